from functools import cache

from wardlake.llm import pretokens
from wardlake.llm.queries import tokenizer


@cache
def byte_level():
    return pretokens.load(tokenizer("byte_bpe_50k.json"))


@cache
def word_level():
    return pretokens.load(tokenizer("word_bpe_49k.json"))
