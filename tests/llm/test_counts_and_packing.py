import random
import zlib
from collections import defaultdict

import numpy as np
from tests.llm.tokens_of_library import byte_level, word_level

from wardlake.llm import packing, pretokens, token_counts
from wardlake.llm.queries import tokenizer


def odd_texts():
    chars = [chr(c) for c in range(pretokens.PLAIN_BELOW)]
    rng = random.Random(0)
    out = [f"a{c}b{c} {c}1{c}" for c in chars]
    out += ["".join(rng.choice(chars) for _ in range(60)) for _ in range(500)]
    out += ["".join(rng.choice("ab'’sStTdDmM  \n\t12<|>.,ß") for _ in range(40)) for _ in range(500)]
    out += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), 0x301, 0x20])) for _ in range(50)) for _ in range(200)]
    return out + ["x<|endoftext|>y <|startoftext|> z", "日本語 <|endoftext|>  a", "", "<|endoftext|>"]


def test_cuts_equal_the_library():
    coder, whole = pretokens.WordCoder(tokenizer("word_bpe_49k.json")), byte_level()
    pieces = pretokens.Pieces(whole)
    texts = odd_texts()
    for text, ids in zip(texts, coder.ids(texts)):
        assert ids == np.array(word_level().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
        words, specials = pretokens.byte_pretokens(whole, text)
        n = specials + sum(len(pieces(w)) for w in words)
        assert n == len(whole.encode(text, add_special_tokens=False).ids), text


def test_token_counts(docs, no_docs, texts):
    got = sorted(map(tuple, token_counts.token_counts(docs, tokenizer(token_counts.TOKENIZER)).collect()), key=repr)
    want = [
        (i, len((t or "").encode()), len(byte_level().encode(t or "", add_special_tokens=False).ids)) for i, t, _ in texts
    ]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, tokenizer(token_counts.TOKENIZER)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        bins, offsets = packing.best_fit(lengths, capacity)
        left = []  # plain best fit decreasing
        for n in sorted(lengths, reverse=True):
            fits = [k for k, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= n
            else:
                left.append(capacity - n)
        assert sorted(left) == sorted(
            capacity - sum(n for n, b in zip(lengths, bins) if b == k) for k in range(len(left))
        )
        for k in range(len(left)):
            at = 0
            for offset, n in sorted((o, n) for o, n, b in zip(offsets, lengths, bins) if b == k):
                assert offset == at
                at += n
            assert at <= capacity


def test_packing(docs, no_docs, texts):
    path = tokenizer(packing.TOKENIZER)
    rows = packing.packed(docs, path, pieces_per_group=40).collect()
    want = []
    for i, t, _ in texts:
        ids = [*word_level().encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 5
    assert packing.packed(no_docs, path).count() == 0
