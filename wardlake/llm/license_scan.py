"""License scans: notices and identifier tags by one Aho-Corasick pass, license expressions by a shunting yard.

A text becomes its words with one blank between them, and one automaton of all phrases reads
that once.  Where a tag such as ``SPDX-License-Identifier`` ends, the text itself is read on as an
expression of identifiers, ``and``, ``or``, ``with`` and parentheses.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Phrases of well-known notices, as words with one blank between them.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache org licenses license 2 0": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl-1",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution 4 0": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "all rights reserved": "reserved",
}
# Phrases after which an expression may stand.
TAGS = ("spdx license identifier", "license identifier", "license expression", "license", "licence")
# Identifiers of expressions, by label.
IDENTIFIERS = {
    "mit": "mit mit-0 x11 expat", "apache-2": "apache-2.0 apache-2 apache2", "gpl-2": "gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-2 gplv2",
    "gpl-3": "gpl-3.0 gpl-3.0-only gpl-3.0-or-later gpl-3 gplv3", "agpl-3": "agpl-3.0 agpl-3.0-only agpl-3.0-or-later",
    "lgpl": "lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later",
    "mpl-2": "mpl-2.0", "epl-2": "epl-1.0 epl-2.0", "bsd": "bsd-2-clause bsd-3-clause 0bsd", "isc": "isc", "bsl-1": "bsl-1.0",
    "unlicense": "unlicense", "cc0": "cc0-1.0", "cc-by": "cc-by-3.0 cc-by-4.0", "cc-by-sa": "cc-by-sa-3.0 cc-by-sa-4.0",
    "cc-by-nc": "cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0", "cc-by-nd": "cc-by-nd-4.0",
}
# How much a license leaves the user free to do, from nothing to anything.
FREEDOM = {
    "reserved": 0.0, "cc-by-nc": 0.2, "cc-by-nd": 0.3, "agpl-3": 0.4, "gpl-2": 0.5, "gpl-3": 0.5, "cc-by-sa": 0.5, "lgpl": 0.6,
    "mpl-2": 0.6, "epl-2": 0.6, "cc-by": 0.8, "apache-2": 0.9, "bsd": 0.9, "bsl-1": 0.9, "mit": 0.9, "isc": 0.9, "unlicense": 1.0, "cc0": 1.0,
}
UNKNOWN_FREEDOM = 0.0
# An exception to a license leaves at least this.
EXCEPTION_FREEDOM = 0.6

BINDING = {"or": 1, "and": 2, "with": 3}
LABEL_OF = {name: label for label, names in IDENTIFIERS.items() for name in names.split()}
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Between a tag and its expression: an optional quote, a colon or an equals sign, an optional quote.
OPENING = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?))")
BLANK = 32


class Terms(NamedTuple):
    """What an expression comes to: all labels, those of the freest choice, its freedom, known and all identifiers."""

    labels: frozenset
    chosen: frozenset
    freedom: float
    known: int
    named: int


def leaf(name: str) -> Terms:
    label = LABEL_OF.get(name.rstrip("+"))
    labels = frozenset([label] if label else [])
    return Terms(labels, labels, FREEDOM.get(label, UNKNOWN_FREEDOM), int(label is not None), 1)


def combined(operator: str, left: Terms, right: Terms) -> Terms:
    """``or`` takes the freer side (the left one of two equals), ``and`` binds by both, ``with`` excepts from the left side."""
    if operator == "with":  # what is on the right names an exception and no license
        return left._replace(freedom=max(left.freedom, EXCEPTION_FREEDOM) if left.known else left.freedom)
    both = left.labels | right.labels
    known, named = left.known + right.known, left.named + right.named
    if operator == "and":
        return Terms(both, left.chosen | right.chosen, min(left.freedom, right.freedom), known, named)
    best = left if left.freedom >= right.freedom else right
    return Terms(both, best.chosen, best.freedom, known, named)


def postfix(text: bytes, at: int) -> list[str]:
    """The longest expression from ``at`` on in postfix order, by a shunting yard; empty if there is none.

    ``with`` binds closer than ``and``, that closer than ``or``; equal operators group from the left.  The expression
    ends before the first token that cannot go on with it.  A parenthesis left open closes at the end; an operator without a
    right side is left out.  Operators are tokens as ``|or``, names cannot have a bar.
    """
    out: list[str] = []
    waiting: list[str] = []
    wants_name, opened = True, 0
    while token := TOKEN.match(text, at):
        bracket, name = token.groups()
        if bracket == b"(":
            if not wants_name:
                break
            waiting.append("(")
            opened += 1
        elif bracket == b")":
            if wants_name or not opened:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
            opened -= 1
        else:
            word = name.decode("ascii")
            if wants_name:
                if word in BINDING:
                    break
                out.append(word)
                wants_name = False
            else:
                if word not in BINDING:
                    break
                while waiting and waiting[-1] != "(" and BINDING[waiting[-1][1:]] >= BINDING[word]:
                    out.append(waiting.pop())
                waiting.append(f"|{word}")
                wants_name = True
        at = token.end()
    if wants_name:  # brackets and an operator that nothing follows
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    out.extend(w for w in reversed(waiting) if w != "(")
    return out


def evaluated(tokens: list[str]) -> Terms | None:
    """The terms of a postfix expression; none without a known identifier."""
    stack: list[Terms] = []
    for token in tokens:
        if token[0] == "|":
            right = stack.pop()
            stack.append(combined(token[1:], stack.pop(), right))
        else:
            stack.append(leaf(token))
    return stack[0] if stack and stack[0].known else None


class Scanner:
    """All phrases in one automaton; ``read`` gives what one text says."""

    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        phrases = [(p, "base", label) for p, label in BASE.items()] + [(p, "notice", label) for p, label in NOTICES.items()]
        # The same phrase may be of several kinds.
        meanings: dict[str, list] = {}
        for phrase, kind, label in [*phrases, *((p, "tag", "") for p in TAGS)]:
            meanings.setdefault(f" {phrase} ", []).append((kind, label))
        for padded, meaning in meanings.items():
            self.machine.add_word(padded, (len(padded), padded.count(" ") - 1, meaning))
        self.machine.make_automaton()

    def read(self, text: str | None) -> dict:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        folded = raw.translate(FOLD)
        words = folded.split()
        places, expressions = [], []
        if words:
            # Bytes as characters: phrases are ASCII, of which no byte of another letter is one.
            line = f" {b' '.join(words).decode('latin-1')} "
            found = list(self.machine.iter(line))
            if found:
                blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == BLANK)
                firsts = np.searchsorted(blanks, [end - length + 1 for end, (length, _, _) in found])
                tags = {}
                for first, (_, (_, n, meaning)) in zip(firsts.tolist(), found):
                    for kind, label in meaning:
                        if kind == "tag":
                            tags[first + n] = min(first, tags.get(first + n, first))
                        else:
                            places.append({"label": label, "start": first, "stop": first + n, "base": kind == "base"})
                if tags:
                    expressions = list(self._expressions(raw, folded, tags))
        places.sort(key=lambda p: (p["start"], p["stop"], p["label"], not p["base"]))
        return {"n_words": len(words), "places": places, "expressions": expressions}

    def _expressions(self, raw: bytes, folded: bytes, tags: dict[int, int]) -> Iterator[dict]:
        lowered = raw.translate(LOWERED)
        inside = np.frombuffer(folded, dtype=np.uint8) != BLANK
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        for after, first in sorted(tags.items()):
            opening = OPENING.match(lowered, int(ends[after - 1]))
            terms = evaluated(tokens := postfix(lowered, opening.end())) if opening else None
            if terms:
                yield {
                    "start": first, "expression": " ".join(t.lstrip("|") for t in tokens), "labels": sorted(terms.labels),
                    "chosen": sorted(terms.chosen), "freedom": terms.freedom, "known": terms.known / terms.named,
                }


PLACES = "array<struct<label:string,start:bigint,stop:bigint,base:boolean>>"
EXPRESSIONS = (
    "array<struct<start:bigint,expression:string,labels:array<string>,chosen:array<string>,freedom:double,known:double>>"
)


def with_licenses(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``; ``places`` of phrases (words from 0, end exclusive), base or not;
    ``expressions`` after tags in postfix order, with all labels, those of the freest choice, their freedom, and the share of known identifiers.

    Null and empty texts have no words and no places.  A text of any length is read whole, in time in proportion to its length.  Places
    may overlap and all count.  Where two tags end at one word the longer one counts, once.  Rows may repeat; other columns are kept, and one named ``into``
    is replaced; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])
    expression = pa.struct([
        ("start", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("chosen", pa.list_(pa.string())),
        ("freedom", pa.float64()), ("known", pa.float64()),
    ])
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("expressions", pa.list_(expression))])

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for batch in texts:
            yield pa.array([scanner.read(value.as_py()) for value in batch], type=kind)

    scan.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scanned = F.arrow_udf(scan, f"struct<n_words:bigint,places:{PLACES},expressions:{EXPRESSIONS}>").asNondeterministic()
    return docs.withColumn(into, scanned(F.col(text)))


def base_places(licenses: Column) -> Column:
    return F.filter(licenses["places"], lambda p: p["base"])


def labels_of(licenses: Column) -> Column:
    """All labels of a text, sorted: of base phrases, notices and expressions."""
    said = F.flatten(F.transform(licenses["expressions"], lambda e: e["labels"]))
    return F.array_sort(F.array_distinct(F.concat(F.transform(licenses["places"], lambda p: p["label"]), said)))


def evidence(licenses: Column) -> Column:
    """From 0 (no statement) to 1: the strongest statement.

    A phrase of w words is worth 1 - 1/2^w, an expression the share of its identifiers that are known.
    """
    phrases = F.transform(licenses["places"], lambda p: 1 - F.pow(F.lit(2.0), p["start"] - p["stop"]))
    return F.coalesce(F.array_max(F.concat(phrases, F.transform(licenses["expressions"], lambda e: e["known"]))), F.lit(0.0))


def freedom(licenses: Column) -> Column:
    """The least freedom that any statement of a text leaves; null without one."""
    known = F.create_map(*(F.lit(x) for pair in FREEDOM.items() for x in pair))
    phrases = F.transform(licenses["places"], lambda p: F.element_at(known, p["label"]))
    return F.array_min(F.concat(phrases, F.transform(licenses["expressions"], lambda e: e["freedom"])))
