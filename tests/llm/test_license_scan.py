import random
import re

import pytest

from wardlake.llm import license_scan, queries

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words_plainly(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places_plainly(words, phrases):
    """(label, start, stop) of every phrase at every place."""
    out = []
    for phrase, label in phrases:
        parts = phrase.split()
        out += [(label, i, i + len(parts)) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return sorted(out, key=lambda p: (p[1], p[2], p[0]))


def descended(tokens):
    """(postfix, freedom, labels) of a whole well-formed expression, by recursive descent."""

    def name():
        token = tokens.pop(0)
        if token == "(":
            inside = alternatives()
            assert tokens.pop(0) == ")"
            return inside
        label = license_scan.LABEL_OF.get(token.rstrip("+"))
        return [token], license_scan.FREEDOM.get(label, 0.0), {label} - {None}

    def level(operator, below, freest):
        left = below()
        while tokens and tokens[0] == operator:
            tokens.pop(0)
            right = below()
            left = (left[0] + right[0] + [f"|{operator}"], freest(left, right), left[2] | (right[2] if operator != "with" else set()))
        return left

    def excepted():
        return level("with", name, lambda a, b: max(a[1], 0.6) if a[2] else a[1])

    def together():
        return level("and", excepted, lambda a, b: min(a[1], b[1]))

    def alternatives():
        return level("or", together, lambda a, b: max(a[1], b[1]))

    return alternatives()


def written(rng, depth=0):
    """A random expression."""
    if depth > 3 or rng.random() < 0.3:
        return rng.choice([*license_scan.LABEL_OF, "licenseref-own", "unknown-1"])
    sides = [written(rng, depth + 1) for _ in range(rng.randint(2, 3))]
    text = "".join(s + rng.choice([" and ", " or "]) for s in sides[:-1]) + sides[-1]
    if rng.random() < 0.2:
        text = f"{rng.choice(['gpl-2.0+', 'mit'])} with some-exception"
    return f"({text})" if rng.random() < 0.6 else text


def test_expressions_against_recursive_descent():
    rng = random.Random(1)
    for _ in range(500):
        text = written(rng)
        wanted = descended(re.findall(r"[()]|[^() ]+", text))
        tokens = license_scan.postfix(text.encode(), 0)
        assert tokens == wanted[0], text
        terms = license_scan.evaluated(tokens)
        assert (terms is None) == (not wanted[2])
        if terms:
            assert (terms.freedom, terms.labels) == (wanted[1], wanted[2])


@pytest.mark.parametrize("text, wanted", [
    ("mit this software", ["mit"]), ("(mit or (apache-2.0", ["mit", "apache-2.0", "|or"]), ("mit or", ["mit"]), ("mit or and", ["mit"]),
    ("mit and (", ["mit"]), ("or mit", []), ("()", []), ("", []), (") mit", []), ("mit) or isc", ["mit"]), ("mit.", ["mit"]),
    ("gpl-2.0+ with classpath-exception-2.0 or mit", ["gpl-2.0+", "classpath-exception-2.0", "|with", "mit", "|or"]),
])
def test_odd_expressions(text, wanted):
    assert license_scan.postfix(text.encode(), 0) == wanted


def test_the_freest_choice():
    terms = license_scan.evaluated(license_scan.postfix(b"gpl-3.0 and mit or apache-2.0 and isc or cc0-1.0 with x", 0))
    assert terms.chosen == {"cc0"} and terms.freedom == 1.0 and terms.labels == {"gpl-3", "mit", "apache-2", "isc", "cc0"}


def test_tags_and_notices():
    read = license_scan.Scanner().read
    text = "é\x00# SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nthe license is fine. \"license\": \"Apache-2.0\", License: see file\nAll rights\treserved"
    report = read(text)
    assert [(e["start"], e["expression"], e["labels"]) for e in report["expressions"]] == [
        (1, "mit gpl-2.0-only or", ["gpl-2", "mit"]), (14, "apache-2.0", ["apache-2"]),
    ]
    assert [(p["label"], p["base"]) for p in report["places"]] == [("reserved", False)]


@pytest.fixture(scope="module")
def licensed(texts):
    rng = random.Random(6)
    bits = [*license_scan.BASE, *license_scan.NOTICES, "Under THE\tmit-license", "cc by cc by nc by nc", "SPDX-License-Identifier: MIT AND ISC", "é"]
    made = [(1_000 + i, " ".join(rng.choices(bits, k=rng.randint(1, 6)))) for i in range(80)]
    made += [(2_000, "cc by nc " * 60_000), (2_001, "(" * 100_000), (2_002, "license: " + "(" * 50_000 + "mit"), (2_003, "license: mit" + " or mit" * 20_000)]
    return [(i, t) for i, t, _ in texts] + made + made[:3]


def test_against_a_plain_search(spark, licensed):
    docs = spark.createDataFrame([(*r, "l", 1) for r in licensed], "doc_id bigint, text string, Labels string, places int").repartition(4)
    read = license_scan.with_licenses(docs, into="found").collect()
    assert len(read) == len(licensed)
    texts = {}
    for doc_id, text in licensed:
        texts.setdefault(doc_id, []).append(text)
    phrases = [(p, label) for label, p in BASE.items()] + list(license_scan.NOTICES.items())
    for row in read:
        if row["doc_id"] in (None, 310):
            continue
        words = words_plainly(texts[row["doc_id"]][0])
        assert row["found"]["n_words"] == len(words)
        found = [(p["label"], p["start"], p["stop"]) for p in row["found"]["places"]]
        assert sorted(found) == sorted(places_plainly(words, phrases))


def test_no_documents(spark, no_docs):
    assert license_scan.with_licenses(no_docs).collect() == []


def test_query(spark, texts, tables):
    found = queries.op11_license_scan(spark, tables).collect()
    assert len(found) == len(texts)
    by_id = {i: t for i, t, _ in texts}
    for row in found:
        if row["doc_id"] is None:
            continue
        places = places_plainly(words_plainly(by_id[row["doc_id"]]), [(p, label) for label, p in BASE.items()])
        assert row["n_base"] == len(places) and row["base_labels"] == ",".join(sorted({p[0] for p in places}))
        assert row["first_word"] == min((p[1] for p in places), default=None)
        assert row["last_word"] == max((p[1] for p in places), default=None)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
