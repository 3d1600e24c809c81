import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from wardlake.llm import filter_audit, queries

BLANKS = " \t\n\x0b\x0c\r"


def failed_plainly(rows):
    """The filters that each (doc_id, text, lang) row fails."""
    ids = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = "".join(" " if c in BLANKS else c for c in text).split(" ")
        words = [w for w in words if w]
        failed = {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        failed |= {"D"} if any(c in text for c in "#$%&*|") else set()
        failed |= {"E"} if doc_id is not None and any(i < doc_id for i in ids[text]) else set()
        out.append(failed)
    return out


def audited_plainly(rows, labels):
    """Every order played through with the documents."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    failed = failed_plainly(rows)
    out = []
    for part in {lang or "" for *_, lang in rows}:
        here = [(row[0], f) for row, f in zip(rows, failed) if (row[2] or "") == part]
        lines, total = [], Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                total[letter] += len(gone)
                every = [f for _, f in here if letter in f]
                lines.append((
                    part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(f == {letter} for f in every),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter,
                ))
        out += [line[:-1] + (total[line[-1]],) for line in lines]
    return out


LABELS = "doc_id bigint, quality int, toxic int, text string, part string"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129, 5_000])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    wanted = [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
    assert filter_audit.set_bits(words).tolist() == wanted


def test_truth_tables():
    for failed in range(32):
        word = filter_audit.truth_table(failed)
        assert all((word >> s & 1) == (s & failed == 0) for s in range(32))


def test_against_brute_force(spark, docs, texts, tables):
    rng = random.Random(2)
    more = [(400 + i, f"Word{i % 40} " * 250 + "#" * (i % 2), rng.choice(["en", "", None])) for i in range(120)]
    more += [(600 + i, "the same text again " * 3, "de") for i in range(300)] + [(None, "the same text again " * 3, "de")] * 2
    rows = texts + more
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 700, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, failed int").repartition(6)
    known = spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS)
    found = sorted(tuple(r) for r in filter_audit.audited(frame, known).collect())
    assert found == sorted(audited_plainly(rows, labels))


def test_without_documents_or_labels(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audited(no_docs, none).collect() == []
    found = sorted(tuple(r) for r in filter_audit.audited(docs, none).collect())
    assert found == sorted(audited_plainly(texts, []))


def test_query(spark, docs, texts, tables):
    spark.createDataFrame([(3, 1, 0, "", ""), (105, 1, 1, "", "")], LABELS).write.mode("overwrite").parquet(f"{tables}/labels.parquet")
    found = sorted(tuple(r) for r in queries.op13_filter_audit(spark, tables).collect())
    assert found == sorted(audited_plainly(texts, [(3, 1, 0), (105, 1, 1)]))
