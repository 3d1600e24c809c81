import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from wardlake.llm import queries, spelling
from wardlake.llm.common import stored


def counted_plainly(rows, least_length=7, least_count=2):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped_plainly(words, times=10):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_the_acceptor_is_minimal_and_accepts_its_strings():
    rng = random.Random(3)
    strings = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    machine = spelling.Acceptor(strings)

    def language(state):
        out = {""} if machine.final[state] else set()
        for letter, after in machine.arcs[state].items():
            out |= {letter + rest for rest in language(after)}
        return frozenset(out)

    assert language(0) == set(strings)
    reached, todo = set(), [0]
    while todo:
        state = todo.pop()
        if state not in reached:
            reached.add(state)
            todo.extend(machine.arcs[state].values())
    assert len({language(s) for s in reached}) == len(reached)


def test_composition_accepts_each_pair_once():
    rng = random.Random(4)
    for size in (2, 5, 40):
        longer = sorted({"".join(rng.choice("ab") for _ in range(6)) for _ in range(size)})
        shorter = sorted({"".join(rng.choice("ab") for _ in range(5)) for _ in range(size)})
        found = Counter(frozenset(p) for p in spelling.one_edit_pairs(spelling.Acceptor(longer), spelling.Acceptor(shorter)))
        wanted = [p for p in itertools.combinations(longer, 2) if one_edit(*p)]
        wanted += [p for p in itertools.product(longer, shorter) if one_edit(*p)]
        assert found == Counter(map(frozenset, wanted))


@pytest.fixture(scope="module")
def variants():
    """Words of few letters, so that many are near, with forms of forms; repeated, null and empty texts."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    rows += [(100, "Mentrean " * 3), (101, "menttrean\x00MENTREAN÷x"), (102, "menttrean, mentrean ÀÉÎ×÷ÿaa ÀÉÎ×÷ÿaa")]
    rows += [(200 + i, "organiser " * 400) for i in range(3)] + [(210, "organizer " * 40), (211, "organizers " * 3)]
    rows += [(300, None), (301, ""), (302, "1 2 short"), (None, "abababab abababab"), (303, "x" * 50_000), (304, "x" * 50_000), (304, "x" * 49_999 + " " + "x" * 49_999)]
    return rows + rows[:5]


@pytest.mark.parametrize("most_words", [20_000, 1_000])
def test_forms_and_roots_against_brute_force(spark, variants, most_words):
    docs = spark.createDataFrame([(*r, 1) for r in variants], "doc_id bigint, text string, n int").repartition(4)
    found = [tuple(r) for r in spelling.grouped_words(docs, most_words=most_words).collect()]
    wanted = grouped_plainly(counted_plainly(variants))
    assert len(found) == len(wanted) and set(found) == wanted
    assert any(form and root != form for _, form, root, *_ in found)


def test_large_partitions_are_cut_without_losing_a_pair(spark):
    rng = random.Random(9)
    words = sorted({"samestart" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(2_500)})
    table = spark.createDataFrame([(w, 2 + i % 7) for i, w in enumerate(words)], "word string, n bigint")
    placed = stored(spelling.partitions(table, 1_000), "test")
    assert placed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 1_000
    found = {r["word"]: r["n_near"] for r in spelling.near_words(table, 1_000).collect()}
    known = set(words)
    for word in words[::50]:
        changes = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abcdefghijsmrt"} - {word}
        assert found.get(word, 0) == len(changes & known)


def test_no_documents(spark, no_docs):
    grouped = spelling.grouped_words(no_docs)
    assert grouped.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not grouped.collect()


def test_query(spark, texts, tables):
    found = {tuple(r) for r in queries.op12_spelling_variants(spark, tables).collect()}
    assert found == grouped_plainly(counted_plainly([(i, t) for i, t, _ in texts]))
