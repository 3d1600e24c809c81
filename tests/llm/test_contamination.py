import random
import re
import subprocess
import sys
import time

from pyspark.sql import functions as F

from wardlake.llm import contamination as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({a: a + 32 for a in range(65, 91)}))


def plain_report(words, items, window):
    hit, found = set(), set()
    for item, its in items:
        for w in [its] if 0 < len(its) < window else [its[k : k + window] for k in range(len(its) - window + 1)]:
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    found.add(item)
    return len(words), hit, sorted(found)


def test_automaton_against_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        letters = [bytes([97 + i]) for i in range(rng.choice([2, 3, 6]))]
        items = [(i, [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for i in range(6)]
        docs = [[rng.choice([*letters, b"zz"]) for _ in range(rng.randint(0, 30))] for _ in range(5)]
        for words, (ranges, found) in zip(docs, c.SuffixAutomaton(items, 4).read(docs)):
            _, hit, want = plain_report(words, items, 4)
            assert {i for a, b in ranges for i in range(a, b)} == hit and found == want


def test_equal_words_take_linear_time():
    def seconds(n):
        machine = c.SuffixAutomaton([(1, [b"a"] * n), (2, [b"a"] * 5)])
        start = time.process_time()
        ((ranges, items),) = machine.read([[b"a"] * 2 * n])
        assert ranges == [(0, 2 * n)] and items == [1, 2]
        return time.process_time() - start

    assert seconds(32_000) < 12 * max(seconds(8_000), 0.01)


def test_automaton_is_read_without_the_package(tmp_path):
    (tmp_path / "sent").write_bytes(c._sent(c.SuffixAutomaton([(7, [b"a", b"b"])])))
    code = "from pyspark import cloudpickle; m = cloudpickle.loads(open('sent', 'rb').read()); print(m.read([[b'x', b'a', b'b']]))"
    clean = {"PATH": "/usr/bin:/bin"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[([(1, 3)], [7])]"


def make_items(texts):
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(40)}" for _ in range(rng.randint(14, 40)))) for i in range(12)]
    words = next(t for i, t, _ in texts if i == 7).split()
    items += [(50, " ".join(words[:20]).translate({a: a - 32 for a in range(97, 123)})), (51, "ünder, THE é!"), (52, None), (53, ""), (54, "..."), (None, "a b"), (50, items[0][1])]
    return items


def test_reports(spark, docs, no_docs, texts):
    items = make_items(texts)
    more = [(900, "x " + items[1][1] + " y", "en", "s", 1, "g", "s", "r", 1), (901, "under ünder the é " * 3, None, None, 1, "", "", "", 1),
            (902, " ".join(["pad"] * 2000) + " " + items[2][1], "en", "s", 1, "g", "s", "r", 1)]
    all_docs = docs.union(spark.createDataFrame(more, docs.schema))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, report string")
    plain = [(i, plain_words(t)) for i, t in items if i is not None]
    for block_words in (500_000, 60):
        rows = c.with_hits(all_docs, benchmark, into="found", block_words=block_words).withColumn("bad", c.is_contaminated(F.col("found")))
        bad = set()
        for r in rows.collect():
            n, hit, found = plain_report(plain_words(r["text"]), plain, 13)
            got = {i for h in r["found"]["hits"] for i in range(h["start"], h["stop"])}
            assert (r["found"]["n_words"], got, list(r["found"]["items"])) == (n, hit, found)
            assert r["bad"] == (len(hit) > 0 and 20 * len(hit) >= n)
            bad |= {r["doc_id"]} if r["bad"] else set()
        assert {7, 900, 901} <= bad and 902 not in bad
    kept = c.decontaminated(all_docs, benchmark)
    assert kept.columns == all_docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({7, 900, 901})
    assert kept.count() == all_docs.count() - rows.where("bad").count()
    cut = {r["doc_id"]: r["text"] for r in c.decontaminated(all_docs, benchmark, cut_spans=True).collect()}
    assert cut[900] == "x  y" and cut[902] == more[2][1]
    assert c.with_hits(no_docs, benchmark).count() == 0
    nothing = c.with_hits(docs, benchmark.limit(0)).select("report.items").distinct().collect()
    assert [list(r[0]) for r in nothing] == [[]]
