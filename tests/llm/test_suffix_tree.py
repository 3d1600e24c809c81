import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from wardlake.llm import suffix_tree_lm as lm


def tokens(text):
    out = (text or "").encode().lower().split()
    return [*out, None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores(docs, no_docs, texts):
    counts = Counter(w for i, t, _ in texts if not held_out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in texts:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want.append((i, held_out(i), len(ws), sum(counts[w] > 0 for w in ws), n, base))
    got = sorted((tuple(r)[:6] for r in lm.scored(docs).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    for g, w in zip(got, sorted(want, key=repr)):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
    assert lm.scored(no_docs).count() == 0


def symbols_of(alphabet, text):
    return [int(alphabet[0][p]) for p in lm.code_points(lm.normal(text))]


def plain_counts(texts, alphabet):
    counts = defaultdict(Counter)
    for t in texts:
        run = [lm.END] * lm.DEPTH + symbols_of(alphabet, t) + [lm.END]
        for i in range(lm.DEPTH, len(run)):
            for d in range(lm.DEPTH + 1):
                counts[tuple(run[i - d : i])][run[i]] += 1
    return counts


def plain_kept(counts):
    def passes(context):
        c, up = counts[context], counts[context[1:]]
        n, m = sum(c.values()), sum(up.values())
        gain = sum(k * math.log((k / n) / (up[x] / m)) for x, k in c.items())
        return gain >= lm.LEAST_GAIN + lm.GAIN_A_KIND * (len(c) - 1)

    return {()} | {c[j:] for c in list(counts) if c and passes(c) for j in range(len(c) + 1)}


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def contexts_of(spark, texts):
    """The kept contexts of a table in which every text is learned from."""
    frame = frame_of(spark, [(None, t) for t in texts])
    alphabet = lm.learned_alphabet(frame.select("text"))
    chunks = lm.chunks_of(frame.selectExpr("doc_id", "text", "bigint(1) AS weight"), alphabet)
    counts = lm.run_counts(lm.run_entries(chunks, weighted=True).groupBy("code").agg(F.sum("n").alias("n")))
    kept = lm.kept_contexts(counts)
    mask = (1 << lm.BITS) - 1
    return {()} | {
        tuple((r["context"] >> lm.BITS * k) & mask for k in range(depth))[::-1]
        for depth in range(1, lm.DEPTH + 1) for r in kept[depth].collect()
    }, alphabet


def test_scores_against_plain_tree(spark, texts):
    some = [(i, t) for i, t, _ in texts if t is None or len(t) < 3000][:40]
    greek = ["η γλώσσα και ο λόγος " * 4, "λόγος και 日本語 の 文 " * 3]
    some += [(500 + k, t) for k, t in enumerate(greek)] + [(None, None), (None, ""), (507, "new wörds x9 日本"), (507, "")]
    learn = [t for i, t in some if not held_out(i)]
    assert any(held_out(i) for i, _ in some)
    kept, alphabet = contexts_of(spark, learn)
    counts = plain_counts(learn, alphabet)
    assert kept == plain_kept(counts) and len(kept) > 30

    def odds(context, x):
        c = counts[context] if context in kept else Counter()
        if not context:
            return (c[x] + 0.5) / (sum(c.values()) + 0.5 * lm.SYMBOLS)
        kinds = max(1, len(c))
        return (c[x] + kinds * odds(context[1:], x)) / (sum(c.values()) + kinds)

    def score(t):
        run = [lm.END] * lm.DEPTH + symbols_of(alphabet, t) + [lm.END]
        want = float(alphabet[1][lm.code_points(lm.normal(t))].sum(dtype=np.float64))
        for i in range(lm.DEPTH, len(run)):
            context = next(c for d in range(lm.DEPTH, -1, -1) if (c := tuple(run[i - d : i])) in kept)
            want += math.log10(odds(context, run[i]))
        return want

    got = sorted((repr(r["doc_id"]), r["score"]) for r in lm.scored(frame_of(spark, some).repartition(3)).collect())
    want = sorted((repr(i), score(t)) for i, t in some)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-4 * max(1, abs(w[1])) for g, w in zip(got, want))
    for context in list(kept)[:200]:
        assert abs(sum(odds(context, x) for x in range(lm.SYMBOLS)) - 1) < 1e-9


def test_contexts_grow_with_the_texts_in_each_script(spark, texts):
    prose = [t for _, t, _ in texts if t and 100 < len(t) < 3000][:40]
    greek = [t.translate({97 + k: 0x3B1 + k for k in range(24)}) for t in prose]
    small, _ = contexts_of(spark, prose[:8] + greek[:8])
    large, alphabet = contexts_of(spark, prose + greek)
    assert len(large) > 1.5 * len(small)
    own = set(alphabet[0][0x3B1:0x3C9].tolist()) - {lm.OTHER}
    assert len(own) > 8 and sum(set(c) <= own for c in large if c) > len(large) / 4


def test_long_texts_are_read_in_pieces(monkeypatch):
    symbols = np.random.default_rng(1).integers(2, 9, 1000).astype(np.uint16)
    (whole,) = lm.runs_of(symbols)
    for piece in (1, 3, 7, 500, 1000, 1001):
        monkeypatch.setattr(lm, "PIECE", piece)
        assert np.array_equal(np.concatenate(list(lm.runs_of(symbols))), whole)
    assert len(whole) == 1001
    monkeypatch.setattr(lm, "PIECE", 70)
    codes, counts = lm.counted_runs([symbols, symbols[:0], symbols], np.array([1, 1, 0]))
    want = Counter(whole.tolist()) + Counter(next(lm.runs_of(symbols[:0])).tolist())
    assert dict(zip(codes.tolist(), counts.tolist())) == dict(want) and (np.diff(codes) > 0).all()


def test_without_anything_to_learn_from(spark):
    held = next(i for i in range(99) if held_out(i))
    rows = lm.scored(frame_of(spark, [(held, "a b"), (held, None)])).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in rows] == [(0, 0)] * 2 and all(r["score"] < 0 for r in rows)
