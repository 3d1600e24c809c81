import re
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from wardlake.llm import secret_scan as s


def plain_spans(text):
    text = text or ""
    assign = re.compile(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans(texts):
    for _, text, _ in texts:
        assert s.base_spans(text or "") == plain_spans(text)
    assert any(plain_spans(t) for _, t, _ in texts)


def test_viterbi_finds_the_best_tags():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        for left, right in ((None, None), (0, 0), (None, 0)):
            scores, pairs = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))

            def total(tags):
                path = [*([left] if left is not None else []), *tags, *([right] if right is not None else [])]
                return sum(scores[i, t] for i, t in enumerate(tags)) + sum(pairs[a, b] for a, b in zip(path, path[1:]))

            best = max(product(range(3), repeat=n), key=total)
            assert s.viterbi(scores, pairs, left, right) == list(best)


def windows(texts):
    return [w for _, t, _ in texts if t and len(t) < 5000 for w in s.training_windows(t)]


def test_pruned_decoding_is_whole_decoding(texts):
    field = s.trained(windows(texts), steps=40)
    some = [t for _, t, _ in texts if t and 0 < len(t) < 5000]
    got = s.Tagger(field).tagged(some)
    for text, ranges in zip(some, got):
        words = text.split()
        bits = np.array([s.word_bits(w) for w in words]) if words else np.zeros(0, dtype=np.int64)
        if not len(bits):
            assert ranges == []
            continue
        rows = s.unpacked(bits)
        scores = rows @ field.here + s.unpacked_file(np.array([s.file_bits(text, len(words), int(((bits & s.ODD) > 0).sum()))])) @ field.text
        scores[1:] += rows[:-1] @ field.before
        scores[:-1] += rows[1:] @ field.after
        tags = s.viterbi(scores, field.pairs)
        tagged = {i for a, b in ranges for i in range(a, b)}
        assert tagged == {i for i, tag in enumerate(tags) if tag != s.OUTSIDE}


def test_learned_field_finds_what_it_was_shown(texts):
    field = s.trained(windows(texts))
    hits = s.Tagger(field).tagged(["the thing and password=b7db7aa4a5fcc78305 on the other", "the thing and the other on and on"])
    assert hits[0] == [(3, 4)] and hits[1] == []


def test_scan_and_mask(docs, no_docs, texts):
    field = s.learned(docs)
    rows = s.with_secrets(docs, field, into="found").select("doc_id", "text", "found", "spans").collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = [(x["kind"], x["start"], x["stop"]) for x in row["found"]]
        assert [x for x in spans if x[0] != "tagged"] == plain_spans(row["text"])
        assert row["spans"] == "s"
        for kind, a, b in spans:
            if kind == "tagged":
                assert row["text"][a:b].strip() and not any(p < b and a < q for k, p, q in spans if k != "tagged")
    clean = s.with_secrets(docs, field, into="found").select("doc_id", s.masked(F.col("text"), F.col("found")).alias("t"))
    assert not any(plain_spans(r["t"]) for r in clean.collect() if r["t"] and "secret=token" not in r["t"])
    assert s.learned(no_docs) is None
    assert s.with_secrets(no_docs, None).count() == 0


def test_windows_of_one_text_are_bounded():
    text = " ".join(f"word{i} password=abc{i}def456" for i in range(3000))
    windows = s.training_windows(text)
    assert sum(w["secret"] for w in windows) <= s.SECRETS_PER_DOCUMENT + s.ODD_PER_DOCUMENT
    assert windows == s.training_windows(text)


def test_windows_with_and_without_secrets_have_a_share_each(spark, monkeypatch):
    rows = [(i, f"some plain words of text {i} " * 3 + (f"password=abc{i}def456" if i % 10 else "")) for i in range(200)]
    seen = []
    monkeypatch.setattr(s, "trained", lambda windows: seen.extend(windows))
    s.learned(spark.createDataFrame(rows, "doc_id bigint, text string"), windows=20)
    assert [sum(w["secret"] == kind for w in seen) for kind in (True, False)] == [10, 10]
