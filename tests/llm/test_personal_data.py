import re

from pyspark.sql import functions as F

from wardlake.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_spans(docs, no_docs, texts):
    rows = pii.found_data(docs).collect()
    got = [(r["doc_id"], [tuple(x) for x in r["base"]]) for r in rows]
    # The plain patterns take the square of these two texts' length.
    long = {308, 309}
    want = [(i, plain_spans(t)) for i, t, _ in texts if i not in long]
    assert sorted((g for g in got if g[0] not in long), key=repr) == sorted(want, key=repr)
    assert all(spans == [] for i, spans in got if i in long) and len(got) == len(texts)
    assert {k for _, spans in want for k, _, _ in spans} == set(pii.KINDS)
    assert pii.found_data(no_docs).count() == 0


def test_odd_texts_against_plain_patterns(spark):
    import random

    rng = random.Random(9)
    texts = ["".join(rng.choice("a1.@-+ ()%2é5_") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("12 -4") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [" 7.1.2.3" * 1500, "a@b.c " * 2000, "1 " * 20_000]
    rows = pii.with_base_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").select(
        "i", F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["stop"])).alias("base")
    )
    for row in rows.collect():
        assert [tuple(x) for x in row["base"]] == plain_spans(texts[row["i"]]), texts[row["i"]][:200]


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"some words here write to user{i}@mail.example.com now or call desk") for i in range(8)]
    rows += [(20, "please write to user77(at)example now"), (21, "the 77th of many things 5 times"), (22, None)]
    rows += [(30 + i, "the word the thing the other the one now 12 or") for i in range(5)]
    made = spark.createDataFrame([(i, t.replace("write to", "write mailto:") if t else t) for i, t in rows], "doc_id bigint, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.found_data(made).collect()}
    text = dict(rows)[20].replace("write to", "write mailto:")
    start = text.index("user77")
    assert found.pop(20) == [("like_email", start, start + len("user77(at)example"))]
    assert all(spans == [] for spans in found.values())


def test_instances_found_in_one_round_induce_patterns_in_the_next(spark):
    rows = [(i, f"some words here write mailto: user{i}@mail.example.com now or call") for i in range(40)]
    rows += [(100 + i, f"some words here write mailto: nick{i} now or call") for i in range(10)]
    rows += [(200 + i, f"reached under handle: nick{i}") for i in range(10)]
    rows += [(300, "reached under handle: zed9"), (301, "the word 9 and zed")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.found_data(made).collect()}
    assert found[300] == [("like_email", 22, 26)]
    assert all(len(found[i]) == 1 for i in [*range(100, 110), *range(200, 210)])
    assert found[301] == [] and all(found[i] == [] for i in range(40))
