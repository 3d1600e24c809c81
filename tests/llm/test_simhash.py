import random

import numpy as np
import xxhash

from wardlake.llm import simhash
from wardlake.llm.components import components


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_codewords_are_the_golay_code():
    table = simhash.near_patterns()
    counts = (table >= 0).sum(axis=1)
    assert sorted(set(counts.tolist())) == [1, 6] and (counts == 6).sum() == 1771


def test_two_flips_share_a_key():
    rng = random.Random(3)
    table = simhash.near_patterns()
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        keys = simhash.keys_of(np.array([a, b], dtype=np.uint64).view(np.int64), table)
        assert set(keys[0][keys[0] >= 0]) & set(keys[1][keys[1] >= 0])


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    rows = components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()
    want = groups(400, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in rows} == {x: want[x] for x in nodes} and len(rows) == len(nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_connect_what_is_near_in_crowded_buckets_too(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(250):  # one crowd, in which many are near
        x = centre
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    number = {x: i for i, x in enumerate(signed)}
    near = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    ours = [(number[r["a"]], number[r["b"]]) for r in links]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 2 for a, b in ours)
    assert groups(len(prints), ours) == groups(len(prints), near)


def test_groups_of_documents(docs, no_docs, texts):
    rows = simhash.grouped(docs).collect()
    prints = [plain_print(t) for _, t, _ in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    roots = groups(len(texts), links)
    least = {}
    for (i, _, _), root in zip(texts, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    want = sorted(((i, f"{p:016x}", least.get(r)) for (i, _, _), p, r in zip(texts, prints, roots)), key=repr)
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in rows]
    assert sorted(got, key=repr) == want
    assert simhash.grouped(no_docs).count() == 0
    kept = simhash.deduplicated(docs).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(least.values()))
    # The row without id and with words is a group of its own; the one without text is in the group of the empty ones.
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here at all"]
    assert kept[0].asDict().keys() == set(docs.columns)


def test_every_group_keeps_a_text_whatever_the_ids(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five six " * 9, "x y z u v w q r s t " * 9)
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (1, a), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "d", 3) for r in rows], "doc_id bigint, text string, digest string, n_rows int").repartition(3)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (None, c), (4, None)], key=repr)
