import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import simhash as S


def brute_print(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, bits=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_position_sets_meet_every_four_bytes():
    from itertools import combinations
    for size, count in ((3, 20), (4, 70)):
        sets = S.position_sets(size)
        assert len(sets) == count
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))


def test_print_is_the_brute_force_one_in_segments_too(monkeypatch):
    rng = random.Random(1)
    texts = ["", " \t\n", "one", "a B c", "Ünï CODE Straße x", "a b c d", "a b c d a b c d a"]
    texts += [" ".join(rng.choice("the of and to x y in".split(" ")) for _ in range(rng.randint(4, 300))) for _ in range(30)]
    want = [brute_print(t) for t in texts]
    assert [S.simhash(t.encode()) for t in texts] == want
    monkeypatch.setattr(S, "SEGMENT", 16)
    assert [S.simhash(t.encode()) for t in texts] == want


def near_prints(rng, groups=60, size=12):
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            p = base
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return sorted(out)


@pytest.mark.parametrize("limit,wide", [(4096, False), (4096, True), (3, False), (3, True), (1, False)])
def test_links_give_the_classes_of_all_pairs(spark, limit, wide):
    prints = near_prints(random.Random(limit), 40)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    at = {p: i for i, p in enumerate(signed)}
    roots = {r["node"]: r["root"] for r in S.components(S.links(df, 4, limit, wide)).collect()}
    got = [at[roots.get(p, p)] for p in signed]
    assert same_partition(got, brute_classes(prints))


def test_a_chain_and_a_hub_contract(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (7, 6), (7, 6)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1
    assert got[0] != got[1000] and len(got) == 501


def test_odd_rows(spark):
    rows = [(1, "", "x"), (2, None, "x"), (3, "the same words in both", None), (9, "the same words in both", "x"),
            (9, "the same words in both", "x"), (None, "the same words in both", "x"), (None, "alone here", "x"), (4, "w " * 50000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string").withColumn("_id", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (9, 3), (9, 3), (None, 3), (None, None), (4, 4)], key=str)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "3", "4", "None", "None"]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    a, b, c = "the first words here", "quite another set of things", "some third text stands alone"
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (7, c, 5), (7, c, 4), (None, a, 6), (None, a, 6), (None, c, 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int")
    got = S.one_of_each(docs).collect()
    assert sorted((r["doc_id"], r["text"], r["n"]) for r in got if r["doc_id"]) == [(3, b, 1), (5, a, 2), (7, c, 4)]
    assert sorted((r["text"], r["n"]) for r in got if r["doc_id"] is None) == sorted([(a, 6), (c, 7)])


def test_query_is_brute_force_on_the_documents(spark):
    from parlance.llm.catalog import queries
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries()["op9_simhash_near_duplicates"](spark, sf).collect()}
    prints = [brute_print(d["text"]) for d in docs]
    assert all(got[d["doc_id"]]["fingerprint"] == f"{p:016x}" for d, p in zip(docs, prints))
    roots = brute_classes(prints)
    least = {}
    for d, r in zip(docs, roots):
        least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    assert all(got[d["doc_id"]]["component_id"] == least[r] for d, r in zip(docs, roots))
