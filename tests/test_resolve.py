import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import leaders, metric
from parlance.operators import resolve as er

ROW = "type string, ord bigint, text string, embedding array<float>"


def texts(spark, n=120, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    return [(f"t{i % 3}", i, f"name {'x' * (i % 5)}{i}", [float(v) for v in rng.normal(size=dim)]) for i in range(n)]


def cos(a, b):
    a, b = np.asarray(a, dtype="float32").astype(float), np.asarray(b, dtype="float32").astype(float)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def greedy(rows, t):
    leader = {}
    for kind in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == kind), key=lambda r: r[1])
        for a in mine:
            if a[1] in leader:
                continue
            leader[a[1]] = a[1]
            for b in mine:
                if b[1] > a[1] and b[1] not in leader and cos(a[3], b[3]) >= t:
                    leader[b[1]] = a[1]
    return leader


def test_similar_pairs_equal_brute_force_for_any_block_size(spark):
    rows = texts(spark)
    df = spark.createDataFrame(rows, ROW)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and cos(a[3], b[3]) >= 0.6}
    for block in (1000, 5):
        assert {(r.lo, r.hi) for r in er.similar_pairs(df, 0.6, block).collect()} == want


def test_guard_restricts_pairs(spark):
    df = spark.createDataFrame([("a", 1, "x", [1.0, 0.0]), ("a", 2, "y", [1.0, 0.0]), ("a", 3, "x", [1.0, 0.0])], ROW)
    assert {(r.lo, r.hi) for r in er.similar_pairs(df, 0.9, guard="text").collect()} == {(1, 3)}


def test_leader_clusters_equal_greedy(spark):
    for seed, t in ((1, 0.5), (2, 0.3)):
        rows = texts(spark, seed=seed)
        df = spark.createDataFrame(rows, ROW)
        got = {r.ord: r.leader for r in er.er_leader_cluster(er.similar_pairs(df, t), df).collect()}
        assert got == greedy(rows, t)
        dense = {r.ord: r.leader for r in er.er_leader_cluster_dense(df, t, front_rows=4).collect()}
        assert dense == got


def test_a_chain_is_not_a_connected_component(spark):
    df = spark.createDataFrame([("s", i, n, [0.0]) for i, n in enumerate("abc")], ROW)
    pairs = spark.createDataFrame([("s", 0, 1, 0.9), ("s", 1, 2, 0.9)], "type string, lo bigint, hi bigint, cosine double")
    got = {r.ord: (r.leader, r.cosine) for r in er.er_leader_cluster(pairs, df).collect()}
    assert got == {0: (0, None), 1: (0, 0.9), 2: (2, None)}


def greedy_leads(pairs):
    below = {}
    for lo, hi in pairs:
        below.setdefault(hi, []).append(lo)
        below.setdefault(lo, [])
    leads = {}
    for n in sorted(below):
        leads[n] = not any(leads[m] for m in below[n])
    return leads


@pytest.mark.parametrize("width, degree, range_texts, most", [(300, 1, 7, 50), (300, 3, 20, 50), (150, 12, 10, 3), (80, 40, 1000, 5)])
def test_leaders_of_random_pairs(spark, width, degree, range_texts, most):
    rng = np.random.default_rng(width + degree)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, width, size=(width * degree, 2)).tolist() if p[0] != p[1]}
    df = spark.createDataFrame([(t, *p) for p in pairs for t in "ab"] + [(None, 1, 2)], "type string, lo bigint, hi bigint")
    got = leaders.leaders(df, range_texts, most).collect()
    assert len(got) == 2 * len(greedy_leads(pairs))
    for t in "ab":
        assert {r.node: r.leads for r in got if r.type == t} == greedy_leads(pairs)


def test_a_long_chain_ends_in_few_rounds(spark):
    n = 10_000
    pairs = spark.range(n - 1).selectExpr("'a' type", "id lo", "id + 1 hi")
    log = []
    got = {r.node: r.leads for r in leaders.leaders(pairs, range_texts=64, log=log).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}
    # Twice as many as rounds are written at most, with the start.
    assert len(log) <= 10
    log = []
    # Two links back: every text has two conditions, and the first range decides the second, and so on.
    pairs = spark.range(2, 600).selectExpr("'a' type", "explode(array(id - 1, id - 2)) lo", "id hi").unionAll(
        spark.sql("select 'a', 0L, 1L"))
    got = {r.node: r.leads for r in leaders.leaders(pairs, log=log).collect()}
    assert got == {i: i % 3 == 0 for i in range(600)} and len(log) <= 10


def test_no_pairs(spark):
    df = spark.createDataFrame([("s", i, n, [0.0]) for i, n in enumerate("abc")], ROW)
    pairs = spark.createDataFrame([], "type string, lo bigint, hi bigint, cosine double")
    assert {r.ord: r.leader for r in er.er_leader_cluster(pairs, df).collect()} == {0: 0, 1: 1, 2: 2}


def test_canonical_name_and_apply(spark):
    clusters = spark.createDataFrame([
        ("S", 0, 0, "absent abdominal pain"), ("S", 1, 0, "absent body aches"), ("S", 2, 0, "absent chest pain"),
        ("S", 3, 3, "rash")], "type string, ord bigint, leader bigint, text string")
    names = {r.leader: (r.canonical_name, r.size) for r in er.er_canonical_name(clusters).collect()}
    assert names == {0: ("absent body aches", 3), 3: ("rash", 1)}
    nodes = spark.createDataFrame([("r", "S", "absent chest pain"), ("r", "T", "absent chest pain")], "res_id string, type string, text string")
    assert sorted(r.text for r in er.er_apply(nodes, clusters).collect()) == ["absent body aches", "absent chest pain"]
    total = er.er_summary(clusters).filter("type is null").first()
    assert (total.texts_before, total.texts_after, total.merged_clusters) == (4, 2, 1)


def test_nearest_label_both_plans(spark):
    rows = texts(spark, 60)
    nodes = spark.createDataFrame([(i, f"t{i % 4}", t, v) for _, i, t, v in rows], "id bigint, type string, text string, embedding array<float>")
    vocab = spark.createDataFrame(texts(spark, 50, seed=9), ROW).withColumnRenamed("text", "label")
    small = {r.id: (r.label, r.cosine) for r in er.nearest_label(nodes, vocab).collect()}
    large = {r.id: (r.label, r.cosine) for r in er.nearest_label(nodes, vocab, broadcast_values=0).collect()}
    assert {k: v[0] for k, v in small.items()} == {k: v[0] for k, v in large.items()}
    assert small[3] == (None, None)  # type t3 has no labels


def test_best_labels_hold_few_cosines_at_once():
    rng = np.random.default_rng(2)
    labels, units = rng.normal(size=(6000, 8)), rng.normal(size=(5000, 8))
    tracemalloc.start()
    at, best = metric.best_labels(units, np.arange(6000), labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 4,096 rows by 6,000 labels, twice, were 393 MB.
    assert peak < 40e6
    some = slice(0, 5000, 50)
    assert (at[some] == (units[some] @ labels.T).argmax(axis=1)).all() and np.allclose(best[some], (units[some] @ labels.T).max(axis=1))


def clustered(seed, clusters=40, each=60, dim=24, spread=0.03, kind="a"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(kind, i, f"n{i}", [float(v) for v in centres[i % clusters] + rng.normal(size=dim) * spread * np.linalg.norm(centres[i % clusters])])
            for i in range(clusters * each)]


def test_clustered_vectors_meet_in_few_cells(spark):
    rows = clustered(1)
    df = spark.createDataFrame(rows, ROW)
    units = np.array([r[3] for r in rows], dtype="float32").astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    lo, hi = np.nonzero(np.triu(units @ units.T >= 0.85, 1))
    got = er.similar_pairs(df, 0.85, 64).collect()
    assert {(r.lo, r.hi) for r in got} == set(zip(lo.tolist(), hi.tolist())) and len(got) == len(lo)
    tasks = metric.pair_tasks(df, 0.85, 64).groupBy("_cell", "_i", "_j", "_mine").count().collect()
    sides = {}
    for r in tasks:
        sides.setdefault((r._cell, r._i, r._j), {})[r._mine] = r["count"]
    compared = sum(n.get(i, 0) * (n.get(i, 0) - 1) / 2 if i == j else n.get(i, 0) * n.get(j, 0) for (_, i, j), n in sides.items())
    assert compared < 0.15 * len(rows) ** 2 / 2
    copies = sum(n for side in sides.values() for n in side.values())
    assert copies < 4 * len(rows)  # all blocks of the type would be 38 each


def test_small_blocks_do_not_multiply_copies(spark):
    rows = [("a", *r[1:]) for r in texts(spark, 800, 16, 3)]
    df = spark.createDataFrame(rows, ROW)
    tasks = metric.pair_tasks(df, 0.3, 4).groupBy("_cell", "_i", "_j").count().collect()
    # Cells of four each went to about a hundred others.
    assert sum(r["count"] for r in tasks) < 32 * len(rows) and len(tasks) < 1024
    want = {(r.lo, r.hi) for r in er.similar_pairs(df, 0.3).collect()}
    got = [(r.lo, r.hi) for r in er.similar_pairs(df, 0.3, 4).collect()]
    assert set(got) == want and len(got) == len(want)


def test_cells_lose_no_pair_on_any_shape(spark):
    rng = np.random.default_rng(5)
    same = [("a", i, "x", [1.0, 2.0, 3.0]) for i in range(60)]
    spread = [("b", 100 + i, "y", [float(v) for v in rng.normal(size=3)]) for i in range(150)]
    odd = [("b", 300, "z", [0.0] * 3), ("b", 301, "z", [0.0] * 3), (None, 302, "z", [1.0] * 3), (None, 303, "z", [1.0] * 3)]
    rows = same + spread + odd
    df = spark.createDataFrame(rows, ROW)
    for t in (0.99, 0.7, 0.1, 0.0, -0.5):
        want = set()
        for kind in "ab":
            mine = [r for r in rows if r[0] == kind]
            u = np.array([r[3] for r in mine])
            n = np.linalg.norm(u, axis=1, keepdims=True)
            u = np.divide(u, n, out=np.zeros_like(u), where=n > 0)
            for i, j in zip(*np.nonzero(np.triu(u.astype("float32").astype(float) @ u.astype("float32").astype(float).T >= t + 1e-6, 1))):
                want.add((mine[i][1], mine[j][1]))
        got = er.similar_pairs(df, t, 16).collect()
        pairs = {(r.lo, r.hi) for r in got}
        assert len(pairs) == len(got) and want <= pairs
        extra = {p for p in pairs - want}
        assert all(abs(r.cosine - t) < 1e-5 for r in got if (r.lo, r.hi) in extra)


def test_nearest_label_in_cells(spark):
    vocab = [(k, i, f"l{i}", v) for k, i, _, v in clustered(2, each=20)] + [("a", 5000 + i, f"m{i}", v) for _, i, _, v in clustered(2, each=1)]
    vocab += [("b", 1, "zero", [0.0] * 24), ("b", 2, "one", [1.0] * 24), (None, 3, "none", [1.0] * 24)]
    nodes = [(i, k, t, v) for k, i, t, v in clustered(3, clusters=10, each=5) + clustered(2, each=3)]
    nodes += [(9000, "b", "n", [1.0] * 24), (9001, "b", "n", [-1.0] * 24), (9002, "b", "n", [0.0] * 24), (9003, "c", "n", [1.0] * 24),
              (9004, "a", "n", None), (9005, None, "n", [1.0] * 24)]
    n = spark.createDataFrame(nodes, "id bigint, type string, text string, embedding array<float>")
    v = spark.createDataFrame(vocab, ROW).withColumnRenamed("text", "label")
    key = lambda rows: sorted((r.id, r.label, r.cosine and round(r.cosine, 9), r.has_labels) for r in rows)
    small = er.nearest_label(n, v).collect()
    assert len(small) == len(nodes)
    assert key(metric.nearest_in_cells(n, v, 32).collect()) == key(small)
    units = np.array([r[3] for r in vocab if r[0] == "a"], dtype="float32").astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    names = [r[2] for r in vocab if r[0] == "a"]
    by_id = {}
    for r in small:
        by_id.setdefault(r.id, []).append(r.label)
    for i, k, _, e in nodes[:170]:
        sims = np.round(units @ (np.asarray(e, dtype="float32").astype(float) / np.linalg.norm(np.asarray(e, dtype="float32").astype(float))), 12)
        assert names[int(sims.argmax())] in by_id[i]
    assert by_id[9000] == ["one"] and by_id[9001] == by_id[9002] == by_id[9003] == by_id[9004] == [None]


def test_vectors_ask_few_cells():
    """On clusters, the first cell's answer leaves hardly any other cell open."""
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(100, 32))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    asking = pivots[:50] + rng.normal(size=(50, 32)) * 0.02
    a = metric.angles(asking / np.linalg.norm(asking, axis=1, keepdims=True), pivots)
    low, high = np.zeros(100), np.full(100, 0.2)
    first = metric.to_ask(a, low, high, np.zeros(50), np.zeros(50, int), 1)
    assert [c[0] for c in first] == list(range(50))
    assert sum(map(len, metric.to_ask(a, low, high, np.full(50, 0.97), np.ones(50, int), 99))) < 25


def test_canonicalize_to_vocab(spark):
    nodes = spark.createDataFrame([(1, "S", "tummy ache", [1.0, 0.1]), (2, "S", "Fever", [0.0, 1.0]), (3, "X", "y", [1.0, 0.0])],
                                  "id int, type string, text string, embedding array<float>")
    vocab = spark.createDataFrame([("S", 0, "abdominal pain", [1.0, 0.0]), ("S", 1, "fever", [0.0, 1.0])], ROW).withColumnRenamed("text", "label")
    canon = er.canonicalize_to_vocab(nodes, vocab)
    assert {r.id: (r.text, r.text_original) for r in canon.collect()} == {
        1: ("abdominal pain", "tummy ache"), 2: ("Fever", None), 3: ("y", None)}
    assert tuple(er.canon_summary(canon).first()) == (3, 1, 1)
    assert [r.text_canonical for r in er.rewrite_report(canon).collect()] == ["abdominal pain"]


def test_encode_text(spark):
    df = spark.createDataFrame([("chest pain",), ("chest pains",), ("rash",), (None,)], "text string")
    vec = {r.text: r.embedding for r in er.encode_text(df).collect()}
    assert cos(vec["chest pain"], vec["chest pains"]) > cos(vec["chest pain"], vec["rash"])
    assert er.encode_text(df).select(F.size("embedding")).first()[0] == 512
