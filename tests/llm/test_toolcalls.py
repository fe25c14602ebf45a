import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import toolcalls as T
from parlance.llm.catalog import queries

CALLS = "conv string, turn bigint, number int, call_id string, name string, arguments string, after array<string>, level string, key int"
RESULTS = "conv string, turn bigint, call_id string, content string, group string"


def slow_levels(edges, nodes):
    memo = {}

    def level(n, path):
        if n in path:
            return None
        if n not in memo:
            below = [level(d, path | {n}) for d in edges.get(n, ())]
            memo[n] = None if None in below else max((b + 1 for b in below), default=0)
        return memo[n]

    return {n: level(n, frozenset()) for n in nodes}


def brute(calls, results, schemas):
    low = lambda x: (x is not None, x if x is not None else 0)
    place = lambda c: (low(c[1]), low(c[2]), c[4] or "", c[5] or "")
    first, answers = {}, defaultdict(list)
    for c in calls:
        if c[3] is not None:
            k = (c[0], c[3])
            first[k] = min(first.get(k, c), c, key=place)
    for r in results:
        if r[2] is not None:
            answers[r[0], r[2]].append((low(r[1]), r[3] or "", r))
    edges = defaultdict(set)
    for c in calls:
        for d in c[6] or []:
            if c[3] is not None and (c[0], d) in first:
                edges[c[0], c[3]].add((c[0], d))
    levels = slow_levels(edges, list(first))
    lost = {(c[0], c[3]) for c in calls for d in c[6] or [] if d is not None and c[3] is not None and (c[0], d) not in first}
    out = []
    for c in calls:
        k = (c[0], c[3])
        is_first = c[3] is not None and place(first[k]) == place(c)
        got = sorted(answers.get(k, []), key=lambda x: x[:2]) if is_first else []
        bad = []
        if c[3] is None:
            bad.append("no id")
        elif not is_first:
            bad.append("repeated id")
        level = 0 if c[3] is None else levels[k]
        bad += ["cycle"] * (level is None) + ["unknown dependency"] * (k in lost)
        bad += ["no result"] if not got else ["several results"] * (len(got) > 1)
        out.append((c[0], c[1], c[3], level, got[0][2][1] if got else None, len(got), tuple(bad)))
    orphans = [r for r in results if r[2] is None or (r[0], r[2]) not in first]
    return out, orphans


def random_case(seed, n=150):
    rng = random.Random(seed)
    ids = [f"c{i}" for i in range(40)] + [None]
    calls = [(rng.choice(["a", "a", "b", None]), rng.randint(0, 30), rng.randint(0, 1), rng.choice(ids), "f", '{"x": 1}',
              [rng.choice(ids[:45]) or "gone" for _ in range(rng.choice([0, 0, 0, 1, 2]))], "x", 1) for _ in range(n)]
    results = [(rng.choice(["a", "b", None]), rng.randint(0, 30), rng.choice(ids), f"r{i}", "g") for i in range(n // 2)]
    return calls + calls[:2], results + results[:1]


@pytest.mark.parametrize("seed,limit", [(1, 50_000), (2, 50_000), (2, 3)])
def test_links_and_levels_are_brute_force(spark, seed, limit):
    calls, results = random_case(seed)
    linked, orphans = T.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"f": {"type": "object"}}, limit)
    want, lost = brute(calls, results, {})
    got = Counter((r["conv"], r["turn"], r["call_id"], r["level"], r["result_turn"], r["n_results"], tuple(r["errors"])) for r in linked.collect())
    assert got == Counter(want)
    assert Counter((r["conv"], r["turn"], r["call_id"], r["content"]) for r in orphans.collect()) == Counter(r[:4] for r in lost)


def test_a_long_chain_and_a_cycle_at_any_size(spark):
    calls = [("a", 100 - i, 0, f"c{i}", "f", "1", [f"c{i - 1}"] if i else []) for i in range(8)]
    calls += [("a", 0, 0, "x", "f", "1", ["y"]), ("a", 0, 0, "y", "f", "1", ["x"]), ("a", 0, 0, "z", "f", "1", ["y", "c0"])]
    none = spark.createDataFrame([], "conv string, turn bigint, call_id string, content string")
    for limit in (50_000, 1):
        df = spark.createDataFrame(calls, "conv string, turn bigint, number int, call_id string, name string, arguments string, after array<string>")
        got = {r["call_id"]: r["level"] for r in T.link(df, none, {}, limit)[0].collect()}
        assert got == {**{f"c{i}": i for i in range(8)}, "x": None, "y": None, "z": None}
    assert T.link(df.limit(0), none, {})[0].count() == 0


def test_canonical_json():
    assert T.canonical(T.parse('{"b": [1, 2.50, 1e2, -0.0, 1E-7, 1e21, 123456789.125, 1e20], "\\u00e9": null, "a": "\\u2028\\"\\n", "\\ud83d\\ude00": 1, "\\ufb33": 2}')) == (
        '{"a":"\u2028\\"\\n","b":[1,2.5,100,0,1e-7,1e+21,123456789.125,100000000000000000000],"é":null,"\U0001F600":1,"\ufb33":2}')
    assert T.canonical(12345678901234567890123) == "12345678901234567890123" and T._number(0.000001) == "0.000001" and T._number(-1.5e300) == "-1.5e+300"
    for bad in ('{"a": 1, "a": 2}', "NaN", "{", "", "1e999", "[1] 2"):
        with pytest.raises(ValueError):
            T.canonical(T.parse(bad))
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30)
        assert float(T._number(x)) == x


def test_schemas():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": ["array", "null"], "items": {"enum": ["x", 1]}, "maxItems": 2}, "c": {"type": "string", "maxLength": 2}}}
    assert T.violations({"a": 1.0, "b": ["x", 1.0], "c": "é𝔘"}, s) == []
    assert T.violations({"b": ["y"], "z": 1}, s) == ["$.a: missing", "$.b[0]: not in the enumeration", "$.z: not allowed"]
    assert T.violations({"a": True}, s) == ["$.a: not of type integer"] and T.violations([], s) == ["$: not of type object"]
    assert T.violations({"a": 0, "c": "abc", "b": [1, 1, 1]}, s) == ["$.a: below the minimum", "$.b: of a wrong length", "$.c: of a wrong length"]


def test_deep_and_long_arguments(spark):
    args = ["[" * 200000, '{"text": "' + "w " * 200000 + '"}', None, "[" * 50 + "]" * 50]
    df = spark.createDataFrame([("a", i, 0, f"c{i}", "f", a, None) for i, a in enumerate(args)], CALLS.split(", level")[0])
    none = spark.createDataFrame([], "conv string, turn bigint, call_id string, content string")
    got = {r["turn"]: r for r in T.link(df, none, {"f": True})[0].collect()}
    assert [len(got[i]["errors"]) for i in range(4)] == [2, 1, 2, 1]
    assert json.loads(got[1]["record"])["arguments"]["text"] == "w " * 200000


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op1_tool_call_linking"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    calls, results = (x.collect() for x in T.calls_of(table))
    want, lost = brute([tuple(c) for c in calls], [tuple(r) for r in results], T.SCHEMAS)
    linked = [r for r in got if r["kind"] == "call"]
    own = {"no id", "repeated id", "cycle", "unknown dependency", "no result", "several results"}
    assert Counter((r["conv"], r["turn"], r["call_id"], r["level"], r["result_turn"], r["n_results"], tuple(e for e in r["errors"] if e in own)) for r in linked) == Counter(want)
    assert len(got) == len(calls) + len(lost)
    by_id = {c["call_id"]: c for c in calls}
    for r in linked:
        record = json.loads(r["record"])
        c = by_id[r["call_id"]]
        try:
            value = json.loads(c["arguments"])
            assert record["arguments"] == value and ([e for e in r["errors"] if e.startswith("$")] == T.violations(value, T.SCHEMAS.get(c["name"], True)))
        except json.JSONDecodeError:
            assert record["arguments"] == c["arguments"] and "$: JSONDecodeError" in r["errors"]
    assert len({e for r in linked for e in r["errors"]}) > 5
