"""Chat formatting: tool calls joined to their results, ordered by what they depend on, validated and serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read
from parlance.runtime import drop_stored, stored

# Calls of one conversation that a task orders by itself; larger conversations are ordered in rounds by all.
CONVERSATION_CALLS = 50_000
# Rows that a task holds as Python objects at once.
ROWS = 256
# Bytes of all schemas together; they travel with the tasks.
SCHEMA_BYTES = 8 << 20


# --- JSON --------------------------------------------------------------------------------

def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a repeated name")
    return out


def parse(text: str):
    """Strict JSON: no NaN, no infinity, no repeated names in an object."""
    value = json.loads(text, parse_constant=_refuse, object_pairs_hook=_unique)
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        raise ValueError("a number out of range")
    return value


def _number(x: float) -> str:
    """The shortest digits that read back as ``x``, plain from 1e-6 up to 1e21 and with an exponent beyond."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("a number out of range")
    if x == 0:
        return "0"
    sign, digits = "-" * (x < 0), repr(abs(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    point = len(whole) + int(exponent or 0)
    raw = whole + part
    point -= len(raw) - len(raw.lstrip("0"))
    raw = raw.strip("0")
    if -6 < point <= 21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{raw}"
        if point >= len(raw):
            return sign + raw.ljust(point, "0")
        return f"{sign}{raw[:point]}.{raw[point:]}"
    e = point - 1
    return f"{sign}{raw[0]}{'.' if raw[1:] else ''}{raw[1:]}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value) -> str:
    """One text for equal values: names in the order of their UTF-16 units, no white space, shortest numbers.

    Integers keep all their digits.
    """
    if isinstance(value, dict):
        names = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in names) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    # A lone surrogate has no UTF-8 form and stays escaped.
    text = json.dumps(value, ensure_ascii=False)
    return text if text.isascii() or not any("\ud800" <= c <= "\udfff" for c in text) else json.dumps(value)


_TYPES = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v),
}


def violations(value, schema, path: str = "$") -> list[str]:
    """What in ``value`` breaks a schema of type, enum, bounds, required, properties, additionalProperties, items."""
    if schema is True or schema is False:
        return [] if schema else [f"{path}: not allowed"]
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{path}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        out.append(f"{path}: not in the enumeration")
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{path}: below the minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{path}: above the maximum")
    if isinstance(value, (str, list)):
        n, least, most = len(value), *(("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems"))
        if n < schema.get(least, 0) or n > schema.get(most, n):
            out.append(f"{path}: of a wrong length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            out += violations(value[k], known.get(k, schema.get("additionalProperties", True)), f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{path}[{i}]")
    return out


# --- order -------------------------------------------------------------------------------

def _levels(edges: list[tuple[int, list[int]]]) -> dict[int, int | None]:
    """Length of the longest chain of dependencies below each call; none for calls on, or after, a cycle."""
    waits = {c: len(set(d)) for c, d in edges}
    after: dict[int, list[int]] = {}
    for c, d in edges:
        for x in set(d):
            after.setdefault(x, []).append(c)
    level: dict[int, int | None] = {c: 0 for c, _ in edges}
    ready = [c for c, n in waits.items() if not n]
    while ready:
        c = ready.pop()
        for x in after.get(c, ()):
            level[x] = max(level[x], level[c] + 1)
            waits[x] -= 1
            if not waits[x]:
                ready.append(x)
    return {c: None if waits[c] else n for c, n in level.items()}


def _order_by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of whole conversations, which stand together: ``conv, call, deps`` to ``conv, call, level``."""
    def done(conv, rows: list[tuple]) -> pa.RecordBatch:
        numbers = {c: i for i, (c, _) in enumerate(rows)}
        level = _levels([(numbers[c], [numbers[d] for d in deps]) for c, deps in rows])
        return pa.record_batch([pa.array([conv] * len(rows), pa.string()), pa.array([c for c, _ in rows], pa.string()),
                                pa.array([level[i] for i in range(len(rows))], pa.int32())], ["conv", "call", "level"])

    now, rows = None, []
    for batch in batches:
        for conv, call, deps in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if rows and conv != now:
                yield done(now, rows)
                rows = []
            now = conv
            rows.append((call, deps))
    if rows:
        yield done(now, rows)


def _order_by_rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The same levels for conversations of any size: each round takes the calls that wait for none left."""
    left, waiting, out, level = stored(calls), stored(edges), None, 0
    while True:
        ready = stored(left.join(waiting, ["conv", "call"], "left_anti"))
        if ready.isEmpty():
            break
        found = ready.withColumn("level", F.lit(level))
        out = found if out is None else out.unionByName(found)
        gone = ready.select("conv", F.col("call").alias("dep"))
        new_left, new_waiting = stored(left.join(ready, ["conv", "call"], "left_anti")), stored(waiting.join(gone, ["conv", "dep"], "left_anti"))
        drop_stored(left, waiting)
        left, waiting, level = new_left, new_waiting, level + 1
    cyclic = left.withColumn("level", F.lit(None).cast("int"))
    return cyclic if out is None else out.unionByName(cyclic)


def dependency_levels(calls: DataFrame, edges: DataFrame, limit: int = CONVERSATION_CALLS) -> DataFrame:
    """``(conv, call, level)`` for the distinct ``calls(conv, call)``; ``edges(conv, call, dep)`` among them."""
    edges = stored(edges.distinct())
    sizes = stored(edges.groupBy("conv").count())
    large = sizes.filter(F.col("count") > limit).select("conv")
    linked = edges.select("conv", "call").union(edges.select("conv", F.col("dep").alias("call"))).distinct()
    deps = edges.groupBy("conv", "call").agg(F.collect_list("dep").alias("deps"))
    small = linked.join(large, "conv", "left_anti").join(deps, ["conv", "call"], "left").select(
        "conv", "call", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    levels = small.repartition("conv").sortWithinPartitions("conv", "call").mapInArrow(
        _order_by_task, "conv string, call string, level int")
    if not large.isEmpty():
        levels = levels.unionByName(_order_by_rounds(linked.join(large, "conv", "left_semi"), edges.join(large, "conv", "left_semi")))
    free = calls.join(linked, ["conv", "call"], "left_anti").withColumn("level", F.lit(0))
    return free.unionByName(levels)


# --- linking -----------------------------------------------------------------------------

def _checked(schemas: dict[str, dict]):
    """Validation and serialisation of joined rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few rows at a time are Python objects.
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            errors, records = [], []
            for r in batch.to_pylist():
                wrong, value = [], None
                try:
                    value = parse(r["arguments"] or "")
                    if r["name"] in schemas:
                        wrong = violations(value, schemas[r["name"]])
                    arguments = canonical(value)
                except (ValueError, OverflowError, RecursionError) as e:
                    wrong, arguments = [f"$: {type(e).__name__}"], canonical(r["arguments"])
                if r["name"] not in schemas:
                    wrong.append("unknown tool")
                if r["call_id"] is None:
                    wrong.append("no id")
                elif not r["first"]:
                    wrong.append("repeated id")
                if r["level"] is None:
                    wrong.append("cycle")
                if r["missing"]:
                    wrong.append("unknown dependency")
                if not r["n_results"]:
                    wrong.append("no result")
                elif r["n_results"] > 1:
                    wrong.append("several results")
                rest = canonical({"id": r["call_id"], "name": r["name"], "result": r["content"]})
                errors.append(wrong)
                records.append('{"arguments":' + arguments + "," + rest[1:])
            yield pa.record_batch(
                [*(batch.column(n) for n in _KEPT), pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())],
                [*_KEPT, "errors", "record"])

    return run


_KEPT = ["conv", "turn", "number", "call_id", "name", "level", "result_turn", "n_results"]
_OUT = ("conv string, turn bigint, number int, call_id string, name string, level int, result_turn bigint, n_results bigint, "
        "errors array<string>, record string")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], limit: int = CONVERSATION_CALLS) -> tuple[DataFrame, DataFrame]:
    """Linked calls, and the results that no call asked for.

    ``calls(conv string, turn bigint, number int, call_id, name, arguments, after array<string>)``, ``results(conv, turn,
    call_id, content)``. One row per call: ``level`` (its place in the order: calls of one conversation are
    ordered by level, turn and number, which puts every call behind all that it depends on; null on or behind a
    cycle), ``result_turn``, ``n_results``, ``errors`` (empty: valid) and ``record``, a canonical JSON of id, name,
    arguments and result; arguments that are no JSON stay a string there. Of several results the first counts; of
    calls that repeat an id only the first gets results; identical rows are one call and come back as often. Nulls: a null id never links, a null conversation is one
    of its own, a dependency on an unknown id is reported and does not order. The joins run on keys that are unique
    on one side at least, so that a hot id can be split.
    """
    total = len(json.dumps(schemas))
    if total > SCHEMA_BYTES:
        raise ValueError(f"{total} bytes of schemas; at most {SCHEMA_BYTES}")
    conv = F.coalesce(F.col("conv"), F.lit("\0none"))
    calls = stored(calls.select("conv", "turn", "number", "call_id", "name", "arguments", "after",
                                F.coalesce(F.col("call_id"), F.lit("\0none")).alias("key"), conv.alias("group")))
    results = results.select("conv", "turn", "call_id", "content", conv.alias("group"))
    place = F.struct("turn", "number", "name", "arguments")
    firsts = stored(calls.filter("call_id is not null").groupBy("group", "key").agg(F.min(place).alias("place")))
    answers = stored(results.filter("call_id is not null").groupBy("group", F.col("call_id").alias("key")).agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n")))
    known = firsts.select(F.col("group").alias("conv"), F.col("key").alias("call"))
    wanted = calls.filter("call_id is not null").select(
        F.col("group").alias("conv"), F.col("key").alias("call"), F.explode(F.array_distinct("after")).alias("dep")).filter("dep is not null").distinct()
    met = stored(wanted.join(known.withColumnRenamed("call", "dep").withColumn("met", F.lit(True)), ["conv", "dep"], "left"))
    levels = stored(dependency_levels(known, met.filter("met").select("conv", "call", "dep"), limit))
    missing = met.filter("met is null").select(F.col("conv").alias("group"), F.col("call").alias("key")).distinct().withColumn("missing", F.lit(True))
    facts = stored(firsts.join(answers, ["group", "key"], "left")
                   .join(levels.select(F.col("conv").alias("group"), F.col("call").alias("key"), "level"), ["group", "key"], "left")
                   .join(missing, ["group", "key"], "left"))
    joined = calls.join(facts, ["group", "key"], "left")
    first = place.eqNullSafe(F.col("place")) & F.col("call_id").isNotNull()
    out = joined.withColumn("first", F.coalesce(first, F.lit(False))).select(
        "conv", "turn", "number", "call_id", "name", "arguments", "first",
        F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"),
        F.when(F.col("first"), F.col("answer.turn")).alias("result_turn"),
        F.when(F.col("first"), F.col("answer.content")).alias("content"),
        F.when(F.col("first"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_results"),
        F.coalesce("missing", F.lit(False)).alias("missing")).mapInArrow(_checked(schemas), _OUT)
    orphans = results.withColumn("key", F.col("call_id")).join(firsts.select("group", "key"), ["group", "key"], "left_anti")
    return out, orphans.drop("group", "key")


# --- the table of conversations ----------------------------------------------------------

SCHEMAS = {
    "search": {"type": "object", "required": ["text", "limit"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}},
    "translate": {"type": "object", "required": ["text"], "properties": {
        "text": {"type": "string"}, "limit": {"type": "integer", "maximum": 200}}},
    "rank": {"type": "object", "required": ["items"], "properties": {
        "items": {"type": "array", "items": {"type": "string"}, "maxItems": 40}, "limit": {"type": ["integer", "null"]}}},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of ``conversations(conv_id, turn, role, text)`` stand for.

    Every assistant's turn is a call with the whole text in its arguments, some of them faulty; every user's turn is
    the result of the turn before it. A call may depend on the call two turns before or, rarely, after it.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    name_of = lambda turn: F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("/", "conv_id", turn)), 1, 12))
    words = F.split(F.coalesce(F.col("text"), F.lit("")), " ")
    plain = F.to_json(F.struct(F.col("text"), F.size(words).alias("limit")))
    arguments = (F.when(crc % 10 == 0, F.to_json(F.struct("text", F.size(words).cast("string").alias("limit"))))
                 .when(crc % 10 == 1, F.to_json(F.struct(words.alias("items"))))
                 .when(crc % 10 == 2, F.expr("substr(c, 1, length(c) - 1)")).otherwise(plain))
    calls = conversations.filter("role = 'assistant'").withColumn("c", plain).select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.lit(0).alias("number"),
        name_of(F.col("turn")).alias("call_id"),
        F.element_at(F.array(*[F.lit(n) for n in ("search", "translate", "rank", "none")]), (crc % 4 + 1).cast("int")).alias("name"),
        arguments.alias("arguments"),
        F.array_compact(F.array(F.when(crc % 3 != 0, name_of(F.col("turn") - 2)), F.when(crc % 11 == 0, name_of(F.col("turn") + 2)))).alias("after"))
    results = conversations.filter("role = 'user'").select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query("op1_tool_call_linking")
def _op1(spark, sf_dir):
    calls, results = calls_of(read(spark, sf_dir, "conversations"))
    linked, orphans = link(calls, results, SCHEMAS)
    return linked.select("*", F.lit("call").alias("kind")).unionByName(
        orphans.select("conv", "turn", "call_id", F.col("content").alias("record"), F.lit("result").alias("kind")), allowMissingColumns=True)
