"""Repair of the structure of conversations by Hirschberg's divide and conquer over four-state cost vectors.

A repaired conversation is empty or an optional system turn before pairs of user and assistant turns: its role initials
match ``(s?(ua)+)?``. Four states tell how far that pattern has come: nothing, after the system, after a user, after an
assistant. A line of a conversation leads from each state to others at a cost, so a run of lines is a table of four by
four costs, and runs of any length are put together from the tables of their parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import query, read
from parlance.runtime import stored

# Lines of one block, and tables of blocks put together at once: what a task holds of a conversation.
BLOCK = 1 << 12
SPACE = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
# The state after one more turn of a role, and after an inserted or reroled turn: only one role fits each state.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FIT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# Turns to insert at the very end.
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}


def edits(kind: str, state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, initials) of every way to settle a line of a kind. A kind is ``-`` (must be deleted) or the
    role's initial and ``.`` or ``!`` (truncated).

    Turns are inserted before a line that stays, at most one: two lead back to where they began or past a place that
    the line could take itself; and before a deleted line they cost the same as behind it, which is ASCII-less.
    """
    out = [(state, DELETE, "D")]
    if kind != "-":
        more = TRUNCATED if kind[1] == "!" else 0
        for first, paid, at in (("", 0, state), ("I", INSERT, FIT[state])):
            kept = AFTER.get(kind[0], {}).get(at)
            if kept is not None:
                out.append((kept, paid + KEEP + more, first + "K"))
            out.append((FIT[at], paid + REROLE + more, first + "R"))
    return out


# A table: for each state before, the costs and ranks of the states right behind the last line. Ranks order the
# ASCII-least cheapest initials that lead there; none is the front of another, as all end with the same line.
Vector = tuple[tuple[int, ...], tuple[int, ...]]
Table = tuple[Vector, ...]


def _ranked(best: dict[int, tuple]) -> Vector:
    """``best``: state to (cost, what orders its initials)."""
    order = {key: i for i, key in enumerate(sorted({b[1:] for b in best.values()}))}
    return (tuple(best[q][0] if q in best else NEVER for q in range(4)),
            tuple(order[best[q][1:]] if q in best else -1 for q in range(4)))


def line_table(kind: str) -> Table:
    rows = []
    for p in range(4):
        best: dict[int, tuple] = {}
        for q, cost, initials in edits(kind, p):
            best[q] = min(best.get(q, (NEVER,)), (cost, initials))
        rows.append(_ranked(best))
    return tuple(rows)


def start(state: int) -> Vector:
    return tuple(0 if q == state else NEVER for q in range(4)), tuple(0 if q == state else -1 for q in range(4))


def forward(vector: Vector, table: Table) -> Vector:
    """The costs and ranks behind one more part."""
    best: dict[int, tuple] = {}
    for p, (cost, rank) in enumerate(zip(*vector)):
        if cost < NEVER:
            for q, (more, way) in enumerate(zip(*table[p])):
                if more < NEVER:
                    best[q] = min(best.get(q, (NEVER,)), (cost + more, rank, way))
    return _ranked(best)


def backward(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """The least costs from before a part to the end, by those from behind it."""
    return tuple(min(NEVER, *(a + b for a, b in zip(table[p][0], costs))) for p in range(4))


class Steps:
    """Both steps for tables that repeat: costs that differ by a constant make the same step, so few are distinct."""

    def __init__(self) -> None:
        self.ahead: dict = {}
        self.back: dict = {}

    def forward(self, vector: Vector, table: Table) -> Vector:
        low = min(vector[0])
        key = tuple(c - low if c < NEVER else NEVER for c in vector[0]), vector[1], table
        if key not in self.ahead:
            self.ahead[key] = forward(key[:2], table)
        costs, ranks = self.ahead[key]
        return tuple(c + low if c < NEVER else NEVER for c in costs), ranks

    def backward(self, costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
        low = min(costs)
        key = tuple(c - low if c < NEVER else NEVER for c in costs), table
        if key not in self.back:
            self.back[key] = backward(key[0], table)
        return tuple(c + low if c < NEVER else NEVER for c in self.back[key])


def crossings(tables: list[Table], first: int, last: int, steps: Steps) -> list[int]:
    """The states between the parts of the ASCII-least of the cheapest ways from ``first`` to ``last``.

    Hirschberg: vectors from both ends meet in the middle; of the states where their sum is least the one of the least
    rank is crossed, and both halves go on alike. Only two vectors are held at a time.
    """
    at = [first] + [0] * (len(tables) - 1) + [last]

    def halve(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        mid = (lo + hi) // 2
        ahead = start(at[lo])
        for i in range(lo, mid):
            ahead = steps.forward(ahead, tables[i])
        back = start(at[hi])[0]
        for i in range(hi - 1, mid - 1, -1):
            back = steps.backward(back, tables[i])
        at[mid] = min((a + b, rank, q) for q, (a, rank, b) in enumerate(zip(*ahead, back)) if rank >= 0)[2]
        halve(lo, mid)
        halve(mid, hi)

    if tables:
        halve(0, len(tables))
    return at


def ending(vector: Vector) -> int:
    """The state behind the last line, of a whole conversation."""
    return min((cost + INSERT * CLOSING[q], rank, q) for q, (cost, rank) in enumerate(zip(*vector)) if rank >= 0)[2]


def joined(tables: list[Table], steps: Steps) -> Table:
    out = []
    for p in range(4):
        vector = start(p)
        for table in tables:
            vector = steps.forward(vector, table)
        out.append(vector)
    return tuple(out)


def _flat(table: Table) -> list[int]:
    return [x for vector in table for part in vector for x in part]


def _table(flat: list[int]) -> Table:
    return tuple((tuple(flat[i:i + 4]), tuple(flat[i + 4:i + 8])) for i in range(0, 32, 8))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of equal keys, which come sorted; a run is never larger than a block."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            mine = tuple(row[k] for k in keys)
            if mine != key and rows:
                yield key, rows
                rows = []
            key = mine
            rows.append(row)
    if rows:
        yield key, rows


def _out(schema: T.StructType) -> Callable[[list[tuple]], pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return batch


def _by_runs(df: DataFrame, keys: list[str], order: str, schema: T.StructType,
             work: Callable[[Steps], Callable[[tuple, list[dict]], list[tuple]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, each, rows = _out(schema), work(Steps()), []
        for key, run_rows in _runs(batches, keys):
            rows += each(key, run_rows)
            if len(rows) >= BLOCK:
                yield pack(rows)
                rows = []
        yield pack(rows)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def lines(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
          copies: Column | None = None) -> DataFrame:
    """The lines of all conversations, numbered: ``conv, turn, role, text, copies, fault, seq``; a null role or text is
    one space.

    Lines of a conversation come by ``order`` (nulls first), then by ``role:text``; equal ones are one line with a
    number of ``copies`` (of each row: ``copies``, 1 by default; 0 keeps the conversation without the row). ``fault``
    is ``blank``, ``duplicate`` (role and text came at an earlier turn; further copies always are), ``truncated`` or
    null. ``seq`` rises in that order over all conversations, and is no row count: it may leave gaps.
    """
    one = F.lit(1).cast("bigint") if copies is None else copies.cast("bigint")
    found = rows.select(
        F.col(f"`{key}`").alias("conv"), F.col(f"`{order}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        one.alias("copies")).groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # A struct of a null is no null, and less than any other.
    at = F.struct("turn")
    first = found.filter("copies > 0").groupBy("conv", "role", "text").agg(F.min(at).alias("first")).select(
        F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t"), "first")
    met = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t"))
    # A text pattern's dot would stop at line ends; the last visible character is what stays when blanks at the end go.
    seen = F.regexp_extract("text", rf"({SPACE})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("copies") == 0, None).when(~F.col("text").rlike(SPACE), "blank").when(
        ~F.col("first").eqNullSafe(at), "duplicate").when(~seen.isin(".", "!", "?"), "truncated")
    line = F.concat("role", F.lit(":"), "text")
    judged = found.join(first, met, "left").select("conv", "turn", "role", "text", "copies", fault.alias("fault"))
    # Bounds are drawn from the fronts of lines only, so that no long text is sent to the driver.
    ranged = judged.repartitionByRange(F.col("conv"), F.col("turn"), F.left(line, F.lit(64))).sortWithinPartitions("conv", "turn", line)
    return ranged.withColumn("seq", F.monotonically_increasing_id())


_TABLE = "conv {conv}, block bigint, flat array<bigint>"
_WAY = "conv {conv}, block bigint, first int, last int, closing int"


def _kind(row: dict) -> str | None:
    if not row["copies"]:
        return None
    if row["fault"] in ("blank", "duplicate"):
        return "-"
    return (row["initial"] or "?") + ("!" if row["fault"] == "truncated" else ".")


def repair(numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """``numbered`` (of ``lines``, stored) with the cheapest repair, of equal ones that of the ASCII-least initials.

    Adds ``before`` (initials of turns inserted before the line: empty or ``I``), ``edit`` (K, R or D; null for no
    copies) of its first copy - all further copies are deleted -, ``state`` before the line, ``new_role`` (null:
    deleted), and ``closing``, the turns inserted behind a conversation's last line.

    Blocks of ``block`` numbers become tables of four by four costs, and up to ``block`` tables one, until each
    conversation is one: a conversation of any length is spread over tasks of bounded size. Then the states between
    the parts are crossed from the top down, and between the lines of each block. Every level is written once, so a
    lost task costs itself only. A line's table has no more than nine forms. An empty table gives an empty one.
    """
    conv = numbered.schema["conv"].dataType
    shape = lambda text: T.StructType.fromDDL(text.format(conv=conv.simpleString()))
    light = numbered.select("conv", "seq", "copies", "fault", F.left("role", F.lit(1)).alias("initial"))
    blocks = light.withColumn("block", F.expr(f"seq div {block}"))

    def of_lines(steps: Steps):
        known: dict[str, Table] = {}

        def each(key: tuple, rows: list[dict]) -> list[tuple]:
            kinds = [k for k in map(_kind, rows) if k]
            for k in set(kinds) - known.keys():
                known[k] = line_table(k)
            # No lines: no step at all.
            return [(*key, _flat(joined([known[k] for k in kinds], steps)))]

        return each

    def of_tables(steps: Steps):
        def each(key: tuple, rows: list[dict]) -> list[tuple]:
            return [(key[0], key[1], _flat(joined([_table(r["flat"]) for r in rows], steps)))]

        return each

    levels = [stored(_by_runs(blocks, ["conv", "block"], "seq", shape(_TABLE), of_lines))]
    while True:
        below = levels[-1]
        if below.groupBy("conv").count().filter("count > 1").isEmpty():
            break
        parts = below.select("conv", F.expr(f"block div {block}").alias("block"), F.col("block").alias("part"), "flat")
        levels.append(stored(_by_runs(parts, ["conv", "block"], "part", shape(_TABLE), of_tables)))

    way = shape(_WAY)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _out(way)
        for batch in batches:
            last = [ending(_table(flat)[NOTHING]) for flat in batch.column("flat").to_pylist()]
            yield pack([(c, b, NOTHING, q, CLOSING[q]) for c, b, q in zip(
                batch.column("conv").to_pylist(), batch.column("block").to_pylist(), last)])

    def within(steps: Steps):
        def each(key: tuple, rows: list[dict]) -> list[tuple]:
            r = rows[0]
            at = crossings([_table(x["flat"]) for x in rows], r["first"], r["last"], steps)
            end = [0] * (len(rows) - 1) + [r["closing"]]
            return [(key[0], x["part"], p, q, c) for x, p, q, c in zip(rows, at, at[1:], end)]

        return each

    ways = levels[-1].mapInArrow(whole, way)
    for below in reversed(levels[:-1]):
        parts = below.select("conv", F.expr(f"block div {block}").alias("block"), F.col("block").alias("part"), "flat")
        ways = stored(_by_runs(_with_ways(parts, ways), ["conv", "block"], "part", way, within))

    def settle(steps: Steps):
        known: dict[str, Table] = {}

        def each(key: tuple, rows: list[dict]) -> list[tuple]:
            kinds = [_kind(r) for r in rows]
            for k in {k for k in kinds if k} - known.keys():
                known[k] = line_table(k)
            some = [i for i, k in enumerate(kinds) if k]
            at = crossings([known[kinds[i]] for i in some], rows[0]["first"], rows[0]["last"], steps)
            found = {}
            for i, p, q in zip(some, at, at[1:]):
                found[i] = p, min((cost, initials) for to, cost, initials in edits(kinds[i], p) if to == q)[1]
            out = []
            for i, r in enumerate(rows):
                p, initials = found.get(i, (None, None))
                closing = r["closing"] if i == len(rows) - 1 else 0
                out.append((r["seq"], *((None,) * 3 if initials is None else (initials[:-1], initials[-1], p)), closing))
            return out

        return each

    settled = _by_runs(_with_ways(blocks, ways), ["conv", "block"], "seq", shape(
        "seq bigint, before string, edit string, state int, closing int"), settle)
    # The role that fits: of the state before the line, or behind the inserted turn.
    fit = lambda at: F.when(at == USER, ROLE[ASSISTANT]).otherwise(ROLE[USER])
    placed = F.when(F.col("before") == "I", F.when(F.col("state") == USER, ASSISTANT).otherwise(USER)).otherwise(F.col("state"))
    new = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", fit(placed))
    return numbered.join(settled, "seq").withColumn("new_role", new)


def _with_ways(parts: DataFrame, ways: DataFrame) -> DataFrame:
    w = ways.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "first", "last", "closing")
    return parts.join(w, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")


_REPORT = ("conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")


def report(repaired: DataFrame) -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gaps``: numbers missing between the least and the largest turn. Lines stream through in order, and nothing of a
    conversation is held but its initials and the state of its hash: a hash over a whole conversation is sequential
    by its definition, so this step, unlike ``repair``, passes each conversation through one task.
    """
    shape = T.StructType.fromDDL(_REPORT.format(conv=repaired.schema["conv"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, rows, now, conv = _out(shape), [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv"] != conv:
                    if now is not None:
                        rows.append((conv, *now.row()))
                    now, conv = _Running(), r["conv"]
                    if len(rows) >= BLOCK:
                        yield pack(rows)
                        rows = []
                now.add(r)
        if now is not None:
            rows.append((conv, *now.row()))
        yield pack(rows)

    return repaired.select("conv", "seq", "turn", "role", "text", "copies", "fault", "before", "edit", "state", "closing",
                           "new_role").repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(run, shape)


class _Running:
    """The figures of one conversation, line by line."""

    def __init__(self) -> None:
        self.least = self.largest = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.hash, self.some = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.some = True

    def insert(self, state: int) -> int:
        self.audit.append("I")
        self.cost += INSERT
        self.put(ROLE[FIT[state]], "")
        return FIT[state]

    def add(self, r: dict) -> None:
        n, fault = r["copies"], r["fault"]
        if n:
            if r["turn"] is not None:
                self.turns += r["turn"] != self.largest
                self.least = r["turn"] if self.least is None else self.least
                self.largest = r["turn"]
            initial = r["role"][:1]
            self.illegal += (self.last is not None and self.last + initial not in LEGAL) + n - 1
            self.last = initial
            every = fault in ("blank", "duplicate")
            if fault:
                self.faults[fault] += n if every else 1
            self.faults["duplicate"] += 0 if every else n - 1
            if r["before"]:
                self.insert(r["state"])
            self.audit.append(r["edit"] + "D" * (n - 1))
            self.cost += DELETE * (n - 1) + {"K": KEEP, "R": REROLE, "D": DELETE}[r["edit"]]
            if r["edit"] != "D":
                self.cost += TRUNCATED * (fault == "truncated")
                self.put(r["new_role"], r["text"])
        state = {1: USER, 2: SYSTEM}.get(r["closing"])
        for _ in range(r["closing"]):
            state = self.insert(state)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.largest - self.least + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Every twentieth row or so dropped, emptied, stripped of its ends of sentences, repeated, or made the user's, by
    the crc32 of ``conv_id:turn``. Dropped rows stay with no copies, so that their conversation is not lost."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies")), F.col("copies")


@query("op11_hirschberg_repair")
def _op11(spark, sf_dir):
    rows, copies = damaged(read(spark, sf_dir, "conversations"))
    return report(repair(stored(lines(rows, copies=copies)))).withColumnRenamed("conv", "conv_id")
