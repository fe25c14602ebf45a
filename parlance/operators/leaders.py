"""Greedy leader clusters in rounds that do not follow the longest chain.

A text leads unless a smaller neighbour leads. That makes every undecided text a conjunction: it leads if none of its
smaller neighbours does. A task works through a range of texts in order, with what the range itself decides: a text
whose conditions all hold leads, one with a broken condition does not, and one that is left with a single condition
*is* that condition, or an alias: it leads if some text before the range leads, or if it does not. Aliases of aliases
are followed by pointer doubling, so a chain of any length over any number of ranges ends in a logarithm of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.runtime import stored

# Texts that a task holds of a range before it starts the next one.
RANGE_TEXTS = 1 << 16
# A text of more open conditions than this waits until joins have settled enough of them.
MOST_CONDITIONS = 1 << 12
_CONDITION = ["type", "node", "root", "want"]


class Settler:
    """The texts of a range, in order.

    ``known``: a node to True or False (it leads or not), or to (root, w): it leads exactly if it is ``w`` that ``root``
    leads. A node that is missing is its own root.
    """

    def __init__(self, texts: int = RANGE_TEXTS) -> None:
        self.known: dict[int, bool | tuple[int, bool]] = {}
        self.texts = texts

    def settle(self, node: int, conditions: list[tuple[int, bool]]) -> bool | tuple[int, bool] | list[tuple[int, bool]]:
        """``conditions``: (other, want): whether ``other`` leads must be ``want``. The verdict, the alias, or what is
        left of the conditions."""
        left: dict[int, bool] = {}
        found: bool | tuple[int, bool] | None = None
        for other, want in conditions:
            value = self.known.get(other, (other, True))
            if isinstance(value, bool):
                if value != want:
                    found = False
                    break
                continue
            root, same = value
            # A root and its opposite cannot both hold.
            if left.setdefault(root, want == same) != (want == same):
                found = False
                break
        if found is None and len(left) > 1:
            return list(left.items())
        if found is None:
            found = next(iter(left.items()), True)
        if len(self.known) >= self.texts:
            self.known.clear()
        self.known[node] = found
        return found


def _settled(conditions: DataFrame, range_texts: int) -> DataFrame:
    """One pass over sorted ranges: ``leads`` is a verdict, ``alias`` marks an alias, other rows are open conditions."""
    kind = conditions.schema["type"].dataType.simpleString()
    shape = T.StructType.fromDDL(f"type {kind}, node bigint, root bigint, want boolean, leads boolean, alias boolean")
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settler, out, now, mine = Settler(range_texts), [], None, []

        def close() -> None:
            found = settler.settle(now[1], mine)
            if isinstance(found, bool):
                out.append((*now, None, None, found, False))
            elif isinstance(found, tuple):
                out.append((*now, *found, None, True))
            else:
                out.extend((*now, root, want, None, False) for root, want in found)

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(arrow)
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for kind_, node, root, want in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != (kind_, node):
                    if now is not None:
                        close()
                        if now[0] != kind_:
                            settler = Settler(range_texts)
                    now, mine = (kind_, node), []
                mine.append((root, want))
            if len(out) >= 1 << 14:
                yield taken()
        if now is not None:
            close()
        yield taken()

    return conditions.select(*_CONDITION).repartitionByRange("type", "node").sortWithinPartitions(
        "type", "node").mapInArrow(run, shape)


def _followed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Conditions one step on: a root that is an alias gives way to its own root; one that is decided leaves ``holds``,
    whether the condition is kept."""
    s = state.select(*[F.col(c).alias(f"_{c}") for c in (*_CONDITION, "leads")])
    return rows.join(s, (F.col("type") == F.col("_type")) & (F.col("root") == F.col("_node")), "left").select(
        "type", "node", F.coalesce("_root", "root").alias("root"),
        F.when(F.col("_root").isNotNull(), F.col("_want") == F.col("want")).otherwise(F.col("want")).alias("want"),
        (F.col("_leads") == F.col("want")).alias("holds"))


def leaders(pairs: DataFrame, range_texts: int = RANGE_TEXTS, most: int = MOST_CONDITIONS, log: list[int] | None = None) -> DataFrame:
    """Which texts of ``pairs`` (type, lo, hi) lead in the greedy pass in order: (type, node, leads).

    Each round writes one table: conditions and aliases are followed one step, texts with a broken condition or without
    an open one are decided, all others are settled by ranges. A round decides the smallest open text at least, and a
    whole range where it does not depend on texts before it that have several open conditions. ``log`` gets the number
    of open rows of each round.
    """
    pairs = pairs.filter((F.col("lo") < F.col("hi")) & F.col("type").isNotNull())
    lower, upper = (pairs.select("type", F.col(c).alias("node")).distinct() for c in ("lo", "hi"))
    none = lambda kind: F.lit(None).cast(kind)
    # A text that is nobody's larger neighbour leads.
    decided = stored(lower.join(upper, ["type", "node"], "left_anti").withColumn("leads", F.lit(True)))
    open_ = pairs.select("type", F.col("hi").alias("node"), F.col("lo").alias("root"), F.lit(False).alias("want"))
    aliases = open_.limit(0)
    while True:
        state = aliases.withColumn("leads", none("boolean")).unionByName(
            decided.select("type", "node", none("bigint").alias("root"), none("boolean").alias("want"), "leads"))
        moved = _followed(open_, state).distinct()
        facts = moved.groupBy("type", "node").agg(
            F.coalesce(F.bool_or(~F.col("holds")), F.lit(False)).alias("_broken"), F.count_if(F.col("holds").isNull()).alias("_open"))
        verdict = F.when(F.col("_broken"), False).when(F.col("_open") == 0, True)
        done = facts.withColumn("leads", verdict).filter("leads is not null").select(
            "type", "node", none("bigint").alias("root"), none("boolean").alias("want"), "leads", F.lit(False).alias("alias"))
        still = moved.filter("holds is null").join(facts.filter(verdict.isNull()), ["type", "node"])
        waiting = still.filter(F.col("_open") > most).select(*_CONDITION, none("boolean").alias("leads"), F.lit(False).alias("alias"))
        new = stored(done.unionByName(waiting).unionByName(_settled(still.filter(F.col("_open") <= most), range_texts)))
        decided = decided.unionByName(new.filter("leads is not null").select("type", "node", "leads"))
        open_ = new.filter("leads is null").select(*_CONDITION)
        aliases = new.filter("alias").select(*_CONDITION)
        left = open_.count()
        if log is not None:
            log.append(left)
        if not left:
            return decided


def er_leader_cluster(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Greedy leader clusters of ``texts`` (type, ord) under ``pairs`` (type, lo, hi, cosine).

    In order, an unassigned text leads and takes every later unassigned neighbour; not connected components. Returns
    (type, ord, leader, cosine), cosine null for leaders. A text without a type leads itself.
    """
    pairs = stored(pairs)
    members = leaders(pairs).filter(~F.col("leads")).select("type", F.col("node").alias("lo"))
    # A member joins the smallest neighbour that is not itself a member.
    joined = pairs.join(members, ["type", "lo"], "left_anti").groupBy(
        "type", F.col("hi").alias("ord")).agg(F.min(F.struct("lo", "cosine")).alias("_l")).select(
        "type", "ord", F.col("_l.lo").alias("leader"), F.col("_l.cosine").alias("cosine"))
    return texts.select("type", "ord").join(joined, ["type", "ord"], "left").withColumn(
        "leader", F.coalesce("leader", "ord"))
