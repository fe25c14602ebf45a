"""Exact searches among vectors by a metric index: cells around pivots, met only where their angles allow it.

The angle of two vectors obeys the triangle inequality. A vector belongs to the cell of its nearest pivot; what is known
of a cell is the range of its members' angles to that pivot. Two vectors within an angle of each other then lie in cells
that both bounds below let meet, so all other pairs of cells are skipped and no pair is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, pi

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.vectors import unit_rows
from parlance.runtime import stored

# Vectors per block of a comparison: two blocks and their product fit in one task.
BLOCK_ROWS = 4096
# Pivots of one type, and numbers in all pivots together (64 MB), which every task gets.
MAX_PIVOTS, PIVOT_VALUES = 1024, 8 << 20
# Blocks that a key is compared in where they may be larger than asked for: with b of them each vector has about b/2 copies.
TILES = 16
# Vectors sampled for each wanted pivot.
SAMPLED = 16
# Allowance for rounded angles, in radians.
SLACK = 1e-6
# Rows compared at once within a task.
STRIPE = 512
# Cosines held at once while labels are searched (8 MB).
PRODUCT = 1 << 20
# Label blocks' worth of vectors that ask one block in one task.
ASKING = 4


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """``homes``: the vectors with ``_group`` (-1: of a key without pivots), ``_cell`` and ``_angle`` to its pivot."""

    homes: DataFrame
    shared: Broadcast | None
    keys: list[str]

    def sizes(self) -> DataFrame:
        return self.homes.groupBy(*self.keys, "_group", "_cell").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_angle").alias("_low"), F.max("_angle").alias("_high"))

    def ranges(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By group: least and largest angle of each cell; an empty cell has an empty range. One row per pivot."""
        out = {g: (np.full(len(p), np.inf), np.full(len(p), -np.inf)) for g, p in enumerate(self.shared.value)} if self.shared else {}
        for r in self.sizes().filter("_group >= 0").collect():
            out[r["_group"]][0][r["_cell"]], out[r["_group"]][1][r["_cell"]] = r["_low"], r["_high"]
        return out


def _choose(apart: float):
    """Pivots of one key, from its sample in the order of a hash: each at least ``apart`` from all before it, so that a
    dense cluster gets one."""
    def choose(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["_h", "ord"])
        units = unit_rows(sample["embedding"])
        near, chosen = np.full(len(units), np.inf), []
        for i in range(len(units)):
            if len(chosen) == sample["_wanted"].iat[0]:
                break
            if near[i] >= apart:
                chosen.append(i)
                near = np.minimum(near, angles(units, units[i:i + 1])[:, 0])
        return sample.iloc[chosen].assign(embedding=list(units[chosen]))[[*sample.columns.drop(["ord", "_h", "_wanted"])]]

    return choose


def in_cells(vectors: DataFrame, keys: list[str], apart: float, block_rows: int = BLOCK_ROWS) -> Cells:
    """Put ``vectors`` (keys, ord, embedding; none of them zero) into cells.

    A key of more than ``block_rows`` vectors gets about one pivot for each block of them, from a sample; the sample
    decides how well cells fit, never which pairs are found. All pivots together are at most PIVOT_VALUES numbers.
    """
    plain = vectors.withColumns({"_group": F.lit(-1), "_cell": F.lit(0), "_angle": F.lit(0.0)})
    large = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"), F.max(F.size("embedding")).alias("_dims")).filter(
        F.col("_count") > block_rows)
    blocks = F.least(F.ceil(F.col("_count") / block_rows), F.lit(MAX_PIVOTS))
    values = large.agg(F.sum(blocks * F.col("_dims"))).first()[0]
    if not values:
        return Cells(plain, None, keys)
    wanted = F.floor(blocks * min(1.0, PIVOT_VALUES / values))
    hashed = F.xxhash64("ord")
    sample = vectors.join(large.select(*keys, "_count", wanted.alias("_wanted")), keys).filter(
        F.pmod(hashed, F.col("_count")) < SAMPLED * F.col("_wanted")).select(
        *keys, "ord", "embedding", hashed.alias("_h"), "_wanted")
    key_fields = [vectors.schema[k] for k in keys]
    chosen = sample.groupBy(*keys).applyInPandas(_choose(apart), T.StructType(
        [*key_fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])).collect()
    by_key: dict[tuple, list] = {}
    for r in chosen:
        by_key.setdefault(tuple(r[k] for k in keys), []).append(r["embedding"])
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast([np.array(p) for p in by_key.values()])
    groups = spark.createDataFrame([(*k, g) for g, k in enumerate(by_key)], T.StructType(
        [*key_fields, T.StructField("_group", T.IntegerType())]))

    def home(group: pd.Series, embedding: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.zeros(len(group), int), "angle": np.zeros(len(group))})
        for g in set(group) - {-1}:
            at = np.flatnonzero(group == g)
            a = angles(unit_rows(embedding.iloc[at]), shared.value[g])
            best = a.argmin(axis=1)
            out.loc[at, "cell"], out.loc[at, "angle"] = best, a[np.arange(len(at)), best]
        return out

    home.__annotations__ = {"group": pd.Series, "embedding": pd.Series, "return": pd.DataFrame}
    # Non-deterministic only so that Spark evaluates it once for its two fields.
    udf = F.pandas_udf(home, "cell int, angle double").asNondeterministic()
    joined = vectors.join(groups, keys, "left").withColumn("_group", F.coalesce("_group", F.lit(-1)))
    homes = joined.withColumn("_home", udf("_group", "embedding")).select(
        *vectors.columns, "_group", F.col("_home.cell").alias("_cell"), F.col("_home.angle").alias("_angle"))
    return Cells(stored(homes), shared, keys)


def reachable(a: np.ndarray, home: np.ndarray, low: np.ndarray, high: np.ndarray, within: float) -> np.ndarray:
    """Which cells (columns) may hold a vector within an angle of each row, by the row's angles ``a`` to all pivots.

    A member of a cell is nowhere nearer to the row's own pivot than to the cell's, so the row is at most twice the
    angle farther from the cell's pivot than from its own; and the member's range bounds it from both sides.
    """
    reach = within + SLACK
    own = a[np.arange(len(a)), home][:, None]
    return (a - own <= 2 * reach) & (a <= high + reach) & (a >= low - reach)


def pair_tasks(texts: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, guard: str | None = None) -> DataFrame:
    """The vectors, dealt out to tasks of at most two blocks: ``keys, _cell, _i, _j, _mine, ord, embedding, _angle``.

    Cells of few vectors go together as they are numbered, in tiles of a sixteenth of their key (at least ``block_rows``,
    at most BLOCK_ROWS vectors), so that copies and tasks grow with the vectors and not with the cells. A vector comes to
    its own tile, and to those of the other tiles with a cell it can reach that its own does not send to: of two tiles
    the smaller number sends where their sum is even, the larger where it is odd. Only a tile of more than one block is
    cut, and its vectors repeated for its own blocks.
    """
    keys = ["type", *([guard] if guard else [])]
    vectors = texts.select(*keys, "ord", "embedding").filter(F.col(keys[-1]).isNotNull() & F.col("type").isNotNull())
    if threshold > 0:
        # A zero vector is like no other.
        vectors = vectors.filter(F.exists("embedding", lambda x: x != 0))
    within = acos(min(threshold, 1.0)) if threshold > 0 else pi
    # Nothing is apart enough where all pairs may meet.
    cells = in_cells(vectors, keys, within if threshold > 0 else 2 * pi, block_rows)
    if cells.shared is None:
        return cells.homes.drop("_group").withColumns({c: F.lit(0) for c in ("_i", "_j", "_mine")})
    ranges, shared = cells.ranges(), cells.shared
    held = dict(cells.homes.groupBy("_group").count().collect())
    rows = {g: max(block_rows, min(BLOCK_ROWS, -(-n // TILES))) for g, n in held.items() if g >= 0}
    per = {g: max(1, r * len(shared.value[g]) // held[g]) for g, r in rows.items()}

    def places(group: pd.Series, cell: pd.Series, embedding: pd.Series) -> pd.Series:
        out = pd.Series([[{"cell": 0, "angle": 0.0, "own": True, "rows": block_rows}]] * len(group), dtype=object)
        for g in set(group) - {-1}:
            at = np.flatnonzero(group == g)
            home = cell.to_numpy()[at]
            a = angles(unit_rows(embedding.iloc[at]), shared.value[g])
            first = np.arange(0, a.shape[1], per[g])
            mine, number = (home // per[g])[:, None], np.arange(len(first))[None, :]
            sends = ((number + mine) % 2 == 0) == (mine < number)
            met = np.logical_or.reduceat(reachable(a, home, *ranges[g], within), first, axis=1) & sends | (number == mine)
            for i, own, row, far in zip(at, mine[:, 0], met, a[:, first]):
                out.iat[i] = [{"cell": int(c), "angle": float(far[c]), "own": bool(c == own), "rows": rows[g]} for c in np.flatnonzero(row)]
        return out

    places.__annotations__ = {"group": pd.Series, "cell": pd.Series, "embedding": pd.Series, "return": pd.Series}
    to = F.pandas_udf(places, "array<struct<cell:int,angle:double,own:boolean,rows:int>>")
    placed = stored(cells.homes.withColumn("_to", F.explode(to("_group", "_cell", "embedding"))).select(
        *keys, F.col("_to.cell").alias("_cell"), "ord", "embedding", F.col("_to.angle").alias("_angle"),
        F.col("_to.own").alias("_home"), F.col("_to.rows").alias("_rows")))
    blocks = lambda some: F.ceil(F.count_if(some) / F.max("_rows")).cast("int")
    # An empty tile has nobody to meet; it drops out here.
    grid = placed.groupBy(*keys, "_cell").agg(
        blocks(F.col("_home")).alias("_own"), blocks(~F.col("_home")).alias("_more")).filter("_own > 0")
    cut = lambda n: F.pmod(F.xxhash64("ord"), n).cast("int")
    dealt = placed.join(grid, [*keys, "_cell"])
    own = dealt.filter("_home").withColumns({
        "_mine": cut(F.col("_own")), "_other": F.explode(F.sequence(F.lit(0), F.col("_own") + F.col("_more") - 1))})
    more = dealt.filter("not _home").withColumns({
        "_mine": F.col("_own") + cut(F.col("_more")), "_other": F.explode(F.sequence(F.lit(0), F.col("_own") - 1))})
    return own.unionByName(more).select(
        *keys, "_cell", "ord", "embedding", "_angle", "_mine",
        F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"))


def close_pairs(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs over the threshold of two blocks, or of one with itself (``right`` None): ords and cosines.

    Rows are in order of their angle to the pivot; a stripe meets only what lies within the angle on that scale.
    """
    within = (acos(min(threshold, 1.0)) if threshold > 0 else pi) + SLACK
    order = lambda b: b.iloc[np.argsort(b["_angle"].to_numpy(), kind="stable")]
    left = order(left)
    lu, la, lo = unit_rows(left["embedding"]), left["_angle"].to_numpy(), left["ord"].to_numpy()
    if right is None:
        ru, ra, ro = lu, la, lo
    else:
        right = order(right)
        ru, ra, ro = unit_rows(right["embedding"]), right["_angle"].to_numpy(), right["ord"].to_numpy()
    found = []
    for s in range(0, len(lu), STRIPE):
        e = min(s + STRIPE, len(lu))
        first = s if right is None else int(np.searchsorted(ra, la[s] - within, "left"))
        last = int(np.searchsorted(ra, la[e - 1] + within, "right"))
        sims = lu[s:e] @ ru[first:last].T
        r, c = np.nonzero(sims >= threshold)
        if right is None:
            r, c = r[c > r], c[c > r]
        found.append((lo[s + r], ro[first + c], sims[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


def similar_pairs(
    texts: DataFrame, threshold: float = 0.85, block_rows: int = BLOCK_ROWS, guard: str | None = None,
) -> DataFrame:
    """Same-type pairs with cosine >= threshold: (type, lo, hi, cosine), lo < hi by ``ord``.

    ``texts``: ord (unique), type, embedding: the distinct texts, far fewer than mentions. ``guard`` may name a column
    both texts must agree on. A type of one block is compared in one task; a larger one is cut into cells by its
    vectors, and only cells that the threshold lets meet are compared.
    """
    keys = ["type", *([guard] if guard else [])]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        i, j = block["_i"].iat[0], block["_j"].iat[0]
        left = block[block["_mine"] == i]
        right = None if i == j else block[block["_mine"] == j]
        if left.empty or (right is not None and right.empty):
            return pd.DataFrame({"type": [], "lo": [], "hi": [], "cosine": []})
        a, b, cosine = close_pairs(left, right, threshold)
        return pd.DataFrame({"type": block["type"].iat[0], "lo": np.minimum(a, b), "hi": np.maximum(a, b), "cosine": cosine})

    kind = texts.schema["type"].dataType.simpleString()
    return pair_tasks(texts, threshold, block_rows, guard).groupBy(*keys, "_cell", "_i", "_j").applyInPandas(
        compare, f"type {kind}, lo bigint, hi bigint, cosine double")


def to_ask(a: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray, seen: np.ndarray, width: int) -> list[list[int]]:
    """The next ``width`` cells for each row, the most promising first, that may still hold a larger cosine than
    ``best``, or an equal one. A member of a cell is at least as far as the row is from the cell's range."""
    least = np.maximum(np.maximum(a - high, low - a), 0.0) - SLACK
    order = np.argsort(least, axis=1, kind="stable")
    out = []
    for row, cells, b, s in zip(least, order, best, seen):
        some = cells[s:s + width]
        # An angle beyond the right one has no positive cosine; an empty cell is infinitely far.
        out.append(some[(row[some] <= pi / 2) & (np.cos(np.clip(row[some], 0.0, pi)) >= b)].tolist())
    return out


def best_labels(units: np.ndarray, ords: np.ndarray, label_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best label of each row and its cosine; labels come by ``ord``, and the first of equals wins.

    Cosines are compared by 12 digits, so that equal vectors tie in whatever block they are compared.
    """
    at, best = np.zeros(len(units), int), np.zeros(len(units))
    rows = max(1, PRODUCT // len(label_units))
    for i in range(0, len(units), rows):
        sims = units[i:i + rows] @ label_units.T
        at[i:i + rows] = np.round(sims, 12).argmax(axis=1)
        best[i:i + rows] = sims[np.arange(len(sims)), at[i:i + rows]]
    return at, best


def _asking(shared: Broadcast | None, ranges: dict, width: int):
    def ask(group: pd.Series, embedding: pd.Series, best: pd.Series, seen: pd.Series) -> pd.Series:
        # A type without pivots is one cell.
        out = pd.Series([[0] if s == 0 else [] for s in seen], dtype=object)
        for g in set(group) - {-1}:
            at = np.flatnonzero(group == g)
            a = angles(unit_rows(embedding.iloc[at]), shared.value[g])
            for i, found in zip(at, to_ask(a, *ranges[g], best.to_numpy()[at], seen.to_numpy()[at], width)):
                out.iat[i] = found
        return out

    ask.__annotations__ = dict.fromkeys(["group", "embedding", "best", "seen", "return"], pd.Series)
    return ask


_FOUND = "_vid bigint, _label string, _ord bigint, _best double"


def nearest_in_cells(nodes: DataFrame, vocab: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``nodes`` with label, cosine and has_labels, through an index of the vocabulary.

    Labels lie in cells. Each distinct (type, vector) asks the most promising cell first, then in doubling numbers those
    whose bound still reaches its best cosine, until none is left: the answer is that of all labels, ties to the first.
    Every round is written once, and most vectors end in the first two. A cell asked by many is asked in pieces.
    """
    labels = stored(vocab.select("type", "label", F.col("ord").cast("bigint").alias("ord"), "embedding"))
    real = labels.filter(F.col("type").isNotNull() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    cells = in_cells(real, ["type"], 0.5, block_rows)
    ranges, shared = cells.ranges(), cells.shared
    pieces = cells.sizes().select("type", "_cell", F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    blocks = cells.homes.join(pieces, ["type", "_cell"]).withColumn(
        "_block", F.pmod(F.xxhash64("ord"), F.col("_blocks")).cast("int")).select(
        "type", "_cell", "_block", "label", "ord", "embedding")
    groups = cells.homes.select("type", "_group").distinct()
    state = stored(nodes.select("type", "embedding").filter(F.col("embedding").isNotNull()).distinct().join(
        groups, "type").select("type", "embedding", "_group", F.monotonically_increasing_id().alias("_vid"), F.lit(0).alias("_seen"),
                               F.lit(None).cast("string").alias("_label"), F.lit(None).cast("bigint").alias("_ord"),
                               F.lit(0.0).alias("_best")))
    rank = lambda b, o, name: F.struct(F.round(b, 12).alias("r"), (-o).alias("o"), name.alias("l"), b.alias("b"))
    done, width = [], 1
    while True:
        # Non-deterministic only so that it is evaluated once for both filters.
        asked = stored(state.withColumn("_ask", F.pandas_udf(_asking(shared, ranges, width), "array<int>").asNondeterministic()(
            "_group", "embedding", "_best", "_seen")))
        done.append(asked.filter("size(_ask) = 0"))
        open_ = asked.filter("size(_ask) > 0")
        if open_.isEmpty():
            break
        asks = open_.select("type", "_vid", "embedding", F.explode("_ask").alias("_cell")).join(pieces, ["type", "_cell"])
        many = asks.groupBy("type", "_cell").agg(F.ceil(F.count(F.lit(1)) / (ASKING * block_rows)).cast("int").alias("_chunks"))
        left = asks.join(many, ["type", "_cell"]).select(
            "type", "_cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
            F.pmod(F.xxhash64("_vid"), F.col("_chunks")).cast("int").alias("_chunk"), "_vid", "embedding")
        right = blocks.join(many, ["type", "_cell"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")

        def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if mine.empty or theirs.empty:
                return pd.DataFrame({"_vid": [], "_label": [], "_ord": [], "_best": []})
            theirs = theirs.sort_values("ord", kind="stable")
            at, best = best_labels(unit_rows(mine["embedding"]), theirs["ord"].to_numpy(), unit_rows(theirs["embedding"]))
            return pd.DataFrame({"_vid": mine["_vid"], "_label": theirs["label"].to_numpy()[at], "_ord": theirs["ord"].to_numpy()[at], "_best": best})[best > 0]

        key = ["type", "_cell", "_block", "_chunk"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, _FOUND)
        best = found.groupBy("_vid").agg(F.max(rank(F.col("_best"), F.col("_ord"), F.col("_label"))).alias("new"))
        old = F.when(F.col("_label").isNotNull() | F.col("_ord").isNotNull(), rank(F.col("_best"), F.col("_ord"), F.col("_label")))
        state = open_.join(best, "_vid", "left").withColumn("_top", F.greatest(old, "new")).select(
            "type", "embedding", "_group", "_vid", (F.col("_seen") + width).alias("_seen"), F.col("_top.l").alias("_label"),
            (-F.col("_top.o")).alias("_ord"), F.coalesce("_top.b", F.lit(0.0)).alias("_best"))
        width *= 2
    answers = done[0]
    for part in done[1:]:
        answers = answers.unionByName(part)
    answers = answers.select("type", "embedding", F.col("_label").alias("label"), F.when(F.col("_ord").isNotNull(), F.col("_best")).alias("cosine"))
    known = labels.select("type").distinct().withColumn("has_labels", F.lit(True))
    return nodes.join(answers, ["type", "embedding"], "left").join(known, "type", "left").select(
        *nodes.columns, "label", "cosine", F.coalesce("has_labels", F.lit(False)).alias("has_labels"))
