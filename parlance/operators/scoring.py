"""Graph against graph: how much of a baseline graph does a student graph find?

Texts are compared after ``norm_key``; types are ignored by the overlap measures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.similarity import levenshtein_similarity
from parlance.functions.text import norm_key
from parlance.runtime import TASK_ROWS, stored  # noqa: F401
from parlance.runtime import dealt as _dealt
from parlance.schema import EDGE_TYPES, NODE_TYPES

QUANTITY_CAP = 1.5
# Longest text that is matched by deletions, however lax the threshold, and the most rows that one may become.
MAX_SHORT, MAX_LEFT = 64, 2400
# Texts of one key (a transcript) are compared directly where these are no more pairs a text.
PAIRED = 1024


def _texts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.select(*keys, norm_key(F.col("text")).alias("text")).filter(F.col("text") != "").distinct()


def _numbered(texts: DataFrame) -> DataFrame:
    """Texts with their length ``n`` and ``id``, a hash: texts that share one only meet more often, and are compared."""
    return texts.withColumn("n", F.length("text")).withColumn("id", F.xxhash64("text"))


def _budget(longest, threshold: float):
    """Most edits that two similar texts may differ by, the longer one being so long."""
    return F.floor(longest * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")


def _short_limit(threshold: float) -> int:
    """The greatest length whose budget is three edits or fewer, and which deletions may handle."""
    def fits(n: int) -> bool:
        depth = math.floor(n * (1 - threshold) + 1e-9)
        return depth <= 3 and sum(math.comb(n, k) for k in range(depth + 1)) <= MAX_LEFT

    n = 0
    while n < MAX_SHORT and fits(n + 1):
        n += 1
    return n


def _deletions(texts: DataFrame, keys: list[str], limit: int, threshold: float) -> DataFrame:
    """Rows (keys, text, n, settled, seg): a short text and hashes of what is left of it after as many deletions as the
    budget of its own length allows, three at most.

    Texts within d edits of each other become equal after deletions from either: from the longer one d at most, from the
    other d less the difference in length. The budget grows by one at most with every character, so neither needs more
    than its own.
    """
    text, n = F.col("text"), F.col("n")
    cut = lambda a, b: F.substr(text, a, b - a)  # noqa: E731 - characters a to b - 1, counted from 1
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(cut(F.lit(1), i), cut(i + 1, n + 1)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
        F.sequence(i + 1, n), lambda j: F.concat(cut(F.lit(1), i), cut(i + 1, j), cut(j + 1, n + 1)))))
    three = F.flatten(F.flatten(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.transform(
        F.sequence(i + 1, n - 1), lambda j: F.transform(F.sequence(j + 1, n), lambda k: F.concat(
            cut(F.lit(1), i), cut(i + 1, j), cut(j + 1, k), cut(k + 1, n + 1)))))))
    depth = _budget(n, threshold)
    none = F.array().cast("array<bigint>")
    hashed = lambda texts: F.transform(texts, lambda t: F.xxhash64(t))
    left = F.concat(F.array(F.col("id")), F.when(depth >= 1, hashed(one)).otherwise(none),
                    F.when((depth >= 2) & (n >= 2), hashed(two)).otherwise(none),
                    F.when((depth >= 3) & (n >= 3), hashed(three)).otherwise(none))
    # The length is asked inside the list: a filter beside it might run after the list is made for long texts too.
    return texts.select(*keys, "text", "n", "settled", F.explode(F.when(n <= limit, F.array_distinct(left)).otherwise(none)).alias("seg"))


def _left(n: Column, threshold: float) -> Column:
    """At most so many rows come of a text of ``n`` characters by deletions."""
    depth = _budget(n, threshold)
    return 1 + F.when(depth >= 1, n).otherwise(0) + F.when(depth >= 2, n * (n - 1) / 2).otherwise(0) + F.when(
        depth >= 3, n * (n - 1) * (n - 2) / 6).otherwise(0)


def _chunk_size(n, threshold: float):
    """Characters of a chunk: a text of length n has more chunks than any similar text may differ by edits."""
    most = _budget(F.floor(n / F.lit(threshold) + F.lit(1e-9)), threshold)
    return F.greatest(F.floor(n / (most + 1)), F.lit(1)).cast("int")


def _chunks(texts: DataFrame, keys: list[str], threshold: float, limit: int) -> DataFrame:
    """Rows (keys, id, n, settled, q, seg, at): hashes and places of the chunks of q characters a text is cut into."""
    n = F.col("n")
    sized = texts.filter(n >= threshold * (limit + 1) - 1e-9).withColumn("q", _chunk_size(n, threshold))
    each = F.transform(F.sequence(F.lit(0), F.floor(n / F.col("q")).cast("int") - 1), lambda i: F.struct(
        F.xxhash64(F.substr(F.col("text"), i * F.col("q") + 1, F.col("q"))).alias("seg"), (i * F.col("q")).alias("at")))
    return sized.select(*keys, "id", "n", "settled", "q", F.inline(each))


def _windows(texts: DataFrame, keys: list[str], threshold: float, limit: int) -> DataFrame:
    """Rows (keys, id, n, settled, q, seg, at): hashes and places of every substring as long as a chunk of some text
    similar in length."""
    n = F.col("n")
    partners = F.sequence(F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int"),
                          F.floor(n / F.lit(threshold) + F.lit(1e-9)).cast("int"))
    sizes = F.array_distinct(F.transform(partners, lambda m: _chunk_size(m, threshold)))
    sized = texts.filter(n >= threshold * (limit + 1) - 1e-9).select(
        *keys, "text", "id", "n", "settled", F.explode(sizes).alias("q"))
    each = F.transform(F.sequence(F.lit(0), n - F.col("q")), lambda i: F.struct(
        F.xxhash64(F.substr(F.col("text"), i + 1, F.col("q"))).alias("seg"), i.alias("at")))
    return sized.filter(F.col("q") <= n).select(*keys, "id", "n", "settled", "q", F.inline(each))


def fuzzy_pairs(
    student: DataFrame, baseline: DataFrame, metric: str = "levenshtein", threshold: float = 0.8,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """(keys, student_text, baseline_text, similarity) with an edit similarity >= threshold.

    Exact. Texts whose budget is three edits or fewer meet in an equality join on what deletions leave of them,
    which few other texts share, and are judged inside the stage of that join. Longer ones meet on unchanged
    chunks, by ids and numbers only; the texts are fetched for the pairs that meet enough of them, and compared.
    The number of rows grows with the length of a text, their width does not; the number of tasks grows with the
    rows, which are counted first.
    """
    keys = list(keys)
    if metric != "levenshtein":
        raise ValueError(f"unknown metric: {metric}")
    unsettled = F.lit(False).alias("settled")
    close = _near(stored(_texts(student, keys)).select("*", unsettled), stored(_texts(baseline, keys)).select("*", unsettled),
                  keys, threshold)
    return close.distinct().withColumn(
        "similarity", levenshtein_similarity(F.col("student_text"), F.col("baseline_text")))


def _near(
    student: DataFrame, baseline: DataFrame, keys: list[str], threshold: float, paired: int = PAIRED,
) -> DataFrame:
    """Pairs of similar texts, some more than once, but for those in which both sides are settled already.

    Where there are keys, the texts of one mostly have few pairs: they meet by key and length. Keys of more than
    ``paired`` pairs a text are searched as a whole vocabulary is.
    """
    if threshold <= 0.5:
        raise ValueError("the threshold must be above 0.5")
    if not keys:
        return _searched(student, baseline, keys, threshold)
    s, b = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for df, c in ((student, "_s"), (baseline, "_b")))
    large = stored(s.join(b, keys).filter(F.col("_s") * F.col("_b") > paired * (F.col("_s") + F.col("_b"))).select(*keys))
    if large.isEmpty():
        return _beside(student, baseline, keys, threshold)
    few = _beside(*(df.join(large, keys, "left_anti") for df in (student, baseline)), keys, threshold)
    return few.unionByName(_searched(*(df.join(large, keys, "left_semi") for df in (student, baseline)), keys, threshold))


def _beside(student: DataFrame, baseline: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The pairs of ``_near``, all texts of a key and of similar length compared."""
    # Lengths in bands: those of similar texts are the same or neighbours. An edit changes the set of characters by two
    # at most, which tells most pairs apart.
    band = F.floor(F.log(F.length("text")) / (math.log(1 / threshold) + 1e-6))
    signs = F.expr("aggregate(split(text, ''), 0L, (m, c) -> m | shiftleft(1L, ascii(c)))")
    s = student.select(*keys, F.col("text").alias("student_text"), F.length("text").alias("_sn"), F.col("settled").alias("_ss"),
                       signs.alias("_sm"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    b = baseline.select(*keys, F.col("text").alias("baseline_text"), F.length("text").alias("_bn"), F.col("settled").alias("_bs"),
                        signs.alias("_bm"), band.alias("_band"))
    budget = _budget(F.greatest("_sn", "_bn"), threshold)
    alike = ~(F.col("_ss") & F.col("_bs")) & (F.abs(F.col("_sn") - F.col("_bn")) <= budget) & (
        F.bit_count(F.col("_sm").bitwiseXOR(F.col("_bm"))) <= 2 * budget)
    edits = F.call_function("levenshtein", F.col("student_text"), F.col("baseline_text"), budget)
    return s.join(b.hint("merge"), [*keys, "_band"]).filter(alike).filter(edits >= 0).select(
        *keys, "student_text", "baseline_text")


def _searched(student: DataFrame, baseline: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The pairs of ``_near`` in an equality join on what deletions leave, or on chunks."""
    limit = _short_limit(threshold)
    student, baseline = _numbered(student), _numbered(baseline)
    sn, bn, n = F.col("_sn"), F.col("_bn"), F.col("n")
    budget = _budget(F.greatest(sn, bn), threshold)
    edits = F.call_function("levenshtein", F.col("student_text"), F.col("baseline_text"), budget)
    # A long text has a window for every character and a few sizes, each of which can meet many chunks.
    sizes = [F.sum(F.when(n <= limit, _left(n, threshold))).alias("short"),
             F.sum(F.when(n >= threshold * (limit + 1) - 1e-9, 16 * n)).alias("long")]
    counted = [df.agg(*sizes).first() for df in (student, baseline)]
    short_rows, long_rows = (sum(r[c] or 0 for r in counted) for c in ("short", "long"))
    # Few texts make many rows: they are spread before.
    student, baseline = (_dealt(df, short_rows + long_rows, [*keys, "id"]) for df in (student, baseline))

    def met(s: DataFrame, b: DataFrame, on: list[str], rows: float) -> DataFrame:
        s, b = (_dealt(df, rows, [*keys, *on]) for df in (s, b))
        s = s.withColumnsRenamed({"text": "student_text", "id": "_sid", "n": "_sn", "settled": "_ss", "at": "_sat"})
        b = b.withColumnsRenamed({"text": "baseline_text", "id": "_bid", "n": "_bn", "settled": "_bs", "at": "_bat"})
        # The rows far outnumber the texts Spark has sizes for: ask for the join that spreads, spills
        # and splits skewed keys rather than a broadcast chosen from the size of the texts.
        return s.join(b.hint("merge"), [*keys, *on]).filter(~(F.col("_ss") & F.col("_bs")) & (F.abs(sn - bn) <= budget))

    pair = [*keys, "student_text", "baseline_text"]
    short = met(_deletions(student, keys, limit, threshold), _deletions(baseline, keys, limit, threshold), ["seg"],
                short_rows).filter(edits >= 0).select(*pair)
    # An edit spoils one chunk at most and moves those behind it by one; the chunks left are counted before any text
    # is fetched.
    near = met(_windows(student, keys, threshold, limit), _chunks(baseline, keys, threshold, limit), ["q", "seg"],
               long_rows).filter(
        (F.greatest(sn, bn) > limit) & (F.abs(F.col("_sat") - F.col("_bat")) <= budget))
    ids = [*keys, "_sid", "_bid", "_sn", "_bn"]
    enough = near.groupBy(*ids, "q").agg(F.count("*").alias("_hits")).filter(
        F.col("_hits") >= F.floor(bn / F.col("q")) - budget).select(*ids).distinct()
    of = lambda texts, side, name: texts.select(
        *keys, F.col("id").alias(f"_{side}id"), F.col("n").alias(f"_{side}n"), F.col("text").alias(name))
    fetched = enough.join(of(student, "s", "student_text"), [*keys, "_sid", "_sn"]).join(
        of(baseline, "b", "baseline_text"), [*keys, "_bid", "_bn"])
    return short.unionByName(fetched.filter(edits >= 0).select(*pair))


def matched_texts(
    student: DataFrame, baseline: DataFrame, metric: str, threshold: float, keys: tuple[str, ...] = (),
    only_baseline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Distinct student and baseline texts, each with a ``matched`` flag, or with null for students if ``only_baseline``."""
    keys = list(keys)
    # Distinct texts are few beside the mentions they come from, and are read several times; each knows its sides.
    tagged = _texts(student, keys).withColumns({"_s": F.lit(True), "_b": F.lit(False)}).unionByName(
        _texts(baseline, keys).withColumns({"_s": F.lit(False), "_b": F.lit(True)}))
    both = F.col("_s") & F.col("_b")
    for k in keys:
        # No null key equals another.
        both = both & F.col(k).isNotNull()
    texts = stored(tagged.groupBy(*keys, "text").agg(F.bool_or("_s").alias("_s"), F.bool_or("_b").alias("_b")).withColumn(
        "settled", both))
    s, b = (texts.filter(side).select(*keys, "text", "settled") for side in ("_s", "_b"))
    if metric == "exact":
        return s.withColumnRenamed("settled", "matched"), b.withColumnRenamed("settled", "matched")
    # A text found verbatim on the other side is matched; it is compared with unmatched texts only, and where no
    # student is asked for, no matched baseline text is compared. Of the pairs no more than the texts asked for is kept.
    if only_baseline:
        close = _near(s.withColumn("settled", F.lit(True)), b.filter(~F.col("settled")), keys, threshold)
        hits = stored(close.select(*keys, F.lit("b").alias("side"), F.col("baseline_text").alias("text")).distinct())
    else:
        sides = F.array(F.struct(F.lit("s").alias("side"), F.col("student_text").alias("text")),
                        F.struct(F.lit("b").alias("side"), F.col("baseline_text").alias("text")))
        hits = stored(_near(s, b, keys, threshold).select(*keys, F.inline(sides)).distinct())

    def flagged(texts: DataFrame, side: str) -> DataFrame:
        hit = hits.filter(F.col("side") == side).drop("side").withColumn("_hit", F.lit(True))
        return texts.join(hit, [*keys, "text"], "left").withColumn(
            "matched", F.col("settled") | F.coalesce("_hit", F.lit(False))).drop("_hit", "settled")

    if only_baseline:
        return s.select(*keys, "text", F.lit(None).cast("boolean").alias("matched")), flagged(b, "b")
    return flagged(s, "s"), flagged(b, "b")


def node_overlap(
    student: DataFrame, baseline: DataFrame, metric: str = "levenshtein", threshold: float = 0.8,
) -> DataFrame:
    """Directional precision and recall of distinct texts, and their harmonic mean."""
    s, b = matched_texts(student, baseline, metric, threshold)
    both = s.select("matched", F.lit(True).alias("_s")).unionByName(b.select("matched", F.lit(False).alias("_s")))
    counts = both.agg(
        F.count_if(F.col("_s") & F.col("matched")).alias("matched_count"),
        F.count_if("_s").alias("student_total"),
        F.count_if(~F.col("_s") & F.col("matched")).alias("baseline_matched"),
        F.count_if(~F.col("_s")).alias("baseline_total"))
    precision = F.coalesce(F.try_divide("matched_count", "student_total"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("baseline_matched", "baseline_total"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counts.select(
        "matched_count", "student_total", "baseline_matched", "baseline_total",
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
        f1.alias("f1_exact"))


def _jaccard(student: DataFrame, baseline: DataFrame) -> DataFrame:
    """|A∩B| / |A∪B| of two tables of distinct rows, in one aggregation."""
    cols = student.columns
    tagged = student.withColumn("_s", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        baseline.withColumn("_s", F.lit(0)).withColumn("_b", F.lit(1)))
    sides = tagged.groupBy(*cols).agg(F.max("_s").alias("_s"), F.max("_b").alias("_b"))
    return sides.agg(
        F.sum(F.col("_s") * F.col("_b")).alias("common"), F.count(F.lit(1)).alias("union_size"))


def node_jaccard(student: DataFrame, baseline: DataFrame) -> DataFrame:
    """Exact-text Jaccard of the node sets."""
    return _jaccard(_texts(student, []), _texts(baseline, [])).withColumn(
        "node_jaccard", F.round(F.coalesce(F.try_divide("common", "union_size"), F.lit(0.0)), 4))


def edge_jaccard(student: DataFrame, baseline: DataFrame) -> DataFrame:
    """Common (source text, type, target text) triples over all edges, repeats counted.

    Inputs are edges with src_text, type, tgt_text.
    """
    triple = [norm_key(F.col("src_text")).alias("src"), F.col("type"), norm_key(F.col("tgt_text")).alias("tgt")]
    tagged = student.select(*triple, F.lit(1).alias("_s"), F.lit(0).alias("_b")).unionByName(
        baseline.select(*triple, F.lit(0).alias("_s"), F.lit(1).alias("_b")))
    per_triple = tagged.groupBy("src", "type", "tgt").agg(F.sum("_s").alias("_s"), F.sum("_b").alias("_b"))
    counts = per_triple.agg(
        F.count_if((F.col("_s") > 0) & (F.col("_b") > 0)).alias("common"),
        F.sum("_s").alias("student_edges"), F.sum("_b").alias("baseline_edges"))
    union = F.col("student_edges") + F.col("baseline_edges") - F.col("common")
    return counts.withColumn(
        "edge_jaccard", F.round(F.coalesce(F.try_divide(F.col("common"), union), F.lit(0.0)), 4))


def type_similarity(student: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cosine of the two vectors of node counts per type."""
    s = student.groupBy("type").agg(F.count(F.lit(1)).alias("s"))
    b = baseline.groupBy("type").agg(F.count(F.lit(1)).alias("b"))
    sides = s.join(b, "type", "full").na.fill(0, ["s", "b"])
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).cast("double")) * F.sqrt(F.sum(F.col("b") * F.col("b")).cast("double"))
    return sides.agg(F.round(F.coalesce(F.try_divide(
        F.sum(F.col("s") * F.col("b")).cast("double"), norm), F.lit(0.0)), 4).alias("type_similarity"))


def _completeness(student: DataFrame, baseline: DataFrame, name: str) -> DataFrame:
    """min(|S| / |B|, cap) / cap: more than the baseline earns credit up to the cap."""
    tagged = student.select(F.lit(1).alias("_s")).unionByName(baseline.select(F.lit(0).alias("_s")))
    counts = tagged.agg(F.sum("_s").alias("student_count"), F.sum(1 - F.col("_s")).alias("baseline_count"))
    ratio = F.least(F.coalesce(F.try_divide("student_count", "baseline_count"), F.lit(0.0)), F.lit(QUANTITY_CAP))
    return counts.withColumn(name, F.round(ratio / QUANTITY_CAP, 4))


def population_completeness(student: DataFrame, baseline: DataFrame) -> DataFrame:
    return _completeness(student, baseline, "population_completeness")


def relation_completeness(student_edges: DataFrame, baseline_edges: DataFrame) -> DataFrame:
    return _completeness(student_edges, baseline_edges, "relation_completeness")


def schema_completeness(
    nodes: DataFrame, edges: DataFrame, node_types: list[str] = NODE_TYPES, edge_types: list[str] = EDGE_TYPES,
) -> DataFrame:
    """Share of the required node and edge types that occur."""
    present = nodes.select(F.lit("node").alias("kind"), "type").filter(F.col("type").isin(node_types)).unionByName(
        edges.select(F.lit("edge").alias("kind"), "type").filter(F.col("type").isin(edge_types)))
    needed = len(node_types) + len(edge_types)
    return present.groupBy("kind", "type").agg(F.lit(1).alias("_one")).agg(
        F.count(F.lit(1)).alias("present")).withColumn(
        "schema_completeness", F.round(F.col("present") / needed, 4))


def composite_score(
    student: tuple[DataFrame, DataFrame], baseline: tuple[DataFrame, DataFrame], metric: str = "levenshtein",
    threshold: float = 0.8, node_types: list[str] = NODE_TYPES, edge_types: list[str] = EDGE_TYPES,
) -> DataFrame:
    """Mean of entity F1, population, relation and schema completeness.

    Quantity raises two of the four parts, so read it beside precision and recall.
    """
    (s_nodes, s_edges), (b_nodes, b_edges) = student, baseline
    s_texts, b_texts = _unified(s_nodes), _unified(b_nodes)
    parts = [
        node_overlap(s_nodes, b_nodes, metric, threshold).select(
            F.lit("entity_f1").alias("part"), F.col("f1").alias("value")),
        population_completeness(s_texts, b_texts).select(
            F.lit("population"), "population_completeness"),
        relation_completeness(s_edges, b_edges).select(F.lit("relation"), "relation_completeness"),
        schema_completeness(s_nodes, s_edges, node_types, edge_types).select(F.lit("schema"), "schema_completeness"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    names = ["entity_f1", "population", "relation", "schema"]
    row = whole.agg(*[F.max(F.when(F.col("part") == n, F.col("value"))).alias(n) for n in names])
    return row.withColumn("composite", F.round(sum(F.col(n) for n in names) / 4, 4))


def _unified(nodes: DataFrame) -> DataFrame:
    return nodes.select(norm_key(F.col("text")).alias("text"), "type").distinct()


def per_patient_coverage(
    student: DataFrame, baseline: DataFrame, metric: str = "levenshtein", threshold: float = 0.8,
) -> DataFrame:
    """Per transcript: share of baseline texts that a student text of the same transcript matches."""
    s, b = matched_texts(student, baseline, metric, threshold, ("res_id",), only_baseline=True)
    per_b = b.groupBy("res_id").agg(
        F.count(F.lit(1)).alias("baseline_count"), F.count_if("matched").alias("matched"))
    per_s = s.groupBy("res_id").agg(F.count(F.lit(1)).alias("student_count"))
    return per_b.join(per_s, "res_id", "left").select(
        "res_id", F.round(F.col("matched") / F.col("baseline_count"), 4).alias("recall"), "matched",
        F.coalesce("student_count", F.lit(0)).alias("student_count"), "baseline_count")


def coverage_worst_k(coverage: DataFrame, k: int) -> DataFrame:
    return coverage.orderBy("recall", "res_id").limit(k)
