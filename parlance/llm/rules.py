"""Quality rules whose cutoffs are risk-controlled: exact binomial tests on labelled documents, per stratum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read
from parlance.runtime import stored

WINDOW = 5
# Ratios between 0 and 1 that a rule may cut; a document above the cutoff is rejected.
RATIOS = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio"]
# Cutoffs are tested from the most lenient one down, in this many steps.
STEPS = 50
# At most this share of good documents may be rejected in a stratum, all rules together, ...
ALPHA = 0.05
# ... and the chance that any stratum breaks that is at most this.
DELTA = 0.05


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(grams: Column) -> Column:
    """Words inside windows that occur more than once, from the hashes of all windows of a text."""
    def positions(s: Column) -> Column:
        twice = lambda e, i: (F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                              | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, twice), lambda e: e["p"]))

    def length(p: Column) -> Column:
        new = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(new, F.lit(0).cast("bigint"), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(
        let(let(ordered, positions), length))


def text_statistics(text: Column) -> Column:
    """A struct of the counts of one text (null: no words), by SQL functions only.

    ``n_words`` words between ASCII white space, ``word_chars`` their code points, ``n_symbols``, ``n_upper``,
    ``n_lines`` lines with a word, ``n_dup_lines`` of them equal to an earlier one, ``n_repeat_words`` words inside
    five-word windows that occur at least twice (windows are compared by a 64-bit hash). Time grows with the
    length of the text and, for texts that repeat themselves, its logarithm.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = lambda w: F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    long = lambda c, name: c.cast("bigint").alias(name)
    of_words = let(words, lambda w: F.struct(
        long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"),
        let(grams(w), _covered).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"),
                    long(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), "n_symbols"),
                    long(F.length(F.regexp_replace(text, "[^A-Z]+", "")), "n_upper"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", strata: list[str] | None = None) -> DataFrame:
    """``doc_id``, the strata as one array, the counts, the ratios and ``base_failed`` of every row."""
    strata = F.array(*[F.col(s).cast("string") for s in strata or []]).cast("array<string>")
    out = docs.select(F.col(key).alias("doc_id"), strata.alias("stratum"), text_statistics(F.col(text)).alias("s")).select(
        "doc_id", "stratum", "s.w.*", "s.l.*", "s.n_symbols", "s.n_upper")
    part = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return out.select(
        "*", part("n_symbols", "word_chars").alias("symbol_ratio"), part("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        part("n_repeat_words", "n_words").alias("repeat_ratio"), part("n_upper", "word_chars").alias("upper_ratio"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly, by the ratio of neighbouring terms in logarithms."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.exp(n * F.log1p(F.lit(-p))).alias("s"))
    odds = F.log(F.lit(p / (1 - p)))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda a: a["s"])


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, ratio, cutoff)``: the strictest cutoffs proved safe; a ratio without a safe cutoff has no row.

    ``labels(doc_id, quality)``: documents of quality 1 are good. Of repeated labels the lowest holds. Only good
    documents that the base rules keep can be rejected by a cutoff. For each stratum and ratio, cutoffs are
    tested from the most lenient down and the first failure ends the sequence, so the steps need no correction;
    the strata and ratios are corrected after Bonferroni. A test rejects "more than alpha / ratios of the
    good documents are above the cutoff" by the exact binomial tail.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    held = stats.filter("not base_failed").join(good, "doc_id")
    # A document with ratio r is above the cutoffs 1 - i / STEPS of all steps i from this one on.
    step = lambda r: F.floor((1 - F.col(r)) * STEPS + F.lit(1e-9)) + 1
    counts = held.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("ratio"), step(r).alias("step")) for r in RATIOS])).alias("x")).groupBy(
            "stratum", "x.ratio", "x.step").count()
    table = counts.groupBy("stratum", "ratio").agg(
        F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("at"))
    tests = stored(table)
    families = max(1, tests.count())
    risk, level = alpha / len(RATIOS), delta / families
    above = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(0).cast("bigint"), lambda a, j: a + F.coalesce(
        F.try_element_at("at", j.cast("bigint")), F.lit(0)))
    safe = tests.select("stratum", "ratio", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(above(F.greatest(i, F.lit(1)))))).alias("step", "k"))
    safe = safe.withColumn("ok", (F.col("k") < F.col("n") * risk) & (binomial_cdf(
        F.when(F.col("k") < F.col("n") * risk, F.col("k")).otherwise(F.lit(0)), F.col("n"), risk) <= level))
    return safe.groupBy("stratum", "ratio").agg(
        F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(STEPS + 1)).alias("stop")).filter("stop > 0").select(
            "stratum", "ratio", (1 - (F.col("stop") - 1) / STEPS).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", strata: list[str] | None = None,
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed``, ``broken`` (ratios above a safe cutoff) and ``kept``.

    A stratum is the combination of the ``strata`` columns (nulls are a value; none: all documents are one). Where
    too few labels prove a cutoff safe, only the base rules apply, so without labels nothing more is rejected. Null and
    empty texts have no words and fail the base rules. Repeated rows are judged one by one; an empty table gives
    an empty result.
    """
    stats = stored(measured(docs, key, text, strata))
    cuts = cutoffs(stats, labels, alpha, delta).groupBy("stratum").pivot("ratio", RATIOS).agg(F.first("cutoff"))
    cuts = cuts.select("stratum", *[F.col(r).alias(f"_{r}") for r in RATIOS])
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"_{r}") + 1e-9, F.lit(r)) for r in RATIOS]))
    out = stats.join(stored(cuts), "stratum", "left").withColumn("broken", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop(*[f"_{r}" for r in RATIOS])


@query("op10_risk_controlled_rules")
def _op10(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), strata=["lang"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")
