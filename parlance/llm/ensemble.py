"""A quality classifier as a sparse ensemble of rules, compiled to column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read, remainder, unpacked, whole_row
from parlance.llm.rules import let
from parlance.runtime import stored

# Labelled rows that the classifier is fitted on, at most; those of the lowest hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.001
THRESHOLD = 0.3

FEATURES = ["log_words", "word_length", "distinct", "same_as_before", "dup_lines", "line_words", "symbols", "pipes",
            "upper", "digits", "exclamations", "stops"]


def statistics(text: Column) -> Column:
    """The features of a text as a struct, by SQL functions only; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Upper case, digits and signs of a text are few: later passes read only them.
    rest = F.regexp_replace(text, r"[^A-Z0-9!-/:-@\[-`{-~]+", "")

    def of_words(w: Column) -> Column:
        same = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
                        F.size(F.array_distinct(w)).alias("distinct"), same.alias("same"))

    def of_rest(r: Column) -> Column:
        size = lambda kind, name: F.length(F.regexp_replace(r, f"[^{kind}]+", "")).alias(name)
        return F.struct(size("#*$%&|<>", "symbols"), size("|", "pipes"), size("A-Z", "upper"), size("0-9", "digits"),
                        size("!", "exclamations"), size(".?;:,", "stops"))

    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counts = F.struct(let(words, of_words).alias("w"), of_lines.alias("l"), let(rest, of_rest).alias("r"))

    def features(c: Column) -> Column:
        n = F.greatest(c["w"]["n"], F.lit(1))
        chars = F.greatest(c["w"]["chars"], F.lit(1))
        values = [F.log1p(c["w"]["n"]), c["w"]["chars"] / n, c["w"]["distinct"] / n, c["w"]["same"] / n,
                  c["l"]["dup"] / F.greatest(c["l"]["n"], F.lit(1)), F.log1p(n / F.greatest(c["l"]["n"], F.lit(1))),
                  c["r"]["symbols"] / chars, c["r"]["pipes"] / chars, c["r"]["upper"] / chars, c["r"]["digits"] / chars,
                  c["r"]["exclamations"] / chars, c["r"]["stops"] / chars]
        return F.struct(*[v.cast("double").alias(name) for v, name in zip(values, FEATURES)])

    return let(counts, features)


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, above, threshold)`` and its weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            value = F.col(f"{stats}.{name}")
            out = out & ((value > threshold) if above else (value <= threshold))
        return out

    def __str__(self) -> str:
        body = " and ".join(f"{n} {'>' if above else '<='} {t:.4g}" for n, above, t in self.conditions)
        return f"{self.weight:+.3f} if {body}"


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: str = "stats") -> Column:
        """The probability of label 1."""
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + F.when(r.column(stats), F.lit(r.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, taken: dict[tuple[str, bool], float]) -> set[tuple]:
    """The conditions of every node below a tree's root; a feature is bounded once from each side."""
    out = {tuple(sorted((n, a, t) for (n, a), t in taken.items()))} if taken else set()
    if node.getClass().getSimpleName() == "LeafNode":
        return out
    name, threshold = FEATURES[node.split().featureIndex()], float(node.split().threshold())
    for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
        old = taken.get((name, above))
        bound = threshold if old is None else (max if above else min)(old, threshold)
        out |= _paths(child, {**taken, (name, above): bound})
    return out


def fit(examples: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> Ensemble:
    """Rules from the paths of a forest over ``examples(stats, label)``, weighted by a lasso logistic regression.

    Rules of weight zero go. Without both labels the score is the share of label 1 (a half without rows).
    """
    counts = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), counts.get(1.0, 0)
    prior = math.log((ones + 1) / (n - ones + 1))
    if not ones or ones == n:
        return Ensemble(prior, ())
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples.select("stats.*", "label")).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5,
                                    featureSubsetStrategy="0.5", maxBins=64).fit(table)
    found = sorted(set().union(*(_paths(t._call_java("rootNode"), {}) for t in forest.trees)))
    rules = [Rule(c) for c in found]
    if not rules:
        return Ensemble(prior, ())
    hits = examples.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(hits)
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(
        hits.select("features", "label"))
    weights = model.coefficients.toArray().tolist()
    return Ensemble(float(model.intercept), tuple(
        Rule(r.conditions, w) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS, **settings) -> Ensemble:
    """An ensemble from the labelled documents outside the held-out fifth (crc32 of the id, modulo 5, is 0).

    Of repeated labels the lowest holds; labels that are null, or without a document, are left out.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label")).filter(
        "id is not null and label in (0, 1)").filter(remainder(F.col("id"), 5) != 0)
    chosen = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    # A limit bounds this side, so it may be broadcast.
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(stored(chosen)), "id")
    return fit(stored(texts.select(statistics(F.col("text")).alias("stats"), "label")), **settings)


def scored(docs: DataFrame, ensemble: Ensemble, text: str = "text") -> DataFrame:
    """``(doc, stats, score)`` for every row, with the whole row as ``doc``. Only the text matters for the score."""
    out = docs.select(whole_row(docs), statistics(F.col(text)).alias("stats"))
    return out.withColumn("score", ensemble.score())


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; its columns stay as they are.

    The classifier is learned from these documents. Empty and null texts are scored like any other; without labels
    every score is a half and every row stays.
    """
    return unpacked(scored(docs, learn(docs, labels, **settings)).filter(F.col("score") >= threshold))


@query("op4_sparse_rule_ensemble")
def _op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = learn(docs, read(spark, sf_dir, "labels"))
    return scored(docs, ensemble).select(
        "doc.doc_id", (remainder(F.col("doc.doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
