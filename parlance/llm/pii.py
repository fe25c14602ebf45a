"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated thresholds.

Everything runs as SQL functions; the trees are fitted by Spark's own booster and compiled to column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read, unpacked, whole_row
from parlance.llm.rules import let
from parlance.runtime import drop_stored, stored

# About so many distinct candidates the trees are fitted on at most, as many of each kind and label where there are.
SAMPLE_CANDIDATES = 20_000
TREES, DEPTH = 12, 3
# A threshold is the lowest one that keeps this precision on the candidates held out from fitting.
PRECISION = 0.99
BINS = 50
CONTEXT = 24

LOCAL = "[A-Za-z0-9._%+-]"
# Kinds with fixed formats. The patterns find what the plain forms find, leftmost and without overlap, but in linear
# time and constant stack: they start where a run of their characters starts, or where the last match ended.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: spans that may be personal data or a secret.
GENERATORS = {
    "email_like": ("email", r"[A-Za-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{2,63}\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,10}"
                            r"(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z]{2,10}){0,3}"),
    "phone_like": ("phone", r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    "number_like": ("number", r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}"
                              r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?(?=[A-Z0-9]{0,2}[0-9])[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"),
    "secret_like": ("secret", r"(?:(?i:pass(?:word|wd)?|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?\x22?[A-Za-z0-9_/+.-]{6,}+\x22?"
                              r"|(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{24,}+(?![A-Za-z0-9]))"),
}
KINDS = ["email", "ip", "card", "phone", "number", "secret"]
# What certainly is a secret: a key of a known form, or a named value that is long and hexadecimal.
SURE_SECRET = r"^(?:AKIA[0-9A-Z]{16}|(?i:password|token|secret|api[_-]?key)\x20?[=:]\x20?\x22?[0-9a-f]{16,}\x22?)$"
FEATURES = ["kind", "length", "digits", "lower", "upper", "separators", "distinct", "luhn", "octets", "address", "ssn",
            "iban", "joined", "hex", "cue_secret", "cue_phone", "cue_number", "cue_mail", "quoted"]


def running(values: Column, join: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """An array of integers joined up to each place, in two levels so that long arrays stay cheap; 0 joins to nothing."""
    total = lambda a: F.aggregate(a, F.lit(0), join)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(values) - 1) / chunk, F.lit(0)).cast("int")),
                         lambda c: F.slice(values, c * chunk + 1, chunk))

    def joined(cs: Column) -> Column:
        each = F.transform(cs, total)
        return let(each, lambda s: F.flatten(F.transform(cs, lambda c, i: let(
            total(F.slice(s, 1, i)), lambda before: F.transform(c, lambda _, j: join(before, total(F.slice(c, 1, j + 1))))))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(chunks, joined))


def running_sums(values: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array."""
    return running(values, lambda x, y: x + y, chunk)


def first_place(sorted_spans: Column, reached: Callable[[Column], Column]) -> Column:
    """Index of the first element for which ``reached`` holds (the size if none), by halving: ``reached`` holds from
    some element on."""
    n = F.size(sorted_spans)
    halves = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((to <= n) & ~reached(F.get(sorted_spans, to - 1)), to).otherwise(at)

    return F.aggregate(halves, F.lit(0), step)


def overlapping(family: Column, span: Column) -> Column:
    """The spans of a family that overlap a span. A family is sorted and its spans do not overlap one another, so all
    families together give all spans of a text a number of pairs in proportion to the spans."""
    first = first_place(family, lambda y: y["end"] > span["start"])
    last = first_place(family, lambda y: y["start"] >= span["end"])
    return let(first, lambda a: F.slice(family, a + 1, F.greatest(last - a, F.lit(0))))


def families(spans: Column) -> Column:
    """Spans by what proposed them, as arrays in text order; patterns without spans are left out."""
    sources = F.sequence(F.lit(0), F.lit(len(BASE) + len(GENERATORS) - 1))
    each = F.transform(sources, lambda k: F.filter(spans, lambda c: c["source"] == k))
    return F.filter(each, lambda f: F.size(f) > 0)


def cut_out(text: Column, spans: Callable[[Callable[[Column, Column], Column]], Column], block: int = 1024) -> Column:
    """What ``spans`` makes of a function that cuts code points from a start to an end out of the text.

    Cutting in a long text counts its characters from the front; here only those of a block are counted.
    """
    def of(blocks: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            within = F.sequence((start / block).cast("int"), ((end - 1) / block).cast("int"))
            parts = F.transform(within, lambda k: F.substring(
                F.get(blocks, k), F.greatest(start - k * block, F.lit(0)) + 1,
                F.least(end - k * block, F.lit(block)) - F.greatest(start - k * block, F.lit(0))))
            return F.when(end > start, F.array_join(parts, "")).otherwise("")

        return spans(cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}+"), F.lit(0)), of)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and without overlap: ``(start, end, value, before, after)`` in code points."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def placed(found: Column) -> Column:
        def with_parts(parts: Column) -> Column:
            ends = running_sums(F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m)))
            return let(ends, lambda e: F.transform(found, lambda m, i: F.struct(
                (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("value"),
                F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(8)).alias("after"))))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_parts)).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def term(c: Column, i: Column) -> Column:
        twice = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    terms = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), term)
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def address(value: Column) -> Column:
    """Whether a value is an e-mail address, once signs written as ``(at)`` and ``(dot)`` are put back."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    return plain.rlike(rf"^{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$") & plain.rlike(r"\.(?:[a-z]{2,10}|[A-Z]{2,10})$")


def ssn(value: Column) -> Column:
    """Whether a value is a social security number of a range that is given out."""
    return value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def iban(value: Column) -> Column:
    """Whether a value is an account number that passes its check: 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    digits = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(digits, F.lit(0), step) == 1).otherwise(False)


def _joined(c: Column) -> Column:
    """Whether a candidate is cut out of a longer run of numbers."""
    return c["before"].rlike(r"(?:[0-9]{2}[\x20.-]|[0-9]\.)$") | c["after"].rlike(r"^[\x20.-]?[0-9]")


def _sure_email(c: Column) -> Column:
    v = c["value"]
    return F.when(address(v), True).when(v.rlike(r"\.\x20[A-Z][a-z]"), False)


def _sure_phone(c: Column) -> Column:
    v, before = c["value"], c["before"]
    sized = VALID["phone"](v)
    cued = before.rlike(r"(?i)\b(?:tel|telephone|phone|call|fax|mobile?|cell)\b[^0-9]*$")
    return (F.when(before.rlike(r"\+[0-9]{1,3}[\x20.-]$"), F.when(sized, True)).when(_joined(c) | ~sized, False)
            .when(cued | v.rlike(r"^\([2-9][0-9]{2}\)\x20[2-9][0-9]{2}-[0-9]{4}$"), True))


def _sure_secret(c: Column) -> Column:
    v = c["value"]
    no = v.rlike("^[0-9]+$") | iban(v) | v.rlike(r"[=:]\x20[A-Za-z][a-z]+\.?$")
    return F.when(v.rlike(SURE_SECRET), True).when(no, False)


# Weak labels of what the generators propose: true, false, or null where neither is known.
SURE = {
    "email_like": _sure_email,
    "phone_like": _sure_phone,
    "number_like": lambda c: ssn(c["value"]) | iban(c["value"]),
    "secret_like": _sure_secret,
}
VALID = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def candidates(text: Column) -> Column:
    """All candidate spans of a text (null: none): ``kind``, ``source``, ``base`` (a base span), ``sure`` (weak
    label: true, false, or null if unknown)."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:int,source:int,base:boolean,sure:boolean,start:int,end:int,value:string,before:string,after:string>>")

    def of(pattern: str, kind: str, source: int, base, sure) -> Column:
        return F.transform(matches(text, pattern), lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(source).alias("source"), base(m["value"]).alias("base"),
            sure(m).alias("sure"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            m["before"].alias("before"), m["after"].alias("after")))

    def guarded(guard: Column, found: list[Column]) -> Column:
        return F.when(guard, F.concat(*found)).otherwise(none)

    base = {k: of(p, k, i, VALID[k], lambda m, k=k: VALID[k](m["value"])) for i, (k, p) in enumerate(BASE.items())}
    never = lambda v: F.lit(False)
    more = {n: of(p, k, len(BASE) + i, never, SURE[n]) for i, (n, (k, p)) in enumerate(GENERATORS.items())}
    return F.concat(
        guarded(text.contains("@"), [base["email"]]),
        guarded(text.contains("@") | text.rlike(r"[(\[]at[)\]]"), [more["email_like"]]),
        guarded(text.contains("+"), [base["phone"]]),
        guarded(text.rlike("[0-9]"), [base["ip"], base["card"], more["phone_like"], more["number_like"]]),
        guarded(text.rlike("[0-9]") | text.rlike(r"(?i)pass|pwd|token|secret|api[_-]?key"), [more["secret_like"]]))


def features(c: Column) -> Column:
    """Format and context of a candidate, as doubles."""
    v = c["value"]
    size = lambda kind: F.length(F.regexp_replace(v, f"[^{kind}]+", ""))
    cue = lambda words: F.lower(c["before"]).rlike(words) | F.lower(F.left(v, F.lit(12))).rlike(words)
    n = F.greatest(F.length(v), F.lit(1))
    values = [c["kind"], F.length(v), size("0-9"), size("a-z") / n, size("A-Z") / n, size(r"\x20().\-"),
              F.size(F.array_distinct(F.split(v, ""))) / n, luhn(_digits(v)), _octets(v), address(v), ssn(v), iban(v),
              _joined(c), size("0-9a-f") / n,
              cue("pass|pwd|secret|token|key|akia"), cue("tel|phone|call|fax|mobil"), cue("card|iban|ssn|account|konto"),
              cue("mail|contact"), v.contains('"')]
    return F.struct(*[F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for x, name in zip(values, FEATURES)])


@dataclass(frozen=True)
class Booster:
    """Compiled trees as nested tuples ``(feature, threshold, left, right)`` or leaf values, and a threshold per kind."""

    trees: tuple = ()
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def score(self, f: Column) -> Column:
        def tree(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            name, threshold, left, right = node
            return F.when(f[name] <= threshold, tree(left)).otherwise(tree(right))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + tree(t)
        return 1 / (1 + F.exp(-2 * total))

    def threshold(self, kind: Column) -> Column:
        return F.get(F.array(*[F.lit(t) for t in self.thresholds]), kind)


def _compiled(node, weight: float):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction()) * weight
    split = node.split()
    return (FEATURES[split.featureIndex()], float(split.threshold()), _compiled(node.leftChild(), weight),
            _compiled(node.rightChild(), weight))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_CANDIDATES, trees: int = TREES, depth: int = DEPTH,
        precision: float = PRECISION, seed: int = 7) -> Booster:
    """Trees over a sample of the candidates of all documents; thresholds from all of a third of the candidates.

    The sample is drawn by hash from the distinct candidates with their context, an equal part for every kind and
    label, so copies and frequent kinds do not crowd others out.
    A candidate is a positive example if the check of its fixed format holds, and so is what a generator proposes if it
    certainly is of its kind: an address once its signs are put back, a phone beside a cue, a number that passes its
    check, a key of known form. Formats that fail their check and what certainly is something else are negative ones;
    candidates of which neither is known are left out here and judged by the trees alone. The third of
    all candidates that the sample leaves out calibrates, copies counted: for every kind the lowest score above which
    the share of positives is at least ``precision``. A kind without a positive in that third is never added, nor is
    any without both labels in the sample.
    """
    proposed = docs.select(F.explode(candidates(F.col(text))).alias("c")).filter("c.sure is not null")
    # Sizes, sample and thresholds read what the patterns find once.
    each = stored(proposed.select(features(F.col("c")).alias("f"), "c.kind", F.col("c.sure").cast("double").alias("label"),
                                  F.xxhash64("c.value", "c.before").alias("h")))
    held = F.pmod("h", F.lit(3)) == 0
    sizes = each.filter(~held).groupBy("kind", "label").agg(F.approx_count_distinct("h").alias("n")).collect()
    part = sample / (2 * len(KINDS))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), min(1.0, part / max(r["n"], 1))).otherwise(share)
    # A second hash draws, as the first one has chosen the third.
    drawn = each.filter(~held & (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share * (1 << 30)))
    rows = stored(drawn.groupBy("kind", "label", "h").agg(F.min("f").alias("f")).repartition(1).sortWithinPartitions("h", "kind", "label"))
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.select("f.*", "label")).select("features", "label")
    if table.select("label").distinct().count() < 2:
        drop_stored(each, rows)
        return Booster()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=64, minInstancesPerNode=3).fit(table)
    booster = Booster(tuple(_compiled(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights)))
    binned = each.filter(held).select(
        "kind", "label", F.floor(let(F.col("f"), booster.score) * BINS).cast("int").alias("bin"))
    counts = {(r["kind"], r["bin"]): (r["p"], r["n"]) for r in
              binned.groupBy("kind", "bin").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()}
    drop_stored(each, rows)
    thresholds = []
    for kind in range(len(KINDS)):
        best, p, n = 2.0, 0.0, 0
        for b in range(BINS, -1, -1):
            dp, dn = counts.get((kind, b), (0.0, 0))
            p, n = p + dp, n + dn
            if dn and p and p >= precision * n:
                best = b / BINS
        thresholds.append(best)
    return Booster(booster.trees, tuple(thresholds))


def find(docs: DataFrame, booster: Booster, text: str = "text") -> DataFrame:
    """``(doc, spans)`` for every row: the whole row, and its spans ``(kind, start, end, base, score)``, sorted.

    Positions are code points of the whole text, the end exclusive; null and empty texts have no spans. Base
    spans are always there; a candidate is added where its score reaches its kind's threshold and it overlaps
    neither a base span nor a candidate of a higher score that overlaps no base span (of equals the first one counts).
    Spans meet in sorted families, so that time grows with their number times its logarithm, however many a text has.
    """
    def spans(cs: Column) -> Column:
        def scored(c: Column, score: Column) -> Column:
            return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"),
                            score.alias("score"), c["source"].alias("source"))

        base = F.transform(F.filter(cs, lambda c: c["base"]), lambda c: scored(c, F.lit(1.0)))
        other = F.transform(F.filter(cs, lambda c: ~c["base"]), lambda c: scored(c, let(features(c), booster.score)))

        def better(y: Column, x: Column) -> Column:
            return (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (
                F.struct(y["start"], y["kind"], y["end"]) < F.struct(x["start"], x["kind"], x["end"])))

        def free(b: Column, o: Column) -> Column:
            above = F.filter(o, lambda x: x["score"] >= booster.threshold(x["kind"]))
            return let(families(b), lambda fs: F.filter(above, lambda x: ~F.exists(
                fs, lambda f: F.size(overlapping(f, x)) > 0)))

        def best(o: Column) -> Column:
            return let(families(o), lambda fs: F.filter(o, lambda x: ~F.exists(
                fs, lambda f: F.exists(overlapping(f, x), lambda y: better(y, x)))))

        all_of = let(base, lambda b: F.concat(b, let(free(b, other), best)))
        return F.sort_array(F.transform(all_of, lambda c: c.dropFields("source")))

    empty = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,score:double>>")
    return docs.select(whole_row(docs), let(candidates(F.col(text)), lambda cs: F.when(
        F.size(cs) > 0, spans(cs)).otherwise(empty)).alias("spans"))


def redact(docs: DataFrame, booster: Booster | None = None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    The other columns stay as they are, but for a column of that name with the text's length. Null and empty texts stay,
    repeated rows come back as often, an empty table gives an empty one. Time grows with the length of a text and, for
    its spans, with their number times its logarithm.
    """
    found = find(docs, booster or fit(docs, text), text)
    by_start = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    # A span that starts inside an earlier one is joined to it: what is cut out runs to the furthest end so far.
    furthest = running(F.transform("ordered", lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    cuts = F.transform("ordered", lambda s, i: F.struct(
        s["start"].alias("start"), F.get("furthest", i).alias("end"), s["kind"].alias("kind"),
        F.coalesce(F.get("furthest", i - 1), F.lit(0)).alias("before")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col(f"doc.`{text}`")

    def replaced(cut: Callable[[Column, Column], Column]) -> Column:
        pieces = F.transform("cuts", lambda c: F.when(c["start"] >= c["before"], F.concat(
            cut(c["before"], c["start"]), F.get(names, c["kind"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(F.element_at("cuts", -1)["end"], F.length(body)))

    cleaned = F.when(F.size("spans") == 0, body).otherwise(cut_out(body, replaced))
    out = found.withColumn("ordered", by_start).withColumn("furthest", furthest).withColumn("cuts", cuts)
    out = out.withColumn("doc", F.col("doc").withField(f"`{text}`", cleaned))
    if length and length in docs.columns:
        out = out.withColumn("doc", F.col("doc").withField(f"`{length}`", F.length(body).cast(docs.schema[length].dataType)))
    return unpacked(out).select(*[F.col(f"`{c}`") for c in docs.columns])


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


@query("op3_boosted_personal_data")
def _op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return find(docs, fit(docs)).withColumn("base", base).select(
        "doc.doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))
