"""Patterns on rows: many at once through an index of the literals they need, and on turns instead of whole texts."""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import find_evidence, find_in_window
from parlance.operators.turns import turn_line
from parlance.runtime import stored

# Up to this many patterns are tried on every text; more are met through their literals.
FEW_PATTERNS = 64
# Characters of a literal that the index is keyed by.
GRAM = 3
_PATTERN = ["rule", "type", "name", "regex", "terms"]


def literals(regex: str) -> list[str] | None:
    """Lower-case ASCII texts of GRAM or more characters, one of which every match contains; None if none is known.

    Of a sequence the part with the fewest, then the longest, is taken; of alternatives all that their branches need.
    """
    def of(items) -> list[str] | None:
        best: list[str] | None = None
        run = ""

        def offer(found: list[str] | None) -> None:
            nonlocal best
            if found and (best is None or (len(found), -min(map(len, found))) < (len(best), -min(map(len, best)))):
                best = found

        for op, arg in [*items, (None, None)]:
            # Other than ASCII, one letter may match letters of another length.
            if op is _parser.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            offer([run] if len(run) >= GRAM else None)
            run = ""
            if op is _parser.SUBPATTERN:
                offer(of(arg[3]))
            elif op is _parser.BRANCH:
                parts = [of(branch) for branch in arg[1]]
                offer(sorted({x for part in parts for x in part}) if all(parts) else None)
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and arg[0] > 0:
                offer(of(arg[2]))
        return best

    try:
        # Classes that only Java knows stand for some letter.
        return of(_parser.parse(re.sub(r"\\[pPx]\{[^}]*\}", r"\\w", regex)))
    except (_parser.error, OverflowError, RecursionError):
        # Another engine's syntax.
        return None


def needed(regex: str, terms: list[str] | None) -> list[str] | None:
    """What a text must contain one of for the pattern or a term to be found; None: the pattern is tried everywhere."""
    found = literals(regex)
    words = [t.lower() for t in terms or [] if t]
    if found is None or any(not t.isascii() or len(t) < GRAM for t in words):
        return None
    return sorted({*found, *words})


def pattern_table(spark, patterns: list[tuple] | DataFrame) -> tuple[list[tuple] | None, DataFrame | None]:
    """Patterns (type, name, regex, terms), numbered by their place or by a column ``rule``: as a list where they are
    few, else as a table."""
    if isinstance(patterns, DataFrame):
        if "rule" not in patterns.columns:
            raise ValueError("a table of patterns needs a column rule: its rows have no places")
        few = patterns.select(*_PATTERN).limit(FEW_PATTERNS + 1).collect()
        return ([tuple(r) for r in few], None) if len(few) <= FEW_PATTERNS else (None, patterns.select(*_PATTERN))
    rows = [(i, *p[:3], list(p[3] or [])) for i, p in enumerate(patterns)]
    if len(rows) <= FEW_PATTERNS:
        return rows, None
    return None, spark.createDataFrame(rows, "rule bigint, type string, name string, regex string, terms array<string>")


def fold(text: Column) -> Column:
    """Letters that match one another without regard to case become equal."""
    return F.lower(F.upper(text))


def with_patterns(texts: DataFrame, patterns: list[tuple] | DataFrame, keys: list[str]) -> DataFrame:
    """``texts`` (keys, text, ...) times the patterns that may be found in them, as a struct ``p``.

    Few patterns are a literal array exploded in the scan stage. Of many, each is known by a literal it needs, and each
    literal by its gram that fewest literals have; the distinct grams of a text meet them in one equality join, so the
    cost follows the text and the literals found in it. Keys must tell the rows apart.
    """
    spark = texts.sparkSession
    few, table = pattern_table(spark, patterns)
    if few is not None:
        def lit(value):
            return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, (list, tuple)) else F.lit(value)

        array = F.array(*[F.struct(*[lit(v if n != "terms" else v or []).alias(n) for n, v in zip(_PATTERN, row)]) for row in few])
        return texts.withColumn("p", F.explode(array)) if few else texts.limit(0).withColumn(
            "p", F.struct(*[F.lit(None).cast(t).alias(n) for n, t in zip(_PATTERN, ["bigint", "string", "string", "string", "array<string>"])]))
    need = F.udf(needed, "array<string>", useArrow=False).asNondeterministic()
    # A pattern without a literal needs the empty one, whose gram every text has.
    known = table.withColumn("_literal", F.explode(F.coalesce(need("regex", "terms"), F.array(F.lit("")))))
    literal = stored(known.select("rule", "_literal", F.explode(_with_empty(_grams(F.col("_literal")))).alias("_gram")).filter(
        (F.col("_gram") != "") | (F.col("_literal") == "")))
    common = literal.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    index = literal.join(common, "_gram").groupBy("rule", "_literal").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    grams = texts.select(*keys, F.explode(_with_empty(_grams(fold(F.col("text"))))).alias("_gram"))
    met = grams.join(index, "_gram").select(*keys, "rule", "_literal")
    found = texts.join(met, keys).filter(F.contains(fold(F.col("text")), F.col("_literal")))
    return found.join(table.select(F.struct(*_PATTERN).alias("p"), "rule"), "rule").select(*texts.columns, "p")


def _with_empty(grams: Column) -> Column:
    return F.array_append(F.array_distinct(grams), F.lit(""))


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1))


def turn_windows(turns: DataFrame, bracketed: bool = True, reach: int = 1) -> DataFrame:
    """(res_id, seq, text, first, last): every turn's line between those of ``reach`` turns before and behind it, and
    where its own begins and ends. Lines are sent to their neighbours by number, never gathered by conversation."""
    lines = turns.select("res_id", "seq", turn_line(bracketed).alias("line"))
    places = range(-reach, reach + 1)
    sent = lines.select("res_id", F.explode(F.array(*[
        F.struct((F.col("seq") - d).alias("seq"), F.lit(d).alias("at"), "line") for d in places])).alias("_s")).select("res_id", "_s.*")
    name = lambda d: f"_l{d + reach}"
    met = sent.groupBy("res_id", "seq").agg(*[F.max(F.when(F.col("at") == d, F.col("line"))).alias(name(d)) for d in places])
    before = F.concat(*[F.coalesce(F.concat(F.col(name(d)), F.lit("\n")), F.lit("")) for d in places if d < 0], F.lit(""))
    after = F.concat(*[F.coalesce(F.concat(F.lit("\n"), F.col(name(d))), F.lit("")) for d in places if d > 0], F.lit(""))
    return met.filter(F.col(name(0)).isNotNull()).select(
        "res_id", "seq", F.concat(before, name(0), after).alias("text"),
        (F.length(before) + 1).alias("first"), (F.length(before) + F.length(name(0)) + 1).alias("last"))


def pattern_hits(source: DataFrame, patterns: list[tuple] | DataFrame, keys: list[str], compat: bool = False,
                 bracketed: bool = True, reach: int = 1) -> DataFrame:
    """(keys, rule, type, name, evidence, turn_id, via): the first proof of each pattern in each text or conversation.

    ``source`` holds whole texts, or turns as rows (res_id, seq, turn_id, speaker, text). On turns, each searches its
    own line with its neighbours around it, and the first hit of a conversation is a minimum with map-side combining: a
    conversation of any length is never one value. A match may cross ``reach`` turn borders; patterns tied to the start
    or end of a whole text, and the windows of ``compat``, are for whole texts only.
    """
    if "seq" not in source.columns:
        hits = with_patterns(source.select(*keys, "text"), patterns, keys).select(
            *keys, "p.rule", "p.type", "p.name",
            find_evidence(F.col("text"), F.col("p.regex"), F.col("p.terms"), compat=compat).alias("hit")).filter(
            F.col("hit.evidence") != "")
        found = hits.select(*keys, "rule", "type", "name", "hit.*")
        # A pattern may have been met through several literals.
        few = not isinstance(patterns, DataFrame) and len(patterns) <= FEW_PATTERNS
        return found if few else found.dropDuplicates([*keys, "rule"])
    if compat:
        raise ValueError("windows across turns need whole texts")
    windows = turn_windows(source, bracketed, reach)
    hit = find_in_window(F.col("text"), F.col("p.regex"), F.col("p.terms"), F.col("first"), F.col("last"))
    rows = with_patterns(windows, patterns, ["res_id", "seq"]).select("res_id", "seq", "p.rule", "p.type", "p.name", hit.alias("h")).filter(
        "h is not null")
    first = rows.groupBy("res_id", "rule", "type", "name").agg(F.min(F.struct(
        "h.by", "h.term", "seq", "h.evidence", "h.turn_id", "h.via")).alias("h"))
    return first.filter(F.col("h.evidence") != "").select("res_id", "rule", "type", "name", "h.evidence", "h.turn_id", "h.via")
