"""Predicates on nodes and edges. All are narrow or equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import canonicalize_text, normalize_ws, strip_ws, word_tokens
from parlance.operators.patterns import turn_windows
from parlance.operators.turns import turn_line
from parlance.runtime import MAX_RULE_ROWS, rule_table, stored

# Characters of the quotes that are judged at once beside their text.
QUOTED = 1 << 20


def valid_type_filter(df: DataFrame, types: list[str], col: str = "type") -> DataFrame:
    """Rows whose trimmed, upper-cased type is known; the type is stored in that form."""
    return df.withColumn(col, F.upper(strip_ws(F.coalesce(F.col(col), F.lit(""))))).filter(F.col(col).isin(types))


def low_value_filter(nodes: DataFrame, regex: str, aliases: dict[str, str] | None = None) -> DataFrame:
    return nodes.filter(~canonicalize_text(F.col("text"), aliases).rlike(regex))


def keep_ids_filter(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates named in ``decisions`` (res_id, id); a transcript without any keeps all."""
    named = decisions.select("res_id", "id").distinct()
    kept = candidates.join(named, ["res_id", "id"], "left_semi")
    undecided = candidates.join(named.select("res_id").distinct(), "res_id", "left_anti")
    return kept.unionByName(undecided)


def grounding_filter(
    df: DataFrame, transcripts: DataFrame, min_share: float = 0.6, short: int = 3, bracketed: bool = True, reach: int = 1,
) -> DataFrame:
    """Drop rows whose non-empty evidence the transcript does not support.

    Every distinct (transcript, quote) is judged once; a transcript may come in parts, or as turns (see
    ``supported_quotes``).
    """
    return keep_supported(df, supported_quotes(df.select("res_id", "evidence"), transcripts, min_share, short, bracketed, reach))


def keep_supported(df: DataFrame, supported: DataFrame) -> DataFrame:
    """The rows without evidence and those whose quote is among ``supported``."""
    tagged = df.withColumn("_ev", F.coalesce(normalize_ws(F.col("evidence")), F.lit("")))
    return tagged.join(supported, ["res_id", "_ev"], "left").filter(
        (F.col("_ev") == "") | F.col("_ok")).select(*df.columns)


def supported_quotes(
    quotes: DataFrame, transcripts: DataFrame, min_share: float = 0.6, short: int = 3, bracketed: bool = True, reach: int = 1,
) -> DataFrame:
    """The distinct quotes (res_id, evidence) that their transcript supports, normalised as ``_ev``.

    ``transcripts``: whole texts, in one part or several, or turns as rows (with a column ``seq``), where a verbatim
    quote may cross ``reach`` turn borders. Short quotes always pass. A text in one part is judged beside its quotes, a
    bounded batch of them at a time (see ``_beside_text``). Quotes of other transcripts meet the words of theirs in one
    equality join; the few that too few words support may still be verbatim, if their first or last word is a part of
    one. Their inner words are whole, so they meet the texts on the first two inner words, and only texts that hold
    both side by side are compared with them: no text is ever sent to each of its quotes.
    """
    found = stored(quotes.select("res_id", normalize_ws(F.col("evidence")).alias("_ev")).filter(F.col("_ev") != "").distinct().withColumns({
        "_size": F.size(word_tokens(F.col("_ev"))), "_quote": F.monotonically_increasing_id()}))
    # Rows of words carry the number of their quote, never its text.
    easy = found.filter(F.col("_size") <= short).select("_quote")
    open_ = found.filter(F.col("_size") > short).drop("_size")
    rows = "seq" in transcripts.columns
    judged = easy
    if not rows:
        several = transcripts.groupBy("res_id").count().filter("count > 1").select("res_id")
        if several.isEmpty():
            judged, open_ = easy.unionByName(_beside_text(open_, transcripts, min_share)), None
        else:
            several = stored(several)
            judged = easy.unionByName(_beside_text(open_, transcripts.join(several, "res_id", "left_anti"), min_share))
            open_, transcripts = (df.join(several, "res_id", "left_semi") for df in (open_, transcripts))
    if open_ is not None:
        judged = judged.unionByName(_by_words(open_, transcripts, rows, min_share, bracketed, reach))
    return found.join(judged, "_quote").select("res_id", "_ev", F.lit(True).alias("_ok"))


def _beside_text(quotes: DataFrame, texts: DataFrame, min_share: float) -> DataFrame:
    """``_quote`` of the supported ones, each text being one row: it meets its quotes in batches of about QUOTED
    characters, so that text and quotes are shuffled whole and never as words."""
    # Few texts have more than one batch, if any: this table is small enough for Spark to broadcast.
    sizes = stored(quotes.groupBy("res_id").agg(F.ceil(F.sum(F.length("_ev")) / QUOTED).cast("int").alias("_n")).filter("_n > 1"))
    n = F.coalesce("_n", F.lit(1))
    asked = quotes.join(sizes, "res_id", "left").groupBy("res_id", F.pmod(F.xxhash64("_ev"), n).cast("int").alias("_batch")).agg(
        F.collect_list(F.struct("_quote", "_ev")).alias("_asked"))
    told = texts.filter(F.col("text").isNotNull()).join(sizes, "res_id", "left").select(
        "res_id", normalize_ws(F.col("text")).alias("_tr"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_batch"))
    # Words are taken where text and quotes have met, so that they are not shuffled beside them.
    words = lambda text: F.array_join(F.array_distinct(word_tokens(text)), " ")
    said = F.transform("_asked", lambda q: F.struct(
        q["_quote"].alias("_quote"), q["_ev"].alias("_ev"), F.array_join(word_tokens(q["_ev"]), " ").alias("_words")))

    def judge(asked: list, known: str, text: str) -> list[int]:
        words, good = set(known.split(" ")), []
        for q in asked:
            own = q["_words"].split(" ")
            hits = sum(map(words.__contains__, own))
            # A verbatim quote has at most two words that are no whole words of the text.
            if hits / len(own) >= min_share or hits >= len(own) - 2 and q["_ev"] in text:
                good.append(q["_quote"])
        return good

    udf = F.udf(judge, "array<bigint>", useArrow=True)
    return asked.join(told, ["res_id", "_batch"]).select(F.explode(udf(said, words(F.col("_tr")), "_tr")).alias("_quote"))


def _by_words(open_: DataFrame, transcripts: DataFrame, rows: bool, min_share: float, bracketed: bool, reach: int) -> DataFrame:
    """``_quote`` of the supported ones, whatever the number and length of a transcript's parts."""
    open_ = open_.withColumn("_words", word_tokens(F.col("_ev")))
    lines = transcripts.select("res_id", (turn_line(bracketed) if rows else F.col("text")).alias("text"))
    sought = open_.select("res_id").distinct()
    words = lines.join(sought, "res_id", "left_semi").select(
        "res_id", F.explode(F.array_distinct(word_tokens(F.lower("text")))).alias("_word")).distinct()
    counted = open_.select("res_id", "_quote", F.explode("_words").alias("_word")).groupBy("res_id", "_quote", "_word").count()
    shared = stored(counted.join(words.withColumn("_known", F.lit(1)), ["res_id", "_word"], "left").groupBy("_quote").agg(
        F.sum(F.col("count") * F.coalesce("_known", F.lit(0))).alias("_hits"), F.sum("count").alias("_all")))
    enough = F.col("_hits") / F.col("_all") >= min_share
    # A verbatim quote has at most two words that are no whole words of the transcript.
    rest = open_.join(shared.filter(~enough & (F.col("_hits") >= F.col("_all") - 2)).select("_quote"), "_quote")
    windows = turn_windows(transcripts, bracketed, reach).select("res_id", "seq", "text") if rows else transcripts.select(
        "res_id", F.xxhash64("text").alias("seq"), "text")
    places = windows.join(rest.select("res_id").distinct(), "res_id", "left_semi").select(
        "res_id", "seq", normalize_ws(F.col("text")).alias("_tr"))
    # The empty pair, which every text has, is for quotes of fewer than four words.
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    inner = F.when(F.size("_words") > 3, F.concat_ws(" ", F.get("_words", F.lit(1)), F.get("_words", F.lit(2)))).otherwise("")
    keyed = rest.select("res_id", "_quote", "_ev", inner.alias("_pair"))
    held = places.select("res_id", "seq", F.explode(F.array_append(F.array_distinct(pairs(word_tokens(F.col("_tr")))), F.lit(""))).alias("_pair"))
    met = held.join(keyed, ["res_id", "_pair"]).select("res_id", "seq", "_quote", "_ev")
    verbatim = met.join(places, ["res_id", "seq"]).filter(F.contains("_tr", "_ev")).select("_quote").distinct()
    return shared.filter(enough).select("_quote").unionByName(verbatim)


def with_endpoints(edges: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with src_text, src_type, tgt_text, tgt_type."""
    src = nodes.select("res_id", F.col("id").alias("source_id"),
                       F.col("text").alias("src_text"), F.col("type").alias("src_type"))
    tgt = nodes.select("res_id", F.col("id").alias("target_id"),
                       F.col("text").alias("tgt_text"), F.col("type").alias("tgt_type"))
    return edges.join(src, ["res_id", "source_id"], how).join(tgt, ["res_id", "target_id"], how)


def edge_validity_filter(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges of a known type between two different, existing nodes."""
    typed = edges.withColumn("type", F.upper(F.coalesce("type", F.lit("")))).filter(
        F.col("type").isin(types) & (F.col("source_id") != F.col("target_id")))
    ids = nodes.select("res_id", "id").distinct()
    return (typed
            .join(ids.withColumnRenamed("id", "source_id"), ["res_id", "source_id"], "left_semi")
            .join(ids.withColumnRenamed("id", "target_id"), ["res_id", "target_id"], "left_semi"))


def type_pair_filter(edges: DataFrame, nodes: DataFrame, allowed: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Edges whose (relation, source type, target type) is admissible."""
    table = rule_table(edges.sparkSession, allowed, ["type", "src_type", "tgt_type"])
    # Relations that no rule names are dropped before their endpoints are fetched.
    if not isinstance(allowed, DataFrame) and len(allowed) <= MAX_RULE_ROWS:
        edges = edges.filter(F.col("type").isin(sorted({r[0] for r in allowed if r[0] is not None})))
    return with_endpoints(edges, nodes).join(table, ["type", "src_type", "tgt_type"], "left_semi")


def is_denied(text: Column) -> Column:
    return text.startswith("absent ") | text.startswith("no ")


def negation_blocks_edges(edges: DataFrame, nodes: DataFrame, checks: list[tuple[str, bool, bool]]) -> DataFrame:
    """Drop edges from or to denied findings where the relation forbids them."""
    src_rule = [t for t, src, _ in checks if src]
    tgt_rule = [t for t, _, tgt in checks if tgt]
    blocked = ((F.col("type").isin(src_rule) & is_denied(F.col("src_text")))
               | (F.col("type").isin(tgt_rule) & is_denied(F.col("tgt_text"))))
    return with_endpoints(edges, nodes).filter(~blocked)


def label_verification(items: DataFrame, entities: DataFrame) -> DataFrame:
    """Demote a "matched" item to "other" unless its text equals an entity's exactly."""
    known = entities.select("res_id", "text").distinct().withColumn("_known", F.lit(True))
    checked = items.join(known, ["res_id", "text"], "left")
    bucket = F.when((F.col("bucket") == "matched") & F.col("_known").isNull(), "other").otherwise(F.col("bucket"))
    return checked.withColumn("bucket", bucket).drop("_known")


def speaker_guard(edges: DataFrame, turns: DataFrame, types: list[str], speaker: str = "D") -> DataFrame:
    """Edges of ``types`` must cite a turn of ``speaker``; other types pass."""
    spoken = turns.filter(F.col("speaker") == speaker).select("res_id", "turn_id").distinct()
    guarded = edges.filter(F.col("type").isin(types)).join(spoken, ["res_id", "turn_id"], "left_semi")
    return guarded.select(*edges.columns).unionByName(edges.filter(~F.col("type").isin(types)))


def stop_mentions(nodes: DataFrame, stop: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Drop (type, text) pairs listed as not being findings at all."""
    table = rule_table(nodes.sparkSession, stop, ["type", "_stop"])
    return nodes.withColumn("_stop", F.lower("text")).join(
        table, ["type", "_stop"], "left_anti").select(*nodes.columns)
