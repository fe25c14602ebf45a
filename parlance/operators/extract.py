"""Mentions from text: lexicon n-grams, patterns, denials, retyping rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import canonicalize_text, norm_key, normalize_ws, word_tokens
from parlance.operators.patterns import pattern_hits


def _grams(tokens: Column, max_n: int) -> Column:
    """All 1..max_n-grams of a token array as struct(start, n, gram); start counts from 0."""
    def of_size(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("gram")))
    return F.flatten(F.array(*[of_size(n) for n in range(1, max_n + 1)]))


def lexicon_extract(
    texts: DataFrame, vocab: DataFrame, keys: list[str], max_n: int = 4, context: int = 0, col: str = "text",
) -> DataFrame:
    """Vocabulary labels found in texts at word boundaries.

    ``vocab`` has label, entity_type. Texts become word n-grams which meet the labels in one
    equality join: its cost follows the text, not text times vocabulary. Spark broadcasts
    the vocabulary when its measured size allows and shuffles both sides otherwise.
    ``context`` adds that many words before and after each hit; they are listed for hits only.
    """
    labels = vocab.select(
        F.array_join(word_tokens(F.lower("label")), " ").alias("gram"), "label", F.col("entity_type").alias("type"),
    ).filter(F.col("gram") != "").distinct()
    tokens = F.col("_tokens")
    rows = texts.select(*keys, word_tokens(F.lower(col)).alias("_tokens"))
    # Each word beside its neighbours: one generated row per word, grams by plain concatenation.
    nulls = lambda k: F.array_repeat(F.lit(None).cast("string"), k)
    shifted = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0))).alias(f"w{k}") for k in range(max_n + context)]
    earlier = [F.concat(nulls(k), F.slice(tokens, 1, F.greatest(F.size(tokens) - k, F.lit(0)))).alias(f"b{k}") for k in range(context, 0, -1)]
    words = rows.filter(F.size(tokens) > 0).select(*keys, F.posexplode(F.arrays_zip(*shifted, *earlier)).alias("start", "_w")).filter(
        F.col("_w.w0").isNotNull())
    grams, gram = [], None
    for k in range(max_n):
        word = F.col(f"_w.w{k}")
        gram = word if gram is None else F.concat(gram, F.lit(" "), word)
        grams.append(F.struct(F.col("start"), F.lit(k + 1).alias("n"), gram.alias("gram")))
    beside = ["_w"] if context else []
    spans = words.select(*keys, *beside, F.explode(F.array(*grams)).alias("_g"))
    found = spans.select(*keys, *beside, "_g.*").join(labels, "gram")
    there = lambda c: F.filter(c, lambda w: w.isNotNull())
    extra = [] if not context else [
        there(F.array(*[F.col(f"_w.b{k}") for k in range(context, 0, -1)])).alias("before"),
        there(F.slice(F.array(*[F.col(f"_w.w{k}") for k in range(max_n + context)]), F.col("n") + 1, context)).alias("after")]
    return found.select(*keys, "start", "n", "label", "type", F.col("gram").alias("quote"), *extra)


def longest_match(mentions: DataFrame, keys: list[str], policy: str = "longest") -> DataFrame:
    """Resolve nested mentions: keep the longest ('longest') or the shortest ('shortest').

    A mention of n words has fewer than n²/2 proper sub-spans; those are listed and matched
    by equality, so mentions of one text are never compared pairwise.
    """
    span = [*keys, "start", "n"]
    subs = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.transform(
        F.sequence(F.lit(0), F.col("n") - k), lambda d: F.struct(
            (F.col("start") + d).alias("sub_start"), k.alias("sub_n")))))
    long = mentions.filter(F.col("n") > 1).select(*span).distinct().select("*", F.inline(subs))
    if policy == "longest":
        inner = long.select(*keys, F.col("sub_start").alias("start"), F.col("sub_n").alias("n")).distinct()
        return mentions.join(inner, span, "left_anti")
    present = mentions.select(*keys, F.col("start").alias("sub_start"), F.col("n").alias("sub_n")).distinct()
    outer = long.join(present, [*keys, "sub_start", "sub_n"], "left_semi").select(*span).distinct()
    return mentions.join(outer, span, "left_anti")


def pattern_extract(
    transcripts: DataFrame, patterns: list[tuple] | DataFrame, present: DataFrame | None = None,
    aliases: dict[str, str] | None = None, compat: bool = False, keys: tuple[str, ...] = ("res_id",),
    bracketed: bool = True, reach: int = 1,
) -> DataFrame:
    """One node per transcript and pattern (type, name, regex, terms) that is proven.

    ``transcripts`` are whole texts, or turns as rows, told by their column ``seq``; any number of patterns, as a list
    or a table with a column ``rule`` (see ``pattern_hits``). ``present`` nodes are not found again.
    """
    keys = list(keys)
    hits = pattern_hits(transcripts, patterns, keys, compat, bracketed, reach)
    nodes = hits.select(
        *keys, F.concat(F.lit("X_"), F.col("rule").cast("string")).alias("id"),
        canonicalize_text(F.col("name"), aliases).alias("text"), "type",
        "evidence", "turn_id", "via", F.col("rule").cast("bigint").alias("ord"))
    if present is None:
        return nodes
    have = present.select("res_id", canonicalize_text(F.col("text"), aliases).alias("text"),
                          F.upper("type").alias("type")).distinct()
    return nodes.join(have, ["res_id", "text", "type"], "left_anti").select(*nodes.columns)


def fallback_audit(hits: DataFrame) -> DataFrame:
    """How many hits per pattern rest on a fallback term alone."""
    return hits.groupBy("type", "text").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("via") == "fallback").alias("fallback_hits")
    ).withColumn("fallback_share", F.round(F.col("fallback_hits") / F.col("hits"), 4))


def negated_findings(
    turns: DataFrame, vocab: DataFrame, negative: str, max_n: int = 4, min_listed: int = 2,
    asker: str = "D", answerer: str = "P",
) -> DataFrame:
    """Findings a question lists, judged by the answer in the next turn.

    An answer that affirms some of the listed findings denies the others; one that affirms
    none denies all if it is negative. The next turn is found by joining on ``seq + 1``.
    """
    asked = lexicon_extract(turns.filter(F.col("speaker") == asker), vocab, ["res_id", "seq"], max_n).select(
        "res_id", (F.col("seq") + 1).alias("seq"), "label", "type").distinct()
    answers = turns.filter(F.col("speaker") == answerer)
    said = lexicon_extract(answers, vocab, ["res_id", "seq"], max_n).select(
        "res_id", "seq", "label", "type").distinct().withColumn("affirmed", F.lit(1))
    listed = asked.join(
        answers.select("res_id", "seq", "turn_id", F.lower("text").rlike(negative).alias("negative")),
        ["res_id", "seq"]).join(said, ["res_id", "seq", "label", "type"], "left")
    per_answer = listed.groupBy("res_id", "seq").agg(
        F.count(F.lit(1)).alias("n_listed"), F.count("affirmed").alias("n_affirmed"))
    judged = listed.join(per_answer, ["res_id", "seq"]).filter(
        (F.col("n_listed") >= min_listed) & (F.col("negative") | (F.col("n_affirmed") > 0)))
    text = F.when(F.col("affirmed") == 1, F.col("label")).otherwise(F.concat(F.lit("absent "), "label"))
    return judged.select("res_id", "seq", "turn_id", "label", "type", text.alias("text"),
                         F.col("affirmed").isNull().alias("denied"))


def exam_denials(
    texts: DataFrame, vocab: DataFrame, cues: list[str], keys: list[str], max_n: int = 4, col: str = "text",
) -> DataFrame:
    """``absent X`` wherever a cue such as "no {x}" surrounds a vocabulary label.

    Cues and labels are combined into a phrase vocabulary, which one n-gram join then finds.
    """
    phrases = vocab.select(F.col("label"), "entity_type", F.explode(F.array(*[F.lit(c) for c in cues])).alias("_cue"))
    table = phrases.select(
        F.replace("_cue", F.lit("{x}"), F.col("label")).alias("label"), "entity_type",
        F.concat(F.lit("absent "), "label").alias("text"))
    span = max_n + max(len(c.split()) - 1 for c in cues)
    found = lexicon_extract(texts, table, keys, span, col=col)
    names = table.select("label", F.col("entity_type").alias("type"), "text").distinct()
    return found.join(names, ["label", "type"]).select(*keys, "start", "text", "type", "quote")


def outcome_retype(
    mentions: DataFrame, anchors: list[str], test_types: tuple[str, ...] = ("PROCEDURE",), result: str = "LAB_RESULT",
) -> DataFrame:
    """A test name followed by its outcome is one result; a lone outcome is dropped.

    Needs mentions extracted with ``context``; a narrow transformation.
    """
    following = F.try_element_at(F.col("after"), F.lit(1))
    outcome = F.coalesce(following.isin(anchors) | following.rlike(r"^\p{N}"), F.lit(False))
    is_result = F.col("type").isin(list(test_types)) & outcome
    lone = (F.col("type") == result) & (F.col("quote").isin(anchors) | F.col("quote").rlike(r"^\p{N}+$"))
    return mentions.filter(~lone).withColumns({
        "text": F.when(is_result, F.concat_ws(" ", "label", following)).otherwise(F.col("label")),
        "type": F.when(is_result, F.lit(result)).otherwise(F.col("type")),
    })


def history_retype(
    mentions: DataFrame, cues: list[str], relatives: list[str], history: str = "MEDICAL_HISTORY",
) -> DataFrame:
    """Mentions framed as past or as a relative's become history, the framing kept.

    Needs mentions extracted with ``context``; a narrow transformation.
    """
    before = F.col("before")
    spoken = F.concat(F.lit(" "), F.array_join(before, " "))
    cue = F.lit(None).cast("string")
    for phrase in sorted(cues, key=len):
        cue = F.coalesce(F.when(spoken.endswith(" " + phrase), F.lit(phrase)), cue)
    relative = F.arrays_overlap(before, F.array(*[F.lit(r) for r in relatives]))
    framed = (F.when(relative, F.concat(F.lit("family history of "), "label"))
              .when(cue.isNotNull(), F.concat_ws(" ", cue, F.col("label"))))
    return mentions.withColumns({
        "text": F.coalesce(framed, F.col("label")),
        "type": F.when(framed.isNotNull(), F.lit(history)).otherwise(F.col("type")),
    })


def bucket_assign(mentions: DataFrame, vocab: DataFrame, max_n: int = 4) -> DataFrame:
    """matched: the text is a label; fine_grained: it properly contains one; else other.

    ``coarse_candidate`` is the longest contained label (first alphabetically on a tie).
    """
    labels = vocab.select(norm_key(F.col("label")).alias("_gram"), F.col("label").alias("_label")).groupBy(
        "_gram").agg(F.min("_label").alias("_label"))
    texts = mentions.select("text").distinct().withColumn("_key", normalize_ws(F.col("text")))
    exact = texts.join(labels, texts["_key"] == labels["_gram"]).select("text", F.lit("matched").alias("bucket"))
    tokens = F.split("_key", " ")
    parts = texts.select("text", "_key", F.explode(_grams(tokens, max_n)).alias("_g")).select(
        "text", F.col("_g.gram").alias("_gram"), F.col("_g.n").alias("_n")
    ).filter(F.col("_gram") != normalize_ws(F.col("text")))
    finer = parts.join(labels, "_gram").groupBy("text").agg(
        F.min(F.struct((-F.col("_n")).alias("_n"), "_label"))["_label"].alias("coarse_candidate"))
    placed = texts.select("text").join(exact, "text", "left").join(finer, "text", "left").select(
        "text",
        F.coalesce("bucket", F.when(F.col("coarse_candidate").isNotNull(), "fine_grained"), F.lit("other")).alias("bucket"),
        F.when(F.col("bucket").isNull(), F.col("coarse_candidate")).alias("coarse_candidate"))
    return mentions.join(placed, "text")
