"""Transcripts to speaker turns and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip_ws
from parlance.runtime import running_counts

# A turn starts at "[D-1]" (with an optional "D:") anywhere, or at "D-1:" on a new line.
_START = r"(?:\[([DP]-\d+)\]\s*(?:[DP]:\s*)?|(?m:^)([DP]-\d+):[ \t]*)"
_SEP, _END = "\x1e", "\x1f"


def segment_marked_turns(transcripts: DataFrame, keys: tuple[str, ...] = ("res_id",)) -> DataFrame:
    """(keys, pos, turn_id, speaker, text); a repeated turn id keeps its last text."""
    keys = list(keys)
    marked = F.regexp_replace("text", _START, f"{_SEP}$1$2{_END}")
    pieces = F.slice(F.split(marked, _SEP), 2, 1_000_000_000)
    rows = transcripts.select(*keys, F.posexplode(pieces).alias("pos", "_piece")).select(
        *keys, "pos",
        F.substring_index("_piece", _END, 1).alias("turn_id"),
        strip_ws(F.substring_index("_piece", _END, -1)).alias("text"),
    ).filter(F.col("text") != "")
    last = rows.groupBy(*keys, "turn_id").agg(
        F.min("pos").cast("bigint").alias("pos"), F.max_by("text", "pos").alias("text"))
    return last.select(*keys, "pos", "turn_id", F.substring("turn_id", 1, 1).alias("speaker"), "text")


def dialogue_to_turns(utterances: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Number utterances (res_id, pos, role, text) per speaker.

    ``roles`` maps a role to its speaker letter; other roles and blank texts are dropped.
    ``seq`` numbers the kept turns of a transcript without gaps, so that the next turn is
    found by an equality join instead of a window over the whole transcript.
    """
    table = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    kept = utterances.select(
        "res_id", F.col("pos").cast("bigint").alias("pos"),
        F.try_element_at(table, F.col("role")).alias("speaker"), strip_ws(F.col("text")).alias("text"),
    ).filter(F.col("speaker").isNotNull() & (F.col("text") != ""))
    letters = sorted(set(roles.values()))
    counts = {f"_n_{s}": F.col("speaker") == s for s in letters}
    numbered = running_counts(kept, ["res_id"], ["pos"], "pos", {"seq": None, **counts})
    own = F.coalesce(*[F.when(F.col("speaker") == s, F.col(f"_n_{s}")) for s in letters])
    return numbered.select(
        "res_id", "pos", "seq", F.concat_ws("-", "speaker", own).alias("turn_id"), "speaker", own.alias("n"), "text")


def split_dialogue(dialogues: DataFrame, role_names: list[str]) -> DataFrame:
    """``[doctor] ... [patient] ...`` strings (res_id, dialogue) to utterances."""
    marker = r"\[(" + "|".join(role_names) + r")\]\s*"
    pieces = F.slice(F.split(F.regexp_replace("dialogue", marker, f"{_SEP}$1{_END}"), _SEP), 2, 1_000_000_000)
    return dialogues.select("res_id", F.posexplode(pieces).alias("pos", "_piece")).select(
        "res_id", F.col("pos").cast("bigint").alias("pos"),
        F.substring_index("_piece", _END, 1).alias("role"), F.substring_index("_piece", _END, -1).alias("text"))


def turn_line(bracketed: bool = False) -> Column:
    """How a turn is written in a transcript."""
    if bracketed:
        return F.concat(F.lit("["), "turn_id", F.lit("] "), "speaker", F.lit(": "), "text")
    return F.concat_ws(": ", "turn_id", "text")


def render_transcript(turns: DataFrame, bracketed: bool = False) -> DataFrame:
    """(res_id, text): a transcript's turns joined by newlines, as one text.

    A transcript is one value here as it is one file elsewhere; patterns are found on turns as rows.
    """
    line = turn_line(bracketed)
    return turns.groupBy("res_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("text"))
