"""JSON out of free text: a cascade of candidates, or the largest object."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THINK = r"(?is)<think>.*?</think>"
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
OUTERMOST = r"(?s)(\{.*\}|\[.*\])"
TRAILING_COMMA = r",\s*([}\]])"


def json_candidates(content: Column) -> list[tuple[str, Column]]:
    """Texts to try in order: all of it, the fenced block, the outermost braces."""
    whole = F.btrim(F.regexp_replace(F.coalesce(content, F.lit("")), THINK, ""), F.lit(" \t\r\n\f\x0b"))
    fenced = F.btrim(F.regexp_extract(whole, FENCE, 1), F.lit(" \t\r\n\f\x0b"))
    outer = F.regexp_replace(F.regexp_extract(whole, OUTERMOST, 1), TRAILING_COMMA, "$1")
    return [("whole", whole), ("fenced", fenced), ("outer", outer)]


def is_json(c: Column) -> Column:
    return (c != "") & F.try_parse_json(c).isNotNull()


# Strings stand behind a structural sign; quotes in prose do not, and open nothing.
_BRACES = re.compile(r'(?<=[{\[,:])\s*"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)


def _decoded(text: str):
    """The value of a JSON text, commas before a closing bracket forgiven; None for anything else."""
    for attempt in (text, re.sub(TRAILING_COMMA, r"\1", text)):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def _objects(text: str) -> list[str]:
    """Texts between matching braces, the longest first: one pass with a stack of open ones."""
    opened, spans = [], []
    for token in _BRACES.finditer(text):
        if token[0] == "{":
            opened.append(token.start())
        elif token[0] == "}" and opened:
            start = opened.pop()
            spans.append((start - token.end(), start, token.end()))
    return [text[a:b] for _, a, b in sorted(spans)]


def _largest_value(text: str | None) -> str | None:
    """All of a text or its fenced block, if that is an object or array; else its longest object that decodes."""
    text = (text or "").strip()
    whole = [text, *(m.strip() for m in re.findall(FENCE, text)[:1])]
    for found in map(_decoded, [*whole, *_objects(text)]):
        if isinstance(found, (dict, list)):
            return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def largest_json(content: pd.Series) -> pd.Series:
    """The whole answer if it is JSON, else the largest object in it, for prose on both sides."""
    return content.map(_largest_value)
