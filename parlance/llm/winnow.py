"""Benchmark decontamination by winnowing: k-gram fingerprints, joined and extended to whole shared windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import query, read, slices, unpacked, whole_row
from parlance.runtime import stored

# A shared span of SPAN words is found for certain: SPAN = GRAM + WINDOW - 1.
GRAM, WINDOW = 7, 7
SPAN = GRAM + WINDOW - 1
# Words of benchmark text in one broadcast index (about 40 bytes a word); more make more indexes.
INDEX_WORDS = 1_000_000
# Bytes of text handled at once, and rows of matches.
RUN, ROWS = 1 << 20, 1 << 18

# Bytes of words, A-Z lower-cased: digits, letters and all of a non-ASCII character; 0 for all others.
_WORD = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _WORD[_b] = _b
_WORD[65:91] = np.arange(97, 123)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n, modulo 2 ** 64; kept, as runs have much the same length."""
    if len(_POWERS.get(base, ())) <= n:
        _POWERS[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, RUN), base, np.uint64))])
    return _POWERS[base][:n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Positions and hashes of the words of a byte string; long strings are read in runs cut between words."""

    def __init__(self, data: bytes):
        self.data = _WORD[np.frombuffer(data, np.uint8)]
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(self.data):
            end = min(at + RUN, len(self.data))
            while end < len(self.data):
                gap = np.flatnonzero(self.data[end:end + RUN] == 0)
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + RUN, len(self.data))
            s, e, h = self._of(self.data[at:end])
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = end
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.starts, self.ends = join(starts, np.int64), join(ends, np.int64)
        self.hashes = join(hashes, np.uint64)

    @staticmethod
    def _of(part: np.ndarray):
        edge = np.flatnonzero(np.diff((part != 0).view(np.int8), prepend=0, append=0))
        s, e = edge[::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * _powers(_BASE, len(part))[:-1], dtype=np.uint64)])
        return s, e, _mix((sums[e] - sums[s]) * _powers(_INVERSE, len(part))[s] + (e - s).astype(np.uint64))

    def text(self, start: int, end: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end])]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    out = words[:len(words) - k + 1].copy() if len(words) >= k else np.empty(0, np.uint64)
    for i in range(1, k):
        out = out * np.uint64(_INVERSE) + words[i:len(words) - k + 1 + i]
    return _mix(out)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The extreme of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:len(values) - step], values[step:])
        done += step
    return values


def winnowed(words: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the minimum of some window of ``width`` k-grams.

    All minima of a window are kept, so two texts that share ``k + width - 1`` words keep the same ones there.
    """
    grams = _grams(words, k)
    if len(grams) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(grams == best)
    return at, grams[at]


@dataclass
class Table:
    """For windows of one length: the winnowed k-grams, and every distinct window of an item with a place of it."""

    k: int
    width: int
    grams: np.ndarray
    seen: np.ndarray
    windows: np.ndarray
    places: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """Fingerprints of a block of benchmark items, by the length of window they serve, and the items' words."""

    ids: list[list[str]] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    # Distinct words by hash, and where each one's bytes lie.
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    begin: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    length: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    data: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))


def build_index(items: list[tuple[str, str]]) -> Index:
    """Items of the same words are held once, with all their ids. Items without words are left out."""
    ids: dict[bytes, set[str]] = defaultdict(set)
    for key, text in items:
        w = Words((text or "").encode())
        if len(w.starts):
            ids[b" ".join(w.text(0, len(w.starts)))].add(key)
    out = Index([sorted(v) for v in ids.values()])
    if not ids:
        return out
    parts = [Words(t).hashes for t in ids]
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(sizes) - sizes
    # One space between two texts: no word reaches from one into the next.
    every = Words(b" ".join(ids))
    out.words, out.data = every.hashes, every.data
    out.vocabulary, at = np.unique(every.hashes, return_index=True)
    out.begin, out.length = every.starts[at], every.ends[at] - every.starts[at]
    found = defaultdict(list)
    for i, (begin, part) in enumerate(zip(first.tolist(), parts)):
        k, width = (GRAM, WINDOW) if len(part) >= SPAN else (len(part), 1)
        windows, at = np.unique(_grams(part, k + width - 1), return_index=True)
        found[k, width].append((np.unique(winnowed(part, k, width)[1]), windows, at + begin, np.full(len(at), i)))
    for (k, width), rows in sorted(found.items()):
        grams = np.unique(np.concatenate([r[0] for r in rows]))
        windows, places, of = (np.concatenate([r[j] for r in rows]) for j in (1, 2, 3))
        order = np.argsort(windows, kind="stable")
        bits = max(12, min(22, int(len(grams)).bit_length() + 5))
        seen = np.zeros(1 << bits, bool)
        seen[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
        out.tables.append(Table(k, width, grams, seen, windows[order], places[order], of[order]))
    return out


def _same(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from a[p] on are those from b[q] on."""
    out = np.ones(len(p), bool)
    for i in range(n):
        out &= a[p + i] == b[q + i]
    return out


def _are_words(w: Words, at: np.ndarray, index: Index) -> np.ndarray:
    """Whether the words at these places of a text are, byte for byte, the index's words of the same hash."""
    out = np.zeros(len(at), bool)
    for start in range(0, len(at), ROWS):
        here = at[start:start + ROWS]
        v = np.searchsorted(index.vocabulary, w.hashes[here])
        n = w.ends[here] - w.starts[here]
        fits = np.flatnonzero(index.length[v] == n)
        v, n, begin = v[fits], n[fits], w.starts[here[fits]]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = w.data[np.repeat(begin, n) + offset] == index.data[np.repeat(index.begin[v], n) + offset]
        out[start + fits] = np.bincount(np.repeat(np.arange(len(n)), n)[~equal], minlength=len(n)) == 0
    return out


def _from_to(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of so many numbers each, one after another."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def windows_of(words: np.ndarray, table: Table, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extends common k-grams to whole windows: ``(at, kind, kind_of, items)``.

    ``at`` are the places where a window of some item stands in ``words``, and ``kind`` numbers equal ones alike; the
    pairs ``kind_of, items`` list each kind's items. A window that a text repeats is looked up once, so the cost
    follows the text and the items found, not how often either repeats its words.
    """
    none = np.empty(0, np.int64)
    size = table.k + table.width - 1
    at, h = winnowed(words, table.k, table.width)
    hit = table.seen[(h >> np.uint64(64 - int(len(table.seen)).bit_length() + 1)).astype(np.int64)]
    at, h = at[hit], h[hit]
    found = np.searchsorted(table.grams, h)
    at = at[table.grams[np.minimum(found, len(table.grams) - 1)] == h]
    if not len(at):
        return none, none, none, none
    # The windows that hold such a gram.
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.maximum(at - table.width + 1, 0), 1)
    np.add.at(marks, at + 1, -1)
    at = np.flatnonzero(np.cumsum(marks[:len(words) - size + 1]))
    distinct, first, kind = np.unique(_grams(words, size)[at], return_index=True, return_inverse=True)
    low, high = np.searchsorted(table.windows, distinct), np.searchsorted(table.windows, distinct, "right")
    lookup = np.flatnonzero(high > low)
    kinds, items = [none], [none]
    ends = np.cumsum((high - low)[lookup])
    start = 0
    while start < len(lookup):  # runs of about ROWS rows
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ROWS, "right")))
        some = lookup[start:stop]
        n = (high - low)[some]
        rows, of = _from_to(low[some], n), np.repeat(some, n)
        good = _same(words, at[first[of]], index.words, table.places[rows], size)
        kinds.append(of[good])
        items.append(table.items[rows[good]])
        start = stop
    kind_of, items = np.concatenate(kinds), np.concatenate(items)
    known = np.zeros(len(distinct), bool)
    known[kind_of] = True
    left = np.flatnonzero(known[kind])
    left = left[_same(words, at[left], words, at[first[kind[left]]], size)]
    return at[left], kind[left], kind_of, items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _search(index):
    def search(texts: list[bytes]):
        """Per text: number of words, spans, item numbers."""
        index_ = Index(**index.value)
        w = Words(b"\n".join(texts))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        of = np.searchsorted(w.starts, begin)
        # Between texts stand words of no text, so that no k-gram reaches over an edge and none is lost.
        apart = np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(_INVERSE)
        parts = []
        for a, b in zip(of[:-1], of[1:]):
            parts += [w.hashes[a:b], apart]
        words = np.concatenate(parts)
        shift = np.arange(len(texts)) * SPAN
        starts = of[:-1] + shift
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for table in index_.tables:
            size = table.k + table.width - 1
            at, kind, kind_of, item = windows_of(words, table, index_)
            if not len(at):
                continue
            d = np.searchsorted(starts, at, "right") - 1
            at = at - shift[d]
            # The words, not only their hashes.
            inside = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + size, -1)
            places = np.flatnonzero(np.cumsum(inside[:-1]))
            wrong = np.zeros(len(w.hashes) + 1, np.int64)
            wrong[places[~_are_words(w, places, index_)] + 1] = 1
            wrong = np.cumsum(wrong)
            good = wrong[at + size] == wrong[at]
            at, d, kind = at[good], d[good], kind[good]
            # Windows that touch or overlap within a text are one span.
            edge = np.flatnonzero((np.diff(at, prepend=-size - 1) > size) | (np.diff(d, prepend=-1) != 0))
            for s, e, i in zip(at[edge].tolist(), (at[np.append(edge[1:], len(at)) - 1] + size).tolist(), d[edge].tolist()):
                found[i].append((s - int(of[i]), e - int(of[i])))
            # Each kind of window once a text, with its items.
            order = np.argsort(kind_of, kind="stable")
            kind_of, item = kind_of[order], item[order]
            pairs = np.unique(np.stack([d, kind], 1), axis=0)
            low, high = np.searchsorted(kind_of, pairs[:, 1]), np.searchsorted(kind_of, pairs[:, 1], "right")
            for start in range(0, len(pairs), 1024):
                n = (high - low)[start:start + 1024]
                rows = item[_from_to(low[start:start + 1024], n)]
                for i, j in np.unique(np.stack([np.repeat(pairs[start:start + 1024, 0], n), rows], 1), axis=0).tolist():
                    items[i].update(index_.ids[j])
        return np.diff(of).tolist(), found, items

    return search


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])
_RESULT_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                           ("items", pa.list_(pa.string()))])


def _blocks(benchmark: DataFrame, key: str, text: str, words: int) -> list[Index]:
    """Indexes of about ``words`` words each. An item longer than that is cut into parts that overlap by a window."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1))
    step = max(1, words - SPAN + 1)
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), tokens.alias("w")).select(
        "id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - SPAN, F.lit(0)), F.lit(step)),
                                    lambda i: F.array_join(F.slice("w", i + 1, words), " "))).alias("t"),
        F.least(F.size("w"), F.lit(words)).alias("n"))
    items = stored(items)
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // words))
    block = lambda i: items.filter(F.pmod(F.xxhash64("t"), F.lit(count)) == i)
    return [build_index([(r["id"], r["t"]) for r in block(i).select("id", "t").toLocalIterator()]) for i in range(count)]


def shared_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """``(doc, found)`` for every row: the whole row, and ``found(n_words, spans, items)``.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. ``spans`` are
    the word ranges (end exclusive, disjoint, sorted) inside occurrences of a window of SPAN words of an
    item, or of a whole item that has fewer words; ``items`` the sorted ids of those items. Both sides keep the
    least k-gram of every window of k-grams, so each shared window has a common fingerprint; matches are
    extended to the windows that hold them and the words themselves compared. The time grows with the length of a
    text and with the items found in it, however often either repeats its words. The fingerprints of the benchmark are broadcast in
    blocks of ``index_words`` words at most, whatever its size; documents are never shuffled, and no block sees
    less than every whole text. Null texts have no words; a null item id counts as the empty id; repeated
    rows are treated one by one; empty tables give empty or hit-free results.
    """
    spark = docs.sparkSession
    out = docs.select(whole_row(docs), F.lit(None).cast(_RESULT).alias("found"))
    for index in _blocks(benchmark, item_key, item_text, index_words):
        search = _search(spark.sparkContext.broadcast(vars(index)))

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, before = batch.column(0), batch.column(1)
                for start, texts in slices(doc.field(text), RUN):
                    n, spans, items = search(texts)
                    rows = []
                    for i, old in enumerate(before.slice(start, len(texts)).to_pylist()):
                        if old:
                            spans[i] += [(s["start"], s["end"]) for s in old["spans"]]
                            items[i].update(old["items"])
                        rows.append({"n_words": n[i], "items": sorted(items[i]),
                                     "spans": [{"start": s, "end": e} for s, e in _union(spans[i])]})
                    yield pa.record_batch([doc.slice(start, len(texts)), pa.array(rows, _RESULT_ARROW)], ["doc", "found"])

        out = out.mapInArrow(run, out.schema)
    return out


def n_hit(found: str = "found") -> Column:
    return F.aggregate(f"{found}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(found: str = "found") -> Column:
    """At least one word hit, and at least a twentieth of all."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without its contaminated rows; its columns stay as they are."""
    return unpacked(shared_spans(docs, benchmark, **settings).filter(~contaminated()))


_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, w, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS k FROM (
         SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS g
       FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM iw)),
ks AS (SELECT DISTINCT k FROM iw),
dg AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, dg.k, i, item_id FROM dg JOIN ig ON dg.k = ig.k AND dg.g = ig.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
          SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""


@query("op2_winnowing_decontamination", _SQL)
def _op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shared_spans(docs, read(spark, sf_dir, "benchmark")).select(
        "doc.doc_id", "found.n_words", n_hit().alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
