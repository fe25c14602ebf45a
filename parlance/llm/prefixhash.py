"""Fingerprints of texts from prefix polynomial hashes.

The prefix array of a text holds, for every position, the sum of ``(code point + 1) * BASE ** index`` before it, modulo
a prime. Any span's hash is then a difference of two entries, brought to the same power: two spans are compared in one
step whatever their length, and the longest common extension of two positions is found by binary search. Two primes
near 2^31 are used together, so that unequal spans of a few million positions hardly ever agree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read
from parlance.runtime import stored

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
# Code points of a long and of a short span. Where a text has fewer than SMALL code points, short spans are compared;
# a fingerprint holds them below FEW.
LONG, SHORT, SMALL, FEW = 16, 4, 64, 256
# Least span hashes of a kind that a fingerprint keeps.
KEPT = 48
# Positions worked on at once.
RUN = 1 << 16
# Code points of short texts that are hashed together.
GROUP = 1 << 14


class Powers:
    """Powers of the bases and of their inverses, grown as texts need them."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint32) for _ in PRIMES]
        self.down = [np.ones(1, np.uint32) for _ in PRIMES]

    def upto(self, n: int) -> None:
        while len(self.up[0]) <= n:
            for k, (p, b) in enumerate(zip(PRIMES, BASES)):
                for table, base in ((self.up, b), (self.down, pow(b, -1, p))):
                    step = np.uint64(pow(base, len(table[k]), p))
                    table[k] = np.concatenate([table[k], (table[k] * step % np.uint64(p)).astype(np.uint32)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """The prefix arrays of a text of ``n`` code points: 8 bytes a position, beside 16 of the shared powers."""

    def __init__(self, text: str, powers: Powers, head: PrefixHash | None = None, shared: int = 0):
        """``head``: the arrays of a text that agrees on the first ``shared`` code points; their entries are taken."""
        points = code_points(text)
        self.n, self.powers, self.origin = len(points), powers, head.origin if head else 0
        powers.upto(self.origin + self.n)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint32)
            if head is not None:
                sums[:shared + 1] = head.sums[k][:shared + 1]
            for at in range(shared, self.n, RUN):
                to = min(at + RUN, self.n)
                up = powers.up[k][self.origin + at:self.origin + to]
                terms = (points[at:to].astype(np.uint64) + np.uint64(1)) * up % np.uint64(p)
                terms[0] += sums[at]
                sums[at + 1:to + 1] = np.cumsum(terms) % np.uint64(p)
            self.sums.append(sums)

    def part(self, start: int, end: int) -> PrefixHash:
        """The same of a part of the text, on the same arrays: where a span stands changes nothing of its hash."""
        out = object.__new__(PrefixHash)
        out.n, out.powers, out.origin = end - start, self.powers, self.origin + start
        out.sums = [s[start:end + 1] for s in self.sums]
        if out.n >= LONG:
            out.long_spans = self.long_spans[start:end - LONG + 1]
        return out

    def spans(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The 62-bit hashes of the spans ``[at, at + length)``; spans are equal if these and their lengths are."""
        return self._hash([(s[at], s[at + length], d[self.origin + at]) for s, d in zip(self.sums, self.powers.down)])

    def every(self, length: int, start: int, end: int) -> np.ndarray:
        """The hashes of the spans of one length that start in ``[start, end)``."""
        return self._hash([(s[start:end], s[start + length:end + length], d[self.origin + start:self.origin + end])
                           for s, d in zip(self.sums, self.powers.down)])

    @staticmethod
    def _hash(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros(len(parts[0][0]), np.uint64)
        for p, (before, upto, down) in zip(PRIMES, parts):
            gap = upto.astype(np.uint64) + np.uint64(p) - before
            # Below 2^32 times below 2^31: the gap needs no reduction of its own.
            out = (out << np.uint64(31)) | (gap * down % np.uint64(p))
        return out

    def span(self, at: int, length: int) -> list[int]:
        """The hash of one span modulo each prime, without the cost of arrays."""
        return [(s.item(at + length) - s.item(at)) * d.item(self.origin + at) % p
                for p, s, d in zip(PRIMES, self.sums, self.powers.down)]

    def whole(self) -> int:
        first, second = self.span(0, self.n)
        return first << 31 | second

    @cached_property
    def long_spans(self) -> np.ndarray:
        """The ``mixed`` hashes of all spans of LONG code points."""
        return mixed(self, LONG)

    @property
    def short_spans(self) -> np.ndarray:
        """Those of SHORT code points, which only texts below FEW need."""
        return mixed(self, SHORT) if self.n < FEW else np.zeros(0, np.uint32)


class Joined:
    """The first ``at`` code points of one text and another text behind them, from the hashes of both.

    ``back`` has to begin with the LONG - 1 code points that follow in ``front``, so that every span lies in one of the
    two. Of a text below FEW it has to be the whole, with ``at`` 0, as has a ``back`` without more than those.
    """

    def __init__(self, front: PrefixHash, at: int, back: PrefixHash):
        self.front, self.at, self.back, self.n = front, at, back, at + back.n

    def whole(self) -> int:
        front, back = self.front.span(0, self.at), self.back.span(0, self.back.n)
        first, second = [(a + b * up.item(self.at)) % p for a, b, up, p in zip(front, back, self.back.powers.up, PRIMES)]
        return first << 31 | second

    @property
    def long_spans(self) -> np.ndarray:
        return np.concatenate([self.front.long_spans[:self.at], self.back.long_spans])

    @property
    def short_spans(self) -> np.ndarray:
        return mixed(self.back, SHORT) if self.n < FEW else np.zeros(0, np.uint32)


def hashed_together(texts: list[str], powers: Powers) -> list[PrefixHash]:
    """The arrays of each text, computed as those of one text: few array steps for many short texts."""
    joint = PrefixHash("".join(texts), powers)
    return [joint.part(end - len(t), end) for t, end in zip(texts, accumulate(map(len, texts)))]


def mixed(text: PrefixHash, length: int) -> np.ndarray:
    """The hashes of all spans of a length, mixed and cut to 32 bits; of a shorter text, of its one span."""
    length = min(length, text.n)
    out = np.zeros(text.n - length + 1 if text.n else 0, np.uint32)
    for at in range(0, len(out), RUN):
        to = min(at + RUN, len(out))
        x = text.every(length, at, to) * np.uint64(0x9E3779B97F4A7C15)
        out[at:to] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    return out


def common_extension(a: PrefixHash, i, b: PrefixHash, j) -> np.ndarray:
    """How many code points agree from ``i`` in ``a`` and ``j`` in ``b`` on, pair by pair: a binary search each.

    It ends below the first power of two that does not agree, so that short extensions take few comparisons.
    """
    def agreeing(x: int, y: int) -> int:
        def differ(n: int) -> bool:
            return a.span(x, n) != b.span(y, n)

        most, reach = min(a.n - x, b.n - y), 1
        while reach <= most and not differ(reach):
            reach *= 2
        # Lengths up to half the reach agree.
        return bisect_left(range(most + 1), True, reach // 2 + 1, min(reach, most + 1), key=differ) - 1

    return np.array([agreeing(int(x), int(y)) for x, y in zip(i, j)], np.int64)


def _least(hashes: np.ndarray) -> list[int]:
    """The ``KEPT`` least distinct ones."""
    if not len(hashes):
        return []
    # Hashes are spread evenly, so enough of them lie below this, unless spans repeat.
    few = np.unique(hashes[hashes < (2 * KEPT << 32) // len(hashes)])
    return (few if len(few) >= KEPT else np.unique(hashes))[:KEPT].tolist()


def fingerprint(text: PrefixHash | Joined) -> str:
    """``length:whole hash:long spans:short spans`` in hexadecimal: bounded, and a function of the text alone."""
    kinds = [_least(text.long_spans), _least(text.short_spans)]
    return ":".join([f"{text.n:x}", f"{text.whole():016x}", *("%08x" * len(kind) % tuple(kind) for kind in kinds)])


def likeness(a: str, b: str) -> float:
    """The share of the spans of two fingerprints' texts that both have: twice the common ones by all, 0 to 1.

    Each fingerprint lists all its spans' hashes up to its last one (all, if it lists fewer than it may), so up to the
    smaller end both are complete, and their Jaccard similarity there is an unbiased estimate. 1 for equal texts, 0
    for an empty and another text.
    """
    if a == b:
        return 1.0
    (n, _, *mine), (m, _, *theirs) = (f.split(":") for f in (a, b))
    small = int(n, 16) < SMALL or int(m, 16) < SMALL
    kind = int(small and max(int(n, 16), int(m, 16)) < FEW)
    x, y = ([h[kind][i:i + 8] for i in range(0, len(h[kind]), 8)] for h in (mine, theirs))
    ends = [s[-1] for s in (x, y) if len(s) == KEPT]
    if ends:
        x, y = (s[:bisect_right(s, min(ends))] for s in (x, y))
    union = set(x).union(y)
    both = len(set(x).intersection(y)) / len(union) if union else 0.0
    return 2 * both / (1 + both)


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by the front of the following one, and the code points that stay."""
    change = len(text) // 3
    return text[:len(text) - change] + following[:change], len(text) - change


_FOUND = ("doc_id {id}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, agree_edited bigint")
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "agree_edited"]


class _Texts:
    """Fingerprints inside one task, which share their powers."""

    def __init__(self) -> None:
        self.powers = Powers()

    def hashed(self, text: str) -> PrefixHash:
        return PrefixHash(text, self.powers)

    def row(self, doc, text: str, own: PrefixHash, mark: str, following: str, next_mark: str) -> tuple:
        return self.rows([(doc, text, own, mark, following, next_mark)])[0]

    def rows(self, pairs: list[tuple]) -> list[tuple]:
        """The results of texts and their following ones, as ``row`` takes them."""
        news = [edited(text, following) for _, text, _, _, following, _ in pairs]
        # Only spans that reach into the new part are hashed; small texts and those without a new part are hashed whole.
        cuts = [max(stay - LONG + 1, 0) if stay < len(new) and len(new) >= FEW else 0 for new, stay in news]
        backs = hashed_together([new[at:] for (new, _), at in zip(news, cuts)], self.powers)
        out = []
        for (doc, text, own, mark, _, next_mark), (new, stay), at, back in zip(pairs, news, cuts, backs):
            new_mark = fingerprint(Joined(own, at, back))
            agree = stay + int(common_extension(own, [stay], back, [stay - at])[0])
            out.append((doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogateescape")).hexdigest(), mark, new_mark,
                        likeness(mark, new_mark), likeness(mark, next_mark), agree))
        return out


def _text(value: pa.Scalar) -> str:
    """Bytes that are no UTF-8 stay one code point each."""
    return (value.as_py() or b"").decode("utf-8", "surrogateescape")


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The rows of a batch, as many at once as have GROUP code points."""
    group, size = [], 0
    for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
        group.append((doc, _text(value)))
        size += len(group[-1][1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _batch(names: list[str], rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": first, "n_chars": pa.int64(), "agree_edited": pa.int64(), "near_edited": pa.float64(),
             "near_next": pa.float64(), "part": pa.int32(), "text": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)], names)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    agree_edited``.

    Every text is edited with the next row's, by descending key (nulls last), then descending text; the first row
    follows the last. ``near_*`` are likenesses of fingerprints, ``agree_edited`` the longest common extension of
    both texts' beginnings. A null text is an empty one, repeated rows follow one another, one row alone follows
    itself, an empty table gives an empty one; other columns are ignored.

    One shuffle: rows are dealt out by ranges and sorted, and each task reads its rows in order, GROUP code points or a
    longer text at a time. What it lacks, the row behind its last one, is written beside the results and met by a small
    join, one row for each task. A text and the next take about 60 bytes a code point of theirs while they are worked on.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [*_NAMES, "part", "end", "text"]
    shape = _FOUND.format(id=kind) + ", part int, end string, text binary"
    ids = F.col("doc_id").desc_nulls_last()
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    # Bounds are drawn from the fronts of texts only.
    ordered = rows.repartitionByRange(ids, F.substring("text", 1, 64).desc()).sortWithinPartitions(ids, F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, texts, last, first, out = TaskContext.get().partitionId(), _Texts(), None, None, []
        for batch in batches:
            first = batch.schema.field(0).type
            for group in _groups(batch):
                owns = hashed_together([now for _, now in group], texts.powers)
                known = [(doc, now, own, fingerprint(own)) for (doc, now), own in zip(group, owns)]
                if last is None:
                    doc, now, _, mark = known[0]
                    out.append((doc, *(None,) * 2, mark, *(None,) * 4, part, "first", now.encode("utf-8", "surrogateescape")))
                else:
                    known.insert(0, last)
                pairs = [(*row, now, mark) for row, (_, now, _, mark) in pairwise(known)]
                out += [(*row, None, None, None) for row in texts.rows(pairs)]
                last = known[-1]
                if len(out) >= 2000:
                    yield _batch(names, out, first)
                    out = []
        if last is not None:
            out.append((last[0], *(None,) * 2, last[3], *(None,) * 4, part, "last", last[1].encode("utf-8", "surrogateescape")))
            yield _batch(names, out, first)

    found = stored(ordered.mapInArrow(run, shape), compression="zstd")
    # At most as many as there are partitions.
    parts = sorted(r["part"] for r in found.filter("end = 'first'").select("part").collect())
    spark = docs.sparkSession
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = found.filter("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"),
                                                 F.col("fingerprint").alias("next_mark"))
    open_ = found.filter("end = 'last'").select("part", "doc_id", "text", "fingerprint").join(follows, "part").join(
        heads, "next").select("doc_id", "text", "fingerprint", "next_text", "next_mark")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts()
        for batch in batches:
            for doc, text_, mark, after, next_mark in zip(*(batch.column(i) for i in range(5))):
                now = _text(text_)
                row = texts.row(doc.as_py(), now, texts.hashed(now), mark.as_py(), _text(after), next_mark.as_py())
                yield _batch(_NAMES, [row], doc.type)

    return found.filter("end is null").select(*_NAMES).unionByName(open_.mapInArrow(close, _FOUND.format(id=kind)))


@query("op13_prefix_polynomial_hashes")
def _op13(spark, sf_dir):
    return edited_fingerprints(read(spark, sf_dir, "documents"))
