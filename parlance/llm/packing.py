"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import query, read
from parlance.runtime import stored

# Open windows of a partition.
OPEN = 32
# Leftover windows that one task merges.
FAN_IN = 512
# Characters of text encoded at once; a longer text is cut before a letter run that follows white space.
TEXT_RUN = 1 << 20

_PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])


class Packer:
    """A fixed number of open windows of ``size`` tokens.

    A document is cut into whole windows and a rest. The rest goes to the open window that it fills best; when it
    fits none and no new window may be opened, the fullest is filled with the front of the rest and emitted, so an
    emitted window is always full. A piece is ``(doc, start, ids, doc_tokens)``.
    """

    def __init__(self, size: int, windows: int, emit: Callable[[list], None]):
        self.size, self.windows, self.emit = size, windows, emit
        self.open: list[tuple[int, list]] = []  # (tokens so far, pieces)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        at, n = 0, len(ids)
        while n - at >= self.size:
            self.emit([(doc, start + at, ids[at:at + self.size], total)])
            at += self.size
        while at < n:
            rest = n - at
            best = max((i for i, w in enumerate(self.open) if w[0] + rest <= self.size),
                       key=lambda i: self.open[i][0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append((0, []))
                best = len(self.open) - 1
            if best is None:
                best = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open[best]
            take = min(rest, self.size - used)
            pieces.append((doc, start + at, ids[at:at + take], total))
            if used + take == self.size:
                self.emit(pieces)
                del self.open[best]
            else:
                self.open[best] = (used + take, pieces)
            at += take

    def leftovers(self) -> list[list]:
        out, self.open = [pieces for _, pieces in self.open], []
        return out


class _Rows:
    """Collects pieces as rows; a sequence id holds the round, the task and a running number."""

    def __init__(self, round_: int, task: int):
        self.base, self.count, self.rows = (round_ << 56) + (task << 28), 0, []

    def add(self, pieces: list, open_: bool = False) -> None:
        if self.count >> 28:
            raise ValueError("too many sequences in one partition")
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.base + self.count, offset, open_))
            offset += len(ids)
        self.count += 1

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows = []
        columns[2] = [x.astype("<u4", copy=False).tobytes() for x in columns[2]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], _PIECE.fieldNames())


_ENCODERS: dict = {}


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[], Callable[[str], np.ndarray]]:
    """A maker of encoders for a byte-level vocabulary file of ``public_tokenizers``, to be called inside a task.

    The ids are those of the tokenizer file of that name; the ranks beside it are the same vocabulary, which
    another library encodes several times as fast. A special token's string is that token, as in the file.
    """
    def make() -> Callable[[str], np.ndarray]:
        if name not in _ENCODERS:
            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens={"<|endoftext|>": len(ranks)})
            _ENCODERS[name] = lambda text: encoding.encode_to_numpy(text, allowed_special="all")
        encode = _ENCODERS[name]

        def in_runs(text: str) -> np.ndarray:
            if len(text) <= TEXT_RUN:
                return encode(text)
            parts, at = [], 0
            while at < len(text):
                end = min(at + TEXT_RUN, len(text))
                # A token never spans the place between a letter and one space that a letter follows.
                while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1:end + 2].isalpha()):
                    end += 1
                parts.append(encode(text[at:end]))
                at = end
            return np.concatenate(parts)

        return in_runs

    return make


def _first_round(encoder, end_id: int, size: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder()
        rows = _Rows(0, TaskContext.get().partitionId())
        packer = Packer(size, windows, rows.add)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype(np.uint32)
                packer.add(doc, 0, ids, len(ids))
                if len(rows.rows) >= 2000:
                    yield rows.taken()
        for pieces in packer.leftovers():
            rows.add(pieces, True)
        yield rows.taken()

    return run


def _merge_round(number: int, size: int, windows: int, last: bool):
    def run(key: Tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(number, key[0].as_py())
        packer = Packer(size, windows, rows.add)
        window, pieces = None, []

        def place() -> None:
            for piece in pieces:
                packer.add(*piece)
            pieces.clear()

        for batch in groups:
            for r in batch.to_pylist():
                if r["sequence_id"] != window:
                    place()
                    window = r["sequence_id"]
                pieces.append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            if len(rows.rows) >= 2000:
                yield rows.taken()
        place()
        left = packer.leftovers()
        if last:
            left = _powers_of_two([p for pieces in left for p in pieces], size)
        for pieces_ in left:
            rows.add(pieces_, not last)
        yield rows.taken()

    return run


def _powers_of_two(pieces: list, size: int) -> list[list]:
    """What is left at the very end, as full windows and then windows of falling powers of two: none needs padding."""
    out: list[list] = []
    left = sum(len(p[2]) for p in pieces)
    room = 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            if not room:
                room = size if left >= size else 1 << (left.bit_length() - 1)
                out.append([])
            take = min(room, len(ids) - at)
            out[-1].append((doc, start + at, ids[at:at + take], total))
            at, room, left = at + take, room - take, left - take
    return out


def pack(docs: DataFrame, encoder=None, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0,
         windows: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens:
    ``doc_id, start, ids (little-endian unsigned 32 bits), length, doc_tokens, sequence_id, offset``.

    Every document is encoded whole and closed by ``end_id``. Each partition packs its documents online with a
    fixed number of open windows; what is open at its end goes to merging rounds of ``fan_in`` windows a task,
    until one task is enough. All sequences are full but those of the last merge, which are powers of two, so
    there is no padding. Memory is bounded by the windows and the longest text. The first round is written once
    to the shared folder: a lost task is packed anew as a whole, and no document is ever packed twice. A null
    text is an empty one (one token); repeated rows are packed as often; ids may be null; an empty table gives
    no pieces.
    """
    if fan_in < 2 * windows:
        raise ValueError("a merging task must take in at least twice the windows that it leaves open")
    encoder = encoder or byte_bpe()
    rounds = [stored(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _first_round(encoder, end_id, size, windows), _PIECE), compression="zstd")]
    while True:
        left = rounds[-1].filter("open")
        count = left.select("sequence_id").distinct().count()
        groups = -(-count // fan_in)
        if not groups:
            break
        last = groups == 1
        merged = left.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        # The order inside a task is fixed, so that a task that runs again gives the same sequences.
        merged = merged.repartition(groups, "group").sortWithinPartitions("group", "sequence_id", "offset")
        rounds.append(stored(merged.groupBy("group").applyInArrow(
            _merge_round(len(rounds), size, 1 if last else windows, last), _PIECE)))
    out = rounds[0].filter("not open")
    for r in rounds[1:]:
        out = out.unionByName(r.filter("not open"))
    return out.select("doc_id", "start", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("length"), "doc_tokens",
                      "sequence_id", "offset")


@query("op6_bounded_space_packing")
def _op6(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
