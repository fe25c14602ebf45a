"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read, unpacked, whole_row
from parlance.llm.components import components
from parlance.runtime import stored

BYTES = 8
# Bytes of a text handled at once.
SEGMENT = 1 << 20
# Distinct fingerprints of one index entry that a task compares with each other.
ENTRY = 4096
# From this many fingerprints on the index uses four positions per entry in place of three.
WIDE = 1 << 26


# --- fingerprints ------------------------------------------------------------------------

def _segments(data: bytes) -> Iterator[bytes]:
    """``data`` cut at white space into parts of about SEGMENT bytes."""
    start = 0
    while len(data) - start > SEGMENT:
        end = start + SEGMENT
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def simhash(data: bytes, n: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of
    ``n`` words with repeats; 0 without words. Texts of any length are read in segments."""
    digest = xxhash.xxh64_digest
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for part in _segments(data.lower()):
        words = carry + part.split()
        if len(words) < n:
            carry = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:len(words) - n + 1].tolist()
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1:].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BYTES), axis=1)
        counts += bits.sum(0, dtype=np.int64)
        total += len(starts)
        carry = words[len(words) - n + 1:]
    if not total:
        return int.from_bytes(digest(b" ".join(carry), seed), "big") if carry else 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row, the fingerprint as a signed long. A null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_py() or b"", n, seed) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint bigint")


# --- the index ---------------------------------------------------------------------------

def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any four of the eight positions contain one of them.

    Fingerprints at four or fewer differing bits share at least four bytes, so they meet in an entry of
    one of the sets. Four: all 70 sets. Three: a smallest family, 20 sets: the positions lie on a circle
    of three groups; a set lies in one group, or has two positions in a group and one in the next.
    """
    if size == 4:
        return list(combinations(range(BYTES), 4))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for s in combinations(range(BYTES), 3):
        g = sorted(group[p] for p in s)
        if g[0] == g[2] or any(g.count(a) == 2 and g.count((a + 1) % 3) == 1 for a in range(3)):
            out.append(s)
    return out


def _byte(print_: Column, position: int) -> Column:
    return F.shiftrightunsigned(print_, 8 * position).bitwiseAND(255)


def _entry(print_: Column, number: int, positions: tuple[int, ...]) -> Column:
    out = F.lit(number).cast("bigint")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(print_, p))
    return out


def _matches(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Count filter, then the exact distance: at least 8 - bits bytes are shared, at most ``bits`` bits differ."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(-1)
    return (shared >= BYTES - bits) & (np.bitwise_count(differ) <= bits)


def _links_of_entry(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the entry's fingerprints connect: one per fingerprint at most."""
    label = np.arange(len(prints))
    while True:
        new = label.copy()
        for i in range(0, len(prints), 256):
            near = _matches(prints[i:i + 256, None], prints[None, :], bits)
            np.minimum(new[i:i + 256], np.where(near, label[None, :], len(prints)).min(1), out=new[i:i + 256])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(prints)))
    return prints[far], prints[label[far]]


def _compare(bits: int):
    """Links within the entries of a partition sorted by entry."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(entries: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        _, first, size = np.unique(entries, return_index=True, return_counts=True)
        for s, n in zip(first[size > 16].tolist(), size[size > 16].tolist()):
            x, y = _links_of_entry(prints[s:s + n], bits)
            a.append(x)
            b.append(y)
        small = np.repeat(size <= 16, size)
        entries, prints = entries[small], prints[small]
        for step in range(1, 16):
            at = np.flatnonzero(entries[step:] == entries[:-step]) if len(entries) > step else np.empty(0, np.int64)
            if not len(at):
                break
            at = at[_matches(prints[at], prints[at + step], bits)]
            a.append(prints[at])
            b.append(prints[at + step])
        join = lambda x: (np.concatenate(x) if x else np.empty(0, np.uint64)).view(np.int64)
        return pa.record_batch([pa.array(join(a)), pa.array(join(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            entries = np.concatenate([entries, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            if len(entries) and entries[0] != entries[-1]:
                cut = np.searchsorted(entries, entries[-1])
                yield found(entries[:cut], prints[:cut])
                entries, prints = entries[cut:], prints[cut:]
        if len(entries):
            yield found(entries, prints)

    return run


def _split(entries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of entries of at most ``limit`` fingerprints, and those of larger ones if there are any."""
    large = stored(entries.groupBy("entry").count().filter(F.col("count") > limit).select("entry"))
    if large.isEmpty():
        return entries, None
    return entries.join(large, "entry", "left_anti"), entries.join(large, "entry", "left_semi")


def links(prints: DataFrame, bits: int = 4, limit: int = ENTRY, wide: bool | None = None) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``fingerprint`` values of ``prints`` that give the same components
    as all pairs at ``bits`` (0, 2 or 4) or fewer differing bits. Every link returned is such a pair or
    joins two fingerprints by a chain of such pairs inside one entry.

    An entry of more than ``limit`` fingerprints is dealt out by one more position (they share at least a
    fourth byte), and one that is still larger by what its fingerprints become when up to half of ``bits``
    of the other 32 bits flip: two that become the same are at most ``bits`` bits apart, and any two at
    most so far apart do. That takes one minimum per outcome, so no entry is compared in full beyond ``limit``.
    """
    if bits not in (0, 2, 4):
        raise ValueError("bits must be 0, 2 or 4")
    p = F.col("fingerprint")
    if wide is None:
        wide = prints.count() >= WIDE
    size = 4 if wide else 3
    sets = position_sets(size)
    compare = lambda df: (df.select("entry", "fingerprint").repartition("entry")
                          .sortWithinPartitions("entry").mapInArrow(_compare(bits), "a bigint, b bigint"))
    entries = prints.select(p, F.explode(F.array(*[_entry(p, i, s) for i, s in enumerate(sets)])).alias("entry"))
    normal, large = _split(entries, limit)
    out = compare(normal)
    if large is not None and size == 3:
        deeper = []
        for i, s in enumerate(sets):
            for q in sorted(set(range(BYTES)) - set(s)):
                own = F.shiftrightunsigned("entry", 24) == i
                deeper.append(F.when(own, _entry(p, position_sets(4).index(tuple(sorted((*s, q)))), tuple(sorted((*s, q))))))
        found = large.select("fingerprint", F.explode(F.array_compact(F.array(*deeper))).alias("entry")).distinct()
        normal, large = _split(stored(found), limit)
        out = out.unionByName(compare(normal))
    if large is not None:
        sets4 = position_sets(4)
        kept = F.element_at(F.array(*[F.lit(sum(255 << 8 * q for q in s) - (1 << 64 if 7 in s else 0)) for s in sets4]),
                            (F.shiftrightunsigned("entry", 32) + 1).cast("int"))
        flips = [sum(1 << i for i in c) for k in range(bits // 2 + 1) for c in combinations(range(64), k)]
        flips = F.array(*[F.lit(f - (1 << 64) if f >> 63 else f) for f in flips])
        outcome = (large.withColumn("flip", F.explode(F.filter(flips, lambda f: f.bitwiseAND(kept) == 0)))
                   .select("fingerprint", p.bitwiseXOR(F.col("flip")).alias("outcome"), "entry"))
        first = stored(outcome.groupBy("entry", "outcome").agg(
            F.min("fingerprint").alias("b"), F.max("fingerprint").alias("a")).filter("a <> b"))
        out = out.unionByName(
            outcome.join(first, ["entry", "outcome"]).select(p.alias("a"), "b").filter("a <> b").distinct())
    return out


# --- classes -----------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, seed: int = 42,
                    bits: int = 4, limit: int = ENTRY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in ``bits`` bits or fewer are linked; ``component_id`` is the
    smallest id that can be reached over links, the document's own included. Equal fingerprints are one
    entry of the index, so copies never make pairs. Empty and null texts have fingerprint zero and are
    linked like any other. A row without an id is linked too, but never names a component (null if no
    row of it has an id). Repeated rows come back as often. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, key, text, n, seed))
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    linked = stored(components(links(distinct.select("fingerprint"), bits, limit)).select(
        F.col("node").alias("fingerprint"), "root"))
    rooted = distinct.join(linked, "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    firsts = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(firsts, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one of the smallest id; its columns stay as they are.

    Of rows of one id and class the one of the smallest hash of its text stays, of rows that share their text too the
    first by its columns as JSON. Of the rows without an id one of each class stays, beside the one with an id.
    """
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    rows = near_duplicates(docs.select(row.alias("doc_id"), F.col(text).alias("text")), **settings)
    least = rows.groupBy("component_id", "doc_id.none").agg(F.min("doc_id").alias("_row"))
    sizes = rows.groupBy(F.col("doc_id").alias("_row")).count()
    first = stored(least.join(sizes, "_row").select(F.to_json("_row", {"ignoreNullFields": "false"}).alias("_row"), "count"))
    packed = docs.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("_row"), whole_row(docs))
    # Ids grow with the documents: they are hashed by the tasks that get them, at every size, and never broadcast.
    kept = packed.join(first.hint("shuffle_hash"), "_row", "left_semi")
    if not first.filter("`count` > 1").isEmpty():
        kept = kept.groupBy("_row").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return unpacked(kept)


@query("op9_simhash_near_duplicates")
def _op9(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
