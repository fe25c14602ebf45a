"""Language identification by mixtures: proportions by expectation-maximisation, the set by penalised likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import query, read, remainder, slices

# The model: hashed byte trigrams of so many buckets, from about so many documents of each language.
BUCKETS, SAMPLE_PER_LANGUAGE = 1 << 14, 4000
# The model takes 64 KB a language in every task; more languages than this (512 MB) are an error, none is left out.
LANGUAGES = 1 << 13
ROUNDS = 12
# Cost of a further language in units of the logarithm of the number of words.
PENALTY = 1.5
# Bytes of text handled at once with up to four languages, fewer with more: bytes times languages stay the same.
# Runs of one text are kept between the rounds up to so many bytes times languages, and made again beyond.
RUN, KEEP = 1 << 20, 1 << 25
# Languages that a task counts at once.
COUNTED = 64

# Letters as bytes: A-Z lower-cased, a-z, and all bytes of non-ASCII characters; all else is a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _letters(data: bytes) -> np.ndarray:
    """The letters of a text, with a space before and behind."""
    return np.concatenate([[np.uint8(32)], _LETTER[np.frombuffer(data, np.uint8)], [np.uint8(32)]])


def _trigrams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around every letter but the outer two places, and where words start among them."""
    b = letters.astype(np.uint32)
    at = np.flatnonzero(b[1:-1] != 32) + 1
    h = b[at - 1] * np.uint32(0x9E3779B1) ^ b[at] * np.uint32(0x85EBCA77) ^ b[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return ((h >> np.uint32(16)) % BUCKETS).astype(np.int64), np.flatnonzero(b[at - 1] == 32)


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return any(map(text.lower().__contains__, b"abcdefghijklmnopqrstuvwxyz"))
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass(frozen=True)
class Model:
    """Log-likelihoods ``table[bucket, language]``."""

    languages: tuple[str, ...]
    table: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Trigram counts of about ``sample`` documents of each language, taken by a hash of the text.

    Rows without a language or text are left out; every other language is learned. More than LANGUAGES distinct
    values are an error.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    rows = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"{lang} holds more than {LANGUAGES} languages")
    if not rows:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    # One row a language, LANGUAGES at most.
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in rows], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def rows_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
        sums.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                letters = _letters(value.as_py())
                for start in range(0, len(letters) - 2, RUN):
                    n = np.bincount(_trigrams(letters[start:start + RUN + 2])[0], minlength=BUCKETS)
                    sums[name] = sums.get(name, 0) + n
                if len(sums) > COUNTED:
                    yield from rows_of(sums)
        yield from rows_of(sums)

    def column(counts: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS)
        n[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
        likely = np.log((n + 0.2) / (n + 0.2).sum()).astype(np.float32)
        return pa.table({"lang": counts["lang"].slice(0, 1), "likely": pa.array([likely.tobytes()], pa.binary())})

    # A group is one language, with a row a bucket at most.
    learned = drawn.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).groupBy("lang").applyInArrow(column, "lang string, likely binary")
    names = sorted(r["lang"] for r in rows)
    place = {name: i for i, name in enumerate(names)}
    table = np.full((BUCKETS, len(names)), -np.log(BUCKETS), np.float32)
    for r in learned.toLocalIterator():
        table[:, place[r["lang"]]] = np.frombuffer(r["likely"], np.float32)
    return Model(tuple(names), table)


def run_bytes(languages: int) -> int:
    return max(1, RUN * 4 // max(4, languages))


def _runs(data: bytes, table: np.ndarray, run: int) -> Iterator[np.ndarray]:
    """Words x languages, in runs of about ``run`` bytes: the log-likelihood of each word, also of one over several runs."""
    letters = _letters(data)
    open_ = np.zeros((0, table.shape[1]))
    for start in range(0, len(data), run):
        part = letters[start:start + run + 2]
        buckets, starts = _trigrams(part)
        if not len(buckets):
            continue
        goes_on = starts[:1].tolist() != [0]
        sums = np.add.reduceat(table[buckets], np.concatenate([[0], starts]) if goes_on else starts, axis=0).astype(np.float64)
        if goes_on:
            sums[0] += open_[0]
        else:
            sums = np.concatenate([open_, sums])
        open_ = sums[-1:]
        if len(sums) > 1:
            yield sums[:-1]
    if len(open_):
        yield open_


def _word_likelihoods(data: bytes, table: np.ndarray, run: int | None = None) -> np.ndarray:
    """Words x languages: the log-likelihood of each word."""
    return np.concatenate([np.zeros((0, table.shape[1])), *_runs(data, table, run or run_bytes(table.shape[1]))])


def _mixture(relative: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once: proportions, and the log-likelihood of the mixture relative to the scale.

    ``relative``: words x languages, likelihoods up to a factor of each word; a text's words stand together.
    """
    share = start
    for _ in range(ROUNDS):
        part = relative * np.repeat(share, sizes, axis=0)
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / sizes[:, None]
    total = (relative * np.repeat(share, sizes, axis=0)).sum(1)
    return share, np.add.reduceat(np.log(total), first)


def _mixture_in_runs(runs: Callable[[], Iterable[np.ndarray]], size: int, start: np.ndarray) -> tuple[np.ndarray, float]:
    """The same EM for one text whose words come in runs: a round adds up what its runs give."""
    share = start
    for _ in range(ROUNDS):
        total = np.zeros(len(start))
        for relative in runs():
            part = relative * share
            part /= part.sum(1, keepdims=True)
            total += part.sum(0)
        share = total / size
    return share, float(sum(np.log(relative @ share).sum() for relative in runs()))


def _choose(single: np.ndarray, share: np.ndarray, mixed: float, size: int,
            fit: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]]) -> list[tuple[int, float]]:
    """The set of the highest penalised likelihood; ``fit(languages, start)`` gives a set's proportions and likelihood."""
    best, cost = int(single.argmax()), PENALTY * np.log(size + 1)
    choice, value = [(best, float(1 / np.exp(single - single[best]).sum()))], float(single[best])
    order = np.argsort(-share, kind="stable")
    for n in range(2, len(single) + 1):
        # No set of more languages beats the full mixture's likelihood less the further languages' cost.
        if mixed - (n - 1) * cost <= value:
            break
        some = order[:n]
        start = np.maximum(share[some], 1e-3)
        s, ll = fit(some, start / start.sum())
        if ll - (n - 1) * cost > value:
            value = float(ll - (n - 1) * cost)
            choice = [(int(some[r]), float(s[r])) for r in np.argsort(-s, kind="stable")]
    return choice


def infer_long(data: bytes, table: np.ndarray, run: int) -> list[tuple[int, float]]:
    """What ``infer`` gives for one text, in memory bounded by the run, the text and eight bytes a word."""
    k = table.shape[1]
    top: list[np.ndarray] = []
    single = np.zeros(k)
    for logs in _runs(data, table, run):
        top.append(logs.max(1, keepdims=True))
        single += np.maximum(logs - top[-1], -50.0).sum(0)
    size = sum(map(len, top))
    if not size:
        return []

    def runs(some: np.ndarray, least: float) -> Callable[[], Iterable[np.ndarray]]:
        columns = np.ascontiguousarray(table[:, some])
        again = lambda: (np.exp(np.maximum(x - m, -50.0)) + least for x, m in zip(_runs(data, columns, run), top))
        if len(data) * len(some) > KEEP:
            return again
        kept = list(again())
        return lambda: kept

    share, mixed = _mixture_in_runs(runs(np.arange(k), 0.0), size, np.full(k, 1 / k))
    return _choose(single, share, mixed, size, lambda some, start: _mixture_in_runs(runs(some, 1e-300), size, start))


def infer(likelihoods: list[np.ndarray]) -> list[list[tuple[int, float]]]:
    """For every text the chosen languages and their proportions, the largest first; none for a text without words.

    A single language keeps its posterior against the other single ones as its figure.
    """
    out: list[list[tuple[int, float]]] = [[] for _ in likelihoods]
    full = [i for i, x in enumerate(likelihoods) if len(x)]
    if not full:
        return out
    sizes = np.array([len(likelihoods[i]) for i in full])
    first = np.cumsum(sizes) - sizes
    logs = np.concatenate([likelihoods[i] for i in full])
    logs = np.maximum(logs - logs.max(1, keepdims=True), -50.0)
    relative = np.exp(logs)
    k = logs.shape[1]
    single = np.add.reduceat(logs, first, axis=0)
    share, mixed = _mixture(relative, first, sizes, np.full((len(full), k), 1 / k))
    for j, i in enumerate(full):
        part = relative[first[j]:first[j] + sizes[j]]

        def fit(some: np.ndarray, start: np.ndarray, part=part) -> tuple[np.ndarray, float]:
            s, ll = _mixture(part[:, some] + 1e-300, np.zeros(1, np.int64), np.array([len(part)]), start[None])
            return s[0], float(ll[0])

        out[i] = _choose(single[j], share[j], float(mixed[j]), int(sizes[j]), fit)
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, languages (lang, share; the largest first), lang_pred, score``.

    A text's words are drawn from a mixture of the model's languages; the share of each is found by EM from
    trigram likelihoods of all its words, and of the sets of the n likeliest languages the one of the highest
    penalised likelihood is taken. A null text, one without a letter, or any under an empty model is ``und`` with
    score 0. Ties go to the first language by name. Repeated rows are treated one by one; an empty table gives an
    empty one. A text of any length is taken word by word: one longer than a run is read run by run in every round, in
    time proportional to its length and to the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        size = run_bytes(len(names))
        for batch in batches:
            for start, texts in slices(batch.column(1), size):
                if names and len(texts) == 1 and len(texts[0]) > size:
                    chosen = [infer_long(texts[0], table, size) if has_letter(texts[0]) else []]
                else:
                    chosen = infer([_word_likelihoods(t, table, size) if names and has_letter(t) else np.zeros((0, 1)) for t in texts])
                langs = [[{"lang": names[i], "share": s} for i, s in c] for c in chosen]
                yield pa.record_batch([
                    batch.column(0).slice(start, len(texts)),
                    pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    pa.array([c[0]["lang"] if c else "und" for c in langs], pa.string()),
                    pa.array([min(1.0, c[0]["share"]) if c else 0.0 for c in langs])], ["doc_id", "languages", "lang_pred", "score"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, languages array<struct<lang:string,share:double>>, lang_pred string, score double")


@query("op7_language_mixture")
def _op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lambda: remainder(F.col("doc_id"), 4) == 2
    return identify(docs, learn(docs.filter(~held()))).withColumn("held_out", held())
