import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import packing as P
from parlance.llm.catalog import queries


def slow_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(pieces, docs, size, exact=True):
    """``docs``: id -> ids. Every id in exactly one piece, sequences gapless and in bounds; returns padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(docs)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(docs[d])
            part = np.array(docs[d][at:at + p["length"]], "<u4").tobytes()
            assert (bytes(p["ids"]) == part) if "ids" in p else (p["ids_crc32"] == zlib.crc32(part))
            at += p["length"]
        assert at == len(docs[d])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


# An encoder for tests: one id per character.
NUMBERS = lambda: lambda text: np.array([ord(c) for c in text], np.uint32)


@pytest.mark.parametrize("size,windows,fan_in,parts", [(16, 4, 8, 7), (16, 1, 2, 3), (64, 8, 512, 1), (1, 2, 4, 3)])
def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark, size, windows, fan_in, parts):
    rng = random.Random(size + windows)
    texts = {i: "".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 3, 10, 15, 16, 17, 40, 200]))) for i in range(300)}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id bigint, text string, ids string, open int").repartition(parts)
    got = [r.asDict() for r in P.pack(df, NUMBERS, size=size, windows=windows, fan_in=fan_in).collect()]
    assert check_pieces(got, {i: [ord(c) for c in t] + [0] for i, t in texts.items()}, size) == 0


def test_best_fit_and_fullest():
    out = []
    p = P.Packer(10, 2, out.append)
    p.add("a", 0, np.arange(4), 4)
    p.add("b", 0, np.arange(7), 7)
    p.add("c", 0, np.arange(3), 3)  # fits both, fills b's window
    assert [[x[0] for x in w] for w in out] == [["b", "c"]]
    p.add("d", 0, np.arange(7), 7)  # opens a window
    p.add("e", 0, np.arange(9), 9)  # fits none: fills the fullest, the rest opens one
    assert [[(x[0], len(x[2])) for x in w] for w in out[1:]] == [[("d", 7), ("e", 3)], [("a", 4), ("e", 6)]]
    assert p.leftovers() == []


def test_ids_are_the_tokenizers(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a <|endoftext|> b", "it's  two   spaces\n\n x ", "Straße 123 été\t!", "日本語 text", "a" * 4000]
    texts += ["".join(rng.choice("ab é1 '\n!") for _ in range(400)) for _ in range(30)]
    encode = P.byte_bpe()()
    want = slow_ids(texts)
    assert [[*encode(t).tolist(), 0] for t in texts] == want
    monkeypatch.setattr(P, "TEXT_RUN", 20)
    assert [[*encode(t).tolist(), 0] for t in texts] == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = P.pack(df).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 2 * [r["doc_tokens"] for r in got if r["doc_id"] == 3][0]
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert P.pack(df.limit(0)).count() == 0


def test_query_is_brute_force_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [r.asDict() for r in queries()["op6_bounded_space_packing"](spark, sf).collect()]
    assert check_pieces(got, dict(zip([d["doc_id"] for d in docs], slow_ids([d["text"] for d in docs]))), 1024) == 0
