import __spark_entry__ as entry
import corpus_pipeline as C
from pyspark.sql import functions as F

from parlance.llm import pii
from test_packing import check_pieces, slow_ids
from test_pii import brute as brute_pii
from test_simhash import brute_classes, brute_print
from test_winnow import brute as brute_winnow

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in C.STAGES:
        out = stage(spark, spark.createDataFrame(list(kept.values()), docs.schema), SF)
        rows = out.collect()
        if name == "quality":
            gone = [labels[i] for i in kept.keys() - {r["doc_id"] for r in rows} if i in labels]
            assert gone and sum(gone) <= 0.1 * len(gone)
            assert all(tuple(r) == tuple(kept[r["doc_id"]]) for r in rows)
        if name == "near_duplicates":
            ids = sorted(kept)
            roots = brute_classes([brute_print(kept[i]["text"]) for i in ids])
            assert {r["doc_id"] for r in rows} == {min(i for i, q in zip(ids, roots) if q == root) for root in set(roots)}
        if name == "decontamination":
            ids = sorted(kept)
            found = brute_winnow([kept[i]["text"] for i in ids], items)
            want = {i for i, (n, hit, _) in zip(ids, found) if not (hit and 20 * len(hit) >= n)}
            assert {r["doc_id"] for r in rows} == want and len(want) < len(ids)
        if name == "personal_data":
            assert {r["doc_id"] for r in rows} == set(kept)
            for r in rows:
                assert not brute_pii(r["text"]) and r["n_chars"] == len(r["text"])
                if not brute_pii(kept[r["doc_id"]]["text"]) and not any(c in kept[r["doc_id"]]["text"] for c in "0123456789@"):
                    assert tuple(r) == tuple(kept[r["doc_id"]])
        if name == "packing":
            texts = {i: kept[i]["text"] for i in kept}
            assert check_pieces([r.asDict() for r in rows], dict(zip(texts, slow_ids(texts.values()))), 1024) == 0
            continue
        assert out.columns == columns
        kept = {r["doc_id"]: r for r in rows}
        assert len(kept) == len(rows)


def test_run_is_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    sums = lambda df: df.agg(F.countDistinct("doc_id"), F.sum("length"), F.max("doc_tokens")).first()
    assert sums(entry.queries()["pipeline"](spark, SF)) == sums(docs)


def test_odd_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "mail a@b.cd now", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("found", F.lit("x"))
    for table in (docs, docs.limit(0)):
        out = table
        for name, stage in C.STAGES:
            out = stage(spark, out, SF)
            assert name == "packing" or out.columns == docs.columns
        assert (out.count() > 0) == (table is docs)
