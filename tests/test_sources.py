import json
import re

import pytest

from parlance.operators.responses import flatten_buckets
from parlance.runtime import checkpoint_dir, stored
from parlance.schema import NODE_TYPES
from parlance.sources import kgdocs
from parlance.sources import transcripts as src
from parlance.sources import vocab as vb
from parlance.streaming.ingest import incremental_ingest_stream, transcript_stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_scan_transcripts(spark, tmp_path):
    put(tmp_path / "RES1" / "RES1.txt", "[D-1] D: a\n[P-1] P: b")
    put(tmp_path / "RES1" / "RES1_note.txt", "note")
    put(tmp_path / "RES_D2" / "RES_D2.txt", "D-1: ü")
    got = {r.res_id: r.text for r in src.scan_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"RES1": "[D-1] D: a\n[P-1] P: b", "RES_D2": "D-1: ü"}
    assert src.scan_transcripts(spark, str(tmp_path), ["RES1"]).count() == 1


def test_unknown_category_is_an_error(spark):
    df = spark.createDataFrame([("r", "A")], "res_id string, category string")
    with pytest.raises(ValueError):
        src.subset_filter(df, "res_id", category_col="category", categories=["B"], known=["A"])


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_kg_round_trip(spark, tmp_path, fmt):
    nodes = spark.createDataFrame([("R_1", f"N_{i}", f"t{i}", "SYMPTOM", "é", "P-1", 9 * i) for i in range(5)] + [("R1", "N_9", "t9", "SYMPTOM", "é", "P-1", 7)],
                                  "res_id string, id string, text string, type string, evidence string, turn_id string, ord bigint")
    edges = spark.createDataFrame([("R_1", "N_0", "N_1", "CAUSES", "", "", 0), ("R_2", "N_0", "N_1", "CAUSES", "", "", 0)],
                                  "res_id string, source_id string, target_id string, type string, evidence string, turn_id string, ord bigint")
    out = str(tmp_path / fmt)
    kgdocs.write_kg(nodes, edges, out, fmt)
    docs = kgdocs.read_kg(spark, out) if fmt == "json" else spark.read.parquet(out)
    assert docs.count() == 3 and spark.read.format(fmt).load(out).select("file_id").distinct().count() == 2  # R_1 and R1 stay two documents
    back_nodes, back_edges = kgdocs.explode_kg(docs)
    assert sorted((r.res_id, r.id, r.evidence, r.ord) for r in back_nodes.collect()) == [
        ("R1", "N_9", "é", 0), *(("R_1", f"N_{i}", "é", i) for i in range(5))]
    assert sorted(r.res_id for r in back_edges.collect()) == ["R_1", "R_2"]


def test_a_large_graph_is_written_as_it_passes(spark, tmp_path):
    n = 200_000
    nodes = spark.range(n).selectExpr("'R_1' res_id", "concat('N_', id) id", "concat('t', char(10), char(34), id) text", "'A' type",
                                      "'' evidence", "null turn_id", f"{n} - id ord")
    nodes = nodes.union(spark.range(3).selectExpr("concat('Q', id)", "'N'", "'one'", "'A'", "null", "'D-1'", "0L"))
    edges = spark.range(n).selectExpr("'R_1' res_id", "concat('N_', id) source_id", "'N_0' target_id", "'X' type", "'' evidence", "'' turn_id", "id ord")
    plan = kgdocs.kg_fragments(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    out = str(tmp_path / "large")
    kgdocs.write_kg(nodes, edges, out)
    back, links = kgdocs.explode_kg(kgdocs.read_kg(spark, out))
    assert back.filter("res_id = 'R_1'").count() == n == links.count() and back.count() == n + 3
    top = back.filter("res_id = 'R_1'").orderBy("ord").first()
    assert (top.id, top.text, top.turn_id) == (f"N_{n - 1}", f't\n"{n - 1}', None)
    assert [r.source_id for r in links.orderBy("ord").limit(3).collect()] == ["N_0", "N_1", "N_2"]


def test_graphs_are_dealt_by_their_rows_and_sorted_once(spark, tmp_path):
    nodes = spark.range(3000).selectExpr("concat('R', id div 3) res_id", "concat('N_', id) id", "'t' text", "'A' type", "'' evidence",
                                         "'' turn_id", "id ord")
    edges = nodes.filter("ord % 2 = 0").selectExpr("concat('E', res_id) res_id", "id source_id", "id target_id", "type", "evidence", "turn_id", "ord")
    lone = nodes.filter("ord % 7 = 0").selectExpr("res_id", "id source_id", "id target_id", "type", "evidence", "turn_id", "ord")
    pieces = kgdocs.kg_fragments(nodes, edges.unionByName(lone), task_rows=100)
    # As many tasks as rows ask for, whatever Spark's number of partitions; one row each, sorted for the window alone.
    assert pieces.rdd.getNumPartitions() == 50 and pieces.count() == 4929
    assert len(re.findall(r"(?m)^[ :+-]*Sort ", pieces._jdf.queryExecution().executedPlan().toString())) == 1
    pieces.write.text(str(tmp_path / "g"), lineSep=" ")
    docs = kgdocs.read_kg(spark, str(tmp_path / "g"))
    back, links = kgdocs.explode_kg(docs)
    # Graphs of nodes, of edges and of both.
    assert docs.count() == 2000 and docs.filter("nodes is null or edges is null").isEmpty()
    for got, want in ((back, nodes), (links, edges.unionByName(lone))):
        names = got.columns[:-1]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert back.filter("ord <> right(id, length(id) - 2) % 3").isEmpty()


def test_answers_as_lines(spark, tmp_path):
    out = str(tmp_path / "lines")
    spark.createDataFrame([("R_1", "SYMPTOM", [("a",)]), ("R_1", "SYMPTOM", [("b",), ("c",)]), ("R_2", "LAB", None)],
                          "res_id string, category string, other array<struct<text:string>>").write.json(out)
    got = kgdocs.read_category_results(spark, out, lines=True)
    assert sorted((r.res_id, r.category, len(r.other or [])) for r in got.collect()) == [("R_1", "SYMPTOM", 1), ("R_1", "SYMPTOM", 2), ("R_2", "LAB", 0)]


def test_read_kg_takes_id_from_file_name(spark, tmp_path):
    put(tmp_path / "RES7_v7.json", json.dumps({"nodes": [{"id": "N_001", "text": "x", "type": "SYMPTOM"}], "edges": [],
                                              "_usage": {"prompt_tokens": 1}}, indent=2))
    nodes, edges = kgdocs.explode_kg(kgdocs.read_kg(spark, str(tmp_path), multi_line=True))
    assert nodes.first().res_id == "RES7" and edges.count() == 0


def test_read_category_results(spark, tmp_path):
    for category, items in (("SYMPTOM", ["fever"]), ("MEDICAL_HISTORY", ["asthma"])):
        put(tmp_path / "RES_D1" / f"RES_D1_{category}.json", json.dumps(
            {"category": category, "status": "OK", "matched": [{"label": x, "turn_id": "P-1", "quote": "q"} for x in items],
             "other": [{"text": "y"}], "fine_grained": []}, indent=1))
    results = kgdocs.read_category_results(spark, str(tmp_path))
    assert {(r.res_id, r.category) for r in results.collect()} == {("RES_D1", "SYMPTOM"), ("RES_D1", "MEDICAL_HISTORY")}
    flat = flatten_buckets(results.selectExpr("*", "0L AS ord"), NODE_TYPES)
    assert [(r.id, r.text, r.type, r.bucket) for r in flat.orderBy("id").collect()] == [
        ("N_001", "fever", "SYMPTOM", "matched"), ("N_002", "y", "SYMPTOM", "other"),
        ("N_003", "asthma", "MEDICAL_HISTORY", "matched"), ("N_004", "y", "MEDICAL_HISTORY", "other")]


def test_vocab(spark):
    rows = [("symptom", " Fever", 2), ("SYMPTOM", "Fever", 1), ("", "x", 3), ("DRUG", "aspirin", 4), (None, "z", 5)]
    df = spark.createDataFrame(rows, "entity_type string, label string, ord int")
    assert sorted(tuple(r) for r in vb.load_vocab_by_type(df).collect()) == [("DRUG", "aspirin", 4), ("SYMPTOM", "Fever", 1)]
    assert vb.load_vocab_by_type(df, "sorted", NODE_TYPES).count() == 1


def test_union_splits_last_wins(spark):
    a = spark.createDataFrame([("e1", "train"), ("e2", "train")], "encounter_id string, note string")
    b = spark.createDataFrame([("e2", "test")], "encounter_id string, note string")
    assert sorted(tuple(r) for r in src.union_splits_last_wins([a, b], "encounter_id").collect()) == [("e1", "train"), ("e2", "test")]


def test_stored_results_live_in_the_checkpoint_folder(spark):
    df = stored(spark.range(5))
    assert df.count() == 5 and checkpoint_dir(spark).removeprefix("file:").strip("/") in df.inputFiles()[0]


def test_stream_reads_each_transcript_once(spark, tmp_path):
    vocab = spark.createDataFrame([("cough", "SYMPTOM"), ("chest pain", "SYMPTOM")], "label string, entity_type string")
    def run():
        incremental_ingest_stream(transcript_stream(spark, str(tmp_path / "in"), 1), vocab,
                                  str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.res_id, r.turn_id, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    put(tmp_path / "in" / "RES1" / "RES1.txt", "[P-1] P: a cough")
    put(tmp_path / "in" / "RES2" / "RES2.txt", "P-1: chest pain, cough")
    first = run()
    assert first == [("RES1", "P-1", "cough"), ("RES2", "P-1", "chest pain"), ("RES2", "P-1", "cough")]
    put(tmp_path / "in" / "RES3" / "RES3.txt", "D-1: cough?")
    put(tmp_path / "in" / "again" / "RES1" / "RES1.txt", "[P-1] P: a cough")
    assert run() == first + [("RES3", "D-1", "cough")]


def test_stream_takes_the_smallest_text_of_a_batch(spark, tmp_path):
    vocab = spark.createDataFrame([("cough", "SYMPTOM"), ("rash", "SYMPTOM")], "label string, entity_type string")
    put(tmp_path / "in" / "a" / "RES1.txt", "[P-1] P: rash")
    put(tmp_path / "in" / "b" / "RES1.txt", "[P-1] P: cough")
    put(tmp_path / "in" / "c" / "RES1.txt", "[P-2] P: rash")
    def run(out, state):
        incremental_ingest_stream(transcript_stream(spark, str(tmp_path / "in")), vocab, str(tmp_path / out),
                                  str(tmp_path / state)).awaitTermination()
        return [(r.res_id, r.label) for r in spark.read.parquet(str(tmp_path / out)).collect()]
    assert run("out1", "state1") == [("RES1", "cough")] == run("out2", "state2")
    # A batch whose commit was lost runs again, from the same state, over its own folder.
    commits = sorted((tmp_path / "state1" / "commits").glob("*"))
    for f in commits:
        f.unlink()
    assert run("out1", "state1") == [("RES1", "cough")]
    put(tmp_path / "in" / "d" / "RES1.txt", "[P-1] P: a rash")
    assert run("out1", "state1") == [("RES1", "cough")]
