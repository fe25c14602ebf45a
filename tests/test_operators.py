from pyspark.sql import functions as F

from parlance.operators import extract as ex
from parlance.operators import filters as fl
from parlance.operators import identity as idt
from parlance.operators import linking as ln
from parlance.operators import stats as st
from parlance.operators import turns as tn
from parlance.plans.enrich import enrich_graph
from parlance.rules import clinical
from parlance.runtime import first_wins, running_counts

NODE = "res_id string, id string, text string, type string, evidence string, turn_id string, ord bigint"
EDGE = "res_id string, source_id string, target_id string, type string, evidence string, turn_id string, ord bigint"


def nodes(spark, *rows):
    return spark.createDataFrame([("r", i, t, k, e, "", n) for n, (i, t, k, e) in enumerate(rows, 1)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([("r", s, t, k, "", "", n) for n, (s, t, k) in enumerate(rows, 1)], EDGE)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_running_counts_equal_row_number_when_a_hot_key_is_cut(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
                                  .alias("k"), F.col("id").alias("o"))
    cut = running_counts(df, ["k"], ["o"], "o", {"n": None, "even": F.col("o") % 2 == 0}, slot_rows=7)
    whole = running_counts(df, ["k"], ["o"], "o", {"n": None, "even": F.col("o") % 2 == 0})
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        n, e = want.get(r.k, [(0, 0)])[-1] if r.k in want else (0, 0)
        want.setdefault(r.k, []).append((n + 1, e + (r.o % 2 == 0)))
    for got in (cut, whole):
        per_key = {}
        for r in sorted(got.collect(), key=lambda r: r.o):
            per_key.setdefault(r.k, []).append((r.n, r.even))
        assert per_key == want


def test_first_wins_keeps_column_order(spark):
    df = spark.createDataFrame([(2, "a", "late"), (1, "a", "early"), (3, "b", "only")], "o int, k string, v string")
    out = first_wins(df, ["k"], ["o"])
    assert out.columns == ["o", "k", "v"] and rows(out, "k", "v") == [("a", "early"), ("b", "only")]


def test_both_layouts_give_the_same_turns_and_the_last_repeat_wins(spark):
    a = "[D-1] D: hello there\n\n[P-1] P: hi\n\n[D-2] D: so\nhow are you?\n\n[P-1] P: again"
    b = "D-1: hello there\nP-1: hi\nD-2: so\nhow are you?\nP-1: again\n"
    df = spark.createDataFrame([("a", a), ("b", b), ("c", "no markers")], "res_id string, text string")
    got = rows(tn.segment_marked_turns(df), "res_id", "turn_id", "speaker", "text")
    want = [("D-1", "D", "hello there"), ("D-2", "D", "so\nhow are you?"), ("P-1", "P", "again")]
    assert got == [("a", *w) for w in want] + [("b", *w) for w in want]


def test_dialogue_to_turns(spark):
    df = spark.createDataFrame([("r", "[doctor] a [patient] b [dragon] x [doctor]  [patient] c")], "res_id string, dialogue string")
    got = tn.dialogue_to_turns(tn.split_dialogue(df, ["doctor", "patient", "dragon"]), {"doctor": "D", "patient": "P"})
    assert rows(got, "turn_id", "text", "seq") == [("D-1", "a", 1), ("P-1", "b", 2), ("P-2", "c", 3)]
    assert tn.render_transcript(got).first()["text"] == "D-1: a\nP-1: b\nP-2: c"


def test_merge_nodes_first_wins_and_ids_have_no_gaps(spark):
    raw = nodes(spark, ("", "Covid", " diagnosis ", "first"), ("", "x", "BAD", ""), ("", "covid 19", "DIAGNOSIS", "second"),
                ("", " ", "SYMPTOM", ""), ("", "fever.", "symptom", ""))
    got = rows(idt.merge_nodes(raw, clinical.ALIASES), "id", "text", "type", "evidence")
    assert got == [("N_001", "covid-19", "DIAGNOSIS", "first"), ("N_002", "fever", "SYMPTOM", "")]


def test_renumber_drops_edges_to_dropped_nodes_instead_of_rewiring(spark):
    # N_001 is dropped; after renumbering the old N_002 takes its id. An edge to the old N_001 must vanish.
    n = nodes(spark, ("N_001", "x", "BAD", ""), ("N_002", "cough", "SYMPTOM", ""), ("N_003", "flu", "DIAGNOSIS", ""))
    e = edges(spark, ("N_001", "N_003", "INDICATES"), ("N_002", "N_003", "INDICATES"))
    out_nodes, out_edges = idt.renumber_graph(n, e)
    assert rows(out_nodes, "id", "text") == [("N_001", "cough"), ("N_002", "flu")]
    assert rows(out_edges, "source_id", "target_id") == [("N_001", "N_002")]


def test_rewrite_merges_losers_into_survivors(spark):
    n = nodes(spark, ("N_001", "cough", "SYMPTOM", ""), ("N_002", "dry cough", "SYMPTOM", ""), ("N_003", "flu", "DIAGNOSIS", ""))
    e = edges(spark, ("N_002", "N_003", "indicates"), ("N_001", "N_003", "INDICATES"), ("N_001", "N_002", "CAUSES"))
    r = spark.createDataFrame([("r", "N_002", "Cough"), ("r", "N_003", " ")], "res_id string, id string, text string")
    out_nodes, out_edges = idt.rewrite_and_remap(n, e, r)
    assert rows(out_nodes, "id", "text") == [("N_001", "cough"), ("N_002", "flu")]
    assert rows(out_edges, "source_id", "target_id", "type", "ord") == [("N_001", "N_002", "INDICATES", 1)]


def test_validate_graph_grounds_nodes(spark):
    n = nodes(spark, ("a", "cough", "SYMPTOM", "I cough a lot"), ("b", "flu", "DIAGNOSIS", "this was never said by anybody"),
              ("c", "rash", "SYMPTOM", ""))
    t = spark.createDataFrame([("r", "D: so? P: I  cough a lot")], "res_id string, text string")
    assert rows(idt.validate_graph(n, edges(spark, ("a", "b", "INDICATES"), ("a", "c", "CAUSES")), t)[0], "text") == [
        ("cough",), ("rash",)]
    assert rows(idt.validate_graph(n, edges(spark, ("a", "b", "INDICATES"), ("a", "c", "CAUSES")), t)[1], "type") == [("CAUSES",)]


def test_grounding_reads_transcripts_in_parts(spark):
    t = spark.createDataFrame([("r", "one two three four"), ("r", "five six seven two")], "res_id string, text string")
    n = nodes(spark, ("a", "x", "SYMPTOM", "six SEVEN"), ("b", "x", "SYMPTOM", "one five two nine six"),
              ("c", "x", "SYMPTOM", "one nine eight ten two"), ("d", "x", "SYMPTOM", None))
    assert rows(fl.grounding_filter(n, t), "id") == [("a",), ("b",), ("d",)]


def test_resolve_endpoints_prefers_allowed_types_in_order(spark):
    n = nodes(spark, ("n1", "Asthma", "LOCATION", ""), ("n2", "asthma", "DIAGNOSIS", ""), ("n3", "pets", "TREATMENT", ""),
              ("n4", "pets", "LAB_RESULT", ""))
    t = spark.createDataFrame([("r", "CAUSES", " PETS ", "asthma", 1), ("r", "LOCATED_AT", "pets", "asthma", 2),
                               ("r", "CAUSES", "ghost", "asthma", 3)], "res_id string, category string, src string, dst string, ord int")
    got = rows(ln.resolve_endpoints(t, n, clinical.ENDPOINT_PRIORITY), "ord", "source_id", "target_id")
    assert got == [(1, "n3", "n2"), (2, "n3", "n1"), (3, None, "n2")]
    assert rows(ln.unresolved_edges(ln.resolve_endpoints(t, n, clinical.ENDPOINT_PRIORITY)).filter("category is null"),
                "src", "dst", "both", "total") == [(1, 0, 0, 1)]


def test_rule_counts():
    per_set = {}
    for rule_set, *_ in clinical.relation_rules():
        per_set[rule_set] = per_set.get(rule_set, 0) + 1
    assert per_set == {"located_at": 18, "indicates": 46, "taken_for": 42, "rules_out": 30, "confirms": 2, "causes": 33}
    assert (len(clinical.ALIASES), len(clinical.PATTERNS), len(clinical.ALLOWED_PAIRS)) == (73, 100, 24)


def test_clinical_enrichment_end_to_end(spark):
    text = ("[D-1] D: what brings you in?\n[P-1] P: I have green phlegm, I was wheezing at night\n"
            "[D-2] D: use ventolin, it sounds like an asthma exacerbation")
    n = nodes(spark, ("N_001", "wheezing", "SYMPTOM", "wheezing"), ("N_002", "no pets", "MEDICAL_HISTORY", ""))
    out_nodes, out_edges = enrich_graph(n, edges(spark), spark.createDataFrame([("r", text)], "res_id string, text string"))
    texts = {r.text: (r.type, r.turn_id) for r in out_nodes.collect()}
    assert "no pets" not in texts and texts["green sputum"] == ("SYMPTOM", "P-1") and texts["ventolin"] == ("TREATMENT", "D-2")
    named = fl.with_endpoints(out_edges, out_nodes)
    got = {(r.src_text, r.type, r.tgt_text) for r in named.collect()}
    assert ("wheezing", "INDICATES", "asthma exacerbation") in got and ("ventolin", "TAKEN_FOR", "wheezing") in got


def test_type_priority_of_inferred_edges(spark):
    n = nodes(spark, ("a", "chest pain", "DIAGNOSIS", "d"), ("b", "chest pain", "SYMPTOM", ""), ("c", "chest", "LOCATION", "loc"))
    got = rows(ln.infer_edges(n, clinical.relation_rules(), ["located_at"]), "source_id", "target_id", "type", "evidence")
    assert got == [("b", "c", "LOCATED_AT", "loc")]


def test_negation_blocks_edges(spark):
    n = nodes(spark, ("a", "absent fever", "SYMPTOM", ""), ("b", "flu", "DIAGNOSIS", ""), ("c", "no asthma", "DIAGNOSIS", ""))
    e = edges(spark, ("a", "b", "INDICATES"), ("a", "b", "RULES_OUT"), ("b", "c", "CONFIRMS"), ("b", "c", "INDICATES"))
    assert rows(fl.negation_blocks_edges(e, n, clinical.NEGATION_CHECKS), "type", "target_id") == [
        ("INDICATES", "c"), ("RULES_OUT", "b")]


def test_keep_ids_filter_without_decision_keeps_all(spark):
    c = spark.createDataFrame([("r", "1"), ("r", "2"), ("s", "3")], "res_id string, id string")
    d = spark.createDataFrame([("r", "2")], "res_id string, id string")
    assert rows(fl.keep_ids_filter(c, d), "res_id", "id") == [("r", "2"), ("s", "3")]


def vocab(spark):
    return spark.createDataFrame([("chest pain", "SYMPTOM"), ("pain", "SYMPTOM"), ("fever", "SYMPTOM"), ("chills", "SYMPTOM"),
                                  ("x-ray", "PROCEDURE"), ("asthma", "DIAGNOSIS")], "label string, entity_type string")


def turns(spark, *lines):
    return spark.createDataFrame([("r", i, f"{s}-{i}", s, t) for i, (s, t) in enumerate(lines, 1)],
                                 "res_id string, seq bigint, turn_id string, speaker string, text string")


def test_lexicon_and_nesting(spark):
    t = turns(spark, ("P", "My chest  pain, and painful pain; the X ray"))
    found = ex.lexicon_extract(t, vocab(spark), ["res_id", "seq"])
    assert rows(found, "label", "start", "n") == [("chest pain", 1, 2), ("pain", 2, 1), ("pain", 5, 1), ("x-ray", 7, 2)]
    assert rows(ex.longest_match(found, ["res_id", "seq"]), "label", "start") == [("chest pain", 1), ("pain", 5), ("x-ray", 7)]
    assert rows(ex.longest_match(found, ["res_id", "seq"], "shortest"), "label", "start") == [
        ("pain", 2), ("pain", 5), ("x-ray", 7)]


def test_stacked_questions(spark):
    blanket = turns(spark, ("D", "any fever or chills?"), ("P", "Nope, none"), ("D", "chest pain?"), ("P", "no"))
    assert rows(ex.negated_findings(blanket, vocab(spark), clinical.BLANKET_NEGATIVE), "turn_id", "text") == [
        ("P-2", "absent chills"), ("P-2", "absent fever"), ("P-4", "absent chest pain"), ("P-4", "absent pain")]
    partial = turns(spark, ("D", "any fever or chills?"), ("P", "some chills"))
    assert rows(ex.negated_findings(partial, vocab(spark), clinical.BLANKET_NEGATIVE), "text", "denied") == [
        ("absent fever", True), ("chills", False)]


def test_exam_denials(spark):
    t = turns(spark, ("D", "No evidence of fever. Asthma is normal, clear of chills; no worries"))
    assert rows(ex.exam_denials(t, vocab(spark), clinical.EXAM_DENIALS, ["res_id"]), "text") == [
        ("absent asthma",), ("absent chills",), ("absent fever",)]


def test_retyping(spark):
    t = turns(spark, ("D", "x-ray unremarkable, my mother has asthma. history of fever. x-ray done"))
    found = ex.lexicon_extract(t, vocab(spark), ["res_id"], context=3)
    got = rows(ex.outcome_retype(found, clinical.OUTCOME_ANCHORS), "text", "type")
    assert ("x-ray unremarkable", "LAB_RESULT") in got and ("x-ray", "PROCEDURE") in got
    got = rows(ex.history_retype(found, clinical.HISTORY_CUES, clinical.RELATIVES), "text", "type")
    assert ("family history of asthma", "MEDICAL_HISTORY") in got and ("history of fever", "MEDICAL_HISTORY") in got


def test_bucket_assign(spark):
    m = spark.createDataFrame([("Chest pain",), ("severe chest pain",), ("itch",)], "text string")
    assert rows(ex.bucket_assign(m, vocab(spark)), "text", "bucket", "coarse_candidate") == [
        ("Chest pain", "matched", None), ("itch", "other", None), ("severe chest pain", "fine_grained", "chest pain")]


def test_candidate_edges_equal_brute_force(spark):
    data = [("r", (i * 7) % 13, f"t{i % 4}", ["SYMPTOM", "DIAGNOSIS", "LOCATION"][i % 3]) for i in range(40)]
    df = spark.createDataFrame(data, "res_id string, seq bigint, text string, type string")
    want = {}
    for _, qa, a, ka in data:
        for _, qb, b, kb in data:
            for rel, s, t in clinical.ALLOWED_PAIRS:
                if (ka, kb) == (s, t) and abs(qa - qb) <= 2 and (a, ka) != (b, kb):
                    gap, n = want.get((rel, a, ka, b, kb), (99, 0))
                    want[rel, a, ka, b, kb] = (min(gap, abs(qa - qb)), n + 1)
    got = {(r.edge_type, r.src_text, r.src_type, r.tgt_text, r.tgt_type): (r.min_gap, r.cooccurrences)
           for r in ln.candidate_edges(df, clinical.ALLOWED_PAIRS, 2).collect()}
    assert got == want


def test_retry_stats(spark):
    a = spark.createDataFrame([
        ("c1", 1, False, 429, False, False), ("c1", 2, True, 200, False, False), ("c2", 1, True, 200, False, False),
        ("c3", 1, False, 503, False, False), ("c3", 2, False, None, True, False), ("c3", 3, False, 200, False, True)],
        "call_id string, attempt int, ok boolean, status int, network boolean, empty boolean")
    r = st.retry_stats(a).first()
    assert (r.total_calls, r.attempt_1, r.attempt_2, r.attempt_3, r.failed_after_all) == (3, 1, 1, 0, 1)
    assert (r.err_429, r.recovered_429, r.err_5xx, r.recovered_5xx, r.err_network, r.err_empty_content) == (1, 1, 1, 0, 1, 1)


def test_large_rule_tables_need_no_list(spark):
    n = nodes(spark, ("a", "Word 7", "SYMPTOM", ""), ("b", "word 7", "DIAGNOSIS", ""), ("c", "other", "SYMPTOM", ""))
    stop = spark.range(20_000).selectExpr("'SYMPTOM' as kind", "concat('word ', id) as word")
    assert rows(fl.stop_mentions(n, stop), "id") == [("b",), ("c",)]
    listed = [("SYMPTOM", f"word {i}") for i in range(20_000)]
    assert rows(fl.stop_mentions(n, listed), "id") == [("b",), ("c",)]


def test_a_null_order_keeps_its_row(spark):
    raw = spark.createDataFrame([("r", "", "b", "SYMPTOM", "", "", None), ("r", "", "a", "SYMPTOM", "", "", 5)],
                                "res_id string, id string, text string, type string, evidence string, turn_id string, ord bigint")
    assert rows(idt.merge_nodes(raw), "id", "text") == [("N_001", "a"), ("N_002", "b")]


def test_endpoints_share_one_index_and_an_untyped_node_is_no_preferred_one(spark):
    n = spark.createDataFrame([("r", "n1", "pets", None, 1), ("r", "n2", "pets", "TREATMENT", 2), ("r", "n3", "dust", None, 3)],
                              "res_id string, id string, text string, type string, ord int")
    t = spark.createDataFrame([("r", "CAUSES", "pets", "dust", 1), ("r", "OTHER", "pets", "dust", 2)],
                              "res_id string, category string, src string, dst string, ord int")
    found = ln.resolve_endpoints(t, n, {"CAUSES": (["DIAGNOSIS", "TREATMENT"], ["SYMPTOM"])})
    assert rows(found, "ord", "source_id", "target_id") == [(1, "n2", "n3"), (2, "n1", "n3")]
    # One shuffle makes the index, and both sides of an edge ask it for the same columns.
    index = ln._endpoint_index(n, ["A", "B"])._jdf.queryExecution().executedPlan().toString()
    assert index.count("Exchange hashpartitioning") == 1


def test_texts_of_merged_nodes_are_made_once(spark):
    n = nodes(spark, ("a", "The Cough", "SYMPTOM", ""), ("b", "cough", "SYMPTOM", ""), ("c", "rash", "SYMPTOM", ""))
    _, e = idt.renumber_graph(n, edges(spark, ("a", "c", "CAUSES"), ("b", "c", "CAUSES"), ("a", "b", "CAUSES")))
    assert rows(e, "source_id", "target_id") == [("N_001", "N_002")]
    # Neither the numbering nor either end of an edge normalises the texts again.
    assert "regexp" not in e._jdf.queryExecution().optimizedPlan().toString()


def test_type_pairs_drop_unnamed_relations_before_the_joins(spark):
    n = nodes(spark, ("a", "x", "SYMPTOM", ""), ("b", "y", "DIAGNOSIS", ""))
    e = edges(spark, ("a", "b", "INDICATES"), ("a", "b", "CAUSES"))
    found = fl.type_pair_filter(e, n, [("INDICATES", "SYMPTOM", "DIAGNOSIS"), (None, "SYMPTOM", "DIAGNOSIS")])
    assert rows(found, "type", "src_text", "tgt_text") == [("INDICATES", "x", "y")]
    assert "= INDICATES" in found._jdf.queryExecution().optimizedPlan().toString()
    assert fl.type_pair_filter(e, n, []).count() == 0
