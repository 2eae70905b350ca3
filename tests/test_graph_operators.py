"""Extraction, candidates, graph, diff, retrieval and the pipeline on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.ontology import Ontology
from graphloom.operators import candidates, diff, embed, entities, graph, relations, retrieval, review
from graphloom.plans.pipeline import Pipeline
from graphloom.streaming import ingest

ONTOLOGY = Ontology()


def chunks(spark, *contents, path=None):
    return spark.createDataFrame([(f"c{i}", "d", path, x) for i, x in enumerate(contents)], "chunk_id string, document string, section_path string, content string")


def found(spark, *contents, path=None):
    return {(r.name, r.type) for r in entities.raw_entities(chunks(spark, *contents, path=path), ONTOLOGY).collect()}


def test_entities(spark):
    assert found(spark, "The Change of Address Process starts.") == {("Change of Address Process", "Process")}
    assert found(spark, "we use Account-Managing System for the rest") == {("Account-Managing System", "System")}
    assert found(spark, "An App. The DB and a Service. COA, Kafka, IVR") == {("DB", "Database"), ("COA", "Process"), ("Kafka", "Technology"), ("IVR", "Channel")}
    assert found(spark, "x", path="A > Mortgage address") == {("Mortgage address", "Topic")}
    assert found(spark, "x", path="d") == set() and found(spark, None) == set()
    raw = entities.raw_entities(chunks(spark, "Billing Service and billing", "The BILLING Service. Billing Service"), ONTOLOGY)
    ents = entities.entities(raw).collect()
    assert [(e.id, e.name, e.source_chunk) for e in ents if e.type == "Service"] == [("entity_service_billing_service", "Billing Service", "c0")]
    assert {(m.chunk_id, m.entity_id) for m in entities.mentions(raw).collect()} == {("c0", "entity_service_billing_service"), ("c1", "entity_service_billing_service")}


def test_one_id_keeps_the_last_found(spark):
    ents = entities.entities(entities.raw_entities(chunks(spark, "Foo-Bar System", "Foo Bar System"), ONTOLOGY))
    assert ents.count() == 2 and [r.name for r in entities.one_per_id(ents).collect()] == ["Foo Bar System"]


def test_relationships(spark):
    text = "Billing Service depends on Ledger Database. Ledger Database must reach Mail API. Audit Team causes Billing Service trouble."
    c = chunks(spark, text, text, "Billing Service uses Billing Service.")
    raw = entities.raw_entities(c, ONTOLOGY)
    got = {tuple(r) for r in relations.extract_relationships(c, entities.one_per_id(entities.entities(raw)), entities.mentions(raw)).collect()}
    s, d, a, t = "entity_service_billing_service", "entity_database_ledger_database", "entity_api_mail_api", "entity_team_audit_team"
    assert got == {(s, "DEPENDS_ON", d, "c0"), (d, "REQUIRES", a, "c0"), (t, "USES", s, "c0")}


def test_model_route(spark):
    c = chunks(spark, "Billing Service", "nothing here", "bad")
    m = entities.mentions(entities.raw_entities(c, ONTOLOGY))
    routed = entities.route(c, m).where("to_model")
    assert {r.chunk_id for r in routed.collect()} == {"c1", "c2"}

    def model(rows):
        if any(r["chunk_id"] == "c2" for r in rows):
            raise RuntimeError("down")
        ents = [{"name": " Foo ", "type": "Team", "confidence_score": "7"}, {"name": "foo", "type": "Team"}, {"name": "X", "type": "Unknown"}, {"name": "Bar", "type": "API"}]
        rels = [{"source": "FOO", "relationship": "OWNS", "target": "bar"}, {"source": "Foo", "relationship": "OWNS", "target": "Foo"}, {"source": "Foo", "relationship": "HATES", "target": "Bar"}]
        return json.dumps({"chunks": [{"chunk_id": "c1", "entities": ents, "relationships": rels}, {"chunk_id": "other", "entities": ents, "relationships": rels}]})

    parsed = entities.parse_responses(entities.call_model(routed, model, batch=1)).cache()
    named = entities.model_entities(parsed, ONTOLOGY)
    assert {(r.name, r.type, r.confidence_score) for r in named.collect()} == {("Foo", "Team", 1.0), ("Bar", "API", 0.5)}
    ids = named.withColumn("entity_id", F.lower("name"))
    assert [(r.source, r.relationship, r.target) for r in relations.model_relationships(parsed, ids, ONTOLOGY).collect()] == [("foo", "OWNS", "bar")]
    bad = spark.createDataFrame([(["c1"], "not json"), (["c1"], None)], "chunk_ids array<string>, response string")
    assert entities.parse_responses(bad).count() == 0


def test_candidates(spark):
    c = chunks(spark, "  First\nline ", "second", "  First\nline ", "third", "fourth", "   ")
    ents = spark.createDataFrame([("e1", "Data Store", "Database"), ("e2", "Done", "Team"), ("e3", "Alone", "Team")], "id string, name string, type string")
    m = spark.createDataFrame([(f"c{i}", "d", "e1", 0) for i in range(6)] + [("c1", "d", "e2", 0), ("gone", "d", "e1", 0)], "chunk_id string, document string, entity_id string, pos int")
    old = spark.createDataFrame([("e2", "APPROVED"), ("e1", "NEW")], "id string, status string")
    got = {r.id: r for r in candidates.build_entities(ents, m, c, "now", ONTOLOGY, old).collect()}
    assert set(got) == {"e1", "e3"}
    e = got["e1"]
    assert e.confidence_score == 0.7 and e.evidence == ["First line", "second", "third"] and e.source_documents == ["d"] and len(e.source_chunks) == 7
    assert e.possible_meanings[0] == "Database Store" and e.history[0].comment == "Auto-created from 7 mention(s). Flagged for ambiguity."
    assert got["e3"].confidence_score == 0 and got["e3"].evidence == [] and got["e3"].definition.startswith("Alone is a concept")
    rels = spark.createDataFrame([("e1", "USES", "e2", "c1"), ("e1", "USES", "e2", "c3"), ("e1", "OWNS", "zz", "gone")], "source string, relationship string, target string, source_chunk string")
    rows = {r.id: r for r in candidates.build_relationships(rels, candidates.mention_counts(ents, m), c, "now").collect()}
    assert rows["rel__e1__USES__e2"].confidence_score == 0.4 and rows["rel__e1__USES__e2"].evidence == ["second", "third"]
    assert rows["rel__e1__OWNS__zz"].confidence_score == 0.6 and rows["rel__e1__OWNS__zz"].evidence == []
    done = spark.createDataFrame([("rel__e1__USES__e2", "REJECTED")], "id string, status string")
    assert candidates.build_relationships(rels, candidates.mention_counts(ents, m), c, "now", done).count() == 1


def review_tables(spark):
    e = [("a", "A", "APPROVED", None), ("b", "B", "APPROVED", None), ("m", "M", "MERGED", "a"), ("n", "N", "MERGED", "p"), ("p", "P", "NEW", None), ("r", "R", "REJECTED", None)]
    ents = spark.createDataFrame([(i, n, "System", s, ["c1", "c2"] if i == "a" else [], x) for i, n, s, x in e], "id string, name string, entity_type string, status string, source_chunks array<string>, merged_into string")
    r = [("m", "USES", "b", "APPROVED"), ("a", "USES", "m", "APPROVED"), ("a", "OWNS", "b", "REJECTED"), ("p", "OWNS", "b", "NEW"), ("n", "OWNS", "b", "APPROVED"), ("a", "USES", "b", "APPROVED"), ("a", "X", "zz", "APPROVED")]
    rels = spark.createDataFrame([("__".join(x[:3]), *x, 0.5) for x in r], "id string, source_entity string, relationship_type string, target_entity string, status string, confidence_score double")
    return ents, rels


def test_candidate_and_approved_graph(spark):
    ents, rels = review_tables(spark)
    nodes, mentions, edges = graph.candidate_graph(ents, rels)
    assert {r.id for r in nodes.collect()} == {"a", "b", "p"} and {r.chunk_id for r in mentions.collect()} == {"c1", "c2"}
    assert sorted(tuple(r) for r in edges.collect()) == [("a", "USES", "b"), ("a", "USES", "b"), ("p", "OWNS", "b")]
    m = spark.createDataFrame([("c1", "a"), ("c1", "m"), ("c2", "m"), ("c3", "r")], "chunk_id string, entity_id string")
    nodes, kept, edges = graph.approved_graph(ents, rels, m)
    assert {r.id for r in nodes.collect()} == {"a", "b"} and [tuple(r) for r in kept.collect()] == [("c1", "a")]
    assert {tuple(r) for r in graph.approved_graph(ents, rels, m, remap_mentions=True)[1].collect()} == {("c1", "a"), ("c2", "a")}
    assert edges.count() == 2
    with pytest.raises(ValueError):
        graph.require_approved(nodes.limit(0))


def test_graph_diff(spark):
    ents, rels = review_tables(spark)
    base = spark.createDataFrame([("a", "Old", "System"), ("m", "M", "System"), ("n", "N", "System"), ("r", "R", "System"), ("x", "X", "System")], "id string, name string, type string")
    got = {r.id: (r.change, r.survivor) for r in diff.entity_diff(base, ents).collect()}
    assert got == {"a": ("modified", None), "m": ("merged", "a"), "n": ("removed", None), "r": ("removed", None), "x": ("removed", None), "b": ("added", None), "p": ("added", None)}
    was = spark.createDataFrame([("a", "USES", "b"), ("q", "USES", "b")], "source string, relationship string, target string")
    edges = diff.relationship_diff(was, ents, rels)
    assert {tuple(r) for r in edges.collect()} == {("q", "USES", "b", "removed"), ("p", "OWNS", "b", "added")}
    assert tuple(diff.deltas(diff.entity_diff(base, ents), edges).first()) == (-2, 0)
    assert tuple(diff.deltas(diff.entity_diff(base.limit(0), ents.limit(0)), edges.limit(0)).first()) == (0, 0)


def test_earlier_state_is_cut_by_time_alone(spark, tmp_path):
    import datetime

    from graphloom.plans import reference

    early, late = datetime.datetime(2000, 1, 1), datetime.datetime(2100, 1, 1)
    rows = [(" A ", "uses", "b", "9999999", early), ("c", "USES", "d", None, early), ("e", "USES", "f", "1000000", late), (None, "USES", "f", "1", early)]
    spark.createDataFrame(rows, "source string, relationship string, target string, source_chunk string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/relationships.parquet")
    got = {tuple(r) for r in reference._loaded_before(spark, str(tmp_path), reference._EARLIER).collect()}
    assert got == {("a", "USES", "b"), ("c", "USES", "d")}


def test_extraction_over_whole_texts(spark, tmp_path):
    from graphloom.plans.reference import QUERIES

    text = "A fee of £20 — paid. Café Billing Service uses Ledger API. Łódź Billing System depends on Mail Service."
    rows = [("c1", "d1", None, text, None, False)]
    spark.createDataFrame(rows, "chunk_id string, document string, section_path string, content string, loaded_at timestamp_ntz, is_deleted boolean").write.parquet(f"{tmp_path}/chunks.parquet")
    ask = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    sentences = [r.sentence for r in sorted(ask("r1_sentences"), key=lambda r: r.sentence_no)]
    assert sentences == ["A fee of £20 — paid.", "Café Billing Service uses Ledger API.", "Łódź Billing System depends on Mail Service."]
    spans = {(r.sentence_no, r.span_start, r.span_end) for r in ask("r2_triggers")}
    assert {(1, sentences[1].index("uses"), sentences[1].index("uses") + 4), (2, sentences[2].index("depends on"), sentences[2].index("depends on") + 10)} <= {(n, sentences[n].index(sentences[n][a:b].strip()), a + len(sentences[n][a:b].rstrip())) for n, a, b in spans}
    # a word that goes on with another letter is no name, and never a part of one
    cut = lambda name: {r.phrase for r in ask(name) if "Caf" in r.phrase}
    assert cut("x1_phrases") == set()


def test_links_and_loading(spark):
    text = "smallblueAn adulthttps://w/pages/2/Q19smallbluehttps://w/pages/9/x smallblue A childhttps://w/pages/3/y"
    docs = spark.createDataFrame([("1", "One", "p", text, None), ("2", "Two Q1 ", "p", None, "1"), ("3", "Three", "p", "", " ")], "document_id string, document_name string, source_path string, markdown string, parent_page_id string")
    links = {tuple(r) for r in graph.link_candidates(docs).collect()}
    assert links == {("1", "2", "An adult", True), ("1", "9", "", False), ("1", "3", "A child", True)}
    ents = spark.createDataFrame([("e1", "E", "API", "c0"), ("e2", "F", "System", "c0")], "id string, name string, type string, source_chunk string")
    c = chunks(spark, "x").withColumn("document", F.lit("1"))
    m = spark.createDataFrame([("c0", "e1"), ("c0", "e1"), ("c0", "gone")], "chunk_id string, entity_id string")
    r = spark.createDataFrame([("e1", "USES", "e2", "c0"), ("e1", "USES", "e2", "c1"), ("e1", "OWNS", "e2", "c0"), ("e1", "HATES", "e2", "c0"), ("e1", "USES", "zz", "c0")], "source string, relationship string, target string, source_chunk string")
    g = graph.build_graph(docs, c, ents, m, r)
    assert {x.kind: (x.n_submitted, x.n_effective) for x in graph.load_stats(g).collect()} == {
        "documents": (3, 3), "chunks": (1, 1), "entities": (2, 2), "has_chunk": (1, 1), "mentions": (3, 1), "relationships": (5, 2), "hierarchy": (1, 1), "links": (2, 2),
    }
    assert [x.relationship for x in graph.collapse_types(graph.loadable(g).relationships).collect()] == ["USES"]
    assert {x.document_id for x in diff.orphan_documents(docs, g.hierarchy, g.links).collect()} == set()
    assert {x.document_id for x in diff.names_without(docs).collect()} == {"1", "3"}


def trail_model(edges, seeds, hops, directed):
    out = set()

    def walk(source, at, used, labels):
        if labels and at not in seeds:
            out.add((source, at, tuple(labels)))
        if len(labels) < hops:
            for i, (a, b, t) in enumerate(edges):
                if i not in used:
                    for x, y in {(a, b)} if directed else {(a, b), (b, a)}:
                        if x == at:
                            walk(source, y, used | {i}, [*labels, t])

    for s in seeds:
        walk(s, s, frozenset(), [])
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_trails(spark, directed):
    rnd = random.Random(9)
    edges = [(rnd.choice("abcdefgh"), rnd.choice("abcdefgh"), rnd.choice("XY")) for _ in range(18)] + [("a", "b", "X"), ("a", "b", "X")]
    df = spark.createDataFrame(edges, "a string, b string, label string")
    seeds = spark.createDataFrame([("a",), ("c",)], "id string")
    for hops in (1, 3):
        got = {(r.source_id, r.target_id, tuple(r.labels)) for r in retrieval.trails(df, seeds, hops, directed).collect()}
        assert got == trail_model(edges, {"a", "c"}, hops, directed)


def test_clamps_and_breadth_first(spark):
    assert retrieval.clamp(999, 0) == (3, 1) and retrieval.clamp(0, 1000) == (1, 100)
    df = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("a", "c", "Z"), ("c", "d", "X")], "a string, b string, label string")
    got = {tuple(r) for r in retrieval.breadth_first(df, spark.createDataFrame([("a",)], "id string"), 2, True).collect()}
    assert got == {("b", "a", "X", 1), ("c", "a", "Z", 1), ("d", "c", "X", 2)}


def test_mentioned_takes_every_chunk(spark):
    m = spark.createDataFrame([(f"c{i}", f"e{i}") for i in range(300)], "chunk_id string, entity_id string")
    ents = spark.createDataFrame([(f"e{i}", f"E{i}", "API") for i in range(300)], "id string, name string, type string")
    asked = m.select("chunk_id").where("chunk_id <> 'c7'")
    got = [r.entity_id for r in retrieval.mentioned(m, ents, asked.unionByName(asked)).collect()]
    assert sorted(got) == sorted(f"e{i}" for i in range(300) if i != 7)


def test_every_query_apart(spark):
    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.choice("abcdefgh"), rnd.choice("XY"), rnd.choice("abcdefgh")) for _ in range(14)], "source string, relationship string, target string")
    ents = spark.createDataFrame([(x, x.upper(), "API") for x in "abcdefgh"], "id string, name string, type string")
    seeds = [("q1", "a"), ("q1", "c"), ("q2", "c"), ("q3", "h")]
    for hops in (1, 2):
        got = [tuple(r) for r in retrieval.neighbors_each(ents, edges, spark.createDataFrame(seeds, "query string, id string"), hops, 3).collect()]
        want = []
        for q in ("q1", "q2", "q3"):
            own = spark.createDataFrame([(i,) for x, i in seeds if x == q], "id string")
            want += [(q, *r) for r in retrieval.neighbors(ents, edges, own, hops, 3).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    # a hub beside a seed, parallel edges, ends that are no entities
    edges = [("s", "X", "hub"), ("s", "X", "hub"), ("t", "Y", "hub"), ("hub", "Y", "gone"), *(("hub", "XY"[i % 2], f"n{i:02d}") for i in range(60))]
    ents = spark.createDataFrame([(x, "Same" if x in "st" else x, "API") for x in ("s", "t", "hub", *(f"n{i:02d}" for i in range(60)))], "id string, name string, type string")
    seeds = [("q1", "s"), ("q1", "t"), ("q1", "n00"), ("q2", "hub"), ("q3", "n05"), ("q4", "none")]
    edges, asked = spark.createDataFrame(edges, "source string, relationship string, target string"), spark.createDataFrame(seeds, "query string, id string")
    for hops, limit in ((2, 7), (3, 5)):
        got = [tuple(r) for r in retrieval.neighbors_each(ents, edges, asked, hops, limit).collect()]
        want = []
        for q in ("q1", "q2", "q3", "q4"):
            want += [(q, *r) for r in retrieval.neighbors(ents, edges, asked.where(f"query = '{q}'").select("id"), hops, limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    links = edges.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.col("relationship").alias("answer_label"))
    docs, e = ents.select("id", "name"), edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("relationship").alias("label"))
    for q in ("q1", "q2", "q3"):
        own = asked.where(f"query = '{q}'").select("id")
        for each, one in ((retrieval.linked_documents_each(docs, links, asked, 2, 6), retrieval.linked_documents(docs, links, own, 2, 6)), (retrieval.breadth_first_each(e, asked, 2), retrieval.breadth_first(e, own, 2))):
            assert sorted(map(tuple, each.where(f"query = '{q}'").drop("query").collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert retrieval.neighbors_each(ents, edges, asked.limit(0), 2, 5).count() == 0
    v = spark.createDataFrame([(i, [rnd.choice([0.0, 1.0, 2.0]), rnd.choice([0.0, 1.0])]) for i in range(40)] + [(40, None), (41, [1.0])], "chunk_id int, embedding_vector array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "query int, v array<float>")
    for r in q.collect():
        each = [x.chunk_id for x in retrieval.top_k_each(v, q, 4, per_pass=2).where(f"query = {r.query}").orderBy(F.desc(F.round("similarity", 9)), "chunk_id").collect()]
        assert each == [x.chunk_id for x in retrieval.top_k(v, r.v, 4).orderBy(F.desc(F.round("similarity", 9)), "chunk_id").collect()]


def test_breadth_first_shuffles_no_found_node(spark):
    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}", rnd.choice("XYZ")) for _ in range(90)] + [("hub", f"n{i:02d}", "X") for i in range(0, 60, 2)]
    edges = spark.createDataFrame([*rows, ("n01", "n01", "W"), ("n03", "n04", None)], "a string, b string, label string")
    asked = spark.createDataFrame([("q1", "hub"), ("q1", "n01"), ("q2", "n03"), ("q3", "n05"), ("q3", "n05"), ("q4", "none")], "query string, id string")
    for hops, directed in ((1, False), (2, True), (3, False)):
        want = [(q, *r) for q in ("q1", "q2", "q3") for r in retrieval.breadth_first(edges, asked.where(f"query = '{q}'").select("id"), hops, directed).collect()]
        for walked in (retrieval.WALKED, 70):  # all edges at once, and parts of the targets
            got = retrieval.breadth_first_each(edges, asked, hops, directed, walked)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = retrieval.breadth_first_each(edges, asked, 2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Exchange")[0]  # nothing moves what was found
    assert retrieval.breadth_first_each(edges.limit(0), asked, 2).count() == retrieval.breadth_first_each(edges, asked.limit(0), 2).count() == 0


def test_retrieval(spark):
    c = spark.createDataFrame([("c0", "d1", "about billing"), ("c1", "d2", "about mail")], "id string, document string, content string")
    embedder = embed.hashing_embedder(16)
    vectors = embed.embed_chunks(c.withColumnRenamed("id", "chunk_id"), embedder, "h-16", batch=1)
    ents = spark.createDataFrame([("e1", "Billing", "Service"), ("e2", "Mail", "API")], "id string, name string, type string")
    m = spark.createDataFrame([("c0", "e1")], "chunk_id string, entity_id string")
    e = spark.createDataFrame([("e2", "USES", "e1")], "source string, relationship string, target string")
    docs = spark.createDataFrame([("d1", "One"), ("d2", "Two"), ("d3", "Three")], "id string, name string")
    links = spark.createDataFrame([("d1", "d2", "yes"), ("d2", "d3", "")], "source_id string, target_id string, answer_label string")
    ask = lambda q, **k: retrieval.retrieve(q, lambda t: embedder([t])[0], c, vectors, ents, m, e, docs, links, **k)
    got = ask("about billing", top=1)
    assert [x["chunk_id"] for x in got.chunks] == ["c0"] and got.graph_paths == ["Billing USES Mail"]
    assert [x["name"] for x in got.entities] == ["Billing", "Mail"] and got.next_steps == ["If yes: see Two", "If yes: see Three"]
    text = retrieval.context_text(got)
    assert "<<<BEGIN_UNTRUSTED_DOCUMENT_EXCERPT>>>about billing<<<END_UNTRUSTED_DOCUMENT_EXCERPT>>>" in text and "- Mail (API)" in text
    assert retrieval.context_text(retrieval.Context()).startswith("No approved")
    for bad in (" ", "x" * 4001):
        with pytest.raises(ValueError):
            ask(bad)
    with pytest.raises(ValueError):
        retrieval.query_graph(spark, {}, "drop table x")
    assert retrieval.query_graph(spark, {"ents": ents}, "select id from ents where type = :t", {"t": "API"}).first().id == "e2"
    assert embed.no_embedding(c.withColumnRenamed("id", "chunk_id")).first().embedding_vector is None


def test_actions_and_summaries(spark):
    schema = "id string, name string, status string, entity_type string, merged_into string, source_documents array<string>, possible_meanings array<string>, history array<struct<timestamp:string,reviewer:string,action:string,comment:string>>"
    rows = spark.createDataFrame([("a", "A", "NEW", "T", None, ["d"], ["x"], [("1", "p", "created", "c")]), ("b", "B", "MERGED", "T", "a", None, [], None)], schema)
    act = "id string, action string, reviewer string, timestamp string, comment string, updates map<string,string>"
    actions = spark.createDataFrame([("a", "approve", "r", "3", None, {"status": "APPROVED"}), ("a", "edit", "r", "2", "n", {"name": "AA", "status": "NEW"}), ("zz", "edit", "r", "2", "n", None), ("b", "clear", "r", "2", None, {"merged_into": None})], act)
    got = {r.id: r for r in review.apply_actions(rows, actions).collect()}
    assert (got["a"].name, got["a"].status, [h.action for h in got["a"].history]) == ("AA", "APPROVED", ["created", "edit", "approve"])
    assert got["b"].merged_into is None and len(got["b"].history) == 1 and got["b"].name == "B"
    assert tuple(review.overview(rows).first()) == (1, 2, 1, 1, 1)
    assert review.pending_ambiguous(rows).count() == 1 and review.filter_rows(rows, [], None).count() == 0
    assert {r.id: r.display_name for r in review.display_names(rows).collect()} == {"a": "A", "b": "B (merged into A)"}


def test_pipeline_runs_again_without_change(spark, tmp_path):
    text = "# Guide\n\nBilling Service depends on Ledger Database.\n\n## Part\n\nAudit Team owns Billing Service."
    docs = spark.createDataFrame([("1", "One", text, "h1", None), ("2", "Two", "plain", "h2", "1")], "document_id string, document_name string, markdown string, content_hash string, parent_page_id string")
    p = Pipeline(spark, str(tmp_path), "now", ONTOLOGY, embed.hashing_embedder(8))
    assert {r.change for r in p.ingest(docs).collect()} == {"added"}
    e = p._read("candidate_entities")
    assert {r.name for r in e.collect()} >= {"Billing Service", "Ledger Database", "Audit Team", "Guide"}
    with pytest.raises(ValueError):
        p.publish_graph()
    from graphloom.sources.sinks import overwrite

    for t in ("candidate_entities", "candidate_relationships"):
        overwrite(p._read(t).withColumn("status", F.lit("APPROVED")), p.root, t)
    before = sorted(map(str, p._read("candidate_entities").collect()))
    assert p.ingest(docs).count() == 0
    assert p.candidates() == {"candidate_entities": 0, "candidate_relationships": 0}
    assert sorted(map(str, p._read("candidate_entities").collect())) == before
    stats = {r.kind: r.n_effective for r in p.publish_graph().collect()}
    assert stats["documents"] == 2 and stats["relationships"] >= 2 and stats["hierarchy"] == 1
    p.publish_ontology()
    assert p._read("approved_relationships").count() >= 2


def test_stream(spark, tmp_path):
    from graphloom.contracts import conform

    def add(k, *rows):
        df = spark.createDataFrame([(i, v, t) for i, v, t in rows], "document_id string, version int, markdown string")
        conform(df, "markdown").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    root = str(tmp_path / "out")
    run = lambda: ingest.start(spark, str(tmp_path / "in"), root, str(tmp_path / "cp")).awaitTermination()
    add(1, ("a", 1, "one"), ("b", 1, "two"))
    run()
    add(2, ("a", 2, "three"), ("a", 1, "one again"), ("c", 5, "five"), ("c", 4, "four"))
    run()
    add(3, ("c", 3, "three"), ("b", 1, "two again"))
    run()
    from graphloom.sources.files import read_table

    assert {(r.document, r.content) for r in read_table(spark, root, "chunks").collect()} == {("a", "three"), ("b", "two again"), ("c", "five")}
    assert {(r.document_id, r.version, r.markdown) for r in read_table(spark, root, "markdown").collect()} == {("a", 2, "three"), ("b", 1, "two again"), ("c", 5, "five")}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(list(itertools.islice(e.queries(), 60))) == 60
