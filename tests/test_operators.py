"""Hand-computed expectations of the retrieval operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.functions import question as Q
from citegrain.functions import text as T
from citegrain.operators import blocks, chunking, dense, evaluate, evidence, freshness, fusion, grounding, layout, lexical
from citegrain.plans import catalogue, pipeline
from citegrain.schemas import RetrievalConfig
from citegrain.sources import readers
from citegrain.streaming import streams


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def pool(spark, rows):
    return spark.createDataFrame(rows, "qid long, chunk_id string, doc_id string, score double")


def test_tokens_keep_names_and_negation(spark):
    found = one(spark, T.tokens("t"), t="U-Net reached 0.94 Dice on KiTS23 using AdamW and scGPT, not all")
    assert {"u-net", "0.94", "kits23", "adamw", "scgpt", "not", "all"} <= set(found) and "and" not in found
    assert one(spark, T.tokens("t"), t="scGPT.") == ["scgpt."]


def test_null_text(spark):
    row = spark.createDataFrame([(None,)], "t string").select(T.tokens("t"), T.sentences("t"), T.squeeze("t"), T.looks_like_bibliography("t")).first()
    assert list(row) == [[], [""], "", False]


def test_fusion_and_ties(spark):
    hits = lambda ids: spark.createDataFrame([(1, c, i + 1, 0.0) for i, c in enumerate(ids)], "qid long, chunk_id string, rank int, score double")
    rows = fusion.rrf({"dense": hits(["a", "c"]), "bm25": hits(["b", "c"])}).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c", "a", "b"] and rows[0].sources == ["bm25", "dense"]
    assert rows[1].score == pytest.approx(1 / 61)
    first = fusion.rrf({"dense": hits(["d"]), "bm25": hits(["b"])}, weights={"dense": 2}).orderBy("rank").first()
    assert first.chunk_id == "d"


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcdefghij")], "qid long, chunk_id string, rank int")
    wanted = spark.createDataFrame([(1, "b"), (1, "e")], "qid long, chunk_id string")
    asked = spark.createDataFrame([(1,), (2,)], "qid long")
    a, b = evaluate.per_question(asked, hits, wanted).orderBy("qid").collect()
    import math

    assert (a.recall_5, a.recall_10, a.precision_5, a.mrr_10) == (1.0, 1.0, 0.4, 0.5)
    assert a.ndcg_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(6)) / (1 + 1 / math.log2(3)))
    assert (b.n_relevant, b.recall_5, b.mrr_10, b.ndcg_10) == (0, 0.0, 0.0, 0.0)
    assert spark.createDataFrame([(10,), (20,), (30,), (40,)], "x int").agg(evaluate.upper_median("x")).first()[0] == 30


def test_diversify(spark):
    rows = pool(spark, [(1, f"c{i}", "d", 9.0 - i) for i in range(8)])
    assert evidence.diversify(rows, 3, 8).count() == 3 and evidence.diversify(rows, 8, 8).count() == 8


def test_live_floor(spark):
    corpus = pool(spark, [(1, "c1", "a", 0.84), (1, "c2", "b", 0.5)])
    live = pool(spark, [(1, "l1", "x", 1.24), (1, "l2", "y", -0.89)])
    assert [r.chunk_id for r in evidence.merge_live(live, corpus).orderBy("rank").collect()] == ["l1", "c1", "c2"]
    low = evidence.merge_live(pool(spark, [(1, "l1", "x", -1.16)]), pool(spark, [(1, "c1", "a", -0.97)]))
    assert [r.chunk_id for r in low.orderBy("rank").collect()] == ["l1", "c1"]


def test_upload_has_no_floor_and_library_merge(spark):
    merged = evidence.merge_uploaded(pool(spark, [(1, "u", "u", -9.0)]), pool(spark, [(1, "c", "c", 5.0)]))
    assert {r.chunk_id for r in merged.collect()} == {"u", "c"}
    corpus = pool(spark, [(1, "c1", "a", 4.0), (1, "c2", "b", 3.0), (1, "c3", "c", 2.0)])
    added = pool(spark, [(1, "l1", "x", 5.0), (1, "l2", "y", 0.1)])
    assert [r.chunk_id for r in evidence.merge_library(added, corpus, 4).orderBy("rank").collect()] == ["l1", "c1", "c2", "c3"]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "Mixed [2; 4] and single [1]."), (2, "All invented [88, 99]."), (3, "Nothing here.")], "qid long, raw string")
    ev = spark.createDataFrame([(q, k, f"c{k}", "d", "some  text") for q in (1, 2, 3) for k in range(1, 5)], "qid long, rank int, chunk_id string, doc_id string, text string")
    texts, citations = grounding.resolve(answers, ev)
    got = {r.qid: (r.text, r.grounded) for r in texts.collect()}
    assert got == {1: ("Mixed [1][2] and single [3].", True), 2: ("All invented.", False), 3: ("Nothing here.", False)}
    assert [(r.marker, r.chunk_id, r.quote) for r in citations.orderBy("marker").collect()] == [(1, "c2", "some text"), (2, "c4", "some text"), (3, "c1", "some text")]


def test_ask_without_evidence(spark):
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "qid long, question string")
    ev = spark.createDataFrame([(1, 1, "c", "d", "Kidneys were segmented. More.")], "qid long, rank int, chunk_id string, doc_id string, text string")
    got = {r.qid: (r.text, r.n_citations) for r in grounding.ask(asked, ev)[0].collect()}
    assert got == {1: ("Kidneys were segmented. [1]", 1), 2: (grounding.NO_EVIDENCE, 0)}


def test_quote_is_cut_at_a_space(spark):
    got = one(spark, grounding.quote(F.col("t")), t="word " * 100)
    assert got.endswith("word…") and len(got) <= 321


def test_prompt_clauses(spark):
    row = spark.createDataFrame([(1, "What are the recent limitations compared with others?", "[1] x", 2, 1, 5, None, None)], "qid long, question string, context string, n_live int, n_yours int, n_passages int, history_question string, history_answer string")
    user = grounding.build_prompt(row).first().user
    assert "2 passages are abstracts" in user and "1 passages of the reader's own, 2 recent abstracts and 2 indexed" in user


def test_conversation_pairs(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "d")], "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in grounding.conversation_pairs(rows).collect()] == [("b", "c")]


def test_chunks_stay_in_sections_and_references_are_skipped(spark):
    sentence = "This sentence carries a claim about kidney segmentation performance. "
    schema = "doc_id string, title string, sections array<struct<kind:string,heading:string,page_start:int,page_end:int,text:string>>"
    doc = ("d", "t", [("methods", "M", 1, 2, sentence * 40), ("results", "R", 3, 3, sentence * 3), ("references", "X", 4, 4, sentence * 9), ("other", "S", 5, 5, "short")])
    rows = chunking.chunk_documents(spark.createDataFrame([doc], schema)).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows))) and {r.section_kind for r in rows} == {"methods", "results"}
    assert all(len(r.text) <= 1100 for r in rows) and rows[1].text.startswith(sentence.strip())
    assert chunking.repeated_ids(spark.createDataFrame([(r.chunk_id,) for r in rows], "chunk_id string")).count() == 0


def test_question_shapes(spark):
    row = spark.range(1).select(Q.asks_for_survey(F.lit("A recurrent network")), Q.compares_with_online(F.lit("compare liver")), Q.asks_for_limitations(F.lit("it can't")), Q.asks_about_owner(F.lit("your email")), Q.asks_about_owner(F.lit("who is quill"), ("quill",))).first()
    assert list(row) == [True, True, True, True, True]  # phrases are substrings: "recurrent" holds "current"
    assert one(spark, Q.resolve_anaphora(F.col("q"), "Ada Quill"), q="what are the author's strengths") == "what are Ada Quill strengths"


def test_dense_zero_vector_and_k(spark):
    assert one(spark, dense.normalise("v"), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, dense.normalise("v"), v=[3.0, 4.0]) == [0.6, 0.8]
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r.chunk_id for r in dense.cosine_topk(asked, rows, 2).orderBy("rank").collect()] == ["a", "c"]
    assert dense.cosine_topk(asked, rows, 0).count() == 0


def test_configuration_needs_a_retriever():
    with pytest.raises(ValueError):
        RetrievalConfig("none", False, False)


def test_search_on_a_subset_keeps_global_statistics(spark):
    rows = spark.createDataFrame([(f"{d}:{i}", d, f"kidney scan {d} number{i}") for d in "abc" for i in range(5)], "chunk_id string, doc_id string, text string")
    asked = spark.createDataFrame([(1, "kidney number3"), (2, "zzz")], "qid long, question string")
    index = pipeline.build(rows, None)
    only = pipeline.search(asked, index, RetrievalConfig("b", False, True), spark.createDataFrame([("b",)], "doc_id string"))
    every = {(r.qid, r.chunk_id): r.bm25_score for r in lexical.bm25(asked, index.lexical, 30).withColumnRenamed("score", "bm25_score").collect()}
    found = only.collect()
    assert {r.chunk_id.split(":")[0] for r in found} == {"b"} and all(r.bm25_score == every[r.qid, r.chunk_id] for r in found)
    with pytest.raises(ValueError):
        pipeline.search(asked, index, RetrievalConfig("d", True, False))


def test_headings(spark):
    head = lambda t, size=9.0, bold=False: one(spark, layout.looks_like_heading(F.col("t"), F.lit(size), F.lit(bold), F.lit(9.0)), t=t)
    assert head("2 Methods", bold=True) and head("RESULTS") and not head("This sentence ends here.", 12.0) and not head("12 - 14", 12.0) and not head("a, b", 12.0)
    assert one(spark, layout.classify(F.col("t")), t="3. Materials & Methods:") == "methods"


def test_bundle_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("d:0", "d", 0, "text", "title")], "chunk_id string, doc_id string, ordinal int, text string, doc_title string")
    vectors = spark.createDataFrame([("d:0", [1.0])], "chunk_id string, vector array<double>")
    readers.write_bundle(chunks, vectors, str(tmp_path), embedding_model="m", chunking=chunking.fingerprint())
    rows, docs = readers.read_bundle(spark, str(tmp_path), "m")
    assert rows.first().vector == [1.0] and docs.first().title == "title"
    with pytest.raises(ValueError):
        readers.read_bundle(spark, str(tmp_path), "other")


def test_question_file(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('// comment\n\n{"_meta": {"chunking": "c1000-o180"}}\n{"question": "a", "relevant_chunks": ["x"]}\n')
    rows, meta = readers.read_json_lines(spark, str(tmp_path / "q.jsonl"), "question string, relevant_chunks array<string>")
    assert [r.question for r in rows.collect()] == ["a"] and "c1000-o180" in meta.first().meta


def test_captured_feed(spark):
    xml = "<feed><entry><id>http://x/abs/2401.00001v2</id><title>A  b</title><summary> s </summary><published>2024-05-01T00:00:00Z</published><author><name>N</name></author></entry><entry><id>http://x/abs/2001.00001v1</id><title>old</title><summary>s</summary><published>2020-01-01T00:00:00Z</published><author><name>N</name></author></entry></feed>"
    rows = readers.atom_entries(spark.createDataFrame([(1, xml)], "qid long, xml string"), "2024-06-01").collect()
    assert [(r.paper_id, r.title, r.published) for r in rows] == [("2401.00001", "A b", "2024-05-01")]


def test_sessions_and_empty_tables(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(30)), (3, 1, at(95)), (4, 2, at(1))], "event_id long, user_id long, ts timestamp")
    assert sorted((r.user_id, r.n_events) for r in streams.sessions(rows).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [r.user_id for r in streams.live_sessions(rows, at(100), most=1).collect()] == [1]
    empty = spark.createDataFrame([], "chunk_id string, doc_id string, text string")
    asked = spark.createDataFrame([(1, "a b")], "qid long, question string")
    assert pipeline.search(asked, pipeline.build(empty), RetrievalConfig()).count() == 0
    assert streams.rate_limit(rows.limit(0)).count() == 0


def test_pools_are_composed(spark):
    ranks = lambda rows: evidence.ranked(pool(spark, rows))
    corpus = ranks([(q, f"c{k}", f"d{k // 3}", 9.0 - k) for q in (1, 2, 3) for k in range(6)])
    library, uploads = ranks([(2, "l0", "m", 8.5)]), ranks([(3, f"u{k}", "mine", 1.0 - k) for k in range(3)])
    out = pipeline.compose(corpus, library, uploads, 6)
    got = {q: [r["chunk_id"] for r in out.where(F.col("qid") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert got == {1: [f"c{k}" for k in range(6)], 2: ["c0", "l0", "c1", "c2", "c3", "c4"], 3: ["u0", "u1", "u2", "c0", "c1", "c3"]}
    assert {r["chunk_id"] for r in out.where("reserved").collect()} == {"l0", "u0", "u1", "u2"}


def test_partition_search_and_retrieve(spark):
    def chunks(rows):
        return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")

    corpus = pipeline.build(chunks([("c0", "a", "graph neural networks for molecules"), ("c1", "b", "protein folding with attention")]))
    library = pipeline.build(chunks([("l0", "l", "graph attention for molecules")]))
    asked = spark.createDataFrame([(1, "graph molecules")], "qid long, question string")
    hits = pipeline.search_partition(asked, library, RetrievalConfig(top_k=5), "library").collect()
    assert [r["chunk_id"] for r in hits] == ["l0"] and "library" in hits[0]["sources"]
    assert pipeline.search_partition(asked, library, RetrievalConfig(top_k=5), "library", spark.createDataFrame([("a",)], "doc_id string")).count() == 0
    assert {r["chunk_id"] for r in pipeline.retrieve(asked, corpus, library).collect()} == {"c0", "c1", "l0"}


def test_empty_snapshots(spark):
    snapshot = spark.createDataFrame([], "key long, fetched_at timestamp, failed_at timestamp, etag string, body string")
    requests = spark.createDataFrame([(1,)], "key long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert [r["action"] for r in freshness.read_decisions(requests, snapshot).collect()] == ["fetch"]
    failed = freshness.take_responses(snapshot, requests.select("key", "ts", F.lit(503).alias("status"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("body")))
    assert [r["action"] for r in freshness.read_decisions(requests, failed).collect()] == ["wait"]
    assert [r["blocked"] for r in freshness.cooling(requests, requests.limit(0)).collect()] == [False]


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path, parts):
    rows = [(1, "cats sit, cats run"), (2, "dogs run"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    if parts:
        frame.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        frame.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    stream = streams.read_stream(spark, str(tmp_path), "documents").select("text")
    found = streams.drain(streams.stream_document_frequencies(stream), ["term"], "update")
    assert {r["term"]: r["df"] for r in found.collect()} == {"cats": 1, "sit": 1, "run": 2, "dogs": 1}


def _odd_documents(spark):
    """Copies, ties, repeated words, null and empty texts, and ids that several rows share."""
    import random

    deal = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "de", "L-1", "Zürich", "3.5"]
    texts = [" ".join(words[min(int(deal.expovariate(0.08)), len(words) - 1)] for _ in range(deal.randint(1, 30))) for _ in range(150)]
    rows = [(i, texts[i % 110] if i % 7 else texts[3] if i % 2 else "de de la " + texts[i]) for i in range(150)]
    rows += [(20, texts[5]), (20, texts[6]), (33, texts[8]), (33, texts[8]), (None, texts[9]), (None, texts[10]), (151, None), (160, ""), (180, "the of"), (200, "unseen " * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk_id", F.col("doc_id").cast("string")).repartition(5)


@pytest.mark.parametrize("limits", [{}, {"first": 16, "ratio": 2, "most": 60}, {"first": 1, "ratio": 3, "most": 1}])
def test_blocks_find_what_the_join_finds(spark, limits):
    rows = _odd_documents(spark)
    asked = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("qid"), F.substring("text", 1, 30).alias("question"))
    index = lexical.build_index(rows)
    joined = lexical.bm25(asked, index, 7)
    pairs = joined.select("qid", "chunk_id").where("chunk_id is not null").join(asked, "qid")
    scored = {(r.qid, r.chunk_id): r.rerank_score for r in fusion.overlap_reranker(pairs, index).collect()}
    ours = blocks.bm25(asked, rows, 7, **limits).withColumn("again", fusion.overlap_score("covered", "total")).collect()
    key = lambda r: (r.qid, r["rank"], r.chunk_id or "", r.score)
    assert sorted(map(key, ours)) == sorted(map(key, joined.collect())) and len(ours) > 900
    assert {(r.qid, r.chunk_id): r.again for r in ours if r.chunk_id} == scored


def test_units_are_rounded_as_decimals(spark):
    values = [0.0, 1e-10, 5e-10, 1.4999999995, 2.0000000005, 0.1234567895, 12.3456789125, 7.0000000015, 1234.5678901235]
    cast = spark.createDataFrame([(v,) for v in values], "x double").select((F.col("x").cast("decimal(28,9)") * 1_000_000_000).cast("long")).collect()
    assert blocks.units(np.array(values)).tolist() == [r[0] for r in cast]


def test_similar_documents_keep_little(spark, tmp_path):
    """What is shuffled and written to the checkpoint folder is less than the texts: it does not follow the pairs of questions and documents."""
    import random

    deal = random.Random(1)
    texts = [" ".join(f"word{min(int(deal.expovariate(0.01)), 3000)}" for _ in range(300)) for _ in range(600)]
    spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    context = spark.sparkContext
    before = context._jsc.sc().getCheckpointDir()
    shuffled = lambda: context._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    moved = -shuffled()
    context.setCheckpointDir(str(tmp_path / "kept"))
    try:
        assert catalogue.similar_documents(spark, str(tmp_path)).count() > 30
        moved += shuffled() + sum(p.stat().st_size for p in (tmp_path / "kept").rglob("part-*"))
    finally:
        if before.isDefined():
            context.setCheckpointDir(before.get())
    assert 0 < moved < sum(map(len, texts))
