"""Queries of the adapters, chunk labels, evidence flags and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrain.operators import chunking, dense, evaluate, evidence, freshness, grounding
from citegrain.plans.catalogue import SQUEEZE, query, table
from citegrain.sources import readers


@query("""SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN a = 0 AND b = 0 THEN CASE WHEN label <> '' THEN label ELSE 'abstract' END WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS pages,
  CASE WHEN a = 0 AND b = 0 THEN CASE WHEN label <> '' THEN label ELSE 'abstract' END WHEN a = b THEN 'p' || a ELSE 'p' || a || '-' || b END AS page_ref
FROM (SELECT doc_id, (doc_id % 5)::INTEGER AS a, (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 5 + doc_id % 3 END)::INTEGER AS b, CASE WHEN doc_id % 2 = 0 THEN 'website' END AS label FROM documents)""")
def page_refs(spark, d):
    first = (F.col("doc_id") % 5).cast("int")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), first.alias("page_start"), F.when(first == 0, 0).otherwise(first + (F.col("doc_id") % 3).cast("int")).alias("page_end"), F.when(F.col("doc_id") % 2 == 0, "website").alias("page_label"))
    return chunking.pages_label(rows).select("chunk_id", "pages", "page_ref")


@query("SELECT doc_id, left(sha256(concat_ws(chr(31), 'letters', 'query: ', text)), 16) AS key FROM documents")
def vector_cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", dense.cache_key("text", "letters", "query: ").alias("key"))


@query("""SELECT source || ':' || doc_id AS chunk_id, source || ':' || doc_id AS doc_id, 0 AS ordinal, text, 'abstract' AS section_kind,
  upper(left(source, 1)) || lower(substr(source, 2)) || ' ' || doc_id || ' · abstract · ' || lang AS section_heading, left(text, 20) AS doc_title FROM documents""")
def paper_chunks(spark, d):
    """Documents as papers that a live search found."""
    papers = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("paper_id"), F.col("text").alias("abstract"), F.col("lang").alias("published"), F.substring("text", 1, 20).alias("title"), F.lit(None).cast("string").alias("url"))
    return readers.papers_to_chunks(papers).select("chunk_id", "doc_id", "ordinal", "text", "section_kind", "section_heading", "doc_title")


@query(f"""SELECT 'site:' || doc_id AS chunk_id, {SQUEEZE.format(x='text')} AS text, concat_ws(' · ', 'Ada Quill', CASE WHEN doc_id % 3 > 0 THEN lang END, source) AS section_heading, 'website' AS page_label
FROM documents WHERE {SQUEEZE.format(x='text')} <> ''""")
def site_chunks(spark, d):
    """Documents as pages of the owner's site; every third has no kind."""
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("source").alias("updated"))
    return readers.site_to_chunks(items, "Ada Quill").select("chunk_id", "text", "section_heading", "page_label")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(lang, '')), 'fr') OR contains(lower(coalesce(source, '')), 'fr') OR contains(lower(coalesce(lang, '')), 'src1')")
def papers_open_access(spark, d):
    return readers.open_access(table(spark, d, "documents").select("doc_id", F.col("source").alias("source_path"), F.col("lang").alias("title")), ("src1", "fr")).select("doc_id")


@query("SELECT min(doc_id) AS ordinal, text AS chunk_id, min_by(source, doc_id) AS doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND source < 'src15') GROUP BY text")
def fresh_chunks(spark, d):
    """Chunks (a text is its id) of sources that the corpus lacks; a chunk id is taken once, with its smallest ordinal."""
    rows = table(spark, d, "documents")
    added = rows.select(F.col("text").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("ordinal"))
    corpus = rows.where("doc_id % 7 = 0 AND source < 'src15'").select(F.col("source").alias("doc_id"))
    return evidence.without_known(added, corpus).select("ordinal", "chunk_id", "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'Listed ' || doc_id ELSE source END AS title, 'u' || doc_id AS url FROM documents WHERE doc_id % 4 = 0 AND doc_id < 100 ORDER BY doc_id LIMIT 25")
def library_titles(spark, d):
    """The owner's list names every fourth document under 100; every other one of them without a title, which then keeps its own."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.array("lang").alias("authors"))
    listed = rows.where("doc_id % 4 = 0 AND doc_id < 100").select(F.col("doc_id").alias("pos"), "doc_id", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("Listed "), F.col("doc_id").cast("string"))).otherwise("").alias("title"), F.lit("A One, B Two").alias("authors"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    return readers.with_manifest(rows, listed).select("doc_id", "title", "url")


@query(f"SELECT doc_id, trim(concat_ws(' ', upper(lang) || ': ' || {SQUEEZE.format(x='text')}, {SQUEEZE.format(x='source')})) AS abstract, concat_ws('-', CASE WHEN doc_id % 3 = 0 THEN '????' ELSE (2000 + doc_id % 20)::VARCHAR END, CASE WHEN doc_id % 4 = 0 THEN '01' ELSE lpad((doc_id % 12)::VARCHAR, 2, '0') END, '01') AS published FROM documents")
def record_parts(spark, d):
    """A record's abstract of labelled parts, and its date of which any part may be missing or a name."""
    rows = table(spark, d, "documents")
    part = lambda label, text: F.struct(label.cast("string").alias("label"), text.alias("text"))
    parts = F.array(part(F.upper("lang"), F.col("text")), part(F.lit(None), F.col("source")))
    year = F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.col("doc_id") % 20 + 2000).cast("string"))
    month = F.when(F.col("doc_id") % 4 == 0, "Spring").otherwise((F.col("doc_id") % 12).cast("string"))
    return rows.select("doc_id", readers.labelled_abstract(parts).alias("abstract"), readers.padded_date(year, month, F.lit(None).cast("string")).alias("published"))


@query(f"""WITH w AS (SELECT doc_id, lang, source, {SQUEEZE.format(x='text')} AS t FROM documents)
SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE 'W' || doc_id END AS paper_id, source AS title, CASE WHEN lang = 'en' THEN t ELSE '[' || lang || '] ' || t END AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id ELSE 'https://index.example/W' || doc_id END AS url, 'Ada Quill,B. Two' AS authors FROM w WHERE t <> '' AND doc_id % 5 > 0""")
def index_papers(spark, d):
    """Every document as a captured payload of an index of works; every fifth has no title, English ones no venue, odd ones no DOI."""
    rows = table(spark, d, "documents")
    inverted = readers.invert_abstracts(rows.select("doc_id", "text"))
    name = lambda n: F.struct(F.struct(F.lit(n).alias("display_name")).alias("author"))
    key = F.col("doc_id").cast("string")
    work = F.struct(
        F.concat(F.lit("https://index.example/W"), key).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), key)).alias("doi"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("title"),
        F.array(name("Ada Quill"), name(""), name("B. Two")).alias("authorships"), F.col("inverted").alias("abstract_inverted_index"),
        F.struct(F.struct(F.when(F.col("lang") != "en", F.col("lang")).alias("display_name")).alias("source")).alias("primary_location"),
    )
    payloads = rows.select("doc_id", "lang", "source").join(inverted, "doc_id").select(F.col("doc_id").alias("qid"), F.to_json(F.struct(F.array(work).alias("results"))).alias("json"))
    return readers.index_works(payloads).select("qid", "paper_id", "title", "abstract", "url", F.array_join("authors", ",").alias("authors"))


@query("""WITH c AS (SELECT conv_id AS qid, CASE WHEN turn % 3 = 0 THEN 'site:' || turn WHEN turn % 3 = 1 THEN 'textbook:' || turn ELSE 'a:' || turn END AS chunk_id FROM conversations WHERE role = 'assistant')
SELECT qid, count(chunk_id) AS n_citations, coalesce(bool_or(chunk_id LIKE 'site:%'), false) AS about_author FROM (SELECT DISTINCT conv_id AS qid FROM conversations) LEFT JOIN c USING (qid) GROUP BY qid""")
def answer_flags(spark, d):
    rows = table(spark, d, "conversations")
    name = F.when(F.col("turn") % 3 == 0, "site:").when(F.col("turn") % 3 == 1, "textbook:").otherwise("a:")
    cited = rows.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.concat(name, F.col("turn").cast("string")).alias("chunk_id"))
    return grounding.answer_flags(rows.select(F.col("conv_id").alias("qid")).distinct(), cited)


@query("SELECT event_type AS config, count(*) AS n_questions, list_sort(list(value))[count(*) // 2 + 1] AS median_ms FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_medians(spark, d):
    return evaluate.latencies(table(spark, d, "events").where("value IS NOT NULL").select(F.col("event_type").alias("config"), F.col("value").alias("ms")))


MISS = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"""WITH o AS (SELECT doc_id AS qid, CASE doc_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'refuse' ELSE 'scoped' END AS expect, CASE WHEN doc_id % 4 = 0 THEN 'answer' ELSE 'refuse' END AS got, text FROM documents)
SELECT qid, expect, got, left({MISS}, 58) AS question, left({MISS}, 100) AS text FROM o WHERE expect <> 'scoped' AND expect <> got ORDER BY qid LIMIT 12""")
def refusal_misses(spark, d):
    expect = F.when(F.col("doc_id") % 3 == 0, "answer").when(F.col("doc_id") % 3 == 1, "refuse").otherwise("scoped")
    got = F.when(F.col("doc_id") % 4 == 0, "answer").otherwise("refuse")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), expect.alias("expect"), got.alias("got"), F.col("text").alias("question"), "text")
    return evaluate.refusal_misses(rows.withColumn("correct", (F.col("expect") == "scoped") | (F.col("expect") == F.col("got"))))


@query("SELECT lang AS section_kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS share FROM documents GROUP BY lang")
def kind_histogram(spark, d):
    """Languages stand for kinds of section."""
    return evaluate.kind_histogram(table(spark, d, "documents").select(F.col("lang").alias("section_kind")))


# ---- sources read over and over: users stand for sources, views for reads that succeeded, errors for failures

SNAPSHOT = """snapshot AS (SELECT user_id AS key, max(ts) FILTER (event_type = 'view') AS fetched_at, max(ts) FILTER (event_type = 'error') AS failed_at,
  max(event_id) FILTER (event_type = 'view')::VARCHAR AS etag, CASE WHEN user_id % 3 > 0 THEN max(event_id) FILTER (event_type = 'view')::VARCHAR END AS body
  FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)"""


def _snapshot(spark, d):
    of = lambda kind, c: F.max(F.when(F.col("event_type") == kind, F.col(c)))
    rows = table(spark, d, "events").where("ts < TIMESTAMP '2024-01-16'").groupBy(F.col("user_id").alias("key"))
    read = of("view", "event_id").cast("string")
    return rows.agg(of("view", "ts").alias("fetched_at"), of("error", "ts").alias("failed_at"), read.alias("etag"), F.when(F.col("key") % 3 > 0, read).alias("body"))


@query(f"""WITH {SNAPSHOT} SELECT event_id, user_id, action, CASE WHEN action = 'fetch' AND held THEN etag END AS if_none_match FROM (
  SELECT event_id, user_id, etag, coalesce(body IS NOT NULL, false) AS held, CASE WHEN body IS NOT NULL AND ts < fetched_at + INTERVAL 172800 SECOND THEN 'cached'
  WHEN body IS NULL AND ts < failed_at + INTERVAL 172800 SECOND THEN 'wait' ELSE 'fetch' END AS action
  FROM events LEFT JOIN snapshot ON key = user_id WHERE ts >= TIMESTAMP '2024-01-16')""")
def cache_decisions(spark, d):
    requests = table(spark, d, "events").where("ts >= TIMESTAMP '2024-01-16'").select("event_id", "user_id", F.col("user_id").alias("key"), "ts")
    return freshness.read_decisions(requests, _snapshot(spark, d), 172800, 172800).drop("key", "ts")


@query(f"""WITH {SNAPSHOT}, r AS (SELECT user_id, min_by(ts, (ts, event_id)) AS ts, min_by(CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 304 ELSE 200 END, (ts, event_id)) AS status, min(event_id)::VARCHAR AS nb
  FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id),
j AS (SELECT coalesce(key, user_id) AS key, fetched_at, failed_at, etag, body, ts, nb, coalesce(status = 200, false) AS rd, coalesce(status = 200 OR (status = 304 AND body IS NOT NULL), false) AS good FROM snapshot FULL JOIN r ON key = user_id)
SELECT key, CASE WHEN good THEN ts ELSE fetched_at END AS fetched_at, CASE WHEN ts IS NOT NULL AND NOT good THEN ts ELSE failed_at END AS failed_at,
  CASE WHEN rd THEN nb ELSE etag END AS etag, CASE WHEN rd THEN nb ELSE body END AS body FROM j""")
def cache_update(spark, d):
    """The first event of each user after the snapshot is the answer to a read."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 304).otherwise(200)
    order, own = F.struct("ts", "event_id"), F.min("event_id").cast("string")
    rows = table(spark, d, "events").where("ts >= TIMESTAMP '2024-01-16'").groupBy(F.col("user_id").alias("key"))
    return freshness.take_responses(_snapshot(spark, d), rows.agg(F.min_by("ts", order).alias("ts"), F.min_by(status, order).alias("status"), own.alias("etag"), own.alias("body")))


@query("""SELECT e.event_id, e.user_id, EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts <= e.ts AND e.ts < x.ts + INTERVAL 28800 SECOND) AS blocked
FROM events e WHERE e.event_type <> 'error'""")
def quota_cooldown(spark, d):
    events = table(spark, d, "events").withColumn("key", F.col("user_id"))
    return freshness.cooling(events.where("event_type <> 'error'").select("event_id", "user_id", "key", "ts"), events.where("event_type = 'error'").select("key", "ts"), 28800).drop("key", "ts")


@query("""WITH h AS (SELECT source AS owner, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1),
f AS (SELECT source AS owner, list(doc_id ORDER BY doc_id) FILTER (substr(source, 4)::INT % 4 = 0 OR (substr(source, 4)::INT % 4 = 1 AND doc_id % 2 = 0)) AS ids FROM documents GROUP BY 1)
SELECT owner, CASE WHEN f.ids IS NOT DISTINCT FROM h.ids THEN 'keep' WHEN len(f.ids) > 0 THEN 'index' WHEN substr(owner, 4)::INT % 4 = 2 THEN 'keep' ELSE 'clear' END AS action FROM h JOIN f USING (owner)""")
def library_refresh(spark, d):
    """Sources as libraries: every fourth is as it was, the next lost chunks, the next could not be read, the next is empty."""
    number = F.substring("source", 4, 9).cast("int") % 4
    rows = table(spark, d, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("chunk_id"), number.alias("n"))
    return freshness.refresh_actions(rows, rows.where("n = 0 OR (n = 1 AND ordinal % 2 = 0)"), rows.where("n = 2").select("owner"))
