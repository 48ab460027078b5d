"""Sources and sinks: documents, pages, question files, bundles, captured payloads of search services, and library listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain import schemas as C
from citegrain.functions.text import split_passages, squeeze, text_or_empty


def content_id(content: Column) -> Column:
    """The first 16 hexadecimal digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def documents_as_sections(rows: DataFrame) -> DataFrame:
    """The documents table as documents of one section; the title is the first eight words."""
    words = F.slice(F.split(squeeze("text"), " "), 1, 8)
    section = F.struct(F.lit("other").alias("kind"), F.lit("").alias("heading"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), text_or_empty("text").alias("text"))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(words, " ").alias("title"), F.array(section).alias("sections"), "source", "lang")


def first_copies(rows: DataFrame) -> DataFrame:
    """(content_id, doc_id, copies): each content once, under its smallest doc_id."""
    return rows.select("doc_id", content_id(text_or_empty("text")).alias("content_id")).groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def page_sections(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, text) of raw HTML: scripts, styles and navigation go, tags and entities are stripped from the paragraphs."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|nav)\b.*?</\1>", " ")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))
    inside = lambda tag: bare(F.regexp_extract("h", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    paragraphs = F.transform(F.regexp_extract_all("h", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), bare)
    return pages.select("page_id", html.alias("h")).select("page_id", inside("title").alias("title"), inside("h1").alias("heading"), F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, meta) of a file of JSON lines with blank lines, // comments and a row of metadata under _meta."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    meta = lines.where(F.get_json_object("value", "$._meta").isNotNull()).select(F.get_json_object("value", "$._meta").alias("meta"))
    rows = lines.where(F.get_json_object("value", "$._meta").isNull()).select(F.from_json("value", schema).alias("x")).select("x.*")
    return rows, meta


def numbered_list(spark: SparkSession, path: str) -> DataFrame:
    """(n, text) of lines like `12. text`."""
    pattern = r"^\s*(\d{1,3})\.\s+(.*\S)\s*$"
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).cast("int").alias("n"), F.regexp_extract("value", pattern, 2).alias("text"))


def write_bundle(chunks: DataFrame, vectors: DataFrame, path: str, **manifest: str) -> None:
    """Chunks with their vectors in one table, and a manifest of one row; nothing but the chunk's own row links the two."""
    chunks.join(vectors, "chunk_id", "left").write.mode("overwrite").parquet(f"{path}/chunks")
    sizes = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("papers"))
    sizes.select("*", *[F.lit(v).alias(k) for k, v in manifest.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents). Another encoder's bundle, or one that lost rows, is refused."""
    chunks, manifest = spark.read.parquet(f"{path}/chunks"), spark.read.json(f"{path}/manifest").first()
    if model and manifest["embedding_model"] != model:
        raise ValueError(f"the bundle was encoded by {manifest['embedding_model']}")
    if chunks.count() != manifest["chunks"]:
        raise ValueError("the bundle's chunks are not those of its manifest")
    return chunks, chunks.groupBy("doc_id").agg(F.min_by("doc_title", "ordinal").alias("title"))


def write_dump(chunks: DataFrame, path: str, fingerprint: str) -> None:
    """Chunks as JSON lines by document, with the chunking's fingerprint in every row."""
    chunks.withColumn("chunking", F.lit(fingerprint)).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ordinal").write.mode("overwrite").json(path)


def unparsed(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """files (content_id, ...) that the cache (content_id, parser_version) lacks for this version."""
    return files.join(cache.where(F.col("parser_version") == version).select("content_id"), "content_id", "left_anti")


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", content_id(F.col("content")).alias("content_id"), "length", "content")


def atom_entries(payloads: DataFrame, now: str, since_days: int = C.LIVE_DAYS) -> DataFrame:
    """payloads (qid, xml) of a preprint feed to papers, newer than the window before `now` (a date), at most eight authors."""
    entry = "array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"
    rows = payloads.select("qid", F.from_xml("xml", f"entry {entry}").alias("f")).select("qid", F.posexplode("f.entry").alias("pos", "e"))
    tail = F.regexp_replace(F.regexp_extract("e.id", r"([^/]+)$", 1), r"v\d+$", "")
    day = F.substring("e.published", 1, 10)
    out = rows.select("qid", "pos", tail.alias("paper_id"), squeeze("e.title").alias("title"), F.slice(F.transform("e.author", lambda a: a["name"]), 1, 8).alias("authors"), squeeze("e.summary").alias("abstract"), day.alias("published"), F.col("e.id").alias("url"), F.lit("arxiv").alias("source"))
    return out.where(F.col("published") >= F.date_format(F.date_sub(F.lit(now).cast("date"), since_days), "yyyy-MM-dd"))


def labelled_abstract(parts: Column) -> Column:
    """array<struct<label,text>> as one text, labelled parts by `LABEL: `."""
    one = lambda p: F.when(F.coalesce(p["label"], F.lit("")) != "", F.concat(p["label"], F.lit(": "), squeeze(p["text"]))).otherwise(squeeze(p["text"]))
    return F.trim(F.array_join(F.transform(parts, one), " "))


def padded_date(year: Column, month: Column, day: Column) -> Column:
    """Year-month-day with ???? for no year and 01 for a month or day that is no number."""
    number = lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 2, "0")).otherwise("01")
    return F.concat_ws("-", F.coalesce(F.nullif(year, F.lit("")), F.lit("????")), number(F.coalesce(month, F.lit(""))), number(F.coalesce(day, F.lit(""))))


def invert_abstracts(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, inverted): a map from each word to its positions, as an index of abstracts stores them."""
    words = rows.select(key, F.posexplode(F.filter(F.split(squeeze(text), " "), lambda w: w != "")).alias("p", "w"))
    places = words.groupBy(key, "w").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    maps = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("inverted"))
    return rows.select(key).join(maps, key, "left")


def reconstruct_abstract(inverted: Column) -> Column:
    """The text of a map from word to positions; null or empty gives the empty text."""
    flat = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(squeeze(F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")), F.lit(""))


WORK = "id string, doi string, title string, publication_date string, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, primary_location struct<source:struct<display_name:string>>"


def index_works(payloads: DataFrame, most_authors: int = 8) -> DataFrame:
    """payloads (qid, json) of an open index of works to papers: works without a title or an abstract are left out, the venue stands before the abstract,
    and the DOI is the id, or else the index's own."""
    rows = payloads.select("qid", F.posexplode(F.from_json("json", f"results array<struct<{', '.join(f.replace(' ', ':', 1) for f in WORK.split(', '))}>>")["results"]).alias("pos", "w"))
    doi = F.replace(F.coalesce("w.doi", F.lit("")), F.lit("https://doi.org/"), F.lit(""))
    own = F.regexp_extract(F.coalesce("w.id", F.lit("")), r"([^/]*)$", 1)
    venue, text = F.coalesce("w.primary_location.source.display_name", F.lit("")), reconstruct_abstract(F.col("w.abstract_inverted_index"))
    names = F.filter(F.transform(F.coalesce("w.authorships", F.array()), lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    out = rows.select(
        "qid", "pos", F.coalesce(F.nullif(doi, F.lit("")), own).alias("paper_id"), squeeze("w.title").alias("title"), F.slice(names, 1, most_authors).alias("authors"), text.alias("text"), venue.alias("venue"),
        F.coalesce("w.publication_date", F.lit("")).alias("published"), F.coalesce(F.nullif("w.doi", F.lit("")), "w.id", F.lit("")).alias("url"), F.lit("openalex").alias("source"),
    ).where("text != '' AND title != ''")
    abstract = F.when(F.col("venue") != "", F.concat(F.lit("["), "venue", F.lit("] "), "text")).otherwise(F.col("text"))
    return out.withColumn("abstract", abstract).drop("text", "venue")


def papers_to_chunks(papers: DataFrame) -> DataFrame:
    """One chunk of each paper's abstract, without pages."""
    heading = F.concat(F.initcap("source"), F.lit(" "), F.col("paper_id"), F.lit(" · abstract · "), F.coalesce("published", F.lit("")))
    key = F.concat_ws(":", "source", "paper_id")
    return papers.select(key.alias("chunk_id"), key.alias("doc_id"), F.lit(0).alias("ordinal"), F.col("abstract").alias("text"), F.lit("abstract").alias("section_kind"), heading.alias("section_heading"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.col("title").alias("doc_title"), F.lit(None).cast("string").alias("page_label"), "url")


def site_to_chunks(items: DataFrame, site: str) -> DataFrame:
    """items (id, title, text, kind, url, updated): one chunk of each with a text."""
    key = F.concat(F.lit("site:"), F.col("id"))
    heading = F.concat_ws(" · ", F.lit(site), F.nullif(F.col("kind"), F.lit("")), F.nullif(F.col("updated"), F.lit("")))
    return items.where(squeeze("text") != "").select(key.alias("chunk_id"), key.alias("doc_id"), F.lit(0).alias("ordinal"), squeeze("text").alias("text"), F.lit("other").alias("section_kind"), heading.alias("section_heading"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.col("title").alias("doc_title"), F.lit("website").alias("page_label"), "url")


def textbook_to_chunks(items: DataFrame, size: int = 900, least: int = 120) -> DataFrame:
    """items (id, title, text, book, chapter, url): passages of at most `size` characters; texts under `least` are left out."""
    kept = items.withColumn("text", squeeze("text")).where(F.length("text") >= least)
    rows = kept.select("*", F.posexplode(split_passages("text", size)).alias("i", "passage"))
    doc = F.concat(F.lit("textbook:"), F.col("id").cast("string"))
    heading = F.concat_ws(" · ", F.concat(F.lit("Textbook "), F.col("id").cast("string")), F.nullif(F.col("book"), F.lit("")), F.nullif(F.col("chapter"), F.lit("")))
    return rows.select(F.concat_ws(":", doc, F.col("i").cast("string")).alias("chunk_id"), doc.alias("doc_id"), F.col("i").alias("ordinal"), F.col("passage").alias("text"), F.lit("other").alias("section_kind"), heading.alias("section_heading"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), squeeze("title").alias("doc_title"), F.lit("proposition").alias("page_label"), "url")


def with_manifest(parsed: DataFrame, manifest: DataFrame, most: int = 25) -> DataFrame:
    """Parsed documents (doc_id, title, authors) under the titles and authors of the first `most` manifest rows (pos, doc_id, title, authors, url)."""
    entries = manifest.orderBy("pos").limit(most).select("doc_id", F.col("title").alias("t"), F.transform(F.split("authors", ","), lambda a: F.trim(a)).alias("a"), "url")
    return parsed.join(entries, "doc_id").select("doc_id", F.coalesce(F.nullif("t", F.lit("")), F.col("title")).alias("title"), F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("authors")).alias("authors"), "url")


def upload_verdicts(uploads: DataFrame, corpus: DataFrame) -> DataFrame:
    """uploads (session, seq, doc_id, n_bytes, is_pdf, n_pages, n_chunks) with `refused`: the first rule that an upload breaks, or null."""
    known = corpus.select("doc_id").distinct().withColumn("_known", F.lit(True))
    joined = uploads.join(known, "doc_id", "left")
    again = F.row_number().over(Window.partitionBy("session", "doc_id").orderBy("seq")) > 1
    ladder = (
        F.when(F.col("n_bytes") == 0, "empty").when(F.col("n_bytes") > C.MOST_BYTES, "too large").when(~F.col("is_pdf"), "not a PDF").when(F.col("n_pages") > C.MOST_PAGES, "too many pages")
        .when(F.col("_known"), "already in the corpus").when(F.col("n_chunks") == 0, "no passages").when(again, "already open")
    )
    judged = joined.withColumn("_why", ladder)
    taken = F.sum(F.col("_why").isNull().cast("int")).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("refused", F.when(F.col("_why").isNull() & (taken > C.SESSION_PAPERS), "session is full").otherwise(F.col("_why"))).drop("_why", "_known")


def open_access(documents: DataFrame, hints: tuple[str, ...]) -> DataFrame:
    """Documents whose path or title holds one of the hints."""
    out = F.lit(False)
    for h in hints:
        out = out | F.lower(F.coalesce("source_path", F.lit(""))).contains(h) | F.lower(F.coalesce("title", F.lit(""))).contains(h)
    return documents.where(out)
