"""Evidence assembly: per-document caps, reserved slots and relevance floors, as windows over ranked pools.

A pool is (qid, chunk_id, doc_id, score[, rank]); without a rank it is ranked by score, ties to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain import schemas as C

# What a paper says when it concedes something, and where a concession is none.
LIMITATION_CUE = (
    r"(?i)limitation|shortcoming|drawback|caveat|weakness|future work|threats?\s+to\s+validity|we\s+(?:do|did|could)\s+not|"
    r"(?:remains?|leaves?)\s+(?:an?\s+)?open|(?:is|are|was|were)\s+not\s+(?:evaluat|test|address|explor|valid)|fails?\s+(?:to|when|on)|"
    r"restricted\s+to|constrained\s+by|only\s+considers?"
)
NO_CONCESSION = ("figure", "table", "title", "references")


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ranked(pool: DataFrame) -> DataFrame:
    if "rank" in pool.columns:
        return pool
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))


def diversify(pool: DataFrame, per_doc, limit) -> DataFrame:
    """In order, at most per_doc of a document, up to limit; rank is the new order."""
    pool = ranked(pool)
    capped = pool.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))).where(F.col("_n") <= _num(per_doc)).drop("_n")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= _num(limit))


def merge_reserved(reserved: DataFrame, rest: DataFrame, slots, reserved_per_doc, rest_per_doc, limit, floor_gap: float | None = None) -> DataFrame:
    """The head takes up to `slots` of the reserved pool, of which those more than floor_gap under the rest's best fall away; the rest fills up to the
    limit, after the head. Parameters may be columns of the reserved pool that hold one value per question."""
    columns = ["qid", "chunk_id", "doc_id", "score"]
    params = {n: v for n, v in (("_slots", slots), ("_rpd", reserved_per_doc)) if isinstance(v, Column)}
    pool = ranked(reserved.withColumns(params) if params else reserved)
    pool = pool.where(F.col("rank") <= 2 * (F.col("_slots") if "_slots" in params else F.lit(slots)))
    head = diversify(pool, F.col("_rpd") if "_rpd" in params else reserved_per_doc, F.col("_slots") if "_slots" in params else slots)
    rest = ranked(rest).where(F.col("rank") <= _num(limit))
    if floor_gap is not None:
        best = rest.groupBy("qid").agg(F.max("score").alias("_best"))
        head = head.join(best, "qid", "left").where(F.col("_best").isNull() | (F.col("score") >= F.col("_best") - floor_gap))
    tail = diversify(rest, rest_per_doc, limit)
    both = head.select(*columns, F.lit(0).alias("_pool"), "rank").unionByName(tail.select(*columns, F.lit(1).alias("_pool"), "rank"))
    order = Window.partitionBy("qid").orderBy("_pool", "rank")
    out = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _num(limit))
    return out.select(*columns, "rank", (F.col("_pool") == 0).alias("reserved"))


def with_count(pool: DataFrame, name: str, what: Column) -> DataFrame:
    """The pool with a count per question."""
    return pool.withColumn(name, what.over(Window.partitionBy("qid")))


def merge_live(live: DataFrame, corpus: DataFrame, comparing: bool = False, limit: int = C.SERVED) -> DataFrame:
    """Up to half the places, and at least two, for live papers, one passage each; two from a corpus paper."""
    pool = with_count(live, "_n", F.count("*"))
    return merge_reserved(pool, corpus, F.least(F.col("_n"), F.lit(max(2, limit // 2))), 1, 2, limit, None if comparing else C.FLOOR_LIVE)


def merge_author(site: DataFrame, corpus: DataFrame, limit: int = C.SERVED) -> DataFrame:
    pool = with_count(site, "_n", F.count("*"))
    return merge_reserved(pool, corpus, F.least(F.col("_n"), F.lit(6)), 1, 2, limit, C.FLOOR_LIVE)


def merge_textbook(book: DataFrame, corpus: DataFrame, limit: int = C.SERVED) -> DataFrame:
    pool = with_count(book, "_n", F.count("*"))
    return merge_reserved(pool, corpus, F.least(F.col("_n"), F.lit(2)), 1, 3, limit, C.FLOOR_LIVE)


def merge_uploaded(uploaded: DataFrame, corpus: DataFrame, k: int = C.SERVED) -> DataFrame:
    """Half the places for the reader's own documents, evenly among them; all of them for a question without corpus passages. No floor."""
    asked = corpus.select("qid").distinct().withColumn("_rest", F.lit(True))
    docs = uploaded.groupBy("qid").agg(F.count("*").alias("_n"), F.countDistinct("doc_id").alias("_docs"))
    pool = uploaded.join(docs, "qid").join(asked, "qid", "left")
    alone = F.col("_rest").isNull()
    slots = F.when(alone, F.least("_n", F.lit(k))).otherwise(F.least("_n", F.lit(max(2, k // 2))))
    per_doc = F.when(alone, F.lit(k)).otherwise(F.greatest(F.lit(2), F.ceil(slots / F.col("_docs"))))
    return merge_reserved(pool, corpus, slots, per_doc, 2, k)


def merge_library(added: DataFrame, corpus: DataFrame, k: int = C.SERVED) -> DataFrame:
    """At most two added passages a document among the first k, then all by score; added ones go first among equals."""
    columns = ["qid", "chunk_id", "doc_id", "score"]
    head = diversify(added, 2, k).select(*columns, F.lit(0).alias("_pool"), "rank")
    both = head.unionByName(ranked(corpus).select(*columns, F.lit(1).alias("_pool"), "rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "_pool", "rank")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*columns, "rank", (F.col("_pool") == 0).alias("reserved"))


def states_a_limitation(kind: Column, heading: Column, text: Column) -> Column:
    return ~kind.isin(*NO_CONCESSION) & (F.coalesce(heading, F.lit("")).rlike(LIMITATION_CUE) | F.coalesce(text, F.lit("")).rlike(LIMITATION_CUE))


def merge_limitations(pool: DataFrame, limit: int = C.SERVED) -> DataFrame:
    """pool also has section_kind, section_heading and text. Captions and the like go where enough prose is left; passages that concede something
    and score near the best have places of their own."""
    prose = ~F.col("section_kind").isin(*NO_CONCESSION)
    counted = with_count(ranked(pool).withColumn("_prose", prose), "_n", F.sum(prose.cast("int")))
    pool = counted.where((F.col("_n") < limit) | F.col("_prose")).drop("rank", "_n", "_prose")
    stated = states_a_limitation(F.col("section_kind"), F.col("section_heading"), F.col("text"))
    pool = pool.withColumn("_stated", stated)
    said = pool.where("_stated")
    best = said.groupBy("qid").agg(F.max("score").alias("_top"))
    near = with_count(said.join(best, "qid").where(F.col("score") >= F.col("_top") - C.FLOOR_LIMITATIONS), "_n", F.count("*"))
    rest = pool.join(near.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    asked = near.select("qid").distinct()
    merged = merge_reserved(near, rest.join(asked, "qid", "left_semi"), F.least(F.col("_n"), F.lit(4)), 2, 2, limit)
    plain = ranked(pool.join(asked, "qid", "left_anti")).where(F.col("rank") <= limit).select("qid", "chunk_id", "doc_id", "score", "rank", F.lit(False).alias("reserved"))
    return merged.unionByName(plain)


def corpus_support(hits: DataFrame, threshold: float = 0.62, among: int = 20) -> DataFrame:
    """(qid, papers): different papers of at least the threshold among the first hits."""
    return ranked(hits).where(F.col("rank") <= among).groupBy("qid").agg(F.count_distinct(F.when(F.col("score") >= threshold, F.col("doc_id"))).alias("papers"))


def without_known(added: DataFrame, corpus: DataFrame) -> DataFrame:
    """Added chunks of documents that the corpus lacks, each chunk id once."""
    fresh = added.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti")
    order = Window.partitionBy("chunk_id").orderBy("ordinal")
    return fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def interleave(papers: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """papers (qid, source, pos, title, ...): the first of each source, then the second, and so on; of papers with the same title letters the first
    stays. rank is the order."""
    order_of = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    key = F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]", ""), 1, 80)
    placed = papers.withColumn("_turn", F.row_number().over(Window.partitionBy("qid", "source").orderBy("pos"))).withColumn("_source", order_of).withColumn("_key", key)
    first = placed.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_key").orderBy("_turn", "_source"))).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_turn", "_source"))).drop("_turn", "_source", "_key", "_n")
