"""BM25 as joins: an inverted index of three tables, and one plan for all questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain import schemas as C
from citegrain.functions.text import tokens
from citegrain.storage import settle


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame  # chunk_id, term, tf, len
    vocabulary: DataFrame  # term, df, idf
    statistics: DataFrame  # one row: n, avg_len


def token_rows(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.select("chunk_id", F.explode(tokens(text)).alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1.0))


def build_index(chunks: DataFrame, text: str = "text") -> LexicalIndex:
    """The index is written once, to the checkpoint folder; searches read it and not the chunks. Statistics count chunks without tokens. A chunk's terms
    are counted within it, so only (term, 1) rows are summed across chunks."""
    tokenised = chunks.select("chunk_id", tokens(text).alias("terms"))
    counted = tokenised.select("chunk_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf"))
    postings = settle(counted)
    statistics = settle(tokenised.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_len")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    # statistics is an aggregate of one row: joining it copies two numbers
    vocabulary = settle(df.join(F.broadcast(statistics), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf")))
    return LexicalIndex(postings, vocabulary, statistics)


def question_terms(questions: DataFrame, question: str = "question") -> DataFrame:
    """(qid, term, qtf): a repeated term counts as often as it is asked."""
    return questions.select("qid", F.explode(tokens(question)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def top(hits: DataFrame, k: int, by: str = "qid", score: str = "score", id_: str = "chunk_id") -> DataFrame:
    """The k best of each question with their ranks; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), id_)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(questions: DataFrame, index: LexicalIndex, k: int = 30, allow: DataFrame | None = None, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """(qid, chunk_id, score, rank). allow: chunk_ids to choose among; the statistics stay those of all chunks.

    Contributions are added as decimals, so the sum does not depend on their order."""
    asked = question_terms(questions).join(index.vocabulary.select("term", "idf"), "term")
    matched = asked.join(index.postings, "term")
    if allow is not None:
        matched = matched.join(allow.select("chunk_id").distinct(), "chunk_id", "left_semi")
    matched = matched.join(F.broadcast(index.statistics), how="cross")
    tf = F.col("tf").cast("double")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = matched.groupBy("qid", "chunk_id").agg(F.sum(part.cast("decimal(28,9)")).cast("double").alias("score"))
    return top(scored, k)
