"""Reciprocal rank fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain import schemas as C
from citegrain.operators.lexical import LexicalIndex, question_terms, top


def rrf(rankings: dict[str, DataFrame], k: int = C.RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """rankings: name to (qid, chunk_id, rank, score). (qid, chunk_id, score, sources, rank)."""
    weights, out = weights or {}, None
    for name, hits in rankings.items():
        part = hits.select("qid", "chunk_id", (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).cast("decimal(28,18)").alias("part"), F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("qid", "chunk_id").agg(F.sum("part").cast("double").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return top(fused, 1 << 30)


def overlap_reranker(pairs: DataFrame, index: LexicalIndex) -> DataFrame:
    """The default scorer of (qid, chunk_id, question): the share of the question's idf that the passage covers, from -5 to 5. Deterministic and without
    a model; a model is a pandas_udf over (question, text) in its place."""
    asked = question_terms(pairs.select("qid", "question").distinct()).select("qid", "term").join(index.vocabulary.select("term", "idf"), "term")
    total = asked.groupBy("qid").agg(F.sum(F.col("idf").cast("decimal(28,9)")).alias("total"))
    hit = pairs.select("qid", "chunk_id").join(asked, "qid").join(index.postings.select("chunk_id", "term"), ["chunk_id", "term"])
    covered = hit.groupBy("qid", "chunk_id").agg(F.sum(F.col("idf").cast("decimal(28,9)")).alias("covered"))
    return pairs.select("qid", "chunk_id").join(total, "qid", "left").join(covered, ["qid", "chunk_id"], "left").select("qid", "chunk_id", overlap_score("covered", "total").alias("rerank_score"))


def overlap_score(covered: str, total: str) -> Column:
    """The overlap reranker's score of the sums of idf that a passage covers and that are asked for."""
    share = F.coalesce(F.col(covered).cast("double"), F.lit(0.0)) / F.nullif(F.col(total).cast("double"), F.lit(0.0))
    return F.round(F.coalesce(share, F.lit(0.0)) * 10 - 5, 6)


def model_reranker(pairs: DataFrame, score) -> DataFrame:
    """score: a pandas_udf of (question, text)."""
    return pairs.select("qid", "chunk_id", score(F.col("question"), F.col("text")).alias("rerank_score"))


def rerank(scored: DataFrame, top_k: int, score: Column | str = "rerank_score") -> DataFrame:
    return top(scored.withColumn("score", F.col(score) if isinstance(score, str) else score), top_k)
