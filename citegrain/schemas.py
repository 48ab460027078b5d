"""Record types and constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()  # noqa: E741
SECTION_KINDS = ("title", "abstract", "introduction", "related", "methods", "results", "discussion", "conclusion", "references", "appendix", "figure", "table", "other")


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SECTION = struct(kind=S, heading=S, page_start=I, page_end=I, text=S)
DOCUMENT = struct(doc_id=S, title=S, authors=T.ArrayType(S), sections=T.ArrayType(SECTION), n_pages=I, source_path=S, arxiv_id=S, doi=S)
CHUNK = struct(chunk_id=S, doc_id=S, ordinal=I, text=S, section_kind=S, section_heading=S, page_start=I, page_end=I, doc_title=S, page_label=S, url=S)
HIT = struct(qid=L, chunk_id=S, rank=I, score=D, bm25_score=D, dense_score=D, rrf_score=D, rerank_score=D, sources=T.ArrayType(S))
PAPER = struct(paper_id=S, title=S, authors=T.ArrayType(S), abstract=S, published=S, url=S, source=S)
WORD = struct(doc_id=S, page=I, text=S, x0=D, x1=D, top=D, bottom=D, size=D, fontname=S, upright=T.BooleanType())


@dataclass(frozen=True)
class RetrievalConfig:
    """Which retrievers take part in a search. At least one must."""

    label: str = "hybrid"
    use_dense: bool = True
    use_bm25: bool = True
    use_rerank: bool = False
    candidates: int = 30
    top_k: int = 10

    def __post_init__(self):
        if not (self.use_dense or self.use_bm25):
            raise ValueError("a configuration needs at least one retriever")


ABLATION = (
    RetrievalConfig("dense only", True, False, False),
    RetrievalConfig("bm25 only", False, True, False),
    RetrievalConfig("hybrid (RRF)", True, True, False),
    RetrievalConfig("hybrid + rerank", True, True, True),
)

# Fixed values.
RRF_K, BM25_K1, BM25_B = 60, 1.5, 0.75
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 1000, 180, 80
CONTEXT_CHARS, QUOTE_CHARS, HISTORY_CHARS = 9000, 320, 400
SERVED, PER_DOC = 8, 3
FLOOR_LIVE, FLOOR_LIMITATIONS, FLOOR_SIMILAR = 1.5, 4.0, 3.0
SESSION_SECONDS, MOST_SESSIONS, SESSION_PAPERS, MOST_PAGES, MOST_BYTES = 3600, 40, 5, 80, 20 * 1024 * 1024
RATE_HOUR, RATE_DAY = 20, 600
LIVE_DAYS, SIMILAR_DAYS = 730, 1825
CACHE_SECONDS, BACKOFF_SECONDS, LIBRARY_BACKOFF_SECONDS, COOLDOWN_SECONDS = 900, 120, 300, 600
LIBRARY_CANDIDATES = 10
