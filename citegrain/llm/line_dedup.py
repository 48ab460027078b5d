"""Site-relative line deduplication, by DataFrame functions only.

A line's frequency at a host is the number of the host's pages that hold it over the number of the host's pages. Lines with a frequency over `ratio`,
on at least `least_pages` pages, are boilerplate there and go. copies_once: pages of one text count as one page in both, so a page that is only
copied keeps its lines.

A null host is the empty host, a null text an empty page. Lines without a word always stay, as do the line breaks around what stays. Lines are
told apart by 64-bit hashes. Repeated documents are cleaned each; empty tables give no row; columns that are not asked for are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import SPACE, clean_text, settle

RATIO, LEAST_PAGES = 0.02, 5
#: Boilerplate hashes (of eight bytes) that may be broadcast, with their hosts; beyond, the table is joined by host and a salt.
BROADCAST_LINES, SALTS = 500_000, 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return F.regexp_replace(line, SPACE, "") != ""


def boilerplate(documents: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate. A host has at most its mean number of lines per page over `ratio` of them."""
    body = clean_text(text)
    pages = documents.select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.struct(F.xxhash64(body).alias("x"), F.crc32(body.cast("binary")).alias("c"), F.length(body).alias("n")).alias("page"),
        F.array_distinct(F.transform(F.filter(_lines(body), _has_word), lambda x: F.xxhash64(x))).alias("lines"),
    )
    pages = settle((pages.dropDuplicates(["host", "page"]) if copies_once else pages).select("host", "lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    frequent = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(documents: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: tuple[str, str] | None = None, copies_once: bool = False) -> DataFrame:
    """The documents with their boilerplate lines dropped from `text`; counts: names of columns for the numbers of lines and of lines dropped."""
    found = settle(boilerplate(documents, host, text, ratio, least_pages, copies_once))
    size = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    names = [c for c in documents.columns]
    row = F.struct(*[F.col(c) for c in names])
    keyed = documents.select(row.alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    if size <= BROADCAST_LINES:
        joined = keyed.join(F.broadcast(found), "host", "left")
    else:  # a hot host's documents are dealt over salts
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64(F.col("row")[text]), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    gone = lambda x: _has_word(x) & F.array_contains("lines", F.xxhash64(x))
    body = F.col("row")[text]
    split = joined.withColumn("all", _lines(F.coalesce(body, F.lit(""))))
    kept = split.withColumn("kept", F.when(F.col("lines").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: ~gone(x))))
    cleaned = F.when(F.size("kept") == F.size("all"), body).otherwise(F.array_join("kept", "\n"))
    out = [cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    if counts:
        out += [F.size("all").cast("long").alias(counts[0]), (F.size("all") - F.size("kept")).cast("long").alias(counts[1])]
    return kept.select(*out)
