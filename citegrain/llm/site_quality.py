"""Document quality by a hierarchical empirical Bayes model of text, path and host.

The text's evidence is a naive Bayes classifier over binned measures of the text (column expressions). The site's evidence is hierarchical: of the
labelled documents, grouped aggregation counts the good ones by host and by path (a path lies in a host: here source and lang). A
host's posterior mean shrinks its share of good documents to the global share, a path's to its host's, by prior strengths that are estimated from
the spread of the shares (method of moments): sparse sites stay near their prior. A document's log-odds are the global ones plus the text's and
path's log ratios, the latter against the global share.

Labels come from rows whose fold (crc32 of doc_id mod 5) is not 0. A null host or path is the empty one; a path or host without labels has its
parent's posterior. A null text is an empty one. Null or repeated labels as in toxicity. Repeated documents are scored each; empty tables give no
row; without labels every score is 0.5. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import SPACE, clean_text, settle
from citegrain.llm.toxicity import fold

#: Prior strengths of a host and of a path are kept in these bounds, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0
#: Bins of each measure: a value's bin is the number of these bounds that it reaches.
BINS = {
    "words": (10, 20, 50, 100, 300, 1000, 5000),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
    "symbol_share": (0.001, 0.01, 0.03, 0.1, 0.2),
    "different_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "line_repeats": (0.01, 0.1, 0.2, 0.3, 0.5, 0.7),
    "stop_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4),
}
_STOPS = ("the", "of", "and", "to", "a", "in", "is", "der", "die", "und", "das", "in", "le", "la", "de", "et", "les", "que", "un", "el", "y", "en", "los")


def features(documents: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and a bin for each measure."""
    base = documents.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), clean_text().alias("text"))
    cut = base.withColumn("words_", F.filter(F.split(F.lower("text"), SPACE), lambda w: w != "")).withColumn("lines_", F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != ""))
    n, m, chars = F.size("words_"), F.size("lines_"), F.length("text")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    values = {
        "words": n.cast("double"),
        "word_length": per(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")), n),
        "symbol_share": per(chars - F.length(F.translate("text", "#*$%&|<>@^~{}[]=+_\\", "")), chars),
        "different_share": per(F.size(F.array_distinct("words_")), n),
        "line_repeats": per(m - F.size(F.array_distinct("lines_")), m),
        "stop_share": per(F.size(F.filter("words_", lambda w: w.isin(*_STOPS))), n),
    }
    measured = cut.select("doc_id", "host", "path", *[v.alias(k) for k, v in values.items()])
    return measured.select("doc_id", "host", "path", *[sum(((F.col(k) >= b).cast("int") for b in bounds), F.lit(0)).alias(k) for k, bounds in BINS.items()])


def _strength(groups: DataFrame, share: float) -> float:
    """The Beta prior's strength by the method of moments over groups (n, good): one row comes back."""
    r = groups.where("n > 1").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - share, 2)).alias("spread"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["k"] or r["k"] < 2 or not 0 < share < 1:
        return MOST_STRENGTH
    noise = share * (1 - share)
    between = (r["spread"] - (r["k"] - 1) * noise) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return MOST_STRENGTH if between <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, noise / between - 1))


def _log_odds(p):
    return F.log(p / (1 - p))


def score_sites(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, the posteriors of host and path, the text's log ratio, score, predicted and kept, one row per document."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("long").alias("good"))
    rows = settle(features(documents, host, path))
    trained = settle(rows.where(fold(F.col("doc_id")) != 0).join(known, "doc_id"))
    total = trained.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"], total["good"] or 0
    share = (good + 1) / (n + 2)
    count = [F.count("*").alias("n"), F.sum("good").alias("good")]
    paths = trained.groupBy("host", "path").agg(*count)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strength = _strength(hosts, share)
    host_means = hosts.select("host", ((F.col("good") + strength * share) / (F.col("n") + strength)).alias("host_mean"))
    inner = _strength(paths, share)
    path_means = paths.join(host_means, "host").select("host", "path", ((F.col("good") + inner * F.col("host_mean")) / (F.col("n") + inner)).alias("path_mean"))
    # The classifier's counts: a few bins for each of a few measures, so what comes to the driver is bounded.
    bins = trained.select("good", F.explode(F.map_from_arrays(F.array(*map(F.lit, BINS)), F.array(*BINS))).alias("measure", "bin")).groupBy("measure", "bin").agg(*count).collect()
    seen = {(r["measure"], r["bin"]): (r["good"], r["n"] - r["good"]) for r in bins}
    text = F.lit(0.0)
    for measure, bounds in BINS.items():
        table = F.array(*[
            F.lit(math.log((g + 0.5) / (good + 0.5 * (len(bounds) + 1)) / ((b + 0.5) / (n - good + 0.5 * (len(bounds) + 1)))) if g + b else 0.0)
            for k in range(len(bounds) + 1)
            for g, b in [seen.get((measure, k), (0, 0))]
        ])
        text = text + F.get(table, F.col(measure))
    # Both site tables have a row for each site, far fewer than documents; a hot host's documents may be split, so no hint is given.
    sited = rows.join(path_means, ["host", "path"], "left").join(host_means, "host", "left")
    host_mean = F.coalesce("host_mean", F.lit(share))
    path_mean = F.coalesce("path_mean", host_mean)
    z = F.lit(math.log(share / (1 - share))) + F.col("text_log_ratio") + (_log_odds(F.col("path_posterior")) - F.lit(math.log(share / (1 - share))))
    out = sited.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), host_mean.alias("host_posterior"), path_mean.alias("path_posterior"), text.alias("text_log_ratio"))
    out = out.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.withColumn("kept", F.col("predicted") == 1)
