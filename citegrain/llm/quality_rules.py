r"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure is a column expression over one text, so the filter is a narrow projection of the scan: no shuffle, and no memory beyond one text.

A null text has no words. Empty texts and texts without words fail the base rule; ratios over nothing are 0. Repeated documents are measured
each; empty tables give no row; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import SPACE, clean_text

#: Common words of the four languages; a text in one of them holds some of its own.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "at", "this", "from", "or", "an",
    "der", "die", "und", "das", "ist", "ein", "eine", "zu", "den", "von", "mit", "für", "auf", "im", "nicht", "dem",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "est", "en", "du", "pour", "dans", "qui", "au",
    "el", "los", "las", "y", "por", "con", "una", "se", "del", "es", "su", "al",
)

#: (name, measure, least, most), None for no bound: a text is kept if every measure of the table is in its bounds.
RULES = (
    ("words", "n_words", 50, 1_000_000),
    ("mean_word_length", "mean_word_length", 2.0, 12.0),
    ("symbols_per_word", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id with the measures that RULES names and the counts they are made of."""
    text = documents.select("doc_id", clean_text().alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    base = text.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    sized = base.withColumns({"n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    # A window is known by the 64-bit hash of its words' hashes. Hashes sorted alone say whether any window comes twice; only then are
    # they sorted with their positions, which puts equal windows side by side.
    window = lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2))
    places = F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)
    windowed = sized.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(places, window)).otherwise(F.array().cast("array<long>"))).withColumn("sorted", F.sort_array("windows"))
    any_twice = F.exists(F.transform("sorted", lambda h, i: F.coalesce(F.get("sorted", i + 1) == h, F.lit(False))), lambda x: x)
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = windowed.withColumn("placed", F.when(any_twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    hash_at = lambda i: F.get("placed", i)["h"]
    twice = F.filter("placed", lambda x, k: F.coalesce(hash_at(k - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(k + 1) == x["h"], F.lit(False)))
    found = placed.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    repeated = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x).cast("long")
    # Generated rather than projected, so that a filter on a measure is not rewritten into the expressions above, several times over.
    counted = found.select("doc_id", F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_lines",
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    ))))
    c = F.col
    return counted.withColumns({
        "mean_word_length": _per(c("word_chars"), c("n_words")), "symbol_ratio": _per(c("n_symbols"), c("n_words")), "stop_ratio": _per(c("n_stop_words"), c("n_words")), "repeat_ratio": _per(c("n_repeat_words"), c("n_words")),
        "dup_line_ratio": _per(c("n_dup_lines"), c("n_lines")), "bullet_ratio": _per(c("n_bullet_lines"), c("n_lines")), "ellipsis_ratio": _per(c("n_ellipsis_lines"), c("n_lines")),
    })


def compile_rules(rules=RULES) -> Column:
    """The table as one condition: an array of the names of the rules that a row breaks."""
    broken = []
    for name, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < least)
        if most is not None:
            bad = bad | (F.col(measure) > most)
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken))


def judge(documents: DataFrame, rules=RULES) -> DataFrame:
    """Every document with its measures, the base rule's verdict, the rules it breaks and the verdict."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured(documents).withColumn("base_failed", base_failed).withColumn("broken", compile_rules(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
