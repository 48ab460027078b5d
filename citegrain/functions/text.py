"""Column expressions over text: tokens, sentences, squeezing, bibliography density. All are null-safe: null is the empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9._+-]*"
STOP = tuple("a an and are as at be by for from has have in is it its of on or that the these this to was were will with".split())
SENTENCE_END = r"(?<=[.!?])[ \t\n\r\f\x0B]+(?=[A-Z(\[])"
CITE_LABEL = r"(?i)\[\d{1,3}\]|arXiv preprint|doi:\s*10\."
CITE_INITIALS = r"\b[A-Z]\.\s?[A-Z]?\.?\s+[A-Z][a-z]+"
BIBLIOGRAPHY_DENSITY = 2.5


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(x), r"(?U)\s+", " "))


def tokens(x: Column | str) -> Column:
    """Lower-cased matches of TOKEN without stop words, in order, repeats kept."""
    found = F.transform(F.regexp_extract_all(text_or_empty(x), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))
    return F.filter(found, lambda t: ~t.isin(*STOP))


def sentences(x: Column | str) -> Column:
    """Sentences in order, trimmed, empty ones dropped; the whole text if none is left."""
    parts = F.filter(F.transform(F.split(text_or_empty(x), SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text_or_empty(x)))


def bibliography_density(x: Column | str) -> Column:
    """Citation markers per 100 characters (of texts under 100, per text)."""
    t = text_or_empty(x)
    hits = F.regexp_count(t, F.lit(CITE_LABEL)) + F.regexp_count(t, F.lit(CITE_INITIALS))
    return hits / F.greatest(F.length(t) / 100, F.lit(1.0))


def looks_like_bibliography(x: Column | str) -> Column:
    return bibliography_density(x) > BIBLIOGRAPHY_DENSITY


def contains_any(haystack: Column, needles) -> Column:
    """Whether any of the needles is a substring."""
    out = F.lit(False)
    for w in needles:
        out = out | haystack.contains(w)
    return out


def fold_sentences(parts: Column, size: int, overlap: int, least: int, drop_bibliography: bool = True) -> Column:
    """Pack sentences into chunks of about `size` characters. A chunk is emitted with its last sentences (up to `overlap` characters) carried
    into the next; a chunk under `least` characters, or one that reads like a bibliography, is dropped and carries nothing."""
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("out"), empty.alias("buf"), F.lit(0).alias("n"))

    def chunk(buf: Column) -> Column:
        return F.trim(F.array_join(buf, " "))

    def good(text: Column) -> Column:
        ok = F.length(text) >= least
        return ok & ~looks_like_bibliography(text) if drop_bibliography else ok

    def tail(buf: Column) -> Column:
        start = F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        step = lambda a, s: F.when(
            a["open"] & (a["n"] + F.length(s) <= overlap),
            F.struct(F.concat(F.array(s), a["kept"]).alias("kept"), (a["n"] + F.length(s) + 1).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(F.reverse(buf), start, step, lambda a: F.struct(a["kept"].alias("kept"), a["n"].alias("n")))

    def merge(a: Column, s: Column) -> Column:
        text = chunk(a["buf"])
        full = (F.size(a["buf"]) > 0) & (a["n"] + F.length(s) > size)
        emit = full & good(text)
        carried = tail(a["buf"])
        out = F.when(emit, F.array_append(a["out"], text)).otherwise(a["out"])
        buf = F.when(emit, carried["kept"]).when(full, empty).otherwise(a["buf"])
        n = F.when(emit, carried["n"]).when(full, F.lit(0)).otherwise(a["n"])
        return F.struct(out.alias("out"), F.array_append(buf, s).alias("buf"), (n + F.length(s) + 1).alias("n"))

    def finish(a: Column) -> Column:
        text = chunk(a["buf"])
        return F.when(good(text), F.array_append(a["out"], text)).otherwise(a["out"])

    return F.aggregate(parts, state, merge, finish)


def split_passages(x: Column | str, size: int = 900) -> Column:
    """Passages of at most `size` characters on sentence boundaries, without overlap; a longer sentence stays whole."""
    t = squeeze(x)
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("out"), F.lit("").alias("buf"))
    step = lambda a, s: F.when(
        (a["buf"] != "") & (F.length(a["buf"]) + 1 + F.length(s) > size), F.struct(F.array_append(a["out"], a["buf"]).alias("out"), s.alias("buf"))
    ).otherwise(F.struct(a["out"].alias("out"), F.when(a["buf"] == "", s).otherwise(F.concat(a["buf"], F.lit(" "), s)).alias("buf")))
    folded = F.aggregate(F.split(t, r"(?<=[.!?])\s+"), state, step, lambda a: F.when(a["buf"] != "", F.array_append(a["out"], a["buf"])).otherwise(a["out"]))
    return F.when(F.length(t) <= size, F.array(t)).otherwise(folded)
