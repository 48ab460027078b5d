"""Page geometry as relational algebra: words to lines in reading order, lines to headings and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances in points, and the patterns of headings, captions, page furniture, banners and mastheads.
BASELINE, GLUE, GUTTER, SIZES_DIFFER, MARKER_RATIO = 2.0, 2.0, 18.0, 0.01, 0.82
BINS, SEARCHED, TROUGH, LEAST_WORDS, LEAST_SIDE = 80, (25, 54), 0.40, 40, 0.15
MARKER = r"^[0-9]{1,3}(?:[,–-][0-9]{1,3})*$"
NUMBERING = r"^\s*(\d+(\.\d+)*|[IVXLC]+|[A-Z])[.)]?\s+"
KINDS = (
    (r"^abstract$", "abstract"),
    (r"^(1\.?\s*)?introduction$", "introduction"),
    (r"^(related\s+work|background|prior\s+work|literature\s+review)$", "related"),
    (r"^(materials?\s+and\s+methods?|methods?|methodology|approach|experimental\s+setup|model|architecture|data\s+and\s+methods?)$", "methods"),
    (r"^(results?|experiments?|experiments?\s+and\s+results?|evaluation|findings)$", "results"),
    (r"^(discussion|analysis|ablations?|ablation\s+stud(y|ies))$", "discussion"),
    (r"^(conclusions?|concluding\s+remarks|summary|conclusions?\s+and\s+future\s+work)$", "conclusion"),
    (r"^(references|bibliography)$", "references"),
    (r"^(appendix|appendices|supplementary(\s+material)?)", "appendix"),
)
FURNITURE = (
    r"(?i)^\s*(open\s*access|article|resource|review|correspondence|perspective|brief\s+communication|letter|editorial|preprint|"
    r"(extended\s+data\s+)?(fig(ure)?|table|supplementary|supp)\b|see\s+also|in\s+brief|highlights|graphical\s+abstract|"
    r"https?://|www\.|doi:|©|creative\s+commons)"
)
CAPTION = r"(?i)^\s*(extended\s+data\s+)?(fig(ure)?\.?|table|supplementary\s+(fig(ure)?|table))\s*\.?\s*\d{1,3}\b"
PANEL = r"(?i)^\s*[a-z]([\s,]+[a-z])*\s*$"
BANNER = (
    r"(?i)^(hhs public access|nih public access|author manuscript|europe pmc|published in final edited form|open access|research article|"
    r"original (research )?article|review article|brief communication|downloaded from|see discussions, stats|preprint|"
    r"\d+\.?\s+(introduction|abstract|background|related work)\b)"
)
MASTHEAD = (
    r"(?i)^[\w&.,'’\- ]{0,44}\b(journal|transactions|proceedings|annals|bulletin|acta|scientific\s+reports|results\s+in|advances\s+in|"
    r"frontiers\s+in)\b[\w&.,'’\- ]{0,20}$"
)
MOST_HEADING_WORDS, MASTHEAD_CHARS, TITLE_CHARS, SECTION_CHARS, PAGE_CHARS = 12, 45, 300, 40, 100


def drop_markers(words: DataFrame) -> DataFrame:
    """Without rotated words and superscript reference marks (digits under 0.82 of the page's upper-median size)."""
    upright = words.where(F.coalesce("upright", F.lit(True)))
    sizes = F.sort_array(F.collect_list("size").over(Window.partitionBy("doc_id", "page")))
    middle = F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))
    return upright.withColumn("_m", middle).where(~(F.col("text").rlike(MARKER) & (F.col("size") < MARKER_RATIO * F.col("_m")))).drop("_m")


def baselines(words: DataFrame) -> DataFrame:
    """With `line`: words in order of their bottoms; a gap of over BASELINE to the one before starts a line."""
    order = Window.partitionBy("doc_id", "page").orderBy("bottom", "x0")
    opens = F.coalesce((F.col("bottom") - F.lag("bottom").over(order) > BASELINE).cast("int"), F.lit(0))
    marked = words.withColumn("_o", opens)
    return marked.withColumn("line", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def column_split(words: DataFrame) -> DataFrame:
    """(doc_id, page, split): the middle of the emptiest bin near the page's middle, if it is a trough between two sides that hold words enough; else null.
    words also has page_width."""
    key = ["doc_id", "page"]
    clamp = lambda x: F.least(F.greatest((x * BINS / F.col("page_width")).cast("int"), F.lit(0)), F.lit(BINS - 1))
    covered = words.select(*key, "page_width", F.explode(F.sequence(clamp(F.col("x0")), F.greatest(clamp(F.col("x0")), clamp(F.col("x1"))))).alias("bin")).groupBy(*key, "page_width", "bin").agg(F.count("*").alias("n"))
    pages = words.groupBy(*key, "page_width").agg(F.count("*").alias("words"))
    spine = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).join(covered, [*key, "page_width", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    near = F.col("bin").between(SEARCHED[0], SEARCHED[1] - 1)
    best = spine.groupBy(*key, "page_width", "words").agg(F.max("n").alias("peak"), F.min(F.when(near, F.struct("n", "bin"))).alias("low"))
    split = F.when((F.col("words") >= LEAST_WORDS) & (F.col("low.n") <= TROUGH * F.col("peak")), (F.col("low.bin") + 0.5) * F.col("page_width") / BINS)
    found = best.select(*key, "words", split.alias("split"))
    sides = words.join(found, key).groupBy(*key, "split", F.col("words").alias("n")).agg(F.sum((F.col("x1") <= F.col("split")).cast("int")).alias("l"), F.sum((F.col("x0") >= F.col("split")).cast("int")).alias("r"))
    return sides.select(*key, F.when((F.col("l") >= LEAST_SIDE * F.col("n")) & (F.col("r") >= LEAST_SIDE * F.col("n")), F.col("split")).alias("split"))


def gutters(words: DataFrame) -> DataFrame:
    """With `part`: a gap of over GUTTER on a line starts another part of it."""
    order = Window.partitionBy("doc_id", "page", "line").orderBy("x0")
    marked = words.withColumn("_o", F.coalesce((F.col("x0") - F.lag("x1").over(order) > GUTTER).cast("int"), F.lit(0)))
    return marked.withColumn("part", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def reading_order(fragments: DataFrame) -> DataFrame:
    """fragments (doc_id, page, x0, x1, top, split) with `position`: by top and x0; on a page with a split, between full-width fragments all of the left
    side comes before the right."""
    page = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    side = F.when(F.col("split").isNull(), 0).when(F.col("x1") <= F.col("split"), 0).when(F.col("x0") >= F.col("split"), 1).otherwise(2)
    sided = fragments.withColumn("_side", side)
    band = F.sum((F.col("_side") == 2).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("_side") == 2).cast("int")
    banded = sided.withColumn("_band", band)
    return banded.withColumn("position", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("_band", "_side", "top", "x0"))).drop("_side", "_band")


def lines(words: DataFrame, key=("doc_id", "page", "line", "part")) -> DataFrame:
    """One row per fragment: its text (words that a font change split are joined), box, size (median), display_size and whether it is bold."""
    order = Window.partitionBy(*key).orderBy("x0")
    glued = (F.col("x0") - F.lag("x1").over(order) < GLUE) & (F.abs(F.col("size") - F.lag("size").over(order)) >= SIZES_DIFFER)
    led = words.withColumn("_lead", F.when(F.lag("x1").over(order).isNull() | glued, "").otherwise(" "))
    bold = F.lower(F.coalesce("fontname", F.lit(""))).rlike("bold|black|heavy|-b$")
    ordered = F.sort_array(F.collect_list(F.struct("x0", F.concat("_lead", "text").alias("t"))))
    falling = F.sort_array(F.collect_list("size"), False)
    return led.groupBy(*key).agg(
        F.trim(F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"),
        F.round(F.median("size"), 2).alias("size"), F.round(F.get(falling, F.floor(F.size(falling) * 0.25).cast("int")), 2).alias("display_size"), (F.avg(bold.cast("double")) > 0.5).alias("bold"),
    )


def body_size(line_rows: DataFrame) -> DataFrame:
    """(doc_id, body): the size that most characters have; the first seen wins a tie. line_rows has line_no."""
    sums = line_rows.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min("line_no").alias("first"))
    return sums.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def classify(heading: Column) -> Column:
    """The kind of section that a heading names, or other."""
    t = F.lower(F.trim(F.regexp_replace(heading, NUMBERING, "")))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[^\w\s&]+$", ""), "&", "and"), r"\s+", " ")
    out = F.lit("other")
    for pattern, kind in reversed(KINDS):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def looks_like_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    numbering = text.rlike(NUMBERING)
    shape = n.between(1, MOST_HEADING_WORDS) & (~F.rtrim(text).rlike(r"[.,;:]$") | numbering) & ~text.rlike(r"^[\d\s.\-–—]+$") & (F.length(F.trim(text)) > 2) & ~text.rlike(PANEL) & ~text.rlike(FURNITURE)
    larger = size >= body + 0.6
    upper = (text == F.upper(text)) & (text != F.lower(text))
    return shape & (larger | (bold & (size >= body - 0.2)) | (numbering & (bold | larger)) | ((classify(text) != "other") & (bold | larger | upper)))


def is_caption(text: Column, size: Column, bold: Column, body: Column) -> Column:
    return text.rlike(CAPTION) & ((size >= body - 0.2) | bold)


def plausible_title(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    t = F.trim(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (
        (F.size(words) >= 2) & (F.length(text) >= 15) & ~t.rlike(BANNER) & ~((F.length(t) <= MASTHEAD_CHARS) & t.rlike(MASTHEAD))
        & (F.size(F.filter(words, lambda w: F.length(w) == 1)) <= F.size(words) * 0.5) & (letters >= F.length(text) * 0.5)
    )


def pick_title(line_rows: DataFrame) -> DataFrame:
    """(doc_id, title) from the first page's sizes, the largest first: the first whose joined lines could be a title, or Untitled."""
    first = line_rows.where((F.col("page") == 1) & (F.trim("text") != "")).withColumn("tier", F.round("display_size", 1))
    used = first.where(~F.col("text").rlike("(?i)^arxiv:") & ~F.col("text").rlike(FURNITURE))
    tiers = first.select("doc_id", F.col("tier").alias("of")).distinct().join(used.select("doc_id", "tier", "line_no", "text"), "doc_id").where(F.abs(F.col("tier") - F.col("of")) < 0.15)
    joined = tiers.groupBy("doc_id", "of").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("t")).withColumn("t", F.trim(F.regexp_replace("t", r"\s+", " ")))
    best = joined.where(plausible_title(F.col("t"))).groupBy("doc_id").agg(F.max_by("t", "of").alias("t"))
    return line_rows.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce(F.trim(F.substring("t", 1, TITLE_CHARS)), F.lit("Untitled")).alias("title"))


def heading_levels(headings: DataFrame) -> DataFrame:
    """With `level`: 1 for the largest half-point size of the document, then on."""
    half = F.bround(F.col("size") * 2, 0) / 2
    return headings.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc(half))))


def inherit_kinds(headings: DataFrame) -> DataFrame:
    """headings (doc_id, line_no, level, named) with `kind`: an unnamed heading has that of the nearest one above it of a smaller level."""
    entry = F.struct("line_no", "level", "named")
    per = headings.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("h"))
    kind_type = "array<struct<level:int,kind:string>>"
    start = F.struct(F.array().cast(kind_type).alias("stack"), F.array().cast("array<string>").alias("kinds"))

    def step(a: Column, x: Column) -> Column:
        stack = F.filter(a["stack"], lambda s: s["level"] < x["level"])  # levels rise along the stack, so this pops its top
        kind = F.when((x["named"] == "other") & (F.size(stack) > 0), F.get(stack, F.size(stack) - 1)["kind"]).otherwise(x["named"])
        return F.struct(F.array_append(stack, F.struct(x["level"].cast("int").alias("level"), kind.alias("kind"))).cast(kind_type).alias("stack"), F.array_append(a["kinds"], kind).alias("kinds"))

    done = per.withColumn("kinds", F.aggregate("h", start, step, lambda a: a["kinds"]))
    return done.select("doc_id", F.explode(F.arrays_zip("h", "kinds")).alias("x")).select("doc_id", "x.h.line_no", "x.h.level", "x.h.named", F.col("x.kinds").alias("kind"))


def vocabulary(line_rows: DataFrame) -> DataFrame:
    """(doc_id, vocabulary): the document's words in lower case, without the halves of words that a line end breaks."""
    whole = F.regexp_replace("text", r"\w+-\s*$|\w+-\s+\w+", " ")
    words = F.transform(F.regexp_extract_all(whole, F.lit(r"\w+(?:-\w+)*"), F.lit(0)), lambda w: F.lower(w))
    return line_rows.select("doc_id", F.explode(words).alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("vocabulary"))


def dehyphenate(text: Column, known: Column) -> Column:
    """Words broken at a line end are rejoined, by the document's own vocabulary: before a capital or digit nothing changes; else merged if that is a word,
    hyphenated if that or both halves are, otherwise merged."""
    pattern = r"(?U)(\w+)-\s+(\w+)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    has = lambda w: F.array_contains(known, F.lower(w))

    def fix(m: Column) -> Column:
        a, b = F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)
        merged, hyphened = F.concat(a, b), F.concat(a, F.lit("-"), b)
        start = F.substring(b, 1, 1)
        lower = (start == F.lower(start)) & (start != F.upper(start))
        return F.when(~lower, m).when(has(merged), merged).when(has(hyphened), hyphened).when(has(a) & has(b), hyphened).otherwise(merged)

    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.array_append(F.transform(found, fix), F.lit("")), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def sections(line_rows: DataFrame) -> DataFrame:
    """line_rows (doc_id, page, line_no, text, size, bold) to (doc_id, section_no, kind, heading, page_start, page_end, text). Headings and captions open sections; on
    page 1 only named headings do; a caption's section takes what follows it; texts under 40 characters are dropped."""
    bodied = line_rows.join(body_size(line_rows), "doc_id")
    t, size, bold, body = F.col("text"), F.col("size"), F.coalesce("bold", F.lit(False)), F.col("body")
    caption = is_caption(t, size, bold, body)
    named = classify(t)
    heading = ~caption & looks_like_heading(t, size, bold, body) & ((F.col("page") > 1) | (named != "other"))
    marked = bodied.withColumns({"_caption": caption, "_heading": heading, "named": named})
    kinds = inherit_kinds(heading_levels(marked.where("_heading"))).select("doc_id", "line_no", F.col("kind").alias("_kind"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    opened = marked.join(kinds, ["doc_id", "line_no"], "left").withColumn("section_no", F.sum((F.col("_caption") | F.col("_heading")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda x: F.min_by(x, "line_no")
    kind = F.when(F.col("_caption"), F.when(t.rlike(r"(?i)^\s*table"), "table").otherwise("figure")).when(F.col("_heading"), F.col("_kind")).otherwise("title")
    stripped = F.trim(F.regexp_replace("text", NUMBERING, ""))
    title = F.when(F.col("_caption"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 8), " ")).when(F.col("_heading"), F.when(stripped != "", stripped).otherwise(F.col("text"))).otherwise("")
    parts = F.transform(F.sort_array(F.collect_list(F.when(~F.col("_heading"), F.struct("line_no", "text")))), lambda x: x["text"])
    grouped = opened.groupBy("doc_id", "section_no").agg(first(kind).alias("kind"), first(title).alias("heading"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")).alias("text"))
    fixed = grouped.join(vocabulary(line_rows), "doc_id", "left").withColumn("text", dehyphenate(F.col("text"), F.coalesce("vocabulary", F.array().cast("array<string>")))).drop("vocabulary")
    return fixed.where(F.length("text") >= SECTION_CHARS)


def scanned(line_rows: DataFrame) -> DataFrame:
    """Documents with fewer than 100 characters a page: scans, to be refused."""
    return line_rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"), F.max("page").alias("n_pages")).where(F.col("n_chars") < PAGE_CHARS * F.col("n_pages"))


def identifiers(text: Column) -> Column:
    """A preprint's or else a DOI's identifier in a text, or null."""
    preprint = F.regexp_extract(text, r"(?i)arxiv:\s*(\d{4}\.\d{4,5})", 1)
    doi = F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)", 1)
    return F.coalesce(F.nullif(preprint, F.lit("")), F.nullif(doi, F.lit("")))


def authors(text: Column) -> Column:
    """Names in a line of authors: marks are dropped, 'and' separates, two to five words a name, at most twenty."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\d*†‡§¶]+", ""), r"(?i)\band\b", ",")
    names = F.transform(F.split(bare, ","), lambda n: F.regexp_replace(n, r"^[ ,.;]+|[ ,.;]+$", ""))
    return F.slice(F.filter(names, lambda n: F.size(F.filter(F.split(n, r"\s+"), lambda w: w != "")).between(2, 5)), 1, 20)
