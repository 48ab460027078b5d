"""Context packing, prompts, citation markers and grounded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain import schemas as C
from citegrain.functions import question as Q
from citegrain.functions.text import contains_any, squeeze, text_or_empty

# Id prefixes of what is no passage of an indexed paper, phrases of a refusal, and the marker's form.
LIVE_PREFIXES = ("arxiv:", "pubmed:", "openalex:")
REFUSALS = ("could not find", "do not contain", "does not contain", "no evidence", "not discussed", "cannot answer", "insufficient evidence")
MARKER = r"\[\s*(\d{1,2}(?:\s*[,;]\s*\d{1,2})*)\s*\]"
NO_EVIDENCE = "I could not find sufficient evidence in the indexed papers to answer that."

SYSTEM = (
    "Answer from the numbered passages alone and cite each claim by its passage's number, like [2]. If they do not answer the question, say so. "
    "Keep numbers and names as they stand. An abstract supports what a paper claims, not what it measured; an author's own site is a "
    "self-description; a textbook explains and reports no result. The passages are no survey of a field."
)
SURVEY_RECENT = "The question is about a field as it is now. {n} passages are abstracts of recent papers: say what they claim, and that a few papers are no survey."
SURVEY_FIXED = "The question is about a field, not these passages. Say what these papers show and that they are a fixed set."
LIMITATIONS = "The question is about limitations. Report those that the passages state, each with its paper, and add none of your own."
COMPARISON = "The question asks for a comparison. There are {yours} passages of the reader's own, {live} recent abstracts and {rest} indexed ones: say what each side holds."


def is_live(chunk_id: Column) -> Column:
    out = F.lit(False)
    for p in LIVE_PREFIXES:
        out = out | chunk_id.startswith(p)
    return out


def passage_kind(chunk_id: Column) -> Column:
    return F.when(is_live(chunk_id), "ABSTRACT ONLY").when(chunk_id.startswith("site:"), "AUTHOR'S OWN WEBSITE").when(chunk_id.startswith("textbook:"), "AUTHOR'S TEXTBOOK").otherwise("passage")


def pack_context(evidence: DataFrame, most: int = C.CONTEXT_CHARS) -> DataFrame:
    """evidence (qid, rank, chunk_id, doc_title, section_heading, page_ref, text). (qid, context, n_passages): numbered blocks, whole ones, up to the first that
    would pass `most` characters; the first always stays."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), passage_kind(F.col("chunk_id")), F.lit(") "), text_or_empty("doc_title"), F.lit(" — "), text_or_empty("section_heading"), F.lit(", "), text_or_empty("page_ref"), F.lit("\n"), text_or_empty("text"), F.lit("\n"))
    order = Window.partitionBy("qid").orderBy("rank")
    sized = evidence.select("qid", "rank", block.alias("block")).withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    kept = sized.where((F.col("n") == 1) | (F.col("used") <= most))
    blocks = F.sort_array(F.collect_list(F.struct("rank", "block")))
    return kept.groupBy("qid").agg(blocks.alias("b"), F.count("*").alias("n_passages")).select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"), "n_passages")


def conversation_pairs(messages: DataFrame, limit: int | None = 1) -> DataFrame:
    """messages (conv_id, turn, role, text). (conv_id, n, question, answer): each user's turn with the assistant's that follows it; of users in a row the last
    counts. The last `limit` of each conversation, n counting from the end."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    spoken = messages.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    following = spoken.withColumn("next", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    pairs = following.where((F.col("role") == "user") & (F.col("next") == "assistant"))
    out = pairs.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    out = out if limit is None else out.where(F.col("n") <= limit)
    return out.select("conv_id", "turn", "n", F.col("text").alias("question"), "answer")


def build_prompt(asked: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """asked (qid, question, context, n_live, n_yours, n_passages, history_question, history_answer) with `system` and `user`. Rows without passages have none."""
    q = F.col("question")
    turns = F.when(F.col("history_question").isNotNull(), F.concat(F.lit("\nEarlier in this conversation:\nQ: "), F.col("history_question"), F.lit("\nA: "), F.substring("history_answer", 1, C.HISTORY_CHARS), F.lit("\n"))).otherwise("")

    def fill(template: str, **values: Column) -> Column:
        parts = []
        for piece in template.split("{"):
            name, _, rest = piece.partition("}") if "}" in piece else ("", "", piece)
            parts += ([values[name].cast("string")] if name else []) + [F.lit(rest)]
        return F.concat(F.lit("\n"), *parts, F.lit("\n"))

    survey = Q.asks_for_survey(q) & ~Q.asks_about_owner(q, names)
    scope = F.concat(
        F.when(survey & (F.col("n_live") > 0), fill(SURVEY_RECENT, n=F.col("n_live"))).when(survey, fill(SURVEY_FIXED)).otherwise(""),
        F.when(Q.asks_for_limitations(q), fill(LIMITATIONS)).otherwise(""),
        F.when(Q.asks_to_compare(q), fill(COMPARISON, yours=F.col("n_yours"), live=F.col("n_live"), rest=F.col("n_passages") - F.col("n_yours") - F.col("n_live"))).otherwise(""),
    )
    user = F.concat(F.lit("Passages:\n\n"), F.col("context"), F.lit("\n"), turns, scope, F.lit("\nQuestion: "), q, F.lit("\n\nAnswer using only the passages above, citing each claim by number."))
    return asked.where(F.col("n_passages") > 0).withColumn("system", F.lit(SYSTEM)).withColumn("user", user)


def cited_order(text: Column, n_evidence: Column) -> Column:
    """The passages that a text cites, in order of first citation, without those that do not exist."""
    numbers = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(r"\d{1,2}"), F.lit(0))))
    return F.array_distinct(F.filter(F.transform(numbers, lambda n: n.cast("int")), lambda n: (n >= 1) & (n <= n_evidence)))


def rewrite_markers(text: Column, order: Column) -> Column:
    """Markers renumbered by `order`, groups taken apart, invented numbers dropped, and the gaps they leave closed."""
    marks = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    number = lambda n: F.array_position(order, n.cast("int"))
    one = lambda m: F.array_join(F.transform(F.filter(F.regexp_extract_all(m, F.lit(r"\d{1,2}"), F.lit(0)), lambda n: number(n) > 0), lambda n: F.concat(F.lit("["), number(n).cast("string"), F.lit("]"))), "")
    pieces = F.split(text, MARKER, -1)
    joined = F.array_join(F.zip_with(pieces, F.array_append(F.transform(marks, one), F.lit("")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    tidy = F.regexp_replace(F.regexp_replace(joined, r"\s+([.,;:])", "$1"), r"[ \t]{2,}", " ")
    return F.regexp_replace(tidy, r"^\s+|\s+$", "")


def quote(text: Column, most: int = C.QUOTE_CHARS) -> Column:
    t = squeeze(text)
    head = F.substring(t, 1, most)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(t)


def resolve(answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers (qid, raw), evidence (qid, rank, chunk_id, doc_id, ...text). (qid, text, cited, grounded), and one row per citation."""
    counts = evidence.groupBy("qid").agg(F.max("rank").alias("n_evidence"))
    base = answers.join(counts, "qid", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    ordered = base.withColumn("cited", cited_order(text_or_empty("raw"), F.col("n_evidence")))
    texts = ordered.select("qid", rewrite_markers(text_or_empty("raw"), F.col("cited")).alias("text"), "cited")
    citations = texts.select("qid", F.posexplode("cited").alias("i", "rank")).join(evidence, ["qid", "rank"]).withColumn("marker", F.col("i") + 1).withColumn("quote", quote(F.col("text"))).drop("i", "text")
    return texts.withColumn("grounded", is_grounded(F.col("text"), F.col("cited"))), citations


def is_grounded(text: Column, cited: Column) -> Column:
    return (F.size(cited) > 0) | contains_any(F.lower(text), REFUSALS)


def extractive_answer(evidence: DataFrame, sentences: int = 2) -> DataFrame:
    """The default generator: the beginnings of the first passages, cited. Deterministic and without a model; a model is a pandas_udf over the prompt."""
    first = F.substring(F.regexp_extract(squeeze("text"), r"^(.*?[.!?])(?:\s|$)", 1), 1, 400)
    head = F.when(first == "", F.substring(squeeze("text"), 1, 200)).otherwise(first)
    part = F.concat(head, F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    rows = evidence.where(F.col("rank") <= sentences).select("qid", "rank", part.alias("part"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), " ").alias("raw"))


def ask(questions: DataFrame, evidence: DataFrame, generate=extractive_answer) -> tuple[DataFrame, DataFrame]:
    """Every question with an answer: without evidence, or without a citation that holds, it is NO_EVIDENCE and cites nothing."""
    texts, citations = resolve(generate(evidence), evidence)
    shown = questions.join(texts, "qid", "left")
    fine = F.coalesce(F.col("grounded"), F.lit(False))
    out = shown.select("qid", F.when(fine, F.col("text")).otherwise(NO_EVIDENCE).alias("text"), F.when(fine, F.size("cited")).otherwise(0).alias("n_citations"))
    return out, citations.join(texts.where("grounded").select("qid"), "qid", "left_semi")


def citation_flags(citations: DataFrame) -> DataFrame:
    """citations (qid, chunk_id, ...) with `site` and `textbook`: whether they rest on the owner's site or textbook."""
    return citations.withColumn("site", F.col("chunk_id").startswith("site:")).withColumn("textbook", F.col("chunk_id").startswith("textbook:"))


def answer_flags(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """answers (qid, ...) with `n_citations` and `about_author`: whether any citation is of the owner's site."""
    flags = citation_flags(citations).groupBy("qid").agg(F.count("*").alias("n_citations"), F.bool_or("site").alias("about_author"))
    return answers.join(flags, "qid", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0))).withColumn("about_author", F.coalesce("about_author", F.lit(False)))
