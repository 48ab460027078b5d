"""What a question asks: content words, acronyms, search queries, shape predicates, anaphora, topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.functions.text import col, contains_any, text_or_empty

# Words that carry no subject, acronyms, and the phrases that give a question its shape.
WORD = r"[A-Za-z][A-Za-z-]*"
SCAFFOLD = tuple(dict.fromkeys("""
what which how why who when where is are was were does do did can could should would will the a an of in on to for and or with from by at as that
this these those there about into over under between any some its it current currently recent recently trend trends trending latest emerging
nowadays lately modern new state art today scope scopes scoping overview landscape summary summarise summarize review reviews survey surveys
area areas topic topics direction directions avenue avenues opportunity opportunities outlook progress advance advances advancement advancements
development developments insight insights perspective perspectives research researches study studies paper papers work works literature
publication publications article articles journal journals field fields domain problem problems gap gaps challenge challenges question questions
open unresolved major main most important key good best common existing compare compared comparison versus vs differ differs difference
differences contrast against similar similarity same better worse instead online offline local locally internet web elsewhere here mine ours
theirs tell give show explain describe list find me please you your i my we our us used use uses using make made get got have has had been being be
""".split()))
ACRONYMS = {
    "llm": "large language model", "llms": "large language model", "vlm": "vision language model", "vlms": "vision language model",
    "rag": "retrieval augmented generation", "gnn": "graph neural network", "gnns": "graph neural network",
    "cnn": "convolutional neural network", "cnns": "convolutional neural network", "rnn": "recurrent neural network",
    "vit": "vision transformer", "vits": "vision transformer", "nlp": "natural language processing", "rl": "reinforcement learning",
    "ssl": "self supervised learning", "moe": "mixture of experts", "nas": "neural architecture search",
    "gan": "generative adversarial network", "gans": "generative adversarial network", "ocr": "optical character recognition",
    "asr": "automatic speech recognition", "fl": "federated learning",
}
SURVEY = ("current", "recent", "trend", "trends", "trending", "nowadays", "lately", "state of the art", "state-of-the-art", "emerging", "latest", "these days")
LIMITATIONS = (
    "limitation", "limitations", "limited by", "weakness", "weaknesses", "shortcoming", "shortcomings", "drawback", "drawbacks", "caveat",
    "caveats", "downside", "downsides", "criticism", "fail", "fails", "failure", "failures", "cannot", "can't", "does not work", "doesn't work",
    "threats to validity", "future work", "unaddressed", "not addressed", "what is wrong", "problems with", "issues with", "critique",
)
COMPARE = (
    "compare", "compared", "comparison", "versus", " vs ", " vs.", "differ", "difference", "differences", "contrast", "how does it stack",
    "better than", "worse than", "same as", "similar to", "in line with", "against the", "relative to", "how does my", "how does this paper",
)
ONLINE = (
    "online", "internet", "web", "live", "recent", "current", "latest", "arxiv", "pubmed", "openalex", "literature", "published", "elsewhere",
    "outside", "state of the art", "state-of-the-art", "others",
)
OWNER = (
    "the author", "author's", "authors'", "who built", "who made", "who wrote this", "who created", "your background", "your research",
    "your work", "your experience", "his background", "his research", "his work", "his experience", "their background", "who is behind",
    "about you", "about the person", "portfolio",
)
PERSONAL = (
    "strength", "strengths", "weakness", "skills", "expertise", "cv", "resume", "curriculum vitae", "education", "degree", "supervisor", "hire",
    "hiring", "available", "contact", "email", "affiliation", "publications", "background", "experience", "currently working", "working on",
    "recently", "bio", "biography",
)
PERSON = ("he ", "his ", "him ", "they ", "their ", "you ", "your ", "author")
ANAPHORA = ((r"(?i)\b(?:the\s+)?authors?['’]?s?\b", ""), (r"(?i)\b(?:his|her|their|your)\b", "'s"), (r"(?i)\b(?:he|she|they|you)\b", ""))
TOPICS = {
    "language models": ("language model", "llm", "gpt", "bert", "transformer", "mixtral", "instruction", "attention is all"),
    "reasoning": ("chain-of-thought", "chain of thought", "reasoning", "verify step"),
    "efficient training": ("efficient", "lora", "quantiz", "distill", "sparse", "mixture of experts", "flash"),
    "retrieval-augmented generation": ("retrieval-augmented", "retrieval augmented"),
    "long context": ("long context", "long-context", "context window"),
    "agents": ("agent", "autogen", "tool use"),
    "multimodal": ("multimodal", "vision-language", "vision language", "clip", "blip", "flamingo"),
    "computer vision": ("vision transformer", "image recognition", "masked autoencoder", "swin", "segment anything", "16x16"),
    "3d vision": ("3d ", "point cloud", "nerf"),
    "medical imaging": ("medical", "radiology", "retinopathy", "clinical", "diabetic"),
    "single-cell": ("single-cell", "single cell", "scgpt", "geneformer", "transcriptom", "chromatin"),
    "perturbation prediction": ("perturbation", "crispr", "gears", "cpa", "in silico"),
    "gene regulatory networks": ("regulatory network", "grn"),
    "causal inference": ("causal", "causation", "intervention", "dag", "counterfactual"),
    "federated learning": ("federated", "privacy-preserving", "homomorphic"),
    "pathology": ("patholog", "histolog", "whole slide"),
    "renal imaging": ("renal", "kidney"),
    "report generation": ("report generation", "captioning"),
    "hallucination": ("hallucinat", "factual", "faithful"),
    "evaluation": ("benchmark", "evaluat", "metric"),
}
SURVEY_FLOOR = 4
SHAPES = ((1, 30, "single"), (31, 40, "pair"), (41, 50, "corpus"), (51, 80, "verify"))


def _framed(question: Column | str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.lower(text_or_empty(question))), F.lit(" "))


def terms(question: Column | str, most: int = 6, least_length: int = 2) -> Column:
    """The first `most` content words, in order, each once."""
    words = F.regexp_extract_all(F.lower(text_or_empty(question)), F.lit(WORD), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*SCAFFOLD) & (F.length(w) >= least_length))), 1, most)


def _acronyms() -> Column:
    return F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])


def expand(term: Column) -> Column:
    """The term and, if it is an acronym, its long form."""
    long = F.try_element_at(_acronyms(), term)
    return F.when(long.isNull(), F.array(term)).otherwise(F.array(term, long))


def fielded_query(question: Column | str) -> Column:
    """Terms quoted in an all-fields index and joined by AND; an acronym is an OR group. Empty without terms."""
    quote = lambda f: F.concat(F.lit('all:"'), f, F.lit('"'))
    group = lambda w: F.when(F.size(expand(w)) == 1, quote(w)).otherwise(F.concat(F.lit("("), F.array_join(F.transform(expand(w), quote), " OR "), F.lit(")")))
    return F.array_join(F.transform(terms(question, 6), group), " AND ")


def boolean_query(question: Column | str) -> Column:
    """Five terms joined by AND; an acronym is an OR group in which forms of several words are quoted."""
    form = lambda f: F.when(f.contains(" "), F.concat(F.lit('"'), f, F.lit('"'))).otherwise(f)
    group = lambda w: F.when(F.size(expand(w)) == 1, w).otherwise(F.concat(F.lit("("), F.array_join(F.transform(expand(w), form), " OR "), F.lit(")")))
    return F.array_join(F.transform(terms(question, 5), group), " AND ")


def ranked_query(question: Column | str) -> Column:
    """Eight terms with their long forms, each once, joined by spaces."""
    return F.array_join(F.array_distinct(F.flatten(F.transform(terms(question, 8), expand))), " ")


def asks_for_survey(question: Column | str) -> Column:
    return contains_any(F.lower(text_or_empty(question)), SURVEY)


def asks_for_limitations(question: Column | str) -> Column:
    return contains_any(_framed(question), LIMITATIONS)


def asks_to_compare(question: Column | str) -> Column:
    return contains_any(_framed(question), COMPARE)


def compares_with_online(question: Column | str) -> Column:
    return asks_to_compare(question) & contains_any(_framed(question), ONLINE)


def asks_about_owner(question: Column | str, names: tuple[str, ...] = ()) -> Column:
    """Whether the question is about the collection's owner, whose names (in lower case) are a parameter."""
    q = _framed(question)
    return contains_any(q, OWNER + tuple(names)) | (contains_any(q, PERSONAL) & contains_any(q, PERSON + tuple(names)))


def resolve_anaphora(question: Column | str, who: str) -> Column:
    """Pronouns become the name; without any part of it the name is put in front."""
    out = text_or_empty(question)
    if not who:
        return out
    for pattern, ending in ANAPHORA:
        out = F.regexp_replace(out, pattern, who.replace("\\", "\\\\").replace("$", "\\$") + ending)
    parts = [t for t in (p.strip(".,'’").lower() for p in who.split()) if len(t) > 2]
    named = contains_any(F.lower(out), parts)
    return F.trim(F.regexp_replace(F.when(named, out).otherwise(F.concat(F.lit(f"{who}: "), out)), r"(?U)\s+", " "))


def topics_for(question: Column | str) -> Column:
    """Names of the topics of which a key occurs, in the table's order."""
    q = F.lower(text_or_empty(question))
    return F.array_compact(F.array(*[F.when(contains_any(q, keys), F.lit(name)) for name, keys in TOPICS.items()]))


def coverage(best: Column) -> tuple[Column, Column]:
    """(coverage, expected behaviour) by the papers on the question's best-covered topic."""
    what = F.when(best == 0, "beyond_corpus").when(best < SURVEY_FLOOR, "thin").otherwise("partial")
    return what, F.when(best == 0, "refuse").otherwise("scoped")


def shape_of(number: Column | str) -> Column:
    n = col(number)
    out = F.lit(None).cast("string")
    for low, high, shape in reversed(SHAPES):
        out = F.when(n.between(low, high), shape).otherwise(out)
    return out
