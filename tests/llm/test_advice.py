"""Cases that earlier versions of the training-data operators left out."""

import numpy as np

from citegrain.llm import passage_dedup, simhash, toxicity


def test_rare_markers_are_not_dropped(spark):
    """Thirty toxic words with fewer than 20 neighbours each among ordinary ones."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij"))
    name = lambda k: "".join(letters[[int(c) for c in f"{k:03d}"]])
    rows = []
    for i in range(1500):
        words = ["w" + name(k) for k in rng.integers(0, 400, 40)]
        if i % 5 == 0:
            for at in rng.choice(40, 4, replace=False):
                words[at] = "vile" + name(rng.integers(0, 60))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)], "doc_id long, toxic int")
    out = [r for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect() if r["held_out"]]
    bad, good = ([r["predicted"] for r in out if (r["doc_id"] % 5 == 0) == c] for c in (True, False))
    assert np.mean(bad) > 0.9 and np.mean(good) < 0.05


def test_all_labelled_texts_are_counted(spark):
    """Each of 14,000 texts has two words, one of its own; all of them are in the counts."""
    docs = spark.range(14_000).selectExpr("id AS doc_id", "concat('common x', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "cast(id % 10 < 3 AS int) AS toxic")
    counts = {r["gram"]: (r["n0"], r["n1"]) for r in toxicity.count_grams(docs.select("text", "toxic")).where("length(gram) = 2").collect()}
    assert counts == {toxicity.START + "c": (9800, 4200), toxicity.START + "x": (9800, 4200)}


def test_passages_with_other_text_between(spark):
    """Two exact passages in the same order, with 40 to 150 words of each document's own between: both are found."""
    rng = np.random.default_rng(8)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    rows, want = [], set()
    for k, (size, gap) in enumerate([(60, 40), (60, 100), (100, 60), (200, 150)] * 5):
        one, two = fresh(size), fresh(size)
        for d in (2 * k, 2 * k + 1):
            rows.append((d, " ".join(fresh(30) + one + fresh(gap) + two + fresh(30))))
        want |= {(2 * k + 1, 30, 30 + size), (2 * k + 1, 30 + size + gap, 30 + 2 * size + gap)}
    found = passage_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == want and all(r["identity"] == 1 for r in found)


def test_all_candidates_are_verified(spark):
    """A text's nearest fingerprints are of its own words in other orders; farther ones are those of its near copies."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(20):
        words = [f"k{k}w{i}" for i in range(200)]
        copy = list(words)
        for i in (60, 130):
            copy[i] = f"k{k}other{i}"
        shuffled = [" ".join(rng.permutation(words)) for _ in range(2)] + [" ".join(rng.permutation(copy)) for _ in range(2)]
        texts = [" ".join(words), *shuffled, " ".join(copy)]
        rows += [(10 * k + n, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert left == {10 * k + n for k in range(20) for n in range(5)}
