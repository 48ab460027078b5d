"""The training-data operators against brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrain.llm import chat, decontaminate, entry, line_dedup, packing, passage_dedup, quality_rules, simhash, site_quality, suffix_dedup, toxicity
from citegrain.llm.components import components

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, label long, chunk int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark, empty=False):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with names that operators use inside."""
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    rows = [
        (None, None, None, None, None, None, None, None, None), (1, None, "en", "a", 0, 1.0, "k", 1, 1), (2, "", "en", "a", 0, 1.0, "k", 1, 1), (3, " \n\t ", "en", None, 4, 1.0, "k", 1, 1),
        (4, "one two three", "en", "a", 13, 1.0, "k", 1, 1), (4, "one two three", "en", "a", 13, 1.0, "k", 1, 1), (5, "é😀 ß " * 30, "de", "b", 150, 1.0, "k", 1, 1), (6, long, "en", "b", len(long), 1.0, "k", 1, 1),
        (7, long + " end", "en", "b", len(long) + 4, 1.0, "k", 1, 1), (None, "one two three", "en", "a", 13, 1.0, "k", 1, 1), (8, "#" * 3000, "en", "a", 3000, 1.0, "k", 1, 1),
    ]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def odd_labels(spark):
    return spark.createDataFrame([(None, 1, 1), (1, None, None), (4, 1, 1), (4, 0, 0), (6, 0, 0), (99, 1, 1)], "doc_id long, toxic int, quality int")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_documents(d, toxicity.train(d, odd_labels(s))),
    "packing": lambda s, d: packing.digest(packing.pack_documents(d)),
    "passages": lambda s, d: passage_dedup.find_passages(d),
    "rules": lambda s, d: quality_rules.judge(d),
    "sites": lambda s, d: site_quality.score_sites(d, odd_labels(s)),
    "lines": lambda s, d: line_dedup.drop_boilerplate(d),
    "suffixes": lambda s, d: suffix_dedup.digest(suffix_dedup.remove_repeats(d)),
    "simhash": lambda s, d: simhash.label_documents(d),
    "near": lambda s, d: simhash.drop_near_duplicates(d),
    "leaks": lambda s, d: decontaminate.drop_contaminated(d, s.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6")], "item_id long, text string")),
}
PER_DOCUMENT = {"toxicity", "rules", "sites", "lines", "suffixes", "simhash"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark, odd_documents(spark)).collect()
    if name in PER_DOCUMENT:
        assert len(rows) == 11
    if name == "packing":
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    if name == "near":  # the copies of 4 and of the empty texts go, and the longer of two alike; rows without an id stay
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8] or sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 8]
        assert sum(r["doc_id"] is None for r in rows) == 2
    if name == "leaks":
        assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 8}
    if name == "passages":
        assert {r["doc_id"] for r in rows} == {7}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, odd_documents(spark, empty=True)).count() == 0


@needs_tables
def test_toxicity_held_out(spark):
    """In every language, though their toxic words are inflected and many forms are new."""
    d = documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score_documents(d, toxicity.train(d, labels)).join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["lang"], r["toxic"]), []).append(r["predicted"])
    for lang in ("en", "de", "es", "fr"):
        assert np.mean(by[lang, 1]) > 0.6 and np.mean(by[lang, 0]) < 0.05, lang
    assert np.mean([x for (_, c), v in by.items() if c for x in v]) > 0.88


class PlainKneserNey:
    """The two class models by recursion over dictionaries."""

    def __init__(self, words, order, discount, strength):
        self.order, self.d, self.strength = order, discount, strength
        self.own = [Counter(), Counter()]
        for word, classes in words.items():
            s = toxicity.START + word + toxicity.END
            for i in range(1, len(s)):
                for c in (0, 1):
                    self.own[c][s[max(0, i - order + 1) : i + 1]] += classes[c]
        self.own = [+c for c in self.own]
        self.left = Counter()
        strings = set(self.own[0]) | set(self.own[1])
        for k in range(order, 1, -1):
            longer = {g for g in strings if len(g) == k}
            self.left.update(g[1:] for g in longer)
            strings |= {g[1:] for g in longer}

    def continuation(self, context, c):
        followers = {g: n for g, n in self.left.items() if g[:-1] == context}
        if not context:
            return (followers[c] + 0.5) / (sum(followers.values()) + 0.5 * len(followers))
        return (max(followers.get(context + c, 0) - self.d, 0) + self.d * len(followers) * self.continuation(context[1:], c)) / sum(followers.values())

    def probability(self, k, context, c):
        both = self.own[0] + self.own[1]
        followers = {g: n for g, n in both.items() if g[:-1] == context}
        q = (max(followers[context + c] - self.d, 0) + self.d * len(followers) * self.continuation(context[1:], c)) / sum(followers.values())
        own = {g: n for g, n in self.own[k].items() if g[:-1] == context}
        return (max(own.get(context + c, 0) - self.d, 0) + (self.d * len(own) + self.strength) * q) / (sum(own.values()) + self.strength)

    def difference(self, word):
        s, out = toxicity.START + word + toxicity.END, 0.0
        for i in range(1, len(s)):
            context = s[max(0, i - self.order + 1) : i]
            out += np.log(self.probability(1, context, s[i]) / self.probability(0, context, s[i]))
        return out


def test_toxicity_is_kneser_ney(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 10))) for _ in range(8)] + (["vile" + str(rng.choice(["", "a", "bc"]))] if i % 3 == 0 else [])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic"))
    counted = {}
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 >= 2:
            for w in set(text.split()):
                counted.setdefault(w, [0, 0])[int(i % 3 == 0)] += 1
    plain = PlainKneserNey(counted, toxicity.ORDER, toxicity.DISCOUNT, toxicity.STRENGTH)
    some = [*sorted(counted)[::60], "vile", "vilebc"]
    assert np.allclose(model.word_differences(some), [plain.difference(w) for w in some], atol=1e-4)


def test_toxicity_lowers_the_order_that_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 300)
    rows = [(i, f"a{chr(97 + i % 26)}q{chr(97 + i % 23)} {'vile' if i % 2 else 'kind'} c{chr(97 + i % 25)}xyz") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic"))
    assert 2 <= model.order < toxicity.ORDER and model.score("vile") > 0.5 > model.score("kind")


def test_toxicity_keeps_its_order_at_any_size(spark, monkeypatch):
    rows = [(i, f"a{chr(97 + i % 26)}q{chr(97 + i % 23)} {'vile' if i % 2 else 'kind'} c{chr(97 + i % 25)}xyz") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    a = toxicity.train(docs, labels)
    monkeypatch.setattr(type(docs), "count", lambda self: 1 << 40)  # as if there were as many labels and grams
    b = toxicity.train(docs, labels)
    assert a.order == b.order == toxicity.ORDER and a.keys.tolist() == b.keys.tolist()


def test_toxicity_joins_labels_either_way(spark, monkeypatch):
    rows = [(i, f"a{chr(97 + i % 26)} {'vile' if i % 2 else 'kind'} c{chr(97 + i % 25)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    a = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    b = toxicity.train(docs, labels)
    assert a.keys.tolist() == b.keys.tolist() and a.lean.tolist() == b.lean.tolist() and np.isclose(a.offset, b.offset)


def test_toxicity_does_not_read_other_columns(spark):
    rows = [(i, f"a{chr(97 + i % 26)} b{chr(97 + i % 23)} {'vile' if i % 2 else 'kind'} c{chr(97 + i % 25)}", "x", "y") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(d, labels)
    assert model.score("aa vile cb") > 0.5 > model.score("aa kind cb")


@given(st.lists(st.integers(1, 5000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing_is_whole_and_without_padding(lengths):
    pieces, sizes = packing.assign(lengths)
    assert sum(sizes) == sum(lengths)
    by_doc, by_sequence = {}, {}
    for d, start, n, q, offset in pieces:
        by_doc.setdefault(d, []).append((start, n))
        by_sequence.setdefault(q, []).append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc[d]):
            assert start == at and k > 0
            at += k
        assert at == n
    for q, parts in by_sequence.items():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at == sizes[q] and (at == packing.CAPACITY or at & (at - 1) == 0)


def test_packing_balances_cost():
    pieces, sizes = packing.assign([1024] * 4 + [512] * 8 + [64] * 64)
    costs = Counter()
    for _, _, n, q, _ in pieces:
        costs[q] += packing.cost(n)
    assert len(sizes) == 6 and max(costs.values()) < 2 * min(costs.values())


ODD_TEXT = st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " " * 70, "\n" * 9, "\u00a0\u2003", "e\u0301", "\u200d\U0001f469", "'ll", "don't 12345"])), max_size=8).map("".join)


@given(ODD_TEXT)
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    """Of the contract's own call, which the module's loader has no part in."""
    assert packing._encoder(None)(text).tolist() == contract_tokenizer().encode(text, add_special_tokens=False).ids


@cache
def contract_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("size", [packing.LONG_TEXT - 20, packing.LONG_TEXT + 20])
def test_ids_of_long_texts(size):
    text = ("Some words, 12 of them; <|endoftext|> é😀 \n\t " * (size // 40 + 1))[:size]
    assert packing._encoder(None)(text).tolist() == contract_tokenizer().encode(text, add_special_tokens=False).ids


@needs_tables
def test_packing_keeps_the_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(documents(spark, SMALL)).orderBy("doc_id", "start").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in documents(spark, SMALL).collect()}


@needs_tables
def test_rules_and_lines_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name in ("op4_quality_rules", "op6_line_dedup"):
        df = entry.queries()[name](spark, SF)
        sql = con.sql(entry.oracle_sql()[name])
        assert sorted(map(repr, (tuple(r[c] for c in sql.columns) for r in df.collect()))) == sorted(map(repr, sql.fetchall()))


@needs_tables
def test_rules_keep_good_documents(spark):
    rows = quality_rules.judge(documents(spark)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1) and not any(r["kept"] for r in rows if r["quality"] == 0)


@needs_tables
def test_site_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = site_quality.score_sites(documents(spark), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 < r["path_posterior"] < 1 for r in rows)


def test_sparse_sites_shrink(spark):
    docs = spark.createDataFrame([(i, "good words here", "en", "big" if i < 400 else "tiny") for i in range(401)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(400, 0)], "doc_id long, quality int")
    by = {r["doc_id"]: r for r in site_quality.score_sites(docs, labels).collect()}
    assert 0.6 < by[400]["host_posterior"] < by[0]["host_posterior"] + 0.01


def test_boilerplate_needs_pages(spark):
    rows = [(i, f"menu home about\nown line {i} of the page\n\nfooter {i % 40}", "h") for i in range(60)] + [(100, "lone page", "g"), (101, "copied page", "c")] + [(200 + i, "copied page", "c") for i in range(50)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(pages, copies_once=True).collect()}
    assert out[7] == "own line 7 of the page\n\nfooter 7" and out[100] == "lone page" and out[101] == "copied page"
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(pages).collect()}
    assert out[7] == "own line 7 of the page\n\nfooter 7" and out[100] == "lone page" and out[101] == ""


def test_salted_lines_equal_broadcast_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"menu\nline {i}", f"h{i % 2}") for i in range(80)], "doc_id long, text string, source string")
    a = sorted(map(tuple, line_dedup.drop_boilerplate(rows).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert a == sorted(map(tuple, line_dedup.drop_boilerplate(rows).collect())) and all(t.startswith("line") for _, t, _ in a)


@needs_tables
def test_suffix_dedup_brute_force(spark):
    extra = [(5, "é" * 60 + "a" * 200), (None, "a" * 300), (None, "a" * 300), (7, None), (8, ""), (9, "ab" * 300), (9, "ab" * 300), (11, "xab" * 3 + "ab" * 100)]
    d = documents(spark, SMALL).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    x = [(10**18 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in d.collect()]
    first: dict = {}
    for i, b in x:
        for p in range(len(b) - 49):
            k = b[p : p + 50]
            first[k] = min(first.get(k, i), i)
    want = []
    for i, b in x:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    got = [(10**18 if r[0] is None else r[0], *r[1:]) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(d)).collect()]
    assert sorted(want) == sorted(got)


@pytest.mark.parametrize("bits", [64, 6])
def test_levels_hold_what_was_added(bits):
    """Different strings stay apart, also where they have one hash."""
    rng, seen = np.random.default_rng(1), set()
    text = rng.integers(97, 100, 4000).astype("u1").tobytes() + bytes(80)
    levels = suffix_dedup.Levels(text, 8)
    for _ in range(60):
        own = {text[p : p + 8]: p for p in rng.integers(0, 3990, 100).tolist()}
        places = np.array(list(own.values()))
        keys = np.array([xxhash.xxh64_intdigest(x, 1) >> (64 - bits) for x in own], np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        held = levels.holds(keys, places)
        assert held.tolist() == [text[p : p + 8] in seen for p in places]
        levels.add(keys[~held], places[~held])
        seen.update(own)
        sizes = [len(x) for x, _ in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_scan_compares_bytes():
    """A hash of eight values finds what one of 64 bits finds."""
    rng, rows = np.random.default_rng(2), []
    for chunk in range(12):
        texts = [rng.integers(97, 99, 40).astype("u1").tobytes() * 2 for _ in range(5)]
        meta = np.array([[k, chunk * 9 + k, 0, 31] for k in range(5)]).T.astype("<i4").tobytes()
        rows.append((chunk, meta, b"".join(t if k else b"ab" * 40 for k, t in enumerate(texts))))
    frame = pd.DataFrame(rows, columns=["chunk", "meta", "content"])
    weak = lambda buffer, n, length: suffix_dedup._hash(buffer, n, length) & np.uint64(7)
    plain, tied = (suffix_dedup._scan(50, f)((0, 0), frame) for f in (suffix_dedup._hash, weak))
    assert len(plain) == 11 and plain.equals(tied)


def reference_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@needs_tables
def test_simhash_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark, SMALL).collect())
    prints = [reference_fingerprint(t) for _, t in rows]
    label = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.label_documents(documents(spark, SMALL)).collect()}
    assert got == {d: (p, rows[k][0]) for (d, _), p, k in zip(rows, prints, label)}


@pytest.mark.parametrize("group", [64, 16_384])
def test_links_lose_none(spark, monkeypatch, group):
    """Clusters around correlated bits, with groups small enough to be split as well."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    prints = []
    for b in base:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            prints.append(int(b) ^ sum(1 << int(f) for f in flips))
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long")
    found = {r["node"]: r["label"] for r in components(simhash.links(rows, 4)).collect()}
    want = union(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert [found.get(i, i) for i in range(len(prints))] == want


def test_plan_covers_the_radius():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    for radius in (0, 3, 4, 8):
        parts = simhash.plan(sample, 100_000, radius)
        assert sum(t + 1 for _, t in parts) == radius + 1 and len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {(r["node"], r["label"]) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def word_text(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n)]


def test_near_duplicates_with_added_blocks(spark):
    """Pairs at similarities just over 0.8 by a block of words added at one end, and by words changed all over; and texts of the same words that are not alike."""
    rng = np.random.default_rng(6)
    rows, want = [], 0
    for k in range(300):
        words = word_text(rng, 60 + k)
        if k % 3 == 0:
            other = words + word_text(rng, int(0.2 * len(words)))
        elif k % 3 == 1:
            other = list(words)
            for at in range(5, len(words), 60):
                other[at] = "changed"
        else:
            other = list(rng.permutation(words))
        want += k % 3 < 2
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(300)} <= left and {2 * k + 1 for k in range(2, 300, 3)} <= left
    assert 600 - len(left) >= 0.9 * want


@pytest.mark.parametrize("bucket", [None, 40])
def test_candidates_are_all_pairs_or_each_ones_nearest(spark, monkeypatch, bucket):
    """Whatever the plan: also where buckets are split into blocks."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    near = np.concatenate([base[:20] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 12), 20)).astype(np.uint64), axis=0) for _ in range(12)])
    fps = np.unique(np.concatenate([base, near]))
    ids, sketches = rng.permutation(len(fps)) * 7, rng.integers(0, 1 << 8, len(fps))
    rows = spark.createDataFrame([(int(i), int(f), int(s), 10) for i, f, s in zip(ids, fps.view(np.int64), sketches)], "id long, fp long, sketch long, size int")
    if bucket:
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "WORK", 200)
    want = {}
    for i in range(len(fps)):
        for j in range(len(fps)):
            if ids[i] < ids[j] and int(fps[i] ^ fps[j]).bit_count() <= 12:
                want[int(ids[i]), int(ids[j])] = int(sketches[i] ^ sketches[j]).bit_count()
    assert len(want) > 500
    got = simhash.candidates(rows, 12, 0.8, True).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["apart"] for r in got} == want
    some = {(r["a"], r["b"]): r["apart"] for r in simhash.candidates(rows, 12, 0.8, False).collect()}
    for k in range(2):
        for x in {p[k] for p in want}:
            best = min((n, p) for p, n in want.items() if p[k] == x)
            assert min((n, p) for p, n in some.items() if p[k] == x) == best and some.items() <= want.items()


def test_a_link_is_found_behind_nearer_candidates(spark):
    """A text with a link of similarity 0.804 among thirty candidates of 0.796, which are as near by their sketches."""
    rng = np.random.default_rng(8)
    rows, wanted = [], []
    for c in range(12):
        words = [f"c{c}w{k}" for k in range(400)]
        changed = lambda v, at, m: words[:at] + [f"c{c}v{v}n{k}" for k in range(m)] + words[at + m :]  # noqa: E731, B023
        rows += [(100 * c, " ".join(words)), (100 * c + 1, " ".join(changed(0, 180, 39)))]
        rows += [(100 * c + 1 + v, " ".join(changed(v, int(rng.integers(5, 350)), 41))) for v in range(1, 31)]
        prints = [simhash.fingerprint_words([w.encode() for w in t.split()], 1) for _, t in rows[-32:-30]]
        if (prints[0] ^ prints[1]).bit_count() <= simhash.WORD_RADIUS:
            wanted.append(100 * c + 1)
    assert len(wanted) >= 6
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not left & set(wanted) and {100 * c for c in range(12)} <= left


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for words in (simhash.SHORT, simhash.LONG):
        apart = []
        for _ in range(200):
            x = rng.integers(0, 1 << 62, 450).astype(np.uint64)
            apart.append(int(np.bitwise_count(simhash.sketch(x[:400], words) ^ simhash.sketch(x[50:], words)).sum()))  # similarity 350 / 450
        share = (1 - 350 / 450) / 2
        assert abs(np.mean(apart) - 64 * words * share) < 0.05 * 64 * words * share and max(apart) <= simhash.furthest(350 / 450, 64 * words)


def test_copies_of_a_large_group(spark):
    """Five hundred copies of one text, each with words of its own changed: few are alike among themselves, all are like the text. And as many that are alike to none."""
    rng = np.random.default_rng(9)
    one, two = word_text(rng, 400), word_text(rng, 400)
    rows = [(0, " ".join(one)), (1, " ".join(two))]
    for k in range(2, 1002):
        text, every = (one, 50) if k % 2 else (two, 12)
        copy = list(text)
        for at in range(int(rng.integers(every)), 400, every):
            copy[at] = f"own{k}x{at}"
        rows.append((k, " ".join(copy)))
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(left & set(range(3, 1002, 2))) <= 25 and {0, 1} | set(range(2, 1002, 2)) <= left


@needs_tables
def test_near_duplicates_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    holders: dict = {}
    links = []
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in holders.get(x, ())).items():
            if k >= 0.8 * (len(s) + len(sets[j]) - k):
                links.append((i, j))
        for x in s:
            holders.setdefault(x, []).append(i)
    label = union(len(rows), links)
    want = {rows[i][0] for i in range(len(rows)) if label[i] == i}
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark)).collect()}
    assert len(got ^ want) <= 0.02 * (len(rows) - len(want)) + 1


@needs_tables
def test_passages_catch_repeats(spark):
    words = {r["doc_id"]: r["text"].lower().split() for r in documents(spark).collect()}
    first, need, shared = {}, set(), set()
    for d in sorted(words):
        w = words[d]
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), d) < d:
                need.add(d)
    for r in passage_dedup.find_passages(documents(spark)).collect():
        shared.add(r["doc_id"])
        assert r["source_doc_id"] < r["doc_id"] and r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 40
        a, b = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["source_doc_id"]][r["source_start"] : r["source_end"]]
        assert r["identity"] < 1 or a == b
    assert len(need - shared) <= 0.02 * len(need) + 1


def test_fuzzy_passage_and_clean_documents(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    passage = [word() for _ in range(80)]
    edited = list(passage)
    for i in (9, 31, 52, 70):
        edited[i] = word()
    del edited[40]
    text = lambda middle: " ".join([word() for _ in range(60)] + middle + [word() for _ in range(60)])
    rows = spark.createDataFrame([(1, text(passage)), (2, text(edited)), (3, text([]))], "doc_id long, text string")
    found = passage_dedup.find_passages(rows).collect()
    assert [(r["doc_id"], r["source_doc_id"]) for r in found] == [(2, 1)] and 0.9 < found[0]["identity"] < 1 and found[0]["end_word"] - found[0]["start_word"] >= 75


def test_chains_rise_in_both():
    x, y = [0, 5, 10, 15, 20, 60, 65, 70], [50, 55, 3, 60, 65, 0, 5, 10]
    for chain in passage_dedup.chains(x, y):
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))


@needs_tables
def test_decontamination_recall(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    rng = np.random.default_rng(2)
    missed = 0
    for k, (item_id, text) in enumerate(items):
        words = text.split()
        for _ in range(decontaminate.allowed(len(words))):
            words[rng.integers(len(words))] = "changed"
        passage = " ".join(["around"] * 30 + words + ["after"] * 30)
        missed += item_id not in {m[0] for m in index.find(passage)}
        assert index.find(" ".join(f"x{k}y{i}" for i in range(200))) == []
    assert missed <= 1
    rows = documents(spark).collect()
    verbatim = {(r["doc_id"], i) for r in rows for i, t in items if t in r["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert verbatim <= found and len(found) <= 1.3 * len(verbatim)


@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=20))
@settings(max_examples=200, deadline=None)
def test_least_edits_is_exact(item, text):
    if not item:
        return
    row = [0] * (len(text) + 1)
    for i, u in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, v in enumerate(text, 1):
            before, row[j] = row[j], min(before + (u != v), row[j] + 1, row[j - 1] + 1)
    assert decontaminate.least_edits([ord(c) for c in item], [ord(c) for c in text])[0] == min(row)


CONTROL = st.text(alphabet=st.sampled_from(list("\\#</turn>: \nA") + ["é", "😀"]), max_size=30)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), CONTROL), CONTROL), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


@given(st.text(max_size=40), st.lists(st.integers(0, 40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_mask_is_the_spans(text, cuts):
    edges = sorted({min(c, len(text)) for c in cuts})
    spans = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
    starts = list(range(0, len(text), 3))
    offsets = np.array([(a, min(a + 3, len(text))) for a in starts], np.int64).reshape(-1, 2)
    learnt, clipped = chat.mask(offsets, spans)
    assert "".join(text[a:b] for a, b in clipped) == "".join(text[a:b] for a, b in spans)
    assert learnt.tolist() == [any(a < y and x < b for x, y in spans) for a, b in offsets.tolist()]


@needs_tables
def test_chat_digests(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (-8, 0, None, None), (-8, None, "a:s\n###x", "\\\\####</turn>"), (-8, 1, "assistant", "é😀\n\\"), (None, None, None, None)]
    both = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    want = {}
    for r in both.collect():
        want.setdefault(r["conv_id"], []).append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    for r in chat.digest(chat.format_conversations(both)).collect():
        turns = sorted(want.pop(r["conv_id"]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not want
    assert chat.digest(chat.format_conversations(both.limit(0))).count() == 0
