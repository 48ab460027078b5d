"""Benchmark decontamination: passages within an edit distance of a benchmark item, over words.

Item-sized windows of a document are embedded by CGK random walks (a walk repeats or advances by a random bit for each step and word), which turn
edit distance into Hamming distance; each repetition samples a few positions of its own walk as a hash key. A window whose key equals an
item's in any repetition is verified exactly: the least number of word edits between the item and any passage around the window. The number of
repetitions is set by measuring, on items edited at random as far as the threshold allows, how many are needed for TARGET_RECALL.

Only windows that can match are embedded: k edits spoil at most 3 k of the n - 2 three-word blocks of an item and move the rest by at most k, so windows
are laid where a document's three words are an item's and enough of its other blocks are near. This loses nothing.

A null or empty text has no match. An item of fewer than LEAST_WORDS words is not searched for. Items of the same words each match. Nulls among items
are left out. Repeated documents are judged each; empty tables give no match; extra columns are not read (kept by drop_contaminated).
Very long texts are searched whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, GRAM, EDIT_SHARE = 5, 3, 0.2
#: Words sampled for a key, most repetitions, the recall of the sampling that they are chosen for, and items that it is measured on.
SAMPLED, MOST_REPEATS, TARGET_RECALL, CALIBRATION = 2, 64, 0.995, 12
#: Item bytes that are sent to executors at once; larger benchmarks are searched in blocks, one pass over the documents for each.
BLOCK_BYTES = 8_000_000
SEED = 7


def allowed(n: int) -> int:
    """Edits that an item of n words may have: a fifth of its words, and few enough to leave a block of three."""
    return max(0, min(int(EDIT_SHARE * n), n // GRAM - 1))


def split_words(text: str | bytes) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()


def embed(rows: np.ndarray, repeat: int) -> np.ndarray:
    """The sampled words of each row's CGK walk. rows: word ids, all of one length; a walk takes three steps for each word."""
    n, width = rows.shape
    rng = np.random.default_rng([SEED, repeat, width])
    salt = rng.integers(1, 1 << 62, size=3 * width, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    steps = np.sort(rng.choice(2 * width, SAMPLED, replace=False))
    at, key = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    lines = np.arange(n)
    for j in range(steps[-1] + 1):
        word = np.where(at < width, rows[lines, np.minimum(at, width - 1)], -1).astype(np.uint64)
        mixed = (word + np.uint64(0x9E3779B97F4A7C15)) * salt[j]
        if j in steps:
            key = key * np.uint64(0x100000001B3) + word + np.uint64(1)
        at += ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return key


def least_edits(item: list[int], passage: list[int]) -> tuple[int, int]:
    """The least number of word edits between the item and any part of the passage, and where the first best part ends."""
    m = len(item)
    match: dict[int, int] = {}
    for i, w in enumerate(item):
        match[w] = match.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(passage):  # bit-parallel columns of the edit table, free to start anywhere
        eq = match.get(w, 0)
        x = eq | minus
        diagonal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1, down << 1
        plus = (down | ~(x | up)) & full
        minus = up & x
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The items of a block, by words, three-word blocks and keys."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in sorted(items):
            words = split_words(text)
            if len(words) >= LEAST_WORDS:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        self.base = len(self.vocabulary) + 1
        grams, owner, place = [], [], []
        for k, (_, ids) in enumerate(self.items):
            for q in range(len(ids) - GRAM + 1):
                grams.append((ids[q] * self.base + ids[q + 1]) * self.base + ids[q + 2])
                owner.append(k)
                place.append(q)
        order = np.argsort(np.array(grams, np.int64), kind="stable")
        self.grams, self.owner, self.place = (np.array(x, np.int64)[order] for x in (grams, owner, place))
        self.sizes = np.array([len(x) for _, x in self.items], np.int64)
        self.most = np.array([allowed(n) for n in self.sizes.tolist()], np.int64)
        self.repeats = self._repeats()
        self.keys = {}
        for width in sorted(set(self.sizes.tolist())):
            own = np.flatnonzero(self.sizes == width)
            rows = np.array([self.items[k][1] for k in own], np.int64)
            for r in range(self.repeats):
                key = embed(rows, r)
                order = np.argsort(key, kind="stable")
                self.keys[width, r] = (key[order], own[order])

    def _repeats(self) -> int:
        """How many repetitions a match as far off as allowed needs, measured on CALIBRATION items of all lengths, edited at random."""
        rng = np.random.default_rng(SEED)
        met = np.zeros((0, MOST_REPEATS), bool)
        by_size = sorted((ids for _, ids in self.items), key=len)
        for ids in by_size[:: max(1, len(by_size) // CALIBRATION)][:CALIBRATION]:
            copies = [ids]
            for _ in range(10):
                edited = list(ids)
                for _ in range(allowed(len(ids))):
                    kind, at = rng.integers(3), int(rng.integers(max(1, len(edited))))
                    if kind == 0:
                        edited.insert(at, 0)
                    elif kind == 1 and len(edited) > 1:
                        del edited[at]
                    else:
                        edited[min(at, len(edited) - 1)] = 0
                copies.append((edited + [0] * len(ids))[: len(ids)])
            keys = np.stack([embed(np.array(copies, np.int64), r) for r in range(MOST_REPEATS)], axis=1)
            met = np.concatenate([met, keys[1:] == keys[0]])
        if not len(met):
            return 1
        enough = np.flatnonzero(np.maximum.accumulate(met, axis=1).mean(0) >= TARGET_RECALL)
        return int(enough[0]) + 1 if len(enough) else MOST_REPEATS

    def windows(self, text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's word ids, and its windows that may match as columns (words, start)."""
        words = split_words(text or b"")
        none = np.zeros((2, 0), np.int64)
        if len(words) < GRAM or not self.items:
            return none[0], none
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        known = ids > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        if not len(at):
            return ids, none
        gram = (ids[at] * self.base + ids[at + 1]) * self.base + ids[at + 2]
        left, right = np.searchsorted(self.grams, gram, "left"), np.searchsorted(self.grams, gram, "right")
        count = right - left
        if not count.any():
            return ids, none
        which = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(at, count) - self.place[which]
        # Each of k edits spoils three blocks at most and moves the others by one at most, so a match has this many near its start.
        owner = self.owner[which]
        spread = (owner + 1) * (4 * (len(ids) + int(self.sizes.max()))) + start
        order = np.argsort(spread, kind="stable")
        spread, owner, start = spread[order], owner[order], start[order]
        near = np.searchsorted(spread, spread + self.most[owner], "right") - np.searchsorted(spread, spread - self.most[owner], "left")
        enough = near >= self.sizes[owner] - GRAM + 1 - GRAM * self.most[owner]
        return ids, np.unique(np.stack([self.sizes[owner[enough]], start[enough]]), axis=1)

    def find_all(self, texts) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, first word, word after the last, edits) of each item's best passage in each text. The windows of all texts are embedded together."""
        by_text, by_size = {}, {}
        found: list[list[tuple[int, int, int, int]]] = []
        for n, text in enumerate(texts):
            found.append([])
            ids, windows = self.windows(text)
            if windows.shape[1]:
                by_text[n] = ids
                for size in np.unique(windows[0]).tolist():
                    by_size.setdefault(size, []).append((n, windows[1][windows[0] == size]))
        candidates = set()
        for size, parts in by_size.items():
            text_of = np.concatenate([np.full(len(starts), n, np.int64) for n, starts in parts])
            start_of = np.concatenate([starts for _, starts in parts])
            rows = np.concatenate([np.concatenate([np.zeros(size, np.int64), by_text[n], np.zeros(2 * size, np.int64)])[np.clip(starts, -size, len(by_text[n]) + size)[:, None] + size + np.arange(size)] for n, starts in parts])
            for at in range(0, len(rows), 50_000):
                for r in range(self.repeats):
                    key, (keys, owners) = embed(rows[at : at + 50_000], r), self.keys[size, r]
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        candidates.update((int(text_of[at + i]), int(start_of[at + i]), k) for k in owners[lo[i] : hi[i]].tolist())
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for n, start, k in sorted(candidates):
            ids = by_text[n]
            item_id, item = self.items[k]
            most = allowed(len(item))
            a, b = max(0, start - 2 * most), min(len(ids), start + len(item) + 2 * most)
            edits, end = least_edits(item, ids[a:b].tolist())
            if edits <= most and ((n, k) not in best or edits < best[n, k][3]):
                _, back = least_edits(item[::-1], ids[a : a + end][::-1].tolist())
                best[n, k] = (item_id, a + end - back, a + end, edits)
        for (n, _), match in sorted(best.items()):
            found[n].append(match)
        return [sorted(x) for x in found]

    def find(self, text: str | bytes | None) -> list[tuple[int, int, int, int]]:
        return self.find_all([text])[0]


def _blocks(benchmark: DataFrame):
    """The items in blocks of about BLOCK_BYTES, one after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in block.collect()]


FOUND = "array<struct<item_id:long,start_word:int,end_word:int,edits:int>>"


def matches_column(spark, items: list[tuple[int, str]], text: Column) -> Column:
    """The matches of a block's items in a text. The block is indexed once, here; its size is bounded."""
    sent = spark.sparkContext.broadcast(vars(Index(items)))

    @F.pandas_udf(FOUND)
    def matches(texts: pd.Series) -> pd.Series:
        index = Index.__new__(Index)
        vars(index).update(sent.value)
        return pd.Series([[dict(zip(("item_id", "start_word", "end_word", "edits"), x)) for x in one] for one in index.find_all(texts)], dtype=object)

    return matches(text.cast("binary"))  # the words are bytes: nothing is decoded


def find_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits): the best passage of each item in each document that holds one."""
    out = None
    for items in _blocks(benchmark):
        found = documents.select("doc_id", matches_column(documents.sparkSession, items, F.col("text")).alias("found")).select("doc_id", F.inline("found"))
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a match, with the columns they came with."""
    for items in _blocks(benchmark):
        documents = documents.where(F.size(matches_column(documents.sparkSession, items, F.col("text"))) == 0)
    return documents
