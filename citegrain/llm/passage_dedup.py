"""Passages that documents repeat, exactly or with edits, by collinear chaining of shared seeds.

Seeds are runs of SEED words; of each WINDOW neighbouring ones the one of least hash is taken, so any SEED + WINDOW - 1 equal words share one. A seed
that two documents hold is joined to its first holder (the smallest doc_id that has it as often), one or two links per occurrence and never
all pairs; a repeated passage so meets the first document that has it. The seeds that a document shares with a first holder are chained in order in both by
a sweep with a Fenwick tree over the holder's places: a seed adds its words, a gap costs GAP for each word it spans in either. Chains are extended
and aligned by word edits between their seeds, and split at the gap of most edits while they agree in too little; what has LEAST_WORDS words and
LEAST_IDENTITY is a repeated passage.

A null or empty text has no passage. Rows with a null doc_id are left out of the search (nothing can be named as its source). Rows that repeat a doc_id are
one document, of the longest of its texts (of several, the greatest). Empty tables give no row. Extra columns are not read. Very long texts are searched whole.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import clean_text, partitions, release, settle
from citegrain.llm.suffix_dedup import CHUNK_BYTES, MOST_CHUNKS, _chunk, _pack5, _shared, _short

SEED, WINDOW, GAP = 5, 10, 0.1
LEAST_WORDS, LEAST_IDENTITY, LEAST_SEEDS = 40, 0.8, 3
#: Words of a gap that are aligned exactly; a longer gap counts as edits throughout.
LONGEST_GAP = 200

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _extreme(x: np.ndarray, reach: int, of) -> np.ndarray:
    """of (minimum or maximum) over each `reach` neighbours."""
    span = 1
    while span < reach:
        step = min(span, reach - span)
        x = of(x[: len(x) - step], x[step:])
        span += step
    return x


def word_hashes(text: str, known: dict) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the seeds of a text."""
    n = len(words) - SEED + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SEED):
        h = h * _MULTIPLIER + words[k : k + n]
    h = _mixed(h)
    if n <= WINDOW:
        at = np.array([int(np.argmin(h))])
        return at, h[at]
    least = _extreme(h, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    most = _extreme(np.concatenate([edge, least, edge]), WINDOW, np.maximum)  # the largest least hash among the windows over a place
    at = np.flatnonzero(most == h)
    return at, h[at]


def _seed_sets(shares: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        found = [seeds(word_hashes(t, known))[1] for t in frame["text"]]
        share, rest = _short(np.concatenate(found), shares)
        order = np.lexsort((rest, share))
        share, rest = share[order], rest[order]
        new = np.ones(len(rest), bool)
        new[1:] = (share[1:] != share[:-1]) | (rest[1:] != rest[:-1])
        share, rest = share[new], rest[new]
        edges = np.searchsorted(share, np.arange(shares + 1, dtype=np.uint64))
        rows = [(k, int(frame["chunk"].iloc[0]), _pack5(rest[edges[k] : edges[k + 1]])) for k in range(shares) if edges[k] < edges[k + 1]]
        return pd.DataFrame(rows, columns=["share", "chunk", "anchors"])

    return run


SHARED = "doc_id long, places binary, hashes binary, runs binary, words binary"
#: Words kept on either side of a shared seed: a passage's ends lie within SEED + WINDOW words of its outer seeds.
AROUND = LEAST_WORDS


def in_company(places: np.ndarray) -> np.ndarray:
    """Which shared seeds have enough others near them to be in a chain: a run of seeds at most 2 * AROUND words apart needs LEAST_SEEDS."""
    if not len(places):
        return np.zeros(0, bool)
    run = np.cumsum(np.diff(places, prepend=places[0]) > 2 * AROUND)
    return np.bincount(run)[run] >= LEAST_SEEDS


def keep_around(words: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes]:
    """The words near shared seeds, as runs (start, length) and the runs' words one after another."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] - places[:-1] > 2 * AROUND + SEED
    first = np.flatnonzero(new)
    starts = np.maximum(places[first] - AROUND, 0)
    stops = np.minimum(places[np.append(first[1:], len(places)) - 1] + SEED + AROUND, len(words))
    kept = np.concatenate([words[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
    return np.stack([starts, stops - starts]).astype("<i4").tobytes(), (kept & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def laid_out(runs: bytes, words: bytes, missing: int) -> np.ndarray:
    """The words at their places; `missing` stands for those that were not kept."""
    starts, sizes = np.frombuffer(runs, "<i4").reshape(2, -1).astype(np.int64)
    out = np.full(int(starts[-1] + sizes[-1]), missing, np.uint32)
    out[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.frombuffer(words, "<u4")
    return out


def _shared_seeds(shares: int):
    """Each document that shares seeds with another: its shared seeds' places and hashes, and the 32-bit hashes of the words around them."""

    def run(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "places", "hashes", "runs", "words"]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        frame = frame.assign(n=frame["text"].str.len()).sort_values(["doc_id", "n", "text"], kind="stable").drop_duplicates("doc_id", keep="last")
        known: dict = {}
        words = [word_hashes(t, known) for t in frame["text"]]
        found = [seeds(w) for w in words]
        hashes = np.concatenate([h for _, h in found])
        if not len(hashes):
            return pd.DataFrame(columns=columns)
        owner = np.repeat(np.arange(len(found)), [len(h) for _, h in found])
        share, rest = _short(hashes, shares)
        order = np.lexsort((owner, rest, share))
        s, r, d = share[order], rest[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        wanted = d[np.append(first[1:], len(order)) - 1] != d[first]
        edges = np.searchsorted(s[first], np.arange(shares + 1, dtype=np.uint64))
        for k, bits in zip(replies["share"], replies["bits"]):
            a, b = edges[k], edges[k + 1]
            wanted[a:b] |= np.unpackbits(np.frombuffer(bits, "u1"))[: b - a].astype(bool)
        shared = np.zeros(len(hashes), bool)
        shared[order] = wanted[np.cumsum(new) - 1]
        rows, at = [], 0
        for k, (places, own) in enumerate(found):
            hit = shared[at : at + len(own)].copy()
            at += len(own)
            hit[hit] = in_company(places[hit])
            if hit.any():
                rows.append((int(frame["doc_id"].iloc[k]), places[hit].astype("<i4").tobytes(), own[hit].astype("<u8").tobytes(), *keep_around(words[k], places[hit])))
        return pd.DataFrame(rows, columns=columns)

    return run


OCCURRENCE = "seed long, asks boolean, doc_id long, place int"


def _occurrences(batches):
    """A row for each seed of a document, whose key is the seed and how often the document had it before; one that came before also asks for holders
    of it at all."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = batch["places"].str.len().to_numpy(np.int64) // 4
        owner = np.repeat(np.arange(len(batch)), sizes)
        places = np.frombuffer(b"".join(batch["places"]), "<i4")
        hashes = np.frombuffer(b"".join(batch["hashes"]), "<u8")
        order = np.lexsort((places, hashes, owner))
        h, p, o = hashes[order], places[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        at = np.arange(len(h))
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        again = nth > 0
        key = _mixed(h + nth * _MULTIPLIER)
        doc = batch["doc_id"].to_numpy(np.int64)[o]
        yield pd.DataFrame({
            "seed": np.concatenate([key, _mixed(h[again])]).view(np.int64), "asks": np.repeat([False, True], [len(h), int(again.sum())]),
            "doc_id": np.concatenate([doc, doc[again]]), "place": np.concatenate([p, p[again]]),
        })


class Fenwick:
    """The greatest (value, item) among places up to one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e300, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """Over places 0 to at - 1."""
        found = (-1e300, -1)
        while at > 0:
            found = max(found, self.best[at])
            at -= at & -at
        return found


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Disjoint chains of matches (x[i], y[i]), rising in both, the best first. Each is a list of matches in order."""
    left, out = sorted(range(len(x)), key=lambda i: (x[i], -y[i])), []
    while len(left) >= LEAST_SEEDS:
        ranks = {v: k for k, v in enumerate(sorted({y[i] for i in left}))}
        tree, score, back = Fenwick(len(ranks)), {}, {}
        for i in left:  # a later match with the same x has a smaller y, so it never follows one
            value, j = tree.upto(ranks[y[i]])
            gain = value - GAP * (x[i] + y[i]) if j >= 0 else 0.0
            score[i], back[i] = SEED + max(0.0, gain), j if j >= 0 and gain > 0 else -1
            tree.put(ranks[y[i]], (score[i] + GAP * (x[i] + y[i]), i))
        at = max(left, key=lambda i: (score[i], -x[i]))
        chain = []
        while at >= 0:
            chain.append(at)
            at = back[at]
        if len(chain) < LEAST_SEEDS:
            break
        chain.reverse()
        out.append(chain)
        # A gap that a passage fits in is not the chain's: what lies there can be in another chain.
        at = [x[i] for i in chain]
        new = [k for k in range(1, len(at)) if at[k] - at[k - 1] >= LEAST_WORDS]
        starts, stops = [at[k] for k in [0, *new]], [at[k - 1] for k in [*new, len(at)]]
        left = [i for i in left if (k := bisect_right(starts, x[i]) - 1) < 0 or x[i] > stops[k]]
    return out


CHAINED = "doc_id long, source_id long, xs array<int>, ys array<int>, words binary, at int"


def _chain(batches):
    for batch in batches:
        rows = []
        for doc_id, matches, runs, words in zip(batch["doc_id"], batch["matches"], batch["runs"], batch["words"]):
            whole = laid_out(runs, words, 0)
            by_source: dict[int, list[tuple[int, int]]] = {}
            for m in matches:
                by_source.setdefault(m["source_id"], []).append((m["place"], m["source_place"]))
            for source, pairs in by_source.items():
                x, y = [a for a, _ in pairs], [b for _, b in pairs]
                for chain in chains(x, y):
                    a, b = max(0, x[chain[0]] - AROUND), x[chain[-1]] + SEED + AROUND  # with room to extend
                    rows.append((doc_id, source, [x[i] for i in chain], [y[i] for i in chain], whole[a:b].tobytes(), a))
        yield pd.DataFrame(rows, columns=["doc_id", "source_id", "xs", "ys", "words", "at"])


def edits(a: list[int], b: list[int]) -> int:
    """Least word edits between two runs."""
    if not a or not b:
        return max(len(a), len(b))
    if max(len(a), len(b)) > LONGEST_GAP:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            before, row[j] = row[j], min(before + (u != v), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _grow(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words that equal beginnings can be extended by, over single changed words that three equal ones follow; and the changed ones."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    at = changed = 0
    while at < n:
        if same[at]:
            at += 1
        elif at + 3 < n and same[at + 1 : at + 4].all():
            at, changed = at + 1, changed + 1
        else:
            break
    return at, changed


def _pieces(mine: np.ndarray, theirs: np.ndarray, xs: list[int], ys: list[int]):
    """(start, end, source start, source end, identity) of the passages in a chain. A chain that agrees in too few words is split at its gap of
    most edits, and either side is judged alone."""
    wrong = [0]  # edits before each seed
    for (u0, v0), (u, v) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        x, y = u0 + SEED, v0 + SEED
        if u < x or v < y:  # seeds that overlap: the longer step is made of edits
            wrong.append(abs((u - x) - (v - y)))
        else:
            wrong.append(edits(mine[x:u].tolist(), theirs[y:v].tolist()))
    todo = [(0, len(xs))]
    while todo:
        i, j = todo.pop()
        x, y = xs[j - 1] + SEED, ys[j - 1] + SEED
        before, there = (0, 0) if i == 0 else (min(xs[i], xs[i - 1] + SEED), min(ys[i], ys[i - 1] + SEED))
        after, beyond = (len(mine), len(theirs)) if j == len(xs) else (max(x, xs[j]), max(y, ys[j]))
        more, changed = _grow(mine[x:after], theirs[y:beyond])
        less, changed_before = _grow(mine[before : xs[i]][::-1], theirs[there : ys[i]][::-1])
        start, end, first, until = xs[i] - less, x + more, ys[i] - less, y + more
        identity = 0.0
        if min(end - start, until - first) >= LEAST_WORDS:
            identity = 1 - (sum(wrong[i + 1 : j]) + changed + changed_before) / max(end - start, until - first)
        if identity >= LEAST_IDENTITY:
            yield start, end, first, until, identity
        elif j - i > 1:
            k = max(range(i + 1, j), key=wrong.__getitem__)
            todo += [(k, j), (i, k)]


PASSAGE = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int, identity double"


def _align(batches):
    for batch in batches:
        rows = []
        for doc_id, source, xs, ys, words, at, theirs in zip(batch["doc_id"], batch["source_id"], batch["xs"], batch["ys"], batch["words"], batch["at"], batch["source"]):
            mine, theirs = np.frombuffer(words, "<u4"), laid_out(theirs["runs"], theirs["words"], 1)
            for start, end, there, until, identity in _pieces(mine, theirs, [int(v) - at for v in xs], [int(v) for v in ys]):
                rows.append((doc_id, start + at, end + at, source, there, until, identity))
        yield pd.DataFrame(rows, columns=["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "identity"])


def find_passages(documents: DataFrame) -> DataFrame:
    """Each passage of a document that an earlier one has: its words, the source's words, and the share of words that agree."""
    ways = partitions(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(min(MOST_CHUNKS, max(2 * ways, size // CHUNK_BYTES)))
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / chunks for k in range(1, chunks)], 0.2 / chunks)}) if size else []
    by_chunk = rows.withColumn("chunk", _chunk(bounds)(F.col("doc_id"))).repartition(ways, "chunk").groupBy("chunk")
    shared = by_chunk.applyInPandas(_seed_sets(ways), "share int, chunk int, anchors binary").groupBy("share").applyInPandas(_shared, "chunk int, share int, bits binary")
    holders = by_chunk.cogroup(shared.groupBy("chunk")).applyInPandas(_shared_seeds(ways), SHARED)
    holders = settle(holders)
    release(documents.sparkSession)
    seen = holders.select("doc_id", "places", "hashes").mapInPandas(_occurrences, OCCURRENCE)
    firsts = seen.where("not asks").groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("high")).where("first.doc_id < high")
    # Joined by a hash of the seed: the sums are dealt by the seed itself, so both sides are dealt anew and a hot seed's occurrences can be split.
    firsts = firsts.select(F.xxhash64("seed").alias("key"), F.col("first.doc_id").alias("source_id"), F.col("first.place").alias("source_place"))
    matched = seen.select(F.xxhash64("seed").alias("key"), "doc_id", "place").join(firsts, "key").where("doc_id != source_id")
    # A pair of documents needs a few seeds; a document's matches are at most its own seeds.
    by_doc = matched.groupBy("doc_id").agg(F.collect_list(F.struct("source_id", "place", "source_place")).alias("matches"))
    chained = by_doc.join(holders.select("doc_id", "runs", "words"), "doc_id").mapInPandas(_chain, CHAINED)
    sources = holders.select(F.col("doc_id").alias("source_id"), F.struct("runs", "words").alias("source"))
    return chained.join(sources, "source_id").select("doc_id", "source_id", "xs", "ys", "words", "at", "source").mapInPandas(_align, PASSAGE)
