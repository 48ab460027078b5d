"""Removal of long strings that an earlier document holds, by a logarithmic family of suffix arrays.

Every byte that is covered by a string of `length` bytes which also starts in a document with a smaller doc_id goes; matches stay within documents and
are judged on the input. Documents are dealt into chunks by doc_id, so that a chunk's documents come before those of the next chunks.

A string's anchor is the least hash among its 16-byte substrings, so equal strings have equal anchors wherever they are, and neighbouring
strings mostly share one; a run of strings with one anchor is a segment.
1. Each chunk sends its different anchors, dealt by anchor; anchors of two chunks are sent back as bits.
2. Segments of anchors that two documents hold are sent, dealt by anchor; of equal segments in a chunk the first document's alone, the
   others are covered.
3. For each share of the anchors, chunks come in order as batches. A batch gets a suffix array: its strings' places in order of a 64-bit hash
   of their `length` bytes (with matches of that length only, any order that puts equal prefixes together does), and those of one hash in order of
   the bytes. It is merge-scanned against the arrays of the existing levels, and with its own earlier documents; then it becomes a level, and levels of
   about equal size merge, so there are about log n levels and a key moves log n times. Levels keep different strings only. Strings are equal if
   their bytes are: a hash only says where to look. The number of shares grows with the text, so that of one share stays bounded.
4. Covered stretches go back to their chunks, are joined and cut out.
A passage in many documents is sent once from each chunk, not once from each document.

A null or empty text has no bytes. A null doc_id is larger than all others, and null ones are equal: neither is before the other, as with repeated
doc_ids. Repeated rows are judged each. Empty tables give no row. Extra columns are not read. A very long text is one piece of its chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import clean_text, partitions

LENGTH, ANCHOR = 50, 16
#: Text bytes in a chunk, about; small tables have a chunk for each shuffle partition.
CHUNK_BYTES = 4_000_000
MOST_CHUNKS = 1 << 16
#: Text bytes for each share of the anchors, about; small tables have a share for each shuffle partition.
SHARE_BYTES = 32_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(buffer: bytes, offset: int, n: int) -> np.ndarray:
    """The eight bytes from each of n places on, as integers."""
    return np.ndarray(n, dtype="<u8", buffer=buffer, offset=offset, strides=(1,))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _hash(buffer: bytes, n: int, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each of n places on; buffer is 64 bytes longer than that."""
    h = np.full(n, length, np.uint64)
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        h ^= _words(buffer, offset, n)
        h *= _A
        h ^= h >> np.uint64(31)
    return _mix(h)


def segments(texts: list[bytes], length: int):
    """Arrays anchor, document, start (in the document), strings and a hash of the content, one entry for each segment; and the joined texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    joined = b"".join(texts) + bytes(length + 64)
    h = _hash(joined, n + length, ANCHOR)
    least, span = h, 1
    reach = length - ANCHOR + 1
    while span < reach:  # the least of the next `reach` hashes, by doubling
        step = min(span, reach - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    least = _mix(least[:n] * _C)
    valid = np.zeros(n + 1, np.int8)
    has = sizes >= length
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, begins[has] + sizes[has] - length + 1, -1)
    valid = np.cumsum(valid[:n], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return (*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)), joined, begins)
    over = np.flatnonzero(valid & (~np.append(valid[1:], False) | np.append(new[1:], False)))
    strings = over - starts + 1
    document = np.searchsorted(begins, starts, "right") - 1
    # documents of no bytes share a beginning with the next one; the last of them is it
    power = np.empty(n, np.uint64)
    power[0] = 1
    power[1:] = _A | np.uint64(1)
    power = np.cumprod(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[:n] * power)])
    inverse = np.uint64(pow(int(_A | np.uint64(1)), -1, 1 << 64))
    back = np.empty(n, np.uint64)
    back[0] = 1
    back[1:] = inverse
    back = np.cumprod(back)
    content = (sums[starts + strings + length - ANCHOR] - sums[starts]) * back[starts]
    return least[starts], document, starts - begins[document], strings, content, joined, begins


def _short(anchor: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The share an anchor is dealt to, and its other 40 bits."""
    return (anchor >> np.uint64(40)) % np.uint64(shares), anchor & np.uint64((1 << 40) - 1)


def _pack5(x: np.ndarray) -> bytes:
    return x.astype("<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()


def _unpack5(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), "u1")
    out[:, :5] = np.frombuffer(x, "u1").reshape(-1, 5)
    return out.view("<u8").ravel()


def _rows(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[bytes]]:
    """A chunk's documents in order, their ranks by doc_id (null last) and texts."""
    frame = frame.sort_values(["no_id", "doc_id", "text"], kind="stable")
    key = frame["doc_id"].to_numpy()
    lone = frame["no_id"].to_numpy()
    new = np.ones(len(frame), bool)
    new[1:] = (key[1:] != key[:-1]) | (lone[1:] != lone[:-1])
    return frame, np.cumsum(new), [t.encode("utf-8", "surrogatepass") for t in frame["text"]]


def _anchors(shares: int, length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, _, texts = _rows(frame)
        share, rest = _short(segments(texts, length)[0], shares)
        order = np.lexsort((rest, share))
        share, rest = share[order], rest[order]
        new = np.ones(len(rest), bool)
        new[1:] = (share[1:] != share[:-1]) | (rest[1:] != rest[:-1])
        share, rest = share[new], rest[new]
        edges = np.searchsorted(share, np.arange(shares + 1, dtype=np.uint64))
        rows = [(k, int(frame["chunk"].iloc[0]), _pack5(rest[edges[k] : edges[k + 1]])) for k in range(shares) if edges[k] < edges[k + 1]]
        return pd.DataFrame(rows, columns=["share", "chunk", "anchors"])

    return run


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, which of its anchors of a share another chunk holds too."""
    sets = [_unpack5(x) for x in frame["anchors"]]
    values, count = np.unique(np.concatenate(sets), return_counts=True)
    twice = values[count > 1]
    bits = []
    for x in sets:
        at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
        bits.append(np.packbits(twice[at] == x).tobytes() if len(twice) else bytes((len(x) + 7) // 8))
    return pd.DataFrame({"chunk": frame["chunk"], "share": frame["share"], "bits": bits})


def _send(shares: int, length: int):
    def run(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "kind", "chunk", "meta", "content"]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        chunk = int(frame["chunk"].iloc[0])
        frame, rank, texts = _rows(frame)
        anchor, document, start, strings, content, joined, begins = segments(texts, length)
        if not len(anchor):
            return pd.DataFrame(columns=columns)
        share, rest = _short(anchor, shares)
        order = np.lexsort((rank[document], rest, share))
        s, r, d = share[order], rest[order], rank[document[order]]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        wanted = d[np.append(first[1:], len(order)) - 1] != d[first]  # two documents of the chunk
        edges = np.searchsorted(s[first], np.arange(shares + 1, dtype=np.uint64))
        for k, bits in zip(replies["share"], replies["bits"]):
            a, b = edges[k], edges[k + 1]
            wanted[a:b] |= np.unpackbits(np.frombuffer(bits, "u1"))[: b - a].astype(bool)
        order = order[wanted[group]]
        # Equal segments: those after the first document's are covered.
        order = order[np.lexsort((rank[document[order]], strings[order], content[order], rest[order], share[order]))]
        same = np.zeros(len(order), bool)
        for x in (share, rest, content, strings):
            y = x[order]
            same[1:] |= y[1:] != y[:-1]
        head = same.copy()
        head[:1] = True
        lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        covered = rank[document[order]] > rank[document[order[lead]]]
        at = begins[document] + start
        for k in np.flatnonzero(covered).tolist():  # of equal hashes; what differs in its bytes is sent
            a, b, m = at[order[k]], at[order[lead[k]]], strings[order[k]] + length - 1
            covered[k] = joined[a : a + m] == joined[b : b + m]
        rows = []
        if covered.any():
            c = order[covered]
            rows.append((chunk, 1, chunk, np.stack([document[c], start[c], start[c] + strings[c] + length - 1]).astype("<i4").tobytes(), b""))
        order = order[~covered]
        order = order[np.lexsort((start[order], document[order], share[order]))]
        edges = np.searchsorted(share[order], np.arange(shares + 1, dtype=np.uint64))
        for k in range(shares):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                meta = np.stack([document[own], rank[document[own]], start[own], strings[own]]).astype("<i4").tobytes()
                rows.append((k, 0, chunk, meta, b"".join(joined[a : a + m] for a, m in zip(at[own].tolist(), (strings[own] + length - 1).tolist()))))
        return pd.DataFrame(rows, columns=columns)

    return run


def _equal(text: bytes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes from places a on are those from places b on; text is 64 bytes longer than they reach."""
    same = np.ones(len(a), bool)
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        words = _words(text, offset, len(text) - offset - 7)
        same &= words[a] == words[b]
    return same


class Levels:
    """Arrays of the places of different strings of a text in order of their hashes, each over twice as long as the next."""

    def __init__(self, text: bytes, length: int):
        self.text, self.length = text, length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def holds(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """keys: sorted, of the strings at places. A merge scan of each level."""
        found = np.zeros(len(keys), bool)
        for level, held in self.levels:
            asked = np.flatnonzero(~found)
            at = np.searchsorted(level, keys[asked])
            while len(asked):  # once, but where different strings have one hash
                near = at < len(level)
                near[near] = level[at[near]] == keys[asked[near]]
                asked, at = asked[near], at[near]
                same = _equal(self.text, held[at], places[asked], self.length)
                found[asked[same]] = True
                asked, at = asked[~same], at[~same] + 1
        return found

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """keys: sorted, of the strings at places, which are different and held by no level."""
        while self.levels and len(self.levels[-1][0]) < 2 * len(keys):
            level, held = self.levels.pop()
            keys, places = np.concatenate([level, keys]), np.concatenate([held, places])
            order = np.argsort(keys, kind="stable")  # merges the two runs
            keys, places = keys[order], places[order]
        if len(keys):
            self.levels.append((keys, places))


def _scan(length: int, hashes_of=_hash):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] == 1:
            return frame[["chunk", "meta"]]
        frame = frame.sort_values("chunk")
        text = b"".join([*frame["content"], bytes(length + 64)])
        narrow = np.uint32 if len(text) < 1 << 32 else np.int64
        levels, rows, begin = Levels(text, length), [], 0
        for chunk, meta, content in zip(frame["chunk"], frame["meta"], frame["content"]):
            document, rank, start, strings = np.frombuffer(meta, "<i4").reshape(4, -1).astype(np.int64)
            sizes = strings + length - 1
            begins = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(strings)), strings)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
            local = begins[owner] + place
            hashes, places = hashes_of(content + bytes(length + 64), len(content), length)[local], (begin + local).astype(narrow)
            begin += len(content)
            suffixes = np.lexsort((rank[owner], hashes))  # the batch's suffix array, earlier documents first among equals
            tied = np.flatnonzero(hashes[suffixes[1:]] == hashes[suffixes[:-1]])
            unlike = ~_equal(text, places[suffixes[tied + 1]], places[suffixes[tied]], length)
            new = np.ones(len(hashes), bool)
            if unlike.any():  # different strings of one hash
                strings_ = np.array([text[p : p + length] for p in places.tolist()], dtype=object)
                _, ordinal = np.unique(strings_, return_inverse=True)
                suffixes = np.lexsort((rank[owner], ordinal, hashes))
                new[1:] = ordinal[suffixes[1:]] != ordinal[suffixes[:-1]]
            else:
                new[tied + 1] = False
            keys, ranks, places = hashes[suffixes], rank[owner][suffixes], places[suffixes]
            lead = np.flatnonzero(new)
            known = levels.holds(keys[lead], places[lead])
            group = np.cumsum(new) - 1
            hit = np.zeros(len(keys), bool)
            hit[suffixes] = known[group] | (ranks > ranks[lead][group])
            levels.add(keys[lead][~known], places[lead][~known])
            edge = np.ones(len(owner), bool)
            edge[1:] = owner[1:] != owner[:-1]
            opens = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
            closes = np.flatnonzero(hit & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([hit[1:], [False]])))
            if len(opens):
                own = owner[opens]
                rows.append((chunk, np.stack([document[own], start[own] + place[opens], start[own] + place[closes] + length]).astype("<i4").tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "meta"])

    return run


KEPT = "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"


def _cut(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    if not len(frame):
        return pd.DataFrame(columns=["doc_id", "n_bytes", "spans", "kept"])
    frame, _, texts = _rows(frame)
    document, start, stop = np.concatenate([np.frombuffer(m, "<i4").reshape(3, -1) for m in found["meta"]] or [np.zeros((3, 0), np.int32)], axis=1)
    order = np.lexsort((start, document))
    document, start, stop = document[order], start[order], stop[order]
    edges = np.searchsorted(document, np.arange(len(texts) + 1))
    spans, kept = [], []
    for k, text in enumerate(texts):
        own: list[list[int]] = []
        for a, b in zip(start[edges[k] : edges[k + 1]].tolist(), stop[edges[k] : edges[k + 1]].tolist()):
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        spans.append([{"start": a, "stop": b} for a, b in own])
        marks = [0, *(x for s in own for x in s), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(marks[::2], marks[1::2])))
    ids = frame["doc_id"].astype("Int64").mask(frame["no_id"].to_numpy())
    return pd.DataFrame({"doc_id": ids, "n_bytes": [len(t) for t in texts], "spans": spans, "kept": kept})


def _chunk(bounds: list[int]) -> Column:
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def chunk(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    return chunk


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, the removed byte spans and the bytes kept, one row per document."""
    ways = partitions(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(min(MOST_CHUNKS, max(2 * ways, size // CHUNK_BYTES)))
    shares = int(max(ways, size // SHARE_BYTES))
    bounds = sorted({int(x) for x in rows.where("doc_id is not null").approxQuantile("doc_id", [k / chunks for k in range(1, chunks)], 0.2 / chunks)}) if size else []
    keyed = rows.select("doc_id", F.col("doc_id").isNull().alias("no_id"), "text")
    keyed = keyed.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "no_id", "text")
    chunk = F.when(F.col("no_id"), F.lit(len(bounds) + 1)).otherwise(_chunk(bounds)(F.col("doc_id")))
    # One exchange deals the documents to their chunks; the three steps that read them share it.
    dealt = keyed.withColumn("chunk", chunk.cast("int")).repartition(shares, "chunk")
    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInPandas(_anchors(shares, length), "share int, chunk int, anchors binary")
    shared = anchors.repartition(shares, "share").groupBy("share").applyInPandas(_shared, "chunk int, share int, bits binary")
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInPandas(_send(shares, length), "key int, kind int, chunk int, meta binary, content binary")
    found = sent.repartition(shares, "kind", "key").groupBy("kind", "key").applyInPandas(_scan(length), "chunk int, meta binary")
    return by_chunk.cogroup(found.groupBy("chunk")).applyInPandas(_cut, KEPT)


def digest(kept: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long"))
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
