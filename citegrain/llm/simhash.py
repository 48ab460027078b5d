"""SimHash near-duplicates, with links found by the generalised pigeonhole principle.

A fingerprint has 64 bits. To find all pairs within `radius` differing bits, correlated bits are grouped into parts; dynamic programming on a
sample gives each part a threshold of its own (-1: it is not searched) such that the thresholds plus one add up to radius + 1, where the rows
probed and the candidates to verify are estimated to be fewest. A pair within the radius then is within the threshold of some part, so no link
is lost. Every fingerprint is put at its part's value and probes the values within the threshold; candidates meet by value and are verified by
the bits they differ in. Nothing but a spanning forest of the links of each value's group leaves a task; a group of many fingerprints is split
into pairs of blocks.

Nulls and texts without words have fingerprint zero and are linked like any other. A null doc_id is carried; it is no component's id unless all of
its component's ids are null. Repeated documents get a row each. Empty tables give no row. Extra columns are not read (kept by
drop_near_duplicates).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import clean_text, partitions, settle, trimmed
from citegrain.llm.components import components

BITS, SEED = 64, 42
SHINGLE, RADIUS = 4, 4
#: Fingerprints that the plan is estimated on, and the relative costs of a probed row (which is shuffled) and a verified candidate (a few machine instructions).
SAMPLE, ROW_COST, PAIR_COST = 2048, 1.0, 0.001
#: A value's group of more fingerprints than this is split into blocks of about half as many.
GROUP = 16_384
#: A plan has fewer parts than this power of two; a group's number ends in its part's.
PARTS = 8
#: Pairs of rows that a task lays out at once.
PAIRS = 1 << 19
#: Where values are probed within a task: a candidate's cost over a probe's; a bucket's rows and pairs beyond which it is split into blocks; and a part's
#: bits that these are estimated by.
TASK_PAIR_COST, BUCKET, WORK, COUNTED = 0.3, 1 << 20, 1 << 30, 13


def fingerprint_words(words: list[bytes], shingle: int) -> int:
    """A bit is set if it is set in over half of the XXH64 hashes of the shingles, repeats included; without words it is zero."""
    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:-1]))
    n = max(1, len(words) - shingle + 1)
    ends = (stops[shingle - 1 :] if len(words) >= shingle else stops[-1:]) - 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : min(at + 8192, n)].tolist(), ends[at : at + 8192].tolist())), "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): texts in lower case (A to Z only)."""

    def run(batches):
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for i, text in enumerate(batch["text"]):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                out[i] = fingerprint_words(words, shingle)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": out.view(np.int64)})

    return documents.select(F.col("doc_id").cast("long"), clean_text().alias("text")).mapInPandas(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")


def _group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of about equal width; each grows from its first free bit by the free bit most correlated with it."""
    x = bits.astype(float) - bits.mean(0)
    scale = np.sqrt((x * x).sum(0))
    close = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        part = [free.pop(0)]
        while len(part) < width:
            best = max(free, key=lambda j: (round(close[j, part].mean(), 3), -j))
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def _ball(width: int, threshold: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(threshold + 1) for c in combinations(range(width), r)]


def plan(sample: np.ndarray, total: int, radius: int, pair_cost: float = PAIR_COST) -> list[tuple[list[int], int]]:
    """The parts' bits and thresholds with the least estimated cost for `total` fingerprints."""
    sample = np.unique(sample.astype(np.uint64))
    bits = _bits(sample) if len(sample) > 1 else np.eye(2, BITS, dtype=np.uint8)
    best = None
    for parts in range(2, PARTS):
        groups = _group_bits(bits, parts)
        costs = []
        for group in groups:
            own = bits[:, group].astype(np.int32)
            probe = own[:256]
            apart = probe.sum(1)[:, None] + own.sum(1)[None] - 2 * probe @ own.T
            n = max(1, apart.size - len(probe))
            row = {-1: 0.0}
            for t in range(0, min(3, radius, len(group) - 1) + 1):
                ball = len(_ball(len(group), t))
                share = max(((apart <= t).sum() - len(probe)) / n, ball / 2.0 ** len(group))
                row[t] = total * (ball * ROW_COST + share * total * pair_cost)
            costs.append(row)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # thresholds plus one, added up
        for row in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, chosen) in table.items():
                for t, more in row.items():
                    if used + t + 1 <= radius + 1 and (used + t + 1 not in step or c + more < step[used + t + 1][0]):
                        step[used + t + 1] = (c + more, [*chosen, t])
            table = step
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], [(g, t) for g, t in zip(groups, table[radius + 1][1]) if t >= 0])
    return best[1]


def _probes(parts):
    """Rows (part, value, probe, fp, id): each fingerprint at its own value and at those around it."""

    def run(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            bits, ids = _bits(fps.view(np.uint64)).astype(np.int64), batch["id"].to_numpy(np.int64)
            for k, (group, threshold) in enumerate(parts):
                own = bits[:, group] @ (1 << np.arange(len(group), dtype=np.int64))
                for mask in _ball(len(group), threshold):
                    yield pd.DataFrame({"part": np.int32(k), "value": own ^ mask, "probe": np.int8(mask != 0), "fp": fps, "id": ids})

    return run


def _groups(batches, columns):
    """Arrays of whole groups (rows of a gid are adjacent), as many as have come together."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch[c].to_numpy() for c in columns if c in batch]
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        gid = held[0]
        if len(gid) < 50_000 or gid[0] == gid[-1]:
            continue
        whole = len(gid) - int(np.argmax(gid[::-1] != gid[-1]))
        yield [x[:whole] for x in held]
        held = [x[whole:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _meetings(gid, probe, fps, radius: int, parts, able):
    """(i, j): rows of a group within the radius of which one at least is at its own value; those come first in a group. A pair that meets in
    several parts is given in the first of them only. A bounded number of pairs is laid out at once. able: tells from i and j which pairs are worth a look."""
    masks = [(np.uint64(sum(1 << b for b in group)), threshold) for group, threshold in parts]
    n = len(gid)
    own = np.flatnonzero(probe == 0)
    last = np.append(np.flatnonzero(gid[1:] != gid[:-1]), n - 1)
    count = last[np.searchsorted(last, own)] - own
    done = np.cumsum(count)
    cuts = np.searchsorted(done, np.arange(PAIRS, int(done[-1]) + PAIRS if len(done) else 0, PAIRS), "right")
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(own))):
        rows, size = own[a:b], count[a:b]
        if not size.sum():
            continue
        i = np.repeat(rows, size)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        worth = able(i, j)
        i, j = i[worth], j[worth]
        bits = fps[i] ^ fps[j]
        near = np.bitwise_count(bits) <= radius
        i, j, bits = i[near], j[near], bits[near]
        part = gid[i] & (PARTS - 1)
        first = np.ones(len(i), bool)
        for k, (mask, threshold) in enumerate(masks[:-1]):
            first &= (part <= k) | (np.bitwise_count(bits & mask) > threshold)
        yield i[first], j[first]


def _forest(radius: int, parts):
    """Links within each group: a spanning forest, each fingerprint with the least one that it reaches in its group."""

    def run(batches):
        for gid, probe, fps, ids in _groups(batches, ["gid", "probe", "fp", "id"]):
            fps, n = fps.view(np.uint64), len(gid)
            label = np.arange(n)
            changed = True
            while changed:  # until no link joins two labels
                changed = False
                for i, j in _meetings(gid, probe, fps, radius, parts, lambda i, j: label[i] != label[j]):
                    if len(i):
                        changed = True
                        least = np.minimum(label[i], label[j])
                        np.minimum.at(label, i, least)
                        np.minimum.at(label, j, least)
                        np.minimum.at(label, label[i], least)
            own = label != np.arange(n)
            yield pd.DataFrame({"a": ids[label[own]], "b": ids[own], "apart": np.int32(0)}).query("a != b").drop_duplicates()

    return run


#: What a row of a bucket holds; the label only in the second pass.
def _row(words: int, labelled: bool) -> np.dtype:
    return np.dtype([("fp", "<u8"), ("id", "<i8"), ("size", "<i4"), *([("label", "<i8")] if labelled else []), ("sketch", "<u8", (words,))])


def _value(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def _own_counts(parts):
    """(part, value, n): how many fingerprints have each value of a part's first COUNTED bits."""

    def run(batches):
        sums = [np.zeros(1 << min(len(group), COUNTED), np.int64) for group, _ in parts]
        for batch in batches:
            bits = _bits(batch["fp"].to_numpy(np.int64).view(np.uint64))
            for k, (group, _) in enumerate(parts):
                sums[k] += np.bincount(_value(bits, group[:COUNTED]), minlength=len(sums[k]))
        for k, n in enumerate(sums):
            at = np.flatnonzero(n)
            yield pd.DataFrame({"part": np.int32(k), "value": at.astype(np.int32), "n": n[at]})

    return run


def layout(parts, counts: list[np.ndarray], total: int) -> list[tuple[int, np.ndarray]]:
    """For each part, by how many of its first bits it is dealt, and the blocks of each bucket: more than one where rows or pairs are many."""
    out = []
    for (group, threshold), n in zip(parts, counts):
        q = min(len(group), COUNTED)
        at = np.arange(len(n))
        work = n * sum(n[at ^ mask] for mask in _ball(q, threshold)) / 2
        p = min(5, q)
        while p < q and total * (1 + len(_ball(p, threshold))) / 2 > BUCKET << p:
            p += 1
        own, work = (np.bincount(at & ((1 << p) - 1), x, 1 << p) for x in (n, work))
        at = np.arange(1 << p)
        rows = own + sum(np.where(at ^ mask > at, own[at ^ mask], 0) for mask in _ball(p, threshold)[1:])
        out.append((p, np.ceil(np.maximum(np.maximum(rows / BUCKET, np.sqrt(work / WORK)), 1)).astype(np.int64)))
    return out


def _buckets(parts, deal, kind: np.dtype):
    """Rows (key, data): the fingerprints of a batch that meet in a bucket, in one run of bytes. A bucket has those that begin with its bits and those of larger
    beginnings within the threshold, so two fingerprints meet in one bucket of a part. A bucket of several blocks (by id) has a key for each two of them."""

    def run(batches):
        for batch in batches:
            rows = np.zeros(len(batch), kind)
            for c in ("fp", "id", "size", "label"):
                if c in kind.names:
                    rows[c] = batch[c].to_numpy(np.int64).astype(kind[c])
            rows["sketch"] = (np.frombuffer(b"".join(batch["sketch"]), "<u8") if batch["sketch"].dtype == object else batch["sketch"].to_numpy(np.int64).view(np.uint64)).reshape(len(batch), -1)
            bits = _bits(rows["fp"])
            for k, ((group, threshold), (p, blocks)) in enumerate(zip(parts, deal)):
                own = _value(bits, group[:p])
                to, who = [], []
                for mask in _ball(p, threshold):
                    at = np.flatnonzero(own ^ mask <= own)
                    goes = own[at] ^ mask
                    many = blocks[goes]
                    at, goes, other = np.repeat(at, many), np.repeat(goes, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    block = rows["id"][at] % blocks[goes]
                    to.append(((np.int64(k) << 20 | goes) << 40) | np.minimum(block, other) << 20 | np.maximum(block, other))
                    who.append(at)
                to, who = np.concatenate(to), np.concatenate(who)
                order = np.argsort(to, kind="stable")
                keys, first = np.unique(to[order], return_index=True)
                yield pd.DataFrame({"key": keys, "data": [rows[x].tobytes() for x in np.split(who[order], first[1:])]})

    return run


def _pairs_of(rows, key: int, parts, deal, radius: int):
    """(i, j): rows of a bucket within the radius, each pair once over all buckets: in the first part where it meets. A bounded number is laid out at once."""
    k, prefix, two = key >> 60, key >> 40 & ((1 << 20) - 1), (key >> 20 & ((1 << 20) - 1), key & ((1 << 20) - 1))
    (group, threshold), (p, blocks) = parts[k], deal[k]
    masks = [(np.uint64(sum(1 << b for b in g)), t) for g, t in parts[:k]]
    fps, bits = rows["fp"], _bits(rows["fp"])
    far = np.bitwise_count(_value(bits, group[:p]) ^ prefix).astype(np.int64)
    rest = _value(bits, group[p:])
    width = len(group) - p
    order = np.lexsort((rest, far > 0))
    own, place = rest[order][: int((far == 0).sum())], np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    start = np.searchsorted(own, np.arange((1 << width) + 1)) if width <= 16 else None
    block = rows["id"] % blocks[prefix]
    label = rows["label"] if "label" in rows.dtype.names else rows["id"]
    for mask in _ball(width, threshold):
        j = np.flatnonzero(far + mask.bit_count() <= threshold)
        target = rest[j] ^ mask
        if mask:  # of two at their own beginnings, the one with the smaller rest looks for the other
            j = j[(far[j] > 0) | (target > rest[j])]
            target = rest[j] ^ mask
        lo, hi = (start[target], start[target + 1]) if start is not None else (np.searchsorted(own, target), np.searchsorted(own, target, "right"))
        if not mask:
            lo = np.where(far[j] == 0, place[j] + 1, lo)
        done = np.cumsum(hi - lo)
        cuts = np.searchsorted(done, np.arange(PAIRS, int(done[-1]) + PAIRS if len(done) else 0, PAIRS), "right")
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(j))):
            size = (hi - lo)[a:b]
            if not size.sum():
                continue
            y = np.repeat(j[a:b], size)
            x = order[np.repeat(lo[a:b], size) + np.arange(len(y)) - np.repeat(np.cumsum(size) - size, size)]
            apart = fps[x] ^ fps[y]
            near = np.flatnonzero(np.bitwise_count(apart) <= radius)
            x, y, apart = x[near], y[near], apart[near]
            worth = label[x] != label[y]
            if two[0] != two[1]:
                worth &= block[x] != block[y]
            for other, most in masks:
                worth &= np.bitwise_count(apart & other) > most
            yield x[worth], y[worth]


def _near(radius: int, parts, deal, kind: np.dtype, ratio: float, all_pairs: bool):
    """Candidates of each bucket with the bits that their sketches differ in: all of them, or each one's nearest before and after it by id (ties: the smaller id)."""
    most = furthest(ratio, BITS * kind["sketch"].shape[0])

    def found(key, data):
        rows = np.frombuffer(b"".join(data), kind)
        ids, size, sketch, n = rows["id"], rows["size"], rows["sketch"], len(rows)
        by_id = np.argsort(ids)
        rank = np.empty(n, np.int64)
        rank[by_id] = np.arange(n)
        none = np.iinfo(np.int64).max
        below, above = np.full(n, none), np.full(n, none)
        for i, j in _pairs_of(rows, key, parts, deal, radius):
            like = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
            i, j = i[like], j[like]
            apart = np.concatenate([np.bitwise_count(sketch[i[at : at + 65_536]] ^ sketch[j[at : at + 65_536]]).sum(1, dtype=np.int64) for at in range(0, len(i) + 1, 65_536)])
            may = apart <= most
            i, j, apart = i[may], j[may], apart[may]
            turned = ids[i] > ids[j]
            lo, hi = np.where(turned, j, i), np.where(turned, i, j)
            if all_pairs:
                yield pd.DataFrame({"a": ids[lo], "b": ids[hi], "apart": apart.astype(np.int32)})
                continue
            np.minimum.at(below, hi, apart * n + rank[lo])
            np.minimum.at(above, lo, apart * n + rank[hi])
        b, a = np.flatnonzero(below < none), np.flatnonzero(above < none)
        pairs = {"a": [ids[by_id[below[b] % n]], ids[a]], "b": [ids[b], ids[by_id[above[a] % n]]], "apart": [below[b] // n, above[a] // n]}
        yield pd.DataFrame({c: np.concatenate(x) for c, x in pairs.items()}).astype({"apart": np.int32}).drop_duplicates()

    def run(batches):
        key, held = None, []
        for batch in batches:
            for own, data in zip(batch["key"].tolist(), batch["data"]):
                if own != key and held:
                    yield from found(key, held)
                    held = []
                key = own
                held.append(data)
        if held:
            yield from found(key, held)

    return run


def candidates(fps: DataFrame, radius: int, ratio: float, all_pairs: bool) -> DataFrame:
    """(a, b, apart) between the ids (not negative) of `fps` (id, fp, sketch, size, perhaps label), which is settled: pairs within `radius` bits, of different labels,
    that sizes and sketches let have the similarity `ratio`. All of them, or the nearest ones by sketch. What is found does not depend on the plan.

    Fingerprints meet by the first bits of a part; the part's other bits are probed within a task. So a text is dealt some ten times for a part however
    many values it probes, and as bytes, not as rows."""
    total = fps.count()
    # a bounded sample, spread by a hash: at most SAMPLE rows come to the driver; it only decides the plan's cost
    sample = np.array([r["fp"] for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, total, radius, TASK_PAIR_COST)
    counts = [np.zeros(1 << min(len(group), COUNTED), np.int64) for group, _ in parts]
    # at most PARTS << COUNTED rows
    for r in fps.select("fp").mapInPandas(trimmed(_own_counts(parts)), "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).collect():
        counts[r["part"]][r["value"]] = r["n"]
    deal = layout(parts, counts, total)
    wide = fps.schema["sketch"].dataType.simpleString() == "binary"
    kind = _row(LONG if wide else SHORT, "label" in fps.columns)
    columns = [c for c in ("fp", "id", "size", "label", "sketch") if c in fps.columns]
    dealt = fps.select(*columns).mapInPandas(trimmed(_buckets(parts, deal, kind)), "key long, data binary")
    dealt = dealt.repartition(partitions(fps), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(trimmed(_near(radius, parts, deal, kind, ratio, all_pairs)), "a long, b long, apart int")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, apart) between the ids of `fps` (id, fp): enough of the links within `radius` bits to join the same components in each group; apart is 0.

    fps is read more than once and so is best settled."""
    total = fps.count()
    # a bounded sample, spread by a hash: at most SAMPLE rows come to the driver
    sample = np.array([r["fp"] for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, total, radius)
    rows = fps.select("id", "fp").mapInPandas(trimmed(_probes(parts)), "part int, value long, probe byte, fp long, id long")
    # Hot values: at most one in GROUP rows, known before the rows are dealt.
    hot = settle(rows.groupBy("part", "value").count().where(F.col("count") > GROUP).select("part", "value", F.ceil(F.col("count") / (GROUP // 2)).cast("int").alias("blocks")))
    if hot.limit(1).count():
        block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
        rows = rows.join(_small(hot), ["part", "value"], "left").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.withColumn("gid", F.xxhash64("part", "value", F.least("own", "other"), F.greatest("own", "other")))
    else:
        rows = rows.withColumn("gid", F.xxhash64("part", "value"))
    rows = rows.withColumn("gid", F.col("gid").bitwiseAND(F.lit(-PARTS)).bitwiseOR(F.col("part").cast("long")))
    dealt = rows.select("gid", "probe", "fp", "id").repartition(partitions(fps), "gid").sortWithinPartitions("gid", "probe", "id")
    return dealt.mapInPandas(trimmed(_forest(radius, parts)), "a long, b long, apart int").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def label_documents(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id: the smallest doc_id reached over links of at most `radius` differing bits."""
    own = settle(fingerprints(documents, shingle))
    classes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes.select(F.col("fp").alias("id"), "fp"), radius))
    labelled = classes.join(found.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labelled.join(least, "label").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates of texts: fingerprints of the different words, in which one changed word moves few bits, propose pairs within
#: this many bits; five-word shingles decide.
WORD_RADIUS, PAIR_SHINGLE, SIMILARITY = 12, 5, 0.8
#: Words of 64 bits in the sketch that every text has and in the one that only texts with a candidate have.
SHORT, LONG = 1, 8
_SALTS = np.random.default_rng(SEED).integers(1, 1 << 62, LONG * BITS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of a group that are verified together against as many of another.
TILE = 64
#: Rows of two longs that may be broadcast to the documents, so that no text is shuffled; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 22


def _small(df: DataFrame) -> DataFrame:
    """df is settled; it is broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(documents: DataFrame) -> DataFrame:
    """The documents with a doc_id, as (doc_id, id, text): id is a non-negative hash of the text."""
    body = clean_text()
    text_id = F.xxhash64(F.md5(body.cast("binary"))).bitwiseAND(F.lit((1 << 63) - 1))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_id.alias("id"), body.alias("text")).where("doc_id is not null")


def shingle_hashes(words: list[bytes], shingle: int, known: dict) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; fewer words have one of them all. known: the words' hashes so far."""
    import xxhash

    if len(known) > 1 << 17:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(own) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(own))):
        h = (h ^ (h >> np.uint64(31))) * _SALTS[0] + own[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * _SALTS[1]
    return h ^ (h >> np.uint64(29))


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits, one of the least value of each of as many hash functions over the set: two sets' sketches differ in about (1 - Jaccard similarity) / 2 of them."""
    salts = _SALTS[: BITS * words]
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048 // words):
        x = hashes[at : at + 2048 // words, None] * salts
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return np.packbits(((least * _SALTS[0]) >> np.uint64(40) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")


def furthest(ratio: float, width: int) -> float:
    """Bits that the sketches of sets with the similarity `ratio` differ in, and four standard deviations more."""
    share = (1 - ratio) / 2
    return width * share + 4 * (width * share * (1 - share)) ** 0.5


def _prints(shingle: int):
    def run(batches):
        known: dict = {}
        for batch in batches:
            fps, sizes, sketches = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.int32), []
            for k, text in enumerate(batch["text"]):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                hashes = np.unique(shingle_hashes(words, shingle, known))
                fps[k] = fingerprint_words([*dict.fromkeys(words)], 1)
                sketches.append(sketch(hashes, SHORT).view(np.int64)[0])
                sizes[k] = len(hashes)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "id": batch["id"], "fp": fps.view(np.int64), "sketch": sketches, "size": sizes})

    return run


def _shingle_sets(shingle: int):
    """The 32-bit hashes of a text's different word shingles, and their long sketch."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t.encode("utf-8", "surrogatepass").lower().split(), shingle, known)) for t in batch["text"]]
            sets = [np.unique((h >> np.uint64(32)).astype(np.uint32).view(np.int32)) for h in hashes]
            yield pd.DataFrame({"id": batch["id"], "set": sets, "sketch": [sketch(h, LONG).tobytes() for h in hashes]})

    return run


def _tiles(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) with the tile they are verified in: texts are numbered by label, so that the pairs of two groups are few tiles and a set is sent to a tile once."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # a label's texts in blocks of about TILE, by a hash, so that no task numbers a large group
    known = ends.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = known.groupBy("label").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    placed = settle(known.join(sizes, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), "blocks")).alias("block")))
    own, other = placed.select(F.col("id").alias("a"), F.col("block").alias("x")), placed.select(F.col("id").alias("b"), F.col("block").alias("y"))
    tile = F.xxhash64(F.least("x", "y"), F.greatest("x", "y"))
    return settle(pairs.select("a", "b").join(own, "a").join(other, "b").select(tile.alias("tile"), "a", "b"))


def _verify(similarity: float):
    def run(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(members["id"].tolist(), members["set"]))
        out = []
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both))
        return pairs.loc[np.array(out, bool), ["a", "b"]]

    return run


def near_links(documents: DataFrame, shingle: int = PAIR_SHINGLE, similarity: float = SIMILARITY, radius: int = WORD_RADIUS) -> tuple[DataFrame, DataFrame]:
    """(classes, found): classes (id, least, copies) has a row for each different text, its least doc_id and how many rows have both; found (a, b) are
    links between ids of texts whose sets of word shingles have a Jaccard similarity of at least `similarity`: enough of them to join what all of them join.

    Each class is verified against its nearest candidates before and after it over all fingerprints, by a short sketch of its shingles. Then every candidate
    pair that these links do not join yet is verified, if long sketches let it be similar. So a large group of copies is joined by two pairs for each text, and
    what is verified of it besides are pairs with texts outside of it. A text's candidates have each at least one nearest one, so the sets of all are at hand."""
    keyed = _keyed(documents)
    prints = keyed.mapInPandas(trimmed(_prints(shingle)), "doc_id long, id long, fp long, sketch long, size int")
    rows = settle(prints.groupBy("id", "doc_id").agg(F.first(F.struct("fp", "sketch", "size")).alias("print"), F.count("*").alias("copies")))
    first = rows.groupBy("id").agg(F.min(F.struct("doc_id", "copies", "print")).alias("first"))
    classes = settle(first.select("id", F.col("first.doc_id").alias("least"), F.col("first.copies").alias("copies"), "first.print.*"))

    proposed = settle(candidates(classes.select("id", "fp", "sketch", "size"), radius, similarity, False))
    before = proposed.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("near")).select(F.col("near.a").alias("a"), "b")
    after = proposed.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("near")).select("a", F.col("near.b").alias("b"))
    chosen = settle(before.unionByName(after).distinct())
    ends = chosen.select(F.col("a").alias("id")).unionByName(chosen.select(F.col("b").alias("id"))).distinct()
    wanted = settle(classes.select("id", F.col("least").alias("doc_id")).join(ends, "id"))
    texts = keyed.join(_small(wanted), ["doc_id", "id"])
    sets = settle(texts.select("id", "text").mapInPandas(trimmed(_shingle_sets(shingle)), "id long, set array<int>, sketch binary").dropDuplicates(["id"]))

    paired = chosen.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")
    both = F.size(F.array_intersect("left", "right"))
    found = settle(paired.where(both >= similarity * (F.size("left") + F.size("right") - both)).select("a", "b"))

    joined = components(found).select(F.col("node").alias("id"), "label")
    apart = classes.select("id", "fp", "size").join(sets.select("id", "sketch"), "id").join(joined, "id", "left")
    apart = settle(apart.select("id", "fp", "sketch", "size", F.coalesce("label", "id").alias("label")))
    rest = settle(candidates(apart, radius, similarity, True).select("a", "b").join(chosen, ["a", "b"], "left_anti"))
    tiles = _tiles(rest, apart)
    members = tiles.select(F.col("tile").alias("of"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "set"), "id")
    more = settle(tiles.groupBy("tile").cogroup(members.groupBy("of")).applyInPandas(_verify(similarity), "a long, b long"))
    return classes.select("id", "least", "copies"), found.unionByName(more)


def drop_near_duplicates(documents: DataFrame, **how) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, with all its columns. Documents without a doc_id stay;
    of rows that repeat a doc_id with the same text the one stays that comes first as JSON."""
    classes, found = near_links(documents, **how)
    groups = components(found)
    placed = classes.join(groups.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    # of a group's texts that share the smallest doc_id (rows may repeat one) the one of least id stays
    heads = placed.groupBy("label").agg(F.min(F.struct("least", "id", "copies")).alias("head")).select("head.*")
    stay = settle(heads.select(F.col("least").alias("stay_id"), F.col("id").alias("stay_text"), "copies"))
    doc_id, text_id = F.col("doc_id").cast("long"), F.xxhash64(F.md5(clean_text().cast("binary"))).bitwiseAND(F.lit((1 << 63) - 1))
    own = (doc_id == F.col("stay_id")) & (text_id == F.col("stay_text"))
    single = documents.join(_small(stay.select("stay_id", "stay_text")), own, "left_semi")
    again = settle(stay.where("copies > 1").select("stay_id", "stay_text"))
    if again.limit(1).count():
        names = documents.columns
        row = F.struct(*[F.col(c) for c in names])
        held = documents.join(_small(again), own, "left_semi").select(row.alias("row"), doc_id.alias("key"), text_id.alias("text_key"))
        first = held.withColumn("n", F.row_number().over(Window.partitionBy("key", "text_key").orderBy(F.to_json("row")))).where("n = 1").select("row.*")
        single = single.join(_small(again), own, "left_anti").unionByName(first)
    return single.unionByName(documents.where("doc_id is null"))
