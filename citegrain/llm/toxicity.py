"""Toxicity by class-conditional Kneser-Ney models over shared backoff counts.

An expression is a word, spelt between a start and an end sign. Each class has a Kneser-Ney model of the next character after the ORDER - 1 before it in the
word, counted in labelled texts (a word once for each text): absolute discounting of the class's own counts, backing off to one model of both
classes' counts, and that to ordinary Kneser-Ney continuation counts of shorter contexts. So an inflected form that was never seen is judged by the stem
it shares with toxic ones, and a rare one is drawn to what both classes share.

A word's difference is its toxic minus its ordinary log-likelihood. Differences within DEAD_ZONE count as none: those of common words are of
language and chance, and there are many. A text's difference is the sum over its words, normalised by the square root of their number, as a sum's
spread grows. The score is a logistic function of it, fitted on labelled texts kept apart from the counts.

Nulls, empty texts and texts without a word: difference 0, so the score is the calibrated prior. A null doc_id is not held out. Labels that are null
or repeated: nulls are left out, of repeated labels the largest counts. Repeated documents are scored each. Empty tables or
labels of one class only: every score is 0 if no toxic text is known (1 if only toxic ones are), nothing is learned. Extra columns are
never read; score_documents leaves them out, drop_toxic keeps them. Words of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import settle, trimmed

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled texts for each class in the calibration, part of the model's definition. All others are counted.
FIT_ROWS = 2000
#: Characters of a gram, the discount, how many of a context's own counts weigh as much as the shared ones, and the difference that counts as none.
#: Chosen on the calibration fold of sf0.1 and check_s.
ORDER, DISCOUNT, STRENGTH, DEAD_ZONE = 6, 0.75, 50.0, 2.0
#: Different grams of a model, 12 bytes each in a broadcast. None: all are kept, so that the model does not turn on the input's size. Who sets a number
#: accepts another model where there would be more: the order is lowered until they fit.
MOST_GRAMS: int | None = None
#: Labels, 16 bytes each, that may be broadcast to the documents; more are joined by a shuffle of what is labelled.
BROADCAST_LABELS = 1 << 22
#: Different words held before their grams are sent on, and words whose differences a model remembers.
HELD_WORDS, KNOWN_WORDS = 40_000, 1 << 17
START, END = "\x02", "\x03"

_MULTIPLIER, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _CONTEXT
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hashes(codes: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the last `sizes` (at most `most`) characters up to each place of `codes`, and of those but the last one: a gram and its context."""
    gram = np.zeros(len(codes), np.uint64)
    context = np.zeros(len(codes), np.uint64)
    for k in range(most - 1, -1, -1):
        here = np.zeros(len(codes), np.uint64)
        here[k:] = codes[: len(codes) - k] if k else codes
        gram = np.where(sizes > k, gram * _MULTIPLIER + here + np.uint64(1), gram)
        if k:
            context = np.where(sizes > k, context * _MULTIPLIER + here + np.uint64(1), context)
    return _mixed(gram), _mixed(context ^ _CONTEXT)


@dataclass
class Model:
    order: int = ORDER
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of the counted grams and contexts, sorted
    lean: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # toxic minus ordinary log-probability of a gram's last character; of a context: of any other
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self._held: dict = {}

    def state(self) -> dict:
        return {"order": self.order, "keys": self.keys, "lean": self.lean, "slope": self.slope, "offset": self.offset}

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, self.lean[at]

    def word_differences(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        out = np.zeros(len(words))
        if not len(self.keys) or not words:
            return out
        codes = _codes("".join(START + w + END for w in words))
        lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(begins, lengths)
        gram, context = _hashes(codes, np.minimum(place + 1, self.order), self.order)
        seen, own = self._find(gram)
        known, other = self._find(context)
        value = np.where(seen, own, np.where(known, other, 0)).astype(float)
        value[begins] = 0  # the start sign is given
        return np.add.reduceat(value, begins)

    def differences(self, texts) -> list[float]:
        """Each text's sum of its words' differences beyond the dead zone, normalised by its length; the new words of a few hundred are looked up together."""
        texts, out = list(texts), []
        for at in range(0, len(texts), 200):
            part = [TOKEN.findall((t or "").lower()) for t in texts[at : at + 200]]
            if len(self._held) > KNOWN_WORDS:
                self._held.clear()
            new = [*set().union(*part).difference(self._held)]
            if new:
                v = self.word_differences(new)
                self._held.update(zip(new, (np.sign(v) * np.maximum(np.abs(v) - DEAD_ZONE, 0)).tolist()))
            out += [sum(map(self._held.__getitem__, p)) / len(p) ** 0.5 if p else 0.0 for p in part]
        return out

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.array(self.differences(texts), float) + self.offset, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): a row for each labelled document outside fold 0."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _sampled(known: DataFrame) -> DataFrame:
    """The bounded sample for the calibration, spread evenly by a hash of doc_id."""
    zero, one = (known.where((F.col("toxic") == c) & (fold(F.col("doc_id")) == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for c in (0, 1))
    return zero.unionByName(one)


def _grams(batches):
    """(gram, n0, n1): for each gram of the texts' words, how many pairs of an ordinary or a toxic text and a word in it have it, summed as far as they are held."""

    def rows(held):
        found: dict = {}  # both counts in one number, the toxic one above 32 bits
        for word, n in held.items():
            s = START + word + END
            for i in range(1, len(s)):
                g = s[max(0, i - ORDER + 1) : i + 1]
                found[g] = found.get(g, 0) + n
        counts = np.fromiter(found.values(), np.int64, len(found))
        return pd.DataFrame({"gram": [*found], "n0": counts & 0xFFFFFFFF, "n1": counts >> 32})

    held: dict = {}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            one = 1 << 32 if toxic else 1
            for word in set(TOKEN.findall((text or "").lower())):
                held[word] = held.get(word, 0) + one
            if len(held) > HELD_WORDS:
                yield rows(held)
                held = {}
    if held:
        yield rows(held)


def _packed(batches):
    """The table in a few rows of bytes: grams of one length as UTF-32, and their counts."""
    for x in batches:
        size = x["gram"].str.len()
        for n in size.unique():
            own = x[size == n]
            yield pd.DataFrame({"size": [int(n)], "grams": ["".join(own["gram"]).encode("utf-32-le", "surrogatepass")], "counts": [own[["n0", "n1"]].to_numpy("<i8").tobytes()]})


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each key's sums, one for each row."""
    _, at = np.unique(keys, return_inverse=True)
    return [np.bincount(at, v)[at] for v in values]


def estimate(grams: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The models' tables. grams: character codes, aligned right; sizes: their lengths; own: counts by class. Returns hashes and differences of grams and of contexts."""
    order = grams.shape[1]

    def ids(rows, length, drop=0):
        """A number for each row's last `length` characters but the last `drop`."""
        h = np.zeros(len(rows), np.uint64)
        for k in range(order - length, order - drop):
            h = h * _MULTIPLIER + rows[:, k].astype(np.uint64) + np.uint64(1)
        return _mixed(h)

    # The continuation model of both classes: of each string of k characters, how many strings of k + 1 characters end with it.
    level, low_of = grams[sizes == order], []
    for k in range(order - 1, 0, -1):
        _, first, count = np.unique(ids(level, k), return_index=True, return_counts=True)
        low_of.append((k, level[first], count.astype(float)))
        level = np.concatenate([level[first], grams[sizes == k]])
        level = level[np.unique(ids(level, k), return_index=True)[1]]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, rows, count in reversed(low_of):
        if k == 1:
            p = (count + 0.5) / (count.sum() + 0.5 * len(count))
        else:
            shorter_keys, shorter_p = by_length[k - 1]
            at = np.searchsorted(shorter_keys, ids(rows, k - 1))
            total, kinds = _sums(ids(rows, k, 1), count, np.ones(len(count)))
            p = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * shorter_p[at]) / total
        keys = ids(rows, k)
        to = np.argsort(keys)
        by_length[k] = (keys[to], p[to])
    # Both classes' counts of a context over the continuation model one character shorter, then each class's own over that.
    q = np.zeros(len(grams))
    context = np.zeros(len(grams), np.uint64)
    for n in np.unique(sizes).tolist():
        rows = sizes == n
        keys, p = by_length[n - 1]
        q[rows] = p[np.searchsorted(keys, ids(grams[rows], n - 1))]
        context[rows] = ids(grams[rows], n, 1) ^ np.uint64(n)
    both = own.sum(0).astype(float)
    total, kinds = _sums(context, both, np.ones(len(grams)))
    q = (np.maximum(both - DISCOUNT, 0) + DISCOUNT * kinds * q) / total
    logs, others = [], []
    for n in own.astype(float):
        total, kinds = _sums(context, n, (n > 0).astype(float))
        free = DISCOUNT * kinds + STRENGTH
        logs.append(np.log((np.maximum(n - DISCOUNT, 0) + free * q) / (total + STRENGTH)))
        others.append(np.log(free / (total + STRENGTH)))
    return logs[1] - logs[0], others[1] - others[0]


def _table(grams: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lean, other = estimate(grams, sizes, own)
    order = grams.shape[1]
    flat = grams.ravel().astype(np.uint64)
    gram, context = _hashes(flat, np.repeat(sizes, order), order)
    gram, context = gram[order - 1 :: order], context[order - 1 :: order]
    keys, first = np.unique(np.concatenate([gram, context]), return_index=True)
    return keys, np.concatenate([lean, other])[first].astype(np.float32)


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n0, n1) over all of `texts` (text, toxic), by grouped aggregation."""
    return texts.mapInPandas(trimmed(_grams), "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows whose fold is not 0; fold 1 calibrates, folds 2 to 4 are counted. doc_id only joins and deals."""
    known = settle(_known(labels.select("doc_id", "toxic")))
    counting = known.where(fold(F.col("doc_id")) >= 2)
    few = known.count() <= BROADCAST_LABELS
    counted = documents.select("doc_id", "text").join(F.broadcast(counting) if few else counting, "doc_id").select("text", "toxic")
    texts = settle(documents.select("doc_id", "text").join(F.broadcast(_sampled(known)), "doc_id").select("text", "toxic"))
    table = settle(count_grams(counted))
    model = Model()
    while MOST_GRAMS is not None and model.order > 2 and table.count() > MOST_GRAMS:  # the last characters of a gram are the gram of a lower order
        model.order -= 1
        table = settle(table.groupBy(F.expr(f"right(gram, {model.order})").alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    packed = table.mapInPandas(_packed, "size int, grams binary, counts binary").collect()
    sizes = np.concatenate([np.full(len(r["grams"]) // (4 * r["size"]), r["size"]) for r in packed] or [np.zeros(0, np.int64)])
    grams = np.zeros((len(sizes), model.order), np.uint32)
    at = 0
    for r in packed:
        own = np.frombuffer(r["grams"], "<u4").reshape(-1, r["size"])
        grams[at : at + len(own), model.order - r["size"] :] = own
        at += len(own)
    own = np.frombuffer(b"".join(r["counts"] for r in packed), "<i8").reshape(-1, 2).T
    if not own[0].sum() or not own[1].sum():
        seen = {r["toxic"] for r in counted.unionByName(texts).select("toxic").distinct().collect()}
        model.offset = 40.0 if own[1].sum() or seen == {1} else -40.0
        return model
    model.keys, model.lean = _table(grams, sizes, own)
    _calibrate(model, texts, labels.where(fold(F.col("doc_id")) != 0).agg(F.avg("toxic")).first()[0] or 0.5)
    return model


def _calibrate(model: Model, texts: DataFrame, share: float) -> None:
    """A logistic fit of one slope and offset by Newton's method, with a small ridge."""
    ready = texts.sparkSession.sparkContext.broadcast(model.state())

    def measure(batches):
        m = Model(**ready.value)
        for x in batches:
            yield pd.DataFrame({"x": m.differences(x["text"]), "toxic": x["toxic"].astype("int32")})

    rows = texts.mapInPandas(measure, "x double, toxic int").toPandas()
    x, y = rows["x"].to_numpy(float), rows["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        model.slope, model.offset = 20.0, 0.0
        return
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
    # A score of a half is where the error on the calibration rows is least, the classes weighed by their share of all labels:
    # the rows are not sampled in proportion.
    z = a @ w
    order = np.argsort(z)
    wrong = share * np.cumsum(y[order]) / y.sum() + (1 - share) * (1 - np.cumsum(1 - y[order]) / (1 - y).sum())
    k = int(np.argmin(wrong))
    cut = (z[order][k] + z[order][min(k + 1, len(z) - 1)]) / 2
    model.slope, model.offset = float(w[0] / scale), float(w[1] - cut)


def score_column(spark, model: Model, text: Column) -> Column:
    """The score of a text column, from 0 to 1."""
    ready = spark.sparkContext.broadcast(model.state())

    def scored(parts):
        m = Model(**ready.value)
        for x in parts:
            yield pd.Series(m.scores(x), dtype="float64")

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(scored)(parts)

    return score(text)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    out = documents.select("doc_id", held_out.alias("held_out"), score_column(documents.sparkSession, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """Documents with a score under a half, with the columns they came with."""
    return documents.where(score_column(documents.sparkSession, model, F.col("text")) < 0.5)
