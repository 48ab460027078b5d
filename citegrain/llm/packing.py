"""Cost-balanced packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they are read; each task packs what it reads, a bounded buffer at a time, so nothing is
shuffled. In a buffer of T tokens there are T // capacity sequences of exactly `capacity` tokens, and the rest of the tokens fill
sequences whose lengths are the powers of two that make it up, so that no sequence needs padding. A piece costs
LINEAR * n + QUADRATIC * n * n (attention stays within a document); in descending length, each piece goes to the sequence
of lowest cost among those with room for all of it. Where none has room, the piece is cut over the emptiest ones.

A null text is an empty one: it has the end token alone. Repeated documents are packed each. Empty tables give no piece. Very long
texts are cut into pieces of the capacity. Extra columns are not read.
sequence_id holds the task's partition in its upper bits; a task that runs again reads the same rows and gives the same result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import load_tokenizer, trimmed

CAPACITY, END_ID = 2048, 1
#: Attention cost of a piece: projections grow with its length, attention scores with its square.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that a task holds before it packs them: 16 MB at four bytes each.
BUFFER_TOKENS = 1 << 22

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, capacity long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pack documents of these lengths. Returns pieces (document, start, length, sequence, offset) and the sequences' sizes."""
    total = int(sum(lengths))
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    waiting = []
    whole = 0
    pieces = []
    for i, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:  # a full piece has a sequence of its own
            pieces.append((i, start, capacity, whole, 0))
            whole += 1
            start += capacity
        if n > start:
            waiting.append((n - start, i, start))
    waiting.sort(key=lambda x: (-x[0], x[1], x[2]))
    room = list(sizes)
    for k in range(whole):
        room[k] = 0
    costs = [0.0] * len(sizes)
    heap = [(0.0, k) for k in range(whole, len(sizes))]
    heapq.heapify(heap)
    by_room: list[tuple[int, int]] = []
    largest = capacity

    def place(i: int, start: int, n: int, k: int) -> None:
        pieces.append((i, start, n, k, sizes[k] - room[k]))
        room[k] -= n
        costs[k] += cost(n)

    for at, (n, i, start) in enumerate(waiting):
        passed = []
        while n <= largest and heap:
            c, k = heapq.heappop(heap)
            if room[k] >= n:
                place(i, start, n, k)
                n = 0
                if room[k]:
                    heapq.heappush(heap, (costs[k], k))
                break
            passed.append((c, k))
        for x in passed:
            heapq.heappush(heap, x)
        if not n:
            continue
        # None has room for it: pieces come in descending order, so rooms only shrink below the pieces that follow from here on.
        largest = max((room[k] for _, k in heap), default=0)
        if largest >= n:
            continue
        by_room = [(-room[k], k) for _, k in heap if room[k]]
        heapq.heapify(by_room)
        while n:
            r, k = heapq.heappop(by_room)
            take = min(n, -r)
            place(i, start, take, k)
            start, n = start + take, n - take
        heap = [(costs[k], k) for _, k in heap if room[k]]
        heapq.heapify(heap)
        largest = max((room[k] for _, k in heap), default=0)
    return pieces, sizes


#: The one special token of the default file: its string in a text is that token, as the tokenizers library reads it.
SPECIAL = {"<|endoftext|>": 50256}
#: Texts of more characters than this are encoded by the tokenizers library, whose stack does not grow with a run of spaces. The ids are the same.
LONG_TEXT = 1_000_000


def _encoder(path: str | None):
    """Texts to arrays of ids, as tokenizers encodes them with add_special_tokens=False.

    byte_bpe_50k.json has the same vocabulary as byte_bpe_50k.tiktoken; the ranks give the same ids (tests compare them) in a
    quarter of the time, so the default reads those. Any other file is read by tokenizers."""
    import public_tokenizers

    made = vars(public_tokenizers).setdefault("_made", {})  # a worker that runs many tasks reads the files once

    def slow(text: str) -> np.ndarray:
        return np.array(load_tokenizer(path, plain=False).encode(text, add_special_tokens=False).ids, dtype="<u4")

    if path:
        return slow
    if "ranks" not in made:
        import base64

        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made["ranks"] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    quick = made["ranks"]
    return lambda t: slow(t) if len(t) > LONG_TEXT else np.array(quick.encode(t, allowed_special="all"), dtype="<u4")


def _packer(path: str | None, capacity: int, end_id: int, buffer_tokens: int):
    def pack(batches):
        encode = _encoder(path)
        base = TaskContext.get().partitionId() << 40
        done = 0

        def flush(names, tokens):
            nonlocal done
            pieces, sizes = assign([len(t) for t in tokens], capacity)
            for at in range(0, len(pieces), 10_000):
                d, s, n, q, o = zip(*pieces[at : at + 10_000])
                yield pd.DataFrame({
                    "doc_id": pd.array([names[i] for i in d], dtype="Int64"), "start": s, "length": n, "ids": [tokens[i][a : a + b].tobytes() for i, a, b in zip(d, s, n)],
                    "doc_tokens": [len(tokens[i]) for i in d], "sequence_id": [base + done + k for k in q], "offset": o, "capacity": [sizes[k] for k in q],
                })
            done += len(sizes)

        names, tokens, held = [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            ids = batch["doc_id"]
            missing = ids.isna()
            for k, text in enumerate(texts):
                tokens.append(np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False))
                names.append(None if missing.iloc[k] else int(ids.iloc[k]))
                held += len(tokens[-1])
                if held >= buffer_tokens:
                    yield from flush(names, tokens)
                    names, tokens, held = [], [], 0
        if tokens:
            yield from flush(names, tokens)

    return pack


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece, with its token ids as little-endian unsigned 32-bit integers in `ids` and its sequence's size in `capacity`.

    tokenizer: path of a tokenizer file that executors can open; None: byte_bpe_50k.json of the installed public_tokenizers."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(trimmed(_packer(tokenizer, capacity, end_id, buffer_tokens)), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity")
