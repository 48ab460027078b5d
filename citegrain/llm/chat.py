r"""Chat formatting with loss masks that are aligned to token offsets.

A conversation is rendered as one text: each turn is `### role: text</turn>` and a newline. In roles and texts a backslash goes before every
backslash and every control string (`###`, `</turn>`, in roles also `:`), which undoes exactly. The whole text is encoded once, with offsets; the
spans of the assistant's texts, which are sorted, are intersected with the tokens' spans by binary search. A token that reaches over a span's
edge, or that holds a part of a character only, is clipped to the span, so the masked text is each assistant text once and nothing else.

Turns are taken by turn, then role and text; a null turn comes first, a null role or text is an empty one, a null conv_id is one conversation.
Repeated rows are turns each. A conversation of empty texts has an empty mask. Empty tables give no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import load_tokenizer

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
CONTROL, CONTROL_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: A turn as the template writes it: each part is made of escaped strings and of characters that start no control string.
TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|(?!###|</turn>|:)[^\\])*): ((?:\\(?:\\|###|</turn>)|(?!###|</turn>)[^\\])*)</turn>\n", re.S)
LEARNT = "assistant"

FORMATTED = "conv_id long, formatted string, ids array<int>, loss array<boolean>, spans array<struct<start:int,stop:int>>"


def escape(text: str, control=CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) pairs, and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, CONTROL_ROLE)}{MIDDLE}", escape(text)
        parts += [head, body, CLOSE]
        if role == LEARNT and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read (role, text) pairs back."""
    found, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def mask(offsets: np.ndarray, spans) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """offsets: (start, stop) of each token, in order. Returns which tokens are in a span, and the tokens' parts in spans, joined where they meet in one."""
    learnt, clipped = np.zeros(len(offsets), bool), []
    if not len(offsets):
        return learnt, clipped
    starts, stops = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    for a, b in spans:
        first, last = int(np.searchsorted(stops, a, "right")), int(np.searchsorted(starts, b, "left"))
        learnt[first:last] = True
        s, t = np.maximum(starts[first:last], a), np.minimum(offsets[first:last, 1], b)
        at = None
        for x, y in zip(s.tolist(), t.tolist()):
            if at is not None and x <= at[1]:
                at[1] = max(at[1], y)
            else:
                if at:
                    clipped.append(tuple(at))
                at = [x, y]
        if at:
            clipped.append(tuple(at))
    return learnt, clipped


def _formatter(path: str | None):
    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), 50):
                part = batch.iloc[at : at + 50]
                rendered = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in part["turns"]]
                out = []
                for (text, spans), e in zip(rendered, tokenizer.encode_batch([x for x, _ in rendered], add_special_tokens=False)):
                    learnt, clipped = mask(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
                    out.append((text, e.ids, learnt.tolist(), [{"start": a, "stop": b} for a, b in clipped]))
                text, ids, learnt, spans = zip(*out)
                yield pd.DataFrame({"conv_id": part["conv_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "formatted": text, "ids": ids, "loss": learnt, "spans": spans})

    return run


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: its text, token ids, which tokens are learnt from, and the character spans under that mask.

    A conversation is one text and so is gathered whole; conversations are dealt by conv_id. tokenizer: as in packing."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.struct("turn", "role", "text").alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    return whole.mapInPandas(_formatter(tokenizer), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches):
    for batch in batches:
        rows = []
        for conv_id, text, spans in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["spans"]):
            turns = parse(text)
            loss = unescape("".join(text[s["start"] : s["stop"]] for s in spans))
            rows.append((None if conv_id is pd.NA else int(conv_id), len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their text and spans."""
    return formatted.select("conv_id", "formatted", "spans").mapInPandas(_digests, DIGEST)
