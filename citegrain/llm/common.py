"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.storage import settle  # noqa: F401  (the operators take it from here)

#: A word: a run of anything but space and the control characters from tab to carriage return.
#: bytes.split() without arguments splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Have the driver's JVM find what is unreachable, so that the shuffle files of lineage that a checkpoint ended are removed now: it may
    not look for them in a long while. To be called when no variable holds the frame that was settled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run):
    """`run`, a function over batches, that gives the memory it has freed back to the system when a task ends: workers are used again by later
    stages, and what the C library and Arrow's pool keep would add up over them."""

    def wrapped(batches):
        import ctypes

        import pyarrow

        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def partitions(df: DataFrame) -> int:
    """How many ways a shuffle by a key is dealt."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def clean_text(name: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def load_tokenizer(path: str | None = None, plain: bool = True):
    """A tokenizer of the tokenizers library; a worker that runs many tasks loads it once.

    path: a file that executors can open; None: byte_bpe_50k.json of the installed public_tokenizers. plain: special tokens' strings are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    made = vars(public_tokenizers).setdefault("_made", {})
    if ("json", path, plain) not in made:
        from tokenizers import Tokenizer

        made["json", path, plain] = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        made["json", path, plain].encode_special_tokens = plain
    return made["json", path, plain]
