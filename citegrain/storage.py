"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: it is computed once however often it is used, and survives a lost executor.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where none is set, a temporary one serves a session in one process (tests); on a
    cluster that is an error, as executors share no local folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="citegrain-"))
    return df.checkpoint(eager=True)
