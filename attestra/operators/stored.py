"""Results that several branches of a plan, or several jobs, need: computed once and kept where all executors can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in ``spark.checkpoint.dir``: one computation, and a lost executor loses nothing.

    Only a local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestra-"))
    return df.checkpoint()
