"""Cut lineage through the checkpoint folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` (a temporary folder where that is unset, as in tests) and read from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="chronopath-"))
    return df.checkpoint(eager=True)


def forget(*held: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in held:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
