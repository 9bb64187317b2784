"""Tables written to the cluster's shared folder, to cut lineage and to read a costly result more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from signalbox.session import work_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once under `spark.checkpoint.dir` and read back.

    A lost executor costs no more than the tasks that read the written files again. The shuffle
    files behind the table are not needed any more and are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
