"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the jobs rely on, all of them changeable while a session runs.
JOIN_CONF = {
    # A hot node's rows are split over several tasks, also where that costs one more shuffle later.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Skip the sort where every shuffled partition has turned out small enough to hash.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Triples compress well: compare the broadcast limit with their size in memory, not on disk.
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # What a write has shuffled is deleted when it ends, not when the driver next collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set up a session for joins on keys of any size and skew."""
    for key, value in JOIN_CONF.items():
        spark.conf.set(key, value)
    return spark


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A few rows written out in the plan itself, so that their size is known when joins are planned."""
    structs = [F.struct(*(F.lit(v).alias(c) for v, c in zip(row, columns))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    folder of its own; on a cluster a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tripleweave-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, where every executor can read what another has written."""
    return f"{shared_dir(spark)}/{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there, with its lineage cut.

    Unlike a row checkpoint the table is columnar, and its size is known when joins are planned. It is written once
    and read a few times, so it is compressed harder than Spark does by itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, collect: bool = False) -> None:
    """Delete a table written by ``cut`` that nothing will read again.

    With ``collect`` the driver also collects its garbage. Spark deletes a finished job's shuffle files once
    the frames they belong to are gone, which a long job on a large heap may otherwise never see.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if collect:
        jvm.System.gc()
