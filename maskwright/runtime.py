"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "maskwright", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: partitions that ``spread`` deals a scan out to; unset, files are read as they lie.
INPUT_PARTITIONS = "maskwright.input.partitions"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local master, which has one machine, may do without:
    it gets a folder of its own. Anywhere else a missing setting is an error.

    What is written below the folder in this session is deleted when the session's JVM ends.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "maskwright-checkpoints")
    sc.setCheckpointDir(folder)
    own = sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder, so later readers neither recompute it nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed columnar table: for wide or long intermediate results of which readers take parts."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many partitions as the session sets in ``maskwright.input.partitions``, else as it lies.

    For sessions whose inputs lie in fewer files than cores, such as the bench. The plan never depends on the size.
    """
    parts = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def exploded(df: DataFrame, keep: list[str], array: Column, name: str = "d") -> DataFrame:
    """One row per element of a computed array.

    From a plain explode the optimiser infers a filter on the array's size and evaluates the whole expression a second
    time below it; an outer one with its nulls dropped is evaluated once.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def is_ascii(c: str | Column) -> Column:
    """True where the string has ASCII characters alone; null stays null."""
    return ~F.col(c).rlike(r"[^\x00-\x7F]") if isinstance(c, str) else ~c.rlike(r"[^\x00-\x7F]")
