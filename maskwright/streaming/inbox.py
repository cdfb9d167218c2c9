"""The pipeline over a stream of documents: all detection is narrow, so it runs on micro-batches as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskwright.operators.resolve import upsert_mappings
from maskwright.plans.pipeline import anonymise
from maskwright.runtime import exploded


def read_inbox(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def anonymise_stream(documents: DataFrame, text: str = "text") -> DataFrame:
    return anonymise(documents, text)


def detection_counts(detected: DataFrame, time: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window_start, entity_type, detections) over event time; rows later than the watermark are dropped by the engine."""
    rows = exploded(detected.withWatermark(time, late), [time], F.col("detections"))
    return rows.groupBy(F.window(time, window).start.alias("window_start"), F.col("d.entity_type").alias("entity_type")).agg(F.count("*").alias("detections"))


#: Parts of a kept mapping table.
BUCKETS = 64
_STORE = "original string, replacement string, entity_type string, created timestamp, last_used timestamp, bucket int, v long"


def _versions(spark: SparkSession, folder: str, until: int | None = None) -> dict[int, int]:
    """Latest version of each part, not above ``until``; by the names of at most ``BUCKETS`` times a few folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket=*/v=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    latest: dict[int, int] = {}
    for status in found:
        at = status.getPath()
        bucket, v = int(at.getParent().getName().split("=")[1]), int(at.getName().split("=")[1])
        if until is None or v <= until:
            latest[bucket] = max(v, latest.get(bucket, -1))
    return latest


def read_mappings(spark: SparkSession, folder: str, until: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The mapping table kept by ``keep_mappings``: the latest version of each part."""
    latest = {b: v for b, v in _versions(spark, folder, until).items() if buckets is None or b in buckets}
    if not latest:
        return spark.createDataFrame([], _STORE).drop("bucket", "v")
    paths = [f"{folder}/bucket={b}/v={v}" for b, v in sorted(latest.items())]
    return spark.read.schema(_STORE).option("basePath", folder).parquet(*paths).drop("bucket", "v")


def keep_mappings(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Upserts each micro-batch ``(original, replacement, entity_type, ord)`` into a mapping table of ``BUCKETS`` parts.

    Only parts that the batch touches are written again, as version n + 1 of batch n beside their last one, so a repeated
    batch overwrites its own result; the version before stays for it, older ones of these parts are deleted.
    """
    part = F.pmod(F.xxhash64("original"), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        used = batch.where("original IS NOT NULL")
        touched = sorted(r[0] for r in used.select(part.alias("b")).distinct().collect())
        if not touched:
            return
        before = {b: v for b, v in _versions(spark, folder, n).items() if b in touched}
        new = upsert_mappings(read_mappings(spark, folder, n, touched), used).withColumn("bucket", part).withColumn("v", F.lit(n + 1))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(folder)
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for b, v in before.items():
            for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={b}/v=*")):
                if int(status.getPath().getName().split("=")[1]) < v:
                    fs.delete(status.getPath(), True)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
