"""Anonymising tables and cells, output paths, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_in_cell(cell: Column, pairs: Column) -> Column:
    """Every literal occurrence of each original in order; what one replacement writes, a later one may replace."""
    return F.aggregate(pairs, cell, lambda text, p: F.when(p["original"] != "", F.replace(text, p["original"], p["replacement"])).otherwise(text))


def anonymise_columns(table: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Given columns as text with the pairs replaced in order; other columns stay."""

    def replaced(c: str) -> Column:
        text = F.col(c).cast("string")
        for original, replacement in pairs:
            text = F.replace(text, F.lit(original), F.lit(replacement))
        return text

    return table.withColumns({c: replaced(c) for c in columns})


def row_text(columns: list[str]) -> Column:
    """A row as one line, values with tabs between them, null as nothing."""
    return F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), "\t")


def output_path(path: Column, pattern: str = "{name}-covered.{ext}", directory: str | None = None) -> Column:
    """Where the covered file goes: beside the input or in ``directory``; a file without extension gets ``txt``."""
    folder, file = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(file, r"^.+\.([^.]*)$", 1)
    stem = F.when(file.rlike(r"^.+\.[^.]*$"), F.regexp_extract(file, r"^(.+)\.[^.]*$", 1)).otherwise(file)
    name = F.replace(F.replace(F.lit(pattern), F.lit("{name}"), stem), F.lit("{ext}"), F.when(file.rlike(r"^.+\.[^.]*$"), ext).otherwise(F.lit("txt")))
    return F.concat(F.lit(directory.rstrip("/") + "/") if directory else folder, name)


def report_json(path: Column, detections: Column) -> Column:
    """A file's detections as JSON."""
    item = lambda d: F.struct(d["entity_type"], d["matched_text"], d["rule_name"], d["start"], d["end"], d["context"])
    return F.to_json(F.struct(path.alias("file"), F.transform(detections, item).alias("detections")))


def batch_summary(files: DataFrame) -> DataFrame:
    """(status, files, detections) of ``files(error, accepted)``: error, skipped without anything accepted, or success."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("accepted", F.lit(0)) == 0, "skipped").otherwise("success")
    return files.groupBy(status.alias("status")).agg(F.count("*").alias("files"), F.coalesce(F.sum("accepted"), F.lit(0)).cast("bigint").alias("detections"))


def storage_usage(files: DataFrame) -> DataFrame:
    """(category, bytes) of ``files(path, length)``: models, logs, or configuration."""
    category = F.when(F.col("path").contains("/models/"), "models").when(F.col("path").contains("/logs/"), "logs").otherwise("config")
    return files.groupBy(category.alias("category")).agg(F.sum("length").alias("bytes"))
