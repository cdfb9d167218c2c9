"""Covered files one by one, beside or instead of tables: each task writes its own files to the folder all share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from maskwright.sinks.pdf import write_pdf
from maskwright.sources.files import write_workbook


def _put(path: str, content: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    scratch = f"{path}.part"
    with open(scratch, "wb") as f:
        f.write(content)
    os.replace(scratch, path)  # a repeated task leaves one whole file


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["output_path"], pdf["output_text"]):
            try:
                _put(path, write_pdf(text) if path.lower().endswith(".pdf") else text.encode("utf-8"))
                rows.append((path, "success", None))
            except Exception as e:  # per-file isolation
                rows.append((path, "error", f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["output_path", "status", "error"])


def write_texts(covered: DataFrame) -> DataFrame:
    """Writes ``covered(output_path, output_text)``, PDF files as pages; lazily gives (output_path, status, error).

    Null texts are left out. Reading the result does the writing; a file is complete or not there.
    """
    return covered.where("output_text IS NOT NULL").select("output_path", "output_text").mapInPandas(_write, "output_path string, status string, error string")


def write_contents(covered: DataFrame) -> DataFrame:
    """Writes ``covered(output_path, content)`` as it is; lazily gives (output_path, status, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["output_path"], pdf["content"]):
                try:
                    _put(path, bytes(content))
                    rows.append((path, "success", None))
                except Exception as e:  # per-file isolation
                    rows.append((path, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["output_path", "status", "error"])

    return covered.where("content IS NOT NULL").select("output_path", "content").mapInPandas(run, "output_path string, status string, error string")


def write_workbooks(cells: DataFrame) -> DataFrame:
    """Writes workbooks out of ``cells(output_path, sheet, row, col, value)``, each file in one group; formats are lost."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        path = pdf["output_path"].iloc[0]
        try:
            _put(path, write_workbook(list(pdf.sort_values(["sheet", "row", "col"])[["sheet", "row", "col", "value"]].itertuples(index=False, name=None))))
            return pd.DataFrame([(path, "success", None)], columns=["output_path", "status", "error"])
        except Exception as e:  # per-file isolation
            return pd.DataFrame([(path, "error", f"{type(e).__name__}: {e}")], columns=["output_path", "status", "error"])

    return cells.where("value IS NOT NULL").groupBy("output_path").applyInPandas(one, "output_path string, status string, error string")
