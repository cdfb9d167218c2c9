"""Redaction of PDF files page by page: render, read the words, find the originals, paint them over, set the covers.

Pages are rows, so a long file is worked on by many tasks; only the painted pages of one file, at most ``MAX_PAGES``, come
together to be put into one. Rendering and reading are parameters; by default an installed library and program do them.
"""

from __future__ import annotations

import io
import subprocess
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.pages import page_matches, redaction_box
from maskwright.sinks.pdf import MAX_PAGES, images_pdf, paint_boxes

#: Pixels of a rendered page at most, US letter at 300 dots an inch.
PAGE_PIXELS = (2550, 3300)

Words = list[tuple[str, int, int, int, int]]
PAGES = "path string, page int, width int, height int, pixels binary, words array<struct<text:string,x:int,y:int,w:int,h:int>>, error string"


def can_render() -> bool:
    return find_spec("pypdfium2") is not None


def render_pages(content: bytes) -> Iterator[np.ndarray]:
    """Grey images of the pages of a PDF file; needs an optional library."""
    import pypdfium2

    document = pypdfium2.PdfDocument(content)
    for page in document:
        scale = min(PAGE_PIXELS[0] / page.get_width(), PAGE_PIXELS[1] / page.get_height())
        yield np.squeeze(page.render(scale=scale, grayscale=True).to_numpy())


def tesseract_words(image: np.ndarray, language: str = "eng") -> Words:
    """Words with their boxes as an outside program reads them, as tab-separated values."""
    h, w = image.shape
    grey = b"P5 %d %d 255\n" % (w, h) + image.astype(np.uint8).tobytes()
    out = subprocess.run(["tesseract", "stdin", "stdout", "-l", language, "tsv"], input=grey, capture_output=True, check=True).stdout
    table = pd.read_csv(io.BytesIO(out), sep="\t", quoting=3, keep_default_na=False)
    words = table[(table["level"] == 5) & (table["text"].astype(str).str.strip() != "")]
    return [(str(r.text), int(r.left), int(r.top), int(r.width), int(r.height)) for r in words.itertuples()]


def read_pages(files: DataFrame, render: Callable[[bytes], Iterator[np.ndarray]] = render_pages, words: Callable[[np.ndarray], Words] = tesseract_words) -> DataFrame:
    """``PAGES`` of ``files(path, content)``: each page with its image and words; a file that can't be read, or has more than
    ``MAX_PAGES`` pages, gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PAGES.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, error = [], None
                try:
                    for i, image in enumerate(render(bytes(content))):
                        if i >= MAX_PAGES:
                            raise ValueError(f"more than {MAX_PAGES} pages")
                        found = [dict(zip(("text", "x", "y", "w", "h"), w)) for w in words(image)]
                        rows.append((path, i, image.shape[1], image.shape[0], image.astype(np.uint8).tobytes(), found, None))
                except Exception as e:  # per-file isolation
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(path, None, None, None, None, None, error)] if error else rows, columns=columns).astype({"page": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        painted = []
        for pixels, w, h, boxes in zip(pdf["pixels"], pdf["width"], pdf["height"], pdf["boxes"]):
            image = np.frombuffer(pixels, np.uint8).reshape(int(h), int(w))
            painted.append(paint_boxes(image, [(b["x"], b["y"], b["w"], b["h"]) for b in boxes]).tobytes())
        yield pdf.assign(pixels=painted)


def covered_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, page, width, height, pixels, boxes) of ``PAGES`` and ``pairs(path, pairs: array<struct<original, replacement>>)``.

    Every place of an original on a page is painted white and gets its replacement; pages without any stay as they are.
    """
    box = lambda w, p, at: F.struct(redaction_box(w, at, F.size(F.split(F.trim(p["original"]), r"(?U)\s+"))).alias("b"), p["replacement"].alias("text"))
    low = F.transform("words", lambda w: w["text"])
    found = F.flatten(F.transform("pairs", lambda p: F.transform(page_matches(low, p["original"]), lambda at: box(F.col("words"), p, at))))
    flat = F.transform(found, lambda f: F.struct(f["b"]["x"].alias("x"), f["b"]["y"].alias("y"), f["b"]["w"].alias("w"), f["b"]["h"].alias("h"), f["text"].alias("text")))
    none = F.array().cast("array<struct<x:int,y:int,w:int,h:int,text:string>>")
    good = pages.where("error IS NULL").join(pairs, "path", "left").select("path", "page", "width", "height", "pixels", F.coalesce(flat, none).alias("boxes"))
    return good.mapInPandas(_cover, "path string, page int, width int, height int, pixels binary, boxes array<struct<x:int,y:int,w:int,h:int,text:string>>")


def assembled(covered: DataFrame) -> DataFrame:
    """(path, content, boxes): one PDF file of each file's pages in order, and how many places were covered."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        images = [np.frombuffer(p, np.uint8).reshape(int(h), int(w)) for p, w, h in zip(pdf["pixels"], pdf["width"], pdf["height"])]
        covers = [[(b["x"], b["y"], b["w"], b["h"], b["text"]) for b in boxes] for boxes in pdf["boxes"]]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [images_pdf(images, covers)], "boxes": [sum(map(len, covers))]})

    return covered.groupBy("path").applyInPandas(one, "path string, content binary, boxes int")


def redact_pdfs(files: DataFrame, pairs: DataFrame, render: Callable = render_pages, words: Callable = tesseract_words) -> DataFrame:
    """(path, content, boxes, error) of ``files(path, content)``: covered files; those without pairs come out as they are."""
    with_pairs = pairs.where("size(pairs) > 0")
    pages = read_pages(files.join(with_pairs.select("path"), "path", "left_semi"), render, words)
    # a file that failed has no good page: its pages are given up when one of them can't be read
    done = assembled(covered_pages(pages, with_pairs)).withColumn("error", F.lit(None).cast("string"))
    failed = pages.where("error IS NOT NULL").select("path", F.lit(None).cast("binary").alias("content"), F.lit(0).alias("boxes"), "error")
    kept = files.join(with_pairs.select("path"), "path", "left_anti").select("path", "content", F.lit(0).alias("boxes"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(failed).unionByName(kept)
