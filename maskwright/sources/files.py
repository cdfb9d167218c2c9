"""Files as rows: listing, types, text extraction with one error per file, spreadsheets as cells, stores, archives."""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.pages import DOUBLED, PAGE_BREAK

#: Extensions of files that are collected, and of those that aren't plain text by type.
SUPPORTED = "txt md csv pdf xlsx xls png jpg jpeg tiff tif".split()
FILE_TYPES = {"Pdf": ["pdf"], "Xlsx": ["xlsx", "xls"], "Image": "png jpg jpeg tiff tif bmp".split()}
#: Files of the storage folder that an archive may hold.
ARCHIVED = ("config.json", "mappings.json", "custom-rules.json")
IGNORE_LIST = "ignore-list.json"

TEXT_ROWS = "path string, doc_type string, text string, error string"
CELL_ROWS = "path string, sheet string, row int, col int, value string, error string"


def extension_of(path: Column) -> Column:
    """Lower-case extension, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension_of(path).isin(*SUPPORTED)


def file_type(path: Column) -> Column:
    """Pdf, Xlsx or Image by extension, Text for all others."""
    kind = F.lit("Text")
    for name, extensions in FILE_TYPES.items():
        kind = F.when(extension_of(path).isin(*extensions), name).otherwise(kind)
    return kind


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files under ``path`` as (path, modificationTime, length, content); a single file is taken whatever its type.

    A missing path raises. The content is only read by queries that use it. The rows aren't sorted, as that would move
    the content of all files: whoever needs an order sorts paths, see ``listed_paths``.
    """
    local = path.removeprefix("file://")
    if "://" not in path and not os.path.exists(local):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if "://" not in path and os.path.isfile(local):
        return files
    return files.where(is_supported(F.col("path")))


def listed_paths(files: DataFrame) -> DataFrame:
    """(path, length), in order of path; the content isn't read."""
    return files.select("path", "length").orderBy("path")


#: Folders of the system that are no input, by the beginning of their path.
BLOCKED = ("/etc", "/usr", "/System", "/Library", "/bin", "/sbin", "/dev", "/proc", "/sys", "/boot")


def validate_path(path: str) -> str:
    """The path, if it is a supported file or a folder outside the system's folders; raises what is wrong with it."""
    real = os.path.realpath(path)
    if any(real == b or real.startswith(f"{b}/") for b in BLOCKED):
        raise PermissionError(f"{path} lies in a folder of the system")
    if not os.path.exists(real):
        raise FileNotFoundError(path)
    if os.path.isfile(real) and os.path.splitext(real)[1].lower().removeprefix(".") not in SUPPORTED:
        raise ValueError(f"{path} has no supported type")
    return path


# ---- spreadsheets -------------------------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of a workbook, every value as a string; empty sheets yield one cell at (-1, -1)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets.get(sheet.get(f"{_REL}id"), "").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            count = 0
            if part in names:
                for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                    for cell in row.iter(f"{_MAIN}c"):
                        kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                        elif v is None:
                            continue
                        else:
                            value = shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if kind == "b" else v.text or ""
                        yield sheet.get("name"), int(re.search(r"\d+", cell.get("r")).group()) - 1, _column_index(cell.get("r")), value
                        count += 1
            if not count:
                yield sheet.get("name"), -1, -1, ""


def sheets_text(cells: list[tuple[str, int, int, str]]) -> str:
    """Sheets as text: a heading each, rows with tabs between the columns of the used range, a blank line in between."""
    out = []
    for sheet in dict.fromkeys(c[0] for c in cells):
        own = {(r, c): v for s, r, c, v in cells if s == sheet and r >= 0}
        rows, cols = sorted({r for r, _ in own}), sorted({c for _, c in own})
        body = "".join("\t".join(own.get((r, c), "") for c in range(cols[0], cols[-1] + 1)) + "\n" for r in range(rows[0], rows[-1] + 1)) if own else ""
        out.append(f"--- Sheet: {sheet} ---\n{body}")
    return "\n".join(out)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows += [(path, *cell, None) for cell in workbook_cells(bytes(content))]
            except Exception as e:  # one unreadable file is a row, not the end of the job
                rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value", "error"]).astype({"row": "Int32", "col": "Int32"})


def read_cells(files: DataFrame) -> DataFrame:
    """Cells of all workbooks among ``files(path, content)``; a file that can't be read gives one row with its error."""
    return files.where(file_type(F.col("path")) == "Xlsx").select("path", "content").mapInPandas(_cells, CELL_ROWS)


def write_workbook(cells: list[tuple[str, int, int, str]]) -> bytes:
    """A workbook of string cells."""
    from xml.sax.saxutils import escape, quoteattr

    def ref(r: int, c: int) -> str:
        letters, n = "", c + 1
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(65 + k) + letters
        return f"{letters}{r + 1}"

    sheets = list(dict.fromkeys(c[0] for c in cells)) or ["Sheet1"]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel, pack = _MAIN[1:-1], _REL[1:-1], "http://schemas.openxmlformats.org/package/2006"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, s in enumerate(sheets, 1):
            rows: dict[int, list[tuple[int, str]]] = {}
            for name, r, c, v in cells:
                if name == s and r >= 0:
                    rows.setdefault(r, []).append((c, v))
            body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in sorted(rows[r])) + "</row>" for r in sorted(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


# ---- text of any file ---------------------------------------------------------------------------------------------


def available(tool: str) -> bool:
    """An outside program is on this machine."""
    return shutil.which(tool) is not None


def _image_text(content: bytes, language: str) -> str:
    if not available("tesseract"):
        raise RuntimeError("tesseract isn't installed")
    with tempfile.NamedTemporaryFile() as f:  # scratch of one call, read back in the same task
        f.write(content)
        f.flush()
        done = subprocess.run(["tesseract", f.name, "stdout", "-l", language], capture_output=True, check=True)
    return done.stdout.decode("utf-8")


#: Lines of single letters that begin the next word, as some documents yield them, in Python's dialect.
_DOUBLED = re.compile(DOUBLED.replace(r"\z", r"\Z"))


def _pdf_text(content: bytes, language: str) -> str:
    """Text of the rendered and read pages where that can be done and yields any, else the text layer; then cleaned up."""
    from maskwright.sinks import redaction

    if redaction.can_render() and available("tesseract"):
        pages = [" ".join(w[0] for w in redaction.tesseract_words(image, language)) for image in redaction.render_pages(content)]
        if any(p.strip() for p in pages):
            return _DOUBLED.sub("", PAGE_BREAK.join(p.strip() for p in pages))
    try:
        import pypdf
    except ImportError:
        from maskwright.sinks.pdf import pdf_text

        text = pdf_text(content)
    else:
        text = "\n".join(page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages)
    return _DOUBLED.sub("", text)


def capabilities() -> dict[str, bool]:
    """What this machine can do beyond plain text, workbooks and simple PDF files."""
    from importlib.util import find_spec

    return {"ocr": available("tesseract"), "pdf_render": find_spec("pypdfium2") is not None, "pdf_library": find_spec("pypdf") is not None, "onnx": find_spec("onnxruntime") is not None}


def extract_text(content: bytes, kind: str, language: str = "eng") -> str:
    """Text of one file; raises what is wrong with it. Plain text must be valid UTF-8."""
    if kind == "Xlsx":
        return sheets_text(list(workbook_cells(content)))
    if kind == "Image":
        return _image_text(content, language)
    if kind == "Pdf":
        return _pdf_text(content, language)
    return content.decode("utf-8")


def read_texts(files: DataFrame, language: str = "eng") -> DataFrame:
    """(path, doc_type, text, error) of ``files(path, content)``; an unreadable file has its error and a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["path"], pdf["doc_type"], pdf["content"]):
                try:
                    rows.append((path, kind, extract_text(bytes(content), kind, language), None))
                except Exception as e:  # per-file isolation
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "doc_type", "text", "error"])

    return files.select("path", file_type(F.col("path")).alias("doc_type"), "content").mapInPandas(run, TEXT_ROWS)


# ---- stores and settings ------------------------------------------------------------------------------------------


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store kept as one JSON array; a missing file is an empty store."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_store(rows: DataFrame, path: str) -> int:
    """A store as one JSON array, written by one task as its rows stream by; gives their number.

    For stores that a person edits, which are one file by their nature. Larger ones are written as tables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scratch, n = f"{path}.new", 0
        with open(scratch, "w", encoding="utf-8") as f:
            f.write("[")
            for pdf in batches:
                for record in pdf["record"]:
                    f.write(("," if n else "") + "\n  " + record)
                    n += 1
            f.write("\n]\n" if n else "]\n")
        os.replace(scratch, path)
        yield pd.DataFrame({"n": [n]})

    records = rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))
    return records.repartition(1).mapInPandas(run, "n bigint").first()[0]


@dataclass
class Config:
    output_pattern: str = "{name}-covered.{ext}"
    output_directory: str | None = None
    model_version: str = "latest"
    model_update_check: bool = True
    ocr_language: str = "eng"

    @classmethod
    def load(cls, path: str) -> Config:
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            return cls(**{k: v for k, v in json.load(f).items() if k in cls.__dataclass_fields__})

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)

    def set(self, key: str, value: str) -> None:
        """Sets a key from text: a boolean that is no boolean is true, an empty or "null" directory is none."""
        if key not in self.__dataclass_fields__:
            raise KeyError(key)
        if key == "model_update_check":
            setattr(self, key, value != "false")
        elif key == "output_directory":
            self.output_directory = None if value in ("", "null") else value
        else:
            setattr(self, key, value)


def export_archive(folder: str, archive: str) -> list[str]:
    """Zips the known files of a storage folder; returns their names."""
    names = [n for n in ARCHIVED if os.path.exists(os.path.join(folder, n))]
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(os.path.join(folder, n), n)
    return names


def import_archive(archive: str, folder: str) -> list[str]:
    """Unpacks the known files only, whatever else or wherever else the archive points to; returns their names."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        names = [n for n in ARCHIVED if n in z.namelist()]
        for n in names:
            with open(os.path.join(folder, n), "wb") as f:
                f.write(z.read(n))
    return names


def log_bundle(folder: str, archive: str) -> list[str]:
    """Zips the logs of a storage folder with a list of all its files and their sizes; returns the names in the archive."""
    sizes = {os.path.relpath(os.path.join(at, n), folder): os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names}
    logs = sorted(n for n in sizes if n.endswith(".log") or n.startswith(f"logs{os.sep}"))
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for n in logs:
            z.write(os.path.join(folder, n), n)
        z.writestr("files.json", json.dumps({"files": sizes, "capabilities": capabilities()}, indent=2, sort_keys=True))
    return [*logs, "files.json"]
