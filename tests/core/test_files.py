import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.operators import tables
from maskwright.operators.resolve import MAPPING
from maskwright.sources import files

CELLS = [("People & co", 0, 0, "Jason Smith"), ("People & co", 0, 1, "jason@example.com"), ("People & co", 1, 0, "555-123-4567"), ("People & co", 1, 1, "<data>"), ("Empty", -1, -1, "")]


def test_workbook_round_trip():
    assert list(files.workbook_cells(files.write_workbook(CELLS))) == CELLS
    assert files.sheets_text(CELLS) == "--- Sheet: People & co ---\nJason Smith\tjason@example.com\n555-123-4567\t<data>\n\n--- Sheet: Empty ---\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("hällo")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.XLSX").write_bytes(files.write_workbook(CELLS))
    (tmp_path / "d.xlsx").write_bytes(b"no workbook")
    (tmp_path / "e.bmp").write_bytes(b"x")
    (tmp_path / "f.pdf").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.csv").write_text("1,2")
    return tmp_path


def test_listing(spark, folder):
    names = lambda df: [os.path.basename(r["path"]) for r in df.select("path").collect()]
    assert names(files.listed_paths(files.list_files(spark, str(folder)))) == ["a.txt", "b.md", "c.XLSX", "d.xlsx", "f.pdf"]
    assert names(files.listed_paths(files.list_files(spark, str(folder), True)))[-1] == "g.csv"
    assert names(files.list_files(spark, str(folder / "e.bmp"))) == ["e.bmp"]
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(folder / "none"))


def test_each_file_has_text_or_its_error(spark, folder):
    got = {os.path.basename(r["path"]): r for r in files.read_texts(files.list_files(spark, str(folder))).collect()}
    assert got["a.txt"]["text"] == "hällo" and got["a.txt"]["error"] is None
    assert got["b.md"]["text"] is None and "UnicodeDecodeError" in got["b.md"]["error"]
    assert got["c.XLSX"]["text"].startswith("--- Sheet: People") and got["d.xlsx"]["error"] and got["f.pdf"]["error"]


def test_cells(spark, folder):
    cells = files.read_cells(files.list_files(spark, str(folder)))
    assert cells.where("error IS NOT NULL").count() == 1 and cells.where("error IS NULL").count() == len(CELLS)
    pairs = F.array(*(F.struct(F.lit(a).alias("original"), F.lit(b).alias("replacement")) for a, b in [("Jason Smith", "A B"), ("jason@example.com", "x@example.com"), ("555-123-4567", "(555) 555-0000")]))
    out = [r[0] for r in cells.where("error IS NULL").select(tables.replace_in_cell(F.col("value"), pairs)).collect()]
    assert not {"Jason Smith", "jason@example.com", "555-123-4567"} & set(out)


def test_types_and_paths(spark):
    df = spark.createDataFrame([("/tmp/readme",), ("/tmp/a.b/x.PDF",), ("y.xls",)], "p string")
    assert [r[0] for r in df.select(files.file_type(F.col("p"))).collect()] == ["Text", "Pdf", "Xlsx"]
    assert [r[0] for r in df.select(tables.output_path(F.col("p"))).collect()] == ["/tmp/readme-covered.txt", "/tmp/a.b/x-covered.PDF", "y-covered.xls"]
    assert df.select(tables.output_path(F.col("p"), directory="/out/")).first()[0] == "/out/readme-covered.txt"


def test_stores(spark, tmp_path):
    path = str(tmp_path / "mappings.json")
    assert files.read_store(spark, path, MAPPING).count() == 0
    files.write_store(spark.createDataFrame([("a", "b", "PERSON", None, None)], MAPPING), path)
    assert json.load(open(path))[0]["original"] == "a" and files.read_store(spark, path, MAPPING).first()["replacement"] == "b"


def test_config_and_archive(tmp_path):
    c = files.Config.load(str(tmp_path / "none.json"))
    c.set("output_directory", "null"), c.set("model_update_check", "maybe"), c.set("ocr_language", "deu")
    assert (c.output_directory, c.model_update_check, c.ocr_language) == (None, True, "deu")
    with pytest.raises(KeyError):
        c.set("nope", "1")
    c.save(str(tmp_path / "s" / "config.json"))
    assert files.Config.load(str(tmp_path / "s" / "config.json")) == c
    assert files.export_archive(str(tmp_path / "s"), str(tmp_path / "x.zip")) == ["config.json"]
    with zipfile.ZipFile(tmp_path / "x.zip", "a") as z:
        z.writestr("../evil.json", "{}")
    assert files.import_archive(str(tmp_path / "x.zip"), str(tmp_path / "t")) == ["config.json"]
    assert not (tmp_path / "evil.json").exists()
