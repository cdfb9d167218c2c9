import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import cli
from maskwright.operators import models
from maskwright.plans.pipeline import anonymise
from maskwright.sinks import pdf
from maskwright.sinks.files import write_texts, write_workbooks
from maskwright.sources import files
from tests.core.test_pipeline import SAMPLE


@pytest.mark.parametrize("text", ["", "one line", "(brackets) and \\ back\n" * 60, "é ü", "x" * 400])
def test_pdf_round_trip(text):
    want = "\n".join("\n".join(page) for page in pdf.page_lines(text))
    assert pdf.pdf_text(pdf.write_pdf(text)) == want.strip("\n") if text.strip() else pdf.pdf_text(pdf.write_pdf(text)) == ""


def test_no_pdf():
    with pytest.raises(ValueError):
        pdf.pdf_text(b"plain")


def test_covered_pdf_has_no_original(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.pdf").write_bytes(pdf.write_pdf(SAMPLE))
    texts = files.read_texts(files.list_files(spark, str(tmp_path / "in")))
    out = anonymise(texts).select(F.lit(str(tmp_path / "out" / "s.pdf")).alias("output_path"), "output_text")
    assert [tuple(r) for r in write_texts(out).collect()] == [(str(tmp_path / "out" / "s.pdf"), "success", None)]
    text = pdf.pdf_text((tmp_path / "out" / "s.pdf").read_bytes())
    assert "219-45-8830" not in text and "Her SSN is 900-" in text and "Whitcombe" not in text


def test_images():
    page = np.zeros((30, 20), np.uint8)
    painted = pdf.paint_boxes(page, [(2, 3, 5, 4), (-5, -5, 7, 7), (18, 28, 50, 50)])
    assert painted[3:7, 2:7].min() == 255 and painted[:2, :2].min() == 255 and page.max() == 0 and painted[10, 10] == 0
    assert pdf.images_pdf([page, painted]).count(b"/Subtype /Image") == 2
    assert pdf.text_size(100, 6000, 5) == 85 and pdf.text_size(100, 10, 50) == 24


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(str(tmp_path / "a" / "b.txt"), "hällo"), (str(tmp_path / "c.txt"), None)], "output_path string, output_text string")
    assert write_texts(df).where("status = 'success'").count() == 1 and (tmp_path / "a" / "b.txt").read_text() == "hällo"
    cells = spark.createDataFrame([(str(tmp_path / "d.xlsx"), "S", 0, 0, "v"), (str(tmp_path / "d.xlsx"), "S", 1, 2, "w")], "output_path string, sheet string, row int, col int, value string")
    assert write_workbooks(cells).collect()[0]["status"] == "success"
    assert list(files.workbook_cells((tmp_path / "d.xlsx").read_bytes())) == [("S", 0, 0, "v"), ("S", 1, 2, "w")]


def test_models(spark, tmp_path):
    assert models.model_status(str(tmp_path)) == {"installed": False, "version": None, "bytes": 0}
    df = spark.createDataFrame([("John Smith",)], "text string")
    assert df.select(models.onnx_detector(str(tmp_path))(F.col("text"))).first()[0] == []
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {"1": "B-PER", "0": "O", "10": "x"}}))
    assert models.label_map(str(tmp_path)) == ["O", "B-PER", "x"]
    assert models.last_argmax(np.array([[1, 3, 3], [2, 1, 0]])).tolist() == [2, 0]


def test_classifier(spark):
    d = spark.createDataFrame([("a", "T", "c"), ("b", "T", "c"), ("c", "T", "c")], "matched_text string, entity_type string, context string")
    answers = {"a": "it is PUBLIC", "b": "Personal", "c": "no idea"}
    assert sorted(r[0] for r in models.keep_personal(d, lambda p: [answers[t] for t in p["matched_text"]]).collect()) == ["b", "c"]
    assert models.keep_personal(d, lambda p: 1 / 0).count() == models.keep_personal(d).count() == 3


def run(capsys, *argv):
    assert cli.main([*argv, "--json"]) == 0
    return json.loads(capsys.readouterr().out)


def test_commands(spark, tmp_path, capsys):
    keep, data = ("--folder", str(tmp_path / "store")), tmp_path / "data"
    data.mkdir()
    (data / "s.txt").write_text(SAMPLE)
    assert len(run(capsys, *keep, "mappings", "add", "--original", "Owen Whitcombe", "--replacement", "Someone Else")) == 1
    assert run(capsys, *keep, "ignore", "add", "--text", "CLARA whitcombe")[0]["text"] == "CLARA whitcombe"
    assert run(capsys, *keep, "ignore", "add", "--text", "Clara Whitcombe")[0]["text"] == "CLARA whitcombe"
    assert run(capsys, *keep, "rules", "add", "--name", "r", "--type", "X", "--pattern", "clinic") == ["r"]
    assert run(capsys, *keep, "rules", "test", "--pattern", r"\d+", "--text", "a 12")[0]["matched_text"] == "12"
    found = run(capsys, *keep, "scan", str(data))
    kinds = [d["entity_type"] for d in found[0]["detections"]]
    assert "X" in kinds and "SSN" in kinds and not any(d["matched_text"] == "Clara Whitcombe" for d in found[0]["detections"])
    done = run(capsys, *keep, "process", str(data), "--auto-accept")
    assert done["files_processed"] == 1 and done["total_detections"] == done["accepted"] + 3
    text = open(done["output_files"][0]).read()
    assert os.path.basename(done["output_files"][0]) == "s-covered.txt" and "where Someone Else and" in text and "Clara Whitcombe" in text
    assert any(m["original"] == "219-45-8830" for m in run(capsys, *keep, "mappings", "list"))
    assert run(capsys, *keep, "config", "set", "ocr_language", "deu")["ocr_language"] == "deu"
    assert run(capsys, *keep, "ignore", "clear") == []


def test_workbooks_stay_workbooks(spark, tmp_path, capsys):
    keep, data = ("--folder", str(tmp_path / "store")), tmp_path / "data"
    data.mkdir()
    cells = [("People", 0, 0, "Name"), ("People", 0, 1, "Mail"), ("People", 1, 0, "see Ann Lee"), ("People", 1, 1, "a.lee@mail.example"), ("Plain", 0, 0, "nothing")]
    (data / "a.xlsx").write_bytes(files.write_workbook(cells))
    (data / "b.png").write_bytes(b"no image")
    done = run(capsys, *keep, "process", str(data), "--auto-accept")
    assert [os.path.basename(p) for p in done["output_files"]] == ["a-covered.xlsx"]
    got = list(files.workbook_cells((data / "a-covered.xlsx").read_bytes()))
    assert [c[:3] for c in got] == [c[:3] for c in cells] and got[0] == cells[0] and got[4] == cells[4]
    assert got[3][3].endswith("@example.com") and got[3][3] != cells[3][3]


def test_review(spark, tmp_path, capsys):
    import io

    data = tmp_path / "data"
    data.mkdir()
    (data / "a.txt").write_text("write to a@x.example or b@x.example or c@x.example or d@x.example")
    (data / "b.txt").write_text("write to b@x.example or e@x.example or f@x.example")
    args = cli.argparse.Namespace(folder=str(tmp_path / "store"), path=str(data), recursive=False, auto_accept=False, quiet=True)
    done = cli.process(args, io.StringIO("y\ni\ne\nhidden@x.example\nn\na\n"))
    assert done["accepted"] == 4 and done["total_detections"] == 7
    assert (data / "a-covered.txt").read_text().split(" or ")[1:] == ["b@x.example", "hidden@x.example", "d@x.example"]
    assert "write to b@x.example or" in (data / "b-covered.txt").read_text() and "f@x.example" not in (data / "b-covered.txt").read_text()
    assert [e["text"] for e in run(capsys, "--folder", str(tmp_path / "store"), "ignore", "list")] == ["b@x.example"]
    stopped = cli.process(cli.argparse.Namespace(**vars(args) | {"folder": str(tmp_path / "other")}), io.StringIO("y\nq\n"))
    assert stopped["accepted"] == 1


def test_text_output_and_models(spark, tmp_path, capsys):
    folder = ("--folder", str(tmp_path))
    assert cli.main([*folder, "config", "show"]) == 0 and "ocr_language: eng" in capsys.readouterr().out
    assert run(capsys, *folder, "model", "status")["installed"] is False and run(capsys, *folder, "smart-detection", "path").endswith("classifier")
    with pytest.raises(SystemExit):
        cli.main([*folder, "model", "download"])
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run.log").write_text("x")
    assert run(capsys, *folder, "config", "logs", str(tmp_path / "bundle.zip")) == [os.path.join("logs", "run.log"), "files.json"]


def test_paths_that_are_no_input(tmp_path):
    (tmp_path / "a.exe").write_text("x")
    for path, error in (("/etc/passwd", PermissionError), (str(tmp_path / "none"), FileNotFoundError), (str(tmp_path / "a.exe"), ValueError)):
        with pytest.raises(error):
            files.validate_path(path)
    assert files.validate_path(str(tmp_path)) == str(tmp_path)


def test_prompting_classifier(spark):
    d = spark.createDataFrame([("a", "T", "c"), ("b", "T", "c"), ("c", "T", "c")], "matched_text string, entity_type string, context string")
    seen = models.prompt_of("Ann Lee", "PERSON", "near Ann Lee")
    assert "'Ann Lee'" in seen and "near Ann Lee" in seen

    def load():
        def generate(prompt, at_most):
            assert at_most == 10
            return "PUBLIC" if "'a'" in prompt else 1 / 0 if "'b'" in prompt else "PERSONAL"

        return generate

    assert sorted(r[0] for r in models.keep_personal(d, load=models.prompting(load)).collect()) == ["b", "c"]
    assert models.keep_personal(d, load=lambda: 1 / 0).count() == 3


def test_redaction_of_pages(spark):
    """Pages by a renderer and a reader of our own: a file is a letter for each page, a page one word a line."""
    from maskwright.sinks import redaction

    def render(content):
        if content == b"bad":
            raise ValueError("broken")
        for c in content.decode():
            yield np.full((200, 300), ord(c), np.uint8)

    def words(image):
        return [("Ann", 10, 10, 40, 20), ("Lee", 60, 10, 40, 20), (chr(int(image[199, 299])), 10, 100, 20, 20)]

    held = spark.createDataFrame([("a.pdf", b"xy"), ("b.pdf", b"bad"), ("c.pdf", b"z"), ("d.pdf", b"p" * 501)], "path string, content binary")
    pairs = spark.createDataFrame([("a.pdf", [("ann LEE", "Someone"), ("y", "(z)")]), ("b.pdf", [("x", "q")]), ("c.pdf", []), ("d.pdf", [("x", "q")])], "path string, pairs array<struct<original:string,replacement:string>>")
    got = {r["path"]: r for r in redaction.redact_pdfs(held, pairs, render, words).collect()}
    assert got["a.pdf"]["boxes"] == 3 and got["a.pdf"]["content"].count(b"/Subtype /Image") == 2
    assert pdf.pdf_text(bytes(got["a.pdf"]["content"])).split("\n") == ["Someone", "Someone", "(z)"]
    assert "broken" in got["b.pdf"]["error"] and "500 pages" in got["d.pdf"]["error"] and bytes(got["c.pdf"]["content"]) == b"z"
    page = redaction.covered_pages(redaction.read_pages(held.where("path = 'a.pdf'"), render, words), pairs).where("page = 0").first()
    image = np.frombuffer(page["pixels"], np.uint8).reshape(200, 300)
    assert image[6:34, 6:104].min() == 255 and image[100, 15] == ord("x")
