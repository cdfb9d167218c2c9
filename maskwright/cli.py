"""Command line: scan and process files, keep mappings, rules, ignored texts and settings."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from datetime import datetime, timezone
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import models, names, resolve
from maskwright.operators.rules import Rule, RuleStore, active_rules, test_pattern
from maskwright.operators.spans import apply_replacements
from maskwright.operators.tables import output_path, replace_in_cell
from maskwright.plans.pipeline import detect, detection_rows
from maskwright.runtime import cut, exploded, get_spark
from maskwright.sinks import redaction
from maskwright.sinks.files import write_contents, write_texts, write_workbooks
from maskwright.sources import files

MAPPINGS, RULES, IGNORED, CONFIG = "mappings.json", "custom-rules.json", files.IGNORE_LIST, "config.json"
MODELS = {"model": "models/names", "smart-detection": "models/classifier"}


def _records(folder: str, name: str) -> list[dict]:
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _keep(folder: str, name: str, records: list[dict]) -> None:
    os.makedirs(folder, mode=0o700, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(records, f, indent=2, ensure_ascii=False)


def _rules(folder: str) -> tuple[Rule, ...]:
    return tuple(Rule(r["name"], r["entity_type"], r["pattern"], r.get("description", ""), r.get("enabled", True)) for r in _records(folder, RULES))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _note(args: argparse.Namespace, text: str) -> None:
    if not args.quiet:
        print(text, file=sys.stderr)


def _detected(args: argparse.Namespace, texts: DataFrame) -> DataFrame:
    """Detections of texts by the rules in force, names by the word list of the settings or else that of the texts."""
    given = os.path.join(args.folder, "common-words.txt")
    common = names.word_list(given) if os.path.exists(given) else names.fitted_words(texts)
    return detect(texts, rules=active_rules(_rules(args.folder)), detectors=[models.onnx_detector(os.path.join(args.folder, MODELS["model"])), names.dictionary_detector(common)])


def scan(args: argparse.Namespace) -> object:
    """Detections of files, ignored texts left out; a file that can't be read is reported and the others go on.

    One object for a single file, a list for several, an empty list for none.
    """
    spark = get_spark()
    texts = cut(files.read_texts(files.list_files(spark, files.validate_path(args.path), args.recursive), files.Config.load(os.path.join(args.folder, CONFIG)).ocr_language))
    for r in texts.where("error IS NOT NULL").select("path", "error").toLocalIterator():
        _note(args, f"{r['path']}: {r['error']}")
    good = texts.where("error IS NULL")
    found = detection_rows(_detected(args, good), ["path"])
    ignored = files.read_store(spark, os.path.join(args.folder, IGNORED), resolve.IGNORED)
    rows = resolve.drop_ignored(found, ignored).orderBy("path", "start").toLocalIterator()
    out: dict[str, list[dict]] = {r["path"]: [] for r in good.select("path").orderBy("path").toLocalIterator()}
    for r in rows:
        out[r["path"]].append({k: r[k] for k in ("entity_type", "matched_text", "rule_name", "start", "end", "context")})
    report = [{"file": p, "detections": d} for p, d in out.items()]
    return report[0] if len(report) == 1 and os.path.isfile(args.path) else report


def review(args: argparse.Namespace, resolved: DataFrame, ignored: list[dict], answers: TextIO) -> DataFrame:
    """Decisions (path, start, action, replacement) of a person, one detection at a time in order of file and place.

    y or nothing accepts, e takes another replacement from the next line, n rejects, i rejects and ignores the text in all
    files that follow, a accepts this and all others, q or the end of input stops; what is accepted by then is written.
    """
    said: list[tuple] = []
    listed = {e["text"].lower() for e in ignored}
    every, last, fresh = False, None, set()
    for r in resolved.orderBy("path", "start").select("path", "start", "matched_text", "entity_type", "replacement").toLocalIterator():
        if r["path"] != last:
            last, listed, fresh = r["path"], listed | fresh, set()
        if r["matched_text"].lower() in listed:
            continue
        action, other = "accept", None
        if not every:
            _note(args, f"{r['path']} at {r['start']}: {r['entity_type']} {r['matched_text']!r} -> {r['replacement']!r} [y/e/n/i/a/q]")
            line = answers.readline()
            answer = line.strip().lower() or ("y" if line else "q")
            if answer == "q":
                break
            every = answer == "a"
            if answer == "e":
                action, other = "edit", answers.readline().rstrip("\r\n") or None
            elif answer in ("n", "i"):
                action = "reject"
                if answer == "i":
                    fresh.add(r["matched_text"].lower())
                    ignored.append({"text": r["matched_text"], "entity_type": r["entity_type"], "created": _now(), "reason": "review"})
        said.append((r["path"], r["start"], action, other))
    return resolved.sparkSession.createDataFrame(said, "path string, start int, action string, replacement string")


def _written(spark: SparkSession, listed: DataFrame, texts: DataFrame, accepted: DataFrame, config: files.Config) -> DataFrame:
    """Writes each file with something accepted in its own kind: (output_path, status, error)."""
    spans = accepted.groupBy("path").agg(F.collect_list(F.struct("start", "end", "replacement", F.lit(True).alias("accepted"))).alias("spans"))
    pairs = accepted.groupBy("path").agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.length("matched_text")).alias("n"), F.col("matched_text").alias("original"), "replacement"))), lambda p: F.struct(p["original"], p["replacement"])).alias("pairs"))
    target = output_path(F.regexp_replace("path", "^file:", ""), config.output_pattern, config.output_directory).alias("output_path")
    kind = F.col("doc_type")
    paged = redaction.can_render() and files.available("tesseract")
    plain = texts.where((kind == "Text") | ((kind == "Pdf") & F.lit(not paged))).join(spans, "path").select(target, apply_replacements(F.col("text"), F.col("spans")).alias("output_text"))
    cells = files.read_cells(listed).where("error IS NULL").join(pairs, "path").select(target, "sheet", "row", "col", replace_in_cell(F.col("value"), F.col("pairs")).alias("value"))
    images = texts.where(kind == "Image").join(spans.select("path"), "path", "left_semi").select(target, F.lit("error").alias("status"), F.lit("an image can't be written as text").alias("error"))
    done = write_texts(plain).unionByName(write_workbooks(cells)).unionByName(images)
    if paged:
        pages = redaction.redact_pdfs(listed.where(files.file_type(F.col("path")) == "Pdf").join(pairs.select("path"), "path", "left_semi").select("path", "content"), pairs)
        done = done.unionByName(write_contents(pages.select(target, "content"))).unionByName(pages.where("error IS NOT NULL").select(target, F.lit("error").alias("status"), "error"))
    return done


def process(args: argparse.Namespace, answers: TextIO | None = None) -> dict:
    """Covers files, keeps the mappings used, writes the covered files: texts as text, workbooks as workbooks, PDF files as pages.

    With ``--auto-accept`` all detections are accepted, else each is reviewed.
    """
    spark = get_spark()
    config = files.Config.load(os.path.join(args.folder, CONFIG))
    listed = files.list_files(spark, files.validate_path(args.path), args.recursive)
    texts = cut(files.read_texts(listed, config.ocr_language))
    good = texts.where("error IS NULL")
    found = cut(exploded(_detected(args, good), ["path"], F.col("detections")).select("path", "d.*"))
    store = files.read_store(spark, os.path.join(args.folder, MAPPINGS), resolve.MAPPING)
    ignored = files.read_store(spark, os.path.join(args.folder, IGNORED), resolve.IGNORED)
    resolved = cut(resolve.resolve(resolve.drop_ignored(found, ignored), resolve.current_mappings(store)))
    accepted = resolved
    if not args.auto_accept:
        kept = _records(args.folder, IGNORED)
        said = review(args, resolved, kept, answers or sys.stdin)
        _keep(args.folder, IGNORED, kept)
        keyed = lambda d: d.withColumn("det_key", F.struct("path", "start"))
        accepted = cut(resolve.decide(keyed(resolved), keyed(said)).where("accepted").drop("det_key"))
    done = cut(_written(spark, listed, good, accepted, config))
    used = accepted.select(F.col("matched_text").alias("original"), "replacement", "entity_type", F.struct("path", "start").alias("ord"))
    os.makedirs(args.folder, mode=0o700, exist_ok=True)
    files.write_store(cut(resolve.upsert_mappings(store, used)), os.path.join(args.folder, MAPPINGS))
    for r in done.where("status = 'error'").toLocalIterator():
        _note(args, f"{r['output_path']}: {r['error']}")
    counts = {k: d.count() for k, d in (("files_processed", good), ("total_detections", found), ("accepted", accepted))}
    return counts | {"output_files": [r["output_path"] for r in done.where("status = 'success'").orderBy("output_path").toLocalIterator()]}


def mappings(args: argparse.Namespace) -> object:
    held = _records(args.folder, MAPPINGS)
    if args.action == "add":
        old = next((m for m in held if m["original"] == args.original), {})
        held = [m for m in held if m["original"] != args.original] + [{"original": args.original, "replacement": args.replacement, "entity_type": args.type, "created": old.get("created", _now()), "last_used": _now()}]
        _keep(args.folder, MAPPINGS, held)
    elif args.action == "remove":
        _keep(args.folder, MAPPINGS, held := [m for m in held if m["original"] != args.original])
    return held


def rules(args: argparse.Namespace) -> object:
    store = RuleStore(_rules(args.folder))
    if args.action == "test":
        spark = get_spark()
        row = spark.createDataFrame([(args.text,)], "text string").select(test_pattern(F.col("text"), args.pattern).alias("d")).first()
        return [{"matched_text": d["matched_text"], "start": d["start"], "end": d["end"]} for d in row["d"]]
    if args.action == "add":
        get_spark()
        store.add(Rule(args.name, args.type, args.pattern))
    elif args.action == "remove":
        store.remove(args.name)
    if args.action in ("add", "remove"):
        _keep(args.folder, RULES, [{"name": r.name, "description": r.description, "pattern": r.pattern, "entity_type": r.entity_type, "enabled": r.enabled, "built_in": False, "created": _now()} for r in store.list()])
    return [r.__dict__ for r in (*active_rules(), *store.list())] if args.action == "list" else [r.name for r in store.list()]


def ignore(args: argparse.Namespace) -> object:
    held = _records(args.folder, IGNORED)
    known = {e["text"].lower() for e in held}
    if args.action == "add" and args.text.lower() not in known:
        held.append({"text": args.text, "entity_type": args.type, "created": _now(), "reason": args.reason})
    elif args.action == "remove":
        held = [e for e in held if e["text"].lower() != args.text.lower()]
    elif args.action == "clear":
        held = []
    if args.action != "list":
        _keep(args.folder, IGNORED, held)
    return held


def config(args: argparse.Namespace) -> object:
    path = os.path.join(args.folder, CONFIG)
    held = files.Config.load(path)
    if args.action == "set":
        held.set(args.key, args.value)
        held.save(path)
    elif args.action == "export":
        return files.export_archive(args.folder, args.key)
    elif args.action == "import":
        return files.import_archive(args.key, args.folder)
    elif args.action == "logs":
        return files.log_bundle(args.folder, args.key)
    elif args.action == "path":
        return path
    return held.__dict__


def model(args: argparse.Namespace) -> object:
    """Status, place and removal of the token classifier or the text classifier; fetching one needs a network and is refused."""
    folder = os.path.join(args.folder, MODELS[args.command])
    if args.action == "download":
        raise SystemExit(f"there is no download here; put the model's files into {folder}")
    if args.action == "path":
        return folder
    if args.action == "remove" and os.path.isdir(folder):
        shutil.rmtree(folder)
    return models.model_status(folder)


def as_text(value: object, depth: int = 0) -> str:
    """A result for a person to read: one line a record or key."""
    if isinstance(value, dict):
        return "\n".join(f"{k}: {as_text(v, depth + 1)}" for k, v in value.items()) if not depth else ", ".join(f"{k}={as_text(v, depth + 1)}" for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return ("\n" if depth < 2 else "; ").join(as_text(v, depth + 1) for v in value)
    return "" if value is None else str(value)


def main(argv: list[str] | None = None) -> int:
    shared = argparse.ArgumentParser(add_help=False)
    for flag, text in (("--json", "print JSON"), ("--quiet", "print no notes")):
        shared.add_argument(flag, action="store_true", default=argparse.SUPPRESS, help=text)
    parser = argparse.ArgumentParser(prog="maskwright", description=__doc__, parents=[shared])
    parser.add_argument("--folder", default=os.path.expanduser("~/.maskwright"), help="where mappings, rules and settings are kept")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("scan", scan), ("process", process)):
        p = commands.add_parser(name, parents=[shared])
        p.add_argument("path")
        p.add_argument("-r", "--recursive", action="store_true")
        if name == "process":
            p.add_argument("--auto-accept", action="store_true", help="accept all detections without a review")
        p.set_defaults(run=run)
    p = commands.add_parser("mappings", parents=[shared])
    p.add_argument("action", choices=["list", "add", "remove"])
    p.add_argument("--original"), p.add_argument("--replacement"), p.add_argument("--type", default="PERSON")
    p.set_defaults(run=mappings)
    p = commands.add_parser("rules", parents=[shared])
    p.add_argument("action", choices=["list", "add", "remove", "test"])
    p.add_argument("--name"), p.add_argument("--pattern"), p.add_argument("--type"), p.add_argument("--text", default="")
    p.set_defaults(run=rules)
    p = commands.add_parser("ignore", parents=[shared])
    p.add_argument("action", choices=["list", "add", "remove", "clear"])
    p.add_argument("--text"), p.add_argument("--type", default="UNKNOWN"), p.add_argument("--reason")
    p.set_defaults(run=ignore)
    p = commands.add_parser("config", parents=[shared])
    p.add_argument("action", choices=["show", "set", "path", "export", "import", "logs"])
    p.add_argument("key", nargs="?"), p.add_argument("value", nargs="?")
    p.set_defaults(run=config)
    for name in MODELS:
        p = commands.add_parser(name, parents=[shared])
        p.add_argument("action", choices=["status", "path", "download", "remove"])
        p.set_defaults(run=model)
    args = parser.parse_args(argv)
    args.json, args.quiet = getattr(args, "json", False), getattr(args, "quiet", False)
    result = args.run(args)
    print(json.dumps(result, indent=2, ensure_ascii=False, default=str) if args.json else as_text(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
