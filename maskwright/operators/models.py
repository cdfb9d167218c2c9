"""Model-backed detectors and classifiers as plug-ins: present if a model is, else they find nothing and keep all."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.pages import decode_bio
from maskwright.operators.rules import DETECTIONS

#: Order of these detections after the rules and before the dictionary.
AFTER_RULES = 400
RULE_NAME = "NER (ONNX)"
_TAGS = "struct<labels:array<int>,offsets:array<struct<start:int,end:int>>>"


def model_status(folder: str) -> dict:
    """What is installed in a model's folder: the model itself decides."""
    files = {n: os.path.getsize(os.path.join(folder, n)) for n in ("model.onnx", "tokenizer.json", "config.json", "manifest.json") if os.path.exists(os.path.join(folder, n))}
    version = None
    if "manifest.json" in files:
        with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
            version = json.load(f).get("version")
    return {"installed": "model.onnx" in files, "version": version, "bytes": sum(files.values())}


def label_map(folder: str) -> list[str]:
    """Labels by index out of the model's configuration."""
    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        held = json.load(f)["id2label"]
    return [held[k] for k in sorted(held, key=int)]


def last_argmax(scores: np.ndarray) -> np.ndarray:
    """Index of the greatest score of each row, the last one at a tie."""
    return scores.shape[-1] - 1 - np.argmax(scores[..., ::-1], axis=-1)


def onnx_detector(folder: str) -> Callable[[Column], Column]:
    """A detector over a token classifier; without a model it finds nothing. The model is loaded once a task.

    ``folder`` must be the same on all executors. Labels come out of the model, entities out of the label fold.
    """
    if not model_status(folder)["installed"]:
        return lambda text: F.array().cast(DETECTIONS)

    @F.pandas_udf(_TAGS)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"))
        tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        wanted = {i.name for i in session.get_inputs()}
        for texts in batches:
            labels, offsets = [], []
            for text in texts:
                try:
                    e = tokenizer.encode(text or "")
                    given = {"input_ids": e.ids, "attention_mask": e.attention_mask, "token_type_ids": e.type_ids}
                    scores = session.run(None, {k: np.array([v], np.int64) for k, v in given.items() if k in wanted})[0][0]
                    labels.append(last_argmax(scores).tolist())
                    offsets.append([{"start": a, "end": b} for a, b in e.offsets])
                except Exception:  # a text the model can't take has no detections
                    labels.append([])
                    offsets.append([])
            yield pd.DataFrame({"labels": labels, "offsets": offsets})

    names = F.array(*(F.lit(x) for x in label_map(folder)))

    def run(text: Column) -> Column:
        tags = tag(text)
        full = lambda d, i: F.struct(d["start"], d["end"], d["matched_text"], d["entity_type"], F.lit(RULE_NAME).alias("rule_name"), (i + AFTER_RULES).cast("int").alias("ord"))
        return F.transform(decode_bio(text, tags["labels"], tags["offsets"], names), full)

    return run


#: Answer of a classifier: kept unless it is public.
PERSONAL, PUBLIC, UNCERTAIN = "PERSONAL", "PUBLIC", "UNCERTAIN"


def read_answer(answer: str | None) -> str:
    """What a model's answer says; PERSONAL goes before PUBLIC, anything else is uncertain."""
    upper = (answer or "").upper()
    return PERSONAL if PERSONAL in upper else PUBLIC if PUBLIC in upper else UNCERTAIN


#: Tokens of an answer at most.
ANSWER_TOKENS = 10


def prompt_of(text: str, entity_type: str, context: str) -> str:
    """What a classifier is asked about one detection."""
    return (
        f"A document contains {text!r}, found as {entity_type}, in this context:\n{context}\n"
        f"Is it personal information about a private individual, or public? Answer with one word, {PERSONAL} or {PUBLIC}."
    )


def prompting(load: Callable[[], Callable[[str, int], str]]) -> Callable[[], Callable[[pd.DataFrame], list[str]]]:
    """A classifier out of a text model: ``load()`` gives generate(prompt, tokens at most), once a task. For ``keep_personal``."""

    def loaded() -> Callable[[pd.DataFrame], list[str | None]]:
        generate = load()

        def answer(row) -> str | None:
            try:
                return generate(prompt_of(row.matched_text, row.entity_type, row.context), ANSWER_TOKENS)
            except Exception:  # without an answer a detection is kept
                return None

        return lambda pdf: [answer(r) for r in pdf.itertuples(index=False)]

    return loaded


def keep_personal(detections: DataFrame, classify: Callable[[pd.DataFrame], list[str]] | None = None, load: Callable[[], Callable[[pd.DataFrame], list[str]]] | None = None) -> DataFrame:
    """Detections that a classifier doesn't call public; without one all stay.

    ``classify`` gets batches of (matched_text, entity_type, context) and gives an answer each; ``load`` makes one, once a
    task. What fails is kept.
    """
    if classify is None and load is None:
        return detections

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            ask = classify or load()
        except Exception:  # a model that can't be loaded drops nothing
            ask = lambda pdf: [None] * len(pdf)
        for pdf in batches:
            try:
                answers = list(ask(pdf[["matched_text", "entity_type", "context"]]))
            except Exception:  # without an answer a detection is kept
                answers = [None] * len(pdf)
            yield pdf[[read_answer(a) != PUBLIC for a in answers]]

    return detections.mapInPandas(run, detections.schema)
