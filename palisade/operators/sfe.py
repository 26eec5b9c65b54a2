"""The optional field filter: drops fields that a predictor takes for metadata, before anything scans them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import DANGEROUS_KEYS, MAX_WALK_DEPTH
from .models import Shared, bounded, pieces
from .payload import parse, render, with_columns

_GONE = object()


@dataclass(frozen=True)
class DropDecision:
    label: str = "pass"
    prob: float = 0.0


class Predictor(Protocol):
    def predict_batch(self, texts: list[str]) -> list[DropDecision | dict]: ...


def _kind(x: Any) -> str:
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string")):
        if isinstance(x, kind):
            return name
    return "null" if x is None else "string"


def field_texts(value: Any) -> tuple[list[tuple[str, str]], bool]:
    """Path (without list places) and text of each string and null, and whether the walk was cut at 100 levels."""
    out, cut = [], False

    def go(x: Any, path: str, depth: int, stack: int) -> None:
        nonlocal cut
        if stack > MAX_WALK_DEPTH:
            cut = True
        elif isinstance(x, dict):
            for k, y in x.items():
                go(y, f"{path}.{k}" if path else k, depth + 1, stack + 1)
        elif isinstance(x, list):
            for y in x:
                go(y, path, depth, stack + 1)
        elif x is None or isinstance(x, str):
            words = path.replace(".", " ").replace("_", " ").replace("-", " ")
            out.append((path, f"{_kind(x)} d{depth} {words} {(x or '')[:200]}".replace("\r", " ").replace("\n", " ")))

    go(value, "", 0, 0)
    return out, cut


def _without(x: Any, paths: set[str], path: str = "", depth: int = 0) -> Any:
    if depth > MAX_WALK_DEPTH:
        return x
    if isinstance(x, list):
        return [y for y in (_without(y, paths, path, depth) for y in x) if y is not _GONE]
    if isinstance(x, dict):
        own = {k: _without(y, paths, f"{path}.{k}" if path else k, depth + 1) for k, y in x.items() if k not in DANGEROUS_KEYS}
        return {k: y for k, y in own.items() if y is not _GONE}
    return _GONE if path in paths else x


def filter_value(value: Any, predictor: Predictor | None, threshold: float = 0.5) -> tuple[Any, list[str], bool]:
    """The value without dropped paths, those paths sorted, and whether the walk was cut.

    A path drops in all elements of a list if it drops in one. Dangerous keys go too, but only when
    something is dropped.
    """
    if predictor is None or not isinstance(value, (dict, list)):
        return value, [], False
    fields, cut = field_texts(value)
    if not fields:
        return value, [], cut
    drop = set()
    for (path, _), d in zip(fields, predictor.predict_batch([t for _, t in fields])):
        label, prob = (d.get("label", "pass"), d.get("prob", 0.0)) if isinstance(d, dict) else (d.label, d.prob)
        if label == "drop" and float(prob) >= threshold:
            drop.add(path)
    return (_without(value, drop), sorted(drop), cut) if drop else (value, [], cut)


def sfe_filter(df: DataFrame, make_predictor: Callable[[], Predictor | None], threshold: float = 0.5, payload: str = "payload") -> DataFrame:
    """Replaces the payload by the filtered one and adds ``fields_dropped``, ``sfe_cut`` and ``sfe_failed``.

    ``make_predictor`` runs once a task; a ``Shared`` one loads once in a worker process. A predictor that is
    absent or fails leaves the payload as it is, and ``sfe_failed`` tells of the failure.
    """
    columns = [c for c in df.columns if c not in ("fields_dropped", "sfe_cut", "sfe_failed")]
    df = bounded(df.select(*columns))
    at = columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor, missing = None, False
        try:
            predictor = make_predictor()
        except Exception as e:  # without it nothing is dropped
            missing = True
            logging.getLogger(__name__).warning("no field filter: %s", e)
        for batch in pieces(batches):
            rows = []
            for text in batch.column(at).to_pylist():
                try:
                    value, dropped, cut = filter_value(parse(text), predictor, threshold)
                    rows.append((render(value) if dropped else text, dropped, cut, missing))
                except Exception as e:
                    logging.getLogger(__name__).warning("the field filter failed: %s", e)
                    rows.append((text, [], False, True))
            new = list(batch.columns)
            new[at] = pa.array([r[0] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*new, pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], [*columns, "fields_dropped", "sfe_cut", "sfe_failed"])

    return df.mapInArrow(run, with_columns(df, "fields_dropped array<string>, sfe_cut boolean, sfe_failed boolean"))


@dataclass(frozen=True)
class NamePredictor:
    """Drops fields whose last name is one of ``names``: a rule in place of a trained model."""

    names: tuple[str, ...] = ("uuid", "id", "etag", "created_at", "updated_at", "thread_id")

    def predict_batch(self, texts: list[str]) -> list[DropDecision]:
        out = []
        for text in texts:
            words = text.split(" ")
            path = " ".join(words[2:])
            hit = any(f" {path} ".startswith(f" {n.replace('_', ' ')} ") for n in self.names)
            out.append(DropDecision("drop", 1.0) if hit else DropDecision())
        return out


# Fixed value: what a trained model's labels begin with.
LABEL_PREFIX = "__label__"


class LabelPredictor:
    """A predictor around a trained text classifier: ``predict(texts, k=1)`` gives the labels and the probabilities of all texts at once."""

    def __init__(self, model: Any):
        self.model = model

    def predict_batch(self, texts: list[str]) -> list[DropDecision]:
        labels, probabilities = self.model.predict(texts, k=1)
        pairs = zip(labels, probabilities)
        return [DropDecision(own[0].removeprefix(LABEL_PREFIX), float(p[0])) if len(own) else DropDecision() for own, p in pairs]


def trained_predictor(path: str, load: Callable[[str], Any] | None = None) -> Shared:
    """Makes the predictor of a model file, once in each worker process. ``load`` reads the file; by default fasttext does, if it is there."""

    def make() -> LabelPredictor:
        if load is not None:
            return LabelPredictor(load(path))
        import fasttext

        return LabelPredictor(fasttext.load_model(path))

    return Shared(("fields", path), make)
