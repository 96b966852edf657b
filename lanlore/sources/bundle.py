"""SNK5: everything that was trained, in one versioned folder.

    path/version=3/<part>/pipeline     fitted pipelines, by Spark's own writer
    path/version=3/<part>/trees        isolation trees: tree, node, values
    path/version=3/<part>/numbers      named lists of numbers, in order
    path/version=3/manifest            one line of JSON: format, parts, classes, columns, limits, row counts

All of it is written through Spark, so a bundle can lie wherever tables can. The manifest is written last: a version without
one was not finished and is not seen. Loading checks the format, every part's kind, the pipelines' stages and the row counts.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..learn.classify import Classifier, Ensemble, OneVersusRest
from ..learn.fusion import MultiView
from ..learn.isolation import IsolationForest
from ..plans.training import Models

FORMAT = 1


class BundleError(ValueError):
    """A bundle that is missing, unfinished, damaged or of another format."""


class _Writer:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.parts: dict[str, dict[str, Any]] = {}

    def _table(self, df: DataFrame, folder: str) -> int:
        df.write.parquet(f"{self.root}/{folder}")
        return df.count()

    def numbers(self, name: str, lists: dict[str, Any]) -> int:
        rows = [(key, i, [float(x) for x in values]) for key, many in lists.items() for i, values in enumerate(many)]
        return self._table(self.spark.createDataFrame(rows, "name string, at int, values array<double>"), f"{name}/numbers")

    def pipeline(self, name: str, model: PipelineModel) -> list[str]:
        model.write().save(f"{self.root}/{name}/pipeline")
        return [type(s).__name__ for s in model.stages]

    def put(self, name: str, part: Any) -> None:
        kind = type(part).__name__
        note: dict[str, Any] = {"kind": kind}
        if isinstance(part, PipelineModel):
            note["stages"] = self.pipeline(name, part)
        elif isinstance(part, Classifier):  # MultiView is one
            note |= {"classes": part.classes, "stages": self.pipeline(name, part.model)}
        elif isinstance(part, OneVersusRest):
            note |= {"classes": part.classes, "of": list(part.models)}
            for i, model in enumerate(part.models.values()):
                self.put(f"{name}/{i}", model)
        elif isinstance(part, Ensemble):
            note |= {"classes": part.classes, "members": len(part.members)}
            for i, member in enumerate(part.members):
                self.put(f"{name}/{i}", member)
        elif isinstance(part, IsolationForest):
            rows = [(t, i, node.tolist()) for t, tree in enumerate(part.trees) for i, node in enumerate(tree)]
            trees = self.spark.createDataFrame(rows, "tree int, node int, values array<double>")
            note |= {"sample": part.sample, "offset": part.offset, "trees": self._table(trees, f"{name}/trees")}
            note["numbers"] = self.numbers(name, {"means": [part.means], "stds": [part.stds]})
        elif isinstance(part, Models):
            held = {f: getattr(part, f) for f in ("baseline", "anomaly", "reconstruction", "views", "scaler") if getattr(part, f) is not None}
            note |= {"features": part.features, "limits": part.limits, "held": list(held), "numbers": self.numbers(name, {"centres": part.centres})}
            for field, value in held.items():
                self.put(f"{name}/{field}", value)
        else:
            raise TypeError(f"a bundle cannot hold {kind}")
        self.parts[name] = note


class _Reader:
    def __init__(self, spark: SparkSession, root: str, parts: dict[str, dict[str, Any]]):
        self.spark, self.root, self.parts = spark, root, parts

    def _rows(self, folder: str, expected: int) -> list:
        rows = self.spark.read.parquet(f"{self.root}/{folder}").collect()  # trees and centres: bounded by the model
        if len(rows) != expected:
            raise BundleError(f"{folder} has {len(rows)} rows, the manifest says {expected}")
        return rows

    def numbers(self, name: str, note: dict[str, Any], key: str) -> list[list[float]]:
        return [list(r["values"]) for r in sorted(self._rows(f"{name}/numbers", note["numbers"]), key=lambda r: r["at"]) if r["name"] == key]

    def pipeline(self, name: str, note: dict[str, Any]) -> PipelineModel:
        model = PipelineModel.load(f"{self.root}/{name}/pipeline")
        stages = [type(s).__name__ for s in model.stages]
        if stages != note["stages"]:
            raise BundleError(f"{name} has the stages {stages}, the manifest says {note['stages']}")
        return model

    def get(self, name: str) -> Any:
        if name not in self.parts:
            raise BundleError(f"the manifest has no part {name}")
        note = self.parts[name]
        kind = note["kind"]
        if kind == "PipelineModel":
            return self.pipeline(name, note)
        if kind in ("Classifier", "MultiView"):
            return {"Classifier": Classifier, "MultiView": MultiView}[kind](self.pipeline(name, note), note["classes"])
        if kind == "OneVersusRest":
            out = OneVersusRest({c: self.get(f"{name}/{i}") for i, c in enumerate(note["of"])})
            out.classes = note["classes"]
            return out
        if kind == "Ensemble":
            out = Ensemble([self.get(f"{name}/{i}") for i in range(note["members"])])
            out.classes = note["classes"]
            return out
        if kind == "IsolationForest":
            trees: dict[int, list[tuple[int, list[float]]]] = {}
            for r in self._rows(f"{name}/trees", note["trees"]):
                trees.setdefault(r["tree"], []).append((r["node"], list(r["values"])))
            built = [np.array([values for _, values in sorted(trees[t])]) for t in sorted(trees)]
            means, stds = (self.numbers(name, note, k)[0] for k in ("means", "stds"))
            return IsolationForest(built, note["sample"], means, stds, note["offset"])
        if kind == "Models":
            held = {f: self.get(f"{name}/{f}") for f in note["held"]}
            return Models(note["features"], centres=self.numbers(name, note, "centres"), limits=note["limits"], **held)
        raise BundleError(f"{name} is of an unknown kind, {kind}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions below `path`, oldest first."""
    try:
        found = spark.read.option("recursiveFileLookup", "true").text(f"{path}/version=*/manifest")
        return sorted(r[0] for r in found.select(F.regexp_extract(F.input_file_name(), r"/version=(\d+)/manifest/", 1).cast("int")).distinct().collect())
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def save_bundle(spark: SparkSession, trained: Any, path: str, version: int | None = None) -> int:
    """Write a model, or all that `train` gave, as the next version (or `version`, which must be new); returns its number."""
    number = version if version is not None else max(versions(spark, path), default=0) + 1
    writer = _Writer(spark, f"{path}/version={number}")
    writer.put("model", trained)
    manifest = json.dumps({"format": FORMAT, "version": number, "parts": writer.parts})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{writer.root}/manifest")
    return number


def load_bundle(spark: SparkSession, path: str, version: int | None = None) -> Any:
    """What `save_bundle` wrote; the newest finished version unless one is named."""
    there = versions(spark, path)
    number = version if version is not None else max(there, default=None)
    if number is None or number not in there:
        raise BundleError(f"no finished version {'' if number is None else number} in {path}")
    root = f"{path}/version={number}"
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    if manifest.get("format") != FORMAT:
        raise BundleError(f"format {manifest.get('format')} is not {FORMAT}")
    return _Reader(spark, root, manifest["parts"]).get("model")
