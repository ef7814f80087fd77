"""Models that are made of tables, written to a folder and read again.

Each table of a model is a Parquet folder; what else it has is one line of JSON with a version.
"""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


def save(spark: SparkSession, model, folder: str) -> None:
    """A dataclass of tables, numbers and strings, to a folder that must not exist."""
    values = {f.name: getattr(model, f.name) for f in fields(model)}
    tables = {n: v for n, v in values.items() if isinstance(v, DataFrame)}
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    meta = {"version": VERSION, "kind": type(model).__name__, "tables": sorted(tables), "values": {n: v for n, v in values.items() if n not in tables}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/model")


def load(spark: SparkSession, kind: type, folder: str):
    """The model of a kind that was saved; refuses other kinds, versions and fields."""
    meta = json.loads(spark.read.text(f"{folder}/model").first()["value"])
    if meta.get("version") != VERSION or meta.get("kind") != kind.__name__:
        raise ValueError(f"not a model of kind {kind.__name__}, version {VERSION}")
    if {*meta["tables"], *meta["values"]} != {f.name for f in fields(kind)}:
        raise ValueError("the model's fields differ")
    return kind(**meta["values"], **{n: spark.read.parquet(f"{folder}/{n}") for n in meta["tables"]})
