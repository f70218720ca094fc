"""Materialised tables of the running application in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple[str, str, str], DataFrame] = {}
_FACTS: dict[tuple[str, str, str], object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where everything is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over ``sf_dir``, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = written(make(), name)
    return _KEPT[key]


def fact(spark: SparkSession, sf_dir: str, name: str, find: Callable[[], object]):
    """A small fact about ``sf_dir``, found once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FACTS:
        _FACTS[key] = find()
    return _FACTS[key]


def forget() -> None:
    """Drop what ``kept`` and ``fact`` remember: the next use builds anew."""
    _KEPT.clear()
    _FACTS.clear()
