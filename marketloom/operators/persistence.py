"""Fitted models in versioned folders, with the gate that decides whether one may be used.

A folder holds one subfolder for each saved model: its pipelines, its tables, and last of all ``meta``,
one row of parquet (schema version, feature list, time of the fit, facts as JSON). A subfolder
without ``meta`` was not finished and does not exist for readers; nothing is overwritten, so readers
of an older model are not disturbed. ``gate`` says for each row of metadata why it may not be used:
another schema version, another feature list, or too old; the newest that may be used is loaded.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import at, seconds
from . import calibration, models
from .storage import names_in, removed

#: Rises when features, targets or stored parts change their meaning.
SCHEMA_VERSION = 1
#: Fixed value: hours after which a model is too old.
MAX_AGE_HOURS = 24.0
META = "schema_version int, features array<string>, fitted_at timestamp, facts string"


@dataclass
class Saved:
    """What a model folder gives back."""

    pipelines: dict[str, PipelineModel]
    tables: dict[str, DataFrame]
    facts: dict
    fitted_at: object = None
    features: list[str] = field(default_factory=list)


def refusal(features: list[str], as_of: str | Column, version: int = SCHEMA_VERSION, max_age_hours: float = MAX_AGE_HOURS) -> Column:
    """Why a row of metadata may not be used (``version``, ``features``, ``age``); null if it may."""
    age = seconds(at(as_of), F.col("fitted_at")) / 3600
    same = F.col("features").eqNullSafe(F.array(*[F.lit(x) for x in features]).cast("array<string>"))
    old = F.coalesce(age > max_age_hours, F.lit(True))
    return F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "version").when(~same, "features").when(old, "age")


def gate(meta: DataFrame, features: list[str], as_of: str | Column, version: int = SCHEMA_VERSION, max_age_hours: float = MAX_AGE_HOURS) -> DataFrame:
    """``meta`` with ``refused``, the first reason against each model."""
    return meta.withColumn("refused", refusal(features, as_of, version, max_age_hours))


def newest_usable(gated: DataFrame, keys: list[str] = [], name: str = "model") -> DataFrame:  # noqa: B006
    """The newest model that is not refused, in all or by keys; ties by the name."""
    order = F.struct("fitted_at", name)
    return gated.where(F.col("refused").isNull()).groupBy(*keys).agg(F.max_by(name, order).alias(name), F.max("fitted_at").alias("fitted_at"))


def save_model(spark: SparkSession, folder: str, features: list[str], fitted_at: str, pipelines: dict[str, PipelineModel], tables: dict[str, DataFrame] | None = None, facts: dict | None = None, version: int = SCHEMA_VERSION) -> str:
    """Write a model under ``folder``; its name is returned. ``facts`` must be plain JSON."""
    name = f"model-{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{name}"
    for part, model in pipelines.items():
        model.write().save(f"{path}/pipelines/{part}")
    for part, table in (tables or {}).items():
        table.write.parquet(f"{path}/tables/{part}")
    row = spark.createDataFrame([(version, features, json.dumps(facts or {}))], "schema_version int, features array<string>, facts string")
    row.select("schema_version", "features", F.lit(fitted_at).cast("timestamp").alias("fitted_at"), "facts").coalesce(1).write.parquet(f"{path}/meta")
    return name


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``model`` and its metadata, one row for each finished model of the folder."""
    done = [n for n in names_in(spark, folder) if "_SUCCESS" in names_in(spark, f"{folder.rstrip('/')}/{n}/meta")]
    if not done:
        return spark.createDataFrame([], f"model string, {META}")
    rows = spark.read.schema(META).parquet(*[f"{folder.rstrip('/')}/{n}/meta" for n in done])
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/meta/[^/]*$", 1).alias("model"), "*")


def load_model(spark: SparkSession, folder: str, features: list[str], as_of: str, version: int = SCHEMA_VERSION, max_age_hours: float = MAX_AGE_HOURS) -> Saved | None:
    """The newest usable model of ``folder``; None if there is none or a part of it cannot be read."""
    found = newest_usable(gate(metadata(spark, folder), features, as_of, version, max_age_hours)).first()
    if found is None or found["model"] is None:
        return None
    path = f"{folder.rstrip('/')}/{found['model']}"
    try:
        row = spark.read.schema(META).parquet(f"{path}/meta").first()
        pipelines = {n: PipelineModel.load(f"{path}/pipelines/{n}") for n in names_in(spark, f"{path}/pipelines")}
        tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in names_in(spark, f"{path}/tables")}
    except (AnalysisException, Py4JJavaError):
        return None
    return Saved(pipelines, tables, json.loads(row["facts"]), row["fitted_at"], row["features"])


def prune_models(spark: SparkSession, folder: str, keep: int = 3) -> list[str]:
    """Remove all but the ``keep`` newest finished models; the names of those removed."""
    rows = metadata(spark, folder).select("model", "fitted_at").orderBy(F.desc("fitted_at"), F.desc("model")).collect()
    gone = [r["model"] for r in rows[keep:]]
    for name in gone:
        removed(spark, f"{folder.rstrip('/')}/{name}")
    return gone


def save_chain(chain: calibration.Calibrated, spark: SparkSession, folder: str, features: list[str], fitted_at: str) -> str:
    """A fitted price chain: medians, bands with their pools, the isotonic map, widths and out-of-fold prices."""
    pipelines = {"median": chain.median, "bands": chain.bands.model, "iso": chain.iso} | ({"width": chain.width[0]} if chain.width else {})
    facts = {"overall": chain.overall, "edges": [str(e) for e in chain.edges], "by_bucket": {str(k): q for k, q in chain.by_bucket.items()}, "offset": chain.width[1] if chain.width else None, "levels": list(chain.bands.levels)}
    return save_model(spark, folder, features, fitted_at, pipelines, {"pools": chain.bands.pools, "seen": chain.seen}, facts)


def load_chain(spark: SparkSession, folder: str, features: list[str], as_of: str, **limits) -> calibration.Calibrated | None:
    """The newest usable price chain, ready for ``calibration.predict``; None means that nothing may be predicted."""
    found = load_model(spark, folder, features, as_of, **limits)
    if found is None or not {"median", "bands", "iso"} <= found.pipelines.keys() or not {"pools", "seen"} <= found.tables.keys():
        return None
    facts, pipes = found.facts, found.pipelines
    bands = models.Forest(pipes["bands"], found.tables["pools"], tuple(facts["levels"]))
    width = (pipes["width"], facts["offset"]) if facts["offset"] is not None and "width" in pipes else None
    return calibration.Calibrated(pipes["median"], bands, pipes["iso"], facts["overall"], [float(e) for e in facts["edges"]], {int(k): q for k, q in facts["by_bucket"].items()}, width, found.tables["seen"])


def save_hazard(model: PipelineModel, spark: SparkSession, folder: str, features: list[str], fitted_at: str, horizon_days: int, metrics: dict) -> str:
    return save_model(spark, folder, features, fitted_at, {"hazard": model}, facts={"horizon_days": horizon_days, "metrics": metrics})


def load_hazard(spark: SparkSession, folder: str, features: list[str], as_of: str, **limits) -> tuple[PipelineModel, int, dict] | None:
    """(model, horizon in days, metrics) of the newest usable hazard model."""
    found = load_model(spark, folder, features, as_of, **limits)
    if found is None or "hazard" not in found.pipelines or "horizon_days" not in found.facts:
        return None
    return found.pipelines["hazard"], found.facts["horizon_days"], found.facts.get("metrics", {})
