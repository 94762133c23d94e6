"""Settings as TOML text and fitted models as JSON documents."""

from __future__ import annotations

import json
import tomllib
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.options import Settings


def _written(v) -> str:
    if v is None:
        return '""'
    if isinstance(v, tuple):
        return f"[{', '.join(map(_written, v))}]"
    return json.dumps(v) if isinstance(v, (bool, str)) else repr(v)


def settings_text(cfg: Settings, *, inputs: dict | None = None) -> str:
    """One table per stage, every option written out; what a run was given goes into a table of its own."""
    parts = [f"drop_unmatched = {_written(cfg.drop_unmatched)}\n"]
    given = [(k, _written(v)) for k, v in (inputs or {}).items() if v is not None]
    for name, values in [("inputs", given)] * bool(given) + [(o.stage, [(k, _written(v)) for k, v in o.items]) for o in cfg]:
        parts.append(f"[{name}]\n" + "".join(f"{k} = {v}\n" for k, v in values))
    return "\n".join(parts)


def write_settings(cfg: Settings, path: str | Path, *, inputs: dict | None = None) -> None:
    Path(path).write_text(settings_text(cfg, inputs=inputs))


def read_settings(path: str | Path) -> Settings:
    """The settings that ``write_settings`` wrote; stages and options that are not named have their defaults."""
    data = tomllib.loads(Path(path).read_text())
    data.pop("inputs", None)
    return Settings(**data)


def write_models(models: DataFrame, folder: str, *, run: dict | None = None) -> None:
    """One JSON object per group and feature in ``folder``, each under the header of its run.

    An object has run (what it was fitted on, and when), group_key, feature and
    model with the arrays edges_lo, edges_hi, n and means of its bins.
    """
    bins = ["bin", "edge_lo", "edge_hi", "n", "mean"]
    keys = [c for c in models.columns if c not in (*bins, "feature", "weight")]
    each = models.groupBy(*keys, "feature").agg(F.sort_array(F.collect_list(F.struct(*bins))).alias("_b"))  # as many as bins
    array = lambda c: F.transform("_b", lambda b: b[c])
    head = {**(run or {}), "group_cols": keys, "written_utc": datetime.now(UTC).isoformat(timespec="seconds")}
    header = F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(str(v))).alias(k) for k, v in head.items()])
    model = F.struct(array("edge_lo").alias("edges_lo"), array("edge_hi").alias("edges_hi"), array("n").alias("n"), array("mean").alias("means"))
    each.select(header.alias("run"), F.struct(*keys).alias("group_key"), "feature", model.alias("model")).write.mode("overwrite").json(folder)
