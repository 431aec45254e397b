"""Named checks as table functions: one row for each check of each row, whatever becomes of it.

`cross_check(features, levels)` is called by LATERAL for every row; a feature is the name of a built-in check or
`module:function` of one that the executors can import. A check gets the levels as a numpy array and gives a number. What a
check raises, what cannot be loaded and what nobody knows are rows with a status and a reason, so that no check ends a job.
`check_status(features)` tells what of it is there, without data.

Statuses: success; error (it raised); unavailable (not to be loaded); unsupported (no such name). Null levels and null
features give no row; a value that is not finite is null with status error.
"""

from __future__ import annotations

import importlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.session import ship

BUILT_IN = {
    "mean": lambda v: v.mean(),
    "largest": lambda v: v.max(),
    "zero_share": lambda v: np.mean(v == 0),
    "roughness": lambda v: np.abs(np.diff(v)).mean(),
}


def loaded(feature: str):
    """The function of a feature; KeyError for an unknown name, ImportError or AttributeError where loading fails."""
    module, found, name = feature.partition(":")
    return getattr(importlib.import_module(module), name) if found else BUILT_IN[feature]


def state_of(feature: str) -> tuple:
    """function or None, status, reason."""
    try:
        return loaded(feature), "success", None
    except KeyError:
        return None, "unsupported", None
    except (ImportError, AttributeError, ValueError) as failure:
        return None, "unavailable", repr(failure)


class CrossCheck:
    """Functions are loaded once a task."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def eval(self, features, levels):
        if levels is None:
            return
        values = np.array([math.nan if v is None else v for v in levels], float)
        for feature in features or []:
            if feature is None:
                continue
            if feature not in self.known:
                self.known[feature] = state_of(feature)
            check, status, reason = self.known[feature]
            value = None
            if check is not None:
                try:
                    value = float(check(values))
                    if not math.isfinite(value):
                        value, status, reason = None, "error", "not finite"
                except Exception as failure:  # noqa: BLE001  a foreign check may raise anything
                    status, reason = "error", repr(failure)
            yield feature, status, value, reason


class CheckStatus:
    def eval(self, features):
        for feature in sorted({*BUILT_IN, *(f for f in features or [] if f is not None)}):
            _, status, reason = state_of(feature)
            yield feature, "built_in" if feature in BUILT_IN else "external", status == "success", reason or (None if status == "success" else status)


def register(spark: SparkSession) -> None:
    """Make both table functions known to SQL."""
    ship(spark)
    spark.udtf.register("cross_check", F.udtf(CrossCheck, returnType="feature STRING, status STRING, value DOUBLE, reason STRING"))
    spark.udtf.register("check_status", F.udtf(CheckStatus, returnType="feature STRING, kind STRING, available BOOLEAN, reason STRING"))


def status(spark: SparkSession, features: list[str] | None = None) -> DataFrame:
    """feature, kind, available, reason of the built-in checks and of those named."""
    register(spark)
    listed = ", ".join("'" + f.replace("\\", "\\\\").replace("'", "\\'") + "'" for f in features or [])
    return spark.sql(f"SELECT * FROM check_status(CAST(array({listed}) AS ARRAY<STRING>))")
