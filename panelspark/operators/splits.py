"""Train, test and validation windows over a dense day index."""

from __future__ import annotations

import hashlib

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "fold int, role string, episode_start int, episode_end int, first_action int, last_action int"


def _half_even(x: float) -> int:
    return round(x)


def split_plan(days: DataFrame, *, day: str, first: str, last: str, terminal: str, train_ratio: float, norm_window: int = 26, history: int = 8, n_folds: int = 0, fold_days: int = 30, min_train: int = 150) -> DataFrame:
    """M6, M7: (fold, role, episode_start, episode_end, first_action, last_action).

    Fold -1 is the outer split. Action days are those from ``first`` to ``last``; the train
    part has round(ratio * n) of them, at least one, leaving at least one for test. Every
    slice starts norm_window + history - 2 days earlier, as far as there are days, and ends
    one day later, at most at ``terminal``. Validation folds roll forward to the end of the
    outer train part; as many are placed as fit, and one that leaves fewer than ``min_train``
    training days is skipped.

    Placement is by the number of folds that fit, so the last fold always ends with the
    train part. The three index positions are one aggregate over the distinct days.
    """
    d = days.select(F.col(day).cast("date").alias("d")).where("d IS NOT NULL").distinct()
    at = lambda s: F.lit(dt.date.fromisoformat(s))
    n = d.agg(F.count_if(F.col("d") < at(first)).alias("before"), F.count_if(F.col("d") <= at(last)).alias("upto"), F.count_if(F.col("d") <= at(terminal)).alias("end"), F.count("*").alias("n")).first()
    a, b = n.before, n.upto - 1
    end = n.end - 1 if n.end else b
    if b <= a:
        raise ValueError("the last action day must come after the first")
    total = b - a + 1
    train = min(max(1, _half_even(total * train_ratio)), total - 1)
    warm = norm_window + history - 2
    row = lambda fold, role, x, y: (fold, role, max(0, x - warm), min(y + 1, end), x, y)
    cut = a + train - 1
    rows = [row(-1, "train", a, cut), row(-1, "test", cut + 1, b)]
    fit = min(n_folds, max(0, (train - min_train) // fold_days))
    for i in range(fit):
        start = cut - (fit - i) * fold_days + 1
        if start - a >= min_train:
            rows += [row(i, "train", a, start - 1), row(i, "val", start, start + fold_days - 1)]
    return days.sparkSession.createDataFrame(rows, _SCHEMA)


def expand_grid(spark, grid: dict[str, list]) -> DataFrame:
    """Every combination of parameter values, one row each, numbered run_id."""
    import itertools

    keys = list(grid)
    rows = [(i, *map(str, combo)) for i, combo in enumerate(itertools.product(*grid.values()))]
    return spark.createDataFrame(rows, "run_id int, " + ", ".join(f"`{k}` string" for k in keys))


def run_name(overrides: dict[str, object], limit: int = 120) -> str:
    """Name of a run from dotted keys: leaf_value, floats short, lists joined by "+"."""
    def show(v: object) -> str:
        if isinstance(v, float):
            return f"{v:g}"
        return "+".join(show(x) for x in v) if isinstance(v, (list, tuple)) else str(v)

    name = "__".join(f"{k.rsplit('.', 1)[-1]}_{show(v)}" for k, v in overrides.items())
    if len(name) <= limit:
        return name
    end = hashlib.sha256(name.encode()).hexdigest()[:10]  # names that begin alike stay apart
    return f"{name[: limit - 11]}-{end}"


def set_path(config: dict, key: str, value: object) -> dict:
    """A copy of a config tree with one dotted key replaced."""
    head, _, rest = key.partition(".")
    return config | {head: set_path(config.get(head) or {}, rest, value) if rest else value}
