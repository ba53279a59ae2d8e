"""Market turbulence: distance of a day's returns from what the days before would suggest.

The operator looks at all entities of a day at once, so time is what it is split by: days get
a dense number, and a block of them is sent to a task together with the ``window`` days
before. Each row travels to 1 + ceil(window / block) tasks whatever the length of history;
an entity without a row in a task's days is only counted there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.panel import dense_index
from panelspark.session import ship_package


def mahalanobis(today: np.ndarray, past: np.ndarray, min_rows: int) -> float:
    """Squared distance of today from past rows; 0 when there is too little to go by."""
    use = ~np.isnan(today) & ~np.all(np.isnan(past), axis=0)
    if not use.any():
        return 0.0
    rows = past[:, use]
    rows = rows[~np.isnan(rows).any(axis=1)]
    if len(rows) < min_rows:
        return 0.0
    gap = today[use] - rows.mean(axis=0)
    cov = np.atleast_2d(np.cov(rows, rowvar=False, ddof=1))
    value = float(gap @ np.linalg.pinv(cov) @ gap)
    return value if math.isfinite(value) and value > 0 else 0.0


def older_distance(today: np.ndarray, past: np.ndarray, idle: int = 0) -> float:
    """As many leading past rows are trimmed as the column with the fewest gaps has gaps,
    then columns with a gap are dropped. 0 without a column, two rows, or a value today.
    Singular values at rounding level count as 0. idle: further columns that are 0 in every
    row; like those of ``past`` they add nothing but to the size that sets the rounding level.

    The rows span no more dimensions than there are rows, so the smaller of the covariance
    and the rows' products is decomposed; both have the same values other than 0.
    """
    if not past.size:
        return 0.0
    none = np.isnan(past)
    trim = 0 if idle else none.sum(axis=0).min()
    rows, use = past[trim:], ~none[trim:].any(axis=0)
    if len(rows) < 2 or not use.any() or np.isnan(today[use]).any():
        return 0.0
    live = use & (rows != 0).any(axis=0)
    if not live.any():
        return 0.0
    rows = rows[:, live]
    mean = rows.mean(axis=0)
    rows, gap = rows - mean, today[live] - mean
    wide = rows.shape[1] > len(rows)
    size, axis = np.linalg.eigh(rows @ rows.T if wide else rows.T @ rows)
    keep = size > (int(use.sum()) + idle) * np.finfo(float).eps * size.max()
    along = axis[:, keep].T @ (rows @ gap if wide else gap)
    value = float((len(rows) - 1) * (along**2 / size[keep] ** (2 if wide else 1)).sum())
    return value if math.isfinite(value) and value > 0 else 0.0


def turbulence(df: DataFrame, *, entity: str = "ticker", day: str = "date", value: str = "close", window: int = 252, block: int = 64, min_rows: int = 20, skip_first: int = 0, older: bool = False) -> DataFrame:
    """(day, turbulence): one value per day over all entities; 0 for the first ``window``.

    Returns are simple returns of each entity's consecutive non-null values. The window is
    the ``window`` days before, today excluded; entities without any return in it or today
    are left out, then days with a gap; fewer than ``min_rows`` days give 0, negative and
    undefined distances too. W17, the older form: with ``older`` an entity's price is
    carried over gaps and past its last day (return 0, as pandas before 3 does by default),
    and ``older_distance`` drops entities instead of days, whatever ``min_rows``;
    skip_first: so many first positive values are set to 0. Rows without entity are left out,
    two of an entity and day are an error. Entities form the columns of a matrix, so their number must be a
    universe's, not a market's.
    """
    ship_package(df.sparkSession)
    w = Window.partitionBy(entity).orderBy(day)
    x = df.where(F.col(value).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(entity).alias("e"), day, (F.col(value) / F.nullif(F.lag(value).over(w), F.lit(0.0)) - 1).alias("r"), (F.row_number().over(w) == 1).alias("first")
    )
    days = dense_index(df.select(day).distinct(), day, "i")
    if older:  # entities that began before a day; one row a day: a running count over the calendar
        begun = days.join(x.where("first").groupBy(day).agg(F.count("*").alias("n")), day, "left")
        days = begun.select(day, "i", F.coalesce(F.sum("n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begun"))
    reach = math.ceil(window / block)
    sent = days.join(x, day, "left").withColumn("b", F.explode(F.sequence(F.floor(F.col("i") / block), F.floor(F.col("i") / block) + reach)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        days = part.drop_duplicates("i").sort_values("i")
        index, rows = days["i"].to_numpy(), part[part["e"].notna()]
        at = np.searchsorted(index, rows["i"].to_numpy())
        col, names = pd.factorize(rows["e"], sort=True)
        there = np.zeros((len(index), len(names)), bool)
        there[at, col] = True
        if there.sum() < len(rows):
            raise ValueError("more than one row of an entity and day")
        grid = np.full(there.shape, np.nan)
        grid[at, col] = rows["r"].to_numpy(float)
        first, b, idle = int(index[0]), int(part["b"].iloc[0]), 0
        if older:
            since, new = np.full(len(names), -1), rows["first"].to_numpy(bool)
            since[col[new]] = at[new]
            grid[~there & (np.arange(len(index))[:, None] > since)] = 0.0
            idle = int(days["begun"].iloc[0]) - int((since < 0).sum())  # their last day is before all of these: 0 throughout
        distance = (lambda today, past: older_distance(today, past, idle)) if older else lambda today, past: mahalanobis(today, past, min_rows)
        out = []
        for k, i in enumerate(index):
            if i // block == b:
                out.append((days[day].iloc[k], int(i), distance(grid[k], grid[max(0, k - window) : k]) if i >= window and i - first >= min(window, i) else 0.0))
        return pd.DataFrame(out, columns=["day", "i", "turbulence"])

    res = sent.groupBy("b").applyInPandas(run, f"day {df.schema[day].dataType.simpleString()}, i int, turbulence double")
    if skip_first:
        # one row a day: a running count over the calendar
        seen = F.sum((F.col("turbulence") > 0).cast("int")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        res = res.withColumn("turbulence", F.when(seen > skip_first, F.col("turbulence")).otherwise(0.0))
    return res.select(F.col("day").alias(day), "turbulence")
