"""Portfolio simulation over weekly panels: one run is a fold over time.

A run needs every week in order, so the unit of work is a run; a sweep of many runs is what is
spread over the cluster. The panel (weeks x assets) travels to each run as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import ship_package

TINY = 1e-8


@dataclass(frozen=True)
class Rules:
    """Trading rules of a run (M1, M2) and its risk terms."""

    initial_cash: float = 1e6
    buy_cost: float = 0.0005
    sell_cost: float = 0.0005
    min_cash: float = 0.05
    fractional: bool = True
    temperature: float = 1.0
    beta: float = 0.0
    gamma: float = 0.0
    reward_scale: float = 1.0
    risk_window: int = 26
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    scales: tuple[float, float, float] = (1.0, 1.0, 1.0)
    warmup: int = 0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def with_min_cash(w: np.ndarray, floor: float) -> np.ndarray:
    """Simplex weights (cash first) with at least ``floor`` in cash."""
    w = np.maximum(w, TINY)
    w = w / w.sum()
    if w[0] < floor:
        rest = w[1:] * (1 - floor) / w[1:].sum()
        w = np.r_[floor, rest]
    return w


def rebalance(cash: float, shares: np.ndarray, prices: np.ndarray, target: np.ndarray, rules: Rules) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(cash, shares, traded shares, cost) after selling first and buying with what is left
    above the target's cash, all buys scaled alike when it doesn't suffice."""
    value = cash + shares @ prices
    traded = np.zeros(len(prices))
    if value <= TINY:
        return cash, shares, traded, 0.0
    whole = (lambda x: x) if rules.fractional else np.floor
    excess = np.maximum(shares * prices - target[1:] * value, 0.0)
    sold = np.minimum(whole(excess / np.maximum(prices, TINY)), shares)
    gross = sold @ prices
    cost = gross * rules.sell_cost
    cash, shares, traded = cash + gross - cost, shares - sold, traded - sold
    value = cash + shares @ prices
    want = np.maximum(target[1:] * value - shares * prices, 0.0)
    need = want.sum() * (1 + rules.buy_cost)
    room = max(0.0, cash - target[0] * value)
    scale = min(1.0, room / need) if need > 0 else 0.0
    bought = whole(want * scale / np.maximum(prices, TINY))
    spent = bought @ prices * (1 + rules.buy_cost)
    if spent > cash > 0:  # rounding dust
        bought, spent = bought * (cash / spent), cash
    cost += bought @ prices * rules.buy_cost
    return cash - spent, shares + bought, traded + bought, float(cost)


def endogenous(returns: list[float], rules: Rules) -> tuple[float, float, float, float]:
    """Downside deviation, tail loss, loss frequency and their weighted sum over the window."""
    r = np.array(returns[-rules.risk_window :])
    neg = r[r < 0]
    dev = float(neg.std()) if len(r) >= 2 and len(neg) >= 2 else 0.0
    tail = float(-neg[neg <= np.percentile(neg, 20)].mean()) if len(r) >= rules.risk_window and len(neg) else 0.0
    freq = len(neg) / len(r) if len(r) else 0.0
    parts = [x / s if s > 0 else 0.0 for x, s in zip((dev, tail, freq), rules.scales)]
    return dev, tail, freq, float(np.dot(rules.weights, parts))


# A policy maps (prices so far, one row a week, and the run's seed) to logits, cash first.
Policy = Callable[[np.ndarray, int], np.ndarray]


def equal_weight(past: np.ndarray, seed: int) -> np.ndarray:
    return np.zeros(past.shape[1] + 1)


def inverse_vol(past: np.ndarray, seed: int) -> np.ndarray:
    if len(past) < 3:
        return np.zeros(past.shape[1] + 1)
    vol = np.diff(np.log(past[-27:]), axis=0).std(axis=0)
    return np.r_[0.0, -np.log(np.maximum(vol, 1e-4)) - 3.0]


def momentum(past: np.ndarray, seed: int) -> np.ndarray:
    return np.zeros(past.shape[1] + 1) if len(past) < 9 else np.r_[0.0, 10 * np.log(past[-1] / past[-9])]


def random_logits(past: np.ndarray, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, len(past)]).normal(size=past.shape[1] + 1)


def min_variance(past: np.ndarray, seed: int) -> np.ndarray:
    """Long-only minimum variance by projecting the unconstrained solution."""
    n = past.shape[1]
    if len(past) < 12:
        return np.zeros(n + 1)
    cov = np.atleast_2d(np.cov(np.diff(np.log(past[-53:]), axis=0), rowvar=False)) + 1e-6 * np.eye(n)
    w = np.maximum(np.linalg.solve(cov, np.ones(n)), 1e-6)
    return np.r_[math.log(1e-6), np.log(w / w.sum())]


POLICIES: dict[str, Policy] = {"equal_weight": equal_weight, "inverse_vol": inverse_vol, "momentum": momentum, "random": random_logits, "min_variance": min_variance}


def rollout(prices: np.ndarray, rules: Rules, policy: Policy, seed: int = 0, turbulence: np.ndarray | None = None, exposure: np.ndarray | None = None) -> pd.DataFrame:
    """One row per step: weights, shares, costs, value, returns, risks and reward.

    Step t decides on prices up to t and is paid at t + 1. Risk columns are scaled by the
    largest absolute value of the whole slice (1 if none), clipped to [0, 1].
    """
    t0, n = rules.warmup, prices.shape[1]
    if len(prices) - t0 < 2:
        return pd.DataFrame(columns=STEP_COLUMNS)
    top = lambda x: max(float(np.nanmax(np.abs(x))), TINY) if x is not None and np.isfinite(x).any() and np.nanmax(np.abs(x)) > 0 else 1.0
    top_turb, top_exp = top(turbulence), top(exposure)
    cash, shares, value = rules.initial_cash, np.zeros(n), rules.initial_cash
    returns: list[float] = []
    rows = []
    for t in range(t0, len(prices) - 1):
        logits = np.clip(np.asarray(policy(prices[: t + 1], seed), float), -10, 10)
        intent = softmax(logits / rules.temperature)
        target = with_min_cash(intent, rules.min_cash)
        before = value
        cash, shares, traded, cost = rebalance(cash, shares, prices[t], target, rules)
        held = cash + shares @ prices[t]
        executed = np.maximum(np.r_[cash, shares * prices[t]], 0) / max(held, TINY)
        executed = executed / executed.sum()
        raw_turb = float(np.nan_to_num(turbulence[t])) if turbulence is not None else 0.0
        raw_exp = float(executed[1:] @ np.nan_to_num(exposure[t])) if exposure is not None else 0.0
        norm_turb, norm_exp = min(max(raw_turb / top_turb, 0), 1), min(max(raw_exp / top_exp, 0), 1)
        value = cash + shares @ prices[t + 1]
        r = math.log(max(value, TINY) / max(before, TINY))
        returns.append(r)
        dev, tail, freq, endo = endogenous(returns, rules)
        market, text = rules.beta * norm_turb * endo, rules.gamma * norm_exp
        rows.append((t - t0, t + 1, intent.tolist(), executed.tolist(), traded.tolist(), cost, cash, before, value, r, dev, tail, freq, endo, raw_turb, norm_turb, raw_exp, norm_exp, (r - market - text) * rules.reward_scale))
    return pd.DataFrame(rows, columns=STEP_COLUMNS)


STEP_COLUMNS = ["step", "day_idx", "intent_weights", "executed_weights", "trade_shares", "trade_cost", "cash", "pre_value", "nav", "log_return", "downside_dev", "cvar", "loss_freq", "endogenous_risk", "raw_turbulence", "norm_turbulence", "raw_exposure", "norm_exposure", "reward"]
STEP_SCHEMA = "run_id string, step int, day_idx int, intent_weights array<double>, executed_weights array<double>, trade_shares array<double>, " + ", ".join(f"{c} double" for c in STEP_COLUMNS[5:])


def panel_arrays(df: DataFrame, *, period: str, entity: str, price: str, risk: str | None = None, exposure: str | None = None, strict: bool = False) -> DataFrame:
    """(period, prices, turbulence, exposure) for periods in which every entity of the frame
    has a price; arrays run in order of the entity's name. strict: a period that lacks a price
    is an error instead of being left out."""
    n = df.agg(F.count_distinct(entity)).scalar()
    item = F.struct(F.col(entity).alias("e"), F.col(price).cast("double").alias("p"), (F.coalesce(F.col(exposure).cast("double"), F.lit(0.0)) if exposure else F.lit(0.0)).alias("x"))
    g = df.where(F.col(price).isNotNull()).groupBy(period).agg(F.array_sort(F.collect_set(item)).alias("a"), F.count_distinct(entity).alias("_k"), (F.max(risk) if risk else F.lit(0.0)).cast("double").alias("turbulence"))
    if strict:
        g = g.withColumn("_k", F.when(F.col("_k") == n, F.col("_k")).otherwise(F.raise_error(F.concat(F.lit("a price is missing in period "), F.col(period).cast("string"))).cast("long")))
    g = g.where(F.col("_k") == n)
    return g.select(period, F.transform("a", lambda i: i["p"]).alias("prices"), F.coalesce("turbulence", F.lit(0.0)).alias("turbulence"), F.transform("a", lambda i: i["x"]).alias("exposure"))


def simulate(panel: DataFrame, runs: DataFrame, *, period: str, rules: Rules = Rules()) -> DataFrame:
    """The steps of every run.

    runs: run_id, policy, seed and any of the Rules' fields as columns (as numbers or text).
    The panel of a universe is one array, weeks x assets numbers, which each run unfolds.
    """
    ship_package(panel.sparkSession)
    base = asdict(rules)
    extra = [c for c in runs.columns if c in base and c not in ("weights", "scales")]
    pairs = runs.select(F.col("run_id").cast("string").alias("run_id"), "policy", F.col("seed").cast("int").alias("seed"), *extra)
    weeks = panel.agg(F.collect_list(F.struct(F.col(period).alias("period"), "prices", "turbulence", "exposure"))).scalar()
    pairs = pairs.withColumn("_weeks", weeks).select(*pairs.columns, F.inline("_weeks"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("period")
        one = part.iloc[0]
        own = {c: type(base[c])(float(one[c])) if not isinstance(base[c], bool) else str(one[c]).lower() in ("true", "1", "1.0") for c in extra}
        steps = rollout(np.stack(part["prices"].to_numpy()), Rules(**{**base, **own}), POLICIES[one["policy"]], int(one["seed"]), part["turbulence"].to_numpy(float), np.stack(part["exposure"].to_numpy()))
        steps.insert(0, "run_id", one["run_id"])
        return steps

    return pairs.groupBy("run_id").applyInPandas(run, STEP_SCHEMA)
