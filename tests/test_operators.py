import datetime as dt
import itertools
import json
import math
import random
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelspark.operators import analyst as an
from panelspark.operators import metrics as mt
from panelspark.operators import panel as pn
from panelspark.operators import selection as sel
from panelspark.operators import signals as sg
from panelspark.operators import simulate as sim
from panelspark.operators import splits as sp
from panelspark.operators import weekly as wk
from panelspark.operators.recursive import ema, recursive_indicators, rsi, true_range
from panelspark.operators.turbulence import mahalanobis, older_distance, turbulence


def bars(spark, n=40, tickers=("A", "B", "C"), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        p = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(t, dt.date(2020, 1, 1) + dt.timedelta(i), float(x), float(x * 1.01), float(x * 0.99), float(x), 1000.0) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


# ---- selection


def greedy(rows, per_source, per_day):
    src, day, out = {}, {}, []
    for s, d, score, item in sorted(rows, key=lambda r: (-r[2], r[3])):
        if src.get(s, 0) < per_source and day.get(d, 0) < per_day:
            out.append(item)
            src[s], day[d] = src.get(s, 0) + 1, day.get(d, 0) + 1
    return out


def test_cap_select_matches_the_walk(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice(["x", "y", "z", None]), rng.choice("12345"), rng.choice([0.1, 0.5, rng.random()]), i) for i in range(300) for g in ("g", "h")]
    df = spark.createDataFrame(rows, "g string, s string, d string, score double, i int")
    for a, b in ((3, 2), (1, 5), (50, 1)):
        got = {r.g: [p.item for p in r.picked] for r in sel.cap_select(df, group=["g"], source="s", day="d", item="i", order=["score"], per_source=a, per_day=b).collect()}
        assert got == {g: greedy([(s or "", d, x, i) for q, s, d, x, i in rows if q == g], a, b) for g in ("g", "h")}


def test_dynamic_top(spark):
    df = spark.createDataFrame([(0, [(1, 0.9), (2, 0.8), (3, 0.1), (4, 0.05)])], "g int, picked array<struct<item: int, score: double>>")
    assert [(r.rank, r.item) for r in sel.dynamic_top(df, group=["g"], n_min=1, n_max=3, tau=1.0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert sel.dynamic_top(df, group=["g"], n_min=3, n_max=5).count() == 3


def test_budget_cut_changes_nothing(spark):
    rng = random.Random(3)
    rows = [(1, str(rng.randrange(4)), rng.choice([1.0, rng.random()]), rng.randrange(100), i, rng.randrange(1, 400)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, day string, score double, ts long, item int, n long")
    got = {r.item for r in sel.budgeted_context(df, group=["g"], day="day", score="score", ts="ts", item="item", n_chars="n", per_day=2, most=9, max_chars=700, per_article=90).collect()}
    part = pd.DataFrame([(d, s, t, i, min(n, 90)) for _, d, s, t, i, n in rows], columns=["day", "score", "ts", "item", "cost"])
    assert got == set(sel.budget_walk(part, 2, 9, 700))


def test_universe(spark):
    rows = [(f"e{i}", f"s{i % 3}", float(100 - i)) for i in range(20)] + [("z", "rare", 0.5)]
    df = spark.createDataFrame(rows, "e string, s string, c double")
    a = sel.sector_allocation(df, entity="e", sector="s", capital="c", size=7).collect()
    assert len(a) == 7 and max(r.seats for r in a) - min(r.seats for r in a) <= 1
    t = sel.top_diversified(df, entity="e", sector="s", capital="c", top_n=2, size=5).orderBy("pick").collect()
    assert [r.e for r in t] == ["e0", "e1", "e2", "z", "e3"]
    w = sel.source_whitelist(spark.createDataFrame([(x,) for x in "aaabbc"], "source string"), 0.34)
    assert [r.source for r in w.collect()] == ["a"]
    assert [tuple(r) for r in sel.source_tiers(spark.createDataFrame([(x,) for x in "aaabbcd"] + [(None,)], "source string")).orderBy("source").collect()] == [("a", 3, "A", 3), ("b", 2, "A", 3), ("c", 1, "B", 2), ("d", 1, "C", 1)]


# ---- panel


def test_panel_checks(spark):
    df = spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "a", float("nan"))], "d string, t string, v double")
    u = spark.createDataFrame([("a",), ("b",)], "t string")
    got = {r.d: (r.n_present, r.missing, r.complete) for r in pn.coverage(df, period="d", entity="t", universe=u).collect()}
    assert got == {"d1": (2, [], True), "d2": (1, ["b"], False)}
    with pytest.raises(ValueError, match="x, y"):
        pn.require_columns(df, "d", "x", "y")
    other = df.withColumn("v", F.when(F.col("t") == "b", 2.5).otherwise(F.col("v")))
    assert pn.overlap_check(df, other, ["d", "t"], ["v"]).first().diff_v == 1
    with pytest.raises(ValueError, match="diff_v"):
        pn.merge_agreeing(df, other.withColumn("w", F.lit(1)), ["d", "t"])
    assert pn.merge_agreeing(df, other.withColumn("w", F.lit(1)), ["d", "t"], strict=False).where("w = 1 AND v = 2").count() == 1


def test_gauss_rank_is_the_normal_quantile(spark):
    from statistics import NormalDist

    df = spark.range(200).select(((F.col("id") + 0.5) / 200).alias("p"))
    for r in df.select("p", pn.normal_quantile(F.col("p")).alias("q")).collect():
        assert abs(NormalDist().inv_cdf(r.p) - r.q) < 2e-8


def test_features_and_scaling(spark):
    df = spark.createDataFrame([(864000, 86400, None, 1.0, -2.0), (864000, None, None, 0.0, None)], "at long, ec long, sec long, a double, b double")
    r = pn.source_features(df, at="at", event_times={"ec": "ec", "sec": "sec"}, signals=["a", "b"]).collect()
    assert (r[0].days_since_ec, r[0].days_since_sec, r[0].n_sources, r[0].sign_disagreement) == (9, None, 2, True)
    assert (r[1].n_sources, r[1].sign_disagreement) == (1, False)
    x = pn.adjust_prices(spark.createDataFrame([(10.0, 12.0, 8.0, 10.0, 5.0, 7.00005), (1.0, 1.0, 1.0, 0.0, 3.0, 1.0)], "open double, high double, low double, close double, adj_close double, volume double")).collect()
    assert (x[0].open, x[0].close, x[1].open, x[1].close) == (5.0, 5.0, 1.0, 3.0)


def test_friday_bins(spark):
    rows = [(dt.date(2024, 1, 5), "a"), (dt.date(2024, 1, 6), "a"), (dt.date(2024, 1, 20), "b"), (None, "a")]
    got = {(r.k, str(r.week)): r.n for r in wk.friday_counts(spark.createDataFrame(rows, "d date, k string"), day="d", key="k").collect()}
    assert got[("a", "2024-01-05")] == 1 and got[("a", "2024-01-12")] == 1 and got[("b", "2024-01-26")] == 1 and got[("b", "2024-01-05")] == 0 and len(got) == 8


# ---- recursive indicators and turbulence


def test_recursive_filters():
    x = np.array([np.nan, 1, 2, np.nan, 4, 8.0])
    want = pd.Series(x).ewm(alpha=0.5, adjust=False, ignore_na=True).mean().to_numpy()
    assert np.allclose(ema(x, 0.5), want, equal_nan=True)
    assert np.isnan(ema(np.arange(5.0), 0.5, seed=3)[:2]).all() and ema(np.arange(5.0), 0.5, seed=3)[2] == 1.0
    assert rsi(np.array([1.0, 2, 3, 4]), 3)[-1] == 100
    assert np.allclose(true_range(np.array([2.0, 5]), np.array([1.0, 4]), np.array([1.5, 4.5])), [1, 3.5])


def test_indicators_operator(spark):
    got = recursive_indicators(bars(spark)).toPandas()
    assert len(got) == 120 and np.allclose(got.macd - got.macd_signal, got.macd_hist, equal_nan=True) and got.rsi.dropna().between(0, 100).all()


def test_turbulence_matches_plain_numpy(spark):
    df = bars(spark, 70)
    got = turbulence(df, window=25, block=8, min_rows=10).toPandas().sort_values("date")["turbulence"].to_numpy()
    r = df.toPandas().pivot(index="date", columns="ticker", values="close").sort_index().pct_change().to_numpy()
    want = [mahalanobis(r[i], r[i - 25 : i], 10) if i >= 25 else 0.0 for i in range(70)]
    assert np.allclose(got, want) and (got[26:] > 0).all()
    older = turbulence(df, window=25, block=64, min_rows=10, skip_first=2).toPandas().sort_values("date")["turbulence"].to_numpy()
    assert (older > 0).sum() == (got > 0).sum() - 2


def test_older_turbulence_drops_entities_not_days(spark):
    r = np.random.default_rng(5)
    p = np.exp(np.cumsum(r.normal(0, 0.01, (70, 4)), axis=0))
    p[:40, 2] = np.nan  # starts late
    p[30::3, 1] = np.nan  # has gaps all the time
    p[50:, 3] = np.nan  # ends early
    day = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(70)]
    rows = [(k, day[i], float(p[i, j])) for i in range(70) for j, k in enumerate("ABCD") if not np.isnan(p[i, j])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = turbulence(df, window=25, block=8, skip_first=2, older=True).toPandas().sort_values("date")["turbulence"].to_numpy()
    ret = pd.DataFrame(p).ffill().pct_change(fill_method=None)
    want, seen = [], 0
    for i in range(70):
        past = ret.iloc[max(0, i - 25) : i]
        v = 0.0
        if i >= 25:
            past = past.iloc[past.isna().sum().min() :].dropna(axis=1)
            gap = (ret.iloc[i][past.columns] - past.mean()).to_numpy()
            v = float(gap @ np.linalg.pinv(past.cov().to_numpy()) @ gap)
        seen += v > 0
        want.append(v if seen > 2 else 0.0)
    assert np.allclose(got, want) and (got[27:] > 0).all() and got[:27].max() == 0


def test_older_turbulence_of_a_wide_panel():
    """Far more entities than days: a matrix of their squared number isn't decomposed for each day."""
    r = np.random.default_rng(6)
    past, today = r.normal(0, 0.01, (60, 3000)), r.normal(0, 0.01, 3000)
    past[:, 1000:], today[2000:] = 0.0, 0.0  # most stand still; half of these move again today
    began = time.monotonic()
    got = [older_distance(today * k, past) for k in (1, 2, 3, 4, 5)]
    assert time.monotonic() - began < 3
    c = (past - past.mean(axis=0))[:, :1000]
    want = [float(np.sum((np.linalg.pinv(c.T) @ (today * k - past.mean(axis=0))[:1000]) ** 2) * 59) for k in (1, 2, 3, 4, 5)]
    assert np.allclose(got, want)


def test_older_turbulence_counts_entities_that_ended_long_ago(spark):
    r = np.random.default_rng(7)
    p = np.exp(np.cumsum(r.normal(0, 0.01, (130, 12)), axis=0))
    for j in range(12):
        p[: 9 * j, j] = p[9 * j + 30 :, j] = np.nan
    day = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(130)]
    df = spark.createDataFrame([(f"T{j:02}", day[i], float(p[i, j])) for i in range(130) for j in range(12) if p[i, j] == p[i, j]], "ticker string, date date, close double")
    got = turbulence(df, window=20, block=8, older=True).toPandas().sort_values("date")["turbulence"].to_numpy()
    ret = pd.DataFrame(p).ffill().pct_change(fill_method=None)
    want = [0.0] * 20
    for i in range(20, len(got)):
        past = ret.iloc[i - 20 : i]
        past = past.iloc[past.isna().sum().min() :].dropna(axis=1)
        gap = (ret.iloc[i][past.columns] - past.mean()).to_numpy()
        want.append(float(gap @ np.linalg.pinv(past.cov().to_numpy(), rcond=past.shape[1] * 2.3e-16) @ gap))
    assert np.allclose(got, want) and (got > 0).sum() > 90


def test_distance_needs_rows():
    assert mahalanobis(np.array([0.1, np.nan]), np.full((30, 2), np.nan), 5) == 0
    assert mahalanobis(np.array([0.1]), np.random.default_rng(0).normal(size=(4, 1)), 5) == 0


# ---- signals and analyst


def test_signal_shapes(spark):
    rows = ['{"rl": {"signal": 11, "risk_score": -1}}', '{"rl": [], "signal": 3}', '{"analysis": {"rl": {"sentiment_score": "2.5", "reasoning": "why"}}}', "{bad", None, "{}"]
    got = sg.clamp_pack(sg.extract_signal(spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "r string, i int"), "r")).orderBy("i").collect()
    assert [x.signal for x in got] == [10, 3, 2.5, 0, 0, 0] and got[0].risk_score == 0 and got[2].rationale == "why" and got[4].rationale == ""
    assert spark.range(1).select(sg.json_block(F.lit('x {"a": {"b": 1}} y')).alias("b"), sg.json_block(F.lit("none")).alias("n")).first() == ('{"a": {"b": 1}}', None)


def test_enums(spark):
    df = spark.createDataFrame([(" Lawsuit ",), ("CYBER",), (None,), ("whatever",)], "v string")
    assert [r.x for r in df.select(sg.normalise_enum(F.col("v"), "category").alias("x")).collect()] == ["litigation", "cyber", "other", "other"]
    assert [r.x for r in df.select(sg.normalise_enum(F.col("v"), "severity").alias("x")).collect()] == ["medium"] * 4


def test_sentence_chunks():
    text = "  ".join(f"This is sentence {i}." for i in range(60))
    out = sg.sentence_chunks(text, 200, 50, 100)
    assert all(len(c) <= 200 + 51 for c in out) and out[1].split(". ")[0] in out[0]
    assert len(sg.sentence_chunks(text, 200, 50, 3)) == 3 and sg.sentence_chunks(None, 10, 0, 3) == [] and sg.sentence_chunks("x" * 50, 10, 0, 3) == ["x" * 50]


def test_chunks_keep_the_whole_text(spark):
    said = [f"This is sentence {i}." for i in range(2000)]
    df = spark.createDataFrame([("d", " ".join(said))], "doc string, t string")
    whole = sorted(sg.chunk_documents(df, doc="doc", text="t", overlap=0).collect(), key=lambda r: r.chunk_no)
    assert len(whole) > 5 and " ".join(r.chunk for r in whole) == " ".join(said)
    assert sg.chunk_documents(df, doc="doc", text="t", max_chunks=3).count() == 3


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Flaky:
    def reply(self, texts):
        return ["no json" if "bad" in t else 'ok {"signal": 1}' for t in texts]


class Broken:
    def reply(self, texts):
        raise OSError("down")


def test_analyst_calls(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, " "), (4, None)], "id int, t string")
    got = {r.id: r for r in an.call_analyst(df, key=["id"], text="t", analyst=Flaky(), retries=1).collect()}
    assert got[1].reply == '{"signal": 1}' and got[1].attempts == 1
    assert got[2].reply is None and "no JSON" in got[2].error and got[2].attempts == 2
    assert json.loads(got[3].reply)["note"] == an.NO_NEWS and got[4].attempts == 0
    assert an.signals_from_replies(spark.createDataFrame([('{"signal": 3}',)], "r string"), "r").first().signal == 3
    down = {r.id: r for r in an.call_analyst(df, key=["id"], text="t", analyst=Broken(), retries=0).collect()}
    assert "down" in down[1].error and down[3].error is None


def test_digest(spark):
    text = "A lawsuit may bring a loss. Cyber risk stays. " * 20
    r = an.digest_documents(spark.createDataFrame([("d", text), ("e", None)], "doc string, t string"), doc="doc", text="t", max_len=200, group=2).collect()
    assert len(r) == 1 and {x.title: x.severity for x in r[0].top_risks}["lawsuit"] == "high" and r[0].rubric_signal == -7


def test_rate_limit():
    import time

    limit, t = an.RateLimit(6000), time.monotonic()
    for _ in range(6):
        limit.wait()
    assert 0.045 <= time.monotonic() - t < 1


# ---- splits, simulation, metrics


def test_split_plan(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i),) for i in range(400)], "d date")
    rows = sp.split_plan(days, day="d", first="2020-02-10", last="2021-01-20", terminal="2021-01-25", train_ratio=0.8, n_folds=3, fold_days=20, min_train=100).collect()
    by = {(r.fold, r.role): r for r in rows}
    assert by[(-1, "train")].first_action == 40 and by[(-1, "test")].last_action == 385
    assert by[(-1, "test")].first_action == by[(-1, "train")].last_action + 1 and by[(2, "val")].last_action == by[(-1, "train")].last_action
    assert all(r.episode_start == max(0, r.first_action - 32) and r.episode_end == min(r.last_action + 1, 390) for r in rows)
    with pytest.raises(ValueError):
        sp.split_plan(days, day="d", first="2021-01-20", last="2020-02-10", terminal="2021-01-25", train_ratio=0.8)


def test_grid_and_names(spark):
    assert sp.expand_grid(spark, {"a": [1, 2], "b": ["x"]}).count() == 2
    assert sp.run_name({"rl.lr": 0.00030, "env.cols": ["a", "b"]}) == "lr_0.0003__cols_a+b"
    assert sp.set_path({"a": {"b": 1, "c": 2}}, "a.b", 5) == {"a": {"b": 5, "c": 2}}


def test_three_steps_by_hand():
    prices = np.array([[10.0, 10.0], [20.0, 10.0], [20.0, 20.0]])
    rules = sim.Rules(initial_cash=1000, buy_cost=0, sell_cost=0, min_cash=0.0)
    third = math.log(1 / 3)
    out = sim.rollout(prices, rules, lambda past, seed: np.full(3, third))
    assert np.allclose(out.nav, [1000 * 4 / 3, 1000 * 4 / 3 * 4 / 3]) and np.allclose(np.exp(out.log_return).prod(), out.nav.iloc[-1] / 1000)
    assert np.allclose(out.trade_shares.iloc[0], [100 / 3, 100 / 3]) and out.trade_cost.sum() == 0


def test_simulation_invariants():
    rng = np.random.default_rng(1)
    prices = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, (60, 5)), axis=0))
    for (name, policy), whole, floor in itertools.product(sim.POLICIES.items(), (True, False), (0.0, 0.1)):
        out = sim.rollout(prices, sim.Rules(min_cash=floor, fractional=not whole, beta=0.1, gamma=0.1), policy, 3, rng.random(60), rng.random((60, 5)))
        w = np.stack(out.executed_weights)
        assert np.allclose(w.sum(1), 1) and (w >= 0).all() and (out.cash >= -1e-6).all() and np.isfinite(out.reward).all()
        if floor:
            assert (w[:, 0] >= floor - 2e-3).all(), name
        if whole:
            assert np.allclose(np.stack(out.trade_shares) % 1, 0)


def test_sweep_operator(spark):
    df = bars(spark, 30).select("ticker", F.col("date").alias("week"), "close")
    panel = sim.panel_arrays(df, period="week", entity="ticker", price="close")
    runs = spark.createDataFrame([("a", "equal_weight", 0, "0.0"), ("b", "momentum", 1, "0.2")], "run_id string, policy string, seed int, min_cash string")
    got = sim.simulate(panel, runs, period="week", rules=sim.Rules(warmup=5))
    assert got.groupBy("run_id").count().orderBy("run_id").collect() == [("a", 24), ("b", 24)]
    assert got.where("run_id = 'b'").selectExpr("min(executed_weights[0]) AS m").first().m > 0.19


def test_metrics_edges(spark):
    steps = spark.createDataFrame([("a", 1, 0.1, 2), ("a", 2, -0.3, 0), ("a", 3, None, 1), ("b", 1, 0.0, 0)], "e string, i int, lr double, tr int")
    p = {r.e: r for r in mt.episode_totals(steps, episode="e", order="i", log_return="lr", trades="tr").collect()}
    assert abs(p["a"].max_drawdown - (math.exp(-0.3) - 1)) < 1e-12 and p["a"].trade_count == 3 and p["b"].sharpe == 0 and p["b"].nav_multiple == 1
    w = spark.createDataFrame([("e", 1, [0.5, 0.5]), ("e", 2, [1.0, 0.0]), ("e", 3, None), ("e", 4, [0.0, 1.0])], "e string, i int, w array<double>")
    assert [r.turnover for r in mt.turnover(w, "w", episode="e", order="i").orderBy("i").collect()] == [None, 0.5, None, None]
    c = mt.guarded_corr(spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, 6.0, 1.0)], "a double, b double, k double"), "a", ["b", "k"]).first()
    assert abs(c.corr_b - 1) < 1e-12 and c.corr_k is None
    r = mt.score_runs(spark.createDataFrame([("x", 1.0, None), ("y", 1.0, 5.0)], "run_id string, a double, b double"), {"a": 1.0, "b": 0.1}).orderBy("rank").collect()
    assert [x.run_id for x in r] == ["y", "x"]


def test_long_run_names_stay_apart():
    a, b = ({"rl.cols": ["column"] * 40 + [x]} for x in "ab")
    assert len(sp.run_name(a)) <= 120 and sp.run_name(a) != sp.run_name(b)


def test_ranks_over_ranges_equal_one_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, float(rng.randrange(40)), rng.random()])) for i in range(3000)]
    got = {r.run_id: r["rank"] for r in mt.score_runs(spark.createDataFrame(rows, "run_id int, x double"), {"x": 2.0}).collect()}
    order = sorted(rows, key=lambda r: (-(r[1] or 0.0) * 2.0, r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    assert mt.score_runs(spark.createDataFrame([], "run_id int, x double"), {"x": 2.0}).count() == 0
