import datetime as dt
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.operators import observe as ob
from panelspark.operators import pipeline as pl
from panelspark.plans import panels


def test_synthetic_panel_is_reproducible(spark):
    a = ob.synthetic_panel(spark, periods=30, entities=["A", "B"], technical=["x"], seed=3)
    assert sorted(a.collect()) == sorted(a.repartition(7).collect()) and a.where("close <= 0").count() == 0
    assert sorted(a.collect()) != sorted(ob.synthetic_panel(spark, periods=30, entities=["A", "B"], technical=["x"], seed=4).collect())


def test_observations_match_numpy(spark):
    p = ob.synthetic_panel(spark, periods=25, entities=["A", "B", "C"], technical=["x", "llm"], seed=1).withColumn("turb", F.col("day_idx") * 0.1)
    got = {r.day_idx: r for r in ob.observations(p, period="day_idx", entity="ticker", technical=["close"], ranked=["x"], text=["llm"], market=["turb"], window=6, history=3).collect()}
    assert sorted(got) == list(range(7, 25))
    t = p.toPandas().pivot(index="day_idx", columns="ticker", values="close").sort_index()
    z = (t - t.rolling(6, min_periods=1).mean()) / (t.rolling(6, min_periods=1).std(ddof=0) + 1e-12)
    for i in (7, 15, 24):
        for k, e in enumerate("ABC"):
            assert np.allclose(got[i].trading[k], z[e].loc[i - 2 : i]) and len(got[i].valuation[k]) == 2
        assert got[i].entities == ["A", "B", "C"] and abs(got[i].market[0] - i * 0.1) < 1e-9


def test_checks_rounding_and_reshapes(spark):
    df = spark.createDataFrame([(1.0, [0.12345, 2.0]), (float("nan"), [float("inf")]), (None, None), (float("-inf"), [])], "x double, a array<double>")
    c = ob.numeric_check(df, ["x"]).first()
    assert (c.x_null, c.x_nan, c.x_inf) == (1, 1, 1)
    assert [(r.x, r.a) for r in ob.rounded(df).collect()] == [(1.0, [0.1234, 2.0]), (None, [None]), (None, None), (None, [])]
    h = ob.heatmap(spark.createDataFrame([("w", [0.0, 0.1, 0.9])], "week string, w array<double>"), "w", 0.5).collect()
    assert [round(r.shade, 6) for r in sorted(h, key=lambda r: r.position)] == [0.0, 0.1, 0.5]
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2, "y")], "k int, v string")
    assert ob.key_difference(a, b, ["k"]).where("k IS NOT NULL").collect() == [(1,)] and ob.key_intersection(a, b, ["k"]).collect() == [(2,)]
    assert sorted(r.k for r in ob.key_union([a, b], "k").collect()) == [1, 2] and ob.union_named([a, b]).count() == 5
    assert ob.pivot_wide(spark.createDataFrame([("d", "A", 1.0)], "d string, t string, v double"), period="d", entity="t", value="v", entities=["A", "B"]).first().asDict() == {"d": "d", "A": 1.0, "B": None}


def test_resampling_and_history(spark):
    days = [dt.date(2024, 1, 4) + dt.timedelta(i) for i in range(5)]  # Thursday to Monday
    df = spark.createDataFrame([("A", d, float(i), float(i), float(i), float(i), 1.0) for i, d in enumerate(days)], "ticker string, date date, open double, high double, low double, close double, volume double")
    got = {str(r.week): (r.open, r.close, r.volume) for r in ob.resample_friday(df).collect()}
    assert got == {"2024-01-05": (0.0, 1.0, 2.0), "2024-01-12": (2.0, 4.0, 3.0)}
    h = ob.history_rows(df, ["close"], by="ticker", order="date", k=3).orderBy("date").collect()
    assert [[x.close for x in r.history] for r in h][-1] == [2.0, 3.0, 4.0]
    cci = ob.older_indicators(df, short=3, long=4).toPandas().sort_values("date")["cci"].to_numpy()
    assert np.isnan(cci[0]) and abs(cci[-1] - (4 - 3) / (0.015 * 2 / 3)) < 1e-9


def test_technical_guard(spark):
    rows = [("w", "A", [("a", 1.0), ("b", 2.0)]), ("w", "B", [("a", 1.0)] * 3 + [("b", None)]), ("w", "C", [("a", 1.0)] * 3 + [("b", 1.05)])]
    df = spark.createDataFrame(rows, "week string, ticker string, history array<struct<week: string, close: double>>")
    got = {r.ticker: r for r in pl.technical_rows(df, keys=["week", "ticker"], columns=["close"]).collect()}
    assert got["A"].tech_summary == "" and got["B"].tech_signal == 0 and abs(got["C"].tech_signal - 100 * np.log(1.05)) < 1e-9


def test_tones_and_contexts(spark):
    news = spark.createDataFrame([("w", "A", 5, "0", 1, "sales rose and margins improved", 1.0), ("w", "A", 3, "0", 2, "costs fell", 2.0), ("w", "B", 1, "0", 3, " ", 1.0)], "week string, ticker string, ts long, day string, id int, text string, score double")
    ctx = pl.weekly_context(news, week="week", ticker="ticker", ts="ts", day="day", item="id", text="text", score="score")
    got = {r.ticker: r.context for r in ctx.collect()}
    assert got["A"] == "costs fell\n---\nsales rose and margins improved"
    out = {r.ticker: r for r in pl.analysed(ctx, ["week", "ticker"], "context", "news").collect()}
    assert abs(out["A"].news_signal - 10 / 3) < 1e-3 and out["B"].news_rationale == "NO_MEANINGFUL_NEWS" and out["B"].news_confidence == 0
    two = pl.two_sided(ctx, ["week", "ticker"], "context").where("ticker = 'A'").first()
    assert two.bull_signal - two.bear_signal == 2 and two.bull_rationale == two.bear_rationale


def test_panels(spark):
    weeks = spark.createDataFrame([("w1", 0, 100), ("w2", 100, 200)], "week string, w_start long, w_end long")
    names = spark.createDataFrame([("A",), ("B",), ("A",)], "ticker string")
    ev = lambda p: spark.createDataFrame([("A", 50, 4.0, 2.0, 0.5)], f"ticker string, ts long, {p}_signal double, {p}_risk_score double, {p}_confidence double")
    news = spark.createDataFrame([("w2", "A", -3.0, 1.0, 1.0, "r")], "week string, ticker string, news_signal double, news_risk_score double, news_confidence double, news_rationale string")
    tech = spark.createDataFrame([], "week string, ticker string, tech_signal double, tech_risk_score double, tech_confidence double, tech_summary string")
    p = pl.tier1_panel(weeks, names, calls=ev("ec"), filings=ev("sec").limit(0), news=news, technical=tech)
    got = {(r.week, r.ticker): r for r in p.collect()}
    assert len(got) == 4 and got[("w1", "A")].n_sources == 1 and got[("w2", "A")].n_sources == 2 and got[("w2", "A")].sign_disagreement
    assert got[("w1", "B")].ec_signal == 0 and got[("w1", "B")].tech_summary == ""
    t = {(r.week, r.ticker): r for r in pl.tier2_panel(p, ["ec", "sec", "news", "tech"]).collect()}
    want = (4.0 * 0.5 - 3.0) / 1.5
    assert len(t) == 4 and abs(t[("w2", "A")].business_signal - want) < 1e-3 and t[("w1", "B")].judge_signal == 0
    ctx = json.loads(p.where("week = 'w2' AND ticker = 'A'").select(pl.context_json(["ec", "news"]).alias("c")).first().c)
    assert ctx["ec"]["signal"] == 4.0 and pd.isna(ctx.get("none"))


def test_filings_are_read_in_both_sections(spark, tmp_path):
    day = dt.date(2024, 1, 4)
    rows = [("A", "both", day, "sales rose", "costs fell and demand weakened"), ("A", "risks", day, None, "margins improved"), ("A", "blank risks", day, " ", "orders fell"), ("A", "none", day, None, " ")]
    spark.createDataFrame(rows, "ticker string, doc_id string, filing_date date, management_discussion string, risk_factors string").write.parquet(str(tmp_path / "sec.parquet"))
    got = {r.doc_id: (round(r.sec_signal, 3), round(r.sec_risk_score, 3), round(r.sec_confidence, 3)) for r in panels.filing_signals(spark, str(tmp_path)).collect()}
    assert got == {"both": (-3.333, 6.667, 0.3), "risks": (10.0, 0.0, 0.1), "blank risks": (-10.0, 10.0, 0.1), "none": (0.0, 0.0, 0.0)}
