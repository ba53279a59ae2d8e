import datetime as dt
import random

from panelspark.operators.rolling import trailing_totals

SCHEMA = "ticker string, date date, ver int, close double, other double, day int"


def brute(rows, periods):
    best = {}
    for t, d, v, c, o, _ in rows:
        if t is None or d is None:
            continue
        if (t, d) not in best or v > best[(t, d)][0]:
            best[(t, d)] = (v, c, o)
    nan = lambda x: None if x is None or x != x else x
    out = {}
    for t in {k[0] for k in best}:
        days = [d for (a, d), x in best.items() if a == t and nan(x[1]) is not None]
        if not days:
            continue
        d = min(days)
        while d <= max(days):
            for p in periods:
                for i, name in ((1, "close"), (2, "other")):
                    vals = [nan(best[(t, x)][i]) for x in (d - dt.timedelta(k) for k in range(p)) if (t, x) in best]
                    vals = [x for x in vals if x is not None]
                    out[(t, d, name, p)] = (round(sum(vals), 6), len(vals)) if vals else (None, 0)
            d += dt.timedelta(1)
    return out


def check(spark, rows, periods=(7, 30)):
    df = spark.createDataFrame(rows, SCHEMA)
    got = trailing_totals(df, entity="ticker", day="date", version="ver", anchor="close", values=["close", "other"], periods=list(periods)).collect()
    flat = {}
    for r in got:
        for p in periods:
            for n in ("close", "other"):
                s = r[f"{n}_sum_{p}"]
                flat[(r.ticker, r.day, n, p)] = (None if s is None else round(s, 6), r[f"{n}_n_{p}"])
                assert r[f"{n}_avg_{p}"] is None if not r[f"{n}_n_{p}"] else abs(r[f"{n}_avg_{p}"] - s / r[f"{n}_n_{p}"]) < 1e-9
    assert len(got) * len(periods) * 2 == len(flat)
    assert flat == brute(rows, periods)


def test_against_brute_force(spark):
    rng = random.Random(3)
    start, rows = dt.date(2020, 1, 1), []
    for t in ("A", "B", "C"):
        for i in range(120):
            if rng.random() < 0.5:
                rows.append((t, start + dt.timedelta(i * (3 if t == "C" else 1)), 1, rng.choice([None, float("nan"), rng.random() * 100]), rng.choice([None, rng.random()]), 0))
    rows += [(r[0], r[1], 2, 7.0, None, 1) for r in rows[::17]] + rows[:5]
    check(spark, rows)


def test_nulls_empty_and_single(spark):
    check(spark, [])
    check(spark, [(None, dt.date(2020, 1, 1), 1, 1.0, 1.0, 0), ("A", None, 1, 1.0, 1.0, 0), ("B", dt.date(2020, 1, 1), 1, None, 2.0, 0)])
    check(spark, [("A", dt.date(2020, 1, 1), 1, 5.0, None, 0)])


def test_long_gap(spark):
    check(spark, [("A", dt.date(2020, 1, 1), 1, 5.0, 1.0, 0), ("A", dt.date(2020, 6, 1), 1, 6.0, 2.0, 0), ("A", dt.date(2020, 6, 20), 1, None, 3.0, 0)])
