import random

from panelspark.operators import timejoin as tj


def test_asof_against_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randrange(-50, 1000)]), i, "x") for i in range(400)]
    right = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(-50, 1000)]), rng.choice([None, rng.randrange(9)]), "y") for _ in range(150)]
    lf, rf = spark.createDataFrame(left, "k string, t long, id int, v string"), spark.createDataFrame(right, "k string, u long, v int, id string")
    for tol, exact, block in ((None, True, 100), (60, True, 37), (60, False, 1000), (0, True, 10)):
        got = tj.asof_backward(lf.drop("v"), rf, by=["k"], left_ts="t", right_ts="u", values=["v"], tolerance_s=tol, exact=exact, block_s=block).collect()
        assert len(got) == len(left)
        want = {}
        for k, t, i, _ in left:
            c = [(u, -1 if v is None else v, v) for q, u, v, _ in right if k is not None and t is not None and q == k and u is not None and (u <= t if exact else u < t)]
            best = max(c, key=lambda x: x[:2]) if c else None
            want[i] = (best[0], best[2]) if best and (tol is None or t - best[0] <= tol) else (None, None)
        assert {r.id: (r.asof_ts, r.v) for r in got} == want


def test_windows(spark):
    rows, wins = [("a", t) for t in (0, 5, 10, 11, 20, 21)] + [("a", None)], [("w1", 0, 10), ("w2", 10, 20), ("bad", None, 3)]
    r, w = spark.createDataFrame(rows, "k string, t long"), spark.createDataFrame(wins, "w string, s long, e long")
    for block in (3, 7, 1000):
        got = {(x.t, x.w) for x in tj.assign_windows(r, w, ts="t", start="s", end="e", block_s=block).collect()}
        assert got == {(5, "w1"), (10, "w1"), (11, "w2"), (20, "w2")}
        got = {(x.t, x.w) for x in tj.assign_windows(r, w, ts="t", start="s", end="e", closed_left=True, block_s=block).collect()}
        assert got == {(0, "w1"), (5, "w1"), (10, "w1"), (10, "w2"), (11, "w2"), (20, "w2")}


def test_lookback_kinds_and_rollback(spark):
    left = spark.createDataFrame([("a", 100)], "k string, t long")
    right = spark.createDataFrame([("a", 50, "q", "d1"), ("a", 95, "k", "d2"), ("a", 99, "k", "d3")], "k string, u long, form string, doc string")
    p = tj.lookback_pick(left, right.where("form = 'q'"), by=["k"], left_ts="t", right_ts="u", values=["doc"], narrow_s=10, wide_s=60).first()
    assert (p.doc, p.within_narrow) == ("d1", False)
    picks = tj.latest_per_kind(left, right, by=["k"], left_ts="t", right_ts="u", kind="form", kinds={"q": 60, "k": 60, "z": 5}, values=["doc"]).first().picks
    assert [(x.kind, x.doc) for x in picks] == [("q", "d1"), ("k", "d3")]
    now = spark.createDataFrame([("A",), ("B",)], "m string")
    log = spark.createDataFrame([("A", 5, "add"), ("C", 6, "remove"), ("C", 8, "add"), ("B", 2, "add"), ("D", 9, "remove")], "m string, ts long, act string")
    got = {r.m for r in tj.membership_on(now, log, member="m", ts="ts", action="act", at=4).collect()}
    assert got == {"B", "C", "D"}


def test_no_look_ahead(spark):
    """Cutting the input after a moment changes no row up to it."""
    rng = random.Random(4)
    left = [("a", t) for t in range(0, 500, 7)]
    right = [("a", rng.randrange(500), i) for i in range(60)]
    lf = spark.createDataFrame(left, "k string, t long")
    run = lambda rs: {r.t: r.v for r in tj.asof_backward(lf, spark.createDataFrame(rs, "k string, u long, v int"), by=["k"], left_ts="t", right_ts="u", values=["v"]).collect()}
    whole, cut = run(right), run([r for r in right if r[1] <= 250])
    assert all(whole[t] == cut[t] for t in whole if t <= 250)
