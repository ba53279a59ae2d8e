import random

import numpy as np

from panelspark.llm.mixture import Marginals, attainable, axis_shares, budgets, mix, rake, shares

DOCS, TARGETS = "doc_id long, n long, source string, lang string, kind string, copies int, part double", "source string, target_share double, max_repeats int, n int"
ARGS = {"key": "doc_id", "size": "n", "source": "source", "language": "lang", "topic": "kind"}


def corpus(seed=1, n=4000):
    rng = random.Random(seed)
    src = ["big"] * 6 + ["mid"] * 3 + ["small", None, "untargeted"]
    return [(i, rng.choice([None, 0, rng.randrange(20, 400), rng.randrange(20, 400), rng.randrange(20, 400)]), rng.choice(src), rng.choice(["en", "EN-us", "de", None, "??"]), rng.choice(["a", "b", None]), 9, 0.5) for i in range(n)]


def test_budgets():
    assert np.allclose(budgets(np.array([0.5, 0.5]), np.array([10.0, 100.0]), 60), [10, 50])
    assert np.allclose(budgets(np.array([0.5, 0.3, 0.2]), np.array([0.0, 100, 100]), 50), [0, 30, 20])
    assert np.allclose(budgets(np.array([0.5, 0.5]), np.array([10.0, 10.0]), 60), [10, 10])


def test_raking_meets_consistent_marginals():
    rng = np.random.default_rng(0)
    axes = [np.repeat([0, 1, 2], 4), np.tile([0, 1, 0, 1], 3), np.tile([0, 0, 1, 1], 3)]
    x = rng.uniform(1, 5, 12)
    goal = x * rng.uniform(0.5, 2, 12)
    wanted = [np.bincount(a, goal) for a in axes]
    got = rake(x, np.full(12, 1e9), axes, wanted)
    for a, w in zip(axes, wanted):
        assert np.allclose(np.bincount(a, got), w, rtol=1e-5)
    capped = rake(x, x * 1.2, axes, wanted)
    assert (capped <= x * 1.2 + 1e-9).all()


def test_mixture_reaches_targets_under_caps(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows + rows[:50], DOCS)
    targets = [("big", 0.5, 1, 0), ("mid", 0.3, 2, 0), ("small", 0.15, 2, 0), ("nowhere", 0.05, 3, 0), ("big", 0.5, 1, 0), (None, 0.1, 1, 0)]
    t = spark.createDataFrame(targets, TARGETS)
    m = mix(docs, t, **ARGS)
    got = m.collect()
    assert len(got) == len({r.doc_id for r in got})
    size, caps = {r[0]: r[1] for r in rows}, {"big": 1, "mid": 2, "small": 2}
    assert all(1 <= r.copies <= caps[r.source] and r.n_tokens == size[r.doc_id] for r in got)
    total = sum(r.n_tokens * r.copies for r in got)
    have = {s: sum(x[1] or 0 for x in rows if x[2] == s) for s in caps}
    want = dict(zip(caps, budgets(np.array([0.5, 0.3, 0.15]), np.array([have[s] * caps[s] for s in caps], float), sum(have.values()))))
    for s in caps:
        real = sum(r.n_tokens * r.copies for r in got if r.source == s)
        assert abs(real - want[s]) <= 0.01 * want[s] + 400
    assert sorted(got) == sorted(mix(docs, t, **ARGS).collect())
    rep = {r.source: r for r in shares(m, t.where("source IS NOT NULL")).collect()}
    assert rep["nowhere"].reached_share == 0 and abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9
    assert abs(rep["big"].n_tokens / total - rep["big"].reached_share) < 1e-9


def test_other_marginals_and_empty(spark):
    docs = spark.createDataFrame(corpus(2), DOCS)
    t = spark.createDataFrame([("big", 0.6, 1, 0), ("mid", 0.4, 2, 0)], TARGETS)
    m = mix(docs, t, **ARGS, total=100_000, marginals=Marginals(language={"en": 0.7, "de": 0.3}))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = m.collect()
    total = sum(r.n_tokens * r.copies for r in got)
    german = sum(r.n_tokens * r.copies for r in got if lang[r.doc_id] == "de")
    assert abs(total - 100_000) < 3000 and abs(german / total - 0.3) < 0.05
    assert mix(docs.limit(0), t, **ARGS).count() == 0 and mix(docs, t.limit(0), **ARGS).count() == 0


def test_attainable_marginals():
    """One source is all "x": no less of it than that source's budget, no more than the caps give."""
    source, axis, tokens = np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([50.0, 50, 100])
    caps, budget = np.array([2.0, 1.0]), np.array([80.0, 90.0])
    got = attainable(np.array([20.0, 150.0]), axis, source, tokens, caps, budget)
    assert np.allclose(got, [80, 90])
    got = attainable(np.array([100.0, 70.0]), axis, source, tokens, caps, budget)
    assert np.allclose(got, [100, 70])


def test_attainable_marginals_of_many_sources_and_categories():
    """The bounds hold whatever the number of sources and categories."""
    source, axis, tokens = np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([50.0, 50, 100])
    caps, budget, wanted = np.ones(2000), np.zeros(2000), np.zeros(1000)
    caps[0], budget[:2], wanted[:2] = 2.0, [80.0, 90.0], [20.0, 150.0]
    assert np.allclose(attainable(wanted, axis, source, tokens, caps, budget)[:3], [80, 90, 0])


def test_attainable_by_pairs_is_the_whole_table():
    rng = np.random.default_rng(4)
    for _ in range(20):
        source, axis, tokens = rng.integers(0, 7, 30), rng.integers(0, 5, 30), rng.uniform(1, 100, 30)
        caps, wanted = rng.integers(1, 4, 7).astype(float), rng.uniform(1, 200, 5)
        own = np.zeros((7, 5))
        np.add.at(own, (source, axis), tokens)
        whole = own.sum(1, keepdims=True)
        budget = rng.uniform(0, 1, 7) * caps * whole[:, 0]
        low = np.maximum(0, budget[:, None] - caps[:, None] * (whole - own)).sum(0)
        high = np.minimum(budget[:, None], caps[:, None] * own).sum(0)
        got = attainable(wanted, axis, source, tokens, caps, budget)
        assert (got >= low - 1e-9).all() and (got <= high + 1e-9).all() and np.isclose(got.sum(), budget.sum())
        inside = (got > low + 1e-6) & (got < high - 1e-6)
        assert np.allclose(got[inside] / wanted[inside], (got / wanted)[inside].mean() if inside.any() else 0)


def test_raking_is_not_source_scaling(spark):
    """By default languages and topics keep the corpus's shares although the sources change."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        s = rng.choice(["big", "big", "big", "small"])
        rows.append((i, rng.randrange(50, 150), s, "de" if rng.random() < (0.1 if s == "big" else 0.5) else "en", rng.choice(["a", "b"]), 0, 0.0))
    docs = spark.createDataFrame(rows, DOCS)
    t = spark.createDataFrame([("big", 0.5, 3, 0), ("small", 0.5, 4, 0)], TARGETS)
    m = mix(docs, t, **ARGS)
    rep = {(r.axis, r.category): r for r in axis_shares(m, docs, t, **ARGS).collect()}
    de = rep["language", "de"]
    assert abs(de.wanted_share - de.corpus_share) < 1e-6 and abs(de.mixed_share - de.wanted_share) < 0.01
    scaled = 0.5 * 0.1 + 0.5 * 0.5  # what scaling the sources alone would give
    assert abs(de.mixed_share - scaled) > 0.05
    got = shares(m, t).collect()
    assert all(abs(r.reached_share - 0.5) < 0.01 for r in got)
