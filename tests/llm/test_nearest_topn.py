import glob
import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from panelspark.llm.nearest import nearest_pairs
from panelspark.llm.topn import ScanReport, _scan_file, top_n_per_group
from panelspark.session import shared_dir

L, R = "k string, ts long, lid string, b int", "k string, ts long, rid string, e string"


def pairs(spark, left, right, tol, entity="k", salts=1):
    a, b = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    got = nearest_pairs(a, b, left_id="lid", right_id="rid", left_time="ts", right_time="ts", entity=entity, tolerance_s=tol, salts=salts)
    rows = [(r.left_id, r.right_id, r.distance_s) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(left, right, tol, entity=True):
    out = set()
    for k, t, i, _ in left:
        c = [(abs(t - u), j) for q, u, j, _ in right if None not in (k, t, i, q, u, j) and (q == k or not entity)] if None not in (k, t, i) else []
        if c and min(c)[0] <= tol:
            out |= {(i, j, d) for d, j in c if d == min(c)[0]}
    return out


@pytest.mark.parametrize("salts", [1, 5])
def test_against_brute_force(spark, salts):
    rng = random.Random(salts)
    key = lambda: rng.choice(["A", "A", "A", "B", None])
    left = [(key(), rng.choice([None, rng.randrange(3000)]), f"l{i}", 0) for i in range(300)]
    right = [(key(), rng.choice([None, rng.randrange(3000)]), f"r{i % 90}", "x") for i in range(120)]
    left += left[:20]
    for tol in (0, 7, 100):
        assert pairs(spark, left, right, tol, salts=salts) == brute(left, right, tol)
    whole = [(r[0] or "Z", *r[1:]) for r in left], [(r[0] or "Z", *r[1:]) for r in right]
    assert pairs(spark, *whole, 50, entity=None, salts=salts) == brute(*whole, 50, entity=False)


def test_ties_borders_and_empty(spark):
    left = [("A", 100, "l", 0)]
    assert pairs(spark, left, [("A", 90, "p", ""), ("A", 110, "q", ""), ("A", 110, "q2", "")], 10) == {("l", "p", 10), ("l", "q", 10), ("l", "q2", 10)}
    assert pairs(spark, left, [("A", 89, "p", "")], 10) == set()
    assert pairs(spark, left, [], 10) == set() and pairs(spark, [], [("A", 1, "p", "")], 10) == set()
    assert pairs(spark, [("A", -5, "l", 0)], [("A", -8, "p", ""), ("A", 3, "q", "")], 10) == {("l", "p", 3)}


def top(spark, rows, n=3):
    df = spark.createDataFrame(rows, "g string, d string, s long, i string, grp string, score string")
    got = [(r.g, r.d, r.rank_no, r.item) for r in top_n_per_group(df, group=["g", "d"], score="s", item="i", n=n).collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute_top(rows, n=3):
    best = {}
    for g, d, s, i, *_ in rows:
        if None not in (g, d, s, i):
            best.setdefault((g, d), {})
            best[(g, d)][i] = max(s, best[(g, d)].get(i, s))
    return {(g, d, k + 1, i) for (g, d), x in best.items() for k, (i, _) in enumerate(sorted(x.items(), key=lambda y: (-y[1], y[0]))[:n])}


def test_top_n(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["1", "2"]), rng.choice([None, rng.randrange(50)]), rng.choice([None, f"i{rng.randrange(400)}"]), "x", "y") for _ in range(3000)]
    for n in (1, 3, 7):
        assert top(spark, rows, n) == brute_top(rows, n)
    assert top(spark, []) == set()


def test_row_groups_are_skipped(tmp_path):
    rows = pd.DataFrame({"grp": ["a"] * 1000 + ["b"] * 10, "score": [*range(1000, 0, -1), *range(10, 0, -1)], "item": [f"{i:04}" for i in range(1010)]})
    pq.write_table(pa.Table.from_pandas(rows, preserve_index=False), tmp_path / "x.parquet", row_group_size=100)
    got, read, skipped = _scan_file(f"file://{tmp_path}/x.parquet", 3)
    assert skipped == 9 and read == 2
    assert list(got.sort_values(["grp", "score"], ascending=[True, False])["score"]) == [1000, 999, 998, 10, 9, 8]


def test_a_hot_group_is_split_and_skipped(spark):
    """A third of all rows in one group: several files hold it, most of its row groups are skipped, and the result stays exact."""
    rows = [("hot" if i % 3 == 0 else f"g{i % 11}", "1", (i * 7919) % 10_007, f"i{i:06}", "", "") for i in range(240_000)]
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    keep = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        df = spark.createDataFrame(rows, "g string, d string, s long, i string, grp string, score string").repartition(8)
        report = ScanReport(spark)
        got = {(r.g, r.d, r.rank_no, r.item) for r in top_n_per_group(df, group=["g", "d"], score="s", item="i", n=5, report=report).collect()}
        assert got == brute_top(rows, 5)
        assert report.files.value > 1 and report.skipped.value > report.read.value
        assert not glob.glob(f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/topn-*")
    finally:
        spark.conf.set(key, keep)


def test_row_group_of_several_full_groups_is_skipped(tmp_path):
    """Two sorted runs in one file: the second run's groups are all full when it is met."""
    rows = pd.DataFrame({"grp": ["a"] * 5 + ["b"] * 5 + ["a"] * 5 + ["b"] * 4 + ["c"], "score": [9] * 10 + [3] * 10, "item": [f"{i:02}" for i in range(20)]})
    for last, want in ((20, (2, 0)), (19, (1, 1))):
        pq.write_table(pa.Table.from_pandas(rows[:last], preserve_index=False), tmp_path / "y.parquet", row_group_size=10)
        assert _scan_file(f"file://{tmp_path}/y.parquet", 3)[1:] == want
