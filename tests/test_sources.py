import json

import pytest
from pyspark.sql import functions as F

from panelspark.sources import files, paged
from panelspark.streaming import events as ev


def test_files(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", float("nan"))], "id int, s string, x double")
    files.write_parquet(df, f"{p}/t", by=["s"])
    assert files.read_parquet(spark, f"{p}/t", columns=["id"]).columns == ["id"]
    assert files.append_missing(df, f"{p}/out", ["id"]) == 2
    assert files.append_missing(df.union(df.withColumn("id", F.lit(3))), f"{p}/out", ["id"]) == 1 and spark.read.parquet(f"{p}/out").count() == 3
    files.write_jsonl(df, f"{p}/j")
    (tmp_path / "k.jsonl").write_text('{"id": 1}\n\n  \nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in files.read_jsonl(spark, f"{p}/k.jsonl", "id int").collect()) == [1, 2]
    assert files.read_jsonl(spark, f"{p}/j", "id int, x double").where("x IS NULL").count() == 1
    (tmp_path / "m.csv").write_text('#{"t": 1}\nr,l\n1.5,3\n')
    r = files.read_csv(spark, f"{p}/m.csv").first()
    assert (r.r, r.l, r.monitor_file) == (1.5, 3, "m.csv")
    files.write_csv(df, f"{p}/c")


def test_run_folders(spark, tmp_path):
    for i in ("r1", "r2"):
        paths = files.run_paths(str(tmp_path), i)
        (tmp_path / i).mkdir()
        with open(paths["run_row"], "w") as f:
            f.write(json.dumps({"run_id": i, "score": 1.0} | ({"extra": 2} if i == "r2" else {})))
    runs = files.read_runs(spark, str(tmp_path))
    assert runs.count() == 2 and "extra" in runs.columns and files.latest_run(runs).first().run_id == "r2"


def test_step_logs_and_bundles(spark, tmp_path):
    step = {"meta": {"episode_id": 1, "step_idx": 0, "date": "2020-01-01"}, "reward_components": {"log_return": 0.5}, "trading": {"executed_weights": [0.1, 0.9], "trade_cost": 2.0}}
    (tmp_path / "s.jsonl").write_text(json.dumps(step) + "\n")
    r = files.flatten_steps(files.read_jsonl(spark, f"{tmp_path}/s.jsonl", files.STEP_LOG)).first()
    assert r.episode_id == 1 and r["reward.log_return"] == 0.5 and r["trading.executed_weights"] == [0.1, 0.9]
    n = spark.createDataFrame([("w", "T", "d1"), ("w", "T", "d2"), ("w", "U", "d3")], "week string, ticker string, doc string")
    got = {r.ticker: (r.n_news, r.n_calls) for r in files.write_bundles(n, n.where("ticker = 'U'"), n.limit(0), f"{tmp_path}/b").collect()}
    assert got == {"T": (2, 0), "U": (1, 1)} and (tmp_path / "b" / "week=w" / "ticker=T").exists()


def test_paging_and_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return [{"a": 1}]

    assert paged.with_retries(flaky, wait_s=0.001) == [{"a": 1}] and len(calls) == 3
    with pytest.raises(OSError):
        paged.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), attempts=2, wait_s=0.001)
    reader = paged.PagedReader({"keys": '["A", "B", "C"]', "chunk": "2", "periods": json.dumps(paged.yearly(2020, 2021)), "fetch": "tests_fetch.fetch"}, ["k", "page"])
    assert len(reader.partitions()) == 4


def test_paged_source(spark, tmp_path):
    (tmp_path / "own_fetch.py").write_text("def fetch(keys, start, end, page):\n    return [{'k': k, 'y': start, 'page': page} for k in keys] if page < 2 else []\n")
    import sys

    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_fetch.py"))
    from panelspark.session import ship_package

    ship_package(spark)
    df = paged.read_paged(spark, "k string, y string, page int", fetch="own_fetch.fetch", keys=["A", "B", "C"], periods=paged.yearly(2020, 2021), chunk=2)
    assert df.count() == 12 and df.where("k = 'C' AND page = 1").count() == 2


def test_html(spark):
    html = "<table><tr><th>Symbol</th></tr><tr><td> <b>AB</b> </td><td>x\n y</td></tr></table>"
    rows = paged.html_cells(spark.createDataFrame([(html,)], "h string"), "h").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["Symbol"], ["AB", "x y"]]


def test_streams(spark, tmp_path):
    e = spark.sql("SELECT id, CAST(id % 3 AS STRING) AS k, timestamp_seconds(1700000000 + id * 3600) AS ts, CAST(id AS DOUBLE) AS v FROM range(200)")
    e.repartition(4).write.parquet(f"{tmp_path}/e")
    s = lambda: ev.read_events(spark, f"{tmp_path}/e", e.schema)
    got = ev.drain(ev.windowed_counts(s(), ts="ts", key="k"), "t", "complete").collect()
    assert sorted(got) == sorted(ev.windowed_counts(e, ts="ts", key="k").collect()) and sum(r.n for r in got) == 200
    assert ev.drain(ev.first_of_key(s(), ts="ts", keys=["k"], late="30 days"), "f").count() == 3
    z = ev.drain(ev.running_zscore(s(), key="k", order="id", value="v", window=5), "z")
    assert z.count() == 200
    one = ev.read_events(spark, next(str(p) for p in (tmp_path / "e").glob("part*")), e.schema)
    assert 0 < ev.drain(one.select("id"), "one").count() < 200


def test_cache_and_settings(spark, tmp_path, monkeypatch):
    from panelspark.config import env_bool, env_int

    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert files.cached(spark, f"{tmp_path}/c", build).count() == 3 and files.cached(spark, f"{tmp_path}/c", build).count() == 3 and len(made) == 1
    files.cached(spark, f"{tmp_path}/c", build, force=True)
    assert len(made) == 2
    monkeypatch.setenv("PS_A", " Yes ")
    monkeypatch.setenv("PS_B", "12x")
    assert env_bool("PS_A") and env_bool("PS_NONE", True) and not env_bool("PS_NONE") and env_int("PS_B", 7) == 7
