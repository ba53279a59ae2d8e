"""Queries over source tiers, scores, selections and universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import selection as sel
from panelspark.plans.base import BARS, bars, chain, num, sql_num
from panelspark.sources.tables import table

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# Articles with a time: documents, ten minutes per step of doc_id, grouped by week.
ARTICLES = """
articles AS (SELECT doc_id, source, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tok_len, doc_id * 600 AS ts,
  (doc_id * 600) // 604800 AS week, ((doc_id * 600) // 604800 + 1) * 604800 AS w_end, (doc_id * 600) // 86400 AS day FROM documents)"""
TIERS = """
cnt AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
tiers AS (SELECT source, n, ntile(3) OVER (ORDER BY n DESC, source) AS t FROM cnt)"""


def articles(spark, d):
    x = table(spark, d, "documents", "doc_id", "source", "text")
    ts = F.col("doc_id") * 600
    n = F.length(F.coalesce("text", F.lit("")))
    return x.select("doc_id", "source", n.cast("long").alias("n_chars"), F.floor(n / 4).alias("tok_len"), ts.alias("ts"), F.floor(ts / 604800).alias("week"), ((F.floor(ts / 604800) + 1) * 604800).alias("w_end"), F.floor(ts / 86400).alias("day"))


def tiered(spark, d):
    x = articles(spark, d)
    return sel.attach_tiers(x, sel.source_tiers(table(spark, d, "documents", "source")))


@query("WITH c AS (SELECT source, count(*) AS n FROM news WHERE source IS NOT NULL GROUP BY source) SELECT source, n, CAST(['A','B','C'][t] AS VARCHAR) AS source_tier, CAST(4 - t AS INTEGER) AS source_score FROM (SELECT source, n, ntile(3) OVER (ORDER BY n DESC, source) AS t FROM c)")
def source_terciles(spark, d):
    return sel.source_tiers(table(spark, d, "news", "source"))


@query("WITH c AS (SELECT source, count(*) AS n FROM news WHERE source IS NOT NULL GROUP BY source), r AS (SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INTEGER) AS rank, count(*) OVER () AS k FROM c) SELECT source, n, rank FROM r WHERE rank <= floor(k * 0.15)")
def source_whitelist(spark, d):
    return sel.source_whitelist(table(spark, d, "news", "source"))


@query(chain(ARTICLES, TIERS) + """, wl AS (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS r, count(*) OVER () AS k FROM cnt) WHERE r <= floor(k * 0.15)),
r AS (SELECT a.*, wl.source IS NOT NULL AS listed FROM articles a LEFT JOIN wl ON a.source = wl.source),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY week ORDER BY listed DESC, ts DESC, doc_id) AS INTEGER) AS pos FROM r) SELECT week, doc_id, listed, pos FROM p WHERE pos <= 10""")
def whitelist_context(spark, d):
    wl = sel.source_whitelist(table(spark, d, "documents", "source"))
    return sel.whitelist_context(articles(spark, d), wl, group=["week"], ts="ts", item="doc_id", most=10).select("week", "doc_id", "listed", "pos")


_V1 = """, scored AS (SELECT a.*, coalesce(4 - t.t, 1) AS src, exp(-ln(2) * ((w_end - ts) / 86400.0::DOUBLE) / 7) AS rec FROM articles a LEFT JOIN tiers t ON a.source = t.source),
v1 AS (SELECT *, 0.5::DOUBLE * rec + 0.2::DOUBLE * CASE WHEN max(tok_len) OVER w <= min(tok_len) OVER w THEN 1 ELSE (tok_len - min(tok_len) OVER w) / (max(tok_len) OVER w - min(tok_len) OVER w)::DOUBLE END + 0.3::DOUBLE * (src / 3.0::DOUBLE) AS score FROM scored WINDOW w AS (PARTITION BY week))"""


def scored_v1(spark, d):
    return sel.score_v1(tiered(spark, d), group=["week"], ts="ts", end="w_end", length="tok_len", src_score="source_score")


@query(chain(ARTICLES, TIERS) + _V1 + f" SELECT doc_id, week, {sql_num('rec', 'rec')}, {sql_num('score', 'score')} FROM v1")
def news_score_v1(spark, d):
    return scored_v1(spark, d).select("doc_id", "week", num("rec", "rec"), num("score", "score"))


@query(chain(ARTICLES, TIERS) + f", s AS (SELECT a.*, coalesce(t.t, 3) AS t FROM articles a LEFT JOIN tiers t ON a.source = t.source) SELECT doc_id, week, {sql_num('CASE t WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END::DOUBLE + 0.5 * least(n_chars / 256.0::DOUBLE, 2.0) + pow(0.5::DOUBLE, (w_end - ts) / 259200.0::DOUBLE)', 'score')} FROM s")
def news_score_v2(spark, d):
    x = tiered(spark, d)
    s = sel.score_v2(tier=F.col("source_tier"), n_chars=F.col("n_chars"), ts=F.col("ts"), end=F.col("w_end"))
    return x.select("doc_id", "week", num(s, "score"))


@query(chain(ARTICLES, TIERS) + """, d AS (SELECT DISTINCT day, week FROM articles) SELECT a.week AS week, count(*) AS n, CAST(count(*) FILTER (coalesce(t.t, 3) = 1) AS BIGINT) AS n_a, CAST(count(*) FILTER (t.t = 2) AS BIGINT) AS n_b, CAST(count(*) FILTER (coalesce(t.t, 3) = 3) AS BIGINT) AS n_c,
CAST(avg(4 - coalesce(t.t, 3)) AS DOUBLE) AS avg_score, CAST(max(4 - coalesce(t.t, 3)) AS INTEGER) AS max_score, count(DISTINCT a.day) AS n_days, CAST(sum(a.tok_len) AS BIGINT) AS tokens FROM articles a LEFT JOIN tiers t ON a.source = t.source GROUP BY a.week""")
def bundle_stats(spark, d):
    return tiered(spark, d).groupBy("week").agg(F.count("*").alias("n"), *[F.count_if(F.col("source_tier") == t).alias(f"n_{t.lower()}") for t in "ABC"], F.avg("source_score").alias("avg_score"), F.max("source_score").alias("max_score"), F.count_distinct("day").alias("n_days"), F.sum("tok_len").alias("tokens"))


def _capped(spark, d):
    return sel.cap_select(scored_v1(spark, d), group=["week"], source="source", day="day", item="doc_id", order=["score", "rec", "ts", "tok_len"], per_source=5, per_day=4)


# The walk as a recursion: one step per article, the picked ones as a list.
_WALK = """, o AS (SELECT week, coalesce(source, '') AS source, day, doc_id, score, row_number() OVER (PARTITION BY week ORDER BY score DESC, rec DESC, ts DESC, tok_len DESC, doc_id) AS rn FROM v1),
w AS (SELECT week, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(source VARCHAR, day BIGINT, doc_id BIGINT, score DOUBLE)[]) AS p FROM (SELECT DISTINCT week FROM o)
  UNION ALL SELECT w.week, o.rn, CASE WHEN len(list_filter(w.p, lambda x: x.source = o.source)) < 5 AND len(list_filter(w.p, lambda x: x.day = o.day)) < 4
    THEN list_append(w.p, {'source': o.source, 'day': o.day, 'doc_id': o.doc_id, 'score': o.score}) ELSE w.p END FROM w JOIN o ON o.week = w.week AND o.rn = w.rn + 1),
f AS (SELECT week, arg_max(p, rn) AS p FROM w GROUP BY week)"""
_WALKED = "WITH RECURSIVE " + ",".join((ARTICLES, TIERS)) + _V1 + _WALK


@query(_WALKED + f", u AS (SELECT week, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS pos, unnest(p) AS x FROM f) SELECT week, pos, x.doc_id AS doc_id, {sql_num('x.score', 'score')} FROM u")
def greedy_dual_cap(spark, d):
    return _capped(spark, d).select("week", F.posexplode("picked").alias("pos", "p")).select("week", (F.col("pos") + 1).alias("pos"), F.col("p.item").alias("doc_id"), num("p.score", "score"))


@query(_WALKED + f""", g AS (SELECT week, p, list_filter(p, lambda x: x.score >= 0.3) AS good, CAST(greatest(3, least(12, round_even(3 + 9 * (1 - exp(-len(p) / 10.0::DOUBLE)), 0))) AS BIGINT) AS n FROM f),
k AS (SELECT week, CASE WHEN len(good) < 3 THEN p[1:3] ELSE good[1:n] END AS q FROM g), u AS (SELECT week, CAST(unnest(range(1, len(q) + 1)) AS INTEGER) AS rank, unnest(q) AS x FROM k) SELECT week, rank, x.doc_id AS doc_id, {sql_num('x.score', 'score')} FROM u""")
def dynamic_topn(spark, d):
    return sel.dynamic_top(_capped(spark, d), group=["week"]).select("week", "rank", F.col("item").alias("doc_id"), num("score", "score"))


# Both phases of the budget as recursions over (chars used, articles, articles of the day, picks).
_BUDGET = """, b AS (SELECT a.week, a.day, a.ts, a.doc_id, least(a.n_chars, 2000) AS cost, CASE coalesce(t.t, 3) WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END::DOUBLE + 0.5 * least(a.n_chars / 256.0::DOUBLE, 2.0) + pow(0.5::DOUBLE, (a.w_end - a.ts) / 259200.0::DOUBLE) AS score
  FROM articles a LEFT JOIN tiers t ON a.source = t.source WHERE a.n_chars >= 40),
o1 AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY day, score DESC, ts DESC, doc_id) AS rn FROM b),
w1 AS (SELECT week, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS day, 0 AS k, CAST([] AS BIGINT[]) AS p FROM (SELECT DISTINCT week FROM b)
  UNION ALL SELECT week, rn, CASE WHEN pick THEN used + cost ELSE used END, nday, CASE WHEN pick THEN nk + 1 ELSE nk END, CASE WHEN pick THEN list_append(p, doc_id) ELSE p END
  FROM (SELECT *, len(p) < 20 AND nk < 3 AND NOT (used > 0 AND used + cost > 12000) AS pick FROM (SELECT w1.week, o1.rn, w1.used, o1.day AS nday, CASE WHEN o1.day = w1.day THEN w1.k ELSE 0 END AS nk, w1.p, o1.cost, o1.doc_id FROM w1 JOIN o1 ON o1.week = w1.week AND o1.rn = w1.rn + 1))),
f1 AS (SELECT week, arg_max(used, rn) AS used, arg_max(p, rn) AS p FROM w1 GROUP BY week),
o2 AS (SELECT b.*, row_number() OVER (PARTITION BY b.week ORDER BY score DESC, ts DESC, doc_id) AS rn FROM b JOIN f1 ON b.week = f1.week WHERE NOT list_contains(f1.p, b.doc_id)),
w2 AS (SELECT week, CAST(0 AS BIGINT) AS rn, used, p FROM f1
  UNION ALL SELECT week, rn, CASE WHEN pick THEN used + cost ELSE used END, CASE WHEN pick THEN list_append(p, doc_id) ELSE p END
  FROM (SELECT *, len(p) < 20 AND used < 12000 AND NOT (used > 0 AND used + cost > 12000) AS pick FROM (SELECT w2.week, o2.rn, w2.used, w2.p, o2.cost, o2.doc_id FROM w2 JOIN o2 ON o2.week = w2.week AND o2.rn = w2.rn + 1))),
f2 AS (SELECT week, arg_max(p, rn) AS p FROM w2 GROUP BY week), u AS (SELECT week, unnest(p) AS doc_id FROM f2)"""


@query("WITH RECURSIVE " + ",".join((ARTICLES, TIERS)) + _BUDGET + " SELECT u.week AS week, u.doc_id AS doc_id, CAST(row_number() OVER (PARTITION BY u.week ORDER BY b.ts, u.doc_id) AS INTEGER) AS pick_no FROM u JOIN b ON b.week = u.week AND b.doc_id = u.doc_id")
def budgeted_context(spark, d):
    x = tiered(spark, d).where("n_chars >= 40")
    x = x.withColumn("score", sel.score_v2(tier=F.col("source_tier"), n_chars=F.col("n_chars"), ts=F.col("ts"), end=F.col("w_end")))
    return sel.budgeted_context(x, group=["week"], day="day", score="score", ts="ts", item="doc_id", n_chars="n_chars", per_article=2000).withColumnRenamed("item", "doc_id")


UNIVERSE = """
uni AS (SELECT s_suppkey AS entity, n_regionkey AS sector, avg(l_extendedprice * l_quantity) AS capital FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
liquid AS (SELECT * FROM uni WHERE capital >= (SELECT quantile_cont(capital, 0.2) FROM uni))"""


def universe(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(F.broadcast(table(spark, d, "nation", "n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    cap = sel.liquidity(table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity"), entity="l_suppkey", close="l_extendedprice", volume="l_quantity")
    x = cap.join(s, cap["l_suppkey"] == s["s_suppkey"]).select(F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("sector"), "capital")
    return sel.liquid_enough(x)


@query(chain(UNIVERSE) + f"SELECT entity, sector, {sql_num('capital', 'capital', 2)} FROM liquid")
def liquidity_filter(spark, d):
    return universe(spark, d).select("entity", "sector", num("capital", "capital", 2))


@query(chain(UNIVERSE) + """, c AS (SELECT sector, count(*) AS n FROM liquid GROUP BY sector), i AS (SELECT sector, n * 20 / (SELECT count(*) FROM liquid)::DOUBLE AS ideal FROM c),
s AS (SELECT sector, floor(ideal) + CASE WHEN row_number() OVER (ORDER BY ideal - floor(ideal) DESC, sector) <= 20 - sum(floor(ideal)) OVER () THEN 1 ELSE 0 END AS seats FROM i),
r AS (SELECT l.*, seats, row_number() OVER (PARTITION BY l.sector ORDER BY capital DESC, entity) AS seat FROM liquid l JOIN s USING (sector)) SELECT entity, sector, CAST(seat AS INTEGER) AS seat FROM r WHERE seat <= seats""")
def sector_allocation(spark, d):
    return sel.sector_allocation(universe(spark, d), entity="entity", sector="sector", capital="capital", size=20).select("entity", "sector", "seat")


@query(chain(UNIVERSE) + """, r AS (SELECT *, row_number() OVER (ORDER BY capital DESC, entity) AS r FROM liquid), m AS (SELECT *, r <= 2 AS top, max(CASE WHEN r <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY sector) AS seen FROM r),
f AS (SELECT *, CASE WHEN top THEN 0 WHEN seen = 0 AND row_number() OVER (PARTITION BY sector, top ORDER BY r) = 1 THEN 1 ELSE 2 END AS phase FROM m), p AS (SELECT *, row_number() OVER (ORDER BY phase, r) AS pick FROM f)
SELECT entity, sector, CAST(phase AS INTEGER) AS phase, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 10""")
def topn_diversified(spark, d):
    return sel.top_diversified(universe(spark, d), entity="entity", sector="sector", capital="capital", top_n=2, size=10).select("entity", "sector", "phase", "pick")


@query(chain(BARS) + "SELECT ticker, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, count(*) AS n FROM bars GROUP BY ticker UNION ALL SELECT 'SPY', NULL, NULL, NULL".replace("NULL, NULL, NULL", "'', '', 0"))
def ticker_spans_benchmark(spark, d):
    x = bars(spark, d).groupBy("ticker").agg(F.min("date").cast("string").alias("first_day"), F.max("date").cast("string").alias("last_day"), F.count("*").alias("n"))
    return sel.with_benchmark(x, "ticker").fillna({"first_day": "", "last_day": "", "n": 0})


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
