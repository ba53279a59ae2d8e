"""Queries over JSON signals, vocabularies, chunks and the analyst pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import analyst as an
from panelspark.operators import signals as sg
from panelspark.operators.replies import SCHEMAS, validate
from panelspark.plans.base import num, sql_num
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


# Replies in every shape that occurs in the wild, built from each event's own value.
_SHAPES = [
    ('{"rl": {"signal": ', ', "risk_score": 3, "confidence": 0.7, "rationale": "a"}}'),
    ('{"signals": {"rl": {"signal": ', ', "risk_score": 12, "confidence": 1.5}}}'),
    ('{"sentiment_score": ', ', "event_risk_score": 2.5, "conf": 0.2, "reasoning": "b"}'),
    ('{"rl": [1], "ec_signal": ', ', "ec_risk_score": "4", "ec_confidence": "x"}'),
    ('{"result": {"rl": {"signal": "', '", "risk": 1}}, "signal": 9}'),
    ('{broken ', ''),
]


def replies(spark, d):
    e = table(spark, d, "events", "event_id", "value")
    v = F.floor(F.col("value") * 10).cast("bigint").cast("string")
    shape = F.coalesce(*[F.when(F.col("event_id") % 6 == i, F.concat(F.lit(a), v, F.lit(b))) for i, (a, b) in enumerate(_SHAPES)])
    return e.select("event_id", shape.alias("reply"))


_CASE = " ".join(f"WHEN event_id % 6 = {i} THEN '{a}' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || '{b}'" for i, (a, b) in enumerate(_SHAPES))


def _path(p: str) -> str:
    return f"CASE WHEN json_type(j, '{p}') = 'OBJECT' THEN json_extract(j, '{p}') END"


def _keys(name: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(o, '$.{k}')" for k in sg.SIGNAL_KEYS[name]) + ")"


@query(f"""WITH e AS (SELECT event_id, CASE {_CASE} END AS reply FROM events), p AS (SELECT event_id, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM e),
o AS (SELECT event_id, coalesce({', '.join(_path(p) for p in sg.SIGNAL_PATHS)}, j) AS o FROM p),
x AS (SELECT event_id, coalesce(try_cast({_keys('signal')} AS DOUBLE), 0) AS s, coalesce(try_cast({_keys('risk_score')} AS DOUBLE), 0) AS r, coalesce(try_cast({_keys('confidence')} AS DOUBLE), 0) AS c, coalesce({_keys('rationale')}, '') AS rationale FROM o),
k AS (SELECT event_id, least(greatest(s, -10), 10) AS s, least(greatest(r, 0), 10) AS r, least(greatest(c, 0), 1) AS c, rationale FROM x)
SELECT event_id, {sql_num('s', 'signal')}, {sql_num('r', 'risk_score')}, {sql_num('c', 'confidence')}, rationale,
CASE WHEN s <= -7.5 THEN 'strongly_negative' WHEN s <= -3.5 THEN 'negative' WHEN s < 3.5 THEN 'neutral' WHEN s < 6.5 THEN 'positive' ELSE 'strongly_positive' END AS signal_label,
CASE WHEN r < 2.5 THEN 'low' WHEN r < 5.5 THEN 'moderate' WHEN r < 7.5 THEN 'high' ELSE 'severe' END AS risk_label FROM k""")
def json_signal_extract(spark, d):
    x = sg.clamp_pack(sg.extract_signal(replies(spark, d), "reply"))
    return x.select("event_id", num("signal", "signal"), num("risk_score", "risk_score"), num("confidence", "confidence"), "rationale", sg.signal_label(F.col("signal")).alias("signal_label"), sg.risk_label(F.col("risk_score")).alias("risk_label"))


# What each spelling must become, written out here and not taken from the operator.
# "a b c > d": a, b and c become d; what isn't listed becomes the value after "else".
_EXPECTED = {
    "category": "market market_risk macroeconomic macro > macro; regulatory_risk regulatory > regulatory; legal lawsuit litigation > litigation; currency fx_risk fx > fx; competition_risk competition > competition; security cybersecurity cyber > cyber; liquidity_risk liquidity > liquidity; covenant_risk covenant > covenant; execution_risk execution > execution; tech technology_risk technology > technology; governance_risk governance > governance; esg_risk esg > esg; supply_chain > supply_chain; credit > credit; tax > tax; reputation > reputation; else other",
    "factor": "currency fx_risk fx > fx; rates rate interest interest_rate > interest_rate; inflation_risk inflation > inflation; labor_market employment labor > labor; housing_market housing > housing; equity stock_market equity_market > equity_market; regulatory regulation > regulation; commodity > commodity; geography > geography; customer_concentration > customer_concentration; supplier_concentration > supplier_concentration; industry > industry; credit_spread > credit_spread; else other",
    "direction": "negative risk pressure drag challenging headwind > headwind; positive supportive benefit favorable tailwind > tailwind; else unclear",
    "severity": "high_risk severe high > high; low_risk low > low; else medium",
    "driver": "digital ai cloud platform online saas technology > technology; capital cost > cost; capital_efficiency efficiency > efficiency; margin price pricing_power pricing > pricing; marketing brand_investment brand > brand; distribution go_to_market gtm channel > channel; geo geography > geography; product > product; mix > mix; fx > fx; demand > demand; acquisition > acquisition; partnership > partnership; regulation > regulation; else other",
    "confidence": "strong high_confidence high > high; weak low_confidence low > low; else medium",
    "news_category": "earnings results q3_results q4_results > earnings; guidance outlook forecast > guidance; product launch products > product; mna m&a merger acquisition deal > mna; litigation lawsuit legal > litigation; regulatory regulation compliance > regulatory; macro market economy > macro; industry sector > industry; management leadership executive > management; financing capital > financing; else other",
    "short_category": "market market_risk macro > macro; regulatory_risk regulatory > regulatory; credit_risk credit > credit; liquidity_risk liquidity > liquidity; fx_risk currency fx > fx; technology_risk it technology > technology; governance_risk governance > governance; esg_risk esg > esg; litigation > litigation; supply_chain > supply_chain; competition > competition; cyber > cyber; covenant > covenant; execution > execution; tax > tax; reputation > reputation; else other",
    "short_severity": "high_risk high > high; low_risk low > low; else medium",
    "short_direction": "negative risk pressure drag headwind > headwind; positive supportive benefit tailwind > tailwind; else unclear",
    "short_driver": "digital ai cloud platform online technology > technology; capital cost > cost; capital_efficiency efficiency > efficiency; margin price pricing > pricing; marketing brand > brand; distribution go_to_market channel > channel; geo geography > geography; product > product; mix > mix; fx > fx; demand > demand; acquisition > acquisition; partnership > partnership; regulation > regulation; else other",
    "short_confidence": "strong high > high; weak low > low; else medium",
}


def _spelt(w: str) -> str:
    return w.replace("_results", " results")


_RULES = {v: [(r.partition(" > ")[0].split(), r.partition(" > ")[2]) for r in text.split("; ")[:-1]] for v, text in _EXPECTED.items()}
_WORDS = sorted({_spelt(w) for rules in _RULES.values() for words, _ in rules for w in words})
# in the forms that replies have: blanks around, other case, unknown words
_SPELLINGS = [*_WORDS, *(f" {w.upper()} " for w in _WORDS[::3]), *(w.title() for w in _WORDS[1::3]), "unknown thing", "", "moderate", "med", "medium_risk", "neutral", "mixed"]
_LIST = "[" + ", ".join(f"'{s}'" for s in _SPELLINGS) + "]"


def _enum_sql(v: str) -> str:
    cases = " ".join(f"WHEN s IN ({', '.join(repr(_spelt(w)) for w in words)}) THEN '{to}'" for words, to in _RULES[v])
    return f"CASE {cases} ELSE '{_EXPECTED[v].rpartition('else ')[2]}' END AS {v}"


@query(f"WITH o AS (SELECT o_orderkey, lower(trim({_LIST}[o_orderkey % {len(_SPELLINGS)} + 1])) AS s FROM orders) SELECT o_orderkey, {', '.join(_enum_sql(v) for v in _EXPECTED)} FROM o")
def enum_normalize(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    raw = F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("o_orderkey") % len(_SPELLINGS) + 1).cast("int"))
    return o.select("o_orderkey", *[sg.normalise_enum(raw, v).alias(v) for v in sg.ENUMS])


@query("""WITH g AS (SELECT l_orderkey, CAST(count(*) FILTER (l_quantity > 40) AS BIGINT) AS h, CAST(count(*) FILTER (l_quantity > 20 AND l_quantity <= 40) AS BIGINT) AS m, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(CASE WHEN h = 0 AND m <= 1 THEN 2.5 WHEN h <= 1 THEN 5.5 ELSE 9.0 END AS DOUBLE) AS rubric_risk, CAST(CASE WHEN s >= 2 * h + m + 2 THEN 6.0 WHEN 2 * h + m >= s + 2 THEN -7.0 ELSE 0.0 END AS DOUBLE) AS rubric_signal FROM g""")
def severity_rubric(spark, d):
    x = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_returnflag")
    sev = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    g = x.groupBy("l_orderkey").agg(F.collect_list(sev).alias("sev"), F.collect_list(F.when(F.col("l_returnflag") == "N", F.lit("s"))).alias("good"))
    return sg.rubric(g, F.col("sev"), F.col("good")).select("l_orderkey", F.col("rubric_risk").cast("double").alias("rubric_risk"), F.col("rubric_signal").cast("double").alias("rubric_signal"))


@query("""WITH m AS (SELECT l_suppkey AS doc, l_returnflag AS title, CASE WHEN l_quantity > 24 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS s FROM lineitem),
g AS (SELECT doc, title, count(*) AS n, CASE WHEN 2 * count(*) FILTER (s = 'high') > count(*) THEN 'high' WHEN count(*) FILTER (s = 'low') = count(*) THEN 'low' ELSE 'medium' END AS severity FROM m GROUP BY doc, title)
SELECT doc, title, n, severity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, title) AS rank FROM g) WHERE rank <= 3""")
def severity_reconcile(spark, d):
    x = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity")
    s = F.when(F.col("l_quantity") > 24, "high").when(F.col("l_quantity") > 10, "medium").otherwise("low")
    return sg.reconcile(x.select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("title"), s.alias("s")), doc="doc", title="title", severity="s", top=3).select("doc", "title", "n", "severity", "rank")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text, doc_id || md5(text) AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM ec WHERE text IS NOT NULL),
sp AS (SELECT id, doc_id, string_split(regexp_replace(flat, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM d WHERE flat <> ''),
s AS (SELECT id, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM sp),
r AS (SELECT id, i, 1 AS g, length(t) AS size FROM s WHERE i = 1
  UNION ALL SELECT s.id, s.i, CASE WHEN r.size + 1 + length(s.t) <= 2000 THEN r.g ELSE r.g + 1 END, CASE WHEN r.size + 1 + length(s.t) <= 2000 THEN r.size + 1 + length(s.t) ELSE length(s.t) END FROM r JOIN s ON s.id = r.id AND s.i = r.i + 1),
c AS (SELECT s.id, s.doc_id, s.i, s.t, r.g, sum(length(s.t) + 1) OVER (PARTITION BY s.id, r.g ORDER BY s.i DESC) AS back FROM s JOIN r ON s.id = r.id AND s.i = r.i),
own AS (SELECT id, any_value(doc_id) AS doc_id, g, string_agg(t, ' ' ORDER BY i) AS t FROM c GROUP BY id, g), tail AS (SELECT id, g, string_agg(t, ' ' ORDER BY i) AS t FROM c WHERE back <= 200 GROUP BY id, g)
SELECT DISTINCT o.doc_id AS doc_id, o.g AS chunk_no, concat_ws(' ', p.t, o.t) AS chunk FROM own o LEFT JOIN tail p ON p.id = o.id AND p.g = o.g - 1""")
def sentence_chunks(spark, d):
    return sg.chunk_documents(table(spark, d, "ec", "doc_id", "text"), doc="doc_id", text="text").distinct()


@query()
def analyst_digest(spark, d):
    """Over all three text fields."""
    text = lambda t, c: table(spark, d, t, "doc_id", c).dropna().distinct().select(F.concat_ws("|", F.lit(f"{t}.{c}"), "doc_id").alias("doc_id"), F.col(c).alias("text"))
    every = text("ec", "text").unionByName(text("sec", "management_discussion")).unionByName(text("sec", "risk_factors"))
    x = an.digest_documents(every, doc="doc_id", text="text")
    return x.select("doc_id", "n_chunks", "n_risks", F.to_json("top_risks").alias("top_risks"), "rubric_risk", "rubric_signal")


# Replies to be validated, built from each order's own key: whole, lacking fields, of wrong type, no JSON.
_REPLIES = (
    ('{"summary_text": "s', '", "top_risks": [{"title": "r", "category": "Market", "severity": "severe"}], "rl": {"signal": 3}}'),
    ('{"summary_text": "s', '", "top_risks": [{"category": "tax"}, {"title": "q"}], "flags": ["a", "b"]}'),
    ('{"top_risks": "none", "rl": {"signal": 40, "n": ', '}}'),
    ('{"summary_text": ', ', "opportunities": [{"title": "o", "driver": "saas", "confidence": "Strong"}], "rl": {"signal": "x"}}'),
    ("no json ", ""),
)
_REPLY_SQL = " ".join(f"WHEN {i} THEN '{a}' || o_orderkey || '{b}'" for i, (a, b) in enumerate(_REPLIES))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'top_risks.0.title: missing' WHEN 2 THEN 'summary_text: missing; top_risks: not a list' WHEN 3 THEN 'rl.signal: not a number' ELSE 'no JSON object' END AS errors,
CASE o_orderkey % 5 WHEN 0 THEN 's' || o_orderkey WHEN 1 THEN 's' || o_orderkey WHEN 3 THEN CAST(o_orderkey AS VARCHAR) END AS summary_text,
CASE o_orderkey % 5 WHEN 0 THEN 'r,macro,high' WHEN 1 THEN '-,tax,medium;q,other,medium' ELSE '' END AS risks,
CASE o_orderkey % 5 WHEN 3 THEN 'o,technology,high' ELSE '' END AS chances, CASE o_orderkey % 5 WHEN 1 THEN 2 ELSE 0 END AS n_flags,
CAST(CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 2 THEN 10 ELSE 0 END AS DOUBLE) AS signal FROM orders""")
def reply_validation(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    reply = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.concat(F.lit(a), F.col("o_orderkey").cast("string"), F.lit(b))) for i, (a, b) in enumerate(_REPLIES)])
    x = validate(o.select("o_orderkey", reply.alias("reply")), "reply", SCHEMAS["filing"])
    flat = lambda c, *fields: F.array_join(F.transform(c, lambda r: F.concat_ws(",", *[F.coalesce(r[f], F.lit("-")) for f in fields])), ";")
    return x.select("o_orderkey", F.array_join("errors", "; ").alias("errors"), "summary_text", flat("top_risks", "title", "category", "severity").alias("risks"), flat("opportunities", "title", "driver", "confidence").alias("chances"), F.size("flags").alias("n_flags"), F.col("rl_signal").alias("signal"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
