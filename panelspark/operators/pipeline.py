"""From documents to one panel of signals: weekly rows per source, their merge, and the chain of
analysts over the merged row. Analysts are pluggable; the rule analysts here need no service."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.analyst import NO_NEWS, Analyst, call_analyst, signals_from_replies
from panelspark.operators.panel import attach, base_panel, source_features
from panelspark.operators.selection import budgeted_context
from panelspark.operators.timejoin import asof_backward

UP = ("rose", "improved", "expanded", "climbed", "rebounded", "accelerated", "recovered", "jumped", "beat")
DOWN = ("fell", "narrowed", "weakened", "slipped", "declined", "contracted", "stalled", "slowed", "missed")


class ToneAnalyst:
    """Signal by the balance of rising and falling words, confidence by how many there are.
    ``lean`` shifts the view: +1 argues for, -1 against."""

    def __init__(self, lean: float = 0.0):
        self.lean = lean

    def reply(self, texts: list[str]) -> list[str]:
        return [json.dumps(self.view(t.lower())) for t in texts]

    def view(self, t: str) -> dict:
        up, down = sum(t.count(w) for w in UP), sum(t.count(w) for w in DOWN)
        n = up + down
        return {"signal": round(10 * (up - down) / n + self.lean, 3) if n else self.lean, "risk_score": round(10 * down / n, 3) if n else 0.0, "confidence": round(min(1.0, n / 10), 3), "rationale": f"{up} up, {down} down"}


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ("signal", "risk_score", "confidence", "rationale")])


def analysed(df: DataFrame, keys: list[str], text: str, prefix: str, analyst: Analyst | None = None) -> DataFrame:
    """(keys, prefix_signal, prefix_risk_score, prefix_confidence, prefix_rationale)."""
    said = call_analyst(df, key=keys, text=text, analyst=analyst or ToneAnalyst())
    quiet = F.get_json_object("reply", "$.note") == NO_NEWS
    out = signals_from_replies(said, "reply").withColumn("rationale", F.when(quiet, NO_NEWS).otherwise(F.col("rationale")))
    return _prefixed(out.withColumn("confidence", F.when(quiet, 0.0).otherwise(F.col("confidence"))), prefix, keys)


def weekly_context(news: DataFrame, *, week: str, ticker: str, ts: str, day: str, item: str, text: str, score: str, per_article: int | None = None, **limits: int) -> DataFrame:
    """(week, ticker, context, n_cut): the chosen articles of a week in order of time,
    separated by a line of dashes. Articles are whole; with ``per_article`` each is cut to so
    many characters, and n_cut counts those that were."""
    n = news.withColumn("_len", F.length(text))
    picked = budgeted_context(n, group=[week, ticker], day=day, score=score, ts=ts, item=item, n_chars="_len", per_article=per_article, **limits)
    cut = F.substring(text, 1, per_article) if per_article else F.col(text)
    texts = news.select(week, ticker, F.col(item).alias("item"), cut.alias("_t"), (F.length(text) > F.length(cut)).cast("int").alias("_c")).dropDuplicates([week, ticker, "item"])
    g = picked.join(texts, [week, ticker, "item"]).groupBy(week, ticker).agg(F.array_sort(F.collect_list(F.struct("pick_no", "_t"))).alias("a"), F.sum("_c").cast("int").alias("n_cut"))
    return g.select(week, ticker, F.array_join(F.transform("a", lambda x: x["_t"]), "\n---\n").alias("context"), "n_cut")


def technical_rows(history: DataFrame, *, keys: list[str], columns: list[str], min_rows: int = 4) -> DataFrame:
    """(keys, tech_signal, tech_risk_score, tech_confidence, tech_summary) from the lookback
    history. A row with fewer than ``min_rows`` weeks or a null in its newest values is
    discarded: its summary is empty and its numbers are 0."""
    last = F.element_at("history", -1)
    nulls = [last[c].isNull() for c in columns]
    bad = F.size("history") < min_rows
    for n in nulls:
        bad = bad | n
    move = F.log(F.element_at("history", -1)[columns[0]] / F.element_at("history", 1)[columns[0]])
    signal = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), move * 100))
    return history.select(
        *keys, F.when(~bad, signal).otherwise(0.0).alias("tech_signal"), F.when(~bad, F.least(F.lit(10.0), F.abs(move) * 100)).otherwise(0.0).alias("tech_risk_score"),
        F.when(~bad, F.least(F.lit(1.0), F.size("history") / 6.0)).otherwise(0.0).alias("tech_confidence"), F.when(~bad, F.to_json("history")).otherwise("").alias("tech_summary"),
    )


def tier1_panel(weeks: DataFrame, entities: DataFrame, *, calls: DataFrame, filings: DataFrame, news: DataFrame, technical: DataFrame, days: int = 240) -> DataFrame:
    """Stage 6: one row per (week, ticker): as-of calls and filings, weekly news and technical
    signals, cross-source features. Missing signals stay null for the counts and are 0 in
    the output, as are risks and confidences; summaries and rationales are ""."""
    p = base_panel(weeks, entities)
    p = asof_backward(p, calls, by=["ticker"], left_ts="w_end", right_ts="ts", values=["ec_signal", "ec_risk_score", "ec_confidence"], tolerance_s=days * 86400, prefix="_ec_")
    p = asof_backward(p, filings, by=["ticker"], left_ts="w_end", right_ts="ts", values=["sec_signal", "sec_risk_score", "sec_confidence"], tolerance_s=days * 86400, prefix="_sec_")
    p = p.join(news, ["week", "ticker"], "left").join(technical, ["week", "ticker"], "left")
    for s in ("ec", "sec"):
        for c in ("signal", "risk_score", "confidence"):
            p = p.withColumnRenamed(f"_{s}_{s}_{c}", f"{s}_{c}")
    p = source_features(p, at="w_end", event_times={"ec": "_ec_asof_ts", "sec": "_sec_asof_ts"}, signals=["ec_signal", "sec_signal", "news_signal", "tech_signal"])
    fill = {f"{s}_{c}": 0.0 for s in ("ec", "sec", "news", "tech") for c in ("signal", "risk_score", "confidence")} | {"news_rationale": "", "tech_summary": ""}
    return p.fillna({k: v for k, v in fill.items() if k in p.columns}).drop("_ec_asof_ts", "_sec_asof_ts")


def context_json(sources: list[str]) -> Column:
    """The row's views as one JSON document."""
    views = [F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("signal", "risk_score", "confidence")]).alias(s) for s in sources]
    return F.to_json(F.struct("week", "ticker", *views))


class WeighingAnalyst:
    """A role of the chain: weighs the sources' signals by confidence and passes on a verdict,
    tempered by the role's caution and by the verdicts before it."""

    def __init__(self, caution: float):
        self.caution = caution

    def reply(self, texts: list[str]) -> list[str]:
        return [json.dumps(self.view(json.loads(t))) for t in texts]

    def view(self, c: dict) -> dict:
        views = [v for v in c.values() if isinstance(v, dict) and "signal" in v]
        weight = sum(v.get("confidence") or 0.0 for v in views)
        signal = sum(v["signal"] * (v.get("confidence") or 0.0) for v in views) / weight if weight else 0.0
        risk = max([v.get("risk_score") or 0.0 for v in views], default=0.0)
        return {"signal": round(signal * (1 - self.caution), 4), "risk_score": round(risk, 4), "confidence": round(min(1.0, weight / max(len(views), 1)), 4)}


ROLES = (("business", 0.0), ("risk", 0.2), ("skeptic", 0.4), ("judge", 0.0))


def tier2_panel(panel: DataFrame, sources: list[str], roles=ROLES) -> DataFrame:
    """(week, ticker, role_signal, role_risk_score, role_confidence...): four roles in turn,
    each reading the context and the verdicts so far. A row passes through the roles as it is,
    without a join, so each role is asked once a row whatever the optimiser does."""
    keys = ["week", "ticker"]
    out = panel.select(*keys, *[f"{s}_{c}" for s in sources for c in ("signal", "risk_score", "confidence")])
    seen = list(sources)
    for role, caution in roles:
        said = call_analyst(out.withColumn("_ctx", context_json(seen)), key=out.columns, text="_ctx", analyst=WeighingAnalyst(caution))
        out = _prefixed(signals_from_replies(said, "reply"), role, out.columns).drop(f"{role}_rationale")
        seen.append(role)
    return out.select(*keys, *[f"{r}_{c}" for r, _ in roles for c in ("signal", "risk_score", "confidence")])


def two_sided(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The case for and the case against of each text, side by side, each with its own
    rationale."""
    return analysed(df, keys, text, "bull", ToneAnalyst(1.0)).join(analysed(df, keys, text, "bear", ToneAnalyst(-1.0)), keys)


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key; ties by all other columns."""
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *rest)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


__all__ = ["ToneAnalyst", "WeighingAnalyst", "analysed", "attach", "context_json", "latest_per_key", "technical_rows", "tier1_panel", "tier2_panel", "two_sided", "weekly_context"]
