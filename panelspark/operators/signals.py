"""Signals out of JSON documents: tolerant extraction, clamps, enums, rubrics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import ship_package

# Where a signal object may stand, first match wins.
SIGNAL_PATHS = ("$.rl", "$.rl_signals", "$.signals.rl", "$.analysis.rl", "$.result.rl")
# Names of each field, the present one first, then older ones.
SIGNAL_KEYS = {
    "signal": ("signal", "sentiment_score", "ec_signal"),
    "risk_score": ("risk_score", "event_risk_score", "risk", "ec_risk_score"),
    "confidence": ("confidence", "conf", "ec_confidence"),
    "rationale": ("rationale", "reasoning", "justification", "ec_rationale"),
}
# Synonyms, allowed values and default of each closed vocabulary.
ENUMS: dict[str, tuple[dict[str, str], tuple[str, ...], str]] = {
    "category": (
        {"market": "macro", "market_risk": "macro", "macroeconomic": "macro", "regulatory_risk": "regulatory", "legal": "litigation", "lawsuit": "litigation", "currency": "fx", "fx_risk": "fx", "competition_risk": "competition", "security": "cyber", "cybersecurity": "cyber", "liquidity_risk": "liquidity", "covenant_risk": "covenant", "execution_risk": "execution", "tech": "technology", "technology_risk": "technology", "governance_risk": "governance", "esg_risk": "esg"},
        ("regulatory", "litigation", "supply_chain", "macro", "fx", "competition", "cyber", "liquidity", "covenant", "execution", "governance", "technology", "credit", "tax", "reputation", "esg", "other"),
        "other",
    ),
    "factor": (
        {"currency": "fx", "fx_risk": "fx", "rates": "interest_rate", "rate": "interest_rate", "interest": "interest_rate", "inflation_risk": "inflation", "labor_market": "labor", "employment": "labor", "housing_market": "housing", "equity": "equity_market", "stock_market": "equity_market", "regulatory": "regulation"},
        ("fx", "commodity", "interest_rate", "geography", "customer_concentration", "supplier_concentration", "industry", "inflation", "credit_spread", "equity_market", "labor", "housing", "regulation", "other"),
        "other",
    ),
    "direction": (
        {"negative": "headwind", "risk": "headwind", "pressure": "headwind", "drag": "headwind", "challenging": "headwind", "positive": "tailwind", "supportive": "tailwind", "benefit": "tailwind", "favorable": "tailwind", "neutral": "unclear", "mixed": "unclear"},
        ("headwind", "tailwind", "unclear"),
        "unclear",
    ),
    "severity": ({"moderate": "medium", "med": "medium", "medium_risk": "medium", "high_risk": "high", "severe": "high", "low_risk": "low"}, ("low", "medium", "high"), "medium"),
    "driver": (
        {"digital": "technology", "ai": "technology", "cloud": "technology", "platform": "technology", "online": "technology", "saas": "technology", "capital": "cost", "capital_efficiency": "efficiency", "margin": "pricing", "price": "pricing", "pricing_power": "pricing", "marketing": "brand", "brand_investment": "brand", "distribution": "channel", "go_to_market": "channel", "gtm": "channel", "geo": "geography"},
        ("product", "pricing", "mix", "geography", "fx", "cost", "efficiency", "demand", "acquisition", "partnership", "technology", "brand", "channel", "regulation", "other"),
        "other",
    ),
    "confidence": ({"moderate": "medium", "med": "medium", "strong": "high", "high_confidence": "high", "weak": "low", "low_confidence": "low"}, ("low", "medium", "high"), "medium"),
    "news_category": (
        {"results": "earnings", "q3 results": "earnings", "q4 results": "earnings", "outlook": "guidance", "forecast": "guidance", "launch": "product", "products": "product", "m&a": "mna", "merger": "mna", "acquisition": "mna", "deal": "mna", "lawsuit": "litigation", "legal": "litigation", "regulation": "regulatory", "compliance": "regulatory", "market": "macro", "economy": "macro", "sector": "industry", "leadership": "management", "executive": "management", "capital": "financing"},
        ("earnings", "guidance", "product", "mna", "litigation", "regulatory", "macro", "industry", "management", "financing"),
        "other",
    ),
    # the forms of a compressed summary know fewer synonyms
    "short_category": (
        {"market": "macro", "market_risk": "macro", "regulatory_risk": "regulatory", "credit_risk": "credit", "liquidity_risk": "liquidity", "fx_risk": "fx", "currency": "fx", "technology_risk": "technology", "it": "technology", "governance_risk": "governance", "esg_risk": "esg"},
        ("regulatory", "litigation", "supply_chain", "macro", "fx", "competition", "cyber", "liquidity", "covenant", "execution", "governance", "technology", "credit", "tax", "reputation", "esg", "other"),
        "other",
    ),
    "short_severity": ({"moderate": "medium", "med": "medium", "high_risk": "high", "low_risk": "low"}, ("low", "medium", "high"), "medium"),
    "short_direction": (
        {"negative": "headwind", "risk": "headwind", "pressure": "headwind", "drag": "headwind", "positive": "tailwind", "supportive": "tailwind", "benefit": "tailwind", "neutral": "unclear", "mixed": "unclear"},
        ("headwind", "tailwind", "unclear"),
        "unclear",
    ),
    "short_driver": (
        {"digital": "technology", "ai": "technology", "cloud": "technology", "platform": "technology", "online": "technology", "capital": "cost", "capital_efficiency": "efficiency", "margin": "pricing", "price": "pricing", "marketing": "brand", "distribution": "channel", "go_to_market": "channel", "geo": "geography"},
        ("product", "pricing", "mix", "geography", "fx", "cost", "efficiency", "demand", "acquisition", "partnership", "technology", "brand", "channel", "regulation", "other"),
        "other",
    ),
    "short_confidence": ({"moderate": "medium", "med": "medium", "strong": "high", "weak": "low"}, ("low", "medium", "high"), "medium"),
}


def json_block(text: Column) -> Column:
    """From the first "{" to the last "}" of a reply, null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def extract_signal(df: DataFrame, column: str) -> DataFrame:
    """Adds signal, risk_score, confidence (0 if missing or no number) and rationale ("").

    The first of SIGNAL_PATHS that holds an object is used as a whole; without one the
    top level is. Then each field is taken from the first of its names that is there.
    Null and broken JSON give the defaults.
    """
    # parsed once into a variant; paths are looked up in its binary form
    d = df.withColumn("_v", F.try_parse_json(column))
    at = [F.try_variant_get("_v", p, "variant") for p in SIGNAL_PATHS]
    d = d.withColumn("_obj", F.coalesce(*[F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in at], F.col("_v")))
    pick = lambda keys: F.coalesce(*[F.try_variant_get("_obj", f"$.{k}", "string") for k in keys])
    for name in ("signal", "risk_score", "confidence"):
        v = pick(SIGNAL_KEYS[name]).try_cast("double")
        d = d.withColumn(name, F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)))
    return d.withColumn("rationale", F.coalesce(pick(SIGNAL_KEYS["rationale"]), F.lit(""))).drop("_v", "_obj")


def clamp(c: Column, low: float, high: float, default: float = 0.0) -> Column:
    """Into [low, high]; null and NaN give the default."""
    v = F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
    return F.coalesce(v, F.lit(default))


def clamp_pack(df: DataFrame) -> DataFrame:
    """Signal to [-10, 10], risk to [0, 10], confidence to [0, 1] (0.5 if missing)."""
    return df.withColumn("signal", clamp(F.col("signal"), -10.0, 10.0)).withColumn("risk_score", clamp(F.col("risk_score"), 0.0, 10.0)).withColumn("confidence", clamp(F.col("confidence"), 0.0, 1.0, 0.5))


def normalise_enum(c: Column, vocabulary: str) -> Column:
    """D3: trimmed lower-case value, synonyms resolved, the default if it isn't allowed."""
    synonyms, allowed, default = ENUMS[vocabulary]
    v = F.lower(F.trim(c))
    if synonyms:
        table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        v = F.coalesce(F.try_element_at(table, v), v)
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def signal_label(c: Column) -> Column:
    """Five bands of a signal in [-10, 10]."""
    return F.when(c <= -7.5, "strongly_negative").when(c <= -3.5, "negative").when(c < 3.5, "neutral").when(c < 6.5, "positive").otherwise("strongly_positive")


def risk_label(c: Column) -> Column:
    """Four bands of a risk in [0, 10]."""
    return F.when(c < 2.5, "low").when(c < 5.5, "moderate").when(c < 7.5, "high").otherwise("severe")


def rubric(df: DataFrame, severities: str, strengths: str) -> DataFrame:
    """Adds rubric_risk and rubric_signal from arrays of severities and strengths.

    Risk is 2.5 with no high and at most one medium severity, 5.5 with one high or several
    medium, 9 with several high. The signal is 6 when strengths outnumber weighted risks by two,
    -7 when it is the other way round, else 0. Null arrays count as empty.
    """
    n = lambda s: F.size(F.filter(F.coalesce(severities, F.array().cast("array<string>")), lambda x: x == s))
    high, medium = n("high"), n("medium")
    good = F.coalesce(F.size(F.coalesce(strengths, F.array().cast("array<string>"))), F.lit(0))
    weight = 2 * high + medium
    risk = F.when((high == 0) & (medium <= 1), 2.5).when(high <= 1, 5.5).otherwise(9.0)
    return df.withColumn("rubric_risk", risk).withColumn("rubric_signal", F.when(good >= weight + 2, 6.0).when(weight >= good + 2, -7.0).otherwise(0.0))


def reconcile(mentions: DataFrame, *, doc: str, title: str, severity: str, top: int | None = None) -> DataFrame:
    """(doc, title, severity, n, rank): one row per risk of a document. High only if most
    mentions say so, otherwise medium (or low when all are low); the most mentioned first. top: a report of the
    first so many; None keeps all."""
    g = mentions.where(F.col(title).isNotNull()).groupBy(doc, title).agg(F.count("*").alias("n"), F.count_if(F.col(severity) == "high").alias("_h"), F.count_if(F.col(severity) == "low").alias("_l"))
    g = g.withColumn("severity", F.when(F.col("_h") * 2 > F.col("n"), "high").when(F.col("_l") == F.col("n"), "low").otherwise("medium")).drop("_h", "_l")
    w = Window.partitionBy(doc).orderBy(F.desc("n"), title)
    g = g.withColumn("rank", F.row_number().over(w))
    return g if top is None else g.where(F.col("rank") <= top)


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sentence_chunks(text: str | None, max_len: int, overlap: int, max_chunks: int | None = None) -> list[str]:
    """Sentences packed up to max_len, each chunk preceded by tail sentences of the one
    before (up to overlap characters, which come on top). Blanks are collapsed first. A
    single sentence longer than max_len is a chunk of its own. With max_chunks the text after
    that many chunks is left out; None keeps the whole text."""
    flat = " ".join((text or "").split())
    if not flat:
        return []
    groups: list[list[str]] = []
    size = 0
    for s in _SENTENCE.split(flat):
        if groups and size + 1 + len(s) <= max_len:
            groups[-1].append(s)
            size += 1 + len(s)
        else:
            if len(groups) == max_chunks:
                break
            groups.append([s])
            size = len(s)
    out = []
    for before, own in zip([[], *groups], groups):
        tail: list[str] = []
        left = overlap
        for s in reversed(before):
            left -= len(s) + 1
            if left < 0:
                break
            tail.insert(0, s)
        out.append(" ".join(tail + own))
    return out


def chunk_documents(df: DataFrame, *, doc: str, text: str, max_len: int = 2000, overlap: int = 200, max_chunks: int | None = None) -> DataFrame:
    """(doc, chunk_no, chunk) of every text; null and blank texts give no rows. The whole text
    is kept unless the caller sets max_chunks."""
    ship_package(df.sparkSession)
    kind = df.schema[doc].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i + 1, c) for k, t in part.itertuples(index=False) for i, c in enumerate(sentence_chunks(t, max_len, overlap, max_chunks))]
            yield pd.DataFrame(rows, columns=["doc", "chunk_no", "chunk"])

    return df.select(doc, text).mapInPandas(run, f"doc {kind}, chunk_no int, chunk string").withColumnRenamed("doc", doc)
