"""Turning documents into signals: a pluggable analyst, map and tree-shaped reduce.

An analyst maps a batch of texts to JSON replies. The one that ships is a deterministic rule
analyst; a model behind a service fits the same protocol. Replies are checked, retried and,
when they stay unusable, put aside as rows instead of failing the job.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.signals import chunk_documents, clamp_pack, extract_signal, json_block, reconcile, rubric
from panelspark.session import ship_package

# Replies without a call.
NO_NEWS, INCONSISTENT = "NO_MEANINGFUL_NEWS", "INCONSISTENT_METADATA"
# Our own small lexicon of the rule analyst.
RISKS = {"litigation": "litigation", "lawsuit": "litigation", "cyber": "cyber", "data breach": "cyber", "sanction": "regulatory", "regulatory": "regulatory", "covenant": "covenant", "currency": "fx", "supplier": "supply_chain", "shortage": "supply_chain", "default": "credit", "tax": "tax", "tariff": "macro", "interest-rate": "macro", "competitor": "competition"}
STRENGTHS = ("rose", "improved", "expanded", "climbed", "rebounded", "beat", "accelerated", "recovered", "jumped")
SEVERE = ("loss", "breach", "failure", "strike", "default", "investigation")


class Analyst(Protocol):
    def reply(self, texts: list[str]) -> list[str]:
        """One reply (text with a JSON object in it) per text."""


class RuleAnalyst:
    """Counts lexicon hits per sentence: risks with a severity, and strengths."""

    def reply(self, texts: list[str]) -> list[str]:
        return [json.dumps(self.read(t)) for t in texts]

    def read(self, text: str) -> dict:
        risks, strengths = [], []
        for s in re.split(r"(?<=[.!?;])\s+", text.lower()):
            severe = any(w in s for w in SEVERE)
            risks += [{"title": w, "category": c, "severity": "high" if severe else "medium"} for w, c in RISKS.items() if w in s]
            strengths += [w for w in STRENGTHS if w in s]
        return {"risks": risks, "strengths": strengths}


class RateLimit:
    """At most ``per_minute`` calls of one task; with p tasks at once a job makes p times that.
    The wait is a token bucket, so no file or lock has to be shared."""

    def __init__(self, per_minute: int):
        self.gap, self.next = 60.0 / per_minute, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def call_analyst(df: DataFrame, *, key: list[str], text: str, analyst: Analyst, retries: int = 2, per_minute: int | None = None, batch: int = 64) -> DataFrame:
    """(key..., reply, error, attempts). A reply without a JSON object is asked again
    up to ``retries`` times; then ``error`` says why and reply is null. Blank texts aren't
    sent; their reply is the NO_NEWS object."""
    ship_package(df.sparkSession)
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = RateLimit(per_minute) if per_minute else None
        for whole in parts:
            for a in range(0, len(whole), batch):
                part = whole.iloc[a : a + batch].reset_index(drop=True)
                out: dict[int, tuple[str | None, str | None, int]] = {i: (json.dumps({"note": NO_NEWS}), None, 0) for i, t in enumerate(part[text]) if not (t or "").strip()}
                todo = [i for i in range(len(part)) if i not in out]
                for attempt in range(1, retries + 2):
                    if not todo:
                        break
                    if limit:
                        limit.wait()
                    try:
                        replies = analyst.reply([part[text][i] for i in todo])
                    except Exception as e:  # a failing service must not fail the job
                        for i in todo:
                            out[i] = (None, f"{type(e).__name__}: {e}", attempt)
                        continue
                    for i, r in zip(list(todo), replies):
                        m = re.search(r"(?s)\{.*\}", r or "")
                        try:
                            json.loads(m[0] if m else "")
                            out[i] = (m[0], None, attempt)
                            todo.remove(i)
                        except ValueError as e:
                            out[i] = (None, f"no JSON object: {e}", attempt)
                yield pd.concat([part[key], pd.DataFrame([out[i] for i in range(len(part))], columns=["reply", "error", "attempts"])], axis=1)

    return df.select(*key, text).mapInPandas(run, f"{head}, reply string, error string, attempts int")


_FINDINGS = "struct<risks: array<struct<title: string, category: string, severity: string>>, strengths: array<string>>"


def digest_documents(df: DataFrame, *, doc: str, text: str, analyst: Analyst | None = None, group: int = 15, max_len: int = 2000, overlap: int = 200, max_chunks: int | None = None, top: int | None = None) -> DataFrame:
    """(doc, n_chunks, n_risks, top_risks, rubric_risk, rubric_signal).

    The rubric counts all risks; top_risks lists the first ``top`` of the n_risks, all by default.

    Texts are cut into chunks and mapped; findings are counted first within groups of
    ``group`` chunks and then over the document, so a long document is no long task.
    Documents without text have no chunks and give no rows.
    """
    chunks = chunk_documents(df, doc=doc, text=text, max_len=max_len, overlap=overlap, max_chunks=max_chunks)
    said = call_analyst(chunks, key=[doc, "chunk_no"], text="chunk", analyst=analyst or RuleAnalyst()).withColumn("f", F.from_json(json_block(F.col("reply")), _FINDINGS)).withColumn("grp", F.floor((F.col("chunk_no") - 1) / group))
    risks = said.select(doc, "grp", F.explode("f.risks").alias("r")).select(doc, "grp", "r.*")
    part = risks.groupBy(doc, "grp", "title", "severity").agg(F.count("*").alias("n"))
    whole = part.groupBy(doc, "title").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("severity") == "high", F.col("n")).otherwise(0)).alias("_h"))
    whole = whole.withColumn("severity", F.when(F.col("_h") * 2 > F.col("n"), "high").otherwise("medium"))
    best = whole.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "title", "severity"))).alias("t"))
    best = best.select(doc, F.transform("t", lambda x: F.struct(x["title"].alias("title"), x["severity"].alias("severity"), (-x["neg"]).alias("n"))).alias("top_risks"))
    strong = said.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("f.strengths", F.array().cast("array<string>")))))).alias("strengths"))
    out = strong.join(best, doc, "left").withColumn("_sev", F.transform("top_risks", lambda x: x["severity"]))
    out = rubric(out, F.col("_sev"), F.col("strengths")).withColumn("n_risks", F.coalesce(F.size("top_risks"), F.lit(0)))
    if top is not None:
        out = out.withColumn("top_risks", F.slice("top_risks", 1, top))
    return out.select(doc, "n_chunks", "n_risks", "top_risks", "rubric_risk", "rubric_signal")


def signals_from_replies(df: DataFrame, reply: str) -> DataFrame:
    """Signal, risk, confidence and rationale of a reply, clamped to their ranges."""
    return clamp_pack(extract_signal(df.withColumn("_json", json_block(F.col(reply))), "_json").drop("_json"))


__all__ = ["INCONSISTENT", "NO_NEWS", "Analyst", "RateLimit", "RuleAnalyst", "call_analyst", "digest_documents", "reconcile", "signals_from_replies"]
