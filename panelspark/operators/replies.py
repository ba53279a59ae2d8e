"""Typed validation of analysts' replies, with an error for each field that doesn't fit.

A reply is parsed once into a variant; every field is looked up in it, brought to its type
or its vocabulary, or replaced by its default, and what was wrong is told in ``errors``.
All of it is one projection of built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.signals import clamp, json_block, normalise_enum


@dataclass(frozen=True)
class Text:
    """A string; any scalar is taken as one."""

    required: bool = False
    default: str | None = None


@dataclass(frozen=True)
class Word:
    """A value of a closed vocabulary; anything else becomes the vocabulary's default."""

    vocabulary: str


@dataclass(frozen=True)
class Number:
    """A number within bounds; missing or unreadable ones become the default."""

    low: float
    high: float
    default: float = 0.0


@dataclass(frozen=True)
class Texts:
    """A list of strings; empty when missing."""


@dataclass(frozen=True)
class Items:
    """A list of objects with fields of their own; empty when missing."""

    fields: tuple[tuple[str, Text | Word], ...]


Field = Text | Word | Number | Texts | Items

RISK = Items((("title", Text(True)), ("category", Word("category")), ("severity", Word("severity")), ("rationale", Text(default=""))))
EXPOSURE = Items((("factor", Word("factor")), ("direction", Word("direction")), ("notes", Text(default=""))))
OPPORTUNITY = Items((("title", Text(True)), ("driver", Word("driver")), ("confidence", Word("confidence")), ("rationale", Text(default=""))))
_SIGNALS = {"rl.signal": Number(-10, 10), "rl.risk_score": Number(0, 10), "rl.confidence": Number(0, 1, 0.5)}

#: Replies by task. A dot in a name is a step into an object; its column has an underscore.
SCHEMAS: dict[str, dict[str, Field]] = {
    "call_chunk": {"bullets": Texts(), "risks": RISK, "opportunities": OPPORTUNITY},
    "call": {"summary_text": Text(True), "risks": RISK, "opportunities": OPPORTUNITY, **_SIGNALS},
    "filing_chunk": {"bullets": Texts(), "risks": RISK, "exposures": EXPOSURE, "opportunities": OPPORTUNITY, "red_flags": Texts()},
    "filing_section": {"section": Text(True), "summary_text": Text(True), "top_risks": RISK, "exposures": EXPOSURE, "opportunities": OPPORTUNITY, "flags": Texts()},
    "filing": {"summary_text": Text(True), "top_risks": RISK, "exposures": EXPOSURE, "opportunities": OPPORTUNITY, "flags": Texts(), **_SIGNALS},
    "news": {"events": Items((("title", Text(True)), ("category", Word("news_category")), ("rationale", Text(True)))), **_SIGNALS},
}


def _error(wrong: Column, text: Column | str) -> Column:
    return F.when(wrong, F.lit(text) if isinstance(text, str) else text)


def validate(df: DataFrame, reply: str, schema: dict[str, Field]) -> DataFrame:
    """All columns of ``df`` but those it replaces, one column for each field, and ``errors``.

    errors: array of "field: what is wrong", in order of the schema; empty when all fits. A
    reply without JSON object has the one error "no JSON object" and defaults throughout;
    so have null and blank ones. An item of a list without a required field is reported as
    "list.position.field: missing", positions from 0, and kept with null.
    """
    names = {f: f.replace(".", "_") for f in schema}
    d = df.withColumn("_v", F.try_parse_json(json_block(F.col(reply))))
    broken = F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT")
    errors, columns = [F.array(_error(broken, "no JSON object"))], []
    for name, rule in schema.items():
        at = lambda kind: F.try_variant_get("_v", f"$.{name}", kind)  # noqa: B023, E731
        present = at("variant").isNotNull() & ~F.is_variant_null(at("variant"))
        fault = lambda wrong, text: _error(~broken & wrong, f"{name}: {text}")  # noqa: B023, E731
        if isinstance(rule, Text):
            value = F.coalesce(at("string"), F.lit(rule.default))
            bad = F.array(fault(at("string").isNull(), "missing") if rule.required else F.lit(None).cast("string"))
        elif isinstance(rule, Word):
            value, bad = normalise_enum(at("string"), rule.vocabulary), F.array(F.lit(None).cast("string"))
        elif isinstance(rule, Number):
            number = at("string").try_cast("double")
            value = clamp(number, rule.low, rule.high, rule.default)
            bad = F.array(fault(present & (number.isNull() | F.isnan(number)), "not a number"))
        elif isinstance(rule, Texts):
            value = F.coalesce(F.filter(at("array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
            bad = F.array(fault(present & at("array<variant>").isNull(), "not a list"))
        else:
            each = F.coalesce(at("array<variant>"), F.array().cast("array<variant>"))
            part = lambda x, f: F.try_variant_get(x, f"$.{f}", "string")
            shape = lambda x, f, r: normalise_enum(part(x, f), r.vocabulary) if isinstance(r, Word) else F.coalesce(part(x, f), F.lit(r.default))
            value = F.transform(each, lambda x: F.struct(*[shape(x, f, r).alias(f) for f, r in rule.fields]))  # noqa: B023
            needed = [f for f, r in rule.fields if isinstance(r, Text) and r.required]
            missing = F.flatten(F.transform(each, lambda x, i: F.array(*[_error(part(x, f).isNull(), F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(f".{f}: missing"))) for f in needed])))  # noqa: B023
            bad = F.concat(F.array(fault(present & at("array<variant>").isNull(), "not a list")), missing if needed else F.array().cast("array<string>"))
        columns.append(value.alias(names[name]))
        errors.append(bad)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in {*names.values(), "errors"}]
    return d.select(*kept, *columns, F.array_compact(F.concat(*errors)).alias("errors"))
