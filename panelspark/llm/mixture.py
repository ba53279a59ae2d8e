"""Mixing sources to target shares of tokens.

Method: iterative proportional fitting. Token counts are summed by (source, language,
topic); the cells are raked in turn to the source, language and topic marginals until they
agree, no cell going beyond its source's cap; a cell's weight is its raked over its own
tokens. A document is then sampled by its cell's weight: the whole part as sure copies, the
fraction as a probability against one permanent random number per document. A histogram of
tokens over those numbers, of fixed size, calibrates the last threshold per source, so that
realised tokens and not only expected ones meet the target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.encode import encode_texts
from panelspark.session import BROADCAST_LIMIT, cut_lineage
from panelspark.sources.tables import table

#: Sources of a recipe, and cells of the contingency table, that are fitted on the driver; more is an error.
MAX_SOURCES, MAX_CELLS = 100_000, 1_000_000
#: Bytes that a cell takes in a hash relation, generously.
_CELL_BYTES = 128
#: Buckets of the calibration histogram per unit of the ratio, and its range.
_GRAIN, _RANGE = 1024, 4


@dataclass
class Marginals:
    """Wanted shares of languages and topics. None: the shares that the documents of the
    named sources have, so that a change of sources doesn't shift languages and topics.
    Shares that the source targets and caps rule out are replaced by the nearest they allow."""

    language: dict[str, float] | None = None
    topic: dict[str, float] | None = None


def budgets(shares: np.ndarray, limits: np.ndarray, total: float) -> np.ndarray:
    """Tokens per source: shares of the total, none above its limit. What a source can't
    give goes to the others in proportion to their shares, as far as they can."""
    out = np.zeros(len(shares))
    free = (shares > 0) & (limits > 0)
    left = total
    while free.any() and left > 1e-9:
        want = left * shares[free] / shares[free].sum()
        over = want >= limits[free]
        idx = np.flatnonzero(free)
        if not over.any():
            out[idx] = want
            break
        out[idx[over]] = limits[idx[over]]
        free[idx[over]] = False
        left = total - out[~free].sum()
    return out


def attainable(wanted: np.ndarray, axis: np.ndarray, source: np.ndarray, tokens: np.ndarray, caps: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Tokens per category of an axis nearest in proportion to ``wanted`` that the sources can give.

    Where a source holds little else than one category, its budget fixes how little of that
    category there can be, and its cap how much. Each category gets its wanted tokens times
    one factor, within those two bounds.
    """
    n = len(wanted)
    # only pairs of source and category that occur; for the others ``own`` is 0
    pairs, at = np.unique(source * n + axis, return_inverse=True)
    own, src, cat = np.bincount(at, tokens, len(pairs)), pairs // n, pairs % n
    whole = np.bincount(source, tokens, len(budget))
    bare = np.maximum(0, budget - caps * whole)
    low = bare.sum() + np.bincount(cat, np.maximum(0, budget[src] - caps[src] * (whole[src] - own)) - bare[src], n)
    high = np.bincount(cat, np.minimum(budget[src], caps[src] * own), n)
    a, b = 0.0, 1e12
    for _ in range(200):
        mid = (a * b) ** 0.5 if a > 0 else b / 1e6
        if np.clip(mid * wanted, low, high).sum() < budget.sum():
            a = mid
        else:
            b = mid
    return np.clip(b * wanted, low, high)


def rake(tokens: np.ndarray, cap: np.ndarray, axes: list[np.ndarray], wanted: list[np.ndarray], rounds: int = 200) -> np.ndarray:
    """Iterative proportional fitting of cells to several marginals under cell caps.

    axes[i] numbers the category of each cell, wanted[i] gives the tokens per category.
    The first axis is raked last in every round, so it holds best when marginals disagree.
    """
    x = tokens.astype(float).copy()
    for _ in range(rounds):
        before = x.copy()
        for ax, want in reversed(list(zip(axes, wanted))):
            for _ in range(20):  # cells at their cap stay; the others take over what they lack
                have = np.bincount(ax, x, len(want))
                fixed = np.bincount(ax, np.where(x >= cap * (1 - 1e-12), x, 0), len(want))
                with np.errstate(divide="ignore", invalid="ignore"):
                    grow = np.where(have > 0, want / have, 0.0)
                    part = np.where(have - fixed > 1e-9, (want - fixed) / (have - fixed), 1.0)
                f = np.where(grow > 1, np.maximum(part, 1.0), grow)[ax]
                new = np.minimum(np.where((f > 1) & (x >= cap * (1 - 1e-12)), x, x * f), cap)
                done = np.allclose(new, x, rtol=1e-12, atol=1e-9)
                x = new
                if done:
                    break
        if np.allclose(x, before, rtol=1e-9, atol=1e-6):
            break
    return x


def language_key(c: str) -> Column:
    """Two or three letters of a language tag in any spelling; all else is "und"."""
    t = F.lower(F.trim(F.col(c)))
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit("")), F.lit("und"))


def mix(
    docs: DataFrame, targets: DataFrame, *, key: str, size: str, source: str, language: str, topic: str,
    total: float | None = None, marginals: Marginals | None = None, seed: int = 7,
) -> DataFrame:
    """(key, source, n_tokens, copies): the documents of the mixture and how often each is used.

    docs has one row a document with its size; targets has source, target_share and
    max_repeats (at most one row a source counts, the largest). total: tokens of the
    mixture, by default those of all documents of the sources named. No document is used
    more than its source's max_repeats times. A source out of reach under its cap gives
    all it can, and the rest goes to the others in proportion; one without documents
    gives nothing. Documents without key, source, or tokens, and sources without target
    are left out; a repeated key counts once. The same seed gives the same mixture.
    """
    spark = docs.sparkSession
    t = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).dropna().where("share > 0 AND cap > 0")
    # named sources: a dimension of the mixture's recipe
    named = t.groupBy("source").agg(F.max(F.struct("share", "cap")).alias("m")).select("source", "m.*").limit(MAX_SOURCES + 1).collect()
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the recipe")
    recipe = {r.source: (r.share, r.cap) for r in named}
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("copies", T.IntegerType())])
    if not recipe:
        return spark.createDataFrame([], out_type)
    names = spark.createDataFrame([(k,) for k in sorted(recipe)], "source string")
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), language_key(language).alias("lang"), F.coalesce(F.col(topic).cast("string"), F.lit("")).alias("topic"), F.col(size).cast("long").alias("n")).where("k IS NOT NULL AND n > 0")
    rows = rows.join(F.broadcast(names), "source", "left_semi").groupBy("k").agg(F.max(F.struct("source", "lang", "topic", "n")).alias("r")).select("k", "r.*")
    rows = cut_lineage(rows)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    if not cells:
        return spark.createDataFrame([], out_type)
    tokens = np.array([c.tokens for c in cells], float)
    order, axes = [], []
    for i in range(3):
        at = {x: k for k, x in enumerate(sorted({c[i] for c in cells}))}
        order.append(list(at))
        axes.append(np.array([at[c[i]] for c in cells]))
    share = np.array([recipe[s][0] for s in order[0]])
    caps = np.array([recipe[s][1] for s in order[0]], float)
    have = np.bincount(axes[0], tokens, len(share))
    want = budgets(share, have * caps, total or have.sum())
    wanted = [want]
    for i, given in ((1, (marginals or Marginals()).language), (2, (marginals or Marginals()).topic)):
        by = np.bincount(axes[i], tokens, len(order[i])) if given is None else np.array([given.get(x, 0.0) for x in order[i]])
        wanted.append(attainable(by * want.sum() / (by.sum() or 1.0), axes[i], axes[0], tokens, caps, want))
    fitted = rake(tokens, tokens * caps[axes[0]], axes, wanted)
    weight = np.minimum(fitted / tokens, caps[axes[0]])
    sure = np.floor(weight + 1e-9)
    table_ = spark.createDataFrame([(c.source, c.lang, c.topic, int(f), float(max(0.0, w - f))) for c, w, f in zip(cells, weight, sure)], "source string, lang string, topic string, sure int, part double")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("k")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    if len(cells) * _CELL_BYTES <= BROADCAST_LIMIT:
        table_ = F.broadcast(table_)
    drawn = rows.join(table_, ["source", "lang", "topic"]).withColumn("ratio", F.when(F.col("part") > 1e-9, u / F.col("part")))
    bucket = F.floor(F.col("ratio") * _GRAIN).cast("int")
    hist = drawn.where(F.col("ratio") < _RANGE).groupBy("source", bucket.alias("b")).agg(F.sum("n").alias("n")).collect()  # at most sources x 4096
    extra = np.bincount(axes[0], fitted - sure * tokens, len(share))
    at = {x: k for k, x in enumerate(order[0])}
    edges = []
    by_source: dict[str, list] = {x: [] for x in order[0]}
    for r in hist:
        by_source[r.source].append(r)
    for x, found in by_source.items():
        h = np.zeros(_RANGE * _GRAIN)
        for r in found:
            h[r.b] += r.n
        reach = np.r_[0.0, np.cumsum(h)]
        edges.append((x, float(np.argmin(np.abs(reach - extra[at[x]]))) / _GRAIN))
    drawn = drawn.join(F.broadcast(spark.createDataFrame(edges, "source string, edge double")), "source")
    copies = F.col("sure") + F.when(F.col("ratio") < F.col("edge"), 1).otherwise(0)
    return drawn.select(F.col("k").alias(key), "source", F.col("n").alias("n_tokens"), copies.cast("int").alias("copies")).where("copies > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_docs, n_tokens, most_copies) of each target."""
    got = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    wanted = targets.select("source", "target_share").groupBy("source").agg(F.max("target_share").alias("target_share"))
    every = Window.partitionBy(F.lit(1))  # one row a target
    out = wanted.join(got, "source", "left").withColumn("whole", F.sum("n_tokens").over(every))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)).alias("reached_share"), zero("n_docs"), zero("n_tokens"), zero("most_copies"))


def axis_shares(mixture: DataFrame, docs: DataFrame, targets: DataFrame, *, key: str, size: str, source: str, language: str, topic: str) -> DataFrame:
    """(axis, category, corpus_share, wanted_share, mixed_share) of each language and topic: its
    share among the documents of the sources named, the nearest share to it that the source
    targets and caps allow, and its share in the mixture."""
    t = targets.select(F.col("source").alias("s"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("double").alias("cap")).groupBy("s").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    d = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), language_key(language).alias("language"), F.coalesce(F.col(topic).cast("string"), F.lit("")).alias("topic"), F.col(size).alias("n")).where("k IS NOT NULL AND n > 0")
    d = d.join(t.select("s"), "s", "left_semi").groupBy("k").agg(F.max(F.struct("s", "language", "topic", "n")).alias("r")).select("k", "r.*")
    d = d.join(mixture.select(F.col(key).alias("k"), "copies"), "k", "left")
    cells = d.groupBy("s", "language", "topic").agg(F.sum("n").alias("a"), F.sum(F.col("n") * F.coalesce("copies", F.lit(0))).alias("b")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    recipe = {r.s: r for r in t.limit(MAX_SOURCES).collect()}
    names = sorted({c.s for c in cells})
    at = {x: i for i, x in enumerate(names)}
    src = np.array([at[c.s] for c in cells], int)
    have, mixed = np.array([c.a for c in cells], float), np.array([c.b for c in cells], float)
    caps = np.array([recipe[x].cap for x in names])
    want = budgets(np.array([recipe[x].share for x in names]), np.bincount(src, have, len(names)) * caps, have.sum())
    out = []
    for axis in ("language", "topic"):
        kinds = sorted({c[axis] for c in cells})
        ax = np.array([kinds.index(c[axis]) for c in cells], int)
        by, got = np.bincount(ax, have, len(kinds)), np.bincount(ax, mixed, len(kinds))
        goal = attainable(by * want.sum() / (by.sum() or 1.0), ax, src, have, caps, want)
        out += [(axis, x, float(p / by.sum()), float(q / goal.sum()), float(r / (got.sum() or 1.0))) for x, p, q, r in zip(kinds, by, goal, got)]
    return docs.sparkSession.createDataFrame(out, "axis string, category string, corpus_share double, wanted_share double, mixed_share double")


_COLUMNS = {"key": "doc_id", "size": "n_tokens", "source": "source", "language": "lang", "topic": "doc_type"}


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "doc_type")
    packed = docs.select(F.struct("doc_id", "source", "lang", "doc_type").alias("doc"), "text")
    return encode_texts(packed, key="doc", text="text", counts_only=True).select("doc.*", "n_tokens")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), **_COLUMNS)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(cut_lineage(_mixture(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


def p9_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of languages and topics: in the corpus, as wanted, and in the mixture."""
    targets = table(spark, sf_dir, "mix_targets")
    sized = cut_lineage(_sized(spark, sf_dir))
    return axis_shares(mix(sized, targets, **_COLUMNS), sized, targets, **_COLUMNS)


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold: no document of a source is used beyond its cap; a source has the tokens
    that its share and cap allow (within 1 % or one document); a language or topic has the
    share wanted (within one percentage point)."""
    targets = table(spark, sf_dir, "mix_targets")
    sized = cut_lineage(_sized(spark, sf_dir).where("n_tokens > 0"))
    mixture = cut_lineage(mix(sized, targets, **_COLUMNS))
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), F.max("copies").alias("most"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("largest"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).join(have, "source", "left").join(got, "source", "left").na.fill(0)
    every = rows.limit(MAX_SOURCES).collect()  # one row a target
    want = budgets(np.array([r.share for r in every]), np.array([r.have * r.cap for r in every], float), float(sum(r.have for r in every)))
    out = [("cap", r.source, bool(r.most <= r.cap)) for r in every]
    out += [("budget", r.source, bool(abs(r.got - w) <= max(0.01 * w, r.largest))) for r, w in zip(every, want)]
    held = axis_shares(mixture, sized, targets, **_COLUMNS).select(F.col("axis").alias("what"), F.col("category").alias("name"), (F.abs(F.col("mixed_share") - F.col("wanted_share")) <= 0.01).alias("holds"))
    return spark.createDataFrame(out, "what string, name string, holds boolean").unionByName(held)


def queries() -> dict:
    return {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_marginals": p9_marginals, "p9_invariants": p9_invariants}


def oracle_sql() -> dict[str, str]:
    # what must hold, whatever the tokens; the tokens themselves are no matter of SQL
    used = "FROM documents WHERE coalesce(text, '') <> '' AND source IN (SELECT source FROM mix_targets)"
    lang = "coalesce(nullif(regexp_extract(lower(trim(lang)), '^([a-z]{2,3})(?:[-_].*)?$', 1), ''), 'und')"
    return {
        "p9_invariants": f"""SELECT DISTINCT 'cap' AS what, source AS name, true AS holds FROM mix_targets UNION ALL SELECT DISTINCT 'budget', source, true FROM mix_targets
UNION ALL SELECT DISTINCT 'language', {lang}, true {used} UNION ALL SELECT DISTINCT 'topic', coalesce(doc_type, ''), true {used}"""
    }
