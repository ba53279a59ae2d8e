"""Lines that a source repeats in document after document.

Method: lines are reduced to their letters and hashed, distinct documents are counted per
(source, line), lines above the threshold are kept, joined back, and documents are rebuilt
without them. Texts are never shuffled for the count, only the hashes of a line and its
document; the first aggregation runs before the shuffle. The frequent lines are cut off
in the shared folder, so their size is known: few are a set within an expression, more are
broadcast up to a fixed bound and joined by shuffle (AQE splits skewed keys) beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import BROADCAST_LIMIT, cut_lineage, distinct_rows, drop_scratch, scratch_path
from panelspark.sources.tables import table

#: Bytes a row of the frequent-line table takes in a hash relation, generously.
_ROW_BYTES = 64
#: Frequent lines that are looked up within the expression that rebuilds a text. 64 bits of
#: hash suffice for so few: a line that isn't frequent is taken for one with a chance of 10^-15.
IN_PLACE = 20_000


def letters_of(line: Column) -> Column:
    """The letters of a line, in order, without regard to case."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def hashed_lines(df: DataFrame, *, group: str, doc: str, text: str) -> DataFrame:
    """(g, doc, line_no, k1, k2): 96 bits of (group, letters). Lines without letters and
    rows without group, document or text are left out."""
    d = df.select(F.col(group).alias("g"), F.col(doc).alias("doc"), F.col(text).alias("x")).dropna()
    d = d.select("g", "doc", F.posexplode(F.split("x", "\n", -1)).alias("line_no", "line"))
    d = d.select("g", "doc", (F.col("line_no") + 1).alias("line_no"), letters_of(F.col("line")).alias("norm")).where("norm <> ''")
    return d.select("g", "doc", "line_no", F.xxhash64("g", "norm").alias("k1"), F.hash("norm", "g").alias("k2"))


def frequent_lines(df: DataFrame, *, group: str, doc: str, text: str, min_docs: int, min_share: float = 0.0) -> DataFrame:
    """(k1, k2, n_docs) of lines in at least ``min_docs`` distinct documents of the group
    and in at least ``min_share`` of the group's documents."""
    return _frequent(hashed_lines(df, group=group, doc=doc, text=text), df, group, doc, min_docs, min_share)


def _frequent(lines: DataFrame, df: DataFrame, group: str, doc: str, min_docs: int, min_share: float) -> DataFrame:
    key = ["g", "k1", "k2"] if min_share else ["k1", "k2"]
    counts = lines.select(*key, F.xxhash64("doc").alias("d")).distinct().groupBy(*key).agg(F.count("*").alias("n_docs"))
    counts = counts.where(F.col("n_docs") >= min_docs)
    if min_share:
        sizes = df.select(F.col(group).alias("g"), F.col(doc).alias("doc")).dropna().groupBy("g").agg(F.count_distinct("doc").alias("n_all"))
        counts = counts.join(sizes, "g").where(F.col("n_docs") >= F.lit(min_share) * F.col("n_all"))
    return counts.select("k1", "k2", "n_docs")


def flagged_lines(df: DataFrame, *, group: str, doc: str, text: str, min_docs: int, min_share: float = 0.0) -> DataFrame:
    """(doc, line_no) of every frequent line, once each.

    Texts are read and hashed once: the hashes are written to the shared folder, counted
    there and joined with the frequent ones; the folder keeps them until the result is cut.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "lines")
    hashed_lines(df, group=group, doc=doc, text=text).write.option("compression", "zstd").parquet(path)
    lines = spark.read.parquet(path)
    frequent = cut_lineage(_frequent(lines, df, group, doc, min_docs, min_share).select("k1", "k2"))
    small = frequent.count() * _ROW_BYTES <= BROADCAST_LIMIT
    hits = lines.select("doc", "line_no", "k1", "k2").join(F.broadcast(frequent) if small else frequent, ["k1", "k2"], "left_semi")
    hits = cut_lineage(hits.select("doc", "line_no").distinct())
    drop_scratch(spark, path)
    return hits


def remove_repeated_lines(df: DataFrame, *, group: str, doc: str, text: str, min_docs: int, min_share: float = 0.0) -> DataFrame:
    """All rows of ``df`` with ``clean_text`` and ``n_removed`` added.

    Lines are what "\n" separates; the kept ones are joined by it again, so a text without
    frequent lines comes out unchanged. Null texts stay null with 0 removed; rows without
    group or document keep their text. A frequent line is the same letters in the same
    order, whatever their case and whatever else the line holds. Documents that repeat
    count once for the threshold and are all cleaned. Existing columns are kept, except
    ones named clean_text and n_removed, which are replaced.

    Up to IN_PLACE frequent lines are a set within the expression that rebuilds a text, so
    texts aren't shuffled. Of more, the hits are joined back by document.
    """
    frequent = cut_lineage(frequent_lines(df, group=group, doc=doc, text=text, min_docs=min_docs, min_share=min_share).select("k1", "k2"))
    # the input travels as one struct, so none of its columns can clash with helpers
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    if frequent.count() <= IN_PLACE:
        base = df.select(row)
        x, g = F.col(f"_row.`{text}`"), F.col(f"_row.`{group}`")
        hashes = [r.k1 for r in frequent.select("k1").distinct().collect()]  # at most IN_PLACE
        known = f"IN ({', '.join(map(str, hashes))})" if hashes else "IN (NULL)"
        lines = F.transform(F.split(x, "\n", -1), lambda y: F.struct(y.alias("line"), F.xxhash64(g, letters_of(y)).alias("h")))
        usable = g.isNotNull() & F.col(f"_row.`{doc}`").isNotNull() & x.isNotNull()
        out = base.withColumn("_lines", F.when(usable, lines)).withColumn("_kept", F.expr(f"filter(_lines, y -> NOT coalesce(y.h {known}, false))"))
        n = F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0))
        clean = F.when(n > 0, F.array_join(F.transform("_kept", lambda y: y["line"]), "\n")).otherwise(x)
    else:
        hits = flagged_lines(df, group=group, doc=doc, text=text, min_docs=min_docs, min_share=min_share)
        per_doc = hits.groupBy(F.col("doc").alias("_hit_doc")).agg(F.collect_set("line_no").alias("_hit"))  # at most a document's lines
        base = df.select(row, F.col(doc).alias("_doc"))
        joined = base.join(per_doc, F.col("_doc") == F.col("_hit_doc"), "left")
        x = F.col(f"_row.`{text}`")
        out = joined.withColumn("_use", F.coalesce(F.when(F.col(f"_row.`{group}`").isNotNull() & x.isNotNull(), F.col("_hit")), F.array().cast("array<int>")))
        kept = F.filter(F.split(x, "\n", -1), lambda y, i: ~F.array_contains(F.col("_use"), (i + 1).cast("int")))
        n = F.size("_use")
        clean = F.when(n > 0, F.array_join(kept, "\n")).otherwise(x)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ("clean_text", "n_removed")], clean.alias("clean_text"), n.alias("n_removed"))


PARAMETERS = {"group": "source", "doc": "doc_id", "text": "text", "min_docs": 10}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = flagged_lines(table(spark, sf_dir, "news", "doc_id", "source", "text"), **PARAMETERS)
    return hits.select(F.col("doc").alias("doc_id"), "line_no")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "news", "doc_id", "source", "text")
    return remove_repeated_lines(distinct_rows(news, "doc_id"), **PARAMETERS).select("doc_id", "clean_text", "n_removed")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_clean": p2_clean}


_LINES = """
WITH raw AS (SELECT DISTINCT doc_id, source, text FROM news WHERE source IS NOT NULL AND text IS NOT NULL),
lines AS (
  SELECT doc_id, source, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM raw),
keyed AS (SELECT doc_id, source, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS norm FROM lines),
freq AS (SELECT source, norm FROM keyed WHERE norm <> '' GROUP BY source, norm HAVING count(DISTINCT doc_id) >= 10),
hits AS (SELECT DISTINCT doc_id, line_no FROM keyed JOIN freq USING (source, norm))
"""


def oracle_sql() -> dict[str, str]:
    clean = _LINES + """, marked AS (
  SELECT l.doc_id, l.source, l.line_no, l.line, h.line_no IS NOT NULL AS hit
  FROM lines l LEFT JOIN hits h ON l.doc_id = h.doc_id AND l.line_no = h.line_no),
built AS (
  SELECT doc_id, source, string_agg(CASE WHEN NOT hit THEN line END, chr(10) ORDER BY line_no) AS t, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS INTEGER) AS n
  FROM marked GROUP BY doc_id, source)
SELECT DISTINCT n.doc_id AS doc_id,
       CASE WHEN n.text IS NULL THEN NULL WHEN n.source IS NULL OR b.n = 0 THEN n.text ELSE coalesce(b.t, '') END AS clean_text,
       CASE WHEN n.text IS NULL OR n.source IS NULL THEN 0 ELSE coalesce(b.n, 0) END AS n_removed
FROM news n LEFT JOIN built b ON n.doc_id = b.doc_id AND n.source IS NOT DISTINCT FROM b.source"""
    return {"p2_found": _LINES + "SELECT doc_id, line_no FROM hits", "p2_clean": clean}
