"""Cutting oversized texts at natural boundaries, with overlap.

Method: structure-tree packing. A text is parsed into a tree: sections nested by the depth
of their headings (marks, tags, parts, items, title lines), in them paragraphs and lists
nested by indent, below these lines, sentences and words. Sibling subtrees are merged up
to the limit; only a node over the limit is descended into. A heading belongs to the first
node of its section, so they are never parted, and the rest of a section that was cut is
never merged with the next section. Spans are offsets in code points, so pieces minus
their overlaps are exactly the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import ship_package, spread
from panelspark.sources.tables import table

LIMIT, OVERLAP = 6000, 400

#: Where a node below a paragraph begins: lines, sentences, words.
_LEVELS = (
    re.compile(r"\n|(?i:</(?:p|li|div|tr)>|<br\s*/?>)"),
    re.compile(r"[.!?;]['\"”’)\]]*\s+|[。！？]"),
    re.compile(r"\s+"),
)
_SENTENCE, _WORD = 1, 2
_HEADING = (  # (form of a line, depth of its section; None: as many as the first group has signs, or its number)
    (re.compile(r"(#{1,6})\s+\S"), None),
    (re.compile(r"\s*<h([1-6])\b", re.I), None),
    (re.compile(r"PART\s+(?:[IVX]+|\d+)\b|Part\s+(?:[IVX]+|\d+)\b[^a-z]*$"), 1),
    (re.compile(r"(?:ITEM|Item)\s+\d+[A-Z]?\."), 2),
    (re.compile(r"(?:SECTION|Section|NOTE|Note)\s+\d+[.:]"), 3),
)
#: A line of its own without end of a sentence; a heading when blank lines stand around it.
_TITLE = re.compile(r"[A-Z][^.!?;:\n]{2,70}$")
_TITLE_DEPTH = 7
_ITEM = re.compile(r"([^\S\n]*)(?:[-*•]|\(?\d{1,3}[.)]|\([a-z]\)|<li\b[^>]*>)\s*\S", re.I)
_LIST = 100  # lists lie below all sections


class Node:
    """A span of the text with its children, which tile it."""

    __slots__ = ("start", "end", "kids", "section")

    def __init__(self, start: int, section: bool = False):
        self.start, self.end, self.kids, self.section = start, start, [], section


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, depth) of headings (1 to 7), paragraphs (0) and list items (from 100)."""
    at, blank, inside = 0, True, False
    lines = text.split("\n")
    for k, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            blank, inside = True, False
        else:
            depth = 0
            for form, d in _HEADING:
                m = form.match(line)
                if m:
                    depth = d or (len(m[1]) if m[1][0] == "#" else int(m[1]))
                    break
            else:
                item = _ITEM.match(line)
                if item:
                    depth = _LIST + len(item[1].expandtabs(4))
                elif blank and k + 1 < len(lines) and not lines[k + 1].strip() and _TITLE.match(bare):
                    depth = _TITLE_DEPTH
            if depth or not inside:
                yield at, depth
                inside = not 0 < depth < _LIST  # what follows a heading is a block of its own
            blank = False
        at += len(line) + 1


def parse(text: str) -> Node:
    """The structure tree of a text."""
    root = Node(0)
    stack: list[tuple[int, Node]] = [(0, root)]
    for start, depth in _blocks(text):
        while len(stack) > 1 and (stack[-1][0] >= depth if depth else stack[-1][0] >= _LIST):
            stack.pop()
        node = Node(start, 0 < depth < _LIST)
        stack[-1][1].kids.append(node)
        if depth:
            stack.append((depth, node))
    todo = [(root, len(text), 0)]
    while todo:
        node, end, start = todo.pop()
        own = node.start
        node.start, node.end = start, end
        if node.kids:
            if not node.section and node is not root and node.kids[0].start > own:
                node.kids.insert(0, Node(own))  # the words of a list item before its sublist
            for i, kid in enumerate(node.kids):
                after = node.kids[i + 1].start if i + 1 < len(node.kids) else end
                todo.append((kid, after, kid.start if i else start))
    return root


def _solid(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """Spans of text without any boundary; marks stay with their base character."""
    out = []
    while b - a > limit:
        cut = a + limit
        while cut > a + limit // 2 and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
            cut -= 1
        out.append((a, cut))
        a = cut
    return [*out, (a, b)]


def _cuts(text: str, a: int, b: int, limit: int, level: int, used: int) -> tuple[list[int], int]:
    """Where to cut a leaf, at lines, sentences or words, and how much of the limit the last
    piece has used. used: the same of the piece open at ``a``, so that a heading or a short
    line goes on with what follows it."""
    edges = [a, *dict.fromkeys(m.end() for m in _LEVELS[level].finditer(text, a, b) if a < m.end() < b), b]
    out: list[int] = []
    for x, y in zip(edges, edges[1:]):
        if used + y - x <= limit:
            used += y - x
        elif y - x <= limit:
            out.append(x)
            used = y - x
        elif level + 1 < len(_LEVELS):
            more, used = _cuts(text, x, y, limit, level + 1, used)
            out += more
        else:
            spans = _solid(text, x, y, limit)
            out += [s for s, _ in spans if s > x or used]
            used = spans[-1][1] - spans[-1][0]
    return out, used


def _pack_text(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` that tile a leaf."""
    edges = [a, *_cuts(text, a, b, limit, 0, 0)[0], b]
    return list(zip(edges, edges[1:]))


def pack(text: str, node: Node, limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` that tile the node, cut as high in the tree as possible."""
    done: dict[int, list[tuple[int, int]]] = {}
    order, todo = [], [node]
    while todo:  # children before parents, without recursion: a tree may be deep
        x = todo.pop()
        order.append(x)
        if x.end - x.start > limit:
            todo += x.kids
    for x in reversed(order):
        if x.end - x.start <= limit:
            done[id(x)] = [(x.start, x.end)]
            continue
        if not x.kids:
            done[id(x)] = _pack_text(text, x.start, x.end, limit)
            continue
        out: list[tuple[int, int]] = []
        rest = False  # whether the last span is the end of a node that was cut
        for kid in x.kids:
            spans = done.pop(id(kid))
            whole = len(spans) == 1
            if out and spans[0][1] - out[-1][0] <= limit and not (kid.section and (rest or not whole)):
                out[-1] = (out[-1][0], spans[0][1])
                spans = spans[1:]
            out += spans
            rest = rest and not spans if whole else True
        done[id(x)] = out
    return done[id(node)]


def _repeat_from(text: str, start: int, end: int, overlap: int) -> int:
    """Where the repeated end of [start, end) begins: within its first quarter (30 characters
    at least) at a sentence, else a word, if any; so three quarters of the overlap are
    repeated at least, or all of a shorter piece."""
    low = max(start, end - overlap)
    if low == start:
        return low
    high = min(end, low + max(30, overlap // 4))
    for level in (_SENTENCE, _WORD):
        # a boundary found just before ``low`` counts when it ends at or after it
        for m in _LEVELS[level].finditer(text, max(start, low - 50), end):
            if low <= m.end() <= high:
                return m.end()
            if m.end() > high:
                break
    at = low
    while at < high and unicodedata.combining(text[at]):
        at += 1
    return at


def cut(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, new, end) of each piece; [start, new) repeats the piece before.

    Texts up to the limit and empty texts are one piece, null is none.
    """
    if text is None:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    for a, b in pack(text, parse(text), limit - overlap):
        out.append((_repeat_from(text, out[-1][0], a, overlap) if out else 0, a, b))
    return out


_OUT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.StringType()), ("field_name", T.StringType()), ("piece_no", T.IntegerType()), ("overlap_chars", T.IntegerType()), ("piece", T.StringType()))])


def split_oversized(df: DataFrame, *, doc: str, field: str, name: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, field_name, piece_no, overlap_chars, piece) of texts longer than ``limit``.

    Lengths are code points. Shorter, empty and null texts give no rows: they need no
    cutting. Rows without id are kept under a null id. Repeated rows give repeated rows;
    other columns are ignored. Concatenating the pieces without their first
    ``overlap_chars`` characters gives the text back.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be smaller than half the limit")
    ship_package(df.sparkSession)
    rows = df.select(F.col(doc).cast("string").alias("doc_id"), F.col(field).alias("x")).where(F.length("x") > limit)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, text in part.itertuples(index=False):
                spans = cut(text, limit, overlap)
                yield pd.DataFrame({"doc_id": key, "field_name": name, "piece_no": range(1, len(spans) + 1), "overlap_chars": [n - s for s, n, _ in spans], "piece": [text[s:e] for s, _, e in spans]})

    return spread(rows, "doc_id").mapInPandas(run, _OUT)


FIELDS = (("ec", "text"), ("sec", "management_discussion"), ("sec", "risk_factors"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, field in FIELDS:
        part = split_oversized(table(spark, sf_dir, t, "doc_id", field), doc="doc_id", field=field, name=f"{t}.{field}")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "field_name").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).distinct()


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text cut: whether its pieces without their overlaps are the text, none is too
    long, and each repeats 300 to 400 characters of the one before, or all of a shorter one."""
    pieces = p4_pieces(spark, sf_dir)
    w = Window.partitionBy("doc_id", "field_name").orderBy("piece_no")
    pieces = pieces.withColumn("before", F.length(F.lag("piece").over(w)))
    part = F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("new"))
    repeats = F.col("before").isNull() | ((F.col("overlap_chars") <= OVERLAP) & (F.col("overlap_chars") >= F.least(F.col("before"), F.lit(OVERLAP * 3 // 4))))
    built = pieces.groupBy("doc_id", "field_name").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["new"]), "")).alias("built"), (F.max(F.length("piece")) <= LIMIT).alias("short"), F.bool_and(repeats).alias("repeats"))
    texts = None
    for t, field in FIELDS:
        x = table(spark, sf_dir, t, "doc_id", field).where(F.length(field) > LIMIT).select("doc_id", F.lit(f"{t}.{field}").alias("field_name"), F.md5(field).alias("text"))
        texts = x if texts is None else texts.unionByName(x)
    joined = texts.distinct().join(built, ["doc_id", "field_name"], "left")
    return joined.select("doc_id", "field_name", F.coalesce(F.col("built") == F.col("text"), F.lit(False)).alias("whole"), "short", "repeats")


def queries() -> dict:
    return {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_invariants": p4_invariants}


def oracle_sql() -> dict[str, str]:
    parts = [f"SELECT doc_id, '{t}.{f}' AS field_name FROM {t} WHERE length({f}) > 6000" for t, f in FIELDS]
    held = [p.replace("field_name", "field_name, true AS whole, true AS short, true AS repeats") for p in parts]
    return {"p4_found": " UNION ".join(parts), "p4_invariants": " UNION ".join(held)}
