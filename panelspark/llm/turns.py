"""Call transcripts into clean, ordered speaker turns.

Method: every line is taken apart by SQL expressions into time marks, label and speech;
speakers are carried forward over the lines of a transcript by windows; marked noise is
removed; and stretches of one speaker that follow each other get one island number
(gaps and islands) and are aggregated into a turn. One shuffle by document serves all
windows; the unit of work is one transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.tables import table

# Hesitations, and sound notes that stand in round brackets.
HESITATIONS = ("um", "uh", "uhm", "er", "hmm")
SOUNDS = ("laughter", "laughs", "laughing", "coughs", "coughing", "applause", "music", "crosstalk", "cross talk", "inaudible", "indiscernible", "unintelligible", "background noise", "technical difficulty", "technical difficulties", "pause", "silence", "sighs")

_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_MARK = rf"(?:\[{_CLOCK}\]|\({_CLOCK}\)|<{_CLOCK}>|(?<![\d:$]){_CLOCK}(?![\d:]))"
#: A time mark, alone or as a span.
TIME = rf"{_MARK}(?:\s*-->\s*{_MARK})?"
NOISE = rf"(?i)\[[\p{{L}} ,'-]{{2,40}}\]|<[\p{{L}} ]{{2,40}}>|\*[\p{{L}} ]{{2,40}}\*|♪[^♪\n]*♪|♪|\((?:{'|'.join(SOUNDS)})\)"
HESITATION = rf"(?i)(?:[—–-]\s*)?(?<![\p{{L}}\p{{N}}'’-])(?:{'|'.join(HESITATIONS)})(?![\p{{L}}\p{{N}}'’-])(?:\.{{2,}}|…|[,.])?(?:\s*[—–-](?=\s))?"

_HESITATES = rf"(?i)\b(?:{'|'.join(HESITATIONS)})\b"

_TOKEN = r"\p{Lu}[\p{L}\p{M}'’.-]*"
_PARTICLE = r"(?:de la |de |van der |van den |van |von |da |di |del |la |le |du |dos )"
_NAME = rf"{_PARTICLE}?{_TOKEN}(?: +{_PARTICLE}?{_TOKEN}){{0,4}}"
_LEAD = r"^(?:>>\s*)?(?:[QA]\s*[-–—]\s+)?"
_END = r"\s*[:：]"

#: Label forms: (expression, group of the name, group of the speech or None).
FORMS = (
    (r"^<v(?:\.[\w.]+)?\s+([^>]{2,60})>\s*(.*)$", 1, 2),
    (_LEAD + r"\*\*([^*:：]{2,60})[:：]?\*\*[:：]?\s*(.*)$", 1, 2),
    (_LEAD + r"\[([^\]:：\d]{2,60})\]\s*[:：]\s*(.*)$", 1, 2),
    (rf"^(?:>>\s*)?Speaker:\s*({_NAME})(?:\s+[-–—]\s*(.*))?$", 1, 2),
    (rf"{_LEAD}({_NAME})\s+--\s+[^:：]{{2,80}}?\s+--\s+[^:：]{{1,80}}$", 1, None),
    (rf"{_LEAD}({_PARTICLE}?{_TOKEN},\s*{_TOKEN}(?: +{_TOKEN})?){_END}\s*(.*)$", 1, 2),
    (rf"{_LEAD}({_NAME})(?:\s*\([^)]{{1,80}}\)|\s+[-–—]\s[^:：]{{2,60}}|,\s[^:：]{{2,60}})?{_END}\s*(.*)$", 1, 2),
)
#: What any label begins with; most lines of speech fail it at their second word.
_GATE = rf"^(?:[<*\[>]|[QA]\s*[-–—]|{_PARTICLE}?{_TOKEN}(?:,?\s+{_PARTICLE}?\p{{Lu}}|\s*[:：(]))"
#: A word of speech before any mark: the line then surely says something.
_PLAIN = rf"(?i)^[^\[(<*♪\d:：]*?(?<![\p{{L}}'’-])(?!(?:{'|'.join(HESITATIONS)})(?!\p{{L}}))\p{{L}}{{2,}}"
_ROLE_LINE = rf"^({_NAME})\s*(?:\([^)]{{3,60}}\)|\s[-–—]\s[^:：]{{3,60}}|,\s[^:：]{{3,60}})$"
_CALLED = rf"(?:line of|comes from|follow-up from|question from|turn (?:the call |it )?over to) ({_NAME}?\p{{L}})\."
_TITLE = r"^(?:mr|ms|mrs|miss|mx|dr|prof|sir|dame)\.? +"


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def clean_speech(c: Column) -> Column:
    """Speech without time marks, sound notes and hesitations, blanks collapsed.

    Each expression runs only where a cheap search says it can match. The steps are one-element
    transforms, so that a step names its text twice without computing it twice.
    """
    step = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    c = step(c, lambda x: F.when(x.contains(":"), F.regexp_replace(x, TIME, " ")).otherwise(x))
    c = step(c, lambda x: F.when(_any(x, ("[", "<", "*", "♪", "(")), F.regexp_replace(x, NOISE, " ")).otherwise(x))
    c = step(c, lambda x: F.when(x.rlike(_HESITATES), F.regexp_replace(x, HESITATION, " ")).otherwise(x))
    c = step(c, lambda x: F.when(_any(x, ("—", "–")), F.regexp_replace(x, r"(?:\s*[—–]\s*){2,}", " — ")).otherwise(x))
    return F.regexp_replace(_squeeze(c), r"\s+([,.;:?!])", "$1")


def _any(x: Column, marks: tuple[str, ...]) -> Column:
    hit = x.contains(marks[0])
    for m in marks[1:]:
        hit = hit | x.contains(m)
    return hit


def _said_name(c: Column) -> Column:
    """A label's name in lower case, "family, given" turned round, single blanks."""
    n = F.lower(_squeeze(F.translate(c, "’", "'")))
    n = F.regexp_replace(n, r"[.]+$", "")
    turned = F.regexp_replace(n, r"^([^,]+), *(.+)$", "$2 $1")
    return F.regexp_replace(F.when(n.rlike(r"\b(analyst|officer|relations|president|director|operator)$"), F.regexp_replace(n, r",.*$", "")).otherwise(turned), r"^(?:the|conference) operator$", "operator")


def speaker_turns(df: DataFrame, *, doc: str, text: str) -> DataFrame:
    """(doc_id, turn_no, speaker, speech): the clean turns of each transcript, from 1.

    speaker is the operator, "given family" in lower case as the transcript names the
    person in full, or the label itself for people without a name. A short label (title
    or initial with family name) is resolved by the full names of the same transcript;
    of several that fit, the first in the alphabet is taken, and one that none fits
    stays as labelled. What precedes the first label is no turn. Null and blank texts and
    transcripts without label give no rows, rows without id none either. Of rows with
    the same id the largest text counts. Other columns are ignored.
    """
    docs = df.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("x")).dropna().groupBy("doc_id").agg(F.max("x").alias("x"))
    lines = docs.select("doc_id", F.posexplode(F.split("x", r"\r\n|\n|\r")).alias("line_no", "line"))
    body = F.trim(F.regexp_replace(F.col("line"), rf"^\s*(?:{TIME}\s*)+", ""))
    lines = lines.withColumn("body", body)
    # plain speech is by far the most frequent: one cheap test spares it the label forms
    maybe = F.col("body").rlike(_GATE)
    part = lambda p, g: F.regexp_extract("body", p, g) if g else F.lit("")
    label = F.coalesce(*[F.when(F.col("body").rlike(p), F.struct(part(p, g).alias("name"), part(p, s).alias("rest"))) for p, g, s in FORMS])
    lines = lines.withColumn("label", F.when(maybe, label)).withColumn("said", _said_name(F.col("label.name")))
    titled = F.col("said").rlike(_TITLE)
    lines = lines.withColumn("core", F.regexp_replace("said", _TITLE, ""))
    short = titled | F.col("core").rlike(r"^(?:\p{L}\.? )+")
    initial = F.regexp_extract("core", r"^(\p{L})\.? ", 1)
    lines = lines.withColumn("initial", F.when(titled, "").otherwise(initial)).withColumn("family", F.when(F.col("initial") != "", F.regexp_replace("core", r"^(?:\p{L}\.? )+", "")).when(titled, F.col("core")))
    anonymous = F.col("said").rlike(r"^(?:unidentified|unknown|unnamed) ")
    operator = F.col("said") == "operator"
    named = F.col("core").contains(" ") | titled
    lines = lines.withColumn("is_label", F.coalesce(operator | anonymous | named, F.lit(False)))
    full = F.when(F.col("is_label") & ~operator & ~anonymous & ~short, F.col("core"))
    listed = F.when(F.col("label").isNull() & maybe & F.col("body").rlike(_ROLE_LINE), _said_name(F.regexp_extract("body", _ROLE_LINE, 1)))
    called = F.when(operator, _said_name(F.regexp_extract("label.rest", _CALLED, 1)))
    lines = lines.withColumn("full", F.nullif(F.coalesce(listed, full, called), F.lit("")))
    lines = lines.withColumn("full", F.when(F.col("full").contains(" ") & ~F.col("full").rlike(_TITLE) & ~F.col("full").rlike(r"^\p{L}\.? "), F.col("full")))
    lines = lines.withColumn("words", F.when(F.col("is_label"), F.coalesce(F.col("label.rest"), F.lit(""))).otherwise(F.col("line")))
    says = F.col("words").rlike(_PLAIN) | clean_speech(F.col("words")).rlike(r"[\p{L}\p{N}]")
    lines = lines.withColumn("says", says).drop("line", "body", "label")
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("line_no")
    lines = lines.withColumn("names", F.array_sort(F.collect_set("full").over(whole)))
    fits = F.expr("filter(names, n -> endswith(n, concat(' ', family)) AND (initial = '' OR startswith(n, initial)))")
    exact = F.expr("filter(names, n -> regexp_replace(n, '^\\\\S+ (?:\\\\p{L}\\\\.? )*', '') = family AND (initial = '' OR startswith(n, initial)))")
    speaker = F.when(operator | anonymous, F.col("said")).when(short, F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(fits, F.lit(1)), F.col("core"))).otherwise(F.col("core"))
    lines = lines.withColumn("speaker", F.when(F.col("is_label"), speaker)).select("doc_id", "line_no", "speaker", "words", "says", "is_label")
    lines = lines.withColumn("stretch", F.sum(F.col("is_label").cast("int")).over(order)).withColumn("who", F.last("speaker", ignorenulls=True).over(order))
    spoken = lines.where((F.col("stretch") > 0) & F.col("says"))
    spoken = spoken.withColumn("new", F.coalesce((F.lag("who").over(order) != F.col("who")).cast("int"), F.lit(1)))
    spoken = spoken.withColumn("turn_no", F.sum("new").over(order).cast("int"))
    return spoken.groupBy("doc_id", "turn_no").agg(F.first("who").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", clean_speech(F.col("words")).alias("words")))), lambda x: x["words"]), " ").alias("speech"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "ec", "doc_id", "text"), doc="doc_id", text="text").select("doc_id", "turn_no", "speaker")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "ec", "doc_id", "text"), doc="doc_id", text="text")


def queries() -> dict:
    return {"p5_found": p5_found, "p5_turns": p5_turns}


def turns_sql() -> str:
    """The same turns by plain SQL over ``ec``, with its own, simpler label expressions."""
    w = r"\p{Lu}[\p{L}'’-]*"
    clock = r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,3})?"
    tm = rf"[\[(]?{clock}[\])]?(?: --> {clock})?"
    forms = [
        ("body", r"^<v ([^>]+)>(.*)$"),
        ("body", r"^\*\*([^*]+):\*\*(.*)$"),
        ("body", r"^\[(Operator)\]:(.*)$"),
        ("body", rf"^Speaker: ((?:{w}|de)(?:\s+(?:{w}|de))+) ?-? ?(.*)$"),
        ("c", r"^([^:]{3,50}?) -- [^:]+ -- [^:]+()$"),
        ("c", r"^((?:The |Conference )?(?i:operator)|(?i:unidentified) \w+)\s*[:：](.*)$"),
        ("c", rf"^((?:(?:Mr|Ms|Mrs|Dr)\.\s+|\p{{Lu}}\.\s+)(?:de )?{w}|(?:de )?{w}, {w}|{w}\s+(?:(?i:de) )?{w})(?: \([^)]+\)| [-–] [^:]+|, (?:Analyst|Chief|Head)[^:]*)?\s*[:：](.*)$"),
    ]
    q = lambda s: "'" + s.replace("'", "''") + "'"
    pick = lambda g: "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(f)}) THEN regexp_extract({c}, {q(f)}, {g})" for c, f in forms) + " END"
    noise = [tm, r"<inaudible>|\((?:laughter|coughs)\)|\[(?:crosstalk|Technical difficulty|music|applause)\]|♪ ♪|\*background noise\*", r"(?i)\b(?:um|uh|uhm|er|hmm)\b"]
    body = "words"
    for n in noise:
        body = f"regexp_replace({body}, {q(n)}, '', 'g')"
    return f"""WITH d AS (SELECT doc_id, string_split(replace(max(text), chr(13), ''), chr(10)) AS x FROM ec WHERE text IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS no, unnest(x) AS line FROM d),
b AS (SELECT *, trim(regexp_replace(line, {q(rf'^\s*(?:{tm}\s*)+')}, '')) AS body FROM l),
c AS (SELECT *, regexp_replace(body, '^(?:>> ?|[QA] - )', '') AS c FROM b),
n AS (SELECT doc_id, no, line, {pick(1)} AS name, {pick(2)} AS rest FROM c),
m AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS n0, sum(CASE WHEN name IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS k FROM n),
s AS (SELECT *, CASE WHEN n0 LIKE '%operator' THEN 'operator' ELSE regexp_replace(n0, '^(.+), (.+)$', '\\2 \\1') END AS said FROM m),
fulls AS (SELECT doc_id, said AS f FROM s WHERE said LIKE '% %' AND NOT regexp_matches(said, '^(?:mr|ms|mrs|dr|\\p{{L}})\\. ') AND said NOT LIKE 'unidentified%'
  UNION SELECT doc_id, lower(regexp_extract(line, {q(rf'^({w} (?:de )?{w})(?: \(|, | - )')}, 1)) FROM s WHERE k = 0 AND no > 2 AND regexp_matches(line, {q(rf'^{w} (?:de )?{w}(?: \(|, | - )')})),
short AS (SELECT doc_id, no, regexp_extract(said, '^(mr|ms|mrs|dr|\\p{{L}})\\. (.+)$', 1) AS t, regexp_extract(said, '^(mr|ms|mrs|dr|\\p{{L}})\\. (.+)$', 2) AS fam FROM s WHERE regexp_matches(said, '^(?:mr|ms|mrs|dr|\\p{{L}})\\. ')),
found AS (SELECT h.doc_id, h.no, coalesce(min(f.f), any_value(h.fam)) AS who FROM short h LEFT JOIN fulls f ON f.doc_id = h.doc_id AND f.f[instr(f.f, ' ') + 1:] = h.fam AND (length(h.t) > 1 OR f.f[1:1] = h.t) GROUP BY h.doc_id, h.no),
w AS (SELECT s.doc_id, s.no, s.k, CASE WHEN s.name IS NOT NULL THEN coalesce(g.who, s.said) END AS who, CASE WHEN s.name IS NULL THEN s.line ELSE s.rest END AS words FROM s LEFT JOIN found g ON g.doc_id = s.doc_id AND g.no = s.no WHERE s.k > 0),
st AS (SELECT doc_id, k, max(who) AS who, bool_or(regexp_matches({body}, '[\\p{{L}}\\p{{N}}]')) AS spoken FROM w GROUP BY doc_id, k),
i AS (SELECT doc_id, k, who, CASE WHEN lag(who) OVER (PARTITION BY doc_id ORDER BY k) = who THEN 0 ELSE 1 END AS new FROM st WHERE spoken),
t AS (SELECT doc_id, k, who, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS turn FROM i)
SELECT doc_id, CAST(turn AS INTEGER) AS turn_no, any_value(who) AS speaker FROM t GROUP BY doc_id, turn"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": turns_sql()}
