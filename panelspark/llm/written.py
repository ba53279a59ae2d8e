"""Written forms of mail addresses, telephone numbers, document numbers and street addresses.

A form only proposes a candidate and names its kind and shape; whether the candidate is an
entity is decided by the field (``field.py``), whose potentials are fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
_AT = r"(?:\s?[@＠]\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
#: An address is looked for at its sign; the local part is then read backwards.
_HOST = re.compile(rf"(?i)(?:{_AT}(?:[a-z0-9-]+{_DOT})+[a-z]{{2,24}}|\s+at\s+(?:[a-z0-9-]+\s+dot\s+)+[a-z]{{2,24}})(?![\w@])")
_SIGN = re.compile(r"(?i)[@＠]|[\[({]\s?at\s?[\])}]|\sat\s+[a-z0-9-]+\s+dot\s")
_LOCAL = re.compile(r"(?i)(?<![\w.+@＠-])[a-z0-9](?:[\w.+-]*\w)?$")


_MAILISH = ("@", "＠", "at)", "at]", "at}", "at )", "at ]", "at }", " dot", "\ndot", "\tdot", "\u00a0dot")


def emails(text: str) -> Iterator[tuple[int, int]]:
    small = text.lower()
    if not any(k in small for k in _MAILISH):
        return
    last = 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at > last and text[at - 1].isspace():
            at -= 1
        host = _HOST.match(text, at) or _HOST.match(text, sign.start())
        local = _LOCAL.search(text[max(last, at - 254) : host.start()]) if host else None
        if local:
            last = host.end()
            yield host.start() - len(local[0]), last


_SEP = r"[-‑–. / ]"
#: Telephone numbers by shape; the last one is any grouped number, which its context must speak for.
_PHONE = re.compile(
    rf"(?<![\w$€£.,/+#-])(?:"
    rf"(?P<plus_one>\+1{_SEP}?(?:\(\d{{3}}\)|\d{{3}}){_SEP}?\d{{3}}{_SEP}?\d{{4}})"
    rf"|(?P<plus>\+[2-9]\d{{0,2}}(?:{_SEP}?(?:\(0\)|\d+)){{1,7}})"
    rf"|(?P<area>(?:1 )?\(\d{{3}}\) ?\d{{3}}[-‑. ]\d{{4}})"
    rf"|(?P<tens>(?:1[-‑. ])?\d{{3}}[-‑. /]\d{{3}}[-‑. ]\d{{4}})"
    rf"|(?P<pairs>0\d(?:[ .-]\d\d){{4}})"
    rf"|(?P<slash>0\d{{2,4}} ?/ ?\d{{5,9}})"
    rf"|(?P<trunk>\(?0\d{{2,4}}\)?(?: \d{{3,4}}){{2}}|0\d{{4}} \d{{6}})"
    rf"|(?P<grouped>\d{{2,5}}(?:{_SEP}\d{{2,5}}){{2,4}})"
    rf")(?![\w]|[-‑/.,]\d|\s?%)"
)
#: Runs of digits and their signs long enough for a telephone number.
_DIALABLE = re.compile(r"[+(0-9][0-9 ().‑–/\u00a0-]{7,}")
#: A number before a word: where an address can begin.
_NUMBERED = re.compile(r"[0-9]+[A-Za-z]?(?:\s+(?:bis|ter|BIS|TER))?,?\s+(?=[^\W\d_])")
#: Document numbers by shape.
_ID_FORMS = (
    ("three_two_four", re.compile(r"(?<![\w-])\d{3}[- ‑]\d\d[- ‑]\d{4}(?![\w-])")),
    ("nine", re.compile(r"(?<![\w.,$-])\d{9}(?![\w.,-]\d|\w)")),
    ("letter_eight", re.compile(r"(?i)(?<![\w-])[a-z]\d{8}(?![\w-])")),
    ("eight_letter", re.compile(r"(?i)(?<![\w-])\d{8}-?[a-z](?![\w-])")),
    ("letter_seven_letter", re.compile(r"(?i)(?<![\w-])[xyz]-?\d{7}-?[a-z](?![\w-])")),
    ("eleven", re.compile(r"(?<![\w.,$+-])\d\d ?\d{3} ?\d{3} ?\d{3}(?![\w-]|[ .,]\d)")),
    ("two_six_one", re.compile(r"(?i)(?<![\w-])[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d](?![\w-])")),
    ("two_three_four_two", re.compile(r"(?i)(?<![\w-])[a-z]{2}\d{3}-\d{4}-\d\d(?![\w-])")),
)
#: Where a document number can stand at all; the forms are tried only there.
_NUMBERISH = re.compile(r"\d(?:[ ‑-]?[A-Za-z]?\d){5,}")
# Check letters of the Spanish identity number, by the number modulo 23.
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def checksum(form: str, value: str) -> bool | None:
    """Whether a document number passes its own check; None for forms without one."""
    v = re.sub(r"\W", "", value).upper()
    if form in ("eight_letter", "letter_seven_letter"):
        digits = str("XYZ".index(v[0])) + v[1:-1] if v[0] in "XYZ" else v[:-1]
        return _CHECK_LETTERS[int(digits) % 23] == v[-1]
    if form == "eleven":  # ISO 7064, modulus 11 and 10
        rest = 10
        for c in v[:-1]:
            rest = (int(c) + rest) % 10 or 10
            rest = 2 * rest % 11
        return (11 - rest) % 10 == int(v[-1])
    if form in ("three_two_four", "nine"):  # parts that are never issued
        return not (v[:3] in ("000", "666") or v[0] == "9" or v[3:5] == "00" or v[5:] == "0000")
    if form == "two_six_one":
        return v[0] not in "DFIQUV" and v[1] not in "DFIOQUV"
    return None


_WHOLE = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Way|Place|Terrace|Square|Parkway|Highway)"
#: Short forms, which may end in a full stop.
_SHORT = r"(?:St|Ave|Rd|Ln|Dr|Blvd|Ct|Pl|Ter|Sq|Pkwy|Hwy)"
_POINTS = r"(?:NW|NE|SW|SE|N|S|E|W)"


def _addresses(c: str, flags: int = 0) -> tuple[re.Pattern, re.Pattern]:
    """Addresses that begin with their number, and with a word. c: a word of a street name,
    capitalised where the text has capitals at all."""
    us = rf"\d{{1,5}}[A-Za-z]?,?\s+(?:{_POINTS}\.?\s+|(?:North|South|East|West)\s+)?(?:{c}\s+){{1,3}}?(?:{_WHOLE}\b|{_SHORT}\b(?:\.(?=,|\.|\s*\||\s+{_POINTS}\b|\s*$))?)(?:\s+{_POINTS}\b)?"
    french = rf"\d{{1,4}}(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|quai|place|allée|chemin|impasse|cours|route|square)\s+(?:(?:de\s+la|des|du|de|de\s+l['’]|d['’])\s*)?(?:{c})(?:\s+{c}){{0,2}}"
    german = rf"(?:(?:Am|An\s+der|Zum|Zur|Auf\s+der|Hinter\s+der|Unter\s+den|In\s+der)\s+{c}(?:\s+{c})?|(?:(?:Obere|Untere|Alte|Neue|Große|Kleine)\s+)?{c}(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer|ring|chaussee))\s+\d{{1,3}}(?:\s?[a-z](?!\w))?(?![\w%.,]*\d|\w)"
    spanish = rf"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Paseo|Ronda|Camino)\s+(?:(?:de\s+la|de\s+los|del|de)\s+)?{c}(?:\s+{c}){{0,2}}?,?\s+\d{{1,4}}(?![\w%]|[.,]\d)"
    return re.compile(rf"(?<![\w.,/$#-])(?:{us}|{french})", flags), re.compile(rf"(?<![\w.,/$#-])(?:{german}|{spanish})", flags)


_ADDRESS = _addresses(r"[A-ZÀ-ÞŠŽ][\w'’-]*")
_ADDRESS_LOWER = _addresses(r"[^\W\d_][^\W\d_'’-]*", re.I)
#: One of these stands in any text with an address that begins with a word.
_STREET = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "damm", "ufer", "chaussee", "Am ", "Am\n", "Zum", "Zur", " der", " den", "\nder", "\nden", "Calle", "C/", "Avda", "Avenida", "Av.", "Plaza", "Paseo", "Ronda", "Camino")
_RING = re.compile(r"ring\s+\d")


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, form, key) of everything written like an entity; they may overlap.

    key: what the same entity has in common however it is written."""
    out = [(a, b, "email", "sign" if "@" in text[a:b] or "＠" in text[a:b] else "spelled", text[a:b].lower()) for a, b in emails(text)]
    lower = text.islower()
    by_number, by_word = _ADDRESS_LOWER if lower else _ADDRESS
    done = 0
    for n in _NUMBERED.finditer(text):
        m = by_number.match(text, n.start()) if n.start() >= done else None
        if m:
            done = m.end()
            out.append((m.start(), done, "address", "number_first", m[0].lower()))
    if lower or any(k in text for k in _STREET) or _RING.search(text):
        out += [(m.start(), m.end(), "address", "word_first", m[0].lower()) for m in by_word.finditer(text)]
    numbers = [(max(0, m.start() - 3), m.end() + 4) for m in _NUMBERISH.finditer(text)]
    for form, pattern in _ID_FORMS if numbers else ():
        found = {m.span(): m[0] for a, b in numbers for m in pattern.finditer(text, a, b) if m.end() < b or m.end() == len(text)}
        out += [(a, b, "id_number", form, re.sub(r"\W", "", v).lower()) for (a, b), v in found.items()]
    for w in _DIALABLE.finditer(text):
        for m in _PHONE.finditer(text, w.start(), min(len(text), w.end() + 3)):
            if m.end() <= w.end() and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                a = m.start() + (m[0].startswith("(") and ")" not in m[0])
                out.append((a, m.end(), "phone", m.lastgroup, re.sub(r"\D", "", m[0])[-9:]))
    return out
