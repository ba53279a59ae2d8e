"""A skip-chain conditional random field that marks the entities of a text.

Nodes are all words that could belong to a name (every capitalised word, and words the
lexicon knows in any case) and all candidates written like a mail address, telephone
number, document number or street address. A node's potential is a sum of fitted weights
of what it looks like and of the words around it. Two kinds of links couple nodes: the
chain between neighbours of one phrase, by how they are joined, and skips between distant
nodes that are equal up to case and accents or similar (one letter apart, or of one stem;
numbers with the same digits). Loopy message passing settles all nodes of a batch at once,
in time linear in the links.

Everything is fitted on the texts themselves, all of them, without hand labels. What the fit
needs are counts that add up over the parts of a corpus (``count``, ``contexts``). Titles and plain announcing
words seed a lexicon of given names and a model of family names over beginnings and
endings; what these mark surely is labelled, what they surely don't mark is labelled as no
name, the rest is left open. Weights and couplings then maximise the pseudo-likelihood of
the labels, each node given its neighbours. Every node counts twice, once as it stands and
once without what the lexicon knows about it (numbers: without their announcing words), so
context and links have to carry words that the texts never showed.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

import numpy as np

from panelspark.llm.written import candidates, checksum

# Titles that precede a name and don't belong to it.
TITLES = frozenset(("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "dame", "herr", "frau", "mme", "mlle", "señor", "señora", "sr", "sra", "monsieur", "madame", "signor", "signora"))
# Plain words that announce a name, for the first labels only.
ANNOUNCED = ("My name is", "Signed:", "regards,", "Contact", "Contacto:", "According to", "thanked", "Attn:", "signed by", "sold by", "Moderator")
# Words that announce a number of each kind, for the first labels only.
CUES = {
    "phone": {"call", "phone", "telephone", "tel", "telefon", "teléfono", "fax", "mobile", "dial", "ring", "ping", "reached", "voicemail"},
    "id_number": {"ssn", "security", "taxpayer", "passport", "passeport", "reisepass", "pasaporte", "dni", "nie", "nif", "steuer", "insurance", "nino", "licence", "license", "führerschein"},
    "email": {"mail", "mailto", "email", "write", "cc", "enquiries", "unsubscribe", "reply", "contact"},
    "address": {"address", "lives", "notices", "adresse", "anschrift", "domicilio", "sent"},
}
# Words that announce another kind of number, for the first labels only.
OTHERS = {"invoice", "order", "cusip", "isin", "file", "exhibit", "tracking", "build"}
#: Prior means of potentials and links: what holds where the texts say nothing. Other potentials have 0, other links 0.3.
PRIOR = {"b:email": 3.0, "b:phone": 2.0, "b:address": 2.0, "b:id_number": 1.0, "f:grouped": -4.0, "f:nine": -2.5, "f:eleven": -3.0, "check": 1.0, "a:title": 2.0} | {f"w:{k}:{w}": 4.0 for k, v in CUES.items() for w in v} | {f"w:{k}:{w}": -4.0 for k in CUES for w in OTHERS}
LINK_PRIOR = {"same number": 1.0}
#: Share of true entities that are announced, at the least; below it a shape is trusted in proportion.
ANNOUNCED_SHARE = 0.3
#: Words on either side of a node that are told apart: those seen this often.
SEEN = 15
#: How often a word is seen is counted per so many texts where there are more, so that what counts
#: as common or new is the same frequency in a corpus of any size.
PER = 6000
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"([^\W\d_]+)")
_AT = re.compile(r"[@＠]|[(\[{]at[)\]}]")
_MAIL = re.compile(rf"\S*(?:{_AT.pattern})\S*")
#: A postcode, in what follows an address.
_TAIL = re.compile(r"(?i)(?<![\w-])(?:(?:[a-z]{2} )?\d{5}|[a-z]{1,2}\d[a-z\d]? \d[a-z]{2})(?![\w-])")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]")
_BUCKETS = 1 << 14
# Small words inside a name, in any case.
PARTICLES = frozenset(("de", "dé", "van", "von", "del", "di", "la", "bin", "al", "der", "den"))
_INNER = PARTICLES | {"o", "d"}
_EASY = {"email": 0, "address": 1, "id_number": 2, "phone": 3}


def plain(word: str) -> str:
    """Lower case without accents."""
    low = word.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


def _traits(w: str) -> list[int]:
    parts = [f"<{w[:k]}" for k in (3, 4, 5, 6)] + [f"{w[-k:]}>" for k in (2, 3, 4, 5, 6)] + [f"n{min(len(w), 14)}", "b"]
    return [zlib.crc32(p.encode()) % _BUCKETS for p in parts]


@dataclass
class NameModel:
    """given: share of a word's capitalised uses that are given names; affix: weights of
    beginnings and endings of family names; counts: (capitalised, small) uses of words,
    per ``PER`` texts; weights: potential of each feature; couplings: of each kind of link."""

    given: dict[str, float] = field(default_factory=dict)
    affix: np.ndarray = field(default_factory=lambda: np.zeros(_BUCKETS))
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    couplings: dict[str, float] = field(default_factory=dict)

    def family(self, w: str) -> float:
        return float(self.affix[_traits(w)].sum())

    def to_json(self) -> str:
        at = np.flatnonzero(self.affix)
        return json.dumps({"given": self.given, "at": at.tolist(), "affix": self.affix[at].tolist(), "counts": self.counts, "weights": self.weights, "couplings": self.couplings})

    @staticmethod
    def from_json(s: str) -> NameModel:
        d = json.loads(s)
        affix = np.zeros(_BUCKETS)
        affix[d["at"]] = d["affix"]
        return NameModel(d["given"], affix, {k: tuple(v) for k, v in d["counts"].items()}, d["weights"], d["couplings"])


# ---------------------------------------------------------------- nodes, features, links


def _joint(gap: str) -> str:
    """How two words are joined, by what stands between them; "" if they are not."""
    if gap.isspace():
        return "line" if "\n" in gap else "blank"
    if re.fullmatch(r"-(?:[oO]['’])?|['’]", gap):
        return "hyphen"
    if re.fullmatch(r",\s+", gap):
        return "comma"
    if re.fullmatch(r"\s+(?:[^\W\d_]\.\s*)+\s+(?:[dD][eEéÉ]\s+|van\s+|von\s+)?(?:[oO]['’])?", gap):
        return "initial"
    if re.fullmatch(r"\s+(?:(?:[dD][eEéÉ]|van|von|del|di|la|bin|al)\s+)?(?:[oO]['’])?", gap):
        return "particle"
    return ""


def _side(gap: str) -> str:
    """Kind of what stands before or after a word."""
    if not gap or gap == "\0":
        return "edge"
    if gap.isspace():
        return "line" if "\n" in gap else "blank"
    for kind, marks in (("stop", ".!?;"), ("comma", ","), ("colon", ":："), ("line", "\n"), ("quote", "\"'’”“()[]{}<>|"), ("hyphen", "-")):
        if any(m in gap for m in marks):
            return kind
    return "other"


class Word(NamedTuple):
    """What is known of a word wherever it stands."""

    key: str
    given: float
    family: float
    cap: int
    low: int
    node: bool  # may be part of a name where the text has capitals
    lexical: bool  # may be one in any case
    own: tuple  # features
    bare: tuple  # features of a word that the lexicon doesn't know
    like: tuple  # keys that similar words share
    small: str
    before: str  # feature of the word after it
    after: str  # feature of the word before it
    kind: str  # common or open
    new: bool  # hardly or never seen


class Nodes:
    """Nodes of texts with their features; remembers what it knows of words and gaps."""

    MEMO = 300_000

    def __init__(self, model: NameModel):
        self.model = model
        self.words: dict[str, Word] = {}
        self.joints: dict[str, str] = {}
        self.sides: dict[str, str] = {}
        self.cues = OTHERS.union(*CUES.values())
        self.common = {w for w, (cap, low) in model.counts.items() if cap + low >= SEEN and w not in model.given and not (low <= 0.4 * cap + 1 and model.family(w) > 0)}
        self.cues |= self.common

    def word(self, w: str) -> Word:
        hit = self.words.get(w)
        if hit is None:
            if len(self.words) > self.MEMO:
                self.words.clear()
            key = plain(w)
            given = self.model.given.get(key, 0.0)
            cap, low = self.model.counts.get(key, (0, 0))
            seen = "new" if cap + low < 3 else "low" if low > 0.4 * (cap + low) else "few" if cap < 30 else "cap"
            fam = self.model.family(key) if len(key) > 3 else -1.0
            shape = "small" if w[0].islower() else "upper" if w.isupper() and len(w) > 1 else "cap"
            fit = f"f{max(-3, min(3, int(fam // 1)))}" if seen != "new" or fam > 0 else "f?"
            base = ("b:name", f"s:{shape}", f"l{min(len(key), 9)}")
            own = (*base, f"g{int(given * 4)}", f"{fit}:{seen}", f"v:{seen}")
            bare = (*base, "g0", "f?:new", "v:new")
            like: tuple = ()
            if len(key) >= 5 and (given > 0 or fam > 0 or seen in ("new", "few")):
                like = (key, *{key[:i] + key[i + 1 :] for i in range(len(key))}, *(("^" + key[:6],) if len(key) > 6 else ()))
            small, common = w.lower(), key in self.common
            inside = len(w) < 2 or small in PARTICLES or small in TITLES and len(w) < 6
            lexical = not inside and (given > 0 or fam > 1.0 and seen != "low")
            hit = Word(key, given, fam, cap, low, lexical or not inside and w[0] != small[0], lexical, own, bare, like, small, f"p:{small}" if common else "p:*", f"q:{small}" if common else "q:*", "common" if common else "open", seen == "new")
            self.words[w] = hit
        return hit

    def _memo(self, memo: dict, f, gap: str) -> str:
        if len(gap) > 12:
            return f(gap)
        hit = memo.get(gap)
        if hit is None:
            if len(memo) > self.MEMO:
                memo.clear()
            hit = memo[gap] = f(gap)
        return hit

    def spans(self, text: str) -> list[tuple[int, int, str, str, tuple, tuple]]:
        """(start, end, kind, key, features, features without announcing words)."""
        out = []
        for a, b, kind, form, key in candidates(text):
            before = [w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])[-4:]]
            after = _WORD.search(text, b, b + 12)
            ok = checksum(form, text[a:b]) if kind == "id_number" else None
            bare = [f"b:{kind}", f"f:{form}"]
            if kind in ("phone", "id_number"):
                bare.append(f"h:{kind}:" + _DIGIT.sub("9", _LETTER.sub("a", text[a:b]))[:16])
            if ok:
                bare.append("check")
            if kind == "address" and _TAIL.search(text, b, b + 60):
                bare.append("tail")
            cues = [f"w:{kind}:{w}" for w in dict.fromkeys(before) if w in self.cues]
            if before and before[-1] in self.cues:
                cues.append(f"w1:{kind}:{before[-1]}")
            if after and after[0].lower() in self.cues:
                cues.append(f"n:{kind}:{after[0].lower()}")
            out.append((a, b, kind, key, (*bare, *cues), tuple(bare)))
        return out

    def name_words(self, text: str, taken: list[tuple[int, int]], lone: bool = True) -> list[list]:
        """[start, end, word, context features, joint with the node before, kinds of the words
        beside it in its phrase, what is known of it] of name nodes. The last are features of new words only: a word
        the lexicon knows has its neighbours' labels instead.

        In a text without capitals only words of the lexicon and those beside a title or a
        given name are nodes, in any other also every capitalised word. Without ``lone`` common
        words are left out that no title and no open word stands near: nothing joins them to one,
        and alone they are no name."""
        parts = _SPLIT.split(text)  # gap, word, gap, word, ..., gap
        words, gaps = parts[1::2], parts[0::2]
        look = list(map(self.words.get, words))
        if None in look:
            look = [x or self.word(w) for x, w in zip(look, words)]
        starts = [0, *accumulate(map(len, parts))][1::2]
        small = text.islower()
        out: list[list] = []
        k, n, last = 0, len(words), -9
        sides, joints, nt = self.sides, self.joints, len(taken)
        for i, x in enumerate(look):
            if not (x.lexical if small else x.node):
                if not small or len(words[i]) < 2 or words[i] in PARTICLES or words[i] in TITLES:
                    continue
                p = words[i - 1] if i else ""
                if not (p in TITLES or last == i - 1 and look[i - 1].given > 0 or p in ("de", "o") and last == i - 2):
                    continue
            if not lone and x.kind == "common" and not any(y.node and y.kind == "open" for y in look[max(0, i - 3) : i + 4]) and not (i and look[i - 1].small in TITLES):
                continue
            a = starts[i]
            b = a + len(words[i])
            if nt:
                while k < nt and taken[k][1] <= a:
                    k += 1
                if k < nt and taken[k][0] < b:
                    continue
            before, after = gaps[i], gaps[i + 1]
            side, pname = "edge", "p:*"
            if i:
                p, pname = look[i - 1], look[i - 1].before
                far = look[i - 2] if i > 1 else None
                if p.small in TITLES and before.strip() in ("", ".") or far and p.small in _INNER and far.small in TITLES:
                    side, pname = "title", "p:*"
                elif before[:1] == "." and len(p.small) == 1 and self._initial(text, words, starts, i - 1, taken, k) or far and p.small in ("de", "o", "d") and gaps[i - 1][:1] == "." and self._initial(text, words, starts, i - 2, taken, k):
                    side = "initial"
                else:
                    side = sides.get(before) or self._memo(sides, _side, before)
            feats = [pname, look[i + 1].after if i + 1 < n else "q:*", "a:" + side, "z:" + ((sides.get(after) or self._memo(sides, _side, after)) if i + 1 < n else "edge")]
            if small:
                feats.append("small text")
            if i + 1 < n and len(words[i + 1]) == 1 and gaps[i + 2][:1] == "." and after.strip() == ",":
                feats.append("initial ahead")
            joint, beside = "", []
            if out and i - last < 8:
                gap = before if i - last == 1 else text[out[-1][1] : a]
                joint = joints.get(gap)
                if joint is None:
                    joint = self._memo(joints, _joint, gap) if len(gap) < 20 else ""
            if joint:
                one, two = look[last].kind, x.kind
                beside.append("l:" + one)
                out[-1][5].append("r:" + two)
                if one != two:
                    joint += "|"
            out.append([a, b, words[i], feats, joint, beside, x])
            last = i
        return out

    def _initial(self, text: str, words: list, starts: list, i: int, taken: list, k: int) -> bool:
        """Whether word i is a letter of its own, not the end of a number or of another entity."""
        return len(words[i]) == 1 and not text[starts[i] - 1 : starts[i]].isdigit() and not (k and taken[k - 1][1] > starts[i])

    def links(self, spans: list, words: list) -> list[tuple[int, int, str]]:
        """(node, node, kind): each is tied to the last one like it, so links stay linear."""
        out, seen = [], {}
        for i, s in enumerate(spans):
            j = seen.get((s[2], s[3]))
            if j is not None:
                out.append((j, i, "same number"))
            seen[s[2], s[3]] = i
        first = len(spans)
        same: dict[str, int] = {}
        like: dict[str, int] = {}
        for i, w in enumerate(words, first):
            if w[4]:
                out.append((i - 1, i, w[4]))
            key, near = w[6].key, w[6].like
            j = same.get(key)
            if j is not None:
                out.append((j, i, "same word"))
            elif near:
                j = next((like[x] for x in near if x in like), None)
                if j is not None:
                    out.append((j, i, "like word"))
            same[key] = i
            for x in near:
                like[x] = i
        return out


# ---------------------------------------------------------------- message passing


def settle(bias: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Log-odds of each node after loopy message passing with couplings ``j`` on (a, b)."""
    if not len(a):
        return bias.copy()
    src, dst, tj = np.r_[a, b], np.r_[b, a], np.tanh(np.r_[j, j])
    back = np.r_[np.arange(len(a), 2 * len(a)), np.arange(len(a))]
    m = np.zeros(len(src))
    n = len(bias)
    for _ in range(rounds):
        total = bias + np.bincount(dst, m, n)
        new = 2 * np.arctanh(np.clip(tj * np.tanh((total[src] - m[back]) / 2), -0.999999, 0.999999))
        m = 0.5 * m + 0.5 * new
    return bias + np.bincount(dst, m, n)


# ---------------------------------------------------------------- fitting

JOINTS = ("blank", "line", "hyphen", "comma", "initial", "particle")
#: Kinds of links; "|" marks a joint between an open and a common word.
LINKS = (*JOINTS, *(f"{j}|" for j in JOINTS), "same word", "like word", "same number")


def _logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, decay: float, rounds: int) -> np.ndarray:
    """Weights of a logistic model by full-batch Adagrad, drawn towards ``prior``."""
    w, squares = prior.copy(), np.full(len(prior), 1e-8)
    n = len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * vals, n), -30, 30)))
        g = np.bincount(cols, (weight * (p - y))[rows] * vals, len(w)) + decay * (w - prior)
        squares += g * g
        w -= 0.3 * g / np.sqrt(squares)
    return w


def count(texts: list[str], every: Nodes | None = None) -> Counter:
    """{(kind, word, word, joint): n}: what a lexicon is made from. Counts of the parts of a corpus add up to its own."""
    every = every or Nodes(NameModel())  # knows nothing: its nodes are the capitalised words
    out, words = Counter({("texts", "", "", ""): len(texts)}), Counter()
    announced = tuple(x.lower() for x in ANNOUNCED)
    for t in texts:
        words.update(_WORD.findall(_MAIL.sub(" ", t) if _AT.search(t) else t))
        nodes = every.name_words(t, [])
        for i, (a, _, w, feats, joint, *_) in enumerate(nodes):
            titled = "a:title" in feats
            ahead = nodes[i + 1][4].strip("|") if i + 1 < len(nodes) else ""
            if joint:
                out["pair", nodes[i - 1][6].key, nodes[i][6].key, joint.strip("|")] += 1  # side by side
            if titled and ahead in ("", "comma"):
                out["family", plain(w), "", ""] += 1
            elif ahead in ("blank", "initial", "particle") and (titled or t[max(0, a - 14) : a].rstrip().lower().endswith(announced)):
                out["given", plain(w), "", ""] += 1
                out["family", plain(nodes[i + 1][2]), "", ""] += 1
        for s in every.spans(t):
            shape = json.dumps(s[5])
            out["shape", shape, "", ""] += 1
            out["told", shape, "", ""] += _announced(s) == 1
    for w, c in words.items():
        if len(w) > 1:
            out["low" if w[0].islower() else "cap", plain(w), "", ""] += c
    return out


def lexicon(counts: dict[tuple, int]) -> tuple[NameModel, dict[tuple, float]]:
    """Given names, family-name endings and word counts; how far each shape of a number is
    trusted where nothing announces it. The same counts give the same, in any order."""
    given, family, cap, low, pairs, shapes, told = (Counter() for _ in range(7))
    kinds = {"given": given, "family": family, "cap": cap, "low": low, "shape": shapes, "told": told}
    n = 0
    for (kind, x, y, joint), c in sorted(counts.items()):
        if kind == "pair":
            pairs[x, y, joint] = c
        elif kind == "texts":
            n = c
        else:
            kinds[kind][x] = c
    scale = min(1.0, PER / max(n, 1))
    # a shape whose numbers are often announced is trusted where nothing announces it; in binary
    # fractions, so that sums of them are exact
    trust = {tuple(json.loads(k)): round(1024 * min(1.0, told[k] / v / ANNOUNCED_SHARE)) / 1024 for k, v in shapes.items()}
    named = lambda w: low[w] <= 0.4 * cap[w] + 1
    model = NameModel()
    # rare words behind another capitalised word may be family names not known yet
    maybe = {f for _, f, joint in pairs if joint not in ("comma", "line") and cap[f] * scale < SEEN}
    turns = 4
    for turn in range(turns):  # given names lead to family names, these to further given names
        for w, c in given.items():
            share = c / max(cap[w], c)
            if (c >= 2 and share > 0.1 or share > 0.5) and named(w):
                model.given[w] = min(1.0, 0.25 + share)
        known, more = set(model.given), Counter()
        for (g, f, joint), c in pairs.items():
            if joint == "comma":
                if f in known and named(g):
                    more[g] += c
            elif joint != "line" and g in known and named(f):
                more[f] += c
        first = set(more)
        for (g, f, joint), c in pairs.items():
            if joint == "hyphen" and g not in known and g in first and named(f):
                more[f] += c
        whole = family | more
        pos = [w for w in sorted(whole) if w not in known and len(w) > 3]
        neg = [w for w in cap if w not in whole and w not in known and w not in maybe and len(w) > 3] + [w for w in low if low[w] >= 3 and cap[w] < low[w] and len(w) > 3]
        if not pos or not neg:
            model.affix[_traits("")[-1]] = -3.0
            break
        x = np.array([_traits(w) for w in pos + neg])
        y = np.r_[np.ones(len(pos)), np.zeros(len(neg))]
        weight = np.where(y > 0, 0.5 / len(pos), 0.5 / len(neg))
        cols = x.ravel()
        model.affix = _logistic(np.repeat(np.arange(len(y)), x.shape[1]), cols, np.ones(len(cols)), y, weight, np.zeros(_BUCKETS), 2e-5, 150)
        if turn == turns - 1:
            break
        # what mostly stands before a family name is a given name, known or not yet
        score = {w: model.family(w) for w in {k[1] for k in pairs} if len(w) > 3}
        good, total, kinds = Counter(), Counter(), Counter()
        for (g, f, joint), c in pairs.items():
            if joint not in ("comma", "hyphen"):
                total[g] += c
                if score.get(f, -1.0) > 0 and f not in known:
                    good[g] += c
                    kinds[g] += 1
        given = Counter({g: max(given[g], good[g]) for g in {*given, *good} if good[g] >= 0.6 * total[g] and (given[g] or kinds[g] >= 3)})
        model.given = {g: v for g, v in model.given.items() if g in given}
    model.counts = {w: (round(cap[w] * scale, 2), round(low[w] * scale, 2)) for w in sorted({*cap, *low}) if (cap[w] + low[w]) * scale >= 3}
    return model, trust


def _announced(span: tuple) -> int:
    """1: the words before a candidate (or its own sign) say what it is, 0: they say something else, -1: open."""
    words = {f.split(":")[-1] for f in span[4] if f[0] == "w"}
    if span[2] == "email" and "f:sign" in span[5] or "tail" in span[5] or words & CUES[span[2]]:
        return 1
    return 0 if words & OTHERS else -1


def _labels(text: str, nodes: Nodes, words: list) -> list[int]:
    """1: surely part of a name, 0: surely not, -1: open; by joints, titles and the lexicon."""
    out = [-1] * len(words)
    look = [w[6] for w in words]
    for i, (w, x) in enumerate(zip(words, look)):
        small = x.low > 0.4 * (x.cap + x.low)
        joint = w[4].strip("|")
        if "a:title" in w[3] and not small:
            out[i] = 1
        elif joint and joint not in ("comma", "line") and look[i - 1].given > 0 and not small and (x.family > 0 or x.cap < 30 or joint == "hyphen" and x.given > 0):
            out[i - 1] = out[i] = 1
        elif joint == "comma" and x.given > 0 and look[i - 1].family > 1:
            out[i - 1] = out[i] = 1
        elif joint == "hyphen" and out[i - 1] == 1:
            out[i] = 1
        elif ("a:initial" in w[3] or "initial ahead" in w[3]) and x.family > 1:
            out[i] = 1
    for i in range(len(words)):
        beside = i and words[i][4] and out[i - 1] == 1 or i + 1 < len(words) and words[i + 1][4] and out[i + 1] == 1
        x = look[i]
        if out[i] < 0 and x.given < 0.5 and (x.cap + x.low >= 3 and (x.family < 0 or x.cap >= 30) or x.family < 0 and not beside):
            out[i] = 0
    return out


def contexts(texts: list[str], nodes: Nodes, trust: dict[tuple, float], merged: dict[tuple, list[float]] | None = None) -> dict[tuple, list[float]]:
    """{(features, labels around a node): [weight, weight of those that are entities]} of the
    labelled nodes, added to ``merged``; nodes that look alike are one. Those of the parts of
    a corpus add up to its own."""
    merged = {} if merged is None else merged

    def add(feats: tuple, label: float, wt: float, near: tuple) -> None:
        row = merged.get((feats, near))
        if row is None:
            row = merged[feats, near] = [0.0, 0.0]
        row[0] += wt
        row[1] += wt * label

    for t in texts:
        spans = nodes.spans(t)
        marks = [_announced(s) for s in spans]
        soft = [trust[s[5]] if k < 0 else float(k) for s, k in zip(spans, marks)]
        for i, x in enumerate(spans):  # of two that overlap one is right
            for j in range(i):
                o = spans[j]
                if x[0] < o[1] and o[0] < x[1]:
                    lose = i if (soft[i], x[1] - x[0]) < (soft[j], o[1] - o[0]) else j
                    marks[lose], soft[lose] = 0, 0.0
        words = nodes.name_words(t, sorted((s[0], s[1]) for s, v in zip(spans, soft) if v > 0.5))
        labels = _labels(t, nodes, words)
        marks += labels
        near: list[dict[str, int]] = [{} for _ in marks]
        for a, b, kind in nodes.links(spans, words):
            for i, o in ((a, b), (b, a)):
                if marks[o] >= 0:
                    near[i][kind] = near[i].get(kind, 0) + 2 * marks[o] - 1
        sides = [tuple(sorted(nb.items())) if nb else () for nb in near]
        for s, v, nb in zip(spans, soft, sides):
            add(s[4], v, 0.5, nb)
            add(s[5], v, 0.5, nb)
        for w, label, nb in zip(words, labels, sides[len(spans) :]):
            if label >= 0:
                x = w[6]
                add((*x.own, *w[3], *(w[5] if x.new else ())), label, 0.5, nb)
                if x.kind == "open":  # the same word in a text that the lexicon knows nothing of
                    bare = (*x.bare, *w[3], *w[5])
                    add(bare, label, 0.25, nb)
                    add(bare, label, 0.25, ())  # nor of the words around it
    return merged


def weigh(model: NameModel, rows: Iterable[tuple[str, float, float]], rounds: int = 150) -> NameModel:
    """Adds potentials and couplings to a lexicon, from ``contexts`` (key in JSON, weight,
    weight of entities) in order of their keys."""
    index: dict[str, int] = {f"link:{k}": i for i, k in enumerate(LINKS)}
    sizes, cols, vals, weight, y = array("i"), array("i"), array("f"), array("d"), array("d")
    for key, wt, hits in rows:
        feats, near = json.loads(key)
        for f in feats:
            cols.append(index.setdefault(f, len(index)))
            vals.append(1.0)
        for k, v in near:
            cols.append(index[f"link:{k}"])
            vals.append(2.0 * v)
        sizes.append(len(feats) + len(near))
        weight.append(wt)
        y.append(hits / wt)
    if not sizes:
        model.weights, model.couplings = dict(PRIOR), {k: LINK_PRIOR.get(k, 0.3) for k in LINKS}
        return model
    for f in PRIOR:
        index.setdefault(f, len(index))
    prior = np.array([LINK_PRIOR.get(f[5:], 0.3) if f.startswith("link:") else PRIOR.get(f, 0.0) for f in index])
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), np.array(sizes))
    w = _logistic(at, np.array(cols), np.array(vals), np.array(y), np.array(weight), prior, 0.02, rounds)
    model.couplings = {k: float(np.clip(w[i], -0.5, 1.2)) for i, k in enumerate(LINKS)}
    model.weights = {k: round(float(w[i]), 4) for k, i in index.items() if abs(w[i]) > 0.01 and not k.startswith("link:")}
    return model


def fit(texts: list[str], rounds: int = 150) -> NameModel:
    """Learns lexicon, potentials and couplings; the same texts give the same model, in any order."""
    model, trust = lexicon(count(texts))
    found = contexts(texts, Nodes(model), trust)
    return weigh(model, sorted((json.dumps(k), *v) for k, v in found.items()), rounds)


# ---------------------------------------------------------------- tagging


class Tagger:
    """Finds entities in a batch of texts with one message-passing run."""

    def __init__(self, model: NameModel, couplings: dict[str, float] | None = None):
        self.model, self.nodes = model, Nodes(model)
        self.couplings = model.couplings if couplings is None else couplings
        self.own: dict[str, float] = {}

    def _own(self, x: Word) -> float:
        v = self.own.get(x.small + x.own[1])
        if v is None:
            if len(self.own) > self.nodes.MEMO:
                self.own.clear()
            v = self.own[x.small + x.own[1]] = sum(self.model.weights.get(f, 0.0) for f in x.own)
        return v

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the entities of each text, in order."""
        weights, bias, ea, eb, ej, docs = self.model.weights, [], [], [], [], []
        get = weights.get
        for text in texts:
            spans, words, scored = [], [], []
            if text:
                scored = [(sum(get(f, 0.0) for f in s[4]), s) for s in self.nodes.spans(text)]
                scored.sort(key=lambda x: (x[0] < 0, _EASY[x[1][2]] if x[0] >= 0 else 0, x[1][0] - x[1][1], x[1][0]))
                kept: list[tuple[float, tuple]] = []
                for v, s in scored:  # of overlapping candidates the likely, then the longer one stands
                    if all(s[1] <= k[0] or s[0] >= k[1] for _, k in kept):
                        kept.append((v, s))
                kept.sort(key=lambda x: x[1][:2])
                scored = kept
                spans = [s for _, s in kept]
                words = self.nodes.name_words(text, [(s[0], s[1]) for v, s in kept if v > 0], lone=False)
            base = len(bias)
            bias += [v for v, _ in scored]
            for w in words:
                v = self._own(w[6])
                for f in w[3]:
                    v += get(f, 0.0)
                if w[6].new:
                    for f in w[5]:
                        v += get(f, 0.0)
                bias.append(v)
            docs.append((spans, words, base))
            for a, b, kind in self.nodes.links(spans, words):
                ea.append(base + a)
                eb.append(base + b)
                ej.append(self.couplings.get(kind, 0.0))
        odds = settle(np.array(bias, float), np.array(ea, int), np.array(eb, int), np.array(ej, float)).tolist()
        out = []
        for text, (spans, words, base) in zip(texts, docs):
            found = [(s[0], s[1], s[2]) for s, o in zip(spans, odds[base : base + len(spans)]) if o > 0]
            at = base + len(spans)
            names = [(w[0], w[1], w[6].given > 0, "a:title" in w[3], w[6].new) for w, o in zip(words, odds[at : at + len(words)]) if o > 0]
            found += [(a, b, "name") for a, b in whole_names(text, names)] if names else []
            out.append(sorted(found))
        return out


_LEAD = re.compile(r"(?:(?<![^\W_])(?:[dD][eEéÉ]|van|von)\s+)?(?:(?<![^\W_])[oO]['’])?$")
_INITIALS_BEFORE = re.compile(r"(?<![^\W_])(?<!['’.-])(?:[^\W\d_]\.\s*)+\s$")
_INITIALS_AFTER = re.compile(r"(?:\s+[^\W\d_]\.)+(?!\w)")
_TURNED_INITIALS = re.compile(r"(?:[^\W\d_]\.)(?:\s+[^\W\d_]\.)*(?!\w)(?!\s+(?:[oO]['’])?[^\W\d_]+(?:-|\s*,|\s+and))")


def whole_names(text: str, words: list[tuple[int, int, bool, bool, bool]]) -> list[tuple[int, int]]:
    """Accepted words (start, end, known as given name, after a title, new) cut to whole names.

    A written name is a run of at least two words, or one with initials or after a title;
    "family, given" and "family, initials" are runs turned round. A word that stands alone
    is no name by the statement of the problem.
    """
    out: list[tuple[int, int]] = []
    i, n = 0, len(words)

    def joint(k: int) -> str:
        return _joint(text[words[k][1] : words[k + 1][0]]) if k + 1 < n and words[k + 1][0] - words[k][1] < 20 else ""

    def hyphens(k: int) -> int:
        while joint(k) == "hyphen":
            k += 1
        return k

    while i < n:
        a, _, given, title, new = words[i]
        start = a - len(_LEAD.search(text[max(0, a - 8) : a])[0])
        end = hyphens(i)
        initials = _INITIALS_BEFORE.search(text[max(0, start - 40) : start])
        if initials and re.search(rf"(?i)(?<![^\W_])(?:{'|'.join(TITLES)})\.?\s*$", text[max(0, start - 40) : start]):
            initials = None
        nxt = joint(end)
        if (nxt in ("blank", "initial", "particle") and (given or new or not title or words[end + 1][2])) or nxt == "line" and given and not words[end + 1][2]:
            stop = hyphens(end + 1)
            if not given:  # a word that isn't in the lexicon: the run may have further parts
                while joint(stop) in ("blank", "particle", "initial") and not words[stop + 1][2] and stop - i < 4 and not words[end + 1][2]:
                    stop = hyphens(stop + 1)
            out.append((start if not given else a, words[stop][1]))
            i = stop + 1
            continue
        if initials:
            out.append((start - len(initials[0]), words[end][1]))
            i = end + 1
            continue
        comma = re.match(r",\s+", text[words[end][1] : words[end][1] + 6])
        if comma and end + 1 < n and nxt == "comma" and words[end + 1][2]:
            g = hyphens(end + 1)
            if joint(g) not in ("blank", "initial", "particle") or words[g + 1][2]:
                tail = _INITIALS_AFTER.match(text[words[g][1] : words[g][1] + 12])
                out.append((start, words[g][1] + (tail.end() if tail else 0)))
                i = g + 1
                continue
        if comma and not given:
            at = words[end][1] + comma.end()
            one = _TURNED_INITIALS.match(text[at : at + 30])
            if one:
                out.append((start, at + one.end()))
                i = end + 1
                continue
        if title and not given:
            out.append((start, words[end][1]))
        i = end + 1
    return out
