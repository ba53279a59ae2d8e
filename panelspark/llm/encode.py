"""Encoding with a public byte-level BPE vocabulary, merges reproduced exactly.

Method: bytes stand as Latin-1 characters in an Aho-Corasick automaton of all tokens. A
piece of text is encoded from its longest matches: a token is kept if it is compatible with
the one before, which a memoised test over the merge tree decides; otherwise the next
shorter prefix is tried, and if none is left the last token is taken back. A position that
failed once is never tried again, so the work is linear in the piece. Only pieces that no
worker has met before reach that point; the others come from a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import ship_package, spread
from panelspark.sources.tables import table

#: Entries after which a worker's memo tables are emptied; a bound on memory, not on results.
MEMO = 400_000
_ENCODERS: dict[str, "BpeEncoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BpeEncoder:
    """Encoder of one rank file (base64 token and rank a line)."""

    def __init__(self, ranks: bytes, pattern: str):
        import ahocorasick
        import regex

        tokens = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.rank, self.pattern = tokens, regex.compile(pattern)
        self.text = {r: t for t, r in tokens.items()}
        self.auto = ahocorasick.Automaton()
        for t, r in tokens.items():
            self.auto.add_word(t, (len(t), r))
        self.auto.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.words: dict[str, list[int]] = {}
        # each token's last merge: of the two-part splits whose parts were there before it,
        # the one whose parts stay apart when only earlier merges are known
        for t, r in sorted(tokens.items(), key=lambda x: x[1]):
            if len(t) == 1:
                continue
            for cut in range(len(t) - 1, 0, -1):
                a, b = tokens.get(t[:cut]), tokens.get(t[cut:])
                if a is not None and b is not None and a < r and b < r and self._compatible(a, b):
                    self.parts[r] = (a, b)
                    self.joined[(a, b)] = r
                    break
        self.fits.clear()

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side.

        Both are opened along their touching edges, the later merge first. If an opened
        pair has a merge of its own that would have come before either side was closed,
        the boundary would have vanished.
        """
        bound = 1 << 60
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < bound:
                return False
            # a merge on the right side is preferred only when it is strictly earlier
            if left > right:
                if left not in self.parts:
                    return True
                bound, left = left, self.parts[left][1]
            else:
                if right not in self.parts:
                    if left not in self.parts:
                        return True
                    bound, left = min(bound, left), self.parts[left][1]
                else:
                    bound, right = right + 1, self.parts[right][0]

    def _fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            known = self.fits[(left, right)] = self._compatible(left, right)
        return known

    def _prefix(self, token: int) -> int | None:
        if token not in self.shorter:
            t = self.text[token]
            self.shorter[token] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None)
        return self.shorter[token]

    def piece(self, word: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(word)
        if whole is not None and (len(word) == 1 or whole in self.parts):
            return [whole]
        longest: list[tuple[int, int]] = [(0, -1)] * len(word)
        for end, (n, r) in self.auto.iter(word):
            if n > longest[end - n + 1][0]:
                longest[end - n + 1] = (n, r)
        size = len(word)
        open_ends = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0][1]
        while True:
            end = at + len(self.text[token])
            if open_ends[end] and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest[at][1]
                continue
            shorter = self._prefix(token)
            if shorter is not None:
                token = shorter
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= len(self.text[token])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in self.pattern.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = self.piece(w.encode("utf-8").decode("latin-1"))
                if len(w) <= 64:
                    if len(words) > MEMO:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


def encoder(ranks: bytes, pattern: str) -> BpeEncoder:
    """The process's encoder of a vocabulary, built once."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = BpeEncoder(ranks, pattern)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, *, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids) or, with counts_only, (key, n_tokens) of every row.

    Null and empty texts have the empty list (0 tokens). Strings of special tokens in a
    text are ordinary text. Repeated rows stay repeated, other columns are ignored, a
    null key is kept. vocabulary: path of a rank file, read by the driver and sent to
    the workers (0.8 MB, fixed by the vocabulary).
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(vocabulary or vocabulary_path(), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    pat = pattern or split_pattern()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    kind = rows.schema["k"].dataType.simpleString()
    value = "n_tokens bigint" if counts_only else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = encoder(ranks.value, pat)
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):  # keeps the ids of one step small
                b = whole.slice(a, 2000)
                ids = [bpe.encode(x) if x else [] for x in b.column(1).to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    out = pa.array(sizes)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), out], names=["k", value.split()[0]])

    return spread(rows, "k").mapInArrow(run, f"k {kind}, {value}").withColumnRenamed("k", key)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), key="doc_id", text="text")


def queries() -> dict:
    return {"p8_ids": p8_ids}


def oracle_sql() -> dict[str, str]:
    return {}
