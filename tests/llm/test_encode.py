import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm.encode import encode_texts, encoder, split_pattern, vocabulary_path

P = pytest.importorskip("public_tokenizers")


def ours(name="byte_bpe_50k.tiktoken"):
    with open(vocabulary_path(name), "rb") as f:
        return encoder(f.read(), split_pattern())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200))
def test_any_text(reference, text):
    assert ours().encode(text) == reference(text)


def test_hard_texts(reference):
    rng = random.Random(2)
    parts = ["a", "aa", "the", "ing", "  ", "\n", "é", "日本", "😀", "1", "==", "zzz", "<|endoftext|>", "​", "I'm", "'LL"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in texts + ["a" * 20_000, "=" * 9999, " " * 5000, "ab" * 5000, "", "é" * 5000]:
        assert ours().encode(t) == reference(t)


def test_other_vocabulary():
    import base64

    import tiktoken

    name = "byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in ["Straße in München, größer als 10 km", "株価は上昇した。", "le marché français est calme\n\nok", "a" * 3000]:
        assert ours(name).encode(x) == t.encode_ordinary(x)


def test_operator(spark, reference):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "k", "x"), (4, "word " * 30_000, "x"), (1, "Hello world", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_texts(df, key="doc_id", text="text").collect()]
    assert sorted(got, key=str) == sorted([(k, reference(t) if t else []) for k, t, _ in rows], key=str)
    n = encode_texts(df, key="doc_id", text="text", counts_only=True).agg({"n_tokens": "sum"}).first()[0]
    assert n == sum(len(i) for _, i in got)
    assert encode_texts(df.limit(0), key="doc_id", text="text").count() == 0
