import base64
import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import byte_bpe, tokens

EDGE = ["", " ", "  ", "a  b", "\n x", "x \n y  z", "don't we'll 'S", "1234 5.6", "é日本語 text 🙂🙂", "a" * 5000, " lead", "trail ", "a  b", "<|endoftext|>", "Ǆ ʰa ͅx", "x\u0000 y", "ab  \n\n  cd", "½ ²3 ٣"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(bpe, texts):
    ids, begin = bpe.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_matches_reference_encoder(reference, name):
    bpe = byte_bpe.load(P.path(name), P.PATTERN)
    assert ids_of(bpe, [*EDGE, None]) == [*(reference.encode_ordinary(x) for x in EDGE), []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_random_texts_round_trip(texts):
    bpe = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids, begin = bpe.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, begin[:-1], begin[1:]):
        assert bpe.decode(ids[a:b]) == t.encode()
        assert bpe.offsets(ids[a:b])[-1] == len(t.encode())


def test_query_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*EDGE, None])], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in tokens.round_trip(df).collect()}
    for i, t in enumerate([*EDGE, None]):
        ids = reference.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = tokens.decode(tokens.encode(df)).withColumn("same", F.col("decoded").cast("string") == F.coalesce("text", F.lit("")))
    assert back.where("not same").count() == 0
    assert tokens.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("cache", [0, 8, 1000])
def test_cache_of_any_size(cache):
    """Results do not hang on what the cache holds, nor on which of its halves."""
    path = P.path("byte_bpe_50k.json")
    small, whole = byte_bpe.load.__wrapped__(path, P.PATTERN), byte_bpe.load(path, P.PATTERN)
    small.limit = cache
    texts = ["the cat's  the.\nThe cat, it's", "", "the café’s 12 the.\n\n x", "cat cat cat's\tthe." * 5, "the cat's  the.\nThe cat, it's"]
    for _ in range(3):
        got, want = small.encode(pa.array(texts)), whole.encode(pa.array(texts))
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
