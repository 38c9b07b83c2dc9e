import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from concord.llm import kernels, substrings


def brute(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "cc", "é", "日本", "The", "the"]) + str(rng.randint(0, 60))
    passages = [[word() for _ in range(rng.randint(30, 60))] for _ in range(6)]
    out = []
    for _ in range(150):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 80))]
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(w))
    out += ["", None, " \n ", "x " * 200, "y", out[0], out[0], " ".join(word() for _ in range(30000)), "w" * 70000]
    return out


@pytest.mark.parametrize("size", [35, 3])
def test_against_brute_force(spark, size):
    data = texts()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(data)], "doc_id long, text string, n_words long").repartition(3)
    got = {r.doc_id: r for r in substrings.dedup(df, size=size, digest=True, keep=["doc_id"]).collect()}
    for i, (n, gone, sha) in enumerate(brute(data, size)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, sha), i


def test_small_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MIN_BITS", 4)
    monkeypatch.setattr(substrings, "MAX_BITS", 4)
    test_against_brute_force(spark, 35)


def test_empty_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c d"), (2, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in substrings.dedup(df, size=3).collect())
    assert rows[0][2] == 3 and rows[1][1:] == (3, 3, "") and rows[2][1:] == (3, 3, "") and [r for r in rows if r[0] == 2][0][3] is None
    assert substrings.dedup(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "7 as n_words", "8 as n_removed", "'x' as _key", "'y' as _text", "1 as bucket", "2 as key")
    rows = substrings.dedup(clash, size=3).where("n_removed = 3").select("n_words", "_key", "_text", "bucket", "key").collect()
    assert sorted(map(tuple, rows)) == [(3, "x", "y", 1, 2)] * 2 + [(4, "x", "y", 1, 2)]


def test_words_across_segments(monkeypatch):
    raw = np.frombuffer(("ab " * 50 + "c" * 300 + " d" * 20).encode(), dtype=np.uint8)
    offsets = np.array([0, 10, 11, 200, len(raw)])
    whole = kernels.words(raw, offsets, spans=True)
    for size in (1, 7, 64):
        monkeypatch.setattr(kernels, "SEGMENT", size)
        for a, b in zip(whole, kernels.words(raw, offsets, spans=True)):
            assert (a == b).all()
