import hashlib
import random
from collections import Counter

import pytest

from concord.llm import fingerprints as fp


def jaccard(a, b):
    x, y = Counter((a or "").split()), Counter((b or "").split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@pytest.mark.parametrize("rows", [7, 1000])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 40, 300]))) for _ in range(40)]
    docs = [(3 * i + 1, rng.choice(base), "x") for i in range(100)] + [(5000, None, "x"), (5001, "", "x"), (5002, "日本 é🙂 words here ok", "x"), (9000, "last one of all", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fp.compare_with_edited(df, samples=fp.SAMPLES).collect()}
    assert len(got) == len(docs)
    error, seen = [], {}
    for i, (d, t, _) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        gone = len(t) // 4
        edited = t[: len(t) - gone] + nxt[:gone]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        if t.split() and edited.split():
            error.append(r.near_edited - jaccard(t, edited))
        if t.split() and nxt.split():
            error.append(r.near_next - jaccard(t, nxt))
    assert abs(sum(error) / len(error)) < 0.03 and (sum(e * e for e in error) / len(error)) ** 0.5 < 0.12
    assert got[5000].near_next == 1.0 and got[5000].fingerprint == "" and got[5001].near_next == 0.0
    alone = dict(fp.fingerprint(df, samples=fp.SAMPLES).collect())
    assert all(alone[d] == got[d].fingerprint for d in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert fp.compare_with_edited(df.limit(0)).count() == 0
    only = fp.compare_with_edited(df).first()
    assert only.near_next == 1.0 and only.near_edited == 1.0 or only.near_edited < 1
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (2, "x")], "doc_id long, text string")
    rows = fp.compare_with_edited(df).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in rows) == sorted([(-1, 3, digest("c d")), (1, 3, digest("a b")), (1, 3, digest("a b")), (2, 1, digest("x"))])
    # eight rows of one key: seven precede themselves, the eighth precedes the last document
    text = "abcd efgh ijkl"
    df = spark.createDataFrame([(1, text)] * 8 + [(2, "wxyz")], "doc_id long, text string").repartition(3)
    rows = fp.compare_with_edited(df).where("doc_id = 1").collect()
    assert sorted(r.edited_sha256 for r in rows) == sorted([digest("abcd efgh iabc")] * 7 + [digest("abcd efgh iwxy")])
    assert sorted(r.near_next for r in rows) == [0.0] + [1.0] * 7
