import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from concord.llm import kernels, language, toxicity

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_language_held_out(spark):
    got = language.op6_language_id(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    right = sum(r.lang_pred == r.lang for r in held) / len(held)
    print("language accuracy", right)
    assert right > 0.96


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat and the dog sat on the mat with another cat", "en"), (2, "der Hund und die Katze liegen auf dem Boden neben dem Ofen", "de"), (3, None, "en"), (4, "123 !", "de"), (5, "", None), (6, "the cat and the dog sat on", None), (6, "the cat and the dog sat on", None)], "doc_id long, text string, score string")
    learned = language.learn(df.withColumnRenamed("score", "lang"))
    rows = language.identify(df, learned).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert all(r.rejected == (r.lang_pred == "und") for r in rows) and len(rows) == 7
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    assert language.identify(df.limit(0), learned).count() == 0 and language.learn(df.limit(0).withColumnRenamed("score", "lang")) == {}


@needs_data
def test_toxicity_held_out(spark):
    got = toxicity.op9_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    every = got.join(labels, "doc_id").join(docs, "doc_id").where("held_out").collect()
    for lang in sorted({r.lang or "" for r in every}):
        own = [r for r in every if (r.lang or "") == lang]
        print("toxicity", lang, "tp fp fn n", sum(r.predicted and r.toxic for r in own), sum(r.predicted and not r.toxic for r in own), sum(not r.predicted and r.toxic for r in own), len(own))
    # the tables' labels are noise but for the English documents
    rows = [r for r in every if r.lang == "en"]
    tp = sum(r.predicted and r.toxic for r in rows)
    fp = sum(r.predicted and not r.toxic for r in rows)
    fn = sum(not r.predicted and r.toxic for r in rows)
    print("toxicity tp fp fn n", tp, fp, fn, len(rows))
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"fine words here {i} nice" + (" vile scum" if i % 3 == 0 else ""), "x") for i in range(300)] + [(1000, None, "y"), (1001, "", "y"), (None, "some", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert rows[0] > 0.5 > rows[4] and all(0 <= s <= 1 for s in rows.values()) and len(rows) == 303
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def kneser_ney(examples: list[tuple[str, int]]):
    """The models in plain Python: log-likelihood ratio of a word."""
    counts = {(c, k): Counter() for c in (0, 1) for k in range(1, toxicity.ORDER + 1)}
    for text, c in examples:
        for word in text.lower().split():
            s = f" {word} ".encode()
            for i in range(1, len(s)):
                for k in range(1, min(toxicity.ORDER, i + 1) + 1):
                    counts[c, k][s[i - k + 1 : i + 1]] += 1

    def kinds(c, k):
        """Bytes seen before a gram, its own occurrence at a word's beginning as one more."""
        if k == toxicity.ORDER:
            return counts[c, k]
        out = Counter()
        for d in (0, 1) if k <= toxicity.SHARED else (c,):
            out.update(counts[d, k].keys())
            out.update(g[1:] for g in counts[d, k + 1])
        return out

    tables = {(c, k): kinds(c, k) for c in (0, 1) for k in range(1, toxicity.ORDER + 1)}
    totals, followers = {}, {}
    for at, table in tables.items():
        totals[at], followers[at] = Counter(), Counter()
        for g, n in table.items():
            totals[at][g[:-1]] += n
            followers[at][g[:-1]] += 1

    def ratio(word: str) -> float:
        s, out = f" {word.lower()} ".encode(), 0.0
        for i in range(1, len(s)):
            for c, sign in ((1, 1), (0, -1)):
                p = 1 / 256
                for k in range(1, min(toxicity.ORDER, i + 1) + 1):
                    g = s[i - k + 1 : i + 1]
                    total = totals[c, k][g[:-1]]
                    if total:
                        p = max(tables[c, k][g] - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * followers[c, k][g[:-1]] / total * p
                out += sign * math.log(p)
        return out

    return ratio


def test_kneser_ney_against_plain_python(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    examples = [(" ".join(word() for _ in range(rng.randint(0, 30))), rng.randrange(2)) for _ in range(60)] + [("ok", 1), ("", 0)]
    models = toxicity.KneserNey(toxicity.counted(spark.createDataFrame(examples, "text string, toxic int").repartition(3)))
    ratio = kneser_ney(examples)
    texts = [word() for _ in range(200)] + ["zzzz", "a", "OK"]
    raw, offsets = kernels.utf8(pa.array(texts))
    got = models.words(raw, offsets[:-1], offsets[1:])
    assert np.allclose(got, [ratio(t) for t in texts], atol=2e-3)


def test_shortest_texts(spark):
    """Texts, and so whole slices, of one word of one or two bytes."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ok", "a", "", None, "no ok", "b"] * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    for t in ("ok", "a", ""):
        assert all(0 <= r.score <= 1 for r in toxicity.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).collect())


def test_language_against_plain_zstandard(spark):
    rng = random.Random(1)
    dictionaries = {n: " ".join(rng.choice(w) for _ in range(3000)).encode() for n, w in {"a": ["xa", "lorem", "qu"], "b": ["yb", "ipsum", "vo"]}.items()}
    texts = [" ".join(rng.choice(["xa", "yb", "lorem", "ipsum", "Qu", "VO", "é"]) for _ in range(rng.choice([1, 5, 50, 900]))) for _ in range(40)]
    odd = [None, "", " \n", "½ ² ① 12", "٣ 7", "é", "日本", "x²"]
    df = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(df, dictionaries).collect()}
    for i, text in enumerate(texts):
        data, sizes = text.lower().encode(), {}
        for name, content in dictionaries.items():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=language.LEVEL)
            box = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(box.compress(data[j : j + language.PIECE])) for j in range(0, len(data), language.PIECE))
        assert got[i].lang_pred == min(sizes, key=lambda n: (sizes[n], n))
        assert math.isclose(got[i].score, 1 / (1 + 2.0 ** (-8 * abs(sizes["a"] - sizes["b"]) / language.TEMPERATURE)))
    assert [got[len(texts) + i].lang_pred != "und" for i in range(len(odd))] == [False] * 5 + [True] * 3


def test_dictionary_takes_from_all_texts(spark):
    rows = [(f"{chr(97 + i % 26)}{i} " * (3 if i < 50 else 4000), "en") for i in range(200)] + [("same text " * 20, "en")] * 500 + [("kurz", "de")]
    learned = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert learned["de"] == b"kurz" and len(learned["en"]) <= language.DICTIONARY + 256
    parts = learned["en"].split(b"\n")
    assert len(parts) == 201 and sum(p.startswith(b"same") or b"same text" in p for p in parts) == 1
    assert language.shares([5, 100, 100], 45) == [5, 20, 20] and language.shares([], 9) == []


def test_distributions_sum_to_one(spark):
    df = spark.createDataFrame([("ab abc abd b", 0), ("abc zz", 1)], "text string, toxic int")
    models = toxicity.KneserNey(toxicity.counted(df))
    raw = np.frombuffer(b"ab", dtype=np.uint8)
    for c in (0, 1):
        total = 0.0
        for byte in range(256):
            text = np.array([97, byte], dtype=np.uint8)
            g = toxicity.Grams(text, np.array([0]), np.array([2]))
            p = np.full(4, 1 / 256)
            g.sums = g.sums if not (65 <= byte <= 90) else toxicity.Grams(text, np.array([0]), np.array([2])).sums
            for k in range(1, toxicity.ORDER + 1):
                where, slots, contexts = g.at(k)
                p[where] = models.share[c][k - 1][slots] + models.backoff[c][k - 1][contexts] * p[where]
            total += 0 if 65 <= byte <= 90 else p[2]
        assert 0.85 < total <= 1.001, total
    assert models.features(pa.array(["", None])).shape == (2, 4) and len(raw)
