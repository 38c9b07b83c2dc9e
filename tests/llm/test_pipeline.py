import re
from collections import Counter

import corpus_pipeline
from concord.session import cut

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "!!! 123", "de", None, 7)], docs.schema)
    now = cut(docs.unionByName(extra))
    frames = [now]
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, DATA), name)
        frames.append(now)
    given, clean, spoken, single, trimmed, packed = frames
    for f in frames[1:5]:
        assert f.columns == given.columns
    before, texts = {r.doc_id: r.text for r in spoken.collect()}, {r.doc_id: r.text for r in single.collect()}
    assert clean.count() > 0.8 * given.count()
    assert {r.doc_id for r in clean.collect()} - set(before) == {10**6, 10**6 + 1, 10**6 + 2}
    sets = {i: shingles(t) for i, t in before.items()}
    linked = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    kept = sorted(texts)
    assert not any(linked(sets[a], sets[b]) for i, a in enumerate(kept) for b in kept[:i])
    for d in set(before) - set(texts):
        assert any(linked(sets[d], sets[e]) for e in before if e != d)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in trimmed.collect():
        w, gone = words[r.doc_id], set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        assert r.text.split() == [x for i, x in enumerate(w) if i not in gone] if gone else r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text) or not gone
    sums = {r[0]: r[1] for r in packed.groupBy("doc_id").sum("length").collect()}
    assert set(sums) == set(texts)


def test_near_copies_of_repeated_ids(spark):
    """Rows stand for themselves: a near copy goes even where its id is another group's head's."""
    w = [f"w{i}" for i in range(60)]
    v = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(v)), (1, " ".join([*w, "end"])), (0, " ".join(w)), (0, " ".join(w)), (None, " ".join([*w, "last"])), (7, None), (8, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, " ".join(v)), (-1, " ".join([*w, "last"])), (7, ""), (8, "")])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), DATA).count() == 0


def test_empty_documents_pass_through(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
