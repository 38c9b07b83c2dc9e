import random

import corpus_pipeline
from concord.llm import language
from concord.llm.folds import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = {
    "en": "the and of that with from this they have was were which their would there about people time house water".split(),
    "de": "der und die nicht mit von diese haben war wurde werden auch nach einer zeit haus wasser leute durch noch".split(),
}


def corpus():
    """More texts than dictionaries hold, in several lengths, some mixed, some of them twice."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        lang, other = ("en", "de") if i % 3 else ("de", "en")
        n, mixed = 220 if i % 25 == 0 else 5 + 65 * (i % 2), rng.choice([0, 0, 0.3])
        rows.append((i, " ".join(rng.choice(WORDS[other if rng.random() < mixed else lang]) for _ in range(n)), lang, "s", n))
    rows += [(2000 + i, *rows[7 * i][1:]) for i in range(120)]
    return rows + [(3000, None, "en", "s", 0), (3001, "12 !", "de", "s", 0), (3002, "the end", None, "s", 0), (3003, "", "en", "s", 0)]


def plain(rows):
    """The margins, from every labelled row, each judged by dictionaries without its text: all in plain Python but for ``learn``."""

    def brute(dictionaries):
        parts, whole, found = {n: d.split(b"\n") for n, d in dictionaries.items()}, language.Classifier(dictionaries), []
        for text, lang in rows:
            if text is None or lang is None:
                continue
            data, model = text.lower().encode(), whole
            if any(held(p, data) for ps in parts.values() for p in ps):
                model = language.Classifier({n: b"\n".join(p for p in ps if not held(p, data)) for n, ps in parts.items()})
            got, score, margin, size = model.classify(text)
            if score > 0 and got == lang:
                found.append((size, margin))
        return found

    def held(part, data):
        return part == data or len(part) > 300 and data.startswith(part)

    def margins(dictionaries):
        found, out, margin = brute(dictionaries), [], 0.0
        for low, high in zip(language.LENGTHS, (*language.LENGTHS[1:], float("inf")), strict=True):
            own = sorted(m for n, m in found if low <= n < high)
            if len(own) >= language.LEAST:
                margin = language.RELAXED * own[int(language.QUANTILE * len(own))]
            out.append((low, margin))
        return out

    return margins


def test_margins_come_from_all_labelled_rows(spark):
    rows = corpus()
    labelled = spark.createDataFrame(rows, SCHEMA).repartition(5).where(fold() != 0)
    dictionaries = language.learn(labelled)
    expected = plain([(r.text, r.lang) for r in labelled.collect()])(dictionaries)
    assert all(len(d.split(b"\n")) == language.SAMPLE_TEXTS for d in dictionaries.values()) and len({m for _, m in expected if m > 0}) > 1
    assert language.calibrate(labelled) == expected


def test_query_rejects_by_margins_of_all_rows(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled = docs.where(fold() != 0)
    dictionaries = language.learn(labelled)
    limits = plain([(r.text, r.lang) for r in labelled.collect()])(dictionaries)
    model, expected = language.Classifier(dictionaries), []
    for r in docs.collect():
        lang, score, margin, size = model.classify(r.text)
        expected.append((r.doc_id, lang, score, lang == "und" or margin < max((at, m) for at, m in limits if at <= size)[1]))
    got = language.op6_language_id(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    assert sorted((r.doc_id, r.lang_pred, r.score, r.rejected) for r in got.collect()) == sorted(expected)


def test_stage_drops_by_margins_of_all_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    labelled = docs.where(fold() != 0)
    dictionaries = language.learn(labelled)
    limits = plain([(r.text, r.lang) for r in labelled.collect()])(dictionaries)
    model, expected = language.Classifier(dictionaries), []
    for r in docs.collect():
        lang, _, margin, size = model.classify(r.text)
        if lang != "und" and margin >= max((at, m) for at, m in limits if at <= size)[1]:
            expected.append(tuple(r))
    got = corpus_pipeline.drop_unknown_language(spark, docs, "")
    assert got.schema == docs.schema and 0 < len(expected) < docs.count() - 4
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    draw = [lambda: rng.random() ** 9, lambda: rng.choice([0.1, 0.25, 1 / 3]), lambda: 0.5, lambda: 1 + rng.randrange(50) * 1e-15]
    rows = [(at, draw[at](), rng.choice([1, 1, 1, 40])) for at in range(4) for _ in range(3000)] + [(9, 0.5, 3)]
    df = spark.createDataFrame(rows, "at int, _margin double, n long").repartition(4)
    for share in (0.0, 0.02, 0.5, 0.999):
        whole = [sorted(m for a, m, n in rows if a == at for _ in range(n)) for at in range(4)]
        assert language.quantiles(df, share, 4) == {at: own[int(share * len(own))] for at, own in enumerate(whole)}
    assert language.quantiles(df.limit(0), 0.02, 1) == {}


def test_nothing_or_one_text_learned(spark):
    none = spark.createDataFrame([(1, "some text", None, "s", 0)], SCHEMA)
    assert language.calibrate(none) == [(low, 0.0) for low in language.LENGTHS]
    one = spark.createDataFrame([(1, "some text", "en", "s", 0), (2, "und der text", "de", "s", 0)], SCHEMA)
    assert language.calibrate(one) == [(low, 0.0) for low in language.LENGTHS]
