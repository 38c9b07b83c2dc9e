import random

import corpus_pipeline
from concord.llm import language
from concord.llm.folds import fold

WORDS = {
    "en": "the and of that with from this they have was were which their would there about people time house water".split(),
    "de": "der und die nicht mit von diese haben war wurde werden auch nach einer zeit haus wasser leute durch noch".split(),
}


def test_codes_and_unlearned_languages_go(spark):
    rng = random.Random(3)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, prose(lang := "en" if i % 2 else "de", n := rng.choice([6, 80])), lang, "s", n) for i in range(1400)]
    code = lambda: " ".join("".join(rng.choice("bcdfxqzw0123456789") for _ in range(7)) for _ in range(60))
    other = lambda: " ".join(rng.choice("kyllä mutta hän minä sinä olla talo vesi ihmiset aika".split()) for _ in range(70))
    odd = [(10**6 + i, code() if i % 2 else other(), None, "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars int")
    margins = language.calibrate(docs.where(fold() != 0))
    assert dict(margins)[256] > 0
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()}
    print("margins", margins, "kept odd", len([i for i in kept if i >= 10**6]), "kept clean", len([i for i in kept if i < 10**6]))
    assert not [i for i in kept if i >= 10**6]
    assert len(kept) >= 0.98 * len(rows) and sum(r[0] in kept for r in rows if r[4] == 6) >= 0.98 * sum(r[4] == 6 for r in rows)
