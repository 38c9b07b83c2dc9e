import re

from test_functions import plain_norm

from concord.functions import text as X
from concord.plans import quality


def sound(word):
    w = re.sub("[^a-z]", "", word.lower())
    codes = dict(zip("bfpvcgjkqsxzdtlmnr", "111122222222334556", strict=True))
    coded = re.sub(r"(\d)\1+", r"\1", "".join(codes.get(c, "") for c in w))
    return "Z000" if not w else (w[0].upper() + coded[0 if w[0] in "aeiouhwy" else 1 :][:3]).ljust(4, "0")


def test_whole_texts(spark, tmp_path):
    tail = " Zoë Łódź 555 123 4567 of the Ärzte hospital clinic"
    texts = ["short 12", "word " * 100 + "- part" + tail, "plain " * 20000 + tail, "Dr Rao - " + "x9 " * 300, "!!! 123", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "big green", "Brand#12")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows = {r.id: r for r in quality.text_functions(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        r, t = rows[f"d{i}"], t or ""
        digits = re.sub("[^0-9]", "", t)
        assert r.norm == plain_norm(t) and r.n_digits == len(digits) and r.phone == (digits[-10:] if len(digits) >= 7 else None)
        assert r.stripped == plain_norm(t.split(" - ")[0])
        assert r.acronym == "".join(w[0] for w in r.norm.split() if len(w) > 1 and w not in X.ACRONYM_STOP)
        heads, generic = "|".join(re.escape(h) for h in X.HONORIFICS if " " not in h), "|".join(sorted(X.GENERIC, key=len, reverse=True))
        core = re.sub(rf"^({heads})(\s+|$)", "", r.stripped).strip()
        assert r.core == re.sub(rf"((^|\s+)({generic}))+$", "", core).strip()
        if texts[i] is not None:
            assert r.sound == (" ".join(map(sound, re.findall(r"[^\W\d_]+", t))) or "Z000")
    assert rows["d1"].phone == "5551234567" and rows["d2"].core.endswith("arzte")
    assert rows["p1"].sound == sound("big green") and rows["p1"].licence == "BIGGREENHO"
