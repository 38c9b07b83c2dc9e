import random
import unicodedata

from pyspark.sql import functions as F

from concord.config import SYNONYMS, config, org_profile
from concord.functions import similarity as S
from concord.functions import text as X


def values(spark, given, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def plain_norm(x):
    text = "".join(c for c in unicodedata.normalize("NFKD", (x or "").strip().lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())


def test_norm_text(spark):
    given = ["José", "Łódź", "a b", None, "  A--B ", "ﬁn", "éx", "Ｆｕｌｌ", "ß", "Ünï 12", ""]
    assert values(spark, given, X.norm_text) == [plain_norm(x) for x in given]


def test_contacts(spark):
    assert values(spark, ["123456", "1234567", "1234567890", "+91-98765 43210", None], X.norm_phone) == [None, "1234567", "1234567890", "9876543210", None]
    assert values(spark, ["mailto:A@b.co", "a@b", "none", " X Y@Z.com ", None], X.norm_email) == ["a@b.co", None, None, "xy@z.com", None]
    assert values(spark, [" a-1/2 ", "", None], X.norm_license) == ["A12", None, None]


def test_soundex(spark):
    assert values(spark, ["krishna", "kakar", "tymczak", "", "aa"], X.soundex_flat) == ["K625", "K600", "T520", "Z000", "A000"]


def test_names(spark):
    words = config()["name"]["strip"]
    assert values(spark, ["dr john smith md jr", "md", "smith"], lambda x: X.strip_name_affixes(x, words)) == ["john smith", "", "smith"]
    assert values(spark, ["apollo hospital", "hospital", "dr x clinic", "shatabdi super speciality hospital"], X.core_org_name) == ["apollo", "", "x", "shatabdi"]
    stockist = config(profile="stockist")
    assert values(spark, ["m s gupta medical agency", "agency", "shri ram pharma distributors pvt ltd"], lambda x: X.strip_org_affixes(x, stockist["org_strip_prefixes"], stockist["org_strip_suffixes"])) == ["gupta", "agency", "ram"]
    assert values(spark, ["ganesh siddha venkateswara medical college"], lambda x: X.is_acronym(F.lit("gsv"), x)) == [True]
    assert values(spark, ["gp", "eye", "other"], lambda x: X.synonym_group(x, SYNONYMS)) == ["general_medicine", "ophthalmology", "other"]
    assert values(spark, ["900000000000000001", "9.38E+17", "12345678901234"], X.id_at_risk) == [True, True, False]
    assert org_profile({"Stockist": 3, "Hospital": 2}) == "stockist" and org_profile({}) == "hco"


def test_similarity(spark):
    assert round(S.token_sort("john michael smith", "john smith"), 2) == 71.43 and S.token_set("john michael smith", "john smith") == 100
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.lcs(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        assert r.n == S.common(r.a, r.b)
        assert S.name_score(r.a, r.b) == S.name_score(r.b, r.a)
    scored = S.score_pairs(spark.createDataFrame(pairs, "a string, b string"), "a", "b", "s").collect()
    assert len(scored) == len(pairs) and all(abs(r.s - (100.0 if r.a == r.b and r.a else S.name_score(r.a, r.b))) < 1e-9 for r in scored)
