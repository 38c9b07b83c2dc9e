import math
import random
from collections import Counter

from pyspark.sql import functions as F

from concord.llm import urls

CASES = [
    (1, "HTTP://Sub.EXAMPLE.org/es/x", "sub.example.org", "/es/x", "example.org/es/", "block"),
    (2, "https://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (4, "http://a.com/FR/1", "a.com", "/FR/1", None, None),
    (5, "http://a.com/fr/1#x", "a.com", "/fr/1", "com/fr/", "allow"),
    (6, "http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    (7, "http://a.org?x=/y", "a.org", "", None, None),
    (8, None, "", "", None, None),
    (9, "a.org/x", "", "", None, None),
    (10, "x://org/", "org", "/", "org/", "allow"),
    (11, "http://É.ORG/é", "É.org", "/é", "org/", "allow"),
    (12, "", "", "", None, None),
    (13, "http://b.net/x://c.org/", "b.net", "/x://c.org/", None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(a, b, "own") for a, b, *_ in CASES], "page_id long, url string, host string")
    rows = {r.page_id: r for r in urls.judge(df, urls.RULES).collect()}
    for i, _, host, path, rule, verdict in CASES:
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), i
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, [("com/", "block")]).collect()} == {"block"}


def test_trees_learn(spark):
    df = spark.range(600).select(F.col("id").alias("page_id"), F.expr("if(id % 2 = 0, concat('http://h', id, '.good.net/a/', id), concat('http://h', id, '.bad.net/x/y/z/', id, '?a=1&b=2&c=', id))").alias("url"))
    rules = [(f"h{i}.{'good' if i % 2 == 0 else 'bad'}.net/", "allow" if i % 2 == 0 else "block") for i in range(60)]
    rows = urls.judge(df, rules).where("rule is null").collect()
    right = sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in rows)
    assert len(rows) == 540 and right / len(rows) > 0.98


def test_lexical_features_alone_tell(spark):
    """Every URL has a site and a section of its own; only its digits and parameters tell the verdict."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, rules = [], []
    for i in range(700):
        bad, host = i % 2, f"{letters(9)}{i}.{letters(3)}x"
        tail = "".join(rng.choice("0123456789") for _ in range(20)) + f"?a={i}&b=2" if bad else letters(22)
        rows.append((i, f"http://{host}/{letters(8)}{i}/{tail}"))
        if i < 100:
            rules.append((f"{host}/", "block" if bad else "allow"))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(got) == 600 and sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) / 600 > 0.97


def test_out_of_fold_rates(spark):
    rng = random.Random(2)
    rows = [(f"http://s{rng.randrange(4)}.net/{i}", rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame([(u, u.split("/")[2], float(b)) for u, b in rows], "_url string, site string, _block double")
    folds = {r["_url"]: r["f"] for r in df.select("_url", urls._fold(F.col("_url")).alias("f")).collect()}
    got = {r["_url"]: (r["site_rate"], r["site_known"]) for r in urls.with_rates(df, df, ["site"], True).collect()}
    for url, _ in rows:
        other = [(u, b) for u, b in rows if folds[u] != folds[url]]
        own = [b for u, b in other if u.split("/")[2] == url.split("/")[2]]
        overall = sum(b for _, b in rows) / len(rows)
        assert math.isclose(got[url][0], (sum(own) + urls.SMOOTH * overall) / (len(own) + urls.SMOOTH)) and math.isclose(got[url][1], math.log1p(len(own)))


def test_against_plain_python(spark):
    """Hosts, paths, rules and entropies of made URLs."""
    rng = random.Random(7)
    parts = ["http://", "://", "example.org", "Sub.EXAMPLE.org", "a.com", "fr.com", "b.net", "é.org", "/es/", "/en/1", "/fr/", "/de/x", "/", "?q=1&r=/es/", "#f", "", "日本", ".org", "org"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    rows = {r.page_id: r for r in urls.judge(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string"), urls.RULES).collect()}
    host, path = urls.host_path(F.col("url"))
    entropies = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").select("page_id", urls.lexical(F.col("url"), host, path)["entropy"].alias("e")).collect()
    for i, text in enumerate(texts):
        host, path = "", ""
        if text and "://" in text:
            rest = text.split("://", 1)[1]
            ends = [rest.find(c) for c in "/?#" if c in rest]
            host, tail = low(rest[: min(ends, default=len(rest))]), rest[min(ends, default=len(rest)) :]
            path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = max(fits, key=len, default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, want), text
        if want:
            assert rows[i].verdict == dict(urls.RULES)[want]
    for r in entropies:
        text = low(texts[r.page_id] or "")
        want = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0
        assert abs(r.e - want) < 1e-9
