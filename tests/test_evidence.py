"""Spellings, links and the ladder of phase 2, with literal cases."""

from pyspark.sql import functions as F

from concord.plans import evidence


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_spellings(spark):
    say = lambda name, text: one(spark, evidence.name_score(F.lit(name), F.lit(text), F.lit(name.split()[0]), F.lit(name.split()[-1])))
    assert say("Mohammed Iqbal", "Dr Muhammad Ikbal sits here") == 90
    assert say("Mohammed Iqbal", "dr mohammed iqbal") == 100
    assert say("Ramesh Rao", "rao and ramesh") == 95
    assert say("Ramesh Zed", "rammesh only") == 37
    assert say("Mohammed Iqbal", "muhammad " + "x " * 90 + "ikbal") == 40
    assert set(evidence._variants()["laxmi"]) == {"lakshmi", "lakshmy"} and "muhammad" in evidence._variants()["md"]


def test_links_of_the_own_domain(spark):
    html = '<a href="/doctors">x</a> <a href="https://a.in/doctors">again</a> <a href="team.html">us</a> <a class="b" href="https://b.in/doctors">o</a> <a href="mailto:doctor@a.in">m</a> <a href="#team">t</a> <a href="/news">n</a>'
    assert one(spark, evidence.doctor_links(F.lit("https://a.in/x?y"), F.lit(html))) == ["https://a.in/doctors", "https://a.in/team.html"]
    many = " ".join(f'<a href="/doctor{i}">d</a>' for i in range(20))
    assert len(one(spark, evidence.doctor_links(F.lit("https://a.in/"), F.lit(many)))) == 15


def test_ladder(spark):
    rows = [
        (1, 0, 0, "a", 35), (1, 0, 1, "b", 90), (1, 1, 0, "c", 100),  # the first that wins at once
        (2, 0, 0, "a", 70), (2, 1, 0, "b", 100),  # enough after the first query
        (3, 0, 0, "a", 30), (3, 1, 0, "a", 90), (3, 1, 1, "b", 30),  # an address counts once; the first of equals
        (4, 0, 0, "a", None), (4, 11, 0, "b", 90),  # no evidence, and a query too many
        *[(5, 0, i, f"u{i}", 90 if i == 5 else 20) for i in range(6)],  # five results a query
    ]
    df = spark.createDataFrame(rows, "claim int, query int, place int, href string, score int")
    got = {r.claim: (r.href, r.score, r.lead, r.affiliated, r.confidence) for r in evidence.ladder(df).collect()}
    assert got == {1: ("b", 90, "found", True, "High"), 2: ("a", 70, "found", True, "Medium"), 3: ("a", 30, "suggested", False, "Low"), 5: ("u0", 20, "suggested", False, "Low")}
