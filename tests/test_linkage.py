import pytest
from pyspark.sql import functions as F

from concord.config import config
from concord.operators import blocking, canonical, rules
from concord.plans import linkage


def pair(spark, a, b, cfg=None, shared=None):
    base = {"vid": "1", "first_name": "asha", "last_name": "rao", "city_cda": "", "specialty_1": "skin", "city": "pune", "state": "", "postal": "", "phone_1": "", "email_1": "", "hco_vid": "", "license_number": "", "license_body": "b", "license_status": "A", "candidate": ""}
    rows = [base | a, base | {"vid": "2"} | b]
    names = list(base)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names)).withColumn("seq", F.lit(1))
    return linkage.dedupe_persons(df, config({"blocking": {"cap": None}}, cfg)).pairs.collect()


@pytest.mark.parametrize(
    "a,b,rule",
    [
        ({"hco_vid": "h"}, {"hco_vid": "h", "city": "x"}, "G1_NAME_SPL_HCO"),
        ({"postal": "411001"}, {"postal": "411001", "city": "x"}, "G2_NAME_SPL_PIN"),
        ({"phone_1": "5551234567"}, {"phone_1": "5551234567"}, "G3a_NAME_SPL_CITY_PHONE"),
        ({"license_number": "7"}, {"license_number": "7"}, "G3b_NAME_SPL_CITY_LICENSE"),
        ({}, {}, "G3c_NAME_SPL_CITY_UNCOMMON"),
        ({"license_number": "7", "specialty_1": "eye"}, {"license_number": "7"}, "G4_LICENSE"),
        ({"phone_1": "5551234567", "email_1": "a@bcd.ef", "specialty_1": "eye", "last_name": "raoz"}, {"phone_1": "5551234567", "email_1": "a@bcd.ef"}, "G5_PHONE_EMAIL"),
        ({"email_1": "a@bcd.ef", "specialty_1": "eye"}, {"email_1": "a@bcd.ef"}, "G6_EMAIL_NAME"),
        ({"license_number": "7", "specialty_1": "eye"}, {"license_number": "8"}, "N1_LICENSE_CONFLICT"),
        ({}, {"city": "delhi"}, "N2_DIFFERENT_CITIES"),
    ],
)
def test_person_rules(spark, a, b, rule):
    rows = pair(spark, a, b)
    assert [r.rule for r in rows] == [rule]


def test_common_name_goes_to_review(spark):
    cfg = {"common_names": {"first": ["asha"], "last": ["rao"]}}
    row = pair(spark, {}, {}, cfg)[0]
    assert row.classification == rules.REVIEW and row.score == 35 + 30 + 20


def test_no_self_pairs_and_caps(spark):
    keys = spark.createDataFrame([("k", "x", f"{i:03d}") for i in range(20)] + [("k", "y", "000"), ("k", "y", "019"), ("k", "z", "a")], "kind string, key string, vid string")
    assert blocking.candidate_pairs(keys).count() == 190
    assert blocking.candidate_pairs(keys, 5).count() == 11
    assert {tuple(r) for r in blocking.candidate_pairs(keys, None, 1).collect()} == {("000", "019")}


def test_first_row_by_order_and_shared(spark):
    df = spark.createDataFrame([("7", 2, "b", "9999999"), ("7", 1, "a", "8888888"), (None, 1, "z", "1")], "vid string, seq int, name string, phone string")
    rows = canonical.organisations(df, config()).collect()
    assert len(rows) == 1 and rows[0].name_norm == "a" and rows[0].phones == ["8888888", "9999999"]
    people = spark.createDataFrame([(str(i), i, "5550000000") for i in range(5)] + [("9", 1, "5551111111")], "vid string, seq int, phone_1 string")
    assert [(r.value, r.vids) for r in canonical.shared_contacts(canonical.persons(people, config()), 5).collect()] == [("5550000000", 5)]


def test_clusters_and_screen(spark):
    canon = spark.createDataFrame([(v,) for v in "abcdef"], "vid string")
    pairs = spark.createDataFrame([("a", "b", 95.0, "AUTO", "r", 100), ("b", "c", 95.0, "AUTO", "r", 100), ("d", "e", 95.0, "AUTO", "r", 100), ("a", "f", 50.0, "NOT_DUP", "", 0)], "vid_a string, vid_b string, nscore double, classification string, rule string, score int")
    linked = linkage.Linked(canon, pairs)
    assert sorted(map(tuple, linked.clusters().collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")]
    assert [r.vid for r in linked.unique().collect()] == ["f"]
    best = {r.vid: (r.verdict, r.match_count, r.best_vid) for r in linkage.best_matches(canon, pairs).collect()}
    assert best["a"] == ("LIKELY_DUP", 1, "b") and best["f"] == ("CLEAN", 0, "")
