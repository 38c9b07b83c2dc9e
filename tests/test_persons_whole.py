"""Person queries on made tables against brute force over all pairs."""

import random
from itertools import combinations

import pytest

from concord.config import config
from concord.operators import blocking, canonical, rules
from concord.plans import linkage, persons, tables

SEGMENTS, CITIES = ["BUILDING", "MACHINERY", "FURNITURE"], ["PERU", "CHINA", "KENYA", "INDIA"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Folder of the tables, and each customer's keys."""
    rng, at = random.Random(4), tmp_path_factory.mktemp("persons")
    customers, orders, lines, keys = [], [], [], {}
    for c in range(1, 141):
        # most of them in one segment and one city, in blocks beyond 60 ids
        last, city = (0, 0) if c <= 75 else (rng.randrange(3), rng.randrange(4))
        customers.append((c, SEGMENTS[last], city))
        first, own = f"n{c % 40}", set()
        for o in range(2):
            order = 2 * c + o
            orders.append((order, c, "O"))
            for n in range(2):
                supplier, part, flag, status = rng.randrange(1, 4000), rng.randrange(1, 9000), rng.choice("ANR"), rng.choice("FO")
                lines.append((order, n, supplier, part, flag, status))
                own |= {("hco", supplier), ("pin", supplier, SEGMENTS[last][:4]), ("phone", part // 4), ("email", order % 977), ("spec", flag, SEGMENTS[last]), ("spec", flag, first)}
                own |= {("licence", supplier)} if status == "F" and flag == "N" else set()
        # every first name sounds N000
        keys[f"9{c:017d}"] = own | {("city", city), ("initial", "n", SEGMENTS[last]), ("initial", SEGMENTS[last][0], first)}
    frames = {"customer": (customers, "c_custkey long, c_mktsegment string, c_nationkey int"), "nation": (list(enumerate(CITIES)), "n_nationkey int, n_name string"), "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string"), "lineitem": (lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at), keys


def test_all_pairs_of_large_blocks(spark, made, monkeypatch):
    monkeypatch.setattr(linkage, "HOT", 20)
    at, keys = made
    want = {(a, b) for a, b in combinations(sorted(keys), 2) if keys[a] & keys[b]}
    got = persons.person_dedupe_pairs(spark, at).collect()
    assert len(got) == len(want) and {(r.vid_a, r.vid_b) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.classification, []).append(r)
    summary = {r.classification: (r.pairs, r.vids) for r in persons.person_summary(spark, at).collect()}
    assert summary == {k: (len(v), len({x for r in v for x in (r.vid_a, r.vid_b)})) for k, v in by.items()}
    assert any(r.rule == "G1_NAME_SPL_HCO" or "HCO" in r.reasons for r in got)


def test_salted_blocks_give_the_same_pairs(spark):
    keys = spark.createDataFrame([("k", "x", f"{i:03d}") for i in range(50)] + [("k", "y", f"{i:03d}") for i in range(5)], "kind string, key string, vid string")
    pairs = lambda hot: sorted(map(tuple, blocking.candidate_pairs(keys, hot=hot).collect()))
    assert pairs(7) == pairs(None) and len(pairs(7)) == 1225


@pytest.mark.parametrize("external", [False, True])
def test_every_customer_is_probed(spark, made, monkeypatch, external):
    monkeypatch.setattr(linkage, "HOT", 20)
    at, keys = made
    cfg, rows = config(persons.PERSON), tables.persons(spark, at)
    probe = canonical.persons(rows.drop("license_number", "license_body", "license_status") if external else rows, cfg)
    known = canonical.persons(rows, cfg)
    # an external record has no licence, hence no licence key; the classes come from all pairs, the keys from here
    own = {v: {k for k in ks if k[0] != "licence"} for v, ks in keys.items()} if external else keys
    pairs = [(a, b) for a in own for b in keys if own[a] & keys[b] and (external or a != b)]
    everything = rules.paired(spark.createDataFrame(pairs, "vid_a string, vid_b string"), probe, known)
    shared = canonical.shared_contacts(known, cfg["shared_contact_threshold"])
    count, best = dict.fromkeys(keys, 0), {}
    for r in linkage._person_classes(everything, cfg, shared, negatives=False).select("vid_a", "vid_b", "classification", "score", "nscore").collect():
        if r.nscore >= linkage.NOISE and r.classification != "NOT_DUP":
            auto = r.classification == "AUTO"
            count[r.vid_a] += 1
            best[r.vid_a] = min(best.get(r.vid_a, (1, 0, "")), (-auto, -(r.nscore if auto else r.score), r.vid_b))
    got = (persons.person_external if external else persons.person_screen)(spark, at).collect()
    assert {r.vid.removeprefix("src:"): (r.match_count, r.best_vid) for r in got} == {v: (n, best[v][2] if n else "") for v, n in count.items()}
    assert len(got) == len(keys)
