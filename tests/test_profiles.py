"""Pairs of groups of like organisations against every pair of records compared by itself."""

import random

import pytest
from pyspark.sql import functions as F

from concord.config import config
from concord.operators import blocking, canonical, profiles, rules
from concord.plans import dedupe, linkage

NO_CAP = config({"blocking": {"cap": None}})


def made(spark, copies=1, phones=True):
    """Organisations of few names and places, so that many are alike; the ids of copies are dealt anew."""
    rng, rows = random.Random(8), []
    for _ in range(60):
        name = f"{rng.choice(['old', 'new', 'or', None])} {rng.choice(['ring', 'rings', 'rod'])}"
        rows.append((name, rng.choice(["clinic", "ward", ""]), rng.choice(["Pune", "Delhi"]), rng.choice(["1", "2", None]), rng.choice(["Main Gate Lane", "Gate Main", None]), rng.choice(["5550000001", None, None, None]) if phones else None))
    ids = list(range(60 * copies))
    rng.shuffle(ids)
    return spark.createDataFrame([(f"{i:04d}", i, *r) for i, r in zip(ids, rows * copies, strict=True)], "vid string, seq int, name string, type string, city string, postal string, address_1 string, phone string")


def plain(rows, display=False):
    canon = rules.organisation_words(canonical.organisations(rows, NO_CAP))
    pairs = blocking.candidate_pairs(blocking.organisation_keys(canon, NO_CAP))
    return linkage.Linked(canon, linkage._organisation_classes(rules.paired(pairs, canon), NO_CAP, display))


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def both(spark):
    rows = made(spark, 3)
    return linkage.dedupe_organisations(rows, NO_CAP), plain(rows)


@pytest.mark.parametrize("what", ["summary", "rule_counts", "clusters", "involvement", "tagged"])
def test_groups_count_as_their_records(both, what):
    got, want = (rows_of(getattr(x, what)()) for x in both)
    assert got == want and got


def test_pairs_of_groups_unroll_to_all_pairs(both, monkeypatch):
    # groups of more than two ids are held in several arrays
    monkeypatch.setattr(profiles, "CHUNK", 2)
    got, want = both
    pairs = profiles.unrolled(got.classes, got.records)
    assert rows_of(pairs) == rows_of(got.pairs) == rows_of(want.pairs)
    assert {r.classification for r in pairs.collect()} == {"AUTO", "REVIEW", "NOT_DUP"}
    ids = lambda x: {r.vid for r in x.unique().collect()}
    assert ids(got) == ids(want)


def test_compared_pairs_do_not_grow_with_copies(spark):
    one, many = (linkage.dedupe_organisations(made(spark, n), NO_CAP) for n in (2, 8))
    assert one.classes.count() == many.classes.count()
    pairs = lambda x: sum(r.pairs for r in x.summary().collect())
    assert pairs(many) == many.pairs.count() > 15 * pairs(one)


def test_review_shows_each_record_on_its_side(spark):
    rows = made(spark, 2)
    got, want = linkage.dedupe_organisations(rows, NO_CAP, display=True), plain(rows, display=True)
    assert rows_of(got.pairs) == rows_of(want.pairs)
    assert got.classes.count() < got.pairs.count()


def test_org_review_is_in_order(spark, tmp_path):
    parts = [(i, f"{'old' if i % 3 else 'new'} ring", "LARGE" if i % 2 else "SMALL", f"Brand#{i % 4 // 2}", i % 20) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [(-r.score, r.vid_a, r.vid_b) for r in dedupe.org_review(spark, str(tmp_path)).collect()]
    assert got == sorted(got) and got


def test_cross_check_groups_either_side(spark, monkeypatch):
    seen, unrolled = [], profiles.unrolled
    monkeypatch.setattr(profiles, "unrolled", lambda classes, *records: seen.append(classes.count()) or unrolled(classes, *records))
    rows = made(spark, 4)
    target = rows.where(F.col("seq") % 3 == 0)
    got = linkage.cross_check_organisations(target, rows, NO_CAP)
    left, right = (rules.organisation_words(canonical.organisations(x, NO_CAP)) for x in (target, rows.where(F.col("seq") % 3 != 0)))
    pairs = blocking.probe_pairs(blocking.organisation_keys(left, NO_CAP), blocking.organisation_keys(right, NO_CAP))
    want = linkage._organisation_classes(rules.paired(pairs, left, right), NO_CAP)
    assert rows_of(got) == rows_of(want)
    assert seen[0] < want.count()
