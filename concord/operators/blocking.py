"""Blocking: keys of records, and the pairs of records that share one.

Keys are rows ``(kind, key, vid)``, distinct for each record, so that no record meets itself.  A
block beyond ``cap`` keeps its first ``cap`` ids in id order: the cap is part of the semantics, and
it bounds what any block can contribute.  Spark limits each group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import text as X

_SEP = "\u0001"


def _key(kind: str, *parts: Column) -> Column:
    """A key, or null if a part is empty."""
    present = F.lit(True)
    for p in parts:
        present = present & p.isNotNull() & (p != "")
    return F.when(present, F.struct(F.lit(kind).alias("kind"), F.concat_ws(_SEP, *parts).alias("key")))


def _each(kind: str, values: Column, *parts: Column) -> Column:
    return F.transform(values, lambda v: _key(kind, v, *parts))


def _rows(canon: DataFrame, singles: list[Column], lists: list[Column]) -> DataFrame:
    keys = F.concat(F.array(*singles), *lists) if lists else F.array(*singles)
    return canon.select("vid", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("k")).select("k.kind", "k.key", "vid")


def organisation_keys(canon: DataFrame, cfg: dict) -> DataFrame:
    name, city, postal = F.col("name_norm"), F.col("city_norm"), F.col("postal_norm")
    word = F.substring_index(name, " ", 1)
    short = X.acronym(name)
    singles = [
        _key("name_city", name, city),
        _key("name_postal", F.left(name, F.lit(6)), postal),
        F.when(word.rlike("^[a-z]{2,6}$"), _key("acronym", word, city)),
        F.when(F.length(short) >= 3, _key("acronym", F.left(short, F.lit(3)), city)),
    ]
    if cfg["blocking"]["phonetic"]:
        singles.append(F.when(word != "", _key("sound_city", X.soundex_flat(word), city)))
    return _rows(canon, singles, [_each("phone", F.col("phones")), _each("fax", F.col("faxes"))])


def person_keys(canon: DataFrame, cfg: dict) -> DataFrame:
    """The families of person keys; names also in swapped order."""
    first, last, city = F.col("first_norm"), F.col("last_norm"), F.col("city_cda")
    other = first != last
    singles = [_key("name_city", last, city), F.when(other, _key("name_city", first, city))]
    if cfg["blocking"]["initial"]:
        singles += [_key("initial_name", F.left(first, F.lit(1)), last), _key("initial_name", F.left(last, F.lit(1)), first)]
    if cfg["blocking"]["phonetic"]:
        singles += [F.when(last != "", _key("sound_city", X.soundex_flat(last), city)), F.when(first != "", _key("sound_city", X.soundex_flat(first), city))]
    lists = [
        _each("name_state", F.col("states"), last), F.transform("states", lambda s: F.when(other, _key("name_state", s, first))),
        _each("specialty_name", F.col("specialty_groups"), last), _each("specialty_name", F.col("specialty_groups"), first),
        _each("pin_name", F.col("pins"), F.left(last, F.lit(4))), _each("hco", F.col("hco_vids")),
        F.transform("active_licenses", lambda x: _key("licence", x["body"], x["num"])), _each("email", F.col("emails")), _each("phone", F.col("phones")),
    ]
    return _rows(canon, singles, lists)


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("kind", "key").agg(F.count("*").alias("size"))


def capped(keys: DataFrame, cap: int | None) -> DataFrame:
    if not cap:
        return keys
    order = Window.partitionBy("kind", "key").orderBy("vid")
    return keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def meet(left: DataFrame, right: DataFrame, hot: int | None = None) -> DataFrame:
    """All rows of ``left`` beside those of ``right`` with the same key.

    With ``hot`` a block of more rows of ``right`` is dealt over salts, so that at most about so many
    rows of ``left`` meet the block in one task; the pairs are the same.
    """
    if not hot:
        return left.join(right, ["kind", "key"])
    salts = block_sizes(right).where(F.col("size") > hot).select("kind", "key", F.ceil(F.col("size") / hot).cast("int").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    dealt = left.join(salts, ["kind", "key"], "left").withColumn("_salt", F.pmod(F.xxhash64("vid_a"), n).cast("int")).drop("_n")
    repeated = right.join(salts, ["kind", "key"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    return dealt.join(repeated, ["kind", "key", "_salt"]).drop("_salt")


def candidate_pairs(keys: DataFrame, cap: int | None = None, max_pairs: int | None = None, hot: int | None = None) -> DataFrame:
    """Distinct ``(vid_a, vid_b)``, ``vid_a < vid_b``, of records that share a key.

    With ``max_pairs`` only so many, those of the smallest blocks first; ``hot`` as in ``meet``.
    """
    kept = capped(keys, cap)
    other = kept.withColumnRenamed("vid", "vid_b")
    pairs = meet(kept.withColumnRenamed("vid", "vid_a"), other, hot).where("vid_a < vid_b")
    if not max_pairs:
        return pairs.select("vid_a", "vid_b").distinct()
    sized = pairs.join(block_sizes(kept), ["kind", "key"]).groupBy("vid_a", "vid_b").agg(F.min("size").alias("size"))
    return sized.orderBy("size", "vid_a", "vid_b").limit(max_pairs).select("vid_a", "vid_b")


def probe_pairs(probe: DataFrame, reference: DataFrame, same_ids: bool = False, hot: int | None = None) -> DataFrame:
    """Distinct ``(vid_a, vid_b)``: a probe record and a reference record that share a key; no cap.  ``hot`` as in ``meet``."""
    left, right = probe.withColumnRenamed("vid", "vid_a"), reference.withColumnRenamed("vid", "vid_b")
    pairs = meet(left, right, hot).select("vid_a", "vid_b").distinct()
    return pairs if same_ids else pairs.where("vid_a <> vid_b")
