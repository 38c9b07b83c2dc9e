"""Signals of pairs, and the ordered rules and scores that classify them.

A pair frame has both records as structs ``a`` and ``b``.  Rules are one CASE, first match first;
scores are sums of CASEs; reasons come from the same conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.functions.similarity import score_pairs

AUTO, REVIEW, NOT_DUP = "AUTO", "REVIEW", "NOT_DUP"


def paired(pairs: DataFrame, canon: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Both records beside each pair."""
    side = lambda f, n: f.select(F.col("vid").alias(f"vid_{n}"), F.struct(*f.columns).alias(n))
    return pairs.join(side(canon, "a"), "vid_a").join(side(other if other is not None else canon, "b"), "vid_b")


def _case(rules: list[tuple[Column, str]]) -> Column:
    out = None
    for condition, name in rules:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out


def _sum(parts: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """Score and comma-joined reasons."""
    score = F.lit(0)
    for condition, points, _ in parts:
        score = score + F.when(condition, F.lit(points)).otherwise(F.lit(0))
    reasons = F.array_join(F.filter(F.array(*[F.when(c, F.lit(r)) for c, _, r in parts]), lambda r: r.isNotNull()), ",")
    return score, reasons


def _same(x: str) -> Column:
    return F.coalesce((F.col(f"a.{x}") != "") & (F.col(f"a.{x}") == F.col(f"b.{x}")), F.lit(False))


def _differs(x: str) -> Column:
    return F.coalesce((F.col(f"a.{x}") != "") & (F.col(f"b.{x}") != "") & (F.col(f"a.{x}") != F.col(f"b.{x}")), F.lit(False))


def _overlap(x: str) -> Column:
    return F.coalesce(F.arrays_overlap(f"a.{x}", f"b.{x}"), F.lit(False))


def _some(side: str, x: str) -> Column:
    return F.size(F.col(f"{side}.{x}")) > 0


def organisation_words(canon: DataFrame) -> DataFrame:
    """What acronyms are told by, once a record instead of once a pair."""
    return canon.withColumns({"word": F.substring_index("name_core", " ", 1), "initials": X.acronym(F.col("name_core"))})


def organisation_signals(pairs: DataFrame) -> DataFrame:
    """Signals of pairs of records that have gone through ``organisation_words``."""
    named = pairs.withColumn("_x", F.col("a.name_core")).withColumn("_y", F.col("b.name_core"))
    scored = score_pairs(named, "_x", "_y", "nscore")
    written = (F.col("a.addr_norm") != "") & (F.col("b.addr_norm") != "")
    address = _same("city_norm") & (_same("postal_norm") | (written & X.address_overlap(F.col("a.addr_norm"), F.col("b.addr_norm"))))
    short = lambda x, y: F.coalesce(F.col(f"{x}.word").rlike("^[a-z]{2,8}$") & F.startswith(F.col(f"{y}.initials"), F.col(f"{x}.word")), F.lit(False))
    return scored.withColumns({
        "phone": _overlap("phones"), "fax": _overlap("faxes"), "type_same": _same("type_norm"), "type_diff": _differs("type_norm"), "city_same": _same("city_norm"), "city_diff": _differs("city_norm"),
        "state_same": _same("state_norm"), "postal_same": _same("postal_norm"), "address": address,
        "acronym": short("a", "b") | short("b", "a"),
    }).drop("_x", "_y")


def organisation_rule(cfg: dict) -> Column:
    ns, at = F.col("nscore"), cfg["org_auto"]
    contact = F.col("phone") | F.col("fax")
    return _case([
        ((ns >= at["H1"]) & F.col("address") & contact, "H1_NAME_ADDR_PHONE"),
        ((ns >= at["H2"]) & F.col("address") & F.col("type_same"), "H2_NAME_ADDR_TYPE"),
        ((ns >= at["H3"]) & contact & F.col("type_same"), "H3_NAME_PHONE_TYPE"),
        (F.col("acronym") & F.col("address") & F.col("type_same"), "H4_ACRONYM_ADDR_TYPE"),
        (F.col("acronym") & F.col("address") & contact, "H5_ACRONYM_ADDR_PHONE"),
    ])


def organisation_score(cfg: dict) -> tuple[Column, Column]:
    """Review score and reasons; both gates (an address, a name) set the score to 0."""
    ns, w = F.col("nscore"), cfg["org_review"]
    score, reasons = _sum([
        (ns >= 92, w["name_strong"], "NAME_STRONG"), ((ns >= 85) & (ns < 92), w["name_medium"], "NAME_MED"), ((ns >= 75) & (ns < 85), w["name_weak"], "NAME_WEAK"),
        (F.col("address"), w["address_match"], "ADDR_MATCH"), (F.col("city_same"), w["city_match"], "CITY_MATCH"), (F.col("postal_same"), w["postal_match"], "POSTAL_MATCH"),
        (F.col("phone"), w["phone_match"], "PHONE_MATCH"), (F.col("fax"), w["fax_match"], "FAX_MATCH"), (F.col("type_same"), w["type_match"], "TYPE_MATCH"),
        (F.col("state_same"), w["state_match"], "STATE_MATCH"), (F.col("acronym"), w["acronym_match"], "ACRONYM_MATCH"),
        (F.col("type_diff"), w["different_type"], "DIFF_TYPE"), (F.col("city_diff"), w["different_city"], "DIFF_CITY"),
    ])
    gate = F.col("address") & ((ns >= 75) | F.col("acronym"))
    return F.when(gate, score).otherwise(0), F.when(gate, reasons).otherwise("")


def person_signals(pairs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Signals; a contact is shared when one of the pair's common values is in ``shared``.

    The shared values are exploded from the pairs that have contacts in common, not collected.
    """
    scored = score_pairs(pairs.withColumn("_x", F.col("a.name_canon")).withColumn("_y", F.col("b.name_canon")), "_x", "_y", "nscore").drop("_x", "_y")
    geo = _overlap("pins") | _overlap("cities") | _overlap("states") | _same("city_cda")
    out = scored.withColumns({
        "phone": _overlap("phones"), "email": _overlap("emails"), "spec": _overlap("specialty_groups"), "city": _overlap("cities"), "pin": _overlap("pins"), "state": _overlap("states"), "hco": _overlap("hco_vids"),
        "licence": _overlap("licenses"), "active": _overlap("active_licenses"),
        "conflict": _some("a", "active_licenses") & _some("b", "active_licenses") & ~_overlap("active_licenses"),
        "geo": geo, "cities_diff": _some("a", "cities") & _some("b", "cities") & ~_overlap("cities"), "spec_both": _some("a", "specialties") & _some("b", "specialties"),
    })
    if shared is None:
        return out.withColumn("shared", F.lit(False))
    both = lambda x, kind: F.transform(F.array_intersect(f"a.{x}", f"b.{x}"), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    common = out.where(F.col("phone") | F.col("email")).select("vid_a", "vid_b", F.explode(F.concat(both("phones", "phone"), both("emails", "email"))).alias("c")).select("vid_a", "vid_b", "c.kind", "c.value")
    hit = common.join(shared.select("kind", "value"), ["kind", "value"], "left_semi").select("vid_a", "vid_b").distinct().withColumn("shared", F.lit(True))
    return out.join(hit, ["vid_a", "vid_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def common_name(side: str, cfg: dict) -> Column:
    names = cfg["common_names"]
    first, last = F.col(f"{side}.first_norm").isin(names["first"]) if names["first"] else F.lit(False), F.col(f"{side}.last_norm").isin(names["last"]) if names["last"] else F.lit(False)
    return (first & last) if names["both_parts"] else (first | last)


def person_rule(cfg: dict) -> Column:
    """The AUTO rules in order; the name is called common by record a, the one with the lesser id."""
    ns, at = F.col("nscore"), cfg["person_auto"]
    own = ~F.col("shared")
    base = (ns >= at["G3"]) & F.col("spec") & F.col("city")
    uncommon = [(base & ~common_name("a", cfg), "G3c_NAME_SPL_CITY_UNCOMMON")] if cfg["common_names"]["enabled"] else [(base, "G3_NAME_SPL_CITY")]
    return _case([
        ((ns >= at["G1"]) & F.col("spec") & F.col("hco"), "G1_NAME_SPL_HCO"),
        ((ns >= at["G2"]) & F.col("spec") & F.col("pin"), "G2_NAME_SPL_PIN"),
        (base & F.col("phone") & own, "G3a_NAME_SPL_CITY_PHONE"),
        (base & F.col("active"), "G3b_NAME_SPL_CITY_LICENSE"),
        *uncommon,
        ((ns >= at["G4"]) & F.col("active"), "G4_LICENSE"),
        ((ns >= at["G5"]) & F.col("phone") & F.col("email") & own, "G5_PHONE_EMAIL"),
        ((ns >= at["G6"]) & F.col("email") & own, "G6_EMAIL_NAME"),
    ])


def person_not_dup(cfg: dict) -> Column:
    """N1 and N2, which do not touch pairs of a common name that G3 held back."""
    ns, at = F.col("nscore"), cfg["person_auto"]
    contact = F.col("phone") & F.col("email")
    held = (ns >= at["G3"]) & F.col("spec") & F.col("city") & common_name("a", cfg) & F.lit(cfg["common_names"]["enabled"])
    return _case([
        (~held & F.col("conflict") & ~contact, "N1_LICENSE_CONFLICT"),
        (~held & (ns >= at["N2"]) & F.col("spec") & F.col("cities_diff") & ~contact & ~F.col("licence"), "N2_DIFFERENT_CITIES"),
    ])


def person_score(cfg: dict) -> tuple[Column, Column]:
    ns, w, n = F.col("nscore"), cfg["person_review"], cfg["name"]
    excused = F.col("hco") & (F.col("city") | F.col("pin") | F.col("geo"))
    eligible = (ns >= 90) | (~common_name("a", cfg) if cfg["common_names"]["enabled"] else F.lit(False))
    pin, city, state, geo, own = F.col("pin"), F.col("city"), F.col("state"), F.col("geo"), ~F.col("shared")
    phone, email = F.col("phone"), F.col("email")
    candidate = lambda s: F.lower(F.trim(F.coalesce(f"{s}.candidate", F.lit("")))) == "true"
    return _sum([
        (ns >= n["strong"], w["name_strong"], "NAME_STRONG"), ((ns >= n["medium"]) & (ns < n["strong"]), w["name_medium"], "NAME_MED"), ((ns >= n["weak"]) & (ns < n["medium"]), w["name_weak"], "NAME_WEAK"),
        (F.col("spec"), w["specialty_match"], "SPEC_MATCH"), (~F.col("spec") & F.col("spec_both") & excused, 0, "SPEC_DIFF_HCO_OVERRIDE"), (~F.col("spec") & F.col("spec_both") & ~excused, w["specialty_conflict"], "SPEC_CONFLICT"),
        (F.col("hco"), w["hco_overlap"], "HCO_MATCH"),
        (pin, w["pin_match"], "PIN_MATCH"), (~pin & city, w["city_match"], "CITY_MATCH"), (~pin & ~city & state & eligible, w["state_match"], "STATE_MATCH"), (~pin & ~city & geo & ~(state & eligible), w["geo_support"], "GEO_SUPPORT"),
        (F.col("licence"), w["license_match"], "LICENSE_MATCH"),
        (phone & email & own, w["phone_email_match"], "PHONE_EMAIL"), (email & ~phone & own, w["email_match"], "EMAIL"), (phone & ~email & own, w["phone_match"], "PHONE"),
        (F.col("cities_diff"), w["different_cities"], "DIFF_CITIES"), (candidate("a"), w["candidate_record"], "CAND_A"), (candidate("b"), w["candidate_record"], "CAND_B"),
    ])


def licence_info() -> Column:
    """``SAME_x``, ``DIFF_x_y``, ``ONLY_A_x``, ``ONLY_B_x`` or ``NO_LICENSE``, by the least numbers."""
    least = lambda s: F.array_min(F.transform(f"{s}.licenses", lambda x: x["num"]))
    both = F.array_min(F.transform(F.array_intersect("a.licenses", "b.licenses"), lambda x: x["num"]))
    return F.when(both.isNotNull(), F.concat(F.lit("SAME_"), both)).when(least("a").isNotNull() & least("b").isNotNull(), F.concat(F.lit("DIFF_"), least("a"), F.lit("_"), least("b"))).when(least("a").isNotNull(), F.concat(F.lit("ONLY_A_"), least("a"))).when(least("b").isNotNull(), F.concat(F.lit("ONLY_B_"), least("b"))).otherwise("NO_LICENSE")


def person_texts(cfg: dict, score: Column) -> dict[str, Column]:
    """Comment and rationale of a scored pair, from the same signals as the score."""
    w = cfg["person_review"]
    both = lambda x: F.array_sort(F.array_intersect(f"a.{x}", f"b.{x}"))
    two = lambda x: F.array_join(F.slice(both(x), 1, 2), ",")
    common = common_name("a", cfg) & F.lit(cfg["common_names"]["enabled"]) & (F.col("nscore") >= cfg["person_auto"]["G3"]) & F.col("spec") & F.col("city")
    tier = F.when(score >= w["high_confidence"], "High").when(score >= w["medium_high"], "Medium-high").when(score >= w["medium"], "Medium").otherwise("Low")
    some = lambda condition, *parts: F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise("")
    number = score.cast("int").cast("string")
    comment = F.concat(
        tier, F.lit(" confidence (Score: "), number, F.lit(")"), some(F.col("spec"), " — Specialty: ", F.array_join(both("specialty_groups"), ",")), some(F.col("licence"), " [License match: ", licence_info(), "]"),
        some(F.col("conflict"), " [WARNING: Active license conflict]"), some(common, " [COMMON NAME — manual verification recommended]"),
    )
    own = ~F.col("shared")
    parts = F.array(
        F.concat(F.lit("Name match ("), F.bround("nscore", 0).cast("int").cast("string"), F.lit("%)")), F.when(F.col("spec"), F.concat(F.lit("same specialty ("), two("specialty_groups"), F.lit(")"))),
        F.when(F.col("city"), F.concat(F.lit("same city ("), two("cities"), F.lit(")"))).when(F.col("state"), F.concat(F.lit("same state ("), two("states"), F.lit(")"))).when(F.col("pin"), "same postal code"),
        F.when(F.col("hco"), "shared HCO affiliation"), F.when(F.col("phone") & own, "shared phone number"), F.when(F.col("email") & own, "shared email"), F.when(F.col("licence"), "license match"),
    )
    rationale = F.concat(
        F.array_join(parts, ", "), F.lit(". Score: "), number, F.lit("/100."), some(common, " Name '", F.col("a.display_name"), "' is common in India — manual verification recommended."),
        some(F.col("conflict"), " Warning: active license conflict detected."),
    )
    return {"comment": comment, "rationale": rationale}


def person_display() -> dict[str, Column]:
    """What a reviewer sees of either record; of sets the first three."""
    out = {}
    for side in ("a", "b"):
        out |= {f"name_{side}": F.col(f"{side}.display_name"), f"specialties_{side}": F.col(f"{side}.display_specialties")}
        out |= {f"{c}_{side}": X.top_three(F.col(f"{side}.{c}")) for c in ("cities", "phones", "emails")}
    return out


def organisation_display() -> dict[str, Column]:
    out = {}
    for side in ("a", "b"):
        out |= {f"{c}_{side}": F.col(f"{side}.display_{c}") for c in ("name", "type", "city")} | {f"phones_{side}": X.top_three(F.col(f"{side}.phones"))}
    return out


def classify(signals: DataFrame, rule: Column, score: tuple[Column, Column], threshold: int, tiers: list[tuple[int, str]], not_dup: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """``vid_a, vid_b, nscore, classification, rule, score, reasons, comment`` and the columns of ``more``."""
    more = more or {}
    against = not_dup if not_dup is not None else F.lit(None).cast("string")
    rows = signals.select("vid_a", "vid_b", F.bround("nscore", 1).alias("nscore"), rule.alias("_auto"), against.alias("_not"), score[0].alias("_score"), score[1].alias("_reasons"), *[v.alias(k if k != "comment" else "_comment") for k, v in more.items()])
    auto, other = F.col("_auto").isNotNull(), F.col("_not").isNotNull()
    review = ~auto & ~other & (F.col("_score") >= threshold)
    comment = F.lit("Low confidence")
    for least, name in sorted(tiers):
        comment = F.when(F.col("_score") >= least, F.lit(name)).otherwise(comment)
    return rows.select(
        "vid_a", "vid_b", "nscore",
        F.when(auto, AUTO).when(review, REVIEW).otherwise(NOT_DUP).alias("classification"),
        F.when(auto, F.col("_auto")).when(other, F.col("_not")).when(~review, "N3_LOW_SCORE").otherwise("").alias("rule"),
        F.when(auto, 100).when(other, 0).otherwise(F.col("_score")).cast("int").alias("score"),
        F.when(auto | other, "").otherwise(F.col("_reasons")).alias("reasons"),
        F.when(review, F.col("_comment") if "comment" in more else comment).otherwise("").alias("comment"),
        *[F.when(review, F.col(k)).otherwise("").alias(k) if k == "rationale" else F.col(k) for k in more if k != "comment"],
    )
