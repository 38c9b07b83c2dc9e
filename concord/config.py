"""Default configuration, its deep merge, and the profiles of organisations."""

from __future__ import annotations

import copy

# Thresholds, weights and word lists that results depend on.
DEFAULTS: dict = {
    "name": {"strong": 92, "medium": 85, "weak": 75, "strip": ["md", "do", "phd", "mbbs", "bds", "mds", "ms", "dr", "jr", "sr", "ii", "iii", "iv"]},
    "person_auto": {"G1": 92, "G2": 92, "G3": 92, "G4": 80, "G5": 85, "G6": 92, "N2": 92},
    "person_review": {
        "name_strong": 35, "name_medium": 25, "name_weak": 15, "specialty_match": 30, "hco_overlap": 25, "pin_match": 25, "city_match": 20,
        "state_match": 15, "geo_support": 10, "license_match": 40, "phone_email_match": 20, "email_match": 15, "phone_match": 10,
        "specialty_conflict": -15, "different_cities": -25, "candidate_record": -10, "review_threshold": 55, "high_confidence": 80, "medium_high": 70, "medium": 60,
    },
    "org_auto": {"H1": 90, "H2": 92, "H3": 90},
    "org_review": {
        "address_match": 50, "postal_match": 30, "phone_match": 25, "name_strong": 25, "fax_match": 15, "name_medium": 15, "type_match": 10, "city_match": 10,
        "acronym_match": 20, "name_weak": 8, "state_match": 5, "different_type": -15, "different_city": -30, "review_threshold": 70, "high_confidence": 90, "medium": 75,
    },
    "blocking": {"cap": 500, "max_pairs": None, "phonetic": True, "initial": True},
    "shared_contact_threshold": 5,
    "common_names": {"enabled": True, "both_parts": True, "first": [], "last": []},
    "velocity_per_hour": 6.5,
    "org_strip_prefixes": [],
    "org_strip_suffixes": [],
}

STOCKIST: dict = {
    "org_auto": {"H1": 93, "H2": 95, "H3": 93},
    "org_strip_prefixes": ["m s", "ms", "messrs", "shri", "smt", "sri", "mr", "mrs"],
    "org_strip_suffixes": [
        "medical agency", "medical agencies", "medical store", "medical stores", "medical hall", "pharma", "pharma distributors", "pharmaceutical", "pharmaceuticals",
        "distributors", "distributor", "agencies", "agency", "enterprises", "enterprise", "sales", "sales centre", "sales center", "traders", "trading", "trading co",
        "company", "co", "pvt ltd", "pvt", "ltd", "private limited", "limited",
    ],
}
STOCKIST_TYPES = ["pharmacy, retail", "pharmacy retail", "distributor", "stockist", "wholesale", "wholesaler", "c&f agent", "c and f", "clearing and forwarding"]

#: Specialty synonyms by group: fixed values.
SYNONYMS: dict[str, list[str]] = {
    "general_medicine": ["general medicine", "gp", "general practitioner", "general practice", "family medicine", "family practice", "internal medicine", "medicine", "physician"],
    "pediatrics": ["pediatrics", "paediatrics", "pediatric medicine", "paediatric medicine", "child health"],
    "obstetrics_gynecology": ["obstetrics and gynecology", "obstetrics and gynaecology", "obstetrics gynecology", "obstetrics gynaecology", "ob gyn", "obgyn", "gynecology", "gynaecology"],
    "orthopedics": ["orthopedics", "orthopaedics", "orthopedic surgery", "orthopaedic surgery", "ortho"],
    "ophthalmology": ["ophthalmology", "eye", "eye specialist"],
    "ent": ["ent", "otorhinolaryngology", "otolaryngology", "ear nose throat", "ear nose and throat"],
    "dermatology": ["dermatology", "dermatology and venereology", "skin", "skin specialist"],
    "cardiology": ["cardiology", "cardiac medicine", "cardiovascular medicine", "cardiovascular disease", "cardiovascular diseases", "interventional cardiology"],
    "endocrinology": ["endocrinology", "endocrinology, diabetes, & metabolism", "endocrinology diabetes & metabolism", "endocrinology diabetes and metabolism", "diabetology", "diabetes and endocrinology", "diabetes", "diabetes mellitus"],
    "psychiatry": ["psychiatry", "psychological medicine", "mental health"],
    "pulmonology": ["pulmonology", "pulmonary medicine", "respiratory medicine", "chest medicine", "chest specialist"],
    "gastroenterology": ["gastroenterology", "gastro", "gastroenterologist"],
    "nephrology": ["nephrology", "renal medicine", "kidney specialist"],
    "urology": ["urology", "urological surgery"],
    "general_surgery": ["general surgery", "surgery", "surgeon"],
    "radiology": ["radiology", "radiodiagnosis", "diagnostic radiology"],
    "anesthesiology": ["anesthesiology", "anaesthesiology", "anesthesia", "anaesthesia"],
    "dentistry": ["dentistry", "dental", "dental surgeon", "dental surgery"],
}


def merged(*parts: dict | None) -> dict:
    """Later parts over earlier ones, nested dictionaries key by key."""
    out: dict = {}
    for part in parts:
        for k, v in (part or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def config(*overrides: dict | None, profile: str | None = None) -> dict:
    return merged(DEFAULTS, STOCKIST if profile == "stockist" else None, *overrides)


def org_profile(types: dict[str, int]) -> str:
    """``stockist`` where more than half of the type values (with their counts) hold a stockist phrase."""
    hits = sum(n for t, n in types.items() if any(p in (t or "").lower() for p in STOCKIST_TYPES))
    return "stockist" if types and hits * 2 > sum(types.values()) else "hco"
