"""Normalisation of text as column expressions: whole-stage code, no Python on the executors."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition, less combining marks, makes of a lower-case character:
    one ASCII letter or digit, or several."""
    one, many = {}, {}
    for code in [*range(0xA0, 0x2C00), *range(0xF900, 0x10000)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain.isascii() and plain.isalnum():
            (one if len(plain) == 1 else many)[c] = plain.lower()
    return one, many


_ONE, _MANY = _folds()
#: Ligatures and digraphs that occur in Latin-script names; other many-letter characters become a space.
_LIGATURES = {c: p for c, p in _MANY.items() if ord(c) < 0x250 or 0xFB00 <= ord(c) <= 0xFB06}


def blank(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def norm_text(x: Column) -> Column:
    """Trimmed, lower case, without accents; anything but a-z0-9 is one space; null is empty."""
    text = F.regexp_replace(F.translate(F.lower(blank(x)), "".join(_ONE), "".join(_ONE.values())), r"\p{M}", "")
    for c, plain in _LIGATURES.items():
        text = F.replace(text, F.lit(c), F.lit(plain))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _empty_null(x: Column) -> Column:
    return F.when(x != "", x)


def norm_email(x: Column) -> Column:
    """Lower case without spaces; null without @ or below six characters."""
    text = F.regexp_replace(F.replace(F.lower(F.trim(x.cast("string"))), F.lit(" "), F.lit("")), "^mailto:", "")
    return F.when(F.contains(x, F.lit("@")) & (F.length(text) >= 6), text)


def digits(x: Column) -> Column:
    return F.regexp_replace(blank(x), "[^0-9]", "")


def norm_phone(x: Column) -> Column:
    """The last ten digits; null below seven."""
    d = digits(x)
    return F.when(F.length(d) >= 7, F.when(F.length(d) > 10, F.substring(d, -10, 10)).otherwise(d))


def norm_license(x: Column) -> Column:
    return _empty_null(F.regexp_replace(F.upper(blank(x)), r"[\s\-_/.]", ""))


def legacy_phone(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) >= 8, F.when(F.length(d) > 10, F.substring(d, -10, 10)).otherwise(d))


def legacy_pin(x: Column) -> Column:
    d = digits(x)
    last = F.when(F.length(d) > 6, F.substring(d, -6, 6)).otherwise(d)
    return F.when((last != "") & (last != "0"), last)


def _alternation(phrases: list[str]) -> str:
    return "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))


def strip_name_affixes(x: Column, words: list[str]) -> Column:
    """Without listed words at the end, then at the start; may become empty."""
    any_ = _alternation(words)
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), f"(^|\\s+)(({any_})(\\s+|$))+$", ""), f"^(({any_})(\\s+|$))+", ""))


def strip_org_affixes(x: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """Without listed phrases in front, then behind, longest first; unchanged if nothing would be left."""
    out = x
    if prefixes:
        out = F.regexp_replace(out, f"^(({_alternation(prefixes)})(\\s+|$))+", "")
    if suffixes:
        out = F.regexp_replace(out, f"((^|\\s+)({_alternation(suffixes)}))+$", "")
    out = F.trim(out)
    return F.when(out == "", x).otherwise(out)


# Honorifics, generic phrases, stop words.
HONORIFICS = ["dr", "dr.", "prof", "professor", "mr", "mrs", "ms", "smt", "shri", "sri", "m s", "messrs"]
GENERIC = [
    "clinic", "clinics", "hospital", "hospitals", "centre", "center", "nursing home", "dispensary", "polyclinic", "multispeciality", "multispecialty",
    "super speciality", "super specialty", "speciality hospital", "specialty hospital", "medical centre", "medical center", "health centre", "health center",
    "eye hospital", "eye care", "diagnostic centre", "diagnostic center", "maternity home", "eye clinic",
]
ACRONYM_STOP = ["of", "and", "the", "a", "an", "for", "in", "at", "to", "by", "from", "&", "dr", "prof", "professor", "mr", "mrs", "ms", "smt", "shri", "sri"]
ADDRESS_STOP = [
    "marg", "salai", "road", "rd", "street", "st", "lane", "ln", "nagar", "nagara", "vihar", "colony", "enclave", "sector", "phase", "block", "zone", "extension", "extn",
    "bazaar", "bazar", "market", "mkt", "chowk", "chawk", "ganj", "gunj", "peth", "wadi", "wada", "main", "new", "old", "east", "west", "north", "south", "no", "number",
    "plot", "flat", "floor", "fl", "building", "bldg", "complex", "tower", "mall", "suite", "ste", "unit", "wing", "anna", "gandhi", "nehru", "mg", "jl", "rajaji",
    "mahatma", "subhash", "netaji", "sardar", "indira",
]


def core_org_name(x: Column) -> Column:
    """Without one leading honorific and without generic phrases behind; may become empty."""
    one = "|".join(re.escape(h) for h in HONORIFICS if " " not in h)
    head = F.trim(F.regexp_replace(x, f"^({one})(\\s+|$)", ""))
    return F.trim(F.regexp_replace(head, f"((^|\\s+)({_alternation(GENERIC)}))+$", ""))


def before_locality(raw: Column) -> Column:
    """The raw name up to the first `` - ``."""
    return F.substring_index(blank(raw), " - ", 1)


def soundex_flat(x: Column) -> Column:
    """A Soundex in which vowels do not part equal codes; ``Z000`` for an empty word."""
    w = F.regexp_replace(F.lower(blank(x)), "[^a-z]", "")
    coded = F.regexp_replace(F.translate(w, "bfpvcgjkqsxzdtlmnraeiouhwy", "111122222222334556"), r"(\d)\1+", "$1")
    start = F.when(w.rlike("^[aeiouhwy]"), F.lit(1)).otherwise(F.lit(2))
    return F.when(w == "", F.lit("Z000")).otherwise(F.rpad(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(coded, start, F.lit(3))), 4, "0"))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def acronym(x: Column) -> Column:
    """Initials of the words of more than one letter that are no stop words."""
    kept = F.filter(tokens(x), lambda w: (F.length(w) > 1) & ~w.isin(ACRONYM_STOP))
    return F.array_join(F.transform(kept, lambda w: F.left(w, F.lit(1))), "")


def is_acronym(short: Column, long: Column) -> Column:
    return F.coalesce(short.rlike("^[a-z]{2,8}$") & F.startswith(acronym(long), short), F.lit(False))


def address_overlap(a: Column, b: Column, share: float = 0.70) -> Column:
    """Whether two addresses share enough of the smaller one's words, of which there are at least two."""
    stop = F.array(*[F.lit(w) for w in ADDRESS_STOP])
    x, y = (F.array_except(F.array_distinct(tokens(blank(c))), stop) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.coalesce((least >= 2) & (F.size(F.array_intersect(x, y)) / F.greatest(least, F.lit(1)) >= share), F.lit(False))


def top_three(x: Column) -> Column:
    return F.array_join(F.slice(F.array_sort(x), 1, 3), "; ")


def values_of(x: Column) -> Column:
    """Trimmed non-empty parts between ``;``, ``,`` and ``|``."""
    return F.filter(F.transform(F.split(blank(x), "[;,|]"), F.trim), lambda v: v != "")


def synonym_group(x: Column, groups: dict[str, list[str]]) -> Column:
    pairs = [F.lit(v) for g, names in groups.items() for n in names for v in (n, g)]
    return F.coalesce(F.create_map(*pairs)[x], x)


def id_at_risk(x: Column) -> Column:
    """Whether a spreadsheet would spoil the id: 15 digits or more, or an exponent."""
    return (F.length(digits(x)) >= 15) | F.coalesce(x.cast("string").rlike(r"[eE]\+"), F.lit(False))


def id_text(x: Column) -> Column:
    return F.trim(x.cast("string"))
