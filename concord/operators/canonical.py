"""Collapse of exploded extracts: one record for each id.

Input columns are logical ones (see ``concord.sources.schema``); absent ones count as null.  ``seq``
is the input order: scalars come from an id's first row, sets from all its rows.  Both are partial
aggregates, so an id with very many rows costs one buffer a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text as X


def column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _set(value: Column) -> Column:
    """Sorted distinct non-empty values."""
    return F.array_sort(F.collect_set(F.when(value != "", value)))


def organisations(df: DataFrame, cfg: dict) -> DataFrame:
    """One record for each ``vid``; rows without one are left out."""
    c = lambda n: column(df, n)
    name = X.norm_text(c("name"))
    rows = df.where(F.trim(c("vid")) != "").select(
        F.trim(c("vid")).alias("vid"), (F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()).alias("seq"),
        F.struct(
            name.alias("name_norm"), X.strip_org_affixes(X.norm_text(X.before_locality(c("name"))), cfg["org_strip_prefixes"], cfg["org_strip_suffixes"]).alias("name_stripped"),
            X.norm_text(c("type")).alias("type_norm"), X.norm_text(c("city")).alias("city_norm"), X.norm_text(c("state")).alias("state_norm"), X.digits(c("postal")).alias("postal_norm"),
            X.norm_text(F.concat_ws(" ", c("address_1"), c("address_2"))).alias("addr_norm"), c("status").alias("status"), X.blank(c("name")).alias("display_name"), X.blank(c("type")).alias("display_type"), X.blank(c("city")).alias("display_city"),
        ).alias("first"),
        X.norm_phone(c("phone")).alias("phone"), X.norm_phone(c("fax")).alias("fax"),
    )
    out = rows.groupBy("vid").agg(F.min_by("first", "seq").alias("first"), _set(F.col("phone")).alias("phones"), _set(F.col("fax")).alias("faxes"))
    return out.select("vid", "first.*", "phones", "faxes").withColumn("name_core", X.core_org_name(F.col("name_stripped")))


def persons(df: DataFrame, cfg: dict, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """One record for each ``vid``; phones, e-mails and specialties may be arrays or single columns."""
    c = lambda n: column(df, n)

    def raw(prefix: str) -> Column:
        """The distinct values of one or several columns as they are; they are normalised once an id, not once a row."""
        names = [n for n in df.columns if n == prefix or n.startswith(f"{prefix}_")]
        values = [F.col(n).cast("string") for n in names]
        if len(values) == 1:
            return F.collect_set(values[0])
        return F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*values), lambda v: v.isNotNull())))) if values else F.array().cast("array<string>")

    def normed(name: str, norm) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(name, norm), lambda v: v.isNotNull() & (v != "")))).alias(name)

    def licences(name: str) -> Column:
        each = F.transform(name, lambda x: F.struct(X.norm_license(x["num"]).alias("num"), X.norm_text(x["body"]).alias("body")))
        return F.array_sort(F.array_distinct(F.filter(each, lambda x: x["num"].isNotNull()))).alias(name)

    strip = lambda x: X.strip_name_affixes(X.norm_text(x), cfg["name"]["strip"])
    active = F.upper(F.trim(c("license_status"))).isin("A", "ACTIVE")
    licence = F.when(c("license_number").isNotNull(), F.struct(c("license_number").alias("num"), c("license_body").alias("body")))
    said = ["first_name", "last_name", "middle_name", "full_name", "city_cda", "status", "candidate"]
    shown = F.concat_ws("; ", *[F.trim(F.col(n).cast("string")) for n in df.columns if n == "specialty" or n.startswith("specialty_")])
    rows = (df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())).where(c("vid").isNotNull()).groupBy(c("vid").alias("vid")).agg(
        F.min_by(F.struct(*[c(n).alias(n) for n in said], shown.alias("display_specialties")), "seq").alias("r"),
        raw("specialty").alias("specialties"), raw("phone").alias("phones"), raw("email").alias("emails"), F.collect_set(licence).alias("licenses"), F.collect_set(F.when(active, licence)).alias("active_licenses"),
        raw("hco_vid").alias("hco_vids"), F.collect_set(c("postal")).alias("pins"), F.collect_set(c("city")).alias("cities"), F.collect_set(c("state")).alias("states"),
    )
    r = lambda n: F.col(f"r.{n}")
    named = rows.withColumns({"first_norm": strip(r("first_name")), "last_norm": strip(r("last_name")), "_middle": strip(r("middle_name"))})
    full = F.trim(F.concat_ws(" ", "first_norm", "_middle", "last_norm"))
    canon = F.regexp_replace(F.when(full != "", full).otherwise(strip(r("full_name"))), " +", " ")
    out = named.select(
        "vid", canon.alias("name_canon"), "first_norm", "last_norm", X.norm_text(r("city_cda")).alias("city_cda"), r("status").alias("status"), X.blank(r("candidate")).alias("candidate"),
        F.trim(F.concat(X.blank(r("first_name")), F.lit(" "), X.blank(r("last_name")))).alias("display_name"), r("display_specialties").alias("display_specialties"),
        normed("specialties", X.norm_text), normed("phones", X.norm_phone), normed("emails", X.norm_email), licences("licenses"), licences("active_licenses"), normed("hco_vids", lambda v: F.trim(v)), normed("pins", X.digits), normed("cities", X.norm_text), normed("states", X.norm_text),
    )
    resolved = F.transform("specialties", lambda s: X.synonym_group(s, synonyms)) if synonyms else F.col("specialties")
    return out.withColumn("specialty_groups", F.array_sort(F.array_distinct(resolved)))


def shared_contacts(canon: DataFrame, least: int) -> DataFrame:
    """``(kind, value, vids)`` of phones and e-mails that ``least`` records or more have."""
    each = canon.select("vid", F.explode(F.array(F.struct(F.lit("phone").alias("kind"), F.col("phones").alias("values")), F.struct(F.lit("email").alias("kind"), F.col("emails").alias("values")))).alias("x"))
    return each.select("vid", "x.kind", F.explode("x.values").alias("value")).groupBy("kind", "value").agg(F.count("*").alias("vids")).where(F.col("vids") >= least)
