"""Runs from a file to a folder of tables: read, bind headers, dedupe, write what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.config import SYNONYMS, config, org_profile
from concord.operators import blocking, canonical, rules
from concord.plans import linkage
from concord.sources import excel, files, schema, sinks

#: Common names that a run learns from its records, at most, of either kind: the most frequent.
MOST_NAMES = 1000


def read(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A workbook's sheet, a zipped table or a text table, every column as text."""
    low = path.lower()
    return excel.read_excel(spark, path, sheet) if low.endswith((".xlsx", ".xlsm")) else files.read_zip(spark, path) if low.endswith(".zip") else files.read_text_table(spark, path)


def frequent_names(canon: DataFrame, least: int) -> dict[str, list[str]]:
    """First and last names that ``least`` records or more have: the common ones, by a rule instead of a list."""
    out = {}
    for part in ("first", "last"):
        counts = canon.where(F.col(f"{part}_norm") != "").groupBy(f"{part}_norm").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        out[part] = sorted(r[0] for r in counts.orderBy(F.desc("n"), f"{part}_norm").limit(MOST_NAMES).collect())
    return out


def common_reason(first: Column, last: Column, cfg: dict) -> Column:
    """Why a name is called common or not, in a sentence."""
    names = cfg["common_names"]
    hit = [x.isin(names[k]) if names[k] else F.lit(False) for x, k in ((first, "first"), (last, "last"))]
    common = (hit[0] & hit[1]) if names["both_parts"] else (hit[0] | hit[1])
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    said = lambda wanted: F.filter(F.array(*[F.when(w, quoted(x)) for w, x in zip(wanted, (first, last), strict=True)]), lambda v: v.isNotNull())
    yes, no = said(hit), said([~h & (x != "") for h, x in zip(hit, (first, last), strict=True)])
    are = lambda a: F.when(F.size(a) > 1, "are").otherwise("is")
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, " and ")).otherwise("name")
    return F.when(common, F.concat(listed(yes), F.lit(" "), are(yes), F.lit(" common Indian name"), F.when(F.size(yes) > 1, "s").otherwise(""), F.lit("."))).otherwise(F.concat(listed(no), F.lit(" "), are(no), F.lit(" uncommon, reducing false-match risk.")))


def _tables(linked: linkage.Linked, cfg: dict) -> dict[str, DataFrame]:
    """The result bundle: a table a class, the unique records, clusters, tagged records, summary and rules."""
    pairs = linked.held()
    of = lambda kind: pairs.where(F.col("classification") == kind).drop("classification")
    return {
        "AUTO": of(rules.AUTO), "REVIEW": of(rules.REVIEW).orderBy(F.desc("score"), "vid_a", "vid_b"), "NOT_DUP": of(rules.NOT_DUP), "UNIQUE": linked.unique().select("vid"), "CLUSTERS": linked.clusters(),
        "TAGGED": linked.tagged(), "SUMMARY": linked.summary(), "RULES": sinks.rules_sheet(pairs, cfg),
    }


def run_organisations(spark: SparkSession, path: str, folder: str, cfg: dict | None = None, kind: str = "csv") -> list[str]:
    """Dedupe an organisation extract; without a configuration the profile follows the types.  Returns the tables written."""
    rows = schema.logical_organisations(read(spark, path))
    if cfg is None:
        types = {r["type"]: r["n"] for r in rows.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(MOST_NAMES).collect()}
        cfg = config(profile=org_profile(types))
    return sinks.write_tables(_tables(linkage.dedupe_organisations(rows, cfg, display=True), cfg), folder, kind)


def run_persons(spark: SparkSession, path: str, folder: str, cfg: dict, kind: str = "csv") -> list[str]:
    """Dedupe a person extract with the specialty synonyms; returns the tables written."""
    rows = schema.logical_persons(read(spark, path))
    return sinks.write_tables(_tables(linkage.dedupe_persons(rows, cfg, SYNONYMS, display=True), cfg), folder, kind)


def index_persons(spark: SparkSession, path: str, folder: str, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """Write the reference index of a person extract; returns its keys and records."""
    canon = canonical.persons(schema.logical_persons(read(spark, path)), cfg, SYNONYMS)
    sinks.save_index(blocking.person_keys(canon, cfg), canon, folder)
    return sinks.load_index(spark, folder)
