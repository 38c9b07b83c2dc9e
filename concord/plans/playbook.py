"""The organisation clean-up steps: departments to parents, one row an id, types with overrides, affiliations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import table


def split_departments(orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Departments (a name with ``/``) and the others."""
    is_dept = F.coalesce(F.col("name").contains("/"), F.lit(False))
    return orgs.where(is_dept), orgs.where(~is_dept)


def first_by_rank(rows: DataFrame, key: str, rank: str, order: str) -> DataFrame:
    """Each id's row of the lowest rank, the earliest of equals; an aggregate, not a window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(rank, order)).alias("r")).select(key, "r.*")


def parents_in_use(departments: DataFrame, links: DataFrame, orgs: DataFrame) -> DataFrame:
    """Distinct parents of the departments, with their own rows."""
    used = links.join(departments.select("vid"), "vid", "left_semi").select(F.col("parent").alias("vid")).distinct()
    return orgs.join(used, "vid", "left_semi")


def business_type(orgs: DataFrame, base: DataFrame, override: DataFrame) -> DataFrame:
    """The override's type, else the base's, else Unknown."""
    joined = orgs.join(base.withColumnRenamed("type", "_base"), "vid", "left").join(override.withColumnRenamed("type", "_over"), "vid", "left")
    return joined.withColumn("business_type", F.coalesce("_over", "_base", F.lit("Unknown"))).drop("_over", "_base")


def affiliated(persons: DataFrame, targets: DataFrame) -> DataFrame:
    """Each person's target: the parent if it is one, else the grandparent; others are left out."""
    t = targets.select("vid").distinct()
    joined = persons.join(t.withColumnRenamed("vid", "parent").withColumn("_p", F.lit(True)), "parent", "left").join(t.withColumnRenamed("vid", "grandparent").withColumn("_g", F.lit(True)), "grandparent", "left")
    target = F.when(F.col("_p"), F.col("parent")).when(F.col("_g"), F.col("grandparent"))
    return joined.withColumn("target", target).where(F.col("target").isNotNull()).drop("_p", "_g")


def by_specialty(rows: DataFrame, specialties: list[str]) -> DataFrame:
    """Counts of distinct persons by target and specialty, the remaining ones as other."""
    each = rows.select("target", "vid", "specialty").distinct()
    counts = [F.sum((F.col("specialty") == s).cast("int")).alias(s.lower()) for s in specialties]
    return each.groupBy("target").agg(*counts, F.sum((~F.col("specialty").isin(specialties)).cast("int")).alias("other"), F.count("*").alias("total"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation as the parent and its region as the grandparent."""
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("vid"), F.concat(F.lit("n"), "n_nationkey").alias("parent"), F.concat(F.lit("r"), "n_regionkey").alias("grandparent"), F.col("c_mktsegment").alias("specialty"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("vid"))
    return nations.unionByName(table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("vid")))


def affiliation_by_specialty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_specialty(affiliated(_people(spark, sf_dir), _targets(spark, sf_dir)), ["BUILDING", "MACHINERY"])


def org_business_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a type from the catalogue, overridden for large sizes."""
    parts = table(spark, sf_dir, "part")
    vid = F.col("p_partkey").alias("vid")
    return business_type(parts.select(vid), parts.where("p_partkey % 5 <> 0").select(vid, F.col("p_type").alias("type")), parts.where("p_size > 40").select(vid, F.lit("Large").alias("type")))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's cheapest line, the first of equals."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("vid"), "l_extendedprice", "l_linenumber", "l_partkey")
    return first_by_rank(rows, "vid", "l_extendedprice", "l_linenumber")


ORACLES = {
    "affiliation_by_specialty": """with p as (select c_custkey as vid, c_mktsegment as s, case when n_nationkey % 3 = 0 then 'n' || n_nationkey when n_regionkey % 2 = 0 then 'r' || n_regionkey end as target from customer join nation on c_nationkey = n_nationkey)
select target, sum((s = 'BUILDING')::int) as building, sum((s = 'MACHINERY')::int) as machinery, sum((s not in ('BUILDING', 'MACHINERY'))::int) as other, count(*) as total from p where target is not null group by 1""",
    "org_business_type": "select p_partkey as vid, case when p_size > 40 then 'Large' when p_partkey % 5 <> 0 then p_type else 'Unknown' end as business_type from part",
    "first_lines": "select vid, l_extendedprice, l_linenumber, l_partkey from (select l_orderkey as vid, l_extendedprice, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber) as n from lineitem) where n = 1",
}
QUERIES = {f.__name__: f for f in (affiliation_by_specialty, org_business_type, first_lines)}
