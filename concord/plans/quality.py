"""Quality checks of a master: licences, affiliations, candidates and status, and id safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.plans import tables
from concord.session import table


def _counted(df: DataFrame, good, to: str) -> DataFrame:
    """Rows that are ``good`` by id, and the names of each id's first row: one aggregate."""
    out = df.groupBy("vid").agg(F.sum(good.cast("int")).alias(to), F.min_by(F.struct("first_name", "last_name"), "seq").alias("n"))
    return out.select("vid", to, "n.first_name", "n.last_name")


def active_licences(df: DataFrame) -> DataFrame:
    """Rows with an active licence and a number other than blank or 0, by id."""
    number = F.trim(F.coalesce("license_number", F.lit("")))
    return _counted(df, (F.coalesce("license_status", F.lit("")) == "Active") & ~number.isin("", "0"), "active_licences")


def active_affiliations(df: DataFrame) -> DataFrame:
    """Rows with a parent that is not inactive, by id."""
    return _counted(df, (F.trim(F.coalesce("hco_vid", F.lit(""))) != "") & (F.coalesce("hco_status", F.lit("")) != "Inactive"), "active_affiliations")


def candidates(df: DataFrame, flag: str = "candidate") -> DataFrame:
    """The first flagged row of each id."""
    flagged = df.where(F.upper(F.trim(F.col(flag).cast("string"))).isin("TRUE", "1"))
    return flagged.groupBy("vid").agg(F.min_by(F.struct("first_name", "last_name"), "seq").alias("n")).select("vid", "n.*")


def not_active(df: DataFrame) -> DataFrame:
    """Ids whose first row has a status other than Active."""
    first = df.groupBy("vid").agg(F.min_by(F.struct(F.trim(F.coalesce("status", F.lit(""))).alias("status")), "seq").alias("r")).select("vid", "r.status")
    return first.where("status <> 'Active'")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.persons(spark, sf_dir)
    return rows.withColumn("hco_status", F.expr("if(specialty_1 = 'R', 'Inactive', 'Active')")).withColumn("candidate", F.expr("if(seq % 17 = 0, 'true ', '0')")).withColumn("status", F.expr("if(status = 'F', 'Active', status)"))


def quality_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_licences(_rows(spark, sf_dir))


def quality_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_affiliations(_rows(spark, sf_dir))


def quality_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_rows(spark, sf_dir))


def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_active(_rows(spark, sf_dir))


def id_shield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys of growing length as ids: which would a spreadsheet spoil."""
    ids = table(spark, sf_dir, "orders").select(F.expr("case o_orderkey % 3 when 0 then concat('9', lpad(cast(o_orderkey as string), 17, '0')) when 1 then concat(' ', o_orderkey, ' ') else concat(o_orderkey, '.5E+17') end").alias("raw"))
    return ids.select(X.id_text(F.col("raw")).alias("id"), X.id_at_risk(F.col("raw")).alias("at_risk"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions over whole documents and over parts' names; ``sound`` has the code of every word of a document."""
    words = F.split("text", "[^\\p{L}]+")
    # a separator at either end leaves an empty piece; a text without letters keeps one
    words = F.coalesce(F.when(F.size(F.filter(words, lambda w: w != "")) > 0, F.filter(words, lambda w: w != "")), F.slice(words, 1, 1))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("x"), words.alias("w"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit(" Hospital - "), "p_brand").alias("x"), F.array("p_name").alias("w"))
    rows = docs.unionByName(parts)
    x = F.col("x")
    return rows.select(
        "id", X.norm_text(x).alias("norm"), F.length(X.digits(x)).alias("n_digits"), X.norm_phone(x).alias("phone"), X.norm_license(F.when(F.startswith("id", F.lit("p")), F.left(x, F.lit(12)))).alias("licence"), F.array_join(F.transform("w", X.soundex_flat), " ").alias("sound"),
        X.norm_text(X.before_locality(x)).alias("stripped"), X.core_org_name(X.norm_text(X.before_locality(x))).alias("core"), X.acronym(X.norm_text(x)).alias("acronym"),
    )


_RAW = """raw as (select '9' || lpad(c_custkey::varchar, 17, '0') as vid, l_orderkey * 10 + l_linenumber as seq, 'n' || (c_custkey % 40) as first_name, c_mktsegment as last_name, l_linestatus = 'F' and l_suppkey <> 0 as numbered, l_returnflag as flag, case when o_orderstatus = 'F' then 'Active' else o_orderstatus end as status
 from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey)"""
_SOUND = "regexp_replace(translate(w, 'bfpvcgjkqsxzdtlmnraeiouhwy', '111122222222334556'), '[^1-6]', '', 'g')"
for _i in range(1, 7):
    _SOUND = f"regexp_replace({_SOUND}, '{_i}+', '{_i}', 'g')"
_NORM = "trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"
_GENERIC = "|".join(sorted(X.GENERIC, key=len, reverse=True))
_HEADS = "|".join(h.replace(".", "\\.") for h in X.HONORIFICS if " " not in h)
_STOP = ", ".join(f"'{w}'" for w in X.ACRONYM_STOP)

ORACLES = {
    "quality_licences": f"with {_RAW} select vid, sum((flag = 'N' and numbered)::int) as active_licences, min(first_name) as first_name, min(last_name) as last_name from raw group by vid",
    "quality_affiliations": f"with {_RAW} select vid, sum((flag <> 'R')::int) as active_affiliations, min(first_name) as first_name, min(last_name) as last_name from raw group by vid",
    "quality_candidates": f"with {_RAW} select distinct vid, first_name, last_name from raw where seq % 17 = 0",
    "quality_status": f"with {_RAW} select vid, arg_min(status, seq) as status from raw group by vid having arg_min(status, seq) <> 'Active'",
    "id_shield": "select trim(raw) as id, length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 15 or regexp_matches(raw, '[eE]\\+') as at_risk from (select case o_orderkey % 3 when 0 then '9' || lpad(o_orderkey::varchar, 17, '0') when 1 then ' ' || o_orderkey || ' ' else o_orderkey || '.5E+17' end as raw from orders)",
    "text_functions": f"""with rows_ as (select 'd' || doc_id as id, text as x, case when len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}]+'), lambda q: q <> '')) > 0 then list_filter(regexp_split_to_array(text, '[^\\p{{L}}]+'), lambda q: q <> '') when text is not null then [''] end as ws from documents union all select 'p' || p_partkey, p_name || ' Hospital - ' || p_brand, [p_name] from part),
r as (select *, list_transform(ws, lambda q: regexp_replace(lower(q), '[^a-z]', '', 'g')) as clean, regexp_replace(x, '[^0-9]', '', 'g') as d, {_NORM.format(x="x")} as norm, {_NORM.format(x="split_part(x, ' - ', 1)")} as stripped from rows_)
select id, norm, length(d)::int as n_digits, case when length(d) >= 7 then right(d, 10) end as phone, case when id[1] = 'p' then nullif(regexp_replace(upper(left(x, 12)), '[\\s\\-_/.]', '', 'g'), '') end as licence,
 array_to_string(list_transform(clean, lambda w: case when w = '' then 'Z000' else rpad(upper(w[1]) || substr({_SOUND}, case when regexp_matches(w, '^[aeiouhwy]') then 1 else 2 end, 3), 4, '0') end), ' ') as sound, stripped,
 trim(regexp_replace(trim(regexp_replace(stripped, '^({_HEADS})(\\s+|$)', '')), '((^|\\s+)({_GENERIC}))+$', '')) as core,
 array_to_string(list_transform(list_filter(string_split(norm, ' '), lambda q: length(q) > 1 and q not in ({_STOP})), lambda q: q[1]), '') as acronym from r""",
}
QUERIES = {f.__name__: f for f in (quality_licences, quality_affiliations, quality_candidates, quality_status, id_shield, text_functions)}
