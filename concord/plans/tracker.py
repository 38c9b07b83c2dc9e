"""The request tracker: incremental append, derived columns, service levels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import table

#: Reasons by note code: fixed values; codes not listed have none.
REASONS = {
    "[R-00015]": "Auto Rejections by System", "[R-10001]": "Missing/Unclear info.", "[R-10004]": "Failed validation", "[R-10050]": "Missing/Unclear info.", "[R-10053]": "Inheritance rule",
    "[R-10054]": "Request on wrong record", "[R-10055]": "Missing/Unclear info.", "[R-10056]": "Incorrect info/request", "[R-10057]": "Opted-out", "[R-10058]": "Out of OD scope", "[R-10060]": "Confusion on entity type",
    "[R-10061]": "Confusion on entity type", "[R-10064]": "Request on personal info.", "[R-10070]": "Future changes", "[R-10072]": "Failed validation",
}
SLA_HOURS = 24


def service_seconds(created: Column, completed: Column) -> Column:
    """Seconds from creation to completion; null if either does not parse or the time is negative."""
    s = F.unix_timestamp(F.try_to_timestamp(completed, F.lit("yyyy-MM-dd HH:mm:ss"))) - F.unix_timestamp(F.try_to_timestamp(created, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(s >= 0, s)


def clock(seconds: Column) -> Column:
    """``H:MM:SS``; empty for a null."""
    return F.when(seconds.isNull(), "").otherwise(F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60))


def hours_minutes(hours: Column) -> Column:
    return F.format_string("%dh %dm", hours.cast("int"), ((hours - hours.cast("int")) * 60).cast("int"))


def hours_of(text: Column) -> Column:
    """Hours of ``H:MM:SS``; null without a colon or with parts that are no numbers."""
    part = F.split(text, ":")
    number = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    return F.when(F.contains(text, F.lit(":")), number(0) + number(1) / 60 + number(2) / 3600)


def shown_source(source: Column, names: dict[str, str]) -> Column:
    """The client's name for a source, where it has one."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[source], source) if names else source


def note_code(note: Column) -> Column:
    """The last ``[X-NNNNN]``, or empty."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.coalesce(note, F.lit("")), F.lit(r"\[[A-Z]-\d{5}\]"), F.lit(0)), F.lit(-1)), F.lit(""))


def note_tail(note: Column, code: Column) -> Column:
    """What follows the last code; the whole note without one."""
    text = F.coalesce(note, F.lit(""))
    return F.trim(F.when(code == "", text).otherwise(F.regexp_extract(text, r"(?s).*\[[A-Z]-\d{5}\](.*)$", 1)))


def reason(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[code], F.lit("N/A"))


def derived(rows: DataFrame) -> DataFrame:
    """Tracker columns from created, completed (text), notes and source."""
    seconds = service_seconds(F.col("created"), F.col("completed"))
    code = note_code(F.col("notes"))
    return rows.withColumns({"service_seconds": seconds, "service_time": clock(seconds), "month": F.substring("created", 1, 7), "note_code": code, "reason": reason(code), "note_tail": note_tail(F.col("notes"), code), "weekday": F.coalesce(F.weekday(F.try_to_timestamp(F.substring("completed", 1, 10), F.lit("yyyy-MM-dd"))) < 5, F.lit(False))})


def append(master: DataFrame, daily: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The master and the daily rows whose id it does not hold; of an id's daily rows the first."""
    fresh = daily.join(master.select(key), key, "left_anti")
    columns = [c for c in master.columns]
    firsts = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in columns if c != key]), order).alias("r")).select(key, "r.*")
    return master.unionByName(firsts.select(columns))


def service_levels(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, shares, missed service levels and mean hours on weekdays by ``by``."""
    accepted, rejected = (F.sum((F.col("resolution") == x).cast("int")) for x in ("Accepted", "Rejected"))
    timed = F.col("weekday") & F.col("service_seconds").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), accepted.alias("accepted"), rejected.alias("rejected"), F.round(accepted * 100.0 / F.count("*"), 4).alias("accepted_pct"),
        F.sum(F.when(timed & (F.col("service_seconds") > SLA_HOURS * 3600), 1).otherwise(0)).alias("missed"), F.round(F.avg(F.when(timed, F.col("service_seconds") / 3600.0)), 6).alias("mean_hours"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: completed with the last shipment; status as resolution."""
    orders = table(spark, sf_dir, "orders")
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    joined = orders.join(last, orders.o_orderkey == last.l_orderkey, "left")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return derived(joined.select(
        F.expr("cast(o_orderkey as string)").alias("id"), F.col("o_orderkey").alias("seq"), stamp("o_orderdate").alias("created"), F.coalesce(stamp("shipped"), F.lit("")).alias("completed"),
        F.expr("case o_orderstatus when 'F' then 'Accepted' when 'O' then 'Rejected' else 'Pending' end").alias("resolution"),
        F.expr("concat('seen [A-10017] then [R-', lpad(cast(10050 + o_orderkey % 25 as string), 5, '0'), '] note ', o_orderkey % 7)").alias("notes"),
        F.expr("case o_custkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end").alias("source"), F.expr("if(o_custkey % 2 = 0, 'ADD_REQUEST', 'CHANGE_REQUEST')").alias("type"),
    ))


def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("id", "service_seconds", "service_time", "month", "note_code", "reason", "note_tail", "weekday")


def tracker_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before 1996 as the master; all orders, twice, as the daily report."""
    all_ = rows(spark, sf_dir).select("id", "seq", "created", "resolution")
    daily = all_.where("created >= '1995-06'").unionByName(all_.where("created >= '1995-06'").withColumn("seq", F.col("seq") + 10_000_000).withColumn("resolution", F.lit("again")))
    return append(all_.where("created < '1996'"), daily)


def tracker_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_levels(rows(spark, sf_dir), ["month"])


def tracker_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_levels(rows(spark, sf_dir).where("completed between '1995' and '1998'"), ["source"])


def tracker_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("resolution = 'Rejected' and reason <> 'N/A'").groupBy("reason").agg(F.count("*").alias("requests"))


def tracker_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients under their shown names with the mean service time, read back from its text, as hours and minutes."""
    done = rows(spark, sf_dir).where("weekday").withColumn("client", shown_source(F.col("source"), {"alpha": "Alpha Inc", "gamma": "Gamma AG"}))
    return done.groupBy("client").agg(F.round(F.avg(hours_of(F.col("service_time"))), 6).alias("mean_hours"), F.count("*").alias("requests")).withColumn("shown", hours_minutes(F.col("mean_hours")))


def tracker_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by request kind and resolution, with a total row."""
    is_add = F.col("type").contains("ADD")
    n = lambda add, res: F.sum((is_add if add else ~is_add).cast("int") * (F.col("resolution") == res).cast("int"))
    return rows(spark, sf_dir).rollup("source").agg(n(True, "Accepted").alias("add_accepted"), n(False, "Accepted").alias("change_accepted"), n(True, "Rejected").alias("add_rejected"), n(False, "Rejected").alias("change_rejected"), F.count("*").alias("total")).select(F.coalesce("source", F.lit("Total")).alias("client"), "add_accepted", "change_accepted", "add_rejected", "change_rejected", "total")


_CASE = "case code " + " ".join(f"when '{k}' then '{v}'" for k, v in REASONS.items()) + " else 'N/A' end"
_ROWS = f"""with base as (select o_orderkey::varchar as id, o_orderkey as seq, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as created, coalesce(strftime(shipped, '%Y-%m-%d %H:%M:%S'), '') as completed, o_orderdate, shipped,
 case o_orderstatus when 'F' then 'Accepted' when 'O' then 'Rejected' else 'Pending' end as resolution, '[R-' || lpad((10050 + o_orderkey % 25)::varchar, 5, '0') || ']' as code, 'note ' || (o_orderkey % 7) as note_tail,
 case o_custkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as source, o_custkey % 2 = 0 as is_add
 from orders left join (select l_orderkey, max(l_shipdate) as shipped from lineitem group by 1) on l_orderkey = o_orderkey),
t as (select *, case when epoch(shipped) - epoch(o_orderdate) >= 0 then (epoch(shipped) - epoch(o_orderdate))::bigint end as ss, coalesce(isodow(shipped) < 6, false) as weekday, {_CASE} as reason, created[1:7] as month from base)"""
_LEVELS = """count(*) as total, sum((resolution = 'Accepted')::int) as accepted, sum((resolution = 'Rejected')::int) as rejected, round(sum((resolution = 'Accepted')::int) * 100.0 / count(*), 4) as accepted_pct,
 sum(case when weekday and ss > 86400 then 1 else 0 end) as missed, round(avg(case when weekday and ss is not null then ss / 3600.0 end), 6) as mean_hours from t"""

ORACLES = {
    "tracker_rows": _ROWS + " select id, ss as service_seconds, case when ss is null then '' else (ss // 3600) || ':' || lpad(((ss // 60) % 60)::varchar, 2, '0') || ':' || lpad((ss % 60)::varchar, 2, '0') end as service_time, month, code as note_code, reason, note_tail, weekday from t",
    "tracker_append": _ROWS + " select id, seq, created, resolution from t",
    "tracker_sla": _ROWS + f" select month, {_LEVELS} group by month",
    "tracker_clients": _ROWS + f" select source, {_LEVELS} where completed between '1995' and '1998' group by source",
    "tracker_reasons": _ROWS + " select reason, count(*) as requests from t where resolution = 'Rejected' and reason <> 'N/A' group by reason",
    "tracker_pivot": _ROWS + " select coalesce(source, 'Total') as client, sum((is_add and resolution = 'Accepted')::int) as add_accepted, sum((not is_add and resolution = 'Accepted')::int) as change_accepted, sum((is_add and resolution = 'Rejected')::int) as add_rejected, sum((not is_add and resolution = 'Rejected')::int) as change_rejected, count(*) as total from t group by rollup(source)",
}
ORACLES["tracker_sources"] = _ROWS + """ select client, mean_hours, requests, floor(mean_hours)::int || 'h ' || floor((mean_hours - floor(mean_hours)) * 60)::int || 'm' as shown from (select case source when 'alpha' then 'Alpha Inc' when 'gamma' then 'Gamma AG' else source end as client, round(avg(ss / 3600.0), 6) as mean_hours, count(*) as requests from t where weekday group by 1)"""
QUERIES = {f.__name__: f for f in (tracker_rows, tracker_sources, tracker_append, tracker_sla, tracker_clients, tracker_reasons, tracker_pivot)}
