"""The reference concepts as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import table


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as organisations: brand is the city, size the postal area."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("9"), F.lpad(F.col("p_partkey").cast("string"), 17, "0")).alias("vid"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("city"), F.expr("cast(p_size div 10 as string)").alias("postal"), F.col("p_size").alias("size")
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, a row an order line: the segment is the last name, the nation the city, suppliers are affiliations."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = customers.join(orders, customers.c_custkey == orders.o_custkey).join(lines, orders.o_orderkey == lines.l_orderkey).join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey)
    return rows.select(
        F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 17, "0")).alias("vid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.expr("concat('n', c_custkey % 40)").alias("first_name"), F.col("c_mktsegment").alias("last_name"), F.col("n_name").alias("city_cda"), F.col("n_name").alias("city"),
        F.col("l_returnflag").alias("specialty_1"), F.expr("concat('h', l_suppkey)").alias("hco_vid"), F.expr("cast(100000 + l_suppkey as string)").alias("postal"),
        F.expr("cast(5550000000 + l_partkey div 4 as string)").alias("phone_1"), F.expr("concat('u', o_orderkey % 977, '@mail.example')").alias("email_1"),
        F.expr("if(l_linestatus = 'F', cast(l_suppkey as string), null)").alias("license_number"), F.lit("board").alias("license_body"), F.expr("if(l_returnflag = 'N', 'Active', 'Expired')").alias("license_status"),
        F.col("o_orderstatus").alias("status"),
    )
