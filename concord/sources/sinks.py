"""Writers: one folder a table, empty tables left out, ids as text, results dealt by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c).cast("string")) for c in ids if c in df.columns})


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Each non-empty table in a folder of its name; returns the names written."""
    done = []
    for name, df in tables.items():
        if df.isEmpty():
            continue
        writer = df.write.mode("overwrite")
        writer.csv(f"{folder}/{name}", header=True) if kind == "csv" else writer.parquet(f"{folder}/{name}")
        done.append(name)
    return done


def append_by_class(pairs: DataFrame, folder: str) -> None:
    """Incremental append, a folder a class."""
    pairs.write.mode("append").partitionBy("classification").parquet(folder)


def rules_sheet(df: DataFrame, cfg: dict) -> DataFrame:
    """Thresholds and weights as a table: section, name, value."""
    rows = [(section, str(k), str(v)) for section in ("person_auto", "person_review", "org_auto", "org_review") for k, v in cfg[section].items()]
    return df.sparkSession.createDataFrame(rows, "section string, name string, value string")


BUCKETS = 32


def _bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


def save_index(keys: DataFrame, canon: DataFrame, folder: str) -> None:
    """A reference index: records, and keys in folders by their hash."""
    canon.write.mode("overwrite").parquet(f"{folder}/records")
    keys.withColumn("b", _bucket()).repartition("b", F.xxhash64("vid") % 8).write.mode("overwrite").partitionBy("b").parquet(f"{folder}/keys")


def load_index(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Keys and records of an index, whole."""
    return spark.read.parquet(f"{folder}/keys").drop("b"), spark.read.parquet(f"{folder}/records")


def probe_index(spark, folder: str, probe: DataFrame) -> DataFrame:
    """Rows of the index with a key of ``probe`` (kind, key): only the folders that the probe's keys hash to are read."""
    wanted = [r["b"] for r in probe.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
    held = spark.read.parquet(f"{folder}/keys").where(F.col("b").isin(wanted)) if wanted else spark.read.parquet(f"{folder}/keys").limit(0)
    return held.drop("b").join(probe.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
