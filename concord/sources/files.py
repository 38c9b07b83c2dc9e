"""Readers: text tables whose header may stand anywhere near the top, zipped tables, the newest file."""

from __future__ import annotations

import csv
import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that count as missing: fixed values.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PREVIEW = 15


def read_text_table(spark: SparkSession, path: str, missing: list[str] | None = None) -> DataFrame:
    """A CSV with every column as text; ids keep all digits.  ``missing`` texts become null."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    gone = MISSING if missing is None else missing
    return df.select(*[F.when(~F.col(f"`{c}`").isin(gone), F.col(f"`{c}`")).alias(c) for c in df.columns])


#: A header holds a Latin letter and has 2 to 79 characters.
_HEADER = re.compile(r"(?s)(?=.*[A-Za-z]).{2,79}")


def _headed(cells: list[str]) -> int:
    return sum(_HEADER.fullmatch((cell or "").strip()) is not None for cell in cells)


def header_row(lines: list[str]) -> int:
    """The first of the rows with the most cells that look like headers."""
    scores = [_headed(next(csv.reader([line]), [])) for line in lines[:PREVIEW]]
    return max(range(len(scores)), key=lambda i: (scores[i], -i), default=0)


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_with_header(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A CSV whose header is one of the first rows; rows and columns without any value are dropped."""
    lines = [r.value for r in spark.read.text(path).limit(PREVIEW).collect()]
    at = header_row(lines)
    names = next(csv.reader([lines[at]]), []) if lines else []
    kept = unique_names([n.strip() or f"Unnamed: {i}" for i, n in enumerate(names)])
    rows = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id())
    body = rows.where(F.col("_i") > at) if len(lines) > at + 1 else rows.limit(0)
    schema = ", ".join(f"`{n}` string" for n in kept)
    df = body.select(F.from_csv("value", schema).alias("r")).select("r.*")
    df = df.where(F.coalesce(*[F.col(f"`{n}`") for n in kept]).isNotNull())
    filled = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in kept]).first().asDict()
    return df.select(*[F.col(f"`{n}`") for n in kept if filled[n] and not n.startswith("Unnamed")]), at


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The first CSV member of a zip file, as text columns."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(".csv"))
        rows = list(csv.reader(io.TextIOWrapper(z.open(name), encoding="utf-8")))
    names = unique_names(rows[0])
    return spark.createDataFrame([tuple(r[: len(names)] + [None] * (len(names) - len(r))) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Path of the file changed last."""
    row = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").first()
    return row["path"] if row else None
