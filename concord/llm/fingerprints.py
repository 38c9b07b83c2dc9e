"""Operator 5: document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document's terms are its words, weighted by their counts.  For each sample, a term's hash gives
r, c ~ Gamma(2, 1) and beta ~ U(0, 1); with t = floor(ln w / r + beta) the term bids
ln a = ln c - r (t - beta + 1), and the lowest bid's (term, t) is the sample.  Two documents agree
on a sample with a probability equal to the generalised Jaccard similarity of their weights.

A bid and its (term, t) are packed into one long, so that a sample is a plain minimum, which Spark
aggregates in fixed-size buffers before and without any shuffle.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.session import cut, drop_cut, table

SAMPLES = 32
#: Keys (not texts) that a range of the key order is meant for.
RANGE_ROWS = 500_000
_SPACE = "[ \t\n\u000b\f\r]+"
_MASK = (1 << 21) - 1
_LOW = (1 << 32) - 1


@contextmanager
def _split_codegen(spark: SparkSession):
    """Whole-stage code puts all samples into one method, too long for the JIT; without it Spark splits them."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _salt(i: int) -> int:
    x = (i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
    return x - 2**64 if x >= 2**63 else x


def bids(term: Column, logs: list[Column], sample: int) -> list[Column]:
    """The packed bid of a term (its hash) in one sample, for each log weight."""
    x = F.xxhash64(term.bitwiseXOR(F.lit(_salt(2 * sample))))
    y = F.xxhash64(term.bitwiseXOR(F.lit(_salt(2 * sample + 1))))
    unit = lambda h, shift: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_MASK)) + F.lit(0.5)) / F.lit(float(1 << 21))
    r = -F.log(unit(x, 0) * unit(x, 21))
    log_c = F.log(-F.log(unit(y, 0) * unit(y, 21)))
    beta = unit(x, 42)
    out = []
    for log in logs:
        t = F.floor(log / r + beta)
        bid = log_c - r * (t - beta + F.lit(1.0))
        high = F.shiftleft(F.floor((bid + F.lit(64.0)) * F.lit(float(1 << 24))).cast("long"), 32)
        out.append(high.bitwiseOR(F.shiftrightunsigned(y, 24).bitwiseXOR(t.cast("long")).bitwiseAND(F.lit(_LOW))))
    return out


def words(text: Column) -> Column:
    return F.split(text, _SPACE)


def _samples(terms: DataFrame, by: list[str], weights: list[str], samples: int) -> DataFrame:
    """``terms``: by, _term (hash) and weights; for each weight and sample the least bid."""
    logs = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))) for w in weights]
    made = []
    for k in range(samples):
        for i, bid in enumerate(bids(F.col("_term"), logs, k)):
            made.append(bid.alias(f"s{i}_{k}"))
    names = [f"s{i}_{k}" for i in range(len(weights)) for k in range(samples)]
    return terms.select(*by, *made).groupBy(*by).agg(*[F.min(n).alias(n) for n in names])


def _hex(side: int, samples: int) -> Column:
    """Samples as text, eight digits each; without terms the empty text."""
    parts = [F.lpad(F.lower(F.hex(F.col(f"s{side}_{k}").bitwiseAND(F.lit(_LOW)))), 8, "0") for k in range(samples)]
    return F.when(F.col(f"s{side}_0").isNull(), F.lit("")).otherwise(F.concat(*parts))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two empty fingerprints are alike, one is not like any other."""
    same = sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples)) / F.lit(float(samples))
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(same)


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``(key, fingerprint)`` for every key; texts of repeated keys count together, null as empty."""
    base = df.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    terms = base.select("_key", F.explode(words(F.col("_text"))).alias("_word")).where("_word <> ''").groupBy("_key", F.xxhash64("_word").alias("_term")).agg(F.count("*").alias("_w0"))
    with _split_codegen(df.sparkSession):
        found = cut(_samples(terms, ["_key"], ["_w0"], samples), "samples")
    marks = found.select("_key", _hex(0, samples).alias("fingerprint"))
    keys = base.select("_key").distinct().join(marks, ["_key"], "left")
    return keys.select(F.col("_key").alias(key), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


_OWN = ["_null", "_key", "_h"]


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """Text, its hash and its key; a null key is told by ``_null``, so that keys join by plain equality."""
    kind = df.schema[key].dataType
    none = F.lit("" if isinstance(kind, T.StringType) else "1970-01-01" if isinstance(kind, T.DateType | T.TimestampType) else 0).cast(kind)
    rows = df.select(F.col(key).isNull().alias("_null"), F.coalesce(F.col(key), none).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    return rows.withColumn("_h", F.xxhash64("_text"))


def order_of(named: DataFrame) -> DataFrame:
    """Each distinct key and text hash with its rows, characters and the one that follows: no text is moved.

    Columns: _OWN, c (rows), n (characters), next (a struct of _OWN).  Equal keys come in the order of
    their texts' hashes, null keys first; after the last comes the first.  The keys are dealt into
    ranges by Spark's sampling; within a range the follower is a window function, and the last key
    takes the first of the next range.
    """
    light = cut(named.groupBy(*_OWN).agg(F.count("*").alias("c"), F.first(F.length("_text").cast("long")).alias("n")), "keys")
    ranges = max(1, light.count() // RANGE_ROWS)
    by = [F.col("_null").desc(), F.col("_key"), F.col("_h")]
    dealt = cut(light.repartitionByRange(ranges, *by).withColumn("b", F.spark_partition_id()), "order") if ranges > 1 else light.withColumn("b", F.lit(0))
    inside = dealt.withColumn("_next", F.lead(F.struct(*_OWN)).over(Window.partitionBy("b").orderBy(*by)))
    # a row a range: the first of each, and beside it the first of the range that follows
    heads = dealt.groupBy("b").agg(F.min_by(F.struct(*_OWN), F.struct(~F.col("_null"), "_key", "_h")).alias("head"))
    turn = Window.orderBy("b")
    heads = heads.select("b", F.coalesce(F.lead("head").over(turn), F.first("head").over(turn)).alias("_then"))
    return inside.join(F.broadcast(heads), "b").select(*_OWN, "c", "n", F.coalesce("_next", "_then").alias("next"))


def compare_with_edited(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likenesses.

    A null text counts as empty; the fingerprint of a text without words is empty.  Rows with equal
    keys follow each other in the order of their texts' hashes, null keys come first; of equal rows
    all but the last have themselves as the next.  Other columns of ``df`` are left out.  Texts are
    shuffled once, by key; the next text sends only the characters that are asked of it.
    """
    named = _named(df, key, text)
    order = cut(order_of(named), "next")
    texts = named.groupBy(*_OWN).agg(F.first("_text").alias("_text"))
    asked = order.select("next.*", F.struct(*_OWN).alias("_by"), F.floor(F.col("n") / 4).cast("int").alias("_chars"))
    sent = texts.join(asked, _OWN).select("_by.*", F.left("_text", F.col("_chars")).alias("_piece"))
    placed = texts.join(order, _OWN).join(sent, _OWN)
    # a row that occurs more than once also stands for those that precede itself
    before = F.struct((F.col("c") - 1).alias("times"), F.left("_text", F.floor(F.col("n") / 4).cast("int")).alias("piece"), F.struct(*_OWN).alias("next"))
    after = F.struct(F.lit(1).cast("long").alias("times"), F.col("_piece").alias("piece"), F.col("next").alias("next"))
    kinds = placed.select(*_OWN, "_text", "n", F.explode(F.when(F.col("c") > 1, F.array(after, before)).otherwise(F.array(after))).alias("k"))
    edited = F.concat(F.expr("left(_text, cast(n as int) - cast(floor(n / 4) as int))"), F.col("k.piece"))
    base = kinds.select(*_OWN, "n", "k.times", "k.next", "_text", edited.alias("_edited")).withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
    row = [*_OWN, "times"]
    both = base.select(*row, F.expr("stack(2, 0, _text, 1, _edited) as (_side, _body)"))
    each = both.select(*row, "_side", F.explode(words(F.col("_body"))).alias("_word"))
    # an empty word weighs nothing, but keeps a text without words among the rows
    weight = lambda side: F.sum(((F.col("_side") == side) & (F.col("_word") != "")).cast("long"))
    terms = each.groupBy(*row, F.xxhash64("_word").alias("_term")).agg(weight(0).alias("_w0"), weight(1).alias("_w1"))
    with _split_codegen(df.sparkSession):
        marks = _samples(terms, row, ["_w0", "_w1"], samples)
        found = cut(base.select(*row, "n", "next", "_sha").join(marks, row).select(*row, "n", "next", "_sha", _hex(0, samples).alias("fingerprint"), _hex(1, samples).alias("edited_fingerprint")), "marks")
    drop_cut(order)
    beside = found.select(F.struct(*_OWN).alias("next"), F.col("fingerprint").alias("_beside")).dropDuplicates(["next"])
    out = found.join(beside, "next", "left").withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(F.when(~F.col("_null"), F.col("_key")).alias(key), F.col("n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_beside"), samples).alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edited(table(spark, sf_dir, "documents"))
