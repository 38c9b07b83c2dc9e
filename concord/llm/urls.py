"""Operator 3: URL verdicts by rules and, beyond them, gradient-boosted trees on lexical features.

The URLs that a rule judges are the labelled ones; the trees are trained on a bounded sample of them
and judge the rest.  Features come from the URL's text by built-in expressions: lengths, depth,
ratios, character entropy, parameter counts, and how often labelled URLs with the same host suffix
were blocked, smoothed.  Those statistics cover all labelled rows; a row that the trees learn from has
them from the other folds only, so that they do not tell it its own label.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import cut, table

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs of each verdict that the trees learn from, at most; the lowest hashes are taken.
MAX_TRAIN = 10_000
TREES, DEPTH = 12, 4
#: Weight of the overall share in a suffix's block rate.
SMOOTH = 5.0
#: Folds by the URL's hash; a learning row's statistics leave its own fold out.
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = _LOWER + "0123456789" + "-._/?=&%:#~+"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://`` or for a null."""
    text = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, shape, 1), _UPPER, _LOWER), F.regexp_extract(text, shape, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null where none fits); of equally long ones the first in text order.

    A rule ``host/prefix`` fits that host and its subdomains, where the path begins with ``/prefix``.
    """
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, _, rest = rule.partition("/")
        name = name.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == F.lit(name)) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL's text."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda of, symbol: (F.length(of) - F.length(F.replace(of, F.lit(symbol), F.lit("")))).cast("double")
    plain = F.translate(text, _UPPER, _LOWER)
    shares = [count(plain, s) / n for s in _SYMBOLS]
    terms = [F.when(s > 0, -s * F.log2(s)).otherwise(F.lit(0.0)) for s in shares]
    # the few characters that are no symbol, each by its own share
    rest = F.translate(plain, _SYMBOLS, "")
    others = F.filter(F.array_distinct(F.split(rest, "")), lambda c: c != "")
    beyond = F.aggregate(others, F.lit(0.0), lambda acc, c: acc - ((F.length(rest) - F.length(F.replace(rest, c, F.lit("")))) / n) * F.log2((F.length(rest) - F.length(F.replace(rest, c, F.lit("")))) / n))
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double")
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "digit_ratio": digits / n,
        "hyphens": count(text, "-"),
        "entropy": sum(terms[1:], terms[0]) + F.when(rest == "", F.lit(0.0)).otherwise(beyond),
        "parameters": F.when(F.contains(text, F.lit("?")), count(text, "&") + 1).otherwise(F.lit(0.0)),
        "assignments": count(text, "="),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
        "secure": F.startswith(plain, F.lit("https")).cast("double"),
        "first_segment": F.length(F.regexp_extract(path, "^/([^/]*)", 1)).cast("double"),
    }


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(17)), F.lit(FOLDS))


def _rate(blocked: Column, rows: Column, overall: Column) -> tuple[Column, Column]:
    """Smoothed block rate of a suffix, and how well it is known."""
    n = F.greatest(F.coalesce(rows, F.lit(0)), F.lit(0)).cast("double")
    return (F.coalesce(blocked, F.lit(0.0)) + F.lit(SMOOTH) * overall) / (n + F.lit(SMOOTH)), F.log1p(n)


def with_rates(rows: DataFrame, labelled: DataFrame, suffixes: list[str], out_of_fold: bool) -> DataFrame:
    """Add ``<suffix>_rate`` and ``<suffix>_known`` from all labelled rows, or from those of the other folds."""
    # one number for all rows, so that it tells no label
    overall = F.lit(labelled.agg(F.coalesce(F.avg("_block"), F.lit(0.5))).first()[0])
    rows = rows.withColumn("_fold", _fold(F.col("_url")))
    for by in suffixes:
        known = labelled.where(F.col(by).isNotNull())
        rows = rows.join(known.groupBy(by).agg(F.sum("_block").alias("_b"), F.count("*").alias("_n")), by, "left")
        if out_of_fold:
            rows = rows.join(known.groupBy(by, _fold(F.col("_url")).alias("_fold")).agg(F.sum("_block").alias("_ob"), F.count("*").alias("_on")), [by, "_fold"], "left")
            rows = rows.withColumns({"_b": F.col("_b") - F.coalesce("_ob", F.lit(0.0)), "_n": F.col("_n") - F.coalesce("_on", F.lit(0))}).drop("_ob", "_on")
        rate, known_ = _rate(F.col("_b"), F.col("_n"), overall)
        rows = rows.withColumns({f"{by}_rate": rate, f"{by}_known": known_}).drop("_b", "_n")
    return rows.drop("_fold")


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (null where a rule judges).

    Without labelled URLs of both kinds every other URL gets the one verdict there is, or ``allow``.
    Null URLs and such without ``://`` have an empty host and path and are judged by the trees.
    Columns of these names are replaced.  Repeated rows are judged alike, each in its own row; an empty
    table gives an empty result.
    """
    host, path = host_path(F.col("_url"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    keep = [c for c in df.columns if c not in {"host", "path", "rule", "verdict", "block_score"}]
    rows = df.select(F.struct(*keep).alias("_row"), F.col(url).alias("_url")).withColumns({"_host": host, "_path": path})
    rows = rows.withColumn("_rule", rule).withColumn("_said", verdict).withColumn("_block", F.when(F.col("_said").isNotNull(), (F.col("_said") == BLOCK).cast("double")))
    rows = rows.withColumn("tld", F.substring_index("_host", ".", -1)).withColumn("site", F.substring_index("_host", ".", -2)).withColumn("section", F.regexp_extract("_path", "^/([^/]*)/", 1))
    out = lambda said, score: [*[F.col("_row").getField(c).alias(c) for c in keep], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), said.alias("verdict"), score.alias("block_score")]
    labelled = rows.where("_said is not null").select("_url", "_host", "_path", "tld", "site", "section", "_block")
    kinds = {r["_block"] for r in labelled.select("_block").distinct().collect()}
    if len(kinds) < 2:
        only = BLOCK if kinds == {1.0} else ALLOW
        return rows.select(*out(F.coalesce("_said", F.lit(only)), F.lit(None).cast("double")))
    suffixes = ["tld", "site", "section"]
    labelled = cut(labelled, "labelled")
    names = [*lexical(F.col("_url"), F.col("_host"), F.col("_path")), *[f"{by}_{x}" for by in suffixes for x in ("rate", "known")]]

    def featured(frame: DataFrame, learning: bool) -> DataFrame:
        frame = with_rates(frame, labelled, suffixes, learning)
        return VectorAssembler(inputCols=names, outputCol="_features").transform(frame.withColumns(lexical(F.col("_url"), F.col("_host"), F.col("_path"))))

    few = None
    for kind in (0.0, 1.0):
        own = labelled.where(F.col("_block") == kind).orderBy(F.xxhash64("_url"), "_url").limit(MAX_TRAIN)
        few = own if few is None else few.unionByName(own)
    sample = cut(featured(few, True).select("_features", "_block"), "sample").coalesce(2)
    model = GBTClassifier(featuresCol="_features", labelCol="_block", predictionCol="_predicted", maxIter=TREES, maxDepth=DEPTH, seed=7).setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(sample)
    rest = model.transform(featured(rows.where("_said is null"), False)).withColumn("_score", vector_to_array("_probability")[1])
    judged = rest.select(*out(F.when(F.col("_score") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW)), F.col("_score")))
    return judged.unionByName(rows.where("_said is not null").select(*out(F.col("_said"), F.lit(None).cast("double"))))


#: The rules that the query judges by.
RULES = [("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK)]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")
