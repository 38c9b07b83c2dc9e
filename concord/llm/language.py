"""Operator 6: language identification by compression against raw-content zstandard dictionaries.

Each language has a dictionary of sample text.  A text is lower-cased and compressed, piece by
piece, with every language's dictionary; the smallest total wins.  Pieces keep the dictionary near
at hand: late in one long frame a text is mostly compressed against itself.  The score is the
winner's share when sizes in bits are taken as log likelihoods at temperature ``TEMPERATURE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.folds import fold
from concord.session import cut, drop_cut, table

#: Bounds of the sample that dictionaries are made from: distinct texts a language, and bytes a dictionary,
#: which the texts share evenly; what short ones leave is the longer ones'.
SAMPLE_TEXTS, DICTIONARY = 256, 112_000
PIECE, LEVEL = 2000, 11
TEMPERATURE = 64.0
#: Calibration: lengths in bytes from which margins are set apart, texts a length needs, share of the low quantile, and what of it is the margin.
LENGTHS, LEAST, QUANTILE, RELAXED = (0, 64, 256, 1024, 4096), 50, 0.02, 0.5
#: Bins of a pass of ``quantiles``.
BINS = 1024
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; digits, superscripts and fractions are not."""
    return any(c.isalpha() for c in text)


def shares(sizes: list[int], total: int) -> list[int]:
    """How much of each of the texts is taken: all alike, but that what short ones leave goes to the longer ones."""
    out, left = [0] * len(sizes), total
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - rank))
        left -= out[i]
    return out


def order(text: str = "text") -> Column:
    """The hash that texts are chosen by, and known by once chosen."""
    return F.xxhash64(text, F.lit(11))


def choose(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict[int, bytes]]:
    """For each non-null ``lang`` the ``SAMPLE_TEXTS`` distinct texts of least hash, what a dictionary takes of each by that hash.

    Of each text a run of characters is taken that begins at a place given by its hash.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and text <> ''").withColumn("_order", order())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("_order", 0.02).alias("n")).collect()}  # a row a language
    if not counts:
        return {}
    # the share of distinct texts that holds twice the sample, so that only few are ranked
    part = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(int(min(1.0, (2 * SAMPLE_TEXTS + 64) / max(1, n)) * 1_000_000)))])
    most = DICTIONARY // 8
    begin = F.pmod(F.xxhash64("text", F.lit(12)), F.greatest(F.length("text") - F.lit(most) + 1, F.lit(1))).cast("int") + 1
    few = rows.where(F.pmod("_order", F.lit(1_000_000)) < part[F.col("lang")]).select("lang", "_order", F.substr("text", begin, F.lit(most)).alias("text"))
    few = few.groupBy("lang", "_order").agg(F.min("text").alias("text"))  # copies count once
    chosen = few.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order"))).where(F.col("_rank") <= SAMPLE_TEXTS)
    found: dict[str, dict[int, bytes]] = {}
    for r in sorted(chosen.select("lang", "_order", "_rank", "text").collect(), key=lambda r: (r["lang"], r["_rank"])):  # SAMPLE_TEXTS a language
        found.setdefault(r["lang"], {})[r["_order"]] = r["text"].lower().encode()
    return {name: {at: t[:n] for (at, t), n in zip(texts.items(), shares([len(t) for t in texts.values()], DICTIONARY), strict=True)} for name, texts in sorted(found.items())}


def joined(chosen: dict[str, dict[int, bytes]]) -> dict[str, bytes]:
    """The dictionaries of the chosen texts."""
    return {name: b"\n".join(texts.values()) for name, texts in chosen.items()}


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each non-null ``lang``, from the texts that ``choose`` finds."""
    return joined(choose(labelled, text, lang))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.models = []
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.models.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def classify(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, margin (bytes saved over the second best, as a share of the best) and the text's bytes."""
        data = (text or "").lower().encode()
        if not self.models or not has_letter(text or ""):
            return UNKNOWN, 0.0, 0.0, len(data)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = {name: sum(len(c.compress(p)) for p in pieces) for name, c in self.models}
        ranked = sorted(sizes, key=lambda name: (sizes[name], name))
        least = sizes[ranked[0]]
        total = sum(2.0 ** (-8.0 * (n - least) / TEMPERATURE) for n in sizes.values())
        second = sizes[ranked[1]] if len(ranked) > 1 else 2 * least
        return ranked[0], 1.0 / total, (second - least) / max(1.0, least), len(data)

    def without(self, chosen: dict[str, dict[int, bytes]], at: int) -> "Classifier":
        """This classifier, but with dictionaries that lack the text of hash ``at``; a language with no other text is unknown to it."""
        less = {name: {k: t for k, t in texts.items() if k != at} for name, texts in chosen.items() if at in texts}
        out = Classifier(joined({name: texts for name, texts in less.items() if texts}))
        out.models += [m for m in self.models if m[0] not in less]
        return out


def judge(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns) and every whole text's ``lang_pred``, ``score``, ``_margin`` and ``_bytes``; columns of those names are replaced."""
    made = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("_margin", T.DoubleType(), pa.float64()), ("_bytes", T.LongType(), pa.int64())]
    keep = [c for c in (df.columns if keep is None else keep) if c not in {m[0] for m in made}]
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for batch in batches:
            out = [model.classify(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array([x[i] for x in out], m[2]) for i, m in enumerate(made))], names=[*keep, *(m[0] for m in made)])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in made)]))


def by_length(values: list[tuple[int, float]]) -> Column:
    """Of ``(least bytes, value)`` the value for ``_bytes``."""
    found = F.lit(0.0)
    for low, value in sorted(values):
        found = F.when(F.col("_bytes") >= low, F.lit(value)).otherwise(found)
    return found


def apart(labelled: DataFrame, chosen: dict[str, dict[int, bytes]]) -> DataFrame:
    """The labelled rows (``text``, ``lang``, ``_order``) whose texts are in a dictionary, judged by dictionaries without their text.

    ``_bytes``, ``_margin`` and the number ``n`` of rows for each such text, SAMPLE_TEXTS a language at most, that is judged rightly.
    """
    rows = labelled.groupBy("lang", "_order").agg(F.min("text").alias("text"), F.count("*").alias("n")).repartition(8 * len(chosen))  # small, but some 10 ms each
    sent = labelled.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Classifier(joined(sent.value))
        for batch in batches:
            found = [(x[3], x[2], r["n"]) for r in batch.to_pylist() if (x := whole.without(sent.value, r["_order"]).classify(r["text"]))[1] > 0 and x[0] == r["lang"]]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["_bytes", "_margin", "n"])

    return rows.mapInArrow(run, "_bytes long, _margin double, n long")


def quantiles(rows: DataFrame, share: float, least: int) -> dict[int, float]:
    """For each ``at`` with ``least`` rows the value of ``_margin`` at rank ``int(share * rows)``, exactly; a row stands for ``n``.

    Rows are counted in bins, then in bins of the bin that has the rank, until that holds one value: at most
    BINS counts an ``at`` are collected a pass.
    """
    facts = [F.sum("n").alias("n"), F.min("_margin").alias("low"), F.max("_margin").alias("high")]
    spans = {r["at"]: (r["low"], r["high"], int(share * r["n"])) for r in rows.groupBy("at").agg(*facts).collect() if r["n"] >= least}
    out = {}
    while spans:
        out |= {at: low for at, (low, high, _) in spans.items() if low == high}
        spans = {at: span for at, span in spans.items() if at not in out}
        place = F.lit(None).cast("int")
        for at, (low, high, _) in spans.items():
            here = (F.col("at") == at) & F.col("_margin").between(low, high)
            place = F.when(here, F.least(F.floor((F.col("_margin") - low) * (BINS / (high - low))), F.lit(BINS - 1)).cast("int")).otherwise(place)
        counts = rows.withColumn("_bin", place).where("_bin is not null").groupBy("at", "_bin").agg(*facts).collect() if spans else []
        for at, (_, _, rank) in spans.items():
            for r in sorted((r for r in counts if r["at"] == at), key=lambda r: r["_bin"]):
                if rank < r["n"]:
                    spans[at] = (r["low"], r["high"], rank)
                    break
                rank -= r["n"]
    return out


def margins(judged: DataFrame, labelled: DataFrame, chosen: dict[str, dict[int, bytes]], text: str = "text", lang: str = "lang") -> list[tuple[int, float]]:
    """Margins by length, ``(least bytes, margin)``: RELAXED times the low quantile of all rightly judged rows.

    ``judged``: the rows of ``labelled`` as ``judge`` finds them with the dictionaries of ``chosen``, with ``lang`` and ``_order``.
    Those whose text is in a dictionary are judged again without it.  A length with few rows takes the next shorter one's.
    """
    spark = judged.sparkSession
    if not chosen:
        return [(low, 0.0) for low in LENGTHS]
    held = F.broadcast(spark.createDataFrame([(at,) for at in sorted({at for texts in chosen.values() for at in texts})], "_order long"))
    own = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), order(text).alias("_order")).where("text is not null and lang is not null")
    right = judged.where((F.col(lang) == F.col("lang_pred")) & (F.col("score") > 0)).join(held, "_order", "left_anti").select("_bytes", "_margin", F.lit(1).cast("long").alias("n"))
    again = cut(apart(own.join(held, "_order", "left_semi"), chosen), "apart")
    found = quantiles(right.unionByName(again).select(by_length([(low, low) for low in LENGTHS]).cast("int").alias("at"), "_margin", "n"), QUANTILE, LEAST)
    drop_cut(again)
    out, margin = [], 0.0
    for low in LENGTHS:
        margin = RELAXED * found[low] if low in found else margin
        out.append((low, margin))
    return out


def calibrate(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[int, float]]:
    """Margins by length, ``(least bytes, margin)``, for texts in no learned language, from all of ``labelled``; see ``margins``."""
    chosen = choose(labelled, text, lang)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), order(text).alias("_order"))
    judged = cut(judge(rows, joined(chosen), keep=["lang", "_order"]), "judged")
    found = margins(judged, rows, chosen)
    drop_cut(judged)
    return found


def reject(judged: DataFrame, margin: float | list[tuple[int, float]]) -> DataFrame:
    """What ``judge`` gives, with ``rejected`` for its margin."""
    limits = margin if isinstance(margin, list) else [(0, margin)]
    return judged.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("_margin") < by_length(limits))).drop("_margin", "_bytes")


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float | list[tuple[int, float]] = 0.0) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` for every whole text.

    A null text, or one without a letter, is ``und``, score 0, and rejected; so is every text where
    nothing was learned.  Others are rejected when their margin is below ``margin``, a number or the
    margins by length that ``calibrate`` gives.  Columns of those
    names are replaced, and columns ``_margin`` and ``_bytes`` lost.  Equal texts are judged alike; of equally small languages the first by name wins.
    """
    return reject(judge(df, dictionaries, text, keep=[c for c in df.columns if c not in ("lang_pred", "score", "rejected", "_margin", "_bytes")]), margin)


def identify_calibrated(df: DataFrame, learned: Column, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``identify`` by dictionaries and margins of the rows where ``learned`` holds; ``keep`` (all columns) are those of ``df`` returned.

    Every text is judged once: verdicts are written, margins taken from those of labelled rows, and then applied.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    labelled = df.where(learned)
    chosen = choose(labelled, text, lang)
    marked = df.withColumn("_label", F.when(learned, F.col(lang))).withColumn("_order", order(text))
    judged = cut(judge(marked, joined(chosen), text, keep=[*keep, "_label", "_order"]), "judged")
    found = margins(judged.select(F.col("_label").alias(lang), "_order", "lang_pred", "score", "_margin", "_bytes"), labelled, chosen, text, lang)
    return reject(judged, found).drop("_label", "_order")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold; ``rejected`` by the margin calibrated on all of those."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_calibrated(docs, fold() != 0, keep=["doc_id"])
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")
