"""Operator 9: toxicity by class-conditional Kneser-Ney models over the letters of words.

Either class has an interpolated Kneser-Ney model of a word's bytes, given up to ORDER - 1 bytes
before, word edges included.  Orders up to SHARED are estimated from both classes together, so a
rare expression, in either class, falls back to shared counts and says little for or against.  The
counts, of all labelled texts outside the held-out folds, are added up by distinct word first, then by
the 64-bit hashes of these words' grams; the model, broadcast whole, has an entry a distinct gram.

A text is judged by length-normalised log-likelihood ratios of the classes: over all its words, and
over its most telling word and words.  A logistic curve fitted on a fold that the counts leave out
makes the score of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import kernels
from concord.llm.folds import fold
from concord.session import table

#: Labelled rows of each class that the logistic curve is fitted on, at most; the lowest hashes are taken.
MAX_LABELLED = 16_384
ORDER, SHARED = 6, 2
#: Distinct words, or grams, that a task holds before it passes their counts on.
HELD = 1 << 20
#: Words whose ratio a worker keeps, and bytes of text that it works through at once.
CACHE, RUN_BYTES = 1 << 19, 1 << 20
#: Width of the filter for labelled keys, in bits, at most: 32 MB.
FILTER_BITS = 28
DISCOUNT = 0.75
#: Log-likelihood ratio from which a word counts as telling.
TELLING = 2.0
_rng = np.random.default_rng(97)
_BYTES = _rng.integers(1, 2**63, (ORDER, 256), dtype=np.uint64)


class Grams:
    """The byte n-grams of distinct lower-cased words, each between two spaces.

    For each order: which bytes have a gram that long, its hash, and the hash of its context.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts + 2
        self.first = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(len(sizes)), sizes)
        total = int(sizes.sum())
        self.place = np.arange(total) - np.repeat(self.first, sizes)
        inner = (self.place > 0) & (self.place < np.repeat(sizes - 1, sizes))
        text = np.full(total, 32, dtype=np.uint8)
        text[inner] = raw[(np.repeat(starts, sizes) + self.place - 1)[inner]]
        upper = (text >= 65) & (text <= 90)
        text[upper] += 32
        self.sums = [np.zeros(total, dtype=np.uint64)]
        for k in range(ORDER):
            shifted = np.zeros(total, dtype=np.uint64)
            shifted[k:] = _BYTES[k][text[: max(total - k, 0)]]
            self.sums.append(self.sums[-1] + shifted)

    def at(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where = np.flatnonzero((self.place > 0) & (self.place >= k - 1))
        return where, kernels.mix(self.sums[k][where], k), kernels.mix(self.sums[k - 1][where - 1], k + 50)


class Lookup:
    """Values by 64-bit hash; absent ones have ``default``.  Hashes are uniform, so few share their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float, like: Lookup | None = None):
        self.values = np.append(values, default).astype(np.float32)
        if like is not None:
            self.keys, self.shift, self.first = like.keys, like.shift, like.first
            return
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def at(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, or of the default."""
        lead = (wanted >> self.shift).astype(np.int64)
        out = np.full(len(wanted), len(self.keys), dtype=np.int32)
        place, end, live = self.first[lead], self.first[lead + 1], np.arange(len(wanted))
        while len(live := live[place[live] < end[live]]):
            hit = self.keys[place[live]] == wanted[live]
            out[live[hit]] = place[live[hit]]
            live = live[~hit]
            place[live] += 1
        return out

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        return self.values[self.at(wanted)]


def distinct_words(raw: np.ndarray, offsets: np.ndarray):
    """Distinct words of a run of texts: hashes, spans, each word's index among them, each row's first word."""
    hashes, firsts, starts, ends = kernels.words(raw, offsets, lower=True, spans=True)
    keys, index, back = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, starts[index], ends[index], back, firsts


def lowered(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw)


def word_counts(examples: DataFrame) -> DataFrame:
    """``word`` (bytes, A-Z lowered), ``n0``, ``n1``: how often each distinct word stands in texts of either class."""

    def packed(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array([n[c] for n in held.values()], pa.int64()) for c in (0, 1))], names=["word", "n0", "n1"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for whole in batches:
            for batch in kernels.slices(whole, "text", RUN_BYTES):
                raw, offsets = kernels.utf8(batch.column(0))
                _, starts, ends, back, firsts = distinct_words(raw, offsets)
                label = np.repeat(np.asarray(batch.column(1), dtype=np.int64), np.diff(firsts))
                counts = [np.bincount(back[label == c], minlength=len(starts)).tolist() for c in (0, 1)]
                text = lowered(raw).tobytes()
                for a, b, n0, n1 in zip(starts.tolist(), ends.tolist(), *counts, strict=True):
                    own = held.setdefault(text[a:b], [0, 0])
                    own[0] += n0
                    own[1] += n1
                if len(held) > HELD // 4:
                    yield packed(held)
                    held = {}
        yield packed(held)

    return examples.mapInArrow(count, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def counted(examples: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """All grams by order, sorted by hash: counts by class, and the hashes of shorter gram and context.

    ``examples``: text, toxic (0 or 1).  Words are counted first, so that each distinct one is cut into
    grams once; Spark adds the grams up, and the distinct ones come to the driver as Arrow columns.
    """
    names = ["k", "gram", "n0", "n1", "suffix", "context"]
    schema = ", ".join(f"{n} {'int' if n == 'k' else 'long'}" for n in names)

    def summed(parts: list[tuple]) -> tuple:
        gram, n0, n1, suffix, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, back = np.unique(gram, return_index=True, return_inverse=True)
        add = lambda n: np.bincount(back, n, minlength=len(keys)).astype(np.int64)
        return keys, add(n0), add(n1), suffix[first], context[first]

    def packed(k: int, data: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(data[0]), k, dtype=np.int32)), *(pa.array(x.view(np.int64)) for x in data)], names=names)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for whole in batches:
            for batch in kernels.slices(whole, "word", RUN_BYTES):
                raw, offsets = kernels.utf8(batch.column(0))
                weights = [np.asarray(batch.column(c), dtype=np.int64) for c in (1, 2)]
                grams = Grams(raw, offsets[:-1], offsets[1:])
                for k in range(1, ORDER + 1):
                    where, keys, contexts = grams.at(k)
                    shorter = kernels.mix(grams.sums[k - 1][where], k - 1)
                    new = (keys, *(w[grams.word[where]] for w in weights), shorter, contexts)
                    held[k] = summed([held[k], new] if k in held else [new])
                if sum(len(x[0]) for x in held.values()) > HELD:
                    yield from (packed(k, x) for k, x in held.items())
                    held = {}
        yield from (packed(k, x) for k, x in held.items())

    parts = word_counts(examples).mapInArrow(cut_up, schema).groupBy("k", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.first("suffix").alias("suffix"), F.first("context").alias("context"))
    found = parts.select(*names).toArrow()
    columns = {n: found.column(n).to_numpy() for n in names}
    del found
    out = {}
    for k in np.unique(columns["k"]).tolist():
        own = np.flatnonzero(columns["k"] == k)
        own = own[np.argsort(columns["gram"][own].view(np.uint64))]
        out[k] = {n: columns[n][own].view(np.uint64) if n in ("gram", "suffix", "context") else columns[n][own] for n in names[1:]}
    return out


class KneserNey:
    """Discounted shares of seen grams and back-off weights of contexts, by class and order."""

    def __init__(self, tables: dict[int, dict[str, np.ndarray]]):
        none = np.zeros(0, dtype=np.uint64)
        own = lambda k, n: tables[k][n] if k in tables else none
        grams = [Lookup(own(k, "gram"), np.zeros(len(own(k, "gram"))), 0) for k in range(1, ORDER + 1)]
        contexts = [np.unique(own(k, "context"), return_inverse=True) for k in range(1, ORDER + 1)]
        before = [Lookup(keys, np.ones(len(keys)), 1) for keys, _ in contexts]
        self.share: list[list[Lookup]] = []
        self.backoff: list[list[Lookup]] = []
        for c in (0, 1):
            shares, weights = [], []
            for k in range(1, ORDER + 1):
                keys, context = contexts[k - 1]
                counts = self._counts(tables, grams, c, k)
                share, weight = np.zeros(len(counts)), np.ones(len(keys))
                if counts.any():
                    seen = counts > 0
                    total = np.bincount(context, counts, minlength=len(keys))
                    kinds = np.bincount(context, seen, minlength=len(keys))
                    full = total > 0
                    share[seen] = np.maximum(counts - DISCOUNT, 0)[seen] / total[context[seen]]
                    weight[full] = DISCOUNT * kinds[full] / total[full]
                shares.append(Lookup(none, share, 0, grams[k - 1]))
                weights.append(Lookup(none, weight, 1, before[k - 1]))
            self.share.append(shares)
            self.backoff.append(weights)

    @staticmethod
    def _counts(tables, grams: list[Lookup], c: int, k: int) -> np.ndarray:
        """Counts at the top order, kinds of bytes before a gram below it, both classes' at shared orders."""
        if k not in tables:
            return np.zeros(0)
        own = tables[k]
        if k == ORDER:
            return own[f"n{c}"].astype(np.float64)
        above = tables.get(k + 1)
        kinds = np.zeros(len(own["gram"]))
        for d in (0, 1) if k <= SHARED else (c,):
            # word beginnings have no byte before them: their own counts, as of one kind more
            kinds += own[f"n{d}"] > 0
            if above is not None:
                kinds += np.bincount(grams[k - 1].at(above["suffix"]), above[f"n{d}"] > 0, minlength=len(kinds))[: len(kinds)]
        return kinds

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, toxic over ordinary, of each word."""
        grams = Grams(raw, starts, ends)
        logs = np.zeros(len(grams.word), dtype=np.float32)
        places = []
        for k in range(1, ORDER + 1):
            where, keys, contexts = grams.at(k)
            places.append((where, self.share[0][k - 1].at(keys), self.backoff[0][k - 1].at(contexts)))
        for c, sign in ((1, 1), (0, -1)):
            p = np.full(len(logs), 1 / 256, dtype=np.float32)
            for k, (where, slots, contexts) in enumerate(places):
                p[where] = self.share[c][k].values[slots] + self.backoff[c][k].values[contexts] * p[where]
            logs += sign * np.log(p)
        logs[grams.place == 0] = 0
        return np.add.reduceat(logs, grams.first) if len(starts) else np.zeros(0, dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def ratios(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ratios of distinct words given by ascending hashes; those seen before come from what the worker keeps."""
        keys, values = self.__dict__.get("known", (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)))
        if len(keys) > CACHE:
            keys, values = keys[:0], values[:0]
        at = np.searchsorted(keys, hashes)
        new = keys[np.minimum(at, len(keys) - 1)] != hashes if len(keys) else np.ones(len(hashes), dtype=bool)
        if new.any():
            made = np.clip(self.words(raw, starts[new], ends[new]), -20, 20)
            keys, values = np.insert(keys, at[new], hashes[new]), np.insert(values, at[new], made)
        self.known = keys, values
        return values[np.searchsorted(keys, hashes)]

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text: mean ratio a word; the largest; telling ratios, summed and per word."""
        raw, offsets = kernels.utf8(column)
        hashes, starts, ends, back, firsts = distinct_words(raw, offsets)
        out = np.zeros((len(column), 4))
        if not len(starts):
            return out
        ratio = self.ratios(hashes, raw, starts, ends)[back].astype(np.float64)
        n = np.diff(firsts)
        some = n > 0
        at = firsts[:-1][some]
        telling = np.maximum(ratio - TELLING, 0)
        out[some, 0] = np.add.reduceat(ratio, at) / n[some]
        out[some, 1] = np.maximum.reduceat(ratio, at) / 10
        total = np.add.reduceat(telling, at)
        out[some, 2] = np.log1p(total)
        out[some, 3] = np.log1p(100 * total / n[some])
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, models: KneserNey, weights: np.ndarray, bias: float):
        self.models, self.weights, self.bias = models, weights, bias

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.models.features(column) @ self.weights + self.bias, -30, 30)))


def labelled_only(texts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` (key, text) with their label (key, toxic).

    A bitmap of the labelled keys' hashes, 2**FILTER_BITS bits at most, leaves most other texts out
    before anything is shuffled; the join that follows is exact.
    """
    bits = min(FILTER_BITS, max(18, (16 * labels.count()).bit_length()))
    cell = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    blocks = labels.select(F.shiftright(cell, 15).alias("block"), cell.bitwiseAND(32767).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    wanted = bytearray((1 << bits) // 8)
    for r in blocks.collect():  # 2**FILTER_BITS bits at most
        wanted[r["block"] * 4096 : (r["block"] + 1) * 4096] = r["bits"]
    sent = texts.sparkSession.sparkContext.broadcast(bytes(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(2), dtype=np.int64)
            keep = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(keep)).select([0, 1])

    few = texts.withColumn("_cell", cell).mapInArrow(run, T.StructType([texts.schema[key], texts.schema["text"]]))
    return few.join(labels.hint("merge"), key).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5) -> Model:
    """Learn from labelled rows outside fold 0: counts from folds 1 to ``folds`` - 2, the curve from the last.

    The counts are of all those rows; the curve is fitted on at most ``MAX_LABELLED`` labels of each
    class, those of lowest hash.  Labels that are null, or contradict each other, teach nothing.
    Without examples of both classes every score is 0.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != 0)).groupBy(key).agg(F.min(label).alias("toxic"), F.max(label).alias("_most")).where("toxic = _most").drop("_most")
    texts = docs.select(key, F.col(text).alias("text"))
    counting = fold(key, folds).between(1, folds - 2)
    models = KneserNey(counted(labelled_only(texts.where(counting), clean.where(counting), key)))
    few = None
    for c in (0, 1):
        own = clean.where((F.col("toxic") == c) & (fold(key, folds) == folds - 1)).orderBy(F.xxhash64(key, F.lit(5)), key).limit(MAX_LABELLED)
        few = own if few is None else few.unionByName(own)
    examples = texts.join(F.broadcast(few), key)  # 2 * MAX_LABELLED rows at most
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernels.slices(whole, "text", RUN_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(list(sent.value.features(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = examples.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "x array<double>, toxic int").collect()
    sent.destroy()
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    if not len(rows) or not 0 < y.sum() < len(y):
        return Model(models, np.zeros(4), -30.0)
    return Model(models, *logistic(np.array([r["x"] for r in rows]), y))


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add column ``to``: the score of every whole text; a null text scores as an empty one."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernels.slices(whole, text, RUN_BYTES):
                made = pa.array(sent.value.score(batch.column(batch.schema.get_field_index(text))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), made], names=[*keep, to])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(to, T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
