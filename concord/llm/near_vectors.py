"""Operator 8: pairs of embeddings with cosine >= a threshold, by randomised-rotation binary codes.

A unit vector o is rotated at random and stored as its signs, the code o' = sign(Po)/sqrt(d), with the
correction factor f = <o', o>.  The rotated vector itself is stored a second time in steps of four
bits, rounded up or down at random so that the rounding is right on average.  From the code of one
vector and the steps q of another, <o', q>/f estimates the cosine without bias, with an error below
ERROR (sqrt((1 - f^2) / f^2 / (d - 1)) + the rounding's) but with a tiny probability (RaBitQ, 2024).

Codes, factors and steps are what travels and meets: where a group of sign bits agrees, in one of
several tables of disjoint bits; the number of bits follows the number of vectors, the number of
tables the recall wanted at the threshold itself (``shape``).  In a bucket the upper bounds of the
estimates tell which vectors have a pair that may reach the threshold.  Only those vectors are fetched
whole, and their pairs are computed again in double precision.  A pair counts in the first table where
it meets.  Equal vectors form one class beforehand.  Buckets above BLOCK rows are dealt out as pairs of
blocks, so that every pair is still met; a block reports degrees and a spanning forest, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.components import connected_components
from concord.session import cut, drop_cut, table

ERROR = 4.0
RECALL = 0.9995
#: Rows that a bucket should hold, and that one block may; levels of a stored step.
BUCKET_ROWS, BLOCK, LEVELS = 64, 2048, 15


def shape(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits a table and tables: two vectors at the threshold meet with probability ``recall`` or more.

    A recall of 1 puts all vectors into one bucket: every pair is met, block by block.
    """
    if recall >= 1:
        return 0, 1
    bits = max(2, min(62, round(math.log2(max(rows, 1) / BUCKET_ROWS)))) if rows > BUCKET_ROWS else 2
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations side by side: (dim, count * dim)."""
    rng = np.random.default_rng(1000 + dim)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1).astype(np.float64)


def signatures(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each vector's key in each table."""
    if not bits:
        return np.zeros((len(unit), tables), dtype=np.int64)
    dim = unit.shape[1]
    turned = unit @ rotations(dim, max(1, math.ceil(bits * tables / dim)))
    signs = (turned[:, : bits * tables] >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def encode(unit: np.ndarray, salt: np.ndarray) -> list[bytes]:
    """What is stored of each unit vector: factor, least value and step (float32), the code's bits, and two steps a byte."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, 1)[:, :dim]
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    low = turned.min(axis=1).astype(np.float32)
    step = np.maximum((turned.max(axis=1) - low) / LEVELS, 1e-30).astype(np.float32)
    # a fraction for each part, fixed by the vector, so that a task run again stores the same
    chance = ((salt[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ** np.uint64(3) >> np.uint64(40)).astype(np.float64) / (1 << 24)
    steps = np.clip(np.floor((turned - low[:, None]) / step[:, None] + chance), 0, LEVELS).astype(np.uint8)
    if dim % 2:
        steps = np.concatenate([steps, np.zeros((len(steps), 1), np.uint8)], axis=1)
    packed = np.concatenate([np.stack([factor.astype(np.float32), low, step], axis=1).view(np.uint8), np.packbits(turned >= 0, axis=1, bitorder="little"), steps[:, ::2] | steps[:, 1::2] << 4], axis=1)
    return [row.tobytes() for row in packed]


def decode(stored: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors, codes, rotated vectors from the steps, and the steps' widths."""
    raw = np.frombuffer(b"".join(stored), dtype=np.uint8).reshape(len(stored), -1)
    factor, low, step = raw[:, :12].copy().view(np.float32).T
    wide = -(-dim // 8)
    code = (np.unpackbits(raw[:, 12 : 12 + wide], axis=1, count=dim, bitorder="little").astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    steps = raw[:, 12 + wide :]
    each = np.stack([steps & 15, steps >> 4], axis=2).reshape(len(raw), -1)[:, :dim]
    return factor, code, low[:, None] + each * step[:, None], step


def may_reach(left: tuple, right: tuple, threshold: float) -> np.ndarray:
    """Which pairs' estimates have an upper bound that reaches the threshold."""
    factor, code, _, _ = left
    _, _, turned, step = right
    dim = code.shape[1]
    if dim < 8:
        return np.ones((len(code), len(turned)), dtype=bool)
    estimate = (code @ turned.T) / factor[:, None]
    bound = ERROR * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (dim - 1))
    # a rounding errs by up to a step a part, in all by a quarter of dim steps squared about
    rounding = ERROR / 2 / factor[:, None] * step[None, :]
    return estimate >= threshold - 1e-4 - bound[:, None] - rounding


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in range(keys)]
        edges = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])).tolist()
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            this = tuple(int(c[a]) for c in columns)
            if held and this != name:
                yield held
                held = []
            name = this
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def near(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    A vector that is null or empty, zero, or has null or non-finite parts links with nothing, as do
    vectors of different lengths.  Equal vectors link.  Links are exact: only pairs with a cosine of
    ``threshold`` or more in double precision.  Rows stand for themselves: a key that occurs twice has
    a row each with its own links, and a null key is linked like any other; a component without any
    key has a null ``component_id``.  With ``recall`` 1 every pair is compared.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    marked = rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(7), "v")))
    classes = cut(marked.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")), "classes")
    count = classes.count()
    bits, tables = shape(count, threshold, recall)

    def parts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Lengths of the vectors, the rows that have them, and their values."""
        sizes = np.asarray(column.value_lengths(), dtype=np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            yield int(dim), at, np.asarray(column.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), -1)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in parts_of(batch.column(1)):
                unit, ids = units(x), batch.column(0).take(pa.array(at))
                names = signatures(unit, bits, tables)
                code = pa.array(encode(unit, np.asarray(ids).view(np.uint64)), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), dim), pa.int32()), pa.array(list(names), pa.list_(pa.int64())), code], names=["h1", "dim", "keys", "code"])

    codes = cut(classes.select("h1", "v").mapInArrow(stored, "h1 long, dim int, keys array<long>, code binary"), "codes")
    dealt = codes.select("h1", "dim", "code", F.posexplode("keys").alias("t", "b"))
    # only a bucket beyond BLOCK rows is dealt out by pairs of blocks
    big = dealt.groupBy("t", "dim", "b").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("t", "dim", "b", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(big, ["t", "dim", "b"], "left") if count > BLOCK else dealt.withColumn("blocks", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("h1", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("if(blocks is null, array(0), sequence(0, blocks - 1))")))
    dealt = dealt.select("t", "dim", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h1", "code")
    by = ["t", "dim", "b", "i", "j"]

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 5):
            dim, i, j = (int(group[0].column(c)[0].as_py()) for c in (1, 3, 4))
            side = np.concatenate([np.asarray(g.column(5)) for g in group])
            if len(side) < 2:
                continue
            all_ = decode([x for g in group for x in g.column(7).to_pylist()], dim)
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            wanted = np.zeros(len(side), dtype=bool)
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                hit = may_reach(tuple(x[some] for x in all_), tuple(x[right] for x in all_), threshold)
                hit &= some[:, None] != right[None, :]
                wanted[some] |= hit.any(axis=1)
                wanted[right] |= hit.any(axis=0)
            found = np.flatnonzero(wanted)
            if len(found):
                rows_ = pa.Table.from_batches(group).combine_chunks().take(pa.array(found)).select([*by, "own", "h1"])
                yield from rows_.to_batches()

    again = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(undecided, "t int, dim int, b long, i int, j int, own int, h1 long")
    fetched = again.join(classes.select("h1", "m", "v"), "h1").select(*by, "own", "h1", "m", "v")

    def compare(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(group).combine_chunks()
        t, i, j = whole["t"][0].as_py(), whole["i"][0].as_py(), whole["j"][0].as_py()
        ids, m = whole["h1"].to_numpy(), whole["m"].to_numpy()
        x = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in whole["v"].chunks]).reshape(len(ids), -1)
        # powers of two leave every digit; squares stay within range
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        side = whole["own"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        names = signatures(unit, bits, t) if t else None
        for at in range(0, len(left), 512):
            a, b = np.nonzero(unit[left[at : at + 512]] @ unit[right].T >= threshold - 1e-9)
            a, b = left[at + a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            exact = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
            a, b = a[exact], b[exact]
            if t:
                new = ~(names[a] == names[b]).any(axis=1)
                a, b = a[new], b[new]
            links.append((a, b))
        a, b = (np.concatenate(z) for z in zip(*links, strict=True)) if links else (np.zeros(0, int),) * 2
        degree = np.bincount(a, m[b], len(ids)) + np.bincount(b, m[a], len(ids))
        root = forest(len(ids), a, b)
        some = np.flatnonzero(degree > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(degree[some].astype(np.int64)), pa.array(ids[root[some]])], names=["h1", "links", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 5):
            yield compare(group)

    found = cut(fetched.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "h1 long, links long, near long"), "links")
    parts = cut(connected_components(found.select("h1", "near"), "h1", "near"), "parts")
    degrees = found.groupBy("h1").agg(F.sum("links").alias("links"))
    solved = classes.select("h1", "h2", "id", "m").join(degrees, "h1", "left").join(parts.withColumnRenamed("node", "h1"), "h1", "left").withColumn("part", F.coalesce("component", "h1"))
    heads = solved.groupBy("part").agg(F.min("id").alias("head"))
    solved = cut(solved.join(heads, "part").select("h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "head"), "solved")
    for done in (classes, codes, found, parts):
        drop_cut(done)
    out = marked.select("id", "ok", "h1", "h2").join(solved, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("head")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near(table(spark, sf_dir, "embeddings"))
