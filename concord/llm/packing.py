"""Operator 4: packing of token pieces into fixed windows by minimum bin slack.

Every document's ids are cut into whole windows and one remainder.  All that the packing needs to
know about the corpus is how many pieces there are of each length, at most ``capacity`` numbers; the
driver plans on those counts alone.  A window is seeded with the longest remaining length; a bitset
subset-sum dynamic programme over the remaining multiset finds the reachable filling closest to the
capacity, its counts are read off by backtracking, and the window is repeated as often as the counts
allow.  Pieces then find their window by their rank among the pieces of their length; ranks come
from counts per (length, hash bucket), so that one very common length is spread over all tasks.

Remainders longer than half a window cannot share one, so where they outweigh the short ones the
planner has a share of them cut at half a window, the least of ``SHARES`` that leaves little padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import byte_bpe
from concord.llm.kernels import slices
from concord.session import cut, table


#: Shares of the remainders over half a window that the planner may cut in two.
SHARES = (0.0, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
#: Padding, as a share of all tokens, with which the planner is content.
PADDING = 0.001


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths out of ``counts`` whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` says that sum s can be made; each step adds a power of two of one length.
    Long lengths go first, so that the short ones, which fit anywhere, are left for later windows;
    the search stops when ``room`` itself is reached.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, have in sorted(counts.items(), reverse=True):
        left, take = min(have, room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            wider = (reach | reach << (length * take)) & full
            if wider != reach:
                steps.append((reach, length, take))
                reach = wider
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces per window, first sequence, first offset), a run of ranks each.

    Windows of one pattern are consecutive sequences; rank r of a run lies in window
    ``(r - first) // per`` at offset ``first offset + (r - first) % per * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        used = fill({n: c for n, c in rest.items() if c and n <= capacity - seed}, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        offset = 0
        for n, c in sorted(used.items(), reverse=True):
            rows.append((n, taken[n], c, sequence, offset))
            offset += n * c
            taken[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def cut_share(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], list[tuple[int, int, int, int, int]]]:
    """How many pieces of each length to cut at half a window, and the plan for what there is then."""
    half, total, best = capacity // 2, sum(n * c for n, c in counts.items()), None
    for share in SHARES:
        cuts = {n: int(c * share) for n, c in counts.items() if half < n < capacity and int(c * share)}
        after = dict(counts)
        for n, c in cuts.items():
            after[n] -= c
            after[half] = after.get(half, 0) + c
            after[n - half] = after.get(n - half, 0) + c
        rows = plan(after, capacity)
        waste = capacity * _sequences(rows, after) - total
        if best is None or waste < best[0]:
            best = waste, cuts, rows
        if waste <= max(PADDING * total, capacity):
            break
    return best[1], best[2]


def _sequences(rows: list[tuple[int, int, int, int, int]], counts: dict[int, int]) -> int:
    """Windows of a plan: the last run of a length ends with the last piece of that length."""
    last = {n: (first, per, sequence) for n, first, per, sequence, _ in rows}
    return max((sequence + (counts[n] - 1 - first) // per + 1 for n, (first, per, sequence) in last.items()), default=0)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, path: str | None = None, pattern: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, closed by ``end_id``, into pieces of ``capacity`` ids and a remainder.

    A null text counts as empty and so gives one piece, the closing id.  Repeated rows give pieces
    each.  Columns: key, start, length, ids_crc32, doc_tokens, the checksums of both parts of a
    remainder that may be cut at half a window (else 0) and, if asked for, ids.
    """
    import public_tokenizers

    given = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(*given)
        close = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for part in slices(whole, text, byte_bpe.RUN_BYTES):
                ids, begin = bpe.encode(part.column(1))
                ids = ids.astype("<u4", copy=False)
                rows, starts, sizes, crcs, totals, heads, tails, own_ids = [], [], [], [], [], [], [], []
                for row, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    data = ids[a:b].tobytes() + close
                    total = b - a + 1
                    for start in range(0, total, capacity):
                        piece = data[4 * start : 4 * (start + capacity)]
                        rows.append(row)
                        starts.append(start)
                        sizes.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(total)
                        two = 2 * capacity < len(piece) < 4 * capacity
                        heads.append(zlib.crc32(piece[: 2 * capacity]) if two else 0)
                        tails.append(zlib.crc32(piece[2 * capacity :]) if two else 0)
                        if with_ids:
                            own_ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals, heads, tails))]
                if with_ids:
                    arrays.append(pa.array(own_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "_head", "_tail"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    return df.select(key, text).mapInArrow(run, T.StructType(fields))


def assign(cuts: DataFrame, key: str = "doc_id", capacity: int = 1024, buckets: int | None = None) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``; ``cuts`` is read more than once, so it should be a table."""
    if buckets is None:
        buckets = max(16, cuts.count() // 250_000)
    bucketed = cuts.withColumn("_bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)))
    counts = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    half = capacity // 2
    split, rows = cut_share(totals, capacity)
    runs = sorted(rows)
    span = np.int64(1) << np.int64(44)
    firsts = np.array([r[0] * span + r[1] for r in runs], dtype=np.int64)
    info = np.array([r[1:] for r in runs], dtype=np.int64).reshape(-1, 4)
    # by length: how many lowest ranks are cut, and the ranks that their halves and rests begin at
    cut_below, head_rank, tail_rank = (np.zeros(capacity + 1, dtype=np.int64) for _ in range(3))
    made = totals.get(half, 0)
    for n, c in split.items():
        cut_below[n], head_rank[n], tail_rank[n] = c, made, totals.get(n - half, 0)
        made += c
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy(key, "start", "ids_crc32")
    ranked = bucketed.withColumn("_rank", F.row_number().over(within) - 1).join(shifts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))

    kept = [c for c in cuts.columns if c not in ("_head", "_tail")]

    def place(batch: pa.RecordBatch, chosen: np.ndarray, changed: dict[str, np.ndarray], rank: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        first, per, sequence, offset = info[np.searchsorted(firsts, length * span + rank, side="right") - 1].T
        at = rank - first
        part = batch.take(pa.array(chosen))
        arrays = [pa.array(changed[n], batch.schema.field(n).type) if n in changed else part.column(part.schema.get_field_index(n)) for n in kept]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(sequence + at // per), pa.array(offset + at % per * length)], names=[*kept, "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {n: np.asarray(batch.column(batch.schema.get_field_index(n)), dtype=np.int64) for n in ("_rank", "length", "start", "_head", "_tail")}
            rank, length = values["_rank"], values["length"]
            two = rank < cut_below[length]
            whole, two = np.flatnonzero(~two), np.flatnonzero(two)
            yield place(batch, whole, {}, rank[whole] - cut_below[length[whole]], length[whole])
            if len(two):
                n, r, start = length[two], rank[two], values["start"][two]
                ids = batch.column(batch.schema.get_field_index("ids")) if "ids" in kept else None
                for size, begin, crc, base, part in ((np.full(len(n), half), start, values["_head"], head_rank, slice(0, half)), (n - half, start + half, values["_tail"], tail_rank, slice(half, None))):
                    changed = {"length": size, "start": begin, "ids_crc32": crc[two]}
                    if ids is not None:
                        changed["ids"] = [ids[int(i)].as_py()[part] for i in two]
                    yield place(batch, two, changed, base[n] + r, size)

    schema = T.StructType([*(cuts.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*cuts.columns, "_rank").mapInArrow(run, schema)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, **options) -> DataFrame:
    """Pieces of all documents with the sequence and the offset at which each one lies.

    A null text counts as empty and gives one piece, its closing id; a text longer than a sequence gives
    several.  Equal rows are packed each for itself, null keys like others; which of equal pieces lies
    where goes by key, start and checksum.  Other columns are left out; an empty table gives no rows.
    """
    return assign(cut(pieces(df, key, text, capacity, **options), "pieces"), key, capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
