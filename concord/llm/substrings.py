"""Operator 7: exact removal of repeated word windows behind a count-min prefilter.

Pass 1 counts.  A window is represented in the sketch by its minimiser, the 8-word gram inside it
with the smallest hash (the leftmost of equals).  Equal windows have equal minimisers at equal
places, and different starts have different minimiser places, so the number of places of a gram
bounds the number of its windows from above.  Partitions sketch their minimiser places in counters
that saturate at two; sketches merge block by block; what is broadcast is one bit a counter, at most
2 * 2**MAX_BITS bits however large the corpus.  A fuller sketch lets more windows through, never
fewer.

Pass 2 groups exactly, by 96 bits of window hash, only the windows whose minimiser is estimated
repeated.  Each run of documents first groups its own windows and sends on one representative of
each distinct one, so a window in a third of all documents reaches its bucket once per run.  The
buckets are groups of packed arrays.  The places found then meet their text in buckets of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import kernels
from concord.session import table

GRAM = 8
DEPTH = 2
BLOCK_BITS = 20
#: Bits of a sketch row's width, at least and at most; the merged sketch takes 2 * 2**28 bits = 64 MB at most.
MIN_BITS, MAX_BITS = 20, 28
#: Minimiser places that a task gathers before it passes a partial sketch on.
FLUSH = 1 << 21
#: Bytes of text whose windows are grouped together before anything is sent.
RUN_BYTES = 1 << 22


def minimisers(hashes: np.ndarray, size: int) -> np.ndarray:
    """For every window start the place of its smallest gram, the leftmost of equals."""
    gram = min(GRAM, size)
    value = kernels.windows(hashes, gram)
    reach = size - gram + 1
    place = np.arange(len(value))
    have = 1
    while have < reach:
        step = min(have, reach - have)
        n = len(value) - step
        if n <= 0:
            return place[:0]
        right = value[step:] < value[:n]
        place = np.where(right, place[step:], place[:n])
        value = np.where(right, value[step:], value[:n])
        have += step
    return place


def _cells(grams: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return kernels.mix(grams, 101 + depth) >> np.uint64(64 - bits)


def sketch(df: DataFrame, text: str, size: int, bits: int) -> list[bytes]:
    """For each sketch row the bits of the counters that reached two."""
    block_bits = min(BLOCK_BITS, bits)
    blocks = 1 << (bits - block_bits)

    def part(grams: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        for depth in range(DEPTH):
            cells, counts = np.unique(_cells(grams, depth, bits), return_counts=True)
            edges = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(block_bits))
            low = (cells & np.uint64((1 << block_bits) - 1)).astype(np.uint32)
            for b in range(blocks):
                own, many = low[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]] > 1
                if len(own):
                    yield depth * blocks + b, own[~many].tobytes(), own[many].tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            rows = list(part(np.concatenate(held))) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "once", "more"])

        for whole in batches:
            for batch in kernels.slices(whole, text):
                hashes, firsts = kernels.words(*kernels.utf8(batch.column(0)))
                starts, _ = kernels.runs(firsts, size)
                if not len(starts):
                    continue
                places = np.unique(minimisers(hashes, size)[starts])
                held.append(kernels.windows(hashes, min(GRAM, size))[places])
                n += len(places)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def made(block: int, counters: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(counters > 1, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counters = None, None
        for batch in batches:
            for i, own in enumerate(batch.column(0).to_pylist()):
                if own != block:
                    if counters is not None:
                        yield made(block, counters)
                    block, counters = own, np.zeros(1 << block_bits, dtype=np.uint8)
                once, more = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint32) for c in (1, 2))
                counters[once] = np.minimum(counters[once] + 1, 2)  # places in one part are distinct
                counters[more] = 2
        if counters is not None:
            yield made(block, counters)

    parts = df.select(text).mapInArrow(count, "block int, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    rows = [bytearray((1 << bits) // 8) for _ in range(DEPTH)]
    wide = (1 << block_bits) // 8
    for r in merged.toLocalIterator():  # DEPTH * 2**MAX_BITS bits at most
        depth, b = divmod(r["block"], blocks)
        rows[depth][b * wide : (b + 1) * wide] = r["bits"]
    return [bytes(x) for x in rows]


def _narrow(x: np.ndarray) -> bytes:
    """As 16- or 32-bit integers if they fit; a leading byte tells the width."""
    top = int(x.max()) if len(x) else 0
    width = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def repeated_places(keyed: DataFrame, text: str, size: int, seen: list[bytes], bits: int, window_buckets: int, doc_buckets: int) -> DataFrame:
    """Packed (row key, window start) of all repeated windows, by bucket of row keys: exact.

    ``keyed`` holds ``_key`` (long) and the text.
    """
    sent = keyed.sparkSession.sparkContext.broadcast(seen)
    shift = np.uint64(64 - (window_buckets.bit_length() - 1))

    def by_doc(key: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        bucket = key.view(np.uint64) % np.uint64(doc_buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, key, place = bucket[order], key[order], place[order]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))), len(bucket)) if len(bucket) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(bucket[a]), key[a:b].tobytes(), _narrow(place[a:b])

    fields = [("bucket", pa.int32()), ("found", pa.bool_()), ("h1", pa.binary()), ("h2", pa.binary()), ("key", pa.binary()), ("place", pa.binary())]
    schema = "bucket int, found boolean, h1 binary, h2 binary, key binary, place binary"

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(x, dtype=np.uint8) for x in sent.value]
        for whole in batches:
            for batch in kernels.slices(whole, text, RUN_BYTES):
                keys = np.asarray(batch.column(0), dtype=np.int64)
                hashes, firsts = kernels.words(*kernels.utf8(batch.column(1)))
                starts, row = kernels.runs(firsts, size)
                if not len(starts):
                    continue
                at = minimisers(hashes, size)[starts]
                places, back = np.unique(at, return_inverse=True)
                grams = kernels.windows(hashes, min(GRAM, size))[places]
                likely = np.ones(len(places), dtype=bool)
                for depth, bitmap in enumerate(tables):
                    cell = _cells(grams, depth, bits)
                    likely &= (bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                keep = likely[back]
                starts, row = starts[keep], row[keep]
                if not len(starts):
                    continue
                h1 = kernels.windows(hashes, size, 0)[starts]
                h2 = kernels.windows(hashes, size, 1)[starts].astype(np.uint32)
                order = np.lexsort((h2, h1))
                h1, h2, starts, row = h1[order], h2[order], starts[order], row[order]
                new = np.ones(len(h1), dtype=bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(h1)))
                many = np.repeat(counts > 1, counts)
                place = starts - firsts[row]
                rows = [(b, True, None, None, k, p) for b, k, p in by_doc(keys[row[many]], place[many])]
                # representatives: a place only where there is one
                h1, h2, single = h1[first], h2[first], counts == 1
                key = np.where(single, keys[row[first]], 0)
                place = np.where(single, place[first] + 1, 0)
                bucket = (h1 >> shift).astype(np.int64) if window_buckets > 1 else np.zeros(len(h1), dtype=np.int64)
                full, edges = np.unique(bucket, return_index=True)
                for b, a, z in zip(full.tolist(), edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
                    rows.append((b, False, h1[a:z].tobytes(), h2[a:z].tobytes(), key[a:z].tobytes(), _narrow(place[a:z])))
                yield table_of(rows)

    def solve(group: list[tuple]) -> list[tuple]:
        h1 = np.frombuffer(b"".join(r[2] for r in group), dtype=np.uint64)
        h2 = np.frombuffer(b"".join(r[3] for r in group), dtype=np.uint32)
        key = np.frombuffer(b"".join(r[4] for r in group), dtype=np.int64)
        place = np.concatenate([_wide(r[5]) for r in group])
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(h1)))
        lone = place[order] > 0
        hit = np.repeat((counts > 1) | ~np.logical_and.reduceat(lone, first), counts) & lone
        chosen = order[hit]
        return [(b, True, None, None, k, p) for b, k, p in by_doc(key[chosen], place[chosen] - 1)]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[1]:
                    yield table_of([r])
                    continue
                if held and held[0][0] != r[0]:
                    yield table_of(solve(held))
                    held = []
                held.append(r)
        if held:
            yield table_of(solve(held))

    found = keyed.select("_key", text).mapInArrow(candidates, schema)
    # rows that are found already pass through beside the buckets of windows, spread evenly
    return found.repartition("bucket", "found").sortWithinPartitions("found", "bucket").mapInArrow(group, schema).select("bucket", "key", "place")


def dedup(df: DataFrame, text: str = "text", size: int = 35, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove each word that lies in a window of ``size`` words whose words also start elsewhere.

    Words are runs of bytes outside ``\\x20\\x09-\\x0D``; windows are judged on the input, and a text
    that occurs in two rows, or under the same id twice, repeats itself.  A null or empty text, or
    one shorter than a window, loses nothing.  Returns the columns ``keep`` (default: all but the
    text) with ``n_words`` and ``n_removed`` and either the kept words joined by one space (in
    ``text``; a text that loses nothing stays as it was, null too) or, with ``digest``, their
    ``kept_sha256``.  Columns of these names are replaced.  Equal rows each keep their row; an empty
    table gives an empty one.
    """
    made = {"n_words", "n_removed", *(["kept_sha256"] if digest else [])}
    keep = [c for c in (df.columns if keep is None else keep) if c != text and c not in made]
    key = F.xxhash64(*[F.col(c) for c in df.columns if dict(df.dtypes)[c] in ("bigint", "int", "string")]) if len(df.columns) > 1 else F.xxhash64(text)
    keyed = df.select(key.alias("_key"), F.col(text).alias("_text"), F.struct(*keep).alias("_rest") if keep else F.lit(None).cast("string").alias("_rest"))
    size_of = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    places = max(1, size_of // 6 * 2 // max(1, size - GRAM + 2))
    bits = min(MAX_BITS, max(MIN_BITS, (4 * places - 1).bit_length()))
    # some 4 MB of representatives and 16 MB of text a bucket
    window_buckets = 1 << max(3, (size_of >> 23).bit_length())
    doc_buckets = max(16, size_of >> 22)
    seen = sketch(df, text, size, bits)
    found = repeated_places(keyed, "_text", size, seen, bits, window_buckets, doc_buckets)
    bucket_of = F.expr(f"cast(pmod(pmod(_key, {doc_buckets}L) + if(_key < 0, {2**64 % doc_buckets}L, 0L), {doc_buckets}L) as int)")
    texts = keyed.select(bucket_of.alias("bucket"), F.lit(1).alias("_kind"), "_key", "_text", "_rest", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("place"))
    hits = found.select("bucket", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_key"), F.lit(None).cast("string").alias("_text"), F.lit(None).cast(texts.schema["_rest"].dataType).alias("_rest"), "key", "place")
    both = texts.unionByName(hits).repartition("bucket").sortWithinPartitions("bucket", "_kind")
    rest = texts.schema["_rest"].dataType

    def strip(value: str | None, starts: np.ndarray) -> tuple[int, int, str | None, str | None]:
        parts = (value or "").encode().split()
        if len(starts):
            cover = np.zeros(len(parts) + size + 1, dtype=np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            stay = np.cumsum(cover)[: len(parts)] == 0
            kept = list(compress(parts, stay.tolist()))
        else:
            kept = parts
        removed = len(parts) - len(kept)
        if digest:
            return len(parts), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), None
        return len(parts), removed, None, b" ".join(kept).decode() if removed else value

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, places, pending = None, None, None, []
        for whole in batches:
            kinds = np.asarray(whole.column(1))
            owners = np.asarray(whole.column(0))
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(owners) != 0) | (np.diff(kinds) != 0)]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)], strict=True):
                if owners[a] != bucket:
                    bucket, keys, pending = int(owners[a]), None, []
                part = whole.slice(a, b - a)
                if kinds[a] == 0:
                    pending += zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)
                    continue
                if keys is None:
                    keys = np.frombuffer(b"".join(k for k, _ in pending), dtype=np.int64)
                    places = np.concatenate([np.zeros(0, np.int64), *(_wide(p) for _, p in pending)])
                    order = np.argsort(keys, kind="stable")
                    keys, places, pending = keys[order], places[order], []
                own = np.asarray(part.column(2))
                lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                out = [strip(t.as_py(), np.unique(places[x:y])) for t, x, y in zip(part.column(3), lo.tolist(), hi.tolist(), strict=True)]
                arrays = [part.column(4), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2 if digest else 3] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["_rest", "_words", "_removed", "_made"])

    schema = T.StructType([T.StructField("_rest", rest), T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType()), T.StructField("_made", T.StringType())])
    done = both.mapInArrow(apply, schema)
    return done.select(*[F.col("_rest").getField(c).alias(c) for c in keep], F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_made").alias("kept_sha256" if digest else text))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the words of its repeated 35-word windows."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), size=35, digest=True)
