"""Operator 1: a store of immutable shards with size-tiered compaction and versioned manifests.

Each arrival is appended as it comes, by a write without a shuffle: a run of small Parquet files.
A run's tier is the number of times its bytes exceed ``base`` by a power of ``fanout``.  Wherever a
tier holds ``fanout`` runs, the oldest are merged into one of a higher tier, until no tier does; the
cascade is planned on the manifest, so that each row is rewritten once.  Merged runs are written in
files of about ``target`` bytes.

A version is a manifest (a Parquet table) and a pointer file.  The pointer is renamed into place and
the rename fails if that version exists: of two writers one commits, the other must plan again.
Readers see a version or the next, never files in between.  After a compaction the live runs are at
most ``fanout`` - 1 a tier, so what the driver plans on grows with the logarithm of the store.

A writer announces its folder under ``pending`` before it writes and takes that back once its version
is live, so that ``vacuum`` leaves alone what is still to be committed.

Rows are kept as they come: null keys and texts, empty and very long texts and repeated rows are rows
like others.  The columns that the store adds are RESERVED; a frame that has one of them is refused.  A store without rows reads as an empty frame of the columns first appended.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import shared_dir, table

#: Columns that the store adds to what it reads, and writes its folders by.
RESERVED = ("run", "tier", "run_rows", "run_bytes", "_run", "_file")
MANIFEST = "run string, first long, arrivals long, tier int, rows long, bytes long, path string"


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Run:
    run: str
    first: int
    arrivals: int
    tier: int
    rows: int
    bytes: int
    path: str


def tier_of(size: int, base: int, fanout: int) -> int:
    tier, limit = 0, base * fanout
    while size >= limit:
        tier, limit = tier + 1, limit * fanout
    return tier


def plan(runs: list[Run], base: int, fanout: int) -> tuple[list[Run], dict[str, list[Run]]]:
    """The runs after a full cascade, and which of the given runs each new one is merged from."""
    live = {r.run: r for r in runs}
    parts = {r.run: [r] for r in runs}
    while True:
        tiers: dict[int, list[Run]] = {}
        for r in sorted(live.values(), key=lambda r: r.first):
            tiers.setdefault(r.tier, []).append(r)
        groups = [own[i : i + fanout] for own in tiers.values() for i in range(0, len(own) - fanout + 1, fanout)]
        if not groups:
            return sorted(live.values(), key=lambda r: r.first), {k: v for k, v in parts.items() if len(v) > 1}
        for group in groups:
            count, size = sum(r.arrivals for r in group), sum(r.bytes for r in group)
            first = group[0].first
            name = f"r{first}x{count}"
            made = Run(name, first, count, tier_of(size, base, fanout), sum(r.rows for r in group), size, "")
            parts[name] = [p for r in group for p in parts.pop(r.run)]
            for r in group:
                del live[r.run]
            live[name] = made


class ShardStore:
    """A store under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", base: int = 16 << 20, fanout: int = 4, target: int = 128 << 20):
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self.base, self.fanout, self.target = max(1, base), fanout, max(1, target)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # versions
    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def runs(self, version: int | None = None) -> list[Run]:
        known = self.versions()
        if not known:
            return []
        stream = self._fs.open(self._path(f"{self.path}/versions/{(known[-1] if version is None else version):010d}"))
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(*r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}").orderBy("first", "run").collect()]

    def commit(self, runs: list[Run], version: int) -> int:
        """Make ``runs`` version ``version``; raises CommitConflict where it exists already."""
        name = uuid.uuid4().hex
        rows = [(r.run, r.first, r.arrivals, r.tier, r.rows, r.bytes, r.path) for r in runs]
        said = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        values = ", ".join(f"({said(a)}, {b}L, {c}L, {d}, {e}L, {f}L, {said(g)})" for a, b, c, d, e, f, g in rows)
        frame = self.spark.sql(f"select * from values {values} as t(run, first, arrivals, tier, rows, bytes, path)") if rows else self.spark.sql("select '' as run, 0L as first, 0L as arrivals, 0 as tier, 0L as rows, 0L as bytes, '' as path where false")
        frame.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        waiting = self._path(f"{self.path}/versions/.{name}")
        stream = self._fs.create(waiting, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            context.rename(waiting, self._path(f"{self.path}/versions/{version:010d}"), options)
        except Exception as e:
            self._fs.delete(waiting, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} exists") from None
            raise
        return version

    def _measured(self, folder: str) -> dict[str, tuple[int, int]]:
        found = self.spark.read.parquet(folder).groupBy("_run").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(self.text)), F.lit(0)).alias("bytes"))
        return {str(r["_run"]): (r["rows"], r["bytes"]) for r in found.collect()}

    def _folder(self) -> tuple[str, object]:
        """A new data folder, announced as pending."""
        name = uuid.uuid4().hex
        mark = self._path(f"{self.path}/pending/{name}")
        self._fs.create(mark, False).close()
        return f"{self.path}/data/{name}", mark

    # writing
    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Append rows as new runs, one for each value of ``arrival`` (a number from 0; default: one run).

        Nothing is shuffled: each task writes its rows as they come.  An empty frame appends nothing.
        """
        taken = [c for c in df.columns if c.lower() in RESERVED]
        if taken:
            raise ValueError(f"columns of the store's own names: {taken}")
        before, known = self.runs(), self.versions()
        if not self._fs.exists(self._path(f"{self.path}/columns")):
            df.limit(0).write.mode("ignore").parquet(f"{self.path}/columns")
        start = max((r.first + r.arrivals for r in before), default=0)
        folder, mark = self._folder()
        number = (F.lit(0) if arrival is None else arrival) + F.lit(start)
        df.withColumn("_run", F.concat(F.lit("r"), number.cast("long").cast("string"), F.lit("x1"))).write.partitionBy("_run").option("compression", "zstd").parquet(folder)
        have = self._measured(folder) if self._fs.globStatus(self._path(f"{folder}/_run=*")) else {}
        made = [Run(name, int(name[1:].split("x")[0]), 1, tier_of(size, self.base, self.fanout), rows, size, f"{folder}/_run={name}") for name, (rows, size) in have.items()]
        version = self.commit([*before, *made], (known[-1] if known else 0) + 1)
        self._fs.delete(mark, False)
        return version

    def compact(self) -> int:
        """Merge until no tier holds ``fanout`` runs; returns the version that is then live.

        Each target file is a task of its own: files are numbered, and rows go to the task of their file's number.
        """
        before, known = self.runs(), self.versions()
        after, merged = plan(before, self.base, self.fanout)
        if not merged:
            return known[-1] if known else 0
        folder, mark = self._folder()
        home = {part.run: r for r in after if r.run in merged for part in merged[r.run]}
        files, first, total = {}, {}, 0
        for r in after:
            if r.run in merged:
                files[r.run], first[r.run] = max(1, math.ceil(r.bytes / self.target)), total
                total += files[r.run]
        # a run is a few names: maps of live runs, whose number is bounded by the tiers
        of = lambda pick: F.create_map(*[F.lit(x) for name, r in home.items() for x in (name, pick(r.run))])[F.col("run")]
        rows = self._read([p for own in merged.values() for p in own])
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), of(files.get)).cast("int")
        rows = rows.withColumns({"_run": of(str), "_file": of(first.get) + spread}).drop("run")
        rows.repartitionById(total, "_file").write.partitionBy("_run", "_file").option("compression", "zstd").parquet(folder)
        done = [Run(r.run, r.first, r.arrivals, r.tier, r.rows, r.bytes, f"{folder}/_run={r.run}") if r.run in merged else r for r in after]
        version = self.commit(done, known[-1] + 1)
        self._fs.delete(mark, False)
        return version

    def vacuum(self, grace: float = 24.0) -> None:
        """Delete the data of runs that the live version does not hold; older versions can no longer be read.

        Folders announced as pending stay, unless they were announced more than ``grace`` hours ago.
        """
        import time

        least = (time.time() - grace * 3600) * 1000
        waiting = {s.getPath().getName() for s in self._fs.globStatus(self._path(f"{self.path}/pending/*")) or [] if s.getModificationTime() >= least}
        found = self._fs.globStatus(self._path(f"{self.path}/data/*/_run=*")) or []
        live = {r.path for r in self.runs()}  # read after the listing, so that what was committed meanwhile is live
        for s in found:
            if s.getPath().getParent().getName() not in waiting and not any(s.getPath().toString().endswith(p.split("://")[-1]) for p in live):
                self._fs.delete(s.getPath(), True)

    # reading
    def _read(self, runs: list[Run]) -> DataFrame:
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*[r.path for r in runs])
        return rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "/_run=([^/]+)/", 1))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the live one) with their ``run`` and its ``tier``, rows and bytes."""
        live = [r for r in self.runs(version) if r.rows]
        if not live:
            if not self._fs.exists(self._path(f"{self.path}/columns")):
                raise ValueError("nothing was ever appended to the store")
            none = self.spark.read.parquet(f"{self.path}/columns").limit(0)
            return none.withColumns({"run": F.lit(""), "tier": F.lit(0), "run_rows": F.lit(0).cast("long"), "run_bytes": F.lit(0).cast("long")})
        pick = lambda f: F.create_map(*[F.lit(x) for r in live for x in (r.run, f(r))])[F.col("run")]
        return self._read(live).withColumns({"tier": pick(lambda r: r.tier), "run_rows": pick(lambda r: r.rows), "run_bytes": pick(lambda r: r.bytes)})


#: Of 64 hash values: eight arrivals of four, fourteen of one, one of the other eighteen.
_PLACE = "cast(pmod(pmod(coalesce(doc_id, 0), 65536) * 40503, 65536) div 1024 as int)"
_ARRIVAL = f"case when {_PLACE} < 32 then {_PLACE} div 4 when {_PLACE} < 46 then {_PLACE} - 24 else 22 end"
FANOUT, TARGET = 4, 64 << 20


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they lie in the store after 23 arrivals and a compaction, read back from its files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    store = ShardStore(spark, f"{shared_dir(spark)}/concord/store-{uuid.uuid4().hex}", base=max(1, total // 128), fanout=FANOUT, target=TARGET)
    store.append(docs, F.expr(_ARRIVAL))
    version = store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.col("run").alias("run_id"), "tier", "run_rows", "run_bytes", F.lit(version).cast("long").alias("version"))


def _oracle(rounds: int = 6) -> str:
    place = "((((coalesce(doc_id, 0) % 65536) * 40503) % 65536) // 1024)"
    arrival = f"case when {place} < 32 then {place} // 4 when {place} < 46 then {place} - 24 else 22 end"
    tier = lambda b: "(" + " + ".join(f"({b} >= base * {4**i})::int" for i in range(1, 13)) + ")"
    steps = [f"""d as (select doc_id, coalesce(text, '') as text, {arrival} as arrival from documents),
total as (select greatest(1, sum(octet_length(encode(text))) // 128) as base from d),
l0 as (select arrival, arrival as first, 1 as n, sum(octet_length(encode(text))) as bytes, count(*) as held from d group by arrival)"""]
    for i in range(rounds):
        steps.append(f"""t{i} as (select distinct first, n, bytes, held, {tier("bytes")} as tier from l{i}, total),
g{i} as (select *, (row_number() over (partition by tier order by first) - 1) // 4 as g, count(*) over (partition by tier) // 4 as wholes from t{i}),
m{i} as (select first as old, min(first) over w as first, sum(n) over w as n, sum(bytes) over w as bytes, sum(held) over w as held from g{i} window w as (partition by tier, g, case when g < wholes then -1 else first end)),
l{i + 1} as (select l.arrival, m.first, m.n, m.bytes, m.held from l{i} l join m{i} m on l.first = m.old)""")
    return "with " + ",\n".join(steps) + f"""
select d.doc_id, md5(d.text) as text_md5, 'r' || l.first || 'x' || l.n as run_id, {tier("l.bytes")} as tier, l.held::bigint as run_rows, l.bytes::bigint as run_bytes, 2::bigint as version
from d join l{rounds} l on d.arrival = l.arrival, total"""


ORACLE = _oracle()
