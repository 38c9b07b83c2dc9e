import duckdb
import pytest
from pyspark.sql import functions as F

from concord.llm import shards


def test_query_against_sql(spark):
    for sf in ("sf0.001",):
        path = f"/root/testdata/{sf}"
        got = shards.op1_shards(spark, path).toPandas()
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{path}/documents.parquet'")
        want = con.sql(shards.ORACLE).df()
        order = lambda x: x[sorted(x.columns)].sort_values(["doc_id", "text_md5"]).reset_index(drop=True).astype(str)
        assert order(got).equals(order(want))
        assert got.run_id.nunique() < 23


def test_store(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", base=10, fanout=2, target=50)
    rows = spark.createDataFrame([(i, "x" * i, i) for i in range(40)] + [(None, None, 0), (3, "xxx", 3)], "doc_id long, text string, run_rows long")
    assert store.versions() == [] and store.compact() == 0
    with pytest.raises(ValueError):
        store.read()
    for i in range(5):
        assert store.append(rows.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == i).drop("run_rows")) == i + 1
    store.append(rows.limit(0).drop("run_rows"))
    before = sorted((r.doc_id or -1, r.text or "") for r in store.read().collect())
    version = store.compact()
    assert sorted((r.doc_id or -1, r.text or "") for r in store.read().collect()) == before == sorted((r.doc_id or -1, r.text or "") for r in rows.collect())
    assert sorted((r.doc_id or -1, r.text or "") for r in store.read(version - 1).collect()) == before
    tiers = [r.tier for r in store.runs()]
    assert max(tiers.count(t) for t in tiers) < 2 and store.compact() == version
    with pytest.raises(shards.CommitConflict):
        store.commit([], version)
    store.vacuum()
    assert store.read().count() == len(before)
    with pytest.raises(ValueError):
        store.append(rows.withColumnRenamed("run_rows", "tier"))


def test_vacuum_spares_what_is_pending_and_quotes(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/it's", base=10, fanout=2, target=50)
    rows = spark.createDataFrame([(i, "x" * 9) for i in range(10)], "doc_id long, text string")
    store.append(rows)
    folder, _ = store._folder()
    rows.withColumn("_run", F.lit("r9x1")).write.partitionBy("_run").parquet(folder)
    store.vacuum()
    assert spark.read.parquet(folder).count() == 10 and store.read().count() == 10
    store.vacuum(grace=-1)
    assert not list(tmp_path.glob("it's/data/*/_run=r9x1"))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = shards.op1_shards(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "text_md5", "run_id", "tier", "run_rows", "run_bytes", "version"]
