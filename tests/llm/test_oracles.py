"""The queries beside their SQL on small tables with nulls, empty texts, repeated rows and ties."""

import math

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from concord.llm.catalog import ORACLES, QUERIES

PASSAGE = " ".join(f"p{i}" for i in range(50))
TEXTS = [
    None, "", " \t\n", "One", "one", "ONE two", "É é", "a b c\x0bd e", PASSAGE, f"x {PASSAGE} y", f"{PASSAGE}\n{PASSAGE}", PASSAGE.upper(),
    " ".join(["ha"] * 90), " ".join(f"w{i}" for i in range(200)), " ".join("other" if i == 100 else f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(185)), "one two three", "one two three",
]
VECTORS = [
    None, [], [0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [-1.0, 0.0], [1.0, 0.2], [1.0, 0.4], [1.0, 0.6], [math.nan, 1.0], [math.inf, 1.0], [1.0, None], [0.0, 1.0], [0.0, 1.0], [1.0, 0.0, 0.0],
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("tables")
    ids = [7 * i % 31 for i in range(len(TEXTS))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(TEXTS), "n_words": pa.array(ids, pa.int64())}), made / "documents.parquet")
    ids = [5 * i % 17 for i in range(len(VECTORS))]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(VECTORS, pa.list_(pa.float32())), "label": pa.array(ids, pa.int32())}), made / "embeddings.parquet")
    return made


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op7_substring_dedup", "op8_near_vectors"])
def test_query_beside_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = pd.DataFrame([r.asDict() for r in QUERIES[name](spark, str(folder)).collect()])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
    assert len(got) == (len(VECTORS) if name.startswith("op8") else len(TEXTS))
