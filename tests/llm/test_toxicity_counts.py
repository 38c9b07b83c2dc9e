import zlib

import numpy as np

from concord.llm import toxicity


def test_all_labels_count(spark, monkeypatch):
    # an expression that only the last of many labelled rows has, and a bound far below the rows
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 20)
    docs = spark.createDataFrame([(i, f"fine words here {i}" + (f" qz{i}vile" if i % 2 else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []
    counted = toxicity.counted
    monkeypatch.setattr(toxicity, "counted", lambda examples: seen.append((examples.count(), counted(examples))) or seen[0][1])
    toxicity.learn(docs, labels)
    rows, tables = seen[0]
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 not in (0, 4)]
    assert rows == len(kept) > 200
    words = [w for i in kept for w in (f" fine  words  here  {i} " + (f" qz{i}vile " if i % 2 else "")).split()]
    grams = {f" {w} "[j : j + 6] for w in words for j in range(len(w) - 3) if len(f" {w} "[j : j + 6]) == 6}
    assert len(tables[6]["gram"]) == len(grams)


def test_lookup():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    found = toxicity.Lookup(keys, np.arange(5000), -1)
    assert (found[keys] == np.arange(5000)).all() and (found[keys + np.uint64(1)] == -1).all()
    assert (toxicity.Lookup(keys[:0], np.zeros(0), 7)[keys] == 7).all()
