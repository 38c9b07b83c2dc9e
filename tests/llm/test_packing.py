import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from concord.llm import packing


def test_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.randint(1, 40)
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        used = packing.fill(counts, room)
        assert all(c <= counts[n] for n, c in used.items())
        best = max(sum(n * c for n, c in zip(counts, pick)) for pick in itertools.product(*(range(c + 1) for c in counts.values())) if sum(n * c for n, c in zip(counts, pick)) <= room)
        assert sum(n * c for n, c in used.items()) == best


def test_plan_places_all():
    rng = random.Random(2)
    counts = {n: rng.randint(0, 400) for n in range(1, 1025)}
    split, rows = packing.cut_share(counts, 1024)
    for n, c in split.items():
        for m, d in ((n, -c), (512, c), (n - 512, c)):
            counts[m] += d
    total = sum(n * c for n, c in counts.items())
    assert packing._sequences(rows, counts) * 1024 * 0.999 <= total
    rng2 = {n: 0 for n in counts}
    for n, first, *_ in sorted(rows):
        assert first >= rng2[n]
        rng2[n] = first
    assert packing.plan({}, 1024) == []


def test_pack(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gam ma", "d\n"]) for _ in range(rng.choice([0, 3, 50, 700, 3000]))), "z") for i in range(120)]
    docs += [(200, None, "z"), (201, "", "z"), (5, docs[5][1], "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, length string")
    out = packing.pack(df, with_ids=True).toPandas()
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((i, tuple(tk.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, _ in docs)
    have = 0
    for i, ids in {*want}:
        own = out[(out.doc_id == i)].drop_duplicates(["start"]).sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert list(r.ids) == list(ids[r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    have = out.length.sum()
    assert have == sum(len(x) for _, x in want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    n = out.sequence_id.nunique()
    assert set(out.sequence_id) == set(range(n)) and n <= have / 1024 + 3
    assert packing.pack(df.limit(0)).count() == 0
