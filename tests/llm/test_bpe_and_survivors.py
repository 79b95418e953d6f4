import os
import random
from datetime import datetime

import pytest

from astrolith.llm import bpe, survivors

RANKS = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")

TEXTS = ["", " ", "a", "Hello world's  end\n\n x", "ﬁ ſt 日本語 é́ \x85 ", "<|endoftext|>", "a" * 4000,
         "recnarge spoiIed bythe naiu.\r\n12,50 — ´x`", "\t\n ", "x퟿\U0001f600" * 30]


@needs_vocabulary
def test_ids_equal_a_public_library_and_round_trip():
    tiktoken = pytest.importorskip("tiktoken")
    b = bpe.load(RANKS)
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(2)
    for t in TEXTS + ["".join(rng.choice("ab eé\n1.,'s") for _ in range(rng.randrange(60))) for _ in range(300)]:
        assert b.encode(t) == ref.encode_ordinary(t)
        assert b.decode(b.encode(t)) == t


@needs_vocabulary
def test_column(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, None)], "doc_id long, text string, ids string")
    out = {r.doc_id: list(r.ids) for r in bpe.encode_column(df).collect()}
    assert out[2] == out[3] == [] and len(out[1]) == 2
    assert bpe.encode_column(df.limit(0)).count() == 0


def test_survivors_equal_the_policy(spark):
    rng = random.Random(7)
    rows, t = [], [datetime(2025, 1, d) for d in range(1, 6)]
    for seq in range(400):
        rows.append((rng.choice(["a", "A", "b", "c", "hot", "hot", "", None]), rng.choice([0, 1, None]),
                     rng.choice(["x", "", None, "y"]), rng.choice([0, 5, None]), rng.choice(t), seq))
    rows.append(("single", 1, "x", 1, t[0], 1000))
    df = spark.createDataFrame(rows, "usr string, d int, f string, g long, loaded_at timestamp, seq long")
    sky = survivors.skyline(df, "usr", df["d"] == 1, ["loaded_at", "seq"], ["f", "g"])
    got = {tuple(r) for r in survivors.field_sources(sky, ["f", "g"], "r1").collect()}
    want = set()
    for k in {r[0] for r in rows if r[0]}:
        g = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] == 1, r[4], r[5]), reverse=True)
        for name, i in (("f", 2), ("g", 3)):
            have = [r for r in g if r[i]]
            if len(g) > 1 and have:
                want.add((k, name, have[0][5]))
    assert got == want
    built = {r.k: r for r in survivors.survivors(sky, ["f", "g"]).collect()}
    assert "single" not in built and built["hot"].n_rows == sum(r[0] == "hot" for r in rows)
    layers = [x.layer for r in sky.collect() for x in r.reps]
    assert min(layers) == 1 and max(layers) > 1
    assert survivors.skyline(df.limit(0), "usr", df["d"] == 1, ["seq"], ["f"]).count() == 0


def test_class_records_have_every_usr_and_column(spark, tmp_path):
    from astrolith.llm.queries import p5_class_records

    columns = ("id bigint, usr string, name string, qualified_name string, kind string, file_id bigint, line int, "
               "is_definition int, is_abstract int, namespace_id bigint, is_system int, tu_ord int, seq bigint, loaded_at int")
    rows = [
        (7, "u", "A", "", "class", 0, 3, 1, 0, None, None, 0, 1, 10),
        (7, "u", "B", "n::A", "struct", 5, 9, None, 1, 4, 1, 2, 2, 20),
        (8, "one", "C", "", None, 6, 0, 0, 0, 0, 0, 0, 3, 30),
        (9, "", "D", "D", "class", 1, 1, 1, 0, 1, 0, 1, 4, 40),
    ]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/src_classes.parquet")
    df = p5_class_records(spark, str(tmp_path))
    assert sorted(df.columns) == sorted([*(c.split()[0] for c in columns.split(", ")), "n_rows"])
    assert {r["usr"]: tuple(r)[1:] for r in df.collect()} == {
        "u": (2, 7, "A", "n::A", "class", 5, 3, 4, 1, 0, 1, 0, 1, 10),
        "one": (1, 8, "C", None, None, 6, None, None, 0, 0, 0, 0, 3, 30),
    }


def test_any_number_of_fields(spark):
    """Nine fields in two blocks, against the best-ranked row that has each."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from astrolith.llm import survivors

    rng = random.Random(4)
    rows = [(f"u{rng.randrange(12)}", rng.randrange(2), datetime(2025, 1, 1) + timedelta(days=rng.randrange(5)), i,
             *[rng.choice([None, "", f"v{i}"]) for _ in range(7)]) for i in range(150)]
    names = [f"f{i}" for i in range(7)]
    df = spark.createDataFrame(rows, "usr string, d int, at timestamp, seq long, " + ", ".join(f"{n} string" for n in names))
    got = {r.usr: r for r in survivors.records(df, "usr", F.col("d") == 1, ["at", "seq"], ["d", "at", "seq"]).collect()}
    for u in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2], r[3]), reverse=True)
        assert got[u].n_rows == len(group)
        for k, n in enumerate(names):
            assert got[u][n] == next((r[4 + k] for r in group if r[4 + k]), None)
