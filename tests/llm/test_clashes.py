"""Extra columns named like the operators' own change nothing."""

from datetime import datetime

from pyspark.sql import functions as F

from astrolith.llm import bpe, langid, leakage, residue, secrets, survivors

OWN = ["node", "skeleton", "sim", "trusted", "lang", "n_natural", "ids", "spans", "score", "k", "x", "c", "f", "t", "at", "vals", "mask", "item_id", "i", "u"]


def wide(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in OWN if c not in df.columns])


def test_clashes(spark):
    docs = wide(spark.createDataFrame(
        [(1, "404 Not Found. The requested page could\nnot be located on this server.", [{"x": 1, "y": 1, "w": 9, "h": 9, "conf": 1}] * 2)],
        "doc_id long, text string, line_boxes array<struct<x:int,y:int,w:int,h:int,conf:int>>"))
    assert [r.doc_id for r in residue.find(docs).collect()] == [1]
    item = " ".join(f"word{chr(97 + i)}" for i in range(20)) + " Tam Hest 123 456"
    items = wide(spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert leakage.find(docs, items).collect() == []
    if bpe.os.path.exists(bpe.os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")):
        assert bpe.encode_column(docs).columns == ["doc_id", "ids"]
    literals = wide(spark.createDataFrame(
        [(1, "password=Tiger#1234", 3, ""), (2, "Vous devez attendre la fin de la copie", 3, "")], "id long, content string, file_id long, function_usr string"))
    assert {(r.id, r.lang) for r in langid.identify(literals, more={}).collect()} == {(2, "fr")}
    model = secrets.Model(["password=Tiger#1234", "token: abC123def456", "plain words", "src/a.cpp", "value->next"] * 20)
    files = wide(spark.createDataFrame([(3, "a.cpp")], "id long, path string"))
    assert {r.id for r in secrets.score(literals, files, model).collect()} >= {1}
    rows = wide(spark.createDataFrame([("a", 1, datetime(2025, 1, 1), 1), ("a", 0, datetime(2025, 1, 2), 2)], "usr string, d int, loaded_at timestamp, seq long"))
    sky = survivors.skyline(rows, "usr", rows["d"] == 1, ["loaded_at", "seq"], ["k"])
    assert [tuple(r) for r in survivors.field_sources(sky, ["k"], "r1").collect()] == [("a", "k", 1)]
