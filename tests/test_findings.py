"""Cases of findings: vectors worked out once, keys in single precision, bounds as wide as they are meant."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from quaestor.functions import vectors as V
from quaestor.operators import requests as R


def test_values_are_worked_out_once(spark):
    z = spark.range(1).select(F.array(*map(F.lit, (1.0, 2.0, 4.0))).alias("logits"))
    assert str(V.softmax("logits")).count("logits") == str(V.log_softmax("logits")).count("logits") == str(V.normalised("logits")).count("logits") == 1
    names = ("first_keys", "first_p", "other_keys", "other_p")
    assert [str(R.ensemble_by_key(*map(F.col, names))).count(n) for n in names] == [1] * 4
    p = V.softmax("logits")
    for _ in range(4):  # each level multiplied the work by the number of entries and more
        p = V.softmax(p)
    want = np.array([1.0, 2.0, 4.0])
    for _ in range(5):
        want = np.exp(want - want.max()) / np.exp(want - want.max()).sum()
    assert np.allclose(z.select(p).first()[0], want)
    rows = spark.sql("SELECT array('a', 'b') AS k, array(1D, 3D) AS p, array('b', 'a') AS j, array(5D, 1D) AS q UNION ALL SELECT array('a'), array(1D), NULL, array(1D)")
    assert [r[0] for r in rows.select(R.ensemble_by_key(*map(F.col, "kpjq"))).collect()] == [[0.2, 0.8], None]


def test_cache_keys_round_in_single_precision(spark, tmp_path):
    x = np.random.default_rng(5).random(400_000, dtype=np.float32)
    single, double = np.floor(x * np.float32(1000) + 0.5), np.floor(x.astype(np.float64) * 1000 + 0.5)
    odd = x[single != double][:3]
    assert len(odd)
    rows = [(i, [float(v)], i) for i, v in enumerate(odd)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {i: hashlib.sha256(f"{int(np.floor(np.float32(v) * np.float32(1000) + 0.5))}|{i}".encode()).hexdigest() for i, (v,), _ in rows}
    assert {r["vec_id"]: r["key"] for r in __spark_entry__.queries()["cache_key"](spark, str(tmp_path)).collect()} == want


def test_bounded_sources_keep_forty_thousand(spark, tmp_path):
    rows = spark.range(40_100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40_050, "large").otherwise("small").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["bounded_sources"](spark, str(tmp_path))
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"large": 40_000, "small": 50}
