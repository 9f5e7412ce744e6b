import numpy as np
import pytest

from corpuslens.operators.encoders import embed, reduced


def test_embed(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"line\n{i}", "clash") for i in range(7)], "n int, text string, e string").repartition(2)
    got = {r.n: r.embedding for r in embed(df, lambda t: [[len(x), x.count("\n")] for x in t], batch=2).collect()}
    assert got[3] is None and got[0] == [6.0, 0.0] and len(got) == 7
    with pytest.raises(Exception, match="vectors"):
        embed(df, lambda t: []).collect()
    assert embed(df.limit(0), lambda t: [[1.0] for _ in t]).count() == 0


def test_reduced_keeps_its_model(spark, tmp_path):
    r = np.random.RandomState(0)
    rows = [(i, (r.randn(2) @ np.ones((2, 8)) * [1, 2, 3, 4, 5, 6, 7, 8] + r.randn(8) * 0.01).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, embedding array<float>")
    p = str(tmp_path / "m")
    a = {x.n: x.reduced for x in reduced(df, p, 2).collect()}
    assert all(len(v) == 2 for v in a.values())
    b = {x.n: x.reduced for x in reduced(df.filter("n < 39"), p, 2).collect()}
    assert all(np.allclose(a[n], v) for n, v in b.items())
    assert spark.read.parquet(p + "/meta").first().n == 40
    reduced(df.unionByName(df), p, 2).collect()
    assert spark.read.parquet(p + "/meta").first().n == 80
    assert reduced(df.limit(0), p, 2).count() == 0
