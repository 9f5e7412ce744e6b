"""Vectors of texts by an injected encoder, and a linear reducer of vectors that is kept and refitted by growth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import vectors

BATCH, REFIT = 100, 0.2


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], column: str = "text", batch: int = BATCH) -> DataFrame:
    """texts plus embedding: the encoder gets batches of at most ``batch`` texts, line ends as spaces.

    Null texts have no vector and are not sent; an encoder that gives another number of vectors raises.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t = p[column].dropna().str.replace("\n", " ")
            got: list = []
            for i in range(0, len(t), batch):
                some = t.iloc[i : i + batch].tolist()
                v = encode(some)
                if len(v) != len(some):
                    raise ValueError(f"{len(some)} texts, {len(v)} vectors")
                got += [[float(x) for x in y] for y in v]
            yield p.assign(embedding=pd.Series(got, index=t.index, dtype=object).reindex(p.index).where(p[column].notna(), None))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(run, f"{fields}, embedding array<float>")


def reduced(rows: DataFrame, path: str, dims: int = 50, growth: float = REFIT) -> DataFrame:
    """rows (embedding of good vectors) plus reduced: principal components of the unit vectors.

    The model is kept in ``path`` and only fitted anew when the rows have grown by more than
    ``growth`` since its fit; the covariance is aggregated in a tree, its size is that of a vector.
    """
    spark = rows.sparkSession
    v = rows.withColumn("_v", array_to_vector(vectors.unit(F.col("embedding"))))
    n = rows.count()
    if not n:
        return rows.withColumn("reduced", F.array().cast("array<double>"))
    model = None
    try:
        last = spark.read.parquet(f"{path}/meta").first()["n"]
        model = PCAModel.load(f"{path}/model") if (n - last) / last <= growth else None
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if model is None:
        dim = rows.select(F.size("embedding")).first()[0]
        model = PCA(k=min(dims, dim), inputCol="_v", outputCol="_r").fit(v)
        model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return model.transform(v).withColumn("reduced", vector_to_array("_r")).drop("_v", "_r")
