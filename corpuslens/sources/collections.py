"""JSON collections: catalogue, scan with a since-filter, point lookup, writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def scan_json(spark: SparkSession, folder: str, collection: str | None = None, since: str | None = None) -> DataFrame:
    """(collection, chunk_id, text, embedding, metadata) of the JSON arrays of a folder.

    The collection is the file's stem; metadata defaults to an empty map. A missing collection
    raises as Spark's reader does. since drops a record only if its created_at is readable and
    earlier; its zone is taken as UTC.
    """
    df = spark.read.schema(RECORD).option("multiLine", True).json(f"{folder}/{collection}.json" if collection else f"{folder}/*.json")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    df = df.select(name.alias("collection"), F.col("id").alias("chunk_id"), "text", "embedding",
                   F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    if since:
        made = F.try_to_timestamp(F.regexp_replace(F.col("metadata")["created_at"], r"(Z|[+-]\d{2}:?\d{2})$", ""))
        df = df.filter(made.isNull() | (made >= F.lit(since).cast("timestamp")))
    return df


def catalogue(records: DataFrame, prefix: str = "") -> DataFrame:
    """(name, count) by name; a prefix selects and is stripped."""
    c = records.filter(F.col("collection").startswith(prefix)) if prefix else records
    return c.groupBy(F.substring("collection", len(prefix) + 1, 10_000).alias("name")).agg(F.count("*").alias("count")).orderBy("name")


def embeddings_of(records: DataFrame, ids: list[str]) -> DataFrame:
    """(pos, chunk_id, embedding) in the order of the request; an unknown id raises."""
    ask = records.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, chunk_id string")
    j = ask.join(records.select("chunk_id", "embedding", F.lit(1).alias("_k")), "chunk_id", "left")
    known = F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("unknown chunk id: "), "chunk_id"))).otherwise(F.col("pos"))
    return j.select(known.cast("int").alias("pos"), "chunk_id", "embedding").orderBy("pos")


def check_dimension(records: DataFrame, dim: int | None = None) -> int | None:
    """The one vector length of a store; another one raises."""
    sizes = [r[0] for r in records.filter("embedding is not null").select(F.size("embedding").alias("n")).distinct().limit(3).collect()]
    for n in sizes:
        if dim is not None and n != dim or n != sizes[0]:
            raise ValueError(f"embedding dimension mismatch: {sorted({*sizes, *([dim] if dim else [])})}")
    return sizes[0] if sizes else dim


def write_json(records: DataFrame, folder: str) -> None:
    """JSON lines, one folder a collection."""
    records.write.mode("overwrite").partitionBy("collection").json(folder)


def store_id(kind: str, place: str) -> str:
    """The kind of a store and its place (a path, or host and port), with a colon between them."""
    return f"{kind}:{place}"
