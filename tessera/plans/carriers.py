"""The driver's tables in the roles of the engine's own: packets, epochs, sample blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: type is kind, user is stream (four to a file), ts is pts in microseconds, props is payload."""
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return read(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 4).alias("file_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.col("user_id").alias("stream_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"),
        F.octet_length("props").cast("bigint").alias("payload_len"),
        "value",
    )


PACKETS = """packets AS (SELECT user_id // 4 AS file_id, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS kind,
    user_id AS stream_id, epoch_us(ts) AS pts, CAST(octet_length(encode(props)) AS BIGINT) AS payload_len, value FROM events)"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A descriptor for each user whose first event is no error: video where it is a view or a signup, else audio."""
    first = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream_id")).agg(F.min_by("event_type", "event_id").alias("first"))
    return first.where("first <> 'error'").select("stream_id", F.when(F.col("first").isin("view", "signup"), 2).otherwise(3).alias("media_kind"))


STREAMS = """streams AS (SELECT stream_id, CASE WHEN first IN ('view', 'signup') THEN 2 ELSE 3 END AS media_kind
    FROM (SELECT user_id AS stream_id, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id) WHERE first <> 'error')"""


def scaled(embedding: Column | str, by: int) -> Column:
    """An embedding as integers."""
    return F.transform(F.col(embedding) if isinstance(embedding, str) else embedding, lambda x: F.floor(x.cast("double") * by + 0.5))


def sql_scaled(by: int, column: str = "embedding") -> str:
    return f"list_transform({column}, lambda x: CAST(floor(CAST(x AS DOUBLE) * {by} + 0.5) AS BIGINT))"


def blocks(spark: SparkSession, sf_dir: str, by: int = 32767) -> DataFrame:
    """embeddings as blocks of 64 integers."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", scaled("embedding", by).alias("x"))


def sql_blocks(by: int = 32767) -> str:
    return f"blocks AS (SELECT vec_id, label, {sql_scaled(by)} AS x FROM embeddings)"
