"""Deterministic motion views over the test tables.

The tables hold no poses or boxes, so every view derives them from columns of
one table. Row positions along a run are numbered per ``(key, bucket)``, never
in one task per key; those inside a picture by picture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridegrid.plans.blocks import dense_position, dealt, spread

FPS = 30.0
WIDTH, HEIGHT = 1280.0, 720.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joints(emb: Column) -> Column:
    value = lambda i: F.element_at(emb, i).cast("double")
    return F.array(*[F.array(*[value(3 * j + a) for a in (1, 2, 3)]) for j in range(21)])


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame_index, vec_id, subject_present, joints, camera_comp."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("run_id"), "vec_id", "embedding"
    )
    e = dense_position(e, ["run_id"], ["vec_id"], F.floor(F.col("vec_id") / 65536))
    return e.select(
        "run_id",
        "frame_index",
        "vec_id",
        (F.col("vec_id") % 17 != 0).alias("subject_present"),
        _joints(F.col("embedding")).alias("joints"),
        F.array(*[F.element_at("embedding", i).cast("double") for i in (62, 63, 64)]).alias(
            "camera_comp"
        ),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    return dense_position(e, ["run_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame_index, value (null = gap), event_id, ts."""
    return _events(spark, sf_dir).select(
        "run_id",
        "frame_index",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        "event_id",
        "ts",
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame_index, inference_status, present, ambiguous, left, right, score."""
    kind = F.col("event_type")
    return _events(spark, sf_dir).select(
        "run_id",
        "frame_index",
        "event_id",
        F.when(kind == "error", "masked")
        .when(kind == "signup", "subject_absent")
        .otherwise("ok")
        .alias("inference_status"),
        (~kind.isin("error", "signup")).alias("present"),
        (kind == "click").alias("ambiguous"),
        (F.col("event_id") % 7 < 4).alias("left"),
        (F.col("event_id") % 5 < 3).alias("right"),
        F.col("value").alias("score"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, det_id, x1, y1, x2, y2, score on a 1280 x 720 picture."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("video_id"),
        (F.col("l_orderkey") % 200).alias("frame"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        (1 - F.col("l_discount")).alias("score"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    # a key is one picture, so its rows are numbered where they meet
    li = dealt(li.where("video_id IS NOT NULL AND frame IS NOT NULL"), "video_id", "frame")
    place = F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(*order))
    li = li.withColumn("det_id", (place - 1).cast("long"))
    x1 = (F.col("l_partkey") % 1000).cast("double")
    y1 = ((F.col("l_orderkey") * 7) % 400).cast("double")
    return li.select(
        "video_id",
        "frame",
        "det_id",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 40 + 3 * F.col("l_quantity")).alias("x2"),
        (y1 + 120 + 20 * F.col("l_linenumber")).alias("y2"),
        "score",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), "embedding"
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, start_sec, end_sec, order_id."""
    start = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("order_id"),
        start.alias("start_sec"),
        (start + (F.col("o_orderkey") % 90)).alias("end_sec"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("text"), "lang", "source"
    )
    return spread(docs, F.col("doc_id"), F.octet_length("text"))
