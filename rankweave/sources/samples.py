"""Samples: (id, features array<double>, labels array<tinyint>) from any DataFrame, and the long forms of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankweave.functions.columns import binarized
from rankweave.operators.sharded import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assemble(df: DataFrame, id_col: str, features: Sequence[Column], labels: Sequence[Column]) -> DataFrame:
    """Samples from columns; labels may be in {0, 1} or {-1, 1}."""
    if not features or not labels:
        raise ValueError("features and labels must not be empty")
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*[c.cast("double") for c in features]).alias("features"), binarized(F.array(*[c.cast("int") for c in labels])).alias("labels"))


def sizes(samples: DataFrame) -> tuple[int, int, int]:
    """(rows, features, labels) of samples of either layout; raises on empty or ragged samples."""
    features = F.col("features.size") if isinstance(samples.schema["features"].dataType, StructType) else F.size("features")
    r = samples.agg(F.count("*").alias("n"), *[f(v).alias(f"{a}_{c}") for c, v in (("features", features), ("labels", F.size("labels"))) for a, f in (("least", F.min), ("most", F.max))]).first()
    if not r["n"] or r["least_features"] != r["most_features"] or r["least_labels"] != r["most_labels"] or r["most_features"] < 1 or r["most_labels"] < 1:
        raise ValueError("samples must be non-empty and equally long")
    return r["n"], r["most_features"], r["most_labels"]


def min_max(samples: DataFrame, d: int | None = None) -> DataFrame:
    """Features scaled to [0, 1]; one aggregate row of bounds goes through the driver. A constant feature becomes 0. ``d``: how many features there
    are; where it is known, the samples are read once less."""
    if d is None:
        d = len(samples.select("features").first()[0])
    low_high = samples.agg(*[F.min(F.col("features")[i]).alias(f"l{i}") for i in range(d)], *[F.max(F.col("features")[i]).alias(f"h{i}") for i in range(d)]).first()
    one = [(F.col("features")[i] - low_high[f"l{i}"]) / (low_high[f"h{i}"] - low_high[f"l{i}"]) if low_high[f"h{i}"] > low_high[f"l{i}"] else F.lit(0.0) for i in range(d)]
    return samples.withColumn("features", F.array(*one))


def feature_values(samples: DataFrame) -> DataFrame:
    """(id, fid, val)."""
    return samples.select("id", F.posexplode("features").alias("fid", "val"))


def label_values(samples: DataFrame) -> DataFrame:
    """(id, lid, y) of all labels."""
    return samples.select("id", F.posexplode("labels").alias("lid", "y"))


def positives(samples: DataFrame) -> DataFrame:
    """(id, lid) of positive labels."""
    return label_values(samples).where("y > 0").select("id", "lid")


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: statistics of their lines; labels by return flag and line status. Features are scaled."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("f0"), F.avg("l_quantity").alias("f1"), F.min("l_quantity").alias("f2"), F.max("l_quantity").alias("f3"),
        F.sum("l_extendedprice").alias("f4"), F.avg("l_extendedprice").alias("f5"), F.avg("l_discount").alias("f6"), F.max("l_discount").alias("f7"),
        F.avg("l_tax").alias("f8"), F.count("*").alias("f9"),
        *[F.max((F.col(c) == v).cast("int")).alias(f"y{k}") for k, (c, v) in enumerate([("l_returnflag", "A"), ("l_returnflag", "N"), ("l_returnflag", "R"), ("l_linestatus", "O"), ("l_linestatus", "F")])],
    )
    return min_max(assemble(g, "l_orderkey", [F.col(f"f{i}") for i in range(10)], [F.col(f"y{i}") for i in range(5)]), 10)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; labels are one-hot, odd, and high."""
    e = table(spark, sf_dir, "embeddings")
    labels = F.array(*[(F.col("label") == i).cast("int") for i in range(10)], (F.col("label") % 2).cast("int"), (F.col("label") >= 5).cast("int"))
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), binarized(labels).alias("labels"))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with counts of characters by kind (f0 to f5). Characters are counted before documents meet labels, so no text is shuffled."""
    t = F.col("text")

    def count(letters: str) -> Column:
        return F.length(t) - F.length(F.translate(t, letters, ""))

    features = [F.col("n_chars"), count(" "), count("0123456789"), count("\n"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(".,;:!?")]
    counts = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(f"f{i}") for i, c in enumerate(features)])
    return table(spark, sf_dir, "labels").join(counts, "doc_id")


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: counts of characters by kind; labels quality and toxic. Features are scaled. Counts are kept, so texts are read once."""
    return min_max(assemble(checkpointed(text_counts(spark, sf_dir)), "doc_id", [F.col(f"f{i}") for i in range(6)], [F.col("quality"), F.col("toxic")]), 6)
