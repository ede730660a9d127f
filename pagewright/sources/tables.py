"""Scans: stored tables, lookup tables and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database, read in ranges of its key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        reader = reader.option("partitionColumn", key).option("lowerBound", low or 0).option("upperBound", (high or 0) + 1).option("numPartitions", parts)
    return reader.load()


class Lookups:
    """Small rule tables, read once: all values in the order of id, bare where there is one column."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 100_000):
        self.spark, self.folder, self.most, self.known = spark, folder, most, {}

    def values(self, name: str) -> list:
        if name not in self.known:
            df = table(self.spark, self.folder, name)
            rows = df.orderBy("id").drop("id").limit(self.most + 1).collect()
            if len(rows) > self.most:
                raise ValueError(f"{name} has more than {self.most} rows: join it instead")
            self.known[name] = [r[0] if len(r) == 1 else tuple(r) for r in rows]
        return self.known[name]

    def refresh(self) -> None:
        self.known.clear()


def word_list(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """One word a line, without blanks around it; empty lines don't count."""
    words = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''").distinct().orderBy("w").limit(most + 1)
    out = [r.w for r in words.collect()]
    if len(out) > most:
        raise ValueError(f"more than {most} words")
    return out


def records_with_images(records: DataFrame, sessions: DataFrame, domain: str, locale: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """Records of a domain and locale that have an image, and all of these columns."""
    own = sessions.where((F.col("domain") == domain) & (F.col("locale") == locale)).select(F.col("id").alias("session_id"))
    rows = records.where("image_link IS NOT NULL").join(own, "session_id", "left_semi")
    for c in needed:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def first_image(candidates: DataFrame, defaults: DataFrame, order: str = "pos") -> DataFrame:
    """Each record's first image that has content; none where that is a default image."""
    from ..functions.scalars import content_hash

    rows = candidates.withColumn("image_hash", content_hash(F.col("content"))).where("image_hash IS NOT NULL")
    first = rows.groupBy("record").agg(F.min_by(F.struct("link", "image_hash"), order).alias("i")).select("record", "i.*")
    return first.join(defaults.select(F.col("hash").alias("image_hash")).distinct(), "image_hash", "left_anti")
