"""Incremental extraction: a stream of pages into a catalog of records.

Pages come one after another, and aliases that were met count no more; here that
memory is stream state under a watermark, and each batch is merged into a
catalog folder whose versions are complete.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import catalog, pages
from ..operators.clean import Settings
from ..rules import Rule

PAGES = "page_id long, url string, html string, fetched timestamp"


def read_pages(spark: SparkSession, path: str, schema: str | StructType = PAGES, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_records(stream: DataFrame, rules: Sequence[Rule], settings: Settings | None = None, late: str = "2 days") -> DataFrame:
    """Typed records of a stream of pages with the time of fetching, each alias once within that time's watermark;
    records without an alias are left out."""
    found = pages.typed_records(pages.records(stream, rules, settings, also=["fetched"]), rules, ["fetched"])
    return found.where("alias IS NOT NULL").withWatermark("fetched", late).dropDuplicatesWithinWatermark(["alias"])


def merge_into(path: str, order: Sequence[str] = ("page_id", "block")) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new aliases are appended to the catalog under ``path``, known ones left out.

    Batches are written under their number, so that a batch that is run again replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = catalog.first_by_alias(batch.where("alias IS NOT NULL"), list(order))
        try:
            known = spark.read.parquet(path).where(F.col("batch") != number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            fresh = catalog.new_only(fresh, known)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def ingest(stream: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str, settings: Settings | None = None, late: str = "2 days") -> StreamingQuery:
    """The stream's new records into the catalog: those met within the watermark are stream state, older ones are
    known by the catalog."""
    found = new_records(stream, rules, settings, late)
    return found.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
