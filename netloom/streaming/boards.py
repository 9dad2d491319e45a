"""Boards as they arrive: a file stream of finished mask tables.

A board's rows arrive in one file, so the stream keeps no state and needs no
watermark; every micro-batch goes through the batch extraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from netloom.plans.extract import Extraction

RUNS = "board_id int, w int, h int, layer string, y int, x0 int, x1 int"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of new Parquet files in ``folder``, with the board's size in each."""
    return spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extract_stream(rows: DataFrame, out: str, checkpoint: str, layers: tuple[str, ...], also: Callable[[Extraction, int], None] | None = None) -> StreamingQuery:
    """Appends the nets of each batch's boards to ``out``/batch=N; a repeated
    batch overwrites its own folder, so each board's nets appear once."""

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            canvas = batch.select("board_id", "w", "h").distinct()
            runs = batch.select("board_id", "layer", "y", "x0", "x1")
            e = Extraction(runs.where(runs.layer.isin(*layers)), runs.where("layer = 'drill'"), canvas, layers)
            e.nets.write.mode("overwrite").parquet(f"{out}/batch={n}")
            if also:
                also(e, n)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
