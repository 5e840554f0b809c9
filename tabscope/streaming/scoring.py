"""Scoring new rows as they arrive (re-aim of the reference's upload-and-score
step for files that keep landing in a folder).

The fitted preparation and a compiled tree / boosted model are plain Column
expressions, so the same projection runs on a streaming DataFrame: a file
source -> ``PreparationSpec.transform`` -> model columns -> file sink with a
checkpoint in the session's shared checkpoint folder (exactly-once output,
restartable after executor or driver loss).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabscope.operators.prepare import PreparationSpec
from tabscope.operators.scoring import score_classification, score_regression
from tabscope.session import ensure_checkpoint_dir


def read_new_rows(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                  max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming source over a folder of files with the training schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(folder)


def score_stream(stream: DataFrame, spec: PreparationSpec, model, keep: list[str] | None = None) -> DataFrame:
    """Streaming version of ``score_classification`` / ``score_regression``:
    stateless, so every micro-batch is one narrow projection."""
    score = score_regression if getattr(model, "task", "classification") == "regression" else score_classification
    return score(stream, spec, model, keep)


def start_scoring(scored: DataFrame, sink_folder: str, name: str, fmt: str = "parquet",
                  trigger_once: bool = False) -> StreamingQuery:
    """File sink; the query checkpoint lives under the shared checkpoint dir."""
    ckpt = os.path.join(ensure_checkpoint_dir(scored.sparkSession), "streams", name)
    w = scored.writeStream.format(fmt).option("checkpointLocation", ckpt).option("path", sink_folder) \
        .outputMode("append").queryName(name)
    if fmt == "csv":
        w = w.option("header", True)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
