"""Streaming scoring gives the same rows as batch scoring."""

import os
import tempfile

import pandas as pd

from tabscope.operators.prepare import PreparationSpec
from tabscope.operators.scoring import score_classification
from tabscope.operators.trees import fit_tree
from tabscope.streaming.scoring import read_new_rows, score_stream, start_scoring


def test_stream_matches_batch(spark):
    rows = [(i, float(i % 10), ["a", "b"][i % 2], "hi" if i % 10 > 4 else "lo") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y string")
    spec = PreparationSpec.fit(df, "y", ["x", "c"])
    model = fit_tree(spec.transform(df), spec.x_columns, "label", max_depth=3, classes=spec.classes)
    src = tempfile.mkdtemp(prefix="ts-src-")
    df.drop("y").write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    stream = read_new_rows(spark, os.path.join(src, "batch1"), df.drop("y").schema)
    out = tempfile.mkdtemp(prefix="ts-out-")
    q = start_scoring(score_stream(stream, spec, model, ["id"]), out, "score_test", trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out).toPandas().sort_values("id").reset_index(drop=True)
    exp = score_classification(df.drop("y"), spec, model, ["id"]).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[exp.columns], exp, check_dtype=False)
