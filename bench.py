"""Benchmark: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total sec), "unit", "queries", "sf"}.
Steps are named on stderr as they end; one that fails ends the run with its error.
$BENCH_ONLY names the steps to run (comma-joined; later steps need the earlier fits).
Each query runs once to warm the JVM and code caches, then is timed
$BENCH_REPS times (default 2) and the best run is reported, which damps
noise from other load on the machine; results are fully computed with the
no-op sink, not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabscope import catalog  # noqa: E402
from tabscope.operators import ensembles as EN  # noqa: E402
from tabscope.operators import scoring as B  # noqa: E402
from tabscope.operators.prepare import LABEL  # noqa: E402
from tabscope.operators.trees import fit_tree  # noqa: E402
from tabscope.plans import queries_models as QM  # noqa: E402
from tabscope.session import get_session  # noqa: E402


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    Q = catalog.QUERIES

    state = {}

    def prepare():
        if "split" in state:
            state["split"].unpersist()
        spec, split, _ = QM.prepared(spark, sf_dir)
        split.count()
        state["spec"], state["split"] = spec, split
        state["train"], state["test"] = QM._sides(split)

    def prepare_reg():
        if "rsplit" in state:
            state["rsplit"].unpersist()
        spec, split, _ = QM.prepared(spark, sf_dir, "regression")
        split.count()
        state["rspec"], state["rsplit"] = spec, split
        state["rtrain"], _ = QM._sides(split)

    def tree_fit():
        state["tree"] = fit_tree(state["train"], state["spec"].x_columns, LABEL, "classification", "gini", 5,
                                 classes=state["spec"].classes)

    def forest_fit():
        EN.forest_classifier(state["train"], state["spec"].x_columns, LABEL, 20, 5, classes=state["spec"].classes)

    def gbt_fit():
        EN.gbt_regressor(state["rtrain"], state["rspec"].x_columns, LABEL, 10, 0.1, 3)

    def adaboost_fit():
        EN.adaboost_classifier(state["train"], state["spec"].x_columns, LABEL, 10, 0.5, classes=state["spec"].classes)

    def score():
        _run(B.score_classification(QM._new_rows(spark, sf_dir), state["spec"], state["tree"], keep=["row_key"]))

    plan = [
        ("numeric_describe", lambda: _run(Q["numeric_describe"](spark, sf_dir))),
        ("histogram", lambda: _run(Q["histogram"](spark, sf_dir))),
        ("corr_pearson", lambda: _run(Q["corr_pearson"](spark, sf_dir))),
        ("corr_spearman", lambda: _run(Q["corr_spearman"](spark, sf_dir))),
        ("split_stratified", lambda: _run(Q["split_stratified"](spark, sf_dir))),
        ("roc_curve_binary", lambda: _run(Q["roc_curve_binary"](spark, sf_dir))),
        ("auc", lambda: _run(Q["auc"](spark, sf_dir))),
        ("classification_report", lambda: _run(Q["classification_report"](spark, sf_dir))),
        ("prepare_and_split", prepare),
        ("prepare_regression", prepare_reg),
        ("tree_classifier_fit", tree_fit),
        ("forest_classifier_fit", forest_fit),
        ("gbt_regressor_fit", gbt_fit),
        ("adaboost_classifier_fit", adaboost_fit),
        ("score_classification", score),
    ]
    only = [s for s in os.environ.get("BENCH_ONLY", "").split(",") if s]
    times = {}
    for name, fn in plan:
        if only and name not in only:
            continue
        runs = []
        try:
            fn()  # warm-up
            for _ in range(reps):
                t0 = time.perf_counter()
                fn()
                runs.append(time.perf_counter() - t0)
        except Exception:
            print(f"bench: {name} failed", file=sys.stderr, flush=True)
            raise
        times[name] = round(min(runs), 3)
        print(f"bench: {name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "stat": f"best of {reps} warm runs"}))
    spark.stop()


if __name__ == "__main__":
    main()
