"""Driver contract: entry() runs; every registered query has a plan."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and "p50" in df.columns


def test_oracles_are_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_profile_queries_build_on_smallest_scale(spark):
    qs = E.queries()
    for name in ["histogram", "value_counts", "confusion_matrix", "split_stratified", "corr_pearson"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0
