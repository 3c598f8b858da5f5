from causeway.operators import redelivery as R
from tests.conftest import rows

SCHEMA = "row_id BIGINT, excerpt_id STRING, model STRING, delivered_at TIMESTAMP, __surplus INT"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_earliest_delivery_stays(spark):
    from datetime import datetime as D

    t = D(2024, 1, 2)
    df = table(spark, [
        (1, "a", "m", D(2024, 1, 3), 0), (2, " A ", "M", t, 0), (3, "a\t", "m ", t, 0),  # tie of 2 and 3: the lower key
        (4, None, "m", t, 0), (5, None, "m", t, 0), (6, "  ", "m", t, 0), (7, "  ", "m", t, 0),  # no identifier: no copies
        (8, "b", None, None, 0), (9, "b", None, t, 0), (10, "c", "m", None, 0), (10, "c", "m", None, 0),
    ])
    assert rows(R.surplus(df)) == [(1,), (3,), (8,)]
    kept = R.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.select("row_id").collect()) == [2, 4, 5, 6, 7, 9, 10, 10]
    assert rows(R.copies_per_identifier(df)) == [(2, 2), (3, 1)]


def test_empty(spark):
    df = table(spark, [])
    assert R.surplus(df).count() == 0 and R.deduplicate(df).count() == 0


def test_partial_aggregation_before_the_shuffle(spark, small):
    from causeway.sources import read_table

    plan = R.kept_keys(read_table(spark, small, "pair_results"), ["excerpt_id", "model"], "excerpt_id", "delivered_at", "row_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") >= 2 and "partial_min_by" in text
