"""Which columns count as features."""

from tidemark.operators import profile as pf


def test_roles_by_type_and_name(spark):
    df = spark.createDataFrame([], "Symbol string, Date date, Close double, rate decimal(10,2), n int, f float, text string, ok boolean, target_x double, fwd_1 double, split string, ingest_seq long")
    assert pf.feature_columns(df) == ["rate", "n", "f"] and pf.feature_columns(df, ("n",)) == ["rate", "f"]
    assert pf.numeric_columns(df) == ["Close", "rate", "n", "f", "ingest_seq"]
    assert pf.find_column(df, ("Adj Close", "Close")) == "Close" and pf.find_column(df, ("none",)) is None


def test_quality_of_decimals(spark):
    df = spark.sql("SELECT 'train' AS split, CAST(x AS DECIMAL(10, 2)) AS d FROM VALUES (1.25), (NULL), (3.75) AS t(x)")
    row = pf.feature_quality(df, ["d"]).head()
    assert (row.dtype, row.nan_count, row.inf_count, row.min, row.max, row.mean, row.status) == ("decimal(10,2)", 1, 0, 1.25, 3.75, 2.5, "FAIL_NAN_OR_INF")
