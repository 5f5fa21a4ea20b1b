"""Numbers in JSON texts are written as the SQL engine writes them, at any size."""

import duckdb

from loomseq.sources import tables

VALUES = [0.0, 1.5, 0.001, 9_999_999.5, 10_000_000.0, 30_013_130.0, 12345678.25, -12345678.25, 1234567890123456.0, 1e20, 1e21, 1.5e22, 0.0001234, 0.00001234, 1.5e-6, 1.5e-7, 0.1 + 0.2]


def test_series_json_has_the_digits_of_the_sql(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(VALUES)] + [("a", 99, None)], "k string, t long, v double")
    got = tables.series_json(df, ["k"], "t", "v").head().json
    pts = [[float(i), v] for i, v in enumerate(VALUES)]
    assert got == duckdb.execute("select to_json({'series': ?::double[][]})", [pts]).fetchall()[0][0]
