"""Each query row has its own best candidates, also where query rows share an id."""

from pyspark.sql import functions as F

from quoin.llm import op9_topk


def test_query_rows_with_one_id(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)]
    ask = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [-1.0, 0.0])]
    got = op9_topk.top_k(spark.createDataFrame(rows + ask, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 5).collect()
    every, want = rows + ask, []
    for i in (8, 9, 10):
        best = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(every[i][1], v)), k) for j, (k, v) in enumerate(every) if j != i)[:5]
        want += [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_sql_twin_on_repeated_rows(spark):
    import duckdb

    rows = [(i % 7 * 50, [float(i % 3), -float(i % 2), 0.5]) for i in range(21)] + [(None, [1.0, 1.0, 1.0]), (50, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    embeddings = df.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(op9_topk.ORACLE).fetchall())
    assert sorted(map(tuple, op9_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == want
