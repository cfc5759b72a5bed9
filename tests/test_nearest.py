"""The nearest rows of many questions, against the cross join of all pairs."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.vectors import cosine
from docloom.operators import nearest

SCHEMA = "vec_id long, embedding array<float>"


def every_pair(rows, questions, k):
    scored = rows.crossJoin(questions).filter("vec_id <> q").withColumn("score", cosine(F.col("embedding"), F.col("qv"))).filter("score IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("n", nth).filter(F.col("n") <= k)


def best(df, k):
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return df.withColumn("n", nth).filter(F.col("n") <= k)


def test_nearest_of_each_question_equals_all_pairs(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 90), ("BLOCK_QUESTIONS", 7), ("TILE_ROWS", 16), ("TILE_QUESTIONS", 3)):
        monkeypatch.setattr(nearest, name, n)
    rng = np.random.default_rng(4)
    data = [(i, [float(np.float32(c)) for c in rng.normal(size=8)]) for i in range(300)]
    data += [(300 + i, data[10][1]) for i in range(40)]  # copies: ties go by id
    data += [(400, None), (401, [0.0] * 8), (402, [1.0, None, *[0.0] * 6]), (403, [1.0, 2.0]), (404, [2.0, 4.0]), (405, []), (406, [float("nan"), *[1.0] * 7]), (None, data[0][1]), (20, data[20][1])]
    rows = spark.createDataFrame(data, SCHEMA).repartition(5)
    questions = rows.filter("vec_id % 10 = 0 OR vec_id > 400").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    for k in (1, 2, 5):
        # NaN differs from itself
        got = sorted((r.q, r.n, r.vec_id, repr(r.score)) for r in best(nearest.nearest_each(rows, questions, k), k).collect())
        assert got == sorted((r.q, r.n, r.vec_id, repr(r.score)) for r in every_pair(rows, questions, k).collect())


def test_blocks_stay_bounded(spark):
    df = spark.range(0, 30_000).select(F.col("id").alias("vec_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    found = nearest.nearest_each(df, df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan  # no row a pair
    assert found.groupBy("q").count().filter("count < 2 OR count > 8").isEmpty()  # k rows of each of 4 blocks
