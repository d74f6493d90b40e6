import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import topk_search

NAN, INF = float("nan"), float("inf")


def brute(rows, k, queries):
    import math

    fit = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in fit:
        if queries(q):
            best = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in fit if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k, blocks=(4096, 4096)):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    v = topk_search.quantize(df)
    return sorted(tuple(r) for r in topk_search.exact_topk(v.where("id % 50 = 0"), v, k, *blocks).collect())


@pytest.mark.parametrize("blocks", [(4096, 4096), (2, 7), (1, 1000)])
def test_matches_brute_force_over_blocks(spark, blocks):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.7]) for _ in range(8)]) for i in range(260)]
    rows += [(300 + i, [0.25] * 8) for i in range(120)]  # a common vector: ties
    assert run(spark, rows, 5, blocks) == brute(rows, 5, lambda q: q % 50 == 0)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [NAN, 1.0]), (1, [INF, 0.0]), (2, [None, 1.0]), (3, [0.0, 0.0]), (4, [-0.001, 0.5]), (None, [1.0, 1.0]), (150, [])]
    assert run(spark, rows, 5) == brute(rows, 5, lambda q: q % 50 == 0)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0])], 5) == []
    assert run(spark, [], 5) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], 5) == [(0, 1, 1, 256 * 512)]


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0]), (3, [1.0]), (3, [1.0]), (2, [1.0])]
    assert [r[2] for r in run(spark, rows, 5)] == [2, 3, 3]


def test_query_rows_of_one_id_are_queries_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [i / 16, (20 - i) / 16]) for i in range(1, 20)]
    assert run(spark, rows, 5, (1, 3)) == run(spark, rows, 5) == brute(rows, 5, lambda q: q % 50 == 0)
    assert len(run(spark, rows, 5)) == 10


def test_only_answers_are_shuffled(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<float>")
    v = topk_search.quantize(df)
    out = topk_search.exact_topk(v.where("id % 50 = 0"), v, 5)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 10
