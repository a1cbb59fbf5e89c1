import math
import random

import numpy as np

from skarn.operators import search, vectors


def test_probed_lists_find_the_nearest(spark, tmp_path):
    rng = random.Random(1)
    middle = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in middle[i % 12]]) for i in range(900)] + [(1000, [0.0] * 16), (1001, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vectors.build(v, f"file://{tmp_path}/v", 24)
    assert index.rows.count() == 901 and len(index.centre) == 24
    asked = v.where("vec_id % 50 = 0 AND vec_id < 900")
    true = search.nearest(asked, v)
    assert vectors.recall(index.nearest(asked), true).first()[0] >= 0.95
    every = index.nearest(asked, probes=24)
    key = lambda d: sorted((r.query_id, r.vec_id, r.place, round(r.cosine, 9)) for r in d.where("cosine IS NOT NULL").collect())
    assert key(every) == key(true)
    plan = index.nearest(asked).select("vec_id")._jdf.queryExecution().toString()
    assert "list#" in plan


def test_few_and_no_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in vectors.build(v, f"file://{tmp_path}/a", 8).nearest(v).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    empty = v.limit(0)
    assert vectors.train(empty, 4).shape[0] == 0
    assert vectors.build(empty, f"file://{tmp_path}/b").nearest(v).count() == 0


def test_exact_ranks_equal_plain_sums_on_odd_vectors(spark):
    rng = random.Random(4)
    word = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    rows = [[float(np.float32(x)) for x in rng.choice(word)] for _ in range(300)] + [None, [0.0] * 5, [1.0, 2.0], [1.0, None, 1.0, 1.0, 1.0], [], [float("nan")] * 5] + [[x * 2 for x in word[0]]] * 30
    v = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        total, one, two = 0.0, 0.0, 0.0
        for x, y in zip(a, b, strict=True):
            total, one, two = total + x * y, one + x * x, two + y * y
        both = math.sqrt(one) * math.sqrt(two)
        return None if both == 0 else total / both

    want = set()
    for i in range(0, len(rows), 3):
        own = [(j, cosine(rows[i], rows[j])) for j in range(len(rows)) if j != i]
        own.sort(key=lambda t: (t[1] is None, -(math.inf if t[1] is not None and math.isnan(t[1]) else t[1] or 0), t[0]))
        want |= {(i, j, repr(c), place) for place, (j, c) in enumerate(own[:10], 1)}
    for blocks in (1, 7):
        got = search.nearest(v.where("vec_id % 3 = 0"), v, 10, blocks).collect()
        assert {(r.query_id, r.vec_id, repr(r.cosine), r.place) for r in got} == want and len(got) == len(want)


def test_no_row_is_made_for_a_pair(spark):
    v = spark.range(600).selectExpr("id AS vec_id", "array(sin(id), cos(id), 1D) AS embedding")
    plan = search.nearest(v.where("vec_id % 2 = 0"), v)._jdf.queryExecution().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
