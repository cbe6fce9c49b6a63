"""The R-tree's search against plain sorting, with small nodes so that the tree has levels."""

import random

import numpy as np
from pyspark.sql import functions as F

from helixmill.llm import hard_negatives as hn

SMALL = hn.Sizes(leaf=8, tile=32, fan=3, file=1, held=30_000)


def plain(rows):
    """Brute force over (vec_id, label, q)."""
    width = max((len(q) for *_, q in rows), default=0)
    q = np.array([list(x) + [0] * (width - len(x)) for *_, x in rows], np.int64).reshape(len(rows), width)
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor % 100:
            continue
        order = sorted((-int(s), v, l, k) for k, (s, (v, l, _)) in enumerate(zip(q @ q[a], rows)))
        for minus, positive, *_ in [o for o in order if o[2] == label and o[1] != anchor][:5]:
            inside = [o for o in order if o[2] != label and 80 * -minus <= 100 * -o[0] <= 100 * -minus][:5]
            out += [(anchor, positive, k + 1, v, -minus, -s) for k, (s, v, *_) in enumerate(inside)]
    return sorted(out)


def search(spark, rows, sizes=SMALL):
    df = spark.createDataFrame(rows, hn.VECTORS).repartition(3)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 100 == 0, sizes).collect()))


def test_levels_ties_and_repeats(spark):
    rng = random.Random(4)
    few = [[rng.randint(-2, 2) * 100 for _ in range(3)] for _ in range(6)]
    rows = [(rng.choice([rng.randint(0, 900), 100 * rng.randint(0, 9)]), rng.choice([0, 0, 1, -2]), rng.choice([rng.choice(few), few[0], [rng.randint(-99, 99) for _ in range(5)], [], [7]])) for _ in range(700)]
    assert search(spark, rows) == plain(rows)


def test_scores_beyond_doubles(spark):
    rng = random.Random(5)
    rows = [(k * 20, k % 3, [rng.choice([-1, 1]) * (hn.LARGEST - rng.randint(0, 3)) for _ in range(64)]) for k in range(60)]
    assert hn.shape_of(spark.createDataFrame(rows, hn.VECTORS)).exact is False
    assert search(spark, rows) == plain(rows)


def test_one_vector_for_a_third_of_the_rows(spark):
    rng = random.Random(6)
    rows = [(k, k % 4, [50, 50, 50] if k % 3 == 0 else [rng.randint(-90, 90) for _ in range(3)]) for k in range(900)]
    assert search(spark, rows) == plain(rows)


def test_only_what_takes_part(spark):
    rows = [(1, [0.5], 1), (2, [float("nan")], 1), (3, [1.0, None], 1), (4, None, 1), (5, [0.001], None), (None, [1.0], 1), (7, [float("-inf")], 2), (8, [1e30, -0.001], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, hn.quantised(df).collect())) == [(1, 1, [128]), (8, 2, [hn.LARGEST, -1])]
    assert search(spark, []) == [] and search(spark, [(100, 1, [5])]) == []
