"""Change points against the plain program over all starts."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import changepoints


def by_hand(values, least=14, penalty=40_000):
    n, s, q = len(values), [0], [0]
    for x in values:
        s.append(s[-1] + x)
        q.append(q[-1] + x * x)

    def segment(a, e):
        k, t, u = e - a + 1, s[e + 1] - s[a], q[e + 1] - q[a]
        v = 1 + (k * u - t * t) // (k * k)
        return k * math.floor(1000 * math.log(v)), t, v

    best = {}  # cost, number of segments, starts from the last one backwards
    for e in range(n):
        found = [(segment(0, e)[0], 1, (0,))] if e + 1 >= least or n < least else []
        found += [(best[a - 1][0] + penalty + segment(a, e)[0], best[a - 1][1] + 1, (a, *best[a - 1][2])) for a in range(least, e - least + 2)]
        if found:
            best[e] = min(found)
    starts = sorted(best[n - 1][2])
    out = []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        c, t, v = segment(a, b - 1)
        out.append((a, b - a, t, v, c, best[n - 1][0]))
    return out


def series(r, n):
    level, out = r.choice([0, 5, 100, 3000]), []
    for _ in range(n):
        if r.random() < 0.05:
            level = r.choice([0, 5, 100, 3000])
        out.append(max(0, int(r.gauss(level, level**0.5))) if r.random() < 0.8 else 0)
    return np.array(out)


@pytest.mark.parametrize(("least", "penalty"), [(14, 40_000), (14, 0), (14, 300), (1, 50), (2, 1000), (5, 0)])
def test_every_start_is_considered(least, penalty):
    r = random.Random(1)
    given = [series(r, r.choice([1, 5, 13, 14, 15, 27, 28, 29, 40, 60, 149])) for _ in range(60)]
    given += [np.zeros(50, np.int64), np.array([3] * 100 + [3] * 40), np.array(([1] * 20 + [9] * 20) * 4)]  # ties
    assert changepoints.solve(given, least, penalty) == [by_hand(v.tolist(), least, penalty) for v in given]


def test_long_series_and_great_numbers():
    r = random.Random(2)
    given = [np.array([0] * 600 + [5] * 20), series(r, 700), np.array([r.randint(0, 10**10) for _ in range(60)])]
    assert changepoints.solve(given) == [by_hand(v.tolist()) for v in given]


def test_blocks_are_left_closed():
    r = random.Random(3)
    given = np.array([[r.randint(0, 1) + (500 if i < 400 else 50) + 5 * (i % 400 < 60) for i in range(800)]])
    search = changepoints.Search(given, np.array([800]), 14, 40_000)
    search.run()
    assert search.opened * changepoints.FAN < 0.1 * 800 * 800 / 2


def test_rows_of_a_table(spark):
    r = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    rows = [(v, r.choice([None, 1, 2, 50]), None if r.random() < 0.1 else day + datetime.timedelta(days=r.randint(0, 80), hours=r.randint(0, 23)), "x") for v in (1, 2, None) for _ in range(300)]
    rows += [rows[0]] * 5 + [(9, 7, day, "x"), (8, None, day, "x"), (7, 1, None, "x")]
    found: dict = {}
    df = spark.createDataFrame(rows, "v long, n int, t timestamp, key string").repartition(3)
    for x in changepoints.segments(df, "v", F.col("n"), F.unix_date(F.to_date("t"))).orderBy("v", "segment_no").collect():
        found.setdefault(x["v"], []).append(tuple(x)[1:])
    want = {}
    for v in (1, 2, None, 9):
        daily: dict[int, int] = {}
        for w, n, t, _ in rows:
            if w == v and n is not None and t is not None:
                d = (t.date() - datetime.date(1970, 1, 1)).days
                daily[d] = daily.get(d, 0) + n
        first = min(daily)
        cuts = by_hand([daily.get(d, 0) for d in range(first, max(daily) + 1)])
        want[v] = [(j + 1, first + a, n, s, x, c, len(cuts), whole) for j, (a, n, s, x, c, whole) in enumerate(cuts)]
    assert found == want


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "v long, n int, t timestamp")
    assert changepoints.segments(df, "v", F.col("n"), F.unix_date(F.to_date("t"))).count() == 0
