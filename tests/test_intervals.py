"""Ranges against brute force, with bins narrower than most of them."""

import random

import pytest

from corpusloom.operators import intervals


def greedy(spans):
    out, end = set(), None
    for low, high in sorted({s for s in spans if s[0] < s[1]}, key=lambda s: (s[0], -s[1])):
        if end is None or low >= end:
            out.add((low, high))
            end = high
    return out


@pytest.mark.parametrize("width,reach", [(8, 5), (8, 60), (4096, 30)])
def test_ranges(spark, monkeypatch, width, reach):
    monkeypatch.setattr(intervals, "WIDTH", width)
    rng = random.Random(width + reach)
    some = lambda n: [(rng.choice("xyz"), low := rng.randint(0, 200), low + rng.randint(0, reach)) for _ in range(n)]
    a, b = some(120), some(40)
    schema = "doc string, `from` int, `to` int"
    odd = [("x", 9, 3), ("x", None, 3), (None, 1, 3), ("y", 1, None)]
    left, right = spark.createDataFrame(a + odd, schema), spark.createDataFrame(b + odd, schema)
    tuples = lambda df: sorted(map(tuple, df.collect()))
    meets = lambda s, t: s[0] == t[0] and max(s[1], t[1]) < min(s[2], t[2])
    assert tuples(intervals.overlaps(left, right, "doc").select("doc", "from", "to", "b_from", "b_to")) == sorted((*s, *t[1:]) for s in a for t in b if meets(s, t))
    assert tuples(intervals.inside(left, right, "doc").select("doc", "from", "to", "b_from", "b_to")) == sorted((*s, *t[1:]) for s in a for t in b if s[0] == t[0] and t[1] <= s[1] and s[2] <= t[2] and (t[1] < t[2] or s[1:] == t[1:]))
    assert tuples(intervals.clear(left, right, "doc").select("doc", "from", "to")) == sorted(s for s in a if not any(meets(s, t) for t in b))
    want = sorted((d, *s) for d in "xyz" for s in greedy([s[1:] for s in a if s[0] == d]))
    assert tuples(intervals.chosen(left, "doc")) == want
    assert intervals.chosen(left.where("false"), "doc").count() == intervals.overlaps(left.where("false"), right, "doc").count() == 0


def test_a_long_text_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "WIDTH", 64)
    df = spark.range(5000).selectExpr("'d' as doc", "cast(id * 10 as int) as `from`", "cast(id * 10 + 9 as int) as `to`")
    own = intervals.clusters(df, "doc")
    assert own.select("cluster").distinct().count() == 5000
    assert intervals.chosen(df, "doc").count() == 5000
