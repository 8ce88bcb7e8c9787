"""Zones of texts with long lines."""

import time

import pytest

from corpusloom.functions import zones
from corpusloom.functions import text as X


@pytest.mark.parametrize("text, zone", [("x" * 60_000, "text"), ("#" + "a/" * 60_000 + "!", "text"), ("- " * 60_000 + "#tag", "tag"), ("a" * 60_000 + "@b", "bareUrl"), ("$" + "x" * 60_000, "mathInline"), (None, "text")])
def test_long_lines_cost_what_their_length_does(spark, text, zone):
    df = spark.createDataFrame([(text,)] * 8, "t string")
    began = time.time()
    assert {r["z"] for r in df.select(X.markdown_zone("t").alias("z")).collect()} == {zone}
    assert time.time() - began < 15  # rules that try each letter as a beginning take a minute and more


def test_shouts_look_at_the_last_three_words():
    assert [zones.shouts(t) for t in ("A", "ab AB", "AB CD ", "AB CD E", "Ab CD E", "", None, "so AB CD")] == [False, True, True, True, False, False, False, True]
