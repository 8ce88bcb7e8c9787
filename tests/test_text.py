"""Text functions against their written-out results."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import channel as C
from corpusloom.functions import text as X
from corpusloom.operators import correct, engagement, ngram


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text,expected", [("The Cat's well-known U.S.A. a", ["the", "cat's", "well-known", "u.s.a", "a"]), ("", []), (None, []), ("123 !?", [])])
def test_tokenize_words(spark, text, expected):
    assert one(spark, X.tokenize_words("t"), t=text) == expected


def test_tokenize_cased(spark):
    assert one(spark, X.tokenize_words_cased("t"), t="It’s fine, OK?") == ["It's", "fine", ",", "OK", "?"]


@pytest.mark.parametrize(
    "token,following,expected",
    [("end.", "Next", True), ("Dr.", "Smith", False), ("3.", "x", False), ("X.Y.", "army", False), ("X.Y.", "Army", True), ("U.S.", "Army", False), ("what?!", "x", True), ("word", "x", False), ("i.e.", None, False), ("A.B.", None, True)],
)
def test_terminator(spark, token, following, expected):
    assert one(spark, X.is_sentence_terminator("t", F.col("n")), t=token, n=following) is expected


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Mr. Bell saw it. He left! -- Then"), (2, ""), (3, None), (4, "... ?")], "doc_id long, text string")
    got = {r["doc_id"]: r["sentences"] for r in ngram.sentences(df).collect()}
    assert got == {1: [["mr", "bell", "saw", "it"], ["he", "left"], ["then"]], 2: [], 3: [], 4: []}


def test_counts_and_probability(spark):
    df = spark.createDataFrame([(1, "the bank rose. the bank fell.")], "doc_id long, text string")
    counts = ngram.count(df)
    assert {(r["w1"], r["w"]): r["c"] for r in counts.bi.collect()} == {("<s>", "<s>"): 2, ("<s>", "the"): 2, ("the", "bank"): 2, ("bank", "rose"): 1, ("bank", "fell"): 1}
    asked = spark.createDataFrame([(None, None, "the"), (None, "the", "bank"), ("the", "bank", "rose"), (None, None, "zzz")], "w2 string, w1 string, w string")
    import math

    got = {(r["w2"], r["w1"], r["w"]): r["log_prob"] for r in ngram.log_prob(counts, asked).collect()}
    p_bank = 2 / (2 + 1 + 1e-9) * 1 + (1 - 2 / (2 + 1 + 1e-9)) * 2 / 6
    p_rose = 2 / 4 * (1 / 2) + (1 - 2 / 4) * (1 / 6)
    p_rose3 = 2 / 4 * (1 / 2) + (1 - 2 / 4) * p_rose
    assert got[None, None, "the"] == pytest.approx(math.log(2 / 6))
    assert got[None, "the", "bank"] == pytest.approx(math.log(p_bank))
    assert got["the", "bank", "rose"] == pytest.approx(math.log(p_rose3), abs=1e-6)
    assert got[None, None, "zzz"] == pytest.approx(math.log(1e-9))


def test_merge_takes_back_what_it_added(spark):
    a = ngram.count(spark.createDataFrame([(1, "one two. one.")], "doc_id long, text string")).bi
    b = ngram.count(spark.createDataFrame([(2, "two three.")], "doc_id long, text string")).bi
    assert sorted(ngram.merged(ngram.merged(a, b), b, -1).collect()) == sorted(a.collect())


@pytest.mark.parametrize("before,expected", [("the 2st", (4, "2nd")), ("1ST", None), ("11st", (0, "11th")), ("21th", (0, "21st")), ("1990's", (0, "1990s")), ("x2st", None), ("word", None)])
def test_numeric_suffix(spark, before, expected):
    got = one(spark, X.fix_numeric_suffix("t"), t=before)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("before,expected", [("add 1/2", (4, "½")), ("11/2", None), ("a/1/2", None), ("7/8", (0, "⅞"))])
def test_fraction(spark, before, expected):
    got = one(spark, X.fraction_glyph("t"), t=before)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "text,zone",
    [("---\na: b", "frontmatter"), ("---\na\n---\nx", "text"), ("```\nx", "codeBlock"), ("```\n~~~\n```\nx", "text"), ("a $$ b", "mathBlock"), ("a %% b", "comment"), ("a `b", "inlineCode"), ("cost $5", "mathInline"), ("see [[No", "wikilink"), ("see [x](ht", "linkUrl"), ("https://a", "linkUrl"), ("a #ta", "tag"), ("## He", "text"), ("mail a@b", "bareUrl"), ("plain", "text"), ("", "text")],
)
def test_zone(spark, text, zone):
    assert one(spark, X.markdown_zone("t"), t=text) == zone


@pytest.mark.parametrize("path,excluded", [("Archive/a.md", True), ("/notes/x.md", False), ("deep/tmp/x.md", True), ("tmp/x.md", True), ("a1.md", True), ("a12.md", False)])
def test_paths(spark, path, excluded):
    assert one(spark, X.path_excluded("t", ["archive", "**/tmp/*", "a?.md", " "]), t=path) is excluded


@pytest.mark.parametrize("before,expected", [("I AM HERE", True), ("I am HE", True), ("say HE ", False), ("SAY HE ", True), ("abc", False), ("", False)])
def test_caps_run(spark, before, expected):
    assert one(spark, X.upper_from_text("t"), t=before) is expected


def test_case_repairs(spark):
    assert one(spark, X.fix_double_capital("t"), t="THe") == "The"
    assert one(spark, X.fix_contraction("t"), t="Dont") == "don't"
    assert one(spark, X.capitalize_first("t"), t="'quote") == "'Quote"
    assert one(spark, X.harmonize_proper_case("t"), t="new York city") == "New York city"
    assert one(spark, X.harmonize_proper_case("t"), t="bank of England") == "bank of England"
    assert one(spark, X.auto_capitalized(F.col("t"), F.col("p"), F.lit(None).cast("string")), t="word", p="It ended. ") == "Word"
    assert one(spark, X.join_phrase(F.split("t", " ")), t="it s we ll go") == "it's we'll go"
    assert one(spark, X.stem("t"), t="running") == "run"


def test_sanitize(spark):
    assert one(spark, X.sanitize_for_model("t"), t="a `code` [x](u) [[n|see]] https://z.y b").split() == ["a", "x", "see", "b"]


def test_costs():
    assert C.weighted_edit("teh", "the") == pytest.approx(1.5)
    assert C.structural_edit("ca", "abc") == 3
    assert C.weighted_edit("tge", "the") < C.weighted_edit("tpe", "the")
    assert C.prefix_cost("mar", "smart") == 0
    assert C.phonetic_key("knight") == C.phonetic_key("nite")
    assert C.phonetic_cost("their", "there") < C.INF
    assert C.fold("Straße Éa") == "strasse ea"
    assert [k for k, _, _ in C.edit_operations("teh", "the")] == ["match", "trans"]


def test_learned_confusions_lower_costs():
    seen = C.Confusion()
    for _ in range(50):
        seen.counts.update(C.confusion_counts("tje", "the"))
    assert C.weighted_edit("tje", "the", seen) < C.weighted_edit("tje", "the", C.Confusion())


def test_neighbours_match_brute_force(spark):
    vocab = ["the", "then", "than", "they", "bank", "banks", "tank", "there", "their", "accept"]
    asked = ["teh", "bnak", "thier", "zzz"]
    v = spark.createDataFrame([(w,) for w in vocab], "w string")
    q = spark.createDataFrame([(w,) for w in asked], "typed string")
    got = {(r["typed"], r["w"]) for r in correct.neighbours(q, v).collect()}
    assert got == {(a, w) for a in asked for w in vocab if min(C.weighted_edit(a, w), C.phonetic_cost(a, w)) <= 4.0}


def test_decisions(spark):
    text = "the bank said the market rose. the bank said rates fell. investors like the bank. " * 6
    counts = ngram.count(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    asked = spark.createDataFrame([("a", "bnak", None, "the"), ("b", "bank", None, "the"), ("c", "x", None, None), ("d", "NASA", None, None), ("e", "dont", None, None), ("f", "qqqqqq", None, None)], "query_id string, token string, w2 string, w1 string")
    got = {r["query_id"]: (r["correct"], r["to"], r["reason"]) for r in correct.decide(counts, asked).collect()}
    assert got["a"] == (True, "bank", "corrected")
    assert got["b"][0] is False
    assert got["c"][2] == "too-short" and got["d"][2] == "acronym" and got["e"] == (True, "don't", "contraction")
    assert got["f"][0] is False


def test_menu_is_the_best_of_all():
    from itertools import combinations

    items = [(0.5, 3.0, "a"), (0.3, 5.0, "b"), (0.1, 9.0, "c"), (0.05, 1.0, "d"), (0.05, 0.0, "e")]
    value = lambda names: sum(p * (s - k) for k, (p, s, _) in enumerate([x for x in items if x[2] in names]))
    best = max((c for n in range(len(items)) for c in combinations("abcd", n)), key=value)
    assert value(engagement.best_menu(items)) == pytest.approx(value(best))
