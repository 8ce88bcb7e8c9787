"""Searches that join on keys, against brute force over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import channel as C
from corpusloom.operators import cells, correct, grams, links, predict, vectors

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def slips(rng, n):
    """Confusion counts of a typist with a few firm habits."""
    counts = Counter()
    for _ in range(n):
        word = "".join(rng.choice(LETTERS[:9]) for _ in range(6))
        typed = word.replace("c", "k").replace("e", "", 1).replace("ab", "ba")
        if rng.random() < 0.3:
            typed = "x" + typed
        counts.update(C.confusion_counts(typed, word))
    return C.Confusion(counts)


def edited(rng, word):
    out = list(word)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(out) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            out.insert(k, rng.choice("xk" + LETTERS))
        elif out and kind == 1:
            out[min(k, len(out) - 1)] = rng.choice("ck" + LETTERS)
        elif out and kind == 2:
            out.pop(min(k, len(out) - 1))
        elif len(out) > 1:
            k = min(k, len(out) - 2)
            out[k], out[k + 1] = out[k + 1], out[k]
    return "".join(out) or "e"


@pytest.mark.parametrize("habits", [0, 3, 400])
def test_candidates_are_complete_under_learned_costs(spark, habits):
    rng = random.Random(habits + 1)
    costs = slips(rng, habits) if habits else None
    vocab = sorted({"".join(rng.choice(LETTERS[:9]) for _ in range(rng.randint(1, 8))) for _ in range(150)})
    typed = sorted({edited(rng, rng.choice(vocab)) for _ in range(60)})
    got = {(r["typed"], r["w"]): r["cost"] for r in correct.near(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(w,) for w in vocab], "w string"), costs=costs).collect()}
    own = costs or C.Geometry()
    want = {}
    for t in typed:
        for w in vocab:
            cost = round(min(C.weighted_edit(t, w, own, 4.0), C.phonetic_cost(t, w)), 9)
            if cost <= 4.0:
                want[t, w] = cost
    assert got == want
    if habits == 400:
        plain = {(t, w) for t in typed for w in vocab if C.weighted_edit(t, w, most=4.0) <= 4.0}
        assert {k for k, v in want.items()} - plain, "habits bring no new candidates"
        sign = C.Signature(costs, 4.0)
        assert sign.folded("cab") == sign.folded("kab") and "e" in sign.silent and sign.depth == 2


def test_learned_costs_change_what_is_suggested(spark):
    pairs = spark.createDataFrame([("kat", "cat"), ("kar", "car"), ("kup", "cup")] * 400, "typed string, intended string")
    costs = correct.learned_costs(correct.confusion(pairs))
    asked, vocab = spark.createDataFrame([("kob",)], "typed string"), spark.createDataFrame([("cob",), ("lob",), ("job",)], "w string")
    best = lambda c: correct.neighbours(asked, vocab, costs=c).orderBy("cost").first()["w"]
    assert best(None) in ("job", "lob") and best(costs) == "cob"
    assert correct.learned_costs(correct.confusion(pairs), keys=3).counts.total() == sum(sorted((r["n"] for r in correct.confusion(pairs).collect()), reverse=True)[:3])


def test_confusion_costs_by_hand():
    own = C.Confusion(Counter({("seen", "c"): 30, ("sub", "c>k"): 15, ("seenCtx", "s|c"): 10, ("subCtx", "s|c>k"): 10, ("observations", ""): 60, ("ins", "x"): 6, ("trans", "a,b"): 12, ("del", "c"): 3}))
    base = C.substitution("c", "k")
    one = 0.6 * math.log(2) + 0.4 * base
    assert own.sub("c", "k", 1.0, None) == pytest.approx(one)
    assert own.sub("c", "k", 1.0, "s") == pytest.approx(2 / 3 * one)  # a third of 0, as all ten were slips
    assert own.sub("c", "k", 0.0, None) == pytest.approx(1.6 * one)
    assert own.add("x", 1.0) == pytest.approx(0.75 * math.log(10) + 0.25 * 2.3)
    assert own.swap("a", "b", 1.0) == pytest.approx(0.75 * math.log(5) + 0.25 * 1.5)
    assert own.drop("c", 1.0) == pytest.approx(0.6 * math.log(10) + 0.4 * 2.3)
    assert own.drop("z", 1.0) == 2.3 and own.sub("a", "A", 0.5, None) == 0.05 and own.sub("a", "a", 0.5, None) == 0.0


@pytest.mark.parametrize("limit", [2, 5, 64])
def test_prefix_neighbours_are_the_cheapest(spark, limit):
    rng = random.Random(limit)
    vocab = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    typed = sorted({edited(rng, rng.choice(vocab))[:3] for _ in range(15)})
    got = {}
    for r in predict.prefix_neighbours(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(w,) for w in vocab], "w string"), limit=limit).collect():
        got.setdefault(r["typed"], set()).add((r["w"], r["cost"]))
    for t in typed:
        least = {}
        for w in vocab:
            best = min(round(C.weighted_edit(t, w[:n], most=4.0), 9) for n in range(1, len(w) + 1))
            if best <= 4.0:
                least[w] = best
        want = sorted(least, key=lambda w: (least[w], len(w), w))[:limit]
        assert got.get(t, set()) == {(w, round(C.prefix_cost(t, w, most=4.0), 9)) for w in want}


def nearest(queries, vectors, k):
    size = Counter(len(v) for _, v in vectors if v).most_common(1)[0][0]
    fine = lambda v: v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    own = [(i, unit(v)) for i, v in vectors if fine(v)]
    out = set()
    for q, v in queries:
        if fine(v):
            found = sorted((-round(float(unit(v) @ x), 9), i) for i, x in own if i != q)[:k]
            out |= {(q, i, r + 1) for r, (_, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_is_exact(spark, clustered, monkeypatch):
    monkeypatch.setattr(cells, "PART", 40)
    monkeypatch.setattr(cells, "ASKED", 15)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    rows = [(k, (centres[k % 8] * clustered + rng.normal(scale=0.2 if clustered else 1.0, size=12)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # a large group of copies
    rows += [(2000, [0.0] * 12), (2001, None), (2002, [1.0] * 5), (2003, [float("nan")] + [0.0] * 11), (2004, []), (2005, [-x for x in rows[0][1]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int")
    asked = df.where("vec_id % 13 = 0 or vec_id >= 2000")
    got = {(r["query_id"], r["id"], r["rank"]) for r in cells.nearest(asked, df, 7).collect()}
    assert got == nearest([r for r in rows if r[0] % 13 == 0 or r[0] >= 2000], rows, 7)
    few = {(r["query_id"], r["id"]) for r in cells.nearest(asked, df.where("vec_id < 3"), 7).collect()}
    assert {i for _, i in few} == {0, 1, 2}
    assert cells.nearest(asked, df.where("false"), 7).count() == cells.nearest(df.where("false"), df, 7).count() == 0


def test_bounds_rule_cells_out(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + rng.normal(scale=0.05, size=16)).tolist()) for k in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = cells.fit(df, cells=40)
    first = cells._first_cells(index, index.members.select("id", "v"), 5).count()
    barred = index.members.select("id", "v", F.lit(0.5).alias("bar"))
    assert cells._other_cells(index, barred, 5).count() + first < 0.2 * 1000 * 40


def test_substrings_by_runs(spark, monkeypatch):
    monkeypatch.setattr(grams, "LIST", 20)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None]
    queries = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(40)}) + ["zz", None, ""]
    listed = grams.lists(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, body string"), "body")
    found = grams.containing(listed, "body", spark.createDataFrame([(q,) for q in queries], "query string"), "query")
    assert {(r["id"], r["query"]) for r in found.collect()} == {(k, q) for k, t in enumerate(texts) for q in queries if q and t is not None and q in t}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_titles_and_aliases(spark):
    notes = [(1, "Red fox", ["Fox", "ab"]), (2, "fox", ["Red Fox", "Vulpes"]), (3, "2024-01", ["January"]), (4, None, ["Nobody"]), (5, "Den", None)]
    index = links.titles(spark.createDataFrame(notes, "id long, title string, aliases array<string>"), "id", "title", "aliases")
    assert sorted(map(tuple, index.collect())) == [("den", "Den", "Den"), ("fox", "Red fox", "Fox"), ("january", "2024-01", "January"), ("red fox", "Red fox", "Red fox"), ("vulpes", "fox", "Vulpes")]
    found = links.search_titles(index, spark.createDataFrame([("FO",), ("",), ("zz",), (None,)], "query string"), 2)
    assert sorted(map(tuple, found.collect())) == [("", "2024-01", 1), ("", "Den", 2), ("FO", "Red fox", 1)]


def test_sparse_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST", 10)
    rng = random.Random(8)

    def unit(own):
        norm = math.sqrt(sum(x * x for x in own.values()))
        return {t: x / norm for t, x in own.items()}

    some = lambda: unit({f"t{int(rng.random() ** 2 * 40)}": rng.randint(1, 9) for _ in range(rng.randint(1, 12))})
    a, b = {k: some() for k in range(25)}, {k: some() for k in range(120)}
    b |= {500 + k: b[3] for k in range(30)}  # ties
    a[99] = {"nowhere": 1.0}
    table = lambda own, name: spark.createDataFrame([(k, t, x) for k, v in own.items() for t, x in v.items()], f"{name} long, term string, weight double")
    got = {(r["q"], r["d"], r["rank"]) for r in vectors.sparse_nearest(table(a, "q"), table(b, "d"), "q", "d", 4).collect()}
    want = set()
    for q, own in a.items():
        found = sorted((-round(sum(x * v[t] for t, x in own.items() if t in v), 9), d) for d, v in b.items() if own.keys() & v.keys())
        want |= {(q, d, r + 1) for r, (_, d) in enumerate(found[:4])}
    assert got == want
    assert vectors.sparse_nearest(table(a, "q").where("false"), table(b, "d"), "q", "d", 4).count() == 0


def test_sparse_nearest_writes_no_pairs(spark, monkeypatch):
    """rows written in between are rows (id, term) of the inputs, however many documents share a term."""
    written = []
    monkeypatch.setattr(vectors, "staged", lambda df, name, own=vectors.staged: (lambda out: (written.append(out.count()), out)[1])(own(df, name)))
    a = spark.createDataFrame([(k, t, 0.5) for k in range(40) for t in ("common", f"t{k % 7}")], "q long, term string, weight double")
    b = spark.createDataFrame([(k, t, 0.5) for k in range(300) for t in ("common", f"t{k % 5}")], "d long, term string, weight double")
    found = vectors.sparse_nearest(a, b, "q", "d", 3).collect()
    assert len(found) == 120 and max(written) <= 600
    assert {r["d"] for r in found if r["q"] == 0} == {0, 5, 10}


@pytest.mark.parametrize("corroborate", [False, True])
def test_related_deals_no_pairs_by_term(spark, monkeypatch, corroborate):
    """parts of queries meet parts of sections, and hold exactly what all pairs give."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(90):
        v = rng.normal(size=6) + 0.4
        own = rng.choice(12, rng.integers(1, 6), replace=False)
        rows.append((f"p{k % 45}", None if k % 7 == 0 else "Hh"[k % 2] + str(k % 3), k, (v / np.linalg.norm(v)).tolist(), {f"t{t}": float(1 / math.sqrt(len(own))) for t in own}))
    rows.append(("q", "short", 900, [1.0, 0.0], {"t1": 1.0}))  # another length is like nothing
    rows.append(("p1", "copy", 901, rows[3][3], rows[3][4]))
    sections = spark.createDataFrame(rows, "path string, heading string, sec_id long, cen array<double>, terms map<string,double>")
    asked = sections.where("sec_id % 9 = 0").selectExpr("sec_id query_id", "path q_path", "cen q_cen", "terms q_terms")
    short = {(r["query_id"], r["path"]) for r in vectors.note_shortlist(asked, sections.where("sec_id <> 900")).collect()}
    monkeypatch.setattr(vectors, "note_shortlist", lambda queries, _: spark.createDataFrame(sorted(short), "query_id long, path string"))
    floor = float(sum(x * y for x, y in zip(rows[0][3], rows[1][3])))
    found = vectors.related(asked, sections, floor, floor + 0.6, 5, corroborate)
    assert "Join Inner, (term" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for q_path, _, q, q_cen, q_terms in (r for r in rows if r[2] % 9 == 0):
        pool = []
        for path, heading, s, cen, terms in rows:
            if path != q_path and len(cen) == len(q_cen) and (q_terms.keys() & terms.keys() or (q, path) in short):
                sem = 0.0
                for x, y in zip(q_cen, cen):
                    sem += x * y
                if sem >= floor:
                    pool.append((-round(0.7 * sem + 0.3 * sum(w * terms.get(t, 0) for t, w in q_terms.items()), 9), s, path, (heading or "").lower(), sem))
        one, two, kept = set(), {}, []
        for score, s, path, heading, sem in sorted(pool):
            if (path, heading) not in one and two.get(path, 0) < 2:
                kept.append((s, sem))
                two[path] = two.get(path, 0) + 1
            one.add((path, heading))
        if not corroborate or sum(max(0.0, max(sem, 0.0) - floor) for _, sem in kept) >= 0.6:
            want |= {(q, k + 1, s) for k, (s, _) in enumerate(kept[:5])}
    assert want and {(r["query_id"], r["rank"], r["sec_id"]) for r in found.collect()} == want


def _rows_out(monkeypatch, module):
    """Rows that a module writes under each name."""
    written = {}

    def own(df, name, whole=module.staged):
        out = whole(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(module, "staged", own)
    return written


def test_tag_popup_keeps_few_hits_of_a_note(spark, monkeypatch):
    """however many tags share a leaf with a note's words, no more hits leave it than can be shown or are applied."""
    written = _rows_out(monkeypatch, links)
    tf = spark.createDataFrame([(d, f"word{t}", 1 + (d + t) % 4) for d in range(6) for t in range(8)], "id long, term string, tf long")
    counts = spark.createDataFrame([(f"{a}/word{t}", 1 + t) for t in range(8) for a in "uvxyz"] + [("word1", 2)], "tag string, n long")
    applied = spark.createDataFrame([(0, "z/word7"), (1, "word1")], "id long, tag string")
    rarity = spark.createDataFrame([(f"word{t}", 0.5 + t / 20) for t in range(8)], "w string, rarity double")
    asked = spark.createDataFrame([(d, "w") for d in range(6)], "id long, query string")
    found = {(r["id"], r["tag"]): (r["rank"], r["score"]) for r in links.tag_popup(tf, counts, applied, rarity, asked, "id").where("not is_new").collect()}
    assert written["tag-hits"] <= 6 * 6
    for d in range(6):
        have = {f"word{t}": 1 + (d + t) % 4 for t in range(8)}
        pool = []
        for r in counts.collect():
            leaf = r["tag"].split("/")[-1]
            if (d, r["tag"]) not in {(0, "z/word7"), (1, "word1")}:
                pool.append((-round(2 * (0.5 + have[leaf] * (2 if leaf == r["tag"] else 1)) * (0.5 + int(leaf[4:]) / 20) * math.log(r["n"] + 2), 9), r["tag"]))
        assert [t for t, _ in sorted(((t, found[d, t][0]) for (k, t) in found if k == d), key=lambda x: x[1])] == [t for _, t in sorted(pool)[:5]]


def test_suggest_tags_adds_up_once(spark):
    """terms and raw words are added up per tag, not per word first, and only hits that can be shown leave a note's task."""
    import re

    tf = spark.createDataFrame([(1, "cat", 2), (1, "dog", 1), (2, "dog", 3)], "id long, term string, tf long")
    raw = spark.createDataFrame([(1, "cat", 2), (2, "dog", 3), (2, "cat", 1)], "id long, term string, tf long")
    counts = spark.createDataFrame([("cat", 2), ("en/dog", 1), ("dog", 1)], "tag string, n long")
    applied = spark.createDataFrame([(2, "dog")], "id long, tag string")
    found = links.suggest_tags(tf, raw, counts, applied, "id", 2)
    assert not re.search(r"Aggregate \[id#\d+L?, term#", found._jdf.queryExecution().optimizedPlan().toString())
    want = {(1, "cat", 8 * math.log(3), 1), (1, "dog", 2 * math.log(2), 2), (2, "en/dog", 6 * math.log(2), 1), (2, "cat", 2 * math.log(3), 2)}
    assert {(r["id"], r["tag"], round(r["score"], 9), r["rank"]) for r in found.collect()} == {(i, t, round(s, 9), r) for i, t, s, r in want}
