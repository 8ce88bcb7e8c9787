"""Sparse and dense vectors: TF-IDF, cosines, centring, background floors and related sections."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.functions import text as X
from corpusloom.operators.cells import nearest
from corpusloom.operators.ngram import held
from corpusloom.session import staged

SAMPLE, COMPONENTS, ITERATIONS = 3000, 2, 12
PAIRS = 4000
LIST = 300_000  # rows (id, term) of a part
BLOCK = 4096  # sections, and queries, that a task compares at once


def term_frequency(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.explode(X.term_words(text_col)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def chunk_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(tf: DataFrame, df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(id, term, weight) with unit length: tf * (ln((n + 1) / (df + 1)) + 1). `docs` is one row with n."""
    raw = F.col("tf") * (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    w = tf.join(df, "term", "left").join(F.broadcast(docs)).select(id_col, "term", raw.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.where(F.col(id_col).isNotNull()).select(id_col, "term", (F.col("w") / norm).alias("weight"))


def sparse_cosine(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id, cosine) of pairs that share a term: an inverted-index join on the term."""
    pairs = a.select(a_id, "term", F.col("weight").alias("wa")).join(b.select(b_id, "term", F.col("weight").alias("wb")), "term")
    return pairs.groupBy(a_id, b_id).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def crossed(a: DataFrame, b: DataFrame, a_id: str, b_id: str, parts_a: int, parts_b: int, run, schema: str) -> DataFrame:
    """run(a, b) on Arrow tables, for every part of a with every part of b.

    Rows are dealt to parts by a hash of their ids; each goes to as many tasks as
    the other side has parts, and pairs stay inside the task.
    """
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumn("part_a", part(a_id, parts_a)).withColumn("part_b", every(parts_b))
    right = b.withColumn("part_b", part(b_id, parts_b)).withColumn("part_a", every(parts_a))
    return left.groupBy("part_a", "part_b").cogroup(right.groupBy("part_a", "part_b")).applyInArrow(run, schema)


class Postings:
    """The rows of a part that have each term, with their weights."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, terms: int, n: int):
        order = np.argsort(codes, kind="stable")
        self.rows, self.weights, self.n = rows[order], weights[order], n
        self.starts = np.searchsorted(codes[order], np.arange(terms + 1))

    def scores(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of products with each row, and whether it shares a term."""
        own = [(slice(self.starts[c], self.starts[c + 1]), w) for c, w in zip(codes.tolist(), weights.tolist())]
        at = np.concatenate([self.rows[:0], *(self.rows[s] for s, _ in own)])
        shared = np.zeros(self.n, bool)
        shared[at] = True
        return np.bincount(at, np.concatenate([self.weights[:0], *(self.weights[s] * w for s, w in own)]), minlength=self.n).astype(np.float64), shared


def ninth_digit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x as whole billionths, and where floating point leaves open to which of two it is rounded: such rows are left to round()."""
    scaled = x * 1e9
    return np.floor(scaled + 0.5), ~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-4)


def sparse_nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, k: int) -> DataFrame:
    """(a_id, b_id, cosine, rank): the k rows of b that share a term with each of a and have the largest cosine, by nine digits and then b_id.

    a(a_id, term, weight) and b(b_id, term, weight) have unit length. Rows of b that
    have terms of a are read once, in parts of about LIST; a part adds up the lists
    of each of a's terms and gives its own k best, so no pair is shuffled but those.
    """
    a = staged(a.select(F.col(a_id).alias("a"), "term", F.col("weight").alias("wa")).where("term is not null"), "sparse-asked")
    own = b.select(F.col(b_id).alias("b"), "term", F.col("weight").alias("wb")).join(a.select("term").distinct(), "term", "left_semi")
    own = staged(own.select("b", "term", "wb"), "sparse-own")

    def best(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, rows = right["b"].combine_chunks().dictionary_encode(), right["term"].combine_chunks().dictionary_encode()
        asked = left["a"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(ids.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = Postings(place[ids.indices.to_numpy()], rows.indices.to_numpy(), right["wb"].to_numpy(), len(rows.dictionary), len(order))
        codes = pc.index_in(left["term"].combine_chunks(), rows.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        which, weights = asked.indices.to_numpy(), left["wa"].to_numpy()
        found = []
        for i in range(len(asked.dictionary)):
            mine = np.flatnonzero((which == i) & (codes >= 0))
            cosine, shared = lists.scores(codes[mine], weights[mine])
            digits, open_ = ninth_digit(cosine)
            at = np.flatnonzero(shared & ~open_)
            if len(at) > k:
                at = at[digits[at] >= np.partition(digits[at], -k)[-k]]
                at = at[np.lexsort((at, -digits[at]))[:k]]
            at = np.concatenate([at, np.flatnonzero(shared & open_)])
            found.append((np.full(len(at), i), order[at], cosine[at]))
        i, at, cosine = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"a": asked.dictionary.take(pa.array(i)), "b": ids.dictionary.take(pa.array(at)), "cosine": cosine})

    kinds = dict(a.dtypes) | dict(own.dtypes)
    pairs = crossed(a, own, "a", "b", _parts(a, LIST), _parts(own, LIST), best, f"a {kinds['a']}, b {kinds['b']}, cosine double")
    order = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    found = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("a").alias(a_id), F.col("b").alias(b_id), "cosine", "rank")


def _parts(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for lengths that differ and for zero vectors."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def mean_vector(vectors: DataFrame, vector_col: str) -> DataFrame:
    """One row: the mean of all vectors, as an array in order of dimension."""
    parts = vectors.select(F.posexplode(vector_col).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("mean"))


def with_unit(df: DataFrame, name: str, v: Column) -> DataFrame:
    """df with v at unit length; the norm is worked out once per row."""
    df = held(df, _v=v)
    df = held(df, _norm=F.sqrt(dot(F.col("_v"), F.col("_v"))))
    return df.withColumn(name, F.when(F.col("_norm") > 0, F.transform("_v", lambda x: x / F.col("_norm"))).otherwise(F.col("_v"))).drop("_v", "_norm")


def centred(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, cen): vectors less the mean, at unit length."""
    df = vectors.join(F.broadcast(mean_vector(vectors, vector_col)))
    return with_unit(df, "cen", F.zip_with(vector_col, "mean", lambda x, m: x.cast("double") - m)).select(id_col, "cen")


def group_vectors(vectors: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """(group, vec): the unit sum of each group's vectors, summed by dimension before the shuffle."""
    parts = vectors.select(group_col, F.posexplode(vector_col).alias("d", "x")).groupBy(group_col, "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    whole = parts.groupBy(group_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("v"))
    return with_unit(whole, "vec", F.col("v")).select(group_col, "vec")


def principal_components(vectors: DataFrame, id_col: str, vector_col: str, k: int = COMPONENTS) -> np.ndarray:
    """Leading directions by power iteration with deflation, on SAMPLE vectors by hash of their id."""
    rows = vectors.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(SAMPLE).select(vector_col).collect()
    if len(rows) < 8:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows], np.float64)
    out = []
    for c in range(max(1, min(k, len(x) // 8))):
        u = np.sin(np.arange(x.shape[1]) * 0.1 + 1 + c * 7.13)
        for _ in range(ITERATIONS):
            u = x.T @ (x @ u)
            u /= max(np.linalg.norm(u), 1e-300)
        out.append(u)
        x = x - np.outer(x @ u, u)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.array(out)


def without_components(df: DataFrame, vector_col: str, components: np.ndarray) -> DataFrame:
    """df with the components taken out of its unit vectors, one after the other."""
    for u in components:
        d = F.array(*(F.lit(float(x)) for x in u))
        df = held(df, _along=dot(F.col(vector_col), d))
        df = with_unit(df, vector_col, F.zip_with(vector_col, d, lambda x, y: x - F.col("_along") * y)).drop("_along")
    return df


def background(vectors: DataFrame, id_col: str, vector_col: str, pairs: int = PAIRS) -> DataFrame:
    """(s): cosines of random pairs, of unit vectors: neighbours in the order of a hash, PAIRS of them."""
    order = Window.orderBy("h", id_col)
    some = vectors.select(id_col, vector_col, F.md5(F.col(id_col).cast("string")).alias("h")).orderBy("h", id_col).limit(2 * pairs)
    numbered = some.withColumn("k", F.row_number().over(order) - 1)
    a = numbered.where(F.col("k") % 2 == 0).select((F.col("k") / 2).cast("int").alias("pair"), F.col(vector_col).alias("a"))
    b = numbered.where(F.col("k") % 2 == 1).select(((F.col("k") - 1) / 2).cast("int").alias("pair"), F.col(vector_col).alias("b"))
    return a.join(b, "pair").select(dot(F.col("a"), F.col("b")).alias("s"))


def floors(sims: DataFrame) -> DataFrame:
    """(sensitivity, floor): sorted[min(n - 1, floor(p * n))] for each percentile."""
    ranked = sims.select("s", (F.row_number().over(Window.orderBy("s")) - 1).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    levels = sims.sparkSession.createDataFrame([(k, p) for k, p in L.PERCENTILES.items()], "sensitivity int, p double")
    return levels.join(ranked, F.col("k") == F.least(F.col("n") - 1, F.floor(F.round(F.col("p") * F.col("n"), 9))), "left").select("sensitivity", F.coalesce("s", F.lit(1.0)).alias("floor"))


def note_shortlist(queries: DataFrame, sections: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, path): the k notes whose summed section vectors are nearest to each query; these may share no word with it."""
    notes = staged(group_vectors(sections, "path", "cen").withColumn("vec_id", F.monotonically_increasing_id()), "note-vectors")
    asked = staged(queries.select("query_id", F.col("q_cen").alias("embedding")).withColumn("vec_id", -1 - F.monotonically_increasing_id()), "note-queries")
    found = nearest(asked, notes.select("vec_id", F.col("vec").alias("embedding")), k).select(F.col("query_id").alias("asked"), "id")
    return found.join(asked.select("query_id", F.col("vec_id").alias("asked")), "asked").join(notes.select("path", F.col("vec_id").alias("id")), "id").select("query_id", "path")


def suggest_links(queries: DataFrame, sections: DataFrame, levels: dict[int, float]) -> DataFrame:
    """The twelve best sections of each query at the middle sensitivity."""
    return related(queries, sections, levels[3], levels[1], 12)


def related(queries: DataFrame, sections: DataFrame, floor: float, strong_floor: float, limit: int, corroborate: bool = False) -> DataFrame:
    """Sections that belong to each query, best first.

    queries(query_id, q_path, q_cen, q_terms) and sections(path, heading, sec_id,
    cen, terms): cen a unit vector, terms a map of TF-IDF weights. A section
    needs `floor` in the cosine; the score is 0.7 of that and 0.3 of the term
    cosine. One section per heading stays, two per path, `limit` in all; with
    `corroborate` a query needs as much evidence over the floor as lies between
    both floors.
    """
    by_note = note_shortlist(queries, sections).groupBy("query_id").agg(F.collect_set("path").alias("notes"))
    whole = lambda name: F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull())
    asked = queries.where(F.col("q_path").isNotNull() & whole("q_cen")).join(by_note, "query_id", "left")
    asked = asked.select("query_id", F.col("q_path").cast(sections.schema["path"].dataType).alias("q_path"), F.col("q_cen").cast("array<double>").alias("cen"), F.map_keys("q_terms").alias("terms"), F.map_values("q_terms").cast("array<double>").alias("weights"), F.coalesce("notes", F.array()).alias("notes"))
    listed = sections.where(F.col("path").isNotNull() & whole("cen"))
    listed = listed.select("sec_id", "path", "heading", F.lower(F.coalesce(F.col("heading").cast("string"), F.lit(""))).alias("head"), F.col("cen").cast("array<double>").alias("cen"), F.map_keys("terms").alias("terms"), F.map_values("terms").cast("array<double>").alias("weights"))
    kinds = dict(queries.dtypes) | dict(sections.dtypes)
    kept = f"query_id {kinds['query_id']}, sec_id {kinds['sec_id']}, path {kinds['path']}, heading {kinds['heading']}, semantic double, keyword double, score double"
    df = crossed(asked, listed, "query_id", "sec_id", _parts(queries, BLOCK), _parts(sections, BLOCK), _scorer(floor, None if corroborate else limit), kept)
    by = [F.desc(F.round("score", 9)), F.asc("sec_id")]
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "path", F.lower(F.coalesce("heading", F.lit("")))).orderBy(*by))).where("r = 1")
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*by))).where("r <= 2")
    evidence = F.sum(F.greatest(F.lit(0.0), F.greatest("semantic", F.lit(0.0)) - floor)).over(Window.partitionBy("query_id"))
    df = df.withColumn("evidence", evidence).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    if corroborate:
        df = df.where(F.col("evidence") >= max(1e-6, strong_floor - floor))
    return df.where(F.col("rank") <= limit).select("query_id", "rank", "path", "heading", "sec_id", "score", F.greatest("semantic", F.lit(0.0)).alias("semantic"), "keyword")


def _scorer(floor: float, limit: int | None):
    """What related() asks of a part of the queries and a part of the sections: scores of pairs that share a term or a note of the shortlist and reach the floor.

    Of these a part gives those that are its best of a heading, its two best of a path
    and (with a limit) its `limit` best of a query; what is so among all is so in its part.
    """

    def flat(column):
        import pyarrow.compute as pc

        column = column.combine_chunks()
        return column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        n, m = left.num_rows, right.num_rows
        # a path's and a heading's number, the same on both sides
        paths = right["path"].combine_chunks().dictionary_encode()
        path = paths.indices.to_numpy()
        code = lambda x, of: pc.index_in(x, of).fill_null(-1).to_numpy(zero_copy_only=False)
        q_path = code(left["q_path"].combine_chunks(), paths.dictionary)
        notes, note_at = flat(left["notes"])
        notes = code(notes.cast(paths.dictionary.type), paths.dictionary)
        heads = right["head"].combine_chunks().dictionary_encode()
        group = path.astype(np.int64) * (len(heads.dictionary) + 1) + heads.indices.to_numpy()
        order = pc.sort_indices(right["sec_id"].combine_chunks()).to_numpy()
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        words, word_at = flat(right["terms"])
        words = words.dictionary_encode()
        lists = Postings(np.repeat(np.arange(m), np.diff(word_at)), words.indices.to_numpy(), flat(right["weights"])[0].to_numpy(), len(words.dictionary), m)
        asked, asked_at = flat(left["terms"])
        asked, weights = code(asked, words.dictionary), flat(left["weights"])[0].to_numpy()
        (x, x_at), (y, y_at) = flat(left["cen"]), flat(right["cen"])
        x, y, sizes = x.to_numpy(), y.to_numpy(), np.diff(y_at)
        alike = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        matrices = {d: y[(y_at[:-1][at][:, None] + np.arange(d)).astype(np.int64)] for d, at in alike.items()}
        found = []
        for i in range(n):
            v = x[x_at[i] : x_at[i + 1]]
            if len(v) not in alike:
                continue
            sem = np.full(m, -np.inf)
            sem[alike[len(v)]] = matrices[len(v)] @ v
            for j in np.flatnonzero(np.abs(sem - floor) < 1e-9):  # a floor is a cosine itself: these are added up in dot()'s order
                sem[j] = np.cumsum(np.concatenate([[0.0], y[y_at[j] : y_at[j + 1]] * v]))[-1]
            fits = ((sem >= floor) | np.isnan(sem)) & (path != q_path[i])
            if not fits.any():
                continue
            own = slice(asked_at[i], asked_at[i + 1])
            known = asked[own] >= 0
            keyword, shared = lists.scores(asked[own][known], weights[own][known])
            fits &= shared | np.isin(path, notes[note_at[i] : note_at[i + 1]])
            score = L.SEMANTIC_WEIGHT * sem + L.KEYWORD_WEIGHT * keyword
            digits, open_ = ninth_digit(score)
            at = np.flatnonzero(fits & ~open_)
            at = at[np.lexsort((place[at], -digits[at]))]
            at = at[np.sort(np.unique(group[at], return_index=True)[1])]
            by_path = np.argsort(path[at], kind="stable")
            begins = np.searchsorted(path[at][by_path], path[at][by_path])
            at = at[np.sort(by_path[np.arange(len(at)) - begins < 2])][:limit]
            at = np.concatenate([at, np.flatnonzero(fits & open_)])
            found.append((np.full(len(at), i), at, sem[at], keyword[at], score[at]))
        i, at, sem, keyword, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0))
        own = right.select(["sec_id", "path", "heading"]).take(pa.array(at))
        own = own.add_column(0, "query_id", left["query_id"].take(pa.array(i)))
        for name, values in (("semantic", sem), ("keyword", keyword), ("score", score)):
            own = own.append_column(name, pa.array(values))
        return own

    return run
