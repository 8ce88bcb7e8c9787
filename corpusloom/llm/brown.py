"""Language-model scoring by a class-based bigram model (Brown classes).

P(text) is the product over its tokens, an end token last, of
P(class | class before) * P(word | class). Every word of the training texts is
assigned to one of CLASSES classes by exchange, in two steps:

1. On the driver, exchange clustering moves units between classes, each to the
   class that raises the likelihood of the class bigrams most, until a sweep
   gains less than GAIN nats a token. Units are the HEADS most frequent words
   and TYPES endings (a type of a word's last three bytes) that stand for all
   others; their table is (HEADS + TYPES + 1) squared, whatever the corpus.
2. In distributed sweeps every other word of the vocabulary moves to the class
   in which the neighbours of all its occurrences, and the word itself, are
   likeliest; the transitions are counted anew after each sweep, until one
   gains less than GAIN nats a token. A word's neighbours are counted by class
   and kept in its hash bucket, so sweeps read these counts and no text.

Endings only give a word its first class, and unseen words their only one.
Transitions are counted over all training tokens with these final classes and
smoothed towards class frequencies. Emissions use absolute discounting: a word
counted c > 0 times has (c - DISCOUNT) / total(class), and what that frees is
shared by as many unseen words as seen ones, DISCOUNT / total(class) each.

Counts cover every training document. Words are counted by 64-bit hash: blocks
of texts send their distinct words, packed by hash bucket, and a bucket adds
them up. For scoring, a chunk of documents asks the buckets for the counts of
its distinct words, and their classes, and gets them back in the same order, so
a frequent word costs one number per chunk. The documents' exchange serves asking and scoring.

Ties go to the lesser class, and among equally frequent words to the lesser
hash. Texts of any length are read whole; a block holds one long text at most.
A null text counts as empty: it holds the end token alone. A null id is scored
but not trained on. Repeated rows are trained on and scored each. Without
training documents all counts are zero and scores stay finite. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import Words, blocks, mix64, release
from corpusloom.llm.toxicity import remainder
from corpusloom.session import staged

HEADS, TYPES, CLASSES = 1000, 512, 64
GAIN = 1e-3  # nats a token under which clustering has converged
DISCOUNT = 0.75
PRIOR = 20.0  # pseudo-counts of a class's transitions
CHUNK = 8_000_000  # characters of text to a chunk, about
PER_BUCKET = 12_000_000
ROWS = 16  # rows of the unit bigram table to a part


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return mix64(hashes + np.uint64(99)) % np.uint64(buckets)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes sorted by bucket, where the buckets begin, each hash's place among them)."""
    distinct, back = np.unique(hashes, return_inverse=True)
    own = _bucket(distinct, buckets)
    order = np.argsort(own, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], np.searchsorted(own[order], np.arange(buckets + 1, dtype=np.uint64)), place[back]


def counted(docs: DataFrame, buckets: int, top: int = HEADS) -> DataFrame:
    """(bucket, hashes, counts, top_hashes, top_counts) over the words of docs(text); hashes are sorted."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=6 << 20):
            distinct, at, place = _by_bucket(Words(block["text"], lower=True).hashes(), buckets)
            n = np.bincount(place, minlength=len(distinct))
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([distinct[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([n[at[b] : at[b + 1]].astype("<i8").tobytes() for b in full], pa.binary())], ["bucket", "hashes", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("counts")])
        distinct, back = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, counts)
        most = np.lexsort((distinct, -total))[:top]
        row = {"bucket": pa.array([key[0].as_py()], pa.int32()), "hashes": [distinct.tobytes()], "counts": [total.astype("<i8").tobytes()], "n": pa.array([len(distinct)], pa.int64()), "total": pa.array([int(total.sum())], pa.int64())}
        row |= {"top_hashes": [distinct[most].view(np.int64).tolist()], "top_counts": [total[most].tolist()]}
        return pa.table(row)

    sent = docs.select("text").mapInArrow(send, "bucket int, hashes binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "bucket int, hashes binary, counts binary, n long, total long, top_hashes array<long>, top_counts array<long>")


@dataclass
class Units:
    """Heads, endings and the end token as numbers."""

    heads: np.ndarray  # sorted hashes
    types: int

    @property
    def end(self) -> int:
        return len(self.heads) + self.types

    def of(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Each word's unit."""
        ending = np.zeros(len(hashes), np.uint64)
        for k in range(1, 4):
            at = words.ends - k
            ending = ending * np.uint64(256) + np.where(at >= words.starts, words.buffer[np.maximum(at, 0)], 0).astype(np.uint64)
        unit = len(self.heads) + (mix64(ending) % np.uint64(self.types)).astype(np.int64)
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
            unit = np.where(self.heads[at] == hashes, at, unit)
        return unit

    def chain(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(before, unit) of every token: the words and an end for each text; texts begin after an end."""
        docs = len(words.counts)
        every = np.full(len(hashes) + docs, self.end, np.int64)
        at = np.arange(len(hashes)) + words.doc
        every[at] = self.of(words, hashes)
        before = np.concatenate([[self.end], every[:-1]])
        return before, every


def unit_bigrams(docs: DataFrame, units: Units) -> np.ndarray:
    """Counts of (before, unit) over docs(text), added up in two levels by parts of the table."""
    size = units.end + 1
    parts = -(-size // ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for block in blocks(batches, most=2 << 20):
            words = Words(block["text"], lower=True)
            before, unit = shared.value.chain(words, words.hashes())
            total += np.bincount(before * size + unit, minlength=size * size)
        if total.any():
            rows = [total[p * ROWS * size : (p + 1) * ROWS * size].astype("<i8").tobytes() for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(rows, pa.binary())], ["part", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("counts"):
            own = np.frombuffer(x.as_buffer(), "<i8")
            total = own.copy() if total is None else total + own
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    sent = docs.select("text").mapInArrow(send, "part int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = sent.groupBy("part", "salt").applyInArrow(add, "part int, counts binary")
    out = np.zeros((size, size), np.int64)
    for row in some.groupBy("part").applyInArrow(add, "part int, counts binary").toLocalIterator():
        own = np.frombuffer(row["counts"], "<i8").reshape(-1, size)
        out[row["part"] * ROWS : row["part"] * ROWS + len(own)] = own
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams under their own frequencies, without the words' share, which classes don't change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def exchange(bigrams: np.ndarray, classes: int = CLASSES, gain_of: float = GAIN) -> np.ndarray:
    """The class of each unit."""
    size = len(bigrams)
    n = bigrams.astype(float)
    weight = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    own = np.empty(size, np.int64)
    own[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    table = member.T @ n @ member
    before = likelihood(table)
    while True:
        for u in order:
            if not weight[u]:
                continue
            a, self_ = own[u], n[u, u]
            right = np.bincount(own, weights=n[u], minlength=classes)
            left = np.bincount(own, weights=n[:, u], minlength=classes)
            right[a] -= self_
            left[a] -= self_
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= self_
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            base = _xlogx(table)
            gain = (_xlogx(table + right[None, :]) - base).sum(axis=1) + (_xlogx(table + left[:, None]) - base).sum(axis=0)
            d = np.diag(table)
            gain += _xlogx(d + right + left + self_) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            gain -= _xlogx(rows + left + right.sum() + self_) - _xlogx(rows + left)
            gain -= _xlogx(columns + right + left.sum() + self_) - _xlogx(columns + right)
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else int(a)
            table[b] += right
            table[:, b] += left
            table[b, b] += self_
            own[u] = b
        now = likelihood(table)
        if now - before <= gain_of * max(n.sum(), 1):
            return own
        before = now


def contexts(docs: DataFrame, units: Units, own: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, hashes, start, word, kind, n): for the words of docs(text) beyond the heads, how often a neighbour is of a class.

    kind counts the classes of words before from 0 and of words after from
    CLASSES; start is the class of a word's ending.
    """
    shared = docs.sparkSession.sparkContext.broadcast((units, own))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, own = shared.value
        for block in blocks(batches, most=3 << 20):
            words = Words(block["text"], lower=True)
            hashes = words.hashes()
            before, unit = units.chain(words, hashes)
            at = np.arange(len(hashes)) + words.doc
            rare = np.flatnonzero(unit[at] >= len(units.heads))
            at = at[rare]
            distinct, begins, place = _by_bucket(hashes[rare], buckets)
            order = np.argsort(place, kind="stable")
            kinds = np.stack([own[before[at]], CLASSES + own[unit[at + 1]]], axis=1).astype(np.uint8)[order]
            start = np.zeros(len(distinct), np.uint8)
            start[place] = own[unit[at]]
            n = np.bincount(place, minlength=len(distinct)).astype("<i4")
            ends = np.concatenate([[0], np.cumsum(n)])
            full = np.flatnonzero(np.diff(begins))
            cut = [(begins[b], begins[b + 1]) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in ([distinct[i:j].tobytes() for i, j in cut], [start[i:j].tobytes() for i, j in cut], [n[i:j].tobytes() for i, j in cut], [kinds[ends[i] : ends[j]].tobytes() for i, j in cut]))], ["bucket", "hashes", "start", "n", "kinds"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        def every(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        hashes, start, n, kinds = every("hashes", np.uint64), every("start", np.uint8), every("n", "<i4"), every("kinds", np.uint8)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys = np.repeat(back, 2 * n) * (2 * CLASSES) + kinds
        keys, counts = np.unique(keys, return_counts=True)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("hashes", distinct), ("start", start[first]), ("word", (keys // (2 * CLASSES)).astype("<i4")), ("kind", (keys % (2 * CLASSES)).astype(np.uint8)), ("n", counts.astype("<i4")))}})

    sent = docs.select("text").mapInArrow(send, "bucket int, hashes binary, start binary, n binary, kinds binary")
    return sent.groupBy("bucket").applyInArrow(gather, "bucket int, hashes binary, start binary, word binary, kind binary, n binary")


@dataclass
class Neighbours:
    """What the sweeps count for each class: tokens by the class before and after, and all tokens."""

    before: np.ndarray  # (class, class before)
    after: np.ndarray  # (class, class after)

    def fit(self) -> np.ndarray:
        """(2 * CLASSES + 1, CLASSES): log-likelihoods of a neighbour and of the word itself, per occurrence, in each class."""
        total = self.before.sum(axis=1)
        into = np.log(self.before + 0.1) - np.log(self.before.sum(axis=0) + 0.1 * CLASSES)[None, :]  # this class after that one
        out = np.log(self.after + 0.1) - np.log(total + 0.1 * CLASSES)[:, None]
        return np.concatenate([into.T, out.T, -np.log(np.maximum(total, 1))[None, :]])


def assigned(found: dict[str, np.ndarray], fit: np.ndarray | None, step: int = 16_384) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(words, their counts of neighbours, their classes) of one bucket, in parts; without a fit, the first classes."""
    word, words = found["word"], len(found["start"])
    for low in range(0, words, step):
        high = min(words, low + step)
        at, to = np.searchsorted(word, [low, high])
        counts = np.zeros((high - low, 2 * CLASSES), np.float32)
        counts[word[at:to] - low, found["kind"][at:to]] = found["n"][at:to]
        if fit is None:
            yield slice(low, high), counts, found["start"][low:high].astype(np.int64)
        else:
            score = counts.astype(float) @ fit[:-1] + counts[:, :CLASSES].sum(axis=1, dtype=float)[:, None] * fit[-1][None, :]
            yield slice(low, high), counts, score.argmax(axis=1)


def unpacked(row: dict) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(row[k].as_buffer(), t) for k, t in (("hashes", np.uint64), ("start", np.uint8), ("word", "<i4"), ("kind", np.uint8), ("n", "<i4"))}


def swept(found: DataFrame, fit: np.ndarray | None) -> np.ndarray:
    """Counts (class, 2 * CLASSES) of neighbours once every word has its class, over all buckets, added up in two levels."""
    shared = found.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 2 * CLASSES))
        for batch in batches:
            for row in batch.to_struct_array():
                for _, counts, own in assigned(unpacked(row), shared.value):
                    np.add.at(total, own, counts)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    return added(found.select("hashes", "start", "word", "kind", "n").mapInArrow(run, "counts binary")).reshape(CLASSES, 2 * CLASSES)


def added(sent: DataFrame) -> np.ndarray:
    """The sum of packed tables (counts) of one size, in two levels; one table reaches the driver."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in table.column("counts"))
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})

    some = sent.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("salt").applyInArrow(add, "counts binary")
    one = some.withColumn("salt", F.lit(0)).groupBy("salt").applyInArrow(add, "counts binary").first()
    return np.frombuffer(one["counts"], "<i8") if one else np.zeros(2 * CLASSES * CLASSES, np.int64)


@dataclass
class Model:
    units: Units
    own: np.ndarray  # class of each unit
    fit: np.ndarray | None  # what words gain in each class
    total: np.ndarray  # each class's tokens
    ends: int  # end tokens in training
    tokens: int
    types: int  # distinct tokens in training
    gains: list[float]  # nats a token that the sweeps over the vocabulary brought


def clustered(docs: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """The classes and (bucket, hashes, counts, classes) of all words, from all of docs(text)."""
    table = staged(counted(docs, buckets), "brown-counts")
    words, types = table.agg(F.sum("total"), F.sum("n")).first()
    ends = docs.count()
    most = table.select(F.explode(F.arrays_zip("top_hashes", "top_counts")).alias("x")).orderBy(F.col("x.top_counts").desc(), "x.top_hashes").limit(HEADS)
    heads = np.sort(np.array([r[0] for r in most.select("x.top_hashes").collect()], np.int64).view(np.uint64))
    units = Units(heads, TYPES)
    bigrams = unit_bigrams(docs, units)
    own = exchange(bigrams)
    found = staged(contexts(docs, units, own, buckets), "brown-contexts")
    member = np.zeros((len(own), CLASSES))
    member[np.arange(len(own)), own] = 1
    among = member.T @ bigrams @ member
    fixed = np.ones(len(own), bool)  # heads and the end keep their classes
    fixed[len(heads) : units.end] = False
    own_after, own_before = (member * fixed[:, None]).T @ bigrams @ member, (member * fixed[:, None]).T @ bigrams.T @ member
    fit, gains, tokens = None, [], max(among.sum(), 1)
    while True:
        counts = swept(found, fit)
        now = Neighbours(own_before + counts[:, :CLASSES], own_after + counts[:, CLASSES:])
        value = _xlogx(now.before).sum() + _xlogx(now.after).sum() - 2 * _xlogx(now.before.sum(axis=1)).sum()
        gains.append(float(value) / tokens)
        if len(gains) > 1 and gains[-1] - gains[-2] <= GAIN:
            break
        fit = now.fit()
    shared = docs.sparkSession.sparkContext.broadcast((units, own, fit))

    def label(known: pa.Table, near: pa.Table) -> pa.Table:
        units, own, fit = shared.value
        row = known.to_pylist()[0]
        hashes, counts = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], "<i8")
        kinds = np.zeros(len(hashes), np.uint8)
        if len(units.heads):
            at = np.minimum(np.searchsorted(units.heads, hashes), len(units.heads) - 1)
            kinds = np.where(units.heads[at] == hashes, own[at], 0).astype(np.uint8)
        if near.num_rows:
            rare = unpacked({k: near.column(k)[0] for k in ("hashes", "start", "word", "kind", "n")})
            place = np.searchsorted(hashes, rare["hashes"])
            for part, _, found_ in assigned(rare, fit):
                kinds[place[part]] = found_
        total = np.bincount(kinds, weights=counts, minlength=CLASSES).astype(np.int64)
        return pa.table({"bucket": known.column("bucket"), "hashes": known.column("hashes"), "counts": known.column("counts"), "classes": pa.array([kinds.tobytes()], pa.binary()), "totals": pa.array([total.tolist()], pa.list_(pa.int64()))})

    classed = table.select("bucket", "hashes", "counts").groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(label, "bucket int, hashes binary, counts binary, classes binary, totals array<long>")
    classed = staged(classed, "brown-classes")
    total = np.zeros(CLASSES)
    for kind, n in classed.select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col")).collect():  # a row for each class
        total[kind] = n
    total[own[units.end]] += ends
    return Model(units, own, fit, total, ends, (words or 0) + ends, (types or 0) + (ends > 0), gains), classed


PARTS = "doc_id long, held_out boolean, trains boolean, n_tokens long, n_known long, base_score double, emission double, pairs binary"


def emission(model: Model, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 P(word | class)."""
    return np.log10(np.where(counts > 0, counts - DISCOUNT, DISCOUNT)) - np.log10(np.maximum(model.total, 1))[kinds]


def transitions(among: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from counts of class bigrams."""
    tokens = among.sum(axis=0)
    prior = (tokens + 1) / (tokens.sum() + CLASSES)
    return np.log10((among + PRIOR * prior) / (among.sum(axis=1, keepdims=True) + PRIOR))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    whole = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    chunks, buckets = max(1, round(whole / CHUNK)), max(1, round(whole / PER_BUCKET))
    held = F.coalesce(remainder(id_col, 7) == 2, F.lit(False))
    trains = F.col(id_col).isNotNull() & ~held
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"), trains.alias("trains"))
    model, words = clustered(docs.where(trains).select(F.col(text_col).alias("text")), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_chunk(texts: list[str | None]) -> tuple[list[tuple[Words, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        every, at = [], 0
        while at < len(texts):
            to, room = at, 2 << 20
            while to < len(texts) and (to == at or len(texts[to] or "") <= room):
                room -= len(texts[to] or "")
                to += 1
            words = Words(texts[at:to], lower=True)
            every.append((words, words.hashes()))
            at = to
        return every, *_by_bucket(np.concatenate([h for _, h in every] or [np.zeros(0, np.uint64)]), buckets)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        release()
        _, distinct, at, _ = of_chunk(table.column("text").to_pylist())
        full = np.flatnonzero(np.diff(at))
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "packed": pa.array([distinct[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        release()
        hashes, totals, kinds = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.uint8)
        if known.num_rows:
            hashes = np.frombuffer(known.column("hashes")[0].as_buffer(), np.uint64)
            totals = np.append(np.frombuffer(known.column("counts")[0].as_buffer(), "<i8"), 0)
            kinds = np.append(np.frombuffer(known.column("classes")[0].as_buffer(), np.uint8), np.uint8(0))
        counts, classes = [], []
        for x in asked.column("packed"):
            own = np.frombuffer(x.as_buffer(), np.uint64)
            at = np.searchsorted(hashes, own)
            at[np.append(hashes, np.uint64(0))[at] != own] = len(hashes)
            counts.append(totals[at].astype("<i8").tobytes())
            classes.append(kinds[at].tobytes())
        return pa.table({"bucket": asked.column("bucket"), "chunk": asked.column("chunk"), "counts": pa.array(counts, pa.binary()), "classes": pa.array(classes, pa.binary())})

    def partial(table: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        own = shared.value
        every, distinct, at, place = of_chunk(table.column("text").to_pylist())
        totals, kinds = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for bucket, counts, classes in zip(answers.column("bucket").to_pylist(), answers.column("counts"), answers.column("classes")):
            totals[at[bucket] : at[bucket + 1]] = np.frombuffer(counts.as_buffer(), "<i8")
            kinds[at[bucket] : at[bucket + 1]] = np.frombuffer(classes.as_buffer(), np.uint8)
        out: list[list] = [[], [], [], [], []]
        low, end = 0, own.own[own.units.end]
        for words, hashes in every:
            docs_ = len(words.counts)
            doc = np.repeat(np.arange(docs_), words.counts + 1)
            at_ = np.arange(len(hashes)) + words.doc
            mine = place[low : low + len(hashes)]
            low += len(hashes)
            c, kind = np.full(len(doc), own.ends, np.int64), np.full(len(doc), end, np.int64)
            c[at_] = totals[mine]
            kind[at_] = np.where(totals[mine] > 0, kinds[mine], own.own[own.units.of(words, hashes)])
            before = np.concatenate([[end], kind[:-1]])
            base = np.log10(c + 1.0) - np.log10(own.tokens + own.types + 1.0)
            pairs = (before * CLASSES + kind).astype("<u2")
            ends = np.cumsum(words.counts + 1)
            out[0].append(words.counts + 1)
            out[1].append(np.bincount(doc[c > 0], minlength=docs_))
            out[2].append(np.bincount(doc, weights=base, minlength=docs_))
            out[3].append(np.bincount(doc, weights=emission(own, c, kind), minlength=docs_))
            out[4] += [pairs[e - n : e].tobytes() for e, n in zip(ends.tolist(), (words.counts + 1).tolist())]
        columns = [np.concatenate(x) for x in out[:4]]
        return pa.table({"doc_id": table.column("id"), "held_out": table.column("held"), "trains": table.column("trains"), "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()), "base_score": pa.array(columns[2], pa.float64()), "emission": pa.array(columns[3], pa.float64()), "pairs": pa.array(out[4], pa.binary())})

    asked = rows.groupBy("chunk").applyInArrow(ask, "bucket int, chunk long, packed binary")
    answers = asked.groupBy("bucket").cogroup(words.select("bucket", "hashes", "counts", "classes").groupBy("bucket")).applyInArrow(answer, "bucket int, chunk long, counts binary, classes binary")
    parts = staged(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(partial, PARTS), "brown-parts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    among = added(parts.where("trains").select("pairs").mapInArrow(count, "counts binary"))[: CLASSES * CLASSES].reshape(CLASSES, CLASSES)
    steps = docs.sparkSession.sparkContext.broadcast(transitions(among).ravel())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walk = [float(steps.value[np.frombuffer(x.as_buffer(), "<u2")].sum()) for x in batch.column(6)]
            score = np.asarray(batch.column(5)) + np.array(walk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(batch.num_rows, model_tokens, np.int64)), batch.column(4), pa.array(score, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    model_tokens = model.tokens
    return parts.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "pairs").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
