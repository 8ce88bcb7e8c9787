"""Substring dedup: removes every word of a passage that recurs in the corpus.

A window is `size` consecutive words of one text. Windows whose word sequence
also starts anywhere else are recurring; every word under one is removed.

1. Texts are dealt to chunks by a hash. A chunk sends each distinct window as
   48 bits of a hash, in the list of its hash bucket. These bits only name
   candidates: windows that two chunks sent, or that one chunk holds twice.
2. Of its candidates a chunk sends 80 bits of other hashes. By these a bucket
   joins the chunks that have a candidate to a ring, so an unlike window that
   shares the first bits doesn't come between two copies. Each chunk sends the
   words of its candidates to the next one, neighbouring windows joined to
   passages. So every chunk gets each candidate's words from one other, however
   many have it.
3. A chunk cuts its candidates' runs into windows that cover them and compiles
   these into an Aho-Corasick automaton (a shard of the corpus's automaton, one
   symbol or two per word of theirs). It streams the passages it was sent and
   all its documents through it, each up to the next word that no candidate
   has, as that leads back to the root; stretches shorter than a window can't
   match and are passed over. A window is confirmed if its words, and not just its
   hash, occur in another chunk's passage or twice in this chunk; a run with a
   window that is not is cut into all its windows and tried again. Only matches
   of confirmed windows remove words.

A window that half the corpus shares is sent once by each chunk.
The documents' exchange is shared by the steps, so their text moves once.

Null, empty and blank texts have no words and nothing to remove; texts of
fewer than `size` words are kept whole. Repeated rows count as separate
documents: each is a copy of the other. Rows with equal or null ids are all
returned. An empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.texts import Words, release

SIZE = 35
CHUNK = 5_000_000  # characters of text to a chunk, about
PER_BUCKET = 24_000_000
BITS = 48  # of a hash, to name a candidate
SYMBOLS = 0x10FFFF - 0x800 - 0x100  # code points that can stand for words


class Chunk:
    """The windows of a chunk's texts and their places: a hash bucket and some bits of a hash.

    fine() has other bits of the windows at a place, where they are kept.
    """

    def __init__(self, texts: list[str | None], size: int, buckets: int, bits: int = BITS, most: int = 1 << 20, fine: bool = True):
        self.size, self.blocks, found, at = size, [], [], 0
        while at < len(texts):
            to, room = at, most
            while to < len(texts) and (to == at or len(texts[to] or "") <= room):
                room -= len(texts[to] or "")
                to += 1
            words = Words(texts[at:to])
            hashes = words.hashes()
            starts, one, two = words.windows(hashes, size)
            self.blocks.append((words, hashes, starts))
            found.append((one >> np.uint64(64 - bits), two % np.uint64(buckets), two, one.astype(np.uint16)))
            at = to
        one, two = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]) for k in (0, 1))
        if fine:
            self.two, self.low = (np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in ((2, np.uint64), (3, np.uint16)))
        del found
        # one key sorts faster than two, where both fit into it
        order = np.argsort(two << np.uint64(bits) | one) if buckets <= 1 << (64 - bits) else np.lexsort((one, two))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.back = np.empty(len(one), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.twice = np.diff(np.append(np.flatnonzero(new), len(one))) > 1
        self.places = one[new]
        self.bounds = np.searchsorted(two[new], np.arange(buckets + 1, dtype=np.uint64))

    def fine(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, 64 bits, 16 bits) of the distinct windows at some places, sorted by place."""
        wanted = np.zeros(len(self.places), bool)
        wanted[places] = True
        at = np.flatnonzero(wanted[self.back])
        place, two, low = self.back[at], self.two[at], self.low[at]
        order = np.lexsort((low, two, place))
        place, two, low = place[order], two[order], low[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (two[1:] != two[:-1]) | (low[1:] != low[:-1])
        return place[new], two[new], low[new]

    def passages(self, wanted: np.ndarray) -> list[bytes]:
        """The words of the wanted windows (a flag for each place), neighbours joined, each passage once."""
        out: dict[bytes, None] = {}
        low = 0
        for words, _, starts in self.blocks:
            hit = starts[wanted[self.back[low : low + len(starts)]]]
            low += len(starts)
            if not len(hit):
                continue
            firsts, lasts = _runs(hit, words.doc)
            for a, b in zip(words.starts[firsts].tolist(), words.ends[lasts + self.size - 1].tolist()):
                out[b" ".join(words.raw[a:b].split())] = None
        return list(out)


def shared(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's hashes of one bucket, each once: the places of those that other chunks have."""
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    found = np.zeros(len(every), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return [np.flatnonzero(x) for x in np.split(found, np.cumsum([len(p) for p in parts])[:-1])]


def partners(parts: list[np.ndarray], chunks: list[int], lows: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each chunk's hashes of one bucket: (place, chunk to send to) of those that other chunks have; `lows` are more bits of them.

    The chunks that have a hash form a ring; each sends to the next one.
    """
    order = np.argsort(chunks, kind="stable")
    sizes = [len(parts[k]) for k in order]
    every, owner = np.concatenate([parts[k] for k in order]), np.repeat(np.arange(len(parts)), sizes)
    low = np.concatenate([lows[k] for k in order]) if lows else np.zeros(len(every), np.uint16)
    by = np.lexsort((np.arange(len(every)), low, every))
    every, low = every[by], low[by]
    last = np.append((every[1:] != every[:-1]) | (low[1:] != low[:-1]), True)[: len(every)]
    first = np.flatnonzero(np.append(True, last[:-1])[: len(every)])
    after = np.arange(1, len(every) + 1)
    after[last] = first
    target = np.empty(len(every), np.int64)
    target[by] = by[after]
    names = np.array([chunks[k] for k in order], np.int32)
    out: list[np.ndarray] = [np.zeros((0, 2), np.int32)] * len(parts)
    for k, (low, high) in enumerate(zip(np.cumsum([0, *sizes[:-1]]).tolist(), np.cumsum(sizes).tolist())):
        shared = np.flatnonzero(target[low:high] != np.arange(low, high))
        out[order[k]] = np.stack([shared.astype(np.int32), names[owner[target[low:high][shared]]]], axis=1)
    return out


def steps(places: np.ndarray) -> bytes:
    """Rising numbers as differences, which compress well."""
    return np.diff(places, prepend=0).astype("<i4").tobytes()


def from_steps(packed: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<i4").astype(np.int64))


def pack48(values: np.ndarray) -> bytes:
    """Numbers below 2**48 in six bytes each."""
    return values.astype("<u4").tobytes() + (values >> np.uint64(32)).astype("<u2").tobytes()


def unpack48(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u4", n).astype(np.uint64) | np.frombuffer(packed, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


class Shard:
    """An automaton over windows of words; a word is one symbol, or two where the alphabet is too small."""

    def __init__(self, known: np.ndarray, size: int):
        self.known, self.size, self.width = known, size, 1 if len(known) <= SYMBOLS else 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that no window has."""
        number = np.searchsorted(self.known, hashes)
        number[number == len(self.known)] = 0
        return np.where(self.known[number] == hashes, number, -1) if len(self.known) else np.full(len(hashes), -1)

    def text(self, numbers: np.ndarray) -> str:
        if self.width == 2:
            numbers = np.stack([numbers // SYMBOLS, numbers % SYMBOLS], axis=1).ravel()
        points = numbers + 0x100
        points += (points >= 0xD800) * 0x800
        return points.astype("<u4").tobytes().decode("utf-32-le")

    def add(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The pattern of each window that begins at `starts`."""
        text, step, n = self.text(np.maximum(numbers, 0)), self.width, self.size * self.width
        out = np.empty(len(starts), np.int64)
        for k, at in enumerate((starts * step).tolist()):
            window = text[at : at + n]
            number = self.automaton.get(window, -1)
            if number < 0:
                number = len(self.automaton)
                self.automaton.add_word(window, number)
            out[k] = number
        return out

    def matches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every window that the automaton knows in one stretch of its words."""
        if not len(self.automaton):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [x for x in self.automaton.iter(self.text(numbers)) if (x[0] + 1) % self.width == 0]
        both = np.array(found, np.int64).reshape(-1, 2)
        return (both[:, 0] + 1) // self.width - self.size, both[:, 1]

    def stream(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches in texts one after the other; `doc` is the text of each word."""
        known = np.flatnonzero(numbers >= 0)
        new = np.ones(len(known), bool)
        new[1:] = (known[1:] != known[:-1] + 1) | (doc[known[1:]] != doc[known[:-1]])
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(known)))
        full = lengths >= self.size
        starts, patterns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, n in zip(known[begins[full]].tolist(), lengths[full].tolist()):
            first, pattern = self.matches(numbers[at : at + n])
            starts.append(first + at)
            patterns.append(pattern)
        return np.concatenate(starts), np.concatenate(patterns)


def _runs(starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of neighbouring windows within one text."""
    begins = np.ones(len(starts), bool)
    begins[1:] = (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]])
    at = np.flatnonzero(begins)
    return starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts


def located(chunk: Chunk, shared: np.ndarray, sent: list[bytes]) -> list[np.ndarray]:
    """For each block of a chunk, which words lie under a confirmed window; `shared` are the places that other chunks have."""
    size = chunk.size
    wanted = chunk.twice.copy()
    wanted[shared] = True
    foreign = Words([p.decode("utf-8", "surrogatepass") for p in sent])
    todo, used, low = [], [np.zeros(0, np.uint64)], 0  # (first, last) of the candidates' runs of each block, and their words
    for words, hashes, starts in chunk.blocks:
        hit = starts[wanted[chunk.back[low : low + len(starts)]]]
        low += len(starts)
        first, last = _runs(hit, words.doc)
        todo.append((first, last))
        under = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(under, first, 1)
        np.add.at(under, last + size, -1)
        used.append(hashes[np.cumsum(under[:-1]) > 0])
    known = np.unique(np.concatenate(used))
    numbers = [Shard(known, size).numbers(b[1]) for b in chunk.blocks]
    passages = Shard(known, size).numbers(foreign.hashes())
    changes = [np.zeros(len(b[1]) + 1, np.int64) for b in chunk.blocks]
    for stride in (size, 1):
        if not any(len(first) for first, _ in todo):
            break
        shard, cuts = Shard(known, size), []
        for number, (first, last) in zip(numbers, todo):
            n = (last - first) // stride + 1
            starts = np.repeat(first, n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            run = np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n))])
            starts = np.concatenate([starts, last])
            cuts.append((run, shard.add(number, starts)))
        shard.automaton.make_automaton()
        count = np.zeros(len(shard.automaton), np.int64)
        count[shard.stream(passages, foreign.doc)[1]] = 2
        places = []
        for (words, *_), number in zip(chunk.blocks, numbers):
            starts, patterns = shard.stream(number, words.doc)
            count += np.bincount(patterns, minlength=len(count))
            places.append((starts, patterns))
        for k, (starts, patterns) in enumerate(places):
            hit = starts[count[patterns] > 1]
            np.add.at(changes[k], hit, 1)
            np.add.at(changes[k], hit + size, -1)
        for k, (run, pattern) in enumerate(cuts):
            again = np.unique(run[count[pattern] < 2])
            todo[k] = todo[k][0][again], todo[k][1][again]
    return [np.cumsum(x[:-1]) > 0 for x in changes]


def without_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept, *carry): kept words joined by one space."""
    bits = BITS
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    chunks, buckets = max(1, round(total / CHUNK)), max(1, round(total / PER_BUCKET))
    names = {c: f"carry_{k}" for k, c in enumerate(carry)}
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in names.items()))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        release()
        chunk = Chunk(table.column("text").to_pylist(), size, buckets, bits, fine=False)
        at = chunk.bounds
        full = np.flatnonzero(np.diff(at))
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "packed": pa.array([pack48(chunk.places[at[b] : at[b + 1]]) for b in full], pa.binary())})

    def name(key: tuple, table: pa.Table) -> pa.Table:
        release()
        found = shared([unpack48(x.as_py()) for x in table.column("packed")])
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "places": pa.array([steps(x) for x in found], pa.binary())})

    def describe(key: tuple, table: pa.Table, named: pa.Table) -> pa.Table:
        release()
        chunk = Chunk(table.column("text").to_pylist(), size, buckets, bits)
        out: list[list] = [[], [], [], [], []]
        for bucket, packed in zip(named.column("bucket").to_pylist(), named.column("places")):
            at = chunk.bounds[bucket]
            place, two, low = chunk.fine(from_steps(packed.as_buffer()) + at)
            for column, value in zip(out, (bucket, key[0].as_py(), steps(place - at), two.astype("<u8").tobytes(), low.astype("<u2").tobytes())):
                column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "places", "two", "low"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        release()
        two, low = ([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)] for c, kind in (("two", "<u8"), ("low", "<u2")))
        found = partners(two, table.column("chunk").to_pylist(), low)
        pairs = [steps(from_steps(x.as_buffer())[k]) + to.astype("<i4").tobytes() for x, (k, to) in zip(table.column("places"), (f.T for f in found))]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "pairs": pa.array(pairs, pa.binary())})

    def pass_on(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        chunk = Chunk(table.column("text").to_pylist(), size, buckets, bits, fine=False)
        at, places, targets = chunk.bounds, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bucket, packed in zip(answers.column("bucket").to_pylist(), answers.column("pairs")):
            pairs = np.frombuffer(packed.as_buffer(), "<i4").reshape(2, -1).astype(np.int64)
            places.append(np.cumsum(pairs[0]) + at[bucket])
            targets.append(pairs[1])
        place, target = np.concatenate(places), np.concatenate(targets)
        order = np.argsort(target, kind="stable")
        place, target = place[order], target[order]
        out: list[list] = [[key[0].as_py()], [None], [place.astype("<i4").tobytes()]]  # to itself: what others have of it
        begins = np.flatnonzero(np.diff(target, prepend=-1))
        for to, low, high in zip(target[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(target)]):
            wanted = np.zeros(len(chunk.places), bool)
            wanted[place[low:high]] = True
            out[0].append(to)
            out[1].append(b"\n".join(chunk.passages(wanted)))
            out[2].append(None)
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "passages": pa.array(out[1], pa.binary()), "shared": pa.array(out[2], pa.binary())})

    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField("id", kinds[id_col]), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), *(T.StructField(n, kinds[c]) for c, n in names.items())])

    def remove(table: pa.Table, sent: pa.Table) -> pa.Table:
        release()
        chunk = Chunk(table.column("text").to_pylist(), size, buckets, bits, fine=False)
        passages = {p: None for x in sent.column("passages").to_pylist() if x is not None for p in x.split(b"\n")}
        shared = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i4") for x in sent.column("shared").to_pylist() if x is not None)]).astype(np.int64)
        n_words, n_removed, kept = [], [], []
        for (words, *_), gone in zip(chunk.blocks, located(chunk, shared, list(passages))):
            totals = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])
            for d, n in enumerate(words.counts.tolist()):
                a = int(words.first[d])
                removed = int(totals[a + n] - totals[a])
                own = words.raw[words.offsets[d] : words.offsets[d + 1]].split()
                if removed:
                    own = [w for w, g in zip(own, gone[a : a + n].tolist()) if not g]
                n_words.append(n)
                n_removed.append(removed)
                kept.append(b" ".join(own))
        return pa.table([table.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(table.column(n) for n in names.values())], names=schema.names)

    def freed(run):
        """run, with its memory given back once it is done: the next stages' workers are the same."""

        def two(a, b):
            out = run(a, b)
            release()
            return out

        def three(a, b, c):
            out = run(a, b, c)
            release()
            return out

        return three if run.__code__.co_argcount == 3 else two

    sent = rows.groupBy("chunk").applyInArrow(freed(send), "bucket int, chunk long, packed binary")
    named = sent.groupBy("bucket").applyInArrow(freed(name), "bucket int, chunk long, places binary")
    fine = rows.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(freed(describe), "bucket int, chunk long, places binary, two binary, low binary")
    answers = fine.groupBy("bucket").applyInArrow(freed(answer), "bucket int, chunk long, pairs binary")
    passages = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(freed(pass_on), "chunk long, passages binary, shared binary")
    out = rows.groupBy("chunk").cogroup(passages.groupBy("chunk")).applyInArrow(freed(remove), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *(F.col(n).alias(c) for c, n in names.items()))
