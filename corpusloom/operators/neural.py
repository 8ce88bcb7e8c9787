"""A recurrent word model with factored 8-bit weights: next words, cased surfaces and phrases, for batches of contexts.

Contexts of a batch are walked together as a trie: every distinct beginning is
stepped once, however many contexts share it, and all beginnings of a length
are one matrix product. Vectors are quantised to 8 bits before each product
with the gates, as the weights are, so sums are exact integers times scales.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the file's mark and formats, floors, shortlists, classes of case and what ends or parts a phrase
MAGIC, F32_GATES, I8_GATES = 0x4C53544D, 4, 5
OOV = -20.0
SHORTLIST, PHRASE_SHORTLIST = 16_000, 4_000
LOWER, TITLE, UPPER, OTHER = range(4)
UNKNOWN = "<unk>"
SENTENCE_END = frozenset(".!?")
PUNCTUATION = frozenset(".,!?;:")


@dataclass
class Quantised:
    """A matrix in 8 bits with a scale per row."""

    q: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, w: np.ndarray) -> Quantised:
        scale = np.maximum(np.abs(w).max(axis=1), 1e-12) / 127
        return cls(np.clip(np.floor(w / scale[:, None] + 0.5), -127, 127).astype(np.int8), scale.astype(np.float32))

    def times(self, x: np.ndarray) -> np.ndarray:
        """Products with the rows of x, each quantised by its own greatest component."""
        scale = np.maximum(np.abs(x).max(axis=1), 1e-9) / 127
        own = np.clip(np.floor(x / scale[:, None] + 0.5), -127, 127)
        return (own @ self.q.T.astype(np.float64)) * self.scale * scale[:, None]


@dataclass
class Layer:
    inputs: Quantised
    states: Quantised
    bias: np.ndarray
    project: Quantised | None = None


@dataclass
class Network:
    vocab: list[str]
    irregular: dict[str, str]
    emb: Quantised
    layers: list[Layer]
    out: np.ndarray
    case_context: np.ndarray  # (4, dim)
    case_base: np.ndarray  # (4,)
    case_word: np.ndarray  # (4, dim)
    case_bias: np.ndarray  # (words, 4)
    case_a: np.ndarray  # (4, rank, dim)
    case_b: np.ndarray
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {w: k for k, w in enumerate(self.vocab)}

    @property
    def width(self) -> int:
        return len(self.layers[0].bias) // 4

    def begin(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(h, c) of every layer for n empty contexts."""
        return [(np.zeros((n, self.emb.q.shape[1])), np.zeros((n, self.width))) for _ in self.layers]

    def step(self, state: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The states after one word each."""
        x = self.emb.q[words] * self.emb.scale[words, None].astype(np.float64)
        out = []
        for layer, (h, c) in zip(self.layers, state):
            gates = layer.bias + layer.inputs.times(x) + layer.states.times(h)
            enter, forget, fresh, leave = np.split(gates, 4, axis=1)
            c = c / (1 + np.exp(-forget)) + np.tanh(fresh) / (1 + np.exp(-enter))
            x = np.tanh(c) / (1 + np.exp(-leave))
            if layer.project is not None:
                x = layer.project.times(x)
            out.append((x, c))
        return out

    def after(self, contexts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The states after each context, words in any case; each distinct beginning is stepped once."""
        words = [[self.ids.get(w.lower(), 0) for w in c] for c in contexts]
        final = self.begin(len(contexts))
        node, state = np.zeros(len(contexts), np.int64), self.begin(1)  # where each context is in the trie's level
        for t in range(max(map(len, words), default=0)):
            live = np.array([k for k, c in enumerate(words) if len(c) > t])
            pairs = np.stack([node[live], [words[k][t] for k in live]], axis=1)
            distinct, back = np.unique(pairs, axis=0, return_inverse=True)
            state = self.step([(h[distinct[:, 0]], c[distinct[:, 0]]) for h, c in state], distinct[:, 1])
            node[live] = back.ravel()
            done = live[[len(words[k]) == t + 1 for k in live]]
            for (h, c), (to_h, to_c) in zip(state, final):
                to_h[done], to_c[done] = h[node[done]], c[node[done]]
        return final

    def logits(self, h: np.ndarray, most: int = SHORTLIST) -> tuple[np.ndarray, np.ndarray]:
        """(logits of the `most` first words, log of their sum) for every state."""
        n = min(most, len(self.vocab))
        own = self.out[:n] + (h @ self.emb.q[:n].T.astype(np.float64)) * self.emb.scale[:n]
        top = own.max(axis=1, keepdims=True)
        return own, (top + np.log(np.exp(own - top).sum(axis=1, keepdims=True)))[:, 0]

    def log_prob(self, h: np.ndarray, words: list[str]) -> np.ndarray:
        """ln P of one word after each state; words beyond the shortlist are scored by their own row."""
        own, total = self.logits(h)
        ids = np.array([self.ids.get(w, -1) for w in words])
        at = np.maximum(ids, 0)
        score = self.out[at] + (h * self.emb.q[at]).sum(axis=1) * self.emb.scale[at]
        return np.where(ids >= 0, score - total, OOV)

    def top(self, h: np.ndarray, k: int, most: int = SHORTLIST) -> list[list[tuple[str, float]]]:
        """The k likeliest words after each state, the unknown one left out."""
        own, total = self.logits(h, most)
        n = min(k + 4, own.shape[1])
        part = np.argpartition(-own, n - 1, axis=1)[:, :n]
        out = []
        for row, z, some in zip(own, total, part):
            ranked = some[np.lexsort((some, -row[some]))]
            out.append([(self.vocab[w], float(row[w] - z)) for w in ranked if self.vocab[w] != UNKNOWN][:k])
        return out

    def case_logits(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(n, 4): how each word would be cased after each state, the product of both included."""
        e = self.emb.q[words] * self.emb.scale[words, None].astype(np.float64)
        both = np.einsum("crd,nd->ncr", self.case_a, h) * np.einsum("crd,nd->ncr", self.case_b, e)
        return h @ self.case_context.T + self.case_base + e @ self.case_word.T + self.case_bias[words] + both.sum(axis=2)

    def surface(self, word: str, logits: np.ndarray) -> str:
        """The word in its best case; a form of its own only if one is stored."""
        forms = {LOWER: word, TITLE: word[:1].upper() + word[1:], UPPER: word.upper(), OTHER: self.irregular.get(word)}
        return next(forms[k] for k in np.argsort(-logits, kind="stable") if forms[k])

    def cased(self, h: np.ndarray, words: list[str], margin: float = 4.0, sure: float = 2.5) -> list[tuple[str, str, list[str]]]:
        """(shown, for corrections, variants) of each word after each state; unknown words stay as they are.

        A correction leaves lower case only where the best class beats it by
        `sure`. A capitalised word has its lower case as a variant if that is
        within `margin`.
        """
        low = [w.lower() for w in words]
        ids = np.array([self.ids.get(w, -1) for w in low])
        every = self.case_logits(h, np.maximum(ids, 0))
        out = []
        for word, own, known, lg in zip(words, low, ids >= 0, every):
            if not known:
                out.append((word, word, [word]))
                continue
            best, lead = int(lg.argmax()), float(lg.max() - lg[LOWER])
            shown = self.surface(own, lg)
            both = best != LOWER and lead <= margin and shown != own
            out.append((shown, shown if best != LOWER and lead >= sure else own, [shown, own] if both else [shown]))
        return out

    def phrases(self, context: list[str], seed: str, words: int = 4, width: int = 3) -> list[tuple[list[str], float]]:
        """(cased words, ln P of all after the seed): continuations of a seed by beam search, within a sentence."""
        if words < 2 or width < 1:
            return []
        base, own = self.after([context]), seed.lower()
        begun = [self.surface(own, self.case_logits(base[-1][0], np.array([self.ids.get(own, 0)]))[0])]
        state = self.step(base, np.array([self.ids.get(own, 0)]))
        paths: list[tuple[list[str], float]] = [(begun, 0.0)]
        out = []
        for depth in range(words - 1):
            h = state[-1][0]
            grown = []
            for k, found in enumerate(self.top(h, width, PHRASE_SHORTLIST)):
                if found and found[0][0] in SENTENCE_END:
                    continue
                fine = [(w, lp) for w, lp in found if w not in SENTENCE_END and w not in PUNCTUATION]
                ids = np.array([self.ids[w] for w, _ in fine], np.int64)
                cases = self.case_logits(np.repeat(h[k : k + 1], len(fine), axis=0), ids) if fine else []
                grown += [(paths[k][1] + lp, k, w, self.surface(w, lg)) for (w, lp), lg in zip(fine, cases)]
            grown = sorted(grown, key=lambda x: -x[0])[:width]
            out += [([*paths[k][0], shown], lp) for lp, k, _, shown in grown]
            if not grown or depth == words - 2:
                break
            kept = np.array([k for _, k, _, _ in grown])
            state = self.step([(h[kept], c[kept]) for h, c in state], np.array([self.ids[w] for _, _, w, _ in grown]))
            paths = [([*paths[k][0], shown], lp) for lp, k, _, shown in grown]
        return out


class _Cursor:
    """Reads a file from the front; every byte must be accounted for."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def numbers(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def array(self, kind: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        out = np.frombuffer(self.data, np.dtype(kind), n, self.at).reshape(shape)
        self.at += n * out.itemsize
        return out

    def text(self) -> str:
        (n,) = self.numbers("H")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8")


def parse(data: bytes) -> Network:
    """A network from its file; ValueError for another mark or format, and for bytes that are left over."""
    read = _Cursor(data)
    (mark,) = read.numbers("I")
    if mark != MAGIC:
        raise ValueError("no model file")
    words, dim, width, n_layers, form = read.numbers("IIIIB")
    if form not in (F32_GATES, I8_GATES):
        raise ValueError(f"format {form} is neither {F32_GATES} nor {I8_GATES}")
    vocab = [read.text() for _ in range(words)]
    irregular = {vocab[read.numbers("I")[0]]: read.text() for _ in range(read.numbers("I")[0])}
    q = read.array("i1", words, dim)
    emb = Quantised(q, read.array("<f4", words))

    def gates(rows: int, columns: int) -> Quantised:
        if form == I8_GATES:
            own = read.array("i1", rows, columns)
            return Quantised(own, read.array("<f4", rows))
        return Quantised.of(read.array("<f4", rows, columns))

    layers = []
    for _ in range(n_layers):
        inputs, states = gates(4 * width, dim), gates(4 * width, dim)
        bias = read.array("<f4", 4 * width).astype(np.float64) + read.array("<f4", 4 * width)
        layers.append(Layer(inputs, states, bias, gates(dim, width) if width != dim else None))
    out = read.array("<f4", words)
    context, base, word, bias = read.array("<f4", 4, dim), read.array("<f4", 4), read.array("<f4", 4, dim), read.array("<f4", words, 4)
    (rank,) = read.numbers("I")
    a, b = read.array("<f4", 4, rank, dim), read.array("<f4", 4, rank, dim)
    if read.at != len(data):
        raise ValueError(f"{len(data) - read.at} bytes too many")
    return Network(vocab, irregular, emb, layers, out, context, base, word, bias, a, b)


def written(net: Network) -> bytes:
    """The file of a network, its gates in 8 bits."""
    rows = [struct.pack("<IIIIIB", MAGIC, len(net.vocab), net.emb.q.shape[1], net.width, len(net.layers), I8_GATES)]
    text = lambda w: struct.pack("<H", len(w.encode())) + w.encode()
    rows += [text(w) for w in net.vocab]
    rows += [struct.pack("<I", len(net.irregular)), *(struct.pack("<I", net.ids[w]) + text(s) for w, s in net.irregular.items())]
    rows += [net.emb.q.tobytes(), net.emb.scale.astype("<f4").tobytes()]
    for layer in net.layers:
        for m in (layer.inputs, layer.states):
            rows += [m.q.tobytes(), m.scale.astype("<f4").tobytes()]
        rows += [layer.bias.astype("<f4").tobytes(), np.zeros(len(layer.bias), "<f4").tobytes()]
        if layer.project is not None:
            rows += [layer.project.q.tobytes(), layer.project.scale.astype("<f4").tobytes()]
    rows += [x.astype("<f4").tobytes() for x in (net.out, net.case_context, net.case_base, net.case_word, net.case_bias)]
    return b"".join([*rows, struct.pack("<I", net.case_a.shape[1]), net.case_a.astype("<f4").tobytes(), net.case_b.astype("<f4").tobytes()])


def drawn(vocab: list[str], dim: int = 16, width: int = 16, layers: int = 2, rank: int = 2, seed: int = 1, irregular: dict[str, str] | None = None) -> Network:
    """A network of random weights, for tests: no trained ones are published."""
    rng = np.random.default_rng(seed)
    g = lambda *shape: rng.standard_normal(shape).astype(np.float32) * 0.4
    own = [Layer(Quantised.of(g(4 * width, dim)), Quantised.of(g(4 * width, dim)), g(4 * width).astype(np.float64), Quantised.of(g(dim, width)) if width != dim else None) for _ in range(layers)]
    return Network(list(vocab), dict(irregular or {}), Quantised.of(g(len(vocab), dim) * 3), own, g(len(vocab)), g(4, dim), g(4), g(4, dim), g(len(vocab), 4) * 3, g(4, rank, dim), g(4, rank, dim))


def read(spark: SparkSession, path: str) -> Network:
    return parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def _run(asked: DataFrame, net: Network, body, schema: str) -> DataFrame:
    """body(network, rows) over batches of questions; the network is a file of fixed size and is broadcast."""
    shared = asked.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                yield pd.DataFrame(body(shared.value, pdf.iloc[at : at + 512]), columns=names)

    return asked.mapInPandas(run, schema)


def _contexts(pdf: pd.DataFrame) -> list[list[str]]:
    return [[w for w in (c if c is not None else []) if w is not None] for c in pdf["context"]]


def scored(net: Network, asked: DataFrame) -> DataFrame:
    """(query_id, w, log_prob, shown, corrected, variants) for asked(query_id, context, w)."""

    def body(own: Network, pdf: pd.DataFrame) -> list[tuple]:
        h = own.after(_contexts(pdf))[-1][0]
        words = list(pdf["w"])
        return [(q, w, float(lp), *cased) for q, w, lp, cased in zip(pdf["query_id"], words, own.log_prob(h, [w.lower() for w in words]), own.cased(h, words))]

    return _run(asked.where("w is not null").select("query_id", "context", "w"), net, body, f"query_id {dict(asked.dtypes)['query_id']}, w string, log_prob double, shown string, corrected string, variants array<string>")


def predicted(net: Network, asked: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, w, log_prob, rank) for asked(query_id, context): the k likeliest next words."""

    def body(own: Network, pdf: pd.DataFrame) -> list[tuple]:
        found = own.top(own.after(_contexts(pdf))[-1][0], k)
        return [(q, w, lp, r) for q, ranked in zip(pdf["query_id"], found) for r, (w, lp) in enumerate(ranked, 1)]

    return _run(asked.select("query_id", "context"), net, body, f"query_id {dict(asked.dtypes)['query_id']}, w string, log_prob double, rank int")


def phrased(net: Network, asked: DataFrame, words: int = 4, width: int = 3) -> DataFrame:
    """(query_id, phrase, log_prob) for asked(query_id, context, seed): phrases that begin with the seed."""

    def body(own: Network, pdf: pd.DataFrame) -> list[tuple]:
        return [(q, " ".join(shown), lp) for q, context, seed in zip(pdf["query_id"], _contexts(pdf), pdf["seed"]) for shown, lp in own.phrases(context, seed, words, width)]

    return _run(asked.where("seed is not null").select("query_id", "context", "seed"), net, body, f"query_id {dict(asked.dtypes)['query_id']}, phrase string, log_prob double")


def word_alternatives(net: Network, asked: DataFrame, k: int = 6, least: float = 0.42) -> DataFrame:
    """(query_id, other, cosine, gain, rank) for asked(query_id, context, w): words of like meaning, and how much better each fits here, in nats."""

    def body(own: Network, pdf: pd.DataFrame) -> list[tuple]:
        own_rows = own.emb.q * own.emb.scale[:, None].astype(np.float64)
        unit = own_rows / np.maximum(np.sqrt((own_rows * own_rows).sum(axis=1, keepdims=True)), 1e-12)
        h = own.after(_contexts(pdf))[-1][0]
        out = []
        for q, w, state in zip(pdf["query_id"], pdf["w"], h):
            at = own.ids.get(w.lower())
            if at is None:
                continue
            cosine = unit @ unit[at]
            near = [j for j in np.argsort(-cosine, kind="stable") if j not in (0, at) and cosine[j] >= least][:k]
            lp = own.log_prob(np.repeat(state[None], len(near) + 1, axis=0), [own.vocab[j] for j in [at, *near]])
            out += [(q, own.vocab[j], float(cosine[j]), float(lp[r] - lp[0]), r) for r, j in enumerate(near, 1)]
        return out

    return _run(asked.where("w is not null").select("query_id", "context", "w"), net, body, f"query_id {dict(asked.dtypes)['query_id']}, other string, cosine double, gain double, rank int")
