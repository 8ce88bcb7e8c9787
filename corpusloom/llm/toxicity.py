"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A character network reads each word both ways; its final states, its own
verdict on the word and the word's log-odds among labelled texts are the
word's inputs. A word network reads windows of SPAN words both ways, attention
pools its states and a logistic unit scores the window. A text's score is the
highest of all its windows; these overlap by SPAN - STEP words. Words over PART
characters are read in parts.

Both networks are trained here, in numpy, on a bounded sample of labelled rows:
EXAMPLES of either label at most, in the order of a hash of id and text, as long
as CHARACTERS characters hold them; an example that no longer fits is passed
over. Equal rows teach once. All else reads whole texts of any length. Words'
inputs to the gates are worked out once per distinct word and kept, WORDS of
them at most.

Null, empty and blank texts, and those without a letter or digit, score 0. A
null id is not trained on but is scored. Without examples of both labels every
score is 0. Repeated rows are scored each. An empty table gives an empty result.
Other columns are passed on unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import blocks, release

EXAMPLES = 1500
CHARACTERS = 30_000_000
SPAN, STEP = 32, 20
PART = 32
WORDS = 100_000
CHARS = 192  # distinct characters with inputs of their own
HC, H, A = 16, 8, 8
THRESHOLD = 0.7
TOKEN = re.compile(r"\w{1,%d}" % PART)


def remainder(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Steps for a dict of arrays."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States (t, n, h) for gate inputs x (t, n, 3h); a masked step keeps the state."""
    h = u.shape[0]
    state = np.zeros((x.shape[1], h), np.float32)
    states, kept = np.empty((len(x), x.shape[1], h), np.float32), []
    for t in range(len(x)):
        a = state @ u
        zr = _sigmoid(x[t, :, : 2 * h] + a[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(x[t, :, 2 * h :] + r * a[:, 2 * h :])
        kept.append((state, z, r, c, a[:, 2 * h :]))
        state = np.where(mask[t][:, None], state + z * (c - state), state)
        states[t] = state
    return states, kept


def gru_states(x: np.ndarray, sizes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """gru() without what training needs; the longest sequences come first, so the live ones are a prefix."""
    h = u.shape[0]
    state = np.zeros((x.shape[1], h), np.float32)
    out = np.zeros((len(x), x.shape[1], h), np.float32)
    live = np.searchsorted(-sizes, -np.arange(len(x)), side="left")
    for t, n in enumerate(live.tolist()):
        if not n:
            break
        own, gates = state[:n], x[t, :n]
        a = own @ u
        zr = gates[:, : 2 * h] + a[:, : 2 * h]
        np.negative(zr, out=zr)
        np.minimum(zr, 60, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = a[:, 2 * h :]
        c *= zr[:, h:]
        c += gates[:, 2 * h :]
        np.tanh(c, out=c)
        c -= own
        c *= zr[:, :h]
        own += c
        out[t] = state
    return out


def gru_back(d: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u, from those of the states."""
    h = u.shape[0]
    dx, du, carry = np.zeros((len(d), d.shape[1], 3 * h), np.float32), np.zeros_like(u), np.zeros(d.shape[1:], np.float32)
    for t in range(len(d) - 1, -1, -1):
        state, z, r, c, a = kept[t]
        carry = carry + d[t]
        live = carry * mask[t][:, None]
        dc = live * z * (1 - c * c)
        gates = np.concatenate([live * (c - state) * z * (1 - z), dc * a * r * (1 - r), dc], axis=1)
        dx[t] = gates
        inner = gates.copy()
        inner[:, 2 * h :] *= r
        du += state.T @ inner
        carry = carry - live + live * (1 - z) + inner @ u.T
    return dx, du


@dataclass
class Model:
    """Both networks' weights and what the words' inputs need."""

    chars: dict[str, int]
    odds: dict[str, float]
    c: dict[str, np.ndarray]
    w: dict[str, np.ndarray]

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(t, n) character numbers and the mask; 0 stands for all rare ones."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        known, back = np.unique(flat, return_inverse=True)
        codes = np.array([self.chars.get(chr(k), 0) for k in known.tolist()], np.int64)[back] if len(known) else np.zeros(0, np.int64)
        mask = np.arange(int(sizes.max(initial=1)))[:, None] < sizes[None, :]
        grid = np.zeros(mask.T.shape, np.int64)
        grid[mask.T] = codes
        return grid.T, mask

    def encode(self, words: list[str]) -> np.ndarray:
        """The inputs of words: character states, the verdict on them and the log-odds."""
        out = np.zeros((len(words), 2 * HC + 2), np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for at in range(0, len(order), 2048):
            rows = order[at : at + 2048]
            part = [words[k] for k in rows]
            ends, _ = self.states(part)
            out[rows, : 2 * HC] = ends
            out[rows, 2 * HC] = np.tanh((ends @ self.c["v"] + self.c["b"]) / 3)
            out[rows, 2 * HC + 1] = [self.odds.get(x, 0.0) for x in part]
        return out

    def states(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        grid, mask = self.letters(words)
        back = mask[::-1]
        f, kf = gru(self.c["xf"][grid], mask, self.c["uf"])
        b, kb = gru(self.c["xb"][grid[::-1]], back, self.c["ub"])
        return np.concatenate([f[-1], b[-1]], axis=1), (grid, mask, kf, kb)

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs (n, 6h)."""
        return np.concatenate([inputs @ self.w["wf"] + self.w["bf"], inputs @ self.w["wb"] + self.w["bb"]], axis=1).astype(np.float32)

    def score(self, table: np.ndarray, grid: np.ndarray, mask: np.ndarray):
        """Logits of windows, grid (t, n) of rows of the gate table, and what training needs."""
        f, kf = gru(table[grid, : 3 * H], mask, self.w["uf"])
        b, kb = gru(table[grid[::-1], 3 * H :], mask[::-1], self.w["ub"])
        states = np.concatenate([f, b[::-1]], axis=2)
        inner = np.tanh(states @ self.w["wa"])
        weight = np.where(mask, inner @ self.w["va"], -30)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ self.w["v"] + self.w["b"][0], (states, inner, weight, pooled, kf, kb)

    def logits(self, table: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of the windows of `sizes` words from `starts`, the longest first."""
        steps = np.arange(int(sizes[0]))
        last = sizes - 1
        ahead = words[starts[None, :] + np.minimum(steps[:, None], last[None, :])]
        behind = words[starts[None, :] + np.maximum(last[None, :] - steps[:, None], 0)]
        f = gru_states(table[:, : 3 * H][ahead], sizes, self.w["uf"])
        b = gru_states(table[:, 3 * H :][behind], sizes, self.w["ub"])
        mask = steps[:, None] < sizes[None, :]
        back = np.maximum(last[None, :] - steps[:, None], 0)
        states = np.concatenate([f, np.take_along_axis(b, back[:, :, None], axis=0) if (sizes < len(steps)).any() else b[::-1]], axis=2)
        weight = np.exp(np.tanh(states @ self.w["wa"]) @ self.w["va"]) * mask
        weight /= weight.sum(axis=0)
        return np.einsum("tn,tns->ns", weight, states) @ self.w["v"] + self.w["b"][0]


def windows(n: int) -> list[int]:
    """Where windows begin in n words."""
    return list(range(0, max(1, n - SPAN + STEP), STEP)) if n else []


def grids(ids: list[np.ndarray], picks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(t, n) word rows and the mask of windows (text, start)."""
    grid, mask = np.zeros((len(picks), SPAN), np.int64), np.zeros((len(picks), SPAN), bool)
    for k, (d, start) in enumerate(picks):
        own = ids[d][start : start + SPAN]
        grid[k, : len(own)], mask[k, : len(own)] = own, True
    return grid.T, mask.T


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows[i]] += values[i], as a sum over sorted rows."""
    order = np.argsort(rows, axis=None, kind="stable")
    own = rows.ravel()[order]
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    out[own[begins]] += np.add.reduceat(values.reshape(-1, values.shape[-1])[order], begins, axis=0)


def _normal(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * 0.3).astype(np.float32)


def _followers(ids: list[np.ndarray], n: int) -> np.ndarray:
    """How many different words follow each word. Copies of a text add nothing to it."""
    pairs = np.unique(np.concatenate([x[:-1] * n + x[1:] for x in ids if len(x)] or [np.zeros(0, np.int64)]))
    return np.bincount(pairs // max(n, 1), minlength=n)


def train(examples: list[tuple[str, int]], seed: int = 5) -> Model | None:
    """Fit both networks; None without examples of both labels."""
    labels = np.array([int(x) for _, x in examples], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    rows: dict[str, int] = {}
    ids = [np.fromiter((rows.setdefault(w, len(rows)) for w in TOKEN.findall(t.lower())), np.int64) for t, _ in examples]
    seen = [_followers([x for x, y in zip(ids, labels) if y == k], len(rows)) for k in (0, 1)]
    letters: Counter = Counter()
    for word, n in zip(rows, np.bincount(np.concatenate(ids), minlength=len(rows)).tolist()):
        for letter in word:
            letters[letter] += n
    chars = {c: k + 1 for k, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:CHARS])}
    tell = np.tanh((np.log((seen[1] + 0.5) / (seen[1].sum() + 1)) - np.log((seen[0] + 0.5) / (seen[0].sum() + 1))) / 3)
    odds = {w: float(x) for w, x, n in zip(rows, tell, seen[0] + seen[1]) if n >= 8}
    D = 2 * HC + 2
    model = Model(
        chars,
        odds,
        {"xf": _normal(rng, len(chars) + 1, 3 * HC), "xb": _normal(rng, len(chars) + 1, 3 * HC), "uf": _normal(rng, HC, 3 * HC), "ub": _normal(rng, HC, 3 * HC), "v": _normal(rng, 2 * HC), "b": np.zeros(1, np.float32)},
        {"wf": _normal(rng, D, 3 * H), "wb": _normal(rng, D, 3 * H), "bf": np.zeros(3 * H, np.float32), "bb": np.zeros(3 * H, np.float32), "uf": _normal(rng, H, 3 * H), "ub": _normal(rng, H, 3 * H), "wa": _normal(rng, 2 * H, A), "va": _normal(rng, A), "v": _normal(rng, 2 * H), "b": np.zeros(1, np.float32)},
    )
    _train_characters(model, list(rows), *seen, rng)
    _train_windows(model, list(rows), ids, labels, rng)
    return model


def _train_characters(model: Model, words: list[str], in0: np.ndarray, in1: np.ndarray, rng: np.random.Generator, steps: int = 500, batch: int = 512) -> None:
    """Teach the character network which words occur in texts of label 1 alone."""
    # so often that no word is expected to fall in label 1 every time by chance
    chance = in1.sum() / max(in0.sum() + in1.sum(), 1)
    often = max(2.0, 0.8 * np.log(max(len(words), 2)) / -np.log(np.clip(chance, 1e-6, 0.95)))
    in0 = in0 * (in1.sum() / max(in0.sum(), 1))
    target = in1 / np.maximum(in0 + in1, 1e-12)
    weight = np.minimum(in0 + in1, 20) ** 0.75
    one = (target > 0.98) & (in1 >= often)
    weight *= one | (target < 0.75)
    target = one.astype(np.float32)
    if not one.any() or not weight[~one].any():
        return
    adam = Adam(0.02)
    for k in range(steps):
        if k % (steps // 5) == 0:
            if k:  # the words of label 0 that are taken for others come up more often from here on
                found = np.concatenate([_sigmoid(model.states(words[i : i + 2048])[0] @ model.c["v"] + model.c["b"]) for i in range(0, len(words), 2048)])
                hard = np.where(one, 0, weight * (found > 0.2))
                share = 0.5 * hard / max(hard.sum(), 1e-12)
            else:
                share = np.zeros(len(words))
            even = np.where(one, weight / weight[one].sum(), weight / weight[~one].sum())
            odds = even / even.sum() + share
            odds /= odds.sum()
        pick = rng.choice(len(words), size=batch, p=odds)
        adam.rate = 0.02 * (1 - k / steps) + 0.001
        part = [words[i] for i in pick]
        ends, (grid, mask, kf, kb) = model.states(part)
        p = _sigmoid(ends @ model.c["v"] + model.c["b"])
        d = (p - target[pick]).astype(np.float32) / batch
        de = d[:, None] * model.c["v"][None, :]
        steps_f, steps_b = np.zeros((*grid.shape, HC), np.float32), np.zeros((*grid.shape, HC), np.float32)
        steps_f[-1], steps_b[-1] = de[:, :HC], de[:, HC:]
        dxf, duf = gru_back(steps_f, mask, model.c["uf"], kf)
        dxb, dub = gru_back(steps_b, mask[::-1], model.c["ub"], kb)
        grads = {"v": ends.T @ d, "b": d.sum(keepdims=True), "uf": duf, "ub": dub, "xf": np.zeros_like(model.c["xf"]), "xb": np.zeros_like(model.c["xb"])}
        _add_rows(grads["xf"], grid, dxf)
        _add_rows(grads["xb"], grid[::-1], dxb)
        adam.step(model.c, {g: v.astype(np.float32) * 10 for g, v in grads.items()})


def _train_windows(model: Model, words: list[str], ids: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, least: int = 400, batch: int = 64) -> None:
    """A text of label 1 teaches its highest window among those with the most telling words; one of label 0 all of them and two others."""
    inputs = model.encode(words)
    tells = np.maximum(inputs[:, 2 * HC], inputs[:, 2 * HC + 1])
    picks: list[list[tuple[int, int]]] = []
    for d, own in enumerate(ids):
        starts = windows(len(own))
        best = sorted(starts, key=lambda s, own=own: -float(tells[own[s : s + SPAN]].max()))[:2]
        some = rng.choice(starts, 2).tolist() if starts and not labels[d] else []
        picks.append([(d, s) for s in dict.fromkeys(best + some)])
    usable = np.array([k for k, x in enumerate(picks) if x])
    adam = Adam(0.02)
    epochs = max(8, -(-least * batch // max(len(usable), 1)))
    for epoch in range(epochs):
        adam.rate = 0.02 * 0.1 ** (epoch / epochs)
        rng.shuffle(usable)
        for at in range(0, len(usable), batch):
            chosen = [p for k in usable[at : at + batch] for p in picks[k]]
            grid, mask = grids(ids, chosen)
            used, back = np.unique(grid, return_inverse=True)
            table, back = model.gates(inputs[used]), back.reshape(grid.shape)
            logit, _ = model.score(table, back, mask)
            top: dict[int, int] = {}
            for k, (doc, _) in enumerate(chosen):
                if doc not in top or logit[k] > logit[top[doc]]:
                    top[doc] = k
            pick = np.array([k for k, (doc, _) in enumerate(chosen) if not labels[doc] or top[doc] == k])
            target = np.array([labels[chosen[k][0]] for k in pick], np.float32)
            grid, mask = grid[:, pick], mask[:, pick]
            logit, (states, inner, weight, pooled, kf, kb) = model.score(table, back[:, pick], mask)
            d = ((_sigmoid(logit) - target) / len(pick)).astype(np.float32)
            dp = d[:, None] * model.w["v"][None, :]
            dw = (states * dp[None]).sum(axis=2)
            ds = weight[:, :, None] * dp[None]
            da = weight * (dw - (weight * dw).sum(axis=0))
            di = da[:, :, None] * model.w["va"] * (1 - inner * inner)
            ds = (ds + di @ model.w["wa"].T).astype(np.float32)
            dxf, duf = gru_back(ds[:, :, :H], mask, model.w["uf"], kf)
            dxb, dub = gru_back(ds[::-1, :, H:], mask[::-1], model.w["ub"], kb)
            x, y = inputs[grid].reshape(-1, inputs.shape[1]), inputs[grid[::-1]].reshape(-1, inputs.shape[1])
            gf, gb = dxf.reshape(-1, 3 * H), dxb.reshape(-1, 3 * H)
            adam.step(
                model.w,
                {"v": pooled.T @ d, "b": d.sum(keepdims=True), "va": np.einsum("tn,tna->a", da, inner), "wa": np.einsum("tns,tna->sa", states, di), "uf": duf, "ub": dub, "wf": x.T @ gf, "wb": y.T @ gb, "bf": gf.sum(axis=0), "bb": gb.sum(axis=0)},
            )


class Scorer:
    """Scores texts; keeps the gate inputs of words it has met."""

    def __init__(self, model: Model | None):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 6 * H), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.model is None:
            return out
        if len(self.rows) > WORDS:
            self.rows = {}
        known, rows = len(self.rows), self.rows
        ids = [np.fromiter((rows.setdefault(w, len(rows)) for w in TOKEN.findall(t.lower())), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(rows) > known:
            new = list(rows)[known:] if known else list(rows)
            fresh = np.concatenate([self.model.gates(self.model.encode(new[i : i + 16_384])) for i in range(0, len(new), 16_384)])
            self.table = np.concatenate([self.table[:known], fresh])
        sizes = np.array([len(x) for x in ids], np.int64)
        low = np.cumsum(sizes) - sizes
        begun = [windows(n) for n in sizes.tolist()]
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in begun])
        starts = np.fromiter((s for x in begun for s in x), np.int64, len(doc))
        spans = np.minimum(sizes[doc] - starts, SPAN)
        order = np.argsort(-spans, kind="stable")
        words = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(order), 1024):
            own = order[at : at + 1024]
            np.maximum.at(best, doc[own], self.model.logits(self.table, words, low[doc[own]] + starts[own], spans[own]))
        return np.where(np.isfinite(best), _sigmoid(best), 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on labelled rows whose crc32 remainder by 3 is not 1; see the module for the bounds."""
    usable = labels.where(F.col(id_col).isNotNull() & (remainder(id_col, 3) != 1) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label")).distinct()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("key", "text"))
    known = rows.select("key", "hash", F.length("text").alias("size")).join(usable, "key").distinct()
    picked, room = [], CHARACTERS
    for label in (1, 0):
        for r in known.where(F.col("label") == label).orderBy("hash", "key").limit(EXAMPLES).collect():
            if r["size"] <= room - (label == 1) * CHARACTERS // 2:
                picked.append((r["key"], r["hash"], label))
                room -= r["size"]
    if not picked:
        return None
    ids = docs.sparkSession.createDataFrame(picked, "key long, hash long, label int")  # 2 * EXAMPLES rows at most
    found = rows.join(F.broadcast(ids), ["key", "hash"]).dropDuplicates(["key", "hash", "label"])
    return train([(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: (r["key"], r["text"], r["label"]))])


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column score; one of just that name is replaced."""
    names = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    schema = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(plain.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.scores(block["text"]) for block in blocks([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])], most=1 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())], [*batch.schema.names, "new_score"])
        release()

    found = plain.mapInArrow(run, f"{schema}, new_score double")
    return found.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), F.col("new_score").alias("score"))
