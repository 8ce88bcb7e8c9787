"""The ten operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import xxhash

from corpusloom.llm import brown, chat, fertility, langid, mixing, packing, phrases, pstable, simhash, toxicity
from corpusloom.llm.components import connected
from corpusloom.llm.texts import Words

WORD = re.compile("[^\x20\x09-\x0d]+")
RNG = random.Random(4)
LOREM = [f"w{k}x" for k in range(400)]
PLACE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN


def prose(n):
    return " ".join(RNG.choice(LOREM) for _ in range(n))


PASSAGE = prose(60)
NEAR = prose(200).split()
TEXTS = (
    [None, "", " \n\t ", "One", "two words", "a" * 50_000, prose(30_000), "é\u2028ü ß\x85x 漢字 😀 \x1f y", "dup line\ndup line\n\nother"]
    + [PASSAGE + " " + prose(20), prose(30) + " " + PASSAGE, PASSAGE, PASSAGE, prose(40) * 3]
    + [" ".join(NEAR[:k] + ["zz"] + NEAR[k + 1 :]) for k in (3, 50, 120)]
    + [prose(RNG.randint(1, 120)) for _ in range(60)]
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, 7, k) for k, t in enumerate(TEXTS)]
    rows += [rows[20], rows[21]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block int, chunk long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


def everything(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def least_reachable(ids, linked):
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_words_are_cut_and_hashed_alike():
    words = Words(TEXTS)
    cut = [[words.raw[s:e].decode() for s, e in zip(words.starts[a:b], words.ends[a:b])] for a, b in zip(words.first, words.first[1:])]
    assert cut == [WORD.findall(t or "") for t in TEXTS]
    flat, hashes = [w for d in cut for w in d], words.hashes()
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))
    small = Words(TEXTS, step=64).hashes()
    assert (small == hashes).all()


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    fps = {k: fingerprint(t) for k, t in everything(docs)}
    label = least_reachable(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {k: (v[0]["fingerprint"], v[0]["component_id"]) for k, v in got.items()} == {k: (f"{fps[k]:016x}", label[k]) for k in fps}
    assert len(got[20]) == 2
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n,spread", [(3000, 64), (6000, 9)])
def test_simhash_search_is_exact(n, spread):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread), replace=False)) for _ in range(n)], dtype=np.uint64)
    fps = np.unique(base ^ flips)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert (simhash.local_components(fps, 2) == label).all()
    rows, shards = simhash.Tree(fps[:500], 3).route(fps, 2)
    own = {}
    for r, s in zip(rows.tolist(), shards.tolist()):
        own.setdefault(r, set()).add(s)
    i, j = np.nonzero(np.triu(near, 1))
    assert all(own[a] & own[b] for a, b in zip(i.tolist(), j.tolist()))


def test_simhash_large_shards_by_probes(docs, monkeypatch):
    want = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "MAX_SHARD", 10)
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\</s>", "<<s>>", "\\\\", "<\\/s>", "[[INST]", "<<SYS>>x<</SYS>>", ""])
def test_chat_escape_round_trip(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not chat.CONTROL.search(shown)


def test_chat(spark):
    rows = [(1, 0, "system", "be <s> good"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "assistant", "é\\[INST]"), (2, 0, "tool [/ROLE]", "x" * 30_000), (2, 1, None, ""), (None, 0, "user", "u"), (3, 5, "user", "b"), (3, 5, "user", "b"), (3, 5, "user", "a"), (4, 0, "user", " " * 1_100_000), (4, 1, "assistant", "<|endoftext|>" + "\n" * 1_100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df, PLACE), PLACE).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        loss = "".join(t or "" for _, role, t in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted(df.where("false"), PLACE).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = docs.sparkSession.createDataFrame([(5000, "a <|endoftext|> b<|endoftext|>"), (5001, " " * 1_200_000 + "x"), (5002, "y" + "\n\t" * 600_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    got = packing.pack(docs, PLACE, capacity=512).collect()
    want = Counter()
    for key, text in everything(docs):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, length) in enumerate(packing.cuts(len(ids), 512)):
            want[key, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own_ in seqs.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at
            at += length
        assert at <= 512
    assert len(seqs) <= 1.05 * sum(r["length"] for r in got) / 512 + 1
    assert packing.pack(empty, PLACE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(2048, rng.lognormal(5 + seed / 2, 1, 5000).astype(int) + 1)
    plan = packing.best_fit_runs({int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}, 2048)
    used = (plan[:, 3] + plan[:, 2]).max()
    assert plan[:, 2].sum() == 5000
    assert used <= max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum())) * 1.02 + 1


def test_brown(docs, empty, spark):
    got = by_id(brown.scored(docs))
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    rows = [(k, WORD.findall((t or "").translate(low)) + [None]) for k, t in everything(docs)]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    c = Counter(w for k, t in rows if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in rows:
        r = got[k][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert brown.scored(empty).count() == 0
    alone = spark.createDataFrame([(5, "x y")], "doc_id long, text string").where("doc_id = 5")
    assert brown.scored(alone).first()["score"] < 0


def test_brown_scores_by_hand(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEADS", 5)
    rows = [(k, " ".join(RNG.choice(LOREM[:60]) for _ in range(RNG.randint(0, 30)))) for k in range(80)] + [(None, "w1x zz"), (200, None), (200, "W1X unseenword w2x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    train = [(t or "").lower().split() for k, t in rows if k is not None and not held[k]]
    c = Counter(w for t in train for w in [*t, None])
    model, words = brown.clustered(df.where("doc_id is not null and crc32(cast(doc_id as string)) % 7 <> 2").select("text"), 2)
    assert model.gains == sorted(model.gains)
    kinds = {}
    for r in words.collect():
        kinds |= dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), r["classes"]))

    def units(word):
        w = Words([word])
        return int(w.hashes()[0]), int(model.own[model.units.of(w, w.hashes())[0]])

    end = int(model.own[model.units.end])
    kind = lambda w: end if w is None else kinds[units(w)[0]] if c[w] else units(w)[1]
    assert len(kinds) == len(c) - 1 and {h for h in kinds} == {units(w)[0] for w in c if w}
    total = Counter()
    for w, n in c.items():
        total[kind(w)] += n
    assert {k: n for k, n in enumerate(model.total.tolist()) if n} == dict(total)
    among = np.zeros((brown.CLASSES, brown.CLASSES))
    for t in train:
        for a, b in zip([None, *t], [*t, None]):
            among[kind(a), kind(b)] += 1
    freq = (among.sum(axis=0) + 1) / (among.sum() + brown.CLASSES)
    walk = (among + brown.PRIOR * freq) / (among.sum(axis=1, keepdims=True) + brown.PRIOR)
    emit = lambda w: (c[w] - brown.DISCOUNT if c[w] else brown.DISCOUNT) / max(total[kind(w)], 1)
    assert walk.sum(axis=1) == pytest.approx(np.ones(brown.CLASSES))
    for k in total:  # seen words, and as many unseen ones, share each class
        seen = [w for w in c if kind(w) == k]
        assert sum(map(emit, seen)) + len(seen) * brown.DISCOUNT / total[k] == pytest.approx(1)
    want = Counter()
    for k, t in rows:
        t = (t or "").lower().split()
        want[k, round(sum(math.log10(walk[kind(a), kind(b)] * emit(b)) for a, b in zip([None, *t], [*t, None])), 6)] += 1
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in brown.scored(df).collect()) == want


def test_brown_sweeps_move_words_to_their_neighbours(spark, monkeypatch):
    rng = random.Random(9)
    left, right = [f"l{k}{rng.choice('abc')}" for k in range(40)], [f"r{k}{rng.choice('abc')}" for k in range(40)]
    texts = [" ".join(w for _ in range(20) for w in ("the", rng.choice(left), "of", rng.choice(right))) for _ in range(60)]
    monkeypatch.setattr(brown, "HEADS", 2)
    model, words = brown.clustered(spark.createDataFrame([(t,) for t in texts], "text string"), 1)
    r = words.first()
    kinds = dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), r["classes"]))
    of = lambda own: {kinds[int(Words([w]).hashes()[0])] for w in own}
    assert not of(left) & of(right) and model.gains[-1] > model.gains[0]


def test_brown_classes_raise_the_likelihood():
    rng = np.random.default_rng(0)
    kind = np.arange(40) % 2  # two kinds of words that alternate
    n = rng.integers(0, 20, (40, 40)) * (kind[:, None] != kind[None, :])
    own = brown.exchange(n, 2)
    assert len(set(own[kind == 0])) == len(set(own[kind == 1])) == 1 and own[0] != own[1]


def test_mixing(docs, empty):
    got = mixing.mixed(docs, max_repeat=2.0).collect()
    rows = everything(docs)
    tokens = {k: len(WORD.findall(t or "")) + 1 for k, t in rows}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    totals = Counter()
    for k, _ in rows:
        totals[source[k]] += tokens[k]
    plan = {s.name: s for s in mixing.planned([mixing.Source(n, 1, t) for n, t in totals.items()], None, 2.0)}
    assert max(s.quota / s.tokens for s in plan.values()) <= 2.0 + 1e-6
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["n_tokens"]
        assert r["n_tokens"] == tokens[r["doc_id"]]
    most = max(tokens.values())
    for name, s in plan.items():
        assert s.quota <= taken[name] < s.quota + most
    seen = Counter((r["doc_id"], r["epoch"]) for r in got)
    repeats = Counter(k for k, _ in rows)
    assert all(n <= repeats[k] for (k, _), n in seen.items())
    assert {k for k, e in seen if e == 0} == set(tokens)
    assert mixing.mixed(empty).count() == 0
    assert set(docs.columns) <= set(mixing.mixed(docs).columns)


def test_mixing_reaches_an_entropy():
    tokens = [900, 50, 30, 20]
    alpha = mixing.temperature(tokens, 1000, None, 1.5)
    assert mixing.bits(mixing.weights(tokens, alpha)) == pytest.approx(1.5, abs=1e-6)
    low = mixing.temperature(tokens, None, None, 0.3)
    assert low > 1 and mixing.bits(mixing.weights(tokens, low)) == pytest.approx(0.3, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.temperature([5, 5], None, None, 0.5)


def test_mixing_keeps_or_refuses_a_repetition():
    tokens = [900, 50, 30, 20]
    own = mixing.weights(tokens, mixing.temperature(tokens, 1900, 2.0, None))
    assert mixing.repetition(tokens, own, 1900) == pytest.approx(2.0, abs=1e-6)
    assert mixing.temperature(tokens, 2000, 2.0, None) == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.temperature(tokens, 5000, 2.0, None)


def test_mixing_without_ids(spark):
    rows = [(None, f"text {k} " + prose(k % 9), "s") for k in range(60)] + [(k, "a b", None) for k in range(5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(df).where("epoch = 0").collect())
    assert got == Counter(rows)


def test_phrases(docs, empty, spark):
    got = by_id(phrases.without_recurring(docs, carry=("chunk",)))
    rows = [(k, WORD.findall(t or "")) for k, t in everything(docs)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    for k, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        r = got[k][0]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)), k
        assert r["chunk"] == k
    assert len(got[20]) == 2
    assert phrases.without_recurring(empty).count() == 0


def test_phrases_over_many_chunks(docs, monkeypatch):
    want = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in phrases.without_recurring(docs).collect())
    monkeypatch.setattr(phrases, "CHUNK", 20_000)
    monkeypatch.setattr(phrases, "PER_BUCKET", 60_000)
    assert sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in phrases.without_recurring(docs).collect()) == want


def test_phrases_are_found_by_the_automaton(monkeypatch):
    none = np.zeros(0, np.int64)
    texts = [PASSAGE + " " + prose(50), prose(10) + " " + PASSAGE, prose(100)]
    chunk = phrases.Chunk(texts, 35, 3)
    assert [int(x.sum()) for x in phrases.located(chunk, none, [])] == [120]
    alone = phrases.Chunk([texts[0], texts[2]], 35, 3)
    assert phrases.located(alone, none, [])[0].sum() == 0
    every = np.arange(len(alone.places))  # as if all hashes met another chunk's: words decide
    assert phrases.located(alone, every, [])[0].sum() == 0
    assert phrases.located(alone, every, [PASSAGE.encode()])[0].sum() == 60
    assert phrases.located(alone, every, [PASSAGE.encode()[:-1] + b"!"])[0].sum() == 59
    assert phrases.located(alone, every, [b" ".join(PASSAGE.encode().split()[7:50])])[0].sum() == 43
    monkeypatch.setattr(phrases, "SYMBOLS", 50)  # two symbols a word
    assert [int(x.sum()) for x in phrases.located(chunk, none, [])] == [120]
    monkeypatch.setattr(phrases.Shard, "matches", lambda self, hashes: (none, none))
    assert [int(x.sum()) for x in phrases.located(chunk, none, [])] == [0]


def test_phrases_rings():
    parts = [np.array([1, 5, 9], np.uint64), np.array([2, 5], np.uint64), np.array([5, 9], np.uint64)]
    assert [x.tolist() for x in phrases.partners(parts, [7, 3, 8])] == [[[1, 8], [2, 8]], [[1, 7]], [[0, 3], [1, 7]]]
    values = np.array([RNG.getrandbits(48) for _ in range(100)], np.uint64)
    assert (phrases.unpack48(phrases.pack48(values)) == values).all()


def test_fertility(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    place = path, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    byte_level = fertility.bpe(*place[1:])
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(fertility.judged(fertility.measured(docs, *place)))
    for k, text in everything(docs):
        t = text or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                twice |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        ids = [i for x in w for i in own.encode(x)]
        r = got[k][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert (r["n_tokens"], r["n_byte_tokens"]) == (len(ids), sum(own.is_byte(i) for i in ids))
        want = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
        assert r["entropy"] == pytest.approx(want, abs=1e-9)
        assert r["base_failed"] == (len(w) < 20 or 100 * len(twice) > 30 * len(w))
        assert r["n_bpe_tokens"] == sum(len(byte_level.encode_ordinary(x)) for x in w)
        least, low, high, most, bits = fertility.BANDS[r["lang"] or r["script"]]
        good = sum(map(len, w)) >= least * max(1, len(ids)) and low <= sum(map(len, w)) / max(1, r["n_bpe_tokens"]) <= high and r["n_byte_tokens"] <= most * max(1, len(ids)) and (want >= bits or len(ids) < 64)
        assert r["kept"] == (good and not r["base_failed"]), k
    assert fertility.measured(empty, *place).count() == 0


def test_fertility_rejects_noise(spark):
    rng = random.Random(3)
    letters = lambda pool: " ".join("".join(rng.choice(pool) for _ in range(rng.randint(4, 9))) for _ in range(150))
    common = "the of and to in that was his with for had not which from they have this were been their would there could other time about people water after first world long great house little under again place where years work".split()
    clean = [" ".join(rng.choice(common) for _ in range(200)) for _ in range(5)]
    noise = [letters("bcdfghjklmnpqrstvwxz"), letters("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), letters("\u00c3\u00a9\u00a2\u20ac\u2122\u0153ab")]
    rows = [(k, t, None) for k, t in enumerate(clean + noise)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    place = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    got = by_id(fertility.judged(fertility.measured(df, *place)))
    assert [got[k][0]["kept"] for k in range(8)] == [True] * 5 + [False] * 3
    assert not any(got[k][0]["base_failed"] for k in range(8))


def test_pstable(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    rows = [(k, (centre[k % 6] + rng.standard_normal(16) * 0.06).tolist(), k % 3) for k in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (304, None, 0), (305, [0.0] * 16, 0), (306, [float("nan")] * 16, 0), (307, [None] * 16, 0), (308, [1.0], 0), (309, [], 0), (310, rows[0][1][:8], 0), (311, [2 * x for x in rows[0][1]], 0), (312, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, bucket int")
    got = {r["vec_id"]: r for r in pstable.near_duplicates(df).collect()}
    ok = {k: np.array(v) for k, v, y in rows if y is not None and v and not any(x is None or not math.isfinite(x) for x in v) and any(v)}
    label = {k: y for k, _, y in rows}
    linked = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98]
    n = Counter(k for pair in linked for k in pair)
    low = least_reachable(label, linked)
    found = sum(got[k]["n_links"] for k in label)
    assert found >= 0.99 * 2 * len(linked) and all(got[k]["n_links"] <= n[k] for k in label)
    assert sum(got[k]["component_id"] == low[k] for k in label) >= 0.99 * len(label)
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in label)
    assert pstable.near_duplicates(df.where("false")).count() == 0


def test_pstable_blocks_count_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, (np.ones(8) + rng.standard_normal(8) * 0.01).tolist(), 0) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(pstable, "BLOCK", 17)
    monkeypatch.setattr(pstable, "SMALL", 6)
    monkeypatch.setattr(pstable, "ROWS", 200)
    got = pstable.near_duplicates(df).collect()
    assert {r["n_links"] for r in got} == {119} and {r["component_id"] for r in got} == {0}


@pytest.mark.parametrize("cosine", [0.98, 0.99])
def test_pstable_finds_pairs_at_the_threshold_and_compares_few(cosine):
    rng = np.random.default_rng(5)
    n = 6000
    x = rng.standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    z = rng.standard_normal((n, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.sqrt((z * z).sum(axis=1, keepdims=True))
    y = cosine * x + math.sqrt(1 - cosine**2) * z
    tables, hashes = pstable.planned(n, 0.98)
    label = np.zeros(n, np.int64)
    a, b = (pstable.keys(v, label, tables, hashes, pstable.WIDTH, 3) for v in (x, y))
    assert (a == b).any(axis=1).mean() >= 0.995
    met = sum(sum(c * (c - 1) // 2 for c in Counter(a[:, t].tolist()).values()) for t in range(tables))
    assert met < 0.01 * n * (n - 1) / 2
    more = pstable.planned(10**9, 0.98)
    assert more[0] < 200 and more[1] > hashes


def test_toxicity(spark):
    rng = random.Random(1)
    syllables = ["ba", "ko", "ri", "tu", "me", "sal", "den", "for"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = lambda: "grax" + rng.choice(syllables)
    rows = []
    for k in range(700):
        own = [word() for _ in range(rng.randint(10, 150))]
        if k % 4 == 0:
            for _ in range(1 + len(own) // 20):
                own.insert(rng.randint(0, len(own)), bad())
        rows.append((k, " ".join(own), int(k % 4 == 0)))
    odd = [(1000, None, 0), (1001, "", 1), (1002, "  ", 0), (1003, "x" * 5000, 0), (1004, "ba ko " * 20_000 + "graxba", 1), (None, "graxko", 1)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, toxic int, score double")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df.select("doc_id", "text", "score"), model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k] >= toxicity.THRESHOLD) == bool(y) for k, y in held) >= 0.97 * len(held)
    assert got[1000] == got[1001] == got[1002] == 0 and got[1004] > 0.7
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.train([("a b", 0)]) is None
    assert toxicity.scored(df.where("false"), None).count() == 0
    odd = df.select("doc_id", "text", df["toxic"].alias("a.b"), df["score"].alias("Score")).where("doc_id < 3")
    named = toxicity.scored(odd.unionAll(odd), model)
    assert named.columns == ["doc_id", "text", "a.b", "Score", "score"] and sorted(r[4] for r in named.collect()) == pytest.approx(sorted(2 * [got[k] for k in range(3)]), abs=1e-6)
    assert toxicity.fit(df.where("false"), df.select("doc_id", "toxic")) is None


def test_toxicity_scores_by_hand():
    """A network of random weights, word by word, against a plain loop."""
    rng = np.random.default_rng(6)
    hc, h, a = toxicity.HC, toxicity.H, toxicity.A
    d = 2 * hc + 2
    g = lambda *shape: rng.standard_normal(shape).astype(np.float32) * 0.5
    chars = {c: k + 1 for k, c in enumerate("abcde")}
    model = toxicity.Model(chars, {"abc": 0.7, "dd": -0.4}, {"xf": g(6, 3 * hc), "xb": g(6, 3 * hc), "uf": g(hc, 3 * hc), "ub": g(hc, 3 * hc), "v": g(2 * hc), "b": g(1)}, {"wf": g(d, 3 * h), "wb": g(d, 3 * h), "bf": g(3 * h), "bb": g(3 * h), "uf": g(h, 3 * h), "ub": g(h, 3 * h), "wa": g(2 * h, a), "va": g(a), "v": g(2 * h), "b": g(1)})
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(inputs, u):
        state, out, n = np.zeros(len(u)), [], len(u)
        for x in inputs:
            r_ = state @ u
            z, r = sig(x[:n] + r_[:n]), sig(x[n : 2 * n] + r_[n : 2 * n])
            c = np.tanh(x[2 * n :] + r * r_[2 * n :])
            state = (1 - z) * state + z * c
            out.append(state)
        return out

    def word(w):
        f = run([model.c["xf"][chars.get(c, 0)] for c in w], model.c["uf"])[-1]
        b = run([model.c["xb"][chars.get(c, 0)] for c in w[::-1]], model.c["ub"])[-1]
        ends = np.concatenate([f, b])
        return np.concatenate([ends, [np.tanh((ends @ model.c["v"] + model.c["b"][0]) / 3), model.odds.get(w, 0.0)]])

    def window(words):
        x = [word(w) for w in words]
        f = run([v @ model.w["wf"] + model.w["bf"] for v in x], model.w["uf"])
        b = run([v @ model.w["wb"] + model.w["bb"] for v in x[::-1]], model.w["ub"])[::-1]
        states = np.array([np.concatenate(p) for p in zip(f, b)])
        weight = np.exp(np.tanh(states @ model.w["wa"]) @ model.w["va"])
        return sig((weight / weight.sum()) @ states @ model.w["v"] + model.w["b"][0])

    py = random.Random(2)
    texts = [" ".join("".join(py.choice("abcdef") for _ in range(py.randint(1, 5))) for _ in range(n)) for n in (1, 5, 31, 32, 33, 52, 53, 90)]
    for text, got in zip(texts, toxicity.Scorer(model).scores(texts)):
        w = text.split()
        starts = [s for s in range(0, len(w), toxicity.STEP) if s == 0 or s < len(w) - toxicity.SPAN + toxicity.STEP]
        assert starts[-1] + toxicity.SPAN >= len(w)
        assert got == pytest.approx(max(window(w[s : s + toxicity.SPAN]) for s in starts), abs=1e-4)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    x, u = rng.standard_normal((4, 3, 6)).astype(np.float32), rng.standard_normal((2, 6)).astype(np.float32) * 0.5
    mask = np.arange(4)[:, None] < np.array([4, 2, 3])[None, :]
    states, kept = toxicity.gru(x, mask, u)
    d = np.zeros_like(states)
    d[-1] = 1
    dx, du = toxicity.gru_back(d, mask, u, kept)
    for at in [(0, 0), (1, 3), (1, 5)]:
        more, less = u.copy(), u.copy()
        more[at] += 1e-2
        less[at] -= 1e-2
        want = (toxicity.gru(x, mask, more)[0][-1].sum() - toxicity.gru(x, mask, less)[0][-1].sum()) / 2e-2
        assert du[at] == pytest.approx(want, abs=5e-3)
    sizes = np.array([4, 3, 2])
    fast = toxicity.gru_states(x[:, [0, 2, 1]], sizes, u)
    assert np.allclose(fast[:, 0], states[:, 0], atol=1e-5) and np.allclose(fast[2, 1], states[2, 2], atol=1e-5)


def test_langid(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ba", "ke", "li"], "bb": ["strü", "öck", "ng"], "cc": ["ño", "que", "ión"]}
    rows = [(k, " ".join("".join(rng.choice(sounds[g]) for _ in range(3)) for _ in range(rng.randint(3, 60))), g) for k, g in enumerate(list(sounds) * 60)]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (903, "strüngöck " * 9000, None), (None, "bakeli", "aa")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.predicted(df, langid.fit(df)).collect()}
    held = [(k, g) for k, _, g in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k]["lang_pred"] == g for k, g in held) >= 0.98 * len(held)
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = df.where("false")
    assert langid.predicted(df, langid.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert langid.predicted(nothing, langid.fit(df)).count() == 0
    twice = langid.predicted(df.unionAll(df), langid.fit(df))
    assert twice.count() == 2 * df.count()


def test_langid_by_hand(spark):
    """Counts, probabilities and posteriors against a dict of n-grams."""
    rows = [(1, "abc abd", "x"), (3, "Bcd", "y"), (4, "éa, 7 b", "y"), (9, "abc", "x"), (10, "zz", "y")]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    tokens = lambda t: [g for i in range(len(t)) for n in (1, 2, 3) if (g := ("".join(c if c.isalpha() else " " for c in t.lower()) + "   ")[i : i + n]).strip()]
    feature = {}
    for text in [t for _, t, _ in rows] + ["abé dz"]:
        for g in tokens(text):
            at = langid.grams([g[::1]])[0][0][len(g) - 1]
            feature[g] = int(at)
    counts = {k: Counter(feature[g] for _, t, y in rows if y == k for g in tokens(t)) for k in {y for *_, y in rows}}
    langs = sorted(counts)
    assert model.languages == langs

    def posterior(text):
        score = []
        for k in langs:
            total = sum(counts[k].values()) + langid.SMOOTHING * langid.FEATURES
            prior = math.log(sum(y == k for *_, y in rows) / len(rows))
            score.append(prior + sum(math.log((counts[k][feature[g]] + langid.SMOOTHING) / total) for g in tokens(text)))
        best = max(range(len(langs)), key=lambda j: score[j])
        return langs[best], 1 / sum(math.exp(x - score[best]) for x in score)

    for text in [t for _, t, _ in rows] + ["abé dz"]:
        lang, p = model.predict([text])
        want = posterior(text)
        assert lang == [want[0]] and p[0] == pytest.approx(want[1], rel=1e-3)


@pytest.mark.parametrize("name", ["full", "empty"])
def test_pipeline(spark, tmp_path, name):
    """Every stage against its brute-force version, on odd rows and on none."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [(None, prose(50), "en", "s0", 1), (None, None, None, None, None), rows[20], rows[20], (20, prose(30), "en", None, 1), (900, " " * 1_100_000 + "end", "en", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (df if name == "full" else df.where("false")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "mixing", "packing"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        assert stage == "packing" or out.columns == list(corpus_pipeline.COLUMNS), stage
        out.write.parquet(f"{tmp_path}/{stage}")
        docs = spark.read.parquet(f"{tmp_path}/{stage}")
        seen[stage] = [tuple(r) for r in docs.collect()]
    if name == "empty":
        assert not any(seen.values())
        return
    assert Counter(seen["toxicity"]) == Counter(rows)  # no label is toxic, so nothing is learned and nothing goes

    def shingles(text):
        w = WORD.findall((text or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    known = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in known]
    label = least_reachable(range(len(known)), [(a, b) for a in range(len(known)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    groups = {}
    for k, r in enumerate(known):
        groups.setdefault(label[k], []).append(r)
    left = Counter(seen["simhash"])
    assert sum(left.values()) == len(groups) + 2 and all(sum(left[r] for r in set(g)) == 1 and min(r[0] for r in g) in [r[0] for r in g if left[r]] for g in groups.values())
    words = [WORD.findall(r[1] or "") for r in seen["simhash"]]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(seen["simhash"], words):
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        if not w or len(gone) < len(w):
            text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
            want[r[0], text, r[3]] += 1
    assert Counter((r[0], r[1], r[3]) for r in seen["substring"]) == want
    mixed = Counter((r[0], r[1], r[3]) for r in seen["mixing"])
    assert set(mixed) == set(want) and all(want[k] <= n <= 2 * want[k] for k, n in mixed.items())
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = Counter()
    for (key, text, _), n in mixed.items():
        ids[key] += n * (len(own.encode(text or "", add_special_tokens=False).ids) + 1)
    packed = Counter()
    for r in docs.collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_pipeline_links_similar_texts(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [None, "", "one two", "ONE  two", "a b c d e f g h", "a b c d e f g h i", prose(20_000)]
    for n in (30, 60, 100, 300, 700):
        for _ in range(6):
            texts.append(prose(n))
            for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
                texts.append(" ".join(w if rng.random() > share else "zz" + w for w in texts[-1].split()))
    rng.shuffle(texts)

    def shingles(text):
        w = WORD.findall((text or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = dict(enumerate(map(shingles, texts)))
    linked = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    label = least_reachable(sets, linked)
    assert 40 < len(set(label.values())) < len(texts) - 40
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for chunk, most in ((5_000_000, 256), (20_000, 3)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "PER_BUCKET", 2 * chunk)
        monkeypatch.setattr(simhash, "TEXTS", most)
        got = [r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, df, "").collect()]
        assert sorted(got) == sorted(set(label.values()))
    assert corpus_pipeline.simhash_stage(spark, df.where("false"), "").count() == 0


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    one, two = prose(80), prose(90)
    near = " ".join([*one.split()[:-1], "zz"])
    rows = [(None, one), (None, one), (None, None), (None, prose(50)), (5, one), (5, one), (5, near), (5, two), (3, near), (9, two), (7, prose(40))]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_stage(spark, df, "").collect()]
    assert Counter(got) == Counter(rows[:4] + [(3, near), (5, two), rows[10]])


@pytest.mark.parametrize("shape", ["chain", "sorted", "star", "random"])
def test_components_of_long_chains(spark, shape):
    n = 1500
    ids = [RNG.getrandbits(62) for _ in range(n)]
    if shape == "sorted":
        ids.sort()
    edges = [(ids[0], x) for x in ids[1:]] if shape == "star" else [(RNG.choice(ids), RNG.choice(ids)) for _ in range(n)] if shape == "random" else list(zip(ids, ids[1:]))
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least_reachable({k for e in edges for k in e}, edges)


def test_pipeline_sends_sets_once(spark):
    """Many near copies in several classes: rows for the exact comparison don't grow with the square of their number."""
    import corpus_pipeline

    rng, words = random.Random(3), prose(120).split()
    texts = set()
    while len(texts) < 600:
        cut = set(rng.sample(range(0, 120, 5), rng.randint(2, 5)))
        texts.add(" ".join("zz" + w if k in cut else w for k, w in enumerate(words)))
    texts = sorted(texts)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, df, "").collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made, every = [], store.executionsList()
    for k in range(before, every.size()):
        at = every.apply(k).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate":
                of = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in of if m.name() == "number of output rows"]
    assert made and max(made) <= len(texts)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(116)) for w in (t.split() for t in texts)]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = least_reachable(range(len(sets)), linked)
    assert 1 < len(set(label.values())) < len(texts) and got == sorted(set(label.values()))


@pytest.mark.parametrize("few", [True, False])
def test_pipeline_tree_leaves_out_no_pair(monkeypatch, few):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(simhash, "LEAF", 16)
    base = rng.integers(0, 1 << 63, (4 if few else 150, 4), dtype=np.uint64)
    wide = base[rng.integers(0, len(base), 900)]
    for _ in range(30):
        wide[np.arange(900), rng.integers(0, 4, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)
    n, known = np.exp(rng.normal(5, 1, 900)).astype(np.int64) + 5, rng.integers(0, 700, 900)
    alone = (n * rng.uniform(0, 0.2, 900)).astype(np.int64)
    pairs = []
    for a in range(900):
        for b in range(a):
            most, apart = min(n[a] - alone[a], n[b] - alone[b]), np.bitwise_count(wide[a] ^ wide[b]).sum()
            if known[a] != known[b] and apart <= simhash.REACH and 5 * most >= 4 * (n[a] + n[b] - most):
                pairs.append((a, b))
    want = least_reachable(range(900), pairs)
    got = least_reachable(range(900), list(zip(*(x.tolist() for x in simhash.open_links(wide, known, n, alone, 0.8)))))
    assert pairs and got == want


def test_phrases_automaton_streams_only_its_words(monkeypatch):
    """Stretches that can't hold a window never reach the automaton, and the words removed are those of brute force."""
    rng, lexicon = random.Random(6), [f"r{k}" for k in range(5000)]
    few = [f"q{k}" for k in range(40)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(400)) for _ in range(20)]
    texts += [" ".join([*few[:k], rng.choice(lexicon), *few, "tail", *few[k:]]) for k in (0, 5, 20)]
    texts += [" ".join(few[:34]), " ".join(few[:20]), " ".join(few[20:]), "", None]  # joined with the next they would be windows
    seen, matches = [], phrases.Shard.matches
    monkeypatch.setattr(phrases.Shard, "matches", lambda self, numbers: seen.append(len(numbers)) or matches(self, numbers))
    chunk = phrases.Chunk(texts, 35, 2)
    got = [int(x.sum()) for x in phrases.located(chunk, np.zeros(0, np.int64), [])]
    words = [(t or "").split() for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = sum(len({i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}) for w in words)
    assert sum(got) == want > 0
    assert seen and all(35 <= n <= 100 for n in seen) and sum(seen) < 500
