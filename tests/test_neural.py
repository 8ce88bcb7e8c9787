"""The recurrent word model against plain loops, its file and its casing."""

import math

import numpy as np
import pytest

from corpusloom.operators import neural as N

WORDS = ["<unk>", "the", "quick", "brown", "fox", "paris", "nasa", "polish", "iphone", ".", "runs"]


def quantised(v):
    s = max(max(abs(x) for x in v), 1e-9) / 127
    return [max(-127, min(127, math.floor(x / s + 0.5))) for x in v], s


def times(m, v):
    q, s = quantised(v)
    return [sum(int(w) * x for w, x in zip(row, q)) * float(scale) * s for row, scale in zip(m.q, m.scale)]


def plain_states(net, words):
    """The last layer's state, word by word."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    dim, width = net.emb.q.shape[1], net.width
    h, c = [[0.0] * dim for _ in net.layers], [[0.0] * width for _ in net.layers]
    for w in words:
        k = net.ids.get(w, 0)
        x = [float(a) * float(net.emb.scale[k]) for a in net.emb.q[k]]
        for at, layer in enumerate(net.layers):
            g = [b + p + r for b, p, r in zip(layer.bias, times(layer.inputs, x), times(layer.states, h[at]))]
            i, f, n, o = (g[j * width : (j + 1) * width] for j in range(4))
            c[at] = [sig(b) * old + sig(a) * math.tanh(d) for a, b, d, old in zip(i, f, n, c[at])]
            x = [sig(a) * math.tanh(b) for a, b in zip(o, c[at])]
            x = times(layer.project, x) if layer.project is not None else x
            h[at] = x
    return h[-1]


@pytest.mark.parametrize("dim,width", [(8, 8), (6, 10)])
def test_states_and_probabilities(dim, width):
    net = N.drawn(WORDS, dim, width)
    contexts = [[], ["The"], ["the", "quick"], ["the", "quick", "zzz"], ["the", "brown"], ["the", "quick"]]
    h = net.after(contexts)[-1][0]
    for own, context in zip(h, contexts):
        assert own == pytest.approx(plain_states(net, [w.lower() for w in context]), abs=1e-9)
    for w in range(len(WORDS)):
        total = [float(net.out[v]) + sum(float(a) * b for a, b in zip(net.emb.q[v], h[2])) * float(net.emb.scale[v]) for v in range(len(WORDS))]
        want = total[w] - math.log(sum(map(math.exp, total)))
        assert net.log_prob(h[2:3], [WORDS[w]])[0] == pytest.approx(want)
    ranked = net.top(h[2:3], 4)[0]
    assert [lp for _, lp in ranked] == sorted((lp for _, lp in ranked), reverse=True) and "<unk>" not in dict(ranked)
    assert net.log_prob(h[:1], ["nowhere"])[0] == N.OOV


def test_file_round_trip():
    net = N.drawn(WORDS, 6, 10, irregular={"iphone": "iPhone"})
    data = N.written(net)
    back = N.parse(data)
    assert back.vocab == WORDS and back.irregular == {"iphone": "iPhone"}
    assert back.after([["the", "fox"]])[-1][0] == pytest.approx(net.after([["the", "fox"]])[-1][0], abs=1e-5)
    with pytest.raises(ValueError, match="too many"):
        N.parse(data + b"\0")
    with pytest.raises(ValueError, match="format 2"):
        N.parse(data[:20] + b"\2" + data[21:])
    with pytest.raises(ValueError, match="no model"):
        N.parse(b"nope" + data[4:])


def test_casing():
    net = N.drawn(WORDS, irregular={"iphone": "iPhone"})
    for x in (net.case_context, net.case_base, net.case_word, net.case_a):
        x[:] = 0
    pins = {"the": [5, 0, 0, 0], "paris": [0, 5, 0, 0], "nasa": [0, 0, 5, 0], "polish": [3, 4, 0, 0], "iphone": [0, 0, 1, 5], "fox": [0, 1, 0, 5]}
    for w, row in pins.items():
        net.case_bias[net.ids[w]] = row
    words = ["The", "paris", "NASA", "polish", "iphone", "fox", "Zzz"]
    got = net.cased(net.after([["a"]] * len(words))[-1][0], words)
    assert [g[0] for g in got] == ["the", "Paris", "NASA", "Polish", "iPhone", "Fox", "Zzz"]
    assert [g[1] for g in got] == ["the", "Paris", "NASA", "polish", "iPhone", "Fox", "Zzz"]
    assert got[3][2] == ["Polish", "polish"] and got[1][2] == ["Paris"]


def test_phrases():
    net = N.drawn(WORDS)
    assert net.phrases(["a"], "the", 1) == [] and net.phrases(["a"], "the", 4, 0) == []
    found = net.phrases(["a"], "the", 4, 3)
    for shown, lp in found:
        assert 2 <= len(shown) <= 4 and lp < 0 and not {w for w in shown if w in N.PUNCTUATION}
        words, total, before = [w.lower() for w in shown], 0.0, ["a"]
        for k in range(1, len(words)):
            h = net.after([[*before, *words[:k]]])[-1][0]
            total += net.log_prob(h, [words[k]])[0]
        assert lp == pytest.approx(total, abs=1e-6)


def test_batches(spark):
    net = N.drawn(WORDS)
    asked = spark.createDataFrame([(1, ["the", "quick"], "brown", "the"), (2, None, "Paris", "fox"), (3, [], None, None)], "query_id long, context array<string>, w string, seed string")
    got = {r["query_id"]: r for r in N.scored(net, asked).collect()}
    assert set(got) == {1, 2} and got[1]["log_prob"] == pytest.approx(net.log_prob(net.after([["the", "quick"]])[-1][0], ["brown"])[0])
    assert N.predicted(net, asked, 3).count() == 9 and N.phrased(net, asked).count() > 0
    assert N.word_alternatives(net, asked, least=-1.0).where("query_id = 1").count() == 6
    assert N.predicted(net, asked.where("false")).count() == 0
