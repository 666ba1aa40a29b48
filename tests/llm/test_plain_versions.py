"""Models and graphs against plain versions written anew: loops over windows, symbols, pairs and edges."""

import math
import random

import numpy as np
import pytest

from sparkmask.llm import pii, quality, toxicity
from tests.llm.test_text_operators import docs


def trained_like(seed):
    """A network with weights of the size that training gives."""
    rng = np.random.default_rng(seed)
    model = toxicity.new_model(rng) | {"cut": 0.3, "slope": 1.0}
    model["words"] = rng.normal(0, 0.7, model["words"].shape).astype(np.float32)
    model["chars"] = rng.normal(0, 0.7, model["chars"].shape).astype(np.float32)
    return model


def plain_window(model, vectors):
    """The logit of one window, word by word, in double precision."""
    h, states = toxicity.HIDDEN, []
    for d in (0, 1):
        state, side = np.zeros(h), {}
        for t in range(len(vectors)) if d == 0 else reversed(range(len(vectors))):
            given = vectors[t] @ model["w"][d].astype(float) + model["b"][d]
            back = state @ model["u"][d].astype(float)
            z, r = (1 / (1 + np.exp(-(given[i : i + h] + back[i : i + h]))) for i in (0, h))
            new = np.tanh(given[2 * h :] + r * back[2 * h :])
            state = z * state + (1 - z) * new
            side[t] = state
        states.append([side[t] for t in range(len(vectors))])
    both = [np.concatenate(s) for s in zip(*states, strict=True)]
    share = np.exp([s @ model["attend"] for s in both])
    return float(sum(a * s for a, s in zip(share / share.sum(), both, strict=True)) @ model["out"] + model["bias"])


def plain_score(model, text):
    lexicon = toxicity.Lexicon([text])
    x, words = toxicity.inputs(model, lexicon).astype(float), lexicon.index.tolist()
    if not words:
        return 0.0
    windows = [words[i : i + toxicity.WIDTH] for i in range(max(1, len(words) - toxicity.WIDTH + 1))]
    worst = max(plain_window(model, [x[w] for w in window]) for window in windows)
    return 1 / (1 + math.exp(-(worst - model["cut"])))


def test_every_window_of_every_text_is_scored():
    rnd, model = random.Random(3), trained_like(3)
    word = lambda: "".join(rnd.choice("abcdeé1") for _ in range(rnd.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 15, 16, 17, 40, 90)]
    texts += ["idiot " * 40, "one idiot", "1d10t and 12345", "", None, "?!", "short", texts[5] + " " + "x " * 30]
    got = toxicity.score(model, texts)
    assert np.allclose(got, [plain_score(model, t or "") for t in texts], atol=2e-5)


def test_repeated_words_are_read_each():
    """A run of one word isn't shortened: the network sees the windows that it makes."""
    model = trained_like(5)
    few, many = (toxicity.Lexicon(["idiot " * n]) for n in (2, 30))
    assert len(few.index) == 2 and len(many.index) == 30 and len(many.windows()[0]) == 30 - toxicity.WIDTH + 1
    assert toxicity.score(model, ["12345"])[0] > 0


def test_the_end_of_a_long_text_counts_like_its_beginning():
    model, rnd = trained_like(7), random.Random(7)
    body = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(9000))
    worst = max(plain_score(model, " ".join(body.split()[i : i + toxicity.WIDTH])) for i in range(0, 2000))
    assert toxicity.score(model, [body])[0] >= worst - 1e-5


def plain_features(text):
    """The statistics of quality.features, from their definition."""
    raw = (text or "").encode()
    n, out = len(raw), [0.0] * (quality.PLAIN + len(quality._SYMBOLS))
    if not n:
        return out
    share = lambda test: sum(map(test, raw)) / n
    out[0:5] = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b >= 128), share(lambda b: b == 32)
    out[5] = 20 * share(lambda b: b == 10)
    out[6] = share(lambda b: b < 9 or 14 <= b < 32 or b == 127)
    lines = raw.split(b"\n")
    out[7] = len(set(lines)) / len(lines)
    for i, symbol in enumerate(quality._SYMBOLS):
        out[quality.PLAIN + i] = min(1, 8 * raw.count(symbol) / n)
    words = raw.lower().split()  # ASCII white space, as bytes have no other
    k = len(words)
    if k:
        sizes = [len(w) for w in words]
        mean = sum(sizes) / k
        out[8], out[9] = mean / 10, math.sqrt(sum((s - mean) ** 2 for s in sizes) / k) / 10
        out[10], out[11] = sum(s <= 2 for s in sizes) / k, sum(s >= 12 for s in sizes) / k
        out[12], out[13] = len(set(words)) / k, max(words.count(w) for w in set(words)) / k
        pairs = list(zip(words, words[1:], strict=False))
        out[14] = sum(a == b for a, b in pairs) / (k - 1) if k > 1 else 0
        out[15] = len(set(pairs)) / max(1, k - 1)
        out[16], out[17] = k < 20, k < 60
    return out


def test_features_of_quality():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aab bcD9 .,!é\n\t漢#") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    texts += [None, "", " ", "one", "word " * 50, "a\nb\na\nb", "x" * 5000]
    assert np.allclose(quality.features(texts), [plain_features(t) for t in texts], atol=1e-9)


def test_gradient_of_pairs_is_that_of_differences():
    rng = np.random.default_rng(2)
    w, diff = rng.normal(size=6), rng.normal(size=(40, 6))
    loss = lambda w: float(np.mean([math.log1p(math.exp(-d @ w)) for d in diff]) + quality.DECAY / 2 * (w @ w))
    for i in range(6):
        step = np.eye(6)[i] * 1e-5
        assert quality.gradient(w, diff)[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, rel=1e-4)


def test_ranking_agrees_with_plain_gradient_descent():
    """The order of documents that the learned strengths give parts the labels as a plain fit of the same loss does."""
    rng = np.random.default_rng(8)
    y = (np.arange(200) % 3 > 0).astype(int)
    x = rng.normal(0, 0.05, (200, quality._WIDTH))
    x[:, 3] += 0.4 * y + rng.normal(0, 0.15, 200)
    model = quality.train(x, y, 0.7)
    z = np.clip((quality.expand(x, model["knots"]) - model["mean"]) / model["scale"], -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(z.shape[1])
    for _ in range(300):
        w -= 0.05 * quality.gradient(w, (z[good][:, None] - z[bad][None]).reshape(-1, z.shape[1]))
    right = lambda w: np.mean((z[good] @ w)[:, None] > (z[bad] @ w)[None])
    assert abs(right(model["w"]) - right(w)) < 0.04 and right(w) > 0.9


def plain_patterns(spans, rounds, confident, support):
    """{pattern: confidence} by loops over the graph of patterns and values."""
    edges = {}
    for value, seed, patterns in spans:
        for p in patterns:
            edges[p, value] = edges.get((p, value), False) or seed
    belief = {e: float(seed) for e, seed in edges.items()}
    for k in range(rounds):
        of = {p: [belief[e] for e in edges if e[0] == p] for p, _ in edges}
        confidence = {p: sum(b) / (len(b) + 1) for p, b in of.items()}
        behind = {p: sum(x >= confident for x in b) for p, b in of.items()}
        if k + 1 < rounds:
            best = {}
            for p, v in edges:
                best[v] = max(best.get(v, 0.0), confidence[p] if behind[p] >= support else 0.0)
            belief = {e: 1.0 if seed else best[e[1]] for e, seed in edges.items()}
    return {p: c for p, c in confidence.items() if behind[p] >= support and c >= confident}


@pytest.mark.parametrize("seed", range(3))
def test_confident_patterns_equal_plain_loops(spark, seed):
    rnd = random.Random(seed)
    spans = []
    for i in range(300):
        group = rnd.randrange(6)
        known = rnd.random() < (0.95, 0.9, 0.8, 0.5, 0.2, 0.0)[group]
        spans.append((f"v{rnd.randrange(120)}-{group}", known, rnd.sample([f"p{group}", f"q{group % 3}", f"r{rnd.randrange(9)}"], rnd.randrange(4))))
    spans += spans[:20]
    got = {r["pattern"]: r["confidence"] for r in pii.confident_patterns(spark.createDataFrame(spans, "value string, seed boolean, patterns array<string>"), 3, 0.6, 4).collect()}
    expected = plain_patterns(spans, 3, 0.6, 4)
    assert expected and got == pytest.approx(expected)


def test_rows_keep_the_spans_of_their_own_text(spark):
    texts = [f"hello customer card number: 4111 1111 1111 1111 {w} mail me at {w}@example.com" for w in "abcdefgh"]
    texts += [f"write to contact address {w}{i}@example.org today" for i, w in enumerate("abcdefgh")]
    found = "please use contact address QX-4471902 today"
    texts += [found, "nothing", found, "nothing", found]
    df = docs(spark, texts).selectExpr("case when doc_id < 16 then doc_id when doc_id < 18 then 50 when doc_id < 20 then null else 51 end as doc_id", "text", "1 as row", "2 as base")
    out = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.personal_data(df).where("doc_id is null or doc_id >= 50").collect()]
    own = [("ident", 27, 37)]
    assert sorted(out, key=repr) == sorted([(50, own), (50, []), (None, own), (None, []), (51, own)], key=repr)


def test_long_and_short_identifiers(spark):
    texts = [f"write to contact address {w}{i}@example.org today" for i, w in enumerate("abcdefgh")]
    texts += ["use contact address AB12345 today", f"use contact address {'7' * 64}x today", "use contact address 1234 today"]
    out = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert out[8] == [("ident", 20, 27)] and out[9] == [("ident", 20, 85)] and out[10] == []
