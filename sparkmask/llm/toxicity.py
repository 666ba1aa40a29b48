"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as a learned vector of its own and as the scaled sum of the vectors of its character n-grams, so that
unseen words with known beginnings count.  All windows of WIDTH words, one starting at every word that leaves room, are
scored, and a text's score is that of its worst window; a shorter text is one window.  Labels belong to texts, so
training looks for the window of each toxic text that bears the label: first by log-odds of words and n-grams, then by
the network itself.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, pieces
from .textops import U64, Words, mix, powers

WIDTH = 16
#: Words between the windows that training draws from; scoring takes all of them.
TRAIN_STRIDE = 8
#: Size of a word's vector, of the n-grams' sum, and of the state of either direction.
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
BUCKETS = 1 << 16
#: Labelled rows taken for training, and characters of such a row, at most.  Longer rows are scored but not learned from,
#: so that fewer rows may take part than are taken.
TRAIN_ROWS, TRAIN_CHARS = 6_000, 20_000
#: Steps of gradient descent a round, and windows a step: the cost of training doesn't depend on the input.
STEPS, BATCH = 350, 128
#: Texts of the training set that must hold a word or an n-gram for a vector of its own.
SUPPORT = 4
CHUNK = 1 << 20

#: Windows whose states are held at once.
BLOCK = 4096

_IN_WORD = np.zeros(256, bool)
_IN_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
_PREFIXES, _INNER = (3, 4, 5, 6, 7, 8), 4


class Lexicon:
    """Distinct words of some texts with the buckets of their n-grams, and the texts as indices into them."""

    def __init__(self, texts: list[str | None]):
        w = Words([(t or "").lower() for t in texts], _IN_WORD)
        self.first = w.first
        _, at, index = np.unique(w.hash, return_index=True, return_inverse=True)
        self.index = index.astype(np.int32)
        self.word = (w.hash[at] >> U64(48)).astype(np.uint16)
        start, end = w.start[at], w.end[at]
        up, down = powers(len(w.buffer) + 1)
        data = np.frombuffer(w.buffer, np.uint8).astype(U64)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum((data + U64(1)) * up[: len(data)])])
            owner, gram = [], []
            for k in _PREFIXES:
                has = np.flatnonzero(end - start >= k)
                owner.append(has)
                gram.append((total[start[has] + k] - total[start[has]]) * down[start[has]] + U64(k))
            inner = np.maximum(0, end - start - _INNER)
            who = np.repeat(np.arange(len(at)), inner)
            place = start[who] + 1 + np.arange(len(who)) - np.repeat(np.cumsum(inner) - inner, inner)
            owner.append(who)
            gram.append((total[place + _INNER] - total[place]) * down[place])
            owner, gram = np.concatenate(owner), mix(np.concatenate(gram)) >> U64(48)
        order = np.argsort(owner, kind="stable")
        self.gram = gram[order].astype(np.uint16)
        self.grams = np.bincount(owner, minlength=len(at))
        self.gram_first = np.concatenate([[0], np.cumsum(self.grams)])

    def blocks(self, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words that have n-grams, these n-grams, first one of each word), by blocks of words."""
        for i in range(0, len(self.word), size):
            j = min(i + size, len(self.word))
            has = i + np.flatnonzero(self.grams[i:j])
            if len(has):
                yield has, self.gram[self.gram_first[i] : self.gram_first[j]], self.gram_first[has] - self.gram_first[i]

    def windows(self, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index, whether there is a word, document) of the windows at every `stride` words, the last ones of texts
        included; a text of fewer words than WIDTH, but not of none, has one."""
        n = np.diff(self.first)
        many = np.where(n > WIDTH, -(-(n - WIDTH) // stride) + 1, (n > 0).astype(n.dtype))
        doc = np.repeat(np.arange(len(n)), many)
        start = self.first[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
        place = start[:, None] + np.arange(WIDTH)
        real = place < self.first[doc + 1][:, None]
        return self.index[np.minimum(place, max(0, len(self.index) - 1))] if len(doc) else place, real, doc


def inputs(model: dict, lexicon: Lexicon) -> np.ndarray:
    """A row per distinct word: its own vector, and its n-grams' sum over the root of their number."""
    x = np.zeros((len(lexicon.word), WORD_DIM + CHAR_DIM), np.float32)
    x[:, :WORD_DIM] = model["words"][lexicon.word]
    for has, gram, first in lexicon.blocks():
        x[has, WORD_DIM:] = np.add.reduceat(model["chars"][gram], first, axis=0) / np.sqrt(lexicon.grams[has])[:, None]
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run(model: dict, x: np.ndarray, index: np.ndarray, real: np.ndarray, keep: bool = False):
    """Logits of windows; with `keep` also what the gradient needs."""
    n, h = len(index), HIDDEN
    states = np.zeros((n, WIDTH, 2 * h), np.float32)
    kept = [[], []]
    for d in (0, 1):
        given, u = x @ model["w"][d] + model["b"][d], model["u"][d]
        state = np.zeros((n, h), np.float32)
        for t in range(WIDTH) if d == 0 else range(WIDTH - 1, -1, -1):
            g, back = given[index[:, t]], state @ u
            gates = sigmoid(g[:, : 2 * h] + back[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(g[:, 2 * h :] + r * back[:, 2 * h :])
            m = real[:, t, None]
            after = np.where(m, new + z * (state - new), state)
            if keep:
                kept[d].append((t, state, z, r, new, back[:, 2 * h :]))
            state = after
            states[:, t, d * h : (d + 1) * h] = state
    e = np.where(real, states @ model["attend"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=1, keepdims=True))
    share = e / e.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", share, states)
    logit = pooled @ model["out"] + model["bias"]
    return (logit, states, kept, share, pooled) if keep else logit


def gradients(model: dict, x: np.ndarray, index: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the mean logistic loss, for the network's weights and for the rows of x."""
    h = HIDDEN
    logit, states, kept, share, pooled = run(model, x, index, real, keep=True)
    error = (sigmoid(logit) - y).astype(np.float32) / len(y)
    grad = {"out": pooled.T @ error, "bias": error.sum(), "w": [], "u": [], "b": []}
    d_pooled = error[:, None] * model["out"]
    d_share = np.einsum("bh,bth->bt", d_pooled, states)
    d_e = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    grad["attend"] = np.einsum("bt,bth->h", d_e, states)
    d_states = share[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * model["attend"]
    d_x = np.zeros_like(x)
    for d in (0, 1):
        u, d_u = model["u"][d], np.zeros_like(model["u"][d])
        d_given = np.zeros((len(x), 3 * h), np.float32)
        d_state = np.zeros((len(y), h), np.float32)
        for t, before, z, r, new, back in reversed(kept[d]):
            d_after = d_states[:, t, d * h : (d + 1) * h] + d_state
            m = real[:, t, None]
            d_now = np.where(m, d_after, 0)
            d_new = d_now * (1 - z) * (1 - new**2)
            d_gates = np.concatenate([d_now * (before - new) * z * (1 - z), d_new * back * r * (1 - r), d_new * r], axis=1)
            d_u += before.T @ d_gates
            d_state = np.where(m, d_now * z, d_after) + d_gates @ u.T
            np.add.at(d_given, index[:, t], np.concatenate([d_gates[:, : 2 * h], d_new], axis=1))
        grad["w"].append(x.T @ d_given)
        grad["b"].append(d_given.sum(axis=0))
        grad["u"].append(d_u)
        d_x += d_given @ model["w"][d].T
    return grad, d_x


def new_model(rng: np.random.Generator) -> dict:
    wide, h = WORD_DIM + CHAR_DIM, HIDDEN
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "words": np.zeros((BUCKETS, WORD_DIM), np.float32),
        "chars": np.zeros((BUCKETS, CHAR_DIM), np.float32),
        "w": [normal(wide, 3 * h, scale=0.4) for _ in (0, 1)],
        "u": [normal(h, 3 * h, scale=0.25) for _ in (0, 1)],
        "b": [np.zeros(3 * h, np.float32) for _ in (0, 1)],
        "attend": normal(2 * h, scale=0.1),
        "out": normal(2 * h, scale=0.3),
        "bias": np.float32(0),
    }


def evidence(lexicon: Lexicon, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per distinct word: the best log-odds of its bucket or of one of its n-grams, by the texts of `use`; and
    which buckets of words and of n-grams so many texts hold that vectors for them are learned."""
    seen = np.zeros((2, 2, BUCKETS))  # words and n-grams, by label
    size = len(lexicon.word)
    for d0, d1 in chunks(np.diff(lexicon.first), 1 << 15):
        part = slice(lexicon.first[d0], lexicon.first[d1])
        doc = np.repeat(np.arange(d0, d1), np.diff(lexicon.first[d0 : d1 + 1]))
        pairs = np.unique((doc * size + lexicon.index[part])[use[doc]])
        doc, word = pairs // size, pairs % size
        n = lexicon.grams[word]
        at = np.repeat(lexicon.gram_first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for k, docs, bucket in ((0, doc, lexicon.word[word]), (1, np.repeat(doc, n), lexicon.gram[at])):
            pairs = np.unique(docs * BUCKETS + bucket)
            for label in (0, 1):
                seen[k, label] += np.bincount(pairs[y[pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
    total = [np.sum(y[use] == label) for label in (0, 1)]
    rate = np.log((seen[:, 1] + 0.2) / (total[1] + 1)) - np.log((seen[:, 0] + 0.2) / (total[0] + 1))
    rate = np.where(seen.sum(axis=1) >= 3, rate, 0)
    out = rate[0][lexicon.word]
    for has, gram, first in lexicon.blocks():
        out[has] = np.maximum(out[has], np.maximum.reduceat(rate[1][gram], first))
    return out, seen.sum(axis=1) >= SUPPORT


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> dict:
    """A model whose cut puts a text at 0.5 where labels of texts that were held back part best.

    With no text of one of the labels nothing can be learned: all scores are then alike, on the side of the only label.
    """
    rng = np.random.default_rng(seed)
    model = new_model(rng) | {"cut": 0.0, "slope": 1.0}
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        model["out"][:] = 0
        model["bias"] = np.float32(3 if len(y) and y[0] else -3)
        return model
    lexicon = _joined(texts)
    index, real, doc = lexicon.windows(TRAIN_STRIDE)
    held = np.array([zlib.crc32(f"{seed}:{i}".encode()) % 5 == 0 for i in range(len(texts))])
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    odds, learned = evidence(lexicon, y, ~held)
    odds = np.maximum(0, odds - 1.5).astype(np.float32)
    rank = (odds[index] * real).sum(axis=1)
    words_state, chars_state = np.full(BUCKETS, 1e-8, np.float32), np.full(BUCKETS, 1e-8, np.float32)
    first, second, step = {}, {}, 0
    pool = np.flatnonzero(~held[doc])
    for _ in range(2):
        order = pool[np.lexsort((-rank[pool], doc[pool]))]
        top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        best = np.zeros(len(texts))
        best[doc[top]] = rank[top]
        marked = pool[(y[doc[pool]] == 1) & (rank[pool] >= np.maximum(best[doc[pool]] * 0.6, 1e-6))]
        yes, no = np.union1d(marked, top[y[doc[top]] == 1]), top[y[doc[top]] == 0]
        clean = pool[y[doc[pool]] == 0]
        hard = clean[np.argsort(-rank[clean], kind="stable")[: len(yes) * 4]]
        if not len(yes) or not len(no):
            break
        for k in range(STEPS):
            step += 1
            rate = 1.0 if k < STEPS * 0.7 else 0.25
            chosen = np.concatenate([rng.choice(yes, BATCH // 2), rng.choice(no, BATCH // 4), rng.choice(hard, BATCH // 8), rng.choice(clean, BATCH // 8)])
            _step(model, lexicon, index[chosen], real[chosen], y[doc[chosen]].astype(np.float32), (words_state, chars_state), learned, first, second, step, rate)
        rank = _logits(model, inputs(model, lexicon), index, real)
    judged = np.flatnonzero(held if held.any() else np.ones(len(texts), bool))
    worst = np.concatenate([worst_logits(model, [texts[k] for k in judged[i:j]]) for i, j in chunks([len(texts[k] or "") for k in judged], CHUNK)])
    seen = np.isfinite(worst)
    model["cut"] = _best_cut(worst[seen], y[judged][seen])
    return model


def _joined(texts: list[str]) -> Lexicon:
    """The lexicon of many texts, made in pieces of bounded memory."""
    parts = [Lexicon(texts[i:j]) for i, j in chunks([len(t or "") for t in texts], CHUNK)]
    whole = Lexicon.__new__(Lexicon)
    shift = np.cumsum([0] + [len(p.word) for p in parts])
    whole.index = np.concatenate([p.index + s for p, s in zip(parts, shift[:-1], strict=True)])
    whole.word = np.concatenate([p.word for p in parts])
    whole.gram = np.concatenate([p.gram for p in parts])
    whole.grams = np.concatenate([p.grams for p in parts])
    whole.gram_first = np.concatenate([[0], np.cumsum(whole.grams)])
    whole.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
    return whole


def _step(model, lexicon, index, real, y, states, learned, first, second, step, rate) -> None:
    """One step: Adam for the network, Adagrad for the rows of the tables that took part."""
    used, inside = np.unique(index, return_inverse=True)
    inside = inside.reshape(index.shape)
    small = Lexicon.__new__(Lexicon)
    n = lexicon.grams[used]
    small.word, small.grams = lexicon.word[used], n
    small.gram_first = np.concatenate([[0], np.cumsum(n)])
    small.gram = lexicon.gram[np.repeat(lexicon.gram_first[used], n) + np.arange(n.sum()) - np.repeat(small.gram_first[:-1], n)]
    x = inputs(model, small)
    grad, d_x = gradients(model, x, inside, real, y)
    flat = {"attend": grad["attend"], "out": grad["out"], "bias": grad["bias"]} | {f"{k}{d}": grad[k][d] for k in "wub" for d in (0, 1)}
    for name, g in flat.items():
        first[name] = 0.9 * first.get(name, 0) + 0.1 * g
        second[name] = 0.999 * second.get(name, 0) + 0.001 * g**2
        move = np.float32(0.01 * rate) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        if name[0] in "wu" and name[1:] in ("0", "1") or name in ("b0", "b1"):
            model[name[0]][int(name[1])] = (model[name[0]][int(name[1])] - move).astype(np.float32)
        else:
            model[name] = (model[name] - move).astype(np.float32)
    owner = np.repeat(np.arange(len(used)), n)
    for table, rows, g, total, may in (
        ("words", small.word, d_x[:, :WORD_DIM], states[0], learned[0]),
        ("chars", small.gram, d_x[owner, WORD_DIM:] / np.sqrt(np.maximum(1, n[owner]))[:, None], states[1], learned[1]),
    ):
        rows, g = rows[may[rows]], g[may[rows]]
        where, back = np.unique(rows, return_inverse=True)
        sums = np.zeros((len(where), g.shape[1]), np.float32)
        np.add.at(sums, back, g)
        total[where] += (sums**2).mean(axis=1)
        model[table][where] -= np.float32(0.05 * rate) * sums / np.sqrt(total[where])[:, None]


def _best_cut(worst: np.ndarray, y: np.ndarray) -> float:
    """The logit from -4 to 4 with the least errors on held-back texts; false alarms count twice, distance from 0 a little."""
    cuts = np.linspace(-4, 4, 81)
    yes, no = np.sort(worst[y == 1]), np.sort(worst[y == 0])
    errors = np.searchsorted(yes, cuts) + 2 * (len(no) - np.searchsorted(no, cuts)) + 0.02 * len(yes) * np.abs(cuts)
    return float(cuts[np.argmin(errors)])


def _logits(model: dict, x: np.ndarray, index: np.ndarray, real: np.ndarray, block: int = 4096) -> np.ndarray:
    out = [run(model, x, index[i : i + block], real[i : i + block]) for i in range(0, len(index), block)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def full_windows(model: dict, x: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Logits of the windows of WIDTH words that start at each word of a sequence but the last WIDTH - 1.

    The same as `run` without masks: features stand in rows, so that every step works on whole blocks of windows, and
    what the words give to the gates is read from one row of words that the windows share.
    """
    h, n = HIDDEN, len(sequence) - WIDTH + 1
    logits = np.empty(max(0, n), np.float32)
    halve = np.repeat(np.float32([0.5, 0.5, 1]), h)  # a logistic gate is half a tanh of half its input, plus a half
    sides = [((x @ model["w"][d] + model["b"][d]) * halve, np.ascontiguousarray((model["u"][d] * halve).T)) for d in (0, 1)]
    for i in range(0, n, BLOCK):
        size = min(BLOCK, n - i)
        words = sequence[i : i + size + WIDTH - 1]
        parts = np.zeros((2, WIDTH, size), np.float32)  # attention and output of each step
        for d, (given, u) in enumerate(sides):
            from_word = np.ascontiguousarray(given[words].T)
            heads = np.stack([model["attend"][d * h : (d + 1) * h], model["out"][d * h : (d + 1) * h]])
            state, back, gates, new = (np.zeros((k * h, size), np.float32) for k in (1, 3, 2, 1))
            for t in range(WIDTH) if d == 0 else range(WIDTH - 1, -1, -1):
                g = from_word[:, t : t + size]
                np.matmul(u, state, out=back)
                np.add(g[: 2 * h], back[: 2 * h], out=gates)
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                np.multiply(gates[h:], back[2 * h :], out=new)
                new += g[2 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= gates[:h]
                state += new
                parts[:, t] += heads @ state
        e = parts[0]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        logits[i : i + size] = (e * parts[1]).sum(axis=0) / e.sum(axis=0) + model["bias"]
    return logits


def worst_logits(model: dict, texts: list[str | None]) -> np.ndarray:
    """The highest logit among all windows of each text; minus infinity for a text without words."""
    lexicon = Lexicon(texts)
    out = np.full(len(texts), -np.inf)
    if not len(lexicon.index):
        return out
    x, n = inputs(model, lexicon), np.diff(lexicon.first)
    long = np.flatnonzero(n >= WIDTH)
    if len(long):
        doc = np.repeat(long, n[long])
        at = lexicon.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n[long]) - n[long], n[long])
        logits = full_windows(model, x, lexicon.index[at])
        inside = np.flatnonzero(doc[: len(logits)] == doc[WIDTH - 1 :])  # a window lies in one text
        first = np.flatnonzero(np.concatenate([[True], doc[inside][1:] != doc[inside][:-1]]))
        out[doc[inside][first]] = np.maximum.reduceat(logits[inside], first)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        place = lexicon.first[short][:, None] + np.arange(WIDTH)
        real = place < lexicon.first[short + 1][:, None]
        out[short] = _logits(model, x, lexicon.index[np.minimum(place, len(lexicon.index) - 1)], real)
    return out


def score(model: dict, texts: list[str | None]) -> np.ndarray:
    """0 to 1 for each whole text; a text without words, empty or null gets 0."""
    out = np.zeros(len(texts))
    for i, j in chunks([len(t or "") for t in texts], CHUNK):
        worst = worst_logits(model, texts[i:j])
        at = np.flatnonzero(np.isfinite(worst))
        out[i + at] = sigmoid(np.clip(model["slope"] * (worst[at] - model["cut"]), -30, 30))
    return out


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """Train on at most `rows` labelled rows of at most TRAIN_CHARS characters, those whose ids hash lowest.

    Rows with a null id, a null text or a label other than 0 and 1 don't take part.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id", "y").limit(rows))  # at most `rows` rows
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    got = texts.join(chosen, "id").select("id", "y", "text").toArrow().to_pandas().sort_values(["id", "y"])
    return train(got["text"].tolist(), got["y"].to_numpy())


def apply(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document row from its whole text.

    Null, empty and wordless texts score 0.  A row with a null or repeated id is a row of the result; other columns,
    whatever they are called, take no part.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = score(model, b.column("text").to_pylist())
            yield pa.record_batch([b.column("id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = dict(documents.dtypes)[id_col]
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rate, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
