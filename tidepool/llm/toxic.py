"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words enter as a word vector and the mean of the vectors of their character n-grams (3 to 5 bytes, with
marks at the word's ends), so that words that training never saw are judged by their parts. The network
reads every overlapping window of a text; a text's score is its worst window's. Training knows the label
of a text only: in each round every training text is read whole, and its worst windows stand for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import map_texts, raw
from tidepool.llm.phrases import words

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
GRAMS = (3, 4, 5)
_SLOTS = 1 << 20
#: Texts that an item's evidence is drawn towards none by, and the share of the step that vectors take.
PRIOR, SLOW = 20, 0.1


def gram_codes(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character n-grams of each word, one word after the other, and the word of each."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in vocabulary), np.uint8).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in vocabulary], np.int64)
    owner = np.repeat(np.arange(len(vocabulary)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(data))  # bytes to the word's end
    codes, owners = [], []
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code[: len(data) - n + 1] = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        if n in GRAMS:
            ok = left >= n
            codes.append(code[ok])
            owners.append(owner[ok])
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return codes[order], owners[order]


class GramIndex:
    """Numbers of known n-grams by open addressing; 0 is unknown."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.r_[np.uint64(0), codes]
        self.table = np.zeros(_SLOTS, np.int32)
        for i, c in enumerate(codes.tolist(), 1):
            at = self._slot(np.uint64(c))
            while self.table[at]:
                at = (at + 1) & (_SLOTS - 1)
            self.table[at] = i

    @staticmethod
    def _slot(codes):
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out, at, todo = np.zeros(len(codes), np.int32), self._slot(codes), np.arange(len(codes))
        while len(todo):
            got = self.table[at]
            hit = (self.codes[got] == codes[todo]) & (got > 0)
            out[todo[hit]] = got[hit]
            on = (got > 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & (_SLOTS - 1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """Parameters by name, and the vocabularies. Row 0 of both tables is the unknown; a word's gate inputs
    are computed once and looked up at every step."""

    p: dict[str, np.ndarray]
    number: dict[bytes, int]
    grams: GramIndex

    @classmethod
    def new(cls, number: dict[bytes, int], grams: GramIndex, rng: np.random.Generator) -> Net:
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        p = {"word": (small(len(number) + 1, WORD_DIM) * 0.1), "char": small(len(grams.codes), CHAR_DIM) * 0.1}
        for side in "fb":
            p |= {f"in_{side}": small(d, 3 * h), f"bias_{side}": np.zeros(3 * h, np.float32), f"zr_{side}": small(h, 2 * h), f"n_{side}": small(h, h)}
        p |= {"att": small(2 * h, ATTENTION), "att_bias": np.zeros(ATTENTION, np.float32), "query": small(ATTENTION, 1), "out": small(2 * h, 1), "out_bias": np.zeros(1, np.float32)}
        return cls(p, number, grams)

    def inputs(self, vocabulary: list[bytes]) -> Inputs:
        """Word and n-gram numbers of a list of words."""
        if not vocabulary:
            return Inputs(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
        codes, owner = gram_codes(vocabulary)
        count = np.bincount(owner, minlength=len(vocabulary)).astype(np.float32)
        grams = self.grams(codes)
        known = grams > 0  # unknown n-grams only count
        return Inputs(np.array([self.number.get(w, 0) for w in vocabulary], np.int32), grams[known], owner[known].astype(np.int32), count)

    def vectors(self, x: Inputs) -> np.ndarray:
        sums = np.zeros((len(x.words), CHAR_DIM), np.float32)
        for k in range(CHAR_DIM):
            sums[:, k] = np.bincount(x.owner, self.p["char"][x.grams, k], len(x.words))
        known_word = (x.words > 0)[:, None]
        return np.hstack([self.p["word"][x.words] * known_word, sums / np.maximum(x.count, 1)[:, None]]).astype(np.float32)

    def gates(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of each word and, last, of the padding, whose update gate keeps the state."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = 40
        return [np.vstack([vectors @ self.p[f"in_{s}"] + self.p[f"bias_{s}"], pad]) for s in "fb"]

    def forward(self, at: np.ndarray, gates: list[np.ndarray], keep: bool = False):
        """Logit of each window; at: numbers of its words, with the padding's number where it ends."""
        n, t = at.shape
        h = HIDDEN
        states = np.empty((t, n, 2 * h), np.float32)
        trace = []
        for side, g in zip("fb", gates):
            zr_w, n_w = self.p[f"zr_{side}"], self.p[f"n_{side}"]
            s = np.zeros((n, h), np.float32)
            lo = 0 if side == "f" else h
            for i in range(t) if side == "f" else range(t - 1, -1, -1):
                x = g[at[:, i]]
                zr = sigmoid(x[:, : 2 * h] + s @ zr_w)
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + (r * s) @ n_w)
                if keep:
                    trace.append((side, i, s, z, r, new))
                s = new + z * (s - new)
                states[i, :, lo : lo + h] = s
        u = np.tanh(states.reshape(t * n, 2 * h) @ self.p["att"] + self.p["att_bias"])
        e = (u @ self.p["query"]).reshape(t, n)
        e[at.T == len(gates[0]) - 1] = -1e9
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", e, states)
        logit = (pooled @ self.p["out"])[:, 0] + self.p["out_bias"][0]
        return (logit, states, u, e, pooled, trace) if keep else logit

    def gradient(self, at: np.ndarray, y: np.ndarray, x: Inputs) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by back-propagation through time."""
        vectors = self.vectors(x)
        gates = self.gates(vectors)
        logit, states, u, e, pooled, trace = self.forward(at, gates, keep=True)
        n, t = at.shape
        h, p, out = HIDDEN, self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((sigmoid(logit) - y) / n).astype(np.float32)[:, None]
        out["out"], out["out_bias"] = pooled.T @ d, d.sum(axis=0)
        d_pooled = d @ p["out"].T
        d_states = e[:, :, None] * d_pooled[None]
        d_e = np.einsum("tnd,nd->tn", states, d_pooled)
        d_score = (e * (d_e - (e * d_e).sum(axis=0))).reshape(-1, 1)
        out["query"] = u.T @ d_score
        d_u = (d_score @ p["query"].T) * (1 - u * u)
        flat = states.reshape(t * n, 2 * h)
        out["att"], out["att_bias"] = flat.T @ d_u, d_u.sum(axis=0)
        d_states += (d_u @ p["att"].T).reshape(t, n, 2 * h)
        d_gates = [np.zeros_like(g) for g in gates]
        carry = np.zeros((n, h), np.float32)
        for k, (side, i, s, z, r, new) in enumerate(reversed(trace)):
            if k == t:  # the other direction begins
                carry = np.zeros((n, h), np.float32)
            lo = 0 if side == "f" else h
            dh = carry + d_states[i, :, lo : lo + h]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (s - new) * z * (1 - z)
            d_rs = d_new @ p[f"n_{side}"].T
            d_r = d_rs * s * r * (1 - r)
            d_zr = np.hstack([d_z, d_r])
            out[f"n_{side}"] += (r * s).T @ d_new
            out[f"zr_{side}"] += s.T @ d_zr
            np.add.at(d_gates["fb".index(side)], at[:, i], np.hstack([d_zr, d_new]))
            carry = dh * z + d_rs * r + d_zr @ p[f"zr_{side}"].T
        d_vectors = np.zeros_like(vectors)
        for side, g in zip("fb", d_gates):
            g = g[:-1]
            out[f"in_{side}"], out[f"bias_{side}"] = vectors.T @ g, g.sum(axis=0)
            d_vectors += g @ p[f"in_{side}"].T
        np.add.at(out["word"], x.words, d_vectors[:, :WORD_DIM] * (x.words > 0)[:, None])
        np.add.at(out["char"], x.grams, (d_vectors[:, WORD_DIM:] / np.maximum(x.count, 1)[:, None])[x.owner])
        return out


@dataclass
class Inputs:
    words: np.ndarray
    grams: np.ndarray
    owner: np.ndarray
    count: np.ndarray

    def of(self, rows: np.ndarray) -> Inputs:
        """The inputs of some of the words."""
        to = np.full(len(self.words), -1, np.int64)
        to[rows] = np.arange(len(rows))
        keep = to[self.owner] >= 0
        return Inputs(self.words[rows], self.grams[keep], to[self.owner[keep]], self.count[rows])


def windows(lens: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of texts that follow each other in ids, and the text of each."""
    n = np.where(lens > 0, 1 + np.maximum(0, -(-(lens - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lens)), n)
    first = np.cumsum(lens) - lens
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    inside = place < lens[owner][:, None]
    at = np.full(place.shape, pad, np.int32)
    at[inside] = ids[(place + first[owner][:, None])[inside]]
    return at, owner


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    number: dict[bytes, int] = {}
    ids, lens = [], []
    for t in texts:
        w = words(t)
        lens.append(len(w))
        ids += [number.setdefault(x, len(number)) for x in w]
    return list(number), np.array(ids, np.int64), np.array(lens, np.int64)


def logits(net: Net, at: np.ndarray, gates: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    return np.concatenate([net.forward(at[i : i + chunk], gates) for i in range(0, len(at), chunk)]) if len(at) else np.zeros(0, np.float32)


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    """The worst window's probability; a text without words has 0."""
    vocabulary, ids, lens = numbered(texts)
    at, owner = windows(lens, ids, len(vocabulary))
    worst = np.full(len(texts), -np.inf)
    if len(at):
        np.maximum.at(worst, owner, logits(net, at, net.gates(net.vectors(net.inputs(vocabulary)))))
    return 1 / (1 + np.exp(-np.clip(worst, -700, 700))) * (lens > 0)


def _evidence(one: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    """Log-odds of label 1 in texts that hold an item, drawn towards 0 where texts are few. one, all_:
    texts with label 1, and all texts, that hold each item."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    p = np.clip((one + PRIOR * rate) / (all_ + PRIOR), 1e-6, 1 - 1e-6)
    return np.clip(np.log(p / (1 - p)) - np.log(rate / (1 - rate)), -2, 4)


def _texts_with(y: np.ndarray, by_doc: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    one, all_ = np.zeros(n), np.zeros(n)
    for label, items in zip(y, by_doc):
        all_[items] += 1
        one[items] += label
    return one, all_


def train(texts: list[bytes], labels: list[int], rounds: int = 10, steps: int = 40, rate: float = 0.08, most_words: int = 20_000, most_grams: int = 60_000, least: int = 3, seed: int = 5) -> Net:
    """Fit on whole texts by Adagrad. The vocabularies are the words and n-grams of `least` texts or more, the
    commonest first. The first coordinate of every word and n-gram starts at its evidence. Without texts, or
    with one label only, the network says what there is to say whatever the text."""
    rng, y = np.random.default_rng(seed), np.array(labels, float)
    vocabulary, ids, lens = numbered(texts)
    bounds = np.r_[0, np.cumsum(lens)]
    word_docs = [np.unique(ids[i:j]) for i, j in zip(bounds, bounds[1:])]
    word_one, word_all = _texts_with(y, word_docs, len(vocabulary))
    common = np.flatnonzero(word_all >= least)
    common = common[np.argsort(-word_all[common], kind="stable")][:most_words]
    chosen = [vocabulary[i] for i in common]
    # n-grams of all words, in parts: their codes, and the numbers of each word's n-grams
    chunks = [vocabulary[i : i + 20_000] for i in range(0, len(vocabulary), 20_000)]
    flat = np.zeros(0, np.uint64)
    for c in chunks:
        flat = np.union1d(flat, gram_codes(c)[0])
    where, sizes = [np.zeros(0, np.int32)], []
    for c in chunks:
        codes, owner = gram_codes(c)
        where.append(np.searchsorted(flat, codes).astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(c)))
    where, first = np.concatenate(where), np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))].astype(np.int64)

    def grams_of(w: np.ndarray) -> np.ndarray:
        size = first[w + 1] - first[w]
        return np.unique(where[np.repeat(first[w], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])

    gram_one, gram_all = np.zeros(len(flat)), np.zeros(len(flat))
    for label, w in zip(y, word_docs):
        g = grams_of(w)
        gram_all[g] += 1
        gram_one[g] += label
    kept = np.flatnonzero(gram_all >= least)
    kept = kept[np.argsort(-gram_all[kept], kind="stable")][:most_grams]
    net = Net.new({w: i for i, w in enumerate(chosen, 1)}, GramIndex(flat[kept]), rng)
    if not len(texts) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["out_bias"][:] = 10 if len(y) and y.min() == 1 else -10
        return net
    del where, word_docs
    x = net.inputs(vocabulary)
    net.p["word"][1:, 0] = _evidence(word_one[common], word_all[common], y.mean())
    net.p["char"][1:, 0] = 2 * _evidence(gram_one[kept], gram_all[kept], y.mean())
    for side in "fb":
        net.p[f"in_{side}"][[0, WORD_DIM], 2 * HIDDEN :] += np.float32(0.5)
    at, own = windows(lens, ids, len(vocabulary))
    past = {k: np.full_like(v, 1e-3) for k, v in net.p.items()}
    # Before the network knows anything, the windows with the most evidence stand for their texts.
    hint = np.r_[net.p["word"][x.words, 0] * (x.words > 0) + net.vectors(x)[:, WORD_DIM], 0]
    rank = hint[at].max(axis=1)
    for r in range(rounds):
        if r:
            rank = logits(net, at, net.gates(net.vectors(x)))
        order = np.lexsort((-rank, own))
        place = np.arange(len(own)) - np.searchsorted(own[order], own[order])
        picked = order[place < 2]  # the two worst windows of every text, one of them for texts with label 1
        picked = picked[(y[own[picked]] == 0) | (place[place < 2] == 0)]
        picked = np.r_[picked, rng.choice(np.flatnonzero(y[own] == 0), min(len(picked) // 2, int((y[own] == 0).sum())), replace=False)]
        # As many windows of either label, in `steps` steps at least.
        ones, zeros = picked[y[own[picked]] == 1], picked[y[own[picked]] == 0]
        picked = np.r_[zeros, np.resize(ones, max(len(ones), len(zeros) // 2))]
        batch = min(256, max(32, len(picked) // steps))
        picked = np.concatenate([rng.permutation(picked) for _ in range(max(1, batch * steps // len(picked)))])
        for i in range(0, len(picked), batch):
            rows = picked[i : i + batch]
            used = np.unique(at[rows])
            used = used[used < len(vocabulary)]
            local = np.full(len(vocabulary) + 1, len(used), np.int64)
            local[used] = np.arange(len(used))
            for k, g in net.gradient(local[at[rows]], y[own[rows]], x.of(used)).items():
                past[k] += g * g
                net.p[k] -= np.float32(rate * (SLOW if k in ("word", "char") else 1)) * g / np.sqrt(past[k])
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_texts: int = 4_000, most_chars: int = 20_000) -> Net:
    """Train on at most most_texts labelled texts, half of them (where there are as many) with label 1,
    those with the smallest hashes of their ids; labelled texts of over most_chars characters are left out
    of training, as are null labels and texts."""
    lab = labels.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    own = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.length("text") <= most_chars)
    both = lab.where("label = 1").orderBy(F.xxhash64("key"), "key").limit(most_texts // 2).union(lab.where("label = 0").orderBy(F.xxhash64("key"), "key").limit(most_texts // 2))
    rows = own.join(F.broadcast(both), "key").collect()  # at most most_texts texts of bounded size
    rows.sort(key=lambda r: (r["key"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["label"] for r in rows])


def toxicity(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id_col, score and predicted (1 from the threshold on) of every whole text. A null or empty text, or
    one without words, has score 0; rows are scored one by one and other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sizes of its vocabularies

    def kernel(part: pa.RecordBatch) -> dict:
        s = scores(shared.value, raw(part, "text"))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_texts(docs, id_col, text_col, "score double, predicted int", kernel)
