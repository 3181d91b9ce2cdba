"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a learned vector of its hashed letters plus one summed over its hashed character
3- to 5-grams, so that unseen endings of a stem are read as well. Two gated recurrent layers read
each window of ``SPAN`` words from either side; attention pools their states into one logit per
window. All windows, one every ``STEP`` words, are scored, and a text's logit is the logarithm of the
sum of their exponentials: one toxic passage in a long clean text is enough. Training follows the
same path from the text's label down (whole texts, no window labels).

At most ``SAMPLE`` texts of either label are used for training, the first in hash order of their
keys; every seventh of them is left out to set the point that counts as 0.5. Labels, languages,
sources and keys are never inputs. Texts without words (null, empty) score 0: nothing in them can be
toxic. Without labelled texts of both kinds every score is 0. Repeated rows get equal scores; a text with labels of both kinds
counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import with_columns
from assayer.llm.words import pieces

#: Labelled texts of either kind used at most, words in a window and between windows.
SAMPLE, SPAN, STEP = 800, 24, 12
#: Sizes: word vectors, states in each direction, attention; hash buckets of words and of n-grams.
VECTOR, STATE, ATTEND, WORD_BITS, GRAM_BITS = 16, 8, 8, 14, 15
#: Passes, windows in a batch, rate; windows scored at a time, words that a task remembers.
PASSES, BATCH, RATE = 4, 3000, 0.01
TOGETHER, REMEMBERED = 4096, 150_000
#: New words looked up at a time.
LOOKED_UP = 8192
GRAMS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def gram_buckets(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of ``<word>``, and the word each belongs to, in word order."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in vocabulary), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(vocabulary)), [len(w) + 2 for w in vocabulary])
    buckets, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        gram = np.full(len(flat) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                gram = gram << np.uint64(8) | flat[i : len(flat) - n + 1 + i]
            bucket = gram * _MIX >> np.uint64(64 - GRAM_BITS)
        inside = owner[: len(bucket)] == owner[n - 1 :]
        buckets.append(bucket[inside])
        owners.append(owner[: len(bucket)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owned = np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), owned[order]


def word_buckets(vocabulary: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(w) for w in vocabulary], np.int64) & ((1 << WORD_BITS) - 1)


def summed(rows: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """Sum the ``rows`` of each owner; owners are in order."""
    out = np.zeros((many, rows.shape[1]), np.float32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places (windows x SPAN), which of them are inside the text, and each window's text."""
    size = np.diff(ends)
    many = np.maximum(-(-(size - SPAN) // STEP), 0) + 1
    text = np.repeat(np.arange(len(size)), many)
    start = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STEP
    at = start[:, None] + np.arange(SPAN)
    inside = at < size[text][:, None]
    return np.where(inside, at + ends[:-1][text][:, None], 0), inside.astype(np.float32), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)

        def some(*shape: int, by: float) -> np.ndarray:
            return (r.standard_normal(shape) * by).astype(np.float32)

        self.p = {
            "word": some(1 << WORD_BITS, VECTOR, by=0.05), "gram": some(1 << GRAM_BITS, VECTOR, by=0.05),
            "attend": some(2 * STATE, ATTEND, by=0.3), "attend_b": np.zeros(ATTEND, np.float32),
            "focus": some(ATTEND, by=0.3), "out": some(2 * STATE, by=0.3), "out_b": np.full(1, -2, np.float32),
        }
        for d in "fb":
            self.p |= {
                f"x{d}": some(VECTOR, 3 * STATE, by=0.3), f"h{d}": some(STATE, 3 * STATE, by=0.3),
                f"b{d}": np.zeros(3 * STATE, np.float32),
            }
        self.shift = 0.0

    def vectors(self, word: np.ndarray, gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self.p["word"][word] + summed(self.p["gram"][gram], owner, len(word))

    def projected(self, vectors: np.ndarray, d: str, out: np.ndarray | None = None) -> np.ndarray:
        """Input part of the gates of one direction, once per distinct word."""
        gates = np.matmul(vectors, self.p[f"x{d}"], out=out)
        gates += self.p[f"b{d}"]
        return gates

    def read(self, gates: np.ndarray, at: np.ndarray, inside: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """States (SPAN x windows x STATE) of one direction over the words ``at`` of the table ``gates``."""
        h = np.zeros((len(at), STATE), np.float32)
        states = np.empty((SPAN, len(at), STATE), np.float32)
        recurrent = self.p[f"h{d}"]
        for t in range(SPAN) if d == "f" else range(SPAN - 1, -1, -1):
            x, u, m = gates[at[:, t]], h @ recurrent, inside[:, t : t + 1]
            zr = sigmoid(x[:, : 2 * STATE] + u[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(x[:, 2 * STATE :] + r * u[:, 2 * STATE :])
            new = h + m * (1 - z) * (n - h)
            if kept is not None:
                kept.append((t, h, z, r, n, u[:, 2 * STATE :]))
            states[t] = h = new
        return states

    def pooled(self, states: np.ndarray, inside: np.ndarray) -> tuple:
        a = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        e = a @ self.p["focus"] + (inside.T - 1) * 1e4
        w = np.exp(e - e.max(axis=0)) * inside.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        c = np.einsum("tw,twk->wk", w, states)
        return a, w, c, c @ self.p["out"] + self.p["out_b"][0]

    def logits(self, gates: dict[str, np.ndarray], at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.read(gates[d], at, inside, d) for d in "fb"], axis=2)
        return self.pooled(states, inside)[3]

    def gradients(self, vectors: np.ndarray, at: np.ndarray, inside: np.ndarray, text: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss over texts, those of the word vectors, and the loss."""
        p, g, gates = self.p, {}, {d: self.projected(vectors, d) for d in "fb"}
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.read(gates[d], at, inside, d, kept[d]) for d in "fb"], axis=2)
        a, w, c, logit = self.pooled(states, inside)
        whole = together(logit, text, len(label))
        score = sigmoid(whole)
        loss = -np.mean(label * np.log(score + 1e-7) + (1 - label) * np.log(1 - score + 1e-7))
        dlogit = (((score - label) / len(label))[text] * np.exp(logit - whole[text])).astype(np.float32)
        g["out"], g["out_b"] = c.T @ dlogit, dlogit.sum(keepdims=True)
        dc = dlogit[:, None] * p["out"]
        dstates = w[:, :, None] * dc
        dw = np.einsum("twk,wk->tw", states, dc)
        de = w * (dw - (w * dw).sum(axis=0))
        g["focus"] = np.einsum("twk,tw->k", a, de)
        da = de[:, :, None] * p["focus"] * (1 - a * a)
        g["attend"], g["attend_b"] = np.einsum("twk,twj->kj", states, da), da.sum(axis=(0, 1))
        dstates += da @ p["attend"].T
        dvectors = np.zeros_like(vectors)
        for k, d in enumerate("fb"):
            recurrent, dgates = p[f"h{d}"], np.zeros((len(vectors), 3 * STATE), np.float32)
            dh, drecurrent = np.zeros((len(at), STATE), np.float32), np.zeros_like(recurrent)
            for t, h, z, r, n, u in reversed(kept[d]):
                dh = dh + dstates[t][:, k * STATE : (k + 1) * STATE]
                m = inside[:, t : t + 1]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dx = np.concatenate([dz, dr, dn], axis=1)
                drecurrent += h.T @ du
                dh = dh * (1 - m * (1 - z)) + du @ recurrent.T
                order = np.argsort(at[:, t], kind="stable")
                dgates += summed(dx[order], at[order, t], len(vectors))
            g[f"h{d}"], g[f"x{d}"], g[f"b{d}"] = drecurrent, vectors.T @ dgates, dgates.sum(axis=0)
            dvectors += dgates @ p[f"x{d}"].T
        return g, dvectors, float(loss)


def together(logit: np.ndarray, text: np.ndarray, many: int) -> np.ndarray:
    """Logarithm of the summed exponentials of each text's windows."""
    first = np.searchsorted(text, np.arange(many))
    top = np.maximum.reduceat(logit, first)
    return top + np.log(np.add.reduceat(np.exp(logit - top[text]), first))


class Scorer:
    """Scores texts, remembering the words it has met in tables that are made once."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.gates = self.table(0)

    def table(self, least: int) -> dict[str, np.ndarray]:
        return {d: np.zeros((max(REMEMBERED, least, 1), 3 * STATE), np.float32) for d in "fb"}

    def learn(self, fresh: list[bytes]) -> None:
        vectors = np.empty((len(fresh), VECTOR), np.float32)
        for i in range(0, len(fresh), LOOKED_UP):
            new = fresh[i : i + LOOKED_UP]
            vectors[i : i + len(new)] = self.net.vectors(word_buckets(new), *gram_buckets(new))
        first = len(self.rows)
        for d, gates in self.gates.items():
            self.net.projected(vectors, d, gates[first : first + len(fresh)])
        self.rows |= {w: first + i for i, w in enumerate(fresh)}

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        split = [words(t) for t in texts]
        fresh = {w for s in split for w in s if w not in self.rows}
        if len(self.rows) + len(fresh) > REMEMBERED:
            self.rows = {}
            fresh = {w for s in split for w in s}
            if len(fresh) > len(self.gates["f"]) or len(self.gates["f"]) > REMEMBERED:
                self.gates = self.table(len(fresh))
        if fresh:
            self.learn(sorted(fresh))
        rows = self.rows
        flat = np.array([rows[w] for s in split for w in s], np.int64)
        return flat, np.cumsum([0] + [len(s) for s in split])

    def logits(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits of the texts at ``places``."""
        at, inside, text = windows(ends)
        at = (flat if len(flat) else np.zeros(1, np.int64))[at]
        parts = [
            self.net.logits(self.gates, at[i : i + TOGETHER], inside[i : i + TOGETHER]) for i in range(0, len(at), TOGETHER)
        ]
        return together(np.concatenate(parts), text, len(ends) - 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        flat, ends = self.places(texts)
        out = sigmoid(self.logits(flat, ends).astype(np.float64) - self.net.shift)
        out[np.diff(ends) == 0] = 0
        return out


def batches(size: list[int], order: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in ``order``, cut where a batch has about ``BATCH`` windows."""
    start = total = 0
    for i, t in enumerate(order):
        total += size[t] // STEP + 1
        if total >= BATCH:
            yield order[start : i + 1]
            start, total = i + 1, 0
    if start < len(order):
        yield order[start:]


def train(texts: list[str | None], labels: list[int], seed: int = 1) -> Network | None:
    """Fit a network; every seventh text of either label sets the decision point."""
    label = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    split = [words(t) for t in texts]
    vocabulary = sorted({w for s in split for w in s})
    row = {w: i for i, w in enumerate(vocabulary)}
    flat = [np.array([row[w] for w in s], np.int64) for s in split]
    word, (gram, owner) = word_buckets(vocabulary), gram_buckets(vocabulary)
    begin = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    judged = np.zeros(len(label), bool)
    for y in (0, 1):
        judged[np.flatnonzero(label == y)[::7]] = True
    net, r = Network(seed), np.random.default_rng(seed)
    fit = np.flatnonzero(~judged) if len(set(label[~judged].tolist())) == 2 else np.arange(len(label))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    tick = 0
    passes = max(PASSES, min(40, -(-80 * BATCH // max(1, sum(len(flat[i]) // STEP + 1 for i in fit)))))
    for _ in range(passes):
        for batch in batches([len(x) for x in flat], r.permutation(fit)):
            joined = np.concatenate([flat[i] for i in batch])
            ends = np.cumsum([0] + [len(flat[i]) for i in batch])
            used, local = np.unique(joined, return_inverse=True)
            if not len(used):
                used, local = np.zeros(1, np.int64), np.zeros(1, np.int64)
            grams = np.concatenate([np.arange(begin[u], begin[u + 1]) for u in used])
            owned = np.repeat(np.arange(len(used)), begin[used + 1] - begin[used])
            vectors = net.vectors(word[used], gram[grams], owned)
            at, inside, text = windows(ends)
            g, dvectors, _ = net.gradients(vectors, local[at], inside, text, label[batch])
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], word[used], dvectors)
            order = np.argsort(gram[grams], kind="stable")
            g["gram"] = summed(dvectors[owned[order]], gram[grams][order], len(g["gram"]))
            tick += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                net.p[k] -= RATE * (first[k] / (1 - 0.9**tick)) / (np.sqrt(second[k] / (1 - 0.99**tick)) + 1e-6)
    held = np.flatnonzero(judged)
    scorer = Scorer(net)
    logit = scorer.logits(*scorer.places([texts[i] for i in held]))
    net.shift = decision_point(logit, label[held])
    return net


def decision_point(logit: np.ndarray, label: np.ndarray) -> float:
    """Where the two error rates, false alarms counted twice, add up to the least; the middle of the best gap."""
    order = np.sort(np.unique(logit))
    cuts = np.r_[order[0] - 1, (order[1:] + order[:-1]) / 2, order[-1] + 1]
    wrong = [np.mean(logit[label == 1] < c) + 2 * np.mean(logit[label == 0] >= c) for c in cuts]
    best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
    gaps = np.r_[0, np.diff(order), 0]
    return float(cuts[best[np.argmax(gaps[best])]])


def fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, wanted: str, sample: int) -> Network | None:
    """Train on at most ``sample`` labelled texts of either kind."""
    kinds = labels.where(F.col(wanted).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(wanted).alias("_y"))
    chosen = None
    for y in (0, 1):
        part = kinds.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * sample numbers at most
    rows = docs.select(key, F.col(f"`{text}`").alias("_t")).join(F.broadcast(chosen), key)
    rows = sorted(rows.select(key, "_t", "_y").collect(), key=lambda r: (r[0], r[1] or ""))
    return train([r[1] for r in rows], [int(r[2]) for r in rows])


def scored(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", wanted: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); ``labels`` are those that may be learned from."""
    net = fitted(docs, labels, key, text, wanted, sample)
    if net is None:
        return with_columns(docs, {"score": F.lit(0.0), "predicted": F.lit(0)})

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(net)
        for part in parts:
            for texts in pieces(part):
                yield pa.array(scorer.scores(texts))

    value = docs.withColumn("_score", score(F.col(f"`{text}`")))
    return with_columns(value, {"score": F.col("_score"), "predicted": (F.col("_score") >= 0.5).cast("int")}).drop("_score")
