"""Toxicity of a text: a bidirectional gated recurrent network over all its windows.

A word has two views: an embedding of the word itself and the means of its
hashed letter n-grams and beginnings, so an unseen form of a known stem is still known. Two
gated recurrent layers read a window from either end, attention pools their
states, and a document is as toxic as its most toxic window.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofcast.llm.sample import labelled_sample

WORD_BITS, LETTER_BITS = 15, 16
WIDTH = 8
HIDDEN = 8
#: Words in a window and between the starts of two windows: every word but the
#: first and last ones is seen with words on either side of it.
LENGTH, STEP = 48, 32
ROWS = 4096
#: Training texts that must hold a word before it gets a view of its own; until
#: then its letters speak for it.
COMMON = 8
#: Share of words left out of a window while it is learned, and how fast views of words fade.
DROPPED, FADE = 0.25, 0.01
#: Steps of training: small samples are gone through more often.
STEPS = 450
#: Words whose projections a task remembers; beyond, the memory is emptied.
REMEMBERED = 200_000
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def starts_of(n: int) -> np.ndarray:
    """Starts of windows that cover n words; the last one ends with the text."""
    if n <= LENGTH:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - LENGTH, STEP), n - LENGTH)


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1) for w in words), np.int64, len(words))


def letter_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed parts of every bordered word, whose they are, and their weights.

    Byte n-grams of orders 3 and 4 from anywhere, and beginnings of 5 to 9 bytes,
    which know a stem from the same letters inside another word. Either kind
    counts as its mean.
    """
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    first = np.cumsum(sizes) - sizes
    buckets, owners, weights = [], [], []

    def hashed(key: np.ndarray, kind: int) -> np.ndarray:
        return (((key + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - LETTER_BITS)).astype(np.int64)

    inside = np.maximum(sizes - 2, 0) + np.maximum(sizes - 3, 0)
    for n in (3, 4):
        if len(data) < n:
            continue
        own = owner[: len(owner) - n + 1] == owner[n - 1 :]
        key = data[: len(data) - n + 1].copy()
        for i in range(1, n):
            key = (key << np.uint64(8)) | data[i : len(data) - n + 1 + i]
        whose = owner[: len(owner) - n + 1][own]
        buckets.append(hashed(key[own], n))
        owners.append(whose)
        weights.append(1 / inside[whose])
    key = np.zeros(len(raw), np.uint64)
    starts = np.clip(sizes - 4, 0, 5)
    for n in range(min(9, int(sizes.max(initial=0)))):
        live = np.flatnonzero(sizes > n)
        key[live] = (key[live] * np.uint64(0x100000001B3)) ^ data[first[live] + n]
        if n >= 4:
            buckets.append(hashed(key[live] ^ (key[live] >> np.uint64(31)), 5 + n))
            owners.append(live)
            weights.append(1 / starts[live])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(buckets), np.concatenate(owners), np.concatenate(weights)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape, scale=0.3):
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"word": np.zeros((1 << WORD_BITS, WIDTH), np.float32), "letter": normal(1 << LETTER_BITS, WIDTH, scale=0.1)}
    for d in "fb":
        p |= {f"W{d}": normal(2 * WIDTH, 3 * HIDDEN), f"U{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"A": normal(2 * HIDDEN, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN), "w": normal(2 * HIDDEN), "o": np.zeros(1, np.float32)}
    return p


def _layer(p: dict, d: str, inputs: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (T, B, H) of one direction; `inputs` are projected words (T, B, 3H)."""
    steps, rows, _ = inputs.shape
    U, H = p[f"U{d}"], HIDDEN
    h = np.zeros((rows, H), np.float32)
    out = np.empty((steps, rows, H), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x, hu = inputs[t], h @ U
        zr = sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * H :]))
        out[t] = h = new
    return out


def _pool(p: dict, states: np.ndarray, mask: np.ndarray | None):
    """Attention over states (T, B, 2H): logits, and what the way back needs."""
    a = np.tanh(states @ p["A"] + p["c"])
    e = a @ p["v"]
    if mask is not None:
        e = np.where(mask, e, -1e9)
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = (alpha[:, :, None] * states).sum(axis=0)
    return pooled @ p["w"] + p["o"][0], (a, alpha, pooled)


@dataclass
class ToxicityModel:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    known: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"p": self.p, "slope": self.slope, "shift": self.shift, "known": {}, "rows": None}

    def embedded(self, words: list[str]) -> np.ndarray:
        x = np.zeros((len(words), 2 * WIDTH), np.float32)
        x[:, :WIDTH] = self.p["word"][word_buckets(words)]
        buckets, owner, weight = letter_buckets(words)
        for k in range(WIDTH):
            x[:, WIDTH + k] = np.bincount(owner, self.p["letter"][buckets, k] * weight, len(words))
        return x

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Row of `rows` of every word; both directions' projections are made once a word."""
        if len(self.known) > REMEMBERED or self.rows is None:
            self.known, self.rows = {}, np.zeros((0, 6 * HIDDEN), np.float32)
        new = list(set().union(*texts).difference(self.known))
        if new:
            weights = np.concatenate([self.p["Wf"], self.p["Wb"]], axis=1)
            made = self.embedded(new) @ weights + np.concatenate([self.p["bf"], self.p["bb"]])
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, made.astype(np.float32)])
        find = self.known.__getitem__
        return [np.fromiter(map(find, words), np.int64, len(words)) for words in texts]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Logits of windows of row numbers (B, T); -1 is padding at the end."""
        out = np.empty(len(windows), np.float32)
        for at in range(0, len(windows), ROWS):
            part = windows[at : at + ROWS].T
            mask = part >= 0
            mask = None if mask.all() else mask
            inputs = self.rows[part]
            both = [_layer(self.p, d, inputs[:, :, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN], mask, None) for i, d in enumerate("fb")]
            out[at : at + ROWS] = _pool(self.p, np.concatenate(both, axis=2), mask)[0]
        return out

    def window_logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Logits of all windows of each text; short texts share padded batches."""
        found: list[np.ndarray] = []
        where: list[tuple[int, int]] = []
        full: list[np.ndarray] = []
        short: dict[int, np.ndarray] = {}
        span = np.arange(LENGTH)
        for i, ids in enumerate(self.ids(texts)):
            found.append(np.zeros(0, np.float32))
            if 0 < len(ids) < LENGTH:
                short[i] = np.append(ids, np.full(LENGTH - len(ids), -1))
            elif len(ids):
                for at in range(0, len(begin := starts_of(len(ids))), ROWS):
                    full.append(ids[begin[at : at + ROWS, None] + span])
                    where.append((i, len(full[-1])))
            if sum(map(len, full[-8:])) > 4 * ROWS:
                self._flush(full, where, found)
        self._flush(full, where, found)
        if short:
            for i, logit in zip(short, self.logits(np.array(list(short.values()))), strict=True):
                found[i] = np.array([logit])
        return found

    def _flush(self, full: list, where: list, found: list) -> None:
        if full:
            logits, at = self.logits(np.concatenate(full)), 0
            for i, n in where:
                found[i] = np.append(found[i], logits[at : at + n])
                at += n
            full.clear()
            where.clear()

    def scores(self, texts: list[str | None]) -> list[float]:
        """0 for texts without a word."""
        out: list[float] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(words_of(text))
            size += len(waiting[-1])
            if size > 200_000:
                out += self._scores(waiting)
                waiting, size = [], 0
        return out + self._scores(waiting)

    def _scores(self, texts: list[list[str]]) -> list[float]:
        return [float(sigmoid(self.slope * x.max() + self.shift)) if len(x) else 0.0 for x in self.window_logits(texts)]


def _step(p: dict, g: dict, moments: dict, rate: float, t: int) -> None:
    for k, grad in g.items():
        m, v = moments[k]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def _gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean cross-entropy, and that of the embedded words (T, B, 2 WIDTH)."""
    H, g = HIDDEN, {}
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_layer(p, d, x @ p[f"W{d}"] + p[f"b{d}"], mask, kept[d]) for d in "fb"], axis=2)
    logit, (a, alpha, pooled) = _pool(p, states, mask)
    dlogit = (sigmoid(logit) - y) / len(y)
    g["w"], g["o"] = pooled.T @ dlogit, np.array([dlogit.sum()])
    dpooled = dlogit[:, None] * p["w"]
    dstates = alpha[:, :, None] * dpooled
    dalpha = (states * dpooled).sum(axis=2)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["v"] = np.einsum("tb,tbk->k", de, a)
    da = de[:, :, None] * p["v"] * (1 - a * a)
    g["A"], g["c"] = np.einsum("tbi,tbk->ik", states, da), da.sum(axis=(0, 1))
    dstates = dstates + da @ p["A"].T
    dx = np.zeros_like(x)
    for i, d in enumerate("fb"):
        U, W = p[f"U{d}"], p[f"W{d}"]
        gU, gW, gb = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * H, np.float32)
        dh = np.zeros((x.shape[1], H), np.float32)
        for t, h, z, r, n, hn in reversed(kept[d]):
            dh = dh + dstates[t][:, i * H : (i + 1) * H]
            m = mask[t][:, None]
            dnew, through = np.where(m, dh, 0), np.where(m, 0, dh)
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            own = np.concatenate([dz, dr, dn], axis=1)
            rec = np.concatenate([dz, dr, dn * r], axis=1)
            gU += h.T @ rec
            gW += x[t].T @ own
            gb += own.sum(axis=0)
            dx[t] += own @ W.T
            dh = dnew * z + rec @ U.T + through
        g |= {f"U{d}": gU, f"W{d}": gW, f"b{d}": gb}
    return g, dx


def train(rows: list[tuple[str, int]], batch: int = 128, rate: float = 0.02, per_text: int = 4, seed: int = 11) -> ToxicityModel:
    """Back-propagation through time on windows; every fifth text calibrates the score.

    A toxic text may be clean almost everywhere, so only the windows that look
    worst to the model so far stand for it, once it has seen all kinds in a first
    round. Clean texts teach their worst window and some at random.
    """
    rng = np.random.default_rng(seed)
    model = ToxicityModel(_fresh(rng))
    texts = [(w, int(y)) for text, y in rows if (w := words_of(text))]
    if len({y for _, y in texts}) < 2:
        model.slope, model.shift = 0.0, -4.0
        return model
    learn, apart = [x for i, x in enumerate(texts) if i % 5 < 4], [x for i, x in enumerate(texts) if i % 5 == 4]
    cuts = [starts_of(len(words)).tolist() for words, _ in learn]
    spread = Counter(w for words, _ in learn for w in set(words))
    common = {w for w, n in spread.items() if n >= COMMON}
    p = model.p
    moments = {k: [np.zeros_like(v, dtype=np.float32), np.zeros_like(v, dtype=np.float32)] for k, v in p.items() if k not in ("word", "letter")}
    sums = {"word": np.full(1 << WORD_BITS, 1e-4, np.float32), "letter": np.full(1 << LETTER_BITS, 1e-4, np.float32)}
    size = sum(2 if y else per_text for _, y in learn)
    rounds = min(14, max(6, STEPS * batch // size))
    t = 0
    for turn in range(rounds):
        data = []
        logits = _chunked(model, [words for words, _ in learn]) if turn else [np.zeros(len(c)) for c in cuts]
        for (words, y), starts, seen in zip(learn, cuts, logits, strict=True):
            some = rng.permutation(len(starts))[:per_text].tolist()
            worst = np.argsort(-seen)[: 2 if y else 1].tolist()
            picked = set(some if not turn else worst if y else [*worst, *some[:-1]])
            if turn and y:  # the second only if it looks toxic itself
                picked = {i for i in picked if i == worst[0] or seen[i] > 0}
            data += [(words[starts[i] : starts[i] + LENGTH], y) for i in sorted(picked)]
        order = rng.permutation(len(data))
        for start in range(0, len(order), batch):
            t += 1
            part = [(_without(*data[i], rng), data[i][1]) for i in order[start : start + batch]]
            _learn(p, part, common, moments, sums, rate / (1 + 4 * turn / rounds), t)
    top = [(x.max(), y) for x, (_, y) in zip(_chunked(model, [w for w, _ in apart]), apart, strict=True)]
    _calibrate(model, np.array([x for x, _ in top]), np.array([y for _, y in top]))
    model.known, model.rows = {}, None
    return model


def _without(words: list[str], y: int, rng: np.random.Generator) -> list[str]:
    """A window that lacks some words, so that no combination of plain words is learned by heart."""
    keep = rng.random(len(words)) > DROPPED
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k] or words


def _chunked(model: ToxicityModel, texts: list[list[str]]) -> list[np.ndarray]:
    """Window logits with the weights as they are now."""
    model.known, model.rows = {}, None
    return [x for at in range(0, len(texts), 200) for x in model.window_logits(texts[at : at + 200])]


def _learn(p: dict, part: list, common: set, moments: dict, sums: dict, rate: float, t: int) -> None:
    vocab = sorted({w for words, _ in part for w in words})
    at = {w: i for i, w in enumerate(vocab)}
    ids = np.full((len(part), LENGTH), -1)
    for i, (words, _) in enumerate(part):
        ids[i, : len(words)] = [at[w] for w in words]
    ids, y = ids.T, np.array([y for _, y in part], np.float32)
    mask = ids >= 0
    wb = word_buckets(vocab)
    lb, owner, weight = letter_buckets(vocab)
    letters = np.stack([np.bincount(owner, p["letter"][lb, k] * weight, len(vocab)) for k in range(WIDTH)], axis=1)
    x = np.concatenate([p["word"][wb], letters], axis=1).astype(np.float32)
    g, dx = _gradients(p, x[ids], mask, y)
    for k in g:
        g[k] = np.clip(g[k], -1, 1)
    _step(p, g, moments, rate, t)
    flat, per_word = np.where(mask, ids, 0).ravel(), (dx * mask[:, :, None]).reshape(-1, 2 * WIDTH)
    back = np.stack([np.bincount(flat, per_word[:, k], len(vocab)) for k in range(2 * WIDTH)], axis=1)
    own = np.array([w in common for w in vocab])
    for name, buckets, grad in (("word", wb[own], back[own, :WIDTH]), ("letter", lb, back[owner, WIDTH:] * weight[:, None])):
        used, slot = np.unique(buckets, return_inverse=True)
        total = np.stack([np.bincount(slot, grad[:, k], len(used)) for k in range(WIDTH)], axis=1)
        sums[name][used] += (total**2).mean(axis=1)
        p[name][used] *= 1 - FADE
        p[name][used] -= (0.05 * total / np.sqrt(sums[name][used])[:, None]).astype(np.float32)


def _calibrate(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> None:
    """A slope above zero and a shift that make the largest logit a probability."""
    if len(set(y.tolist())) < 2:
        return
    mid, spread = x.mean(), x.std() + 1e-6
    u, a, b = (x - mid) / spread, 1.0, 0.0
    weight = np.full(len(y), 1 / len(y))
    for _ in range(3000):
        e = (sigmoid(a * u + b) - y) * weight
        a, b = max(a - 2 * ((e * u).sum() + 1e-4 * a), 0.05), b - 2 * e.sum()
    model.slope, model.shift = float(a / spread), float(b - a * mid / spread)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = 1200) -> ToxicityModel:
    """A model of about `most` texts of each label, up to 64 KB each.

    The labelled ids are sampled first, so what is joined to the texts is bounded.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label is not null").distinct()
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not sizes:
        return train([])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, F.lit(1.5 * most / n)).otherwise(share)
    picked = marks.where(place < share)  # about 1.5 * most rows of each label
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "id")
    return train(labelled_sample(rows.select("text", "label", F.xxhash64("text").alias("key")), most))


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score of whole texts, 0 to 1; 0 for null texts and texts without a word."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()), dtype="float64")

    return of(text)
