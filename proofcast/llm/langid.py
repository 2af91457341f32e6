"""Language of a text: averaged embeddings of hashed subwords and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofcast.llm.sample import labelled_sample

ORDERS = (2, 3, 4)
BITS = 16
WIDTH = 16
#: Bytes of text whose subwords are in memory at once.
PIECE = 1 << 20
UNKNOWN = "und"
#: Every ASCII byte that is no letter ends a subword run.
_CLEAN = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Hashed byte n-grams of a text in lower case, a piece at a time.

    Blanks and marks become one space each; n-grams cross word borders, so a
    word's first and last letters are known as such.
    """
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN) + b" "
    longest = max(ORDERS)
    for start in range(0, len(raw), PIECE):
        data = np.frombuffer(raw[start : start + PIECE + longest - 1], np.uint8).astype(np.uint64)
        for n in ORDERS:
            count = min(PIECE, len(data) - n + 1)
            if count <= 0:
                continue
            key = data[:count].copy()
            for i in range(1, n):
                key = (key << np.uint64(8)) | data[i : i + count]
            key = (key + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            yield (key >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    """`table`: what a subword adds to each language's logit, embedding and softmax in one."""

    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, count = np.zeros(len(self.names)), 0
        for hashes in subwords(text):
            total += self.table[hashes].sum(axis=0, dtype=np.float64)
            count += len(hashes)
        return total / max(count, 1) + self.bias

    def probabilities(self, text: str) -> np.ndarray:
        return softmax(self.logits(text) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _pieces(text: str, words: int) -> list[str]:
    parts = text.split()
    return [" ".join(parts[i : i + words]) for i in range(0, len(parts), words)] or [text]


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 2.0, words: int = 40, most_pieces: int = 6, accept: float = 0.99, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on pieces of the texts; one text in five calibrates.

    The temperature is fitted on the texts set apart, and `least`, the smallest
    probability that is accepted, is the one which `1 - accept` of the right
    answers among them fall below.
    """
    names = sorted({label for _, label in rows})
    if not names:
        return LanguageModel([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    at = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(seed)
    learn, apart = [], []
    for k, (text, label) in enumerate(rows):
        pieces = _pieces(text, words)
        picked = pieces if len(pieces) <= most_pieces else [pieces[i] for i in rng.choice(len(pieces), most_pieces, replace=False)]
        (apart if k % 5 == 4 else learn).extend((np.concatenate([*subwords(p), np.zeros(0, np.int64)]), at[label]) for p in picked)
    embed = rng.normal(0, 0.05, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    batch = 32
    for epoch in range(epochs):
        order = rng.permutation(len(learn))
        step = rate * (1 - epoch / epochs)
        for start in range(0, len(order), batch):
            part = [learn[i] for i in order[start : start + batch]]
            ids = np.concatenate([h for h, _ in part])
            sizes = np.array([max(len(h), 1) for h, _ in part], np.float32)
            owner = np.repeat(np.arange(len(part)), [len(h) for h, _ in part])
            mean = np.zeros((len(part), WIDTH), np.float32)
            np.add.at(mean, owner, embed[ids])
            mean /= sizes[:, None]
            error = softmax(mean @ out + bias)
            error[np.arange(len(part)), [y for _, y in part]] -= 1
            error /= len(part)
            back = (error @ out.T) * (step * len(part) / sizes)[:, None]
            out -= step * mean.T @ error
            bias -= step * error.sum(axis=0) * 0.1
            np.subtract.at(embed, ids, back[owner])
    model = LanguageModel(names, embed @ out, bias.astype(np.float64))
    _calibrate(model, apart or learn, accept)
    return model


def _calibrate(model: LanguageModel, pieces: list[tuple[np.ndarray, int]], accept: float) -> None:
    logits = np.array([model.table[h].sum(axis=0) / max(len(h), 1) + model.bias for h, _ in pieces])
    truth = np.array([y for _, y in pieces])

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    sure = softmax(logits / model.temperature)
    right = sure.max(axis=1)[sure.argmax(axis=1) == truth]
    model.least = float(np.quantile(right, 1 - accept)) if len(right) else 0.0


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 400) -> LanguageModel:
    """A model of at most `most` distinct texts of each language, up to 64 KB each."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("label"))
    return train(labelled_sample(rows.withColumn("key", F.xxhash64("text")), most))


def predict(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score, accepted) of whole texts.

    `und` with score 0 for null texts and texts without a letter. `accepted` is
    false where the probability is below the calibrated least, and for `und`;
    callers who want rejection turn those rows into `und`. Without any label to
    learn from, every text is `und`.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double, accepted: boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(whole: str | None) -> tuple:
            if not has_letter(whole) or model.names == [UNKNOWN]:
                return UNKNOWN, 0.0, False
            p = model.probabilities(whole)
            best = int(p.argmax())
            return model.names[best], float(p[best]), bool(p[best] >= model.least)

        for batch in batches:
            yield pd.DataFrame([one(t) for t in batch], columns=["lang_pred", "score", "accepted"])

    return of(text)
