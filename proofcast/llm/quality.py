"""Text quality from weak labels: heuristics vote, a model of the voters teaches a scorer.

Overlapping heuristics vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns estimates how often each voter is
right about either class, and so the probability that a document of a pattern is
good. These posteriors are the labels of a linear scorer over hashed features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut
from proofcast.llm.sample import labelled_sample

BITS = 14
BAD, GOOD, NONE = 0, 1, 2
#: Words and bytes of a text that are looked at together.
PIECE = 1 << 20

# classes of bytes: 0 blank, 1 newline, 2 small letter (or part of one), 3 capital, 4 digit, 5 common mark, 6.. others
_CLASS = np.full(256, 2, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c == "\n" else 0 if _c.isspace() or _b < 32 else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 if _c in ".,;:'\"()-?" else 6 + _b % 26
_TABLE = _CLASS.tobytes()

_run = re.compile(rb"(.)\1+", re.DOTALL).sub
#: Forms from here on are folded.
_FORMS = 1 << 26

#: name, share below which it votes good, share above which it votes bad
VOTERS = (
    ("symbols", 0.03, 0.10),
    ("capitals", 0.20, 0.50),
    ("repeats", 0.05, 0.20),
    ("near_repeats", 0.25, 0.45),
    ("marked_words", 0.05, 0.20),
    ("bare_marks", 0.05, 0.20),
    ("same_lines", 0.20, 0.40),
)
#: Largest share of good texts that a voter is taken to call bad.
FALSE_ALARMS = 0.01
#: Words a text needs before shares of words say anything.
LEAST_WORDS = 8


def _mixed(values: np.ndarray, kind: int) -> np.ndarray:
    key = (values.astype(np.uint64) + np.uint64(kind << 44)) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - BITS)).astype(np.int64)


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Identity of each word and its form: the runs of its classes of bytes."""
    seen: dict[str, int] = {}
    forms: list[int] = []
    ids = np.empty(text.count(" ") + len(text.split()) + 1, np.int64)
    n = 0
    for n, word in enumerate(text.split(), 1):
        known = seen.get(word)
        if known is None:
            known = seen[word] = len(forms)
            form = 1
            for c in _run(rb"\1", word.encode("utf-8", "surrogatepass").translate(_TABLE)):
                # a long form keeps its last class and never looks like a short one
                form = (form if form < _FORMS else _FORMS + form % _FORMS) * 37 + c + 1
            forms.append(form)
        ids[n - 1] = known
    ids = ids[:n]
    return ids, np.array(forms, np.int64)[ids] if n else np.zeros(0, np.int64)


def profile(text: str | None, taught: bool = True) -> tuple[np.ndarray, list[int]]:
    """Hashed features (bucket of each, repeats included) and the voters' votes; no features unless `taught`."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    ids, forms = _words(text)
    counts = np.bincount(raw, minlength=32)
    letters, visible = counts[2] + counts[3], len(raw) - counts[0] - counts[1]
    again = np.zeros(len(ids), np.int64)  # 1: the word before, 2: one of the seven before that
    for back in range(8, 0, -1):
        again[back:][ids[back:] == ids[:-back]] = 1 if back == 1 else 2
    lines = [line for line in text.split("\n") if line.strip()]
    n = max(len(ids), 1)
    kinds, per_kind = np.unique(forms, return_counts=True)
    marked = sum(int(c) for f, c in zip(kinds.tolist(), per_kind.tolist(), strict=True) if _ends_marked(f))
    bare = sum(int(c) for f, c in zip(kinds.tolist(), per_kind.tolist(), strict=True) if 37 + 6 <= f < 37 + 33)
    enough = len(ids) >= LEAST_WORDS
    shares = {
        "symbols": counts[6:].sum() / visible if visible >= 20 else None,
        "capitals": counts[3] / letters if letters >= 20 else None,
        "repeats": (again == 1).sum() / n if enough else None,
        "near_repeats": (again > 0).sum() / n if enough else None,
        "marked_words": marked / n if enough else None,
        "bare_marks": bare / n if enough else None,
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else None,
    }
    votes = [NONE if (s := shares[v]) is None else GOOD if s <= low else BAD if s >= high else NONE for v, low, high in VOTERS]
    if not taught:
        return np.zeros(0, np.int64), votes
    state = forms * 3 + again
    features = [_mixed(state, 1), _mixed(again, 3)]
    if len(state) > 1:
        features.append(_mixed(state[1:] * 131 + state[:-1], 2))
    if len(raw) > 2:
        wide = raw.astype(np.int64)
        features.append(_mixed((wide[2:] << 12) | (wide[1:-1] << 6) | wide[:-2], 4))
    return np.concatenate(features), votes


def _ends_marked(form: int) -> bool:
    """A word whose last run of bytes is an uncommon mark after something else."""
    return form >= 37 * 37 and (form - 1) % 37 >= 6


def pattern_of(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v
    return code


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in VOTERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def posteriors(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Probability of good for each vote pattern, by expectation maximisation.

    Each voter has, for either class, its own chance of each vote. It starts from
    bad wherever anyone votes bad, since voters call bad only what is far from
    usual and each knows one kind of it; for the same reason no voter is taken to
    call more than FALSE_ALARMS of the good texts bad, which also fixes which class
    is which. A pattern without votes keeps
    the share of good.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    votes = np.array([votes_of(p) for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    good = np.where((votes == BAD).any(axis=1), 0.05, np.where((votes == GOOD).any(axis=1), 0.95, 0.5))
    for _ in range(rounds):
        prior = np.clip((weight * good).sum() / weight.sum(), 0.02, 0.98)
        log = np.stack([np.full(len(patterns), np.log(1 - prior)), np.full(len(patterns), np.log(prior))])
        for j in range(len(VOTERS)):
            for cls, share in ((BAD, 1 - good), (GOOD, good)):
                chance = np.array([(weight * share * (votes[:, j] == v)).sum() for v in (BAD, GOOD, NONE)]) + 1.0
                given = chance[:2] / chance[:2].sum()
                if cls == GOOD:
                    given = np.array([min(given[BAD], FALSE_ALARMS), 1 - min(given[BAD], FALSE_ALARMS)])
                log[cls] += np.where(votes[:, j] == NONE, 0.0, np.log(given)[np.minimum(votes[:, j], 1)])
        top = log.max(axis=0)
        new = np.exp(log[1] - top) / np.exp(log - top).sum(axis=0)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        if not len(buckets):
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets].mean() * SCALE + self.bias, -40, 40))))


SCALE = 10.0


def train(rows: list[tuple[np.ndarray, float]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> QualityModel:
    """Logistic regression on averaged hashed features, towards the posteriors."""
    model = QualityModel(np.zeros(1 << BITS), 0.0)
    rows = [(b, y) for b, y in rows if len(b)]
    if not rows:
        return model
    sparse = []
    for buckets, y in rows:
        at, n = np.unique(buckets, return_counts=True)
        sparse.append((at, n / n.sum() * SCALE, y))
    rng = np.random.default_rng(seed)
    sums = np.full(1 << BITS, 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(sparse)):
            at, x, y = sparse[i]
            p = 1 / (1 + np.exp(-np.clip(model.weights[at] @ x + model.bias, -40, 40)))
            g = (p - y) * x + decay * model.weights[at]
            sums[at] += g * g
            model.weights[at] -= rate * g / np.sqrt(sums[at])
            model.bias -= 0.05 * (p - y)
    return model


def _pattern(text: Column) -> Column:
    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([pattern_of(profile(t, taught=False)[1]) for t in batch], dtype="int32")

    return of(text)


def fit_quality(docs: DataFrame, text: str = "text", most: int = 1500) -> QualityModel:
    """Votes on every document, posteriors from all their counts, a scorer from a sample.

    The driver sees the counts of at most 3^7 patterns and about `most` texts of
    either side of one half (up to 64 KB each), no gold label. An empty table
    gives a model that scores one half.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("key"))
    voted = cut(rows.select("key", _pattern(F.col("text")).alias("pattern")), "votes")
    good = posteriors({r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()})
    sides = {p: int(g >= 0.5) for p, g in good.items()}
    if not sides:
        return train([])
    side = F.element_at(F.create_map(*(F.lit(x) for pair in sides.items() for x in pair)), F.col("pattern"))
    keys = voted.select("key", side.alias("label")).groupBy("key").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    place = F.pmod(F.col("key"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(1.2 * most / n)).otherwise(share)
    picked = F.broadcast(keys.where(place < share))  # about 2.4 * most rows
    sample = labelled_sample(rows.join(picked, "key").select("text", "label", "key"), most)
    taught = []
    for whole, _ in sample:
        buckets, votes = profile(whole)
        taught.append((buckets, good.get(pattern_of(votes), 0.5)))
    return train(taught)


def quality(text: Column, model: QualityModel) -> Column:
    """Score of whole texts, 0 to 1, high for good; one half for null and blank texts."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(profile(t)[0]) for t in batch], dtype="float64")

    return of(text)


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5, most: int = 1500) -> DataFrame:
    """Documents that score `least` or more, with all their columns."""
    model = fit_quality(docs, text, most)
    return docs.where(quality(F.col(f"`{text}`"), model) >= least)
