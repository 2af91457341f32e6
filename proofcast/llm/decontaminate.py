"""Benchmark items in documents, also with other numbers, names and units.

Numbers, names and units become typed placeholders, neighbours of one type a
single one. Windows of the resulting templates, and windows of the words
themselves in lower case, are hash-joined with those of the items. The values in
the slots of what lines up must then map consistently from item to document,
unless enough words in a row are the item's own.

Items that differ only in such values are one class: windows that they share are
joined once, for the smallest item, and others only where a document has the
values of that item.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut
from proofcast.llm.substring_dedup import _groups

#: Words in a template window, and those of them that must be no placeholder.
WINDOW, LITERALS = 8, 4
#: Words of an item that must line up, or all of a shorter one.
LEAST_WORDS = 13
#: Words put in or left out between parts of one copy.
SHIFT = 4
#: Bits of the filter that documents are held against before anything is shuffled:
#: 4 MB for any benchmark. More items let more through; the join decides.
FILTER_BITS = 25
REMEMBERED = 400_000
#: Units that may take each other's place in a re-parameterised question.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters dollar dollars cent cents euro euros percent degree degrees".split()
)
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-z]{1,2})?")
# Numbers in words; "one" is a pronoun too often to be one.
SMALL = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SPELT = frozenset([*SMALL, *TENS, "zero", "hundred", "thousand", "million", "billion", "dozen", *(f"{t}-{u}" for t in TENS for u in ("one", *SMALL[:8]))])
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
SLOTS = (NUMBER, NAME, UNIT)


def template(word: str) -> tuple[str, str]:
    """The placeholder, or the word in lower case, and the word's value; empty for bare marks."""
    letters = word.isalpha()
    core = word if letters else _EDGE.sub("", word)
    if not core:
        return "", ""
    low = core.lower()
    if low in SPELT or not letters and _NUMBER.fullmatch(low):
        return NUMBER, low
    if low in UNITS:
        return UNIT, low
    if core[0].isupper() and not core[1:].isupper() and core[1:] == core[1:].lower():
        return NAME, low
    return low, low


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class Templates:
    """Codes of words, remembered for the task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1 << 12, 3), np.int64)

    def _learn(self, words: list[str]) -> None:
        at = len(self.known)
        if at + len(words) > len(self.table):
            wider = np.empty((2 * (at + len(words)), 3), np.int64)
            wider[:at] = self.table[:at]
            self.table = wider
        for n, word in enumerate(words, at):
            form, value = template(word)
            own = _code(value)
            self.table[n] = own if form == value else _code(form), own, -1 if not form else int(form not in SLOTS)
            self.known[word] = n

    def of(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words that count, the codes of each one's template and of itself, and whether it is a literal."""
        words = (text or "").split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list(set(words).difference(self.known)))
        all_ = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
        real = all_[:, 2] >= 0
        if not real.all():
            words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
            all_ = all_[real]
        return words, all_[:, 0].astype(np.uint64), all_[:, 1].astype(np.uint64), all_[:, 2]


def windows(codes: np.ndarray, literal: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every window of `size` templates with enough literals, or without `literal` of words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.full(n, size if literal is not None else size + (1 << 20), np.uint64)
    for i in range(size):
        hashes = (hashes ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    if literal is None:
        return hashes.view(np.int64), np.arange(n)
    total = np.concatenate([[0], np.cumsum(literal)])
    at = np.flatnonzero(total[size:] - total[:-size] >= min(LITERALS, (size + 1) // 2))
    return hashes[at].view(np.int64), at


#: `size` is negative for windows of words, which have words for forms and forms for values; `places` has the first word of each part of a window, and the word behind it.
#: `common` says that all items of a class have the window.
WINDOWS = "id bigint, hash bigint, size int, words int, forms array<string>, slot_values array<string>, places array<int>, common boolean"


def _emit(ids: pd.Series, texts: pd.Series, sizes: list[int] | None, allowed: np.ndarray | None, memory: Templates) -> pd.DataFrame:
    """Windows of texts: an item's own sizes, or for documents all `sizes` that pass the filter."""
    out: dict[str, list] = {k.split()[0]: [] for k in WINDOWS.split(", ")}
    for id_, text in zip(ids.tolist(), texts.tolist(), strict=True):
        words, codes, own, literal = memory.of(text)
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (literal[1:] == 1))) if len(words) else np.zeros(0, np.int64)
        edges = np.append(first, len(words))
        for size in sizes if sizes is not None else [min(WINDOW, len(first)), -min(WINDOW, len(words))]:
            if not size:
                continue
            hashes, at = windows(codes[first], literal[first], size) if size > 0 else windows(own, None, -size)
            if allowed is not None and len(hashes):
                place = hashes & ((1 << FILTER_BITS) - 1)
                passed = np.flatnonzero(allowed[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                hashes, at = hashes[passed], at[passed]
            for h, s in zip(hashes.tolist(), at.tolist(), strict=True):
                places = edges[s : s + size + 1].tolist() if size > 0 else list(range(s, s - size + 1))
                pairs = [template(w) for w in words[places[0] : places[-1]]]
                values = [v for _, v in pairs]
                if size > 0:
                    forms = [pairs[x - places[0]][0] for x in places[:-1]]
                    values = [" ".join(values[x - places[0] : y - places[0]]) for x, y in zip(places, places[1:], strict=False)]
                else:
                    forms, values = values, [f for f, _ in pairs]
                common = size > 0 or not any(f in SLOTS for f in values)
                for k, v in zip(out, (id_, h, size, len(words), forms, values, places, common), strict=True):
                    out[k].append(v)
    return pd.DataFrame(out)


def _class_keys(text: str | None) -> tuple[str, str]:
    """Digests of an item's templates, each value by the place where its slot type first has it, and of its words."""
    forms: list[str] = []
    values: list[str] = []
    first: dict[tuple[str, str], int] = {}
    for form, value in map(template, (text or "").split()):
        if form:
            forms.append(f"{form}{first.setdefault((form, value), len(first))}" if form in SLOTS else form)
            values.append(value)
    shape, own = (hashlib.md5(" ".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in (forms, values))
    return shape, own


def item_classes(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, class_id (smallest item_id of the class), same_as (smallest item_id with the same words).

    Items are one class if they differ only in numbers, names and units, and the
    same value comes back at the same places. Rows without an id are left out; of
    rows that repeat an id with other texts each counts. Null texts are empty ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [_class_keys(t) for t in b["text"].tolist()]
            yield pd.DataFrame({"item_id": b["item_id"], "shape": [k for k, _ in keys], "own": [k for _, k in keys]})

    rows = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").alias("text"))
    keyed = cut(rows.where("item_id is not null").distinct().mapInPandas(run, "item_id bigint, shape string, own string"), "item-classes")
    same = keyed.groupBy("shape", "own").agg(F.min("item_id").alias("same_as"))
    classes = same.groupBy("shape").agg(F.min("same_as").alias("class_id"))
    return keyed.join(same, ["shape", "own"]).join(classes, "shape").select("item_id", "class_id", "same_as").distinct()


def item_windows(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Templates()
        for b in batches:
            found = _emit(b["id"], b["text"], None, None, memory)
            if len(found):
                yield found

    return items.mapInPandas(run, WINDOWS)


def document_windows(docs: DataFrame, sizes: list[int], allowed: bytes) -> DataFrame:
    table = np.frombuffer(allowed, np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Templates()
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                found = _emit(part["id"], part["text"], sizes, table, memory)
                if len(found):  # an empty column of lists has no type to convert
                    yield found

    return docs.mapInPandas(run, WINDOWS)


def _filter(found: DataFrame) -> bytes:
    """Bitmap of the hashes' low bits; at most 2^FILTER_BITS bits reach the driver."""
    place = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    # the built-in bitmaps hold 32768 bits each and count places from 1
    parts = found.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    bits = bytearray(1 << (FILTER_BITS - 3))
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        at = (row["bucket"] - 1) * 4096
        bits[at : at + 4096] = row["bits"]
    return bytes(bits)


def _lined(rows: pd.DataFrame) -> dict[int, dict[int, tuple[int, int, tuple | None]]]:
    """What lines up of one document and item: by offset and the item's word, the words of the item and
    of the document and, for a slot, its form and both values."""
    found: dict[int, dict[int, tuple[int, int, tuple | None]]] = {}
    columns = ("size", "item_forms", "item_values", "slot_values", "item_places", "places")
    for size, forms, ours, theirs, i_at, d_at in zip(*(rows[c].tolist() for c in columns), strict=True):
        if size < 0:
            forms, ours, theirs = ours, forms, forms
        for n, form in enumerate(forms):
            i, d, i_size, d_size = int(i_at[n]), int(d_at[n]), int(i_at[n + 1] - i_at[n]), int(d_at[n + 1] - d_at[n])
            slot = (form, ours[n], theirs[n]) if form in SLOTS else None
            # a part of several words gives way to its words where these are known
            if i_size == 1 or i not in found.get(d - i, {}):
                found.setdefault(d - i, {})[i] = (i_size, d_size, slot)
    return found


def _covered(parts: list[dict[int, tuple[int, int, tuple | None]]]) -> tuple[int, bool, bool]:
    """Words of the item that parts cover, whether their slots map consistently, and whether nothing differs."""
    covered: set[int] = set()
    values: dict[tuple, set] = {}
    for part in parts:
        for i, (size, _, slot) in part.items():
            covered.update(range(i, i + size))
            if slot:
                values.setdefault(slot[:2], set()).add(slot[2])
    return len(covered), all(len(v) == 1 for v in values.values()), all(v == {value} for (_, value), v in values.items())


def _copies(id_: int, item: int, of: int, rows: pd.DataFrame) -> list[tuple]:
    """Rows of `leaks` for one document and item."""
    least, parts = min(LEAST_WORDS, of), _lined(rows)
    out, settled = [], set()
    for offset, part in sorted(parts.items()):
        n, consistent, exact = _covered([part])
        if n >= least and consistent:
            out.append((id_, item, offset + min(part), n, of, exact))
            settled.add(offset)
            continue
        own = sorted({i + k for i, (size, _, slot) in part.items() if slot is None or slot[1] == slot[2] for k in range(size)})
        cuts = [0, *(k for k in range(1, len(own)) if own[k] != own[k - 1] + 1), len(own)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x >= least:
                out.append((id_, item, offset + own[x], y - x, of, True))
                settled.add(offset)
    ordered = sorted(parts)
    for k, offset in enumerate(ordered):
        near = ordered[k : bisect_right(ordered, offset + SHIFT, k)]
        if len(near) < 2 or any(offset + x in settled for x in range(-2 * SHIFT, 2 * SHIFT + 1)):
            continue
        n, consistent, exact = _covered([parts[o] for o in near])
        if n >= least and consistent:
            out.append((id_, item, min(o + min(parts[o]) for o in near), n, of, exact))
            settled.update(near)
    return out


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Aligned copies: doc_id, item_id, start (word of the document), n_words, item_words, exact.

    One row for each class of items (`item_classes`) and place where at least 13 of the item's words, or all
    of a shorter one, line up with a document and slot values map consistently: a
    value of the item always to one value of the document. Where they do not, so
    many words in a row that are the item's own make a row, whatever stands beside
    them. Parts of an item that are up to SHIFT words further or less far apart
    count together. `exact` says that all values are the item's own; a row that
    isn't exact names the smallest item of the class, and of items with the same
    words only the smallest is named. Items of
    placeholders only match word for word; null and empty texts and rows without
    an id match nothing; repeated rows repeat nothing; empty tables give no rows.

    A passage that very many documents hold costs a few rows for each of them, and
    the join with the items splits such a hash. Windows of one document and item
    at one offset are at most twice as many as the item has words.
    """
    entries = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text")).where("id is not null")
    classes = item_classes(items, item_text, item_id)
    leads = classes.where("item_id = same_as").select(F.col("item_id").alias("id"), "class_id")
    windowed = item_windows(entries.distinct()).join(leads, "id").where("id = class_id or not common")
    found = cut(windowed, "item-windows")
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    seen = document_windows(rows, sizes, _filter(found))
    ours = found.select("hash", "size", "class_id", "common", F.col("id").alias("item_id"), F.col("words").alias("item_words"), F.col("forms").alias("item_forms"), F.col("slot_values").alias("item_values"), F.col("places").alias("item_places"))
    same = seen.drop("common").join(ours, ["hash", "size"]).where("forms = item_forms")
    lined = same.select("id", "class_id", "item_id", "common", "item_words", "size", "item_forms", "item_values", "slot_values", "item_places", "places")

    def use(rows: pd.DataFrame) -> list[tuple]:
        id_, lead, of = (int(rows[c].iloc[0]) for c in ("id", "class_id", "item_words"))
        out = _copies(id_, lead, of, rows[rows["item_id"] == lead])
        others = sorted(set(rows["item_id"].tolist()) - {lead})
        if not others:
            return out
        common = rows[(rows["item_id"] == lead) & rows["common"]].copy()
        # the values in these are another item's: no word of a document is taken for them
        common["item_values"] = [[f"\0{v}" for v in x] if size > 0 else x for x, size in zip(common["item_values"], common["size"], strict=True)]
        known = {row[2:] for row in out}
        named = []
        for item in others:
            found = _copies(id_, item, of, pd.concat([common, rows[rows["item_id"] == item]]))
            named += [row for row in found if row[5] and row[2:] not in known]
        starts = {row[2] for row in named}
        return [row for row in out if row[5] or row[2] not in starts] + named

    columns = ["doc_id", "item_id", "start", "n_words", "item_words", "exact"]
    schema = "doc_id bigint, item_id bigint, start int, n_words int, item_words int, exact boolean"
    keys = ["id", "class_id", "item_words"]
    return lined.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_groups(keys, use, columns), schema)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without a leak, with all their columns; rows without an id stay."""
    found = leaks(docs, items, text, doc_id).select(F.col("doc_id").alias("__leaky")).distinct()
    return docs.join(found, F.col(f"`{doc_id}`").cast("bigint") == F.col("__leaky"), "left_anti")
