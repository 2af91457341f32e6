"""Words grouped with the spelling they are a slip of, by pivotal bigrams.

Bigrams are ordered from rare to common. The three rarest of a word are its
prefix; of these the two that don't overlap and are rarest together are its
pivots. One edit spares a pivot of either word, and of two words one edit apart,
that whose prefix ends with the rarer bigram has its spared pivot in the other's
prefix, at the same place or shifted by the edit. So pivots are looked up in an
index of prefixes by bigram, place and length, and what is found is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofcast.llm.common import cut

#: Distinct words a task keeps before it hands them on.
HELD = 1 << 18
#: Words that one key of the index holds at most; a larger one is dealt into parts.
LISTED = 2000
#: A word's length and a bigram's place, as one edit may change them together.
SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = 6, slip: int | None = None) -> DataFrame:
    """word, n: runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of all texts with A-Z in lower case.

    Only words of `min_length` code points or more. With `slip` one run in so many
    loses a code point: where the crc32 of `<doc_id>:<run>` is divisible by it, the
    one at the crc32 modulo the length. Equal runs of a document share this fate, so
    they are counted before.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for name, whole in zip(batch["name"], batch["text"], strict=True):
                if not whole:
                    continue
                found = Counter(runs.findall(whole.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if slip:
                    start = zlib.crc32(f"{name or ''}:".encode())
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % slip:
                            held[run] += n
                        elif len(run) > min_length:
                            k = h % len(run)
                            held[run[:k] + run[k + 1 :]] += n
                else:
                    held.update(found)
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("name"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def pivotal(word: str, order: dict[str, int], weight: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of a word's prefix bigrams and of its two pivots.

    The prefix holds the three rarest and whatever equals the last of them. The
    pivots have the least weight together of all pairs in it that don't overlap:
    going through the places, the best single bigram that ends before is kept.
    """
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    last = sorted(order[g] for g in grams)[2]
    prefix = [i for i, g in enumerate(grams) if order[g] <= last]
    single: list[tuple[int, int]] = []  # the least weight and its place among the first bigrams
    best: tuple[int, int, int] | None = None
    for k, i in enumerate(prefix):
        mine = (weight[grams[i]], i)
        free = k - 1
        while free >= 0 and prefix[free] > i - 2:
            free -= 1
        if free >= 0:
            pair = (single[free][0] + mine[0], single[free][1], i)
            best = pair if best is None else min(best, pair)
        single.append(min(single[-1], mine) if single else mine)
    return prefix, list(best[1:])


def _entries(words: DataFrame) -> DataFrame:
    """Index entries: word, n, parity of its letters, gram, place, length and whether the bigram is a pivot.

    The table of bigrams that the tasks get has at most 90 * 90 rows, one for each two letters.
    """
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("word", i, F.lit(2))))).alias("gram"))
    weight = dict(map(tuple, grams.groupBy("gram").count().collect()))
    order = {g: k for k, (g, _) in enumerate(sorted(weight.items(), key=lambda x: (x[1], x[0])))}

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                letters = 0
                for c in word:
                    letters ^= 1 << (ord(c) & 63)
                letters -= (letters >> 63) << 64
                prefix, pivots = pivotal(word, order, weight)
                out += [(word, n, letters, order[word[i : i + 2]], i, len(word), i in pivots) for i in prefix]
            yield pd.DataFrame(out, columns=["word", "n", "letters", "gram", "place", "size", "pivot"])

    return words.mapInPandas(entries, "word string, n bigint, letters bigint, gram int, place int, size int, pivot boolean")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all words one inserted, deleted or replaced code point apart, in both directions.

    `words` has distinct words of four code points or more, and n.
    """
    entries = cut(_entries(words), "word-grams")
    keys = ["gram", "place", "size"]
    sizes = entries.groupBy(keys).agg(F.ceil(F.count("*") / LISTED).cast("int").alias("parts"))
    sizes = cut(sizes, "gram-sizes")
    index = entries.join(sizes, keys).select(
        *keys, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters")
    )
    shift = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.lit(p).alias("place")) for s, p in SHIFTS)))
    asked = entries.where("pivot").withColumn("by", shift)
    asked = asked.select("gram", (F.col("place") + F.col("by.place")).alias("place"), (F.col("size") + F.col("by.size")).alias("size"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"))
    asked = asked.join(sizes, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # cut, so that hot keys of the join below can be split
    index, asked = cut(index, "gram-index"), cut(asked, "gram-asked")
    # one edit changes the parity of two letters at most; the threshold ends the comparison early
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2
    pairs = asked.join(index, [*keys, "part"]).where(alike & (F.levenshtein("a", "b", 1) == 1))
    first, second = F.struct(F.col("a").alias("w"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("w"), F.col("b_n").alias("n"))
    pairs = cut(pairs.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).distinct(), "near-words")
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select(F.col("p.x.w").alias("word"), F.col("p.x.n").alias("n"), F.col("p.y.w").alias("other"), F.col("p.y.n").alias("other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, by doubling. Counts rise at every step, so there are no rings and few rounds."""
    roots = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return roots


def spelling_forms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = 6, min_count: int = 5, times: int = 5, slip: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of `min_length` code points and `min_count` occurrences.

    A word's form is its near word (one edit apart) of largest n, of equal ones the
    smallest in code-point order, if it occurs `times` as often as the word itself;
    root follows forms to the last. Null and empty texts have no words; a null
    doc_id counts as empty where `slip` asks for it; repeated rows count each; an
    empty table gives no rows; other columns are not read.
    """
    if min_length < 4:
        raise ValueError("words need four code points for two bigrams apart")
    words = word_counts(docs, text, doc_id, min_length, slip).where(F.col("n") >= min_count)
    words = cut(words, "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("w"))).alias("best"))
    found = cut(words.join(near, "word", "left"), "forms")
    enough = -F.col("best.less") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
