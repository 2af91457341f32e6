"""Decontamination: exact and re-parameterised items, and what must stay."""

import random
import time

from proofcast.llm.decontaminate import NAME, NUMBER, UNIT, item_classes, keep_clean, leaks, template

QUESTION = "Alice walks 12 miles to the market and buys 5 apples for 3 dollars each, then Bob walks 12 miles back home with half of them."
OTHER = "Maria walks 40 km to the market and buys 9 apples for 7 euros each, then Peter walks 40 km back home with half of them."
MIXED = "Maria walks 40 km to the market and buys 9 apples for 7 euros each, then Peter walks 55 miles back home with half of them."
SHORT = "name the tallest mountain on earth"
RNG = random.Random(3)
FILLER = ["".join(RNG.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
ITEMS = [(1, QUESTION), (2, SHORT), (3, None), (4, ""), (5, "12 13 14 Bob Alice 7 miles"), (None, QUESTION)]


def filler(n):
    return " ".join(RNG.choice(FILLER) for _ in range(n))


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_templates():
    assert [template(w)[0] for w in ("12,", "$3.50", "Alice's", "miles.", "THE", "walks", "--", "5th")] == [NUMBER, NUMBER, NAME, UNIT, "the", "walks", "", NUMBER]


def test_leaks(docs_of, spark):
    docs = docs_of(
        [
            (10, f"{filler(30)} {QUESTION} {filler(30)}"),
            (11, f"{filler(5)}\n{OTHER}"),
            (12, f"{filler(5)} {MIXED}"),
            (13, filler(400)),
            (14, f"x {SHORT}? y"),
            (15, f"{QUESTION} {filler(3)} {OTHER}"),
            (16, None), (17, ""), (None, QUESTION), (18, QUESTION[:40]), (19, filler(30000) + " " + QUESTION),
            (20, "1 2 3 Tom Ann 4 miles"), (21, OTHER), (21, OTHER),
        ]
    )
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in leaks(docs, items(spark)).collect()}
    assert got == {(10, 1, True), (11, 1, False), (14, 2, True), (15, 1, True), (15, 1, False), (19, 1, True), (21, 1, False)}
    rows = {(r["doc_id"]): r for r in leaks(docs, items(spark)).where("doc_id = 10").collect()}
    assert rows[10]["start"] == 30 and rows[10]["n_words"] == rows[10]["item_words"] == len(QUESTION.split())
    kept = keep_clean(docs, items(spark))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 12), (False, 13), (False, 16), (False, 17), (False, 18), (False, 20), (True, None)]


def test_part_of_an_item_counts_from_thirteen_words(docs_of, spark):
    words = QUESTION.split()
    docs = docs_of([(n, f"{filler(9)} {' '.join(words[2 : 2 + n])} {filler(9)}") for n in range(8, 18)])
    found = {r["doc_id"]: r["n_words"] for r in leaks(docs, items(spark)).collect()}
    assert found == {n: n for n in range(13, 18)}


def test_changed_values_do_not_hide_the_rest(docs_of, spark):
    edited = QUESTION.replace("Bob walks 12", "Bob walks 15")
    docs = [(1, edited), (2, QUESTION.replace("Bob", "Uncle Bob")), (3, OTHER.replace("each, then", "each, and so then")), (4, OTHER.replace("Maria", "Aunt Maria Lee"))]
    rows = {r["doc_id"]: r for r in leaks(docs_of([(i, f"{filler(20)} {t} {filler(20)}") for i, t in docs]), items(spark)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1]["n_words"] == 18 and rows[1]["exact"] and rows[3]["n_words"] == 15


def test_parts_on_both_sides_of_a_word_put_in_count_together(docs_of, spark):
    words = "one may ask how many of the red stones lie on that old wall".split()
    docs = docs_of([(1, f"{filler(9)} {' '.join([*words[:8], 'very', *words[8:]])} {filler(9)}"[:-1]), (2, f"{filler(9)} {' '.join(words[:8])} {filler(9)}")])
    entry = spark.createDataFrame([(1, " ".join([*words, "near", "here"]))], "item_id bigint, text string")
    assert {r["doc_id"] for r in leaks(docs, entry).collect()} == set()
    long = docs_of([(1, f"{filler(9)} {' '.join([*words[:8], 'very', *words[8:]])} near here {filler(9)}")])
    assert [tuple(r)[3:] for r in leaks(long, entry).collect()] == [(16, 16, True)]


def test_copies_word_for_word_need_no_literals(docs_of, spark):
    table = "12 Bob 14 Alice 7 miles 3 Tom 9 Ann 4 km 8 Eve 5 Max"
    entries = spark.createDataFrame([*ITEMS, (6, table), (7, "Who Was The First King Of All England And Wales After Harold Died")], "item_id bigint, text string")
    docs = docs_of([(1, f"x {ITEMS[4][1]} y"), (2, f"{filler(20)} {table.lower()}"), (3, table.replace("3", "2")), (4, f"who was the first king of all england and wales after harold died {filler(9)}"), (5, QUESTION.lower())])
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in leaks(docs, entries).collect()} == {(1, 5, True), (2, 6, True), (4, 7, True), (5, 1, True)}


def test_empty_tables(docs_of, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(docs_of([(1, QUESTION)]), none).count() == 0
    assert leaks(docs_of([]), items(spark)).count() == 0
    assert keep_clean(docs_of([(1, QUESTION)]), none).count() == 1


def test_numbers_in_words_are_numbers(docs_of, spark):
    assert [template(w)[0] for w in ("Forty", "nine,", "twenty-one", "one", "tense")] == [NUMBER, NUMBER, NUMBER, "one", "tense"]
    spelt = OTHER.replace("40 km", "forty miles").replace("9 apples", "nine apples")
    row = leaks(docs_of([(1, f"{filler(20)} {spelt} {filler(20)}")]), items(spark)).first()
    assert row["item_id"] == 1 and not row["exact"] and row["n_words"] == row["item_words"]


def test_a_phrase_repeated_very_often_is_walked_once(docs_of, spark):
    phrase = " ".join(QUESTION.split()[2:11])
    started = time.monotonic()
    found = leaks(docs_of([(1, " x ".join([phrase] * 20_000)), (2, f"{phrase} {QUESTION}")]), items(spark)).collect()
    assert {r["doc_id"] for r in found} == {2} and time.monotonic() - started < 60


def test_items_of_one_template_are_one_class(docs_of, spark):
    text = "A farmer has {} red apples in a large basket and gives {} of them to the children at the school gate today"
    entries = spark.createDataFrame([(k, text.format(100 + k, 300 + k)) for k in range(60)] + [(90, text.format(7, 7)), (91, text.format(105, 305))], "item_id bigint, text string")
    classes = {r["item_id"]: (r["class_id"], r["same_as"]) for r in item_classes(entries).collect()}
    assert classes == {k: (0, k) for k in range(60)} | {90: (90, 90), 91: (0, 5)}
    docs = [(k, f"{filler(9)} {text.format(500 + k, 700 + k)} {filler(9)}") for k in range(50)]
    docs += [(50, f"{filler(9)} {text.format(107, 307)}"), (51, text.format(8, 8)), (52, text.format(107, 308)), (53, text.format(100, 300))]
    got = sorted((r["doc_id"], r["item_id"], r["exact"]) for r in leaks(docs_of(docs), entries).collect())
    want = [(k, 0, False) for k in range(50)] + [(50, 7, True), (51, 0, False), (51, 90, False), (53, 0, True)]
    assert [g for g in got if g[0] != 52] == want
    # values of two items: a copy of the class, and word for word of the one that holds more of it
    assert {(0, False)} <= {g[1:] for g in got if g[0] == 52} or (52, 8, True) in got
    dotted = docs_of(docs).withColumnRenamed("doc_id", "doc.id")
    assert keep_clean(dotted, entries, doc_id="doc.id").count() == 0
