"""Copies of benchmark items that hold their own template again, stand beside other fillings of it, or are numbers and signs throughout."""

import pytest

TWICE = "If a box holds 3 red pens and 4 blue pens how many pens are there? If a box holds 5 red pens and 6 blue pens how many pens are there?"
BASKET = "In the year 1987 Tom bought 12 apples and 3 pears while Tom paid 15 dollars for the whole basket and Tom then walked 7 miles to the market with all of it"
SUMS = "12 + 7 + 30 = 49, 8 + 15 + 4 = 27"
CHINESE = "小明有三个苹果和五个梨他一共有多少个水果"
THAI = "แมวสีดำนอนอยู่บนโต๊ะในห้องครัว"
OTHER = "In the year 2003 Anna bought 40 apples and 7 pears while Bert paid 99 dollars for the whole basket"


def found(spark, items, docs):
    from tidelog.llm import decontamination as d

    table = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.leaks(table(docs, "doc_id"), table(items, "item_id")).collect()}


def test_all_places_of_a_template(spark):
    put_in = BASKET.replace("for the whole", "of coin for the whole")
    docs = [TWICE, f"{OTHER}. And now: {BASKET}", f"{BASKET}. And now: {OTHER}", put_in, f"{OTHER}. And now: {put_in}", OTHER]
    assert found(spark, [TWICE, BASKET], docs) == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)}


def test_numbers_names_and_scripts_without_spaces(spark):
    docs = [f"We add: {SUMS}. Done", "We add: 13 + 7 + 31 = 51, 9 + 15 + 4 = 28. Done", f"题目：{CHINESE}？答案", "小明有一本书", f"ก่อน {THAI} หลัง", "12 + 7"]
    assert found(spark, [SUMS, CHINESE, THAI], docs) == {(0, 0), (2, 1), (4, 2)}


def test_numbers_beside_a_template(spark):
    """Windows that match as they stand don't take the cover from an item's templates in copies with other fillings."""
    item = f"In the year 1987 Tom bought apples and pears for all. {SUMS}, 5 + 6 + 7 = 18"
    other = "In the year 2003 Anna bought apples and pears for all. 1 + 2 + 3 = 6, 4 + 5 + 9 = 18, 2 + 2 + 4 = 8"
    assert found(spark, [item], [item, other]) == {(0, 0), (1, 0)}


def test_short_items_match_as_they_stand(spark):
    """Items under 5 tokens match verbatim; cleaned() leaves them out."""
    from tidelog.llm import decontamination as d

    items, docs = ["12 + 7 + 30", "小明有书", "Who wrote Hamlet?", "+ - !", "osmosis"], ["so 12 + 7 + 30 it is", "小明有书", "Tell me: who wrote Hamlet? Shakespeare.", "Who wrote Macbeth? 12 + 7 + 31", "By osmosis."]
    assert found(spark, items, docs) == {(0, 0), (1, 1), (2, 2), (4, 4)}
    table = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    assert d.cleaned(table(docs, "doc_id"), table(items, "item_id")).count() == len(docs)


def test_texts_of_one_id_stay_apart(spark):
    """Halves of an item in two rows of one doc_id are no leak; the whole item in one of them is."""
    from tidelog.llm import decontamination as d

    words = BASKET.split()
    items = spark.createDataFrame([(0, BASKET)], "item_id long, text string")
    rows = [(1, " ".join(words[:16])), (1, " ".join(words[16:])), (2, "nothing here"), (2, f"So: {BASKET}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, items).collect()} == {(2, 0)}
