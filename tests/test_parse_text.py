import math
import re

import pytest
from pyspark.sql import functions as F

from quartier.functions import parse, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("value,expected", [
    ("3-комн. кв., 85 м2", 3), ("  2 -комн", 2), ("6 и более комнат", 6), ("свободная планировка", 1000), (None, 1000),
    (" 4-комн", 4), ("", 1000), ("кв. 3-комн", 1000),
])
def test_rooms(spark, value, expected):
    assert one(spark, value, parse.rooms) == expected


@pytest.mark.parametrize("value,expected", [
    ("5 этаж из 9", (5, 9)), ("5этаж из9", (5, 9)), ("5 этаж", (None, None)), (None, (None, None)),
])
def test_floor(spark, value, expected):
    assert tuple(one(spark, value, parse.floor_pair)) == expected


@pytest.mark.parametrize("value,expected", [
    ("85.5 м2, жилая: 40 м2", (85.5, 40)), ("85 м2", (85, None)), ("жилая: 40 м2", (None, 40)), ("м2", (None, None)),
    ("1.2.3 м2", (None, None)), (None, (None, None)),
])
def test_area(spark, value, expected):
    assert tuple(one(spark, value, parse.area_pair)) == expected


@pytest.mark.parametrize("value,expected", [
    ("кирпичный, 1986 г.", ("кирпичный", 1986)), ("панельный", ("панельный", None)),
    ("монолитный, 106, 2020 г., 1999 г.", ("монолитный", 2020)), ("1986 г.", ("1986 г.", None)),
    (None, (None, None)), (" панельный  , x 12 1975 г", ("панельный", 1975)), ("a, 12345 г", ("a", 2345)),
])
def test_house(spark, value, expected):
    assert tuple(one(spark, value, parse.house_pair)) == expected


TEXTS = ["", "a", "a b", "Ул. Ленина 12_б, д.5", "one two  three\tfour five", "xx", "слово-слово ещё", None]


@pytest.mark.parametrize("value", TEXTS)
def test_tokens_and_ngrams(spark, value):
    words = re.findall(r"\w\w+", (value or "").lower())
    expected = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert one(spark, value, lambda c: text.ngrams(text.tokens(c), 1, 3)) == expected
    assert one(spark, value, lambda c: text.ngrams(text.tokens(c), 2, 2)) == [
        " ".join(words[i:i + 2]) for i in range(len(words) - 1)
    ]


@pytest.mark.parametrize("value", TEXTS)
def test_char_wb(spark, value):
    expected = []
    for word in (value or "").lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            if n > 3 and len(padded) < n:
                break
            expected += [padded[i:i + n] for i in range(max(len(padded) - n, 0) + 1)]
    assert sorted(one(spark, value, lambda c: text.char_wb(c, 3, 5))) == sorted(expected)


def test_hashed_weights_have_unit_length(spark):
    from quartier.operators.textfeatures import hashed_ngrams

    df = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, None), (4, "x")], "k int, t string")
    norms = {r["k"]: r["n"] for r in hashed_ngrams(df, "k", "t", 16).groupBy("k").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    assert set(norms) == {1} and math.isclose(norms[1], 1)


def test_tfidf_by_hand(spark):
    from quartier.operators.textfeatures import Tfidf, TfidfVector

    rows = [(1, "aa bb"), (2, "aa cc"), (3, "aa aa bb")]
    df = spark.createDataFrame(rows, "k int, t string")
    model = Tfidf(key="k", text="t", low=1, high=1, min_df=2).fit(df)
    vocabulary = {r["term"]: r["idf"] for r in model.vocabulary(df).collect()}
    assert vocabulary == pytest.approx({"aa": 1.0, "bb": math.log(4 / 3) + 1})
    weights = {(r["k"], r["term"]): r["weight"] for r in model.transform(df).collect()}
    a, b = 2.0, vocabulary["bb"]
    assert weights[3, "aa"] == pytest.approx(a / math.hypot(a, b))
    assert weights[2, "aa"] == pytest.approx(1.0)
    vector = TfidfVector(text="t", out="v", low=1, high=1, min_df=2, max_features=10).fit(df).transform(df)
    third = sorted(vector.where("k = 3").first()["v"].toArray())
    assert third == pytest.approx(sorted([a / math.hypot(a, b), b / math.hypot(a, b)]))
