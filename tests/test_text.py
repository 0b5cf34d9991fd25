import datetime

import pytest
from pyspark.sql import functions as F

from rallylens.functions import text as tx


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Antifa [North]", "Antifa"),
        ("Group [] X", "Group [] X"),
        ("members of Antifa", "Antifa"),
        ("Members of Antifa", "Members of Antifa"),
        ("supporters of A; members of B", "A; members of B"),
        ("protesters from X", "X"),
        ("  a \t b  c ", "a b c"),
        (None, None),
    ],
)
def test_parse_actor(evaluate, raw, clean):
    assert evaluate(tx.parse_actor("t"), raw) == clean


def test_split_keeps_empty_parts_and_trims(evaluate):
    assert evaluate(tx.split_names("t"), "a ;;b; c;") == ["a", "", "b", "c", ""]
    assert evaluate(tx.split_names("t"), "a; ;b") == ["a", "", "b"]


def test_dot_stops_only_at_newline(evaluate):
    assert evaluate(tx.found("t", "a.*b"), "a\rb")
    assert evaluate(tx.found("t", "a.*b"), "a b")
    assert not evaluate(tx.found("t", "a.*b"), "a\nb")


def test_whole_words(evaluate):
    assert evaluate(tx.has_word("t", "socialist"), "the socialist club")
    assert not evaluate(tx.has_word("t", "social"), "the socialist club")
    assert not evaluate(tx.has_word("t", "caf"), "cafés")
    assert evaluate(tx.count_word("t", "a"), "a a a b aa") == 3


def test_punctuation_is_not_symbols(evaluate):
    assert evaluate(tx.punctuation_to_blank("t"), "a-b.c$d+e") == "a b c$d+e"


def test_words_only_replaces_line_breaks(evaluate):
    assert evaluate(tx.words_only("t"), "é1\n2_x") == "é1 2 x"


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("The Green Movement", "green"),
        ("Workers of the North Group", "workers of north"),
        ("BLM: Black Lives Matter", "blm black lives matter"),
        (None, ""),
    ],
)
def test_standardise_actor(evaluate, raw, clean):
    assert evaluate(tx.standardise_actor("t"), raw) == clean


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("They can't stop", "they cannot stop"),
        ("We WON'T go; they’re here", "we will not go they are here"),
        ("isn't", "is not"),
        ("l'été 2020", "l été 2020"),
        (None, ""),
    ],
)
def test_clean_note(evaluate, raw, clean):
    assert evaluate(tx.clean_note("t"), raw) == clean


def test_short_and_blank(evaluate):
    assert evaluate(tx.shorter_than("t", 10), None)
    assert evaluate(tx.shorter_than("t", 10), " \t\n 123456789 \r")
    assert not evaluate(tx.shorter_than("t", 10), "1234567890")
    assert evaluate(tx.is_blank("t"), "   ") and evaluate(tx.is_blank("t"), None)
    assert evaluate(tx.is_missing("t"), "") and not evaluate(tx.is_missing("t"), " ")


def test_numbers_dates_names(evaluate):
    assert evaluate(tx.percent(F.lit(1), F.lit(800)), "x") == 0.12
    assert evaluate(tx.percent(F.lit(3), F.lit(800)), "x") == 0.38
    assert evaluate(tx.day_month_year("t"), "03/02/2020") == datetime.date(2020, 2, 3)
    assert evaluate(tx.slug("t"), "United Kingdom") == "united_kingdom"
    assert evaluate(tx.leading("t", 3), "abcdef") == "abc"
    assert evaluate(tx.logistic(F.lit(0.0)), "x") == 0.5
    assert evaluate(tx.or_empty("t"), None) == ""
