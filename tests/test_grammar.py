"""Golden rows of the term grammar and the stemmer, derived by hand."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import grammar
from tidemark.functions.stem import stem

ROWS = [
    ("13 May 1994", ["1994-05-13"]), ("13 May", ["05-13"]), ("13th May", ["05-13"]), ("1994 May", ["1994-05"]), ("88 June", ["1988-06"]), ("May 13", ["may", "13"]),
    ("5.6.1994", ["1994-6-05"]), ("6-7 July", ["07-06", "07-07"]), ("18-24", ["18-24", "18", "24"]), ("1-2-3", ["1-2-3", "1", "2", "3"]), ("F-16", ["f-16"]),
    ("state-of-the-art", ["state-of-the-art", "state", "art"]), ("$5-million", ["5 M Dollars"]), ("B-52s", []), ("a--b", []), ("read/write", ["read", "write"]),
    ("5%", ["5%"]), ("5 percent", ["5%"]), ("10.6 percentage", ["10.6%"]), ("1st", []), ("192.168.0.1", []), ("(U.S.)", []), (".5", ["5"]), ("m", ["m"]), ("½", []),
    ("$450,000", ["450,000 Dollars"]), ("$450,000,000", ["450 M Dollars"]), ("$1,000,000", ["1,000,000 Dollars"]), ("$100 million", ["100 M Dollars"]),
    ("$100 billion", ["100000 M Dollars"]), ("1,000,000 Dollars", ["1 M Dollars"]), ("22 3/4 Dollars", ["22 3/4 Dollars"]), ("100bn Dollars", ["100bn Dollars"]),
    ("20.6 m Dollars", ["20.6 M Dollars"]), ("100 bn Dollars", ["100000 M Dollars"]), ("5 m high", ["m", "high"]), ("100 billion U.S. dollars", ["100000 M Dollars"]),
    ("10,123", ["10.123K"]), ("55 Million", ["55M"]), ("1000", ["1000"]), ("1000000", ["1000K"]), ("7 Trillion", ["7000B"]), ("7.5 trillion", ["7.5B"]),
    ("35.66", ["35"]), ("35 3/4", ["35 3/4"]), ("3/4", ["0"]), ("250000000000", ["2.5B"]), ("5 km/h", ["5 km/h"]),
    ("between 18 and 24 years", ["18-24", "18", "24", "18", "and", "24", "years"]), ("", []), (None, []),
]


@pytest.mark.parametrize(("text", "terms"), ROWS)
def test_golden(text, terms):
    stop = frozenset({"of", "the"})
    assert [t[0] for t in grammar.parse(text, stop)] == terms


def test_kinds_and_month_first():
    assert [t[1] for t in grammar.parse("Bob BOB bob")] == ["U", "L", "D"]
    assert [t[0] for t in grammar.parse("May 5 May 1994", month_first=True)] == ["05-05", "1994-05"]


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("sky", "sky"), ("walked", "wal"), ("jumping", "jum"), ("crying", "crying"), ("s", ""), ("agreed", "agre"), ("adoption", "adopt")],
)
def test_stem(word, stemmed):
    assert stem(word) == stemmed


@given(st.text(max_size=200))
def test_any_text(text):
    for term, kind, pos, word in grammar.parse(text, stemmed=True):
        assert kind in ("", "U", "L", "D") and 0 <= pos < len(text.split()) and bool(word) == bool(kind)


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzé", max_size=15))
def test_stem_shortens(word):
    assert len(stem(word)) <= len(word) + 1
