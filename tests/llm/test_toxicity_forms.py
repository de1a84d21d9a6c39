"""Disguised words among other single letters, in long runs, and with every look-alike and parting mark."""

from __future__ import annotations

import random

import pytest
from data import frame

from wakegrid.llm import toxicity
from wakegrid.llm.toxicity import LOOK_ALIKE, PARTING, Restorer, decode, letter_model


@pytest.fixture(scope="module")
def cost(spark):
    r = random.Random(4)
    words = "you are such a idiot moron worthless river stone garden quiet letter morning water paper silver window market".split()
    return letter_model(frame(spark, [(k, " ".join(r.choice(words) for _ in range(40)), None, None, None) for k in range(200)]))


def test_separators_may_part_words(cost):
    restored = Restorer(cost).text
    assert restored("such a m o r o n") == "such a moron"
    assert restored("y o u i d i o t") == "you idiot"
    assert restored("you.are.such.a.moron").split() == "you are such a moron".split()
    assert restored("i--d--i--o--t") == "idiot"
    assert restored("x=1d10t").split()[-1].endswith("idiot")


def test_long_forms_are_decoded(cost):
    restored = Restorer(cost).text
    assert restored(" ".join("youaresuchamoron" * 20)).split() == "you are such a moron".split() * 20
    assert restored("idi" + "o" * 60 + "t") == "idiot"
    assert "worthless" in restored("garden-quiet-morning-w0rthl3ss")


def test_reading_out_changes_nothing(cost, monkeypatch):
    form = " ".join("suchamoronyouw0rthl3ssidi0t" * 4)
    whole = decode(form, cost)
    for many in (1, 2, 7):
        monkeypatch.setattr(toxicity, "READ_OUT", many)
        assert decode(form, cost) == whole


def test_all_marks_are_suspicious(cost):
    restored = Restorer(cost).text
    for mark in PARTING.strip():
        assert restored(f"i{mark}d{mark}i{mark}o{mark}t") == "idiot", mark
    for mark, letters in LOOK_ALIKE.items():
        assert toxicity.MIXED.search(f"a{mark}b") and toxicity.SUSPECT.search(f"a{mark}b"), (mark, letters)
