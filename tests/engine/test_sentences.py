"""Sentence boundaries against examples of Unicode's annex 29, and against the rules read one by one."""

import random

import pytest

from tessera.functions import packing as P
from tessera.functions import sentences as S

# "|" marks the boundaries.
CASES = [
    "First. |Second! |Third?", "c.d", "3.4", "U.S", "C.D", "the resp. leaders are", "the resp. Leaders are".replace(" L", " |L"), "Version 3.5 runs.|",
    "Mail example.com or a.b@c.de now. |Then wait.", "etc.)’ ‘(the", "etc.)’ |‘(The", "etc.) the", "Really?! |Yes.", "He said “Stop!” |Then left.", "Wait… Now", "一。|二！|三？",
    "line one\n|line two\r\n|line three |end", "\r\r".replace("\r\r", "\r|\r"), "ä.́ |B", "Dr. |Smith", "e.g., this", "no stop at all", "One. ́two", "4.̀5", "He left.\" |She", "a. |B", "ends. ", "x! , y", "etc.: that",
]


@pytest.mark.parametrize("case", CASES)
def test_examples(case):
    text = case.rstrip("|").replace("|", "")
    assert "|".join(S.split(text)) == case.rstrip("|")


def by_rules(kinds):
    """The boundaries of a string of class letters, rule after rule at each place."""
    out = []
    for at in range(1, len(kinds)):
        a, b = kinds[at - 1], kinds[at]
        if a == "c" and b == "f":
            continue  # SB3
        if a in "cfp":
            out.append(at)  # SB4
            continue
        if b == "x":
            continue  # SB5
        # Marks that combine stand for the character before them.
        before = "".join(c for i, c in enumerate(kinds[:at]) if c != "x" or i == 0 or kinds[:i].rstrip("x")[-1:] in ("", "c", "f", "p"))
        core = before.rstrip("s")
        spaces, closed = len(before) - len(core), core
        core = core.rstrip("q")
        close = len(closed) - len(core)
        stop = core[-1:]
        if stop == "A" and not spaces and not close and b == "N":
            continue  # SB6
        if stop == "A" and not spaces and not close and b == "U" and core[-2:-1] in ("U", "l"):
            continue  # SB7
        if stop == "A":
            rest = kinds[at:]
            to_come = next((c for c in rest if c in "OUlcfpAT"), None)
            if to_come == "l":
                continue  # SB8
        if stop in ("A", "T"):
            if b in "kAT":
                continue  # SB8a
            if not spaces and b in "qscfp":
                continue  # SB9
            if b in "scfp":
                continue  # SB10
            out.append(at)  # SB11
            continue
    return [*out, len(kinds)] if kinds else []


def test_rules_on_random_texts():
    sample = {"c": "\r", "f": "\n", "p": "\x85", "x": "́", "s": " ", "l": "a", "U": "B", "O": "中", "N": "7", "A": ".", "T": "!", "q": ")", "k": ",", ".": "+"}
    assert all(S.classes(c) == k for k, c in sample.items())
    r = random.Random(3)
    for _ in range(6000):
        kinds = "".join(r.choice("cfpxxsslUONAAATqk.") for _ in range(r.randint(0, 9)))
        assert S.boundaries("".join(sample[k] for k in kinds)) == by_rules(kinds), kinds


def test_sentences_of_chunks():
    assert P.sentences("Version 3.5 of example.com is out. It is faster.") == ["Version 3.5 of example.com is out.", "It is faster."]
    assert P.sentences("One!\n\n***\n\nTwo") == ["One!", "Two"] and P.sentences("... !!") == ["...", "!!"] and P.sentences("  ") == []
