"""Sentence boundaries by the rules of Unicode's text segmentation (annex 29, SB3 to SB998).

Each character's class is read from Unicode's Sentence_Break property, once a character, and a text becomes a string of
class letters; the machine runs over those.  Every paragraph separator ends a sentence.  So does a terminator with the
closing marks and spaces behind it, unless what stands around it says otherwise: a number or a capital next to a full
stop, a lower-case letter to come, or a comma or another terminator behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex

#: Letters for the classes.
CLASSES = {"CR": "c", "LF": "f", "Sep": "p", "Extend": "x", "Format": "x", "Sp": "s", "Lower": "l", "Upper": "U", "OLetter": "O", "Numeric": "N", "ATerm": "A", "STerm": "T", "Close": "q", "SContinue": "k"}
_PROPERTY = [(letter, regex.compile(rf"\p{{Sentence_Break={name}}}")) for name, letter in CLASSES.items()]


class _Letters(dict):
    def __missing__(self, c: int) -> str:
        found = self[c] = next((letter for letter, pattern in _PROPERTY if pattern.match(chr(c))), ".")
        return found


_letters = _Letters()
#: The end of a paragraph, or a terminator with marks that combine with it, closing marks and spaces.
_END = regex.compile(r"cf|[cfp]|(?P<stop>[AT])x*(?P<close>(?:qx*)*)(?P<space>(?:sx*)*)")
_LOWER_TO_COME = regex.compile(r"[^OUlcfpAT]*l")


def classes(text: str) -> str:
    return text.translate(_letters)


def _before(kinds: str, at: int) -> str:
    """The class before a place, without marks that combine with it; a dot at the text's start."""
    while at and kinds[at - 1] == "x":
        at -= 1
    return kinds[at - 1] if at else "."


def boundaries(text: str) -> list[int]:
    """Where sentences end; the last is the text's end."""
    kinds, n, out = classes(text), len(text), []
    for found in _END.finditer(kinds):
        end, stop = found.end(), found["stop"]
        if end == n:
            break
        if stop:
            then = kinds[end]
            if then in "cfpkAT":  # SB8a to SB10: more of the same sentence, or the separator ends it
                continue
            if stop == "A":
                bare = not found["close"] and not found["space"]
                if bare and then == "N":  # SB6
                    continue
                if bare and then == "U" and _before(kinds, found.start()) in "Ul":  # SB7
                    continue
                if _LOWER_TO_COME.match(kinds, end):  # SB8
                    continue
        out.append(end)
    return [*out, n] if n else []


def split(text: str) -> Iterator[str]:
    """The sentences of a text; together they are the text."""
    begin = 0
    for end in boundaries(text):
        yield text[begin:end]
        begin = end
