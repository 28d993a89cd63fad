import random
import re

import pytest

from tessera.operators import layout as L


def test_collapsed_text_maps_back():
    flat, places = L.collapsed("  Big \t\n  Title of\r\ntwo é \n")
    assert flat == "Big Title of two é"
    assert [("  Big \t\n  Title of\r\ntwo é \n")[p] for p in places] == list("Big Title of\rtwo é")
    assert L.collapsed(" \n ")[0] == "" and len(L.collapsed("")[1]) == 0
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice("ab \n\t é") for _ in range(r.randint(0, 20)))
        flat, places = L.collapsed(text)
        assert flat == " ".join(re.findall("[^ \n\t ]+", text)) and len(flat) == len(places) and sorted(places) == list(places)
        assert all(text[p] == c or (c == " " and text[p] in " \n\t ") for c, p in zip(flat, places, strict=True))


@pytest.mark.parametrize("page, found, want", [
    ("Title\nbody", [(1, "Title")], "\n# Title\n\nbody"),
    ("intro\n  Big   Title \nbody", [(2, " Big Title")], "intro\n  \n## Big   Title\n \nbody"),
    ("intro\r\nBig  Title\r\nbody", [(3, "Big Title")], "intro\r\n\n### Big  Title\n\r\nbody"),
    ("we name Big Title here\nBig Title\nbody", [(1, "Big Title")], "we name Big Title here\n\n# Big Title\n\nbody"),
    ("text  \nTitle\nbody", [(1, "Title")], "text  \nTitle\nbody"),  # the white space before begins with a space
    ("A\nx\nB\nx\nA\n", [(1, "B"), (2, "A"), (1, "B")], "A\nx\n\n# B\n\nx\n\n## A\n\n"),
    ("Two\nlines here\nbody", [(1, "Two lines")], "\n# Two\nlines\n here\nbody"),
    ("body", [(1, ""), (1, "none")], "body"),
    ("body\nEnd  \n", [(4, "End")], "body\n\n### End  \n\n"),
])
def test_headings_in_pages(page, found, want):
    assert L.marked(page, found) == want
