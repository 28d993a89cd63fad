import pytest

from tessera.functions import packing as P

W = P.word_tokens()


def test_chars_keep_the_budget_and_overlap():
    assert P.by_chars("", 10, 0.1) == P.by_chars(" \n", 10, 0.1) == []
    out = P.by_chars("word " * 200, 100, 0.0)
    assert all(len(c) <= 400 for c in out) and " ".join(out).split() == ["word"] * 200
    lapped = P.by_chars("word " * 200, 100, 0.1)
    assert lapped[1].startswith(lapped[0][-40:].strip())
    assert P.by_chars("x" * 2000, 10, 0.5)[0] == "x" * 2000


def test_token_windows():
    assert P.window("a b c d", 2, 0.5, W) == ["a b", " b c", " c d"]
    assert P.window("a b c d", 0, 0.5, W) == ["a b c d"]
    assert P.window("a b", 5, 0.5, W) == ["a b"]
    halves = P.Tokens(lambda t: [bytes([b]) for b in t.encode()])
    assert P.window("éé", 1, 0, halves) == ["éé"]  # a window would cut a character


def test_sentences():
    assert P.sentences("First. Second! Third?") == ["First.", "Second!", "Third?"]
    assert P.sentences("一。二！三？") == ["一。", "二！", "三？"]
    out = P.by_sentences(" ".join(f"Sentence number {i} is here." for i in range(500)), 50, 0.0, W)
    assert all(W.count(c) <= 50 for c in out) and sum(c.count("Sentence") for c in out) == 500
    lapped = P.by_sentences("One two three. Four five six. Seven eight nine.", 3, 0.34, W)
    assert lapped == ["One two three.", "three. Four five six.", "six. Seven eight nine."]
    assert P.by_sentences("a b c d e f. G", 3, 0.0, W) == ["a b c", " d e f.", "G"]


def test_paragraphs():
    assert P.by_paragraphs("One.\r\n\r\nTwo.", 3, 0.0, W) == ["One.\n\nTwo."]
    assert P.by_paragraphs("a b\n \nc d", 3, 0.0, W) == ["a b", "c d"]
    assert P.paragraphs("  - x\n   * y\n 1. z") == ["- x\n* y\n1. z"]
    assert P.by_paragraphs("a b c d\n\ne", 3, 0.34, W) == ["a b c", " c d", "e"]


def test_markdown_sections_have_paths():
    text = "intro\n# A\none\n## B\ntwo\n### C\n####### no\n## D\n#nope\nthree\n# E\nlast"
    found = P.sections(text)
    assert [s.path for _, s in found] == [None, "A", "A > B", "A > B > C", "A > D", "E"]
    assert found[3][0] == "### C\n####### no" and found[4][0].endswith("#nope\nthree")
    long = P.by_markdown("# Head\n" + "w " * 20, 6, 0.0, W)
    assert len(long) > 3 and all(c.startswith("# Head\n") and W.count(c) <= 6 for c, _ in long)
    assert [c for c, _ in P.by_markdown("plain text. more", 0, 0, W)] == ["plain text. more"]


def test_pages():
    text = "Page1 text.\fPage2 text.\f \f"
    assert P.by_pages(text, 0, 0, W) == ["[page 1]\nPage1 text.", "[page 2]\nPage2 text."]
    assert P.by_pages("one page", 0, 0, W) == ["[page 1]\none page"]
    assert P.by_page_tokens(text, 50, 0, W) == ["[page 1 chunk 1]\nPage1 text.", "[page 2 chunk 1]\nPage2 text."]
    assert P.by_page_tokens("a b c", 2, 0, W) == ["a b", " c"]


def test_recursion_keeps_the_last_piece():
    text = ("para one. " * 30).strip() + "\n\n" + ("para two. " * 30).strip() + "\n\n \n\n"
    out = P.by_recursion(text, 50, 0.0)
    assert all(P.size_of(c) <= 400 for c in out) and "".join(out).count("two") == 30


@pytest.mark.parametrize(("text", "want"), [("ystems in the AI Act", "in the AI Act"), ("Valid start", "Valid start"), ("hello", "hello"), ("  x y", "y"), ("漢字 x", "漢字 x"), ("123 abc", "123 abc"), ("", ""), ("שלום עולם", "שלום עולם")])
def test_word_start(text, want):
    assert P.word_start(text) == want


def test_model_falls_back():
    assert P.by_model("a b c", 2, 0, W, lambda t: ["a", " ", "b c"]) == ["a", "b c"]
    for bad in (None, lambda t: [], lambda t: ["x"] * 129, lambda t: 1 / 0):
        assert P.by_model("a b c", 2, 0, W, bad) == ["a b", " c"]


def test_every_strategy():
    for s in P.STRATEGIES:
        assert P.chunk("Some text. More of it.", s, 40, 0.1, W)
        assert P.chunk("", s, 40, 0.1, W) in ([], [("[page 1]", P.Section())])


def test_long_texts_lose_nothing():
    text = "\n".join(f"#tag{i} word{i}" for i in range(5000))
    out = "\n".join(c for c, _ in P.chunk(text, "markdown", 40, 0.0, W))
    assert all(f"word{i}" in out for i in (0, 2047, 2048, 4999)) and out.count("#tag") == 5000
    huge = ("x" * 4095 + " ") * 13_000  # over 50 MB
    assert sum(c.count("x") for c in P.by_chars(huge, 2000, 0.0)) == 4095 * 13_000
