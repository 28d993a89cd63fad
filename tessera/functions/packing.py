"""Chunkers that pack pieces of text under a budget, in plain Python for use in Arrow batches.

All are built from three parts: a splitter that yields pieces, ``Packer`` that joins pieces while they fit, and
``window`` that cuts what is too long.  Budgets count tokens of a pluggable tokenizer; without one, four UTF-8 bytes
make a token.  Whole texts are cut, whatever their length and their number of parts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from .sentences import split as split_sentences

MOST_OVERLAP = 0.9
LEAST_CHARS = 400
BYTES_PER_TOKEN = 4
SENTENCE = re.compile(r"[^.!?。！？؟।]*(?:[.!?。！？؟।]+[\"')\]”’»]*|\Z)", re.S)


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def ratio(overlap: float) -> float:
    return min(max(overlap, 0.0), MOST_OVERLAP)


@dataclass
class Tokens:
    """A tokenizer: ``encode`` gives the tokens' bytes in order.  None stands for the byte estimate.

    One whose tokens are whole characters may also give them as text (``split``) and tell their number (``number``).
    """

    encode: Callable[[str], list[bytes]] | None = None
    split: Callable[[str], list[str]] | None = None
    number: Callable[[str], int] | None = None
    memory: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)

    def count(self, text: str) -> int:
        if self.number is not None:
            return self.number(text)
        return math.ceil(size_of(text) / BYTES_PER_TOKEN) if self.encode is None else len(self.encode(text))

    def tail(self, text: str, n: int) -> str:
        """The text of the last n tokens."""
        if n <= 0:
            return ""
        if self.encode is None:
            return text[-n * BYTES_PER_TOKEN :]
        if self.split is not None:
            return "".join(self.split(text)[-n:])
        return b"".join(self.encode(text)[-n:]).decode("utf-8", "replace")


def word_tokens() -> Tokens:
    """Each run of white space with the word behind it is a token."""
    split = re.compile(r"\s*\S+|\s+\Z").findall
    return Tokens(lambda text: [m.encode() for m in split(text)], split, lambda text: len(text.split()) + text[-1:].isspace())


def byte_pair_tokens(path: str) -> Tokens:
    """A public byte-pair vocabulary file (base64 token and rank on each line)."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Tokens(lambda text: coder.decode_tokens_bytes(coder.encode_ordinary(text)))


@dataclass
class Packer:
    """Joins pieces with ``glue`` while ``fits`` allows; ``take`` returns what got full."""

    fits: Callable[[str, str], bool]
    glue: str
    held: str = ""
    out: list[str] = field(default_factory=list)

    def flush(self) -> None:
        if self.held.strip():
            self.out.append(self.held.strip())
        self.held = ""

    def add(self, piece: str) -> None:
        if self.held and not self.fits(self.held, piece):
            self.flush()
        self.held = f"{self.held}{self.glue}{piece}" if self.held else piece


def by_chars(text: str, budget: int, overlap: float) -> list[str]:
    """Words under a byte budget of four bytes a token (at least 400).

    A chunk begins with the last characters of the one before, and the next word follows them without a space.
    """
    limit = int(max(budget * float(BYTES_PER_TOKEN), LEAST_CHARS))
    again = int(limit * ratio(overlap))
    out: list[str] = []
    line, used = [], 0
    for word in text.split():
        n = size_of(word)
        if line and used + n + 1 > limit:
            out.append("".join(line).strip())
            kept = out[-1][-again:] if again else ""
            line, used = ([kept] if kept else []), size_of(kept)
        line += [word, " "]
        used += n + 1
    rest = "".join(line).strip()
    return [*out, rest] if rest else out


def window(text: str, budget: int, overlap: float, tokens: Tokens) -> list[str]:
    """Windows of tokens; a window that would cut a character sends the whole text to ``by_chars``."""
    if budget == 0:
        return [text]
    whole = tokens.split(text) if tokens.split else []
    parts = whole or (tokens.encode(text) if tokens.encode else [])
    if not parts:
        return by_chars(text, budget, overlap)
    step = budget - int(ratio(overlap) * budget)
    starts = range(0, max(1, len(parts) - budget + step), step)
    if whole:
        return [c for c in ("".join(whole[i : i + budget]) for i in starts) if c]
    try:
        return [c for c in (b"".join(parts[i : i + budget]).decode() for i in starts) if c]
    except UnicodeDecodeError:
        return by_chars(text, budget, overlap)


def remembered(cut: Callable[..., list[str]]) -> Callable[..., list[str]]:
    """``cut`` with its last result: one text is cut alike by several strategies."""

    def run(text: str, budget: int, overlap: float, tokens: Tokens) -> list[str]:
        asked = (text, budget, overlap)
        if tokens.memory.get(cut.__name__, (None,))[0] != asked:
            tokens.memory[cut.__name__] = asked, cut(text, budget, overlap, tokens)
        return tokens.memory[cut.__name__][1]

    return run


#: ``window`` of whole texts.
whole_window = remembered(window)


def sentences(text: str) -> list[str]:
    """Sentences that hold a letter or a number, trimmed; without any, the parts between terminators."""
    whole = [s.strip() for s in split_sentences(text) if any(map(str.isalnum, s))]
    return whole or [s for s in (m.strip() for m in SENTENCE.findall(text)) if s]


def by_sentences(text: str, budget: int, overlap: float, tokens: Tokens) -> list[str]:
    """Sentences packed with spaces; a sentence over the budget is cut into windows; overlap comes on top afterwards."""
    pieces = sentences(text)
    if not pieces:
        return window(text, budget, overlap, tokens)
    counted = tokens.encode is not None
    limit = budget if counted else int(max(budget * float(BYTES_PER_TOKEN), LEAST_CHARS))
    measure = tokens.count if counted else size_of
    used = 0
    pack = Packer(lambda held, piece: used + 1 + measure(piece) <= limit, " ")
    for piece in pieces:
        n = measure(piece)
        if n > limit:
            pack.flush()
            pack.out += window(piece, budget, overlap, tokens)
            used = 0
            continue
        fresh = not pack.held or used + 1 + n > limit
        pack.add(piece)
        used = n if fresh else used + 1 + n
    pack.flush()
    again = int(limit * ratio(overlap))
    if not again:
        return pack.out
    tail = (lambda t: tokens.tail(t, again)) if counted else (lambda t: t[-again:])
    return [c if i == 0 else f"{tail(pack.out[i - 1])} {c}".strip() for i, c in enumerate(pack.out)]


whole_sentences = remembered(by_sentences)
_LIST_LINE = re.compile(r"\s*(?:[-*] |\d+\. )")


def paragraphs(text: str) -> list[str]:
    """Blocks between blank lines; the lines of blocks with list marks are trimmed."""
    blocks = (b.strip() for b in re.split(r"\n(?:[^\S\n]*\n)+", text.replace("\r\n", "\n")))
    return ["\n".join(x.strip() for x in b.split("\n") if x.strip()) if any(map(_LIST_LINE.match, b.split("\n"))) else b for b in blocks if b]


def by_paragraphs(text: str, budget: int, overlap: float, tokens: Tokens) -> list[str]:
    """Paragraphs packed with blank lines (a separator costs one token); only oversized ones are cut, with overlap."""
    pieces = paragraphs(text)
    if not pieces:
        return window(text, budget, overlap, tokens)
    used = 0
    pack = Packer(lambda held, piece: used + 1 + tokens.count(piece) <= budget, "\n\n")
    for piece in pieces:
        n = tokens.count(piece)
        if n > budget:
            pack.flush()
            pack.out += window(piece, budget, overlap, tokens)
            used = 0
            continue
        fresh = not pack.held or used + 1 + n > budget
        pack.add(piece)
        used = n if fresh else used + 1 + n
    pack.flush()
    return pack.out


HEADING = re.compile(r"\s*(#{1,6})\s+(\S.*?)\s*\Z")
HAS_HEADING = re.compile(r"^\s*#{1,6} ", re.M)


@dataclass(frozen=True)
class Section:
    title: str | None = None
    path: str | None = None
    level: int | None = None


def sections(text: str) -> list[tuple[str, Section]]:
    """Markdown cut before its headings, each part with the path of headings it stands under."""
    text = text.replace("\r\n", "\n")
    out: list[tuple[str, Section]] = []
    open_: dict[int, str] = {}
    lines: list[str] = []
    info = Section()
    for line in [*text.split("\n"), None]:
        m = HEADING.match(line) if line is not None else None
        if m or line is None:
            body = "\n".join(lines).strip()
            if body:
                out.append((body, info))
            lines = []
        if m:
            level = len(m[1])
            open_ = {k: v for k, v in open_.items() if k < level} | {level: m[2]}
            info = Section(m[2], " > ".join(open_[k] for k in sorted(open_)), level)
        if line is not None:
            lines.append(line)
    if len(out) <= 1 and "\n#" in text:
        parts = [p if i == 0 else f"#{p}" for i, p in enumerate(text.split("\n#"))]
        parts = [p for p in parts if p.strip()]
        if len(parts) > 1:
            heads = [HEADING.match(p.split("\n", 1)[0]) for p in parts]
            return [(p, Section(h[2], h[2], len(h[1])) if h else Section()) for p, h in zip(parts, heads, strict=True)]
    return out


def by_markdown(text: str, budget: int, overlap: float, tokens: Tokens) -> list[tuple[str, Section]]:
    """Sections that fit stay whole; of others every body window carries the heading, within the budget if it can."""
    if budget == 0:
        return [(text.strip(), Section())]
    found = sections(text)
    if not found:
        return [(c, Section()) for c in window(text, budget, ratio(overlap), tokens)]
    if len(found) == 1 and found[0][1] == Section():
        return [(c, Section()) for c in whole_sentences(found[0][0], budget, ratio(overlap), tokens)]
    out: list[tuple[str, Section]] = []
    for body, info in found:
        if tokens.count(body) <= budget:
            out.append((body.strip(), info))
            continue
        head, _, rest = body.partition("\n")
        cost = tokens.count(head)
        carry = info.level is not None and HEADING.match(head) is not None and not (cost >= budget and rest.strip())
        if not carry:
            head, rest, cost = "", body, 0
        if not rest.strip():
            out.append((body.strip(), info))
            continue
        for piece in window(rest, max(1, budget - cost), ratio(overlap), tokens):
            out.append((f"{head}\n{piece}".strip() if carry else piece.strip(), info))
    return out


def _pages(text: str) -> Iterator[tuple[int, str]]:
    return ((i, p.strip()) for i, p in enumerate(text.split("\f"), 1) if p.strip())


def by_pages(text: str, budget: int, overlap: float, tokens: Tokens) -> list[str]:
    """Pages (form feeds between them) with a label each, cut so that label and text stay within the budget."""
    if "\f" not in text:
        return whole_window(text, budget, overlap, tokens) if budget else [f"[page 1]\n{text.strip()}"]
    out = []
    for i, page in _pages(text):
        label = f"[page {i}]\n"
        out += [label + c for c in (window(page, max(1, budget - tokens.count(label)), ratio(overlap), tokens) if budget else [page])]
    return out


def by_page_tokens(text: str, budget: int, overlap: float, tokens: Tokens) -> list[str]:
    """The same with labels that also number the chunks of a page; room is kept for a four-digit number."""
    if "\f" not in text:
        return whole_window(text, budget, overlap, tokens)
    out = []
    for i, page in _pages(text):
        room = max(1, budget - tokens.count(f"[page {i} chunk 9999]\n")) if budget else 0
        out += [f"[page {i} chunk {k}]\n{c}" for k, c in enumerate(window(page, room, overlap, tokens), 1)]
    return out


RECURSIVE_CUTS = ("\n\n", "\n", ". ", " ")


def _nested(text: str, limit: int, cuts: tuple[str, ...]) -> Iterable[str]:
    if size_of(text) <= limit:
        return [text.strip()]
    if not cuts:
        return by_chars(text, limit // BYTES_PER_TOKEN, 0.0)
    glue = cuts[0]
    if glue not in text:
        return _nested(text, limit, cuts[1:])
    pack = Packer(lambda held, piece: size_of(held) + size_of(glue) + size_of(piece) <= limit, glue)
    for piece in filter(None, map(str.strip, text.split(glue))):
        pack.add(piece)
    pack.flush()
    return [c for full in pack.out for c in ([full] if size_of(full) <= limit else _nested(full, limit, cuts[1:]))]


def by_recursion(text: str, budget: int, overlap: float) -> list[str]:
    """Cut at blank lines, lines, sentences, then spaces, as far as needed; overlap in characters on top."""
    limit = int(max(budget * float(BYTES_PER_TOKEN), LEAST_CHARS))
    out = list(_nested(text, limit, RECURSIVE_CUTS))
    again = int(limit * ratio(overlap))
    return [c if i == 0 or overlap <= 0 else f"{out[i - 1][-again:] if again else ''} {c}".strip() for i, c in enumerate(out)]


def word_start(text: str) -> str:
    """Drop a leading word that begins in lower case (in scripts with case), as what a cut has left of a word."""
    text = text.lstrip()
    if text and text[0].islower() and text[0] != text[0].upper() or text and unicodedata.category(text[0]) == "Ll":
        rest = re.search(r"\s", text)
        return text[rest.start() :].lstrip() if rest else text
    return text


STRATEGIES = ("chars", "tokens", "sentences", "paragraphs", "pages", "page_tokens", "markdown", "recursive_chars", "semantic")


def chunk(text: str, strategy: str, budget: int, overlap: float, tokens: Tokens, semantic: Callable[[str], list[str]] | None = None) -> list[tuple[str, Section]]:
    """The chunks of a text with their sections, starts normalised and empty ones dropped."""
    plain: list[str]
    if strategy == "markdown":
        found = by_markdown(text, budget, overlap, tokens)
    else:
        if strategy == "chars":
            plain = by_chars(text, budget, overlap)
        elif strategy == "recursive_chars":
            plain = by_recursion(text, budget, overlap)
        elif strategy == "semantic":
            plain = by_model(text, budget, overlap, tokens, semantic)
        else:
            plain = {"tokens": whole_window, "sentences": whole_sentences, "paragraphs": by_paragraphs, "pages": by_pages, "page_tokens": by_page_tokens}[strategy](text, budget, overlap, tokens)
        found = [(c, Section()) for c in plain]
    return [(c, s) for c, s in ((word_start(c), s) for c, s in found) if c]


def by_model(text: str, budget: int, overlap: float, tokens: Tokens, ask: Callable[[str], list[str]] | None, most: int = 128) -> list[str]:
    """Chunks a model proposes (1 to ``most`` texts that are not blank); without a model or on any failure, windows."""
    try:
        got = [c for c in ask(text) if c.strip()] if ask else []
        if 0 < len(got) <= most:
            return got
    except Exception:  # noqa: BLE001  a provider may fail in any way; the fallback is the defined result
        pass
    return whole_window(text, budget, overlap, tokens)
