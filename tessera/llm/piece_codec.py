"""SentencePiece encoding and decoding for BPE models by a max-plus parallel scan.

The public model at hand is a BPE model (merge ranks as scores), so a plain best-sum search over scores would not give
its ids.  Its segmentation has a local form: a sequence of pieces is the model's own exactly if every two neighbours,
encoded together, come out as these two.  So encoding is a path through nodes (place, piece that ends there), with
weight 0 for an edge between such neighbours and minus infinity otherwise; exactly one path reaches the end.

Documents over ``CHUNK_CHARS`` are cut into chunks that tasks handle on their own.  A chunk's transfer matrix tells,
in the max-plus semiring, which boundary states (the piece in use where the chunk begins) lead to which where it ends;
weights being 0 and minus infinity, a row is a set of states, kept as bits.  The matrices of a document are combined
by their associative product in a balanced tree; what leads to each boundary from the left and from it to the end fixes
the one state there, from the root down; then each chunk backtraces its own pieces.  At a word boundary (no piece of
such a model crosses one) there is a single state, so words are encoded once by the same search and remembered, and a
chunk's matrix is the product of those of the word it begins in, of its whole words, and of the word it ends in.

Normalisation: the dummy space in front, and spaces as U+2581, nothing else (the identity rule of such models).
Characters without a piece become their UTF-8 byte pieces.  Decoding is the inverse: pieces, bytes, spaces.

Edge cases.  Null and empty texts have no ids and decode to an empty text.  Rows that share a doc_id stay apart.
Texts may be of any length, with or without spaces.  Other columns are ignored, whatever their names, except that the
pipeline keeps them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpoint, gathered, give_back, light_batches, mix, parallelism, slices, unit_codes

SPACE = "▁"
CHUNK_CHARS = 1 << 16
WORD_CACHE, PAIR_CACHE, WINDOW_CACHE = 250_000, 1_000_000, 20_000
#: Words over ``LONG`` characters are searched in windows of ``STRIDE``, begun ``LEAD`` characters early.
LONG, STRIDE, LEAD = 256, 128, 96
WHOLE = -1  # the state at a word boundary: any piece may have ended there


class Pieces:
    """A BPE model's pieces, and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.names)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model crosses a word boundary")
        self.own: dict[str, list[tuple[float, str, str]]] = {}
        self.words: dict[str, bytes] = {}
        self.units_known: dict[str, bytes] = {}
        self._windows: dict[tuple, list[int]] = {}
        self._near: dict[tuple[str, str], bool] = {}
        whole = [p for p in self.ids if self.whole(p)]
        key = np.array([_key(p) for p in whole], np.uint64)
        order = np.argsort(key)
        self._keys, self._key_ids = key[order], np.array([self.ids[p] for p in whole], np.int64)[order]
        self._maybe = np.zeros(1 << 20, bool)  # heads of all keys: most ranges are told apart here
        self._maybe[(key >> U64(44)).astype(np.int64)] = True
        self._pair_keys, self._pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        raw = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([self.bytes[i]]) if i in self.bytes else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self._raw, self._raw_at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))

    def _steps(self, text: str) -> list[tuple[float, str, str]]:
        """The model's rule on a short text: merge the best-scored neighbours, the leftmost of equals, until none fits.

        Returns for each merge its score, and the text's first and last part after it.
        """
        parts, out = list(text), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        return out

    def steps(self, piece: str) -> list[tuple[float, str, str]]:
        got = self.own.get(piece)
        if got is None:
            got = self.own[piece] = self._steps(piece)
        return got

    def whole(self, piece: str) -> bool:
        """Whether the rule leaves a text of just this piece in one."""
        return len(self.steps(piece)) == len(piece) - 1

    def neighbours(self, a: str, b: str) -> bool:
        """The weight between two whole pieces: allowed (0) or not (minus infinity).

        Encoding both together repeats each one's own merges, best score first, until a merge across the border is due.
        """
        left, right = self.steps(a), self.steps(b)
        end, begin, i, j = a[-1], b[0], 0, 0
        low = -math.inf
        across = self.scores.get(end + begin, low)
        while True:
            x = left[i][0] if i < len(left) else low
            y = right[j][0] if j < len(right) else low
            if across > x and across >= y:
                return False
            if x == low and y == low:
                return True
            if x >= y:
                changed, i = left[i][2] != end, i + 1
                end = left[i - 1][2]
            else:
                changed, j = right[j][1] != begin, j + 1
                begin = right[j - 1][1]
            if changed:
                across = self.scores.get(end + begin, low)

    def ending(self, text: str, end: int, start: int = 0) -> Iterator[str]:
        """The pieces (or the single character) that end at a place."""
        for size in range(min(self.longest, end - start), 0, -1):
            piece = text[end - size : end]
            if (size == 1 or piece in self.ids) and self.whole(piece):
                yield piece

    def path(self, word: str) -> list[str]:
        """The pieces of a word: for each prefix, the one piece its path ends in."""
        last: list[str] = [""] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for piece in self.ending(word, end):
                before = end - len(piece)
                if before == 0 or self.neighbours(last[before], piece):
                    last[end] = piece
                    break
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > WORD_CACHE:
                self.words.clear()
            got = self.paths([word])[0] if len(word) > LONG else np.array(self.numbers(self.path(word)), "<i4").tobytes()
            if len(word) <= LONG:
                self.words[word] = got
        return got

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The weights of many neighbours, by numbers: pieces by id, characters without a piece by code point."""
        key = a << 22 | b
        for _ in range(2):
            if len(self._pair_keys):
                j = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
                strange = self._pair_keys[j] != key
            else:
                strange = np.ones(len(key), bool)
            if not strange.any():
                break
            if len(self._pair_keys) > PAIR_CACHE:
                self._pair_keys, self._pair_ok, strange = self._pair_keys[:0], self._pair_ok[:0], np.ones(len(key), bool)
            fresh = np.unique(key[strange])
            ok = np.array([self.neighbours(self._name(k >> 22), self._name(k & (1 << 22) - 1)) for k in fresh.tolist()], bool)
            at = np.searchsorted(self._pair_keys, fresh)
            self._pair_keys, self._pair_ok = np.insert(self._pair_keys, at, fresh), np.insert(self._pair_ok, at, ok)
        return self._pair_ok[j]

    def _name(self, number: int) -> str:
        return self.names[number] if number < len(self.names) else chr(number - len(self.names))

    def paths(self, words: list[str]) -> list[bytes]:
        """The ids of many words: the search of ``path`` in lock-step, place by place, over all of them."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        short = [i for i, w in enumerate(words) if len(w) <= LONG] if long else range(len(words))
        out = [b""] * len(words)
        for i, ids in zip(short, self._short_paths([words[i] for i in short]), strict=True):
            out[i] = ids
        for i, ids in zip(long, self._long_paths([words[i] for i in long]), strict=True):
            out[i] = ids
        return out

    def _forward(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each prefix of each word the piece that its path ends in: the words' order (longest first), where each
        begins and ends, and by the prefix's last place the piece's size and number."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        codes, starts, ends = _codes([words[i] for i in order])
        lengths = ends - starts
        value = mix(codes.astype(np.uint64) + FIRST_CODE)
        n = len(self.names)
        size_at = np.zeros(len(codes) + 1, np.int64)
        number_at = np.zeros(len(codes) + 1, np.int64)
        hashes = [np.zeros(len(words), np.uint64)]  # of the prefixes of each length
        for end in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -end, side="right"))  # longer words come first
            stop = starts[:live] + end
            hashes.append(hashes[-1][:live] * BASE + value[stop - 1])
            if end > self.longest:
                hashes[end - self.longest - 1] = hashes[0][:0]
            open_ = np.ones(live, bool)
            for size in range(min(self.longest, end), 0, -1):
                key = hashes[end] - hashes[end - size][:live] * POWERS[size]
                hit = np.flatnonzero(self._maybe[(key >> U64(44)).astype(np.int64)] & open_) if size > 1 else np.flatnonzero(open_)
                if not len(hit):
                    continue
                key = key[hit]
                j = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
                number = np.where(self._keys[j] == key, self._key_ids[j], n + codes[stop[hit] - 1] if size == 1 else -1)
                found = number >= 0
                hit, number = hit[found], number[found]
                if size < end and len(hit):
                    ok = self._allowed(number_at[stop[hit] - size - 1], number)
                    hit, number = hit[ok], number[ok]
                size_at[stop[hit] - 1], number_at[stop[hit] - 1] = size, number
                open_[hit] = False
        return order, starts, ends, size_at, number_at

    def _short_paths(self, words: list[str]) -> list[bytes]:
        order, starts, ends, size_at, number_at = self._forward(words)
        # Backtrace of all words at once, one piece a round.
        place, word = ends.copy(), np.arange(len(words))
        got_word, got = [], []
        while len(word):
            got_word.append(word)
            got.append(number_at[place - 1])
            place = place - size_at[place - 1]
            more = place > starts[word]
            place, word = place[more], word[more]
        if not got:
            return []
        which, number, step = np.concatenate(got_word), np.concatenate(got), np.concatenate([np.full(len(g), -k) for k, g in enumerate(got)])
        sort = np.lexsort((step, which))
        which, number = which[sort], number[sort]
        cut = np.searchsorted(which, np.arange(len(words) + 1)).tolist()
        data = number.astype("<i4").tobytes()
        strange = set(which[number >= len(self.names)].tolist())
        out = [b""] * len(words)
        for k, i in enumerate(order):
            out[i] = data[4 * cut[k] : 4 * cut[k + 1]] if k not in strange else np.array(self.numbers([self._name(x) for x in number[cut[k] : cut[k + 1]].tolist()]), "<i4").tobytes()
        return out

    def _long_paths(self, words: list[str]) -> list[bytes]:
        out = []
        for word, size in zip(words, self._sizes(words), strict=True):
            pieces, end, back = [], len(word), size.tolist()
            while end:
                pieces.append(word[end - back[end] : end])
                end -= back[end]
            out.append(np.array(self.numbers(pieces[::-1]), "<i4").tobytes())
        return out

    def _sizes(self, words: list[str]) -> list[np.ndarray]:
        """For each prefix of each word the size of the piece that its path ends in: windows of all words in lock-step,
        each begun ``LEAD`` characters early.

        The piece that a prefix ends in follows from those of the ``longest`` prefixes before it.  So a window whose
        lead ends in the same pieces as the window before is right from there on; one that does not is done again from
        that window's pieces on.
        """
        places = [(i, max(0, a - LEAD), a, min(len(w), a + STRIDE)) for i, w in enumerate(words) for a in range(0, len(w), STRIDE)]
        order, starts, _, size_at, _ = self._forward([words[i][c:b] for i, c, _, b in places])
        first = np.empty(len(places), np.int64)
        first[order] = starts
        sizes = [np.zeros(len(w) + 1, np.int64) for w in words]
        for (i, c, a, b), at in zip(places, first.tolist(), strict=True):
            own, seen = size_at[at : at + b - c], sizes[i]
            low = max(c, a - self.longest)
            if c == 0 or (own[low - c : a - c] == seen[low + 1 : a + 1]).all():
                seen[a + 1 : b + 1] = own[a - c :]
            else:
                seen[a + 1 : b + 1] = self._resumed(words[i], a, b, seen)
        return sizes

    def _resumed(self, word: str, a: int, b: int, sizes: np.ndarray) -> list[int]:
        """The sizes of the pieces that the prefixes up to ``b`` end in, from those up to ``a`` on; remembered by the text
        and the sizes before, as long repeats come back to both."""
        low = a - self.longest
        before = sizes[low + 1 : a + 1].tolist()
        reach = low - max(before)
        key = (word[max(0, reach) : b], a - reach, *before)
        got = self._windows.get(key)
        if got is None:
            if len(self._windows) > WINDOW_CACHE:
                self._windows.clear()
            size, near = dict(zip(range(low + 1, a + 1), before, strict=True)), self._near
            for end in range(a + 1, b + 1):
                for piece in self.ending(word, end):
                    at = end - len(piece)
                    pair = word[at - size[at] : at], piece
                    ok = near.get(pair)
                    if ok is None:
                        ok = near[pair] = self.neighbours(*pair)
                    if ok:
                        size[end] = len(piece)
                        break
            if len(near) > PAIR_CACHE:
                near.clear()
            got = self._windows[key] = [size[end] for end in range(a + 1, b + 1)]
        return got

    def forget(self) -> None:
        """Drop the words remembered, at the end of a task."""
        self.units_known, self.words, self._windows, self._near = {}, {}, {}, {}
        give_back()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of many texts.  Words between single spaces are looked up together; odd texts go word by word."""
        out = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if "  " in t or t[0] == " " or t[-1] == " " or SPACE in t:
                out[i] = self.encode_words(normalised(t))
            else:
                plain.append(i)
        if not plain:
            return out
        units, codes, counts = unit_codes(pa.array([texts[i] for i in plain], pa.large_string()), [])
        known = self.units_known
        new = [u for u in units if u not in known]
        known.update(zip(new, self.paths([SPACE + u for u in new]), strict=True))
        flat, ends = gathered([known[u] for u in units], codes, counts, "<i4")
        for u in new:
            if len(u) > LONG:
                del known[u]
        if len(known) > WORD_CACHE:
            self.units_known = {u: known[u] for u in units if len(u) <= LONG}
        data = flat.tobytes()
        for i, a, b in zip(plain, [0, *ends[:-1]], ends, strict=True):
            out[i] = data[4 * a : 4 * b]
        return out

    def decode_batch(self, ids: list[np.ndarray]) -> pa.Array:
        """The texts of many id lists: piece bytes gathered at once; lists whose bytes are no UTF-8 go one by one."""
        flat = np.concatenate([*ids, np.zeros(0, "<i4")]).astype(np.int64)
        size = self._raw_at[flat + 1] - self._raw_at[flat]
        until = np.cumsum(size)
        data = self._raw[np.arange(int(until[-1]) if len(until) else 0) + np.repeat(self._raw_at[flat] - (until - size), size)]
        bounds = np.concatenate(([0], until))[np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))]
        first = bounds[:-1][bounds[1:] > bounds[:-1]]
        drop = first[data[first] == 32]
        data = np.delete(data, drop)
        bounds = bounds - np.searchsorted(drop, bounds)
        texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([self.decode(x.tolist()) for x in ids], pa.string())
        return texts.cast(pa.string())

    def units(self, text: str) -> list[str]:
        """Cut before every run of space marks; a run and the word behind it stay together."""
        parts = text.split(SPACE)
        units, lead = ([parts[0]] if parts[0] else []), ""
        for p in parts[1:]:
            lead += SPACE
            if p:
                units.append(lead + p)
                lead = ""
        if lead:
            units.append(lead)
        return units

    def encode_words(self, text: str) -> bytes:
        """The ids of a text that starts and ends at word boundaries."""
        known, word = self.words, self.word
        return b"".join([known.get(u) or word(u) for u in self.units(text)])

    # Boundary states: (place, length) of the last piece that ended at or before a boundary, the next crossing it; at the
    # start of a word the length is ``WHOLE``, whatever piece ended there.

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """The states possible at a boundary, by what stands around it."""
        if at == 0 or at == len(text) or boundary(text, at):
            return [(at, WHOLE)]
        return [x for p in range(max(0, at - self.longest + 1), at + 1) for x in ([(p, WHOLE)] if p == 0 or boundary(text, p) else [(p, len(y)) for y in self.ending(text, p)])]

    def _edges(self, text: str, node: tuple[int, int]) -> Iterator[tuple[int, int]]:
        place, size = node
        last = text[place - size : place] if size > 0 else ""
        for n in range(1, min(self.longest, len(text) - place) + 1):
            piece = text[place : place + n]
            if (n == 1 or piece in self.ids) and self.whole(piece) and (not last or boundary(text, place) or self.neighbours(last, piece)):
                yield place + n, n

    def transfer(self, text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
        """Entry states, exit states and the matrix between the boundaries (no word boundary lies between them): a row of
        bits for each exit."""
        if end - start > 4 * LONG:
            left, right = self.transfer(text, start, start + LONG), self.transfer(text, end - LONG, end)
            alive = [x for x, row in zip(left[1], left[2], strict=True) if row]
            return product(product(left, self._through(text, end - LONG, alive)), right)
        entries, exits = self.states(text, start), self.states(text, end)
        reach = self._reach(text, start, end, entries)
        return entries, exits, [reach.get(x, 0) for x in exits]

    def _reach(self, text: str, start: int, end: int, entries: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """For each node up to ``end`` the entry states that lead to it; exits keep those whose next piece crosses."""
        by_place: dict[int, dict[tuple[int, int], int]] = {}
        for i, node in enumerate(entries):
            at = by_place.setdefault(node[0], {})
            at[node] = at.get(node, 0) | 1 << i
        out: dict[tuple[int, int], int] = {}
        last_state = self.states(text, end)
        single = last_state == [(end, WHOLE)]
        for place in range(min(by_place, default=0), end + 1):
            for node, bits in by_place.pop(place, {}).items():
                if place == end and single:
                    out[(end, WHOLE)] = out.get((end, WHOLE), 0) | bits
                    continue
                crosses = False
                for nxt in self._edges(text, node):
                    if nxt[0] > end:
                        crosses = True
                    elif place >= start or nxt[0] > start or (place == start):
                        if place < start and nxt[0] <= start:
                            continue
                        at = by_place.setdefault(nxt[0], {})
                        nxt = (nxt[0], WHOLE) if boundary(text, nxt[0]) else nxt
                        at[nxt] = at.get(nxt, 0) | bits
                if crosses and not single:
                    out[node] = out.get(node, 0) | bits
        return out

    def _through(self, text: str, end: int, entries: list[tuple[int, int]]) -> Matrix:
        """The matrix from some states to a far boundary.  From a state there is at most one path to each place: the one
        to it from where the state's piece begins, if that goes through the state."""
        exits = self.states(text, end)
        begins = [place - max(size, 0) for place, size in entries]
        rows = [0] * len(exits)
        for i, ((place, _), begin, sizes) in enumerate(zip(entries, begins, self._sizes([text[x:end] for x in begins]), strict=True)):
            back, good = sizes.tolist(), {place - begin: True}
            for k, (at, size) in enumerate(exits):
                q, seen = at - begin, []
                while q > place - begin and q not in good:
                    seen.append(q)
                    q -= back[q]
                fine = good.get(q, False)
                good |= dict.fromkeys(seen, fine)
                if fine and back[at - begin] == size:
                    rows[k] |= 1 << i
        return entries, exits, rows

    def backtrace(self, text: str, start: int, end: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[str]:
        """The pieces that end in (start, end] on the path from one state to another."""
        begin, out = entry[0] - max(entry[1], 0), []
        back = self._sizes([text[begin : leave[0]]])[0].tolist()
        at = leave[0] - begin
        while at > entry[0] - begin:
            out.append(text[begin + at - back[at] : begin + at])
            at -= back[at]
        return out[::-1]

    def chunk_matrix(self, text: str, start: int, end: int) -> Matrix:
        """``transfer`` of a chunk: through its whole words there is one way."""
        whole = inner(text, start, end)
        if whole is None:
            return self.transfer(text, start, end)
        first, last = whole
        parts = [([(start, WHOLE)], [(start, WHOLE)], [1]) if first == start else self.transfer(text, start, first)]
        parts.append(([(first, WHOLE)], [(last, WHOLE)], [1]))
        if last < end:
            parts.append(self.transfer(text, last, end))
        return product(product(*parts[:2]), parts[2]) if len(parts) > 2 else product(*parts)

    def chunk_ids(self, text: str, start: int, end: int, entry: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """The ids of a chunk between its two states."""
        whole = inner(text, start, end)
        ids = lambda pieces: np.array(self.numbers(pieces), "<i4").tobytes()
        if whole is None:
            return ids(self.backtrace(text, start, end, entry, leave))
        first, last = whole
        head = b"" if first == start else ids(self.backtrace(text, start, first, entry, (first, WHOLE)))
        tail = b"" if last == end else ids(self.backtrace(text, last, end, (last, WHOLE), leave))
        return head + self.encode_words(text[first:last]) + tail

    def decode(self, ids) -> str:
        """The text of these ids: pieces joined, byte pieces as UTF-8, spaces restored, the dummy space dropped."""
        out, raw, byte_of, names = [], bytearray(), self.bytes, self.names
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(names[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words in a row, and where each begins and ends."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return codes, ends - np.fromiter(map(len, words), np.int64, len(words)), ends


BASE, FIRST_CODE = U64(0x9E3779B97F4A7C15), U64(0x51ED27)
POWERS = np.concatenate(([U64(1)], np.cumprod(np.full(64, BASE, np.uint64))))


def _key(piece: str) -> int:
    """The 64-bit key of a piece: a polynomial over its mixed code points."""
    key = np.zeros(1, np.uint64)
    for v in mix(_codes([piece])[0].astype(np.uint64) + FIRST_CODE):
        key = key * BASE + v
    return int(key[0])


def boundary(text: str, at: int) -> bool:
    """A word boundary: a space mark begins here, after something else."""
    return 0 < at < len(text) and text[at] == SPACE and text[at - 1] != SPACE


def normalised(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def cuts(text: str, size: int) -> list[int]:
    """Chunk boundaries: the multiples of ``size``, wherever they fall."""
    return [*range(0, len(text), size), len(text)]


def inner(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The first and the last word boundary from ``a`` to ``b`` (the ends of the text count); None without any."""
    ends = lambda p: p in (0, len(text)) or boundary(text, p)
    first, last = a, b
    while first <= b and not ends(first):
        first = text.find(SPACE, first + 1, b + 1)
        if first < 0:
            return None
    while not ends(last):
        last = text.rfind(SPACE, a, last)
    return first, last


Matrix = tuple[list, list, list[int]]  # entry states, exit states, and a row of bits of entries for each exit


def product(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product: an exit is reached from the entries that lead to a state in between that leads to it."""
    at = {state: i for i, state in enumerate(left[1])}
    rows = []
    for row in right[2]:
        bits = 0
        for i, state in enumerate(right[0]):
            if row >> i & 1 and state in at:
                bits |= left[2][at[state]]
        rows.append(bits)
    return left[0], right[1], rows


def scan(matrices: list[Matrix]) -> list[tuple[int, int]]:
    """The state at every boundary of a document, by products in a balanced tree and a walk down from its root."""

    def up(lo: int, hi: int) -> tuple:
        if hi - lo == 1:
            return matrices[lo], None, None
        left, right = up(lo, (lo + hi) // 2), up((lo + hi) // 2, hi)
        return product(left[0], right[0]), left, right

    def down(node: tuple, lo: int, hi: int, before: set, after: set) -> None:
        """``before``: the states at the left end that the start leads to; ``after``: those at the right end that lead on."""
        if node[1] is None:
            return
        (entries, exits, rows), (entries2, exits2, rows2) = node[1][0], node[2][0]
        reached = {x for x, row in zip(exits, rows, strict=True) if any(row >> i & 1 for i, e in enumerate(entries) if e in before)}
        leads = {e for i, e in enumerate(entries2) if any(row >> i & 1 for x, row in zip(exits2, rows2, strict=True) if x in after)}
        mid = (lo + hi) // 2
        chosen[mid] = min(reached & leads)  # one path reaches the end, so there is one
        down(node[1], lo, mid, before, {chosen[mid]})
        down(node[2], mid, hi, {chosen[mid]}, after)

    root, n = up(0, len(matrices)), len(matrices)
    chosen: list[tuple[int, int]] = [matrices[0][0][0]] * n + [matrices[-1][1][0]]
    down(root, 0, n, {chosen[0]}, {chosen[n]})
    return chosen


_IDS = "row long, doc_id long, ids binary"


_BOTH = "row long, doc_id long, n_pieces long, ids_crc32 long, ids binary, decoded string"


def _both(use: Pieces, row: pa.Array, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    """Ids with their number, checksum and decoded text."""
    numbers = [np.frombuffer(x, "<i4") for x in ids]
    columns = [row, doc_id, pa.array([len(x) for x in numbers], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary()), use.decode_batch(numbers)]
    return pa.record_batch(columns, names=["row", "doc_id", "n_pieces", "ids_crc32", "ids", "decoded"])


def _short(path: str, chunk: int, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = pieces_of(path)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if t is None or len(t) < chunk]
            ids = use.encode_batch([texts[i] for i in keep])
            some = part.take(pa.array(keep, pa.int64()))
            if not keep:
                continue
            if back:
                yield _both(use, some.column("row"), some.column("doc_id"), ids)
            else:
                yield pa.record_batch([some.column("row"), some.column("doc_id"), pa.array(ids, pa.binary())], names=["row", "doc_id", "ids"])
        use.forget()

    return run


def _chunks(path: str, chunk: int):
    """Long documents in chunks, each with the characters around it that its boundary states may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = pieces_of(path).longest
        for part in slices(batches):
            for row, doc, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text is not None and len(text) >= chunk:
                    text = normalised(text)
                    at = cuts(text, chunk)
                    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        left, right = max(0, a - 2 * around), min(len(text), b + 2 * around)
                        yield pa.record_batch([pa.array([x], t) for x, t in ((row, pa.int64()), (doc, pa.int64()), (k, pa.int32()), (left, pa.int64()), (a - left, pa.int64()), (b - left, pa.int64()), (text[left:right], pa.string()))], names=["row", "doc_id", "k", "offset", "a", "b", "text"])

    return run


def _absolute(states: list[tuple[int, int]], offset: int) -> list[list[int]]:
    return [[p + offset, n] for p, n in states]


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = pieces_of(path)
        for part in slices(batches, limit=1 << 20):
            out = []
            for x in part.to_pylist():
                text, a, b = x["text"], x["a"], x["b"]
                entries, exits, rows = use.chunk_matrix(text, a, b)
                width = -(-len(entries) // 8)
                out.append((x["row"], x["k"], sum(_absolute(entries, x["offset"]), []), sum(_absolute(exits, x["offset"]), []), b"".join(r.to_bytes(width, "little") for r in rows)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["row", "k", "entries", "exits", "matrix"])

    return run


def _scanned(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda x: x["k"])
    matrices = []
    for x in rows:
        entries, exits = (list(zip(x[c][::2], x[c][1::2], strict=True)) for c in ("entries", "exits"))
        width = -(-len(entries) // 8)
        matrices.append((entries, exits, [int.from_bytes(x["matrix"][i * width : (i + 1) * width], "little") for i in range(len(exits))]))
    states = scan(matrices)
    return pa.table([[x["row"] for x in rows], pa.array([x["k"] for x in rows], pa.int32()), [list(s) for s in states[:-1]], [list(s) for s in states[1:]]], names=["row", "k", "entry", "leave"])


def _backtraced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = pieces_of(path)
        for part in slices(batches, limit=1 << 20):
            out = []
            for x in part.to_pylist():
                text, a, b, o = x["text"], x["a"], x["b"], x["offset"]
                (p, n), (q, m) = x["entry"], x["leave"]
                out.append((x["row"], x["doc_id"], x["k"], use.chunk_ids(text, a, b, (p - o, n), (q - o, m))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["row", "doc_id", "k", "ids"])

    return run


def _joined(group: pa.Table) -> pa.Table:
    group = group.sort_by("k")
    return pa.table([group["row"][:1], group["doc_id"][:1], pa.array([b"".join(group["ids"].to_pylist())], pa.binary())], names=["row", "doc_id", "ids"])


def encode(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, back: bool = False) -> DataFrame:
    """Per row of ``docs(row, doc_id, text)``: row, doc_id and ids (little-endian 32-bit, in one binary).

    With ``back`` the ids are decoded at once, by the same task: the columns of ``decode``.
    """
    if chunk < 40 or chunk < 2 * pieces_of(path).longest:
        raise ValueError("chunks must be longer than two pieces")
    docs = light_batches(docs).select(F.col("row").cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = docs.mapInArrow(_short(path, chunk, back), _BOTH if back else _IDS)
    long = docs.where(F.length("text") >= chunk).mapInArrow(_chunks(path, chunk), "row long, doc_id long, k int, offset long, a long, b long, text string")
    parts = checkpoint(long.repartition(parallelism(docs.sparkSession), "row", "k"))
    states = parts.mapInArrow(_transfers(path), "row long, k int, entries array<long>, exits array<long>, matrix binary").groupBy("row").applyInArrow(_scanned, "row long, k int, entry array<long>, leave array<long>")
    traced = parts.join(states, ["row", "k"]).mapInArrow(_backtraced(path), "row long, doc_id long, k int, ids binary")
    joined = traced.groupBy("row").applyInArrow(_joined, _IDS)
    return short.union(decode(joined, path) if back else joined)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = pieces_of(path)
        for part in slices(batches, "ids"):
            yield _both(use, part.column("row"), part.column("doc_id"), part.column("ids").to_pylist())

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encoded(row, doc_id, ids)``: row, doc_id, n_pieces, ids_crc32, ids and the decoded text."""
    return encoded.mapInArrow(_decoded(path), _BOTH)


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and decode the ids: doc_id, n_pieces, ids_crc32, text_sha, n_chars (decoded)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return encode(rows, path, chunk, back=True).select("doc_id", "n_pieces", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha"), F.length("decoded").cast("long").alias("n_chars"))
