"""Exact, memoised encoding with the public BPE tokenizers.

A whole text is cut only where the tokenizer itself always cuts, so that the
ids of the text are the ids of its pieces one after another:

* ``word_bpe_49k.json`` drops white space and never joins across it, so pieces
  are the runs between white space;
* ``byte_bpe_50k.json`` lets a piece start with at most one space and never
  lets a token run from a non-space into a space, so a space that follows a
  non-space always starts a new piece.

A text of ASCII and Latin-1 letters alone is cut further, by the tokenizer's own
pre-tokenisation pattern, and each unit goes to the library's BPE model. Other
texts are cut into pieces as above; a piece with any further character goes
through the library's whole encoder.

A special token that stands in a text is plain text, or with ``special`` its own id, as
in the library's default call; the text is then cut there first, as the library does.

``encode_all`` takes many texts: those of ASCII and Latin-1 letters, ``PART`` characters (or
one text) at once, are cut into units as one array, and the merges of all their different units
are done side by side: each round merges in each unit the pair that is next there.

In ``encode_bytes`` units repeat, so their ids are kept (as little-endian uint32 bytes) in two
generations of ``cache_entries`` units each: memory stays bounded however large
the vocabulary of the corpus is, and frequent units survive.
"""

from __future__ import annotations

import contextlib
import json
import re
from array import array

import numpy as np

#: Latin-1 letters: NFC-stable, and lower-cased alike by every library.
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_SIMPLE = re.compile(rf"[\n\x20-\x7e{_UP}{_LOW}]*").fullmatch
#: White space as the tokenizers see it (Python's also holds U+001C to U+001F).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NON_SPACE = re.compile(f"[^{_SPACE}]+").findall
_CUT_AT_SPACE = re.compile(rf"(?<=[^\s]) ").split
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_SPLIT = re.compile(rf"{_CONTRACTIONS}|[{_LOW}]+|[0-9]|[^\s{_LOW}0-9]+").findall
_BYTE_SPLIT = re.compile(
    rf"{_CONTRACTIONS}| ?[{_UP}{_LOW}]+| ?[0-9]+| ?[^\s{_UP}{_LOW}0-9]+|\s+(?!\S)|\s+"
).findall


PART = 2_000_000
LONG = 64  # bytes of a unit that goes to the library's model
_LETTER, _DIGIT, _BLANK, _SIGN, _END = range(5)


def _kinds() -> np.ndarray:
    """Of each Latin-1 character of a simple text; NUL ends texts."""
    out = np.full(256, _SIGN, "u1")
    out[0] = _END
    for kind, pattern in ((_LETTER, f"[{_UP}{_LOW}]"), (_DIGIT, "[0-9]"), (_BLANK, "[ \n]")):
        out[[c for c in range(256) if re.match(pattern, chr(c))]] = kind
    return out


_KIND = _kinds()
_PRINTED = bytes(range(0x20, 0x7F))
_LOWER = bytes(ord(chr(c).lower()) for c in range(256))


def unit_starts(data: np.ndarray, byte_level: bool) -> np.ndarray:
    """Where the units of simple texts start, as ``_BYTE_SPLIT`` or ``_WORD_SPLIT`` finds them: flags of the characters.

    ``data``: Latin-1 characters, a NUL before each text and two behind the last.
    """
    kind = _KIND[data]
    changed = np.empty(len(data), bool)
    changed[0] = True
    np.not_equal(kind[1:], kind[:-1], out=changed[1:])
    blank = kind == _BLANK
    if byte_level:
        # the last white space before a word stands apart from those before it; a space is the word's first character
        follows = np.append(kind[1:] < _BLANK, False) | np.append(kind[1:] == _SIGN, False)
        space = np.concatenate([[False], data[:-1] == 32])
        begin = np.where(blank, changed | follows, changed & ~space)
    else:
        begin = changed & ~blank | (kind == _DIGIT)
    quote = np.flatnonzero(data == 39)
    quote = quote[kind[quote - 1] != _SIGN]
    if byte_level:
        quote = quote[data[quote - 1] != 32]
    if len(quote):
        second, third = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        size = 2 * np.isin(second, list(b"stmd")) + 3 * (((second == 114) | (second == 118)) & (third == 101) | (second == 108) & (third == 108))
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        behind = quote + size
        begin[behind] |= kind[behind] == _LETTER
    return begin & (kind != _END)


class Merges:
    """Byte pair merges of many units at once; ids are under 0xFFFF. Pairs stand in an open hash table."""

    NONE = np.uint32(0xFFFFFFFF)

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        alphabet = byte_alphabet()
        self.inner = np.array([vocabulary[x] for x in alphabet], "u4")
        self.last = np.array([vocabulary[x + suffix] for x in alphabet], "u4")
        left, right = (np.array([vocabulary[x[k]] for x in merges], "u4") for k in range(2))
        self.made = np.array([vocabulary["".join(x)] for x in merges], "u4")
        keys, self.bits = left << 16 | right, 18
        self.keys, self.ranks = np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits, "u4")
        rest, slot = np.arange(len(keys), dtype="u4"), self._slot(keys)
        while len(rest):
            free = self.keys[slot] == self.NONE
            self.ranks[slot[free]] = rest[free]
            self.keys[slot[free]] = keys[self.ranks[slot[free]]]
            left_over = self.keys[slot] != keys[rest]
            rest, slot = rest[left_over], slot[left_over] + np.uint32(1) & np.uint32((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The number of each pair's merge, ``NONE`` for no merge."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], self.NONE)
        more = np.flatnonzero((there != keys) & (there != self.NONE))
        at, key = slot[more], keys[more]
        while len(more):
            at = at + np.uint32(1) & np.uint32((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == key
            out[more[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != self.NONE)
            more, at, key = more[go], at[go], key[go]
        return out

    def ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each unit's) of units of UTF-8 bytes (``sizes`` of them, none 0) that stand one after another."""
        n, none = len(data), self.NONE
        stops = np.cumsum(sizes)
        own = np.zeros(n + 2, "u4")  # a place more at either end, never merged
        own[1:-1] = self.inner[data]
        own[stops] = self.last[data[stops - 1]]
        ends = np.zeros(n + 2, bool)  # of units
        ends[0] = ends[stops] = ends[-1] = True
        after, before = np.arange(1, n + 3, dtype="i4"), np.arange(-1, n + 1, dtype="i4")
        rank = np.full(n + 2, none)
        inside = np.flatnonzero(~ends)
        rank[inside] = self.rank(own[inside] << 16 | own[inside + 1])
        alive = np.ones(n + 2, bool)
        alive[[0, -1]] = False
        unit = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
        while len(inside):
            mine, of = rank[inside], unit[inside - 1]
            firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.minimum.reduceat(mine, firsts)
            least = np.repeat(least, np.diff(firsts, append=len(of)))
            first = (mine == least) & (mine != none)
            at = inside[first]
            single = rank[before[at]] != mine[first]  # of equal pairs that overlap the left one
            at, made = at[single], mine[first][single]
            inside = inside[least != none]  # units without a merge are done
            gone = after[at]
            own[at] = self.made[made]
            ends[at] = ends[gone]
            alive[gone] = False
            rank[gone] = none
            behind = after[gone]
            after[at] = behind
            before[behind] = at
            changed = np.concatenate([at, before[at]])
            rank[changed] = none
            changed = changed[~ends[changed]]
            rank[changed] = self.rank(own[changed] << 16 | own[after[changed]])
            inside = inside[alive[inside] & ~ends[inside]]
        return own[alive], np.add.reduceat(alive[1:-1], stops - sizes, dtype="i8") if len(sizes) else np.zeros(0, "i8")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


class Memo(dict):
    """key -> bytes, made on first use and kept in two generations of bounded size."""

    def __init__(self, encode, entries: int = 200_000):
        super().__init__()
        self._encode, self._entries, self._older = encode, entries, {}

    def __missing__(self, unit):
        ids = self._older.get(unit) or self._encode(unit)
        if len(self) >= self._entries:
            self._older = dict(self)
            self.clear()
        if len(unit) <= 64:
            self[unit] = ids
        return ids


class Encoder:
    """``encode_bytes(text)``: the ids of a whole text as little-endian uint32."""

    def __init__(self, path: str, cache_entries: int = 200_000, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = spec["normalizer"] is None
        self._split = _BYTE_SPLIT if self.byte_level else _WORD_SPLIT
        alphabet = byte_alphabet()
        self._latin = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in [*range(33), *range(127, 256)]}
        self._model = self.tokenizer.model.tokenize
        self._get = Memo(self._unit, cache_entries).__getitem__
        self._spec, self._merges, self._known = spec["model"], None, {}
        plain = not any(self._spec[x] for x in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        suffix = self._spec["end_of_word_suffix"] or ""
        self._side_by_side = plain and all(x in self._spec["vocab"] for a in alphabet for x in (a, a + suffix)) and max(self._spec["vocab"].values()) < 0xFFFF
        added = spec["added_tokens"] if special else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that match more or less than their own characters")
        self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self._markers = re.compile("|".join(re.escape(x) for x in sorted(self._added, key=len, reverse=True)))

    def _unit(self, unit: str) -> bytes:
        if self.byte_level or not unit.isascii():
            unit = unit.translate(self._latin)
        return array("I", [t.id for t in self._model(unit)]).tobytes()

    @contextlib.contextmanager
    def ahead(self, words: list[bytes]):
        """Meanwhile ``encode_word`` knows these different words of UTF-8; it is asked once for each."""
        plain = [w for w in words if w and w.isascii()] if self._side_by_side and not self._added else []
        if b"".join(plain).translate(None, _PRINTED):
            plain = [w for w in plain if not w.translate(None, _PRINTED)]
        for k in range(0, len(plain), 100_000):
            some = plain[k : k + 100_000]
            self._known.update(zip(some, self._simple_texts(some)))
        rest = [w for w in words if w not in self._known]
        self._known.update(zip(rest, self.encode_all(w.decode("utf-8", "surrogatepass") for w in rest)))
        try:
            yield
        finally:
            self._known = {}

    def encode_word(self, word: bytes) -> bytes:
        """The ids of a word that is not seen again: not kept, and in one piece if it is all of small letters."""
        if (ids := self._known.pop(word, None)) is not None:
            return ids
        word = word.decode("utf-8", "surrogatepass")
        if not self.byte_level and word.isascii() and word.isalpha() and word.islower():
            return self._unit(word)
        return self.encode_bytes(word)

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self._get, self._split(text if self.byte_level else text.lower())))

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._added and self._markers.search(text):
            return self._marked(text)
        return self._plain(text)

    def _marked(self, text: str) -> bytes:
        out, at = [], 0
        for found in self._markers.finditer(text):
            out += [self._plain(text[at : found.start()]), self._added[found[0]]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _SIMPLE(text):
            return self._simple(text)
        out = []
        for piece in self.pieces(text):
            if _SIMPLE(piece):
                out.append(self._simple(piece))
            else:
                out.append(array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes())
        return b"".join(out)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after another, are those of the text."""
        if not self.byte_level:
            return _NON_SPACE(text)
        first, *rest = _CUT_AT_SPACE(text)
        return [first, *[" " + x for x in rest]]

    def merges(self) -> Merges:
        """Made on first use."""
        if self._merges is None:
            pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in self._spec["merges"]]
            self._merges = Merges(self._spec["vocab"], pairs, self._spec["end_of_word_suffix"] or "")
        return self._merges

    def encode_units(self, units) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each unit's) of an Arrow large binary array of units, none empty, of Latin-1 characters."""
        if not len(units):
            return np.zeros(0, "<u4"), np.zeros(0, "i8")
        starts = np.frombuffer(units.buffers()[1], "i8")[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(units.buffers()[2], "u1")[starts[0] : starts[-1]]
        starts = starts - starts[0]
        wide = data >= 0x80
        if wide.any():  # to UTF-8
            more = np.concatenate([[0], np.cumsum(wide)])
            leads = np.flatnonzero(wide) + np.arange(more[-1])
            trails, starts, data = data[wide] & 63 | 0x80, starts + more[starts], np.repeat(data, 1 + wide)
            data[leads], data[leads + 1] = data[leads] >> 6 | 0xC0, trails
        sizes = np.diff(starts)
        long = np.flatnonzero(sizes > LONG)
        if not len(long):
            return self.merges().ids(data, sizes)
        short = sizes <= LONG
        few, some = self.merges().ids(data[np.repeat(short, sizes)], sizes[short])
        # each long one's ids in its place among the others
        each = [np.frombuffer(self._unit(units[int(k)].as_py().decode("latin-1")), "<u4") for k in long]
        numbers = np.zeros(len(sizes), "i8")
        numbers[short], numbers[long] = some, [len(x) for x in each]
        behind = np.cumsum(some)
        at = [int(behind[k - j - 1]) if k > j else 0 for j, k in enumerate(long)]
        parts = [x for a, b, ids in zip([0, *at], at, each) for x in (few[a:b], ids)]
        return np.concatenate([*parts, few[at[-1] :]]), numbers

    def encode_all(self, texts):
        """The ids of each text of an iterable, as ``encode_bytes`` tells them, one after another."""
        held, kept, size = [], [], 0
        for text in texts:
            if text and self._side_by_side and _SIMPLE(text) and not (self._added and self._markers.search(text)):
                held.append(None)
                kept.append(text.encode("latin-1"))
                size += len(text)
                if size < PART:
                    continue
            else:
                held.append(text or "")
            if size >= PART or len(held) >= 10_000:
                yield from self._together(held, kept)
                held, kept, size = [], [], 0
        yield from self._together(held, kept)

    def _together(self, held: list[str | None], kept: list[bytes]):
        simple = iter(self._simple_texts(kept) if kept else ())
        for text in held:
            yield next(simple) if text is None else self.encode_bytes(text)

    def _simple_texts(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        joined = b"\0".join([b"", *texts, b"\0"])
        data = np.frombuffer(joined if self.byte_level else joined.translate(_LOWER), "u1")
        begin = unit_starts(data, self.byte_level)
        keep = data != 0 if self.byte_level else (data != 0) & (_KIND[data] != _BLANK)
        ends = np.searchsorted(np.flatnonzero(begin), np.cumsum([1, *(len(t) + 1 for t in texts)]))  # units before each text
        starts = np.append(np.flatnonzero(begin[keep]), np.count_nonzero(keep))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype("i8")), pa.py_buffer(data[keep])]).dictionary_encode()
        number = np.asarray(units.indices)
        ids, sizes = self.encode_units(units.dictionary)
        of = np.take(sizes, number)
        stops = np.cumsum(of)
        places = np.arange(stops[-1] if len(stops) else 0) + np.repeat(np.take(np.cumsum(sizes) - sizes, number) - stops + of, of)
        out = np.take(ids, places).astype("<u4").tobytes()
        cuts = (4 * np.append(0, stops)[ends]).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, cache_entries: int = 200_000, special: bool = False) -> Encoder:
    """One encoder for each worker process and file; its table outlives tasks."""
    key = (path, cache_entries, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
