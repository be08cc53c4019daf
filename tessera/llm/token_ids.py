"""Token ids of whole texts, through the tokenizers library.

A byte-level BPE merges inside the pieces its pre-tokenizer cuts, never across them, so the ids of a text are the ids
of its pieces in a row. Many texts are cut at once, by array operations on the classes of their characters; pieces are
known by a hash, and only a piece not met before goes to the library's merge model. The ids are those of the library's
``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np
import regex

from tessera.llm.words import mix64

#: Fixed value: the piece pattern of byte-level BPE vocabularies. ``_starts`` cuts as it does.
BYTE_LEVEL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = range(5)
#: Characters of one pass, most pieces that are kept, and the longest that is.
PASS_CHARS, KEPT, LONGEST = 1 << 18, 1 << 18, 64
_STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern tells them apart; of those that this Python's Unicode lacks, only
    the library knows it."""
    every = "".join(map(chr, range(0x110000)))
    out = np.fromiter(map({**dict.fromkeys(("Lu", "Ll", "Lt", "Lm", "Lo"), _LETTER), **dict.fromkeys(("Nd", "Nl", "No"), _NUMBER), "Cn": _UNKNOWN}.get, map(unicodedata.category, every), repeat(_OTHER)), np.uint8, len(every))
    for m in regex.finditer(r"\s", every):
        out[m.start()] = _SPACE
    return out


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse (mod 2^64)."""
    return tuple(np.cumprod(np.full(PASS_CHARS + 1, step, np.uint64)) for step in (_STEP, pow(_STEP, -1, 1 << 64)))


def _starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end; ``kind`` are the classes of their characters, ``first`` the places
    where texts start."""
    n = len(points)
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run[first] = True
    new_text = np.zeros(n + 1, bool)
    new_text[first] = new_text[n] = True
    start = run.copy()
    # the last space before other characters stands alone, or with them if it is a blank
    after = np.flatnonzero(run[1:] & (kind[:-1] == _SPACE) & ~new_text[1:n]) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 0x20
    # an apostrophe alone that begins a piece takes the endings of the pattern with it
    mark = np.flatnonzero((points[:-2] == 0x27) & start[:-2] & run[1:-1] & (kind[1:-1] == _LETTER) & ~new_text[1 : n - 1]) if n > 2 else np.empty(0, np.int64)
    end = n - 2
    if n > 1 and points[end] == 0x27 and start[end] and run[end + 1] and kind[end + 1] == _LETTER and not new_text[end + 1]:
        mark = np.append(mark, end)
    if len(mark):
        one = points[mark + 1]
        two = np.where(new_text[mark + 2], 0, points[np.minimum(mark + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        rest = np.concatenate([mark[short] + 2, mark[long & ~short] + 3])
        rest = rest[rest < n]
        start[rest[kind[rest] == _LETTER]] = True
    return start


class _PieceTable:
    """Ids of pieces by their hash: linear probing on arrays, so that a whole pass is looked up at once.

    At ``most`` pieces it is emptied and begins anew.
    """

    def __init__(self, most: int = KEPT):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits, self.count, self.used = 16, 0, 0
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.at, self.size, self.ids = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), np.zeros(1 << 17, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        entry = np.where(held == keys, self.place[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            entry[left[hit]] = self.place[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return entry

    def _put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            empty = self.keys[slot] == 0
            self.keys[slot[empty]] = keys[empty]
            won = empty & (self.keys[slot] == keys)
            self.place[slot[won]] = entries[won]
            keys, entries, slot = keys[~won], entries[~won], (slot[~won] + 1) & mask

    def append(self, lists: list[list[int]]) -> np.ndarray:
        """Entries for the ids of new pieces."""
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        total, count = int(sizes.sum()), self.count + len(lists)
        for name, need in (("at", count), ("size", count), ("ids", self.used + total)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.size[self.count : count] = sizes
        self.at[self.count : count] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.uint32, total)
        entries = np.arange(self.count, count, dtype=np.int32)
        self.count, self.used = count, self.used + total
        return entries

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> np.ndarray:
        """Keep new pieces; ``keys`` are distinct and not yet in the table."""
        entries = self.append(lists)
        if 2 * self.count > 1 << self.bits:
            while 2 * self.count > 1 << self.bits:
                self.bits += 1
            old, place = self.keys, self.place
            self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old[old != 0], place[old != 0])
            del old, place
        self._put(keys, entries)
        return entries


class TextEncoder:
    """``encode_many(texts)`` gives the ids of each whole text as unsigned 32-bit arrays, ``encode(text)`` those of one
    as little-endian bytes; null is empty.

    A text that holds the string of an added token, or a character that this Python does not know, goes to the library
    as it is, as does every text if the vocabulary is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.table = self.tokenizer.model.tokenize, _PieceTable()
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        #: The letter by which a byte-level vocabulary writes each byte: printable ones themselves, the others from 256 on.
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _ids(self, piece: str) -> list[int]:
        letters = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        return [t.id for t in self.merge(letters.translate(self.letters))]

    def _plainly(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pass(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of non-empty texts of at most PASS_CHARS characters in all."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths) - lengths
        kind = _classes()[points]
        unknown = np.flatnonzero(kind == _UNKNOWN)
        if len(unknown):
            odd = set((np.searchsorted(first, unknown, "right") - 1).tolist())
            rest = iter(self._pass([t for k, t in enumerate(texts) if k not in odd])) if len(odd) < len(texts) else iter(())
            return [self._plainly(t) if k in odd else next(rest) for k, t in enumerate(texts)]
        starts = np.flatnonzero(_starts(points, kind, first))
        sizes = np.diff(starts, append=len(points))
        up, down = _powers()
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        keys = mix64((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64)) | np.uint64(1)
        table = self.table
        if table.count > table.most:
            table.clear()
        entry = table.find(keys)
        cut = lambda k: whole[starts[k] : starts[k] + sizes[k]]
        short = sizes <= LONGEST
        new = np.flatnonzero((entry < 0) & short)
        if len(new):
            fresh, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            entry[new] = table.add(fresh, [self._ids(cut(k)) for k in new[where].tolist()])[back]
        count, used = table.count, table.used
        long = np.flatnonzero(~short)
        if len(long):  # not kept: they have entries for this pass alone
            entry[long] = table.append([self._ids(cut(k)) for k in long.tolist()])
        widths = table.size[entry].astype(np.int64)
        ends = np.cumsum(widths)
        ids = table.ids[np.repeat(table.at[entry] - (ends - widths), widths) + np.arange(ends[-1])]
        table.count, table.used = count, used
        return np.split(ids, (ends - widths)[np.searchsorted(starts, first[1:])])

    def _long(self, text: str) -> np.ndarray:
        """Ids of a text of more than PASS_CHARS characters: parted at single blanks, which always begin a piece."""
        out, at = [], 0
        while at < len(text):
            end = min(at + PASS_CHARS, len(text))
            if end < len(text):
                end = next((k for k in range(end - 1, at, -1) if text[k] == " " and not text[k - 1].isspace() and not text[k + 1].isspace()), 0)
                if not end:
                    return self._plainly(text)
            out += self._pass([text[at:end]])
            at = end
        return np.concatenate(out)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        held: list[int] = []
        size = 0

        def flush():
            for k, ids in zip(held, self._pass([texts[k] for k in held]) if held else [], strict=True):
                out[k] = ids
            held.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.plain or any(token in text for token in self.added):
                out[k] = self._plainly(text)
            elif len(text) > PASS_CHARS:
                out[k] = self._long(text)
            else:
                if size + len(text) > PASS_CHARS:
                    flush()
                    size = 0
                held.append(k)
                size += len(text)
        flush()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    return TextEncoder(path)


def default_vocabulary() -> str:
    """The public byte-level vocabulary; its path is a parameter of every operator that encodes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
