"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage by up to ``budget = floor(n * error_rate)`` word edits. Cut into
budget + 1 pieces, one piece must stand unchanged. Piece hits are found by hashed lookups at every word of the whole
text; around each, Myers' bit-parallel algorithm gives the least edit distance of the item to any substring.

Words are runs of letters and digits in lower case, so case, spacing and punctuation do not hide a passage.

Items are sent to the executors in blocks of bounded size; a larger test set takes more passes, not more memory.

Defined cases: null or wordless texts and items match nothing; null ids stay null in the result; repeated items are
reported by each id, repeated rows once an id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix64, slices

ERROR_RATE = 0.2
#: A block of items that goes to each executor at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 runs (start, length) that cover n words, as even as can be."""
    cuts = [n * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: list, text: list) -> list[int]:
    """Least edit distance of the whole pattern to a substring of text that ends at each position (Myers 1999)."""
    m = len(pattern)
    peq: dict = {}
    for k, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << k)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        out.append(score)
    return out


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= 1 << 19:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def _hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


class PieceIndex:
    """Pieces of a block of items, by length, as sorted hashes."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, w, int(len(w) * error_rate)) for i, t in items if (w := item_words(t))]
        self.hashes = [_hash_words(w) for _, w, _ in self.items]
        by_width: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (_, words, budget) in enumerate(self.items):
            for start, width in pieces(len(words), budget):
                h = int(_windows(self.hashes[k][start : start + width], width)[0])
                by_width.setdefault(width, {}).setdefault(h, []).append((k, start))
        self.by_width = {w: (np.array(sorted(t), np.uint64), t) for w, t in by_width.items()}

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int, int, int]]:
        """item's place, distance, first and last character of the passage; the best passage of each item."""
        words = item_words(text)
        if not words or not self.by_width:
            return
        h = _hash_words(words)
        starts: dict[int, set[int]] = {}
        for width, (known, table) in self.by_width.items():
            if width > len(h):
                continue
            found = _windows(h, width)
            at = np.searchsorted(known, found)
            at[at == len(known)] = 0
            for pos in np.flatnonzero(known[at] == found).tolist():
                for k, offset in table[int(found[pos])]:
                    starts.setdefault(k, set()).add(pos - offset)
        spans = None
        for k, begins in starts.items():
            _, pattern, budget = self.items[k]
            pattern_h, best = self.hashes[k].tolist(), None
            for lo, hi in _merged(sorted(begins), len(pattern), budget, len(h)):
                window = h[lo:hi].tolist()
                scores = myers(pattern_h, window)
                d = min(scores)
                if d <= budget and (best is None or d < best[0]):
                    end = scores.index(d)
                    back = myers(pattern_h[::-1], window[: end + 1][::-1])
                    best = (d, lo + end - back.index(d), lo + end)
            if best:
                if spans is None:
                    spans = [m.span() for m in _WORD.finditer(text)] if len(text.lower()) == len(text) else []
                first, last = (spans[best[1]][0], spans[best[2]][1]) if len(spans) == len(words) else (-1, -1)
                yield k, best[0], first, last, best[1], best[2]


def _merged(begins: list[int], n: int, budget: int, total: int) -> Iterator[tuple[int, int]]:
    """Windows in which an item may stand; overlapping ones become one."""
    lo = hi = -1
    for b in begins:
        a, z = max(0, b - budget), min(total, b + n + budget)
        if a <= hi:
            hi = max(hi, z)
        else:
            if hi > lo >= 0:
                yield lo, hi
            lo, hi = a, z
    if hi > lo >= 0:
        yield lo, hi


_HITS = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "item_words", "char_start", "char_end")])


def _match(block, error_rate: float):
    def run(batches):
        index = PieceIndex(block.value, error_rate)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, distance, first, last, _, _ in index.matches(text):
                    rows.append((doc_id, index.items[k][0], distance, len(index.items[k][1]), first, last))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(_HITS), schema=_HITS)

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_ITEMS and about BLOCK_CHARS, streamed by partition, never all on the driver."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row["text"]) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """Matches of ``items`` (item_id, text) in ``docs`` (doc_id, text): doc_id, item_id, distance (word edits),
    item_words, char_start, char_end (of the best passage; -1 where lower-casing changes the text's length)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ddl = ", ".join(f"{f.name} long" for f in _HITS)
    out = spark.createDataFrame([], ddl)
    for k, block in enumerate(item_blocks(items)):
        found = rows.mapInArrow(_match(spark.sparkContext.broadcast(block), error_rate), ddl)
        out = found if k == 0 else out.union(found)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the rows in which any item is found; all columns as they are."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    out = docs
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            index = PieceIndex(shared.value, error_rate)
            for batch in slices(batches):
                clean = [next(index.matches(t), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
