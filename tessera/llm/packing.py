"""Packing along a space-filling curve.

Each document's ids are hashed into a signed vector and projected to three numbers; their ranks on a fixed grid
give a Hilbert key. Documents are range-sorted by that key, so neighbours in a sequence are alike, and laid end
to end within each range: a sequence is cut every ``length`` ids, and a document runs on into the next one. What
is left at a range's end is cut at powers of two, which need no padding.

Rows of one key (copies) are parted by a hash of doc_id, so a hot group spreads over ranges.

Defined cases: null text is the end id alone; null doc_id is packed like any other; repeated rows are packed each;
an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize, shuffle_width
from tessera.llm.token_ids import default_vocabulary, text_encoder
from tessera.llm.words import mix64, slices

SEQUENCE, END_ID = 2048, 1
DIMENSIONS, BITS = 3, 10
SLICE_ROWS = 512
#: Ids of a range, about: 64 MB at two bytes each.
RANGE_IDS = 1 << 25


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows of ``points``, each coordinate below 2^bits).

    Skilling's transpose form: undo the excess rotations from the top bit down, Gray-code, interleave.
    """
    x = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(len(x)):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[k]
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


def id_directions(size: int) -> np.ndarray:
    """A fixed signed direction for each token id: hashed features, projected."""
    h = mix64(np.arange(size, dtype=np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(1, DIMENSIONS + 1, dtype=np.uint64))
    return (h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - np.float32(1)


def grid_point(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Mean direction of the ids, scaled by 8 whatever the length, squashed to the grid: texts of one mixture of ids
    land close by, however long they are; long ones lie nearer to the middle, as their means do."""
    mean = directions[ids].sum(axis=0) / len(ids)
    squashed = 0.5 + np.arctan(mean * 8) / np.pi
    return np.minimum((squashed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


_KEYED = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _encode(vocabulary: str, end_id: int):
    def run(batches):
        encoder, directions = text_encoder(vocabulary), None
        end = np.array([end_id], np.uint32)
        for part in slices(batches, SLICE_ROWS):
            if directions is None:
                directions = id_directions(max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
            points, packed, sizes = [], [], []
            for ids in encoder.encode_many(part.column(1).to_pylist()):
                ids = np.concatenate([ids, end])
                sizes.append(len(ids))
                points.append(grid_point(ids, directions))
                packed.append((b"\2" + ids.astype("<u2").tobytes()) if len(directions) <= 1 << 16 else b"\4" + ids.astype("<u4").tobytes())
            yield pa.record_batch([part.column(0), pa.array(hilbert_key(np.array(points)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], schema=_KEYED)

    return run


_PIECES = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "slot", "offset", "curve")])
_PIECES_DDL = ", ".join(f"{f.name} long" for f in _PIECES)


def tail_sizes(left: int) -> list[int]:
    """Powers of two that add up to ``left``, largest first."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def _pack(length: int):
    """Lay one range's documents end to end; needs only the current position, and the last open sequence's pieces."""

    def emit(rows):
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PIECES)

    def run(batches):
        slot, used, done, open_rows = 0, 0, [], []
        for batch in batches:
            for doc_id, curve, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = packed[1:] if packed[:1] == b"\4" else np.frombuffer(packed, "<u2", offset=1).astype("<u4").tobytes()
                total, start = len(raw) // 4, 0
                while start < total:
                    take = min(total - start, length - used)
                    open_rows.append((doc_id, start, take, raw[4 * start : 4 * (start + take)], total, curve))
                    start, used = start + take, used + take
                    if used == length:
                        at = 0
                        for d, s, n, piece, t, c in open_rows:
                            done.append((d, s, n, zlib.crc32(piece), t, slot, at, c))
                            at += n
                        slot, used, open_rows = slot + 1, 0, []
                        if len(done) >= 8192:
                            yield emit(done)
                            done = []
        sizes = tail_sizes(used)
        room, at = (sizes.pop(0) if sizes else 0), 0
        for d, s, n, piece, t, c in open_rows:
            cut = 0
            while cut < n:
                take = min(n - cut, room - at)
                done.append((d, s + cut, take, zlib.crc32(piece[4 * cut : 4 * (cut + take)]), t, slot, at, c))
                cut, at = cut + take, at + take
                if at == room:
                    slot, at, room = slot + 1, 0, sizes.pop(0) if sizes else 0
        if done:
            yield emit(done)

    return run


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve.

    Ids are made once and kept in the shared folder, since a range sort reads its input twice; they take two bytes
    each where the vocabulary allows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = materialize(rows.mapInArrow(_encode(vocabulary or default_vocabulary(), end_id), "doc_id long, curve long, n long, ids binary"), "pack-ids")
    total = keyed.agg(F.sum("n")).first()[0] or 0
    order = ("curve", F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids"))
    ranged = keyed.select("doc_id", "curve", "ids").repartitionByRange(max(shuffle_width(spark), -(-total // RANGE_IDS)), *order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(_pack(length), _PIECES_DDL)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.spark_partition_id().cast("long") * F.lit(1 << 40) + F.col("slot")).alias("sequence_id"), "offset", "curve",
    )
