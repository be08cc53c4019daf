"""Content-addressed store of token ids.

Layout under one folder (all Parquet, so writes are committed or absent):

``chunks/``    hash (SHA-256 of the ids' bytes), n_ids, payload (zstd of the ids); each unique chunk once
``recipes/``   documents in ascending doc_id order: part, at (place in it), inner (ids before it there), doc_id, n_tokens, hashes, leaf
``manifest/``  one row a recipe part: part, n_docs, n_tokens, root; and the top Merkle root

Chunk bounds come from a rolling hash over the last 32 ids, so equal passages give equal chunks wherever
they stand. Reading verifies each chunk against its address, each recipe part against its Merkle root, and
joins chunk checksums by recipe; ``read_ids`` gives the ids themselves.

Defined cases: null text is the end id alone; a null doc_id comes first; repeated rows are documents of
their own; an empty table gives an empty store; other columns are not read. ``start`` orders rows of one
doc_id by length and content.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.storage import fresh_path, remove_path, shuffle_width, spread_join
from tessera.llm.token_ids import default_vocabulary, text_encoder
from tessera.llm.words import mix64, slices

END_ID = 2
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
SLICE_ROWS = 512
#: Documents of a recipe part, about; the manifest has one row a part.
PART_DOCS = 1 << 20


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return mix64(np.arange(1, 1 << 17, dtype=np.uint64))


def chunk_bounds(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: where the rolling hash of the last 32 ids has its top
    MEAN_BITS zero, at least MIN_CHUNK and at most MAX_CHUNK ids apart."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _gear()[ids & 0x1FFFF if ids.dtype != np.uint16 else ids]
    for k in range(5):  # doubling: after step k the hash covers 2^(k+1) ids
        step = 1 << k
        h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint64(step))])
    at = np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + 1
    ends, last = [], 0
    for cut in at.tolist():
        while cut - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if cut - last >= MIN_CHUNK:
            ends.append(cut)
            last = cut
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


class MerkleTree:
    """Root of a binary hash tree over leaves that come one by one; leaves and nodes are hashed with different first
    bytes. Kept are the roots of whole subtrees, one a size; no leaves: hash of nothing."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == level:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        node = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = MerkleTree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _leaf(doc_id: int | None, n: int, hashes: list[bytes]) -> bytes:
    return hashlib.sha256(f"{doc_id}:{n}:".encode() + b"".join(hashes)).digest()


_STAGED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("hashes", pa.list_(pa.binary())),
        ("sizes", pa.list_(pa.int32())),
        ("payloads", pa.list_(pa.binary())),
        ("leaf", pa.binary()),
    ]
)
_STAGED_DDL = "doc_id long, n_tokens long, hashes array<binary>, sizes array<int>, payloads array<binary>, leaf binary"


def _stage(vocabulary: str, end_id: int, seen_most: int = 1 << 19):
    def run(batches):
        encoder, packer = text_encoder(vocabulary), zstandard.ZstdCompressor(level=3)
        end, seen = np.array([end_id], np.uint32), set()
        for part in slices(batches, SLICE_ROWS):
            out: list[list] = [[] for _ in _STAGED]
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_many(part.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                raw = ids.astype("<u4").tobytes()
                hashes, sizes, payloads, last = [], [], [], 0
                for stop in chunk_bounds(ids):
                    piece = raw[4 * last : 4 * stop]
                    address = hashlib.sha256(piece).digest()
                    hashes.append(address)
                    sizes.append(stop - last)
                    if address in seen:  # this task has sent it already
                        payloads.append(None)
                    else:
                        if len(seen) >= seen_most:
                            seen.clear()
                        seen.add(address)
                        payloads.append(encode_payload(ids[last:stop], packer))
                    last = stop
                for column, value in zip(out, (doc_id, len(ids), hashes, sizes, payloads, _leaf(doc_id, len(ids), hashes)), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _STAGED, strict=True)], schema=_STAGED)

    return run


def encode_payload(ids: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """Bytes an id (2 or 4), then the ids compressed."""
    width = 4 if int(ids.max()) > 0xFFFF else 2
    return bytes([width]) + packer.compress(ids.astype(f"<u{width}").tobytes())


def decode_payload(payload: bytes) -> bytes:
    """Ids of one chunk as ``<u4`` bytes."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[1:]), f"<u{payload[0]}").astype("<u4").tobytes()


def write_store(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the store to ``path``.

    Texts are encoded once. Only chunks move between executors, each task's own repeats left out,
    and each unique chunk is written by the one task its address belongs to.
    """
    spark = docs.sparkSession
    staged_path = fresh_path(spark, "token-stage")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(_stage(vocabulary or default_vocabulary(), end_id), _STAGED_DDL).write.parquet(staged_path)
    staged = spark.read.parquet(staged_path)

    pieces = staged.select(F.explode(F.arrays_zip("hashes", "sizes", "payloads")).alias("c")).where("c.payloads is not null")
    (
        pieces.select(F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n_ids"), F.col("c.payloads").alias("payload"))
        .groupBy("hash")
        .agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload"))
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/chunks")
    )
    parts = max(shuffle_width(spark), -(-staged.count() // PART_DOCS))
    order = (F.col("doc_id").asc_nulls_first(), "n_tokens", "leaf")
    recipes = staged.select("doc_id", "n_tokens", "hashes", "leaf").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    recipes.select(F.spark_partition_id().alias("part"), "*").mapInArrow(_place, _RECIPE_DDL).write.parquet(f"{path}/recipes")
    rows = _part_roots(spark.read.parquet(f"{path}/recipes")).orderBy("part").collect()  # one row a recipe part: a millionth of the documents
    top = merkle_root([bytes(r["root"]) for r in rows])
    listed = [(r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"]), top) for r in rows]
    spark.createDataFrame(listed, "part int, n_docs long, n_tokens long, root binary, top binary").coalesce(1).write.parquet(f"{path}/manifest")
    remove_path(spark, staged_path)


_RECIPE_DDL = "part int, at long, inner long, doc_id long, n_tokens long, hashes array<binary>, leaf binary"


def _place(batches):
    """Number one part's documents and sum up the ids before them; a task holds one part in order."""
    at = inner = 0
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        sums = np.cumsum(sizes)
        where, before = np.arange(at, at + len(sizes)), inner + sums - sizes
        yield pa.record_batch([batch.column(0), pa.array(where, pa.int64()), pa.array(before, pa.int64()), *batch.columns[1:]], names=["part", "at", "inner", "doc_id", "n_tokens", "hashes", "leaf"])
        at, inner = at + len(sizes), inner + int(sums[-1]) if len(sums) else inner


def _part_roots(recipes: DataFrame) -> DataFrame:
    """Merkle root of each recipe part, from its documents in their order, whose leaves, places and sums are verified
    on the way. Parts are dealt whole and read as a stream, so memory does not grow with them."""

    def roots(batches):
        part, tree, n_docs, n_tokens, done = None, MerkleTree(), 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[0] != part:
                    if n_docs:
                        done.append((part, n_docs, n_tokens, tree.root()))
                    part, tree, n_docs, n_tokens = row[0], MerkleTree(), 0, 0
                leaf = _leaf(row[3], row[4], row[5])
                if leaf != row[6] or (row[1], row[2]) != (n_docs, n_tokens):
                    raise ValueError("a recipe does not match its leaf or its place")
                tree.add(leaf)
                n_docs, n_tokens = n_docs + 1, n_tokens + row[4]
        if n_docs:
            done.append((part, n_docs, n_tokens, tree.root()))
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "n_docs", "n_tokens", "root"])

    rows = recipes.select("part", "at", "inner", "doc_id", "n_tokens", "hashes", "leaf").repartition("part").sortWithinPartitions("part", "at")
    return rows.mapInArrow(roots, "part int, n_docs long, n_tokens long, root binary")


def _chunk_sums(batches):
    """Address and checksum of each stored chunk, read and verified."""
    names = ["hash", "n_ids", "crc"]
    for part in slices(batches, SLICE_ROWS):
        hashes, sums = part.column(0).to_pylist(), []
        for address, n, payload in zip(hashes, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            raw = decode_payload(payload)
            if hashlib.sha256(raw).digest() != address or len(raw) != 4 * n:
                raise ValueError(f"chunk {address.hex()} does not match its address")
            sums.append(zlib.crc32(raw))
        yield pa.record_batch([pa.array(hashes, pa.binary()), part.column(1), pa.array(sums, pa.int64())], names=names)


_ZEROS = bytes(4 * MAX_CHUNK)


@lru_cache(maxsize=MAX_CHUNK + 1)
def _zeros_crc(size: int) -> int:
    return zlib.crc32(_ZEROS[:size])


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs; ``size`` is the second's, at most that of a chunk."""
    return zlib.crc32(memoryview(_ZEROS)[:size], first) ^ _zeros_crc(size) ^ second


def _document_sums(batches):
    """CRC of whole documents from those of their chunks in order."""
    for batch in batches:
        crcs = []
        for chunks in batch.column(3).to_pylist():
            crc = 0
            for k, c in enumerate(chunks):
                crc = join_crc(crc, c["crc"], 4 * c["n_ids"]) if k else c["crc"]
            crcs.append(crc)
        n = [sum(c["n_ids"] for c in chunks) for chunks in batch.column(3).to_pylist()]
        if n != batch.column(2).to_pylist():
            raise ValueError("a document is not as long as its recipe says")
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed_recipes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Recipes with ``start``, the ids of all documents before: those of the part, and the sums of the parts before,
    which are one row a part in the manifest. And how many chunks they use."""
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes")
    before = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"))
    used = recipes.agg(F.sum(F.size("hashes"))).first()[0] or 0
    return recipes.join(F.broadcast(before), "part").withColumn("start", F.col("inner") + F.col("base")), used


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Hold every recipe part, and the whole, against the manifest's Merkle roots."""
    stored = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()  # one row a part
    found = {r["part"]: bytes(r["root"]) for r in _part_roots(spark.read.parquet(f"{path}/recipes")).collect()}
    if found != {r["part"]: bytes(r["root"]) for r in stored} or any(merkle_root([found[k] for k in sorted(found)]) != bytes(r["top"]) for r in stored):
        raise ValueError("the recipes do not match the manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Every stored chunk is read and verified once; what then moves is its address and checksum.
    """
    verify_manifest(spark, path)
    sums = spark.read.parquet(f"{path}/chunks").select("hash", "n_ids", "payload").mapInArrow(_chunk_sums, "hash binary, n_ids int, crc long")
    placed, used = _placed_recipes(spark, path)
    uses = placed.select("part", "at", "doc_id", "start", "n_tokens", F.posexplode("hashes").alias("pos", "hash"))
    docs = (
        spread_join(uses, sums, ["hash"], ["part", "at", "pos"], used)
        .groupBy("part", "at", "doc_id", "start", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "n_ids", "crc"))).alias("chunks"))
        .select("doc_id", "start", "n_tokens", "chunks")
    )
    return docs.mapInArrow(_document_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id and the rebuilt ids (array of long) of all documents, or of those in ``doc_ids`` (one column, doc_id)."""
    uses, used = _placed_recipes(spark, path)
    if doc_ids is not None:
        uses = uses.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    uses = uses.select("part", "at", "doc_id", F.posexplode("hashes").alias("pos", "hash"))
    whole = spread_join(uses, spark.read.parquet(f"{path}/chunks"), ["hash"], ["part", "at", "pos"], used).groupBy("part", "at", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("chunks"))

    def rebuild(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(decode_payload(c["payload"]) for c in chunks), "<u4").astype(np.int64) for chunks in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return whole.select("doc_id", "chunks").mapInArrow(rebuild, "doc_id long, ids array<long>")
