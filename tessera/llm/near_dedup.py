"""MinHash near-dedup by a signature-coordinate inverted join, every link confirmed on full shingle sets.

1. Each document gets its set of five-word shingles, 64 MinHash coordinates and a fingerprint of the set. Documents
   of one set form a class; the smallest doc_id stands for it, so copies cost nothing further.
2. A representative is posted under its first 32 (coordinate, value) pairs. Pairs are ordered from rare to common.
   Two documents that agree in at least ``MATCH`` of 32 share one of each other's ``32 - MATCH + 1`` rarest pairs
   (prefix), so only those are posted, and common pairs, which passages of many documents make, are skipped.
   Pairs that one document holds are no postings at all.
3. No list emits all its pairs. Its pivot, the document with the commonest pairs, is compared with each member
   (star), and what the pivot teaches rules out or finds the other pairs, exactly:
   * both at a distance of at most NEAR from the pivot: members the pivot links are joined through it. Any other
     linked pair differs from the pivot in common shingles (else the sum of their differences would exceed what a
     link allows), so the differences of the members are posted again, rarest first, with prefix lengths by which
     a link cannot be missed (delta).
   * otherwise both are further than FAR = NEAR - 0.15 (the triangle inequality of Jaccard distance): they stay in
     the list (residue), marked if near the pivot: two marked ones were compared in delta. A document with more than
     15 % of its shingles in no other residual document can have no link and leaves, and so does a list of marked
     ones only. Lists take further pivots, unmarked ones first, until what is left has no more pairs than there are
     documents, so pairs grow with the input and not with the square of a list. Those are compared by 64 coordinates, each pair in one list only, and pairs above the threshold are confirmed.
4. Links are contracted to components by repeated hops to the least neighbour in an order drawn anew each round.

A pair at the limit 0.85 agrees in fewer than MATCH of 32 coordinates with a probability of 3.5e-6, and in fewer than
MATCH_ALL of 64 with 1e-6; everything else is exact.

Defined cases: null or wordless text has an empty set and links with nothing; fewer than five words are one shingle;
a null doc_id joins its class but is never its representative; rows of one doc_id are one node; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize, spread_join
from tessera.llm.words import mix64, shingle_set, slices, split_words, word_hashes
from tessera.operators.topology import connected_components

WIDTH = 5
#: A link: LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 85)
COORDINATES, POSTED = 64, 32
MATCH, MATCH_ALL = 17, 38
#: Percent of Jaccard similarity: near a pivot from NEAR on, in the residue below FAR; FAR = NEAR + (100 - 85).
NEAR, FAR = 60, 75
#: Of 64 coordinates, how many a document near the pivot shows but with a probability of 1e-7.
NEAR_MATCH = 18
#: What pivots leave open is compared in pairs when these are so few for each document, or after MOST_TURNS pivots a
#: list (as many as there are bits to mark them).
PAIRS_A_DOC, MOST_TURNS = 1, 60
#: Places of the sieve that spares texts a move: a bound on what is broadcast, 16 MB.
SIEVE = 1 << 20
_BYTES = [f"b{k}" for k in range(COORDINATES // 8)]

_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix64(_SEEDS + np.uint64(77)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (64 bits) of a non-empty set."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = (shingles[None, at : at + 1024] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return mix64(low ^ _SEEDS)


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("tokens", pa.list_(pa.int64()))] + [(b, pa.int64()) for b in _BYTES]
)
_SIGNED_DDL = "doc_id long, n_shingles long, set_hi long, set_lo long, tokens array<long>, " + ", ".join(f"{b} long" for b in _BYTES)


def _sign(width: int):
    def run(batches):
        for batch in slices(batches):
            n, sets, tokens, folded = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(word_hashes(split_words(text)), width)
                n.append(len(shingles))
                sets.append(xxhash.xxh3_128_intdigest(shingles.tobytes()))
                sig = signature(shingles) if len(shingles) else np.zeros(COORDINATES, np.uint64)
                tokens.append(sig[:POSTED].view(np.int64) if len(shingles) else [])
                folded.append((sig & np.uint64(0xFF)).astype(np.uint8).view("<i8"))
            folds = np.array(folded, np.int64).reshape(len(n), len(_BYTES))
            hi = np.array([s >> 64 for s in sets], np.uint64).view(np.int64)
            lo = np.array([s & 0xFFFFFFFFFFFFFFFF for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(hi), pa.array(lo), pa.array(tokens, pa.list_(pa.int64())), *(pa.array(folds[:, k]) for k in range(len(_BYTES)))], schema=_SIGNED)

    return run


def _shingle_rows(width: int):
    def run(batches):
        for part in slices(batches, 256):
            sets = [shingle_set(word_hashes(split_words(t)), width).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def matches(a: str, b: str) -> Column:
    """Equal bytes of two folded signatures whose columns have the prefixes ``a`` and ``b``: a byte of the
    difference is folded to its lowest bit, and the set bits are counted."""
    differ = None
    for name in _BYTES:
        v = F.col(a + name).bitwiseXOR(F.col(b + name))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
        differ = F.bit_count(v) if differ is None else differ + F.bit_count(v)
    return F.lit(COORDINATES) - differ


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes that a similarity of ``percent`` allows."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Scratch:
    """Intermediate tables of one run, deleted at its end."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(materialize(df, label))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables.clear()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...; a written table) with both shingle arrays. A document of very many pairs, as a pivot is,
    meets them in as many parts as they ask for."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return spread_join(pairs, left, ["a"], ["b"], pairs.count()).join(right, "b")


def _similarity(df: DataFrame) -> DataFrame:
    df = df.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return df.withColumn("either", F.size("set_a") + F.size("set_b") - F.col("common"))


def _linked() -> Column:
    return LINK[0] * F.col("common") >= LINK[1] * F.col("either")


def _postings(reps: DataFrame) -> DataFrame:
    """token, doc_id, weight, n_shingles and folded signature for each pair in a document's prefix that others hold too."""
    held = reps.select("doc_id", F.explode("tokens").alias("token"))
    shared = held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    known = held.join(shared, "token")
    mine = Window.partitionBy("doc_id")
    ranked = known.select(
        "doc_id", "token",
        F.row_number().over(mine.orderBy("n", "token")).alias("rank"),
        F.count("*").over(mine).alias("held"),
        F.sum("n").over(mine).alias("weight"),
    )
    # pairs of one document come first in the order: the prefix has room for the others' first held - MATCH + 1
    prefix = ranked.where(F.col("rank") <= F.col("held") - (MATCH - 1)).select("doc_id", "token", "weight")
    return prefix.join(reps.select("doc_id", "n_shingles", *_BYTES), "doc_id")


def _lists(postings: DataFrame) -> DataFrame:
    """The pivot of each list of two or more: a document near no pivot so far, the heaviest, then the smallest."""
    best = F.max(F.struct(F.expr("near = 0").alias("new"), "weight", (-F.col("doc_id")).alias("neg"), "n_shingles", *_BYTES)).alias("p")
    lists = postings.groupBy("token").agg(best, F.count("*").alias("size")).where("size > 1")
    return lists.select("token", (-F.col("p.neg")).alias("pivot"), F.col("p.n_shingles").alias("p_n"), *(F.col(f"p.{b}").alias(f"p_{b}") for b in _BYTES))


def _near(postings: DataFrame, lists: DataFrame, sets: DataFrame, scratch: _Scratch) -> DataFrame:
    """Pivots (a) and the members of their lists (b) that are near them."""
    star = spread_join(postings, lists, ["token"], ["doc_id"], postings.count()).where((F.col("doc_id") != F.col("pivot")) & _alike("n_shingles", "p_n", NEAR) & (matches("", "p_") >= NEAR_MATCH))
    star = star.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = _similarity(_with_sets(scratch.keep(star, "star"), sets)).withColumn("linked", _linked())
    return near.where(100 * F.col("common") >= NEAR * F.col("either")).select("a", "b", "linked", "common", "either")


def _delta_links(near: DataFrame, sets: DataFrame, scratch: _Scratch) -> DataFrame:
    """Links among documents near one pivot of which at least one is not linked to it.

    A member's difference is its symmetric difference from the pivot. For a link, two sets of a and b shingles may
    differ in at most 15 (a + b) / 185, so differences of sizes x <= y share at least half of x + y less that. The
    smaller posts a prefix for partners no smaller, the larger one for partners no smaller than a link allows.
    """
    outside = near.where(~F.col("linked")).select("a").distinct()
    rows = _with_sets(scratch.keep(near.join(outside, "a", "left_semi"), "outside"), sets)
    rows = rows.withColumn("delta", F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a")))
    rows = rows.select("a", "b", "linked", F.size("set_b").alias("n"), F.size("set_a").alias("n_p"), "delta").withColumn("d", F.size("delta"))
    held = scratch.keep(rows.select("a", "b", "linked", "n", "n_p", "d", F.explode("delta").alias("e")), "delta")
    shared = held.groupBy("a", "e").agg(F.count("*").alias("uses")).where("uses > 1")
    mine = Window.partitionBy("a", "b")
    known = held.join(shared, ["a", "e"])
    ranked = known.select("*", F.row_number().over(mine.orderBy("uses", "e")).alias("r"), F.count("*").over(mine).alias("kept"))
    most = F.floor(3 * F.col("n") / 17)  # 15 (n + 20 n / 17) / 185: what a link of this set may differ in
    # a linked member's partner is outside, and so differs from the pivot in more than a link allows
    least_partner = F.when(F.col("linked"), F.floor(15 * (F.lit(0.85) * F.col("n") + F.col("n_p")) / 185)).otherwise(F.col("d"))
    overlap = F.greatest(F.lit(1), F.ceil((F.col("d") + F.greatest("d", least_partner) - most) / 2))
    ranked = ranked.withColumn("place", F.col("d") - F.col("kept") + F.col("r"))
    short = ranked.where(F.col("place") <= F.col("d") - overlap + 1)
    long = ranked.where(F.col("place") <= F.least("d", most + 1))
    x = short.select("a", "e", F.col("b").alias("x"), F.col("d").alias("x_d"), F.col("linked").alias("x_linked"))
    y = long.select("a", "e", F.col("b").alias("y"), F.col("d").alias("y_d"), F.col("linked").alias("y_linked"))
    ordered = (F.col("x_d") < F.col("y_d")) | ((F.col("x_d") == F.col("y_d")) & (F.col("x") < F.col("y")))
    pairs = x.join(y, ["a", "e"]).where(ordered & ~(F.col("x_linked") & F.col("y_linked")))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _similarity(_with_sets(scratch.keep(pairs, "pairs"), sets)).where(_linked()).select("a", "b")


def _residue(postings: DataFrame, lists: DataFrame, near: DataFrame, sets: DataFrame, turn: int, scratch: _Scratch) -> DataFrame:
    """Postings that the pivots of this turn do not settle; bit ``turn`` of ``near`` marks documents near theirs."""
    seen = near.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), (100 * F.col("common") >= FAR * F.col("either")).alias("settled"))
    rest = spread_join(postings, lists.select("token", "pivot"), ["token"], ["doc_id"], postings.count()).where("doc_id <> pivot").join(seen, ["pivot", "doc_id"], "left")
    rest = rest.where(~F.coalesce("settled", F.lit(False))).withColumn("near", F.col("near").bitwiseOR(F.when(F.col("settled").isNotNull(), F.lit(1 << turn).cast("long")).otherwise(F.lit(0).cast("long"))))
    rest = scratch.keep(_shared(rest.drop("pivot", "settled")), "residue")
    docs = rest.select("doc_id").distinct()
    held = sets.join(docs, "doc_id", "left_semi").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("e"))
    alone = held.groupBy("e").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other"), F.min("n").alias("n")).where("doc_id = other")
    closed = alone.groupBy("doc_id").agg(F.count("*").alias("own"), F.min("n").alias("n")).where(LINK[0] * F.col("own") > (LINK[0] - LINK[1]) * F.col("n"))
    return scratch.keep(_shared(rest.join(closed, "doc_id", "left_anti")), "residue")


def _residual_links(rest: DataFrame, sets: DataFrame, scratch: _Scratch) -> DataFrame:
    """Links between residual documents of one list that were near no pivot in common. The first list that two
    documents share reports them."""
    rest = rest.join(rest.groupBy("doc_id").agg(F.collect_set("token").alias("tokens")), "doc_id")
    columns = ("doc_id", "n_shingles", "near", "tokens", *_BYTES)
    x = rest.select("token", *(F.col(c).alias(f"x_{c}") for c in columns))
    y = rest.select("token", *(F.col(c).alias(f"y_{c}") for c in columns))
    unseen = F.col("x_near").bitwiseAND(F.col("y_near")) == 0
    likely = unseen & _alike("x_n_shingles", "y_n_shingles", LINK[1]) & (matches("x_", "y_") >= MATCH_ALL)
    first = F.array_min(F.array_intersect("x_tokens", "y_tokens")) == x["token"]
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("x_doc_id") < F.col("y_doc_id")) & likely & first)
    pairs = scratch.keep(pairs.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct(), "pairs")
    return _similarity(_with_sets(pairs, sets)).where(_linked()).select("a", "b")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings whose list has two documents or more that were not all near one pivot."""
    lists = postings.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_and("near").alias("all_near")).where("lo < hi and all_near = 0").select("token")
    return postings.join(lists, "token", "left_semi")


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not ``wanted``, before their texts are moved: ids are hashed to
    SIEVE places, and at most so many, those that are taken, are broadcast."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).alias("_place")
    taken = wanted.select(place).distinct()
    return docs.select("*", place).join(F.broadcast(taken), "_place", "left_semi").drop("_place")


def find_links(docs: DataFrame, reps: DataFrame, n_docs: int, width: int = WIDTH) -> DataFrame:
    """Linked pairs (a, b) of representatives that hold every component together."""
    scratch = _Scratch()
    postings = scratch.keep(_shared(_postings(reps).withColumn("near", F.lit(0).cast("long"))), "postings")
    wanted = postings.select("doc_id").distinct()
    texts = _likely(docs, wanted).join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    sets = scratch.keep(texts.mapInArrow(_shingle_rows(width), "doc_id long, shingles array<long>"), "shingles")
    links, rest = [], postings
    for turn in range(MOST_TURNS):
        lists = scratch.keep(_lists(rest), "lists")
        near = scratch.keep(_near(rest, lists, sets, scratch), "near")
        links += [near.where("linked").select("a", "b"), _delta_links(near, sets, scratch)]
        rest = _residue(rest, lists, near, sets, turn, scratch)
        pairs = rest.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
        if pairs <= PAIRS_A_DOC * n_docs:
            break
    links.append(_residual_links(rest, sets, scratch))
    out = materialize(reduce(DataFrame.union, links).distinct(), "links")
    scratch.clear()
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(docs.mapInArrow(_sign(width), _SIGNED_DDL), "signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = signed.where("n_shingles > 0").join(classes, [signed["doc_id"] == classes["rep"], signed["set_hi"] == classes["set_hi"], signed["set_lo"] == classes["set_lo"]], "left_semi")
    links = find_links(docs, reps, signed.count(), width)
    labels = materialize(connected_components(links), "labels")
    discard(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("set_hi", "set_lo", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "set_hi", "set_lo").join(named, ["set_hi", "set_lo", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; columns as they are.

    Of rows of the kept doc_id that have the same text one stays; rows of one doc_id with other texts are one node, and
    all stay if it does. Wordless rows and rows without id are no near-duplicates of anything and stay.
    """
    found = near_duplicates(docs, width)
    gone = materialize(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "gone")
    # the row in one struct, so that no name of its columns meets ours
    own = F.col("row.doc_id").cast("long")
    rest = docs.select(F.struct("*").alias("row")).join(gone, own == gone["id"], "left_anti")
    again = rest.groupBy(own.alias("id")).agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id")
    again = materialize(again, "repeated")
    once = rest.join(again, own == again["id"], "left_anti")
    repeated = rest.join(again, own == again["id"], "left_semi").groupBy(own.alias("id"), F.col("row.text").cast("string").alias("words")).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
