"""Half-edges, pairing, manifold checks and connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import discard, materialize, spread_join

#: Links that a worker contracts at a time, and about so many vertices of a solid go to one task for it.
LINKS, VERTS = 1 << 18, 1 << 16
#: Rows of one solid that a worker holds while it gives its vertices new numbers.
HELD_ROWS = 1 << 17


def halfedges(tris: DataFrame) -> DataFrame:
    """mesh_id, he (3 tri + side), start_v, end_v."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("s"), F.col(f"v{(k + 1) % 3}").alias("e")) for k in range(3)))
    df = tris.select("mesh_id", "tri", F.explode(sides).alias("h"))
    return df.select("mesh_id", (3 * F.col("tri") + F.col("h.k")).alias("he"), F.col("h.s").alias("start_v"), F.col("h.e").alias("end_v"))


def paired(edges: DataFrame) -> DataFrame:
    """``edges`` with ``paired``: the half-edge that runs the other way; the i-th of equal ones with the i-th, null if
    open. Both directions of an edge meet by one move; ranks and partners are found where they meet."""
    df = edges.withColumns({"lo": F.least("start_v", "end_v"), "hi": F.greatest("start_v", "end_v"), "forward": F.col("start_v") < F.col("end_v")})
    df = df.repartition("mesh_id", "lo", "hi")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("mesh_id", "lo", "hi", "forward").orderBy("he")))
    mates = Window.partitionBy("mesh_id", "lo", "hi", "rank")
    other = F.when(F.col("forward"), F.max(F.when(~F.col("forward"), F.col("he"))).over(mates)).otherwise(F.max(F.when(F.col("forward"), F.col("he"))).over(mates))
    return df.withColumn("paired", other).select("mesh_id", "he", "start_v", "end_v", "paired")


def undirected(edges: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, how many half-edges run forward and backward, and the least forward one (or the least)."""
    forward = F.col("start_v") < F.col("end_v")
    return edges.groupBy("mesh_id", F.least("start_v", "end_v").alias("lo"), F.greatest("start_v", "end_v").alias("hi")).agg(
        F.count_if(forward).alias("forward"), F.count_if(~forward).alias("backward"), F.coalesce(F.min(F.when(forward, F.col("he"))), F.min("he")).alias("he")
    )


def manifold_check(tris: DataFrame) -> DataFrame:
    """mesh_id, n_halfedge, n_open, n_duplicate, is_manifold, is_2_manifold: one grouping by edge, partial counts first."""
    more = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    df = undirected(halfedges(tris)).groupBy("mesh_id").agg(
        F.sum(F.col("forward") + F.col("backward")).alias("n_halfedge"), F.sum(F.abs(F.col("forward") - F.col("backward"))).alias("n_open"), F.sum(more("forward") + more("backward")).alias("n_duplicate")
    )
    return df.withColumn("is_manifold", F.col("n_open") == 0).withColumn("is_2_manifold", (F.col("n_open") == 0) & (F.col("n_duplicate") == 0))


def open_edges(tris: DataFrame) -> DataFrame:
    """Half-edges that pairing leaves alone."""
    return paired(halfedges(tris)).where("paired is null").drop("paired")


def without_opposed(tris: DataFrame) -> DataFrame:
    """``tris`` without triangles that have the same corners as another, the other way round: the i-th of either way
    go together."""
    key = F.array_sort(F.array("v0", "v1", "v2"))
    low = F.least("v0", "v1", "v2")
    after = F.when(F.col("v0") == low, F.col("v1")).when(F.col("v1") == low, F.col("v2")).otherwise(F.col("v0"))
    df = tris.withColumns({"_key": key, "_way": after == key[1]})
    sides = Window.partitionBy("mesh_id", "_key")
    df = df.withColumn("_rank", F.row_number().over(Window.partitionBy("mesh_id", "_key", "_way").orderBy("tri")))
    df = df.withColumns({"_on": F.count_if(F.col("_way")).over(sides), "_against": F.count_if(~F.col("_way")).over(sides)})
    return df.where(F.col("_rank") > F.least("_on", "_against")).select(*tris.columns)


def orbits(tris: DataFrame) -> DataFrame:
    """mesh_id, vert, he, next: from each half-edge that leaves a vertex the next one that leaves it, across the edge."""
    edges = paired(halfedges(tris)).where("paired is not null")
    return edges.select("mesh_id", F.col("start_v").alias("vert"), "he", F.when(F.col("paired") % 3 == 2, F.col("paired") - 2).otherwise(F.col("paired") + 1).alias("next"))


def edge_predicates(tris: DataFrame, epsilon: float) -> DataFrame:
    """mesh_id, he, is_forward, is_short (shorter than ``epsilon``), is_paired (its partner runs the other way), of every
    half-edge."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), sum(((F.col(p + c) - F.col(q + c)) * (F.col(p + c) - F.col(q + c)) for c in "xyz"), F.lit(0.0)).alias("d")) for k, (p, q) in enumerate(("ab", "bc", "ca"))))
    size = tris.select("mesh_id", "tri", F.explode(sides).alias("h")).select("mesh_id", (3 * F.col("tri") + F.col("h.k")).alias("he"), F.col("h.d").alias("d"))
    flags = paired(halfedges(tris)).select("mesh_id", "he", (F.col("start_v") < F.col("end_v")).alias("is_forward"), F.col("paired").isNotNull().alias("is_paired"))
    return flags.hint("merge").join(size, ["mesh_id", "he"]).select("mesh_id", "he", "is_forward", (F.col("d") < epsilon * epsilon).alias("is_short"), "is_paired")


def dense(groups: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The rank of each number (n, 3) among the different ones of its group; ``groups`` (n) ascend."""
    flat, of = old.reshape(-1), np.repeat(groups, 3)
    order = np.lexsort((flat, of))
    flat, of = flat[order], of[order]
    first = np.r_[True, of[1:] != of[:-1]]
    rank = np.cumsum(np.r_[True, (flat[1:] != flat[:-1]) | first[1:]])
    out = np.empty(len(rank), np.int64)
    out[order] = rank - rank[first][np.cumsum(first) - 1]
    return out.reshape(-1, 3)


def _renumbered(names: list[str]):
    """Batches sorted by mesh_id with dense numbers. Of a solid that goes on over more than HELD_ROWS rows, only the
    different numbers are held; its rows wait in a file of the task."""
    corners = ["v0", "v1", "v2"]

    def numbers(rows: pa.Table) -> np.ndarray:
        return np.column_stack([rows.column(c).cast(pa.int64()).to_numpy() for c in corners])

    def keys(rows) -> np.ndarray:
        at = rows.column(names.index("mesh_id"))
        code = at.dictionary_encode(null_encoding="encode")
        return code.indices.to_numpy()

    def put(rows: pa.Table, new: np.ndarray) -> list[pa.RecordBatch]:
        for k, c in enumerate(corners):
            rows = rows.set_column(names.index(c), c, pa.array(np.ascontiguousarray(new[:, k])))
        return rows.combine_chunks().to_batches()

    def run(batches):
        open_rows, spooled, writer, known = [], None, None, None

        def spool(rows: pa.Table):
            nonlocal spooled, writer, known
            if spooled is None:
                spooled, known = tempfile.TemporaryFile(), np.empty(0, np.int64)
                writer = pa.ipc.new_stream(spooled, rows.schema)
            known = np.union1d(known, numbers(rows))
            writer.write_table(rows)

        def done():
            """The open solid, which has come to its end."""
            nonlocal spooled, known
            if spooled is not None:
                if open_rows:
                    spool(pa.Table.from_batches(open_rows))
                writer.close()
                spooled.seek(0)
                for batch in pa.ipc.open_stream(spooled):
                    rows = pa.Table.from_batches([batch])
                    yield from put(rows, np.searchsorted(known, numbers(rows)))
                spooled.close()
                spooled = known = None
            elif open_rows:
                rows = pa.Table.from_batches(open_rows)
                yield from put(rows, dense(np.zeros(rows.num_rows, np.int64), numbers(rows)))
            open_rows.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = keys(batch)
            starts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
            key = batch.column(names.index("mesh_id"))
            goes_on = last is not None and key[0].as_py() == last[0]
            if not goes_on:
                yield from done()
            if len(starts) > 1:
                lo = 0
                if open_rows or spooled is not None:
                    lo = int(starts[1])
                    open_rows.append(batch.slice(0, lo))
                    yield from done()
                hi = int(starts[-1])
                if hi > lo:
                    rows = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                    yield from put(rows, dense(np.cumsum(np.r_[0, code[lo + 1 : hi] != code[lo : hi - 1]]), numbers(rows)))
                batch = batch.slice(hi)
            open_rows.append(batch)
            if sum(b.num_rows for b in open_rows) > HELD_ROWS:
                spool(pa.Table.from_batches(open_rows))
                open_rows.clear()
            last = (key[len(key) - 1].as_py(),)
        yield from done()

    return run


def renumber(tris: DataFrame) -> DataFrame:
    """``tris`` with vertices numbered from 0 in the order of their old numbers, those not used left out.

    Numbers are ranks within a solid, found where its triangles lie after one move: the numbers in use of one solid must
    fit a worker, its triangles need not. Triangles with a null number are left out; null is a mesh_id too.
    """
    long = T.LongType()
    schema = T.StructType([T.StructField(f.name, long if f.name in ("v0", "v1", "v2") else f.dataType) for f in tris.schema])
    rows = tris.where("v0 is not null and v1 is not null and v2 is not null").repartition("mesh_id").sortWithinPartitions("mesh_id")
    return rows.mapInArrow(_renumbered(tris.columns), schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of an edge list (a, b).

    Every round each node hops to that of its neighbours and itself which is least in the order of a hash, and links are
    drawn between what is left. In that order about half of the nodes of a path go each round, however they are
    numbered, and all leaves of a star, so rounds grow with the logarithm of the number of nodes. Hubs are split where
    labels follow the hops.

    Edges with a null end, and their other end, are left out; repeated edges and loops are no matter (a node with only
    a loop is its own component); no edges give no rows; other columns are not read.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    live = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    hops = []
    while size := live.count():
        mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        both = live.select(F.col("a").alias("at"), mark("b").alias("other")).union(live.select("b", mark("a")))
        least = both.groupBy("at").agg(F.min("other").alias("m"))
        hop = materialize(least.select("at", F.least("m", mark("at"))["id"].alias("to")), "hop")
        hops.append(hop)
        moved = live
        for end, to in (("a", "p"), ("b", "q")):
            other = "b" if end == "a" else "p"
            moved = spread_join(moved, hop.select(F.col("at").alias(end), F.col("to").alias(to)), [end], [other], size).drop(end)
        moved = moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        after = materialize(moved, "edges")
        discard(live)
        live = after
    # from the last round back: where a node ends is where the node it hopped to ends
    ends = None
    for hop in reversed(hops):
        if ends is None:
            found = hop.select("at", F.col("to").alias("end"))
        else:
            found = spread_join(hop, ends.select(F.col("at").alias("to"), "end"), ["to"], ["at"], hop.count(), "left").select("at", F.coalesce("end", "to").alias("end"))
        found = materialize(found, "ends")
        discard(hop, *([ends] if ends is not None else []))
        ends = found
    discard(live)
    if ends is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = materialize(ends.groupBy("end").agg(F.least(F.min("at"), F.col("end")).alias("component")), "least")
    named = spread_join(ends, least, ["end"], ["at"], ends.count()).select(F.col("at").alias("node"), "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links once, and the least node that they connect it with: greater roots hang themselves onto
    lesser neighbours until none are left, which at least halves the roots that still have links each time."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        live = p != q
        if not live.any():
            return nodes, nodes[root]
        x, y, p, q = x[live], y[live], p[live], q[live]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def near_components(edges: DataFrame) -> DataFrame:
    """``connected_components`` of links (a, b: long) of which most neighbours lie side by side, as those of a solid do.

    Workers contract each run of links where it lies to one row a node, with the least node it is connected with; a node
    that several runs hold links their least nodes. Only these links, none where no solid is cut, take rounds.
    ``edges`` are read once.
    """

    def run(batches):
        def rows():
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in least_linked(a, b)], names=["node", "root"])

        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= LINKS:
                yield rows()
                held = []
        if sum(x.num_rows for x in held):
            yield rows()

    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    ordered = Window.partitionBy("node").orderBy("root")
    stars = links.mapInArrow(run, "node long, root long").select("node", "root", F.first("root").over(ordered).alias("least"), F.row_number().over(ordered).alias("place"))
    stars = materialize(stars, "stars")
    nodes, between = stars.where("place = 1"), stars.where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
    if between.isEmpty():
        return nodes.select("node", F.col("least").alias("component"))
    ends = connected_components(between).withColumnRenamed("node", "least")
    return spread_join(nodes.select("node", "least"), ends, ["least"], ["node"], nodes.count(), "left").select("node", F.coalesce("component", "least").alias("component"))


# ---- faces: flat regions, given as (mesh_id, tri, face)


def _faced(tris: DataFrame, faces: DataFrame) -> DataFrame:
    """Numbers of triangles with their face: joined before triangles are exploded, so a third of the rows meet."""
    return tris.select("mesh_id", "tri", "v0", "v1", "v2").hint("merge").join(faces, ["mesh_id", "tri"])


def _faced_sides(tris: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, how many half-edges and how many faces meet there, least and greatest face of every edge."""
    sides = F.array(*(F.struct(F.least(f"v{k}", f"v{(k + 1) % 3}").alias("lo"), F.greatest(f"v{k}", f"v{(k + 1) % 3}").alias("hi")) for k in range(3)))
    named = _faced(tris, faces).select("mesh_id", "face", F.explode(sides).alias("h")).select("mesh_id", "face", "h.lo", "h.hi")
    return named.groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"), F.min("face").alias("one"), F.max("face").alias("other"))


def face_sides(tris: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, face, n_tri, n_side (edges shared with other faces), is_flat_group (three triangles or more) of every face."""
    rim = _faced_sides(tris, faces).where("one <> other")
    sides = rim.select("mesh_id", F.explode(F.array("one", "other")).alias("face")).groupBy("mesh_id", "face").agg(F.count("*").alias("n_side"))
    n = faces.groupBy("mesh_id", "face").agg(F.count("*").alias("n_tri"))
    return n.hint("merge").join(sides, ["mesh_id", "face"], "left").select("mesh_id", "face", "n_tri", F.coalesce("n_side", F.lit(0)).cast("long").alias("n_side"), (F.col("n_tri") >= 3).alias("is_flat_group"))


def collapsible_starts(tris: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, vert, n_face of vertices that at most two faces surround, so that an edge may be drawn out of them."""
    corners = _faced(tris, faces).select("mesh_id", "face", F.explode(F.array("v0", "v1", "v2")).alias("vert"))
    return corners.groupBy("mesh_id", "vert").agg(F.count_distinct("face").alias("n_face")).where("n_face <= 2")


def unbroken_pieces(tris: DataFrame, crossed: DataFrame) -> DataFrame:
    """mesh_id, vert, piece: parts of a solid whose vertices edges hold together that are not ``crossed`` (mesh_id, he, of
    forward half-edges); the piece is named by a number of one of its vertices."""
    forward = halfedges(tris).where("start_v < end_v")
    whole = forward.hint("merge").join(crossed.select("mesh_id", "he").distinct(), ["mesh_id", "he"], "left_anti")
    key = lambda c: F.shiftleft(F.col("mesh_id").cast("long"), 31) + F.col(c)
    every = tris.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vert")).distinct().withColumn("node", key("vert"))
    # hashed by half-edge so far; the links of a solid are to lie side by side
    near = whole.repartition("mesh_id", F.floor(F.col("start_v") / VERTS)).sortWithinPartitions("mesh_id", "start_v")
    links = near.select(key("start_v").alias("a"), key("end_v").alias("b"))
    named = every.hint("merge").join(near_components(links), "node", "left")
    return named.select("mesh_id", "vert", F.coalesce("component", "node").bitwiseAND(F.lit((1 << 31) - 1)).alias("piece"))
