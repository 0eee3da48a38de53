"""Exact Jaccard self-join of documents in the metric space of their shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tasks_for
from .components import components, local_components
from .counting import split_slices
from .voronoi import JaccardSpace, has_partner, settle
from .vectors import U64, chunks, long_column, mix, shingle_sets, text_bytes

#: Prefixes hold small hashes, so their slices come from another hash.
_SPREAD = U64(0xE7037ED1A0B428DB)


def _node(shingles: np.ndarray) -> np.uint64:
    """The fingerprint of a set; documents with equal sets are one node."""
    return mix(shingles.sum(dtype=U64, keepdims=True) + mix(shingles ^ U64(len(shingles))).sum(dtype=U64, keepdims=True))[0]


def _arrow(rows, names, types) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names)


# Texts: described, and each task's distinct sets packed to chunks of texts.


def _describe(k: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts, nodes, held, schema = set(), [], [], 0, None

        def pack():
            sink = pa.BufferOutputStream()
            table = pa.table({"text": pa.chunked_array(texts).combine_chunks()})
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            row = (None, None, None, None, uuid.uuid4().int >> 65, np.array(nodes, U64).tobytes(), sink.getvalue().to_pybytes())
            return _arrow([row], schema.names, schema.types)

        for batch in chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")), k)
            node = np.array([_node(s) if len(s) else 0 for s in sets], U64)
            size = np.array([len(s) for s in sets])
            empty = [pa.nulls(len(sets), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            out = pa.record_batch(
                [batch.column("doc_id"), batch.column("print"), long_column(size), long_column(node), *empty],
                ["doc_id", "print", "n_shingles", "node", "chunk", "nodes", "texts"],
            )
            schema = out.schema
            yield out
            new = []
            for i, x in enumerate(node.tolist()):
                if size[i] and x not in seen:
                    new.append(i)
                    seen.add(x)
            if len(seen) > 200_000:  # bounds memory; a repeat is harmless
                seen.clear()
            if new:
                some = batch.column("text").take(pa.array(new))
                texts.append(some)
                nodes += node[new].tolist()
                held += some.nbytes
            if held > most:
                yield pack()
                texts, nodes, held = [], [], 0
        if texts:
            yield pack()

    return run


def _text_sets(row: dict, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes and sets of a chunk of texts."""
    table = pa.ipc.open_stream(row["texts"]).read_all()
    sets = [s for batch in chunks(iter(table.to_batches())) for s in shingle_sets(*text_bytes(batch.column("text")), k)]
    return np.frombuffer(row["nodes"], U64), sets


def _live_sets(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes and sets of a chunk of live sets."""
    sizes = np.frombuffer(row["sizes"], np.uint32)
    return np.frombuffer(row["nodes"], U64), np.split(np.frombuffer(row["sets"], U64), np.cumsum(sizes, dtype=np.int64)[:-1])


# An exchange of frequencies: chunks ask the owners of hash slices, who answer each chunk.

_ASKED = "slice int, chunk long, low binary, n binary"
_ANSWERED = "chunk long, slice int, levels binary, node long"


def _asked(sets: list[np.ndarray], half: bool):
    """The shingles of a chunk in the order they are asked for, and where each of the sets' shingles is among them."""
    h = np.concatenate(sets)
    if half:
        h = h[h < U64(1 << 63)]
    return np.unique(h, return_inverse=True, return_counts=True)


def _ask(read, half: bool, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                h, _, n = _asked(read(row)[1], half)
                part, low = split_slices(h, slices)
                n = np.minimum(n, 255).astype(np.uint8)
                cut = np.searchsorted(part, np.arange(slices + 1))
                rows = [(int(s), row["chunk"], low[cut[s] : cut[s + 1]].tobytes(), n[cut[s] : cut[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(cut))]
                yield _arrow(rows, ["slice", "chunk", "low", "n"], (pa.int32(), pa.int64(), pa.binary(), pa.binary()))

    return run


def _answer(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For each shingle asked for, the number of bits of the number of sets that hold it: 1 where only one does."""
    read = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), t)
    u, back = np.unique(read("low", np.uint32), return_inverse=True)
    n = np.bincount(back, read("n", np.uint8), len(u))
    levels = np.frexp(n)[1].astype(np.uint8)[back]
    cut = np.cumsum([0, *(len(x.as_py()) // 4 for x in rows.column("low"))])
    found = [levels[a:b].tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table([rows.column("chunk"), rows.column("slice"), pa.array(found, pa.binary()), pa.nulls(len(found), pa.int64())], ["chunk", "slice", "levels", "node"])


def _levels(right: pa.Table) -> np.ndarray:
    right = right.filter(pc.is_valid(right.column("levels"))).sort_by("slice")
    return np.frombuffer(b"".join(x.as_py() for x in right.column("levels")), np.uint8)


def _survivors(k: int, percent: int):
    """The sets of a chunk that may link: their own shingles, held by no other set, are few enough.

    Frequencies are known for half of all shingles here, which settles texts
    that are wholly their own. Each node is returned by one chunk only.
    """

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            nodes, sets = _text_sets(row, k)
            _, back, _ = _asked(sets, True)
            own = np.zeros(len(back), np.int64)
            if len(back):
                own = (_levels(right)[back] == 1).astype(np.int64)
            mine = set(right.filter(pc.is_valid(right.column("node"))).column("node").to_numpy().view(U64).tolist())
            at, keep = 0, []
            for i, s in enumerate(sets):
                m = int(np.searchsorted(s, U64(1 << 63)))
                if int(nodes[i]) in mine and 100 * own[at : at + m].sum() <= (100 - percent) * len(s):
                    keep.append(i)
                at += m
            if keep:
                some = [sets[i] for i in keep]
                out.append((row["chunk"], nodes[keep].tobytes(), np.array([len(s) for s in some], np.uint32).tobytes(), np.concatenate(some).tobytes()))
        types = (pa.int64(), *[pa.binary()] * 3)
        return pa.Table.from_batches([_arrow(out, ["chunk", "nodes", "sizes", "sets"], types)])

    return run


def _owner_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, nodes in zip(batch.column("chunk").to_pylist(), batch.column("nodes")):
            node = np.frombuffer(nodes.as_py(), U64)
            yield pa.record_batch([long_column(node), long_column(np.full(len(node), chunk))], ["node", "chunk"])


# Prefixes: which sets may be near each other.

_PREFIX = "slice int, low binary, at binary, nodes binary, sizes binary, owns binary"


def _prefixes(percent: int, slices: int):
    """The first shingles of each set, rarest first, by slice; slice -1 lists the nodes.

    Sets of Jaccard percent / 100 or more share one of their first
    n - ceil(percent * n / 100) + 1 shingles in any order that all follow.
    """

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            nodes, sets = _live_sets(row)
            h, back, _ = _asked(sets, False)
            level = _levels(right)[back]
            n = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), n)
            own = np.bincount(owner, level == 1, len(sets)).astype(np.int64)
            live = 100 * own <= (100 - percent) * n
            order = np.lexsort((level, owner))  # stable: hashes rise within a level
            rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            take = n + percent * -n // 100 + 1
            use = (rank < take[owner]) & (level[order] > 1) & live[owner]
            order, owner = order[use], owner[use]
            part, low = split_slices(mix(h[back[order]] ^ _SPREAD), slices)
            by = np.argsort(part, kind="stable")
            low, owner = low[by], owner[by]
            cut = np.searchsorted(part[by], np.arange(slices + 1))
            for s in np.flatnonzero(np.diff(cut)):
                a, b = cut[s], cut[s + 1]
                used, at = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(s), low[a:b].tobytes(), at.astype(np.uint32).tobytes(), *(x[used].tobytes() for x in (nodes, n, own))))
            rows.append((-1, b"", b"", *(x[live].tobytes() for x in (nodes, n, own))))
        return pa.Table.from_batches([_arrow(rows, ["slice", "low", "at", "nodes", "sizes", "owns"], (pa.int32(), *[pa.binary()] * 5))])

    return run


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            columns = [np.frombuffer(row[c], np.int64) for c in ("nodes", "sizes", "owns")]
            yield pa.record_batch([pa.array(c) for c in columns], ["node", "n", "own"])


def _neighbours(percent: int, hot: int):
    """Edges (a, b) whose components hold all pairs that may link by a shingle of this slice."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = []
        for r in rows.to_pylist():
            at = np.frombuffer(r["at"], np.uint32)
            parts.append((np.frombuffer(r["low"], np.uint32), *(np.frombuffer(r[c], t)[at] for c, t in (("nodes", U64), ("sizes", np.int64), ("owns", np.int64)))))
        low, node, n, own = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(low, kind="stable")
        low, node, n, own = low[order], node[order], n[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        length = np.diff(np.concatenate([first, [len(low)]]))
        # x and y can link only if what each does not own reaches the overlap that their sizes need.
        slack = (100 + percent) * (n - own) - percent * n
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, hot + 1):
            at = first[length == m]
            for i in range(m):
                for j in range(i + 1, m):
                    x, y = at + i, at + j
                    near = (slack[x] >= percent * n[y]) & (slack[y] >= percent * n[x])
                    a.append(x[near])
                    b.append(y[near])
        for start, m in zip(first[length > hot], length[length > hot]):
            x = start + np.flatnonzero(has_partner(n[start : start + m], slack[start : start + m], percent))
            if len(x):
                a.append(np.full(len(x), x[0]))
                b.append(x)
        u, back = np.unique(node, return_inverse=True)
        label = local_components(back[np.concatenate(a)], back[np.concatenate(b)], len(u))
        moved = np.flatnonzero(label != np.arange(len(u)))
        return pa.table([long_column(u[label[moved]]), long_column(u[moved])], ["a", "b"])

    return run


# Clusters of candidates, settled in the metric space.


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            nodes, sets = _live_sets(row)
            for i in range(0, len(sets), 1000):
                yield pa.record_batch([long_column(nodes[i : i + 1000]), pa.array([s.tobytes() for s in sets[i : i + 1000]], pa.binary())], ["node", "set"])


def _settle(percent: int, leaf: int, pivots: int):
    """Rows (region, node, known, owns, set) sorted by region become links (a, b) that span each component.

    ``known`` is a component found before; nodes of one need no comparison.
    """

    def close(held):
        table = pa.Table.from_batches(held)
        node = table.column("node").to_numpy().view(U64)
        known = np.unique(table.column("known").to_numpy(), return_inverse=True)[1]
        label = settle([np.frombuffer(x.as_buffer(), U64) for x in table.column("set")], known, table.column("owns").to_numpy(), percent, leaf, pivots)
        first = np.full(len(node), len(node))
        np.minimum.at(first, label, np.arange(len(node)))
        return pa.record_batch([long_column(node[first[label]]), long_column(node)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, region = [], None
        for batch in batches:
            key = batch.column("region").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else []
            for x, y in zip(cuts, cuts[1:]):
                if held and key[x] != region:
                    yield close(held)
                    held = []
                held.append(batch.slice(x, y - x))
                region = key[x]
        if held:
            yield close(held)

    return run


def _measure(percent: int):
    """Distances of a share of a large region's members to all its pivots."""

    def run(key: tuple[pa.Scalar, ...], members: pa.Table, pivots: pa.Table) -> pa.Table:
        read = lambda t: [np.frombuffer(x.as_buffer(), U64) for c in t.column("set").chunks for x in c]
        pivots = pivots.sort_by("pivot")
        sets = read(members)
        space = JaccardSpace(sets)
        d = np.array([space.distances_from(p) for p in read(pivots)], np.float64).reshape(pivots.num_rows, -1).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
        names = pa.array([pivots.column("pivot").to_pylist()] * len(sets), pa.list_(pa.int64()))
        return pa.table([*(members.column(c) for c in ("region", "node", "n", "own", "owns")), names, lists], ["region", "node", "n", "own", "owns", "pivots", "d"])

    return run


def _merge(df: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by exchange and sort: neither side is small by rule, so none is broadcast."""
    return df.hint("merge").join(other, on, how)


def _split(members: DataFrame, sets: DataFrame, percent: int, pivots: int, task_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voronoi regions of large regions: the next members, the links of the pivots' balls, and their components.

    A region elects pivots, those that own the least of ``pivots`` random
    parts. Nodes within r of a pivot link to it. Each node is dealt to its
    nearest pivot, and as a guest to all whose distance is at most 2r larger:
    by the triangle inequality every link then lies in the region of either
    end. Regions where all nodes are of one component are done.
    """
    r, near = 1 - percent / 100, 1e-9
    rank = F.struct(F.col("own") / F.col("n"), F.xxhash64("node", "region"), F.col("node"))
    elected = members.groupBy("region", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("part")).agg(F.min(rank).alias("p"))
    elected = elected.select("region", F.col("p.node").alias("pivot"))
    shares = members.groupBy("region").agg(F.ceil(F.sum("n") * 8 / (task_bytes / 4)).cast("int").alias("shares"))
    rows = _merge(_merge(members, shares, "region"), sets, "node").withColumn("share", F.pmod(F.hash("node"), F.col("shares")))
    dealt = _merge(_merge(elected, shares, "region").withColumnRenamed("pivot", "node"), sets, "node")
    dealt = dealt.select("region", F.col("node").alias("pivot"), "set", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rows, dealt = (df.select([F.col(c).alias(c) for c in df.columns]) for df in (rows, dealt))  # both come from one table: new names
    measured = materialise(
        rows.groupBy("region", "share")
        .cogroup(dealt.groupBy("region", "share"))
        .applyInArrow(_measure(percent), "region long, node long, n long, own long, owns boolean, pivots array<long>, d array<double>"),
        "jac-measured",
    )
    pairs = measured.select("node", F.explode(F.arrays_zip("pivots", "d")).alias("p"))
    links = materialise(pairs.where((F.col("p.d") <= r + near) & (F.col("p.pivots") != F.col("node"))).select(F.col("p.pivots").alias("a"), F.col("node").alias("b")).distinct(), "jac-links")
    known = components(links)
    named = _merge(measured, known, "node", "left").withColumn("known", F.coalesce("label", F.col("node")))
    least = F.array_min("d")
    nearest = F.element_at("pivots", F.array_position("d", least).cast("int"))
    placed = named.select("*", least.alias("least"), nearest.alias("nearest"), F.explode(F.arrays_zip("pivots", "d")).alias("p")).where(F.col("p.d") <= F.col("least") + 2 * r + near)
    placed = placed.select(
        F.xxhash64("region", "p.pivots").alias("region"), "node", "n", "own", (F.col("owns") & (F.col("nearest") == F.col("p.pivots"))).alias("owns"), "known"
    )
    open_ = placed.groupBy("region").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.max("owns").alias("o")).where("x <> y and o").select("region")
    return materialise(_merge(placed, open_, "region", "left_semi"), "jac-members"), links, known


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    leaf: int = 32,
    hot: int = 16,
    rounds: int = 3,
    pivots: int = 16,
    task_bytes: int = 48 << 20,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id, print, n_shingles, component_id, class_size, stays for every input row.

    Documents are sets of k-word shingles under the Jaccard distance d = 1 - J,
    a metric; two link when J >= percent / 100, so r = 1 - percent / 100.

    1. Documents with equal sets become one node. Chunks of texts ask the
       owners of hash slices which shingles others hold too; a set that owns
       more than r of its shingles links with nothing, so most texts end here.
    2. For the others frequencies are exact. Two linked sets share one of
       their first r n + 1 shingles, rarest first; nodes that do, and whose
       shared parts are large enough, form clusters of candidates. At distance
       1, where nearly all pairs are, pivots say nothing: this bounds the
       space in which they are elected. Shingles with more than ``hot``
       holders join their holders by a star instead of by pairs.
    3. A cluster elects pivots far from each other; every node goes to the
       region of its nearest pivot, and as a guest to those up to 2r further
       (the triangle-inequality window). Nodes within r of a pivot are one
       component, and regions of one component are done; the others are split
       again, until at most ``leaf`` nodes lie outside the largest component.
       These are compared with the whole region.
    4. Clusters with more than ``task_bytes`` of sets are split in the same way
       by the cluster, each share of a region in a task of its own, until
       regions fit a task. Where windows would more than double a round's nodes,
       or after ``rounds``, blocks of a region are compared in pairs, each pair
       of blocks in one task.

    No link is lost: bounds only rule out pairs that can't link, and sizes of
    sets and intersections are exact. Shingles are 64-bit hashes.

    ``print`` is xxhash64(text), ``stays`` is true for the rows of the smallest
    (id, print) of a component. Null or empty text: n_shingles 0 and a
    component of its own. Rows that repeat an id are documents of their own,
    each with the component of its own text; so one id may have several.
    Null ids: component_id is the smallest id reachable, or null where there is
    none. A text is worked on as a whole by one task, which takes about 30
    times its bytes. Empty tables give empty results.
    """
    spark = docs.sparkSession
    slices = tasks_for(spark, docs)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    first = materialise(
        base.mapInArrow(_describe(k, chunk_bytes), f"doc_id {id_type}, print long, n_shingles long, node long, chunk long, nodes binary, texts binary"), "jac-texts"
    )
    described = materialise(first.where("chunk is null").select("doc_id", "print", "n_shingles", "node"), "jac-docs")
    texts = first.where("chunk is not null").select("chunk", "nodes", "texts")

    def exchange(chunked: DataFrame, read, half: bool) -> DataFrame:
        return chunked.mapInArrow(_ask(read, half, slices), _ASKED).groupBy("slice").applyInArrow(_answer, _ANSWERED)

    owners = texts.select("chunk", "nodes").mapInArrow(_owner_rows, "node long, chunk long").groupBy("node").agg(F.min("chunk").alias("chunk"))
    told = exchange(texts, lambda row: _text_sets(row, k), True).union(owners.select("chunk", F.lit(-1), F.lit(None).cast("binary"), "node"))
    live = materialise(
        texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_survivors(k, percent), "chunk long, nodes binary, sizes binary, sets binary"), "jac-live"
    )
    discard(first)
    prefixes = materialise(
        live.groupBy("chunk").cogroup(exchange(live, _live_sets, False).groupBy("chunk")).applyInArrow(_prefixes(percent, slices), _PREFIX), "jac-prefixes"
    )
    edges = prefixes.where("slice >= 0").groupBy("slice").applyInArrow(_neighbours(percent, hot), "a long, b long")
    clusters = components(edges)

    nodes = prefixes.where("slice < 0").select("nodes", "sizes", "owns").mapInArrow(_node_rows, "node long, n long, own long")
    sets = live.mapInArrow(_set_rows, "node long, set binary")
    members = materialise(
        _merge(clusters.withColumnRenamed("label", "region"), nodes, "node").select("region", "node", "n", "own", F.lit(True).alias("owns"), F.col("node").alias("known")), "jac-members"
    )
    links = None

    def solve(some: DataFrame) -> DataFrame:
        rows = _merge(some.select("region", "node", "known", "owns"), sets, "node")
        return rows.repartition(slices, "region").sortWithinPartitions("region").mapInArrow(_settle(percent, leaf, pivots), "a long, b long")

    def add(some: DataFrame) -> None:
        nonlocal links
        links = some if links is None else links.union(some)

    whole = False
    for i in range(rounds + 1):
        totals = members.groupBy("region").agg(F.sum("n").alias("total"))
        large = materialise(totals.where(F.col("total") * 8 > task_bytes), "jac-large")
        if large.isEmpty():
            whole = i == 0
            add(solve(members))
            break
        add(materialise(solve(_merge(members, large, "region", "left_anti")), "jac-links"))
        members = _merge(members, large, "region")
        if i < rounds:
            parts, balls, known = _split(members.drop("total"), sets, percent, pivots, task_bytes)
            add(balls)
            size = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if size(parts) <= 2 * size(members):
                members = parts
                continue
            # Windows as wide as their regions: splitting again would only repeat nodes.
            members = _merge(members.drop("known"), known, "node", "left").withColumn("known", F.coalesce("label", F.col("node"))).drop("label")
        add(solve(_block_pairs(members, task_bytes)))
        break
    # Where every cluster fits a task, its links are its component: all to one node.
    labels = components(links) if not whole else materialise(links.select(F.col("b").alias("node"), F.col("a").alias("label")), "jac-labels")

    for table in (live, prefixes):
        discard(table)

    # Node labels become the smallest document of the component.
    filled = described.where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    by_node = _merge(filled.groupBy("node").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("m")), labels, "node", "left")
    by_node = materialise(by_node.withColumn("label", F.coalesce("label", F.col("node"))), "jac-nodes")
    named = by_node.groupBy("label").agg(F.min("least").alias("least"), F.sum("m").alias("class_size"))
    known = _merge(by_node.select("node", "label"), named, "label").select("node", "least", "class_size")
    alone = F.col("n_shingles") == 0
    result = _merge(described, known, "node", "left").select(
        "doc_id",
        "print",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("print") == F.col("least.print")))).alias("stays"),
    )
    return result


def _block_pairs(members: DataFrame, task_bytes: int) -> DataFrame:
    """Regions that pivots don't split: blocks of nodes, and a region for each pair of blocks."""
    blocks = F.ceil(F.col("total") * 8 / (task_bytes / 2)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "node", "n", "own", "owns", "known")


def jaccard_components(docs: DataFrame, *args, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size: see ``jaccard_groups``, which takes the same arguments."""
    return jaccard_groups(docs, *args, **options).select("doc_id", "n_shingles", "component_id", "class_size")
