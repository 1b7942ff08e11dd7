"""Embedding near-duplicates: spherical k-means cells, blocked cosine products between cells, one representative a group.

Cells only decide where a pair is compared, never whether. A vector is at home in the cell of its nearest centroid. Cells
that lie near each other share a block, and a cell larger than a block has several. A vector is compared with its own
block, and is a guest in every block of a smaller number with a cell in which a partner may be at home: for a pair with
cosine >= t the distance between the unit vectors is at most s = sqrt(2 - 2t), so a guest lies no deeper than s beyond
the plane between its own centroid and the cell's, and no more than arccos(t) outside the cell's widest member. Each
pair thus meets in the block of the smaller number, and links are exact.

Blocks grow with the table up to a number of bytes, so a vector is sent to a few blocks rather than to each of many
cells, and they are dealt out in waves: a wave holds a stated number of the table's rows, and its shuffle files go before
the next begins. Vectors are sent as they were given and made units again where they are compared.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.components import connected_components
from corvid.llm.shared import dropped, stored

#: Vectors a cell should hold, most centroids, sampled vectors a centroid, slack for rounding. Few vectors have a centroid for
#: each FEW of their number's square root, so that small tables have several cells too.
CELL, MOST_CELLS, SAMPLE, SLACK, FEW = 2000, 2048, 32, 1e-6, 8
#: Vectors that a block has at least, most bytes of a block in double precision, parts in which a block's guests come, rows
#: of a wave for each vector of the table, products that are held at once.
BLOCK, BLOCK_BYTES, PARTS, WAVE, TILE = 2000, 32 << 20, 6, 3, 1 << 22


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, real): the rows that have a direction in double precision and of length one, and which these are."""
    x = np.ascontiguousarray(x, np.float64)
    top = np.abs(x).max(axis=1, initial=0)
    real = np.isfinite(x).all(axis=1) & (top > 0)
    x = x[real] / top[real, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None], real


def unit(values) -> np.ndarray | None:
    """The vector in double precision and of length one; None where it is null, zero, empty or not finite."""
    if values is None or any(v is None for v in values) or not len(values):
        return None
    x, real = unit_rows(np.array([values], np.float64))
    return x[0] if real[0] else None


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit vectors; an empty cell takes the vector that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        fit = np.einsum("ij,ij->i", x, c[near])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        bad = size < 1e-12
        sums[bad] = x[np.argsort(fit)[: bad.sum()]]
        c = sums / np.where(bad, 1.0, size)[:, None]
    return c / np.linalg.norm(c, axis=1)[:, None]


def _given(column) -> list[np.ndarray | None]:
    """The vectors of an Arrow list column, None where one is null or holds a null."""
    whole = column.flatten()
    raw = np.asarray(whole.fill_null(0))
    ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0)))
    holes = np.concatenate([[0], np.cumsum(np.asarray(whole.is_null()))])
    return [raw[a:b] if ok and holes[a] == holes[b] else None for a, b, ok in zip(ends - np.diff(ends, prepend=0), ends, column.is_valid().to_pylist())]


def _nodes(vectors: DataFrame) -> DataFrame:
    """Per row id, node (a 64-bit hash of the unit vector; null: it links with nothing), dim and raw (the vector as given)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            given = _given(batch.column(1))
            node: list = [None] * len(given)
            lengths = np.array([0 if v is None else len(v) for v in given])
            for d in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == d)
                units, real = unit_rows(np.stack([given[k] for k in at]))
                for k, u in zip(at[real], units):
                    node[k] = int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)
            raw = [None if n is None else v.tobytes() for n, v in zip(node, given)]
            dim = [None if n is None else len(v) for n, v in zip(node, given)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], ["id", "node", "dim", "raw"])

    return vectors.mapInArrow(run, f"id {kind}, node long, dim int, raw binary")


def _matrix(column, kind: str) -> np.ndarray:
    """The unit vectors of a column of raw ones of one length."""
    return unit_rows(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1))[0]


def _cells(reps: DataFrame, centroids, dim: int, kind: str) -> DataFrame:
    """(cell, fit, home): of each vector its cell, and others as near but for rounding, so that a cell's reach holds in either
    case; vectors of another length than the centroids' share a cell by length."""

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column(0)).astype(np.int64)
            other = -dims[dims != dim]
            dots = _matrix(batch.column(1).filter(pa.array(dims == dim)), kind) @ centroids.value.T if (dims == dim).any() else np.zeros((0, 1))
            row, cell = np.nonzero(dots >= dots.max(axis=1, keepdims=True) - 1e-9)
            home = cell == dots.argmax(axis=1)[row]
            columns = np.concatenate([other, cell]).astype(np.int32), np.concatenate([np.ones(len(other)), dots[row, cell]]), np.concatenate([np.ones(len(other), bool), home])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "fit", "home"])

    return reps.select("dim", "raw").mapInArrow(run, "cell int, fit double, home boolean")


def _near_each_other(c: np.ndarray) -> list[int]:
    """The centroids' numbers as a chain from each to the nearest one that is left."""
    left, chain = np.ones(len(c), bool), [0]
    left[0] = False
    while left.any():
        chain.append(int(np.where(left, c @ c[chain[-1]], -np.inf).argmax()))
        left[chain[-1]] = False
    return chain


def _blocks(sizes: dict[int, int], centroids: np.ndarray, room: int) -> tuple[dict[int, tuple[int, int]], int]:
    """({cell: (first block, blocks)}, number of blocks): cells along the chain share a block as long as there is room."""
    out, n, held = {}, 0, 0
    for cell in [k for k in _near_each_other(centroids) if k in sizes] + sorted(k for k in sizes if k < 0):
        parts = max(1, -(-sizes[cell] // room))
        if held and (parts > 1 or cell < 0 or held + sizes[cell] > room):
            n, held = n + 1, 0
        out[cell] = (n, parts)
        held += sizes[cell]
        if parts > 1 or cell < 0:
            n, held = n + parts, 0
    return out, n + bool(held)


def _placed(reps: DataFrame, centroids, dim: int, kind: str, reach: np.ndarray, blocks, count: int, threshold: float) -> DataFrame:
    """reps with their block and the blocks in which they are guests."""
    chord, angle = np.sqrt(2 - 2 * threshold) + SLACK, np.arccos(threshold) + SLACK

    def run(batches):
        c = centroids.value
        widths = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 512 else None
        held = [k for k in sorted(blocks) if k >= 0]
        for batch in batches:
            node, dims = np.asarray(batch.column(0)), np.asarray(batch.column(2)).astype(np.int64)
            cell = -dims
            guest = np.zeros((len(node), count), bool)
            own = np.flatnonzero(dims == dim)
            if len(own):
                dots = _matrix(batch.column(4).take(pa.array(own)), kind) @ c.T
                home = cell[own] = dots.argmax(axis=1)
                best = dots.max(axis=1)
                for k in held:
                    width = widths[home, k] if widths is not None else np.linalg.norm(c[home] - c[k], axis=1)
                    near = (best - dots[:, k] <= chord * width + SLACK) & (np.arccos(np.clip(dots[:, k], -1, 1)) <= reach[k] + angle)
                    first, parts = blocks[k]
                    guest[own[near], first : first + parts] = True
            first, parts = (np.array([blocks[k][i] for k in cell.tolist()], np.int64) for i in (0, 1))
            spread = ((node.view(np.uint64) >> np.uint64(17)) % parts.astype(np.uint64)).astype(np.int64)
            block = first + spread
            for r in np.flatnonzero(spread):  # the earlier blocks of one's own cell
                guest[r, first[r] : block[r]] = True
            guest &= np.arange(count)[None, :] < block[:, None]
            ends = np.concatenate([[0], np.cumsum(guest.sum(axis=1))]).astype(np.int32)
            guests = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(guest)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3, 4)), pa.array(block.astype(np.int32)), guests], ["node", "rep", "copies", "raw", "block", "guests"])

    rep = reps.schema["rep"].dataType.simpleString()
    return reps.select("node", "rep", "dim", "copies", "raw").mapInArrow(run, f"node long, rep {rep}, copies long, raw binary, block int, guests array<int>")


def _dealt(homes: DataFrame, wave: range, parts: dict[int, list[int]], share: int) -> DataFrame:
    """Rows of the blocks of a wave: block, part, side (0: at home there, 1: a guest), node, copies, raw."""

    def run(batches):
        for batch in batches:
            own, lists = np.asarray(batch.column(3)).astype(np.int64), batch.column(4)
            to, row = np.asarray(lists.flatten()).astype(np.int64), np.repeat(np.arange(len(own)), np.asarray(lists.value_lengths()))
            here = (to >= wave.start) & (to < wave.stop)
            found = [(row[here], to[here], own[row[here]] // share, np.ones(here.sum()))]
            for r in np.flatnonzero((own >= wave.start) & (own < wave.stop)):
                at = parts[int(own[r])]
                found.append((np.full(len(at), r), np.full(len(at), own[r]), np.array(at), np.zeros(len(at))))
            row, to, part, side = (np.concatenate(x) for x in zip(*found))
            take = pa.array(row.astype(np.int64))
            for at in range(0, len(row), 20_000):
                cut = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[cut].astype(np.int32)) for x in (to, part, side)), *(batch.column(k).take(take[cut]) for k in range(3))], ["block", "part", "side", "node", "copies", "raw"])

    return homes.select("node", "copies", "raw", "block", "guests").mapInArrow(run, "block int, part int, side int, node long, copies long, raw binary")


class _Group:
    """The vectors of one block (side 0) are held; those of side 1 are compared tile by tile."""

    def __init__(self, within: bool, threshold: float):
        self.within, self.threshold = within, threshold
        self.held: list = []
        self.out: list[tuple] = []
        self.x = None

    def add(self, nodes, copies, x):
        self.held.append((nodes, copies, x))

    def settle(self):
        """All of side 0 has come: compare it with itself where the group is the block's own."""
        if not self.held:
            return
        self.nodes, self.copies, self.x = (np.concatenate(v) for v in zip(*self.held))
        self.held = []
        self.links, self.group = np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes))
        step = self._step()
        for at in range(0, len(self.nodes) if self.within else 0, step):
            self._compare(self.nodes[at : at + step], self.copies[at : at + step], self.x[at : at + step], at)

    def _step(self) -> int:
        return max(1, min(1024, TILE // len(self.nodes)))

    def compare(self, nodes, copies, x):
        if self.x is not None:
            step = self._step()
            for at in range(0, len(nodes), step):
                self._compare(nodes[at : at + step], copies[at : at + step], x[at : at + step])

    def _compare(self, nodes, copies, x, start: int | None = None):
        """A tile against the held vectors; one of these themselves, from `start` on, meets those after it.

        Counts are of all links; edges only join a vector to the groups of held vectors that it links with, and these."""
        first = start or 0
        near = x @ self.x[first:].T >= self.threshold
        if start is None:
            near &= nodes[:, None] != self.nodes[None, :]
        else:
            near &= np.arange(near.shape[1])[None, :] > np.arange(len(nodes))[:, None]
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return
        near, nodes, copies = near[hit], nodes[hit], copies[hit]
        self.links[first:] += copies @ near
        self.out += [(n, n, k) for n, k in zip(nodes, near @ self.copies[first:])]
        if start is not None:
            near[np.arange(len(hit)), hit] = True
        columns = np.flatnonzero(near.any(axis=0))
        groups, at = np.unique(self.group[first + columns], return_inverse=True)
        order = np.argsort(at, kind="stable")
        met = np.logical_or.reduceat(near[:, columns[order]], np.searchsorted(at[order], np.arange(len(groups))), axis=1)
        label = np.arange(len(groups))
        while True:
            own = np.where(met, label[None, :], len(groups)).min(axis=1)
            after = np.minimum(label, np.where(met, own[:, None], len(groups)).min(axis=0))
            after = after[after]
            if (after == label).all():
                break
            label = after
        name = self.nodes[groups]
        self.out += [(n, b, 0) for n, b in zip(nodes, name[own]) if n != b]
        moved = np.flatnonzero(label != np.arange(len(label)))
        self.out += [(name[i], name[label[i]], 0) for i in moved]
        if len(moved):
            to = np.arange(len(self.nodes))
            to[groups[moved]] = groups[label[moved]]
            self.group = to[self.group]

    def end(self):
        return self.out + ([] if self.x is None else [(self.nodes[k], self.nodes[k], self.links[k]) for k in np.flatnonzero(self.links)])


def _compared(dealt: DataFrame, threshold: float, kind: str, share: int, tasks: int) -> DataFrame:
    """(a, b, links): with a = b, vectors linked with a in one group; else both are in one component."""

    def run(batches):
        now, group, settled = None, None, False

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(3)], ["a", "b", "links"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(keys)), cuts):
                if not len(part):
                    continue
                key, side = tuple(keys[part[0], :2]), keys[part[0], 2]
                if key != now:
                    if group is not None:
                        if not settled:
                            group.settle()
                        if out := group.end():
                            yield packed(out)
                    now, group, settled = key, _Group(key[0] // share == key[1], threshold), False
                rows = batch.slice(int(part[0]), len(part))
                nodes, copies, x = np.asarray(rows.column(3)), np.asarray(rows.column(4)), _matrix(rows.column(5), kind)
                if side == 0:
                    group.add(nodes, copies, x)
                    continue
                if not settled:
                    group.settle()
                    settled = True
                group.compare(nodes, copies, x)
                if len(group.out) > 100_000:
                    yield packed(group.out)
                    group.out = []
        if group is not None:
            if not settled:
                group.settle()
            if out := group.end():
                yield packed(out)

    ordered = dealt.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "side")
    return ordered.mapInArrow(run, "a long, b long, links long")


def _waves(sizes: list[int], most: int) -> list[range]:
    """Successive blocks whose rows are about `most` together; a larger block is a wave of its own."""
    out, start, held = [], 0, 0
    for t, n in enumerate(sizes):
        if held and held + n > most:
            out.append(range(start, t))
            start, held = t, 0
        held += n
    return out + [range(start, len(sizes))] * (start < len(sizes))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable, its own included), kept.

    Rows link when their cosine in double precision is >= threshold. Vectors that are null, empty, zero or hold a null
    or non-finite component, and vectors of different lengths, link with nothing. Equal unit vectors are compared once
    and counted by their copies. A null id is never the smallest; a row is kept where its id is its component's (a row
    without links always). Other columns are ignored; an empty table gives an empty result.

    Centroids are fitted on a bounded sample (SAMPLE vectors a centroid, MOST_CELLS centroids at most, those of the
    smallest hashes); every vector is assigned. A block has so many vectors that there is one for each core, within BLOCK
    and BLOCK_BYTES; its guests come in PARTS, each with the block a group of its own, so that a hot block spreads over tasks.
    Groups return counts and spanning forests.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    given = _nodes(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector")))
    kind = "<f4" if kind == "array<float>" else "<f8"
    found = stored(given.select("id", "node"), "units")
    reps = given.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("dim").alias("dim"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    reps = stored(reps, "reps")
    main = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, n = (main["dim"], main["count"]) if main else (1, 0)
    k = int(min(MOST_CELLS, max(1, n // CELL, round(math.sqrt(n) / FEW))))
    sample = reps.filter(F.col("dim") == dim).orderBy("node").limit(SAMPLE * max(k, 64)).select("raw").collect() if n else []
    x = unit_rows(np.stack([np.frombuffer(r.raw, kind) for r in sample]))[0] if sample else np.ones((1, dim))
    centroids = spark.sparkContext.broadcast(spherical_kmeans(x, min(k, len(x))))

    cells = _cells(reps, centroids, dim, kind).groupBy("cell").agg(F.count_if("home").alias("n"), F.min("fit").alias("fit")).collect()  # a row a cell
    reach = np.zeros(len(centroids.value))
    for r in cells:
        if r.cell >= 0:
            reach[r.cell] = np.arccos(np.clip(r.fit, -1, 1))
    room = max(1, min(max(BLOCK, -(-n // spark.sparkContext.defaultParallelism)), max(BLOCK, BLOCK_BYTES // (8 * dim))))
    blocks, count = _blocks({r.cell: r.n for r in cells}, centroids.value, room)
    homes = stored(_placed(reps, centroids, dim, kind, reach, blocks, count, threshold), "homes")
    dropped(reps)
    reps = homes.select("node", "rep", "copies")

    share = max(1, -(-count // PARTS))
    own = {r.block: r.n for r in homes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
    guests = homes.select(F.explode("guests").alias("to"), F.floor(F.col("block") / share).cast("int").alias("part")).groupBy("to", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most PARTS rows a block
    parts, rows = {t: {t // share} for t in range(count)}, [0] * count
    for r in guests:
        parts[r.to].add(r.part)
        rows[r.to] += r.n
    rows = [rows[t] + own.get(t, 0) * len(parts[t]) for t in range(count)]
    met = []
    for wave in _waves(rows, WAVE * sum(own.values())):
        dealt = _dealt(homes, wave, {t: sorted(parts[t]) for t in wave}, share)
        met.append(stored(_compared(dealt, threshold, kind, share, 2 * sum(len(parts[t]) for t in wave)), "links"))
    links = reduce(DataFrame.unionByName, met) if met else spark.createDataFrame([], "a long, b long, links long")

    degree = links.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(links.filter("a <> b"))
    groups = reps.select("node", "rep", "copies").join(labels, "node", "left").join(degree, "node", "left")
    groups = groups.select("node", "rep", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = groups.join(least, "component").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = found.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
