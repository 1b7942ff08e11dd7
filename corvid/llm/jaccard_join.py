"""Exact n-gram Jaccard self-join of documents: a size-aware heavy-light join over shingle sets.

Sets are held as sorted 64-bit shingle hashes. Two linked sets of any sizes share at least k shingles among the first
(size - least overlap + k) of each, in any order that all sets use; here rare shingles come first. Small (light) sets
enumerate the 2-subsets of that prefix (k = 2) and meet under equal subsets; large (heavy) sets look themselves up in
the inverted lists of single prefix shingles (k = 1), which hold the heavy sets and those light ones that are large
enough to link with a heavy one. The boundary minimises estimated rows and list scans.

Groups that meet under a signature are never expanded into pairs. They are resolved in rounds: the member with the
smallest hash is the group's pivot and the others are compared with it. Jaccard distance is a metric, so with d the
largest distance of linked sets, a set within 2d of the pivot links with none beyond 3d of it. All members within 3d of
one pivot, over all signatures, are one block to be settled: those linked with the pivot are one component already, the
others are compared with it and among themselves in memory, in pieces of a fixed size. Then the pivot and the members
within 2d leave their groups, and a group whose members are in one component is done. Once little is left, its pairs
across components are compared; if much is left after a fixed number of rounds (sets that share a passage and aren't
similar), groups are compared in memory, in pieces. So no pair that could join two components goes unseen.
Candidates pass an exact bound on parity bitmaps before texts are fetched and compared.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.components import connected_components
from corvid.llm.shared import dropped, mix, slices, stored, utf8
from corvid.llm.shingles import shingle_hashes, word_hashes

#: Counters of the rarity sketch (4 bytes each: its broadcast size) and of a part of it that one row holds, text bytes
#: handled at once, sizes that may be light.
SKETCH, PART, SLICE, LIGHT = 1 << 18, 1 << 12, 1 << 18, 64
#: The longest list of sets under a signature that one task may hold, and the tasks that a longer one is dealt over.
LONGEST_LIST, SALTS = 100_000, 64
#: Rows of pairs that may be made at once to end the rounds, besides those for each document; sets of a piece of a block;
#: most rounds around pivots.
PAIRS_AT_ONCE, PAIRS_A_DOCUMENT, PIECE, ROUNDS = 100_000, 10, 2000, 4
_TOKEN, _PAIR = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any linked set."""
    return -(-percent * n // 100)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips a bit; two bitmaps differ in no more bits than their sets in shingles."""
    size = max(64, 1 << (3 * len(shingles) - 1).bit_length())  # so sparse that unrelated sets come out far apart
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(v, np.uint64) for v in ((a, b) if len(a) <= len(b) else (b, a)))
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def text_sets(column, width: int):
    """For each text of an Arrow column, its sorted distinct shingle hashes; texts are handled in slices."""
    raw, bounds = utf8(column)
    for start, end in slices(bounds, SLICE):
        part = bounds[start : end + 1]
        hashes, first = word_hashes(raw[part[0] : part[-1]], part - part[0])
        found, at = shingle_hashes(hashes, first, width)
        for k in range(end - start):
            yield np.unique(found[at[k] : at[k + 1]])


def _described(texts: DataFrame, width: int) -> DataFrame:
    """Per row id, dh (as given), n, node and bits; and per task rows whose id is null and whose n is negative: -1 less the
    number of the part of the task's sketch that is in the column sketch."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        id_type = None
        for batch in batches:
            ids, id_type = batch.column(0), batch.schema.field(0).type
            n, node, bits = [], [], []
            for s in text_sets(batch.column(1), width):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                bits.append(parity_bits(s) if len(s) else None)
                np.add.at(sketch, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if id_type is not None:
            parts = [zstandard.compress(x.astype(np.uint32).tobytes(), 1) for x in np.minimum(sketch, 2**32 - 1).reshape(-1, PART)]
            k, part = len(parts), pa.array([-1 - i for i in range(len(parts))], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), part, pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(parts, pa.binary())], names)

    names = ["id", "dh", "n", "node", "bits", "sketch"]
    return texts.mapInArrow(run, f"id {kind}, dh long, n long, node long, bits binary, sketch binary")


def _summed(sketches: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: each part is summed by tasks, then in one, so that the driver gets one sketch."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[n] = total.get(n, np.zeros(PART, np.int64)) + np.frombuffer(zstandard.decompress(value), np.uint32)
        packed = [zstandard.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(packed, pa.binary())], ["n", "sketch"])

    rows = sketches.select("n", "sketch").mapInArrow(run, "n long, sketch binary").repartition("n").mapInArrow(run, "n long, sketch binary").collect()
    out = np.zeros((SKETCH // PART, PART), np.uint32)
    for row in rows:
        out[-1 - row.n] = np.frombuffer(zstandard.decompress(row.sketch), np.uint32)
    return out.reshape(-1)


def _rare_first(s: np.ndarray, sketch: np.ndarray, most: int) -> np.ndarray:
    """The first shingles of a set in the order of (sketch count, hash); s is sorted by hash."""
    return s[np.argsort(_seen(s, sketch), kind="stable")[:most]]


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n shingles can link with any set other than itself."""
    return 100 * n >= percent * (n + 1)


def signatures(s: np.ndarray, sketch: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """The signatures under which a set meets all sets that it may link with; those whose lists may pass LONGEST_LIST, as the
    sketch bounds them, are odd, the others even."""
    n = len(s)
    least = least_overlap(n, percent)
    out = []
    if n > boundary or 100 * n >= percent * (boundary + 1):
        first = _rare_first(s, sketch, n - least + 1)
        out.append(_marked(mix(first ^ _TOKEN), _seen(first, sketch)))
    if n <= boundary:
        first = _rare_first(s, sketch, n - least + 2)
        pairs = np.array(list(combinations(range(len(first)), 2)), np.int64).reshape(-1, 2)
        low, high = np.sort(first[pairs], axis=1).T
        out.append(_marked(mix(mix(low + _PAIR) ^ high), np.minimum(_seen(low, sketch), _seen(high, sketch))))
    return np.concatenate(out)


def _seen(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]


def _marked(sig: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (sig & ~np.uint64(1)) | (seen > LONGEST_LIST).astype(np.uint64)


def _boundary(texts: DataFrame, sketch: np.ndarray, width: int, percent: int, sample_rows: int = 2000, sample_chars: int = 10_000) -> int:
    """The largest light size: least estimated rows plus list entries scanned, by set size on a bounded sample (the
    first sample_rows texts of up to sample_chars characters).

    Only the cost depends on it; the linked pairs are the same under any boundary."""
    floor = max(1.0, float(sketch.mean()))
    sample = texts.select("text").filter(F.length("text") <= sample_chars).limit(sample_rows).collect()
    found = []
    for s in text_sets(pa.array([r.text for r in sample], pa.string()), width):
        n = len(s)
        if can_link(n, percent) and n <= 2 * LIGHT:
            least = least_overlap(n, percent)
            counts = np.sort(sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)] / floor)
            single, pair = counts[: n - least + 1], counts[: n - least + 2]
            m = len(pair)
            # a list is scanned up to its length; a pair's list is about as long as the rarer one's over the floor
            found.append((n, len(single) + single.sum(), m * (m - 1) / 2 + (pair[:-1] * np.arange(m - 1, 0, -1)).sum() / m))

    def cost(b: int) -> float:
        return sum(light for n, _, light in found if n <= b) + sum(heavy for n, heavy, _ in found if n > b or 100 * n >= percent * (b + 1))

    return min((0, 4, 6, 8, 12, 16, 24, 32, 48, LIGHT), key=lambda b: (cost(b), b))


def _signature_rows(texts: DataFrame, sketch, boundary: int, width: int, percent: int) -> DataFrame:
    """(sig, node, n) of every set, once for copies within a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sigs, nodes, sizes = [], [], []
            for s in text_sets(batch.column(0), width):
                if not can_link(len(s), percent):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
                sig = signatures(s, sketch.value, boundary, percent)
                sigs.append(sig)
                nodes.append(np.full(len(sig), node, np.int64))
                sizes.append(np.full(len(sig), len(s), np.int32))
            if sigs:
                columns = [np.concatenate(sigs).view(np.int64), np.concatenate(nodes), np.concatenate(sizes)]
                table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "n"])
                for at in range(0, table.num_rows, 200_000):
                    yield table.slice(at, 200_000)

    return texts.select("text").mapInArrow(run, "sig long, node long, n int")


def _pivoted(sigs: DataFrame, long: bool) -> DataFrame:
    """(sig, b, n_b, a, n_a): the members of each signature's list with the smallest as pivot a, of lists of two nodes or
    more; stored.

    The texts are read once: a window finds the pivots, of lists that may pass LONGEST_LIST for each of SALTS parts, whose
    pivots are then aggregated. long: whether there may be such lists."""
    salt = F.when(F.col("sig").bitwiseAND(F.lit(1)) == 1, F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if long else F.lit(0)
    own = Window.partitionBy("sig", "salt") if long else Window.partitionBy("sig")
    rows = sigs.withColumn("salt", salt) if long else sigs
    rows = rows.withColumn("p", F.min(F.struct("node", "n")).over(own)).withColumn("many", F.max("node").over(own) != F.col("p.node"))
    cold = F.col("sig").bitwiseAND(F.lit(1)) == 0
    # copies whose texts came to several tasks: a list holds a set once, or copies would be counted and paired with each other
    rows = rows.filter(F.col("many") | ~cold if long else F.col("many")).dropDuplicates(["sig", "salt", "node"] if long else ["sig", "node"])
    found = stored(rows.select("sig", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("p.node").alias("a"), F.col("p.n").alias("n_a")), "met")
    if not long:
        return found
    hot = found.filter(~cold)
    first = hot.groupBy("sig").agg(F.min(F.struct("a", "n_a")).alias("p"), F.max("b").alias("top")).filter("p.a <> top")
    joined = hot.select("sig", "b", "n_b").join(first, "sig").select("sig", "b", "n_b", F.col("p.a").alias("a"), F.col("p.n_a").alias("n_a"))
    return found.filter(cold).unionByName(joined)


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, near) of the pairs (a, b, n_a, n_b) that may be within three times the distance of linked sets; near: within
    twice. Bitmaps bound the similarity from above."""
    bits = reps.select("node", "bits")
    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")

    def run(batches):
        for batch in batches:
            _, _, n_a, n_b, x, y = (c.to_pylist() for c in batch.columns)
            # sets that differ in d shingles or more have a similarity of (n_a + n_b - d) / (n_a + n_b + d) at most
            bound = [(p + q - d, p + q + d) for p, q, d in zip(n_a, n_b, (max(abs(p - q), differing_bits(u, v)) for p, q, u, v in zip(n_a, n_b, x, y)))]
            keep, near = (pa.array([100 * i >= (100 - k * (100 - percent)) * u for i, u in bound], pa.bool_()) for k in (3, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), near], ["a", "b", "near"]).filter(keep)

    return stored(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, near boolean"), "bounded")


def _packed_texts(wanted: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(node, packed): a compressed text of each node in `wanted`, stored."""
    wanted = stored(wanted.select("node").distinct().join(reps.select("node", "rep"), "node"), "wanted")
    found = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")  # alike at every size

    def packed(batches):
        press = zstandard.ZstdCompressor()
        for batch in batches:
            keep, out = [], []
            for i, s in enumerate(text_sets(batch.column(1), width)):
                if len(s) and node_of(s) == batch.column(0)[i].as_py():
                    keep.append(i)
                    out.append(press.compress(batch.column(1)[i].as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["node", "packed"])

    out = stored(found.mapInArrow(packed, "node long, packed binary").dropDuplicates(["node"]), "packed", "uncompressed")
    dropped(wanted)
    return out


def _compared(pairs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b) that are within twice the distance of linked sets, by their whole texts; stored.

    The members of a pivot a are dealt out in salted parts, each with the pivot's text before theirs."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("long").alias("salts"))
    members = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    members = members.join(found.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "packed")
    pivots = salts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).join(found.withColumnRenamed("node", "a"), "a")
    pivots = pivots.select("a", "salt", F.lit(None).cast("long").alias("b"), "packed")

    def run(batches):
        press, now, pivot = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            out = []
            texts_here = pa.array([press.decompress(v.as_py()) for v in batch.column(3)], pa.binary())
            for a, salt, b, s in zip(*(batch.column(k).to_pylist() for k in range(3)), text_sets(texts_here, width)):
                if b is None:
                    now, pivot = (a, salt), s
                elif now == (a, salt):
                    both = _shared(pivot, s)
                    either = len(pivot) + len(s) - both
                    if 100 * both >= (2 * percent - 100) * either:
                        out.append((a, b, 100 * both >= percent * either))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    ordered = members.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stored(ordered.mapInArrow(run, "a long, b long, linked boolean"), "links")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct values share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


class _Piece:
    """Sets held in memory, with their bitmaps folded to each size asked for, and local component labels."""

    def __init__(self, percent: int):
        self.percent, self.nodes, self.sets, self.bits, self.label = percent, [], [], [], []
        self.folded: dict[int, np.ndarray] = {}
        self.sizes = np.zeros(0, np.int64)

    def add(self, node: int, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(s)
        self.bits.append(np.frombuffer(parity_bits(s), np.uint64))
        self.label.append(len(self.label))
        self.folded.clear()

    def may_link(self, s: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Of the rows `among`, those whose bitmaps don't rule out a link with s."""
        own = np.frombuffer(parity_bits(s), np.uint64)
        width = min(len(own), min(map(len, self.bits)))
        if width not in self.folded:
            self.folded[width] = np.stack([np.bitwise_xor.reduce(b.reshape(-1, width), axis=0) for b in self.bits])
            self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        d = np.bitwise_count(self.folded[width][among] ^ np.bitwise_xor.reduce(own.reshape(-1, width), axis=0)).sum(axis=1).astype(np.int64)
        total = self.sizes[among] + len(s)
        d = np.maximum(d, np.abs(self.sizes[among] - len(s)))
        return among[100 * (total - d) >= self.percent * (total + d)]

    def linked(self, row: int, s: np.ndarray) -> bool:
        both = _shared(self.sets[row], s)
        return 100 * both >= self.percent * (len(self.sets[row]) + len(s) - both)

    def links(self, node: int, s: np.ndarray, start: int, own: int | None = None) -> list[tuple[int, int]]:
        """Links of a set with the rows from `start` on, one for each component it joins; own: its row, if it has one."""
        label = np.array(self.label)
        among = np.flatnonzero(label != (label[own] if own is not None else -1))
        out, joined = [], [] if own is None else [label[own]]
        for row in self.may_link(s, among[among >= start]):
            if self.label[row] not in joined and self.linked(row, s):
                out.append((node, self.nodes[row]))
                joined.append(self.label[row])
        if len(joined) > 1:
            least = min(joined)
            self.label = [least if x in joined else x for x in self.label]
        return out


def _settled(member: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links among the members (a, b, star) of each block a; stored.

    A block is a pivot's, whose stars are linked with it and so one component already, or a list's, without stars.
    Strays, the others, are compared with stars and among themselves. Both are dealt out in pieces of PIECE sets, a pair
    of pieces to a task's group; blocks without strays aren't looked at. A group returns one link for each component that
    a set joins."""
    counts = member.groupBy("a").agg(F.count_if(~F.col("star")).alias("strays"), F.count_if("star").alias("stars")).filter("strays > 0")
    pieces = counts.select("a", F.ceil(F.col("strays") / PIECE).cast("int").alias("p"), F.ceil(F.col("stars") / PIECE).cast("int").alias("q"))
    member = member.join(pieces, "a")
    own = F.pmod(F.xxhash64("b"), F.when(F.col("star"), F.col("q")).otherwise(F.col("p"))).cast("int")
    member = member.withColumn("own", own)
    spot = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    all_strays, all_pieces = F.sequence(F.lit(0), F.col("p") - 1), F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)
    held = F.transform(F.filter(all_pieces, lambda j: j >= F.col("own")), lambda j: spot(F.col("own"), j, F.lit(0)))
    after = F.transform(F.filter(all_strays, lambda i: i < F.col("own")), lambda i: spot(i, F.col("own"), F.lit(1)))
    star = F.transform(all_strays, lambda i: spot(i, F.col("p") + F.col("own"), F.lit(1)))
    dealt = member.withColumn("s", F.explode(F.when(F.col("star"), star).otherwise(F.concat(held, after)))).select("a", "s.i", "s.j", "s.role", "b", "star")
    dealt = dealt.join(found.withColumnRenamed("node", "b"), "b").select("a", "i", "j", "role", "b", "star", "packed")

    def run(batches):
        press, now, piece, settled = zstandard.ZstdDecompressor(), None, None, False
        for batch in batches:
            out = []
            texts_here = pa.array([press.decompress(v.as_py()) for v in batch.column(6)], pa.binary())
            for a, i, j, role, b, is_star, s in zip(*(batch.column(k).to_pylist() for k in range(6)), text_sets(texts_here, width)):
                if (a, i, j) != now:
                    if piece is not None and not settled and now[1] == now[2]:
                        out += _within(piece)
                    now, piece, settled = (a, i, j), _Piece(percent), False
                if role == 0:
                    piece.add(b, s)
                    continue
                if not piece.nodes:
                    continue
                settled = True
                if is_star:  # stars are one component: a stray needs one link to it
                    rest = np.flatnonzero(np.array(piece.label) != -1)
                    for row in piece.may_link(s, rest) if len(rest) else ():
                        if piece.linked(row, s):
                            out.append((b, piece.nodes[row]))
                            piece.label[row] = -1
                else:
                    out += piece.links(b, s, 0)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["a", "b"])
        if piece is not None and not settled and now[1] == now[2]:
            out = _within(piece)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["a", "b"])

    ordered = dealt.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "role")
    return stored(ordered.mapInArrow(run, "a long, b long"), "settled")


def _around_pivots(bounded: DataFrame, compared: DataFrame) -> DataFrame:
    """(a, b, star) of each pivot's block: the pivot, and all that may be within three times the distance of linked sets."""
    linked = compared.filter("linked").select("a", "b", F.lit(True).alias("star"))
    member = bounded.select("a", "b").join(linked, ["a", "b"], "left").select("a", "b", F.coalesce("star", F.lit(False)).alias("star"))
    return member.unionByName(bounded.select("a", F.col("a").alias("b"), F.lit(True).alias("star")).distinct())


def _within(piece: _Piece) -> list[tuple[int, int]]:
    """Links among the sets of a piece, one for each component that a set joins."""
    return [x for row in range(len(piece.nodes) - 1) for x in piece.links(piece.nodes[row], piece.sets[row], row + 1, row)]


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, component) of all nodes with links, after more links: only components that links join are worked on."""
    if labels is None:
        return connected_components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = stored(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))), "known")
    a, b = (known.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in "ab")
    between = links.join(a, "a").join(b, "b").filter("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    moved = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    out = stored(known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    for old in (labels, known, moved):
        dropped(old)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles (distinct shingles of `width` lower-cased words) and component_id.

    A text with fewer words is one shingle; null, empty and blank texts have none and link with nothing. Two rows
    link when 100 * intersection >= percent * union; component_id is the smallest id reachable by links, the row's own
    id included (null ids never are the smallest; a component of null ids alone has null). Repeated rows and equal
    texts are copies of one set; ties have no effect. Other columns are ignored, an empty table gives an empty result.
    Equality of shingles and sets is that of 64-bit hashes.
    """
    found = _rows_of_components(docs, id_col, text_col, width, percent)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _place() -> Column:
    """The order of the rows of a component: by id, null last, then the text's hash."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("dh"))


def _rows_of_components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Per row: id, dh (the text's hash), n, node, component_id and first, the least place in the row's component."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    described = stored(_described(texts.withColumn("dh", F.xxhash64("text")), width), "sets")
    rows = described.filter("n >= 0")
    sketch = spark.sparkContext.broadcast(_summed(described.filter("n < 0")))
    reps = stored(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.min(_place()).alias("first"), F.first("bits").alias("bits")), "reps")

    boundary = _boundary(texts, sketch.value, width, percent)
    met = _pivoted(_signature_rows(texts, sketch, boundary, width, percent), int(sketch.value.max()) > LONGEST_LIST)

    most = PAIRS_AT_ONCE + PAIRS_A_DOCUMENT * rows.count()
    labels = None

    def in_components(members: DataFrame) -> tuple[DataFrame, int]:
        """Members (sig, node, n) with their component, of signatures that hold several; and the pairs across them."""
        held = members.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        counts = held.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("m"))
        across = counts.groupBy("sig").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("across")).filter("across > 0")
        held = stored(held.join(across, "sig"), "open")
        size = held.groupBy("sig").agg(F.first("across").alias("across")).agg(F.coalesce(F.sum("across"), F.lit(0.0))).first()[0]
        return held.drop("across"), size

    def crossing(members: DataFrame) -> DataFrame:
        """The pairs (a, b, n_a, n_b) across components that share a signature and are of sizes that may link."""
        x = members.select("sig", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
        y = members.select("sig", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
        both = x.join(y, "sig").filter((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
        return both.select("a", "b", "n_a", "n_b").distinct()

    ends = lambda df: df.select(F.col("a").alias("node")).unionByName(df.select(F.col("b").alias("node")))
    held = met.select("sig", F.col("b").alias("node"), F.col("n_b").alias("n"), "a", "n_a").filter("b <> a")
    spent = [met]
    for turn in range(ROUNDS):
        pairs = held.select("a", F.col("node").alias("b"), "n_a", F.col("n").alias("n_b")).distinct()
        bounded = _bounded(pairs, reps, percent)
        found = _packed_texts(ends(bounded), texts, reps, width)
        compared = _compared(bounded.filter("near").select("a", "b"), found, width, percent)
        settled = _settled(_around_pivots(bounded, compared), found, width, percent)
        labels = _merged(labels, compared.filter("linked").select("a", "b").unionByName(settled))
        held = held.join(compared.select("a", F.col("b").alias("node")).hint("merge"), ["a", "node"], "left_anti")
        held, size = in_components(held.select("sig", "node", "n"))
        for old in (*spent, bounded, found, compared, settled):
            dropped(old)
        spent = [held]
        if size <= most or turn == ROUNDS - 1:
            break
        pivot = held.groupBy("sig").agg(F.min(F.struct("node", "n")).alias("p"))
        held = held.join(pivot, "sig").select("sig", "node", "n", F.col("p.node").alias("a"), F.col("p.n").alias("n_a")).filter("node <> a")
    if 0 < size <= most:
        bounded = _bounded(crossing(held), reps, percent).filter("near")
        compared = _compared(bounded.select("a", "b"), _packed_texts(ends(bounded), texts, reps, width), width, percent)
        labels = _merged(labels, compared.filter("linked").select("a", "b"))
    elif size:  # lists of many sets that aren't similar: compared by pieces, under each signature
        found = _packed_texts(held.select("node"), texts, reps, width)
        labels = _merged(labels, _settled(held.select(F.col("sig").alias("a"), F.col("node").alias("b"), F.lit(False).alias("star")), found, width, percent))

    groups = reps.select("node", "rep", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("first").alias("first"))
    named = groups.select("node", "component").join(least, "component").select("node", "component_id", "first")
    return rows.select("id", "dh", "n", "node").join(named, "node", "left")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps the first by id (null last), then text hash.

    Each row is judged by its own text, whatever other rows its id has. Rows without words stay; rows that are equal in
    id and text stay or go together."""
    found = _rows_of_components(docs, id_col, text_col, width, percent)
    gone = found.filter(F.col("node").isNotNull() & (_place() > F.col("first"))).select("id", "dh").distinct()
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.`{text_col}`").cast("string")) == F.col("g.dh"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")
