"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corvid.llm.shared import let, stored, words

#: Share of a shard's items from which a source or cluster is hot, and how many hot keys a shard indexes bins by.
HOT_SHARE, HOT_KEYS = 0.02, 6


class Bins:
    """Open bins in the order of their residuals, each with bitmaps of the sources and duplicate clusters in it.

    Bins are filed by which hot keys they hold, so that an item of a hot key looks only at bins without it; a file
    has a bitmap of its residuals for the successor search and, for each residual, the bins that have it.
    """

    def __init__(self, capacity: int, hot: dict):
        self.capacity, self.hot = capacity, hot
        self.residual: list[int] = []
        self.held: list[int] = []
        self.files: dict[int, tuple[list[int], dict[int, list[int]]]] = {}
        self.mask: list[int] = []

    def _file(self, b: int) -> None:
        if self.residual[b]:
            present, by = self.files.setdefault(self.mask[b], ([0], {}))
            insort(by.setdefault(self.residual[b], []), b)
            present[0] |= 1 << self.residual[b]

    def _unfile(self, b: int) -> None:
        present, by = self.files[self.mask[b]]
        here = by[self.residual[b]]
        here.remove(b)
        if not here:
            present[0] &= ~(1 << self.residual[b])

    def tightest(self, size: int, bits: int, hot: int) -> int | None:
        """The bin with the least residual that holds `size` and none of the item's bits; of equal ones the oldest."""
        best = None
        for mask, (present, by) in self.files.items():
            if mask & hot:
                continue
            left, at = present[0] >> size, size
            while left:
                step = (left & -left).bit_length() - 1
                at += step
                if best is not None and at > best[0]:
                    break
                b = next((b for b in by[at] if not self.held[b] & bits), None)
                if b is not None:
                    best = min(best, (at, b)) if best else (at, b)
                    break
                left >>= step + 1
                at += 1
        return best[1] if best else None

    def put(self, size: int, bits: int, hot: int) -> tuple[int, int]:
        """Place an item; returns its bin and its start in the bin."""
        b = self.tightest(size, bits, hot)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.held.append(0)
            self.mask.append(0)
        else:
            self._unfile(b)
        start = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.held[b] |= bits
        self.mask[b] |= hot
        self._file(b)
        return b, start


def pack_items(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack (size, source, cluster) in the order given: (item, piece, size, bin, start) of each piece.

    Each `capacity` words of an item fill a bin of their own; what is left over is placed by best fit into a bin
    without the item's source and cluster (None conflicts with nothing). Items of size 0 have no piece."""
    keys = Counter(k for size, source, cluster in items if size % capacity for k in (("s", source), ("c", cluster)) if k[1] is not None)
    shared = [k for k, n in keys.most_common() if n > 1]
    bit = {k: 1 << n for n, k in enumerate(shared)}
    hot = {k: 1 << n for n, k in enumerate(shared[:HOT_KEYS]) if keys[k] >= HOT_SHARE * len(items)}
    bins, out, full = Bins(capacity, hot), [], []
    for n, (size, source, cluster) in enumerate(items):
        pieces, rest = divmod(size, capacity)
        full += [(n, p) for p in range(pieces)]
        if rest:
            own = (("s", source), ("c", cluster))
            b, start = bins.put(rest, sum(bit.get(k, 0) for k in own), sum(hot.get(k, 0) for k in own))
            out.append((n, pieces, rest, b, start))
    first = len(bins.residual)
    return out + [(n, p, capacity, first + k, 0) for k, (n, p) in enumerate(full)]


def best_fit(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = 20_000, cluster_col: str | None = None) -> DataFrame:
    """Per piece of a document: id, piece, n_words, bin_id, bin_start (words before it in the bin).

    A bin holds up to `capacity` words, at most one document of a source and at most one of a duplicate cluster (texts
    equal but for case and white space, or the values of cluster_col, such as components of the Jaccard join; null is in none); documents go in by falling size, each into the tightest bin that holds it
    and conflicts with nothing. A document of more words is cut into full bins and a rest. Null, empty and blank
    texts have one row with piece 0, no words and no bin. A null source conflicts with nothing. Ties in size go by id
    (nulls first), cluster and source; repeated rows are documents of one cluster. Other columns are ignored; an empty
    table gives an empty result.

    Documents are dealt to shards by a hash of id and text, so that hot sources and clusters spread, and each shard is
    sorted by Spark and packed in runs of `shard_rows`, the bound of a task's memory: bins never span runs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    w = words(F.lower(text))
    given = [F.col(cluster_col).alias("given")] if cluster_col else []
    items = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), w.alias("w"), *given)
    cluster = F.when(F.col("given").isNotNull(), F.xxhash64("given")) if cluster_col else F.xxhash64(F.array_join("w", " "))
    items = items.select("id", "source", F.size("w").cast("long").alias("n"), cluster.alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    items = items.withColumn("shard", F.pmod(F.xxhash64("id", "cluster"), F.lit(shards)).cast("int"))
    ordered = items.repartition("shard").sortWithinPartitions("shard", F.desc("n"), "id", "cluster", "source")

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "n", "source", "cluster"))))

        def packed(shard, base, part):
            got = pack_items([(n, source, cluster) for _, _, n, source, cluster in part], capacity)
            out = [(part[i][1], piece, size, (shard << 40) + base + b, start) for i, piece, size, b, start in got]
            out += [(r[1], 0, 0, None, None) for r in part if not r[2]]
            types = (None, pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(list(c), t or id_type) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays(columns, ["id", "piece", "n_words", "bin_id", "bin_start"]), base + max((b + 1 for *_, b, _ in got), default=0)

        for shard, group in groupby(rows, key=lambda r: r[0]):
            base, part, pieces = 0, [], 0
            for r in group:
                part.append(r)
                pieces += 1 + r[2] // capacity
                if len(part) >= 2 * shard_rows or pieces >= 1 << 21:
                    batch, base = packed(shard, base, part)
                    yield batch
                    part, pieces = [], 0
            if part:
                yield packed(shard, base, part)[0]

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    out = ordered.mapInArrow(run, f"id {kind}, piece long, n_words long, bin_id long, bin_start long")
    return out.withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(bin_id, n_words, pieces, text) of the bins of best_fit(docs, capacity): what is trained on.

    A bin's text is its pieces as they stand in their documents, white space included, in the order of their places and with the
    separator between them. pieces are (id, piece, bin_start, n_words, char_start, n_chars), so that attention can be kept within one
    and a document is the join of its pieces. Rows of docs with one id must have one text; see packed_pieces. A bin is at most
    `capacity` words, so no group has more; documents are cut before they are shuffled, so a very long one travels as pieces."""
    # one key of one type for both sides, nullable throughout, so that rows of pieces are dealt once, for finding repeated rows
    # and for the join
    kind = f"struct<id:{docs.schema[id_col].dataType.simpleString()},piece:bigint>"
    at = lambda of, piece: F.struct(of.alias("id"), piece.alias("piece")).cast(kind).alias("at")
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(cut_texts(F.col(text_col), capacity)).alias("piece", "t"))
    cut = cut.select(at(F.col("id"), F.col("piece")), "t").dropDuplicates(["at"])
    held = placed.filter("bin_id IS NOT NULL").select("bin_id", "bin_start", at(F.col(id_col), F.col("piece")), "n_words")
    found = held.join(cut, "at").select("bin_id", "bin_start", "at.id", "at.piece", "n_words", "t", F.length("t").cast("long").alias("n_chars"))
    before = Window.partitionBy("bin_id").orderBy("bin_start").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_chars") + len(separator)).over(before), F.lit(0)).cast("long")
    found = found.withColumn("char_start", start)
    bins = found.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list(F.struct("bin_start", "id", "piece", "n_words", "char_start", "n_chars", "t"))).alias("p"))
    piece = F.transform("p", lambda x: F.struct(*(x[c].alias(c) for c in ("id", "piece", "bin_start", "n_words", "char_start", "n_chars"))))
    return bins.select("bin_id", "n_words", piece.alias("pieces"), F.array_join(F.transform("p", lambda x: x["t"]), separator).alias("text"))


def cut_texts(text: Column, capacity: int) -> Column:
    """The pieces of `capacity` words that a text is cut into, each with the white space before its words and the last with that at
    the end; together they are the text. A text without words has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    unit = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?"

    def pieces(units):
        cuts = F.sequence(F.lit(0), ((F.size(units) - 1) / capacity).cast("int"))
        return F.when(F.size(units) > 0, F.transform(cuts, lambda k: F.array_join(F.slice(units, k * capacity + 1, F.lit(capacity)), ""))).otherwise(F.array().cast("array<string>"))

    # so few characters can't be more words than a piece has room for
    short = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) <= 2 * capacity, short).otherwise(let(F.regexp_extract_all(text, F.lit(unit), F.lit(0)), pieces))


def packed_pieces(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, shard_rows: int = 20_000) -> DataFrame:
    """The rows of best_fit with where each piece stands in its bin's sequence (char_start, n_chars) and the sequence's SHA-256.

    Texts without words have null in these. Rows are told apart by id and text, so ids may repeat: rows equal in both are cut alike
    and each has its own place. Other columns are ignored; an empty table gives an empty result. Places are written to the
    shared folder, as they are read twice: for the sequences and for rows without a bin."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = {"cluster": F.col(cluster_col)} if cluster_col else {}
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("of")).alias("key"), text.alias("text"), F.col(source_col).alias("source"), *(c.alias(k) for k, c in more.items()))
    placed = stored(best_fit(keyed, capacity, "key", cluster_col="cluster" if more else None, shard_rows=shard_rows), "places")
    bins = sequences(keyed, placed, capacity, "key").select("bin_id", F.sha2("text", 256).alias("sequence_sha256"), F.explode("pieces").alias("p"))
    at = [F.col("p.id.id").alias(id_col), "p.piece", "p.n_words", "bin_id", "p.bin_start", "p.char_start", "p.n_chars", "sequence_sha256"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("char_start", "long"), ("n_chars", "long"), ("sequence_sha256", "string"))]
    return bins.select(*at).unionByName(placed.filter("bin_id IS NULL").select(F.col("key.id").alias(id_col), "piece", "n_words", "bin_id", "bin_start", *none))
