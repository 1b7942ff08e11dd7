"""Importance resampling towards a target distribution: hashed n-gram counts, log-ratio weights, Gumbel top-k.

Two passes over the texts and no shuffle of them. The first adds up counts by bucket, the second sums a document's gains;
between the two stands one table of as many rows as there are buckets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.ranges import running
from corvid.llm.shared import slices, stored, utf8

#: Bytes of text whose words share a dictionary.
BLOCK = 4 << 20
#: By byte: whether it belongs to a word (digits, letters, all beyond ASCII), and its lower case.
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def block_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(ids, words, first): the id of each word of the texts in raw, the distinct words, and each text's first word.

    Ids are the places of words in the block's dictionary, so equal words have equal ids, exactly."""
    word = _IS_WORD[raw]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    inner = np.unique(inner[word[inner] & word[inner - 1]])  # a text ends in a word and the next starts with one
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(inner):
        starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    data = _LOWER[raw[word]]
    made = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return made.indices.to_numpy().astype(np.int64), made.dictionary, np.searchsorted(starts, bounds)


def block_features(ids: np.ndarray, words: pa.Array, first: np.ndarray, most: int, buckets: int):
    """For each n up to `most`: (bucket of each n-gram in the order of the texts, the text of each).

    An n-gram is a tuple of word ids. Tuples get ids in turn: one of n words is that of its first n - 1 and a word, and the
    distinct ones are numbered. The bytes of each distinct tuple are hashed once, and its bucket joined back by its id."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    spelled = [w.as_py() for w in words]
    crcs = np.array([zlib.crc32(w) for w in spelled], np.int64)
    tuples = ids
    for n in range(1, most + 1):
        if n > 1:
            whole = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
            held = np.zeros(len(ids), np.int64)
            held[whole] = tuples[whole] * len(spelled) + ids[whole + n - 1]
            distinct, of = np.unique(held[whole], return_inverse=True)
            before, last = np.divmod(distinct, max(len(spelled), 1))
            # the checksum of bytes goes on from that of their start
            crcs = np.array([zlib.crc32(b" " + spelled[w], int(crcs[t])) for t, w in zip(before, last)], np.int64)
            tuples = np.zeros(len(ids), np.int64)
            tuples[whole] = of
            yield (crcs % buckets)[of] if len(of) else np.zeros(0, np.int64), text[whole]
        else:
            yield (crcs % buckets)[ids] if len(ids) else np.zeros(0, np.int64), text


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all n-grams of up to `most` words of a table's texts; buckets without any have no row.

    A task sends one row for each bucket at most, whatever its rows."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, bounds = utf8(batch.column(0))
            for a, b in slices(bounds, BLOCK):
                found = block_words(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                for at, _ in block_features(*found, most, buckets):
                    total += np.bincount(at, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket, from two tables of bucket_counts: the floor of 1000 times the logarithm of how much
    likelier the bucket is in the target, each with one more of every bucket."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(total.s + buckets)) / ((s + 1) * F.lit(total.t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row. The gains, a number for each bucket, go along with the tasks."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # as many rows as there are buckets
        table[r.bucket] = r.gain
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["id", "n_words", "n_features", "weight"]

    def run(batches):
        by_bucket = shared.value
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            for a, b in slices(bounds, BLOCK):
                ids, words, first = block_words(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                count, weight = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for at, text in block_features(ids, words, first, most, buckets):
                    sums = np.concatenate([[0], np.cumsum(by_bucket[at])])
                    place = np.searchsorted(text, np.arange(b - a + 1))
                    count += np.diff(place)
                    weight += np.diff(sums[place])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.array(count), pa.array(weight)], names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return out.select(F.col("id").alias(id_col), *names[1:])


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int | str = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Per row: id, n_features, weight, score, rank (1, 2, ... of those drawn, else null).

    Without replacement: percent of the rows with min_words words or more, rounded down, are drawn by the highest score,
    the weight and Gumbel noise from a hash of seed and id. Ties go to the smaller id, null ids last, then by any order.
    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null and empty texts,
    and texts without words, have no features and weight 0. An empty target or table is one without features.
    Repeated rows are rows of their own with the same score. Other columns are ignored, whatever their names.
    Only ids and numbers pass a shuffle; places come from ranges of the scores, whose ties are split by id.
    """
    counts = [stored(bucket_counts(x, most, buckets, col), "buckets") for x, col in ((docs, text_col), (target, target_text))]
    gain = gains(*counts, buckets)
    rows = weighed(docs, gain, most, buckets, id_col, text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    eligible = F.col("n_words") >= min_words
    rows = stored(rows.withColumn("score", F.col("weight") + noise).withColumn("__late", (~eligible).cast("int")).withColumn("__at", F.monotonically_increasing_id()), "importance")
    drawn = rows.filter("__late = 0").count() * percent // 100
    placed = running(rows, [F.col("__late"), F.desc("score"), F.asc_nulls_last(id_col), F.col("__at")])
    return placed.select(id_col, "n_features", "weight", "score", F.when((F.col("__late") == 0) & (F.col("nth") <= drawn), F.col("nth").cast("long")).alias("rank"))
