"""Language-model scores: smoothed n-grams as a weighted backoff automaton, traversed once per text.

The corpus is written as blocks of texts. Each block sends its distinct n-grams and their training counts to buckets by
hash; a bucket sums them over the corpus and sends every block the totals of the n-grams that the block holds. So a
block builds the part of the automaton that its own texts can reach, with counts from all training texts, and no
task, driver or broadcast ever holds the whole model.
"""

from __future__ import annotations

import math
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvid.llm.shared import mix, slices, stored, utf8
from corvid.llm.shingles import word_hashes

#: Bytes of text in a block, n-gram occurrences a bucket should have, bytes hashed at once.
BLOCK, BUCKET, SLICE = 5 << 20, 2_000_000, 1 << 18
#: Bytes that a word is taken to have with its space, where the number of buckets is chosen.
WORD_BYTES = 6
#: The bits that tell n-grams of two words or more apart: a byte fewer to send for each.
LONGER = ~np.uint64(0xFF)
#: Hashes that stand for a text's begin and end.
BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)


def is_held_out(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


class Grams:
    """The distinct n-grams of a block, by level: grams of 1..order tokens that end at each place."""

    def __init__(self, ids: list, column, order: int, modulus: int, remainder: int):
        raw, bounds = utf8(column)
        parts = [word_hashes(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in slices(bounds, SLICE)]
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        sizes = np.concatenate([np.diff(f) for _, f in parts]) if parts else np.zeros(0, np.int64)
        #: each text is BEGIN, its words, END
        self.start = np.concatenate([[0], np.cumsum(sizes + 2)])
        tokens = np.empty(self.start[-1], np.uint64)
        place = np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
        tokens[place] = hashes
        tokens[self.start[:-1]] = BEGIN
        tokens[self.start[1:] - 1] = END
        self.held_out = np.array([is_held_out(i, modulus, remainder) for i in ids], bool)
        train = np.repeat(~self.held_out, sizes + 2)
        depth = np.arange(len(tokens)) - np.repeat(self.start[:-1], sizes + 2)
        self.keys, self.place, self.first, self.count = [], [], [], []
        key = np.zeros(len(tokens), np.uint64)
        for m in range(order):
            # the gram of m + 1 tokens that ends here, from the one of m tokens that ends one place before
            before = np.concatenate([np.zeros(1, np.uint64), key[:-1]])
            key = mix(before * np.uint64(0xD1342543DE82EF95) + tokens + np.uint64(m))
            at = np.flatnonzero(depth >= m)
            keys = key[at] & LONGER if m else key[at]
            order_of = np.argsort(keys)
            keys, at = keys[order_of], at[order_of]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            runs = np.diff(new, append=len(keys))
            spread = np.full(len(tokens), -1, np.int64)
            spread[at] = np.repeat(np.arange(len(new)), runs)
            self.keys.append(keys[new])
            self.first.append(at[new])  # any place of the gram does
            self.place.append(spread)
            self.count.append(np.add.reduceat(train[at], new, dtype=np.uint32) if len(new) else np.zeros(0, np.uint32))

    def train_tokens(self) -> int:
        return int((np.diff(self.start) - 1)[~self.held_out].sum())


class BackoffAutomaton:
    """States are contexts, the empty one (0) the root; an arc reads a word with its log10 probability.

    Where a state has no arc for a word, its failure arc leads, at the state's weight, to the context without its
    first word. Probabilities are (count + mass * lower) / (context count + mass), lower being the next shorter
    context's, and at the root (count + 1) / (tokens + kinds + 1); so failure weights are log10 of
    mass / (context count + mass), and each state's probabilities sum to one. The arc that a state of d words would
    have at a place is that of the d + 1 words which end there, so arcs are found by place and depth."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, kinds: int, mass: float):
        order = len(totals)
        counts = [t.astype(np.float64) for t in totals]
        fail, weight, depth = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        log, end, self.arcs = [], [], []
        states, arcs = 1, 0
        chance = (counts[0] + 1) / (tokens + kinds + 1)
        state = None
        for m in range(order):
            first = grams.first[m]
            seen = counts[m] > 0 if m else np.ones(len(first), bool)  # the root reads unknown words too
            suffix = state[grams.place[m - 1][first]] if m else np.zeros(len(first), np.int64)
            if m:
                context = grams.place[m - 1][first - 1]
                chance = (counts[m] + mass * chance[grams.place[m - 1][first]]) / (counts[m - 1][context] + mass)
            state = suffix
            if m < order - 1:
                known = counts[m] > 0
                state = np.where(known, states + np.cumsum(known) - 1, suffix)
                fail.append(suffix[known])
                weight.append(np.log10(mass / (counts[m][known] + mass)))
                depth.append(np.full(known.sum(), m + 1))
                states += int(known.sum())
            number = np.append(np.where(seen, arcs + np.cumsum(seen) - 1, -1), -1)
            self.arcs.append(number[grams.place[m]])
            arcs += int(seen.sum())
            log.append(np.log10(chance[seen]))
            end.append(state[seen])
            if m == 0:
                self.begin = int(state[grams.place[0][grams.start[0]]])
        # machine numbers in arrays: a list would hold an object for each
        self.log, self.weight = (array("d", np.concatenate(x).tobytes()) for x in (log, weight))
        self.end, self.fail, self.depth = (array("q", np.concatenate(x).astype(np.int64).tobytes()) for x in (end, fail, depth))

    def score(self, start: int, end: int) -> float:
        """log10 probability of the words at the places start..end: one traversal from the begin state."""
        log, to, fail, weight, depth = self.log, self.end, self.fail, self.weight, self.depth
        state, total = self.begin, 0.0
        for arcs in zip(*(a[start:end].tolist() for a in self.arcs)):
            arc = arcs[depth[state]]
            while arc < 0:
                total += weight[state]
                state = fail[state]
                arc = arcs[depth[state]]
            total += log[arc]
            state = to[arc]
        return total


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(block, n_bytes, blob): texts with their ids, compressed, in blocks of about block_bytes."""

    def run(batches):
        held, size = [], 0

        def packed():
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            row = [[random.getrandbits(62)], [size], [sink.getvalue().to_pybytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.binary()))], ["block", "n_bytes", "blob"])

        for batch in batches:
            _, bounds = utf8(batch.column(1))
            at = 0
            for k in range(batch.num_rows):
                size += int(bounds[k + 1] - bounds[k]) + 16
                if size >= block_bytes:
                    held.append(batch.slice(at, k + 1 - at))
                    yield packed()
                    at, held, size = k + 1, [], 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield packed()

    return texts.mapInArrow(run, "block long, n_bytes long, blob binary")


def _opened(blob: bytes, order: int, modulus: int, remainder: int) -> tuple[pa.Array, Grams]:
    table = pa.ipc.open_stream(blob).read_all()
    ids = table.column(0).combine_chunks()
    return ids, Grams(ids.to_pylist(), table.column(1).combine_chunks(), order, modulus, remainder)


def _squeezed(values: np.ndarray) -> bytes:
    """Integers as bytes, the first bytes of all together, then the second, and so on: high bytes are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _unsqueezed(data, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _cuts(keys: np.ndarray, buckets: int):
    """(bucket, start, end) of each bucket that has any of the sorted keys: work by keys, however many buckets there are."""
    high = keys >> np.uint64(32)  # a bucket is a range of the upper half, so that the product fits
    bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, mass: float = 150.0, modulus: int = 7, remainder: int = 2, block_bytes: int = BLOCK, bucket_grams: int = BUCKET) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words (A-Z lower-cased) and one end. Rows whose crc32(id as text) modulo `modulus` is not
    `remainder` train the model (a null id is the empty text); others are held out. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over tokens, c being the token's training count, N all and V distinct training tokens;
    n_known counts tokens with c > 0; score is the log10 probability under the `order`-gram automaton. Null, empty and
    blank texts are their end alone. Repeated rows count and are scored each; other columns are ignored; an empty
    table gives an empty result; without training rows every c is 0. Words are told apart by
    64-bit hashes, longer n-grams by 56 bits of theirs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(_blocks(texts, block_bytes), "blocks", "uncompressed")
    n_bytes = int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets = max(8, -(-n_bytes * order // (WORD_BYTES * bucket_grams)))

    def sent(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = _opened(blob.as_buffer(), order, modulus, remainder)[1]
                rows = [(block % buckets, block, -1, b"", grams.train_tokens().to_bytes(8, "little"))]
                for m, (keys, counts) in enumerate(zip(grams.keys, grams.count)):
                    for b, start, end in _cuts(keys, buckets):
                        rows.append((b, block, m, _squeezed(np.diff(keys[start:end], prepend=np.uint64(0))), _squeezed(counts[start:end])))
                types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "block", "level", "keys", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        rows, kinds = [], 0
        bucket = table.column("bucket")[0].as_py()
        begin = mix(np.zeros(1, np.uint64) + BEGIN)[0]
        for m in range(order):
            part = table.filter(pa.compute.equal(table.column("level"), m))
            if not part.num_rows:
                continue
            keys = [np.cumsum(_unsqueezed(k.as_buffer(), np.uint64), dtype=np.uint64) for k in part.column("keys")]
            counts = np.concatenate([_unsqueezed(c.as_buffer(), np.uint32) for c in part.column("counts")])
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(unique))
            if m == 0:
                kinds = int(((total > 0) & (unique != begin)).sum())
            total = total.astype(np.uint64 if total.max(initial=0) >= 2**32 else np.uint32)[inverse]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            rows += [(block, bucket, m, _squeezed(total[at[i] : at[i + 1]]), 0, total.itemsize) for i, block in enumerate(part.column("block").to_pylist())]
        rows.append((-1, bucket, -1, b"", kinds, 4))
        told = table.filter(pa.compute.equal(table.column("level"), -1)).column("counts").to_pylist()
        rows.append((-2, bucket, -1, b"", sum(int.from_bytes(n, "little") for n in told), 4))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["block", "bucket", "level", "totals", "kinds", "width"])

    counted = blocks.select("block", "blob").mapInArrow(sent, "bucket int, block long, level int, keys binary, counts binary")
    model = counted.groupBy("bucket").applyInArrow(summed, "block long, bucket int, level int, totals binary, kinds long, width int")
    model = stored(model, "model")
    kinds, n_train = (int(model.filter(F.col("block") == k).agg(F.sum("kinds")).first()[0] or 0) for k in (-1, -2))
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by([("level", "ascending"), ("bucket", "ascending")])
        for blob in left.column("blob"):
            ids, grams = _opened(blob.as_buffer(), order, modulus, remainder)
            totals = []
            for m in range(order):
                part = right.filter(pa.compute.equal(right.column("level"), m))
                totals.append(np.concatenate([_unsqueezed(t.as_buffer(), np.uint32 if w == 4 else np.uint64) for t, w in zip(part.column("totals"), part.column("width").to_pylist())]))
            grams.keys = grams.count = ()  # the totals stand for both
            automaton = BackoffAutomaton(grams, totals, n_train, kinds, mass)
            c = totals[0][grams.place[0]].astype(np.float64)
            plus, known = np.log10(c + 1), c > 0
            del part, totals
            grams.place = grams.first = ()
            lows = math.log10(n_train + kinds + 1)
            n, k, base, score = [], [], [], []
            for a, b in zip(grams.start[:-1] + 1, grams.start[1:]):
                n.append(b - a)
                k.append(int(known[a:b].sum()))
                base.append(float(plus[a:b].sum()) - (b - a) * lows)
                score.append(automaton.score(a, b))
            out.append(pa.table([ids, pa.array(grams.held_out), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([n_train] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=names))
        if not out:
            return pa.table([pa.array([], t) for t in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        return pa.concat_tables(out)

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    grouped = blocks.select("block", "blob").groupBy("block").cogroup(model.filter("block >= 0").groupBy("block"))
    return grouped.applyInArrow(scored, schema).withColumnRenamed("id", id_col)
