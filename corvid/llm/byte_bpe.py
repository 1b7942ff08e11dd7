"""Byte-level BPE encoding and decoding with length-bucketed, padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Symbols of a padded matrix, characters handled at once, cached pieces, and the length beyond which a piece stands alone.
CELLS, CHUNK, CACHE, ALONE = 1 << 21, 1 << 21, 400_000, 2048


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of the merged token."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(8, int(len(keys) * 2.5).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.ranks[at] == NONE
            first = np.unique(at[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where two ids don't merge or one is padding (negative)."""
        out = np.full(left.shape, NONE, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[live].astype(np.uint64) << np.uint64(32) | right.ravel()[live].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        while len(live):
            ranks = self.ranks[slot]
            hit = self.keys[slot] == keys
            flat[live[hit]] = ranks[hit]
            on = ~hit & (ranks != NONE)
            live, keys, slot = live[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return flat.reshape(left.shape)


class ByteBpe:
    """Encoder and decoder for a rank file: base64 of a token's bytes, a space, its rank, a line each."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = PairTable(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.cache: dict[str, bytes] = {}

    def _matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of up to `width` bytes: a padded row each; finished rows leave the matrix each round."""
        out: list[bytes] = [b""] * len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        raw = np.frombuffer(b"".join(rows), np.uint8)
        cols = np.arange(width)
        m = np.full((len(rows), width + 1), -1, np.int32)
        m[:, :width][cols < sizes[:, None]] = self.byte[raw]
        live, rank = np.arange(len(rows)), self.pairs.find(m[:, :-1], m[:, 1:])
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            ended = best == NONE
            for k in np.flatnonzero(ended):
                out[live[k]] = m[k, : sizes[live[k]]].astype("<u4").tobytes()
            keep = ~ended
            live, m, rank, at, best = live[keep], m[keep], rank[keep], at[keep], best[keep]
            if not len(live):
                break
            sizes[live] -= 1
            width = int(sizes[live].max())
            here, cols = np.arange(len(live)), np.arange(width)
            m[here, at] = best
            m = np.concatenate([np.take_along_axis(m, cols + (cols > at[:, None]), 1), np.full((len(live), 1), -1, np.int32)], 1)
            rank = np.take_along_axis(rank, np.minimum(cols + (cols > at[:, None]), rank.shape[1] - 1), 1)
            rank[here, at] = self.pairs.find(m[here, at], m[here, at + 1])
            left = np.maximum(at - 1, 0)
            rank[here, left] = self.pairs.find(m[here, left], m[here, left + 1])
        return out

    def _alone(self, piece: bytes) -> bytes:
        """Ids of one very long piece: the same rounds over a single row, with minima by block and lazy compaction."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].astype(np.int32)
        size, block = len(ids), 512
        blocks = -(-size // block)
        rank = np.full(blocks * block, NONE, np.int32)
        rank[: size - 1] = self.pairs.find(ids[:-1], ids[1:])
        rank = rank.reshape(blocks, block)
        least = rank.min(axis=1)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)

        def put(i: int) -> None:
            j = after[i]
            b, c = divmod(i, block)
            rank[b, c] = self.pairs.find(ids[i : i + 1], ids[j : j + 1])[0] if j < size else NONE
            least[b] = rank[b].min()

        while least[b := int(least.argmin())] != NONE:
            i = b * block + int(rank[b].argmin())
            j = int(after[i])
            ids[i], ids[j] = least[b], -1
            rank[j // block, j % block] = NONE
            least[j // block] = rank[j // block].min()
            after[i] = k = after[j]
            if k < size:
                before[k] = i
            put(i)
            if before[i] >= 0:
                put(int(before[i]))
        return ids[ids >= 0].astype("<u4").tobytes()

    def learn(self, pieces) -> None:
        """Encode the pieces that the cache lacks, by length bucket."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in set(pieces):
            if p in self.cache:
                continue
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(raw) > ALONE:
                self.cache[p] = self._alone(raw)
            else:
                buckets.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                self.cache.update(zip((p for p, _ in part), self._matrix([r for _, r in part], width)))

    def runs(self, text: str):
        """Lists of pieces, one list for a text of usual length."""
        if len(text) <= CHUNK:
            yield self.pattern.findall(text)
            return
        it = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(it, CHUNK // 8)):
            yield run

    def encode(self, texts: list[str]):
        """For each text, an iterator over little-endian unsigned 32-bit ids in parts."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size := size + len(texts[end])) <= CHUNK:
                end += 1
            if end == at:  # one long text: in runs
                yield self._parts(texts[at])
                at += 1
                continue
            lists = [self.pattern.findall(t) for t in texts[at:end]]
            self.learn(p for x in lists for p in x)
            for x in lists:
                yield [b"".join(map(self.cache.__getitem__, x))]
            at = end

    def _parts(self, text: str):
        for run in self.runs(text):
            self.learn(run)
            yield b"".join(map(self.cache.__getitem__, run))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian uint32) themselves.

    Null and empty texts have no ids, and the digests of nothing. Null ids and repeated rows stay as they are;
    other input columns are ignored. Long texts are encoded in runs; the memory of a task is a run, a padded
    matrix and the bounded piece cache. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            rows = []
            for parts in bpe.encode([t.as_py() or "" for t in batch.column(1)]):
                ids_hash, text_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for ids in parts:
                    ids_hash.update(ids)
                    text_hash.update(bpe.decode(ids))
                    n += len(ids) // 4
                    if with_ids:
                        kept.append(ids)
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), b"".join(kept)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.binary()))]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if with_ids else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns][: len(names)], names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
