"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers."""

from __future__ import annotations

import heapq
import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's piece cache, and the pieces handled at once for a very long text.
CACHE, STEP = 400_000, 200_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class TokenCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary file of the `tokenizers` library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.start = [ids[c] for c in byte_symbols()]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.into = [ids[a + b] for a, b in pairs]
        special = [t["content"] for t in spec.get("added_tokens", ()) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Initial symbols minus merges: the lowest-rank adjacent pair goes first, the leftmost of equal ones."""
        size = len(piece)
        if size < 2:
            return size
        rank, into = self.rank, self.into
        symbol = [self.start[b] for b in piece]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [r * size + i for i in range(size - 1) if (r := rank.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        count = size
        while heap:
            r, i = divmod(heapq.heappop(heap), size)
            j = after[i]
            if symbol[i] < 0 or j >= size or rank.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            count -= 1
            symbol[i], symbol[j] = into[r], -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (s := rank.get(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, s * size + i)
            if (h := before[i]) >= 0 and (s := rank.get(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(heap, s * size + h)
        return count

    def _plain(self, text: str) -> int:
        total, cache = 0, self.cache
        found = iter([self.pattern.findall(text)]) if len(text) <= 1 << 20 else _runs(self.pattern, text)
        for pieces in found:
            for p in pieces:
                n = cache.get(p)
                if n is None:
                    n = self.merged(p.encode())
                    if len(p) <= 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[p] = n
                total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token, as the library's default has it."""
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + (self._plain(text[at:]) if at else self._plain(text))


def _runs(pattern, text: str):
    it = (m.group() for m in pattern.finditer(text))
    while run := list(islice(it, STEP)):
        yield run


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary; reused by later tasks of the same worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows stay repeated; other
    columns of the input are ignored, whatever their names. An empty table gives an empty result. One row is
    held at a time, a long text in runs of pieces. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tokens = counter(vocabulary)
        for batch in batches:
            counts = [tokens.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
