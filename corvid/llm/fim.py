"""Fill-in-middle: documents cut into prefix, middle and suffix at unit boundaries found by one automaton's events."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import let

#: The ASCII characters at which words end, and what marks the parts of an output.
SPACES = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Events held at once, and characters of output sent at once.
_EVENTS, _CHARS = 1 << 16, 1 << 22


@dataclass(frozen=True)
class Ranks:
    """The white space of a text as runs [starts[k], ends[k]), in code points, and what follows from it."""

    length: int
    starts: np.ndarray
    ends: np.ndarray
    marked: bool  # a sentinel occurs

    @property
    def units(self) -> int:
        """A unit is a word with the white space before it; white space at the very end is one of its own."""
        return len(self._stops) + self._tail

    @property
    def _tail(self) -> int:
        return int(len(self.ends) > 0 and self.ends[-1] == self.length)

    @property
    def _stops(self) -> np.ndarray:
        """Where words end: at each run that doesn't start the text, and at its end after a word."""
        stops = self.starts[1:] if len(self.starts) and self.starts[0] == 0 else self.starts
        return stops if self._tail or not self.length else np.append(stops, self.length)

    def end_of(self, rank: int) -> int:
        """Code points before the end of the rank-th unit."""
        return 0 if rank == 0 else int(self._stops[rank - 1]) if rank <= len(self._stops) else self.length


class Scanner:
    """One Aho-Corasick automaton over the white space characters and the sentinels."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for c in SPACES:
            self.automaton.add_word(c, 0)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            self.automaton.add_word(mark, 1)
        self.automaton.make_automaton()

    def ranks(self, text: str) -> Ranks:
        """One pass over a text. Its events are sparse: between two of them lies a word or nothing, so a gap of more than
        one character counts as one unit and no other character is looked at. Events are folded into runs as they come."""
        starts, ends, marked, last = [], [], False, -2
        events: list[int] = []

        def fold():
            nonlocal last
            at = np.array(events, np.int64)
            first = np.empty(len(at), bool)
            first[0], first[1:] = at[0] != last + 1, np.diff(at) != 1
            if not first[0]:
                ends[-1] = ends[-1][:-1]  # the run goes on
            starts.append(at[first])
            ends.append(at[np.append(first[1:], True)] + 1)
            last = int(at[-1])
            events.clear()

        for at, kind in self.automaton.iter(text):
            if kind:
                marked = True
                continue
            events.append(at)
            if len(events) == _EVENTS:
                fold()
        if events:
            fold()
        none = np.zeros(0, np.int64)
        return Ranks(len(text), np.concatenate(starts or [none]), np.concatenate(ends or [none]), marked)


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def draws(seed: int | str, name: str) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of seed and name, as unsigned integers."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def rearranged(text: str, name: str, seed: int | str = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    found = scanner().ranks(text)
    n, (h1, h2, h3, h4) = found.units, draws(seed, name)
    if not text or found.marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (found.end_of(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int | str = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Of 100 draws `rate` are rearranged, `spm` of 100 of those with the suffix first; both cuts are uniform over unit
    boundaries. Draws hang on seed and id alone, so repeated ids are cut at the same ranks and reruns agree. Null and
    empty texts are plain and empty; texts of white space are one unit; a text that holds a sentinel stays plain; a null
    id is drawn as the empty name. Other columns are ignored, whatever their names; an empty table gives an empty
    result. A text of any length is scanned once; batches of output are sent by size. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(batches):
        for batch in batches:
            start, held, rows = 0, 0, []

            def sent(end):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns[:-1], columns[-1].cast(pa.string())], names)

            for k in range(batch.num_rows):
                rows.append(rearranged(batch.column(2)[k].as_py() or "", batch.column(1)[k].as_py() or "", seed, rate, spm))
                held += len(rows[-1][-1])
                if held >= _CHARS or k == batch.num_rows - 1:
                    yield sent(k + 1)
                    start, held, rows = k + 1, 0, []

    source = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("id").alias(id_col), *names[1:])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A rearranged text holds no sentinel, and no two of them overlap, so that the
    three in the output are the only ones."""

    def joined(p):
        first, second, middle = (F.get(p, F.lit(k)) for k in (1, 2, 3))
        return F.when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))

    return F.when(form == "plain", output).otherwise(let(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), joined))
