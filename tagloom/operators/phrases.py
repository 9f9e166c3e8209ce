"""Texts in another script or spelling: the longest phrase of a table at each place is replaced, single characters being phrases too."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Phrases:
    """A table of phrases as one automaton."""

    def __init__(self, table: list[tuple[str, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase, other in table:
            self.automaton.add_word(phrase, (len(phrase), other))
        if table:
            self.automaton.make_automaton()

    def convert(self, text: str) -> str:
        """From left to right: the longest phrase that starts here, or else the character as it is."""
        if not len(self.automaton):
            return text
        at_start: dict[int, tuple[int, str]] = {}
        out: list[str] = []
        for end, (size, other) in self.automaton.iter(text):
            start = end + 1 - size
            if size > at_start.get(start, (0, ""))[0]:
                at_start[start] = (size, other)
        at = 0
        for start in sorted(at_start):
            if start >= at:
                size, other = at_start[start]
                out += (text[at:start], other)
                at = start + size
        return "".join([*out, text[at:]])


def _converted(table: list[tuple[str, str]], column: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(table)
        for batch in batches:
            k = batch.schema.get_field_index(column)
            texts = [None if t is None else phrases.convert(t) for t in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows


def converted(rows: DataFrame, table: DataFrame, column: str, most_chars: int = 16 << 20) -> DataFrame:
    """``rows`` with ``column`` converted by the phrases of ``table`` (phrase, other).

    A longer phrase comes before a shorter one at its place, an earlier place before a later one; what
    has been replaced isn't read again. Of equal phrases the least replacement counts; empty and null
    ones don't. Null texts stay null. The table goes to the executors: one of more than ``most_chars``
    characters is refused, as a place's longest phrase can't be told from a part of it.
    """
    known = table.where("phrase IS NOT NULL AND phrase <> '' AND other IS NOT NULL").groupBy("phrase").agg(F.min("other").alias("other"))
    chars = known.agg(F.sum(F.length("phrase") + F.length("other"))).first()[0] or 0
    if chars > most_chars:
        raise ValueError(f"{chars} characters of phrases; {most_chars} at most")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(_converted([tuple(r) for r in known.collect()], column), schema)
