"""Search for long keyword lists: one pass over a text, whatever the list's length.

The list is a table.  It becomes an Aho-Corasick automaton, which meets every occurrence of every keyword
while it reads a text once; overlapping occurrences of one keyword are then passed over from
the left, as replacing it would do.  The automaton is sent to the tasks once, and an automaton
holds a bounded part of the list: a longer list takes a pass over the texts for each part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gleaner.operators.joins import measured_bytes
from gleaner.session import cut_lineage

#: Text of the keywords that one automaton holds; it takes some fifty times that in memory.
AUTOMATON_BYTES = 4 << 20
#: Rows whose matches a task holds at once.
SLICE_ROWS = 256
FOUND = ArrayType(StructType([StructField("keyword", StringType()), StructField("freq", IntegerType())]))
_FOUND = pa.list_(pa.struct([("keyword", pa.string()), ("freq", pa.int32())]))


def automaton_of(words: Sequence[str]):
    """The automaton of distinct words that are not empty; each carries its own length."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for word in words:
        made.add_word(word, (word, len(word)))
    made.make_automaton()
    return made


def occurrences(automaton, text: str) -> dict[str, int]:
    """Keywords in ``text`` with the number of their occurrences that do not overlap, from the left."""
    counts: dict[str, int] = {}
    ends: dict[str, int] = {}
    for end, (word, length) in automaton.iter(text):
        if end - length >= ends.get(word, -1):
            ends[word] = end
            counts[word] = counts.get(word, 0) + 1
    return counts


def _parts(keywords: DataFrame, most: int) -> Iterator[list[str]]:
    """The distinct keywords, a bounded part at a time."""
    words = keywords.select(F.col(f"`{keywords.columns[0]}`").cast("string").alias("word"))
    words = cut_lineage(words.where("word <> ''").distinct())
    n = max(1, -(-measured_bytes(words) // most))
    for k in range(n):
        part = words.where(F.pmod(F.xxhash64("word"), F.lit(n)) == k) if n > 1 else words
        yield part.toArrow()["word"].to_pylist()


def with_found(df: DataFrame, text: str, keywords: DataFrame, max_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``df`` without the column ``text`` and with ``found``: an array of ``keyword, freq`` in keyword order, null for a null text.

    ``keywords`` is a table's first column; nulls and empty keywords find nothing.  The text is
    compared as it is: fold both sides before, or neither.  The list is read when this is called.
    """
    context = df.sparkSession.sparkContext
    parts = list(_parts(keywords, max_bytes))
    others = [f for f in df.schema.fields if f.name != text]
    for number, words in enumerate(parts):
        sent = context.broadcast(automaton_of(words) if words else None)
        last = number == len(parts) - 1
        if number:  # texts are read again: each part of the list is a job of its own
            df = cut_lineage(df)
        fields = others + [StructField("found", FOUND)] + ([] if last else [f for f in df.schema.fields if f.name == text])
        df = df.mapInArrow(_finder(sent, text, [f.name for f in fields]), StructType(fields))
    return df


def _finder(sent, text: str, columns: list[str]):
    def found_in(texts, before):
        """The column ``found`` of some rows, without a Python object for each of its entries."""
        offsets, words, freqs = [], [], []
        for row, value in enumerate(texts):
            value = value.as_py()
            offsets.append(None if value is None else len(words))
            if value is None:
                continue
            counts = {} if before is None else {e["keyword"]: e["freq"] for e in before[row].as_py() or ()}
            if sent.value is not None:
                counts |= occurrences(sent.value, value)
            for word in sorted(counts):
                words.append(word)
                freqs.append(counts[word])
        entries = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(freqs, pa.int32())], names=["keyword", "freq"])
        return pa.ListArray.from_arrays(pa.array([*offsets, len(words)], pa.int32()), entries, type=_FOUND)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                place = batch.schema.get_field_index("found")
                texts = batch.column(batch.schema.get_field_index(text))
                found = found_in(texts, batch.column(place) if place >= 0 else None)
                made = {"found": found}
                yield pa.RecordBatch.from_arrays(
                    [made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in columns], names=columns
                )

    return run
