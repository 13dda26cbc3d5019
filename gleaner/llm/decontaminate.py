"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long: the Jaccard similarity of the two says nothing, the
containment of the item in the document does.  Documents are partitioned by the size of
their shingle sets, and the sketch grows with the partition: one hash function deals shingles into
``SLOTS`` times as many registers as the partition's largest set has shingles, each keeping its
least hash.  A shingle of the document so keeps its register with probability of at least
(1 - exp(-1 / SLOTS)) * SLOTS, whatever the document's length.  Items are sketched once per
partition; an item is a candidate if a register of its holds the same hash in the document.
Items of few shingles, which chance could leave without a register, are looked up by all of
theirs.  Candidates are verified by exact containment of shingle sets, in the same task.

Defined cases: a null or empty text has no shingles and matches nothing; texts under five words
are one shingle; repeated documents and items each have their own rows; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import only, slices
from gleaner.llm.words import mix64, shingle_sets
from gleaner.operators.joins import join_list
from gleaner.session import store

WIDTH = 5
THRESHOLD = 0.8
SLOTS = 8
#: Items with fewer shingles are looked up by all of them.
FEW = 12
#: Items searched in one pass over the documents; more take more passes.
BLOCK_ITEMS = 20_000
SCHEMA = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint, containment double"


def _registers(shingles: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash per (owner, register) of ``2 ** bits`` registers, and its owner."""
    hashed = mix64(shingles)
    slot = hashed >> np.uint64(64 - bits)
    order = np.lexsort((hashed, slot, owner))
    hashed, slot, owner = hashed[order], slot[order], owner[order]
    first = np.ones(len(hashed), dtype=bool)
    first[1:] = (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])
    return hashed[first], owner[first]  # the leading bits of a hash are its register


class ItemSketches:
    """A block of items: their shingle sets, and per document size the registers to look for."""

    def __init__(self, item_ids: list, texts: list, slots: int = SLOTS, few: int = FEW):
        self.ids = item_ids
        self.shingles, self.offsets = shingle_sets(pa.array(texts, pa.string()), WIDTH)
        self.sizes = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.slots, self.few, self.by_bits = slots, few, {}

    def lookup(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes that make an item a candidate, and the items of each."""
        if bits not in self.by_bits:
            values, owner = _registers(self.shingles, self.owner, bits)
            small = self.sizes[self.owner] < self.few
            values = np.concatenate((values, mix64(self.shingles[small])))
            owner = np.concatenate((owner, self.owner[small]))
            order = np.argsort(values, kind="stable")
            self.by_bits[bits] = values[order], owner[order]
        return self.by_bits[bits]

    def search(self, shingles: np.ndarray, offsets: np.ndarray, threshold: float):
        """Rows (document, item, shared) of documents' shingle sets."""
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        partition = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)  # sets of up to 2 ** partition
        found = []
        for part in np.unique(partition[sizes > 0]):
            bits = int(part) + int(np.log2(self.slots))
            values, items = self.lookup(bits)
            mine = partition[owner] == part
            sketch, docs = _registers(shingles[mine], owner[mine], bits)
            small = np.isin(mix64(shingles[mine]), values)  # items of few shingles: all of the document's
            sketch = np.concatenate((sketch, mix64(shingles[mine][small])))
            docs = np.concatenate((docs, owner[mine][small]))
            low, high = np.searchsorted(values, sketch, "left"), np.searchsorted(values, sketch, "right")
            hit = high > low
            for a, b, d in zip(low[hit], high[hit], docs[hit], strict=True):
                found.append(np.stack((np.full(b - a, d), items[a:b]), axis=1))
        if not found:
            return
        for d, i in np.unique(np.concatenate(found), axis=0).tolist():
            item = self.shingles[self.offsets[i] : self.offsets[i + 1]]
            document = shingles[offsets[d] : offsets[d + 1]]
            at = np.minimum(np.searchsorted(document, item), len(document) - 1)
            shared = int((document[at] == item).sum())
            if shared >= threshold * len(item):
                yield d, i, shared


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment`` of items that documents hold.

    Documents are read where they lie and shuffled nowhere.  Items are handed to the tasks in
    blocks of a bounded number, one pass each.
    """
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text")
    listed = only(items, "item_id", "text")
    count = listed.count()
    blocks = max(1, -(-count // block_items))
    result = None
    for k in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def search(batches, shared=shared):
            sketches = ItemSketches(*shared.value)
            for piece in slices(batches):
                shingles, offsets = shingle_sets(piece.column(1), WIDTH)
                found = list(sketches.search(shingles, offsets, threshold))
                ids = piece.column(0).to_pylist()
                sizes = sketches.sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, _, _ in found], pa.int64()),
                        pa.array([sketches.ids[i] for _, i, _ in found], pa.int64()),
                        pa.array([int(sizes[i]) for _, i, _ in found], pa.int64()),
                        pa.array([s for _, _, s in found], pa.int64()),
                        pa.array([s / int(sizes[i]) for _, i, s in found], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                )

        found = texts.mapInArrow(search, SCHEMA)
        result = found if result is None else result.unionByName(found)
    return result


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no item, in ``docs``' columns; one with a null id cannot be told and stays."""
    leaks = store(find_leaks(docs, items, threshold).select("doc_id").distinct(), "leaks")
    return join_list(docs, leaks, ["doc_id"], "left_anti")


LEAKS_SQL = """
    WITH words AS (
      SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents
      UNION ALL
      SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') FROM benchmark),
    shingles AS (
      SELECT DISTINCT kind, id, array_to_string(w[k : k + 4], ' ') AS s
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
    items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i')
    SELECT d.id AS doc_id, i.id AS item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
    FROM items i JOIN shingles d ON d.kind = 'd' AND d.s = i.s
    GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n"""
