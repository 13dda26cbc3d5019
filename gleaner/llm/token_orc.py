"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

Texts are dealt into ranges of ``doc_id``, tokenized where they lie and written in order, one
file per range, so that every file, stripe and row group covers a narrow span of ids.  ORC
stores the ids of a stripe run-length encoded; a reader of some documents skips files,
stripes and row groups by their statistics and Bloom filters, and Spark reads large files
stripe by stripe in parallel.

Defined cases: a null text is an empty one and gives the end id alone; a null ``doc_id`` sorts
first; rows with equal ids are ordered by a hash of their texts where ranges part them, within
a file by their ids' checksum, then length; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import kept_in_worker, only, slices
from gleaner.operators.joins import join_list
from gleaner.session import new_folder, store

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Texts' bytes a file; about as many bytes of ids.
FILE_BYTES = 48 << 20
#: Punctuation that the tokenizer never joins with a letter before it.
TAIL = ".,!*#%$&|;:?)\"]>"
#: Code points (Latin, Greek, Cyrillic) among which letters are sought that can be told from what follows them.
LETTERS = 0x530
#: Words that go through the library as one text.
TOGETHER = 2000


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts`` and are ``sizes`` long, one run after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class WordTokenizer:
    """``tokenizers`` on the distinct words of a batch.

    The tokenizer drops white space and never joins what it separates, so that a text's ids are its
    words' ids in a row; and punctuation behind a letter is a piece of its own.  Not so behind
    letters that it takes apart, such as those whose lower case ends in a mark: which letters are
    sound is asked of the tokenizer itself, and words with others stay whole.  Distinct words of sound
    letters go through the library many at once, told apart by the marks of word ends, all other pieces
    one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        sound = "".join(c for c in map(chr, range(LETTERS)) if c.isalpha() and self._is_sound(c))
        self.ends_sound, self.all_sound = f"[{sound}]$", f"^[{sound}]+$"

    def _is_sound(self, letter: str) -> bool:
        """Whether letters before and punctuation after this one are told apart from it as from any letter."""
        for text, cuts in ((f"{letter}.", 2), (f"a{letter}a.", 2), (f"{letter}{letter}{TAIL}", 2)):
            normal = self.tokenizer.normalizer.normalize_str(text)
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)) != cuts or len(normal) != len(text):
                return False
        return True

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each piece's begin and how many they are."""
        plain = pc.match_substring_regex(pieces, self.all_sound).to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(pieces), np.int64)
        found, order, unsure = [], [], [np.flatnonzero(~plain)]
        joined = pc.binary_join_element_wise(pieces.filter(pa.array(plain)), pa.scalar("", pieces.type), pa.scalar(" ", pieces.type))
        places, at = np.flatnonzero(plain), np.asarray(joined.buffers()[1]).view(np.int64) if len(joined) else np.zeros(1, np.int64)
        data = joined.buffers()[2].to_pybytes() if len(joined) else b""
        starts = range(0, len(places), TOGETHER)
        texts = [data[at[k] : at[min(k + TOGETHER, len(places))]].decode() for k in starts]
        for k, encoded in zip(starts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids, mine = np.array(encoded.ids, np.int32), places[k : k + TOGETHER]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(mine):  # not expected of sound letters
                unsure.append(mine)
                continue
            sizes[mine] = np.diff(ends, prepend=0)
            found.append(ids)
            order.append(mine)
        rest = np.concatenate(unsure)
        encoded = self.tokenizer.encode_batch_fast(pieces.take(pa.array(rest)).to_pylist(), add_special_tokens=False)
        lists = [e.ids for e in encoded]
        sizes[rest] = np.fromiter(map(len, lists), np.int64, count=len(lists))
        found.append(np.array([i for ids in lists for i in ids], np.int32))
        order = np.concatenate([*order, rest])
        begins = np.zeros(len(pieces), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found), begins, sizes

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words: their letters' ids and their tail's, if they can be parted."""
        heads = pc.utf8_rtrim(words, TAIL)
        parted = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(words)), pc.match_substring_regex(heads, self.ends_sound))
        # special tokens may hold punctuation: such words stay whole
        parted = pc.and_not(parted, pc.match_substring(words, "<|"))
        is_parted = parted.to_numpy(zero_copy_only=False)
        tails = pc.replace_substring_regex(words.filter(parted), pattern=f"^.*[^{TAIL.replace(']', chr(92) + ']')}]", replacement="")
        pieces = pc.dictionary_encode(pa.concat_arrays([pc.if_else(parted, heads, words), tails]))
        values, begins, sizes = self._piece_ids(pieces.dictionary)
        of = pieces.indices.to_numpy()
        first, second = of[: len(words)], of[len(words) :]
        # a word's pieces stand one after the other: two places a word, the second may be empty
        both_begin, both_size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        both_begin[:, 0], both_size[:, 0] = begins[first], sizes[first]
        both_begin[is_parted, 1], both_size[is_parted, 1] = begins[second], sizes[second]
        flat = values[_runs(both_begin.ravel(), both_size.ravel())]
        size = both_size.sum(axis=1)
        return flat, np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = pc.dictionary_encode(words.flatten())
        values, begins, sizes = self._word_ids(flat.dictionary)
        at = flat.indices.to_numpy()
        ids = values[_runs(begins[at], sizes[at])]
        ends = np.concatenate(([0], np.cumsum(sizes[at])))
        offsets = ends[np.asarray(words.offsets)]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _with_end(lists: pa.ListArray, end_id: int) -> pa.ListArray:
    offsets, values = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
    rows = np.arange(1, len(offsets))
    out = np.insert(values, offsets[1:], end_id).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], offsets[1:] + rows)).astype(np.int32)), pa.array(out))


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` of ``doc_id, text``: narrow, in the order of the input."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)
        encoder = kept_in_worker(f"tokenizer {path}", lambda: WordTokenizer(path))
        for part in slices(batches):
            texts = pc.fill_null(part.column(1), "")
            ids = _with_end(encoder.encode(texts), end_id)
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def write_token_orc(
    docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> None:
    """Write ``doc_id, ids`` in ascending ``doc_id`` order: the files' names follow the ranges of ids."""
    docs = only(docs, "doc_id", "text")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, round(volume / file_bytes))
    # texts are dealt before they are tokenized: dealing out looks at its input twice
    dealt = docs.repartitionByRange(ranges, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    (
        encode_documents(dealt, tokenizer, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "zstd")
        .orc(folder)
    )


def read_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ids``; filters on ``doc_id`` reach the files' statistics and Bloom filters."""
    return spark.read.schema("doc_id bigint, ids array<int>").orc(folder)


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files.

    Ids leave the task that reads them only as checksums.  ``start`` adds up the documents
    within a file and the files before it: files cover ranges, and only a row per file is ordered
    in one task.
    """

    def checksums(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            values = memoryview(np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2)],
                names=["doc_id", "n_tokens", "ids_crc32", "file"],
            )

    stored = read_token_orc(spark, folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string"
    rows = stored.mapInArrow(checksums, schema)
    rows = store(rows, "index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    before = Window.partitionBy(F.lit(1)).orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens")
    running = F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = join_list(rows.withColumn("_start", running), files, ["file"])
    return placed.select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")




def tokenize_to_orc(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new folder in the shared folder and return its index."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write_token_orc(docs, folder, tokenizer, end_id)
    return token_index(spark, folder)
