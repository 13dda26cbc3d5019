import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from gleaner.llm import token_orc
from gleaner.session import new_folder

ODD = [
    "", "  a  b ", "I'LL don't it's, ('s)", "<|startoftext|> x<|ENDOFTEXT|>!! foo.<|endoftext|>.",
    "T̈. İstanbul, Å; ΣΣΣ. x", "\x1c a\x1fb\x85c", "9,9. a9. 1234!! 你好, \U0001f600\U0001f600!",
    "a\x00b c​d", "é, é.", "가 ᄀ, k.́",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_orc.TOKENIZER))


@pytest.fixture(scope="module")
def mine():
    return token_orc.WordTokenizer(public_tokenizers.path(token_orc.TOKENIZER))


def test_ids_are_those_of_the_library(library, mine, doc_rows):
    texts = ODD + [t for _, t in doc_rows]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine.encode(pa.array(texts)).to_pylist() == expected
    assert mine.encode(pa.array(texts[::-1])).to_pylist() == expected[::-1]
    assert mine.encode(pa.array([], pa.string())).to_pylist() == []


def test_every_letter_before_every_tail(library, mine):
    """All letters of all scripts, alone, doubled and inside a word, before each mark of punctuation."""
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0x3400 <= c < 0x9FF0 and not 0xAC00 <= c < 0xD7A0 and c < 0x10000]
    texts = [" ".join(f"{c}{t} x{c}{t} {c}{c}y{t}{t}" for t in token_orc.TAIL) for c in letters]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = mine.encode(pa.array(texts)).to_pylist()
    assert [c for c, a, b in zip(letters, got, expected, strict=True) if a != b] == []


def test_random_words(library, mine):
    import random

    rng = random.Random(11)
    alphabet = "abzéßİıΣςаяÅ\u0301\u0307\u0958क'’-_0½" + token_orc.TAIL + "<|"
    texts = [" ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(60)) for _ in range(300)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine.encode(pa.array(texts)).to_pylist() == expected


def reference(library, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_index_of_files(spark, docs, doc_rows, library, monkeypatch):
    monkeypatch.setattr(token_orc.write_token_orc, "__defaults__", (token_orc.TOKENIZER, 2, 20_000))
    got = sorted(tuple(r) for r in token_orc.tokenize_to_orc(docs).collect())
    assert got == reference(library, doc_rows)


def test_odd_rows(odd, odd_rows, none, library):
    got = sorted(tuple(r) for r in token_orc.tokenize_to_orc(odd).collect())
    assert got == sorted(reference(library, [r[:2] for r in odd_rows]))
    assert token_orc.tokenize_to_orc(none).collect() == []


def test_files_are_pruned_and_split(spark, docs, doc_rows, library):
    folder = new_folder(spark, "orc")
    token_orc.write_token_orc(docs, folder, file_bytes=40_000)
    path = folder.removeprefix("file://")
    files = sorted(Path(path).glob("*.orc"))
    assert len(files) > 1
    for one in files:
        content = orc.ORCFile(str(one))
        ids = content.read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and content.compression == "ZSTD" and content.row_index_stride == 1000
    one = token_orc.read_token_orc(spark, folder).where("doc_id = 77")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan
    text = dict(doc_rows)[77]
    assert one.first()["ids"] == library.encode(text, add_special_tokens=False).ids + [2]
