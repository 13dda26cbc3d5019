import random
import re

import pytest
from pyspark.sql import functions as F

WORDS = re.compile("[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall(text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


@pytest.fixture(scope="session")
def brute():
    class Brute:
        pass

    Brute.words, Brute.shingles, Brute.LOWER = staticmethod(words), staticmethod(shingles), LOWER
    return Brute


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, wordless, short, repeated, tied and very long texts."""
    rng = random.Random(5)
    prose = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300))
    long = " ".join("".join(rng.choices("mnopqrst", k=rng.randint(1, 7))) for _ in range(60_000))
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\x0c\r ", None, "a"),
        (4, "word", "en", None),
        (5, prose, "en", "a"),
        (5, prose, "en", "a"),
        (6, prose.upper(), None, None),
        (7, prose + " tail", "en", "b"),
        (8, long, "en", "b"),
        (9, "same line\nsame line\nsame line\n\n" + prose[:400], "de", "b"),
        (10, "é ü ß \U0001f600 日本語 " + prose[:300], "de", "c"),
        (11, "mail a.b@c.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1", "fr", "c"),
        (12, "a\x00b " * 200, "fr", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same as a table, with columns named like those operators make."""
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(odd_rows, schema).withColumn("n_chars", F.expr("cast(length(text) as bigint)"))
    extra = "key label rep size start taken target rank shard quota hash first last group twin kept t1 t2 part component_id _at _of _key"
    for name in extra.split():
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]
