import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.operators import automaton, keywords


def counted(text, words):
    return {w: text.count(w) for w in words if w and w in text}


@given(st.text("ab é", max_size=40), st.lists(st.text("ab é", min_size=1, max_size=4), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_occurrences_are_those_of_counting_each_keyword(text, words):
    assert automaton.occurrences(automaton.automaton_of(words), text) == counted(text, words)


def found_rows(df):
    return {r.id: None if r.found is None else [(e.keyword, e.freq) for e in r.found] for r in df.collect()}


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_table_of_keywords_in_parts(spark, max_bytes):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)]
    texts = [(k, "".join(rng.choices("abcd ", k=rng.randint(0, 200)))) for k in range(40)] + [(100, None), (101, ""), (102, "abc" * 20_000), (103, "\x00a\x00日本")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    listed = spark.createDataFrame([(w,) for w in words + words + ["", None, "日", "\x00a"]], "w string")
    got = found_rows(automaton.with_found(df, "text", listed, max_bytes))
    assert got == {i: None if t is None else sorted(counted(t, set(words) | {"日", "\x00a"}).items()) for i, t in texts}


def test_no_keywords_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    none = spark.createDataFrame([("",), (None,)], "w string")
    assert found_rows(automaton.with_found(df, "text", none)) == {1: [], 2: None}
    some = spark.createDataFrame([("a",)], "w string")
    assert automaton.with_found(df.where("1 = 0"), "text", some).collect() == []


def test_long_lists_give_the_rows_of_short_ones(spark, monkeypatch):
    rows = [("http://www.a.com/1", "The quick Brown fox, the end"), ("http://b.de/2", "und UND THE"), ("http://b.de/3", None), (None, "the")]
    pages = spark.createDataFrame(rows, "url string, text string")
    words = ["THE", "quick", "und", "qu", "e", "", "zz"]
    for mode in (keywords.DOCUMENTED, keywords.AS_CODED):
        for operator in (keywords.keyword_matches, keywords.keyword_matches_concat, keywords.vacancy_candidates):
            want = Counter(operator(pages, words, mode=mode).collect())
            assert want
            monkeypatch.setattr(keywords, "MOST_COLUMNS", 0)
            assert Counter(operator(pages, words, mode=mode).collect()) == want
            table = spark.createDataFrame([(w,) for w in words], "w string")
            assert Counter(operator(pages, table, mode=mode).collect()) == want
            monkeypatch.undo()


def test_the_as_coded_length_test_takes_tables(spark):
    pages = spark.createDataFrame([("http://a.com/", "the")], "url string, text string")
    one = spark.createDataFrame([("the",), ("the",)], "w string")
    assert keywords.vacancy_candidates(pages, one, mode=keywords.AS_CODED).collect() == []
    assert keywords.vacancy_candidates(pages, one, min_keywords=1, mode=keywords.AS_CODED).count() == 1


def test_matches_are_held_for_few_rows_at_a_time():
    import pyarrow as pa

    class Sent:
        value = automaton.automaton_of(["a", "b"])

    texts = ["ab" if k % 3 else None for k in range(10 * automaton.SLICE_ROWS)]
    whole = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    given = list(automaton._finder(Sent, "text", ["id", "found"])(iter([whole])))
    assert max(b.num_rows for b in given) == automaton.SLICE_ROWS
    rows = [r for b in given for r in b.to_pylist()]
    both = [{"keyword": "a", "freq": 1}, {"keyword": "b", "freq": 1}]
    assert rows == [{"id": k, "found": both if t else None} for k, t in enumerate(texts)]
