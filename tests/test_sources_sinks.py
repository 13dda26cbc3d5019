import pytest
from plans import plan
from pyspark.sql import functions as F

from gleaner.operators.index import arc_lookup_index, sample_arc_files
from gleaner.sinks import writers
from gleaner.sources import records as src


@pytest.fixture
def pages(spark):
    rows = [(f"http://a{i}.com/", f"line one\nline {i}\ttab") for i in range(20)]
    return spark.createDataFrame(rows, "url string, html string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_sequence_file_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "seq")
    writers.write_seq(pages, path)
    assert got(src.scan_seq(spark, path, "html")) == got(pages)
    assert got(src.scan_seq(spark, path, "html", "part-")) == got(pages)


def test_sequence_files_know_their_names(spark, pages, tmp_path):
    for i in range(5):
        part = pages.withColumn("html", F.concat(F.lit(f"metadata-{i}:"), "url"))
        writers.write_seq(part.coalesce(1), str(tmp_path / "parts" / str(i)))
        (tmp_path / "parts" / str(i) / "part-00000").rename(tmp_path / f"metadata-{i}")
    df = src.scan_seq(spark, str(tmp_path), "html", "metadata-", source_file="meta_file")
    assert df.count() == 100
    assert df.where("meta_file <> substring_index(html, ':', 1)").count() == 0


def test_tsv_keeps_quotes_and_drops_misfits(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('com\thttp://a.com/"x"\nno tab\norg\thttp://b.org/,\n')
    rows = got(src.scan_tsv(spark, str(path), "domain_id string, url string"))
    assert rows == [("com", 'http://a.com/"x"'), ("org", "http://b.org/,")]


def test_bad_counts_are_dropped(spark, tmp_path):
    path = tmp_path / "stat.tsv"
    path.write_text("com\t5\norg\tmany\nnet\t7\tmore\n")
    schema = "domain_id string, n long"
    assert got(src.scan_tsv(spark, str(path), schema)) == [("com", 5), ("net", 7)]
    assert got(src.tsv_misfits(spark, str(path), schema)) == [("org\tmany",)]
    with pytest.raises(Exception, match="does not fit"):
        src.scan_tsv(spark, str(path), schema, strict=True).collect()


def test_tsv_sink_modes_and_layout(spark, tmp_path):
    df = spark.createDataFrame([("com", i) for i in range(50)] + [("org", 1)], "d string, n int")
    path = str(tmp_path / "out")
    writers.write_tsv(df, path, keys=["d", "n"], num_partitions=4)
    with pytest.raises(Exception, match="already exists"):
        writers.write_tsv(df, path)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == 4  # the frequent key is spread over files
    for file in files:
        lines = [line.split("\t") for line in file.read_text().split("\n") if line]
        numbers = [(k, int(v)) for k, v in lines]
        assert numbers == sorted(numbers)
    writers.write_tsv(df, path, mode="overwrite", num_partitions=2)
    assert got(src.scan_tsv(spark, path, "d string, n int")) == got(df)


def test_null_fields_keep_their_column(spark, tmp_path):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    writers.write_tsv(df, str(tmp_path / "n"))
    assert src.scan_tsv(spark, str(tmp_path / "n"), "a string, b string").first()["b"] == "x"


def test_files_by_name_and_number(spark, pages, tmp_path):
    for i in range(4):
        pages.limit(1).select(F.lit(i).alias("i")).coalesce(1).write.parquet(str(tmp_path / f"metadata-{i}"))
    root = str(tmp_path)
    assert len(src.first_files(spark, root, 2, "part-")) == 2
    assert src.scan_first_files(spark, root, 3, "part-").count() == 3
    assert src.first_files(spark, root, 9, "nothing") == []


def test_a_folder_of_parts_counts_as_one_file(spark, pages, tmp_path):
    for name in ("pages.parquet", "pages_b.parquet", "other.parquet"):
        pages.select(F.lit(name).alias("name"), "url").repartition(3).write.parquet(str(tmp_path / name))
    root = str(tmp_path)
    assert [p.rpartition("/")[2] for p in src.first_files(spark, root, 9, "pages")] == ["pages.parquet", "pages_b.parquet"]
    first = src.scan_first_files(spark, root, 1, "pages")
    assert [tuple(r) for r in first.groupBy("name").count().collect()] == [("pages.parquet", 20)]
    assert src.scan_pages(spark, root, "pages").count() == 40
    assert src.first_files(spark, root, 9, "nothing") == []


def test_name_filter_and_source_file(spark, pages, tmp_path):
    pages.coalesce(1).write.parquet(str(tmp_path / "x"))
    df = src.with_source_file(src.scan_pages(spark, str(tmp_path / "x"), "part-"))
    name = df.select("meta_file").distinct().first()[0]
    assert name.startswith("part-") and name.endswith(".parquet")
    prefix = f"file:{tmp_path}/"
    path = src.with_source_path(src.scan_pages(spark, str(tmp_path / "x")), prefix=prefix)
    assert path.select("arc_path").first()[0].replace("file://", "").endswith(f"x/{name}")


def test_lists_of_any_length(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("a\n b\n\nC\n")
    assert src.read_parameters(spark, str(path)) == ["a", " b", "", "C"]
    assert sorted(r["host"] for r in src.read_list(spark, str(path), "host").collect()) == ["", " b", "C", "a"]


ODD_TEXTS = [
    (1, "a\tb\nc\rd"), (2, "\\n"), (3, "\\\n\\"), (4, None), (5, ""), (6, "\\N"), (7, "x\\\\ty\\"),
    (8, "\\\\\\n\n\\r\r"), (None, "q"),
]


def test_tsv_keeps_every_value_or_raises(spark, tmp_path):
    df = spark.createDataFrame(ODD_TEXTS, "k int, v string")
    writers.write_tsv(df, str(tmp_path / "escaped"), escape=True)
    got = src.scan_tsv(spark, str(tmp_path / "escaped"), "k int, v string", escaped=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ODD_TEXTS, key=str)
    with pytest.raises(Exception, match="tab or line break"):
        writers.write_tsv(df, str(tmp_path / "plain"))


def test_paths_have_one_form(spark):
    forms = ["/d/x", "file:/d/x", "file:///d/x", "hdfs://host:1/d/x", "s3a://bucket/d/x", "//d/x", "rel/x", None]
    df = spark.createDataFrame([(f,) for f in forms], "p string")
    assert [r[0] for r in df.select(src.plain_path(F.col("p"))).collect()] == ["/d/x"] * 6 + ["rel/x", None]
    for prefix in ("/d/", "file:///d/", "file:/d/", "hdfs://other/d/"):
        assert [r[0] for r in df.select(src.without_prefix(F.col("p"), prefix)).collect()] == ["x"] * 6 + ["rel/x", None]
    inside = spark.createDataFrame([("/a/d/x",)], "p string").select(src.without_prefix(F.col("p"), "/d/"))
    assert inside.first()[0] == "/a/d/x"


INFO = '{"archiveInfo": {"arcSourceSegmentId": %s, "arcFileDate": 2, "arcFileParition": "3", "arcFileOffset": 4}}'


@pytest.fixture
def index(spark):
    rows = [
        ("http://a.com/", INFO % 1),
        ("http://a.com/", INFO % 9),
        ("http://b.org/", INFO % '"s"'),
        ("http://c.org/", '{"archiveInfo": {"arcSourceSegmentId": 1}}'),
        ("http://d.org/", '{"http_result": 200}'),
        ("http://e.org/", "bad"),
        ("http://localhost/", INFO % 1),
    ]
    meta = spark.createDataFrame(rows, "url string, json string").withColumn("meta_file", F.lit("m-1"))
    return arc_lookup_index(meta)


def test_index_rows(index):
    assert got(index) == [
        ("com", "http://a.com/", "m-1", "1/2_3.arc.gz", 4),
        ("com", "http://a.com/", "m-1", "9/2_3.arc.gz", 4),
        ("org", "http://b.org/", "m-1", "s/2_3.arc.gz", 4),
    ]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_index_join_multiplies(spark, index, max_bytes):
    sample = spark.createDataFrame([("x", "http://a.com/")] * 2 + [("y", "http://z.com/")], "domain_id string, url string")
    df = sample_arc_files(index, sample, "/base/", max_bytes)
    assert [tuple(r)[-2:] for r in df.orderBy("arc_path").collect()] == [
        ("x", "/base/1/2_3.arc.gz")] * 2 + [("x", "/base/9/2_3.arc.gz")] * 2
    assert ("BroadcastHashJoin" in plan(df)) or max_bytes == 0
