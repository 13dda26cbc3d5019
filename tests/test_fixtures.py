import gzip

import pyarrow as pa

from gleaner import fixtures as fx


def packed_rows(n):
    return [(k, f"/{k % 3}.arc.gz", f"http://a{k}.com/", b"x" * k, False) for k in range(n)]


def test_packing_holds_one_archive_at_a_time(monkeypatch):
    made, member = [], fx._member
    monkeypatch.setattr(fx, "_member", lambda *row: made.append(row) or member(*row))
    n = 4 * fx.RECORDS_PER_ARCHIVE + 3
    columns = [["/a"] * n, ["h"] * n, [b"x"] * n, [False] * n]
    batch = pa.record_batch(columns, ["arc_path", "header", "payload", "damaged"])
    archives = fx._pack(iter([batch]))
    next(archives)
    assert len(made) == fx.RECORDS_PER_ARCHIVE
    assert len(list(archives)) == 4


def test_archive_files_are_written_member_by_member(spark, tmp_path, monkeypatch):
    schema = "page_id long, arc_path string, header string, payload binary, damaged boolean"
    rows = spark.createDataFrame(packed_rows(40), schema).repartition(5)

    def whole(*args, **kwargs):
        raise AssertionError("an archive is a whole group")

    monkeypatch.setattr(type(rows.groupBy("arc_path")), "applyInPandas", whole)
    fx.archive_folder(rows, f"file://{tmp_path}")
    assert sorted(f.name for f in tmp_path.iterdir()) == ["0.arc.gz", "1.arc.gz", "2.arc.gz"]
    for k in range(3):
        lines = [b"http://a%d.com/\n%s" % (i, b"x" * i) for i in range(k, 40, 3)]
        assert gzip.decompress((tmp_path / f"{k}.arc.gz").read_bytes()) == fx.OPENING + b"".join(lines)


def test_profiles_of_one_file_are_dealt_over_all_cores(spark, sf_dir):
    made = fx.profiles(fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "nation"))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.count() == fx.table(spark, sf_dir, "customer").count()
