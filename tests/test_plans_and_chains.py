import pytest
from plans import count, exchanges, plan

import __spark_entry__ as entry
from gleaner import fixtures as fx
from gleaner.functions.urls import with_domains
from gleaner.operators import counts, pages
from gleaner.operators.joins import join_list
from gleaner.plans import chains
from gleaner.sources import archives as arc


@pytest.fixture(scope="module")
def page_table(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages")


def test_count_has_one_shuffle_after_partial_counts(page_table):
    df = counts.count_urls_per_domain(fx.metadata(page_table))
    assert exchanges(df) == 1 and "partial_count" in plan(df)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(df)


def test_costly_columns_are_computed_once(page_table):
    text = plan(counts.count_urls_per_domain(fx.metadata(page_table)))
    assert text.count("get_json_object") == 1
    assert text.count("ParseUrlEvaluator(null,HOST") == 1


def test_host_pages_need_no_shuffle(page_table):
    records = arc.parse_records(arc.split_members(fx.archives(fx.records(page_table))))
    df = pages.pages_for_hosts(records, ["example.com"])
    assert exchanges(df) == 0 and count(df, "ArrowEvalPython") == 1


def test_small_url_list_is_broadcast(spark, page_table):
    records = arc.parse_records(arc.split_members(fx.archives(fx.records(page_table))))
    wanted = spark.createDataFrame([("p", "u")], "arc_path string, url string")
    df = pages.html_for_urls(records, wanted)
    assert "BroadcastHashJoin" in plan(df) and "LeftSemi" in plan(df)
    assert exchanges(df) <= 1  # only the list itself is made distinct
    longer = pages.html_for_urls(records, wanted, max_list_bytes=0)
    assert "SortMergeJoin" in plan(longer) and "BroadcastHashJoin" not in plan(longer)


def test_a_frequent_key_is_split_and_a_long_list_not_copied(spark):
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        big = spark.range(200_000).selectExpr("IF(id % 3 = 0, 'hot', cast(id AS string)) AS k", "md5(cast(id AS string)) AS v")
        small = spark.range(3000).selectExpr("IF(id = 0, 'hot', cast(id AS string)) AS k")
        df = join_list(big, small, ["k"], "left_semi", max_bytes=0)
        assert df.count() == 66_667 + sum(1 for i in range(1, 3000) if i % 3)
        df.collect()
        assert "skewed" in plan(df) or "skew=true" in plan(df)
        assert "Generate" not in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_profile_pages_are_tested_before_they_are_decoded(spark, sf_dir):
    records = entry._profile_records(spark, sf_dir)
    text = plan(chains.social_profile_countries(records))
    assert text.count("ParseUrlEvaluator(null,HOST") == 1
    lines = text.splitlines()
    decode = max(i for i, line in enumerate(lines) if "MapInArrow" not in line and "Contains(url" in line.replace("#", " ") or "/profile/" in line)
    python = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert python and decode > max(python)  # further down the tree


def test_registered_names():
    for name in entry.core_queries():
        assert "pipeline" not in name and not name.startswith("op")


def with_base(stages):
    archives = stages.archives.selectExpr("url", f"concat('{fx.ARCHIVE_BASE}', arc_path) AS arc_path")
    return chains.VacancyStages(stages.candidates, stages.counts, stages.sample, archives)


def test_vacancy_stages_fit_together(spark, sf_dir, tmp_path):
    texts = fx.texts(fx.table(spark, sf_dir, "documents"))
    meta = entry._documents(spark, sf_dir).selectExpr(
        f"{fx.TEXT_URL} AS url", f"{fx.METADATA_JSON.replace('page_id', 'doc_id')} AS json", "'m' AS meta_file"
    )
    stages = chains.vacancy_stages(texts, meta, fx.KEYWORDS, 40)
    candidates = {r["url"] for r in stages.candidates.collect()}
    sample = [r["url"] for r in stages.sample.collect()]
    assert set(sample) <= candidates and len(sample) == len(set(sample))
    assert sum(r["n"] for r in stages.counts.collect()) == len(candidates)
    assert {r["url"] for r in stages.archives.collect()} <= set(sample)

    # the archives as files: the whole job opens only the listed ones
    rows = entry._documents(spark, sf_dir).selectExpr("doc_id AS page_id", f"{fx.TEXT_URL} AS url", "text AS html")
    packed = fx.archives(fx.records(rows)).collect()
    for r in packed:
        file = tmp_path / r["arc_path"].removeprefix(fx.ARCHIVE_BASE)
        file.parent.mkdir(parents=True, exist_ok=True)
        with file.open("ab") as out:  # opening records inside a file are read as bad headers
            out.write(r["content"])
    unlisted = tmp_path / "unlisted.arc.gz"
    unlisted.write_bytes(b"not an archive")
    records = arc.readable(arc.parse_records(arc.split_members(fx.archives(fx.records(rows)))))
    want = sorted(tuple(r) for r in chains.vacancy_html(records, with_base(stages)).collect())
    found = chains.vacancy_html_from_files(spark, str(tmp_path), stages, f"file:{tmp_path}/")
    assert sorted(tuple(r) for r in found.collect()) == want and want


def test_row_wise_stages_accept_a_stream(spark, sf_dir, tmp_path):
    schema = fx.table(spark, sf_dir, "pages").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "pages.parquet").parquet(sf_dir)
    df = with_domains(stream).select("domain_id", "url")
    query = (
        df.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == fx.table(spark, sf_dir, "pages").count()


def test_task_functions_need_no_package_on_the_workers(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from gleaner.functions import html

    file = tmp_path / "functions"
    file.write_bytes(cloudpickle.dumps((arc._split_batches, arc.mentions(["a.b"]), html.select_page)))
    code = f"import pickle, sys; pickle.load(open({str(file)!r}, 'rb')); assert 'gleaner' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
