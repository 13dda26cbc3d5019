"""

Inputs are the given tables, read whole, or crawl records that Spark derives from them
by the rules in ``gleaner/fixtures.py``; the SQL states the same rules on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import fixtures as fx
from gleaner.functions.css import css_texts
from gleaner.functions.html import joined, select_text
from gleaner.functions.html_tree import normalised_html
from gleaner.functions.http import first_header, with_http
from gleaner.functions.suffix_table import suffix_table
from gleaner.functions.text import keyword_count
from gleaner.functions.urls import url_host, with_domains
from gleaner.operators import counts, index, keywords, ordered, pages, profiles, sampling
from gleaner.operators.joins import join_list
from gleaner.plans import chains
from gleaner.session import cut_lineage, new_folder
from gleaner.sinks import writers
from gleaner.sources import arc_source
from gleaner.sources import archives as arc
from gleaner.sources import records as src

SAMPLE_SIZE = 100
HTML_LIMIT = 5000
HOSTS = ["example.com", "example.org", "Example.net"]
COUNTRIES = ["nation_1", "nation_2", "nation_3", "NATION_4", ""]


# ---- inputs -------------------------------------------------------------------------


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: fx.table(spark, sf, name)


_pages, _documents = _table("pages"), _table("documents")


def _metadata(spark, sf):
    return fx.metadata(_pages(spark, sf))


def _cases(spark, sf):
    return fx.url_cases(_pages(spark, sf))


def _texts(spark, sf):
    return fx.texts(_documents(spark, sf))


def _profiles(spark, sf):
    return fx.profiles(_table("customer")(spark, sf), _table("nation")(spark, sf))


def _records(spark, sf):
    rows = fx.records(_pages(spark, sf))
    return arc.parse_records(arc.split_members(fx.archives(rows)))


def _profile_records(spark, sf):
    rows = fx.profile_records(_profiles(spark, sf))
    keep = arc.mentions(chains.SOCIAL_SITES)
    return arc.parse_records(arc.split_members(fx.archives(rows), keep))


def _indexed(spark, sf):
    scanned = src.with_source_file(_pages(spark, sf))
    json = F.expr(fx.METADATA_JSON).alias("json")
    return index.arc_lookup_index(scanned.select("url", json, "meta_file"))


def _matches(spark, sf):
    return keywords.keyword_matches(_texts(spark, sf), fx.KEYWORDS)


def _benchmark_words(spark, sf):
    """The words of the benchmark items, as a table of keywords."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    return fx.table(spark, sf, "benchmark").select(words.alias("word")).where("word <> ''").distinct()


def _matches_automaton(spark, sf):
    return keywords.keyword_matches(_texts(spark, sf), _benchmark_words(spark, sf))


def _candidates_automaton(spark, sf):
    long = _benchmark_words(spark, sf).where("length(word) >= 8")
    found = keywords.vacancy_candidates(_texts(spark, sf), long, min_keywords=3)
    return found.groupBy("domain_id", "url").agg(F.count(F.lit(1)).alias("n_keywords"), F.sum("freq").alias("n"))


def _page_domains(spark, sf):
    return with_domains(_pages(spark, sf)).select("domain_id", "url")


def _page_counts(spark, sf):
    return _page_domains(spark, sf).groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))


def _folder(spark) -> str:
    return new_folder(spark, "query")


# ---- queries ------------------------------------------------------------------------


def _scan_tsv(spark, sf):
    path = _folder(spark)
    writers.write_tsv(_page_domains(spark, sf), path, keys=["domain_id", "url"])
    return src.scan_tsv(spark, path, "domain_id string, url string")


def _scan_seq(spark, sf):
    path = _folder(spark)
    writers.write_seq(_pages(spark, sf).select("url", "html"), path)
    return src.scan_seq(spark, path, "html").select("url", F.md5("html").alias("html_md5"))


def _write_tsv(spark, sf):
    path = _folder(spark)
    writers.write_tsv(_indexed(spark, sf), path, num_partitions=2)
    return spark.read.text(path)


def _write_seq(spark, sf):
    path = _folder(spark)
    writers.write_seq(profiles.profile_country(_profiles(spark, sf)), path)
    return src.scan_seq(spark, path, "country")


def _write_pages(spark, sf):
    path = _folder(spark)
    writers.write_pages(_pages(spark, sf).select("url", "html"), path)
    return src.scan_pages(spark, path).select("url", F.octet_length("html").alias("n_bytes"))


def _scan_arc(spark, sf):
    return _records(spark, sf).select(
        "arc_path", "url", "ip", "archive_ts", "content_type", "content_length", "status",
        F.octet_length("payload").alias("payload_bytes"),
    )


def _scan_status(spark, sf):
    return _records(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _archive_folder(spark, sf):
    folder = new_folder(spark, "archives")
    fx.archive_folder(fx.records(_pages(spark, sf)), folder)
    return folder


def _scan_arc_files(spark, sf):
    folder = _archive_folder(spark, sf)
    records = arc.scan_arc(spark, folder, prefix=folder)
    place = Window.partitionBy("arc_path").orderBy("arc_offset")
    return records.select(
        "arc_path", "url", "status", F.octet_length("payload").alias("payload_bytes"),
        F.rank().over(place).cast("bigint").alias("place"),
    )


def _scan_arc_pieces(spark, sf):
    folder = _archive_folder(spark, sf)
    records = arc_source.scan_arc_pieces(spark, folder, prefix=folder, piece_bytes=64 << 10)
    place = Window.partitionBy("arc_path").orderBy("arc_offset")
    return records.select(
        "arc_path", "url", "status", F.octet_length("payload").alias("payload_bytes"),
        F.rank().over(place).cast("bigint").alias("place"),
    )


def _scan_arc_pieces_of_hosts(spark, sf):
    folder = _archive_folder(spark, sf)
    path = F.expr(fx.RECORD_PARTS["arc_path"])
    paths = [r[0] for r in _pages(spark, sf).where("page_id % 4 = 1").select(path).distinct().collect()]
    records = arc_source.scan_arc_pieces(spark, folder, prefix=folder, piece_bytes=64 << 10, files=paths, hosts=HOSTS)
    return arc.readable(records).select("arc_path", "url", F.octet_length("payload").alias("payload_bytes"))


def _listed(spark, sf):
    """Pages whose id is no multiple of three, by the file they lie in."""
    rows = _pages(spark, sf).where("page_id % 3 > 0")
    return rows.select(F.expr(fx.RECORD_PARTS["arc_path"]).alias("arc_path"), "url")


def _scan_listed_arc(spark, sf):
    folder = _archive_folder(spark, sf)
    listed = _listed(spark, sf).where("url NOT LIKE '%.org/%'")
    records = arc.scan_listed_arc(spark, folder, listed, prefix=folder)
    return arc.readable(records).select("arc_path", "url", "status", F.octet_length("payload").alias("payload_bytes"))


def _scan_listed_offsets(spark, sf):
    folder = _archive_folder(spark, sf)
    places = arc.scan_arc(spark, folder).where("status = 'OK'").select("arc_path", "arc_offset", "url")
    places = join_list(places, cut_lineage(_listed(spark, sf).select("url")), ["url"], "left_semi")
    records = arc.scan_listed_arc(spark, folder, places.select("arc_path", "arc_offset"))
    return records.select("url", "status", F.octet_length("payload").alias("payload_bytes"))


def _html_for_urls_files(spark, sf):
    folder = _archive_folder(spark, sf)
    listed = cut_lineage(_listed(spark, sf).distinct())
    records = arc.readable(arc.scan_listed_arc(spark, "file:/", listed, prefix=folder))
    return pages.html_for_urls(records, listed).select("url", F.md5("html").alias("html_md5"))


def _with_source_path(spark, sf):
    pages_ = spark.read.parquet(f"{sf}/pages.parquet")
    return src.with_source_path(pages_, "path", prefix=sf + "/").select("page_id", "path")


def _write_tsv_escaped(spark, sf):
    path = _folder(spark)
    rows = _documents(spark, sf).select("doc_id", F.when(F.expr("doc_id % 7 > 0"), F.col("text")).alias("text"))
    writers.write_tsv(rows, path, escape=True)
    return src.scan_tsv(spark, path, "doc_id bigint, text string", escaped=True)


def _tsv_misfits(spark, sf):
    path = _folder(spark)
    rows = _pages(spark, sf).select(F.expr("IF(page_id % 5 = 0, concat('x', page_id), cast(page_id AS string))").alias("k"), "url")
    writers.write_tsv(rows, path, mode="overwrite")
    writers.write_tsv(rows, path, mode="overwrite")
    return src.tsv_misfits(spark, path, "page_id bigint, url string")


def _hosts_from_file(spark, sf):
    path = _folder(spark)
    hosts = with_domains(_pages(spark, sf)).where("host_domain IS NOT NULL AND length(url) % 2 = 0")
    hosts.select("host_domain").distinct().write.text(path)
    found = pages.on_hosts(_pages(spark, sf), src.read_list(spark, path))
    return found.select("url", "host_domain")


def _profile_country_ordered(spark, sf):
    return profiles.profile_country(_profiles(spark, sf), ordered=True)


def _profile_status_counts(spark, sf):
    return profiles.profile_status_counts(_profiles(spark, sf))


def _first_of_many_files(spark, sf):
    path = _folder(spark)
    for k in range(4):
        part = _pages(spark, sf).where(f"page_id % 4 = {k}")
        part.write.parquet(f"{path}/part{k}")  # each a file in as many parts as tasks wrote
    return src.scan_first_files(spark, path, 2, "part").select("page_id")


def _arc_header_parse(spark, sf):
    headers = fx.records(_pages(spark, sf)).select("page_id", "header")
    return arc.parse_header(headers).drop("header")


def _http_parse(spark, sf):
    df = with_http(arc.readable(_records(spark, sf)))
    return df.select(
        "url",
        "http_status",
        F.size("http_headers").alias("n_headers"),
        first_header(F.col("http_headers"), "content-type").alias("http_type"),
        first_header(F.col("http_headers"), "x-page").cast("bigint").alias("page_id"),
        F.octet_length("body").alias("body_bytes"),
    )


def _arc_html(spark, sf):
    records = arc.readable(_records(spark, sf))
    return pages.arc_html(records).select("url", F.md5("html").alias("html_md5"))


def _url_host(spark, sf):
    return _pages(spark, sf).select("url", url_host(F.col("url")).alias("host"))


def _host_domain(spark, sf):
    return with_domains(_cases(spark, sf)).select("page_id", "host_domain")


def _host_domain_registries(spark, sf):
    return with_domains(fx.registry_hosts(_pages(spark, sf))).select("page_id", "host_domain")


def _domain_id(spark, sf):
    return with_domains(_pages(spark, sf)).select("url", "domain_id")


def _url_status(spark, sf):
    return counts.with_status(_cases(spark, sf)).select("page_id", "host_domain", "domain_id", "status")


def _keyword_count(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        keyword_count(F.lower("text"), F.lit("the")).alias("n_the"),
        keyword_count(F.lower("text"), F.lit("que")).alias("n_que"),
        keyword_count(F.lower("text"), F.lit("")).alias("n_empty"),
    )


def _split_key(spark, sf):
    packed = keywords.packed_key(_matches(spark, sf))
    return packed.select(*keywords.split_key(F.col("key")), "val")


def _stratum_filter(spark, sf):
    stat = _page_counts(spark, sf).where("domain_id <> 'net'")
    return sampling.stratum_filter(_page_domains(spark, sf), stat)


def _sample_of(dice: bool):
    def run(spark, sf):
        rows, stat = _page_domains(spark, sf), _page_counts(spark, sf)
        return sampling.stratified_sample(rows, stat, SAMPLE_SIZE, dice=dice)

    return run


def _sample_copies(spark, sf):
    rows = _matches(spark, sf).select("domain_id", "url")  # one row per keyword: URLs repeat
    stat = rows.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.stratified_sample(rows, stat, SAMPLE_SIZE)


def _page_sample(spark, sf):
    return cut_lineage(_sample_of(False)(spark, sf))


def _sample_arc_files(spark, sf):
    return index.sample_arc_files(_indexed(spark, sf), _page_sample(spark, sf), fx.ARCHIVE_BASE)


def _sample_arc_files_bucketed(spark, sf):
    name = f"lookup_{uuid.uuid4().hex}"
    stored = index.write_bucketed_index(_indexed(spark, sf), name, 8)
    return index.sample_arc_files_bucketed(spark, stored, _page_sample(spark, sf), fx.ARCHIVE_BASE)


def _html_for_long_list(spark, sf):
    """A limit that the list exceeds, but not its Bloom filter: that comes first, then a join by shuffle."""
    records = arc.readable(_records(spark, sf))
    found = pages.html_for_urls(records, _wanted(spark, sf), max_list_bytes=1000)
    return found.select("url", F.md5("html").alias("html_md5"))


def _wanted(spark, sf):
    return cut_lineage(_sample_arc_files(spark, sf).select("arc_path", "url"))


def _html_for_urls(pairwise: bool):
    def run(spark, sf):
        records = arc.readable(_records(spark, sf))
        wanted = _wanted(spark, sf)
        if not pairwise:  # lists that do not belong together: paths of one half of the list
            wanted = wanted.withColumn(
                "arc_path", F.when(F.col("arc_path").endswith("_1.arc.gz"), F.col("arc_path"))
            )
        found = pages.html_for_urls(records, wanted, pairwise)
        return found.select("url", F.md5("html").alias("html_md5"))

    return run


def _arc_file_prune(spark, sf):
    return pages.archive_prune(_records(spark, sf), _archives_of_sample(spark, sf)).select(
        "arc_path", "url", "content_length"
    )


def _archives_of_sample(spark, sf):
    wanted = _wanted(spark, sf).select("arc_path").distinct()
    return wanted.where(F.col("arc_path").endswith("_1.arc.gz"))


def _filter_html_size(spark, sf):
    df = _pages(spark, sf).select(
        "url",
        F.expr(fx.RECORD_PARTS["content_type"]).alias("content_type"),
        F.octet_length("html").alias("content_length"),
    )
    return pages.filter_html_size(df, HTML_LIMIT)


def _pages_for_hosts(spark, sf):
    found = pages.pages_for_hosts(arc.readable(_records(spark, sf)), HOSTS)
    return found.select("url", F.md5("html").alias("html_md5"))


def _rule_lines(spark, sf):
    """Every third site of the pages as a registry of its own, with marks, comments and foreign spellings between."""
    sites = with_domains(_pages(spark, sf)).where("host_domain IS NOT NULL").select("host", "page_id")
    lines = sites.select(F.explode(F.array(
        F.when(F.expr("page_id % 3 = 0"), F.col("host")), F.when(F.expr("page_id % 3 = 1"), F.concat(F.lit("*."), "host")),
        F.concat(F.lit("// "), "host"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".bücher.example  // x")),
    )).alias("line"))
    more = spark.createDataFrame([("com",), ("org",), ("*.net",), ("!example.net",)], "line string")
    return lines.dropna().unionByName(more)


def _host_domain_rule_table(spark, sf):
    rules = suffix_table(_rule_lines(spark, sf))
    below = _pages(spark, sf).withColumn("url", F.regexp_replace("url", "://", "://a.b."))
    foreign = _pages(spark, sf).select("page_id", F.expr("concat('http://www.shop.p', page_id, '.xn--bcher-kva.example/')").alias("url"))
    rows = below.select("page_id", "url").unionByName(foreign)
    return with_domains(rows, rules=rules).select("page_id", "url", "host_domain")


def _arc_html_sniffed(spark, sf):
    """Pages without a charset in their header: with a mark, with a meta element, with neither."""
    body = F.expr(r"""CASE page_id % 3
        WHEN 0 THEN X'EFBBBF' || encode(html, 'UTF-8')
        WHEN 1 THEN encode(replace(regexp_replace(html, '[^\\x01-\\x7F]', '?'), 'charset="utf-8"', 'charset="windows-1252"'), 'UTF-8') || X'80'
        ELSE encode(replace(regexp_replace(html, '[^\\x01-\\x7F]', '?'), '<meta charset="utf-8">', ''), 'UTF-8') || X'E9' END""")
    head = F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), "UTF-8")
    rows = _pages(spark, sf).select("page_id", "url", F.lit("text/html").alias("content_type"), F.concat(head, body).alias("payload"))
    return pages.arc_html(rows, sniff=True).select("page_id", F.md5("html").alias("html_md5"))


def _http_parse_schemes(spark, sf):
    """As ``http_parse``, where every third record has an address that is not of the web."""
    other = F.expr("CASE WHEN length(url) % 3 = 0 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END")
    return with_http(arc.readable(_records(spark, sf)).withColumn("url", other)).select("url", "http_status", F.octet_length("body").alias("body_bytes"))


def _host_page_status(spark, sf):
    found = pages.host_page_status(_records(spark, sf), HOSTS)
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _listed_page_status(spark, sf):
    found = pages.listed_page_status(_records(spark, sf), cut_lineage(_listed(spark, sf)))
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _arc_file_prune_by_segment(spark, sf):
    folder = _folder(spark)
    records = pages.by_segment(_records(spark, sf))
    records.write.partitionBy("segment").parquet(folder)
    stored = spark.read.schema(records.schema).parquet(folder)
    return pages.archive_prune_by_segment(stored, _archives_of_sample(spark, sf)).select("arc_path", "url", "content_length")


def _hosts_from_ordered_files(spark, sf):
    folder = _folder(spark)
    ordered.write_by_host(_pages(spark, sf), folder, 12)
    hosts = with_domains(_pages(spark, sf)).where("host_domain IS NOT NULL AND length(url) % 2 = 0")
    found = ordered.pages_on_sites(spark, folder, cut_lineage(hosts.select("host_domain").distinct()))
    return found.select("url", "host_domain")


def _html_normalised(spark, sf):
    return _profiles(spark, sf).select("url", normalised_html(F.col("html")).alias("html"))


def _html_css_select(spark, sf):
    chosen = {"title": "head > title", "ad": "body > .ad", "links": "nav ul li > a[href]", "lang": 'html[lang="fr"] h1, html[lang=de] h1', "none": "article nav, #x"}
    texts = _pages(spark, sf).select("page_id", css_texts(F.col("html"), chosen).alias("t"))
    return texts.select("page_id", *[joined(F.col(f"t.{n}")).alias(n) for n in chosen])


def _html_select_text(spark, sf):
    return _pages(spark, sf).select(
        "page_id", joined(select_text(F.col("html"), "div", "ad")).alias("ad_text")
    )


def _vacancy(spark, sf):
    # page metadata for the URLs of the texts, so that the two sides meet
    texts = _texts(spark, sf)
    meta = _documents(spark, sf).select(
        F.expr(fx.TEXT_URL).alias("url"),
        F.expr(fx.METADATA_JSON.replace("page_id", "doc_id")).alias("json"),
        F.lit("metadata-0").alias("meta_file"),
    )
    return chains.vacancy_stages(texts, meta, fx.KEYWORDS, SAMPLE_SIZE, fx.ARCHIVE_BASE)


def _vacancy_archives(spark, sf):
    return _vacancy(spark, sf).archives.select("domain_id", "url", "arc_path", "arc_offset")


def _vacancy_html(spark, sf):
    # the texts of the corpus as archived pages
    rows = _documents(spark, sf).select(
        F.col("doc_id").alias("page_id"), F.expr(fx.TEXT_URL).alias("url"), F.col("text").alias("html")
    )
    records = arc.readable(arc.parse_records(arc.split_members(fx.archives(fx.records(rows)))))
    found = chains.vacancy_html(records, _vacancy(spark, sf))
    return found.select("url", F.md5("html").alias("html_md5"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: successfully fetched URLs per domain."""
    return counts.count_urls_per_domain(_metadata(spark, "/root/testdata/sf0.001"))


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "host_domain_registries": _host_domain_registries,
        "scan_arc_files": _scan_arc_files,
        "host_domain_rule_table": _host_domain_rule_table,
        "arc_html_sniffed": _arc_html_sniffed,
        "http_parse_schemes": _http_parse_schemes,
        "host_page_status": _host_page_status,
        "listed_page_status": _listed_page_status,
        "arc_file_prune_by_segment": _arc_file_prune_by_segment,
        "hosts_from_ordered_files": _hosts_from_ordered_files,
        "html_normalised": _html_normalised,
        "html_css_select": _html_css_select,
        "scan_listed_arc": _scan_listed_arc,
        "scan_arc_pieces": _scan_arc_pieces,
        "scan_arc_pieces_of_hosts": _scan_arc_pieces_of_hosts,
        "keyword_matches_automaton": _matches_automaton,
        "vacancy_candidates_automaton": _candidates_automaton,
        "sample_arc_files_bucketed": _sample_arc_files_bucketed,
        "html_for_long_list": _html_for_long_list,
        "scan_listed_offsets": _scan_listed_offsets,
        "html_for_urls_files": _html_for_urls_files,
        "with_source_path": _with_source_path,
        "write_tsv_escaped": _write_tsv_escaped,
        "tsv_misfits": _tsv_misfits,
        "hosts_from_file": _hosts_from_file,
        "profile_country_ordered": _profile_country_ordered,
        "profile_status_counts": _profile_status_counts,
        "scan_first_of_many_files": _first_of_many_files,
        # sources and sinks
        "scan_pages": lambda s, d: src.scan_pages(s, f"{d}/pages.parquet").select(
            "page_id", "url", F.octet_length("html").alias("n_bytes")
        ),
        "scan_by_name": lambda s, d: src.scan_pages(s, d, "custom"),
        "scan_first_n_files": lambda s, d: src.scan_first_files(s, d, 1, "pages").select("page_id", "url"),
        "with_source_file": lambda s, d: src.with_source_file(_pages(s, d)).select("url", "meta_file"),
        "scan_tsv": _scan_tsv,
        "scan_seq": _scan_seq,
        "write_tsv": _write_tsv,
        "write_seq": _write_seq,
        "write_pages": _write_pages,
        "scan_arc": _scan_arc,
        "scan_arc_status": _scan_status,
        "arc_header_parse": _arc_header_parse,
        "http_parse": _http_parse,
        "arc_html": _arc_html,
        # URLs and metadata
        "url_host": _url_host,
        "host_domain": _host_domain,
        "domain_id": _domain_id,
        "url_status": _url_status,
        "url_status_counts": lambda s, d: counts.url_status_counts(_cases(s, d)),
        "filter_valid_host": lambda s, d: counts.valid_host(_cases(s, d)).select("page_id", "url"),
        "filter_http_ok": lambda s, d: counts.http_ok(_metadata(s, d)).select("url"),
        "count_urls_per_domain": lambda s, d: counts.count_urls_per_domain(_metadata(s, d)),
        "count_urls_per_host_domain": lambda s, d: counts.count_urls_per_host_domain(_metadata(s, d)),
        "arc_lookup_index": _indexed,
        # keywords and candidates
        "keyword_count": _keyword_count,
        "keyword_matches": _matches,
        "keyword_matches_as_coded": lambda s, d: keywords.keyword_matches(
            _texts(s, d), fx.KEYWORDS, keywords.AS_CODED
        ),
        "keyword_matches_concat": lambda s, d: keywords.keyword_matches_concat(_texts(s, d), fx.KEYWORDS),
        "vacancy_candidates": lambda s, d: keywords.vacancy_candidates(_texts(s, d), fx.KEYWORDS),
        "vacancy_candidates_as_coded": lambda s, d: keywords.vacancy_candidates(
            _texts(s, d), fx.KEYWORDS, mode=keywords.AS_CODED
        ),
        "split_key": _split_key,
        "candidate_urls": lambda s, d: keywords.candidate_urls(_matches(s, d)),
        "candidate_count_per_domain": lambda s, d: keywords.candidate_count_per_domain(_matches(s, d)),
        # sampling
        "stratum_filter": _stratum_filter,
        "sample_quota": lambda s, d: sampling.sample_quota(_page_counts(s, d), SAMPLE_SIZE),
        "stratified_sample": _sample_of(False),
        "stratified_sample_dice": _sample_of(True),
        "stratified_sample_copies": _sample_copies,
        # archives and pages
        "sample_arc_files": _sample_arc_files,
        "html_for_urls": _html_for_urls(True),
        "html_for_urls_unpaired": _html_for_urls(False),
        "arc_file_prune": _arc_file_prune,
        "filter_html_size": _filter_html_size,
        "pages_for_hosts": _pages_for_hosts,
        # profiles
        "html_select_text": _html_select_text,
        "profile_pages": lambda s, d: pages.profile_pages(_profiles(s, d)).select("url", "html"),
        "profile_country": lambda s, d: profiles.profile_country(_profiles(s, d)),
        "profiles_in_countries": lambda s, d: profiles.profiles_in_countries(_profiles(s, d), COUNTRIES),
        # whole jobs
        "vacancy_archives": _vacancy_archives,
        "vacancy_html": _vacancy_html,
        "social_profile_countries": lambda s, d: chains.social_profile_countries(_profile_records(s, d)),
        "social_profiles_in_countries": lambda s, d: chains.social_profiles_in(
            _profile_records(s, d), COUNTRIES
        ),
    }


# ---- SQL equivalents ----------------------------------------------------------------

_NUMBER = f"(page_id % 4 + 4 * (page_id // {fx.PAGES_PER_ROUND}))"

_META = """meta AS (
  SELECT page_id, url,
         regexp_extract(url, '://([^/:?#]+)', 1) AS host,
         regexp_extract(url, '://[^/:?#]*?([^./:?#]+[.][^./:?#]+)([/:?#]|$)', 1) AS site,
         CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS http_result
  FROM pages),
dom AS (SELECT *, split_part(site, '.', -1) AS domain_id FROM meta)"""

_CASES = """cases AS (
  SELECT page_id, page_id % 16 AS k,
    CASE page_id % 16
      WHEN 0 THEN 'http://a' || page_id || '.b' || page_id % 5 || '.co.uk/x'
      WHEN 1 THEN 'HTTP://WWW.Shop' || page_id % 9 || '.COM:80/p'
      WHEN 4 THEN 'http://my_host' || page_id || '.example.com/'
      WHEN 5 THEN 'mailto:u' || page_id || '@b'
      WHEN 6 THEN '/rel/path' || page_id
      WHEN 7 THEN 'http://bad host' || page_id || '/'
      WHEN 8 THEN 'http://ex.com/a b' || page_id
      WHEN 9 THEN 'http://1.2.3.' || page_id % 250 || '/x'
      WHEN 10 THEN 'http://localhost/' || page_id
      WHEN 11 THEN 'http://co.uk/' || page_id
      ELSE url END AS url,
    CASE WHEN page_id % 16 = 0 THEN 'b' || page_id % 5 || '.co.uk'
         WHEN page_id % 16 = 1 THEN 'shop' || page_id % 9 || '.com'
         WHEN page_id % 16 BETWEEN 4 AND 11 THEN NULL
         ELSE regexp_extract(url, '://[^/:?#]*?([^./:?#]+[.][^./:?#]+)([/:?#]|$)', 1)
    END AS host_domain,
    CASE WHEN page_id % 16 IN (4, 5, 6) THEN 'INVALID_URIS'
         WHEN page_id % 16 IN (7, 8, 12, 13, 14) THEN 'EXCEPTIONS'
         WHEN page_id % 16 IN (9, 10, 11) THEN 'INVALID_DOMAIN'
         WHEN page_id % 16 = 2 THEN 'HTTP_FAIL'
         WHEN page_id % 16 = 3 THEN 'MISSING_HTTPCODE'
         ELSE 'HTTP_SUCCESS' END AS status
  FROM pages)"""

_INDEX = f"""idx AS (
  SELECT domain_id, url, 'pages.parquet' AS meta_file,
         (1346823846036 + page_id % 3) || '/1346848925218_' || {_NUMBER} || '.arc.gz' AS arc_file,
         page_id * 1000 AS arc_offset
  FROM dom WHERE page_id % 11 <> 0)"""

_TEXTS = """texts AS (
  SELECT doc_id, lang AS domain_id, lower(text) AS t, text,
         'http://www.' || source || '.example.' || lang || '/' || doc_id AS url
  FROM documents)"""


def _found(words: str) -> str:
    return f"""{_TEXTS}, found AS (
  SELECT domain_id, url, kw AS keyword, doc_id,
         CAST((length(t) - length(replace(t, kw, ''))) / length(kw) AS INTEGER) AS freq
  FROM texts CROSS JOIN (SELECT unnest({words}) AS kw) AS list
  WHERE contains(t, kw))"""


_FOLDED = _found("['the', 'que', 'und', 'zzqx']")
_AS_GIVEN = _found("['the', 'que', 'und', 'zzqx', 'THE']")


_BENCHMARK_WORDS = """listed AS (
  SELECT DISTINCT kw FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS kw FROM benchmark) AS t WHERE kw <> '')"""
_BY_BENCHMARK = f"""{_BENCHMARK_WORDS}, {_TEXTS}, found AS (
  SELECT domain_id, url, kw AS keyword,
         CAST((length(t) - length(replace(t, kw, ''))) / length(kw) AS INTEGER) AS freq
  FROM texts CROSS JOIN listed WHERE contains(t, kw))"""


def _quota_sql(rows: str) -> str:
    return f"""stat AS (SELECT domain_id, count(*) AS n FROM {rows} GROUP BY domain_id),
quota AS (
  SELECT domain_id, n, CAST(floor(CAST(CAST({SAMPLE_SIZE} AS FLOAT)
           / CAST((SELECT sum(n) FROM stat) AS FLOAT) * CAST(n AS FLOAT) AS DOUBLE) + 0.5)
           AS BIGINT) AS quota
  FROM stat)"""


def _sample_sql(rows: str, where: str = "TRUE") -> str:
    return f"""ranked AS (
  SELECT domain_id, url, row_number() OVER (
           PARTITION BY domain_id ORDER BY md5('order-0:' || url), url) AS place
  FROM {rows} WHERE {where}),
sample AS (SELECT domain_id, url FROM ranked JOIN quota USING (domain_id) WHERE place <= quota)"""


_DIE = "CAST('0x' || substr(md5('die-0:' || url), 1, 8) AS BIGINT) % 6 = 0"


def _records_sql(source: str = "pages") -> str:
    return rf"""rec AS (
  SELECT page_id, url, page_id % 10 AS k,
    '{fx.ARCHIVE_BASE}' || (1346823846036 + page_id % 3) || '/1346848925218_'
      || {_NUMBER} || '.arc.gz' AS arc_path,
    '10.0.' || page_id % 256 || '.1' AS ip,
    make_timestamp(2012, 9, 1 + page_id % 28, page_id % 24, page_id % 60, 0.0) AS archive_ts,
    CASE WHEN page_id % 10 = 0 THEN 'text/plain' ELSE 'text/html' END AS content_type,
    CASE page_id % 10 WHEN 0 THEN 'text/plain' WHEN 5 THEN 'text/html'
      WHEN 6 THEN 'text/html; charset=ISO-8859-1'
      WHEN 7 THEN 'text/html; charset=windows-1252'
      ELSE 'text/html; charset=utf-8' END AS http_type,
    CASE WHEN page_id % 10 IN (5, 6) THEN regexp_replace(html, '[^\x01-\x7F]', '?', 'g') || 'é'
         WHEN page_id % 10 = 7 THEN regexp_replace(html, '[^\x01-\x7F]', '?', 'g') || '€'
         ELSE html END AS html,
    CASE WHEN page_id % 50 = 33 THEN 'BAD_GZIP' WHEN page_id % 10 = 1 THEN 'BAD_HEADER'
         WHEN page_id % 10 = 3 THEN 'TRUNCATED' ELSE 'OK' END AS status
  FROM {source}),
cut AS (
  SELECT *, status IN ('OK', 'TRUNCATED') AS sound,
    CASE WHEN k IN (5, 6, 7) THEN length(html) ELSE octet_length(encode(html)) END AS body_bytes,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: ' || http_type
      || chr(13) || chr(10) || 'X-Page: ' || page_id || chr(13) || chr(10) || chr(13) || chr(10)
      AS head
  FROM rec),
arc AS (
  SELECT *, body_bytes + CASE WHEN k = 4 THEN 0 ELSE length(head) END AS payload_bytes,
    sound AND k NOT IN (0, 4) AS has_html
  FROM cut)"""


_PROFILES = """prof AS (
  SELECT c_custkey AS key, c_custkey % 4 AS h, lower(n_name) AS nation,
    CASE c_custkey % 4
      WHEN 0 THEN 'https://www.linkedin.com/in/' || c_custkey
      WHEN 1 THEN 'http://www.viadeo.com/profile/' || c_custkey
      WHEN 2 THEN 'https://www.xing.com/profile/' || c_custkey
      ELSE 'https://www.xing.com/jobs/' || c_custkey END AS url,
    '<html><head><title>x</title></head><body><p class="country-name big">no</p>' ||
    CASE c_custkey % 4
      WHEN 0 THEN
        CASE WHEN c_custkey % 12 = 0 THEN '<span class="full-name"> </span>'
             ELSE '<span class="full-name">' || c_name || '</span>' END ||
        CASE WHEN c_custkey % 8 = 4 THEN '<span class="locality">Town, ' || n_name || '</span>'
             ELSE '<span class="country-name">' || n_name || '</span>' END
      WHEN 1 THEN CASE
        WHEN c_custkey % 7 = 0 THEN '<p>no country'
        WHEN c_custkey % 3 = 0 THEN '<abbr class="country-name">' || n_name || '</abbr>'
        ELSE '<span class="country-name">' || n_name || '</span>' END
      WHEN 2 THEN '<ul><li class="country-name">' || n_name || '<li>other</ul>'
      ELSE '<li class="country-name">' || n_name || '</li>' END || '</body></html>' AS html
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
located AS (
  SELECT url, html, CASE WHEN h = 1 AND key % 7 = 0 THEN '' ELSE nation END AS country
  FROM prof WHERE h IN (1, 2) OR (h = 0 AND key % 12 <> 0))"""

_IN_COUNTRIES = "country IN ('nation_1', 'nation_2', 'nation_3', 'NATION_4', '')"

_VACANCY = f"""{_FOLDED},
cand AS (
  SELECT DISTINCT domain_id, url, doc_id FROM found
  WHERE url IN (SELECT url FROM found GROUP BY url HAVING count(*) >= 2)),
{_quota_sql("cand")}, {_sample_sql("cand")},
chosen AS (
  SELECT cand.domain_id, cand.url, doc_id,
    '{fx.ARCHIVE_BASE}' || (1346823846036 + doc_id % 3) || '/1346848925218_' || {_NUMBER.replace('page_id', 'doc_id')}
      || '.arc.gz' AS arc_path,
    doc_id * 1000 AS arc_offset
  FROM cand JOIN sample USING (url) WHERE doc_id % 11 <> 0)"""

_PAGE_SAMPLE = f"{_META}, {_quota_sql('dom')}, {_sample_sql('dom')}, {_INDEX}"


def core_sql() -> dict[str, str]:
    """Equivalent SQL over the same tables for each key in ``queries()``."""
    return {
        "host_domain_registries": f"""SELECT page_id, 'shop' || page_id || '.' ||
            string_split('{" ".join(fx.REGISTRY_SUFFIXES)}', ' ')[page_id % {len(fx.REGISTRY_SUFFIXES)} + 1] AS host_domain
            FROM pages""",
        "scan_arc_files": f"""WITH {_records_sql()}
            SELECT arc_path, CASE WHEN sound THEN url END AS url, status,
              CASE WHEN sound THEN payload_bytes END AS payload_bytes,
              rank() OVER (PARTITION BY arc_path ORDER BY page_id) AS place
            FROM arc""",
        "scan_arc_pieces": f"""WITH {_records_sql()}
            SELECT arc_path, CASE WHEN sound THEN url END AS url, status,
              CASE WHEN sound THEN payload_bytes END AS payload_bytes,
              rank() OVER (PARTITION BY arc_path ORDER BY page_id) AS place
            FROM arc""",
        "scan_arc_pieces_of_hosts": f"""WITH {_records_sql()}
            SELECT arc_path, url, payload_bytes FROM arc
            WHERE sound AND page_id % 4 = 1 AND regexp_matches(url, 'example[.](com|org|net)')""",
        "keyword_matches_automaton": f"WITH {_BY_BENCHMARK} SELECT domain_id, url, keyword, freq FROM found",
        "vacancy_candidates_automaton": f"""WITH {_BY_BENCHMARK}
            SELECT domain_id, url, count(*) AS n_keywords, sum(freq)::BIGINT AS n
            FROM found WHERE length(keyword) >= 8 GROUP BY domain_id, url HAVING count(*) >= 3""",
        "sample_arc_files_bucketed": f"""WITH {_PAGE_SAMPLE}
            SELECT idx.*, sample.domain_id AS sample_domain_id,
                   '{fx.ARCHIVE_BASE}' || arc_file AS arc_path
            FROM idx JOIN sample ON idx.url = sample.url""",
        "html_for_long_list": f"""WITH {_PAGE_SAMPLE}, {_records_sql()}
            SELECT url, md5(html) AS html_md5 FROM arc
            WHERE has_html AND url IN (SELECT idx.url FROM idx JOIN sample ON idx.url = sample.url)""",
        "host_domain_rule_table": f"""WITH {_META}, registry AS (
              SELECT DISTINCT host, page_id % 3 AS kind FROM dom WHERE page_id % 3 < 2),
            rows AS (
              SELECT page_id, regexp_replace(url, '://', '://a.b.') AS url, 'a.b.' || host AS name, host, site,
                domain_id, host IN (SELECT host FROM registry WHERE kind = 0) AS is_exact,
                host IN (SELECT host FROM registry WHERE kind = 1) AS is_wild FROM dom)
            SELECT page_id, url, CASE WHEN domain_id = 'net' THEN site WHEN is_wild THEN name
              WHEN is_exact THEN 'b.' || host ELSE site END AS host_domain FROM rows
            UNION ALL SELECT page_id, 'http://www.shop.p' || page_id || '.xn--bcher-kva.example/',
              'shop.p' || page_id || '.xn--bcher-kva.example' FROM pages""",
        "arc_html_sniffed": r"""SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN html
              WHEN 1 THEN replace(regexp_replace(html, '[^\x01-\x7F]', '?', 'g'), 'charset="utf-8"', 'charset="windows-1252"') || '€'
              ELSE replace(regexp_replace(html, '[^\x01-\x7F]', '?', 'g'), '<meta charset="utf-8">', '') || 'é' END) AS html_md5
            FROM pages""",
        "http_parse_schemes": f"""WITH {_records_sql()}
            SELECT CASE WHEN length(url) % 3 = 0 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END AS url,
              CASE WHEN k = 4 OR length(url) % 3 = 0 THEN -1 ELSE 200 END AS http_status,
              CASE WHEN k <> 4 AND length(url) % 3 > 0 THEN body_bytes END AS body_bytes
            FROM arc WHERE sound""",
        "host_page_status": f"""WITH {_records_sql()}
            SELECT CASE WHEN NOT sound THEN 'EXCEPTIONS'
                WHEN NOT regexp_matches(url, '[.]example[.](com|org)([/:?#]|$)') THEN 'NOT_LISTED'
                WHEN k = 0 THEN 'NOT_HTML' WHEN k = 4 THEN 'NO_HTTP' ELSE 'OK' END AS outcome, count(*) AS n
            FROM arc GROUP BY outcome""",
        "listed_page_status": f"""WITH {_records_sql()}
            SELECT CASE WHEN NOT sound THEN 'EXCEPTIONS' WHEN page_id % 3 = 0 THEN 'NOT_LISTED'
                WHEN k = 0 THEN 'NOT_HTML' WHEN k = 4 THEN 'NO_HTTP' ELSE 'OK' END AS outcome, count(*) AS n
            FROM arc GROUP BY outcome""",
        "arc_file_prune_by_segment": f"""WITH {_PAGE_SAMPLE}, {_records_sql()},
            wanted AS (SELECT idx.* FROM idx JOIN sample ON idx.url = sample.url)
            SELECT arc_path, CASE WHEN sound THEN url END AS url,
              CASE WHEN sound THEN payload_bytes + CASE WHEN k = 3 THEN 100 ELSE 0 END END
                AS content_length
            FROM arc
            WHERE arc_path IN (SELECT '{fx.ARCHIVE_BASE}' || arc_file FROM wanted
                               WHERE arc_file LIKE '%\\_1.arc.gz' ESCAPE '\\')""",
        "hosts_from_ordered_files": f"""WITH {_META}
            SELECT url, site AS host_domain FROM dom
            WHERE site IN (SELECT site FROM dom WHERE length(url) % 2 = 0)""",
        "html_normalised": f"""WITH {_PROFILES}
            SELECT url, replace(replace(html, 'no country</body>', 'no country</p></body>'), '<li>other</ul>', '</li><li>other</li></ul>') AS html
            FROM prof""",
        "html_css_select": r"""
            WITH plain AS (SELECT page_id, html, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
                regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages),
            texts AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad,
                array_to_string(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), ' ') AS links,
                CASE WHEN lang IN ('fr', 'de') THEN h1 ELSE '' END AS lang, '' AS none FROM plain),
            long AS (UNPIVOT texts ON title, ad, links, lang, none INTO NAME n VALUE t)
            SELECT page_id, max(t) FILTER (n = 'title') AS title, max(t) FILTER (n = 'ad') AS ad, max(t) FILTER (n = 'links') AS links,
              max(t) FILTER (n = 'lang') AS lang, max(t) FILTER (n = 'none') AS none
            FROM (SELECT page_id, n, replace(replace(replace(replace(trim(regexp_replace(t, '\s+', ' ', 'g')),
              '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM long) GROUP BY page_id""",
        "scan_listed_arc": f"""WITH {_records_sql()}
            SELECT arc_path, url, status, payload_bytes FROM arc
            WHERE sound AND page_id % 3 > 0 AND url NOT LIKE '%.org/%'""",
        "scan_listed_offsets": f"""WITH {_records_sql()}
            SELECT url, status, payload_bytes FROM arc
            WHERE status = 'OK' AND url IN (SELECT url FROM pages WHERE page_id % 3 > 0)""",
        "html_for_urls_files": f"""WITH {_records_sql()}
            SELECT url, md5(html) AS html_md5 FROM arc
            WHERE has_html AND (arc_path, url) IN (SELECT (arc_path, url) FROM arc WHERE page_id % 3 > 0)""",
        "with_source_path": "SELECT page_id, 'pages.parquet' AS path FROM pages",
        "write_tsv_escaped": "SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN text END AS text FROM documents",
        "tsv_misfits": "SELECT 'x' || page_id || chr(9) || url AS value FROM pages WHERE page_id % 5 = 0",
        "hosts_from_file": f"""WITH {_META}
            SELECT url, site AS host_domain FROM dom
            WHERE site IN (SELECT site FROM dom WHERE length(url) % 2 = 0)""",
        "profile_country_ordered": f"WITH {_PROFILES} SELECT url, country FROM located",
        "profile_status_counts": f"""WITH {_PROFILES}
            SELECT CASE WHEN h = 0 AND key % 12 = 0 THEN 'NO_NAME' ELSE 'OK' END AS status, count(*) AS n
            FROM prof WHERE h < 3 GROUP BY status""",
        "scan_first_of_many_files": "SELECT page_id FROM pages WHERE page_id % 4 < 2",
        "scan_pages": "SELECT page_id, url, octet_length(encode(html)) AS n_bytes FROM pages",
        "scan_by_name": "SELECT * FROM customer",
        "scan_first_n_files": "SELECT page_id, url FROM pages",
        "with_source_file": "SELECT url, 'pages.parquet' AS meta_file FROM pages",
        "scan_tsv": f"WITH {_META} SELECT domain_id, url FROM dom",
        "scan_seq": "SELECT url, md5(html) AS html_md5 FROM pages",
        "write_tsv": f"""WITH {_META}, {_INDEX}
            SELECT concat_ws(chr(9), domain_id, url, meta_file, arc_file, arc_offset) AS value FROM idx""",
        "write_seq": f"WITH {_PROFILES} SELECT url, country FROM located",
        "write_pages": "SELECT url, octet_length(encode(html)) AS n_bytes FROM pages",
        "scan_arc": f"""WITH {_records_sql()}
            SELECT arc_path, status,
              CASE WHEN sound THEN url END AS url, CASE WHEN sound THEN ip END AS ip,
              CASE WHEN sound THEN archive_ts END AS archive_ts,
              CASE WHEN sound THEN content_type END AS content_type,
              CASE WHEN sound THEN payload_bytes + CASE WHEN k = 3 THEN 100 ELSE 0 END END
                AS content_length,
              CASE WHEN sound THEN payload_bytes END AS payload_bytes
            FROM arc""",
        "scan_arc_status": f"WITH {_records_sql()} SELECT status, count(*) AS n FROM arc GROUP BY status",
        "arc_header_parse": f"""WITH {_records_sql()}
            SELECT page_id, k <> 1 AS header_ok,
              CASE WHEN k <> 1 THEN url END AS url, CASE WHEN k <> 1 THEN ip END AS ip,
              CASE WHEN k <> 1 THEN archive_ts END AS archive_ts,
              CASE WHEN k <> 1 THEN content_type END AS content_type,
              CASE WHEN k <> 1 THEN payload_bytes + CASE WHEN k = 3 THEN 100 ELSE 0 END END
                AS content_length
            FROM arc""",
        "http_parse": f"""WITH {_records_sql()}
            SELECT url, CASE WHEN k = 4 THEN -1 ELSE 200 END AS http_status,
              CASE WHEN k <> 4 THEN 2 END AS n_headers,
              CASE WHEN k <> 4 THEN http_type END AS http_type,
              CASE WHEN k <> 4 THEN page_id END AS page_id,
              CASE WHEN k <> 4 THEN body_bytes END AS body_bytes
            FROM arc WHERE sound""",
        "arc_html": f"WITH {_records_sql()} SELECT url, md5(html) AS html_md5 FROM arc WHERE has_html",
        "url_host": f"WITH {_META} SELECT url, host FROM meta",
        "host_domain": f"WITH {_CASES} SELECT page_id, host_domain FROM cases",
        "domain_id": f"WITH {_META} SELECT url, domain_id FROM dom",
        "url_status": f"""WITH {_CASES}
            SELECT page_id, host_domain, split_part(host_domain, '.', -1) AS domain_id, status
            FROM cases""",
        "url_status_counts": f"WITH {_CASES} SELECT status, count(*) AS n FROM cases GROUP BY status",
        "filter_valid_host": f"""WITH {_CASES}
            SELECT page_id, url FROM cases WHERE k NOT BETWEEN 4 AND 8""",
        "filter_http_ok": f"WITH {_META} SELECT url FROM meta WHERE http_result = 200",
        "count_urls_per_domain": f"""WITH {_META}
            SELECT domain_id, count(*) AS n FROM dom WHERE http_result = 200 GROUP BY domain_id""",
        "count_urls_per_host_domain": f"""WITH {_META}
            SELECT site AS host_domain, count(*) AS n FROM dom WHERE http_result = 200 GROUP BY site""",
        "arc_lookup_index": f"WITH {_META}, {_INDEX} SELECT * FROM idx",
        "keyword_count": """
            SELECT doc_id,
              CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INTEGER) AS n_the,
              CAST((length(t) - length(replace(t, 'que', ''))) / 3 AS INTEGER) AS n_que,
              CAST(0 AS INTEGER) AS n_empty
            FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
        "keyword_matches": f"WITH {_FOLDED} SELECT domain_id, url, keyword, freq FROM found",
        "keyword_matches_as_coded": f"WITH {_AS_GIVEN} SELECT domain_id, url, keyword, freq FROM found",
        "keyword_matches_concat": f"""WITH {_FOLDED}
            SELECT domain_id, url, string_agg(keyword || ',' || freq || ',', '' ORDER BY keyword) AS matches
            FROM found GROUP BY domain_id, url""",
        "vacancy_candidates": f"""WITH {_FOLDED}
            SELECT domain_id, url, keyword, freq FROM found
            WHERE url IN (SELECT url FROM found GROUP BY url HAVING count(*) >= 2)""",
        "vacancy_candidates_as_coded": f"WITH {_AS_GIVEN} SELECT domain_id, url, keyword, freq FROM found",
        "split_key": f"WITH {_FOLDED} SELECT domain_id, url, keyword || ',' || freq AS val FROM found",
        "candidate_urls": f"WITH {_FOLDED} SELECT DISTINCT domain_id, url FROM found",
        "candidate_count_per_domain": f"""WITH {_FOLDED}
            SELECT domain_id, count(DISTINCT url) AS n FROM found GROUP BY domain_id""",
        "stratum_filter": f"WITH {_META} SELECT domain_id, url FROM dom WHERE domain_id <> 'net'",
        "sample_quota": f"WITH {_META}, {_quota_sql('dom')} SELECT * FROM quota",
        "stratified_sample": f"WITH {_META}, {_quota_sql('dom')}, {_sample_sql('dom')} SELECT * FROM sample",
        "stratified_sample_dice": f"""WITH {_META}, {_quota_sql('dom')}, {_sample_sql('dom', _DIE)}
            SELECT * FROM sample""",
        "stratified_sample_copies": f"""WITH {_FOLDED}, {_quota_sql('found')}, {_sample_sql('found')}
            SELECT * FROM sample""",
        "sample_arc_files": f"""WITH {_PAGE_SAMPLE}
            SELECT idx.*, sample.domain_id AS sample_domain_id,
                   '{fx.ARCHIVE_BASE}' || arc_file AS arc_path
            FROM idx JOIN sample ON idx.url = sample.url""",
        "html_for_urls": f"""WITH {_PAGE_SAMPLE}, {_records_sql()}
            SELECT url, md5(html) AS html_md5 FROM arc
            WHERE has_html AND url IN (SELECT idx.url FROM idx JOIN sample ON idx.url = sample.url)""",
        "html_for_urls_unpaired": f"""WITH {_PAGE_SAMPLE}, {_records_sql()},
            wanted AS (SELECT idx.* FROM idx JOIN sample ON idx.url = sample.url)
            SELECT url, md5(html) AS html_md5 FROM arc
            WHERE has_html AND url IN (SELECT url FROM wanted)
              AND arc_path IN (SELECT '{fx.ARCHIVE_BASE}' || arc_file FROM wanted
                               WHERE arc_file LIKE '%\\_1.arc.gz' ESCAPE '\\')""",
        "arc_file_prune": f"""WITH {_PAGE_SAMPLE}, {_records_sql()},
            wanted AS (SELECT idx.* FROM idx JOIN sample ON idx.url = sample.url)
            SELECT arc_path, CASE WHEN sound THEN url END AS url,
              CASE WHEN sound THEN payload_bytes + CASE WHEN k = 3 THEN 100 ELSE 0 END END
                AS content_length
            FROM arc
            WHERE arc_path IN (SELECT '{fx.ARCHIVE_BASE}' || arc_file FROM wanted
                               WHERE arc_file LIKE '%\\_1.arc.gz' ESCAPE '\\')""",
        "filter_html_size": f"""
            SELECT * FROM (
              SELECT url, octet_length(encode(html)) AS content_length,
                CASE WHEN page_id % 10 = 0 THEN 'text/plain' ELSE 'text/html' END AS content_type
              FROM pages) AS typed
            WHERE contains(content_type, 'html') AND content_length < {HTML_LIMIT}""",
        "pages_for_hosts": f"""WITH {_records_sql()}
            SELECT url, md5(html) AS html_md5 FROM arc
            WHERE has_html AND regexp_matches(url, '[.]example[.](com|org)([/:?#]|$)')""",
        "html_select_text": """
            SELECT page_id, trim(regexp_replace(
              regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '\\s+', ' ', 'g')) AS ad_text
            FROM pages""",
        "profile_pages": f"WITH {_PROFILES} SELECT url, html FROM prof WHERE contains(url, '/profile/')",
        "profile_country": f"WITH {_PROFILES} SELECT url, country FROM located",
        "profiles_in_countries": f"WITH {_PROFILES} SELECT url, html FROM located WHERE {_IN_COUNTRIES}",
        "vacancy_archives": f"WITH {_VACANCY} SELECT domain_id, url, arc_path, arc_offset FROM chosen",
        "vacancy_html": f"""WITH {_VACANCY},
            docs AS (SELECT doc_id AS page_id, url, text AS html FROM texts), {_records_sql("docs")}
            SELECT url, md5(html) AS html_md5 FROM arc
            WHERE has_html AND url IN (SELECT url FROM chosen)""",
        "social_profile_countries": f"WITH {_PROFILES} SELECT url, country FROM located",
        "social_profiles_in_countries": f"""WITH {_PROFILES}
            SELECT url, html FROM located WHERE {_IN_COUNTRIES}""",
    }


# ---- training-data operators, where their subpackage is present ------------------------


def _llm():
    """The subpackage and its pipeline; nothing if either is not there at all."""
    try:
        import corpus_pipeline
        from gleaner.llm import queries as llm
    except ModuleNotFoundError as error:
        if error.name in ("corpus_pipeline", "gleaner.llm", "gleaner.llm.queries"):
            return None, None
        raise
    return llm, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = core_queries()
    llm, pipeline = _llm()
    if llm is not None:
        found |= llm.queries() | {"pipeline": pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = core_sql()
    llm, pipeline = _llm()
    if llm is not None:
        found |= llm.oracle_sql()
        if pipeline.ORACLE_SQL:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found
