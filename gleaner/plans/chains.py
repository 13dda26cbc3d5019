"""The stages joined into whole jobs.

Stages that several later ones read are written out once (``cut_lineage``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.index import arc_lookup_index, sample_arc_files
from gleaner.operators.keywords import (
    DOCUMENTED,
    candidate_count_per_domain,
    candidate_urls,
    vacancy_candidates,
)
from gleaner.operators.pages import html_for_urls, on_hosts, pages_for_hosts
from gleaner.operators.profiles import (
    LINKEDIN,
    VIADEO,
    XING,
    may_be_profile,
    profile_country,
    profiles_in_countries,
)
from gleaner.operators.sampling import stratified_sample
from gleaner.session import cut_lineage
from gleaner.sources.archives import mentions, readable, scan_arc, scan_listed_arc

SOCIAL_SITES = (LINKEDIN, VIADEO, XING)


@dataclass(frozen=True)
class VacancyStages:
    candidates: DataFrame
    counts: DataFrame
    sample: DataFrame
    archives: DataFrame


def vacancy_stages(
    texts: DataFrame,
    metadata: DataFrame,
    keywords: Sequence[str],
    sample_size: int,
    base: str = "",
    min_keywords: int = 2,
    mode: str = DOCUMENTED,
    seed: int = 0,
    dice: bool = False,
) -> VacancyStages:
    """Keyword search, cleaning, counting, sampling and the index join.

    The texts are searched once: the distinct candidates are stored, and so is the sample.
    """
    matches = vacancy_candidates(texts, keywords, min_keywords, mode)
    candidates = cut_lineage(candidate_urls(matches, ordered=False))
    counts = candidate_count_per_domain(candidates)
    sample = cut_lineage(stratified_sample(candidates, counts, sample_size, seed, dice))
    archives = sample_arc_files(arc_lookup_index(metadata), sample, base)
    return VacancyStages(candidates, counts, sample, archives)


def _wanted(stages: VacancyStages) -> DataFrame:
    return cut_lineage(stages.archives.select("arc_path", "url").distinct())


def vacancy_html(records: DataFrame, stages: VacancyStages, pairwise: bool = True) -> DataFrame:
    """``url, html`` of the sampled vacancy pages among ``records``."""
    return html_for_urls(records, _wanted(stages), pairwise)


def vacancy_html_from_files(
    spark: SparkSession,
    root: str,
    stages: VacancyStages,
    prefix: str = "",
    pairwise: bool = True,
) -> DataFrame:
    """The same from archive files below ``root``; only the listed files are opened.

    ``prefix`` is what stands before the listed paths where the files are stored.
    """
    wanted = _wanted(stages)
    listed = wanted if pairwise else wanted.select("arc_path")
    records = scan_listed_arc(spark, root, listed, prefix)
    return html_for_urls(readable(records), wanted, pairwise)


def social_records(
    spark: SparkSession, paths: str | list[str], sites: Sequence[str] = SOCIAL_SITES
) -> DataFrame:
    """Readable archive records that may be pages of the sites, for the two jobs below."""
    return readable(scan_arc(spark, paths, keep=mentions(sites)))


def _social_pages(records: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Pages that site and address say are profiles; only those are decoded, and the site is kept."""
    on_sites = on_hosts(records, sites).where(may_be_profile())
    return pages_for_hosts(on_sites, sites, with_host=True)


def social_profile_countries(
    records: DataFrame, sites: Sequence[str] = SOCIAL_SITES
) -> DataFrame:
    """``url, country`` of profile pages straight from archive records."""
    return profile_country(_social_pages(records, sites))


def social_profiles_in(
    records: DataFrame, countries: Sequence[str] | DataFrame, sites: Sequence[str] = SOCIAL_SITES
) -> DataFrame:
    """``url, html`` of profile pages of the given countries, from archive records."""
    return profiles_in_countries(_social_pages(records, sites), countries)
