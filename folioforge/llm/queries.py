"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import curriculum, licenses, periodic_runs, quality, rolling, warc
from .common import table


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import shingle_components

    return shingle_components(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import documents_as_files, scan_licenses

    return scan_licenses(documents_as_files(table(spark, sf_dir, "documents")), id_col="doc_id")


#: (verdict, host/path) of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


#: Addresses by form as in url_filters; pages of the tables hold no canonical links or refreshes, which SQL leaves out.
URL_ORACLE = r"""
with p as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, coalesce(lower(regexp_extract(rest, '^[^/?#]*', 0)), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
a as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*', '\1', 'g'), '&&+', '&', 'g'), '^&|&$', '', 'g') as query,
  case when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/7') then 'example.com/en/7'
       when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/de/8') then 'example.net/de/8'
       when (host = 'com' or suffix(host, '.com')) and prefix(path, '/en/') then 'com/en/'
       when (host = 'net' or suffix(host, '.net')) and prefix(path, '/de/') then 'net/de/'
       when (host = 'org' or suffix(host, '.org')) and prefix(path, '/es/') then 'org/es/' end as rule from h),
v as (select *, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' end as said,
  case when host <> '' then host || regexp_replace(path, '/+$', '') || case when query <> '' then '?' || query else '' end end as address from a),
c as (select address, bool_or(said = 'block') and not bool_or(said = 'allow') as blocked from v where said is not null and address is not null group by address)
select page_id, host, path, rule, coalesce(said, case when blocked then 'block' else 'allow' end) as verdict from v left join c using (address)
"""

QUERIES = {"op4_license_scans": op4_license_scans, "op3_url_filters": op3_url_filters, "op8_warc": op8_warc, "pipeline": pipeline, "op2_decontamination": op2_decontamination, "op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op10_toxicity": op10_toxicity, "op1_quality_rules": op1_quality_rules, "op5_token_binary": op5_token_binary, "op6_packing": op6_packing, "op9_token_counts": op9_token_counts, "op11_periodic_runs": periodic_runs.op11_periodic_runs, "op12_source_mix": curriculum.op12_source_mix, "op13_rolling_features": rolling.op13_rolling_features}
ORACLES: dict[str, str] = {"op1_quality_rules": quality.oracle(), "op3_url_filters": URL_ORACLE, "op4_license_scans": licenses.oracle(), "op8_warc": warc.ORACLE, "op11_periodic_runs": periodic_runs.ORACLE, "op12_source_mix": curriculum.ORACLE, "op13_rolling_features": rolling.ORACLE}
