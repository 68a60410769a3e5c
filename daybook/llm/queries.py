"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bfd_packing, fill_middle, length_packing, mixing, near_dedup, ordinal, quality_rules, simhash, suffix_dedup, token_counts, url_filter, warc, whitening
from .common import table


def op1_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprinted(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    return ordinal.grade(docs, model)


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.pack(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_bfd_packing,
    op2_warc,
    op3_robust_outliers,
    op4_token_counts,
    op5_simhash,
    op6_mixing,
    op7_suffix_dedup,
    op8_near_duplicates,
    op9_ordinal_grades,
    op10_length_buckets,
    op11_url_filter,
    op12_whitening,
    op13_fill_middle,
)

ORACLE = {
    "op2_warc": """
        with rows as (select page_id, coalesce(html, '') as payload from pages),
        sized as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest from rows),
        last as (select *, max(page_id) over (partition by payload_digest) as final from sized)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 1000 and page_id < final then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id < final then final end as refers_to
        from last
    """,
    "op11_url_filter": r"""
        with split as (select page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
        rules(how, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fits as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(how, length(h || p)) as how
            from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
        labels as (select distinct host, unnest(string_split(host, '.')) as label from split),
        listed as (select distinct host from labels where regexp_matches(label, '(?:^|-)(?:ads|adult|bets|casino|gambling|pills|poker|porn|spam|viagra|warez|xxx)(?:-|$)'))
        select s.page_id, s.host, s.path, f.rule, coalesce(f.how, case when l.host is null then 'allow' else 'block' end) as verdict, l.host is not null as listed
        from split s left join fits f on f.page_id = s.page_id left join listed l on l.host = s.host
    """,
    "op13_fill_middle": r"""
        with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as digest from documents),
        h as (select *, ('0x' || digest[1:8])::bigint as h1, ('0x' || digest[9:16])::bigint as h2, ('0x' || digest[17:24])::bigint as h3, ('0x' || digest[25:32])::bigint as h4,
            regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units from d),
        c as (select *, len(units) as n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
        p as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from c),
        x as (select *, coalesce(array_to_string(units[1:a], ''), '') as head, coalesce(array_to_string(units[a + 1:b], ''), '') as middle, coalesce(array_to_string(units[b + 1:], ''), '') as tail from p)
        select doc_id, n, form, case form when 'plain' then null else length(head) end as prefix_chars, case form when 'plain' then null else length(middle) end as middle_chars,
            sha256(case form when 'plain' then text when 'spm' then '<S>' || tail || '<P>' || head || '<M>' || middle else '<P>' || head || '<S>' || tail || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
        from x
    """,
    "op8_near_duplicates": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0),
        sets as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle from places),
        sizes as (select doc_id, count(*) as n from sets group by doc_id),
        shared as (select x.doc_id as a, y.doc_id as b, count(*) as i from sets x join sets y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
        links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
        pairs as (select a, b from links union all select b, a from links),
        reach as (select distinct a as doc_id, a as other from pairs union select reach.doc_id, pairs.b from reach join pairs on pairs.a = reach.other),
        lowest as (select doc_id, min(other) as lowest from reach group by doc_id)
        select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(lowest, d.doc_id) as component_id, coalesce(lowest, d.doc_id) = d.doc_id as kept
        from documents d left join sizes s on s.doc_id = d.doc_id left join lowest l on l.doc_id = d.doc_id
    """,
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
