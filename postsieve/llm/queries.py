"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postsieve.llm import importance, licenses, lines, lm, mixing, near, packing, phrases, pii, ranking, secrets, tokens, warc
from postsieve.llm.common import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir), licenses.known_digests(spark))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(warc.round_trip(spark, table(spark, sf_dir, "pages")))


def op3_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secrets.scan_secrets(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


def op4_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir, "source"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir)).drop("found")


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge_documents(documents(spark, sf_dir, "source"))


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "spans")


def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_digests, op2_warc_transactions, op3_token_efficiency, op4_whole_tokens, op5_curriculum_mix,
        op6_order_minhash, op7_disclosing_terms, op8_deleted_interpolation, op9_line_frequency, op10_positional_index,
        op11_nra_search, op12_importance_resampling, op13_configuration_packing,
    )
}

ORACLE: dict[str, str] = {
    "op2_warc_transactions": """
        with p as (
          select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n, url from pages),
        g as (select h, max(page_id) head from p where n >= 1000 group by h)
        select page_id, n::bigint payload_bytes, sha1(p.h) payload_digest,
          case when head is null or head = page_id then 'response' else 'revisit' end record_type,
          case when head <> page_id then head end refers_to,
          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) host
        from p left join g on p.h = g.h and n >= 1000""",
    "op11_nra_search": r"""
        with d as (
          select row_number() over () no, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') words
          from documents),
        s as (select count(*) filter (len(words) > 0) n_docs, sum(len(words))::bigint n_all from d),
        p as (select no, doc_id, term, len(words) n, count(*) tf
              from (select no, doc_id, words, unnest(words) term from d) group by all),
        w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint w
              from (select term, count(*) df from p group by term), s),
        q as (select item_id, term, count(*) times from (
                select item_id, unnest(regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark) group by all),
        scored as (
          select item_id, no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all))))::bigint score
          from q join w using (term) join p using (term), s group by all)
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last, no))::int "rank", doc_id, score
        from scored where score > 0 qualify "rank" <= 10""",
}
