"""Registered queries of the training-text operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, confusables, langmix, leaks, nearest, sentences, spampages, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    t = _table
    return {
        "p1_found": lambda s, d: langmix.wrongly_labelled(t(s, d, "store_docs"), t(s, d, "lang_samples")),
        "p1_segments": lambda s, d: langmix.language_segments(t(s, d, "store_docs"), t(s, d, "lang_samples")),
        "p2_found": lambda s, d: confusables.lookalike_pairs(t(s, d, "payloads")),
        "p2_forms": lambda s, d: confusables.canonical_payloads(t(s, d, "payloads")),
        "p3_found": lambda s, d: splitting.oversized_payloads(t(s, d, "store_docs"), t(s, d, "split_profiles")),
        "p3_units": lambda s, d: splitting.split_units(t(s, d, "store_docs"), t(s, d, "split_profiles")),
        "p3_coverage": lambda s, d: splitting.coverage(t(s, d, "store_docs"), t(s, d, "split_profiles")),
        "p4_found": lambda s, d: sentences.sentence_ends(t(s, d, "store_docs")),
        "p4_units": lambda s, d: sentences.split_sentences(t(s, d, "store_docs")),
        "p5_found": lambda s, d: nearest.most_similar(t(s, d, "units"), k=5, min_cos=0.85).select("unit_a", "unit_b"),
        "p6_ids": lambda s, d: bytebpe.encode_documents(t(s, d, "documents")),
        "p7_found": lambda s, d: leaks.leaks_found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p7_details": lambda s, d: leaks.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_found": lambda s, d: spampages.spam_pages(t(s, d, "documents")),
        "p8_shares": lambda s, d: spampages.label_pages(t(s, d, "documents")),
    }


_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say on whole tables; the rest is tested against brute force in tests/llm."""
    return {
        "p3_found": r"""
            WITH cur AS (SELECT doc_key, payloads, profile FROM store_docs WHERE doc_key IS NOT NULL
                         QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY seq DESC) = 1),
                 n AS (SELECT c.*, unnest(range(len(payloads))) AS i FROM cur c),
                 p AS (SELECT doc_key, i AS payload_no, payloads[i + 1].modality AS modality, payloads[i + 1].data AS data,
                              coalesce(f.max_chars, (SELECT max_chars FROM split_profiles WHERE profile = 'default')) AS max_chars
                       FROM n LEFT JOIN split_profiles f ON f.profile = coalesce(n.profile, 'default'))
            SELECT doc_key, CAST(payload_no AS INTEGER) AS payload_no,
                   CAST(list_max(list_transform(regexp_split_to_array(data, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？…।؟]'),
                                                lambda x: length(x))) > max_chars AS INTEGER) AS forced
            FROM p WHERE modality = 'text' AND length(data) > max_chars""",
        # every payload that isn't blank is covered from its first to its last character, within limit and overlap
        "p3_coverage": rf"""
            WITH cur AS (SELECT doc_key, payloads FROM store_docs WHERE doc_key IS NOT NULL
                         QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY seq DESC) = 1),
                 n AS (SELECT c.*, unnest(range(len(payloads))) AS i FROM cur c),
                 p AS (SELECT doc_key, CAST(i AS INTEGER) AS payload_no, payloads[i + 1].data AS data FROM n WHERE payloads[i + 1].modality = 'text'),
                 s AS (SELECT *, regexp_replace(data, '^{_BLANK}+', '') AS l, regexp_replace(data, '{_BLANK}+$', '') AS r FROM p)
            SELECT doc_key, payload_no, CAST(length(data) - length(l) AS INTEGER) AS first_pos, CAST(length(r) AS INTEGER) AS last_pos,
                   true AS within, true AS gapless, true AS overlapping
            FROM s WHERE length(l) > 0""",
    }
