"""Queries op1 to op10 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, langid, line_dedup, lm_scoring, mixing, quality, simhash, substring, warc, winnow
from .common import read_table


def _documents(f):
    return lambda spark, sf_dir: f(read_table(spark, sf_dir, "documents"))


def _quality(docs):
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _mix(docs):
    return mixing.mix_table(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def queries() -> dict:
    return {
        "op1_lm_scoring": _documents(lm_scoring.score_documents),
        "op2_line_dedup": _documents(line_dedup.report),
        "op3_warc": lambda spark, sf_dir: warc.report(read_table(spark, sf_dir, "pages")),
        "op4_mixing": _documents(_mix),
        "op5_quality": _documents(_quality),
        "op6_bpe": _documents(lambda docs: bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))),
        "op7_substring_dedup": _documents(substring.removed_words),
        "op8_winnowing": _documents(winnow.edited_likeness),
        "op9_simhash": _documents(simhash.near_duplicates),
        "op10_language_id": _documents(langid.identify),
    }


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_RULE = {r.name: r for r in quality.RULES}

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c
  FROM (SELECT doc_id, i, list_slice(w, i, i + 7) AS gram
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, 8) AS t(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars BETWEEN {_RULE["word_length"].low} * n_words AND {_RULE["word_length"].high} * n_words
       AND n_symbols <= {_RULE["symbols"].high} * n_words
       AND n_stop >= {_RULE["stop_words"].low} * n_words
       AND n_dup_lines <= {_RULE["duplicate_lines"].high} * n_lines AS kept
FROM v"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first
      FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d))),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM g, range(0, 13) AS t(k) WHERE first < doc_id),
e AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN x USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": QUALITY_SQL, "op7_substring_dedup": SUBSTRING_SQL}
