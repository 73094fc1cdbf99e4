"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontaminate, language_id, near_dedup, ngram_lm, quality_classifier, quality_rules, sharding, token_files, warc

QUERIES = {
    "op1_ngram_llr_rules": quality_rules.query,
    "op2_cgk_decontamination": decontaminate.query,
    "op3_ranked_token_files": token_files.query,
    "op4_minimax_shards": sharding.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_warc": warc.query,
    "op7_family_svm": language_id.query,
    "op8_setsketch_dedup": near_dedup.query,
    "op9_cotraining": quality_classifier.query,
    "op10_elias_fano_lm": ngram_lm.query,
}

SQL: dict[str, str] = {
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS leader FROM p GROUP BY 1),
d AS (SELECT p.page_id, leader, strlen(p.h) AS n, sha1(p.h) AS x FROM p JOIN g USING (h))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((cast('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> leader THEN leader END AS refers_to FROM d""",
    "op8_setsketch_dedup": """WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))
  WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id, min(to_id) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
