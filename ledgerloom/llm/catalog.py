"""Queries of the numbered operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.decontamination import op2_decontamination
from ledgerloom.llm.filter_audit import op12_filter_audit
from ledgerloom.llm.fingerprints import op4_fingerprints
from ledgerloom.llm.html_pages import op13_html_extraction
from ledgerloom.llm.language import op10_language_id
from ledgerloom.llm.licenses import op9_license_scan
from ledgerloom.llm.near_duplicates import op1_jaccard_join
from ledgerloom.llm.negatives import op11_hard_negatives
from ledgerloom.llm.packing import op3_packing
from ledgerloom.llm.quality import op8_quality
from ledgerloom.llm.substrings import op6_substring_dedup
from ledgerloom.llm.toxicity import op5_toxicity
from ledgerloom.llm.urls import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_html_extraction": op13_html_extraction,
}

_WORDS = r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents"

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": f"""WITH RECURSIVE w AS ({_WORDS}),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS gram FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE k * 5 >= 4 * (a.n + b.n - k)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.y FROM reached JOIN links ON reached.b = links.x)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM links WHERE x = a) AS n_links FROM reached GROUP BY a""",
    "op6_substring_dedup": f"""WITH w AS ({_WORDS}),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS window_text FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
owners AS (SELECT window_text, min(doc_id) AS owner FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN owners USING (window_text), range(0, 50) AS t(k) WHERE owner < doc_id),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept_text, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) p LEFT JOIN gone USING (doc_id, j) WHERE gone.j IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::double) FOR x IN embedding] AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS other_id, c.label AS label, list_inner_product(a.v, c.v)::bigint AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::int AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10""",
    "op12_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY 1),
l AS (SELECT doc_id, max((quality = 1)::int) AS quality, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS bad, (len(ws) < 100)::int AS a, (100 * len(list_distinct(ws)) < 80 * len(ws))::int AS b,
(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::int AS c, regexp_matches(t, '[#$%&*|]')::int AS d, coalesce(d.doc_id > first_id, false)::int AS e
FROM d JOIN least USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
h AS (SELECT part, a, b, c, d, e, a + b + c + d + e AS n_failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT h.*, filter_order, step, own, CASE own WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 AS fails,
(a = 1 AND contains(earlier, 'A')) OR (b = 1 AND contains(earlier, 'B')) OR (c = 1 AND contains(earlier, 'C')) OR (d = 1 AND contains(earlier, 'D')) OR (e = 1 AND contains(earlier, 'E')) AS gone FROM h, steps),
o AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND n_failed = 1 THEN n ELSE 0 END) AS unique_fails,
sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
(sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM o""",
}
