"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from webloom.llm import line_dedup

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Bytes as two hexadecimal digits each.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)),
least AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hits AS (SELECT doc_id, p FROM w JOIN least USING (s) WHERE first < doc_id),
steps AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM hits),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM steps),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS rest FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
w AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM d WHERE len(words) >= 13)),
least AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT DISTINCT doc_id, p + unnest(range(13)) AS p FROM w JOIN least USING (s) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT e.doc_id, count(hit.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE hit.p IS NULL) AS rest FROM each e LEFT JOIN hit ON e.doc_id = hit.doc_id AND e.p = hit.p GROUP BY e.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_PLAIN}, []) AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_PLAIN} AS words FROM benchmark),
windows AS (SELECT item, least(len(words), 10) AS n, words[p:p + 9] AS w FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
there AS (SELECT doc_id, n, p, words[p:p + n - 1] AS w FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, sizes WHERE len(words) >= n)),
found AS (SELECT doc_id, p, there.n, item FROM there JOIN windows ON there.w = windows.w),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, p + unnest(range(n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def _base32(part: int) -> str:
    digits = "".join(map(str, range(10))) + "".join(map(chr, range(65, 87)))
    letters = "".join(map(chr, range(65, 91))) + "234567"
    return f"translate(lpad(to_base(('0x' || substr(h, {10 * part + 1}, 10))::BIGINT, 32), 8, '0'), '{digits}', '{letters}')"


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {" || ".join(map(_base32, range(4)))} AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g
"""

ORACLES = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_decontamination": DECONTAMINATION,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op9_warc": WARC,
    "op10_line_dedup": line_dedup.SQL,
}
