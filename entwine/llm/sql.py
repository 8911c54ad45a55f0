"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(pattern: str) -> str:
    """Lower-cased words of a text."""
    return f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}'), [])"


#: Sets of 4-word shingles; pairs with a shared shingle; links; the smallest document reachable over links.
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {words('[^ \\t\\n\\x0B\\f\\r]+')} AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: list_slice(ws, i, i + 3))) WHEN len(ws) > 0 THEN [ws] ELSE [] END AS sh FROM w),
 x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id AS at, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.at WHERE e.b > r.root)
 SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(root) FROM r WHERE r.at = s.doc_id), s.doc_id)) AS component_id FROM s"""

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP2 = f"""WITH d AS (SELECT doc_id, {words(WORD)} AS ws FROM documents), b AS (SELECT item_id, {words(WORD)} AS ws FROM benchmark),
 iw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + least(8, len(ws)) - 1) AS g FROM b, unnest(range(1, greatest(len(ws) - 6, 2))) t(i) WHERE len(ws) > 0),
 sizes AS (SELECT DISTINCT len(g) AS n FROM iw),
 dw AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS g FROM d, sizes, unnest(range(1, len(ws) - n + 2)) t(i)),
 h AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (g)),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
 it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
 SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: The tables' pages link within their hosts only, so no trust moves and a host's own rules decide.
OP8 = f"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 rules(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
 m AS (SELECT page_id, arg_max(h || q, len(h || q)) AS rule, arg_max(verdict, len(h || q)) AS by_rule FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
 j AS (SELECT page_id, host, path, rule, by_rule FROM p LEFT JOIN m USING (page_id)),
 c AS (SELECT host, count(*) AS n, count_if(by_rule = 'allow') AS good, count_if(by_rule = 'block') AS bad FROM j GROUP BY host)
 SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bad > good AND bad > n * 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN c USING (host)"""

ESCAPED = r"length(regexp_replace(replace(t, '\', '\\'), '([<\[])(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2', 'g'))"
OP9 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 s AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t) AS whole, coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '') AS loss,
  CAST(3 + sum(8 + 8 + 7 + length(r) + {ESCAPED}) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(r, ',' ORDER BY turn NULLS FIRST, r, t) || ',', '(system,)?(user,assistant,)+') AS valid FROM t GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM s"""

ORACLES = {"op1_jaccard_join": OP1, "op2_decontaminate": OP2, "op8_url_filter": OP8, "op9_chat_format": OP9}
