"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from entwine.functions.normalize import LEGAL_SUFFIXES, SCORING_STOPWORDS, SEARCH_STOPWORDS
from entwine.operators.evaluation import ERRORS

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def text(x: str) -> str:
    return f"trim(regexp_replace(replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '\\([^)]*\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def name(x: str) -> str:
    return f"regexp_replace(regexp_replace({text(x)}, '(^| )e v$', ''), '([a-z0-9])( ({'|'.join(LEGAL_SUFFIXES)}))+$', '\\1')"


def among(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def search(x: str) -> str:
    return f"list_filter({words(name(x))}, lambda w: len(w) >= 2 AND w NOT IN {among(SEARCH_STOPWORDS)})"


def country(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '\\p{{L}}{{2}}') THEN CASE upper(trim({x})) WHEN 'UK' THEN 'GB' WHEN 'EL' THEN 'GR' ELSE upper(trim({x})) END ELSE {text(x)} END"


PARTS = f"""parts AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {HOST} AS host, upper(regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]{{2}})/', 1)) AS lang,
 regexp_extract({HOST}, '([a-z]+\\.[a-z]+)$', 1) AS city, CASE WHEN starts_with(url, 'https') THEN 'active' ELSE 'withdrawn' END AS status FROM pages)"""
ORGS = f"{PARTS}, orgs AS (SELECT 'page-' || page_id AS ror_id, title AS name, lang AS country_code, city, status FROM parts)"
NAMES = f"""{ORGS}, all_names AS (SELECT page_id * 2 AS name_id, 'page-' || page_id AS ror_id, title AS value, {name('title')} AS norm, 'ror_display' AS kind FROM parts
 UNION ALL SELECT page_id * 2 + 1, 'page-' || page_id, host, {name('host')}, 'alias' FROM parts), names AS (SELECT * FROM all_names WHERE norm <> '')"""
RAW = "raw_queries AS (SELECT 'q-' || page_id AS query_id, substr(title, 1, 2) || substr(title, 4) || ' GmbH' AS query, lang AS country, city FROM parts)"
QUERIES = f"{RAW}, queries AS (SELECT query_id, query, {name('query')} AS norm FROM raw_queries)"
CASES = f"cases AS (SELECT q.query_id AS case_id, query, country, q.city, CASE WHEN status = 'active' THEN 'page-' || page_id END AS expected_ror_id, coalesce(nullif(country, ''), 'default') AS stratum FROM raw_queries q JOIN parts p ON q.query_id = 'q-' || p.page_id)"
PHRASES = f"phrase_rows AS (SELECT query_id, unnest(list_slice({search('norm')}, 1, 8)) AS phrase FROM queries), phrases AS (SELECT query_id, phrase, count(*) AS times FROM phrase_rows GROUP BY ALL)"
POSTINGS = f"posting_rows AS (SELECT name_id, unnest({words('norm')}) AS token FROM names), postings AS (SELECT token, name_id, count(*) AS tf FROM posting_rows GROUP BY ALL)"
HITS = "hits AS (SELECT phrase, name_id, CAST(sum(tf) AS BIGINT) AS hits FROM (SELECT DISTINCT phrase FROM phrases) JOIN postings ON starts_with(token, phrase) AND len(token) >= 2 GROUP BY ALL)"
GRAM_LIST = "list_transform(range(1, greatest(len(norm) - 1, 1)), lambda i: substr(norm, i, 3))"
GRAM_PHRASES = f"gram_lists AS (SELECT query_id, list_slice(list_sort(list_distinct(list_filter({GRAM_LIST}, lambda g: NOT contains(g, ' ')))), 1, 64) AS grams FROM queries), gram_phrases AS (SELECT query_id, unnest(grams) AS phrase, 1 AS times FROM gram_lists)"
GRAM_POSTINGS = f"gram_rows AS (SELECT name_id, unnest({GRAM_LIST}) AS token FROM names), gram_postings AS (SELECT token, name_id, count(*) AS tf FROM gram_rows GROUP BY ALL)"
GRAM_HITS = "gram_hits AS (SELECT token AS phrase, name_id, tf AS hits FROM gram_postings WHERE token IN (SELECT phrase FROM gram_phrases))"


def ranked(prefix: str, phrases: str, hits: str, length: str) -> str:
    """CTEs of a BM25 shortlist; the last is <prefix>_list (query_id, ror_id, best, place)."""
    return f"""{prefix}_len AS (SELECT name_id, {length} AS dl FROM names), {prefix}_all AS (SELECT count(*) AS n_rows, avg(dl) AS mean FROM {prefix}_len),
 {prefix}_df AS (SELECT phrase, count(*) AS n FROM {hits} GROUP BY ALL),
 {prefix}_w AS (SELECT phrase, mean, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM {prefix}_df, {prefix}_all),
 {prefix}_part AS (SELECT h.phrase, h.name_id, idf * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM {hits} h JOIN {prefix}_w USING (phrase) JOIN {prefix}_len USING (name_id)),
 {prefix}_score AS (SELECT query_id, name_id, -round(sum(CAST(part AS DOUBLE) * times), 9) AS score FROM {phrases} JOIN {prefix}_part USING (phrase) GROUP BY ALL),
 {prefix}_best AS (SELECT * FROM {prefix}_score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, name_id) <= 250),
 {prefix}_org AS (SELECT query_id, n.ror_id, min(score) AS best FROM {prefix}_best JOIN names n USING (name_id) JOIN orgs o ON o.ror_id = n.ror_id AND o.status = 'active' GROUP BY ALL),
 {prefix}_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, ror_id) AS place FROM {prefix}_org QUALIFY place <= 50)"""


WORD_LIST = f"{NAMES}, {QUERIES}, {PHRASES}, {POSTINGS}, {HITS}, " + ranked("w", "phrases", "hits", f"len({words('norm')})")
GRAM_ONLY = f"{GRAM_PHRASES}, {GRAM_POSTINGS}, {GRAM_HITS}, " + ranked("t", "gram_phrases", "gram_hits", "greatest(len(norm) - 2, 0)")
EXACT = "exact_rows AS (SELECT DISTINCT query_id, o.ror_id FROM queries q JOIN names n ON n.norm = q.norm JOIN orgs o ON o.ror_id = n.ror_id AND o.status = 'active' WHERE q.norm <> ''), exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ror_id) AS place FROM exact_rows QUALIFY place <= 500)"
CANDIDATES = f"""{WORD_LIST}, {GRAM_ONLY}, {EXACT}, staged AS (SELECT query_id, ror_id, 0 AS stage, place FROM exact UNION ALL SELECT query_id, ror_id, 1, place FROM w_list UNION ALL SELECT query_id, ror_id, 2, place FROM t_list),
 cand AS (SELECT query_id, ror_id, min(stage * 1000 + place) AS o, bool_or(stage = 0) AS by_exact, bool_or(stage = 1) AS by_words, bool_or(stage = 2) AS by_trigrams FROM staged GROUP BY ALL)"""
DECIDED = f"""{NAMES}, queries AS (SELECT ror_id AS query_id, {name('name')} AS norm, nullif({country('country_code')}, '') AS country_n FROM orgs), {EXACT},
 evidence AS (SELECT query_id, e.ror_id, e.place, country_n, CASE WHEN country_n IS NULL OR nullif({country('o.country_code')}, '') IS NULL THEN NULL ELSE country_n = {country('o.country_code')} END AS country_match,
  CASE WHEN nullif({text('o.city')}, '') IS NULL THEN NULL ELSE {text('o.city')} = 'example com' END AS city_match, len(list_filter({words('q.norm')}, lambda w: len(w) >= 3 AND w NOT IN {among(SCORING_STOPWORDS)})) AS signal
  FROM exact e JOIN queries q USING (query_id) JOIN orgs o ON o.ror_id = e.ror_id),
 scored AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE + CASE WHEN country_match THEN 0.04 WHEN NOT country_match THEN -0.03 ELSE 0 END + CASE WHEN city_match THEN 0.03 WHEN NOT city_match THEN -0.02 ELSE 0 END)) AS score FROM evidence),
 placed AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS margin, count_if(coalesce(country_match, false)) OVER (PARTITION BY query_id) AS alone FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, place)),
 decided AS (SELECT *, rank = 1 AND score >= 0.86 AND (margin >= 0.03 OR (coalesce(country_match, false) AND alone = 1)) AND coalesce(country_match, true) AS match FROM placed)"""
PARTICIPANTS = "participants AS (SELECT o_orderkey AS row_idx, CAST(o_custkey AS VARCHAR) AS org, c_name AS name, n_name AS country, c_mktsegment AS activity, CAST(o_orderkey - o_orderkey % 3 AS VARCHAR) AS project, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
FIRSTS = f"{PARTICIPANTS}, firsts AS (SELECT * FROM participants QUALIFY row_number() OVER (PARTITION BY org ORDER BY row_idx) = 1)"
ENRICHED = f"""{PARTICIPANTS}, days AS (SELECT CAST(user_id AS VARCHAR) AS org, day(ts) AS year, count(*) AS works, CAST(sum(floor(value)) AS BIGINT) AS cited FROM events GROUP BY ALL),
 inst AS (SELECT org, CAST(sum(works) AS BIGINT) AS total, CAST(coalesce(sum(works) FILTER (year BETWEEN 5 AND 20), 0) AS BIGINT) AS works, CAST(coalesce(sum(cited) FILTER (year BETWEEN 5 AND 20), 0) AS BIGINT) AS cited,
  '[' || coalesce(string_agg('{{"cited_by_count":' || cited || ',"works_count":' || works || ',"year":' || year || '}}', ',' ORDER BY year) FILTER (year BETWEEN 5 AND 20), '') || ']' AS counts FROM days GROUP BY ALL),
 enriched AS (SELECT p.*, i.org IS NOT NULL AS joined, total, works, cited, counts FROM participants p LEFT JOIN inst i USING (org))"""
ORGANIZATIONS = f"""{ENRICHED}, marked AS (SELECT *, row_number() OVER (PARTITION BY org, project ORDER BY row_idx) = 1 AS first FROM enriched WHERE joined),
 organizations AS (SELECT org AS ror_id, arg_min(name, row_idx) AS ror_name, arg_min(country, row_idx) AS country, arg_min(activity, row_idx) AS activity_type, count_if(first) AS cordis_project_count, round(coalesce(sum(amount) FILTER (first), 0), 2) AS cordis_ec_contribution,
  count_if(first) AS cordis_contribution_rows, '5' AS openalex_from_year, '20' AS openalex_to_year, arg_min(works, row_idx) AS openalex_works_count_period, arg_min(cited, row_idx) AS openalex_cited_by_count_period FROM marked GROUP BY org)"""
ORACLES = {
    "e_normalize": f"WITH {NAMES} SELECT name_id, {text('value')} AS text, norm, array_to_string({search('value')}, ' ') AS search, array_to_string(list_filter({words('norm')}, lambda w: len(w) >= 3 AND w NOT IN {among(SCORING_STOPWORDS)}), ' ') AS scoring, CASE WHEN regexp_matches(value, '[^\\x00-\\x7F]') THEN 'multilingual' WHEN len(value) <= 6 AND len(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')) = 1 THEN 'acronym' WHEN len(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')) <= 2 THEN 'short_name' ELSE 'standard' END AS stratum FROM names",
    "e_country": f"SELECT country, {country('country')} AS country_n FROM (SELECT n_name AS country FROM nation UNION ALL SELECT DISTINCT lang FROM documents)",
    "e_case_identifier": f"WITH {PARTS}, {RAW} SELECT query_id, 'case-' || substr(sha256(lower(trim(query)) || '|' || lower(trim(country)) || '|' || lower(trim(city))), 1, 12) AS case_id FROM raw_queries",
    "e_amounts": "SELECT o_orderkey, o_totalprice AS amount, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders",
    "e_identity": f"WITH {PARTICIPANTS} SELECT row_idx, CASE WHEN activity <> 'BUILDING' THEN 'cordis:' || org ELSE 'fallback:' || {name('name')} || '|' || {country('country')} || '|' END AS identity FROM participants",
    "e13_property": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN nullif(trim(json_extract_string(props, '$.k')), '') END AS value FROM events",
    "c1_exact": f"WITH {NAMES}, queries AS (SELECT name_id AS query_id, norm FROM names), {EXACT} SELECT query_id, ror_id, place FROM exact",
    "c2_active": f"WITH {ORGS} SELECT ror_id, name, country_code, city FROM orgs WHERE status = 'active'",
    "c6_count": "SELECT count(*) AS organizations FROM pages",
    "c7_records": f"WITH {NAMES} SELECT o.ror_id, o.name, coalesce(string_agg(kind || '=' || value, '|' ORDER BY kind, value), '') AS names FROM orgs o LEFT JOIN names n USING (ror_id) GROUP BY ALL",
    "c9_phrases": f"WITH {NAMES}, {QUERIES}, {PHRASES} SELECT * FROM phrases",
    "c10_trigrams": f"WITH {NAMES}, {QUERIES}, {GRAM_PHRASES} SELECT query_id, array_to_string(grams, ',') AS grams FROM gram_lists",
    "c3_bm25_words": f"WITH {WORD_LIST} SELECT query_id, ror_id, round(best, 6) AS best, place FROM w_list",
    "c4_bm25_trigrams": f"WITH {NAMES}, {QUERIES}, {GRAM_ONLY} SELECT query_id, ror_id, round(best, 6) AS best, place FROM t_list",
    "d1_candidates": f"WITH {CANDIDATES} SELECT query_id, ror_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS source_order, by_exact, by_words, by_trigrams FROM cand",
    "d2_blocking_hits": f"WITH {CANDIDATES}, {CASES} SELECT case_id AS query_id, expected_ror_id AS ror_id FROM cases WHERE EXISTS (SELECT 1 FROM cand WHERE cand.query_id = case_id AND cand.ror_id = expected_ror_id)",
    "d3_prefix_hits": f"WITH {NAMES}, {QUERIES}, {PHRASES}, {POSTINGS}, {HITS} SELECT * FROM hits",
    "d4_trigram_postings": f"WITH {NAMES}, {GRAM_POSTINGS} SELECT * FROM gram_postings",
    "g1_repeated": f"WITH {PARTS}, {RAW} SELECT lower(trim(query)) AS query, lower(trim(country)) AS country, lower(trim(city)) AS city, count(*) AS count FROM raw_queries GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "g2_identities": f"WITH {FIRSTS} SELECT 'cordis:' || org AS identity, row_idx FROM firsts",
    "g3_identity_queries": f"WITH {FIRSTS} SELECT 'cordis:' || org AS query_id, name AS query, country, CAST(NULL AS VARCHAR) AS city FROM firsts",
    "g7_enrich": f"WITH {ENRICHED} SELECT row_idx, org AS ror_id, CASE WHEN joined THEN 'joined' ELSE 'not_found' END AS openalex_status, coalesce(CAST(total AS VARCHAR), '') AS openalex_works_count_total, coalesce(CAST(works AS VARCHAR), '') AS openalex_works_count_period, coalesce(CAST(cited AS VARCHAR), '') AS openalex_cited_by_count_period, coalesce(counts, '[]') AS openalex_counts_by_year FROM enriched",
    "g9_cohort": f"WITH {FIRSTS}, turns AS (SELECT org, country, row_number() OVER (PARTITION BY country ORDER BY sha256('42|cordis:' || org), org) AS turn FROM firsts), chosen AS (SELECT org FROM turns ORDER BY turn, country LIMIT 100) SELECT row_idx, org AS \"organisationID\", country FROM participants WHERE org IN (SELECT org FROM chosen)",
    "g10_gold_template": f"WITH {FIRSTS}, turns AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY sha256('42|cordis:' || org), org) AS turn FROM firsts) SELECT 'cordis:' || org AS source, name AS query, country, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS expected_ror_id, 'short_name' AS stratum, 'unlabelled' AS notes FROM turns ORDER BY turn, country LIMIT 50",
    "h1_organizations": f"WITH {ORGANIZATIONS} SELECT * FROM organizations",
    "h2_groups": f"WITH {ORGANIZATIONS} SELECT country, activity_type, count(*) AS organization_count, CAST(sum(cordis_project_count) AS BIGINT) AS cordis_project_participations, round(sum(cordis_ec_contribution), 2) AS cordis_ec_contribution, CAST(sum(openalex_works_count_period) AS BIGINT) AS openalex_works_count_period, CAST(sum(openalex_cited_by_count_period) AS BIGINT) AS openalex_cited_by_count_period FROM organizations GROUP BY ALL",
    "h3_summary": f"WITH {ORGANIZATIONS} SELECT (SELECT count(*) FROM participants) AS source_rows, 0::BIGINT AS unmatched_rows, count(*) AS joined_organizations, round(corr(cordis_project_count, openalex_works_count_period), 6) AS project_count_works_pearson, round(corr(cordis_ec_contribution, openalex_works_count_period), 6) AS contribution_works_pearson FROM organizations",
    "i4_suggest": "SELECT * FROM (VALUES ('country', 'Country code or country name'), ('city', 'City')) t(id, name)",
}
