"""DuckDB SQL of fuzzy scoring and of the decision: a second, independent form of what similarity.py and matching.py work out.

The longest common subsequence is worked out in the bits of a HUGEINT, so strings may have 120 characters.
"""

from __future__ import annotations

from dataclasses import replace

from entwine.config import MatchConfig, ablations
from entwine.plans import sql


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns."""
    full = f"((1::HUGEINT << len({a})::HUGEINT) - 1)"
    places = f"coalesce(list_sum(list_transform(range(0, len({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END)), 0)::HUGEINT"
    rows = f"list_transform(string_split({b}, ''), lambda c: {places})"
    return f"(len({a}) - bit_count(list_reduce({rows}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full})))"


def percent(apart: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (1 - ({apart})::DOUBLE / ({whole})::DOUBLE) END"


def ratio(a: str, b: str) -> str:
    return percent(f"len({a}) + len({b}) - 2 * {lcs(a, b)}", f"len({a}) + len({b})")


def signal(x: str, least: int) -> str:
    return f"list_filter({sql.words(x)}, lambda w: len(w) >= {least} AND w NOT IN {sql.among(sql.SCORING_STOPWORDS)})"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def similarities(p: str, pairs: str, config: MatchConfig) -> str:
    """CTEs from distinct pairs (a, b) of different strings to <p>_scores: a, b, coverage, ratio, token_sort, token_set, weighted, raw, name_score. Without coverage the ratios are null and the score is 0."""
    kept = "WHERE coverage > 0" if config.use_coverage else ""
    score = "raw * coverage" if config.use_coverage else "raw"
    missing = lambda x, y: f"list_filter({x}, lambda t: NOT list_contains({y}, t))"
    slide = lambda short, long: f"SELECT x, y, {short} AS s, {long} AS l FROM {p}_wanted WHERE len({short}) <= len({long}) AND {short} <> ''"
    return f"""{p}_strings AS (SELECT DISTINCT s FROM (SELECT a AS s FROM {pairs} UNION ALL SELECT b FROM {pairs})),
 {p}_tokens AS (SELECT s, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t, len(l) AS n FROM (SELECT s, {signal('s', config.min_scoring_token_len)} AS l FROM {p}_strings)),
 {p}_vocabulary AS (SELECT DISTINCT t FROM {p}_tokens),
 {p}_close AS (SELECT x.t AS t, y.t AS u FROM {p}_vocabulary x JOIN {p}_vocabulary y ON 2 * least(len(x.t), len(y.t)) / (len(x.t) + len(y.t)) >= {config.token_coverage_threshold}::DOUBLE),
 {p}_near AS (SELECT t, u FROM {p}_close WHERE t = u OR ({ratio('t', 'u')}) / 100.0 >= {config.token_coverage_threshold}::DOUBLE),
 {p}_met AS (SELECT a, b, x.i AS i, y.i AS j, x.n AS n, y.n AS m FROM {pairs} JOIN {p}_tokens x ON x.s = a JOIN {p}_near w ON w.t = x.t JOIN {p}_tokens y ON y.s = b AND y.t = w.u),
 {p}_covered AS (SELECT a, b, count(DISTINCT i) / any_value(n) * pow(count(DISTINCT j) / any_value(m), {config.compactness_exponent}::DOUBLE) AS coverage FROM {p}_met GROUP BY ALL),
 {p}_some AS (SELECT a, b, coalesce(coverage, 0.0) AS coverage, {sql.words('a')} AS ta, {sql.words('b')} AS tb FROM {pairs} LEFT JOIN {p}_covered USING (a, b)),
 {p}_sets AS (SELECT *, list_sort(list_distinct(ta)) AS da, list_sort(list_distinct(tb)) AS db, {joined('list_sort(ta)')} AS sa, {joined('list_sort(tb)')} AS sb, greatest(len(a), len(b)) / nullif(least(len(a), len(b)), 0) AS stretch FROM {p}_some {kept}),
 {p}_parts AS (SELECT *, {joined(missing('da', 'db'))} AS la, {joined(missing('db', 'da'))} AS lb, {joined("list_filter(da, lambda t: list_contains(db, t))")} AS shared FROM {p}_sets),
 {p}_wanted AS (SELECT DISTINCT * FROM (SELECT a AS x, b AS y FROM {p}_parts WHERE stretch >= 1.5 UNION ALL SELECT sa, sb FROM {p}_parts WHERE stretch >= 1.5 AND shared = '' UNION ALL SELECT {joined('da')}, {joined('db')} FROM {p}_parts WHERE stretch >= 1.5 AND shared = '')),
 {p}_slides AS ({slide('x', 'y')} UNION ALL {slide('y', 'x')}),
 {p}_windows AS (SELECT DISTINCT s, l, substr(l, greatest(i, 0) + 1, least(i + len(s), len(l)) - greatest(i, 0)) AS w FROM (SELECT s, l, unnest(range(1 - len(s), len(l))) AS i FROM (SELECT DISTINCT s, l FROM {p}_slides))),
 {p}_slid AS (SELECT s, l, max({ratio('s', 'w')}) AS best FROM {p}_windows GROUP BY ALL),
 {p}_partial AS (SELECT x, y, max(best) AS partial FROM {p}_slides JOIN {p}_slid USING (s, l) GROUP BY ALL),
 {p}_single AS (SELECT r.*, {ratio('a', 'b')} AS ratio, {ratio('sa', 'sb')} AS token_sort, len(shared) AS k, CASE WHEN shared <> '' THEN 1 ELSE 0 END AS gap, len(la) + len(lb) - 2 * {lcs('la', 'lb')} AS apart,
   coalesce(w.partial, 0.0) AS partial, CASE WHEN shared <> '' THEN 100.0 ELSE greatest(coalesce(s.partial, 0.0), coalesce(u.partial, 0.0)) END AS partial_token
  FROM {p}_parts r LEFT JOIN {p}_partial w ON w.x = a AND w.y = b LEFT JOIN {p}_partial s ON s.x = sa AND s.y = sb LEFT JOIN {p}_partial u ON u.x = {joined('da')} AND u.y = {joined('db')}),
 {p}_all AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN shared <> '' AND (la = '' OR lb = '') THEN 100.0 ELSE greatest({percent('apart', '2 * k + 2 * gap + len(la) + len(lb)')},
   CASE WHEN shared <> '' THEN {percent('gap + len(la)', '2 * k + gap + len(la)')} ELSE 0.0 END, CASE WHEN shared <> '' THEN {percent('gap + len(lb)', '2 * k + gap + len(lb)')} ELSE 0.0 END) END AS token_set FROM {p}_single),
 {p}_weighed AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN stretch < 1.5 THEN greatest(ratio, 0.95 * greatest(token_sort, token_set)) ELSE greatest(ratio, CASE WHEN stretch <= 8 THEN 0.9 ELSE 0.6 END * partial, 0.95 * (CASE WHEN stretch <= 8 THEN 0.9 ELSE 0.6 END)::DOUBLE * partial_token) END AS weighted FROM {p}_all),
 {p}_raw AS (SELECT *, greatest(token_set, token_sort, weighted) / 100.0 AS raw FROM {p}_weighed),
 {p}_scores AS (SELECT a, b, x.coverage, ratio, token_sort, token_set, weighted, coalesce(raw, 0.0) AS raw, coalesce({score}, 0.0) AS name_score FROM (SELECT a, b, coverage FROM {p}_some) x LEFT JOIN (SELECT * EXCLUDE (coverage), coverage AS c FROM {p}_raw) r USING (a, b))""".replace("raw * coverage", "raw * c")


def candidates(p: str, config: MatchConfig) -> str:
    """CTE <p>_cand: query_id, ror_id, source_order, from the shortlists exact, w_list and t_list."""
    stages = ["SELECT query_id, ror_id, 0 AS stage, place FROM exact"]
    stages += ["SELECT query_id, ror_id, 1, place FROM w_list"] * config.use_fts + ["SELECT query_id, ror_id, 2, place FROM t_list"] * config.use_trigram
    return f"{p}_cand AS (SELECT query_id, ror_id, row_number() OVER (PARTITION BY query_id ORDER BY min(stage * 1000 + place)) AS source_order FROM ({' UNION ALL '.join(stages)}) GROUP BY query_id, ror_id)"


def decided(p: str, config: MatchConfig = MatchConfig()) -> str:
    """CTEs from <p>_cand to <p>_decided: every candidate with best name, scores, evidence, rank, margin and match."""
    step = lambda flag, on, up, down: f"CASE WHEN {flag} THEN {up}::DOUBLE WHEN NOT {flag} THEN -{down}::DOUBLE ELSE 0.0 END" if on else "0.0"
    clear = f"(margin >= {config.min_margin}::DOUBLE OR (exact_match AND coalesce(country_match, false) AND alone = 1))" if config.use_margin else "true"
    guard = "(exact_match OR signal >= 2)" if config.require_multi_token_fuzzy_signal else "true"
    return f"""{p}_pairs AS (SELECT DISTINCT q.norm AS a, n.norm AS b FROM {p}_cand JOIN queries q USING (query_id) JOIN names n USING (ror_id) WHERE q.norm <> n.norm),
 {similarities(p, p + '_pairs', config)},
 {p}_named AS (SELECT c.query_id, c.ror_id, c.source_order, coalesce(n.value, '') AS best_name, coalesce(n.kind, 'missing') AS best_kind, coalesce(n.norm = q.norm, false) AS exact_match, CASE WHEN n.norm = q.norm THEN 1.0 ELSE greatest(coalesce(s.name_score, 0.0), 0.0) END AS name_score
  FROM {p}_cand c JOIN queries q USING (query_id) LEFT JOIN names n USING (ror_id) LEFT JOIN {p}_scores s ON s.a = q.norm AND s.b = n.norm),
 {p}_best AS (SELECT * FROM {p}_named QUALIFY row_number() OVER (PARTITION BY query_id, ror_id ORDER BY exact_match DESC, name_score DESC, best_kind, best_name) = 1),
 {p}_seen AS (SELECT b.*, q.lim, o.name AS ror_name, len({signal('q.norm', config.min_scoring_token_len)}) AS signal,
   {f"CASE WHEN q.country_n IS NULL OR nullif({sql.country('o.country_code')}, '') IS NULL THEN NULL ELSE q.country_n = {sql.country('o.country_code')} END" if config.use_country else "NULL::BOOLEAN"} AS country_match,
   {f"CASE WHEN q.city_n IS NULL OR nullif({sql.text('o.city')}, '') IS NULL THEN NULL ELSE q.city_n = {sql.text('o.city')} END" if config.use_city else "NULL::BOOLEAN"} AS city_match
  FROM {p}_best b JOIN queries q USING (query_id) JOIN orgs o ON o.ror_id = b.ror_id),
 {p}_moved AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, name_score + {step('country_match', config.use_country, config.country_boost, config.country_penalty)} + {step('city_match', config.use_city, config.city_boost, config.city_penalty)})) AS score FROM {p}_seen),
 {p}_ranked AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0.0) AS margin, count_if(exact_match AND coalesce(country_match, false)) OVER (PARTITION BY query_id) AS alone FROM {p}_moved WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, source_order)),
 {p}_decided AS (SELECT *, rank = 1 AND {guard} AND name_score >= {config.lexical_gate}::DOUBLE AND score >= {config.auto_match_threshold}::DOUBLE AND {clear} AND coalesce(country_match, true) AS match FROM {p}_ranked),
 {p}_limited AS (SELECT * FROM {p}_decided WHERE rank <= coalesce(nullif(lim, 0), {config.return_limit}))"""


#: Queries of the roles with their evidence and limits.
QUERIES = f"{sql.RAW}, queries AS (SELECT query_id, query, {sql.name('query')} AS norm, nullif({sql.country('country')}, '') AS country_n, nullif({sql.text('city')}, '') AS city_n, CAST(NULL AS INT) AS lim FROM raw_queries)"


LENGTH = f"len({sql.words('norm')})"


def retrieval(queries: str = QUERIES) -> str:
    """CTEs of names, queries and the three shortlists."""
    return f"{sql.NAMES}, {queries}, {sql.PHRASES}, {sql.POSTINGS}, {sql.HITS}, {sql.ranked('w', 'phrases', 'hits', LENGTH)}, {sql.GRAM_ONLY}, {sql.EXACT}"


def whole(config: MatchConfig = MatchConfig(), p: str = "m", queries: str = QUERIES) -> str:
    """All CTEs from the tables to <p>_limited."""
    return f"{retrieval(queries)}, {candidates(p, config)}, {decided(p, config)}"


def places(x: str, digits: int) -> str:
    """A number rounded by its exact binary value."""
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE) + 0.0"


#: Limits of their own for seven in eight queries.
LIMITED = QUERIES.replace("CAST(NULL AS INT) AS lim", "nullif(CAST(regexp_extract(query_id, '(\\d+)$', 1) AS INT) % 8, 7) AS lim")
PAIRS = f"{retrieval()}, {candidates('m', MatchConfig())}, m_pairs AS (SELECT DISTINCT q.norm AS a, n.norm AS b FROM m_cand JOIN queries q USING (query_id) JOIN names n USING (ror_id) WHERE q.norm <> n.norm)"
FEATURES = f"""SELECT m.query_id, CAST(m.rank - 1 AS BIGINT) AS place, m.ror_id AS id, m.ror_name AS name, 'organization=Organization' AS types, {places('m.score * 100', 3)} AS score, m.match,
  concat_ws('; ', 'name ' || format('{{:.2f}}', name_score) || ' via ' || best_kind, CASE WHEN country_match THEN 'country match' WHEN NOT country_match THEN 'country mismatch' END, CASE WHEN city_match THEN 'city match' WHEN NOT city_match THEN 'city mismatch' END, CASE WHEN margin <> 0 THEN 'margin ' || format('{{:.2f}}', margin) END) AS description,
  {places('name_score', 4)} AS name_fuzzy, {places('m.score', 4)} AS final_score, {places('margin', 4)} AS margin, exact_match AS exact_name, country_match, city_match FROM m_limited m"""


def outcome_rows(p: str) -> str:
    """CTE <p>_out: outcomes of the cases from <p>_limited and <p>_cand."""
    return f"""{p}_out AS (SELECT c.case_id, c.stratum, d.ror_id AS predicted_ror_id, expected_ror_id IS NOT NULL AS known, expected_ror_id IS NOT NULL AND EXISTS (SELECT 1 FROM {p}_cand x WHERE x.query_id = c.case_id AND x.ror_id = expected_ror_id) AS blocking_hit,
  expected_ror_id IS NOT NULL AND coalesce(d.ror_id = expected_ror_id, false) AS top1_hit, coalesce(d.match, false) AS answered, coalesce(d.match AND d.ror_id = expected_ror_id, false) AS correct_answered, expected_ror_id IS NULL AND NOT coalesce(d.match, false) AS correct_abstention
  FROM cases c LEFT JOIN {p}_limited d ON d.query_id = c.case_id AND d.rank = 1)"""


MATCHED = whole()
OUT = f"{MATCHED}, {sql.CASES}, {outcome_rows('m')}"
COUNTERS = "count(*) AS cases, count_if(known) AS known_matches, count_if(blocking_hit) AS blocking_hits, count_if(top1_hit) AS top1_correct_known, count_if(answered) AS answered, count_if(answered AND known) AS answered_known, count_if(correct_answered) AS correct_answers, count_if(correct_abstention) AS correct_abstentions"
SHARES = {
    "blocking_recall": ("blocking_hits", "known_matches"), "top1_accuracy_known": ("top1_correct_known", "known_matches"), "selective_precision": ("correct_answers", "answered"), "coverage": ("answered", "cases"),
    "answerable_coverage": ("answered_known", "known_matches"), "end_to_end_recall": ("correct_answers", "known_matches"), "no_match_specificity": ("correct_abstentions", "(cases - known_matches)"),
}
METRICS = ", ".join(f"{places(f'coalesce({a}::DOUBLE / nullif({b}, 0), 0.0)', 4)} AS {name}" for name, (a, b) in SHARES.items())
ERROR = "CASE WHEN correct_answered THEN 'correct_answer' WHEN correct_abstention THEN 'correct_abstention' WHEN answered THEN 'accepted_wrong' WHEN NOT blocking_hit THEN 'blocking_miss' WHEN NOT top1_hit THEN 'ranking_error' ELSE 'threshold_or_margin_abstention' END"
SPLIT = """grouped AS (SELECT *, expected_ror_id IS NOT NULL AS kn, sha256('42|' || case_id) AS d FROM cases),
 numbered AS (SELECT *, count(*) OVER (PARTITION BY stratum, kn) AS n, row_number() OVER (PARTITION BY stratum, kn ORDER BY d, case_id) AS i FROM grouped),
 halved AS (SELECT *, i <= CASE WHEN n = 1 THEN 0 ELSE greatest(1, least(n - 1, round_even(n * 0.5, 0))) END AS dev FROM numbered),
 lacking AS (SELECT round_even(count(*) * 0.5, 0) - count_if(dev) AS more FROM halved),
 turned AS (SELECT *, CASE WHEN dev THEN i > 1 ELSE n > 1 AND i < n END AS movable FROM halved),
 lined AS (SELECT *, row_number() OVER (PARTITION BY dev, movable ORDER BY d, case_id) AS turn FROM turned),
 parted AS (SELECT case_id, CASE WHEN (NOT dev AND movable AND turn <= more) OR (dev AND NOT (movable AND turn <= -more)) THEN 'dev' ELSE 'test' END AS part FROM lined, lacking)"""
HOSTED = """equals AS (SELECT DISTINCT query_id, ror_id FROM queries q JOIN names n ON n.norm = q.norm WHERE q.norm <> ''), two AS (SELECT query_id, list_slice(list(ror_id ORDER BY ror_id), 1, 2) AS found FROM equals GROUP BY query_id),
 hosted AS (SELECT c.case_id, c.stratum, expected_ror_id IS NOT NULL AS known, found IS NULL AND ends_with(c.case_id, '7') AS failed, coalesce(list_contains(found, expected_ror_id), false) AS blocking_hit, coalesce(found[1] = expected_ror_id, false) AS top1_hit, found IS NOT NULL AS answered,
  coalesce(found[1] = expected_ror_id, false) AS correct_answered, expected_ror_id IS NULL AND found IS NULL AND NOT ends_with(c.case_id, '7') AS correct_abstention FROM cases c LEFT JOIN two ON two.query_id = c.case_id)"""
KINDS = "count_if(kind = 'correct') AS correct, count_if(kind = 'wrong') AS wrong, count_if(kind = 'unresolved') AS unresolved, count_if(kind = 'error') AS error"


def binomial_bound(tail_of: str) -> str:
    """The chance at which a tail is 0.025, by halving 60 times. tail_of: the tail at x, greater than 0.025 where the chance is to be smaller."""
    step = f"CASE WHEN {tail_of} THEN {{'lo': acc.lo, 'hi': (acc.lo + acc.hi) / 2}} ELSE {{'lo': (acc.lo + acc.hi) / 2, 'hi': acc.hi}} END"
    start = "{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}"
    return f"(list_reduce(list_transform(range(0, 60), lambda i: {start}), lambda acc, z: {step}, {start})).hi"


def interval(s: str, n: str) -> str:
    """Clopper-Pearson bounds of columns as two expressions, by sums of the binomial's terms."""
    x = "((acc.lo + acc.hi) / 2)"
    at_most = lambda k: f"list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({x}) + ({n} - k) * ln(1 - {x}))))"
    low = f"CASE WHEN {s} = 0 THEN 0.0 WHEN {n} > 0 THEN {binomial_bound(f'1 - {at_most(f'{s} - 1')} > 0.025')} END"
    high = f"CASE WHEN {s} = {n} THEN 1.0 WHEN {n} > 0 THEN {binomial_bound(f'{at_most(s)} < 0.025')} END"
    return f"round({low}, 6) AS low, round({high}, 6) AS high"


def ablation() -> str:
    """All configurations of an ablation over one retrieval."""
    parts, rows = [], []
    for step, (stage, config) in enumerate(ablations().items()):
        p = f"s{step}"
        parts.append(f"{candidates(p, config)}, {decided(p, config)}, {outcome_rows(p)}")
        rows.append(f"SELECT {step} AS step, '{stage}' AS stage, *, {METRICS} FROM (SELECT {COUNTERS} FROM {p}_out)")
    return f"WITH {retrieval()}, {sql.CASES}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


FULL = MatchConfig()
SWEEP = f"""WITH {MATCHED}, {sql.CASES}, grid AS (SELECT gate, threshold FROM (VALUES (0.76::DOUBLE), (0.78), (0.80), (0.82)) g(gate), (VALUES (0.80::DOUBLE), (0.82), (0.84), (0.86), (0.88), (0.90), (0.92)) t(threshold)),
 firsts AS (SELECT * FROM m_ranked WHERE rank = 1),
 judged AS (SELECT gate, threshold, expected_ror_id, case_id, r.ror_id, coalesce((exact_match OR signal >= 2) AND name_score >= gate AND score >= threshold AND (margin >= {FULL.min_margin}::DOUBLE OR (exact_match AND coalesce(country_match, false) AND alone = 1)) AND coalesce(country_match, true), false) AS answered FROM cases CROSS JOIN grid LEFT JOIN firsts r ON r.query_id = case_id),
 flags AS (SELECT gate, threshold, expected_ror_id IS NOT NULL AS known, expected_ror_id IS NOT NULL AND EXISTS (SELECT 1 FROM m_cand x WHERE x.query_id = case_id AND x.ror_id = expected_ror_id) AS blocking_hit, coalesce(ror_id = expected_ror_id, false) AS top1_hit, answered, answered AND coalesce(ror_id = expected_ror_id, false) AS correct_answered, expected_ror_id IS NULL AND NOT answered AS correct_abstention FROM judged)
 SELECT *, {METRICS} FROM (SELECT gate, threshold, {COUNTERS} FROM flags GROUP BY gate, threshold)"""
BOOTSTRAP = f"""WITH {OUT}, classes AS (SELECT stratum, known, blocking_hit, top1_hit, answered, correct_answered, correct_abstention, count(*) AS n FROM m_out GROUP BY ALL),
 ends AS (SELECT *, CAST(sum(n) OVER (PARTITION BY stratum ORDER BY known, blocking_hit, top1_hit, answered, correct_answered, correct_abstention) AS BIGINT) AS e, CAST(sum(n) OVER (PARTITION BY stratum) AS BIGINT) AS whole FROM classes),
 strata AS (SELECT DISTINCT stratum, whole FROM ends), draws AS (SELECT stratum, whole, iteration, unnest(range(0, whole)) AS number FROM strata, range(2000) t(iteration)),
 drawn AS (SELECT stratum, iteration, CAST('0x' || substr(md5('42|' || iteration || '|' || stratum || '|' || number), 1, 13) AS BIGINT) % whole AS d FROM draws),
 hit AS (SELECT iteration, c.* FROM drawn JOIN ends c ON c.stratum = drawn.stratum AND d < e AND d >= e - n),
 each AS (SELECT iteration, {COUNTERS} FROM hit GROUP BY iteration), shares AS (SELECT {METRICS} FROM each)
 {' UNION ALL '.join(f"SELECT '{m}' AS metric, {places(f'quantile_cont({m}, 0.025)', 4)} AS low, {places(f'quantile_cont({m}, 0.975)', 4)} AS high FROM shares" for m in SHARES)}"""
JOINED = f"""WITH {MATCHED}, tops AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS returned FROM m_limited QUALIFY rank = 1)
 SELECT query_id AS "organisationID", r.query AS name, r.country, r.city, CAST(substr(query_id, 3) AS BIGINT) AS row_idx, CASE WHEN t.match THEN 'matched' WHEN t.ror_id IS NOT NULL THEN 'abstained' ELSE 'no_candidates' END AS match_status,
  CASE WHEN t.match THEN t.ror_id ELSE '' END AS ror_id, CASE WHEN t.match THEN ror_name ELSE '' END AS ror_name, coalesce(t.ror_id, '') AS candidate_ror_id, coalesce(ror_name, '') AS candidate_ror_name, {places('score', 6)} AS score, {places('name_score', 6)} AS name_score, {places('margin', 6)} AS margin,
  coalesce(best_name, '') AS best_name, coalesce(best_kind, '') AS best_name_kind, country_match, city_match, exact_match, coalesce(returned, 0) AS candidate_count FROM raw_queries r LEFT JOIN tops t USING (query_id)"""

ORACLES = {
    "f1_ratio": f"WITH {PAIRS}, {similarities('m', 'm_pairs', replace(FULL, use_coverage=False))} SELECT a, b, {', '.join(f'{places(k, 6)} AS {k}' for k in ('ratio', 'token_sort', 'token_set', 'weighted', 'raw'))} FROM m_scores",
    "f6_coverage": f"WITH {MATCHED} SELECT query_id, ror_id, best_name, best_kind, {places('name_score', 6)} AS name_score, exact_match FROM m_best",
    "f8_evidence": f"WITH {MATCHED} SELECT query_id, ror_id, country_match, city_match, {places('score', 6)} AS score FROM m_decided",
    "f12_decision": f"WITH {MATCHED} SELECT query_id, ror_id, rank, {places('margin', 6)} AS margin, match FROM m_decided",
    "f13_exact_decision": f"WITH {sql.DECIDED} SELECT query_id, ror_id, rank, {places('margin', 6)} AS margin, match FROM decided",
    "f14_limited": f"WITH {whole(queries=LIMITED)} SELECT query_id, ror_id, rank FROM m_limited",
    "f15_batch": f"WITH {whole(queries=LIMITED)} SELECT query_id, count(*) AS returned, count_if(match) AS matched FROM m_limited GROUP BY query_id",
    "f16_struct": f"WITH {MATCHED} {FEATURES}",
    "pipeline_reconcile": f"WITH {MATCHED} SELECT query_id, rank, ror_id, best_name, best_kind, {places('name_score', 6)} AS name_score, {places('score', 6)} AS score, {places('margin', 6)} AS margin, country_match, city_match, exact_match, match FROM m_limited",
    "g4_join_back": JOINED,
    "g5_evidence": f"""WITH {MATCHED}, listed AS (SELECT query_id, string_agg(ror_id || '=' || match, ',' ORDER BY rank) AS found, max(CASE WHEN rank = 1 THEN CASE WHEN match THEN 'matched' ELSE 'abstained' END END) AS state FROM m_limited GROUP BY query_id)
 SELECT 'cordis:' || query_id AS organization_identity, CAST(json_object('city', r.city, 'country', r.country, 'name', r.query, 'organisationID', query_id) AS VARCHAR) AS source, coalesce(state, 'no_candidates') AS match_status, found AS candidates FROM raw_queries r LEFT JOIN listed USING (query_id)""",
    "g6_run_counts": f"WITH {MATCHED} SELECT (SELECT count(*) FROM raw_queries) AS unique_organizations, count(DISTINCT query_id) AS matched_organizations, (SELECT count(*) FROM raw_queries) - count(DISTINCT query_id) AS abstained_organizations FROM m_limited WHERE match",
    "g11_split": f"WITH {sql.PARTS}, {sql.RAW}, {sql.CASES}, {SPLIT} SELECT * FROM parted",
    "h5_outcomes": f"WITH {OUT} SELECT case_id, predicted_ror_id, known, blocking_hit, top1_hit, answered, correct_answered, correct_abstention FROM m_out",
    "h6_metrics": f"WITH {OUT} SELECT *, {METRICS} FROM (SELECT stratum, {COUNTERS} FROM m_out GROUP BY GROUPING SETS ((), (stratum)))",
    "h8_errors": f"WITH {OUT} SELECT e.error, count(case_id) AS cases FROM (VALUES {', '.join(f'({e!r})' for e in sql.ERRORS)}) e(error) LEFT JOIN (SELECT case_id, {ERROR} AS error FROM m_out) USING (error) GROUP BY ALL",
    "h8_error_cases": f"WITH {OUT} SELECT {ERROR} AS error, case_id FROM m_out",
    "h9_held_out": f"""WITH {OUT}, {SPLIT}, {HOSTED}, of_both AS (SELECT 'local' AS system, case_id, known, CASE WHEN correct_answered OR correct_abstention THEN 'correct' WHEN answered THEN 'wrong' ELSE 'unresolved' END AS kind FROM m_out
  UNION ALL SELECT 'hosted', case_id, known, CASE WHEN failed THEN 'error' WHEN correct_answered OR correct_abstention THEN 'correct' WHEN answered THEN 'wrong' ELSE 'unresolved' END FROM hosted)
 SELECT system, known, {KINDS} FROM of_both JOIN parted USING (case_id) WHERE part = 'test' GROUP BY ALL""",
    "h10_bootstrap": BOOTSTRAP,
    "h12_ablation": ablation(),
    "h13_sweep": SWEEP,
    "h14_hosted": f"WITH {sql.NAMES}, {QUERIES}, {sql.CASES}, {HOSTED} SELECT *, {METRICS} FROM (SELECT stratum, {COUNTERS} FROM hosted GROUP BY GROUPING SETS ((), (stratum)))",
    "h15_intervals": f"WITH c AS (SELECT o_custkey, count_if(starts_with(o_orderpriority, '1')) AS successes, count(*) AS trials FROM orders GROUP BY ALL) SELECT *, {interval('successes', 'trials')} FROM c",
    "h16_report": f"""WITH {OUT}, sums AS (SELECT 'selective_precision' AS metric, count_if(correct_answered) AS successes, count_if(answered) AS trials FROM m_out UNION ALL SELECT 'no_match_specificity', count_if(correct_abstention), count_if(NOT known) FROM m_out)
 SELECT *, round(successes / nullif(trials, 0), 6) AS estimate, {interval('successes', 'trials')} FROM sums""",
    "e14_flags": "SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS even FROM lineitem",
    "e15_quoted": "SELECT p_partkey, url_encode('https://ror.org/é ' || p_name) AS quoted FROM part",
    "e16_rounding": f"SELECT o_orderkey, {places('o_totalprice / 10', 2)} AS tenth, {places('-o_totalprice / 1000', 4)} AS thousandth, {places('o_orderkey / 8', 2)} AS eighth FROM orders",
}


#: Requests of 50 queries each, with limits from the page's number; 0 counts as 1.
REQUESTED = QUERIES.replace("CAST(NULL AS INT) AS lim", "CASE CAST(regexp_extract(query_id, '(\\d+)$', 1) AS INT) % 8 WHEN 7 THEN NULL WHEN 0 THEN 1 ELSE CAST(regexp_extract(query_id, '(\\d+)$', 1) AS INT) % 8 END AS lim")
ORACLES |= {
    "i1_manifest": "SELECT * FROM (VALUES ('batchSize', '50'), ('defaultTypes', '[{\"id\":\"organization\",\"name\":\"Organization\"}]'), ('identifierSpace', '\"https://ror.org/\"'), ('name', '\"Local organisation reconciliation\"'), ('schemaSpace', '\"https://ror.org/\"'), ('suggest', '{\"property\":{\"service_path\":\"/suggest/property\",\"service_url\":\"http://local\"}}'), ('versions', '[\"0.2\"]'), ('view', '{\"url\":\"{{id}}\"}')) t(key, value)",
    "i2_respond": f"WITH {whole(queries=REQUESTED)}, f AS ({FEATURES}) SELECT CAST(substr(query_id, 3) AS BIGINT) // 50 AS request, 200 AS status, query_id, place, id, score, match, description FROM f",
    "i3_parse": f"WITH {sql.PARTS}, {REQUESTED} SELECT CAST(substr(r.query_id, 3) AS BIGINT) // 50 AS request, r.query_id, r.query, nullif(trim(country), '') AS country, nullif(trim(city), '') AS city, lim AS \"limit\", CAST(NULL AS VARCHAR) AS error FROM raw_queries r JOIN queries USING (query_id)",
    "i5_health": "SELECT true AS ok, count(*) AS organizations FROM pages",
}
