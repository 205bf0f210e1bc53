"""DuckDB SQL for the catalogue's queries."""

from turnlake.plans.proxies import EVENTS_SQL, TYPE_CODE_SQL, WORDS_SQL

WS = r"[ \t\n\r\f\x0b]"
_COLLAPSE = rf"trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')"

_CARVE = """
uses AS (SELECT DISTINCT l_orderkey AS example, l_partkey AS tool FROM lineitem),
freq AS (SELECT tool, count(*) AS f FROM uses GROUP BY tool),
scores AS (SELECT example, sum(f) AS score FROM uses JOIN freq USING (tool) GROUP BY example),
evals AS (SELECT example FROM scores ORDER BY score, example LIMIT 100),
heldout AS (SELECT DISTINCT tool FROM uses WHERE example IN (SELECT example FROM evals)),
pool AS (SELECT DISTINCT example FROM uses WHERE example NOT IN (SELECT example FROM uses WHERE tool IN (SELECT tool FROM heldout)))
"""

_CALLS = """
c AS (SELECT event_id, event_type, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
"""

_STARTS = """
tok AS (SELECT conv_id, turn, role, j, turn * 3 + j + 1 AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) - 1 AS pos
  FROM conversations, (SELECT unnest([0, 1, 2]) AS j)),
lab AS (SELECT *, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS loss,
    lag(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM tok),
starts AS (SELECT conv_id, pos AS start, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS turn_index
  FROM lab WHERE loss = 1 AND coalesce(before, 0) = 0)
"""

_CODES = f"""
codes AS (SELECT CAST(user_id AS VARCHAR) AS query_id, {TYPE_CODE_SQL} AS code,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
"""
_RUNS = _CODES + """,
marks AS (SELECT *, CASE WHEN lag(code) OVER w IS DISTINCT FROM code THEN 1 ELSE 0 END AS new FROM codes WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY pos) - 1 AS run FROM marks),
runs AS (SELECT query_id, CAST(run AS BIGINT) AS run, CAST(min(code) AS BIGINT) AS code, count(*) AS len FROM numbered GROUP BY query_id, run)
"""

_PER_PROMPT = "per AS (SELECT query_id, count(*) AS n_steps, CAST(sum(scored) AS BIGINT) AS n_scored, CAST(sum(accepted) AS BIGINT) AS n_accepted, CAST(sum(emitted) AS BIGINT) AS n_emitted FROM {src} GROUP BY query_id)"


def _boot(name: str, value: str, n_boot: int, per: str) -> str:
    """Draws by counts down a tree of ranges (needs WITH RECURSIVE), then within leaves of at most 128."""
    begin = lambda q, k: f"(({q}) * n + (1::BIGINT << ({k})) - 1) // (1::BIGINT << ({k}))"
    return f"""
{name}_v AS (SELECT CAST(round(coalesce({value}, 0.0::DOUBLE) * 1e6::DOUBLE) AS BIGINT) AS v, row_number() OVER (ORDER BY query_id) - 1 AS place FROM {per}),
{name}_n AS (SELECT n, (SELECT min(x) FROM (SELECT unnest(range(0, 40)) AS x) WHERE n <= 128 * (1::BIGINT << x)) AS d FROM (SELECT count(*) AS n FROM {name}_v)),
{name}_l AS (SELECT v, (place << d) // n AS leaf, row_number() OVER (PARTITION BY (place << d) // n ORDER BY place) - 1 AS slot FROM {name}_v, {name}_n),
{name}_t AS (SELECT b, 0::BIGINT AS k, 0::BIGINT AS q, n AS m FROM (SELECT unnest(range(0, {n_boot})) AS b), {name}_n
  UNION ALL SELECT b, k + 1, 2 * q + side, CASE side WHEN 0 THEN l ELSE m - l END FROM (SELECT *, least(m, greatest(0, CAST(floor(m * p + z * sqrt(m * p * (1 - p)) + 0.5::DOUBLE) AS BIGINT))) AS l FROM (
    SELECT b, k, q, m, CAST({begin("2 * q + 1", "k + 1")} - {begin("2 * q", "k + 1")} AS DOUBLE) / ({begin("q + 1", "k")} - {begin("q", "k")}) AS p,
      CAST(list_sum(list_transform(range(0, 8), lambda i: CAST('0x' || substr(md5('42:' || b || ':t' || (k + 1) || ':' || q), 1 + 4 * i, 4) AS BIGINT))) - 262140 AS DOUBLE) / 65536.0::DOUBLE * sqrt(1.5::DOUBLE) AS z
    FROM {name}_t, {name}_n WHERE k < d)), (SELECT unnest([0, 1]) AS side)),
{name}_d AS (SELECT b, leaf, CAST('0x' || substr(md5('42:' || b || ':d' || leaf || ':' || (i // 4)), 1 + 7 * (i % 4), 7) AS BIGINT) % size AS slot
  FROM (SELECT b, q AS leaf, unnest(range(0, m)) AS i FROM {name}_t, {name}_n WHERE k = d) JOIN (SELECT leaf, count(*) AS size FROM {name}_l GROUP BY leaf) USING (leaf)),
{name}_m AS (SELECT b, CAST(sum(v) AS DOUBLE) / count(*) / 1e6::DOUBLE AS m FROM {name}_d JOIN {name}_l USING (leaf, slot) GROUP BY b),
{name}_ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM {name}_m)"""


_REASON = """CASE WHEN k % 7 = 1 THEN 'unknown function name' WHEN k % 7 = 2 THEN 'keys outside schema for' WHEN k % 7 = 3 THEN 'missing required keys for'
  WHEN k % 7 = 4 THEN 'no tool call in generation' WHEN k % 7 = 5 THEN 'payload not JSON' END"""

_LOGITS = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 8, 3)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
pairs AS (SELECT a.vec_id, a.x[1:60] AS s, b.x[1:60] AS t FROM e a JOIN e b ON b.vec_id - 1 = a.vec_id),
long AS (SELECT vec_id, unnest(range(0, 60)) AS i, unnest(s) AS s, unnest(t) AS t FROM pairs),
norm AS (SELECT vec_id, max(s) AS ms, max(t) AS mt FROM long GROUP BY vec_id),
lse AS (SELECT vec_id, any_value(ms) + ln(sum(exp(s - ms))) AS zs, any_value(mt) + ln(sum(exp(t - mt))) AS zt FROM long JOIN norm USING (vec_id) GROUP BY vec_id),
lp AS (SELECT vec_id, i, s - zs AS s, t - zt AS t FROM long JOIN lse USING (vec_id))
"""

_METHODS = """
m AS (SELECT user_id % 3 AS batch, CASE WHEN event_type = 'view' THEN 'ar' ELSE event_type END AS method,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
r AS (SELECT batch, method, CAST(sum(k) AS DOUBLE) / count(*) AS tok_s FROM m GROUP BY batch, method),
sp AS (SELECT r.batch, r.method, r.tok_s, r.tok_s / ar.tok_s AS speedup FROM r LEFT JOIN (SELECT batch, tok_s FROM r WHERE method = 'ar') ar USING (batch) WHERE r.method <> 'ar')
"""

_PACK = rf"""
d AS (SELECT doc_id AS ord, CAST(len({WORDS_SQL}) AS BIGINT) AS n FROM documents),
f AS (SELECT ord, n, row_number() OVER (ORDER BY ord) AS i FROM d WHERE n <= {{cap}}),
p(i, ord, n, pack, used) AS (
  SELECT i, ord, n, 0::BIGINT, n FROM f WHERE i = 1
  UNION ALL
  SELECT f.i, f.ord, f.n, p.pack + CASE WHEN p.used + f.n > {{cap}} AND p.used > 0 THEN 1 ELSE 0 END,
    CASE WHEN p.used + f.n > {{cap}} AND p.used > 0 THEN f.n ELSE p.used + f.n END
  FROM p JOIN f ON f.i = p.i + 1)
"""

ORACLE = {
    "q01_conv_zip": "SELECT CAST(conv_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, length(text) AS n_chars FROM conversations",
    "q02_norm_query": rf"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace('Step ' || conv_id || ':  ' || text || ' ' || chr(10), '^{WS}*Step{WS}*[0-9]+{WS}*:{WS}*', ''), '{WS}+', ' ', 'g'), ' ') AS query FROM conversations""",
    "q03_schema_convert": """
SELECT p_partkey,
  CASE p_size % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'array' WHEN 3 THEN 'string' WHEN 4 THEN 'object' ELSE 'boolean' END AS json_type,
  CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' [type: int, optional, default=' || p_size || ']' WHEN 2 THEN p_name || ' [type: List[float]]'
    WHEN 3 THEN p_name || ' [type: str, optional, default ''' || p_name || ''']' WHEN 4 THEN p_name || ' [type: Dict]' ELSE p_name || ' [type: bool, optional]' END AS description,
  CASE p_size % 6 WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN p_name END AS default_value,
  p_size % 6 IN (0, 2, 4) AS required
FROM part""",
    "q04_conv_filter": """
WITH r AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 1 ELSE 0 END AS same FROM conversations)
SELECT conv_id, count(*) AS n_turns, CASE WHEN arg_min(role, turn) NOT IN ('system', 'user') THEN 'bad_first_role' WHEN arg_max(role, turn) <> 'assistant' THEN 'last_not_assistant'
  WHEN max(same) = 1 THEN 'repeated_role' ELSE 'kept' END AS reason FROM r GROUP BY conv_id""",
    "q05_dedupe_first": f"SELECT min(doc_id) AS doc_id, md5(arg_min(text, doc_id)) AS text_md5 FROM documents GROUP BY {_COLLAPSE}",
    "q05b_clean_stats": f"""
WITH f AS (SELECT {_COLLAPSE} AS q FROM documents WHERE n_chars >= 200), n AS (SELECT count(*) AS filtered, count(DISTINCT q) AS kept FROM f)
SELECT (SELECT count(*) FROM documents) AS raw, kept, (SELECT count(*) FROM documents) - filtered AS drop_filter, filtered - kept AS drop_duplicate FROM n""",
    "q06_rarity_carve": f"WITH {_CARVE} SELECT 'eval' AS part, example AS id FROM evals UNION ALL SELECT 'heldout', tool FROM heldout UNION ALL SELECT 'pool', example FROM pool",
    "q06b_tool_frequency": "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_examples FROM lineitem GROUP BY l_partkey",
    "q07_seeded_sample": "SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 100",
    "q07b_pool_minus": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 100)",
    "q08_token_regions": f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), t AS (SELECT doc_id, unnest(range(0, len(w))) AS pos FROM w)
SELECT doc_id, CAST(region AS INTEGER) AS region, count(*) AS n, min(pos) AS first, max(pos) AS last
FROM (SELECT *, CASE WHEN pos IN (9, 29, 30) THEN 3 WHEN pos BETWEEN 10 AND 28 THEN 2 ELSE 1 END AS region FROM t) GROUP BY doc_id, region""",
    "q09_turn_starts": f"WITH {_STARTS} SELECT conv_id, turn_index, start FROM starts",
    "q10_rle": f"WITH {_RUNS} SELECT query_id, run, code, len FROM runs",
    "q10b_unrle": f"WITH {_CODES} SELECT query_id, pos, CAST(code AS BIGINT) AS code FROM codes",
    "q11_length_stats": """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.25) AS p25,
  quantile_cont(n_chars, 0.95) AS p95, max(n_chars) AS longest FROM documents GROUP BY lang""",
    "q12_region_totals": f"WITH {_RUNS} SELECT code, CAST(sum(len) AS BIGINT) AS n_tokens, count(*) AS n_runs FROM runs GROUP BY code",
    "q13_boundary_contexts": f"""
WITH {_STARTS},
ctx AS (SELECT s.conv_id, s.turn_index, s.start, t.pos, t.id FROM starts s JOIN tok t ON t.conv_id = s.conv_id AND t.pos < s.start),
cut AS (SELECT *, start - 7 AS lo FROM ctx),
lo AS (SELECT conv_id, turn_index, start, CASE WHEN start <= 7 THEN 0 ELSE coalesce(min(CASE WHEN pos >= lo AND id = 4 THEN pos END), any_value(lo)) END AS first FROM cut GROUP BY conv_id, turn_index, start)
SELECT lo.conv_id || '#t' || lo.turn_index AS query_id, lo.start AS n, lo.start - lo.first AS n_clip, CAST(t.id AS BIGINT) AS first_kept
FROM lo JOIN tok t ON t.conv_id = lo.conv_id AND t.pos = lo.first""",
    "q14c_tag_counts": "SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n_open, (length(html) - length(replace(html, '</p>', ''))) // 4 AS n_close FROM pages",
    "q15_logprob_sort": """
WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS id, round(CAST(unnest(embedding) AS DOUBLE), 2) AS lp FROM embeddings WHERE embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, id) - 1 AS rank FROM x)
SELECT vec_id, rank, id, lp FROM r WHERE rank < 5""",
    "q15b_with_eos": f"""WITH {_CALLS} SELECT event_id, CAST(CASE WHEN k % 3 = 0 THEN 2 WHEN k % 2 = 0 AND k <> 2 THEN 2 ELSE 1 END AS BIGINT) AS n,
  CAST(CASE WHEN k % 3 = 0 THEN 2 WHEN k % 2 = 0 THEN 2 ELSE k END AS BIGINT) AS last FROM c""",
    "q16_join_report": """
WITH l AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
SELECT count(*) FILTER (WHERE l.n IS NOT NULL AND r.n IS NOT NULL) AS n_matched, count(*) FILTER (WHERE r.n IS NULL) AS n_left_only, count(*) FILTER (WHERE l.n IS NULL) AS n_right_only,
  count(*) FILTER (WHERE l.n > 1) AS n_left_dup, count(*) FILTER (WHERE r.n > 1) AS n_right_dup FROM l FULL OUTER JOIN r USING (doc_id)""",
    "q16b_join_one_to_one": "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)",
    "q17_validate_calls": f"""WITH {_CALLS} SELECT event_id, CAST(CASE WHEN k % 7 = 4 THEN 0 ELSE 1 END AS BIGINT) AS n_calls, k % 7 IN (0, 6) AS valid,
  CAST(CASE WHEN k % 7 IN (0, 6) THEN 0 ELSE 1 END AS BIGINT) AS n_problems, {_REASON} AS first_reason FROM c""",
    "q17b_validate_relaxed": f"WITH {_CALLS} SELECT event_id, k % 7 IN (0, 4, 6) AS valid FROM c",
    "q18_drop_reasons": f"WITH {_CALLS} SELECT {_REASON} AS reason, count(*) AS n FROM c WHERE k % 7 NOT IN (0, 6) GROUP BY 1",
    "q18b_assembly_stats": f"""WITH {_CALLS} SELECT count(*) AS n, count(*) FILTER (WHERE k % 7 IN (0, 6)) AS n_kept, count(*) FILTER (WHERE k % 7 NOT IN (0, 6)) AS n_dropped,
  round(CAST(count(*) FILTER (WHERE k % 7 NOT IN (0, 6)) AS DOUBLE) / count(*), 4) AS drop_rate FROM c""",
    "q19_kd_record": f"""
WITH {_CALLS}, g AS (SELECT event_id, k, unnest(range(0, k % 6 + 1)) AS i FROM c),
rg AS (SELECT event_id, k, i, CASE WHEN k % 2 = 0 AND i = 0 THEN 3 WHEN i IN (1, 2) THEN 2 ELSE 1 END AS r FROM g),
ch AS (SELECT *, CASE WHEN lag(r) OVER (PARTITION BY event_id ORDER BY i) IS DISTINCT FROM r THEN 1 ELSE 0 END AS new FROM rg)
SELECT CAST(event_id AS VARCHAR) AS query_id, any_value(k) % 4 + 1 + count(*) AS n_tokens, count(*) AS n_loss, CAST(sum(new) AS BIGINT) + 1 AS n_runs, CAST(arg_max(r, i) AS BIGINT) AS last_region FROM ch GROUP BY event_id""",
    "q20_event_stats": f"WITH {EVENTS_SQL} SELECT event_id, accepted, scored, CAST(bonus AS BIGINT) AS bonus, emitted FROM st",
    "q21_flat_metrics": f"""WITH {EVENTS_SQL} SELECT count(*) AS n_events, count(DISTINCT query_id) AS n_prompts, round(CAST(sum(accepted) AS DOUBLE) / CAST(sum(scored) AS DOUBLE), 6) AS alpha,
  round(CAST(sum(accepted) AS DOUBLE) / count(*), 6) AS tau, round(CAST(sum(bonus) AS DOUBLE) / count(*), 6) AS bonus_rate, CAST(sum(emitted) AS BIGINT) AS tokens_emitted FROM st""",
    "q21b_first_step_alpha": f"WITH {EVENTS_SQL} SELECT count(*) AS n_prompts, count(*) FILTER (WHERE accepted > 0) AS n_accepted, round(CAST(count(*) FILTER (WHERE accepted > 0) AS DOUBLE) / count(*), 6) AS alpha0 FROM st WHERE step = 0",
    "q22_alpha_by_position": f"""WITH {EVENTS_SQL}, att AS (SELECT accepted, unnest(range(0, n)) AS pos FROM st),
a AS (SELECT pos, count(*) FILTER (WHERE pos <= accepted) AS pos_scored, count(*) FILTER (WHERE pos < accepted) AS pos_accepted FROM att WHERE pos < 5 GROUP BY pos)
SELECT pos, pos_scored, pos_accepted, round(CAST(pos_accepted AS DOUBLE) / nullif(pos_scored, 0), 6) AS alpha_n FROM a""",
    "q23_phase_timing": f"""WITH {EVENTS_SQL}, v AS (SELECT value AS p, value * 0.5::DOUBLE + 1 AS q FROM st)
SELECT count(p) AS n_timed, round(avg(p), 4) AS propose_ms_mean, round(quantile_cont(p, 0.5), 4) AS propose_ms_median, round(avg(q), 4) AS verify_ms_mean, round(quantile_cont(q, 0.5), 4) AS verify_ms_median,
  round(sum(p) / (sum(p) + sum(q)), 4) AS draft_time_share FROM v""",
    "q24_region_metrics": f"""
WITH {EVENTS_SQL}, {_CODES},
cur AS (SELECT *, 3 + coalesce(sum(emitted) OVER (PARTITION BY query_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM st),
att AS (SELECT query_id, cursor, accepted, emitted, n, unnest(range(0, greatest(n, emitted))) AS i FROM cur),
rg AS (SELECT att.*, coalesce(codes.code, 1) AS region FROM att LEFT JOIN codes ON codes.query_id = att.query_id AND codes.pos = att.cursor + att.i)
SELECT CAST(region AS BIGINT) AS region, count(*) FILTER (WHERE i < n AND i <= accepted) AS n_verified, count(*) FILTER (WHERE i < accepted) AS n_accepted, count(*) FILTER (WHERE i < n) AS n_proposed,
  count(*) FILTER (WHERE i < emitted) AS n_emitted, round(CAST(count(*) FILTER (WHERE i < accepted) AS DOUBLE) / nullif(count(*) FILTER (WHERE i < n AND i <= accepted), 0), 6) AS alpha FROM rg GROUP BY region""",
    "q25_per_prompt": f"""WITH {EVENTS_SQL}, {_PER_PROMPT.format(src="st")} SELECT query_id, n_steps, n_scored, n_accepted, round(CAST(n_accepted AS DOUBLE) / n_scored, 6) AS alpha,
  round(CAST(n_accepted AS DOUBLE) / n_steps, 6) AS tau, n_emitted FROM per""",
    "q26_bootstrap_ci": f"""WITH RECURSIVE {EVENTS_SQL}, {_PER_PROMPT.format(src="st")}, {_boot("a", "CAST(n_accepted AS DOUBLE) / n_scored", 1000, "per")}, {_boot("t", "CAST(n_accepted AS DOUBLE) / n_steps", 1000, "per")}
SELECT 'alpha' AS stat, round((SELECT CAST(sum(v) AS DOUBLE) / count(*) / 1e6::DOUBLE FROM a_v), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (SELECT n FROM a_n) AS n_prompts FROM a_ci
UNION ALL SELECT 'tau', round((SELECT CAST(sum(v) AS DOUBLE) / count(*) / 1e6::DOUBLE FROM t_v), 6), round(lo, 6), round(hi, 6), (SELECT n FROM t_n) FROM t_ci""",
    "q27_name_args_cut": f"""
WITH {_CALLS}, t AS (SELECT event_id, '{{"name": "' || CASE WHEN k % 7 = 1 THEN 'nope' ELSE event_type END || '", "arguments": ' ||
  CASE WHEN k % 7 = 2 THEN '{{"city": "c' || k || '", "zoom": 1}}' WHEN k % 7 = 3 THEN '{{"unit": "m"}}' ELSE '{{"city": "c' || k || '", "unit": "m"}}' END || '}}' AS call FROM c),
p AS (SELECT event_id, length(call) AS n, strpos(call, '"arguments"') - 1 AS cut FROM t)
SELECT event_id AS span, cut // 4 AS n_name, (n + 3) // 4 - cut // 4 AS n_args FROM p""",
    "q28_ngram_lookup": f"""
WITH w AS (SELECT doc_id, list_transform({WORDS_SQL}, lambda x: lower(x)) AS s FROM documents),
t AS (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i, len(s) AS l, s[len(s)] AS e1, s[len(s) - 1] AS e2, s[len(s) - 2] AS e3 FROM w),
p AS (SELECT *, lag(x, 1) OVER o AS x1, lag(x, 2) OVER o AS x2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, coalesce(min(i) FILTER (WHERE x = e1 AND x1 = e2 AND x2 = e3 AND l >= 3), min(i) FILTER (WHERE x = e1 AND x1 = e2 AND l >= 2), min(i) FILTER (WHERE x = e1)) AS e FROM p WHERE i < l GROUP BY doc_id),
g AS (SELECT w.doc_id, CASE WHEN e IS NULL THEN ['<pad>'] ELSE s[e + 1 : e + 3] END AS p FROM w LEFT JOIN hit USING (doc_id))
SELECT doc_id, CAST(len(p) AS BIGINT) AS n, array_to_string(p, ' ') AS proposal FROM g""",
    "q29_integrity": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "q29b_set_checks": f"""
WITH {_CARVE}, pt AS (SELECT DISTINCT tool FROM uses WHERE example IN (SELECT example FROM pool))
SELECT 'eval and pool' AS "check", count(*) AS n, count(*) = 0 AS ok FROM evals WHERE example IN (SELECT example FROM pool)
UNION ALL SELECT 'held-out and pool tools', count(*), count(*) = 0 FROM heldout WHERE tool IN (SELECT tool FROM pt)
UNION ALL SELECT 'pool in all', count(*), count(*) = 0 FROM pool WHERE example NOT IN (SELECT example FROM uses)
UNION ALL SELECT 'eval size', count(*), count(*) = 100 FROM evals
UNION ALL SELECT 'held-out', count(*), count(*) > 0 FROM heldout""",
    "q30_mix_plan": "SELECT i AS slot, (i + 1) % 4 = 0 AS minor FROM (SELECT unnest(range(0, 64)) AS i)",
    "q30b_context_mix": """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'multi' ELSE 'single' END AS source FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) AS r FROM d)
SELECT doc_id, source FROM r WHERE source = 'single' OR r <= CAST(floor((SELECT count(*) FROM d) * 0.25) AS BIGINT)""",
    "q31_pack": f"WITH RECURSIVE {_PACK.format(cap=8192)} SELECT ord, n, pack, used - n AS \"offset\" FROM p",
    "q31b_pack_stats": f"""WITH RECURSIVE {_PACK.format(cap=1024)}, per AS (SELECT pack, sum(n) AS len, count(*) AS records FROM p GROUP BY pack)
SELECT count(*) AS n_packs, quantile_cont(len, 0.5) AS median_len, CAST(max(len) AS BIGINT) AS max_len, quantile_cont(records, 0.5) AS median_records, (SELECT count(*) FROM d WHERE n > 1024) AS n_skipped FROM per""",
    "q32_chunks": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS chunk, (row_number() OVER (ORDER BY doc_id) - 1) % 32 AS place FROM documents",
    "q33_first_divergence": f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), p AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM w a JOIN w b ON b.doc_id + 1 = a.doc_id),
x AS (SELECT doc_id, unnest(range(0, least(len(a), len(b)))) AS i, unnest(a[1:least(len(a), len(b))]) AS l, unnest(b[1:least(len(a), len(b))]) AS r FROM p),
f AS (SELECT doc_id, min(i) FILTER (WHERE l <> r) AS i FROM x GROUP BY doc_id)
SELECT CAST(p.doc_id AS VARCHAR) AS query_id, coalesce(f.i, CASE WHEN len(a) <> len(b) THEN least(len(a), len(b)) END) AS first_divergence, CAST(len(a) AS BIGINT) AS len_baseline, CAST(len(b) AS BIGINT) AS len_spec
FROM p LEFT JOIN f USING (doc_id)""",
    "q33b_exactness_summary": f"""WITH w AS (SELECT doc_id % 10 = 0 AND len({WORDS_SQL}) > 5 AS bad FROM documents)
SELECT count(*) AS n_prompts, count(*) FILTER (WHERE NOT bad) AS n_exact, count(*) FILTER (WHERE bad) AS n_mismatch, count(*) FILTER (WHERE bad) = 0 AS all_exact FROM w""",
    "q34_run_medians": """
WITH e AS (SELECT event_type, value + 1 AS w, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS g FROM events)
SELECT event_type, count(*) AS runs, round(quantile_cont(w, 0.5), 6) AS median_wall_s, round(quantile_cont(g / w, 0.5), 6) AS median_gen_tok_s, round(quantile_cont((g + 12) / w, 0.5), 6) AS median_total_tok_s FROM e GROUP BY event_type""",
    "q35_latest_per_key": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE r = 1""",
    "q36_pick_best": f"WITH {_METHODS} SELECT batch, method, round(speedup, 6) AS speedup FROM sp WHERE batch = 0 ORDER BY sp.speedup DESC, method LIMIT 1",
    "q36b_speedup_estimate": f"WITH {EVENTS_SQL}, {_PER_PROMPT.format(src='st')} SELECT query_id, round((CAST(n_accepted AS DOUBLE) / n_steps + 1) / 1.5::DOUBLE, 6) AS speedup FROM per",
    "q36c_speedups": f"WITH {_METHODS} SELECT batch, method, round(tok_s, 6) AS tok_s, round(speedup, 6) AS speedup FROM sp",
    "q37_jsonl_repair": "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "q38_config_grid": """
SELECT m AS method, CAST(k AS BIGINT) AS k, CAST(t AS DOUBLE) AS temperature,
  CASE m WHEN 'ngram' THEN '{"method":"ngram","num_speculative_tokens":' || k || ',"prompt_lookup_min":2,"prompt_lookup_max":4}'
    WHEN 'draft_model' THEN '{"method":"draft_model","model":"m/x","num_speculative_tokens":' || k || '}' END AS config
FROM (SELECT unnest(['ar', 'ngram', 'draft_model']) AS m), (SELECT unnest([3, 5, 7]) AS k), (SELECT unnest([0.0, 0.7]) AS t)""",
    "q39_topk_kl": f"""
WITH {_LOGITS}, top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, i) AS r FROM lp),
k AS (SELECT vec_id, ln(sum(exp(t))) AS z FROM top WHERE r <= 20 GROUP BY vec_id),
kl AS (SELECT vec_id, sum(exp(t - z) * (t - z - s)) AS kl FROM top JOIN k USING (vec_id) WHERE r <= 20 GROUP BY vec_id)
SELECT vec_id, round(0.9::DOUBLE * kl + 0.1::DOUBLE * -s, 6) AS loss FROM kl JOIN lp USING (vec_id) WHERE lp.i = vec_id % 60""",
    "q40_divergences": f"""
WITH {_LOGITS}, x AS (SELECT *, ln(0.5::DOUBLE * (exp(s) + exp(t))) AS m FROM lp),
d AS (SELECT vec_id, sum(exp(s) * (s - t)) AS rk, sum(exp(t) * (t - s)) AS fk, sum(0.5::DOUBLE * (exp(s) * (s - m) + exp(t) * (t - m))) AS js FROM x GROUP BY vec_id),
b AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, i) AS r FROM lp)
SELECT vec_id, round(0.9::DOUBLE * rk - 0.1::DOUBLE * s, 6) AS reverse_kl, round(0.9::DOUBLE * fk - 0.1::DOUBLE * s, 6) AS forward_kl, round(0.9::DOUBLE * js - 0.1::DOUBLE * s, 6) AS jsd FROM d JOIN b USING (vec_id) WHERE r = 1""",
    "q41_verify_round": f"""
WITH {_CALLS}, a AS (SELECT event_id, k, k % 4 + 1 AS n, 1 + user_id % 6 AS budget, CASE WHEN k % 3 = 0 THEN k ELSE k + 5 * (user_id % 2) + event_id % 2 END AS k2, event_id % 5 AS bonus FROM c),
p AS (SELECT *, unnest(range(1, n + 1)) AS i FROM a),
f AS (SELECT event_id, any_value(k) AS k, any_value(k2) AS k2, any_value(n) AS n, any_value(budget) AS budget, any_value(bonus) AS bonus, min(i) FILTER (WHERE (k * i) % 5 <> (k2 * i) % 5) AS miss FROM p GROUP BY event_id)
SELECT event_id, coalesce(miss, n) AS n, coalesce(miss - 1, n) AS n_accepted,
  CASE WHEN miss IS NOT NULL THEN (k2 * miss) % 5 WHEN (k * n) % 5 = 4 THEN NULL WHEN budget > n THEN bonus END AS correction,
  CASE WHEN miss IS NOT NULL THEN 'reject' WHEN (k * n) % 5 = 4 THEN 'full_eos' WHEN budget > n AND bonus = 4 THEN 'full_eos' WHEN budget > n THEN 'full_bonus' ELSE 'budget' END AS step_type,
  CASE WHEN miss IS NOT NULL THEN (k2 * miss) % 5 = 4 WHEN (k * n) % 5 = 4 THEN true WHEN budget > n THEN bonus = 4 ELSE true END AS eos FROM f""",
    "q43_contamination": f"""
WITH a AS (SELECT item_id AS id, string_split(lower({_COLLAPSE}), ' ') AS w FROM benchmark), b AS (SELECT doc_id AS id, string_split(lower({_COLLAPSE}), ' ') AS w FROM documents),
ga AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5)),
gb AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5))
SELECT ga.id AS item_id, count(DISTINCT gb.id) AS n_docs, count(DISTINCT ga.g) AS n_grams FROM ga JOIN gb ON ga.g = gb.g GROUP BY ga.id""",
    "q43b_same_queries": f"SELECT count(*) AS n_shared FROM (SELECT DISTINCT {_COLLAPSE} AS q FROM documents WHERE doc_id % 2 = 0) a WHERE q IN (SELECT {_COLLAPSE} FROM documents WHERE doc_id % 2 = 1)",
    "q44_gold_classes": f"""WITH {_CALLS} SELECT CASE WHEN k % 7 = 4 THEN 'no_call' WHEN k % 7 = 1 THEN 'wrong_function' WHEN k % 7 IN (2, 3) THEN 'other_args' ELSE 'exact' END AS class, count(*) AS n FROM c GROUP BY 1""",
    "q45_opener_distribution": f"""
WITH f AS (SELECT lang, ({WORDS_SQL})[1] AS first FROM documents), c AS (SELECT lang, first, count(*) AS n FROM f GROUP BY lang, first)
SELECT lang, first, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 6) AS share FROM c""",
}
_REGIONS = ORACLE["q24_region_metrics"]
_TOKEN = r"'<\|im_(?:start|end)\|>|[ \n]|[^ \n<]+|<'"
ORACLE |= {
    "q47_render": "WITH r AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, md5(t) AS text_md5, length(t) AS n_chars FROM r",
    "q48_records": f"""
WITH p AS (SELECT conv_id, turn, role, len(regexp_extract_all('<|im_start|>' || role || chr(10), {_TOKEN})) AS h, len(regexp_extract_all(text || '<|im_end|>', {_TOKEN})) AS b FROM conversations),
c AS (SELECT *, sum(h + b + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - b - 1 AS slot FROM p)
SELECT conv_id, CAST(sum(h + b + 1) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN b ELSE 0 END) AS BIGINT) AS n_loss,
  CAST(coalesce(min(CASE WHEN role = 'assistant' THEN slot END), sum(h + b + 1)) AS BIGINT) AS n_prompt_tokens FROM c GROUP BY conv_id""",
    "q49_assistant_spans": """
WITH c AS (SELECT conv_id, turn, role, length(text) + 10 AS b, 12 + length(role) + 1 AS h,
  coalesce(sum(12 + length(role) + 1 + length(text) + 11) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CAST(before + h AS BIGINT) AS s, CAST(before + h + b AS BIGINT) AS e FROM c WHERE role = 'assistant'""",
    "q50_region_extremes": f"SELECT round(min(alpha), 6) AS lowest, round(max(alpha), 6) AS highest, round(CAST(sum(CASE WHEN region = 0 THEN n_verified ELSE 0 END) AS DOUBLE) / CAST(sum(n_verified) AS DOUBLE), 6) AS context_share FROM ({_REGIONS})",
    "q51_positions_improved": f"""WITH {EVENTS_SQL}, att AS (SELECT user_id % 2 AS odd, accepted, unnest(range(0, n)) AS pos FROM st),
a AS (SELECT odd, pos, CAST(count(*) FILTER (WHERE pos < accepted) AS DOUBLE) / nullif(count(*) FILTER (WHERE pos <= accepted), 0) AS alpha FROM att GROUP BY odd, pos)
SELECT count(*) AS n_positions, count(*) FILTER (WHERE x.alpha >= y.alpha) AS n_improved FROM (SELECT * FROM a WHERE odd = 0) x JOIN (SELECT * FROM a WHERE odd = 1) y USING (pos)""",
    "q52_worst_gate": "SELECT event_type, count(*) FILTER (WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 2 = 0) AS n_exact FROM events GROUP BY event_type ORDER BY n_exact, event_type LIMIT 1",
    "q53_teacher_width": "SELECT CAST(greatest(1, max(least(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 25, 20))) AS BIGINT) AS width FROM events",
    "q54_cyclic_contexts": "WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT o_orderkey, n_name FROM orders JOIN n ON n.i = o_orderkey % (SELECT count(*) FROM nation)",
}
ORACLE |= {
    "q55_messages": f"""
WITH {_CALLS}, a AS (SELECT *, CASE WHEN k % 7 = 1 THEN 'nope' ELSE event_type END AS name, CASE WHEN k % 7 = 2 THEN '"city":"c' || k || '","zoom":1' WHEN k % 7 = 3 THEN '"unit":"m"' ELSE '"city":"c' || k || '","unit":"m"' END AS args FROM c),
n AS (SELECT *, length('{{"name": "' || name || '", "arguments": {{' || args || '}}}}') + CASE WHEN k % 7 = 3 THEN 1 ELSE 3 END AS l FROM a)
SELECT CAST(event_id AS VARCHAR) AS query_id, 1 + k % 2 AS n_answers, name AS first_name, '{{' || args || '}}' AS first_arguments, '3' AS default_n,
  CASE WHEN k % 7 = 4 THEN 15 WHEN k % 7 = 5 THEN 20 WHEN k % 7 = 6 THEN 2 * l + 24 ELSE l + 16 END AS n_query FROM n""",
    "q55b_typed_messages": f"""
WITH {_CALLS} SELECT CAST(event_id AS VARCHAR) AS query_id,
  CASE k % 3 WHEN 0 THEN '{{"z":' || k || ',"a":2.0,"n":null}}' WHEN 1 THEN '{{"a":"' || k || '","z":[1.5,true]}}' ELSE '{{"z":' || k || ',"a":NaN}}' END AS arguments,
  CASE k % 2 WHEN 0 THEN '3' ELSE '"3"' END AS default_n, '2.5' AS default_m FROM c""",
    "q60_converted": f"""
WITH {_CALLS}, r AS (SELECT *, CASE k % 8 WHEN 2 THEN 'unparseable_turn' WHEN 3 THEN 'unknown_action' WHEN 4 THEN 'early_finish' WHEN 5 THEN 'gave_up' WHEN 6 THEN 'blank_answer' ELSE 'kept' END AS reason FROM c)
SELECT 'Step 1: event ' || event_id AS id, reason, CASE WHEN reason = 'kept' THEN CASE k % 8 WHEN 0 THEN '{{"z":' || k || ',"a":1,"b":[1],"c":null}}' WHEN 1 THEN '{{"z":2,"a":"' || k || '"}}' ELSE '{{}}' END END AS arguments,
  CASE WHEN reason = 'kept' THEN 'ask' END AS first, CASE WHEN reason = 'kept' THEN event_type END AS answers_to, CASE WHEN reason = 'kept' THEN 'done' || chr(10) || chr(10) || 'is ' || k END AS final,
  CASE WHEN reason = 'kept' THEN '{{"type":"function","function":{{"name":"' || event_type || '","description":"","parameters":{{"type":"object","properties":{{"z":{{"type":"integer","enum":[1,2.0]}}}},"required":["z"]}}}}}}' END AS tool,
  CASE WHEN reason = 'kept' THEN 2 END AS n_tools, CASE WHEN reason = 'kept' THEN 'event ' || event_id END AS query FROM r""",
    "q56_dataset_stats": f"""WITH {_CODES}, u AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE code IN (2, 3)) AS t FROM codes GROUP BY query_id)
SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens_total, quantile_cont(n, 0.5) AS n_tokens_median, quantile_cont(n, 0.95) AS n_tokens_p95, max(n) AS n_tokens_max, round(100.0::DOUBLE * CAST(sum(t) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 1) AS pct_tool_call FROM u""",
    "q57_carve_stats": f"""WITH {_CARVE} SELECT (SELECT count(DISTINCT example) FROM uses) AS n_examples, (SELECT count(*) FROM evals) AS eval_size, (SELECT count(*) FROM heldout) AS heldout_tools, (SELECT count(*) FROM pool) AS pool,
  round(100.0::DOUBLE * (SELECT count(*) FROM pool) / (SELECT count(DISTINCT example) FROM uses), 1) AS pool_pct""",
    "q58_gather": "WITH i AS (SELECT doc_id AS raw_idx, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents WHERE n_chars >= 500) SELECT ord, raw_idx, n_chars FROM i WHERE ord % 3 = 0",
    "q59_run_totals": f"SELECT count(*) AS n_prompts, CAST(sum(coalesce(len({WORDS_SQL}), 0)) AS BIGINT) AS n_tokens, 1.5::DOUBLE AS wall_s FROM documents",
    "q61_teacher_packs": rf"""WITH RECURSIVE d AS (SELECT doc_id AS ord, doc_id % 3 + 1 AS p, coalesce({WORDS_SQL}, []) AS w FROM documents),
f AS (SELECT *, p + len(w) AS n, row_number() OVER (ORDER BY ord) AS i FROM d WHERE p + len(w) <= 8192),
k(i, pack, used) AS (
  SELECT i, 0::BIGINT, n FROM f WHERE i = 1
  UNION ALL SELECT f.i, k.pack + CASE WHEN k.used + f.n > 8192 THEN 1 ELSE 0 END, CASE WHEN k.used + f.n > 8192 THEN f.n ELSE k.used + f.n END FROM k JOIN f ON f.i = k.i + 1),
r AS (SELECT pack, used - n AS base, p, n, w FROM k JOIN f USING (i)),
t AS (SELECT pack, base + p + i - 1 AS place, length(w[i]) AS x, least(2, (length(w[i]) + i - 1) % 4) AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM r)),
h AS (SELECT pack, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS positions FROM r GROUP BY pack),
g AS (SELECT pack, count(*) AS n_labels, sum(x) AS labels, sum(place - 1) AS keep, count(*) FILTER (WHERE c > 0) AS n_valid, sum(c * x + c * (c - 1) // 2) AS teacher_ids, -sum(c * (c + 1) // 2) AS teacher_lps FROM t GROUP BY pack)
SELECT pack, n_records, n_tokens, positions, coalesce(n_labels, 0) AS n_labels, CAST(coalesce(labels, 0) AS BIGINT) AS labels, CAST(coalesce(keep, 0) AS BIGINT) AS keep, coalesce(n_valid, 0) AS n_valid,
  CAST(coalesce(teacher_ids, 0) AS BIGINT) AS teacher_ids, CAST(coalesce(teacher_lps, 0) AS BIGINT) AS teacher_lps, 2 * coalesce(n_labels, 0) AS n_cells FROM h LEFT JOIN g USING (pack)""",
    "q62_keep_exact": rf"""WITH m AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, text, regexp_extract_all(text, {_TOKEN}) AS toks, CASE WHEN conv_id % 2 = 0 THEN regexp_extract_all(text, {_TOKEN}) ELSE regexp_extract_all(text, '(?s).{{1,4}}') END AS pieces FROM m),
e AS (SELECT conv_id, text, pieces, unnest(pieces) AS x, unnest(range(0, len(pieces))) AS i FROM t WHERE pieces = toks AND length(text) % 5 <> 0),
c AS (SELECT conv_id, length(text) AS n_chars, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e)
SELECT conv_id, count(*) AS n_pieces, CAST(sum(s) AS BIGINT) AS starts, CAST(any_value(n_chars) AS BIGINT) AS n_chars FROM c GROUP BY conv_id""",
}
ORACLE["q04b_funnel"] = f"SELECT reason, count(*) AS n FROM ({ORACLE['q04_conv_filter']}) GROUP BY reason"


def _spans() -> None:
    pairs = r"""
o AS (SELECT page_id, '{open}' AS o, '{close}' AS c, html FROM pages),
parts AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)(.*?){open}(.*?){close}', 1)) AS gap, unnest(regexp_extract_all(html, '(?s)(.*?){open}(.*?){close}', 2)) AS load,
    unnest(range(0, len(regexp_extract_all(html, '(?s)(.*?){open}(.*?){close}', 1)))) AS j FROM pages),
cum AS (SELECT *, sum(length(gap) + length(load) + {a} + {b}) OVER (PARTITION BY page_id ORDER BY j) AS until FROM parts),
sp AS (SELECT page_id, j, CAST(until - {b} - length(load) AS BIGINT) AS s, CAST(until - {b} AS BIGINT) AS e FROM cum WHERE length(load) > 0)"""
    p = pairs.format(open="<p>", close="</p>", a=3, b=4)
    ORACLE["q14_payload_spans"] = f"WITH {p} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY j) - 1 AS i, s, e FROM sp"
    art = pairs.format(open="<article>", close="</article>", a=9, b=10)
    for name in ("o", "parts", "cum", "sp"):
        art = art.replace(f"\n{name} AS", f"\na{name} AS").replace(f"FROM {name} ", f"FROM a{name} ").replace(f"FROM {name})", f"FROM a{name})")
    ORACLE["q14b_outermost_spans"] = f"""WITH {p}, {art}, every AS (SELECT page_id, s, e FROM sp UNION ALL SELECT page_id, s, e FROM asp)
SELECT x.page_id, count(*) AS n_spans, CAST(sum(x.e - x.s) AS BIGINT) AS n_chars FROM every x
WHERE NOT EXISTS (SELECT 1 FROM every y WHERE y.page_id = x.page_id AND y.s <= x.s AND x.e <= y.e AND (y.s <> x.s OR y.e <> x.e)) GROUP BY x.page_id"""


_spans()


def _overlap() -> None:
    types = ("click", "error", "purchase", "signup", "view")
    ctes = [EVENTS_SQL]
    for t in types:
        ctes.append(_PER_PROMPT.format(src=f"(SELECT * FROM st WHERE event_type = '{t}')").replace("per AS", f"per_{t} AS"))
        ctes.append(_boot(t, "CAST(n_accepted AS DOUBLE) / n_steps", 1000, f"per_{t}"))
    union = " UNION ALL ".join(f"SELECT '{t}' AS run, lo, hi FROM {t}_ci" for t in types)
    ORACLE["q46_ci_overlap"] = f"WITH RECURSIVE {', '.join(ctes)}, ci AS ({union}) SELECT a.run AS run_a, b.run AS run_b, greatest(a.lo, b.lo) > least(a.hi, b.hi) AS apart FROM ci a JOIN ci b ON a.run < b.run"


_overlap()
