"""The queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

_PAIRS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 5 THEN 'fraud' ELSE 'legit' END AS label FROM embeddings),
near AS (SELECT a.vec_id AS idx, b.vec_id AS ref_id, b.label, {d} AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, ref_id) AS rank FROM near QUALIFY rank <= {k})"""
_L2 = "list_distance(a.v, b.v)"


def _top(d: str = _L2, k: int = 5) -> str:
    return _PAIRS.format(d=d, k=k)


_DECIDED = f"""{_top()},
decided AS (SELECT idx, count(*) FILTER (label = 'fraud') AS votes, round(count(*) FILTER (label = 'fraud') / 5.0::DOUBLE * 10000) / 10000 AS fraud_score,
  round(count(*) FILTER (label = 'fraud') / 5.0::DOUBLE * 10000) / 10000 < 0.6::DOUBLE AS approved FROM top GROUP BY idx)"""
_ROWS = "SELECT idx, CAST(rank AS INT) AS rank, ref_id, label, round(d, 6) AS d FROM top"

def _p99_score(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > 2000 THEN -3000.0 ELSE 1000 * log10(1000.0 / greatest({x}, 1)) END"


def _detection(rate: str, epsilon: str, errors: str) -> str:
    return f"CASE WHEN {rate} > 0.15 THEN -3000.0 ELSE 1000 * log10(1.0::DOUBLE / greatest({epsilon}, 0.001::DOUBLE)) - 300 * log10(1.0::DOUBLE + {errors}) END"


def _clamp(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN {x} WHEN {x} < 0 THEN 0.0 WHEN {x} > 1 THEN 1.0 ELSE {x} END"


def _round(x: str, places: int = 4) -> str:
    return f"round(({x}) * 1e{places}::DOUBLE) / 1e{places}::DOUBLE"


_HISTORY = """e AS (SELECT *, json_extract_string(props, '$.k') AS merchant FROM events),
h AS (SELECT *, lag(ts) OVER line AS last_ts, count(*) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_n,
    coalesce(sum(value) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_sum,
    count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tx_count_24h,
    row_number() OVER (PARTITION BY user_id, merchant ORDER BY ts, event_id) = 1 AS unknown,
    avg(value) OVER (PARTITION BY merchant) AS merchant_avg
  FROM e WINDOW line AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, CASE WHEN prior_n > 0 THEN prior_sum / prior_n ELSE 0.0 END AS average,
    CASE WHEN last_ts IS NULL THEN NULL ELSE (floor(epoch(ts)) - floor(epoch(last_ts))) / 60.0 END AS minutes FROM h)"""
_RATIO = "CASE WHEN average = 0 AND value = 0 THEN 'nan'::DOUBLE WHEN average = 0 THEN 'inf'::DOUBLE ELSE value / average END"
_RISK = "CASE event_type WHEN 'purchase' THEN 0.85 WHEN 'signup' THEN 0.45 WHEN 'error' THEN 0.75 WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.2 ELSE 0.5 END::DOUBLE"
_ONLINE = "event_type IN ('click', 'view', 'signup')"
_EXACT = (
    _clamp("(value * 20 / 10000::DOUBLE)"),
    _clamp("((event_id % 13 + 1) / 12::DOUBLE)"),
    _clamp(f"(({_RATIO}) / 10::DOUBLE)"),
    "hour(ts) / 23::DOUBLE",
    "(isodow(ts) - 1) / 6::DOUBLE",
    f"CASE WHEN last_ts IS NULL THEN -1.0 ELSE {_clamp('(minutes / 1440::DOUBLE)')} END",
    f"CASE WHEN last_ts IS NULL THEN -1.0 ELSE {_clamp('(coalesce(merchant::DOUBLE, 0) * 7 / 1000::DOUBLE)')} END",
    _clamp("((event_id * 37 % 1000) / 1000::DOUBLE)"),
    _clamp("(tx_count_24h / 20::DOUBLE)"),
    f"({_ONLINE})::INT::DOUBLE",
    f"(NOT ({_ONLINE}) AND event_id % 10 < 9)::INT::DOUBLE",
    "unknown::INT::DOUBLE",
    _RISK,
    _clamp("(merchant_avg * 20 / 10000::DOUBLE)"),
)
_VECTOR = f"{_HISTORY}, vec AS (SELECT event_id, {', '.join(f'{_round(x)} AS d{i}' for i, x in enumerate(_EXACT))} FROM t)"
_EVENT_TOP = f"""{_VECTOR}, e2 AS (SELECT event_id, [{', '.join(f'd{i}' for i in range(14))}] AS v, CASE WHEN d12 >= 0.75 THEN 'fraud' ELSE 'legit' END AS label FROM vec),
      near AS (SELECT a.event_id AS idx, b.event_id AS ref_id, b.label, {' + '.join(f'(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])' for i in range(1, 15))} AS d FROM e2 a JOIN e2 b ON a.event_id <> b.event_id WHERE a.event_id % 20 = 0),
      top AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, ref_id) AS rank FROM near QUALIFY rank <= 5)"""
_EVENT_DECIDED = f"""{_EVENT_TOP},
decided AS (SELECT idx, count(*) FILTER (label = 'fraud') AS votes, round(count(*) FILTER (label = 'fraud') / 5.0::DOUBLE * 10000) / 10000 AS fraud_score,
  round(count(*) FILTER (label = 'fraud') / 5.0::DOUBLE * 10000) / 10000 < 0.6::DOUBLE AS approved FROM top GROUP BY idx)"""
_JUDGED = f"""{_EVENT_DECIDED},
answers AS (SELECT idx, CASE WHEN idx // 20 % 41 <> 0 THEN approved END AS approved, CASE WHEN idx // 20 % 31 = 0 THEN 503 ELSE 200 END AS status, CAST(idx // 20 * 37 % 2100 AS DOUBLE) AS ms FROM decided WHERE idx // 20 % 50 <> 7),
judged AS (SELECT x.event_id AS idx, CASE
    WHEN r.idx IS NULL OR r.ms > 2001 OR r.status <> 200 THEN 'err'
    WHEN x.label = 'legit' AND coalesce(r.approved, false) THEN 'tn'
    WHEN x.label = 'fraud' AND r.approved = false THEN 'tp'
    WHEN coalesce(r.approved, false) THEN 'fn' ELSE 'fp' END AS class
  FROM e2 x LEFT JOIN answers r ON x.event_id = r.idx WHERE x.event_id % 20 = 0),
counts AS (SELECT {", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ("tp", "tn", "fp", "fn", "err"))} FROM judged),
errs AS (SELECT *, tp + tn + fp + fn + err AS n, fp + 3 * fn + 5 * err AS weighted_errors, fp + fn + err AS failures, (fp + 3 * fn + 5 * err)::DOUBLE / (tp + tn + fp + fn + err) AS epsilon, (fp + fn + err)::DOUBLE / (tp + tn + fp + fn + err) AS failure_rate FROM counts)"""


_KINDS = "CASE json_type(props, '{0}') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE CASE WHEN json_type(props, '{0}') IS NULL THEN 'invalid' ELSE 'number' END END"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def _cut(x: str, places: int) -> str:
    return _trim(f"printf('%.{places}f', trunc({x} * 1e{places}::DOUBLE) / 1e{places}::DOUBLE)")


_MS = "(l_extendedprice * l_quantity / 7)"
_SECONDS = f"CASE WHEN {_MS} > 60000 THEN {_cut(f'(({_MS} % 60000) / 1000)', 0)} ELSE {_cut(f'(({_MS} % 60000) / 1000)', 2)} END || 's'"
_MINUTES = f"CAST(floor({_MS} / 60000) AS BIGINT)"
_DURATION = f"""CASE WHEN {_MS} = 0 THEN '0s' WHEN {_MS} < 0.001 THEN CAST(CAST(floor({_MS} * 1e6) AS BIGINT) AS VARCHAR) || 'ns' WHEN {_MS} < 1 THEN {_cut(f'({_MS} * 1000)', 2)} || 'µs'
  WHEN {_MS} < 1000 THEN {_cut(_MS, 2)} || 'ms' WHEN {_MINUTES} < 1 THEN {_SECONDS} WHEN {_MINUTES} < 60 THEN CAST({_MINUTES} % 60 AS VARCHAR) || 'm' || {_SECONDS}
  ELSE CAST({_MINUTES} // 60 AS VARCHAR) || 'h' || CAST({_MINUTES} % 60 AS VARCHAR) || 'm' || {_SECONDS} END"""
_SIZE = "floor(l_extendedprice * l_quantity)"
_POWER = f"(CASE WHEN {_SIZE} < 1e3 THEN 0 WHEN {_SIZE} < 1e6 THEN 1 WHEN {_SIZE} < 1e9 THEN 2 ELSE 3 END)"
_UNITS = f"(floor({_SIZE} / pow(1000, {_POWER}) * 10 + 0.5) / 10)"
_BYTES = f"""CASE WHEN {_SIZE} < 10 THEN CAST(CAST({_SIZE} AS BIGINT) AS VARCHAR) || ' B' ELSE
  (CASE WHEN {_UNITS} < 10 THEN printf('%.1f', {_UNITS}) ELSE printf('%.0f', floor({_UNITS} + 0.5)) END) || ' ' || (['B', 'kB', 'MB', 'GB'])[{_POWER} + 1] END"""
_NUMBER = "(l_discount * 3)"
_NAME = "CASE WHEN p_size % 2 = 0 THEN p_name || '{' || p_type || '}' ELSE '<' || p_name || ' & ''x''>' END"
_ESCAPED = "replace(replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;')"
_WORDS = "words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT substr(c_mktsegment, 1, 4) || CAST(c_nationkey % 7 AS VARCHAR) FROM customer))"

_LAST_KM = _clamp("((n % 1200) / 1000::DOUBLE)")
_SINCE = _clamp("((n * 61 % 100000) / 60::DOUBLE / 1440::DOUBLE)")
_SPENT = "CASE WHEN avg_amount = 0 AND amount = 0 THEN 'nan'::DOUBLE WHEN avg_amount = 0 AND amount > 0 THEN 'inf'::DOUBLE WHEN avg_amount = 0 THEN '-inf'::DOUBLE ELSE amount / avg_amount END"
_PAYLOAD_EXACT = (
    _clamp("(amount / 10000::DOUBLE)"),
    _clamp("((n % 13 + 1) / 12::DOUBLE)"),
    _clamp(f"(({_SPENT}) / 10::DOUBLE)"),
    "(sec // 3600 % 24) / 23::DOUBLE",
    "((sec // 86400 + 3) % 7) / 6::DOUBLE",
    f"CASE WHEN n % 5 = 0 THEN -1.0 ELSE {_SINCE} END",
    f"CASE WHEN n % 5 = 0 THEN -1.0 ELSE {_LAST_KM} END",
    _clamp("((n * 37 % 1300) / 1000::DOUBLE)"),
    _clamp("((n % 25) / 20::DOUBLE)"),
    "(n % 3 = 0)::INT::DOUBLE",
    "(n % 4 = 1)::INT::DOUBLE",
    "(NOT list_contains(list_transform(range(1, n % 4 + 3), lambda i: n * i % 7), n % 9))::INT::DOUBLE",
    "([0.15, 0.30, 0.20, 0.45, 0.80, 0.75, 0.85, 0.35, 0.25, 0.50, 0.50])[n % 11 + 1]::DOUBLE",
    _clamp("((n % 997) * 12.5::DOUBLE / 10000::DOUBLE)"),
)
_PAYLOAD = f"""p AS (SELECT event_id AS n, value * 20 AS amount, (event_id % 11) * 25::DOUBLE AS avg_amount, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
pv AS (SELECT n AS event_id, {', '.join(f'{_round(x)} AS d{i}' for i, x in enumerate(_PAYLOAD_EXACT))} FROM p)"""
_PAYLOAD_TOP = f"""{_PAYLOAD}, e2 AS (SELECT event_id, [{', '.join(f'd{i}' for i in range(14))}] AS v, CASE WHEN d12 >= 0.75 THEN 'fraud' ELSE 'legit' END AS label FROM pv),
      near AS (SELECT a.event_id AS idx, b.event_id AS ref_id, b.label, {' + '.join(f'(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])' for i in range(1, 15))} AS d FROM e2 a JOIN e2 b ON true WHERE a.event_id % 20 = 0),
      top AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, ref_id) AS rank FROM near WHERE NOT isnan(d) QUALIFY rank <= 5)"""


def _number(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN printf('%.0f', {v}) ELSE {_trim(f"printf('%.10f', {v})")} END"


_REFS = "refs AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ref_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 5 THEN 'fraud' ELSE 'legit' END AS label FROM embeddings)"
_PRINTED = "CASE WHEN event_id % 5 < 2 THEN 'null' WHEN event_id % 4 = 0 THEN CAST(event_id // 4 AS VARCHAR) ELSE CAST(event_id / 4::DOUBLE AS VARCHAR) END"

SQL: dict[str, str] = {
    "q01_vector_score": f"WITH {_DECIDED} SELECT idx, votes, fraud_score, approved FROM decided",
    "q02_knn_l2": f"WITH {_top()} {_ROWS}",
    "q02b_knn_l2_pivots": f"WITH {_top()} {_ROWS}",
    "q03_knn_l1": f"WITH {_top('list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))')} {_ROWS}",
    "q04_knn_cosine": f"WITH {_top('list_cosine_distance(a.v, b.v)')} {_ROWS}",
    "q05_knn_majority": f"WITH {_top(k=3)} SELECT idx, round(avg((label = 'fraud')::INT), 6) AS share, avg((label = 'fraud')::INT) > 0.5 AS fraud FROM top GROUP BY idx",
    "q06_weighted_vote": f"WITH {_top()} SELECT idx, round(sum((label = 'fraud')::INT / (1e-6::DOUBLE + d)) / sum(1 / (1e-6::DOUBLE + d)), 6) AS score FROM top GROUP BY idx",
    "q07_clamp_round4": f"SELECT l_orderkey, l_linenumber, l_partkey, {_clamp('v')} AS clamped, {_round('v')} AS r4, {_round('v', 2)} AS r2 FROM (SELECT *, l_extendedprice / 50000 - 0.2::DOUBLE AS v FROM lineitem)",
    "q08_hour_dow": "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS dow FROM events",
    "q09_minutes_since_last": f"WITH {_HISTORY} SELECT event_id, round(coalesce(minutes, -1.0), 6) AS minutes FROM t",
    "q10_tx_count_24h": f"WITH {_HISTORY} SELECT event_id, tx_count_24h FROM t",
    "q11_amount_vs_average": f"WITH {_HISTORY} SELECT event_id, round(average + 1e-9::DOUBLE, 6) AS average, {_round(_clamp(f'(({_RATIO}) / 10::DOUBLE)'))} AS ratio FROM t",
    "q12_unknown_merchant": f"WITH {_HISTORY} SELECT event_id, unknown FROM t",
    "q13_mcc_risk": f"SELECT event_id, {_RISK} AS by_map, CASE event_type WHEN 'purchase' THEN 0.85 WHEN 'signup' THEN 0.45 WHEN 'error' THEN 0.75 WHEN 'click' THEN 0.15 ELSE 0.5 END::DOUBLE AS by_join FROM events",
    "q14_event_vector": f"WITH {_VECTOR} SELECT * FROM vec",
    "q15_stats": f"""WITH {_EVENT_DECIDED}, s AS (SELECT count(*) AS total, count(*) FILTER (NOT approved) AS fraud_count, count(*) FILTER (approved) AS legit_count, count(*) FILTER (fraud_score = 0.6::DOUBLE) AS edge_case_count FROM decided)
      SELECT *, {_round('fraud_count / total::DOUBLE')} AS fraud_rate, {_round('legit_count / total::DOUBLE')} AS legit_rate, {_round('edge_case_count / total::DOUBLE')} AS edge_case_rate FROM s""",
    "q16_confusion": f"WITH {_JUDGED} SELECT * FROM counts",
    "q17_weighted_errors": f"WITH {_JUDGED} SELECT n, weighted_errors, failures, round(epsilon, 9) AS epsilon, floor(failure_rate * 1e6 + 0.5) / 1e6::DOUBLE AS failure_rate FROM errs",
    "q18_p99": "SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "q19_p99_score": f"SELECT event_id, round({_p99_score('x')}, 6) AS p99_score FROM (SELECT event_id, (value - 5) * 20 AS x FROM events)",
    "q20_detection_score": f"SELECT o_orderkey, round({_detection('((o_orderkey % 200) / 1000::DOUBLE)', '((o_custkey % 1000) / 1000::DOUBLE)', '(o_orderkey % 500)')}, 6) AS detection_score FROM orders",
    "q21_final_score": f"""WITH {_JUDGED}, p AS (SELECT quantile_cont(value, 0.99) AS p99 FROM events),
      s AS (SELECT {_p99_score('p99')} AS a, {_detection('failure_rate', 'epsilon', 'weighted_errors')} AS b, failure_rate > 0.15 AS detection_cut FROM errs, p)
      SELECT round(a, 6) AS p99_score, round(b, 6) AS detection_score, detection_cut, round(a + b, 6) AS final_score FROM s""",
    "q22_ramp": """WITH s(stage, duration, target) AS (VALUES (1, 120, 900), (2, 31, 900), (3, 7, 10)), f AS (SELECT *, lag(target, 1, 1) OVER (ORDER BY stage) AS from_rate FROM s),
      r AS (SELECT *, CAST((from_rate + target) * duration // 2 AS BIGINT) AS stage_requests FROM f)
      SELECT *, CAST(sum(stage_requests) OVER (ORDER BY stage) AS BIGINT) AS cumulative FROM r""",
    "q23_first_per_owner": "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY o_custkey",
    "q23b_resolve_default": """WITH f AS (SELECT o_custkey, CAST(min(o_orderkey) AS VARCHAR) AS first FROM orders GROUP BY o_custkey)
      SELECT c_custkey AS owner, CASE WHEN c_nationkey % 2 = 0 THEN first ELSE c_mktsegment END AS submission FROM customer LEFT JOIN f ON c_custkey = o_custkey""",
    "q24_upsert": """WITH n AS (SELECT c_custkey AS owner, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS submission, c_acctbal + 1 AS score FROM customer WHERE c_custkey % 3 = 0)
      SELECT owner, submission, round(score, 6) AS score FROM (SELECT c_custkey AS owner, c_mktsegment AS submission, c_acctbal AS score FROM customer o
        WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.owner = o.c_custkey AND n.submission = o.c_mktsegment) UNION ALL SELECT * FROM n)""",
    "q25_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "q26_json": f"""SELECT event_id, {_KINDS.format('$.k')} AS kind, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, {_KINDS.format('$.missing')} AS missing,
      '{{"event_id":' || event_id || ',"type":"' || event_type || '","last":' || CASE WHEN event_id % 3 = 0 THEN '"' || event_type || '"' ELSE 'null' END || '}}' AS encoded FROM events""",
    "q27_arrays": """WITH a AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS a FROM orders GROUP BY o_custkey)
      SELECT o_custkey, len(a) AS n, a[2] AS second, list_contains(a, o_custkey) AS has, array_to_string(list_concat(list_concat(a[1:1], [-1]), a[2:]), ',') AS inserted,
        array_to_string(a[2:], ',') AS removed, array_to_string(list_concat([-2], a[2:]), ',') AS replaced FROM a""",
    "q27b_maps": """SELECT c_custkey, c_acctbal AS any_case, 1.0::DOUBLE AS exact, c_mktsegment = 'BUILDING' AS has, CAST(1 AS BIGINT) AS left FROM customer""",
    "q28_formats": f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_NUMBER} = floor({_NUMBER}) THEN printf('%.0f', {_NUMBER}) ELSE {_trim(f"printf('%.10f', {_NUMBER})")} END AS number,
      {_DURATION} AS duration, {_BYTES} AS bytes, printf('%.2f', floor(l_tax * 100 * 100) / 100::DOUBLE) || '%' AS percent FROM lineitem""",
    "q28b_names": f"""SELECT p_partkey, CASE WHEN contains(n, '{{') THEN '{{ ' || p_type || ' }}' ELSE n END AS shown, CASE WHEN contains(n, '{{') THEN '  ' ELSE '' END AS indent, {_ESCAPED} AS escaped, CAST(length(n) AS INT) AS width FROM (SELECT *, {_NAME} AS n FROM part)""",
    "q29_buckets": f"""WITH {_EVENT_TOP}
      SELECT idx, CAST(rank AS INT) AS rank, ref_id, label, round(sqrt(d), 6) AS d FROM top""",
    "q30_streaming_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "q31_sql_functions": f"""SELECT l_orderkey, l_linenumber, l_partkey, {_round('l_extendedprice / 33333::DOUBLE')} AS r4, {_clamp('(l_extendedprice / 50000 - 0.2::DOUBLE)')} AS c, {_round('l_discount * 10', 2)} < 0.6::DOUBLE AS ok, (l_orderkey - l_partkey) / 60::DOUBLE AS m FROM lineitem""",
    "q32_metrics": """SELECT event_type AS name, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS med, round(max(value), 6) AS max, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
      arg_max(value, (ts, event_id)) AS last, round(avg((value > 50)::INT), 6) AS rate, count(*) FILTER (value > 50) AS passes, count(*) FILTER (NOT value > 50) AS fails, CAST(floor(100 * count(*) FILTER (value > 50) / count(*)::DOUBLE) AS BIGINT) AS percent FROM events GROUP BY event_type""",
    "q33_edit_neighbors": f"WITH {_WORDS} SELECT a.word, b.word AS other, CAST(levenshtein(a.word, b.word) AS INT) AS distance FROM words a, words b WHERE levenshtein(a.word, b.word) <= 1",
    "q46_payload_vectors": f"WITH {_PAYLOAD} SELECT * FROM pv",
    "q47_references": f"""WITH {_REFS} SELECT ref_id, CAST({_number('v[1]')} AS DOUBLE) AS first, CAST({_number('v[64]')} AS DOUBLE) AS last, len(v) AS dims, label, '[' || {_number('v[1]')} || ',' || {_number('v[2]')} || ']' AS text FROM refs""",
    "q47b_references_gzip": f"WITH {_REFS} SELECT ref_id, CAST({_number('v[8]')} AS DOUBLE) AS eighth, label FROM refs",
    "q48_timestamps": """SELECT l_orderkey, l_linenumber, l_partkey, strftime(epoch_ms(e * 1000), '%Y-%m-%dT%H:%M:%SZ') AS text, e AS epoch, CAST(hour(epoch_ms(e * 1000)) AS INT) AS hour, CAST(isodow(epoch_ms(e * 1000)) - 1 AS INT) AS dow
      FROM (SELECT *, l_orderkey * 86399 + l_partkey * 61 - 40000000 AS e FROM lineitem)""",
    "q49_json_values": f"""SELECT event_id, '{{"b":[1,"x  y"],"a":' || event_id || ',"b":null}}' AS minified, '{{"list":[' || event_id || ',true],"n":' || event_id || ',"none":null,"type":"' || event_type || '"}}' AS made, event_type AS string, 'null' AS none,
      true AS any_case, false AS exact_case, abs(event_id / 3::DOUBLE - event_id / 3::DOUBLE * (1 + pow(2, -52))) <= event_id / 3::DOUBLE * (1 + pow(2, -52)) * pow(2, -52) AS close, {_PRINTED} AS printed, '[' || {_PRINTED} || ',' || event_id || ']' AS numbers, '["' || event_type || '","q\\""]' AS strings FROM events""",
    "q49b_json_items": """SELECT c_custkey, '{"B":1.0,"a":2.0}' AS map, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"set"}' AS set, '{"c_mktsegment":"set"}' AS dropped, c_acctbal AS copy FROM customer""",
    "q50_value_text": f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN printf('%.2f', floor(l_tax * 100 * 100) / 100::DOUBLE) || '%' WHEN 2 THEN {_BYTES} WHEN 3 THEN {_DURATION} ELSE {_trim(f"printf('%.6f', {_NUMBER})")} END AS text FROM lineitem""",
    "q51_is_known": """WITH k AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS known FROM orders GROUP BY o_custkey),
      c AS (SELECT c_custkey, coalesce(list_contains(known, (['1-URGENT', '2-HIGH', '3-MEDIUM', 'none'])[c_custkey % 4 + 1]), false) AS known FROM customer LEFT JOIN k ON c_custkey = o_custkey)
      SELECT c_custkey, known, (NOT known)::INT::DOUBLE AS unknown FROM c""",
    "q52_counter": "SELECT event_type AS name, round(sum(value), 6) AS count, round(sum(value) / 120, 6) AS rate FROM events GROUP BY event_type",
    "q53_upsert_last": """WITH n AS (SELECT o_custkey % 50 AS owner, o_orderpriority AS submission, max(o_orderkey) AS place FROM orders GROUP BY ALL), s(owner, submission, place) AS (VALUES (1, '1-URGENT', -1), (1, 'none', -2))
      SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.owner = s.owner AND n.submission = s.submission) UNION ALL SELECT * FROM n""",
    "q54_test_file": f"""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, 'tx-' || event_id AS id, (event_id % 6) / 5::DOUBLE AS score, value * 20 AS amount, event_id % 5 = 0 AS first FROM events),
      s AS (SELECT count(*) AS total, count(*) FILTER (score >= 0.6::DOUBLE) AS fraud_count, {_round('count(*) FILTER (score < 0.6::DOUBLE) / count(*)::DOUBLE')} AS legit_rate, count(*) FILTER (score = 0.6::DOUBLE) AS edge_case_count FROM r)
      SELECT idx, id, score < 0.6::DOUBLE AS expected_approved, score AS expected_fraud_score, amount, first, s.* FROM r, s""",
    "q55_participants": """SELECT r_name AS owner, CAST(row_number() OVER w - 1 AS INT) AS pos, n_name AS id, 'repo/' || n_nationkey AS repo, first_value(n_name) OVER w AS first
      FROM nation JOIN region ON n_regionkey = r_regionkey WINDOW w AS (PARTITION BY r_name ORDER BY n_nationkey)""",
    "q56_stream_scores": f"""WITH {_PAYLOAD_TOP}, s AS (SELECT idx, {_round("count(*) FILTER (label = 'fraud') / 5.0::DOUBLE")} AS fraud_score FROM top GROUP BY idx)
      SELECT event_id AS idx, coalesce(fraud_score, 0.0) AS fraud_score, coalesce(fraud_score, 0.0) < 0.6::DOUBLE AS approved FROM pv LEFT JOIN s ON event_id = idx WHERE event_id % 20 = 0""",
    "q57_config": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.5::DOUBLE ELSE n_nationkey / 100::DOUBLE END AS risk FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}
