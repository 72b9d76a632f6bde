"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from ..functions import features as X
from ..functions import sqltext as S
from ..sources.views import PORTS, TEMPLATES

_q = lambda s: "'" + s.replace("'", "''") + "'"
_k = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"
NET = f"""net AS (
  SELECT event_id AS row_id, ts AS timestamp, user_id::VARCHAR AS src_ip, event_type AS service, value * 20 AS bytes,
         1 + {_k} % 20 AS packets, (event_id % 100)::DOUBLE / 10 AS duration, {PORTS}[{_k} % {len(PORTS)} + 1] AS dst_port,
         CASE WHEN event_id % 10 < 7 THEN 'tcp' WHEN event_id % 10 < 9 THEN 'udp' ELSE 'icmp' END AS protocol,
         CASE WHEN event_type = 'error' THEN 'S0' ELSE 'SF' END AS flag, (event_type = 'error')::INT AS is_anomaly
  FROM events)"""
TEXT = f"""txt AS (
  SELECT event_id AS row_id, ts, user_id::VARCHAR AS ip,
         replace(replace([{', '.join(map(_q, TEMPLATES))}][(event_id % {len(TEMPLATES)} + 1)::INT], '{{u}}', user_id::VARCHAR), '{{k}}', {_k}::VARCHAR) AS query
  FROM events)"""
ORACLE: dict[str, str] = {}


def _in(values: list) -> str:
    return "(" + ", ".join(map(str, values)) + ")"


ORACLE["q_temporal_features"] = f"""WITH {NET}
SELECT row_id, hour(timestamp)::BIGINT AS hour_of_day, (isodow(timestamp) - 1)::BIGINT AS day_of_week, (isodow(timestamp) >= 6)::BIGINT AS is_weekend,
  (hour(timestamp) BETWEEN 9 AND 17 AND isodow(timestamp) < 6)::BIGINT AS is_working_hours, month(timestamp)::BIGINT AS month,
  day(timestamp)::BIGINT AS day_of_month, weekofyear(timestamp)::BIGINT AS week_of_year,
  NOT (hour(timestamp) BETWEEN 8 AND 18 AND isodow(timestamp) < 6) AS out_of_hours FROM net"""
ORACLE["q_port_features"] = f"""WITH {NET}
SELECT row_id, dst_port::BIGINT AS dst_port,
  CASE WHEN dst_port IN {_in(X.COMMON_PORTS)} THEN dst_port WHEN dst_port BETWEEN 1 AND 1023 THEN 1 WHEN dst_port BETWEEN 1 AND 49151 THEN 2 ELSE 3 END::BIGINT AS port_class,
  (dst_port IN {_in(X.SUSPICIOUS_PORTS)})::BIGINT AS suspicious, CASE WHEN dst_port IN {_in(X.COMMON_PORTS)} THEN dst_port ELSE 0 END::BIGINT AS common_port,
  (packets <= 3 AND duration < 0.5)::BIGINT AS port_scan_like FROM net"""
ORACLE["q_protocol_onehot"] = f"""WITH {NET}
SELECT row_id, CASE protocol WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END::BIGINT AS protocol_num,
  (protocol = 'tcp')::BIGINT AS protocol_tcp, (protocol = 'udp')::BIGINT AS protocol_udp, (protocol = 'icmp')::BIGINT AS protocol_icmp,
  (flag = 'SF')::BIGINT AS "flag_SF", (flag = 'S0')::BIGINT AS "flag_S0" FROM net"""
ORACLE["q_ip_hash"] = f"""WITH {NET}
SELECT src_ip, ('0x' || substr(md5(src_ip), 1, 8))::BIGINT % 10000 AS src_ip_hash, count(*)::BIGINT AS n FROM net GROUP BY ALL"""
ORACLE["q_rates"] = f"""WITH {NET}
SELECT row_id, round(bytes / (duration + 0.1), 6) AS bytes_per_second, round(packets / (duration + 0.1), 6) AS packets_per_second, round(ln(1 + bytes), 6) AS bytes_log FROM net"""
_BUCKET = "floor(epoch(timestamp) / %d)"
ORACLE["q_window_counts"] = f"""WITH {NET}
SELECT row_id, count(*) OVER (PARTITION BY service, {_BUCKET % 21600})::BIGINT AS service_6h, count(*) OVER (PARTITION BY src_ip, {_BUCKET % 86400})::BIGINT AS user_day FROM net"""
ORACLE["q_dos_like"] = f"""WITH {NET}, c AS (SELECT row_id, count(*) OVER (PARTITION BY service, {_BUCKET % 21600})::BIGINT AS connection_count FROM net)
SELECT row_id, connection_count, (connection_count > (SELECT quantile_cont(connection_count, 0.95) FROM c))::BIGINT AS is_dos_like FROM c"""


def _profile(source: str, key: str, features: list[str], least: int = 1, ctes: str = NET) -> str:
    long = " UNION ALL ".join(f"SELECT {key} AS key, '{f}' AS feature, {f}::DOUBLE AS x FROM {source} WHERE {f} IS NOT NULL" for f in features)
    return f"""WITH {ctes + ', ' if ctes else ''}long AS ({long})
SELECT key, feature, count(*)::BIGINT AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1,
  round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(min(x), 6) AS min, round(max(x), 6) AS max
FROM long GROUP BY key, feature HAVING count(*) >= {least}"""


_BASE = ["bytes", "packets", "duration"]
ORACLE["q_global_profile"] = _profile("net", "'all'", _BASE)
ORACLE["q_lineitem_profile"] = _profile("lineitem", "l_returnflag || '|' || l_linestatus", ["l_quantity", "l_extendedprice", "l_discount"], 10, "")
ORACLE["q_hour_profile"] = _profile("net", "hour(timestamp)::VARCHAR", _BASE)
ORACLE["q_day_profile"] = _profile("net", "(isodow(timestamp) - 1)::VARCHAR", _BASE)
ORACLE["q_protocol_profile"] = _profile("net", "protocol", _BASE)
ORACLE["q_service_profile_min_support"] = _profile("net", "service", _BASE, 1000)
ORACLE["q_protocol_port_profile"] = _profile("net", "protocol || '|' || dst_port", _BASE, 10)
ORACLE["q_category_distribution"] = f"WITH {NET} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM net WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("service", "protocol", "flag")
)
ORACLE["q_thresholds"] = f"""WITH {NET}, long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x FROM net" for f in _BASE)}),
s AS (SELECT feature, avg(x) AS m, greatest(avg(x) + 3 * stddev_samp(x), quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))) AS t, quantile_cont(x, 0.999) AS p FROM long GROUP BY feature)
SELECT feature, round(CASE WHEN t < 1.2 * m THEN 1.5 * m ELSE t END, 6) AS threshold, round(p, 6) AS p999 FROM s"""
ORACLE["q_standard_scale"] = f"WITH {NET} SELECT row_id, " + ", ".join(f"round(coalesce(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1 ELSE stddev_pop({f}) OVER () END, 0), 6) AS {f}" for f in _BASE) + " FROM net"
ORACLE["q_qcut_state"] = f"""WITH {NET}, e AS (SELECT {', '.join(f'quantile_cont(bytes, {q}) AS e{i}' for i, q in enumerate((0.2, 0.4, 0.6, 0.8)))}, min(bytes) AS lo, max(bytes) AS hi FROM net)
SELECT row_id, service || '_' || protocol || '_' || (len(list_filter(list_distinct([e0, e1, e2, e3]), lambda x: bytes > x AND x > lo AND x < hi)))::VARCHAR AS state FROM net, e"""


def _score(name: str, key: str, least: int, sigmas: float) -> str:
    part = lambda f: f"coalesce(greatest(0, abs({f} - m_{f}) / (s_{f} + 1e-10) - {sigmas}), 0)"
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in _BASE)
    return f"""WITH {NET}, p AS (SELECT {key} AS key, {stats} FROM net WHERE is_anomaly = 0 GROUP BY 1 HAVING count(*) >= {least})
SELECT row_id, round({' + '.join(map(part, _BASE))}, 6) AS {name} FROM net LEFT JOIN p ON {key} = p.key"""


ORACLE["q_statistical_score"] = _score("statistical_score", "'all'", 1, 2.0)
ORACLE["q_contextual_score"] = _score("contextual_score", "protocol || '|' || dst_port", 10, 1.5)


def _spikes(f: str, out: str, part: str = "src_ip") -> str:
    """A row per event with its share of the spikes of ``f``, window by window, in the order of each ``part``."""
    return f"""{out}_o AS (SELECT row_id, {part} AS g, {f}, row_number() OVER w AS r, abs({f} - lag({f}) OVER w) AS d FROM net WINDOW w AS (PARTITION BY {part} ORDER BY timestamp, row_id)),
{out}_w AS (SELECT a.g, a.r AS e, avg(b.d) AS m FROM {out}_o a JOIN {out}_o b ON a.g = b.g AND b.r BETWEEN a.r - 8 AND a.r GROUP BY ALL HAVING count(b.d) = 9),
{out}_h AS (SELECT o.g, o.r, sum(o.d / (m + 1e-10) - 3) AS h FROM {out}_o o JOIN {out}_w w ON o.g = w.g AND w.e BETWEEN o.r AND o.r + 8 WHERE m <> 0 AND o.d > 3 * m GROUP BY ALL),
{out} AS (SELECT o.row_id, coalesce(a.h, 0) + coalesce(b.h, 0) AS s FROM {out}_o o LEFT JOIN {out}_h a ON o.g = a.g AND o.r = a.r LEFT JOIN {out}_h b ON o.g = b.g AND o.r + 1 = b.r)"""


ORACLE["q_collective_spikes"] = f"WITH {NET}, {_spikes('bytes', 'c')} SELECT row_id, round(s, 6) AS collective_score FROM c"
ORACLE["q_whole_spikes"] = f"WITH {NET}, {_spikes('bytes', 'c', '1')} SELECT row_id, round(s, 6) AS collective_score FROM c"


def _adaptive() -> str:
    part = lambda a, f: f"coalesce(greatest(0, abs({f} - {a}.m_{f}) / ({a}.s_{f} + 1e-10) - 2.0), 0)"
    total = lambda a: " + ".join(part(a, f) for f in _BASE)
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in _BASE)
    keys = {"g": ("'all'", 1), "h": ("hour(timestamp)", 1), "w": ("(hour(timestamp) BETWEEN 9 AND 17 AND isodow(timestamp) < 6)", 1), "p": ("protocol || '|' || dst_port", 10)}
    tables = ", ".join(f"{a} AS (SELECT {k} AS key, {stats} FROM net WHERE is_anomaly = 0 GROUP BY 1 HAVING count(*) >= {n})" for a, (k, n) in keys.items())
    joins = " ".join(f"LEFT JOIN {a} ON {k} = {a}.key" for a, (k, _) in keys.items())
    mm = lambda c: f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"
    return f"""WITH {NET}, {tables}, {', '.join(_spikes(f, f'x{i}') for i, f in enumerate(_BASE))},
raw AS (SELECT net.row_id, {total('g')} AS a, {total('h')} + {total('w')} + {total('p')} AS b, x0.s + x1.s + x2.s AS c
        FROM net {joins} JOIN x0 ON net.row_id = x0.row_id JOIN x1 ON net.row_id = x1.row_id JOIN x2 ON net.row_id = x2.row_id),
sc AS (SELECT row_id, {mm('a')} AS a, {mm('b')} AS b, {mm('c')} AS c FROM raw),
t AS (SELECT *, 0.4 * a + 0.3 * b + 0.1 * c AS s FROM sc), f AS (SELECT *, {mm('s')} AS score FROM t),
y AS (SELECT *, (score >= least((SELECT quantile_cont(score, 0.95) FROM f), 0.7) AND (SELECT max(score) > min(score) FROM f))::BIGINT AS hit FROM f)
SELECT row_id, round(score, 5) AS anomaly_score, hit AS predicted_anomaly, CASE WHEN hit = 0 THEN 'Normal' WHEN a = greatest(a, b, c) THEN 'Statistical Anomaly' WHEN b = greatest(a, b, c) THEN 'Contextual Anomaly' ELSE 'Collective Anomaly' END AS anomaly_type FROM y"""


ORACLE["q_adaptive_detect"] = _adaptive()


def _transitions(source: str, state: str, part: str, order: str, least: int) -> str:
    return f"""o AS (SELECT {state} AS state, lead({state}) OVER (PARTITION BY {part} ORDER BY {order}) AS next_state FROM {source}),
t AS (SELECT state, next_state, count(*)::BIGINT AS n FROM o WHERE next_state IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN n >= {least} THEN n / sum(n) OVER (PARTITION BY state) ELSE 0 END AS p FROM t)"""


ORACLE["q_transition_probs"] = f"WITH {NET}, {_transitions('net', 'service', 'src_ip', 'timestamp, row_id', 5)} SELECT state, next_state, n, round(p, 6) AS p FROM m"
ORACLE["q_order_transitions"] = f"WITH {_transitions('orders', chr(39).join(['o_orderstatus || ', '_', ' || o_orderpriority']), 'o_custkey', 'o_orderdate, o_orderkey', 2)} SELECT state, next_state, n, round(p, 6) AS p FROM m"
_STATE = "service || '_' || protocol"
ORACLE["q_whole_transitions"] = f"WITH {NET}, {_transitions('net', 'service', '1', 'timestamp, row_id', 5)} SELECT state, next_state, n, round(p, 6) AS p FROM m"


def _sequence_score(part: str) -> str:
    return f"""WITH {NET}, {_transitions('net', _STATE, part, 'timestamp, row_id', 5)},
x AS (SELECT row_id, {part} AS g, timestamp, {_STATE} AS state, lead({_STATE}) OVER (PARTITION BY {part} ORDER BY timestamp, row_id) AS nx FROM net),
y AS (SELECT x.*, CASE WHEN nx IS NULL THEN NULL WHEN p > 0 THEN -ln(p / (SELECT min(p) FROM m WHERE p > 0)) ELSE 10 END AS step FROM x LEFT JOIN m ON x.state = m.state AND x.nx = m.next_state)
SELECT row_id, round(coalesce(avg(step) OVER (PARTITION BY g ORDER BY timestamp, row_id ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), 0), 6) AS raw_score FROM y"""


ORACLE["q_sequence_score"] = _sequence_score("src_ip")
ORACLE["q_whole_sequence_score"] = _sequence_score("1")
_DOS = ["connection_count", "bytes_per_second", "traffic_intensity", "syn_flag", "icmp_flag", "udp_flag"]
ORACLE["q_dos_detect"] = f"""WITH {NET}, c AS (SELECT *, count(*) OVER (PARTITION BY service, {_BUCKET % 21600}) AS connection_count FROM net),
f AS (SELECT *, bytes / (duration + 0.1) AS bytes_per_second, (connection_count * packets)::DOUBLE AS traffic_intensity, (flag = 'S0')::INT AS syn_flag, (protocol = 'icmp')::INT AS icmp_flag, (protocol = 'udp')::INT AS udp_flag FROM c),
l AS (SELECT {', '.join(f'quantile_cont({x}, 0.99) AS l_{x}' for x in _DOS)} FROM f),
s AS (SELECT f.*, {' + '.join(f'CASE WHEN l_{x} > 0 THEN greatest(0, {x} / l_{x} - 1) ELSE 0 END' for x in _DOS)} AS raw FROM f, l),
a AS (SELECT *, coalesce(raw / nullif(max(raw) OVER (), 0), 0) AS score FROM s)
SELECT row_id, round(score, 6) AS anomaly_score, (score > 0)::BIGINT AS predicted_anomaly,
  CASE WHEN score <= 0 THEN 'Normal' WHEN udp_flag = 1 THEN 'UDP Flood' WHEN icmp_flag = 1 THEN 'ICMP Flood' WHEN syn_flag = 1 THEN 'SYN Flood' ELSE 'Generic DoS' END AS dos_attack_type FROM a"""

_match = lambda p, t="lower(query)": f"regexp_matches({t}, {_q(p.lower())})"
_CRIT = " OR ".join(map(_match, S.CRITICAL))
_SEC = " + ".join(f"{_match(p)}::INT" for p in S.SECONDARY)
_ODD = """((length(query) - length(replace(query, '''', ''))) % 2 <> 0 OR (length(query) - length(replace(query, '"', ''))) % 2 <> 0)"""
_PS = f"CASE WHEN {_CRIT} THEN 1.0 WHEN {_ODD} THEN greatest(least(0.9, ({_SEC}) * 0.15), 0.6) ELSE least(0.9, ({_SEC}) * 0.15) END"
ORACLE["q_sqli_patterns"] = f"WITH {TEXT} SELECT row_id, ({_CRIT}) AS critical, ({_SEC})::BIGINT AS n_secondary, round(({_PS})::DOUBLE, 6) AS pattern_score FROM txt"
_CRIT_T = " OR ".join(_match(p, "lower(t)") for p in S.CRITICAL)
ORACLE["q_sqli_pages"] = f"SELECT kind, count(*)::BIGINT AS n, count(*) FILTER (contains(t, '--') OR contains(t, '#'))::BIGINT AS comment_signs, count(*) FILTER ({_CRIT_T})::BIGINT AS flagged FROM (SELECT 'pages' AS kind, html AS t FROM pages UNION ALL SELECT 'documents', text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY kind"
_has = lambda words: "(" + " OR ".join(f"contains(lower(query), {_q(w)})" for w in words) + ")"
_KINDS = " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in S.ATTACKS) + f" WHEN contains(query, ';') AND {_has(S.STACKED)} THEN 'stacked_queries' " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in S.LATE_ATTACKS)
ORACLE["q_sqli_attack_type"] = f"""WITH {TEXT}, s AS (SELECT *, {_PS} AS score FROM txt)
SELECT row_id, CASE {_KINDS} ELSE 'generic_injection' END AS attack_type, CASE WHEN score >= 0.9 THEN 'Critical' WHEN score >= 0.75 THEN 'High' WHEN score >= 0.6 THEN 'Medium' ELSE 'Low' END AS threat_level, {_ODD} AS odd_quotes FROM s"""
_COMPLEX = (
    " + ".join(f"regexp_matches(query, '(?i)\\b{w}\\b')::INT * {n}" for w, n in S.COMPLEXITY)
    + " + regexp_matches(query, '(?i)\\([^()]*SELECT[^()]*\\)')::INT * 5 + 2 * len(regexp_extract_all(query, '(?i)\\bAND\\b|\\bOR\\b')) + 2 * len(regexp_extract_all(query, '\\b\\w+\\s*\\(')) + length(query) / 50.0"
)
ORACLE["q_sqli_complexity"] = f"WITH {TEXT} SELECT row_id, round(({_COMPLEX})::DOUBLE, 6) AS complexity FROM txt"


def _history(part: str) -> str:
    return f"""WITH {TEXT}, s AS (SELECT row_id, {part} AS g, ts, ({_PS})::DOUBLE AS score FROM txt),
h AS (SELECT row_id, list_sort(list(score) OVER w) AS h, avg(score) OVER w AS m, stddev_pop(score) OVER w AS d FROM s WINDOW w AS (PARTITION BY g ORDER BY ts, row_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, list_filter(range(2, len(h) + 1), lambda i: h[i] - h[i - 1] > 0.15) AS g FROM h)
SELECT row_id, round(CASE WHEN coalesce(len(h), 0) > 10 THEN least(0.8, greatest(0.4, CASE WHEN len(g) > 0 THEN (h[g[1] - 1] + h[g[len(g)]]) / 2 ELSE m + 2 * d END)) ELSE 0.5 END, 6) AS threshold FROM g"""


ORACLE["q_sqli_adaptive_threshold"] = _history("ip")
ORACLE["q_sqli_whole_history"] = _history("1")
_RECON = " + ".join(f"{_match(p)}::INT" for p in S.RECON)
_VALUE = r"TRY_CAST(nullif(regexp_extract(query, '(?is)\bWHERE\b.*?\b(\d+)\b', 1), '') AS BIGINT)"
_SCAN = "(len(%(v)s) >= 3 AND (list_min(list_transform(range(2, len(%(v)s) + 1), lambda i: %(v)s[i] - %(v)s[i - 1])) >= 0 OR list_max(list_transform(range(2, len(%(v)s) + 1), lambda i: %(v)s[i] - %(v)s[i - 1])) <= 0))"
ORACLE["q_sqli_context"] = f"""WITH {TEXT}, a AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, ({_COMPLEX})::DOUBLE AS cx, {_RECON} AS rc, {_VALUE} AS val FROM txt WINDOW w AS (PARTITION BY ip ORDER BY ts, row_id)),
b AS (SELECT *, sum(CASE WHEN gap < 500000 THEN 1.0 WHEN gap < 1000000 THEN 0.5 ELSE 0 END) OVER w AS cnt, sum(rc) OVER l AS recon, list_filter(list(val) OVER l, lambda x: x IS NOT NULL) AS vs, list(cx) OVER l AS cs
      FROM a WINDOW w AS (PARTITION BY ip ORDER BY ts, row_id), l AS (PARTITION BY ip ORDER BY ts, row_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, {_SCAN % {'v': 'vs'}} AS scan, len(cs) >= 3 AND cs[len(cs)] > 1.5 * cs[1] AND len(list_filter(range(2, len(cs)), lambda i: cs[i] < 0.8 * cs[i - 1])) = 0 AS up FROM b)
SELECT row_id, round(CASE WHEN ip IS NULL THEN 0 ELSE least(0.6, CASE WHEN gap < 500000 THEN 0.05 WHEN gap < 1000000 THEN 0.02 ELSE 0 END + CASE WHEN cnt > 5 THEN least(0.3, 0.05 * cnt) ELSE 0 END
  + CASE WHEN coalesce(scan, false) THEN 0.15 ELSE 0 END + CASE WHEN up THEN 0.2 ELSE 0 END + CASE WHEN recon >= 2 THEN 0.25 ELSE 0 END) END::DOUBLE, 6) AS context_score FROM c"""
ORACLE["q_sqli_scan"] = f"""WITH {TEXT}, a AS (SELECT row_id, ip, ts, {_VALUE} AS value FROM txt), b AS (SELECT row_id, value, list_filter(list(value) OVER (PARTITION BY ip ORDER BY ts, row_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS vs FROM a)
SELECT row_id, coalesce(value, -1)::BIGINT AS value, coalesce({_SCAN % {'v': 'vs'}}, false) AS scan FROM b"""
ORACLE["q_sqli_combine"] = f"""WITH {TEXT}, s AS (SELECT row_id, query, ({_PS})::DOUBLE AS p, (row_id % 11) / 10.0::DOUBLE AS m, (row_id % 7) / 6.0::DOUBLE AS a FROM txt),
t AS (SELECT *, CASE WHEN p >= 0.9 THEN p WHEN a >= 0.8 THEN greatest(p, 0.7 * a + 0.3 * m) ELSE 0.6 * p + 0.2 * m + 0.2 * a END AS score,
  CASE WHEN p >= 0.7 THEN 0.58 WHEN p < 0.1 THEN 0.65 WHEN row_id % 3 = 0 THEN 0.55 WHEN regexp_matches(upper(query), 'UNION|DROP|EXEC|WAITFOR') THEN 0.5 ELSE 0.58 END::DOUBLE AS threshold FROM s)
SELECT row_id, round(score, 6) AS score, round(threshold, 6) AS threshold,
  array_to_string(list_filter([CASE WHEN p >= threshold THEN 'pattern' END, CASE WHEN m >= threshold THEN 'ml' END, CASE WHEN a >= threshold THEN 'advanced_ml' END, CASE WHEN 0.1 + greatest(p, m, a) >= threshold THEN 'context' END], lambda x: x IS NOT NULL), ',') AS detected_by FROM t"""

_W = {"volume": 1.5, "duration": 1.0, "port": 1.0}
_SCORED = f"""{NET}, p AS (SELECT *, 0.5 * coalesce(dst_port IN {_in(X.SUSPICIOUS_PORTS)}, false)::INT + 0.25 * (packets <= 3)::INT AS port FROM net),
s AS (SELECT *, bytes::DOUBLE AS score_volume, duration AS score_duration, port::DOUBLE AS score_port, (bytes > 2000)::INT AS anomaly_volume, (duration < 1)::INT AS anomaly_duration, (port >= 0.5)::INT AS anomaly_port FROM p)"""
_sum = lambda t: " + ".join(f"{t % d} * ({w} / 3.5::DOUBLE)" for d, w in _W.items())
_mm = lambda c: f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"
_top = "SELECT row_id, round(x, 6) AS fused_score, (x > (SELECT quantile_cont(x, 0.95) FROM f) AND (SELECT max(x) > min(x) FROM f))::BIGINT AS fused_anomaly FROM f"
ORACLE["q_majority_vote"] = f"WITH {_SCORED} SELECT row_id, round({_sum('score_%s')}, 6) AS fused_score, ({_sum('anomaly_%s')} > 0.5)::BIGINT AS fused_anomaly FROM s"
ORACLE["q_weighted_average"] = f"WITH {_SCORED}, m AS (SELECT row_id, {', '.join(f'{_mm(f'score_{d}')} AS {d}' for d in _W)} FROM s), f AS (SELECT row_id, {_sum('%s')} AS x FROM m) {_top}"
ORACLE["q_rank_fusion"] = f"WITH {_SCORED}, m AS (SELECT row_id, {', '.join(f'rank() OVER (ORDER BY score_{d}) AS {d}' for d in _W)} FROM s), g AS (SELECT row_id, {_sum('%s')} AS y FROM m), f AS (SELECT row_id, {_mm('y')} AS x FROM g) {_top}"
ORACLE["q_adaptive_fusion"] = f"""WITH {_SCORED}, m AS (SELECT s.*, {', '.join(f'{_mm(f'score_{d}')} AS n_{d}' for d in _W)} FROM s)
SELECT row_id, round(greatest({', '.join(f'n_{d}' for d in _W)}), 6) AS fused_score, CASE WHEN anomaly_volume = anomaly_duration AND anomaly_duration = anomaly_port THEN anomaly_volume
  WHEN n_volume = greatest(n_volume, n_duration, n_port) THEN anomaly_volume WHEN n_duration = greatest(n_volume, n_duration, n_port) THEN anomaly_duration ELSE anomaly_port END::BIGINT AS fused_anomaly FROM m"""
ORACLE["q_anomaly_types"] = f"""WITH {NET}, v AS (SELECT *, bytes / (duration + 0.1) AS v FROM net)
SELECT row_id, CASE WHEN v > (SELECT quantile_cont(v, 0.99) FROM v) THEN 'Volume Anomaly' WHEN dst_port IN {_in(X.SUSPICIOUS_PORTS)} THEN 'Unusual Port' WHEN packets <= 3 AND duration < 0.5 THEN 'Port Scan'
  WHEN NOT (hour(timestamp) BETWEEN 8 AND 18 AND isodow(timestamp) < 6) THEN 'Unusual Time' ELSE 'Unknown Anomaly' END AS anomaly_type FROM v"""
_CELLS = "count(*) FILTER (%(p)s AND y = 1)::BIGINT AS tp, count(*) FILTER (%(p)s AND y = 0)::BIGINT AS fp, count(*) FILTER (NOT (%(p)s) AND y = 0)::BIGINT AS tn, count(*) FILTER (NOT (%(p)s) AND y = 1)::BIGINT AS fn"
_R = {"accuracy": "(tp + tn) / nullif(tp + fp + tn + fn, 0)", "precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)", "fpr": "fp / nullif(fp + tn, 0)", "fnr": "fn / nullif(fn + tp, 0)"}
_rate = lambda *names: ", ".join(f"round(coalesce({_R[n]}, 0), 6) AS {n}" for n in names)
ORACLE["q_metrics"] = f"""WITH {_SCORED}, l AS ({' UNION ALL '.join(f"SELECT 'anomaly_{d}' AS detector, anomaly_{d} AS q, is_anomaly AS y FROM s" for d in _W)}),
c AS (SELECT detector, {_CELLS % {'p': 'q = 1'}} FROM l GROUP BY detector) SELECT detector, tp, fp, tn, fn, {_rate(*_R)} FROM c"""
ORACLE["q_metrics_sweep"] = f"""WITH {_SCORED}, t AS ({' UNION ALL '.join(f'SELECT {p}::DOUBLE AS percentile, quantile_cont(score_volume, {p / 100}) AS threshold FROM s' for p in (50, 75, 90, 95, 99))}),
c AS (SELECT percentile, threshold, {_CELLS % {'p': 'score_volume > threshold'}} FROM t, (SELECT score_volume, is_anomaly AS y FROM s) GROUP BY ALL)
SELECT percentile, round(threshold, 6) AS threshold, tp, fp, tn, fn, {_rate('precision', 'recall', 'f1')} FROM c"""
ORACLE["q_auc"] = """WITH j AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM j)
SELECT round(((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0))::DOUBLE, 6) AS auc FROM r"""
ORACLE["q_roc_curve"] = f"""WITH {_SCORED}, d AS (SELECT score_duration AS t, count(*) FILTER (is_anomaly = 1) AS a, count(*) FILTER (is_anomaly = 0) AS b FROM s GROUP BY 1),
r AS (SELECT t, sum(a) OVER (ORDER BY t DESC) AS tp, sum(b) OVER (ORDER BY t DESC) AS fp, sum(a) OVER () AS p, sum(b) OVER () AS n FROM d)
SELECT round(t, 6) AS threshold, round(coalesce(fp / nullif(n, 0), 0), 6) AS fpr, round(coalesce(tp / nullif(p, 0), 0), 6) AS tpr, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision FROM r"""
ORACLE["q_histogram"] = f"""WITH {_SCORED}, b AS (SELECT min(score_volume) AS lo, max(score_volume) AS hi FROM s)
SELECT least(29, floor((score_volume - lo) / (hi - lo) * 30))::BIGINT AS bin, is_anomaly::BIGINT AS label, count(*)::BIGINT AS n FROM s, b GROUP BY ALL"""
ORACLE["q_top_anomalies"] = f"WITH {NET} SELECT row_id, service, round(bytes, 6) AS bytes FROM net ORDER BY bytes DESC, row_id LIMIT 10"
ORACLE["q_density_noise"] = f"""WITH {NET}, z AS (SELECT row_id, (bytes - avg(bytes) OVER ()) / stddev_pop(bytes) OVER () AS a, (duration - avg(duration) OVER ()) / stddev_pop(duration) OVER () AS b FROM net),
p AS (SELECT x.row_id AS i, y.row_id AS j FROM z x, z y WHERE (x.a - y.a) ** 2 + (x.b - y.b) ** 2 <= 0.1 * 0.1),
core AS (SELECT i FROM p GROUP BY i HAVING count(*) >= 5)
SELECT row_id, (row_id NOT IN (SELECT p.i FROM p JOIN core ON p.j = core.i))::BIGINT AS noise FROM z"""

_H = "('0x' || substr(md5(row_id::VARCHAR || ':42'), 1, 8))::BIGINT %% 1000" % ()
ORACLE["q_stratified_sample"] = f"""WITH {NET}, r AS (SELECT row_id, is_anomaly, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5(row_id::VARCHAR || ':42'), row_id) AS n FROM net)
SELECT row_id, is_anomaly::BIGINT AS is_anomaly FROM r WHERE n <= CASE is_anomaly WHEN 0 THEN 700 ELSE 300 END"""
ORACLE["q_train_test_split"] = f"WITH {NET} SELECT row_id, CASE WHEN {_H} < 600 THEN 0 WHEN {_H} < 800 THEN 1 ELSE 2 END::BIGINT AS part FROM net"
ORACLE["q_stratified_split"] = f"""WITH {NET}, r AS (SELECT row_id, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5(row_id::VARCHAR || ':42')) - 1 AS i, count(*) OVER (PARTITION BY is_anomaly) AS n FROM net)
SELECT row_id, CASE WHEN i < round(0.7 * n) THEN 0 ELSE 1 END::BIGINT AS part FROM r"""
ORACLE["q_set_difference"] = f"WITH {NET} SELECT row_id FROM net WHERE {_H} >= 700"
ORACLE["q_informative_weights"] = f"""WITH {_SCORED}, l AS ({' UNION ALL '.join(f"SELECT 'score_{d}' AS detector, abs(corr(score_{d}, is_anomaly)) AS a, var_pop(score_{d}) / (avg(score_{d}) + 1e-10) AS b FROM s" for d in _W)})
SELECT detector, round(0.7 / 3::DOUBLE + 0.3 * a / sum(a) OVER (), 6) AS by_label, round(0.7 / 3::DOUBLE + 0.3 * b / sum(b) OVER (), 6) AS by_dispersion FROM l"""
ORACLE["q_f1_weights"] = f"""WITH {_SCORED}, l AS ({' UNION ALL '.join(f"SELECT 'anomaly_{d}' AS detector, anomaly_{d} AS q, is_anomaly AS y FROM s" for d in _W)}),
c AS (SELECT detector, {_CELLS % {'p': 'q = 1'}} FROM l GROUP BY detector), f AS (SELECT detector, coalesce({_R['f1']}, 0) AS f1 FROM c)
SELECT detector, round(f1, 6) AS f1, round(greatest(f1, 0.01) / sum(greatest(f1, 0.01)) OVER (), 6) AS weight FROM f"""
ORACLE["q_gap_threshold"] = f"""WITH {_SCORED}, d AS (SELECT DISTINCT score_volume AS v FROM s), g AS (SELECT v, lead(v) OVER (ORDER BY v) AS above, lead(v) OVER (ORDER BY v) - v AS gap FROM d),
h AS (SELECT * FROM g WHERE above IS NOT NULL), l AS (SELECT quantile_cont(gap, 0.95) AS g FROM h WHERE gap >= (SELECT quantile_cont(gap, 0.75) FROM h)),
n AS (SELECT min(above) AS nat FROM h, l WHERE gap > g)
SELECT round(CASE WHEN nat > 2500 THEN nat ELSE least((SELECT quantile_cont(score_volume, 0.95) FROM s), 2500) END, 6) AS threshold FROM n"""
ORACLE["q_weight_grid"] = f"""WITH {_SCORED}, w AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.5, 0.5), (2, 0.2, 10.0)) x(weights, a, b)), t AS (SELECT unnest([50.0::DOUBLE, 500, 1000]) AS threshold),
c AS (SELECT weights, threshold, {_CELLS % {'p': 'score_volume * a + score_duration * b > threshold'}} FROM (SELECT score_volume, score_duration, is_anomaly AS y FROM s), w, t GROUP BY ALL)
SELECT weights::BIGINT AS weights, threshold, tp, fp, tn, fn, {_rate('f1')} FROM c"""
ORACLE["q_cascade"] = f"WITH {_SCORED} SELECT row_id, round(least(score_volume, score_port), 6) AS fused_score, (anomaly_volume * anomaly_port)::BIGINT AS fused_anomaly FROM s"
ORACLE["q_top_states"] = f"""WITH {_transitions('orders', chr(39).join(['o_orderstatus || ', '_', ' || o_orderpriority']), 'o_custkey', 'o_orderdate, o_orderkey', 2)},
e AS (SELECT state FROM m WHERE p > 0.01 UNION ALL SELECT next_state FROM m WHERE p > 0.01) SELECT state, count(*)::BIGINT AS degree FROM e GROUP BY state ORDER BY degree DESC, state LIMIT 15"""
_WHERE = r"(?i)\bWHERE\b.*?(?:\bORDER BY\b|\bGROUP BY\b|\bHAVING\b|$)"
_FIRST = r"""\b\w+\s*=\s*(?:['"][\w@.]+['"]|\d+)"""
ORACLE["q_sqli_synthetic"] = f"""WITH {TEXT}, p AS (SELECT row_id, query, regexp_extract(query, '(?i)\\bSELECT\\b.*?\\bFROM\\b') AS cols, regexp_extract(query, {_q(_WHERE)}) AS cond FROM txt),
a AS (SELECT *, regexp_extract(cond, {_q(_FIRST)}) AS cmp FROM p WHERE cols <> '' AND cond <> ''),
b AS (SELECT *, instr(cond, cmp) AS a, regexp_extract(cmp, '^\\w+\\s*=\\s*') AS head FROM a)
SELECT row_id, 'boolean' AS kind, CASE WHEN cmp = '' THEN query ELSE replace(query, cond, cond[1:a - 1] || head || ''' OR 1=1 --' || cond[a + length(cmp):]) END AS attack FROM b
UNION ALL SELECT row_id, 'union', query || ' UNION SELECT ' || array_to_string(list_transform(range(0, length(cols) - length(replace(cols, ',', '')) + 1), lambda x: '1'), ',') || ' --' FROM b"""
# Tokens: the longest words of a rule first, white space left out; their kinds by their first letters.
_WORDS = "('" + "','".join("SELECT FROM WHERE INSERT UPDATE DELETE DROP CREATE ALTER UNION JOIN HAVING GROUP ORDER BY LIMIT PROCEDURE EXEC EXECUTE WAITFOR DELAY BENCHMARK INTO VALUES TABLE DATABASE COLUMN INDEX CONSTRAINT VIEW FUNCTION TRIGGER SCHEMA GRANT REVOKE COMMIT ROLLBACK SAVEPOINT TRANSACTION SET DECLARE CASE WHEN THEN ELSE END AND OR NOT EXISTS BETWEEN LIKE IN IS NULL TRUE FALSE PRIMARY FOREIGN KEY REFERENCES INNER OUTER LEFT RIGHT FULL CROSS NATURAL ON USING COUNT SUM AVG MIN MAX DISTINCT ALL EXCEPT INTERSECT ANY SOME FOR OFFSET FETCH FIRST NEXT ONLY WITH".split()) + "')"
_SPLIT = r"""'[^']*'|"[^"]*"|`[^`]*`|--[^\n]*|#[^\n]*|/\*(?s:.*?)\*/|[0-9]+(?:\.[0-9]+)?|[A-Za-z_@][A-Za-z0-9_@$]*|<=|>=|<>|!=|\|\||&&|<<|>>|[^ \t\n\x0B\f\r]"""
_KIND = f"""CASE WHEN v[1] IN ('''', '"', '`') AND length(v) > 1 THEN 'string' WHEN regexp_matches(v, '^(--|#|/\\*)') THEN 'comment' WHEN regexp_matches(v, '^[0-9]') THEN 'number' WHEN upper(v) IN {_WORDS} THEN 'keyword'
  WHEN regexp_matches(v, '^[A-Za-z_@]') THEN 'identifier' WHEN regexp_full_match(v, '<=|>=|<>|!=|\\|\\||&&|<<|>>|[-=<>+*/%^&|~!]') THEN 'operator' ELSE 'other' END"""


def _tokens(source: str, keys: str, score: str = "") -> str:
    """Tokens as rows with the three after each; what a rule finds at any of them."""
    rules = {
        "boolean": "v = 'OR' AND k = 'keyword' AND ((k1 = 'number' AND v2 = '=') OR (k1 = 'keyword' AND v1 = 'TRUE') OR (k1 = 'string' AND v2 = '=' AND k3 = 'string'))",
        "union": "v = 'UNION' AND ((v1 = 'SELECT') OR (v1 = 'ALL' AND v2 = 'SELECT'))",
        "time": "v IN ('SLEEP', 'WAITFOR', 'BENCHMARK')",
        "destructive": "v = 'DROP'",
        "command_exec": "k = 'identifier' AND contains(v, 'CMDSHELL')",
    }
    found = ", ".join(f"bool_or(coalesce(k2 IS NOT NULL AND ({r}), false)) AS f_{n}" for n, r in rules.items())
    listed = "concat_ws(',', " + ", ".join(f"CASE WHEN f_{n} THEN '{n}' END" for n in rules) + ")"
    return f"""src AS ({source}), x AS (SELECT {keys}, unnest(regexp_extract_all(coalesce(t, ''), {_q(_SPLIT)})) AS v, generate_subscripts(regexp_extract_all(coalesce(t, ''), {_q(_SPLIT)}), 1) AS i FROM src),
y AS (SELECT {keys}, i, {_KIND} AS k, v FROM x), z AS (SELECT {keys}, i, k, CASE WHEN k IN ('keyword', 'identifier') THEN upper(v) ELSE v END AS v FROM y),
n AS (SELECT *, lead(k) OVER w AS k1, lead(v) OVER w AS v1, lead(k, 2) OVER w AS k2, lead(v, 2) OVER w AS v2, lead(k, 3) OVER w AS k3 FROM z WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
g AS (SELECT {keys}, count(*)::BIGINT AS n_tokens, string_agg(k || ' ' || v, chr(10) ORDER BY i) AS listed, {found} FROM n GROUP BY {keys})
SELECT {', '.join('src.' + k.strip() for k in keys.split(','))}, coalesce(n_tokens, 0) AS n_tokens, sha256(coalesce(listed, '')) AS tokens, coalesce({listed}, '') AS findings{score} FROM src LEFT JOIN g USING ({keys})"""


_TEXTS = "SELECT 'documents' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages"
ORACLE["q_sqli_tokens"] = f"WITH {TEXT}, {_tokens('SELECT row_id, query AS t FROM txt', 'row_id')}"
ORACLE["q_sqli_text_tokens"] = f"WITH {_tokens(_TEXTS, 'kind, id', ', CASE WHEN t IS NULL THEN 0 ELSE ' + _PS.replace('query', 't') + ' END::DOUBLE AS pattern_score')}"
ORACLE["q_sqli_advice"] = f"""WITH {TEXT}, k AS (SELECT CASE {_KINDS} ELSE 'generic_injection' END AS attack_type FROM txt)
SELECT attack_type, CASE attack_type {' '.join(f"WHEN '{k}' THEN {_q(v)}" for k, v in S.ADVICE.items())} ELSE {_q(S.DEFAULT_ADVICE)} END AS recommendation, count(*)::BIGINT AS n FROM k GROUP BY ALL"""
ORACLE["q_customer_distribution"] = _profile("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "r_name || '|' || n_name", ["c_acctbal"], 1, "")

ORACLE["q_anomaly_subtypes"] = f"""WITH {NET}, c AS (SELECT *, count(*) OVER (PARTITION BY service, {_BUCKET % 21600}) AS n, bytes / (duration + 0.1) AS v FROM net)
SELECT row_id, CASE WHEN n > (SELECT quantile_cont(n, 0.95) FROM c) THEN 'DoS Attack' WHEN packets <= 3 AND duration < 0.5 THEN 'Port Scan' WHEN v > 3 * (SELECT avg(v) FROM c) THEN 'Volume Anomaly'
  WHEN dst_port IN {_in(X.SUSPICIOUS_PORTS)} THEN 'Suspicious Port' WHEN hour(timestamp) < 6 OR hour(timestamp) > 22 THEN 'Time Anomaly' ELSE 'Statistical Anomaly' END AS anomaly_subtype FROM c"""
ORACLE["q_dominant_type"] = f"""WITH {_SCORED}, x AS (SELECT row_id, score_volume / 1000 * 0.4::DOUBLE AS a, duration * 0.1::DOUBLE AS b, score_port * 1.0::DOUBLE AS c FROM s)
SELECT row_id, CASE WHEN a + b + c <= 0 THEN 'none' WHEN greatest(a, b, c) / (a + b + c) < 0.5 THEN 'mixed' WHEN a = greatest(a, b, c) THEN 'volume' WHEN b = greatest(a, b, c) THEN 'time' ELSE 'score_port' END AS dominant FROM x"""
ORACLE["q_sequence_statistics"] = f"""WITH {NET}, {_transitions('net', _STATE, 'src_ip', 'timestamp, row_id', 5)}
SELECT count(DISTINCT state)::BIGINT AS states, count(*)::BIGINT AS edges, count(*) FILTER (p > 0)::BIGINT AS likely, round(min(p) FILTER (p > 0), 6) AS least_p, round(avg(p) FILTER (p > 0), 6) AS mean_p FROM m"""
_EVENTS = ["click", "error", "purchase", "signup", "view"]
ORACLE["q_transition_heat_map"] = f"WITH {NET}, {_transitions('net', 'service', 'src_ip', 'timestamp, row_id', 5)} SELECT state, " + ", ".join(f"round(coalesce(max(p) FILTER (next_state = '{e}'), 0), 6) AS {e}" for e in _EVENTS) + f" FROM m WHERE state IN {_in(list(map(_q, _EVENTS)))} GROUP BY state"

ORACLE["q_profile_counts"] = f"WITH {NET} SELECT 'global' AS context, 3::BIGINT AS profiles UNION ALL SELECT 'protocol', 3 * count(DISTINCT protocol) FROM net"
ORACLE["q_port_profile_support"] = _profile("net", "dst_port::VARCHAR", _BASE).replace("HAVING count(*) >= 1", "HAVING count(*) >= greatest(10, (SELECT count(*) // 100 FROM net))")
ORACLE["q_profile_lookup"] = _profile("(SELECT * FROM net WHERE protocol = 'udp')", "protocol", ["bytes"])
ORACLE["q_threshold_lookup"] = f"""WITH {NET}, long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x FROM net" for f in ("bytes", "duration"))}),
s AS (SELECT feature, avg(x) AS m, greatest(avg(x) + 3 * stddev_samp(x), quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))) AS t FROM long GROUP BY feature)
SELECT feature, round(1.5 * CASE WHEN t < 1.2 * m THEN 1.5 * m ELSE t END, 6) AS threshold, false AS unbounded FROM s UNION ALL SELECT 'unknown', NULL, true"""
ORACLE["q_mean_scores"] = f"WITH {_SCORED} " + " UNION ALL ".join(f"SELECT 'score_{d}' AS detector, round(avg(score_{d}), 6) AS mean FROM s" for d in _W)
ORACLE["q_positions"] = f"""WITH {NET}, p AS (SELECT row_id, row_number() OVER (ORDER BY timestamp, row_id) - 1 AS i, count(*) OVER () AS n FROM net)
SELECT row_id, i::BIGINT AS "order", round(i / n, 6) AS order_normalized, strftime(TIMESTAMP '2023-01-01' + to_seconds(10 * i), '%Y-%m-%d %H:%M:%S') AS clock FROM p"""
ORACLE["q_inferred_types"] = f"""WITH {_SCORED} SELECT 'volume' AS type, count(*) FILTER (anomaly_volume = 1 AND bytes > (SELECT quantile_cont(bytes, 0.95) FROM s))::BIGINT AS n FROM s
UNION ALL SELECT 'port', count(*) FILTER (anomaly_volume = 1 AND dst_port IN {_in(X.SUSPICIOUS_PORTS)}) FROM s"""
ORACLE["q_best_f1"] = f"""WITH {_SCORED}, t AS ({' UNION ALL '.join(f'SELECT {p}::DOUBLE AS percentile, quantile_cont(score_duration, {p / 100}) AS threshold FROM s' for p in (70, 75, 80, 85, 90, 95))}),
c AS (SELECT percentile, threshold, {_CELLS % {'p': 'score_duration >= threshold'}} FROM t, (SELECT score_duration, is_anomaly AS y FROM s) GROUP BY ALL),
f AS (SELECT percentile, threshold, coalesce({_R['f1']}, 0) AS f1 FROM c) SELECT percentile, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f WHERE f1 > 0 ORDER BY f.f1 DESC, percentile LIMIT 1"""
ORACLE["q_metrics_and_auc"] = f"""WITH {TEXT}, s AS (SELECT ({_PS})::DOUBLE AS s, regexp_matches(query, '--|#|;')::INT AS y FROM txt), c AS (SELECT {_CELLS % {'p': 's >= 0.6'}} FROM s),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s WHERE y IS NOT NULL),
u AS (SELECT round(((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0))::DOUBLE, 6) AS auc FROM r)
SELECT tp, fp, tn, fn, {_rate('precision', 'recall', 'f1')}, auc FROM c, u"""
ORACLE["q_improvement"] = f"""WITH {_SCORED}, a AS (SELECT {_CELLS % {'p': 'anomaly_port = 1'}} FROM (SELECT *, is_anomaly AS y FROM s)), b AS (SELECT {_CELLS % {'p': 'anomaly_duration = 1'}} FROM (SELECT *, is_anomaly AS y FROM s)),
x AS (SELECT {', '.join(f'coalesce({_R[m]}, 0) AS {m}' for m in ('precision', 'recall', 'f1'))} FROM a), z AS (SELECT {', '.join(f'coalesce({_R[m]}, 0) AS {m}' for m in ('precision', 'recall', 'f1'))} FROM b)
SELECT {', '.join(f'round(100 * (z.{m} - x.{m}) / nullif(x.{m}, 0), 6) AS {m}' for m in ('precision', 'recall', 'f1'))} FROM x, z"""
ORACLE["q_rounded_vote"] = f"WITH {_SCORED} SELECT row_id, round((anomaly_volume + anomaly_duration + anomaly_port) / 3, 6) AS fused_score, (anomaly_volume + anomaly_duration + anomaly_port >= 2)::BIGINT AS fused_anomaly FROM s"
_F1S = ", ".join(f"coalesce(2.0::DOUBLE * count(*) FILTER (anomaly_{d} = 1 AND is_anomaly = 1) / nullif(2 * count(*) FILTER (anomaly_{d} = 1 AND is_anomaly = 1) + count(*) FILTER (anomaly_{d} = 1 AND is_anomaly = 0) + count(*) FILTER (anomaly_{d} = 0 AND is_anomaly = 1), 0), 0) AS f_{d}" for d in _W)
ORACLE["q_f1_vote"] = f"""WITH {_SCORED}, f AS (SELECT {_F1S} FROM s), v AS (SELECT row_id, ({' + '.join(f'anomaly_{d} * f_{d}' for d in _W)}) / CASE WHEN {' + '.join(f'f_{d}' for d in _W)} = 0 THEN 1 ELSE {' + '.join(f'f_{d}' for d in _W)} END AS x FROM s, f)
SELECT row_id, round(x, 6) AS fused_score, (x > 0.5)::BIGINT AS fused_anomaly FROM v"""
ORACLE["q_ensemble_types"] = f"""WITH {_SCORED}, v AS (SELECT *, bytes / (duration + 0.1) AS v FROM s), h AS (SELECT CASE WHEN count(*) <= 4 THEN max(score_volume) ELSE quantile_cont(score_volume, 0.75) END AS high FROM s WHERE anomaly_volume = 1)
SELECT row_id, CASE WHEN bytes > 1800 THEN 'SYN Flood' WHEN v > (SELECT quantile_cont(v, 0.99) FROM v) THEN 'Volume Anomaly' WHEN dst_port IN {_in(X.SUSPICIOUS_PORTS)} THEN 'Unusual Port' WHEN packets <= 3 AND duration < 0.5 THEN 'Port Scan'
  WHEN NOT (hour(timestamp) BETWEEN 8 AND 18 AND isodow(timestamp) < 6) THEN 'Unusual Time' WHEN anomaly_duration = 1 THEN 'Sequence Anomaly' WHEN anomaly_volume = 1 AND score_volume > high THEN 'Isolation Anomaly' ELSE 'Unknown Anomaly' END AS anomaly_type FROM v, h"""
ORACLE["q_improved_types"] = f"""WITH {NET}, c AS (SELECT *, count(*) OVER (PARTITION BY service, {_BUCKET % 21600}) AS n, bytes / (duration + 0.1) AS bps, packets / (duration + 0.1) AS pps FROM net),
x AS (SELECT *, coalesce(bytes / 4000, 0) AS a, duration / 10 AS b, packets / 20 AS m, CASE WHEN protocol = 'icmp' THEN 0.9 ELSE 0.1 END::DOUBLE AS g FROM c), k AS (SELECT avg(bps) AS mb, avg(pps) AS mp FROM c)
SELECT row_id, CASE WHEN greatest(a, b, m, g) / (a + b + m + g + 1e-10) < 0.3 THEN 'Mixed Anomaly' WHEN a = greatest(a, b, m, g) THEN CASE WHEN n > 20 AND bps > 5000 THEN 'High-Bandwidth DoS Attack' WHEN n > 20 THEN 'DoS Attack' WHEN packets <= 3 AND duration < 0.5 THEN 'Port Scan'
    WHEN bps > 3 * mb AND pps > 3 * mp THEN 'Traffic Burst' WHEN bps > 3 * mb THEN 'Volume Anomaly' WHEN dst_port IN {_in(X.SUSPICIOUS_PORTS)} THEN 'Suspicious Port' WHEN hour(timestamp) < 6 OR hour(timestamp) > 22 THEN 'After-Hours Activity' ELSE 'Statistical Anomaly' END
  WHEN b = greatest(a, b, m, g) THEN 'Contextual Anomaly' WHEN m = greatest(a, b, m, g) THEN 'Complex Anomaly' ELSE 'Collective Anomaly' END AS anomaly_type FROM x, k"""
_PAIRS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), n AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d QUALIFY r <= %d)"
ORACLE["q_nearest"] = f"WITH {_PAIRS % 5} SELECT i AS vec_id, (r - 1)::BIGINT AS rank, j AS other, round(d, 6) AS d FROM n"
_LOF = f"""{_PAIRS % 20}, k AS (SELECT i, max(d) AS kd FROM n GROUP BY i), l AS (SELECT n.i, 1 / (avg(greatest(n.d, k.kd)) + 1e-10) AS density FROM n JOIN k ON n.j = k.i GROUP BY n.i),
f AS (SELECT n.i AS vec_id, avg(o.density) / any_value(l.density) AS s FROM n JOIN l o ON n.j = o.i JOIN l ON n.i = l.i GROUP BY n.i)"""
ORACLE["q_local_outlier_factor"] = f"WITH {_LOF} SELECT vec_id, round(s, 6) AS anomaly_score FROM f"
ORACLE["q_factor_labels"] = f"WITH {_LOF} SELECT vec_id, round(s, 6) AS anomaly_score, (s > (SELECT quantile_cont(s, 0.95) FROM f))::BIGINT AS predicted_anomaly FROM f"
ORACLE["q_feature_pipeline"] = f"""WITH {NET}, c AS (SELECT *, count(*) OVER (PARTITION BY src_ip, {_BUCKET % 86400})::BIGINT AS connection_count FROM net)
  SELECT row_id, connection_count, (connection_count > (SELECT quantile_cont(connection_count, 0.95) FROM c))::BIGINT AS is_dos_like,
  CASE WHEN dst_port IN {_in(X.COMMON_PORTS)} THEN dst_port WHEN dst_port BETWEEN 1 AND 1023 THEN 1 WHEN dst_port BETWEEN 1 AND 49151 THEN 2 ELSE 3 END::BIGINT AS port_class, (packets <= 3 AND duration < 0.5)::BIGINT AS is_port_scan_like,
  round(bytes / (duration + 0.1), 6) AS bytes_per_second, {', '.join(f"round(coalesce(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 0), 6) AS scaled_{f}" for f in ("bytes", "duration"))} FROM c"""
_seq = f"""t0 AS (SELECT service || '_' || protocol AS state, lead(service || '_' || protocol) OVER (PARTITION BY src_ip ORDER BY timestamp, row_id) AS nx FROM net), t1 AS (SELECT state, nx, count(*) AS n FROM t0 WHERE nx IS NOT NULL GROUP BY ALL), m AS (SELECT *, CASE WHEN n >= 5 THEN n / sum(n) OVER (PARTITION BY state) ELSE 0 END AS p FROM t1)"""
ORACLE["q_ensemble"] = f"""WITH {NET}, c AS (SELECT *, count(*) OVER (PARTITION BY service, {_BUCKET % 21600}) AS connection_count FROM net),
f AS (SELECT *, bytes / (duration + 0.1) AS bytes_per_second, (connection_count * packets)::DOUBLE AS traffic_intensity, (flag = 'S0')::INT AS syn_flag, (protocol = 'icmp')::INT AS icmp_flag, (protocol = 'udp')::INT AS udp_flag FROM c),
l AS (SELECT {', '.join(f'quantile_cont({x}, 0.99) AS l_{x}' for x in _DOS)} FROM f), s0 AS (SELECT f.*, {' + '.join(f'CASE WHEN l_{x} > 0 THEN coalesce(greatest(0, {x} / l_{x} - 1), 0) ELSE 0 END' for x in _DOS)} AS raw FROM f, l),
{_seq}, y AS (SELECT s0.*, service || '_' || protocol AS st, lead(service || '_' || protocol) OVER (PARTITION BY src_ip ORDER BY timestamp, row_id) AS nx FROM s0),
z AS (SELECT y.*, CASE WHEN y.nx IS NULL THEN NULL WHEN p > 0 THEN -ln(p / (SELECT min(p) FROM m WHERE p > 0)) ELSE 10 END AS step FROM y LEFT JOIN m ON y.st = m.state AND y.nx = m.nx),
w AS (SELECT *, coalesce(avg(step) OVER (PARTITION BY src_ip ORDER BY timestamp, row_id ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), 0) AS q FROM z),
g AS (SELECT *, coalesce(raw / nullif(max(raw) OVER (), 0), 0) AS a, q / CASE WHEN max(q) OVER () > 0 THEN max(q) OVER () ELSE 1 END AS b, q >= (SELECT quantile_cont(q, 0.95) FROM w) AS steps FROM w),
h AS (SELECT *, {_mm('a')} / 2 + {_mm('b')} / 2 AS x, bytes / (duration + 0.1) AS v FROM g), i AS (SELECT *, x > (SELECT quantile_cont(x, 0.95) FROM h) AS hit FROM h)
SELECT row_id, round(x, 6) AS anomaly_score, hit::BIGINT AS predicted_anomaly, CASE WHEN NOT hit THEN 'Normal' WHEN a > 0 THEN CASE WHEN udp_flag = 1 THEN 'UDP Flood' WHEN icmp_flag = 1 THEN 'ICMP Flood' WHEN syn_flag = 1 THEN 'SYN Flood' ELSE 'Generic DoS' END
  WHEN v > (SELECT quantile_cont(v, 0.99) FROM h) THEN 'Volume Anomaly' WHEN dst_port IN {_in(X.SUSPICIOUS_PORTS)} THEN 'Unusual Port' WHEN packets <= 3 AND duration < 0.5 THEN 'Port Scan' WHEN NOT (hour(timestamp) BETWEEN 8 AND 18 AND isodow(timestamp) < 6) THEN 'Unusual Time'
  WHEN steps THEN 'Sequence Anomaly' ELSE 'Unknown Anomaly' END AS anomaly_type FROM i"""
_GRID = [(0.3, 0.4, 0.05), (0.4, 0.3, 0.1), (0.25, 0.25, 0.1), (0.3, 0.3, 0.1)]
ORACLE["q_detector_grid"] = f"""WITH {_SCORED}, z AS (SELECT is_anomaly AS y, {_mm('score_volume')} AS va, {_mm('score_duration')} AS vb, {_mm('score_port')} AS vc FROM s),
w AS (SELECT y, weights, vc * c + vb * b + va * a AS x FROM z, (VALUES {', '.join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_GRID))}) t(weights, a, b, c)),
f AS (SELECT y, weights, coalesce((x - min(x) OVER p) / nullif(max(x) OVER p - min(x) OVER p, 0), 0) AS x FROM w WINDOW p AS (PARTITION BY weights)),
l AS (SELECT weights, unnest([90.0::DOUBLE, 95, 99]) AS percentile, unnest(quantile_cont(x, [0.9, 0.95, 0.99])) AS t FROM f GROUP BY weights),
q AS (SELECT weights, percentile, cap, least(t, cap) AS threshold FROM l, (SELECT unnest([0.6::DOUBLE, 0.8]) AS cap)),
g AS (SELECT q.weights, percentile, cap, threshold, {_CELLS % {'p': 'x >= threshold'}} FROM f JOIN q ON f.weights = q.weights GROUP BY ALL)
SELECT weights::BIGINT AS weights, percentile, cap, round(threshold, 6) AS threshold, tp, fp, tn, fn, {_rate('f1')} FROM g"""
ORACLE["q_top_sequences"] = f"""WITH {NET}, o AS (SELECT row_number() OVER (ORDER BY timestamp, row_id) - 1 AS position, bytes AS score, service FROM net),
k AS (SELECT row_number() OVER (ORDER BY score DESC, position) AS rank, * FROM o WHERE score IS NOT NULL ORDER BY score DESC, position LIMIT 10),
s AS (SELECT k.rank, k.position, k.score, list(o.service ORDER BY o.position) AS st FROM k JOIN o ON o.position BETWEEN k.position - 5 AND k.position + 5 GROUP BY ALL),
t AS (SELECT *, array_to_string(CASE WHEN len(st) > 5 THEN [st[1], st[2], '...', st[len(st) - 1], st[len(st)]] ELSE st END, ' -> ') AS txt FROM s)
SELECT rank::BIGINT AS rank, position::BIGINT AS position, round(score, 6) AS score, CASE WHEN length(txt) > 30 THEN txt[1:27] || '...' ELSE txt END AS sequence, array_to_string(st, ' -> ') AS around, len(st)::BIGINT AS states FROM t"""
ORACLE["q_vector_noise"] = """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.0),
d AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 5), f AS (SELECT a FROM d UNION SELECT p.a FROM p JOIN d ON p.b = d.a)
SELECT vec_id, (vec_id NOT IN (SELECT a FROM f))::BIGINT AS noise FROM embeddings"""
