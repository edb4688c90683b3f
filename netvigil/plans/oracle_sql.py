"""DuckDB oracle SQL for each registered query.

Every statement reads the pre-registered parquet views (``events`` here) and
re-derives the flow tables with the same rules as ``sources.derived``, so the
check is end to end.  These strings are the independent second opinion: they
use set-based SQL (GROUP BY / joins / SQL windows) where the Spark side uses
array expressions or halo windows.
"""

from __future__ import annotations

from ..config import ATTACK_TYPES, DATASETS, KNOWN_CLASSES, detector_registry

FLOWS = """flows AS (SELECT event_id AS flow_id, ts AS "timestamp",
 concat('192.168.1.', CAST(user_id % 254 + 1 AS VARCHAR(10))) AS src_ip,
 concat('10.0.0.', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 254 + 1 AS VARCHAR(10))) AS dst_ip,
 CAST(1024 + (event_id * 7919) % 64511 AS INT) AS src_port,
 CAST(1 + (event_id * 104729) % 65535 AS INT) AS dst_port,
 CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
 CAST(64 + CAST(round(value * 100) AS BIGINT) % 1436 AS INT) AS packet_size,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 10.0 END AS flow_duration,
 (event_id * 31) % 10000 AS bytes_sent, (event_id * 37) % 10000 AS bytes_received,
 1 + (event_id * 41) % 99 AS packets_sent, 1 + (event_id * 43) % 99 AS packets_received,
 CASE event_type WHEN 'signup' THEN 'DoS' WHEN 'purchase' THEN 'DDoS' WHEN 'error' THEN 'Botnet' ELSE 'Benign' END AS label
FROM events)"""

CLUSTERS = "clusters AS (SELECT * FROM (VALUES " + ",\n".join(
    f"({o},{a},'{c}','{t}','{m}')" for (o, a, c, t, m) in detector_registry()
) + ") AS t(ordinal, attack_idx, cluster_id, attack_type, model_type))"

PREDS = """preds AS (WITH q AS (SELECT f.flow_id, f."timestamp" AS ts, k.ordinal, k.attack_idx, k.cluster_id, k.attack_type, k.model_type, g.attack_type AS target,
   f.flow_id % 8 AS s, (f.flow_id * 7919 + k.ordinal * 104729) % 1000 AS r, (f.flow_id * 7919 + k.ordinal * 104729) % 100 AS m
   FROM flows f CROSS JOIN clusters k JOIN clusters g ON g.ordinal = 2 * (f.flow_id % 9)),
 z AS (SELECT *, CASE WHEN s < 4 THEN attack_idx = flow_id % 9 WHEN s = 7 THEN flow_id % 16 <> 7 ELSE (flow_id + ordinal) % 11 <> 0 END AS is_trained,
   CASE WHEN s >= 4 AND (flow_id + ordinal) % 13 = 0 THEN 'boom' END AS error,
   CASE s WHEN 0 THEN 900 + m WHEN 1 THEN 800 + m WHEN 2 THEN 600 + 2 * m WHEN 3 THEN 50 + 5 * m WHEN 4 THEN 900 + m WHEN 5 THEN 100 + 5 * m WHEN 6 THEN r ELSE 600 + m END AS milli FROM q)
SELECT flow_id, ts, ordinal, cluster_id, attack_type, model_type, is_trained, error,
 CASE WHEN error IS NOT NULL THEN 'Error' WHEN NOT is_trained THEN 'Unknown'
  WHEN s = 5 THEN CASE WHEN r % 3 = 0 THEN attack_type ELSE 'Benign' END WHEN s = 6 THEN CASE WHEN r % 2 = 0 THEN attack_type ELSE 'Benign' END ELSE target END AS prediction,
 CASE WHEN error IS NOT NULL OR NOT is_trained THEN CAST(0 AS DOUBLE) ELSE CAST(milli AS DOUBLE) / 1000 END AS confidence,
 CAST(r % 500 AS DOUBLE) / 1000 AS prediction_time FROM z)"""

HOST_METRICS = """host_metrics AS (SELECT event_id AS sample_id, ts, concat('host', CAST(user_id % 5 AS VARCHAR(5))) AS host,
 CASE event_id % 3 WHEN 0 THEN 'cpu_usage' WHEN 1 THEN 'memory_usage' ELSE 'disk_usage' END AS metric,
 CAST(CAST(round(value * 100) AS BIGINT) % 10000 AS DOUBLE) / 100 AS value FROM events)"""

VALID = """v AS (SELECT * FROM preds WHERE coalesce(is_trained, false) AND coalesce(confidence, 0) > 0 AND error IS NULL)"""

WEIGHTS = """wts AS (SELECT * FROM (VALUES ('lstm', CAST(0.6 AS DOUBLE)), ('svm', CAST(0.4 AS DOUBLE))) AS t(model_type, weight))"""

KNOWN = ", ".join(f"'{c}'" for c in KNOWN_CLASSES)
ATTACKS = ", ".join(f"'{c}'" for c in ATTACK_TYPES)

CONFLICTS = """e1 AS (SELECT flow_id, attack_type, count(DISTINCT prediction) AS nd, max(confidence) AS mx FROM v GROUP BY flow_id, attack_type),
cf AS (SELECT flow_id, sum(CASE WHEN nd > 1 THEN 1 ELSE 0 END) AS n_class,
   CASE WHEN count(*) > 1 AND sum(CASE WHEN mx > 0.7 THEN 1 ELSE 0 END) > 1 THEN 1 ELSE 0 END AS n_type FROM e1 GROUP BY flow_id)"""


def severity_sql(attack: str, conf: str, n: str) -> str:
    base = (f"CASE WHEN {attack} = 'Benign' THEN 'Low' WHEN round({conf}, 6) >= 0.9 AND {n} = 0 THEN 'Critical' "
            f"WHEN round({conf}, 6) >= 0.8 THEN 'High' WHEN round({conf}, 6) >= 0.6 THEN 'Medium' ELSE 'Low' END")
    return (f"CASE WHEN {n} > 0 AND ({base}) = 'Low' THEN 'Medium' "
            f"WHEN {n} > 0 AND ({base}) = 'Medium' THEN 'High' ELSE ({base}) END")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def weights_cte(weights: dict) -> str:
    rows = ", ".join(f"('{k}', CAST({float(v)!r} AS DOUBLE))" for k, v in weights.items())
    return f"wts AS (SELECT * FROM (VALUES {rows}) AS t(model_type, weight))"


def weighted_decisions_sql(weights: dict | None = None) -> str:
    """Weighted-voting decision per flow (E4 + E1-E3 + P3 + P14 + P18)."""
    weights = weights or {"lstm": 0.6, "svm": 0.4}
    return with_(FLOWS, CLUSTERS, PREDS, VALID, weights_cte(weights), CONFLICTS, """vw AS (SELECT v.*, coalesce(w.weight, 0.5) AS weight,
   min(v.ordinal) OVER (PARTITION BY v.flow_id, v.model_type) AS grp
   FROM v LEFT JOIN wts w ON w.model_type = v.model_type)""",
        """tot AS (SELECT flow_id, sum(weight) AS tw FROM vw GROUP BY flow_id)""",
        """cs AS (SELECT flow_id, prediction, sum(weight * confidence) AS s, min(grp * 100000 + ordinal) AS pos FROM vw GROUP BY flow_id, prediction)""",
        """best AS (SELECT flow_id, prediction, score FROM (SELECT cs.flow_id, cs.prediction, round(cs.s / tot.tw, 9) AS score,
   row_number() OVER (PARTITION BY cs.flow_id ORDER BY round(cs.s / tot.tw, 9) DESC, cs.pos) AS rn
   FROM cs JOIN tot ON cs.flow_id = tot.flow_id) x WHERE rn = 1)""",
        decision_ctes("weighted_voting"))


def decision_ctes(method: str, extra: str = "") -> str:
    """dec/decisions CTEs on top of a ``best(flow_id, prediction, score)`` CTE."""
    return f"""dec AS (SELECT f.flow_id, f."timestamp" AS ts, f.src_ip, f.dst_ip, f.protocol, f.label,
   CASE WHEN b.prediction IS NULL THEN 'Unknown' WHEN b.prediction IN ({KNOWN}) THEN b.prediction ELSE 'Unknown' END AS attack_type,
   coalesce(b.prediction, 'Unknown') AS prediction, coalesce(b.score, 0.0) AS confidence,
   CASE WHEN b.prediction IS NULL THEN 'default' ELSE '{method}' END AS method,
   CASE WHEN b.prediction IS NULL THEN 0 ELSE coalesce(cf.n_class + cf.n_type, 0) END AS conflicts_detected{extra}
   FROM flows f LEFT JOIN best b ON b.flow_id = f.flow_id LEFT JOIN cf ON cf.flow_id = f.flow_id),
decisions AS (SELECT *, {severity_sql('attack_type', 'confidence', 'conflicts_detected')} AS severity FROM
   (SELECT * REPLACE (round(confidence, 6) AS confidence) FROM dec) d)"""


WEIGHTED_DECISIONS = weighted_decisions_sql()


ORACLE: dict[str, str] = {}

# Schema of the one base table the statements read (for type normalisation).
EVENTS_DDL = ("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, "
              "value DOUBLE, props VARCHAR)")
_INTEGERS = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"}


def register(key: str, sql: str) -> None:
    ORACLE[key] = sql


def normalized(sqls: dict) -> dict:
    """Wrap each statement so every integer column comes out as BIGINT (DuckDB
    sums give HUGEINT, Spark gives bigint).  Result types are found once by
    describing the statement against an empty ``events`` table."""
    import duckdb
    con = duckdb.connect()
    con.execute(EVENTS_DDL)
    out = {}
    for k, sql in sqls.items():
        try:
            rel = con.sql(sql)
            cols = [(c, str(t)) for c, t in zip(rel.columns, rel.types)]
        except Exception:  # noqa: BLE001 -- leave the statement as written
            out[k] = sql
            continue
        if not any(t in _INTEGERS and t != "BIGINT" for _, t in cols):
            out[k] = sql
            continue
        proj = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' if t in _INTEGERS else f'"{c}"' for c, t in cols)
        out[k] = f"SELECT {proj} FROM (\n{sql}\n) AS oracle_result"
    con.close()
    return out


register("e8_decision_summary", WEIGHTED_DECISIONS + """SELECT attack_type, severity, count(*) AS n_flows,
 sum(CASE WHEN conflicts_detected > 0 THEN 1 ELSE 0 END) AS n_conflict_flows,
 sum(CASE WHEN method = 'default' THEN 1 ELSE 0 END) AS n_default
FROM decisions GROUP BY attack_type, severity""")

register("e4_weighted_voting", WEIGHTED_DECISIONS +
         "SELECT flow_id, attack_type, prediction, confidence, severity, method, conflicts_detected FROM decisions")


# --- W: rolling features (DuckDB windows over the same order) ---------------

GW = 'WINDOW w AS (ORDER BY "timestamp", flow_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)'
KW = 'WINDOW w AS (PARTITION BY src_ip ORDER BY "timestamp", flow_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)'


def g(expr: str, x: str, digits: int | None = 6) -> str:
    inner = f"CASE WHEN count({x}) OVER w = 10 THEN {expr} END"
    return f"round({inner}, {digits}) + 0.0" if digits is not None else inner


PS_STATS = (f"{g('avg(packet_size) OVER w', 'packet_size')} AS packet_size_mean, "
            f"{g('stddev_samp(packet_size) OVER w', 'packet_size')} AS packet_size_std, "
            f"{g('min(packet_size) OVER w', 'packet_size', None)} AS packet_size_min, "
            f"{g('max(packet_size) OVER w', 'packet_size', None)} AS packet_size_max")

register("w1_packet_size_stats", with_(FLOWS) + f"SELECT flow_id, {PS_STATS} FROM flows {GW}")
register("w1_keyed_packet_size_stats", with_(FLOWS) + f"SELECT flow_id, {PS_STATS} FROM flows {KW}")
register("w0_keyed_halo_stats", with_(FLOWS) + f"""SELECT flow_id,
 {g('avg(packet_size) OVER w', 'packet_size')} AS packet_size_mean,
 {g('stddev_samp(packet_size) OVER w', 'packet_size')} AS packet_size_std,
 {g('count(DISTINCT dst_ip) OVER w', 'dst_ip', None)} AS unique_dst_ips FROM flows {KW}""")
register("w2_packet_size_median", with_(FLOWS) +
         f"SELECT flow_id, {g('median(packet_size) OVER w', 'packet_size')} AS packet_size_median FROM flows {GW}")
register("w3_flow_duration_stats", with_(FLOWS) + f"""SELECT flow_id,
 {g('avg(flow_duration) OVER w', 'flow_duration')} AS flow_duration_mean,
 {g('stddev_samp(flow_duration) OVER w', 'flow_duration')} AS flow_duration_std FROM flows {GW}""")
register("w4_distinct_counts", with_(FLOWS) + "SELECT flow_id, " + ", ".join(
    f"{g(f'count(DISTINCT {x}) OVER w', x, None)} AS {name}" for x, name in
    (("src_ip", "unique_src_ips"), ("dst_ip", "unique_dst_ips"), ("src_port", "unique_src_ports"),
     ("dst_port", "unique_dst_ports"))) + f" FROM flows {GW}")
register("w5_high_port_ratio", with_(FLOWS) + f"""SELECT flow_id,
 {g('avg(CASE WHEN dst_port > 1024 THEN 1.0 ELSE 0.0 END) OVER w', 'dst_port')} AS high_port_ratio FROM flows {GW}""")
DT = """dt AS (SELECT *, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (ORDER BY "timestamp", flow_id)) / 1e6 AS dt FROM flows)"""
register("w6_inter_arrival", with_(FLOWS, DT) + "SELECT flow_id, round(dt, 6) + 0.0 AS inter_arrival FROM dt")
register("w7_packet_rate", with_(FLOWS, DT) + f"""SELECT flow_id,
 {g('1 / nullif(avg(dt) OVER w, 0)', 'dt')} AS packet_rate,
 {g('1 / nullif(stddev_samp(dt) OVER w, 0)', 'dt')} AS packet_rate_std FROM dt {GW}""")
register("w10_ip_entropy", with_(FLOWS) + f"""SELECT flow_id,
 {g('entropy(src_ip) OVER w * ln(2)', 'src_ip')} AS src_ip_entropy,
 {g('entropy(dst_ip) OVER w * ln(2)', 'dst_ip')} AS dst_ip_entropy FROM flows {GW}""")
TIMEF = """tf AS (SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week FROM flows)"""
register("w11_time_entropy", with_(FLOWS, TIMEF) + f"""SELECT flow_id,
 {g('entropy(hour) OVER w * ln(2)', 'hour')} AS hour_entropy,
 {g('entropy(day_of_week) OVER w * ln(2)', 'day_of_week')} AS day_entropy FROM tf {GW}""")
register("w12_w13_burstiness_regularity", with_(FLOWS) + f"""SELECT flow_id,
 {g('stddev_samp(packet_size) OVER w / nullif(avg(packet_size) OVER w, 0)', 'packet_size')} AS traffic_burstiness,
 {g('1.0 / (1.0 + stddev_samp(packet_size) OVER w)', 'packet_size')} AS traffic_regularity FROM flows {GW}""")


def _corr_sql(a: str, b: str) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"
    r = (f"CASE WHEN stddev_pop({a}) OVER w * stddev_pop({b}) OVER w = 0 THEN NULL "
         f"ELSE covar_pop({a}, {b}) OVER w / (stddev_pop({a}) OVER w * stddev_pop({b}) OVER w) END")
    return f"round(CASE WHEN count({both}) OVER w = 10 THEN {r} END, 6) + 0.0 AS corr_{a}_{b}"


_CORR_COLS = ("src_port", "dst_port", "packet_size", "flow_duration", "hour", "day_of_week")
register("w14_rolling_correlation", with_(FLOWS, TIMEF) + "SELECT flow_id, " + ",\n ".join(
    _corr_sql(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]) + f" FROM tf {GW}")

SEQ = """sq AS (SELECT flow_id, label, row_number() OVER (ORDER BY "timestamp", flow_id) - 1 AS pos,
 array_to_string(list(CAST(packet_size AS VARCHAR)) OVER w, ',') AS sequence FROM flows {w})"""
register("w8_sequences", with_(FLOWS, SEQ.format(w=GW)) + "SELECT flow_id, label, sequence FROM sq WHERE pos >= 9")
register("w8_strided_sequences", with_(FLOWS, SEQ.format(w=GW)) +
         "SELECT flow_id, label, sequence FROM sq WHERE pos >= 9 AND (pos - 9) % 5 = 0")
register("w9_padded_sequences", with_(FLOWS) + f"""SELECT flow_id,
 array_to_string(list_concat(list_resize(CAST([] AS VARCHAR[]), 10 - least(count(*) OVER w, 10), '0'),
   list(CAST(packet_size AS VARCHAR)) OVER w), ',') AS sequence FROM flows {KW}""")

FAN = """fo AS (SELECT src_ip, count(DISTINCT dst_ip) AS fan_out FROM flows GROUP BY src_ip),
fi AS (SELECT dst_ip, count(DISTINCT src_ip) AS fan_in FROM flows GROUP BY dst_ip)"""
register("a1_fan_out", with_(FLOWS, FAN) + "SELECT src_ip, fan_out FROM fo")
register("a1_fan_in", with_(FLOWS, FAN) + "SELECT dst_ip, fan_in FROM fi")
register("j2_flow_fan", with_(FLOWS, FAN) + """SELECT f.flow_id, f.src_ip, f.dst_ip, fo.fan_out, fi.fan_in
 FROM flows f LEFT JOIN fo ON fo.src_ip = f.src_ip LEFT JOIN fi ON fi.dst_ip = f.dst_ip""")
register("w15_rolling_fan_out", with_(FLOWS, FAN) + """SELECT src_ip, fan_out,
 round(CASE WHEN count(fan_out) OVER w = 10 THEN avg(fan_out) OVER w END, 6) + 0.0 AS avg_fan_out
 FROM fo WINDOW w AS (ORDER BY src_ip ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
register("w15_rolling_fan_in", with_(FLOWS, FAN) + """SELECT dst_ip, fan_in,
 round(CASE WHEN count(fan_in) OVER w = 10 THEN avg(fan_in) OVER w END, 6) + 0.0 AS avg_fan_in
 FROM fi WINDOW w AS (ORDER BY dst_ip ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")


# --- E: ensemble variants ---------------------------------------------------------

ENS = with_(FLOWS, CLUSTERS, PREDS, VALID, CONFLICTS)
SUMMARY = """SELECT attack_type, severity, count(*) AS n_flows,
 sum(CASE WHEN conflicts_detected > 0 THEN 1 ELSE 0 END) AS n_conflict_flows,
 sum(CASE WHEN method = 'default' THEN 1 ELSE 0 END) AS n_default FROM decisions GROUP BY attack_type, severity"""
DEC_COLS = "flow_id, attack_type, prediction, confidence, severity, method, conflicts_detected"

register("e1_class_conflicts", ENS + "SELECT flow_id, attack_type, nd AS n_classes FROM e1 WHERE nd > 1")
register("e2_attack_type_conflicts", ENS + """SELECT flow_id, n_high AS n_high_types FROM (SELECT flow_id, count(*) AS nt,
 sum(CASE WHEN mx > 0.7 THEN 1 ELSE 0 END) AS n_high FROM e1 GROUP BY flow_id) x WHERE nt > 1 AND n_high > 1""")
register("e3_conflict_counts", ENS + """SELECT f.flow_id, coalesce(cf.n_class, 0) AS n_class_conflicts,
 coalesce(cf.n_type, 0) AS n_attack_type_conflicts, coalesce(cf.n_class + cf.n_type, 0) AS conflicts_detected
 FROM flows f LEFT JOIN cf ON cf.flow_id = f.flow_id""")
MAJORITY = with_(FLOWS, CLUSTERS, PREDS, VALID, CONFLICTS,
    "mv AS (SELECT flow_id, prediction, count(*) AS n, min(ordinal) AS pos FROM v GROUP BY flow_id, prediction)",
    "nv AS (SELECT flow_id, count(*) AS total FROM v GROUP BY flow_id)",
    """best AS (SELECT flow_id, prediction, score FROM (SELECT mv.flow_id, mv.prediction, CAST(mv.n AS DOUBLE) / nv.total AS score,
   row_number() OVER (PARTITION BY mv.flow_id ORDER BY mv.n DESC, mv.pos) AS rn FROM mv JOIN nv ON mv.flow_id = nv.flow_id) x WHERE rn = 1)""",
    decision_ctes("majority_voting"))
register("e5_majority_voting", MAJORITY + f"SELECT {DEC_COLS} FROM decisions")
HIGHEST = with_(FLOWS, CLUSTERS, PREDS, VALID, CONFLICTS,
    """best AS (SELECT flow_id, prediction, score, cluster_id FROM (SELECT flow_id, prediction, confidence AS score, cluster_id,
   row_number() OVER (PARTITION BY flow_id ORDER BY confidence DESC, ordinal) AS rn FROM v) x WHERE rn = 1)""",
    decision_ctes("highest_confidence", ", b.cluster_id AS best_cluster"))
register("e6_highest_confidence", HIGHEST + f"SELECT {DEC_COLS}, best_cluster FROM decisions")
register("e7_unknown_strategy_fallback", WEIGHTED_DECISIONS +
         "SELECT method, severity, count(*) AS n_flows FROM decisions GROUP BY method, severity")
register("j4_weight_lookup_default", weighted_decisions_sql({"lstm": 1.0}) + SUMMARY)
register("p19_weight_normalization", weighted_decisions_sql({"lstm": 0.6, "svm": 0.4}) + SUMMARY)
register("p16_vote_validity", with_(FLOWS, CLUSTERS, PREDS) + """SELECT cluster_id, count(*) AS n_votes,
 sum(CASE WHEN coalesce(is_trained, false) AND coalesce(confidence, 0) > 0 AND error IS NULL THEN 1 ELSE 0 END) AS n_valid
 FROM preds GROUP BY cluster_id""")
register("p17_detector_defaults", with_(FLOWS, CLUSTERS, PREDS) + """SELECT cluster_id,
 sum(CASE WHEN prediction = 'Unknown' THEN 1 ELSE 0 END) AS n_untrained_default,
 sum(CASE WHEN prediction = 'Error' THEN 1 ELSE 0 END) AS n_error_rows FROM preds GROUP BY cluster_id""")
register("p18_default_decisions", WEIGHTED_DECISIONS +
         "SELECT flow_id, attack_type, severity FROM decisions WHERE method = 'default'")
register("j3_flow_detector_pairs", with_(FLOWS, CLUSTERS, PREDS) + """SELECT cluster_id, count(*) AS n_rows,
 sum(CASE WHEN is_trained THEN 1 ELSE 0 END) AS n_trained, round(sum(confidence), 3) AS sum_confidence
 FROM preds GROUP BY cluster_id""")

# --- monitoring ---------------------------------------------------------------------

OKP = "ok AS (SELECT * FROM preds WHERE coalesce(is_trained, false) AND error IS NULL)"
MON = with_(FLOWS, CLUSTERS, PREDS, OKP)
A7 = """a7 AS (SELECT cluster_id, count(*) AS prediction_count, avg(prediction_time) AS avg_prediction_time,
 max(CASE WHEN rn = 1 THEN prediction_time END) AS last_prediction_time
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, flow_id DESC) AS rn FROM ok) x GROUP BY cluster_id)"""
register("a7_detector_status", with_(FLOWS, CLUSTERS, PREDS, OKP, A7) + """SELECT cluster_id, prediction_count,
 round(avg_prediction_time, 6) + 0.0 AS avg_prediction_time, round(last_prediction_time, 6) + 0.0 AS last_prediction_time FROM a7""")
register("a8_attack_distribution", WEIGHTED_DECISIONS + """SELECT CASE WHEN attack_type IN ('Benign', 'DoS', 'DDoS', 'Botnet', 'Brute_Force')
 THEN attack_type ELSE 'Other' END AS attack_type, count(*) AS n FROM decisions GROUP BY 1""")
register("a9_severity_distribution", WEIGHTED_DECISIONS + """, sev AS (SELECT * FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) t(severity))
SELECT sev.severity, count(d.flow_id) AS n FROM sev LEFT JOIN decisions d ON d.severity = sev.severity GROUP BY sev.severity""")
register("a10_prediction_counter", MON + f"""SELECT CASE WHEN prediction IN ({KNOWN}) THEN prediction ELSE 'Unknown' END AS attack_type,
 cluster_id, count(*) AS n FROM ok GROUP BY 1, 2""")
register("a10_conflict_counter", ENS + """SELECT 'class_conflict' AS conflict_type, count(*) AS n FROM e1 WHERE nd > 1
 UNION ALL SELECT 'attack_type_conflict', sum(n_type) FROM cf HAVING sum(n_type) > 0""")
_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
register("a11_duration_histogram", MON + ", b AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{b}', {b})" for b in _BOUNDS) + """, ('+Inf', 'Infinity'::DOUBLE)) t(le, bound))
SELECT ok.cluster_id, b.le, CAST(sum(CASE WHEN ok.prediction_time <= b.bound THEN 1 ELSE 0 END) AS BIGINT) AS cumulative_count
FROM ok JOIN b ON true GROUP BY ok.cluster_id, b.le""")
register("a12_ensemble_status", WEIGHTED_DECISIONS + f""", {OKP},
 pf AS (SELECT flow_id, sum(prediction_time) AS t FROM ok GROUP BY flow_id)
SELECT (SELECT count(*) FROM decisions) AS decision_count,
 (SELECT sum(CASE WHEN conflicts_detected > 0 THEN 1 ELSE 0 END) FROM decisions) AS conflict_count,
 (SELECT round(avg(t), 6) + 0.0 FROM pf) AS avg_scoring_time,
 (SELECT count(DISTINCT cluster_id) FROM preds) AS active_clusters,
 least(10, (SELECT sum(CASE WHEN conflicts_detected > 0 THEN 1 ELSE 0 END) FROM decisions)) AS recent_conflicts""")
HM = with_(HOST_METRICS)
register("a13_health_check", HM + """, lt AS (SELECT host, metric, value FROM (SELECT *, row_number() OVER
 (PARTITION BY host, metric ORDER BY ts DESC, sample_id DESC) AS rn FROM host_metrics) x WHERE rn = 1),
 p AS (SELECT host, max(CASE WHEN metric = 'cpu_usage' THEN value END) AS cpu_usage,
   max(CASE WHEN metric = 'memory_usage' THEN value END) AS memory_usage,
   max(CASE WHEN metric = 'disk_usage' THEN value END) AS disk_usage FROM lt GROUP BY host),
 q AS (SELECT *, concat_ws(',', CASE WHEN cpu_usage > 80 THEN 'cpu_usage' END, CASE WHEN memory_usage > 85 THEN 'memory_usage' END,
   CASE WHEN disk_usage > 90 THEN 'disk_usage' END) AS issues FROM p)
SELECT host, cpu_usage, memory_usage, disk_usage, CASE WHEN issues = '' THEN 'healthy' ELSE 'unhealthy' END AS status, issues FROM q""")
register("a14_threshold_alerts", HM + """SELECT sample_id, host, metric AS type, value,
 CASE metric WHEN 'cpu_usage' THEN 80.0 ELSE 85.0 END::DOUBLE AS threshold FROM host_metrics
 WHERE (metric = 'cpu_usage' AND value > 80) OR (metric = 'memory_usage' AND value > 85)""")
register("a15_system_status", with_(FLOWS, CLUSTERS, PREDS, OKP, A7) + """SELECT c.cluster_id, c.attack_type, c.model_type,
 coalesce((SELECT bool_or(coalesce(p.is_trained, false)) FROM preds p WHERE p.cluster_id = c.cluster_id), false) AS is_trained,
 coalesce(a7.prediction_count, 0) AS prediction_count, round(coalesce(a7.avg_prediction_time, 0.0), 6) + 0.0 AS avg_prediction_time
 FROM clusters c LEFT JOIN a7 ON a7.cluster_id = c.cluster_id""")
register("l1_recent_decisions", WEIGHTED_DECISIONS + f"""SELECT {DEC_COLS}, row_number() OVER (ORDER BY ts, flow_id) AS position
FROM (SELECT * FROM decisions ORDER BY ts DESC, flow_id DESC LIMIT 100)""")
register("l1_recent_conflicts", WEIGHTED_DECISIONS + """SELECT flow_id, conflicts_detected FROM decisions
 WHERE conflicts_detected > 0 ORDER BY ts DESC, flow_id DESC LIMIT 50""")
register("l2_threat_list", WEIGHTED_DECISIONS + f"""SELECT {DEC_COLS} FROM (SELECT * FROM decisions ORDER BY ts DESC, flow_id DESC LIMIT 100) r
 WHERE attack_type <> 'Benign' ORDER BY ts, flow_id LIMIT 20""")
register("l3_history_retention", WEIGHTED_DECISIONS + """SELECT flow_id, severity FROM decisions
 WHERE (SELECT count(*) FROM decisions) <= 1000 OR flow_id IN (SELECT flow_id FROM decisions ORDER BY ts DESC, flow_id DESC LIMIT 500)""")

# --- evaluation -------------------------------------------------------------------------

EVALP = """ev AS (SELECT p.flow_id, p.ordinal, p.cluster_id, p.attack_type, p.model_type,
 CASE WHEN f.label = p.attack_type THEN 1 ELSE 0 END AS y_true, CASE WHEN p.prediction = p.attack_type THEN 1 ELSE 0 END AS y_pred
 FROM preds p JOIN flows f ON f.flow_id = p.flow_id WHERE p.is_trained AND p.error IS NULL)"""
CM = """cm AS (SELECT ordinal, cluster_id, attack_type, model_type,
 sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
 sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp
 FROM ev GROUP BY ordinal, cluster_id, attack_type, model_type)"""


def _r(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


REP = f"""r0 AS (SELECT *, tn + fp AS support_0, fn + tp AS support_1, tn + fp + fn + tp AS test_samples,
 {_r('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {_r('tn', 'tn + fn')} AS precision_0, {_r('tn', 'tn + fp')} AS recall_0,
 {_r('tp', 'tp + fp')} AS precision_1, {_r('tp', 'tp + fn')} AS recall_1 FROM cm),
r1 AS (SELECT *, {_r('2 * precision_0 * recall_0', 'precision_0 + recall_0')} AS f1_0,
 {_r('2 * precision_1 * recall_1', 'precision_1 + recall_1')} AS f1_1 FROM r0),
report AS (SELECT *, (precision_0 + precision_1) / 2 AS precision, (recall_0 + recall_1) / 2 AS recall, (f1_0 + f1_1) / 2 AS f1_score,
 {_r('precision_0 * support_0 + precision_1 * support_1', 'test_samples')} AS weighted_precision,
 {_r('recall_0 * support_0 + recall_1 * support_1', 'test_samples')} AS weighted_recall,
 {_r('f1_0 * support_0 + f1_1 * support_1', 'test_samples')} AS weighted_f1,
 CASE WHEN support_0 > 0 AND support_1 > 0 THEN (recall_0 + recall_1) / 2 END AS roc_auc FROM r1)"""
EVAL = with_(FLOWS, CLUSTERS, PREDS, EVALP, CM, REP)


def rd(c: str) -> str:
    return f"round({c}, 6) + 0.0 AS {c}"


register("a2_confusion_matrix", with_(FLOWS, CLUSTERS, PREDS, EVALP, CM) + "SELECT cluster_id, tn, fp, fn, tp FROM cm")
register("a3_classification_report", EVAL + "SELECT cluster_id, " + ", ".join(rd(c) for c in (
    "accuracy", "precision_0", "recall_0", "f1_0")) + ", support_0, " + ", ".join(rd(c) for c in (
    "precision_1", "recall_1", "f1_1")) + ", support_1, " + ", ".join(rd(c) for c in (
    "precision", "recall", "f1_score", "weighted_precision", "weighted_recall", "weighted_f1")) + ", test_samples FROM report")
register("a4_roc_auc", EVAL + "SELECT cluster_id, round(roc_auc, 6) + 0.0 AS roc_auc FROM report")
_MEANS = ", ".join(f"round(avg({m}), 6) + 0.0 AS {m}" for m in ("accuracy", "precision", "recall", "f1_score"))
register("a6_grouped_means", EVAL + f"""SELECT CASE WHEN grouping(model_type) = 0 THEN 'model_type'
 WHEN grouping(attack_type) = 0 THEN 'attack_type' ELSE 'overall' END AS "grouping",
 coalesce(model_type, attack_type, 'all') AS group_value, {_MEANS}, count(*) AS n_detectors
 FROM report GROUP BY GROUPING SETS ((model_type), (attack_type), ())""")
register("a5_summary_means", EVAL + "SELECT " + ", ".join(
    f"round(avg({m}), 6) + 0.0 AS overall_{m}" for m in ("accuracy", "precision", "recall", "f1_score")) + " FROM report")
register("l4_best_detectors", EVAL + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{m}' AS metric, cluster_id, round({m}, 6) + 0.0 AS value FROM report
      ORDER BY {m} DESC, ordinal LIMIT 1)""" for m in ("accuracy", "precision", "recall", "f1_score")))


# --- preparation ----------------------------------------------------------------------

FL = with_(FLOWS)
NUMC = ("src_port", "dst_port", "packet_size", "flow_duration", "bytes_sent", "bytes_received",
        "packets_sent", "packets_received")
SCC = ("packet_size", "flow_duration", "bytes_sent", "src_port")
HK = "md5(concat(CAST(flow_id AS VARCHAR), '|42'))"
FILLED = "filled AS (SELECT * REPLACE (coalesce(flow_duration, 0) AS flow_duration) FROM flows)"

register("p1_numeric_columns", FL + "SELECT " + ", ".join(
    "round(flow_duration, 6) + 0.0 AS flow_duration" if c == "flow_duration" else c for c in ("flow_id",) + NUMC) + " FROM flows")
register("u1_p2_union_datasets", FL + """SELECT CASE WHEN protocol <> 'ICMP' THEN 'cic_ids_2018' ELSE 'bot_iot_2019' END AS dataset,
 label, count(*) AS n, count(CASE WHEN protocol <> 'ICMP' THEN bytes_sent END) AS n_with_bytes FROM flows GROUP BY 1, 2""")
register("p5_impute_zero", FL + "SELECT flow_id, round(coalesce(flow_duration, 0), 6) + 0.0 AS flow_duration FROM flows")
register("p6_timestamp_parse", FL + """SELECT flow_id, CAST(epoch(strptime(strftime("timestamp", '%Y-%m-%d %H:%M:%S'),
 '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS parsed_epoch FROM flows""")
register("p7_hour_day_of_week", FL + 'SELECT flow_id, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week FROM flows')
register("p8_protocol_onehot", FL + """SELECT flow_id, CAST(protocol = 'ICMP' AS INT) AS protocol_ICMP,
 CAST(protocol = 'TCP' AS INT) AS protocol_TCP, CAST(protocol = 'UDP' AS INT) AS protocol_UDP FROM flows""")
register("p9_high_port_indicator", FL + "SELECT flow_id, CAST(dst_port > 1024 AS INT) AS high_port FROM flows")
register("p10_ordinal_encoding", FL + """SELECT flow_id, dense_rank() OVER (ORDER BY src_ip) - 1 AS src_ip_code,
 dense_rank() OVER (ORDER BY dst_ip) - 1 AS dst_ip_code, dense_rank() OVER (ORDER BY protocol) - 1 AS protocol_code FROM flows""")
register("p11_label_encoding", FL + "SELECT flow_id, dense_rank() OVER (ORDER BY label) - 1 AS label_code FROM flows")
register("p12_minmax_scaling", FL + "SELECT flow_id, " + ", ".join(
    f"""round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END
     ELSE (CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) + 0.0 AS {c}""" for c in SCC) + " FROM flows")
register("p13_standard_scaling", FL + "SELECT flow_id, " + ", ".join(
    f"""round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END
     ELSE (CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 6) + 0.0 AS {c}""" for c in SCC) + " FROM flows")
register("x1_exact_sample", FL + f"SELECT flow_id, label FROM flows ORDER BY {HK}, flow_id LIMIT 1000")
TRAIN = with_(FLOWS, CLUSTERS,
    "det AS (SELECT DISTINCT attack_type FROM clusters WHERE attack_type IN (SELECT label FROM flows))",
    "cnt AS (SELECT label AS attack_type, count(*) AS n FROM flows GROUP BY label)",
    f"bh AS (SELECT flow_id, row_number() OVER (ORDER BY {HK}, flow_id) AS rk FROM flows WHERE label = 'Benign')",
    f"ah AS (SELECT flow_id, row_number() OVER (ORDER BY {HK}, flow_id) AS rk FROM flows WHERE label <> 'Benign')",
    """tset AS (SELECT d.attack_type, f.flow_id, 1 AS y FROM det d JOIN flows f ON f.label = d.attack_type
  UNION ALL SELECT d.attack_type, bh.flow_id, 0 FROM det d JOIN cnt c ON c.attack_type = d.attack_type
    JOIN bh ON bh.rk <= least(c.n, 10000) WHERE d.attack_type <> 'Benign'
  UNION ALL SELECT d.attack_type, ah.flow_id, 0 FROM det d JOIN cnt c ON c.attack_type = d.attack_type
    JOIN ah ON ah.rk <= least(c.n, 10000) WHERE d.attack_type = 'Benign')""")
register("x2_undersample_counts", TRAIN + """SELECT attack_type, CAST(sum(y) AS BIGINT) AS n_attack,
 CAST(sum(1 - y) AS BIGINT) AS n_benign FROM tset GROUP BY attack_type""")
register("x3_training_sets", TRAIN + "SELECT attack_type, flow_id, y FROM tset")
SPLIT = with_(FLOWS, f"""sp AS (SELECT flow_id, label, CASE WHEN rk <= round(n * 0.2) THEN 'test'
 WHEN rk <= round(n * 0.2) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM (SELECT flow_id, label,
 row_number() OVER (PARTITION BY label ORDER BY {HK}, flow_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM flows) r)""")
register("x4_stratified_split", SPLIT + "SELECT flow_id, label, split FROM sp")
register("x4_split_sizes", SPLIT + "SELECT label, split, count(*) AS n FROM sp GROUP BY label, split")
register("x4_hash_split", FL + f"""SELECT flow_id, label, CASE WHEN place < 0.2 THEN 'test' WHEN place < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split
 FROM (SELECT flow_id, label, CAST(CAST(concat('0x', substr({HK}, 1, 8)) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS place FROM flows) r""")
register("x5_correlations_with_gaps", with_(FLOWS, "gaps AS (SELECT * REPLACE (CASE WHEN flow_id % 5 <> 0 THEN packet_size END AS packet_size) FROM flows)") + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS r FROM gaps" for i, a in enumerate(NUMC) for b in NUMC[i + 1:]))
register("x6_contingency_scores", with_(FLOWS, FILLED, "l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({e} AS DOUBLE) AS v, label FROM filled" for c, e in [*((c, c) for c in NUMC), ("class_bytes", "bytes_sent % 100 + length(label) * 20")]) + ")",
    "k AS (SELECT feature, label, floor((rank() OVER (PARTITION BY feature ORDER BY v) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS bin FROM l)",
    "o AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY ALL)",
    "e AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bin) AS r, sum(n) OVER (PARTITION BY feature, label) AS c, sum(n) OVER (PARTITION BY feature) AS t FROM o)") +
    """SELECT feature, round(any_value(t) * (sum(n * n / (r * c)) - 1), 5) + 0.0 AS chi2, round(sum(n / t * ln(n * t / (r * c))), 5) + 0.0 AS mutual_info
 FROM e GROUP BY feature""")
register("a1_fan_sketches", with_(FLOWS, FAN) + "SELECT src_ip, fan_out, true AS within_5_percent FROM fo")
register("l3_history_by_date", FL + """SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, count(*) AS n FROM flows
 WHERE CAST("timestamp" AS DATE) >= (SELECT max(CAST("timestamp" AS DATE)) FROM flows) - 9 GROUP BY 1""")
register("x5_feature_correlations", with_(FLOWS, FILLED) + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) + 0.0 AS r FROM filled"
    for i, a in enumerate(NUMC) for b in NUMC[i + 1:]))
register("x6_anova_f", with_(FLOWS, FILLED, "st AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, label, count(*) AS n, avg(CAST({c} AS DOUBLE)) AS m, var_pop(CAST({c} AS DOUBLE)) AS v FROM filled GROUP BY label"
    for c in NUMC) + ")",
    "tot AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM st GROUP BY feature)",
    """fs AS (SELECT st.feature, round((sum(st.n * (st.m - tot.gm) ^ 2) / (tot.k - 1)) / nullif(sum(st.n * st.v) / (tot.nn - tot.k), 0), 4) AS f_score
   FROM st JOIN tot ON st.feature = tot.feature GROUP BY st.feature, tot.k, tot.nn)""") +
    """SELECT feature, f_score, row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS rank,
 row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) <= 50 AS selected FROM fs""")
register("j5_detectors_with_data", with_(FLOWS, CLUSTERS) +
         "SELECT DISTINCT attack_type FROM clusters WHERE attack_type IN (SELECT label FROM flows)")
register("j6_register_detectors", with_(FLOWS, CLUSTERS,
    """cand AS (SELECT DISTINCT label AS attack_type, m.model_type FROM flows, (VALUES ('lstm'), ('gbt')) m(model_type))""",
    """nw AS (SELECT c.attack_type, c.model_type FROM cand c WHERE NOT EXISTS (SELECT 1 FROM clusters k
   WHERE k.attack_type = c.attack_type AND k.model_type = c.model_type))""") +
    """SELECT ordinal, attack_idx, cluster_id, attack_type, model_type FROM clusters UNION ALL
SELECT CAST(17 + row_number() OVER (ORDER BY nw.attack_type, nw.model_type) AS INT) AS ordinal,
 CAST((SELECT max(attack_idx) FROM clusters k WHERE k.attack_type = nw.attack_type) AS INT) AS attack_idx,
 nw.attack_type || '_' || nw.model_type AS cluster_id, nw.attack_type, nw.model_type FROM nw""")


# --- sources and sinks --------------------------------------------------------------

register("s1_csv_scan", FL + """SELECT flow_id, epoch_us("timestamp") AS "timestamp", src_ip, dst_ip, src_port, dst_port, protocol,
 packet_size, round(flow_duration, 6) + 0.0 AS flow_duration, bytes_sent, bytes_received, packets_sent, packets_received, label FROM flows""")
register("s1_header_union", FL + """SELECT flow_id, epoch_us("timestamp") AS "timestamp", src_ip, dst_ip, src_port, dst_port, protocol,
 packet_size, CASE WHEN flow_id % 3 <> 2 THEN round(flow_duration, 6) END AS flow_duration, bytes_sent, bytes_received, packets_sent, packets_received,
 label, CASE WHEN flow_id % 3 = 2 THEN concat('s', CAST(flow_id % 7 AS VARCHAR)) END AS sensor FROM flows""")
register("s2_skipped_files", FL + """SELECT label, count(*) AS n FROM flows GROUP BY label
 UNION ALL SELECT * FROM (VALUES ('skipped zy-empty.csv', 1), ('skipped zz-broken.csv.gz', 1)) t(label, n)""")
register("s2_skip_unreadable_files", FL + "SELECT label, count(*) AS n FROM flows GROUP BY label")
register("s4_contract_check", FL + """SELECT flow_id, CASE WHEN protocol = 'ICMP' THEN 'quarantine' ELSE 'valid' END AS status FROM flows""")
register("s5_ingest_defaults", FL + """SELECT flow_id, protocol = 'UDP' AS defaulted, true AS has_timestamp, true AS has_request_id
 FROM flows WHERE protocol <> 'ICMP'""")
register("s6_batch_scoring_isolation", WEIGHTED_DECISIONS + """SELECT method, severity, count(*) AS n_flows FROM (
 SELECT CASE WHEN protocol = 'ICMP' THEN 'error' ELSE method END AS method,
        CASE WHEN protocol = 'ICMP' THEN 'High' ELSE severity END AS severity FROM decisions) x GROUP BY method, severity""")
register("s8_scaler_roundtrip", ORACLE["p12_minmax_scaling"])
register("s10_history_append", WEIGHTED_DECISIONS + """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, severity, count(*) AS n
 FROM decisions GROUP BY 1, 2""")


# --- streaming (batch twins) -------------------------------------------------------------

register("t1_stream_scoring", ORACLE["e8_decision_summary"])
register("t2_stream_rolling_state", with_(FLOWS) + f"""SELECT flow_id,
 {g('avg(packet_size) OVER w', 'packet_size')} AS packet_size_mean,
 {g('stddev_samp(packet_size) OVER w', 'packet_size')} AS packet_size_std FROM flows {KW}""")
register("t3_tumbling_counts", WEIGHTED_DECISIONS + """SELECT CAST(floor(epoch(ts) / 10) * 10 AS BIGINT) AS window_start,
 CAST(floor(epoch(ts) / 10) * 10 + 10 AS BIGINT) AS window_end, attack_type, severity, count(*) AS n
 FROM decisions GROUP BY 1, 2, 3, 4""")
_T3_WINDOW = """CAST(floor(epoch(f."timestamp") / 10) * 10 AS BIGINT) AS window_start, CAST(floor(epoch(f."timestamp") / 10) * 10 + 10 AS BIGINT) AS window_end"""
register("t3_conflict_counts", ENS + f"""SELECT {_T3_WINDOW}, 'class_conflict' AS conflict_type, count(*) AS n
 FROM e1 JOIN flows f ON f.flow_id = e1.flow_id WHERE nd > 1 GROUP BY 1, 2
UNION ALL SELECT {_T3_WINDOW}, 'attack_type_conflict', CAST(sum(n_type) AS BIGINT)
 FROM cf JOIN flows f ON f.flow_id = cf.flow_id GROUP BY 1, 2 HAVING sum(n_type) > 0""")
register("t4_sliding_windows", FL + """, s AS (SELECT CAST(floor(epoch("timestamp") / 5) * 5 AS BIGINT) AS b, protocol FROM flows)
SELECT window_start, window_start + 10 AS window_end, protocol, count(*) AS n FROM (
 SELECT b AS window_start, protocol FROM s UNION ALL SELECT b - 5 AS window_start, protocol FROM s) x
GROUP BY window_start, protocol""")
register("t5_health_windows", HM + """, l AS (SELECT host, metric, value, CAST(floor(epoch(ts) / 30) * 30 AS BIGINT) AS ws,
 row_number() OVER (PARTITION BY CAST(floor(epoch(ts) / 30) * 30 AS BIGINT), host, metric ORDER BY ts DESC, sample_id DESC) AS rn FROM host_metrics),
 p AS (SELECT ws, host, max(CASE WHEN metric = 'cpu_usage' AND rn = 1 THEN value END) AS cpu_usage,
   max(CASE WHEN metric = 'memory_usage' AND rn = 1 THEN value END) AS memory_usage,
   max(CASE WHEN metric = 'disk_usage' AND rn = 1 THEN value END) AS disk_usage FROM l GROUP BY ws, host),
 q AS (SELECT *, concat_ws(',', CASE WHEN cpu_usage > 80 THEN 'cpu_usage' END, CASE WHEN memory_usage > 85 THEN 'memory_usage' END,
   CASE WHEN disk_usage > 90 THEN 'disk_usage' END) AS issues FROM p)
SELECT ws AS window_start, ws + 30 AS window_end, host, cpu_usage, memory_usage, disk_usage,
 CASE WHEN issues = '' THEN 'healthy' ELSE 'unhealthy' END AS status, issues FROM q""")
register("t5_alerts", HM + """, l AS (SELECT host, metric, value, CAST(floor(epoch(ts) / 30) * 30 + 30 AS BIGINT) AS checked_at,
 row_number() OVER (PARTITION BY CAST(floor(epoch(ts) / 30) * 30 AS BIGINT), host, metric ORDER BY ts DESC, sample_id DESC) AS rn FROM host_metrics),
 c AS (SELECT host, metric AS type, checked_at, value, CAST(CASE metric WHEN 'cpu_usage' THEN 80 ELSE 85 END AS DOUBLE) AS threshold FROM l
  WHERE rn = 1 AND metric IN ('cpu_usage', 'memory_usage') AND checked_at * 1000 <= (SELECT epoch_ms(max(ts)) - 60000 FROM host_metrics)),
 u AS (SELECT *, value > threshold AS up, coalesce(lag(value > threshold) OVER (PARTITION BY host, type ORDER BY checked_at), false) AS was FROM c),
 e AS (SELECT *, sum(CASE WHEN up AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY host, type ORDER BY checked_at) AS episode FROM u),
 g AS (SELECT *, min(checked_at) OVER x AS opened_at, max(CASE WHEN up THEN value END) OVER x AS peak,
  CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER x AS BIGINT) AS n_checks FROM e
  WINDOW x AS (PARTITION BY host, type, episode ORDER BY checked_at))
SELECT host, type, CASE WHEN up THEN 'opened' ELSE 'closed' END AS event, checked_at, value, threshold, opened_at, peak, n_checks
FROM g WHERE up <> was""")
register("t6_running_stats", MON + """SELECT cluster_id, count(*) AS prediction_count,
 round(avg(prediction_time), 6) + 0.0 AS avg_prediction_time FROM ok GROUP BY cluster_id""")
register("t7_dedup_within_watermark", FL + "SELECT flow_id, protocol FROM flows")


# --- remaining inventory items ------------------------------------------------------

register("p3_attack_type_map", with_(FLOWS, CLUSTERS, PREDS) + f"""SELECT prediction,
 CASE WHEN prediction IN ({KNOWN}) THEN prediction ELSE 'Unknown' END AS attack_type, count(*) AS n FROM preds GROUP BY 1, 2""")
register("p20_decision_metadata", WEIGHTED_DECISIONS + """SELECT flow_id, severity, epoch_us(ts) AS meta_ts,
 src_ip AS meta_src_ip, dst_ip AS meta_dst_ip, protocol AS meta_protocol FROM decisions""")
register("a16_dataset_statistics", SPLIT + """SELECT label, count(*) AS n_samples,
 round(count(*) / (SELECT count(*) FROM flows), 6) AS share,
 sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS n_train, sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS n_val,
 sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS n_test FROM sp GROUP BY label""")
register("s7_json_results", EVAL + """SELECT cluster_id, round(accuracy, 6) + 0.0 AS accuracy, round(f1_score, 6) + 0.0 AS f1_score,
 test_samples, tp FROM report""")
_J1_SRC = """allf AS (SELECT tf.*, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (ORDER BY "timestamp", flow_id)) / 1e6 AS dt FROM tf)"""
_J1_COLS = [
    f"{g('avg(packet_size) OVER w', 'packet_size')} AS packet_size_mean",
    f"{g('stddev_samp(packet_size) OVER w', 'packet_size')} AS packet_size_std",
    f"{g('min(packet_size) OVER w', 'packet_size', None)} AS packet_size_min",
    f"{g('max(packet_size) OVER w', 'packet_size', None)} AS packet_size_max",
    f"{g('median(packet_size) OVER w', 'packet_size')} AS packet_size_median",
    f"{g('avg(flow_duration) OVER w', 'flow_duration')} AS flow_duration_mean",
    f"{g('stddev_samp(flow_duration) OVER w', 'flow_duration')} AS flow_duration_std",
    f"{g('count(DISTINCT src_ip) OVER w', 'src_ip', None)} AS unique_src_ips",
    f"{g('count(DISTINCT dst_ip) OVER w', 'dst_ip', None)} AS unique_dst_ips",
    f"{g('count(DISTINCT src_port) OVER w', 'src_port', None)} AS unique_src_ports",
    f"{g('count(DISTINCT dst_port) OVER w', 'dst_port', None)} AS unique_dst_ports",
    f"{g('avg(CASE WHEN dst_port > 1024 THEN 1.0 ELSE 0.0 END) OVER w', 'dst_port')} AS high_port_ratio",
    f"{g('1 / nullif(avg(dt) OVER w, 0)', 'dt')} AS packet_rate",
    f"{g('1 / nullif(stddev_samp(dt) OVER w, 0)', 'dt')} AS packet_rate_std",
    f"{g('entropy(src_ip) OVER w * ln(2)', 'src_ip')} AS src_ip_entropy",
    f"{g('entropy(dst_ip) OVER w * ln(2)', 'dst_ip')} AS dst_ip_entropy",
    f"{g('stddev_samp(packet_size) OVER w / nullif(avg(packet_size) OVER w, 0)', 'packet_size')} AS traffic_burstiness",
    f"{g('1.0 / (1.0 + stddev_samp(packet_size) OVER w)', 'packet_size')} AS traffic_regularity",
    f"{g('entropy(hour) OVER w * ln(2)', 'hour')} AS hour_entropy",
    f"{g('entropy(day_of_week) OVER w * ln(2)', 'day_of_week')} AS day_entropy",
] + [_corr_sql(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
register("j1_feature_row", with_(FLOWS, TIMEF, _J1_SRC) + "SELECT flow_id, " + ",\n ".join(_J1_COLS) + f" FROM allf {GW}")


# X5 greedy rule replayed in SQL: a recursive walk over the features in order;
# a feature still kept drops every later-checked feature it correlates with
# (|r| > 0.95, r <> 1.0) that is not dropped yet.
_X5_FEATS = ["packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max", "packet_size_median",
             "flow_duration_mean", "flow_duration_std", "unique_src_ips", "unique_dst_ips", "unique_src_ports",
             "unique_dst_ports", "high_port_ratio", "packet_rate", "packet_rate_std", "src_ip_entropy",
             "dst_ip_entropy", "traffic_burstiness", "traffic_regularity", "hour_entropy", "day_entropy"]
_X5_ROW = "fr AS (SELECT flow_id, " + ",\n ".join(_J1_COLS[:20]) + f" FROM allf {GW})"
_X5_LONG = "lg AS (" + " UNION ALL ".join(
    f"SELECT flow_id, {i} AS i, CAST(coalesce({f}, 0) AS DOUBLE) AS x FROM fr" for i, f in enumerate(_X5_FEATS, 1)) + ")"
_X5_PAIRS = """pairs AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS r
 FROM lg a JOIN lg b ON a.flow_id = b.flow_id AND a.i <> b.i GROUP BY a.i, b.i)"""
_X5_FEATS_CTE = "feats AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', {i})" for i, f in enumerate(_X5_FEATS, 1)) + ") t(feature, i))"
register("x5_selected_features", "WITH RECURSIVE " + ",\n".join([FLOWS, TIMEF, _J1_SRC, _X5_ROW, _X5_LONG, _X5_PAIRS,
    _X5_FEATS_CTE, """walk(step, dropped) AS (
  SELECT 0, CAST([] AS INTEGER[])
  UNION ALL
  SELECT w.step + 1,
    CASE WHEN list_contains(w.dropped, w.step + 1) THEN w.dropped
    ELSE list_concat(w.dropped, coalesce((SELECT list(p.j ORDER BY p.j) FROM pairs p
       WHERE p.i = w.step + 1 AND abs(p.r) > 0.95 AND abs(p.r - 1.0) > 1e-12 AND NOT list_contains(w.dropped, p.j)),
       CAST([] AS INTEGER[]))) END
  FROM walk w WHERE w.step < (SELECT count(*) FROM feats))"""]) + """
SELECT f.feature, NOT list_contains((SELECT dropped FROM walk ORDER BY step DESC LIMIT 1), f.i) AS kept FROM feats f""")

# The features that the walk keeps, each scaled to 0..1 over all flows, with the label's place among the sorted labels.
_S8_EXACT = ",\n ".join(c.removeprefix("round(").replace(", 6) + 0.0 AS", " AS") for c in _J1_COLS[:20])  # scaled before any rounding
register("s8_feature_pipeline", ORACLE["x5_selected_features"].replace(",\n ".join(_J1_COLS[:20]), _S8_EXACT).replace(
    "SELECT f.feature, NOT list_contains(", """SELECT lg.flow_id, code.c AS label_code, f.feature,
 round(CASE WHEN span.hi = span.lo THEN 0 ELSE (lg.x - span.lo) / (span.hi - span.lo) END, 4) AS value
FROM feats f JOIN lg ON lg.i = f.i JOIN flows fl ON fl.flow_id = lg.flow_id
JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS c FROM (SELECT DISTINCT label FROM flows)) code ON code.label = fl.label
JOIN (SELECT i, min(x) AS lo, max(x) AS hi FROM lg GROUP BY i) span ON span.i = f.i
WHERE NOT list_contains(""").replace(", f.i) AS kept FROM feats f", ", f.i)"))


# M3: which detectors train and on how many rows follows from X3 + X4 alone
# (statuses and sizes; the fitted weights themselves have no SQL twin).
register("m3_train_all_detectors", SPLIT + """, """ + CLUSTERS + """,
 c AS (SELECT label, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS te FROM sp GROUP BY label),
 side AS (SELECT sum(CASE WHEN label = 'Benign' THEN tr ELSE 0 END) AS b_tr, sum(CASE WHEN label <> 'Benign' THEN tr ELSE 0 END) AS a_tr,
   sum(CASE WHEN label = 'Benign' THEN te ELSE 0 END) AS b_te, sum(CASE WHEN label <> 'Benign' THEN te ELSE 0 END) AS a_te FROM c),
 sz AS (SELECT k.*, least(coalesce(c.tr, 0), 10000) AS pos, coalesce(c.te, 0) AS te,
   CASE WHEN k.attack_type = 'Benign' THEN a_tr ELSE b_tr END AS other_tr, CASE WHEN k.attack_type = 'Benign' THEN a_te ELSE b_te END AS other_te
   FROM clusters k CROSS JOIN side LEFT JOIN c ON c.label = k.attack_type)
SELECT ordinal, cluster_id, attack_type, model_type, CASE WHEN pos > 0 THEN 'trained' ELSE 'no_data' END AS status,
 CAST(pos + least(pos, other_tr) AS BIGINT) AS n_train,
 CAST(CASE WHEN pos > 0 THEN te + other_te ELSE 0 END AS BIGINT) AS n_test, CAST(NULL AS VARCHAR) AS error FROM sz""")

# --- conflict evidence, class scores, saved fits -------------------------------------------

_VT = "string_agg(concat(cluster_id, '=', printf('%.3f', confidence)), ',' ORDER BY ordinal)"
register("e1_conflict_detail", ENS + f"""SELECT v.flow_id, v.attack_type, v.prediction, {_VT} AS votes
 FROM v JOIN e1 ON e1.flow_id = v.flow_id AND e1.attack_type = v.attack_type WHERE e1.nd > 1 GROUP BY ALL""")
register("e2_conflict_detail", ENS + f""", hi AS (SELECT flow_id, count(*) AS k FROM e1 WHERE mx > 0.7 GROUP BY flow_id)
SELECT v.flow_id, v.attack_type, round(max(confidence), 6) AS confidence, {_VT} AS votes
 FROM v JOIN e1 ON e1.flow_id = v.flow_id AND e1.attack_type = v.attack_type JOIN hi ON hi.flow_id = v.flow_id
 WHERE e1.mx > 0.7 AND hi.k > 1 GROUP BY v.flow_id, v.attack_type""")
register("e4_class_scores", WEIGHTED_DECISIONS + """SELECT cs.flow_id, cs.prediction, round(round(cs.s / tot.tw, 9), 6) AS score
 FROM cs JOIN tot ON tot.flow_id = cs.flow_id""")
register("e5_class_votes", MAJORITY + "SELECT flow_id, prediction, n AS n_votes FROM mv")
register("a11_duration_summary", MON + """SELECT cluster_id, round(sum(prediction_time), 3) + 0.0 AS duration_sum,
 count(*) AS duration_count FROM ok GROUP BY cluster_id""")
register("p11_label_decoding", FL + "SELECT flow_id, dense_rank() OVER (ORDER BY label) - 1 AS label_code, label FROM flows")
register("s8_selection_roundtrip", (
    "WITH sel AS (" + ORACLE["x6_anova_f"] + "), " + FLOWS + ", " + FILLED + ", tot AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(sum(CAST({c} AS DOUBLE)), 3) AS total FROM filled" for c in NUMC) +
    ") SELECT sel.feature, sel.rank, tot.total FROM sel JOIN tot ON tot.feature = sel.feature WHERE sel.rank <= 5"))
register("s10_conflict_history", ENS + """, c AS (SELECT flow_id, 'class_conflict' AS type FROM e1 WHERE nd > 1
 UNION ALL SELECT flow_id, 'attack_type_conflict' FROM cf WHERE n_type = 1)
SELECT CAST(CAST(f."timestamp" AS DATE) AS VARCHAR) AS date, c.type, count(*) AS n FROM c JOIN flows f ON f.flow_id = c.flow_id GROUP BY 1, 2""")
register("s3_dataset_registry", FL + ", reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{d['label_column']}', '{t}')" for n, d in DATASETS.items() for t in d["attack_types"]) +
    """) t(name, label_column, label)), per AS (SELECT label, count(*) AS n FROM flows GROUP BY label)
SELECT name, label_column, count(*) AS n_attack_types, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows
 FROM reg LEFT JOIN per ON per.label = reg.label GROUP BY name, label_column""")
register("t2_stream_rolling_features", with_(FLOWS) + f"""SELECT flow_id,
 {g('CAST(min(packet_size) OVER w AS DOUBLE)', 'packet_size')} AS packet_size_min,
 {g('CAST(max(packet_size) OVER w AS DOUBLE)', 'packet_size')} AS packet_size_max,
 {g('median(packet_size) OVER w', 'packet_size')} AS packet_size_median,
 {g('avg(flow_duration) OVER w', 'flow_duration')} AS flow_duration_mean,
 {g('stddev_samp(flow_duration) OVER w', 'flow_duration')} AS flow_duration_std FROM flows {KW}""")
register("a16_dataset_summary", FL + f"""SELECT count(*) AS n_samples, {len(NUMC)} AS n_features,
 string_agg(DISTINCT label, ',' ORDER BY label) AS classes FROM flows""")
register("t2_stream_all_features", with_(FLOWS, TIMEF, _J1_SRC.replace("OVER (ORDER BY", "OVER (PARTITION BY src_ip ORDER BY")) +
         "SELECT flow_id, " + ",\n ".join(_J1_COLS) + f" FROM allf {KW}")
register("t1_stream_requests", FL + """SELECT flow_id, CASE WHEN protocol = 'ICMP' THEN 'quarantined' ELSE 'decided' END AS status,
 CASE WHEN protocol = 'ICMP' THEN 'invalid record: missing or malformed src_port, dst_port' END AS error FROM flows""")
register("s9_model_versions", "WITH m AS (" + ORACLE["m3_train_all_detectors"] + """), k AS (SELECT count(*) AS n FROM m WHERE status = 'trained')
SELECT v.version, k.n AS n_models, v.in_force FROM k, (VALUES (1, false), (2, true)) v(version, in_force)""")
