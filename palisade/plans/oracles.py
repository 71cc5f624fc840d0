"""The same results as plain SQL over the driver's tables, for the side-by-side check."""

from __future__ import annotations

from palisade import constants as C
from palisade.plans import adapters as A
from palisade.plans import fixed_forest, fixed_text

BASE = "TIMESTAMP '2026-01-01 00:00:00'"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n)})" for n in needles) + ")"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_payload = "CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN replace({_q(p)}, '<host>', CAST(user_id % 200 AS VARCHAR))"
    for i, p in enumerate(A.PAYLOADS)) + " END"

FRAMES = f"""frames AS (
  SELECT event_id AS seq, ts,
    CASE WHEN user_id % 5 = 0 THEN '0.0.0.0'
         ELSE '10.0.0.' || CAST(user_id % 250 AS VARCHAR) END AS src_ip,
    CASE event_type WHEN 'error' THEN 'HOST_LINUX' WHEN 'view' THEN 'HOST_WINDOWS'
      WHEN 'signup' THEN CASE event_id % 2 WHEN 1 THEN 'AUTH_WINDOWS' ELSE 'AUTH_LINUX' END
      WHEN 'click' THEN 'WEB_APP' ELSE 'L3_L4' END AS act,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst_pt,
    CAST(floor(value * 100) AS BIGINT) AS b_in, event_id % 1500 AS b_out,
    {_payload} AS payload,
    CASE WHEN value >= 100 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS base,
    CASE event_type WHEN 'error' THEN {_q(A.LINUX)} WHEN 'view' THEN {_q(A.WINDOWS)}
      WHEN 'signup' THEN CASE event_id % 2 WHEN 1 THEN {_q(A.LANL)} ELSE {_q(A.SSH)} END
      WHEN 'click' THEN {_q(A.APACHE)}
      WHEN 'purchase' THEN CASE event_id % 2 WHEN 1 THEN {_q(A.MONDAY)} ELSE {_q(A.FRIDAY)} END
      ELSE {_q(A.FRIDAY)} END AS dataset
  FROM events)"""

_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_RHOST = r"rhost=([0-9]{1,3}(?:-[0-9]{1,3}){3})"


def _resolved(given: str) -> str:
    return f"""CASE WHEN {given} NOT IN ('0.0.0.0', '') THEN {given}
      WHEN regexp_matches(payload, '{_IP}') THEN regexp_extract(payload, '{_IP}')
      WHEN regexp_matches(payload, '{_RHOST}')
        THEN replace(regexp_extract(payload, '{_RHOST}', 1), '-', '.')
      ELSE {given} END"""


_LAYER = f"""CASE WHEN contains(act, 'HOST') AND {_any('payload', C.WINDOWS_SIGNATURES)}
      THEN 'HOST_WIN'
    WHEN contains(act, 'HOST') AND {_any('payload', C.LINUX_SIGNATURES)} THEN 'HOST_LIN'
    ELSE act END"""


def _enriched(source: str = "frames") -> str:
    return f"""enriched AS (
  SELECT seq, ts, payload, base, {_resolved('src_ip')} AS src_ip, {_LAYER} AS tag
  FROM {source} WHERE NOT {_any('payload', C.WHITELIST)})"""


ENRICHED = _enriched()
SUMS = """sums AS (
  SELECT *,
    coalesce(sum(base) OVER (PARTITION BY src_ip ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS every,
    coalesce(sum(base) OVER (PARTITION BY src_ip, tag ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same
  FROM enriched)"""
BONUS = """bonused AS (
  SELECT *, CASE WHEN src_ip <> '0.0.0.0' AND (every > same OR same > 5)
    THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS bonus FROM sums)"""
FUSED = """fused AS (
  SELECT *, least(CAST(1.0 AS DOUBLE), base * CAST(CASE
      WHEN tag IN ('WEB_APP', 'AUTH_LINUX', 'AUTH_WINDOWS') THEN 1.5
      WHEN tag IN ('HOST_LIN', 'HOST_WIN') THEN 2.5 ELSE 1.0 END AS DOUBLE)
      / CAST(3.0 AS DOUBLE) + bonus) AS raw
  FROM bonused),
verdicts AS (
  SELECT seq, ts, src_ip, tag, base, round(raw, 2) AS score,
    raw >= CAST(0.6 AS DOUBLE) AS is_anomaly, substr(payload, 1, 50) AS payload
  FROM fused)"""
CHAIN = _with(FRAMES, ENRICHED, SUMS, BONUS, FUSED)
ALERTS = CHAIN + ", alerts AS (SELECT * FROM verdicts WHERE is_anomaly)\n"

RECENT = """timed AS (
  SELECT *, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) // 1000 AS "at"
  FROM enriched),
hits AS (
  SELECT f.seq, count(*) FILTER (WHERE h.tag <> f.tag) AS other,
    count(*) FILTER (WHERE h.tag = f.tag) AS same
  FROM timed f JOIN timed h ON h.src_ip = f.src_ip AND h.base > 0
    AND h."at" BETWEEN f."at" - 60 AND f."at" AND (h."at" < f."at" OR h.seq < f.seq)
  WHERE f.src_ip <> '0.0.0.0' GROUP BY f.seq),
bonused AS (
  SELECT t.*, CASE WHEN h.other > 0 OR h.same > 5 THEN CAST(0.3 AS DOUBLE)
    ELSE CAST(0.0 AS DOUBLE) END AS bonus
  FROM timed t LEFT JOIN hits h ON t.seq = h.seq)"""

_ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0
  THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END"""


def _synthetic(seq: str = "seq") -> str:
    return f"strftime({BASE} + to_seconds({seq}), '%Y-%m-%dT%H:%M:%SZ')"


FLOWS = """flows AS (
  SELECT o_orderkey AS seq, o_custkey % 65536 AS dst_pt,
    CAST(floor(o_totalprice) AS BIGINT) AS b_in, o_orderkey % 1500 AS b_out FROM orders)"""
SNAPSHOTS = """snaps AS (
  SELECT event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'OS' WHEN 'view' THEN 'NETWORK'
      ELSE 'APP' END AS source,
    CAST(user_id AS VARCHAR) AS u, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS s
  FROM events),
states AS (
  SELECT *, CASE source WHEN 'OS' THEN 'service_name=svc' || u || ';status=' || s
      WHEN 'NETWORK' THEN 'foreign_address=0.0.0.0:0;local_address=10.0.0.' || u || ';pid=' || u
        || ';protocol=TCP;state=' || s
      ELSE 'image_name=app.bin;mem_usage=' || s || ';pid=' || u END AS state,
    CASE source WHEN 'OS' THEN 'OS:svc' || u
      WHEN 'NETWORK' THEN 'NET:10.0.0.' || u || '-' || u
      ELSE 'APP:app.bin-' || u END AS uid
  FROM snaps)"""
_TS_TEXT = """rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"""
LINES = """raw_lines AS (
  SELECT event_id AS seq, ts, event_id % 9 AS n,
    CASE event_type WHEN 'error' THEN 'OS' WHEN 'view' THEN 'NETWORK' ELSE 'APP' END AS source,
    CAST(user_id AS VARCHAR) AS u, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS v
  FROM events),
bodies AS (
  SELECT *, CASE source WHEN 'OS' THEN 'svc' || u || '   running'
    WHEN 'NETWORK' THEN '  TCP  10.0.0.' || u || ':22' || chr(9) || '0.0.0.0:0 LISTEN ' || u
    ELSE 'app' || u || '.bin ' || u || ' Console 1 ' || v || 'K up' END AS body
  FROM raw_lines),
lines AS (
  SELECT seq, source, CASE n
    WHEN 0 THEN '--- [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] NETWORK DUMP ---'
    WHEN 1 THEN 'Proto  Local Address  State' WHEN 2 THEN '   ' WHEN 3 THEN 'lone' || u
    WHEN 4 THEN body || '  user ' || u || '   title' ELSE body END AS line
  FROM bodies),
records AS (
  SELECT * FROM lines
  WHERE NOT <garbage> AND regexp_replace(line, '\\s+', '', 'g') <> '')""".replace(
    "<garbage>", _any("line", C.GARBAGE_MARKERS))
LABELS = """judged AS (
  SELECT CASE doc_id % 6 WHEN 0 THEN 'L3_L4' WHEN 1 THEN 'WEB_APP' WHEN 2 THEN 'AUTH_LINUX'
      WHEN 3 THEN 'AUTH_WINDOWS' WHEN 4 THEN 'HOST_LIN' ELSE 'HOST_WIN' END AS tag,
    1 - quality AS truth, toxic AS pred FROM labels)"""

_CELLS = """count(*) FILTER (WHERE truth = 0 AND pred = 0) AS tn,
  count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn,
  count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp"""
_MEASURES = """tn, fp, fn, tp,
  round(coalesce((tn + tp) / CAST(nullif(tn + fp + fn + tp, 0) AS DOUBLE), 0), 9) AS accuracy,
  round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 9) AS precision,
  round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 9) AS recall,
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 9) AS f1"""
_SPECIALIST = """CASE tag WHEN 'HOST_LINUX' THEN 'HOST_LIN' WHEN 'HOST_WINDOWS' THEN 'HOST_WIN'
  ELSE tag END"""


def _truth(payload: str = "payload") -> str:
    return f"""CASE WHEN contains(act, 'L3_L4')
      THEN CASE WHEN contains(upper({payload}), 'BENIGN') THEN 0 ELSE 1 END
    WHEN contains(dataset, 'DDos') OR contains(lower(dataset), 'attack') THEN 1
    WHEN {_any(payload, C.TRUTH_SIGNATURES)} THEN 1 ELSE 0 END"""


def _injected(datasets: list[str]) -> str:
    rows = []
    for name in datasets:
        for part, ip, act, payload in C.INJECTED_ATTACKS:
            if part in name:
                rows.append(f"({_q(name)}, {_q(ip)}, {_q(payload)}, {_q(act)})")
                break
    return f"""injected AS (
  SELECT dataset, src_ip, payload, act, (SELECT max(seq) + 1 FROM frames) + i AS seq
  FROM (VALUES {', '.join(rows)}) AS t(dataset, src_ip, payload, act),
    range({C.INJECTED_PER_DATASET}) AS r(i))"""


EVENT_DATASETS = [name for name, _, _ in C.DATASETS]
_ORDINAL = "CASE dataset " + " ".join(
    f"WHEN {_q(n)} THEN {i}" for i, n in enumerate(EVENT_DATASETS)) + " END"
SAMPLED = """sampled AS (
  SELECT * FROM frames QUALIFY row_number() OVER (
    PARTITION BY dataset ORDER BY md5('42:' || CAST(seq AS VARCHAR)), seq) <= 500)"""
EVALUATION = _with(
    FRAMES, SAMPLED, _injected(EVENT_DATASETS),
    f"""mixed AS (
  SELECT dataset, src_ip, payload, act, seq, base FROM sampled
  UNION ALL SELECT dataset, src_ip, payload, act, seq, CAST(1.0 AS DOUBLE) FROM injected),
ordered AS (
  SELECT dataset, src_ip, payload, act, base, {_ORDINAL} * 1099511627776 + row_number() OVER (
      PARTITION BY dataset ORDER BY md5('42:' || CAST(seq AS VARCHAR)), seq) - 1 AS seq,
    {BASE} AS ts FROM mixed)""",
    _enriched("ordered"), SUMS, BONUS, FUSED)


def _draw(layer: str, slot: str) -> str:
    return (f"CAST('0x' || substr(md5('42:{layer}:{slot}:' || CAST(r AS VARCHAR)), 1, 8) "
            "AS BIGINT)")


def _baseline(layer: str) -> str:
    rounds, templates, ranges, choices = C.BASELINES[layer]
    slots = {}
    for slot, (low, high) in ranges.items():
        number = f"({low} + {_draw(layer, slot)} % {high - low + 1})"
        slots[slot] = (f"'0x' || lower(to_hex({number}))" if slot in C.HEX_SLOTS.get(layer, ())
                       else f"CAST({number} AS VARCHAR)")
    for slot, options in choices.items():
        slots[slot] = (f"CASE {_draw(layer, slot)} % {len(options)} " + " ".join(
            f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END")
    lines = []
    for template in templates:
        line = _q(template)
        for slot, value in slots.items():
            if "{" + slot + "}" in template:
                line = f"replace({line}, '{{{slot}}}', {value})"
        lines.append(f"SELECT {line} AS payload FROM range({rounds}) AS t(r)")
    return " UNION ALL ".join(lines)


def _shifted(items: str, n: int, glue: str) -> str:
    """All runs of n neighbours; the ones that reach past the end are null and left out."""
    if n == 1:
        return items
    columns = ", ".join([items] + [f"{items}[{k + 1}:]" for k in range(1, n)])
    joined = f" || '{glue}' || ".join(f"z[{k + 1}]" for k in range(n))
    return f"list_transform(list_zip({columns}), lambda z: {joined})"


def _grams(items: str, shortest: int, longest: int, glue: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT seq, unnest({_shifted(items, n, glue)}) AS term FROM split_docs"
        for n in range(shortest, longest + 1))
    return f"grams AS (SELECT * FROM ({parts}) WHERE term IS NOT NULL)"


def _char_grams(docs: str, shortest: int, longest: int) -> str:
    return f"""split_docs AS (
  SELECT seq, string_split(regexp_replace(lower(payload), '[\\s\\x0B\\x{{A0}}]{{2,}}', ' ', 'g'),
    '') AS chars FROM ({docs})),
{_grams('chars', shortest, longest, '')}"""


def _word_grams(docs: str, shortest: int, longest: int) -> str:
    return f"""split_docs AS (
  SELECT seq, regexp_extract_all(lower(payload), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS words
  FROM ({docs})),
{_grams('words', shortest, longest, ' ')}"""


_STATS = """stats AS (
  SELECT term, CAST(count(*) AS BIGINT) AS tf, count(DISTINCT seq) AS df
  FROM grams GROUP BY term)"""
DOCS = "SELECT doc_id AS seq, text AS payload FROM documents"
PAGES = "SELECT page_id AS seq, 'GET ' || url AS payload FROM pages"


def _tfidf(grams: str, table: str) -> str:
    return f"""WITH {grams}, {_STATS},
vocab AS (SELECT * FROM stats ORDER BY tf DESC, term LIMIT 3000),
counts AS (SELECT seq, term, count(*) AS n FROM grams GROUP BY seq, term),
raw AS (
  SELECT c.seq, c.term, c.n * (ln((1.0 + (SELECT count(*) FROM {table})) / (1.0 + v.df)) + 1.0) AS w
  FROM counts c JOIN vocab v ON c.term = v.term)
SELECT seq, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY seq)), 6) AS weight FROM raw"""


def _quartiles(name: str) -> str:
    q = [f"quantile_cont(CAST({name} AS DOUBLE), {p})" for p in (0.25, 0.5, 0.75)]
    return (f"SELECT '{name}' AS feature, {q[0]} AS q1, {q[1]} AS center, {q[2]} AS q3, "
            f"CASE WHEN {q[2]} = {q[0]} THEN CAST(1.0 AS DOUBLE) ELSE {q[2]} - {q[0]} END "
            "AS scale FROM volume")


def _scaled(name: str) -> str:
    q = [f"(SELECT quantile_cont(CAST({name} AS DOUBLE), {p}) FROM flows)"
         for p in (0.25, 0.5, 0.75)]
    return (f"round((CAST({name} AS DOUBLE) - {q[1]}) / coalesce(nullif({q[2]} - {q[0]}, 0), 1), "
            f"9) AS {name}_scaled")


_WORDS = r"regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+')"
_CSV_PAYLOAD = "CASE WHEN seq % 97 = 0 THEN 'nan' ELSE payload END"

SQL: dict[str, str] = {
    # fusion
    "fusion_alerts": CHAIN + "SELECT * FROM verdicts",
    "fusion_windowed": CHAIN + "SELECT * FROM verdicts",
    "fusion_alerts_60s": _with(FRAMES, ENRICHED, RECENT, FUSED) + "SELECT * FROM verdicts",
    "correlate_60s": _with(FRAMES, ENRICHED, RECENT)
    + "SELECT seq, src_ip, tag, \"at\", bonus FROM bonused",
    "correlate_join": CHAIN + "SELECT seq, src_ip, tag, bonus FROM bonused",
    "cross_layer": CHAIN + "SELECT seq, src_ip, tag, src_ip <> '0.0.0.0' AND every > same "
    "AS cross_layer FROM sums",
    "freq_escalation": CHAIN + "SELECT seq, src_ip, tag, src_ip <> '0.0.0.0' AND same > 5 "
    "AS repeated FROM sums",
    "ledger": CHAIN + "SELECT * FROM verdicts WHERE base > 0",
    "alerts": ALERTS + "SELECT * FROM alerts",
    "export_alerts": ALERTS + f"SELECT {_ISO} AS ts, src_ip, tag, score, is_anomaly, "
    "'`Structural Anomaly`' AS forensics, payload FROM alerts",
    # scans and sinks
    "scan_flow_csv": _with(FLOWS) + """SELECT CAST(dst_pt AS VARCHAR) AS dst_pt,
  CAST(b_out AS VARCHAR) AS b_out, CAST(b_in AS VARCHAR) AS b_in,
  CASE WHEN seq % 50 = 0 THEN 'DDoS' ELSE 'BENIGN' END AS label, 'flows' AS dataset, seq
  FROM flows""",
    "scan_log_csv": _with(FRAMES) + f"""SELECT seq,
  strftime(ts, '%b ') || CAST(day(ts) AS VARCHAR) || strftime(ts, ' %H:%M:%S') AS ts,
  'E' || CAST(seq % 20 AS VARCHAR) AS evt_id, 'HOST_LINUX' AS act, {_CSV_PAYLOAD} AS payload
  FROM frames""",
    "scan_bz2_lines": _with(FRAMES) + f"""SELECT {_synthetic()} AS ts, '0.0.0.0' AS src_ip,
  payload, 'AUTH_WINDOWS' AS act, seq FROM frames""",
    "head_rows": _with(FRAMES) + "SELECT seq, payload FROM frames WHERE seq < 2000",
    "scan_frames": _with(FRAMES) + f"""SELECT {_ISO} AS ts, src_ip, dst_pt,
  CAST(seq % 7 AS VARCHAR) AS evt_id, act, b_in, b_out, payload FROM frames""",
    "frame_sink": _with(FRAMES) + "SELECT dataset, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs "
    "FROM frames GROUP BY dataset",
    "scan_snapshots": _with(SNAPSHOTS) + f"""SELECT {_TS_TEXT} AS timestamp, source, state
  FROM states WHERE seq % 11 <> 0""",
    "route_datasets": _with(FRAMES, FLOWS, f"""routed AS (
  SELECT 'Monday-WorkingHours.pcap_ISCX' AS dataset, 'L3_L4' AS act, seq,
    CASE WHEN seq % 50 = 0 THEN 'DDoS' ELSE 'BENIGN' END AS payload FROM flows
  UNION ALL SELECT 'Linux_2k.log_structured', 'HOST_LINUX', seq, {_CSV_PAYLOAD} FROM frames
  UNION ALL SELECT 'LANL_WLS_2k', 'AUTH_WINDOWS', seq, payload FROM frames)""")
    + """SELECT dataset, act, count(*) AS n, min(seq) AS first, max(seq) AS last,
  CAST(sum(length(payload)) AS BIGINT) AS chars FROM routed GROUP BY dataset, act""",
    "route_by_model": CHAIN + f"""SELECT seq, tag, {_SPECIALIST} AS model_tag FROM enriched
  WHERE tag <> 'AUTH_LINUX'""",
    "row_index": _with(FRAMES) + "SELECT seq, payload FROM frames",
    # projections
    "normalize_flow": _with(FLOWS) + f"""SELECT {_synthetic()} AS ts, '0.0.0.0' AS src_ip,
  '0.0.0.0' AS dst_ip, CAST(0 AS BIGINT) AS src_pt, dst_pt, 'NA' AS proto, '1000' AS evt_id,
  'L3_L4' AS act, b_in, b_out, CASE WHEN seq % 50 = 0 THEN 'DDoS' WHEN seq % 51 = 0 THEN 'nan'
  ELSE 'BENIGN' END AS payload, 'flows' AS dataset, seq FROM flows WHERE seq % 53 <> 0""",
    "synthetic_ts": f"SELECT event_id AS seq, {_synthetic('event_id')} AS ts FROM events",
    "normalize_log": _with(FRAMES) + f"""SELECT strftime(ts, '%H:%M:%S') AS ts,
  '0.0.0.0' AS src_ip, '0.0.0.0' AS dst_ip, CAST(0 AS BIGINT) AS src_pt,
  CAST(0 AS BIGINT) AS dst_pt, 'NA' AS proto, '0' AS evt_id, 'WEB_APP' AS act,
  CAST(0 AS BIGINT) AS b_in, CAST(0 AS BIGINT) AS b_out, {_CSV_PAYLOAD} AS payload,
  'web' AS dataset, seq FROM frames""",
    "log_timestamp": _with("""parts AS (
  SELECT event_id AS seq, strftime(ts, '%b') AS month, CAST(day(ts) AS VARCHAR) AS date,
    strftime(ts, '%a') AS day, CASE WHEN event_id % 31 = 0 THEN 'nan'
      ELSE strftime(ts, '%H:%M:%S') END AS time FROM events)""")
    + """SELECT seq, 0 AS variant, month || ' ' || date || ' ' || time AS ts FROM parts
  UNION ALL SELECT seq, 1, date || ' ' || day || ' ' || time FROM parts
  UNION ALL SELECT seq, 2, date || 'T' || time || 'Z' FROM parts
  UNION ALL SELECT seq, 3, time FROM parts
  UNION ALL SELECT seq, 4, '1970-01-01T00:00:00Z' FROM parts""",
    "normalize_auth_line": _with(FRAMES) + f"""SELECT {_synthetic()} AS ts,
  '0.0.0.0' AS src_ip, payload, 'AUTH_WINDOWS' AS act, 'wls' AS dataset, seq FROM frames""",
    "parse_ts": f"""SELECT event_id AS seq, CASE event_id % 8 WHEN 0 THEN ts
  WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts)
  WHEN 3 THEN date_trunc('minute', ts) ELSE {BASE} END AS ts FROM events""",
    "extract_ip": f"""WITH docs AS (SELECT doc_id AS seq, text AS payload, CASE
    WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 10 = 0 THEN '8.8.8.8' ELSE '0.0.0.0' END AS given
  FROM documents) SELECT seq, {_resolved('given')} AS src_ip FROM docs""",
    "detect_os": _with(FRAMES) + f"SELECT seq, act, {_LAYER} AS tag FROM frames",
    "model_tag": _with(FRAMES) + "SELECT seq, act, "
    + _SPECIALIST.replace("tag", "act") + " AS model_tag FROM frames",
    "alert_projection": "SELECT doc_id AS seq, substr(text, 1, 50) AS payload FROM documents",
    "evidence_fallback": _with(FRAMES) + """SELECT seq, '`' || CASE
  WHEN act = 'L3_L4' AND seq % 5 = 1 THEN 'Structural Anomaly (Explainer Not Found)'
  WHEN act = 'L3_L4' AND seq % 5 = 2 THEN 'Structural Anomaly (SHAP Error: bad shape)'
  WHEN act = 'L3_L4' AND seq % 5 = 0 AND -((b_in % 200) / 100.0) < -0.5
    THEN 'b_in: ' || CAST(b_in AS VARCHAR) || ' (SHAP: -'
      || printf('%.2f', CAST((b_in % 200) / 100.0 AS DOUBLE)) || ')'
  WHEN act = 'L3_L4' THEN 'High-Entropy Volumetric Flow Detected'
  WHEN seq % 5 = 3 THEN 'Structural Anomaly (XAI Timeout)'
  ELSE 'Structural Anomaly' END || '`' AS evidence FROM frames""",
    "evidence_text": """SELECT doc_id AS seq, array_to_string(list_transform(
  string_split(text, chr(10)), lambda e: '`' || e || '`'), ' ') AS evidence FROM documents""",
    "parse_snapshot_line": _with(LINES) + f""", words AS (
  SELECT seq, source, {_WORDS} AS w FROM records)
SELECT seq, source, CASE source
  WHEN 'OS' THEN CASE WHEN len(w) > 2 THEN 'extra_info=' || array_to_string(w[3:], ' ') || ';'
    ELSE '' END || 'service_name=' || w[1] || ';status=' || w[2]
  WHEN 'NETWORK' THEN CASE WHEN len(w) > 5 THEN 'extra_info=' || array_to_string(w[6:], ' ')
    || ';' ELSE '' END || 'foreign_address=' || w[3] || ';local_address=' || w[2] || ';pid='
    || w[5] || ';protocol=' || w[1] || ';state=' || w[4]
  ELSE CASE WHEN len(w) > 6 THEN 'extra_info=' || array_to_string(w[7:], ' ') || ';'
    ELSE '' END || 'image_name=' || w[1] || ';mem_usage=' || w[5] || ';pid=' || w[2]
    || ';session_name=' || w[3] || ';session_num=' || w[4] || ';status=' || w[6] END AS state
FROM words WHERE len(w) >= CASE source WHEN 'OS' THEN 2 WHEN 'NETWORK' THEN 5 ELSE 6 END""",
    "snapshot_header": "SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') "
    "|| '] NETWORK DUMP' AS header FROM events WHERE event_id % 9 = 0",
    "entity_id": _with(SNAPSHOTS) + """SELECT seq, CASE WHEN seq % 7 = 0
  THEN 'GENERIC:' || md5(state) ELSE uid END AS uid FROM states""",
    "severity": ALERTS + "SELECT seq, score, CASE WHEN score > CAST(0.7 AS DOUBLE) THEN 'high' "
    "ELSE 'medium' END AS severity FROM alerts",
    "anomaly_proba": """SELECT event_id AS seq,
  round(1 - 1 / (1 + exp(-((value - 50) / 25))), 9) AS p_anomaly,
  round(1 / (1 + exp(-((value - 50) / 25))), 9) AS p_normal FROM events""",
    "ground_truth": _with(FRAMES, """labelled AS (SELECT * REPLACE (
  CASE WHEN act = 'L3_L4' AND seq % 3 = 0 THEN 'Benign' ELSE payload END AS payload)
  FROM frames)""") + f"SELECT seq, {_truth()} AS truth FROM labelled",
    # filters
    "whitelist_filter": _with(FRAMES)
    + f"SELECT seq, payload FROM frames WHERE NOT {_any('payload', C.WHITELIST)}",
    "clean_baseline": _with(FRAMES)
    + f"SELECT seq, payload FROM frames WHERE NOT {_any('payload', C.SSH_ATTACK_SIGNATURES)}",
    "garbage_filter": _with(LINES) + "SELECT seq, line FROM records",
    "row_range_scan": _with(FRAMES) + """SELECT seq, dataset FROM frames
  WHERE NOT contains(dataset, 'Friday-WorkingHours-Afternoon-DDos')
    OR seq < 10 OR (seq >= 1884 AND seq < 1904)""",
    # reports
    "alerts_by_tag": ALERTS + "SELECT * FROM alerts WHERE tag = 'HOST_LIN'",
    "alert_kpis": ALERTS + """SELECT count(*) AS total, count(DISTINCT src_ip) AS sources,
  count(*) FILTER (WHERE contains(tag, 'AUTH')) AS auth,
  count(*) FILTER (WHERE score >= CAST(0.8 AS DOUBLE)) AS critical FROM alerts""",
    "alerts_per_tag": ALERTS + "SELECT tag, count(*) AS n FROM alerts GROUP BY tag",
    "top_ips": ALERTS + "SELECT src_ip, count(*) AS n FROM alerts GROUP BY src_ip "
    "ORDER BY n DESC, src_ip LIMIT 5",
    "alert_feed": ALERTS + """SELECT *, CASE WHEN score > CAST(0.7 AS DOUBLE) THEN 'high'
  ELSE 'medium' END AS severity FROM alerts ORDER BY ts DESC, seq LIMIT 100""",
    "distinct_tags": ALERTS + "SELECT DISTINCT tag FROM alerts",
    "run_totals": ALERTS + "SELECT (SELECT count(*) FROM events) AS scanned, "
    "(SELECT count(*) FROM alerts) AS raised",
    # evaluation
    "confusion": _with(LABELS) + f"SELECT tag, {_CELLS} FROM judged GROUP BY tag",
    "classification_metrics": _with(LABELS, f"cells AS (SELECT tag, {_CELLS} FROM judged "
                                    "GROUP BY tag)") + f"SELECT tag, {_MEASURES} FROM cells",
    "specialist_metrics": _with(FRAMES, f"""judged AS (SELECT {_SPECIALIST} AS tag, truth, pred
  FROM (SELECT {_LAYER} AS tag, {_truth()} AS truth,
    CASE WHEN base > 0 THEN 1 ELSE 0 END AS pred FROM frames))""",
                                f"cells AS (SELECT tag, {_CELLS} FROM judged GROUP BY tag)")
    + f"SELECT tag, {_MEASURES} FROM cells",
    "fusion_metrics": CHAIN + f""", judged AS (SELECT {_truth('f.payload')} AS truth,
  CASE WHEN v.is_anomaly THEN 1 ELSE 0 END AS pred
  FROM frames f LEFT JOIN verdicts v ON f.seq = v.seq), cells AS (SELECT {_CELLS} FROM judged)
SELECT {_MEASURES} FROM cells""",
    "evaluation_run": EVALUATION + f""", judged AS (
  SELECT {_SPECIALIST} AS tag, truth, pred FROM (SELECT {_LAYER} AS tag, {_truth()} AS truth,
    CASE WHEN base > 0 THEN 1 ELSE 0 END AS pred FROM ordered)
  UNION ALL SELECT 'FUSION', {_truth('f.payload')}, CASE WHEN v.is_anomaly THEN 1 ELSE 0 END
  FROM ordered f LEFT JOIN verdicts v ON f.seq = v.seq),
cells AS (SELECT tag, {_CELLS} FROM judged GROUP BY tag)
SELECT tag, {_MEASURES} FROM cells""",
    # snapshots
    "state_changes": _with(SNAPSHOTS) + """SELECT seq, uid, state FROM (SELECT *, lag(state)
  OVER (PARTITION BY uid ORDER BY seq) AS old FROM states) WHERE state IS DISTINCT FROM old""",
    "distinct_states": _with(SNAPSHOTS)
    + "SELECT min(seq) AS seq, uid, state FROM states GROUP BY uid, state",
    "last_states": _with(SNAPSHOTS) + """SELECT uid, state FROM (
  SELECT min(seq) AS seq, uid, state FROM states GROUP BY uid, state)
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq DESC) = 1""",
    # order, samples, sets
    "sample_per_dataset": _with(FRAMES, SAMPLED) + "SELECT seq, dataset FROM sampled",
    "shuffle_seq": _with(FRAMES) + """SELECT seq AS event_id, dataset, row_number() OVER (
  PARTITION BY dataset ORDER BY md5('42:' || CAST(seq AS VARCHAR)), seq) - 1 AS seq
  FROM frames""",
    "insert_at": _with(FLOWS) + """SELECT CASE WHEN seq >= 5 THEN seq + 1 ELSE seq END AS seq,
  dst_pt, b_in, b_out FROM flows UNION ALL SELECT 5, 4444, 15000000, 0""",
    "dataset_order": _with(FRAMES) + f"SELECT seq AS event_id, dataset, {_ORDINAL} "
    "* 1099511627776 + seq AS seq FROM frames",
    "inject_threats": _with(FRAMES, _injected(EVENT_DATASETS)) + """
SELECT dataset, src_ip, payload, act, seq, CAST(NULL AS VARCHAR) AS ts FROM frames
UNION ALL SELECT dataset, src_ip, payload, act, seq, '2026-04-30T12:00:00Z' FROM injected""",
    "augment_web": f"SELECT payload FROM ({PAGES}) UNION ALL {_baseline('WEB_APP')}",
    "augment_ssh": _with(FRAMES) + f"""SELECT payload FROM frames WHERE act = 'AUTH_LINUX'
  AND NOT {_any('payload', C.SSH_ATTACK_SIGNATURES)} UNION ALL {_baseline('AUTH_LINUX')}""",
    "augment_linux": _with(FRAMES) + "SELECT payload FROM frames WHERE act = 'HOST_LINUX' "
    f"UNION ALL {_baseline('HOST_LIN')}",
    "augment_windows": _with(FRAMES) + "SELECT payload FROM frames WHERE act = 'HOST_WINDOWS' "
    f"UNION ALL {_baseline('HOST_WIN')}",
    # features
    "robust_stats": """WITH volume AS (SELECT l_suppkey AS dst_pt,
  CAST(floor(l_extendedprice) AS BIGINT) AS b_in, CAST(floor(l_quantity * 100) AS BIGINT) AS b_out
  FROM lineitem) """ + " UNION ALL ".join(_quartiles(n) for n in C.FLOW_FEATURES),
    "robust_scale": _with(FLOWS) + "SELECT seq, "
    + ", ".join(_scaled(n) for n in C.FLOW_FEATURES) + " FROM flows",
    "score_threshold": """SELECT l_returnflag AS name,
  quantile_cont(l_extendedprice, 0.007) AS at_contamination,
  quantile_cont(l_extendedprice, 0.01) AS at_nu FROM lineitem GROUP BY l_returnflag""",
    "term_stats": f"WITH {_char_grams(DOCS, 3, 5)}, {_STATS} SELECT * FROM stats",
    "top_terms": f"WITH {_char_grams(DOCS, 3, 6)}, {_STATS} "
    "SELECT * FROM stats ORDER BY tf DESC, term LIMIT 3000",
    "char_tfidf": _tfidf(_char_grams(PAGES, 3, 5), "pages"),
    "word_tfidf": _tfidf(_word_grams(DOCS, 1, 3), "documents"),
}

# streams must give what the batch form gives
SQL["stream_state_changes"] = SQL["state_changes"]
SQL["stream_fusion"] = SQL["ledger"]
SQL["stream_fusion_60s"] = SQL["fusion_alerts_60s"] + " WHERE base > 0"
SQL["stream_normalize"] = (
    "WITH parsed AS (" + SQL["parse_snapshot_line"] + ") "
    "SELECT source, state, count(*) AS n FROM parsed GROUP BY source, state")
SQL["stream_tail"] = (
    "WITH parsed AS (" + SQL["parse_snapshot_line"] + "), "
    "top AS (SELECT max(event_id) AS last FROM events) "
    "SELECT source, state, count(*) AS n FROM parsed, top "
    "WHERE seq * 4 // (last + 1) >= 1 GROUP BY source, state")
SQL["stream_append"] = (
    "WITH parsed AS (" + SQL["parse_snapshot_line"] + ") SELECT seq, source, state FROM parsed")
SQL["stream_push"] = _with(FRAMES) + f""", arrived AS (SELECT base, row_number() OVER (ORDER BY
  list_position({[name for name, _, _ in C.DATASETS]}, dataset), seq) - 1 AS place FROM frames)
SELECT place // {C.PUSH_FRAMES} AS push, count(*) AS frames,
  (count(*) FILTER (WHERE base > 0)) AS suspicious FROM arrived GROUP BY 1"""
SQL["stream_seeded_changes"] = _with(SNAPSHOTS) + """, cut AS (
  SELECT max(seq) // 2 AS border FROM states),
firsts AS (
  SELECT min(seq) AS seq, uid, state FROM states, cut WHERE seq < border GROUP BY uid, state),
seed AS (SELECT uid, state AS known FROM firsts
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq DESC) = 1)
SELECT seq, uid, state FROM (
  SELECT s.seq, s.uid, s.state, d.known,
    lag(s.state) OVER (PARTITION BY s.uid ORDER BY s.seq) AS old
  FROM (SELECT states.* FROM states, cut WHERE seq >= border) s LEFT JOIN seed d ON s.uid = d.uid)
WHERE state IS DISTINCT FROM coalesce(old, known)"""

SQL["forest_fixed"] = fixed_forest.sql(FLOWS) + (
    "SELECT seq, round(score, 9) AS score, prediction FROM explained")
_SHAP = ", ".join(f"round(shap{i}, 9) AS shap{i}" for i in range(3))
SQL["shapley_fixed"] = fixed_forest.sql(FLOWS) + (
    f"SELECT seq, {_SHAP}, round(expected, 9) AS expected FROM explained WHERE prediction = -1")
SQL["first_anomaly"] = fixed_forest.sql(FLOWS) + (
    f"SELECT seq, dst_pt, b_in, b_out, round(score, 9) AS score, {_SHAP} FROM explained "
    "WHERE prediction = -1 ORDER BY seq LIMIT 1")


def _modelled(frames: str, before: str) -> str:
    """``rescored``: the rows of ``frames`` with the verdicts of the given models as ``base``."""
    layered = f"""layered AS (SELECT *, {_SPECIALIST} AS model FROM (
  SELECT *, {_LAYER} AS tag FROM {frames})),
flows AS (SELECT seq, coalesce(dst_pt, 0) AS dst_pt, coalesce(b_in, 0) AS b_in,
  coalesce(b_out, 0) AS b_out FROM layered WHERE model = 'L3_L4')"""
    return fixed_forest.sql(f"{before},\n{layered}").rstrip() + ",\n" + fixed_text.sql(
        "SELECT model AS tag, payload AS line FROM layered WHERE model <> 'L3_L4'") + f""",
rescored AS (SELECT l.* EXCLUDE (tag, model), l.tag AS layer, l.model, d.decision,
    CASE WHEN d.decision < -1e-6 OR e.prediction = -1 THEN CAST(1.0 AS DOUBLE)
      ELSE CAST(0.0 AS DOUBLE) END AS base
  FROM layered l LEFT JOIN decided d ON d.tag = l.model AND d.line = l.payload
  LEFT JOIN explained e ON e.seq = l.seq)"""


_PLAIN = FRAMES + ", plain AS (SELECT * EXCLUDE (base) FROM frames)"
_RECONSTRUCTED = _modelled("plain", _PLAIN)
SQL["ocsvm_fixed"] = _RECONSTRUCTED + f"""
SELECT seq, layer AS tag, model AS model_tag, round(decision, 9) AS decision,
  CASE WHEN decision < -1e-6 THEN -1 ELSE 1 END AS prediction,
  round(1 - 1 / (1 + exp(-decision)), 9) AS chance
FROM rescored WHERE model <> 'L3_L4' AND NOT {_any('payload', C.WHITELIST)}"""
SQL["reconstruction_fixed"] = _RECONSTRUCTED + ",\n" + ",\n".join(
    [_enriched("rescored"), SUMS, BONUS, FUSED]) + "SELECT * FROM verdicts"
SQL["evaluation_fixed"] = _modelled("ordered", ",\n".join([
    FRAMES, SAMPLED, _injected(EVENT_DATASETS), f"""mixed AS (
  SELECT dataset, src_ip, payload, act, seq, dst_pt, b_in, b_out FROM sampled
  UNION ALL SELECT dataset, src_ip, payload, act, seq, NULL, NULL, NULL FROM injected),
ordered AS (
  SELECT dataset, src_ip, payload, act, dst_pt, b_in, b_out,
    {_ORDINAL} * 1099511627776 + row_number() OVER (
      PARTITION BY dataset ORDER BY md5('42:' || CAST(seq AS VARCHAR)), seq) - 1 AS seq,
    {BASE} AS ts FROM mixed)"""])) + ",\n" + ",\n".join(
        [_enriched("rescored"), SUMS, BONUS, FUSED]) + f""", judged AS (
  SELECT model AS tag, {_truth()} AS truth, CASE WHEN base > 0 THEN 1 ELSE 0 END AS pred
  FROM rescored
  UNION ALL SELECT 'FUSION', {_truth('f.payload')}, CASE WHEN v.is_anomaly THEN 1 ELSE 0 END
  FROM rescored f LEFT JOIN verdicts v ON f.seq = v.seq),
cells AS (SELECT tag, {_CELLS} FROM judged GROUP BY tag)
SELECT tag, {_MEASURES} FROM cells"""
