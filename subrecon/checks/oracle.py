"""DuckDB SQL equivalents of the catalog queries, for the correctness gate.

Written independently of the Spark code: every report is computed here
the plain way (materialise the joins, then count), while the Spark side
counts from per-key aggregates. Only ``lineitem`` and ``part`` are needed;
the stand-in input tables are rebuilt as CTEs with the same arithmetic as
``subrecon.sources.fixtures``.
"""

from __future__ import annotations


def _g(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 13, '0')"


_KEYS = f"""CAST(l_orderkey AS VARCHAR) AS order_no,
    {_g('l_partkey')} AS ordered_upc,
    {_g('l_partkey + 1 + l_suppkey % 3')} AS picked_upc"""
_ST = "lpad(CAST(l_orderkey % 50 AS VARCHAR), 5, '0')"

# Stand-in inputs (raw), then the scoped versions the analysis starts from.
FIXTURES = f"""
li AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
substitution_events AS (
  SELECT {_KEYS}, {_ST} AS store_code, l_quantity / 50 AS attempted_utilization,
         CAST(l_shipdate AS DATE) AS event_date
  FROM li WHERE l_returnflag IN ('A', 'R')),
response_events AS (
  SELECT {_KEYS}, {_ST} AS store_code,
         CASE WHEN q % 4 = 0 THEN 'Reject' ELSE 'Accept' END AS status,
         CASE WHEN q = 50 THEN CAST(NULL AS BIGINT) WHEN q % 7 = 0 THEN CAST(540 AS BIGINT)
              ELSE CAST(1 + l_suppkey % 20 AS BIGINT) END AS division,
         CAST(l_shipdate AS DATE) AS event_date
  FROM li WHERE q % 3 <> 0 AND (l_returnflag IN ('A', 'R') OR q % 10 = 1)),
partner_raw AS (
  SELECT {_KEYS}, l_linenumber <= 4 AS has_sub, CAST(l_shipdate AS DATE) AS event_date
  FROM li WHERE l_returnflag = 'N' AND q % 10 = 1),
partner_events AS (SELECT * FROM partner_raw WHERE has_sub),
clicks_dup AS (
  SELECT *, unnest(CASE WHEN q % 11 = 0 THEN [0, 1] ELSE [0] END) AS dup
  FROM li WHERE l_linenumber <> 7),
clicks AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, {_g('l_partkey')} AS upc,
         CASE q % 5 WHEN 0 THEN CAST(NULL AS VARCHAR[]) WHEN 1 THEN CAST([] AS VARCHAR[])
              WHEN 2 THEN [{_g('l_partkey + 1')}]
              WHEN 3 THEN [{_g('l_partkey + 1')}, {_g('l_partkey + 2')}]
              ELSE [{_g('l_partkey + 1')}, {_g('l_partkey + 2')}, {_g('l_partkey + 3')}] END AS sub_upc,
         CASE l_linenumber % 3 WHEN 0 THEN CAST(NULL AS VARCHAR) WHEN 1 THEN 'rejected'
              ELSE 'accepted' END AS sub_status,
         CASE WHEN l_linestatus = 'F' THEN 'app' ELSE 'web' END AS channel,
         CASE WHEN l_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS allow_substitutes,
         CAST(l_partkey % 4 AS INTEGER) AS number_of_subs,
         CASE l_partkey % 3 WHEN 0 THEN 'best_match' WHEN 1 THEN 'same_brand'
              ELSE CAST(NULL AS VARCHAR) END AS substitute_method,
         'Y' AS product_allow_substitutes,
         'best_match' AS product_substitute_method,
         concat('item ', CAST(l_partkey AS VARCHAR)) AS sub_name,
         l_extendedprice AS sub_price,
         CASE WHEN l_partkey % 5 = 0 THEN 'WEIGHT' ELSE 'EACH' END AS sub_type,
         'EA' AS sub_units,
         CAST(l_shipdate AS DATE) AS event_date
  FROM clicks_dup),
tx_dup AS (
  SELECT *, unnest(CASE WHEN q % 13 = 0 THEN [0, 1] ELSE [0] END) AS dup
  FROM li WHERE l_returnflag <> 'N' AND (q % 4 <> 0 OR q % 8 = 0)),
transactions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_no, {_g('l_partkey + 1 + l_suppkey % 3')} AS gtin_no,
         {_ST} AS store_code, CAST(l_shipdate AS DATE) AS transaction_date
  FROM tx_dup),
products AS (
  SELECT {_g('p_partkey')} AS con_upc_no, {_g('p_partkey - p_partkey % 10')} AS bas_con_upc_no
  FROM part)"""

_CARRIED = ("allow_substitutes, number_of_subs, substitute_method, product_allow_substitutes, "
            "product_substitute_method, sub_name, sub_price, sub_type, sub_units")

# The analysis relations, written the direct way.
RELATIONS = f"""
click_subs AS (
  SELECT sub_upc, sub_status, {_CARRIED}, upc, order_id,
         CASE WHEN sub_status IS NULL THEN 'NO' ELSE 'YES' END AS click_record
  FROM clicks),
click_pairs AS (
  SELECT DISTINCT sub_upc, sub_status, {_CARRIED}, upc, order_id, click_record
  FROM (SELECT * EXCLUDE (sub_upc), unnest(sub_upc) AS sub_upc FROM click_subs)),
responses_in_scope AS (
  SELECT order_no, ordered_upc, picked_upc, store_code AS cust_resp_store_code, status, division,
         event_date AS response_date
  FROM response_events WHERE division <> 540),
response_flagged AS (
  SELECT s.order_no, s.ordered_upc, s.picked_upc, r.status,
         CASE WHEN r.status IS NULL THEN 'NO' ELSE 'YES' END AS response_record, s.store_code
  FROM substitution_events s LEFT JOIN responses_in_scope r
    ON s.order_no = r.order_no AND s.ordered_upc = r.ordered_upc AND s.picked_upc = r.picked_upc),
reconciled AS (
  SELECT f.response_record, p.click_record, f.order_no, f.ordered_upc, f.picked_upc, p.sub_upc,
         f.status, p.sub_status, f.store_code, p.allow_substitutes, p.number_of_subs,
         p.substitute_method, p.product_allow_substitutes, p.product_substitute_method,
         p.sub_name, p.sub_price, p.sub_type, p.sub_units
  FROM response_flagged f LEFT JOIN click_pairs p
    ON f.order_no = p.order_id AND f.ordered_upc = p.upc AND f.picked_upc = p.sub_upc),
unanswered AS (SELECT * FROM reconciled WHERE response_record = 'NO'),
answered_in_both AS (SELECT * FROM reconciled WHERE response_record = 'YES' AND click_record = 'YES'),
contradictions AS (
  SELECT * FROM answered_in_both
  WHERE (status = 'Accept' AND sub_status = 'rejected') OR (status = 'Reject' AND sub_status = 'accepted'))"""


def _with(body: str) -> str:
    return f"WITH {FIXTURES},{RELATIONS}\n{body}"


def _pct(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0) * 100.0"


def _metric(name: str, n: str, d: str | None) -> str:
    if d is None:
        return (f"SELECT '{name}' AS metric, CAST({n} AS BIGINT) AS numerator, "
                "CAST(NULL AS BIGINT) AS denominator, CAST(NULL AS DOUBLE) AS percent")
    return (f"SELECT '{name}' AS metric, CAST({n} AS BIGINT) AS numerator, "
            f"CAST({d} AS BIGINT) AS denominator, {_pct(n, d)} AS percent")


def _metrics(rows: list[tuple[str, str, str | None]]) -> str:
    return "\nUNION ALL\n".join(_metric(*r) for r in rows)


def _cnt(rel: str, where: str = "TRUE") -> str:
    return f"(SELECT count(*) FROM {rel} WHERE {where})"


_ON_REG = """d JOIN transactions t
    ON d.order_no = t.order_no AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code"""


def _semi(rel: str) -> str:
    return (f"(SELECT count(*) FROM {rel} d WHERE EXISTS (SELECT 1 FROM transactions t "
            "WHERE d.order_no = t.order_no AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code))")


def _inner(rel: str) -> str:
    return f"(SELECT count(*) FROM {rel} {_ON_REG})"


def _flat(cols: str) -> str:
    return cols.replace("sub_upc,", "array_to_string(sub_upc, '|') AS sub_upc_list,", 1)


_AB = "response_record = 'YES' AND click_record = 'YES'"
_AVR = f"{_AB} AND status = 'Accept' AND sub_status = 'rejected'"
_RVA = f"{_AB} AND status = 'Reject' AND sub_status = 'accepted'"
_AVA = f"{_AB} AND status = 'Accept' AND sub_status = 'accepted'"
_RVR = f"{_AB} AND status = 'Reject' AND sub_status = 'rejected'"

_FANOUT_PARTS = [
    ("substitution_events", "order_no,ordered_upc,picked_upc", "substitution_events",
     "order_no, ordered_upc, picked_upc"),
    ("responses_in_scope", "order_no,ordered_upc,picked_upc", "responses_in_scope",
     "order_no, ordered_upc, picked_upc"),
    ("partner_events", "order_no,ordered_upc,picked_upc", "partner_events",
     "order_no, ordered_upc, picked_upc"),
    ("click_pairs", "order_id,upc,sub_upc", "click_pairs", "order_id, upc, sub_upc"),
    ("transactions", "order_no,gtin_no,store_code", "transactions", "order_no, gtin_no, store_code"),
    ("products", "con_upc_no", "products", "con_upc_no"),
    ("products_base", "bas_con_upc_no", "products", "bas_con_upc_no"),
]


def _fanout() -> str:
    parts = []
    for name, label, rel, keys in _FANOUT_PARTS:
        parts.append(
            f"SELECT '{name}' AS relation, '{label}' AS key_columns, CAST(sum(n) AS BIGINT) AS rows, "
            "CAST(count(*) AS BIGINT) AS distinct_keys, CAST(max(n) AS BIGINT) AS max_rows_per_key, "
            "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows "
            f"FROM (SELECT count(*) AS n FROM {rel} GROUP BY {keys})")
    return "\nUNION ALL\n".join(parts)


_MONTHS = """SELECT DISTINCT strftime(d, '%Y-%m') AS period, date_trunc('month', d)::DATE AS a, last_day(d) AS z FROM (
  SELECT event_date AS d FROM substitution_events UNION SELECT response_date FROM responses_in_scope
  UNION SELECT event_date FROM partner_events UNION SELECT event_date FROM clicks) WHERE d IS NOT NULL"""
_GIVEN = """SELECT * FROM (VALUES ('1994-02-10/1994-08-20', DATE '1994-02-10', DATE '1994-08-20'),
  ('1995-02-10/1995-08-20', DATE '1995-02-10', DATE '1995-08-20')) v(period, a, z)"""


_PERIOD_MORE = [
    ("contradictions_on_register", "reg1"),
    ("contradictions_found_on_register", "sem1"),
    ("unanswered_on_register", "reg2"),
    ("unanswered_found_on_register", "sem2"),
    ("ordered_upc_mapped", "u1"),
    ("picked_upc_mapped", "u2"),
    ("click_upc_mapped", "u3"),
    ("click_upc_base_mapped", "u4"),
    ("click_sub_upc_mapped", "u5"),
    ("response_flagged_rows", "u6"),
    ("click_pairs", "u7"),
]


def _period(periods: str) -> str:
    """One independent run per period, expressed with the period as a join key."""
    return f"""
, given AS ({periods}),
s AS (SELECT x.*, period FROM substitution_events x JOIN given ON event_date >= a AND event_date <= z),
r AS (SELECT x.*, period FROM responses_in_scope x JOIN given ON response_date >= a AND response_date <= z),
pe AS (SELECT x.*, period FROM partner_events x JOIN given ON event_date >= a AND event_date <= z),
c AS (SELECT x.*, period, CASE WHEN sub_status IS NULL THEN 'NO' ELSE 'YES' END AS click_record
      FROM clicks x JOIN given ON event_date >= a AND event_date <= z),
cp AS (SELECT DISTINCT sub_status, {_CARRIED}, upc, order_id, click_record, period,
              unnest(sub_upc) AS sub_upc FROM c),
tx AS (SELECT x.*, period FROM transactions x JOIN given ON transaction_date >= a AND transaction_date <= z),
fl AS (SELECT s.order_no, s.ordered_upc, s.picked_upc, s.store_code, s.period, r.status,
              CASE WHEN r.status IS NULL THEN 'NO' ELSE 'YES' END AS response_record
       FROM s LEFT JOIN r ON s.order_no = r.order_no AND s.ordered_upc = r.ordered_upc
         AND s.picked_upc = r.picked_upc AND s.period = r.period),
rc AS (SELECT fl.*, cp.click_record, cp.sub_status FROM fl LEFT JOIN cp
         ON fl.order_no = cp.order_id AND fl.ordered_upc = cp.upc AND fl.picked_upc = cp.sub_upc
        AND fl.period = cp.period),
m1 AS (SELECT period, count(*) AS substitutions FROM s GROUP BY period),
m2 AS (SELECT period, count(*) AS responses_in_scope FROM r GROUP BY period),
m3 AS (SELECT s.period, count(*) AS matched_responses FROM s JOIN r ON s.order_no = r.order_no
         AND s.ordered_upc = r.ordered_upc AND s.picked_upc = r.picked_upc AND s.period = r.period
       GROUP BY s.period),
m4 AS (SELECT period, count(*) AS without_response FROM fl WHERE response_record = 'NO' GROUP BY period),
m5 AS (SELECT period, count(*) AS responses_without_substitution FROM r WHERE NOT EXISTS (
         SELECT 1 FROM s WHERE s.order_no = r.order_no AND s.ordered_upc = r.ordered_upc
           AND s.picked_upc = r.picked_upc AND s.period = r.period) GROUP BY period),
m6 AS (SELECT r.period, count(*) AS partner_explained_responses FROM r JOIN pe ON r.order_no = pe.order_no
         AND r.ordered_upc = pe.ordered_upc AND r.picked_upc = pe.picked_upc AND r.period = pe.period
       GROUP BY r.period),
m7 AS (SELECT period, count(*) FILTER (WHERE response_record = 'NO') AS unanswered,
              count(*) FILTER (WHERE response_record = 'NO' AND click_record = 'YES') AS recovered_from_clicks,
              count(*) FILTER (WHERE {_AB}) AS answered_in_both,
              count(*) FILTER (WHERE ({_AVR}) OR ({_RVA})) AS contradictions,
              count(*) FILTER (WHERE {_AVR}) AS accept_vs_rejected,
              count(*) FILTER (WHERE {_RVA}) AS reject_vs_accepted
       FROM rc GROUP BY period),
m8 AS (SELECT period, count(*) AS clicks, count(sub_status) AS clicks_with_answer FROM c GROUP BY period),
con AS (SELECT * FROM rc WHERE ({_AVR}) OR ({_RVA})),
una AS (SELECT * FROM rc WHERE response_record = 'NO'),
{', '.join(f"""reg{k} AS (SELECT d.period, count(*) AS n FROM {rel} d JOIN tx t ON d.order_no = t.order_no
  AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code AND d.period = t.period GROUP BY d.period),
sem{k} AS (SELECT d.period, count(*) AS n FROM {rel} d WHERE EXISTS (SELECT 1 FROM tx t WHERE d.order_no = t.order_no
  AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code AND d.period = t.period) GROUP BY d.period)"""
  for k, rel in ((1, 'con'), (2, 'una')))},
u1 AS (SELECT period, count(*) AS n FROM fl JOIN products p ON fl.ordered_upc = p.con_upc_no GROUP BY period),
u2 AS (SELECT period, count(*) AS n FROM fl JOIN products p ON fl.picked_upc = p.con_upc_no GROUP BY period),
u3 AS (SELECT period, count(*) AS n FROM c JOIN products p ON c.upc = p.con_upc_no GROUP BY period),
u4 AS (SELECT period, count(*) AS n FROM c WHERE upc IN (SELECT bas_con_upc_no FROM products) GROUP BY period),
u5 AS (SELECT period, count(*) AS n FROM cp JOIN products p ON cp.sub_upc = p.con_upc_no GROUP BY period),
u6 AS (SELECT period, count(*) AS n FROM fl GROUP BY period),
u7 AS (SELECT period, count(*) AS n FROM cp GROUP BY period),
ps AS (SELECT period FROM m1 UNION SELECT period FROM m2 UNION SELECT period FROM pe UNION SELECT period FROM m8),
w AS (
  SELECT ps.period,
    CAST(coalesce(substitutions, 0) AS BIGINT) AS substitutions,
    CAST(coalesce(responses_in_scope, 0) AS BIGINT) AS responses_in_scope,
    CAST(coalesce(matched_responses, 0) AS BIGINT) AS matched_responses,
    CAST(coalesce(without_response, 0) AS BIGINT) AS without_response,
    CAST(coalesce(responses_without_substitution, 0) AS BIGINT) AS responses_without_substitution,
    CAST(coalesce(partner_explained_responses, 0) AS BIGINT) AS partner_explained_responses,
    CAST(coalesce(unanswered, 0) AS BIGINT) AS unanswered,
    CAST(coalesce(recovered_from_clicks, 0) AS BIGINT) AS recovered_from_clicks,
    CAST(coalesce(answered_in_both, 0) AS BIGINT) AS answered_in_both,
    CAST(coalesce(contradictions, 0) AS BIGINT) AS contradictions,
    CAST(coalesce(accept_vs_rejected, 0) AS BIGINT) AS accept_vs_rejected,
    CAST(coalesce(reject_vs_accepted, 0) AS BIGINT) AS reject_vs_accepted,
    CAST(coalesce(clicks, 0) AS BIGINT) AS clicks,
    CAST(coalesce(clicks_with_answer, 0) AS BIGINT) AS clicks_with_answer,
    {', '.join(f"CAST(coalesce({t}.n, 0) AS BIGINT) AS {n}" for n, t in _PERIOD_MORE)}
  FROM ps LEFT JOIN m1 USING (period) LEFT JOIN m2 USING (period) LEFT JOIN m3 USING (period)
  LEFT JOIN m4 USING (period) LEFT JOIN m5 USING (period) LEFT JOIN m6 USING (period)
  LEFT JOIN m7 USING (period) LEFT JOIN m8 USING (period)
  {' '.join(f"LEFT JOIN {t} ON {t}.period = ps.period" for _, t in _PERIOD_MORE)})
SELECT *,
  {_pct('without_response', 'substitutions')} AS pct_without_response,
  {_pct('responses_without_substitution', 'responses_in_scope')} AS pct_responses_without_substitution,
  {_pct('partner_explained_responses', 'responses_in_scope')} AS pct_partner_explained,
  {_pct('recovered_from_clicks', 'unanswered')} AS pct_recovered,
  {_pct('contradictions', 'answered_in_both')} AS pct_contradictions,
  {_pct('accept_vs_rejected', 'contradictions')} AS pct_accept_vs_rejected,
  {_pct('reject_vs_accepted', 'contradictions')} AS pct_reject_vs_accepted,
  {_pct('clicks_with_answer', 'clicks')} AS pct_clicks_with_answer,
  {_pct('contradictions_found_on_register', 'contradictions')} AS pct_contradictions_found_on_register,
  {_pct('unanswered_found_on_register', 'unanswered')} AS pct_unanswered_found_on_register,
  {_pct('ordered_upc_mapped', 'response_flagged_rows')} AS pct_ordered_upc_mapped,
  {_pct('picked_upc_mapped', 'response_flagged_rows')} AS pct_picked_upc_mapped,
  {_pct('click_upc_mapped', 'clicks')} AS pct_click_upc_mapped,
  {_pct('click_upc_base_mapped', 'clicks')} AS pct_click_upc_base_mapped,
  {_pct('click_sub_upc_mapped', 'click_pairs')} AS pct_click_sub_upc_mapped
FROM w"""


def _flag_cov(flag: str, rel: str, total: str) -> str:
    return (f"SELECT {flag}, CAST(count(*) AS BIGINT) AS count, CAST({total} AS BIGINT) AS total, "
            f"{_pct('count(*)', total)} AS percent FROM {rel} GROUP BY {flag}")


_CLICK_COLS = f"order_id, upc, sub_upc, sub_status, channel, {_CARRIED}, event_date"
_CLICK_SUBS_COLS = f"sub_upc, sub_status, {_CARRIED}, upc, order_id, click_record"

SQL: dict[str, str] = {
    "substitution_events_period": _with("SELECT * FROM substitution_events"),
    "response_events_period": _with("SELECT * FROM response_events"),
    "partner_events_period": _with("SELECT * FROM partner_events"),
    "transactions_period": _with("SELECT * FROM transactions"),
    "clicks": _with(f"SELECT {_flat(_CLICK_COLS)} FROM clicks"),
    "products": _with("SELECT * FROM products"),
    "click_subs": _with(f"SELECT {_flat(_CLICK_SUBS_COLS)} FROM click_subs"),
    "click_pairs": _with("SELECT * FROM click_pairs"),
    "click_channels": _with("SELECT DISTINCT channel FROM clicks"),
    "response_statuses": _with("SELECT DISTINCT status FROM reconciled"),
    "click_statuses": _with("SELECT DISTINCT sub_status FROM reconciled"),
    "responses_in_scope": _with("SELECT * FROM responses_in_scope"),
    "partner_explained_responses": _with(
        "SELECT r.* FROM responses_in_scope r JOIN partner_events p ON r.order_no = p.order_no "
        "AND r.ordered_upc = p.ordered_upc AND r.picked_upc = p.picked_upc"),
    "matched_responses": _with(
        "SELECT s.*, r.* EXCLUDE (order_no, ordered_upc, picked_upc) FROM substitution_events s "
        "JOIN responses_in_scope r ON s.order_no = r.order_no AND s.ordered_upc = r.ordered_upc "
        "AND s.picked_upc = r.picked_upc"),
    "responses_right_join": _with(
        "SELECT r.order_no, r.ordered_upc, r.picked_upc, s.store_code, s.attempted_utilization, "
        "s.event_date, r.cust_resp_store_code, r.status, r.division, r.response_date "
        "FROM substitution_events s RIGHT JOIN responses_in_scope r ON s.order_no = r.order_no "
        "AND s.ordered_upc = r.ordered_upc AND s.picked_upc = r.picked_upc"),
    "responses_without_substitution": _with(
        "SELECT r.* FROM substitution_events s RIGHT JOIN responses_in_scope r "
        "ON s.order_no = r.order_no AND s.ordered_upc = r.ordered_upc AND s.picked_upc = r.picked_upc "
        "WHERE s.attempted_utilization IS NULL"),
    "response_flagged": _with("SELECT * FROM response_flagged"),
    "reconciled": _with("SELECT * FROM reconciled"),
    "unanswered": _with("SELECT * FROM unanswered"),
    "recovered_from_clicks": _with("SELECT * FROM unanswered WHERE click_record = 'YES'"),
    "answered_in_both": _with("SELECT * FROM answered_in_both"),
    "contradictions": _with("SELECT * FROM contradictions"),
    "contradictions_on_register": _with(
        f"SELECT d.*, t.gtin_no, t.transaction_date FROM contradictions {_ON_REG}"),
    "contradictions_found_on_register": _with(
        "SELECT d.* FROM contradictions d WHERE EXISTS (SELECT 1 FROM transactions t "
        "WHERE d.order_no = t.order_no AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code)"),
    "unanswered_on_register": _with(
        f"SELECT d.*, t.gtin_no, t.transaction_date FROM unanswered {_ON_REG}"),
    "unanswered_found_on_register": _with(
        "SELECT d.* FROM unanswered d WHERE EXISTS (SELECT 1 FROM transactions t "
        "WHERE d.order_no = t.order_no AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code)"),
    "engaged_orders": _with(
        "SELECT order_no, CAST(count(*) AS BIGINT) AS substitutions, "
        "CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS on_register FROM ("
        "  SELECT d.order_no, EXISTS (SELECT 1 FROM transactions t WHERE d.order_no = t.order_no "
        "    AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code) AS hit"
        "  FROM substitution_events d) GROUP BY order_no "
        "HAVING count(*) FILTER (WHERE hit) > 0 AND count(*) FILTER (WHERE hit) < count(*)"),
    "order_register_profile": _with(
        "SELECT CASE WHEN hits = n THEN 'all' WHEN hits = 0 THEN 'none' ELSE 'some' END AS order_class, "
        "CAST(count(*) AS BIGINT) AS orders, CAST(sum(n) AS BIGINT) AS substitutions, "
        "CAST(sum(hits) AS BIGINT) AS on_register FROM ("
        "  SELECT order_no, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM ("
        "    SELECT d.order_no, EXISTS (SELECT 1 FROM transactions t WHERE d.order_no = t.order_no "
        "      AND d.picked_upc = t.gtin_no AND d.store_code = t.store_code) AS hit"
        "    FROM substitution_events d) GROUP BY order_no) GROUP BY 1"),
    "upc_map_ordered": _with(
        "SELECT f.ordered_upc, p.con_upc_no, p.bas_con_upc_no FROM response_flagged f "
        "JOIN products p ON f.ordered_upc = p.con_upc_no"),
    "upc_map_picked": _with(
        "SELECT f.picked_upc, p.con_upc_no, p.bas_con_upc_no FROM response_flagged f "
        "JOIN products p ON f.picked_upc = p.con_upc_no"),
    "upc_map_click": _with(
        "SELECT c.upc, p.con_upc_no, p.bas_con_upc_no FROM click_subs c JOIN products p "
        "ON c.upc = p.con_upc_no"),
    "upc_map_click_base": _with(
        "SELECT c.order_id, c.upc FROM click_subs c WHERE c.upc IN (SELECT bas_con_upc_no FROM products)"),
    "upc_map_click_sub": _with(
        "SELECT c.sub_upc, p.con_upc_no, p.bas_con_upc_no FROM click_pairs c JOIN products p "
        "ON c.sub_upc = p.con_upc_no"),
    "click_coverage": _with(_flag_cov("click_record", "click_subs", _cnt("click_subs"))),
    "response_coverage": _with(_flag_cov("response_record", "response_flagged",
                                         _cnt("substitution_events"))),
    "reconciliation_summary": _with(_metrics([
        ("substitutions", _cnt("substitution_events"), None),
        ("responses_in_scope", _cnt("responses_in_scope"), None),
        ("matched_responses",
         "(SELECT count(*) FROM substitution_events s JOIN responses_in_scope r ON s.order_no = r.order_no "
         "AND s.ordered_upc = r.ordered_upc AND s.picked_upc = r.picked_upc)", None),
        ("responses_without_substitution",
         "(SELECT count(*) FROM substitution_events s RIGHT JOIN responses_in_scope r "
         "ON s.order_no = r.order_no AND s.ordered_upc = r.ordered_upc AND s.picked_upc = r.picked_upc "
         "WHERE s.attempted_utilization IS NULL)", _cnt("responses_in_scope")),
        ("partner_explained_responses",
         "(SELECT count(*) FROM responses_in_scope r JOIN partner_events p ON r.order_no = p.order_no "
         "AND r.ordered_upc = p.ordered_upc AND r.picked_upc = p.picked_upc)", _cnt("responses_in_scope")),
        ("substitutions_without_response", _cnt("response_flagged", "response_record = 'NO'"),
         _cnt("substitution_events")),
    ])),
    "recovery_rate": _with(_metrics([
        ("recovered_from_clicks", _cnt("unanswered", "click_record = 'YES'"), _cnt("unanswered")),
    ])),
    "contradiction_matrix": _with(_metrics([
        ("contradictions", _cnt("contradictions"), _cnt("answered_in_both")),
        ("accept_vs_rejected", _cnt("reconciled", _AVR), _cnt("contradictions")),
        ("reject_vs_accepted", _cnt("reconciled", _RVA), _cnt("contradictions")),
        ("accept_vs_accepted", _cnt("reconciled", _AVA), _cnt("answered_in_both")),
        ("reject_vs_rejected", _cnt("reconciled", _RVR), _cnt("answered_in_both")),
        ("other", f"({_cnt('answered_in_both')} - {_cnt('contradictions')} - {_cnt('reconciled', _AVA)}"
                  f" - {_cnt('reconciled', _RVR)})", _cnt("answered_in_both")),
    ])),
    "contradiction_register_check": _with(_metrics([
        ("contradictions", _cnt("contradictions"), None),
        ("on_register_inner", _inner("contradictions"), _cnt("contradictions")),
        ("on_register_semi", _semi("contradictions"), _cnt("contradictions")),
    ])),
    "unanswered_register_rate": _with(_metrics([
        ("unanswered", _cnt("unanswered"), None),
        ("inferred_purchase_inner", _inner("unanswered"), _cnt("unanswered")),
        ("inferred_purchase_semi", _semi("unanswered"), _cnt("unanswered")),
    ])),
    "upc_mapping_coverage": _with(_metrics([
        ("ordered_upc_gtin", "(SELECT count(*) FROM response_flagged f JOIN products p "
                             "ON f.ordered_upc = p.con_upc_no)", _cnt("response_flagged")),
        ("picked_upc_gtin", "(SELECT count(*) FROM response_flagged f JOIN products p "
                            "ON f.picked_upc = p.con_upc_no)", _cnt("response_flagged")),
        ("click_upc_gtin", "(SELECT count(*) FROM click_subs c JOIN products p ON c.upc = p.con_upc_no)",
         _cnt("click_subs")),
        ("click_upc_base", "(SELECT count(*) FROM click_subs c "
                           "WHERE c.upc IN (SELECT bas_con_upc_no FROM products))", _cnt("click_subs")),
        ("click_sub_upc_gtin", "(SELECT count(*) FROM click_pairs c JOIN products p "
                               "ON c.sub_upc = p.con_upc_no)", _cnt("click_pairs")),
    ])),
    "key_fanout_audit": _with(_fanout()),
    "period_comparison": f"WITH {FIXTURES},{RELATIONS}{_period(_MONTHS)}",
}

# bounded runs: each table cut by its own date, first and last day included
_BETWEEN = "BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'"
_LI = "li AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"
assert _LI in FIXTURES
_ONE_MONTH = FIXTURES.replace(_LI, f"{_LI[:-1]} WHERE CAST(l_shipdate AS DATE) {_BETWEEN})")
SQL |= {
    **{f"{t}_month": _with(f"SELECT * FROM {t} WHERE {c} {_BETWEEN}")
       for t, c in (("substitution_events", "event_date"), ("response_events", "event_date"),
                    ("partner_events", "event_date"), ("transactions", "transaction_date"))},
    "contradiction_matrix_month": SQL["contradiction_matrix"].replace(FIXTURES, _ONE_MONTH),
    "reconciliation_summary_rounded": ("SELECT metric, numerator, denominator, round(percent, 2) AS percent FROM ("
                                       + SQL["reconciliation_summary"] + ")"),
    "two_period_comparison": f"WITH {FIXTURES},{RELATIONS}{_period(_GIVEN)}",
}


def _job_month(first: str, last: str) -> str:
    """What one monthly run of the job adds to ``metrics``."""
    days = FIXTURES.replace(_LI, f"{_LI[:-1]} WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{first}' AND DATE '{last}')")
    return " UNION ALL ".join(
        f"SELECT '{report}' AS report, *, round(percent, 2) AS percent_rounded, '{first}/{last}' AS period, "
        f"'{first}_{last}' AS run_period FROM ({SQL[report].replace(FIXTURES, days)})"
        for report in ("recovery_rate", "contradiction_matrix"))


SQL["job_metrics"] = " UNION ALL ".join([_job_month("1995-03-01", "1995-03-31"), _job_month("1995-04-01", "1995-04-30")])
