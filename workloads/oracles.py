"""SQL checks: the same results as ``workloads.queries``, written independently for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

BINS = list(range(2, 20))


def _code(tbl: str, col: int, row: int) -> str:
    return f"{tbl}_C{col:02d}_{row:03d}E"


AGES = [_code("S0101", 1, b) for b in BINS]
POP, MIG, WOMEN, BIRTHS = "S0101_C01_001E", "S0701_C06_001E", "S1301_C01_001E", "S1301_C02_001E"
S0101 = [_code("S0101", c, x) for c in (1, 3, 5) for x in range(1, 20)]
S0701 = [_code("S0701", c, x) for c in range(1, 6) for x in (1, 2, 3, 11, 48)]
S1301 = [_code("S1301", 1, x) for x in (1, 2, 31, 32)] + [_code("S1301", c, x) for c in range(2, 6) for x in (1, 2)]
MODEL = [*AGES, MIG, WOMEN, BIRTHS, "dn"]

LI = """li AS (
  SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS place,
         CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS period,
         CAST(floor((l_quantity - 1) * 18 / 50) AS INTEGER) + 2 AS bin, lineitem.*
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

TAX = {2: "l_tax < 0.02", 3: "l_tax BETWEEN 0.02 AND 0.03", 4: "l_tax BETWEEN 0.04 AND 0.05", 5: "l_tax >= 0.06"}


def _n(*conds: str) -> str:
    used = " AND ".join(c for c in conds if c)
    return f"CAST(count(*) FILTER (WHERE {used}) AS DOUBLE)" if used else "CAST(count(*) AS DOUBLE)"


def _pct(part: str, base: str) -> str:
    return f"CASE WHEN {base} = 0 THEN 0.0::DOUBLE ELSE {part} * 100 / {base} END"


def _expr(code: str) -> str:
    tbl, col, row = code[:5], int(code[7:9]), int(code[10:13])
    if tbl == "S0101":
        sex = {1: "", 3: "l_linestatus = 'F'", 5: "l_linestatus = 'O'"}[col]
        return _n(sex, "" if row == 1 else f"bin = {row}")
    if tbl == "S0701":
        tax = TAX.get(col, "")
        if row in (11, 48):
            what = "l_extendedprice" if row == 11 else "l_discount"
            return f"max({what})" + (f" FILTER (WHERE {tax})" if tax else "")
        moved = {1: "", 2: "l_returnflag = 'A'", 3: "l_returnflag = 'R'"}[row]
        return _n(moved) if col == 1 else _pct(_n(moved, tax), _n(moved))
    if col == 1 and row in (1, 2):
        return _n("l_quantity BETWEEN 15 AND 45", "l_linestatus = 'O'" if row == 2 else "")
    if col == 1:
        return "max(l_tax)" if row == 31 else "CAST(0 AS DOUBLE)"
    group = "l_linestatus = 'O'" if row == 2 else ""
    if col == 2:
        return _n("l_discount >= 0.08", group)
    share = {3: "l_returnflag = 'A'", 4: "l_returnflag = 'R'", 5: "l_returnflag = 'N'"}[col]
    return _pct(_n("l_discount >= 0.08", group, share), _n("l_discount >= 0.08", group))


def wide(codes: list[str], t: str = "year") -> str:
    """CTEs ``li`` and ``w``: the wide panel."""
    cols = ",\n    ".join(f"{_expr(c)} AS {c}" for c in codes)
    return f"{LI},\nw AS (SELECT {t}, state, place,\n    {cols}\n  FROM li GROUP BY {t}, state, place)"


def melt(source: str, name: str, ids: str = "year, state, place") -> str:
    return f"{name} AS (UNPIVOT {source} ON COLUMNS(* EXCLUDE ({ids})) INTO NAME metric VALUE value)"


def long(codes: list[str], t: str = "year") -> str:
    """CTEs ``li``, ``w`` and ``p``: the long panel."""
    return wide(codes, t) + ",\n" + melt("w", "p", f"{t}, state, place")


def rnd(x: str, digits: int = 6, name: str = "value") -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def ratio(num: str, den: str, scale: str = "") -> str:
    zero = f"CASE WHEN {num} = 0 THEN 0.0::DOUBLE ELSE sign({num}) * 'inf'::DOUBLE END"
    return f"CASE WHEN {den} = 0 THEN {zero} ELSE {num} / {den} {scale} END"


RATIOS = ", ".join([
    f"{rnd(ratio('working', 'senior'), 6, 'working_senior_ratio')}",
    f"{rnd(ratio('working', 'total', '* 100'), 6, 'working_total_ratio')}",
    f"{rnd(ratio('senior', 'total', '* 100'), 6, 'senior_total_ratio')}"])

GROUPS = {"youth": AGES[0:5], "working": AGES[5:13], "senior": AGES[13:18]}


def groups_of(source: str) -> str:
    parts = ", ".join(f"{' + '.join(cols)} AS {g}" for g, cols in GROUPS.items())
    return f"SELECT year, state, place, {parts}, {' + '.join(AGES)} AS total FROM {source}"


# The old layout: percentages of the group's total, empty cells as a sentinel.
OLD_GROUP = {"C01": "C01", "C03": "C02", "C05": "C03"}
OLD = f"""{long(S0101)},
old AS (
  SELECT p.year, p.state, p.place, p.metric AS new_metric,
         CASE substr(p.metric, 7, 3) WHEN 'C03' THEN replace(p.metric, 'C03', 'C02')
              WHEN 'C05' THEN replace(p.metric, 'C05', 'C03') ELSE p.metric END AS metric,
         b.value AS base,
         CASE WHEN p.metric LIKE '%_001E' THEN p.value WHEN p.value = 0 THEN -888888888.0
              ELSE round(p.value * 100 / b.value, 1) END AS value
  FROM p JOIN p b ON b.year = p.year AND b.state = p.state AND b.place = p.place
       AND b.metric = substr(p.metric, 1, 10) || '001E'
  WHERE p.year < 1998),
new AS (SELECT year, state, place, metric AS new_metric, metric, value FROM p WHERE year >= 1998)"""

ORACLES["codebook_grid"] = f"""WITH {long(S0101)},
grid AS (SELECT CAST(c AS INTEGER) AS col, CAST(x AS INTEGER) AS row FROM (VALUES (1), (3), (5)) v(c), range(1, 20) g(x))
SELECT 'S0101_C' || lpad(CAST(col AS VARCHAR), 2, '0') || '_' || lpad(CAST(row AS VARCHAR), 3, '0') || 'E' AS metric,
       'S0101' AS tbl, col, row, count(value) AS n, sum(value) AS total
FROM grid LEFT JOIN p ON p.metric = 'S0101_C' || lpad(CAST(col AS VARCHAR), 2, '0') || '_'
     || lpad(CAST(row AS VARCHAR), 3, '0') || 'E'
GROUP BY col, row"""

ORACLES["typed_reread"] = """SELECT o_orderstatus, count(*) AS n, max(o_custkey) AS last_customer,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 6) + 0.0 AS total FROM orders GROUP BY o_orderstatus"""

ORACLES["read_release_files"] = """WITH c AS (SELECT year, c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS a,
  CASE WHEN c_nationkey % 3 = 0 OR c_nationkey % 5 = 0 THEN 0 ELSE c_nationkey + year END AS b FROM customer, (VALUES (2016), (2018)) y(year))
SELECT CAST(year AS INTEGER) AS year, metric, count(*) AS n, round(CAST(sum(value) AS DOUBLE), 6) + 0.0 AS total,
       min(lpad(CAST(c_custkey AS VARCHAR), 10, '0')) AS first_place, max(lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS last_state
FROM (SELECT year, c_custkey, c_nationkey, 'S0101_C01_001E' AS metric, a AS value FROM c
      UNION ALL SELECT year, c_custkey, c_nationkey, 'S0101_C01_002E', b FROM c) GROUP BY year, metric"""

ORACLES["read_lookup_file"] = """SELECT n_name AS state, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""

ORACLES["predicate_filter"] = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS n
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW'
GROUP BY ALL"""

ORACLES["vintage_union"] = f"""WITH {OLD},
codes AS (SELECT 'S0101_' || c || '_' || lpad(CAST(x AS VARCHAR), 3, '0') || 'E' AS metric
          FROM (VALUES ('C01'), ('C02'), ('C03'), ('C05')) v(c), range(1, 20) g(x)),
cells AS (SELECT 'old' AS layout, year, state, place, metric, value FROM old
          UNION ALL SELECT 'new', year, state, place, metric, value FROM new),
rows AS (SELECT DISTINCT layout, year, state, place FROM cells)
SELECT r.layout, r.year, c.metric, count(*) AS n_rows, count(*) - count(x.value) AS n_null,
       round(sum(CASE WHEN x.value > -1e8 THEN x.value END), 6) + 0.0 AS total
FROM rows r CROSS JOIN codes c LEFT JOIN cells x ON x.layout = r.layout AND x.year = r.year AND x.state = r.state
     AND x.place = r.place AND x.metric = c.metric
GROUP BY r.layout, r.year, c.metric"""

ORACLES["align_vintage"] = f"""WITH {OLD}
SELECT year, state, place, new_metric AS metric, value FROM old WHERE new_metric LIKE '%_002E'
UNION ALL SELECT year, state, place, new_metric, value FROM new WHERE new_metric LIKE '%_002E'"""

ORACLES["align_vintage_long"] = f"""WITH {OLD},
cells AS (SELECT year, new_metric AS metric, value FROM old UNION ALL SELECT year, new_metric, value FROM new)
SELECT year, metric, count(*) AS n, round(sum(CASE WHEN value > -1e8 THEN value END), 6) + 0.0 AS total
FROM cells GROUP BY year, metric"""

ORACLES["metric_parse"] = f"""WITH {long(S0101)}
SELECT substr(metric, 1, 5) AS tbl, substr(metric, 7, 3) AS col, substr(metric, 11, 4) AS row, sum(value) AS total
FROM p WHERE regexp_matches(metric, '^S0101_C0[15]_01') AND metric NOT LIKE '%019E' GROUP BY ALL"""

ORACLES["drop_families"] = f"""WITH {long(sorted([*S0101, *S0701, *S1301]))}
SELECT metric, CAST(row_number() OVER (ORDER BY metric) AS INTEGER) AS position, round(sum(value), 6) + 0.0 AS total FROM p
WHERE NOT regexp_matches(metric, '^S1301_C0[34]|^S0701_C.._(011|048)E|^S1301_C01_03[12]E') GROUP BY metric"""

ORACLES["common_schema"] = f"""WITH {long([POP, *AGES])}
SELECT metric, 2 * count(*) AS n, 2 * sum(value) AS total FROM p GROUP BY metric"""

ORACLES["unpivot"] = f"""WITH {long([POP, WOMEN, BIRTHS])} SELECT year, state, place, metric, value FROM p"""

# Customers as places, order priorities as five bins.
CUSTOMER = """c AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state,
         lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS place, c_mktsegment AS segment,
         CAST(count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS DOUBLE) AS S0101_C01_002E,
         CAST(count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS DOUBLE) AS S0101_C01_003E,
         CAST(count(*) FILTER (WHERE o_orderpriority LIKE '3%') AS DOUBLE) AS S0101_C01_004E,
         CAST(count(*) FILTER (WHERE o_orderpriority LIKE '4%') AS DOUBLE) AS S0101_C01_005E,
         CAST(count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS DOUBLE) AS S0101_C01_006E
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
FIVE = AGES[:5]
CUSTOMER_LONG = f"""{CUSTOMER},
cw AS (SELECT * EXCLUDE (segment) FROM c),
{melt('cw', 'cl')}"""

ORACLES["pivot_wide"] = ORACLES["fill_missing"] = f"WITH {CUSTOMER} SELECT * EXCLUDE (segment) FROM c"

ORACLES["double_unpivot"] = f"""WITH {wide([POP, *AGES])}, g AS ({groups_of('w')}),
s AS (SELECT *, {RATIOS} FROM g)
SELECT year, state, place, age_group,
       CASE age_group WHEN 'youth' THEN youth WHEN 'working' THEN working ELSE senior END AS population, ratio_type,
       CASE ratio_type WHEN 'working_total_ratio' THEN working_total_ratio ELSE senior_total_ratio END AS ratio
FROM s, (VALUES ('youth'), ('working'), ('senior')) a(age_group),
     (VALUES ('working_total_ratio'), ('senior_total_ratio')) b(ratio_type)"""

ORACLES["transpose_report"] = f"""WITH {wide([POP, *AGES])}, g AS ({groups_of('w')}),
m AS (SELECT year, age_group, value FROM (UNPIVOT g ON youth, working, senior, total INTO NAME age_group VALUE value))
SELECT age_group, {', '.join(f"sum(value) FILTER (WHERE year = {y}) AS y{y}" for y in range(1995, 2002))}
FROM m GROUP BY age_group"""

ORACLES["quantile_dim"] = f"""WITH {long([POP, *AGES])}
SELECT 'upper' AS path, year, metric, count(*) AS n, round(sum(value * (CAST(0.6 AS DOUBLE) + 0.5)), 6) + 0.0 AS total
FROM p GROUP BY year, metric
UNION ALL
SELECT 'all', year, metric, count(*), round(sum(value * (q + 0.5)), 6) + 0.0
FROM p, (VALUES (CAST(0.4 AS DOUBLE)), (0.5), (0.6)) v(q) GROUP BY year, metric"""

LABELS = ["0-4", "5-9", "10-14", "15-19", "20-24", "25-29", "30-34", "35-39", "40-44", "45-49", "50-54", "55-59",
          "60-64", "65-69", "70-74", "75-79", "80-84", "85+"]
LABEL_CASE = "CASE metric " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(AGES, LABELS)) + " ELSE metric END"

ORACLES["label_metrics"] = f"""WITH {long([POP, *AGES])}
SELECT year, {LABEL_CASE} AS label, sum(value) AS total FROM p GROUP BY ALL"""

ORACLES["clean_sentinel"] = f"""WITH {OLD},
cleaned AS (SELECT year, metric, CASE WHEN value <= -111111111 THEN 0.0 ELSE value END AS value FROM old)
SELECT year, metric, round(sum(value), 6) + 0.0 AS total, min(value) AS lowest, count(*) FILTER (WHERE value = 0) AS n_zero
FROM cleaned GROUP BY year, metric"""

ORACLES["drop_zero_metrics"] = f"""WITH {long(S1301)}
SELECT metric, {rnd('avg(value)', 6, 'mean')} FROM p GROUP BY metric HAVING avg(value) <> 0"""

PCT = """CASE WHEN new_metric LIKE '%_001E' THEN value WHEN value <= -111111111 THEN 0.0
              ELSE round_even(base * value / 100, 0) END"""
ORACLES["pct_to_count"] = f"""WITH {OLD}
SELECT year, state, place, new_metric AS metric, {PCT} AS value FROM old"""

SIB = """s AS (SELECT p.year, p.state, p.place, p.metric, b.value * p.value / 100 AS value
  FROM p JOIN p b ON b.year = p.year AND b.state = p.state AND b.place = p.place
       AND b.metric = '{tbl}_{base}' || substr(p.metric, 10)
  WHERE regexp_matches(p.metric, '{pattern}'))"""
SIB_MOBILITY = SIB.format(tbl="S0701", base="C01", pattern="^S0701_C0[2-5]_00")

ORACLES["sibling_scale"] = f"""WITH {long(S0701)}, {SIB_MOBILITY}
SELECT year, state, place, metric, {rnd('value')} FROM s"""

ORACLES["sibling_product"] = f"""WITH {long(S1301)}, {SIB.format(tbl='S1301', base='C02', pattern='^S1301_C05')}
SELECT year, state, place, metric, {rnd('value')} FROM s"""

ORACLES["migration_sum"] = f"""WITH {long(S0701)}, {SIB_MOBILITY}
SELECT year, state, place, 'S0701_C06_' || substr(metric, 11) AS metric, {rnd('sum(value)')}
FROM s GROUP BY year, state, place, substr(metric, 11)"""

ORACLES["family_sum"] = f"""WITH {wide([POP, *AGES])}, g AS ({groups_of('w')})
SELECT year, state, place, youth, working, senior, total FROM g"""

ORACLES["ratios"] = f"""WITH {wide([POP, *AGES])}, g AS ({groups_of('w')}) SELECT year, state, place, {RATIOS} FROM g"""

ORACLES["growth_rate"] = f"""WITH {wide([POP])}
SELECT state, place, max(CASE WHEN year = 1995 THEN {POP} END) AS first_value,
       max(CASE WHEN year = 2001 THEN {POP} END) AS last_value,
       {rnd(f'(max(CASE WHEN year = 2001 THEN {POP} END) - max(CASE WHEN year = 1995 THEN {POP} END))'
            f' / max(CASE WHEN year = 1995 THEN {POP} END) * 100', 6, 'growth_rate')}
FROM w GROUP BY state, place HAVING count(*) = 7"""


def model(t: str, first: int, keep: list[str]) -> str:
    """CTE ``f``: long panel of modelling measures with the residual, first time point dropped."""
    mob = [_code("S0701", c, 1) for c in range(1, 6)]
    moved = " + ".join(f"{m} * S0701_C01_001E / 100" for m in mob[1:])
    return f"""{wide([POP, *AGES, *mob, WOMEN, BIRTHS], t)},
d AS (SELECT {t}, state, place, {POP}, {', '.join(AGES)}, {moved} AS {MIG}, {WOMEN}, {BIRTHS} FROM w),
e AS (SELECT *, {POP} - lag({POP}) OVER (PARTITION BY state, place ORDER BY {t}) - {MIG} - {BIRTHS} AS dn FROM d),
g0 AS (SELECT {t}, state, place, {', '.join(f'coalesce({c}, 0) AS {c}' for c in keep)} FROM e WHERE {t} <> {first}),
{melt('g0', 'f', f'{t}, state, place')}"""


YEARLY_MODEL = model("year", 1995, [POP, *MODEL])
QUARTERS = model("period", 0, MODEL)
QUARTERS_AGES = model("period", 0, AGES)

ORACLES["residual_change"] = f"""WITH {model('year', -1, ['dn'])}
SELECT year, state, place, {rnd('dn', 6, 'dn')} FROM e"""

STATS = """st AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS sd FROM f GROUP BY metric)"""

ORACLES["clip_floor"] = f"""WITH {YEARLY_MODEL}, {STATS}
SELECT year, state, place, f.metric, round(CASE WHEN f.metric = 'dn' THEN value - 2
  ELSE greatest(value - 2, round(mean / 2, 6)) END, 6) + 0.0 AS value FROM f JOIN st ON f.metric = st.metric"""

# Hold-out, decoding, entity tables.
PLACES = """places AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state,
  lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS place, s_name, s_acctbal, s_nationkey FROM supplier),
held AS (SELECT place, state, s_name FROM places WHERE s_acctbal < 2000 AND place NOT IN ('0000000001', '0000000005'))"""

ORACLES["holdout_semi"] = f"""WITH {wide([POP])}, {PLACES}
SELECT year, state, place, {POP} FROM w WHERE place IN (SELECT place FROM held)"""
ORACLES["holdout_anti"] = f"""WITH {wide([POP])}, {PLACES}
SELECT year, state, place, {POP} FROM w WHERE place NOT IN (SELECT place FROM held)"""
ORACLES["decode_lookup"] = f"""WITH {wide([POP])}, {PLACES}
SELECT year, w.state, s_name AS place, {POP} FROM w JOIN places ON w.place = places.place"""

CLUSTERS = """cl0 AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state,
  lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS place, CAST(s_nationkey + 1 AS INTEGER) AS cluster
  FROM supplier WHERE s_acctbal > 0)"""
ENTITIES = f"""{CLUSTERS},
ent AS (SELECT state, place, cluster FROM cl0 UNION ALL
  SELECT 'vec', lpad(CAST(vec_id AS VARCHAR), 10, '0'), CAST(label + 100 AS INTEGER) FROM embeddings)"""


def sampled(source: str) -> str:
    return f"""sp AS (SELECT cluster, state, place, cluster_size,
  CASE WHEN rn <= CASE WHEN cluster_size < 10 THEN 1 ELSE cluster_size // 5 END THEN 1 ELSE 0 END AS calib
  FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_size,
        row_number() OVER (PARTITION BY cluster ORDER BY md5('123|' || state || '|' || place), state, place) AS rn
        FROM {source}))"""


ORACLES["attach_cluster"] = f"""WITH {wide([POP])}, {CLUSTERS}
SELECT year, w.state, w.place, {POP}, coalesce(cluster, 0) AS cluster
FROM w LEFT JOIN cl0 ON w.state = cl0.state AND w.place = cl0.place"""
ORACLES["cluster_sizes"] = f"WITH {ENTITIES} SELECT cluster, count(*) AS cluster_size FROM ent GROUP BY cluster"
ORACLES["distinct_sizes"] = f"""WITH {ENTITIES}
SELECT DISTINCT cluster_size FROM (SELECT count(*) AS cluster_size FROM ent GROUP BY cluster)"""
ORACLES["stratified_holdout"] = f"WITH {ENTITIES}, {sampled('ent')} SELECT * FROM sp"
ORACLES["cluster_split"] = f"""WITH {wide([POP])}, {CLUSTERS}, {sampled('cl0')}
SELECT CASE WHEN calib = 1 THEN 'calib' ELSE 'train' END AS part, year, cluster, cluster_size, count(*) AS n,
       sum({POP}) AS total
FROM w JOIN sp ON w.state = sp.state AND w.place = sp.place WHERE cluster_size > 1
GROUP BY calib, year, cluster, cluster_size"""
ORACLES["entity_labels"] = f"""WITH {wide([POP])}, {CLUSTERS}, {sampled('cl0')}
SELECT w.state, w.place, coalesce(cluster, 0) AS cluster, coalesce(calib, 0) AS calib
FROM (SELECT state, place FROM w GROUP BY state, place HAVING count(*) = 7) w
LEFT JOIN sp ON w.state = sp.state AND w.place = sp.place"""

ORACLES["history_counts"] = f"WITH {CUSTOMER} SELECT state, place, count(*) AS n FROM c GROUP BY state, place"
ORACLES["complete_history"] = f"""WITH {CUSTOMER} SELECT * EXCLUDE (segment) FROM c
QUALIFY count(*) OVER (PARTITION BY state, place) = 7"""
ORACLES["recent_history"] = f"""WITH {CUSTOMER} SELECT * EXCLUDE (segment) FROM c
QUALIFY count(*) OVER (PARTITION BY state, place) >= 5
  AND count(*) FILTER (WHERE year = 2000) OVER (PARTITION BY state, place) > 0"""

ORACLES["align_pred"] = f"""WITH {long([POP, *AGES])}
SELECT a.year, a.state, a.place, a.metric, b.value AS pred, a.value AS actual
FROM p a JOIN p b ON a.state = b.state AND a.place = b.place AND a.metric = b.metric AND a.year = b.year + 1"""

# Windows.
SERIES_YEAR = "OVER (PARTITION BY state, place, metric ORDER BY year)"
ORACLES["lags"] = f"""WITH {CUSTOMER_LONG}
SELECT year, state, place, metric, value, {', '.join(f'lag(value, {i}) {SERIES_YEAR} AS lag_{i}' for i in range(1, 7))}
FROM cl"""
ORACLES["lags_gap_aware"] = f"""WITH {CUSTOMER_LONG}
SELECT a.year, a.state, a.place, a.metric, a.value, {', '.join(f'l{i}.value AS lag_{i}' for i in range(1, 7))}
FROM cl a {' '.join(f'LEFT JOIN cl l{i} ON l{i}.state = a.state AND l{i}.place = a.place AND l{i}.metric = a.metric '
                    f'AND l{i}.year = a.year - {i}' for i in range(1, 7))}"""
ORACLES["lead_target"] = f"""WITH {CUSTOMER_LONG}
SELECT year, state, place, metric, value, lead(value) {SERIES_YEAR} AS y FROM cl"""

SERIES = "OVER (PARTITION BY state, place, metric ORDER BY period)"
LAGS = ", ".join(f"lag(value, {i}) {SERIES} AS l{i}" for i in range(1, 7))
EMA = [f"{x}" for x in ("l6", "l5", "l4", "l3", "l2", "l1", "value")]


def ema_cte(source: str) -> str:
    """CTEs ``lg`` (lags) and ``em`` (EMA as a recursion spelled out step by step)."""
    steps = "l6 AS m1"
    parts = [f"lg AS (SELECT *, {LAGS}, lead(value) {SERIES} AS y FROM {source})", f"m1 AS (SELECT *, {steps} FROM lg)"]
    for k in range(2, 8):
        parts.append(f"m{k} AS (SELECT *, CAST(2 AS DOUBLE) / 3 * {EMA[k - 1]} + (1 - CAST(2 AS DOUBLE) / 3) * m{k - 1}"
                     f" AS m{k} FROM m{k - 1})")
    parts.append("em AS (SELECT *, m3 AS ema_5, m4 AS ema_4, m5 AS ema_3, m6 AS ema_2, m7 AS ema_1 FROM m7)")
    return ",\n".join(parts)


ORACLES["ema"] = f"""WITH {QUARTERS}, {ema_cte('f')}
SELECT period, state, place, metric, {', '.join(rnd(f'ema_{i}', 6, f'ema_{i}') for i in range(5, 0, -1))} FROM em"""

ORACLES["history_vector"] = f"""WITH {QUARTERS}
SELECT period, state, place, metric, array_to_string(list_transform(
  list(value) OVER (PARTITION BY state, place, metric ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  lambda x: CAST(CAST(round(x) AS BIGINT) AS VARCHAR)), ',') AS history FROM f"""

ORACLES["window_samples"] = f"""WITH {QUARTERS},
s AS (SELECT period, state, place, sum(value) AS total, max(CASE WHEN metric = '{AGES[0]}' THEN value END) AS head,
             max(CASE WHEN metric = 'dn' THEN value END) AS dn FROM f GROUP BY period, state, place)
SELECT a.period, a.state, a.place, CAST(7 AS INTEGER) AS steps,
       round(sum(CASE WHEN b.period <= a.period THEN b.total END), 6) + 0.0 AS x_total,
       round(max(CASE WHEN b.period = a.period - 6 THEN b.head END), 6) AS x_first,
       round(max(a.dn), 6) + 0.0 AS x_last,
       round(max(CASE WHEN b.period = a.period + 1 THEN b.total END), 6) + 0.0 AS y_total
FROM s a JOIN s b ON a.state = b.state AND a.place = b.place AND b.period BETWEEN a.period - 6 AND a.period + 1
GROUP BY a.period, a.state, a.place HAVING count(*) = 8"""

TARGET = _code("S0101", 1, 10)
_own = {TARGET: "value", **{f"{TARGET}_lag_{i}": f"l{i}" for i in range(1, 7)},
        **{f"{TARGET}_ema_{i}": f"ema_{i}" for i in range(5, 0, -1)}, "y": "y"}
ORACLES["target_features"] = f"""WITH {QUARTERS}, {ema_cte('f')}
SELECT period, state, place,
  {', '.join(f"round(max(CASE WHEN metric = '{TARGET}' THEN {c} END), 6) + 0.0 AS {n}" for n, c in _own.items())},
  {', '.join(f"round(max(CASE WHEN metric = '{m}' THEN value END), 6) + 0.0 AS {m}" for m in MODEL if m != TARGET)}
FROM em GROUP BY period, state, place"""

# Scaling.
ORACLES["fit_scaler"] = f"""WITH {YEARLY_MODEL}, {STATS}
SELECT metric, {rnd('mean', 6, 'mean')}, {rnd('sd', 6, 'sd')}, {rnd('-mean / sd', 6, 'zero_value')} FROM st"""
ORACLES["standardize"] = f"""WITH {YEARLY_MODEL}, {STATS}
SELECT year, state, place, f.metric, {rnd('(value - mean) / sd')} FROM f JOIN st ON f.metric = st.metric"""
ORACLES["unstandardize"] = f"""WITH {YEARLY_MODEL}, {STATS}
SELECT year, state, place, f.metric, round(CASE WHEN f.metric = 'dn' THEN (value - mean) / sd - 0.5
  ELSE greatest((value - mean) / sd - 0.5, -mean / sd) END * sd + mean, 6) + 0.0 AS value
FROM f JOIN st ON f.metric = st.metric"""
ORACLES["scaler_artefact"] = f"""WITH {YEARLY_MODEL},
st AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS sd FROM f WHERE year >= 1998 GROUP BY metric)
SELECT f.metric, count(value) AS n, {rnd('sum((value - mean) / sd)', 6, 'total')}
FROM f JOIN st ON f.metric = st.metric WHERE year < 1998 GROUP BY f.metric"""
ORACLES["global_scale"] = f"""WITH {YEARLY_MODEL}
SELECT metric, {rnd('sum(value) / (SELECT stddev_samp(value) FROM f)', 6, 'scaled_total')},
       {rnd('sum(value) / 2', 6, 'halved_total')} FROM f GROUP BY metric"""

# Aggregates and distributions.
TOTALS = f"""{wide([POP, *AGES])},
t AS (SELECT year, '0' AS state, '0' AS place, {', '.join(f'sum({c}) AS {c}' for c in [POP, *AGES])} FROM w GROUP BY year)"""
ORACLES["totals"] = f"WITH {TOTALS} SELECT * FROM w UNION ALL SELECT * FROM t"
ORACLES["report_max"] = f"WITH {TOTALS} SELECT max({POP}) AS max_{POP}, max({AGES[0]}) AS max_{AGES[0]} FROM t"
ORACLES["age_profile"] = f"""WITH {TOTALS}, u AS (UNPIVOT t ON {', '.join(AGES)} INTO NAME age_bin VALUE population)
SELECT year, age_bin, population FROM u"""
ORACLES["exact_quantile"] = """SELECT l_returnflag, l_linestatus, level, count(*) AS n, round(CASE level
  WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25)
  WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.95) END, 6) AS value
FROM lineitem, (VALUES (CAST(0.05 AS DOUBLE)), (0.25), (0.5), (0.95)) v(level) GROUP BY l_returnflag, l_linestatus, level"""
ORACLES["weighted_quantile"] = """WITH c AS (
  SELECT l_returnflag, l_extendedprice, sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS cum
  FROM lineitem GROUP BY l_returnflag, l_extendedprice),
n AS (SELECT l_returnflag, sum(l_quantity) AS n FROM lineitem GROUP BY l_returnflag)
SELECT c.l_returnflag, level, min(l_extendedprice) AS value
FROM c JOIN n ON c.l_returnflag = n.l_returnflag, (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9)) v(level)
WHERE cum >= n * level GROUP BY c.l_returnflag, level"""

GROWTH = f"""{CUSTOMER},
gr AS (SELECT state, place, max(CASE WHEN year = 1995 THEN v END) AS a, max(CASE WHEN year = 2000 THEN v END) AS b
  FROM (SELECT year, state, place, {' + '.join(FIVE)} AS v FROM c) GROUP BY state, place)"""
ORACLES["histogram_density"] = f"""WITH {GROWTH},
x AS (SELECT (b - a) / a * 100 AS g FROM gr WHERE a IS NOT NULL AND b IS NOT NULL),
h AS (SELECT r.bin, count(g) AS n FROM range(30) r(bin) LEFT JOIN (
      SELECT g, least(floor((g + 250) / (CAST(500 AS DOUBLE) / 30)), 29) AS b FROM x WHERE g BETWEEN -250 AND 250) ON b = r.bin GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, round(-250 + bin * (CAST(500 AS DOUBLE) / 30), 6) + 0.0 AS bin_start, n,
       round(n / (sum(n) OVER () * (CAST(500 AS DOUBLE) / 30)), 6) AS density FROM h"""


def kde_of(source: str, by: str, lo: int = -8, hi: int = 10) -> str:
    """CTEs and select: curve of the values ``v`` of each ``by`` within [lo, hi], 512 bins and points."""
    width = hi - lo
    return f"""u AS (SELECT * FROM {source} WHERE v BETWEEN {lo} AND {hi}),
b AS (SELECT {by}, count(*) AS n, 0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE)
             * pow(count(*), -0.2::DOUBLE) AS bw FROM u GROUP BY {by}),
pos AS (SELECT u.{by}, (v - ({lo} - 4 * bw)) / (({width} + 8 * bw) / 511) AS z FROM u JOIN b ON u.{by} = b.{by}),
mass AS (SELECT {by}, bin, sum(m) AS m FROM (
    SELECT {by}, CAST(floor(z) AS INTEGER) AS bin, 1 - (z - floor(z)) AS m FROM pos
    UNION ALL SELECT {by}, CAST(floor(z) AS INTEGER) + 1, z - floor(z) FROM pos) GROUP BY {by}, bin),
k AS (SELECT mass.{by}, i, {lo} + i * (CAST({width} AS DOUBLE) / 511) AS x, m, bw, n,
             ({lo} + i * (CAST({width} AS DOUBLE) / 511) - ({lo} - 4 * bw + bin * (({width} + 8 * bw) / 511))) / bw AS d
      FROM mass JOIN b ON mass.{by} = b.{by}, range(0, 512) r(i))
SELECT {by}, CAST(i AS INTEGER) AS i, round(x, 6) + 0.0 AS x,
       round(sum(m * exp(-0.5::DOUBLE * d * d) / (bw * sqrt(2 * pi()))) / max(n), 6) + 0.0 AS density
FROM k GROUP BY {by}, i, x"""


ORACLES["kde"] = f"""WITH {wide([POP, *AGES])}, g AS ({groups_of('w')}),
x AS (SELECT year, {ratio('working', 'senior')} AS v FROM g), {kde_of('x', 'year')}"""

# Back-test: seven weights, oldest first.
SMOOTH = tuple(f"CAST({k} AS DOUBLE) / 21" for k in (1, 1, 2, 2, 3, 4, 8))
STEADY = tuple(f"CAST({k} AS DOUBLE)" for k in (0, 0, 0, 0, 0, 0, 1))


def scored(weights: tuple[str, ...], names: list[str]) -> str:
    return "(" + " + ".join(f"{w} * {n}" for w, n in zip(weights, names)) + ")"


def backtest(source: str, name: str = "bt", weights: tuple[str, ...] = SMOOTH) -> str:
    """CTE: each period from 8 on predicted from the seven periods before, all present."""
    joins = " ".join(
        f"JOIN {source} h{i} ON h{i}.state = a.state AND h{i}.place = a.place AND h{i}.metric = a.metric "
        f"AND h{i}.period = a.period - {i}" for i in range(7, 0, -1))
    pred = scored(weights, [f"h{i}.value" for i in range(7, 0, -1)])
    return f"""{name} AS (SELECT a.state, a.place, a.metric, a.period,
  CASE WHEN a.metric = 'dn' THEN {pred} ELSE greatest({pred}, 0) END AS pred, a.value AS actual
  FROM {source} a {joins} WHERE a.period BETWEEN 8 AND 27)"""


BT_AGES = f"{QUARTERS_AGES}, {backtest('f')}"
BT_MODEL = f"{QUARTERS}, {backtest('f')}"

ORACLES["backtest_linear"] = ORACLES["score_sequences"] = f"""WITH {BT_MODEL}
SELECT period, state, place, metric, {rnd('pred', 6, 'pred')}, {rnd('actual', 6, 'actual')} FROM bt"""
ORACLES["mae"] = f"WITH {BT_AGES} SELECT metric, {rnd('avg(abs(pred - actual))', 6, 'mae')} FROM bt GROUP BY metric"


def mape(source: str, by: str) -> str:
    return f"""er AS (SELECT {by}, abs(pred - actual) / (1 + actual) AS e FROM {source}),
cu AS (SELECT {by}, quantile_cont(e, 0.95) AS cut FROM er GROUP BY {by}),
mp AS (SELECT {', '.join(f'er.{c.strip()}' for c in by.split(','))}, avg(CASE WHEN e <= cut THEN e END) * 100 AS mape
       FROM er JOIN cu ON {' AND '.join(f'er.{c.strip()} = cu.{c.strip()}' for c in by.split(','))} GROUP BY {', '.join(f'er.{c.strip()}' for c in by.split(','))})"""


ORACLES["trimmed_mape"] = f"WITH {BT_AGES}, {mape('bt', 'metric')} SELECT metric, {rnd('mape', 6, 'mape')} FROM mp"
ORACLES["regression_metrics"] = f"""WITH {BT_AGES}
SELECT metric, {rnd('sqrt(avg((pred - actual) * (pred - actual)))', 6, 'rmse')},
       {rnd('pow(corr(pred, actual), 2)', 6, 'r2')}, {rnd('avg(abs(pred - actual))', 6, 'mae')} FROM bt GROUP BY metric"""


def huber(q: str) -> str:
    return f"""hb AS (SELECT period, state, place, CASE WHEN actual - pred >= 0
    THEN sqrt({q} * {q} * (actual - pred) * (actual - pred) + 1) - 1
    ELSE -(sqrt((1 - {q}) * (1 - {q}) * (actual - pred) * (actual - pred) + 1) - 1) END AS s, pred, actual FROM bt),
ql AS (SELECT period, state, place, avg(abs(s)) AS q_loss, abs(avg(s)) AS m_loss,
    1 - (2 * stddev_pop(pred) * stddev_pop(actual) + 1e-8) / (stddev_pop(pred) * stddev_pop(pred) + stddev_pop(actual) * stddev_pop(actual) + 1e-8)
      * (covar_pop(pred, actual) + 1e-8) / (stddev_pop(pred) * stddev_pop(actual) + 1e-8) AS s_loss
    FROM hb GROUP BY period, state, place)"""


ORACLES["pseudo_huber"] = f"""WITH {BT_AGES}, {huber('CAST(0.6 AS DOUBLE)')}
SELECT period, state, place, {rnd('q_loss', 6, 'q_loss')}, {rnd('m_loss', 6, 'm_loss')} FROM ql"""
ORACLES["ssim_loss"] = f"""WITH {BT_AGES}, {huber('CAST(0.6 AS DOUBLE)')}
SELECT period, state, place, {rnd('s_loss', 6, 's_loss')} FROM ql"""
ORACLES["combined_loss"] = f"""WITH {BT_AGES}, {huber('CAST(0.4 AS DOUBLE)')}
SELECT period, state, place, {rnd('q_loss + m_loss * s_loss', 6, 'loss')} FROM ql"""


def qhat(source: str) -> str:
    """CTE ``qh``: conformal quantile of ``score`` per target and alpha, by rank and interpolation."""
    return f"""rk AS (SELECT target, alpha, score, row_number() OVER (PARTITION BY target, alpha ORDER BY score) - 1 AS k,
  count(*) OVER (PARTITION BY target, alpha) AS n FROM {source}),
lv AS (SELECT *, (n - 1) * least(1, (n + 1) * (1 - alpha) / n) AS h, (n + 1) * (1 - alpha) / n > 1 AS clamped FROM rk),
qh AS (SELECT target, alpha, n, clamped,
  max(CASE WHEN k = floor(h) THEN score END) + (max(h) - floor(max(h)))
    * (max(CASE WHEN k = ceil(h) THEN score END) - max(CASE WHEN k = floor(h) THEN score END)) AS qhat
  FROM lv GROUP BY target, alpha, n, clamped)"""


ORACLES["conformal_qhat"] = f"""WITH {BT_AGES},
sc AS (SELECT metric AS target, alpha, abs(pred - actual) AS score
       FROM bt, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2), (0.45)) v(alpha)), {qhat('sc')}
SELECT target, alpha, n, {rnd('qhat', 6, 'qhat')}, clamped FROM qh"""

CQR = f"""{BT_MODEL},
qp AS (SELECT state, place, period, metric AS target, q, pred * (1 + CAST(0.4 AS DOUBLE) * (q - 0.5)) AS pred, actual AS y
  FROM bt, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2), (0.45), (0.5), (0.55), (0.8), (0.9), (0.95)) v(q)),
sc AS (SELECT lo.target, lo.q AS alpha, greatest(lo.pred - lo.y, hi.y - hi.pred) AS score
  FROM qp lo JOIN qp hi ON lo.state = hi.state AND lo.place = hi.place AND lo.period = hi.period
       AND lo.target = hi.target AND round(1 - lo.q, 6) = hi.q WHERE lo.q < 0.5),
{qhat('sc')}"""
ORACLES["cqr_calibrate"] = f"WITH {CQR} SELECT target, alpha, n, {rnd('qhat', 6, 'qhat')}, clamped FROM qh"
ORACLES["cqr_adjust"] = f"""WITH {CQR},
mv AS (SELECT qp.target AS metric, qp.q, qp.period, CASE WHEN qp.q < 0.5 THEN pred - qhat
    WHEN qp.q > 0.5 THEN pred + qhat ELSE pred END AS v
  FROM qp LEFT JOIN qh ON qp.target = qh.target AND round(least(qp.q, 1 - qp.q), 6) = qh.alpha)
SELECT metric, q, period, count(*) AS n, round(sum(CASE WHEN metric = 'dn' THEN v ELSE greatest(v, 0) END), 6) + 0.0 AS total
FROM mv GROUP BY metric, q, period"""


def projection(source: str, steps: int, name: str = "pj", weights: tuple[str, ...] = SMOOTH) -> str:
    """CTE: recursive projection after period 27, a 7-value window carried along."""
    hist = ", ".join(f"max(CASE WHEN period = {21 + i} THEN value END) AS h{i}" for i in range(7))
    nxt = f"{scored(weights, [f'h{i}' for i in range(7)])} * (1 + CAST(0.1 AS DOUBLE) * (q - 0.5))"
    nxt = f"CASE WHEN metric = 'dn' THEN {nxt} ELSE greatest({nxt}, 0) END"
    return f"""{name} AS (
  SELECT state, place, metric, q, CAST(27 AS INTEGER) AS period, {', '.join(f'h{i}' for i in range(7))}
  FROM (SELECT state, place, metric, {hist} FROM {source} WHERE period BETWEEN 21 AND 27
        GROUP BY state, place, metric HAVING count(*) = 7), (VALUES (CAST(0.4 AS DOUBLE)), (0.5), (0.6)) v(q)
  UNION ALL
  SELECT state, place, metric, q, period + 1, {', '.join(f'h{i}' for i in range(1, 7))}, {nxt}
  FROM {name} WHERE period < {27 + steps})"""


ORACLES["project_linear"] = ORACLES["project_sequences"] = f"""WITH RECURSIVE {QUARTERS}, {projection('f', 39)}
SELECT state, place, metric, q, period, {rnd('h6')} FROM pj WHERE period > 27"""

EVAL_CASE = "CASE metric " + " ".join(f"WHEN '{a}' THEN {i + 1}" for i, a in enumerate(AGES)) + " ELSE 19 END"
EVAL_LABEL = "CASE metric " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(AGES, LABELS)) + " ELSE 'Total' END"
ORACLES["evaluation_table"] = f"""WITH {QUARTERS_AGES}, {backtest('f', 'b1')},
{backtest('f', 'b2', STEADY)},
m0 AS (SELECT 'smooth' AS model, * FROM b1 UNION ALL SELECT 'steady', * FROM b2),
al AS (SELECT model, period, state, place, metric, pred, actual FROM m0 UNION ALL
       SELECT model, period, state, place, 'Total', sum(pred), sum(actual) FROM m0 GROUP BY model, period, state, place),
{mape('al', 'model, metric')},
ma AS (SELECT model, metric, avg(abs(pred - actual)) AS mae FROM al GROUP BY model, metric),
tb AS (SELECT {EVAL_CASE} AS sort, {EVAL_LABEL} AS label,
   max(CASE WHEN ma.model = 'smooth' THEN mae END) AS mae_smooth, max(CASE WHEN ma.model = 'steady' THEN mae END) AS mae_steady,
   max(CASE WHEN ma.model = 'smooth' THEN mape END) AS mape_smooth, max(CASE WHEN ma.model = 'steady' THEN mape END) AS mape_steady
   FROM (SELECT ma.model, ma.metric, mae, mape FROM ma JOIN mp ON ma.model = mp.model AND ma.metric = mp.metric) ma GROUP BY metric),
fu AS (SELECT * FROM tb WHERE sort < 19 UNION ALL
   SELECT 19, 'Mean', avg(mae_smooth), avg(mae_steady), avg(mape_smooth), avg(mape_steady) FROM tb WHERE sort < 19 UNION ALL
   SELECT 20, label, mae_smooth, mae_steady, mape_smooth, mape_steady FROM tb WHERE sort = 19)
SELECT CAST(sort AS INTEGER) AS sort, label, round_even(mae_smooth, 6) AS mae_smooth, round_even(mae_steady, 6) AS mae_steady,
       round_even(mape_smooth, 6) AS mape_smooth, round_even(mape_steady, 6) AS mape_steady FROM fu"""

_pivot = ", ".join(f"max(CASE WHEN metric = '{m}' THEN h6 END) AS {m}" for m in AGES)
REPORTS = f"""{QUARTERS_AGES}, {projection('f', 39, 'p1')},
{projection('f', 39, 'p2', STEADY)},
pw AS (SELECT model, q, period AS year, state, place, {_pivot}
  FROM (SELECT 'smooth' AS model, q, period, state, place, metric, h6 FROM p1 WHERE period > 27
        UNION ALL SELECT 'steady', q, period, state, place, metric, h6 FROM p2 WHERE period > 27
        UNION ALL SELECT model, q, period, state, place, metric, value FROM f, (VALUES ('smooth'), ('steady')) m(model),
          (VALUES (CAST(0.4 AS DOUBLE)), (0.5), (0.6)) v(q))
  GROUP BY model, q, period, state, place),
pt AS (SELECT * FROM pw UNION ALL SELECT model, q, year, '0', '0', {', '.join(f'sum({m})' for m in AGES)}
  FROM pw GROUP BY model, q, year),
rs AS (SELECT model, CASE q WHEN 0.4 THEN 'Lower' WHEN 0.5 THEN 'Middle' ELSE 'Upper' END AS quantile, year, state, place,
  {', '.join(f"{' + '.join(cols)} AS {g}" for g, cols in GROUPS.items())}, {' + '.join(AGES)} AS total FROM pt)"""
ORACLES["projection_report"] = f"""WITH RECURSIVE {REPORTS}
SELECT model, quantile, year, state, place, {rnd(ratio('working', 'senior'), 6, 'working_senior_ratio')},
       CASE quantile WHEN 'Upper' THEN 1 WHEN 'Middle' THEN 2 ELSE 3 END AS quantile_order FROM rs"""
ORACLES["ratio_distribution"] = f"""WITH RECURSIVE {REPORTS},
x AS (SELECT CASE WHEN year > 27 THEN year || '_' || model ELSE CAST(year AS VARCHAR) END AS type, {ratio('working', 'senior')} AS v FROM rs
      WHERE quantile = 'Middle' AND place <> '0' AND year IN (27, 28, 66) AND (year > 27 OR model = 'smooth')), {kde_of('x', 'type')}"""
_cmp = ", ".join(
    f"round(max(CASE WHEN model = '{m}' AND quantile = '{q}' THEN total END), 6) + 0.0 AS total_{q.lower()}_{m}"
    for m in ("smooth", "steady") for q in ("Lower", "Middle", "Upper"))
ORACLES["compare_projections"] = f"""WITH RECURSIVE {REPORTS}
SELECT year, state, place, {_cmp} FROM rs GROUP BY year, state, place"""

ORACLES["descriptive_report"] = f"""WITH {TOTALS}, z AS (SELECT * FROM w UNION ALL SELECT * FROM t), g AS ({groups_of('z')}),
j AS (SELECT g.* EXCLUDE (total), z.{POP}, z.{POP} AS total FROM g JOIN z ON g.year = z.year AND g.state = z.state AND g.place = z.place)
SELECT year, state, place, {POP}, youth, working, senior, {RATIOS} FROM j"""

ORACLES["composition"] = f"""WITH {TOTALS}, g AS ({groups_of('t')}),
s AS (SELECT *, {RATIOS} FROM g)
SELECT year, age_group, CASE age_group WHEN 'youth' THEN youth WHEN 'working' THEN working ELSE senior END AS population,
       ratio_type, CASE ratio_type WHEN 'working_total_ratio' THEN working_total_ratio ELSE senior_total_ratio END AS ratio
FROM s, (VALUES ('youth'), ('working'), ('senior')) a(age_group),
     (VALUES ('working_total_ratio'), ('senior_total_ratio')) b(ratio_type)"""
ORACLES["growth_density"] = f"""WITH {wide([POP])},
x AS (SELECT 'growth' AS kind, (max(CASE WHEN year = 2000 THEN {POP} END) - max(CASE WHEN year = 1995 THEN {POP} END))
             / max(CASE WHEN year = 1995 THEN {POP} END) * 100 AS v
      FROM w GROUP BY state, place HAVING count(*) = 7), {kde_of('x', 'kind', -250, 250)}"""

def _soft_dtw(steps: int, gamma: float = 0.01) -> str:
    """One table for each anti-diagonal of the soft-DTW recursion, ``t1`` holding the series ``v`` and centres ``u``."""
    border = lambda i, j: ("0::DOUBLE" if i == j == 0 else "'inf'::DOUBLE") if not i or not j else f"r_{i}_{j}"
    tables = []
    for k in range(2, 2 * steps + 1):
        cells = []
        for i in range(max(1, k - steps), min(steps, k - 1) + 1):
            j = k - i
            before = [border(i - 1, j - 1), border(i - 1, j), border(i, j - 1)]
            low = f"least({', '.join(before)})"
            soft = " + ".join(f"exp(-({b} - {low}) / {gamma}::DOUBLE)" for b in before)
            d = " + ".join(f"pow(v[{i}][{m}] - u[{j}][{m}], 2)" for m in (1, 2, 3))
            cells.append(f"{d} + {low} - {gamma}::DOUBLE * ln({soft}) AS r_{i}_{j}")
        tables.append(f"t{k} AS MATERIALIZED (SELECT *, {', '.join(cells)} FROM t{k - 1})")
    return ",\n".join(tables)


ORACLES["series_distances_yearly"] = f"""WITH {wide([POP, WOMEN, BIRTHS])},
s AS (SELECT state, place, list([{POP}, {WOMEN}, {BIRTHS}] ORDER BY year) AS v FROM w GROUP BY state, place HAVING count(*) = 7),
c AS (SELECT v AS u, row_number() OVER (ORDER BY md5(state || '|' || place)) AS centre FROM s QUALIFY centre <= 5),
t1 AS MATERIALIZED (SELECT state, place, CAST(centre AS INTEGER) AS centre, v, u FROM s, c),
{_soft_dtw(7)}
SELECT state, place, centre, {rnd('r_7_7', 6, 'distance')} FROM t14"""

ORACLES["segment_report"] = f"""WITH {CUSTOMER},
s AS (SELECT year, state, segment AS place, {', '.join(f'sum({m}) AS {m}' for m in FIVE)} FROM c GROUP BY year, state, segment),
a AS (SELECT * FROM s UNION ALL SELECT year, '0', '0', {', '.join(f'sum({m})' for m in FIVE)} FROM s GROUP BY year),
g AS (SELECT year, state, place, {FIVE[0]} + {FIVE[1]} AS youth, {FIVE[2]} + {FIVE[3]} AS working, {FIVE[4]} AS senior,
      {' + '.join(FIVE)} AS total FROM a)
SELECT year, state, place, total, youth, working, senior, {RATIOS} FROM g"""

ORACLES["stage_tables"] = f"""WITH {CUSTOMER}
SELECT year, state, segment AS place, {', '.join(rnd(f'coalesce(sum({m}), 0)', 6, m) for m in FIVE)}
FROM c GROUP BY year, state, segment"""

_keep = [c for c in sorted([*S0101, *S0701, *S1301]) if c[:9] not in ("S1301_C03", "S1301_C04") and not (
    c[:5] == "S0701" and c[10:] in ("011E", "048E")) and c not in ("S1301_C01_031E", "S1301_C01_032E")]


def _prepared(c: str) -> str:
    if c[:5] == "S0701" and c[6:9] != "C01":
        return f"{c} * S0701_C01_{c[10:]} / 100"
    if c[:9] == "S1301_C05":
        return f"{c} * S1301_C02_{c[10:]} / 100"
    return c


_sums = {f"S0701_C06_{x:03d}E": " + ".join(_prepared(_code("S0701", c, x)) for c in range(2, 6)) for x in (1, 2, 3)}
ORACLES["prepare_panel"] = f"""WITH {wide(sorted([*S0101, *S0701, *S1301]))},
d AS (SELECT year, state, place, {', '.join(f'{_prepared(c)} AS {c}' for c in _keep)},
      {', '.join(f'{x} AS {n}' for n, x in _sums.items())} FROM w),
e AS (SELECT *, coalesce({POP} - lag({POP}) OVER (PARTITION BY state, place ORDER BY year) - {MIG} - {BIRTHS}, 0) AS dn FROM d),
e1 AS (SELECT * FROM e WHERE year <> 1995), {melt('e1', 'x')}
SELECT year, metric, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM x GROUP BY year, metric"""

ORACLES["collect_stage"] = f"""WITH {OLD}, {PLACES},
cells AS (SELECT year, state, place, new_metric AS metric, {PCT} AS value FROM old
          UNION ALL SELECT year, state, place, metric, value FROM new),
named AS (SELECT CASE WHEN h.place IS NULL THEN 'training' ELSE 'held' END AS panel, year, metric, value,
                 coalesce(h.s_name, cells.place) AS place FROM cells LEFT JOIN held h ON cells.place = h.place)
SELECT panel, year, metric, count(*) AS n, round(sum(value), 6) + 0.0 AS total, max(place) AS last_place
FROM named GROUP BY panel, year, metric"""

# Full width, and one release at a time.
FULL_TABLES = ("(VALUES ('S0101', 1, 19), ('S0101', 3, 19), ('S0101', 5, 19), "
               + ", ".join(f"('S0701', {c}, 53)" for c in range(1, 6)) + ", " + ", ".join(f"('S1301', {c}, 32)" for c in range(1, 6)) + ") t(tbl, col, n)")
NAME = "printf('%s_C%02d_%03dE', tbl, col, row)"
FULL = f"""{LI},
fc0 AS (SELECT year, state, place, l_quantity, tbl, col, unnest([1, 2 + (l_partkey * col + l_linenumber) % (n - 1)]) AS row
        FROM li, {FULL_TABLES}),
fc AS (SELECT year, state, place, {NAME} AS metric, CAST(sum(l_quantity) AS DOUBLE) AS value FROM fc0 GROUP BY ALL),
codes AS (SELECT {NAME} AS metric FROM (SELECT tbl, col, unnest(range(1, n + 1)) AS row FROM {FULL_TABLES})),
fw AS (SELECT DISTINCT year, state, place FROM fc),
fg AS (SELECT fw.*, codes.metric, fc.value FROM fw CROSS JOIN codes LEFT JOIN fc ON fc.year = fw.year AND fc.state = fw.state
       AND fc.place = fw.place AND fc.metric = codes.metric)"""


def full_prepared(source: str) -> str:
    """Totals by year and measure of the prepared panel, from dense cells."""
    counted = "regexp_matches(metric, '^S0701_C0[2-5]') AND substr(metric, 11) NOT IN ('011E', '048E')"
    return f"""fs AS (SELECT g.year, g.state, g.place, g.metric, CASE WHEN b.metric IS NULL THEN g.value ELSE b.value * g.value / 100 END AS value
  FROM {source} g LEFT JOIN {source} b ON b.year = g.year AND b.state = g.state AND b.place = g.place
       AND b.metric = CASE WHEN {counted.replace('metric', 'g.metric')} THEN 'S0701_C01_' || substr(g.metric, 11)
                           WHEN g.metric LIKE 'S1301_C05%' THEN 'S1301_C02_' || substr(g.metric, 11) END),
fsum AS (SELECT year, state, place, 'S0701_C06_' || substr(metric, 11) AS metric,
                CASE WHEN count(value) = 4 THEN sum(value) END AS value FROM fs WHERE {counted} GROUP BY ALL),
fall AS (SELECT * FROM fs WHERE NOT regexp_matches(metric, '^S1301_C0[34]|^S0701_C.._(011|048)E|^S1301_C01_03[12]E')
         UNION ALL SELECT * FROM fsum),
fn AS (SELECT year, state, place, max(value) FILTER (WHERE metric = '{POP}') AS pop, max(value) FILTER (WHERE metric = '{MIG}') AS mig,
              max(value) FILTER (WHERE metric = '{BIRTHS}') AS births FROM fall GROUP BY ALL),
fdn AS (SELECT year, state, place, 'dn' AS metric,
               pop - lag(pop) OVER (PARTITION BY state, place ORDER BY year) - mig - births AS value FROM fn),
fx AS (SELECT year, metric, coalesce(value, 0) AS value FROM (SELECT * FROM fall UNION ALL SELECT * FROM fdn) WHERE year <> 1995)
SELECT year, metric, count(*) AS n, count(*) FILTER (WHERE value <> 0) AS n_filled, round(sum(value), 6) + 0.0 AS total
FROM fx GROUP BY year, metric"""


ORACLES["prepare_full_width"] = f"WITH {FULL}, {full_prepared('fg')}"

ORACLES["collect_full_width"] = f"""WITH {FULL},
fb AS (SELECT g.year, g.state, g.place, g.metric, CASE WHEN g.value IS NULL THEN 0.0
    WHEN g.year < 1998 AND g.metric LIKE 'S0101%' AND g.metric NOT LIKE '%_001E'
      THEN round_even(b.value * round(g.value * 100 / b.value, 1) / 100, 0) ELSE g.value END AS value
  FROM fg g LEFT JOIN fc b ON b.year = g.year AND b.state = g.state AND b.place = g.place AND b.metric = substr(g.metric, 1, 10) || '001E'),
{full_prepared('fb')}"""

ORACLES["release_quality"] = f"""WITH {FULL},
q AS (SELECT year, substr(metric, 1, 5) AS tbl, count(DISTINCT state || place) AS n_rows, count(*) AS cells,
             count(*) - count(value) AS missing FROM fg GROUP BY ALL)
SELECT year, tbl, n_rows, cells, CASE tbl WHEN 'S1301' THEN missing ELSE 0 END AS empty,
       CASE tbl WHEN 'S0701' THEN missing ELSE 0 END AS no_number, CASE tbl WHEN 'S0101' THEN missing ELSE 0 END AS sentinel FROM q"""

ORACLES["codebook_layouts"] = f"""WITH {FULL},
laid AS (SELECT CASE WHEN year < 1998 THEN 'old' ELSE 'new' END AS layout,
    CASE WHEN year >= 1998 THEN metric WHEN metric LIKE 'S0101_C03%' THEN replace(metric, '_C03_', '_C02_')
         WHEN metric LIKE 'S0101_C05%' THEN replace(metric, '_C05_', '_C03_') ELSE metric END AS metric, value FROM fc),
names AS (SELECT 'new' AS layout, metric FROM codes UNION ALL
  SELECT 'old', CASE WHEN metric LIKE 'S0101_C03%' THEN replace(metric, '_C03_', '_C02_')
                     WHEN metric LIKE 'S0101_C05%' THEN replace(metric, '_C05_', '_C03_') ELSE metric END FROM codes)
SELECT n.layout, n.metric, substr(n.metric, 1, 5) AS tbl, CAST(substr(n.metric, 8, 2) AS INTEGER) AS col,
       CAST(substr(n.metric, 11, 3) AS INTEGER) AS row, CASE WHEN count(value) > 0 THEN count(value) END AS n, sum(value) AS total
FROM names n LEFT JOIN laid l ON l.layout = n.layout AND l.metric = n.metric GROUP BY n.layout, n.metric"""

ORACLES["feature_state"] = f"""WITH {QUARTERS}, {ema_cte('f')}
SELECT period, state, place, metric, {rnd('value')}, {', '.join(rnd(f'l{i}', 6, f'lag_{i}') for i in range(1, 7))},
       {', '.join(rnd(f'ema_{i}', 6, f'ema_{i}') for i in range(5, 0, -1))} FROM em WHERE period >= 25"""

ORACLES["scaler_merge"] = f"""WITH {YEARLY_MODEL}, {STATS}
SELECT metric, {rnd('mean', 6, 'mean')}, {rnd('sd', 6, 'sd')}, {rnd('-mean / sd', 6, 'zero_value')},
       {rnd('(SELECT stddev_samp(value) FROM f)', 6, 'sd_all')} FROM st"""

ORACLES["replace_release"] = f"""WITH {CUSTOMER},
r AS (SELECT year, state, place, {', '.join(f'CASE WHEN year = 1999 THEN {m} + 1 ELSE {m} END AS {m}' for m in FIVE)} FROM c)
SELECT *, lag({FIVE[0]}) OVER (PARTITION BY state, place ORDER BY year) AS lag_1,
       lag({FIVE[0]}, 2) OVER (PARTITION BY state, place ORDER BY year) AS lag_2 FROM r"""
