"""Reference SQL (DuckDB dialect) for every query in ``catalog.QUERIES``.

Each statement recomputes the same result from the raw tables with plain
SQL: window row_number for first occurrences, quantile_cont for cut
points, CASE chains for segments, format() for text. Rounding uses
``round_even(x * 10^d, 0) / 10^d`` (ties to even on the scaled value), the
same recipe as the Spark side.
"""

from __future__ import annotations

import re

from tiercraft import config

# -- record tables (FIXTURES.md) --------------------------------------------

FX_PLAYERS = r"""
fx_players AS (
  SELECT concat('P', CAST(c_custkey AS VARCHAR)) AS PlayerID, c_name AS FullName,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
           / count(DISTINCT o_orderdate) / 1000 AS NetADT,
         date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-02 00:00:00') AS DaysSinceLastVisit,
         CASE WHEN c_custkey % 4 = 0 THEN 'YES' WHEN c_custkey % 4 = 1 THEN ' no '
              WHEN c_custkey % 4 = 2 THEN 'y' END AS CanEmail,
         CASE WHEN c_custkey % 30 = 0 THEN NULL WHEN c_custkey % 30 = 1 THEN ''
              ELSE c_mktsegment END AS ZipCode,
         c_custkey AS _row_order
  FROM customer JOIN orders ON c_custkey = o_custkey
  GROUP BY c_custkey, c_name, c_mktsegment)"""

FX_DIRTY = FX_PLAYERS + r""",
fx_players_dirty AS (
  SELECT CASE WHEN _row_order % 97 = 0 THEN NULL WHEN _row_order % 89 = 0 THEN ' nan '
              ELSE concat(' ', PlayerID) END AS PlayerID,
         FullName, CASE WHEN _row_order % 20 = 0 THEN NULL ELSE NetADT END AS NetADT,
         DaysSinceLastVisit, CanEmail, ZipCode, _row_order FROM fx_players
  UNION ALL
  SELECT PlayerID, FullName, NetADT, DaysSinceLastVisit, CanEmail, ZipCode,
         _row_order + 4611686018427387904 FROM fx_players WHERE _row_order % 50 = 0)"""

FX_PRIOR = r"""
fx_prior AS (
  SELECT concat('P', CAST(o_custkey AS VARCHAR)) AS PlayerID,
         CASE WHEN o_custkey % 40 = 0 THEN 0
              ELSE CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 END AS NetADT,
         o_custkey AS _row_order
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-15 00:00:00' GROUP BY o_custkey)"""

FX_CURRENT = r"""
fx_current AS (
  SELECT concat('P', CAST(o_custkey AS VARCHAR)) AS PlayerID,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS NetADT,
         o_custkey AS _row_order
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-15 00:00:00' GROUP BY o_custkey)"""

FX_COMPANIES = r"""
fx_companies AS (
  SELECT concat('A', CAST(s_suppkey AS VARCHAR)) AS AccountID, s_name AS FullName,
         n_name AS Industry,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))
                  * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS AnnualRevenue,
         CAST((s_suppkey % 30) * 1000 AS DOUBLE) AS Debt,
         CASE WHEN s_suppkey % 33 = 0 THEN 0 ELSE 5000 + s_acctbal END AS Equity,
         s_suppkey % 26 AS MonthsSinceContact,
         CASE WHEN s_suppkey % 3 = 0 THEN 'High Risk' ELSE 'Low Risk' END AS RiskTier,
         s_suppkey AS _row_order
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY s_suppkey, s_name, s_acctbal, n_name)"""

FX_CUSTOM = r"""
fx_custom AS (
  SELECT p_partkey AS ref_id, p_name AS label,
         CASE WHEN p_partkey % 40 = 0 THEN 'n/a'
              ELSE concat('$', CAST(p_retailprice AS VARCHAR)) END AS worth,
         p_size AS recency_days, p_partkey AS _row_order
  FROM part)"""

FX_OFFERS = r"""
fx_offers AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS OfferSlots,
         sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS OfferTables,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS OfferFood,
         sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS OfferHotel
  FROM lineitem GROUP BY l_orderkey)"""

MONEY = r"TRY_CAST(nullif(regexp_replace({c}, '[^0-9.\-]', '', 'g'), '') AS DOUBLE)"


def money(expr: str) -> str:
    return f"('$' || coalesce(format('{{:,.2f}}', {expr}), 'nan'))"


def fixed(expr: str, d: int) -> str:
    return f"coalesce(format('{{:.{d}f}}', CAST({expr} AS DOUBLE)), 'nan')"


def r_even(expr: str, d: int) -> str:
    s = float(10 ** d)
    return f"(round_even(({expr}) * {s}, 0) / {s})"


CONSENT = ("CASE WHEN lower(trim(CanEmail)) = 'yes' THEN 'Yes' "
           "WHEN lower(trim(CanEmail)) = 'no' THEN 'No' ELSE 'Unknown' END AS CanEmail")


def _classified(src: str, idc: str) -> str:
    return f"""
{src}_keyed AS (
  SELECT *, CASE WHEN {idc} IS NULL OR trim(CAST({idc} AS VARCHAR)) IN ('', 'nan', 'None', 'NaN')
                 THEN NULL ELSE trim(CAST({idc} AS VARCHAR)) END AS _key FROM {src}),
{src}_class AS (
  SELECT *, CASE WHEN _key IS NULL THEN 'Missing {idc}'
                 WHEN row_number() OVER (PARTITION BY _key ORDER BY _row_order) > 1
                 THEN 'Duplicate {idc} (first occurrence kept)' END AS QuarantineReason
  FROM {src}_keyed)"""


DIRTY_CLEAN = FX_DIRTY + "," + _classified("fx_players_dirty", "PlayerID") + r""",
dirty_kept AS (
  SELECT PlayerID, FullName, NetADT, DaysSinceLastVisit, CanEmail, ZipCode, _row_order
  FROM fx_players_dirty_class WHERE QuarantineReason IS NULL),
dirty_med AS (SELECT median(NetADT) AS med, count(*) FILTER (WHERE NetADT IS NULL) AS imputed,
                     count(*) FILTER (WHERE ZipCode IS NULL OR trim(ZipCode) = '') AS flagged
              FROM dirty_kept),
dirty_clean AS (
  SELECT PlayerID, FullName, coalesce(NetADT, med) AS NetADT, DaysSinceLastVisit, """ + CONSENT + r""",
         CASE WHEN ZipCode IS NULL OR ZipCode = '' THEN 'MISSING' ELSE ZipCode END AS ZipCode,
         _row_order
  FROM dirty_kept, dirty_med)"""


def _players_segment(src: str, out: str, recency: bool = True) -> str:
    r = "DaysSinceLastVisit" if recency else "0"
    return f"""
{out}_cut AS (SELECT quantile_cont(NetADT, 0.75) AS cut FROM {src}),
{out} AS (
  SELECT s.*, CASE WHEN NetADT IS NULL THEN 'Needs Review'
                   WHEN {r} > 180 THEN (CASE WHEN NetADT >= cut THEN 'At Risk High Value'
                                               ELSE 'Churned Low Value' END)
                   WHEN NetADT >= cut THEN 'VIP High Value'
                   WHEN {r} <= 30 THEN 'Active Developing'
                   ELSE 'Casual' END AS Segment
  FROM {src} s, {out}_cut)"""


def _trend(src: str, out: str) -> str:
    pct = r_even("(s.NetADT - p.NetADT) / nullif(p.NetADT, 0) * 100", 1)
    return f"""
{out}_j AS (
  SELECT s.*, p.NetADT AS NetADT_Prev, {pct} AS TrendPct
  FROM {src} s LEFT JOIN fx_prior p ON trim(s.PlayerID) = trim(p.PlayerID)),
{out} AS (
  SELECT *, CASE WHEN TrendPct IS NULL THEN 'No prior data' WHEN TrendPct <= -15 THEN 'Declining'
                 WHEN TrendPct >= 15 THEN 'Rising' ELSE 'Stable' END AS Trend FROM {out}_j)"""


PLAYERS_SEG = FX_PLAYERS + "," + FX_PRIOR + r""",
players_med AS (SELECT median(NetADT) AS med FROM fx_players),
players_clean AS (
  SELECT PlayerID, FullName, coalesce(NetADT, med) AS NetADT, DaysSinceLastVisit, """ + CONSENT + r""",
         CASE WHEN ZipCode IS NULL OR ZipCode = '' THEN 'MISSING' ELSE ZipCode END AS ZipCode,
         _row_order
  FROM fx_players, players_med),""" + _players_segment("players_clean", "players_s") + "," + \
    _trend("players_s", "pseg")

COMPANIES_SEG = FX_COMPANIES + r""",
companies_med AS (SELECT median(AnnualRevenue) AS med FROM fx_companies),
companies_clean AS (
  SELECT AccountID, FullName,
         CASE WHEN Industry IS NULL OR Industry = '' THEN 'MISSING' ELSE Industry END AS Industry,
         coalesce(AnnualRevenue, med) AS AnnualRevenue, Debt, Equity, MonthsSinceContact,
         RiskTier, _row_order
  FROM fx_companies, companies_med),
companies_cut AS (SELECT quantile_cont(AnnualRevenue, 0.75) AS cut FROM companies_clean),
companies_dte AS (
  SELECT c.*, """ + r_even("Debt / nullif(Equity, 0)", 2) + r""" AS DebtToEquity
  FROM companies_clean c),
cseg AS (
  SELECT c.*, CASE WHEN AnnualRevenue IS NULL THEN 'Needs Review'
                   WHEN DebtToEquity > 1.5 THEN (CASE WHEN AnnualRevenue >= cut
                        THEN 'High Value At Risk' ELSE 'Leveraged Watchlist' END)
                   WHEN AnnualRevenue >= cut THEN 'Strategic Account'
                   WHEN MonthsSinceContact > 12 THEN 'Dormant'
                   ELSE 'Standard' END AS Segment
  FROM companies_dte c, companies_cut)"""

CUSTOM_VALUES = FX_CUSTOM + r""",
custom_v AS (
  SELECT ref_id, label, """ + MONEY.format(c="worth") + r""" AS worth,
         CAST(recency_days AS DOUBLE) AS _recency, _row_order FROM fx_custom),
custom_q AS (SELECT quantile_cont(worth, 0.75) AS cut, quantile_cont(worth, 0.25) AS low,
                    median(_recency) AS med FROM custom_v)"""

CUSTOM_SEG = CUSTOM_VALUES + r""",
useg AS (
  SELECT v.*, CASE WHEN worth IS NULL THEN 'Needs Review'
       WHEN worth >= cut THEN (CASE WHEN coalesce(_recency > med, false)
                                    THEN 'High Value At Risk' ELSE 'High Value Active' END)
       WHEN worth <= low THEN (CASE WHEN coalesce(_recency > med, false)
                                    THEN 'Low Value Lapsed' ELSE 'Low Value' END)
       ELSE (CASE WHEN coalesce(_recency > med, false) THEN 'Mid Tier Lapsed' ELSE 'Mid Tier' END)
       END AS Segment
  FROM custom_v v, custom_q)"""


def say(template: str, **parts: str) -> str:
    """SQL text expression of a sentence template; parts are SQL expressions."""
    out = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            out.append(parts[piece])
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _meaning(pairs: dict[str, str]) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE Segment {body} ELSE '' END"


def _lines(parts: list[tuple[str, str]]) -> str:
    """Numbered lines from (line expression, FROM/WHERE tail) parts, skipping
    parts whose WHERE filters them out."""
    unions = " UNION ALL ".join(
        f"SELECT {i} AS _ord, {expr} AS line {tail}" for i, (expr, tail) in enumerate(parts))
    return (f"SELECT CAST(row_number() OVER (ORDER BY _ord) AS BIGINT) AS line_no, line "
            f"FROM ({unions}) x")


def _bands_sql(cte: str, src: str, col: str) -> str:
    """Quantile bands with labels at 3 decimals (edges here never collide
    at that precision)."""
    def brk(e: str, lower: bool) -> str:
        r = f"(round_even({e} * 1000.0, 0) / 1000.0)"
        if lower:
            r = f"({r} - 0.001)"
        return f"CAST(trunc({r}) AS BIGINT)"
    return f"""WITH {cte},
vals AS (SELECT CAST({col} AS DOUBLE) AS v FROM {src} WHERE {col} IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS ed FROM vals),
b AS (SELECT CAST(i AS BIGINT) AS band_no, ed[i] AS lower, ed[i + 1] AS upper
      FROM e, range(1, len(ed)) t(i))
SELECT band_no,
       '$' || format('{{:,}}', CASE WHEN band_no = 1 THEN {brk('lower', True)} ELSE {brk('lower', False)} END)
       || ' to $' || format('{{:,}}', {brk('upper', False)}) AS Band,
       lower, upper,
       (SELECT count(*) FROM vals WHERE (v > lower OR (band_no = 1 AND v >= lower)) AND v <= upper)
         AS Records
FROM b"""


PLAYERS_VALUE_TABLE = f"""
vt AS (
  SELECT Segment, count(PlayerID) AS Records,
         {r_even('coalesce(sum(NetADT), 0.0)', 2)} AS TotalValue,
         {r_even('avg(NetADT)', 2)} AS AvgValue
  FROM pseg GROUP BY Segment),
vtr AS (SELECT *, CAST(row_number() OVER (ORDER BY TotalValue DESC, Segment) AS BIGINT) AS rank
        FROM vt)"""

HV = "Segment IN ('At Risk High Value', 'VIP High Value')"


def _tiers() -> list[tuple]:
    tiers = config.DEFAULT_COMP_TIERS
    return [(c, tiers[i + 1][0] if i + 1 < len(tiers) else None, n) for i, (c, n) in enumerate(tiers)]


def _comp_tier(v: str) -> str:
    cases = " ".join(f"WHEN {v} >= {c} THEN {text(n)}" for c, _, n in reversed(_tiers()))
    return f"CASE {cases} ELSE {text(config.DEFAULT_COMP_TIERS[0][1])} END"


def _comp_cases(v: str, between, above, none: str) -> str:
    cases = " ".join(
        f"WHEN {v} >= {lo} THEN {above(lo, n)}" if hi is None
        else f"WHEN {v} >= {lo} AND {v} < {hi} THEN {between(lo, hi, n)}" for lo, hi, n in _tiers())
    return f"CASE {cases} ELSE {none} END"


def _comp_band(v: str) -> str:
    return _comp_cases(
        v, lambda lo, hi, n: say(config.COMP_BAND_BETWEEN, tier=text(n), low=text(f"{lo:,}"), high=text(f"{hi:,}")),
        lambda lo, n: say(config.COMP_BAND_ABOVE, tier=text(n), low=text(f"{lo:,}")),
        say(config.COMP_BAND_NONE, tier=text(config.DEFAULT_COMP_TIERS[0][1])))


def _comp_reason(v: str) -> str:
    m = money(v)
    return _comp_cases(
        v, lambda lo, hi, n: say(config.COMP_REASON_BETWEEN, value=m, low=text(f"${lo:,.2f}"),
                                 high=text(f"${hi:,.2f}"), tier=text(n.lower())),
        lambda lo, n: say(config.COMP_REASON_ABOVE, value=m, low=text(f"${lo:,.2f}"), tier=text(n.lower())),
        say(config.COMP_REASON_NONE, value=m))


def _host_reason() -> str:
    decline = (f"(CASE WHEN TrendPct <= -{config.TREND_LIMIT_PCT} THEN "
               f"{say(config.HOST_DECLINE, drop=fixed('abs(TrendPct)', 0))} ELSE '' END)")
    absence = (f"coalesce({say(config.HOST_UNSEEN, days='CAST(CAST(DaysSinceLastVisit AS BIGINT) AS VARCHAR)')}, "
               f"{text(config.HOST_QUIET)})")
    m = money("NetADT")
    at_risk, vip = map(text, config.HIGH_VALUE_SEGMENTS)
    return (f"CASE WHEN Segment = {at_risk} THEN {say(config.HOST_AT_RISK, value=m, absence=absence, decline=decline)} "
            f"WHEN Segment = {vip} THEN {say(config.HOST_VIP, value=m, decline=decline)} "
            f"ELSE {say(config.HOST_OTHER, value=m, decline=decline)} END")


def _signed(expr: str) -> str:
    return f"(format('{{:+.0f}}', {expr}) || '%')"


ORACLE: dict[str, str] = {}

ORACLE["money_parse"] = f"""WITH {FX_CUSTOM}
SELECT ref_id, worth, {MONEY.format(c='worth')} AS worth_value FROM fx_custom"""

ORACLE["quarantine_kept"] = f"""WITH {DIRTY_CLEAN}
SELECT * FROM dirty_kept"""

ORACLE["quarantine_rejects"] = f"""WITH {DIRTY_CLEAN}
SELECT QuarantineReason, PlayerID, FullName, NetADT, DaysSinceLastVisit, CanEmail, ZipCode,
       _row_order FROM fx_players_dirty_class WHERE QuarantineReason IS NOT NULL"""

ORACLE["quarantine_metrics"] = f"""WITH {DIRTY_CLEAN}
SELECT count(*) AS rows_received,
       count(*) FILTER (WHERE QuarantineReason IS NULL) AS rows_kept,
       count(*) FILTER (WHERE QuarantineReason IS NOT NULL) AS rows_quarantined,
       count(*) FILTER (WHERE QuarantineReason LIKE 'Missing%') AS missing_ids,
       count(*) FILTER (WHERE QuarantineReason LIKE 'Duplicate%') AS duplicate_ids
FROM fx_players_dirty_class"""

ORACLE["preflight"] = f"""WITH {DIRTY_CLEAN},
st AS (SELECT avg(CASE WHEN NetADT IS NULL THEN 1.0 ELSE 0.0 END) AS miss,
              count(*) FILTER (WHERE _key IS NULL) AS blank,
              count(_key) - count(DISTINCT _key) AS dupe FROM fx_players_dirty_keyed)
""" + _lines([
    (f"{fixed('miss * 100', 0)} || '% of the value column (NetADT) could not be read as numbers. "
     f"The wrong column may be mapped.'", "FROM st WHERE miss > 0.10"),
    ("CAST(blank + dupe AS VARCHAR) || ' row(s) have a missing or duplicate PlayerID and will be "
     "quarantined out of the analysis.'", "FROM st WHERE blank + dupe > 0")])

ORACLE["clean_players"] = f"""WITH {DIRTY_CLEAN}
SELECT * FROM dirty_clean"""

ORACLE["clean_report"] = f"""WITH {DIRTY_CLEAN}
""" + _lines([
    ("'Standardized CanEmail to Yes / No / Unknown.'", ""),
    ("'Filled ' || CAST(imputed AS VARCHAR) || ' missing NetADT values with the median (' || "
     "format('{:,.2f}', med) || ').'", "FROM dirty_med WHERE imputed > 0"),
    ("'Flagged ' || CAST(flagged AS VARCHAR) || ' missing ZipCode values as MISSING.'",
     "FROM dirty_med WHERE flagged > 0")])

ORACLE["segment_players"] = f"""WITH {FX_PLAYERS},""" + _players_segment("fx_players", "s1") + """
SELECT PlayerID, NetADT, DaysSinceLastVisit, Segment FROM s1"""

ORACLE["segment_players_dirty"] = f"""WITH {DIRTY_CLEAN},""" + \
    _players_segment("dirty_clean", "s2") + """
SELECT PlayerID, NetADT, DaysSinceLastVisit, CanEmail, ZipCode, Segment, _row_order FROM s2"""

ORACLE["segment_companies"] = f"""WITH {COMPANIES_SEG}
SELECT AccountID, AnnualRevenue, DebtToEquity, MonthsSinceContact, Industry, Segment FROM cseg"""

ORACLE["segment_custom"] = f"""WITH {CUSTOM_SEG}
SELECT ref_id, worth, _recency, Segment FROM useg"""

ORACLE["segment_custom_value_only"] = f"""WITH {CUSTOM_VALUES}
SELECT ref_id, worth, CASE WHEN worth IS NULL THEN 'Needs Review' WHEN worth >= cut THEN 'Top Tier'
       WHEN worth <= low THEN 'Bottom Tier' ELSE 'Middle Tier' END AS Segment
FROM custom_v, custom_q"""

ORACLE["mapping_fallback"] = f"""WITH {FX_CUSTOM},
c AS (
  SELECT 'label' AS "column", CAST(1 AS BIGINT) AS ordinal,
         stddev_samp({MONEY.format(c='label')}) AS std, count({MONEY.format(c='label')}) AS parsed
  FROM fx_custom
  UNION ALL
  SELECT 'worth', 2, stddev_samp({MONEY.format(c='worth')}), count({MONEY.format(c='worth')})
  FROM fx_custom
  UNION ALL
  SELECT 'recency_days', 3, stddev_samp(CAST(recency_days AS DOUBLE)), count(recency_days)
  FROM fx_custom)
SELECT "column", ordinal, parsed, {r_even('std', 6)} AS std_dev,
       CAST(row_number() OVER (ORDER BY std DESC NULLS LAST, ordinal) AS BIGINT) AS rank FROM c"""


def _profile_col(name: str, ordinal: int, dtype: str) -> str:
    return (f"SELECT CAST({ordinal} AS BIGINT) AS ordinal, '{name}' AS \"column\", '{dtype}' AS dtype, "
            f"count(*) FILTER (WHERE {name} IS NULL) AS nulls, "
            f"substring(arg_min(CAST({name} AS VARCHAR), _row_order) FILTER (WHERE {name} IS NOT NULL), 1, 30) AS example "
            f"FROM fx_custom")


ORACLE["column_profile"] = f"""WITH {FX_CUSTOM}
{_profile_col('ref_id', 1, 'bigint')} UNION ALL {_profile_col('label', 2, 'string')}
UNION ALL {_profile_col('worth', 3, 'string')} UNION ALL {_profile_col('recency_days', 4, 'int')}"""

ORACLE["segment_counts"] = f"""WITH {PLAYERS_SEG},
g AS (SELECT Segment, count(*) AS Records FROM pseg WHERE Segment IS NOT NULL GROUP BY Segment)
SELECT Segment, Records, CAST(row_number() OVER (ORDER BY Records DESC, Segment) AS BIGINT) AS rank,
       {_meaning(config.PLAYER_MEANINGS)} AS Meaning FROM g"""

ORACLE["value_table"] = f"""WITH {PLAYERS_SEG},{PLAYERS_VALUE_TABLE}
SELECT Segment, Records, TotalValue, AvgValue, rank FROM vtr"""

ORACLE["value_table_companies"] = f"""WITH {COMPANIES_SEG},
vt AS (SELECT Segment, count(AccountID) AS Records,
              {r_even('coalesce(sum(AnnualRevenue), 0.0)', 2)} AS TotalValue
       FROM cseg GROUP BY Segment)
SELECT Segment, Records, TotalValue,
       CAST(row_number() OVER (ORDER BY TotalValue DESC, Segment) AS BIGINT) AS rank FROM vt"""

ORACLE["segment_overview"] = f"""WITH {PLAYERS_SEG},
g AS (SELECT Segment, count(*) AS Records, coalesce(sum(NetADT), 0.0) AS tv, avg(NetADT) AS av
      FROM pseg GROUP BY Segment),
w AS (SELECT *, sum(Records) OVER () AS tr, sum(tv) OVER () AS tt FROM g)
SELECT Segment, Records, {fixed('Records / tr * 100', 0)} || '%' AS "% of records",
       {money('tv')} AS "Total value", {money('av')} AS "Avg value",
       {fixed('CASE WHEN tt != 0 THEN tv / tt * 100 ELSE 0.0 END', 0)} || '%' AS "% of value",
       CAST(row_number() OVER (ORDER BY Records DESC, Segment) AS BIGINT) AS rank FROM w"""

ORACLE["segment_stats"] = f"""WITH {CUSTOM_SEG},
g AS (SELECT Segment, count(*) AS Records, coalesce(sum(worth), 0.0) AS t, avg(worth) AS a,
             max(worth) AS hi, min(worth) AS lo FROM useg GROUP BY Segment)
SELECT Segment, {_meaning(config.CUSTOM_MEANINGS)} AS Meaning, Records,
       {fixed('Records / sum(Records) OVER () * 100', 0)} || '%' AS "Share of records",
       {money('t')} AS Total, {money('a')} AS Average, {money('hi')} AS Highest,
       {money('lo')} AS Lowest FROM g"""

ORACLE["headline"] = f"""WITH {PLAYERS_SEG}
SELECT format('{{:,}}', count(*)) AS Records, {money('coalesce(sum(NetADT), 0.0)')} AS "Total value",
       {money('avg(NetADT)')} AS "Avg value", CAST(count(DISTINCT Segment) AS VARCHAR) AS Segments
FROM pseg"""

ORACLE["segment_insight"] = f"""WITH {PLAYERS_SEG},{PLAYERS_VALUE_TABLE},
t AS (SELECT *, sum(TotalValue) OVER () AS tv, sum(Records) OVER () AS tr FROM vtr)
SELECT 'Your largest segment by value is ' || Segment || ', holding ' || {money('TotalValue')}
       || ' (' || {fixed('CASE WHEN tv != 0 THEN TotalValue / tv * 100 ELSE 0.0 END', 0)}
       || '% of all value) from ' || {fixed('CASE WHEN tr != 0 THEN Records / tr * 100 ELSE 0.0 END', 0)}
       || '% of records. When a small share of records holds most of the value, focus your effort there first.' AS insight
FROM t WHERE rank = 1"""

ORACLE["distribution_insight"] = f"""WITH {PLAYERS_SEG},
v AS (SELECT NetADT AS v FROM pseg WHERE NetADT IS NOT NULL),
r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS rn, count(*) OVER () AS n FROM v),
s AS (SELECT sum(v) AS s, sum(v) FILTER (WHERE rn <= greatest(1, floor(n * 0.1))) AS top,
             (SELECT median(v) FROM v) AS med FROM r)
SELECT 'The median value is ' || {money('med')} || ' and the top 10% of records hold about '
       || {fixed('CASE WHEN s != 0 THEN top / s * 100 ELSE 0.0 END', 0)}
       || '% of total value. A wide gap between median and top means value is concentrated in a few records.' AS insight
FROM s"""

ORACLE["value_bands"] = _bands_sql(PLAYERS_SEG, "pseg", "NetADT")
ORACLE["value_bands_custom"] = _bands_sql(CUSTOM_SEG, "useg", "worth")


def _width_bands() -> str:
    def brk(e: str) -> str:
        return f"CAST(trunc(round_even({e} * 1000.0, 0) / 1000.0) AS BIGINT)"
    return f"""WITH {COMPANIES_SEG},
vals AS (SELECT AnnualRevenue AS v FROM cseg WHERE AnnualRevenue IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx, (max(v) - min(v)) / 5 AS step FROM vals),
b AS (SELECT CAST(i AS BIGINT) AS band_no,
             CASE WHEN i = 1 THEN mn - (mx - mn) * 0.001 ELSE (i - 1) * step + mn END AS lower,
             CASE WHEN i = 5 THEN mx ELSE i * step + mn END AS upper
      FROM mm, range(1, 6) t(i))
SELECT band_no, '$' || format('{{:,}}', {brk('lower')}) || ' to $' || format('{{:,}}', {brk('upper')}) AS Band,
       lower, upper, (SELECT count(*) FROM vals WHERE v > lower AND v <= upper) AS Records
FROM b"""


ORACLE["width_bands"] = _width_bands()

_PARETO = f"""WITH {FX_OFFERS},
t AS (
  SELECT 'OfferSlots' AS Category, sum(OfferSlots) AS total, count(OfferSlots) AS n FROM fx_offers
  UNION ALL SELECT 'OfferTables', sum(OfferTables), count(OfferTables) FROM fx_offers
  UNION ALL SELECT 'OfferFood', sum(OfferFood), count(OfferFood) FROM fx_offers
  UNION ALL SELECT 'OfferHotel', sum(OfferHotel), count(OfferHotel) FROM fx_offers),
r AS (SELECT Category, total, {r_even('total', 2)} AS RawTotal FROM t WHERE n > 0),
p AS (SELECT Category, RawTotal,
             {r_even('sum(RawTotal) OVER (ORDER BY total DESC, Category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(RawTotal) OVER () * 100', 1)} AS "Cumulative %",
             CAST(row_number() OVER (ORDER BY total DESC, Category) AS BIGINT) AS rank FROM r)"""

ORACLE["pareto"] = _PARETO + "\nSELECT * FROM p"

ORACLE["pareto_insight"] = _PARETO + f"""
SELECT Category || ' alone accounts for ' || {fixed('"Cumulative %"', 0)}
       || '% of total offer dollars. Categories that drive most of the spend are where small changes move the budget most.' AS insight
FROM p WHERE rank = 1"""


def _health(cte: str, src: str, ncols: int, noun: str, cols: list[str],
            extra: list[tuple[str, str]]) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    aggs = ", ".join([f"count(*) AS n", f"({nulls}) AS z"] + [f"{e} AS x{i}"
                                                              for i, (e, _) in enumerate(extra)])
    parts = [(f"CAST(n AS VARCHAR) || ' {noun} loaded across {ncols} columns.'", "FROM st"),
             (f"{fixed(f'z / greatest(n * {ncols}, 1) * 100', 1)} || '% of all cells are empty.'",
              "FROM st")]
    parts += [(f"{fixed(f'x{i}', 0)} || '{text}'", "FROM st") for i, (_, text) in enumerate(extra)]
    return f"WITH {cte},\nst AS (SELECT {aggs} FROM {src})\n" + _lines(parts)


def _share(pred: str) -> str:
    return f"avg(CASE WHEN coalesce({pred}, false) THEN 1.0 ELSE 0.0 END) * 100"


ORACLE["health_players"] = _health(
    FX_DIRTY, "fx_players_dirty", 6, "records",
    ["PlayerID", "FullName", "NetADT", "DaysSinceLastVisit", "CanEmail", "ZipCode"],
    [(_share("lower(CanEmail) = 'yes'"), "% are marked emailable."),
     (_share("DaysSinceLastVisit > 180"), "% have not visited in over 180 days.")])

ORACLE["health_companies"] = _health(
    FX_COMPANIES, "fx_companies", 8, "accounts",
    ["AccountID", "FullName", "Industry", "AnnualRevenue", "Debt", "Equity",
     "MonthsSinceContact", "RiskTier"],
    [(_share("MonthsSinceContact > 12"), "% not contacted in over 12 months."),
     (_share("RiskTier = 'High Risk'"), "% sit in the High Risk tier.")])

ORACLE["health_custom"] = _health(
    FX_CUSTOM, "fx_custom", 4, "records", ["ref_id", "label", "worth", "recency_days"],
    [(_share(MONEY.format(c="worth") + " IS NOT NULL"),
      "% of the value column parsed into clean numbers.")])


def _money_stat(col: str, src: str) -> str:
    return (f"(SELECT '{col}: avg ' || {money(f'avg({col})')} || ', median ' || "
            f"{money(f'median({col})')} || ', max ' || {money(f'max({col})')} FROM {src})")


def _f1_stat(col: str, src: str) -> str:
    return (f"(SELECT '{col}: avg ' || {fixed(f'avg({col})', 1)} || ', median ' || "
            f"{fixed(f'median({col})', 1)} || ', max ' || {fixed(f'max({col})', 1)} FROM {src})")


def _top_values(col: str, src: str) -> str:
    return (f"(SELECT '{col} top values: ' || string_agg({col} || ' (' || CAST(n AS VARCHAR) || ')', "
            f"', ' ORDER BY n DESC, {col}) FROM (SELECT {col}, count(*) AS n FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY n DESC, {col} LIMIT 3) t)")


ORACLE["profile_players"] = f"WITH {PLAYERS_SEG}\n" + _lines([
    ("(SELECT 'Total records: ' || CAST(count(*) AS VARCHAR) FROM pseg)", ""),
    (_money_stat("NetADT", "pseg"), ""),
    (f"(SELECT 'DaysSinceLastVisit: avg ' || {fixed('avg(DaysSinceLastVisit)', 0)} || ', max ' || "
     f"{fixed('max(DaysSinceLastVisit)', 0)} FROM pseg)", "")])

ORACLE["profile_companies"] = f"WITH {COMPANIES_SEG}\n" + _lines([
    ("(SELECT 'Total accounts: ' || CAST(count(*) AS VARCHAR) FROM cseg)", ""),
    (_money_stat("AnnualRevenue", "cseg"), ""), (_money_stat("Debt", "cseg"), ""),
    (_money_stat("Equity", "cseg"), ""), (_f1_stat("DebtToEquity", "cseg"), ""),
    (_top_values("Industry", "cseg"), ""), (_top_values("RiskTier", "cseg"), "")])

ORACLE["profile_custom"] = f"WITH {CUSTOM_SEG}\n" + _lines([
    ("(SELECT 'Total records: ' || CAST(count(*) AS VARCHAR) FROM useg)", ""),
    (_money_stat("worth", "useg"), "")])

ORACLE["top_categories"] = f"""WITH {COMPANIES_SEG},
t AS (SELECT 'Industry' AS "column", Industry AS value FROM cseg
      UNION ALL SELECT 'RiskTier', RiskTier FROM cseg),
g AS (SELECT "column", value, count(*) AS count FROM t WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS BIGINT)
             AS rank FROM g)
SELECT * FROM r WHERE rank <= 3"""

ORACLE["trend"] = f"""WITH {FX_CURRENT},{FX_PRIOR},""" + \
    _players_segment("fx_current", "cs", recency=False) + "," + _trend("cs", "ct") + """
SELECT PlayerID, NetADT, Segment, NetADT_Prev, TrendPct, Trend FROM ct"""

ORACLE["trend_counts"] = f"""WITH {PLAYERS_SEG}
SELECT count(*) FILTER (WHERE Trend = 'Rising') AS Rising,
       count(*) FILTER (WHERE Trend = 'Stable') AS Stable,
       count(*) FILTER (WHERE Trend = 'Declining') AS Declining FROM pseg"""

ORACLE["top_declines"] = f"""WITH {PLAYERS_SEG},
d AS (SELECT * FROM pseg WHERE Trend = 'Declining' ORDER BY TrendPct ASC NULLS LAST, PlayerID LIMIT 10)
SELECT FullName, PlayerID, Segment, {money('NetADT_Prev')} AS "Prior NetADT",
       {money('NetADT')} AS "Current NetADT", {_signed('TrendPct')} AS Change,
       CAST(row_number() OVER (ORDER BY TrendPct ASC NULLS LAST, PlayerID) AS BIGINT) AS rank FROM d"""

ORACLE["trend_insight"] = f"""WITH {PLAYERS_SEG},
d AS (SELECT * FROM pseg WHERE Trend = 'Declining'),
c AS (SELECT count(*) AS n_dec, count(*) FILTER (WHERE {HV}) AS n_hv FROM d),
w AS (SELECT FullName, NetADT, TrendPct FROM d WHERE {HV} ORDER BY NetADT DESC, _row_order LIMIT 1)
SELECT CASE WHEN n_dec = 0 THEN 'No players are declining versus the prior period.'
            WHEN n_hv > 0 THEN 'Start with ' || (SELECT FullName FROM w) || ': a high-value player worth '
                 || (SELECT {money('NetADT')} FROM w) || '/day whose play is down '
                 || (SELECT {fixed('abs(TrendPct)', 0)} FROM w) || '% versus last period. Of your '
                 || CAST(n_dec AS VARCHAR) || ' decliners, ' || CAST(n_hv AS VARCHAR)
                 || ' are high value, those are the calls that protect the most revenue.'
            ELSE CAST(n_dec AS VARCHAR) || ' players are declining, but none are in your high-value segments, so these are lower priority than an active VIP would be.'
       END AS insight FROM c"""

ORACLE["top_per_segment"] = f"""WITH {PLAYERS_SEG},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY Segment ORDER BY NetADT DESC NULLS LAST, PlayerID, _row_order) AS BIGINT) AS rank FROM pseg)
SELECT Segment, rank, FullName AS Record, {money('NetADT')} AS NetADT FROM r WHERE rank <= 10"""

ORACLE["top_records"] = f"""WITH {PLAYERS_SEG},
t AS (SELECT * FROM pseg ORDER BY NetADT DESC NULLS LAST, PlayerID, _row_order LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY NetADT DESC NULLS LAST, PlayerID, _row_order) AS BIGINT) AS rank,
       FullName || ': ' || {money('NetADT')} || ', ' || Segment
       || coalesce(', last visit ' || CAST(CAST(DaysSinceLastVisit AS BIGINT) AS VARCHAR) || 'd ago', '') AS line
FROM t"""

ORACLE["worklist"] = f"""WITH {PLAYERS_SEG},
h AS (SELECT *, CASE Segment WHEN 'At Risk High Value' THEN 0 WHEN 'VIP High Value' THEN 1 ELSE 2 END AS prio
      FROM pseg WHERE {HV})
SELECT FullName AS Player, Segment, {money('NetADT')} AS NetADT,
       coalesce(CAST(CAST(DaysSinceLastVisit AS BIGINT) AS VARCHAR), 'n/a') AS "Days since visit",
       {_comp_tier('NetADT')} AS "Suggested comp", {_comp_band('NetADT')} AS "Why this comp",
       {_host_reason()} AS "Why reach out",
       CASE WHEN TrendPct IS NULL THEN 'n/a' ELSE {_signed('TrendPct')} END AS Trend,
       CAST(row_number() OVER (ORDER BY prio, TrendPct ASC NULLS LAST, NetADT DESC NULLS LAST, PlayerID, _row_order) AS BIGINT) AS rank
FROM h"""

ORACLE["comp_reason"] = f"""WITH {PLAYERS_SEG}
SELECT PlayerID, {_comp_tier('NetADT')} AS comp, {_comp_band('NetADT')} AS band,
       {_comp_reason('NetADT')} AS reason FROM pseg"""

_EXPLAIN_PLAYER = (
    "CASE WHEN NetADT IS NULL THEN 'This player has no NetADT value, so they were set aside for review.' "
    "ELSE concat_ws(' ', "
    f"CASE WHEN NetADT >= cut THEN 'Their NetADT of ' || {money('NetADT')} || ' is in the top quartile (cutoff ' || {money('cut')} || '), so they count as high value.' "
    f"ELSE 'Their NetADT of ' || {money('NetADT')} || ' is below the high value cutoff of ' || {money('cut')} || '.' END, "
    "CASE WHEN DaysSinceLastVisit > 180 THEN 'They have not visited in ' || CAST(DaysSinceLastVisit AS VARCHAR) || ' days, past the 180 day mark, so recency flags them as drifting away.' "
    "WHEN DaysSinceLastVisit <= 30 THEN 'They visited ' || CAST(DaysSinceLastVisit AS VARCHAR) || ' days ago, which is recent.' "
    "WHEN DaysSinceLastVisit IS NOT NULL THEN 'They last visited ' || CAST(DaysSinceLastVisit AS VARCHAR) || ' days ago.' END, "
    "'Together that places them in the ' || Segment || ' segment.') END")

ORACLE["explain_players"] = f"""WITH {PLAYERS_SEG}
SELECT PlayerID, FullName || ' (' || PlayerID || ')' AS Label, {_EXPLAIN_PLAYER} AS Explanation
FROM pseg, players_s_cut"""

ORACLE["explain_companies"] = f"""WITH {COMPANIES_SEG}
SELECT AccountID, CASE WHEN AnnualRevenue IS NULL THEN 'This account has no revenue figure, so it was set aside for review.'
  ELSE concat_ws(' ',
    CASE WHEN AnnualRevenue >= cut THEN 'Its revenue of ' || {money('AnnualRevenue')} || ' is in the top quartile (cutoff ' || {money('cut')} || '), so it is a large account.'
         ELSE 'Its revenue of ' || {money('AnnualRevenue')} || ' is below the large account cutoff of ' || {money('cut')} || '.' END,
    CASE WHEN DebtToEquity IS NOT NULL THEN 'Its debt to equity ratio of ' || CAST(DebtToEquity AS VARCHAR) || ' is '
         || CASE WHEN DebtToEquity > 1.5 THEN 'above 1.5, which signals heavy leverage.' ELSE 'within a healthy range.' END END,
    CASE WHEN MonthsSinceContact > 12 THEN 'It has not been contacted in ' || CAST(MonthsSinceContact AS VARCHAR) || ' months.' END,
    'Together that places it in the ' || Segment || ' segment.') END AS Explanation
FROM cseg, companies_cut"""

ORACLE["explain_custom"] = f"""WITH {CUSTOM_SEG}
SELECT ref_id, CASE WHEN worth IS NULL THEN 'This record has no usable worth, so it was set aside for review.'
  ELSE 'Its worth of ' || {money('worth')} || ' is ' || CASE WHEN worth >= cut THEN 'in the top tier' ELSE 'below the top tier' END
       || ' (top cutoff ' || {money('cut')} || '), placing it in the ' || Segment || ' segment.' END AS Explanation
FROM useg, custom_q"""


def _detail(fields: list[str]) -> str:
    parts = [f"SELECT PlayerID AS record_id, CAST({i + 1} AS BIGINT) AS field_no, '{f}' AS Field, "
             f"coalesce(CAST({f} AS VARCHAR), 'nan') AS Value FROM pseg"
             for i, f in enumerate(fields)]
    return " UNION ALL ".join(parts)


ORACLE["record_detail"] = f"""WITH {PLAYERS_SEG}
""" + _detail(["PlayerID", "FullName", "NetADT", "DaysSinceLastVisit", "CanEmail", "ZipCode",
               "Segment", "NetADT_Prev", "TrendPct", "Trend"])

ORACLE["roster"] = f"""WITH {PLAYERS_SEG}
SELECT PlayerID, FullName, Segment, NetADT, DaysSinceLastVisit FROM pseg"""

ORACLE["sql_records"] = f"""WITH {PLAYERS_SEG}
SELECT Segment, COUNT(*) AS records, ROUND(SUM("NetADT"), 2) AS total_value
FROM pseg GROUP BY Segment ORDER BY total_value DESC"""

ORACLE["preview"] = f"""WITH {FX_DIRTY}
SELECT * FROM fx_players_dirty ORDER BY _row_order LIMIT 10"""

ORACLE["rejects_shown"] = f"""WITH {DIRTY_CLEAN}
SELECT QuarantineReason, PlayerID, FullName, NetADT, DaysSinceLastVisit, CanEmail, ZipCode,
       _row_order FROM fx_players_dirty_class WHERE QuarantineReason IS NOT NULL
ORDER BY _row_order LIMIT 20"""

ORACLE["clean_metrics"] = f"""WITH {DIRTY_CLEAN}
SELECT (SELECT count(*) FROM dirty_kept) AS rows, imputed, flagged, med AS median,
       (imputed + flagged) / greatest((SELECT count(*) FROM dirty_kept), 1) AS issue_rate,
       imputed / greatest((SELECT count(*) FROM dirty_kept), 1) AS value_unparsed_rate
FROM dirty_med"""

ORACLE["parse_rate_custom"] = f"""WITH {FX_CUSTOM}
SELECT avg(CASE WHEN {MONEY.format(c='worth')} IS NULL THEN 1.0 ELSE 0.0 END) AS value_unparsed_rate
FROM fx_custom"""

_LINES = """
fx_lines AS (
  SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS line_id,
         l_extendedprice AS amount,
         date_diff('day', l_shipdate, TIMESTAMP '2001-08-02 00:00:00') AS days_since_ship,
         ROW(l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey) AS _row_order
  FROM lineitem),""" + _classified("fx_lines", "line_id") + """,
kept_lines AS (SELECT * FROM fx_lines_class WHERE QuarantineReason IS NULL)"""

ORACLE["quarantine_lines_rejects"] = f"""WITH {_LINES}
SELECT QuarantineReason, line_id, amount, days_since_ship FROM fx_lines_class
WHERE QuarantineReason IS NOT NULL"""

ORACLE["line_quantiles"] = """
SELECT count(*) AS records, quantile_cont(l_extendedprice, 0.75) AS cut,
       quantile_cont(l_extendedprice, 0.25) AS low,
       median(CAST(date_diff('day', l_shipdate, TIMESTAMP '2001-08-02 00:00:00') AS DOUBLE)) AS median_days
FROM lineitem"""


def _custom_segment(src: str, value: str, recency: str) -> str:
    """CTE ``sg``: the custom mode over (``value``, ``recency``) of ``src``."""
    return f"""
sq AS (SELECT quantile_cont({value}, 0.75) AS cut, quantile_cont({value}, 0.25) AS low,
              median(CAST({recency} AS DOUBLE)) AS med FROM {src}),
sg AS (SELECT s.*, CAST({recency} AS DOUBLE) AS _recency,
       CASE WHEN {value} IS NULL THEN 'Needs Review'
            WHEN {value} >= cut THEN (CASE WHEN coalesce({recency} > med, false)
                                          THEN 'High Value At Risk' ELSE 'High Value Active' END)
            WHEN {value} <= low THEN (CASE WHEN coalesce({recency} > med, false)
                                          THEN 'Low Value Lapsed' ELSE 'Low Value' END)
            ELSE (CASE WHEN coalesce({recency} > med, false)
                       THEN 'Mid Tier Lapsed' ELSE 'Mid Tier' END) END AS Segment
FROM {src} s, sq)"""


ORACLE["segment_lines"] = f"""WITH {_LINES},{_custom_segment("kept_lines", "amount", "days_since_ship")}
SELECT line_id, amount, _recency, Segment FROM sg"""

# -- text and dates as people write them, awkward names and cells -------------

_TEXTS = """
fx_texts AS (
  SELECT p_partkey AS ref_id,
         CASE p_partkey % 6 WHEN 0 THEN '$' || CAST(p_retailprice AS VARCHAR)
              WHEN 1 THEN ' ' || CAST(p_retailprice AS VARCHAR) || ' '
              WHEN 2 THEN CAST(p_partkey AS VARCHAR) || 'e2' WHEN 3 THEN '1,000'
              WHEN 4 THEN '-' || CAST(p_retailprice AS VARCHAR) END AS cell FROM part)"""

ORACLE["strict_parse"] = f"""WITH {_TEXTS}
SELECT ref_id, cell, CASE WHEN ref_id % 6 IN (1, 2, 4) THEN CAST(trim(cell) AS DOUBLE) END AS number FROM fx_texts"""

_DATED = """
fx_last AS (SELECT o_custkey AS k, max(o_orderdate) AS last,
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS NetADT
            FROM orders GROUP BY o_custkey),
fx_dated AS (
  SELECT concat('P', CAST(k AS VARCHAR)) AS PlayerID, NetADT, k, CASE k % 7
           WHEN 0 THEN strftime(last, '%-m/%-d/%Y') WHEN 1 THEN strftime(last, '%Y-%m-%dT%H:%M:%SZ')
           WHEN 2 THEN strftime(last, '%Y-%m-%d %H:%M:%S.5') WHEN 3 THEN strftime(last, '%b %-d, %Y')
           WHEN 4 THEN strftime(last, '%Y-%m-%d') WHEN 5 THEN 'not a date'
           ELSE strftime(last, '%-d.%-m.%Y') END AS LastVisitDate,
         CASE WHEN k % 7 IN (1, 2) THEN date_trunc('second', last)
              WHEN k % 7 <> 5 THEN CAST(date_trunc('day', last) AS TIMESTAMP) END AS parsed
  FROM fx_last),
fx_days AS (
  SELECT *, CAST(floor((epoch(TIMESTAMP '2001-08-02 00:00:00')
                        - epoch(parsed) - CASE WHEN k % 7 = 2 THEN 0.5 ELSE 0 END) / 86400) AS BIGINT) AS days
  FROM fx_dated)"""

ORACLE["parse_dates"] = f"""WITH {_DATED}
SELECT PlayerID, LastVisitDate, strftime(parsed, '%Y-%m-%d %H:%M:%S') AS parsed FROM fx_dated"""

ORACLE["date_unparsed_rate"] = f"""WITH {_DATED}
SELECT count(*) FILTER (WHERE parsed IS NULL) / greatest(count(*), 1) AS date_unparsed_rate FROM fx_dated"""

ORACLE["days_since"] = f"""WITH {_DATED}
SELECT PlayerID, days FROM fx_days"""

ORACLE["segment_players_from_dates"] = f"""WITH {_DATED},
d1 AS (SELECT PlayerID, NetADT, days AS DaysSinceLastVisit FROM fx_days),""" + _players_segment("d1", "ds") + """
SELECT PlayerID, NetADT, DaysSinceLastVisit, Segment FROM ds"""

ORACLE["segment_custom_from_dates"] = f"""WITH {_DATED},
d2 AS (SELECT PlayerID, NetADT, date_diff('day', parsed, TIMESTAMP '2001-08-02 00:00:00') AS days FROM fx_days),
{_custom_segment("d2", "NetADT", "days")}
SELECT PlayerID, NetADT, _recency, Segment FROM sg"""

ORACLE["custom_dotted"] = f"""WITH {CUSTOM_SEG}
SELECT ref_id AS member, worth, _recency, Segment FROM useg"""

ORACLE["health_dotted"] = _health(
    FX_CUSTOM, "fx_custom", 3, "records", ["ref_id", "worth", "recency_days"],
    [(_share(MONEY.format(c="worth") + " IS NOT NULL"), "% of the value column parsed into clean numbers.")])

ORACLE["profile_dotted"] = f"WITH {CUSTOM_VALUES}\n" + _lines([
    ("(SELECT 'Total records: ' || CAST(count(*) AS VARCHAR) FROM custom_v)", ""),
    (_money_stat("worth", "custom_v").replace("'worth: avg ", "'Net.Worth: avg "), "")])

ORACLE["mapping_guess"] = f"""WITH {FX_CUSTOM},
st AS (SELECT count(*) AS records, stddev_samp({MONEY.format(c='worth')}) AS takings,
              stddev_samp(recency_days) AS away, stddev_samp(_row_order % 7) AS visits FROM fx_custom)
SELECT records, 'Member No.' AS id_column,
       CASE WHEN takings >= away AND takings >= visits THEN 'Takings'
            WHEN away >= visits THEN 'Days Away' ELSE 'Visits' END AS value_column,
       'Days Away' AS recency_column FROM st"""

ORACLE["label_null_name"] = f"""WITH {FX_PLAYERS}
SELECT PlayerID, CASE WHEN _row_order % 3 <> 0 THEN FullName ELSE 'nan' END || ' (' || PlayerID || ')' AS Label
FROM fx_players"""

ORACLE["top_records_null_name"] = f"""WITH {FX_PLAYERS},
r AS (SELECT *, CAST(row_number() OVER (ORDER BY NetADT DESC NULLS LAST, PlayerID) AS BIGINT) AS rank FROM fx_players)
SELECT rank, 'nan: ' || {money('NetADT')} || coalesce(', last visit ' || CAST(DaysSinceLastVisit AS VARCHAR) || 'd ago', '')
         AS line FROM r WHERE rank <= 10"""

ORACLE["flag_numeric"] = f"""WITH {FX_PLAYERS}
SELECT PlayerID, CASE WHEN _row_order % 5 <> 0 THEN CAST(_row_order % 1000 AS VARCHAR) ELSE 'MISSING' END AS ZipCode
FROM fx_players"""

# -- filters, lookups, reports --------------------------------------------------

ORACLE["in_segment"] = f"""WITH {PLAYERS_SEG}
SELECT PlayerID, NetADT, Segment FROM pseg WHERE Segment = 'Casual'"""

ORACLE["record_lookup"] = f"""WITH {PLAYERS_SEG}
SELECT PlayerID, FullName, Segment FROM pseg WHERE PlayerID = 'P1'"""

ORACLE["lookup_by_name"] = f"""WITH {FX_PLAYERS}
SELECT PlayerID, 'Name 3' AS FullName FROM fx_players WHERE _row_order % 10 = 3 ORDER BY _row_order LIMIT 1"""

_MID = "(SELECT * FROM useg WHERE Segment = 'Mid Tier') m"
ORACLE["deep_dive_lines"] = f"WITH {CUSTOM_SEG}\n" + _lines([
    (text("What this segment is: " + config.CUSTOM_MEANINGS["Mid Tier"]), ""),
    (f"(SELECT 'Records: ' || CAST(count(*) AS VARCHAR) || '  (' || "
     f"{fixed('count(*) / (SELECT count(*) FROM useg) * 100', 0)} || '% of all records)' FROM {_MID})", ""),
    *[(f"(SELECT '{label} worth: ' || {money(f'{f}(worth)')} FROM {_MID})", "")
      for label, f in (("Total", "sum"), ("Average", "avg"), ("Highest", "max"), ("Lowest", "min"))]])

ORACLE["deep_dive_top"] = f"""WITH {CUSTOM_SEG},
r AS (SELECT ref_id, worth AS v, CAST(row_number() OVER (ORDER BY worth DESC NULLS LAST, ref_id, _row_order) AS BIGINT)
        AS rank FROM {_MID})
SELECT rank, CAST(ref_id AS VARCHAR) AS Record, {money('v')} AS worth FROM r WHERE rank <= 10"""

ORACLE["profile_players_categories"] = f"""WITH {FX_PLAYERS},
tp AS (SELECT *, 'T' || CAST(_row_order % 4 AS VARCHAR) AS TierRank,
              CASE WHEN _row_order % 3 <> 0 THEN 'G' || CAST(_row_order % 5 AS VARCHAR) END AS PreferredGame
       FROM fx_players)
""" + _lines([
    ("(SELECT 'Total records: ' || CAST(count(*) AS VARCHAR) FROM tp)", ""),
    (_money_stat("NetADT", "tp"), ""),
    (f"(SELECT 'DaysSinceLastVisit: avg ' || {fixed('avg(DaysSinceLastVisit)', 0)} || ', max ' || "
     f"{fixed('max(DaysSinceLastVisit)', 0)} FROM tp)", ""),
    (_top_values("TierRank", "tp"), ""), (_top_values("PreferredGame", "tp"), "")])

ORACLE["run_log"] = f"""WITH {DIRTY_CLEAN},
n AS (SELECT CAST((SELECT count(*) FROM fx_players_dirty) AS VARCHAR) AS rows_in,
             CAST((SELECT count(*) FROM dirty_kept) AS VARCHAR) AS kept)
SELECT 'Quarantine' AS Stage, rows_in AS "Rows in", kept AS "Rows out" FROM n
UNION ALL SELECT s, kept, kept FROM n, (VALUES ('Clean'), ('Segment + Trend'), ('Aggregate')) t(s)"""

ORACLE["csv_roundtrip"] = """
SELECT concat('P', CAST(c_custkey AS VARCHAR)) AS PlayerID,
       CASE c_custkey % 6 WHEN 0 THEN 'say "' || c_name || '", twice' WHEN 1 THEN c_name || chr(10) || 'second line'
            WHEN 2 THEN '  ' || c_name || ' ' WHEN 3 THEN NULL WHEN 4 THEN '"' || c_name ELSE c_name END AS FullName,
       CASE WHEN c_custkey % 4 <> 0 THEN '$' || CAST(c_acctbal AS VARCHAR) END AS NetADT
FROM customer"""

ORACLE["segmented_csv"] = f"""WITH {FX_PLAYERS},""" + _players_segment("fx_players", "s3") + """
SELECT PlayerID, NetADT, Segment FROM s3"""

ORACLE["template"] = f"""WITH {FX_PLAYERS}
SELECT count(*) AS records, 'PlayerID,FullName,NetADT,DaysSinceLastVisit,CanEmail,ZipCode' AS header,
       CAST(0 AS BIGINT) AS template_rows FROM fx_players"""

_DUP_TREND = _trend("cs", "ct").replace("fx_prior p", "one_prior p")
ORACLE["trend_prior_duplicates"] = f"""WITH {FX_CURRENT},{FX_PRIOR},
two_prior AS (
  SELECT ' ' || PlayerID AS PlayerID, NetADT * 2 AS NetADT, _row_order + 4611686018427387904 AS _row_order FROM fx_prior
  UNION ALL SELECT * FROM fx_prior),
one_prior AS (SELECT PlayerID, NetADT FROM (
  SELECT *, row_number() OVER (PARTITION BY trim(PlayerID) ORDER BY _row_order) AS rn FROM two_prior) WHERE rn = 1),""" + \
    _players_segment("fx_current", "cs", recency=False) + "," + _DUP_TREND + """
SELECT PlayerID, NetADT_Prev, TrendPct, Trend FROM ct"""

ORACLE["value_bands_constant"] = """
WITH c AS (SELECT p_retailprice AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
mm AS (SELECT n, v - 0.001::DOUBLE * v AS mn, v + 0.001::DOUBLE * v AS mx, v FROM c),
b AS (SELECT CAST(i AS BIGINT) AS band_no, n, v, (i - 1) * ((mx - mn) / 5) + mn AS lower,
             CASE WHEN i = 5 THEN mx ELSE i * ((mx - mn) / 5) + mn END AS upper FROM mm, range(1, 6) t(i))
SELECT band_no, '$' || format('{:,}', CAST(trunc(round_even(lower * 1000.0, 0) / 1000.0) AS BIGINT)) || ' to $'
       || format('{:,}', CAST(trunc(round_even(upper * 1000.0, 0) / 1000.0) AS BIGINT)) AS Band,
       lower, upper, CASE WHEN v > lower AND v <= upper THEN n ELSE 0 END AS Records FROM b"""

_STATES = """
orders_ AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN ' house' ELSE 'P' || o_custkey END AS PlayerID,
                   CAST(o_orderdate AS DATE) AS day, o_totalprice AS NetADT FROM orders),
prior_ AS (SELECT trim(PlayerID) AS id, CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH AS DATE) AS closed,
                  sum(CAST(round(NetADT * 100) AS BIGINT)) / 100.0::DOUBLE AS v FROM orders_ GROUP BY 1, 2)"""
ORACLE["trend_asof"] = f"""WITH {_STATES},
j AS (SELECT o.*, p.closed, p.v, {r_even("(NetADT - v) / nullif(v, 0) * 100", 1)} AS TrendPct
      FROM orders_ o ASOF LEFT JOIN prior_ p ON trim(o.PlayerID) = p.id AND o.day >= p.closed)
SELECT o_orderkey, PlayerID, NetADT, CAST(closed AS VARCHAR) AS PriorDate, v AS NetADT_Prev, TrendPct,
       CASE WHEN TrendPct IS NULL THEN 'No prior data' WHEN TrendPct <= -15 THEN 'Declining'
            WHEN TrendPct >= 15 THEN 'Rising' ELSE 'Stable' END AS Trend FROM j"""

ORACLE["tier_table"] = """
WITH o AS (SELECT o_orderkey, c_mktsegment AS market, o_orderpriority AS offer, o_totalprice AS v,
                  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT market, offer, ((sum(cents) // (count(*) * 250)) * (CAST(substr(offer, 1, 1) AS INT) - 1))::DOUBLE AS low
      FROM o GROUP BY market, offer),
t AS (SELECT *, lead(low) OVER (PARTITION BY market ORDER BY low) AS high FROM c)
SELECT o.o_orderkey, o.market, t.offer, t.low, t.high
FROM o LEFT JOIN t ON o.market = t.market AND o.v - 1000.0 >= t.low AND (t.high IS NULL OR o.v - 1000.0 < t.high)"""

ORACLE["quarantine_arrivals"] = f"""WITH {DIRTY_CLEAN}
SELECT QuarantineReason, PlayerID, FullName, NetADT, DaysSinceLastVisit, CanEmail, ZipCode, _row_order
FROM fx_players_dirty_class"""

ORACLE["top_values"] = """
WITH v AS (
  SELECT 'part' AS "column", CAST(CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS VARCHAR) FROM lineitem),
r AS (SELECT "column", value, count(*) AS count FROM v GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM r QUALIFY rank <= 3"""

ORACLE["csv_split"] = ORACLE["csv_roundtrip"]

ORACLE["dates_by_column"] = """
WITH f AS (SELECT arg_min(strftime(o_orderdate, '%d/%m/%Y'), o_orderkey + CASE WHEN day(o_orderdate) <= 12 THEN 1e15 ELSE 0 END) AS first
           FROM orders),
t AS (SELECT try_strptime(first, '%m/%d/%Y') IS NULL AS turned FROM f)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS us,
       CASE WHEN turned THEN strftime(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'), '%Y-%m-%d')
            ELSE strftime(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%m/%d/%Y'), '%Y-%m-%d') END AS eu FROM orders, t"""

ORACLE["prior_csv"] = f"""WITH {FX_CURRENT},{FX_PRIOR},""" + \
    _players_segment("fx_current", "cs", recency=False) + "," + _trend("cs", "ct") + """
SELECT PlayerID, NetADT_Prev, TrendPct, Trend FROM ct"""

ORACLE["worklist_file"] = f"""SELECT Player, Segment, NetADT, rank FROM ({ORACLE["worklist"]})"""
ORACLE["sql_file"] = ORACLE["sql_records"].replace('ORDER BY total_value DESC', '')

for stored, plain in (("trend_stored", "trend"), ("record_lookup_stored", "record_lookup"),
                      ("lookup_by_name_stored", "lookup_by_name"), ("line_quantiles_summarised", "line_quantiles")):
    ORACLE[stored] = ORACLE[plain]


def _summary() -> str:
    """The report's lines; the value table is laid out as pandas prints a frame."""
    def shown(c: str) -> str:
        return (f"' ' || CASE WHEN greatest(1, max(length(rtrim(split_part(format('{{:.6f}}', {c}), '.', 2), '0'))) OVER ()) = 1 "
                f"THEN format('{{:.1f}}', {c}) ELSE format('{{:.2f}}', {c}) END")
    title = config.PLAYERS.title
    health = [
        "CAST(n AS VARCHAR) || ' records loaded across 6 columns.'",
        f"{fixed('z / greatest(n * 6, 1) * 100', 1)} || '% of all cells are empty.'",
        say(config.HEALTH_EMAILABLE, share=fixed("e", 0)),
        say(config.HEALTH_LAPSED, share=fixed("l", 0), days=text(str(config.PLAYER_RECENCY_LAPSED_DAYS)))]
    fixed_lines = [(1, text(title.upper())), (2, text("=" * len(title))), (3, "''"), (4, "'Data health:'"),
                   (500, "''"), (501, "'Value by segment:'")]
    unions = [f"SELECT {k} AS k, {line} AS line" for k, line in fixed_lines]
    unions += [f"SELECT {100 + i}, '  ' || {line} FROM st" for i, line in enumerate(health)]
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in (
        "PlayerID", "FullName", "NetADT", "DaysSinceLastVisit", "CanEmail", "ZipCode"))
    lapsed = f"DaysSinceLastVisit > {config.PLAYER_RECENCY_LAPSED_DAYS}"
    return f"""WITH {PLAYERS_SEG},{PLAYERS_VALUE_TABLE},
st AS (SELECT count(*) AS n, {nulls} AS z, {_share("lower(CanEmail) = 'yes'")} AS e, {_share(lapsed)} AS l FROM fx_players),
tt AS (SELECT Segment AS s, rank, ' ' || CAST(Records AS VARCHAR) AS r, {shown('TotalValue')} AS t, {shown('AvgValue')} AS a
       FROM vtr),
w AS (SELECT greatest(7, max(length(s)))::INT AS ws, greatest(8, max(length(r)))::INT AS wr,
             greatest(11, max(length(t)))::INT AS wt, greatest(9, max(length(a)))::INT AS wa FROM tt),
u AS ({" UNION ALL ".join(unions)}
  UNION ALL SELECT 502, repeat(' ', ws + 1) || lpad(' Records', wr, ' ') || ' ' || lpad(' TotalValue', wt, ' ') || ' '
                        || lpad(' AvgValue', wa, ' ') FROM w
  UNION ALL SELECT 503, rpad('Segment', ws + 1, ' ') || repeat(' ', wr + wt + wa + 2) FROM w
  UNION ALL SELECT 503 + rank, rpad(s, ws + 1, ' ') || lpad(r, wr, ' ') || ' ' || lpad(t, wt, ' ') || ' ' || lpad(a, wa, ' ')
            FROM tt, w)
SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS line_no, line FROM u"""


ORACLE["summary_report"] = _summary()
