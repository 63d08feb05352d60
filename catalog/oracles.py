"""SQL that states the same results independently, for DuckDB over the shared test tables.

Inputs are stated as plain values here, so parsing of JSON text and lenient casts are checked
against what the text was built from.
"""

from __future__ import annotations

import re

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
MONTH = 30 * 86400
SIX = 6 * 3600

# ---- shared inputs ---------------------------------------------------------------------

POINTS = """points AS (
  SELECT CAST(user_id AS VARCHAR) AS token_id,
    CASE WHEN event_type IN ('view', 'click') THEN '1m' WHEN event_type = 'purchase' THEN 'max' ELSE '1h' END AS resolution,
    event_id AS extract_ord, epoch_us(ts) // 1000000 AS t,
    CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0.0::DOUBLE
         WHEN event_id % 89 = 0 THEN 1.0::DOUBLE ELSE value / (value + 50.0::DOUBLE) END AS price
  FROM events)"""

PRINTS = POINTS + """, prints AS (
  SELECT token_id, t, arg_max(price, extract_ord) AS price FROM points WHERE price IS NOT NULL GROUP BY 1, 2)"""

CUST = """cust0 AS (
  SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS BIGINT) AS nk, c_acctbal AS bal, c_mktsegment AS seg,
    coalesce(first_s, 1704067200 + (c_custkey % 20) * 86400) AS start_s
  FROM customer LEFT JOIN (SELECT user_id, min(epoch_us(ts) // 1000000) AS first_s FROM events GROUP BY 1) e
    ON e.user_id = c_custkey),
cust1 AS (
  SELECT *, start_s - start_s % 3600 + (5 + k % 26) * 86400 + CASE WHEN k % 4 = 3 THEN 1020 ELSE 0 END AS end_s,
    'Nation ' || nk AS rival FROM cust0),
cust AS (
  SELECT *,
    CAST(k AS VARCHAR) AS ks,
    CASE WHEN k % 211 = 0 THEN ' ' ELSE CAST(k AS VARCHAR) END AS id,
    CASE k % 6 WHEN 0 THEN name || CASE WHEN k % 5 = 1 THEN chr(160) || 'vs.' || chr(160) ELSE ' vs. ' END || rival WHEN 1 THEN name || ' vs ' || rival
      WHEN 2 THEN 'Will ' || name || ' win?' WHEN 3 THEN 'Spread: ' || name || ' vs. ' || rival
      WHEN 4 THEN name || ' vs. ' || rival || ': O/U 5' END AS question,
    CASE WHEN k % 20 IN (7, 8) THEN NULL ELSE start_s END AS start_ok,
    CASE WHEN k % 20 = 9 THEN NULL ELSE end_s END AS end_ok,
    strftime(make_timestamp(start_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso_start,
    strftime(make_timestamp(end_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso_end,
    CASE WHEN (k // 6) % 4 = 0 THEN (CASE WHEN k % 2 = 0 THEN ['Yes', 'No'] ELSE ['No', 'Yes'] END)
      WHEN k % 29 = 3 THEN [' ', rival] ELSE [name, rival] END AS names,
    CASE WHEN k % 11 = 0 THEN ['0.5', '0.5'] WHEN k % 11 = 1 THEN ['1'] WHEN k % 11 = 2 THEN ['x', '1']
      WHEN k % 11 BETWEEN 3 AND 6 THEN ['0', '1'] ELSE ['1', '0'] END AS finals,
    CASE WHEN k % 19 IN (5, 8) THEN NULL WHEN k % 19 = 6 THEN CAST([] AS VARCHAR[])
      WHEN k % 19 = 7 THEN [CAST(k AS VARCHAR)] ELSE [CAST(k AS VARCHAR), k || 'n'] END AS toks,
    CASE k % 9 WHEN 0 THEN 'spreads' WHEN 1 THEN ' Totals ' WHEN 2 THEN NULL ELSE 'moneyline' END AS mtype,
    CASE k % 8 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE lower(seg) END AS category,
    CASE WHEN k % 17 = 4 OR k % 23 = 9 OR k % 31 = 7 THEN NULL ELSE bal END AS vol,
    CASE WHEN k % 13 = 5 THEN NULL ELSE bal / 2 END AS liq,
    CASE WHEN k % 14 = 3 THEN NULL ELSE bal / 8 END AS liq_clob,
    CASE WHEN k % 15 = 2 THEN NULL ELSE bal * 8 END AS vol_1wk,
    CASE k % 12 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '0.' || lpad(CAST(k % 90 + 5 AS VARCHAR), 2, '0') END AS bid,
    CASE k % 12 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE '0.' || lpad(CAST(k % 90 + 8 AS VARCHAR), 2, '0') END AS ask,
    k % 7 <> 0 AS active, k % 5 IN (0, 1, 2) AS closed
  FROM cust1)"""

RAW_TEXT = """rawtext AS (
  SELECT *,
    CASE WHEN k % 20 = 7 THEN NULL WHEN k % 20 = 8 THEN 'soon' ELSE iso_start END AS start_text,
    CASE WHEN k % 20 = 9 THEN '' ELSE iso_end END AS end_text,
    names[1] IN ('Yes', 'No') AS yes_no,
    CASE WHEN names[1] IN ('Yes', 'No') THEN list_position(names, 'Yes') - 1 ELSE 0 END AS pidx
  FROM cust)"""

SEGS = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"

OTHER = "label <> seg AND k % 3 = 0"
OTHER_TOKENS = "[CAST(k + 7 AS VARCHAR), k || 'a']"
CLOSED_LIST = f"""closedlist AS (SELECT * REPLACE (CASE WHEN k % 4 = 1 THEN {OTHER_TOKENS} ELSE toks END AS toks)
  FROM rawtext WHERE closed)"""

LISTING = f"""listing AS (
  SELECT * REPLACE (
      CASE WHEN {OTHER} THEN {OTHER_TOKENS} ELSE toks END AS toks,
      CASE WHEN {OTHER} THEN end_s + 43200 ELSE end_ok END AS end_ok,
      CASE WHEN {OTHER} THEN strftime(make_timestamp((end_s + 43200) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE end_text END AS end_text),
    CAST(list_position({SEGS}, label) - 1 AS INTEGER) AS category_ord,
    CAST(list_position({SEGS}, label) + 9 AS VARCHAR) AS tag_id, lower(label) AS tag_slug
  FROM (SELECT c.*, unnest(CASE WHEN seg = {SEGS}[nk % 5 + 1] THEN [seg] ELSE [seg, {SEGS}[nk % 5 + 1]] END) AS label
        FROM rawtext c))"""

MARKETS = "markets AS (SELECT ks AS market_id, ks AS token_id, start_ok AS start_s, end_s, vol FROM cust)"

MPRINTS = "mprints AS (SELECT token_id AS market_id, t, price FROM prints)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


# Month grid of six-hour steps over all markets; `gridmarkets` says which.
def month_grid(gridmarkets: str = "SELECT market_id, start_s FROM markets") -> str:
    return f"""gm AS (SELECT market_id, coalesce(start_s, {AS_OF - MONTH}) AS start_s FROM ({gridmarkets})),
lines AS (
  SELECT market_id, start_s, unnest(range(lo, {AS_OF} + 1, {SIX})) AS unix_ts, lo
  FROM (SELECT *, greatest(start_s, {AS_OF - MONTH}) // {SIX} * {SIX} AS lo FROM gm)),
buckets AS (
  SELECT market_id, t // {SIX} * {SIX} AS unix_ts, arg_max(price, t) AS price_yes, count(*) AS n,
    max(price) - min(price) AS rng, CASE WHEN count(*) >= 2 THEN stddev_pop(price) END AS sd
  FROM mprints GROUP BY 1, 2),
grid AS (
  SELECT l.market_id, l.start_s, l.unix_ts, (l.unix_ts - l.lo) // {SIX} AS lookback_step, b.price_yes,
    coalesce(b.n, 0) AS n, b.rng, b.sd
  FROM lines l LEFT JOIN buckets b USING (market_id, unix_ts)),
anchored AS (
  SELECT g.*, a.anchor, g.price_yes - a.anchor AS norm FROM grid g LEFT JOIN (
    SELECT market_id, arg_min(price_yes, unix_ts) AS anchor FROM grid WHERE price_yes > 0 AND price_yes < 1 GROUP BY 1) a
  USING (market_id))"""


GRID_BASE = [PRINTS, MPRINTS, CUST, MARKETS]

RAW_ROWS = [
    PRINTS, MPRINTS, CUST, RAW_TEXT, LISTING, MARKETS,
    month_grid("SELECT market_id, start_s FROM markets WHERE market_id IN (SELECT market_id FROM mprints)"),
    """rawrows AS (SELECT g.market_id, g.unix_ts, g.lookback_step AS step, g.price_yes, l.label, l.category_ord
      FROM grid g JOIN listing l ON l.ks = g.market_id)""",
    """steps AS (SELECT market_id, step, price_yes, label FROM (
      SELECT *, row_number() OVER (PARTITION BY market_id, step ORDER BY unix_ts DESC, category_ord DESC) AS rn FROM rawrows) WHERE rn = 1)""",
    """kept AS (SELECT market_id FROM steps GROUP BY 1 HAVING count(price_yes) >= 8)""",
    """allsteps AS (SELECT DISTINCT step FROM steps)""",
    """filled AS (SELECT market_id, step,
        coalesce(last_value(price_yes IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(price_yes IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                 0.5) AS level
      FROM kept CROSS JOIN allsteps LEFT JOIN steps USING (market_id, step))""",
    """rich AS (SELECT *, coalesce(level - lag(level) OVER (PARTITION BY market_id ORDER BY step), 0) AS diff,
        row_number() OVER (PARTITION BY market_id ORDER BY step) - 1 AS pos FROM filled)""",
]

JUMPS = """changes AS (
  SELECT market_id, unix_ts, norm - lag(norm) OVER (PARTITION BY market_id ORDER BY unix_ts) AS change
  FROM anchored WHERE price_yes > 0 AND price_yes < 1),
pieces AS (SELECT market_id, count(*) AS n_valid, count(change) AS n, stddev_pop(change) AS sd, max(abs(change)) AS top,
    sum(abs(change)) AS total, quantile_cont(abs(change), 0.95) AS p95, quantile_cont(abs(change), 0.99) AS p99
  FROM changes GROUP BY 1),
ranked AS (SELECT market_id, abs(change) AS a, row_number() OVER (PARTITION BY market_id ORDER BY abs(change) DESC) AS rn
  FROM changes WHERE change IS NOT NULL),
tops AS (SELECT market_id, sum(a) AS top3 FROM ranked WHERE rn <= 3 GROUP BY 1),
hits AS (SELECT r.market_id, CAST(sum(CASE WHEN sd > 1e-12 AND a / sd >= 2 THEN 1 ELSE 0 END) AS DOUBLE) AS z2,
    CAST(sum(CASE WHEN sd > 1e-12 AND a / sd >= 3 THEN 1 ELSE 0 END) AS DOUBLE) AS z3,
    CAST(sum(CASE WHEN a >= p95 THEN 1 ELSE 0 END) AS DOUBLE) AS h95, CAST(sum(CASE WHEN a >= p99 THEN 1 ELSE 0 END) AS DOUBLE) AS h99
  FROM ranked r JOIN pieces USING (market_id) GROUP BY 1),
jumps AS (SELECT p.market_id, n_valid,
    z2 AS feat_jump_zcount_ge_2, z2 / n AS feat_jump_zrate_ge_2, z3 AS feat_jump_zcount_ge_3, z3 / n AS feat_jump_zrate_ge_3,
    h95 AS feat_jump_count_ge_p95, h95 / n AS feat_jump_rate_ge_p95, h99 AS feat_jump_count_ge_p99, h99 / n AS feat_jump_rate_ge_p99,
    top AS feat_jump_max_abs, top3 AS feat_jump_top3_sum_abs,
    CASE WHEN total > 1e-12 THEN top3 / total END AS feat_jump_top3_frac_total_move,
    CASE WHEN n_valid >= 2 THEN sd END AS feat_return_volatility
  FROM pieces p LEFT JOIN tops USING (market_id) LEFT JOIN hits USING (market_id))"""

JUMP_NAMES = [
    "feat_jump_zcount_ge_2", "feat_jump_zrate_ge_2", "feat_jump_zcount_ge_3", "feat_jump_zrate_ge_3",
    "feat_jump_count_ge_p95", "feat_jump_rate_ge_p95", "feat_jump_count_ge_p99", "feat_jump_rate_ge_p99",
    "feat_jump_max_abs", "feat_jump_top3_sum_abs", "feat_jump_top3_frac_total_move", "feat_return_volatility",
]
BOOK_FEATURES = [
    "feat_ob_spread", "feat_ob_spread_over_mid", "feat_ob_imbalance_topn", "feat_ob_mid",
    "feat_ob_log_bid_ask_depth_ratio",
]
ALL_FEATURES = [*JUMP_NAMES, "feat_time_to_close_hours", "feat_raw_prints_per_hour", *BOOK_FEATURES]

BOOKS = """levels AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS token_id, l_linestatus = 'O' AS is_bid,
    CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 0.5::DOUBLE - l_discount ELSE 0.5::DOUBLE + l_tax END AS price,
    l_quantity AS size, CAST(s AS VARCHAR) AS stamp,
    row_number() OVER (PARTITION BY l_suppkey, l_linestatus = 'O' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM (SELECT *, 700 + 500 * (l_orderkey % 3) AS s FROM lineitem QUALIFY s = max(s) OVER (PARTITION BY l_suppkey))),
firstlevels AS (SELECT * FROM levels WHERE rn <= 5),
sides AS (
  SELECT token_id, max(stamp) AS ob_timestamp_ms,
    arg_min(price, rn) FILTER (is_bid AND price IS NOT NULL) AS ob_best_bid,
    arg_min(price, rn) FILTER (NOT is_bid AND price IS NOT NULL) AS ob_best_ask,
    CASE WHEN count(*) FILTER (is_bid) > 0 THEN coalesce(sum(size) FILTER (is_bid AND price IS NOT NULL), 0) END AS bd,
    CASE WHEN count(*) FILTER (NOT is_bid) > 0 THEN coalesce(sum(size) FILTER (NOT is_bid AND price IS NOT NULL), 0) END AS ad
  FROM firstlevels GROUP BY 1),
book AS (
  SELECT token_id, ob_timestamp_ms, ob_best_bid, ob_best_ask, (ob_best_bid + ob_best_ask) / 2 AS ob_mid,
    ob_best_ask - ob_best_bid AS ob_spread,
    CASE WHEN bd + ad > 0 THEN bd END AS ob_bid_depth_topn, CASE WHEN bd + ad > 0 THEN ad END AS ob_ask_depth_topn,
    CASE WHEN bd + ad > 0 THEN (bd - ad) / (bd + ad) END AS ob_imbalance_topn
  FROM sides),
bookfeat AS (
  SELECT token_id, ob_spread AS feat_ob_spread,
    CASE WHEN abs(ob_mid) > 1e-12 THEN ob_spread / ob_mid END AS feat_ob_spread_over_mid,
    ob_imbalance_topn AS feat_ob_imbalance_topn, ob_mid AS feat_ob_mid,
    CASE WHEN ob_bid_depth_topn > 0 AND ob_ask_depth_topn > 0 THEN ln(ob_bid_depth_topn / ob_ask_depth_topn) END AS feat_ob_log_bid_ask_depth_ratio
  FROM book)"""
BOOK_COLS = [
    "ob_best_bid", "ob_best_ask", "ob_mid", "ob_spread", "ob_bid_depth_topn", "ob_ask_depth_topn", "ob_imbalance_topn",
]


def rs(names) -> str:
    return ", ".join(r6(n) for n in names)


def z_value(name: str) -> str:
    """z-score with missing as 0 and constant columns as 0."""
    v = f"coalesce({name}, 0)"
    return (
        f"CASE WHEN max({v}) OVER () > min({v}) OVER () THEN "
        f"({v} - avg({v}) OVER ()) / stddev_pop({v}) OVER () ELSE 0.0::DOUBLE END"
    )


def z_columns(names: list[str], source: str) -> str:
    return ", ".join(f"round({z_value(n)}, 6) + 0.0 AS {n}" for n in names)


# ---- principal components ------------------------------------------------------------------

SQUARINGS = 18


def eigen(dims: int, k: int) -> list[str]:
    """Components of ``src(rid, e)`` with ``e`` of ``dims`` numbers, as ``pc(k, vec, lam, ratio)``.

    The centred covariance is squared until only its first direction is left, which is read off and
    taken out of the covariance; then the next one. The largest loading is positive.
    """
    at = f"range(1, {dims + 1})"
    return [
        f"cell AS (SELECT rid, i, e[i] - avg(e[i]) OVER (PARTITION BY i) AS x FROM src, {at} r(i))",
        "centred AS (SELECT rid, list(x ORDER BY i) AS x FROM cell GROUP BY 1)",
        "columns_of AS (SELECT i, list(x ORDER BY rid) AS v FROM cell GROUP BY 1)",
        """cov AS (SELECT list(r ORDER BY i) AS c FROM (SELECT a.i, list(list_dot_product(a.v, b.v) / (len(a.v) - 1) ORDER BY b.i) AS r
          FROM columns_of a, columns_of b GROUP BY 1))""",
        f"""turns AS (
          SELECT 0 AS k, 0 AS s, c AS m, c, CAST(NULL AS DOUBLE[]) AS vec, CAST(NULL AS DOUBLE) AS lam FROM cov
          UNION ALL
          SELECT CASE WHEN s < {SQUARINGS} THEN k ELSE k + 1 END, CASE WHEN s < {SQUARINGS} THEN s + 1 ELSE 0 END,
            CASE WHEN s < {SQUARINGS} THEN [[x / big for x in r] for r in sq] ELSE next_c END,
            CASE WHEN s < {SQUARINGS} THEN c ELSE next_c END, CASE WHEN s < {SQUARINGS} THEN vec ELSE v END,
            CASE WHEN s < {SQUARINGS} THEN lam ELSE l END
          FROM (SELECT *, CASE WHEN s = {SQUARINGS} THEN [[c[i][j] - l * v[i] * v[j] for j in {at}] for i in {at}] END AS next_c,
              list_max([list_max(r) for r in sq]) AS big
            FROM (SELECT *, CASE WHEN s = {SQUARINGS} THEN list_dot_product(v, [list_dot_product(r, v) for r in c]) END AS l
              FROM (SELECT *, CASE WHEN s < {SQUARINGS} THEN [[list_dot_product(r, q) for q in m] for r in m] END AS sq,
                  CASE WHEN s = {SQUARINGS} THEN [x / sqrt(list_dot_product(u, u)) for x in u] END AS v
                FROM (SELECT *, m[list_position([m[i][i] for i in {at}], list_max([m[i][i] for i in {at}]))] AS u
                  FROM turns WHERE k < {k})))))""",
        f"""pc AS (SELECT k, lam, lam / (SELECT list_sum([c[i][i] for i in {at}]) FROM cov) AS ratio,
          CASE WHEN vec[list_position([abs(x) for x in vec], list_max([abs(x) for x in vec]))] < 0 THEN [-x for x in vec] ELSE vec END AS vec
          FROM turns WHERE s = 0 AND k > 0)""",
        "scores AS (SELECT rid, k, list_dot_product(x, vec) AS score FROM centred, pc)",
    ]


def recursive(*parts: str) -> str:
    return ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


# ---- streaks, segments, closed features --------------------------------------------------


def streaks(prints_from: str, markets_from: str, hours: int) -> str:
    """`prints_from` has (token_id, t, price); hours are filled explicitly here."""
    return f"""sm AS (SELECT * FROM ({markets_from})),
sp AS (SELECT m.market_id, m.end_s, p.t, p.price FROM ({prints_from}) p JOIN sm m USING (token_id)
  WHERE p.t BETWEEN m.end_s - 336 * 3600 AND m.end_s),
sh AS (SELECT market_id, t // 3600 * 3600 AS hour, least(greatest(arg_max(price, t), 0), 1) AS price FROM sp GROUP BY 1, 2),
sfill AS (
  SELECT l.market_id, l.hour, last_value(h.price IGNORE NULLS) OVER (PARTITION BY l.market_id ORDER BY l.hour) AS price
  FROM (SELECT market_id, unnest(range(min(hour), max(hour) + 1, 3600)) AS hour FROM sh GROUP BY 1) l
  LEFT JOIN sh h USING (market_id, hour)),
sflag AS (SELECT *, price >= 0.95 OR price <= 0.05 AS ext FROM sfill),
spair AS (SELECT *, ext AND lead(ext) OVER (PARTITION BY market_id ORDER BY hour) AS pair FROM sflag),
sfound AS (SELECT market_id, min(hour) FILTER (pair) AS e, count(*) AS n_hours FROM spair GROUP BY 1),
scount AS (SELECT market_id, count(*) AS n FROM sp GROUP BY 1),
streaks AS (
  SELECT m.market_id, m.token_id, f.e - {hours} * 3600 AS segment_start, f.e AS segment_end,
    CASE WHEN coalesce(c.n, 0) < 2 THEN 'insufficient_hourly_clob' WHEN f.n_hours < 2 THEN 'sparse_hourly_resample'
         WHEN f.e IS NULL THEN 'no_skew_streak' ELSE 'ok' END AS status
  FROM sm m LEFT JOIN sfound f USING (market_id) LEFT JOIN scount c USING (market_id))"""


def closed_features(prints_from: str, markets_from: str) -> str:
    """`prints_from` has (market_id, t, price); labels are found with an ASOF join here."""
    return f"""cm AS (SELECT * FROM ({markets_from})),
cp AS (SELECT p.* FROM ({prints_from}) p JOIN cm USING (market_id) WHERE p.t <= cm.end_s),
cbound AS (SELECT market_id, min(t) // 3600 * 3600 AS lo, max(t) // 3600 * 3600 AS hi FROM cp GROUP BY 1),
chours AS (SELECT market_id, unnest(range(end_s - 72 * 3600, end_s + 1, 3600)) AS h, end_s FROM cm WHERE end_s % 3600 = 0),
cat AS (SELECT h.market_id, h.h, h.end_s, CASE WHEN h.h BETWEEN b.lo AND b.hi THEN p.price END AS price
  FROM chours h LEFT JOIN cbound b USING (market_id) ASOF LEFT JOIN cp p ON p.market_id = h.market_id AND p.t <= h.h),
cfill AS (SELECT market_id, h, (end_s - h) // 3600 AS back,
    coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(price IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price
  FROM cat),
clog AS (SELECT *, ln(greatest(0.001, least(price, 0.999)) / (1 - greatest(0.001, least(price, 0.999)))) AS l FROM cfill WHERE price IS NOT NULL),
croll AS (SELECT market_id, avg(CASE WHEN c >= 2 THEN s END) AS vol FROM (
    SELECT market_id, count(l) OVER w AS c, stddev_samp(l) OVER w AS s FROM clog WHERE back <= 48
    WINDOW w AS (PARTITION BY market_id ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) GROUP BY 1),
cagg AS (SELECT market_id, max(l) FILTER (back = 0) AS l0, max(l) FILTER (back = 1) AS l1, max(l) FILTER (back = 6) AS l6,
    max(l) FILTER (back = 24) AS l24, max(price) FILTER (back <= 48) - min(price) FILTER (back <= 48) AS span
  FROM clog GROUP BY 1),
cfeat AS (SELECT market_id, l0 - l1 AS momentum_1h, l0 - l6 AS momentum_6h, l0 - l24 AS momentum_24h, vol AS volatility_24h,
    volume / greatest(span, 1e-6) AS efficiency_ratio, greatest(abs(end_s - coalesce(start_s, end_s - 86400)) / 3600.0::DOUBLE, 1e-6) AS ripeness_hours
  FROM cagg JOIN croll USING (market_id) JOIN cm USING (market_id))"""


CLOSED_NAMES = [
    "momentum_1h", "momentum_6h", "momentum_24h", "volatility_24h", "efficiency_ratio", "ripeness_hours",
]

MERGED = """mjoin AS (SELECT m.market_id, p.t, p.price, p.resolution, p.extract_ord,
    p.t BETWEEN m.end_s - 240 * 3600 AND m.end_s + 3600 AS near
  FROM points p JOIN mm m USING (token_id) WHERE p.price IS NOT NULL AND p.resolution IN ('1h', '1m')),
near AS (SELECT market_id, t, price FROM (SELECT *, row_number() OVER (PARTITION BY market_id, t ORDER BY resolution = '1m' DESC, extract_ord DESC) AS rn
  FROM mjoin WHERE near) WHERE rn = 1),
dense AS (SELECT market_id FROM near GROUP BY 1 HAVING count(*) >= 2),
wide AS (SELECT market_id, t, arg_max(price, extract_ord) AS price FROM mjoin WHERE resolution = '1h' GROUP BY 1, 2),
merged AS (
  SELECT market_id, t, price FROM near WHERE market_id IN (SELECT market_id FROM dense)
  UNION ALL SELECT market_id, t, price FROM wide WHERE market_id NOT IN (SELECT market_id FROM dense)
  UNION ALL SELECT market_id, t, price FROM near n WHERE market_id NOT IN (SELECT market_id FROM dense)
    AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.market_id = n.market_id AND w.t = n.t))"""

# ---- selection ---------------------------------------------------------------------------


def top_markets(source: str, n: int, cap: int | None = None) -> str:
    paged = "" if cap is None else f"pos <= {cap} AND "
    return f"""scan AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY vol DESC NULLS LAST, id) AS pos FROM ({source})),
picked AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY pos) AS pick FROM scan
  WHERE {paged}trim(id) <> '' AND len(toks) > 0 AND coalesce(vol, 0) >= 1000 AND coalesce(liq, 0) >= 600),
top AS (SELECT *, trim(id) AS market_id, toks[1] AS token_id FROM picked WHERE pick <= {n})"""


def h2h(col: str) -> str:
    q = f"trim(coalesce({col}, ''))"
    return f"""(NOT starts_with(lower({q}), 'will ') AND NOT starts_with(lower({q}), 'spread:') AND NOT contains(lower({q}), ': o/u')
      AND NOT (contains(lower({q}), 'o/u') AND contains(lower({q}), ' vs')) AND regexp_matches({q}, '(?i)[\\s\\x{{00a0}}]+vs\\.?[\\s\\x{{00a0}}]+')
      AND length(trim(regexp_split_to_array({q}, '(?i)[\\s\\x{{00a0}}]+vs\\.?[\\s\\x{{00a0}}]+')[1])) >= 2
      AND length(trim(regexp_replace({q}, '(?is)^.*?[\\s\\x{{00a0}}]+vs\\.?[\\s\\x{{00a0}}]+', ''))) >= 2)"""


def closed_pick(events: str = "", listings: str = "") -> str:
    """Candidates in scan order; a paging limit is a condition on the position."""
    return f"""ev AS (SELECT *, 's' || nk % 10 AS series_id, CASE WHEN k % 16 = 3 THEN ' ' ELSE name || ' vs. ' || rival END AS title,
    row_number() OVER (PARTITION BY nk % 10 ORDER BY end_s DESC, k) AS pos FROM rawtext WHERE closed),
nested AS (SELECT (nk % 10) % 5 AS sport_ord, 0 AS source_ord, (nk % 10) // 5 AS series_ord, pos, unnest([0, 1]) AS nested_ord, * EXCLUDE (pos) FROM ev {events}),
cand AS (
  SELECT sport_ord, source_ord, series_ord, pos, nested_ord, k, trim(CASE nested_ord WHEN 0 THEN id ELSE k || 'x' END) AS market_id,
    CASE WHEN nested_ord = 0 AND trim(coalesce(question, '')) <> '' THEN trim(question) ELSE trim(title) END AS title_used,
    CASE WHEN nested_ord = 0 THEN question END AS question FROM nested
  UNION ALL
  SELECT sport_ord, 1, 0, pos, 0, k, trim(id), trim(coalesce(question, '')), question FROM (
    SELECT *, list_position({SEGS}, seg) - 1 AS sport_ord,
      row_number() OVER (PARTITION BY seg ORDER BY end_ok DESC NULLS LAST, id) AS pos FROM rawtext WHERE closed) {listings}),
fit AS (
  SELECT c.*, r.* EXCLUDE (k, question) REPLACE (CASE WHEN source_ord = 1 AND r.k % 4 = 1 THEN
      [CAST(r.k + 7 AS VARCHAR), r.k || 'a'] ELSE toks END AS toks), CASE WHEN CAST(finals[1] AS VARCHAR) = '1' THEN 1 ELSE 0 END AS resolved
  FROM cand c JOIN rawtext r USING (k)
  WHERE market_id <> '' AND coalesce(mtype, '') NOT IN ('spreads', ' Totals ') AND {h2h('title_used')}
    AND NOT yes_no AND trim(names[1]) <> '' AND len(finals) = 2 AND finals[1] IN ('0', '1') AND (len(toks) >= 2 OR (source_ord = 1 AND r.k % 4 = 1))
    AND start_ok IS NOT NULL AND end_ok IS NOT NULL AND end_ok < {AS_OF} AND end_ok >= {AS_OF - MONTH}),
firstseen AS (SELECT *, row_number() OVER (PARTITION BY sport_ord, market_id ORDER BY source_ord, series_ord, pos, nested_ord) AS seen FROM fit),
closedpick AS (SELECT *, market_id || '|' || sport AS line FROM (SELECT *, lower({SEGS}[sport_ord + 1]) AS sport FROM (
    SELECT *, row_number() OVER (PARTITION BY sport_ord ORDER BY source_ord, series_ord, pos, nested_ord, market_id) AS pick
    FROM firstseen WHERE seen = 1) WHERE pick <= 20))"""


CLOSED_PICK = closed_pick()

# ---- active job ---------------------------------------------------------------------------

LOOK = 10 * 86400
ACTIVE = f"""tl AS (SELECT *, token_id || '|' || coalesce(start_ok, {AS_OF - LOOK}) AS line FROM top),
am AS (SELECT DISTINCT line AS market_id, token_id, coalesce(start_ok, {AS_OF - LOOK}) AS start_s FROM tl),
ap AS (SELECT m.market_id, p.resolution, p.t, arg_max(p.price, p.extract_ord) AS price
  FROM points p JOIN am m USING (token_id)
  WHERE p.price IS NOT NULL AND p.t >= greatest(m.start_s, {AS_OF - LOOK}) AND p.t <= {AS_OF} GROUP BY 1, 2, 3),
ac AS (SELECT market_id, count(*) FILTER (resolution = '1m') AS n1, count(*) FILTER (resolution = 'max') AS n2,
    count(*) FILTER (resolution = '1h') AS n3 FROM ap GROUP BY 1),
ause AS (SELECT market_id, CASE WHEN n1 >= 2 THEN '1m' WHEN n2 >= 2 THEN 'max' WHEN n3 >= 2 THEN '1h'
    WHEN n3 > 0 THEN '1h' WHEN n2 > 0 THEN 'max' WHEN n1 > 0 THEN '1m' END AS resolution FROM ac),
mprints AS (SELECT market_id, t, price FROM ap JOIN ause USING (market_id, resolution))"""


def active_grid() -> str:
    return month_grid("SELECT market_id, start_s FROM am").replace(str(AS_OF - MONTH), str(AS_OF - LOOK))


def active_parts() -> list[str]:
    return [
        POINTS, CUST, RAW_TEXT, LISTING, top_markets("SELECT * FROM listing WHERE active AND NOT closed", 200),
        ACTIVE, active_grid(), JUMPS, BOOKS,
        f"""acount AS (SELECT market_id, count(*) AS clob_points_raw FROM mprints GROUP BY 1),
arows AS (SELECT market_id, count(*) AS grid_rows, max(anchor) AS price_norm_anchor FROM anchored GROUP BY 1),
afeat AS (SELECT t.line, t.market_id, t.label AS classifier_label, t.tag_id, t.tag_slug, t.question, t.start_text, t.end_text, t.vol, t.liq,
    t.bal * 2 AS gamma_volume, t.liq_clob, t.start_ok, coalesce(t.start_ok, {AS_OF - LOOK}) AS start_s,
    {', '.join('j.' + n for n in JUMP_NAMES)},
    CASE WHEN j.n_valid >= 2 THEN (t.end_ok - {AS_OF}) / 3600.0::DOUBLE END AS feat_time_to_close_hours,
    coalesce(c.clob_points_raw, 0) / 240.0::DOUBLE AS feat_raw_prints_per_hour,
    {', '.join('f.' + n for n in BOOK_FEATURES)}, {', '.join('b.' + n for n in BOOK_COLS)},
    coalesce(b.ob_timestamp_ms, '') AS ob_timestamp_ms,
    coalesce(c.clob_points_raw, 0) AS clob_points_raw, coalesce(r.grid_rows, 0) AS grid_rows, r.price_norm_anchor
  FROM tl t LEFT JOIN jumps j ON j.market_id = t.line LEFT JOIN acount c ON c.market_id = t.line LEFT JOIN arows r ON r.market_id = t.line
  LEFT JOIN book b ON b.token_id = t.token_id LEFT JOIN bookfeat f ON f.token_id = t.token_id)""",
    ]


IDS = "market_id, classifier_label, tag_id, tag_slug"


def closed_parts() -> list[str]:
    return [
        POINTS, CUST, RAW_TEXT, CLOSED_PICK,
        "mm AS (SELECT line AS market_id, toks[1] AS token_id, start_ok AS start_s, end_ok AS end_s, vol AS volume FROM closedpick)",
        MERGED,
        closed_features("SELECT * FROM merged", "SELECT * FROM mm"),
        """h1 AS (SELECT token_id, t, arg_max(price, extract_ord) AS price FROM points WHERE price IS NOT NULL AND resolution = '1h' GROUP BY 1, 2),
m1 AS (SELECT token_id, t, arg_max(price, extract_ord) AS price FROM points WHERE price IS NOT NULL AND resolution = '1m' GROUP BY 1, 2)""",
        streaks("SELECT * FROM h1", "SELECT * FROM mm", 48),
    ]


def iso(expr: str) -> str:
    return f"strftime(make_timestamp({expr} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


TRADE = f"""{r6('vol', 'volume_num')}, {r6('liq', 'liquidity_num')}, {r6('bal / 4', 'liquidity')}, {r6('liq_clob', 'liquidity_clob')},
  0.0::DOUBLE AS liquidity_amm, {r6('bal * 2', 'volume')}, {r6('bal * 4', 'volume_clob')}, {r6('vol_1wk', 'volume_1wk_clob')},
  coalesce(bid, '') AS best_bid, coalesce(ask, '') AS best_ask"""

FEATURE64 = [f"f{i + 1}" for i in range(64)]
EMB = """emb AS (SELECT CAST(vec_id AS VARCHAR) AS market_id, 'label ' || label AS classifier_label, CAST(label AS VARCHAR) AS tag_id,
  'label-' || label AS tag_slug, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""

TOKS_JSON = """CASE WHEN toks IS NULL THEN NULL WHEN len(toks) = 0 THEN '[]'
  ELSE '["' || array_to_string(toks, '","') || '"]' END"""

ORACLES: dict[str, str] = {
    "scan_active_markets": ctes(CUST, RAW_TEXT, LISTING)
    + f"SELECT k, id, tag_id, {r6('vol', 'volume')} FROM listing WHERE active AND NOT closed",
    "scan_closed_markets": ctes(CUST, RAW_TEXT)
    + f"SELECT k, id, CAST(list_position({SEGS}, seg) + 9 AS VARCHAR) AS tag_id, end_text AS \"endDate\" FROM rawtext WHERE closed",
    "scan_event_markets": ctes(CUST)
    + """SELECT title, series_id, position, CASE position WHEN 0 THEN id ELSE k || 'x' END AS id,
      CASE WHEN position = 0 AND question IS NOT NULL THEN question ELSE trim(title) END AS question
      FROM (SELECT *, CASE WHEN k % 16 = 3 THEN ' ' ELSE name || ' vs. ' || rival END AS title, 's' || nk % 10 AS series_id,
        CAST(unnest([0, 1]) AS BIGINT) AS position FROM cust)""",
    "scan_price_history": ctes(POINTS)
    + f"""SELECT token_id, extract_ord, t, {r6('price')} FROM points WHERE extract_ord % 50 <> 0 AND price IS NOT NULL
      UNION ALL SELECT token_id, extract_ord, t + 2, 0.25::DOUBLE FROM points WHERE extract_ord % 50 <> 0""",
    "normalize_batch_history": ctes(POINTS)
    + f"""SELECT extract_ord, CASE WHEN extract_ord % 4 = 2 THEN 'a' || token_id ELSE token_id END AS token_id, t, {r6('price')}
      FROM points WHERE price IS NOT NULL""",
    "scan_features_csv": ctes(EMB)
    + f"SELECT {IDS}, " + ", ".join(r6(f"e[{i + 1}]", n) for i, n in enumerate(FEATURE64)) + " FROM emb",
    "parse_id_list": """SELECT DISTINCT market_id FROM (
      SELECT CAST(o_custkey AS VARCHAR) AS market_id FROM orders WHERE o_orderkey % 4 IN (1, 2)
      UNION ALL SELECT 'm' || o_orderkey FROM orders WHERE o_orderkey % 4 = 1)""",
    "atomic_write_roundtrip": ctes(CUST) + f"SELECT k, id, seg, {r6('bal * 2', 'volume')} FROM cust",
    "check_alignment": ctes(PRINTS, CUST)
    + """, f AS (SELECT DISTINCT token_id FROM prints), m AS (SELECT ks FROM cust)
      SELECT (SELECT count(*) FROM f) AS n_features, (SELECT count(*) FROM m) AS n_metadata,
        (SELECT count(*) FROM f WHERE token_id NOT IN (SELECT ks FROM m)) AS only_features,
        (SELECT count(*) FROM m WHERE ks NOT IN (SELECT token_id FROM f)) AS only_metadata,
        (SELECT count(*) FROM f) = (SELECT count(*) FROM m) AND (SELECT count(*) FROM m WHERE ks NOT IN (SELECT token_id FROM f)) = 0 AS aligned""",
    "dropped_ids": ctes(CUST, RAW_TEXT, LISTING)
    + "SELECT ks AS market_id FROM listing WHERE label NOT IN ('BUILDING', 'MACHINERY')",
    "prefilter_markets": ctes(CUST) + "SELECT k, id FROM cust WHERE coalesce(vol, 0) >= 1000 AND coalesce(liq, 0) >= 600",
    "prefilter_markets_at_zero": ctes(CUST)
    + """SELECT k, id FROM cust WHERE coalesce(vol, 0) >= 0 AND coalesce(liq, 0) >= 0
      AND NOT (k % 17 <> 4 AND k % 23 <> 9 AND k % 31 = 7)""",
    "yes_token": ctes(CUST)
    + "SELECT k, trim(id) AS market_id, toks[1] AS token_id FROM cust WHERE trim(id) <> '' AND len(toks) > 0",
    "market_type_filter": ctes(CUST)
    + "SELECT k, mtype AS \"sportsMarketType\" FROM cust WHERE mtype IS NULL OR mtype = 'moneyline'",
    "head_to_head_filter": ctes(CUST) + f"SELECT k, question FROM cust WHERE {h2h('question')}",
    "moneyline_filter": ctes(CUST, RAW_TEXT) + "SELECT k FROM rawtext WHERE NOT yes_no AND trim(names[1]) <> ''",
    "resolved_label": ctes(CUST, RAW_TEXT)
    + """SELECT k, CASE WHEN TRY_CAST(finals[pidx + 1] AS DOUBLE) > 0.5 THEN 1 ELSE 0 END AS resolved_yes FROM rawtext
      WHERE len(finals) = 2 AND TRY_CAST(finals[pidx + 1] AS DOUBLE) <> 0.5""",
    "end_date_window": ctes(CUST, RAW_TEXT)
    + f"""SELECT k, end_text AS "endDate" FROM rawtext WHERE start_ok IS NOT NULL AND end_ok < {AS_OF}
      AND end_ok >= {AS_OF - 25 * 86400} AND end_ok >= epoch(TIMESTAMP '2024-01-08') AND end_ok < epoch(TIMESTAMP '2024-01-28')""",
    "valid_price_filter": ctes(POINTS)
    + f"SELECT extract_ord, token_id, {r6('price')} FROM points WHERE price > 0 AND price < 1",
    "history_window": ctes(POINTS, CUST, MARKETS)
    + f"""SELECT m.market_id, extract_ord, t FROM points JOIN markets m USING (token_id)
      WHERE t BETWEEN greatest(coalesce(start_s, 0), {AS_OF - 20 * 86400}) AND {AS_OF}""",
    "category_split": ctes(CUST, RAW_TEXT, LISTING)
    + "SELECT k, tag_id, CASE WHEN label IN ('HOUSEHOLD', 'FURNITURE') THEN 'kept' ELSE 'dropped' END AS part FROM listing",
    "min_points_filter": ctes(*RAW_ROWS)
    + "SELECT market_id, count(price_yes) AS n_points FROM steps GROUP BY 1 HAVING count(price_yes) >= 40",
    "select_numeric": "SELECT c_acctbal, c_nationkey, c_acctbal > 0 AS in_credit FROM customer",
    "liquidity_snapshot": ctes(CUST)
    + f"""SELECT k, {r6('vol', 'gamma_volume_num')}, {r6('liq', 'gamma_liquidity_num')}, {r6('bal * 2', 'gamma_volume')},
      {r6('liq_clob', 'gamma_liquidity_clob')} FROM cust""",
    "trade_context": ctes(CUST) + f"SELECT k, {TRADE} FROM cust",
    "closed_metadata": ctes(CUST, RAW_TEXT, CLOSED_LIST)
    + f"""SELECT k, id, coalesce(question, 'untitled') AS question,
      CASE WHEN trim(coalesce(category, '')) = '' THEN lower(seg) ELSE category END AS category,
      {r6('vol', '"volumeNum"')}, {r6('liq', '"liquidityNum"')}, start_text AS "startDate", end_text AS "endDate",
      {TOKS_JSON} AS "clobTokenIds", lower(seg) AS sport_bucket FROM closedlist""",
    "primary_outcome": ctes(CUST, RAW_TEXT)
    + "SELECT k, CAST(pidx AS INTEGER) AS primary_index, trim(names[pidx + 1]) AS primary_outcome FROM rawtext",
    "grid_axes": ctes(*GRID_BASE, month_grid())
    + f"""SELECT market_id, unix_ts, lookback_step,
      CAST(floor((unix_ts - start_s // {SIX} * {SIX}) / {SIX}.0) AS BIGINT) AS normalized_step,
      {r6('(unix_ts - start_s) / 3600.0::DOUBLE', 'hours_since_market_start')} FROM grid""",
    "time_to_close": ctes(CUST) + f"SELECT k, {r6(f'(end_ok - {AS_OF}) / 3600.0::DOUBLE', 'time_to_close_hours')} FROM cust",
    "bucket_last": ctes(PRINTS)
    + f"SELECT token_id, t // 3600 * 3600 AS unix_ts, {r6('arg_max(price, t)', 'price_yes')} FROM prints GROUP BY 1, 2",
    "bucket_stats": ctes(PRINTS)
    + f"""SELECT token_id, t // {SIX} * {SIX} AS unix_ts, count(*) AS raw_prints_in_bucket, {r6('arg_max(price, t)', 'price_yes')},
      {r6('max(price) - min(price)', 'intrabucket_price_range')},
      {r6('CASE WHEN count(*) >= 2 THEN stddev_pop(price) END', 'intrabucket_price_stdev')} FROM prints GROUP BY 1, 2""",
    "price_grid": ctes(*GRID_BASE, month_grid()) + f"SELECT market_id, unix_ts, {r6('price_yes')} FROM grid",
    "grid_bucket_stats": ctes(*GRID_BASE, month_grid())
    + f"""SELECT market_id, unix_ts, n AS raw_prints_in_bucket, {r6('rng', 'intrabucket_price_range')},
      {r6('sd', 'intrabucket_price_stdev')} FROM grid""",
    "grid_with_placeholder": ctes(PRINTS, CUST, MARKETS)
    + f""", lines AS (SELECT market_id, unnest(range(end_s // 86400 * 86400, {AS_OF} + 1, 86400)) AS unix_ts FROM markets WHERE end_s < {AS_OF}),
      b AS (SELECT token_id AS market_id, t // 86400 * 86400 AS unix_ts, arg_max(price, t) AS price_yes FROM prints GROUP BY 1, 2)
      SELECT market_id, l.unix_ts, CASE WHEN l.unix_ts IS NULL THEN 'no_clob_in_window' ELSE '' END AS note, {r6('price_yes')}
      FROM markets LEFT JOIN lines l USING (market_id) LEFT JOIN b USING (market_id, unix_ts)""",
    "normalized_price": ctes(*GRID_BASE, month_grid())
    + f"SELECT market_id, unix_ts, {r6('norm', 'price_yes_norm')}, {r6('anchor', 'price_norm_anchor')} FROM anchored",
    "asof_hourly": ctes(PRINTS)
    + f""", lines AS (SELECT token_id, unnest(range(min(t) // 3600 * 3600, max(t) // 3600 * 3600 + 1, 3600)) AS unix_ts FROM prints GROUP BY 1)
      SELECT l.token_id, l.unix_ts, {r6('p.price', 'price_yes')}
      FROM lines l ASOF LEFT JOIN prints p ON p.token_id = l.token_id AND p.t <= l.unix_ts""",
    "asof_minute": ctes(PRINTS, CUST, MARKETS, streaks("SELECT * FROM prints", "SELECT * FROM markets", 48))
    + f""", inside AS (SELECT s.market_id, p.t, p.price FROM prints p JOIN streaks s USING (token_id) WHERE p.t BETWEEN segment_start AND segment_end AND status = 'ok'),
      lines AS (SELECT market_id, unnest(range(min(t) // 60 * 60, (max(t) + 59) // 60 * 60 + 1, 60)) AS unix_ts FROM inside GROUP BY 1)
      SELECT l.market_id, l.unix_ts, {r6('p.price', 'price_yes')}
      FROM lines l ASOF JOIN inside p ON p.market_id = l.market_id AND p.t <= l.unix_ts""",
    "segment_before_streak": ctes(PRINTS, CUST, MARKETS, streaks("SELECT * FROM prints", "SELECT * FROM markets", 48))
    + f"""SELECT s.market_id, p.t, {r6('p.price', 'price')}, CAST(p.t - segment_start AS DOUBLE) AS seconds_since_window_start,
      CAST(segment_end - p.t AS DOUBLE) AS seconds_until_window_end
      FROM prints p JOIN streaks s USING (token_id) WHERE p.t BETWEEN segment_start AND segment_end AND status = 'ok'""",
    "price_diff": ctes(*GRID_BASE, month_grid(), JUMPS) + f"SELECT market_id, unix_ts, {r6('change')} FROM changes",
    "jump_features": ctes(*GRID_BASE, month_grid(), JUMPS) + f"SELECT market_id, n_valid, {rs(JUMP_NAMES)} FROM jumps",
    "prints_per_hour": ctes(PRINTS)
    + f"SELECT token_id, {r6('count(*) / 720.0::DOUBLE', 'feat_raw_prints_per_hour')} FROM prints GROUP BY 1",
    "order_book_summary": ctes(BOOKS) + f"SELECT token_id, {rs(BOOK_COLS)}, ob_timestamp_ms FROM book",
    "book_features": ctes(BOOKS) + f"SELECT token_id, {rs(BOOK_FEATURES)} FROM bookfeat",
    "closed_features": ctes(
        PRINTS, MPRINTS, CUST, MARKETS,
        closed_features("SELECT * FROM mprints", "SELECT market_id, start_s, end_s, vol AS volume FROM markets"),
    )
    + f"SELECT market_id, {rs(CLOSED_NAMES)} FROM cfeat",
    "zscore": ctes(CUST)
    + ", z AS (SELECT k, vol AS volume_num, liq AS liquidity_num, bal * 2 AS volume, liq_clob AS liquidity_clob, 0.0::DOUBLE AS liquidity_amm FROM cust) SELECT k, "
    + z_columns(["volume_num", "liquidity_num", "volume", "liquidity_clob", "liquidity_amm"], "z") + " FROM z",
    "hourly_ffill": ctes(PRINTS)
    + f""", b AS (SELECT token_id, t // 3600 * 3600 AS unix_ts, arg_max(price, t) AS price FROM prints GROUP BY 1, 2),
      lines AS (SELECT token_id, unnest(range(min(unix_ts), max(unix_ts) + 1, 3600)) AS unix_ts FROM b GROUP BY 1)
      SELECT l.token_id, l.unix_ts, {r6('last_value(b.price IGNORE NULLS) OVER (PARTITION BY l.token_id ORDER BY l.unix_ts)', 'price_yes')}
      FROM lines l LEFT JOIN b USING (token_id, unix_ts)""",
    "rolling_volatility": ctes(PRINTS)
    + f""", b AS (SELECT token_id, t // 3600 * 3600 AS unix_ts, arg_max(price, t) AS price FROM prints GROUP BY 1, 2),
      lines AS (SELECT token_id, unnest(range(min(unix_ts), max(unix_ts) + 1, 3600)) AS unix_ts FROM b GROUP BY 1),
      f AS (SELECT l.token_id, l.unix_ts, last_value(b.price IGNORE NULLS) OVER (PARTITION BY l.token_id ORDER BY l.unix_ts) AS p
        FROM lines l LEFT JOIN b USING (token_id, unix_ts)),
      g AS (SELECT *, greatest(0.001, least(p, 0.999)) AS q FROM f),
      w AS (SELECT token_id, count(*) OVER w AS c, stddev_samp(ln(q / (1 - q))) OVER w AS s FROM g
        WINDOW w AS (PARTITION BY token_id ORDER BY unix_ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
      SELECT token_id, {r6('avg(CASE WHEN c >= 2 THEN s END)', 'volatility')} FROM w GROUP BY 1""",
    "detect_streak": ctes(PRINTS, CUST, MARKETS, streaks("SELECT * FROM prints", "SELECT * FROM markets", 2))
    + """SELECT market_id, CASE WHEN status = 'ok' THEN segment_start END AS segment_start,
      CASE WHEN status = 'ok' THEN segment_end END AS segment_end, status FROM streaks""",
    "sequence_dedup": ctes(*RAW_ROWS) + f"SELECT market_id, step, label AS classifier_label, {r6('price_yes')} FROM steps",
    "fill_sequence": ctes(*RAW_ROWS) + f"SELECT market_id, step, {r6('level')} FROM rich",
    "rich_features": ctes(*RAW_ROWS) + f"SELECT market_id, step, {rs(['level', 'diff'])} FROM rich",
    "sequence_matrix": ctes(*RAW_ROWS)
    + f""", v AS (SELECT market_id, pos AS slot, level AS value FROM rich UNION ALL
        SELECT market_id, pos + (SELECT count(*) FROM allsteps), diff FROM rich),
      s AS (SELECT slot, avg(value) AS m, CASE WHEN max(value) > min(value) THEN stddev_pop(value) ELSE 0 END AS d FROM v GROUP BY 1)
      SELECT market_id, slot, {r6('CASE WHEN d > 0 THEN greatest(-6.0::DOUBLE, least((value - m) / d, 6.0::DOUBLE)) ELSE 0.0::DOUBLE END', 'value')}
      FROM v JOIN s USING (slot)""",
    "label_index": ctes(EMB)
    + """SELECT row_number() OVER (ORDER BY classifier_label) - 1 AS label_class_index, classifier_label AS label_class
      FROM (SELECT DISTINCT classifier_label FROM emb)""",
    "top_markets_per_category": ctes(CUST, RAW_TEXT, LISTING, top_markets("SELECT * FROM listing", 30))
    + "SELECT tag_id, market_id, token_id, pick FROM top",
    "selection_shortfall": ctes(CUST, RAW_TEXT, LISTING, top_markets("SELECT * FROM listing", 150))
    + f"""SELECT d.tag_id, d.tag_slug, count(t.market_id) AS found, CAST(150 AS BIGINT) AS wanted, count(t.market_id) < 150 AS short
      FROM (SELECT CAST(i + 10 AS VARCHAR) AS tag_id, lower({SEGS}[i + 1]) AS tag_slug FROM range(5) r(i)) d
      LEFT JOIN top t USING (tag_id) GROUP BY 1, 2""",
    "select_closed_markets": ctes(CUST, RAW_TEXT, CLOSED_PICK)
    + "SELECT sport, market_id, title_used AS question, toks[1] AS token_id, resolved AS resolved_yes, pick FROM closedpick",
    "select_closed_markets_paged": ctes(CUST, RAW_TEXT, closed_pick("WHERE pos <= 80", "WHERE pos <= 200"))
    + "SELECT sport, market_id, title_used AS question, toks[1] AS token_id, resolved AS resolved_yes, pick FROM closedpick",
    "top_markets_paged": ctes(CUST, RAW_TEXT, LISTING, top_markets("SELECT * FROM listing", 120, 200))
    + "SELECT tag_id, market_id, token_id, pick FROM top",
    "list_categories": ctes(CUST, RAW_TEXT, LISTING) + "SELECT DISTINCT label AS classifier_label FROM listing ORDER BY 1",
    "history_coverage": ctes(POINTS, CUST, RAW_TEXT, LISTING)
    + """, w AS (SELECT DISTINCT toks[1] AS token_id FROM listing WHERE active AND NOT closed AND trim(id) <> '' AND len(toks) > 0)
      SELECT count(*) FILTER (token_id IN (SELECT token_id FROM points WHERE price IS NOT NULL)) AS tokens_with_data,
        count(*) AS tokens_total FROM w""",
    "enrich_question": ctes(CUST, RAW_TEXT, LISTING)
    + """SELECT ks AS market_id, tag_id, CASE WHEN active AND NOT closed THEN coalesce(question, '') ELSE '' END AS question FROM listing""",
    "exclude_ids": ctes(CUST, RAW_TEXT, LISTING) + "SELECT ks AS market_id, tag_id FROM listing WHERE NOT closed",
    "hash_sample": ctes(CUST) + "SELECT k, seg FROM cust ORDER BY md5(ks), k LIMIT 80",
    "dedupe_history": ctes(PRINTS) + f"SELECT token_id, t, {r6('price')} FROM prints",
    "merge_resolutions": ctes(POINTS, CUST, MARKETS, "mm AS (SELECT * FROM markets)", MERGED)
    + f"SELECT market_id, t, {r6('price')} FROM merged",
    "finest_resolution": ctes(POINTS)
    + f""", d AS (SELECT token_id, resolution, t, arg_max(price, extract_ord) AS price FROM points WHERE price IS NOT NULL GROUP BY 1, 2, 3),
      c AS (SELECT token_id, count(*) FILTER (resolution = '1m') AS n1, count(*) FILTER (resolution = 'max') AS n2,
        count(*) FILTER (resolution = '1h') AS n3 FROM d GROUP BY 1),
      u AS (SELECT token_id, CASE WHEN n1 >= 2 THEN '1m' WHEN n2 >= 2 THEN 'max' WHEN n3 >= 2 THEN '1h' WHEN n3 > 0 THEN '1h'
        WHEN n2 > 0 THEN 'max' ELSE '1m' END AS resolution FROM c)
      SELECT token_id, resolution, t, {r6('price')} FROM d JOIN u USING (token_id, resolution)""",
    "parse_json_field": ctes(CUST)
    + """SELECT k, coalesce(array_to_string(toks, '|'), '') AS "clobTokenIds", CASE WHEN toks IS NULL THEN 0 ELSE 1 END AS "has_clobTokenIds",
      array_to_string(names, '|') AS outcomes, array_to_string(finals, '|') AS "outcomePrices" FROM cust""",
    "lenient_cast": ctes(CUST)
    + f"""SELECT k, {r6('vol', '"volumeNum"')}, {r6('liq', '"liquidityNum"')}, {r6('liq_clob', '"liquidityClob"')},
      {r6('vol_1wk', '"volume1wkClob"')}, {r6('TRY_CAST(bid AS DOUBLE)', '"bestBid"')} FROM cust""",
    "lenient_timestamp": ctes(CUST) + 'SELECT k, start_ok AS "startDate", end_ok AS "endDate" FROM cust',
    "logit": ctes(PRINTS)
    + f"""SELECT token_id, t, {r6('ln(q / (1 - q))', 'logit')} FROM (SELECT *, greatest(0.001, least(price, 0.999)) AS q FROM prints)""",
    "floor_ceil_ts": ctes(POINTS)
    + """SELECT extract_ord, t // 25200 * 25200 AS floor_7h, (t + 1799) // 1800 * 1800 AS ceil_30min FROM points""",
    "feature_correlations": ctes(EMB)
    + f""", s AS (SELECT list_sum(e[1:32]) / 32 AS p1, list_sum(e[33:64]) / 32 AS p2, e FROM emb),
      l AS (SELECT i, e[i] AS x, p1, p2 FROM s, range(1, 65) r(i))
      SELECT 'f' || i AS feature, 'PC1' AS target, {r6('corr(x, p1)', 'correlation')} FROM l GROUP BY i
      UNION ALL SELECT 'f' || i, 'PC2', round(corr(x, p2), 6) + 0.0 FROM l GROUP BY i""",
    "scores_by_time_to_close": ctes(CUST, RAW_TEXT, LISTING)
    + f"""SELECT row_number() OVER (ORDER BY end_ok ASC NULLS LAST, ks, tag_id) - 1 AS rank, ks AS market_id, tag_id,
      {r6(f'(end_ok - {AS_OF}) / 3600.0::DOUBLE', 'hours')}, {r6('bal * 2', '"PC1"')}, {r6('bal / 4', '"PC2"')} FROM listing""",
    "pairwise_distance": ctes(EMB)
    + f""", s AS (SELECT * FROM emb ORDER BY md5(market_id), market_id LIMIT 80)
      SELECT a.market_id AS market_a, b.market_id AS market_b, a.classifier_label || ': ' || a.market_id AS label_a,
        b.classifier_label || ': ' || b.market_id AS label_b, {r6('list_distance(a.e, b.e)', 'distance')} FROM s a, s b""",
    "active_features": ctes(*active_parts()) + f"SELECT {IDS}, {z_columns(ALL_FEATURES, 'afeat')} FROM afeat",
    "active_metadata": ctes(*active_parts())
    + f"""SELECT {IDS}, question, start_text AS "startDate", end_text AS "endDate", {r6('vol', '"volumeNum"')}, {r6('liq', '"liquidityNum"')},
      6.0::DOUBLE AS interval_hours, 10.0::DOUBLE AS lookback_days, 240.0::DOUBLE AS lookback_hours_used, clob_points_raw, grid_rows,
      '6h' AS grid_freq, 'snapshot_at_fetch_not_historical' AS ob_note, {r6('price_norm_anchor')},
      {r6('vol', 'gamma_volume_num')}, {r6('liq', 'gamma_liquidity_num')}, {r6('gamma_volume')}, {r6('liq_clob', 'gamma_liquidity_clob')},
      {rs(BOOK_COLS)}, ob_timestamp_ms, {rs(ALL_FEATURES)} FROM afeat""",
    "active_raw_grid": ctes(*active_parts())
    + f"""SELECT {IDS}, question, {iso('g.unix_ts')} AS timestamp_iso, g.unix_ts, {r6('price_yes')}, {r6('norm', 'price_yes_norm')},
      CAST(floor((g.unix_ts - g.start_s // {SIX} * {SIX}) / {SIX}.0) AS BIGINT) AS normalized_step, lookback_step,
      {r6('(g.unix_ts - g.start_s) / 3600.0::DOUBLE', 'hours_since_market_start')}, {iso('g.start_s')} AS gamma_market_start_iso,
      '6h' AS grid_interval, 6.0::DOUBLE AS interval_hours, 10.0::DOUBLE AS lookback_days, n AS raw_prints_in_bucket,
      {r6('rng', 'intrabucket_price_range')}, {r6('sd', 'intrabucket_price_stdev')}, {r6('vol', 'gamma_volume_num')},
      {r6('liq', 'gamma_liquidity_num')}, {r6('gamma_volume')}, {r6('liq_clob', 'gamma_liquidity_clob')}, {rs(BOOK_COLS)},
      ob_timestamp_ms, '' AS note FROM (SELECT * RENAME (market_id AS line) FROM anchored) g JOIN afeat a USING (line)""",
    "closed_pipeline": ctes(*closed_parts())
    + f"""SELECT market_id, sport, resolved AS resolved_yes, {z_columns(CLOSED_NAMES, 'x')}
      FROM closedpick LEFT JOIN (SELECT * RENAME (market_id AS line) FROM cfeat) USING (line)""",
    "closed_pipeline_metadata": ctes(*closed_parts())
    + f"""SELECT p.market_id AS id, CASE WHEN trim(coalesce(question, '')) = '' THEN title_used ELSE question END AS question,
      CASE WHEN trim(coalesce(category, '')) = '' THEN sport ELSE category END AS category,
      {r6('vol', '"volumeNum"')}, {r6('liq', '"liquidityNum"')}, start_text AS "startDate", end_text AS "endDate",
      {TOKS_JSON} AS "clobTokenIds", sport AS sport_bucket, s.status AS skew_segment_status,
      coalesce({iso('s.segment_start')}, '') AS inferred_game_start_iso, coalesce({iso('s.segment_end')}, '') AS inferred_game_end_iso
      FROM closedpick p JOIN (SELECT * RENAME (market_id AS line) FROM streaks) s USING (line)""",
    "closed_pipeline_segments": ctes(*closed_parts())
    + f"""SELECT p.market_id, sport, title_used AS question, trim(names[1]) AS primary_outcome,
      {iso('start_ok')} AS gamma_listing_start_iso, {iso('end_ok')} AS gamma_listing_end_iso,
      coalesce({iso('s.segment_start')}, '') AS inferred_game_start_iso, coalesce({iso('s.segment_end')}, '') AS inferred_game_end_iso,
      s.status AS skew_segment_status, CASE WHEN s.status = 'ok' THEN '1m_after_skew_detect' ELSE 'no_1m_segment' END AS clob_sources,
      false AS minute_grid_ffill, {TRADE}, {iso('m.t')} AS timestamp_iso, m.t AS unix_ts, {r6('m.price', 'price_primary_token')},
      CAST(m.t - s.segment_start AS DOUBLE) AS seconds_since_window_start, CAST(s.segment_end - m.t AS DOUBLE) AS seconds_until_window_end,
      CASE WHEN s.status <> 'ok' THEN s.status WHEN m.t IS NULL THEN 'no_1m_points_in_segment' ELSE '' END AS note
      FROM closedpick p JOIN (SELECT * RENAME (market_id AS line) FROM streaks) s USING (line)
      LEFT JOIN m1 m ON m.token_id = s.token_id AND s.status = 'ok' AND m.t BETWEEN s.segment_start AND s.segment_end""",
}
ORACLES["excluded_count"] = (
    ctes(CUST, RAW_TEXT, LISTING) + "SELECT count(*) AS n_excluded FROM listing WHERE closed"
)
ORACLES["label_one_hot"] = ctes(EMB) + """SELECT market_id, slot, CASE WHEN slot = own THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot
  FROM (SELECT market_id, dense_rank() OVER (ORDER BY classifier_label) - 1 AS own FROM emb),
    range((SELECT count(DISTINCT classifier_label) FROM emb)) r(slot)"""
ORACLES["top_correlations"] = ctes(EMB) + f""", s AS (SELECT list_sum(e[1:32]) / 32 AS p1, list_sum(e[33:64]) / 32 AS p2, e FROM emb),
  l AS (SELECT i, e[i] AS x, p1, p2 FROM s, range(1, 65) r(i)),
  c AS (SELECT 'f' || i AS feature, 'PC1' AS target, corr(x, p1) AS v FROM l GROUP BY i
    UNION ALL SELECT 'f' || i, 'PC2', corr(x, p2) FROM l GROUP BY i)
  SELECT target, place, feature, {r6('v', 'correlation')} FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(v) DESC, feature) AS place FROM c) WHERE place <= 8"""
ORACLES["scan_order_books"] = f"""WITH b AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS token_id, CAST(l_orderkey AS VARCHAR) AS ob_timestamp_ms,
    0.5::DOUBLE - l_discount AS ob_best_bid, l_quantity * 3 AS bd,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 5 = 0 THEN 0.6::DOUBLE + l_tax ELSE 0.5::DOUBLE + l_tax END AS ob_best_ask,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 5 = 0 THEN l_quantity * 4 ELSE l_quantity * 5 END AS ad
  FROM lineitem)
  SELECT token_id, ob_timestamp_ms, {rs(['ob_best_bid', 'ob_best_ask'])}, {r6('(ob_best_bid + ob_best_ask) / 2', 'ob_mid')},
    {r6('ob_best_ask - ob_best_bid', 'ob_spread')}, {r6('CASE WHEN bd + ad > 0 THEN bd END', 'ob_bid_depth_topn')},
    {r6('CASE WHEN bd + ad > 0 THEN ad END', 'ob_ask_depth_topn')},
    {r6('CASE WHEN bd + ad > 0 THEN (bd - ad) / (bd + ad) END', 'ob_imbalance_topn')} FROM b"""
# ---- networks with weights from a formula --------------------------------------------------

AE_WIDTHS = [(64, 8), (8, 4), (4, 2), (2, 4), (4, 8), (8, 64), (2, 3)]
CVAE_WIDTHS = [(67, 8), (8, 4), (4, 2), (4, 2), (5, 4), (4, 8), (8, 64)]
NET_SRC = "src AS (SELECT CAST(vec_id AS VARCHAR) AS market_id, CAST(embedding AS DOUBLE[]) AS a0, label % 3 AS own FROM embeddings)"


def weights(widths: list[tuple[int, int]]) -> list[str]:
    shapes = ", ".join(f"({l}, {a}, {b})" for l, (a, b) in enumerate(widths))
    return [
        f"shapes AS (SELECT * FROM (VALUES {shapes}) s(l, n_in, n_out))",
        "bias AS (SELECT l, j, ((j * 3 + l) % 7 - 3) / 20.0::DOUBLE AS v FROM shapes, range(64) r(j) WHERE j < n_out)",
        """weight AS (SELECT l, i, j, ((i * 7 + j * 13 + l * 5) % 23 - 11) / 40.0::DOUBLE AS v
          FROM shapes, range(67) q(i), range(64) r(j) WHERE i < n_in AND j < n_out)""",
    ]


def by_layer(tag: str = "") -> list[str]:
    """Lists of each layer: columns (by output), rows (by input), biases."""
    return [
        f"cols{tag} AS (SELECT l, list(c ORDER BY j) AS c FROM (SELECT l, j, list(v ORDER BY i) AS c FROM weight{tag} GROUP BY 1, 2) GROUP BY 1)",
        f"rows{tag} AS (SELECT l, list(c ORDER BY i) AS c FROM (SELECT l, i, list(v ORDER BY j) AS c FROM weight{tag} GROUP BY 1, 2) GROUP BY 1)",
        f"biases{tag} AS (SELECT l, list(v ORDER BY j) AS b FROM bias{tag} GROUP BY 1)",
    ]


def layer(x: str, l: int, n_out: int, squash: bool = True, tag: str = "") -> str:
    u = f"list_dot_product({x}, cols{tag}_{l}[j]) + biases{tag}_{l}[j]"
    return f"[{'tanh(' + u + ')' if squash else u} for j in range(1, {n_out + 1})]"


def chain(source: str, steps: list[tuple[str, str]], name: str) -> list[str]:
    """CTEs that add one column each; ``cols_0`` and the like stand for the lists of a layer."""
    out, last = [], source
    for n, (column, sql) in enumerate(steps):
        used = sorted(set(re.findall(r"\b((?:cols|rows|biases)2?)_(\d)\b", sql)))
        from_lists = "".join(
            f", (SELECT {'b' if t.startswith('b') else 'c'} AS {t}_{l} FROM {t} WHERE l = {l})" for t, l in used
        )
        out.append(f"{name}{n} AS (SELECT s.*, {sql} AS {column} FROM {last} s{from_lists}, (SELECT count(*) AS n_src FROM src))")
        last = f"{name}{n}"
    return out


ENCODE = [("a1", layer("a0", 0, 8)), ("a2", layer("a1", 1, 4)), ("a3", layer("a2", 2, 2))]
DECODE = [("a4", layer("a3", 3, 4)), ("a5", layer("a4", 4, 8)), ("a6", layer("a5", 5, 64, False))]
Z12 = f"SELECT market_id, {r6('a3[1]', 'z1')}, {r6('a3[2]', 'z2')} FROM "
ORACLES["ae_encode"] = ctes(NET_SRC, *weights(AE_WIDTHS), *by_layer(), *chain("src", ENCODE, "f")) + Z12 + "f2"
ORACLES["ae_reconstruction"] = (
    ctes(NET_SRC, *weights(AE_WIDTHS), *by_layer(), *chain("src", ENCODE + DECODE, "f"))
    + f"""SELECT count(*) AS n_rows, {r6('sum(list_sum([(a6[j] - a0[j]) ** 2 for j in range(1, 65)])) / sum(64)', 'mse')},
      0.0::DOUBLE AS mean_kl FROM f5"""
)
GIVEN = "[CASE WHEN own = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for j in range(0, 3)]"
CVAE_ENCODE = [
    ("y", GIVEN), ("given", "a0 || y"), ("a1", layer("given", 0, 8)), ("a2", layer("a1", 1, 4)),
    ("a3", layer("a2", 2, 2, False)), ("lv", f"[greatest(-8, least(8, q)) for q in {layer('a2', 3, 2, False)}]"),
]
CVAE_DECODE = [("zy", "a3 || y"), ("a4", layer("zy", 4, 4)), ("a5", layer("a4", 5, 8)), ("a6", layer("a5", 6, 64, False))]
ORACLES["cvae_encode"] = ctes(NET_SRC, *weights(CVAE_WIDTHS), *by_layer(), *chain("src", CVAE_ENCODE, "f")) + Z12 + "f5"
ORACLES["cvae_reconstruction"] = (
    ctes(NET_SRC, *weights(CVAE_WIDTHS), *by_layer(), *chain("src", CVAE_ENCODE + CVAE_DECODE, "f"))
    + f"""SELECT count(*) AS n_rows, {r6('sum(list_sum([(a6[j] - a0[j]) ** 2 for j in range(1, 65)])) / sum(64)', 'mse')},
      {r6('avg(-0.5 * list_sum([1 + lv[j] - a3[j] ** 2 - exp(lv[j]) for j in range(1, 3)]))', 'mean_kl')} FROM f9"""
)


def pull(upstream: str, l: int, n_in: int) -> str:
    return f"[list_dot_product({upstream}, rows_{l}[i]) for i in range(1, {n_in + 1})]"


def through(upstream: str, a: str, n: int) -> str:
    return f"[{upstream}[i] * (1 - {a}[i] ** 2) for i in range(1, {n + 1})]"


def descended(last: str, sides: list[tuple[int, str, str]], free: int) -> list[str]:
    """Weights and biases after one descent; ``sides`` are (layer, its input, gradient of its output)."""
    grads = " UNION ALL ".join(
        f"SELECT {l} AS l, i - 1 AS i, j - 1 AS j, sum({a}[i] * {d}[j]) AS g FROM {last}, range(1, len({a}) + 1) q(i), range(1, len({d}) + 1) r(j) GROUP BY i, j"
        for l, a, d in sides
    )
    biases = " UNION ALL ".join(
        f"SELECT {l} AS l, j - 1 AS j, sum({d}[j]) AS g FROM {last}, range(1, len({d}) + 1) r(j) GROUP BY j" for l, _, d in sides
    )
    return [
        f"grads AS ({grads})", f"bias_grads AS ({biases})",
        "decayed AS (SELECT l, i, j, v, g + 1e-4 * v AS g FROM weight JOIN grads USING (l, i, j))",
        "rate AS (SELECT 0.05 * least(1.0::DOUBLE, 5.0 / sqrt(sum(g * g))) AS r FROM decayed)",
        f"weight2 AS (SELECT l, i, j, CASE WHEN l = {free} THEN v - r * g ELSE greatest(-4, least(4, v - r * g)) END AS v FROM decayed, rate)",
        "bias2 AS (SELECT l, j, v - r * g AS v FROM bias JOIN bias_grads USING (l, j), rate)",
        *by_layer("2"),
    ]


def one_step(head: bool) -> str:
    """One full-batch descent by the chain rule, then the encoder with the new weights."""
    n = "n_src"
    back = [
        ("d6", f"[2 * (a6[j] - a0[j]) / {n} for j in range(1, 65)]"),
        ("u5", pull("d6", 5, 8)), ("d5", through("u5", "a5", 8)),
        ("u4", pull("d5", 4, 4)), ("d4", through("u4", "a4", 4)),
        ("u3", pull("d4", 3, 2)),
    ]
    if head:
        back += [
            ("logit", layer("a3", 6, 3, False)),
            ("dc", f"[(exp(logit[j + 1]) / list_sum([exp(q) for q in logit]) - CASE WHEN own = j THEN 1 ELSE 0 END) / {n} for j in range(0, 3)]"),
            ("uc", pull("dc", 6, 2)), ("w3", "[u3[i] + 0.75 * uc[i] for i in range(1, 3)]"),
        ]
    back += [
        ("d3", through("w3" if head else "u3", "a3", 2)),
        ("u2", pull("d3", 2, 4)), ("d2", through("u2", "a2", 4)),
        ("u1", pull("d2", 1, 8)), ("d1", through("u1", "a1", 8)),
    ]
    last = f"g{len(back) - 1}"
    sides = [(0, "a0", "d1"), (1, "a1", "d2"), (2, "a2", "d3"), (3, "a3", "d4"), (4, "a4", "d5"), (5, "a5", "d6")]
    if head:
        sides.append((6, "a3", "dc"))
    return ctes(
        NET_SRC, *weights(AE_WIDTHS if head else AE_WIDTHS[:6]), *by_layer(),
        *chain("src", ENCODE + DECODE, "f"), *chain("f5", back, "g"), *descended(last, sides, free=6),
        *chain("src", [("a1", layer("a0", 0, 8, tag="2")), ("a2", layer("a1", 1, 4, tag="2")), ("a3", layer("a2", 2, 2, tag="2"))], "h"),
    ) + Z12 + "h2"


def noise_steps() -> list[str]:
    """Normal noise of (row key, column) in epoch 0: two mixed counters of 64 bits each, Box-Muller."""
    whole = "18446744073709551616::UHUGEINT"
    start = (42 * 0x9E3779B97F4A7C15) % 2**64
    steps = [
        f"""n0 AS (SELECT market_id, c, o, CAST((CAST(market_id AS UHUGEINT) + {start}::UHUGEINT
          + c::UHUGEINT * {0x632BE59BD9B4E019}::UHUGEINT
          + CASE o WHEN 0 THEN {0x2545F4914F6CDD1D}::UHUGEINT ELSE {0x1F83D9AB}::UHUGEINT END) % {whole} AS UBIGINT) AS h
          FROM (SELECT CAST(vec_id AS VARCHAR) AS market_id FROM embeddings), range(2) q(c), range(2) r(o))"""
    ]
    for k, (shift, factor) in enumerate(((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))):
        steps.append(
            f"n{k + 1} AS (SELECT market_id, c, o, CAST((xor(h, h // {1 << shift}::UBIGINT)::UHUGEINT * {factor}::UHUGEINT) % {whole} AS UBIGINT) AS h FROM n{k})"
        )
    return steps + [
        f"n3 AS (SELECT market_id, c, o, (CAST(xor(h, h // {1 << 31}::UBIGINT) // 2048::UBIGINT AS DOUBLE) + 0.5) / 9007199254740992 AS u FROM n2)",
        """noise AS (SELECT market_id, list(e ORDER BY c) AS eps FROM (
          SELECT market_id, c, sqrt(-2 * ln(max(u) FILTER (o = 0))) * cos(2 * pi() * max(u) FILTER (o = 1)) AS e
          FROM n3 GROUP BY 1, 2) GROUP BY 1)""",
        "drawn AS (SELECT src.*, eps FROM src JOIN noise USING (market_id))",
    ]


def cvae_step() -> str:
    """One full-batch descent of the conditional model, then its encoder with the new weights."""
    n = "n_src"
    forward = CVAE_ENCODE + [
        ("dev", "[exp(0.5 * q) for q in lv]"), ("z", "[a3[i] + dev[i] * eps[i] for i in range(1, 3)]"), ("zy", "z || y"),
        ("a4", layer("zy", 4, 4)), ("a5", layer("a4", 5, 8)), ("a6", layer("a5", 6, 64, False)),
    ]
    back = [
        ("d6", f"[2 * (a6[j] - a0[j]) / {n} for j in range(1, 65)]"),
        ("u5", pull("d6", 6, 8)), ("d5", through("u5", "a5", 8)),
        ("u4", pull("d5", 5, 4)), ("d4", through("u4", "a4", 4)),
        ("u3", pull("d4", 4, 5)),
        ("dm", f"[u3[i] + 0.5 * a3[i] / {n} for i in range(1, 3)]"),
        ("dl", f"[u3[i] * 0.5 * dev[i] * eps[i] + 0.5 * 0.5 * (exp(lv[i]) - 1) / {n} for i in range(1, 3)]"),
        ("um", pull("dm", 2, 4)), ("ul", pull("dl", 3, 4)), ("u2", "[um[i] + ul[i] for i in range(1, 5)]"),
        ("d2", through("u2", "a2", 4)),
        ("u1", pull("d2", 1, 8)), ("d1", through("u1", "a1", 8)),
    ]
    sides = [(0, "given", "d1"), (1, "a1", "d2"), (2, "a2", "dm"), (3, "a2", "dl"), (4, "zy", "d4"), (5, "a4", "d5"), (6, "a5", "d6")]
    return ctes(
        NET_SRC, *noise_steps(), *weights(CVAE_WIDTHS), *by_layer(),
        *chain("drawn", forward, "f"), *chain(f"f{len(forward) - 1}", back, "g"),
        *descended(f"g{len(back) - 1}", sides, free=-1),
        *chain("src", [("y", GIVEN), ("given", "a0 || y"), ("a1", layer("given", 0, 8, tag="2")),
                       ("a2", layer("a1", 1, 4, tag="2")), ("a3", layer("a2", 2, 2, False, tag="2"))], "h"),
    ) + Z12 + "h4"


ORACLES["cvae_one_step"] = cvae_step()
ORACLES["ae_one_step"] = one_step(False)
ORACLES["semi_one_step"] = one_step(True)
PC_NAMES = [f"PC{i + 1}" for i in range(20)]
EMB_SRC = "src AS (SELECT market_id AS rid, e FROM emb)"
ORACLES["pca_scores"] = recursive(EMB, EMB_SRC, *eigen(64, 20)) + "SELECT market_id, classifier_label, " + ", ".join(
    r6(f"max(CASE WHEN k = {i + 1} THEN score END)", n) for i, n in enumerate(PC_NAMES)
) + " FROM scores JOIN emb ON rid = market_id GROUP BY 1, 2"
ORACLES["pca_scree"] = recursive(EMB, EMB_SRC, *eigen(64, 20)) + f"""SELECT k AS component, 'PC' || k AS label, {r6('ratio', 'variance_ratio')},
  {r6('sum(ratio) OVER (ORDER BY k)', 'cumulative_ratio')} FROM pc"""
ORACLES["pca_loadings"] = recursive(EMB, EMB_SRC, *eigen(64, 20)) + f"""SELECT 'f' || i AS feature, k AS component, {r6('vec[i]', 'loading')}
  FROM pc, range(1, 65) r(i)"""
ORACLES["pca_top_features"] = recursive(EMB, EMB_SRC, *eigen(64, 20)) + """SELECT 'f' || i AS feature,
  round(sqrt(sum(vec[i] * vec[i])), 6) + 0.0 AS loading_norm FROM pc, range(1, 65) r(i) GROUP BY i ORDER BY sqrt(sum(vec[i] * vec[i])) DESC LIMIT 8"""
N_ACTIVE = len(ALL_FEATURES)
ORACLES["pca_report"] = (
    recursive(
        *active_parts(),
        "zs AS (SELECT line, market_id, classifier_label, tag_id, " + ", ".join(f"{z_value(n)} AS {n}" for n in ALL_FEATURES) + " FROM afeat)",
        f"src AS (SELECT market_id || ':' || tag_id AS rid, [{', '.join(ALL_FEATURES)}] AS e FROM zs)",
        *eigen(N_ACTIVE, N_ACTIVE),
        f"names AS (SELECT i, [{', '.join(repr(n) for n in ALL_FEATURES)}][i] AS feature FROM range(1, {N_ACTIVE + 1}) r(i))",
        """long AS (SELECT 'PC' || s.k AS target, n.feature, f.e[n.i] AS x, s.score FROM src f JOIN scores s USING (rid), names n WHERE s.k <= 2)""",
        """corrs AS (SELECT target, feature, corr(x, score) AS v FROM long GROUP BY 1, 2 HAVING stddev_pop(x) > 1e-12 AND stddev_pop(score) > 1e-12)""",
        """best AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(v) DESC, feature) AS place FROM corrs)""",
        """sample AS (SELECT market_id || ':' || tag_id AS rid, classifier_label || ': ' || market_id AS name FROM zs
          ORDER BY md5(market_id), market_id, classifier_label LIMIT 80)""",
        # Directions without variance add nothing to a distance.
        """spots AS (SELECT name, list(score ORDER BY k) AS p FROM sample JOIN scores USING (rid) JOIN pc USING (k)
          WHERE k <= 10 AND ratio > 1e-9 GROUP BY rid, name)""",
    )
    + f"""SELECT 'score' AS part, rid AS key, 'PC' || k AS item, {r6('score', 'value')} FROM scores WHERE k <= 2
  UNION ALL SELECT 'correlation', feature, target, round(v, 6) + 0.0 FROM best WHERE place <= 8
  UNION ALL SELECT 'scree', 'PC' || k, 'ratio', round(ratio, 6) + 0.0 FROM pc
  UNION ALL SELECT 'distance', a.name, b.name, round(list_distance(a.p, b.p), 6) + 0.0 FROM spots a, spots b"""
)
ORACLES["landed_active_features"] = ORACLES["active_features"]
ORACLES["landed_closed_pipeline"] = ORACLES["closed_pipeline"]
ORACLES["landed_grid_paths"] = (
    ctes(
        *active_parts(),
        """rawrows AS (SELECT a.market_id, g.unix_ts, g.lookback_step AS step, g.price_yes, a.classifier_label AS label,
          a.classifier_label AS category_ord FROM (SELECT * RENAME (market_id AS line) FROM anchored) g JOIN afeat a USING (line))""",
        *RAW_ROWS[8:],
    )
    + f"SELECT market_id, step, {rs(['level', 'diff'])} FROM rich"
)
# A list of CTEs ends with a newline; some queries add further ones after a comma.
ORACLES = {k: v.replace("\n,", ",").replace("\n      ,", ",") for k, v in ORACLES.items()}

# The latest snapshot is that of the highest number: unreadable stamps, and older ones, change nothing.
ORACLES["latest_order_books"] = ORACLES["order_book_summary"]

# A store that extracts were added to gives what the points give at once.
ORACLES["stored_merge_resolutions"] = ORACLES["merge_resolutions"]
ORACLES["stored_finest_resolution"] = ORACLES["finest_resolution"]
