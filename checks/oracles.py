"""The same results as plain SQL (DuckDB dialect) on the same tables."""

from __future__ import annotations

UNIT = "4294967296"


def h(seed: int, tag: str, *key: str) -> str:
    return f"md5(concat_ws(':', '{seed}', '{tag}', {', '.join(f'({k})::VARCHAR' for k in key)}))"


def u32(seed: int, tag: str, *key: str) -> str:
    return f"(('0x' || substr({h(seed, tag, *key)}, 1, 8))::BIGINT + 1)"


def u(seed: int, tag: str, *key: str) -> str:
    return f"({u32(seed, tag, *key)} / 4294967296.0::DOUBLE)"


def minor(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def srs(table: str, key: str, n: str, seed: int, tag: str = "srs", columns: str = "", where: str = "true") -> str:
    order = f"{h(seed, tag, key)}, {key}"
    return (
        f"SELECT {columns or key}, CAST(row_number() OVER (ORDER BY {order}) <= {n} AS INTEGER) AS is_sample "
        f"FROM {table} WHERE {where}"
    )


def largest_remainder(source: str, strata: str, n: int) -> str:
    """stratum columns, stratum_size, allocated."""
    return f"""
    SELECT {strata}, stratum_size,
           CAST(base + CAST(row_number() OVER (ORDER BY rem DESC, stratum_size DESC, {strata})
                            <= {n} - sum(base) OVER () AS BIGINT) AS BIGINT) AS allocated
    FROM (SELECT {strata}, c AS stratum_size, (c * {n}) // t AS base, (c * {n}) % t AS rem
          FROM (SELECT {strata}, count(*) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS t FROM {source} GROUP BY {strata}))"""


def half_even_allocation(source: str, stratum: str, n: int) -> str:
    return f"""
    SELECT {stratum}, c AS stratum_size,
           CAST(s + CASE WHEN row_number() OVER (ORDER BY s DESC, {stratum}) <= abs({n} - sum(s) OVER ()) AND s > 0
                    THEN sign({n} - sum(s) OVER ()) ELSE 0 END AS BIGINT) AS allocated
    FROM (SELECT {stratum}, c,
                 q + CAST(2 * r > t OR (2 * r = t AND q % 2 = 1) AS BIGINT) AS s
          FROM (SELECT {stratum}, c, t, (c * {n}) // t AS q, (c * {n}) % t AS r
                FROM (SELECT {stratum}, count(*) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS t
                      FROM {source} GROUP BY {stratum})))"""


def mus(
    source: str, key: str, value: str, n: str, seed: int, order: str, stratum: str | None = None,
    allocation: str | None = None, topup: bool = True,
) -> str:
    """Keys selected by monetary units: one join of every drawn unit to the row that covers it."""
    s = stratum or "''"
    plan = allocation or f"SELECT '' AS s, CAST(({n}) AS BIGINT) AS n"
    race = f"-ln({u(seed, 'race', 'r.k')}) / r.m::DOUBLE"
    more = f"""
      UNION ALL
      SELECT k FROM (
        SELECT r.k, p.n - g.got AS need, row_number() OVER (PARTITION BY r.s ORDER BY {race}, r.k) AS rn
        FROM rows r JOIN plan p USING (s) JOIN size z USING (s)
        JOIN (SELECT s, (SELECT count(*) FROM hits h WHERE h.s = p.s) AS got FROM plan p) g USING (s)
        WHERE z.c > p.n AND z.t > 0 AND r.m > 0 AND r.k NOT IN (SELECT k FROM hits)) WHERE rn <= need""" if topup else ""
    return f"""
    WITH rows AS (
      SELECT {key} AS k, {s} AS s, {minor(value)} AS m,
             sum({minor(value)}) OVER (PARTITION BY {s} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS hi
      FROM {source}),
    size AS (SELECT s, count(*) AS c, sum(m) AS t FROM rows GROUP BY s),
    plan AS ({plan}),
    span AS (
      SELECT s, i, i * w + least(i, rem) AS a, (i + 1) * w + least(i + 1, rem) AS b
      FROM (SELECT z.s, CAST(z.t // p.n AS BIGINT) AS w, CAST(z.t % p.n AS BIGINT) AS rem, unnest(range(0, p.n)) AS i
            FROM size z JOIN plan p USING (s) WHERE z.c > p.n AND z.t > 0)),
    point AS (
      SELECT s, a + 1 + least(CAST(floor(({u32(seed, 'mus', 's', 'i')} - 1) / {UNIT}.0::DOUBLE * (b - a)) AS BIGINT), b - a - 1) AS p
      FROM span WHERE b > a),
    hits AS (
      SELECT DISTINCT r.s, r.k FROM point JOIN rows r ON r.s = point.s AND point.p > r.hi - r.m AND point.p <= r.hi),
    picked AS (
      SELECT k FROM rows r JOIN plan p USING (s) JOIN size z USING (s) WHERE z.c <= p.n
      UNION ALL SELECT k FROM hits {more})
    """


def lof(points: str, key: str, k: int, distance: str, digits: int, n: int, descending: bool, flag: bool = True) -> str:
    """Local outlier factor over all pairs; equal rows rank by their smallest key."""
    way = "DESC" if descending else "ASC"
    sample = f", CAST(row_number() OVER (ORDER BY anomaly_score {way}, {key}) <= {n} AS INTEGER) AS is_sample" if flag else ""
    return f"""
    WITH pts AS (SELECT *, min({key}) OVER (PARTITION BY v) AS rep FROM ({points})),
    near AS (
      SELECT a, b, d FROM (
        SELECT x.{key} AS a, y.{key} AS b, {distance} AS d,
               row_number() OVER (PARTITION BY x.{key} ORDER BY {distance}, y.rep, y.{key}) AS rn
        FROM pts x JOIN pts y ON x.{key} <> y.{key}) WHERE rn <= {k}),
    rad AS (SELECT a, max(d) AS r FROM near GROUP BY a),
    den AS (SELECT near.a, 1 / (avg(greatest(d, r)) + 1e-10) AS lrd FROM near JOIN rad ON near.b = rad.a GROUP BY near.a),
    lof AS (SELECT n.a AS {key}, avg(o.lrd) / any_value(p.lrd) AS anomaly_score
            FROM near n JOIN den o ON n.b = o.a JOIN den p ON n.a = p.a GROUP BY n.a)
    SELECT {key}, round(anomaly_score, {digits}) AS anomaly_score,
           CAST(anomaly_score > 1.5 AS INTEGER) AS is_anomaly{sample} FROM lof"""


def systematic(table: str, key: str, order: str, n: int, seed: int, fractional: bool = False) -> str:
    start = f"least(CAST(floor({u(seed, 'start', '0')} * (t // {n})) AS BIGINT), t // {n} - 1)"
    if fractional:
        chosen = f"p IN (SELECT (i * t) // {n} + {start} FROM (SELECT unnest(range(0, {n})) AS i), (SELECT count(*) AS t FROM {table}))"
    else:
        step = f"(t // {n})"
        chosen = f"p >= {start} AND (p - {start}) % {step} = 0 AND (p - {start}) // {step} < {n}"
    return f"""SELECT {key}, CAST({chosen} AS INTEGER) AS is_sample
    FROM (SELECT {key}, row_number() OVER (ORDER BY {order}, {key}) - 1 AS p, count(*) OVER () AS t FROM {table})"""


PLACED = """
    (SELECT o_orderkey, c AS cluster, sqrt(d) AS distance_to_centroid FROM (
      SELECT o_orderkey, c, d, row_number() OVER (PARTITION BY o_orderkey ORDER BY d, c) AS rn FROM (
        SELECT o_orderkey, c, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d
        FROM (SELECT o_orderkey, o_totalprice / 500000.0::DOUBLE AS x, day(o_orderdate) / 31.0::DOUBLE AS y FROM orders),
             (VALUES (0, 0.2::DOUBLE, 0.25::DOUBLE), (1, 0.5::DOUBLE, 0.75::DOUBLE), (2, 0.8::DOUBLE, 0.25::DOUBLE)) AS k(c, cx, cy)))
     WHERE rn = 1)"""

PART_POINTS = "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, {'x': p_size::DOUBLE, 'y': p_retailprice} AS v FROM part"
PART_DISTANCE = "sqrt((x.x - y.x) * (x.x - y.x) + (x.y - y.y) * (x.y - y.y))"


def knn(points: str, key: str, held: str, distance: str, k: int) -> str:
    """The k nearest rows of every distinct point, over all pairs."""
    return f"""
    WITH d AS (SELECT v{held}, min({key}) AS pid, count(*) AS w FROM ({points}) GROUP BY v),
    pairs AS (
      SELECT x.pid AS a, y.pid AS b, {distance} AS dist, y.w FROM d x JOIN d y ON x.pid <> y.pid
      UNION ALL SELECT pid, pid, 0.0, w - 1 FROM d WHERE w > 1)
    SELECT a, b, round(dist, 6) AS dist, CAST(least(w, {k} - prior) AS BIGINT) AS take
    FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY a ORDER BY dist, b
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM pairs)
    WHERE prior < {k}"""


NUMBERED_PARTS = """SELECT p_partkey, p_size / 10.0::DOUBLE AS x, p_retailprice / 100.0::DOUBLE AS y, p_type AS t,
    {'x': p_size, 'y': p_retailprice, 't': p_type} AS v FROM part"""
NUMBERED_DISTANCE = "sqrt((x.x - y.x) * (x.x - y.x) + (x.y - y.y) * (x.y - y.y) + CASE WHEN x.t = y.t THEN 0 ELSE 2 END)"
KNN_PARTS = knn(PART_POINTS, "p_partkey", ", any_value(x) AS x, any_value(y) AS y", PART_DISTANCE, 5)

VECTOR_DISTANCE = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i]))))"
VECTORS = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
KNN_VECTORS = knn(VECTORS, "vec_id", "", VECTOR_DISTANCE, 5)

SILHOUETTE = f"""
    WITH size AS (SELECT count(*) AS c FROM embeddings),
    e AS (SELECT vec_id, label, v FROM (SELECT *, row_number() OVER (ORDER BY {h(42, 'silhouette0', 'vec_id')}, vec_id) AS rn FROM ({VECTORS})), size
          WHERE rn <= CASE WHEN c < 1000 THEN c WHEN c < 100000 THEN least(greatest(c // 10, 1000), 5000) ELSE 5000 END),
    m AS (SELECT x.vec_id, x.label AS mine, y.label AS other, sum({VECTOR_DISTANCE}) AS s, count(*) AS c
          FROM e x JOIN e y ON true GROUP BY ALL),
    ab AS (SELECT vec_id, any_value(mine) AS mine,
                  max(CASE WHEN mine = other THEN s / greatest(c - 1, 1) END) AS a,
                  max(CASE WHEN mine = other THEN c END) AS size,
                  min(CASE WHEN mine <> other THEN s / c END) AS b FROM m GROUP BY vec_id)
    SELECT vec_id, round(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette
    FROM ab"""

SILHOUETTE_SQUARED = SILHOUETTE.replace("sum(sqrt(", "sum((", 1).replace("WHERE rn <= CASE", "WHERE true OR rn <= CASE").replace(", 6) AS silhouette", ", 12) AS silhouette")

CALINSKI = """
    WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
    c AS (SELECT label, i, avg(x) AS m, count(*) AS n, sum((x - mm) * (x - mm)) AS w
          FROM (SELECT *, avg(x) OVER (PARTITION BY label, i) AS mm FROM e) GROUP BY label, i),
    g AS (SELECT i, avg(x) AS gm FROM e GROUP BY i),
    t AS (SELECT sum(n * (m - gm) * (m - gm)) AS between_ss, sum(w) AS within_ss, count(DISTINCT label) AS k FROM c JOIN g USING (i))
    SELECT CAST(k AS BIGINT) AS clusters, (SELECT count(*) FROM embeddings) AS "rows",
           round((between_ss / (k - 1)) / (within_ss / ((SELECT count(*) FROM embeddings) - k)), 6) AS calinski_harabasz FROM t"""

# Two principal axes in closed form; the largest entry of an axis is positive.
PRINCIPAL = f"""
    (SELECT p_partkey, x - mx AS cx, y - my AS cy,
            CASE WHEN abs(cos(a)) >= abs(sin(a)) THEN sign(cos(a)) ELSE sign(sin(a)) END AS s1,
            CASE WHEN abs(sin(a)) > abs(cos(a)) THEN sign(-sin(a)) ELSE sign(cos(a)) END AS s2, cos(a) AS c, sin(a) AS s
     FROM ({PART_POINTS}), (SELECT avg(x) AS mx, avg(y) AS my,
            0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM ({PART_POINTS})))"""

TRIALS = "SELECT event_id AS trial, hour(ts)::DOUBLE AS hour, (user_id % 10)::DOUBLE AS \"user\", value FROM events"
LONG = f"""(SELECT trial, 'hour' AS param, hour AS setting, value FROM ({TRIALS})
    UNION ALL SELECT trial, 'user', "user", value FROM ({TRIALS}))"""

TEXT_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def is_picked(table: str, key: str, columns: str) -> str:
    return f"SELECT {columns}, CAST({key} IN (SELECT k FROM picked) AS INTEGER) AS is_sample FROM {table}"


def stats(columns: list[str], parts: list[tuple[str, str]], digits: int | None) -> str:
    out = []
    for c in columns:
        for name, f in parts:
            value = f.format(c=c)
            out.append(f"{f'round({value}, {digits})' if digits else value} AS {name}_{c}")
    return ", ".join(out)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STRATIFIED = f"""
    WITH al AS ({largest_remainder('orders', 'o_orderpriority', 137)}),
    f AS (SELECT o_orderkey, o_orderpriority, o_totalprice,
                 row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h(42, 'srs', 'o_orderkey')}, o_orderkey) AS rn
          FROM orders),
    flagged AS (SELECT f.*, CAST(rn <= allocated AS INTEGER) AS is_sample FROM f JOIN al USING (o_orderpriority))"""
KEPT = "(SELECT * FROM orders WHERE o_totalprice >= 100000)"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LOGGED = "CASE WHEN value > 0 THEN ln(1 + value) ELSE value END"
HOT_EVENTS = ", ".join(f"CAST(event_type = '{t}' AS INTEGER) AS \"event_type_{t}\"" for t in EVENT_TYPES)
EVENT_FEATURES = f"""
    SELECT event_id, round(({LOGGED} - lo) / (hi - lo), 6) AS value, round((user_id - mean) / sd, 6) AS user_id, {HOT_EVENTS}
    FROM events, (SELECT min({LOGGED}) AS lo, max({LOGGED}) AS hi, avg(user_id) AS mean, stddev_pop(user_id) AS sd FROM events)"""
RESOLVED = f"""
    SELECT round(sum(({LOGGED} - lo) / (hi - lo)), 6) AS sum_value, {", ".join(
        f"round(sum((event_type = '{t}')::INTEGER)::DOUBLE, 6) AS \"sum_event_type_{t}\"" for t in EVENT_TYPES)}
    FROM events, (SELECT min({LOGGED}) AS lo, max({LOGGED}) AS hi FROM events)"""

SKEW = "(avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / (avg(x * x) - avg(x) ** 2) ** 1.5"

ORACLES: dict[str, str] = {
    "scan_csv_orders": TEXT_ORDERS,
    "scan_json_orders": TEXT_ORDERS,
    "scan_parquet": "SELECT * FROM customer",
    "scan_dbf_suppliers": "SELECT * FROM supplier",
    "scan_xlsx_suppliers": "SELECT * FROM supplier",
    "load_table": "SELECT * FROM part",
    "scan_csv_documents": "SELECT * FROM documents",
    "scan_csv_conversations": "SELECT * FROM conversations",
    "write_results_csv_text": f"SELECT * FROM ({srs('documents', 'doc_id', '150', 11, columns='doc_id, text, source')}) WHERE is_sample = 1",
    "write_results_read_back": f"SELECT * FROM ({srs('orders', 'o_orderkey', '200', 11, columns='o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority')}) WHERE is_sample = 1",
    "table_shape": "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem",
    "column_catalog": "SELECT column_name AS name, column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN') AS is_numeric FROM (DESCRIBE lineitem)",
    "threshold_filter_orders": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000",
    "flag_init": "SELECT p_partkey, 0 AS is_sample FROM part",
    "drop_null_labels": "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "project_features": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
    + ", ".join(f"CAST(l_returnflag = '{v}' AS INTEGER) AS \"l_returnflag_{v}\"" for v in "ANR") + " FROM lineitem",
    "fraction_subsample_exact": f"SELECT event_id FROM ({srs('events', 'event_id', '(SELECT round_even(0.15 * count(*), 0) FROM events)', 5, 'fraction')}) WHERE is_sample = 1",
    "fraction_subsample_bernoulli": f"SELECT event_id FROM events WHERE {u(5, 'fraction', 'event_id')} <= 0.15",
    "with_row_key_lineitem": """SELECT hash || '-' || row_number() OVER (PARTITION BY hash) AS row_key, l_orderkey, l_linenumber, l_returnflag, l_linestatus
        FROM (SELECT *, sha256(list_aggregate(list_transform([l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag, l_linestatus], lambda v: coalesce(length(v) || ':' || v, 'null;')), 'string_agg', '')) AS hash FROM lineitem)""",
    "row_keys_unique_lineitem": "SELECT count(*) AS n_rows, count(*) AS n_keys FROM lineitem",
    "row_keys_unique_documents": "SELECT count(*) AS n_rows, count(*) AS n_keys FROM documents",
    "global_rank_events": "SELECT event_id, row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS position FROM events",
    "prefix_sum_orders": f"SELECT o_orderkey, row_number() OVER w - 1 AS position, CAST(sum({minor('o_totalprice')}) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)",
    "prefix_sum_by_stratum": f"SELECT o_orderkey, row_number() OVER w - 1 AS position, CAST(sum({minor('o_totalprice')}) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)",
    "sorted_prefix_sum": f"SELECT event_id, row_number() OVER w - 1 AS position, CAST(sum({minor('value')}) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM events WINDOW w AS (ORDER BY value, event_id)",
    "random_sample_orders": srs("orders", "o_orderkey", "500", 42),
    "random_sample_third": srs("events", "event_id", "(SELECT count(*) // 3 FROM events)", 42),
    "systematic_sample_events": systematic("events", "event_id", "ts", 300, 42),
    "systematic_sample_fractional": systematic("events", "event_id", "ts", 333, 42, True),
    "stratified_allocation_orders": largest_remainder("orders", "o_orderpriority", 137),
    "stratified_sample_orders": f"{STRATIFIED} SELECT o_orderkey, o_orderpriority, is_sample FROM flagged",
    "run_method_stratified": f"{STRATIFIED} SELECT o_orderkey, is_sample FROM flagged",
    "stratified_sample_documents": f"""
        WITH al AS ({largest_remainder('documents', 'lang, source', 100)}),
        f AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {h(7, 'srs', 'doc_id')}, doc_id) AS rn FROM documents)
        SELECT doc_id, CAST(rn <= allocated AS INTEGER) AS is_sample FROM f JOIN al USING (lang, source)""",
    "mus_allocation_orders": half_even_allocation(KEPT, "o_orderstatus", 301),
    "mus_sample_orders": mus("orders", "o_orderkey", "o_totalprice", "500", 42, "o_orderkey") + is_picked("orders", "o_orderkey", "o_orderkey"),
    "point_in_cumulative_range": mus("orders", "o_orderkey", "o_totalprice", "700", 42, "o_orderdate, o_orderkey", topup=False) + "SELECT k AS o_orderkey FROM picked",
    "mus_topup": mus("(SELECT * FROM customer WHERE c_acctbal >= 0)", "c_custkey", "c_acctbal", "SELECT count(*) // 2 FROM customer", 42, "c_custkey") + is_picked("customer", "c_custkey", "c_custkey"),
    "mus_stratified": mus(KEPT, "o_orderkey", "o_totalprice", "301", 42, "o_orderkey", "o_orderstatus",
                          f"SELECT o_orderstatus AS s, allocated AS n FROM ({half_even_allocation(KEPT, 'o_orderstatus', 301)}) WHERE allocated > 0")
    + is_picked("orders", "o_orderkey", "o_orderkey, o_orderstatus"),
    "mark_sample_orders": "SELECT o_orderkey, CAST(o_totalprice >= 400000 AS INTEGER) AS is_sample FROM orders",
    "semi_mark": "SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders) AS INTEGER) AS is_sample FROM customer",
    "method_summary_orders": f"""SELECT 'Monetary Unit Sampling' AS method, count(*) AS population_size, 200 AS sample_size,
        CAST(200 AS BIGINT) AS selected, CAST(sum({minor('o_totalprice')}) AS BIGINT) AS total_minor, 50000.0::DOUBLE AS threshold,
        count(*) FILTER (o_totalprice >= 50000) AS filtered_size, NULL::VARCHAR AS strata, 9 AS seed, '2024-01-01' AS created FROM orders""",
    "row_limits": "SELECT max_rows, (SELECT count(*) FROM events) <= max_rows AS accepted FROM (VALUES (100::BIGINT), (1000000000::BIGINT)) AS t(max_rows)",
    "population_totals_orders": f"SELECT count(*) AS population_size, CAST(sum({minor('o_totalprice')}) AS BIGINT) AS total_minor FROM orders",
    "stratum_counts_documents": "SELECT lang, source, count(*) AS stratum_size FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL",
    "stratum_shares_customers": "SELECT c_mktsegment, count(*) AS stratum_size, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM customer GROUP BY c_mktsegment",
    "skewness_events": f"SELECT round({SKEW}, 6) AS skew FROM (SELECT value AS x FROM events)",
    "min_max": f"SELECT {stats(NUMBERS, [('min', 'min({c})'), ('max', 'max({c})')], None)} FROM lineitem",
    "mean_std": f"SELECT {stats(NUMBERS, [('mean', 'avg({c})'), ('sd', 'stddev_pop({c})')], 6)} FROM lineitem",
    "distinct_levels": "SELECT DISTINCT 'p_brand' AS name, p_brand AS level FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part",
    "one_hot": "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM orders",
    "sparse_one_hot_customers": """SELECT o_orderkey, CAST((SELECT count(DISTINCT o_custkey) FROM orders) AS INTEGER) AS levels,
        CAST(dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS INTEGER) AS place FROM orders""",
    "skew_route": f"SELECT 'value' AS name, abs({SKEW}) > 0.75 AS log_route FROM (SELECT value AS x FROM events) UNION ALL SELECT 'user_id', abs({SKEW}) > 0.75 FROM (SELECT user_id::DOUBLE AS x FROM events)",
    "log1p_positive": "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(1 + c_acctbal) ELSE c_acctbal END, 6) AS logged FROM customer",
    "minmax_scale": "SELECT event_id, round((value - lo) / (hi - lo), 6) AS scaled FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)",
    "standard_scale": "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS scaled FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)",
    "nearest_centroid_orders": f"SELECT o_orderkey, cluster, round(distance_to_centroid, 6) AS distance_to_centroid FROM {PLACED}",
    "cluster_distance_std_orders": f"SELECT cluster, count(*) AS cluster_size, round(stddev_samp(distance_to_centroid), 6) AS distance_std FROM {PLACED} GROUP BY cluster",
    "kmeans_quota_fixed_centres": f"""
        WITH p AS (SELECT o_orderkey, cluster, round(distance_to_centroid / stddev_samp(distance_to_centroid) OVER (PARTITION BY cluster), 6) AS r FROM {PLACED}),
        q AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY r DESC, o_orderkey) <= 16 AS f FROM p),
        g AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY r DESC, o_orderkey) AS rn FROM q)
        SELECT o_orderkey, cluster, CAST(f OR rn <= 50 - (SELECT count(*) FROM q WHERE f) AS INTEGER) AS is_sample FROM g""",
    "top_n_per_group": "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 7",
    "top_n_by_score_lowest": "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) <= 100 AS INTEGER) AS is_sample FROM customer",
    "global_nlargest": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 25",
    "sorted_output": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey",
    "concat_strata": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')",
    "distinct_hits": "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "anomaly_and_cluster_count": f"SELECT CAST(count(*) FILTER (distance_to_centroid > 0.3) AS BIGINT) AS anomaly_count, CAST(max(cluster) + 1 AS INTEGER) AS cluster_count FROM {PLACED}",
    "share_left_join": """SELECT p.p_brand AS stratum, round(coalesce(s.c, 0) * 100.0::DOUBLE / (SELECT count(*) FROM part WHERE p_size = 1), 6) AS sample_percent
        FROM (SELECT DISTINCT p_brand FROM part) p LEFT JOIN (SELECT p_brand, count(*) AS c FROM part WHERE p_size = 1 GROUP BY p_brand) s USING (p_brand)""",
    "knn_join_parts": KNN_PARTS,
    "knn_join_blocks": KNN_PARTS,
    "knn_join_vector_blocks": KNN_VECTORS,
    "approximate_knn_vectors": KNN_VECTORS,
    "number_levels_orders": "SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS number FROM orders",
    "lof_numbered_parts": lof(NUMBERED_PARTS, "p_partkey", 20, NUMBERED_DISTANCE, 5, 20, True, False),
    "lof_vector_blocks": lof(VECTORS, "vec_id", 20, VECTOR_DISTANCE, 5, 20, False, False),
    "lof_sample_parts": lof(PART_POINTS, "p_partkey", 20, PART_DISTANCE, 6, 20, True),
    "lof_sample_vectors": lof(VECTORS, "vec_id", 20, VECTOR_DISTANCE, 5, 20, False, False),
    "calinski_harabasz_vectors": CALINSKI,
    "silhouette_vectors": SILHOUETTE,
    "silhouette_mean_vectors": "SELECT round(avg(m), 6) AS silhouette FROM (" + " UNION ALL ".join(
        f"SELECT avg(silhouette) AS m FROM ({SILHOUETTE.replace('silhouette0', f'silhouette{i}').replace(', 6) AS silhouette', ', 12) AS silhouette')})"
        + (" WHERE (SELECT count(*) FROM embeddings) >= 1000" if i else "") for i in range(3)) + ") WHERE m IS NOT NULL",
    "silhouette_squared_vectors": f"SELECT round(avg(silhouette), 6) AS silhouette FROM ({SILHOUETTE_SQUARED})",
    "sniff_csv_dialect": "SELECT kind, 'utf-8' AS encoding, sep, 5 AS n_cols, 4::BIGINT AS files FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|')) AS t(kind, sep)",
    "pca_reconstruction_parts": f"""SELECT p_partkey, round(e, 6) AS anomaly_score,
        CAST(row_number() OVER (ORDER BY e DESC, p_partkey) <= 50 AS INTEGER) AS is_sample
        FROM (SELECT p_partkey, (cy * c - cx * s) ** 2 / 2 AS e FROM {PRINCIPAL})""",
    "projection_2d_parts": f"SELECT p_partkey, round((cx * c + cy * s) * s1, 6) AS x, round((cy * c - cx * s) * s2, 6) AS y FROM {PRINCIPAL}",
    "silhouette_sizes_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS name, CASE WHEN c < 1000 THEN 1 ELSE 3 END AS parts, CAST(CASE WHEN c < 1000 THEN c WHEN c < 100000 THEN least(greatest(c // 10, 1000), 5000) ELSE 5000 END AS INTEGER) AS size FROM (SELECT count(*) AS c FROM {t})"
        for t in ("supplier", "customer", "part", "orders", "lineitem")
    ),
    "noise_sample_documents": f"""SELECT doc_id, toxic::INTEGER AS is_anomaly,
        CAST(toxic = 1 AND row_number() OVER (PARTITION BY toxic ORDER BY {h(42, 'noise', 'doc_id')}, doc_id) <= 20 AS INTEGER) AS is_sample FROM labels""",
    "strata_comparison_orders": f"""{STRATIFIED}
        SELECT o_orderpriority AS stratum,
               round(count(*) FILTER (o_totalprice >= 100000) * 100.0::DOUBLE / sum(count(*) FILTER (o_totalprice >= 100000)) OVER (), 6) AS population_percent,
               round(sum(is_sample) * 100.0::DOUBLE / sum(sum(is_sample)) OVER (), 6) AS sample_percent FROM flagged GROUP BY o_orderpriority""",
    "cumulative_curve_orders": f"""WITH f AS ({srs('orders', 'o_orderkey', '500', 42, columns='o_orderkey, o_orderstatus, o_totalprice')})
        SELECT o_orderstatus, o_orderkey, row_number() OVER w - 1 AS position,
               CAST(sum({minor('o_totalprice')}) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total, is_sample
        FROM f WHERE o_totalprice >= 100000 WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)""",
    "trial_history_events": "SELECT event_id AS trial, value FROM events WHERE value IS NOT NULL",
    "trials_long_events": f"SELECT trial, param, setting, value FROM {LONG}",
    "param_effect_events": f"""
        WITH l AS {LONG},
        s AS (SELECT param, min(setting) AS lo, max(setting) AS hi, avg(value) AS mean, var_pop(value) AS v, count(*) AS n FROM l GROUP BY param),
        b AS (SELECT param, least(floor((setting - lo) * 10 / (hi - lo)), 9) AS slot, avg(value) AS m, count(*) AS c,
                     any_value(mean) AS mean, any_value(v) AS v, any_value(n) AS n FROM l JOIN s USING (param) GROUP BY ALL)
        SELECT param, round(sum(c * (m - mean) ** 2) / any_value(n) / any_value(v), 6) AS effect FROM b GROUP BY param""",
    "sampling_report_orders": """
        SELECT 'method' AS section, item, value FROM (VALUES ('method', 'Random Sampling'), ('population_size', (SELECT count(*) FROM orders)::VARCHAR),
          ('sample_size', '100'), ('selected', '100'), ('filtered_size', (SELECT count(*) FROM orders)::VARCHAR), ('seed', '3'), ('created', '2024-01-01')) AS t(item, value)""",
    "prepare_features": EVENT_FEATURES,
    "resolve_features": RESOLVED,
}

for _same, _as in (("run_method_systematic", "systematic_sample_events"), ("run_method_mus", "mus_sample_orders")):
    ORACLES[_same] = ORACLES[_as]
