"""SQL for the registered queries, over the star-schema tables alone (no raw records, no JSON)."""

from __future__ import annotations


def sk(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: Canonical orders with their ingestion time; cp 0 is the first copy of a record.
ORD = f"""
ord AS (
  SELECT o_orderkey AS k, o_custkey AS c, ['uber_eats', 'doordash', 'own_app'][(o_orderkey % 3 + 1)::INT] AS platform,
    ['UE-', 'DD-', 'OA-'][(o_orderkey % 3 + 1)::INT] || o_orderkey AS order_id,
    CASE WHEN o_orderkey % 50 <> 0 THEN 'user' || o_custkey || '@example.com' END AS raw_email,
    round(o_totalprice * 100)::BIGINT AS cents, o_orderdate + to_minutes((o_orderkey % 1440)::BIGINT) AS ts,
    'K-' || (o_custkey % 101) AS kitchen_id, 'Brand#' || (o_orderkey % 26 + 1) AS brand_name,
    'NATION_' || (o_custkey % 25) || '-' || ['DOWNTOWN', 'MIDTOWN', 'UPTOWN', 'SUBURBS-N', 'SUBURBS-S'][(o_orderkey % 5 + 1)::INT] AS zone_id,
    CASE WHEN o_orderkey % 33 = 0 THEN 108000 ELSE 60 END AS delay
  FROM orders
), o AS (
  SELECT *, coalesce(sha256(raw_email), sha256(platform || 'C' || c)) AS customer_key, platform || '_' || order_id AS poid,
    ts + to_seconds(delay) AS ing, k % 33 = 0 AS late FROM ord
), copies AS (
  SELECT o.*, cp.cp FROM o, (VALUES (0), (1)) cp(cp) WHERE cp.cp = 0 OR k % 20 = 0
), items AS (SELECT l_orderkey AS k, count(*)::INT AS n FROM lineitem GROUP BY ALL)
"""
#: States of orders.
EV = """
ev AS (
  SELECT poid AS order_id, 'placed' AS status, ts AS done, kitchen_id, k, 0 AS n FROM o
  UNION ALL
  SELECT poid, CASE WHEN k % 20 = 7 AND s.n = 2 THEN 'cancelled' ELSE s.name END,
    ts + to_minutes(list_sum([2 + (k * j) % 14 for j in range(1, s.n + 1)])::BIGINT), kitchen_id, k, s.n
  FROM o, (VALUES (1, 'confirmed'), (2, 'preparing'), (3, 'ready'), (4, 'picked_up'), (5, 'delivered')) s(n, name)
  WHERE k % 20 <> 7 OR s.n <= 2
)
"""
FACT = f"""
fact AS (
  SELECT (year(ts) * 10000 + month(ts) * 100 + day(ts))::INT AS date_key, (hour(ts) * 100 + minute(ts))::INT AS time_key,
    CASE WHEN c % 101 IN (SELECT s_suppkey FROM supplier) THEN {sk("kitchen_id")} ELSE -1 END AS kitchen_key,
    CASE WHEN brand_name IN (SELECT p_brand FROM part) THEN {sk("replace(brand_name, 'Brand#', 'BR-')")} ELSE -1 END AS brand_key,
    customer_key AS customer_hk, {sk("zone_id")} AS zone_key, platform, poid AS platform_order_id, cents AS order_total_cents,
    coalesce(items.n, 0)::INT AS item_count, ts AS order_placed_ts, late AS is_late_arriving, k % 20 = 7 AS is_cancelled,
    CASE WHEN k % 20 <> 7 THEN ts + to_minutes(list_sum([2 + (k * j) % 14 for j in range(1, 6)])::BIGINT) END AS order_delivered_ts,
    CASE WHEN k % 20 <> 7 THEN list_sum([2 + (k * j) % 14 for j in range(1, 6)])::DOUBLE END AS delivery_duration_min,
    CASE WHEN k % 20 = 7 THEN ['customer', 'kitchen', 'courier'][(k % 3 + 1)::INT] END AS cancellation_reason, k, c
  FROM o LEFT JOIN items USING (k)
)
"""
KITCHEN = f"""
kitchen AS (
  SELECT {sk("'K-' || s_suppkey")} AS kitchen_key, 'K-' || s_suppkey AS kitchen_id, s_name AS name, n_name AS city, 'R' || n_regionkey AS state,
    (s_suppkey % 60 + 20)::INT AS capacity_orders_per_hour, s_acctbal >= 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
"""
BRAND = f"""
brand AS (
  SELECT {sk("replace(p_brand, 'Brand#', 'BR-')")} AS brand_key, replace(p_brand, 'Brand#', 'BR-') AS brand_id, p_brand AS brand_name, min(p_type) AS cuisine_type, true AS is_active
  FROM part GROUP BY p_brand
)
"""
ZONE = f"""
zone AS (
  SELECT {sk("n_name || '-' || kind")} AS zone_key, n_name || '-' || kind AS zone_id, n_name || ' ' || name AS zone_name, n_name AS city, radius AS avg_delivery_radius_km
  FROM nation, (VALUES ('DOWNTOWN', 'Downtown', 3.0::DOUBLE), ('MIDTOWN', 'Midtown', 2.8), ('UPTOWN', 'Uptown', 3.3), ('SUBURBS-N', 'Suburbs N', 5.0), ('SUBURBS-S', 'Suburbs S', 5.0)) z(kind, name, radius)
)
"""
CUST = """
bridge AS (
  SELECT customer_key AS customer_hk, platform, 'C' || c AS platform_customer_id, min(raw_email) AS raw_email,
    CASE WHEN min(raw_email) IS NOT NULL THEN 'exact_email' ELSE 'platform_id_fallback' END AS match_method, min(ts) AS first_seen, max(ts) AS last_seen
  FROM o GROUP BY customer_key, platform, c
), hub AS (
  SELECT customer_key AS customer_hk, raw_email AS customer_bk, TIMESTAMP '2002-01-01' AS load_ts, platform AS record_source
  FROM o QUALIFY row_number() OVER (PARTITION BY customer_key ORDER BY ts, poid) = 1
), cust AS (
  SELECT customer_hk, customer_hk AS customer_id, coalesce(md5(customer_bk), md5(customer_hk)) AS email_masked,
    (SELECT min(ts)::DATE FROM o WHERE o.customer_key = hub.customer_hk) AS first_order_date, p.n AS platform_count, p.l AS platforms_list,
    p.n > 1 AS is_multi_platform, record_source, load_ts AS effective_start, true AS is_current
  FROM hub JOIN (SELECT customer_hk, count(DISTINCT platform)::INT AS n, '["' || string_agg(DISTINCT platform, '","' ORDER BY platform) || '"]' AS l FROM bridge GROUP BY 1) p USING (customer_hk)
)
"""
SENS = """
rd AS (
  SELECT 'R-' || event_id AS reading_id, 'S-' || user_id AS sensor_id, 'K-' || (user_id % 101) AS kitchen_id,
    CASE event_type WHEN 'error' THEN 'humidity' WHEN 'purchase' THEN 'fryer_timer' WHEN 'click' THEN 'cooler_door' ELSE 'temperature' END AS sensor_type,
    value * 2 AS value, 'unit' AS unit, ['fryer', 'grill', 'cooler', 'ambient'][(regexp_extract(props, '[0-9]+')::INT % 4 + 1)::INT] AS zone,
    date_trunc('second', ts) AS event_timestamp, date_trunc('second', ts) + to_seconds(10) AS ingestion_timestamp
  FROM events WHERE event_id % 100 <> 0
), sensor AS (
  SELECT *, coalesce((sensor_type = 'temperature' AND value > 400) OR (sensor_type = 'humidity' AND value > 75) OR (sensor_type = 'fryer_timer' AND value > 600), false) AS is_anomaly FROM rd
), hourly AS (
  SELECT kitchen_id, sensor_id, sensor_type, zone, date_trunc('hour', event_timestamp) AS hour, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value,
    count(*) FILTER (is_anomaly) AS anomaly_count, count(*) AS reading_count FROM sensor GROUP BY ALL
)
"""
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
PING = f"""
png AS (
  SELECT 'D-' || user_id || '-' || day(ts) AS delivery_id, 'UE-' || (user_id * 3) AS order_id, 'DR-' || (user_id % 40) AS driver_id,
    29.0::DOUBLE + regexp_extract(props, '[0-9]+')::INT / 1000 AS lat, -95.0::DOUBLE + value / 10000 AS lon, value / 10 AS speed_mph,
    date_trunc('second', ts) AS event_timestamp, date_trunc('second', ts) + to_seconds((event_id % 90)::BIGINT) AS sync_timestamp, event_id
  FROM events
), ping AS (
  SELECT * FROM png QUALIFY row_number() OVER (PARTITION BY delivery_id, event_timestamp ORDER BY lat, lon, event_id) = 1
), ends AS (
  SELECT delivery_id, arg_min({{'lat': lat, 'lon': lon, 'o': order_id, 'd': driver_id, 't': event_timestamp}}, (event_timestamp, lat, lon)) AS a,
    arg_max({{'lat': lat, 'lon': lon, 't': event_timestamp}}, (event_timestamp, lat, lon)) AS b, avg(speed_mph) AS s, count(*) AS ping_count FROM ping GROUP BY 1
), trip AS (
  SELECT {sk("delivery_id")} AS trip_key, delivery_id, a.o AS order_id, a.d AS driver_id, (year(a.t) * 10000 + month(a.t) * 100 + day(a.t))::INT AS date_key,
    a.lat AS pickup_lat, a.lon AS pickup_lon, b.lat AS dropoff_lat, b.lon AS dropoff_lon, round({HAVERSINE.format(a="a", b="b")}, 3) AS distance_km,
    round((epoch(b.t) - epoch(a.t)) / 60, 2) AS duration_minutes, round(s * 1.60934, 2) AS avg_speed_kmh, ping_count FROM ends
)
"""
TRIP = PING + ", moved AS (SELECT * FROM trip WHERE distance_km > 0)"
MENU = f"""
upd AS (
  SELECT l_partkey AS p, l_shipdate AS ts, floor(round(l_extendedprice * 100) / l_quantity) / 100 AS price,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) = 1 AS last
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)
), chg AS (
  SELECT p_partkey AS p, 'c' AS op, TIMESTAMP '1995-01-01' AS ts, p_retailprice AS price, 0 AS seq FROM part
  UNION ALL SELECT p, CASE WHEN last AND p % 97 = 0 THEN 'd' ELSE 'u' END, ts, price, seq FROM upd
  UNION ALL SELECT p, 'c', ts + INTERVAL 1 DAY, price, seq + 1 FROM upd WHERE last AND p % 194 = 0
), ver AS (
  SELECT *, lead(ts) OVER (PARTITION BY p ORDER BY ts, seq) AS nxt FROM chg
), menu AS (
  SELECT {sk("'{\"brand\":\"' || p_brand || '\",\"item_id\":\"I' || p || '\"}'")} AS menu_item_hk, 'I' || p AS item_id, p_brand AS brand, p_name AS name,
    round(price * 100)::BIGINT AS price_cents, p_type AS category, ts AS effective_start, nxt AS effective_end, nxt IS NULL AS is_current
  FROM ver JOIN part ON p = p_partkey WHERE op <> 'd' AND (nxt IS NULL OR nxt > ts)
)
"""
CAL = """
cal AS (
  SELECT d::DATE AS full_date, (year(d) * 10000 + month(d) * 100 + day(d))::INT AS date_key, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day_of_month,
    (dayofweek(d) + 1)::INT AS day_of_week, dayname(d) AS day_name, monthname(d) AS month_name, quarter(d)::INT AS quarter, dayofweek(d) IN (0, 6) AS is_weekend, false AS is_holiday
  FROM unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) t(d)
)
"""


def q(select: str, *parts: str) -> str:
    return f"WITH {', '.join(p.strip() for p in parts)}\n{select.strip()}" if parts else select.strip()


CANON = "customer_key, cents AS order_total_cents, ts AS order_timestamp, kitchen_id, brand_name, platform, 'C' || c AS platform_customer_id, poid AS platform_order_id"
REV = """count(*) AS order_count, sum(order_total_cents)::BIGINT AS total_revenue_cents, round(sum(order_total_cents) / 100.0, 2) AS total_revenue_dollars,
  round(avg(order_total_cents)) / 100 AS avg_order_value_dollars, sum(item_count)::BIGINT AS total_items_sold"""
LIFE = """life AS (
  SELECT customer_hk, count(*) AS total_orders, sum(order_total_cents)::BIGINT AS lifetime_value_cents, round(sum(order_total_cents) / 100.0, 2) AS lifetime_value_dollars,
    round(avg(order_total_cents)) / 100 AS avg_order_value_dollars, count(DISTINCT kitchen_key) AS kitchens, count(DISTINCT brand_key) AS brands, max(order_placed_ts) AS last_order_ts
  FROM fact GROUP BY 1
)"""
PROFILE = "customer_hk, customer_id, email_masked, platform_count, platforms_list, is_multi_platform, first_order_date"
STATES = f"""
st AS (
  SELECT order_id, status, done AS status_timestamp, lag(status) OVER w AS previous_status, (epoch(done) - epoch(lag(done) OVER w))::BIGINT AS time_in_previous_status_seconds,
    (year(done) * 10000 + month(done) * 100 + day(done))::INT AS date_key,
    CASE WHEN substr(kitchen_id, 3)::BIGINT IN (SELECT s_suppkey FROM supplier) THEN {sk("kitchen_id")} ELSE -1 END AS kitchen_key,
    lead(done) OVER w AS effective_end, lead(done) OVER w IS NULL AS is_current
  FROM ev WINDOW w AS (PARTITION BY order_id ORDER BY done, status)
)
"""


def dq(suite: str, source: str, rules: list[tuple[str, str, str]]) -> str:
    """One line per rule: (kind, column, condition of a violation or a whole count)."""
    lines = []
    for kind, column, bad in rules:
        count = bad[1:] if bad.startswith("=") else f"(SELECT count(*) FROM {source} WHERE {bad})"
        total = f"(SELECT count(*) FROM {source})"
        lines.append(f"SELECT '{suite}' AS suite, '{kind}' AS rule, '{column}' AS \"column\", {count} = 0 AS success, {count}::BIGINT AS unexpected_count, {total}::BIGINT AS total")
    return " UNION ALL ".join(lines)


def repeats(source: str, key: str) -> str:
    return f"=(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {source} GROUP BY {key}) WHERE n > 1)"


ORACLES: dict[str, str] = {
    "bronze_envelope": q("SELECT 'orders' AS kafka_topic, k * 10 + cp AS kafka_offset, ts AS kafka_timestamp, ing + to_seconds(cp * 300) AS ingestion_timestamp, strftime(ing + to_seconds(cp * 300), '%Y-%m-%d') AS ingestion_date, strftime(ing + to_seconds(cp * 300), '%H') AS ingestion_hour FROM copies", ORD),
    "orders_aligned": q(f"SELECT {CANON}, coalesce(n, 0)::INT AS item_count, raw_email, zone_id, ing + to_seconds(cp * 300) AS ingestion_timestamp, late AS is_late_arriving, k * 10 + cp AS kafka_offset FROM copies LEFT JOIN items USING (k)", ORD),
    "orders_dedup": q(f"SELECT {CANON}, coalesce(n, 0)::INT AS item_count, raw_email, zone_id, ing AS ingestion_timestamp, late AS is_late_arriving FROM o LEFT JOIN items USING (k)", ORD),
    "bronze_profile": q("SELECT strftime(ing + to_seconds(cp * 300), '%Y-%m-%d') AS ingestion_date, count(*) AS n, min(k * 10 + cp) AS min_offset, max(k * 10 + cp) AS max_offset FROM copies GROUP BY 1", ORD),
    "platform_profile": q("SELECT platform, count(*) AS n, count(*) FILTER (raw_email IS NULL) AS null_emails, count(DISTINCT customer_key) AS customers FROM o GROUP BY 1", ORD),
    "identity_profile": q("SELECT record_source, count(*) AS n, count(*) FILTER (customer_bk IS NULL) AS null_emails, (SELECT count(*) FROM (SELECT raw_email FROM bridge WHERE raw_email IS NOT NULL GROUP BY 1 HAVING count(DISTINCT platform) > 1)) AS cross_platform_emails FROM hub GROUP BY 1", ORD, CUST),
    "hub_customer": q("SELECT * FROM hub", ORD, CUST),
    "hub_order": q("SELECT sha256(poid) AS order_hk, poid AS platform_order_id, TIMESTAMP '2002-01-01' AS load_ts, platform AS record_source FROM o", ORD),
    "hub_insert_only_second_batch": q("SELECT customer_key AS customer_hk, raw_email AS customer_bk, CASE WHEN ts < '1998-01-01' THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2003-01-01' END AS load_ts, platform AS record_source FROM o QUALIFY row_number() OVER (PARTITION BY customer_key ORDER BY ts, poid) = 1", ORD),
    "hub_kitchen": q("SELECT sha256(kitchen_id) AS kitchen_id_hk, kitchen_id, TIMESTAMP '2002-01-01' AS load_ts, platform AS record_source FROM o QUALIFY row_number() OVER (PARTITION BY kitchen_id ORDER BY ts, poid) = 1", ORD),
    "links_order": q("SELECT sha256(sha256(poid) || '||' || customer_key) AS link_hk, sha256(poid) AS order_hk, customer_key AS customer_hk, TIMESTAMP '2002-01-01' AS load_ts FROM o", ORD),
    "sat_order_scd2_two_batches": q("""SELECT sha256(poid) AS order_hk, cents AS order_total_cents, ing AS effective_start, CASE WHEN k % 10 = 0 THEN ing + INTERVAL 1 DAY END AS effective_end, k % 10 <> 0 AS is_current FROM o
      UNION ALL SELECT sha256(poid), cents + 100, ing + INTERVAL 1 DAY, NULL, true FROM o WHERE k % 10 = 0""", ORD),
    "sat_order_status": q("SELECT sha256(order_id) AS order_hk, status, previous_status, status_timestamp AS effective_start, effective_end, is_current FROM st", ORD, EV, STATES),
    "sat_customer_profile": q("SELECT customer_hk, '{' || string_agg('\"' || platform || '\":\"' || pid || '\"', ',' ORDER BY platform) || '}' AS platform_ids, max(seen) AS effective_start, NULL::TIMESTAMP AS effective_end, true AS is_current FROM (SELECT customer_hk, platform, min(platform_customer_id) AS pid, max(last_seen) AS seen FROM bridge GROUP BY 1, 2) GROUP BY 1", ORD, CUST),
    "identity_bridge": q("SELECT * FROM bridge", ORD, CUST),
    "identity_bridge_two_batches": q("SELECT * FROM bridge", ORD, CUST),
    "identity_confidence": q("SELECT customer_hk, platform, platform_customer_id, match_method, first_seen, last_seen, md5(raw_email) AS email_hash, CASE WHEN match_method = 'exact_email' THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence FROM bridge", ORD, CUST),
    "identity_fuzzy": q("SELECT x.s_nationkey, x.s_suppkey AS a, y.s_suppkey AS b, x.n AS na, y.n AS nb, levenshtein(x.n, y.n)::INT AS distance FROM s x JOIN s y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey AND levenshtein(x.n, y.n) <= 2", "s AS (SELECT s_suppkey, s_nationkey, 'kitchen ' || (('0x' || substr(md5(s_suppkey::VARCHAR), 1, 3))::BIGINT) AS n FROM supplier)"),
    "dim_date": q("SELECT cal.*, coalesce(n, 0) AS n_orders FROM cal LEFT JOIN (SELECT ts::DATE AS d, count(*) AS n FROM o GROUP BY 1) ON full_date = d", ORD, CAL),
    "dim_time": q("""SELECT t.*, coalesce(n, 0) AS n_orders FROM (
      SELECT f AS full_time, (hour(f) * 100 + minute(f))::INT AS time_key, hour(f)::INT AS hour, minute(f)::INT AS minute,
        CASE WHEN hour(f) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(f) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(f) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS time_of_day,
        hour(f) BETWEEN 11 AND 13 AS is_lunch_rush, hour(f) BETWEEN 17 AND 20 AS is_dinner_rush, hour(f) BETWEEN 16 AND 18 AS is_happy_hour
      FROM unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 23:59:00', INTERVAL 1 MINUTE)) x(f)) t
      LEFT JOIN (SELECT (hour(ts) * 100 + minute(ts))::INT AS time_key, count(*) AS n FROM o GROUP BY 1) USING (time_key)""", ORD),
    "dim_kitchen": q("SELECT * FROM kitchen", KITCHEN),
    "dim_brand": q("SELECT * FROM brand", BRAND),
    "dim_zone": q("SELECT * FROM zone", ZONE),
    "dim_customer": q("SELECT * FROM cust", ORD, CUST),
    "dim_menu_item": q("SELECT item_id, name AS item_name, price_cents / 100 AS price, category, brand, effective_start AS valid_from, effective_end AS valid_to, is_current FROM menu", MENU),
    "bridge_kitchen_brand": q("SELECT DISTINCT kitchen_key, brand_key, true AS is_active FROM fact WHERE kitchen_key <> -1 AND brand_key <> -1", ORD, FACT),
    "fact_order": q("SELECT * EXCLUDE (k, c) FROM fact", ORD, FACT),
    "fact_order_final_state": q("SELECT order_id, arg_max(status, n) AS final_status, min(done) FILTER (status = 'placed') AS placed_ts, max(done) FILTER (status = 'delivered') AS delivered_ts, bool_or(status = 'cancelled') AS is_cancelled, max(CASE WHEN status = 'cancelled' THEN ['customer', 'kitchen', 'courier'][(k % 3 + 1)::INT] END) AS cancellation_reason, (epoch(max(done) FILTER (status = 'delivered')) - epoch(min(done) FILTER (status = 'placed')))::BIGINT AS delivery_seconds FROM ev GROUP BY 1", ORD, EV),
    "order_state_history": q("SELECT * FROM st", ORD, EV, STATES),
    "menu_cdc_history": q("SELECT * FROM menu", MENU),
    "menu_current": q("SELECT brand, item_id, price_cents, effective_start FROM menu WHERE is_current", MENU),
    "menu_price_history": q("SELECT item_id, name AS item_name, brand, category, price_cents / 100 AS price_dollars, price_cents, effective_start, effective_end, is_current, CASE WHEN is_current THEN 'current' ELSE 'historical' END AS version_status FROM menu", MENU),
    "pit_menu_join": q("SELECT l_partkey, l_shipdate, n, 'I' || l_partkey AS item_id, price_cents, effective_start, effective_end FROM (SELECT l_partkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2) f LEFT JOIN menu m ON m.item_id = 'I' || l_partkey AND l_shipdate >= effective_start AND (effective_end IS NULL OR l_shipdate < effective_end)", MENU),
    "sensor_clean": q("SELECT * FROM sensor", SENS),
    "sensor_hourly": q("SELECT * FROM hourly", SENS),
    "sensor_zone_rules": q("SELECT sensor_type, zone, count(*) AS n, count(*) FILTER ((sensor_type = 'temperature' AND value > CASE zone WHEN 'fryer' THEN 400 WHEN 'grill' THEN 500 WHEN 'cooler' THEN 45 ELSE 85 END) OR (sensor_type = 'humidity' AND value > 75)) AS anomalies FROM rd GROUP BY ALL", SENS),
    "sensor_jumps": q("SELECT reading_id, sensor_id, value, pv AS previous_value, round(abs(value - pv), 4) AS drift FROM (SELECT *, lag(value) OVER (PARTITION BY sensor_id ORDER BY event_timestamp, reading_id) AS pv FROM sensor) WHERE abs(value - pv) >= 200", SENS),
    "sensor_gaps": q("SELECT reading_id, sensor_id, pt AS previous_timestamp, (epoch(event_timestamp) - epoch(pt))::BIGINT AS gap_seconds FROM (SELECT *, lag(event_timestamp) OVER (PARTITION BY sensor_id ORDER BY event_timestamp, reading_id) AS pt FROM sensor) WHERE epoch(event_timestamp) - epoch(pt) > 20000", SENS),
    "arrival_lag": q("SELECT delivery_id, count(*) AS n, min(lag_s) AS min_lag, max(lag_s) AS max_lag, quantile_cont(lag_s::DOUBLE, 0.5) AS median_lag, count(*) FILTER (event_timestamp < seen) AS out_of_order FROM (SELECT *, (epoch(sync_timestamp) - epoch(event_timestamp))::BIGINT AS lag_s, max(event_timestamp) OVER (PARTITION BY delivery_id ORDER BY sync_timestamp, event_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ping) GROUP BY 1", PING),
    "gps_pings": q("SELECT delivery_id, order_id, driver_id, lat, lon, speed_mph, event_timestamp FROM ping", PING),
    "delivery_trips": q("SELECT m.*, coalesce(f.kitchen_key, -1) AS kitchen_key, coalesce(f.zone_key, -1) AS zone_key FROM moved m LEFT JOIN fact f ON f.platform_order_id = 'uber_eats_' || m.order_id", ORD, FACT, TRIP),
    "trip_path_distance": q(f"SELECT delivery_id, count(*) AS ping_count, round(coalesce(sum(seg), 0.0), 3) AS path_km, count(*) FILTER (epoch(sync_timestamp) - epoch(event_timestamp) > 60) AS late_pings FROM (SELECT b.*, CASE WHEN b.p IS NOT NULL THEN {HAVERSINE.format(a='b.p', b='b')} END AS seg FROM (SELECT *, lag({{'lat': lat, 'lon': lon}}) OVER (PARTITION BY delivery_id ORDER BY event_timestamp, lat, lon) AS p FROM ping) b) GROUP BY 1", PING),
    "rev_kitchen_day": q(f"SELECT full_date AS order_date, year, month, day_of_month, is_weekend, kitchen_id, name AS kitchen_name, city, state, {REV}, count(*) FILTER (is_cancelled) AS cancelled_orders, coalesce(sum(order_total_cents) FILTER (NOT is_cancelled), 0)::BIGINT AS net_revenue_cents FROM fact JOIN cal USING (date_key) JOIN kitchen USING (kitchen_key) GROUP BY ALL", ORD, FACT, CAL, KITCHEN),
    "rev_brand_day": q(f"SELECT full_date AS order_date, year, month, brand_id, brand_name, cuisine_type, platform, {REV}, count(DISTINCT customer_hk) AS unique_customers FROM fact JOIN cal USING (date_key) JOIN brand USING (brand_key) GROUP BY ALL", ORD, FACT, CAL, BRAND),
    "delivery_by_zone": q("SELECT zone_id, zone_name, city, count(*) AS trip_count, round(avg(round(duration_minutes * 100)::BIGINT)) / 100 AS avg_duration_minutes, round(min(duration_minutes), 2) AS min_duration_minutes, round(max(duration_minutes), 2) AS max_duration_minutes, round(avg(round(distance_km * 1000)::BIGINT)) / 1000 AS avg_distance_km, round(avg(round(avg_speed_kmh * 100)::BIGINT)) / 100 AS avg_speed_kmh FROM moved m JOIN fact f ON f.platform_order_id = 'uber_eats_' || m.order_id JOIN zone USING (zone_key) WHERE duration_minutes >= 0 GROUP BY 1, 2, 3", ORD, FACT, TRIP, ZONE),
    "multi_platform_customers": q(f"SELECT {PROFILE}, coalesce(total_orders, 0) AS total_orders, lifetime_value_cents, lifetime_value_dollars FROM cust LEFT JOIN life USING (customer_hk) WHERE is_multi_platform", ORD, FACT, CUST, LIFE),
    "top_customers": q(f"SELECT {PROFILE}, life.* EXCLUDE (customer_hk) FROM cust JOIN life USING (customer_hk) ORDER BY total_orders DESC, lifetime_value_cents DESC, customer_hk LIMIT 10", ORD, FACT, CUST, LIFE),
    "sensor_anomalies": q("SELECT h.kitchen_id, name AS kitchen_name, city, sensor_id, sensor_type, zone, hour::DATE AS sensor_date, hour(hour)::INT AS sensor_hour, reading_count, anomaly_count, round(100.0 * anomaly_count / reading_count, 2) AS anomaly_rate_pct, avg_value, min_value, max_value FROM hourly h JOIN kitchen k ON h.kitchen_id = k.kitchen_id WHERE anomaly_count > 0", SENS, KITCHEN),
    "dq_fact_order": q(dq("fact_order", "fact", [*[("not_null", c, f"{c} IS NULL") for c in ("customer_hk", "kitchen_key", "brand_key", "date_key", "time_key")], ("between", "order_total_cents", "order_total_cents NOT BETWEEN 100 AND 100000"), ("between", "item_count", "item_count NOT BETWEEN 1 AND 20"), ("in_set", "platform", "platform NOT IN ('uber_eats', 'doordash', 'own_app')"), ("match", "date_key", "NOT regexp_matches(date_key::VARCHAR, '^[0-9]{8}$')"), ("unique", "platform_order_id", repeats("fact", "platform_order_id"))]), ORD, FACT),
    "dq_dim_customer": q(dq("dim_customer", "cust", [("not_null", "customer_hk", "customer_hk IS NULL"), ("not_null", "email_masked", "email_masked IS NULL"), ("not_match", "email_masked", "email_masked LIKE '%@%'"), ("between", "platform_count", "platform_count NOT BETWEEN 1 AND 3"), ("in_set", "is_current", "is_current IS NULL"), ("unique", "customer_hk", repeats("cust", "customer_hk"))]), ORD, CUST),
    "dq_dim_menu_item": q(dq("dim_menu_item", "menu", [("not_null", "item_id", "item_id IS NULL"), ("between", "price", "price_cents NOT BETWEEN 99 AND 5000"), ("in_set", "is_current", "is_current IS NULL"), ("not_null", "valid_from", "effective_start IS NULL"), ("unique", "menu_item_key", repeats("menu", "brand, item_id, effective_start"))]) + " UNION ALL SELECT 'dim_menu_item', 'one_current', 'brand,item_id', count(*) FILTER (n > 1) = 0, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, sum(n)::BIGINT FROM (SELECT count(*) AS n FROM menu WHERE is_current GROUP BY brand, item_id)", MENU),
    "dq_states": q("SELECT 'states' AS suite, 'has_state' AS rule, 'order_id' AS \"column\", count(*) FILTER (NOT p) = 0 AS success, count(*) FILTER (NOT p) AS unexpected_count, count(*) AS total FROM (SELECT order_id, bool_or(status = 'placed') AS p FROM ev GROUP BY 1) UNION ALL SELECT 'states', 'columns', '', m = 0, m, 2 FROM (SELECT 2 - count(*) AS m FROM (DESCRIBE SELECT order_id, status FROM ev) WHERE column_name IN ('order_id', 'status')) UNION ALL SELECT 'orders', 'columns', '', m = 0, m, 3 FROM (SELECT 3 - count(*) AS m FROM (DESCRIBE orders) WHERE column_name IN ('o_orderkey', 'o_orderdate', 'o_zone'))", ORD, EV),
    "fk_orphans": q("SELECT k AS fk, n AS orphans, t AS total, round(n * 100.0 / t, 2) AS orphan_pct, CASE WHEN round(n * 100.0 / t, 2) > 5 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT 'kitchen_key' AS k, count(*) FILTER (kitchen_key = -1) AS n, count(*) AS t FROM fact UNION ALL SELECT 'brand_key', count(*) FILTER (brand_key = -1), count(*) FROM fact)", ORD, FACT),
    "grain_check": q("SELECT count(*) AS n, count(DISTINCT platform_order_id) AS n_keys, count(*) - count(DISTINCT platform_order_id) AS duplicates, 'pass' AS status FROM fact", ORD, FACT),
    "pii_scan": q(" UNION ALL ".join([f"SELECT 'dim_customer' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} LIKE '%@%') AS leaks FROM cust" for c in ("customer_hk", "customer_id", "email_masked", "platforms_list", "record_source")] + [f"SELECT 'identity_bridge', '{c}', count(*) FILTER ({c} LIKE '%@%') FROM bridge" for c in ("customer_hk", "platform", "platform_customer_id", "raw_email", "match_method")]), ORD, CUST),
    "freshness": q("SELECT max(ing + to_seconds(cp * 300)) AS latest, (epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(max(ing + to_seconds(cp * 300))))::BIGINT AS age_seconds, CASE WHEN epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(max(ing + to_seconds(cp * 300))) > 86400 THEN 'fail' WHEN epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(max(ing + to_seconds(cp * 300))) > 7200 THEN 'warn' ELSE 'pass' END AS status FROM copies", ORD),
    "row_counts": q("SELECT 'orders' AS table_name, count(*) AS n, 1000::BIGINT AS expected, CASE WHEN count(*) >= 1000 THEN 'pass' ELSE 'fail' END AS status FROM orders UNION ALL SELECT 'customer', count(*), 1000, CASE WHEN count(*) >= 1000 THEN 'pass' ELSE 'fail' END FROM customer"),
    "health_verdict": q("SELECT f::BIGINT AS failures, 0::BIGINT AS warnings, CASE WHEN f > 0 THEN 'failed' ELSE 'healthy' END AS verdict FROM (SELECT ((SELECT count(*) FROM orders) < 1000)::INT + ((SELECT count(*) FROM customer) < 1000)::INT + (SELECT count(*) <> count(DISTINCT o_orderkey) FROM orders)::INT AS f)"),
    "row_count_drop": q("SELECT day, n, round(t, 4) AS trailing_avg, coalesce(n < 0.5 * round(t, 4), false) AS is_drop FROM (SELECT *, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS t FROM (SELECT ts::DATE AS day, count(*) AS n FROM o GROUP BY 1))", ORD),
    "feedback_0_100": q("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 100 / 50, 2) AS rating FROM lineitem"),
    "upsert_scd1": q("SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.b IS NOT NULL THEN s.v ELSE t.c_acctbal END AS c_acctbal, CASE WHEN s.b IS NOT NULL THEN 2 ELSE 1 END::INT AS batch FROM customer t FULL JOIN (SELECT c_custkey * 2 AS c_custkey, c_acctbal AS v, 2 AS b FROM customer WHERE c_custkey % 3 = 0) s ON t.c_custkey = s.c_custkey"),
    "stream_bronze": q("SELECT strftime(o_orderdate, '%Y-%m-%d') AS ingestion_date, count(*) AS n, max(o_orderkey) AS max_offset FROM orders GROUP BY 1"),
    "stream_dedup_watermark": q("SELECT DISTINCT event_id - event_id % 2 AS pair FROM events"),
    "stream_hourly": q("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS reading_count, min(value) AS min_value, max(value) AS max_value FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) GROUP BY 1, 2"),
    "stream_upsert": q("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1"),
    "backfill_range": q("SELECT platform, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT DISTINCT k, platform, cents FROM copies WHERE strftime(ing + to_seconds(cp * 300), '%Y') = '1996') GROUP BY 1", ORD),
    "sensor_offline_alarms": q("""SELECT sensor_id, ts AS last_seen, ts + INTERVAL 20000 SECOND AS alarm_at
        FROM (SELECT sensor_id, ts, lead(ts) OVER (PARTITION BY sensor_id ORDER BY ts) AS nx FROM (SELECT DISTINCT sensor_id, event_timestamp AS ts FROM sensor)), (SELECT max(event_timestamp) - INTERVAL 1 HOUR AS w FROM sensor)
        WHERE (nx IS NULL OR nx > ts + INTERVAL 20000 SECOND) AND ts + INTERVAL 20000 SECOND < w""", SENS),
    "stream_order_pickups": q("""SELECT poid AS platform_order_id, ts AS placed_ts, p.done AS picked_up_ts
        FROM o LEFT JOIN (SELECT order_id, done FROM ev WHERE status = 'picked_up') p ON p.order_id = poid AND p.done BETWEEN ts AND ts + INTERVAL 40 MINUTE,
          (SELECT least((SELECT max(ts) FROM o), (SELECT max(done) FROM ev WHERE status = 'picked_up')) - INTERVAL 1 HOUR AS w)
        WHERE p.done IS NOT NULL OR ts + INTERVAL 40 MINUTE < w""", ORD, EV),
    "sat_order_bitemporal": q("""SELECT bn AS batch, order_hk, cents AS order_total_cents, ts AS effective_start, lead(ts) OVER l AS effective_end, lead(ts) OVER l IS NULL AS is_current FROM (
          SELECT b.n AS bn, order_hk, cents, ts, lag(cents) OVER (PARTITION BY b.n, order_hk ORDER BY ts) AS before FROM (
            SELECT 1 AS n, sha256(poid) AS order_hk, cents, ing AS ts FROM o
            UNION ALL SELECT 2, sha256(poid), cents + 100, ing - INTERVAL 1 DAY FROM o WHERE k % 10 = 0 UNION ALL SELECT 2, sha256(poid), cents + 50, ing + INTERVAL 1 DAY FROM o WHERE k % 10 = 1
            UNION ALL SELECT 3, sha256(poid), cents, ing + INTERVAL 2 DAY FROM o WHERE k % 20 < 2) x JOIN (VALUES (1), (2), (3)) b(n) ON x.n <= b.n) b
        WHERE before IS NULL OR before <> cents WINDOW l AS (PARTITION BY bn, order_hk ORDER BY ts)""", ORD),
    "orders_quarantine": q("""SELECT k * 10 + cp AS kafka_offset, CASE WHEN k % 101 = 0 THEN 'not_json' WHEN k % 103 = 0 THEN 'unknown_platform' WHEN k % 107 = 0 THEN 'no_order_id' WHEN k % 109 = 0 THEN 'bad_timestamp' ELSE 'bad_total' END AS fault
        FROM copies WHERE k % 101 = 0 OR k % 103 = 0 OR k % 107 = 0 OR k % 109 = 0 OR k % 113 = 0""", ORD),
    "nightly_reconciliation": q("""SELECT strftime(seen, '%Y-%m') AS ingestion_month, platform, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT *, ing + to_seconds(cp * 300) AS seen FROM copies)
        WHERE epoch(seen) - epoch(ts) <= 86400 OR strftime(seen, '%Y-%m') IN ('1999-05', '1999-06') GROUP BY ALL""", ORD),
    "identity_people": q("""SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 'by hand ' || c_custkey WHEN mail IS NOT NULL THEN sha256(mail) WHEN best IS NOT NULL THEN sha256(best.m) ELSE sha256('id ' || least) END AS identity_key,
          CASE WHEN c_custkey % 50 = 7 THEN 'manual_override' WHEN mail IS NOT NULL THEN 'exact_email' WHEN best IS NOT NULL OR d IS NOT NULL THEN 'fuzzy_name_address' ELSE 'platform_id_fallback' END AS match_method,
          CASE WHEN c_custkey % 50 = 7 OR mail IS NOT NULL THEN 1.0 WHEN best IS NOT NULL OR d IS NOT NULL THEN round(0.9 - 0.1 * d, 1) ELSE 0.6 END::DOUBLE AS match_confidence
        FROM p LEFT JOIN grp ON grp.a = p.c_custkey LEFT JOIN nearest USING (g) LEFT JOIN own ON own.a = p.c_custkey""", """RECURSIVE p AS (
          SELECT c_custkey, c_mktsegment AS b, 'house ' || substr(md5(c_custkey::VARCHAR), 1, 3) AS n, CASE WHEN c_custkey % 3 <> 0 THEN 'mail' || floor(c_custkey / 2)::BIGINT || '@x.org' END AS mail FROM customer
        ), pair AS (SELECT x.c_custkey AS a, y.c_custkey AS o, y.mail, levenshtein(x.n, y.n) AS d FROM p x JOIN p y ON x.b = y.b AND x.mail IS NULL AND x.c_custkey <> y.c_custkey AND levenshtein(x.n, y.n) <= 1),
        reach AS (SELECT c_custkey AS a, c_custkey AS o FROM p WHERE mail IS NULL UNION SELECT reach.a, pair.o FROM reach JOIN pair ON pair.a = reach.o WHERE pair.mail IS NULL),
        grp AS (SELECT a, min(o) AS g, min(o) AS least FROM reach GROUP BY a),
        nearest AS (SELECT g, min({'d': pair.d, 'm': pair.mail}) AS best FROM grp JOIN pair USING (a) WHERE pair.mail IS NOT NULL GROUP BY g),
        own AS (SELECT a, min(d) AS d FROM pair GROUP BY a)"""),
    "unique_customers_rollup": q("""SELECT p.period, date_trunc(p.period, ts)::DATE AS start, platform, count(DISTINCT customer_key) AS customers FROM o, (VALUES ('day'), ('week'), ('month')) p(period) GROUP BY ALL""", ORD),
    "reconcile_48h": q("SELECT DISTINCT poid AS platform_order_id, cents AS order_total_cents, ts AS order_timestamp FROM copies WHERE ing + to_seconds(cp * 300) BETWEEN TIMESTAMP '1999-05-30 12:00:00' AND TIMESTAMP '1999-06-01 12:00:00'", ORD),
    "jdbc_roundtrip": q("SELECT ts::DATE AS day, count(*) AS n_orders FROM o GROUP BY 1", ORD),
    "menu_cdc_two_batches": q("SELECT * FROM menu", MENU),
    "sat_order_late_changes": q("SELECT sha256(poid) AS order_hk, cents + 100 AS order_total_cents, ing - INTERVAL 1 DAY AS ingestion_timestamp FROM o WHERE k % 20 = 0", ORD),
    "fact_order_default_zone": q(f"SELECT poid AS platform_order_id, CASE WHEN k % 7 <> 0 THEN {sk('zone_id')} WHEN city IS NULL THEN -1 ELSE {sk("city || '-DOWNTOWN'")} END AS zone_key FROM o LEFT JOIN kitchen USING (kitchen_id)", ORD, KITCHEN),
    "fact_sensor_hourly": q("SELECT hourly.*, coalesce(kitchen_key, -1) AS kitchen_key, (year(hour) * 10000 + month(hour) * 100 + day(hour))::INT AS date_key FROM hourly LEFT JOIN kitchen USING (kitchen_id)", SENS, KITCHEN),
    "seed_last_wins": q(f"SELECT {sk("'K-' || s_suppkey")} AS kitchen_key, 'K-' || s_suppkey AS kitchen_id, CASE WHEN length('K-' || s_suppkey) % 2 = 0 THEN upper(s_name) ELSE s_name END AS name, CASE WHEN length('K-' || s_suppkey) % 2 = 0 THEN 2 ELSE 1 END::INT AS load FROM supplier"),
    "seed_csv": q("SELECT * FROM kitchen", KITCHEN),
    "schema_merge": q("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer"),
    "hub_menu_item": q("SELECT sha256(item_id) AS item_id_hk, item_id, TIMESTAMP '2002-01-01' AS load_ts, 'menu' AS record_source FROM (SELECT DISTINCT item_id FROM menu)", MENU),
    "link_order_kitchen_brand": q("SELECT sha256(sha256(poid) || '||' || sha256(kitchen_id) || '||' || sha256(brand_name)) AS link_hk, sha256(poid) AS order_hk, sha256(kitchen_id) AS kitchen_hk, sha256(brand_name) AS brand_hk, TIMESTAMP '2002-01-01' AS load_ts FROM o", ORD),
    "identity_fuzzy_address": q("SELECT x.b AS segment, x.c_custkey AS a, y.c_custkey AS b, x.n AS na, y.n AS nb, levenshtein(x.n, y.n)::INT AS distance FROM s x JOIN s y ON x.b = y.b AND x.c_custkey < y.c_custkey AND levenshtein(x.n, y.n) <= 1", "s AS (SELECT c_custkey, c_mktsegment AS b, 'house ' || substr(md5(c_custkey::VARCHAR), 1, 4) AS n FROM customer)"),
    "bronze_totals": q("SELECT count(*) AS n, min(k * 10 + cp) AS min_offset, max(k * 10 + cp) AS max_offset, count(DISTINCT strftime(ing + to_seconds(cp * 300), '%Y-%m-%d %H')) AS n_partitions FROM copies", ORD),
    "dq_more": q("""SELECT 'sensors' AS suite, 'rate_between' AS rule, 'is_anomaly' AS "column", coalesce(count(*) FILTER (is_anomaly) / nullif(count(*), 0) BETWEEN 0.0 AND 0.25, false) AS success, count(*) FILTER (is_anomaly) AS unexpected_count, count(*) AS total FROM sensor
      UNION ALL SELECT 'sensors', 'drift_below', 'value', count(*) FILTER (d >= 200) = 0, count(*) FILTER (d >= 200), count(*) FROM (SELECT abs(value - lag(value) OVER (PARTITION BY sensor_id ORDER BY event_timestamp, reading_id)) AS d FROM sensor)
      UNION ALL SELECT 'dim_zone', 'row_count', '', count(*) = 125, abs(count(*) - 125), count(*) FROM zone UNION ALL SELECT 'dim_time', 'row_count', '', count(*) = 1440, abs(count(*) - 1440), count(*) FROM unnest(generate_series(0, 1439))""", SENS, ZONE),
    "replace_partitions": q("SELECT year(ts)::INT AS year, platform, (CASE WHEN year(ts) = 1997 THEN -1 ELSE 1 END * sum(cents))::BIGINT AS cents FROM o GROUP BY year(ts), platform", ORD),
    "stream_sliding": q("SELECT h AS hour, event_type, count(*) AS reading_count, min(value) AS min_value, max(value) AS max_value FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS h FROM events) WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) GROUP BY 1, 2"),
    "jdbc_gold_tables": q(" UNION ALL ".join(f"SELECT '{name}' AS table_name, ({n}) AS n" for name, n in {
        "dim_date": "SELECT count(*) FROM cal", "dim_time": "SELECT count(*) FROM unnest(generate_series(0, 1439))", "dim_kitchen": "SELECT count(*) FROM kitchen", "dim_brand": "SELECT count(*) FROM brand", "dim_delivery_zone": "SELECT count(*) FROM zone",
        "dim_menu_item": "SELECT count(*) FROM menu", "dim_customer": "SELECT count(*) FROM cust", "bridge_kitchen_brand": "SELECT count(DISTINCT (kitchen_key, brand_key)) FROM fact WHERE kitchen_key <> -1 AND brand_key <> -1", "fact_order": "SELECT count(*) FROM fact",
        "fact_order_state_history": "SELECT count(*) FROM st", "fact_sensor_hourly": "SELECT count(*) FROM hourly", "fact_delivery_trip": "SELECT count(*) FROM moved"}.items()), ORD, CAL, KITCHEN, BRAND, ZONE, MENU, CUST, FACT, EV, STATES, SENS, TRIP),
    "bronze_samples": q("SELECT strftime(seen, '%Y-%m-%d') AS ingestion_date, strftime(seen, '%H') AS ingestion_hour, count(*) AS n, min(off) AS kafka_offset, arg_min(platform, off) AS platform, arg_min(order_id, off) AS order_id FROM (SELECT *, k * 10 + cp AS off, ing + to_seconds(cp * 300) AS seen FROM copies) GROUP BY 1, 2", ORD),
}
LEAST = {"dim_date": 1095, "dim_time": 1440, "dim_kitchen": 50, "dim_brand": 8, "dim_delivery_zone": 50}
ORACLES["row_counts_gold"] = f"SELECT table_name, n, expected, CASE WHEN n >= expected THEN 'pass' ELSE 'fail' END AS status FROM (SELECT *, {' '.join(['CASE', *[f"WHEN table_name = '{t}' THEN {n}" for t, n in LEAST.items()], 'ELSE 1 END'])}::BIGINT AS expected FROM (" + ORACLES["jdbc_gold_tables"] + "))"
ORACLES["dq_observed_write"] = "SELECT * FROM (" + ORACLES["dq_fact_order"] + ") WHERE rule <> 'unique'"
ORACLES["rev_kitchen_day_incremental"] = ORACLES["rev_kitchen_day"]
ORACLES["rev_brand_day_incremental"] = ORACLES["rev_brand_day"]
ORACLES["dq_pass_rate"] = "SELECT suite, count(*) AS n_rules, count(*) FILTER (success) AS n_passed, round(100.0 * count(*) FILTER (success) / count(*), 2) AS pass_pct FROM ((" + ORACLES["dq_fact_order"] + ") UNION ALL (" + ORACLES["dq_dim_customer"] + ")) GROUP BY suite"
