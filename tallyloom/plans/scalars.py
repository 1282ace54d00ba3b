"""Scalar functions and small row operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import convert, display, geometry, text
from tallyloom.operators import enrich
from tallyloom.operators.ordering import number_rows, page
from tallyloom.operators.paging import read_page
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK
from tallyloom.session import work_path
from tallyloom.sources.versions import write_version

WITH_TRIPS = "WITH " + b.FLIGHTS_SQL + ", " + b.PASSENGERS_SQL
WITH_TRAFFIC = "WITH " + b.TRAFFIC_SQL


@BOOK.add("fn_route_label", WITH_TRIPS + """
SELECT f.flight_id, p.passport_id, origin || ' → ' || destination AS route
FROM flights f JOIN passengers p ON f.flight_id = p.flight_id""")
def fn_route_label(spark, folder):
    joined = b.flights(spark, folder).join(b.passengers(spark, folder), "flight_id")
    return joined.select("flight_id", "passport_id",
                         display.route_label(F.col("origin"), F.col("destination")).alias("route"))


# What is put at the end of a whole document: some tails are harmless, some hold risky fragments.
RISKY = [" ", " and so on. \n", " it's done", "; DROP TABLE t", " -- 'note'", "/* hidden */ UNION  SELECT 1", " delete from t; ", "O'Hare execute (x) ;  ",
         " a --x\ry\x85z\u2028", "union\xa0select", "exec\u2003(x);\x85\xa0"]


def _strip_sql(expr: str) -> str:
    return f"trim({expr}, '{text.WHITE}')"


def _sanitize_sql(expr: str) -> str:
    out = _strip_sql(f"coalesce({expr}, '')")
    for fragment in text.RISKY_FRAGMENTS:
        out = f"regexp_replace({out}, '{fragment}', '', 'gi')"
    out = f"replace({out}, '''', '''''')"
    return _strip_sql(f"regexp_replace({out}, ';[{text.WHITE}]*$', '', 'g')")


def _list_sql(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@BOOK.add("fn_sanitize_text", f"""
SELECT doc_id, {_sanitize_sql(f'"text" || ({_list_sql(RISKY)})[doc_id % {len(RISKY)} + 1]')} AS cleaned FROM documents""")
def fn_sanitize_text(spark, folder):
    tails = F.array(*[F.lit(v) for v in RISKY])
    risky = F.concat("text", F.element_at(tails, (F.col("doc_id") % len(RISKY) + 1).cast("int")))
    return b.table(spark, folder, "documents").select("doc_id", text.sanitize(risky).alias("cleaned"))


@BOOK.add("fn_valid_identifier", """
SELECT p_partkey, p_name, regexp_matches(trim(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE ' ' END)),
       '^[a-zA-Z_][a-zA-Z0-9_.]*$') AS valid FROM part""")
def fn_valid_identifier(spark, folder):
    name = F.replace(F.col("p_name"), F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.lit("_")).otherwise(F.lit(" ")))
    return b.table(spark, folder, "part").select("p_partkey", "p_name", text.is_identifier(name).alias("valid"))


@BOOK.add("fn_split_list", """
SELECT p_partkey, item_no - 1 AS item_no, item FROM (
  SELECT p_partkey, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS item_no FROM (
    SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ' || p_brand || ',, ' || p_type, ','),
                                                 lambda x: trim(x)), lambda x: x <> '') AS items FROM part))""")
def fn_split_list(spark, folder):
    joined = F.concat("p_name", F.lit(", "), "p_brand", F.lit(",, "), "p_type")
    items = b.table(spark, folder, "part").select("p_partkey", F.posexplode(text.split_list(joined)).alias("item_no", "item"))
    return items.withColumn("item_no", F.col("item_no").cast("long"))


@BOOK.add("fn_is_number", """
SELECT event_id, piece, regexp_matches(replace(replace(piece, '.', ''), '-', ''), '^[0-9]+$') AS is_number FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '2024-01-01' WHEN 2 THEN '-1.5'
         ELSE event_type END AS piece FROM events)""")
def fn_is_number(spark, folder):
    piece = (F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("string"))
             .when(F.col("event_id") % 4 == 1, F.lit("2024-01-01")).when(F.col("event_id") % 4 == 2, F.lit("-1.5"))
             .otherwise(F.col("event_type")))
    rows = b.table(spark, folder, "events").select("event_id", piece.alias("piece"))
    return rows.withColumn("is_number", text.is_number(F.col("piece")))


@BOOK.add("fn_upper", "SELECT s_suppkey, upper(s_name) AS code FROM supplier")
def fn_upper(spark, folder):
    return b.table(spark, folder, "supplier").select("s_suppkey", F.upper("s_name").alias("code"))


@BOOK.add("fn_datetime", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS form_time, date_trunc('minute', ts) AS moment FROM events""")
def fn_datetime(spark, folder):
    shown = b.table(spark, folder, "events").select("event_id", convert.to_form_time(F.col("ts")).alias("form_time"))
    return shown.withColumn("moment", convert.from_form_time(F.col("form_time")))


@BOOK.add("fn_blank_to_null", """
SELECT event_id, nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, '') AS kind FROM events""")
def fn_blank_to_null(spark, folder):
    kind = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type"))
    return b.table(spark, folder, "events").select("event_id", text.blank_to_null(kind).alias("kind"))


_RAW_SQL = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN NULL
         WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN '-7.9' ELSE '9007199254740993' END ELSE '2024-02-03 04:05:06' END AS raw FROM events"""


@BOOK.add("fn_safe_cast", f"""
SELECT event_id, coalesce(raw, 'unknown') AS as_string,
       coalesce(CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN TRY_CAST(raw AS BIGINT) END, CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT), 0) AS as_long,
       coalesce(TRY_CAST(raw AS DOUBLE), 0.0) AS as_double, TRY_CAST(raw AS TIMESTAMP) AS as_time FROM ({_RAW_SQL})""")
def fn_safe_cast(spark, folder):
    raw = (F.when(F.col("event_id") % 5 == 0, F.col("value").cast("string")).when(F.col("event_id") % 5 == 1, F.col("event_type"))
           .when(F.col("event_id") % 5 == 2, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 3, F.when(F.col("event_id") % 2 == 0, F.lit("-7.9")).otherwise(F.lit("9007199254740993")))
           .otherwise(F.lit("2024-02-03 04:05:06")))
    rows = b.table(spark, folder, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", convert.safe_string(F.col("raw")).alias("as_string"),
                       convert.safe_long(F.col("raw")).alias("as_long"), convert.safe_double(F.col("raw")).alias("as_double"),
                       convert.safe_timestamp(F.col("raw")).alias("as_time"))


@BOOK.add("fn_missing_zero", """
SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 'n/a'
       ELSE CAST(event_id % 90 AS VARCHAR) END AS INTEGER), 0) AS delay_minutes FROM events""")
def fn_missing_zero(spark, folder):
    raw = (F.when(F.col("event_type") == "error", F.lit("n/a"))
           .when(F.col("event_type") != "view", (F.col("event_id") % 90).cast("string")))
    return b.table(spark, folder, "events").select("event_id", convert.or_zero(raw).alias("delay_minutes"))


@BOOK.add("fn_delay_badge", """
WITH d AS (SELECT o_orderkey, o_orderkey % 60 AS m FROM orders)
SELECT o_orderkey, CASE WHEN m = 0 THEN 'On Time' ELSE m || ' min' END AS badge,
       CASE WHEN m = 0 THEN 'success' WHEN m < 30 THEN 'warning' ELSE 'danger' END AS level FROM d""")
def fn_delay_badge(spark, folder):
    badge, level = display.delay_badge(F.col("o_orderkey") % 60)
    return b.table(spark, folder, "orders").select("o_orderkey", badge.alias("badge"), level.alias("level"))


_CENTS = "CAST(round(CAST(o_totalprice AS DECIMAL(20,2)) * 100, 0) AS BIGINT)"
_PRICE = "CAST(o_totalprice AS DECIMAL(20,2))"


@BOOK.add("fn_money", f"""
SELECT o_orderkey, '$' || (({_CENTS} + 5000) // 10000 // 10) || '.' || (({_CENTS} + 5000) // 10000 % 10) || 'K' AS thousands,
       '$' || (({_CENTS} + 50) // 100) AS whole, '$' || CAST({_PRICE} AS VARCHAR) AS cents,
       format('{{:,}}', {_CENTS} // 100) ||
         CASE WHEN {_CENTS} % 100 = 0 THEN '' ELSE rtrim('.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0'), '0') END AS grouped
FROM orders""")
def fn_money(spark, folder):
    amount = F.col("o_totalprice")
    return b.table(spark, folder, "orders").select(
        "o_orderkey", display.thousands_of_dollars(amount).alias("thousands"), display.dollars(amount, 0).alias("whole"),
        display.dollars(amount).alias("cents"), display.grouped_number(amount).alias("grouped"))


@BOOK.add("fn_labels", """
SELECT s_suppkey, s_suppkey || ' - ' || s_name || ' (' || n_name || ')' AS airport, s_suppkey || ' - ' || s_name AS airline,
       s_name || ' - ' || n_name || ' to ' || r_name AS flight
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def fn_labels(spark, folder):
    rows = (b.table(spark, folder, "supplier")
            .join(b.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(b.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    key = F.col("s_suppkey").cast("string")
    return rows.select("s_suppkey", display.place_label(key, F.col("s_name"), F.col("n_name")).alias("airport"),
                       display.place_label(key, F.col("s_name")).alias("airline"),
                       display.flight_label(F.col("s_name"), F.col("n_name"), F.col("r_name")).alias("flight"))


@BOOK.add("fn_base64", 'SELECT doc_id, base64(encode("text")) AS encoded, "text" AS decoded FROM documents')
def fn_base64(spark, folder):
    rows = b.table(spark, folder, "documents").select(
        "doc_id", convert.encode(F.encode("text", "UTF-8")).alias("encoded"))
    return rows.withColumn("decoded", F.decode(convert.decode(F.col("encoded")), "UTF-8"))


@BOOK.add("fn_clean_text", """SELECT doc_id, trim(replace(' ' || chr(0) || "text" || '  ', chr(0), ''), ' ') AS cleaned FROM documents""")
def fn_clean_text(spark, folder):
    dirty = F.concat(F.lit(" \u0000"), F.col("text"), F.lit("  "))
    return b.table(spark, folder, "documents").select("doc_id", text.clean(dirty).alias("cleaned"))


@BOOK.add("fn_truncate", """
SELECT doc_id, CASE WHEN length("text") > 100 THEN substr("text", 1, 100) || '...' ELSE "text" END AS short,
       substr("text", 1, 8) || '...' AS prefix FROM documents""")
def fn_truncate(spark, folder):
    return b.table(spark, folder, "documents").select(
        "doc_id", text.truncate(F.col("text")).alias("short"), text.id_prefix(F.col("text")).alias("prefix"))


@BOOK.add("fn_file_parts", r"""
SELECT page_id, regexp_extract(path, '([^/.]*)[^/]*$', 1) AS base_name, regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1) AS extension
FROM (SELECT page_id, url || '/clip' || page_id || '.part.mp4' AS path FROM pages)""")
def fn_file_parts(spark, folder):
    path = F.concat("url", F.lit("/clip"), F.col("page_id").cast("string"), F.lit(".part.mp4"))
    return b.table(spark, folder, "pages").select(
        "page_id", text.base_name(path).alias("base_name"), text.extension(path).alias("extension"))


_A, _B, _C, _D, _E, _F, _G, _H = (repr(v) + "::DOUBLE" for v in geometry.perspective_coefficients())


@BOOK.add("fn_perspective", WITH_TRAFFIC + f"""
SELECT event_id, CAST(trunc(({_A} * position_x + {_B} * position_y + {_C}) / ({_G} * position_x + {_H} * position_y + 1.0::DOUBLE)) AS BIGINT) AS plane_x,
       CAST(trunc(({_D} * position_x + {_E} * position_y + {_F}) / ({_G} * position_x + {_H} * position_y + 1.0::DOUBLE)) AS BIGINT) AS plane_y
FROM traffic""")
def fn_perspective(spark, folder):
    x, y = geometry.perspective(F.col("position_x"), F.col("position_y"))
    return b.traffic(spark, folder).select("event_id", x.alias("plane_x"), y.alias("plane_y"))


@BOOK.add("fn_direction", WITH_TRAFFIC + " SELECT event_id, position_x, direction FROM traffic")
def fn_direction(spark, folder):
    return b.traffic(spark, folder).select("event_id", "position_x", "direction")


@BOOK.add("fn_class_name", """
SELECT event_id, CASE event_id % 9 WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck'
       ELSE 'car' END AS name FROM events""")
def fn_class_name(spark, folder):
    return b.table(spark, folder, "events").select(
        "event_id", display.class_name((F.col("event_id") % 9).cast("int")).alias("name"))


@BOOK.add("fn_vehicle_label", WITH_TRAFFIC + """
SELECT event_id, CASE WHEN estimated_speed_kmh > 0 THEN '#' || car_id || ' ' || estimated_speed_kmh || ' km/h ' || direction
       ELSE '#' || car_id || ' ' || direction END AS label FROM traffic""")
def fn_vehicle_label(spark, folder):
    label = display.vehicle_label(F.col("car_id"), F.col("estimated_speed_kmh"), F.col("direction"))
    return b.traffic(spark, folder).select("event_id", label.alias("label"))


@BOOK.add("fn_render_record", """
SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment
       AS record FROM customer""")
def fn_render_record(spark, folder):
    return b.customers(spark, folder).select(
        "c_custkey", display.record_lines(["c_custkey", "c_name", "c_mktsegment"]).alias("record"))


@BOOK.add("fn_payload", """
SELECT doc_id, '{"dataframe_split":{"index":[0],"columns":["encoded_image"],"data":[["' || base64(encode("text")) ||
       '"]]},"params":{"mode":"RADAR"}}' AS payload FROM documents""")
def fn_payload(spark, folder):
    rows = b.table(spark, folder, "documents").select(
        "doc_id", convert.encode(F.encode("text", "UTF-8")).alias("encoded_image"))
    return rows.select("doc_id", display.model_payload(["encoded_image"], {"mode": "RADAR"}).alias("payload"))


@BOOK.add("fn_contains_ci", f"""
SELECT conv_id, turn, lower("text") LIKE '%{b.WON_MARK}%' OR lower("text") LIKE '%{b.LOST_MARK}%' AS marked FROM conversations""")
def fn_contains_ci(spark, folder):
    return b.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.contains_any(F.col("text"), [b.WON_MARK, b.LOST_MARK]).alias("marked"))


@BOOK.add("fn_half_even", "SELECT event_id, round_even(event_id / 4.0::DOUBLE, 1) AS one, round_even(event_id / 8.0::DOUBLE, 2) AS two FROM events")
def fn_half_even(spark, folder):
    return b.table(spark, folder, "events").select(
        "event_id", convert.half_even(F.col("event_id") / F.lit(4.0), 1).alias("one"),
        convert.half_even(F.col("event_id") / F.lit(8.0), 2).alias("two"))


@BOOK.add("fn_date_shift", """
SELECT event_id, ts - to_days(CAST(event_id % 60 AS INTEGER)) AS booked, ts + to_hours(event_id % 12 + 2) AS arrival FROM events""")
def fn_date_shift(spark, folder):
    return b.table(spark, folder, "events").select(
        "event_id", convert.shift(F.col("ts"), days=-(F.col("event_id") % 60)).alias("booked"),
        convert.shift(F.col("ts"), hours=F.col("event_id") % 12 + 2).alias("arrival"))


@BOOK.add("fn_frame_seconds", WITH_TRAFFIC + " SELECT event_id, frame_id / 25.0::DOUBLE AS seconds FROM traffic")
def fn_frame_seconds(spark, folder):
    return b.traffic(spark, folder).select("event_id", convert.frame_seconds(F.col("frame_id"), 25).alias("seconds"))


@BOOK.add("fn_frame_label", WITH_TRAFFIC + """
SELECT event_id, video_id, 'Frame ' || (row_number() OVER (PARTITION BY video_id ORDER BY event_id) - 1) AS label FROM traffic""")
def fn_frame_label(spark, folder):
    rows = number_rows(b.traffic(spark, folder).select("event_id", "video_id"), ["video_id"], ["event_id"])
    return rows.select("event_id", "video_id",
                       F.concat(F.lit("Frame "), (F.col("position") - 1).cast("string")).alias("label"))


# Row operators

@BOOK.add("frame_slice", WITH_TRAFFIC + """
SELECT event_id, video_id, position FROM (
  SELECT event_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS position FROM traffic)
WHERE position BETWEEN 11 AND 15""")
def frame_slice(spark, folder):
    """Five sightings of each video from index 10."""
    position = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id"))
    rows = b.traffic(spark, folder).select("event_id", "video_id").withColumn("position", position.cast("long"))
    return rows.filter("position <= 15").filter("position >= 11")


@BOOK.add("grid_search", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)) LIKE '%build%'""")
def grid_search(spark, folder):
    rows = b.customers(spark, folder).select("c_custkey", "c_name", "c_mktsegment")
    return rows.filter(text.search_row([F.col(c) for c in rows.columns], "Build"))


@BOOK.add("grid_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 500")
def grid_page(spark, folder):
    return page(b.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 500, 25)


@BOOK.add("grid_page_deep", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET (SELECT 9 * count(*) // 10 FROM orders)")
def grid_page_deep(spark, folder):
    """A page after nine tenths of a versioned table, by its index."""
    root = work_path(spark, "grid")
    orders = b.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_version(orders, root)
    return read_page(spark, root, ["o_orderkey"], 9 * orders.count() // 10, 25)


@BOOK.add("lookup_keys", """
SELECT k.c_custkey AS wanted, o.o_orderkey IS NOT NULL AS found, o.o_totalprice
FROM customer k LEFT JOIN orders o ON o.o_orderkey = k.c_custkey * 20""")
def lookup_keys(spark, folder):
    """Orders looked up by a table of keys, some of which are missing."""
    wanted = b.customers(spark, folder).select(F.col("c_custkey").alias("wanted"))
    orders = b.table(spark, folder, "orders")
    return wanted.join(orders, F.col("o_orderkey") == F.col("wanted") * 20, "left").select(
        "wanted", F.col("o_orderkey").isNotNull().alias("found"), "o_totalprice")


@BOOK.add("at_risk_customers", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0")
def at_risk_customers(spark, folder):
    return b.customers(spark, folder).filter(F.col("c_acctbal") < 0).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@BOOK.add("latest_artifact", """
WITH files AS (
  SELECT doc_id % 50 AS folder_no, 'videos/' || CASE WHEN doc_id % 7 = 0 THEN 'processed_video' ELSE 'uploaded_video' END || doc_id ||
         CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.mp4' END AS path, n_chars AS modified_at FROM documents)
SELECT folder_no, path, kind FROM (
  SELECT folder_no, path, CASE WHEN path LIKE 'videos/processed%' THEN 'processed' ELSE 'fallback' END AS kind,
         row_number() OVER (PARTITION BY folder_no ORDER BY path LIKE 'videos/processed%' DESC, modified_at DESC, path DESC) AS n
  FROM files WHERE path LIKE '%.mp4') WHERE n = 1""")
def latest_artifact(spark, folder):
    key = F.col("doc_id")
    kind = F.when(key % 7 == 0, F.lit("processed_video")).otherwise(F.lit("uploaded_video"))
    ending = F.when(key % 3 == 0, F.lit(".txt")).otherwise(F.lit(".mp4"))
    files = b.table(spark, folder, "documents").select(
        (key % 50).alias("folder_no"), F.concat(F.lit("videos/"), kind, key.cast("string"), ending).alias("path"),
        F.col("n_chars").alias("modified_at"))
    return enrich.latest_artifact(files, ["folder_no"])
