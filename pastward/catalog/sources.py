"""Scans, samples, fingerprints and sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastward.catalog.base import hourly_all, hourly_by_type, query, table, with_series
from pastward.operators.audits import missing_names
from pastward.operators.ordering import keep_last
from pastward.schema import HOURLY_CSV
from pastward.session import staged, work_folder
from pastward.sources.fingerprint import file_hashes, file_trees, list_files, provenance, row_hash, table_fingerprint
from pastward.sources.series import accepted_and_rejected, judged_lines, read_hourly_csv, tail_rows, with_timestamp
from pastward.sources.sinks import guard_results, packed_lines, read_csv, read_json, write_csv, write_json
from pastward.spec import HOURLY

CSV_COLUMNS = ("Date", "Time", "Consumption", "Temperature", "Rain", "Sun")


def _csv_lines(spark, folder):
    series = hourly_all(spark, folder)
    return series.select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("Date"),
        F.concat(F.hour("timestamp").cast("string"), F.lit(":00")).alias("Time"),
        *CSV_COLUMNS[2:],
    )


LINES_SQL = """SELECT strftime(timestamp, '%Y-%m-%d') AS Date, concat(hour(timestamp), ':00') AS Time,
                      Consumption, Temperature, Rain, Sun, timestamp FROM hourly_all"""


@query("s1_csv_scan", with_series("hourly_all") + LINES_SQL)
def s1(spark, folder):
    path = work_folder(spark)
    write_csv(_csv_lines(spark, folder), path)
    return with_timestamp(read_hourly_csv(spark, path)).drop("file_order")


@query(
    "s2_tail_sample",
    "SELECT event_id, ts, value FROM events ORDER BY event_id DESC LIMIT 6000",
)
def s2(spark, folder):
    return tail_rows(table(spark, folder, "events").select("event_id", "ts", "value"), 6000, "event_id")


@query("s4_text_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def s4(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# numbers with two decimals in a form that does not depend on how an engine prints doubles
MONEY = ("o_totalprice", "value")


def _part(name: str) -> str:
    text = f"{name}::DECIMAL(18, 2)::VARCHAR" if name in MONEY else f"{name}::VARCHAR"
    return f"coalesce(length({text}) || ':' || {text}, '-')"


def _whole(df):
    """All columns, amounts as decimals."""
    return df.select(*(F.col(c).cast("decimal(18,2)").alias(c) if c in MONEY else F.col(c) for c in df.columns))


def _hash_sql(*names: str) -> str:
    return f"sha256({' || '.join(map(_part, names))})"


def _fingerprint_sql(source: str, *names: str) -> str:
    def total(first: int) -> str:
        return f"sum(CAST(('0x' || substr(mark, {first}, 15))::BIGINT AS DECIMAL(38, 0)))"

    return f"SELECT count(*) AS rows, {total(1)} AS low, {total(16)} AS high FROM (SELECT {_hash_sql(*names)} AS mark FROM {source})"


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query("s4_row_hashes", f"SELECT o_orderkey, {_hash_sql(*ORDERS)} AS sha256 FROM orders")
def s4_rows(spark, folder):
    return _whole(table(spark, folder, "orders")).select("o_orderkey", row_hash(*map(F.col, ORDERS)).alias("sha256"))


@query("s4_file_hashes")
def s4_files(spark, folder):
    return file_hashes(spark, f"{folder}/*.parquet")


# half of the status values are taken away, so that missing values are part of the check
GAPS = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END"


@query(
    "s4_table_fingerprint",
    f"""WITH gaps AS (SELECT * REPLACE ({GAPS} AS o_orderstatus) FROM orders)
        SELECT rows, CAST(low AS VARCHAR) AS low, CAST(high AS VARCHAR) AS high FROM ({_fingerprint_sql("gaps", *ORDERS)})""",
)
def s4_table(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderstatus", F.expr(GAPS))
    found = table_fingerprint(_whole(orders))
    return found.select("rows", F.col("low").cast("string"), F.col("high").cast("string"))


@query("s3_file_listing")
def s3(spark, folder):
    return list_files(spark, folder).select("name", "bytes")


# customers stand for required inputs, those with orders for present ones
@query(
    "s3_required_inputs",
    "SELECT DISTINCT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def s3_required(spark, folder):
    required = table(spark, folder, "customer").select(F.col("c_custkey").alias("name"))
    present = table(spark, folder, "orders").select(F.col("o_custkey").alias("name"))
    return missing_names(required, present, "name")


def _identity(fingerprint, name):
    """Name and one hash of a table's fingerprint."""
    mark = F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("low").cast("string"), F.col("high").cast("string")), 256)
    return fingerprint.select(F.lit(name).alias("name"), mark.alias("sha256"))


@query(
    "s5_provenance",
    f"""WITH e AS ({_fingerprint_sql("events", *EVENTS)}), o AS ({_fingerprint_sql("orders", *ORDERS)})
        SELECT 'generated tables' AS source, true AS synthetic_data, 'events' AS canonical_file, 'orders' AS raw_file,
               sha256(e.rows || ':' || e.low || ':' || e.high) AS canonical_sha256,
               sha256(o.rows || ':' || o.low || ':' || o.high) AS raw_sha256 FROM e, o""",
)
def s5(spark, folder):
    events = table_fingerprint(_whole(table(spark, folder, "events")))
    orders = table_fingerprint(_whole(table(spark, folder, "orders")))
    hashes = _identity(events, "events").unionByName(_identity(orders, "orders"))
    return provenance(hashes, "generated tables", True, {"canonical": "events", "raw": "orders"})


@query(
    "s8_overwrite_guard",
    """SELECT attempt, allowed, rows FROM (SELECT count(*) AS rows FROM orders) AS t,
       (VALUES ('new', true), ('again', false), ('overwrite', true), ('smoke', false)) AS v(attempt, allowed)""",
)
def s8(spark, folder):
    path = work_folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    tried = []
    for attempt, overwrite, smoke in (("new", False, False), ("again", False, False), ("overwrite", True, False), ("smoke", True, True)):
        try:
            guard_results(spark, path, overwrite, smoke)
            write_csv(orders, path, overwrite)
            tried.append((attempt, True))
        except FileExistsError:
            tried.append((attempt, False))
    rows = read_csv(spark, path, "o_orderkey long, o_orderstatus string").agg(F.count("*").alias("rows"))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(a).alias("attempt"), F.lit(ok).alias("allowed")) for a, ok in tried))), "rows")


@query(
    "s9_report_tables",
    """SELECT event_type AS name, count(*) AS rows, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1""",
)
def s9(spark, folder):
    csv, json = work_folder(spark), work_folder(spark)
    stats = table(spark, folder, "events").groupBy(F.col("event_type").alias("name"))
    write_csv(stats.agg(F.count("*").alias("rows"), F.round(F.avg("value"), 6).alias("mean")), csv)
    write_json(stats.agg(F.max("value").alias("most")), json)
    return read_csv(spark, csv, "name string, rows long, mean double").join(read_json(spark, json, "name string, most double"), "name")


@query("s1_reordered_header", with_series("hourly_all") + LINES_SQL)
def s1_reordered(spark, folder):
    path = work_folder(spark)
    lines = _csv_lines(spark, folder).withColumn("Note", F.lit("n/a"))
    write_csv(lines.select("Sun", "Note", "Time", "Rain", "Consumption", "Date", "Temperature"), path)
    return with_timestamp(read_hourly_csv(spark, path)).drop("file_order")


@query("s6_csv_roundtrip", with_series("hourly_by_type") + "SELECT series_id, timestamp, Consumption, Rain FROM hourly_by_type")
def s6(spark, folder):
    path = work_folder(spark)
    write_csv(hourly_by_type(spark, folder).select("series_id", "timestamp", "Consumption", "Rain"), path)
    schema = "series_id string, timestamp timestamp_ntz, Consumption double, Rain double"
    return read_csv(spark, path, schema)


@query("s7_json_roundtrip", with_series("hourly_by_type") + "SELECT series_id, timestamp, Consumption, Rain FROM hourly_by_type")
def s7(spark, folder):
    path = work_folder(spark)
    write_json(hourly_by_type(spark, folder).select("series_id", "timestamp", "Consumption", "Rain"), path)
    return read_json(spark, path, "series_id string, timestamp timestamp_ntz, Consumption double, Rain double")


@query(
    "s1_scan_and_keep_last",
    with_series("hourly_all")
    + f"""SELECT * EXCLUDE (timestamp), timestamp FROM ({LINES_SQL})""",
)
def s1_last(spark, folder):
    path = work_folder(spark)
    lines = _csv_lines(spark, folder)
    # every hour is written twice, the valid line after the outdated one
    outdated = lines.withColumns({"Consumption": F.lit(-1.0), "_turn": F.lit(0)})
    both = outdated.unionByName(lines.withColumn("_turn", F.lit(1)))
    write_csv(both.repartitionByRange(4, "Date", "Time", "_turn").sortWithinPartitions("Date", "Time", "_turn").drop("_turn"), path)
    parsed = with_timestamp(read_hourly_csv(spark, path)).withColumn("series_id", F.lit("all"))
    return keep_last(parsed, HOURLY, "file_order").select(*HOURLY_CSV.names, "timestamp")


# the events as lines of a text file, in order
EVENT_LINE = "concat_ws('|', event_id, user_id, event_type, props)"
TREE_CHUNK, TREE_FAN_IN = 4096, 16


def _event_file(spark, folder):
    path = work_folder(spark)
    lines = table(spark, folder, "events").orderBy("event_id").select(F.monotonically_increasing_id().alias("at"), F.expr(EVENT_LINE).alias("value"))
    packs = staged(lines.mapInArrow(packed_lines, "at long, value string"))  # sorted in many tasks; the one that writes gets packs, not lines
    packs.repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


@query("s4_streamed_file_hash", f"SELECT sha256(string_agg({EVENT_LINE} || chr(10), '' ORDER BY event_id)) AS sha256 FROM events")
def s4_streamed(spark, folder):
    return file_hashes(spark, _event_file(spark, folder)).select("sha256")


@query(
    "s4_file_tree",
    f"""WITH RECURSIVE lines AS (SELECT event_id, {EVENT_LINE} || chr(10) AS line FROM events),
        placed AS (SELECT *, sum(strlen(line)) OVER (ORDER BY event_id) AS upto FROM lines),
        leaves AS (SELECT sha256(string_agg(line, '' ORDER BY event_id)) AS h, (upto - strlen(line)) // {TREE_CHUNK} AS chunk FROM placed GROUP BY chunk),
        level AS (
          SELECT row_number() OVER (ORDER BY chunk) - 1 AS part, h, count(*) OVER () AS n FROM leaves
          UNION ALL
          SELECT * FROM (SELECT part // {TREE_FAN_IN} AS part, sha256(string_agg(h, '' ORDER BY part)) AS h, count(*) OVER () AS n FROM level WHERE n > 1 GROUP BY part // {TREE_FAN_IN}))
        SELECT sha256((SELECT max(upto) FROM placed)::BIGINT || ':' || CASE WHEN (SELECT count(*) FROM leaves) = 1 THEN sha256(h) ELSE h END) AS sha256 FROM level WHERE n = 1""",
)
def s4_tree(spark, folder):
    return file_trees(spark, _event_file(spark, folder), TREE_CHUNK, TREE_FAN_IN).select("sha256")


# each seventh hour of a series is written as a line with one of five defects
DEFECTS = ("columns", "date", "time", "Consumption", "Sun")
DEFECT = f"CASE WHEN (day(timestamp) * 24 + hour(timestamp)) % 7 = 0 THEN CAST((day(timestamp) + hour(timestamp)) % {len(DEFECTS)} AS INT) END"


@query(
    "p1_rejected_lines",
    with_series("hourly_all")
    + f"""SELECT strftime(timestamp, '%Y-%m-%d') AS day, hour(timestamp) AS hour, CASE {DEFECT} {" ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(DEFECTS))} END AS reason,
                 CASE WHEN {DEFECT} IS NULL THEN timestamp END AS timestamp, CASE WHEN {DEFECT} IS NULL THEN Consumption END AS Consumption FROM hourly_all""",
)
def p1_rejected(spark, folder):
    defect = F.expr(DEFECT)
    lines = hourly_all(spark, folder).select(
        F.concat_ws(
            ",",
            F.when(defect == 1, F.concat(F.date_format("timestamp", "yyyy"), F.lit("-13-40"))).otherwise(F.date_format("timestamp", "yyyy-MM-dd")),
            F.when(defect == 2, "noon").otherwise(F.concat(F.hour("timestamp").cast("string"), F.lit(":00"))),
            F.when(defect == 3, "much").otherwise(F.col("Consumption").cast("string")),
            F.lit("1.5"),
            F.lit(""),
            F.when(defect == 4, "x").otherwise("2"),
            F.date_format("timestamp", "yyyy-MM-dd"),
            F.hour("timestamp").cast("string"),
        ).alias("value"),
        defect.alias("defect"),
    )
    path = work_folder(spark)
    short = F.when(F.col("defect") == 0, F.concat(F.col("value"), F.lit(",more"))).otherwise(F.col("value"))
    header = "Date,Time,Consumption,Temperature,Rain,Sun,day,hour"
    lines.select(short.alias("value")).repartition(3).write.option("lineSep", "\n").text(path + "/body")
    # every file has the header line
    spark.read.text(path + "/body", wholetext=True).select(F.concat(F.lit(header + "\n"), F.col("value")).alias("value")).write.option("lineSep", "\n").text(path + "/lines")
    good, bad = accepted_and_rejected(judged_lines(spark, path + "/lines"))
    cells = F.split("line", ",")
    return good.select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.hour("timestamp").cast("long").alias("hour"), F.lit(None).cast("string").alias("reason"), "timestamp", "Consumption"
    ).unionByName(
        bad.select(cells[6].alias("day"), cells[7].cast("long").alias("hour"), "reason", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("double").alias("Consumption"))
    )
