"""The given tables read as inspection tables, in Spark and as the same SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollscan.operators.scan import row_numbers

ROLL_WIDTH_M = 1.5
EVENT_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Line items as events of rolls. Numbering them sorts each roll; readers that do not need event_id name the columns they need."""
    li = table(spark, sf_dir, "lineitem")
    e = {
        "sku": F.col("l_partkey") % 8,
        "roll_id": F.col("l_partkey"),
        "event_id": F.row_number().over(Window.partitionBy("l_partkey").orderBy(*EVENT_ORDER)).cast("long"),
        "frame_index": F.floor(F.col("l_extendedprice") / 100),
        "along_start_mm": F.col("l_extendedprice"),
        "length_mm": F.col("l_quantity") * 10,
        "across_start_mm": ((F.col("l_suppkey") % 15) * 100).cast("double"),
        "width_mm": (20 + F.col("l_linenumber") * 10).cast("double"),
        "max_score": 10 + 100 * F.col("l_discount"),
        "assertion": F.when(F.col("l_linestatus") == "F", "asserted").otherwise("uncertain"),
        "status": F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "N", "confirmed").otherwise("proposed"),
        "order_id": F.col("l_orderkey"),
    }
    return li.select(*[c.alias(n) for n, c in e.items() if not columns or n in columns])


EVENTS = f"""v_events AS (
  SELECT l_partkey % 8 AS sku, l_partkey AS roll_id,
    row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(EVENT_ORDER)}) AS event_id,
    floor(l_extendedprice / 100)::BIGINT AS frame_index, l_extendedprice AS along_start_mm, l_quantity * 10 AS length_mm,
    ((l_suppkey % 15) * 100)::DOUBLE AS across_start_mm, (20 + l_linenumber * 10)::DOUBLE AS width_mm, 10 + 100 * l_discount AS max_score,
    CASE WHEN l_linestatus = 'F' THEN 'asserted' ELSE 'uncertain' END AS assertion,
    CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'N' THEN 'confirmed' ELSE 'proposed' END AS status, l_orderkey AS order_id
  FROM lineitem)"""


def detections(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Events read as detections of one frame each. As in events(), readers without detection_id name their columns."""
    names = {"event_id": "detection_id", "along_start_mm": "along_mm", "across_start_mm": "across_mm"}
    e = ("sku", "roll_id", "frame_index", "event_id", "along_start_mm", "across_start_mm", "length_mm", "width_mm", "max_score", "assertion")
    e = tuple(c for c in e if not columns or names.get(c, c) in columns)
    return events(spark, sf_dir, e).select(*[F.col(c).alias(names.get(c, c)) for c in e])


def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, roll_id, length_m, width_m."""
    from rollscan.operators.astm import roll_lengths

    return roll_lengths(events(spark, sf_dir, ("sku", "roll_id", "along_start_mm")), ["sku", "roll_id"]).withColumn("width_m", F.lit(ROLL_WIDTH_M))


ROLLS = f"""v_rolls AS (
  SELECT l_partkey % 8 AS sku, l_partkey AS roll_id, greatest(max(l_extendedprice) / 1000::DOUBLE, 1e-6::DOUBLE) AS length_m, {ROLL_WIDTH_M}::DOUBLE AS width_m
  FROM lineitem GROUP BY l_partkey)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = row_numbers(e.withColumn("roll_id", F.col("user_id") % 10), ["roll_id"], ["ts", "event_id"], "place")
    f = e.select("roll_id", (F.col("place") - 1).alias("frame_index"), ((micros - F.lit(1704067200000000)) / F.lit(1e6)).alias("ts_s"), (F.col("event_type") != "error").alias("marked"), "value", (0.2 + (F.col("user_id") % 7) * F.lit(0.001)).alias("scale"), "event_type")
    measured = F.when(F.col("marked"), F.col("frame_index") * F.lit(100.0) - F.col("value") * F.col("scale"))
    return f.select("roll_id", "frame_index", "ts_s", measured.alias("measured_mm"), F.when(F.col("marked"), F.col("scale")).alias("mm_per_px"), "value", "event_type", "marked")


FRAMES = """v_frames AS (
  SELECT roll_id, frame_index, ts_s, CASE WHEN marked THEN frame_index * 100::DOUBLE - value * scale END AS measured_mm, CASE WHEN marked THEN scale END AS mm_per_px, value, event_type, marked
  FROM (SELECT user_id % 10 AS roll_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS frame_index,
          (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS ts_s, event_type <> 'error' AS marked, value, 0.2::DOUBLE + (user_id % 7) * 0.001::DOUBLE AS scale, event_type FROM events))"""


def clean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("sku"), F.col("event_id").alias("tile_id"), F.col("value").alias("score"))


SCORES = "v_scores AS (SELECT event_type AS sku, event_id AS tile_id, value AS score FROM events)"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("sku"), "vec_id", "embedding")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = li.select((F.col("l_suppkey") % 10).alias("roll_id"), F.col("l_linenumber").cast("long").alias("frame_index"), (F.col("l_quantity").cast("int") - 1).cast("long").alias("y"), (F.col("l_orderkey") % 50).alias("x"), "l_discount")
    return c.groupBy("roll_id", "frame_index", "y", "x").agg(F.max("l_discount").alias("score"))


CELLS = """v_cells AS (
  SELECT l_suppkey % 10 AS roll_id, l_linenumber::BIGINT AS frame_index, l_quantity::BIGINT - 1 AS y, l_orderkey % 50 AS x, max(l_discount) AS score
  FROM lineitem GROUP BY ALL)"""


def tile_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("roll_id"), (512 + F.col("p_size") * 16).cast("int").alias("h"), (1024 + F.col("p_size") * 8).cast("int").alias("w"))


TILE_FRAMES = "v_tiles AS (SELECT p_partkey AS roll_id, (512 + p_size * 16)::INT AS h, (1024 + p_size * 8)::INT AS w FROM part)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as operators' decisions on the events of their line items."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "rejected").otherwise("proposed")
    e = events(spark, sf_dir, ("roll_id", "event_id", "order_id"))
    return e.join(o, F.col("order_id") == F.col("o_orderkey")).select("roll_id", "event_id", status.alias("status"), F.col("o_custkey").alias("operator"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("decision_id"))


DECISIONS = EVENTS + """, v_decisions AS (
  SELECT roll_id, event_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'rejected' ELSE 'proposed' END AS status, o_custkey AS operator, o_orderdate AS "at", o_orderkey AS decision_id
  FROM v_events JOIN orders ON order_id = o_orderkey)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", F.col("n_chars").alias("score"), "toxic")


LABELLED = "v_labelled AS (SELECT doc_id, lang, n_chars AS score, toxic FROM labels JOIN documents USING (doc_id))"
