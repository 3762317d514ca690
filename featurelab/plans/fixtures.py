"""Logical inputs of the operators, bound to the driver tables.

Every builder takes ``(spark, sf_dir)`` and reads whole tables; the matching
``*_SQL`` text defines the same input for the DuckDB oracle (tables are views
there).  The parity split of ``embeddings`` into reference and sample sets is
the definition of the two sets an evaluation compares (both halves are used),
not a subset taken to save work.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ features
def features(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def ref_features(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).where(F.pmod("id", F.lit(2)) == 0)


def sample_features(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).where(F.pmod("id", F.lit(2)) == 1)


FEATURES_SQL = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings"
REF_SQL = f"SELECT * FROM ({FEATURES_SQL}) WHERE id % 2 = 0"
SAMPLE_SQL = f"SELECT * FROM ({FEATURES_SQL}) WHERE id % 2 = 1"


def probs(spark, sf_dir) -> DataFrame:
    """Class probabilities: softmax of ``20 * embedding[1..10]``."""
    from ..operators.stats import softmax
    x = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10), lambda v: v * 20.0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), softmax(x).alias("probs"))


PROBS_SQL = """
SELECT id, list_transform(z, lambda v: v / list_sum(z)) AS probs FROM (
  SELECT id, list_transform(x, lambda v: exp(v - list_max(x))) AS z FROM (
    SELECT vec_id AS id,
           list_transform(CAST(embedding AS DOUBLE[])[1:10], lambda v: v * 20.0) AS x
    FROM embeddings))
"""


# ------------------------------------------------------------------ vectors
def moments(spark, sf_dir) -> DataFrame:
    """Encoder moments: mean = dims 1..32, std = |dims 33..64|."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.slice(e, 1, 32).alias("mean"),
        F.transform(F.slice(e, 33, 32), lambda v: F.abs(v)).alias("std"))


MOMENTS_SQL = """
SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:32] AS mean,
       list_transform(CAST(embedding AS DOUBLE[])[33:64], lambda v: abs(v)) AS std
FROM embeddings
"""


def hidden(spark, sf_dir) -> DataFrame:
    """Hidden states: the 64 values as 16 tokens of width 4 (1 class, 4 registers, 11 patches)."""
    e = F.col("embedding").cast("array<double>")
    toks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(e, t * 4 + 1, 4))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), toks.alias("tokens"))


HIDDEN_SQL = """
SELECT vec_id AS id,
       list_transform(range(0, 16), lambda t: CAST(embedding AS DOUBLE[])[t * 4 + 1: t * 4 + 4]) AS tokens
FROM embeddings
"""


def predictions(spark, sf_dir) -> DataFrame:
    """cond = embedding of id 2k, uncond = embedding of id 2k+1, key k."""
    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("bigint").alias("k"), F.pmod("vec_id", F.lit(2)).alias("par"),
        F.col("embedding").cast("array<double>").alias("v"))
    c = e.where("par = 0").select("k", F.col("v").alias("cond"))
    u = e.where("par = 1").select("k", F.col("v").alias("uncond"))
    return c.join(u, "k")


PREDICTIONS_SQL = """
SELECT c.k, c.v AS cond, u.v AS uncond FROM
  (SELECT vec_id // 2 AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0) c
  JOIN (SELECT vec_id // 2 AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1) u
  ON c.k = u.k
"""


# ------------------------------------------------------------------ paths / images
def image_paths(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = (F.when(F.pmod("doc_id", F.lit(5)) == 0, "png").when(F.pmod("doc_id", F.lit(5)) == 1, "JPG")
           .when(F.pmod("doc_id", F.lit(5)) == 2, "jpeg").when(F.pmod("doc_id", F.lit(5)) == 3, "npy")
           .otherwise("txt"))
    folder = F.when(F.pmod("doc_id", F.lit(17)) == 0, F.lit("")).otherwise(F.concat(F.col("source"), F.lit("/")))
    return d.select("doc_id", F.concat(folder, F.lit("img_"), F.col("doc_id").cast("string"),
                                       F.lit("."), ext).alias("path"))


IMAGE_PATHS_SQL = """
SELECT doc_id,
       CASE WHEN doc_id % 17 = 0 THEN '' ELSE source || '/' END || 'img_' || CAST(doc_id AS VARCHAR) || '.' ||
       CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'npy' ELSE 'txt' END
       AS path
FROM documents
"""


def image_dims(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    (F.lit(16) + F.pmod("n_chars", F.lit(997))).cast("int").alias("w"),
                    (F.lit(16) + F.pmod(F.col("n_chars") * 7 + F.col("doc_id"), F.lit(613))).cast("int").alias("h"))


IMAGE_DIMS_SQL = """
SELECT doc_id, CAST(16 + n_chars % 997 AS INTEGER) AS w,
       CAST(16 + (n_chars * 7 + doc_id) % 613 AS INTEGER) AS h
FROM documents
"""


def manifest(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"),
                      (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


MANIFEST_SQL = """
SELECT 'img_' || CAST(doc_id AS VARCHAR) || '.png' AS name, CAST(quality * 2 + toxic AS INTEGER) AS label
FROM labels
"""


# ------------------------------------------------------------------ metrics
def metric_reports_from(ev: DataFrame, keep=()) -> DataFrame:
    """Metric reports from an events frame (batch or stream): NaN, inf and 1e25 injected."""
    v = (F.when(F.pmod("event_id", F.lit(97)) == 0, F.lit(float("nan")))
         .when(F.pmod("event_id", F.lit(101)) == 0, F.lit(float("inf")))
         .when(F.pmod("event_id", F.lit(103)) == 0, F.lit(1e25))
         .otherwise(F.col("value")))
    return ev.select("event_id", F.col("event_type").alias("name"),
                     F.pmod("event_id", F.lit(8)).cast("int").alias("rank"), v.alias("value"), *keep)


def ntz_as_utc(col: str = "ts"):
    """A ``timestamp_ntz`` wall-clock read as UTC, independent of the session time zone
    (a plain cast would use the session zone)."""
    c = F.col(col)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def metric_reports(spark, sf_dir) -> DataFrame:
    return metric_reports_from(table(spark, sf_dir, "events"))


METRIC_REPORTS_SQL = """
SELECT event_id, event_type AS name, CAST(event_id % 8 AS INTEGER) AS rank,
       CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN event_id % 103 = 0 THEN 1e25
            ELSE value END AS value
FROM events
"""


def step_log_from(reports: DataFrame) -> DataFrame:
    return reports.select(
        "*", F.floor(F.col("event_id") / 8).cast("bigint").alias("step"),
        (F.pmod("event_id", F.lit(4)) == 3).alias("is_sync"))


def step_log(spark, sf_dir) -> DataFrame:
    return step_log_from(metric_reports(spark, sf_dir))


STEP_LOG_SQL = f"""
SELECT *, event_id // 8 AS step, (event_id % 4 = 3) AS is_sync FROM ({METRIC_REPORTS_SQL})
"""


def metric_series(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value")


def checkpoints(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("training-state-"), F.col("o_orderkey").cast("string"),
                             F.lit(".pt")).alias("file"))


CHECKPOINTS_SQL = "SELECT 'training-state-' || CAST(o_orderkey AS VARCHAR) || '.pt' AS file FROM orders"


def param_shapes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("tensor_id"), F.col("p_brand").alias("group"),
                    F.array(F.col("p_size").cast("bigint"),
                            (F.lit(1) + F.pmod("p_partkey", F.lit(7))).cast("bigint")).alias("shape"))


PARAM_SHAPES_SQL = """
SELECT p_partkey AS tensor_id, p_brand AS "group",
       [CAST(p_size AS BIGINT), CAST(1 + p_partkey % 7 AS BIGINT)] AS shape
FROM part
"""
