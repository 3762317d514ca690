"""Labelling and dataset-level checks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import is_pow2_square
from ..functions.paths import top_dir
from .position import with_position

#: a manifest document above this size is read in byte ranges
DOCUMENT_BYTES = 64 << 20
MANIFEST_SCHEMA = T.StructType([T.StructField("labels", T.ArrayType(T.ArrayType(T.StringType())), True)])


def distinct_classes(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Distinct top-level names, with their sorted position as ``label``."""
    tops = df.select(top_dir(path_col).alias("top")).distinct()
    return with_position(tops, "top", "label")


def labels_from_top_dir(df: DataFrame, path_col: str = "path", out_col: str = "label") -> DataFrame:
    """label = rank of the first path component among the sorted distinct
    ones (files at the root use ``''``); only when there is more than one.

    The class table holds one row per distinct folder; it is joined back by a
    plain equi-join (Spark broadcasts it when its measured size allows).
    """
    classes = distinct_classes(df, path_col)
    n = classes.count()
    if n <= 1:
        return df.withColumn(out_col, F.lit(None).cast("int"))
    cls = classes.select("top", F.col("label").cast("int").alias(out_col))
    return df.withColumn("_fl_top", top_dir(path_col)).join(cls, F.col("_fl_top") == F.col("top"), "left") \
        .drop("_fl_top", "top")


def resolve_manifest(pairs: DataFrame, pos_col: str = "pos", name_col: str = "name",
                     label_col: str = "label") -> DataFrame:
    """One label per name, the later pair winning (dictionary-build order)."""
    return pairs.groupBy(name_col).agg(F.max_by(F.col(label_col), F.col(pos_col)).alias(label_col))


def read_label_manifest(spark, path, vectors: bool = False) -> DataFrame:
    """Read ``{"labels": [[name, label], ...] | null}`` documents into ``(name, label)``.

    ``path`` may be one file, a glob of shards or a list of files; later pairs win, ordered by
    (file name, position).  A null ``labels`` yields no rows.  Documents of up to
    ``DOCUMENT_BYTES`` are one task each; if one is larger, all are read in byte ranges
    (:func:`split_manifest`).  Labels are whole numbers; ``vectors`` reads arrays of numbers as
    ``array<double>`` (a number is an array of one).  A label of neither form is
    an error, as a silent null would unlabel the data set.
    """
    pairs = None
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    if largest is not None and largest > DOCUMENT_BYTES:
        pairs = split_manifest(spark, path)
    if pairs is None:
        raw = (spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
               .select(F.input_file_name().alias("_file"), "labels"))
        pairs = raw.select("_file", F.posexplode("labels").alias("pos", "pair")).select(
            F.struct("_file", "pos").alias("pos"), F.element_at("pair", 1).alias("name"),
            F.element_at("pair", 2).alias("text"))
    return resolve_manifest(pairs.withColumn("label", manifest_label(F.col("text"), vectors)))


def split_manifest(spark, path) -> DataFrame | None:
    """``pos, name, text`` of the pairs of large documents ``{"labels": [[name, label], ...]}``.

    The text is cut behind the bracket and comma that end a pair, which Spark's text
    source does at any byte range of a file, so one document is many tasks.  ``pos``
    orders by file, range and place in it.  None if a piece is no pair (other keys, or
    names with a bracket and a comma): such documents are read whole.
    """
    pieces = spark.read.option("lineSep", "],").text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("place")).alias("pos"))
    body = F.regexp_replace("value", r'^\s*\{\s*"labels"\s*:\s*(\[|null\s*\}\s*$)', "")
    body = F.trim(F.regexp_replace(body, r"(\]\s*)?\]\s*\}\s*$", ""))
    # a vector's own bracket may have gone with the document's end
    closed = F.when(F.length(F.regexp_replace(body, r"[^\[]", "")) > F.length(F.regexp_replace(body, r"[^\]]", "")) + 1, F.concat(body, F.lit("]"))).otherwise(body)
    pair = F.from_json(F.concat(closed, F.lit("]")), "array<string>")
    rows = pieces.withColumn("body", body).where("body <> ''").select("pos", pair.alias("pair"))
    whole = F.coalesce((F.size("pair") == 2) & F.element_at("pair", 1).isNotNull(), F.lit(False))
    if rows.where(~whole).limit(1).count():
        return None
    return rows.select("pos", F.element_at("pair", 1).alias("name"), F.element_at("pair", 2).alias("text"))


def manifest_label(text, vectors: bool = False):
    """The label that a manifest holds as JSON ``text``; one of another form is an error."""
    if vectors:
        label = F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<double>"),
                           F.when(text.try_cast("double").isNotNull(), F.array(text.try_cast("double"))))
    else:
        label = text.try_cast("int")
    kind = "numbers" if vectors else "whole numbers"
    return F.when(text.isNotNull() & label.isNull(), F.raise_error(F.concat(F.lit(f"manifest labels must be {kind}: "), text))).otherwise(label)


def attach_labels(samples: DataFrame, manifest: DataFrame, name_col: str = "name",
                  strict: bool = False) -> DataFrame:
    """Left join of the manifest on the file name.  ``strict`` (the training
    loader) fails when a sample has no manifest entry."""
    joined = samples.join(manifest, name_col, "left")
    if strict:
        missing = samples.join(manifest.select(name_col), name_col, "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"samples without a label, e.g. {[r[name_col] for r in missing]}")
    return joined


def all_or_nothing_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Labels survive only if every row is labelled (an empty set counts as
    labelled); otherwise the whole label column becomes NULL."""
    all_labelled = df.agg(F.coalesce(F.bool_and(F.col(label_col).isNotNull()), F.lit(True)).alias("a")).first()["a"]
    if all_labelled:
        return df
    return df.withColumn(label_col, F.lit(None).cast(df.schema[label_col].dataType))


def limit_samples(df: DataFrame, max_images: int | None, idx_col: str = "idx") -> DataFrame:
    """The first ``max_images`` rows in index order; None keeps all, 0 keeps none."""
    if max_images is None:
        return df
    return df.where(F.col(idx_col) < F.lit(int(max_images)))


def uniform_square_offenders(df: DataFrame, idx_col: str = "idx", w_col: str = "w",
                             h_col: str = "h") -> DataFrame:
    """Rows whose size differs from the first row by index, plus that first
    row itself when it is not a power-of-two square.  Empty = dataset passes."""
    first = df.agg(F.min_by(F.struct(F.col(w_col).alias("w"), F.col(h_col).alias("h")), F.col(idx_col)).alias("f")).first()["f"]
    if first is None:
        return df.limit(0).withColumn("reason", F.lit(None).cast("string"))
    fw, fh = int(first["w"]), int(first["h"])
    bad_first = not (fw == fh and fw > 0 and (fw & (fw - 1)) == 0)
    differs = (F.col(w_col) != F.lit(fw)) | (F.col(h_col) != F.lit(fh))
    reason = (F.when(differs, F.lit("size differs from first image"))
              .when(F.lit(bad_first) & (F.col(w_col) != F.col(h_col)), F.lit("not square"))
              .when(F.lit(bad_first) & ~is_pow2_square(w_col, h_col), F.lit("not power of two")))
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def assert_uniform_square(df: DataFrame, idx_col: str = "idx", w_col: str = "w", h_col: str = "h") -> DataFrame:
    bad = uniform_square_offenders(df, idx_col, w_col, h_col).limit(10).collect()
    if bad:
        raise ValueError(f"images must be equal power-of-two squares; offenders e.g. {bad}")
    return df
