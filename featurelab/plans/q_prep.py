"""Registered queries of the dataset-preparation family (S1, S4, S8, S9, P1-P8, G1-G8,
W1, W2, J1-J3, J7, J8, U1, U2, U4, F1-F9, K4, V21) and their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as G
from ..functions import paths as P
from ..operators import align as A
from ..operators import labels as L
from ..operators.position import with_position
from . import fixtures as fx
from .q_evaluate import rnd

IMG_EXT_SQL = ", ".join(f"'{e}'" for e in P.IMAGE_EXTENSIONS)
SUPPORTED_SQL = ", ".join(f"'{e}'" for e in P.supported_extensions([".npy"]))
IGNORES = ["*.txt", "src1?", "img_1*"]


# ---------------------------------------------------------------- helpers
def image_index(spark, sf):
    """S1 over the path listing: image files sorted by path, ``idx`` = position."""
    p = fx.image_paths(spark, sf).where(P.is_image_path("path"))
    return with_position(p, "path", "idx")


def image_index_sql() -> str:
    return f"""SELECT row_number() OVER (ORDER BY path) - 1 AS idx, doc_id, path
FROM ({fx.IMAGE_PATHS_SQL}) WHERE lower(string_split(path, '.')[-1]) IN ({IMG_EXT_SQL})"""


def _named_pairs(spark, sf):
    """Manifest pairs with repeated names (later entries must win)."""
    lab = fx.table(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("pos"),
                      F.concat(F.lit("img_"), F.pmod("doc_id", F.lit(97)).cast("string"), F.lit(".png")).alias("name"),
                      (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


# ---------------------------------------------------------------- queries
def q_is_image(spark, sf):
    return fx.image_paths(spark, sf).select("doc_id", "path", P.is_image_path("path").alias("is_image"))


def q_supported_ext(spark, sf):
    ext = F.lower(P.file_ext("path"))
    p = fx.image_paths(spark, sf).where(ext.isin(P.supported_extensions([".npy"])))
    return p.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def q_image_index(spark, sf):
    return image_index(spark, sf).select("idx", "doc_id", "path")


def q_limit_samples(spark, sf):
    return L.limit_samples(image_index(spark, sf), 100).select("idx", "path")


def q_artifact_paths(spark, sf):
    i = image_index(spark, sf)
    return i.select("idx", *[P.artifact_path("idx", k).alias(k) for k in ("image", "latents", "cls", "patches")])


def q_round_robin(spark, sf):
    i = image_index(spark, sf)
    return i.groupBy(P.round_robin("idx", 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"),
                                                                   F.min("idx").alias("first_idx"))


def q_top_dir_labels(spark, sf):
    return L.labels_from_top_dir(image_index(spark, sf)).select("idx", "path", "label")


def q_distinct_classes(spark, sf):
    return L.distinct_classes(fx.image_paths(spark, sf)).select("top", "label")


def q_manifest_resolve(spark, sf):
    return L.resolve_manifest(_named_pairs(spark, sf))


def _attached(spark, sf):
    i = image_index(spark, sf).withColumn("name", P.base_name("path"))
    return L.attach_labels(i, fx.manifest(spark, sf), "name")


def q_attach_labels(spark, sf):
    return _attached(spark, sf).select("idx", "path", "label")


def q_all_or_nothing(spark, sf):
    left = L.all_or_nothing_labels(_attached(spark, sf))
    inner = L.all_or_nothing_labels(_attached(spark, sf).where(F.col("label").isNotNull()))
    def summ(df, tag):
        return df.agg(F.lit(tag).alias("case"), F.count(F.lit(1)).alias("n_rows"),
                      F.count("label").alias("n_labelled"))
    return summ(left, "left").unionByName(summ(inner, "labelled_only"))


def q_uniform_offenders(spark, sf):
    d = fx.image_dims(spark, sf).withColumnRenamed("doc_id", "idx")
    return L.uniform_square_offenders(d).select("idx", "w", "h", "reason")


def q_plan_scale(spark, sf):
    d = fx.image_dims(spark, sf)
    return d.select("doc_id", G.plan_scale("w", "h", 256, None).alias("p")).select("doc_id", "p.*")


def q_center_crop(spark, sf):
    d = fx.image_dims(spark, sf)
    return d.select("doc_id", G.plan_center_crop("w", "h", 256, 256).alias("p")).select("doc_id", "p.*")


def q_wide_crop(spark, sf):
    d = fx.image_dims(spark, sf)
    return d.select("doc_id", G.plan_center_crop_wide("w", "h", 512, 256).alias("p")).select("doc_id", "p.*")


def q_dhariwal(spark, sf):
    d = fx.image_dims(spark, sf)
    return d.select("doc_id", G.plan_dhariwal("w", "h", 64).alias("p")).select("doc_id", "p.*")


def _size_strings(spark, sf):
    d = fx.image_dims(spark, sf)
    s = (F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat_ws("x", "w", "h"))
         .when(F.pmod("doc_id", F.lit(3)) == 1, F.concat_ws(",", "w", "h"))
         .otherwise(F.concat(F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"), F.lit("px"))))
    return d.select("doc_id", s.alias("s"))


def q_parse_size(spark, sf):
    return _size_strings(spark, sf).select("doc_id", "s", P.parse_size("s").alias("p")).select(
        "doc_id", "s", F.col("p.w").alias("w"), F.col("p.h").alias("h"))


def q_relative_path(spark, sf):
    p = fx.image_paths(spark, sf)
    win = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.regexp_replace("path", "/", "\\\\")).otherwise(F.col("path"))
    full = F.concat(F.lit("/data/"), win)
    return p.select("doc_id", P.relative_path(full, "/data").alias("rel"))


def q_list_filter(spark, sf):
    """S8 over a listing: glob ``IGNORES`` prune any matching directory or file name."""
    p = fx.image_paths(spark, sf)
    pats = [P.fnmatch_regex(g) for g in IGNORES]
    hit = F.exists(F.split("path", "/"), lambda c: F.lit(False) if not pats else
                   _any([c.rlike(r) for r in pats]))
    return p.where(~hit).select("doc_id", "path")


def _any(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def q_checkpoint_name(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", P.checkpoint_name("o_orderkey").alias("file"))


def q_latest_checkpoint(spark, sf):
    return P.latest_checkpoint(fx.checkpoints(spark, sf))


def q_format_duration(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", P.format_duration("l_extendedprice").alias("dur"),
                     P.format_duration("l_extendedprice", brief=True).alias("brief"))


def _url_variants(spark, sf):
    p = fx.table(spark, sf, "pages")
    v = [p.select("page_id", F.lit(0).alias("variant"), F.col("url")),
         p.select("page_id", F.lit(1).alias("variant"), F.regexp_replace("url", "://", ":/").alias("url")),
         p.select("page_id", F.lit(2).alias("variant"), F.regexp_replace("url", r"\.example\.[a-z]+", "").alias("url")),
         p.select("page_id", F.lit(3).alias("variant"), F.regexp_replace("url", "^https?", "ftp").alias("url")),
         p.select("page_id", F.lit(4).alias("variant"), F.regexp_replace("url", "^https?", "foo").alias("url"))]
    out = v[0]
    for x in v[1:]:
        out = out.unionByName(x)
    return out


def q_valid_url(spark, sf):
    return _url_variants(spark, sf).select("page_id", "variant", P.is_valid_url("url").alias("valid"))


def q_cache_key(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", P.cache_key("url").alias("cache_key"))


def q_run_name(spark, sf):
    p = fx.table(spark, sf, "part")
    cfg = (F.lit(1.0) + F.col("p_size") / 10.0)
    return p.select("p_partkey", P.run_name(F.lit("model-XL/2"), P.checkpoint_name("p_partkey"), F.lit(256), F.lit("ema"),
                                            cfg, F.col("p_partkey"), F.lit("sde"), F.lit(0.85), F.lit(1.5)).alias("folder"),
                    P.report_name(F.lit("eval/"), F.lit(250), P.checkpoint_name("p_partkey"), cfg, F.lit(0.85),
                                  F.lit(1.5), F.pmod("p_partkey", F.lit(2)) == 0).alias("report"))


def _cls_files(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select(P.artifact_path("doc_id", "cls").alias("path"))


def _patch_files(spark, sf):
    d = fx.table(spark, sf, "documents").where(F.pmod("doc_id", F.lit(11)) != 0)
    return d.select(P.artifact_path("doc_id", "patches").alias("path"))


def q_feature_set(spark, sf):
    """Class-token files and the derived sibling path."""
    c = _cls_files(spark, sf)
    return c.where(F.col("path").endswith("_cls.npy")).select(
        "path", F.regexp_replace("path", r"_cls\.npy$", "_patches.npy").alias("sibling"))


def q_missing_siblings(spark, sf):
    return A.missing_siblings(_cls_files(spark, sf), _patch_files(spark, sf)).select("cls_path")


def _modalities(spark, sf):
    d = fx.table(spark, sf, "documents")
    return {"images": fx.image_paths(spark, sf).select("path"),
            "latents": d.where(F.pmod("doc_id", F.lit(13)) != 0).select(P.artifact_path("doc_id", "latents").alias("path")),
            "tokens": d.select(P.artifact_path("doc_id", "cls").alias("path"))}


def q_align_modalities(spark, sf):
    return A.align_modalities(_modalities(spark, sf), strict=False, how="full").select(
        "pos", "images_path", "latents_path", "tokens_path")


def q_align_by_stem(spark, sf):
    """J1 keyed mode: artifacts joined on the 8-digit index stem, so a missing
    latent leaves a gap instead of shifting every later pair."""
    d = fx.table(spark, sf, "documents")
    stem = P.index_string("doc_id").alias("stem")
    src = {"images": fx.image_paths(spark, sf).select(P.index_string("doc_id").alias("stem"), "path"),
           "latents": d.where(F.pmod("doc_id", F.lit(13)) != 0).select(
               stem, P.artifact_path("doc_id", "latents").alias("path")),
           "tokens": d.select(stem, P.artifact_path("doc_id", "cls").alias("path"))}
    return A.align_by_stem(src, "stem", how="full").select("stem", "images_path", "latents_path", "tokens_path")


def q_count_parity(spark, sf):
    return A.count_parity(_modalities(spark, sf))


def q_stems_missing(spark, sf):
    d = fx.table(spark, sf, "documents")
    a = d.select(P.index_string("doc_id").alias("stem"))
    b = d.where(F.pmod("doc_id", F.lit(13)) != 0).select(P.index_string("doc_id").alias("stem"))
    return A.stems_missing(a, b)


def q_merge_by_name(spark, sf):
    p = fx.table(spark, sf, "part")
    dst = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"),
                   F.col("p_retailprice").alias("value"))
    src = p.where(F.pmod("p_partkey", F.lit(3)) == 0).select(F.col("p_name").alias("name"),
                                                             (F.col("p_retailprice") * 2).alias("value"))
    return A.merge_by_name(dst, src, each=lambda c: rnd(c, 4)).select("key", "name", "value")


def replicas(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    r = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"))
    bump = F.transform("embedding", lambda x, i: F.when((F.pmod("vec_id", F.lit(50)) == F.col("rank"))
                                                        & (i == F.pmod("vec_id", F.lit(64))),
                                                        x.cast("double") + 1.0).otherwise(x.cast("double")))
    return r.select("rank", F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("name"),
                    bump.alias("values"))


def q_replica_diff(spark, sf):
    d = A.replica_diff(replicas(spark, sf), ignore_regex=r"vec_1\d*")
    return d.select("rank", "name", "pos", rnd("value").alias("value"), rnd("reference").alias("reference"))


def _pixels(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 127.5).cast("int")).alias("px"),
                    F.col("embedding").cast("array<double>").alias("x"))


def _long(df, col, name):
    return df.select("id", F.posexplode(col).alias("i", name)).select("id", F.col("i").cast("int").alias("i"), name)


def q_normalize_pixels(spark, sf):
    p = _pixels(spark, sf)
    return _long(p.select("id", G.normalize_pixels("px").alias("v")), "v", "v").select("id", "i", rnd("v").alias("v"))


def q_standardize(spark, sf):
    p = _pixels(spark, sf)
    return _long(p.select("id", G.standardize_channels("px", "clip").alias("v")), "v", "v").select(
        "id", "i", rnd("v").alias("v"))


def q_quantize(spark, sf):
    p = _pixels(spark, sf)
    q = p.select("id", G.quantize_pixels(G.dequantize_latents("x", 4.0, -0.5), "truncate").alias("t"),
                 G.quantize_pixels("x", "round").alias("r"))
    return q.select("id", F.posexplode(F.arrays_zip("t", "r")).alias("i", "z")).select(
        "id", F.col("i").cast("int").alias("i"), F.col("z.t").alias("trunc"), F.col("z.r").alias("rounded"))


def q_tile_layout(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return e.select("vec_id", G.tile_layout("vec_id", F.lit(n)).alias("t")).select("vec_id", "t.*")


def q_order_results(spark, sf):
    """K3: output in index order whatever the task finish order (range partitions): each row
    with its place in the files as written."""
    from ..operators.position import order_results
    from ..session import stage
    written = stage(order_results(image_index(spark, sf), "idx").select("idx", "path", F.monotonically_increasing_id().alias("at")), "ordered")
    return with_position(written, "at", "place").select("idx", "path", "place")


def q_json_config(spark, sf):
    """run arguments to JSON text and back (one config per part row)."""
    p = fx.table(spark, sf, "part")
    cfg = F.struct(F.lit("model-XL/2").alias("model"), (F.lit(1.0) + F.col("p_size") / 10.0).alias("cfg_scale"),
                   F.col("p_partkey").alias("seed"), F.array(F.col("p_size"), F.lit(2)).alias("resolution"))
    j = p.select("p_partkey", F.to_json(cfg).alias("json"))
    back = j.select("p_partkey", F.from_json("json", "model string, cfg_scale double, seed long, "
                                                     "resolution array<int>").alias("c"))
    return back.select("p_partkey", "c.model", rnd("c.cfg_scale").alias("cfg_scale"), "c.seed",
                       F.element_at("c.resolution", 1).alias("res0"))


QUERIES = {
    "prep_order_results": q_order_results,
    "paths_json_config": q_json_config,
    "prep_is_image": q_is_image,
    "prep_supported_ext": q_supported_ext,
    "prep_image_index": q_image_index,
    "prep_limit_samples": q_limit_samples,
    "prep_artifact_paths": q_artifact_paths,
    "prep_round_robin": q_round_robin,
    "prep_top_dir_labels": q_top_dir_labels,
    "prep_distinct_classes": q_distinct_classes,
    "prep_manifest_resolve": q_manifest_resolve,
    "prep_attach_labels": q_attach_labels,
    "prep_all_or_nothing": q_all_or_nothing,
    "prep_uniform_offenders": q_uniform_offenders,
    "prep_plan_scale": q_plan_scale,
    "prep_center_crop_plan": q_center_crop,
    "prep_wide_crop_plan": q_wide_crop,
    "prep_dhariwal_plan": q_dhariwal,
    "prep_parse_size": q_parse_size,
    "prep_normalize_pixels": q_normalize_pixels,
    "prep_standardize": q_standardize,
    "prep_quantize": q_quantize,
    "prep_tile_layout": q_tile_layout,
    "paths_relative": q_relative_path,
    "paths_list_filter": q_list_filter,
    "paths_checkpoint_name": q_checkpoint_name,
    "paths_latest_checkpoint": q_latest_checkpoint,
    "paths_format_duration": q_format_duration,
    "paths_valid_url": q_valid_url,
    "paths_cache_key": q_cache_key,
    "paths_run_name": q_run_name,
    "paths_feature_set": q_feature_set,
    "align_missing_siblings": q_missing_siblings,
    "align_modalities": q_align_modalities,
    "align_by_stem": q_align_by_stem,
    "align_count_parity": q_count_parity,
    "align_stems_missing": q_stems_missing,
    "align_merge_by_name": q_merge_by_name,
    "align_replica_diff": q_replica_diff,
}

# ---------------------------------------------------------------- oracles
_IDX = image_index_sql()
_TOP = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END"


def _art(idx: str, fmt: str) -> str:
    s = f"printf('%08d', {idx})"
    return f"substr({s}, 1, 5) || '/' || printf('{fmt}', {s})"


def _fnmatch_sql(col: str) -> str:
    pats = [P.fnmatch_regex(g) for g in IGNORES]
    return " OR ".join(f"regexp_full_match({col}, '{p}')" for p in pats)


_DUR = """
CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's'
     WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ' || printf('%02d', s % 60) || 's'
     WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || printf('%02d', (s // 60) % 60) || 'm '
                         || printf('%02d', s % 60) || 's'
     ELSE CAST(s // 86400 AS VARCHAR) || 'd ' || printf('%02d', (s // 3600) % 24) || 'h '
          || printf('%02d', (s // 60) % 60) || 'm' END"""
_DUR_BRIEF = """
CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's'
     WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ' || printf('%02d', s % 60) || 's'
     WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || printf('%02d', (s // 60) % 60) || 'm'
     ELSE CAST(s // 86400 AS VARCHAR) || 'd ' || printf('%02d', (s // 3600) % 24) || 'h' END"""

_SCHEMES = ", ".join(f"'{s}'" for s in P.RELATIVE_SCHEMES)
_URLS = """
SELECT page_id, 0 AS variant, url FROM pages
UNION ALL SELECT page_id, 1, replace(url, '://', ':/') FROM pages
UNION ALL SELECT page_id, 2, regexp_replace(url, '\\.example\\.[a-z]+', '', 'g') FROM pages
UNION ALL SELECT page_id, 3, regexp_replace(url, '^https?', 'ftp') FROM pages
UNION ALL SELECT page_id, 4, regexp_replace(url, '^https?', 'foo') FROM pages
"""

_MODS = f"""
img AS (SELECT path AS images_path, row_number() OVER (ORDER BY path) - 1 AS pos FROM ({fx.IMAGE_PATHS_SQL})),
lat AS (SELECT p AS latents_path, row_number() OVER (ORDER BY p) - 1 AS pos
        FROM (SELECT {_art('doc_id', 'img-mean-std-%s.npy')} AS p FROM documents WHERE doc_id % 13 <> 0)),
tok AS (SELECT p AS tokens_path, row_number() OVER (ORDER BY p) - 1 AS pos
        FROM (SELECT {_art('doc_id', 'img-dinov3-%s_cls.npy')} AS p FROM documents))
"""

_PIXELS = """
SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(floor((v + 1.0) * 127.5) AS INTEGER)) AS px,
       CAST(embedding AS DOUBLE[]) AS x
FROM embeddings
"""
_CLIP_M = "[" + ", ".join(repr(v) for v in G.CLIP_MEAN) + "]"
_CLIP_S = "[" + ", ".join(repr(v) for v in G.CLIP_STD) + "]"

ORACLES = {
    "prep_order_results": f"SELECT idx, path, row_number() OVER (ORDER BY idx) - 1 AS place FROM ({_IDX})",
    "paths_json_config": """SELECT p_partkey, 'model-XL/2' AS model, round0(1.0 + p_size / 10.0, 6) AS cfg_scale,
  p_partkey AS seed, p_size AS res0 FROM part""",
    "prep_is_image": f"""SELECT doc_id, path, lower(string_split(path, '.')[-1]) IN ({IMG_EXT_SQL}) AS is_image
FROM ({fx.IMAGE_PATHS_SQL})""",
    "prep_supported_ext": f"""SELECT lower(string_split(path, '.')[-1]) AS ext, count(*) AS n FROM ({fx.IMAGE_PATHS_SQL})
WHERE lower(string_split(path, '.')[-1]) IN ({SUPPORTED_SQL}) GROUP BY 1""",
    "prep_image_index": _IDX,
    "prep_limit_samples": f"SELECT idx, path FROM ({_IDX}) WHERE idx < 100",
    "prep_artifact_paths": f"""SELECT idx, {_art('idx', 'img%s.png')} AS image, {_art('idx', 'img-mean-std-%s.npy')} AS latents,
  {_art('idx', 'img-dinov3-%s_cls.npy')} AS cls, {_art('idx', 'img-dinov3-%s_patches.npy')} AS patches FROM ({_IDX})""",
    "prep_round_robin": f"SELECT idx % 8 AS shard, count(*) AS n, min(idx) AS first_idx FROM ({_IDX}) GROUP BY 1",
    "prep_top_dir_labels": f"""WITH i AS ({_IDX}), t AS (SELECT idx, path, {_TOP} AS top FROM i),
c AS (SELECT top, CAST(row_number() OVER (ORDER BY top) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT top FROM t))
SELECT idx, path, CASE WHEN (SELECT count(*) FROM c) > 1 THEN label END AS label FROM t JOIN c USING (top)""",
    "prep_distinct_classes": f"""SELECT top, row_number() OVER (ORDER BY top) - 1 AS label
FROM (SELECT DISTINCT {_TOP} AS top FROM ({fx.IMAGE_PATHS_SQL}))""",
    "prep_manifest_resolve": """SELECT 'img_' || CAST(doc_id % 97 AS VARCHAR) || '.png' AS name,
  arg_max(CAST(quality * 2 + toxic AS INTEGER), doc_id) AS label FROM labels GROUP BY 1""",
    "prep_attach_labels": f"""SELECT i.idx, i.path, m.label FROM ({_IDX}) i
LEFT JOIN ({fx.MANIFEST_SQL}) m ON string_split(i.path, '/')[-1] = m.name""",
    "prep_all_or_nothing": f"""WITH a AS (SELECT i.idx, m.label FROM ({_IDX}) i
  LEFT JOIN ({fx.MANIFEST_SQL}) m ON string_split(i.path, '/')[-1] = m.name)
SELECT 'left' AS "case", count(*) AS n_rows,
       CASE WHEN coalesce(bool_and(label IS NOT NULL), true) THEN count(label) ELSE 0 END AS n_labelled FROM a
UNION ALL
SELECT 'labelled_only', count(*), count(label) FROM a WHERE label IS NOT NULL""",
    "prep_uniform_offenders": f"""WITH d AS (SELECT doc_id AS idx, w, h FROM ({fx.IMAGE_DIMS_SQL})),
f AS (SELECT arg_min(w, idx) AS fw, arg_min(h, idx) AS fh FROM d),
r AS (SELECT d.*, CASE WHEN w <> fw OR h <> fh THEN 'size differs from first image'
   WHEN NOT (fw = fh AND fw > 0 AND (fw & (fw - 1)) = 0) AND w <> h THEN 'not square'
   WHEN NOT (fw = fh AND fw > 0 AND (fw & (fw - 1)) = 0) AND NOT (w = h AND w > 0 AND bit_count(w) = 1)
     THEN 'not power of two' END AS reason FROM d, f)
SELECT idx, w, h, reason FROM r WHERE reason IS NOT NULL""",
    "prep_plan_scale": f"""SELECT doc_id, CAST(256 AS INTEGER) AS out_w, h AS out_h, NOT (w = 256 AND h = h) AS resized
FROM ({fx.IMAGE_DIMS_SQL})""",
    "prep_center_crop_plan": f"""SELECT doc_id, least(w, h) AS crop, CAST((h - least(w, h)) // 2 AS INTEGER) AS y0,
  CAST((h + least(w, h)) // 2 AS INTEGER) AS y1, CAST((w - least(w, h)) // 2 AS INTEGER) AS x0,
  CAST((w + least(w, h)) // 2 AS INTEGER) AS x1, CAST(256 AS INTEGER) AS out_w, CAST(256 AS INTEGER) AS out_h
FROM ({fx.IMAGE_DIMS_SQL})""",
    "prep_wide_crop_plan": f"""SELECT doc_id, ch AS crop_h, CAST(floor((h - ch) / 2) AS INTEGER) AS y0,
  CAST(floor((h + ch) / 2) AS INTEGER) AS y1, CAST(128 AS INTEGER) AS paste_y0, CAST(384 AS INTEGER) AS paste_y1,
  CAST(512 AS INTEGER) AS canvas, (w < 512 OR ch < 256) AS rejected
FROM (SELECT doc_id, w, h, CAST(round_even(CAST(512 AS DOUBLE) * h / w, 0) AS INTEGER) AS ch FROM ({fx.IMAGE_DIMS_SQL}))""",
    "prep_dhariwal_plan": f"""WITH a AS (SELECT doc_id, w, h, CAST(floor(least(w, h) / 64) AS BIGINT) AS q FROM ({fx.IMAGE_DIMS_SQL})),
b AS (SELECT doc_id, w, h, CASE WHEN q < 1 THEN 0 ELSE length(bin(q)) - 1 END AS k FROM a),
c AS (SELECT doc_id, k, w >> k AS hw, h >> k AS hh FROM b),
d AS (SELECT *, CAST(64 AS DOUBLE) / least(hw, hh) AS sc FROM c),
e AS (SELECT *, CAST(round_even(hw * sc, 0) AS INTEGER) AS nw, CAST(round_even(hh * sc, 0) AS INTEGER) AS nh FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS halvings, CAST(hw AS INTEGER) AS half_w, CAST(hh AS INTEGER) AS half_h,
  nw AS resize_w, nh AS resize_h, CAST(floor((nh - 64) / 2) AS INTEGER) AS crop_y,
  CAST(floor((nw - 64) / 2) AS INTEGER) AS crop_x FROM e""",
    "prep_parse_size": f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(w AS VARCHAR) || 'x' || CAST(h AS VARCHAR)
  WHEN doc_id % 3 = 1 THEN CAST(w AS VARCHAR) || ',' || CAST(h AS VARCHAR)
  ELSE CAST(w AS VARCHAR) || 'x' || CAST(h AS VARCHAR) || 'px' END AS s FROM ({fx.IMAGE_DIMS_SQL}))
SELECT doc_id, s,
  CASE WHEN regexp_full_match(s, '(\\d+)[x,](\\d+)') THEN TRY_CAST(regexp_extract(s, '^(\\d+)[x,](\\d+)$', 1) AS INTEGER) END AS w,
  CASE WHEN regexp_full_match(s, '(\\d+)[x,](\\d+)') THEN TRY_CAST(regexp_extract(s, '^(\\d+)[x,](\\d+)$', 2) AS INTEGER) END AS h
FROM s""",
    "prep_normalize_pixels": f"""SELECT id, CAST(i - 1 AS INTEGER) AS i, round0(px[i] / 127.5 - 1.0, 6) AS v
FROM ({_PIXELS}), range(1, 65) t(i)""",
    "prep_standardize": f"""SELECT id, CAST(i - 1 AS INTEGER) AS i,
  round0((px[i] / 255.0 - {_CLIP_M}[((i - 1) % 3) + 1]) / {_CLIP_S}[((i - 1) % 3) + 1], 6) AS v
FROM ({_PIXELS}), range(1, 65) t(i)""",
    "prep_quantize": f"""SELECT id, CAST(i - 1 AS INTEGER) AS i,
  CAST(floor(least(greatest((((x[i] + 0.5) / 4.0) + 1.0) / 2.0 * 255.0, 0.0), 255.0)) AS INTEGER) AS trunc,
  CAST(floor(least(greatest(least(greatest((x[i] + 1.0) / 2.0, 0.0), 1.0) * 255.0 + 0.5, 0.0), 255.0)) AS INTEGER) AS rounded
FROM ({_PIXELS}), range(1, 65) t(i)""",
    "prep_tile_layout": """WITH n AS (SELECT CAST(round_even(sqrt(count(*)), 0) AS BIGINT) AS c FROM embeddings)
SELECT vec_id, c AS n_cols, CAST(floor(vec_id / c) AS BIGINT) AS "row", vec_id % c AS col FROM embeddings, n""",
    "paths_relative": f"""SELECT doc_id, CASE WHEN starts_with(p, '/data/') THEN substr(p, 7) ELSE p END AS rel FROM (
  SELECT doc_id, replace('/data/' || CASE WHEN doc_id % 2 = 0 THEN replace(path, '/', '\\') ELSE path END, '\\', '/') AS p
  FROM ({fx.IMAGE_PATHS_SQL}))""",
    "paths_list_filter": f"""SELECT doc_id, path FROM ({fx.IMAGE_PATHS_SQL})
WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda c: {_fnmatch_sql('c')}))""",
    "paths_checkpoint_name": "SELECT o_orderkey, printf('%07d.pt', o_orderkey) AS file FROM orders",
    "paths_latest_checkpoint": f"""SELECT arg_max(file, n) AS latest, CAST(max(n) AS BIGINT) AS step, count(*) AS n_matching FROM (
  SELECT file, CAST(regexp_extract(file, '^(?:training-state-(\\d+).pt)$', 1) AS DOUBLE) AS n FROM ({fx.CHECKPOINTS_SQL})
  WHERE regexp_full_match(file, 'training-state-(\\d+).pt'))""",
    "paths_format_duration": f"""SELECT l_orderkey, l_linenumber, {_DUR} AS dur, {_DUR_BRIEF} AS brief FROM (
  SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS s FROM lineitem)""",
    "paths_valid_url": f"""SELECT page_id, variant, coalesce(contains(url, '://') AND sch <> '' AND net <> '' AND contains(net, '.')
  AND sch IN ({_SCHEMES}), false) AS valid FROM (
  SELECT page_id, variant, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS sch,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS net FROM ({_URLS}))""",
    "paths_cache_key": """SELECT page_id, md5(url) || '_' || substr(regexp_replace(url, '[^0-9a-zA-Z\\-._]', '_', 'g'), 1, 128)
  AS cache_key FROM pages""",
    "paths_run_name": """SELECT p_partkey,
  'model-XL-2-' || replace(printf('%07d.pt', p_partkey), '.pt', '') || '-size-256-vae-ema-cfg-'
    || CAST(1.0 + p_size / 10.0 AS VARCHAR) || '-seed-' || CAST(p_partkey AS VARCHAR) || '-sde-0.85-1.5' AS folder,
  'eval/250' || printf('%07d.pt', p_partkey) || CAST(1.0 + p_size / 10.0 AS VARCHAR) || '0.851.5'
    || CASE WHEN p_partkey % 2 = 0 THEN 'cfg_cond_true.txt' ELSE 'cfg_cond_false.txt' END AS report
FROM part""",
    "paths_feature_set": f"""SELECT path, regexp_replace(path, '_cls\\.npy$', '_patches.npy') AS sibling FROM (
  SELECT {_art('doc_id', 'img-dinov3-%s_cls.npy')} AS path FROM documents) WHERE ends_with(path, '_cls.npy')""",
    "align_missing_siblings": f"""SELECT {_art('doc_id', 'img-dinov3-%s_cls.npy')} AS cls_path FROM documents
WHERE doc_id % 11 = 0""",
    "align_modalities": f"""WITH {_MODS}
SELECT coalesce(img.pos, lat.pos, tok.pos) AS pos, images_path, latents_path, tokens_path
FROM img FULL OUTER JOIN lat ON img.pos = lat.pos FULL OUTER JOIN tok ON coalesce(img.pos, lat.pos) = tok.pos""",
    "align_by_stem": f"""SELECT printf('%08d', d.doc_id) AS stem, i.path AS images_path,
  CASE WHEN d.doc_id % 13 <> 0 THEN {_art('d.doc_id', 'img-mean-std-%s.npy')} END AS latents_path,
  {_art('d.doc_id', 'img-dinov3-%s_cls.npy')} AS tokens_path
FROM documents d JOIN ({fx.IMAGE_PATHS_SQL}) i ON i.doc_id = d.doc_id""",
    "align_count_parity": """SELECT 'images' AS source, count(*) AS n FROM documents
UNION ALL SELECT 'latents', count(*) FROM documents WHERE doc_id % 13 <> 0
UNION ALL SELECT 'tokens', count(*) FROM documents""",
    "align_stems_missing": "SELECT printf('%08d', doc_id) AS stem FROM documents WHERE doc_id % 13 = 0",
    "align_merge_by_name": """SELECT d.p_partkey AS key, d.p_name AS name, round0(coalesce(s.v, d.p_retailprice), 4) AS value
FROM part d LEFT JOIN (SELECT p_name, p_retailprice * 2 AS v FROM part WHERE p_partkey % 3 = 0) s ON d.p_name = s.p_name""",
    # one pass: a replica's element and that of replica 0 come from the same row
    "align_replica_diff": """WITH r AS (SELECT rk, 'vec_' || CAST(vec_id AS VARCHAR) AS name, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS e,
    CASE WHEN vec_id % 50 = rk AND i - 1 = vec_id % 64 THEN 1.0 ELSE 0.0 END AS d, CASE WHEN vec_id % 50 = 0 AND i - 1 = vec_id % 64 THEN 1.0 ELSE 0.0 END AS d0
  FROM embeddings, range(1, 4) a(rk), range(1, 65) b(i))
SELECT CAST(rk AS INTEGER) AS rank, name, CAST(pos AS INTEGER) AS pos, round0(e + d, 6) AS value, round0(e + d0, 6) AS reference
FROM r WHERE e + d IS DISTINCT FROM e + d0 AND NOT regexp_full_match(name, 'vec_1\\d*')""",
}
