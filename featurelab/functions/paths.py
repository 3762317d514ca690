"""P1, P6, P7, F1-F9, K4 helpers: path, naming and formatting columns."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Image file extensions recognised by the image library's registry (lower case,
# without the dot).  Fixed values.
IMAGE_EXTENSIONS = (
    "apng", "blp", "bmp", "bufr", "bw", "cur", "dcx", "dds", "dib", "emf", "eps", "fit", "fits",
    "flc", "fli", "ftc", "ftu", "gbr", "gif", "grib", "h5", "hdf", "icb", "icns", "ico", "iim",
    "im", "j2c", "j2k", "jfif", "jp2", "jpc", "jpe", "jpeg", "jpf", "jpg", "jpx", "mpeg", "mpg",
    "mpo", "msp", "palm", "pbm", "pcd", "pcx", "pdf", "pfm", "pgm", "png", "pnm", "ppm", "ps",
    "psd", "pxr", "qoi", "ras", "rgb", "rgba", "sgi", "tga", "tif", "tiff", "vda", "vst", "webp",
    "wmf", "xbm", "xpm",
)
# Artifact file name patterns (fixed values): image, latent moments, token files.
ARTIFACT_FORMATS = {
    "image": "img%s.png",
    "latents": "img-mean-std-%s.npy",
    "cls": "img-dinov3-%s_cls.npy",
    "patches": "img-dinov3-%s_patches.npy",
}
# URL schemes that support relative resolution in the standard URL parser (fixed values).
RELATIVE_SCHEMES = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
                    "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
CHECKPOINT_PATTERN = r"training-state-(\d+).pt"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_ext(path) -> Column:
    """Text after the last ``.`` (the whole name if there is none)."""
    return F.element_at(F.split(_c(path), r"\."), -1)


def is_image_path(path, extensions=IMAGE_EXTENSIONS) -> Column:
    """Lower-cased extension is a known image extension."""
    return F.lower(file_ext(path)).isin(list(extensions))


def supported_extensions(extra=()) -> list[str]:
    """Built-in image extensions plus extras, de-duplicated (``.npy`` stubs)."""
    return sorted(set(IMAGE_EXTENSIONS) | {e.lstrip(".").lower() for e in extra})


def index_string(idx) -> Column:
    return F.format_string("%08d", _c(idx))


def artifact_path(idx, kind: str = "image") -> Column:
    """``<first 5 digits>/<name>`` with the 8-digit zero-padded index."""
    s = index_string(idx)
    name = F.format_string(ARTIFACT_FORMATS[kind], s)
    return F.concat(F.substring(s, 1, 5), F.lit("/"), name)


def round_robin(idx, n: int) -> Column:
    """Shard of an index."""
    return F.pmod(_c(idx), F.lit(int(n)))


def relative_path(path, root: str) -> Column:
    """path relative to ``root`` with ``\\`` turned into ``/``."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    r = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(r), F.substring(p, len(r) + 1, 1 << 30)).otherwise(p)


def top_dir(path) -> Column:
    """first path component, ``''`` for files at the root."""
    p = _c(path)
    return F.when(p.contains("/"), F.split_part(p, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parse_size(s) -> Column:
    """``'WxH'`` or ``'W,H'`` to ``struct<w int, h int>``; NULL when it does not parse."""
    pat = r"^(\d+)[x,](\d+)$"
    ok = _c(s).rlike(pat)
    return F.when(ok, F.struct(F.regexp_extract(_c(s), pat, 1).try_cast("int").alias("w"),
                               F.regexp_extract(_c(s), pat, 2).try_cast("int").alias("h")))


def checkpoint_name(step) -> Column:
    """zero-padded to 7 digits plus ``.pt``."""
    return F.format_string("%07d.pt", _c(step))


def _pad2(x: Column) -> Column:
    return F.format_string("%02d", x)


def format_duration(seconds, brief: bool = False) -> Column:
    """Round half to even, then ``Ns``, ``Nm NNs``, ``Nh NNm NNs`` or
    ``Nd NNh NNm`` (brief: at most two units)."""
    s = F.bround(_c(seconds).cast("double"), 0).cast("bigint")
    d, h, m, sec = F.floor(s / 86400), F.pmod(F.floor(s / 3600), F.lit(24)), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    hours_total = F.floor(s / 3600)
    minutes_total = F.floor(s / 60)
    if brief:
        hour_form = F.concat(hours_total.cast("string"), F.lit("h "), _pad2(m), F.lit("m"))
        day_form = F.concat(d.cast("string"), F.lit("d "), _pad2(h), F.lit("h"))
    else:
        hour_form = F.concat(hours_total.cast("string"), F.lit("h "), _pad2(m), F.lit("m "), _pad2(sec), F.lit("s"))
        day_form = F.concat(d.cast("string"), F.lit("d "), _pad2(h), F.lit("h "), _pad2(m), F.lit("m"))
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .when(s < 3600, F.concat(minutes_total.cast("string"), F.lit("m "), _pad2(sec), F.lit("s")))
            .when(s < 86400, hour_form)
            .otherwise(day_form))


def is_valid_url(url, allow_file_urls: bool = False) -> Column:
    """has ``://``, a scheme and a host containing a dot; the scheme must also
    resolve relative references (the root URL check).  Malformed is false."""
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    netloc = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    ok = (u.contains("://") & (scheme != "") & (netloc != "") & netloc.contains(".")
          & scheme.isin(list(RELATIVE_SCHEMES)))
    if allow_file_urls:
        ok = ok | u.startswith("file://")
    return F.coalesce(ok, F.lit(False))


def cache_key(url) -> Column:
    """F8: ``md5(url) + '_' + first 128 chars of the url made file-name safe``."""
    u = _c(url)
    safe = F.regexp_replace(u, r"[^0-9a-zA-Z\-._]", "_")
    return F.concat(F.md5(u), F.lit("_"), F.substring(safe, 1, 128))


def run_name(model, ckpt, resolution, vae, cfg, seed, mode, guidance_high, cls_cfg) -> Column:
    """generation folder name from run settings."""
    ck = F.coalesce(F.regexp_replace(_c(ckpt), r"\.pt", ""), F.lit("pretrained"))
    return F.concat(F.regexp_replace(_c(model), "/", "-"), F.lit("-"), ck, F.lit("-size-"), _c(resolution).cast("string"),
                    F.lit("-vae-"), _c(vae), F.lit("-cfg-"), _c(cfg).cast("string"), F.lit("-seed-"),
                    _c(seed).cast("string"), F.lit("-"), _c(mode), F.lit("-"), _c(guidance_high).cast("string"),
                    F.lit("-"), _c(cls_cfg).cast("string"))


def report_name(save_path, num_steps, step, cfg, gh, cls_cfg, cfg_cond: bool | Column) -> Column:
    """evaluation report file name, concatenated with no separators."""
    cond = _c(cfg_cond) if isinstance(cfg_cond, (str, Column)) else F.lit(bool(cfg_cond))
    suffix = F.when(cond, F.lit("cfg_cond_true.txt")).otherwise(F.lit("cfg_cond_false.txt"))
    return F.concat(_c(save_path), *[_c(x).cast("string") for x in (num_steps, step, cfg, gh, cls_cfg)], suffix)


def fnmatch_regex(pattern: str) -> str:
    """Shell glob to an anchored Java regex (``*``, ``?``, ``[...]``)."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = pattern.find("]", i + 1)
            if j < 0:
                out.append(r"\[")
            else:
                body = pattern[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def latest_checkpoint(files, file_col: str = "file", pattern: str = CHECKPOINT_PATTERN):
    """K4: the checkpoint file of the largest number among those whose whole name
    fits ``pattern`` (its first group is the number): one row ``(latest, step,
    n_matching)``, nulls and 0 when none fits."""
    whole = f"^(?:{pattern})$"
    fits = files.where(F.col(file_col).rlike(whole)).select(
        F.col(file_col).alias("f"), F.regexp_extract(file_col, whole, 1).cast("double").alias("n"))
    return fits.agg(F.max_by("f", "n").alias("latest"), F.max("n").cast("bigint").alias("step"), F.count(F.lit(1)).alias("n_matching"))
