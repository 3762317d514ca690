"""Image geometry plans and pixel arithmetic as columns.

Plans are integer column arithmetic on ``(w, h)`` so they run inside whole-stage
codegen; the pixel work itself (G5) is in :mod:`featurelab.operators.images`.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Channel statistics used to standardise encoder inputs.
CLIP_MEAN = (0.48145466, 0.4578275, 0.40821073)
CLIP_STD = (0.26862954, 0.26130258, 0.27577711)
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
# Latent scaling of the image autoencoder.
LATENT_SCALE = 0.18215
LATENT_BIAS = 0.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_or_col(x) -> Column:
    if x is None:
        return F.lit(None).cast("int")
    return _c(x) if isinstance(x, (str, Column)) else F.lit(int(x))


def idiv(a: Column, b) -> Column:
    """Floor division of integers."""
    return F.floor(a / (b if isinstance(b, Column) else F.lit(b))).cast("int")


def plan_scale(w, h, W=None, H=None) -> Column:
    """G1: target size; a missing target dimension keeps the source one."""
    w, h = _c(w), _c(h)
    tw, th = F.coalesce(_lit_or_col(W), w), F.coalesce(_lit_or_col(H), h)
    return F.struct(tw.alias("out_w"), th.alias("out_h"),
                    (~((tw == w) & (th == h))).alias("resized"))


def plan_center_crop(w, h, W, H) -> Column:
    """Centred square crop of side ``min(w, h)``, then resize to ``W x H``."""
    w, h = _c(w), _c(h)
    c = F.least(w, h)
    return F.struct(c.alias("crop"), idiv(h - c, 2).alias("y0"), idiv(h + c, 2).alias("y1"),
                    idiv(w - c, 2).alias("x0"), idiv(w + c, 2).alias("x1"),
                    F.lit(int(W)).alias("out_w"), F.lit(int(H)).alias("out_h"))


def plan_center_crop_wide(w, h, W, H) -> Column:
    """Crop rows to ``ch = round_half_even(W * h / w)``, resize to ``W x H``, paste into a
    black ``W x W`` canvas at rows ``(W-H) div 2 .. (W+H) div 2``; rejected when
    ``w < W`` or ``ch < H``."""
    w, h = _c(w), _c(h)
    ch = F.bround(F.lit(float(W)) * h / w, 0).cast("int")
    rejected = (w < F.lit(int(W))) | (ch < F.lit(int(H)))
    return F.struct(ch.alias("crop_h"), idiv(h - ch, 2).alias("y0"), idiv(h + ch, 2).alias("y1"),
                    F.lit((W - H) // 2).alias("paste_y0"), F.lit((W + H) // 2).alias("paste_y1"),
                    F.lit(int(W)).alias("canvas"), rejected.alias("rejected"))


def plan_dhariwal(w, h, S: int) -> Column:
    """Halve (floor) while ``min >= 2S``, scale the short side to ``S`` with
    half-even rounding, centre crop ``S x S``.

    The halving count is closed form: ``k = bitlength(min div S) - 1`` (0 when
    ``min < 2S``), so no loop is needed.
    """
    w, h = _c(w), _c(h)
    m = F.least(w, h)
    q = F.floor(m / F.lit(int(S))).cast("bigint")
    k = F.when(q < 1, F.lit(0)).otherwise(F.length(F.bin(q)) - 1)
    hw, hh = F.call_function("shiftright", w, k), F.call_function("shiftright", h, k)
    scale = F.lit(float(S)) / F.least(hw, hh)
    nw = F.bround(hw * scale, 0).cast("int")
    nh = F.bround(hh * scale, 0).cast("int")
    return F.struct(k.cast("int").alias("halvings"), hw.alias("half_w"), hh.alias("half_h"),
                    nw.alias("resize_w"), nh.alias("resize_h"),
                    idiv(nh - F.lit(int(S)), 2).alias("crop_y"), idiv(nw - F.lit(int(S)), 2).alias("crop_x"))


def is_pow2_square(w, h) -> Column:
    w, h = _c(w), _c(h)
    return (w == h) & (w > 0) & (F.bit_count(w) == 1)


def normalize_pixels(pixels) -> Column:
    """``x / 127.5 - 1`` per element."""
    return F.transform(_c(pixels), lambda x: x.cast("double") / 127.5 - 1.0)


def standardize_channels(pixels, family: str = "clip", channels: int = 3) -> Column:
    """G7 (normalise part): ``(x / 255 - mean_c) / std_c`` on interleaved channels
    (element i has channel ``i mod channels``)."""
    mean, std = (CLIP_MEAN, CLIP_STD) if "clip" in family else (IMAGENET_MEAN, IMAGENET_STD)
    mean_a = F.array(*[F.lit(v) for v in mean])
    std_a = F.array(*[F.lit(v) for v in std])
    return F.transform(_c(pixels), lambda x, i: (x.cast("double") / 255.0
                                                 - F.element_at(mean_a, F.pmod(i, F.lit(channels)) + 1))
                       / F.element_at(std_a, F.pmod(i, F.lit(channels)) + 1))


def resize_target(resolution: int) -> int:
    """G7 resize rule: ``224 * (resolution div 256)``."""
    return 224 * (int(resolution) // 256)


def dequantize_latents(latents, scale: float = LATENT_SCALE, bias: float = LATENT_BIAS) -> Column:
    """G8 first half: ``(x - bias) / scale``."""
    return F.transform(_c(latents), lambda x: (x.cast("double") - F.lit(bias)) / F.lit(scale))


def quantize_pixels(x, mode: str = "truncate") -> Column:
    """Decoder output in [-1, 1] to uint8 values.

    ``truncate`` (bulk samples): ``int(clamp(255 * (x + 1) / 2, 0, 255))``;
    ``round`` (preview grid): ``int(clamp((x + 1) / 2, 0, 1) * 255 + 0.5)`` clamped to 255.
    """
    def one(v):
        u = (v.cast("double") + 1.0) / 2.0
        if mode == "truncate":
            return F.floor(F.least(F.greatest(u * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int")
        return F.floor(F.least(F.greatest(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5,
                                          F.lit(0.0)), F.lit(255.0))).cast("int")
    return F.transform(_c(x), one)


def tile_layout(i, n) -> Column:
    """Image ``i`` of ``n`` goes to row ``i div c``, column ``i mod c`` with
    ``c = round(sqrt(n))`` columns (a square sheet)."""
    cols = F.bround(F.sqrt(_c(n).cast("double")), 0).cast("bigint")
    return F.struct(cols.alias("n_cols"), F.floor(_c(i) / cols).cast("bigint").alias("row"),
                    F.pmod(_c(i), cols).alias("col"))
