"""Vector arithmetic on array columns.

Everything computes in double with higher-order functions (``transform``,
``zip_with``, ``aggregate``) so it stays in the JVM; ``array<float>`` inputs are
widened first.  Per-row vectors of a few thousand elements are fine this way;
for much wider rows use the numpy block forms in :mod:`featurelab.operators`.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rng

L2_EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return _c(x).cast("array<double>")


def _num(x) -> Column:
    return _c(x) if isinstance(x, (str, Column)) else F.lit(float(x))


def vsum(x) -> Column:
    return F.aggregate(dbl(x), F.lit(0.0), lambda a, v: a + v)


def sum_flat(x) -> Column:
    """V1: sum over all elements of the row."""
    return vsum(x)


def mean_flat(x) -> Column:
    """V1: mean over all elements of the row."""
    return vsum(x) / F.size(_c(x))


def dot(u, v) -> Column:
    return F.aggregate(F.zip_with(dbl(u), dbl(v), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def add(u, v) -> Column:
    return F.zip_with(dbl(u), dbl(v), lambda a, b: a + b)


def sub(u, v) -> Column:
    return F.zip_with(dbl(u), dbl(v), lambda a, b: a - b)


def scale(u, s) -> Column:
    s = _num(s)
    return F.transform(dbl(u), lambda a: a * s)


def axpby(a, x, b, y) -> Column:
    """``a * x + b * y`` elementwise (``a``, ``b`` scalars or columns)."""
    a, b = _num(a), _num(b)
    return F.zip_with(dbl(x), dbl(y), lambda p, q: a * p + b * q)


def pack_moments(mean, std) -> Column:
    """V2: concatenate mean and std on the channel axis (row-major flattening)."""
    return F.concat(dbl(mean), dbl(std))


def split_moments(m) -> tuple[Column, Column]:
    """V2: halves of a packed moments array."""
    half = (F.size(_c(m)) / 2).cast("int")
    return F.slice(dbl(m), 1, half), F.slice(dbl(m), half + 1, half)


def sample_posterior(mean, std, seed, key, latent_scale: float = 1.0, latent_bias: float = 0.0) -> Column:
    """V3: ``(mean + std * eps) * scale + bias`` with keyed normal noise."""
    eps = rng.normal_vector(seed, _c(key), F.size(_c(mean)))
    z = F.zip_with(F.zip_with(dbl(mean), dbl(std), lambda m, s: F.struct(m.alias("m"), s.alias("s"))), eps,
                   lambda ms, e: (ms["m"] + ms["s"] * e) * F.lit(float(latent_scale)) + F.lit(float(latent_bias)))
    return z


def split_hidden_tokens(tokens, registers: int = 4) -> tuple[Column, Column]:
    """V4: ``cls = h[0]``; register tokens dropped; ``patches = h[1 + R:]``."""
    t = _c(tokens)
    return F.element_at(t, 1), F.slice(t, 2 + int(registers), F.size(t))


def prepend_cls(cls, patches) -> Column:
    """V5: ``[cls] ++ patches``."""
    return F.concat(F.array(_c(cls)), _c(patches))


def to_storage_precision(x) -> Column:
    """V6: single precision on write (Spark has no half type; documented widening)."""
    return _c(x).cast("array<float>")


def l2_normalize(x, eps: float = L2_EPS) -> Column:
    """V7: ``x / max(||x||, eps)``."""
    d = dbl(x)
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v))
    den = F.greatest(n, F.lit(eps))
    return F.transform(d, lambda v: v / den)


def interpolant(t, path: str = "linear") -> Column:
    """``struct(alpha, sigma, d_alpha, d_sigma)`` of the path at ``t``."""
    t = _num(t)
    if path == "linear":
        return F.struct((1 - t).alias("alpha"), t.alias("sigma"), F.lit(-1.0).alias("d_alpha"),
                        F.lit(1.0).alias("d_sigma"))
    if path == "cosine":
        a = t * (math.pi / 2)
        return F.struct(F.cos(a).alias("alpha"), F.sin(a).alias("sigma"),
                        (F.lit(-math.pi / 2) * F.sin(a)).alias("d_alpha"),
                        (F.lit(math.pi / 2) * F.cos(a)).alias("d_sigma"))
    raise NotImplementedError(f"path type {path!r}")


def noisy_pair(x, eps, t, path: str = "linear") -> Column:
    """``struct(input = a x + s eps, target = a' x + s' eps)``."""
    it = interpolant(t, path)
    return F.struct(axpby(it["alpha"], x, it["sigma"], eps).alias("input"),
                    axpby(it["d_alpha"], x, it["d_sigma"], eps).alias("target"))


def denoise_loss(pred, target) -> Column:
    """Per-row mean squared error."""
    d = F.zip_with(dbl(pred), dbl(target), lambda a, b: (a - b) * (a - b))
    return F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(_c(pred))


def alignment_loss(z, z_pred, eps: float = L2_EPS) -> Column:
    """V13 per row: mean over tokens of ``-cos(z_tok, zp_tok)`` (both normalised)."""
    cos = F.zip_with(_c(z), _c(z_pred), lambda a, b: dot(l2_normalize(a, eps), l2_normalize(b, eps)))
    return -F.aggregate(cos, F.lit(0.0), lambda acc, v: acc + v) / F.size(_c(z))


def alignment_loss_batch(pairs: list[tuple]) -> Column:
    """V13 batch value (an aggregate): the per-row losses of every encoder summed
    over rows and encoders, divided by ``encoders * rows``."""
    per_row = None
    for z, zp in pairs:
        l_ = alignment_loss(z, zp)
        per_row = l_ if per_row is None else per_row + l_
    return F.sum(per_row) / (F.lit(len(pairs)) * F.count(F.lit(1)))


def total_loss(l_img, l_proj, l_cls, proj_coeff: float = 0.5, cls_coeff: float = 0.03) -> Column:
    """V14 (an aggregate): ``mean(l_img) + mean(l_proj) * proj_coeff + mean(l_cls) * cls_coeff``."""
    return (F.avg(_c(l_img)) + F.avg(_c(l_proj)) * F.lit(float(proj_coeff))
            + F.avg(_c(l_cls)) * F.lit(float(cls_coeff)))


def score_from_velocity(v, x, t, path: str = "linear") -> Column:
    """``r = a / a'``, ``var = s^2 - r s' s``, ``score = (r v - x) / var``.

    Division by zero (``t = 0``) gives NULL elements (``try_divide``).
    """
    it = interpolant(t, path)
    r = it["alpha"] / it["d_alpha"]
    var = it["sigma"] * it["sigma"] - r * it["d_sigma"] * it["sigma"]
    return F.zip_with(dbl(v), dbl(x), lambda a, b: F.try_divide(r * a - b, var))


def guidance_blend(cond, uncond, w, cond_only_if_nonpositive: bool = False) -> Column:
    """``u + w (c - u)``; the class branch uses ``w <= 0`` as "cond only"."""
    w = _num(w)
    blended = F.zip_with(dbl(cond), dbl(uncond), lambda c, u: u + w * (c - u))
    if cond_only_if_nonpositive:
        return F.when(w <= 0, dbl(cond)).otherwise(blended)
    return blended


def drift(v, x, t, path: str = "linear") -> Column:
    """``d = v - 0.5 * (2 t) * score``."""
    s = score_from_velocity(v, x, t, path)
    tt = _num(t)
    return F.zip_with(dbl(v), s, lambda a, b: a - 0.5 * (2 * tt) * b)


def sde_step(x, d, t, t_next, eps, last: bool | Column = False) -> Column:
    """``x + d dt + sqrt(2t) eps sqrt(|dt|)``; the last step adds no noise."""
    t, tn = _num(t), _num(t_next)
    dt = tn - t
    noisy = F.zip_with(F.zip_with(dbl(x), dbl(d), lambda a, b: a + b * dt), dbl(eps),
                       lambda a, e: a + F.sqrt(2 * t) * e * F.sqrt(F.abs(dt)))
    mean = F.zip_with(dbl(x), dbl(d), lambda a, b: a + dt * b)
    lst = last if isinstance(last, Column) else F.lit(bool(last))
    return F.when(lst, mean).otherwise(noisy)


def guidance_active(t, scale, lo, hi) -> Column:
    """``scale > 1 and lo <= t <= hi``."""
    t = _num(t)
    return (_num(scale) > 1) & (t >= _num(lo)) & (t <= _num(hi))


def timestep_features(t, dim: int, max_period: float = 10000.0) -> Column:
    """``[cos(t f), sin(t f)]`` with ``f_i = exp(-ln(P) i / half)``, one 0 appended if odd."""
    half = dim // 2
    t = _num(t)
    freq = lambda i: F.exp(F.lit(-math.log(max_period)) * i / F.lit(float(half)))
    idx = F.sequence(F.lit(0), F.lit(half - 1))
    out = F.concat(F.transform(idx, lambda i: F.cos(t * freq(i))), F.transform(idx, lambda i: F.sin(t * freq(i))))
    if dim % 2:
        out = F.concat(out, F.array(F.lit(0.0)))
    return out


def grid_position_features(pos, dim: int, grid: int, extra: int = 0) -> Column:
    """2-D sin-cos features of token ``pos``: the first ``extra`` tokens (class /
    register tokens) get zeros, token ``extra + i`` gets grid cell ``i`` (row-major
    over (h, w)).

    The first half encodes the column (w) coordinate, the second half the row;
    each half is ``[sin(p w_k), cos(p w_k)]`` with ``w_k = 10000^(-k / (dim/4))``.
    """
    if extra:
        return F.when(_c(pos) < F.lit(int(extra)), F.array_repeat(F.lit(0.0), int(dim))).otherwise(
            grid_position_features(_c(pos) - F.lit(int(extra)), dim, grid, 0))
    p = _c(pos)
    quarter = dim // 4
    col = F.pmod(p, F.lit(grid)).cast("double")
    row = F.floor(p / F.lit(grid)).cast("double")
    ks = F.sequence(F.lit(0), F.lit(quarter - 1))
    omega = lambda k: F.lit(1.0) / F.pow(F.lit(10000.0), k / F.lit(float(quarter)))

    def one(coord):
        return F.concat(F.transform(ks, lambda k: F.sin(coord * omega(k))),
                        F.transform(ks, lambda k: F.cos(coord * omega(k))))
    return F.concat(one(col), one(row))


def unpatchify(tokens, p: int, c: int) -> Column:
    """``[T, p*p*c]`` tokens to a flattened ``[c, h*p, w*p]`` image, ``h = w = sqrt(T)``;
    element order inside a token is (p, q, c).  Non-square token counts raise."""
    t = _c(tokens)
    n_tok = F.size(t)
    h = F.floor(F.sqrt(n_tok.cast("double"))).cast("int")
    side = h * F.lit(p)
    checked = F.when(h * h == n_tok, side).otherwise(
        F.raise_error(F.lit("unpatchify: token count is not a square")).cast("int"))

    def at(o):
        ch = F.floor(o / (side * side)).cast("int")
        rem = F.pmod(o, side * side)
        y = F.floor(rem / side).cast("int")
        x = F.pmod(rem, side)
        tok = F.floor(y / F.lit(p)).cast("int") * h + F.floor(x / F.lit(p)).cast("int")
        el = (F.pmod(y, F.lit(p)) * F.lit(p) + F.pmod(x, F.lit(p))) * F.lit(c) + ch
        return F.element_at(F.element_at(t, tok + 1), el + 1).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(c) * checked * checked - 1), at)


def shape_matches(shape, reference: list) -> Column:
    """Equal rank, and every dimension that ``reference`` does not leave open (None) equal."""
    shape = F.col(shape) if isinstance(shape, str) else shape
    fits = [F.get(shape, F.lit(i)) == F.lit(int(r)) for i, r in enumerate(reference) if r is not None]
    ok = F.size(shape) == F.lit(len(reference))
    for f in fits:
        ok = ok & F.coalesce(f, F.lit(False))
    return ok
