"""Helpers for the oracle SQL text."""
from __future__ import annotations


def expand_round0(sql: str) -> str:
    """Rewrite ``round0(x, n)`` as ``(round(x, n) + 0.0)`` so -0.0 folds into 0.0,
    matching the Spark side's rounding helper."""
    out, i, key = [], 0, "round0("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            k += 1
        inner = expand_round0(sql[j + len(key):k - 1])
        out.append(f"(round({inner}) + 0.0)")
        i = k


def _product(a: str, b: str, dim: int) -> str:
    """Matrix product of two lists of rows."""
    columns = f"list_transform(range(1, {dim + 1}), lambda j: list_transform({b}, lambda q: q[j]))"
    return f"list_transform({a}, lambda r: list_transform({columns}, lambda c: list_dot_product(r, c)))"


def frechet_sql(tag: str, dim: int, steps: int = 24) -> str:
    """CTEs (for ``WITH RECURSIVE``) that end in ``fid_<tag>(fid, self_fid)``: the Fréchet
    distance of the first ``dim`` features of odd against even ids.

    ``tr (S1 S2)^1/2`` by the coupled Newton-Schulz iteration on the product
    scaled by its norm; all of it is SQL over lists.
    """
    eye = f"list_transform(range(0, {dim}), lambda i: list_transform(range(0, {dim}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))"
    three = f"list_transform(range(1, {dim + 1}), lambda i: list_transform(range(1, {dim + 1}), lambda j: CASE WHEN i = j THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END - p[i][j]))"
    half = "list_transform({0}, lambda r: list_transform(r, lambda v: v / 2.0))"
    t = tag
    return f"""
e_{t} AS MATERIALIZED (SELECT vec_id AS id, vec_id % 2 AS side, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {dim + 1}) r(i)),
m_{t} AS MATERIALIZED (SELECT side, i, avg(v) AS mu, count(*) AS n FROM e_{t} GROUP BY side, i),
d_{t} AS MATERIALIZED (SELECT id, side, i, v - mu AS v, n FROM e_{t} JOIN m_{t} USING (side, i)),
c_{t} AS MATERIALIZED (SELECT a.side, a.i, b.i AS j, sum(a.v * b.v) / (max(a.n) - 1) AS s FROM d_{t} a JOIN d_{t} b ON a.id = b.id GROUP BY a.side, a.i, b.i),
r_{t} AS (SELECT side, i, list(s ORDER BY j) AS r FROM c_{t} GROUP BY side, i),
s_{t} AS MATERIALIZED (SELECT side, list(r ORDER BY i) AS s FROM r_{t} GROUP BY side),
a_{t} AS MATERIALIZED (SELECT kind, a, sqrt(list_sum(list_transform(a, lambda r: list_sum(list_transform(r, lambda v: v * v))))) AS norm
  FROM (SELECT x.side + y.side AS kind, {_product("x.s", "y.s", dim)} AS a FROM s_{t} x JOIN s_{t} y ON y.side = 0)),
it_{t}(kind, k, norm, y, z) AS (
  SELECT kind, 0, norm, list_transform(a, lambda r: list_transform(r, lambda v: v / norm)), {eye} FROM a_{t}
  UNION ALL
  SELECT kind, k + 1, norm, {half.format(_product("y", "t", dim))}, {half.format(_product("t", "z", dim))}
  FROM (SELECT kind, k, norm, y, z, {three} AS t FROM (SELECT kind, k, norm, y, z, {_product("z", "y", dim)} AS p FROM it_{t} WHERE k < {steps}))),
tr_{t} AS MATERIALIZED (SELECT kind, sqrt(norm) * list_sum(list_transform(range(1, {dim + 1}), lambda i: y[i][i])) AS root FROM it_{t} WHERE k = {steps}),
q_{t} AS (SELECT sum(s) FILTER (WHERE side = 0 AND i = j) AS t0, sum(s) FILTER (WHERE side = 1 AND i = j) AS t1 FROM c_{t}),
g_{t} AS (SELECT sum((a.mu - b.mu) * (a.mu - b.mu)) AS gap FROM m_{t} a JOIN m_{t} b ON a.i = b.i AND a.side = 0 AND b.side = 1),
fid_{t} AS MATERIALIZED (SELECT gap + t0 + t1 - 2.0 * (SELECT root FROM tr_{t} WHERE kind = 1) AS fid, 2.0 * t0 - 2.0 * (SELECT root FROM tr_{t} WHERE kind = 0) AS self_fid
  FROM q_{t}, g_{t})"""


def frechet_by_label_sql(dim: int, steps: int = 40) -> str:
    """Rows ``(label, n_ref, n_sample, fid)``: the distance of the first ``dim`` features of odd against even ids of each label,
    with the root as in :func:`frechet_sql`."""
    eye = f"list_transform(range(0, {dim}), lambda i: list_transform(range(0, {dim}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))"
    three = f"list_transform(range(1, {dim + 1}), lambda i: list_transform(range(1, {dim + 1}), lambda j: CASE WHEN i = j THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END - p[i][j]))"
    half = "list_transform({0}, lambda r: list_transform(r, lambda v: v / 2.0))"
    return f"""WITH RECURSIVE
e AS MATERIALIZED (SELECT label, vec_id AS id, vec_id % 2 AS side, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {dim + 1}) r(i)),
m AS MATERIALIZED (SELECT label, side, i, avg(v) AS mu, count(*) AS n FROM e GROUP BY ALL),
d AS MATERIALIZED (SELECT e.label, id, side, i, v - mu AS v, n FROM e JOIN m USING (label, side, i)),
c AS MATERIALIZED (SELECT a.label, a.side, a.i, b.i AS j, sum(a.v * b.v) / (max(a.n) - 1) AS s FROM d a JOIN d b ON a.id = b.id GROUP BY ALL),
r AS (SELECT label, side, i, list(s ORDER BY j) AS r FROM c GROUP BY ALL),
s AS MATERIALIZED (SELECT label, side, list(r ORDER BY i) AS s FROM r GROUP BY ALL),
a AS MATERIALIZED (SELECT label, a, sqrt(list_sum(list_transform(a, lambda r: list_sum(list_transform(r, lambda v: v * v))))) AS norm
  FROM (SELECT x.label, {_product("x.s", "y.s", dim)} AS a FROM s x JOIN s y ON x.label = y.label AND x.side = 1 AND y.side = 0)),
it(label, k, norm, y, z) AS (
  SELECT label, 0, norm, list_transform(a, lambda r: list_transform(r, lambda v: v / norm)), {eye} FROM a
  UNION ALL
  SELECT label, k + 1, norm, {half.format(_product("y", "t", dim))}, {half.format(_product("t", "z", dim))}
  FROM (SELECT label, k, norm, y, z, {three} AS t FROM (SELECT label, k, norm, y, z, {_product("z", "y", dim)} AS p FROM it WHERE k < {steps}))),
q AS (SELECT label, sum(s) FILTER (WHERE i = j) AS traces FROM c GROUP BY label),
g AS (SELECT a.label, max(a.n) AS n_ref, max(b.n) AS n_sample, sum((a.mu - b.mu) * (a.mu - b.mu)) AS gap
      FROM m a JOIN m b ON a.label = b.label AND a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY a.label)
SELECT label, n_ref, n_sample,
  round0(gap + traces - 2.0 * sqrt(norm) * list_sum(list_transform(range(1, {dim + 1}), lambda i: y[i][i])), 5) AS fid
FROM it JOIN q USING (label) JOIN g USING (label) WHERE k = {steps}"""


def resample_sql(name: str, n_in: int, n_out: int, kind: str) -> str:
    """CTE ``name(o, i, w)``: the weights of a 1-D resize, from the kernels' definitions."""
    support = {"lanczos": 3.0, "bicubic": 2.0}[kind]
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    sinc = "(CASE WHEN {0} = 0 THEN 1.0 ELSE sin(pi() * ({0})) / (pi() * ({0})) END)"
    kernel = {"lanczos": f"CASE WHEN abs(x) < 3 THEN {sinc.format('x')} * {sinc.format('(x / 3.0)')} ELSE 0 END",
              "bicubic": "CASE WHEN abs(x) < 1 THEN (1.5 * abs(x) - 2.5) * x * x + 1 "
                         "WHEN abs(x) < 2 THEN -0.5 * (((abs(x) - 5) * abs(x) + 8) * abs(x) - 4) ELSE 0 END"}[kind]
    center = f"((o + 0.5::DOUBLE) * {scale!r}::DOUBLE)"
    reach = repr(support * stretch)
    return f"""{name} AS (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {kernel} AS k FROM (
  SELECT o, i, (i - {center} + 0.5) / {stretch!r}::DOUBLE AS x FROM range(0, {n_out}) a(o), range(0, {n_in}) b(i)
  WHERE i >= greatest(trunc({center} - {reach} + 0.5), 0) AND i < least(trunc({center} + {reach} + 0.5), {n_in}))))"""
