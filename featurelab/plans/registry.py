"""All registered queries (name -> (spark, sf_dir) -> DataFrame) and their DuckDB oracles."""
from __future__ import annotations

import functools

from ..session import ensure_checkpoint_dir, ship_package
from . import q_evaluate, q_io, q_metrics, q_prep, q_train
from .sqltext import expand_round0


def _prepared(fn):
    """Every query first makes the package importable in the workers and the
    checkpoint folder known (the caller's session may have neither)."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES: dict = {}
ORACLES: dict = {}
for _mod in (q_evaluate, q_metrics, q_prep, q_train, q_io):
    QUERIES.update({k: _prepared(v) for k, v in _mod.QUERIES.items()})
    ORACLES.update({k: expand_round0(v) for k, v in _mod.ORACLES.items()})
