"""Joins of documents with short tables of ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.sources.scratch import materialize

# Rows of ids and positions that may be sent to every task: some tens of MB.
MOST_SENT = 1_000_000


def checked_side(rows: DataFrame, name: str, size: str = "1") -> DataFrame:
    """``rows``, stored, and marked for broadcast only if ``size`` adds up to MOST_SENT at most.

    Texts then stay where they are; a larger table is joined by a shuffle. ``size`` is an SQL
    expression of what a row counts for.
    """
    stored = materialize(rows, name)
    total = stored.selectExpr(f"coalesce(sum(CAST({size} AS BIGINT)), 0) AS n").first()["n"]
    return F.broadcast(stored) if total <= MOST_SENT else stored


def names_apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` for tables that have columns of its own working names, which begin with "__".

    Such columns are renamed while it runs and have their names again afterwards.
    """
    @wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        hidden = [c for c in docs.columns if c.startswith("__")]
        if not hidden:
            return operator(docs, *args, **named)
        prefix = "kept"
        while any(c.startswith(prefix) for c in docs.columns):
            prefix += "_"
        names = {c: prefix + c for c in hidden}

        def new(value):
            return names.get(value, value) if isinstance(value, str) else value

        out = operator(docs.withColumnsRenamed(names), *map(new, args),
                       **{k: new(v) for k, v in named.items()})
        return out.withColumnsRenamed({n: c for c, n in names.items()})

    return run
