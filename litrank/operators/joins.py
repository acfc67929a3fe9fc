"""Join strategies for a small side whose size is checked, not assumed.

``join_small`` broadcasts the small side only after measuring its rows and bytes
against a bound. Beyond the bound it falls back to a salted shuffle join, so that one hot
key (a common token, a popular article) is spread over ``salt_buckets`` tasks
instead of landing in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows and bytes a side may hold to be broadcast.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 * 2 ** 20
DEFAULT_SALT_BUCKETS = 32
# Rows that one task of a shuffle join of stored tables sorts. AQE merges shuffle partitions by their
# compressed bytes, and 64 MB of ids are over ten million rows; a number given to ``repartition`` stays.
ROWS_IN_TASK = 500_000


def measured(df: DataFrame, *more: Column) -> tuple:
    """Rows and bytes of ``df``, and ``more`` aggregates: one aggregation whose tasks each send one partial row."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)), *more).first())


def broadcastable(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """May ``df`` be broadcast under these bounds? ``max_rows <= 0`` never broadcasts."""
    if max_rows <= 0:
        return False
    rows, size = measured(df)
    return rows <= max_rows and size <= max_bytes


def tasks_for(rows: int, least: int = 1, rows_in_task: int = ROWS_IN_TASK) -> int:
    """Tasks over which ``rows`` rows are shuffled, so that each sorts ``rows_in_task`` of them."""
    return max(least, -(-int(rows) // rows_in_task))


def join_stored(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, rows_in_task: int = ROWS_IN_TASK) -> DataFrame:
    """Join of two tables that are cheap to count: ``small`` is broadcast within the bounds of
    ``broadcastable``, else both sides move to as many tasks as their rows need."""
    on = list(on)
    rows, size = measured(small)
    if rows <= max_rows and size <= MAX_BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    tasks = tasks_for(big.count() + rows, rows_in_task=rows_in_task)
    return big.repartition(tasks, *on).join(small.repartition(tasks, *on).hint("merge"), on, how)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                salt_buckets: int = DEFAULT_SALT_BUCKETS,
                salt_from: Sequence[str] | None = None) -> DataFrame:
    """Shuffle join with the big side salted and the small side replicated.

    ``salt_from`` are big-side columns that spread the rows of one key; by
    default a random-free hash of all big-side columns, so that a retried task
    computes the same salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted join does not support {how!r}")
    cols = list(salt_from) if salt_from else big.columns
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salt_buckets)))
    replicated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return salted_big.join(replicated, list(on) + ["_salt"], how).drop("_salt")


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               salt_buckets: int = DEFAULT_SALT_BUCKETS,
               salt_from: Sequence[str] | None = None) -> DataFrame:
    """Broadcast ``small`` if its row count is within ``max_rows``, else salt."""
    if broadcastable(small, max_rows):
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how, salt_buckets, salt_from)


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, check: bool = True) -> DataFrame:
    """Join a lookup side with unique keys (a catalog, a per-query table).

    ``check=True`` (inputs that are cheap to count, e.g. a catalog scan):
    broadcast after counting it against ``max_rows``, else a shuffle join.
    ``check=False`` (derived aggregates, which a count would compute twice):
    a plain join; AQE measures the finished shuffle stage and broadcasts only
    if it is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``, else it
    keeps the sort-merge join. No salt: the small side has unique keys and
    the big side is already aggregated.
    """
    on = [on] if isinstance(on, (str, Column)) else list(on)
    if check and broadcastable(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
