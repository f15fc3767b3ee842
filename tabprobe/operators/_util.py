"""Small shared helpers for operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.sources.io import col

# Row bound under which a side table is broadcast; larger tables are joined
# with a shuffle (AQE may still pick broadcast at runtime).
BROADCAST_ROWS = 500_000


def persist(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by ``spark.checkpoint.dir``."""
    from tabprobe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, n_rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a row-count check (``df`` should be cheap to count,
    e.g. checkpointed)."""
    n = df.count() if n_rows is None else n_rows
    return F.broadcast(df) if n <= limit else df


def numeric_frame(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The group keys and the columns as doubles, under the missing-value rules of every profile operator:
    NaN is NULL, and rows with a NULL group key belong to no group."""
    for b in by:
        df = df.filter(col(b).isNotNull())
    return df.select(*[col(b) for b in by],
                     *[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])


def numeric_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """:func:`numeric_frame` unpivoted to (``by``…, ``column``, ``value``)."""
    return numeric_frame(df, columns, by).unpivot([col(b) for b in by], [col(c) for c in columns], "column", value)


def stored_frame(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """:func:`numeric_frame` stored once in the shared folder, for operators that pass over the values several times: what is
    behind ``df`` (joins, parsing) runs once, not in every pass."""
    from tabprobe.session import staged
    frame = numeric_frame(df, columns, by)
    return staged(frame.toDF(*[f"c{i}" for i in range(len(frame.columns))]), "numeric").toDF(*frame.columns)
