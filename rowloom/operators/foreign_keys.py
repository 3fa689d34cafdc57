"""Foreign keys onto parents that already exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.indexing import dense_index
from rowloom.plans.joins import filled

#: Parents up to which their positions, one narrow row each, are found by one task and broadcast.
BROADCAST_ROWS = 200_000


def assign_foreign_key(
    child: DataFrame, index: str, fk_column: str | Sequence[str], parent: DataFrame, parent_key: str | Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Give child row ``i`` the key of parent ``i % n``, parents taken in key order.

    A key may have several columns: all of them come from the same parent row, and parents whose key holds a null are left out. Few
    parents are sorted and numbered in one small array and broadcast. Many parents get a dense position by a range-partitioned
    sort and are joined by shuffle, where every position holds at most ``rows / n`` children, so no key is hot. Without parents
    the child stays as it is.
    """
    columns = [fk_column] if isinstance(fk_column, str) else list(fk_column)
    keys = [parent_key] if isinstance(parent_key, str) else list(parent_key)
    if len(columns) != len(keys):
        raise ValueError("a foreign key has as many columns as the key it refers to")
    named = [f"_key{i}" for i in range(len(keys))]
    whole = parent.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).filter(filled(named))
    parents = whole.count()
    if parents == 0:
        return child
    if parents <= broadcast_rows:
        listed = whole.agg(F.array_sort(F.collect_list(F.struct(*named))).alias("all"))
        placed_keys = F.broadcast(listed.select(F.posexplode("all").alias("_position", "k")).select("_position", "k.*"))
    else:
        placed_keys = dense_index(whole, named, "_position")
    placed = child.withColumn("_position", F.pmod(F.col(index), F.lit(parents).cast("bigint")))
    placed = placed.drop(*[c for c in columns if c in placed.columns])
    joined = placed.join(placed_keys, "_position", "left").drop("_position")
    return joined.withColumnsRenamed(dict(zip(named, columns, strict=True)))
