"""Data-quality checks for the constraints Spark does not enforce (DQ-1..3).

Each check is one distributed pass: null counts in a single aggregate, key
duplicates through a partially aggregated ``groupBy(keys).count()``, and
references through a left-anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitewatt.operators.joins import checked_broadcast
from sitewatt.schemas import FOREIGN_KEYS, PRIMARY_KEYS


def check_not_null(df: DataFrame, cols=None) -> DataFrame:
    """One row: ``rows`` and the number of nulls per column (``<col>_nulls``)."""
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def check_unique(df: DataFrame, keys) -> DataFrame:
    """Keys occurring more than once, with their multiplicity ``copies``."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def check_fk(child: DataFrame, parent: DataFrame, child_cols, parent_cols=None) -> DataFrame:
    """Child rows whose reference has no parent row (null references excluded,
    as SQL foreign keys allow them).

    One anti join against the distinct parent keys: the child is read once, and
    Spark broadcasts the key side by its size or splits a skewed join."""
    child_cols = list(child_cols)
    parent_cols = list(parent_cols or child_cols)
    c = child
    for cc in child_cols:
        c = c.where(F.col(cc).isNotNull())
    p = parent.select(*[F.col(pc).alias(cc) for pc, cc in zip(parent_cols, child_cols)]).distinct()
    return c.join(p, child_cols, "left_anti")


def write_checked(rows: DataFrame, path: str, keys, order, parent: DataFrame | None = None, parent_key: str | None = None,
                  required=None, partition_by=()) -> dict:
    """Write facts and check them in the same pass (DQ-1..3 in flight); returns the counts.

    The first row of each key by ``order`` is written under ``<path>/valid=true``, or under ``valid=false``
    where a required value is missing or the reference has no parent: bad rows are kept aside for
    repair instead of failing the load. The counts come from ``Observation`` on the written rows: no
    scan of their own. ``<col>_nulls`` count written rows, ``copies`` rows left out as repeats,
    ``repeated_keys`` keys that had any, ``orphans`` rows whose non-null reference has no parent.
    """
    keys, required = list(keys), list(required or rows.columns)
    rest = [c for c in rows.columns if c not in keys]
    one = (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"), F.count(F.lit(1)).alias("_copies"))
           .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "_copies"))
    orphan = F.lit(False)
    if parent is not None:
        known = parent.select(F.col(parent_key).alias("_parent")).distinct()
        one = one.join(checked_broadcast(known), F.col(parent_key) == F.col("_parent"), "left")
        orphan = F.col("_parent").isNull() & F.col(parent_key).isNotNull()
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    one = one.withColumns({"_orphan": orphan, "valid": ~(missing | orphan)})
    seen = Observation()
    one = one.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum("_copies").alias("samples"),
                      *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in required],
                      F.sum(F.col("_copies") - 1).alias("copies"), F.count_if(F.col("_copies") > 1).alias("repeated_keys"),
                      F.count_if("_orphan").alias("orphans"), F.count_if("valid").alias("valid_rows"))
    one.select(*rows.columns, "valid").write.partitionBy("valid", *partition_by).parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}  # sums over no rows are null


def check_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All declared key and reference checks over the tables present."""
    out = {}
    for name, keys in PRIMARY_KEYS.items():
        if name in tables:
            out[f"unique:{name}"] = check_unique(tables[name], keys)
    for child, ccols, parent, pcols in FOREIGN_KEYS:
        if child in tables and parent in tables:
            out[f"fk:{child}->{parent}"] = check_fk(tables[child], tables[parent], ccols, pcols)
    return out
