"""Event tables: entry numbers, chains, friends, entry lists, ranges, jagged columns, late columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaChanged


def with_entry(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows 0, 1, … in the given (unique) order, without sorting them in one task.

    Rows are range-partitioned; the numbers of rows per partition, one row each, give the offsets.
    The partitioned rows are checkpointed, so both uses see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__id", 33)
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    numbered = ranged.withColumn("__part", part).join(F.broadcast(table), "__part")  # one row a partition
    row = F.col("__id").bitwiseAND((1 << 33) - 1)
    return numbered.select(*df.columns, (F.col("__before") + row).alias("entry"))


def chain(*parts: DataFrame) -> DataFrame:
    """Tables one after another, with the number of the part. Columns must agree in name and type."""
    first = parts[0]
    for p in parts[1:]:
        if p.dtypes != first.dtypes:
            raise SchemaChanged(f"{p.dtypes} is not {first.dtypes}")
    out = first.withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(k)))
    return out


def friend(main: DataFrame, other: DataFrame, on: str = "entry") -> DataFrame:
    """Columns of another table, row by row, over a stored entry number or key."""
    return main.join(other, on, "inner")


def select_entries(df: DataFrame, entries: DataFrame, on: str = "entry") -> DataFrame:
    """The rows that an entry list names, each once."""
    return df.join(entries.select(on), on, "left_semi")


def entry_range(df: DataFrame, start: int, stop: int, on: str = "entry") -> DataFrame:
    """Rows with start <= entry < stop; a filter that reaches the scan."""
    return df.where((F.col(on) >= start) & (F.col(on) < stop))


def alias(df: DataFrame, **expressions: str) -> DataFrame:
    """Named SQL expressions as further columns."""
    return df.withColumns({name: F.expr(e) for name, e in expressions.items()})


def flat(df: DataFrame, jagged: str, *keys: str) -> DataFrame:
    """One row an element of a jagged column: keys, its index, its value."""
    return df.select(*keys, F.posexplode(jagged).alias("index", "value"))


def zip_members(df: DataFrame, name: str, *members: str) -> DataFrame:
    """Parallel arrays as one array of structs."""
    return df.withColumn(name, F.arrays_zip(*members)).drop(*members)


def map_of(df: DataFrame, name: str, keys: str, values: str) -> DataFrame:
    """Parallel key and value arrays as a map."""
    return df.withColumn(name, F.map_from_arrays(keys, values)).drop(keys, values)


def variant(df: DataFrame, name: str, tag: str, *alternatives: str) -> DataFrame:
    """A tagged union: a struct of the tag (1-based; 0: no value) and the alternatives."""
    values = [F.when(F.col(tag) == k, F.col(a)).alias(a) for k, a in enumerate(alternatives, 1)]
    return df.withColumn(name, F.struct(F.coalesce(tag, F.lit(0)).alias("tag"), *values)).drop(tag, *alternatives)


def default_of(kind: T.DataType) -> Column:
    """What a late column holds in rows written before it: 0, false or empty."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind)


def extend(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older and a newer schema; columns that came late are filled with their default."""
    late = [f for f in new.schema if f.name not in old.columns]
    return old.withColumns({f.name: default_of(f.dataType) for f in late}).unionByName(new)


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]
