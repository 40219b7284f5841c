"""Joins, set operations and row layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settled

#: Rows that one task sorts, where their number is counted first.
TASK_ROWS = 1 << 19


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks among which df is dealt so that each has some `rows` rows, however many there are; no fewer than the session's. Counts df."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def pending(samples: DataFrame, completed: DataFrame, key: list[str], expected: int = 1) -> DataFrame:
    """Samples whose key isn't completed `expected` times."""
    done = completed.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= expected)
    return samples.join(done, key, "left_anti")


def jobs(sources: DataFrame, repeats: int, completed: DataFrame, key: list[str]) -> DataFrame:
    """Each source `repeats` times (repeat), less what is completed."""
    rows = sources.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    return rows.join(completed, [*key, "repeat"], "left_anti")


def first_source_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which a key's row comes from the first part that has it."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    row = F.struct(*[c for c in out.columns if c not in key])
    best = out.groupBy(*key).agg(F.min_by(row, "_part").alias("_r"))
    return best.select(*key, "_r.*").drop("_part")


def last_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select(*key, "_r.*")


def zipped(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Columns of both tables; columns that both have must be equal, or the job fails."""
    shared = [c for c in b.columns if c in a.columns and c not in key]
    right = b.select(*key, *[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in b.columns if c not in key])
    rows = a.join(right, key)
    for c in shared:
        rows = rows.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return rows.drop(*(f"_r_{c}" for c in shared))


def branch_pairs(rows: DataFrame, key: list[str], branch: str, names: tuple[str, str], hit: str) -> DataFrame:
    """Both branches of each key in one row; a missing branch is a miss."""
    a, b = (F.coalesce(F.max(F.when(F.col(branch) == n, F.col(hit))), F.lit(0)).alias(n) for n in names)
    return rows.groupBy(*key).agg(a, b).withColumn("both", F.least(*names))


def compared(a: DataFrame, b: DataFrame, key: list[str], score: str) -> DataFrame:
    """Wins, losses and ties of two models on the rows that both have."""
    rows = a.select(*key, F.col(score).alias("x")).join(b.select(*key, F.col(score).alias("y")), key)
    x, y = F.col("x"), F.col("y")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(x > y).alias("wins"), F.count_if(x < y).alias("losses"), F.count_if((x == y) & (x > 0)).alias("both_right"),
        F.count_if((x == y) & (x <= 0)).alias("both_wrong"),
    )


def completed_with_errors(expected: DataFrame, actual: DataFrame, key: list[str], status: str, error: str) -> DataFrame:
    """One row for each expected key; where none came, an error."""
    return expected.join(actual, key, "left").withColumn(status, F.coalesce(F.col(status), F.lit(error)))


def interleaved(parts: list[DataFrame], orders: list[list[str]], until: str = "all") -> DataFrame:
    """Rows of the parts in turn (column place); until: "first" part or "all" parts are used up, each row once.

    A part's rows are numbered by range-partitioned order, without moving a part into one task.
    """
    numbered = [with_position(p, o).withColumn("_part", F.lit(i)) for i, (p, o) in enumerate(zip(parts, orders, strict=True))]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    if until == "first":
        out = out.where(F.col("position") < min(p.count() for p in parts))
    return out.withColumn("place", F.struct("position", "_part")).drop("position", "_part")


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Numbers rows from 0 in a global order: range partitions are counted, then numbered side by side.

    The partitions are settled first, since range bounds come from samples that may differ between two runs.
    """
    part, at, first = "__part", "__at", "__first"
    parts = settled(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    parts = parts.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    sizes = parts.groupBy(part).agg(F.max(at).alias("size"))
    before = sizes.select(part, F.coalesce(F.sum("size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    return parts.join(F.broadcast(before), part).withColumn(name, F.col(first) + F.col(at) - 1).drop(part, at, first)  # a row for each partition


def repeated(df: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    """Each row as often as times says (not at all below 1)."""
    return df.where(times >= 1).select("*", F.explode(F.sequence(F.lit(0), times.cast("int") - 1)).alias(name))


def folded(df: DataFrame, position: str, k: int, value: Column) -> DataFrame:
    """Every k positions as one row with an array of values in order."""
    rows = df.groupBy(F.floor(F.col(position) / k).alias("fold")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v")))).alias("x"))
    return rows.select("fold", F.transform("x", lambda r: r["v"]).alias("values"))


def column_chunks(df: DataFrame, array: str, n: int) -> DataFrame:
    """n rows for each row, its array cut into n equal pieces."""
    width = (F.size(array) / n).cast("int")
    return df.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(array, (i * width + 1).cast("int"), width))).alias("chunk", "piece"))


def minibatches(df: DataFrame, key: list[str], size: int, seed: str, epoch: int) -> DataFrame:
    """Adds batch: rows in the seeded order of the epoch, `size` at a time."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(epoch)), *(F.col(k).cast("string") for k in key)))
    rows = with_position(df.withColumn("_order", order), ["_order", *key])
    return rows.withColumn("batch", F.floor(F.col("position") / size)).drop("_order", "position")


def padded(df: DataFrame, order: list[str], multiple: int) -> DataFrame:
    """Rows with their position, and the first ones again (padding) up to a multiple."""
    rows = with_position(df, order).withColumn("position", F.col("position").cast("long"))
    n = df.count()
    more = -n % multiple if n else 0
    again = [rows.where(F.col("position") < min(n, more - k)).withColumn("position", F.col("position") + n + k) for k in range(0, more, max(n, 1))]
    out = rows.withColumn("padding", F.lit(False))
    for a in again:
        out = out.unionAll(a.withColumn("padding", F.lit(True)))
    return out


def disjoint(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that both have; empty if the splits don't overlap."""
    return a.select(*key).intersect(b.select(*key))
