"""Sampling and splitting by seeded hashes: the same counts, strata and disjointness on any cluster."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settled


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a global order, however large n is: range partitions are numbered side by side."""
    from tessera.operators.relational import with_position

    return with_position(df, order, "_first").where(F.col("_first") < n).drop("_first")


def draw(seed: str, *key: str) -> Column:
    """Seeded order of rows: the MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in key)))


def uniform(seed: str, *key: str) -> Column:
    """A seeded number in (0, 1)."""
    return (F.conv(F.substring(draw(seed, *key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _offsets(df: DataFrame, strata: list[str], value: Column) -> DataFrame:
    """(strata, _b, _before, _all): what the buckets before each one add up to, and the stratum's total."""
    sums = df.groupBy(*strata, "_b").agg(value.alias("_s"))
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))  # a few thousand buckets, not rows
    before = F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(strata)), F.col("_b").alias("_kb"), before.alias("_before"), F.sum("_s").over(w).alias("_all"))


def _numbered(df: DataFrame, strata: list[str], seed: str, key: list[str], value: Column, within: Column, names: tuple[str, str]) -> DataFrame:
    """Running totals in the seeded order, by buckets of it: no task gets a whole stratum, however large."""
    rows = df.withColumn("_d", draw(seed, *key)).withColumn("_b", F.substring("_d", 1, 3))
    sums = _offsets(rows, strata, value)
    on = F.col("_b") == F.col("_kb")
    for i, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*strata, "_b").orderBy("_d", *key)
    rows = rows.withColumn("_i", within.over(w)).join(sums, on)
    return rows.select(*df.columns, (F.col("_before") + F.col("_i")).alias(names[0]), F.col("_all").alias(names[1]))


def ranked(df: DataFrame, strata: list[str], seed: str, key: list[str], rank: str = "rank", n: str = "n") -> DataFrame:
    """Adds rank (from 1) in the seeded order within strata, and the stratum's number of rows."""
    return _numbered(df, strata, seed, key, F.count("*"), F.row_number(), (rank, n))


def running(df: DataFrame, value: str, seed: str, key: list[str]) -> DataFrame:
    """Adds up_to, the running total of value in the seeded order, and total."""
    return _numbered(df, [], seed, key, F.sum(value), F.sum(value), ("up_to", "total"))


def split_counts(df: DataFrame, strata: list[str], seed: str, key: list[str], train: int, val: int) -> DataFrame:
    """Per stratum `train` rows and then `val` rows, never the same; others have no split."""
    r = F.col("rank")
    return ranked(df, strata, seed, key).withColumn("split", F.when(r <= train, "train").when(r <= train + val, "val")).drop("rank", "n")


def stratum_assignment(df: DataFrame, strata: list[str], seed: str, key: list[str], shares: dict[str, float], name: str = "split") -> DataFrame:
    """Deals each stratum's rows, in seeded order, to the names by the rank's midpoint and cumulative shares."""
    at, total, out, so_far = (F.col("rank") - 0.5) / F.col("n"), sum(shares.values()), None, 0.0
    *most, last = shares
    for k in most:
        so_far += shares[k] / total
        out = F.when(at <= so_far, k) if out is None else out.when(at <= so_far, k)
    return ranked(df, strata, seed, key).withColumn(name, F.lit(last) if out is None else out.otherwise(last)).drop("rank", "n")


def joint_ratios(df: DataFrame, first: str, second: str, a: dict[str, float], b: dict[str, float], most: int, seed: str, key: list[str]) -> DataFrame:
    """`most` rows to a joint distribution: in each stratum the half-even share, then the rest in seeded order."""
    spark = df.sparkSession
    ta, tb = sum(a.values()), sum(b.values())
    grid = spark.createDataFrame([(x, y, p / ta * q / tb) for x, p in a.items() for y, q in b.items()], f"{first} string, {second} string, _share double")
    want = F.bround(F.lit(float(most)) * F.coalesce("_share", F.lit(0.0))).cast("int")
    rows = ranked(df, [first, second], seed, key).join(F.broadcast(grid), [first, second], "left").withColumn("_in", F.col("rank") <= want)  # the grid is an argument
    rows = rows.withColumns({"_o": ~F.col("_in"), "_d": draw(seed, *key)})
    return first_rows(rows, ["_o", "_d", *key], most).select(*df.columns)


def ratio_units(df: DataFrame, stratum: str, ratios: dict[str, int], seed: str, key: list[str], most_units: int | None = None) -> DataFrame:
    """ratio * unit rows of each stratum, unit being the greatest that all strata can fill."""
    counts = df.where(F.col(stratum).isin(list(ratios))).groupBy(stratum).agg(F.count("*").alias("n"))
    r = _lookup(F.col(stratum), ratios)
    unit = counts.agg(F.when(F.count("*") == len(ratios), F.min(F.floor(F.col("n") / r))).otherwise(0).alias("unit"))
    unit = unit.withColumn("unit", F.least("unit", F.lit(most_units))) if most_units is not None else unit
    rows = ranked(df.where(F.col(stratum).isin(list(ratios))), [stratum], seed, key).crossJoin(F.broadcast(unit))  # one row
    return rows.where(F.col("rank") <= F.col("unit") * r).drop("rank", "n", "unit")


def _lookup(value: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out


def fails_and_share_of_passes(df: DataFrame, passed: Column, stratum: list[str], share: float, seed: str, key: list[str]) -> DataFrame:
    """All rows that fail, and int(n * share) of those that pass, per stratum."""
    rows = ranked(df.withColumn("_p", passed), [*stratum, "_p"], seed, key)
    return rows.where(~F.col("_p") | (F.col("rank") <= F.floor(F.col("n") * share))).drop("_p", "rank", "n")


def middle_and_sides(df: DataFrame, rate: str, share: float, seed: str, key: list[str]) -> DataFrame:
    """All rates strictly between 0 and 1, and half-up share * their number of each of 0 and 1."""
    side = F.when(F.col(rate) <= 0, "low").when(F.col(rate) >= 1, "high").otherwise("middle")
    rows = df.where(F.col(rate).isNotNull()).withColumn("side", side)
    most = rows.agg(F.floor(F.count_if(F.col("side") == "middle") * share + 0.5).alias("_most"))
    return ranked(rows, ["side"], seed, key).crossJoin(F.broadcast(most)).where((F.col("side") == "middle") | (F.col("rank") <= F.col("_most"))).drop("rank", "n", "_most")  # one row


def weighted_best(df: DataFrame, weight: str, n: int, seed: str, key: list[str]) -> DataFrame:
    """n rows without replacement, chances by weight: the greatest u ** (1 / weight)."""
    rows = df.where(F.col(weight) > 0).withColumn("_k", -F.log(uniform(seed, *key)) / F.col(weight))
    return first_rows(rows, ["_k", *key], n).drop("_k")


def resampled(df: DataFrame, n: int, seed: str, key: list[str]) -> DataFrame:
    """n rows: whole permutations of the table and then part of one (copy: which)."""
    count = df.count()
    if not count:
        return df.withColumn("copy", F.lit(0)).limit(0)
    whole, rest = divmod(n, count)
    rows = ranked(df, [], seed, key, "_r", "_n") if rest else df.withColumn("_r", F.lit(1))
    times = F.lit(whole) + F.when(F.col("_r") <= rest, 1).otherwise(0)
    return rows.where(times > 0).select(*df.columns, F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))


def whole_groups(df: DataFrame, group: str, n: int, seed: str) -> DataFrame:
    """Groups in the seeded order of SHA-256, taken greedily while they fit into n rows (column chosen).

    Each round takes, by prefix sums over buckets of the order, all groups up to the first that doesn't fit; groups
    larger than what is left then count no more, so that rounds are few.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = settled(sizes)
    room, after, taken = n, "", None
    while room > 0:
        left = sizes.where((F.col("_n") <= room) & (F.col("_h") > after))
        before = _offsets(left, [], F.sum("_n"))
        w = Window.partitionBy("_b").orderBy("_h")
        summed = left.join(before, F.col("_b") == F.col("_kb")).select(group, "_h", "_n", (F.col("_before") + F.sum("_n").over(w)).alias("_up_to"))
        found = summed.agg(F.max(F.when(F.col("_up_to") <= room, F.struct("_h", "_up_to"))).alias("last"), F.min(F.when(F.col("_up_to") > room, F.col("_h"))).alias("stop")).first()
        if found.last is None:
            break
        part = (F.col("_n") <= room) & (F.col("_h") > after) & (F.col("_h") <= found.last._h)
        taken = part if taken is None else taken | part
        if found.stop is None:
            break
        room, after = room - found.last._up_to, found.stop
    chosen = sizes.select(group, (F.lit(False) if taken is None else taken).alias("chosen"))
    return df.join(chosen, group)


def importance_resampled(df: DataFrame, weight: str, n: int, seed: str, key: list[str]) -> DataFrame:
    """n rows with replacement, chances by weight (copy: which): n evenly spaced marks with a seeded start over the running weights."""
    rows = running(df.where(F.col(weight) > 0), weight, seed, key)
    start = int(hashlib.md5(f"{seed}:start".encode()).hexdigest()[:12], 16) / float(1 << 48)
    marks = lambda x: F.ceil(x * n / F.col("total") - start)
    times = (marks(F.col("up_to")) - marks(F.col("up_to") - F.col(weight))).cast("int")
    return rows.where(times > 0).select(*df.columns, F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))


def curriculum(df: DataFrame, rate: str, rescued: str, sft_share: float, seed: str, key: list[str]) -> DataFrame:
    """Target of each row: drop (always passed), rl (part of the rest), sft (a share of it and all that a teacher rescued), unsolved."""
    pool = (F.col(rate) > 0) & (F.col(rate) < 1)
    rows = ranked(df.withColumn("_pool", F.coalesce(pool, F.lit(False))), ["_pool"], seed, key, "_r", "_n")
    sft = F.col("_pool") & (F.col("_r") <= F.bround(F.col("_n") * sft_share))
    target = F.when(F.col(rate).isNull(), F.array(F.lit("unscored"))).when(F.col(rate) >= 1, F.array(F.lit("drop"))).when(
        F.col("_pool"), F.array(F.when(sft, "sft").otherwise("rl")),
    ).when(F.col(rescued), F.array(F.lit("sft"), F.lit("rl"))).otherwise(F.array(F.lit("unsolved")))
    return rows.select(*df.columns, F.explode(target).alias("target"))


def weighted_copies(df: DataFrame, size: int, weights: dict[str, float], source: str, seed: str, key: list[str]) -> DataFrame:
    """About size * weight rows of each source: whole copies, and a seeded part of one more (copy: which)."""
    total = sum(weights.values())
    want = F.coalesce(_lookup(F.col(source), {k: float(size * w / total) for k, w in weights.items()}), F.lit(0.0))
    rows = ranked(df.where(F.col(source).isin(list(weights))), [source], seed, key, "_r", "_n").withColumn("_w", want)
    times = F.floor(F.col("_w") / F.col("_n")) + F.when(F.col("_r") <= F.floor(F.col("_w") - F.floor(F.col("_w") / F.col("_n")) * F.col("_n")), 1).otherwise(0)
    return rows.withColumn("_t", times.cast("int")).where("_t > 0").select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("copy"))


def rounds(parts: list[DataFrame], names: list[str], seed: str, key: list[str]) -> DataFrame:
    """All parts interleaved until the longest ends, shorter ones starting over (round, source)."""
    sizes = [p.count() for p in parts]
    most, out = max(sizes), None
    for p, n, name in zip(parts, sizes, names, strict=True):
        if not n:
            continue
        rows = ranked(p, [], seed, key, "_r", "_n").withColumn("_r", (F.col("_r") - 1).cast("int")).drop("_n")
        rows = rows.select("*", F.explode(F.sequence(F.col("_r"), F.lit(most - 1), F.lit(n))).alias("round")).where(F.col("round") < most).withColumn("source", F.lit(name)) if n < most else rows.withColumn("round", F.col("_r")).withColumn("source", F.lit(name))
        rows = rows.drop("_r")
        out = rows if out is None else out.unionByName(rows)
    return out
