"""Values of further policy losses over a table of tokens (key, place, new, old, adv, mask), as plain columns and one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.selection import first_n, number_of

LOSSES: dict[str, Callable[..., Column]] = {}


def tokens(df: DataFrame, key: str, new: str, old: str, adv: str, mask: str) -> DataFrame:
    """One row for each token that the mask keeps."""
    x = F.arrays_zip(F.col(new).alias("new"), F.col(old).alias("old"), F.col(adv).alias("adv"), F.col(mask).alias("mask"))
    rows = df.select(key, F.posexplode(x).alias("place", "x")).where("x.mask > 0")
    gap = F.least(F.greatest(F.col("x.new") - F.col("x.old"), F.lit(-20.0)), F.lit(20.0))
    return rows.select(key, "place", "x.new", "x.old", "x.adv", F.exp(gap).alias("ratio"))


def loss(name: str) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        LOSSES[name] = f
        return f

    return add


@loss("trust_by_probability")
def trust_by_probability(low: float, high: float, most: float = 20.0) -> Column:
    """Truncated ratios; tokens whose probability moved beyond the bound on the side of their advantage don't count."""
    move = F.exp("new") - F.exp("old")
    ok = F.when(F.col("adv") > 0, move <= high).otherwise(move >= -low)
    return F.when(ok, -F.col("adv") * F.least("ratio", F.lit(most)) * F.col("new")).otherwise(0.0)


@loss("trust_by_divergence")
def trust_by_divergence(low: float, high: float, most: float = 20.0) -> Column:
    """The same with the divergence between the two choices (this token or another) as the bound."""
    p, q = F.least(F.exp("old"), F.lit(1 - 1e-8)), F.least(F.exp("new"), F.lit(1 - 1e-8))
    apart = p * (F.log(p) - F.log(q)) + (1 - p) * (F.log(1 - p) - F.log(1 - q))
    ok = F.when(F.col("adv") > 0, (apart <= high) | (q <= p)).otherwise((apart <= low) | (q >= p))
    return F.when(ok, -F.col("adv") * F.least("ratio", F.lit(most)) * F.col("new")).otherwise(0.0)


@loss("soft_gate")
def soft_gate(up: float, down: float) -> Column:
    """Ratios through a sigmoid gate, one temperature for each sign of the advantage."""
    tau = F.when(F.col("adv") > 0, up).otherwise(down)
    return -F.col("adv") * (4.0 / tau) / (1 + F.exp(-tau * (F.col("ratio") - 1)))


def _covariance(rows: DataFrame) -> DataFrame:
    """Adds cov, each token's share of the covariance of advantage and log-probability, and the number of tokens."""
    all_ = rows.agg(F.avg("adv").alias("_a"), F.avg("new").alias("_p"), F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(all_)).withColumn("cov", (F.col("adv") - F.col("_a")) * (F.col("new") - F.col("_p"))).drop("_a", "_p")  # one row


def _share(rows: DataFrame, share: float) -> int:
    """So many of all tokens, one at least."""
    return max(1, int(share * rows.count()))


def clipped_by_covariance(rows: DataFrame, low: float, high: float, band: tuple[float, float], share: float, seed: str, key: str) -> DataFrame:
    """Adds loss: clipped ratios, less a seeded choice of at most share of the tokens whose covariance lies in the band."""
    plain = -F.col("adv") * F.col("ratio")
    clipped = -F.col("adv") * F.least(F.greatest("ratio", F.lit(1 - low)), F.lit(1 + high))
    rows = _covariance(rows).withColumn("_c", (F.col("cov") > band[0]) & (F.col("cov") < band[1]) & ~(clipped > plain))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("place").cast("string")))
    found = first_n(rows.where("_c").withColumn("_o", order), [number_of(F.col("_o"))], _share(rows, share), ["_o", key, "place"])
    out = found.select(key, "place", F.lit(0.0).alias("_zero"))
    return rows.join(out, [key, "place"], "left").withColumn("loss", F.coalesce("_zero", F.greatest(plain, clipped))).drop("_c", "_zero", "_n")


def held_by_covariance(rows: DataFrame, share: float, weight: float, key: str) -> DataFrame:
    """Adds loss: plain ratios, and a divergence penalty on the share of tokens of greatest covariance."""
    rows = _covariance(rows)
    top = first_n(rows, [-F.col("cov")], _share(rows, share), [key, "place"]).select(key, "place", F.lit(1.0).alias("_top"))
    penalty = F.coalesce("_top", F.lit(0.0)) * weight * F.abs(F.col("new") - F.col("old"))
    return rows.join(top, [key, "place"], "left").withColumn("loss", -F.col("adv") * F.col("ratio") + penalty).drop("_top", "_n")


def total(rows: DataFrame, loss_: Column | str, key: str, mode: str = "token-mean") -> DataFrame:
    """The loss over tokens, or over rows' means."""
    value = rows.select(key, (F.col(loss_) if isinstance(loss_, str) else loss_).alias("loss"))
    if mode == "token-mean":
        return value.agg(F.avg("loss").alias("loss"))
    return value.groupBy(key).agg(F.avg("loss").alias("loss")).agg(F.avg("loss").alias("loss"))
