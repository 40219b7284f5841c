"""Packing and balancing of sequences by length."""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each pack takes the longest item that fits until none does; places of the items, items beyond capacity are left out."""
    free = sorted((n, i) for i, n in enumerate(lengths) if n <= capacity)
    packs = []
    while free:
        room, pack = capacity, []
        while (at := bisect.bisect_right(free, (room, len(lengths)))) > 0:
            n, i = free.pop(at - 1)
            room -= n
            pack.append(i)
        packs.append(pack)
    return packs


def packed(df: DataFrame, key: str, length: str, batch: Column, capacity: int) -> DataFrame:
    """(batch, pack, place, key, length, offset): packs within each batch, whose size the caller bounds."""
    kind = df.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        out = []
        for p, pack in enumerate(knapsacks(pdf[length].tolist(), capacity)):
            at = 0
            for k, i in enumerate(pack):
                out.append((pdf.batch[i], p, k, pdf[key][i], int(pdf[length][i]), at))
                at += int(pdf[length][i])
        return pd.DataFrame(out, columns=["batch", "pack", "place", key, length, "offset"])

    rows = df.select(batch.cast("long").alias("batch"), key, F.col(length).cast("long").alias(length))
    return rows.groupBy("batch").applyInPandas(one, f"batch long, pack int, place int, {key} {kind}, {length} long, offset long")


def karmarkar_karp(lengths: list[int], k: int, equal: bool = False, rest: bool = False) -> list[list[int]]:
    """k parts of nearly equal sums by largest differencing; equal: of equal sizes too (the number must divide; with rest it need not, and sizes differ by one at most)."""
    if equal and not rest and len(lengths) % k:
        raise ValueError("the number of items must be a multiple of the parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap: list[tuple] = []
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    for n, g in enumerate(groups):
        parts = sorted(((lengths[i], [i]) for i in g), key=lambda x: (-x[0], x[1]))
        parts += [(0, [])] * (k - len(parts))
        heap.append((-(parts[0][0] - parts[-1][0]), n, parts))
    heapq.heapify(heap)
    n = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (-(both[0][0] - both[-1][0]), n, both))
        n += 1
    return [sorted(p) for _, p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal: bool = False, rest: bool = False) -> list[list[int]]:
    """k parts: each item, in order, joins the part of the least sum so far, the first of those that tie; equal: of the fewest items first (the number must divide; with rest it need not)."""
    if equal and not rest and len(lengths) % k:
        raise ValueError("the number of items must be a multiple of the parts")
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, 0, j) for j in range(k)]
    for i, n in enumerate(lengths):
        size, total, j = heap[0]
        parts[j].append(i)
        heapq.heapreplace(heap, (size + equal, total + n, j))
    return parts


#: Ways to cut a batch into parts, by name.
METHODS = {"differencing": karmarkar_karp, "greedy": greedy}


def workload(length: Column) -> Column:
    """Cost of a sequence: linear layers and attention."""
    return F.lit(24576) * length + length * length


def balanced(df: DataFrame, key: str, length: str, batch: Column, k: int, method: str = "differencing", equal: bool = False, rest: bool = False) -> DataFrame:
    """(batch, key, part): each batch cut into k parts of nearly equal sums, in the order of keys; equal: of equal sizes too; rest: as far as the batch's size divides."""
    kind, cut = df.schema[key].dataType.simpleString(), METHODS[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        parts = cut(pdf[length].tolist(), k, equal, rest)
        return pd.DataFrame([(pdf.batch[0], pdf[key][i], p) for p, items in enumerate(parts) for i in items], columns=["batch", key, "part"])

    rows = df.select(batch.cast("long").alias("batch"), key, F.col(length).cast("long").alias(length))
    return rows.groupBy("batch").applyInPandas(one, f"batch long, {key} {kind}, part int")


def imbalance(df: DataFrame, part: str, length: str) -> DataFrame:
    sums = df.groupBy(part).agg(F.sum(length).alias("total"))
    return sums.agg(F.min("total").alias("least"), F.max("total").alias("most"), (F.max("total") - F.min("total")).alias("spread"), F.avg("total").alias("mean"))


def small_at_both_ends(costs: list[int]) -> list[int]:
    """Order of micro-batches: cheapest at the start and the end, dearest in the middle."""
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    return order[::2] + order[1::2][::-1]


def ends_first(df: DataFrame, group: list[str], cost: str, key: str, name: str = "at") -> DataFrame:
    """Adds the place of each of a group's micro-batches in the order of small_at_both_ends()."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(cost, key)) - 1
    n = F.count("*").over(Window.partitionBy(*group))
    return df.withColumn(name, F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor(r / 2)))


def balanced_groups(df: DataFrame, key: str, group: str, length: str, batch: Column, k: int) -> DataFrame:
    """As balanced(), by workload, with all rows of a group in one part and as many groups in each part."""
    costs = df.groupBy(batch.cast("long").alias("batch"), group).agg(F.sum(workload(F.col(length))).cast("long").alias("cost"))
    kind = df.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group, kind="stable").reset_index(drop=True)
        parts = karmarkar_karp(pdf.cost.tolist(), k, equal=len(pdf) % k == 0)
        return pd.DataFrame([(pdf.batch[0], pdf[group][i], p) for p, items in enumerate(parts) for i in items], columns=["batch", group, "part"])

    dealt = costs.groupBy("batch").applyInPandas(one, f"batch long, {group} {kind}, part int")
    return df.withColumn("batch", batch.cast("long")).join(dealt, ["batch", group]).select("batch", group, key, "part")


def padded_batch(ids: Column, most: int, pad: int, left: bool = False) -> Column:
    """An array of ids cut and padded to one length."""
    cut = F.slice(ids, 1, most)
    fill = F.array_repeat(F.lit(pad), F.lit(most) - F.size(cut))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def packed_examples(df: DataFrame, key: str, ids: str, labels: str, batch: Column, capacity: int, pad: int, ignore: int = -100, neat: bool = True) -> DataFrame:
    """(batch, pack, n, input_ids, labels, position_ids, attention): the examples of each pack of packed(), one after another, padded to capacity.

    attention numbers the examples of a pack from 1, or is 1 for all of them (neat: false); positions begin anew with each example; padding has 0, and ignored labels.
    """
    rows = df.select(key, F.col(ids).alias("_ids"), F.col(labels).alias("_labels"), F.size(ids).cast("long").alias("_n"), batch.cast("long").alias("_batch"))
    places = packed(rows, key, "_n", F.col("_batch"), capacity).select("batch", "pack", "place", key)
    item = F.struct(F.col("place"), F.col("_ids").alias("ids"), F.col("_labels").alias("labels"))
    packs = places.join(rows, (F.col("batch") == F.col("_batch")) & (places[key] == rows[key])).groupBy("batch", "pack").agg(F.array_sort(F.collect_list(item)).alias("x"))
    joined = lambda f: F.flatten(F.transform("x", f))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(capacity) - F.size(c)))
    number = lambda p: F.array_repeat(p["place"] + 1 if neat else F.lit(1), F.size(p["ids"]))
    places_of = lambda p: F.when(F.size(p["ids"]) > 0, F.sequence(F.lit(0), F.size(p["ids"]) - 1)).otherwise(F.array().cast("array<int>"))
    return packs.select(
        "batch", "pack", F.size("x").alias("n"), fill(joined(lambda p: p["ids"]), pad).alias("input_ids"),
        fill(joined(lambda p: p["labels"]), ignore).alias("labels"), fill(joined(places_of), 0).alias("position_ids"),
        fill(joined(number), 0).alias("attention"),
    )


def block_mask(attention: Column) -> Column:
    """For each place of a packed row, which places it may see: earlier ones and itself, of its own example."""
    return F.transform(attention, lambda a, i: F.transform(attention, lambda b, j: F.when((a == b) & (a > 0) & (j <= i), 1).otherwise(0)))


def turn_labels(pairs: Column, most: int, mask_history: bool = False, on_prompt: bool = False, ignore: int = -100) -> Column:
    """struct(input_ids, labels) of turns (source, target: arrays of ids) within a budget of tokens.

    Each turn is cut by most_lengths() to what is left of the budget, and turns after it is used up go; with mask_history the last turn comes
    first in this and is the only one to be learnt.
    """
    from tessera.operators.conversations import most_lengths

    kind = "array<int>"
    none = lambda: F.array().cast(kind)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("turn"), none().alias("ids"), none().alias("labels"))

    def step(acc: Column, p: Column) -> Column:
        source, target = p["source"].cast(kind), p["target"].cast(kind)
        left = F.lit(most) - acc["n"]
        s, t = most_lengths(F.size(source), F.size(target), left)
        a, b = F.slice(source, F.lit(1), F.greatest(s, F.lit(0))), F.slice(target, F.lit(1), F.greatest(t, F.lit(0)))
        said = F.when(acc["turn"] > 0, F.array_repeat(F.lit(ignore), F.size(b))).otherwise(b) if mask_history else b
        asked = a if on_prompt else F.array_repeat(F.lit(ignore), F.size(a))
        both = (lambda old, new: F.concat(new, old)) if mask_history else F.concat
        new = F.struct(
            (acc["n"] + F.size(a) + F.size(b)).alias("n"), (acc["turn"] + 1).alias("turn"), both(acc["ids"], F.concat(a, b)).alias("ids"),
            both(acc["labels"], F.concat(asked, said)).alias("labels"),
        )
        return F.when(acc["n"] >= most, acc).otherwise(new)

    return F.aggregate(F.reverse(pairs) if mask_history else pairs, start, step, lambda a: F.struct(a["ids"].alias("input_ids"), a["labels"].alias("labels")))


def pairwise(prompt: Column, chosen: Column, rejected: Column, most: int, ignore: int = -100) -> Column:
    """struct of ids and labels of a chosen and a rejected answer to one prompt, which is cut by the longer of the two."""
    from tessera.operators.conversations import most_lengths

    s, t = most_lengths(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), most)
    p = F.slice(prompt, F.lit(1), s)
    part = lambda x: (F.concat(p, F.slice(x, F.lit(1), t)), F.concat(F.array_repeat(F.lit(ignore), F.size(p)), F.slice(x, F.lit(1), t)))
    (ci, cl), (ri, rl) = part(chosen), part(rejected)
    return F.struct(ci.alias("chosen_ids"), cl.alias("chosen_labels"), ri.alias("rejected_ids"), rl.alias("rejected_labels"))


def unsupervised(prompt: Column, answer: Column, most: int) -> Column:
    """struct(input_ids, labels): the prompt to answer and the answer it had, both cut."""
    from tessera.operators.conversations import most_lengths

    s, t = most_lengths(F.size(prompt), F.size(answer), most)
    return F.struct(F.slice(prompt, F.lit(1), s).alias("input_ids"), F.slice(answer, F.lit(1), t).alias("labels"))


def pretraining(df: DataFrame, ids: str, order: str, batch: Column, block: int, end: int) -> DataFrame:
    """(batch, block, input_ids): the texts of each batch, each closed by the end token, as one stream cut into blocks of equal length; what is left over goes."""
    texts = df.groupBy(batch.cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(order, F.concat(ids, F.array(F.lit(end))).alias("x")))).alias("t"))
    stream = texts.select("batch", F.flatten(F.transform("t", lambda s: s["x"])).alias("s")).withColumn("n", F.floor(F.size("s") / block).cast("int")).where("n > 0")
    return stream.select("batch", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("s", i * block + 1, F.lit(block)))).alias("block", "input_ids"))
