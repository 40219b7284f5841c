"""One pack plan for all documents, and parts by the greedy rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import packing as P
from tessera.operators import packing_plan as K
from tessera.registry import Tables, query
from tessera.shipping import ship

#: The greedy rule item by item, over all documents.
GREEDY = """
WITH RECURSIVE f AS (SELECT list(n_chars ORDER BY n_chars) AS free FROM documents WHERE n_chars <= 20000), r AS (
  SELECT free, 20000::BIGINT AS room, 0 AS pack, NULL::BIGINT AS n FROM f
  UNION ALL
  SELECT CASE WHEN c > 0 THEN free[1:c - 1] || free[c + 1:] ELSE free END, CASE WHEN c > 0 THEN room - free[c] ELSE 20000 END, pack + (c = 0)::INTEGER, CASE WHEN c > 0 THEN free[c] END
  FROM (SELECT *, len(list_filter(free, lambda x: x <= room)) AS c FROM r) WHERE len(free) > 0)
SELECT pack::BIGINT AS pack, count(*)::BIGINT AS n, sum(n)::BIGINT AS total, string_agg(n, ',' ORDER BY n DESC) AS lengths FROM r WHERE n IS NOT NULL GROUP BY pack
"""


@query(GREEDY)
def pack_whole_table(t: Tables) -> DataFrame:
    rows = K.packed_table(t.documents, "doc_id", "n_chars", 20000)
    lengths = F.array_sort(F.collect_list(F.struct("place", "n_chars")))
    return rows.groupBy("pack").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.array_join(F.transform(lengths, lambda x: x["n_chars"].cast("string")), ",").alias("lengths"))


@query("""
WITH k AS (SELECT list(DISTINCT doc_id ORDER BY doc_id) AS ids, count(*) AS n FROM documents WHERE n_chars <= 20000)
SELECT n::BIGINT AS n, n::BIGINT AS n_distinct, true AS whole, true AS fits FROM k
""")
def packs_hold_every_row_once(t: Tables) -> DataFrame:
    """Each document that fits is in one place; places and offsets of a pack leave no gaps."""
    rows = K.packed_table(t.documents, "doc_id", "n_chars", 20000)
    packs = rows.groupBy("pack").agg((F.max("place") + 1 == F.count("*")).alias("whole"), (F.max(F.col("offset") + F.col("n_chars")) == F.sum("n_chars")).alias("tight"), F.sum("n_chars").alias("total"))
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))
    good = packs.agg(F.bool_and(F.col("whole") & F.col("tight")).alias("whole"), F.bool_and(F.col("total") <= 20000).alias("fits"))
    return counts.crossJoin(F.broadcast(good))  # one row


#: Each document in turn to the part of the least sum, the first of those that tie.
PARTS = """
WITH RECURSIVE d AS (SELECT doc_id, n_chars + {bias} AS n_chars, doc_id // 40 AS batch, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY doc_id // 40) AS size FROM documents), r AS (
  SELECT batch, 0::BIGINT AS i, [0::BIGINT, 0, 0, 0] AS sums, NULL::BIGINT AS doc_id, 0::BIGINT AS part FROM d GROUP BY batch
  UNION ALL
  SELECT r.batch, d.i, list_transform(range(1, 5), lambda j: r.sums[j] + CASE WHEN j = list_position(r.sums, list_min(r.sums)) THEN d.n_chars ELSE 0 END), d.doc_id, list_position(r.sums, list_min(r.sums)) - 1
  FROM r JOIN d ON d.batch = r.batch AND d.i = r.i + 1)
SELECT batch, doc_id, part::INTEGER AS part FROM r WHERE doc_id IS NOT NULL
"""


@query(PARTS.format(bias="0"))
def greedy_parts(t: Tables) -> DataFrame:
    ship(t.spark)
    return P.balanced(t.documents, "doc_id", "n_chars", F.floor(F.col("doc_id") / 40), 4, "greedy")


@query(PARTS.format(bias="100000000"))
def greedy_parts_of_equal_size(t: Tables) -> DataFrame:
    ship(t.spark)
    return P.balanced(t.documents, "doc_id", "n_chars", F.floor(F.col("doc_id") / 40), 4, "greedy", equal=True, rest=True)
