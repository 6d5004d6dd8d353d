"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source s of size S_s (words) and weight w_s wants a share of the budget in proportion to w_s, but no more than
max_epochs * S_s. Raising one common level L, target_s = min(max_epochs * S_s, L * w_s) until the budget is spent gives
the same targets as handing the excess of clamped sources to the others by weight until none is above its cap.

A source repeats every document floor(target / S) times; the rest of its target goes to the documents that come first
in a seeded hash order, up to the document whose middle lies beyond the rest. The place where the order is cut is found
by sums over ranges of the hash (RADIX_BITS at a time) and a window over one last range only, so no source, however
large, is ordered as a whole.

Defined results: a null text or a text without words has size 0 and is taken 0 times 0 words; null sources form one
source, last in order; a source without words has target 0; an empty table gives no rows; of rows that agree in
source, doc_id and size, as many get the fractional repetition as its rest holds, by a hash of their texts in `mixed`. Columns other than doc_id,
text and source are not read here; `mixed` carries them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, staged

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
MAX_EPOCHS = 2
#: The budget in words is BUDGET_NUM / BUDGET_DEN of all words.
BUDGET_NUM, BUDGET_DEN = 3, 2
HASH_BITS, RADIX_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; orders by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def order_hash(doc_id: Column, seed: str = SEED) -> Column:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget=(BUDGET_NUM, BUDGET_DEN)) -> DataFrame:
    """sizes: sk, size. A row per source: sk, source_size, target. One row per source is ordered in one task.

    Whether a source is clamped is decided in whole numbers: level_i = (budget - caps before i) / (weights from i on),
    with sources in ascending order of cap / weight."""
    num, den = budget
    per = sizes.groupBy("sk").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.row_number().over(Window.orderBy("sk")) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs * den)
    up = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    whole = Window.partitionBy()
    per = per.select(
        "*",
        F.row_number().over(up).alias("place"),
        (F.sum("source_size").over(whole) * num - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("open"),
    )
    per = per.withColumn("first_open", F.min(F.when(F.col("left") * F.col("w") < F.col("cap") * F.col("open"), F.struct("place", "left", "open"))).over(whole))
    level = F.col("first_open")
    target = F.when(level.isNull() | (F.col("place") < level["place"]), (F.col("source_size") * max_epochs).cast("double")).otherwise(
        (F.col("w") * level["left"]).cast("double") / (level["open"] * den).cast("double")
    )
    return per.select("sk", "source_size", target.alias("target"))


def _cut(rows: DataFrame, rest: str, shift: int, label: str) -> DataFrame:
    """Per sk, the first range of RADIX_BITS of the hash whose documents go beyond `rest`: its number and what is left of
    rest at its start. None for a source that stays below."""
    sums = rows.groupBy("sk", F.shiftright("h", shift).alias("range")).agg(F.sum("size").alias("words"), F.first(rest).alias("rest"))
    run = F.sum("words").over(Window.partitionBy("sk").orderBy("range"))
    beyond = sums.withColumn("run", run).where("run > rest")
    return beyond.groupBy("sk").agg(F.min(F.struct("range", (F.col("rest") - F.col("run") + F.col("words")).alias("left"))).alias(label))


def fractional_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per source: sk, source_size, target, whole, below, last, tied, tied_taken. Documents with a hash under
    `below`, or with (h, doc_id, size) before `last`, and tied_taken of the `tied` rows at `last` get one repetition more than
    `whole`. sizes must be cheap to read more than once."""
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = staged(targets.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")), "mix-targets")
    # two doubles a source and a name: small unless there are very many sources
    small = broadcast_if_small(targets.select("sk", "rest"), 256)
    rows = sizes.where("size > 0").join(small, "sk")
    first = staged(_cut(rows, "rest", HASH_BITS - RADIX_BITS, "a"), "mix-cut-a")
    rows = rows.join(broadcast_if_small(first, 256), "sk").where(F.shiftright("h", HASH_BITS - RADIX_BITS) == F.col("a.range"))
    rows = rows.select("sk", "doc_id", "size", "h", F.col("a.left").alias("rest"))
    second = staged(_cut(rows, "rest", HASH_BITS - 2 * RADIX_BITS, "b"), "mix-cut-b")
    rows = rows.join(broadcast_if_small(second, 256), "sk").where(F.shiftright("h", HASH_BITS - 2 * RADIX_BITS) == F.col("b.range"))
    before = F.sum("size").over(Window.partitionBy("sk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    taken = rows.withColumn("before", before).withColumn("in", (2 * F.col("before") + F.col("size") <= 2 * F.col("b.left")).cast("long"))
    ties = taken.groupBy("sk", F.struct("h", "doc_id", "size").alias("last")).agg(F.count("*").alias("tied"), F.sum("in").alias("tied_taken"))
    last = ties.where("tied_taken > 0").groupBy("sk").agg(F.max(F.struct("last", "tied", "tied_taken")).alias("l")).select("sk", "l.*")
    below = F.coalesce(F.shiftleft(F.col("b.range"), HASH_BITS - 2 * RADIX_BITS), F.lit(1 << HASH_BITS))
    cuts = targets.join(second, "sk", "left").join(last, "sk", "left")
    return cuts.select("sk", "source_size", "target", "whole", below.alias("below"), "last", "tied", "tied_taken")


def _key(h: Column, doc_id: Column, size: Column) -> Column:
    return F.struct(h.alias("h"), doc_id.alias("doc_id"), size.alias("size"))


def _placed(rows: DataFrame, cuts: DataFrame, key: Column, order: Column) -> DataFrame:
    """rows joined with cuts, and __place: the number of a row among those at `last`, where not all of these are taken."""
    rows = rows.join(broadcast_if_small(cuts, 256), "sk")
    if cuts.where("tied > tied_taken").isEmpty():
        return rows.withColumn("__place", F.lit(0))
    split = (F.col("tied") > F.col("tied_taken")) & key.eqNullSafe(F.col("last"))
    split = F.coalesce(split, F.lit(False))
    number = F.row_number().over(Window.partitionBy("sk").orderBy(order))
    return rows.where(~split).withColumn("__place", F.lit(0)).unionByName(rows.where(split).withColumn("__place", number))


def _repetitions(h: Column, key: Column) -> Column:
    more = (h < F.col("below")) | F.coalesce((key <= F.col("last")) & (F.col("__place") <= F.col("tied_taken")), F.lit(False))
    return F.col("whole") + F.when((F.col("target") > F.col("whole") * F.col("source_size")) & more, 1).otherwise(0)


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget=(BUDGET_NUM, BUDGET_DEN), seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, sk, size, h for every document; cuts: as fractional_cuts)."""
    sizes = docs.select("doc_id", source_key(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id"), seed).alias("h"))
    sizes = staged(sizes, "mix-sizes")
    return sizes, staged(fractional_cuts(sizes, source_targets(sizes, weights, max_epochs, budget)), "mix-cuts")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sizes, cuts = mix_plan(docs, **how)
    key = _key(F.col("h"), F.col("doc_id"), F.col("size"))
    out = _placed(sizes, cuts, key, F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _repetitions(F.col("h"), key)).alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents of size 0 stay once."""
    _, cuts = mix_plan(docs, seed=seed, **how)
    rows = docs.select(F.struct("*").alias("__row"), source_key(F.col("source")).alias("sk"), word_count(F.col("text")).alias("__size"))
    h = order_hash(F.col("__row.doc_id"), seed)
    key = _key(h, F.col("__row.doc_id"), F.col("__size"))
    rows = _placed(rows, cuts, key, F.xxhash64("__row.text"))
    times = F.when(F.col("__size") == 0, F.lit(1)).otherwise(_repetitions(h, key))
    return rows.select("__row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("__n")).select("__row.*")


#: The same rows in DuckDB.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS sk,
         CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
ranked AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY sk) AS r FROM sized GROUP BY sk),
weighted AS (
  SELECT sk, source_size, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 4 * source_size AS cap FROM ranked),
placed AS (
  SELECT *, row_number() OVER up AS place,
         CAST(sum(source_size) OVER () * 3 - (sum(cap) OVER up - cap) AS BIGINT) AS rem,
         CAST(sum(w) OVER () - (sum(w) OVER up - w) AS BIGINT) AS open_w
  FROM weighted WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / w, sk ROWS UNBOUNDED PRECEDING)),
lvl AS (SELECT place, rem, open_w FROM placed WHERE rem * w < cap * open_w ORDER BY place LIMIT 1),
targets AS (
  SELECT p.sk, p.source_size,
         CASE WHEN l.place IS NULL OR p.place < l.place THEN CAST(2 * p.source_size AS DOUBLE)
              ELSE CAST(p.w * l.rem AS DOUBLE) / CAST(l.open_w * 2 AS DOUBLE) END AS target
  FROM placed p LEFT JOIN lvl l ON true),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM targets),
runs AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.n, w.target - CAST(w.n * w.source_size AS DOUBLE) AS rest,
         sum(s.size) OVER (PARTITION BY s.sk ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN whole w USING (sk))
SELECT doc_id, size, source_size, target,
       CAST(size * (n + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs
"""
