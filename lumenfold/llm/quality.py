"""Quality rules with thresholds that adapt to language and source, with DataFrame functions only.

Every document has four measures in whole numbers: symbols per 1000 characters of words, repeated lines per 1000 lines
with a word, words in repeated 3-word windows per 1000 words, and the mean word length in hundredths. A sketch of a
group is the counts of its values in buckets whose width is at most 1/32 of their value; sketches merge by adding
counts, so the result depends neither on partitions nor on the order of rows. From it come the quartiles, and a
document passes a measure up to q3 + SPREAD * max(q3 - q1, the measure's least spread).

A group is a language and source; with fewer than LEAST_GROUP documents (of LEAST_WORDS words or more, the only ones
that sketches hold) its language's merged sketch is used, and with too few of these as well, that of all documents.

Defined results: a null text has no words; a document without words has all measures 0 and fails the base rule; null
languages or sources form a group of their own; the rules see no columns but doc_id, text, lang and source; rows that
repeat a doc_id are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, let, staged

LEAST_WORDS, LEAST_GROUP, SPREAD = 50, 200, 3
#: Per measure, the least spread: groups whose documents agree in a measure would else reject the slightest deviation.
MEASURES = {"symbols": 30, "dup_lines": 150, "repeats": 100, "word_length": 50}
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            again = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            at = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"]))
            # each place covers three words, or as many as there are before the next place
            return let(at, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"]))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows(words), of_hashes)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, gk (language and source), lk (language), the counts, and the measures of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("0"), "lang"), F.lit("1")).alias("lk"), F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("sk"), text.alias("t"))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    rows = rows.select(
        "doc_id", "lk", F.struct("lk", "sk").alias("gk"),
        let(F.filter(F.split("t", SPACE), lambda x: x != ""), of_words).alias("w"),
        F.char_length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: F.regexp(x, F.lit(r"[^\x20\x09-\x0D]"))), of_lines).alias("l"),
    )
    rows = rows.select("doc_id", "lk", "gk", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    share = lambda a, b, by=1000: F.expr(f"{by} * {a} div greatest({b}, 1)")
    return rows.withColumns({"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words", 100)})


def bucket(x: Column) -> Column:
    """Values under 64 are exact; above, 32 buckets for each doubling."""
    e = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", x, e)).cast("int")


def least_value(name: str) -> Column:
    """The least value of the bucket whose number is in column name."""
    e = F.greatest(F.expr(f"{name} div 32").cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (F.col(name) - e * 32).cast("long"), e)


def sketches(rows: DataFrame) -> DataFrame:
    """gk, lk, measure, bucket, n: the mergeable sketches of all groups."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    long = rows.where(F.col("n_words") >= LEAST_WORDS).select("gk", "lk", each.alias("m"))
    return long.groupBy("gk", "lk", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of keys: size, and the highest value that passes, by measure. Merges the sketches of what keys join."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    merged = merged.withColumns({"run": F.sum("n").over(group.orderBy("bucket")), "size": F.sum("n").over(group)})
    quarter = lambda k: F.min(F.when(F.col("run") * 4 >= F.col("size") * k, F.col("bucket")))
    per = merged.groupBy(*keys, "measure").agg(quarter(1).alias("b1"), quarter(3).alias("b3"), F.first("size").alias("size"))
    per = per.withColumn("q1", least_value("b1")).withColumn("q3", least_value("b3"))
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
    per = per.withColumn("most", F.col("q3") + SPREAD * F.greatest(F.col("q3") - F.col("q1"), floor.cast("long")))
    return per.groupBy(*keys).agg(F.first("size").alias("size"), *[F.max(F.when(F.col("measure") == m, F.col("most"))).alias(f"max_{m}") for m in MEASURES])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    rows = staged(features(docs), "quality-features")
    sketch = staged(sketches(rows), "quality-sketches")
    limits = [f"max_{m}" for m in MEASURES]
    pack = F.struct("size", *limits)
    own = thresholds(sketch, ["gk", "lk"]).select("gk", "lk", pack.alias("own"))
    lang = thresholds(sketch, ["lk"]).select("lk", pack.alias("lang"))
    every = thresholds(sketch.withColumn("a", F.lit(1)), ["a"]).select(pack.alias("every"))
    enough = lambda c: F.when(F.col(f"{c}.size") >= LEAST_GROUP, F.col(c))
    # every has one row at most
    chosen = own.join(lang, "lk").join(F.broadcast(every)).select("gk", F.coalesce(enough("own"), enough("lang"), F.col("every")).alias("most"))
    chosen = staged(chosen, "quality-thresholds")
    out = rows.join(broadcast_if_small(chosen, 256), "gk", "left")
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")
    passes = F.lit(True)
    for m in MEASURES:
        passes = passes & (F.col(m) <= F.col(f"most.max_{m}"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(passes, F.lit(True))).alias("kept"))


def _oracle() -> str:
    """The rows of judged in DuckDB."""
    space, names = r"[\x20\x09-\x0D]", list(MEASURES)
    b = "(greatest(length(bin({x})) - 6, 0) * 32 + ({x} >> greatest(length(bin({x})) - 6, 0)))"
    val = "((({b}) - greatest(({b}) // 32 - 1, 0) * 32) << greatest(({b}) // 32 - 1, 0))"
    floor = " ".join(f"WHEN '{m}' THEN {v}" for m, v in MEASURES.items())

    def level(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        most = ", ".join(f"max(most) FILTER (measure = '{m}') AS max_{m}" for m in names)
        return f"""(SELECT {by}max(size) AS size, {most} FROM (
  SELECT {by}measure, size, {val.format(b='b3')} + {SPREAD} * greatest({val.format(b='b3')} - {val.format(b='b1')}, CASE measure {floor} END) AS most FROM (
    SELECT {by}measure, max(size) AS size, min(CASE WHEN run * 4 >= size THEN bucket END) AS b1, min(CASE WHEN run * 4 >= size * 3 THEN bucket END) AS b3 FROM (
      SELECT {by}measure, bucket, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {by}measure) AS size FROM (
        SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY {by}measure, bucket)) GROUP BY {by}measure)) {'GROUP BY ' + keys if keys else ''})"""

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('0' || lang, '1') AS lk, coalesce('0' || source, '1') AS sk, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
windows AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM (SELECT id, i, w[i:i+2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3))),
repeats AS (
  SELECT id, count(*) AS r FROM (SELECT DISTINCT id, i + d AS p FROM windows, (VALUES (0), (1), (2)) v(d) WHERE c > 1) GROUP BY id),
feat AS (
  SELECT id, doc_id, lk, sk, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (id)),
meas AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
         1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_length FROM feat),
sketch AS (
  SELECT lk, sk, measure, {b.format(x='x')} AS bucket, count(*) AS n FROM (
    {' UNION ALL '.join(f"SELECT lk, sk, '{m}' AS measure, CAST({m} AS BIGINT) AS x FROM meas WHERE n_words >= {LEAST_WORDS}" for m in names)}) GROUP BY ALL),
own AS {level('lk, sk')}, lang AS {level('lk')}, every AS {level('')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND {' AND '.join(f"coalesce({m} <= CASE WHEN own.size >= {LEAST_GROUP} THEN own.max_{m} WHEN lang.size >= {LEAST_GROUP} THEN lang.max_{m} ELSE every.max_{m} END, true)" for m in names)} AS kept
FROM meas LEFT JOIN own USING (lk, sk) LEFT JOIN lang USING (lk) LEFT JOIN every ON true
"""


ORACLE = _oracle()
