"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions only.

A section is a line of the text; its paragraphs are blocks that end with a sentence, or after MOST characters without
one. A leaf is the SHA-256 of a block, a section's node the SHA-256 of its leaves, the root that of the sections. Blocks
joined give back their section, so equal roots mean equal texts. The fingerprint is the root and the tree, its nodes cut to 8
hexadecimal digits: root=section:leaf,leaf|section:leaf. Two fingerprints are told apart by their roots; which branches
differ locates the edit (`differing`); their likeness is twice the number of common leaves over that of both, over
distinct leaves.

The next document by ascending doc_id comes without a sort of the whole table: ids are cut into ranges of about RANGE
documents, a window orders each range, and a copy of the next range's first document closes it. The ranges' borders are
quantiles of a sample of the ids, BORDERS at most, with even steps between them, so that neither wide gaps nor 64-bit hashes
as ids fill a range; an id that fills more than a range by itself is cut by the hash of the text. Trees are built before
documents meet, once for each text and edited text.

Defined results: a null text counts as empty; an empty text has one section without paragraphs, is like an empty text (1.0) and
like no other (0.0); documents without a doc_id come last, by a hash of their text; rows that repeat a doc_id follow one
another by a hash of their text; a table with one row follows itself; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, staged

MOST = 400
RANGE, SEGMENT = 1024, 4096
BORDERS, SAMPLE = 1024, 1 << 16
BLOCK = rf"[^.!?]{{0,{MOST}}}+[.!?]+\x20?|[^.!?]{{1,{MOST}}}"
SHORT = 8


def fingerprint(text: Column) -> Column:
    leaves = F.transform(F.split(text, "\n", -1), lambda s: F.transform(F.regexp_extract_all(s, F.lit(BLOCK), F.lit(0)), lambda p: F.sha2(p.cast("binary"), 256)))

    def of_tree(tree: Column) -> Column:
        nodes = F.transform(tree, lambda s: F.sha2(F.concat_ws(",", s).cast("binary"), 256))

        def of_nodes(n: Column) -> Column:
            root = F.sha2(F.concat_ws("|", n).cast("binary"), 256)
            short = F.transform(tree, lambda s, i: F.concat(F.substring(n[i], 1, SHORT), F.lit(":"), F.concat_ws(",", F.transform(s, lambda p: F.substring(p, 1, SHORT)))))
            return F.concat(root, F.lit("="), F.concat_ws("|", short))

        return let(nodes, of_nodes)

    return let(leaves, of_tree)


def root(fp: Column) -> Column:
    return F.substring_index(fp, "=", 1)


def leaves(fp: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fp, "=", -1), F.lit(rf"(?<=[:,])[0-9a-f]{{{SHORT}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    dice = let(F.struct(leaves(a).alias("x"), leaves(b).alias("y")), lambda s: 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.size(s["x"]) + F.size(s["y"]), F.lit(1)))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(dice)


def differing(a: Column, b: Column) -> Column:
    """The places, from 0, of the sections of b whose node a does not have: where b was edited."""
    nodes = lambda fp: F.transform(F.split(F.substring_index(fp, "=", -1), r"\|"), lambda s: F.substring_index(s, ":", 1))
    found = F.transform(nodes(b), lambda n, i: F.when(~F.array_contains(nodes(a), n), i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.array_compact(found))


def _hash_part(h: str, parts: int) -> Column:
    """0 .. parts - 1, ascending with h."""
    return F.expr(f"(shiftright({h}, 40) + {1 << 23}) * {parts} div {1 << 24}")


def _ranges(docs: DataFrame) -> Column:
    """A number that ascends with (doc_id with nulls last, h), the same for about RANGE rows, of columns doc_id and h."""
    count, unnamed = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    named = count - unnamed
    wanted = max(1, named // RANGE)
    borders = min(BORDERS, wanted)
    ids = docs.select("doc_id").where("doc_id is not null")
    ids = sorted(r[0] for r in ids.sample(min(1.0, SAMPLE / max(named, 1)), 1).collect()) if borders > 1 else []  # about SAMPLE
    at = [ids[k * len(ids) // borders] for k in range(1, borders)] if ids else []
    low = sorted(set(at))
    # ids that hold several borders, and how many
    often = {x: at.count(x) for x in low if at.count(x) > 1}
    steps = max(1, -(-wanted // borders), *[n + 3 for n in often.values()]) if often else max(1, -(-wanted // borders))
    null_parts = max(1, unnamed // RANGE)
    unnamed_at = F.lit((len(low) + 1) * steps) + _hash_part("h", null_parts)
    if not low:
        named_at = F.lit(0).cast("long")
    else:
        # the number of borders at or below the id, by two short lists
        width = max(1, int(len(low) ** 0.5))
        cut = [low[i : i + width] for i in range(0, len(low), width)]
        literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
        rows = F.array(*[literal(c) for c in cut])
        border = let(below(literal([c[0] for c in cut])), lambda r: F.when(r == 0, F.lit(0)).otherwise((r - 1) * width + below(F.get(rows, r - 1))))
        ends = literal(low)

        def step(k: Column) -> Column:
            lo, hi = F.get(ends, F.greatest(k - 1, F.lit(0))).cast("double"), F.get(ends, F.least(k, F.lit(len(low) - 1))).cast("double")
            even = F.when((k == 0) | (k == len(low)) | (hi <= lo), F.lit(0)).otherwise(((F.col("doc_id").cast("double") - lo) / (hi - lo) * steps).cast("int"))
            even = F.least(F.greatest(even, F.lit(0)), F.lit(steps - 1))
            for x, n in often.items():
                own = F.when(F.col("doc_id") == x, _hash_part("h", n + 1).cast("int")).otherwise(F.lit(n + 1))
                even = F.when(k == low.index(x) + 1, own).otherwise(even)
            return k.cast("long") * steps + even

        named_at = let(border, step)
    return F.when(F.col("doc_id").isNull(), unnamed_at).otherwise(named_at)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: the rows of docs in their ranges, with fingerprints, and each one's successor's."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.select(_ranges(docs).cast("long").alias("range"), "doc_id", "h", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h"))
    heads = rows.groupBy("range").agg(first.alias("head")).withColumn("segment", F.expr(f"range div {SEGMENT}"))
    heads = staged(heads, "next-heads")
    # one row for SEGMENT * RANGE documents goes through the one task of this window
    ends = heads.groupBy("segment").agg(F.max("range").alias("end"))
    ends = ends.select("segment", F.coalesce(F.lag("end").over(Window.orderBy("segment")), F.max("end").over(Window.partitionBy())).alias("before"))
    back = F.lag("range").over(Window.partitionBy("segment").orderBy("range"))
    heads = heads.withColumn("back", back).join(broadcast_if_small(ends, 64), "segment")
    heads = staged(heads.select(F.coalesce("back", "before").alias("closes"), "range", "head.doc_id", "head.h"), "next-closing")
    closing = rows.withColumnRenamed("range", "own").join(
        broadcast_if_small(heads.select("closes", "range", F.col("doc_id").alias("head_id"), F.col("h").alias("head_h")), 64),
        (F.col("own") == F.col("range")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")),
    )
    closing = closing.dropDuplicates(["closes"]).select(F.col("closes").alias("range"), "doc_id", "h", "text", F.lit(1).alias("closing"))
    every = rows.withColumn("closing", F.lit(0)).unionByName(closing).withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("range").orderBy("closing", F.col("doc_id").isNull(), "doc_id", "h")
    every = every.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)})
    return every.where("closing = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = with_next(docs.select("doc_id", "text"))
    n = F.char_length("text")
    part = F.expr("char_length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("fp"))).alias("e"))
    near = let(F.struct("fp", "next_fp", F.col("e.fp").alias("edited")), lambda p: F.struct(likeness(p["fp"], p["edited"]).alias("edited"), likeness(p["fp"], p["next_fp"]).alias("next")))
    rows = rows.withColumn("near", near)
    return rows.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("e.fp").alias("edited_fingerprint"), F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))


def _oracle() -> str:
    """The rows of fingerprinted in DuckDB, for tables whose doc_ids are neither null nor repeated."""
    blocks = BLOCK.replace("}+", "}").replace("\\x20", " ")

    def tree(t: str) -> str:
        sections = f"list_transform(string_split({t}, chr(10)), lambda s: list_transform(regexp_extract_all(s, '{blocks}'), lambda p: sha256(p)))"
        return f"list_transform({sections}, lambda s: {{'node': sha256(array_to_string(s, ',')), 'leaves': array_to_string(list_transform(s, lambda p: p[1:{SHORT}]), ',')}})"

    fp = lambda t: f"sha256(array_to_string(list_transform({t}, lambda s: s.node), '|')) || '=' || array_to_string(list_transform({t}, lambda s: s.node[1:{SHORT}] || ':' || s.leaves), '|')"
    leaves = lambda t: f"list_distinct(flatten(list_transform({t}, lambda s: list_filter(string_split(s.leaves, ','), lambda x: x <> ''))))"
    like = lambda a, x, b, y: f"CASE WHEN split_part({a}, '=', 1) = split_part({b}, '=', 1) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / greatest(len({x}) + len({y}), 1) END"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
edits AS (
  SELECT doc_id, t, left(t, length(t) - length(t) // 2) || left(nxt, length(t) // 2) AS e FROM (
    SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nxt FROM docs)),
trees AS MATERIALIZED (SELECT doc_id, length(t) AS n, sha256(e) AS sha, {tree('t')} AS tt, {tree('e')} AS te FROM edits),
prints AS MATERIALIZED (SELECT doc_id, n, sha, {fp('tt')} AS f, {fp('te')} AS fe, {leaves('tt')} AS l, {leaves('te')} AS le FROM trees),
nexts AS (SELECT *, coalesce(lead(f) OVER o, first_value(f) OVER o) AS fn, coalesce(lead(l) OVER o, first_value(l) OVER o) AS ln FROM prints WINDOW o AS (ORDER BY doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha AS edited_sha256, f AS fingerprint, fe AS edited_fingerprint,
       {like('f', 'l', 'fe', 'le')} AS near_edited, {like('f', 'l', 'fn', 'ln')} AS near_next FROM nexts
"""


ORACLE = _oracle()
