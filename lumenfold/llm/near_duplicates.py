"""Near-duplicate documents by HyperMinHash registers, banding, corrected estimates and full verification.

A document's set: the distinct 5-word shingles of its whole text, A-Z lower-cased; with fewer words, the whole sequence
as one. Every shingle has a 64-bit hash h. BUCKETS buckets by h's top bits keep, of their least hash, the number of
leading zeros of the other bits (capped at 63) and the MANTISSA bits behind the leading one: 16 bits a register.

1. Documents with equal sets fall into one class, which gets a number and is a node from here on; one row's text stands
   for it.
2. BANDS bands of ROWS registers each. Nodes that agree in a band (not in an empty one) meet in a group. Groups with
   the same members are kept once, in the first such band.
3. Groups are cut into blocks of about BLOCK nodes and BLOCK_BYTES of sets, and every pair of blocks is a unit of work of
   bounded size. In a unit, pairs that first agree in this band are estimated from their registers (corrected for chance
   collisions). Only nodes with a pair within MARGIN of the threshold or above stay in the unit; their full sets are made
   from their texts again, and the pairs are verified, best first, unless they are connected already. Links come out as
   stars, so a group of n copies gives fewer than n links, not n * n.
4. Links are joined to components by large-star and small-star rounds, each written to the shared folder. Rows get theirs
   by their class; classes of more than a HOT-th of all rows, of which there are fewer than HOT, by a broadcast table, so
   that no class meets in one task.

With J >= 0.85 a pair shares no band with a probability under 1e-10; smaller sets have empty registers in common and are
found more surely still. The estimate's standard error is 0.032 at 0.85 and 0.035 at 0.8; by the binomial tail of BUCKETS
registers a pair at the threshold is estimated more than MARGIN below it with a probability of 2e-12 and 9e-11, less than
those of the bands (6e-11 and 5e-8).

Defined results: a text that is null, empty or without words has an empty set, is linked with nothing and is its own
component; equal texts are always linked; rows that repeat a doc_id count as one document with each of their texts; rows
without a doc_id are documents of their own, linked as any others, and a null doc_id is never a component's id unless all
its documents' are null (all of these are kept then); an empty table gives no rows; other columns are not read by
`components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, numbered_words, released, staged, text_slices

SHINGLE = 5
BUCKETS, BITS, MANTISSA = 128, 7, 10
BANDS, ROWS = 32, 4
BLOCK = 512
MARGIN = 0.25
#: Bytes of full sets of a block, and of those that one call holds at once, about.
BLOCK_BYTES, UNIT_BYTES = 16 << 20, 32 << 20
#: Rows of a unit that one call holds at once, about.
UNIT_ROWS = 1024
HOT = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its shingles."""
    for part in text_slices(texts):
        words, number, ends = numbered_words(pc.ascii_lower(part))
        own = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words.cast(pa.large_binary())), dtype=np.uint64, count=len(words))
        w = own[number] if len(own) else np.zeros(0, np.uint64)
        h = np.full(max(0, len(w) - SHINGLE + 1), SHINGLE, dtype=np.uint64)
        for k in range(SHINGLE):
            h = _mix(h * _MIX + w[k : k + len(h)])
        lo = 0
        for hi in ends.tolist():
            if hi - lo >= SHINGLE:
                yield np.unique(h[lo : hi - SHINGLE + 1])
            elif hi > lo:
                short = np.full(1, hi - lo, dtype=np.uint64)
                for x in w[lo:hi]:
                    short = _mix(short * _MIX + x)
                yield short
            else:
                yield np.zeros(0, dtype=np.uint64)
            lo = hi


def shingle_set(text: str | None) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.large_string())))


def registers(h: np.ndarray) -> np.ndarray:
    """BUCKETS registers of 16 bits from sorted hashes; 0 is an empty one. Per bucket, only its least hash counts."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if len(h) == 0:
        return out
    bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = h[first] << np.uint64(BITS)
    # the leading bit by the exponent of the top 52 bits, which a double holds exactly
    top = (rest >> np.uint64(12)).astype(np.float64)
    zeros = np.where(top > 0, 52 - np.frexp(top)[1], 52).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two disjoint sets of n and m elements that agree by chance, by the published approximation."""
    large, small = np.maximum(n, m), np.maximum(np.minimum(n, m), 1)
    ratio = large / small
    return 0.169919487159739093975315012348 * 2.0 ** (BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of the rows of a against the rows of b."""
    out = np.zeros((len(a), len(b)))
    filled_b = b != 0
    for i in range(len(a)):
        filled = (a[i] != 0) | filled_b
        same = ((a[i] == b) & filled).sum(axis=1)
        total = np.maximum(filled.sum(axis=1), 1)
        chance = expected_collisions(n_a[i], n_b) * total / BUCKETS
        out[i] = np.clip((same - chance) / np.maximum(total - chance, 1e-9), 0, 1)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; 0 for a band without a filled register."""
    rows = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.full(BANDS, 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _MIX + rows[:, k])
    return np.where(rows.any(axis=1), key | np.uint64(1), np.uint64(0))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tk (a hash of the text), n_shingles, c1, c2 (128 bits that name the set; null for an empty one), regs for
    every row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2, regs = [], [], [], []
            for h in shingle_sets(batch.column("text")):
                n.append(len(h))
                name = xxhash.xxh3_128_intdigest(h.tobytes()) if len(h) else None
                c1.append(None if name is None else (name >> 64) - (1 << 63))
                c2.append(None if name is None else (name & (1 << 64) - 1) - (1 << 63))
                regs.append(None if name is None else registers(h).tobytes())
            out = [batch.column("doc_id"), batch.column("tk"), *[pa.array(x, pa.int64()) for x in (n, c1, c2)], pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "tk", "n_shingles", "c1", "c2", "regs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("tk"), "text")
    return narrow.mapInArrow(run, "doc_id long, tk long, n_shingles long, c1 long, c2 long, regs binary")


def _sets(texts: DataFrame) -> DataFrame:
    """node, regs, shingles for rows of node, text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column("text")):
                sets = list(shingle_sets(part))
                out = [batch.column("node").slice(at, len(part)), pa.array([registers(h).tobytes() for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(out, names=["node", "regs", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, regs binary, shingles binary")


def _near(group: pd.DataFrame, size: np.ndarray, regs: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one unit (places in group), best estimate first, that may reach the threshold and share no band
    before this one: of one block, or of block bi with block bj."""
    num, den = threshold
    band, bi, bj = int(group["band"].iloc[0]), int(group["bi"].iloc[0]), int(group["bj"].iloc[0])
    side = group["block"].to_numpy(np.int64)
    left = np.flatnonzero(side == bi)
    right = left if bi == bj else np.flatnonzero(side == bj)
    est = estimates(regs[left], regs[right], size[left], size[right])
    # sizes alone bound the Jaccard value
    bound = np.minimum(size[left][:, None], size[right][None, :]) * den >= num * np.maximum(size[left][:, None], size[right][None, :])
    near = (est >= num / den - MARGIN) & bound
    if bi == bj:
        near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    x, y = np.nonzero(near)
    best = np.argsort(-est[x, y], kind="stable")
    x, y = left[x[best]], right[y[best]]
    if band and len(x):
        keys = np.stack([band_keys(r)[:band] for r in regs])
        new = ~np.concatenate([((keys[x[i : i + 65536]] == keys[y[i : i + 65536]]) & (keys[x[i : i + 65536]] != 0)).any(axis=1) for i in range(0, len(x), 65536)])
        x, y = x[new], y[new]
    return x, y


def _links_of(group: pd.DataFrame, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links of one unit as (member, smallest member)."""
    num, den = threshold
    node = group["node"].to_numpy(np.int64)
    regs = np.frombuffer(b"".join(group["regs"]), dtype=np.uint16).reshape(len(node), BUCKETS)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
    size = np.asarray([len(x) for x in sets], dtype=np.float64)
    root = np.arange(len(node))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*(v.tolist() for v in _near(group, size, regs, threshold)), strict=True):
        a, b = find(i), find(j)
        if a == b or node[i] == node[j]:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if den * both >= num * (size[i] + size[j] - both):
            root[max(a, b)] = min(a, b)
    tops = [find(i) for i in range(len(node))]
    least: dict[int, int] = {}
    for i, top in enumerate(tops):
        least[top] = min(least.get(top, int(node[i])), int(node[i]))
    return sorted({(int(node[i]), least[top]) for i, top in enumerate(tops) if node[i] != least[top]})


def _marks(*columns: str) -> list[Column]:
    """Two independent hashes of all rows of a group together; no sum, which could overflow."""
    return [F.bit_xor(F.xxhash64(*columns)).alias("x1"), F.bit_xor(F.xxhash64(*columns, F.lit(1))).alias("x2")]


def links(docs: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """a, b: links whose components are those of all pairs of nodes with J >= threshold. nodes: node, n_shingles, regs,
    and doc_id, tk of the row of docs whose text stands for the node; read more than once."""

    @released
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r.as_buffer(), dtype=np.uint16)).view(np.int64) for r in batch.column("regs")]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_shingles"), lists], names=["node", "n", "keys"])

    per = nodes.select("node", "n_shingles", "regs").mapInArrow(keyed, "node long, n long, keys array<long>")
    bands = staged(per.select("node", "n", F.posexplode("keys").alias("band", "key")).where("key <> 0"), "near-bands")
    groups = bands.groupBy("band", "key").agg(F.count("*").alias("g"), F.sum("n").alias("total"), *_marks("node")).where("g > 1")
    kept = groups.groupBy("g", "x1", "x2").agg(F.min(F.struct("band", "key", "total")).alias("k"))
    blocks = F.ceil(F.greatest(F.col("g") / BLOCK, F.col("k.total") * 8 / BLOCK_BYTES)).cast("int")
    kept = staged(kept.select("k.band", "k.key", F.least(blocks, F.col("g").cast("int")).alias("blocks")), "near-groups")
    met = staged(bands.join(broadcast_if_small(kept, 32), ["band", "key"]).select("band", "key", "blocks", "node"), "near-met")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    cut = met.withColumn("block", own)
    cut = cut.select("band", "key", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("band", "key", "node", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    unit = lambda n: F.pmod(F.xxhash64("band", "key", "bi", "bj"), F.lit(max(1, n)))

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        """The members of each unit that have a pair there."""
        out = []
        for _, group in pdf.groupby(["band", "key", "bi", "bj"], sort=False):
            regs = np.frombuffer(b"".join(group["regs"]), dtype=np.uint16).reshape(len(group), BUCKETS)
            x, y = _near(group, group["n_shingles"].to_numpy(np.float64), regs, threshold)
            out.append(group.iloc[np.unique(np.concatenate([x, y]))])
        return pd.concat(out)[list(place)]

    place = {"band": "int", "key": "long", "node": "long", "block": "int", "bi": "int", "bj": "int"}
    work = cut.withColumn("unit", unit(met.count() // UNIT_ROWS)).join(nodes.select("node", "n_shingles", "regs"), "node")
    left = work.groupBy("unit").applyInPandas(sift, ", ".join(f"{k} {v}" for k, v in place.items()))
    left = staged(left.distinct(), "near-left")
    wanted = staged(nodes.select("node", "doc_id", "tk", "n_shingles").join(left.groupBy("node").agg(F.count("*").alias("units")), "node"), "near-wanted")
    # only texts with such a pair are read again, for their full sets; of equal rows one
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _text_key(F.col("text")).alias("k"), "text")
    own = broadcast_if_small(wanted.select("node", "doc_id", "tk"), 32)
    texts = texts.join(own, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tk"))).select("node", "text").dropDuplicates(["node"])
    size = wanted.agg(F.sum(F.col("n_shingles") * F.col("units") * 8), F.sum("units")).first()
    units = max((size[0] or 0) // UNIT_BYTES, (size[1] or 0) // UNIT_ROWS)
    work = left.withColumn("unit", unit(units)).join(_sets(texts), "node")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        for _, group in pdf.groupby(["band", "key", "bi", "bj"], sort=False):
            found.update(_links_of(group, threshold))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return work.groupBy("unit").applyInPandas(verify, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b), by alternating large-star and small-star."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, "cc-edges")
        now = edges.agg(F.count("*"), *_marks("a", "b")).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def _placed(docs: DataFrame, threshold: tuple[int, int], tie: bool) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows; c1, c2, component, size of every class). tie: the texts of one doc_id are one document."""
    sig = staged(signatures(docs), "near-signatures")
    filled = sig.where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tk")
    # of equal sets the registers and sizes are equal too
    classes = filled.groupBy("c1", "c2").agg(F.min(row).alias("row"), F.count("*").alias("size"), F.max("n_shingles").alias("n_shingles"))
    classes = staged(classes.select("c1", "c2", "size", "n_shingles", "row.doc_id", "row.tk", F.monotonically_increasing_id().alias("node")), "near-classes")
    # joined on the row that stands for the class: no class, however large, meets in one task
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("c1", "c2", "doc_id", "tk")]
    joined = filled.alias("f").join(classes.alias("k"), same[0] & same[1] & same[2] & same[3])
    nodes = staged(joined.select("k.node", "k.doc_id", "k.tk", "k.n_shingles", "f.regs").dropDuplicates(["node"]), "near-nodes")
    edges = links(docs, nodes, threshold)
    if tie:
        several = filled.where("doc_id is not null").groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("doc_id")
        several = staged(several, "near-several")
        if not several.isEmpty():
            own = filled.select("doc_id", "c1", "c2").join(several, "doc_id", "left_semi").join(classes.select("c1", "c2", "node"), ["c1", "c2"])
            own = staged(own.select("doc_id", "node").distinct(), "near-tied")
            least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
            edges = edges.unionByName(own.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"))
    comp = staged(connected(staged(edges, "near-links")), "near-components")
    comp = broadcast_if_small(comp, 32)
    return sig, staged(classes.join(comp, "node", "left").select("c1", "c2", "size", "doc_id", "tk", F.coalesce("component", "node").alias("component")), "near-placed")


def components(docs: DataFrame, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sig, classes = _placed(docs, threshold, tie=True)
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = staged(classes.join(least, "component").select("c1", "c2", "size", "component_id"), "near-by-class")
    rows = sig.where("n_shingles > 0").select("doc_id", "n_shingles", "c1", "c2")
    limit = max(1, rows.count() // HOT)
    hot = F.broadcast(by_class.where(F.col("size") > limit).drop("size"))  # HOT rows at most
    out = rows.join(hot, ["c1", "c2"]).unionByName(rows.join(hot, ["c1", "c2"], "left_anti").join(by_class.where(F.col("size") <= limit).drop("size"), ["c1", "c2"]))
    out = out.select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Of each component of texts the row of least doc_id, those without one last, then by a hash of the text; texts of one
    doc_id that are not near each other are components of their own, and rows without words all stay."""
    sig, classes = _placed(docs, threshold, tie=False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tk"))
    keep = staged(classes.groupBy("component").agg(first.alias("row")).select(F.col("row.doc_id").alias("__id"), F.col("row.tk").alias("__key")), "near-kept")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__own"), _text_key(F.col("text")).alias("__tk"), F.coalesce(F.regexp("text", F.lit(WORD)), F.lit(False)).alias("__words"))
    worded = rows.where("__words").join(broadcast_if_small(keep, 16), F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__tk") == F.col("__key")), "left_semi")
    if not sig.where("n_shingles > 0").groupBy("doc_id", "tk").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        worded = worded.dropDuplicates(["__own", "__tk"])
    return worded.select("__row.*").unionByName(rows.where("not __words").select("__row.*"))


def oracle(threshold: tuple[int, int] = (85, 100)) -> str:
    """The rows of components in DuckDB, which compares all pairs that share a shingle; for doc_ids that are neither null nor
    repeated."""
    num, den = threshold
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {den} * common >= {num} * (x.n + y.n - common)),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached(node, root) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d JOIN least ON node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
