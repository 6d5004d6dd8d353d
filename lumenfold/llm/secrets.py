"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (trigram_query.py). The index holds, for every trigram that
some rule asks for and every block of about BLOCK documents, the documents with that trigram. A block's postings are
intersected within each alternative of a query and united over its alternatives; what is left are the rule's candidates,
and only these texts meet the rule's expression. Rules without mandatory trigrams, such as a run of hexadecimal digits,
scan every text.

Only texts that hold the rarest trigram of some alternative get postings. Positions come from the lengths of the matches and of the texts between them, in code points, end exclusive.

Rules besides the three base ones add spans: private_key, github, slack, jwt.

Defined results: a null text counts as empty and has no spans; the digest of no spans is that of the empty string;
spans of different rules may overlap and are all listed; rows that repeat a doc_id are scanned each; an empty table
gives no rows. `redacted` carries other columns along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, staged
from .trigram_query import query_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 or more, which are the base rule's runs that count
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
BLOCK = 4096
#: Characters by falling frequency; a rough order is enough.
COMMON = "etaoinshrdlucmfwypvbgkjqxz"
#: Matches of a text that are summed up together.
RUN = 64
MASK = "[secret]"


def _key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id)


def _gate(trigrams: frozenset[str]) -> str:
    """The trigram of the rarest characters, of those that an alternative asks for together."""
    rank = lambda c: COMMON.find(c) if c in COMMON else len(COMMON)
    return max(sorted(trigrams), key=lambda t: sum(map(rank, t)))


def index(docs: DataFrame, rules=RULES, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """trigram, block, postings (keys of the documents that hold it). Unless whole, documents that hold no alternative's
    gate, the rarest of its trigrams, are left out: they can't be candidates of these rules. whole: an index that any rules
    with these trigrams can use."""
    asked = [a for r in rules for a in query_of(r.pattern) or ()]
    wanted, gates = sorted({t for a in asked for t in a}), sorted({_gate(a) for a in asked})
    rows = docs.select(_key(F.col("doc_id")).alias("key"), F.lower("text").alias("low"))
    if not whole:
        rows = rows.where(let(F.col("low"), lambda low: F.exists(F.array(*[F.lit(g) for g in gates]), lambda g: F.contains(low, g))) if gates else F.lit(False))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    # exploded as it is: a filter on it would compute it a second time
    pairs = staged(rows.select("key", F.explode(held).alias("trigram")), "secret-pairs")
    blocks = max(1, pairs.count() // (block * 4))
    return pairs.groupBy("trigram", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_set("key").alias("postings"))


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """key, rules: the kinds whose trigram query the document fulfils; only for rules that have one."""
    held = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("held"))
    found = []
    for r in rules:
        if (q := query_of(r.pattern)) is None:
            continue
        union = None
        for need in sorted(q, key=sorted):
            lists = [F.coalesce(F.element_at("held", F.lit(t)), F.array().cast("array<bigint>")) for t in sorted(need)]
            both = lists[0]
            for x in lists[1:]:
                both = F.array_intersect(both, x)
            union = both if union is None else F.array_union(union, both)
        found.append(F.struct(F.lit(r.kind).alias("rule"), union.alias("keys")))
    per = held.select(F.explode(F.array(*found)).alias("f")).select("f.rule", F.explode("f.keys").alias("key"))
    return per.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in text: an array of (start, order, end, kind)."""
    kind = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
    pattern = F.lit(rule.pattern)
    cut = F.struct(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("match"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
    )

    def walk(c: Column) -> Column:
        n = F.size(c["match"])
        total = lambda array, at, count: F.aggregate(F.slice(array, at + 1, count), F.lit(0).cast("long"), lambda a, x: a + x)
        # where runs of RUN matches begin, so that no place is summed up from the text's first match on
        runs = F.aggregate(
            F.sequence(F.lit(0), ((n - 1) / RUN).cast("int")),
            F.array(F.lit(0).cast("long")),
            lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + total(c["gap"], r * RUN, F.lit(RUN)) + total(c["match"], r * RUN, F.lit(RUN)))),
        )

        def place(runs: Column) -> Column:
            def span(i: Column) -> Column:
                r = (i / RUN).cast("int")
                start = runs[r] + total(c["gap"], r * RUN, i - r * RUN + 1) + total(c["match"], r * RUN, i - r * RUN)
                return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + c["match"][i]).alias("end"), F.lit(rule.kind).alias("kind"))

            return F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: c["value"][i] >= rule.least), span)

        return let(runs, place)

    return F.when(F.regexp(text, pattern), let(cut, walk)).otherwise(F.array().cast(kind))


def scanned(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs as a struct __row, with __spans: all spans, by start, then by rule as listed, then by end."""
    found = staged(candidates(staged(index(docs, rules), "secret-index"), rules), "secret-candidates")
    rows = docs.select(F.struct("*").alias("__row"), _key(F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.join(broadcast_if_small(found, 128), "key", "left")
    spans = []
    for k, r in enumerate(rules):
        each = _spans(F.col("__text"), r, k)
        if query_of(r.pattern) is not None:
            each = F.when(F.array_contains("rules", r.kind), each).otherwise(F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>"))
        spans.append(each)
    return rows.select("__row", "__text", F.sort_array(F.concat(*spans)).alias("__spans"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secrets_of(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    base = F.filter("__spans", lambda s: s["order"] < len(BASE))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["order"] == k)).cast("long")
    return scanned(docs.select("doc_id", "text"), rules).select(
        F.col("__row.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("__spans")).alias("spans"),
    )


def redacted(docs: DataFrame, rules=RULES, mask: str = MASK) -> DataFrame:
    """The rows of docs, with every span, or run of overlapping spans, of text replaced by mask and n_chars to match."""
    text = F.col("__text")

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    init = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.char_length(text)))
    rows = scanned(docs, rules).withColumn("__clean", F.when(F.size("__spans") > 0, F.aggregate("__spans", init, step, done)))
    changed = {"text": F.coalesce("__clean", "__row.text"), "n_chars": F.when(F.col("__clean").isNull(), F.col("__row.n_chars")).otherwise(F.char_length("__clean").cast("long"))}
    return rows.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def oracle(rules=RULES) -> str:
    """The rows of secrets_of in DuckDB, which scans every text with every rule."""
    parts = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT id, {k} AS o, '{r.kind}' AS kind, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS g, "
            f"list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS m, list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x)) AS v FROM docs) WHERE len(m) > 0"
        )
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT id, o, kind, CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i-1]), 0) AS BIGINT) AS s, CAST(list_sum(g[1:i]) + list_sum(m[1:i]) AS BIGINT) AS e
  FROM found WHERE v[i] >= CASE o {least} END),
per AS (
  SELECT id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < {len(BASE)}), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans
  FROM placed GROUP BY id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per USING (id)
"""
