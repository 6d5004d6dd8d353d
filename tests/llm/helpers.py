"""Plain versions of the operators, for small tables."""

import hashlib
import html
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0d]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def table(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCUMENTS)


def clashing(df):
    """df with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "target", "h", "sk", "piece", "start", "length", "offset", "key", "node", "score", "kept", "range", "bucket", "shard", "payload", "host", "n", "unit", "spans", "component_id", "regs", "held_out", "digest", "taken", "rules"]
    return df.withColumns({c: F.lit("clash") for c in names})


def shingles(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, num=85, den=100):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = [("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def base_spans(text):
    out = []
    for k, (kind, p, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end(), kind) for m in p.finditer(text or "") if len(m[group]) >= least]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def quality(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def edited(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    return out


def archive(rows):
    pay = {p: (h or "").encode() for p, h in rows}
    largest = defaultdict(int)
    for p, b in pay.items():
        largest[b] = max(largest[b], p)
    out = set()
    for p, b in pay.items():
        again = len(b) >= 1000 and largest[b] != p
        out.add((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", largest[b] if again else None))
    return out


unescape = html.unescape
