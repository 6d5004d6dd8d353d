"""Boolean trigram queries derived from regular expressions.

A query is None (any text may match) or a set of alternatives, each a set of trigrams that must all be present. Every
text that the expression matches fulfils the query, on lower-cased trigrams; the converse need not hold. Each part of
the expression yields the exact strings it can match, while they are few, or else the possible heads and tails of its
matches besides a query; joining two parts adds the trigrams that straddle the seam."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

#: Bounds on the sets that are followed; beyond them a part counts as unknown, which only weakens the query.
MOST_STRINGS, MOST_CLASS, MOST_ALTERNATIVES = 48, 8, 48

Query = frozenset[frozenset[str]] | None


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _of_strings(strings: frozenset[str]) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _lean(frozenset(trigrams(s) for s in strings))


def _lean(q: Query) -> Query:
    """Without alternatives that another one implies."""
    if q is None:
        return None
    return None if len(q) > MOST_ALTERNATIVES else frozenset(a for a in q if not any(b < a for b in q))


def both(p: Query, q: Query) -> Query:
    if p is None or q is None:
        return q if p is None else p
    joined = _lean(frozenset(a | b for a, b in product(p, q)))
    return joined if joined is not None else min(p, q, key=len)


def either(p: Query, q: Query) -> Query:
    return None if p is None or q is None else _lean(p | q)


@dataclass(frozen=True)
class _Part:
    exact: frozenset[str] | None
    head: frozenset[str]
    tail: frozenset[str]
    query: Query = None

    def open(self) -> _Part:
        """Without exact strings: what they demand goes to the query."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:3] for s in self.exact), frozenset(s[-3:] for s in self.exact), both(self.query, _of_strings(self.exact)))


_EMPTY = _Part(frozenset([""]), frozenset([""]), frozenset([""]))
_ANY = _Part(None, frozenset([""]), frozenset([""]))


def _few(strings: frozenset[str], cut) -> frozenset[str]:
    return strings if len(strings) <= MOST_STRINGS else frozenset([""]) if cut else strings


def _then(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_STRINGS:
        return _Part(frozenset(a + b for a, b in product(x.exact, y.exact)), frozenset(), frozenset(), both(x.query, y.query))
    a, b = x.open(), y.open()
    seam = None
    if len(a.tail) * len(b.head) <= MOST_STRINGS:
        seam = _of_strings(frozenset(s[-2:] + t[:2] for s, t in product(a.tail, b.head)))
    head = frozenset((s + t)[:3] for s, t in product(x.exact, b.head)) if x.exact is not None else a.head
    tail = frozenset((s + t)[-3:] for s, t in product(a.tail, y.exact)) if y.exact is not None else b.tail
    return _Part(None, _few(head, True), _few(tail, True), both(both(a.query, b.query), seam))


def _or(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST_STRINGS:
        return _Part(x.exact | y.exact, frozenset(), frozenset(), either(x.query, y.query) if x.query != y.query else x.query)
    a, b = x.open(), y.open()
    return _Part(None, _few(a.head | b.head, True), _few(a.tail | b.tail, True), either(a.query, b.query))


def _characters(items) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            out.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < 64:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= MOST_CLASS else None


def _part(parsed) -> _Part:
    whole = _EMPTY
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            c = frozenset([chr(value).lower()])
            part = _Part(c, c, c)
        elif name == "IN":
            c = _characters(value)
            part = _ANY if c is None else _Part(c, c, c)
        elif name == "SUBPATTERN":
            part = _part(value[-1])
        elif name == "BRANCH":
            options = [_part(p) for p in value[1]]
            part = options[0]
            for p in options[1:]:
                part = _or(part, p)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            one = _part(inner)
            part = _EMPTY
            for _ in range(min(least, 8)):
                part = _then(part, one)
            if most != least or least > 8:
                rest = _or(_EMPTY, one) if (least, most) == (0, 1) else _ANY
                part = _then(part, rest)
        elif name == "AT":
            part = _EMPTY
        else:
            part = _ANY
        whole = _then(whole, part)
    return whole


def query_of(pattern: str) -> Query:
    """The trigram query of a regular expression in the syntax that Python and Java share."""
    return _part(re._parser.parse(pattern)).open().query


def fulfils(text: str, query: Query) -> bool:
    """Whether text holds what the query asks for."""
    low = text.lower()
    return query is None or any(all(t in low for t in a) for a in query)
