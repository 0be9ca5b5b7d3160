"""Boolean trigram queries from regular expressions.

A query is a set of clauses, each a set of trigrams in lower case: a text that the
expression matches holds all trigrams of at least one clause. The empty clause stands
for every text: such an expression has no mandatory trigram.
"""

from __future__ import annotations

import re
from itertools import product

Query = frozenset[frozenset[str]]

ANY: Query = frozenset([frozenset()])
# Beyond these, a weaker query is used; it still finds every match.
MAX_STRINGS = 64
MAX_CLAUSES = 64

_ops = re._constants


def _absorbed(clauses) -> Query:
    """Without clauses that ask for all that another one asks for, and more."""
    kept: list[frozenset[str]] = []
    for clause in sorted(set(clauses), key=len):
        if not any(k <= clause for k in kept):
            kept.append(clause)
    return frozenset(kept) if len(kept) <= MAX_CLAUSES else ANY


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_CLAUSES**2:
        return min(a, b, key=len)
    joined = _absorbed(x | y for x, y in product(a, b))
    return joined if joined != ANY else (a if b == ANY else b)


def either(a: Query, b: Query) -> Query:
    return _absorbed(a | b)


def _of_strings(strings: frozenset[str]) -> Query:
    return _absorbed(
        frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings
    )


def _class(items) -> frozenset[str] | None:
    """The characters of a small class in lower case, or None."""
    found: set[str] = set()
    for op, arg in items:
        if op is _ops.LITERAL:
            found.add(chr(arg).lower())
        elif op is _ops.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _one(op, arg) -> tuple[frozenset[str] | None, Query]:
    """All strings that one element can match if they are few, else None; and its query."""
    if op is _ops.LITERAL:
        return frozenset([chr(arg).lower()]), ANY
    if op is _ops.IN:
        return _class(arg), ANY
    if op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
        return frozenset([""]), ANY
    if op is _ops.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _ops.BRANCH:
        strings, query = frozenset(), frozenset()
        for branch in arg[1]:
            some, asks = _sequence(branch)
            strings = strings | some if strings is not None and some is not None else None
            query |= _of_strings(some) if some is not None else asks
        if strings is not None and len(strings) <= MAX_STRINGS:
            return strings, ANY
        return None, _absorbed(query)
    if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT):
        low, high, inner = arg
        some, asks = _sequence(inner)
        if (low, high) == (0, 1) and some is not None:
            return some | {""}, ANY
        if low == 0:
            return None, ANY
        if some is not None and len(some) ** low <= MAX_STRINGS:
            whole = frozenset("".join(p) for p in product(some, repeat=low))
            return (whole, ANY) if low == high else (None, _of_strings(whole))
        return None, asks
    return None, ANY


def _sequence(elements) -> tuple[frozenset[str] | None, Query]:
    exact, run, query = True, frozenset([""]), ANY
    for op, arg in elements:
        strings, asks = _one(op, arg)
        if strings is None or len(run) * len(strings) > MAX_STRINGS:
            query, exact = both(query, both(_of_strings(run), asks)), False
            run = strings if strings is not None else frozenset([""])
        else:
            run = frozenset(a + b for a, b in product(run, strings))
    return (run, ANY) if exact else (None, both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The trigrams that any text has in which ``pattern`` is found."""
    strings, query = _sequence(re._parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query
