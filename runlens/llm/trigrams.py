"""Boolean trigram queries of regular expressions.

A query is in disjunctive form: a list of clauses, each a set of trigrams that a
matching text must hold together.  ``[frozenset()]`` (one empty clause) says
nothing: the rule has no mandatory trigram.  Literals are lower-cased, so the
index is over lower-cased text; that only adds candidates.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

ANY = [frozenset()]
MOST_STRINGS, MOST_CLAUSES = 64, 64


def _product(a, b):
    return {x + y for x in a for y in b}


def _exact(items) -> set[str] | None:
    """All strings that a sequence of regex nodes can match, if they are few."""
    out = {""}
    for op, arg in items:
        one = _exact_one(op, arg)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = _product(out, one)
    return out


def _exact_one(op, arg) -> set[str] | None:
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        chars = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars
    if op is C.SUBPATTERN:
        return _exact(arg[-1])
    if op is C.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is C.AT:
        return {""}
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
        inner = _exact(arg[2])
        if inner is None:
            return None
        out, power = set(), {""}
        for k in range(int(arg[1]) + 1):
            if k >= arg[0]:
                out |= power
            power = _product(power, inner)
            if len(power) > MOST_STRINGS * 4:
                return None
        return out
    return None


def _of_strings(strings: set[str]):
    clauses = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
    return _least(clauses)


def _least(clauses):
    """Without clauses that hold another one."""
    found = set(clauses)
    return sorted((c for c in found if not any(o < c for o in found)), key=sorted)


def _and(a, b):
    if len(a) * len(b) > MOST_CLAUSES:
        return a if len(a) >= len(b) else b
    return _least([x | y for x in a for y in b])


def _query(items):
    out, run = ANY, {""}
    for op, arg in items:
        one = _exact_one(op, arg)
        if one is not None and len(one) * len(run) <= MOST_STRINGS:
            run = _product(run, one)
            continue
        out, run = _and(out, _of_strings(run)), {""}
        if one is not None:
            run = one
        elif op is C.SUBPATTERN:
            out = _and(out, _query(arg[-1]))
        elif op is C.BRANCH:
            out = _and(out, _least([c for x in arg[1] for c in _query(x)]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            out = _and(out, _query(arg[2]))
    return _and(out, _of_strings(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    return _query(_parser.parse(pattern))


def needed(patterns: list[str]) -> list[str]:
    """Every trigram that the queries of the patterns name."""
    return sorted({t for p in patterns for clause in trigram_query(p) for t in clause})


def admits(pattern: str, text: str) -> bool:
    """Whether the query of ``pattern`` lets ``text`` through (for tests)."""
    low = text.lower()
    return any(all(t in low for t in clause) for clause in trigram_query(pattern))


