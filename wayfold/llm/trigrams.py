"""Boolean trigram queries derived from regular expressions.

A query is ``True`` (no trigram is mandatory), a trigram, or a tuple
``("and" | "or", queries)``. Any text that the expression matches meets its
query over the trigrams of the lower-cased text, so the query may only
discard texts. Lower case serves both kinds of rules: it can only add texts.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

MOST = 32


def _both(kind: str, parts: list):
    flat = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat += p[1]
        else:
            flat.append(p)
    flat = sorted(set(flat), key=str)
    if kind == "or":  # a clause that asks for more than another adds nothing
        needs = [frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat]
        flat = [p for p, n in zip(flat, needs, strict=True) if not any(m < n for m in needs)]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def of_strings(strings: set[str]):
    """Some one of the strings occurs."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else True


def _exact(tree) -> set[str] | None:
    """All strings the tree can match, if they are few."""
    out = {""}
    for op, arg in tree:
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            own = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            own = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(t) for t in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
            once = _exact(arg[2])
            own = None if once is None else _repeated(once, arg[0], arg[1])
        else:
            own = None
        if own is None or len(out) * len(own) > MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def _repeated(strings: set[str], least: int, most: int) -> set[str] | None:
    """Strings of ``least`` to ``most`` of ``strings`` in a row, if they are few."""
    power, out = {""}, {""} if least == 0 else set()
    for n in range(1, most + 1):
        power = {a + b for a in power for b in strings}
        if len(power) > MOST:
            return None
        if n >= least:
            out |= power
    return out


def _query(tree):
    parts, run = [], {""}
    for item in tree:
        own = _exact([item])
        if own is not None and len(run) * len(own) <= MOST:
            run = {a + b for a in run for b in own}
            continue
        parts.append(of_strings(run))
        run = {""} if own is None else own
        op, arg = item
        if own is None and op is C.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif own is None and op is C.BRANCH:
            parts.append(_both("or", [_query(t) for t in arg[1]]))
        elif own is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _both("and", [*parts, of_strings(run)])


def _thin(q, most: int):
    """The same query with at most ``most`` of each conjunction's trigrams, spread over them: weaker, so still met by every match."""
    if q is True or isinstance(q, str):
        return q
    parts = [_thin(x, most) for x in q[1]]
    if q[0] == "and":
        plain = [x for x in parts if isinstance(x, str)]
        step = max(1, -(-len(plain) // most))
        parts = [x for x in parts if not isinstance(x, str)] + plain[::step]
    return _both(q[0], parts)


def query(pattern: str, most: int = 3):
    """The trigram query of a regular expression."""
    return _thin(_query(_parser.parse(pattern, re.DOTALL)), most)


def trigrams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))
