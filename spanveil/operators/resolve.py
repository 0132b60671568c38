"""Conflict resolution between candidate spans of one text, row-local."""

from __future__ import annotations

from ..functions.spans import count_while
from .detectors import CANDIDATE_TYPE

CLAIMS_TYPE = "array<struct<s:int,e:int>>"


def overlapped(claims: str, start: str, end: str) -> str:
    """SQL for whether ``[start, end)`` overlaps one of some claims, which are in order and apart from each other.

    Of the claims that begin before the end, the last reaches furthest.
    """
    return f"""transform(array({count_while(claims, f"__x.s < {end}")}), __n ->
        __n > 0 AND get({claims}, __n - 1).e > {start})[0]"""


#: Claims made beforehand may overlap each other: joined to stretches, with a growing state only for them.
_JOINED = f"""aggregate(
    array_sort(transform(filter(found, c -> c.rank = 0), c -> named_struct('s', c.start, 'e', c.end))),
    CAST(array() AS {CLAIMS_TYPE}),
    (acc, c) -> CASE WHEN size(acc) > 0 AND c.s < element_at(acc, -1).e
        THEN slice(acc, 1, size(acc) - 1) || array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, c.e)))
        ELSE acc || array(c) END)"""

#: Within a pass, what overlaps the one kept before it goes; seldom needed, as its matches are apart.
_APART = f"""CASE WHEN exists(transform(fresh, (c, i) -> coalesce(c.check_start < get(fresh, i - 1).end, false)), x -> x)
    THEN aggregate(fresh, CAST(array() AS {CANDIDATE_TYPE}), (acc, c) -> CASE
        WHEN size(acc) > 0 AND c.check_start < element_at(acc, -1).end AND c.end > element_at(acc, -1).start THEN acc ELSE acc || array(c) END)
    ELSE fresh END"""

#: One pass after another: its candidates that overlap no claim are kept and claim their spans.
_BY_PASS = f"""aggregate(
    array_sort(array_distinct(transform(filter(found, c -> c.rank > 0), c -> c.rank))),
    named_struct('claims', {_JOINED}, 'kept', filter(found, c -> c.rank = 0)),
    (acc, r) -> transform(
        transform(array(array_sort(filter(found, c -> c.rank = r AND NOT {overlapped('acc.claims', 'c.check_start', 'c.end')}))), fresh -> {_APART}),
        fresh -> named_struct(
            'claims', CASE WHEN size(fresh) = 0 THEN acc.claims ELSE array_sort(acc.claims || transform(fresh, c -> named_struct('s', c.start, 'e', c.end))) END,
            'kept', acc.kept || fresh))[0],
    acc -> array_sort(acc.kept))"""


def resolve(candidates: str) -> str:
    """SQL that keeps candidates in rank order, dropping each that overlaps one already kept.

    Where no two neighbours touch, all stay.  Else the passes go in order; the claims of earlier ones are a
    sorted array without overlaps, in which a candidate looks up the only claim that it can overlap.  So
    k candidates cost about k log k, however they touch.  Candidates of rank 0 are claims made
    beforehand: they are always kept.  The result is in text order.
    """
    touching = "exists(transform(found, (c, i) -> coalesce(c.check_start < get(found, i - 1).end, false)), x -> x)"
    return f"""CASE WHEN size({candidates}) > 1
        THEN transform(array(array_sort({candidates})), found -> CASE WHEN {touching} THEN {_BY_PASS} ELSE found END)[0]
        ELSE {candidates} END"""
