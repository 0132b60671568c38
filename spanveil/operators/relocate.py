"""Finding earlier findings again in an edited copy of their text, row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import count_while, with_computed
from .resolve import CLAIMS_TYPE, overlapped

MOVED_TYPE = "array<struct<start:int,end:int,type:string,text:string>>"
# Findings that share one copy of the text that is left, and one sorting of the places taken.
GROUP = 256


def _grouped(findings: str) -> str:
    """SQL for the findings in groups of ``GROUP``, in order."""
    return f"""transform(sequence(0, (size({findings}) - 1) div {GROUP}), g -> slice({findings}, g * {GROUP} + 1, {GROUP}))"""


def relocate_ordered(df: DataFrame, findings: str, new_text: str, out: str = "moved") -> DataFrame:
    """Look for each finding from the end of the previous one on, left to right.

    The result is null as soon as one finding is missing.  A group of findings looks through the
    text from where the last group ended, so finding the way to a place costs no more than a group.
    The text that is left is no part of a state, which would be copied at each step.
    """
    moved = "named_struct('start', acc.pos + h - 1, 'end', acc.pos + h - 1 + length(f.text), 'type', f.type, 'text', f.text)"
    group = f"""transform(array(substring({new_text}, acc.pos + 1)), rest -> aggregate(fs,
        named_struct('pos', 0, 'found', true, 'moved', CAST(array() AS {MOVED_TYPE})),
        (inner, f) -> CASE WHEN inner.found THEN transform(array(locate(f.text, rest, inner.pos + 1)), h -> CASE WHEN h > 0
                THEN named_struct('pos', h - 1 + length(f.text), 'found', true, 'moved', inner.moved || array({moved}))
                ELSE named_struct('pos', inner.pos, 'found', false, 'moved', inner.moved) END)[0]
            ELSE inner END))[0]"""
    body = f"""CASE WHEN size({findings}) = 0 THEN CAST(array() AS {MOVED_TYPE}) ELSE transform(array(array_sort({findings})), sorted -> aggregate(
        {_grouped('sorted')},
        named_struct('pos', 0, 'found', true, 'groups', CAST(array() AS array<{MOVED_TYPE}>)),
        (acc, fs) -> CASE WHEN acc.found
            THEN transform(array({group}), g -> named_struct('pos', acc.pos + g.pos, 'found', g.found, 'groups', acc.groups || array(g.moved)))[0]
            ELSE acc END,
        acc -> CASE WHEN acc.found THEN flatten(acc.groups) END))[0] END"""
    return with_computed(df, out, body)


def relocate_first(
    df: DataFrame, findings: str, old_text: str, new_text: str, out: str = "moved",
    collapsed: str = "collapsed",
) -> DataFrame:
    """Look for the first occurrence of each finding; missing ones are dropped.

    An unchanged text keeps its findings.  Findings that land on text already taken by an
    earlier one are left out and counted in ``collapsed``.  Each distinct text is looked for once, from
    the beginning: that costs the number of distinct texts times the places of their first occurrences.
    Places taken are a sorted array, brought up to date once a group of findings.
    """
    same = "named_struct('start', f.start, 'end', f.start + length(f.text), 'type', f.type, 'text', f.text)"
    needles = f"array_sort(array_distinct(transform({findings}, f -> f.text)))"
    places = f"transform({needles}, n -> named_struct('text', n, 'at', locate(n, {new_text}) - 1))"
    at = f"get(__places, {count_while('__places', '__x.text < f.text')}).at"
    moved = f"""transform(filter(transform(array_sort({findings}), f -> named_struct('f', f, 'at', {at})), m -> m.at >= 0),
        m -> named_struct('start', m.at, 'end', m.at + length(m.f.text), 'type', m.f.type, 'text', m.f.text))"""
    taken = f"(exists(inner, k -> f.end > k.start AND f.start < k.end) OR {overlapped('acc.claims', 'f.start', 'f.end')})"
    body = f"""CASE WHEN {old_text} = {new_text} THEN transform({findings}, f -> {same})
        WHEN size(__moved) = 0 THEN CAST(array() AS {MOVED_TYPE})
        ELSE aggregate(
            {_grouped('__moved')},
            named_struct('claims', CAST(array() AS {CLAIMS_TYPE}), 'groups', CAST(array() AS array<{MOVED_TYPE}>)),
            (acc, fs) -> transform(
                array(aggregate(fs, CAST(array() AS {MOVED_TYPE}), (inner, f) -> CASE WHEN {taken} THEN inner ELSE inner || array(f) END)),
                kept -> named_struct(
                    'claims', array_sort(acc.claims || transform(kept, f -> named_struct('s', f.start, 'e', f.end))),
                    'groups', acc.groups || array(kept)))[0],
            acc -> array_sort(flatten(acc.groups))) END"""
    present = f"CASE WHEN {old_text} = {new_text} THEN size({findings}) ELSE size(__moved) END"
    df = with_computed(df, "__places", f"CASE WHEN {old_text} = {new_text} THEN array() ELSE {places} END")
    df = with_computed(df, "__moved", f"CASE WHEN {old_text} = {new_text} THEN CAST(array() AS {MOVED_TYPE}) ELSE {moved} END")
    return with_computed(df, out, body).withColumn(collapsed, F.expr(f"{present} - size({out})")).drop("__places", "__moved")


def relocate_one(df: DataFrame, finding: str, new_text: str, out: str = "moved") -> DataFrame:
    """Keep one finding's place if the text there is unchanged, else take its first
    occurrence, else null."""
    f = finding
    place = f"""CASE
        WHEN substring({new_text}, {f}.start + 1, {f}.end - {f}.start) = {f}.text THEN {f}.start
        WHEN locate({f}.text, {new_text}) > 0 THEN locate({f}.text, {new_text}) - 1 END"""
    body = f"""transform(array({place}), at -> CASE WHEN at IS NOT NULL THEN named_struct(
        'start', at, 'end', at + length({f}.text), 'type', {f}.type, 'text', {f}.text) END)[0]"""
    return with_computed(df, out, body)


def choose_copy(df: DataFrame, source: str, pasted: str, live: str, out: str = "chosen") -> DataFrame:
    """Which of two copies of a text to scan, and whether the live copy has caught up.

    A paste is scanned from the clipboard while the live copy holds less than 80 % of it.
    ``caught_up`` is true once the live copy holds 90 % of the scanned text.
    """
    behind = (
        (F.col(source) == "paste")
        & (F.length(pasted) > 0)
        & (F.length(live) < F.length(pasted) * F.lit(0.8))
    )
    chosen = F.when(behind | (F.length(live) == 0), F.col(pasted)).otherwise(F.col(live))
    return df.withColumn(out, chosen).withColumn(
        "caught_up", F.length(live) >= F.length(out) * F.lit(0.9)
    )
