"""The detector registry: one declarative entry per recognition pass.

A pass is a pattern, the widths of its context windows, a cheap guard that tells whether a
text can match at all, and a score.  The score is a SQL expression over one match ``m``
(``m.text``, ``m.before``, ``m.after``, ``m.start``, ``m.end``) giving a confidence, or null
to reject the match.  Passes run in order: where two passes hit overlapping text, the
earlier one wins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from ..functions import checks, lexicons
from ..functions import patterns as P
from ..functions.spans import matches, one_of, quoted

CANDIDATE_TYPE = (
    "array<struct<check_start:int,rank:int,start:int,end:int,type:string,text:string,"
    "confidence:double>>"
)
AROUND = "(m.before || m.text || m.after)"


@dataclass(frozen=True)
class Detector:
    """One recognition pass.  ``guards`` are patterns a text must contain to be scanned."""

    rank: int
    type: str
    pattern: str
    score: str
    guards: tuple[str, ...] = ()
    # A pattern implied by the guards and shared by many passes; tested once for all of them.
    gate: str = ""
    before: int = 0
    after: int = 0
    # Characters dropped from the front of the match; the overlap test keeps the whole match.
    cut: str = "0"
    # Text after the match that joins the finding.
    extension: str = "''"
    # Named values derived from the match, one step after another, as ``v.<name>``.
    values: tuple[dict[str, str], ...] = ()

    def candidates(self, text: str) -> str:
        """SQL for the scored candidates in one text; rejected ones have a null confidence."""
        found = matches(text, self.pattern, self.before, self.after)
        fields = {name: f"m.{name}" for name in ("start", "end", "text", "before", "after")}
        for step in self.values:
            built = ", ".join(f"'{name}', {sql}" for name, sql in {**fields, **step}.items())
            found = f"transform({found}, m -> named_struct({built}))"
            fields |= {name: f"m.{name}" for name in step}
        scored = f"""transform({found}, m -> named_struct(
            'check_start', m.start, 'rank', {self.rank}, 'start', m.start + {self.cut},
            'end', m.end + length({self.extension}), 'type', {quoted(self.type)},
            'text', substring(m.text, {self.cut} + 1) || {self.extension},
            'confidence', CAST({self.score} AS double)))"""
        return _if_found(text, self.guards, scored)


def _if_found(text: str, patterns: Sequence[str], then: str) -> str:
    """``then`` for a text that holds every pattern, else no candidates."""
    tests = [
        f"contains({text}, {quoted(p)})" if re.fullmatch(r"[\w@ ]+", p) else _rlike(text, p)
        for p in patterns
        if p
    ]
    if not tests:
        return then
    return f"CASE WHEN {' AND '.join(tests)} THEN {then} ELSE CAST(array() AS {CANDIDATE_TYPE}) END"


def all_candidates(text: str, detectors: Sequence[Detector]) -> str:
    """SQL for every accepted match of every pass in one text, conflicts still in."""
    by_gate = groupby(sorted(detectors, key=lambda d: d.gate), key=lambda d: d.gate)
    groups = [
        _if_found(text, (gate,), f"concat({', '.join(d.candidates(text) for d in passes)})")
        for gate, passes in by_gate
    ]
    return f"filter(concat({', '.join(groups)}), c -> c.confidence IS NOT NULL)"


def _rlike(x: str, pattern: str) -> str:
    return f"({x} RLIKE {quoted(pattern)})"


def _cases(*cases: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}D" for test, value in cases) + " END"


def _needs(context: str, value: float) -> str:
    return _cases((_rlike(AROUND, context), value))


def _birth(year_at: int) -> str:
    return _cases(
        (_rlike(AROUND, P.BIRTH_CONTEXT), 0.97),
        (checks.plausible_birth_year(f"substring(m.text, {year_at}, 4)"), 0.78),
    )


def _nhs() -> str:
    return _cases(
        (f"m.valid AND {_rlike('m.before', P.NHS_CONTEXT)}", 0.99),
        ("m.valid", 0.85),
        (_rlike("m.before", P.NHS_LABEL), 0.75),
    )


def _word_pairs(names: Sequence[str], known: str | None) -> Detector:
    """Capitalised word pairs and triples, judged by their words and surroundings.

    A leading salutation is cut off and counts as context.  ``known`` names an array column that
    holds the text's given names; without it, ``names`` are the given names.
    """
    never = lexicons.FALSE_POSITIVES

    def any_word(words: str, terms: Sequence[str]) -> str:
        return f"exists({words}, w -> {one_of('w', terms)})"

    usable = f"""(NOT {one_of('m.lower', never)} AND NOT forall(m.words, w -> {one_of('w', never)})
        AND NOT {any_word('m.own', never)}
        AND NOT (size(m.own) = 2 AND {any_word('m.own', lexicons.COMMON_WORDS)})
        AND (m.known OR NOT {one_of('m.own[0]', lexicons.NON_NAME_STARTERS)}))"""
    return Detector(
        24, "name", P.NAME_WORDS,
        score=f"CASE WHEN {usable} THEN " + _cases(
            ("m.known AND m.context", 0.92),
            ("m.context", 0.88),
            (_rlike("m.after", P.NAME_LABEL_AFTER), 0.85),
            ("m.known", 0.78),
        ) + " END",
        guards=(rf"[{P.UPPER}][{P.LOWER}]+[ \t]+[{P.UPPER}][{P.LOWER}]",),
        before=40, after=30, cut="m.cut",
        values=(
            {"lower": "lower(m.text)"},
            {"words": r"split(m.lower, '[ \t]+')"},
            {"salutation": one_of("m.words[0]", lexicons.SALUTATIONS)},
            {"cut": "CASE WHEN m.salutation THEN instr(m.text, ' ') ELSE 0 END"},
            {"own": r"CASE WHEN m.cut > 0 THEN split(substring(m.lower, m.cut + 1), '[ \t]+') ELSE m.words END"},
            {
                "known": f"array_contains(`{known}`, m.own[0])" if known else one_of("m.own[0]", names) if names else "false",
                "context": f"(m.salutation OR {_rlike('m.before', P.NAME_CONTEXT)})",
            },
        ),
    )


def _capital_words() -> Detector:
    never, common = lexicons.FALSE_POSITIVES, lexicons.COMMON_WORDS
    return Detector(
        25, "name", P.NAME_CAPITALS,
        score=_cases((
            f"NOT {one_of('m.lower', never)}"
            f" AND NOT exists(split(m.lower, '[ \\t]+'), w -> {one_of('w', (*never, *common))})"
            f" AND {_rlike('m.before', P.NAME_CONTEXT)}", 0.85)),
        guards=(rf"[{P.UPPER}]{{2}}[ \t]+[{P.UPPER}]{{2}}",),
        before=50,
        values=({"lower": "lower(m.text)"},),
    )


def default_detectors(given_names: Sequence[str] | None = None, known: str | None = None) -> list[Detector]:
    """The 25 passes in priority order: specific identifiers first, names last."""
    names = lexicons.inline_names(given_names)
    S = P.SP
    # Six digits, at most one separator between neighbours: all numbers longer than a year.
    six = rf"\d(?:[{S}\-./]?\d){{5}}"
    digit = r"\d"
    pair_run = r"\d{2}[ \t\-]\d{2}[ \t\-]\d{2}"
    bank = r"[SsAaBbFf](?i:ort|ccount|ank|acs|aster)"
    travel = r"[PpTtMm](?i:assport|ravel|rz)"
    licence = r"\d{6}[A-Z]{2}[0-9A-Z][A-Z]{2}"
    bare = {"digits": checks.digits_only("m.text")}
    valid_nhs = (bare, {"valid": checks.nhs_check("m.text", "m.digits")})
    valid_ni = (
        {"valid": checks.ni_prefix_check("m.text"), "context": _rlike(AROUND, P.NI_CONTEXT)},
    )
    ip_kind = ({"kind": checks.ip_class("m.text")},)
    valid_card = checks.card_check("m.text", "m.digits")
    card = _cases((valid_card, 0.95))
    long_card = _cases((f"length(m.digits) >= 17 AND {valid_card}", 0.95))
    licence_score = _cases(
        (f"{checks.licence_date_check('m.text')} AND {_rlike(AROUND, P.LICENCE_CONTEXT)}", 0.95)
    )
    phone = (
        f"CASE WHEN length({checks.phone_national('m.text')}) = 11 THEN "
        + _cases((_rlike(AROUND, P.PHONE_CONTEXT), 0.93), ("true", 0.82)) + " END"
    )
    email = _cases((
        f"NOT {_rlike('m.text', P.EMAIL_EXAMPLE_DOMAIN)}"
        f" AND NOT {_rlike('m.text', P.EMAIL_PLACEHOLDER_LOCAL)}", 0.97))
    return [
        Detector(1, "nhs_number", P.NHS, _nhs(),
                 (rf"\d{{3}}[{S}\-]\d{{3}}[{S}\-]\d{{4}}",), six, 20, values=valid_nhs),
        Detector(2, "ni_number", P.NI,
                 _cases(("m.valid AND m.context", 0.99), ("m.valid", 0.92), ("m.context", 0.75)),
                 (r"\d{2}[ \t\-]?\d{2}[ \t\-]?\d{2}[ \t\-]?[A-Da-d]",), six, 80, 40,
                 values=valid_ni),
        Detector(3, "passport", P.PASSPORT_DIGITS, _needs(P.PASSPORT_CONTEXT, 0.95),
                 (rf"\d{{9}}|\d{{2}}[{S}]\d{{3}}[{S}]\d{{3}}[{S}]\d", travel), six, 60, 20),
        Detector(4, "passport", P.PASSPORT_ALPHA, _needs(P.PASSPORT_CONTEXT, 0.95),
                 (r"\d{7}[A-Z]", travel), six, 60, 20),
        Detector(5, "driving_licence", P.LICENCE, licence_score, (licence,), six, 100, 20),
        Detector(6, "driving_licence", P.LICENCE_LOOSE, _needs(P.LICENCE_CONTEXT, 0.90),
                 (licence,), six, 100, 20),
        Detector(7, "uk_vat", P.VAT, "0.97D", (rf"[Gg][Bb][{S}\-]?\d{{3}}",), six),
        Detector(8, "sortcode_account", P.SORT_CODE_ACCOUNT, _needs(P.BANK_CONTEXT, 0.92),
                 (pair_run, r"\d{8}", bank), six, 120, 60),
        Detector(9, "sortcode", P.SORT_CODE, _needs(P.SORT_CODE_CONTEXT, 0.88),
                 (pair_run, bank), six, 120, 60),
        Detector(10, "account_number", P.ACCOUNT, _needs(P.ACCOUNT_CONTEXT, 0.88),
                 (r"\d{8}", bank), six, 40, 20),
        Detector(11, "iban", P.IBAN, _cases((checks.iban_check("m.text"), 0.99)),
                 (rf"[Gg][Bb][{S}]*\d{{2}}[{S}]*[A-Za-z]{{4}}",), digit),
        Detector(12, "card_number", P.CARD_4_6_5, card,
                 (rf"\d{{4}}[{S}\-]?\d{{6}}[{S}\-]?\d{{5}}",), six, values=(bare,)),
        Detector(13, "card_number", P.CARD_13_16, card,
                 (rf"\d{{4}}[{S}\-]?\d{{4}}[{S}\-]?\d{{4}}[{S}\-]?\d",), six, values=(bare,)),
        Detector(14, "card_number", P.CARD_17_19, long_card,
                 (rf"\d{{4}}[{S}\-]?\d{{4}}[{S}\-]?\d{{4}}[{S}\-]?\d{{4}}[{S}\-]?\d",), six,
                 values=(bare,)),
        Detector(15, "date_of_birth", P.DATE_DMY, _birth(-4),
                 (r"\d[/\-.]\d{1,2}[/\-.]\d{4}",), six, 40, 10),
        Detector(16, "date_of_birth", P.DATE_WRITTEN, _birth(-4),
                 (r"\d [A-Za-z]{3,9} \d{4}",), digit, 40, 10),
        Detector(17, "date_of_birth", P.DATE_ISO, _birth(1), (r"\d{4}-\d{2}-\d{2}",), six, 40, 10),
        Detector(18, "uk_phone", P.PHONE, phone, (rf"\d\d(?:[{S}\-]?\d){{8}}",), six, 40, 10),
        Detector(19, "email", P.EMAIL, email, ("@",)),
        Detector(20, "ip_address", P.IPV4,
                 _cases(("m.kind = 'public'", 0.88), ("m.kind = 'private'", 0.75)),
                 (r"\d\.\d{1,3}\.\d",), digit, values=ip_kind),
        Detector(21, "address", P.ADDRESS, "0.82D",
                 (rf"\d[{S}]+[A-Za-z]{{2,}}[{S}]+[A-Za-z]",), digit, after=30,
                 extension=f"regexp_extract(m.after, {quoted(P.ADDRESS_CITY)}, 0)"),
        Detector(22, "uk_postcode", P.POSTCODE,
                 _cases((_rlike(AROUND, P.POSTCODE_CONTEXT), 0.99), ("true", 0.85)),
                 (r"\d[A-Za-z\d]?[ ]?\d[A-Za-z]{2}",), digit, 50, 10),
        Detector(23, "name", P.NAME_TITLED, "0.92D", (r"[DMPRC](?:r|rs|s|rof|ev|llr)\.?[ \t]",)),
        _word_pairs(names, known),
        _capital_words(),
    ]
