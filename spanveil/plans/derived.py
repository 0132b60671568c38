"""Texts derived from table columns, in SQL that Spark and other engines read alike.

The given documents hold few kinds of identifiers.  These expressions turn the order keys
into texts that hold every kind, valid and invalid, with and without context, so that a
detector can be checked over whole tables of any size.
"""

from __future__ import annotations

KEY = "o_orderkey"


def digits(width: int, mul: int, add: int = 0) -> str:
    return f"lpad(CAST(({KEY} * {mul} + {add}) % {10**width} AS STRING), {width}, '0')"


def number(mul: int, add: int, mod: int) -> str:
    return f"CAST(({KEY} * {mul} + {add}) % {mod} AS STRING)"


def letter(mul: int, add: int = 0, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> str:
    return f"substr('{alphabet}', CAST(({KEY} * {mul} + {add}) % {len(alphabet)} AS INT) + 1, 1)"


def pick(step: int, *choices: str) -> str:
    """One of several SQL expressions by the key; quoted texts must be given as literals."""
    cases = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
    return f"CASE ({KEY} // {step}) % {len(choices)} {cases} ELSE {choices[-1]} END".replace(
        f"({KEY} // {step})", f"CAST(floor({KEY} / {step}) AS BIGINT)"
    )


def text(*parts: str) -> str:
    return " || ".join(f"({p})" for p in parts)


def q(*words: str) -> list[str]:
    return ["'" + w + "'" for w in words]


_sep = pick(3, *q(" ", "-", ""))
_tail = pick(5, *q(" ok", ".", "", "x", "7"))

TEXTS: dict[str, str] = {
    "nhs": text(
        pick(1, *q("NHS: ", "my NHS  Number: ", "ref ", "x", "nhs or a quite long gap of text ")),
        digits(3, 7919, 13), pick(2, *q(" ", "-", "")), digits(3, 104729, 7), pick(4, *q(" ", "-")),
        digits(4, 1299709, 3), _tail, "' and then NHS number 943 476 1239 end'",
    ),
    "ni": text(
        pick(1, *q("NI number ", "code ", "x", "National Insurance ", "nino")), pick(2, "' '", "''", "':'"),
        pick(7, *[f"lower({letter(7)})", letter(7), letter(7)]), letter(11, 5), _sep, digits(2, 31),
        _sep, digits(2, 37), _sep, digits(2, 41), _sep, letter(3, 0, "ABCDE"), _tail,
        "', JK 12 34 56 A, '", pick(6, "'n.i. listed'", "'BG123456B'"),
    ),
    "passport": text(
        pick(1, *q("passport no. ", "Passport: ", "order ", "travel document ", "MRZ ", "passports ")),
        pick(6, digits(9, 7919 * 131, 11), f"{letter(5)} || {digits(7, 991)} || {letter(3)}",
             f"{digits(2, 3)} || ' ' || {digits(3, 7)} || ' ' || {digits(3, 11)} || ' ' || {digits(1, 1)}",
             digits(8, 977)),
        _tail, pick(2, "' issued'", "repeat(' far', 12) || ' 123456789'"),
    ),
    "driving_licence": text(
        pick(1, *q("Driving Licence: ", "driving license ", "DVLA ref ", "ref ", "D.L. no ", "licence number ")),
        pick(6, *q("MORGA", "JONES", "GARCIA", "LEE99", "abcde")), digits(1, 1), digits(2, 1, 3),
        digits(2, 3, 1), digits(1, 7), pick(3, *q("SM", "AB", "9X")), letter(9, 1, "0123456789ABCDEFGH"), "'IJ'",
        _tail, pick(2, "''", "' then ' || repeat('filler ', 20) || 'SMITH751101AB9CD'"),
    ),
    "vat": text(
        pick(1, *q("VAT: ", "number ", "x")), pick(2, *q("GB", "gb", "DE", "GB")), _sep, digits(3, 17), _sep,
        digits(4, 7919), _sep, digits(2, 13), pick(5, "''", f"({_sep}) || ({digits(3, 29)})"), _tail,
    ),
    "bank": text(
        pick(1, *q("Sort Code: ", "ref ", "BACS ", "bank sort code ", "riverbank ")),
        digits(2, 3), pick(3, *q("-", " ")), digits(2, 7), pick(3, *q("-", " ")), digits(2, 11),
        pick(5, *q(" Account: ", " account number: ", " ", "; ", " - ", ", Account ")), digits(8, 7919 * 17, 5), _tail,
        pick(4, "''", "' and account 12345678 too'", "repeat(' pad', 40) || ' bank 12-34-56'"),
    ),
    "iban": text(
        pick(1, *q("IBAN: ", "account ", "x")), pick(2, *q("GB", "gb", "GB", "FR")), digits(2, 7, 3), pick(4, *q(" ", "")),
        pick(3, *q("NWBK", "WEST", "abcd")), pick(4, *q(" ", "")), digits(4, 7919), pick(4, *q(" ", "")), digits(4, 104729),
        pick(4, *q(" ", "")), digits(4, 31), pick(4, *q(" ", "")), digits(2, 17), _tail,
        "' paid to GB29 NWBK 6016 1331 9268 19.'",
    ),
    "card": text(
        pick(1, *q("Card: ", "paid with ", "x")),
        pick(3, f"'4' || {digits(3, 7)}", f"'5' || {digits(3, 11)}", f"'34' || {digits(2, 7)}",
             "'6011'", "'6759'", "'1234'", f"'37' || {digits(2, 3)}", f"'2' || {digits(3, 229)}", f"'62' || {digits(2, 37)}"),
        pick(2, *q(" ", "", "-")),
        pick(4, f"{digits(4, 7919)} || ' ' || {digits(4, 31)} || ' ' || {digits(4, 104729)}",
             f"{digits(6, 7919)} || ' ' || {digits(5, 104729)}",
             f"{digits(4, 77)} || {digits(4, 131)} || {digits(4, 104729)} || {digits(2, 19)}",
             f"{digits(4, 77)} || {digits(4, 131)} || {digits(2, 104729)}"),
        _tail, "', 4111 1111 1111 1111 and 4111 1111 1111 1112'",
    ),
    "dob": text(
        pick(1, *q("DOB: ", "born ", "meeting on ", "date of birth ", "due ")),
        pick(5, f"{number(7, 1, 35)} || '/' || {number(11, 1, 14)} || '/' || {number(13, 0, 140)} + 1890".replace(
                 f"{number(13, 0, 140)} + 1890", f"CAST(({KEY} * 13) % 140 + 1890 AS STRING)"),
             f"{digits(2, 7)} || '.' || {digits(2, 3)} || '.' || CAST(({KEY} * 17) % 140 + 1890 AS STRING)",
             f"{number(3, 1, 33)} || ' ' || "
             + pick(2, *q("Jan", "February", "march", "Sept", "Oct", "December", "Dec", "MAY"))
             + f" || ' ' || CAST(({KEY} * 19) % 140 + 1890 AS STRING)",
             f"CAST(({KEY} * 23) % 140 + 1890 AS STRING) || '-' || {digits(2, 3)} || '-' || {digits(2, 7)}"),
        _tail, "' or 14/03/1987 and 1 May 2020'",
    ),
    "phone": text(
        pick(1, *q("Mobile: ", "ring ", "x", "contact ", "num ")), pick(5, *q("0", "+44 ", "0044", "+44", "1")),
        digits(2, 7), digits(2, 13), pick(3, *q(" ", "-", "")), digits(3, 7919), pick(2, *q("", " ")), digits(3, 104729),
        _tail, "' or 020 7946 0958; fax 07700900123'",
    ),
    "email": text(
        pick(1, *q("mail ", "<", "to:", "é")),
        pick(4, *q("john.smith", "your-email", "user", "a+b_c%d", "name_here", "x..y")), "'@'",
        pick(24, *q("gmail", "test", "sub.company", "domain", "your-company", "example", "localhost")),
        pick(7, *q(".com", ".co.uk", ".photography", ".c", ".org.abcdefgh", ".1com", "")),
        pick(3, *q("", ".", " now", "9", ">")), "' cc ann@nhs.uk'",
    ),
    "ip": text(
        pick(1, *q("ip ", "v", "addr=", "1.")), number(7, 0, 300), "'.'", number(11, 3, 260), "'.'", number(3, 0, 256),
        "'.'", number(13, 1, 257), pick(3, *q("", ".", ".5", " ", "/24")),
        pick(2, "' at 127.0.0.1'", "' at 192.168.1.1 8.8.8.8'", "' 0.0.0.0,172.20.1.1'", "' 100.64.0.1;169.254.9.9'"),
    ),
    "address": text(
        pick(1, *q("", "Flat 4b, ", "at ", "unit 12 ", "apt 3, ")), number(7, 1, 200), pick(3, *q(" ", "  ", " a ")),
        pick(5, *q("High", "wellington", "Old Mill", "Park", "St James")), pick(2, *q(" ", "  ")),
        pick(4, *q("Street", "road", "Lane", "Avenue", "Banana", "St", "streets", "Park View")),
        pick(6, *q(", London", " oxford.", ",Oxfordshire", "", "9", " and 7 Green Close, Leeds SW1A 1AA")),
        pick(9, "''", "repeat(' word', 300) || ' 5 x Road'", "' 5 Fifth Way'"),
    ),
    "postcode": text(
        pick(1, *q("postcode: ", "deliver to ", "Address ", "x", "zip ")), letter(7), pick(3, "''", letter(5)),
        digits(1, 1), pick(4, "''", letter(3), digits(1, 3)), pick(2, *q(" ", "", "  ")), digits(1, 7), letter(9), letter(11),
        _tail, "' (EC1A 1BB), w1a1hq9'",
    ),
    "names": text(
        pick(1, *q("Name: ", "", "from ", "see ", "Patient: ", "Visit ", "x", "Dear ")),
        pick(8, *q("Sarah", "Zork", "Dear Hodan", "Smart", "Support", "Mr", "James Paul", "MARIA", "Hi", "Ming", "Frank",
                   "Dr. Jean", "Max", "Étienne", "HAS")),
        pick(5, "' '", "chr(9)", "'  '"),
        pick(3, *q("Johnson", "Team", "Dynasty", "Redaction", "Esteban Garcia", "ESTEBAN", "Discussion", "Patient", "New",
                   "Äther", "smith", "O", "CLARKE LEE")),
        pick(2, *q("", " email: a", ", today", " DOB- 1", " Street", ".")),
        "'. Kind Regards, Emily Clarke phoned Priya. '", pick(4, *q("cc: JOHN SMITH", "Thanks Ann Bee", "The End")),
    ),
}

TEXTS["mixed"] = text(
    TEXTS["names"], "' '", TEXTS["bank"], "'; '", TEXTS["phone"], "' '", TEXTS["email"], "' '", TEXTS["nhs"],
    "' '", TEXTS["dob"], "'; '", TEXTS["card"],
)
TEXTS["contact"] = text(TEXTS["phone"], "'; '", TEXTS["email"], "'; '", TEXTS["postcode"])

# Model output about a contact text: right and wrong offsets, several wrappings, bad JSON.
_entity = (
    """'{{"type":"' || ({kind}) || '","text":"' || substr(text, {at} + 1, {n}) || '","start":' || CAST({shift} AS STRING)"""
    """ || ',"end":' || CAST({shift} + {n} AS STRING) || {conf} || '}}'"""
)
_entities = " || ',' || ".join([
    _entity.format(kind="CASE id % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PHONE' ELSE 'Odd' END", at=0, n=6,
                   shift="0", conf="',\"confidence\":' || CAST(id % 120 AS STRING)"),
    _entity.format(kind="'EMAIL'", at=3, n=9, shift="CAST(3 + (id % 2) AS INT)", conf="''"),
    _entity.format(kind="'UK_VAT'", at=40, n=5, shift="40", conf="',\"confidence\":true'"),
    _entity.format(kind="'POSTCODE'", at=62, n=4, shift="62", conf="',\"confidence\":0.5'"),
    """'{"type":"PERSON","text":"","start":1,"end":2}'""",
    """'{"type":"PERSON","text":"lost"}'""",
])
MODEL_OUTPUT = f"""CASE id % 8
    WHEN 0 THEN '{{"entities":[' || {_entities} || ']}}'
    WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"entities":[' || {_entities} || ']}}' || chr(10) || '```'
    WHEN 2 THEN 'Here it is: {{"entities":[' || {_entities} || ']}} - done'
    WHEN 3 THEN 'no json at all'
    WHEN 4 THEN '{{"entities":[' || {_entities}
    WHEN 5 THEN '{{"entities":"none"}}'
    WHEN 6 THEN '```' || chr(10) || 'broken' || chr(10) || '``` {{"entities":[' || {_entities} || ']}}'
    ELSE '  {{"entities":[' || {_entities} || ']}}  ' END"""
