r"""Fixed recognition patterns, in Java regular-expression syntax.

The patterns describe identifier formats and must agree with the published
definition of each format, so they are stated here as values.  Conventions:

* ``\b`` is never used: on the JVM it follows Unicode letters, while the
  formats are defined over ASCII word characters.  ``START``/``END``/``EDGE``
  are the ASCII forms.  ``\w`` and the POSIX classes are ASCII and one test each,
  where a bracket of ranges is one test per range.
* ``SP`` holds every Unicode white-space character, which Java's ``\s`` lacks.
* Repeats that cannot give characters back are possessive, so a long run of
  words or dots neither recurses nor backtracks.
"""

SP = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

START = r"(?<!\w)"
END = r"(?!\w)"
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
# Looking for the digit first lets the scan skip prose without a look-behind.
DIGIT_START = r"(?=[0-9])" + START

UPPER = "A-ZÀ-Þ"
LOWER = "a-zà-þ"
CAPITAL_START = r"(?:[A-Z](?<!\w.)|[À-Þ](?<=\w.))"
CAPITALISED = f"[{UPPER}][{LOWER}]+"

MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    "Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
DAY = r"(?:0?[1-9]|[12]\d|3[01])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"
STREETS = (
    "road|rd|street|st|avenue|ave|lane|ln|drive|dr|way|court|ct|square|sq|crescent|cres|"
    "close|cl|grove|gv|gardens|gdn|villas|mews|place|pl|terrace|terr|hill|rise|view|park|walk"
)
CITIES = (
    "london|manchester|birmingham|leeds|glasgow|liverpool|newcastle|sheffield|bristol|"
    "cardiff|edinburgh|belfast|oxford|cambridge"
)
TITLES = r"Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Prof\.?|Rev\.?|Cllr\.?"

# --- fixed values: identifier formats ---------------------------------------------------
NHS = DIGIT_START + rf"\d{{3}}[{SP}\-]\d{{3}}[{SP}\-]\d{{4}}(?!\d)"
NI = rf"(?i:{START}[A-Z]{{2}}[ \t\-]?\d{{2}}[ \t\-]?\d{{2}}[ \t\-]?\d{{2}}[ \t\-]?[A-D](?!\d))"
PASSPORT_DIGITS = DIGIT_START + rf"(?:\d{{9}}|\d{{2}}[{SP}]\d{{3}}[{SP}]\d{{3}}[{SP}]\d)" + END
PASSPORT_ALPHA = START + r"[A-Z]\d{7}[A-Z]" + END
LICENCE = START + r"[A-Z9]{5}\d{6}[A-Z]{2}[0-9A-Z][A-Z]{2}" + END
LICENCE_LOOSE = START + r"[A-Z][A-Z9]{5}\d{6}[A-Z]{2}[0-9A-Z][A-Z]{2}" + END
VAT = rf"(?i:{START}GB[{SP}\-]?\d{{3}}[{SP}\-]?\d{{4}}[{SP}\-]?\d{{2}}(?:[{SP}\-]?\d{{3}})?{END})"
SORT_CODE = DIGIT_START + r"\d{2}[ \t\-]\d{2}[ \t\-]\d{2}(?!\d)"
SORT_CODE_ACCOUNT = (
    r"(?i:" + DIGIT_START + r"\d{2}[ \t\-]\d{2}[ \t\-]\d{2}[ \t\-]*+"
    r"(?:account(?:[ \t]+number)?[ \t]*+:?[ \t\-]*+)?\d{8}(?!\d))"
)
ACCOUNT = DIGIT_START + r"\d{8}(?!\d)"
IBAN = (
    rf"(?i:{START}GB[{SP}]*\d{{2}}[{SP}]*[A-Z]{{4}}[{SP}]*\d{{4}}[{SP}]*\d{{4}}"
    rf"[{SP}]*\d{{4}}[{SP}]*\d{{2}}{END})"
)
CARD_4_6_5 = DIGIT_START + rf"\d{{4}}[{SP}\-]?\d{{6}}[{SP}\-]?\d{{5}}" + END
CARD_13_16 = DIGIT_START + rf"\d{{4}}[{SP}\-]?\d{{4}}[{SP}\-]?\d{{4}}[{SP}\-]?\d{{1,4}}" + END
CARD_17_19 = (
    DIGIT_START
    + rf"\d{{4}}[{SP}\-]?\d{{4}}[{SP}\-]?\d{{4}}[{SP}\-]?\d{{4}}[{SP}\-]?\d{{0,3}}"
    + END
)
DATE_DMY = DIGIT_START + DAY + r"[/\-.](?:0?[1-9]|1[0-2])[/\-.]\d{4}(?!\d)"
DATE_WRITTEN = rf"(?i:{DIGIT_START}{DAY} (?:{MONTHS}) \d{{4}}(?!\d))"
DATE_ISO = DIGIT_START + r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)"
PHONE = (
    rf"(?=[+0])(?<!\d)(?:\+44[{SP}\-]?|0044[{SP}\-]?|0)[123789]\d(?:[{SP}\-]?\d){{8}}(?!\d)"
)
# A run of address characters is tried once: if it fails at its first possible start, it fails at
# all later ones.  That start is the first letter or digit of the run, with nothing or only marks
# before it, so never behind a letter, which is tested first; where the last match ended inside a run, the run begins anew (\\G).
# Most words end without an ``@``: the next 64 characters tell, or all three look-behinds would be tried.
EMAIL = (
    r"(?:(?=\w)(?<!\w)(?:(?=[\w.%+\-]{1,64}+[\w@.%+\-])(?:(?<![.%+\-])|(?<=(?:\A|[^\w.%+\-])[.%+\-]{1,40})|(?<=[.%+\-]{41})))"
    r"|\G(?:(?=\w)(?<!\w)|(?=[.%+\-])(?<=\w)))"
    r"[\w.%+\-]++@[\p{Alnum}.\-]+\.\p{Alpha}{2,13}(?:\.\p{Alpha}{2,6})?(?!\p{Alpha})"
)
IPV4 = rf"(?=[0-9])(?<![\d.]){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?![\d.])"
# A run of words is eaten possessively up to and including each street word, so the
# match ends at the last street word of the run.
ADDRESS = (
    rf"(?=[0-9FASUfasu])(?i:(?:(?:flat|apt|apartment|suite|unit)[{SP}]+\d+[a-z]?[{SP},]+)?(?<!\d)\d++"
    rf"[{SP}]++[a-z]{{2,}}+"
    rf"(?:(?:[{SP}]++(?!(?:{STREETS}){END})[a-z]{{2,}}+)*+[{SP}]++(?:{STREETS}){END})++)"
)
ADDRESS_CITY = rf"(?i)\A[{SP},]+(?:{CITIES}){END}"
POSTCODE = r"(?i:(?<![A-Z0-9])[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2})"
NAME_TITLED = START + rf"(?:{TITLES})[ \t]+{CAPITALISED}(?:[ \t]+{CAPITALISED}){{0,2}}"
NAME_WORDS = CAPITAL_START + rf"[{LOWER}]+(?:[ \t]+{CAPITALISED}){{1,2}}"
# A word that may be the first of a pair.
NAME_WORD = rf"[{UPPER}][{LOWER}]+"
NAME_CAPITALS = CAPITAL_START + rf"[{UPPER}]+(?:[ \t]+[{UPPER}]{{2,}}){{1,3}}"

# --- fixed values: words that give a match its context ------------------------------------
NHS_CONTEXT = rf"(?i){START}nhs{EDGE}"
NHS_LABEL = rf"(?i){START}nhs[{SP}]+number{EDGE}"
NI_CONTEXT = rf"(?i){START}(?:national[{SP}]*insurance|ni[{SP}]*number|nino|n\.i\.|ni){EDGE}"
PASSPORT_CONTEXT = (
    rf"(?i){START}(?:passport[{SP}]*(?:number|no\.?|#)?|travel[{SP}]*document|mrz){EDGE}"
)
LICENCE_CONTEXT = (
    rf"(?i){START}(?:driving[{SP}]*licen[sc]e|d\.?l\.?[{SP}]*(?:number|no\.?|:)|dvla|"
    rf"licence[{SP}]*(?:number|no\.?)|license[{SP}]*(?:number|no\.?)){EDGE}"
)
BANK_CONTEXT = (
    rf"(?i){START}(?:sort[{SP}]*code|account[{SP}]*number|account[{SP}]*:?|bank|bacs|"
    rf"faster[{SP}]*payment){EDGE}"
)
SORT_CODE_CONTEXT = rf"(?i){START}(?:sort[{SP}]*code|bank|bacs){EDGE}"
ACCOUNT_CONTEXT = rf"(?i){START}(?:account[{SP}]*number|account[{SP}]*:?|bank|bacs){EDGE}"
BIRTH_CONTEXT = rf"(?i){START}(?:date[{SP}]*of[{SP}]*birth|d\.?o\.?b\.?|born|birthday|dob){EDGE}"
PHONE_CONTEXT = (
    rf"(?i){START}(?:phone|mobile|tel(?:ephone)?|call|fax|contact|number|mob){EDGE}"
)
POSTCODE_CONTEXT = (
    rf"(?i){START}(?:postcode|post[{SP}]+code|address|zip(?:[{SP}]+code)?){EDGE}"
)
EMAIL_EXAMPLE_DOMAIN = (
    r"(?i)\A[^@]+@(?:test|domain|placeholder|invalid|localhost|email|"
    r"your[-_.]?(?:company|domain|email|name))\."
)
EMAIL_PLACEHOLDER_LOCAL = (
    r"(?i)\A(?:your[-_.]?email|your[-_.]?name|email[-_.]?address|name[-_.]?here|"
    r"enter[-_.]?email|user[@])@"
)
NAME_CONTEXT = (
    rf"(?i){START}(?:full[{SP}]*name[{SP}]*[:\-]?|name[{SP}]*[:\-]|named?|patient[{SP}]*[:\-]?|"
    rf"from|to|dear|signed?[{SP}]*by|referred[{SP}]*by|contact|regarding|re[:{SP}]|about|"
    rf"cc[:{SP}]|for|hello|hi|sender|recipient|author|written[{SP}]*by|submitted[{SP}]*by|"
    rf"prepared[{SP}]*by|reviewed[{SP}]*by|regards|sincerely|cheers|thanks|yours|"
    rf"egress[{SP}]*[:\-]?)[,.]?[{SP}]*\z"
)
NAME_LABEL_AFTER = (
    rf"(?i)\A[{SP}]*(?:email|phone|address|dob|date|tel|mobile|postcode)[{SP}]*[:\-]"
)
