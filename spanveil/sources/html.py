"""Text segments of web pages, without leaving the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import CLOSE, MID, OPEN, normalise_newlines, quoted, scan_form, with_computed, with_starts

# --- fixed values: elements whose text is not read -------------------------------------------
SKIPPED = ("script", "style", "noscript", "iframe", "textarea")

# --- fixed values: elements whose text is read as it stands, tags and all ------------------------
VERBATIM = ("title", "xmp", "noembed", "noframes")

# Quoted attribute values may hold ``>``; an unbalanced quote ends at the first ``>``, and a tag
# that is not closed at the end of the page.
_REST = r"(?:(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\z))"
_NAMED = r"(?=[\s/>]|\z)"
_TAG = rf"<[a-z/!?]{_REST}"
# Comments and skipped elements go first, up to the end of the page where they are not closed; what
# is in elements read as they stand comes as group 3.  Whichever comes first wins.
_OUTER = (
    r"(?i)<!---?>|<!--[\s\S]*?(?:--!?>|\z)"
    rf"|<({'|'.join(SKIPPED)}){_NAMED}{_REST}[\s\S]*?(?:</\1{_NAMED}[^>]*+(?:>|\z)|\z)"
    rf"|<({'|'.join(VERBATIM)}){_NAMED}{_REST}([\s\S]*?)(?:</\2{_NAMED}[^>]*+(?:>|\z)|\z)"
)
#: Any tag that is left, or a place where something was taken out.
_INNER = rf"(?i){_TAG}|{OPEN}"

# The references of the markup language, by the standard library's table; those that also stand
# without a semicolon are looked for from the longest on.
_REFERENCES = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
#: What the numbers 128 to 159 stand for: the characters of the code page 1252, where it has one.
_LOW_NUMBERS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]


def decode_entities(text: Column) -> Column:
    """Decode numeric and named character references, each exactly once."""
    named = F.expr(f"from_json({quoted(_REFERENCES)}, 'map<string,string>')")

    def character(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        encoded = F.unhex(F.lpad(F.hex(code), 8, "0"))
        low = F.get(F.array(*map(F.lit, _LOW_NUMBERS)), (code - 128).cast("int"))
        return F.when(code.between(128, 159), low).when(valid, F.decode(encoded, "UTF-32")).otherwise("�")

    def decoded(piece: Column) -> Column:
        def number(pattern: str) -> Column:
            return F.regexp_extract(piece, pattern, 1)

        def with_rest(pattern: str, made: Column) -> Column:
            return F.concat(made, F.regexp_replace(piece, pattern, ""))

        decimal, hexadecimal = r"\A&#0*(\d{1,7});?", r"\A&#[xX]0*([0-9A-Fa-f]{1,6});?"
        full, bare = r"\A&([A-Za-z0-9]+);", rf"\A&({_BARE})"
        return F.coalesce(
            F.when(~piece.startswith("&"), piece),
            F.when(number(decimal) != "", with_rest(decimal, character(number(decimal).cast("int")))),
            F.when(number(hexadecimal) != "", with_rest(hexadecimal, character(F.conv(number(hexadecimal), 16, 10).cast("int")))),
            with_rest(full, named[F.nullif(number(full), F.lit(""))]),
            F.when(number(bare) != "", with_rest(bare, named[number(bare)])),
            piece,
        )

    pieces = F.split(text, r"(?=&)")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def html_segments(df: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """Text nodes of each page in document order: key, seg_no, start, end, text.

    Offsets count in the nodes joined without a separator, after newline normalisation.
    """
    rows = with_nodes(df.select(key, html_col), html_col, "nodes").select(key, F.posexplode_outer("nodes").alias("seg_no", "s"))
    return rows.where("s is not null").select(
        key, F.col("seg_no").cast("bigint").alias("seg_no"), "s.start", "s.end", "s.text"
    )


def with_nodes(df: DataFrame, html_col: str, out: str) -> DataFrame:
    """Add the array of ``(start, end, text)`` of each page's text nodes, inside the row."""
    clean = scan_form(F.coalesce(F.col(html_col), F.lit("")))
    # Text read as it stands comes between two marks; its ``<`` is put aside until the tags are gone.
    outer = F.split(F.regexp_replace(clean, F.lit(_OUTER), F.lit(f"{OPEN}{MID}$3{MID}{OPEN}")), MID)
    plain = F.array_join(F.transform(outer, lambda p, i: F.when(i % 2 == 1, F.translate(p, "<", CLOSE)).otherwise(p)), "")
    pieces = F.split(plain, _INNER)
    texts = F.transform(
        F.filter(pieces, lambda p: F.length(p) > 0), lambda p: normalise_newlines(decode_entities(F.translate(p, CLOSE, "<")))
    )
    df = with_starts(df.withColumn("__texts", texts), "__texts", "__starts")
    nodes = "transform(__texts, (t, i) -> named_struct('start', __starts[i], 'end', __starts[i] + length(t), 'text', t))"
    return with_computed(df, out, nodes).drop("__texts", "__starts")


def page_text(df: DataFrame, html_col: str = "html", text_col: str = "text", nodes: str = "nodes") -> DataFrame:
    """Add each page's text nodes and the text they join to."""
    df = with_nodes(df, html_col, nodes)
    return df.withColumn(text_col, F.array_join(F.transform(nodes, lambda n: n["text"]), ""))


def page_domain(url: Column) -> Column:
    """Host of a URL, lower-cased; null when there is none."""
    host = F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)
