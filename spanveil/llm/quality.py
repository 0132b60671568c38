"""Quality rules by distribution divergence, as DataFrame expressions only.

Each document gets two histograms: its characters by class, and its words by the common words of
its language (ten of them, and all other words).  The reference of a language is the sum over
all documents of that language, and that of documents without one the sum over all documents; the
histogram of common words is judged where there is a list of them.  A document fails when the Jensen-Shannon distance of a
histogram to its language's reference is above a limit, and it is long enough for that
histogram: ``CHARS_FROM`` word characters, ``WORDS_FROM`` words.  The base rules come first.

Words that stand in a repeated three-word window are counted inside the row: the windows are
hashed, the hashes sorted with their places, and the places of equal neighbours merged; work
is n log n in the text.  The only shuffle is the sum of 17 numbers per language.

Defined cases: a null text has no words, and such a document fails.  A language without a list of
common words is judged by its characters alone, and so is a null or absent one.  Repeated rows
give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import quoted, with_computed

from .common import source_key, written

#: Ten common words of each language that has a reference.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
}
#: Character classes; the last is every other character.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[\x20\x09-\x0D]+", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
CHARS_LIMIT, CHARS_FROM = 0.29, 200
WORDS_LIMIT, WORDS_FROM = 0.225, 100


def _left(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, {quoted(pattern)}, ''))"


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` with the base counts and the histograms ``chars`` and ``common`` of each row."""
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    df = with_computed(df, "words", rf"array_remove(split(text, {quoted('[\\x20\\x09-\\x0D]+')}), '')")
    df = with_computed(
        df, "windows",
        "transform(slice(words, 1, greatest(0, size(words) - 2)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))",
    )
    df = with_computed(
        df, "placed",
        """CASE WHEN size(array_distinct(windows)) = size(windows) THEN CAST(array() AS array<struct<h:bigint,i:int>>)
                ELSE sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) END""",
    )
    df = with_computed(
        df, "starts",
        """sort_array(transform(filter(placed, (p, k) -> coalesce(p.h = get(placed, k - 1).h, false)
                                                      OR coalesce(p.h = get(placed, k + 1).h, false)), p -> p.i))""",
    )
    lists = "map(" + ", ".join(f"{quoted(lang)}, array({', '.join(map(quoted, words))})" for lang, words in COMMON.items()) + ")"
    df = with_computed(df, "found", f"filter(transform(words, w -> array_position(coalesce(get_list, array('')), w)), p -> p > 0)".replace("get_list", f"try_element_at({lists}, lang)"))
    df = with_computed(df, "lines", rf"filter(split(text, '\n'), l -> l RLIKE {quoted('[^\\x20\\x09-\\x0D]')})")
    n = "length(text)"
    sizes = [f"{n} - {_left('text', c)}" for c in CLASSES]
    df = with_computed(df, "classes", f"array({', '.join(sizes)})")
    other = f"{n} - aggregate(classes, 0, (a, x) -> a + x)"
    return df.selectExpr(
        "doc_id", "lang", "cast(size(words) AS bigint) AS n_words", f"cast({n} - classes[3] AS bigint) AS word_chars",
        f"cast({n} - {_left('text', '[#*$%&|<>]+')} AS bigint) AS n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
        """cast(aggregate(starts, named_struct('last', -3, 'n', 0),
                (a, s) -> named_struct('last', s, 'n', a.n + least(3, s - a.last)), a -> a.n) AS bigint) AS n_repeat_words""",
        f"transform(classes || array({other}), x -> cast(x AS bigint)) AS chars",
        """transform(transform(sequence(1, 10), k -> size(filter(found, p -> p = k))) || array(size(words) - size(found)),
                     x -> cast(x AS bigint)) AS common""",
    )


def divergence(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance (base 2) of two arrays of counts."""
    share = lambda x: f"transform({x}, v -> v / greatest(1, aggregate({x}, 0L, (a, v) -> a + v)))"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (x + y)) ELSE 0D END"
    return f"sqrt(greatest(0D, 0.5D * aggregate(zip_with({share(p)}, {share(q)}, (x, y) -> {part.format('x')} + {part.format('y')}), 0D, (a, v) -> a + v)))"


def judged(docs: DataFrame) -> DataFrame:
    """``features`` with ``base_failed, js_chars, js_common, kept``."""
    rows = written(features(docs), "features")
    sums = lambda name, n: "array(" + ", ".join(f"sum({name}[{k}])" for k in range(n)) + ")"
    # One row per language found, and one of their sums for documents without a language.
    of_lang = written(
        rows.groupBy(F.col("lang").alias("l")).agg(F.expr(sums("chars", 6)).alias("ref_chars"), F.expr(sums("common", 11)).alias("ref_common")), "languages"
    )
    of_all = of_lang.agg(F.expr(sums("ref_chars", 6)).alias("ref_chars"), F.expr(sums("ref_common", 11)).alias("ref_common"))
    refs = of_lang.where("l IS NOT NULL").unionByName(of_all.withColumn("l", F.lit(None).cast("string"))).withColumn("ref", source_key(F.col("l")))
    listed = f"lang IN ({', '.join(map(quoted, COMMON))})"
    out = rows.withColumn("ref", source_key(F.col("lang"))).join(refs, "ref").selectExpr(
        "*", f"{divergence('chars', 'ref_chars')} AS js_chars", f"CASE WHEN {listed} THEN {divergence('common', 'ref_common')} END AS js_common",
        "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed",
    )
    far = (
        f"coalesce(word_chars >= {CHARS_FROM} AND js_chars > {CHARS_LIMIT}, false) "
        f"OR coalesce(n_words >= {WORDS_FROM} AND js_common > {WORDS_LIMIT}, false)"
    )
    return out.selectExpr(*rows.columns, "js_chars", "js_common", "base_failed", f"NOT (base_failed OR {far}) AS kept")


def rules(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of each row."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    blank = r"[\x20\x09-\x0D]"
    classes = ", ".join(f"n - length(regexp_replace(text, '{c}', '', 'g'))" for c in CLASSES)
    lists = "MAP {" + ", ".join(f"'{lang}': [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in words)}]" for lang, words in COMMON.items()) + "}"
    langs = ", ".join(f"'{x}'" for x in COMMON)

    def js(p: str, q: str) -> str:
        x, y = (f"({v}[k] / greatest(1, list_sum({v}))::DOUBLE)" for v in (p, q))
        part = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2(2 * {v} / ({x} + {y})) ELSE 0 END"
        return f"sqrt(greatest(0, 0.5 * list_sum(list_transform(range(1, len({p}) + 1), lambda k: {part(x)} + {part(y)}))))"

    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, words FROM t),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c FROM w WHERE i + 2 <= len(words)),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM tri, range(3) g(k) WHERE c > 1 GROUP BY r),
f AS (
  SELECT t.r, doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
         n - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         [{classes}] AS five, n, words, coalesce(map_extract({lists}, lang)[1], ['']) AS list
  FROM t LEFT JOIN covered USING (r)),
g AS (
  SELECT *, list_append(five, n - list_sum(five)) AS chars,
         list_transform(range(1, 11), lambda k: len(list_filter(words, lambda x: x = list[k]))) AS ten
  FROM f),
h AS (SELECT *, list_append(ten, len(words) - list_sum(ten)) AS common FROM g),
ref AS (SELECT lang, [{', '.join(f'sum(chars[{k}])' for k in range(1, 7))}] AS ref_chars, [{', '.join(f'sum(common[{k}])' for k in range(1, 12))}] AS ref_common
        FROM h GROUP BY GROUPING SETS ((lang), ()) HAVING grouping(lang) = 1 OR lang IS NOT NULL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR coalesce(word_chars >= {CHARS_FROM} AND {js('chars', 'ref_chars')} > {CHARS_LIMIT}, false)
            OR coalesce(h.lang IN ({langs}) AND n_words >= {WORDS_FROM} AND {js('common', 'ref_common')} > {WORDS_LIMIT}, false)) AS kept
FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang
"""


ORACLE = _oracle()
