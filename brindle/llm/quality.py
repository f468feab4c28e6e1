"""Quality rules by distribution divergence, in DataFrame functions alone.

Each document's histogram of character classes and its histogram of common words are compared by
Jensen-Shannon distance with fixed references of its language. Texts under the length guards, and languages
without a reference, are judged by the base rules alone. Everything is one narrow pass over the documents.
"""

from __future__ import annotations

import math
import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Common words of a language and how often they stand in a thousand words of prose, roughly. Neither these
#: nor the shares below were measured on a corpus: they are round figures set down for this library, and the bounds leave
#: room for that.
COMMON = {
    "en": "the 62 of 31 and 28 to 26 a 22 in 20 is 11 that 11 it 10 for 9 was 9 on 7 with 7 as 7 be 6 by 5 he 7 are 5 this 5 at 5 from 4 not 5 have 4 but 4 his 5 they 4 which 3 or 4 an 3 you 5 we 4 one 3 had 4 were 3 all 3 their 3 there 3 has 3 would 2 will 2",
    "fr": "de 50 la 30 le 25 et 23 les 20 des 16 en 13 un 12 du 12 une 11 que 11 est 11 pour 9 qui 9 dans 9 a 9 par 7 plus 5 pas 6 au 6 sur 6 ne 6 se 6 ce 6 il 8 sont 4 avec 5 son 4 je 5 elle 3 nous 4 vous 4 mais 4 on 4 aux 3 ou 3 cette 3 sa 3 comme 3 ses 2",
    "de": "der 32 die 32 und 27 in 18 den 12 von 9 zu 11 das 14 mit 9 sich 8 des 8 auf 7 für 7 ist 10 im 7 dem 7 nicht 9 ein 9 eine 8 als 6 auch 6 es 8 an 6 werden 4 aus 5 er 7 hat 5 dass 5 sie 9 nach 4 wird 4 bei 4 einer 4 um 4 am 4 sind 4 noch 3 wie 4 einem 3 über 3",
    "es": "de 60 la 37 que 31 el 29 en 26 y 25 a 21 los 16 se 12 del 12 las 11 un 11 por 10 con 9 no 11 una 8 su 8 para 8 es 9 al 6 lo 6 como 5 más 4 o 4 pero 4 sus 3 le 4 ha 3 me 4 si 3 sin 2 sobre 2 este 2 ya 2 entre 2 cuando 2 todo 2 esta 2 ser 2 son 2",
}
#: Shares of the character classes in prose, roughly: white space, #*$%&|<>, beyond ASCII, A-Z, 0-9, punctuation, a e i o u, and all others.
CHARS = {
    "en": [0.17, 0.001, 0.001, 0.025, 0.008, 0.03, 0.31, 0.455],
    "fr": [0.165, 0.001, 0.02, 0.02, 0.008, 0.035, 0.33, 0.421],
    "de": [0.145, 0.001, 0.005, 0.05, 0.008, 0.03, 0.31, 0.451],
    "es": [0.165, 0.001, 0.01, 0.02, 0.008, 0.03, 0.345, 0.421],
}
#: Guards: shorter texts are too small a sample for a distance.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Jensen-Shannon distance (base 2, 0 to 1) of character classes beyond which a document is rejected; for common words the
#: bound is this share of the distance that a text without any common word has to the language's reference.
MOST_CHARS, MOST_WORDS = 0.25, 0.8
#: Signs that are taken off a word's ends before it is looked for among the common ones.
AROUND = ".,;:!?\"'()"

SPACE = "[ \\t-\\r]+"
#: Character classes that are counted by pattern.
CLASSES = ("[A-Z]", "[0-9]", r"[.,;:!?'\"()\-]")


def shares_of(words: str) -> dict[str, float]:
    """Word to share, from a line of COMMON."""
    parts = words.split()
    return {w: int(n) / 1000 for w, n in zip(parts[::2], parts[1::2], strict=True)}


def window_hashes(words: Column, size: int = 5) -> Column:
    """64-bit hashes of the windows of size word hashes; null where there are none or one."""
    windows = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))
    return F.when(F.size(words) > size, F.slice(windows, F.lit(1), F.size(words) - (size - 1)))


def with_repeats(df: DataFrame, size: int = 5) -> DataFrame:
    """Add n_repeat_words from `hashes`. Each array that a lambda looks into is a column of its own, so that it is made once a row."""
    twice = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("ranked", twice)
    at = F.array_sort(F.array_compact(F.transform("ranked", lambda x, i: F.when((x.h == F.get("ranked", i - 1).h) | (x.h == F.get("ranked", i + 1).h), x.i))))
    total = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")))
    return df.withColumn("n_repeat_words", F.coalesce(total["n"], F.lit(0)).cast("long"))


def histograms(docs: DataFrame, common: Mapping[str, str] = COMMON) -> DataFrame:
    """doc_id, lang, the base counts, and the counts `chars` and `common` as arrays."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", text.alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")))
    base = base.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    base = with_repeats(base.withColumn("hashes", window_hashes(F.col("word_hashes"))))
    lists = {lang: list(shares_of(words)) for lang, words in common.items()}
    listed = F.lit(None).cast("array<string>")
    for lang, words in lists.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    letters = string.ascii_letters[: max(map(len, lists.values()), default=0)]  # a letter for each listed word, a dot for others
    every = sorted({w for words in lists.values() for w in words})
    bare = F.transform("words", lambda w: F.lower(F.btrim(w, F.lit(AROUND))))
    code = F.array_join(F.transform(F.filter(bare, lambda w: w.isin(every)), lambda w: F.substring(F.lit("." + letters), F.array_position("listed", w).cast("int") + 1, F.lit(1))), "")
    base = base.withColumn("listed", listed).withColumn("code", F.when(F.col("listed").isNotNull(), code))
    n_chars = F.length("text").cast("long")
    counted = base.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", n_chars.alias("n_chars"), (F.octet_length("text") - F.length("text")).cast("long").alias("beyond"), *(F.regexp_count("text", F.lit(c)).cast("long").alias(f"class{k}") for k, c in enumerate(CLASSES)),
        F.length(F.regexp_replace("text", "[^aeiou]+", "")).cast("long").alias("vowels"),
        F.array(*(F.length("code") - F.length(F.replace(F.col("code"), F.lit(x))) for x in letters)).alias("hits"), F.col("listed").isNotNull().alias("has_list"),
    )
    # beyond ASCII by the bytes beyond one a character; all others last
    known = [F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"), F.col("beyond"), *(F.col(f"class{k}") for k in range(len(CLASSES))), F.col("vowels")]
    chars = F.array(*known, F.greatest(F.lit(0), F.col("n_chars") - sum(known, F.lit(0))))
    hit = F.aggregate("hits", F.lit(0), lambda a, x: a + x)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_chars", chars.alias("chars"),
        F.when(F.col("has_list"), F.concat("hits", F.array((F.col("n_words") - hit).cast("int")))).alias("common"),
    )


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.try_divide(x, total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions with base 2: 0 for equal, 1 for disjoint ones."""

    def part(x: Column, y: Column) -> Column:
        middle = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / middle)).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total / 2)))


def js_of(p: list[float], q: list[float]) -> float:
    """The same distance of two lists, for what is known before any document."""
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def judge_quality(docs: DataFrame, common: Mapping[str, str] = COMMON, chars: Mapping[str, list[float]] = CHARS, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """Base counts and the divergence verdict of each document.

    docs needs doc_id, text and lang; other columns are left out. Null text is empty and fails the base
    rules. A null language and one without references have no distances, nor have texts under the guards:
    the base rules decide. A distance at its bound passes. Every row gives one row, repeated rows and null
    doc_id included; an empty table gives none. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, js_chars, js_words (rounded to 6 places), kept.
    """
    width = max((len(shares_of(w)) for w in common.values()), default=0)
    of_chars, of_words, most = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    for lang, words in common.items():
        known = list(shares_of(words).values())
        known = [*known, *[0.0] * (width - len(known)), 1.0 - sum(known)]
        here = F.col("lang") == lang
        of_words = F.when(here, F.array(*map(F.lit, known))).otherwise(of_words)
        most = F.when(here, F.lit(most_words * js_of([0.0] * width + [1.0], known))).otherwise(most)
    for lang, known in chars.items():
        of_chars = F.when(F.col("lang") == lang, F.array(*map(F.lit, known))).otherwise(of_chars)
    guard = (F.col("n_chars") >= least_chars) & (F.col("n_words") >= least_words)
    both = histograms(docs, common).withColumns({"of_chars": of_chars, "of_words": of_words, "char_shares": shares(F.col("chars")), "word_shares": shares(F.col("common"))})
    both = both.withColumn("js_chars", F.when(guard, F.round(js_distance(F.col("char_shares"), F.col("of_chars")), 6)))
    both = both.withColumn("js_words", F.when(guard, F.round(js_distance(F.col("word_shares"), F.col("of_words")), 6)))
    diverges = F.coalesce(F.col("js_chars") > most_chars, F.lit(False)) | F.coalesce(F.col("js_words") > most, F.lit(False))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", (~F.col("base_failed") & ~diverges).alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in v) + ")" for v in values)


_LISTED = [(lang, w, n) for lang, words in COMMON.items() for w, n in shares_of(words).items()]
_MOST = [(lang, 1 - sum(s.values()), MOST_WORDS * js_of([0.0] * len(s) + [1.0], [*s.values(), 1 - sum(s.values())])) for lang, s in ((k, shares_of(v)) for k, v in COMMON.items())]
_JS = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
ORACLE = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM doc),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS q FROM twice) GROUP BY r),
base AS (SELECT r, doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS n_chars, w FROM split LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_chars >= {LEAST_CHARS} AND n_words >= {LEAST_WORDS} AS enough FROM base),
counted AS (SELECT r, lang, [n_chars - word_chars, n_symbols, octet_length(encode(t)) - n_chars, len(regexp_extract_all(t, '[A-Z]')), len(regexp_extract_all(t, '[0-9]')), len(regexp_extract_all(t, '[.,;:!?''"()\-]')), len(regexp_extract_all(t, '[aeiou]'))] AS c, n_chars
  FROM judged WHERE enough),
classes AS (SELECT r, lang, unnest(list_append(c, greatest(0, n_chars - list_sum(c)))) AS n, unnest(range(8)) AS k FROM counted),
of_chars(lang, k, q) AS (VALUES {_rows([(lang, k, q) for lang, shares in CHARS.items() for k, q in enumerate(shares)])}),
js_of_chars AS (SELECT r, round(sqrt(greatest(0, sum({_JS}) / 2)), 6) AS js_chars FROM (SELECT r, k, n / sum(n) OVER (PARTITION BY r) AS p, q FROM classes JOIN of_chars USING (lang, k)) GROUP BY r),
listed(lang, word, q) AS (VALUES {_rows(_LISTED)}),
rest(lang, q, most) AS (VALUES {_rows(_MOST)}),
hits AS (SELECT r, word, count(*) AS n FROM (SELECT r, lang, lower(trim(unnest(w), '{AROUND.replace("'", "''")}')) AS word FROM judged WHERE enough) JOIN listed USING (lang, word) GROUP BY r, word),
words AS (SELECT j.r, coalesce(h.n, 0) / j.n_words AS p, l.q FROM judged j JOIN listed l USING (lang) LEFT JOIN hits h ON h.r = j.r AND h.word = l.word WHERE enough
  UNION ALL SELECT j.r, (j.n_words - coalesce(sum(h.n), 0)) / j.n_words, any_value(s.q) FROM judged j JOIN rest s USING (lang) LEFT JOIN hits h ON h.r = j.r WHERE enough GROUP BY j.r, j.n_words),
js_of_words AS (SELECT r, round(sqrt(greatest(0, sum({_JS}) / 2)), 6) AS js_words FROM words GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, js_chars, js_words, NOT base_failed AND NOT coalesce(js_chars > {MOST_CHARS}, false) AND NOT coalesce(js_words > most, false) AS kept
FROM judged LEFT JOIN js_of_chars USING (r) LEFT JOIN js_of_words USING (r) LEFT JOIN rest USING (lang)
"""
