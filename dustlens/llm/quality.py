"""Quality rules: counts over a text, and how far its histograms are from those of known languages. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import SPACE_CLASS, let, table, texts_of

#: The commonest words of each language, the most frequent first; the k-th makes up some WORD_SHARE / k ** WORD_FALL of all words, as measured on the rows of sf0.1 that labels call good, outside of the held-out fold (within a twentieth in all four languages).
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por"),
}
WORD_SHARE, WORD_FALL = 0.0623, 0.75
#: Character classes: a pattern each; bytes beyond a character's first are one more class, all other characters the last.
CLASSES = {"space": r"[\x20\x09-\x0D]", "symbol": r"[#*$%&|<>]", "digit": "[0-9]", "mark": r"[.,;:!?'\"()-]", "upper": "[A-Z]"}
#: Shares of the classes in running text of each language, as measured on the rows of sf0.1 that labels call good, outside of the held-out fold: space, symbol, digit, mark, upper, further bytes; the rest are other characters.
CLASS_SHARES = {
    "en": (0.1666, 0.0002, 0.0006, 0.0237, 0.0138, 0.0002),
    "de": (0.1491, 0.0002, 0.0004, 0.0209, 0.0119, 0.0367),
    "fr": (0.1530, 0.0002, 0.0006, 0.0219, 0.0096, 0.0830),
    "es": (0.1499, 0.0002, 0.0005, 0.0212, 0.0110, 0.0729),
}
#: Jensen-Shannon distances (0 to 1) above which a text is unlike a language, and the lengths under which they are not judged.
#: Both limits make the fewest mistakes on the quality labels of sf0.1 outside the held-out fold; the word limit is the smallest that no good text there comes near.
MOST_CLASS_DISTANCE, LEAST_CHARS = 0.18, 200
MOST_WORD_DISTANCE, LEAST_WORDS = 0.25, 100
#: Base limits.
FEWEST_WORDS, MOST_REPEAT_PERCENT = 50, 50

_CASED = "[^a-zß-ÿ]+"


def word_share(rank: int) -> float:
    return WORD_SHARE / rank**WORD_FALL


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that come twice or more. Only texts that have such windows are sorted."""

    def of(w: Column) -> Column:
        last = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
            return let(twice, lambda t: F.size(F.array_distinct(F.concat(t, F.transform(t, lambda i: i + 1), F.transform(t, lambda i: i + 2)))))

        return let(placed, count)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, of))


def _distance(parts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of shares to a reference; both sum to 1."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + q * F.log2(q / m)

    terms = F.zip_with(parts, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _with_rest(shares: Column) -> Column:
    """Shares, and what they leave of the whole."""
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance), a row for each row of ``docs``, without a shuffle.

    A text that fails no base limit is kept if some language's histograms are near: that of
    character classes, judged from ``LEAST_CHARS`` characters on, and that of the language's
    commonest words, judged from ``LEAST_WORDS`` words on. The distances returned are the least
    over languages, null where they are not judged. A null text has no words and fails. Whole
    texts are read; equal rows get equal answers; other columns are not read; an empty table
    gives an empty result.
    """
    base = texts_of(docs, id_col, text_col)
    text = F.col("text")
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.char_length("text").cast("long").alias("n"),
        F.octet_length("text").cast("long").alias("bytes"),
        *[F.regexp_count("text", F.lit(p)).cast("long").alias(f"c_{c}") for c, p in CLASSES.items()],
        let(
            F.filter(F.split(F.lower("text"), _CASED), lambda w: w != ""),
            lambda w: F.struct(F.size(w).alias("n"), F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x.isin(sorted({y for ys in COMMON_WORDS.values() for y in ys}))), "  "), F.lit(" ")).alias("common")),
        ).alias("c"),
    )
    # A common word's share comes from what removing it with its own two spaces takes away.
    common, size = F.col("c.common"), F.greatest(F.col("c.n"), F.lit(1))

    def share(word: Column) -> Column:
        return (F.octet_length(common) - F.octet_length(F.replace(common, F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))) / ((F.octet_length(word) + 2) * size)

    words_of = [F.transform(F.array(*map(F.lit, ws)), share).alias(f"h_{lang}") for lang, ws in COMMON_WORDS.items()]
    all_bytes = F.greatest(F.col("bytes"), F.lit(1))
    classes = F.array(*[F.col(f"c_{c}") / all_bytes for c in CLASSES], (F.col("bytes") - F.col("n")) / all_bytes)
    counted = counted.select("doc_id", "w.*", "n_dup_lines", "n", "c_space", "c_symbol", F.col("c.n").alias("n_cased"), classes.alias("classes"), *words_of)
    columns, fits = [], F.lit(False)
    for lang, ws in COMMON_WORDS.items():
        q = [word_share(k) for k in range(1, len(ws) + 1)]
        columns.append(F.when(F.col("n") >= LEAST_CHARS, _distance(_with_rest(F.col("classes")), [*CLASS_SHARES[lang], 1 - sum(CLASS_SHARES[lang])])).alias(f"class_{lang}"))
        columns.append(F.when(F.col("n_cased") >= LEAST_WORDS, _distance(_with_rest(F.col(f"h_{lang}")), [*q, 1 - sum(q)])).alias(f"word_{lang}"))
        fits = fits | ((F.coalesce(f"class_{lang}", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce(f"word_{lang}", F.lit(0.0)) <= MOST_WORD_DISTANCE))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return counted.select("doc_id", "n_words", (F.col("n") - F.col("c_space")).alias("word_chars"), F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *columns).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"),
        F.least(*[f"class_{x}" for x in COMMON_WORDS]).alias("class_distance"), F.least(*[f"word_{x}" for x in COMMON_WORDS]).alias("word_distance"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge_quality`` of all ``documents``; see there for nulls, empty texts and repeated rows."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge_quality(table(spark, sf_dir, "documents")).select(*columns)


def sql() -> str:
    """The same in DuckDB's SQL."""
    space = r"[ \t-\r]"

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(t, '{pattern}'))"

    def distance(parts: list[str], reference: list[float]) -> str:
        terms = [f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}) / 2)) ELSE 0 END + {q!r} * log2({q!r} / (({p} + {q!r}) / 2))" for p, q in zip(parts, reference, strict=True)]
        return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"

    classes = {c: p.replace(r"\x20\x09-\x0D", r" \t-\r").replace("'", "''") for c, p in CLASSES.items()}
    shares = [f"(s_{c})" for c in classes] + ["(s_further)"]
    rest = f"greatest(0, 1 - {' - '.join(shares)})"
    tests = []
    for lang, ws in COMMON_WORDS.items():
        q = [word_share(k) for k in range(1, len(ws) + 1)]
        parts = [f"(h_{w})" for w in ws]
        a = distance([*shares, rest], [*CLASS_SHARES[lang], 1 - sum(CLASS_SHARES[lang])])
        b = distance([*parts, f"greatest(0, 1 - {' - '.join(parts)})"], [*q, 1 - sum(q)])
        tests.append(f"((n < {LEAST_CHARS} OR {a} <= {MOST_CLASS_DISTANCE}) AND (n_cased < {LEAST_WORDS} OR {b} <= {MOST_WORD_DISTANCE}))")
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x != '') AS ws,
  list_filter(regexp_split_to_array(lower(t), '{_CASED}'), lambda x: x != '') AS cs,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
keyed AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) x GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, length(t) AS n, strlen(t) AS b, len(cs) AS n_cased, cs, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  {", ".join(f"{count(p)} AS c_{k}" for k, p in classes.items())} FROM w),
s AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, {", ".join(f"c_{k} / greatest(b, 1) AS s_{k}" for k in classes)}, (b - n) / greatest(b, 1) AS s_further,
  {", ".join(f"len(list_filter(cs, lambda x: x = '{x}')) / greatest(n_cased, 1) AS h_{x}" for x in every)} FROM c LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, n - c_space AS word_chars, c_symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({" OR ".join(tests)}) AS kept FROM f
"""
