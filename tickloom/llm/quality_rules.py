"""Line-first cleaning in DataFrame functions: rules judge each line, failing lines go, and documents that lose too much go too.

Everything runs row by row inside the scan; there is no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that part words, and those that count as symbols.
BLANKS, BLANK_CLASS, SYMBOL_CLASS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Separators of navigation items; a line with three or more, and short items between them, is navigation.
SEPARATOR_CLASS, ITEM_CHARS = r"[|>»·•]", 60
#: Phrases that pages carry on every page, in English, German, French and Spanish.
BOILERPLATE = (
    r"(?i)\b(?:lorem ipsum|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|skip to (?:main )?content|sign in|log in|subscribe to our|share on (?:facebook|twitter)"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|allgemeine gesch[äÄ]ftsbedingungen|zum inhalt springen|jetzt anmelden|newsletter abonnieren"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales|aller au contenu|se connecter|abonnez-vous"
    r"|todos los derechos reservados|pol[íÍ]tica de (?:privacidad|cookies)|aviso legal|saltar al contenido|iniciar sesi[óÓ]n|suscr[íÍ]bete)"
)
#: What a line of prose of LONG_LINE characters or more ends with.
SENTENCE_END, LONG_LINE = r"[.!?…。！？:;\x22\x27)\]»”’][\x20\x09-\x0D]*\z", 60
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(rows: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(rows, k)["h"] == F.get(rows, k + d)["h"], F.lit(False))
            places = F.transform(F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: same(k, -1) | same(k, 1)), lambda k: F.get(rows, k)["i"])
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            grow = lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(a["end"], p)).alias("n"))
            return F.aggregate(F.sort_array(places), start, grow, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, twins))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), covered))


def line_fails(line: Column) -> Column:
    """Whether a line (with a word) breaks a rule: navigation, boilerplate, symbols, few words over and over, or a long line that ends like no sentence."""
    size = F.length(line)
    symbols = F.regexp_count(line, F.lit(SYMBOL_CLASS)) * 20 > size
    navigation = let(F.regexp_count(line, F.lit(SEPARATOR_CLASS)), lambda n: (n >= 3) & (size <= (n + 1) * ITEM_CHARS))
    unpunctuated = (size >= LONG_LINE) & ~F.rlike(line, F.lit(SENTENCE_END))
    stutters = (size >= 24) & let(F.split(line, " "), lambda w: (F.size(w) >= 8) & (F.size(F.array_distinct(w)) * 4 < F.size(w)))
    return symbols | navigation | unpunctuated | stutters | F.rlike(line, F.lit(BOILERPLATE))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def clean_lines(docs: DataFrame, text: str = "text", into: str = "cleaned", min_words: int = 10, max_repeat: int = 20, max_loss: float = 0.5) -> DataFrame:
    """``docs`` with ``into``, a struct of the measures of the whole text, ``base_failed``, the cleaned ``text``, ``loss`` (share of the lines' characters removed) and ``kept``.

    Null and empty texts have no words, so they fail; their cleaned text is
    empty.  Texts of any length are judged whole.  Rows are independent: ties,
    repeated rows and empty tables need no rule.  Other columns pass through; a
    column named ``into`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def judged(parts: Column) -> Column:
        t, words = parts["t"], parts["w"]
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

        def of_lines(full: Column) -> Column:
            good = F.filter(full, lambda x: ~line_fails(x))

            def verdict(kept: Column) -> Column:
                chars = lambda a: F.length(F.array_join(a, ""))
                loss = F.coalesce(F.try_divide(chars(full) - chars(kept), chars(full)), F.lit(0.0))
                return F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                    F.regexp_count(t, F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
                    (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                    repeated_words(words).alias("n_repeat_words"),
                    F.array_join(kept, "\n").alias("text"),
                    loss.alias("loss"),
                )

            return let(good, verdict)

        return let(lines, of_lines)

    measured = let(F.struct(whole.alias("t"), words_of(whole).alias("w")), judged)

    def finish(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in MEASURES], failed.alias("base_failed"), m["text"].alias("text"), m["loss"].alias("loss"), (~failed & (m["loss"] <= max_loss)).alias("kept"))

    return docs.withColumn(into, let(measured, finish))


def digest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the share of text lost, of every document."""
    return clean_lines(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"cleaned.{c}").alias(c) for c in (*MEASURES, "base_failed", "kept", "loss")])


_WORDY = r"[^\x20\x09-\x0D]"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDY}+') AS w FROM documents),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS times FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)) WHERE times > 1) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDY}')) AS ls FROM d),
g AS (SELECT *, list_filter(ls, lambda x: NOT (
    len(regexp_extract_all(x, '{SYMBOL_CLASS}')) * 20 > length(x)
    OR (len(regexp_extract_all(x, '{SEPARATOR_CLASS}')) >= 3 AND length(x) <= (len(regexp_extract_all(x, '{SEPARATOR_CLASS}')) + 1) * {ITEM_CHARS})
    OR (length(x) >= {LONG_LINE} AND NOT regexp_matches(x, '{SENTENCE_END}'))
    OR (length(x) >= 24 AND len(string_split(x, ' ')) >= 8 AND len(list_distinct(string_split(x, ' '))) * 4 < len(string_split(x, ' ')))
    OR regexp_matches(x, '{BOILERPLATE}'))) AS good FROM l),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOL_CLASS}')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  coalesce((length(array_to_string(ls, '')) - length(array_to_string(good, ''))) / nullif(length(array_to_string(ls, '')), 0), 0) AS loss
  FROM g LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND loss <= 0.5 AS kept FROM m
"""
