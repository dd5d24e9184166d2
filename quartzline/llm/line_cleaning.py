"""Quality rules: line-first cleaning, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import SEPARATOR_CLASS, unused

#: Phrases of site furniture and licence text in four languages; fixed values.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "licensed under the",
    "lorem ipsum",
    "click here",
    "sign in",
    "sign up",
    "read more",
    "share this",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "verwendet cookies",
    "hier klicken",
    "weiterlesen",
    "impressum",
    "lizenziert unter",
    "tous droits réservés",
    "conditions générales",
    "politique de confidentialité",
    "utilise des cookies",
    "cliquez ici",
    "lire la suite",
    "se connecter",
    "sous licence",
    "todos los derechos reservados",
    "términos de uso",
    "política de privacidad",
    "utiliza cookies",
    "haga clic aquí",
    "leer más",
    "iniciar sesión",
    "bajo la licencia",
)
#: Marks that separate the entries of a navigation bar.
NAVIGATION_MARKS = "|»«›‹•·"
#: Marks that may end a line of prose, closing quotes and brackets left aside.
TERMINALS = ".!?…:;。！？"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule.

    A line is removed if it ends without a terminal mark and has fewer than `short_words` words,
    has a navigation mark for every `words_per_mark` words or fewer (two marks at least), holds a
    boilerplate phrase and at most `boilerplate_words` words, has a symbol for every
    `words_per_symbol` words or fewer (two symbols at least), or equals an earlier line.
    A document is rejected if it keeps no word, or less than `min_kept_percent` of its word
    characters.
    """

    short_words: int = 4
    words_per_mark: int = 4
    boilerplate_words: int = 40
    words_per_symbol: int = 3
    min_kept_percent: int = 50


def _count(text: Column, chars: str) -> Column:
    """How many characters of a text are in a regular expression class."""
    return F.regexp_count(text, F.lit(chars))


def _word_chars(text: Column) -> Column:
    """Code points outside the separators."""
    return F.length(text) - _count(text, SEPARATOR_CLASS)


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _measured(line: Column) -> Column:
    """A line with its counts, each taken once."""
    return F.struct(
        line.alias("line"),
        _n_words(line).alias("words"),
        _count(line, f"[{NAVIGATION_MARKS}]").alias("marks"),
        _count(line, f"[{SYMBOLS}]").alias("symbols"),
        F.lower(line).alias("low"),
    )


def line_fails(x: Column, rules: LineRules) -> Column:
    """Whether a measured line with a word fails a rule."""
    phrase = x["low"].contains(BOILERPLATE[0])
    for other in BOILERPLATE[1:]:
        phrase = phrase | x["low"].contains(other)
    unended = ~x["line"].rlike(rf"[{TERMINALS}][\"'”’»)\]\x20\x09-\x0D]*$")
    return (
        ((x["marks"] >= 2) & (x["marks"] * rules.words_per_mark >= x["words"]))
        | ((x["symbols"] >= 2) & (x["symbols"] * rules.words_per_symbol >= x["words"]))
        | ((x["words"] < rules.short_words) & unended)
        | ((x["words"] <= rules.boilerplate_words) & phrase)
    )


def clean_lines(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """Adds to each document what the line rules leave of it, and the verdict on the whole.

    New columns: `clean_text` (the lines kept, in order, joined by line feeds), `lines_failed`
    (lines with a word that were removed), `kept_word_chars`, `word_chars` (code points outside
    the separators), `accepted` (false if too much was lost). Other columns stay as they are,
    unless they have one of these names: those are replaced.

    A null text counts as empty: no words, so it is not accepted, and its clean text is empty.
    Lines without a word are dropped silently. Repeated rows are judged one by one. Everything is
    a function of one row, without a shuffle, so neither hot sources nor copies matter.
    """
    rules = rules or LineRules()
    names = ["clean_text", "lines_failed", "word_chars", "kept_word_chars", "accepted"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop(*names)
    held, left = unused("_lines", docs), unused("_kept", docs)
    lines = docs.withColumn(held, F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    # array_distinct keeps the first of equal lines, so of a repeated line one stays
    kept = F.transform(
        F.filter(F.transform(F.array_distinct(held), _measured), lambda x: ~line_fails(x, rules)), lambda x: x["line"]
    )
    cleaned = lines.withColumn(left, kept)
    return (
        cleaned.withColumn("clean_text", F.array_join(left, "\n"))
        .withColumn("lines_failed", (F.size(held) - F.size(left)).cast("bigint"))
        .withColumn("word_chars", _word_chars(text).cast("bigint"))
        .withColumn("kept_word_chars", _word_chars(F.array_join(left, "")).cast("bigint"))
        .withColumn("accepted", (F.col("kept_word_chars") > 0) & (F.col("kept_word_chars") * 100 >= F.col("word_chars") * rules.min_kept_percent))
        .drop(held, left)
    )


def with_repeated_window_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds how many words of the array column `words` stand in a run of three that occurs twice or more in it.

    Texts whose runs all differ are done after hashing them. In others the hashes are sorted with
    their places, and equal neighbours mark their places: one sort of a row's words, whatever
    their number.
    """
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    third = F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0)))
    runs = F.zip_with(F.slice(pairs, F.lit(1), F.size(third)), third, lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    placed = F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    last = F.slice("_order", F.lit(1), F.greatest(F.size("_order") - 1, F.lit(0)))
    later = F.slice("_order", F.lit(2), F.greatest(F.size("_order") - 1, F.lit(0)))
    twins = F.flatten(F.zip_with(last, later, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)).otherwise(F.array().cast("array<int>"))))
    return (
        df.withColumn("_runs", F.when(F.size(words) >= 3, runs).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_order", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), F.sort_array(placed)))
        .withColumn(name, F.when(F.col("_order").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(twins))).cast("bigint"))
        .drop("_runs", "_order")
    )


def line_report(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """The digest of `clean_lines` per document, with counts of the base rules.

    A null text has no words: all counts 0, `base_failed`. One row out for each row in.
    """
    text = F.col("text")
    base = clean_lines(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rules).drop("clean_text")
    base = base.withColumn("_words", F.filter(F.split(text, SEPARATOR_CLASS + "+"), lambda w: w != ""))
    base = base.withColumn("_all_lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    counted = (
        with_repeated_window_words(base, "_words", "n_repeat_words")
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("n_symbols", _count(text, f"[{SYMBOLS}]").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_all_lines") - F.size(F.array_distinct("_all_lines"))).cast("bigint"))
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_failed", "kept_word_chars", "base_failed", (~failed & F.col("accepted")).alias("kept")
    )
