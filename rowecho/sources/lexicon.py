"""Lexicon: the words a language is known to have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Words the lexicon must not contain.
EXCLUDED_WORDS = ("blue-collar", "admin.", "self-employed")


def lexicon_from_words(words: DataFrame, word: str = "word",
                       excluded: Iterable[str] = EXCLUDED_WORDS) -> DataFrame:
    """Lower-case distinct words without the excluded ones."""
    lowered = words.select(F.lower(F.col(word)).alias("word"))
    return lowered.filter(~F.col("word").isin(*excluded)).distinct()


def lexicon_from_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lexicon of the words a corpus uses: letters only, combined per task before the shuffle."""
    tokens = texts.select(
        F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")
    ).filter("word <> ''")
    return lexicon_from_words(tokens)


def is_letter(word: Column) -> Column:
    return word.rlike("^[A-Za-z]$")


def tag_lexicon(words: DataFrame, lexicon: DataFrame, value: str = "value",
                kind: str = "kind") -> DataFrame:
    """Add ``in_lexicon``. The whole string is looked up, whatever its case; single letters are
    words; values that are not strings are never looked up and count as known."""
    known = lexicon.select(F.col("word").alias("_word"), F.lit(True).alias("_known"))
    return (
        words.join(known, F.lower(F.col(value)) == F.col("_word"), "left")
        .withColumn(
            "in_lexicon",
            (F.col(kind) != "string") | F.coalesce(F.col("_known"), F.lit(False)) | is_letter(F.col(value)),
        )
        .drop("_word", "_known")
    )


def outside_lexicon(words: DataFrame, lexicon: DataFrame, value: str = "value",
                    kind: str = "kind") -> DataFrame:
    """The string values that are not words of the lexicon."""
    asked = words.filter((F.col(kind) == "string") & ~is_letter(F.col(value)))
    return asked.join(lexicon, F.lower(F.col(value)) == F.col("word"), "left_anti")
