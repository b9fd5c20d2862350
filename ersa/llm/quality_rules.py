"""Line-first cleaning and document quality rules, in DataFrame expressions only.

Rules look at single lines first: punctuation (symbols or exclamation runs instead of sentences,
shouting), navigation (menu separators) and boilerplate (stock phrases, a line seen before in the
document, one word over and over).  Lines that fail are removed; a document that loses more than
``max_lost_percent`` of its word characters that way is rejected.  Base counts over the whole
text (words, symbols, repeated lines, repeated three-word windows) reject a document on their own.

Repeated windows are found inside the row: window hashes are sorted with their positions, equal
neighbours are repeats, and the covered words follow from the gaps between repeat positions.
Everything is a projection over the scan, with no shuffle; a text of n words costs n log n.

Edge cases: a null text has no words and lines; an empty or short text fails the base rule
(fewer than ``min_words`` words); repeated rows give repeated results; an empty table gives an
empty result; a null doc_id is kept; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bodies of regular-expression classes.
SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
SPLIT = f"[{SPACES}]+"

#: Stock phrases of web boilerplate in English, German, French and Spanish, in lower case.
BOILERPLATE = (
    "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "javascript is disabled",
    "log in to", "lorem ipsum", "privacy policy", "read more", "share this", "sign in to", "sign up for",
    "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies",
    "alle rechte vorbehalten", "cookie-richtlinie", "hier klicken", "javascript aktivieren", "nach oben", "nutzungsbedingungen",
    "verwendung von cookies", "weiterlesen", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "cliquez ici", "conditions générales", "haut de page", "lire la suite", "politique de confidentialité",
    "tous droits réservés", "utilisation de cookies",
    "aviso legal", "haga clic aquí", "ir al contenido", "leer más", "política de cookies", "política de privacidad", "todos los derechos reservados",
    "términos de uso", "uso de cookies", "volver arriba",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds.  A line's percentages are of its bytes; the last one is of the document's word characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_symbols_percent: int = 10
    line_min_words: int = 4
    line_exclamations_percent_of_words: int = 50
    line_menu_separators: int = 3
    line_repeat_words: int = 10
    line_rest_percent: int = 30
    max_lost_percent: int = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (lambda variables are bound, not inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the regular-expression class body ``chars``."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT, -1), "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``words``."""
    def over_windows(g: Column) -> Column:
        # most texts repeat no window; only the others pay for sorting windows with their positions
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))), over_sorted))

    def over_sorted(s: Column) -> Column:
        repeats = F.filter(s, lambda x, j: F.get(s, j - 1)["g"].eqNullSafe(x["g"]) | F.get(s, j + 1)["g"].eqNullSafe(x["g"]))
        return let(F.array_sort(F.transform(repeats, lambda x: x["p"])), covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.slice(windows, F.lit(1), F.size(words) - 2), over_windows))


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether a line with a word fails the punctuation, navigation or boilerplate rules.

    A line's size is its bytes, and its words are its spaces plus one."""
    size, words = F.octet_length(line), F.regexp_count(line, F.lit(" ")) + 1
    symbols = count_of(line, SYMBOLS) * 100 > size * rules.line_symbols_percent
    shouting = line.contains("!!") & (F.regexp_count(line, F.lit("!")) * 100 > words * rules.line_exclamations_percent_of_words)
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & (words >= rules.line_min_words)
    menu = count_of(line, "|»›•·") >= rules.line_menu_separators
    stock = F.lower(line).rlike("\\b(?:" + "|".join(BOILERPLATE) + ")")
    first = F.substring_index(F.ltrim(line), " ", 1)
    droning = (words >= rules.line_repeat_words) & (F.octet_length(F.replace(line, first, F.lit(""))) * 100 < size * rules.line_rest_percent)
    return capitals | symbols | shouting | menu | stock | droning


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, ``base_failed``, ``kept``, the counts of removed lines and
    characters, and ``cleaned``, the text without the failing lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    measures = rows.select(
        "doc_id",
        (F.length("text") - count_of(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(word_array(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(F.split("text", "\n", -1), lambda lines: _line_work(lines, rules)).alias("l"))
    base = measures.select(
        "doc_id", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"), F.col("l.n_removed").alias("n_lines_removed"),
        F.col("l.lost").alias("n_chars_removed"), F.col("l.cleaned").alias("cleaned"))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_chars_removed") * 100 <= F.col("word_chars") * rules.max_lost_percent)).alias("kept"),
        "n_lines_removed", "n_chars_removed", "cleaned")


def _line_work(lines: Column, rules: Rules) -> Column:
    filled = F.filter(lines, lambda x: x.rlike(f"[^{SPACES}]"))

    def work(full: Column) -> Column:
        return let(F.array_distinct(full), lambda distinct: let(
            F.filter(distinct, lambda x: line_fails(x, rules)), lambda bad: _verdict(lines, full, distinct, bad)))
    return let(filled, work)


def _verdict(lines: Column, full: Column, distinct: Column, bad: Column) -> Column:
    """A line equal to an earlier one goes as boilerplate; so only first occurrences can stay."""
    def chars(of: Column) -> Column:
        text = F.array_join(of, "\n")
        return (F.length(text) - count_of(text, SPACES)).cast("long")

    def outcome(kept: Column) -> Column:
        whole = F.size(kept) == F.size(full)
        return F.struct(
            (F.size(full) - F.size(distinct)).cast("long").alias("n_dup_lines"),
            (F.size(full) - F.size(kept)).cast("long").alias("n_removed"),
            F.when(whole, F.lit(0).cast("long")).otherwise(chars(full) - chars(kept)).alias("lost"),
            F.when(whole, F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n")).alias("cleaned"))

    return let(F.when(F.size(bad) == 0, distinct).otherwise(F.array_except(distinct, bad)), outcome)


def clean_documents(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns and the cleaned text in ``text_col``.

    Measured in the same projection as the other columns, so no join back is needed.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kept = quality(packed, rules).where("kept")
    return kept.select(*[(F.col("cleaned") if c == text_col else F.col("doc_id").getField(c)).alias(c) for c in docs.columns])
