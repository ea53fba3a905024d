"""Text expressions with Python string semantics, built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions.jsonv import let

# Patterns and word lists that decide results.
PY_SPACE = r"(?U)[\s\x1c-\x1f\x85]+"
PY_EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+\z"
ANSI_OR_CR = r"\x1b\[[0-9;]*m|\r"
ARTICLES = r"(?U)\b(a|an|the)\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHELL_UNSAFE = r"[^A-Za-z0-9_@%+=:,./-]"
START_MARKER = ">>>>> Start Test Output"
END_MARKER = ">>>>> End Test Output"


def py_strip(c: Column) -> Column:
    """``str.strip()``: all Unicode whitespace, not only spaces."""
    return F.regexp_replace(c, PY_EDGE_SPACE, "")


def py_words(c: Column) -> Column:
    """``str.split()``: non-empty whitespace-separated words."""
    return F.filter(F.split(c, PY_SPACE), lambda w: w != "")


def collapse_space(c: Column) -> Column:
    """Null becomes empty; runs of whitespace become one space; edges are cut."""
    return F.coalesce(py_strip(F.regexp_replace(c, PY_SPACE, " ")), F.lit(""))


def strip_ansi(c: Column) -> Column:
    """Drop colour codes and carriage returns; plain text skips the regular expression."""
    return F.when(c.contains("\x1b") | c.contains("\r"), F.regexp_replace(c, ANSI_OR_CR, "")).otherwise(c)


def normalize_answer(c: Column) -> Column:
    """Lower case, articles to spaces, punctuation out, whitespace collapsed."""
    bare = F.translate(F.regexp_replace(F.lower(c), ARTICLES, " "), PUNCTUATION, "")
    return py_strip(F.regexp_replace(bare, PY_SPACE, " "))


def exact_match(prediction: Column, targets: Column) -> Column:
    """True when any target equals the prediction after normalisation."""
    hit = let(normalize_answer(prediction), lambda want: F.exists(targets, lambda t: normalize_answer(t) == want))
    return F.coalesce(hit, F.lit(False))


def test_section(log: Column) -> Column:
    """Text between the first start marker and the next marker; null if one is missing."""
    found = log.contains(START_MARKER) & log.contains(END_MARKER)
    after = F.split_part(log, F.lit(START_MARKER), F.lit(2))
    return F.when(found, F.split_part(after, F.lit(END_MARKER), F.lit(1)))


def shell_quote(c: Column) -> Column:
    """Quote for a POSIX shell, leaving plainly safe words alone."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(c == "", F.lit("''")).when(c.rlike(SHELL_UNSAFE), quoted).otherwise(c)


def spaced_json(compact: Column) -> Column:
    """Compact JSON text with a space after each separator outside strings.

    Escapes are set aside, so that every quote left opens or closes a string; of the pieces
    between quotes the even ones are outside. No pattern is involved: the time is linear and
    the stack does not grow with the text.
    """
    bare = F.replace(F.replace(compact, F.lit("\\\\"), F.lit("\x00")), F.lit('\\"'), F.lit("\x01"))
    apart = lambda piece: F.replace(F.replace(piece, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    pieces = F.transform(F.split(bare, '"', -1), lambda piece, i: F.when(i % 2 == 0, apart(piece)).otherwise(piece))
    joined = F.array_join(pieces, '"')
    return F.replace(F.replace(joined, F.lit("\x01"), F.lit('\\"')), F.lit("\x00"), F.lit("\\\\"))


def count_matches(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a needle in the lower-cased text."""
    if not needle:
        return F.lit(0)
    low = F.lower(c)
    gone = F.length(F.replace(low, F.lit(needle), F.lit("")))
    return ((F.length(low) - gone) / len(needle)).cast("int")


def completion_tokens(c: Column) -> Column:
    """Word count, at least one, used when no token usage was reported."""
    return F.greatest(F.size(py_words(F.coalesce(c, F.lit("")))), F.lit(1))


def render_prompt(statement: Column, template: str) -> Column:
    """Fill ``{problem_statement}`` by plain replacement."""
    return F.replace(F.lit(template), F.lit("{problem_statement}"), statement)
