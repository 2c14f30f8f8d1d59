"""String functions: stripping, lines, tokens, snippets, code fences, bars and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words (by Unicode's notion of one) with another character than ASCII letters and digits, and several hyphens in a row: both end a token.
NO_TOKEN = r"(?U)\b[a-z0-9]*+[\w&&[^a-z0-9]]\w*|--+"
#: Tokens of what is left: ASCII letters and digits with single hyphens between them. No pattern repeats a group, which java.util.regex walks by recursion, one level for each time.
TOKEN = r"[a-z0-9][a-z0-9-]*(?<!-)"
#: White space as Python's str.strip() has it (fixed values).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c: Column) -> Column:
    """Without white space (Unicode's, and the four separators below a space) at the ends."""
    return F.trim(c, F.lit(BLANKS))


def lines(c: Column) -> Column:
    """Array of lines at any line boundary; a line end at the very end makes no further line."""
    return F.split(F.regexp_replace(c, f"(?:{_LINE_END})\\z", ""), _LINE_END)


def tokens(c: Column) -> Column:
    """Array of lower-case tokens. A word with an underscore or a letter beyond ASCII gives none; codes with hyphens stay whole."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NO_TOKEN, " ")
    return F.regexp_extract_all(words, F.lit(TOKEN), F.lit(0))


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def snippet(c: Column, length: int = 60, always: bool = False) -> Column:
    """The first characters on one line, with dots where something is left out (or always)."""
    head = F.translate(F.substring(c, 1, length), "\n", " ")
    return F.concat(head, F.lit("...")) if always else F.when(F.length(c) > length, F.concat(head, F.lit("..."))).otherwise(head)


def unfenced(c: Column) -> Column:
    """Without a code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))


def bar(score: Column, width: int = 10) -> Column:
    """Full blocks for the score's share of the width, halves to the even count."""
    full = F.bround(score * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def label(score: Column) -> Column:
    return F.when(score >= 0.8, "pass").when(score >= 0.5, "warn").otherwise("fail")
