"""Text functions as Column expressions."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GREETING_PATTERN, MANUAL_ENTRY, NEW_CHAT, NO_CONTEXT, REFUSAL, SETTINGS

#: Unicode white space (the ASCII separators 1C-1F included), as Java and as RE2 write it.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
WHITE_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def normalise_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


@functools.cache
def _upper_pairs() -> tuple[str, str]:
    """Characters that have an upper case of one character, and that; the sharp s has its capital."""
    pairs = {c: next((x for x in (c.upper(), c.title()) if len(x) == 1), c) for c in map(chr, range(sys.maxunicode + 1))} | {"ß": "ẞ"}
    return tuple(map("".join, zip(*((c, x) for c, x in pairs.items() if c != x), strict=True)))


def upper_by_character(c: Column) -> Column:
    """Upper case of each character alone, so a text keeps its length, as in DuckDB; Spark's own makes SS of a sharp s."""
    return F.translate(c, *_upper_pairs())


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def chunks(c: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Windows of any text; long texts go faster through ``windows`` on a column that holds the normalised text."""
    return windows(normalise_space(F.coalesce(c, F.lit(""))), size, overlap)


def windows(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Windows of ``size`` code points at steps of size - overlap (1 at least) over normalised text; the last reaches its end.

    ``text`` is evaluated for every window, so it should be a plain column.
    """
    step = max(size - overlap, 1)
    n = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - size) / step).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.trim(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(cut, lambda w: w != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def features(c: Column) -> Column:
    """Tokens and pairs of neighbours, repeats kept."""
    return features_of(tokens(c))


def features_of(words: Column) -> Column:
    """The same from a column of tokens, which is then cut out of the text once."""
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def is_greeting(c: Column) -> Column:
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+", " "))
    return letters.rlike(GREETING_PATTERN)


def is_empty_context(c: Column) -> Column:
    return c.isNull() | (c == "") | (strip(c) == NO_CONTEXT)


def is_refusal(c: Column) -> Column:
    return strip(c) == REFUSAL


def clipped(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail(history: Column, n: int) -> Column:
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), n)


def spoken(history: Column) -> Column:
    """User and assistant turns that are not blank, stripped."""
    kept = F.filter(history, lambda m: m["role"].isin("user", "assistant") & ~is_blank(m["content"]))
    return F.transform(kept, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))


def history_text(history: Column, n: int = SETTINGS.query_history, chars: int = SETTINGS.history_chars) -> Column:
    said = spoken(tail(history, n))
    return F.array_join(F.transform(said, lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), clipped(m["content"], chars))), "\n")


def retrieval_query(query: Column, history: Column, n: int = SETTINGS.query_history) -> Column:
    said = history_text(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), n)
    return F.when(said == "", query).otherwise(F.concat(F.lit("Recent conversation:\n"), said, F.lit("\n\nCurrent question: "), query))


def user_prompt(query: Column, context: Column) -> Column:
    return strip(F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), query))


def title_or_default(c: Column) -> Column:
    return clipped(F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(NEW_CHAT)), SETTINGS.title_chars)


def normal_username(c: Column) -> Column:
    return F.lower(strip(c))


def role_of(c: Column, admins=SETTINGS.admins) -> Column:
    return F.when(normal_username(c).isin(*admins), "admin").otherwise("user")


def basename(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "[^/]*$", 0))


def extension(c: Column) -> Column:
    return F.regexp_extract(c, r"\.([^./]*)$", 1)


def source_label(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(MANUAL_ENTRY))


def megabytes(n: Column) -> Column:
    return F.format_string("%.2f MB", F.greatest(n / 1048576.0, F.lit(0.01)))


def daypart(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "morning").when(F.hour(ts) < 17, "afternoon").otherwise("evening")


def uuid_of(*parts: Column) -> Column:
    """A repeatable id in UUID layout."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
