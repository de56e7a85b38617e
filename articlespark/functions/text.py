"""Text scalar functions as Spark Column expressions.

Everything here is a built-in expression (regexp_replace, sha2, lower, ...), so
it stays inside whole-stage codegen; no Python runs per row.  The regular
expressions use explicit character classes that mean the same thing in Java
(Spark) and RE2 (DuckDB, our SQL oracle):

* ``WS`` equals Python's ``str.isspace`` over the BMP (Java's ``\\s`` misses
  U+00A0 and friends, RE2's ``\\s`` is ASCII only).
* ``TOKEN`` is the two-or-more word-character run used for TF-IDF terms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]"
# Possessive ``{2,}+``: a maximal run of word characters is followed by a
# non-word character, so it matches exactly the runs of the greedy form
# (which the RE2 twin in plans/registry.py uses) without backtracking.
TOKEN = r"[\p{L}\p{N}_]{2,}+"
TAG = r"<[^>]+>"

# The 50-word Vietnamese + English stop set of the title-word
# frequency chart, and the characters stripped from both ends of each word.
TITLE_STOPWORDS = (
    "và", "của", "cho", "các", "một", "với", "trong", "từ",
    "này", "được", "là", "có", "không", "người", "đã", "khi",
    "the", "a", "an", "is", "in", "on", "at", "to", "for",
    "of", "and", "or", "but", "by", "it", "as", "be", "ở",
    "về", "theo", "bị", "tại", "ra", "lên", "đến", "sau",
    "vì", "như", "sẽ", "do", "hay", "thì", "vào", "nhưng",
)
TITLE_STRIP_CHARS = ".,!?()\"'"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col: str | Column) -> Column:
    """Runs of any Unicode whitespace -> one space (no trim)."""
    return F.regexp_replace(_c(col), WS + "++", " ")  # possessive: same runs, no backtracking


def clean_text(col: str | Column) -> Column:
    """collapse whitespace and trim; NULL/'' -> ''."""
    return F.trim(collapse_ws(F.coalesce(_c(col), F.lit(""))))


def normalize_text(col: str | Column) -> Column:
    """strip tags (replaced by nothing), collapse whitespace, trim, lower."""
    no_tags = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"<[^>]++>", "")  # TAG, possessive
    return F.lower(F.trim(collapse_ws(no_tags)))


def fingerprint(col: str | Column) -> Column:
    """SHA-256 hex of the UTF-8 text; ''/NULL -> '' (not the hash of '')."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(c == "", F.lit("")).otherwise(F.sha2(c, 256))


def content_hash(col: str | Column) -> Column:
    """fingerprint of the normalised content."""
    return fingerprint(normalize_text(col))


def snippet(col: str | Column, n: int = 120) -> Column:
    """F8: first ``n`` characters plus an ellipsis when longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def time_text(col: str | Column, now) -> Column:
    """``yyyy-MM-dd HH:mm``; NULL -> ``now`` (a parameter, never the clock)."""
    return F.date_format(F.coalesce(_c(col), F.lit(now).cast("timestamp")), "yyyy-MM-dd HH:mm")


def absolutize_url(col: str | Column, base_url: str | Column) -> Column:
    """a URL starting with '/' gets the site base prepended."""
    c = _c(col)
    base = base_url if isinstance(base_url, Column) else F.lit(base_url)
    return F.when(c.startswith("/"), F.concat(base, c)).otherwise(c)


def doc_text(title: str | Column, content: str | Column) -> Column:
    """``title + ' ' + content`` (NULL if either is NULL, like pandas)."""
    return F.concat(_c(title), F.lit(" "), _c(content))


def append_source(acc: Column, new: Column) -> Column:
    """append ``new`` to a comma list unless it already occurs as a substring.

    ``instr(acc, '') = 1`` so an empty addition leaves the list unchanged.
    """
    return (F.when(new.isNull(), acc)
            .when(acc.isNull() | (acc == ""), new)
            .when(F.instr(acc, new) > 0, acc)
            .otherwise(F.concat(acc, F.lit(","), new)))


def fold_sources(initial: Column, sources: Column) -> Column:
    """F12 over an ordered array of sources (bounded: distinct sources only)."""
    return F.aggregate(sources, F.coalesce(initial, F.lit("")), lambda a, x: append_source(a, x))


def tokens(col: str | Column, stopwords: Iterable[str] = ()) -> Column:
    """lower-cased word tokens (2+ word chars) minus a stop list."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(col).cast("string"), F.lit(""))), F.lit(TOKEN), 0)
    stop = sorted(set(stopwords))
    if not stop:
        return toks
    # ``isin`` with many literals becomes a hash-set lookup (InSet)
    return F.filter(toks, lambda t: ~t.isin(stop))


def title_words(col: str | Column) -> Column:
    """whitespace split; keep raw length > 2 and lower not a stop word;
    then strip punctuation from both ends (may leave '')."""
    words = F.split(F.trim(collapse_ws(F.coalesce(_c(col), F.lit("")))), " ")
    stop = list(TITLE_STOPWORDS)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stop))
    cls = "[" + TITLE_STRIP_CHARS.replace("\\", "\\\\") + "]"
    return F.transform(kept, lambda w: F.regexp_replace(w, f"^{cls}+|{cls}+$", ""))


def first_line(col: str | Column) -> Column:
    """Headline of a text: its whole first line."""
    return F.substring_index(_c(col), "\n", 1)
