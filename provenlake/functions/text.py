"""Column expressions over text: sentences, tokens, markers, words. JVM-side only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenlake.functions import fixed

DOT = "\ue000"  # stands for a full stop that ends no sentence
URL_DOT = "\ue001"  # the same within a URL


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in s)


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markers(text: Column) -> Column:
    """Without citation markers such as [3], and without the blanks they leave."""
    return collapse(F.regexp_replace(F.regexp_replace(text, r"\s*\[\d+\]", ""), r"\s+([.,;:!?])", "$1"))


def markers(text: Column) -> Column:
    """Labels of citation markers, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))


def word_count(text: Column) -> Column:
    t = collapse(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def sentences(text: Column, cited: bool = False) -> Column:
    """Sentences of a text as an array. A sentence ends after . ! or ? before white space or a capital letter; full stops in
    decimals, abbreviations (whole words, their letters kept) and initialisms end none. cited: a marker right after the full
    stop belongs before it, and full stops in URLs end none either."""
    t = text
    if cited:
        t = F.regexp_replace(t, r"([.!?])((?:\[\d+\])+)", "$2$1")
        # every full stop within a URL: from its beginning, or from where the last one of it was found
        t = F.regexp_replace(t, r"(https?://|\G(?!^))([^\s.]*)\.(?=\S)", "$1$2" + URL_DOT)
    t = F.regexp_replace(t, r"(?<=\d)\.(?=\d)", DOT)
    words = [a[:-1] for a in fixed.ABBREVIATIONS if "." not in a[:-1]]
    t = F.regexp_replace(t, r"(?i)(?<![A-Za-z])(" + "|".join(map(_quoted, words)) + r")\.", "$1" + DOT)
    for a in fixed.ABBREVIATIONS:
        inner = a[:-1].split(".")
        if len(inner) > 1:
            pattern = r"(?i)(?<![A-Za-z])" + r"\.".join(f"({_quoted(x)})" for x in inner) + r"\."
            t = F.regexp_replace(t, pattern, DOT.join(f"${i + 1}" for i in range(len(inner))) + DOT)
    # A.B.C.: each letter's stop before or after another letter's
    t = F.regexp_replace(t, r"(?U)(?<![A-Za-z])([A-Z])\.(?=[A-Z]\.)", "$1" + DOT)
    t = F.regexp_replace(t, DOT + r"([A-Z])\.(?![A-Z]\.)", DOT + "$1" + DOT)
    parts = F.split(t, r"(?U)(?<=[.!?])(?:\s+|(?=[A-Z]))")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, f"[{DOT}{URL_DOT}]", "."))), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Distinct keyword tokens in lower case, sorted, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(" + fixed.TOKEN.replace("A-Z", "") + ")"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), words(fixed.STOPWORDS)))


def words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def singular(token: Column) -> Column:
    t = F.regexp_replace(token, r"^[-'/]+|[-'/]+$", "")
    long = F.length(t) > 4
    return F.when(long & t.endswith("ies"), F.regexp_replace(t, "ies$", "y")).when(long & t.rlike("(ch|sh|x|z|s)es$"), F.regexp_replace(t, "es$", "")).when(long & t.rlike("(?<!s)s$"), F.regexp_replace(t, "s$", "")).otherwise(t)


def identity_terms(text: Column) -> Column:
    """Subject words of a text: tokens without digits, singular, of 4 letters at least, without generic words."""
    own = F.transform(F.filter(tokens(text), lambda x: ~x.rlike("[0-9]")), singular)
    return F.array_sort(F.array_except(F.array_distinct(F.filter(own, lambda x: F.length(x) >= 4)), words(fixed.IDENTITY_EXCLUSIONS)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: Catalyst finds no common parts in branches and lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stems(pattern: str) -> list[str]:
    """What the matches of a pattern ``\\b(one|two...)\\b`` begin with, without its operators: one literal for each alternative."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    if body.startswith("(") and body.endswith(")"):
        body = body[1:-1]
    out, depth, start = [], 0, 0
    for i, c in enumerate(body + "|"):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(body[start:i])
            start = i + 1
    return sorted({re.sub(r"(?s)(?:[\[(.\\]|\w[?*]).*", "", x).lower() for x in out})


def named(text: Column, table: list[tuple[str, str]]) -> Column:
    """Names of the patterns of a table that a text matches, case-insensitively. A pattern is tried only where the text holds the
    beginning of one of its alternatives; letters that ignore case without having it leave all patterns to be tried."""
    odd = F.lit(False)
    for c in "ſıİK":
        odd = odd | text.contains(c)

    def found(low: Column, p: str) -> Column:
        begun = odd
        for stem in stems(p):
            begun = begun | low.contains(stem)
        return begun & text.rlike("(?iU)" + p)

    return once(F.lower(text), lambda low: F.array_sort(F.array_compact(F.array(*(F.when(found(low, p), F.lit(n)) for n, p in table)))))
