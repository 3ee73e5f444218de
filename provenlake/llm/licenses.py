r"""License scans by a positional index of rare words, in DataFrame functions alone.

Templates are phrases and notices of licences, as words. How rare a licence word is, is counted over all documents (one row a word of
the templates). The index has, for each template, its rarest words with their positions (four, or half of a short one's, two at
least). A document's places of indexed words are looked up there; each posting says where its template would begin, and starts on
which two postings agree go on: that is the intersection of postings by relative position. At such a start the template's mandatory
words have to stand each at its own place (for a phrase these are all of its words, so that no place of a phrase is missed), and
as much of the rest as ``share`` says. A document never leaves its row, so nothing is shuffled but the word counts, and a
template that a third of all documents hold is no hot key.

Words: A-Z lower-cased, then [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. Score: the greatest share of a template's words found in place where that
template was accepted, else 0. Ties in rareness: the lesser word is rarer.

Nulls: a null text is empty (no words, empty labels, null places); a null doc_id stays null. Repeated rows are scanned each. An empty
table gives no rows. Other columns are ignored. Very long texts are one array of words of one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label's words; mandatory: phrases among them that have to stand in place (none given: all words)."""

    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def required(self) -> list[int]:
        """Positions of mandatory words."""
        words, out = self.words, set()
        for phrase in self.mandatory or (self.text,):
            own = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            if not at:
                raise ValueError(f"{self.label}: no {phrase!r} in the template")
            out.update(range(at[0], at[0] + len(own)))
        return sorted(out)


#: The phrases of the query's contract.
PHRASES = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
]
#: Sentences of public licence notices, and what of them is mandatory.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("epl-2", "eclipse public license v 2 0"),
]
TEMPLATES = PHRASES + NOTICES
#: Share of a template's words that have to stand in place.
SHARE = 0.8
#: Indexed words of a template at most, and how many of them have to agree on a start.
INDEXED, AGREE = 4, 2
#: A start is one number: its template's, and in the lower bits its place, which may lie before the text.
BITS, BEFORE = 32, 1 << 16


def words_of(text: Column) -> Column:
    """The words of a text, as an array; of a null one, none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Two letters beyond ASCII have ASCII in lower case; elsewhere Spark's lower() parts and spells ASCII words as A-Z alone would.
    odd = text.contains("K") | text.contains("İ")
    own = F.when(odd, F.translate(text, upper, lower)).otherwise(F.lower(text))
    return F.filter(F.split(F.regexp_replace(F.coalesce(own, F.lit("")), GAP, " "), " "), lambda w: w != "")


def document_counts(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of a vocabulary occurs: a row a word comes to the driver."""
    met = words.select(F.explode(F.array_intersect(column, F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r.word: r.n for r in met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_of(templates: list[Template], counts: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of each template's rarest words."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        words = template.words
        rarest = sorted(set(words), key=lambda w: (counts.get(w, 0), w))[: max(AGREE, min(INDEXED, len(words) // 2))]
        for i, w in enumerate(words):
            if w in rarest:
                out.setdefault(w, []).append((t, i))
    return out


def _starts(words: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """Starts, ascending and each once, on which postings of a document's indexed words agree."""
    rare = F.array(*map(F.lit, sorted(index)))
    postings = F.array(*[F.array(*[F.lit((t << BITS) + BEFORE - i).cast("long") for t, i in index[w]]) for w in sorted(index)])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.get(words, p).isin(*sorted(index)))
    # postings of a place: the word's own, moved there
    told = F.flatten(F.transform(places, lambda p: F.transform(F.get(postings, F.array_position(rare, F.get(words, p)).cast("int") - 1), lambda x: x + p)))
    return F.when(F.size(words) > 0, F.sort_array(told)).otherwise(F.array().cast("array<bigint>"))


def _agreed(told: Column) -> Column:
    """Numbers that a sorted array holds AGREE times or more, each once."""
    last = F.lit(AGREE - 1)
    return F.filter(told, lambda x, i: (F.get(told, i + last) == x) & ~F.coalesce(F.get(told, i - 1) == x, F.lit(False)))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (label, template, start, share)."""
    if any(len(t.words) < AGREE or len(t.words) > BEFORE for t in templates):
        raise ValueError(f"a template has {AGREE} words at least")
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    index = index_of(templates, document_counts(words, "words", sorted({w for t in templates for w in t.words})))
    strings = lambda xs: F.array(*map(F.lit, xs))
    text, required = F.array(*[strings(t.words) for t in templates]), F.array(*[strings(t.required) for t in templates])
    label, base = strings([t.label for t in templates]), strings([t.base for t in templates])

    def place(x: Column) -> Column:
        """(label, template, start, share) of a start; share is null where a mandatory word is not in place."""
        t, start = F.shiftright(x, BITS).cast("int"), (x.bitwiseAND((1 << BITS) - 1) - BEFORE).cast("int")
        own = F.get(text, t)
        stands = lambda i: F.get("words", start + i).eqNullSafe(F.get(own, i))
        met = F.size(F.filter(F.sequence(F.lit(0), F.size(own) - 1), stands)) / F.size(own)
        return F.struct(F.get(label, t).alias("label"), t.alias("template"), start.cast("long").alias("start"), F.when((start >= 0) & F.forall(F.get(required, t), stands), met).alias("share"))

    told = words.withColumn("told", _starts(F.col("words"), index)).withColumn("agreed", _agreed(F.col("told")))
    found = told.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("agreed", place), lambda p: p["share"] >= share).alias("places"))
    own = F.filter("places", lambda p: F.get(base, p["template"]))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda p: p["label"]))), ",")
    starts = F.transform(own, lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(own).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )


def digest(docs: DataFrame) -> DataFrame:
    """scan() with all templates: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan(docs).drop("places")
