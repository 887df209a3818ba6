"""License scans by a positional rare-token index."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import words

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Our own templates, of which four fifths of the words must stand in place: words, key phrase, label.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version", "gnu general public license", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("released under the mit license", "the mit license", "mit-notice"),
    ("gnu lesser general public license", "lesser general public license", "lgpl"),
    ("gnu affero general public license", "affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mozilla public license", "mpl-2.0"),
    ("creative commons attribution", "creative commons attribution", "cc"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("you can redistribute it and or modify it under the terms of the gnu", "under the terms of the gnu", "gpl-text"),
    ("you may not use this file except in compliance with the license", "except in compliance with the license", "apache-text"),
]


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    key: tuple[int, int]  # first and last place of the mandatory key phrase
    label: str
    base: bool

    @property
    def needed(self) -> int:
        return len(self.words) if self.base else math.ceil(0.8 * len(self.words))

    def probes(self, rarity: dict[str, int]) -> list[int]:
        """The places of its rarest words: one more than may be absent, so that no match lacks them all."""
        order = sorted(range(len(self.words)), key=lambda i: (rarity.get(self.words[i], 0), self.words[i], i))
        return order[: len(self.words) - self.needed + 1]


def templates() -> list[Template]:
    out = [Template(tuple(p.split()), (0, len(p.split()) - 1), label, True) for p, label in BASE.items()]
    for text, key, label in TEMPLATES:
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append(Template(tuple(w), (at, at + len(k) - 1), label, False))
    return out


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all documents each word of the vocabulary occurs; the driver gets a row for each of these words."""
    met = docs.select(F.explode(F.array_intersect(words("text"), _strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Of each template the words with the highest inverse document frequency (counted over all of docs) are looked up
    in a file; a hit gives the template's place relative to it, distinct places are checked word by word, and the key
    phrase must stand whole. So many words are looked up that a match can't lack all of them. Base phrases are
    templates of which every word must stand. score is the largest share of a matched template's words, 0 without a
    match. Null and empty texts: no words, empty labels. Rows are independent of each other, whatever their doc_id.
    """
    known = templates()
    vocabulary = sorted({w for t in known for w in t.words})
    rarity = document_frequencies(docs, vocabulary)  # a lower frequency is a higher IDF
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(known):
        for at in t.probes(rarity):
            postings.setdefault(t.words[at], []).append((n, at))
    rows = docs.select("doc_id", F.coalesce(words("text"), F.array().cast("array<string>")).alias("w"))
    rare = ", ".join(f"'{w}'" for w in sorted(postings))
    rows = rows.withColumn("met", F.expr(f"filter(sequence(0, greatest(size(w), 1) - 1), i -> get(w, i) in ({rare}))"))
    looked_up = F.create_map(*(x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(n).alias("t"), F.lit(at).alias("at")) for n, at in p)))))
    rows = rows.withColumn("places", F.array_distinct(F.flatten(F.transform("met", lambda p: F.transform(F.element_at(looked_up, F.get("w", p)), lambda x: F.struct(x["t"].alias("t"), (p - x["at"]).alias("start")))))))
    rows = rows.withColumn("all", F.array(*(_strings(t.words) for t in known)))
    constant = lambda values: F.array(*map(F.lit, values))
    needed, lo, hi = (constant(v) for v in ([t.needed for t in known], [t.key[0] for t in known], [t.key[1] for t in known]))

    def stands(c: Column, j: Column) -> Column:
        return F.coalesce(F.get("w", c["start"] + j) == F.get(F.get("all", c["t"]), j), F.lit(False))

    def checked(c: Column) -> Column:
        count = F.size(F.filter(F.sequence(F.lit(0), F.size(F.get("all", c["t"])) - 1), lambda j: stands(c, j)))
        key = F.forall(F.sequence(F.get(lo, c["t"]), F.get(hi, c["t"])), lambda j: stands(c, j))
        return F.struct(c["t"].alias("t"), c["start"].alias("start"), count.alias("n"), key.alias("key"))

    rows = rows.withColumn("found", F.filter(F.transform("places", checked), lambda c: c["key"] & (c["n"] >= F.get(needed, c["t"]))))
    n_base = len(BASE)
    base = F.filter("found", lambda c: c["t"] < n_base)
    labels = constant([t.label for t in known])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda c: F.get(labels, c["t"])))), ",")
    starts = F.transform(base, lambda c: c["start"].cast("long"))
    share = F.transform("found", lambda c: c["n"] / F.size(F.get("all", c["t"])))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined("found").alias("labels"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )
