"""License scans in DataFrame functions alone: a positional index of rare words.

Templates of license notices are indexed under their rarest words, by inverse document frequency over the
whole corpus. A file's words that the index holds are looked up; each place of such a word says where its
template would begin, and a template whose rare words agree on one beginning is a candidate there. It counts
once its key phrases stand in full at their relative places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold_case, table

#: Phrases counted as base places, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates: label, notice, key phrases of it that must stand in full. A label may have several.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("you can redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("public-domain", "dedicated to the public domain", ("public domain",)),
)
#: Rare words that a template is indexed under, and how many of them must agree on its beginning: two, as agrees() has it.
PROBES, AGREE = 3, 2
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text that is folded to lower case: runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), PARTING), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """How many of all documents hold each word of the templates, and how many documents there are."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    held = docs.select(F.array_intersect(words(fold_case(F.col("text"))), _strings(vocabulary)).alias("held"))
    # the document itself is counted under an empty word
    rows = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").count().collect()  # the vocabulary at most
    counts = {r["word"]: r["count"] for r in rows}
    total = counts.pop("", 0)
    return {w: counts.get(w, 0) for w in vocabulary}, total


def build_index(frequencies: dict[str, int], templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Rare word -> (template, place in it). Of equally frequent words the longer, then the first in order."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(templates):
        own = notice.split()
        for w in sorted(set(own), key=lambda w: (frequencies[w], -len(w), w))[:PROBES]:
            index.setdefault(w, []).extend((t, i) for i, x in enumerate(own) if x == w)
    return index


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def scan(docs: DataFrame, templates=TEMPLATES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs(text) and what its whole texts hold; a row for every row.

    n_words; n_base (all places of the base phrases), first_word and last_word (their least and largest start,
    null without); base_labels; labels (base and templates); both distinct, sorted, comma-joined, empty if none;
    score: the largest share of a found template's words that stand in place, at least 0.5 with a base phrase,
    0 without any label; found: array of (label, word) of the verified templates. Null texts are empty.
    Repeated rows and null keys stay; other columns are not read.
    """
    if any(len(set(n.split())) < AGREE for _, n, _ in templates):
        raise ValueError(f"a template needs {AGREE} different words")
    frequencies, _ = document_frequencies(docs, templates)
    index = build_index(frequencies, templates)
    rows = docs.select(*carry, words(fold_case(F.col("text"))).alias("w"))

    w = F.col("w")

    def base(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE:
            own = phrase.split()
            here = x == own[0]
            for k, word in enumerate(own[1:], 1):
                here = here & (_at(w, i + k) == word)
            out = F.when(here, label).otherwise(out)
        return F.when(out.isNotNull(), F.struct(i.alias("at"), out.alias("label")))

    none = F.array().cast("array<struct<at:int,label:string>>")
    starts = _strings(sorted({p.split()[0] for p, _ in BASE}))
    places = F.when(F.arrays_overlap(w, starts), F.filter(F.transform(w, base), lambda x: x.isNotNull())).otherwise(none)
    rare = sorted(index)
    postings = F.create_map(*[c for k in rare for c in (F.lit(k), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("place")) for t, i in index[k]]))])
    hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(_strings(rare), x), F.struct(x.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    begin = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["place"]).alias("at"), h["word"].alias("word")))))
    begin = F.when(F.arrays_overlap(w, _strings(rare)), F.array_sort(begin)).otherwise(F.array().cast("array<struct<t:int,at:int,word:string>>"))
    rows = rows.select(*carry, "w", places.alias("places"), begin.alias("begin"))

    # in order of (t, at, word): a beginning is kept where a second rare word follows on the first, and once
    def agrees(x: Column, i: Column) -> Column:
        last = _at(F.col("begin"), F.greatest(i - 1, F.lit(0)))
        return (i > 0) & (last["t"] == x["t"]) & (last["at"] == x["at"]) & (last["word"] != x["word"])

    def first(x: Column, i: Column) -> Column:
        last = _at(F.col("agreed"), F.greatest(i - 1, F.lit(0)))
        return (i == 0) | (last["t"] != x["t"]) | (last["at"] != x["at"])

    rows = rows.select(*carry, "w", "places", F.filter("begin", agrees).alias("agreed"))
    begun = F.transform(F.filter("agreed", first), lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at")))
    rows = rows.select(*carry, "w", "places", begun.alias("begun"))

    notices = F.array(*[_strings(n.split()) for _, n, _ in templates])
    phrases = F.array(*[F.array(*[F.struct(F.lit(_offset(n, k)).alias("place"), _strings(k.split()).alias("words")) for k in keys]) for _, n, keys in templates])
    names = _strings([label for label, _, _ in templates])

    def verified(b: Column) -> Column:
        return F.forall(_at(phrases, b["t"]), lambda p: (b["at"] + p["place"] >= 0) & (F.slice(w, F.greatest(b["at"] + p["place"] + 1, F.lit(1)), F.size(p["words"])) == p["words"]))

    def share(b: Column) -> Column:
        notice = _at(notices, b["t"])
        there = F.filter(F.transform(notice, lambda x, i: (b["at"] + i >= 0) & (_at(w, F.greatest(b["at"] + i, F.lit(0))) == x)), lambda x: x)
        return F.size(there) / F.size(notice)

    good = F.transform(F.filter("begun", verified), lambda b: F.struct(_at(names, b["t"]).alias("label"), b["at"].alias("word"), share(b).alias("share")))
    rows = rows.select(*carry, F.size("w").cast("bigint").alias("n_words"), "places", good.alias("good"))
    base_labels = F.array_distinct(F.col("places.label"))
    labels = F.array_distinct(F.concat(base_labels, F.col("good.label")))
    has = F.size("places") > 0
    return rows.select(
        *carry,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.when(has, F.array_min("places.at").cast("bigint")).alias("first_word"),
        F.when(has, F.array_max("places.at").cast("bigint")).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("good.share"), F.lit(0.0)), F.when(has, 0.5).otherwise(0.0)).alias("score"),
        F.transform("good", lambda g: F.struct(g["label"], g["word"])).alias("found"),
    )


def _offset(notice: str, phrase: str) -> int:
    m = re.search(rf"(?<!\S){re.escape(phrase)}(?!\S)", notice)
    if not m:
        raise ValueError(f"{phrase!r} isn't part of {notice!r}")
    return len(notice[: m.start()].split())


def op5_rare_word_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


def _oracle() -> str:
    """The same scan as joins over all words."""
    notices, keys = [], []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):
        notices += [f"({t}, '{label}', {i}, '{w}')" for i, w in enumerate(notice.split())]
        keys += [f"({t}, {_offset(notice, p) + i}, '{w}')" for p in phrases for i, w in enumerate(p.split())]
    base = [f"SELECT a.rid, a.i, '{label}' AS label FROM tok a " + " ".join(f"JOIN tok x{k} ON x{k}.rid = a.rid AND x{k}.i = a.i + {k} AND x{k}.word = '{w}'" for k, w in enumerate(phrase.split()[1:], 1)) + f" WHERE a.word = '{phrase.split()[0]}'" for phrase, label in BASE]
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PARTING}'), lambda x: x <> '') AS w FROM documents),
tok AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
notice(t, label, place, word) AS (VALUES {", ".join(notices)}),
phrase(t, place, word) AS (VALUES {", ".join(keys)}),
df AS (SELECT n.word, COUNT(DISTINCT k.rid) AS df FROM (SELECT DISTINCT word FROM notice) n LEFT JOIN tok k ON k.word = n.word GROUP BY 1),
rare AS (SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY df, -length(word), word) AS k FROM (SELECT DISTINCT t, word FROM notice) JOIN df USING (word)) WHERE k <= {PROBES}),
least AS (SELECT t, least({AGREE}, COUNT(DISTINCT word)) AS need, COUNT(*) AS size, any_value(label) AS label FROM notice GROUP BY t),
begun AS (SELECT k.rid, r.t, k.i - n.place AS b FROM tok k JOIN rare r ON r.word = k.word JOIN notice n ON n.t = r.t AND n.word = r.word GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT k.word) >= (SELECT need FROM least l WHERE l.t = r.t)),
good AS (SELECT b.rid, b.t, b.b FROM begun b JOIN phrase p ON p.t = b.t LEFT JOIN tok k ON k.rid = b.rid AND k.i = b.b + p.place AND k.word = p.word GROUP BY 1, 2, 3 HAVING COUNT(*) = COUNT(k.word)),
share AS (SELECT g.rid, l.label, COUNT(k.word) * 1e0 / any_value(l.size) AS share FROM good g JOIN notice n ON n.t = g.t JOIN least l ON l.t = g.t LEFT JOIN tok k ON k.rid = g.rid AND k.i = g.b + n.place AND k.word = n.word GROUP BY g.rid, g.t, g.b, l.label),
base AS ({" UNION ALL ".join(base)}),
places AS (SELECT rid, COUNT(*) AS n, MIN(i) AS first_word, MAX(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM share) GROUP BY rid),
best AS (SELECT rid, MAX(share) AS share FROM share GROUP BY rid)
SELECT doc_id, len(w) AS n_words, COALESCE(n, 0) AS n_base, first_word, last_word, COALESCE(p.labels, '') AS base_labels, COALESCE(l.labels, '') AS labels,
    greatest(COALESCE(share, 0e0), CASE WHEN n > 0 THEN 0.5e0 ELSE 0e0 END) AS score
FROM docs LEFT JOIN places p USING (rid) LEFT JOIN labels l USING (rid) LEFT JOIN best USING (rid)
"""


ORACLE_SQL = _oracle()
