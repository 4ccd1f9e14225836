"""License scans: a positional index of rare licence words, in DataFrame functions alone.

Licence notices are short word templates. An index holds, for the rarest words of each template, where they stand in it: so many that
the others alone never have the weight that must agree. Each template whose mandatory phrase a text has is looked up by every indexed word
of the text; a posting says at which place the template would begin; at every such place it is laid over the text, and its label counts
if enough of its weight agrees and the phrase stands within it there. So every place of every template is found. All of it happens within a row: nothing is shuffled
but the document counts of the templates' words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ready

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: the contract's phrases and labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, notice, mandatory phrase): words of the public licences' own notices
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license version", "lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution international license", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under the creative commons cc0", "creative commons cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "on an as is basis"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("proprietary", "copyright all rights reserved unauthorized copying of this file is strictly prohibited", "unauthorized copying"),
]

#: share of a template's weight that must agree
AGREES = 0.7


def _words(text: Column) -> Column:
    """The words, joined by single spaces, with one at either end; one space if there are none."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BREAK, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.when(F.trim(spaced) == "", "").otherwise(" "))


def _count(of: Column) -> Column:
    """Spaces in a string."""
    return (F.length(of) - F.length(F.replace(of, F.lit(" "), F.lit("")))).cast("long")


def document_counts(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each word of ``vocabulary`` stands, over all rows, and the number of rows."""
    found = F.array_distinct(F.filter(F.split(_words(F.col(text_col)), " "), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()  # as many rows as the vocabulary has words, and one
    counts = {r["word"]: r["count"] for r in rows}
    return counts, counts.pop("", 0)


def _indexed(ws: list[str], idf: dict[str, float]) -> dict[str, list[int]]:
    """{word: places in the template} of its rarest words, until the weight of the others is less than what must agree."""
    places: dict[str, list[int]] = {}
    rest = total = sum(idf[w] for w in ws)
    for w in sorted(set(ws), key=lambda w: (-idf[w], w)):
        if rest < (AGREES - 1e-5) * total:
            break
        places[w] = [p for p, x in enumerate(ws) if x == w]
        rest -= idf[w] * len(places[w])
    return places


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for every row.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z lower-cased. n_base counts the places of the phrases of BASE;
    first_word and last_word are their smallest and largest start (else null). labels are the base labels and those of templates found;
    score is the largest agreeing share of a template's weight (1 for a base phrase alone, 0 without any label); places lists the templates found
    with the word where they begin. Null and blank texts have no words, empty labels and score 0. Null ids and repeated rows
    stay as they came; other columns are ignored; an empty table gives an empty result. Templates may have any length; what stands of one before a text's
    first word agrees with nothing.
    """
    ready(docs.sparkSession)
    templates = templates or TEMPLATES
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = [t.split() for _, t, _ in templates]
    vocabulary = sorted({w for t in cut for w in t})
    counts, total = document_counts(rows, "text", vocabulary)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    # postings of each template by word: a place without any of them agrees in less than AGREES
    lookup = F.array(*(F.create_map(*(x for w, at in _indexed(ws, idf).items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("of"), F.lit(p).alias("back")) for p in at))))) for t, ws in enumerate(cut)))
    indexed = F.array(*(F.array(*(F.lit(w) for w in _indexed(ws, idf))) for ws in cut))
    laid = F.array(*(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(idf[w] / sum(idf[x] for x in ws)).alias("part")) for p, w in enumerate(ws))) for ws in cut))
    label, length, phrase = (F.array(*map(F.lit, x)) for x in ([x for x, _, _ in templates], map(len, cut), [f" {x} " for _, _, x in templates]))

    base = "(?: " + "| ".join(BASE) + ")(?= )"
    a = rows.select("doc_id", _words(F.col("text")).alias("norm"))
    a = a.withColumn("words", F.split(F.trim("norm"), " ")).withColumn("n_base", F.regexp_count("norm", F.lit(base)).cast("long"))
    held = F.filter(F.array(*(F.when(F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(t)) for t, (_, _, p) in enumerate(templates))), lambda t: t.isNotNull())
    b = a.withColumn("held", held)
    wanted = F.array_distinct(F.flatten(F.transform("held", lambda t: F.get(indexed, t))))
    c = b.withColumn("wanted", F.when(F.size("held") == 0, F.array().cast("array<string>")).otherwise(wanted))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: F.array_contains("wanted", h["w"]))
    c = c.withColumn("hits", F.when(F.size("wanted") == 0, F.array().cast("array<struct<i:int,w:string>>")).otherwise(hits))
    kind = "array<struct<of:int,word:int>>"
    none = F.array().cast(kind)
    starts = F.flatten(F.transform("hits", lambda h: F.flatten(F.transform("held", lambda t: F.transform(F.coalesce(F.element_at(F.get(lookup, t), h["w"]), F.array().cast("array<struct<of:int,back:int>>")), lambda x: F.struct(x["of"].alias("of"), (h["i"] - x["back"]).alias("word")))))))
    d = c.withColumn("starts", F.when(F.size("hits") == 0, none).otherwise(F.array_distinct(starts)))

    def agreeing(s: Column) -> Column:
        of, begin = s["of"], s["word"]
        here = lambda e: (begin + e["p"] >= 0) & (F.get("words", F.greatest(begin + e["p"], F.lit(0))) == e["w"])
        share = F.aggregate(F.get(laid, of), F.lit(0.0), lambda x, e: x + F.when(here(e), e["part"]).otherwise(0.0))
        return F.struct(of.alias("of"), begin.alias("word"), F.round(share, 6).alias("share"))

    def phrase_there(x: Column) -> Column:
        """Whether the words that a template would cover have its mandatory phrase."""
        first = F.greatest(x["word"], F.lit(0))
        covered = F.slice("words", first + 1, F.greatest(x["word"] + F.get(length, x["of"]) - first, F.lit(0)))
        return F.contains(F.concat(F.lit(" "), F.array_join(covered, " "), F.lit(" ")), F.get(phrase, x["of"]))

    agreed = F.filter(F.transform("starts", agreeing), lambda x: x["share"] >= AGREES)
    laid_over = F.transform(F.filter(agreed, phrase_there), lambda x: F.struct(F.get(label, x["of"]).alias("label"), x["word"].alias("word"), x["share"].alias("share")))
    e = d.withColumn("places", F.when(F.size("starts") == 0, F.array().cast("array<struct<label:string,word:int,share:double>>")).otherwise(laid_over))
    own = F.filter(F.array(*(F.when(F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(x)) for p, x in BASE.items())), lambda x: x.isNotNull())
    f = e.withColumn("own", F.array_sort(F.array_distinct(own)))
    before_first = F.element_at(F.split("norm", base, 2), 1)
    before_last = F.regexp_extract("norm", "(?s)^(.*)" + base, 1)
    has = F.col("n_base") > 0
    return f.select(
        "doc_id",
        F.when(F.col("norm") == " ", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        "n_base",
        F.when(has, _count(before_first)).alias("first_word"),
        F.when(has, _count(before_last)).alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", F.transform("places", lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.least(F.lit(1.0), F.array_max(F.transform("places", lambda x: x["share"])))).when(has, 1.0).otherwise(0.0).alias("score"),
        F.transform("places", lambda x: F.struct(x["label"].alias("label"), x["word"].cast("long").alias("word"))).alias("places"),
    )
