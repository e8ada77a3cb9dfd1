"""License scan by diagonal voting, in DataFrame functions only.

Every rolling word 2-gram of a document is hashed and joined to the 2-grams of the templates; a match counts if the words
are equal too. A match at document word p and template word t votes for the diagonal p - t. A phrase or a short notice
stands where a diagonal has all votes of its template. For longer notices neighbouring diagonals merge, which bridges
inserted or lost words, and a merged span counts if it covers enough of the template and isn't much longer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, _UPPER, materialize

#: Anything but ASCII digits, letters and characters beyond ASCII separates words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose every place counts: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license notices by label: fixed values.
NOTICES = {
    "agpl": ("GNU Affero General Public License",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "boost-1.0": ("Distributed under the Boost Software License, Version 1.0",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl-3.0": (
        "licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl": ("GNU Lesser General Public License",),
    "mit-notice": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
}

#: Diagonals at most this many words apart merge.
DRIFT = 2
#: A merged span must cover this share of the template's 2-grams and be at most this many times as long; a short template, of
#: fewer 2-grams than ``SHORT``, must be there whole, since one word more may make it another license.
COVER, STRETCH, SHORT = 0.8, 1.5, 10


def words_of(template: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.lower())


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is phrase, words)."""
    found = [(label, True, words_of(p)) for p, label in PHRASES.items()] + [(label, False, words_of(t)) for label, of in NOTICES.items() for t in of]
    return [(k, *x) for k, x in enumerate(found)]


def template_grams(spark: SparkSession) -> DataFrame:
    """Rows (hash, a, b, template, label, phrase, at, grams) for each 2-gram of each template; some hundred rows, fixed in code."""
    rows = [f"({k}, '{label}', {phrase}, '{a}', '{b}', {at}, {len(w) - 1})" for k, label, phrase, w in templates() for at, (a, b) in enumerate(zip(w, w[1:]))]
    given = spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS x(template, label, phrase, a, b, at, grams)")
    return given.select(F.xxhash64("a", "b").alias("hash"), "a", "b", "template", "label", "phrase", "at", "grams")


def _fold(text: Column) -> Column:
    """Lower case for matching ASCII words: lower() is fast, and only U+0130 and U+212A would make ASCII letters of others."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _words(text_col: str) -> Column:
    return F.array_remove(F.split(_fold(F.coalesce(F.col(text_col), F.lit(""))), _GAP), "")


def votes(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Rows (keys, template, label, phrase, grams, diagonal, places): the template positions matched on a diagonal."""
    worded = df.select(*keys, _words(text_col).alias("__w"))
    after = F.slice("__w", F.lit(2), F.greatest(F.lit(0), F.size("__w") - 1))
    first = sorted({w for _, _, _, of in templates() for w in of})
    # words go along where the first is a template's, to be compared where hashes are equal
    gram = lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), F.when(a.isin(first), F.struct(a.alias("a"), b.alias("b"))).alias("words"))
    grams = worded.select(*keys, F.posexplode(F.zip_with("__w", after, gram)).alias("pos", "x")).select(*keys, "pos", "x.*")
    known = template_grams(df.sparkSession).withColumnsRenamed({"a": "ta", "b": "tb"})
    hits = grams.join(F.broadcast(known), "hash").where((F.col("words.a") == F.col("ta")) & (F.col("words.b") == F.col("tb")))  # fixed in code, far under a megabyte
    return hits.groupBy(*keys, "template", "label", "phrase", "grams", (F.col("pos") - F.col("at")).cast("bigint").alias("diagonal")).agg(F.collect_set("at").alias("places"))


def spans(voted: DataFrame, keys: list[str]) -> DataFrame:
    """Verified spans of notices: (keys, template, label, first_word, end_word, cover)."""
    of = Window.partitionBy(*keys, "template").orderBy("diagonal")
    marked = voted.where(~F.col("phrase")).withColumn("new", F.when(F.col("grams") < SHORT, 1).otherwise(F.coalesce((F.col("diagonal") - F.lag("diagonal").over(of) > DRIFT).cast("int"), F.lit(1))))
    grouped = marked.withColumn("island", F.sum("new").over(of))
    low, high = (F.col("diagonal") + F.array_min("places")), (F.col("diagonal") + F.array_max("places") + 2)
    merged = grouped.groupBy(*keys, "template", "label", "grams", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.min(low).alias("first_word"), F.max(high).alias("end_word"))
    good = (F.col("n") >= F.when(F.col("grams") < SHORT, 1.0).otherwise(COVER) * F.col("grams")) & (F.col("end_word") - F.col("first_word") <= F.when(F.col("grams") < SHORT, 1.0).otherwise(STRETCH) * (F.col("grams") + 1))
    return merged.where(good).select(*keys, "template", "label", "first_word", "end_word", (F.col("n") / F.col("grams")).alias("cover"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no labels and score 0; null ids and repeated rows keep their rows, since results
    are joined by id and the text's hash; an empty input gives an empty result; other columns may have any name. Very long
    texts are scanned whole, as one array of words in their task. The score is the best coverage of any verified template,
    1 with a whole phrase. Only matches are shuffled, with a few numbers per document; votes are written once.
    """
    keyed = df.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__th"), F.col(text_col).alias("__text"))
    keys = ["__id", "__th"]
    voted = materialize(votes(keyed, keys, "__text"), "votes")
    whole = voted.where(F.col("phrase") & (F.size("places") == F.col("grams")))
    base = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
        F.collect_set("label").alias("base"),
    )
    noted = spans(voted, keys).groupBy(*keys).agg(F.collect_set("label").alias("noted"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    found = (
        base.withColumns({"noted": none, "cover": F.lit(1.0)})
        .unionByName(noted.withColumns({"n_base": F.lit(0).cast("bigint"), "first_word": F.lit(None).cast("bigint"), "last_word": F.lit(None).cast("bigint"), "base": none}))
        .groupBy(*keys)
        .agg(F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.flatten(F.collect_list("base")).alias("base"), F.flatten(F.collect_list("noted")).alias("noted"), F.max("cover").alias("score"))
    )
    counted = keyed.select(*keys, F.size(_words("__text")).cast("bigint").alias("n_words"))
    right = found.withColumnsRenamed({"__id": "__id2", "__th": "__th2"})
    joined = counted.join(right, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2")), "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(F.coalesce(c, none))), ",")
    return joined.select(
        F.col("__id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        text(F.col("base")).alias("base_labels"), text(F.concat(F.coalesce("base", none), F.coalesce("noted", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
