"""License scan: base phrases by words, and diagonal voting against templates.

Templates are the clauses of license notices and bodies. Rolling hashes of
every k consecutive words of every document are joined to the positions of the
same hashes in the clauses. A hit at document position p and clause position t
lies on diagonal p - t; a copied clause puts many hits on one diagonal. Votes
are aggregated per document, clause and diagonal, neighbouring diagonals (a
word put in or left out) are merged, and the hits of each merged group are
verified word by word. A group counts by the share of the clause's words that
verified hits cover, so words shared with a license by chance do not.

The clauses are a fixed list in this file, so the broadcast side is bounded by
it. The document side is exploded and joined without a shuffle; only hits are
shuffled, collected per diagonal before. Only texts with hits are split into
words again for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweepfield.llm.common import broadcast_if_counted, fold_case, gram_arrays, same, text_of, word_arrays, written

# Fixed value: what separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
# Clauses of published license notices and bodies, by label.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
GRAM = 4
# Diagonals this close belong to one passage; this share of a clause's words
# must be covered by verified hits.
SLACK, MIN_SHARE = 2, 0.75
# Passages of several labels that begin this close are readings of one place.
NEAR = 8


def clause_words(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``(label, clause, _w)``: the words of each clause."""
    rows = [(label, i, clause) for label, clauses in sorted(templates.items()) for i, clause in enumerate(clauses)]
    frame = spark.createDataFrame(rows, "label string, clause int, body string")
    return word_arrays(frame, fold_case(F.col("body")), SEPARATOR, [F.col("label"), F.col("clause")])


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    here = lambda i: [F.get(words, i + j) == p for j, p in enumerate(parts)]

    def test(i):
        first, *rest = here(i)
        for r in rest:
            first = first & r
        return first

    firsts = F.array_position(words, F.lit(parts[0]))
    places = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.when(firsts > 0, F.filter(places, test)).otherwise(F.array().cast("array<int>"))


def _phrase_places(words: Column, phrase: str, label: str) -> Column:
    return F.transform(
        _phrase_starts(words, phrase), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return word_arrays(docs, fold_case(text), SEPARATOR, [F.col(id_col), F.xxhash64(text).alias("_fp")])


def base_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, _fp, n_words, places array<struct<at, label>>)``, one row per input row."""
    words = _words(docs, id_col, text_col)
    places = F.concat(*[_phrase_places(F.col("_w"), phrase, label) for phrase, label in PHRASES.items()])
    return words.select(id_col, "_fp", F.size("_w").cast("long").alias("n_words"), places.alias("places"))


def template_spans(
    docs: DataFrame, clauses: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM,
    slack: int = SLACK, min_share: float = MIN_SHARE, near: int = NEAR,
) -> DataFrame:
    """Verified passages: ``(id_col, _fp, label, first_word, last_word, votes, share)``.

    ``votes`` counts the verified hits, ``share`` the part of the clause's
    words they cover; first and last word are the outermost ones covered. Of
    passages of several labels that begin within ``near`` words of each other,
    those that hit the largest part of their clause's grams stay. Clauses under ``k`` words never match.
    Repeated rows give one row per passage.
    """
    piece = ["label", "clause"]
    positions = gram_arrays(clauses, k, piece).select(*piece, F.posexplode_outer("_h").alias("_t", "hash")).filter("hash IS NOT NULL")
    key = [F.col(id_col).alias("_id"), "_fp"]
    grams = gram_arrays(_words(docs, id_col, text_col), k, [id_col, "_fp"]).select(*key, F.posexplode_outer("_h").alias("_p", "hash"))
    hits = grams.join(F.broadcast(positions), "hash")
    # A clause position counts once per diagonal, however often a row repeats.
    diagonals = hits.groupBy("_id", "_fp", *piece, (F.col("_p") - F.col("_t")).alias("_d")).agg(F.collect_set("_t").alias("_ts"))
    # All hits of a diagonal lie within one clause's length, so neighbours in
    # the order of diagonals are neighbours in the document.
    along = Window.partitionBy("_id", "_fp", *piece).orderBy("_d")
    fresh = F.when(F.col("_d") - F.lag("_d").over(along) <= slack, 0).otherwise(1)
    marks = F.transform("_ts", lambda t: F.struct(F.col("_d").alias("d"), t.alias("t")))
    groups = diagonals.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(along)).groupBy("_id", "_fp", *piece, "_run").agg(
        F.flatten(F.collect_list(marks)).alias("_hits"))

    def covered(found: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda h: F.sequence(h["t"], h["t"] + (k - 1))))))

    sized = groups.join(F.broadcast(clauses.select(*piece, F.col("_w").alias("_cw"))), piece)
    likely = written(sized.filter(covered(F.col("_hits")) >= min_share * F.size("_cw")), "clauses")
    suspects = broadcast_if_counted(likely.select(F.col("_id").alias("_i"), F.col("_fp").alias("_f")).distinct())
    text = docs.select(F.col(id_col).alias("_own"), text_of(text_col).alias("_text")).withColumn("_ofp", F.xxhash64("_text"))
    there = text.join(suspects, same([(F.col("_own"), F.col("_i")), (F.col("_ofp"), F.col("_f"))]), "left_semi").dropDuplicates(["_own", "_ofp"])
    words = word_arrays(there, fold_case(F.col("_text")), SEPARATOR, [F.col("_own"), F.col("_ofp")])
    met = likely.join(words, same([(F.col("_id"), F.col("_own")), (F.col("_fp"), F.col("_ofp"))]))
    true_hit = lambda h: F.slice("_w", h["d"] + h["t"] + 1, k) == F.slice("_cw", h["t"] + 1, k)
    at = F.transform("_hits", lambda h: h["d"] + h["t"])
    spans = met.withColumn("_hits", F.filter("_hits", true_hit)).select(
        "_id", "_fp", "label", F.array_min(at).cast("long").alias("first_word"), (F.array_max(at) + (k - 1)).cast("long").alias("last_word"),
        F.size("_hits").cast("long").alias("votes"), (covered(F.col("_hits")) / F.size("_cw")).alias("share"),
        (F.size(F.array_distinct(F.transform("_hits", lambda h: h["t"]))) / (F.size("_cw") - k + 1)).alias("_whole")).filter(F.col("share") >= min_share)
    around = Window.partitionBy("_id", "_fp").orderBy("first_word").rangeBetween(-near, near)
    return spans.withColumn("_most", F.max("_whole").over(around)).filter("_whole = _most").select(
        F.col("_id").alias(id_col), "_fp", "label", "first_word", "last_word", "votes", "share")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``(id_col, n_words, places, passages array<struct<label, first_word, last_word, votes, share>>)``.

    One row per input row, repeated rows included. Null texts count as empty
    and give empty lists; null ids are kept; other columns are dropped. A very
    long text is one row of words; its hits are rows of their own.
    """
    base = base_phrases(docs, id_col, text_col)
    spans = template_spans(docs, clause_words(docs.sparkSession, templates), id_col, text_col)
    lists = spans.groupBy(F.col(id_col).alias("_id"), F.col("_fp").alias("_fp2")).agg(
        F.array_sort(F.collect_list(F.struct("label", "first_word", "last_word", "votes", "share"))).alias("passages"))
    empty = F.array().cast("array<struct<label:string,first_word:bigint,last_word:bigint,votes:bigint,share:double>>")
    return base.join(lists, same([(F.col(id_col), F.col("_id")), (F.col("_fp"), F.col("_fp2"))]), "left").select(
        id_col, "n_words", "places", F.coalesce("passages", empty).alias("passages"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns; the score is 1 with a base phrase, else the best passage's share."""
    starts, labels = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    own = F.transform("passages", lambda p: p["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(labels).alias("base_labels"), joined(F.concat(labels, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(
            F.coalesce(F.array_max(F.transform("passages", lambda p: p["share"])), F.lit(0.0))).alias("score"))
