"""License scans by diagonal voting.

Texts are taken as words: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. Spark joins the
rolling hashes of consecutive words (GRAM, or LONG_GRAM for templates of LONG words or more) to the places at which they
stand in the templates. A hit votes for the diagonal (place in the text less place in the template); votes are summed for
each text, template and diagonal, and diagonals of a template that are at most SHIFT apart are merged, so a text with a
word more or less still votes together. A short phrase stands where one diagonal holds all its hits, word by word. Of a
longer template the merged diagonals must hold at least COVER of its distinct hits; then their span is verified: its words
are aligned with the template's (match +2, mismatch and gap -1, local), and the share of a full copy's points, at least
COVER, is the score.

Hashes of a text that occur in no template cannot join; they are left out where they are made. The templates are a
table of bounded size (MOST_WORDS), which is checked.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.llm._shared import settle, small_batches, text_of
from gridwright.llm.contamination import MATCH, scored, words_of

GRAM, LONG_GRAM, LONG, SHIFT, COVER, MOST_WORDS = 2, 3, 20, 3, 0.7, 100_000
#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of licenses, with their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "lgpl": "gnu lesser general public license version",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
    ),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
        "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with "
        "this program"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
        "as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ),
    "mit-name": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
    "cc": "licensed under a creative commons attribution license",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}


def gram_of(words: int) -> int:
    """The words of a hash, of a template of so many."""
    return LONG_GRAM if words >= LONG else GRAM


def grams_of(ids: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The rolling hash of `gram` word numbers (0: a word of no template); -1 where one is 0. Hashes of different lengths
    differ, as the shorter ones are below size squared, and the others are not."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keys, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(gram):
        keys, known = keys * size + ids[k : k + n], known & (ids[k : k + n] > 0)
    return np.where(known, keys, -1)


def license_hits(df: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and hits (array of struct template, label, exact, first_word, end_word, score) of every row.

    Null texts have no words; texts are read whole, however long they are. Repeated rows come out repeated; extra columns
    take no part; an empty df gives no rows. Templates of fewer than GRAM words, or of more than MOST_WORDS together, raise
    ValueError.
    """
    listed = [(t, label, True) for t, label in base.items()] + [(t, label, False) for label, t in templates.items()]
    words = [words_of(t) for t, _, _ in listed]
    if min(map(len, words), default=GRAM) < GRAM:
        raise ValueError(f"a template needs {GRAM} words")
    if sum(map(len, words)) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    vocabulary: dict[bytes, int] = {}
    for own in words:
        for w in own:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    size = len(vocabulary) + 1
    own_grams = [grams_of(np.array([vocabulary[w] for w in own]), size, gram_of(len(own))) for own in words]
    lengths = sorted({gram_of(len(own)) for own in words})
    known = np.unique(np.concatenate([*own_grams, np.array([-1])]))[1:]

    def run(batches):
        for batch in batches:
            total, grams = [], []
            for t in batch.column(1).to_pylist():
                own = words_of(t)
                ids = np.fromiter(map(vocabulary.get, own, repeat(0)), np.int64, len(own))
                total.append(len(own))
                found = []
                for length in lengths:
                    keys = grams_of(ids, size, length)
                    at = np.flatnonzero(keys >= 0)
                    at = at[np.isin(keys[at], known)]
                    found += [{"at": p, "gram": g} for p, g in zip(at.tolist(), keys[at].tolist(), strict=True)]
                grams.append(found)
            kind = pa.list_(pa.struct([("at", pa.int64()), ("gram", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(grams, kind)], names=["doc_id", "n_words", "grams"])

    small_batches(df.sparkSession)
    spark = df.sparkSession
    source = df.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = source.mapInArrow(run, "doc_id long, n_words long, grams array<struct<at:long,gram:long>>")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "license-grams")
    # bounded by MOST_WORDS, so it is broadcast whatever the texts are: no row is dealt out by template
    listed_places = [(int(g), t, k, len(own_grams[t]), gram_of(len(words[t])), listed[t][1], listed[t][2]) for t in range(len(listed)) for k, g in enumerate(own_grams[t].tolist())]
    places = F.broadcast(spark.createDataFrame(listed_places, "gram long, template int, k long, grams long, length int, label string, exact boolean"))
    hits = rows.select("row", F.inline("grams")).join(places, "gram")
    votes = hits.groupBy("row", "template", "label", "exact", "grams", "length", (F.col("at") - F.col("k")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.collect_set("k").alias("ks"))
    whole = votes.where(F.col("exact") & (F.col("votes") == F.col("grams")))
    exact = whole.select("row", "template", "label", "exact", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("grams") + F.col("length") - 1).alias("end_word"), F.lit(1.0).alias("score"))
    by_place = Window.partitionBy("row", "template").orderBy("diagonal")
    broken = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_place) > SHIFT).cast("int"), F.lit(1))
    merged = votes.where(~F.col("exact")).withColumn("broken", broken).withColumn("group", F.sum("broken").over(by_place))
    merged = merged.groupBy("row", "template", "label", "exact", "grams", "length", "group").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ks")))).alias("held"), F.min(F.col("diagonal") + F.col("lo")).alias("first_word"), F.max(F.col("diagonal") + F.col("hi") + F.col("length")).alias("end_word"))
    merged = merged.where(F.col("held") >= COVER * F.col("grams")).select("row", "template", "label", "exact", "first_word", "end_word")
    spans = merged.join(rows.select("row", "grams"), "row").withColumn("grams", F.filter("grams", lambda g: (g["at"] >= F.col("first_word")) & (g["at"] + GRAM <= F.col("end_word"))))
    wordings = [np.array([vocabulary[w] for w in own], np.int32) for own in words]

    def verify(batches):
        for batch in batches:
            spans, todo, out = batch.to_pylist(), [], []
            for r in spans:  # a span's words are those of its grams; others stand in no template next to each other
                own = np.zeros(r["end_word"] - r["first_word"], np.int32)
                for g in r["grams"]:
                    at, key = g["at"] - r["first_word"], g["gram"]
                    for k in reversed(range(LONG_GRAM if key >= size * size else GRAM)):
                        key, word = divmod(key, size)
                        if at + k < len(own):
                            own[at + k] = word
                todo.append((r, wordings[r["template"]], r["first_word"], own))
            while todo:  # what stands before and after a copy is aligned again
                more = []
                for (r, wording, start, own), (points, first, end) in zip(todo, scored([(x, t) for _, x, _, t in todo]), strict=True):
                    if points >= COVER * MATCH * len(wording):
                        out.append((r["row"], r["template"], r["label"], r["exact"], start + first, start + end, points / (MATCH * len(wording))))
                        more += [(r, wording, at, rest) for at, rest in ((start, own[:first]), (start + end, own[end:])) if np.count_nonzero(rest) >= COVER * len(wording)]
                todo = more
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "template", "label", "exact", "first_word", "end_word", "score"])

    merged = spans.mapInArrow(verify, "row long, template int, label string, exact boolean, first_word long, end_word long, score double")
    hits = exact.union(merged.select(exact.columns)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("template", "label", "exact", "first_word", "end_word", "score"))).alias("hits"))
    return rows.join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))


def license_report(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    base, hits = F.filter("hits", lambda h: h["exact"]), F.col("hits")
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["first_word"])
    return license_hits(df).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(hits).alias("labels"),
        F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
