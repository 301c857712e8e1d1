"""License scans by a positional rare-token index (operator 2), in DataFrame operations only.

Templates are licence texts and notices as word sequences, each with a mandatory key phrase.  Over all
documents the document frequencies of the templates' words are counted; a file's highest-IDF licence
words are those of its words that are the rarest of some template's key phrase, and the index has the
postings (template, position) of these.  Each such word in a file gives the offset at which a template
would lie; the postings of the key's other words are intersected with it by relative position, which
verifies the key phrase, and what is left counts as found if enough of its words are in place; the best
share counts.  Every place of every file is tried.

Scale: one pass counts frequencies (a table as long as the templates' vocabulary goes to the driver), one
looks words up, one gives the base columns.  The index, a few rows for each template, is part of the
plan.  A file that holds none of its words leaves at once; another is cut into blocks of ``BLOCK`` words
with a template's length around them, so that work and memory of a row are bounded and grow with a
file's words, not their square.  No text is shuffled: what leaves the second pass is one row for each
template found in a block, keyed by the text's digest, so that copies of a text share it.

Defined results: a null text is empty; a file without words has n_words 0, null first_word and
last_word, empty labels and score 0; texts of any length are scanned whole; of offsets that tie none is
preferred, the share is the same; repeated rows have equal results; an empty table gives no rows;
columns that are named like a result are replaced, all others passed through whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import documents, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases every scan reports, with their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Least share of a template's words in place.
LEAST = 0.6
#: Words of a file that are scanned in one row.
BLOCK = 1024


@dataclass(frozen=True)
class Template:
    label: str
    key: str
    text: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# Wording of public licences and of the notices by which works name them.
TEMPLATES = (
    Template("mit", "mit license", "released under the mit license"),
    Template("mit", "mit license", "licensed under the mit license"),
    Template("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "apache license", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law apache license version 2 0"),
    Template("gpl-3.0", "general public license version 3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2.0", "general public license version 2", "gnu general public license version 2"),
    Template("gpl", "general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl-3.0", "affero general public license", "licensed under the gnu affero general public license version 3"),
    Template("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc-4.0", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nd-4.0", "cc by nd", "licensed under cc by nd 4 0"),
    Template("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    Template("cc0", "cc0", "released under cc0 1 0 universal"),
    Template("cc-by-4.0", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    Template("mit", "the above copyright notice and this permission notice shall be included", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    Template("bsd-2-clause", "redistributions in binary form must reproduce", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    Template("bsd-3-clause", "neither the name of the copyright holder", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("isc", "provided that the above copyright notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", "the origin of this software must not be misrepresented", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    Template("gpl", "without even the implied warranty of merchantability", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    Template("epl-2.0", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    Template("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
)


def padded_words(text: Column) -> Column:
    """The text's words, each after one space, and a last space; one space if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, " ", ""))).cast("long")


def _has(phrase: str) -> Column:
    return F.col("_padded").contains(f" {phrase} ")


def _base(phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase, and the first and last of them, counted in words."""
    n = len(phrase.split())
    padded = F.col("_padded")
    count = F.when(_has(phrase), F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )")).cast("long")).otherwise(0)
    before = F.substring(padded, F.lit(1), F.locate(f" {phrase} ", padded))
    back = F.reverse(padded)
    after = F.substring(back, F.lit(1), F.locate(f" {phrase[::-1]} ", back))
    first = F.when(_has(phrase), _spaces(before) - 1)
    last = F.when(_has(phrase), F.col("_n") - n - (_spaces(after) - 1))
    return count, first, last


def document_frequencies(padded: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many files each word of the templates stands (at most as many entries as they have words)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.array_intersect(F.split("_padded", " "), F.array(*map(F.lit, vocabulary)))
    rows = padded.select(F.explode(words).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def postings(idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """The index: for the rarest word of each template's key, (template, position)."""
    rarity = lambda w: (-idf.get(w, math.inf), w)
    out: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        key = t.key.split()
        word = min(key, key=rarity)
        out.setdefault(word, []).append((n, t.key_at + key.index(word)))
    return out


def _blocks(words: Column, margin: int) -> Column:
    """The words in structs (from, to, words) of BLOCK words and ``margin`` more on both sides; from and to are the block's own places in it."""

    def cut(k: Column) -> Column:
        start = F.greatest(k * BLOCK - margin, F.lit(0))
        own = k * BLOCK - start
        return F.struct(own.alias("from"), (own + BLOCK).alias("to"), F.slice(words, start + 1, own + BLOCK + margin).alias("words"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int")), cut)


def found_templates(texts: DataFrame, index: dict[str, list[tuple[int, int]]], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(a, b, found): for the digest of each text with a template in it, the (label, share) of its templates.

    texts: (_padded, a, b).
    """
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, t.key.split())).alias("key"), F.lit(t.key_at).alias("key_at")) for t in templates])
    table = F.create_map(*[x for w, ps in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    margin = max(len(t.words) for t in templates)
    files = texts.select("a", "b", F.split(F.trim("_padded"), " ").alias("file")).where(F.arrays_overlap("file", F.array(*map(F.lit, index))))
    blocks = files.select("a", "b", F.explode(_blocks(F.col("file"), margin)).alias("x")).select("a", "b", "x.*").where(F.arrays_overlap("words", F.array(*map(F.lit, index))))

    words = F.col("words")
    own = lambda i: (i >= F.col("from")) & (i < F.col("to"))
    looked_up = F.transform(words, lambda w, i: F.when(own(i), F.transform(F.try_element_at(table, w), lambda p: F.struct(p["t"].alias("t"), (i - p["p"]).alias("at")))))
    hits = F.transform(F.flatten(F.filter(looked_up, lambda x: x.isNotNull())), lambda h: F.struct(F.element_at(known, h["t"] + 1).alias("x"), h["at"].alias("at")))
    # The other words of the key at their places relative to the hit.
    keyed = F.filter(hits, lambda h: (h["at"] + h["x"]["key_at"] >= 0) & (F.slice(words, F.greatest(h["at"] + h["x"]["key_at"], F.lit(0)) + 1, F.size(h["x"]["key"])) == h["x"]["key"]))

    def share(h: Column) -> Column:
        # Places before the file's first word are missing.
        skip = F.greatest(-h["at"], F.lit(0))
        there = F.slice(words, h["at"] + skip + 1, F.greatest(F.size(h["x"]["words"]) - skip, F.lit(0)))
        same = F.zip_with(there, F.slice(h["x"]["words"], skip + 1, F.size(there)), lambda x, y: x == y)
        return F.struct(h["x"]["label"].alias("label"), (F.size(F.filter(same, lambda x: x)) / F.size(h["x"]["words"])).alias("share"))

    placed = blocks.select("a", "b", F.explode(F.transform(keyed, share)).alias("x")).select("a", "b", "x.*").where(F.col("share") >= LEAST)
    best = placed.groupBy("a", "b", "label").agg(F.max("share").alias("share"))
    return best.groupBy("a", "b").agg(F.collect_list(F.struct("label", "share")).alias("found"))


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in ``keep``) with n_words, n_base, first_word, last_word, base_labels, labels and score appended.

    score is the largest share of a found template's words in place; a base phrase counts as whole.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    # The input's row is a struct, so the operator's columns clash with none of it.
    padded = docs.select(F.struct(*[docs[quoted(c)].alias(c) for c in kept]).alias("_row"), padded_words(docs[quoted(text_col)]).alias("_padded"))
    padded = padded.withColumn("a", F.xxhash64("_padded")).withColumn("b", F.xxhash64("_padded", F.lit(1)))
    total = docs.count()
    idf = {w: math.log((1 + total) / n) for w, n in document_frequencies(padded.select("_padded"), templates).items()}
    found = found_templates(padded.select("_padded", "a", "b"), postings(idf, templates), templates)

    rows = padded.withColumn("_n", _spaces(F.col("_padded")) - 1)
    for i, (count, first, last) in enumerate([_base(p) for p, _ in BASE]):
        rows = rows.withColumn(f"_c{i}", count).withColumn(f"_f{i}", first).withColumn(f"_l{i}", last)
    k = range(len(BASE))
    rows = rows.select("_row", "a", "b", "_n", *[f"_{x}{i}" for i in k for x in "cfl"]).join(found, ["a", "b"], "left")
    base = F.filter(F.array(*[F.when(F.col(f"_c{i}") > 0, F.lit(BASE[i][1])) for i in k]), lambda x: x.isNotNull())
    names = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    rows = (
        rows.withColumn("n_words", F.col("_n"))
        .withColumn("n_base", sum((F.col(f"_c{i}") for i in k), F.lit(0).cast("long")))
        .withColumn("first_word", F.least(*[F.col(f"_f{i}") for i in k]))
        .withColumn("last_word", F.greatest(*[F.col(f"_l{i}") for i in k]))
        .withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(base)), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base, names))), ","))
        .withColumn("score", F.when(F.col("n_base") > 0, 1.0).otherwise(best))
    )
    return rows.select("_row.*", *made)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), keep=["doc_id"])
