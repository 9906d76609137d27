"""Licence scans with a positional rare-token index (DataFrame functions only).

Templates are word sequences, each with a mandatory key phrase at a known place. The index holds, for every template, the
places of its words with the highest inverse document frequency in the corpus at hand. A file looks up those of
them that it holds; a posting (word, place in the file) says where the template would start, and postings of two or more
words of a template that agree on the start are what an intersection by relative position leaves. Only there the key
phrase is verified, word by word, and the rest of the template counted, with a small tolerance, so that a word
inserted or left out shifts nothing else.

A template of m words that may miss some of them indexes just so many of its rarest words that a place where it is found
always has two of them: which words are rare decides how many starts are tried, not what is found.

Texts are split once: the first pass keeps of every text the words that templates have, at their places, in a table that
is a small part of the texts; frequencies and postings are read from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: By so many words a word of a licence text may be off its place.
TOLERANCE = 2


@dataclass(frozen=True)
class Template:
    """A label, the template's words, and the key phrase among them that must stand whole. A template
    counts as found where at least ``share`` of its words stand at their places, give or take ``tolerance``."""

    label: str
    text: str
    key: str
    share: float = 0.7
    tolerance: int = TOLERANCE

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)

    def indexed(self, frequency: dict[str, int]) -> list[int]:
        """The places of the rarest words: two more than may be missing, so that two of them stand wherever it is found."""
        rare = sorted(range(len(self.words)), key=lambda j: (frequency.get(self.words[j], 0), self.words[j], j))
        may_miss = int(len(self.words) * (1 - self.share) + 1e-9)
        return rare[: may_miss + 2]


#: The phrases that count as base places.
BASE = [
    Template("mit", "under the mit license", "under the mit license", 1.0, 0),
    Template("apache-2", "apache license version 2", "apache license version 2", 1.0, 0),
    Template("cc-by-nc", "cc by nc", "cc by nc", 1.0, 0),
]
#: Well-known licence texts and notices, as words in lower case, which add labels of their own.
MORE = [
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "with or without fee is hereby granted",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "under the apache license",
    ),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "under the apache license"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "gnu general public license",
    ),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "licensed under cc by nc"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def frequencies(kept: DataFrame) -> dict[str, int]:
    """In how many texts each word of the templates occurs. What reaches the driver is a row for each such word."""
    held = kept.select(F.explode(F.array_distinct(F.filter("_w", lambda w: w.isNotNull()))).alias("w"))
    return {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _starts(t: Template, places: list[int]) -> Column:
    """Starts on which postings of two different indexed words agree, within the tolerance."""
    at: dict[str, list[int]] = {}
    for j in places:
        at.setdefault(t.words[j], []).append(j)
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*map(F.lit, js)).alias("js")) for w, js in at.items()])
    looked_up = F.filter("_rare", lambda a: a["w"].isin(list(at)))
    votes = F.flatten(F.transform(looked_up, lambda a: F.flatten(F.transform(F.filter(index, lambda x: x["w"] == a["w"])[0]["js"], lambda j: F.transform(
        F.array(*[F.lit(d) for d in range(-t.tolerance, t.tolerance + 1)]), lambda d: F.struct((a["p"] - j + d).alias("s"), j.alias("j")))))))
    votes = F.array_sort(F.array_distinct(votes))
    agreed = F.zip_with(votes, F.slice(votes, 2, F.greatest(F.size(votes), F.lit(1))), lambda a, b: F.when(a["s"] == b["s"], a["s"]))
    found = F.array_distinct(F.filter(agreed, lambda s: s.isNotNull()))
    return F.when(F.size(looked_up) > 1, found).otherwise(F.array().cast("array<int>"))


def _places(t: Template, places: list[int]) -> Column:
    """(label, at, agree) of the starts where the key phrase stands and enough words of the template do."""
    word = lambda p: F.when(p >= 0, F.get("_w", p))
    key = F.array(*map(F.lit, t.key_words))
    stands = F.filter(_starts(t, places), lambda s: F.when(s + t.key_at >= 0, F.slice("_w", F.greatest(s + t.key_at + 1, F.lit(1)), len(t.key_words)) == key).otherwise(F.lit(False)))
    words = F.array(*map(F.lit, t.words))

    def near(s: Column, w: Column, j: Column) -> Column:
        there = F.lit(False)
        for d in range(-t.tolerance, t.tolerance + 1):
            there = there | F.coalesce(word(s + j + d) == w, F.lit(False))
        return there

    agree = lambda s: F.size(F.filter(F.transform(words, lambda w, j: near(s, w, j)), lambda same: same))
    kept = F.transform(stands, lambda s: F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("at"), F.round(agree(s) / F.lit(float(len(t.words))), 6).alias("agree")))
    return F.filter(kept, lambda p: p["agree"] >= t.share)


def scan(df: DataFrame, base: list[Template] | None = None, more: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for each row of ``df``.

    ``places`` are structs (label, at, agree): every place of a template with its share of agreeing
    words. ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the
    smallest and the largest of their starts (null if none), labels are distinct, sorted and joined by
    commas (empty if none), ``score`` is the best share. A null text counts as empty. Rows that repeat
    an id are rows of their own; other columns are not read.
    """
    base, more = BASE if base is None else base, MORE if more is None else more
    every = [*base, *more]
    vocabulary = sorted({w for t in every for w in t.words})
    split = df.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_w"))
    kept = split.select("_id", F.size("_w").cast("long").alias("n_words"), F.transform("_w", lambda w: F.when(w.isin(vocabulary), w)).alias("_w"))
    kept = written(kept.withColumn("_w", F.when(F.exists("_w", lambda w: w.isNotNull()), F.col("_w"))), "licence-words")
    frequency = frequencies(kept)
    index = {n: t.indexed(frequency) for n, t in enumerate(every)}
    rare = sorted({every[n].words[j] for n, js in index.items() for j in js})
    postings = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("p")))), lambda a: a.isNotNull())
    found = kept.select("_id", "n_words", "_w", postings.alias("_rare"))

    some = F.size("_rare") > 1
    none = F.array().cast("array<struct<label:string,at:bigint,agree:double>>")
    of = lambda ns: F.when(some, F.concat(*[_places(every[n], index[n]) for n in ns])).otherwise(none)
    found = found.select("_id", "n_words", of(range(len(base))).alias("_base"), of(range(len(base), len(every))).alias("_more"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    both = F.concat("_base", "_more")
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda p: p["at"])).alias("last_word"),
        labels("_base").alias("base_labels"),
        labels(both).alias("labels"),
        F.coalesce(F.array_max(F.transform(both, lambda p: p["agree"])), F.lit(0.0)).alias("score"),
        both.alias("places"),
    )
