"""License scans [native]: exact set-similarity join of text blocks with license templates.

A block of a template is a run of words of a text that begins with one of the
template's words and is a quarter longer than the template (or ends with the text).
A template matches a block if at least ``threshold`` of its distinct words are in it,
all words that the label needs are, and none that speaks for a rival label is: a
notice of CC BY isn't one of CC BY-SA for the other 13 of 14 words.

Words are ordered by their document frequency over the whole corpus, rarest first. A
text, or a block, can only match a template if it has one of the template's first
``size - ceil(threshold * size) + 1`` words (prefix filter), enough known words at
all (length filter), and enough words left after the shared one on both sides
(positional filter). Texts and templates are joined on prefix words; in the pairs that
pass, the blocks near a prefix word are verified by their true overlap. A template may be
of any length: whole license texts are in the list too.

The phrases are templates too, with all their words needed; consecutive words give
their places. Templates are a fixed list, so the broadcast index is bounded by it. Each
text is read and split once; the words of texts that could match are written beside their counts.

Defined results: a null text is empty; texts without a match have no labels,
score 0 and null places; a block with exactly the threshold matches; labels of all
matching templates are told, once each; rows alike in doc_id and text get equal results,
one each; a null doc_id is an id; very long texts are read whole; an empty table gives an
empty table; other columns of ``docs`` are not read, so no name clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import ascii_lower, literal_rows, materialise

#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Usual wordings of license notices: label, words that it needs, words of rival labels, wording.
TEMPLATES = [
    ("apache-2.0", "apache 2", "", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache 2", "", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit-terms", "hereby granted sublicense", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-terms", "hereby granted charge deal", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-terms", "mit license", "", "released under the mit license"),
    ("gpl-3.0", "gnu general 3", "lesser affero", "this work is licensed under the gnu general public license version 3"),
    ("gpl-any", "gnu general", "lesser library affero", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-any", "gnu lesser", "affero", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-any", "gnu affero", "lesser", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("bsd", "redistribution binary source", "", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "hereby granted fee", "charge", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla 2", "", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "attribution 4", "sharealike noncommercial noderivatives", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "attribution sharealike 4", "noncommercial noderivatives", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "cc by nc 4", "sa nd", "licensed under cc by nc 4 0"),
    ("cc0", "extent waived", "", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "unencumbered", "", "this is free and unencumbered software released into the public domain"),
]
#: What lies between words, once letters A to Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def block_length(words: list[str]) -> int:
    """How many words a block of a template has: a quarter more than the template."""
    return math.ceil(1.25 * len(words))


def needed(tokens, threshold: float) -> int:
    return math.ceil(threshold * len(tokens) - 1e-9)


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def entries_of(templates, phrases, threshold: float) -> list[dict]:
    """The list of what is looked for, each with its number."""
    out = []
    for phrase, label in phrases.items():
        words = phrase.split()
        out.append({"label": label, "phrase": True, "words": words, "must": sorted(set(words)), "never": [], "need": len(set(words)), "size": len(words)})
    for label, must, never, wording in templates:
        words = wording.split()
        out.append({"label": label, "phrase": False, "words": words, "must": must.split(), "never": never.split(), "need": needed(set(words), threshold), "size": block_length(words)})
    return out


def word_order(seen: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by document frequency over all rows of ``seen`` (_known), rarest first, ties by word. Its size bounds what is collected."""
    counts = {r["w"]: r["count"] for r in seen.select(F.explode("_known").alias("w")).groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


_KEY = ["_id", "_digest"]


def _seen(docs: DataFrame, entries: list[dict], vocabulary: list[str], doc_id: str, text: str) -> DataFrame:
    """A row per row of ``docs``: its key, number of words, known words, and all words if it has enough of any entry's."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_digest"), license_words(F.col(text)).alias("_w"))
    rows = rows.withColumn("_known", F.array_intersect(_strings(vocabulary), F.col("_w")))
    entry = lambda e: F.struct(_strings(sorted(set(e["words"]))).alias("tokens"), _strings(e["must"]).alias("must"), F.lit(e["need"]).alias("need"))
    enough = F.exists(F.array(*[entry(e) for e in entries]), lambda e: (F.size(F.array_except(e["must"], F.col("_known"))) == 0) & (F.size(F.array_intersect(e["tokens"], F.col("_known"))) >= e["need"])) if entries else F.lit(False)
    return rows.select("doc_id", *_KEY, F.size("_w").cast("long").alias("n_words"), "_known", F.when(enough, F.col("_w")).alias("_w"))


def _matches(seen: DataFrame, entries: list[dict], order: list[str]) -> DataFrame:
    """``_id, _digest, number``: the join of texts and entries on prefix words, with the length and positional filters."""
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, e in enumerate(entries):
        tokens = sorted(set(e["words"]), key=rank.get)
        for i in range(len(tokens) - e["need"] + 1):
            index.append((tokens[i], number, i, e["need"], tokens))
    index_df = literal_rows(seen.sparkSession, index, "_token string, number int, _i int, _need int, _tokens array<string>")
    ordered = seen.filter("_w IS NOT NULL").select(*_KEY, F.array_intersect(_strings(order), F.col("_known")).alias("_known"))
    # every row of a text's known words with the index: only rare prefix words meet it
    pairs = ordered.select("*", F.posexplode("_known").alias("_j", "_token")).join(F.broadcast(index_df), "_token")
    pairs = pairs.filter((F.size("_known") >= F.col("_need")) & (F.least(F.size("_tokens") - F.col("_i"), F.size("_known") - F.col("_j")) >= F.col("_need")))
    return pairs.filter(F.size(F.array_intersect("_known", "_tokens")) >= F.col("_need")).select(*_KEY, "number").distinct()


def license_blocks(docs: DataFrame, templates=None, phrases=None, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): ``doc_id, _id, _digest, n_words`` of each row of ``docs``, and every matching block.

    A block is ``_id, _digest, label, is_phrase, start, end, share``; places are words from 0, ``end`` is one beyond.
    """
    entries = entries_of(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, threshold)
    vocabulary = sorted({w for e in entries for w in e["words"]})
    seen = materialise(_seen(docs, entries, vocabulary, doc_id, text), "words")
    order = word_order(seen, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    found = _matches(seen, entries, order).groupBy(*_KEY).agg(F.collect_set("number").alias("_numbers"))
    texts = seen.filter("_w IS NOT NULL").select(*_KEY, "_w").join(found, _KEY)

    def row(number: int, e: dict) -> tuple:
        tokens = sorted(set(e["words"]), key=rank.get)
        return number, e["label"], e["phrase"], e["words"], tokens, tokens[: len(tokens) - e["need"] + 1], e["must"], e["never"], e["need"], e["size"]

    told = literal_rows(docs.sparkSession, [row(k, e) for k, e in enumerate(entries)], "number int, label string, is_phrase boolean, words array<string>, tokens array<string>, prefix array<string>, must array<string>, never array<string>, need int, size int")
    texts = texts.select(*_KEY, "_w", F.explode("_numbers").alias("number")).join(F.broadcast(told), "number")
    # the blocks that hold a prefix word, one for each template word that they may begin with
    near = F.expr("filter(transform(_w, (x, i) -> IF(array_contains(prefix, x), i, -1)), i -> i >= 0)")
    starts = F.expr("filter(transform(_w, (x, i) -> IF(array_contains(tokens, x), i, -1)), i -> i >= 0)")
    phrase_at = F.expr("filter(transform(_w, (x, i) -> IF(x = words[0] AND slice(_w, i + 1, size) = words, i, -1)), i -> i >= 0)")
    texts = texts.withColumn("_near", F.when(~F.col("is_phrase"), near)).withColumn("_starts", F.when(F.col("is_phrase"), phrase_at).otherwise(starts))
    texts = texts.withColumn("_starts", F.expr("IF(is_phrase, _starts, filter(_starts, p -> exists(_near, q -> q >= p AND q < p + size)))"))
    blocks = texts.select(*_KEY, "label", "is_phrase", "tokens", "must", "never", "need", F.explode(F.expr("transform(_starts, p -> struct(p AS start, slice(_w, p + 1, size) AS block))")).alias("b"))
    overlap = F.size(F.array_intersect("tokens", "b.block"))
    blocks = blocks.filter((overlap >= F.col("need")) & (F.size(F.array_except("must", "b.block")) == 0) & ~F.arrays_overlap("never", "b.block"))
    blocks = blocks.select(*_KEY, "label", "is_phrase", F.col("b.start").cast("long").alias("start"), (F.col("b.start") + F.size("b.block")).cast("long").alias("end"), (overlap / F.size("tokens")).alias("share")).distinct()
    return seen.select("doc_id", *_KEY, "n_words"), blocks


def license_scan(docs: DataFrame, templates=None, phrases=None, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row of ``docs``."""
    rows, blocks = license_blocks(docs, templates, phrases, threshold, doc_id, text)
    base = F.col("is_phrase")
    hits = blocks.groupBy(*_KEY).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("_base"), F.array_sort(F.collect_set("label")).alias("_all"), F.max("share").alias("_score"),
    )
    joined = rows.join(hits, _KEY, "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce(F.array_join("_base", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("_all", ","), F.lit("")).alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
