"""License scans as an exact set-similarity join between text blocks and license templates.

Blocks are the lines of a text, templates short notices; both are sets of words. A block meets a template when it holds at
least ``threshold`` of the template's words (containment). Words are ordered by their frequency over all blocks, rarest
first; if block and template share enough words, then the first shared one lies in a short prefix of both (prefix filter).
Blocks with too few words are left out before (length filter), and a shared word too far back can't be the first of enough
(positional filter). What is left is verified on the whole sets. Words of no template can't be shared, so blocks keep only
template words. Everything is DataFrame functions; the only data broadcast are templates and their prefixes, which are parameters.

A notice may be wrapped over lines. So runs of consecutive words of the whole text, line ends left aside and each as long as
the template, are blocks as well; as such a run has no bounds of its own, ``threshold`` of the template's words must stand in
it in the template's order. Only texts that hold enough of a template's words anywhere are looked at for that template.

Beside that, exact phrases give base labels and their places.

Cases: NULL and empty texts have no words, no labels and score 0; repeated rows are scanned each; equal labels of several
templates count once; a word's ties in frequency go by the word; an empty table gives an empty table. Whole texts are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from invoicelens.session import materialise

# Fixed values of the contract: phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as they are in common use, with the label each stands for.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the terms of the GNU Lesser General Public License"),
    ("agpl", "licensed under the terms of the GNU Affero General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
)
THRESHOLD = 0.8

_NO_WORD = "".join(chr(c) for c in range(128) if chr(c) != "\n" and not chr(c).isalnum())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(text: str) -> str:
    return text.translate(str.maketrans(_NO_WORD + "\n" + _UPPER, " " * (len(_NO_WORD) + 1) + _UPPER.lower()))


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(_plain(text).split()))


def _lowered(text: Column) -> Column:
    """Words and line ends only, A-Z in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), _NO_WORD + _UPPER, " " * len(_NO_WORD) + _UPPER.lower())


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
                   threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score); both label columns are sorted arrays.

    ``score`` is the best containment found at or above the threshold, 1 with a base label, 0 with neither.
    """
    sets = [(label, template_words(text)) for label, text in templates]
    needed = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    vocabulary = sorted({w for _, words in sets for w in words})
    least = min(needed, default=0)

    lines = docs.select(docs[id_col].alias("id"), _lowered(docs[text_col]).alias("lines"))
    flat = F.trim(F.regexp_replace("lines", "[ \n]+", " "))
    padded = lines.select("id", "lines", F.concat(F.lit(" "), flat, F.lit(" ")).alias("padded"))
    found = {p: F.contains("padded", F.lit(f" {p} ")) for p in phrases}
    any_found = F.lit(False)
    for condition in found.values():
        any_found = any_found | condition
    n_words = F.when(F.length("padded") <= 2, 0).otherwise(_spaces(F.col("padded")) - 1)
    # Cut before each place; a place may overlap the one before.
    cut = F.split("padded", " (?=(?:" + "|".join(phrases) + ") )", -1) if phrases else F.array("padded")
    cuts = F.when(any_found, cut)
    hits = F.transform(F.split("lines", "\n"), lambda line: F.array_intersect(_strings(vocabulary), F.split(line, " ")))
    held = F.array_distinct(F.flatten("hits"))
    wrapped = F.array_compact(F.array(*[F.when(F.size(F.array_intersect(_strings(words), held)) >= n, F.lit(i))
                                        for i, ((_, words), n) in enumerate(zip(sets, needed))]).cast("array<int>"))
    scanned = materialise(
        padded.select("id", n_words.cast("bigint").alias("n_words"), cuts.alias("cuts"),
                      F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(found[p], label) for p, label in phrases.items()]))))
                      .cast("array<string>").alias("base_labels"), "padded", hits.alias("hits"))
        .select("id", "n_words", "cuts", "base_labels", "padded", F.filter("hits", lambda words: F.size(words) >= least).alias("blocks"),
                F.when(F.size("hits") > 1, wrapped).otherwise(F.array().cast("array<int>")).alias("wrapped"))
        .select("id", "n_words", F.coalesce(F.size("cuts") - 1, F.lit(0)).cast("bigint").alias("n_base"),
                _spaces(F.get("cuts", F.lit(0))).cast("bigint").alias("first_word"),
                (F.col("n_words") - _spaces(F.element_at("cuts", -1))).cast("bigint").alias("last_word"),
                "base_labels", "blocks", "wrapped", F.when(F.size("wrapped") > 0, F.split(F.trim("padded"), " ")).alias("words"),
                F.monotonically_increasing_id().alias("row")))
    lengths = [len(_plain(text).split()) for _, text in templates]
    matched = _join(scanned, sets, needed, vocabulary).union(_join_wrapped(scanned, sets, needed, lengths)).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    return scanned.drop("blocks", "wrapped", "words").join(matched, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def _join(scanned: DataFrame, sets: list[tuple[str, list[str]]], needed: list[int], vocabulary: list[str]) -> DataFrame:
    """Rows (row, label, containment) of every block and template that meet the threshold, each pair once."""
    blocks = scanned.select("row", F.explode("blocks").alias("words"))
    counts = dict(blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect())  # one row per template word
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes = []
    for (label, words), least in zip(sets, needed):
        ranked = sorted(words, key=order.__getitem__)
        prefixes += [(word, label, place, len(words), least, ranked) for place, word in enumerate(ranked[:len(words) - least + 1])]
    templates = blocks.sparkSession.createDataFrame(
        prefixes, "word string, label string, template_place int, template_size int, least int, template array<string>")
    ranked = F.array_intersect(_strings(sorted(vocabulary, key=order.__getitem__)), F.col("words"))
    sized = blocks.select("row", ranked.alias("words")).withColumn("size", F.size("words"))
    shared = F.array_intersect("template", "words")
    return (
        sized.select("row", "words", "size", F.posexplode("words").alias("place", "word"))
        .join(F.broadcast(templates), "word")
        .filter((F.col("size") >= F.col("least")) & (F.col("place") <= F.col("size") - F.col("least"))
                & (F.least(F.col("size") - F.col("place"), F.col("template_size") - F.col("template_place")) >= F.col("least")))
        .withColumn("shared", shared)
        .filter((F.size("shared") >= F.col("least")) & (F.get("shared", F.lit(0)) == F.col("word")))
        .select("row", "label", (F.size("shared") / F.col("template_size")).alias("containment"))
    )


def _in_order(template: Column, words: Column) -> Column:
    """How many words of the template, at most, stand among the words in the template's order (longest common subsequence)."""
    def after(row: Column, word: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(template)), F.array(F.lit(0)), lambda made, j: F.concat(made, F.array(
            F.when(F.get(template, j - 1) == word, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(made, j - 1))))))

    return F.element_at(F.aggregate(words, F.array_repeat(F.lit(0), F.size(template) + 1), after), -1)


def _join_wrapped(scanned: DataFrame, sets: list[tuple[str, list[str]]], needed: list[int], lengths: list[int]) -> DataFrame:
    """Rows (row, label, containment) of the runs of words that hold enough of a template in order."""
    templates = scanned.sparkSession.createDataFrame(
        [(i, label, words, least, length) for i, ((label, words), least, length) in enumerate(zip(sets, needed, lengths)) if words],
        "number int, label string, template array<string>, least int, length int")
    run = lambda at: F.slice("words", at + 1, F.col("length"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda at: F.array_contains("template", F.get("words", at)) & (
        F.size(F.array_intersect("template", run(at))) >= F.col("least")))
    return (
        scanned.select("row", "words", F.explode("wrapped").alias("number")).join(F.broadcast(templates), "number")
        .select("row", "label", "template", "least", F.explode(F.transform(starts, run)).alias("run"))
        .withColumn("shared", _in_order(F.col("template"), F.col("run")))
        .filter(F.col("shared") >= F.col("least"))
        .select("row", "label", (F.col("shared") / F.size("template")).alias("containment"))
    )
