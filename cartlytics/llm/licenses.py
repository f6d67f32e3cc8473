"""Licence scan by a positional rare-token index.

Each template (a phrase, or a notice with gaps) is indexed by its rarest words: postings (word ->
template, position), the words being those of highest inverse document frequency in the corpus.
A file is scanned in one pass: the positions of its indexed words meet the postings, and each
(template, offset) they agree on is a candidate; all words of the phrase at that offset, or for a
notice its mandatory key phrases at their own places in it (within ``SLACK`` words), must then stand in the file.

Base labels are exact phrases: every place at which a phrase's words stand consecutively is found,
as every place has the phrase's rarest word.  Notices add labels of their own: their mandatory
phrases need not be adjacent, and the score is the share of the notice's indexed words that stand in
the file at one offset (within ``SLACK`` words).

Phrases and notices are parameters.  The index is data, a few literals (postings by word, words by phrase, mandatory phrases by notice)
that one expression looks up, whatever the number of templates; a file's row is made from its own text alone, so nothing but
the document frequencies of the templates' words is shuffled.

Cases: null texts have no words; ties of frequency are broken by the word; texts that repeat a phrase
count each place; repeated rows each give a row; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlytics.llm.common import text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices of well-known licences: label, words, mandatory key phrases (fixed values).
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["free documentation license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["express or implied warranty", "will the authors be held liable"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["names of its contributors", "endorse or promote products"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright", "neighboring rights"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["open font license"]),
    ("ms-pl", "this source is subject to the microsoft public license", ["microsoft public license"]),
    ("eupl", "licensed under the european union public licence", ["european union public licence"]),
    ("artistic", "this package is distributed under the terms of the artistic license", ["artistic license"]),
]
#: Rarest words of a template that are indexed.
RARE = 3
#: Words by which an agreeing offset may differ, for words put in or left out of a notice.
SLACK = 2
#: Share of a notice's indexed words that must agree on its place.
LEAST_AGREEMENT = 0.6


def lowered(text: str = "text") -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text_or_empty(text), UPPER, LOWER)


def words(lower: Column) -> Column:
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that have each word of the templates; at most as many rows as these words."""
    wanted = F.array_intersect(words(lowered()), F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    rows = docs.select(F.explode(wanted).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["n"] for r in rows}


def rarest(ws: list[str], df: dict[str, int], n: int) -> list[tuple[str, int]]:
    """(word, first position) of the ``n`` words of ``ws`` that the fewest documents have, rarest first."""
    return [(w, ws.index(w)) for w in sorted(set(ws), key=lambda w: (df[w], w))[:n]]


def _offsets(ws: list[str], phrase: list[str]) -> list[int]:
    """Where a phrase stands in a notice."""
    return [i for i in range(len(ws) - len(phrase) + 1) if ws[i:i + len(phrase)] == phrase]


def _data(value, schema: str) -> Column:
    """A literal of this type; the optimizer evaluates it once."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def index_of(docs: DataFrame, phrases: dict[str, str], notices: list[tuple[str, str, list[str]]], rare: int) -> dict:
    """The index as plain data.  words: of each phrase (base ones first, then mandatory ones); by_word: rarest word -> its phrases;
    of_notice: rare word -> notices and positions; must: of each notice its mandatory phrases with their offsets."""
    listed = list(dict.fromkeys([*phrases, *(m for _, _, must in notices for m in must)]))
    split, texts = [q.split() for q in listed], [text.split() for _, text, _ in notices]
    df = frequencies(docs, sorted({w for ws in [*split, *texts] for w in ws}))
    by_word: dict[str, list] = {}
    for q, ws in enumerate(split):
        (word, pos), = rarest(ws, df, 1)
        by_word.setdefault(word, []).append({"q": q, "pos": pos, "n": len(ws)})
    of_notice: dict[str, list] = {}
    sizes = []
    for t, ws in enumerate(texts):
        postings = rarest(ws, df, rare)
        sizes.append(len(postings))
        for word, pos in postings:
            of_notice.setdefault(word, []).append({"t": t, "pos": pos})
    must = [[{"q": listed.index(m), "at": _offsets(ws, m.split())} for m in ms] for (_, _, ms), ws in zip(notices, texts, strict=True)]
    return {"words": split, "by_word": by_word, "of_notice": of_notice, "sizes": sizes, "must": must,
            "labels": [phrases.get(q) for q in listed], "notice_labels": [label for label, _, _ in notices]}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, list[str]]] = NOTICES, rare: int = RARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every text;
    places: array<struct<word, label>> of the base phrases.  ``phrases``: phrase -> label; ``notices``: (label, words,
    mandatory phrases); ``rare``: words of a notice that are indexed."""
    index = index_of(docs, phrases, notices, rare)
    at = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(sorted({*index["by_word"], *index["of_notice"]})))
    found = docs.select("doc_id", words(lowered()).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), "w", at.alias("hits"))

    # phrases: wherever the rarest word of one stands, all its words are compared
    phrase_words = _data(index["words"], "array<array<string>>")
    of_phrase = _data(index["by_word"], "map<string,array<struct<q:int,pos:int,n:int>>>")
    no_phrase = F.array().cast("array<struct<q:int,pos:int,n:int>>")

    def stands(start, p):
        return (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, p["n"]) == F.element_at(phrase_words, p["q"] + 1))

    def phrases_at(h):
        here = F.coalesce(F.try_element_at(of_phrase, h["word"]), no_phrase)
        return F.transform(F.filter(here, lambda p: stands(h["at"] - p["pos"], p)), lambda p: F.struct(p["q"].alias("q"), (h["at"] - p["pos"]).alias("start")))

    found = found.withColumn("phrases", F.flatten(F.transform("hits", phrases_at)))
    # notices: the indexed words that are there give (notice, start, position); starts at which all mandatory phrases stand are scored
    postings = _data(index["of_notice"], "map<string,array<struct<t:int,pos:int>>>")
    no_posting = F.array().cast("array<struct<t:int,pos:int>>")

    def starts_at(h):
        here = F.coalesce(F.try_element_at(postings, h["word"]), no_posting)
        return F.transform(here, lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["pos"]).alias("start"), p["pos"].alias("pos")))

    must, sizes = _data(index["must"], "array<array<struct<q:int,at:array<int>>>>"), _data(index["sizes"], "array<int>")

    def whole(c):
        return F.forall(F.element_at(must, c["t"] + 1), lambda m: F.exists("phrases", lambda f: (f["q"] == m["q"]) & F.exists(
            m["at"], lambda o: F.abs(f["start"] - o - c["start"]) <= SLACK)))

    def share(c):
        same = F.filter("starts", lambda x: (x["t"] == c["t"]) & (F.abs(x["start"] - c["start"]) <= SLACK))
        return F.size(F.array_distinct(F.transform(same, lambda x: x["pos"]))) / F.element_at(sizes, c["t"] + 1)

    # texts without a phrase have no notice either
    some = F.size("phrases") > 0
    found = found.withColumn("starts", F.when(some, F.flatten(F.transform("hits", starts_at))).otherwise(F.array().cast("array<struct<t:int,start:int,pos:int>>")))
    found = found.withColumn("noticed", F.array_distinct(F.transform(F.filter("starts", whole), lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start")))))
    notice_labels = _data(index["notice_labels"], "array<string>")
    scored = F.transform("noticed", lambda c: F.struct(share(c).alias("score"), F.element_at(notice_labels, c["t"] + 1).alias("label")))
    found = found.withColumn("notices", F.filter(scored, lambda x: x["score"] >= LEAST_AGREEMENT))
    base_label = _data(index["labels"], "array<string>")
    placed = F.transform("phrases", lambda f: F.struct(f["start"].cast("int").alias("word"), F.element_at(base_label, f["q"] + 1).alias("label")))
    found = found.withColumn("places", F.array_sort(F.filter(placed, lambda x: x["label"].isNotNull())))
    base_labels = F.array_sort(F.array_distinct("places.label"))
    labels = F.array_sort(F.array_union("places.label", "notices.label"))
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("notices.score"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").cast("long").alias("first_word"), F.array_max("places.word").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "places")
