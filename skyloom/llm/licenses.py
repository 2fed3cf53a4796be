"""Licence notices in texts, found through a positional index of rare words.

A notice is a label, a text and key phrases of that text. It stands at a word of a file if all its key phrases stand at
their places relative to that word and at least SHARE of its words do.

1. The words of all notices are a vocabulary, some hundred words. Spark counts in how many documents each stands (its
   frequency gives the IDF); tasks send one row a word.
2. The index holds postings (notice, position) of the words of key phrases, highest IDF first. A file's words are mapped to
   the vocabulary exactly, by their bytes.
3. A notice is looked up in a file that has all of its key words: the starts its two rarest words imply are intersected by
   relative position, then the other postings of its key phrases thin them out, then the share of words at their places is
   taken. A start that this misses can't have all key phrases, so the IDF decides about speed and never about results.

Base phrases are found wherever their words stand consecutively. Words are runs of ASCII letters and digits and of anything
beyond ASCII; A-Z are lower-cased. Texts of any length are scanned whole; all places are kept. Null or empty text: no words,
no labels. Null doc_id and repeated rows: a row each. Ties in IDF: by word. Two notices at one place: both labels. Empty table: no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import ODD, U64, mix64, set_arrow_batches, stash

#: Phrases of the base and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices as their publishers word them: label, text, key phrases.
NOTICES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "without specific prior written permission")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "either version 3")),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "either version 2")),
    ("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license", "either version 3")),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ("gnu lesser general public license", "either version 2 1")),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license", "either version 3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international license",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0 international license",)),
    ("cc0-1.0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Words of a notice that must stand at their places, at least.
SHARE = 0.75
#: Rarest key words whose postings are intersected first.
RARE = 2
FOUND = "doc_id long, n_words long, base array<struct<label string, word long>>, notices array<struct<label string, word long, n_words int, share double>>"


def split(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


_IN_WORD = np.ones(256, bool)
_IN_WORD[:128] = False
_IN_WORD[ord("0") : ord("9") + 1] = True
_IN_WORD[ord("a") : ord("z") + 1] = True


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of their words."""
    data = np.frombuffer(raw.lower(), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edge[0::2], edge[1::2]


class Vocabulary:
    """Words as whole rows of 8-byte lanes, so that looking one up compares all its bytes."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lanes = -(-max(len(w.encode()) for w in words) // 8)
        data = "".join(words).encode()
        end = np.cumsum([len(w.encode()) for w in words])
        lanes, size = self._lanes(np.frombuffer(data, np.uint8), np.append(0, end[:-1]), end)
        key = self._key(lanes, size)
        self.order = np.argsort(key)
        self.key, self.lane, self.size = key[self.order], lanes[:, self.order], size[self.order]

    def _lanes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        room = np.concatenate((data, np.zeros(8 * self.lanes, np.uint8)))
        window = np.ndarray((len(room) - 7,), "<u8", room.data, 0, (1,))
        out = np.zeros((self.lanes, len(start)), U64)
        for k in range(self.lanes):
            bits = (8 * np.clip(size - 8 * k, 0, 8)).astype(U64)
            mask = np.where(bits == 64, ~U64(0), (U64(1) << (bits & U64(63))) - U64(1))
            out[k] = window[np.minimum(start + 8 * k, len(window) - 1)] & mask
        return out, size

    def _key(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        key = size.astype(U64)
        for lane in lanes:
            key = mix64((key + lane) * ODD)
        return key

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words not in the vocabulary."""
        lanes, size = self._lanes(data, start, end)
        at = np.minimum(np.searchsorted(self.key, self._key(lanes, size)), len(self.key) - 1)
        same = (self.size[at] == size) & (self.lane[:, at] == lanes).all(axis=0)
        return np.where(same, self.order[at], -1)


class Index:
    """Notices and phrases over one vocabulary; postings of key words, rarest first where document frequencies are known."""

    def __init__(self, notices=NOTICES, phrases=PHRASES, frequency: dict[str, int] | None = None):
        texts = [split(text) for _, text, _ in notices]
        self.words = sorted({w for t in texts for w in t} | {w for p, _ in phrases for w in split(p)})
        self.vocabulary = Vocabulary(self.words)
        number = {w: i for i, w in enumerate(self.words)}
        self.phrases = [(label, [number[w] for w in split(p)]) for p, label in phrases]
        self.notices = []
        for (label, _, keys), text in zip(notices, texts, strict=True):
            places = set()
            for key in map(split, keys):
                starts = [s for s in range(len(text) - len(key) + 1) if text[s : s + len(key)] == key]
                if not starts:
                    raise ValueError(f"the notice of {label} lacks its key phrase {' '.join(key)}")
                places |= {starts[0] + i for i in range(len(key))}
            rarest = sorted(places, key=lambda q: ((frequency or {}).get(text[q], 0), text[q], q))
            self.notices.append((label, np.array([number[w] for w in text]), rarest))
        self.needed = np.zeros((len(self.notices), len(self.words)), bool)
        for k, (_, text, postings) in enumerate(self.notices):
            self.needed[k, text[postings]] = True

    def places(self, ids: np.ndarray) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Places of base phrases, and (label, word, words, share) of the notices that stand in a file."""
        known = np.flatnonzero(ids >= 0)
        order = known[np.argsort(ids[known], kind="stable")]
        first = np.searchsorted(ids[order], np.arange(len(self.words) + 1))
        at = lambda word: order[first[word] : first[word + 1]]
        padded = np.concatenate((ids, np.full(max(len(t) for _, t, _ in self.notices), -1)))
        base = []
        for label, phrase in self.phrases:
            start = at(phrase[0])
            for k, word in enumerate(phrase[1:], 1):
                start = start[padded[start + k] == word]
            base += [(label, s) for s in start.tolist()]
        there = first[1:] > first[:-1]
        found = []
        for k in np.flatnonzero(~(self.needed & ~there).any(axis=1)):
            label, text, postings = self.notices[k]
            start = at(text[postings[0]]) - postings[0]
            for q in postings[1:RARE]:
                start = np.intersect1d(start, at(text[q]) - q, assume_unique=True)
            start = start[start > -len(text)]
            for q in postings[RARE:]:
                start = start[padded[start + q] == text[q]]
            if len(start):
                # A notice may be cut off by the file's beginning; its key phrases can't be.
                share = sum((padded[np.maximum(start + q, -1)] == word) & (start + q >= 0) for q, word in enumerate(text)) / len(text)
                found += [(label, int(s), len(text), float(x)) for s, x in zip(start, share, strict=True) if x >= SHARE]
        return base, found


def _present(index: Index):
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(index.words), np.int64)
        for batch in batches:
            for raw in batch.column("raw"):
                ids = index.vocabulary.ids(*words_of(raw.as_py() or b""))
                count[np.unique(ids[ids >= 0])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(index.words), pa.array(count)], names=["word", "n"])

    return present


def _raw(docs: DataFrame) -> DataFrame:
    set_arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"))


def frequencies(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> dict[str, int]:
    """In how many documents each word of the notices stands: as many rows as the notices have words."""
    counted = _raw(docs).select("raw").mapInArrow(_present(Index(notices, phrases)), "word string, n long")
    return {r["word"]: r["n"] for r in stash(counted.groupBy("word").agg(F.sum("n").alias("n")), "licence-words").collect()}


def _scan(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        notice_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64())]))
        for batch in batches:
            sizes, bases, notices = [], [], []
            for raw in batch.column("raw"):
                ids = index.vocabulary.ids(*words_of(raw.as_py() or b""))
                base, found = index.places(ids)
                sizes.append(len(ids))
                bases.append([{"label": x, "word": w} for x, w in base])
                notices.append([{"label": x, "word": w, "n_words": n, "share": s} for x, w, n, s in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bases, base_type), pa.array(notices, notice_type)], names=["doc_id", "n_words", "base", "notices"])

    return scan


def scanned(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Every document's number of words, places of base phrases and notices with their place, length and share. A cut-off notice's place may be negative."""
    return _raw(docs).mapInArrow(_scan(Index(notices, phrases, frequencies(docs, notices, phrases))), FOUND)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, own = F.col("base.label"), F.col("notices.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max("notices.share"), F.lit(0.0)).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
