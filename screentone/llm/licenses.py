"""License scans: phrases at word level, and an exact set-similarity join of text blocks with templates.

Blocks are overlapping windows of words over the whole text, so that wrapped notices are whole in one,
and lines besides. A template matches a block that holds at least
`threshold` of its distinct tokens. Tokens are ordered by how many blocks of the whole corpus hold
them, rarest first; a matching block must hold one of the template's first n - ceil(threshold*n) + 1
tokens (prefix filter), have enough tokens at all (length filter), and have enough left from the
place of the first hit on (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License notices in their customary wording (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Words that name a license: a template that holds them matches only with all of them.
NAMES = {"mit": "mit", "apache": "apache", "gpl": "general", "mpl": "mozilla", "cc-by": "cc by", "cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa"}

# A-Z to lower case; all other ASCII but digits and letters to a space; line feeds stay
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def _lines(text: str | None) -> list[list[bytes]]:
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")]


def _blocks(line: list[bytes], width: int):
    """The words, or windows of `width` words at half their distance if there are more."""
    if len(line) <= width:
        yield set(line)
    else:
        for at in range(0, len(line) - width // 2, width // 2):
            yield set(line[at : at + width])


def _text_blocks(lines: list[list[bytes]], width: int):
    """Windows over the whole text, then those of its lines where there are several."""
    yield from _blocks([w for line in lines for w in line], width)
    if len(lines) > 1:
        for line in lines:
            yield from _blocks(line, width)


def tokens(template: str) -> set[bytes]:
    return {w for line in _lines(template) for w in line}


def block_counts(docs: DataFrame, vocabulary: set[bytes], width: int, text_col: str = "text") -> dict[bytes, int]:
    """For each token of the templates, the blocks of the corpus that hold it."""

    def run(batches):
        n = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for t in b.column(0).to_pylist():
                for block in _text_blocks(_lines(t), width):
                    for w in block & vocabulary:
                        n[w] += 1
        yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in got}


class Index:
    """Templates by the tokens of their prefixes, in the global order."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        self.sets = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            t = sorted(tokens(text), key=lambda w: (counts.get(w, 0), w))
            if not t:
                continue
            need = ceil(threshold * len(t) - 1e-9)
            for at, w in enumerate(t[: len(t) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.sets), at))
            self.sets.append((label, frozenset(t), need))

    def named(self, block: set[bytes]) -> list[tuple[float, str]]:
        """(containment, label) of the matched templates whose names are in the block.

        One whose common tokens are a proper part of another one's is left out: CC BY-NC also holds CC BY.
        """
        held = [(share, label, t & block) for share, _, label, t in self._matches(block) if block.issuperset(t & set(NAMES.get(label, "").encode().split()))]
        return [(share, label) for share, label, t in held if not any(t < other for *_, other in held)]

    def match(self, block: set[bytes]) -> list[tuple[float, int, str]]:
        """(containment, tokens in common, label) of every template the block matches."""
        return [m[:3] for m in self._matches(block)]

    def _matches(self, block: set[bytes]) -> list[tuple[float, int, str, frozenset[bytes]]]:
        first: dict[int, int] = {}
        for w in block & self.prefix.keys():
            for k, at in self.prefix[w]:
                first[k] = min(at, first.get(k, at))
        out = []
        for k, at in first.items():
            label, t, need = self.sets[k]
            if len(block) < need or len(t) - at < need:
                continue
            both = len(t & block)
            if both >= need:
                out.append((both / len(t), both, label, t))
        return out


def licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, width: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases; first_word and last_word are their smallest and largest
    start (null without one). labels adds, for each block, those of all matching templates that hold their
    names, but one whose common tokens are a proper part of another one's; both are distinct, sorted and
    comma-joined, empty if there are none. score: 1 with a phrase, else the highest containment
    of a matching template, else 0. Null and empty texts have no words. Repeated rows get equal results; an empty table gives an
    empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    vocabulary = set().union(*[tokens(t) for _, t in templates]) if templates else set()
    # windows overlap by half, so any half window of words is whole in one
    width = max([width, *(2 * sum(map(len, _lines(t))) for _, t in templates)])
    index = Index(templates, block_counts(docs, vocabulary, width, text_col), threshold)
    phrases = [(p.encode(), label) for p, label in PHRASES.items()]

    def scan(text):
        lines = _lines(text)
        n = sum(map(len, lines))
        places, base = [], set()
        flat = b" " + b" ".join(w for line in lines for w in line) + b" "
        for p, label in phrases:
            at = flat.find(b" " + p + b" ")
            while at >= 0:
                places.append(flat.count(b" ", 0, at + 1) - 1)
                base.add(label)
                at = flat.find(b" " + p + b" ", at + 1)
        labels, score = set(base), 1.0 if base else 0.0
        if not index.prefix.keys().isdisjoint(flat.split()):
            for block in _text_blocks(lines, width):
                if not index.prefix.keys().isdisjoint(block):
                    found = index.named(block)
                    labels.update(label for _, label in found)
                    score = max([score, *(share for share, _ in found)])
        return n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches):
        for b in batches:
            found = [scan(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*found)) if found else [[]] * 7
            yield pa.record_batch([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=names)

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
