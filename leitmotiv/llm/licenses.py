"""Licence scan: a positional index of rare tokens.

Each template's rarest words (highest IDF over the templates) are filed with their positions. A file's words fetch those
postings; each votes for an alignment (template, file position - template position). So are the rarest words of its key phrases.
An alignment with enough votes, or with those of all key phrases, is a candidate, and it holds if every mandatory key phrase of the template stands, word for word, where the alignment puts it,
give or take `slack` words. Its score is the share of the template's words that stand where the alignment puts them, give
or take the same. Beside that, base phrases are found wherever their words stand consecutively.

One pass over the documents in Arrow batches, nothing is shuffled, and the index is as small as the template list.

Defined results: null and empty texts have 0 words, no labels and score 0. Every place in a text of any length counts.
Repeated rows each get their own row. Other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from leitmotiv.llm.common import map_arrow, utf8

#: On UTF-8 bytes this is the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]: every byte of a character past ASCII is above \\x7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "This library is licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "Licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("mit-notice", "Released under the MIT License", ("mit license",)),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("proprietary", "All rights reserved", ("all rights reserved",)),
)


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z alone


@dataclass
class RareTokenIndex:
    """rare: how many of its rarest words each template is filed under (a word at each of its positions)."""

    templates: tuple[Template, ...] = TEMPLATES
    base: dict[str, str] = field(default_factory=lambda: dict(BASE))
    rare: int = 4
    slack: int = 2

    def __post_init__(self) -> None:
        self.texts = [words(t.text.encode()) for t in self.templates]
        self.keys = [[words(k.encode()) for k in t.keys] for t in self.templates]
        self.phrases = [(words(p.encode()), label) for p, label in self.base.items()]
        self.starts: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for p, label in self.phrases:
            self.starts[p[0]].append((p, label))
        df = Counter(w for t in self.texts for w in set(t))
        self.idf = {w: math.log(len(self.texts) / n) + 1 for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        self.rarest: list[set[bytes]] = []
        self.anchors: list[set[bytes]] = []
        for k, t in enumerate(self.texts):
            rank = lambda w: (-self.idf.get(w, 0.0), w)
            chosen = sorted(set(t), key=rank)[: self.rare]
            self.rarest.append(set(chosen))
            self.anchors.append({min(key, key=rank) for key in self.keys[k]})
            for q, w in enumerate(t):
                if w in self.rarest[k] or w in self.anchors[k]:
                    self.postings[w].append((k, q))
            # Words that two templates tell apart by may be altered, the others must agree on one alignment.
            self.needed.append(max(1, len(chosen) // 2))
        self.look = frozenset(self.postings) | frozenset(self.starts)

    def scan(self, text: bytes) -> dict:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans [(label, first, last word)]."""
        w = words(text)
        look = self.look
        found = [(i, x) for i, x in enumerate(w) if x in look]
        n_base, first, last, base_labels = 0, None, None, set()
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for i, x in found:
            for p, label in self.starts.get(x, ()):
                if w[i : i + len(p)] == p:
                    n_base += 1
                    first, last = i if first is None else first, i
                    base_labels.add(label)
            for k, q in self.postings.get(x, ()):
                votes[k, i - q].add(x)
        labels, score, spans = set(base_labels), 0.0, []
        for (k, at), seen in votes.items():
            near = set().union(*(votes.get((k, at + d), ()) for d in range(-self.slack, self.slack + 1)))
            if (len(near & self.rarest[k]) < self.needed[k] and not self.anchors[k] <= near) or len(seen) < max(len(votes.get((k, at + d), ())) for d in range(-self.slack, self.slack + 1)):
                continue
            t = self.texts[k]
            lo, hi = max(0, at - self.slack), max(0, at + len(t) + self.slack)
            area = w[lo:hi]
            if not all(self._stands(area, key) for key in self.keys[k]):
                continue
            score = max(score, sum(x in w[max(0, at + q - self.slack) : max(0, at + q + self.slack + 1)] for q, x in enumerate(t)) / len(t))
            labels.add(self.templates[k].label)
            spans.append((self.templates[k].label, max(0, at), min(len(w), at + len(t)) - 1))
        if base_labels and not spans:  # a bare mention: the phrase's share of the shortest template that has it
            score = max(len(p) / min((len(t) for t in self.texts if self._stands(t, p)), default=len(p)) for p, label in self.phrases if label in base_labels)
        return {"n_words": len(w), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": float(min(1.0, score)), "spans": sorted(set(spans))}

    @staticmethod
    def _stands(area: list[bytes], phrase: list[bytes]) -> bool:
        n = len(phrase)
        return any(area[i : i + n] == phrase for i in range(len(area) - n + 1))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"


def scan_licenses(docs: DataFrame, index: RareTokenIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the columns of SCHEMA, one row for each row of docs."""
    index = index or RareTokenIndex()
    names = [c.split()[0] for c in SCHEMA.replace("array<struct<label:string,first:long,last:long>>", "x").split(", ")]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def batch(b: pa.RecordBatch) -> dict:
        rows = [index.scan(t) for t in utf8(b.column(1))]
        out = {n: [r[n] for r in rows] for n in names}
        out["spans"] = pa.array([[dict(zip(("label", "first", "last"), s)) for s in x] for x in out["spans"]], spans)
        typed = {"first_word": pa.int64(), "last_word": pa.int64()}
        return {"id": b.column(0)} | {n: pa.array(v, typed[n]) if n in typed else v for n, v in out.items()}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), batch, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
