"""License scans: exact phrases, and short notices within a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, octets, portions

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices that the fuzzy search looks for, in words and single spaces.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "bsd 3 clause license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "all-rights-reserved",
}
#: Letters of a notice for each edit that is allowed.
LETTERS_PER_EDIT = 9

#: A-Z to a-z; what is no word character to a space; digits, letters and bytes from 128 stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    edits: int

    @property
    def seeds(self) -> list[tuple[int, str]]:
        """Pieces, one more than edits: an occurrence with so many edits has one of them unchanged."""
        n, k = len(self.words), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds notices with at most their number of edits (insertions, deletions, substitutions of characters)."""

    def __init__(self, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, letters_per_edit: int = LETTERS_PER_EDIT):
        self.notices = [Notice(w, label, len(w) // letters_per_edit) for w, label in notices.items()]
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(x.words, literal_spaces=True)}){{e<={x.edits}}}") for x in self.notices]
        self.trie = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for offset, seed in notice.seeds:
                where.setdefault(seed, []).append((n, offset))
        for seed, uses in where.items():
            self.trie.add_word(seed, (len(seed), uses))
        self.trie.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """``(start, end, label, similarity)`` of notices in normalised text, in order; those of one notice don't overlap."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.trie.iter(text):
            for n, offset in uses:
                x = self.notices[n]
                a, b = end + 1 - size - offset - x.edits, end + 1 - size - offset + len(x.words) + x.edits
                own = windows.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        found = []
        for n, own in windows.items():
            x = self.notices[n]
            for a, b in own:
                # The best match of a window first, then what stands before and behind it.
                parts = [(max(a, 0), min(b, len(text)))]
                while parts:
                    start, end = parts.pop()
                    m = self.patterns[n].search(text, start, end) if end - start >= len(x.words) - x.edits else None
                    if m:
                        found.append((m.start(), m.end(), x.label, 1 - sum(m.fuzzy_counts) / len(x.words)))
                        parts += [(start, m.start()), (m.end(), end)]
        return sorted(found)

    def scan(self, raw: bytes) -> tuple:
        """Row of one text: words, base places, first, last, base labels, labels, score, spans by words."""
        kept = raw.translate(_WORDS).split()
        joined = b" " + b" ".join(kept) + b" " if kept else b""
        places, base = [], set()
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                places.append(joined.count(b" ", 0, at))
                base.add(label)
                at = joined.find(phrase, at + 1)
        spans = []
        if joined:
            text = joined.decode("utf-8", "replace")
            for start, end, label, like in self.spans(text):
                first = text.count(" ", 0, start + 1) - 1 if text[start] != " " else text.count(" ", 0, start)
                spans.append({"first_word": max(first, 0), "last_word": max(first, text.count(" ", 0, end) - 1), "label": label, "similarity": like})
        labels = base | {s["label"] for s in spans}
        score = 1.0 if base else max((s["similarity"] for s in spans), default=0.0)
        return len(kept), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())]))
FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,last_word:long,label:string,similarity:double>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan(docs: DataFrame, text_col: str = "text", notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Add to each row what its whole text says about licenses.

    A-Z become a-z, words are runs of digits, letters and non-ASCII characters. ``n_base`` counts every
    place where a phrase's words stand in a row (``first_word``, ``last_word``: smallest and largest
    start, null without any); ``base_labels`` are their labels. Fuzzy notices are searched in the words
    joined by single spaces: each is split into one piece more than its edits, an automaton finds the
    pieces, and bounded-error matching around them reports ``spans`` in words with their similarity.
    ``labels`` has the labels of both, ``score`` the best similarity (1 for a base phrase, 0 if none).

    Null and empty text have no words and no labels; repeated rows give equal rows; an empty table
    gives an empty result; the columns of the result replace those of equal name.
    """
    arrow_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in _NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for batch in portions(batches, "_text"):
            at, data = octets(batch.column(batch.num_columns - 1))
            whole = data.tobytes()
            rows = list(zip(*(scanner.scan(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(rows, _TYPES))], [*keep, *_NAMES])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(FOUND).fields])
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


__all__ = ["NOTICES", "PHRASES", "Notice", "Scanner", "scan"]
