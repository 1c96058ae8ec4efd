"""Licence scan with a positional rare-token index (operator 4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

# Fixed values of the contract: phrase and label.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, words of a public licence text or notice, phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ("gnu general public license", "version 2")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license", "version 3")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation",
     ("free software", "gnu general public license")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ("with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("unencumbered software", "public domain")),
    # whole licences
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the "
            "following conditions the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any "
            "kind express or implied including but not limited to the warranties of merchantability fitness for a "
            "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
            "any claim damages or other liability whether in an action of contract tort or otherwise arising from "
            "out of or in connection with the software or the use or other dealings in the software",
     ("permission is hereby granted", "without restriction", "as is")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and the author disclaims all warranties with regard to this software "
            "including all implied warranties of merchantability and fitness in no event shall the author be liable "
            "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
            "of use data or profits whether in an action of contract negligence or other tortious action arising out "
            "of or in connection with the use or performance of this software",
     ("with or without fee", "as is")),
    ("bsd-3-clause",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met 1 redistributions of source code must retain the above copyright notice this list "
     "of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
     "notice this list of conditions and the following disclaimer in the documentation and or other materials "
     "provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors "
     "may be used to endorse or promote products derived from this software without specific prior written permission",
     ("redistribution and use in source and binary forms", "neither the name of")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be "
             "held liable for any damages arising from the use of this software permission is granted to anyone to "
             "use this software for any purpose including commercial applications and to alter it and redistribute "
             "it freely subject to the following restrictions 1 the origin of this software must not be "
             "misrepresented you must not claim that you wrote the original software if you use this software in a "
             "product an acknowledgment in the product documentation would be appreciated but is not required 2 "
             "altered source versions must be plainly marked as such and must not be misrepresented as being the "
             "original software 3 this notice may not be removed or altered from any source distribution",
     ("must not be misrepresented", "altered source versions")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
                "software and accompanying documentation covered by this license the software to use reproduce "
                "display distribute execute and transmit the software and to prepare derivative works of the "
                "software and to permit third parties to whom the software is furnished to do so",
     ("any person or organization", "prepare derivative works")),
)

SLACK = 2       # words by which a word may stand off its place, and one more for every SLACK_EACH template words
SLACK_EACH = 20
LEAST = 0.6     # share of a template's words that must stand near their places
AGREE = 2       # rare words that must agree on a start
BASE_SCORE = 0.5

# Words are runs of digits, lower-cased letters and everything beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def _tokens(phrase: str) -> list[bytes]:
    return phrase.encode().split()


def document_frequency(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[dict, int]:
    """In how many documents each template word stands, and the number of documents.

    Counted over all documents, summed inside each task first. The result is
    at most the template vocabulary, a fixed few hundred words.
    """
    vocabulary = frozenset(w for _, text, _ in templates for w in _tokens(text))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen, n = Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *[w.decode() for w in seen]]), pa.array([n, *seen.values()], pa.int64())],
            names=["word", "n"])

    bounded_batches(docs.sparkSession)
    rows = (docs.select(text_col).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


class Template:
    """A template with the words that must stand near their places."""

    def __init__(self, label: str, text: str, phrases, idf):
        self.label, self.words, self.phrases = label, _tokens(text), [_tokens(p) for p in phrases]
        m = len(self.words)
        self.slack = SLACK + m // SLACK_EACH
        self.need = math.ceil(LEAST * m)
        self.key_words = frozenset(w for p in self.phrases for w in p)
        self.rare_first = sorted(range(m), key=lambda i: (-idf(self.words[i]), i))

    def rare_places(self, present) -> list[int] | None:
        """The rarest places of the template that a file with these words has to be asked for.

        A match has ``need`` of m places filled. Of any m - need + AGREE
        places at least AGREE are then filled, so it is enough to look up
        that many less those whose word the file lacks. None: too few.
        """
        here = [i for i in self.rare_first if self.words[i] in present]
        spare = len(here) - self.need
        return None if spare < 0 else here[:spare + min(AGREE, self.need)]


class RareIndex:
    """Postings ``word -> (template, place)`` of all template words, and which of them to ask for in a file."""

    def __init__(self, frequency: dict, n_docs: int, templates=TEMPLATES):
        idf = lambda w: math.log((1 + n_docs) / (1 + frequency.get(w, 0)))
        self.templates = [Template(*t, idf) for t in templates]
        self.base = [(_tokens(phrase), label) for phrase, label in BASE_PHRASES]

    def scan(self, words: list[bytes]):
        """Base places ``(start, label)`` and template matches ``(label, start, length, score)``."""
        present = set(words)
        phrases = [(tokens, label) for tokens, label in self.base if present.issuperset(tokens)]
        asked = [(t, t.rare_places(present)) for t in self.templates if t.key_words <= present]
        asked = [(t, rare) for t, rare in asked if rare is not None]
        if not phrases and not asked:
            return [], []
        places = self.places_of(words, {tokens[0] for tokens, _ in phrases}.union(
            *[t.words for t, _ in asked], *[p for t, _ in asked for p in t.phrases]))
        base = sorted((int(at), label) for tokens, label in phrases for at in self.standing(words, places, tokens))
        return base, [m for t, rare in asked for m in self.matches(words, places, t, rare)]

    @staticmethod
    def places_of(words, wanted) -> dict:
        import numpy as np

        found = {w: [] for w in wanted}
        for at, w in enumerate(words):
            if w in found:
                found[w].append(at)
        return {w: np.array(at, np.int64) for w, at in found.items()}

    @staticmethod
    def standing(words, places, tokens):
        """Where the tokens stand one after the other."""
        return [at for at in places[tokens[0]] if words[at:at + len(tokens)] == tokens]

    @staticmethod
    def near(at, lo, hi):
        """Whether a sorted array of places has one from ``lo`` to ``hi``, for arrays of both."""
        import numpy as np

        return np.searchsorted(at, hi, "right") > np.searchsorted(at, lo, "left")

    def matches(self, words, places, t: Template, rare: list[int]):
        """Matches of one template: starts on which rare words agree, then the phrases, then all its words."""
        import numpy as np

        m, slack = len(t.words), t.slack
        # a word at place i votes for every start within the slack, once per place of the template
        votes = [np.unique(places[t.words[i]][:, None] - i + np.arange(-slack, slack + 1)) for i in rare]
        starts, agree = np.unique(np.concatenate(votes), return_counts=True)
        starts = starts[agree >= min(AGREE, t.need)]
        for p in t.phrases:
            at = np.array(self.standing(words, places, p), np.int64)
            starts = starts[self.near(at, starts - slack, starts + m + slack - len(p))]
        if not len(starts):
            return []
        filled = sum(self.near(places[w], starts + i - slack, starts + i + slack).astype(np.int64)
                     for i, w in enumerate(t.words))
        starts, filled = starts[filled >= t.need], filled[filled >= t.need]
        exact = sum((self.near(places[w], starts + i, starts + i).astype(np.int64) for i, w in enumerate(t.words)),
                    np.zeros(len(starts), np.int64))
        # of starts that overlap the best one stands: most words near, most words in place, first
        apart, taken, out = max(1, m - slack), {}, []
        for k in np.lexsort((starts, -exact, -filled)):
            s, cell = int(starts[k]), int(starts[k]) // apart
            if all(abs(taken.get(c, s + apart) - s) >= apart for c in (cell - 1, cell, cell + 1)):
                taken[cell] = s
                out.append((t.label, max(0, s), m, int(filled[k]) / m))
        return sorted(out, key=lambda x: x[1])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and templates of every document.

    A first pass counts the document frequency of the template words over
    the whole corpus. In a second pass the rarest licence words that a file
    itself has are looked up among the places of each template, as many as
    a match cannot do without, and vote for template starts by relative
    position; a start on which at least ``AGREE`` agree is verified by the
    mandatory phrases and by the share of the template's words that stand
    near their places (``LEAST``). The lookup loses no start that passes
    these checks; of overlapping starts of a template the best is the match.

    Returns id, ``n_words``, ``n_base``, ``first_word``, ``last_word`` (null
    without a base place), ``base_labels``, ``labels``, ``score`` (the best
    template match, one half for a bare phrase, zero for none) and
    ``matches`` (label, start word, words, score). Null and empty texts have
    no words and empty labels; repeated rows are scanned each; an empty
    table gives no rows; other columns are ignored.
    """
    index = RareIndex(*document_frequency(docs, text_col))
    match = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                          T.StructField("words", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField(id_col, docs.schema[id_col].dataType),
              *[T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")],
              T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
              T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(match))]

    def scan(batches):
        import pyarrow as pa

        item = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()),
                                   ("score", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), item]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                base, matches = index.scan(words)
                own = {label for _, label in base}
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                             ",".join(sorted(own)), ",".join(sorted(own | {m[0] for m in matches})),
                             max([BASE_SCORE if base else 0.0, *[m[3] for m in matches]]),
                             [dict(zip(("label", "start", "words", "score"), m)) for m in matches]))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                                             names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(scan, T.StructType(fields))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
