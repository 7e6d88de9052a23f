"""Licence scans by a positional rare-token index.

Index: every licence template is a word sequence; the document frequencies of
its words in the corpus give their IDF, and the ``ANCHORS`` highest-IDF words
of a template are posted as (word -> template, position). Scan: the licence
words of a file are looked up from the highest IDF down; an anchor at file position p with a
posting at template position q votes for the template starting at p - q
(postings intersect by relative position). Alignments with enough votes are
verified: each mandatory key phrase must stand at its place, and the share of the
template's IDF weight that matches at its place must reach the template's
minimum; behind the name of a Creative Commons licence no further part of a name may stand
(``cc by nc sa`` is no ``cc by nc``). Short phrase templates are mandatory as a whole, so every place where
their words stand consecutively is found.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

One job counts document frequencies (a row for each template word and task), one scans;
nothing else is shuffled. The index is as large as the templates, whatever the corpus.

Defined cases: null and empty texts have no words and no licence; repeated rows
are scanned each; an empty table gives an empty result; other columns pass
through :func:`scan` whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finledger.llm._common import free_name

ANCHORS = 4

# FIXED VALUES: phrases and notices that must be found (public licence wording).
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
]
NOTICES += [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "this permission notice shall be included in all copies"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
     "each contributor hereby grants to you a perpetual worldwide"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
     "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
     "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
     "may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work to the public domain"),
]
# Names that are found as a whole.
NAMES = [
    ("mpl", "mozilla public license"), ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"),
    ("epl", "eclipse public license"), ("boost", "boost software license"), ("isc", "isc license"),
    ("unlicense", "unlicense org"), ("cc0", "cc0 1 0"), ("cc0", "creativecommons org publicdomain zero"),
    *[("cc-by", f"cc by {version}") for version in ("1 0", "2 0", "2 5", "3 0", "4 0")],
]
for _kind in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"):
    _label = "cc-" + _kind.replace(" ", "-")
    _long = " ".join({"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}[x] for x in _kind.split())
    NAMES += [(_label, f"creative commons {_long}"), (_label, f"creativecommons org licenses {_kind}")]
    if _kind != "by":  # "cc by" alone may be prose
        NAMES.append((_label, f"cc {_kind}"))
NOTICES += [(label, name, name) for label, name in NAMES]
#: Parts of the names of Creative Commons licences.
_PARTS = frozenset([b"nc", b"sa", b"nd", b"noncommercial", b"sharealike", b"noderivatives", b"noderivs"])
LEAST_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    base: bool
    key: tuple[int, int]      # mandatory phrase: from, to
    least: float              # share of IDF weight that must match
    barred: frozenset[bytes] = frozenset()   # words that must not follow the phrase


def templates(notices: list[tuple[str, str, str]] | None = None) -> list[Template]:
    """The base phrases and the notices (label, wording, mandatory phrase in it), ``NOTICES`` unless given."""
    out = []
    for label, phrase in PHRASES:
        w = tuple(phrase.encode().split())
        out.append(Template(label, w, True, (0, len(w)), 1.0))
    for label, notice, key in NOTICES if notices is None else notices:
        w, k = tuple(_words(notice)), tuple(_words(key))
        at = next((i for i in range(len(w)) if w[i:i + len(k)] == k), None)
        if not k or at is None:
            raise ValueError(f"the notice of {label!r} does not hold its phrase {key!r}")
        barred = _PARTS if k[0] in (b"cc", b"creative", b"creativecommons") else frozenset()
        out.append(Template(label, w, False, (at, at + len(k)), LEAST_SHARE, barred))
    return out


#: ASCII bytes that are no word characters become spaces, A-Z become a-z; bytes of other characters stay.
_TO_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def document_frequencies(docs: DataFrame, text: str, vocabulary: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents in all and with each word of the vocabulary (bounded by the templates)."""
    known = frozenset(vocabulary)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        n, has = 0, Counter()
        for b in batches:
            for t in b.column(0):
                n += 1
                has.update(known.intersection(_words(t.as_py())))
        rows = [(b"", n), *has.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0].decode() for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["w", "n"])

    rows = docs.select(text).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {r["w"].encode(): r["n"] for r in rows}
    return df.pop(b"", 0), df


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, found: list[Template], docs: int, df: dict[bytes, int], anchors: int = ANCHORS):
        self.templates = found
        self.idf = {w: math.log((1 + docs) / (1 + df.get(w, 0))) + 1e-3 for t in found for w in t.words}
        self.need, self.weight, self.postings = [], [], {}
        for i, t in enumerate(found):
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[:anchors]
            at = [q for q, w in enumerate(t.words) if w in rare]
            for q in at:
                self.postings.setdefault(t.words[q], []).append((i, q))
            self.weight.append(sum(self.idf[w] for w in t.words))
            # votes that an alignment with the least share must have at least: matching words weigh that share
            slack, votes = (1 - t.least) * self.weight[-1], len(at)
            for w in sorted((self.idf[t.words[q]] for q in at)):
                if w > slack + 1e-12:
                    break
                slack, votes = slack - w, votes - 1
            self.need.append(max(1, votes))

    def scan(self, words: list[bytes]):
        """(template index, start, share) of every verified alignment."""
        from collections import Counter

        get, votes = self.postings.get, Counter()
        own = [(p, w) for p, w in enumerate(words) if w in self.postings]
        own.sort(key=lambda x: -self.idf[x[1]])  # the highest-IDF words of the file first
        for p, w in own:
            for i, q in get(w):
                if p >= q:
                    votes[i, p - q] += 1
                elif not self.templates[i].base:
                    votes[i, p - q] += 1
        out = []
        for (i, start), n in votes.items():
            t = self.templates[i]
            if n < self.need[i]:
                continue
            lo, hi = t.key
            if start + lo < 0 or tuple(words[start + lo:start + hi]) != t.words[lo:hi]:
                continue
            if t.barred and start + hi < len(words) and words[start + hi] in t.barred:
                continue
            share = sum(self.idf[w] for q, w in enumerate(t.words) if 0 <= start + q < len(words) and words[start + q] == w) / self.weight[i]
            if share >= t.least - 1e-9:
                out.append((i, start, min(1.0, share)))
        return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, anchors: int = ANCHORS,
         notices: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The input's columns (or ``keep``) with n_words, places (template label, base, start, share), and what they sum up to:
    n_base, first_word, last_word, base_labels, labels, score (the best share; 0 without a licence).

    ``notices`` (label, wording, mandatory phrase) take the place of ``NOTICES``; the base phrases always count.
    """
    found = templates(notices)
    n, df = document_frequencies(docs, text, sorted({w for t in found for w in t.words}))
    index = Index(found, n, df, anchors)
    keep = docs.columns if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]

    def run(batches):
        import pyarrow as pa

        place = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            count, places = [], []
            for t in b.column(0):
                w = _words(t.as_py())
                hits = sorted((s, i, x) for i, s, x in index.scan(w))
                count.append(len(w))
                places.append([{"label": found[i].label, "base": found[i].base, "start": s, "share": x} for s, i, x in hits])
            yield pa.RecordBatch.from_arrays([*[b.column(j + 1) for j in range(len(names))], pa.array(count, pa.int64()), pa.array(places, place)],
                                             [*names, "n_words", "places"])

    schema = T.StructType([T.StructField(x, docs.schema[c].dataType) for c, x in zip(keep, names)] + [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
            T.StructField("start", T.LongType()), T.StructField("share", T.DoubleType())])))])
    out = docs.select(F.col(text).alias("_text"), *[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names)]).mapInArrow(run, schema)
    base = F.filter("places", lambda p: p["base"])

    def joined(places):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["start"])
    sums = {"n_base": F.size(base).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
            "base_labels": joined(base), "labels": joined(F.col("places")),
            "score": F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))}
    return out.select(*[F.col(x).alias(c) for c, x in zip(keep, names)], 
                      *[F.col(c).alias(free_name(c, keep)) for c in ("n_words", "places")], *[v.alias(free_name(k, keep)) for k, v in sums.items()])
