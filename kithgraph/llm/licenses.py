"""Licence notices by a trained paragraph classifier.

A paragraph is a line with a word, and also a block of two or more lines between blank ones (a wrapped
notice); comment marks count as spaces. A block counts if it is confirmed and none of its lines is for the
same family. Its features are word sequences of one to three words that occur in
the notice templates and hold a telling word (one that the corpus's own paragraphs, notices left out, hardly
use, and of each template its two rarest in them). A sparse
multinomial logistic regression (L1 penalty, by proximal gradient steps) is fitted to disturbed copies of
the templates, one class for each licence family, against the class "unknown": ``max_paragraphs``
paragraphs of the corpus, the first by a hash of text and place, each text once (a documented bound), and disturbed
paragraphs of ordinary words around single telling words. A temperature fitted on a held-out part
calibrates the probabilities; a family is predicted only above the level that a thousandth of the
held-out unknown paragraphs exceeds, and above one half. A prediction is confirmed if the paragraph holds
``overlap`` percent or more of the word pairs of one of the family's templates.

A paragraph without a telling word has no feature and is unknown, so that only the others are scored.
The fit happens on the driver, on the bounded sample; on the rows there are SQL functions only.

Nulls: a null text has no paragraph; null ids are kept; rows that repeat give their paragraphs again.
Other columns are ignored. Without any document the templates alone are fitted.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Notices by which families are known (fixed values: the usual wording of licence notices).
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission."],
}
_MARKS = ".,;:!?\"'()[]{}*#/-=&%$|<>"
UNKNOWN = "unknown"
_STOP = {"the", "of", "to", "a", "and", "or", "in", "is", "for", "any", "this", "you", "with", "by", "it", "not", "be", "are", "may", "can", "that", "no", "if", "at"}


def _plain(text: str) -> list[str]:
    return text.lower().translate(str.maketrans(dict.fromkeys(_MARKS, " "))).split()


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def words_col(line: str) -> Column:
    return F.filter(F.split(F.lower(F.translate(F.col(line), _MARKS, " " * len(_MARKS))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


class Model:
    """classes, telling words, and for each feature its weights; bias; temperature; the level to reach."""

    def __init__(self, paragraphs: list[list[str]], seed: int = 11, copies: int = 40):
        r = random.Random(seed)
        self.classes = [UNKNOWN, *TEMPLATES]
        known = [(f, _plain(t)) for f, ts in TEMPLATES.items() for t in ts]
        sure = [set(_grams(t)) for _, t in known]
        # notices neither make words common nor are unknown, however many there are
        paragraphs = [p for p in paragraphs if not any(len(_grams(p) & s) > 0.5 * len(s) for s in sure)]
        held: dict[str, int] = {}
        for p in paragraphs:
            for w in set(p):
                held[w] = held.get(w, 0) + 1
        able = [{w for w in t if w not in _STOP and not w.isdigit() and len(w) > 1} for _, t in known]
        telling = {w for ws in able for w in ws if held.get(w, 0) * 50 <= len(paragraphs)}
        for ws in able:  # the two rarest words of each template tell in any corpus
            telling.update(sorted(ws, key=lambda w: (held.get(w, 0), w))[:2])
        self.telling = sorted(telling)
        tells = set(self.telling)
        self.features = sorted(g for g in set().union(*(_grams(t) for _, t in known)) if tells & set(g.split()))
        place = {g: k for k, g in enumerate(self.features)}
        filler = sorted(held) or ["lorem", "ipsum", "dolor", "sit"]
        noise = lambda k: [r.choice(filler) for _ in range(k)]
        rows: list[tuple[int, list[str]]] = []
        for family, t in known:
            for _ in range(copies):
                own = [w for w in t if r.random() > 0.06]
                if len(t) > 12 and r.random() < 0.3:
                    own = own[: max(8, len(own) * 2 // 3)]
                rows.append((self.classes.index(family), noise(r.choice([0, 0, 2, 8])) + own + noise(r.choice([0, 0, 2, 8]))))
        rows += [(0, p) for p in paragraphs]
        for _ in range(copies * 10):
            rows.append((0, noise(r.randint(2, 12)) + [r.choice(self.telling)] + noise(r.randint(2, 12))))
        r.shuffle(rows)
        x = np.zeros((len(rows), len(self.features)), np.float32)
        for i, (_, p) in enumerate(rows):
            x[i, [place[g] for g in _grams(p) if g in place]] = 1
        y = np.array([c for c, _ in rows])
        fit = np.arange(len(rows)) % 4 != 0
        self.weights, self.bias = self._fit(x[fit], y[fit])
        logits = x[~fit] @ self.weights + self.bias
        self.temperature = min((t for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(logits)), y[~fit]], 1e-12)).mean())
        p = _softmax(logits / self.temperature)
        wrong = np.sort(p[y[~fit] == 0][:, 1:].max(axis=1))[::-1]
        self.level = max(0.5, float(wrong[len(wrong) // 1000]) if len(wrong) else 0.5)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 250, penalty: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.classes)
        w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
        hot = np.eye(k, dtype=np.float32)[y]
        balance = (1 / np.maximum(1, hot.sum(axis=0)))[y]
        balance = (balance / balance.sum())[:, None].astype(np.float32)
        rate = np.float32(1 / (0.5 * (x * x * balance).sum(axis=1).sum() + 0.5))
        v, c, t = w, b, 1.0
        for _ in range(steps):  # accelerated
            g = (_softmax(x @ v + c) - hot) * balance
            step = v - rate * (x.T @ g)
            new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
            base = c - rate * g.sum(axis=0)
            u = (1 + math.sqrt(1 + 4 * t * t)) / 2
            v, c = new + (t - 1) / u * (new - w), base + (t - 1) / u * (base - b)
            w, b, t = new, base, u
        return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BLANK = "^[\\\\x20\\\\x09-\\\\x0D]*$"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("lines"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: bool = True) -> DataFrame:
    """doc_id, h (the text's hash), block (its first line's number), pos, n_lines, words: of all lines with a word and, if asked for, blocks of lines."""
    rows = _lines(docs, id_col, text_col).withColumn("blank", F.expr(f"transform(lines, x -> x rlike '{_BLANK}')"))
    each = "sequence(0, size(lines) - 1)"
    rows = rows.withColumn("starts", F.expr(f"filter({each}, i -> not blank[i] and (i = 0 or blank[greatest(i - 1, 0)]))"))
    rows = rows.withColumn("ends", F.expr(f"filter({each}, i -> not blank[i] and (i = size(lines) - 1 or blank[least(i + 1, size(lines) - 1)]))"))
    lines = "flatten(zip_with(starts, ends, (s, e) -> transform(sequence(s, e), i -> named_struct('block', s, 'pos', i, 'n_lines', 1, 'text', lines[i]))))"
    whole = "filter(zip_with(starts, ends, (s, e) -> named_struct('block', s, 'pos', s, 'n_lines', e - s + 1, 'text', case when e > s then array_join(slice(lines, s + 1, e - s + 1), ' ') end)), u -> u.n_lines > 1)"
    units = F.explode(F.expr(f"concat({lines}, {whole})" if blocks else lines)).alias("u")
    return rows.select("doc_id", "h", units).select("doc_id", "h", "u.*").withColumn("words", words_col("text")).drop("text").where(F.size("words") > 0)


def trained(docs: DataFrame, max_paragraphs: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fitted to the first ``max_paragraphs`` lines by hash. The hash is held below a level first, so that no task sends more than its share."""
    rows = _lines(docs, id_col, text_col)
    n = rows.agg(F.sum(F.size("lines"))).first()[0] or 0
    rows = rows.select("doc_id", F.posexplode("lines").alias("pos", "line")).withColumn("k", F.xxhash64("doc_id", "pos", "line"))
    rows = rows.where(F.pmod("k", F.lit(1 << 40)) < F.lit(min(1 << 40, (4 * max_paragraphs << 40) // max(1, n)))).withColumn("words", words_col("line")).where(F.size("words") > 0)
    sample = rows.select("k", "words").orderBy("k", F.size("words")).limit(max_paragraphs).collect()
    return Model([list(x) for x in dict.fromkeys(tuple(dict.fromkeys(r["words"])) for r in sample)])  # each text once


def licences(docs: DataFrame, model: Model | None = None, overlap: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs for which a family is predicted: doc_id, pos (first line), n_lines, family, probability, similarity, confirmed."""
    names = {"id_col": id_col, "text_col": text_col}
    m = model or trained(docs, **names)
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    rows = paragraphs(docs, **names).where(F.arrays_overlap("words", texts(m.telling)))
    pairs = "transform(sequence(2, size(words)), i -> concat_ws(' ', words[i - 2], words[i - 1]))"
    triples = "transform(sequence(3, size(words)), i -> concat_ws(' ', words[i - 3], words[i - 2], words[i - 1]))"
    none = "cast(array() as array<string>)"
    rows = rows.withColumn("pairs", F.expr(f"case when size(words) > 1 then {pairs} else {none} end")).withColumn("triples", F.expr(f"case when size(words) > 2 then {triples} else {none} end"))
    used = [k for k in range(len(m.features)) if np.abs(m.weights[k]).max() > 1e-6]
    weights = F.create_map(*[c for k in used for c in (F.lit(m.features[k]), F.array(*[F.lit(float(v)) for v in m.weights[k]]))])

    def plus(k: int):
        return lambda s, x: s + x[k]

    def scored(adds: Column) -> Column:
        logits = F.array(*[F.aggregate(adds, F.lit(float(b)), plus(k)) / m.temperature for k, b in enumerate(m.bias)])
        return _let(logits, lambda z: _let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), chances))

    def chances(e: Column) -> Column:
        top = F.array_max(e)
        return F.struct(F.element_at(texts(m.classes), F.array_position(e, top).cast("int")).alias("family"), F.round(top / F.aggregate(e, F.lit(0.0), lambda a, b: a + b), 6).alias("probability"))

    adds = F.transform(F.array_intersect(F.concat("words", "pairs", "triples"), texts([m.features[k] for k in used])), lambda f: F.try_element_at(weights, f))
    # inside a generator, so that no filter repeats the expression
    best = F.filter(F.array(_let(adds, scored)), lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= m.level))
    place = ["doc_id", "h", "block", "pos", "n_lines"]
    rows = rows.select(*place, "pairs", F.explode(best).alias("s")).select(*place, "pairs", "s.family", "s.probability")
    similar = F.lit(0.0)
    for family, ts in TEMPLATES.items():
        shares = []
        for t in ts:
            w = _plain(t)
            own = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
            shares.append(F.size(F.array_intersect("pairs", texts(own))) / len(own))
        similar = F.when(F.col("family") == family, F.greatest(*shares, F.lit(0.0))).otherwise(similar)
    rows = rows.select(*place, "family", "probability", F.round(similar, 6).alias("similarity")).withColumn("confirmed", F.col("similarity") * 100 >= overlap)
    known = F.max((F.col("confirmed") & (F.col("n_lines") == 1)).cast("int")).over(W.partitionBy("doc_id", "h", "block", "family"))
    rows = rows.withColumn("known", known).where("n_lines = 1 or (confirmed and known = 0)")
    return rows.select("doc_id", "pos", "n_lines", "family", "probability", "similarity", "confirmed")
