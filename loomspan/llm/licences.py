"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over word n-grams (one to three words) tells licence families apart. It is trained here, on notices and
licence texts of the families, varied by rule (neighbouring words, cut ends, lost words), and on sentences that state no licence or one of no known family, which make
up the classes none and unknown. A temperature fitted on sentences and variants that were kept from training calibrates its probabilities; below a probability
the answer is unknown. A prediction is confirmed if a template of the family is found in the paragraph.

Scoring runs in Spark's own functions. Lines with a word that licences need (see STRONG) open a paragraph, which goes on over line
ends while such lines follow within a few lines; paragraphs and their single lines are cut into n-grams and joined with the weights, a small table of fixed size.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch

NONE, UNKNOWN = "none", "unknown"
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GNU = "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
_GNU_MERCY = "{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
#: Notices and paragraphs of licence families (fixed values, public wording).
TEMPLATES = {
    "mit": ["Released under the MIT License", "This project is licensed under the terms of the MIT license", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _WARRANTY],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", _GNU.format(it="This program", name="General Public License", n=3), _GNU_MERCY.format(it="This program", name="General Public License"), "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0", _GNU.format(it="This program", name="General Public License", n=2).replace(": you", "; you").replace("Foundation,", "Foundation;"), "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."],
    "lgpl": ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0", _GNU.format(it="This library", name="Lesser General Public License", n=3), _GNU_MERCY.format(it="This library", name="Lesser General Public License"), "GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0", _GNU.format(it="This program", name="Affero General Public License", n=3), _GNU_MERCY.format(it="This program", name="Affero General Public License"), "GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["Released under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0": ["Dedicated to the public domain under CC0 1.0", "Creative Commons Zero CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
#: Paragraphs about licences of no family above; every fifth is kept from training.
OTHERS = ["All rights reserved", "Licensed under the terms of the Example Corporation agreement", "This work is licensed under a proprietary license", "Released under a custom license", "Licensed to the customer under the master license agreement, version 7", "Redistribution of this material is not permitted without a license", "Copyright held by the authors, license on request",
    "Released under the Artistic License 2.0", "Artistic License 2.0 applies", "This program is made available under the terms of the Eclipse Public License 2.0", "Licensed under the Boost Software License, Version 1.0", "Distributed under the zlib license", "This software is covered by the European Union Public Licence", "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "You may not copy, modify or redistribute this document without written permission of the publisher", "This font is licensed under the SIL Open Font License, Version 1.1", "Released under the PostgreSQL License", "Licensed under the Educational Community License", "Do what you want to public license", "Use of this software requires a valid commercial license key", "Your license to use the product is limited, personal and revocable",
    "Copyright 2019 the authors, all rights reserved", "No part of this publication may be reproduced without prior permission", "Licensed under the Python Software Foundation License", "The source is available under a source-available license", "This dataset is released under the Open Database License"]
#: Sentences with such words that state no licence; every fifth is kept from training.
PLAIN = ["The driver lost his license after the third ticket", "She asked for permission to leave the room", "The licensing office opens at nine", "Copyright law is taught in the second year", "The apache helicopter landed near the village", "A warranty covers the engine for five years", "The commons was full of sheep", "Redistribution of income was the topic of the debate", "They granted him a fishing licence for the river", "Mozilla held a meeting in the town hall", "The restaurant needs a license to sell wine", "Permission slips are due on friday",
    "The warranty on the washing machine has expired", "He copied the whole chapter without permission", "The domain name was registered last week", "An open mind is the license of the poet", "The copyright office received many letters", "Marriage licenses are issued at the court", "The isc meeting was moved to tuesday", "Public domain films are shown every sunday", "The bsd conference takes place in ottawa", "A poetic licence is not a legal term"]
#: Words of which a line must hold one to be looked at, as the beginnings of regular expressions (fixed values).
STRONG = "licen[cs]|sublicen|unlicen|copyright|copyleft|spdx|[al]?gpl|apache|mozilla|mpl\\b|bsd|isc\\b|warrant|redistribut|hereby|permission|unencumbered|public domain|creative ?commons|cc0|cc[ -]by|permitted|rights reserved|waived|affero|endorse|disclaim|compiled binary"
#: Lines without such a word that may lie between two that have one, and that are taken along at either end of a paragraph.
GAP, MARGIN = 4, 2
#: Words that are no feature on their own.
COMMON = frozenset("a all an and are as at be by either for free form in into is it mit of on or published use any person nd not that the this to under was with without you 0 1 2 3 4".split())
FILLERS = "the river over market green walking number theory people often small light winter train paper answer question garden music table".split()
VARIANTS = 14
SALADS = 700
ORDER = 3
CONFIRM = 0.8
#: Probability below which the answer is unknown.
SURE = 0.5


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(words) - n + 1)}


def _matters(gram: str) -> bool:
    return any(w not in COMMON for w in gram.split(" ")) or "mit" in gram.split(" ") and " " in gram


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    grams: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Expected calibration error on the examples kept from training.
    error: float

    def probabilities(self, text: str) -> dict[str, float]:
        own = _ngrams(words_of(text))
        found = [self.weights[i] for i, g in enumerate(self.grams) if g in own]
        z = (self.bias + sum(found, np.zeros(len(self.classes))) / np.sqrt(max(len(found), 1))) / self.temperature
        p = np.exp(z - z.max())
        return dict(zip(self.classes, (p / p.sum()).tolist(), strict=True))


def _varied(rng: random.Random, own: list[str], words: list[str]) -> list[str]:
    """The words with others around them; of long ones sometimes only a part; some lost."""
    if len(own) > 12 and rng.random() < 0.5:
        size = rng.randrange(max(8, len(own) // 2), len(own) + 1)
        at = rng.randrange(len(own) - size + 1)
        own = own[at : at + size]
    if len(own) > 6 and rng.random() < 0.3:
        own = [w for w in own if rng.random() > 0.08]
    return rng.choices(words, k=rng.randrange(8)) + own + rng.choices(words, k=rng.randrange(8))


def examples(rng: random.Random, held: bool) -> list[tuple[list[str], str]]:
    """Word lists and classes: for training, or (held) of sentences, names and fillers that training does not see."""
    part = lambda v: [t for i, t in enumerate(v) if (i % 5 == 4) == held]
    fillers = FILLERS[14:] if held else FILLERS[:14]
    vocabulary = sorted({w for notices in TEMPLATES.values() for t in notices for w in words_of(t)})
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    count = max(2, VARIANTS // 4) if held else VARIANTS
    out = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            out += [(_varied(rng, words_of(notice), fillers) if i or held else words_of(notice), family) for i in range(count)]
        for _ in range(count):  # several paragraphs of one licence
            some = [w for t in rng.sample(notices, min(len(notices), rng.randrange(2, 4))) for w in words_of(t)]
            out.append((some, family))
    for sentences, label in ((OTHERS, UNKNOWN), (PLAIN, NONE)):
        out += [(_varied(rng, words_of(t), fillers) if i else words_of(t), label) for t in part(sentences) for i in range(count)]
    for _ in range(6 * count):
        made = rng.choice(["released under the {} license", "licensed under the {} {} license", "this work is licensed under the {} public license", "distributed under the terms of the {} licence version {}", "the {} license applies"])
        out.append((_varied(rng, words_of(made.format(name(), rng.choice([name(), "2", "3"]))), fillers), UNKNOWN))
    for i in range(SALADS // 5 if held else SALADS):
        known = rng.choices(vocabulary, k=rng.randrange(1, 8)) if i % 2 else [rng.choice(vocabulary)]
        salad = known + rng.choices(fillers, k=rng.randrange(2, 14))
        rng.shuffle(salad)
        out.append((salad, NONE))
    rng.shuffle(out)
    return out


def calibration_error(probability: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """Expected difference between the stated probability of the chosen class and how often it is right."""
    at = np.minimum((probability * bins).astype(int), bins - 1)
    return float(sum(abs(probability[at == b].mean() - right[at == b].mean()) * (at == b).mean() for b in set(at.tolist())))


@lru_cache(maxsize=1)
def train(seed: int = 3, steps: int = 160, penalty: float = 3e-4) -> Model:
    seen, kept = examples(random.Random(seed), False), examples(random.Random(seed + 1), True)
    classes = (NONE, UNKNOWN, *TEMPLATES)
    texts = [t for notices in TEMPLATES.values() for t in notices] + [t for v in (OTHERS, PLAIN) for i, t in enumerate(v) if i % 5 != 4]
    grams = tuple(sorted(g for g in set().union(*(_ngrams(words_of(t)) for t in texts)) if _matters(g)))
    at = {g: i for i, g in enumerate(grams)}

    def matrix(rows: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(grams)), np.float32)
        for r, (own, _) in enumerate(rows):
            x[r, [at[g] for g in _ngrams(own) if g in at]] = 1
        # Long paragraphs have many n-grams, each of which then counts for less.
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)), np.array([classes.index(c) for _, c in rows])

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    x, y = matrix(seen)
    w, b = np.zeros((len(grams), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    v, vb = w.copy(), b.copy()
    one = np.eye(len(classes), dtype=np.float32)[y]
    for _ in range(steps):
        e = (softmax(x @ w + b) - one) / len(x)
        v = 0.9 * v - 6.0 * (x.T @ e + penalty * w)
        vb = 0.9 * vb - 2.0 * e.sum(0)
        w, b = w + v, b + vb
    x, y = matrix(kept)
    logits = x @ w + b
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    grid = np.geomspace(0.02, 50, 161)
    best = int(np.argmin([loss(t) for t in grid]))
    if best in (0, len(grid) - 1):
        raise ValueError("the temperature lies on the bound of its grid")
    p = softmax(logits / grid[best])
    error = calibration_error(p.max(1), p.argmax(1) == y)
    return Model(classes, grams, w.astype(float), b.astype(float), float(grid[best]), error)


def _word_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _gram_column(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<string>"))


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (hash of the text), line (from 0), n_lines, whole, run and paragraph: paragraphs of lines near each other that have a word of STRONG (whole), and each such line."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    strong = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.lower(x).rlike(rf"(?:^|[^a-z0-9])(?:{STRONG})").alias("on"))), lambda s: s["on"]), lambda s: s["i"])
    # Whole texts without such a word are passed over before they are cut.
    rows = df.where(F.lower(text_col).rlike(rf"(?:^|[^a-z0-9])(?:{STRONG})")).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), lines.alias("lines")).withColumn("at", strong).where(F.size("at") > 0)
    size = F.size("at")
    far = lambda i, j: F.coalesce(F.get("at", j) - F.get("at", i) > GAP + 1, F.lit(True))
    numbers = F.sequence(F.lit(0), size - 1)
    first = F.transform(F.filter(numbers, lambda i: (i == 0) | far(i - 1, i)), lambda i: F.get("at", i))
    last = F.transform(F.filter(numbers, lambda i: (i == size - 1) | far(i, i + 1)), lambda i: F.get("at", i))
    rows = rows.withColumn("runs", F.arrays_zip(first.alias("first"), last.alias("last")))

    def text_of(r: Column) -> Column:
        begin = F.greatest(r["first"] - MARGIN, F.lit(0))
        return F.array_join(F.slice("lines", begin + 1, F.least(r["last"] + MARGIN, F.size("lines") - 1) - begin + 1), "\n")

    whole = F.transform("runs", lambda r: F.struct(r["first"].alias("line"), (r["last"] - r["first"] + 1).alias("n_lines"), F.lit(True).alias("whole"), r["first"].alias("run"), text_of(r).alias("paragraph")))
    run_of = lambda i: F.array_max(F.filter(F.col("runs.first"), lambda f: f <= i))
    single = F.transform("at", lambda i: F.struct(i.alias("line"), F.lit(1).alias("n_lines"), F.lit(False).alias("whole"), run_of(i).alias("run"), F.get("lines", i).alias("paragraph")))
    return rows.select("id", "t", F.inline(F.concat(whole, single)))


def classified(lines: DataFrame, model: Model) -> DataFrame:
    """paragraph, family, probability, similarity, confirmed for distinct paragraphs.

    similarity: largest share of a template's word pairs, of the predicted family, that the paragraph has; of a template of one word, its word. Equal
    probabilities go to the class that comes first.
    """
    spark = lines.sparkSession
    k = len(model.classes)
    weights = spark.createDataFrame([(g, *[float(v) for v in row]) for g, row in zip(model.grams, model.weights, strict=True)], "gram string, " + ", ".join(f"w{i} double" for i in range(k)))
    distinct = lines.select("paragraph").distinct().withColumn("words", _word_column(F.col("paragraph")))
    grams = F.array_distinct(F.concat(*[_gram_column(F.col("words"), n) for n in range(1, ORDER + 1)]))
    each = distinct.select("paragraph", F.explode(grams).alias("gram"))
    hit = each.join(F.broadcast(weights), "gram").groupBy("paragraph").agg(*[F.sum(f"w{i}").alias(f"z{i}") for i in range(k)], F.sqrt(F.count("*")).alias("n"))
    z = F.array(*[(F.col(f"z{i}") / F.col("n") + float(model.bias[i])) / model.temperature for i in range(k)])
    hit = hit.withColumn("z", z).withColumn("top", F.array_max("z"))
    hit = hit.select("paragraph", F.transform("z", lambda v: F.exp(v - F.col("top"))).alias("e"))
    hit = hit.withColumn("best", F.array_position("e", F.array_max("e")).cast("int")).withColumn("probability", F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    names = F.array(*[F.lit(c) for c in model.classes])
    hit = hit.select("paragraph", F.element_at(names, F.col("best")).alias("guess"), "probability")
    pairs = [(family, i, " ".join(p)) for family, notices in TEMPLATES.items() for i, t in enumerate(notices) for p in sorted(set(zip(words_of(t), words_of(t)[1:], strict=False)))]
    sizes = {(f, i): sum(p[0] == f and p[1] == i for p in pairs) for f, i, _ in pairs}
    template = spark.createDataFrame([(f, i, p, sizes[f, i]) for f, i, p in pairs], "family string, template int, gram string, size int")
    alike = each.join(F.broadcast(template), "gram").groupBy("paragraph", "family", "template").agg((F.count("*") / F.first("size")).alias("share"))
    alike = alike.groupBy("paragraph", "family").agg(F.max("share").alias("similarity"))
    known = F.when((F.col("guess") == NONE) | (F.col("probability") >= SURE), F.col("guess")).otherwise(UNKNOWN)
    out = hit.withColumn("family", known).join(alike, ["paragraph", "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.select("paragraph", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """A row for each paragraph that is found to state a licence: id, line (from 0), n_lines, paragraph, family, probability, similarity, confirmed.

    A paragraph is a line, or several lines near each other, each with a word of STRONG. A family is reported for every line whose template confirms it, and for
    the lines together if none of them has it. Lines together for which no family is confirmed are reported once, as unknown, unless they are of class none. Null
    and empty texts have none; repeated rows are reported once; an empty table gives an empty table. Texts are read whole, however long they are.
    """
    model = model or train()
    scratch = Scratch(df.sparkSession, "licences")
    found = scratch.write(paragraphs(df, id_col, text_col).distinct(), "paragraphs")
    judged = scratch.write(classified(found, model).where(F.col("family") != NONE), "found")
    rows = found.join(judged, "paragraph").withColumn("known", F.col("confirmed") & (F.col("family") != UNKNOWN))
    place = ["id", "t", "run"]
    own = rows.where("known and not whole").groupBy(*place).agg(F.collect_set("family").alias("own"))
    known = rows.where("known").groupBy(*place).agg(F.lit(True).alias("any_known"))
    same = lambda a: F.col("id").eqNullSafe(F.col(f"{a}_id")) & (F.col("t") == F.col(f"{a}_t")) & (F.col("run") == F.col(f"{a}_run"))
    renamed = lambda x, a: x.withColumnsRenamed({c: f"{a}_{c}" for c in place})
    rows = rows.join(renamed(own, "own"), same("own"), "left").join(renamed(known, "known"), same("known"), "left")
    extra = F.col("known") & (~F.col("whole") | ~F.coalesce(F.array_contains("own", F.col("family")), F.lit(False)))
    rows = rows.where(extra | F.col("whole") & F.col("any_known").isNull())
    return rows.select("id", "line", "n_lines", "paragraph", F.when(F.col("known"), F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", F.col("known").alias("confirmed"))


def per_document(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per id that states a licence: id, n_paragraphs, families (sorted, comma-joined), probability (the largest), confirmed (any)."""
    found = scan(df, id_col, text_col, model)
    return found.groupBy("id").agg(F.count("*").alias("n_paragraphs"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"), F.bool_or("confirmed").alias("confirmed"))
