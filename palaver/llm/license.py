"""Licence scan: a trained paragraph classifier confirmed by templates.

Paragraphs are the \\n-separated lines of a text. A paragraph's features are its known word
1- to 3-grams (known from the templates), scaled to unit length, and the share of its words
that are known. Logistic regression over them, trained on the templates, on seeded
alterations of them, on paragraphs that use a licence's words without being one, and on a
bounded sample of the corpus's own lines, gives a probability for each family and for "no
licence"; a temperature fitted on alterations not trained on calibrates them. Every
paragraph with a known word is scored. A prediction is confirmed if enough of a template's
word 3-grams stand in the paragraph, or of the paragraph's in a template. A paragraph that
probably has a licence but whose family is not sure or not confirmed is ``unknown`` (one of
fewer than three words is then left out: too little stands in it to tell); its score is the probability of any licence, that of a named one the family's.

Defined results: a null or empty text has one empty paragraph and no licence. Rows are
scanned one by one, so repeated rows, null ids and extra columns do no harm. A long paragraph
needs memory in proportion to its length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import small_batches

UNKNOWN = "unknown"
#: Calibrated probability from which a family is named.
SURE = 0.6
#: Probability of "no licence" up to which a paragraph is reported at all.
NONE_MOST = 0.5
#: Share of common 3-grams that confirms a family.
CONFIRM = 0.5
DIM = 1 << 15
#: Bound on the corpus lines that are learned as having no licence (expected size of the hash sample).
BACKGROUND_ROWS = 4_000
#: Shares of known words are features in steps of a quarter.
_SHARES = 5

#: Notices of licence families (fixed values: short public forms, one per line).
TEMPLATES = {
    "MIT": """Released under the MIT License.
Licensed under the MIT license. See the LICENSE file in the project root for full license information.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
SPDX-License-Identifier: MIT
MIT License
License: MIT
The MIT License (MIT)
MIT licensed
This project is available under the terms of the MIT license
The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement
In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied
SPDX-License-Identifier: Apache-2.0
Apache 2.0
Apache License 2.0
License: Apache-2.0
Apache License Version 2.0, January 2004
This project is available under the Apache 2.0 license
Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the Work and such derivative works in source or object form
each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work
You must give any other recipients of the Work or derivative works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files
See the License for the specific language governing permissions and limitations under the License""",
    "GPL": """This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details
Released under the GNU General Public License, version 2.
SPDX-License-Identifier: GPL-3.0-or-later
GPLv3
GPLv2
GPL-3.0
License: GPL
GNU General Public License
This project is available under the GPL version 3
You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed
You may convey verbatim copies of the program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice""",
    "LGPL": """Licensed under the GNU Lesser General Public License, version 3.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation
SPDX-License-Identifier: LGPL-2.1-or-later
LGPLv3
LGPL-2.1
GNU LGPL v3
GNU Lesser General Public License
License: LGPL
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation""",
    "AGPL": """Licensed under the GNU Affero General Public License, version 3.
You should have received a copy of the GNU Affero General Public License along with this program
SPDX-License-Identifier: AGPL-3.0-only
AGPLv3
AGPL-3.0
GNU AGPL v3
GNU Affero General Public License
License: AGPL
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation""",
    "BSD": """Licensed under the BSD 3-Clause License.
Released under the BSD 2-Clause License.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file
SPDX-License-Identifier: BSD-3-Clause
BSD 3-Clause
BSD 2-Clause
BSD license
License: BSD
New BSD License
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed
In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/
Licensed under the Mozilla Public License, version 2.0.
SPDX-License-Identifier: MPL-2.0
MPL 2.0
License: MPL-2.0
Mozilla Public License Version 2.0""",
    "CC-BY": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
CC BY 4.0
CC-BY-4.0
License: CC BY
Creative Commons Attribution 4.0 International
Available under a Creative Commons Attribution license""",
    "CC-BY-SA": """Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License
CC BY-SA 4.0
CC-BY-SA-4.0
License: CC BY-SA
Creative Commons Attribution-ShareAlike 4.0 International""",
    "CC-BY-NC": """Licensed under CC BY-NC 4.0.
Licensed under CC BY-NC-SA 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
CC BY-NC 4.0
CC-BY-NC-4.0
License: CC BY-NC
Creative Commons Attribution-NonCommercial 4.0 International""",
    "CC0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work
Released under CC0 1.0 Universal public domain dedication.
This is free and unencumbered software released into the public domain
CC0 1.0
CC0
License: CC0
Creative Commons Zero
Dedicated to the public domain
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
Licensed under the ISC License.
ISC License
License: ISC
The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness""",
}
#: Paragraphs that use a licence's words without being one (fixed values).
OTHERS = """The driver showed a valid license and the registration of the car.
Copyright law protects works of authors for a limited time.
The software was free of charge for any person who asked.
A general public meeting was held in the hall at noon.
This work was published by the foundation in its third version.
You may obtain a copy of the minutes from the office.
The commons were open to all, without restriction.
The library is open to the public under the terms of the lease.
The file is in the root of the project, with more details in the source.
He released the dog under the table.
The patient was licensed under the state law to drive at night.
The pilot was licensed under the rules of the authority.
The notice was released under the name of the holder.
The general sold the source of the water to the public.
In no event shall the meeting start before noon.
The sale was made without warranty, as the car was old.
The contributors were free to use the hall for any purpose.
You should have received a letter from the office.
Everyone is permitted to enter the library with a copy of the card.
The foundation published a version of the work in January.
The author and the holders of the rights met to make a contract.
The terms of the lease are available in the office."""
#: Licence paragraphs of no family above; they calibrate the unknown class (fixed values).
FOREIGN = """Licensed under the Example Company Source License, version 1.
All rights reserved. No part of this work may be reproduced without written permission of the publisher.
This software is licensed under the terms of the commercial license agreement that came with it.
Use of this data is subject to the license terms of the provider.
Released under the Open Data Licence, version 1.0.
This document is licensed for internal use only; redistribution is not permitted."""

_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


@functools.cache
def _vocabulary() -> dict[str, int]:
    text = "\n".join([*TEMPLATES.values(), OTHERS, FOREIGN]).lower()
    return {w: i + 1 for i, w in enumerate(sorted(set(_WORD.findall(text))))}


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(ids: np.ndarray) -> np.ndarray:
    """Distinct hashed 1- to 3-grams of known words (0 stands for an unknown word)."""
    out = [np.empty(0, np.int64)]
    for n in range(1, 4):
        m = len(ids) - n + 1
        if m <= 0:
            break
        h, known = np.full(m, n, np.uint64), np.ones(m, bool)
        for i in range(n):
            part = ids[i : m + i]
            known &= part > 0
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            h ^= h >> np.uint64(29)
        out.append((h[known] % np.uint64(DIM - _SHARES)).astype(np.int64))
    share = int((_SHARES - 1) * np.count_nonzero(ids) / max(len(ids), 1))
    return np.unique(np.concatenate([*out, [DIM - _SHARES + share]]))


def word_ids(paragraph: str) -> np.ndarray:
    known = _vocabulary()
    return np.array([known.get(w, 0) for w in words(paragraph)], np.int64)


def _altered(rng: np.random.Generator, paragraph: str) -> str:
    """A variant: some words lost, others put in, a part cut off, text around it."""
    ws = paragraph.split()
    keep = rng.random(len(ws)) >= rng.choice([0.0, 0.05, 0.1])
    ws = [w for w, k in zip(ws, keep) if k] or ws
    if len(ws) > 14 and rng.random() < 0.4:
        lo = int(rng.integers(0, len(ws) - 10))
        ws = ws[lo : lo + int(rng.integers(10, len(ws)))]
    for _ in range(int(rng.integers(0, 3))):
        ws.insert(int(rng.integers(0, len(ws) + 1)), f"x{rng.integers(10**6)}")
    return " ".join(ws)


@dataclass
class Model:
    names: list[str]  # families and the unknown class; one more class is "no licence"
    weights: np.ndarray  # [classes, DIM + 1]
    temperature: float

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """[paragraph, class]; the last class is "no licence"."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        start = np.cumsum(size) - size  # no row is empty: the share of known words is always there
        z = np.add.reduceat(self.weights.T[np.concatenate(rows)], start, axis=0) / np.sqrt(size)[:, None] + self.weights[:, -1]
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def verdicts(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(no licence), the best family's probability and its index, of each paragraph."""
        p = np.concatenate([self.probabilities(rows[at : at + 512]) for at in range(0, len(rows), 512)])
        family = p[:, :-1].argmax(axis=1)
        return p[:, -1], p[np.arange(len(p)), family], family


@functools.lru_cache(2)
def fit(lines: tuple[str, ...] = (), seed: int = 5, copies: int = 7, rounds: int = 100) -> Model:
    """Train on the templates, their alterations and ``lines`` without a licence; the temperature
    on alterations not trained on and on a fifth of the lines, kept for that."""
    rng = np.random.default_rng(seed)
    learned = TEMPLATES | {UNKNOWN: FOREIGN}
    names = list(learned)

    def drawn(n: int, more: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
        rows, y = [], []
        for c, text in enumerate(learned.values()):
            for line in text.split("\n"):
                for v in [line, *(_altered(rng, line) for _ in range(n))]:
                    rows.append(grams(word_ids(v)))
                    y.append(c)
        vocabulary = list(_vocabulary())
        for w in vocabulary:  # one known word among unknown ones ("mit" is German, too), or a known one in a name
            at = int(rng.integers(0, 6))
            rows.append(grams(word_ids(" ".join(["xq"] * at + [w] + ["xq"] * (6 - at)))))
            y.append(len(names))
        for line in OTHERS.split("\n"):
            for v in [line, *(_altered(rng, line) for _ in range(n))]:
                rows.append(grams(word_ids(v)))
                y.append(len(names))
        for line in more:
            rows.append(grams(word_ids(line)))
            y.append(len(names))
        for _ in range(20 * n):  # known words in no order, among unknown ones
            picked = rng.choice(vocabulary, int(rng.integers(0, 30)))
            rows.append(grams(word_ids(" ".join(w if rng.random() < 0.5 else "xq" for w in picked))))
            y.append(len(names))
        return rows, np.array(y)

    def matrix(rows: list[np.ndarray], used: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(used) + 1), np.float32)
        for i, r in enumerate(rows):
            at = np.searchsorted(used, r)
            ok = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == r)
            x[i, at[ok]] = 1 / max(len(r), 1) ** 0.5
        x[:, -1] = 1
        return x

    rows, y = drawn(copies, tuple(x for i, x in enumerate(lines) if i % 5))
    used = np.unique(np.concatenate(rows))
    x = matrix(rows, used)
    target = np.eye(len(names) + 1, dtype=np.float32)[y]
    balance = (1 / np.bincount(y, minlength=len(names) + 1))[y][:, None].astype(np.float32)
    balance *= len(y) / balance.sum()
    w = look = np.zeros((len(names) + 1, x.shape[1]), np.float32)
    t = 1.0
    for _ in range(rounds):
        z = x @ look.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = look - 2.0 * (((p - target) * balance).T @ x / len(y) + 1e-5 * look)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = np.zeros((len(names) + 1, DIM + 1), np.float32)
    weights[:, used], weights[:, -1] = w[:, :-1], w[:, -1]
    model = Model(names, weights, 1.0)
    rows, y = drawn(3, lines[::5])
    raw = np.log(model.probabilities(rows) + 1e-12)

    def loss(temperature: float) -> float:
        z = raw / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return model


def _trigrams(ws: list[str]) -> set[tuple[str, ...]]:
    return set(zip(ws, ws[1:], ws[2:])) if len(ws) > 2 else {tuple(ws)} if ws else set()


@functools.cache
def _template_grams() -> dict[str, list[set]]:
    return {name: [_trigrams(words(line)) for line in text.split("\n")] for name, text in TEMPLATES.items()}


def similarity(paragraph: str, name: str) -> float:
    """Greatest share of a template's 3-grams in the paragraph, or of its 3-grams in a template.

    Of fewer than three words all must be a template.
    """
    own = _trigrams(words(paragraph))
    if not own:
        return 0.0
    if len(next(iter(own))) < 3:
        return float(own in _template_grams()[name])
    return max(max(len(own & t) / len(t), len(own & t) / len(own)) for t in _template_grams()[name])


#: Usual words of notices (fixed values). They gate nothing; with ``cued`` one can tell how
#: much is found without them.
CUES = ("licen", "copyright", "permission", "permitted", "redistribut", "public domain", "spdx", "warranty", "rights")


def cued(text: str) -> bool:
    text = text.lower()
    return any(cue in text for cue in CUES)


def like_notice(paragraph: str) -> bool:
    """Whether a word 3-gram of the paragraph stands in a written notice: not to be learned as free of licences."""
    return not _notice_grams().isdisjoint(_trigrams(words(paragraph)))


@functools.cache
def _notice_grams() -> frozenset[tuple[str, ...]]:
    lines = "\n".join([*TEMPLATES.values(), FOREIGN]).split("\n")
    return frozenset().union(*(_trigrams(words(line)) for line in lines))


def scan(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, int, str, float, float, bool]]]:
    """Paragraphs, and (paragraph, start, length, family, score, similarity, confirmed) of those with a licence."""
    paragraphs = (text or "").split("\n")
    found, start = [], 0
    picked, rows = [], []
    for i, paragraph in enumerate(paragraphs):
        ids = word_ids(paragraph)
        if ids.any():
            picked.append((i, start, paragraph))
            rows.append(grams(ids))
        start += len(paragraph) + 1
    if rows:
        none, best, family = model.verdicts(rows)
        for k in np.flatnonzero(none <= NONE_MOST):
            i, at, paragraph = picked[k]
            name = model.names[family[k]]
            like = similarity(paragraph, name) if name != UNKNOWN else 0.0
            confirmed = bool(best[k] >= SURE and like >= CONFIRM)
            if not confirmed and len(words(paragraph)) < 3:
                continue
            score = best[k] if confirmed else 1 - none[k]
            found.append((i, at, len(paragraph), name if confirmed else UNKNOWN, float(score), like, confirmed))
    return len(paragraphs), found


def background(docs: DataFrame, rows: int = BACKGROUND_ROWS) -> list[str]:
    """About ``rows`` lines of the corpus, by a hash, that have no word 3-gram of a notice."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).where(F.char_length(F.trim("line")) > 0)
    share = min(1.0, rows / max(lines.count(), 1))
    chosen = lines.where(F.pmod(F.xxhash64("line"), F.lit(1_000_000)) < int(1_000_000 * share)).distinct()
    return sorted(r.line for r in chosen.collect() if not like_notice(r.line))


def scan_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs and ``found``, the licence paragraphs, for every row."""
    small_batches(docs.sparkSession, 1000)
    model = model or fit(tuple(background(docs)))
    schema = "n_paragraphs long, found array<struct<paragraph:long,start:long,length:long,license:string,score:double,similarity:double,confirmed:boolean>>"
    names = ("paragraph", "start", "length", "license", "score", "similarity", "confirmed")

    @F.pandas_udf(schema)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [scan(t, model) for t in batch]
            yield pd.DataFrame(
                {"n_paragraphs": [r[0] for r in rows], "found": [[dict(zip(names, f)) for f in r[1]] for r in rows]}
            )

    return docs.select("doc_id", scanned("text").alias("_s")).select("doc_id", "_s.*")
