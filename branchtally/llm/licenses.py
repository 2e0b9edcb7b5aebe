"""License scan: fixed phrases, and license texts found by diagonal voting.

All runs of ``K`` words of every text are hashed and joined by Spark with the positions of the
same runs in the templates. A hit at text position p and template position t votes for the
diagonal p - t. Votes are summed by diagonal and neighbouring diagonals are merged: n inserted or
dropped words shift what follows by n, so the pieces of an edited notice follow one another on
diagonals n apart. Neighbours are at most ``NEAR`` apart, and at most half of the template's length,
so copies of a notice stay apart; any number of edits may follow one another. The union of the
merged pieces is verified by the share of the template's words that its hits cover.

Texts are named by two hashes of themselves, so copies of a text are voted on once and hits of a
hot text are combined before they move. The template table is small and fixed.

Defined cases: null and empty texts have no words; texts shorter than a run have only phrases;
empty tables give an empty result; repeated rows come out repeated; further columns are not read;
very long texts are hashed in slices, and their hits are counted by diagonal before they are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textnp import ALNUM, grouped, hash_words, shingles

#: Words of a run, the most that neighbouring diagonals are apart, the covered share that proves a text.
K, NEAR, COVER = 4, 32, 0.6
#: Neighbours of the shortest templates, of which half is less.
LEAST_NEAR = 3

# The phrases of the contract with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their licenses word them, each clause of the longer ones by itself.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "gpl-terms": "under the terms of the GNU General Public License",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "bsd-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: str) -> np.ndarray:
    return hash_words(text.encode().lower(), ALNUM)[1]


def _phrase_places(words: np.ndarray, phrases: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Starts of each phrase in a text's words."""
    out = {}
    for label, phrase in phrases.items():
        n = len(words) - len(phrase) + 1
        at = np.flatnonzero(words[:n] == phrase[0]) if n > 0 else np.zeros(0, np.int64)
        for i in range(1, len(phrase)):
            at = at[words[at + i] == phrase[i]]
        out[label] = at
    return out


def _read(k: int, wide: bool):
    """Per text its counts and phrases; or (``wide``) its two hashes and the runs' hashes."""
    phrases = {label: _words(phrase) for phrase, label in PHRASES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in grouped(batch.column("text")):
                at, hashes, _ = hash_words(data, ALNUM)
                texts = np.split(hashes, np.searchsorted(at, starts[1:]))
                rows = batch.slice(first, end - first)
                if wide:
                    runs = [shingles(words, k) for words in texts]
                    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(runs).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([rows.column("k1"), rows.column("k2"), column], names=["k1", "k2", "runs"])
                else:
                    yield _counted(rows, texts, phrases)

    return run


def _counted(rows: pa.RecordBatch, texts: list[np.ndarray], phrases: dict[str, np.ndarray]) -> pa.RecordBatch:
    n_base, first, last, labels = [], [], [], []
    for words in texts:
        places = _phrase_places(words, phrases)
        every = np.concatenate(list(places.values()))
        n_base.append(len(every))
        first.append(int(every.min()) if len(every) else None)
        last.append(int(every.max()) if len(every) else None)
        labels.append(sorted(label for label, at in places.items() if len(at)))
    columns = [
        rows.column("doc_id"), rows.column("k1"), rows.column("k2"), pa.array([len(w) for w in texts], pa.int64()), pa.array(n_base, pa.int64()),
        pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(labels, pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n_words", "n_base", "first_word", "last_word", "base"])


def template_runs(spark, k: int = K) -> DataFrame:
    """``run, template, tpos, length``: a few hundred rows."""
    rows = []
    for name, text in TEMPLATES.items():
        words = _words(text)
        rows += [(int(h), name, i, len(words)) for i, h in enumerate(shingles(words, k).view(np.int64))]
    return spark.createDataFrame(rows, "run bigint, template string, tpos int, length int")


def voted(runs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """``k1, k2, template, start, stop, cover``: verified spans of words; ``runs`` has k1, k2, runs."""
    hits = (
        runs.select("k1", "k2", F.posexplode("runs").alias("pos", "run"))
        .join(F.broadcast(templates), "run")  # a few hundred rows by construction
        .select("k1", "k2", "template", "length", "pos", "tpos")
        .distinct()  # copies of a text give the same hits
    )
    diagonals = (
        hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("k1", "k2", "template", "length", "diagonal")
        .agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.collect_set("tpos").alias("at"))  # at most the template's runs
    )
    # a new span begins where a diagonal is far from the one before
    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    near = F.greatest(F.lit(LEAST_NEAR), F.least(F.lit(NEAR), F.floor(F.col("length") / 2)))
    begins = (F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int")
    merged = (
        diagonals.withColumn("span", F.sum(F.coalesce(begins, F.lit(0))).over(order))
        .groupBy("k1", "k2", "template", "length", "span")
        .agg(F.min("start").alias("start"), (F.max("stop") + k).alias("stop"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    )
    words = F.flatten(F.transform("at", lambda t: F.sequence(t, t + k - 1)))
    cover = F.size(F.array_distinct(words)) / F.col("length")
    return merged.withColumn("cover", F.least(cover, F.lit(1.0))).where(F.col("cover") >= COVER).select("k1", "k2", "template", "start", "stop", "cover")


def scan(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document of ``doc_id, text``: the phrases, the voted labels and a score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = read.mapInArrow(
        _read(k, False), f"doc_id {id_type}, k1 bigint, k2 bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>"
    )
    runs = read.select("k1", "k2", "text").mapInArrow(_read(k, True), "k1 bigint, k2 bigint, runs array<bigint>")
    spans = voted(runs, template_runs(docs.sparkSession, k), k)
    by_text = spans.groupBy("k1", "k2").agg(
        F.collect_set("template").alias("voted"),  # at most one for each template
        F.max("cover").alias("cover"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "template", F.col("start").cast("string"), F.col("stop").cast("string")))), ",").alias("voted_spans"),
    )
    none = F.array().cast("array<string>")
    return base.join(by_text, ["k1", "k2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("voted", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
        F.coalesce("voted_spans", F.lit("")).alias("voted_spans"),
    )
