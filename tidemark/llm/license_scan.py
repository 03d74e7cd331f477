"""License scan by diagonal voting.

Texts and templates are read as lower-case words of letters and digits.  All rolling k-grams of
words of the texts are joined by hash to the places where templates hold them; each hit votes for
the diagonal (place in the text minus place in the template).  Votes are summed by diagonal, those of neighbouring
diagonals (an inserted or lost word moves the diagonal) together; of the hits of one place in the text the
one with most votes stays, so a phrase that a template repeats counts where the copy runs.  The hits of a template are then
read in the order of the text: while its places go on in order and gaps are no longer than GAP words they are one copy, on
however many diagonals, so words may be inserted anywhere.  A copy is verified: its hits must cover enough of the template's
words, and lie densely enough in the text.

Licenses quote each other.  Where copies of two templates share more than half of the shorter one's words in the text, the
one that covers more words stays, or as many words of a shorter template.

The templates are the paragraphs of short licenses and the notices of long ones, a fixed list of this module, or a
table of (label, text): a folder of license texts can be read with `templates_in`.  Their k-grams are counted, and
broadcast only if they are few; otherwise both sides are shuffled.

Beside the method, base places are counted: a phrase's words standing consecutively.

Cases: a null text is empty: no words, no places, labels ''.  Rows that repeat an id are judged
each by its own text (rows equal in both are equal in the result, too).  A null id is kept.  Very long texts are
read whole.  Of templates of one length that cover equally many words each gives its label.  No rows give no rows.  Extra columns
are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as kit
from .shared import bounded_broadcast, discard, each_batch, settle, small_batches

K = 3
#: Phrases whose places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording of public licenses and notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see http www gnu org licenses"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see http www gnu org licenses"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("reserved", "all rights reserved"),
)
#: Neighbouring diagonals differ by so many words at most; a copy has no gap of more than GAP words in the text.
BAND, GAP = 4, 40
#: Words of a text in a cell: copies that overlap are looked for in the cells that they share.
CELL = 256
#: A span is kept if its hits cover this share of the template (short ones share phrases with each other, so need
#: more) and are this dense in the text.
COVERED, COVERED_SHORT, SHORT_WORDS, DENSE = 0.5, 0.8, 20, 0.5


def _hashes(text: str) -> np.ndarray:
    return next(kit.blocks(pa.array([text]), kit.ALNUM_SPLIT, fold=True)).hashes


#: K-grams up to which the templates are broadcast.
BROADCAST_ROWS = 200_000


def listed(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """Templates of a list as a table of (label, text)."""
    return spark.createDataFrame([tuple(t) for t in templates], "label string, text string")


def templates_in(spark: SparkSession, path: str) -> DataFrame:
    """License texts as templates: each file is one, labelled by its name without the ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("label"), F.col("value").alias("text"))
    return files


def template_table(templates: DataFrame, k: int = K) -> DataFrame:
    """(gram, template, label, t_pos, t_words) for each place of a k-gram in a template; template is a hash of its text."""
    small_batches(templates.sparkSession)
    texts = templates.where("label is not null and text is not null").distinct()
    rows = texts.select(F.monotonically_increasing_id().alias("_id"), F.xxhash64("label", "text").alias("_text"), "label", "text")
    named = rows.select(F.col("_text").alias("template"), "label").distinct()
    grams = each_batch(lambda b: _grams(b, k), "_id long, _text long, pos int, gram long", rows.drop("label"))
    sized = grams.groupBy(F.col("_text").alias("template")).agg((F.max("pos") + k).alias("t_words"))
    return grams.select("gram", F.col("_text").alias("template"), F.col("pos").alias("t_pos")).join(sized, "template").join(named, "template").select("gram", "template", "label", "t_pos", "t_words")


def _grams(batch: pa.RecordBatch, k: int):
    ids, texts = batch.column("_id"), batch.column("_text")
    for words in kit.blocks(batch.column("text"), kit.ALNUM_SPLIT, fold=True):
        at = np.flatnonzero(kit.within(words.ptr, k))
        if not len(at):
            continue
        doc = np.searchsorted(words.ptr, at, side="right") - 1
        row = pa.array(doc + words.first)
        gram = kit.rolling(words.hashes, k, 41)[at].view(np.int64)
        yield pa.RecordBatch.from_arrays([ids.take(row), texts.take(row), pa.array((at - words.ptr[doc]).astype(np.int32)), pa.array(gram)], names=["_id", "_text", "pos", "gram"])


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, k: int = K) -> DataFrame:
    """Verified spans: (_id, _text, template, label, first_word, last_word, coverage), _text a hash of the text."""
    small_batches(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("text"))
    grams = each_batch(lambda b: _grams(b, k), "_id long, _text long, pos int, gram long", texts)
    known = settle(template_table(listed(docs.sparkSession) if templates is None else templates, k))
    hits = grams.join(bounded_broadcast(known, known.count(), BROADCAST_ROWS), "gram")
    copy = ["_id", "_text", "template"]
    of_copy = lambda *order: Window.partitionBy(*copy).orderBy(*order)
    # dealt once: all windows below are of a text and a template
    placed = hits.repartition(*copy).withColumn("diagonal", F.col("pos") - F.col("t_pos")).distinct()
    voted = placed.withColumn("votes", F.count(F.lit(1)).over(of_copy("diagonal").rangeBetween(-BAND, BAND)))
    at_place = Window.partitionBy(*copy, "pos").orderBy(F.desc("votes"), "t_pos")
    # a lone hit away from all others is noise, unless the template is short
    best = voted.withColumn("place", F.row_number().over(at_place)).where((F.col("place") == 1) & ((F.col("votes") > 1) | (F.col("t_words") < SHORT_WORDS)))
    before = lambda c: F.lag(c).over(of_copy("pos"))
    new = (F.col("t_pos") <= before("t_pos")) | (F.col("pos") - before("pos") > GAP)
    chained = best.withColumn("span", F.coalesce(new, F.lit(True)).cast("int")).withColumn("span", F.sum("span").over(of_copy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    # words of the template under hits: places p .. p+k-1, each once, as places go up
    step = F.least(F.col("t_pos") - F.lag("t_pos").over(Window.partitionBy(*copy, "span").orderBy("pos")), F.lit(k))
    merged = chained.withColumn("under", F.coalesce(step, F.lit(k))).groupBy(*copy, "label", "t_words", "span").agg(
        F.sum("under").alias("covered"), F.min("pos").alias("first_word"), (F.max("pos") + (k - 1)).alias("last_word")
    )
    length = F.col("last_word") - F.col("first_word") + 1
    verified = (
        merged.withColumn("coverage", F.col("covered") / F.col("t_words"))
        .where((F.col("coverage") >= F.when(F.col("t_words") < SHORT_WORDS, COVERED_SHORT).otherwise(COVERED)) & (F.col("covered") >= DENSE * length))
        .select(*copy, "label", "first_word", "last_word", "covered", "coverage")
    )
    spans = settle(verified)
    discard(known)
    return _widest(spans)


def _widest(spans: DataFrame) -> DataFrame:
    """The spans that share no more than half of the shorter one's words with a span that covers more
    words, or as many of a shorter template."""
    cells = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.expr(f"{a} div {CELL}"), F.expr(f"{b} div {CELL}"))))
    other = spans.select("_id", "_text", F.col("covered").alias("o_covered"), F.col("coverage").alias("o_coverage"), F.col("first_word").alias("o_first"), F.col("last_word").alias("o_last"))
    shared = F.least("last_word", "o_last") - F.greatest("first_word", "o_first") + 1
    shorter = F.least(F.col("last_word") - F.col("first_word"), F.col("o_last") - F.col("o_first")) + 1
    left, right = cells(spans, "first_word", "last_word"), cells(other, "o_first", "o_last").withColumnsRenamed({"_id": "o_id", "_text": "o_text", "cell": "o_cell"})
    same = F.col("_id").eqNullSafe(F.col("o_id")) & (F.col("_text") == F.col("o_text")) & (F.col("cell") == F.col("o_cell"))
    key = ["_id", "_text", "template", "first_word"]
    better = (F.col("o_covered") > F.col("covered")) | ((F.col("o_covered") == F.col("covered")) & (F.col("o_coverage") > F.col("coverage")))
    beaten = left.join(right, same & better & (2 * shared > shorter), "left_semi").select(*key).distinct()
    beaten = beaten.withColumnsRenamed({c: f"b_{c}" for c in key})
    match = F.col("_id").eqNullSafe(F.col("b__id"))
    for c in key[1:]:
        match = match & (F.col(c) == F.col(f"b_{c}"))
    return spans.join(beaten, match, "left_anti").drop("covered")


def _base_places(batch: pa.RecordBatch):
    phrases = [(_hashes(phrase), label) for phrase, label in BASE]
    for words in kit.blocks(batch.column("text"), kit.ALNUM_SPLIT, fold=True):
        h, docs = words.hashes, words.docs
        count = np.zeros(docs, dtype=np.int64)
        first, last = np.full(docs, np.iinfo(np.int64).max), np.full(docs, -1, dtype=np.int64)
        labels = [[] for _ in range(docs)]
        for phrase, label in phrases:
            m = len(phrase)
            if len(h) < m:
                continue
            same = kit.within(words.ptr, m)
            for j in range(m):
                same &= h[j : len(h) - m + 1 + j] == phrase[j]
            at = np.flatnonzero(same)
            doc = np.searchsorted(words.ptr, at, side="right") - 1
            place = at - words.ptr[doc]
            np.add.at(count, doc, 1)
            np.minimum.at(first, doc, place)
            np.maximum.at(last, doc, place)
            for d in np.unique(doc):
                labels[d].append(label)
        none = count == 0
        ids = pa.array(np.arange(words.first, words.first + docs))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id").take(ids),
                batch.column("_text").take(ids),
                pa.array(np.diff(words.ptr).astype(np.int64)),
                pa.array(count),
                pa.array(first, mask=none),
                pa.array(last, mask=none),
                pa.array(labels, pa.list_(pa.string())),
            ],
            names=["_id", "_text", "n_words", "n_base", "first_word", "last_word", "base"],
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word and last_word (of base places),
    base_labels, labels, score (1 with a base place, else the best coverage of a verified span, or 0)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("text"))
    facts = each_batch(_base_places, "_id long, _text long, n_words long, n_base long, first_word long, last_word long, base array<string>", texts)
    spans = license_spans(docs, id_col, text_col, templates).groupBy("_id", "_text").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    spans = spans.withColumnRenamed("_id", "span_id").withColumnRenamed("_text", "span_text")
    both = facts.join(spans, F.col("_id").eqNullSafe(F.col("span_id")) & (F.col("_text") == F.col("span_text")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("coverage", F.lit(0.0)))).alias("score"),
    )
