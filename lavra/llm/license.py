"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of a document is hashed and joined to the pairs of the
license templates (a fixed table of a few hundred rows); a pair is a hit only if
its words are equal too. A hit votes for its diagonal, document position minus template position. Neighbouring diagonals are
merged, so that an inserted or dropped word doesn't break a match, and a merged
band is verified over its span: it is a match if its distinct template positions
cover enough of the template within a span not much longer than it. Where chance
hits have made the band longer, its best single diagonal is verified instead.

The short phrases are templates too; they need every pair on a single diagonal,
that is, their words stand consecutively.

Defined results: null and empty texts have no words, no labels and score 0;
very long texts are scanned whole; repeated rows and rows without doc_id are
scanned one by one; labels of equal cover are all given; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phrases that name a license.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening notices of public licenses.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "cc0": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
#: Bytes between words; the text is lower-cased before, so that A-Z don't occur.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this near to each other are one band; part of the template that a band must cover; longest span as a multiple of the template.
MERGE, COVER, STRETCH = 3, 0.6, 1.5


def templates() -> list[tuple[str, str, int, int]]:
    """(label, text, base, number of pairs) of phrases and notices."""
    rows = [(label, text, 1) for text, label in PHRASES.items()] + [(label, text, 0) for label, text in NOTICES.items()]
    return [(label, text, base, len(text.split()) - 1) for label, text, base in rows]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels and a score for each document.

    One pass over the texts: the first pair of every document is a marker that
    the template table also holds, so each document keeps a row that carries its
    word count through the join. `lower` also folds non-ASCII letters; that
    changes neither the number of words nor a phrase, as none holds a letter
    that such a fold can yield.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(t, label, base, pairs, i, a, b) for t, (label, text, base, pairs) in enumerate(templates()) for i, (a, b) in enumerate(zip(text.split(), text.split()[1:]))],
        "template int, label string, base int, pairs int, at int, a string, b string",
    ).withColumn("gram", F.xxhash64("a", "b"))
    marker = spark.createDataFrame([(-1, "", 0, 0, 0, "", "", 0)], table.schema)
    table = table.unionByName(marker)

    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), "")
    grams = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.struct(F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b"))))
    rows = (
        docs.select("doc_id", words.alias("words"))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.struct(F.lit(0).cast("long").alias("gram"), F.lit("").alias("a"), F.lit("").alias("b"))), grams).alias("grams"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "n_words", "row", F.posexplode("grams").alias("pos", "pair"))
        .select("doc_id", "n_words", "row", "pos", "pair.gram", "pair.a", "pair.b")
    )
    # The template table has a fixed size, far below any broadcast limit.
    hits = rows.join(F.broadcast(table), ["gram", "a", "b"]).filter("(template < 0) = (pos = 0)")
    hits = hits.withColumn("diagonal", F.when(F.col("template") < 0, 0).otherwise(F.col("pos") - 1 - F.col("at")))
    one = ["row", "doc_id", "n_words", "template", "label", "base", "pairs"]
    voted = hits.groupBy(*one, "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    # Phrases stay on their diagonal; notices join diagonals at most MERGE apart.
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("base") == 1, 0).otherwise(MERGE)).cast("int"), F.lit(0))
    bands = (
        voted.withColumn("gap", gap)
        .withColumn("band", F.sum("gap").over(by))
        .groupBy(*one, "band")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"), F.max(F.size("seen")).alias("best"))
        .withColumn("cover", F.when(F.col("template") < 0, 0.0).otherwise(F.col("covered") / F.col("pairs")))
    )
    place = (F.col("base") == 1) & (F.col("covered") == F.col("pairs"))
    own = (F.col("base") == 0) & (F.col("template") >= 0)
    straight = F.col("best") / F.col("pairs")
    in_span = own & (F.col("cover") >= COVER) & (F.col("high") - F.col("low") + 1 <= STRETCH * F.col("pairs"))
    share = F.when(in_span, F.col("cover")).when(own & (straight >= COVER), straight)
    notice = share.isNotNull()
    per_row = bands.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(place | notice, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(place, 1.0).when(notice, share)), F.lit(0.0)).alias("score"),
    )
    return per_row.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
