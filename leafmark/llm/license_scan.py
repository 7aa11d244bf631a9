"""License scans (10): a positional rare-token index, in DataFrame and SQL functions only.

Each template is a list of words with places, a label and a key phrase that must stand in full: the wording of licences' notices
and grants, and short statements of a licence. One pass over the texts finds the words, and keeps, for each row, which words of the
index's vocabulary it has, and its words in order if one of them can open a lookup. Over all documents, each
vocabulary word gets an IDF (COMMON ones weigh nothing). A file's rare words are looked up: a template is
looked up by the word of its key phrase with the highest IDF, whose posting (template, offset) at place p
proposes that the template starts at p - offset; the template's other postings are then intersected with the words at their places from there.
A start counts if the key phrase stands there in full and matched words hold at least LEAST of the template's IDF.
As no start counts without the rare word, the lookup loses none, whatever else the file holds.
Base phrases are templates whose every word is key; all their places count. The score is the largest share of a template that stands, 1 for a base phrase.

The index is a constant of the plan, of a size that the templates fix. What is shuffled are counts of vocabulary words; rows never are, so a file full of
licence words is work for its own row alone (as many lookups as it has rare words), and a licence that every file has is spread like the files.

Defined cases: null or empty text has no words and no labels; rows that repeat an id are rows of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common

#: Phrase and label; fixed.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Template, key phrase, label; fixed: wording of public licences, in lower case and without marks.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license version", "lesser general public license", "lgpl"),
    ("gnu affero general public license version", "affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution license", "creative commons attribution", "cc-by"),
    ("released under the mit license", "mit license", "mit"),
    ("bsd 2 clause license", "bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause license", "bsd 3 clause", "bsd-3-clause"),
    ("mozilla public license version 2 0", "mozilla public license", "mpl"),
    ("dedicated to the public domain", "the public domain", "public-domain"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "distribute this software for any purpose with or without fee is hereby granted", "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms with or without modification are permitted", "bsd",
    ),
    (
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause",
    ),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2 of the license", "gpl-2.0",
    ),
    (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license as published by the free software foundation", "lgpl",
    ),
    (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license as published by the free software foundation", "agpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "subject to the terms of the mozilla public license v 2 0", "mpl",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        "free and unencumbered software released into the public domain", "unlicense",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        "any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "in no event will the authors be held liable for any damages arising from the use of this software", "zlib",
    ),
    (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights", "cc0",
    ),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "cc-by-nc"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "the eclipse public license", "epl"),
)
#: Weigh nothing and open no lookup; they have postings where a key phrase needs them.
COMMON = frozenset("a all and any are as at be by can do for has if in is it its may no nor not of on one or so that the this to use was whom will with you your".split())
LEAST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings() -> list[tuple[int, str, int, str, bool, bool]]:
    """(template, label, offset, word, whether the word is key, whether it is a base phrase)."""
    out = []
    for t, (phrase, key, label) in enumerate([(p, p, x) for p, x in BASE] + list(TEMPLATES)):
        words, keys = phrase.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(keys)] == keys)
        for i, w in enumerate(words):
            is_key = first <= i < first + len(keys)
            if is_key or w not in COMMON:
                out.append((t, label, i, w, is_key, t < len(BASE)))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, n_words, n_base, first_word, last_word, base_labels, labels, score): a row for each document."""
    index = postings()
    vocabulary = {p[3] for p in index}
    telling, opening = sorted(vocabulary - COMMON), sorted({p[3] for p in index if p[4]} - COMMON)
    # lower() is A-Z for what can become ASCII, but for the Kelvin sign
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\ua7b1")))
    found = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)).alias("words"))
    found = found.withColumn("has", F.array_distinct(F.filter("words", lambda w: w.isin(telling))))
    opens = F.exists("has", lambda w: w.isin(opening))
    rows = common.written(found.select("id", F.size("words").cast("long").alias("n_words"), "has", F.when(opens, F.col("words")).alias("words")), "license-words")
    # at most one row for each word of the vocabulary
    n_docs = rows.count()
    df = rows.select(F.explode("has").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in df.collect()}
    idf = {w: 0.0 if w in COMMON else math.log((n_docs + 1.0) / (seen.get(w, 0) + 1.0)) + 1.0 for w in vocabulary}
    templates = [[p for p in index if p[0] == t] for t in range(index[-1][0] + 1)]
    rare = [max((idf[p[3]], p[3]) for p in of if p[4])[1] for of in templates]
    struct = lambda **c: F.struct(*[F.lit(v).alias(k) for k, v in c.items()])
    lookups = F.array(*[struct(template=p[0], offset=p[2], word=p[3]) for of, word in zip(templates, rare, strict=True) for p in of if p[3] == word])
    of_template = F.array(*[struct(label=of[0][1], is_base=of[0][5], keys=sum(p[4] for p in of), all_idf=sum(idf[p[3]] for p in of)) for of in templates])
    of_postings = F.array(*[F.array(*[struct(offset=p[2], word=p[3], is_key=p[4], idf=idf[p[3]]) for p in of]) for of in templates])

    rares = sorted(set(rare))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rares), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    proposed = F.flatten(F.transform(places, lambda x: F.transform(F.filter(lookups, lambda p: p["word"] == x["word"]), lambda p: F.struct(p["template"].alias("template"), (x["at"] - p["offset"]).alias("start")))))

    def intersected(c: Column) -> Column:
        """Key words and IDF of the template's postings that hold at its start."""
        at = lambda p: F.get(F.col("words"), c["start"] + p["offset"])
        held = F.filter(F.get(of_postings, c["template"]), lambda p: (c["start"] + p["offset"] >= 0) & (at(p) == p["word"]))
        none = F.struct(F.lit(0).alias("keys"), F.lit(0.0).alias("idf"))
        total = F.aggregate(held, none, lambda a, p: F.struct((a["keys"] + p["is_key"].cast("int")).alias("keys"), (a["idf"] + p["idf"]).alias("idf")))
        return F.struct(c["start"].cast("long").alias("start"), F.get(of_template, c["template"]).alias("of"), total.alias("total"))

    share = lambda x: F.when(x["of"]["is_base"], 1.0).otherwise(F.least(x["total"]["idf"] / x["of"]["all_idf"], F.lit(1.0)))
    good = F.filter(F.transform(F.array_distinct(proposed), intersected), lambda x: (x["total"]["keys"] == x["of"]["keys"]) & (share(x) >= LEAST))
    out = rows.select("id", "n_words", F.when(F.col("words").isNotNull(), good).alias("good"))
    base = F.transform(F.filter("good", lambda x: x["of"]["is_base"]), lambda x: x["start"])
    labels = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce(F.array_size(base), F.lit(0)).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        labels(F.transform(F.filter("good", lambda x: x["of"]["is_base"]), lambda x: x["of"]["label"])).alias("base_labels"), labels(F.transform("good", lambda x: x["of"]["label"])).alias("labels"),
        F.coalesce(F.round(F.array_max(F.transform("good", share)), 6), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


_TEXTS = ",\n  ".join(f"({t}, '{phrase}', '{key}', '{label}')" for t, (phrase, key, label) in enumerate([(p, p, x) for p, x in BASE] + list(TEMPLATES)))
_COMMON = ", ".join(f"'{w}'" for w in sorted(COMMON))
#: Over duckdb's views of the same tables; from the templates' texts and the definition: a template stands where its key phrase stands in full and
#: words that hold half of its IDF are at their places.
SQL = rf"""
WITH texts(template, phrase, key, label) AS (VALUES
  {_TEXTS}
), split AS (
  SELECT *, string_split(phrase, ' ') AS p, string_split(key, ' ') AS q, template < 4 AS is_base,
         len(string_split(trim(substr(phrase, 1, strpos(' ' || phrase || ' ', ' ' || key || ' ') - 1)), ' ')) - CASE WHEN starts_with(phrase || ' ', key || ' ') THEN 1 ELSE 0 END AS first
  FROM texts
), every AS (SELECT template, label, is_base, first, len(q) AS all_keys, generate_subscripts(p, 1) - 1 AS off, unnest(p) AS word FROM split),
idx AS (SELECT *, off >= first AND off < first + all_keys AS is_key FROM every WHERE word NOT IN ({_COMMON}) OR (off >= first AND off < first + all_keys)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
w AS (SELECT rid, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM d),
hits AS (SELECT * FROM w WHERE word IN (SELECT word FROM idx)),
idf AS (SELECT word, ln(((SELECT count(*) FROM d)::DOUBLE + 1) / (count(DISTINCT rid)::DOUBLE + 1)) + 1 AS idf FROM hits WHERE word NOT IN ({_COMMON}) GROUP BY word),
weighed AS (SELECT idx.*, coalesce(idf, CASE WHEN word IN ({_COMMON}) THEN 0 ELSE ln((SELECT count(*) FROM d)::DOUBLE + 1) + 1 END) AS idf FROM idx LEFT JOIN idf USING (word)),
whole AS (SELECT template, sum(idf) AS all_idf FROM weighed GROUP BY template),
near AS (SELECT DISTINCT rid, template FROM hits JOIN weighed USING (word) WHERE is_key AND word NOT IN ({_COMMON})),
placed AS (
  SELECT hits.rid, weighed.template, label, is_base, all_keys, pos - off AS start, sum(idf) AS idf, count(*) FILTER (is_key) AS keys
  FROM hits JOIN weighed USING (word) JOIN near ON near.rid = hits.rid AND near.template = weighed.template GROUP BY ALL
), good AS (
  SELECT placed.*, placed.idf / all_idf AS share FROM placed JOIN whole USING (template)
  WHERE keys = all_keys AND (is_base OR placed.idf / all_idf >= {LEAST})
), by_row AS (
  SELECT rid, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(CASE WHEN is_base THEN 1 ELSE least(share, 1) END) AS score
  FROM good GROUP BY rid
)
SELECT doc_id, len(l) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(round(score, 6), 0) AS score
FROM d LEFT JOIN by_row USING (rid)
"""
