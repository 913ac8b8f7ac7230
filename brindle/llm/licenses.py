"""License scan by sentence rules.

A text's sentences are normalised (lower case, letters and digits with single
spaces) and mapped to the identifiers of known license sentences. The sequence
of identifiers is matched against rules in order: a rule that matches takes its
sentences, so that later, more general rules see only the rest. Other text may
stand between the sentences of a rule. All of it is built-in functions.

Defined results: a null or empty text has no sentences; repeated rows each get
their row; a null doc_id is kept; texts are scanned whole; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import text_or_empty

#: Sentences as public licenses and their usual notices word them, normalised.
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-2.0-may-not": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "apache-2.0-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-3.0-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "mpl-2.0-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2.0-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-4.0-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4.0-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "rights": "all rights reserved",
    "gpl-2-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl-2-only-as": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-3-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "lgpl-2.1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-3-library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl-2.0-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "bsl-1.0": "distributed under the boost software license version 1 0",
}
#: Identifiers that a line of its own may name.
TAGS = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
SENTENCES |= {f"tag-{t}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", t.lower()) for t in TAGS}
#: Rules in order: license, and the sentences that must follow each other.
RULES = (
    ("Apache-2.0", ("apache-2.0-notice-the", "apache-2.0-may-not", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl-3-only-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-only", ("gpl-2-only-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-only", ("gpl-2-only-as", "gpl-hope", "gpl-details")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-3-library", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope", "lgpl-details")),
    ("MPL-2.0", ("mpl-2.0-form", "mpl-2.0-copy")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("Apache-2.0", ("apache-2.0-notice-the",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-only", ("gpl-3.0-work",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-only-free",)),
    ("GPL-2.0-only", ("gpl-2-only-free",)),
    ("GPL-2.0-only", ("gpl-2-only-as",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0-or-later", ("agpl-details",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-library",)),
    ("LGPL", ("lgpl-details",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl-2.0-terms",)),
    ("BSL-1.0", ("bsl-1.0",)),
    ("MPL-2.0", ("mpl-2.0-form",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-work",)),
    ("CC-BY-4.0", ("cc-by-4.0",)),
    ("CC-BY-4.0", ("cc-by-4.0-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-work",)),
    ("CC0-1.0", ("cc0",)),
    *[(t, (f"tag-{t}",)) for t in TAGS],
    ("all-rights-reserved", ("rights",)),
)
#: Every known sentence has one of these; sentences without are not normalised.
ANCHORS = r"(?i)licen[sc]e|permi(?:ssion|tted)|warrant|copyright|redistribut|rights|public domain|mpl"
#: Ends of sentences; a list's colon and semicolon end one too.
ENDS = r"(?<=[.!?:;])\s+|\n[\x20\t\r]*\n"
#: Sentences whose usual wording has such an end inside ("free software; you can", "License, v. 2.0"), and what a text with one holds.
CUT = ("gpl-free", "gpl-2-free", "gpl-hope", "mpl-2.0-form", "gpl-2-only-free", "gpl-2-only-as", "gpl-3-only-free", "agpl-free", "lgpl-2.1-free", "lgpl-3-free", "lgpl-3-library", "lgpl-hope")
CUT_CUE = r"(?i)free[\W_]+software[\W_]+foundation|without[\W_]+any[\W_]+warranty|mozilla[\W_]+public"
#: Pieces of them at most.
CUT_PIECES = 3

#: What is put in order before a text is cut into sentences: a line of comment marks alone is a blank line; the name that a
#: sentence leaves open, which may hold a full stop, is the one of the known sentence; a tag and its colon belong to one line.
PREPARED = (
    (r"\n[\x20\t]*(?:/\*+|\*+/?|/+|#+|;+|--+)[\x20\t\r]*\n", "\n\n"),
    (r"(?is)neither[\W_]+the[\W_]+names?[\W_]+of\b.{1,120}?\bnor[\W_]+the[\W_]+names[\W_]+of[\W_]+(?:its|any|other|the|their)\b", "neither the name of the copyright holder nor the names of its"),
    (r"(?i)spdx-license-identifier:", "spdx-license-identifier "),
)


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", F.lit(" ")))


def _named(sentence: Column, names: Iterable[str] = tuple(SENTENCES)) -> Column:
    """Identifier of a normalised sentence among ``names``, or null."""
    known = F.array(*[F.lit(SENTENCES[n]) for n in names])
    return F.get(F.array(*[F.lit(n) for n in names]), F.array_position(known, sentence).cast("int") - 1)


def _identified(s: Column) -> Column:
    """Identifier of a sentence, or null."""
    return _named(normal(s))


def _whole(pieces: Column, alone: Callable[[Column], Column]) -> Column:
    """Identifiers for each piece of a text: those of CUT stand at the first of their pieces, other pieces are looked at ``alone``."""
    empty = F.expr("cast(array() as array<string>)")
    start = lambda norm, n: F.transform(norm, lambda _, i: _named(F.array_join(F.slice(norm, i + 1, F.lit(n)), " "), CUT))

    def placed(x: Column) -> Column:
        runs = [x[f"run{n}"] for n in range(2, CUT_PIECES + 1)]
        inside = lambda i: reduce(or_, [F.get(run, i - k).isNotNull() for n, run in enumerate(runs, 2) for k in range(1, n)])
        found = lambda i: F.coalesce(*[F.get(run, i) for run in runs])
        return F.transform(pieces, lambda s, i: F.when(found(i).isNotNull(), F.array(found(i))).when(inside(i), empty).otherwise(alone(s)))

    runs = lambda norm: F.struct(*[start(norm, n).alias(f"run{n}") for n in range(2, CUT_PIECES + 1)])
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return once(once(F.transform(pieces, normal), runs), placed)


def prepared(text: Column) -> Column:
    out = text
    for pattern, to in PREPARED:
        out = F.regexp_replace(out, pattern, F.lit(to))
    return F.when(text.rlike(ANCHORS), out).otherwise(text)


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences, in the text's order.

    A sentence may run over lines; one that is not known as a whole is looked at
    line by line, as notices often stand on a line without a full stop before.
    Pieces that ENDS makes of a known sentence count as that sentence.
    """
    anchored = lambda s: s.rlike(ANCHORS)
    empty = F.expr("cast(array() as array<string>)")
    by_line = lambda s: F.transform(F.filter(F.split(s, "\n"), anchored), _identified)
    found = F.transform(F.filter(F.split(text, ENDS), anchored), lambda s: F.coalesce(F.transform(F.filter(F.array(_identified(s)), lambda x: x.isNotNull()), lambda x: x), F.array()))
    found = F.zip_with(F.filter(F.split(text, ENDS), anchored), found, lambda s, ids: F.when(F.size(ids) > 0, ids).otherwise(by_line(s)))
    alone = lambda s: F.when(~anchored(s), empty).when(_identified(s).isNotNull(), F.array(_identified(s))).otherwise(by_line(s))
    found = F.when(text.rlike(CUT_CUE), _whole(F.split(text, ENDS), alone)).otherwise(found)
    return F.when(text.rlike(ANCHORS), F.filter(F.flatten(found), lambda x: x.isNotNull())).otherwise(empty)


def licenses(ids: Column) -> Column:
    """Licenses that the ordered rules find in a sequence, in the order of the rules, once for each match."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("seq")) for name, seq in RULES])
    text = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    times = lambda rest, seq: ((F.length(rest) - F.length(F.replace(rest, seq, F.lit("")))) / F.length(seq)).cast("int")
    start = F.struct(text.alias("rest"), F.expr("cast(array() as array<string>)").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        n = times(acc["rest"], rule["seq"])
        # what is taken stays as a gap, so that its neighbours do not become one sequence
        return F.struct(F.replace(acc["rest"], rule["seq"], F.lit("#")).alias("rest"), F.concat(acc["found"], F.array_repeat(rule["name"], n)).alias("found"))

    empty = F.expr("cast(array() as array<string>)")
    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step, lambda acc: acc["found"])).otherwise(empty)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licenses (one for each rule's match)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    found = docs.select("doc_id", prepared(F.col("text")).alias("text")).select("doc_id", sequence(F.col("text")).alias("sentences"))
    return found.withColumn("licenses", licenses(F.col("sentences")))


def digest(docs: DataFrame) -> DataFrame:
    out = scan(docs)
    return out.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"),
        F.array_join(F.array_sort(F.array_distinct("licenses")), ",").alias("licenses"),
    )
