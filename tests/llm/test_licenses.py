import re

from brindle.llm import licenses, queries


def normal(s):
    return re.sub(r"[^\W_]+|.", lambda m: m[0] if m[0].isalnum() else " ", s.lower(), flags=re.S)


def squeeze(s):
    return " ".join(normal(s).split())


BY_TEXT = {t: n for n, t in licenses.SENTENCES.items()}


def brute(text):
    ids = []
    for s in re.split(r"(?<=[.!?:;])\s+|\n[\x20\t\r]*\n", text or ""):
        if squeeze(s) in BY_TEXT:
            ids.append(BY_TEXT[squeeze(s)])
        else:
            ids += [BY_TEXT[squeeze(x)] for x in s.split("\n") if squeeze(x) in BY_TEXT]
    left, found = list(ids), []
    for name, seq in licenses.RULES:
        i = 0
        while i + len(seq) <= len(left):
            if tuple(left[i : i + len(seq)]) == seq:
                left[i : i + len(seq)] = [None]
                found.append(name)
            i += 1
    return ids, found


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op8_licenses(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids, found = brute(r.text)
        assert got[r.doc_id].sentences == ",".join(ids)
        assert got[r.doc_id].licenses == ",".join(sorted(set(found)))
    assert any(r.licenses for r in got.values())


MIT = "MIT stuff\n\n" + ". ".join(licenses.SENTENCES[k].capitalize() for k in ("mit-grant",)) + ":\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More text."


def test_rules_take_their_sentences(spark):
    texts = [MIT, "foo bar\nReleased under the MIT License.\nAll rights reserved.", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "unlicensed rights", MIT + "\n\n" + MIT]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[0].licenses == ["MIT"] and got[0].sentences == ["mit-grant", "mit-notice", "mit-as-is"]
    assert got[1].licenses == ["MIT", "all-rights-reserved"]
    assert got[2].licenses == ["CC-BY-NC-4.0"] * 2
    assert got[3].licenses == [] and got[4].licenses == ["MIT", "MIT"]
    for i, t in enumerate(texts):
        assert (got[i].sentences, got[i].licenses) == brute(t)


GPL = """    <one line to give the program's name and a brief idea of what it does.>
    Copyright (C) <year>  <name of author>

    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {}://mozilla.org/MPL/2.0/.
"""


def test_notices_with_ends_inside(spark):
    """Verbatim notices whose sentences hold a colon, a semicolon or 'v.'."""
    gpl2, gpl3 = GPL.format(";", ";", 2), GPL.format(":", ",", 3)
    hashed = "# " + MPL.format("http").replace("\n", "\n# ")
    tail = ["gpl-hope", "gpl-details"]
    want = [
        (gpl2, ["gpl-2-free", *tail], ["GPL-2.0-or-later"]), (gpl3, ["gpl-free", *tail], ["GPL-3.0-or-later"]), (GPL.format(";", ";", 3), ["gpl-free", *tail], ["GPL-3.0-or-later"]),
        (MPL.format("http"), ["mpl-2.0-form", "mpl-2.0-copy"], ["MPL-2.0"]), (hashed, ["mpl-2.0-form", "mpl-2.0-copy"], ["MPL-2.0"]), (MPL.format("https"), ["mpl-2.0-form"], ["MPL-2.0"]),
        (MIT + "\n\n" + gpl3 + "Licensed under CC BY 4.0.", ["mit-grant", "mit-notice", "mit-as-is", "gpl-free", *tail, "cc-by-4.0"], ["MIT", "GPL-3.0-or-later", "CC-BY-4.0"]),
        ("This program is free software: you can run it. Without any warranty.", [], []),
        ("Free Software Foundation.\nReleased under the MIT License.\nAll rights reserved.", ["mit-released", "rights"], ["MIT", "all-rights-reserved"]),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, x[0]) for i, x in enumerate(want)], "doc_id long, text string")).collect()}
    for i, (_, ids, found) in enumerate(want):
        assert (got[i].sentences, got[i].licenses) == (ids, found)


def test_known_sentences_have_anchors():
    for text in licenses.SENTENCES.values():
        assert re.search(licenses.ANCHORS, text) and squeeze(text) == text
    names = set(licenses.SENTENCES)
    assert all(set(seq) <= names for _, seq in licenses.RULES)


def test_odd_rows(odd, odd_rows, none):
    rows = licenses.digest(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.n_sentences == 0 and r.licenses == "" for r in rows)
    assert licenses.digest(none).count() == 0


def test_native(odd):
    plan = licenses.digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


NOTICES = {
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "MIT": """MIT License

Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
""",
    "GPL-2.0-or-later": GPL.format(";", ";", 2),
    "GPL-3.0-or-later": GPL.format(":", ",", 3),
    "LGPL": """This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
""",
    "MPL-2.0": MPL.format("http"),
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish it.\n",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"].replace("THIS SOFTWARE", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")


def _sql_rows(rows):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = [d[0] for d in con.execute(queries.ORACLES["op8_licenses"]).description]
    return {r[names.index("doc_id")]: (r[names.index("sentences")], r[names.index("licenses")]) for r in con.fetchall()}


def test_official_notices(spark):
    """Each notice yields its license and no other, alone and within code comments; SQL agrees."""
    hashed = {k: "x = 1\n" + "".join(f"# {line}".rstrip() + "\n" for line in v.splitlines()) for k, v in NOTICES.items()}
    rows = [(i, v) for i, v in enumerate([*NOTICES.values(), *[f"Intro text here.\n\n{v}\n\nAnd more text." for v in NOTICES.values()], *hashed.values()])]
    got = {r.doc_id: r for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names, n = list(NOTICES), len(NOTICES)
    assert {names[i]: got[i].licenses for i in range(n)} == {k: k for k in names}
    assert {names[i]: got[n + i].licenses for i in range(n)} == {k: k for k in names}
    sql = _sql_rows(rows)
    assert all((got[i].sentences, got[i].licenses) == sql[i] for i, _ in rows)


def test_every_sentence_is_reachable(spark):
    rows = [(i, f"Before it. {text.capitalize()}.\n\nAfter it.") for i, text in enumerate(licenses.SENTENCES.values())]
    got = {r.doc_id: r for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].sentences for i in range(len(rows))] == list(licenses.SENTENCES)
    sql = _sql_rows(rows)
    assert all((got[i].sentences, got[i].licenses) == sql[i] for i, _ in rows)
    # every rule can win: its own sentences alone give its license
    rows = [(i, ". ".join(licenses.SENTENCES[x].capitalize() for x in seq) + ".") for i, (_, seq) in enumerate(licenses.RULES)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(len(rows))] == [[name] for name, _ in licenses.RULES]


MORE = {
    "AGPL-3.0-or-later": GPL.format(":", ",", 3).replace("GNU General", "GNU Affero General"),
    "GPL-2.0-only": GPL.format(";", ";", 2).replace("either version 2 of the License, or\n    (at your option) any later version.", "version 2 of the License."),
    "GPL-3.0-only": GPL.format(":", ",", 3).replace("either version 3 of the License, or\n    (at your option) any later version.", "version 3 of the License."),
    "LGPL-2.1-or-later": GPL.format(";", ";", "2.1").replace("program", "library").replace("GNU General", "GNU Lesser General"),
    "LGPL-3.0-or-later": GPL.format(":", ",", 3).replace("GNU General", "GNU Lesser General"),
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
""",
    "EPL-2.0": """This program and the accompanying materials
are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/

""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt.)\n",
    "BSD-3-Clause": NOTICES["BSD-3-Clause"].replace("the copyright holder nor", "Google Inc. nor"),
}
MORE |= {f"{t} ": f"SPDX-License-Identifier: {t}\nint main() { {} }\n" for t in licenses.TAGS}


def test_notices_in_comments_with_names_and_tags(spark):
    """Each notice, plain and inside the usual comments, yields its license and no other; SQL agrees."""
    wraps = {
        "plain": lambda v: v, "slashes": lambda v: "".join(f"// {x}".rstrip() + "\n" for x in v.splitlines()), "hash": lambda v: "".join(f"# {x}".rstrip() + "\n" for x in v.splitlines()),
        "block": lambda v: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in v.splitlines()) + " */\n", "markup": lambda v: f"<!--\n{v}\n-->\n",
    }
    cases = [(k.strip(), how, "code before\n\n" + f(v) + "\nx = 1\n") for k, v in [*NOTICES.items(), *MORE.items()] for how, f in wraps.items()]
    rows = [(i, text) for i, (_, _, text) in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(k, how, got[i].licenses) for i, (k, how, _) in enumerate(cases) if got[i].licenses != k]
    assert wrong == []
    sql = _sql_rows(rows)
    assert all((got[i].sentences, got[i].licenses) == sql[i] for i, _ in rows)
