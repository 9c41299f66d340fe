import re

import duckdb
import pytest

from gridloom.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some One

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2020 The Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("    ", " * ")
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
BSD3 = """Copyright (c) 2001, Example Labs
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the Example Labs Foundation nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD2 = re.sub(r"3\. Neither.*?permission\.\n", "", BSD3, flags=re.S)
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
GPL3_HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
RESERVED = "LicenseRef-all-rights-reserved"
DOCS = [
    (1, "Words end.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    (2, "No mark\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", "MIT,GPL-3.0-only"),
    (3, MIT, "MIT"),
    (4, "Licensed under CC BY-NC 4.0.  Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    (5, None, ""),
    (6, "", ""),
    (7, "About licensed things: not released under the mit license at all.", ""),
    (8, "word " * 200_000 + ".\nAll Rights Reserved.", RESERVED),
    (None, "RELEASED UNDER THE MIT LICENSE", "MIT"),
    (1, "Words end.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    (9, "Été — licence\n\n\n \nLicensed under CC BY 4.0!", "CC-BY-4.0"),
    (10, APACHE, f"Apache-2.0,{RESERVED}"),
    (11, GPL3, "GPL-3.0-or-later"),
    (12, GPL2, "GPL-2.0-or-later"),
    (13, LGPL21, "LGPL-2.1-or-later"),
    (14, BSD3, f"BSD-3-Clause,{RESERVED}"),
    (15, BSD2, f"BSD-2-Clause,{RESERVED}"),
    (16, ISC, "ISC"),
    (17, MPL, "MPL-2.0"),
    (18, UNLICENSE, "Unlicense"),
    (19, GPL3_HEAD + "\n\n" + GPL3, "GPL-3.0-only"),
    (20, "// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: Apache-2.0", "MIT,Apache-2.0"),
    (21, "*" * 300_000 + "\n" + MIT.upper().replace("\n", "\r\n"), "MIT"),
    (22, MIT + APACHE + GPL3, f"Apache-2.0,MIT,GPL-3.0-or-later,{RESERVED}"),
    (23, "This software is licensed under the terms of the Mozilla Public License 2.0; see there.", "MPL-2.0"),
    (24, "Version 2.0.1 is licensed under the Apache License, Version 2.0.1", ""),
    (25, "all rights\n\nreserved", RESERVED),
    (26, "All rights. Reserved; CC", RESERVED),
    (27, "İall rights reserved", RESERVED),
]


def rows(df):
    return sorted((r.doc_id or 0, r.sentence_ids, r.licenses, r.n_licenses) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in docs], "doc_id long, text string, licenses string, left int")


def by_sql(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    return sorted((a or 0, b, c, d) for a, b, c, d in con.sql(licenses.OP9_SQL).fetchall())


def test_rules_and_sql(spark):
    df = frame(spark, DOCS)
    got = rows(licenses.recognise(df))
    assert [(i, names) for i, _, names, _ in got] == [(i or 0, names) for i, _, names in sorted(DOCS, key=lambda d: d[0] or 0)]
    assert by_sql(df) == got


@pytest.mark.parametrize("text", [MIT, APACHE, GPL3, GPL2, LGPL21, BSD3, BSD2, ISC, MPL, UNLICENSE, GPL3_HEAD])
def test_wrapping_and_case_change_nothing(spark, text):
    variants = [text, text.lower(), text.upper(), re.sub(r"((?:\S+ ){4}\S+) ", r"\1\n", text), text.replace("\n", "\n## "), text.replace("\n\n", "\n \t\n")]
    got = {names for _, _, names, _ in rows(licenses.recognise(frame(spark, [(i, t, "") for i, t in enumerate(variants)])))}
    assert len(got) == 1 and got != {""}


def test_no_python_in_the_plan(spark):
    plan = licenses.recognise(frame(spark, DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_rule_is_known():
    assert {i.rstrip("?") for _, ids in licenses.RULES for i in ids} == set(licenses.SENTENCES)


def test_every_sentence_is_found_in_every_spelling(spark):
    known = [(w.replace("*", "some body of people"), i) for i, s in licenses.SENTENCES.items() for w in s.split("|")]
    known += [(f"licensed under {n}", f"is:{i}") for i, s in licenses.STATEMENTS.items() for n in s.split("|")]
    known += [(f"this work is made available under the terms of the {n}", f"is:{i}") for i, s in licenses.STATEMENTS.items() for n in s.split("|")]
    docs = [(k, spell(w), "") for k, (w, _) in enumerate(known) for spell in (str, lambda w: w.upper().replace(" ", " * "), lambda w: "x.\n" + w.title().replace(" ", "\n"))]
    df = frame(spark, docs)
    got = rows(licenses.recognise(df))
    assert [(known[k], ids) for k, ids, _, _ in got if ids != known[k][1]] == [] and len(got) == 3 * len(known)
    assert by_sql(df) == got


def test_empty(spark):
    assert licenses.recognise(frame(spark, DOCS).limit(0)).count() == 0
