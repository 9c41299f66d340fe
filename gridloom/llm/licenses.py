"""Licence recognition by sentences and rules, in DataFrame functions alone.

A text is normalised: runs of anything but letters and digits of ASCII become one space, or a boundary where they
hold the end of a line or a mark (. ! ? ; :) before white space, and A-Z become a-z. A sentence is what stands between
two boundaries, whatever boundaries there are inside it, so that wrapped and commented lines, list numbers, colons and
semicolons do not hide it. Known sentences map to identifiers, and the sequence of a document's identifiers is matched
against ordered rules: full texts and notices before parts of them, so that a sentence that a rule has used is not used
again by a later one. What is left of short statements ("licensed under ...") names its licence by itself.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_FSF = "license as published by the free software foundation"
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
#: Normalised sentences by identifier, several wordings of one divided by a bar; a star stands for one to twelve words.
#: The wording of public licences.
SENTENCES = {
    "apache_title": "apache license version 2 0 january 2004",
    "apache_terms": "terms and conditions for use reproduction and distribution",
    "apache_definitions": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache_the": "licensed under the apache license version 2 0 the license|the asf licenses this file to you under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0|you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc_liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_names": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_as_is": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd_liability": "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "gpl2_title": "gnu general public license version 2 june 1991",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21_title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007",
    "gpl_verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3_preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl2_preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "lgpl3_preamble": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "agpl3_preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "gpl3_later": f"this program {_FREE} general public {_FSF} either version 3 of the license or at your option any later version",
    "gpl2_later": f"this program {_FREE} general public {_FSF} either version 2 of the license or at your option any later version",
    "gpl3_only": f"this program {_FREE} general public {_FSF} version 3|this program {_FREE} general public {_FSF} version 3 of the license|this program {_FREE} general public license version 3 as published by the free software foundation",
    "gpl2_only": f"this program {_FREE} general public {_FSF} version 2|this program {_FREE} general public {_FSF} version 2 of the license|this program {_FREE} general public license version 2 as published by the free software foundation",
    "gpl_hope": f"this program {_WARRANTY}",
    "gpl_details": "see the gnu general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl3_later": f"this library {_FREE} lesser general public {_FSF} either version 3 of the license or at your option any later version|this program {_FREE} lesser general public {_FSF} either version 3 of the license or at your option any later version",
    "lgpl21_later": f"this library {_FREE} lesser general public {_FSF} either version 2 1 of the license or at your option any later version",
    "lgpl_hope": f"this library {_WARRANTY}",
    "lgpl_details": "see the gnu lesser general public license for more details",
    "lgpl_received": "you should have received a copy of the gnu lesser general public license along with this library|you should have received a copy of the gnu lesser general public license along with this program",
    "agpl3_later": f"this program {_FREE} affero general public {_FSF} either version 3 of the license or at your option any later version",
    "agpl_details": "see the gnu affero general public license for more details",
    "agpl_received": "you should have received a copy of the gnu affero general public license along with this program",
    "mpl2_title": "mozilla public license version 2 0",
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0|if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0|if a copy of the mpl was not distributed with this file you can obtain one at http www mozilla org mpl 2 0",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0_dedicated": "to the extent possible under law the author s has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide|to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "reserved": "all rights reserved",
}
#: Names of licences in short statements, by the licence. Customary names.
STATEMENTS = {
    "MIT": "mit license|mit licence|mit",
    "Apache-2.0": "apache license version 2 0|apache license 2 0|apache license v2 0|apache 2 0 license|apache 2 0",
    "GPL-2.0-only": "gnu general public license version 2|gnu general public license v2|gnu gpl version 2|gpl version 2|gplv2|gpl v2|gpl 2 0",
    "GPL-3.0-only": "gnu general public license version 3|gnu general public license v3|gnu general public license v3 0|gnu gpl version 3|gpl version 3|gplv3|gpl v3|gpl 3 0",
    "GPL-2.0-or-later": "gpl 2 0 or later|gnu general public license version 2 or later|gnu general public license v2 or later",
    "GPL-3.0-or-later": "gpl 3 0 or later|gnu general public license version 3 or later|gnu general public license v3 or later",
    "LGPL-2.1-only": "gnu lesser general public license version 2 1|gnu lesser general public license v2 1|lgpl 2 1",
    "LGPL-3.0-only": "gnu lesser general public license version 3|gnu lesser general public license v3|lgpl 3 0",
    "AGPL-3.0-only": "gnu affero general public license version 3|gnu affero general public license v3|agpl 3 0",
    "MPL-2.0": "mozilla public license version 2 0|mozilla public license 2 0|mpl 2 0",
    "BSD-2-Clause": "bsd 2 clause license|2 clause bsd license|simplified bsd license|bsd 2 clause",
    "BSD-3-Clause": "bsd 3 clause license|3 clause bsd license|new bsd license|bsd 3 clause",
    "ISC": "isc license|isc",
    "Unlicense": "unlicense",
    "CC0-1.0": "cc0 1 0|cc0 1 0 universal",
    "CC-BY-4.0": "cc by 4 0|a creative commons attribution 4 0 international license",
    "CC-BY-SA-4.0": "cc by sa 4 0|a creative commons attribution sharealike 4 0 international license",
    "CC-BY-ND-4.0": "cc by nd 4 0|a creative commons attribution noderivatives 4 0 international license",
    "CC-BY-NC-4.0": "cc by nc 4 0|a creative commons attribution noncommercial 4 0 international license",
    "CC-BY-NC-SA-4.0": "cc by nc sa 4 0|a creative commons attribution noncommercial sharealike 4 0 international license",
    "CC-BY-NC-ND-4.0": "cc by nc nd 4 0|a creative commons attribution noncommercial noderivatives 4 0 international license",
}
#: What may lead a licence's name in a statement.
_LEADS = "(?:this (?:software|project|program|package|library|file|code|work|document|page|text|content) is )?(?:licensed|released|distributed|made available|available) under (?:the )?(?:terms of (?:the )?)?|spdx license identifier "
#: (licence, identifiers in their order; a question mark allows one to be absent). Earlier rules go first.
_GPL_NOTICE = ["gpl3_later?", "gpl2_later?", "gpl_hope?", "gpl_details?", "gpl_received?"]
RULES = [
    ("Apache-2.0", ["apache_title", "apache_terms?", "apache_definitions?", "apache_the?", "apache_comply?", "apache_copy?", "apache_as_is?", "apache_see?"]),
    ("GPL-3.0-only", ["gpl3_title", "gpl_verbatim?", "gpl3_preamble", *_GPL_NOTICE]),
    ("GPL-2.0-only", ["gpl2_title", "gpl_verbatim?", "gpl2_preamble", *_GPL_NOTICE]),
    ("LGPL-3.0-only", ["lgpl3_title", "gpl_verbatim?", "lgpl3_preamble"]),
    ("LGPL-2.1-only", ["lgpl21_title", "gpl_verbatim?", "gpl2_preamble?", "lgpl21_later?", "lgpl_hope?", "lgpl_details?", "lgpl_received?"]),
    ("AGPL-3.0-only", ["agpl3_title", "gpl_verbatim?", "agpl3_preamble", "agpl3_later?", "gpl_hope?", "agpl_details?", "agpl_received?"]),
    ("Apache-2.0", ["apache_the", "apache_comply?", "apache_copy?", "apache_as_is?", "apache_see?"]),
    ("MIT", ["mit_grant", "mit_notice?", "mit_as_is?", "mit_liability?"]),
    ("ISC", ["isc_grant", "isc_as_is?", "isc_liability?"]),
    ("0BSD", ["0bsd_grant", "isc_as_is?", "isc_liability?"]),
    ("BSD-4-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising", "bsd_names?", "bsd_as_is?", "bsd_liability?"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is?", "bsd_liability?"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is?", "bsd_liability?"]),
    ("GPL-3.0-or-later", ["gpl3_later", "gpl_hope?", "gpl_details?", "gpl_received?"]),
    ("GPL-2.0-or-later", ["gpl2_later", "gpl_hope?", "gpl_details?", "gpl_received?"]),
    ("GPL-3.0-only", ["gpl3_only", "gpl_hope?", "gpl_details?", "gpl_received?"]),
    ("GPL-2.0-only", ["gpl2_only", "gpl_hope?", "gpl_details?", "gpl_received?"]),
    ("LGPL-3.0-or-later", ["lgpl3_later", "lgpl_hope?", "gpl_hope?", "lgpl_details?", "lgpl_received?"]),
    ("LGPL-2.1-or-later", ["lgpl21_later", "lgpl_hope?", "lgpl_details?", "lgpl_received?"]),
    ("AGPL-3.0-or-later", ["agpl3_later", "gpl_hope?", "agpl_details?", "agpl_received?"]),
    ("MPL-2.0", ["mpl2_subject", "mpl2_copy?"]),
    ("MPL-2.0", ["mpl2_title"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone?"]),
    ("CC0-1.0", ["cc0_dedicated"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]
#: Steps of the normalisation: a boundary is marked by a pair of these, so that neighbouring sentences have one each. The
#: second leaves single spaces alone, which are most of what it would replace by themselves. Its class lists characters:
#: Java looks those up in a table, and tests ranges one by one.
_MARK = "\x01"
_ALNUM = string.ascii_letters + string.digits
_STEPS = [(r"[.!?;:][\"')\]]?[ \t\r\n\f]|\n", _MARK), (f"[^{_ALNUM} {_MARK}][^{_ALNUM}{_MARK}]*| [^{_ALNUM}{_MARK}]+", " "), (f" ?{_MARK}[ {_MARK}]*", _MARK * 2)]
_BETWEEN = f"[ {_MARK}]+"
#: From a sentence as found to the one that is looked up: boundaries inside it, names that fill a star, leads of statements.
_TO_KNOWN = [
    (_BETWEEN, " "),
    ("^neither the name of .* nor the names", "neither the name of x nor the names"),
    ("^this software is provided by .* as is and", "this software is provided by x as is and"),
    ("^in no event shall .* be liable for any direct", "in no event shall x be liable for any direct"),
    (f"^(?:{_LEADS})", "statement "),
]


def _known() -> dict[str, str]:
    out = {re.sub(f"^(?:{_LEADS})", "statement ", wording.replace("*", "x")): i for i, s in SENTENCES.items() for wording in s.split("|")}
    return out | {f"statement {name}": f"is:{licence}" for licence, names in STATEMENTS.items() for name in names.split("|")}


def _pattern() -> str:
    """All sentences, the longer ones first, between two boundaries."""
    spaced = lambda s: s.replace(" ", _BETWEEN).replace("*", f"(?:[a-z0-9]+{_BETWEEN}){{0,11}}[a-z0-9]+")
    whole = sorted((w for s in SENTENCES.values() for w in s.split("|")), key=lambda w: (-len(w), w))
    names = sorted((n for s in STATEMENTS.values() for n in s.split("|")), key=lambda w: (-len(w), w))
    statements = f"(?:{spaced(_LEADS)})(?:{'|'.join(map(spaced, names))})"
    return f"{_MARK}(?:{'|'.join(map(spaced, whole))}|{statements}){_MARK}"


def _rule_pattern(ids: list[str]) -> str:
    return "".join(f"(<{i[:-1]}>)?" if i.endswith("?") else f"<{i}>" for i in ids)


def sentences(text: Column) -> Column:
    """The known sentences of a text in their order, as they are looked up."""
    text = F.concat(F.lit("\n"), text, F.lit("\n"))
    for pattern, mark in _STEPS:
        text = F.regexp_replace(text, pattern, mark)
    found = F.regexp_extract_all(F.lower(text), F.lit(_pattern()), 0)

    def known(s: Column) -> Column:
        s = F.replace(s, F.lit(_MARK * 2), F.lit(" "))
        s = F.replace(s, F.lit(_MARK), F.lit(""))
        for pattern, by in _TO_KNOWN:
            s = F.regexp_replace(s, pattern, by)
        return s

    return F.transform(found, known)


def recognise(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, licenses, n_licenses`` of every row, from whole texts.

    ``sentence_ids`` are the known sentences in their order, joined by spaces; ``licenses`` the licences of the rules
    that matched, then of the statements that are left, each once, in the order of the rules and of the text, joined by
    commas. A null, empty or unlicensed text gets empty strings and 0. Where two sentences could begin at one place the
    longer is taken. Repeated rows and null ids keep their rows; very long texts are read whole. Other columns are not
    read.
    """
    known = F.create_map(*(F.lit(x) for pair in _known().items() for x in pair))
    found = F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.element_at(known, s))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(found, " ").alias("sentence_ids"))
    rows = rows.withColumn("left", F.when(F.col("sentence_ids") == "", "").otherwise(F.concat(F.lit("<"), F.replace("sentence_ids", F.lit(" "), F.lit("><")), F.lit(">"))))
    names = []
    for k, (_, ids) in enumerate(RULES):
        pattern = _rule_pattern(ids)
        names.append(f"rule{k}")
        rows = rows.withColumns({names[-1]: F.col("left").rlike(pattern), "left": F.regexp_replace("left", pattern, "<>")})
    by_rule = F.array_compact(F.array(*(F.when(F.col(n), F.lit(name)) for n, (name, _) in zip(names, RULES))))
    matched = F.array_distinct(F.concat(by_rule, F.regexp_extract_all("left", F.lit("<is:([^>]+)>"), 1)))
    return rows.select("doc_id", "sentence_ids", F.array_join(matched, ",").alias("licenses"), F.size(matched).cast("long").alias("n_licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`recognise` over all documents, whose docstring states the odd cases."""
    return recognise(table(spark, sf_dir, "documents"))


def _sql() -> str:
    text = "chr(10) || coalesce(text, '') || chr(10)"
    quoted = lambda s: s.replace("'", "''")
    for pattern, mark in _STEPS:
        text = f"regexp_replace({text}, '{quoted(pattern)}', '{mark}', 'g')"
    looked_up = f"replace(replace(s, '{_MARK * 2}', ' '), '{_MARK}', '')"
    for pattern, by in _TO_KNOWN:
        looked_up = f"regexp_replace({looked_up}, '{pattern}', '{by}', 'g')"
    known = ", ".join(f"('{s}', '{i}')" for s, i in _known().items())
    steps, last = [], "s"
    for k, (_, ids) in enumerate(RULES):
        p = _rule_pattern(ids)
        steps.append(f"r{k} AS (SELECT *  REPLACE (regexp_replace(rest, '{p}', '<>', 'g') AS rest), regexp_matches(rest, '{p}') AS rule{k} FROM {last})")
        last = f"r{k}"
    matched = ", ".join(f"CASE WHEN rule{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    order = ", ".join(f"'{name}'" for name in dict.fromkeys(name for name, _ in RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
known(sentence, id) AS (VALUES {known}),
e AS (SELECT n, regexp_extract_all(lower({text}), '{_pattern()}') AS found FROM d),
parts AS (SELECT n, unnest(found) AS s, generate_subscripts(found, 1) AS k FROM e),
ids AS (SELECT n, string_agg(id, ' ' ORDER BY k) AS sentence_ids FROM parts JOIN known ON {looked_up} = sentence GROUP BY n),
s AS (SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, CASE WHEN sentence_ids IS NULL THEN '' ELSE '<' || replace(sentence_ids, ' ', '><') || '>' END AS rest FROM d LEFT JOIN ids USING (n)),
{", ".join(steps)},
m AS (SELECT doc_id, sentence_ids, list_filter([{order}], lambda x: list_contains([{matched}], x)) AS by_rule, regexp_extract_all(rest, '<is:([^>]+)>', 1) AS stated FROM {last}),
o AS (SELECT doc_id, sentence_ids, list_concat(by_rule, list_filter(stated, lambda x, i: NOT list_contains(by_rule, x) AND list_position(stated, x) = i)) AS licences FROM m)
SELECT doc_id, sentence_ids, array_to_string(licences, ',') AS licenses, CAST(len(licences) AS BIGINT) AS n_licenses FROM o
"""


OP9_SQL = _sql()
