"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, which are normalised (lower case, other characters than letters and digits to single blanks) and
looked up in a table of known license sentences, which gives each an identifier. The document's sequence of identifiers is
then matched against ordered rules: each rule is a run of identifiers; what a rule has matched is used up for later ones, so
full texts come before single references.

Sentences end at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space and at lines without a letter or digit (blank ones, or
with no more than comment marks). Other line breaks go on, as license texts are wrapped and stand in comments, but for lines
(or parts of them) that are a known sentence by themselves.

All of it is one projection: no shuffle, no join, nothing collected.

Defined cases: null and empty texts have no sentences and no license; a sentence counts each time it occurs; repeated rows
each give a row; other columns are ignored; an empty table gives no rows; control characters 1 and 2 end sentences and lines.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of license texts and headers, and their identifiers.
TEXTS = {
    "All rights reserved.": "AllRights",
    # MIT
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "MitPermission",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "MitNotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "MitWarranty",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "MitLiability",
    # Apache 2.0
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "ApacheHead",
    "You may not use this file except in compliance with the License.": "ApacheUse",
    "You may obtain a copy of the License at": "ApacheCopy",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "ApacheCopy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "ApacheBasis",
    "See the License for the specific language governing permissions and limitations under the License.": "ApacheSee",
    # GNU
    "This program is free software;": "GnuFree",
    "This library is free software;": "GnuFree",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "Gpl3PlusTerms",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;": "GplTerms",
    "Either version 2 of the License, or (at your option) any later version.": "GnuVersion2Plus",
    "Either version 2.1 of the License, or (at your option) any later version.": "GnuVersion21Plus",
    "Either version 3 of the License, or (at your option) any later version.": "GnuVersion3Plus",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;": "LgplTerms",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "Lgpl3PlusTerms",
    "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "Agpl3PlusTerms",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "GnuHope",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "GnuHope",
    "Without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GnuWarranty",
    "See the GNU General Public License for more details.": "GplSee",
    "See the GNU Lesser General Public License for more details.": "LgplSee",
    "See the GNU Affero General Public License for more details.": "AgplSee",
    # BSD
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BsdTerms",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BsdSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "BsdBinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BsdNames",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "BsdAdvertising",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.": "BsdWarranty",
    # ISC, zlib, Boost, 0BSD
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "IscPermission",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "IscPermission",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "ZeroBsdPermission",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": "IscWarranty",
    "This software is provided 'as-is', without any express or implied warranty.": "ZlibWarranty",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "ZlibPermission",
    "Distributed under the Boost Software License, Version 1.0.": "BoostRef",
    # Mozilla, Eclipse, Unlicense, WTFPL, Creative Commons
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. ": "MplTerms",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "EplTerms",
    "This is free and unencumbered software released into the public domain.": "UnlicenseFree",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "UnlicenseAnyone",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": "WtfplTitle",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "CcZeroWaiver",
}
# How references name licenses.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
# What goes before a license's name.
PHRASES = ["Licensed under", "Released under", "Distributed under", "Available under", "This project is licensed under", "This work is licensed under", "This software is licensed under", "This file is licensed under", "Code is licensed under"]
# Ordered rules, license and run of identifiers. References follow them, each a rule of its own.
TEXT_RULES = [
    ("MIT", ["MitPermission", "MitNotice", "MitWarranty", "MitLiability"]),
    ("MIT", ["MitPermission", "MitNotice", "MitWarranty"]),
    ("Apache-2.0", ["ApacheHead", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("AGPL-3.0-or-later", ["GnuFree", "Agpl3PlusTerms", "GnuHope", "GnuWarranty", "AgplSee"]),
    ("LGPL-3.0-or-later", ["GnuFree", "Lgpl3PlusTerms", "GnuHope", "GnuWarranty", "LgplSee"]),
    ("LGPL-3.0-or-later", ["GnuFree", "LgplTerms", "GnuVersion3Plus", "GnuHope", "GnuWarranty", "LgplSee"]),
    ("LGPL-2.1-or-later", ["GnuFree", "LgplTerms", "GnuVersion21Plus", "GnuHope", "GnuWarranty", "LgplSee"]),
    ("GPL-3.0-or-later", ["GnuFree", "Gpl3PlusTerms", "GnuHope", "GnuWarranty", "GplSee"]),
    ("GPL-3.0-or-later", ["GnuFree", "GplTerms", "GnuVersion3Plus", "GnuHope", "GnuWarranty", "GplSee"]),
    ("GPL-2.0-or-later", ["GnuFree", "GplTerms", "GnuVersion2Plus", "GnuHope", "GnuWarranty", "GplSee"]),
    ("BSD-4-Clause", ["BsdTerms", "BsdSource", "BsdBinary", "BsdAdvertising", "BsdNames"]),
    ("BSD-3-Clause", ["BsdTerms", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdTerms", "BsdSource", "BsdBinary"]),
    ("ISC", ["IscPermission", "IscWarranty"]),
    ("0BSD", ["ZeroBsdPermission", "IscWarranty"]),
    ("Zlib", ["ZlibWarranty", "ZlibPermission"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("MIT", ["MitPermission"]),
    ("Apache-2.0", ["ApacheHead"]),
    ("AGPL-3.0-or-later", ["Agpl3PlusTerms"]),
    ("LGPL-3.0-or-later", ["Lgpl3PlusTerms"]),
    ("LGPL-3.0-or-later", ["LgplTerms", "GnuVersion3Plus"]),
    ("LGPL-2.1-or-later", ["LgplTerms", "GnuVersion21Plus"]),
    ("GPL-3.0-or-later", ["Gpl3PlusTerms"]),
    ("GPL-3.0-or-later", ["GplTerms", "GnuVersion3Plus"]),
    ("GPL-2.0-or-later", ["GplTerms", "GnuVersion2Plus"]),
    ("ISC", ["IscPermission"]),
    ("0BSD", ["ZeroBsdPermission"]),
    ("Zlib", ["ZlibPermission"]),
    ("MPL-2.0", ["MplTerms"]),
    ("EPL-2.0", ["EplTerms"]),
    ("BSL-1.0", ["BoostRef"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("WTFPL", ["WtfplTitle"]),
    ("CC0-1.0", ["CcZeroWaiver"]),
]


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def reference(name: str) -> str:
    return f"{name}Ref"


#: Known sentences in normalised form, references made of phrases and names, and their identifiers.
SENTENCES = {_normal(f"{phrase} {article} {called}"): reference(name) for name, many in NAMES.items() for called in many for phrase in PHRASES for article in ("", "the", "a")} | {_normal(s): i for s, i in TEXTS.items()}
RULES = [*TEXT_RULES, *((name, [reference(name)]) for name in NAMES), ("Proprietary", ["AllRights"])]
#: Each known sentence holds one of these words or parts of words (tested), so other texts and sentences need no look-up.
TALK = ["licen", "reserved", "permi", "warrant", "redistribut", "copyright", "liable", "software", "released", "distributed", "available"]
#: Stands for what a rule has used up; a run of identifiers never spans it.
USED = "-"
#: End of a sentence, and the end of a line that is none.
END, LINE = "\x01", "\x02"
#: The steps that put these marks into a text and take everything else out, as (pattern, replacement).
MARKS = [("\r\n?", "\n"), ("\n([^a-zA-Z0-9\n]*\n)+", END), ("[.!?;:][\"')\\]]*[ \t\n]", END), ("\n", LINE + END), ("[^a-zA-Z0-9\x01\x02]+", " ")]


def talk(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in TALK])


def parts(text: Column) -> Column:
    """Normalised sentences and lines; those that end with LINE may go on in the next."""
    marked = reduce(lambda c, x: F.regexp_replace(c, *x), MARKS, F.coalesce(text, F.lit("")))
    return F.split(F.lower(marked), END)


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    bare = lambda p: F.trim(F.replace(p, F.lit(LINE), F.lit("")))
    told = lambda p: F.when(talk(p) & F.element_at(known, bare(p)).isNotNull(), F.concat(F.lit(END), bare(p), F.lit(END))).when(F.endswith(p, F.lit(LINE)), F.concat(F.lit(" "), bare(p))).otherwise(F.concat(F.lit(" "), bare(p), F.lit(END)))
    whole = F.split(F.array_join(F.transform(parts(text), told), ""), END)
    found = F.filter(F.transform(F.filter(whole, talk), lambda s: F.element_at(known, F.trim(s))), lambda i: i.isNotNull())
    return F.when(talk(F.lower(F.coalesce(text, F.lit("")))), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (identifiers in text order, by commas), licenses (in rule order, by commas, each once) and
    n_sentences (known sentences in the text)."""
    out = docs.select("doc_id", identifiers(F.col("text")).alias("__ids"))
    # Each identifier stands between commas of its own, so that runs side by side don't share one.
    left = F.concat(F.lit(","), F.array_join("__ids", ",,"), F.lit(","))
    out = out.select("doc_id", F.array_join("__ids", ",").alias("sentence_ids"), F.size("__ids").cast("long").alias("n_sentences"), left.alias("__left"), F.array().cast("array<string>").alias("__licenses"))
    for name, run in RULES:
        there = F.lit("," + ",,".join(run) + ",")
        hit = F.contains(F.col("__left"), there)
        out = out.select("doc_id", "sentence_ids", "n_sentences", F.replace("__left", there, F.lit(f",{USED},")).alias("__left"), F.when(hit, F.array_append("__licenses", F.lit(name))).otherwise(F.col("__licenses")).alias("__licenses"))
    return out.select("doc_id", "sentence_ids", F.array_join(F.array_distinct("__licenses"), ",").alias("licenses"), "n_sentences")


def scan_sql() -> str:
    """The same scan as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # Control characters and quotes by escapes of the SQL's own.
    pattern = lambda s: "E'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace(END, "\\x01").replace(LINE, "\\x02") + "'"
    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in SENTENCES.items())
    marked = reduce(lambda c, x: f"regexp_replace({c}, {pattern(x[0])}, {pattern(x[1])}, 'g')", MARKS, "coalesce(text, '')")
    each = lambda array, of: f"SELECT doc_id, unnest({array}) AS s, generate_subscripts({array}, 1) AS pos FROM {of}"
    steps, left = [], "left0"
    columns = []
    for k, (name, run) in enumerate(RULES, 1):
        there = quote("," + ",,".join(run) + ",")
        columns.append(f"replace({left}, {there}, ',{USED},') AS left{k}")
        steps.append(f"CASE WHEN contains({left}, {there}) THEN {quote(name)} END")
        left = f"left{k}"
    chain = "SELECT doc_id, ids, n, ',' || ids2 || ',' AS left0 FROM seq"
    for c in columns:
        chain = f"SELECT *, {c} FROM ({chain})"
    return f"""
    WITH known(sentence, id) AS (VALUES {rows}),
    split1 AS (SELECT doc_id, string_split(lower({marked}), chr(1)) AS a FROM documents),
    parts AS ({each('a', 'split1')}),
    bare AS (SELECT doc_id, pos, s, trim(replace(s, chr(2), '')) AS b FROM parts),
    told AS (SELECT doc_id, string_agg(CASE WHEN id IS NOT NULL THEN chr(1) || b || chr(1) WHEN ends_with(s, chr(2)) THEN ' ' || b ELSE ' ' || b || chr(1) END, '' ORDER BY pos) AS t
             FROM bare LEFT JOIN known ON sentence = b GROUP BY doc_id),
    split2 AS (SELECT doc_id, string_split(t, chr(1)) AS a FROM told),
    whole AS ({each('a', 'split2')}),
    hit AS (SELECT doc_id, pos, id FROM whole JOIN known ON sentence = trim(s)),
    seq AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS ids, string_agg(id, ',,' ORDER BY pos) AS ids2, count(*) AS n FROM hit GROUP BY doc_id),
    matched AS ({chain}),
    named AS (SELECT doc_id, ids, n, list_filter([{', '.join(steps)}], lambda x: x IS NOT NULL) AS found FROM matched)
    SELECT d.doc_id, coalesce(ids, '') AS sentence_ids,
           coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses,
           coalesce(n, 0)::BIGINT AS n_sentences
    FROM documents d LEFT JOIN named USING (doc_id)
    """
