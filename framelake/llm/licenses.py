"""License scans: normalised sentences become identifiers, and ordered rules match sequences of them."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import ascii_lower, text_or_empty

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache2-line": "Licensed under the Apache License, Version 2.0",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-line": "Released under the MIT License",
    "mit-line-2": "Licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-title-2": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-line-2": "Licensed under the BSD 2-Clause License",
    "bsd-line-3": "Licensed under the BSD 3-Clause License",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-line-2": "Licensed under the GNU General Public License v3.0",
    "gpl2-line": "This work is licensed under the GNU General Public License, version 2",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl3-line": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl3-line": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-line": "Licensed under CC BY 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-line": "Licensed under CC BY-ND 4.0",
    "cc0-line": "Licensed under CC0 1.0 Universal",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "rights": "All rights reserved",
}


class Rule(NamedTuple):
    """Identifiers that follow each other among the known sentences of a text; `hides` are weaker rules."""

    name: str
    license: str
    sequence: tuple[str, ...]
    hides: tuple[str, ...] = ()


RULES = [
    Rule("apache2-line", "Apache-2.0", ("apache2-line",)),
    Rule("apache2-header", "Apache-2.0", ("apache2-header",)),
    Rule("apache2-notice", "Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see"), ("apache2-header",)),
    Rule("mit-line", "MIT", ("mit-line",)),
    Rule("mit-line-2", "MIT", ("mit-line-2",)),
    Rule("mit-title", "MIT", ("mit-title",)),
    Rule("mit-title-2", "MIT", ("mit-title-2",)),
    Rule("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability"), ("mit-title", "mit-title-2")),
    Rule("isc-title", "ISC", ("isc-title",)),
    Rule("isc-text", "ISC", ("isc-grant",), ("isc-title",)),
    Rule("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ("bsd-2-text",)),
    Rule("bsd-2-line", "BSD-2-Clause", ("bsd-line-2",)),
    Rule("bsd-3-line", "BSD-3-Clause", ("bsd-line-3",)),
    Rule("gpl3-line", "GPL-3.0-only", ("gpl3-line",)),
    Rule("gpl3-line-2", "GPL-3.0-only", ("gpl3-line-2",)),
    Rule("gpl2-line", "GPL-2.0-only", ("gpl2-line",)),
    Rule("gpl3-notice", "GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-implied", "gpl-details")),
    Rule("gpl2-notice", "GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-implied", "gpl-details")),
    Rule("lgpl3-line", "LGPL-3.0-only", ("lgpl3-line",)),
    Rule("agpl3-line", "AGPL-3.0-only", ("agpl3-line",)),
    Rule("mpl2-notice", "MPL-2.0", ("mpl2-form", "mpl2-copy")),
    Rule("cc-by-line", "CC-BY-4.0", ("cc-by-line",)),
    Rule("cc-by-long", "CC-BY-4.0", ("cc-by-long",)),
    Rule("cc-by-sa-line", "CC-BY-SA-4.0", ("cc-by-sa-line",)),
    Rule("cc-by-nc-line", "CC-BY-NC-4.0", ("cc-by-nc-line",)),
    Rule("cc-by-nd-line", "CC-BY-ND-4.0", ("cc-by-nd-line",)),
    Rule("cc0-line", "CC0-1.0", ("cc0-line",)),
    Rule("unlicense", "Unlicense", ("unlicense", "unlicense-anyone")),
    Rule("rights", "LicenseRef-all-rights-reserved", ("rights",)),
]

_NOT_WORD = r"[\x00\x02-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: A sentence ends at these signs before white space or the end, and at an empty line.
_ENDS = r"[.!?;:,]*[.!?;:](?=[\x20\x09-\x0D]|$)|\n[\x20\x09\x0B-\x0D]*\n"


def normal_sentence(text: str) -> list[str]:
    """The pieces, in normal form, into which a known sentence falls."""
    cut = re.sub(_ENDS, "\x01", text.lower())
    return [p for p in (re.sub(r"[\x20\n]+", " ", re.sub(_NOT_WORD, " ", s)).strip() for s in cut.split("\x01")) if p]


def known_pieces(sentences: dict[str, str]) -> dict[str, str]:
    """Normal form of each sentence's last piece, which is the one that is looked up, to its identifier."""
    out = {normal_sentence(text)[-1]: name for name, text in sentences.items()}
    if len(out) < len(sentences):
        raise ValueError("two sentences have the same normal form")
    return out


def sentences_of(text: Column) -> Column:
    """Sentences in normal form, in order; a sentence of several lines is followed by its single lines."""
    cut = F.regexp_replace(ascii_lower(text), _ENDS, "\x01")
    plain = F.split(F.regexp_replace(cut, _NOT_WORD, " "), "\x01", -1)
    pieces = F.transform(
        plain,
        lambda s: F.when(
            F.contains(F.btrim(s, F.lit(" \n")), F.lit("\n")),
            F.concat(F.array(F.regexp_replace(s, r"[\x20\n]+", " ")), F.split(s, "\n", -1)),
        ).otherwise(F.array(s)),
    )
    return F.transform(F.flatten(pieces), lambda s: F.btrim(s, F.lit(" \n")))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """`docs` with sentence_ids (known sentences in order), licenses and matched_rules (both sorted, distinct).

    A rule matches where its identifiers stand one after another among the known sentences; sentences that are
    not known do not come between. A rule hidden by another matched rule is left out. The table of sentences is
    a literal (some dozens of rows), so everything is one projection without a shuffle. Null and empty
    texts have empty arrays; repeated rows stay separate; columns with the new names are replaced.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = known_pieces(sentences)
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    names = ("sentence_ids", "licenses", "matched_rules")
    found = docs.drop(*names).withColumn(
        "sentence_ids",
        F.filter(F.transform(sentences_of(text_or_empty()), lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull()),
    )
    # Identifiers have no blank, so a sequence is a part of the blank-separated list.
    listed = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    met = {r.name: F.contains(listed, F.lit(f" {' '.join(r.sequence)} ")) for r in rules}
    hiders = {r.name: [h.name for h in rules if r.name in h.hides] for r in rules}
    chosen = []
    for r in rules:
        shown = met[r.name]
        for h in hiders[r.name]:
            shown = shown & ~met[h]
        chosen.append(F.when(shown, F.struct(F.lit(r.name).alias("rule"), F.lit(r.license).alias("license"))))
    matches = F.when(F.size("sentence_ids") > 0, F.filter(F.array(*chosen), lambda x: x.isNotNull())).otherwise(
        F.array().cast("array<struct<rule:string,license:string>>")
    )
    return (
        found.withColumn("__matches", matches)
        .withColumns(
            {
                "licenses": F.array_sort(F.array_distinct(F.transform("__matches", lambda m: m["license"]))),
                "matched_rules": F.array_sort(F.transform("__matches", lambda m: m["rule"])),
            }
        )
        .drop("__matches")
    )
