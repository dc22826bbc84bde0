"""Operator 6 (native): recognition of licences by their sentences."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .common import text_of

# Sentences of public licences and their usual notices, as (identifier, text). Texts are cut at their sentence ends like any
# other; of several parts the first has the identifier itself, the others a number behind it.
SENTENCES = [
    ("apache-grant", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-0-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("bsl-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("gpl-under", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    ("gpl3-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-under", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"),
    ("lgpl3-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("later-2", "either version 2 of the License, or (at your option) any later version."),
    ("later-2.1", "either version 2.1 of the License, or (at your option) any later version."),
    ("later-3", "either version 3 of the License, or (at your option) any later version."),
    ("only-2", "version 2 of the License."),
    ("gpl-useful", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl2.1-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-title", "Mozilla Public License Version 2.0"),
    ("epl-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
    ("epl-title", "Eclipse Public License - v 2.0"),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
]

# Sentences with a name in them (which may be cut behind an Inc.), as (identifier, regular expression over the normal form).
TEMPLATES = [
    ("bsd-name", r"^neither the names? of .+ nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("bsd-name", r"^nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission$"),
]

# Licences and what a short notice calls them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"], "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"], "GPL-2.0-only": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"], "GPL-3.0-only": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"], "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"], "EPL-2.0": ["Eclipse Public License 2.0"], "CC0-1.0": ["CC0 1.0 Universal"], "Unlicense": ["Unlicense"],
}
OPENINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under"]
CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Licence, the sentences that it takes in this order (others may stand between them), and sentences that speak against it.
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-as-is", "apache-see"], []),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is"], []),
    ("MIT-0", ["mit-0-grant", "mit-as-is"], ["mit-condition"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], []),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["bsd-name"]),
    ("ISC", ["isc-grant"], []),
    ("0BSD", ["0bsd-grant"], ["isc-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered"], []),
    ("BSL-1.0", ["bsl-grant"], []),
    ("AGPL-3.0-or-later", ["agpl3-later"], []),
    ("LGPL-3.0-or-later", ["lgpl3-later"], []),
    ("LGPL-3.0-or-later", ["lgpl-under", "later-3"], []),
    ("LGPL-2.1-or-later", ["lgpl-under", "later-2.1"], []),
    ("GPL-3.0-or-later", ["gpl3-later"], []),
    ("GPL-3.0-or-later", ["gpl-under", "later-3"], []),
    ("GPL-2.0-or-later", ["gpl-under", "later-2"], []),
    ("GPL-2.0-only", ["gpl-under", "only-2"], ["later-2", "later-3"]),
    ("AGPL-3.0-only", ["agpl3-title"], ["agpl3-later"]),
    ("LGPL-3.0-only", ["lgpl3-title"], ["lgpl3-later", "later-3"]),
    ("LGPL-2.1-only", ["lgpl2.1-title"], ["later-2.1"]),
    ("GPL-3.0-only", ["gpl3-title"], ["gpl3-later", "later-3", "agpl3-title", "lgpl3-title"]),
    ("GPL-2.0-only", ["gpl2-title"], ["later-2"]),
    ("MPL-2.0", ["mpl-notice"], []),
    ("EPL-2.0", ["epl-notice"], []),
    ("MIT", ["mit-grant"], []),
    ("Apache-2.0", ["apache-grant"], []),
    ("Apache-2.0", ["apache-title"], []),
    ("MPL-2.0", ["mpl-title"], []),
    ("EPL-2.0", ["epl-title"], []),
    ("CC0-1.0", ["cc0-notice"], []),
    ("Unlicense", ["unlicense-notice"], []),
]

ENDS = r"[.;:!?]+(?:[\"')\]]*)(?:\s+|$)"
TAG = "SPDX-License-Identifier"
LIST_MARK = r"^(?:[0-9]{1,2}|[a-h]|i{1,3}|iv|vi{0,3}|ix|x) "


def plain(sentence: str) -> str:
    """The normal form of a sentence: a-z and 0-9, single spaces, no list mark."""
    return re.sub(LIST_MARK, "", " ".join(re.sub("[^a-z0-9]+", " ", sentence.lower()).split()))


def parts(text: str) -> list[str]:
    """The normal forms of a text's sentences."""
    return [p for p in map(plain, re.split(ENDS, text.replace(f"{TAG}:", f"{TAG} "))) if p]


@dataclass(frozen=True)
class Recogniser:
    """Sentences by normal form, templates, and ordered rules over their identifiers."""

    sentences: dict[str, str]
    rules: list[tuple[str, list[str], list[str]]]
    templates: list[tuple[str, str]] = field(default_factory=list)

    @staticmethod
    def standard() -> Recogniser:
        sentences, rules = {}, list(RULES)
        for name, text in SENTENCES:
            for k, part in enumerate(parts(text)):
                if len(part.split()) > 2:
                    sentences.setdefault(part, name if k == 0 else f"{name}-{k + 1}")
        notices = {licence: [f"{o} {article}{n}" for n in names for o in OPENINGS for article in ("the ", "", "the terms of the ")] for licence, names in NAMES.items()}
        for code, words in CC_TERMS.items():
            called = [f"CC {code} 4.0", f"Creative Commons {code} 4.0", f"a Creative Commons {words} 4.0 International License", f"the Creative Commons {words} 4.0 International License"]
            notices[f"CC-{code}-4.0"] = [f"{o} {c}" for o in OPENINGS for c in called]
        for licence, texts in notices.items():
            name = f"{licence.lower()}-notice"
            sentences |= {p: name for t in [*texts, f"{TAG} {licence}"] for p in parts(t)[:1]}
            rules.append((licence, [name], []))
        for licence in ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"):
            sentences[plain(f"{TAG} {licence}")] = f"{licence.lower()}-notice"
            rules.append((licence, [f"{licence.lower()}-notice"], []))
        return Recogniser(sentences, rules, TEMPLATES)

    def starts(self) -> list[str]:
        """The first two words of every sentence."""
        return sorted({*self.by_start(), *(" ".join(re.findall(r"[a-z]+", re.sub(r"s\?", "", t))[:2]) for _, t in self.templates)})

    def by_start(self) -> dict[str, list[tuple[str, str]]]:
        """The sentences that begin with the same two words, with their identifiers, the longest first."""
        found: dict[str, list[tuple[str, str]]] = {}
        for s, name in sorted(self.sentences.items(), key=lambda kv: (-len(kv[0]), kv[0])):
            found.setdefault(" ".join(s.split()[:2]), []).append((s, name))
        return found

    def most_lines(self) -> int:
        """A line has a word at least, so a sentence stands on no more lines than it has words; twice that for names in templates."""
        return max([2, *(len(s.split()) for s in self.sentences), *(2 * len(t.split()) for _, t in self.templates)])


def _fits(ids: Column, sequence: list[str], against: list[str]) -> Column:
    """Whether the identifiers, each between spaces, hold those of the sequence in its order and none of the others."""
    fits = ids.rlike(".*".join(f" {re.escape(s)} " for s in sequence))
    for s in against:
        fits = fits & ~F.contains(ids, F.lit(f" {s} "))
    return fits


def recognise(docs: DataFrame, recogniser: Recogniser | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence_ids, licenses, n_licenses of every row.

    sentence_ids has the known sentences in text order, each once, and licenses the licences whose rule fits, in the order of the
    rules: a rule fits if its sentences stand in its order. Both are joined by spaces and empty where nothing is known; null
    and empty texts have nothing. Sentences end at . ; : ! ? before white space. A known one may also stand on lines of its own
    among others without such ends (a heading above it, a notice on a line), wrapped however narrow; marks of comments and lists,
    and a copyright line that runs on into it, don't count. No rows meet: the work is one pass over each text, linear in its lines.
    """
    known = recogniser or Recogniser.standard()
    starts, most = known.starts(), known.most_lines()
    grouped = {two: [{"s": s, "name": name} for s, name in those] for two, those in known.by_start().items()}
    by_start = F.from_json(F.lit(json.dumps(grouped)), "map<string, array<struct<s string, name string>>>")  # a constant
    # A template may run over lines, and ends with one.
    templates = [(name, "(?s)" + re.sub(r"\$$", r"(?=\\n|\\z)", pattern).replace(" ", "[ \\n]")) for name, pattern in known.templates]

    def lines_of(sentence: Column) -> Column:
        return F.filter(F.transform(F.split(sentence, "\n"), lambda x: F.btrim(x)), lambda x: x != "")

    def from_line(stretch: Column, two: Column) -> Column:
        """The longest known sentence that the lines of a stretch begin with and that ends with one of them, as an array of at most one."""
        fits = F.filter(by_start[two], lambda k: stretch["spaced"].startswith(k["s"]) & F.substring(stretch["broken"], F.char_length(k["s"]) + 1, F.lit(1)).isin("\n", ""))
        name = F.get(fits, F.lit(0))["name"]
        for template, pattern in templates:
            name = F.coalesce(name, F.when(stretch["broken"].rlike(pattern), F.lit(template)))
        return F.array_compact(F.array(name))

    def begun(lines: Column, line: Column, at: Column) -> Column:
        first = F.regexp_replace(line, before, "")
        two = F.substring_index(F.concat_ws(" ", first, F.get(lines, at + 1)), " ", 2)
        ahead = F.slice(lines, at + 2, F.lit(most - 1))
        stretch = bound(ahead, lambda more: F.struct(F.concat_ws(" ", F.array(first), more).alias("spaced"), F.concat_ws("\n", F.array(first), more).alias("broken")))
        return F.when(two.isin(*starts), bound(stretch, lambda x: from_line(x, two))).otherwise(F.array().cast("array<string>"))

    def hits(sentence: Column) -> Column:
        """The lines are cut once, and each is looked at once with a bounded number of those behind it."""
        return bound(lines_of(sentence), lambda lines: F.flatten(F.transform(lines, lambda line, at: begun(lines, line, at))))

    # Sentence ends become a mark of their own; then all but letters, digits, line ends and marks is space.
    marked = F.regexp_replace(F.lower(F.regexp_replace(text_of(text_col), f"(?i){TAG}:", f"{TAG} ")), ENDS, "\u0001")
    spaced = F.regexp_replace(marked, "[^a-z0-9\n\u0001]+", " ")
    # Most sentences have no line that begins like a known one and are told by one search.
    begins = "|".join(x.replace(" ", r"\s+") for x in starts)
    likely = rf"(?:^|\n) ?(?:copyright [^\n]*|(?:[0-9]{{1,2}}|[a-h]|[ivx]{{1,4}}) )?(?:{begins})\b"
    before = rf"{LIST_MARK}|^copyright .*?(?= (?:{begins})\b) "
    ids = F.flatten(F.transform(F.filter(F.split(spaced, "\u0001"), lambda s: s.rlike(likely)), hits))
    found = docs.select(F.col(id_col), ids.alias("ids"))
    marked_ids = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    fits = [F.when(_fits(F.col("marked"), sequence, against), F.lit(licence)) for licence, sequence, against in known.rules]
    # Rules are looked at where there is any sentence.
    licences = F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(F.array(*fits)))).otherwise(F.array().cast("array<string>"))
    out = found.withColumn("marked", marked_ids).withColumn("licences", licences)
    return out.select(F.col(id_col), F.array_join(F.array_distinct("ids"), " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licenses"), F.size("licences").cast("long").alias("n_licenses"))


def oracle_sql() -> str:
    """DuckDB SQL for the same results by another way: known sentences are searched in whole normalised texts, not cut out of them.

    Of sentences found within another the longer counts.
    """
    known = Recogniser.standard()
    table = ", ".join(f"('{s}', '{k}')" for s, k in known.sentences.items())
    rules = ", ".join(
        f"CASE WHEN regexp_matches(marked, '{'.*'.join(f' {re.escape(s)} ' for s in seq)}'){''.join(f' AND NOT contains(marked, $$ {s} $$)' for s in against)} THEN '{licence}' END" for licence, seq, against in known.rules
    )
    return f"""
WITH known(s, id) AS (VALUES {table}),
norm AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM documents),
places AS (SELECT doc_id, id, instr(n, ' ' || s || ' ') AS pos, length(s) AS len FROM norm JOIN known ON contains(n, ' ' || s || ' ')),
outer_ones AS (SELECT * FROM places p WHERE NOT EXISTS (SELECT 1 FROM places o WHERE o.doc_id = p.doc_id AND o.pos <= p.pos AND o.pos + o.len >= p.pos + p.len AND o.len > p.len)),
firsts AS (SELECT doc_id, id, min(pos) AS pos FROM outer_ones GROUP BY ALL),
ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM firsts GROUP BY doc_id),
marked AS (SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, ' ' || coalesce(array_to_string(ids, '  '), '') || ' ' AS marked FROM documents LEFT JOIN ids USING (doc_id)),
found AS (SELECT doc_id, sentence_ids, list_filter([{rules}], lambda x: x IS NOT NULL) AS ls FROM marked),
once AS (SELECT doc_id, sentence_ids, list_filter(ls, lambda x, i: list_position(ls, x) = i) AS ls FROM found)
SELECT doc_id, sentence_ids, coalesce(array_to_string(ls, ' '), '') AS licenses, len(ls)::BIGINT AS n_licenses FROM once
"""
