"""Licences by sentence rules, in DataFrame functions alone.

Texts are cut into sentences, sentences are normalised (lower case; only letters, digits and dots; single spaces) and looked
up among known licence sentences, which have identifiers. The identifiers found, in text order, are matched against
ordered rules, longest first: a rule whose sequence occurs names its licence and uses the sequence up.

Only texts with one of KEYWORDS are cut up. Every known sentence has one of them (tested), and they are letters and digits alone,
which normalisation leaves as they are, so no line break or sign can hide one and nothing is missed.

Edge cases: null and empty texts have no sentences; very long texts are read whole; repeated sentences and rows count each; a
sentence across line breaks is one sentence unless its next line starts like one; of rules that could use the same identifiers
the first does; identifiers that no rule uses are reported as leftover; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("licen", "copyright", "warrant", "permission", "redistribut", "gnu", "spdx", "liable", "unencumbered", "cc0")
#: (identifier, sentence as normalised)
OWN_SENTENCES = (
    ("MITref", "released under the mit license"),
    ("MITref", "licensed under the mit license"),
    ("MITref", "distributed under the mit license"),
    ("MITref", "this project is licensed under the mit license"),
    ("MITtitle", "the mit license"),
    ("MITtitle", "mit license"),
    (
        "MITperm",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    ("MITnotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (
        "AsIs",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    (
        "NoLiability",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    ("Apache2ref", "licensed under the apache license version 2.0"),
    ("Apache2ref", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("Apache2ref", "released under the apache license version 2.0"),
    ("Apache2use", "you may not use this file except in compliance with the license"),
    ("Apache2copy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    (
        "Apache2asis",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    ("Apache2see", "see the license for the specific language governing permissions and limitations under the license"),
    ("GPL3ref", "this work is licensed under the gnu general public license version 3"),
    ("GPL3ref", "licensed under the gnu general public license version 3"),
    ("GPL3ref", "released under the gnu general public license version 3"),
    ("GPL2ref", "this work is licensed under the gnu general public license version 2"),
    ("GPL2ref", "licensed under the gnu general public license version 2"),
    (
        "GPLfree3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    (
        "GPLfree2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ),
    ("GPLhope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLsee", "see the gnu general public license for more details"),
    ("GPLcopy", "you should have received a copy of the gnu general public license along with this program"),
    ("LGPL3ref", "licensed under the gnu lesser general public license version 3"),
    ("LGPL21ref", "licensed under the gnu lesser general public license version 2.1"),
    ("AGPL3ref", "licensed under the gnu affero general public license version 3"),
    ("MPL2ref", "this source code form is subject to the terms of the mozilla public license v"),
    ("MPL2ref", "licensed under the mozilla public license version 2.0"),
    ("BSDredist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDsource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (
        "BSDbinary",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    (
        "BSDendorse",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    ("BSD3ref", "licensed under the bsd 3 clause license"),
    ("BSD2ref", "licensed under the bsd 2 clause license"),
    ("CCBYNC4ref", "licensed under cc by nc 4.0"),
    ("CCBYNC4ref", "this work is licensed under cc by nc 4.0"),
    ("CCBY4ref", "licensed under cc by 4.0"),
    ("CCBYSA4ref", "licensed under cc by sa 4.0"),
    ("CCBY4ref", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CCBYSA4ref", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC0ref", "released under cc0 1.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("AllRights", "all rights reserved no license is granted"),
    ("SpdxMIT", "spdx license identifier mit"),
    ("SpdxApache2", "spdx license identifier apache 2.0"),
    ("SpdxGPL3", "spdx license identifier gpl 3.0 or later"),
    ("SpdxBSD3", "spdx license identifier bsd 3 clause"),
)
#: (identifier, licence, names): what can follow the words of GRANTS.
NAMED = (
    ("MITref", "MIT", ("the mit license", "mit license", "the expat license", "the mit expat license")),
    ("Apache2ref", "Apache-2.0", ("the apache license version 2.0", "apache license version 2.0", "apache license 2.0", "the apache 2.0 license", "apache 2.0")),
    ("GPL3ref", "GPL-3.0", ("the gnu general public license version 3", "the gnu general public license v3.0", "the gnu gpl version 3", "gnu gplv3", "the gplv3 license")),
    ("GPL2ref", "GPL-2.0", ("the gnu general public license version 2", "the gnu general public license v2.0", "the gnu gpl version 2", "gnu gplv2", "the gplv2 license")),
    ("LGPL3ref", "LGPL-3.0", ("the gnu lesser general public license version 3", "the gnu lgpl version 3", "gnu lgplv3")),
    ("LGPL21ref", "LGPL-2.1", ("the gnu lesser general public license version 2.1", "the gnu lgpl version 2.1", "gnu lgplv2.1")),
    ("AGPL3ref", "AGPL-3.0", ("the gnu affero general public license version 3", "the gnu agpl version 3", "gnu agplv3")),
    ("MPL2ref", "MPL-2.0", ("the mozilla public license version 2.0", "the mozilla public license 2.0", "mpl 2.0")),
    ("BSD3ref", "BSD-3-Clause", ("the bsd 3 clause license", "a bsd 3 clause license", "the new bsd license", "the modified bsd license")),
    ("BSD2ref", "BSD-2-Clause", ("the bsd 2 clause license", "a bsd 2 clause license", "the simplified bsd license", "the freebsd license")),
    ("CCBYNC4ref", "CC-BY-NC-4.0", ("cc by nc 4.0", "a creative commons attribution noncommercial 4.0 international license")),
    ("CCBYSA4ref", "CC-BY-SA-4.0", ("cc by sa 4.0", "a creative commons attribution sharealike 4.0 international license")),
    ("CCBYND4ref", "CC-BY-ND-4.0", ("cc by nd 4.0", "a creative commons attribution noderivatives 4.0 international license")),
    ("CCBY4ref", "CC-BY-4.0", ("cc by 4.0", "a creative commons attribution 4.0 international license")),
    ("CC0ref", "CC0-1.0", ("cc0 1.0", "the cc0 1.0 universal license")),
    ("ISCref", "ISC", ("the isc license", "isc license")),
    ("Zlibref", "Zlib", ("the zlib license", "zlib license")),
    ("BSL1ref", "BSL-1.0", ("the boost software license version 1.0", "the boost software license 1.0")),
    ("EPL2ref", "EPL-2.0", ("the eclipse public license version 2.0", "the eclipse public license 2.0")),
    ("Artistic2ref", "Artistic-2.0", ("the artistic license version 2.0", "the artistic license 2.0")),
    ("Unlicenseref", "Unlicense", ("the unlicense", "the unlicense license")),
)
GRANTS = (
    "licensed under", "released under", "distributed under", "available under", "made available under", "dual licensed under",
    "this work is licensed under", "this project is licensed under", "this software is licensed under", "this program is licensed under",
    "this file is licensed under", "this code is licensed under", "this project is released under", "this software is released under",
    "this software is distributed under",
)
SENTENCES = OWN_SENTENCES + tuple(
    (identifier, f"{grant} {name}") for identifier, _, names in NAMED for name in names for grant in GRANTS if any(k in f"{grant} {name}" for k in KEYWORDS)
)
#: (licence, identifiers); tried in this order
RULES = (
    ("MIT", ("MITtitle", "MITperm", "MITnotice", "AsIs", "NoLiability")),
    ("MIT", ("MITperm", "MITnotice", "AsIs", "NoLiability")),
    ("Apache-2.0", ("Apache2ref", "Apache2use", "Apache2copy", "Apache2asis", "Apache2see")),
    ("Apache-2.0", ("Apache2ref", "Apache2copy", "Apache2asis", "Apache2see")),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary")),
    ("GPL-3.0-or-later", ("GPLfree3", "GPLhope", "GPLsee", "GPLcopy")),
    ("GPL-2.0-or-later", ("GPLfree2", "GPLhope", "GPLsee", "GPLcopy")),
    ("GPL-3.0-or-later", ("GPLfree3",)),
    ("GPL-2.0-or-later", ("GPLfree2",)),
    ("MIT", ("MITperm",)),
    ("Apache-2.0", ("Apache2ref",)),
    ("GPL-3.0", ("GPL3ref",)),
    ("GPL-2.0", ("GPL2ref",)),
    ("LGPL-3.0", ("LGPL3ref",)),
    ("LGPL-2.1", ("LGPL21ref",)),
    ("AGPL-3.0", ("AGPL3ref",)),
    ("MPL-2.0", ("MPL2ref",)),
    ("BSD-3-Clause", ("BSD3ref",)),
    ("BSD-2-Clause", ("BSD2ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4ref",)),
    ("CC-BY-4.0", ("CCBY4ref",)),
    ("CC0-1.0", ("CC0ref",)),
    ("Unlicense", ("Unlicense",)),
    ("MIT", ("MITref",)),
    ("MIT", ("SpdxMIT",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("GPL-3.0-or-later", ("SpdxGPL3",)),
    ("BSD-3-Clause", ("SpdxBSD3",)),
    ("LicenseRef-none", ("AllRights",)),
    ("CC-BY-ND-4.0", ("CCBYND4ref",)),
    ("ISC", ("ISCref",)),
    ("Zlib", ("Zlibref",)),
    ("BSL-1.0", ("BSL1ref",)),
    ("EPL-2.0", ("EPL2ref",)),
    ("Artistic-2.0", ("Artistic2ref",)),
    ("Unlicense", ("Unlicenseref",)),
)
_CUT = "|"
#: In order: what starts a new sentence, and the marks that replace it.
CUTS = ((r"\n[ \t\r]*\n", f" {_CUT} "), (r"\n([ \t]*[A-Z][a-z])", f" {_CUT} $1"), (r"([.!?;:])[ \t\r\n]+", f"$1 {_CUT} "))


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order; some may be empty."""
    marked = F.regexp_replace(text, r"\|", " ")
    for pattern, mark in CUTS:
        marked = F.regexp_replace(marked, pattern, mark)
    plain = F.regexp_replace(F.lower(marked), r"[^a-z0-9.|]+", " ")
    return F.transform(F.split(plain, r"\|"), lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", ""))


def rule_text(identifiers: tuple[str, ...]) -> str:
    return "".join(f" {x} " for x in identifiers)


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids, n_sentence_ids, licenses (in rule order, each once, joined by "; "), leftover_ids.

    Every row is reported; without licence sentences the texts are empty and the count is 0.
    """
    known: dict[str, str] = {}
    for identifier, sentence in SENTENCES:
        known.setdefault(sentence, identifier)
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    maybe = F.lower(F.col(text)).rlike("|".join(KEYWORDS))
    ids = F.filter(F.transform(sentences(F.col(text)), lambda s: F.element_at(table, s)), lambda x: x.isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(maybe, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    sequence = F.coalesce(F.array_join(F.transform("ids", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), ""), F.lit(""))
    out = rows.select(
        "doc_id", F.coalesce(F.array_join("ids", " "), F.lit("")).alias("sentence_ids"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_sentence_ids"), sequence.alias("left0")
    )
    # rules one after another, each on what the ones before have left
    for i, (_, identifiers) in enumerate(RULES):
        pattern = rule_text(identifiers)
        out = out.withColumn(f"left{i + 1}", F.when(F.col(f"left{i}").contains(pattern), F.replace(F.col(f"left{i}"), F.lit(pattern), F.lit(" | "))).otherwise(F.col(f"left{i}")))
    hits = [F.when(F.col(f"left{i}") != F.col(f"left{i + 1}"), F.lit(name)) for i, (name, _) in enumerate(RULES)]
    left = F.btrim(F.regexp_replace(F.col(f"left{len(RULES)}"), "[ |]+", " "))
    return out.select("doc_id", "sentence_ids", "n_sentence_ids", F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), "; ").alias("licenses"), left.alias("leftover_ids"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def report_sql() -> str:
    """The same report over table documents, for DuckDB."""
    known: dict[str, str] = {}
    for identifier, sentence in SENTENCES:
        known.setdefault(sentence, identifier)
    marked = "regexp_replace(text, '\\|', ' ', 'g')"
    for pattern, mark in CUTS:
        marked = f"regexp_replace({marked}, '{pattern}', '{mark.replace('$1', chr(92) + '1')}', 'g')"
    plain = f"regexp_replace(lower({marked}), '[^a-z0-9.|]+', ' ', 'g')"
    values = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in known.items())
    steps, before = [], "r0"
    for k, (_, identifiers) in enumerate(RULES):
        steps.append(f"r{k + 1} AS (SELECT *, replace(left{k}, {_quoted(rule_text(identifiers))}, ' | ') AS left{k + 1} FROM {before})")
        before = f"r{k + 1}"
    hits = ", ".join(f"CASE WHEN left{k} <> left{k + 1} THEN {_quoted(name)} END" for k, (name, _) in enumerate(RULES))
    n = len(RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS row_no, string_split({plain}, '|') AS parts FROM documents),
s AS (SELECT row_no, i, regexp_replace(parts[i], '^[ .]+|[ .]+$', '', 'g') AS sentence FROM d, generate_series(1, len(parts)) AS g(i)),
f AS (SELECT row_no, string_agg(id, ' ' ORDER BY i) AS sentence_ids, count(*) AS n, string_agg(' ' || id || ' ', '' ORDER BY i) AS left0 FROM s JOIN known USING (sentence) GROUP BY row_no),
r0 AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n, 0) AS n_sentence_ids, coalesce(left0, '') AS left0 FROM d LEFT JOIN f USING (row_no)),
{", ".join(steps)},
h AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM r{n})
SELECT doc_id, sentence_ids, n_sentence_ids,
       coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(hits)), lambda i: list_position(hits, hits[i]) = i), lambda i: hits[i]), '; '), '') AS licenses,
       trim(regexp_replace(left{n}, '[ |]+', ' ', 'g')) AS leftover_ids
FROM h
"""
