"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences, the sentences are normalised, and those that a
table knows become sentence identifiers, in order. Ordered rules then take
runs of identifiers off the sequence: the first rule whose run occurs names a
licence and uses the run up, so a specific rule shields a general one.

Everything is an expression of one row: no shuffle, no join, no Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a line that goes on in lower case, or amid a licence's name, belongs to the line before it (capture 1: its beginning)
WRAPPED = r"[ \t]*\r?\n[ \t*#/;>|-]*([a-z(]|Foundation\b|Software Foundation|Public License|General Public|Lesser General|Affero General|License,)"
#: a line that ends amid a reference to a licence, or amid a holder's name, goes on in the next one (capture 1: its end)
UNFINISHED = (r"(\b[Uu]nder(?: the| a| an)?(?: terms of(?: the)?)?|\bterms of(?: the)?|\bname of(?: the)?|\bLicen[cs]e,|"
              r"\b(?:MIT|BSD|ISC|Apache|GNU|Mozilla|Eclipse|Creative|Commons|Affero|Lesser|General|Clause))[ \t]*\r?\n[ \t*#/;>|-]*")
#: a machine-readable reference ends with its identifier (capture 1)
TAGGED = r"(SPDX-License-Identifier:[ \t]*[A-Za-z0-9.+-]+)"
#: a full stop that ends no sentence (captures 1 and 2: around it)
ABBREVIATION = r"\b(Inc|Ltd|Co|Corp)\.,?[ \t]+(nor|and|or)\b"
SENTENCE_END = r"[.!?;]+[ \t]+|[.!?;:]*[ \t]*[\r\n]+|[.!?;:]+$"
ANCHOR = r"licen|copyright|permission|redistribut|warrant|rights reserved|free software|public domain|creative commons|copying and distribution"
#: every anchor holds one of these, so a text without any has no sentence to look up
IN_ANCHORS = ["licen", "copyright", "permission", "redistribut", "warrant", "reserved", "software", "domain", "commons", "distribution"]
NOT_WORD = r"[^a-z0-9]+"
MARK = "|"

# Published licence names and the sentences by which texts refer to them.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0"],
    "MIT": ["mit license", "expat license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "BSD": ["bsd license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gnu gpl v2", "gpl v2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gnu gpl v3", "gpl v3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgpl v2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lgpl version 3", "lgpl v3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu agpl version 3", "agpl v3"],
    "Unlicense": ["unlicense"],
}
CC_PARTS = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
#: a reference by name: (the text is) licensed under (the terms of the) NAME (license)
REFERENCE = (r"^(?:(?:this|the|all|our)(?: [a-z]+){1,4} (?:is|are) |it is |content is |text is )?(?:dual )?"
             r"(?:licensed|released|distributed|published|available|made available|provided) under (?:the terms of )?(?:the |a |an )?(.+)$")
NAME_TAIL = r"(?: international| unported)?(?: public)?(?: licen[cs]e)?(?: the licen[cs]e)?$"
#: whose name a clause protects
HOLDER = r"^neither the names? of .+ nor the names? of (?:its|their|any|the) (?:other )?contributors? may "
ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors may "
SPDX = "spdx license identifier "
GNU_SUBJECT = r"^(?:this [a-z]+|it|the [a-z]+) is free software "

#: identifier, sentences (normalised) that stand for it
SENTENCES = {
    "all_rights": ["all rights reserved"],
    "no_rights": ["no rights reserved", "this work is in the public domain", "released into the public domain",
                  "this is free and unencumbered software released into the public domain"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                  "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                  "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                  "furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
              "merchantability fitness for a particular purpose and noninfringement"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies",
                  "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                  "conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                   "disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                  "derived from this software without specific prior written permission"],
    "apache_only": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at"],
    "apache_asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as "
                    "is basis without warranties or conditions of any kind either express or implied"],
    "apache_limits": ["see the license for the specific language governing permissions and limitations under the license"],
    "mpl_terms": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "gnu_warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                     "warranty of merchantability or fitness for a particular purpose"],
    "gnu_copy": ["you should have received a copy of the gnu general public license along with this program"],
    "fsfap": ["copying and distribution of this file with or without modification are permitted in any medium without royalty provided the "
              "copyright notice and this notice are preserved"],
}
GNU = [("GPL", "general", "2"), ("GPL", "general", "3"), ("LGPL", "lesser general", "2 1"), ("LGPL", "lesser general", "3"), ("AGPL", "affero general", "3")]


def _gnu(family: str, version: str) -> str:
    return f"{family}-{version.replace(' ', '.')}" + ("" if " " in version else ".0")


def name_table() -> dict[str, str]:
    """Licence name, normalised and without its tail -> licence."""
    out = {re.sub(NAME_TAIL, "", n): k for k, ns in NAMES.items() for n in ns}
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            short, long, v = kind.lower().replace("-", " "), " ".join(CC_PARTS[p] for p in kind.split("-")), version.replace(".", " ")
            for n in (f"cc {short} {v}", f"creative commons {short} {v}", f"creative commons {long} {v}"):
                out[n] = f"CC-{kind}-{version}"
    return out


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {s: k for k, sentences in SENTENCES.items() for s in sentences}
    for family, words, version in GNU:
        terms = (f"this program is free software you can redistribute it and or modify it under the terms of the gnu {words} public license "
                 f"as published by the free software foundation")
        out[f"{terms} either version {version} of the license or at your option any later version"] = f"gnu:{_gnu(family, version)}-or-later"
        out[f"{terms} version {version} of the license"] = f"gnu:{_gnu(family, version)}"
        out[f"{terms} version {version}"] = f"gnu:{_gnu(family, version)}"
    # machine-readable references; "only" is what the plain number says
    for k in [k for k in NAMES if k != "BSD"] + [f"CC-{kind}-{v}" for kind in CC_KINDS for v in CC_VERSIONS]:
        out[SPDX + re.sub(NOT_WORD, " ", k.lower())] = f"name:{k}"
    for family, _, version in GNU:
        k = _gnu(family, version)
        out[SPDX + re.sub(NOT_WORD, " ", f"{k}-only".lower())] = f"name:{k}"
        out[SPDX + re.sub(NOT_WORD, " ", f"{k}-or-later".lower())] = f"gnu:{k}-or-later"
    return out


def rules() -> list[tuple[str, list[str]]]:
    """(licence, run of identifiers), specific rules first."""
    out = [
        ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
        ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
        ("MIT", ["name:MIT", "mit_grant", "mit_notice"]),
        ("MIT", ["mit_grant", "mit_notice"]),
        ("MIT", ["mit_grant"]),
        ("ISC", ["isc_grant"]),
        ("Apache-2.0", ["name:Apache-2.0", "apache_only", "apache_copy", "apache_asis", "apache_limits"]),
        ("Apache-2.0", ["name:Apache-2.0", "apache_only", "apache_copy"]),
        ("Apache-2.0", ["name:Apache-2.0", "apache_only"]),
        ("MPL-2.0", ["mpl_terms"]),
        ("FSFAP", ["fsfap"]),
    ]
    for family, _, version in GNU:
        for suffix in ("-or-later", ""):
            k = f"{_gnu(family, version)}{suffix}"
            out += [(k, [f"gnu:{k}", "gnu_warranty", "gnu_copy"]), (k, [f"gnu:{k}", "gnu_warranty"]), (k, [f"gnu:{k}"])]
    out += [(k, [f"name:{k}"]) for k in NAMES]
    out += [(f"CC-{kind}-{v}", [f"name:CC-{kind}-{v}"]) for kind in CC_KINDS for v in CC_VERSIONS]
    return [*out, ("Public-Domain", ["no_rights"]), ("BSD", ["bsd_grant"]), ("All-Rights-Reserved", ["all_rights"])]


def _token(identifier: str) -> str:
    return f"<{identifier}>"


def run_text(identifiers: list[str]) -> str:
    return "".join(map(_token, identifiers))


def sentences(text: Column) -> Column:
    """Normalised sentences with an anchor word; every known sentence has one."""
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        text, TAGGED, "$1. "), UNFINISHED, "$1 "), WRAPPED, " $1"), ABBREVIATION, "$1 $2")
    cut = F.filter(F.split(lines, SENTENCE_END), lambda s: F.lower(s).rlike(ANCHOR))
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " ")))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def identify(sentence: Column) -> Column:
    """Identifier of a normalised sentence, or null; ``name:X`` is a reference to licence X."""
    known = _map(sentence_table())[F.regexp_replace(F.regexp_replace(sentence, GNU_SUBJECT, "this program is free software "), HOLDER, ANY_HOLDER)]
    name = F.regexp_replace(F.regexp_extract(sentence, REFERENCE, 1), NAME_TAIL, "")
    return F.coalesce(known, F.concat(F.lit("name:"), _map(name_table())[name]))


def scan(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and, of every row: ``sentences``, the known
    sentences' identifiers in order, joined by commas; ``licenses``, the licences of
    the rules that matched, in rule order, joined by commas; ``unmatched``, the
    number of identifiers no rule used. A kept column of one of these names is replaced.

    * null or empty text, or one without a known sentence: both lists empty, 0;
    * a licence that occurs several times is listed once; ties: rule order;
    * very long texts: every sentence is looked up; rows are independent, so
      repeated rows get equal results and an empty table gives none.
    """
    new = ["sentences", "licenses", "unmatched"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    low = F.lower(F.col(text_col))
    possible = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in IN_ANCHORS])
    known = F.when(possible, F.filter(F.transform(sentences(F.col(text_col)), identify), lambda k: k.isNotNull())).otherwise(
        F.array().cast("array<string>"))
    listed = F.array(*[F.struct(F.lit(run_text(ids)).alias("run"), F.lit(name).alias("name")) for name, ids in rules()])
    start = F.struct(F.array_join(F.transform("_gf_ids", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "").alias("left"),
                     F.array().cast("array<string>").alias("found"))
    matched = F.aggregate(listed, start, lambda acc, r: F.when(
        F.contains(acc["left"], r["run"]),
        F.struct(F.replace(acc["left"], r["run"], F.lit(MARK)).alias("left"), F.array_append(acc["found"], r["name"]).alias("found"))).otherwise(acc))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], known.alias("_gf_ids"))
    # most rows know no sentence: the rules run over the others only
    some = F.when(F.size("_gf_ids") > 0, matched)
    return rows.withColumn("_gf_m", some).select(
        *[F.col(f"`{c}`") for c in keep], F.array_join("_gf_ids", ",").alias("sentences"),
        F.coalesce(F.array_join(F.array_distinct("_gf_m.found"), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.length(F.regexp_replace("_gf_m.left", "[^<]", "")), F.lit(0)).alias("unmatched"))


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL, from the same tables."""
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def values(table: dict[str, str]) -> str:
        return ", ".join(f"({q(s)}, {q(k)})" for s, k in sorted(table.items()))

    sql = f"""WITH known(s, k) AS (VALUES {values(sentence_table())}), names(name, lic) AS (VALUES {values(name_table())}),
    cut AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
                   {q(TAGGED)}, '\\1. ', 'g'), {q(UNFINISHED)}, '\\1 ', 'g'), {q(WRAPPED)}, ' \\1', 'g'), {q(ABBREVIATION)}, '\\1 \\2', 'g'), {q(SENTENCE_END)}) AS a FROM documents),
    one AS (SELECT r, unnest(a) AS s, unnest(range(len(a))) AS i FROM cut),
    norm AS (SELECT r, i, trim(regexp_replace(lower(s), {q(NOT_WORD)}, ' ', 'g')) AS s FROM one WHERE regexp_matches(lower(s), {q(ANCHOR)})),
    named AS (SELECT r, i, regexp_replace(regexp_replace(s, {q(GNU_SUBJECT)}, 'this program is free software '), {q(HOLDER)}, {q(ANY_HOLDER)}) AS s,
                     regexp_replace(regexp_extract(s, {q(REFERENCE)}, 1), {q(NAME_TAIL)}, '') AS name FROM norm),
    looked AS (SELECT r, i, coalesce(k, 'name:' || lic) AS k FROM named LEFT JOIN known USING (s) LEFT JOIN names USING (name)),
    ids AS (SELECT r, list(k ORDER BY i) AS ks FROM looked WHERE k IS NOT NULL GROUP BY r),
    s0 AS (SELECT doc_id, ks, coalesce(array_to_string(['<' || t || '>' for t in ks], ''), '') AS x, CAST([] AS VARCHAR[]) AS f
           FROM cut LEFT JOIN ids USING (r))"""
    n = 0
    for n, (name, ids) in enumerate(rules(), 1):
        run = q(run_text(ids))
        sql += f""",
    s{n} AS (SELECT doc_id, ks, replace(x, {run}, '{MARK}') AS x, CASE WHEN contains(x, {run}) AND NOT list_contains(f, {q(name)}) THEN list_append(f, {q(name)}) ELSE f END AS f FROM s{n - 1})"""
    return sql + f"""
    SELECT doc_id, coalesce(array_to_string(ks, ','), '') AS sentences, array_to_string(f, ',') AS licenses,
           CAST(length(regexp_replace(x, '[^<]', '', 'g')) AS INTEGER) AS unmatched FROM s{n}"""
