"""Licence texts by sentence rules, with DataFrame functions only.

Texts are cut into sentences, once at line ends and once with lines joined
inside paragraphs. A sentence is normalised (a-z and 0-9, one space between
words), a lead-in such as "this project is released under the terms of" becomes
"licensed under", a closing pointer such as "see the LICENSE file for details" goes, and
the sentence is mapped to the identifier of a known licence sentence. Sentences that only name a
licence come from ``NAMES`` and the SPDX identifiers. The known
identifiers of a text, in order, are matched against the ordered licence rules:
each rule is a sequence of identifiers; where it fits, its identifiers are used
up, so a shorter rule further down sees only what is left. Known sentences that
no rule uses are counted as loose. A licence counts as often as the better of
the two cuts finds it.

A null or empty text has no licence; repeated rows are scanned alike; a null
doc_id is kept. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
#: Texts without one of these hold no known sentence.
SCREEN = "licen|permission|redistribution|warranty|reserved|cc0|unencumbered|gpl|nor the names"

# Known sentences (normalised) by identifier.
SENTENCES = {
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license "
                     "is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not "
                 "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided "
                 "that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
                  "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                  "and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "nor the names of its contributors may be used to endorse or promote products derived from this "
                 "software without specific prior written permission",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even "
                "the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
# Names of licences (normalised, without a leading article), by SPDX identifier; a
# licence of unknown version or kind goes by its plain name.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license 2 0"),
    "MIT": ("mit license", "mit license mit", "expat license"),
    "ISC": ("isc license",),
    "BSD": ("bsd license",),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl",),
    "CC0-1.0": ("cc0 license", "creative commons zero v1 0 universal"),
}
CC = {"BY": "attribution", "BY-NC": "attribution noncommercial", "BY-SA": "attribution sharealike",
      "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike",
      "BY-NC-ND": "attribution noncommercial noderivatives"}
GNU = {"GPL": ("general", ("2.0", "3.0")), "LGPL": ("lesser general", ("2.1", "3.0")), "AGPL": ("affero general", ("3.0",))}
PUBLISHED = "as published by the free software foundation"
# Lead-ins and closing pointers of sentences that name a licence.
VERB = "(?:released|licensed|distributed|published|available|made available|provided|covered|dual licensed)"
LEAD = (rf"^(?:(?:this|the|these|our|all) (?:[a-z0-9]+ ){{1,4}}(?:is|are|has been|have been|may be) )?(?:hereby )?{VERB} "
        "(?:under|by|subject to) (?:the )?(?:terms of (?:the )?|terms and conditions of (?:the )?)?")
TAIL = (" (?:see (?:the )?(?:accompanying |included )?(?:file )?licen[sc]e(?: md| txt| file)*"
        "(?: for (?:more |further )?(?:details|information|the full text))?)$")
FREE = "^(?:this [a-z]+ is free software )?you can redistribute it and or modify it under the terms of the "
HOLDER = "^(?:.+ )?nor the names of its contributors"


def plain(name: str) -> str:
    """A name as the texts' sentences are written."""
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def gnu_names(short: str, kind: str, version: str) -> list[str]:
    """Ways to write one version of a GNU licence, without "only" or "or later"."""
    full, number = f"gnu {kind} public license", plain(version)
    out = [f"{n} {w}{v}" for n in (full, plain(short), f"gnu {plain(short)}") for w in ("version ", "v", "") for v in
           ([number, number[0]] if version.endswith(".0") else [number])]
    return [*out, f"{plain(short)}v{number[0]}" if version.endswith(".0") else f"{plain(short)}v{number}"]


def named() -> dict[str, str]:
    """Normalised sentences that name a licence, and what they name."""
    out: dict[str, str] = {}
    for lic, names in NAMES.items():
        out |= {f"licensed under {n}": f"line-{lic}" for n in (plain(lic), *names)}
    for part, words in CC.items():
        for v in ("3.0", "4.0"):
            out |= {f"licensed under {n}": f"line-CC-{part}-{v}" for n in (
                plain(f"CC {part} {v}"), plain(f"CC {part} {v} license"), plain(f"creative commons {words} {v} international license"),
                plain(f"creative commons {words} {v} license"), plain(f"creative commons {words} {v} international"))}
    for short, (kind, versions) in GNU.items():
        for v in versions:
            for n in gnu_names(short, kind, v):
                out[f"licensed under {n}"] = out[f"licensed under {n} only"] = f"line-{short}-{v}"
                for later in ("or later", "or any later version", "or at your option any later version"):
                    out[f"licensed under {n} {later}"] = f"line-{short}-{v}-or-later"
            n, name = f"gnu {kind} public license {PUBLISHED}", plain(v) if not v.endswith(".0") else v[0]
            for w in (f"version {name}", f"version {name} of the license"):
                out[f"free under {n} {w}"] = f"free-{short}-{v}"
                for either in ("either ", ""):
                    out[f"free under {n} {either}{w} or at your option any later version"] = f"free-{short}-{v}-or-later"
    for lic in (*NAMES, *(f"CC-{p}-{v}" for p in CC for v in ("3.0", "4.0"))):
        out[f"spdx license identifier {plain(lic)}"] = f"spdx-{lic}"
    for short, (_, versions) in GNU.items():
        for v in versions:
            for end, what in (("", ""), ("-only", ""), ("-or-later", "-or-later"), ("+", "")):
                out.setdefault(f"spdx license identifier {plain(short + '-' + v + end)}", f"spdx-{short}-{v}{what}")
    return out


#: Known sentences and their identifiers: the fixed ones, and those that name a licence.
KNOWN = {**{s: i for i, s in SENTENCES.items()}, **named()}
# Licence rules in order, longer ones first; a sentence that names a licence is a rule of its own.
RULES = (
    ("Apache-2.0", ("apache-the", "apache-not", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-not", "apache-copy", "apache-unless")),
    ("Apache-2.0", ("apache-the", "apache-not", "apache-copy")),
    ("Apache-2.0", ("line-Apache-2.0", "apache-not", "apache-copy", "apache-unless", "apache-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Unlicense", ("unlicense-free",)),
    ("MPL-2.0", ("mpl-terms",)),
    ("Apache-2.0", ("apache-the",)),
)
#: Sentences of a GNU notice around the one that names the licence; they belong to it.
AROUND = r"<free-([^>]+)>(?:<gpl-hope>)?(?:<gpl-see>)?"
ALONE = "<(?:line|spdx)-([^>]+)>"
FOUND = r"\[([^\]]+)\]"


#: Where sentences end, per cut: at every line end, or at empty lines.
CUTS = {"lines": r"\n", "paragraphs": rf"\n{SPACE}*\n"}
#: A semicolon inside a sentence of a notice, which ends no sentence.
INSIDE = "([Ss]oftware|[Ff]oundation);"
#: What is rewritten in a sentence before it is looked up.
NORMAL = ((TAIL, ""), (LEAD, "licensed under "), (FREE, "free under "),
          (HOLDER, "nor the names of its contributors"))


def _chain(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")


def sequence(text: Column, cut: str) -> Column:
    """Known identifiers of a text in order, as ``<id><id>...``."""
    # one literal map: its parts hold no comma
    known = F.map_from_arrays(*[F.split(F.lit(",".join(x)), ",") for x in (KNOWN, KNOWN.values())])
    ended = F.regexp_replace(F.regexp_replace(text, INSIDE, "$1,"), rf"([.!?;]){SPACE}+", "$1\n\n")
    words = F.transform(F.split(ended, CUTS[cut], -1), lambda s: F.trim(F.regexp_replace(
        F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    # sentences without one of these words are not known
    words = F.filter(words, lambda s: s.rlike(SCREEN))
    for pattern, to in NORMAL:
        words = F.transform(words, lambda s: F.regexp_replace(s, pattern, to))  # noqa: B023
    return _chain(F.filter(F.transform(words, lambda s: known[s]), lambda x: x.isNotNull()))


def _apply(seq: Column) -> Column:
    """The sequence with ``[licence]`` in place of the identifiers that a rule uses."""
    whole = reduce(lambda c, r: F.replace(c, F.lit("".join(f"<{i}>" for i in r[1])), F.lit(f"[{r[0]}]")),
                   RULES, seq)
    return F.regexp_replace(F.regexp_replace(whole, AROUND, "[$1]"), ALONE, "[$1]")


def _count(text: Column, part: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def _times(found: Column, name: Column) -> Column:
    return F.size(F.filter(found, lambda x: x == name))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, n_licenses, n_loose, identifiers`` per row: distinct licences
    (sorted, comma-joined), rule matches, loose known sentences, and the identifiers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    may = F.translate(F.col("text"), UPPER, LOWER).rlike(SCREEN)
    rows = rows.select("doc_id", *[F.when(may, sequence(F.col("text"), c)).otherwise(F.lit("")).alias(c)
                                   for c in CUTS])
    rows = rows.select("*", *[_apply(F.col(c)).alias(f"{c}_rules") for c in CUTS])
    rows = rows.select("*", *[F.regexp_extract_all(f"{c}_rules", F.lit(FOUND), F.lit(1)).alias(f"{c}_found")
                              for c in CUTS])
    names = F.array_sort(F.array_distinct(F.concat(*[f"{c}_found" for c in CUTS])))
    n = F.aggregate(names, F.lit(0).cast("bigint"), lambda acc, x: acc + F.greatest(
        *[_times(F.col(f"{c}_found"), x) for c in CUTS]))
    loose = F.least(*[_count(F.col(f"{c}_rules"), "<") for c in CUTS])
    longer = F.when(F.char_length("paragraphs") > F.char_length("lines"), F.col("paragraphs")).otherwise(F.col("lines"))
    return rows.select("doc_id", F.array_join(names, ",").alias("licenses"),
                       n.alias("n_licenses"),
                       loose.alias("n_loose"), longer.alias("identifiers"))


def oracle_sql() -> str:
    """The same in SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    sentence = "s"
    for pattern, to in NORMAL:
        sentence = f"regexp_replace({sentence}, '{pattern}', '{to}')"
    def used(seq: str) -> str:
        for lic, ids in RULES:
            seq = f"replace({seq}, '{''.join(f'<{i}>' for i in ids)}', '[{lic}]')"
        for pattern in (AROUND, ALONE):
            seq = f"regexp_replace({seq}, '{pattern}', '[\\1]', 'g')"
        return seq
    def count(col: str, part: str) -> str:
        return f"CAST((length({col}) - length(replace({col}, '{part}', ''))) // {len(part)} AS BIGINT)"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS cut, string_split_regex(ended, '{p}') AS p FROM e" for c, p in CUTS.items())
    return f"""
WITH e AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{INSIDE}', '\\1,', 'g'), '([.!?;]){SPACE}+', '\\1' || chr(10) || chr(10), 'g') AS ended
  FROM documents),
known(s, id) AS (VALUES {values}),
seg AS (
  SELECT doc_id, cut, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM ({parts}) AS u),
n AS (SELECT doc_id, cut, i, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s
      FROM seg),
m AS (SELECT doc_id, cut, i, {sentence} AS s FROM n WHERE regexp_matches(s, '{SCREEN}')),
q AS (SELECT doc_id, cut, string_agg('<' || id || '>', '' ORDER BY i) AS seq
      FROM m JOIN known ON known.s = m.s GROUP BY doc_id, cut),
r AS (
  SELECT documents.doc_id, coalesce(l.seq, '') AS l, coalesce(p.seq, '') AS p FROM documents
  LEFT JOIN q AS l ON l.doc_id = documents.doc_id AND l.cut = 'lines'
  LEFT JOIN q AS p ON p.doc_id = documents.doc_id AND p.cut = 'paragraphs'),
a AS (SELECT doc_id, l, p, {used('l')} AS lr, {used('p')} AS pr FROM r),
f AS (SELECT *, regexp_extract_all(lr, '{FOUND}', 1) AS lf, regexp_extract_all(pr, '{FOUND}', 1) AS pf FROM a),
g AS (SELECT *, list_sort(list_distinct(list_concat(lf, pf))) AS names FROM f)
SELECT doc_id, array_to_string(names, ',') AS licenses,
       CAST(coalesce(list_sum(list_transform(names, lambda x: greatest(
         len(list_filter(lf, lambda y: y = x)), len(list_filter(pf, lambda y: y = x))))), 0) AS BIGINT) AS n_licenses,
       least({count('lr', '<')}, {count('pr', '<')}) AS n_loose,
       CASE WHEN length(p) > length(l) THEN p ELSE l END AS identifiers
FROM g"""
