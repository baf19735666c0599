"""Licence scan by sentence rules, with DataFrame operations only.

A text is cut into sentences; normalised (lower case, runs of other characters than letters
and digits as one space), a sentence that is in the table of known licence sentences stands
for its identifier. The identifiers in the order of the text are matched against rules, each
a licence and the sentences that have to follow one another. Sentences that aren't in the table
may stand between; known ones only where ``BETWEEN`` allows them. At each sentence the longest
rule that starts there is taken and uses up its sentences, so a part of a licence that is a
licence of its own isn't reported beside it.

Sentences end at marks before a blank and at blank lines. At a line's end one may end or go
on, behind a comment prefix too, as licence texts are wrapped; the longest known sentence
counts. A table sentence with such a mark inside is looked for across it.

All of it is one expression over a row: nothing is exploded, joined or shuffled, and the
sentence table is a fixed list. The expression that finds sentences is a trie of their words, so
that a place in a text is given up at the first word that goes on no sentence, however many there are.

Defined cases: null and empty texts have no sentences and no licences; repeated sentences
stay in the sequence; a licence found by several rules is named once; rows that repeat an id
are scanned row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import read_table

# Sentences of public licences and of the usual notices, by identifier.
SENTENCES = {
    "apache.notice": "Licensed under the Apache License, Version 2.0.",
    "apache.may": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache.comply": "you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit.notice": "Released under the MIT License.",
    "mit.licensed": "Licensed under the MIT License.",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                 "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                 "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.include": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the Software.",
    "mit.asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
                "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version.",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                 "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                 "option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                 "the following conditions are met:",
    "bsd.name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                "products derived from this software without specific prior written permission.",
    "bsd.asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
                "PURPOSE ARE DISCLAIMED.",
    "ccby.notice": "Licensed under CC BY 4.0.",
    "ccbysa.notice": "Licensed under CC BY-SA 4.0.",
    "ccbync.notice": "Licensed under CC BY-NC 4.0.",
    "ccbync.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccby.long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0.notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "rights.reserved": "All rights reserved.",
    "agpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version.",
    "lgpl.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version.",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                  "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.advertising": "All advertising materials mentioning features or use of this software must display the following "
                       "acknowledgement:",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
                "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
                  "alter it and redistribute it freely, subject to the following restrictions:",
    "mpl.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
}
# Fixed values: (rule, licence, the sentences in order).
RULES = (
    ("apache-notice", "Apache-2.0", ("apache.notice",)),
    ("apache-header", "Apache-2.0", ("apache.may", "apache.copy", "apache.asis")),
    ("mit-notice", "MIT", ("mit.notice",)),
    ("mit-licensed", "MIT", ("mit.licensed",)),
    ("mit-text", "MIT", ("mit.grant", "mit.include", "mit.asis")),
    ("gpl3-notice", "GPL-3.0", ("gpl3.notice",)),
    ("gpl3-header", "GPL-3.0", ("gpl.free", "gpl.hope")),
    ("gpl2-header", "GPL-2.0", ("gpl2.free", "gpl.hope")),
    ("bsd3-text", "BSD-3-Clause", ("bsd.grant", "bsd.name", "bsd.asis")),
    ("bsd2-text", "BSD-2-Clause", ("bsd.grant", "bsd.asis")),
    ("ccby-notice", "CC-BY-4.0", ("ccby.notice",)),
    ("ccby-long", "CC-BY-4.0", ("ccby.long",)),
    ("ccbysa-notice", "CC-BY-SA-4.0", ("ccbysa.notice",)),
    ("ccbync-notice", "CC-BY-NC-4.0", ("ccbync.notice",)),
    ("ccbync-long", "CC-BY-NC-4.0", ("ccbync.long",)),
    ("cc0-notice", "CC0-1.0", ("cc0.notice",)),
    ("reserved", "proprietary", ("rights.reserved",)),
    ("agpl3-header", "AGPL-3.0", ("agpl.free", "gpl.hope")),
    ("lgpl21-header", "LGPL-2.1", ("lgpl.free", "lgpl.hope")),
    ("bsd4-text", "BSD-4-Clause", ("bsd.grant", "bsd.advertising", "bsd.name", "bsd.asis")),
    ("isc-text", "ISC", ("isc.grant", "isc.asis")),
    ("zlib-text", "Zlib", ("zlib.asis", "zlib.grant")),
    ("mpl2-header", "MPL-2.0", ("mpl.form",)),
    ("unlicense-text", "Unlicense", ("unlicense.free",)),
)
# Known sentences that may stand before and between a rule's own, by rule. A copyright
# line's "All rights reserved." above a licence of several sentences belongs to that licence.
BETWEEN = {
    "apache-header": ("apache.comply",),
    "bsd2-text": ("bsd.source", "bsd.binary"),
    "bsd3-text": ("bsd.source", "bsd.binary"),
    "bsd4-text": ("bsd.source", "bsd.binary"),
}
# Short notices are a lead and a licence's name, each with each.
LEADS = {
    "licensed": "Licensed under", "released": "Released under", "distributed": "Distributed under",
    "available": "Available under", "work": "This work is licensed under", "project": "This project is licensed under",
    "software": "This software is licensed under", "file": "This file is licensed under",
}
NAMES = {
    "apache2": ("Apache-2.0", "the Apache License, Version 2.0"), "apache2s": ("Apache-2.0", "the Apache License 2.0"),
    "mit": ("MIT", "the MIT License"), "isc": ("ISC", "the ISC License"), "zlib": ("Zlib", "the zlib License"),
    "bsd2": ("BSD-2-Clause", "the BSD 2-Clause License"), "bsd3": ("BSD-3-Clause", "the BSD 3-Clause License"),
    "gpl2": ("GPL-2.0", "the GNU General Public License, version 2"),
    "gpl3": ("GPL-3.0", "the GNU General Public License, version 3"),
    "lgpl21": ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    "lgpl3": ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    "agpl3": ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    "mpl2": ("MPL-2.0", "the Mozilla Public License 2.0"), "boost": ("BSL-1.0", "the Boost Software License, Version 1.0"),
    "ccby": ("CC-BY-4.0", "CC BY 4.0"), "ccbysa": ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    "ccbync": ("CC-BY-NC-4.0", "CC BY-NC 4.0"), "ccbynd": ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    "ccbyncsa": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), "cc0": ("CC0-1.0", "CC0 1.0"),
}

# What is done to a lower-cased text, in order. Form feeds end a sentence, line feeds may.
_STEPS = (
    ("\\r\\n?", "\n"),
    # a mark at a line's end, or a blank line, with the prefixes around it
    ("(?:[.!?;:][ \\t]*\\n|\\n[^\\p{L}\\p{N}\\n]*\\n)[^\\p{L}\\p{N}]*", "\f"),
    ("\\n[^\\p{L}\\p{N}\\n\\f]*", "\n"),
    ("[.!?;:][ \\t]+", "\f"),
    ("[^\\p{L}\\p{N}\\n\\f]+", " "),
)
_MARK = "[.!?;:][ \\t]+"


def normalised(sentence: str) -> str:
    """A sentence of the table as texts' sentences are normalised."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


def _with_notices(sentences: dict[str, str], rules: tuple) -> tuple[dict[str, str], tuple]:
    """The tables and what LEADS and NAMES add; a sentence that is there already keeps its rule."""
    sentences, known = dict(sentences), {normalised(s) for s in sentences.values()}
    for key, (licence, name) in NAMES.items():
        for lead, words in LEADS.items():
            if normalised(f"{words} {name}") not in known:
                sentences[f"{key}.{lead}"] = f"{words} {name}."
                rules += ((f"{key}-{lead}", licence, (f"{key}.{lead}",)),)
    return sentences, rules


SENTENCES, RULES = _with_notices(SENTENCES, RULES)


def _pattern(sentences) -> str:
    """Finds the known sentences (group 1) between ends of sentences or lines in a text after _STEPS."""
    trie: dict = {}
    for sentence in sentences:
        node, gap = trie, ""
        for part in filter(None, map(normalised, re.split(_MARK, sentence))):
            for word in part.split():
                node, gap = node.setdefault((gap, word), {}), "[ \\n]+"
            gap = "[ \\n\\f]+"
        node[()] = None

    def ways(node) -> str:
        # going on comes before ending, so the longest sentence is found
        found = [gap + word + ways(child) for (gap, word), child in sorted((k, v) for k, v in node.items() if k)]
        found += [""] if () in node else []
        return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"

    return f"(?:\\A|[\\n\\f]) ?({ways(trie)})(?= ?(?:[\\n\\f]|\\z))"


def _bars(names) -> str:
    """Identifiers as they stand in a sequence: each has its own bars, so that neighbours match too."""
    return "".join(f"|{name}|" for name in names)


def _allowed(rule: tuple, between: dict) -> tuple[str, ...]:
    """Known sentences that may stand before and between a rule's own."""
    name, _, order = rule
    extra = (*between.get(name, ()), *(("rights.reserved",) if len(order) > 1 else ()))
    return tuple(s for s in extra if s not in order)


def _rules_pattern(rules, between: dict) -> tuple[str, str]:
    """(finds rules in a sequence, the longest that starts at a sentence first; finds the sentences
    of a match that aren't the rule's own)."""
    found, allowed = [], set()
    for rule in sorted(rules, key=lambda r: -len(r[2])):
        extra = _allowed(rule, between)
        allowed.update(extra)
        skip = "(?:" + "|".join(re.escape(_bars([s])) for s in extra) + ")*" if extra else ""
        found.append("".join(skip + re.escape(_bars([s])) for s in rule[2]))
    return "|".join(found), "|".join(re.escape(_bars([s])) for s in sorted(allowed)) or "(?!)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None,
         rules=RULES, between: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per input row: id, sequence (array of sentence identifiers), rules and licences
    (arrays, sorted)."""
    sentences = sentences or SENTENCES
    known = {normalised(s): name for name, s in sentences.items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    plain = F.translate(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "\f", " ")
    for step, to in _STEPS:
        plain = F.regexp_replace(plain, step, to)
    met = F.regexp_extract_all(plain, F.lit(_pattern(sentences.values())), F.lit(1))
    names = F.transform(met, lambda s: F.element_at(table, F.regexp_replace(s, "[ \\n\\f]+", " ")))
    found = docs.select(F.col(id_col).alias("id"), names.alias("sequence"))
    pattern, skipped = _rules_pattern(rules, BETWEEN if between is None else between)
    named = F.create_map(*[F.lit(x) for name, licence, order in rules for x in (_bars(order), f"{name}\t{licence}")])
    bars = F.concat(F.lit("|"), F.array_join("sequence", "||"), F.lit("|"))
    hits = F.transform(F.regexp_extract_all("bars", F.lit(pattern), F.lit(0)), lambda m: F.coalesce(
        F.try_element_at(named, m), F.try_element_at(named, F.regexp_replace(m, skipped, ""))))
    out = found.withColumn("bars", bars).withColumn("hits", F.array_sort(F.array_distinct(hits)))
    return out.select(
        "id", "sequence", F.transform("hits", lambda h: F.substring_index(h, "\t", 1)).alias("rules"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.substring_index(h, "\t", -1)))).alias("licences"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.array_join("licences", ",").alias("licences"),
        F.array_join("rules", ",").alias("rules"), F.array_join("sequence", ",").alias("sequence"),
        F.size("sequence").cast("long").alias("n_sentences"))


def _sql() -> str:
    pairs = ", ".join(f"('{normalised(s)}', '{n}')" for n, s in SENTENCES.items())
    longest = max(len(normalised(s)) for s in SENTENCES.values())
    rules = ", ".join(f"('{n}', '{lic}', '{_bars(order)}')" for n, lic, order in RULES)
    pattern, skipped = _rules_pattern(RULES, BETWEEN)
    return rf"""
WITH known(body, name) AS (VALUES {pairs}), rules(rule, licence, body) AS (VALUES {rules}),
cut AS (SELECT row_number() OVER () AS n, doc_id,
  string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r]+', '\1' || chr(10), 'g'), '[\r\n]+') AS parts FROM documents),
plain AS (SELECT n, i, trim(regexp_replace(lower(parts[i]), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS body
  FROM (SELECT n, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut) WHERE length(parts[i]) BETWEEN 1 AND {2 * longest}),
seq AS (SELECT n, string_agg(name, ',' ORDER BY i) AS sequence, '|' || string_agg(name, '||' ORDER BY i) || '|' AS bars,
  count(*) AS n_sentences FROM plain JOIN known USING (body) GROUP BY n),
met AS (SELECT n, unnest(regexp_extract_all(bars, '{pattern}')) AS run FROM seq),
own AS (SELECT DISTINCT n, CASE WHEN run IN (SELECT body FROM rules) THEN run ELSE regexp_replace(run, '{skipped}', '', 'g') END AS body FROM met),
hit AS (SELECT n, string_agg(rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM own JOIN rules USING (body) GROUP BY n)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(rules, '') AS rules, coalesce(sequence, '') AS sequence,
  coalesce(n_sentences, 0)::BIGINT AS n_sentences
FROM cut LEFT JOIN seq USING (n) LEFT JOIN hit USING (n)
"""


SQL = _sql()
