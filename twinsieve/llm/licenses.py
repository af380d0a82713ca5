"""Licence scans by sentence rules (operator 8), in SQL functions only.

A text becomes one stream of words: lower case, everything but letters, digits and plus signs a blank.  So line ends,
comment marks, long blanks and punctuation don't matter, and a known sentence is found wrapped, commented or followed
by a clause.  Known sentences (of licence texts, headers, and notices that name a licence) are mapped to identifiers, the leftmost first and the longest of those that begin at one
word; the sequence of identifiers is matched against ordered rules.  SPDX tags name licences by themselves; they are
read from the text as it is, and their identifiers (spdx:...) come after the sentences'.  Edge cases: null and empty texts match nothing;
repeated rows are scanned each; only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Ways to begin a notice, and what stands for each of them in the stream of words.
NOTICE = r"(?<! not)(?<! never) (?:licensed|released|distributed|available|published|provided|covered|offered|issued|shared) under (?:the terms (?:and conditions )?of )?(?:the |an? )?(?=[a-z])"
MARK = " ~ "
#: Ways to write a version before its number.
VERSION = r"(?: version| ver| v|(?<=pl)v) ?(?=[0-9])"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.+:-]*[) \t]*(?:(?:OR|AND|WITH)[ \t]+(?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.+:-]*[) \t]*)*)"


def normal(sentence: str) -> str:
    """What ``words`` makes of a sentence in ASCII, without the blanks around."""
    bare = re.sub(r"[^a-z0-9+]+", " ", sentence.lower()).strip().replace("licence", "license")
    return re.sub(NOTICE, MARK, re.sub(VERSION, " ", f" {bare} ")).strip()


def _short_names() -> dict[str, list[str]]:
    """Licences and the ways to name them in a notice."""
    written = lambda v: [v] + [v[:-2]] * v.endswith(".0")
    out = {
        "MIT": ["MIT", "MIT/X11", "MIT (Expat)", "Expat"], "X11": ["X11"], "ISC": ["ISC"], "0BSD": ["0BSD", "Zero-Clause BSD"], "Zlib": ["zlib", "zlib/libpng"],
        "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause", "2-clause BSD", "two-clause BSD", "Simplified BSD", "FreeBSD"],
        "BSD-3-Clause": ["BSD-3-Clause", "3-clause BSD", "three-clause BSD", "New BSD", "Modified BSD", "Revised BSD"],
        "BSD-4-Clause": ["BSD-4-Clause", "4-clause BSD", "four-clause BSD", "Original BSD"], "BSD": ["BSD", "BSD-style"],
        "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "BSL-1.0": ["Boost Software License 1.0", "BSL-1.0", "Boost Software License version 1.0"],
        "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    }
    for name, long, versions in (("Apache", "Apache License", ("1.0", "1.1", "2.0")), ("Apache", "Apache Software License", ("1.0", "1.1", "2.0")), ("MPL", "Mozilla Public License", ("1.0", "1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("CDDL", "Common Development and Distribution License", ("1.0", "1.1")), ("EUPL", "European Union Public Licence", ("1.0", "1.1", "1.2")), ("Artistic", "Artistic License", ("1.0", "2.0"))):
        for v in versions:
            out.setdefault(f"{name}-{v}", []).extend(f"{x} {n}" for n in written(v) for x in (long, name))
    for name, middle, versions in (("GPL", "General", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")), ("LGPL", "Library General", ("2.0",)), ("AGPL", "Affero General", ("1.0", "3.0"))):
        for v in versions:
            base = [x + t + n for n in written(v) for t in (" ", f" ({name}) ") for x in (f"{middle} Public License", f"GNU {middle} Public License")] + [f"{g}{name} {n}" for n in written(v) for g in ("", "GNU ")]
            out.setdefault(f"{name}-{v}", []).extend([*base, *(f"{x} only" for x in base)])
            out.setdefault(f"{name}-{v}-or-later", []).extend([f"{x}+" for x in base] + [f"{x} {t}" for x in base for t in ("or later", "or newer", "or any later", "or (at your option) any later")])
    kinds = {"BY": ("Attribution",), "BY-SA": ("Attribution ShareAlike", "Attribution Share Alike"), "BY-ND": ("Attribution NoDerivatives", "Attribution NoDerivs", "Attribution No Derivatives"), "BY-NC": ("Attribution NonCommercial", "Attribution Non Commercial"), "BY-NC-SA": ("Attribution NonCommercial ShareAlike", "Attribution Non Commercial Share Alike"), "BY-NC-ND": ("Attribution NonCommercial NoDerivatives", "Attribution NonCommercial NoDerivs", "Attribution Non Commercial No Derivatives")}
    for kind, longs in kinds.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names = [f"CC {kind}", f"Creative Commons {kind}", *longs, *(f"Creative Commons {x}" for x in longs)]
            out[f"CC-{kind}-{v}"] = [f"{x} {n}{t}" for x in names for n in written(v) for t in ("", " International", " Unported", " Generic")]
    return out


#: Identifiers that were given first.
_FIRST = {"Apache-2.0": "apache2", "CC-BY-NC-4.0": "ccbync4", "GPL-3.0": "gpl3"}
SHORT_NAMES = _short_names()
#: Identifiers that name a licence by themselves.
NAMES = {_FIRST.get(n, re.sub("[^a-z0-9]", "", n.lower())): n for n in SHORT_NAMES}
_BY_NAME = {n: i for i, n in NAMES.items()}


def _texts() -> list[tuple[str, str]]:
    """Identifiers and sentences of licence texts and headers."""
    gpl = [(f"{k}_grant", f"modify it under the terms of {the}GNU {m} Public License as published by the Free Software Foundation") for k, m in (("gpl", "General"), ("lgpl", "Lesser General"), ("lgpl", "Library General"), ("agpl", "Affero General")) for the in ("the ", "")]
    gpl += [(_BY_NAME[f"{k}-{v}"], f"under the terms of the GNU {m} Public License version {n} as published by the Free Software Foundation") for k, m, v in (("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0")) for n in {v, v.removesuffix(".0")}]
    titles = (("GPL-1.0", "GNU General Public License Version 1, February 1989"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("Apache-2.0", "Apache License Version 2.0, January 2004"))
    links = [(_BY_NAME[f"CC-{k}-{v}"], f"creativecommons.org/licenses/{k}/{v}") for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    return gpl + [(_BY_NAME[n], t) for n, t in titles] + links + [
        ("reserved", "All rights reserved"),
        ("apache2", "apache.org/licenses/LICENSE-2.0"), ("cc010", "creativecommons.org/publicdomain/zero/1.0"),
        ("apache_compliance", "you may not use this file except in compliance with the License"), ("apache_basis", "Unless required by applicable law or agreed to in writing"),
        *((f"gpl_{v.replace('.', '')}", f"version {v} of the License") for v in ("1", "2", "2.1", "3")), ("gpl_later", "or (at your option) any later version"), ("gpl_hope", "is distributed in the hope that it will be useful"),
        ("mpl20", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
        ("mpl10", "The contents of this file are subject to the Mozilla Public License Version 1.0"), ("mpl11", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
        ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("mit_condition", "shall be included in all copies or substantial portions of the Software"),
        ("mit_warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
        ("bsl_grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        *(("isc_grant", f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies") for x in ("and", "and/or")),
        *(("zero_grant", f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted") for x in ("and", "and/or")),
        ("isc_warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES'), ("isc_warranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES'),
        ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        *(("bsd_source", f"Redistributions of source code must retain the {x} copyright notice, this list of conditions and the following disclaimer") for x in ("above", "accompanying")),
        ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
        ("bsd_advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
        ("bsd_endorse", "may be used to endorse or promote products derived from this software without"),
        ("bsd_disclaimer", "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
        ("zlib_warranty", "This software is provided 'as-is', without any express or implied warranty"),
        ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
        ("zlib_origin", "The origin of this software must not be misrepresented"), ("zlib_altered", "Altered source versions must be plainly marked as such"), ("zlib_notice", "This notice may not be removed or altered from any source distribution"),
        ("free_domain", "This is free and unencumbered software released into the public domain"), ("free_grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ]


#: Known sentences as they are normalised, and their identifiers; a notice comes with and without the word "license".
SENTENCES = {normal(t): i for i, t in _texts()} | {f"{MARK.strip()} {normal(w)}{end}": _BY_NAME[n] for n, ways in SHORT_NAMES.items() for w in ways for end in ("", " license")}
#: Licences, the identifiers that must occur in this order, others between them allowed, and those that must not come between.
RULES = (
    ("MIT", ("mit_grant", "mit_condition", "mit_warranty"), ("bsl_grant", "free_domain")),
    ("MIT-0", ("mit_grant", "mit_warranty"), ("mit_condition", "bsl_grant", "free_domain")),
    ("ISC", ("isc_grant", "isc_warranty"), ("zero_grant",)),
    ("0BSD", ("zero_grant", "isc_warranty"), ("isc_grant",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_disclaimer"), ("bsd_endorse", "bsd_advert")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_disclaimer"), ("bsd_advert",)),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse", "bsd_disclaimer"), ()),
    ("BSL-1.0", ("bsl_grant", "mit_warranty"), ("mit_grant",)),
    ("Zlib", ("zlib_warranty", "zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"), ()),
    ("Unlicense", ("free_domain", "free_grant", "mit_warranty"), ("mit_grant",)),
    *((f"{k.upper()}-{v}-or-later", (f"{k}_grant", f"gpl_{n}", "gpl_later"), tuple(f"{x}_grant" for x in ("gpl", "lgpl", "agpl") if x != k)) for k, v, n in (("gpl", "1.0", "1"), ("gpl", "2.0", "2"), ("gpl", "3.0", "3"), ("lgpl", "2.0", "2"), ("lgpl", "2.1", "21"), ("lgpl", "3.0", "3"), ("agpl", "3.0", "3"))),
    *((f"{k.upper()}-{v}", (f"{k}_grant", f"gpl_{n}", "gpl_hope"), ("gpl_later", *(f"{x}_grant" for x in ("gpl", "lgpl", "agpl") if x != k))) for k, v, n in (("gpl", "1.0", "1"), ("gpl", "2.0", "2"), ("gpl", "3.0", "3"), ("lgpl", "2.0", "2"), ("lgpl", "2.1", "21"), ("lgpl", "3.0", "3"), ("agpl", "3.0", "3"))),
)
#: "All rights reserved" says nothing of its own right before one of these.
GRANTS = ("mit_grant", "bsl_grant", "isc_grant", "zero_grant", "bsd_grant", "gpl_grant", "lgpl_grant", "agpl_grant", "zlib_warranty", "zlib_grant", *NAMES)
#: Comment marks that are words, at the beginning of a line.
WORD_MARKS = r"(?im)^[ \t]*(?:dnl|rem)[ \t]"


def words(text: Column) -> Column:
    """The words of a text, with one blank before and after each; a notice's beginning is a mark, words for versions go."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, WORD_MARKS, " ")), r"[^\p{L}\p{M}\p{N}+]+", " ")
    bare = F.replace(F.replace(F.concat(F.lit(" "), F.trim(bare), F.lit(" ")), F.lit(" + "), F.lit(" ")), F.lit("licence"), F.lit("license"))
    return F.regexp_replace(F.regexp_replace(bare, VERSION, " "), NOTICE, MARK)


def pattern(sentences: list[str]) -> str:
    """A regular expression of all sentences, longest first, that branches word by word."""
    tree: dict = {}
    for s in sentences:
        node = tree
        for w in s.split(" "):
            node = node.setdefault(w, {})
        node[""] = {}

    def branch(node: dict) -> str:
        parts = [" " + re.escape(w) + branch(below) for w, below in sorted(node.items()) if w]
        parts += ["(?= )"] if "" in node else []
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return branch(tree)


def identified(text: Column) -> Column:
    """The identifiers of the known sentences in a text, in order."""
    known = F.create_map(*(F.lit(x) for kv in SENTENCES.items() for x in kv))
    found = F.regexp_extract_all(words(text), F.lit(pattern(list(SENTENCES))), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.trim(s)))


def tagged(text: Column) -> Column:
    """The licences that SPDX tags name, in order; exceptions after WITH aren't licences."""
    plain = lambda x: F.regexp_replace(x, r"(?i)[ \t]WITH[ \t]+\S+", " ")
    named = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.split(plain(x), r"[\s()]+")))
    return F.filter(F.transform(named, lambda x: F.regexp_replace(x, r"[.:-]+$", "")), lambda x: (x != "") & ~F.lower(x).isin("or", "and", "none", "noassertion"))


def _matches(ids: tuple[str, ...], barred: tuple[str, ...]) -> Column:
    """Whether ``ids`` occur in this order with none of ``barred`` between: a walk that counts those seen so far."""
    n = len(ids)

    def step(k: Column, x: Column) -> Column:
        out = k
        for i, wanted in enumerate(ids):
            out = F.when((k == i) & (x == wanted), F.lit(i + 1)).otherwise(out)
        return F.when(k == n, k).when(x.isin(*barred), F.lit(0)).otherwise(out) if barred else out

    return F.aggregate("sentence_ids", F.lit(0), step) == n


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in order), licenses (sorted names of the rules that match)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identified(text_or_empty()).alias("sentence_ids"), tagged(text_or_empty()).alias("tags"))
    whole = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    known = F.create_map(*(F.lit(x) for n in {*NAMES.values(), *(n for n, _, _ in RULES)} for x in (n.lower(), n)))
    joined = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    names = [F.when(joined.rlike(f",reserved,(?!(?:{'|'.join(GRANTS)}),)"), F.lit("Proprietary")), *(F.when(_matches(ids, barred), F.lit(name)) for name, ids, barred in RULES)]
    single = F.transform("sentence_ids", lambda x: F.try_element_at(whole, x))
    of_tags = F.transform("tags", lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x))
    found = F.array_sort(F.array_distinct(F.filter(F.concat(single, F.array(*names), of_tags), lambda x: x.isNotNull())))
    none = F.array().cast("array<string>")
    ids = F.concat("sentence_ids", F.transform("tags", lambda x: F.concat(F.lit("spdx:"), F.lower(x))))
    return rows.select("doc_id", ids.alias("sentence_ids"), F.when((F.size("sentence_ids") > 0) | (F.size("tags") > 0), found).otherwise(none).alias("licenses"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))
