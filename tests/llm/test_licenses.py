"""The licence scan against brute force over words."""

import random
import re

from twinsieve.llm import licenses


def scanned(make, texts):
    return {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(make(list(enumerate(texts)))).collect()}


def test_sentences_survive_wrapping_marks_and_clauses(make):
    texts = [
        "# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use it otherwise.",
        "/*\n * Released   under\n * the MIT\n * License.\n */",
        "// All rights\n//   reserved.",
        "dnl This work is licensed under the GNU General\ndnl Public License, version 3.",
        "x" * 300 + " and it is licensed under CC BY-NC 4.0, " + "y" * 300,
        "Small rights reserved. Licensed under the Apache Licenses.",
        None,
    ]
    assert [x for _, x in sorted(scanned(make, texts).items())] == [(["apache2"], ["Apache-2.0"]), (["mit"], ["MIT"]), (["reserved"], ["Proprietary"]), (["gpl3"], ["GPL-3.0"]), (["ccbync4"], ["CC-BY-NC-4.0"]), ([], []), ([], [])]


MIT = """Copyright (c) 2020 Someone. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in it.
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in it.",
    "3. Neither its name nor theirs may be used to endorse or promote products derived from this software without permission.",
    "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
]
GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation, either version {} of the License{}.\n * It is distributed in the hope that it will be useful."
LATER = ", or\n * (at your option) any later version"


def test_texts_headers_and_tags(make):
    cases = [
        (MIT, ["MIT"]),
        (MIT.replace("shall be included", "may be left"), ["MIT-0"]),
        ("\n".join(reversed(MIT.split("\n"))), ["Proprietary"]),
        ("\n".join(BSD), ["BSD-3-Clause"]),
        ("\n".join(BSD[:3] + BSD[4:]), ["BSD-2-Clause"]),
        ("\n".join(BSD[:3] + BSD[4:] + BSD), ["BSD-2-Clause", "BSD-3-Clause"]),
        ("\n".join(reversed(BSD)), []),
        (GPL.format("", "3", LATER), ["GPL-3.0-or-later"]),
        (GPL.format("Lesser ", "2.1", LATER), ["LGPL-2.1-or-later"]),
        (GPL.format("", "2", ""), ["GPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0.", ["MPL-2.0"]),
        ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR mit\n", ["GPL-2.0-only", "MIT"]),
        ("<!-- SPDX-License-Identifier: Own-1.0 -->", ["Own-1.0"]),
        ("Distributed under the terms of the GNU GPL v2 or later.", ["GPL-2.0-or-later"]),
        ("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported Licence", ["CC-BY-SA-3.0"]),
        ("see https://creativecommons.org/licenses/by-nc-nd/4.0/", ["CC-BY-NC-ND-4.0"]),
        ("It is not released under the MIT license.", []),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES", ["ISC"]),
    ]
    got = scanned(make, [t for t, _ in cases])
    assert [got[i][1] for i in range(len(cases))] == [x for _, x in cases]


def brute_ids(text):
    """At each word the longest known sentence, then on after it."""
    stream, out, i = licenses.normal(text).split(" "), [], 0
    most = max(len(s.split(" ")) for s in licenses.SENTENCES)
    while i < len(stream):
        n = next((n for n in range(most, 0, -1) if " ".join(stream[i : i + n]) in licenses.SENTENCES and i + n <= len(stream)), 0)
        out += [licenses.SENTENCES[" ".join(stream[i : i + n])]] if n else []
        i += n or 1
    return out


def brute_rules(ids):
    out = {licenses.NAMES[i] for i in ids if i in licenses.NAMES}
    out |= {"Proprietary" for a, b in zip(ids, [*ids[1:], ""]) if a == "reserved" and b not in licenses.GRANTS}
    for name, wanted, barred in licenses.RULES:
        between = rf",(?:(?!(?:{'|'.join(barred) or '!'}),)[^,]+,)*"
        out |= {name} if re.search("," + between.join(wanted) + ",", f",{','.join(ids)},") else set()
    return sorted(out)


def test_against_brute_force(make):
    draw = random.Random(5)
    texts = [t for _, t in licenses._texts()] + [f"Licensed under the {w}" for ways in licenses.SHORT_NAMES.values() for w in ways]
    hot = [t for i, t in licenses._texts() if i.split("_")[0] in ("mit", "bsd", "gpl", "isc", "zero", "reserved")]
    rows = [draw.choice([" ", "\n", "\n# ", "; "]).join(draw.choice([hot, texts, ["other words", "the license", "version 2"]])[-1] if draw.random() < 0.1 else draw.choice(draw.choice([hot, hot, texts])) for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    got = scanned(make, rows)
    for i, t in enumerate(rows):
        ids = brute_ids(t)
        assert got[i] == (ids, brute_rules(ids)), t
