"""License scans by known sentences and ordered rules.

A text is cut into normalised sentences.  Sentences that speak of licensing are
mapped to identifiers of known licence sentences (others become ``?``), and the
identifier sequence of the document is matched against ordered rules: a rule
names a licence by a run of identifiers; longer and more specific rules come
first and consume what they match.  Unknown sentences may lie between those of a
run.  An ``SPDX-License-Identifier`` line is a sentence too.

``SPDX-License-Identifier`` lines, and ``License:`` lines that hold nothing else,
are expressions: each of their identifiers (but what follows ``WITH``) is one,
old names included.  A sentence that is not known, but says under which licences
something stands, gives the licences it names, in its order; one that says that
something is *not* licensed so gives none.

Everything is done per row with built-in functions: no shuffle, no Python.

Defined results: a null or empty text has no sentences; copyright notices are
read but name no licence; a line ``All rights reserved`` counts as proprietary
only where nothing else is named; repeated rows and ties get equal results
(licences stand in the order in which the text names them); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import table

#: Known licence sentences in normal form -> identifier (fixed values).
SENTENCES = {
    "licensed under the apache license, version 2.0": "ApacheShort",
    "licensed under the apache license, version 2.0 (the \"license\")": "ApacheLic",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0": "ApacheObtain",
    "you may obtain a copy of the license at https://www.apache.org/licenses/license-2.0": "ApacheObtain",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITShort",
    "licensed under the mit license": "MITShort",
    "this project is licensed under the mit license": "MITShort",
    "the mit license (mit)": "MITTitle",
    "mit license": "MITTitle",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITAsIs",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "this work is licensed under the gnu general public license, version 3": "GPL3Short",
    "licensed under the gnu general public license, version 3": "GPL3Short",
    "this work is licensed under the gnu general public license, version 2": "GPL2Short",
    "licensed under the gnu general public license, version 2": "GPL2Short",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "GPL3Grant",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "GPL2Grant",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "licensed under the gnu lesser general public license, version 3": "LGPL3Short",
    "licensed under the gnu lesser general public license, version 2.1": "LGPL21Short",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "MPL2Grant",
    "licensed under cc by 4.0": "CCBY4",
    "licensed under cc by-sa 4.0": "CCBYSA4",
    "licensed under cc by-nc 4.0": "CCBYNC4",
    "licensed under cc by-nd 4.0": "CCBYND4",
    "licensed under cc by-nc-sa 4.0": "CCBYNCSA4",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version": "LGPL21Grant",
    "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "LGPL3Grant",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "AGPL3Grant",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, version 3": "AGPL3Only",
    "licensed under the gnu affero general public license, version 3": "AGPL3Short",
    "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLWarranty",
    "see the gnu lesser general public license for more details": "LGPLSee",
    "see the gnu affero general public license for more details": "AGPLSee",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLCopy",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLCopy",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": "MPL2Obtain",
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/": "MPL2Obtain",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution": "EPL1Grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "EPL2Grant",
    "to the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0Grant",
    "this software is distributed without any warranty": "CC0Warranty",
    "you should have received a copy of the cc0 public domain dedication along with this software": "CC0Copy",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CCBYSA4",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CCBYNC4",
    "this work is licensed under the creative commons attribution 4.0 international license": "CCBY4",
    "this work is licensed under the creative commons attribution-sharealike 4.0 international license": "CCBYSA4",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following": "BSLGrant",
    "distributed under the boost software license, version 1.0": "BSLShort",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZlibGrant",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UnlicenseFree",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0BSDGrant",
    "do what the fuck you want to public license": "WTFPLTitle",
    "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the work and such derivative works in source or object form": "ApacheGrant",
    "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": "",
    "all rights reserved": "AllRights",
}
PROPRIETARY = "Proprietary"
#: Ordered rules: licence, run of identifiers (fixed values).
RULES = [
    ("Apache-2.0", ("ApacheLic", "ApacheComply", "ApacheObtain", "ApacheWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheLic", "ApacheComply", "ApacheObtain")),
    ("Apache-2.0", ("ApacheLic",)),
    ("Apache-2.0", ("ApacheShort",)),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITAsIs")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("MIT", ("MITTitle", "MITGrant")),
    ("MIT", ("MITGrant",)),
    ("MIT", ("MITShort",)),
    ("MIT", ("MITTitle",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("ISC", ("ISCGrant",)),
    ("GPL-3.0-or-later", ("GPL3Grant", "GPLWarranty", "GPLSee", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPL2Grant", "GPLWarranty", "GPLSee", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPL3Grant",)),
    ("GPL-2.0-or-later", ("GPL2Grant",)),
    ("GPL-3.0-only", ("GPL3Short",)),
    ("GPL-2.0-only", ("GPL2Short",)),
    ("LGPL-3.0-only", ("LGPL3Short",)),
    ("LGPL-2.1-only", ("LGPL21Short",)),
    ("MPL-2.0", ("MPL2Grant",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-ND-4.0", ("CCBYND4",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4",)),
    ("LGPL-2.1-or-later", ("LGPL21Grant", "LGPLWarranty", "LGPLSee", "LGPLCopy")),
    ("LGPL-3.0-or-later", ("LGPL3Grant", "LGPLWarranty", "LGPLSee", "LGPLCopy")),
    ("LGPL-2.1-or-later", ("LGPL21Grant",)),
    ("LGPL-3.0-or-later", ("LGPL3Grant",)),
    ("AGPL-3.0-or-later", ("AGPL3Grant", "GPLWarranty", "AGPLSee", "AGPLCopy")),
    ("AGPL-3.0-only", ("AGPL3Only", "GPLWarranty", "AGPLSee", "AGPLCopy")),
    ("AGPL-3.0-or-later", ("AGPL3Grant",)),
    ("AGPL-3.0-only", ("AGPL3Only",)),
    ("AGPL-3.0-only", ("AGPL3Short",)),
    ("EPL-1.0", ("EPL1Grant",)),
    ("EPL-2.0", ("EPL2Grant",)),
    ("CC0-1.0", ("CC0Grant", "CC0Warranty", "CC0Copy")),
    ("CC0-1.0", ("CC0Grant",)),
    ("CC0-1.0", ("CC0Copy",)),
    ("BSL-1.0", ("BSLGrant",)),
    ("BSL-1.0", ("BSLShort",)),
    ("Zlib", ("ZlibGrant",)),
    ("Unlicense", ("Unlicense", "UnlicenseFree")),
    ("Unlicense", ("Unlicense",)),
    ("Unlicense", ("UnlicenseFree",)),
    ("0BSD", ("0BSDGrant",)),
    ("WTFPL", ("WTFPLTitle",)),
    ("Apache-2.0", ("ApacheTitle", "ApacheGrant")),
    ("Apache-2.0", ("ApacheTitle",)),
    ("Apache-2.0", ("ApacheGrant",)),
    ("GPL-3.0-only", ("GPL3Title",)),
    ("GPL-2.0-only", ("GPL2Title",)),
    ("LGPL-3.0-only", ("LGPL3Title",)),
    ("LGPL-2.1-only", ("LGPL21Title",)),
    ("AGPL-3.0-only", ("AGPL3Title",)),
    ("MPL-2.0", ("MPL2Title",)),
    ("BSL-1.0", ("BSLTitle",)),
    (PROPRIETARY, ("AllRights",)),
]
#: An identifier of an expression, or a name in a sentence, stands for its licence outright.
SPDX = "spdx-license-identifier"
LICENCES = sorted({name for name, _ in RULES} - {PROPRIETARY})
RULES += [(licence, (f"{kind}-{licence}",)) for licence in LICENCES for kind in ("SPDX", "Named")]
#: Identifiers of expressions as they were written before (fixed values).
OLD_NAMES = {
    "gpl-2.0": "GPL-2.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only", "gpl-3.0+": "GPL-3.0-or-later",
    "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.1+": "LGPL-2.1-or-later", "lgpl-3.0": "LGPL-3.0-only", "lgpl-3.0+": "LGPL-3.0-or-later",
    "agpl-3.0": "AGPL-3.0-only", "agpl-3.0+": "AGPL-3.0-or-later", "bsd-2-clause-freebsd": "BSD-2-Clause", "bsd-2-clause-netbsd": "BSD-2-Clause",
    "apache-2.0+": "Apache-2.0", "mpl-2.0+": "MPL-2.0", "epl-1.0+": "EPL-1.0", "epl-2.0+": "EPL-2.0",
}
EXPRESSION_IDS = {name.lower(): f"SPDX-{name}" for name in LICENCES} | {old: f"SPDX-{name}" for old, name in OLD_NAMES.items()}
_V = r"(?:,)? ?(?:version |v\.? ?|-)?"
_LATER = r"(?:\+|,? or (?:\(at your option\) |at your option )?(?:any )?(?:later|newer))"
_GNU = {"GPL": r"(?:gnu general public license|gnu gpl|\bgpl)", "LGPL": r"(?:gnu lesser general public license|gnu lgpl|\blgpl)", "AGPL": r"(?:gnu affero general public license|gnu agpl|\bagpl)"}
#: Names of licences in sentences -> licence; a pattern may have one that overrules it.
NAMES: dict[str, tuple[str, str | None]] = {
    "Apache-2.0": (rf"\bapache(?: software)?(?: license)?{_V}2(?:\.0)?\b", None),
    "MIT": (r"\b(?:mit|expat)[ -]licensed?\b", None),
    "BSD-3-Clause": (r"\b(?:bsd[ -]3[ -]clause|3[ -]clause bsd|(?:new|modified|revised) bsd)\b", None),
    "BSD-2-Clause": (r"\b(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd)\b", None),
    "ISC": (r"\bisc[ -]licensed?\b", None),
    "MPL-2.0": (rf"\b(?:mozilla public license|mpl){_V}2(?:\.0)?\b", None),
    "EPL-1.0": (rf"\b(?:eclipse public license|epl){_V}1\.0\b", None),
    "EPL-2.0": (rf"\b(?:eclipse public license|epl){_V}2(?:\.0)?\b", None),
    "BSL-1.0": (r"\bboost software license\b", None),
    "Zlib": (r"\bzlib[ -]licensed?\b", None),
    "Unlicense": (r"\bunlicense\b", None),
    "CC0-1.0": (r"\b(?:cc0|creative commons zero)\b", None),
    "CC-BY-4.0": (r"\bcc[ -]by[ -]4\.0\b|creative commons attribution 4\.0", None),
    "CC-BY-SA-4.0": (r"\bcc[ -]by-sa[ -]4\.0\b|creative commons attribution-sharealike 4\.0", None),
    "CC-BY-NC-4.0": (r"\bcc[ -]by-nc[ -]4\.0\b|creative commons attribution-noncommercial 4\.0", None),
    **{
        f"{kind}-{version}-{how}": (rf"{_GNU[kind]}{_V}{number}{_LATER if how == 'or-later' else ''}", None if how == "or-later" else rf"{_GNU[kind]}{_V}{number}{_LATER}")
        for kind, version, number in (("GPL", "2.0", r"2(?:\.0)?"), ("GPL", "3.0", r"3(?:\.0)?"), ("LGPL", "2.1", r"2\.1"), ("LGPL", "3.0", r"3(?:\.0)?"), ("AGPL", "3.0", r"3(?:\.0)?"))
        for how in ("or-later", "only")
    },
}
#: What makes a sentence one about the licences it names, and what makes it one against.
SAYS = r"\b(?:under|terms of|subject to|governed by|covered by)\b|[ -]licensed\b"
DENIES = r"\b(?:not|never|neither|no longer)(?: be| been)? (?:licensed|released|distributed|available|provided|published|offered|under|covered|governed)\b|n't (?:be )?(?:licensed|released|distributed|available|under)\b"
#: Every sentence above holds one of these; a text without them is passed over.
CRITICAL = r"licen[cs]e|\b[al]?gpl\b|\bcc0\b|copyright|rights reserved|warrant|permission|redistribut|public domain|gnu general public|is free to copy|copy of the mpl"
#: A line that begins so begins a sentence, whatever the line before ends with.
OPENERS = "spdx-license-identifier|this library is|this software is|this program and the accompanying|distributed under the boost|permission is granted|anyone is free|to the extent possible|licensed under|released under|this work is|this project is|this program is|this source code|this is free|permission is hereby|permission to use|redistribution and use|all rights reserved|copyright|the mit license|mit license"
BLANK = r"[ \t\n\x0B\f\r]"
CUT = "\x01"
#: Comment leaders and bullets; a line may have several.
LEADERS = r"//+|/\*+|\*+/?|#+|;+|--+|-[ \t]|[•·]|\(?[0-9]{1,2}\)[ \t]"
#: Words after ``copyright`` that go on with a sentence; years, (c) and names begin a notice.
GOES_ON = "notices?|holders?|owners?|laws?|licenses?|permissions?|statements?|protection|information|interests?|claims?|infringement|treat(?:y|ies)|and|or|in|of|is|to|as"
#: Sentences that name their holder -> identifier.  A cut at ``Inc. `` leaves the part from ``nor``.
_ENDORSE = "to endorse or promote products derived from this software without (specific )?prior written permission"
PATTERNS = {
    f"^(neither the names? of .+ )?nor the names? of .+ may be used {_ENDORSE}$": "BSDEndorse",
    f"^the names? of .+ may not be used {_ENDORSE}$": "BSDEndorse",
    '^this software is provided by .+ "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed$': "BSDAsIs",
    r"^apache license,? version 2\.0, january 2004": "ApacheTitle",
    "^gnu general public license,? version 3, 29 june 2007": "GPL3Title",
    "^gnu general public license,? version 2, june 1991": "GPL2Title",
    "^gnu lesser general public license,? version 3, 29 june 2007": "LGPL3Title",
    r"^gnu lesser general public license,? version 2\.1, february 1999": "LGPL21Title",
    "^gnu affero general public license,? version 3, 19 november 2007": "AGPL3Title",
    r"^mozilla public license,? version 2\.0$": "MPL2Title",
    r"^boost software license - version 1\.0": "BSLTitle",
}
_ID = "[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
_EXPRESSION = rf"\(*{_ID}\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*{_ID}\)*)*"
#: Steps of normalisation of a lower-case text, in order: pattern and what replaces it ($1: its group).
NORMAL = [
    ("licence", "license"),
    ("[“”‘’`]", '"'),
    ("[\"']{2,}", '"'),
    (rf"(^|\n)[ \t]*(?:(?:{LEADERS})[ \t]*)+", "$1"),
    (rf"\bat{BLANK}+(https?://)", "at $1"),
    (rf"{SPDX}[ \t]*:[ \t]*({_EXPRESSION})", f"{CUT}{SPDX}=$1{CUT}"),
    (rf"(?:^|\n)license[ \t]*:[ \t]*({_EXPRESSION})[ \t]*(?:\n|\z)", f"{CUT}{SPDX}=$1{CUT}"),
    (rf"[.!?;:](?:{BLANK}+|\z)", CUT),
    (rf"\n{BLANK}*\n", CUT),
    (rf"\n[ \t]*(copyrights?{BLANK}+(?:{GOES_ON})\b)", " $1"),
    (rf"\n[ \t]*({OPENERS})", f"{CUT}$1"),
    (rf"{BLANK}+", " "),
]


def normalised(text: Column) -> Column:
    """Lower case, without comment leaders and quote variants, CUT between sentences."""
    t = F.lower(text)
    for pattern, by in NORMAL:
        t = F.regexp_replace(t, pattern, by)
    return t


def _pieces() -> dict[str, str]:
    """Known sentences by piece: an inner ``: `` or ``; `` is a cut, so the first
    piece that is critical stands for the sentence; later pieces are fillers."""
    out: dict[str, str] = {}
    for s, name in SENTENCES.items():
        parts = [p.strip() for p in re.split(r"[.!?;:] ", s)]
        parts = [p for p in parts if re.search(CRITICAL, p)]
        out.setdefault(parts[0], name)
        for p in parts[1:]:
            out.setdefault(p, "")
    return out


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def _identifiers(sentence: Column) -> Column:
    """Of an expression: an identifier each, ? for unknown ones."""
    plain = F.regexp_replace(F.substring(sentence, len(SPDX) + 2, 1 << 30), rf"\bwith[ \t]+{_ID}", "")
    ids = F.filter(F.regexp_extract_all(plain, F.lit(_ID), F.lit(0)), lambda x: ~x.isin("and", "or"))
    return F.transform(ids, lambda x: F.coalesce(F.element_at(_map(EXPRESSION_IDS), x), F.lit("?")))


def _named(sentence: Column) -> Column:
    """The licences a sentence names, in its order; ? for none."""
    found = []
    for licence, (pattern, but) in NAMES.items():
        fine = sentence.rlike(pattern) if but is None else sentence.rlike(pattern) & ~sentence.rlike(but)
        found.append(F.when(fine, F.struct(F.instr(sentence, F.regexp_extract(sentence, pattern, 0)).alias("at"), F.lit(f"Named-{licence}").alias("id"))))
    names = F.transform(F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())), lambda x: x["id"])
    says = sentence.rlike(SAYS) & ~sentence.rlike(DENIES)
    some = F.when(says, names).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("?")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, licences for each row."""
    text = F.when(F.lower("text").rlike(CRITICAL), F.col("text"))
    known = _map(_pieces())
    critical = F.filter(F.transform(F.split(normalised(text), CUT), lambda s: F.btrim(s)), lambda s: s.rlike(CRITICAL))
    held = lambda s: [F.when(s.rlike(p), F.lit(name)) for p, name in PATTERNS.items()]
    one = lambda s: F.coalesce(F.element_at(known, s), *held(s))
    named = lambda s: F.when(s.startswith(f"{SPDX}="), _identifiers(s)).when(one(s).isNotNull(), F.array(one(s))).otherwise(_named(s))
    ids = F.flatten(F.transform(F.filter(critical, lambda s: ~s.rlike("^copyright ")), named))
    rows = docs.select("doc_id", F.coalesce(F.filter(ids, lambda x: x != ""), F.array().cast("array<string>")).alias("ids"))
    chain = F.concat(F.lit("|"), F.array_join(F.filter("ids", lambda x: x != "?"), "||"), F.lit("|"))  # unknown sentences may lie between
    for licence, run in RULES:
        chain = F.replace(chain, F.lit("|" + "||".join(run) + "|"), F.lit(f"<{licence}>"))
    found = F.array_distinct(F.regexp_extract_all(F.when(F.size("ids") > 0, chain).otherwise(""), F.lit("<([^>]+)>"), F.lit(1)))
    told = F.when(F.size(found) > 1, F.filter(found, lambda x: x != PROPRIETARY)).otherwise(found)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.size(F.filter("ids", lambda x: x != "?")).cast("bigint").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(told, ",").alias("licences"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same scan, sentence by sentence, from the same tables."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in _pieces().items())
    text = "lower(text)"
    for pattern, by in NORMAL:
        text = f"regexp_replace({text}, {q(pattern)}, {q(by.replace('$1', chr(92) + '1'))}, 'g')"
    token = "CASE x " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EXPRESSION_IDS.items()) + " ELSE '?' END"
    plain = f"regexp_replace(substr(s, {len(SPDX) + 2}), {q(rf'{chr(92)}bwith[ {chr(92)}t]+{_ID}')}, '', 'g')"
    expression = f"list_transform(list_filter(regexp_extract_all({plain}, {q(_ID)}), lambda x: x NOT IN ('and', 'or')), lambda x: {token})"
    held = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN [{q(name)}]" for p, name in PATTERNS.items())
    fine = lambda p, but: f"regexp_matches(s, {q(p)})" + (f" AND NOT regexp_matches(s, {q(but)})" if but else "")
    names = ", ".join(f"CASE WHEN {fine(p, but)} THEN {{'at': strpos(s, regexp_extract(s, {q(p)})), 'id': {q('Named-' + licence)}}} END" for licence, (p, but) in NAMES.items())
    named = f"list_transform(list_sort(list_filter([{names}], lambda x: x IS NOT NULL)), lambda x: x.id)"
    says = f"regexp_matches(s, {q(SAYS)}) AND NOT regexp_matches(s, {q(DENIES)})"
    chain = "'|' || array_to_string(list_filter(ids, lambda z: z <> '?'), '||') || '|'"
    for licence, run in RULES:
        chain = f"replace({chain}, {q('|' + '||'.join(run) + '|')}, {q(f'<{licence}>')})"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
n AS (SELECT doc_id, {text} AS t FROM documents WHERE regexp_matches(lower(text), '{CRITICAL}')),
s AS (SELECT doc_id, unnest(range(1, len(string_split(t, chr(1))) + 1)) AS k, trim(unnest(string_split(t, chr(1)))) AS s FROM n),
i AS (SELECT doc_id, k, CASE WHEN starts_with(s, '{SPDX}=') THEN {expression} WHEN id IS NOT NULL THEN [id] {held} WHEN {says} AND len({named}) > 0 THEN {named} ELSE ['?'] END AS ids
      FROM s LEFT JOIN known USING (s) WHERE regexp_matches(s, '{CRITICAL}') AND NOT regexp_matches(s, '^copyright ')),
g AS (SELECT doc_id, list_filter(flatten(list(ids ORDER BY k)), lambda x: x <> '') AS ids FROM i GROUP BY doc_id),
m AS (SELECT doc_id, ids, {chain} AS chain FROM g WHERE len(ids) > 0),
x AS (SELECT doc_id, k, lic FROM (SELECT doc_id, unnest(range(1, len(regexp_extract_all(chain, '<([^>]+)>', 1)) + 1)) AS k,
             unnest(regexp_extract_all(chain, '<([^>]+)>', 1)) AS lic FROM m)),
w AS (SELECT doc_id, lic, min(k) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM x GROUP BY doc_id, lic),
y AS (SELECT doc_id, string_agg(lic, ',' ORDER BY k) AS licences FROM w WHERE lic <> '{PROPRIETARY}' OR n = 1 GROUP BY doc_id)
SELECT documents.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(len(list_filter(ids, lambda z: z <> '?')), 0)::BIGINT AS n_known,
       coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licences, '') AS licences
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN y USING (doc_id)
"""


ORACLE = _oracle()
