"""Whole headers as they stand in real files."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from paceline.llm import license_scan

sys.path.append(str(Path(__file__).parent.parent))
from comparing import database, same  # noqa: E402

CHROMIUM = """// Copyright 2015 The Chromium Authors
//
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//    * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.
//    * Redistributions in binary form must reproduce the above
// copyright notice, this list of conditions and the following disclaimer
// in the documentation and/or other materials provided with the
// distribution.
//    * Neither the name of Google Inc. nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission.
//
// THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
// "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
// LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
// A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
// OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
// SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.
"""
REGENTS = """/*-
 * Copyright (c) 1992, 1993
 *      The Regents of the University of California.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 * 3. Neither the name of the University nor the names of its contributors
 *    may be used to endorse or promote products derived from this software
 *    without specific prior written permission.
 *
 * THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
 * ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
 * ARE DISCLAIMED.
 */
"""
APACHE = """#
# Copyright 2020 Jane Doe
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above
copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = "BSDGrant,BSDSource,BSDBinary,BSDEndorse,BSDAsIs"
BSD2 = "\n".join(x for x in CHROMIUM.split("\n") if not any(w in x for w in ("Neither", "contributors may be used", "this software without")))


@pytest.mark.parametrize(
    ("text", "ids", "licence"),
    [
        (CHROMIUM, BSD + ",?", "BSD-3-Clause"),
        (REGENTS, BSD, "BSD-3-Clause"),
        (BSD2, "BSDGrant,BSDSource,BSDBinary,BSDAsIs,?", "BSD-2-Clause"),
        (APACHE, "ApacheLic,ApacheComply,ApacheObtain,ApacheWarranty,ApacheSee", "Apache-2.0"),
        (MIT, "MITTitle,MITGrant,MITNotice,MITAsIs", "MIT"),
        ("Licensed under the MIT License\n\nhttps://example.org/x", "MITShort", "MIT"),
        ("Some prose\nCopyright Jane Doe\nReleased under the MIT License.", "MITShort", "MIT"),
    ],
    ids=["chromium", "regents", "bsd2", "apache", "mit", "url", "name"],
)
def test_whole_headers(docs_of, text, ids, licence):
    got = license_scan.scan(docs_of([text])).first()
    assert (got["sentence_ids"], got["licences"]) == (ids, licence)


GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with this software."""


def test_more_licences(docs_of):
    texts = [
        GNU.format(kind=""),
        GNU.format(kind="Affero "),
        CC0,
        "// SPDX-License-Identifier: Apache-2.0\n// some code",
        "/* SPDX-License-Identifier: MIT */",
        "# SPDX-License-Identifier: GPL-3.0-or-later\nimport this",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "This code is not licensed under the MIT License.",
    ]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(docs_of(texts)).collect()}
    want = ["GPL-3.0-or-later", "AGPL-3.0-or-later", "CC0-1.0", "Apache-2.0", "MIT", "GPL-3.0-or-later", "EPL-2.0", ""]
    assert [got[k] for k in range(len(texts))] == want


def test_unknown_sentences_may_lie_between(docs_of):
    text = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nA word on the license here.\nSee the License for the specific language governing permissions and limitations under the License."
    got = license_scan.scan(docs_of([text])).first()
    assert got["licences"] == "Apache-2.0" and "?" in got["sentence_ids"]


APACHE_TOP = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
BSD_RESERVED = """Copyright (c) 2020 Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
#: Everyday lines and the licences they name.
LINES = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0"),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0-only)", "MIT,GPL-2.0-only"),
    ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
    ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("/* SPDX-License-Identifier: GPL-2.0+ WITH Linux-syscall-note */", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: MIT AND FooBar-1.0", "MIT"),
    ("Licensed under the MIT License or the Apache License, Version 2.0.", "MIT,Apache-2.0"),
    ("The terms of the GNU General Public License v3.0 apply.", "GPL-3.0-only"),
    ("This is available under either the GPL version 2 or later, or the LGPL v3.", "GPL-2.0-or-later,LGPL-3.0-only"),
    ("Released under the BSD 3-Clause license and CC BY 4.0.", "BSD-3-Clause,CC-BY-4.0"),
    (APACHE_TOP, "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\n Copyright (C) 1989", "GPL-2.0-only"),
    ("MIT-licensed; see LICENSE.", "MIT"),
    ("License: MIT\nName: x", "MIT"),
    ("License: see the file", ""),
    (BSD_RESERVED, "BSD-2-Clause"),
    ("- licensed under CC0\n- All rights reserved", "CC0-1.0"),
    ("All rights reserved.", "Proprietary"),
    ("This code is not licensed under the MIT license.", ""),
    ("Nobody says which license this has.", ""),
    ("", ""),
    (None, ""),
]


def test_everyday_lines_and_their_sql(spark, docs_of):
    docs = docs_of([t for t, _ in LINES])
    got = license_scan.scan(docs)
    assert [r["licences"] for r in got.orderBy("doc_id").collect()] == [want for _, want in LINES]
    same(got.toPandas(), database("/root/testdata/sf0.001", {"documents": docs.toPandas()}).sql(license_scan.ORACLE).df())


def test_headers_and_their_sql(spark, docs_of):
    docs = docs_of([CHROMIUM, REGENTS, APACHE, APACHE_TOP, BSD_RESERVED, "", None])
    same(license_scan.scan(docs).toPandas(), database("/root/testdata/sf0.001", {"documents": docs.toPandas()}).sql(license_scan.ORACLE).df())
