import os
import random
import textwrap
import time

import pytest

from wayspan.llm.licences import BY_LENGTH, HINTS, KNOWN, filled, licences, matched, scan, spdx_names

#: The wording of common licences, a paragraph a line.
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.'
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice in the documentation."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF FITNESS ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.'
GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, {2}.\nThis {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.\nYou should have received a copy of the GNU {1}General Public License along with this {0}."
LATER = "either version {} of the License, or (at your option) any later version"
TEXTS = {
    "MIT": f"MIT License\nCopyright (c) 2020 Someone. All rights reserved.\n{GRANT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{WARRANTY}",
    "Apache-2.0": 'Copyright 2020 Someone\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": f"Copyright (c) 2020, Someone\nAll rights reserved.\n{BSD}\n{BSD_END}",
    "BSD-3-Clause": f"Copyright (c) 2020, Someone\n{BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{BSD_END}",
    "ISC": 'Copyright (c) 2020 Someone\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.\n2. Altered source versions must be plainly marked as such.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": f"Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use it.\n{WARRANTY}",
    "Unlicense": f"This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.\n{WARRANTY}",
    "GPL-3.0-or-later": GNU.format("program", "", LATER.format(3)),
    "GPL-2.0-or-later": GNU.format("program", "", LATER.format(2)).replace("software:", "software;").replace("Foundation,", "Foundation;"),
    "GPL-2.0": GNU.format("program", "", "version 2"),
    "LGPL-2.1-or-later": GNU.format("library", "Lesser ", LATER.format("2.1")).replace("Foundation,", "Foundation;"),
    "AGPL-3.0-or-later": GNU.format("program", "Affero ", LATER.format(3)),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def wrapped(text, mark, width=72):
    lines = [x for p in text.split("\n") for x in [*textwrap.wrap(p, width), ""]]
    return "\n".join((mark + x).rstrip() for x in lines)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_whole_texts(name):
    """As it is, in one paragraph, wrapped, in comments: exactly its own licence."""
    text = TEXTS[name]
    for form in (text, text.replace("\n", " "), wrapped(text, ""), wrapped(text, " * "), wrapped(text, "# "), wrapped(text, "// ", 60), "/*\n" + wrapped(text, "   ") + "\n*/"):
        assert scan("Some words before.\n\n" + form + "\n\nSome words behind.")[0] == [name], form


FOLDER = "/usr/share/common-licenses"
FULL = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0"}


@pytest.mark.parametrize("file", sorted(FULL))
def test_full_texts(file):
    if not os.path.exists(f"{FOLDER}/{file}"):
        pytest.skip("no such text here")
    with open(f"{FOLDER}/{file}", encoding="utf-8", errors="replace") as text:
        assert scan(text.read())[0] == [FULL[file]]


def test_mentions():
    assert scan("Words.\nLicensed under the Apache License, Version 2.0.\nMore words.") == (["Apache-2.0"], 1)
    assert scan("Words. This work is licensed under the GNU General Public License, version 3. End.")[0] == ["GPL-3.0"]
    assert scan("This project is licensed under the Apache License, Version 2.0.")[0] == ["Apache-2.0"]
    assert scan("Released under the MIT License.")[0] == ["MIT"]
    assert scan("Licensed under CC BY-NC 4.0.")[0] == ["CC-BY-NC-4.0"]
    assert scan("Released under the GPLv3.")[0] == ["GPL-3.0"] and scan("Distributed under the terms of the LGPL-2.1 or later.")[0] == ["LGPL-2.1-or-later"]
    assert scan("Licensed under the 3-clause BSD license.")[0] == ["BSD-3-Clause"]
    assert scan("It is licensed under the Foo terms.")[0] == ["UNKNOWN"]
    assert scan("Copyright 2020 X. All rights reserved.")[0] == ["all-rights-reserved"]
    assert scan("My driving licence is old. I permit you to go.")[0] == []
    assert scan(None) == scan("") == ([], 0)
    assert scan("Released under the MIT License.\n" * 3 + "Licensed under CC BY 4.0.") == (["CC-BY-4.0", "MIT"], 4)
    assert scan(TEXTS["MIT"] + "\n\n" + TEXTS["Zlib"])[0] == ["MIT", "Zlib"]


def test_spdx_expressions():
    assert scan("// SPDX-License-Identifier: BSD-3-Clause\nint x;")[0] == ["BSD-3-Clause"]
    assert scan("# spdx-license-identifier: apache-2.0")[0] == ["Apache-2.0"]
    assert spdx_names("(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0"]
    assert spdx_names("gpl-2.0+ */") == ["GPL-2.0-or-later"] and spdx_names("licenseref-own or mit") == ["licenseref-own", "MIT"]


def brute_matched(found):
    """The definition by recursion: the longest rule that fits at the left."""
    found = [x for x in found if x[0] != "copyright"]
    if not found:
        return []
    fits = [(lic, ids) for lic, ids in BY_LENGTH if [x[0] for x in found][: len(ids)] == list(ids)]
    if not fits:
        return (["UNKNOWN"] if found[0][0] == "unknown" else []) + brute_matched(found[1:])
    lic, ids = max(fits, key=lambda f: len(f[1]))
    return [filled(lic, found[: len(ids)]), *brute_matched(found[len(ids) :])]


def test_rules_against_brute_force():
    rng = random.Random(1)
    ids = [name for name, _ in KNOWN if not name.startswith(("text:", "spdx"))] + ["unknown"]
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 4)):
            found += [(i, {}) for i in rng.choice(BY_LENGTH)[1]] if rng.random() < 0.6 else [(rng.choice(ids), {})]
        assert matched(found) == brute_matched(found)


def test_long_texts_in_one_pass():
    for text in ("licensed " * 200_000, "license\n" * 100_000, "under the license " * 100_000, "*" * 500_000 + " license", "#" * 1000 + "\n* license" * 1000):
        began = time.time()
        scan(text)
        assert time.time() - began < 10, text[:20]


def test_rows(spark, odd, none):
    text = "Plain.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."
    got = licences(spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licences, r.n_sentences) for r in got) == [(1, ["CC-BY-NC-4.0", "MIT"], 2), (2, [], 0), (3, [], 0)]
    assert all(any(h in x for h in HINTS) for x in ("licensed under", "copyright", "warranty"))
    assert licences(odd, keep=odd.columns).count() == odd.count() and licences(none).count() == 0
