"""The official notices as published, however their lines are broken, and the usual wordings of references."""

import random
import re
import time
from collections import Counter

from tests.llm.fixtures import DOCS, rows
from tidemark.llm import licenses, queries
from tidemark.llm.licenses import scan_licenses

GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
NOTICES = [
    (GPL.replace("version 3", "version 2"), ["Gpl2Redistribute", "GplHope", "GplSee"], "GPL-2.0-or-later"),
    (GPL.replace("GNU General", "GNU Affero General"), ["AgplRedistribute", "GplHope", "AgplSee"], "AGPL-3.0-or-later"),
    (GPL.replace("GNU General", "GNU Lesser General"), ["LgplRedistribute", "GplHope", "LgplSee"], "LGPL-3.0-or-later"),
    (GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("This program is", "This library is"), ["Lgpl21Redistribute", "LgplHope", "LgplSee"], "LGPL-2.1-or-later"),
    (BSD2, ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability"], "BSD-2-Clause"),
    (ISC, ["IscGrant", "IscAsIs", "IscLiability"], "ISC"),
    (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), ["ZeroBsdGrant", "IscAsIs", "IscLiability"], "0BSD"),
    (MPL, ["MplHead", "MplCopy"], "MPL-2.0"),
    (UNLICENSE, ["UnlicenseHead", "UnlicenseGrant"], "Unlicense"),
    (ZLIB, ["ZlibAsIs", "ZlibGrant"], "Zlib"),
    (GPL, ["GplRedistribute", "GplHope", "GplSee"], "GPL-3.0-or-later"),
    (GPL.replace("This program", "Foobar"), ["GplRedistribute", "GplHope", "GplSee"], "GPL-3.0-or-later"),
    (APACHE, ["ApacheHead", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"], "Apache-2.0"),
]
REFERENCES = [
    ("Licensed under the MIT License", ["MIT"]), ("This project is licensed under the MIT License - see LICENSE.md for details.", ["MIT"]), ("Distributed under the terms of the MIT licence.", ["MIT"]), ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("released under the Apache License 2.0", ["Apache-2.0"]), ("Licensed under Apache-2.0", ["Apache-2.0"]), ("License: Apache License, Version 2.0", ["Apache-2.0"]), ("Licensed under the Apache License, Version 2.0. The License is short.", ["Apache-2.0"]),
    ("Distributed under GPLv3.", ["GPL-3.0-only"]), ("Distributed under GPLv3+.", ["GPL-3.0-or-later"]), ("This work is licensed under the GNU General Public License, version 3, or later.", ["GPL-3.0-or-later"]), ("# SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0-or-later"]),
    ("you may copy it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation, or (at your option) any later version", ["GPL-3.0-or-later"]),
    ("Use is governed by the BSD 3-Clause License", ["BSD-3-Clause"]), ("available under the Simplified BSD license", ["BSD-2-Clause"]), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]), ("SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1-or-later"]), ("licensed under the GNU Affero General Public License v3.0", ["AGPL-3.0-only"]), ("Distributed under the Mozilla Public License 2.0", ["MPL-2.0"]),
    ("This is licensed under the ISC license.", ["ISC"]), ("released under the Unlicense", ["Unlicense"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]), ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]), ("SPDX-License-Identifier: CC0-1.0", ["CC0-1.0"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("available under the zlib license", ["Zlib"]), ("SPDX-License-Identifier: EPL-2.0", ["EPL-2.0"]), ("licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
    ("not licensed under the MIT License", []), ("It isn't\nreleased under the MIT License", []), ("published under the MIT Press imprint", []), ("released under the\n\nMIT License", []), ("All rights. Reserved seats", []), ("hot licenses for all", []),
]


BSD3 = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
AUTHOR = "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n\n"


def bsd(clause):
    head, tail = BSD2.split("THIS SOFTWARE IS")
    return f"Copyright (c) 2014, Someone\nAll rights reserved.\n\n{head}{clause}THIS SOFTWARE IS{tail}"


MORE = [
    (bsd(BSD3.format("the copyright holder")), ["BSD-3-Clause"]), (bsd(BSD3.format("Google Inc.")), ["BSD-3-Clause"]), (bsd(BSD3.format("the University of California, Berkeley")), ["BSD-3-Clause"]), (bsd(AUTHOR), ["BSD-3-Clause"]), (bsd(""), ["BSD-2-Clause"]),
    (bsd("3. Whoever redistributes this must also send a postcard from a nice place to the author.\n\n"), ["BSD-other"]),
    (bsd("3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the Organization.\n4. " + BSD3.format("the Organization")[3:]), ["BSD-4-Clause"]),
    ("License: MIT", ["MIT"]), ("The MIT License (MIT)\n\nCopyright (c) 2020 Someone", ["MIT"]), ("This project is MIT licensed.", ["MIT"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n", ["Apache-2.0"]), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", ["GPL-3.0-only"]),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]), ("released under the Artistic License 2.0", ["Artistic-2.0"]), ("licensed under the Common Development and Distribution License, Version 1.0", ["CDDL-1.0"]),
    ("Available under a Creative Commons Attribution 3.0 Unported License", ["CC-BY-3.0"]),
]


def test_holders_and_titles(spark):
    df = spark.createDataFrame(rows([(k, t) for k, (t, _) in enumerate(MORE)]), DOCS)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for k, (text, names) in enumerate(MORE):
        assert [n for n in got[k].licenses if n != "All-rights-reserved"] == names, text


def test_common_words_cost_little():
    """Half a megabyte of ordinary words among which licence words stand, at well over a megabyte a second."""
    rng, words = random.Random(1), "software released distributed license copy conditions the of work provided and any public under with notice apache is available version".split()
    text = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(70_000)).encode()
    known = licenses.compiled(licenses.SENTENCES, references=True)
    begun = time.process_time()
    licenses.identified(text, known)
    assert time.process_time() - begun < 3e-7 * len(text) * 4


def test_ids_of_any_type(spark):
    got = scan_licenses(spark.createDataFrame([("x7", "License: MIT"), (None, None)], "doc_id string, text string")).collect()
    assert {(r.doc_id, tuple(r.licenses)) for r in got} == {("x7", ("MIT",)), (None, ())}


def test_query(spark):
    """The registered query against the whole-sentence lookup alone: every sentence that stands by itself is told."""
    d = "/root/testdata/sf0.01"
    known = {v: k for k, v in licenses.SENTENCES.items()}
    norm = lambda s: " ".join(re.findall("[a-z0-9\u0080-\U0010ffff]+", s.lower()))
    got = {r.doc_id: r for r in queries.op8_licenses(spark, d).collect()}
    docs = queries.read(spark, d, "documents").collect()
    assert len(got) == len(docs)
    told = 0
    for r in docs:
        want = Counter(known[norm(x)] for x in re.split(r"(?<=[.!?:])\s|\n", r.text or "") if norm(x) in known)
        have = Counter(got[r.doc_id].sentence_ids.split())
        assert not want - have, r.doc_id
        told += sum(want.values())
        assert (got[r.doc_id].licenses != "") <= (got[r.doc_id].sentence_ids != "")
    assert told > 20


def test_official_notices(spark):
    shapes = [str, lambda t: re.sub(r"\s+", " ", t), lambda t: re.sub(r"(?m)^", "# ", t), lambda t: "/*\n" + re.sub(r"(?m)^", " * ", t) + "*/"]
    cases = [(shape(text), ids, name) for text, ids, name in NOTICES for shape in shapes]
    df = spark.createDataFrame(rows([(k, f"some code here\n\n{t}\n\nmore code") for k, (t, _, _) in enumerate(cases)]), DOCS)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for k, (text, ids, name) in enumerate(cases):
        assert list(got[k].sentence_ids) == ids and list(got[k].licenses) == [name] and len(got[k].matches) == 1, text


def test_references(spark):
    df = spark.createDataFrame(rows([(k, t) for k, (t, _) in enumerate(REFERENCES)]), DOCS)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for k, (text, names) in enumerate(REFERENCES):
        assert list(got[k].licenses) == names, text
    m = got[1].matches[0]
    assert REFERENCES[1][0][m.start : m.end] == "licensed under the MIT License"
