"""Licence scans on the notices as their licences give them."""

from tidemark.llm import licenses

MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
MIT = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe end."


def test_mpl_and_both_readings(spark):
    one_line = MPL.replace("\n *", "")
    broken = MPL.replace("v. 2.0", "v.\n * 2.0")
    rows = [(1, MPL), (2, one_line), (3, broken), (4, MIT)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(got[i]["licenses"] == ["MPL-2.0"] and got[i]["wrapped_ids"] == ["mpl-2-notice"] for i in (1, 2, 3))
    assert got[2]["sentence_ids"] == ["mpl-2-notice"]
    assert got[4]["sentence_ids"] == ["mit-title"] and got[4]["wrapped_ids"] == ["mit-title", "mit-grant"]


MIT_REST = """

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
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
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_whole_texts_of_licences(spark):
    rows = [(1, MIT.replace("The end.", "") + MIT_REST), (2, APACHE), (3, BSD), (4, BSD.replace("3. Neither", "3. Either")), (5, GPL), (6, "// SPDX-License-Identifier: Apache-2.0\nint x;"), (7, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["BSD-3-Clause"], 4: ["BSD-3-Clause"], 5: ["GPL-3.0-or-later"], 6: ["Apache-2.0"], 7: ["CC-BY-SA-4.0"]}
    assert got[1]["wrapped_ids"] == ["mit-title", "mit-grant", "mit-keep", "mit-as-is", "mit-liability"] and got[2]["wrapped_ids"][-1] == "apache-2-see"


def test_every_sentence_is_known_and_told(spark):
    """Each sentence by itself, as its licence writes it, is found; and the words that texts are chosen by are in all of them."""
    rows = [(n, t) for n, (_, t) in enumerate(licenses.TEXTS)]
    got = {r["n"]: r["wrapped_ids"] for r in licenses.scan(spark.createDataFrame(rows, "n int, text string")).collect()}
    assert all(got[n] == [i] for n, (i, _) in enumerate(licenses.TEXTS))
    words = licenses.telling_words(licenses.SENTENCES)
    assert all(any(w in s for w in words) for s in licenses.SENTENCES)


def test_names_in_sentences_and_expressions(spark):
    """Holders and organisations stand in the sentences; a clause that is not known keeps BSD-3 and others from being taken for BSD-2."""
    third = BSD[BSD.index("3. Neither") : BSD.index("THIS SOFTWARE")]
    texts = {
        "Google": (BSD.replace(third, "3. Neither the name of Google Inc. nor the names of its contributors may be\n   used to endorse or promote products derived from this software without\n   specific prior written permission.\n\n"), ["BSD-3-Clause"]),
        "University": (BSD.replace(third, "3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n\n"), ["BSD-3-Clause"]),
        "author": (BSD.replace(third, "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n\n"), ["BSD-3-Clause"]),
        "other": (BSD.replace(third, "3. Products derived from this software may not be called Foo.\n\n"), []),
        "two": (BSD.replace(third, ""), ["BSD-2-Clause"]),
        "holder": (BSD.replace(third, "").replace("PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "PROVIDED BY THE REGENTS AND CONTRIBUTORS"), ["BSD-2-Clause"]),
        "isc": ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
        "mit": ("Licensed under the MIT license (see LICENSE).", ["MIT"]),
        "spdx": ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", ["MIT", "Apache-2.0"]),
        "brackets": ("# SPDX-License-Identifier: (GPL-2.0-only WITH Foo-note) AND BSD-3-Clause", ["GPL-2.0-only", "BSD-3-Clause"]),
        "either": ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["MIT", "Apache-2.0"]),
        "gfdl": ("Permission is granted to copy, distribute and/or modify this document\nunder the terms of the GNU Free Documentation License, Version 1.3\nor any later version published by the Free Software Foundation;\nwith no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.", ["GFDL-1.3-or-later"]),
        "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]),
        "none": ("We sell software. Buy a license or three. The MIT campus is near.", []),
    }
    got = {r["k"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "k string, text string")).collect()}
    assert got == {k: want for k, (_, want) in texts.items()}
    assert len({n for n, *_ in licenses.ALL_RULES}) >= 50


def test_sql_on_the_same_texts(spark, tmp_path):
    """The twin in SQL, on whole licences with names in them."""
    import duckdb

    texts = [MIT + MIT_REST, APACHE, BSD, BSD.replace("of the copyright holder", "of Foo Inc."), "SPDX-License-Identifier: MIT OR (Zlib AND BSD-2-Clause)", GPL, None, "", "available under the terms of the MIT License, or so"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"], ",".join(r["sentence_ids"]), ",".join(r["wrapped_ids"]), ",".join(r["licenses"])) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(f"SELECT doc_id, sentence_ids, wrapped_ids, licenses FROM ({licenses.oracle()})").fetchall()) == got
