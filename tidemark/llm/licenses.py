"""Licence scans by sentence rules.

A text is normalised (lower case, all but letters, digits and sentence ends to a space) and split into sentences; sentences that
are known become identifiers, the rest is left out; a rule matches where its identifiers stand in this order, unless one that it excludes stands anywhere. Sentences with places for names (holders, organisations) are
told by patterns, and SPDX lines are taken apart at OR, AND and WITH, each part being a line of its own. A text is
read twice, with line ends as sentence ends and with line ends as spaces (blank lines as sentence ends), so that both bare licence lines and wrapped
paragraphs are recognised. All of it is row by row, in Spark's own expressions: no shuffle, no Python.

Defined results: null and empty texts have no sentences and no licence; other columns play no part; equal rows give equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of their usual notices, with identifiers.
TEXTS = [
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-notice", "This software is released under the MIT License."),
    ("mit-notice", "Distributed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is", "The Software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("mit-liability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the 'License');"),
    ("apache-2-notice", "This project is licensed under the Apache License, Version 2.0."),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License."),
    ("apache-2-comply", "You may not use this file except in compliance with the License."),
    ("apache-2-obtain", "You may obtain a copy of the License at"),
    ("apache-2-unless", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2-title", "Apache License Version 2.0, January 2004"),
    ("apache-2-title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-2-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("apache-2-grant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl-2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2-notice", "Licensed under the GNU General Public License, version 2."),
    ("gpl-3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("gpl-2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl-no-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("gpl-3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl-2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-2-preamble", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("gnu-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("lgpl-21-notice", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-21-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3-notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-no-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("agpl-3-notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl-3-preamble", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("cc0-notice", "Licensed under CC0 1.0."),
    ("cc0-notice", "CC0 1.0 Universal"),
    ("cc0-waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-as-is", "This software is provided by the copyright holders and contributors 'as is' and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    ("bsd-liability", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("bsd-3-notice", "Licensed under the BSD 3-Clause License."),
    ("bsd-2-notice", "Licensed under the BSD 2-Clause License."),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2-title", "Mozilla Public License Version 2.0"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-as-is", "The software is provided 'as is' and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    ("isc-liability", "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl-1-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl-1-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the 'Software') to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("epl-2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-2-title", "Eclipse Public License - v 2.0"),
    ("artistic-2-title", "The Artistic License 2.0"),
    ("gfdl-13-later", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("gfdl-13-later", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("gfdl-12-later", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("ofl-11-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ofl-11-title", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("eupl-12-notice", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"),
    ("cddl-1-title", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("cddl-1-notice", "The contents of this file are subject to the terms of the Common Development and Distribution License (the 'License')."),
    ("epl-1-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("epl-1-title", "Eclipse Public License - v 1.0"),
    ("ms-pl-title", "Microsoft Public License (Ms-PL)"),
    ("postgresql-grant", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("psf-2-title", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("mpl-11-notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the 'License'); you may not use this file except in compliance with the License."),
    ("osl-3-notice", "Licensed under the Open Software License version 3.0"),
    ("afl-3-notice", "Licensed under the Academic Free License version 3.0"),
    ("blue-oak-title", "Blue Oak Model License Version 1.0.0"),
    ("wtfpl-title", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("all-rights-reserved", "All rights reserved."),
]
#: Sentences with places for names, as patterns of whole normalised sentences; the first that fits counts. A full stop within a name ends a sentence, so what follows the name is enough.
SLOTS = [
    ("bsd-names", "(.* )?nor (the )?names? of (its|their|the|other) contributors may be used to endorse or promote products derived from this software without( specific)?( prior)? written permission"),
    ("bsd-names", "(3 )?neither the names? of .* may be used to endorse or promote products derived from this software without( specific)?( prior)? written permission"),
    ("bsd-names", "(3 )?the names? of .* may not be used to endorse or promote products derived from this software without( specific)?( prior)? written permission"),
    ("bsd-other-clause", ".*(endorse or promote|advertising materials|may not be called|nor may ).*"),
    ("bsd-as-is", "this software is provided by .* as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc-grant", "permission to use copy modify (and or |and )?distribute this software (and its documentation )?for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2-or-mit", "(.* )?apache license version 2[.]0( .*)? or (the )?mit license( .*)?"),
    ("apache-2-or-mit", "(.* )?mit license( .*)? or (the )?apache license version 2[.]0( .*)?"),
    ("mit-notice", "(.* )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?mit license( .*)?"),
    ("apache-2-notice", "(.* )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?apache license version 2[.]0( .*)?"),
]
SPDX = "spdx license identifier "
#: Licences and their ordered sentence identifiers, from the most telling rule to the least; and, for some, identifiers that speak against them.
RULES = [
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["apache-2-or-mit"]),
    ("Apache-2.0", ["apache-2-title", "apache-2-terms", "apache-2-grant"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-comply", "apache-2-obtain"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-obtain", "apache-2-unless", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("Apache-2.0", ["apache-2-title", "apache-2-terms"]),
    ("Apache-2.0", ["apache-2-or-mit"]),
    ("AGPL-3.0-or-later", ["agpl-3-later"]),
    ("AGPL-3.0-only", ["agpl-3-title", "gnu-verbatim", "agpl-3-preamble"]),
    ("GPL-3.0-or-later", ["gpl-3-later", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-2-later", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2-later"]),
    ("GPL-3.0-only", ["gpl-3-title", "gnu-verbatim", "gpl-3-preamble"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("GPL-2.0-only", ["gpl-2-title", "gnu-verbatim", "gpl-2-preamble"]),
    ("GPL-2.0-only", ["gpl-2-only"]),
    ("GPL-2.0-only", ["gpl-2-notice"]),
    ("AGPL-3.0-only", ["agpl-3-notice"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-21-later"]),
    ("LGPL-3.0-only", ["lgpl-3-notice"]),
    ("LGPL-2.1-only", ["lgpl-21-notice"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-3-notice"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["bsd-names", "bsd-advertising", "bsd-other-clause"]),
    ("BSD-2-Clause", ["bsd-2-notice"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("BSL-1.0", ["bsl-1-title", "bsl-1-grant"]),
    ("BSL-1.0", ["bsl-1-notice"]),
    ("Unlicense", ["unlicense-notice"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("Artistic-2.0", ["artistic-2-title"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("GFDL-1.3-or-later", ["gfdl-13-later"]),
    ("GFDL-1.2-or-later", ["gfdl-12-later"]),
    ("OFL-1.1", ["ofl-11-notice"]),
    ("OFL-1.1", ["ofl-11-title"]),
    ("EUPL-1.2", ["eupl-12-notice"]),
    ("CDDL-1.0", ["cddl-1-title"]),
    ("CDDL-1.0", ["cddl-1-notice"]),
    ("EPL-1.0", ["epl-1-notice"]),
    ("EPL-1.0", ["epl-1-title"]),
    ("MS-PL", ["ms-pl-title"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("PSF-2.0", ["psf-2-title"]),
    ("MPL-1.1", ["mpl-11-notice"]),
    ("OSL-3.0", ["osl-3-notice"]),
    ("AFL-3.0", ["afl-3-notice"]),
    ("BlueOak-1.0.0", ["blue-oak-title"]),
    ("WTFPL", ["wtfpl-title"]),
    ("LicenseRef-All-Rights-Reserved", ["all-rights-reserved"]),
]
#: The parts of Creative Commons licences.
DEEDS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def normal_sentence(text: str) -> str:
    """As sentences are in a normalised text."""
    plain = re.sub(r"[^a-z0-9.!?]+", " ", text.lower()).strip()
    return re.sub(r"(?<![a-z0-9.])v\. (?=[0-9])", "v ", plain).rstrip(".!? ")


def _with_notices() -> tuple[dict[str, str], list[tuple]]:
    """The sentences and rules above, and those that are made by rule: Creative Commons notices and SPDX lines."""
    known, rules = {normal_sentence(t): i for i, t in TEXTS}, list(RULES)
    for part, name in DEEDS.items():
        for version in ("3.0", "4.0"):
            i, scope = f"cc-{part}-{version[0]}-notice", {"3.0": "Unported", "4.0": "International"}[version]
            short = f"CC {part.upper()} {version}"
            for t in (f"Licensed under {short}", f"This work is licensed under {short}", f"This work is licensed under a Creative Commons {name} {version} {scope} License", f"This work is licensed under the Creative Commons {name} {version} {scope} License"):
                known[normal_sentence(t)] = i
            rules.insert(len(rules) - 1, (f"CC-{part.upper()}-{version}", [i]))
    for name in dict.fromkeys(n for n, *_ in rules if not n.startswith("LicenseRef")):
        known[normal_sentence(f"SPDX-License-Identifier: {name}")] = f"spdx-{name.lower()}"
        rules.insert(len(rules) - 1, (name, [f"spdx-{name.lower()}"]))
    return known, rules


SENTENCES, ALL_RULES = _with_notices()


def telling_words(known: dict[str, str]) -> list[str]:
    """A few words of which every known sentence has one: long ones that cover many sentences first, as they are rare in other texts. Those with places for names have one of the last."""
    left, words = [set(re.findall("[a-z]{5,}", s)) or {s} for s in known], []
    while left:
        best = min({w for s in left for w in s}, key=lambda w: (-sum(w in s for s in left) * len(w) ** 3, w))
        words.append(best)
        left = [s for s in left if best not in s]
    return list(dict.fromkeys([*words, "license", "software", "advertising"]))


def sentence_ids(plain: Column, wrapped: bool, known: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text (as of ``_plain``), in order. wrapped: a line end is a space."""
    folded = F.regexp_replace(F.regexp_replace(plain, r"\n ?\n[ \n]*", ". "), r"[ \n]+", " ") if wrapped else plain
    folded = F.regexp_replace(folded, r"(^|[^a-z0-9.])v\. ?([0-9])", "$1v $2")  # v. 2.0 is no sentence end
    sentences = F.transform(F.split(F.regexp_replace(folded, r"[.!?]+( |\n|$)", "\n"), "\n"), lambda s: F.trim(s))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))

    def slot(s: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, pattern in SLOTS:
            out = out.when(s.rlike(f"^({pattern})$"), name)
        return out

    parts = lambda s: F.transform(F.split(F.substring(s, len(SPDX) + 1, 1 << 20), " (?:or|and|with) "), lambda p: F.try_element_at(table, F.concat(F.lit(SPDX), F.trim(p))))
    ids = lambda s: F.when(s.startswith(SPDX), parts(s)).otherwise(F.array(F.coalesce(F.try_element_at(table, s), slot(s))))
    return F.array_compact(F.flatten(F.transform(sentences, ids)))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.!?\n]+", " ")


def _patterns(rule: tuple) -> tuple[str, str, str]:
    """A rule's name, and the patterns of identifiers that it needs, and that it does not allow, if any."""
    name, ids, *no = rule
    return name, r"\|" + r"\|(.*\|)?".join(ids) + r"\|", r"\|(" + "|".join(no[0]) + r")\|" if no else ""


def scan(df: DataFrame, text_col: str = "text", known: dict[str, str] = SENTENCES, rules: list = ALL_RULES) -> DataFrame:
    """``df`` with sentence_ids (of the line reading), wrapped_ids (of the other), licenses (all that match, in the order of the rules) and license (the first).

    Each reading is made once a text, and only of texts with a word of a known sentence. Columns of these names in ``df`` are replaced.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = lambda w: F.when(F.lower(text).rlike("|".join(telling_words(known))), sentence_ids(_plain(text), w, known)).otherwise(none)
    found = df.withColumns({"sentence_ids": read(False), "wrapped_ids": read(True)})
    joined = [F.concat(F.lit("|"), F.array_join(c, "|"), F.lit("|")) for c in ("sentence_ids", "wrapped_ids")]
    either = lambda p: joined[0].rlike(p) | joined[1].rlike(p)
    hits = F.array(*(F.when(either(p) & ~either(no) if no else either(p), F.lit(name)) for name, p, no in map(_patterns, rules)))
    some = (F.size("sentence_ids") > 0) | (F.size("wrapped_ids") > 0)
    found = found.withColumn("licenses", F.when(some, F.array_distinct(F.array_compact(hits))).otherwise(none))
    return found.withColumn("license", F.try_element_at(F.col("licenses"), F.lit(1)))


def oracle(table: str = "documents") -> str:
    """DuckDB's SQL for the query of this operator."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    slots = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, p in SLOTS) + " END"
    cut = lambda x: f"list_transform(string_split(regexp_replace(regexp_replace(x_{x}, '(^|[^a-z0-9.])v\\. ?([0-9])', '\\1v \\2', 'g'), '[.!?]+( |\\n|$)', chr(10), 'g'), chr(10)), lambda s: trim(s))"
    of = f"CASE WHEN starts_with(s, '{SPDX}') THEN list_transform(string_split_regex(substr(s, {len(SPDX) + 1}), ' (or|and|with) '), lambda p: k['{SPDX}' || trim(p)]) ELSE [coalesce(k[s], {slots})] END"
    ids = lambda x: f"list_filter(flatten(list_transform({cut(x)}, lambda s: {of})), lambda v: v IS NOT NULL)"
    hit = lambda p: f"(regexp_matches(a, '{p}') OR regexp_matches(b, '{p}'))"
    cases = ", ".join(f"CASE WHEN {hit(p)}{f' AND NOT {hit(no)}' if no else ''} THEN '{n}' END" for n, p, no in map(_patterns, ALL_RULES))
    return f"""
WITH n AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.!?\\n]+', ' ', 'g') x_l, MAP {{{known}}} k FROM {table}),
x AS (SELECT doc_id, k, x_l, regexp_replace(regexp_replace(x_l, '\\n ?\\n[ \\n]*', '. ', 'g'), '[ \\n]+', ' ', 'g') x_w FROM n),
i AS (SELECT doc_id, {ids('l')} l, {ids('w')} w FROM x),
s AS (SELECT doc_id, len(l) n, coalesce(array_to_string(l, ','), '') sentence_ids, coalesce(array_to_string(w, ','), '') wrapped_ids, '|' || coalesce(array_to_string(l, '|'), '') || '|' a, '|' || coalesce(array_to_string(w, '|'), '') || '|' b FROM i),
h AS (SELECT doc_id, n, sentence_ids, wrapped_ids, list_filter([{cases}], lambda v: v IS NOT NULL) hits FROM s),
u AS (SELECT doc_id, n, sentence_ids, wrapped_ids, list_filter(hits, lambda v, p: list_position(hits, v) = p) hits FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, sentence_ids, wrapped_ids, coalesce(array_to_string(hits, ','), '') AS licenses, coalesce(hits[1], '') AS license FROM u
"""
