"""License recognition: known sentences become identifiers, and identifier sequences match ordered rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licenses and the notices that point to them, as published.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit-name", "The MIT License"),
    ("mit-name-2", "MIT License"),
    ("mit-name-3", "The MIT License (MIT)"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice-2", "Licensed under the MIT License."),
    ("mit-notice-3", "This project is licensed under the MIT License."),
    ("mit-notice-4", "Distributed under the MIT License."),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-condition-next", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd2-notice", "Licensed under the BSD 2-Clause License."),
    ("bsd3-notice", "Licensed under the BSD 3-Clause License."),
    ("bsd3-notice-2", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("apache2-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache2-notice-2", "This project is licensed under the Apache License, Version 2.0."),
    ("apache2-notice-3", "Released under the Apache License, Version 2.0."),
    ("apache2-notice-4", "Licensed under the Apache License 2.0."),
    ("apache2-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice-2", "Licensed under the GNU General Public License v3.0."),
    ("gpl2-terms", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl3-terms", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl3-only-terms", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("agpl3-terms", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("lgpl21-terms", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("gnu-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gnu-hope-library", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("agpl-see", "See the GNU Affero General Public License for more details."),
    ("lgpl-see", "See the GNU Lesser General Public License for more details."),
    ("mpl2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl2-notice", "Licensed under the Mozilla Public License 2.0."),
    ("cc-by-4", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-4", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-4-work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "Licensed under CC0 1.0 Universal."),
    ("cc0-waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("reserved", "All rights reserved."),
)

# Rules in order of precedence; a matched sequence is used up.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition-next", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT-0", ("mit-grant", "mit-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-header", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-header", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-header",)),
    ("GPL-2.0-or-later", ("gpl2-terms", "gnu-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-terms",)),
    ("GPL-3.0-or-later", ("gpl3-terms", "gnu-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-terms",)),
    ("GPL-3.0-only", ("gpl3-only-terms", "gnu-hope", "gpl-see")),
    ("GPL-3.0-only", ("gpl3-only-terms",)),
    ("AGPL-3.0-or-later", ("agpl3-terms", "gnu-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-terms",)),
    ("LGPL-2.1-or-later", ("lgpl21-terms", "gnu-hope-library", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-terms",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("MIT", ("mit-notice-4",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-2",)),
    ("MIT", ("mit-name-3",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-3-Clause", ("bsd3-notice-2",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-notice-2",)),
    ("Apache-2.0", ("apache2-notice-3",)),
    ("Apache-2.0", ("apache2-notice-4",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-2",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("BSL-1.0", ("boost-notice",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)

# Every known sentence holds one of these, so texts without any are not split.
STEMS = ("licen", "permission", "redistribut", "warrant", "copyright", "public domain", "rights reserved", "of the mpl",
         "no event", "free to copy")


@dataclass(frozen=True)
class Rulebook:
    sentences: tuple[tuple[str, str], ...] = SENTENCES
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES
    stems: tuple[str, ...] = STEMS

    def known(self) -> dict[str, str]:
        """Normalised sentence to identifier."""
        return {normal(text): name for name, text in self.sentences}

    def missing_stems(self) -> list[str]:
        return [name for name, text in self.sentences if not any(s in normal(text) for s in self.stems)]


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", _lower(sentence)).strip()


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT = "\x01"
# Ends of sentences; license terms also run on after the colons of their lists.
ENDS = "([.!?]|conditions:|restrictions:|are met:)"


def license_scan(docs: DataFrame, book: Rulebook = Rulebook(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, licenses, unmatched) per row of ``docs``.

    A text is split into sentences twice: at line ends and after ``.``, ``!`` or ``?``
    (or a colon that opens a license's list) before a blank; and again with single line ends read as blanks, which joins wrapped
    sentences (empty lines still separate). Sentences are compared in lower case, with
    everything but ASCII letters and digits as one blank. ``sentences`` are the identifiers
    of known sentences in order, for the two readings; ``licenses`` the distinct names of
    the rules that match, sorted; ``unmatched`` the known sentences of the first reading that no
    rule used. Within a reading, rules apply in order and use up what they match; sentences
    that are not known do not separate a sequence.

    Everything happens in one pass within the row, without a shuffle. Null and empty texts
    have no sentences, long ones are read whole, an empty table gives no rows; ids may be null
    or repeated; other columns are ignored.
    """
    if book.missing_stems():
        raise ValueError(f"sentences without a stem: {book.missing_stems()}")
    known = book.known()
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    # as sentences are compared: whatever is no letter or digit may stand between the words of a stem
    stem = "|".join("[^a-z0-9]+".join(map(re.escape, normal(s).split())) for s in book.stems)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ruled = F.array(*[F.struct(F.lit("".join(f"<{s}>" for s in ids)).alias("pattern"), F.lit(lic).alias("license"))
                      for lic, ids in book.rules])

    def reading(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, ENDS + r"[ \t-\r]+", "$1" + CUT), CUT)
        plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
        return F.transform(F.filter(plain, lambda s: s.isin(list(known))), lambda s: names[s])

    def matched(ids: Column) -> Column:
        start = F.struct(F.concat_ws("", F.transform(ids, lambda s: F.concat(F.lit("<"), s, F.lit(">")))).alias("rest"),
                         F.array().cast("array<string>").alias("found"))
        return F.aggregate(ruled, start, lambda acc, r: F.struct(
            F.replace(acc["rest"], r["pattern"], F.lit("<>")).alias("rest"),
            F.when(F.contains(acc["rest"], r["pattern"]), F.concat(acc["found"], F.array(r["license"])))
            .otherwise(acc["found"]).alias("found")))

    empty = F.array().cast("array<string>")
    found = docs.select(F.col(id_col).alias("doc_id"), text.rlike(stem).alias("maybe"), text.alias("t")).select(
        "doc_id",
        F.when(F.col("maybe"), reading(F.replace(F.col("t"), F.lit("\n"), F.lit(CUT)))).otherwise(empty).alias("lines"),
        F.when(F.col("maybe"), reading(F.replace(F.regexp_replace(F.col("t"), r"\n[ \t-\r]*\n", CUT), F.lit("\n"), F.lit(" "))))
        .otherwise(empty).alias("flowing"))
    nothing = F.struct(F.lit("").alias("rest"), empty.alias("found"))
    ruled_rows = found.select(
        "doc_id", "lines", "flowing",
        F.when(F.size("lines") > 0, matched(F.col("lines"))).otherwise(nothing).alias("a"),
        F.when(F.size("flowing") > 0, matched(F.col("flowing"))).otherwise(nothing).alias("b"))
    left = F.filter(F.split(F.replace(F.col("a.rest"), F.lit("<>"), F.lit("")), "[<>]+"), lambda s: s != "")
    return ruled_rows.select(
        "doc_id", F.struct("lines", "flowing").alias("sentences"),
        F.array_sort(F.array_union("a.found", "b.found")).alias("licenses"), left.alias("unmatched"))


def scan_sql(book: Rulebook = Rulebook()) -> str:
    """The query ``op6`` in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in book.known().items())

    def apply(view: str) -> str:
        steps, hits = ["ids as s0"], []
        for i, (lic, ids) in enumerate(book.rules):
            pattern = quote("".join(f"<{s}>" for s in ids))
            steps.append(f"replace(s{i}, {pattern}, '<>') as s{i + 1}")
            hits.append(f"case when contains(s{i}, {pattern}) then {quote(lic)} end")
        return (f"select n, {', '.join(steps)}, [{', '.join(hits)}] as found from {view}_seq")

    def view(name: str, source: str) -> str:
        return f"""
        {name}_parts as (select n, unnest(p) as s, generate_subscripts(p, 1) as pos from (
            select n, string_split(regexp_replace({source}, '{ENDS}[ \\t-\\r]+', '\\1' || chr(1), 'g'), chr(1)) as p from t)),
        {name}_known as (select n, pos, k.id from {name}_parts
            join known k on k.s = trim(regexp_replace({name}_parts.s, '[^a-z0-9]+', ' ', 'g'))),
        {name}_seq as (select n, string_agg('<' || id || '>', '' order by pos) as ids, count(*) as c from {name}_known group by n),
        {name}_rules as ({apply(name)})"""

    return f"""with known(s, id) as (values {values}),
        t as (select row_number() over () as n, doc_id,
              translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as x from documents),
        {view("a", "replace(x, chr(10), chr(1))")},
        {view("b", "replace(regexp_replace(x, '\\n[ \\t-\\r]*\\n', chr(1), 'g'), chr(10), ' ')")}
        select t.doc_id, coalesce(a_seq.c, 0) as n_sentences,
          coalesce(array_to_string(list_sort(list_distinct(list_filter(
              list_concat(coalesce(a_rules.found, []), coalesce(b_rules.found, [])), lambda x: x is not null))), ','), '') as licenses,
          coalesce(len(list_filter(string_split(replace(replace(a_rules.s{len(book.rules)}, '<>', ''), '<', '>'), '>'), lambda x: x <> '')), 0)
            as n_unmatched
        from t left join a_seq using (n) left join a_rules using (n) left join b_rules using (n)"""
