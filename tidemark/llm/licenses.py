"""License scans: sentences to identifiers, then identifier sequences to licence rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import apart

# Sentences of public licence texts and notices, as normalised() leaves them, by identifier.
SENTENCES: dict[str, str] = {
    "mit.title": "the mit license",
    "mit.title2": "mit license",
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.distributed": "distributed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.grant1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc.liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd.head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd.licensed": "licensed under the bsd license",
    "apache.licensed": "licensed under the apache license version 2.0",
    "apache.head": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache.head2": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.copy1": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl.work3": "this work is licensed under the gnu general public license version 3",
    "gpl.work2": "this work is licensed under the gnu general public license version 2",
    "gpl.licensed3": "licensed under the gnu general public license version 3",
    "gpl.licensed2": "licensed under the gnu general public license version 2",
    "gpl.free3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.free2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "lgpl.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "cc.by-nc": "licensed under cc by nc 4.0",
    "cc.by": "licensed under cc by 4.0",
    "cc.by-sa": "licensed under cc by sa 4.0",
    "cc.work-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc.work-by-sa": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc.zero": "this work has been dedicated to the public domain under cc0 1.0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "unlicense.anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "spdx.mit": "spdx license identifier mit",
    "spdx.apache": "spdx license identifier apache 2.0",
    "spdx.gpl3": "spdx license identifier gpl 3.0 only",
    "spdx.bsd3": "spdx license identifier bsd 3 clause",
    "apache.licensed2": "licensed under the apache license version 2.0 the license",
    "apache.obtain": "you may obtain a copy of the license at",
    "apache.copy-https": "you may obtain a copy of the license at https www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl.program": "this program is free software",
    "gpl.redis2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.redis3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.library": "this library is free software",
    "lgpl.redis": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl.see": "see the gnu lesser general public license for more details",
    "mpl.subject-v": "this source code form is subject to the terms of the mozilla public license v",
    "mpl.copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "agpl.free3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl.see": "see the gnu affero general public license for more details",
    "agpl.licensed3": "licensed under the gnu affero general public license version 3",
    "lgpl.free3": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.licensed3": "licensed under the gnu lesser general public license version 3",
    "epl.available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "epl.licensed": "licensed under the eclipse public license 2.0",
    "bsl.distributed": "distributed under the boost software license version 1.0",
    "bsl.see": "see accompanying file license 1 0.txt or copy at https www.boost.org license 1 0.txt",
    "bsd.name-holders": "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.name-author": "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.name-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.name-organization": "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "isc.grant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc.by-nc-sa": "licensed under cc by nc sa 4.0",
    "cc.by-nd": "licensed under cc by nd 4.0",
    "cc.by-nc-nd": "licensed under cc by nc nd 4.0",
    "cc.work-by-nc": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc.work-by-nc-sa": "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license",
    "cc.work-by-nd": "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
    "apache.title": "apache license",
    "apache.version": "version 2.0 january 2004",
    "apache.terms": "terms and conditions for use reproduction and distribution",
    "apache.licensed3": "licensed under the apache license 2.0",
    "apache.licensed4": "licensed under the apache 2.0 license",
    "apache.released": "released under the apache license version 2.0",
    "bsd.licensed3": "licensed under the bsd 3 clause license",
    "bsd.licensed2": "licensed under the bsd 2 clause license",
    "isc.licensed": "licensed under the isc license",
    "mpl.licensed": "licensed under the mozilla public license 2.0",
    "rights": "all rights reserved",
}

# Further names of the public licence list, each a sentence and a rule of its own behind the list's tag.
LISTED = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "MS-PL", "OFL-1.1", "PostgreSQL", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx.{x.lower()}": f"spdx license identifier {x.lower().replace('-', ' ')}" for x in LISTED}

# Fixed values: (rule, licence, identifiers in order). Longer rules come first and use up what they match.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("gpl3-published", "GPL-3.0-or-later", ("gpl.program", "gpl.redis3", "gpl.hope", "gpl.implied", "gpl.see")),
    ("gpl2-published", "GPL-2.0-or-later", ("gpl.program", "gpl.redis2", "gpl.hope", "gpl.implied", "gpl.see")),
    ("lgpl-published", "LGPL-2.1-or-later", ("lgpl.library", "lgpl.redis", "lgpl.hope", "gpl.implied", "lgpl.see")),
    ("apache-published", "Apache-2.0", ("apache.licensed2", "apache.head2", "apache.obtain", "apache.basis", "apache.see")),
    ("apache-published-line", "Apache-2.0", ("apache.licensed2", "apache.head2", "apache.copy", "apache.see")),
    ("apache-published-https", "Apache-2.0", ("apache.licensed2", "apache.head2", "apache.copy-https", "apache.see")),
    ("gpl3-published-colon", "GPL-3.0-or-later", ("gpl.free3", "gpl.hope", "gpl.implied", "gpl.see")),
    ("gpl2-published-colon", "GPL-2.0-or-later", ("gpl.free2", "gpl.hope", "gpl.implied", "gpl.see")),
    ("mpl-published", "MPL-2.0", ("mpl.subject-v", "mpl.copy-https")),
    ("mpl-published-http", "MPL-2.0", ("mpl.subject-v", "mpl.copy")),
    ("bsd3", "BSD-3-Clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.name", "bsd.warranty")),
    ("bsd2", "BSD-2-Clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.warranty")),
    ("bsd3-holders", "BSD-3-Clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.name-holders", "bsd.warranty")),
    ("bsd3-author", "BSD-3-Clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.name-author", "bsd.warranty")),
    ("bsd3-university", "BSD-3-Clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.name-university", "bsd.warranty")),
    ("bsd3-organization", "BSD-3-Clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.name-organization", "bsd.warranty")),
    ("agpl3-published", "AGPL-3.0-or-later", ("agpl.free3", "gpl.hope", "gpl.implied", "agpl.see")),
    ("lgpl3-published", "LGPL-3.0-or-later", ("lgpl.free3", "gpl.hope", "gpl.implied", "lgpl.see")),
    ("zlib-text", "Zlib", ("zlib.warranty", "zlib.liability", "zlib.grant")),
    ("bsl-notice", "BSL-1.0", ("bsl.distributed", "bsl.see")),
    ("mit-text", "MIT", ("mit.grant1", "mit.notice", "mit.warranty", "mit.liability")),
    ("apache-notice4", "Apache-2.0", ("apache.head", "apache.copy1", "apache.basis", "apache.see")),
    ("apache-notice5", "Apache-2.0", ("apache.licensed", "apache.head2", "apache.copy", "apache.see")),
    ("mit-text3", "MIT", ("mit.grant", "mit.warranty", "mit.liability")),
    ("isc-text", "ISC", ("isc.grant", "isc.warranty", "isc.liability")),
    ("apache-notice", "Apache-2.0", ("apache.head", "apache.copy", "apache.see")),
    ("gpl3-notice", "GPL-3.0-or-later", ("gpl.free3", "gpl.warranty", "gpl.see")),
    ("gpl2-notice", "GPL-2.0-or-later", ("gpl.free2", "gpl.warranty", "gpl.see")),
    ("mpl-notice", "MPL-2.0", ("mpl.subject", "mpl.copy")),
    ("unlicense", "Unlicense", ("unlicense.free", "unlicense.anyone")),
    ("lgpl-free", "LGPL-2.1-or-later", ("lgpl.free",)),
    ("gpl3-free", "GPL-3.0-or-later", ("gpl.free3",)),
    ("gpl2-free", "GPL-2.0-or-later", ("gpl.free2",)),
    ("apache-head", "Apache-2.0", ("apache.head",)),
    ("mpl-subject", "MPL-2.0", ("mpl.subject",)),
    ("mit-grant", "MIT", ("mit.grant",)),
    ("mit-grant1", "MIT", ("mit.grant1",)),
    ("isc-grant", "ISC", ("isc.grant",)),
    ("unlicense-free", "Unlicense", ("unlicense.free",)),
    ("mit-title", "MIT", ("mit.title",)),
    ("mit-title2", "MIT", ("mit.title2",)),
    ("mit-released", "MIT", ("mit.released",)),
    ("mit-licensed", "MIT", ("mit.licensed",)),
    ("mit-distributed", "MIT", ("mit.distributed",)),
    ("apache-licensed", "Apache-2.0", ("apache.licensed",)),
    ("bsd-licensed", "BSD", ("bsd.licensed",)),
    ("gpl3-work", "GPL-3.0-only", ("gpl.work3",)),
    ("gpl2-work", "GPL-2.0-only", ("gpl.work2",)),
    ("gpl3-licensed", "GPL-3.0-only", ("gpl.licensed3",)),
    ("gpl2-licensed", "GPL-2.0-only", ("gpl.licensed2",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc.by-nc",)),
    ("cc-by", "CC-BY-4.0", ("cc.by",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc.by-sa",)),
    ("cc-work-by", "CC-BY-4.0", ("cc.work-by",)),
    ("cc-work-by-sa", "CC-BY-SA-4.0", ("cc.work-by-sa",)),
    ("cc-zero", "CC0-1.0", ("cc.zero",)),
    ("spdx-mit", "MIT", ("spdx.mit",)),
    ("spdx-apache", "Apache-2.0", ("spdx.apache",)),
    ("spdx-gpl3", "GPL-3.0-only", ("spdx.gpl3",)),
    ("spdx-bsd3", "BSD-3-Clause", ("spdx.bsd3",)),
    ("apache-licensed2", "Apache-2.0", ("apache.licensed2",)),
    ("gpl3-redis", "GPL-3.0-or-later", ("gpl.redis3",)),
    ("gpl2-redis", "GPL-2.0-or-later", ("gpl.redis2",)),
    ("lgpl-redis", "LGPL-2.1-or-later", ("lgpl.redis",)),
    ("mpl-subject-v", "MPL-2.0", ("mpl.subject-v",)),
    ("agpl3-free", "AGPL-3.0-or-later", ("agpl.free3",)),
    ("agpl3-licensed", "AGPL-3.0-only", ("agpl.licensed3",)),
    ("lgpl3-free", "LGPL-3.0-or-later", ("lgpl.free3",)),
    ("lgpl3-licensed", "LGPL-3.0-only", ("lgpl.licensed3",)),
    ("epl-available", "EPL-2.0", ("epl.available",)),
    ("epl-licensed", "EPL-2.0", ("epl.licensed",)),
    ("bsl-distributed", "BSL-1.0", ("bsl.distributed",)),
    ("zlib-grant", "Zlib", ("zlib.grant",)),
    ("isc-text2", "ISC", ("isc.grant2", "isc.warranty", "isc.liability")),
    ("isc-grant2", "ISC", ("isc.grant2",)),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ("cc.by-nc-sa",)),
    ("cc-by-nd", "CC-BY-ND-4.0", ("cc.by-nd",)),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", ("cc.by-nc-nd",)),
    ("cc-work-by-nc", "CC-BY-NC-4.0", ("cc.work-by-nc",)),
    ("cc-work-by-nc-sa", "CC-BY-NC-SA-4.0", ("cc.work-by-nc-sa",)),
    ("cc-work-by-nd", "CC-BY-ND-4.0", ("cc.work-by-nd",)),
    ("apache-text", "Apache-2.0", ("apache.title", "apache.version")),
    ("apache-version", "Apache-2.0", ("apache.version",)),
    ("apache-terms", "Apache-2.0", ("apache.terms",)),
    ("apache-licensed3", "Apache-2.0", ("apache.licensed3",)),
    ("apache-licensed4", "Apache-2.0", ("apache.licensed4",)),
    ("apache-released", "Apache-2.0", ("apache.released",)),
    ("apache-title", "Apache-2.0", ("apache.title",)),
    ("bsd-licensed3", "BSD-3-Clause", ("bsd.licensed3",)),
    ("bsd-licensed2", "BSD-2-Clause", ("bsd.licensed2",)),
    ("isc-licensed", "ISC", ("isc.licensed",)),
    ("mpl-licensed", "MPL-2.0", ("mpl.licensed",)),
    ("rights", "All-rights-reserved", ("rights",)),
]
RULES[-1:-1] = [(f"spdx-{x.lower()}", x, (f"spdx.{x.lower()}",)) for x in LISTED]

#: So many unknown sentences may stand between two identifiers of a rule.
GAP = 2

# Each known sentence has one of these inside a word, so a text without any of them has none.
CUES = ("licen", "permission", "copyright", "redistribution", "warrant", "rights", "software", "domain", "mpl", "cc0", "january 2004", "terms and conditions")
assert all(any(c in s for c in CUES) for s in SENTENCES.values())

END, NOISE, BREAK = r"[.;!?]+([ \t\r\n]+|$)", r"[^a-z0-9.\n]+", r" *\n[ \n]*"


#: What is made plain before sentences are cut, in order, as (pattern, replacement) with \1 for a group: who is licensed, where the text is said to
#: lie, and each operand of a tag's expression as a tag of its own (an exception behind `with` leaves its licence).
PLAIN = [
    (r"\b(?:this|the) (?:project|software|library|code|package|program|repository|module) is (licensed|released|distributed) under", r"\1 under"),
    (r"\bunder the terms of the (mit|apache|bsd|isc|mozilla) ", r"under the \1 "),
    (r"(licen[sc]e(?:,?[ \t]+version[ \t]+[0-9.]*[0-9])?)[ \t]*(?:[-,(]+[ \t]*)?see (?:the )?(?:file )?\[?(?:licen[sc]e|copying)(?:\.md|\.txt)?\]?(?:\([a-z./]*\))?(?: file)?(?: for (?:more |further )?(?:details|information))?\)?", r"\1"),
    (r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)\)?[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]+)\)?[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]+)\)?", "spdx-license-identifier: \\1\nspdx-license-identifier: \\2\nspdx-license-identifier: \\3"),
    (r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)\)?[ \t]+(?:or|and)[ \t]+\(?([a-z0-9.+-]+)\)?", "spdx-license-identifier: \\1\nspdx-license-identifier: \\2"),
    (r"(spdx-license-identifier:[ \t]*[a-z0-9.+-]+)[ \t]+with[ \t]+[a-z0-9.-]+", r"\1"),
]


def _token(identifier: str) -> str:
    return f"<{identifier.replace('.', ':')}>"


def normalised(lower: Column, wrapped: bool) -> Column:
    """One sentence of a lower-case text a line, words parted by one space, no other marks but inner dots.

    wrapped: a single line end is a space, as in texts wrapped to a width; else each line end ends a sentence.
    """
    out = lower
    if wrapped:
        out = F.regexp_replace(out, r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*", "; ")
        out = F.regexp_replace(out, r"\n", " ")
    for pattern, plain in PLAIN:
        out = F.regexp_replace(out, pattern, plain.replace("\\", "$"))
    out = F.regexp_replace(out, END, "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, NOISE, " "), BREAK, "\n"), F.lit(" \n"))


def sequence(lower: Column, wrapped: bool) -> Column:
    """The identifiers of the text's sentences in order, `|` where over GAP unknown ones part them."""
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, _token(i))))
    line = F.array_join(F.transform(F.split(normalised(lower, wrapped), "\n"), lambda s: F.coalesce(known[s], F.lit("."))), "")
    return F.replace(F.regexp_replace(line, rf"\.{{{GAP + 1},}}", "|"), F.lit("."), F.lit(""))


def matched(seq: Column) -> Column:
    """The names of the rules that match, in rule order; each rule uses up its identifiers."""
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("".join(map(_token, ids))).alias("ids")) for n, _, ids in RULES))
    start = F.struct(seq.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(held: Column, rule: Column) -> Column:
        hit = F.contains(held["rest"], rule["ids"])
        return F.when(hit, F.struct(F.replace(held["rest"], rule["ids"], F.lit("|")).alias("rest"), F.array_append(held["found"], rule["name"]).alias("found"))).otherwise(held)

    return F.aggregate(rules, start, step, lambda held: held["found"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but text, then sentence_ids, rules and licenses (sorted, comma-joined; empty if none).

    Each text is read twice, with line ends as sentence ends and as spaces; a rule counts if either shows
    it. A null or empty text has no licence. All steps are row by row: nothing is shuffled, texts are read whole, repeated
    rows give repeated results, an empty table gives none. A column of docs named like a result's gets an underscore.
    """
    of = F.create_map(*(F.lit(x) for name, licence, _ in RULES for x in (name, licence)))
    kept = [c for c in docs.columns if c != text]
    shown = apart(kept, ["sentence_ids", "rules", "licenses"])
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("low"))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(F.col("low"), F.lit(c))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({k: F.when(cue, sequence(F.col("low"), w)).otherwise("") for k, w in (("a", False), ("b", True))})
    rows = rows.withColumn("rules", F.array_sort(F.array_union(*(F.when(F.contains(c, F.lit("<")), matched(c)).otherwise(none) for c in (F.col("a"), F.col("b"))))))
    return rows.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(shown)),
        F.col("a").alias("sentence_ids"),
        F.array_join("rules", ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("rules", lambda r: of[r]))), ",").alias("licenses"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def made_plain(x: str) -> str:
        for pattern, plain in PLAIN:
            x = f"regexp_replace({x}, {lit(pattern)}, {lit(plain)}, 'g')"
        return x

    words = ", ".join(f"({lit(s)}, {lit(_token(i))})" for i, s in SENTENCES.items())
    norm = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[.;!?]+([ \t\r\n]+|$)', chr(10), 'g'), '[^a-z0-9.\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    wrapped = r"replace(regexp_replace(lower(text), '[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*', '; ', 'g'), chr(10), ' ')"
    steps, rest = [], "seq"
    for k, (_, _, ids) in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest), CASE WHEN contains(rest, {lit(''.join(map(_token, ids)))}) THEN list_append(found, {k}) ELSE found END AS found2, replace(rest, {lit(''.join(map(_token, ids)))}, '|') AS rest FROM {'start' if k == 0 else f'q{k - 1}'}), q{k} AS (SELECT doc_id, way, seq, found2 AS found, rest FROM r{k})")
    rules = ", ".join(f"({k}, {lit(n)}, {lit(licence)})" for k, (n, licence, _) in enumerate(RULES))
    return f"""
WITH dict(sentence, token) AS (VALUES {words}), rule(k, name, licence) AS (VALUES {rules}),
lines AS (
  SELECT doc_id, 'a' AS way, {norm.format(x=made_plain("lower(text)"))} AS norm FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
  UNION ALL SELECT doc_id, 'b', {norm.format(x=made_plain(wrapped))} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), sentences AS (
  SELECT doc_id, way, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM (SELECT doc_id, way, string_split(norm, chr(10)) AS s FROM lines)
), tokens AS (
  SELECT doc_id, way, string_agg(coalesce(token, '.'), '' ORDER BY i) AS line
  FROM sentences LEFT JOIN dict USING (sentence) GROUP BY doc_id, way
), start AS (
  SELECT doc_id, way, replace(regexp_replace(line, '\\.{{{GAP + 1},}}', '|', 'g'), '.', '') AS seq, replace(regexp_replace(line, '\\.{{{GAP + 1},}}', '|', 'g'), '.', '') AS rest, []::INTEGER[] AS found FROM tokens
), {", ".join(steps)},
cues AS (SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{"|".join(CUES)}') AS cue FROM documents),
hits AS (SELECT DISTINCT doc_id, unnest(found) AS k FROM q{len(RULES) - 1}),
named AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses FROM hits JOIN rule USING (k) GROUP BY doc_id)
SELECT tokens.doc_id, CASE WHEN cue THEN start.seq ELSE '' END AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM tokens JOIN cues ON tokens.doc_id = cues.doc_id JOIN start ON tokens.doc_id = start.doc_id AND start.way = 'a' LEFT JOIN named ON tokens.doc_id = named.doc_id WHERE tokens.way = 'a'
"""


OP2_SQL = _sql()
