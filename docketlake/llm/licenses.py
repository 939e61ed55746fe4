"""Licence scans: known sentences to identifiers, identifier sequences to licences.

DataFrame functions only. A text's sentences end at line feeds and at full stops,
question and exclamation marks before white space; they are normalised (lower case,
comment marks and punctuation to single spaces) and looked up in a table of licence
sentences. A notice, however it begins ("SPDX-License-Identifier:", "This project is
released under the terms of the") and goes on ("see the LICENSE file for details"), is
normalised to the word ``notice`` and the licence's name, and looked up like any other
sentence. The identifiers found, in order, form a sequence; the rules are tried in
their order, and a rule that matches a run of the sequence names its licence and
takes that run out, so that a long licence is not also reported for a part of it.

Licences are often wrapped over several lines. So a text is read in two ways at once:
with each line by itself, and with single line feeds as spaces; there, lines without a
letter or digit, such as a comment's blank lines, and colons end a sentence too. What
either way finds is put in the order of the text by where its sentence ends, counted in
letters and digits, and one that both find is one; of equal licences one is reported.

A null or empty text has no licences. Rows are kept as they are; a text with no
known sentence has empty arrays. Texts are read whole, at any length. Not read are
sentences of more than ``SPARE`` characters, four times the longest known one, and owners'
names of more than 200 characters in BSD's third condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import add_free

# Licence sentences, normalised, with their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at": "apache-2-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 3 of the license or at your option any later"
    " version": "gpl-3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 2 of the license or at your option any later"
    " version": "gpl-2-or-later",
    # The same without what stands before the colon, which ends a sentence in wrapped texts.
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
    " free software foundation either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
    " free software foundation either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    **dict.fromkeys([
        f"{name} may {verb} used to endorse or promote products derived from this software without specific prior"
        " written permission" for name, verb in (
            ("neither the name of the copyright holder nor the names of its contributors", "be"),
            ("the names of its contributors", "be"), ("nor the names of its contributors", "be"),
            ("the names of contributors", "be"), ("the names of other contributors", "be"),
            ("the name of the author", "not be"), ("the names of its contributors", "not be"))], "bsd-endorse"),
    "all advertising materials mentioning features or use of this software must display the following"
    " acknowledgement": "bsd-advertising",
    **{f"{start}{terms}": name
       for start in ("this program is free software ", "this library is free software ", "")
       for terms, name in {
           f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license {rest}":
           f"{short}-{version.replace(' ', '.')}-{which}"
           for kind, short, version in (("", "gpl", "2"), ("", "gpl", "3"), ("lesser ", "lgpl", "2 1"),
                                        ("lesser ", "lgpl", "3"), ("affero ", "agpl", "3"))
           for rest, which in (
               (f"as published by the free software foundation either version {version} of the license or at your"
                " option any later version", "or-later"),
               (f"as published by the free software foundation version {version} of the license", "only"),
               (f"as published by the free software foundation either version {version} of the license", "only"),
               (f"version {version} as published by the free software foundation", "only"))}.items()},
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
    # The full stop of "v. 2.0" ends the sentence.
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-notice",
    **dict.fromkeys([
        f"permission to use copy modify and{x} distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
        for x in (" or", "")], "isc-grant"),
    **dict.fromkeys([
        f"to the extent possible under law the author{s} waived all copyright and related or neighboring rights to this"
        f" {what}" for s in (" has", " s have") for what in ("work", "software")], "cc0-waiver"),
    **dict.fromkeys([
        f"to the extent possible under law the author{s} dedicated all copyright and related and neighboring rights to"
        " this software to the public domain worldwide" for s in (" has", " s have")], "cc0-waiver"),
    "all rights reserved": "all-rights-reserved",
    # Titles, and the lines below them.
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "isc license": "isc-title",
    "the isc license": "isc-title",
    "bsd 2 clause license": "bsd-2-title",
    "bsd 3 clause license": "bsd-3-title",
    "apache license": "apache-title",
    "version 2 0 january 2004": "january-2004",
    "gnu general public license": "gpl-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "version 2 june 1991": "june-1991",
    "version 2 1 february 1999": "february-1999",
    "version 3 29 june 2007": "june-2007",
    "version 3 19 november 2007": "november-2007",
    "mozilla public license version 2 0": "mpl-2-title",
    # Sentences of the full texts.
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non"
    " exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly"
    " display publicly perform sublicense and distribute the work and such derivative works in source or object form":
    "apache-2-grant",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl-3-preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl-2-preamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu"
    " general public license supplemented by the additional permissions listed below": "lgpl-3-preamble",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically"
    " designed to ensure cooperation with the community in the case of network server software": "agpl-3-preamble",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
}

# Names of licences as notices write them, normalised, by the notice's identifier.
NAMES = {
    "mit-notice": ["mit", "mit license", "mit licence", "mit x11 license", "expat license"],
    "apache-2-notice": [
        "apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v2", "apache license 2",
        "apache 2 0 license", "apache 2 license", "apache 2 0", "apache 2", "apache v2", "apache v2 license",
        "apache software license 2 0", "apache software license version 2 0", "asl 2 0"],
    "mpl-2-notice": [
        "mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0",
        "mpl 2 0 license", "mpl version 2 0", "mpl v2", "mplv2"],
    "isc-notice": ["isc", "isc license", "isc licence"],
    "bsd-3-notice": [
        "bsd 3 clause", "bsd 3 clause license", "3 clause bsd", "3 clause bsd license", "three clause bsd license",
        "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause new or revised license"],
    "bsd-2-notice": [
        "bsd 2 clause", "bsd 2 clause license", "2 clause bsd", "2 clause bsd license", "two clause bsd license",
        "simplified bsd license", "freebsd license", "bsd 2 clause simplified license"],
    "cc0-notice": [
        "cc0", "cc0 1 0", "cc0 license", "cc0 1 0 universal", "creative commons zero v1 0 universal",
        "creative commons cc0 1 0 universal"],
    "unlicense-notice": ["unlicense"],
    "bsl-1-notice": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "zlib-notice": ["zlib", "zlib license"],
    "epl-2-notice": ["eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0", "epl 2 0"],
    **{f"cc-{short}-4-notice": [
        f"cc {short.replace('-', ' ')} 4 0", f"cc {short.replace('-', ' ')} 4 0 license", f"creative commons {long} 4 0",
        f"creative commons {long} 4 0 international", f"creative commons {long} 4 0 license",
        f"creative commons {long} 4 0 international license"] for short, long in (
            ("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"))},
    **{f"{short}-{version.replace(' ', '.')}-{which}": [
        f"{name}{end}" for v in {version, version if " " in version else f"{version} 0"}
        for name in (
            f"gnu {kind}general public license version {v}", f"gnu {kind}general public license v{v}",
            f"gnu {kind}general public license {v}", f"gnu {short} version {v}", f"gnu {short} v{v}", f"gnu {short} {v}",
            f"gnu {short}v{v}", f"{short} version {v}", f"{short} v{v}", f"{short} {v}", f"{short}v{v}") for end in ends]
       for kind, short, version in (("", "gpl", "2"), ("", "gpl", "3"), ("lesser ", "lgpl", "2 1"), ("lesser ", "lgpl", "3"),
                                    ("affero ", "agpl", "3"))
       for which, ends in (("only", ("", " only", " license")), ("or-later", (" or later", " or any later version")))},
}

# How notices begin, what may follow the name, and what is no notice, over normalised sentences.
BEGINS = (
    "^(?:spdx license identifier|licen[sc]es?|(?:.{0,80} )?(?:licen[sc]ed|released|distributed|available|provided|published|offered|covered)"
    " (?:under|by)(?: (?:the )?terms(?: and conditions)? of)?|under(?: (?:the )?terms(?: and conditions)? of)?)(?: the)? ")
GOES_ON = (
    " (?:the license(?: you may not use this file except in compliance with the license)?"
    "|(?:please )?(?:see|read|refer to|as found in|as described in|as stated in|a copy of which|which can be found|as published by) .{1,120})$")
NO_NOTICE = "(?:^| )not (?:be )?(?:licen[sc]ed|released|distributed|available|provided|published|offered|covered) "

# The rules in the order in which they are tried.
RULES = [
    (["mit-grant", "mit-condition", "mit-warranty"], "MIT"),
    (["mit-grant", "mit-condition"], "MIT"),
    (["mit-notice"], "MIT"),
    (["mit-title"], "MIT"),
    (["apache-2-notice", "apache-2-compliance", "apache-2-copy"], "Apache-2.0"),
    (["apache-2-notice"], "Apache-2.0"),
    (["apache-title", "january-2004", "apache-2-grant"], "Apache-2.0"),
    (["apache-title", "january-2004"], "Apache-2.0"),
    (["apache-2-grant"], "Apache-2.0"),
    (["gpl-3-or-later", "gpl-warranty", "gpl-details"], "GPL-3.0-or-later"),
    (["gpl-3-or-later", "gpl-warranty"], "GPL-3.0-or-later"),
    (["gpl-3-or-later"], "GPL-3.0-or-later"),
    (["gpl-2-or-later", "gpl-warranty", "gpl-details"], "GPL-2.0-or-later"),
    (["gpl-2-or-later", "gpl-warranty"], "GPL-2.0-or-later"),
    (["gpl-2-or-later"], "GPL-2.0-or-later"),
    (["gpl-title", "june-2007", "gpl-3-preamble"], "GPL-3.0-only"),
    (["gpl-title", "june-2007"], "GPL-3.0-only"),
    (["gpl-3-preamble"], "GPL-3.0-only"),
    (["gpl-title", "june-1991", "gpl-2-preamble"], "GPL-2.0-only"),
    (["gpl-title", "june-1991"], "GPL-2.0-only"),
    (["lgpl-title", "june-2007", "lgpl-3-preamble"], "LGPL-3.0-only"),
    (["lgpl-title", "june-2007"], "LGPL-3.0-only"),
    (["lgpl-3-preamble"], "LGPL-3.0-only"),
    (["lgpl-title", "february-1999"], "LGPL-2.1-only"),
    (["gpl-2-preamble"], "GPL-2.0-only"),
    (["agpl-title", "november-2007", "agpl-3-preamble"], "AGPL-3.0-only"),
    (["agpl-title", "november-2007"], "AGPL-3.0-only"),
    (["agpl-3-preamble"], "AGPL-3.0-only"),
    (["gpl-3-only"], "GPL-3.0-only"),
    (["gpl-2-only"], "GPL-2.0-only"),
    (["lgpl-3-or-later"], "LGPL-3.0-or-later"),
    (["lgpl-3-only"], "LGPL-3.0-only"),
    (["lgpl-2.1-or-later"], "LGPL-2.1-or-later"),
    (["lgpl-2.1-only"], "LGPL-2.1-only"),
    (["agpl-3-or-later"], "AGPL-3.0-or-later"),
    (["agpl-3-only"], "AGPL-3.0-only"),
    (["mpl-2-notice", "mpl-2-copy"], "MPL-2.0"),
    (["mpl-2-notice"], "MPL-2.0"),
    (["mpl-2-title"], "MPL-2.0"),
    (["mpl-2-copy"], "MPL-2.0"),
    (["isc-grant"], "ISC"),
    (["isc-notice"], "ISC"),
    (["isc-title"], "ISC"),
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"], "BSD-4-Clause"),
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], "BSD-3-Clause"),
    (["bsd-grant", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    (["bsd-3-notice"], "BSD-3-Clause"),
    (["bsd-2-notice"], "BSD-2-Clause"),
    (["bsd-3-title"], "BSD-3-Clause"),
    (["bsd-2-title"], "BSD-2-Clause"),
    (["unlicense-grant"], "Unlicense"),
    (["unlicense-notice"], "Unlicense"),
    (["bsl-1-notice"], "BSL-1.0"),
    (["zlib-notice"], "Zlib"),
    (["epl-2-notice"], "EPL-2.0"),
    (["cc0-notice"], "CC0-1.0"),
    (["cc0-waiver"], "CC0-1.0"),
    (["cc-by-nc-4-notice"], "CC-BY-NC-4.0"),
    (["cc-by-sa-4-notice"], "CC-BY-SA-4.0"),
    (["cc-by-4-notice"], "CC-BY-4.0"),
    (["all-rights-reserved"], "LicenseRef-all-rights-reserved"),
]

#: Every normalised sentence that is looked up.
KNOWN = {**SENTENCES, **{f"notice {name}": i for i, names in NAMES.items() for name in names}}

#: A sentence before normalisation is at least as long as the shortest name.
SHORTEST, LONGEST = min(len(n) for names in NAMES.values() for n in names), max(map(len, SENTENCES))
#: A sentence before normalisation may be longer by comment marks and white space.
SPARE = 4 * LONGEST
MARK = "\x01"
#: The owner's name in BSD's third condition differs from text to text; what follows it is known.
OWNER = r"[Nn](either|EITHER)\s+([Tt]he|THE)\s+(names?|NAMES?)\s+(of|OF)\s[\s\S]{1,200}?\s(nor|NOR)\s"
LINE_OWNER = r"[Nn](either|EITHER) ([Tt]he|THE) (names?|NAMES?) (of|OF) [^\n]{1,200}? (nor|NOR) "
LINE_ENDS = r"\n|[.!?]+([ \t\r\n]+|$)|" + LINE_OWNER
SENTENCE_ENDS = r"(\n[ \t\r*#/;%!|<>=-]*)+\n|[.!?:]+([ \t\r\n]+|$)|" + OWNER
#: Words of which every licence sentence has one; other sentences are not normalised.
TELLING = (
    "(?i)licen|software|copyright|permission|redistribut|reserved|warranty|cc0|spdx|gpl|january 2004|june 2007|june 1991"
    "|february 1999|november 2007|under (the )?(terms of )?(the )?(mit|isc|bsd|apache|mozilla|mpl|cc|creative|asl|epl|bsl|zlib|gnu|[23])"
    "|copy of the mpl")


def normalised(sentence: Column) -> Column:
    """Lower-case words; a plus sign after a version is "or later", and a notice is "notice" and its name."""
    later = F.regexp_replace(F.lower(sentence), "([0-9])[+]", "$1 or later ")
    plain = F.trim(F.regexp_replace(later, "[^a-z0-9]+", " "))
    notice = F.regexp_replace(F.regexp_replace(plain, BEGINS, "notice "), GOES_ON, "")
    return F.when(plain.rlike(BEGINS) & ~plain.rlike(NO_NOTICE), notice).otherwise(plain)


def placed(text: Column, ends: str) -> Column:
    """The known sentences of one way of reading, as structs (at, id): ``at`` is how many letters
    and digits the text has up to the sentence's end."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    pieces = F.split(F.regexp_replace(text, ends, f"{MARK}$0{MARK}"), MARK)  # the ends are pieces too
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at: int, id: string>>").alias("found"))

    def step(so_far: Column, piece: Column) -> Column:
        at = so_far["at"] + F.length(F.regexp_replace(F.lower(piece), "[^a-z0-9]+", ""))
        near = (F.length(piece) >= SHORTEST) & (F.length(piece) <= SPARE) & piece.rlike(TELLING)
        here = F.struct(at.alias("at"), F.when(near, F.try_element_at(known, normalised(piece))).alias("id"))
        return F.struct(at.alias("at"), F.when(here["id"].isNull(), so_far["found"]).otherwise(
            F.array_append(so_far["found"], here)).alias("found"))
    return F.aggregate(pieces, first, step)["found"]


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in the order of the text."""
    both = F.array_sort(F.array_union(placed(text, LINE_ENDS), placed(text, SENTENCE_ENDS)))
    none = F.array().cast("array<string>")
    return F.when(text.rlike(TELLING), F.transform(both, lambda p: p["id"])).otherwise(none)


def by_rules(found: Column) -> tuple[Column, Column]:
    """The licences of an identifier sequence in the order of the rules, and what no rule took."""
    rest = F.concat(F.lit("|"), F.array_join(found, "||"), F.lit("|"))
    licences = []
    for run, licence in RULES:
        mark = "|" + "||".join(run) + "|"
        licences.append(F.when(F.contains(rest, F.lit(mark)), F.lit(licence)))
        rest = F.replace(rest, F.lit(mark), F.lit("|"))
    return F.array_distinct(F.array_compact(F.array(*licences))), rest


def scan(docs: DataFrame, text: str = "text", name: str = "_scan") -> DataFrame:
    """``docs`` with a struct ``name``: sentence identifiers and licences. A column of that name is an error."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name}; give another name for the result")
    out, known = add_free(docs, identifiers(F.coalesce(F.col(text), F.lit(""))))
    licences, _ = by_rules(F.col(known))
    return out.withColumn(name, F.struct(F.col(known).alias("sentences"), licences.alias("licences"))).drop(known)
