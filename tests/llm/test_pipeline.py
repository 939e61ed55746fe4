"""Licence scans, and the pipeline's stages against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketlake.llm import licenses, simhash
from docketlake.llm.components import local_roots

SF = "/root/testdata/sf0.001"

# Public licence texts, as input of the scan.
MIT = """Some tool, by somebody.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""

CASES = [
    (None, [], []),
    ("", [], []),
    ("Nothing about a license here.", [], []),
    ("End of a line\nReleased under the MIT License.\nMore text", ["mit-notice"], ["MIT"]),
    ("/* Licensed under the Apache License, Version 2.0. */", ["apache-2-notice"], ["Apache-2.0"]),
    (MIT, ["mit-grant", "mit-condition", "mit-warranty"], ["MIT"]),
    ("All rights reserved.\nLicensed under CC BY-NC 4.0.", ["all-rights-reserved", "cc-by-nc-4-notice"],
     ["CC-BY-NC-4.0", "LicenseRef-all-rights-reserved"]),
    ("Released under the MIT License. Released under the MIT License.", ["mit-notice", "mit-notice"], ["MIT"]),
]


def test_licences(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", "y") for i, (t, *_) in enumerate(CASES)], "doc_id long, text string, licences string, _p string")
    rows = {r["doc_id"]: r["_scan"] for r in licenses.scan(docs).collect()}
    assert {i: (r["sentences"], r["licences"]) for i, r in rows.items()} == {i: tuple(c[1:]) for i, c in enumerate(CASES)}
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs).columns == [*docs.columns, "_scan"]
    with pytest.raises(ValueError, match="column _scan"):
        licenses.scan(docs.withColumnRenamed("_p", "_scan"))


NOTICES = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("MIT License\n\nCopyright (c) 2020 Foo", "MIT"), ("The MIT License (MIT)\nCopyright (c) 2020 Foo", "MIT"),
    ("Code licensed under the Apache License 2.0.", "Apache-2.0"), ("You may use it under the Apache-2.0 license.", None),
    ("It is available under the Apache-2.0 license.", "Apache-2.0"), ("under the Apache-2.0 license", "Apache-2.0"),
    ("License: GPLv3", "GPL-3.0-only"), ("License: GPLv3+", "GPL-3.0-or-later"), ("Licence: BSD-3-Clause", "BSD-3-Clause"),
    ("Released under the terms of the MIT License.", "MIT"), ("Distributed under the MIT license.", "MIT"),
    ("This project is licensed under the MIT License - see the LICENSE.md file for details.", "MIT"),
    ("This project is licensed under the\nMIT License - see the LICENSE file\nfor details.", "MIT"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n"
     "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0-only"), ("Published under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
     " the License.", "Apache-2.0"), ("This work is licensed under a permissive license.", None),
    ("Released under the Boost Software License 1.0", "BSL-1.0"), ("The code is not licensed under the MIT License.", None),
    ("Released under the GNU Lesser General Public License v2.1 or later.", "LGPL-2.1-or-later"),
]


def test_notices(spark):
    got = [licences for _, licences in scanned(spark, [t for t, _ in NOTICES])]
    assert got == [[name] if name else [] for _, name in NOTICES]


def test_sql_reads_alike(spark, tmp_path):
    """The registered SQL on notices, headers plain and commented, and texts partly wrapped."""
    import duckdb

    from docketlake.llm.queries import ORACLE_SQL, op7_license_scan

    texts = [t for t, *_ in CASES] + [t for t, _ in NOTICES] + [commented(t, *m) for t in (MIT, GPL, BSD + THIRD)
                                                                for m in (("/*", " *", " */"), ("", "#", ""))]
    texts += [" ".join(MIT.split()), MIT + GPL + BSD, "word " * 30000 + "\nReleased under the MIT License."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, sentences, licences FROM ({ORACLE_SQL['op7_license_scan']}) ORDER BY doc_id").fetchall()
    assert sorted(tuple(r) for r in op7_license_scan(spark, str(tmp_path)).collect()) == want


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def commented(text, start, mark, end):
    body = "\n".join(f"{mark} {line}".rstrip() for line in ["Copyright (C) 2020 Foo", "", *text.splitlines()])
    return f"{start}\n{body}\n{end}\n"


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r["_scan"]["sentences"], r["_scan"]["licences"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_headers_plain_and_commented(spark):
    marks = [("/*", " *", " */"), ("", "#", ""), ("", "//", ""), ("", "", "")]
    two = GPL.replace("version 3", "version 2").replace("software:", "software;")
    for text, ids, licence in (
            (MIT, ["mit-grant", "mit-condition", "mit-warranty"], "MIT"),
            (GPL, ["gpl-3-or-later", "gpl-warranty", "gpl-details"], "GPL-3.0-or-later"),
            (two, ["gpl-2-or-later", "gpl-warranty", "gpl-details"], "GPL-2.0-or-later")):
        texts = [text, text.replace("\n", "\r\n"), *[commented(text, *m) for m in marks]]
        assert scanned(spark, texts) == [(ids, [licence])] * len(texts)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERTISING = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software.
"""


def test_common_licences_have_their_names(spark):
    words = " ".join(GPL.split())
    cases = [
        (BSD, "BSD-2-Clause"), (BSD + THIRD, "BSD-3-Clause"), (BSD + ADVERTISING + THIRD, "BSD-4-Clause"),
        (BSD + THIRD.replace("the copyright holder", "Foo Inc."), "BSD-3-Clause"),
        (BSD + THIRD.replace("the copyright holder", "the University of Foo"), "BSD-3-Clause"),
        (commented(BSD + THIRD, "/*", " *", " */"), "BSD-3-Clause"), (" ".join((BSD + THIRD).split()), "BSD-3-Clause"),
        (GPL.replace("General", "Lesser General"), "LGPL-3.0-or-later"),
        (GPL.replace("General", "Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1-or-later"),
        (GPL.replace("General", "Affero General"), "AGPL-3.0-or-later"),
        (words.replace(", or (at your option) any later version", "").replace("either version 3", "version 2"),
         "GPL-2.0-only"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby"
         " granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        ("Released under CC0 1.0.", "CC0-1.0"),
    ]
    assert [licences for _, licences in scanned(spark, [text for text, _ in cases])] == [[name] for _, name in cases]


def test_every_known_sentence_is_looked_up():
    assert all(re.search(licenses.TELLING, s) for s in licenses.SENTENCES)
    names = [n for some in licenses.NAMES.values() for n in some]
    assert all(re.search(licenses.TELLING, f"under {n}") for n in names if n != "unlicense")
    assert not any(re.search(licenses.GOES_ON, f" {n}") for n in names)
    assert {i for run, _ in licenses.RULES for i in run} <= set(licenses.KNOWN.values())
    assert set(licenses.KNOWN.values()) <= {i for run, _ in licenses.RULES for i in run} | {"gpl-details", "lgpl-details", "agpl-details"}


def test_partly_wrapped_texts_keep_their_order(spark):
    grant, condition, warranty = MIT.split("\n\n", 1)[1].split("\n\n")
    line = " ".join(condition.split())
    texts = ["\n\n".join(x) for x in (
        (grant, line, warranty), (" ".join(grant.split()), condition, warranty), (grant, condition, " ".join(warranty.split())))]
    known = ["mit-grant", "mit-condition", "mit-warranty"]
    assert scanned(spark, texts) == [(known, ["MIT"])] * 3
    twice = "All rights reserved\n\n" + texts[0] + "\n" + texts[1] + "\nReleased under the MIT License"
    assert scanned(spark, [twice]) == [
        (["all-rights-reserved", *known, *known, "mit-notice"], ["MIT", "LicenseRef-all-rights-reserved"])]


def test_earlier_rules_take_their_sentences(spark):
    row = spark.range(1).select(*licenses.by_rules(F.array(*map(F.lit, ["gpl-3-or-later", "gpl-warranty", "gpl-details", "x"]))))
    assert tuple(row.head()) == (["GPL-3.0-or-later"], "||x|")


def test_scan_stays_in_the_engine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = licenses.scan(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count()
        assert kept.join(before, kept.columns, "left_anti").count() == 0
    rows = kept.collect()
    assert not near_pairs([r["text"] for r in rows])
    packed = corpus_pipeline.STAGES[3][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == len(rows)


def shingled(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def near_pairs(texts):
    """Index pairs of texts with a five-word Jaccard similarity of 0.8 or more."""
    sets, by_shingle, seen = [shingled(t) for t in texts], {}, {}
    for i, some in enumerate(sets):
        for x in some:
            for j in by_shingle.setdefault(x, []):
                seen[j, i] = seen.get((j, i), 0) + 1
            by_shingle[x].append(i)
    none = [i for i, some in enumerate(sets) if not some]
    return [p for p, n in seen.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + list(zip(none, none[1:]))


def edited(rng, text, share):
    words = text.split()
    for k in rng.integers(0, len(words), max(1, int(share * len(words)))):
        words[k] = f"w{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicate_stage_against_brute_force(spark, sf):
    """All pairs of similar texts are found in these tables, so one document of each group stays."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    pairs = near_pairs([r["text"] for r in rows])
    root = local_roots(len(rows), *(np.array(x, int) for x in zip(*pairs)))
    want = [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]
    assert len(want) < len(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()) == want


def test_near_copies_planted_in_documents(spark):
    """Edited copies go, in pairs and in a crowd; texts that only share most words or a half stay."""
    rng = np.random.default_rng(9)
    texts = [t for t in (r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
             if 80 <= len(t.split()) <= 900]
    chosen = [texts[i] for i in rng.permutation(len(texts))[:150]]
    chosen = [t for i, t in enumerate(chosen) if not any(p[0] == i or p[1] == i for p in near_pairs(chosen))]
    rows = list(chosen)
    rows += [edited(rng, t, 0.015) for t in chosen[:100]] + [edited(rng, chosen[0], 0.01) for _ in range(200)]
    shuffled = [" ".join(rng.permutation(t.split())) for t in chosen[100:]]  # the same words
    halves = [" ".join(t.split()[: len(t.split()) // 2] + texts[k].split()) for k, t in enumerate(chosen[100:])]
    rows += shuffled + halves
    pairs = near_pairs(rows)
    root = local_roots(len(rows), *(np.array(x, int) for x in zip(*pairs)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.near_copies(docs).collect()}
    single = {i for i in range(len(rows)) if (root == root[i]).sum() == 1}
    assert single <= kept and len(single) > 40
    extra = [i for i in kept if root[i] != i]
    assert len(extra) <= 0.05 * len(pairs) and len(extra) <= 0.1 * (root != np.arange(len(rows))).sum()


def test_odd_documents_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 2.0), (2, "a b c", None, None, 5, None),
         (2, "a b c", None, None, 5, None)],
        "doc_id long, text string, lang string, source string, n_chars long, _p double")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.near_duplicate_stage(spark, docs, SF).count() == 2
    assert corpus_pipeline.packing_stage(spark, docs, SF).count() == 4


def test_run(spark):
    first = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(first.columns)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_quality_stage_decides_by_its_model(spark):
    """The rows that stay are those that the model, fitted on the same input, selects."""
    from docketlake.llm import quality

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf}/labels.parquet")))
    rows = docs.select("doc_id", quality.predict(model, "text", spark).alias("p")).collect()
    want = sorted(r["doc_id"] for r in rows if r["p"]["tails"][-1] >= quality.LEAST)
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
