import re

import __spark_entry__ as entry
from fleetlens.llm import licences

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
STATED = {"CC BY-NC 4.0": "CC-BY-NC", "GNU General Public License, version 3": "GPL", "Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT"}


def stated(text):
    return sorted({f for name, f in STATED.items() if re.search(rf"(?m)^[^\n]*{re.escape(name)}", text or "")})


def test_whole_table_finds_the_stated_licences(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.queries()["op6_licence_scan"](spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and sum(r["n_licences"] for r in rows) > 0
    for r in rows:
        assert [f for f in r["families"].split(",") if f] == stated(docs[r["doc_id"]]), docs[r["doc_id"]][:200]


def test_odd_rows_and_other_wordings(spark):
    rows = [(1, "Some prose about permission and a licence to kill.\n\n"), (2, None), (3, ""), (4, "x " * 100_000), (None, "This software is available under the BSD 3-Clause License"),
            (5, "intro\nThe code in this folder is licensed under the GNU Lesser General Public License, version 3.\nend"), (6, "Licensed under the MIT License.\nLicensed under the MIT License."),
            (6, "Distributed under the Mozilla Public License, version 2.0."), (7, "MIT is a university in Massachusetts."),
            (8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    df = spark.createDataFrame([(k, t, "w", 1.0) for k, t in rows], "doc_id long, text string, words string, probability double")
    model = licences.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licences"], r["families"]) for r in licences.documents_with_licences(df, model).collect()}
    assert got[1] == (1, 0, []) and got[2] == got[3] == (0, 0, []) and got[4][1] == 0 and got[None][2] == ["BSD"]
    assert got[5] == (3, 1, ["LGPL"]) and got[6] == (3, 3, ["MIT", "MPL"]) and got[8][2] == ["BSD"]
    assert licences.documents_with_licences(df.limit(0), model).count() == 0


def test_fit_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.fit(empty).temperature in licences.TEMPERATURES


WRAPPED = {
    "BSD": "Copyright (c) 2019, The Authors\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code",
    "ISC": "/*\n * Copyright (c) 2019 The Authors\n *\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice appear in all copies.\n */\nint main;",
    "Apache-2.0": "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n# http://www.apache.org/licenses/LICENSE-2.0",
}


def test_wrapped_notices_and_dual_licences(spark):
    dual = {"Licensed under either of Apache License, Version 2.0 or the MIT License": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
            "Licensed under the GNU General Public License or the GNU Lesser General Public License, version 3.": ["GPL", "LGPL"], "This work is licensed under CC BY-NC 4.0.": ["CC-BY-NC"],
            "Distributed under the GNU Lesser General Public License.": ["LGPL"]}
    cases = [(t, [f]) for f, t in WRAPPED.items()] + list(dual.items())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    model = licences.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r["doc_id"]: r["families"] for r in licences.documents_with_licences(df, model).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert max(len(re.findall(r"[^\W_]+", t)) for texts in (*licences.NAMES.values(), *licences.TEXTS.values()) for t in texts) <= licences.WINDOW - licences.STRIDE


def test_hint_words_are_in_all_that_can_be_confirmed():
    hints = set(licences.hint_words())
    for family, texts in licences.NAMES.items():
        for template in (*texts, *licences.TEXTS.get(family, [])):
            words = licences.plain(template)
            pairs = set(zip(words, words[1:])) or {tuple(words)}
            assert sum(1 for p in pairs if not hints & set(p)) < licences.CONFIRMED * len(pairs)
        assert all(hints & set(p.split()) for one in licences.beside(family) for p in one)


def test_units_without_hint_words_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-i, t) for i, t in enumerate([*WRAPPED.values(), "Licensed under Apache-2.0 OR MIT", "mit und ohne", "CC0", "The Unlicense"], 1)], "doc_id long, text string")
    model = licences.fit(docs)

    def rows():
        return sorted(tuple(r) for r in licences.documents_with_licences(docs.unionByName(more), model).select("doc_id", "n_paragraphs", "n_licences", "families", "probability").collect())

    got = rows()
    monkeypatch.setattr(licences, "worth_judging", lambda words: licences.F.lit(True))
    assert got == rows()
