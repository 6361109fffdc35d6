"""Quality rules, language identification, toxicity and licence scan."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwright.llm import langid, licenses, quality, toxicity


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    sh = list(zip(*[w[i:] for i in range(5)]))
    cover = {j for i, s in enumerate(sh) if sh.count(s) > 1 for j in range(i, i + 5)}
    return (
        len(w),
        sum(map(len, w)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(cover),
        len(w) < 10 or 100 * len(cover) > 20 * len(w),
    )


def test_quality_counts(spark, docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(40))) + rng.choice(["", "\n#x\n#x", "\n\n"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    by_text = {r.text: r.doc_id for r in df.where("text is not null").collect()}
    got = {r.doc_id: r for r in quality.score(df.where("doc_id < 1 or doc_id > 20 or doc_id is null or doc_id <= 20")).collect()}
    for text, i in by_text.items():
        if i is not None and sum(1 for r in by_text.values() if r == i) == 1 and i not in range(12):
            assert tuple(got[i][f] for f in fields) == brute_quality(text)
    alone = {r.doc_id: r for r in quality.score(docs).collect()}
    for r in docs.collect():
        if r.doc_id not in (None, 6):
            assert tuple(alone[r.doc_id][f] for f in fields) == brute_quality(r.text)
    assert not alone[1].kept and alone[1].n_words == 0


def test_quality_filter_keeps_columns(docs, no_docs):
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 7 in ids and not ids & {1, 2, 3, 4, 11}
    assert quality.filter_documents(no_docs).count() == 0 and quality.score(no_docs).count() == 0


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = {"en": "the ing tion er and of", "de": "sch der und ung ein keit", "fr": "eau eux les que ai ment"}
    out = []
    for i in range(n):
        lang = list(syllables)[i % 3]
        s = syllables[lang].split()
        out.append((i, " ".join("".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(30)), lang))
    return out


def test_language_accuracy(spark):
    df = spark.createDataFrame(corpus(240), "doc_id long, text string, lang string")
    out = langid.detect(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 240 and held
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_rows(spark, docs, no_docs):
    train = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string")
    both = train.withColumn("doc_id", train.doc_id + 100).unionByName(docs.select("doc_id", "text", "lang"))
    rows = {r.doc_id: r for r in langid.detect(both).collect()}
    assert len(rows) == 72 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 11))
    assert rows[7].lang_pred in ("en", "de", "fr")
    assert langid.detect(no_docs).count() == 0
    unlabelled = docs.drop("lang")
    assert {r.lang_pred for r in langid.detect(unlabelled).collect()} == {"und"}
    kept = langid.filter_documents(docs)
    assert kept.columns == docs.columns and langid.filter_documents(no_docs).count() == 0


def test_letters_and_many_languages_and_frequent_ids(spark):
    """Number signs are no letters; hundreds of languages are learned; an id on most rows does not fill the sample."""
    assert [langid.has_letter(t) for t in ("²½", "Ⅷ ①", "1_2", "", "²a", "日", "½ß")] == [False, False, False, False, True, True, True]
    rows = []
    for n in range(300):
        word = f"{chr(0x4E00 + 7 * n)}{chr(0x4E03 + 7 * n)}"
        rows += [(1000 * n + i, f"{word} {word}{chr(0x4E01 + 7 * n)} " * 4, f"l{n:03}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, langid.held_out(2, 4))
    assert len(model.languages) == 300
    out = langid.identify(df, model).collect()
    assert np.mean([r._lang == r.lang for r in out]) > 0.95
    hot = spark.range(100_000).selectExpr("cast(7 as long) as doc_id", "concat('the same ', 'text') as text", "'en' as lang")
    mixed = hot.unionByName(spark.createDataFrame(corpus(90), "doc_id long, text string, lang string"))
    assert len(langid.train(mixed, langid.held_out(2, 4), max_rows=300).languages) == 3


def test_language_scores_equal_plain_regression(spark):
    """Predictions of the stored chunks against the model applied n-gram by n-gram."""
    df = spark.createDataFrame(corpus(90), "doc_id long, text string, lang string")
    m = langid.train(df, langid.held_out(2, 4))
    got = {r.doc_id: r for r in langid.identify(df, m).collect()}
    for i, text, _ in corpus(90):
        cells = langid.text_cells(text)
        s = (m.table[cells].sum(0) / len(cells) * langid.SCALE + m.bias) / m.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        assert got[i]._lang == m.languages[int(p.argmax())] and got[i]._score == pytest.approx(p.max(), rel=1e-3)


def test_languages_of_one_row_and_shared_weights(spark):
    """A language's only row is learned; where cells share weights the model is small and still tells languages apart."""
    assert langid.fifths(np.array([1, 0, 1, 1, 1, 1, 0, 2, 1])).tolist() == [False] * 5 + [True] + [False] * 3
    words = [f"{chr(0x4E00 + 7 * n)}{chr(0x4E03 + 7 * n)}{chr(0x4E01 + 7 * n)}" for n in range(20)]
    df = spark.createDataFrame([(n, f"{w} " * 12, f"l{n:02}") for n, w in enumerate(words)], "doc_id long, text string, lang string")
    nothing = F.lit(False)
    assert [r._lang == r.lang for r in langid.identify(df, langid.train(df, nothing)).collect()] == [True] * 20
    small = langid.train(df, nothing, max_weights=20 * 1024)
    assert small.table.shape == (1024, 20)
    assert np.mean([r._lang == r.lang for r in langid.identify(df, small).collect()]) >= 0.9


def test_label_and_id_are_no_inputs(spark):
    df = spark.createDataFrame(corpus(120), "doc_id long, text string, lang string")
    model = langid.train(df, langid.held_out(2, 4))
    twice = df.limit(1).unionByName(df.limit(1).selectExpr("doc_id + 999 as doc_id", "text", "'xx' as lang"))
    got = langid.identify(twice, model).collect()
    assert got[0]._lang == got[1]._lang and got[0]._score == got[1]._score


def insults(n, seed=2):
    rng = random.Random(seed)
    words = "ing tion heed ther and of stone water meadow lyes".split()
    rows = []
    for i in range(n):
        body = rng.choices(words, k=40)
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            body.insert(rng.randrange(40), rng.choice(["blorgix", "zumpfak"]) + rng.choice(["", "en", "ed"]))
        rows.append((i, " ".join(body) + ".", int(toxic)))
    return rows


#: Insults with blanks, marks and letters put in; then clean ones.
SPLIT = {
    904: "stone blor gix water",
    905: "bl or gix",
    906: "heed b-l-o-r-g-i-x of",
    907: "stone zumxpfak of water",
    908: "zu - mp fa k",
    909: "Blorgix!",
    911: "water of stone and meadow lyes",
}


def test_toxicity(spark, no_docs):
    rows = insults(200)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "you b.l.orgix"), (903, "z u m p f a k now"), *SPLIT.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(out) == 204 + len(SPLIT)
    assert all(out[i].predicted == y for i, _, y in rows)
    assert out[900].predicted == 0 and out[901].predicted == 0 and 0 <= out[901].score <= 1
    assert out[902].score > out[901].score and out[903].score > out[901].score
    assert [out[i].predicted for i in SPLIT] == [1, 1, 1, 1, 1, 1, 0]
    none = toxicity.score(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(no_docs, labels).count() == 0


def test_toxicity_with_a_frequent_id(spark):
    """Rows of one clean id, more than the whole sample, leave the scores of the others as they were."""
    from pyspark.sql import functions as F

    rows = insults(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").unionByName(spark.createDataFrame([(7_001, 0)], "doc_id long, toxic int"))
    often = spark.range(60_000).select(F.lit(7_001).cast("long").alias("doc_id"), F.concat(F.lit("stone and water "), (F.col("id") % 50).cast("string")).alias("text"))
    model = toxicity.train(docs.unionByName(often).repartition(6), labels, F.lit(False))
    margins = model.margins(model.lexicon(), [t for _, t, _ in rows])
    assert all((p >= 0.5) == bool(y) for p, (_, _, y) in zip(model.probability(margins), rows))


def test_kernel_is_what_its_table_says():
    marks = ["blorgix", "water", "ab"]
    k = toxicity.kernel(["blorgix", "b-l-orgix", "meadow", ""], marks)
    assert k[0, 0] == max(k[:, 0]) and 0 < k[1, 0] < k[0, 0] and k[3].tolist() == [0, 0, 0]

    def brute(s, t):
        def feats(x):
            c = [31] + [toxicity.letter_code(ch) for ch in x]
            f = {}
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for m in range(j + 1, len(c)):
                        if m - i < toxicity.SPAN:
                            u = (c[i], c[j], c[m])
                            f[u] = f.get(u, 0) + toxicity.DECAY ** (m - i + 1)
            return f

        a, b = feats(s), feats(t)
        return sum(v * b.get(u, 0) for u, v in a.items()) / (toxicity.NORM[len(s) + 1] * toxicity.NORM[len(t) + 1])

    assert k[1, 0] == pytest.approx(brute("b-l-orgix", "blorgix"), rel=1e-4)
    assert k[2, 1] == pytest.approx(brute("meadow", "water"), rel=1e-4, abs=1e-6)


def test_windows_of_sentences():
    """Neighbouring chunks of one sentence meet, also as runs of short ones; nothing crosses a sentence's end."""
    got = toxicity.sentences("The blor. gix of b-l a\ni d - o *** Meadows, lyes?! x")
    assert got[0] == ["the", "blor", "theblor"]
    assert {"gixof", "gix", "ofblaido", "ofbla"} <= set(got[1]) and not any("blorgix" in w for s in got for w in s)
    assert got[-1] == ["x"] and "meadowslyes" in got[1] and toxicity.sentences(" *** ") == []


def test_scores_equal_the_kernel_machine(spark):
    """The scores that batches of texts get, window by window against the folded table's definition; no text sways another."""
    rows = insults(120, seed=5)
    model = toxicity.learn([(t, y) for _, t, y in rows])
    texts = [t for _, t, _ in rows[:40]] + ["", "a b c d e", "blor gix. x", "Ärger", "x" * 100, "blorgix" + "y" * 40]
    got = model.margins(model.lexicon(), texts)

    def score(w):
        best = -9.0
        for i in range(max(1, len(w) + 1 - toxicity.WINDOW + 0)):
            c = [31] + [toxicity.letter_code(ch) for ch in w]
            if len(w) <= toxicity.WINDOW:
                some, of = range(len(c)), len(c)
            else:
                some, of = range(i, i + toxicity.WINDOW), toxicity.WINDOW
            total = 0.0
            for a in some:
                for b in range(a + 1, len(c)):
                    for d in range(b + 1, min(len(c), a + toxicity.SPAN)):
                        total += toxicity.DECAY ** (d - a + 1) * model.table[(c[a] * 32 + c[b]) * 32 + c[d]]
            best = max(best, total / toxicity.NORM[of])
            if len(w) <= toxicity.WINDOW:
                break
        return best

    for text, value in zip(texts, got):
        want = max((score(w) for s in toxicity.sentences(text) for w in s), default=0.0)
        assert value == pytest.approx(want + model.bias, abs=1e-4), text
    alone = [model.margins(model.lexicon(), [t])[0] for t in texts]
    assert alone == got.tolist()


def test_licences(spark, docs, no_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = {
        1: "Intro.\nLicensed under the Apache License, Version 2.0.",
        2: "Released under the MIT License. More words.",
        3: mit,
        4: "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        5: "We talk about the MIT License here.",
        6: None,
        7: "",
        8: "Released under the MIT License.\nReleased under the MIT License.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_matches) for r in licenses.scan(df).collect()}
    assert got == {1: ("Apache-2.0", 1), 2: ("MIT", 1), 3: ("MIT", 1), 4: ("GPL-3.0,CC-BY-NC-4.0", 2), 5: ("", 0), 6: ("", 0), 7: ("", 0), 8: ("MIT", 2)}
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_docs).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. N. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
GPL = """A program's name
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY.

You should have received a copy of the GNU General Public License
along with this program.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
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

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_licences(spark, mark):
    from turnwright.llm import licenses

    texts = ["\n".join((mark + line).rstrip() if mark else line for line in t.splitlines()) for t in (MIT, GPL, APACHE, BSD)]
    df = spark.createDataFrame(list(enumerate([*texts, "A licence.\nNo\npermission\nof any kind"])), "doc_id long, text string")
    got = [(r.licenses, r.n_matches) for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [("MIT", 1), ("GPL-3.0", 1), ("Apache-2.0", 1), ("BSD-2-Clause", 1), ("", 0)]
    ids = licenses.scan(df).where("doc_id = 2").first().sentence_ids.split(",")
    assert ids == ["ApacheNotice", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]


def test_licence_sql_reads_wrapped_texts(spark):
    """The same rows by DuckDB, wrapped texts, comments and repeated rows among them."""
    import duckdb
    import pandas as pd

    marked = ["\n".join((m + x).rstrip() for x in t.splitlines()) for m in ("", "# ", " * ", "; ") for t in (MIT, GPL, APACHE, BSD)]
    texts = [*marked, " ".join(marked[:4]), None, "", "Released under the MIT License.\n\n;\nLicensed under CC BY-NC 4.0.", "All rights\nreserved.", marked[0]]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.sql(licenses.duckdb_sql()).df().sort_values("doc_id")
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert len(documents) == len(got)
    for name in got.columns:
        assert got[name].tolist() == want[name].tolist(), name


LICENCE_TEXTS = {
    "MIT": ["All rights reserved\n" + MIT, "Copyright A. N. Author\nAll rights reserved\n" + MIT.split("\n\n", 2)[2], "This project is licensed under the MIT license."],
    "Apache-2.0": [
        "                              Apache License\n                        Version 2.0, January 2004\n                     http://www.apache.org/licenses/\n\n"
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.",
        "// SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0": [GPL.replace("version 3", "version 2"), "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\nPreamble", "/* SPDX-License-Identifier: GPL-2.0-or-later */"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "The code is distributed under the GNU GPLv3."],
    "LGPL-2.1": [GPL.replace("version 3", "version 2.1").replace("GNU General", "GNU Lesser General").replace("program", "library")],
    "AGPL-3.0": [GPL.replace("GNU General", "GNU Affero General"), "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
        "copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE.'
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\n"
        "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications.\n\n1. The origin of this software must not be misrepresented; you must not."
    ],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation."],
    "": ["The licence of this project is not decided.", "This project is not licensed under the MIT license.", "all rights reserved\x03by\x03 nobody\x02"],
}


def test_standard_licence_texts(spark):
    """Known lines do not hide the wrapped sentences around them; names, titles and SPDX lines; equal to the SQL."""
    import duckdb
    import pandas as pd

    spdx = [(name, f"# SPDX-License-Identifier: {name}") for name in licenses.NAMES]
    cases = [(name, text) for name, texts in LICENCE_TEXTS.items() for text in texts] + spdx
    assert len(licenses.NAMES) >= 25
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = licenses.scan(df).toPandas().sort_values("doc_id")
    for (name, text), found, n in zip(cases, got["licenses"], got["n_matches"]):
        assert (found, n) == (name, 1 if name else 0), text
    documents = pd.DataFrame({"doc_id": range(len(cases)), "text": [text for _, text in cases]})
    want = duckdb.sql(licenses.duckdb_sql()).df().sort_values("doc_id")
    assert len(documents) == len(got)
    for name in got.columns:
        assert got[name].tolist() == want[name].tolist(), name


def test_a_step_does_not_keep_another_steps_store(spark):
    """Workers drop what an earlier step kept before vectors are summed; texts do not come back from Python."""
    from turnwright.llm import common

    def seed(batches):
        common.worker_state("store of another step", lambda: [0])
        yield from batches

    def kept(batches):
        return np.full(32, len(common._STATE) + 0 * sum(map(len, batches)))

    rows = spark.range(0, 80, 1, 8)
    rows.mapInPandas(seed, "id long").count()
    assert common.summed_vector(rows, kept, 32).sum() == 0
    df = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string")
    out = langid.identify(df, langid.train(df, langid.held_out(2, 4)))
    assert out.columns == ["doc_id", "lang", "_lang", "_score"] and out.count() == 60
