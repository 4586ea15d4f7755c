import re

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm.licenses import RULES, SENTENCES, matched, scan_licenses

MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def naive(text):
    """Known sentences of a text: each segment between ends, else each of its lines."""
    known = {v: k for k, v in SENTENCES.items()}
    norm = lambda s: " ".join(re.findall("[a-z0-9\u0080-\U0010ffff]+", s.lower()))
    out = []
    for s in re.split(r"(?<=[.!?:])\s|\n[ \t\r]*\n", text or ""):
        out += [known[norm(s)]] if norm(s) in known else [known[norm(x)] for x in s.split("\n") if norm(x) in known] if "\n" in s else []
    return out


def test_against_brute_force(spark):
    texts = corpus() + [
        (700, "Some words\nLicensed under the Apache License, Version 2.0.\nmore words here"), (701, "Released under the MIT License. All rights reserved."), (702, MIT), (703, MIT + MIT + "This work is licensed under the GNU General Public License, version 3."),
        (704, "All rights reserved"), (705, "licensed under cc by-nc 4.0"), (706, "you may obtain a copy of the License at\nhttp://x"), (707, "Licensed under the Apache License Version 2.0 (the License);\nyou may not use this file except in compliance with the License."),
    ]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows(texts), DOCS)).collect()}
    for i, t in texts:
        if i == 707:  # `;` ends no sentence, so the plain split does not see the two it holds
            assert list(got[i].sentence_ids) == ["ApacheHead", "ApacheComply"] and list(got[i].licenses) == ["Apache-2.0"]
        elif i is not None:
            assert list(got[i].sentence_ids) == naive(t), i
            hits = matched(naive(t), RULES)
            assert list(got[i].licenses) == list(dict.fromkeys(h[0] for h in hits))
    assert list(got[702].licenses) == ["MIT"] and list(got[703].licenses) == ["MIT", "GPL-3.0-only"] and list(got[701].licenses) == ["MIT", "All-rights-reserved"]
    assert list(got[706].unmatched) == ["ApacheCopy"] and list(got[706].licenses) == []
    m = got[700].matches[0]
    assert "Apache" in texts[[i for i, _ in texts].index(700)][1].encode()[m.start : m.end].decode()
    assert got[60].n_sentences == 0 and got[61].n_sentences == 0


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_rules_in_order():
    assert matched(["a", "b", "c", "a"], [("AB", ["a", "b"]), ("A", ["a"])]) == [("AB", 0, 2), ("A", 3, 4)]
