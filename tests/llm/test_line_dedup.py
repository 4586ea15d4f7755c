import hashlib
from collections import defaultdict

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm.line_dedup import drop_repeated_lines

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(texts, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= min_docs and i != max(held[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, texts):
    df = spark.createDataFrame(rows(texts), DOCS)
    out = drop_repeated_lines(df)
    assert out.columns == [*df.columns, "kept_text", "n_lines", "n_dropped"]
    return sorted([(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()], key=repr)


def test_against_brute_force(spark):
    texts = corpus() + [(900, "ÄÖ " * 9), (901, "äö " * 9), (902, "ÄÖ " * 9 + "\n" + "ÄÖ " * 9), (903, "ÄÖ " * 9)]
    assert run(spark, texts) == brute(texts)


def test_everything_dropped_and_empty_table(spark):
    line = "exactly the same long line here"
    texts = [(1, line), (2, line), (3, line + "\n" + line)]
    got = run(spark, texts)
    assert got == brute(texts) and got[0] == (1, "", 1, 1) and got[2][3] == 0
    assert run(spark, []) == []


def test_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a", "old", 7)], "doc_id long, text string, kept_text string, n_lines long")
    row = drop_repeated_lines(df).first()
    assert (row.kept_text, row.n_lines) == ("a", 1)
    assert hashlib.sha256(row.kept_text.encode()).hexdigest()
