import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

from tidemark.llm.warc import LoserTree, capture_history, capture_runs, records, url_key, with_revisits, write_archives

PAGES = "page_id long, url string, html string, value string, digest string"


def pages():
    big = "<p>päge</p>\r\n\r\nWARC/1.1\r\n" * 60
    out = [(i, f"http://www.Host{i % 3}.example.com:80/p{i % 4}?q=1#f", f"<html>{i}</html>" * (i * 5), "v", "d") for i in range(30)]
    out += [(100, "http://a.org/x y", big, "v", "d"), (101, "http://a.org/", big, "v", "d"), (102, None, big, "v", "d"), (103, "b", None, "v", "d"), (104, "c", "", "v", "d"), (105, "http://a.org/", "s" * 999, "v", "d"), (106, "http://a.org/", "s" * 999, "v", "d")]
    out += [(None, "http://n.org/", big, "v", "d"), (101, "http://a.org/", big, "v", "d"), (300, "u", "z" * 200_000, "v", "d")]
    return out


def brute(rows):
    keeper = defaultdict(lambda: None)
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            keeper[html] = max(keeper[html] or 0, i)
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        k = keeper[html] if len(b) >= 1000 and sum(h == html for _, _, h, *_ in rows) > 1 else None
        again = k is not None and k != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", k if again else None))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    df = spark.createDataFrame(pages(), PAGES)
    got = capture_history(df).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == brute(pages())
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert capture_history(df.limit(0)).count() == 0


def test_archives_on_disk(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES).coalesce(1)
    write_archives(records(with_revisits(df)), str(tmp_path / "w"), per_file=7)
    files = list(Path(tmp_path / "w").glob("*.gz"))
    assert len(files) >= len(pages()) // 7
    runs = capture_runs(spark, str(tmp_path / "w")).collect()
    for f in files:
        data = gzip.decompress(f.read_bytes())
        own = [r for r in runs if r.run == f.name]
        assert sum(r.length for r in own) == len(data)
        for r in own:
            assert data[r.offset :].startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted([("r", f"k{rng.randint(0, 9)}", "t", rng.randint(0, 9), *[None] * 5, j, 0) for j in range(rng.randint(0, 12))], key=lambda r: (r[1], r[2], r[3], r[9])) for _ in range(k)]
        got = [(r[1], r[3], r[9]) for r in LoserTree(runs)]
        assert got == sorted((r[1], r[3], r[9]) for run in runs for r in run)


def test_url_key():
    assert url_key("https://user@www.Example.COM:8080/a?b#c") == "com,example)/a?b"
    assert url_key("") == ")/"
