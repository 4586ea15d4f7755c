"""Rules as tables of inputs and expected values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, text, timeutil
from tidemark.operators import history, listings, places, stories, weather


def ask(spark, schema, cases, *columns):
    """Rows of expressions over cases, in order."""
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}").coalesce(1)
    return [tuple(r[1:]) if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_state_changed(spark):
    cases = [("a", "f", True, "a", "f", False), ("a", "f", True, "b", "f", True), ("a", "f", True, "a", "g", True), ("a", "f", False, "a", "f", True), (None, None, True, "", "", False), (None, "f", True, "x", "f", True), ("a", None, True, "a", "f", True)]
    got = ask(spark, "ps string, pf string, pa boolean, s string, f string, want boolean", cases, history.state_changed(*[F.col(c) for c in ("ps", "pf", "pa", "s", "f")]))
    assert got == [c[-1] for c in cases]


def test_fingerprints(spark):
    ring = [[-85, 35], [-85, 35.1], [-84.9, 35.1], [-85, 35]]
    poly, multi = f'{{"type":"Polygon","coordinates":[{ring}]}}', f'{{"type":"MultiPolygon","coordinates":[[{ring}]]}}'
    cases = [(None, 35.04, -85.31), (None, None, -85.31), (None, 35.04 + 1e-9, -85.31), (poly, None, None), (multi, 1.0, 2.0), ('{"type":"Point","coordinates":[1.5,2,3]}', None, None), (None, 35.0451234567, -85.3097654321)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g string, lat double, lon double")
    got = [r.f for r in geo.with_fingerprint(rows, "g", name="f").orderBy("i").collect()]
    assert got[:5] == ["-85.310000,35.040000", None, "-85.310000,35.040000", "1e3c7f63daf4a510065e511d7c370ed1ef8ca025", "37addbf384b68e32171b98a9a9d0eb47188c1e41"]
    assert len(got[5]) == 40 and got[6] == "-85.309765,35.045123"


def test_boxes(spark):
    assert geo.parse_bbox("1,2,3,4.5") == (1, 2, 3, 4.5)
    for bad in ("1,2,3", "a,b,c,d", "1,2,3,4,5"):
        with pytest.raises(ValueError):
            geo.parse_bbox(bad)
    square = '{"type":"Polygon","coordinates":[[[0,0],[0,10],[10,10],[10,0],[0,0]],[[4,4],[4,6],[6,6],[6,4],[4,4]]]}'
    cases = [(square, 1.0, 1.0, 2.0, 2.0, True), (square, 4.5, 4.5, 5.5, 5.5, False), (square, 10.0, 10.0, 12.0, 12.0, True), (square, 11.0, 0.0, 12.0, 1.0, False), (square, -5.0, -5.0, 20.0, 20.0, True), ('{"type":"Point","coordinates":[1,2]}', 0.0, 0.0, 1.0, 2.0, True), (None, 0.0, 0.0, 1.0, 1.0, False)]
    assert ask(spark, "g string, a double, b double, c double, d double, want boolean", cases, geo.shape_meets_box("g", "a", "b", "c", "d")) == [c[-1] for c in cases]


def test_distances(spark):
    down, memphis = (35.0456, -85.3097), (35.1495, -90.0490)
    h, s = ask(spark, "a double, b double, c double, d double", [(*down, *memphis)], geo.haversine_miles(*[F.col(c) for c in "abcd"]), geo.spheroid_meters("a", "b", "c", "d"))[0]
    assert abs(h - 267.9) < 0.5 and abs(s / geo.METERS_PER_MILE - h) < 0.006 * h
    # a published line on WGS84: 1 degree of longitude on the equator
    assert abs(ask(spark, "a double", [(0.0,)], geo.spheroid_meters("a", "a", "a", F.lit(1.0)))[0] - 111319.491) < 0.01
    assert ask(spark, "a double", [(1.5,), (None,)], geo.ewkt_point(F.col("a"), F.lit(-2.0))) == ["SRID=4326;POINT(-2.0 1.5)", None]


def test_titles(spark):
    cases = [("The Jazz Night!", "jazz night"), ("Cars & Coffee", "cars coffee"), ("On The At", "on the at"), ("", ""), (None, ""), ("Ünïcode  a1", "code a1")]
    assert ask(spark, "t string, want string", cases, text.normal_title(F.col("t"))) == [c[1] for c in cases]
    pairs = [("Ooltewah Sonic Cruise In", "Oltewah Cruise", True), ("Cars and Coffee", "Cars & Coffee Franklin", True), ("Coffee", "Coffee", False), ("Run 731", "Run 732", False), ("big band big", "big band", True), ("big big", "big band", False), ("memphis show", "memphs show x", True)]
    got = ask(spark, "a string, b string, want boolean", pairs, text.tokens_match(text.title_tokens(F.col("a")), text.title_tokens(F.col("b"))))
    assert got == [p[2] for p in pairs] == [listings._titles(listings._tokens(a), listings._tokens(b)) for a, b, _ in pairs]


def test_truncate(spark):
    cases = [("short", "short"), ("x" * 30 + ". " + "y" * 40, "x" * 30 + "."), ("word " * 10 + "w" * 30, ("word " * 10).rstrip() + "…"), ("a, " + "b" * 60, "a…"), ("z" * 60, "z" * 50 + "…"), ("A. " + "b " * 40, None)]
    got = ask(spark, "t string, want string", cases, text.truncate_sentences(F.col("t"), 50))

    def plain(t):
        if len(t) <= 50:
            return t
        cut = t[:50]
        for sep in (". ", "! ", "? "):
            if cut.rfind(sep) > 25:
                return cut[: cut.rfind(sep) + 1]
        k = cut.rfind(" ")
        return (cut[:k] if k > 0 else cut).rstrip(",;:") + "…"

    assert got == [plain(t) for t, _ in cases]


def test_text_helpers(spark):
    assert ask(spark, "t string", [("Mayor's 27 new a1 of 2024 x",)], F.array_sort(text.headline_tokens(F.col("t"))), text.number_tokens(text.headline_tokens(F.col("t"))))[0] == (["2024", "27", "mayor's"], ["27"])
    assert ask(spark, "t string", [("Latest Arrest Reports: gas",)], text.column_key(F.col("t"))) == ["latest arrest report gas"]
    assert ask(spark, "t string", [("<p>a &amp; <b>b</b></p>\n&lt;i&gt;c",), (None,)], text.strip_html("t")) == ["a & b c", ""]
    assert ask(spark, "a string, b string", [(" x ", " "), (" ", None)], text.join_parts(F.col("a"), F.col("b"))) == ["x", None]
    assert ask(spark, "t string", [("u?api_key=abc&x=1 my-secret-1 a%2Fb%2Fc%2Fdef",)], text.redact(F.col("t"), ["my-secret-1", "a/b/c/def", "short"])) == ["u?api_key=[REDACTED]&x=1 [REDACTED] [REDACTED]"]
    assert ask(spark, "t string", [("Book ai",), ("aim",)], text.keyword_keys(F.col("t"), {"tech": [" ai "], "b": ["book"]})) == [["tech", "b"], []]
    assert ask(spark, "t string", [("--A b!--",), ("!",)], text.slug(F.col("t"))) == ["a-b", "event"]


def test_times(spark):
    cases = [("2024-01-02", 1704153600), ("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02 03:04:05.5+02:00", 1704157445), ("x", None), (None, None), ("2024-13-01", None)]
    assert ask(spark, "t string, want long", cases, F.unix_seconds(timeutil.parse_iso(F.col("t")))) == [c[1] for c in cases]
    assert ask(spark, "t string", [("2024-07-01T12:00:00",)], F.date_format(timeutil.parse_iso(F.col("t"), "America/New_York"), "HH:mm")) == ["16:00"]
    assert ask(spark, "t string", [("1.5",), ("NaN",), ("x",)], timeutil.to_float(F.col("t"))) == [1.5, None, None]
    years = [(1, 5, dt.date(2027, 1, 5)), (12, 30, dt.date(2026, 12, 30)), (2, 29, None), (8, 1, dt.date(2026, 8, 1))]
    assert ask(spark, "m int, d int, want date", years, timeutil.resolve_year(F.col("m"), F.col("d"), F.lit("2026-07-20").cast("date"))) == [y[2] for y in years]
    spans = [("July 22 | 9:00 AM - 5 p.m.", 1784725200, 28800), ("Dec 31 | 10 PM – 1 AM", 1798772400, 10800), ("July 19 | 9 AM - 10 AM", None, None), ("Foo 3 | 1 AM - 2 AM", None, None), ("July 22 | 25 AM - 3 PM", None, None)]
    o = timeutil.occurrence(F.col("t"), F.lit("2026-07-20 12:00:00").cast("timestamp"))
    assert ask(spark, "t string, a long, b long", spans, F.unix_seconds(o["start"]), F.unix_seconds(o["end"]) - F.unix_seconds(o["start"])) == [s[1:] for s in spans]
    assert ask(spark, "h string, z string", [("22:00", "est"), ("7", "XX"), ("25", "EST")], timeutil.observed_at(F.lit("2026-07-01"), F.col("h"), F.col("z"))) == ["2026-07-01T22:00:00-05:00", "2026-07-01T07:00:00", None]


def test_classify(spark):
    cases = [("City council vote", "", ["Local", "Commentary"], "opinion"), ("x", "", ["Top Stories"], "news"), ("Playoff win", "mayor", ["Featured"], "sports"), ("x", "y", None, "s0")]
    got = ask(spark, "t string, s string, tags array<string>, want string", cases, stories.classify(F.col("t"), F.col("s"), F.col("tags"), F.lit("s0")))
    assert got == [c[3] for c in cases]


def test_weather(spark):
    values = [(0.0, 1), (50.0, 1), (50.5, 2), (100.0, 2), (150.1, 4), (300.0, 5), (301.0, 6), (None, None)]
    assert ask(spark, "v double, want int", values, weather.aqi_category(F.col("v"))) == [v[1] for v in values]
    assert ask(spark, "d double", [(0.0,), (11.25,), (33.75,), (359.0,), (None,)], weather.compass(F.col("d"))) == ["N", "N", "NE", "N", None]
    df = spark.createDataFrame([(22.5, 10.0), (None, 1.0)], "temp_c double, wind_kmh double").withColumns({"wind_degrees": F.lit(90.0), "humidity": F.lit(50.5)})
    assert [tuple(r) for r in weather.conditions(df).collect()] == [(round(22.5 * 9 / 5 + 32), 6, "E", 50)]
    assert ask(spark, "p string", [('{"WebServiceError":[{"Message":"m"},{"x":1}]}',), ("[1]",), ("{}",)], weather.error_messages(F.col("p"))) == [["m"], [], []]


def test_lookup_keys(spark):
    cases = [("Hall, 1 Main, Town, TN, 37402", ["Hall, 1 Main, Town, TN, 37402", "1 Main, Town, TN, 37402"]), ("a,b,c,d", ["a,b,c,d", "b, c, d"]), ("x", ["x"]), ("V, s, c, ST, z, US", ["V, s, c, ST, z, US", "s, c, ST, z, US", "c, ST, z, US"])]
    assert ask(spark, "a string, want array<string>", cases, places.lookup_keys(F.col("a"))) == [c[1] for c in cases]


def test_clean_image(spark):
    cases = [("https://x.org/a/Generic-Car.jpg", None), ("https://x.org/stock/a.jpg?default", "https://x.org/stock/a.jpg?default"), (" ", None), (None, None), ("img/placeholder.png", None)]
    assert ask(spark, "u string, want string", cases, text.clean_image(F.col("u"))) == [c[1] for c in cases]
    assert math.isclose(listings._miles((35.0, -85.0), (35.0, -85.0)), 0)


def test_strip_html_against_a_parser(spark):
    """Pieces of markup in random order, against the standard parser's text nodes."""
    import html
    import random
    from html.parser import HTMLParser

    class Nodes(HTMLParser):
        found: list

        def handle_data(self, data):
            self.found.append(data)

    def plain(value):
        n = Nodes()
        n.found = []
        n.feed(html.unescape(value))
        n.close()
        return " ".join(" ".join(n.found).split())

    pieces = ["word", "two words", "<p>", "</p>", "<b class='x>y'>", "</b>", "<br/>", "<!-- a > b -->", "<!DOCTYPE html>", "<script>if (a<b) t='</p>';</script>", "<style>p{}</style>", "&amp;", "&lt;i&gt;x&lt;/i&gt;", "&#233;", "&nbsp;", "a < b", "3<4 ", '<a href="u?a=1&b=2">', "</a>", "\n\t"]
    rng = random.Random(4)
    cases = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) + " end",) for _ in range(400)] + [("",)]
    assert ask(spark, "h string", cases, text.strip_html(F.col("h"))) == [plain(c[0]) for c in cases]
    assert ask(spark, "h string", [(None,)], text.strip_html(F.col("h"))) == [""]
