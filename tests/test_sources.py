import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import places, weather
from tidemark.sources import calendars, live, news, stations

AT = dt.datetime(2024, 1, 1)


def polls(spark, *payloads):
    return spark.createDataFrame([("s", AT, p if isinstance(p, str) else json.dumps(p)) for p in payloads], "source_key string, poll_at timestamp, payload string")


def by_id(df):
    return {r.external_id: r for r in df.collect()}


def test_emergency_calls(spark):
    items = [
        {"master_incident_id": 7, "type": "MVC", "agency_type": "Law ", "latitude": 35.1, "longitude": "-85.2", "status": "Queued", "statusdatetime": "1900-01-01T00:00:00Z", "creation": "2024-01-01T10:00:00Z"},
        {"master_incident_id": 8, "type": "PERBURN"}, {"type": "MVC"}, {"master_incident_id": 9, "type": "", "type_description": "Fire alarm", "agency_type": "Fire", "latitude": "x"}, {"master_incident_id": 7, "type": "MVC2", "agency_type": None},
    ]
    got = by_id(live.emergency_calls(polls(spark, items)))
    assert set(got) == {"7", "9"} and got["7"].label == "MVC2" and got["7"].category == "other"
    assert got["9"].label == "Fire alarm" and got["9"].category == "fire" and got["9"].lat is None
    one = by_id(live.emergency_calls(polls(spark, items[:1])))["7"]
    assert one.category == "police" and one.lon == -85.2 and one.source_time == dt.datetime(2024, 1, 1, 10)


def test_outages_and_roads_and_areas(spark):
    got = by_id(live.outages(polls(spark, {"energy": [{"latitude": 35.0, "longitude": -85.3097655, "customer_quantity": 3, "incident_status": "A"}, {"latitude": None, "longitude": 1}, {"latitude": 35.0, "longitude": -85.3097655, "incident_status": "B"}], "fiber": []})))
    assert list(got) == [f"energy:{35.0:.6f},{-85.3097655:.6f}"]
    r = next(iter(got.values()))
    assert r.status == "B" and r.label == "Energy Outage" and '"service":"energy"' in r.properties
    roads = [{"id": 1, "eventTypeName": "Operations", "locations": [{"midPoint": {"lat": 1.0, "lng": 2.0}}], "revisedDate": "2024-01-01T00:00:00-05:00"}, {"id": 1, "eventTypeName": "Incident", "isSevere": True, "locations": [{"coordinates": [{"lat": 3.0, "lng": 4.0}]}]}, {"id": 2, "eventTypeName": "Zoo", "eventSubTypeDescription": "Bear"}, {"id": 2, "eventTypeName": "Incident"}, {}]
    got = by_id(live.road_events(polls(spark, roads)))
    assert got["1"].category == "severe" and (got["1"].lat, got["1"].lon) == (3.0, 4.0) and got["2"].category == "other" and got["2"].label == "Bear" and got["2"].lat is None
    assert by_id(live.road_events(polls(spark, roads[:1])))["1"].source_time == dt.datetime(2024, 1, 1, 5)
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}
    layers = [{"category": "emergency", "features": [{"properties": {"EventID": "a", "EventType": "", "EventStatus": "Active"}, "geometry": shape}, {"properties": {"EventID": "b"}, "geometry": None}]}, {"category": "general", "features": [{"properties": {"EventID": "a", "EventType": "Planned"}, "geometry": shape}]}]
    got = by_id(live.advisories(polls(spark, layers)))
    assert set(got) == {"a"} and got["a"].category == "general" and got["a"].status == "Planned" and json.loads(got["a"].geometry) == shape and '"advisory_type":"general"' in got["a"].properties


def test_one_bad_payload_costs_only_its_poll(spark):
    rows, status = live.normalized({"calls": polls(spark, "{oops", [{"master_incident_id": 1}]), "roads": polls(spark, [{"id": 5}])})
    assert sorted(r.external_id for r in rows.collect()) == ["1", "5"]
    assert sorted((r.ok, r.error) for r in status.collect()) == [(False, "payload is no JSON"), (True, None), (True, None)]


def test_paged_calendar(spark):
    page = {"events": [{"id": 5, "title": "Jazz &amp; Tea", "description": "<p>a</p><p>b</p>", "utc_start_date": "2024-01-01 10:00:00", "venue": {"venue": "Hall", "address": " 1 St", "city": "", "zip": "37402", "geo_lat": 35.1, "geo_lng": False}, "image": False, "categories": [{"name": "Music"}, {"name": "music"}], "url": "u"}, {"title": "none"}, {"title": "", "utc_start_date": "2024-01-01 10:00:00", "venue": [], "image": {"url": "x/default.png"}}]}
    raw = spark.createDataFrame([("cal", json.dumps(page))], "source_name string, payload string")
    got = sorted(calendars.paged_calendar(raw).collect(), key=lambda r: r.seq)
    assert [r.title for r in got] == ["Jazz & Tea", "Untitled event"] and got[0].address == "1 St, 37402" and list(got[0].tags) == ["music"] and got[0].description == "a b"
    assert (got[0].latitude, got[0].longitude, got[0].image_url, got[1].image_url, got[1].venue_name) == (35.1, None, None, None, None)


def test_aggregator_and_search(spark):
    value = [{"Name": "Fun Run!", "PId": 9, "StartUTC": "2024-01-01T10:00:00Z", "DateStart": "x", "Tags": [2, 3, 1], "MediumImg": "a/generic.png", "Images": [{"url": "b.png"}], "Links": [{"url": ""}, {"url": "l"}], "Id": "i", "CityState": "Town, TN"}, {"Name": "no", "DateStart": "2024-01-01T10:00:00Z"}, {"StartUTC": "2024-01-01T10:00:00Z", "PId": 3}]
    raw = spark.createDataFrame([("agg", "https://x/#/", json.dumps({"Value": value}))], "source_name string, base_url string, payload string")
    rolled = spark.createDataFrame([(1, "Music"), (2, "Sports"), (3, "music")], "id int, name string")
    got = sorted(calendars.aggregator(raw, rolled).collect(), key=lambda r: r.seq)
    assert [r.source_url for r in got] == ["l", "https://x/#/details/event/3"] and list(got[0].tags) == ["sports", "music"] and got[0].image_url == "b.png" and got[0].address == "Town, TN"
    edges = [{"node": {"result": {"id": "1", "title": "T", "dateTime": "2024-01-01T10:00:00-05:00", "group": {"name": "G"}, "description": "", "venue": {"name": "V"}}}}, {"node": {"result": {"title": "x"}}}]
    raw = spark.createDataFrame([("m", "f", json.dumps({"data": {"keywordSearch": {"edges": edges}}}))], "source_name string, fallback_url string, payload string")
    (r,) = calendars.graph_search(raw).collect()
    assert (r.description, r.address, r.source_url, r.start_time) == ("G", "V", "f", dt.datetime(2024, 1, 1, 15))


def test_ical(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long na\r\n me\\, ok\r\nDESCRIPTION:a\\;b\\\\nc\\nd\r\nDTSTART;TZID=America/New_York:20240701T090000\r\nDTEND:20240701T150000Z\r\nATTACH;FMTTYPE=image/png:https://x/a\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20240102\r\nURL:https://u\r\nATTACH:https://x/Generic-1.jpg\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:undated\r\nEND:VEVENT\r\nEND:VCALENDAR"
    raw = spark.createDataFrame([("i", "feed", text)], "source_name string, feed_url string, payload string")
    a, b = sorted(calendars.ical(raw).collect(), key=lambda r: r.seq)
    assert (a.title, a.start_time, a.end_time, a.image_url, a.source_url, a.source_event_id) == ("Long name, ok", dt.datetime(2024, 7, 1, 13), dt.datetime(2024, 7, 1, 15), "https://x/a", "feed", "1")
    assert a.description == "a;b\\nc\nd"
    assert (b.title, b.start_time, b.image_url, b.source_url) == ("Untitled event", dt.datetime(2024, 1, 2), None, "https://u")


def test_ical_past_a_million_events(spark):
    """The last event of a large file is read; those before it have no start."""
    last = "BEGIN:VEVENT\nUID:z\nSUMMARY:Last\nDTSTART:20240601T180000Z\nEND:VEVENT\n"
    raw = spark.range(1).select(F.lit("s").alias("source_name"), F.lit("u").alias("feed_url"), F.concat(F.repeat(F.lit("BEGIN:VEVENT\n"), 1_000_000), F.lit(last)).alias("payload"))
    assert [r.title for r in calendars.ical(raw).select("title").collect()] == ["Last"]


def test_structured_pages(spark):
    node = {"@type": "Event", "name": "Car &amp; Tea", "startDate": "2024-07-01T09:00", "location": {"name": "Lot", "address": {"streetAddress": "1 St", "postalCode": "37402"}}, "image": [{"url": "a/stock.png"}, "b.png"], "url": "https://x.org/e/show/?a"}
    html = f'<script type="application/ld+json">{json.dumps({"@graph": [node, {"@type": "Org"}]})}</script><script type="application/ld+json">oops</script><script type="application/ld+json">{json.dumps([{"@type": "Event", "name": "undated"}])}</script>'
    (r,) = calendars.structured_pages(spark.createDataFrame([("c", "p", html)], "source_name string, page_url string, html string")).collect()
    assert (r.title, r.start_time, r.address, r.image_url, r.source_event_id) == ("Car & Tea", dt.datetime(2024, 7, 1, 13), "1 St, 37402", "b.png", "e/show")


def test_listing_and_details(spark):
    listing = '<a class="col third fundraiser" href="/events/moon"><h3>Moon <b>Walk</b></h3><img src="m.png"></a><a class="col third fundraiser" href="/events/moon"><h3>Again</h3></a><a class="col third fundraiser" href="/x"></a>'
    cards = calendars.listing_cards(spark.createDataFrame([("https://zoo.org/list", listing)], "page_url string, html string"))
    assert [tuple(r) for r in cards.collect()] == [("https://zoo.org/events/moon", "Moon Walk", "m.png")]
    page = '<div class="intro"><h1>Moonwalk</h1></div><div class="event-logo"><h3>Under <b>stars</b></h3><div><p>not this</p></div><p>With\n guides.</p><h5><span>July 22 | 9:00 PM - 1 AM</span><span>July 1 | 9 AM - 10 AM</span></h5></div>'
    details = spark.createDataFrame([("https://zoo.org/events/moon", page)], "url string, html string")
    (r,) = calendars.occurrences(cards, details, F.lit("2026-07-20 12:00:00").cast("timestamp"), "Zoo", ("Zoo", "1 St", 35.0, -85.0)).collect()
    assert r.description == "Under stars With guides."
    bare = page.replace("<h3>Under <b>stars</b></h3>", "").replace("<p>With\n guides.</p>", "") + '<div id="prices"><section class="two-thirds"><p>One.</p><ul><li>x</li></ul><p>Two.</p></section><section><p>no</p></section></div>'
    (o,) = calendars.occurrences(cards, spark.createDataFrame([("https://zoo.org/events/moon", bare)], "url string, html string"), F.lit("2026-07-20 12:00:00").cast("timestamp"), "Zoo", ("Zoo", "1 St", 35.0, -85.0)).collect()
    assert o.description == "One. Two."
    assert (r.title, r.source_event_id, r.start_time, r.end_time) == ("Moonwalk", "moon#2026-07-22", dt.datetime(2026, 7, 23, 1), dt.datetime(2026, 7, 23, 5))
    pages = spark.createDataFrame([("a", 1, 0), ("a", 0, 5), ("b", 1, 1)], "id string, page int, pos int")
    assert sorted((x.id, x.page) for x in calendars.merge_pages(pages, "id", "page", "pos").collect()) == [("a", 0), ("b", 1)]


def test_news_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:content="c"><channel><item><title>One &amp;lt;b&amp;gt;x&amp;lt;/b&amp;gt;</title><link>https://a/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>short</description><content:encoded>&lt;p&gt;full &lt;img src="i.png"&gt; body&lt;/p&gt;</content:encoded><category>Sports</category><category>Local</category></item>'
        '<item><title>Two</title><link>https://a/2</link><enclosure url="e.jpg" type="image/jpeg"/></item><item><title>no link</title></item></channel></rss>'
    )
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    a, b = sorted(news.feed_articles(news.read_feed(spark, str(tmp_path)), now).collect(), key=lambda r: r.url)
    assert (a.guid, a.title, a.summary, a.image_url, list(a.tags), a.published) == ("g1", "One x", "full body", "i.png", ["Sports", "Local"], dt.datetime(2024, 1, 1, 10))
    assert (b.guid, b.image_url, b.published, b.summary) == ("https://a/2", "e.jpg", dt.datetime(2024, 1, 2), "")


def test_atom_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><title type="html">One &amp;lt;i&amp;gt;x&amp;lt;/i&amp;gt;</title><link rel="self" href="https://a/self"/><link href="https://a/1"/><link rel="enclosure" type="image/png" href="e.png"/><id>tag:1</id><published>2024-01-01T10:00:00Z</published><updated>2024-01-02T10:00:00Z</updated>'
        '<summary>short</summary><content type="html">&lt;p&gt;full body&lt;/p&gt;</content><category term="Sports"/><category term=""/></entry><entry><title>Two</title><link href="https://a/2" rel="alternate"/><updated>2024-01-03T00:00:00+01:00</updated><summary>only this</summary></entry><entry><title>no link</title></entry></feed>'
    )
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    a, b = sorted(news.feed_articles(news.read_feeds(spark, str(tmp_path)), now).collect(), key=lambda r: r.url)
    assert (a.guid, a.title, a.url, a.summary, a.image_url, list(a.tags), a.published) == ("tag:1", "One x", "https://a/1", "full body", "e.png", ["Sports"], dt.datetime(2024, 1, 1, 10))
    assert (b.guid, b.url, b.summary, b.published) == ("https://a/2", "https://a/2", "only this", dt.datetime(2024, 1, 2, 23))


def test_news_listing(spark):
    html = '<div class="views-row"><div class="views-field-title"><h3><a href=" /n/1">First <i>item</i></a></h3></div><div class="views-field-body"><div class="field-content"><p>Body.</p></div></div><div class="views-field-created"><time datetime="2024-01-01T10:00:00-04:00">x</time></div></div><div class="views-row"><h3>no link</h3></div><div class="views-row"><div class="views-field-title"><h3><a href="b">Second</a></h3></div></div>'
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    a, b = sorted(news.listing_articles(spark.createDataFrame([("https://c.gov/news/list", html)], "page_url string, html string"), now).collect(), key=lambda r: r.url, reverse=True)
    assert sorted([a.url, b.url]) == ["https://c.gov/n/1", "https://c.gov/news/b"]
    first = a if a.url.endswith("/1") else b
    assert (first.title, first.summary, first.published) == ("First item", "Body.", dt.datetime(2024, 1, 1, 14))


def test_stations_and_weather(spark):
    raw = lambda rows, schema: spark.createDataFrame(rows, schema)
    o = stations.observations(raw([("p", f"s{k}", k, json.dumps({"properties": {"temperature": {"value": t}, "windSpeed": {"value": 10}, "textDescription": "ok"}})) for k, t in ((1, None), (2, 20.0), (4, 1.0))], "place string, station string, rank int, payload string"))
    best = weather.usable_station(o).collect()
    assert [(r.station, r.temp_c) for r in best] == [("s2", 20.0)]
    assert [tuple(r) for r in stations.station_ids(raw([("p", json.dumps({"features": [{"id": "a"}, {"id": "b"}, {"id": "c"}]}))], "place string, payload string"), 2).collect()] == [("p", 1, "a"), ("p", 2, "b")]
    f = stations.forecasts(raw([("p", json.dumps({"properties": {"periods": [{"name": "Today", "temperature": 70}, {"name": "Tonight"}, {"name": "x"}]}}))], "place string, payload string"))
    assert [r.period.name for r in weather.first_periods(f).collect()] == ["Today", "Tonight"]
    q = stations.air_quality(raw([("z", json.dumps([{"parameterName": "OZONE", "nowcastAQI": 50.5, "dateObserved": "2026-07-01", "hourObserved": "22:00", "localTimeZone": "EST"}, {"parameterName": "PM2.5", "nowcastAQI": -999}, {"parameterName": "PM10", "nowcastAQI": 50.5}])), ("e", '{"WebServiceError":[]}')], "area string, payload string"))
    assert [tuple(r) for r in weather.overall_aqi(q, ["area"]).collect()] == [("z", 50.5, "OZONE", 2)]
    t = lambda m: AT + dt.timedelta(minutes=m)
    r = raw([("a", t(0), 40.0, t(0)), ("a", t(60), None, None), ("a", t(130), None, None)], "area string, at timestamp, aqi double, observed timestamp")
    assert [x.aqi for x in weather.carry_forward(r, "area", "at", "aqi", "observed").orderBy("at").collect()] == [40.0, 40.0, None]
    assert weather.changed_payloads(r, "area", "at", ["aqi"]).count() == 2


def test_places(spark):
    none = None
    cache = spark.createDataFrame([("V, 1 St, T, TN", none, none, AT), ("x", none, none, AT + dt.timedelta(hours=30)), ("ok", 1.0, 2.0, AT)], "address string, latitude double, longitude double, last_attempted_at timestamp")
    gaz = spark.createDataFrame([("1 St, T, TN", 35.0, -85.0)], "query string, latitude double, longitude double")
    events = spark.createDataFrame([(1, "V, 1 St, T, TN", none, none), (2, "V, 1 St, T, TN", 9.0, 9.0), (3, "new", none, none), (4, "ok", none, none)], "id int, address string, latitude double, longitude double")
    now = F.lit(AT + dt.timedelta(hours=48))
    c, e, tried = places.retry(cache, events, gaz, now, 24, 10)
    assert [r.address for r in tried.collect()] == ["V, 1 St, T, TN"] and c.count() == 3 and c.filter("latitude IS NULL").count() == 1
    assert {r.id: r.latitude for r in e.collect()} == {1: 35.0, 2: 9.0, 3: None, 4: None}
    assert places.retry(cache, events, gaz, now, 0, 10)[2].count() == 0
    assert [r.address for r in places.cache_misses(events, cache).collect()] == ["new"]
    assert {r.id: r.latitude for r in places.located(events, cache).collect()} == {1: None, 2: 9.0, 3: None, 4: 1.0}
