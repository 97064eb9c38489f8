import json
from datetime import datetime

from pyspark.sql import functions as F

from postsieve.schemas import RAW_POSTING, SOURCES
from postsieve.sources import payloads, registry


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content)
    return str(folder)


def test_board_json(spark, tmp_path):
    jobs = [
        {"id": 77, "title": "Lock Smith", "absolute_url": "https://b.example/77", "location": {"name": "Bergen"},
         "content": "We open doors", "updated_at": "2024-02-03T00:00:00Z"},
        {"id": "x", "title": "Cook", "location": "Oslo"},
        {"id": 5},
    ]
    write(tmp_path / "slug=blue-3d-whale", "a.json", json.dumps({"jobs": jobs}, indent=1))
    rows = payloads.read_board_json(spark, str(tmp_path)).orderBy("external_id")
    assert rows.schema.simpleString() == RAW_POSTING.simpleString()
    numbered, third, named = (rows.collect()[i] for i in (1, 0, 2))
    assert (third.external_id, third.title, third.location, third.raw_text) == ("gh_5", "", "", "  ")
    assert (numbered.external_id, numbered.company, numbered.location) == ("gh_77", "Blue 3D Whale", "Bergen")
    assert numbered.raw_text == "Lock Smith Bergen We open doors" and numbered.source_tier == 1
    assert (named.external_id, named.location, named.updated_at) == ("gh_x", "Oslo", None)
    assert payloads.read_board_json(spark, str(tmp_path / "slug=blue-3d-whale"), "other").first().company == "Other"


def test_postings_json(spark, tmp_path):
    postings = [
        {"id": "q-1", "text": "Key Maker", "hostedUrl": "https://l.example/q-1", "categories": {"location": "Rome"},
         "descriptionPlain": "Makes keys"},
        {"id": "q-2", "text": "Guard"},
    ]
    path = write(tmp_path, "a.json", json.dumps(postings))
    first, second = payloads.read_postings_json(spark, path, "net-co").orderBy("external_id").collect()
    assert (first.external_id, first.title, first.company, first.location) == ("lv_q-1", "Key Maker", "Net Co", "Rome")
    assert first.raw_text == "Key Maker Rome Makes keys" and first.source_name == "lever"
    assert (second.location, second.url, second.raw_text) == ("", "", "Guard  ")


def test_feed(spark, tmp_path):
    xml = """<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
    <title>Feed</title><item><title>Rust Dev at Night at Owl Inc</title><link>http://o.example/1</link>
    <description>Short</description><content:encoded>Long text</content:encoded></item>
    <item><title>Cook</title><link>http://o.example/2</link></item></channel></rss>"""
    path = write(tmp_path, "f.xml", xml)
    first, second = payloads.read_feed_xml(spark, path, "owl_feed").orderBy("url").collect()
    assert (first.title, first.company, first.source_name) == ("Rust Dev at Night", "Owl Inc", "owl_feed")
    assert first.raw_text == "Rust Dev at Night Owl Inc  Short Long text" and first.external_id.startswith("rss_")
    assert (second.title, second.company) == ("Cook", "")


def test_sitemap(spark, tmp_path):
    urls = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
    <url><loc>http://s.example/1</loc></url><url><loc></loc></url><url><lastmod>x</lastmod></url></urlset>"""
    index = """<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
    <sitemap><loc>http://s.example/more.xml</loc></sitemap></sitemapindex>"""
    write(tmp_path, "a.xml", urls)
    path = write(tmp_path, "b.xml", index)
    rows = payloads.read_sitemap_xml(spark, path, "acme").collect()
    assert sorted(r.url for r in rows) == ["http://s.example/1", "http://s.example/more.xml"]
    assert {(r.title, r.company, r.source_tier) for r in rows} == {("", "acme", 2)}


def test_mail(spark):
    link = '<a href="https://www.linkedin.com/jobs/view/{}">x</a>'
    body = "".join(link.format(i) for i in range(12)) + "<h3 class='t'> One </h3><h3>Two</h3><h4>Co</h4>"
    mails = spark.createDataFrame([(body,), ("",), (None,)], "html string")
    rows = payloads.extract_mail_postings(mails).collect()
    assert [(r.title, r.company) for r in rows[:3]] == [("One", "Co"), ("Two", ""), ("", "")]
    assert len(rows) == 12 and rows[1].raw_text == f"Two  {body}"


def test_cards(spark):
    card = "<li class='row job'><h2>T{0}</h2><i class=\"place\">P&amp;{0}</i></li>"
    html = "".join(card.format(i) for i in range(40)) + "<li class='job'><i class='place'>no title</i></li><li>other</li>"
    pages = spark.createDataFrame([("http://p", html), ("http://q", "<li class='job'><i class='place'>x</i></li>")], "url string, html string")
    rows = payloads.extract_page_cards(pages, "li.job", title="h2", location="i.place").collect()
    assert len(rows) == 40 and {r.url for r in rows} == {"http://p"}
    assert (rows[3].title, rows[3].company, rows[3].raw_text) == ("T3", "", "T3  P&amp;3")


def test_nested_cards(spark):
    html = """<div class="list"><div class="card job-card"><div class='t'><div>Deep</div> Cook</div><div><b class=co>Owl</b></div>
    </div><section class="job-card"><div class="t">Guard</div><b class="co"></b></section><div class="job-cards">no</div></div>"""
    pages = spark.createDataFrame([("http://p", html)], "url string, html string")
    rows = payloads.extract_page_cards(pages, ".job-card", title=".t", company="b.co").collect()
    assert [(r.title, r.company) for r in rows] == [("Deep Cook", "Owl"), ("Guard", "")]
    plain = payloads.extract_page_cards(pages, "div.list", title="p").collect()
    assert plain == []
    big = "<ul>" + "".join(f"<li><p>t{i}<p>{'x < y ' * 20000}</li>" for i in range(3)) + "</ul>"
    pages = spark.createDataFrame([("u", big)], "url string, html string")
    assert [r.title for r in payloads.extract_page_cards(pages, "li", title="p").collect()] == ["t0", "t1", "t2"]


def test_messages(spark):
    rows = [("sec_jobs_daily", 9, "Blue Whale hires a guard at Harbour, pays $90k"), ("sec_jobs_daily", 10, "hi")]
    raw = payloads.messages_to_raw(spark.createDataFrame(rows, "channel string, msg_id long, text string")).collect()
    assert len(raw) == 1
    assert (raw[0].external_id, raw[0].url) == ("tg_9_sec_jobs_d", "https://t.me/sec_jobs_daily/9")
    assert (raw[0].company, raw[0].source_name) == ("Harbour, pays", "telegram_sec_jobs_daily")


def test_registry(spark):
    config = {"greenhouse": ["a", "b"], "lever": ["b"], "feeds": ["f"], "other": ["z"]}
    listed = registry.load_registry(spark, config)
    sources = spark.createDataFrame([("a", 3)], "name string, tier int")
    sources = sources.select(
        *[(F.col(f.name) if f.name in ("name", "tier") else F.lit(None).cast(f.dataType)).alias(f.name) for f in SOURCES]
    )
    rows = {r.name: (r.tier, r.url) for r in registry.seed_sources(sources, listed).collect()}
    assert rows == {"a": (3, None), "b": (1, "https://api.lever.co/v0/postings/b"), "f": (2, None)}


def test_watchlist(spark, tmp_path):
    path = write(tmp_path, "w.yaml", '# names\n- "Blue Whale"\n- Okta  # note\n- 42\n- true\n-  \'Mandi ant \'\n')
    names = {r[0] for r in registry.load_watchlist(spark, path + "/w.yaml").collect()}
    assert names == {"blue whale", "okta", "mandi ant"}
    assert registry.load_watchlist(spark, str(tmp_path / "none.yaml")).count() == 0
    rows = spark.createDataFrame([(" OKTA",), ("Okta Inc",), (None,)], "company string")
    flags = registry.flag_watchlist(rows, registry.load_watchlist(spark, path + "/w.yaml"))
    assert {r.company: r.on_watchlist for r in flags.collect()} == {" OKTA": True, "Okta Inc": False, None: False}


def test_skip_unchanged(spark):
    now = datetime(2024, 5, 1)
    fetched = [("feed", "u1", "e1", "d1"), ("feed", "u2", "e2", "d1"), ("feed", "u3", None, "d1"), ("sitemap", "u4", "e", ""), ("sitemap", "u5", None, "d5")]
    frame = spark.createDataFrame(fetched, "kind string, url string, etag string, last_modified string")
    stored = registry.manifest_rows(frame, now)
    assert registry.skip_unchanged(frame, stored, datetime(2024, 5, 1, 23)).select("url").first()[0] == "u4"
    assert registry.skip_unchanged(frame, stored, datetime(2024, 5, 2)).count() == 5
    changed = frame.replace({"e1": "new", "d5": "d6"})
    assert {r.url for r in registry.skip_unchanged(changed, stored, now).collect()} == {"u1", "u4", "u5"}
