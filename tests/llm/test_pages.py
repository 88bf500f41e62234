"""Operators over pages: archives, extraction and url filters."""

import hashlib
import random

import pytest

from tessera.llm import html_extraction, url_filters, warc
from tessera.llm.queries import LISTED_URLS, URL_RULES

from .helpers import prose


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, note int, digest string")


def test_archive_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big, other = prose(rng, 400), prose(rng, 500) + "é"
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/9", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "a b\nc\u2028%20", other), (7, "a b\nc\u2028%20", other), (None, "n", other)]
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, rows), folder, shard_bytes=5000, roll_bytes=600)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 3
    for r in manifest.collect():
        raw = (tmp_path / "w" / r["file"]).read_bytes()
        assert len(raw) == r["bytes"] and hashlib.sha256(raw).hexdigest() == r["sha256"]
    assert (tmp_path / "w" / "_SUCCESS").exists() and not (tmp_path / "w" / "_temporary").exists()
    back = warc.read(spark, folder, payload=True).collect()
    assert len(back) == len(rows)
    kinds = {}
    for r in back:
        url, payload = next((u, (h or "").encode()) for p, u, h in rows if p == r["page_id"])
        assert r["url"] == url
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert (bytes(r["payload"]) == payload) if r["record_type"] == "response" else r["payload"] is None
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert kinds[9] == [("response", None)] and kinds[1] == kinds[2] == [("revisit", 9)]
    assert kinds[3] == kinds[4] == kinds[5] == kinds[6] == [("response", None)]
    assert sorted(kinds[7]) == [("response", None), ("revisit", 7)] and kinds[None] == [("revisit", 7)]
    again = warc.write(pages(spark, rows).repartition(4), f"file://{tmp_path}/v", shard_bytes=5000, roll_bytes=600)
    assert sorted(r["sha256"] for r in again.collect()) == sorted(r["sha256"] for r in manifest.collect())


def test_archives_of_equal_tables_are_equal(spark, tmp_path):
    """However the rows are dealt; ids in clusters far apart, and rows far beyond what a sample would hold."""
    table = spark.range(50_000).selectExpr("CASE WHEN id < 30000 THEN id ELSE id * 1000003 - 9000000000000000000 END AS page_id", "concat('http://a/', id) AS url", "repeat(concat('w', id % 977, ' '), cast(id % 60 as int)) AS html")
    one = warc.write(table.repartition(7), f"file://{tmp_path}/one", shard_bytes=2 << 20, roll_bytes=1 << 17)
    two = warc.write(table.orderBy("html").coalesce(3), f"file://{tmp_path}/two", shard_bytes=2 << 20, roll_bytes=1 << 17)
    names = ["shard", "number", "first_page", "file", "records", "bytes", "sha256"]
    a, b = (m.select(*names).orderBy("file").collect() for m in (one, two))
    assert a == b and a[-1]["shard"] > 10 and any(r["number"] for r in a) and sum(r["records"] for r in a) == 50_000
    sizes = {}
    for r in a:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["records"]
    assert max(sizes.values()) < 50_000 / 5
    assert warc.read(spark, f"file://{tmp_path}/two").count() == 50_000
    assert warc.shard_bounds(table.limit(0)) == []
    wide = spark.createDataFrame([(-(1 << 63), "x"), ((1 << 63) - 1, "y" * 9), (5, "z" * 9000), (6, "z" * 9000), (7, None), (None, "q")], "page_id long, html string")
    assert warc.shard_bounds(wide, 9000) == [6, 7]  # the least id of all has no block of its own


def test_empty_tables_give_no_archives(spark, tmp_path):
    assert warc.write(pages(spark, []), f"file://{tmp_path}/e").count() == 0
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_truncated_archive_is_an_error(tmp_path):
    import io

    member = warc._member(warc.record(1, 0, "u", b"x" * 50, None))
    assert len(list(warc.members(io.BytesIO(member * 3)))) == 3
    with pytest.raises(ValueError, match="within a member"):
        list(warc.members(io.BytesIO(member + member[:30])))
    fields, block = warc.parse(warc.record(None, 2, None, b"abc", "<urn:page:5:0>"))
    assert warc.page_of(fields["WARC-Record-ID"]) is None and warc.page_of(fields["WARC-Refers-To"]) == 5 and not block.endswith(b"abc")


PAGE = """<!DOCTYPE html><html><head><title>Head</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul>{menu}</ul></nav><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<{main}><h1>Title &amp; more</h1><p>First <b>bo</b>ld   text.<br>Next&nbsp;line<p>Second {body}</p><aside>Side</aside><!-- gone --><form><input>Name <button>Go</button></form><p>Last.</p></{main}>
<section class="comments"><p>Nice post, thank you very much indeed dear author</p></section><div class="sidebar"><a href="x">More</a></div><footer>&copy; 2024</footer></body></html>"""


def test_extraction_of_the_article_only(spark):
    rng = random.Random(2)
    menu = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(6))
    bodies = [prose(rng, n) for n in (1, 40, 400)]
    rows = [(i, f"u{i}", PAGE.format(menu=menu, body=b, main="article")) for i, b in enumerate(bodies)]
    rows += [(10, "m", PAGE.format(menu=menu, body=bodies[2], main="div")), (11, None, None), (12, "e", ""), (13, "t", "plain words only"), (14, "b", "<p>a<b <c & <!-- never ends"), (15, "s", "<script>x"), (16, "n", "<nav>only menu</nav>")]
    got = {r["page_id"]: r for r in html_extraction.extract_pages(pages(spark, rows)).collect()}
    for i, b in [*enumerate(bodies), (10, bodies[2])]:
        want = f"Title & more First bold text. Next line Second {b} Last."
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want), i
    assert [got[i]["text"] for i in (11, 12, 15, 16)] == [""] * 4 and got[13]["text"] == "plain words only" and got[14]["text"] == "a"
    assert html_extraction.extract_pages(pages(spark, [])).count() == 0


def test_article_with_lists_and_links_at_its_edges(spark):
    rng = random.Random(12)
    links = "".join(f'<div><ul><li><a href="/{i}">Entry {i}</a></li><li>Item {i}</li></ul><div><a href="/">more</a></div></div>' for i in range(8))
    page = "<html><body>{links}<{main}>{start}<p>{body}</p>{end}</{main}>{links}</body></html>"
    short, link = "<ul><li>One</li><li><a href='/1'>two</a></li></ul>", "<div><p><a href='/2'>See</a></p></div>"
    body = prose(rng, 60)
    rows = [(i, "u", page.format(links=links, main=("article", "main")[i % 2], start=a, end=b, body=body)) for i, (a, b) in enumerate([("", ""), (short, short), (link, link), (short + link, link + short)])]
    rows += [(100 + i, "u", page.format(links=links, main="article", start="", end="", body=prose(rng, 50))) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == [body, f"One two {body} One two", f"See {body} See", f"One two See {body} See One two"]


STORY = " ".join(f"word{i}" for i in range(40))
ODD_PAGES = [  # (page, text that has to be there, text that must not)
    ('<div id="wrapper" class="has-sidebar"><p>{}</p></div>', "", ""), ('<div class="content no-sidebar">{}</div>', "", ""), ('<div class="page-with-comments"><p>{}</p></div><footer>bye</footer>', "", "bye"),
    ('<div class="nav-open">{}</div>', "", ""), ('<article><h1>Top</h1><section id="discussion">{}</section></article>', "Top", ""), ('<main><div class="search-theory">{}</div></main>', "", ""),
    ('<body><form id="aspnetForm"><div><p>{}</p></div></form></body>', "", ""), ('<form id="aspnetForm"><h1>Top</h1><p>{}</p></form><footer>bye</footer>', "Top", "bye"),
    ("<article><p>a short teaser</p></article><div><p>{}</p></div>", "", ""), ('<p title="x>{}</p><p>and more</p>', "and more", "x>"), ('<body class="nav-open"><nav>menu</nav><p>{}</p>', "", "menu"),
    ('<article><p>{}</p><div class="post-comments"><p>first! first! first!</p></div><aside>side</aside><p>The end</p></article>', "The end", "first!"), ('<p>{}</p><div style="display: none">unseen</div>', "", "unseen"),
    ('<article><header class="entry-header"><h1>Top</h1></header><p>{}</p></article>', "Top", ""), ('<div class="post-header"><h1>Top title</h1></div><p>{}</p><div class="social">tweet it</div>', "Top title", ""), ('<div class="social-sciences"><p>{}</p></div>', "", ""),
    ('<div class="adSlot">buy</div><p>{}</p><div class="cookie-notice">we eat them</div>', "", "buy"), ("<p>{}</p><b></p><div>x</b> y</div", "", "div"),
]


@pytest.mark.parametrize("learned", [False, True])
def test_names_of_containers_do_not_drop_a_page(learned):
    from collections import Counter

    counts = Counter()
    for i in range(30 * learned):
        html_extraction._count(PAGE.format(menu='<li><a href="/">Entry</a></li>' * 5, body=prose(random.Random(i), 200), main="article"), counts)
    weights = html_extraction.Weights(dict(counts))
    for page, there, gone in ODD_PAGES:
        text = html_extraction.extract(page.format(STORY), weights)
        assert STORY in text and there in text and (not gone or gone not in text), (page, text)


def test_region_is_the_best_of_all():
    rng = random.Random(7)
    weights = html_extraction.Weights({})
    tags = ["<p>", "</p>", "<div class='ad'>", "</div>", "<div>", "<a href=x>", "</a>", "<li>", "<b>", "<nav>", "</nav>", "<article>", "</article>", "<br>", "one two", "w " * 9, "x"]
    for _ in range(300):
        values, _ = html_extraction.scores(html_extraction.parse("".join(rng.choice(tags) for _ in range(rng.randrange(1, 30)))), weights)
        a, b = html_extraction.best_region(values)
        best = max((sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1)), default=0.0)
        assert abs(sum(values[a:b]) - max(best, 0.0)) < 1e-9


@pytest.mark.parametrize("piece", ["<a ", "<b>x", "<!--x", "<!--x-->", "<b><div></b>", '<p a="', "<p a='\">\"", "<div class=c{}>a", "<script>", "</x", "<a b = ", "<article><i>", "&lt;<"])
def test_time_is_linear_in_the_page(piece):
    import time
    from collections import Counter

    page = "".join(piece.replace("{}", str(i)) for i in range((1 << 20) // len(piece)))
    start = time.process_time()
    html_extraction.extract(page, html_extraction.Weights({}))
    html_extraction._count("<main>" + page, Counter())
    assert time.process_time() - start < 15  # a second or two; hours if it went back and forth


def test_pages_without_marks_use_what_others_teach(spark):
    rng = random.Random(31)
    odd = '<div class="tagline">{}</div><div class="story"><h1>Head</h1><p>{}</p></div><div class="tagline">{}</div>'
    rows = [(i, "u", "<body>" + odd.replace('<div class="story">', "<article>").replace("</p></div>", "</p></article>").format(prose(rng, 30), prose(rng, 60), prose(rng, 30))) for i in range(40)]
    bodies = [prose(rng, 60) for _ in range(10)]
    rows += [(100 + i, "u", "<body>" + odd.format(prose(rng, 30), b, prose(rng, 30))) for i, b in enumerate(bodies)] + [(None, "n", "<p>no id</p>"), (3000, None, None), (3000, None, None)]
    got = html_extraction.extract_pages(pages(spark, rows)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[100 + i] for i in range(10)] == ["Head " + b for b in bodies] and text[None] == "no id" and sum(r["page_id"] == 3000 for r in got) == 2


URLS = [
    ("http://example.com/en/x", "example.com/en/", "block"), ("https://WWW.Example.com/en/", "www.example.com/en/", "allow"), ("http://a.www.example.com/en/q", "www.example.com/en/", "allow"),
    ("http://example.com", None, "allow"), ("http://example.com/", "com/", "allow"), ("http://x.net/es/1?u#v", "net/es/", "block"), ("http://x.net/est", None, "allow"), ("http://net/fr/", "net/fr/", "block"),
    ("ftp://notcom/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme/en/", None, "allow"), ("x://", None, "allow"), ("http://spam-farm.example.org/en/1", None, "block"),
    ("http://www.casino-win.example.org?x", None, "block"), ("http://not-spam-farm.example.org/", None, "allow"), ("http://b.org/a://c/d", None, "allow"), ("http://u@spam-farm.example.org:80/a/b", None, "block"),
]


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", broadcast)
    rows = [(i, u, "") for i, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "")]
    listed = spark.createDataFrame([(x,) for x in LISTED_URLS] + [(None,)], "canonical string")
    out = url_filters.filter_urls(pages(spark, rows), URL_RULES, listed).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["rule"], r["verdict"]) == URLS[r["page_id"]][1:], URLS[r["page_id"]]
    first = next(r for r in out if r["page_id"] == 1)
    assert (first["host"], first["path"]) == ("www.example.com", "/en/")
    assert all(r["verdict"] == "allow" for r in url_filters.filter_urls(pages(spark, rows[13:14]), URL_RULES, listed.limit(0)).collect())
    assert url_filters.filter_urls(pages(spark, []), URL_RULES, listed).count() == 0


def test_deep_listed_entries(spark):
    deep = "/".join(f"d{i}" for i in range(30))
    labels = ".".join(f"l{i}" for i in range(20))
    entries = [f"deep.org/{deep}/", f"{labels}.org/", f"file.org/{deep}/page", "flat.org/a/"]
    urls = [
        (f"http://deep.org/{deep}/x/y", "block"), (f"http://www.deep.org/{deep}/", "block"), (f"http://deep.org/{deep}", "allow"), (f"http://a.b.{labels}.org/q", "block"), (f"http://{labels}.org", "block"),
        (f"http://{labels[3:]}.org/", "allow"), (f"http://file.org/{deep}/page?x", "block"), (f"http://file.org/{deep}/other", "allow"), (f"http://flat.org/a/{deep}", "block"), ("http://x.flat.org/b/", "allow"),
    ]
    for listed in (entries, entries[3:], ["org/"]):  # a last label alone is no suffix
        out = url_filters.filter_urls(pages(spark, [(i, u, "") for i, (u, _) in enumerate(urls)]), (), spark.createDataFrame([(x,) for x in listed], "canonical string")).collect()
        for r in out:
            want = urls[r["page_id"]][1] if listed is entries or "flat" in listed[0] and "flat" in urls[r["page_id"]][0] else "allow"
            assert r["verdict"] == want, urls[r["page_id"]]


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/') AS canonical")
    bloom = url_filters.bloom_filter(listed, 128)
    probe = spark.range(6000).selectExpr("id", "concat('h', id, '.org/') AS canonical").withColumn("block", url_filters._block(url_filters.F.col("canonical"), 128))
    maybe = {r["id"] for r in probe.join(bloom, "block").where(url_filters._maybe(url_filters.F.col("canonical"))).select("id").collect()}
    assert set(range(3000)) <= maybe and len(maybe) < 3300


@pytest.mark.parametrize("broadcast", [1 << 16, 16])
def test_a_large_list(spark, monkeypatch, broadcast):
    """300,000 entries: the verdicts are those of a lookup, and few candidates pass the filter without being listed."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", broadcast)
    listed = spark.range(300_000).selectExpr("CASE id % 3 WHEN 0 THEN concat('h', id, '.org/') WHEN 1 THEN concat('site', id, '.com/a/b', id, '/') ELSE concat('www.p', id, '.net/page', id) END AS canonical")
    urls = [f"http://h{i}.org/x/{i}" for i in range(0, 3000, 2)] + [f"https://sub.site{i}.com/a/b{i}/c?q" for i in range(0, 3000, 2)] + [f"http://www.p{i}.net/page{i}#f" for i in range(0, 3000, 2)] + ["http://h0.org/"] * 400 + [None, "http://h3.org"]
    entries = {f"h{i}.org/" for i in range(0, 300_000, 3)} | {f"site{i}.com/a/b{i}/" for i in range(1, 300_000, 3)} | {f"www.p{i}.net/page{i}" for i in range(2, 300_000, 3)}

    def verdict(url):
        if url is None:
            return "allow"
        host, _, path = url.split("://")[1].split("?")[0].split("#")[0].partition("/")
        labels, steps = host.split("."), path.split("/")
        hosts = [".".join(labels[i:]) for i in range(len(labels) - 1)]
        paths = ["/" + "".join(x + "/" for x in steps[:k]) for k in range(len(steps))] + ["/" + path]
        return "block" if any(h + p in entries for h in hosts for p in paths) else "allow"

    rows = [(i, u, "h", "p", 1, "c", 2, True) for i, u in enumerate(urls)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, path string, salt int, canonical string, block int, found boolean")
    out = url_filters.filter_urls(table, (), listed).collect()
    assert len(out) == len(urls) and [r["verdict"] for r in sorted(out, key=lambda r: r["page_id"])] == [verdict(u) for u in urls]
    blocks = 1 << (300_000 * url_filters.BITS_PER_ENTRY // 256 - 1).bit_length()
    probe = spark.range(200_000).selectExpr("concat('other', id, '.org/') AS canonical").withColumn("block", url_filters._block(F.col("canonical"), blocks))
    passed = probe.join(url_filters.bloom_filter(listed, blocks), "block").where(url_filters._maybe(F.col("canonical"))).count()
    assert passed < 0.02 * 200_000


def test_urls_of_null_and_repeated_ids(spark):
    listed = spark.createDataFrame([("bad.org/",)], "canonical string")
    out = url_filters.filter_urls(pages(spark, [(None, "http://bad.org/", ""), (None, None, ""), (4, "http://bad.org/", ""), (4, "http://good.org/", ""), (4, "http://good.org/", "")]), (), listed).collect()
    assert sorted((r["page_id"] or -1, r["verdict"]) for r in out) == [(-1, "allow"), (-1, "block"), (4, "allow"), (4, "allow"), (4, "block")]
