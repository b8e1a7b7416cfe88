import random
import re
import time
import hashlib
from html.parser import HTMLParser

from pyspark.sql import functions as F

import pytest

from loamsift.llm import media as M

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><img src='no'>";</script><style>p{}</style></head><body>
<p>Hello <b>wor</b>ld &amp; co<br>two</p><figure><img src="/a.png" alt="A"><figcaption>Cap <i>one</i></figcaption></figure>
<p>mid<img src='data:image/png;base64,QUJD'>after</p><video poster=x><source src=v.mp4><source src=v.webm>old</video>
<picture><source srcset="p.webp 1x, q.webp 2x"><img src="p.jpg" alt="pp"></picture><!-- <img src=no> --><script>x()</script><p>end"""


def kinds(page, base="http://h.org/d/e.html"):
    return [(i["kind"], i["text"] or i["url"], i["caption"]) for i in M.parse(page, base)]


def test_order_captions_and_addresses():
    assert kinds(PAGE) == [
        ("text", "Hello world & co", None), ("text", "two", None), ("image", "http://h.org/a.png", "Cap one"), ("text", "mid", None), ("image", "data:image/png;base64,QUJD", None),
        ("text", "after", None), ("video", "http://h.org/d/v.mp4", None), ("text", "old", None), ("image", "http://h.org/d/p.webp", "pp"), ("text", "end", None),
    ]
    assert [i["position"] for i in M.parse(PAGE, "")] == list(range(10))


def test_odd_markup():
    assert kinds("") == [] and kinds("plain") == [("text", "plain", None)]
    assert kinds("a < b > c") == [("text", "a < b > c", None)]
    assert kinds("<p>x<!-- open") == [("text", "x", None)]
    assert kinds("<script>never closed <p>x") == [] and kinds("<style>a</style>b") == [("text", "b", None)]
    assert kinds("<figure><figcaption>alone</figcaption></figure>") == [("text", "alone", None)]
    assert kinds("<figure><img src=a><img src=b><figcaption>both") == [("image", "http://h.org/d/a", "both"), ("image", "http://h.org/d/b", "both")]
    assert kinds("<img><img src=''><img src=' '>") == []
    assert kinds("<img alt=\"a > b\" src=x>") == [("image", "http://h.org/d/x", "a > b")]
    assert kinds("<head><p>h</p><body>b") == [("text", "b", None)]
    assert kinds("<img src='http://[bad'>")[0][1] == "http://[bad"


def test_images_after_unclosed_holders():
    u = "http://h.org/d/"
    for tag in ("video", "audio"):
        want = [(tag, u + "a", None), ("image", u + "b", None), ("image", u + "c", None)]
        for opened in (f"<{tag} src='a'>", f"<{tag} src='a'/>", f"<{tag} src=a />", f"<div><{tag} src='a'></div>", f"<{tag}><source src=a><source src=a2>", f"<picture><{tag} src='a'></picture>"):
            assert kinds(opened + "<img src=b><p><img src=c></p>") == want, opened
        assert kinds(f"<div><{tag} src='a'></div><img src=b><img src=c></{tag}>") == want
        assert kinds(f"<{tag} src='a'><img src=b><img src=c><{tag} src='e'></{tag}>") == [*want, (tag, u + "e", None)]
        assert kinds(f"<{tag} src='a'><p>x</p><img src=fallback alt=A></{tag}><img src=b>")[:: 2] == [(tag, u + "a", "A"), ("image", u + "b", None)]
        assert [i["url"] for i in M.parse(f"<{tag} src=a/><img src=b>", u)] == [u + "a/", u + "b"]
    assert kinds("<picture><source srcset=p><img src=q alt=Q><img src=b><p><img src=c>") == [("image", u + "p", "Q"), ("image", u + "b", None), ("image", u + "c", None)]
    assert kinds("<picture><source srcset=p><p><img src=b>") == [("image", u + "p", None), ("image", u + "b", None)]
    assert kinds("<picture><video src=a></video><img src=b></picture>") == [("video", u + "a", None), ("image", u + "b", None)]


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hide = [], 0

    def handle_starttag(self, tag, attrs):
        self.hide += tag in ("script", "style", "head")
        self.out.append(" " if tag not in ("b", "a") else "")

    def handle_endtag(self, tag):
        self.hide -= tag in ("script", "style", "head")
        self.out.append(" " if tag not in ("b", "a") else "")

    def handle_data(self, data):
        if not self.hide:
            self.out.append(data)


def test_text_against_the_standard_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        p = Text()
        p.feed(r["html"])
        p.close()
        assert " ".join("".join(p.out).split()) == " ".join(i["text"] for i in M.parse(r["html"], r["url"]))


def test_payloads_resolve_by_digest(spark):
    url = "http://h.org/a.png"
    pages = spark.createDataFrame([(1, url, PAGE), (2, None, "<p>no media</p>"), (3, "http://h.org/", None), (3, "http://h.org/", ""), (None, "http://h.org/x", "<img src=a.png>")], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("x") for c in ("items", "key", "met", "digest", "p", "i")})
    sha = hashlib.sha256(url.encode()).hexdigest()
    extern = spark.createDataFrame([(sha, "image/png", 10), (sha, "image/gif", 99), (None, "x", 1), ("ff", "y", 2)], "digest string, mime string, n_bytes long")
    got = {}
    for r in M.interleaved(pages, M.inline_payloads(pages).unionByName(extern)).collect():
        got.setdefault(r["page_id"], []).append(r)
    (one,) = got[1]
    assert (one["n_text"], one["n_media"], one["n_resolved"]) == (6, 4, 2)
    assert [i["position"] for i in one["items"]] == list(range(10))
    assert (one["items"][2]["mime"], one["items"][2]["n_bytes"], one["items"][2]["resolved"], one["items"][2]["caption"]) == ("image/gif", 99, True, "Cap one")
    assert (one["items"][4]["mime"], one["items"][4]["n_bytes"]) == ("image/png", 3) and not one["items"][6]["resolved"] and one["items"][6]["mime"] is None
    assert got[2][0]["n_media"] == 0 and len(got[3]) == 2 and got[None][0]["n_resolved"] == 1
    assert M.interleaved(pages.limit(0), extern).collect() == []
    assert M.interleaved(pages, extern.limit(0)).where("n_resolved > 0").collect() == []


def test_inline_payloads():
    assert M.inline_payload("data:text/plain,a%20b") == ("text/plain", b"a b") and M.inline_payload("data:;base64,QQ==") == ("text/plain", b"A")
    assert M.inline_payload("data:image/png;base64,***") is None and M.inline_payload("http://x") is None
    assert M.digest("data:x/y;base64,QUJD") == hashlib.sha256(b"ABC").hexdigest()


def test_long_page_is_kept_whole():
    t = "word " * 300_000
    assert kinds(f"<p>{t}</p>") == [("text", t.strip(), None)]


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<a \"'", "<img src=a ", "<", "<!", "<!-", "<a b='\">", "&", "<video>", "</", "<p>'", '<a "x">'])
@pytest.mark.parametrize("end", ["", ">", "'\">"])
def test_broken_pages_take_linear_time(piece, end):
    """A megabyte of it; the patterns it replaced took hours."""
    n = (1 << 20) // len(piece)
    began = time.perf_counter()
    M.parse(piece * n + end, "")
    assert time.perf_counter() - began < 8


def test_tags_against_the_plain_pattern():
    """What ends a tag, against one pattern that tries every place."""
    plain = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    r = random.Random(5)
    for _ in range(4000):
        page = "".join(r.choice(["<", ">", "'", '"', "a", "b ", "<a", "</a", "<!--", "-->", "=", "<!", "x>", "<![CDATA[", "]]>"]) for _ in range(r.randrange(1, 25)))
        want = [(m.start(), m.end(), bool(m[1]), m[2] and m[2].lower(), m[3] or "") for m in plain.finditer(page)]
        for near in (4096, 3):
            M.NEAR, got, at, tags = near, [], 0, M.Tags(page)
            while (t := tags.after(at)) is not None:
                got.append(t)
                at = t[1]
            M.NEAR = 4096
            assert got == want, page
