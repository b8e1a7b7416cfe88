"""Web pages as interleaved sequences of text and media.

Each page's HTML is parsed once to an ordered list of items: runs of visible text and references to media, with each
reference's caption. Payloads are resolved by digest: a reference to a URL has the digest of its resolved address, an
inline payload (data: URI) that of its bytes, and one join against the payload table brings its type and size. Items keep
their position, so text, media and captions stay aligned whatever is found.

Defined results. Null and empty HTML: a sequence without items. Null page ids: a row like any other, with a null id.
Repeated rows: each gives its sequence. Repeated digests in the payload table: the row with the least (mime, n_bytes).
References whose payload is missing: `resolved` false, and they keep their place. Text of any length is kept whole. Unclosed
elements end with the page; a tag without an end is text, as is all that looks like one behind it; but video, audio and picture end at the next block or medium, or where what is around them closes. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

ITEM = "struct<position:int,kind:string,text:string,url:string,digest:string,caption:string>"
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_SIGN = re.compile("[>\"']")
NEAR = 4096
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_HIDDEN = ("script", "style", "template", "noscript", "head")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_HOLDER = {t: re.compile(rf"<(/?){t}(?![\w:-])", re.I) for t in ("video", "audio", "picture")}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "", "embed": "object", "object": "object", "iframe": "frame", "image": "image"}


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return out


def inline_payload(url: str) -> tuple[str, bytes] | None:
    """(mime, bytes) of a data: URI; None if it isn't one, or a broken one."""
    if url[:5].lower() != "data:" or "," not in url:
        return None
    head, body = url[5:].split(",", 1)
    mime = head.split(";")[0].strip().lower() or "text/plain"
    try:
        data = base64.b64decode(re.sub(r"\s", "", body), validate=True) if head.lower().endswith(";base64") else unquote_to_bytes(body)
    except (binascii.Error, ValueError):
        return None
    return mime, data


def digest(url: str) -> str:
    found = inline_payload(url)
    return hashlib.sha256(found[1] if found else url.encode("utf-8", "surrogatepass")).hexdigest()


def _address(attributes: dict[str, str], base: str) -> str | None:
    url = attributes.get("src") or attributes.get("data-src") or attributes.get("data") or attributes.get("href") or ""
    if not url and attributes.get("srcset"):
        url = attributes["srcset"].split(",")[0].split()[0] if attributes["srcset"].strip(" ,") else ""
    url = url.strip()
    if not url:
        return None
    if url[:5].lower() == "data:":
        return url
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


def _title(attributes: dict[str, str]) -> str | None:
    return _SPACE.sub(" ", attributes.get("alt") or attributes.get("title") or attributes.get("aria-label") or "").strip() or None


class Tags:
    """The tags of a page, in time proportional to its length whatever it holds.

    Most tags end close by, where a pattern finds the end. For others all signs that matter are walked once, from the page's
    end: where a tag ends that is outside quotes before a sign follows from where it does before a later one.
    """

    def __init__(self, page: str) -> None:
        self.page, self.next_end = page, -1
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def _next_end(self, at: int) -> int:
        """The next > at or behind a place, the page's length if there is none. Places only grow."""
        if self.next_end < at:
            found = self.page.find(">", at)
            self.next_end = found if found >= 0 else len(self.page)
        return self.next_end

    def _end(self, at: int) -> int:
        """Of the tag whose attributes begin at a place: its > outside quotes, or -1."""
        page, end = self.page, self._next_end(at)
        if end == len(page):
            return -1
        if end - at <= NEAR:
            part = page[at:end]
            if '"' not in part and "'" not in part:
                return end
            if m := _REST.match(page, at, at + NEAR):
                return m.end() - 1
        if self.places is None:
            self.places = [m.start() for m in _SIGN.finditer(page)]
            self.ends = [-1] * (len(self.places) + 1)
            behind = {'"': len(self.places), "'": len(self.places)}
            for k in range(len(self.places) - 1, -1, -1):
                sign = page[self.places[k]]
                if sign == ">":
                    self.ends[k] = self.places[k]
                else:
                    self.ends[k] = self.ends[min(behind[sign] + 1, len(self.places))]
                    behind[sign] = k
        return self.ends[bisect_left(self.places, at)]

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it closes, name, attributes) of the first tag or comment from a place on; no name: a comment."""
        page, start = self.page, at
        while (start := page.find("<", start)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, None, ""
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                return start, end + 3 if end >= 0 else len(page), False, None, ""
            if page.startswith(("<!", "<?"), start):
                return start, min(len(page), self._next_end(start + 2) + 1), False, None, ""
            m = _NAME.match(page, start)
            if m and (end := self._end(m.end())) >= 0:
                return start, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            start += 1
        return None


def parse(page: str, base: str) -> list[dict]:
    """The items of a page in document order."""
    items: list[dict] = []
    words: list[str] = []
    stack: list[str] = []  # the open hidden elements
    figures: list[list] = []  # of each open figure: its media items, its caption's words or None
    holder: list[list] = []  # open video, audio and picture elements: tag, item, whether a closing tag follows, open blocks inside

    def put(text: str) -> None:
        if text:
            (figures[-1][1] if figures and figures[-1][2] else words).append(text)

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            items.append({"position": len(items), "kind": "text", "text": text, "url": None, "digest": None, "caption": None})

    def hold(tag: str, item: int, at: int) -> None:
        following = _HOLDER[tag].search(page, at)
        holder.append([tag, item, bool(following and following[1]), Counter()])

    def end_holders(tag: str, close: bool) -> None:
        """Ends those that this tag shows to be over: without a closing tag at the next block or medium, else where what is around them closes."""
        for i, (_, _, closes, inside) in enumerate(holder):
            if not closes and (tag in _BLOCK or tag in _MEDIA and tag not in ("source", "img") or tag == "picture" or tag == "img" and holder[i][0] != "picture"):
                del holder[i:]
                return
            if tag in _BLOCK and tag not in ("br", "hr"):
                if close and not inside[tag]:
                    del holder[i:]
                    return
                inside[tag] += -1 if close else 1

    def close_figure() -> None:
        own, caption, _ = figures.pop()
        text = _SPACE.sub(" ", "".join(caption)).strip()
        if text and own:
            for i in own:
                items[i]["caption"] = text
        elif text:  # a caption without media is text
            words.append(" " + text + " ")

    at, tags = 0, Tags(page)
    while at < len(page):
        found = tags.after(at)
        if not stack:
            put(entities.unescape(page[at : found[0] if found else len(page)]))
        if not found:
            break
        _, at, close, tag, inside = found
        if tag is None:
            continue
        if stack:
            if close and tag == stack[-1]:
                stack.pop()
            elif not close and tag == stack[-1]:
                stack.append(tag)
            elif close and tag in ("html", "body") or not close and tag == "body":  # an unclosed head ends where the body begins
                stack.clear()
            if stack and stack[-1] in _RAW_END and not close:
                end = _RAW_END[stack[-1]].search(page, at)
                stack.pop()
                at = end.end() if end else len(page)
            if not (stack or close) and tag in _RAW_END:
                continue
            if stack or tag == "head":
                continue
        if holder and not (close and tag in _HOLDER):
            end_holders(tag, close)
        if tag in _BLOCK:
            put(" ")
            if not (figures and figures[-1][2]):
                flush()
        if tag in _HIDDEN and not close:
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            else:
                stack.append(tag)
        elif tag == "figure":
            if not close:
                figures.append([[], [], False])
            elif figures:
                close_figure()
        elif tag == "figcaption" and figures:
            figures[-1][2] = not close
        elif tag in ("video", "audio", "picture") and close:
            if (open_at := next((i for i in reversed(range(len(holder))) if holder[i][0] == tag), None)) is not None:
                del holder[open_at:]  # with what is still open inside
        elif (tag in _MEDIA or tag == "picture") and not close:
            attributes = _attributes(inside)
            url = _address(attributes, base)
            open_item = holder[-1][1] if holder else -1
            if tag == "picture":
                hold(tag, -1, at)
            elif open_item >= 0 and tag in ("source", "img"):
                # another form of what its holder already shows; only its description can be new
                items[open_item]["caption"] = items[open_item]["caption"] or _title(attributes)
            elif url:
                flush()
                kind = _MEDIA[tag] or {"video": "video", "audio": "audio"}.get(holder[-1][0] if holder else "", "image")
                items.append({"position": len(items), "kind": kind, "text": None, "url": url, "digest": digest(url), "caption": _title(attributes)})
                if figures:
                    figures[-1][0].append(len(items) - 1)
                if tag in ("video", "audio"):
                    hold(tag, len(items) - 1, at)
                elif holder:
                    holder[-1][1] = len(items) - 1
            elif tag in ("video", "audio"):
                hold(tag, -1, at)
            if tag == "img" and holder and holder[-1][0] == "picture":
                holder.pop()  # a picture has one image, its last form
    while figures:
        close_figure()
    flush()
    return items


def _items(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    kind = pa.list_(pa.struct([("position", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "url", "digest", "caption"))]))

    @F.arrow_udf(f"array<{ITEM}>")
    def parsed(html: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([parse(h or "", u or "") for h, u in zip(html.to_pylist(), url.to_pylist())], kind)

    items = parsed.asNondeterministic()(col(pages, html_col).cast("string"), col(pages, url_col).cast("string"))
    return pages.select(col(pages, id_col).alias("page_id"), items.alias("items"))


def inline_payloads(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(digest, mime, n_bytes) of the payloads that pages carry inside themselves, one row for each digest."""

    def run(batches):
        for b in batches:
            rows = {}
            for h in b["html"].to_pylist():
                for i in parse(h, ""):
                    if i["url"] and (found := inline_payload(i["url"])):
                        rows[i["digest"]] = found
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([m for m, _ in rows.values()], pa.string()), pa.array([len(d) for _, d in rows.values()], pa.int64())], ["digest", "mime", "n_bytes"])

    own = pages.select(col(pages, html_col).cast("string").alias("html")).where(F.contains(F.lower("html"), F.lit("data:")))
    return own.mapInArrow(run, "digest string, mime string, n_bytes long").groupBy("digest").agg(F.min(F.struct("mime", "n_bytes")).alias("p")).select("digest", "p.mime", "p.n_bytes")


def interleaved(pages: DataFrame, payloads: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, n_text, n_media, n_resolved, items array<struct<position,kind,text,url,digest,caption,mime,n_bytes,resolved>>.

    payloads: (digest, mime, n_bytes). Only references are shuffled for the join, not the pages' text: pages with media
    meet their resolved references by a row key, all others pass straight through.
    """
    known = payloads.select("digest", "mime", F.col("n_bytes").cast("long").alias("n_bytes")).where("digest is not null").groupBy("digest").agg(F.min(F.struct("mime", "n_bytes")).alias("p"))
    found = materialize(_items(pages, id_col, url_col, html_col).withColumn("key", F.monotonically_increasing_id()), "items")
    has = F.exists("items", lambda i: i["digest"].isNotNull())
    refs = found.where(has).select("key", F.explode(F.filter("items", lambda i: i["digest"].isNotNull())).alias("i"))
    met = refs.select("key", "i.position", "i.digest").join(known, "digest").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("position", "p"))).alias("met"))

    def resolved(i, met):
        p = met[i["position"]] if met is not None else F.lit(None).cast("struct<mime:string,n_bytes:long>")
        return F.struct(*[i[f].alias(f) for f in ("position", "kind", "text", "url", "digest", "caption")], p["mime"].alias("mime"), p["n_bytes"].alias("n_bytes"), p.isNotNull().alias("resolved"))

    with_media = found.where(has).join(met, "key", "left").withColumn("items", F.transform("items", lambda i: resolved(i, F.coalesce("met", F.create_map().cast("map<int,struct<mime:string,n_bytes:long>>")))))
    plain = found.where(~has).withColumn("items", F.transform("items", lambda i: resolved(i, None)))
    out = with_media.select("page_id", "items").unionByName(plain.select("page_id", "items"))
    count = lambda test: F.size(F.filter("items", test)).alias
    return out.select("page_id", count(lambda i: i["kind"] == "text")("n_text"), count(lambda i: i["kind"] != "text")("n_media"), count(lambda i: i["resolved"])("n_resolved"), "items")
