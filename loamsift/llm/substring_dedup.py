"""Passages that several documents share, word for word, with a Count-min sketch before the exact grouping.

Unit: the window of WINDOW words. Winnowing gives each window an anchor, the least-hashed of its runs of GRAM words, by
the window's own words alone; so equal windows have equal anchors at equal offsets, and neighbours mostly share one.

Pass 1 counts anchors. Each partition makes a Count-min sketch of saturating counters, the partition sketches are merged
block by block, and a merged count never falls short of the true one. Pass 2 reads the texts again and sends on only the
windows whose anchor is estimated to occur twice or more; they are grouped exactly, by anchor and fingerprint, so a window
that the sketch overestimates is dropped here and none that repeats is lost. Runs of repeated windows then make the spans.

Scale: the sketch has a cell or two for each anchor that a corpus of its bytes has, up to `max_width` cells a row, so the
broadcast is depth * max_width / 8 bytes at most. Where a corpus outgrows it, more unique windows pass to the exact grouping:
about 5 bytes a word at worst, and the result stays the same. Anchors that occur HOT times or more, counted exactly over all
that passed, don't meet in one task: their windows are counted and joined one by one.

Defined results. Rows with a null doc_id or text, and texts of fewer than WINDOW words: no span. Rows that share a doc_id
are one document: a window that only they hold is not shared. Windows that overlap or touch make one span. Empty tables give
no rows. Texts are read whole; words are runs of anything but white space, compared exactly. Other columns are not read.
Ids are of any type that has an order. Windows are told apart by 64 bits of anchor and 32 of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import exploded_id, hashed_words, id_codes, id_type, materialize, mix, range_hashes, slices

WINDOW, GRAM = 50, 26
DEPTH, MAX_WIDTH, BLOCK = 2, 1 << 29, 1 << 18
#: A cell for each so many bytes of text; an anchor comes about every 80 bytes.
BYTES_PER_CELL = 32
#: An anchor that occurs so often is grouped by window instead. So many of these, in 8 bytes each, are broadcast; more are joined.
HOT, MOST_BROADCAST = 100_000, 1 << 20
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def anchored_windows(texts: list[str], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor's place after the first window, anchor hash) of each anchor, and all windows' 32 bits."""
    h, at = hashed_words(texts, fold=False)
    if len(h) < window:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64), e.astype(np.uint32)
    p = np.arange(len(h) - gram + 1)
    grams = range_hashes(h, p, p + gram)
    # the least hash, the rightmost of equals: a minimum over keys that hold the place below the hash
    m = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - p.astype(np.uint64))
    span, want = 1, window - gram + 1
    while span * 2 <= want:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if want > span:
        m = np.minimum(m[: len(m) - (want - span)], m[want - span :])
    n = np.maximum(0, np.diff(at) - window + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    i = np.repeat(at[:-1] - first[:-1], n) + np.arange(first[-1])
    anchor = (np.uint64(0xFFFFFFFF) - (m[i] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    begin = np.flatnonzero(np.diff(anchor, prepend=-1))
    text = np.repeat(np.arange(len(texts)), n)[begin]
    sig = (range_hashes(h, i, i + window) >> np.uint64(32)).astype(np.uint32)
    return text, i[begin] - at[text], np.diff(np.append(begin, len(i))), anchor[begin] - i[begin], grams[anchor[begin]], sig


def cells(anchors: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    return [(mix(anchors ^ np.uint64(_SEEDS[r])) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(depth)]


def _partial(depth: int, width: int, window: int, gram: int):
    def run(batches):
        def flush(found):
            c, n = np.unique(np.concatenate(cells(np.concatenate(found), depth, width)), return_counts=True)
            blocks, at = np.unique(c // BLOCK, return_index=True)
            once, twice = [], []
            for lo, hi in zip(at, np.append(at[1:], len(c))):
                at_, more = (c[lo:hi] % BLOCK).astype(np.int32), n[lo:hi] > 1
                once.append(_zip(at_[~more]))
                twice.append(_zip(at_[more]))
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])

        found, n = [], 0
        for b in batches:
            for _, texts in slices(b["text"]):
                found.append(anchored_windows(texts, window, gram)[4])
                n += len(found[-1])
                if n > 1 << 21:
                    yield flush(found)
                    found, n = [], 0
        if n:
            yield flush(found)

    return run


def _zip(sorted_cells: np.ndarray) -> bytes:
    return zlib.compress(np.diff(sorted_cells, prepend=0).astype(np.int32).tobytes(), 1)


def _unzip(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32))


def _merge(batches):
    """Rows sorted by block: adds the partitions' counters, which stay at 2 once there."""
    block, seen = None, None

    def close():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(seen >= 2, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    for b in batches:
        for k, once, twice in zip(b["block"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist()):
            if k != block:
                if block is not None:
                    yield close()
                block, seen = k, np.zeros(BLOCK, np.uint8)
            c = _unzip(once)
            seen[c] = np.minimum(2, seen[c] + 1)
            seen[_unzip(twice)] = 2
    if block is not None:
        yield close()


def width_for(n_bytes: int, max_width: int = MAX_WIDTH) -> int:
    """Cells a row for a corpus of so many bytes: a power of two, BLOCK at least."""
    return min(max_width, max(BLOCK, 1 << (max(1, n_bytes // BYTES_PER_CELL) - 1).bit_length()))


def sketch(texts: DataFrame, depth: int, width: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """One bit a cell, whether its merged count is 2 or more. texts: (doc_id, text)."""
    parts = texts.mapInArrow(_partial(depth, width, window, gram), "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block long, bits binary")
    bits = np.zeros(depth * width // 8, np.uint8)
    for r in merged.toLocalIterator():  # depth * width bits in all, of which max_width is the bound
        bits[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def estimated_repeated(bits: np.ndarray, anchors: np.ndarray, depth: int, width: int) -> np.ndarray:
    ok = np.ones(len(anchors), bool)
    for c in cells(anchors, depth, width):
        ok &= (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return ok


def window_keys(h: np.ndarray, off: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place within the row) of each window."""
    row = np.repeat(np.arange(len(h)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return mix(h[row] ^ (sig.astype(np.uint64) | ((off[row] - j).astype(np.uint64) << np.uint64(32)))), row, j


def repeated_runs(h: np.ndarray, doc: np.ndarray, first: np.ndarray, off: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, ...]:
    """From whole anchor groups the runs of windows that two documents or more hold: (doc, first start, last start, copies, first doc)."""
    key, row, j = window_keys(h, off, n, sig)
    d = doc[row]
    order = np.lexsort((d, key))
    k, o = key[order], d[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_doc = new_key | np.append(True, o[1:] != o[:-1])
    at = np.flatnonzero(new_key)
    holders, group = np.add.reduceat(new_doc.astype(np.int64), at), np.cumsum(new_key) - 1
    copies, least = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    copies[order], least[order] = holders[group], o[at][group]
    many = np.flatnonzero(copies > 1)
    if not len(many):
        return (many,) * 5
    cut = np.flatnonzero(np.append(True, (np.diff(many) != 1) | (np.diff(row[many]) != 0)))
    last = np.append(cut[1:], len(many)) - 1
    start = first[row] + j
    return d[many[cut]], start[many[cut]], start[many[last]], np.maximum.reduceat(copies[many], cut), np.minimum.reduceat(least[many], cut)


def _arrays(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """h, first, off, windows, all windows' 32 bits."""
    h, first, off = (t[c].to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[c].to_numpy() for c in ("h", "first", "off"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32)
    n = np.asarray(pa.compute.binary_length(t["sig"])).astype(np.int64) // 4
    return [h.view(np.uint64), first.astype(np.int64), off.astype(np.int64), n, sig]


def _single(batches):
    """Each window as a row of its own."""
    for b in batches:
        h, first, off, n, sig = _arrays(b)
        key, row, j = window_keys(h, off, n, sig)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b["doc_id"].take(pa.array(row)), pa.array(first[row] + j)], ["key", "doc_id", "s"])


def _hot_runs(rows: DataFrame) -> DataFrame:
    """repeated_runs() for frequent anchors, by window: counts combine before the shuffle, and a join that is skewed can be split."""
    w = rows.mapInArrow(_single, f"key long, doc_id {id_type(rows, 'doc_id')}, s long")
    held = w.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")
    return w.join(held, "key").select("doc_id", "s", F.col("s").alias("e"), "copies", "first_doc")


def _exact(batches):
    """Rows sorted by anchor: works through whole groups, as many at a time as fill a chunk."""
    kept: list[pa.Table] = []
    rows = 0

    def work(t: pa.Table):
        h, first, off, n, sig = _arrays(t)
        doc, ids = id_codes(t["doc_id"])
        d, s, e, copies, least = (x.astype(np.int64) for x in repeated_runs(h, doc, first, off, n, sig))
        return pa.RecordBatch.from_arrays([ids(d), pa.array(s), pa.array(e), pa.array(copies), ids(least)], ["doc_id", "s", "e", "copies", "first_doc"])

    for b in batches:
        kept.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= 50_000:
            t = pa.concat_tables(kept)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield work(t.slice(0, cut))
            kept, rows = [t.slice(cut)], len(t) - cut
    if rows:
        yield work(pa.concat_tables(kept))


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, width: int | None = None, max_width: int = MAX_WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, copies (most documents that share one of the span's windows) and
    first_doc (the least doc_id that holds one): a row for each maximal span of windows shared between documents.

    width: cells of a row of the sketch, by default as many as the bytes of the texts call for (width_for)."""
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    texts = exploded_id(docs, id_col, text_col).where("doc_id is not null and text is not null")
    width = width or width_for(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, max_width)
    bits = spark.sparkContext.broadcast(sketch(texts, depth, width, window, gram))

    def candidates(batches):
        seen = bits.value
        for b in batches:
            for at, run in slices(b["text"]):
                text, first, n, off, h, sig = anchored_windows(run, window, gram)
                ok = estimated_repeated(seen, h, depth, width)
                own = sig[np.repeat(ok, n)]
                ends = np.concatenate([[0], np.cumsum(n[ok])]).astype(np.int32) * 4
                blob = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(ends), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), b["doc_id"].take(pa.array(at + text[ok])), pa.array(first[ok].astype(np.int32)), pa.array(off[ok].astype(np.int32)), blob], ["h", "doc_id", "first", "off", "sig"])

    found = materialize(texts.mapInArrow(candidates, f"h long, doc_id {kind}, first int, off int, sig binary"), "windows")
    heavy = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("h"), "frequent")
    n_heavy, frequent = heavy.count(), None
    if n_heavy:
        these = F.broadcast(heavy) if n_heavy <= MOST_BROADCAST else heavy
        frequent, found = _hot_runs(found.join(these, "h", "left_semi")), found.join(these, "h", "left_anti")
    runs = found.repartition("h").sortWithinPartitions("h").mapInArrow(_exact, f"doc_id {kind}, s long, e long, copies long, first_doc {kind}")
    if frequent is not None:
        runs = runs.unionByName(frequent)
    by_doc = W.partitionBy("doc_id").orderBy("s", "e")
    before = F.max(F.col("e") + window).over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
    island = marked.withColumn("k", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    spans = island.groupBy("doc_id", "k").agg(F.min("s").alias("start_word"), (F.max("e") + window).alias("end_word"), F.max("copies").alias("copies"), F.min("first_doc").alias("first_doc"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "copies", "first_doc")


SQL = rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS s FROM w),
win AS (SELECT doc_id, s, string_agg(word, ' ') OVER x AS t FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) QUALIFY count(*) OVER x = {WINDOW}),
shared AS (SELECT t, count(DISTINCT doc_id) AS copies, min(doc_id) AS first_doc FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, s, copies, first_doc, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM win JOIN shared USING (t)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM hit)
SELECT doc_id, min(s)::BIGINT AS start_word, (max(s) + {WINDOW})::BIGINT AS end_word, (max(s) - min(s) + {WINDOW})::BIGINT AS n_words, max(copies)::BIGINT AS copies, min(first_doc)::BIGINT AS first_doc FROM island GROUP BY doc_id, k"""
