"""Language identification with language-bitmask n-gram filters.

Each slot of one array holds a bitmask of languages, so the slots form one Bloom filter per language, sliced by bit. An
n-gram's k slots combined by AND give every language whose profile contains it, in k look-ups however many languages there
are. A document's hits are counted per language (population counts over its n-grams), each count is corrected for the false
positives which the filter's fill predicts, and the corrected shares decide.

Defined results. Null and empty texts, and texts without letters: lang null, share 0, rejected. Languages that tie: the
alphabetically first. Repeated rows: each judged alike. No labelled rows to learn from: every document is rejected.
Very long texts are judged whole. Other columns, whatever their names, are neither read nor touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import alnum_table, codepoints, col, fresh, mix, slices

RESULT = "struct<lang:string,share:double,margin:double,n_grams:int,accepted:boolean>"


@dataclass(frozen=True)
class LanguageFilter:
    """slots: (m, words of 64 languages); fp: by language, the chance that an absent n-gram seems present."""

    langs: tuple[str, ...]
    slots: np.ndarray
    fp: np.ndarray
    n: int
    k: int

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """The bitmask of all languages that contain each n-gram."""
        return _and_slots(self.slots, grams, self.k)


def _slot(grams: np.ndarray, i: int, m: int) -> np.ndarray:
    """Double hashing; m is a power of two."""
    return ((grams + np.uint64(i) * ((grams >> np.uint64(32)) | np.uint64(1))) & np.uint64(m - 1)).astype(np.int64)


def _and_slots(slots: np.ndarray, grams: np.ndarray, k: int) -> np.ndarray:
    out = slots[_slot(grams, 0, len(slots))]
    for i in range(1, k):
        out &= slots[_slot(grams, i, len(slots))]
    return out


def grams_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams over lower-case letters, other runs folded to one space; and each text's first n-gram."""
    cp, offsets = codepoints(["\n" + t for t in texts])
    a = alnum_table()[cp]
    a[(a >= 48) & (a <= 57)] = 0
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    keep[offsets[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    a = a[keep].astype(np.uint64)
    if len(a) < n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = np.zeros(len(a) - n + 1, np.uint64)
    letters = np.zeros(len(h), bool)
    for j in range(n):
        piece = a[j : j + len(h)]
        h = h * np.uint64(0x110001) + piece
        letters |= piece != 0
    # n-grams stay within their text: a text ends in the folded space before the next one begins
    inside = np.ones(len(h), bool)
    for b in at[1:-1]:
        inside[max(0, b - n + 1) : b] = False
    inside &= letters
    return mix(h[inside]), np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(h))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, n: int = 4, least_share: float = 1e-5, least_relative: float = 0.1, k: int = 4, slots_per_gram: int = 16) -> LanguageFilter:
    """Learn the profiles from at most `per_lang` labelled documents of each language (the bound of the training sample; they are
    those of lowest hashed id, so any partitioning gives the same). A profile holds the n-grams that make up at least
    `least_share` of the language's n-grams, and `least_relative` of what they make up in the language where they are
    commonest, so that a few wrong labels don't mix the profiles."""
    lang, key = col(docs, lang_col).cast("string"), col(docs, id_col).cast("string")
    labelled = docs.select(lang.alias("lang"), key.alias("id"), F.xxhash64(key).alias("h")).where("lang is not null")
    chosen = labelled.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= per_lang).select("lang", "id")
    ids = [tuple(r) for r in chosen.distinct().collect()]  # at most per_lang for each language
    spark = docs.sparkSession
    if not ids:
        return LanguageFilter((), np.zeros((1, 1), np.uint64), np.zeros(0), n, k)
    picked = F.broadcast(spark.createDataFrame(ids, "l string, i string"))
    text = docs.select(lang.alias("lang"), key.alias("id"), col(docs, text_col).cast("string").alias("text"))
    text = text.join(picked, (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i"))).select("lang", "text")

    def count(batches):
        for b in batches:
            for tag in sorted(set(b["lang"].to_pylist())):
                own = b.filter(pa.compute.equal(b["lang"], tag))["text"]
                for _, run in slices(own):
                    g, c = np.unique(grams_of(run, n)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([tag] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "g", "c"])

    counts = text.mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    share = F.col("c") / F.sum("c").over(W.partitionBy("lang"))
    shares = counts.withColumn("share", share).withColumn("most", F.max("share").over(W.partitionBy("g")))
    profile = shares.where((F.col("share") >= least_share) & (F.col("share") >= F.col("most") * least_relative)).select("lang", "g").toArrow()
    if not profile.num_rows:
        return LanguageFilter((), np.zeros((1, 1), np.uint64), np.zeros(0), n, k)
    names = np.array(profile["lang"].to_pylist(), object)
    return build(profile["g"].to_numpy().view(np.uint64), names, n, k, slots_per_gram)


def build(grams: np.ndarray, langs: np.ndarray, n: int, k: int = 4, slots_per_gram: int = 16) -> LanguageFilter:
    names = tuple(sorted(set(langs.tolist())))
    most = max(int((langs == x).sum()) for x in names)
    m = 1 << max(10, (most * slots_per_gram - 1).bit_length())
    slots = np.zeros((m, (len(names) + 63) // 64), np.uint64)
    for at, name in enumerate(names):
        own = grams[langs == name]
        for i in range(k):
            s = np.unique(_slot(own, i, m))
            slots[s, at // 64] |= np.uint64(1 << (at % 64))
    fill = np.array([float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(names))])
    return LanguageFilter(names, slots, fill**k, n, k)


def classify(f: LanguageFilter, texts: list[str], least: float, least_margin: float) -> list[np.ndarray]:
    """Best language's index (-1: none), corrected share, lead over the second, n-grams, accepted."""
    if not f.langs:
        z = np.zeros(len(texts))
        return [z.astype(int) - 1, z, z, z.astype(int), z > 0]
    grams, at = grams_of(texts, f.n)
    masks = f.probe(grams)
    total = np.diff(at)
    share = np.zeros((len(texts), len(f.langs)))
    for i in range(len(f.langs)):
        bits = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        hits = np.diff(np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[at])
        share[:, i] = (hits - total * f.fp[i]) / np.maximum(1, total) / (1 - f.fp[i])
    share = np.clip(share, 0, 1)
    best = share.argmax(1)
    top = np.take_along_axis(share, best[:, None], 1)[:, 0]
    second = np.sort(share, 1)[:, -2] if len(f.langs) > 1 else np.zeros(len(texts))
    ok = (total > 0) & (top >= least) & (top - second >= least_margin)
    return [np.where((total > 0) & (top > 0), best, -1), top, top - second, total, ok]


def identify(f: LanguageFilter, text: Column, least: float = 0.3, least_margin: float = 0.02) -> Column:
    """The struct RESULT for each text. least: the corrected share of a text's n-grams that its language must explain;
    least_margin: its lead over the next language."""
    shared = f

    @F.arrow_udf(RESULT)
    def lid(texts: pa.Array) -> pa.Array:
        parts = [classify(shared, run, least, least_margin) for _, run in slices(texts)]
        best, top, lead, total, ok = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 5
        names = [shared.langs[int(i)] if i >= 0 else None for i in best]
        fields = [pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(lead, pa.float64()), pa.array(total.astype(np.int32)), pa.array(ok.astype(bool))]
        return pa.StructArray.from_arrays(fields, ["lang", "share", "margin", "n_grams", "accepted"])

    return lid.asNondeterministic()(text)  # so that no optimizer rule evaluates it twice


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit_options) -> DataFrame:
    """doc_id, labelled (the table's own label), detected, share, margin, n_grams, accepted: one row per input row."""
    f = fit(docs, id_col, text_col, lang_col, **fit_options)
    out = docs.select(col(docs, id_col).alias("doc_id"), col(docs, lang_col).alias("labelled"), identify(f, col(docs, text_col)).alias("r"))
    return out.select("doc_id", "labelled", F.col("r.lang").alias("detected"), F.round("r.share", 6).alias("share"), F.round("r.margin", 6).alias("margin"), "r.n_grams", "r.accepted")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit_options) -> DataFrame:
    """The input's rows and columns, without the documents that no language explains."""
    f = fit(docs, id_col, text_col, lang_col, **fit_options)
    r = fresh(docs, "_lid")
    return docs.withColumn(r, identify(f, col(docs, text_col))).where(F.col(f"{r}.accepted")).drop(r)
