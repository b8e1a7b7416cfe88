"""Text functions as Columns. They mean what Python's str methods and re mean on text with any Unicode line end or white space."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow, by_parts
from .patterns import IDENTIFIER, MAIL, NUMBER, STOP_WORDS, WEB, WORD, java

SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
BREAK = r"\R|[\x1c-\x1e]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it, also within functions of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The value, marked so that no optimizer rule copies it to each place that reads it, such as a filter pushed below it.

    The mark is a test that always holds, on a number the optimizer can't foresee (it does foresee a comparison with rand) and
    that streams have too."""
    return F.when(F.spark_partition_id() >= 0, value)


def lines(t: Column) -> Column:
    """str.splitlines()"""
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, rf"(?:{BREAK})\z", ""), BREAK))


def n_lines(t: Column) -> Column:
    return F.size(lines(t))


@arrow("struct<all:int,full:int>")
@by_parts
def line_counts(texts: pa.Array) -> pa.Array:
    """How many lines, and how many of them are not blank; str.splitlines() is some ten times as quick as the pattern."""
    rows = [t.splitlines() if t else [] for t in texts.to_pylist()]
    counts = [len(ls) for ls in rows], [sum(x != "" and not x.isspace() for x in ls) for ls in rows]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in counts], ["all", "full"], mask=texts.is_null())


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?U){SPACE}+\z", "")


def not_blank(t: Column) -> Column:
    return t.rlike(_NOT_SPACE)


def _join(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def normalize_whitespace(t: Column) -> Column:
    return strip(F.regexp_replace(t, rf"(?U){SPACE}+", " "))


def remove_empty_lines(t: Column) -> Column:
    return _join(F.filter(lines(t), not_blank))


def remove_trailing_whitespace(t: Column) -> Column:
    return _join(F.transform(lines(t), rstrip))


def normalize_line_endings(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def count_words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(java(r"\w+")))


def count_characters(t: Column) -> Column:
    return F.length(t)


def count_characters_no_spaces(t: Column) -> Column:
    return F.length(F.replace(t, F.lit(" "), F.lit("")))


def all_matches(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def extract_words(t: Column) -> Column:
    return all_matches(t, java(r"\w+"))  # whole runs, so no boundaries need be looked for


def extract_sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "[.!?]+"), strip), lambda x: x != "")


def extract_paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n\n"), strip), lambda x: x != "")


def extract_urls(t: Column) -> Column:
    return all_matches(t, java(WEB))


def extract_emails(t: Column) -> Column:
    return all_matches(t, java(r"\b" + MAIL))


def extract_numbers(t: Column) -> Column:
    return all_matches(t, java(NUMBER))


def extract_hashtags(t: Column) -> Column:
    return all_matches(t, java(r"#\w+"))


def extract_mentions(t: Column) -> Column:
    return all_matches(t, java(r"@\w+"))


def clean_text(t: Column) -> Column:
    """Without control characters, white space folded."""
    return normalize_line_endings(remove_trailing_whitespace(normalize_whitespace(F.regexp_replace(t, r"[\p{Cc}&&[^\t\n\r]]", ""))))


def truncate_text(t: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(max(0, most - len(suffix)))), F.lit(suffix)))


def _filled(line: Column, width: int) -> Column:
    """Greedy filling by words; null for a blank line."""
    rows = F.regexp_replace(normalize_whitespace(line), rf"(?s)\G([^ ]{{{width + 1},}}+|.{{1,{width}}})(?: |\z)", "$1\n")
    return F.nullif(F.regexp_replace(rows, r"\n\z", ""), F.lit(""))


def wrap_text(t: Column, width: int) -> Column:
    """Lines of more than `width` characters are filled by words; such a line without words is left out."""
    return _join(F.transform(lines(t), lambda x: F.when(F.length(x) <= width, x).otherwise(_filled(x, width))))


def syllables(word: Column) -> Column:
    """Runs of vowels, without a silent ending, at least 1."""
    w = F.regexp_replace(F.lower(word), r"(?:e[sd]|ing)\z", "")
    runs = lambda x: F.regexp_count(x, F.lit("[aeiouy]+"))
    return let(w, lambda x: F.greatest(F.lit(1), runs(x) - F.when(F.endswith(x, F.lit("e")) & (runs(x) > 1), 1).otherwise(0)))


_IS_WORD, _IS_VOWEL, _IS_SPACE, _IS_END, _LETTER = 1, 2, 4, 8, 4
_E, _S_, _D, _I, _N, _G = range(1, 7)


@cache
def _classes() -> np.ndarray:
    """For each code point the _IS_ bits, and above them which letter of an ending it is, whatever its case."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = _IS_WORD * (x == "_" or unicodedata.category(x)[0] in "LN") | _IS_SPACE * x.isspace() | _IS_END * (x in ".!?")
    for x in "aeiouy":
        out[[ord(x), ord(x.upper())]] |= _IS_VOWEL
    for i, x in enumerate("esding", 1):
        out[[ord(x), ord(x.upper())]] |= i << _LETTER
    return out


@arrow("struct<sentences:long,words:long,syllables:long>")
@by_parts
def _reading_counts(texts: pa.Array) -> pa.Array:
    """How many of extract_sentences(), how many words, and the sum of their syllables(), of all texts at once: a pattern for each
    of these would make an object of every match."""
    # in lower case a capital I with a dot is two signs, of which the second is no letter
    own = [(t or "").replace("İ", "iƛ") for t in texts.to_pylist()]
    k = _classes()[np.frombuffer(".".join([*own, ""]).encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in own])
    word, vowel, letter = (k & _IS_WORD).astype(bool), (k & _IS_VOWEL).astype(bool), k >> _LETTER
    first = np.flatnonzero(word & ~np.append(False, word[:-1]))
    last = np.flatnonzero(word[:-1] & ~word[1:])  # behind the last word is the full stop of its text
    x, y, z = letter[last], letter[last - 1], letter[last - 2]
    two, three = (y == _E) & ((x == _S_) | (x == _D)), (x == _G) & (y == _N) & (z == _I)
    for ending, n in ((two, 2), (three, 3)):
        for i in range(n):
            vowel[last[ending] - i] = False
    runs = np.add.reduceat(vowel & ~np.append(False, vowel[:-1]), first, dtype=np.int64)
    at = last - 2 * two - 3 * three
    silent = (runs > 1) & (at >= first) & (letter[at] == _E)
    syllables = np.append(0, np.cumsum(np.maximum(1, runs - silent)))
    some = np.flatnonzero(~(k & _IS_SPACE).astype(bool))
    stop = (k[some] & _IS_END).astype(bool)
    sentences = some[~stop & np.append(True, stop[:-1])]
    words = np.append(0, np.searchsorted(first, ends))
    counts = [np.diff(np.append(0, np.searchsorted(sentences, ends))), np.diff(words), np.diff(syllables[words])]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts], ["sentences", "words", "syllables"], mask=texts.is_null())


def syllable_total(t: Column) -> Column:
    """The sum of syllables() over the words."""
    return _reading_counts(t)["syllables"]


def readability(t: Column) -> Column:
    """struct<sentences,words,syllables,words_per_sentence,syllables_per_word,flesch,fk>; zeros where there are no words or sentences."""
    # Python's part is an argument: it can't stand within the function
    return F.when(t.isNotNull(), let(_reading_counts(t), lambda p: _readability(*[p[c].cast("double") for c in ("sentences", "words", "syllables")])))


def _readability(s: Column, w: Column, y: Column) -> Column:
    some = (s > 0) & (w > 0)
    wps, spw = F.try_divide(w, s), F.try_divide(y, w)
    flesch = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(206.835) - wps * 1.015 - spw * 84.6))
    fk = F.greatest(F.lit(0.0), wps * 0.39 + spw * 11.8 - 15.59)
    zero = lambda x: F.when(some, x).otherwise(0.0)
    return F.struct(s.cast("int").alias("sentences"), w.cast("int").alias("words"), y.cast("long").alias("syllables"), zero(wps).alias("words_per_sentence"), zero(spw).alias("syllables_per_word"), zero(flesch).alias("flesch"), zero(fk).alias("fk"))


def top_counts(words: list[str], n: int) -> list[tuple[str, int]]:
    """The n commonest, the earlier first of equals."""
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return sorted(counts.items(), key=lambda x: -x[1])[:n]


_PAIRS = pa.list_(pa.struct([("word", pa.string()), ("count", pa.int64())]))
_STOP = frozenset(STOP_WORDS)
_WORD, _IDENTIFIER = re.compile(WORD), re.compile(IDENTIFIER)


def _kept(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 2 and w not in _STOP]


def extract_keywords(t: Column, top_n: int = 10) -> Column:
    @F.arrow_udf("array<struct<word:string,count:long>>")
    def keywords(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [dict(zip(("word", "count"), p)) for p in top_counts(_kept(_WORD.findall(x.lower())), top_n)] for x in texts.to_pylist()], _PAIRS)

    return keywords(t)


@arrow("struct<top_words:array<struct<word:string,count:long>>,unique_words:int,total_words:int,vocabulary_richness:double>")
def keyword_stats(texts: pa.Array) -> pa.Array:
    """The 20 commonest identifiers without stop words, how many different ones, of how many, and their ratio."""
    rows = []
    for t in texts.to_pylist():
        if t is None:
            rows.append(None)
            continue
        found = _IDENTIFIER.findall(t)
        kept = _kept([w.lower() for w in found])
        n = len(set(kept))
        rows.append({"top_words": [dict(zip(("word", "count"), p)) for p in top_counts(kept, 20)], "unique_words": n, "total_words": len(found), "vocabulary_richness": n / len(found) if found else 0.0})
    return pa.array(rows, pa.struct([("top_words", _PAIRS), ("unique_words", pa.int32()), ("total_words", pa.int32()), ("vocabulary_richness", pa.float64())]))


_SCRIPTS = {"chinese": r"[\x{4e00}-\x{9fff}]", "japanese": r"[\x{3040}-\x{30ff}]", "korean": r"[\x{ac00}-\x{d7af}]", "arabic": r"[\x{0600}-\x{06ff}]", "russian": r"[\x{0400}-\x{04ff}]"}


def detect_language(t: Column) -> Column:
    """By script, in the order of _SCRIPTS; more than a tenth of the characters decides."""
    out = F.when(F.length(t) == 0, "unknown")
    for name, chars in _SCRIPTS.items():
        out = out.when(F.regexp_count(t, F.lit(chars)) / F.greatest(F.lit(1), F.length(t)) > 0.1, name)
    return F.when(t.isNotNull(), out.otherwise("english"))


def basic_stats(t: Column) -> Column:
    return let(F.struct(lines(t).alias("lines"), extract_words(t).alias("words"), t.alias("t")), lambda p: _basic_stats(p["lines"], p["words"], p["t"]))


def _basic_stats(ls: Column, words: Column, t: Column) -> Column:
    widths = F.transform(ls, F.length)
    n, w, c = F.size(ls), F.size(words), F.length(t)
    word_chars = F.aggregate(F.transform(words, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.struct(
        n.alias("total_lines"), F.size(F.filter(ls, not_blank)).alias("non_empty_lines"), w.alias("total_words"), c.alias("total_characters"), count_characters_no_spaces(t).alias("characters_no_spaces"),
        F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("average_line_length"), F.coalesce(F.try_divide(word_chars, w), F.lit(0.0)).alias("average_word_length"),
        F.coalesce(F.array_max(widths), F.lit(0)).alias("longest_line"), F.coalesce(F.array_min(widths), F.lit(0)).alias("shortest_line"),
    )


_ANY_TYPE = r"(?:(?:public|protected|private))?\s*(?:static\s+)?"
_CODE: dict[str, dict[str, tuple[str, int]]] = {
    "python": {
        "imports": (r"(?m)^(?:from\s+\w+\s+)?import\s+[,\w\s]+", 0), "functions": (r"(?m)^def\s+(\w+)", 1), "classes": (r"(?m)^class\s+(\w+)", 1),
        "comments": ("(?m)#.*$", 0), "docstrings": ('(?s)""".*?"""', 0),
    },
    "javascript": {
        "functions": (r"function\s+(\w+)", 1), "arrow_functions": (r"(?:var|let|const)\s+(\w+)\s*=\s*\([^)]*\)\s*=>", 1), "classes": (r"class\s+(\w+)", 1),
        "imports": (r"""import\s+.*?from\s+['"]([^'"]+)['"]""", 1), "comments": (r"(?ms)//.*$|/\*.*?\*/", 0),
    },
    "java": {
        "classes": (r"class\s+(\w+)", 1), "methods": (_ANY_TYPE + r"(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*(?:throws\s+[,\w\s]+)?\s*\{", 1),
        "imports": (r"import\s+([.\w]+);", 1), "comments": (r"(?ms)//.*$|/\*.*?\*/", 0),
    },
}
_CODE["typescript"] = _CODE["javascript"]


def text_patterns(t: Column, language: Column) -> Column:
    """map<string,array<string>>: urls, emails and numbers, and by language what its code holds."""
    base = F.create_map(F.lit("urls"), extract_urls(t), F.lit("emails"), extract_emails(t), F.lit("numbers"), extract_numbers(t))
    out = None
    for name, found in _CODE.items():
        # a method needs a body: texts without one are spared its costly pattern
        own = F.map_concat(base, F.create_map(*[x for k, (p, g) in found.items() for x in (F.lit(k), all_matches(F.when(F.contains(t, F.lit("{")), t).otherwise("") if k == "methods" else t, java(p), g))]))
        out = F.when(language == name, own) if out is None else out.when(language == name, own)
    return out.otherwise(base)


def encoding_info(t: Column) -> Column:
    ascii_ = t.rlike(r"\A[\x00-\x7f]*\z")
    return F.struct(F.lit("utf-8").alias("detected_encoding"), ascii_.alias("is_ascii"), (~ascii_).alias("has_unicode"), F.startswith(t, F.lit("﻿")).alias("has_bom"))


def text_features(t: Column, language: Column) -> Column:
    return F.struct(basic_stats(t).alias("basic_stats"), readability(t).alias("readability"), keyword_stats(t).alias("keywords"), text_patterns(t, language).alias("patterns"), encoding_info(t).alias("encoding_info"))
