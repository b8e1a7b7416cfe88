"""Text and hash functions against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loamsift.functions import hashing, text

PIECES = ["a", "b", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\xa0", "\u3000", "é", "ß", "中", "x.", "Hello", "123", "²", "1.5", "!", "😀", "_"]


def texts(n=400, seed=1):
    r = random.Random(seed)
    return ["", " ", "\n", "\n\n", "a\n\n", *["".join(r.choice(PIECES) for _ in range(r.randrange(12))) for _ in range(n)]]


CASES = {
    "lines": (text.lines, str.splitlines),
    "n_lines": (text.n_lines, lambda t: len(t.splitlines())),
    "strip": (text.strip, str.strip),
    "rstrip": (text.rstrip, str.rstrip),
    "not_blank": (text.not_blank, lambda t: bool(t.strip())),
    "words": (text.extract_words, lambda t: re.findall(r"\b\w+\b", t)),
    "count_words": (text.count_words, lambda t: len(re.findall(r"\b\w+\b", t))),
    "normalize": (text.normalize_whitespace, lambda t: re.sub(r"\s+", " ", t).strip()),
    "endings": (text.normalize_line_endings, lambda t: t.replace("\r\n", "\n").replace("\r", "\n")),
    "no_empty": (text.remove_empty_lines, lambda t: "\n".join(x for x in t.splitlines() if x.strip())),
    "no_trailing": (text.remove_trailing_whitespace, lambda t: "\n".join(x.rstrip() for x in t.splitlines())),
    "characters": (text.count_characters, len),
    "no_spaces": (text.count_characters_no_spaces, lambda t: len(t.replace(" ", ""))),
    "sentences": (text.extract_sentences, lambda t: [s.strip() for s in re.split(r"[.!?]+", t) if s.strip()]),
    "paragraphs": (text.extract_paragraphs, lambda t: [s.strip() for s in t.split("\n\n") if s.strip()]),
    "numbers": (text.extract_numbers, lambda t: re.findall(r"\b" r"\d+(?:\.\d+)?" r"\b", t)),
    "truncate": (lambda t: text.truncate_text(t, 6), lambda t: t if len(t) <= 6 else t[:3] + "..."),
    "checksum": (hashing.checksum, lambda t: sum(map(ord, t)) % 65536),
    "fingerprint": (hashing.content_fingerprint, lambda t: hashlib.sha256("".join(t.split()).lower().encode()).hexdigest()),
    "sha512": (lambda t: hashing.calculate_hash(t, "sha512"), lambda t: hashlib.sha512(t.encode()).hexdigest()),
    "unknown_hash": (lambda t: hashing.calculate_hash(t, "crc"), lambda t: hashlib.sha256(t.encode()).hexdigest()),
    "similarity_hash": (hashing.similarity_hash, lambda t: hashlib.sha256(t.encode() if len(t) < 3 else "".join(hashlib.md5(t[i : i + 3].encode()).hexdigest() for i in range(len(t) - 2)).encode()).hexdigest()),
}


@pytest.mark.parametrize("name", CASES)
def test_against_python(one, name):
    make, plain = CASES[name]
    own = texts()
    for t, got in zip(own, one(make, own)):
        assert got == plain(t), (name, t)


@pytest.mark.parametrize("name", CASES)
def test_null_stays_null(one, name):
    assert one(CASES[name][0], [None]) == [None]


def test_structural_hash(one):
    def plain(t):
        ls = t.splitlines()
        full = [x for x in ls if x.strip()]
        a = sum(map(len, ls)) / len(ls) if ls else 0
        b = sum(len(x) - len(x.lstrip()) for x in full) / len(full) if full else 0
        return hashlib.sha256(f"lines:{len(ls)},non_empty:{len(full)},avg_length:{a:.2f},avg_indent:{b:.2f}".encode()).hexdigest()

    own = [*texts(), "12345678\n" + "\n" * 7, "  a\n    bb\nccc"]
    assert one(hashing.structural_hash, own) == [plain(t) for t in own]


def test_wrap_text(one):
    long = "aa bbbb c " * 20 + "x" * 50
    got = one(lambda t: text.wrap_text(t, 20), ["short", long, "a\n" + "word " * 10])
    assert got[0] == "short"
    assert all(len(x) <= 20 for x in got[2].split("\n"))
    assert got[1].replace("\n", " ").split() == long.split()


def test_patterns(one):
    t = "see https://a.b/c?d=1 <x> mail me.x+1@host.co.uk #tag @user 12 3.5"
    assert one(text.extract_urls, [t]) == [["https://a.b/c?d=1"]]
    assert one(text.extract_emails, [t]) == [["me.x+1@host.co.uk"]]
    assert one(text.extract_hashtags, [t]) == [["#tag"]]
    assert one(text.extract_mentions, [t]) == [["@host", "@user"]]


def test_code_patterns(one):
    py = "import os, sys\nfrom a import b\ndef f(x):\n    '''d'''\n    return x  # note\nclass K:\n    \"\"\"doc\n    more\"\"\"\n"
    js = "function foo(a) { }\nconst bar = (x) => x\nclass Baz {}\nimport {q} from 'mod'\n/* c */\n"
    java = "import java.util.List;\npublic class A {\n  public static int go(int x) throws E {\n  }\n}\n"
    got = one(lambda t: text.text_patterns(t, F.col("language")), [py, js, java, "x"], language=["python", "javascript", "java", "go"])
    assert got[0]["functions"] == ["f"] and got[0]["classes"] == ["K"] and got[0]["comments"] == ["# note"] and got[0]["docstrings"] == ['"""doc\n    more"""']
    assert got[1]["functions"] == ["foo"] and got[1]["arrow_functions"] == ["bar"] and got[1]["classes"] == ["Baz"] and got[1]["imports"] == ["mod"]
    assert got[2]["methods"] == ["go"] and got[2]["imports"] == ["java.util.List"] and got[2]["classes"] == ["A"]
    assert set(got[3]) == {"urls", "emails", "numbers"}


def test_readability_and_syllables(one):
    assert one(lambda t: text.syllables(t), ["table", "making", "the", "apple", "x", "banana"]) == [1, 1, 1, 1, 1, 3]
    r = one(text.readability, ["The cat sat. It ran away!", "", "..."])
    assert (r[0]["sentences"], r[0]["words"]) == (2, 6)
    assert r[0]["flesch"] == pytest.approx(min(100, 206.835 - 1.015 * 3 - 84.6 * r[0]["syllables"] / 6))
    assert (r[1]["flesch"], r[1]["fk"], r[2]["flesch"]) == (0, 0, 0)


def test_syllables_of_a_text_are_those_of_its_words(one):
    r = random.Random(8)
    parts = ["e", "es", "ed", "ing", "a", "u", "b", "t", "the", "E", "ES", " ", " ", "-", "1", "_", "é", "İ", "y", "\n", "'s", "eee", "bre", "ae"]
    own = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(1500)] + ["x" * 30_000 + "e", "ae" * 20_000, ""]
    want = one(lambda t: F.aggregate(text.extract_words(t), F.lit(0).cast("long"), lambda a, w: a + text.syllables(w)), own)
    assert one(text.syllable_total, own) == want


def test_keywords_tie_by_first(one):
    got = one(lambda t: text.extract_keywords(t, 2), ["zeta alpha zeta beta alpha beta the the the", "", None])
    assert [(p["word"], p["count"]) for p in got[0]] == [("zeta", 2), ("alpha", 2)]
    assert got[1:] == [[], None]
    s = one(text.keyword_stats, ["foo Foo bar_1 is 9x"])[0]
    assert (s["unique_words"], s["total_words"]) == (2, 4) and s["top_words"][0]["word"] == "foo"


def test_detect_language(one):
    assert one(text.detect_language, ["", "plain", "中文字符", "ひらがな", "한국어", "привет", "abc", None]) == ["unknown", "english", "chinese", "japanese", "korean", "russian", "english", None]


def test_encoding_and_basic_stats(one):
    e = one(text.encoding_info, ["abc", "é", "\ufeffx"])
    assert [(x["is_ascii"], x["has_bom"]) for x in e] == [(True, False), (False, False), (False, True)]
    b = one(text.basic_stats, ["ab cd\n\nx", ""])
    assert (b[0]["total_lines"], b[0]["non_empty_lines"], b[0]["total_words"], b[0]["longest_line"], b[0]["shortest_line"]) == (3, 2, 3, 5, 0)
    assert b[1]["longest_line"] == 0 and b[1]["average_word_length"] == 0


def test_clean_text(one):
    assert one(text.clean_text, ["a\x00\x07b  c\r\nd \x7f"]) == ["ab c d"]


def test_counts_of_a_text_are_those_of_its_parts(one):
    r = random.Random(9)
    own = [None, *texts(), *["".join(r.choice([*PIECES, "!", "?", "es", "ing", "É"]) for _ in range(r.randrange(40))) for _ in range(300)], "a. b" * 600_000, "c"]
    read, lines = one(text._reading_counts, own), one(text.line_counts, own)
    assert [x and x["sentences"] for x in read] == [None if t is None else sum(bool(s.strip()) for s in re.split("[.!?]+", t)) for t in own]
    assert [x and x["words"] for x in read] == [None if t is None else len(re.findall(r"\w+", t)) for t in own]
    assert [x and (x["all"], x["full"]) for x in lines] == [None if t is None else (len(t.splitlines()), sum(bool(x.strip()) for x in t.splitlines())) for t in own]


def test_wrap_text_is_plain_filling(one):
    def plain(line, width):
        if len(line) <= width:
            return [line]
        out, now = [], ""
        for word in line.split():
            if now and len(now) + len(word) > width:
                out.append(now.rstrip())
                now = ""
            now += word + " "
        return out + [now.rstrip()] if now else out

    r = random.Random(10)
    own = [None, "", " " * 30, "\n" + " " * 30 + "\na", *["".join(r.choice([*PIECES, "x" * r.randrange(1, 14), " "]) for _ in range(r.randrange(60))) for _ in range(300)]]
    for width in (1, 12):
        assert one(lambda t: text.wrap_text(t, width), own) == [None if t is None else "\n".join(x for line in t.splitlines() for x in plain(line, width)) for t in own]


def test_functions_by_parts_see_no_more_than_a_part(monkeypatch):
    import pyarrow as pa

    from loamsift.functions import arrow

    monkeypatch.setattr(arrow, "PART", 20)
    seen = []

    @arrow.by_parts
    def f(texts, other):
        seen.append((len(texts), texts.nbytes and sum(len(t or "") for t in texts.to_pylist())))
        return pa.array([None if t is None else t + str(x) for t, x in zip(texts.to_pylist(), other.to_pylist())], pa.string())

    own = ["a" * 7, None, "b" * 50, "", "c" * 9, "d" * 9, "e" * 9, None]
    assert f(pa.array(["z", *own]).slice(1), pa.array(range(8))).to_pylist() == [None if t is None else t + str(i) for i, t in enumerate(own)]
    assert len(seen) > 2 and all(n == 1 or size <= 20 for n, size in seen)
