"""Personal data by a linear-chain conditional random field over word-shape features.

Words are runs of anything but white space; their features are hashed shapes (runs of upper case, lower case, digits, and
punctuation as it stands), lengths and counts, of the word and its neighbours. The field is trained on a small labelled
table by gradient ascent, and decoded by Viterbi over whole lines in numpy: lines of one batch advance together, word by
word, the longest first, so none is cut or padded.

Defined results. Null and empty texts: no span. Null doc_id: spans with a null doc_id. Ids are of any type. Repeated rows:
each gives its spans. Ties between taggings: the lower tag number. Lines of any length are decoded whole. A span never crosses
a line feed. Empty tables give no rows; an empty training table gives a field that tags nothing. In a training table, unknown
tags count as O, and sentences of any length are learnt whole. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import codepoints, exploded_id, id_type, range_hashes, slices, space_table, words

TAGS = ("O", "B-EMAIL", "B-PHONE", "I-PHONE", "B-IP", "B-CARD", "I-CARD", "B-ID")
N_FEATURES, SLOTS = 8, 1 << 14
MAX_TRAINING_ROWS = 200_000
#: Signs that are taken off the end of a word, however many; one character always stays.
OUTER = ",.;:!?\"'%&#$*|"


@lru_cache(maxsize=1)
def shape_table() -> np.ndarray:
    """1 upper case, 2 other letters, 3 digits, 4 other signs beyond ASCII, and ASCII signs by their own code."""
    out = np.full(0x110000, 4, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        out[c] = 1 if ch.isupper() else 2 if ch.isalpha() else 3 if ch.isdigit() else c if 32 < c < 127 else 4
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(code points, where texts begin, word starts, word ends, line number of each word); words without outer punctuation."""
    cp, offsets = codepoints(texts)
    starts, ends = words(cp, ~space_table()[cp])
    line = np.cumsum(cp == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    outer = np.zeros(0x110000, bool)
    outer[[ord(c) for c in OUTER]] = True
    if len(starts):
        inner = np.maximum.accumulate(np.where(outer[cp], -1, np.arange(len(cp))))  # the last place up to here that isn't such a sign
        ends = np.maximum(starts, inner[ends - 1]) + 1
    starts = starts + (np.isin(cp[starts], [ord(c) for c in "\"'"]) & (ends - starts > 1))
    return cp, offsets, starts, ends, line


def features(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
    """N_FEATURES slots of the weight table for each word."""
    c = shape_table()[cp]
    inside = np.zeros(len(c) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    new = np.append(True, c[1:] != c[:-1])
    new[starts] = True
    run = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    out = np.empty((len(starts), N_FEATURES), np.uint64)
    for f, keep in enumerate((new, run < 4)):
        at = np.concatenate([[0], np.cumsum(keep)])
        out[:, f] = range_hashes(c[keep], at[starts], at[ends])

    def count(flags, most):
        s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.minimum(most, s[ends] - s[starts]).astype(np.uint64)

    length = np.minimum(24, ends - starts).astype(np.uint64)
    kind = (count(c == 3, 20) * np.uint64(32) + count(cp == 46, 4)) * np.uint64(4) + count(cp == 64, 2)
    out[:, 2], out[:, 3] = length, kind
    for f, own in ((4, 0), (6, 3)):
        out[:, f : f + 2] = 1
        if len(starts) > 1:
            joined = line[1:] == line[:-1]
            out[1:, f] = np.where(joined, out[:-1, own], 1)
            out[:-1, f + 1] = np.where(joined, out[1:, own], 1)
    salt = (np.arange(1, N_FEATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    x = (out ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return ((x * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(50)).astype(np.int64)


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # SLOTS x tags
    moves: np.ndarray  # tag to tag
    begin: np.ndarray

    def emissions(self, f: np.ndarray) -> np.ndarray:
        e = self.weights[f[:, 0]].copy()
        for i in range(1, N_FEATURES):
            e += self.weights[f[:, i]]
        return e


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Which tags may follow which, and begin a line."""
    begin = np.array([not t.startswith("I-") for t in TAGS])
    move = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in TAGS] for a in TAGS])
    return move, begin


def viterbi(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best tags of all words. e: words x tags, the sequences one after another with the given lengths."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    ls = lengths[order]
    if not len(ls) or not ls[0]:
        return np.zeros(0, np.int64)
    active = len(ls) - np.searchsorted(ls[::-1], np.arange(ls[0]), "right")
    back = np.zeros(e.shape, np.uint8)
    score = e[first[: active[0]]] + begin
    final = np.zeros(len(ls), np.int64)
    into = np.ascontiguousarray(moves.T)
    for t in range(1, ls[0]):
        k = active[t]
        if k < len(score):
            final[k : len(score)] = score[k:].argmax(1)
            score = score[:k]
        at = first[:k] + t
        if k < 64:
            step = score[:, None, :] + into[None]
            back[at] = b = step.argmax(2)
            score = np.take_along_axis(step, b[:, :, None], 2)[:, :, 0] + e[at]
        else:
            best = score[:, :1] + moves[0]
            b = np.zeros(best.shape, np.uint8)
            for j in range(1, len(moves)):
                other = score[:, j : j + 1] + moves[j]
                b[other > best] = j
                np.maximum(best, other, out=best)
            back[at] = b
            score = best + e[at]
    final[: len(score)] = score.argmax(1)
    tags = np.empty(len(e), np.int64)
    now = np.empty(0, np.int64)
    for t in range(ls[0] - 1, -1, -1):
        k = active[t]
        if k > len(now):
            now = np.concatenate([now, final[len(now) : k]])
        at = first[:k] + t
        tags[at] = now
        now = back[at, now].astype(np.int64)
    return tags


def labelled_sentences(n: int = 900, seed: int = 5) -> list[tuple[int, int, str, str]]:
    """The small labelled table: (sentence, position, word, tag). Made-up prose with made-up personal data and look-alikes."""
    r = np.random.default_rng(seed)
    syllables = ["an", "der", "ti", "re", "in", "on", "é", "ç", "ü", "que", "sch", "th", "la", "mo", "ñ", "ß", "er", "es"]
    pick = lambda x: x[int(r.integers(len(x)))]
    digits = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    name = lambda: "".join(pick("abcdefghiklmnoprstu") for _ in range(int(r.integers(2, 9))))

    def plain():
        w = "".join(pick(syllables) for _ in range(int(r.integers(1, 5))))
        u = r.random()
        w = w.capitalize() if u < 0.12 else w.upper() + "!!" if u < 0.16 else w + pick(["%%%", "&&&", "###", "***", "$$$"]) if u < 0.2 else "|" if u < 0.23 else w
        return [(w + pick([",", ".", "", "", "", "", ""]), "O")]

    def near():
        h = "".join(pick("0123456789abcdef") for _ in range(40))
        return [(w, "O") for w in pick([[digits(int(r.integers(1, 6)))], [str(r.integers(1900, 2100))], [f"v{r.integers(9)}.{r.integers(20)}.{r.integers(9)}"], ["version", f"{r.integers(9)}.{r.integers(9)}."], ["token", "=", f'"{h}"'], ["password=" + h[:18]], ["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))], [f"{r.integers(1, 32)}/{r.integers(1, 13)}/{r.integers(1950, 2030)}"], [f"{r.integers(24)}:{digits(2)}"], ["@" + name()], ["https://" + name() + ".example.com/" + name()], ["CC", "BY-NC", "4.0."], [f"{digits(3)}-{digits(2)}"], [f"(c{name()})"], [f"{digits(2)}.{digits(3)},{digits(2)}"], ["+" + digits(1)]])]

    def private():
        u = int(r.integers(10))
        if u < 2:
            return [(pick([f"{name()}.{digits(2)}", f"{name()}{digits(1)}", f"{name()}_{name()}", f"{name()}.{name()}", name(), name().capitalize()]) + "@" + pick([f"mail{digits(1)}.example.com", f"{name()}.org", f"{name()}.co.uk", f"{name()}-{name()}.net"]), "B-EMAIL")]
        if u < 5:
            form = pick([["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(3), digits(4)], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(11)}"], [f"+1-{digits(3)}-{digits(3)}-{digits(4)}"]])
            return [(w, "B-PHONE" if i == 0 else "I-PHONE") for i, w in enumerate(form)]
        if u < 7:
            return [(".".join(str(x) for x in r.integers(0, int(pick([12, 120, 256, 256])), 4)), "B-IP")]
        if u < 9:
            form = pick([[digits(16)], [digits(16)], [digits(15)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]])
            return [(w, "B-CARD" if i == 0 else "I-CARD") for i, w in enumerate(form)]
        return [(f"{digits(3)}-{digits(2)}-{digits(4)}", "B-ID")]

    rows = []
    for s in range(n):
        sentence: list[tuple[str, str]] = []
        for _ in range(int(r.integers(1, 13))):
            u = r.random()
            sentence += private() if u < 0.25 else near() if u < 0.35 else plain()
        w, tag = sentence[-1]
        sentence[-1] = (w + pick([".", ".", ""]), tag)
        rows += [(s, i, w, tag) for i, (w, tag) in enumerate(sentence)]
    return rows


def labelled_table(spark: SparkSession, **options) -> DataFrame:
    return spark.createDataFrame(labelled_sentences(**options), "sentence long, position int, word string, tag string")


def fit(labelled: DataFrame, rounds: int = 120, step: float = 0.1, l2: float = 1e-3, max_rows: int = MAX_TRAINING_ROWS) -> Field:
    """Train on at most max_rows words (the bound of the labelled sample), whole sentences in the order of their numbers: the
    sentence that would go beyond the bound, and those after it, are left out."""
    rows = labelled.where("word is not null and tag is not null and sentence is not null").orderBy("sentence", "position", "word").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        rows = [r for r in rows if r["sentence"] != rows[-1]["sentence"]]
    return train([(r["sentence"], r["word"], r["tag"]) for r in rows], rounds, step, l2)


def train(rows: list[tuple[int, str, str]], rounds: int = 120, step: float = 0.1, l2: float = 1e-3) -> Field:
    move, begin = allowed()
    bar = lambda ok: np.where(ok, 0.0, -1e4)
    L = len(TAGS)
    if not rows:
        w = np.zeros((SLOTS, L), np.float32)
        return Field(w, bar(move).astype(np.float32), (bar(begin) - 10.0 * (np.arange(L) > 0)).astype(np.float32))
    lines: dict[int, list[tuple[str, str]]] = {}
    for s, w, tag in rows:
        lines.setdefault(s, []).append(("".join(w.split()) or "-", tag))
    texts = [" ".join(w for w, _ in x) for x in lines.values()]
    y = np.array([TAGS.index(t) if t in TAGS else 0 for x in lines.values() for _, t in x])
    cp, _, starts, ends, line = tokens(texts)
    f = features(cp, starts, ends, line)
    n = np.array([len(x) for x in lines.values()])
    first = np.cumsum(n) - n
    # sentences advance together, the longest first, so that none is padded: at word i those of `live[i]` are still going
    order = np.argsort(-n, kind="stable")
    begin_at, ls = first[order], n[order]
    live = len(ls) - np.searchsorted(ls[::-1], np.arange(ls[0]), "right")
    sentence = np.repeat(np.arange(len(n)), n)
    gold = np.zeros((len(y), L))
    gold[np.arange(len(y)), y] = 1
    pairs = np.zeros((L, L))
    inner = np.ones(len(y), bool)
    inner[first] = False
    np.add.at(pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    begins = gold[first].sum(0)
    W, T, B = np.zeros((SLOTS, L)), np.zeros((L, L)), np.zeros(L)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (W, T, B)]
    flat = f.ravel()

    def spread(x):
        return np.stack([np.bincount(flat, np.repeat(x[:, i], N_FEATURES), SLOTS) for i in range(L)], 1)

    goal = spread(gold)

    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))

    for k in range(1, rounds + 1):
        e, t, b = W[f].sum(1), T + bar(move), B + bar(begin)
        alpha, beta = np.empty((len(y), L)), np.zeros((len(y), L))
        alpha[first] = e[first] + b
        for i in range(1, ls[0]):
            at = begin_at[: live[i]] + i
            alpha[at] = lse(alpha[at - 1][:, :, None] + t, 1) + e[at]
        for i in range(ls[0] - 1, 0, -1):
            at = begin_at[: live[i]] + i
            beta[at - 1] = lse(t[None] + (e[at] + beta[at])[:, None, :], 2)
        z = lse(alpha[first + n - 1], 1)
        p = np.exp(alpha + beta - z[sentence][:, None])
        gt = pairs.copy()
        later = np.flatnonzero(inner)
        for i in range(0, len(later), 1 << 16):
            at = later[i : i + (1 << 16)]
            gt -= np.exp(alpha[at - 1][:, :, None] + t + (e[at] + beta[at])[:, None, :] - z[sentence[at]][:, None, None]).sum(0)
        grads = (goal - spread(p), gt, begins - p[first].sum(0))
        for (v, m, s), g in zip(state, grads):
            g = g / len(n) - l2 * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += step * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8) * (np.abs(g) + np.abs(m) > 0)
    return Field(W.astype(np.float32), (T + bar(move)).astype(np.float32), (B + bar(begin)).astype(np.float32))


def spans(field: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, tag number of the begin tag) of each span, in characters."""
    cp, offsets, starts, ends, line = tokens(texts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    e = field.emissions(features(cp, starts, ends, line))
    cut = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    tags = viterbi(e, np.diff(np.append(cut, len(line))), field.moves, field.begin)
    goes_on = np.array([t.startswith("I-") for t in TAGS])[tags]
    at = np.flatnonzero((tags != 0) & ~goes_on)
    stop = np.append(np.flatnonzero(~goes_on), len(tags))
    last = stop[np.searchsorted(stop, at, "right")] - 1
    text = np.searchsorted(offsets, starts[at], "right") - 1
    return text, starts[at] - offsets[text], ends[last] - offsets[text], tags[at]


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (exclusive, in characters), label: a row for each span."""
    names = np.array([t[2:] for t in TAGS], object)

    def run(batches):
        for b in batches:
            for at, texts in slices(b["text"]):
                text, s, e, tag = spans(field, texts)
                ids = b["doc_id"].slice(at, len(texts)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(names[tag], pa.string())], ["doc_id", "start", "end", "label"])

    return exploded_id(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, start int, end int, label string")
