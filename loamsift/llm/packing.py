"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

Bins are filled one after another: of the examples that fit, the one whose demand has the largest dot product with the
room left (each dimension in shares of its limit, weighted by its scarcity) goes in next. Packing runs in shards of bounded
total, drawn by the hash of the example, so that it spreads over executors and every shard is filled equally well.

Within a shard, examples of equal demand wait in one line, of which only the first is looked at: the work is examples times
different demands, and 2^20 tokens have room for some 10 000 different demands at most (1 450 where all tokens bear loss).

Defined results. Null ids: left out. Null texts and roles: no tokens, and no loss. Examples without tokens: left out.
Examples beyond a limit: cut to pieces that keep it, so every token is placed once; a piece tells where it starts. Turns of
one number: in order of role and text. Repeated rows of `turns`: each is a turn. Ties: the least example id first. Empty
tables give no bins. Ids are of any type that has an order. Other columns are not read. Limits below 1 are an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, id_type, materialize, typed_id

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this family cut text to pieces first.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 16, 3072
SHARD_TOKENS = 1 << 20


def bins_type(example_id: str = "bigint") -> str:
    return f"bin_id long, tokens long, segments long, loss_tokens long, members array<struct<example_id:{example_id},start:long,tokens:long,loss_tokens:long>>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each text, by the vocabulary file at path, which every executor must have."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = tokenizer(path).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def pieces(turns: Iterable[tuple[int, bool]], max_tokens: int, max_loss: int) -> list[tuple[int, int, int]]:
    """(start, tokens, loss) of the pieces of an example; a piece ends where either limit is reached."""
    out, start, n, loss = [], 0, 0, 0
    for tokens, bears in turns:
        while tokens:
            take = min(tokens, max_tokens - n, max_loss - loss if bears else tokens)
            n, loss, tokens = n + take, loss + take * bears, tokens - take
            if tokens:
                out.append((start, n, loss))
                start, n, loss = start + n, 0, 0
    if n:
        out.append((start, n, loss))
    return out


def pack_vectors(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of row numbers. demand: a row for each example, within the limits. Ties: the first row."""
    if not len(demand):
        return []
    share = demand / limits
    weight = share.sum(0) / max(1e-12, share.sum())
    _, own, line = np.unique(demand, axis=0, return_index=True, return_inverse=True)
    rows = np.argsort(line.ravel(), kind="stable")  # each line's rows in order, one line after another
    end = np.cumsum(np.bincount(line.ravel(), minlength=len(own)))
    head = np.append(0, end[:-1])
    now, first = share[own], rows[head]
    bins = []
    while len(now):
        room, chosen, over = np.ones(len(limits)), [], False
        can = now.copy()  # of lines that are used up: beyond any room
        while True:
            fits = (can <= room + 1e-12).all(1)
            if not fits.any():
                break
            value = np.where(fits, (now * (weight * room)).sum(1), -1.0)
            best = np.flatnonzero(value == value.max())
            k = int(best[first[best].argmin()])
            chosen.append(int(first[k]))
            room = room - now[k]
            head[k] += 1
            if head[k] == end[k]:
                can[k], over = np.inf, True
            else:
                first[k] = rows[head[k]]
        bins.append(chosen)
        if over:
            left = head < end
            now, first, head, end = now[left], first[left], head[left], end[left]
    return bins


def pack(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """examples: (example_id, turns array<struct<n:long,loss:boolean>>), one row for each example. The columns are bins_type()."""
    if min(max_tokens, max_segments, max_loss, shard_tokens) < 1:
        raise ValueError("limits must be 1 or more")
    spark = examples.sparkSession
    own = examples.where("example_id is not null")
    total = own.agg(F.sum(F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["n"]))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    limits = np.array([max_tokens, max_segments, max_loss], float)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("example_id")
        shard = table["shard"][0].as_py()
        kind = pa.list_(pa.struct([("example_id", table["example_id"].type), *((k, pa.int64()) for k in ("start", "tokens", "loss_tokens"))]))
        rows = []
        for e, turns in zip(table["example_id"].to_pylist(), table["turns"].to_pylist()):
            rows += [(e, *p) for p in pieces([(t["n"], t["loss"]) for t in turns], max_tokens, max_loss)]
        demand = np.array([(r[2], 1, r[3]) for r in rows], float).reshape(-1, 3)
        out = {k: [] for k in ("bin_id", "tokens", "segments", "loss_tokens", "members")}
        for i, own in enumerate(pack_vectors(demand, limits)):
            m = [rows[j] for j in own]
            for k, v in (("bin_id", (shard << 32) + i), ("tokens", sum(r[2] for r in m)), ("segments", len(m)), ("loss_tokens", sum(r[3] for r in m)), ("members", [dict(zip(("example_id", "start", "tokens", "loss_tokens"), r)) for r in m])):
                out[k].append(v)
        return pa.table({k: pa.array(v, kind if k == "members" else pa.int64()) for k, v in out.items()})

    spread = min(shards, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a number of its own: a shard is few bytes but much work, so tasks aren't to be joined by their size
    sharded = own.select("example_id", "turns", F.pmod(F.xxhash64("example_id"), F.lit(shards)).alias("shard")).repartition(spread, "shard")
    return sharded.groupBy("shard").applyInArrow(run, bins_type(id_type(examples, "example_id")))


def conversation_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",), path: str = TOKENIZER) -> DataFrame:
    """(example_id, turns) with the loss on the tokens of loss_roles. Only counts are shuffled, not texts."""
    text, role = col(turns, text_col).cast("string"), F.coalesce(col(turns, role_col), F.lit(""))
    counted = turns.select(typed_id(turns, id_col).alias("example_id"), col(turns, turn_col).alias("turn"), role.alias("role"), F.xxhash64(text).alias("h"), count_tokens(text, path).alias("n"))
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "h", "n")))
    out = counted.where("example_id is not null").groupBy("example_id").agg(order.alias("turns"))
    return out.select("example_id", F.transform("turns", lambda t: F.struct(t["n"].alias("n"), t["role"].isin(*loss_roles).alias("loss"))).alias("turns"))


def document_examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(example_id, turns): every token of a document bears loss. Rows of one doc_id follow each other."""
    text = col(docs, text_col).cast("string")
    counted = docs.select(typed_id(docs, id_col).alias("example_id"), F.xxhash64(text).alias("h"), count_tokens(text, path).alias("n"))
    out = counted.where("example_id is not null").groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("turns"))
    return out.select("example_id", F.transform("turns", lambda t: F.struct(t["n"].alias("n"), F.lit(True).alias("loss"))).alias("turns"))


def pack_conversations(turns: DataFrame, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, **columns) -> DataFrame:
    """Bins of conversations, see pack()."""
    return pack(materialize(conversation_examples(turns, path=path, **columns), "examples"), max_tokens, max_segments, max_loss)


def pack_documents(docs: DataFrame, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, **columns) -> DataFrame:
    """Bins of documents, all of whose tokens bear loss."""
    return pack(materialize(document_examples(docs, path=path, **columns), "examples"), max_tokens, max_segments, max_tokens)
