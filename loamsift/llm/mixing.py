"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed once by cell (source, language, topic); raking scales the cells until every marginal meets its
targets; the ratio of a cell's raked weight to its tokens, scaled so that the expected sample has the wanted size, is the
probability of its documents. Categories without a target of their own share the target of `OTHER`, so the cells that reach
the driver are at most as many as the targets have combinations, however large the corpus.

Tokens are whatever column `tokens` gives, such as a tokenizer's count (the pipeline takes that of packing); by default an
estimate that needs no tokenizer and treats all scripts alike, a token for each four bytes. The topic is a column of the table
(`topic_col`); a table without one is mixed by the form of its texts (tabular, shouted, symbolic, long, prose).

Defined results. Null source, language or topic: the category OTHER. Null and empty texts: no tokens, probability 0, not kept.
Repeated rows: each counts, and rows of one doc_id are kept or left together. Null doc_id: drawn as the name 'null'. Targets
of categories that the table lacks are spread over the others in proportion. Categories that have no target, neither of their
own nor of OTHER: probability 0, and what else has only them to meet its targets leaves its share to the rest. Targets must be
finite and not negative; if no target is left to be met, nothing is kept. Targets that contradict each other are met as near
as ROUNDS rounds come. Cells that would need a probability above 1 are kept whole and the rest made up elsewhere. An empty
table gives an empty one. Ids may be of any type. Columns whose names clash with working names are untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, materialize

OTHER = "__other__"
SOURCES = {f"src{i}": 1.0 for i in range(20)} | {OTHER: 0.2}
LANGUAGES = {"en": 0.55, "fr": 0.2, "de": 0.15, "es": 0.1, OTHER: 0.01}
TOPICS = {"prose": 0.6, "long": 0.25, "tabular": 0.05, "shouted": 0.05, "symbolic": 0.05, OTHER: 0.01}
#: Rounds at most; raking stops when no marginal is further than TOLERANCE from its targets.
BUDGET, ROUNDS, TOLERANCE, SEED = 0.3, 60, 1e-11, 7
BYTES_PER_TOKEN, LONG_BYTES = 4, 6000
#: form -> what shows it, in syntax that Java and RE2 read alike: three delimiters in a line, three words in capitals in a row,
#: three runs of signs near each other.
FORMS = {
    "tabular": r"(?:[|\t][^|\t\n]{0,80}){3}",
    "shouted": r"[A-Z]{2,}[^a-zA-Z]{1,4}[A-Z]{2,}[^a-zA-Z]{1,4}[A-Z]{2,}",
    "symbolic": r"[#$%&*+=@^~]{3}[^#$%&*+=@^~\n]{1,40}[#$%&*+=@^~]{3}[^#$%&*+=@^~\n]{1,40}[#$%&*+=@^~]{3}",
}


def n_tokens(text: Column) -> Column:
    """An estimate by size."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / float(BYTES_PER_TOKEN)).cast("long")


def form_of(text: Column) -> Column:
    """The form of a text; null for null."""
    out = None
    for name, pattern in FORMS.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.when(text.isNotNull(), out.when(F.octet_length(text) >= LONG_BYTES, "long").otherwise("prose"))


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells after scaling each marginal to its targets until all agree. members: each cell's category by
    dimension. Targets of a category without weight are spread over the others in proportion; all weights are 0 if none is left."""
    w = tokens.astype(float) / max(1e-300, tokens.sum())
    for _ in range(rounds):
        off = 0.0
        for m, t in zip(members, targets):
            have = np.bincount(m, w, len(t))
            want = np.where(have > 0, t, 0)
            if not want.sum() > 0:
                return np.zeros(len(w))
            want = want / want.sum()
            off = max(off, np.abs(have - want).max())
            w = w * (want / np.where(have > 0, have, 1))[m]
        if off <= tolerance:
            break
    return w


def rate(tokens: np.ndarray, ratio: np.ndarray, budget: float) -> float:
    """x so that sum(min(1, x * ratio) * tokens) is budget; where even all cells of some ratio fall short, one that keeps them whole."""
    tokens, ratio = tokens[ratio > 0], ratio[ratio > 0]
    if not len(ratio):
        return 0.0
    order = np.argsort(-ratio, kind="stable")
    t, r = tokens[order].astype(float), ratio[order]
    full = np.concatenate([[0], np.cumsum(t)])
    rest = np.concatenate([np.cumsum((r * t)[::-1])[::-1], [0]])
    for j in range(len(t)):
        x = (budget - full[j]) / rest[j]
        if x * r[j] <= 1:
            return x
    return 1 / r[-1]


def _group(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*[k for k in targets if k != OTHER]), value).otherwise(F.lit(OTHER))


def probabilities(cells: list[tuple[str, str, str, int]], targets: list[dict[str, float]], budget: float = BUDGET, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[str, str, str, float]]:
    """The sampling probability of each cell (three categories, tokens above 0)."""
    for want in targets:
        if not all(np.isfinite(v) and v >= 0 for v in want.values()):
            raise ValueError(f"targets must be finite and not negative: {want}")
    if not cells:
        return []
    cells = sorted(cells)
    t = np.array([c[3] for c in cells], float)
    members, goals = [], []
    for d, want in enumerate(targets):
        names, m = np.unique([c[d] for c in cells], return_inverse=True)
        goal = np.array([want.get(str(x), 0.0) for x in names])
        members.append(m)
        goals.append(goal)
    r = rake(t, members, goals, rounds, tolerance) / t
    p = np.minimum(1, rate(t, r, budget * t.sum()) * r)
    assert np.isfinite(p).all()
    return [(*c[:3], float(x)) for c, x in zip(cells, p)]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokens: Column | None = None, source_targets: dict[str, float] = SOURCES, lang_targets: dict[str, float] = LANGUAGES, topic_targets: dict[str, float] = TOPICS, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED, slim: bool = False) -> tuple[DataFrame, list[str], Column]:
    """The input with working columns (source, language and topic group, probability), their names, and the decision.

    slim: only the id, the working columns and the tokens, from a written table. Otherwise tokens are counted once, for the
    sums, and the second pass only looks for the cell of each row.
    """
    spark, targets = docs.sparkSession, [source_targets, lang_targets, topic_targets]
    text = col(docs, text_col).cast("string")
    names = [fresh(docs, n) for n in ("_source", "_lang", "_topic", "_p", "_tokens", "_some")]
    topic = form_of(text) if topic_col is None else col(docs, topic_col).cast("string")
    some = F.coalesce(F.octet_length(text) > 0, F.lit(False))
    count = F.when(some, F.coalesce(n_tokens(text) if tokens is None else tokens.cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    placed = docs.withColumns({names[0]: _group(col(docs, source_col).cast("string"), source_targets), names[1]: _group(col(docs, lang_col).cast("string"), lang_targets), names[2]: _group(topic, topic_targets), names[5]: some})
    counted = placed.withColumn(names[4], count)
    if slim:
        placed = counted = materialize(counted.select(col(counted, id_col), *names[:3], *names[4:]), "mixture")
    cells = counted.groupBy(*names[:3]).agg(F.sum(names[4])).collect()  # at most one for each combination of targets
    p = spark.createDataFrame(probabilities([tuple(c) for c in cells if c[3]], targets, budget, rounds), ", ".join(f"c{i} string" for i in range(3)) + ", p double")
    p = F.broadcast(p.select(*[F.col(f"c{i}").alias(fresh(placed, f"_c{i}")) for i in range(3)], F.col("p").alias(names[3])))
    match = [F.col(names[i]) == F.col(p.columns[i]) for i in range(3)]
    out = placed.join(p, match[0] & match[1] & match[2], "left").drop(*p.columns[:3])
    out = out.withColumn(names[3], F.when(F.col(names[5]), F.coalesce(names[3], F.lit(0.0))).otherwise(0.0))
    key = F.concat(F.coalesce(col(out, id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return out, names, draw < F.col(names[3])


def mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, source_group, lang_group, topic_group, tokens, probability, kept of every row. The texts are read once."""
    out, n, kept = mix(docs, id_col, slim=True, **options)
    return out.select(col(out, id_col).alias("doc_id"), F.col(n[0]).alias("source_group"), F.col(n[1]).alias("lang_group"), F.col(n[2]).alias("topic_group"), F.col(n[4]).alias("tokens"), F.round(n[3], 6).alias("probability"), kept.alias("kept"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows, with the input's columns."""
    out, n, kept = mix(docs, **options)
    return out.where(kept).drop(*n)


def _sql(rounds: int = ROUNDS) -> str:
    lists = [", ".join(f"('{k}', {v}::DOUBLE)" for k, v in t.items()) for t in (SOURCES, LANGUAGES, TOPICS)]
    names = [", ".join(f"'{k}'" for k in t if k != OTHER) for t in (SOURCES, LANGUAGES, TOPICS)]
    forms = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in FORMS.items())
    sql = f"""WITH named AS (SELECT doc_id, ceil(coalesce(strlen(text), 0) / {BYTES_PER_TOKEN}.0)::BIGINT AS tokens, source, lang, CASE {forms} WHEN strlen(text) >= {LONG_BYTES} THEN 'long' WHEN text IS NOT NULL THEN 'prose' END AS topic FROM documents),
grouped AS (SELECT doc_id, tokens, CASE WHEN source IN ({names[0]}) THEN source ELSE '{OTHER}' END AS g0, CASE WHEN lang IN ({names[1]}) THEN lang ELSE '{OTHER}' END AS g1, CASE WHEN topic IN ({names[2]}) THEN topic ELSE '{OTHER}' END AS g2 FROM named),
cells AS MATERIALIZED (SELECT g0, g1, g2, sum(tokens)::DOUBLE AS t FROM grouped WHERE tokens > 0 GROUP BY ALL)"""
    for d in range(3):
        sql += f",\ngoal{d} AS MATERIALIZED (SELECT k AS g{d}, v / sum(v) OVER () AS goal{d} FROM (VALUES {lists[d]}) x(k, v) WHERE k IN (SELECT g{d} FROM cells))"
    sql += ",\nw0 AS (SELECT g0, g1, g2, t, t / sum(t) OVER () AS w, goal0, goal1, goal2 FROM cells JOIN goal0 USING (g0) JOIN goal1 USING (g1) JOIN goal2 USING (g2))"
    last = rounds * 3
    for i in range(last):
        sql += f",\nw{i + 1} AS MATERIALIZED (SELECT * REPLACE (w * goal{i % 3} / sum(w) OVER (PARTITION BY g{i % 3}) AS w) FROM w{i})"
    sql += f""",
ratio AS MATERIALIZED (SELECT g0, g1, g2, t, w / t AS r FROM w{last}),
ranked AS (SELECT *, coalesce(sum(t) OVER (ORDER BY r DESC, g0, g1, g2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(r * t) OVER (ORDER BY r DESC, g0, g1, g2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(t) OVER () AS total FROM ratio),
factor AS (SELECT x FROM (SELECT ({BUDGET} * total - before) / rest AS x, r FROM ranked) WHERE x * r <= 1 ORDER BY r DESC LIMIT 1)
SELECT doc_id, g0 AS source_group, g1 AS lang_group, g2 AS topic_group, tokens, round(CASE WHEN tokens > 0 THEN least(1, x * r) ELSE 0 END, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < CASE WHEN tokens > 0 THEN least(1, x * r) ELSE 0 END AS kept
FROM grouped LEFT JOIN ratio USING (g0, g1, g2), factor"""
    return sql


SQL = _sql()
