"""Secret scan with corpus-wide ownership frequency.

Every candidate's hash is aggregated over the whole corpus by distinct repositories and owners. A value that many owners
carry was copied from documentation or a template; one that a single owner has, in varied characters, looks live.

Verdicts: `example` (at least `example_owners` owners, or too few different characters for a real key), `shared` (several
owners, fewer than that), `live` (one owner).

Defined results. Null and empty texts hold no candidate. A null owner or repository counts as the empty name. Repeated rows
add to the occurrences of their doc_id, not to its distinct owners; rows with a null doc_id are one group. Candidates that
several kinds match are reported under each. Empty tables give no rows. Very long texts are scanned whole. Columns other than
the named ones are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, materialize

EXAMPLE_OWNERS, LEAST_DISTINCT = 3, 6
_KEYS = ("password", "passwd", "passphrase", "secret", "token", "api[_-]?key", "access[_-]?key", "private[_-]?key", "secret[_-]?key", "auth[_-]?key")

#: In whatever case and spelling of _KEYS, one of these is part of the key.
_KEY_PARTS = ["passw", "passphrase", "secret", "token", "key"]

#: kind -> (pattern whose group 1 is the secret, groups of strings: a text with a match holds one of each group). Only syntax
#: that Java and RE2 read alike.
KINDS: dict[str, tuple[str, list[list[str]]]] = {
    "aws_access_key": (r"(?:^|[^A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})", [["AKIA", "ASIA"]]),
    "forge_token": (r"(?:^|[^A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36})", [["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]]),
    "chat_token": (r"(?:^|[^A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})", [["xox"]]),
    "maps_key": (r"(?:^|[^A-Za-z0-9])(AIza[0-9A-Za-z_-]{35})", [["AIza"]]),
    "web_token": (r"(?:^|[^A-Za-z0-9])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", [["eyJ"]]),
    "private_key": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*)", [["PRIVATE KEY-----"]]),
    "assignment": (r"(?i:" + "|".join(_KEYS) + r")[\"']?[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9+/_-]{12,})", [["=", ":"], _KEY_PARTS]),
}


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret"))


def _hit(text: Column, hints: list[list[str]]) -> Column:
    found = lambda t, own: reduce(lambda a, b: a | b, [F.contains(t, F.lit(h)) for h in own])
    return reduce(lambda a, b: a & b, [F.get(F.transform(F.array(F.lower(text)), lambda t: found(t, own)), F.lit(0)) if own is _KEY_PARTS else found(text, own) for own in hints])


def may_hold(text: Column) -> Column:
    """Whether a text holds the fixed strings that some kind of candidate needs."""
    return F.coalesce(reduce(lambda a, b: a | b, [_hit(text, hints) for _, hints in KINDS.values()]), F.lit(False))


def candidates(text: Column) -> Column:
    """array<struct<kind,secret>> of a text, repeats included. A search for fixed strings spares most texts the patterns."""
    none = F.array().cast("array<string>")
    found = []
    for kind, (pattern, hints) in KINDS.items():
        secrets = F.when(_hit(text, hints), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(none)
        found.append(F.transform(secrets, _named(kind)))
    return F.concat(*found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS, least_distinct: int = LEAST_DISTINCT, with_secret: bool = False) -> DataFrame:
    """doc_id, kind, secret_hash, occurrences, n_docs, n_repos, n_owners, verdict: a row for each document and secret."""
    owner = F.coalesce(col(docs, owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(col(docs, c).cast("string"), F.lit("")) for c in repo_cols])
    own = docs.select(col(docs, id_col).alias("doc_id"), owner.alias("owner"), repo.alias("repo"), F.explode(candidates(col(docs, text_col).cast("string"))).alias("c"))
    hit = own.groupBy("doc_id", "owner", "repo", "c.kind", "c.secret").agg(F.count("*").alias("occurrences"))
    # written down: both aggregates below read the few findings, and the texts are scanned once
    hit = materialize(hit.select("doc_id", "owner", "repo", "kind", "secret", F.sha2("secret", 256).alias("secret_hash"), "occurrences"), "findings")
    per = hit.groupBy("kind", "secret_hash").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    doc = hit.groupBy("doc_id", "kind", "secret_hash").agg(F.first("secret").alias("secret"), F.sum("occurrences").alias("occurrences"))
    plain = F.size(F.array_distinct(F.split("secret", ""))) < least_distinct
    verdict = F.when(plain | (F.col("n_owners") >= example_owners), "example").when(F.col("n_owners") > 1, "shared").otherwise("live")
    out = doc.join(per, ["kind", "secret_hash"])
    return out.select("doc_id", "kind", "secret_hash", "occurrences", "n_docs", "n_repos", "n_owners", verdict.alias("verdict"), *(["secret"] if with_secret else []))


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, with each live-looking secret in a text replaced by <SECRET:kind>.

    Only documents that may hold a candidate are shuffled, by fixed strings; all others pass straight through, so the patterns
    run once over each text. n_chars, if there is one, follows.
    """
    text, has = col(docs, text_col), fresh(docs, "_candidates")
    marked = docs.withColumn(has, may_hold(text.cast("string")))
    live = scan(docs, id_col, text_col, with_secret=True, **options).where("verdict = 'live'")
    k, lives = fresh(docs, "_secret_id"), fresh(docs, "_lives")
    # longest first, so that a secret within another one doesn't break it up
    per_doc = live.groupBy(F.col("doc_id").alias(k)).agg(F.sort_array(F.collect_list(F.struct(F.length("secret").alias("n"), "secret", "kind")), asc=False).alias(lives))
    touched = marked.where(F.col(has)).join(per_doc, col(marked, id_col).eqNullSafe(F.col(k)), "left")
    cleaned = F.aggregate(F.coalesce(lives, F.array().cast("array<struct<n:int,secret:string,kind:string>>")), col(touched, text_col), lambda t, s: F.replace(t, s["secret"], F.concat(F.lit("<SECRET:"), s["kind"], F.lit(">"))))
    out = touched.withColumn(text_col, cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(col(out, text_col)).cast(docs.schema["n_chars"].dataType))
    return marked.where(~F.col(has)).drop(has).unionByName(out.select(*[col(out, c) for c in docs.columns]))


def _sql() -> str:
    parts = []
    for kind, (pattern, _) in KINDS.items():
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS secret FROM documents")
    return f"""WITH hit AS ({" UNION ALL ".join(parts)}),
per AS (SELECT kind, secret, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repo) AS n_repos, count(DISTINCT owner) AS n_owners FROM hit GROUP BY ALL),
doc AS (SELECT doc_id, kind, secret, count(*) AS occurrences FROM hit GROUP BY ALL)
SELECT doc_id, kind, sha256(secret) AS secret_hash, occurrences, n_docs, n_repos, n_owners,
  CASE WHEN len(list_distinct(string_split(secret, ''))) < {LEAST_DISTINCT} OR n_owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN n_owners > 1 THEN 'shared' ELSE 'live' END AS verdict
FROM doc JOIN per USING (kind, secret)"""


SQL = _sql()
