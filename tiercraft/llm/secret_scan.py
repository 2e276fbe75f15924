"""Secrets in texts, told from copied examples by who else in the corpus holds them.

Patterns propose candidates. The value of each is hashed and its owners are
counted over the whole corpus: the distinct owners and the distinct
repositories (an owner's documents) that hold it. A value that many owners
share was copied from some tutorial; one that is a single owner's own and looks
random is probably live. Base kinds stay whatever the verdict; candidates of the
looser added kinds count only if they are an owner's own.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, without
from tiercraft.operators.skew import join_hot
from tiercraft.session import ensure_checkpoint_dir

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "login", "pem", "blob")
KINDS = BASE_KINDS + ADDED_KINDS
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Of so many owners, or so many repositories, a value is an example that was copied around.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 100
#: Bits per character (Shannon, of the value's own characters) of a live-looking value, and of a blob.
LIVE_BITS, BLOB_BITS = 3.0, 4.0
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|change_me|placeholder|your[_-]|x{4}|test[_-]|12345678|abcdefgh",
                         re.IGNORECASE | re.ASCII)
#: A value found so often, and in a thousandth of all findings, is hot: its rows are dealt out.
HOT_VALUE = 10_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
LOGIN = re.compile(r"://[^\x00-\x20/:@\"'<>]{1,64}:([^\x00-\x20/:@\"'<>]{6,128})@")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----([A-Za-z0-9+/=\s]{32,})-----END")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")

_FOUND = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()),
                             ("digest", pa.binary()), ("live", pa.bool_())]))
_FOUND_SQL = "array<struct<kind:tinyint,start:bigint,end:bigint,digest:binary,live:boolean>>"


def bits(value: str) -> float:
    """Shannon entropy of a value's characters, in bits each."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    """Random-looking, and not one of the usual stand-ins."""
    return bits(value) >= LIVE_BITS and not PLACEHOLDER.search(value)


def _candidates(text: str):
    """(kind, start, end, value) of all kinds; a base match that fails its length is dropped, without a retry."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_VALUE:
            yield 0, m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield 1, m.start(), m.end(), m[0]
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end(), m[0]
    if "eyJ" in text:
        for m in JWT.finditer(text):
            yield 3, m.start(), m.end(), m[0]
    if "://" in text:
        for m in LOGIN.finditer(text):
            yield 4, m.start(1), m.end(1), m[1]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            yield 5, m.start(), m.end(), re.sub(r"\s", "", m[1])
    for m in BLOB.finditer(text):
        value = m[0]
        if (re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)
                and bits(value) >= BLOB_BITS):
            yield 6, m.start(), m.end(), value


def find(text: str) -> list[tuple[int, int, int, bytes, bool]]:
    """The candidates of a text by start, then kind: (kind, start, end, digest of the value, live-looking).

    An added candidate that overlaps a base one, or an earlier added one, is not listed.
    """
    found = sorted((start, kind, end, value) for kind, start, end, value in _candidates(text))
    base = [(start, end) for start, kind, end, _ in found if kind < len(BASE_KINDS)]
    out, at, k, taken = [], 0, 0, 0
    for start, kind, end, value in found:
        if kind >= len(BASE_KINDS):
            while k < len(base) and base[k][0] <= start:
                at, k = max(at, base[k][1]), k + 1
            if start < max(at, taken) or (k < len(base) and base[k][0] < end):
                continue
            taken = end
        out.append((kind, start, end, hashlib.blake2b(value.encode(), digest_size=16).digest(), looks_live(value)))
    return out


def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "digest", "live"), f, strict=True))
                      for f in find(t.as_py() or "")] for t in texts], _FOUND)


def ownership(held: DataFrame) -> DataFrame:
    """Per ``digest`` of ``held`` (digest, owner, repo): distinct ``owners``, distinct ``repos`` (of an owner), ``rows``.

    Copies are folded before every shuffle, so a value held by a third of all
    documents is one row per task from the second step on.
    """
    repos = held.groupBy("digest", "owner", "repo").agg(F.count("*").alias("rows"))
    owners = repos.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"))
    return owners.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"),
                                        F.sum("rows").alias("rows"))


def verdict(live: Column, owners: Column, repos: Column) -> Column:
    """``example`` (copied around), ``owned`` (live-looking, an owner's own) or ``dull``."""
    return (F.when((owners >= EXAMPLE_OWNERS) | (repos >= EXAMPLE_REPOS), "example")
            .when(live, "owned").otherwise("dull"))


def find_secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
                 spans_col: str = "secrets") -> DataFrame:
    """Every row of ``docs``, its text left out, with an array of spans (kind, start, end, verdict).

    Positions are code points, the end exclusive; spans are ordered by start,
    then kind (assign, access, hex, jwt, login, pem, blob). ``verdict`` says who
    else holds the value: see :func:`verdict`. Base kinds are listed with any
    verdict, added kinds only if owned. Null and empty texts have no spans. A
    null owner or repository counts as one of its own; rows that repeat a
    repository count once. Input columns called like the new one are replaced;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}"
    docs = without(docs, spans_col)
    keep = [c for c in docs.columns if c.lower() != text_col.lower()]
    row, found, repo, owner = fresh(docs, "__row", "__found", "__repo", "__owner")
    (docs.select(*map(col, keep), col(repo_col).cast("string").alias(repo), col(owner_col).cast("string").alias(owner),
                 F.monotonically_increasing_id().alias(row), F.arrow_udf(_scan, _FOUND_SQL)(col(text_col).cast("string")).alias(found))
     .write.option("compression", "zstd").parquet(folder))
    rows = spark.read.parquet(folder)  # written once: the row numbers hold
    each = rows.where(F.size(found) > 0).select(
        F.col(row).alias("row"), F.col(owner).alias("owner"), F.col(repo).alias("repo"),
        F.posexplode(found).alias("place", "f")).select("row", "owner", "repo", "place", "f.*")
    held = ownership(each.select("digest", "owner", "repo"))
    hot_from = max(HOT_VALUE, (rows.agg(F.sum(F.size(found))).first()[0] or 0) // 1000)
    judged = (join_hot(each.drop("owner", "repo"), held, ["digest"], "rows", F.col("row"), hot_from)
              .withColumn("verdict", verdict(F.col("live"), F.col("owners"), F.col("repos")))
              .where((F.col("kind") < len(BASE_KINDS)) | (F.col("verdict") == "owned")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "place", kind.alias("kind"), "start", "end", "verdict"))).alias("s"))
    spans = spans.select("row", F.transform("s", lambda s: s.dropFields("place")).alias(spans_col))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,verdict:string>>")
    joined = rows.select(*map(col, keep), F.col(row)).join(spans, F.col(row) == F.col("row"), "left")
    return joined.select(*map(col, keep), F.coalesce(col(spans_col), none).alias(spans_col))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
