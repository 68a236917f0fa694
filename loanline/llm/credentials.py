"""Secret scans, with corpus-wide ownership of what they find.

Candidates are found in every text; their hashes are counted by distinct repositories and owners over the whole corpus.
A value that many owners have, or that lies in many repositories of few, is a copied example; any other looks like a
live credential of its owners.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import row_key, steps
from loanline.sources.folders import stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds that this scan adds, if the value is not a copied example.
ADDED = {
    "bearer": re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=-]{20,})"),
    "login": re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:([^\s/@]{8,})@"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s*+[A-Za-z0-9-]++:[^\n]*+\n)*+([A-Za-z0-9+/=\s]{40,})"),
    "prefixed": re.compile(r"\b((?:gh[pousr]_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,})"),
}
KINDS = ["assign", "access", "hex", *ADDED]
#: Owners from which on a value counts as a widely copied example.
COPIED = 3
#: Repositories from which on it counts as one, however few owners they have: a live credential is kept in few places.
COPIED_REPOSITORIES = 10


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points; per kind leftmost and without overlap, base kinds first."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern in ADDED.items():
        found += [(kind, m.start(), m.end(), m[1]) for m in pattern.finditer(text)]
    return found


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        found, digests = [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            spans = candidates(text or "")
            base = sorted((start, KINDS.index(kind), end) for kind, start, end, _ in spans if kind not in ADDED)
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            found.append(
                [
                    {"kind": KINDS.index(kind), "start": start, "end": end, "value": hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()}
                    for kind, start, end, value in spans
                ]
            )
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "row", "repository", "owner")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(digests), pa.array(found, _FOUND)], names=["doc_id", "row", "repository", "owner", "base_sha256", "found"]
        )


def _is_kind(number: int):
    return lambda span: span["kind"] == number


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) of (value, repository, owner) rows; each pair is counted once, before it is shuffled.

    A null repository or owner is one of its own.
    """
    pairs = found.select("value", F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    repositories = pairs.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("n_repositories"))
    owners = pairs.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    return repositories.join(owners, "value")


def scan_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    copied: int = COPIED,
    copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_repositories): a row for each row of ``docs``.

    The three base kinds are always reported; a candidate of an added kind is reported if fewer than ``copied`` owners
    and fewer than ``copied_repositories`` repositories have its value. ``spans`` lists kind:start:end (code points, end
    exclusive) by start, then kind. ``n_live`` and ``n_copied`` count the spans by that same test; ``n_repositories`` is
    that of the row's most spread candidate, reported or not (0: none). Values leave a task as SHA-256 only. A null text
    is empty; repeated rows are scanned alike and add no owner and no repository; a null owner or repository is one of
    its own; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        row_key(f"`{doc_id}`", f"`{text}`").alias("row"),
        F.col(f"`{repository}`").cast("string").alias("repository"),
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.col(f"`{text}`").alias("text"),
    )
    fields = "found array<struct<kind int, start int, end int, value string>>"
    scanned = stored(
        rows.mapInArrow(_scan, f"doc_id {kind}, row string, repository string, owner string, base_sha256 string, {fields}"), "secrets"
    )
    each = scanned.select("row", "repository", "owner", F.explode("found").alias("f")).select("row", "repository", "owner", "f.*")
    judged = each.join(ownership(each), "value").withColumn(
        "live", (F.col("n_owners") < copied) & (F.col("n_repositories") < copied_repositories)
    )
    added = F.col("kind") >= KINDS.index(next(iter(ADDED)))
    names = F.array(*[F.lit(k) for k in KINDS])
    reported = (
        judged.select("row", "n_repositories", F.when(~added | F.col("live"), F.struct("start", "kind", "end", "live")).alias("span"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("span")).alias("all"), F.max("n_repositories").alias("n_repositories"))
    )
    joined = scanned.join(reported, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")))
    shown = F.transform(F.col("all"), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    count = lambda test: F.size(F.filter(F.col("all"), test)).cast("long")
    return joined.select(
        "doc_id",
        *[count(_is_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        "base_sha256",
        F.array_join(shown, ",").alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
        F.coalesce("n_repositories", F.lit(0).cast("long")).alias("n_repositories"),
    )
