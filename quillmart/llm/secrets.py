"""Secret scans with multipart credential linking.

Strong candidates (assignments, access identifiers, long hex strings) are reported
as they are. Weak ones are parts of a credential: a bare 40-character secret, a
named identifier, an endpoint. They are reported only where complementary parts
are within SCOPE code points: a bare secret next to an identifier, a named
identifier next to a secret, an endpoint next to both. What overlaps a candidate is
no complement of it: the hex digits after client_id= are not their own secret. The
interval join is an equality join on (text, bucket of SCOPE code points) and a test
of the distance, so a candidate meets the parts of three buckets, which hold no more
than SCOPE code points have room for, however long the text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize
from .spans import found_matches, located, with_digests

KINDS = ["assign", "access", "hex"]
WEAK = ["secret", "identifier", "endpoint"]
SCOPE = 300
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]++",
    # Runs under 16 characters fail anyway.
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    # An assignment sign may stand before it.
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "identifier": r"""(?<![A-Za-z0-9])(?i:client_?id|account_?id|access_?key_?id|user(?:name)?|login)["']? *[:=] *["']?[A-Za-z0-9@._-]{4,}+""",
    "endpoint": r"(?<![A-Za-z0-9])(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/?#@!&=%-]++|[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,6}\.(?:amazonaws|azure|googleapis)\.com)",
}
NEEDS = {"access": "AKIA", "endpoint": "."}


def is_base() -> Column:
    kind, match = F.col("kind"), F.col("match")
    value = F.regexp_extract(match, r"""[:=] *["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    return F.when(kind == "assign", F.char_length(value) >= 12).when(kind == "access", F.char_length(match) >= 18).when(kind == "hex", F.char_length(match) >= 16).otherwise(False)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of parts (ROW, kind, start, end, is_base) whose complements start within the scope of their start and do not overlap them."""
    role = (
        F.when(F.col("kind").isin("access", "identifier"), "identifier")
        .when(F.col("kind").isin("assign", "hex", "secret"), "secret")
        .otherwise("endpoint")
    )
    placed = parts.withColumns({"role": role, "bucket": F.floor(F.col("start") / scope)})
    others = placed.filter("role <> 'endpoint'").select(ROW, "bucket", "role", F.col("start").alias("from"), F.col("end").alias("to"))
    weak = placed.filter(F.col("kind").isin(WEAK)).select(ROW, "kind", "start", "end", "is_base", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    apart = (F.col("to") <= F.col("start")) | (F.col("from") >= F.col("end"))
    met = weak.join(others, [ROW, "bucket"]).filter(apart & (F.abs(F.col("from") - F.col("start")) <= scope))
    seen = met.groupBy(ROW, "kind", "start", "end", "is_base").agg(F.bool_or(F.col("role") == "identifier").alias("id"), F.bool_or(F.col("role") == "secret").alias("key"))
    return seen.filter("CASE kind WHEN 'secret' THEN id WHEN 'identifier' THEN key ELSE id AND key END").select(ROW, "kind", "start", "end", "is_base")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text).

    Counts and base_sha256 are of the strong spans; spans has the linked weak ones
    too, of the kinds secret, identifier and endpoint, after the strong kinds where
    they start together. Null texts count as empty; texts without spans have counts
    of zero, the digest of nothing and an empty string. Repeated rows are each
    reported. An empty table gives no rows.
    """
    found = found_matches(docs, PATTERNS, NEEDS)
    # What a pattern matches without passing its test is no part either.
    parts = materialize(located(found).select(ROW, "kind", "start", "end", is_base().alias("is_base")).filter(F.col("is_base") | F.col("kind").isin(WEAK)))
    spans = parts.filter("is_base").unionByName(linked(parts, scope))
    return with_digests(found, spans, KINDS, WEAK)
