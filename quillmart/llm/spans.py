"""Spans of patterns in texts, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, keyed, materialize

#: Code points kept on either side of a match.
BEFORE, AFTER = 48, 24


def found_matches(docs: DataFrame, patterns: dict[str, str], needs: dict[str, str] | None = None) -> DataFrame:
    """ROW, doc_id and found: for each pattern its leftmost non-overlapping matches in order, as
    (kind, i, gap, match, before, after); gap is the number of code points since the match before.

    needs: a string that every match of the kind holds, to skip texts cheaply. Null
    texts count as empty. The table is written out, so texts are read once.
    """
    needs = needs or {}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), text.alias("_q_text"))
    none = F.array().cast("array<string>")
    cut = {}
    for k, rx in patterns.items():
        there = F.col("_q_text").rlike(rx)
        if k in needs:
            there = F.col("_q_text").contains(needs[k]) & there
        cut[f"_q_has_{k}"] = there
    rows = rows.withColumns(cut)
    rows = rows.withColumns(
        {f"_q_f_{k}": F.when(F.col(f"_q_has_{k}"), F.regexp_extract_all("_q_text", F.lit(rx), F.lit(0))).otherwise(none) for k, rx in patterns.items()}
        | {f"_q_g_{k}": F.when(F.col(f"_q_has_{k}"), F.split("_q_text", rx, -1)).otherwise(none) for k, rx in patterns.items()}
    )

    def kind(k: str) -> Column:
        zipped = F.arrays_zip(F.col(f"_q_f_{k}").alias("m"), F.col(f"_q_g_{k}").alias("g"), F.slice(F.col(f"_q_g_{k}"), 2, F.greatest(F.size(f"_q_g_{k}"), F.lit(1))).alias("h"))
        return F.transform(
            F.filter(zipped, lambda x: x["m"].isNotNull()),
            lambda x, i: F.struct(
                F.lit(k).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"), x["m"].alias("match"), F.right(x["g"], F.lit(BEFORE)).alias("before"), F.left(x["h"], F.lit(AFTER)).alias("after")
            ),
        )

    return materialize(rows.select(ROW, "doc_id", F.concat(*[kind(k) for k in patterns]).alias("found")))


def located(found: DataFrame) -> DataFrame:
    """A row for each match: ROW, kind, start, end (code points, end exclusive), match, before, after.

    Positions are running sums of gaps and matches within a text and kind.
    """
    one = found.filter(F.size("found") > 0).select(ROW, F.explode("found").alias("x")).select(ROW, "x.*")
    order = W.partitionBy(ROW, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ended = one.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(order))
    return ended.select(ROW, "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", "match", "before", "after")


def digest_spans(spans: DataFrame, kinds: list[str]) -> DataFrame:
    """ROW, base and all (arrays of kind:start:end by start, then kind as listed), and n_<kind> of the base.

    spans: ROW, kind, start, end, is_base. A text's spans are gathered in one row.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    item = F.struct("start", rank.alias("rank"), "end", "kind")
    name = lambda xs: F.transform(F.array_sort(xs), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return spans.groupBy(ROW).agg(
        name(F.collect_list(F.when(F.col("is_base"), item))).alias("base"), name(F.collect_list(item)).alias("all"), *[F.count_if(F.col("is_base") & (F.col("kind") == k)).alias(f"n_{k}") for k in kinds]
    )


def with_digests(found: DataFrame, spans: DataFrame, base_kinds: list[str], more_kinds: list[str] | None = None) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans for each text, also those without spans."""
    joined = found.select(ROW, "doc_id").join(digest_spans(spans, base_kinds + (more_kinds or [])), ROW, "left")
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base_kinds], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("all")).alias("spans")
    )


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")
