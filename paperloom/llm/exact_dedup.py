"""Exact deduplication by skew-safe combining, in DataFrame functions alone.

Texts are equal when identical after every run of ASCII white space is one space. The steps:

1. digest counts find the groups that are too large for one task ("hot": at least 2 000 rows and more than one
   row in 65 536 of the table, so at most 65 536 digests, about 4 MB, are ever broadcast);
2. every task combines its own rows by (digest, salt, full text) before anything is sent; a hot digest is dealt to
   so many salts that each holds about one threshold of rows, all others have one salt;
3. salted groups are merged by (digest, salt, full text), which shuffles each different text once, and stored with their ids; the
   text stays only with hot groups;
4. the salts' winners, without their ids, are combined by (digest, full text), and the result goes back to each salt. So
   no task has to take all ids of a group. Rows repeated with one id, and rows without one, share a salt.

A digest never decides by itself: the full text is part of the key at every stage, so colliding digests stay apart.

Edge cases: a null text is the empty text; very long texts are compared whole, as keys; repeated rows are rows of one group, of
which one is kept; of rows with the smallest id any one stays, as they are alike; null ids come after all others and win only where a group has no other; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.shipping import filter_by_ids, written

#: White space that isn't already one space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
HOT_ROWS, HOT_DIGESTS = 2_000, 65_536


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normal_text(F.col(text)).alias("t"))
    rows = rows.withColumn("d", F.unhex(F.sha2("t", 256)))
    counts = rows.groupBy("d").agg(F.count("*").alias("n")).filter(F.col("n") >= hot_rows)
    # the threshold grows with the table, so the number of hot digests stays bounded at any size
    total = docs.count()
    least = max(hot_rows, -(-total // HOT_DIGESTS))
    hot = counts.filter(F.col("n") >= least).select("d", F.ceil(F.col("n") / least).cast("int").alias("salts"))
    member = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    salted = (
        rows.join(F.broadcast(hot), "d", "left")
        .withColumn("salts", F.coalesce("salts", F.lit(1)))
        .withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(F.lit(0).cast("bigint")))
    )
    merged = salted.groupBy("d", "salt", "salts", "t").agg(F.min(member).alias("best"), F.count("*").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))
    merged = written(merged.withColumn("t", F.when(F.col("salts") > 1, F.col("t"))), "merged")
    parts = merged.filter("salts > 1")
    groups = parts.groupBy("d", "t", "salts").agg(F.min("best").alias("keep"), F.sum("n").alias("group_size"))
    groups = groups.select("d", "t", "keep", "group_size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)).alias("salt"))
    whole = merged.filter("salts = 1").select("d", F.col("best").alias("keep"), F.col("n").alias("group_size"), "members")
    # a left join, as an inner one may broadcast the parts to the one task that has their group
    combined = whole.unionByName(parts.join(groups, ["d", "salt", "t"], "left").select("d", "keep", "group_size", "members"))
    return (
        combined.select("d", "keep", "group_size", "members", F.posexplode("members").alias("i", "m"))
        .select(
            F.col("m.id").alias("doc_id"),
            F.col("keep.id").alias("keep_id"),
            "group_size",
            (F.col("m").eqNullSafe(F.col("keep")) & ((F.col("i") == 0) | ~F.get("members", F.col("i") - 1).eqNullSafe(F.col("m")))).alias("kept"),
            F.lower(F.hex("d")).alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    doc_id identifies a document: rows whose id lost against another are dropped, and of rows repeated with their id one
    stays. Rows without an id stay.
    """
    groups = written(duplicate_groups(docs, doc_id, text).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "keep_id"), "dropped")
    kept = filter_by_ids(docs, doc_id, groups.filter("doc_id <> keep_id").select("doc_id"), keep=False)
    if groups.filter("doc_id = keep_id").limit(1).count():
        alone = kept.filter(F.col(doc_id).isNull())
        return kept.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(alone)
    return kept
