"""Merkle fixity audit of archive replicas. DataFrame functions only.

A record (file, offset, content) is hashed with its offset. The records of a range of `leaf`
bytes of a file, in the order of their offsets, hash to the range's node; FANOUT ranges in order
hash to a node one level up, and so on to the file's root. Two replicas are compared at their
roots; only below nodes that differ are children looked at, level by level, down to records.
A node groups at most FANOUT children, and a range holds the records that begin in it, so no group grows
with a file or the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEAF = 1 << 16
FANOUT = 64
#: Files may be as long as LEAF * FANOUT ** LEVELS bytes (70 TB).
LEVELS = 5


def records(replica: DataFrame, file: str = "file", offset: str = "offset", content: str = "content") -> DataFrame:
    """(file, at, digest) of each record, written once. Null files count as '', null offsets as -1, null contents
    as an empty one with a mark of its own. Repeated records all count."""
    body = F.col(f"`{content}`").cast("binary")
    digest = F.sha2(F.concat(F.when(body.isNull(), F.lit(b"null ")).otherwise(F.lit(b"record ")), F.coalesce(F.col(f"`{offset}`").cast("string"), F.lit("-1")).cast("binary"), F.lit(b"\n"), F.coalesce(body, F.lit(b""))), 256)
    return materialise(replica.select(F.coalesce(F.col(f"`{file}`").cast("string"), F.lit("")).alias("file"), F.coalesce(F.col(f"`{offset}`").cast("long"), F.lit(-1).cast("long")).alias("at"), digest.alias("digest")), "records")


def _joined(rows: str, by: str) -> Column:
    return F.expr(f"sha2(concat_ws('\\n', transform(array_sort(collect_list(struct({by}, {rows}))), x -> concat_ws(' ', x.{by}, x.{rows}))), 256)")


def tree(records: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Tables (file, node, digest) from the ranges of records up to one root for each file."""
    out = [materialise(records.groupBy("file", F.expr(f"at div {leaf}").alias("node")).agg(_joined("digest", "at").alias("digest")), "ranges")]
    for _ in range(levels):
        up = out[-1].groupBy("file", F.expr(f"node div {fanout}").alias("up")).agg(_joined("digest", "node").alias("digest"))
        out.append(materialise(up.select("file", F.col("up").alias("node"), "digest"), "nodes"))
    return out


def audit(first: DataFrame, second: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, levels: int = LEVELS, **names) -> DataFrame:
    """(file, offset, status, first_digest, second_digest) of the records that the replicas do not share.

    status: changed (same place, other content), missing (not in the second), extra (only
    there). Records of one file and offset are compared in the order of their digests. A row
    stands for each difference; equal replicas and empty tables give none. Only the named
    columns are read.
    """
    a, b = records(first, **names), records(second, **names)
    up_a, up_b = tree(a, leaf, fanout, levels), tree(b, leaf, fanout, levels)
    open_nodes = None
    for level in range(levels, -1, -1):
        x, y = up_a[level], up_b[level]
        if open_nodes is not None:
            x, y = (t.join(open_nodes, (t["file"] == open_nodes["f"]) & (F.expr(f"node div {fanout}") == open_nodes["n"]), "left_semi") for t in (x, y))
        x = x.select("file", "node", F.col("digest").alias("da"))
        y = y.select("file", "node", F.col("digest").alias("db"))
        differ = x.join(y, ["file", "node"], "full").where("not (da <=> db)")
        open_nodes = materialise(differ.select(F.col("file").alias("f"), F.col("node").alias("n")), "open")
    x, y = (t.join(open_nodes, (t["file"] == open_nodes["f"]) & (F.expr(f"at div {leaf}") == open_nodes["n"]), "left_semi") for t in (a, b))
    x, y = (t.groupBy("file", "at").agg(F.sort_array(F.collect_list("digest")).alias("d")) for t in (x, y))
    x, y = (t.select("file", "at", F.posexplode("d").alias("k", name)) for t, name in ((x, "da"), (y, "db")))
    both = x.join(y, ["file", "at", "k"], "full").where("not (da <=> db)")
    status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("changed")
    return both.select("file", F.col("at").alias("offset"), status.alias("status"), F.col("da").alias("first_digest"), F.col("db").alias("second_digest"))
