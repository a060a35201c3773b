"""Exact deduplication: group by a 128-bit content hash, compare the texts inside a group, keep one row.

Native: DataFrame functions only.

* Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted; null is empty.
* The hash is the first half of SHA-256 of the normalised text. The grouping key is that hash *and* the text, so equal
  hashes of different texts never share a group: the aggregate compares the bytes. Map-side combining leaves one row
  for each distinct text of a map task, however many copies there are.
* Of a group stays the row with the most code points in the original text, then the smallest id. (Where a row has no
  id, rows with one come first.) Both are packed into one decimal, so the aggregate keeps fixed-width buffers and stays
  a hash aggregate.
* Rows get their group by a join on the hash alone. Both sides of it are plain exchanges, so that adaptive execution
  splits the partition of a group that holds a large part of all rows. Hashes that two texts share (``clash``) go
  another way, joined by hash and text; there are none unless SHA-256's first half collides, so that set is broadcast,
  and its branch is dropped at run time when it is empty.

Empty table: empty result. Repeated rows with one id and one text are one document: they share its decision. Columns
of the input keep their values, except those with the name of a result column, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh

RESULT = ("keep_id", "group_size", "kept", "text_sha256")
_WIDE = "decimal(38,0)"
_HALF = "36893488147419103232"  # 2 to the 65th: above any id's rank


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _rank(text: Column, key: Column) -> Column:
    """Larger is better: code points first, then the smaller id; no id ranks last."""
    by_id = F.coalesce(F.lit("9223372036854775808").cast(_WIDE) - key.cast(_WIDE), F.lit(0).cast(_WIDE))
    return (F.char_length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)") * F.lit(_HALF).cast("decimal(20,0)") + by_id).cast(_WIDE)


def _id(rank: Column) -> Column:
    part = (rank % F.lit(_HALF).cast(_WIDE)).cast(_WIDE)
    return F.when(part > 0, (F.lit("9223372036854775808").cast(_WIDE) - part).cast("bigint"))


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", hash_bits: int = 128) -> DataFrame:
    """All columns of docs and RESULT. hash_bits: fewer only to test what happens when hashes collide."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT))
    h, sha, size, best, norm = fresh(docs, "hash", "sha", "size", "best", "norm")
    plain = normalised(F.col(f"`{text}`"))
    digest = F.sha2(plain.cast("binary"), 256)
    hashed = F.substring(digest, 1, hash_bits // 4)
    rank = _rank(F.col(f"`{text}`"), F.col(f"`{key}`"))
    rows = docs.withColumns({h: hashed, sha: digest})
    groups = (
        docs.select(hashed.alias(h), plain.alias(norm), rank.alias(best))
        .groupBy(h, norm)
        .agg(F.max(best).alias(best), F.count(F.lit(1)).alias(size))
    )
    # All columns of the groups are asked for, so that one exchange of the texts serves this and the join.
    shared = groups.groupBy(h).agg(F.count(F.lit(1)).alias("n"), F.max(best).alias(best), F.max(size).alias(size))
    clash = F.broadcast(shared.where((F.col("n") > 1) & F.col(best).isNotNull() & (F.col(size) > 0)).select(h))
    most = rows.join(groups.join(clash, h, "left_anti").select(h, best, size), h)
    rest = rows.withColumn(norm, plain).join(clash, h).join(groups.join(clash, h, "left_semi"), [h, norm])
    return most.unionByName(rest.drop(norm)).select(
        *(F.col(f"`{c}`") for c in docs.columns),
        _id(F.col(best)).alias("keep_id"),
        F.col(size).alias("group_size"),
        F.col(f"`{key}`").eqNullSafe(_id(F.col(best))).alias("kept"),
        F.col(sha).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    decided = decide(docs, key, text).where("kept and group_size > 0")  # all that decide() makes of a group: its exchange is shared
    return decided.select(*(F.col(f"`{c}`") for c in docs.columns))
