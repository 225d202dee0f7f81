"""Near-dedup at a stated similarity: SimHash and BK-trees (operator 3) first, and an exact join for what they leave.

Fingerprints of 64 bits can't decide a similarity of 0.8 alone: such sets differ in ten bits on average, a radius at
which a BK-tree prunes next to nothing. So the BK-trees form the first groups: sets whose fingerprints lie within the radius
are tied, and link after an exact check, and so are sets with the same least token. The token-group matrix of
``groupjoin`` then finds all further links, in groups and between them. The result is that of all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tidied, unused
from .groupjoin import SENT, classes, set_key, sets_of, to_leaders
from .simhash import links as fingerprint_links


def fingerprint_pairs(own: DataFrame, radius: int) -> DataFrame:
    """Pairs of sets (a, b) that span the components of fingerprints within ``radius`` bits: each set of a fingerprint
    goes with its leader, and these go along the links that BK-trees find."""
    least = checkpointed(own.groupBy("fp").agg(F.max(F.struct("rank", "u")).alias("leader")).select("fp", "leader.u"))
    found = fingerprint_links(least.select("fp"), radius)
    ends = found.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return to_leaders(own, "fp").unionAll(ends)


def deduplicated(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, share: float = 0.8, radius: int = 3) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (then key of its set, then all columns).

    Rows link if the Jaccard similarity of their sets of ``width``-word shingles (only A-Z folded, ASCII white space
    splits) is ``share`` or more. ``radius`` is that of the fingerprints' links; the result doesn't depend on it.
    Texts without words link with each other. Null ids come last; a component of null
    ids only keeps one of its rows. Repeated rows are copies like others. No rows give no rows. Jobs run while this is called.
    """
    columns = df.columns
    kept_id, kept_key, copy = unused(columns, "_kept", "_kept_key", "_copy")
    first = [lambda own: fingerprint_pairs(own, radius), lambda own: to_leaders(own, "first"), lambda own: to_leaders(own, "second")]
    marked, found, unique = classes(df, id, text, width, share, first, fingerprints=True)
    least = marked.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    if found is not None:
        least = least.join(found, F.col("key") == F.col("node"), "left").groupBy(F.coalesce(F.col("label").cast("string"), F.hex("key")).alias("label")).agg(F.min("first").alias("first"))
    with tidied(df.sparkSession):
        kept = checkpointed(least.select(F.col("first.id").alias(kept_id), F.col("first.key").alias(kept_key)))
    if unique:
        with tidied(df.sparkSession):
            copies = checkpointed(marked.join(kept, F.col("id") == F.col(kept_id), "left_anti").select(F.col("id").alias(copy)))
            few = copies.count() <= SENT
        if few:  # then the texts stay where they are
            return df.join(F.broadcast(copies), F.col(id) == F.col(copy), "left_anti")
        return df.join(kept, F.col(id) == F.col(kept_id), "left_semi")
    # ids that repeat or are null don't tell rows apart: their keys and columns do
    own = F.udf(lambda t: set_key(sets_of([t], width)[0]), "binary")
    rows = df.join(kept, F.col(id).eqNullSafe(F.col(kept_id))).where(own(F.col(text)) == F.col(kept_key))
    first_row = rows.groupBy(kept_id, kept_key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"))
    return first_row.select(*[F.col("row").getField(c).alias(c) for c in columns])
