"""Bounded samples of labelled rows, for the classifiers of this subpackage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Buckets of the sampling hash.
_BUCKETS = 1 << 20
#: Labels up to which each has its full number of rows: with it, the bound of a sample.
LABELS = 256
#: Labels up to which their shares are broadcast.
SENT = 100_000
#: Characters of a sample's texts that come to the driver (about).
CHARS = 60_000_000


def fold(id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds))


def sampled(labelled: DataFrame, id: str, label: str, per_label: int | dict, labels: int = LABELS) -> DataFrame:
    """Rows of ``labelled`` (id, label): about ``per_label`` of each label (or by label), chosen by a hash of the id, so the
    same at any partitioning; all of a rarer label. Of more than ``labels`` labels each has an equal part of
    ``labels * per_label`` rows, one expected at least. Null ids and labels are left out."""
    known = labelled.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    counts = checkpointed(known.groupBy(F.col(label).alias("_label")).count())
    n_labels = counts.count()
    if isinstance(per_label, dict):
        most = F.coalesce(*[F.when(F.col("_label") == k, F.lit(n)) for k, n in per_label.items()], F.lit(0))
    else:
        most = F.lit(min(per_label, max(1, labels * per_label // max(1, n_labels))))
    shares = counts.select("_label", (most / F.col("count")).alias("_share"))
    # as a rule there are few labels, and the labelled rows stay where they are
    shares = F.broadcast(shares) if n_labels <= SENT else shares
    # 40 bits of the hash, so that no label is too frequent for a share
    part = lambda bits: F.pmod(F.shiftright(F.xxhash64(id, F.lit(7)), bits), F.lit(_BUCKETS))
    at = part(0) / _BUCKETS + part(20) / _BUCKETS**2
    chosen = known.join(shares, F.col(label) == F.col("_label")).where(at < F.col("_share"))
    return chosen.drop("_label", "_share")


def within(rows: DataFrame, chars: int | None = None) -> DataFrame:
    """The sampled rows (id, text, label), written out; if their texts have more than ``chars`` (CHARS) characters, those
    of a part of the ids, chosen by another hash, that has about as many."""
    chars = CHARS if chars is None else chars
    held = checkpointed(rows)
    total = held.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    if total <= chars:
        return held
    return held.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(_BUCKETS)) < max(1, _BUCKETS * chars // total))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, learns: Column, per_label: int | dict, longest: int, id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """(text, label) of a bounded sample, on the driver, in a fixed order.

    ``labels`` (id, label) may repeat an id, which then has its greatest label. About ``per_label`` rows of each
    label, of at most ``longest`` characters each, are taken: the bounds of the sample's size. Only those rows of
    the documents come to the driver; the sampled ids are broadcast, at most twice as many as are asked for. If their
    texts have more than CHARS characters, a part of the rows of each label that has about as many is taken.
    """
    own = labels.where(learns).groupBy(id).agg(F.max(label).alias("label"))
    chosen = sampled(own, id, "label", per_label).select(F.col(id).alias("chosen"), "label")
    most = 2 * (sum(per_label.values()) if isinstance(per_label, dict) else LABELS * per_label)
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.length("text") <= longest)
    found = within(rows.join(F.broadcast(chosen.limit(most)), F.col("id") == F.col("chosen")).select("id", "text", "label")).toPandas()
    return found.sort_values(["id", "text"], kind="stable").reset_index(drop=True)[["text", "label"]]
