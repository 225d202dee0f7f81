"""Column functions on biological sequences, qualities and k-mers; all of them are built-in expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order T, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), CODE, strict=True))


def count(s: Column, letters: str) -> Column:
    """How many characters are among the letters, either case."""
    return F.regexp_count(s, F.lit(f"(?i)[{letters}]")).cast("long")


def percent(s: Column, letters: str) -> Column:
    return 100.0 * count(s, letters) / F.greatest(F.length(s), F.lit(1))


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTUacgtuRYKMBDHVrykmbdhv", "TGCAAtgcaaYRMKVHDByrmkvhdb")


def revcomp(s: Column) -> Column:
    return F.reverse(complement(s))


def windows(s: Column, width: int, step: int) -> Column:
    """Starts (from 0) of all whole windows."""
    n = F.length(s) - width
    return F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def kmers(s: Column, k: int, canonical: bool = False) -> Column:
    """All k-mers in order; canonical ones are the lesser of each and its reverse complement."""
    found = F.transform(windows(s, k, 1), lambda i: F.substring(s, i + 1, F.lit(k)))
    return F.transform(found, lambda m: F.least(m, revcomp(m))) if canonical else found


def chunks(s: Column, size: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.length(s) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(s, i * size + 1, F.lit(size)))


def translated(s: Column, frame: int = 0) -> Column:
    """Protein of one frame; unknown codons are X, a partial last one is left out."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    body = F.upper(F.replace(F.substring(s, frame + 1, 1 << 30), F.lit("U"), F.lit("T")))
    # split in one pass: what a lambda refers to is made anew for each of its elements
    triples = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit("(?s).{3}"), F.lit(0))
    codons = F.transform(triples, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    return F.array_join(codons, "")


def phred(q: Column, offset: int = 33) -> Column:
    """Qualities as numbers."""
    return F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def mean_quality(q: Column, offset: int = 33) -> Column:
    p = phred(q, offset)
    return F.aggregate(p, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(p), F.lit(1))


def expected_errors(q: Column, offset: int = 33) -> Column:
    return F.aggregate(phred(q, offset), F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), -x / 10))


def good_ends(q: Column, least: int, offset: int = 33) -> tuple[Column, Column]:
    """(start from 0, length) of what is left between the first and the last quality of at least ``least``."""
    low = "".join("\\" + chr(c) if not chr(c).isalnum() else chr(c) for c in range(33, offset + least))
    left = F.length(F.regexp_extract(q, f"^[{low}]*", 0)) if low else F.lit(0)
    right = F.length(F.regexp_extract(q, f"[{low}]*$", 0)) if low else F.lit(0)
    return left, F.greatest(F.length(q) - left - right, F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Differing places plus the difference in length."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), "")
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d)) + F.abs(F.length(a) - F.length(b))
