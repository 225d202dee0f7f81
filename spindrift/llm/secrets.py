"""Secret scans (operator 4): JVM-side SQL functions only.

Base kinds are found by pattern. The entropy kind slides a window over candidate strings (long runs of token
characters) and keeps the Shannon entropy of the window by incremental counts: at each step one count goes up, one
goes down, and the sum of c * log2(c) changes by a looked-up difference. Each character class (hex, base64) has its
own alphabet and threshold; an allow-list suppresses known harmless strings, and windows over known harmless words. Positions are code points.

``split`` and ``regexp_extract_all`` walk the same leftmost non-overlapping matches, so the running lengths of gaps
and matches give the positions. Everything is a projection: no shuffle, no Python. Arrays that are looked up in a
walk are bound to a lambda variable first: an expression would be computed again at each step.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base kinds, in the order of ties: (kind, pattern, group measured, its least length).
#: Runs that are too short never match the bounded patterns, which find the same matches as unbounded ones filtered
#: by length; that doesn't hold for assign, whose short matches still take up text.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one class: full runs of at least ``window`` characters that hold a digit and, if ``mixed``, a
    lower-case and an upper-case letter; ``bits`` is the entropy that some window must reach."""

    kind: str
    alphabet: str
    window: int
    bits: float
    mixed: bool


#: Fixed values. The most that a window of 20 can reach is log2(16) = 4 and log2(20) = 4.32 bits.
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", 20, 3.0, False),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 3.5, True),
)
#: Candidates that match one of these as a whole are no secrets: UUIDs, runs of digits, file and URL paths of words.
ALLOW = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]+|[a-z]([a-z/_=-]*[a-z])?"
#: Words of example keys: windows over one of them don't count, the rest of the candidate does.
HARMLESS = r"(?i)example|placeholder|xxxx|your[_-]"


#: Items whose running values are made in one walk; the walk over the blocks' totals is as much shorter.
BLOCK = 256


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the value, which is computed once however often ``f`` names it, at every step of a walk too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each item, the values of those before it joined (0 at first), as array<bigint>.

    A walk that appends to an array copies it at each step; so it goes over blocks, from the total of those before.
    """
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
    go = lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    zero = F.lit(0).cast("bigint")

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda own: F.aggregate(own, zero, lambda s, x: join(s, value(x))))
        offsets = F.aggregate(totals, start(zero), go, lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, offsets, lambda own, at: F.aggregate(own, start(at), lambda s, x: go(s, value(x)), lambda s: s["out"])))

    return _bound(_blocks(items), of)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as array<struct<start, end, run>>, where run is the group's text."""
    p = F.lit(pattern)
    whole, measured = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    sizes = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size")))
    parts = F.zip_with(sizes, measured, lambda x, r: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), r.alias("run")))

    def placed(own: Column) -> Column:
        before = _running(own, lambda x: x["gap"] + x["size"], lambda a, b: a + b)
        return F.zip_with(own, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["run"].alias("run")))

    # most texts have no match: the walk is then skipped; what follows the last match is no match
    found = _bound(F.filter(parts, lambda x: x["size"].isNotNull()), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, run: string>>"))


def _named(matches: Column, kind: str, order: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(order).alias("order")))


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans of all matches whose group has the least length, in order."""
    return _named(F.filter(_matches(text, pattern, group), lambda x: F.length(x["run"]) >= least), kind, order)


def window_entropy(candidate: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy (bits) of any window of the candidate, by incremental counts, in time that follows
    the candidate's length.

    The state holds the counts by place in the alphabet and the sum of c * log2(c); the entropy is
    log2(window) - sum / window. Shorter candidates are one window of their own length.
    """
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    table = F.array(*[F.lit(c) for c in cost])
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    zero = F.array_repeat(F.lit(0), len(alphabet))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), F.lit(0).alias("i"))

    def step(s: Column, code: Column, codes: Column) -> Column:
        counts, full = s["counts"], s["i"] >= window
        gone = F.when(full, F.get(codes, s["i"] - window)).otherwise(-1)
        same = code == gone  # one comes, one of its kind goes
        c, g = F.get(counts, code), F.get(counts, gone)
        rise = F.get(table, c + 1) - F.get(table, c)
        fall = F.when(full, F.get(table, g - 1) - F.get(table, g)).otherwise(0.0)
        after = F.transform(counts, lambda x, j: F.when(j == code, x + 1).when(j == gone, x - 1).otherwise(x))
        total = F.when(same, s["sum"]).otherwise(s["sum"] + rise + fall)
        least = F.when(s["i"] >= window - 1, F.least(s["least"], total)).otherwise(s["least"])
        return F.struct(F.when(same, counts).otherwise(after).alias("counts"), total.alias("sum"), least.alias("least"), (s["i"] + 1).alias("i"))

    n = F.length(candidate)

    def done(s: Column) -> Column:
        short = F.log2(n.cast("double")) - s["sum"] / n
        return F.when(n < window, short).otherwise(math.log2(window) - s["least"] / window)

    return _bound(places, lambda codes: F.aggregate(codes, start, lambda s, code: step(s, code, codes), done))


def _candidates(text: Column, kind: CharacterClass) -> Column:
    """Spans and strings of the maximal runs of a class that are long enough."""
    inside = "".join("\\" + c if c in "+/=_-" else c for c in kind.alphabet)
    return _matches(text, rf"(?<![{inside}])[{inside}]{{{kind.window},}}")


def _entropy_spans(text: Column, kind: CharacterClass, order: int, allow: str, harmless: str) -> Column:
    def holds(c: Column) -> Column:
        run = c["run"]
        wanted = run.rlike("[0-9]") & ~run.rlike(rf"^(?:{allow})$")
        if kind.mixed:
            wanted = wanted & run.rlike("[a-z]") & run.rlike("[A-Z]")
        parts = F.filter(F.split(run, harmless, -1), lambda part: F.length(part) >= kind.window)
        return F.when(wanted, F.exists(parts, lambda part: window_entropy(part, kind.alphabet, kind.window) >= kind.bits)).otherwise(False)

    return _named(F.filter(_candidates(text, kind), holds), kind.kind, order)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", classes: tuple[CharacterClass, ...] = CLASSES, allow: str = ALLOW, harmless: str = HARMLESS) -> DataFrame:
    """``df`` with the spans of all secrets of each whole text: array<struct<start, end, kind, order>> by start, then
    kind in the order of BASE and ``classes``.

    Code points, end exclusive. Null and empty texts have none; repeated rows are scanned each; a column named
    like the output is replaced. Candidates that match ``allow`` as a whole have no entropy span; of others only the
    parts between matches of ``harmless`` count. Base spans stay whatever the entropy says; an entropy span that covers the same
    text as a base span is its own span.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = [_spans(whole, p, group, least, kind, i) for i, (kind, p, group, least) in enumerate(BASE)]
    found += [_entropy_spans(whole, c, len(BASE) + i, allow, harmless) for i, c in enumerate(classes)]
    by = lambda a, b: F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).otherwise(a["order"] - b["order"])
    return df.withColumn(out, F.array_sort(F.concat(*found), by))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(df: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with the text under each group of overlapping spans replaced by a mark (null texts stay null)."""
    whole = F.col(f"`{text}`")

    def piece(t: Column, start: Column, end: Column) -> Column:
        return t.substr((start + 1).cast("int"), (end - start).cast("int"))

    def hidden(own: Column) -> Column:
        before = _running(own, lambda x: x["end"], F.greatest)
        # overlapping or repeated spans: what is left of them is hidden under the mark before
        cuts = F.filter(F.zip_with(own, before, lambda x, at: F.struct(at.alias("start"), x["start"].alias("end"))), lambda c: c["end"] >= c["start"])
        # a piece is found by walking the text to it; so the text is cut into blocks first
        block = lambda c: _bound(c[0]["start"], lambda base: _bound(piece(whole, base, F.element_at(c, -1)["end"]), lambda t: F.array_join(F.transform(c, lambda x: F.concat(piece(t, x["start"] - base, x["end"] - base), F.lit(mark))), "")))
        shown = _bound(cuts, lambda found: F.array_join(F.transform(F.filter(_blocks(found), lambda c: F.size(c) > 0), block), ""))
        return F.concat(shown, _bound(F.array_max(F.transform(own, lambda x: x["end"])), lambda last: piece(whole, last, F.greatest(last, F.length(whole).cast("bigint")))))

    return df.withColumn(text, F.when(F.size(spans) > 0, _bound(F.col(spans), hidden)).otherwise(whole))
