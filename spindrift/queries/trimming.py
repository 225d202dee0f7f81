"""Queries of trimming and of presence in two groups on the test tables."""

from __future__ import annotations

from ..catalog import register as add
from ..operators import trimming as o
from .reads import _P
from .statistics import _IN, _L, A, B, L
from .tables import rounded


def _mott(threshold: float, least: int) -> str:
    """Both ends by running sums over lists of qualities."""
    cut = f"CASE WHEN list_max(c) > 0 THEN list_position(c, list_max(c)) ELSE 0 END"
    sums = f"list_transform(range(1, len(p) + 1), lambda i: i * (list_sum(p) - {threshold}::DOUBLE * len(p)) - len(p) * list_sum(p[1:i]))"
    return (
        f"WITH r AS (SELECT id, upper(seq) AS seq, qual, {_P} AS p FROM reads), f AS (SELECT id, seq, qual, {cut} AS k FROM (SELECT *, {sums} AS c FROM r)), "
        f"g AS (SELECT id, substr(seq, k + 1) AS seq, substr(qual, k + 1) AS qual FROM f), h AS (SELECT *, list_reverse({_P}) AS p FROM g), "
        f"t AS (SELECT id, seq, qual, {cut} AS k FROM (SELECT *, {sums} AS c FROM h)) "
        f"SELECT id, substr(seq, 1, length(seq) - k) AS seq, substr(qual, 1, length(qual) - k) AS qual FROM t WHERE length(seq) - k >= {least}"
    )


add("fastq_mott_trimmer", lambda t: o.mott_trimmed(t.reads.select("id", "seq", "qual"), 5.0, 20), _mott(5.0, 20))
_AT5, _AT3 = "strpos(upper(seq), 'ACGTT') - 1", "CASE WHEN strpos(reverse(upper(seq)), 'TAACG') > 0 THEN length(seq) - strpos(reverse(upper(seq)), 'TAACG') + 1 - 5 ELSE -1 END"
add("nanopore_porechop", lambda t: o.adapters_located(t.reads, "ACGTT", "GCAAT", 40),
    f"SELECT *, trimmed_length >= 40 AS kept FROM (SELECT *, greatest(CASE WHEN adapter_3p > 0 THEN adapter_3p ELSE length END - greatest(adapter_5p + 1, 0), 0) AS trimmed_length FROM (SELECT id, length(seq) AS length, {_AT5} AS adapter_5p, {_AT3} AS adapter_3p FROM reads))")
add("msa_trim_columns", lambda t: o.gap_trimmed(t.gapped, 0.3),
    "WITH n AS (SELECT count(*) AS n FROM gapped), c AS (SELECT id, i, substr(seq, i, 1) AS b FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM gapped)), k AS (SELECT i FROM c GROUP BY i HAVING (SELECT n FROM n) - count(*) FILTER (WHERE b NOT IN ('-', '.')) <= 0.3 * (SELECT n FROM n)) "
    "SELECT g.id, coalesce(s.seq, '') AS seq FROM gapped g LEFT JOIN (SELECT id, string_agg(b, '' ORDER BY i) AS seq FROM c SEMI JOIN k USING (i) GROUP BY 1) s ON g.id = s.id")
_CH = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_P_OF = lambda k: f"exp({_CH(3, k)} + {_CH(3, f'(on_a + on_b - {k})')} - {_CH(6, '(on_a + on_b)')})"
add("differential_fisher_on_off", lambda t: rounded(o.on_off(L(t), A, B, 25.0), "odds", "p"),
    f"SELECT \"row\", on_a, on_b, round(on_a * (3 - on_b) / CAST(nullif((3 - on_a) * on_b, 0) AS DOUBLE), 4) AS odds, round(least(1.0, list_sum(list_filter(list_transform(range(greatest(0, on_a + on_b - 3), least(3, on_a + on_b) + 1), lambda k: {_P_OF('k')}), lambda v: v <= {_P_OF('on_a')} * 1.0000001))), 4) AS p "
    f"FROM (SELECT \"row\", count(*) FILTER (WHERE {_IN(A)} AND value > 25) AS on_a, count(*) FILTER (WHERE {_IN(B)} AND value > 25) AS on_b FROM {_L} GROUP BY 1)")


def _adapters(adapters: list[str], quality: int, least: int) -> str:
    """Cuts one after the other, then the low end."""
    sql = "SELECT id, upper(seq) AS seq, qual, length(seq) AS length, 0 AS adapters FROM reads"
    for a in adapters:
        sql = f"SELECT id, CASE WHEN strpos(seq, '{a}') > 0 THEN substr(seq, 1, strpos(seq, '{a}') - 1) ELSE seq END AS seq, qual, length, adapters + CAST(strpos(seq, '{a}') > 0 AS INT) AS adapters FROM ({sql})"
    last = chr(32 + quality).replace("'", "''")
    cut = f"SELECT *, length(seq) - length(regexp_extract(substr(qual, 1, length(seq)), '[!-{last}]*$')) AS n FROM ({sql})"
    whole = f"SELECT id, substr(seq, 1, n) AS seq, substr(qual, 1, n) AS qual, length, length - n AS removed, adapters, n FROM ({cut})"
    return f"SELECT id, seq, qual, length, removed, adapters, round(CASE WHEN qual <> '' THEN list_sum({_P}) / len({_P}) ELSE 0 END, 4) AS mean_quality, n >= {least} AS kept FROM ({whole})"


add("nanopore_trim_adapters", lambda t: rounded(o.adapter_trimmed(t.reads, ["ACGTT"], 7, 50).select("id", "length", "removed", "adapters", "mean_quality", "kept"), "mean_quality"),
    f"SELECT id, length, removed, adapters, mean_quality, kept FROM ({_adapters(['ACGTT'], 7, 50)})")
add("bbduk_trim", lambda t: o.adapter_trimmed(t.reads, ["ACGTT", "ggca"], 20, 25).where("kept").select("id", "seq", "qual"), f"SELECT id, seq, qual FROM ({_adapters(['ACGTT', 'GGCA'], 20, 25)}) WHERE kept")
_PRIMED = "SELECT id, seq, strpos(upper(seq), 'ACG') - 1 AS i, strpos(reverse(upper(seq)), 'GTTA') AS k FROM reads"
add("qiime_trim_primers", lambda t: o.primers_trimmed(t.reads, "ACG", "TAAC"),
    f"SELECT id, CASE WHEN i < 0 OR j < 0 THEN 'primer_not_found' ELSE 'trimmed' END AS status, CASE WHEN i < 0 OR j < 0 THEN -1 ELSE i + 3 END AS start, CASE WHEN i < 0 OR j < 0 THEN -1 ELSE greatest(i + 3, j) END AS stop, CASE WHEN i >= 0 AND j >= 0 THEN substr(upper(seq), i + 4, greatest(j - i - 3, 0)) END AS seq FROM (SELECT *, CASE WHEN k > 0 THEN length(seq) - k + 1 - 4 ELSE -1 END AS j FROM ({_PRIMED.replace('GTTA', 'ATTG')}))")
