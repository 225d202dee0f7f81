"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, groupjoin, langid, lexical, licenses, quality, runs, secrets, simhash, topk, toxicity
from .common import checkpointed, table
from .sample import fold, labelled_texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def vocabulary(spark: SparkSession):
    return bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole document, then decodes the ids; digests of both."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(spark), keep=["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and one of control strings, then reads the turns and the loss text back."""
    said = r"\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    messages = checkpointed(chat.threaded(rows))
    made = chat.format_conversations(messages)
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = made.join(messages.select(F.col("id").alias("root"), "conv_id"), "root").withColumns({"turns": chat.parsed("formatted"), "loss_text": chat.under_mask("formatted", "loss")})
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op2_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS nth FROM said
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS turns,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(regexp_replace(role, '([\\<#:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<#])', '\\\1', 'g')) + 15) AS chars
  FROM numbered GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM whole
"""


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and entropy spans of every whole document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [kind for kind, *_ in secrets.BASE]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def _secret_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    runs = []
    patterns = [(kind, p, group, least) for kind, p, group, least in secrets.BASE]
    patterns += [(c.kind, "[" + "".join("\\" + x if x in "+/=_-" else x for x in c.alphabet) + "]{" + str(c.window) + ",}", 0, c.window) for c in secrets.CLASSES]
    for i, (kind, p, group, least) in enumerate(patterns):
        runs.append(f"SELECT r, {i} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, {quoted(p)}) AS whole, regexp_extract_all(t, {quoted(p)}, {group}) AS part, regexp_split_to_array(t, {quoted(p)}) AS gaps FROM d")
    wanted = " OR ".join(
        f"(kind = '{c.kind}' AND bits >= {c.bits} AND regexp_matches(run, '[0-9]') AND NOT regexp_full_match(run, {quoted(secrets.ALLOW)})" + (" AND regexp_matches(run, '[a-z]') AND regexp_matches(run, '[A-Z]'))" if c.mixed else ")") for c in secrets.CLASSES
    )
    base = ", ".join(quoted(kind) for kind, *_ in secrets.BASE)
    window = secrets.CLASSES[0].window
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, *_ in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(runs)}),
flat AS (SELECT r, ord, kind, least, unnest(range(1, len(whole) + 1)) AS k, unnest(whole) AS run, unnest(part) AS part, unnest(list_slice(gaps, 1, len(whole))) AS gap FROM m WHERE len(whole) > 0),
placed AS (SELECT *, CAST(sum(length(gap) + length(run)) OVER (PARTITION BY r, ord ORDER BY k) AS BIGINT) AS stop FROM flat),
pieces AS (SELECT r, ord, k, piece, part AS run FROM (SELECT r, ord, k, unnest(range(1, len(parts) + 1)) AS piece, unnest(parts) AS part FROM (SELECT *, regexp_split_to_array(run, {quoted(secrets.HARMLESS)}) AS parts FROM placed WHERE kind NOT IN ({base}))) WHERE length(part) >= {window}),
chars AS (SELECT r, ord, k, piece, i, substr(run, i + j, 1) AS c FROM (SELECT *, unnest(range(1, {window} + 1)) AS j FROM (SELECT *, unnest(range(0, length(run) - {window} + 1)) AS i FROM pieces))),
entropy AS (SELECT r, ord, k, max(bits) AS bits FROM (SELECT r, ord, k, piece, i, -sum(n / {window} * log2(n / {window})) AS bits FROM (SELECT r, ord, k, piece, i, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
spans AS (
  SELECT r, ord, kind, stop - length(run) AS start, stop FROM placed WHERE kind IN ({base}) AND length(part) >= least
  UNION ALL SELECT r, ord, kind, stop - length(run), stop FROM placed JOIN entropy USING (r, ord, k) WHERE {wanted}
), listed AS (SELECT *, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS span FROM spans),
by_doc AS (SELECT r, {counts}, coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE kind IN ({base})), '') AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM listed GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (r)
"""


ORACLE_SQL["op4_secret_scan"] = _secret_sql()


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all benchmark items, by windows of 10 words."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Words, and windows of 10 words or of a whole shorter item.
ORACLE_SQL["op5_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, list_slice(w, k, k + 9) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM wins), places AS (
  SELECT r, k, n, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, k, n, item FROM places JOIN wins USING (win)),
counted AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (r) LEFT JOIN named USING (r)
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned outside fold 0 of 5."""
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.train(documents, folds=5, held=0), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; labels learned outside fold 1 of 3."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled_texts(documents, labels, "toxic", fold("doc_id", 3) != 1, toxicity.PER_LABEL, toxicity.LONGEST)
    found = toxicity.score(documents, toxicity.fit(rows), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def quality_ranker(spark: SparkSession, sf_dir: str) -> quality.Ranker:
    rows = labelled_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0, quality.PER_LABEL, quality.LONGEST)
    return quality.fit(rows)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document; labels learned outside fold 0 of 5."""
    found = quality.score(table(spark, sf_dir, "documents"), quality_ranker(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices in every whole document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["template"] < len(licenses.PHRASES))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def _license_sql() -> str:
    templates = licenses.PHRASES + licenses.NOTICES
    quoted = lambda w: "'" + w.decode() + "'"
    facts = ", ".join(f"({i}, '{t.label}', CAST({t.share} AS DOUBLE), {t.drift}, {t.k}, {len(t.words)})" for i, t in enumerate(templates))
    grams = ", ".join(f"({i}, {t.k}, {p}, [{', '.join(map(quoted, t.words[p : p + t.k]))}])" for i, t in enumerate(templates) for p in range(len(t.words) - t.k + 1))
    return rf"""
WITH facts(template, label, least, drift, k, size) AS (VALUES {facts}), grams(template, k, place, gram) AS (VALUES {grams}),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), ks AS (SELECT DISTINCT k FROM facts),
runs AS (SELECT r, k, p - 1 AS pos, list_slice(w, p, p + k - 1) AS gram FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
votes AS (SELECT r, template, pos, place, pos - place AS diagonal FROM runs JOIN grams USING (k, gram)),
gaps AS (SELECT votes.*, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > drift, false) AS apart FROM votes JOIN facts USING (template)),
merged AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY r, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS grp FROM gaps),
sized AS (SELECT r, template, grp, max(pos) + any_value(k) - min(pos) <= any_value(ceil(size / least)) AS fits FROM merged JOIN facts USING (template) GROUP BY ALL),
units AS (
  SELECT r, template, grp, diagonal, pos, place, NULL AS own FROM merged JOIN sized USING (r, template, grp) WHERE fits
  UNION ALL SELECT m.r, m.template, m.grp, m.diagonal, m.pos, m.place, cut.diagonal FROM merged m JOIN sized USING (r, template, grp) JOIN facts USING (template)
    JOIN (SELECT DISTINCT r, template, grp, diagonal FROM merged) cut ON cut.r = m.r AND cut.template = m.template AND cut.grp = m.grp
      AND m.diagonal BETWEEN cut.diagonal AND cut.diagonal + CAST(ceil(size / least) AS BIGINT) - size
  WHERE NOT fits
),
covered AS (SELECT r, template, grp, own, count(DISTINCT c) AS n FROM (SELECT r, template, grp, own, unnest(range(place, place + k)) AS c FROM units JOIN facts USING (template)) GROUP BY ALL),
ends AS (SELECT r, template, grp, own, min(pos) AS first_at FROM units GROUP BY ALL),
verified AS (
  SELECT r, template, label, grp, own, first_at, n / size AS share, CAST(ceil(size / least) AS BIGINT) - size AS slack FROM covered
  JOIN (SELECT r AS r2, template AS template2, grp AS grp2, own AS own2, first_at FROM ends) ON r = r2 AND template = template2 AND grp = grp2 AND own IS NOT DISTINCT FROM own2
  JOIN facts USING (template) WHERE n / size >= least
), spans AS (
  SELECT * FROM verified a WHERE own IS NULL OR NOT EXISTS (
    SELECT 1 FROM verified b WHERE b.r = a.r AND b.template = a.template AND b.grp = a.grp AND b.own BETWEEN a.own - a.slack AND a.own + a.slack
      AND (b.share > a.share OR (b.share = a.share AND b.own < a.own)))
), by_doc AS (
  SELECT r, count(*) FILTER (WHERE template < {len(licenses.PHRASES)}) AS n_base,
    min(first_at) FILTER (WHERE template < {len(licenses.PHRASES)}) AS first_word, max(first_at) FILTER (WHERE template < {len(licenses.PHRASES)}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE template < {len(licenses.PHRASES)}) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN by_doc USING (r)
"""


ORACLE_SQL["op9_license_scan"] = _license_sql()


@query
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


ORACLE_SQL["op10_topk_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM long q JOIN long c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _periodic_tails(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with the tails of documents with h % 10 = 0 made periodic, as the contract of operator 11 asks."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n, g = F.size("_words"), F.floor(h / 10)
    chosen = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    a = chosen.select("doc_id", "text", "_words", "_g", F.when(n > 0, F.pmod("_g", n)).alias("_a"))
    p = a.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    tail = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return p.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more of every whole document, and the documents without their repeats."""
    found = runs.periodic_runs(_periodic_tails(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length, period = -longest["less"], longest["period"]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 bit by bit; repeats at a distance q as islands of equal stretches of six words, of which every run has some.
ORACLE_SQL["op11_periodic_runs"] = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), [CAST(k AS BIGINT) for k in range(8)]), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) AS h
  FROM documents
), drawn AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM numbered
), d AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] for i in range(n)] END AS w FROM drawn
), grams AS (
  SELECT r, i, w[i + 1 : i + 6] AS gram FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 6)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), found AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), summed AS (
  SELECT r, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), (-length, start, period)) AS best,
    string_agg(CAST(start AS VARCHAR) || ',' || CAST(length AS VARCHAR) || ',' || CAST(period AS VARCHAR) || chr(10), '' ORDER BY start, period) AS listed
  FROM found GROUP BY r
), dropped AS (
  SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM found) GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM (
    SELECT words.r, words.i, word FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM d) words
    ANTI JOIN (SELECT r, unnest(gone) AS i FROM dropped) away ON words.r = away.r AND words.i = away.i
  ) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLE_SQL["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM b) GROUP BY ALL),
posted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
totals AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
weighted AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM posted, totals GROUP BY term),
sized AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM d, totals WHERE len(w) > 0),
scored AS (
  SELECT q, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN posted USING (term) JOIN weighted USING (term) JOIN sized USING (r) GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN b USING (q) WHERE rank <= 20
"""


@query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole documents with three-word shingle sets of Jaccard similarity 0.9 or more."""
    return groupjoin.similar_documents(table(spark, sf_dir, "documents"), width=3, share=0.9)
