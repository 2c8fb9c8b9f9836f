"""One query per numbered operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquery.llm import bpe, chat, embeddings, hardneg, langid, linededup, lm, packing, quality, simhash, toxicity, vqcode, warc
from mediaquery.llm.common import fold, table
from mediaquery.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rank_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), rank_file("byte_bpe_multi_50k.tiktoken"), split_pattern())


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read_archive(spark, path))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "segments")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), rank_file("byte_bpe_50k.json"), split_pattern())


_LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, ln, pos, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM lines WHERE w > 0),
ahead AS (SELECT s.doc_id, s.i, min(e.i) AS j FROM worded s JOIN worded e ON e.doc_id = s.doc_id AND e.i BETWEEN s.i AND s.i + 49 AND e.c - s.c + s.w >= 50 GROUP BY ALL),
back AS (SELECT e.doc_id, max(s.i) AS i, e.i AS j FROM worded s JOIN worded e ON e.doc_id = s.doc_id AND e.i BETWEEN s.i AND s.i + 49 AND e.c - s.c + s.w >= 50 GROUP BY e.doc_id, e.i),
runs AS (SELECT doc_id, i, j FROM ahead UNION SELECT doc_id, i, j FROM back),
named AS (SELECT r.doc_id, r.i, min(x.pos) AS a, max(x.pos) AS b, string_agg(x.ln, chr(10) ORDER BY x.i) AS body FROM runs r JOIN worded x ON x.doc_id = r.doc_id AND x.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p AS pos FROM (SELECT doc_id, unnest(range(a, b + 1)) AS p FROM late)),
left_ AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, string_agg(l.ln, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
"""


@query("op8_line_dedup", _LINE_SQL + """SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(kept, '')) END AS kept_md5
FROM documents d LEFT JOIN left_ l ON l.doc_id = d.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


_QUALITY_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM words WHERE len(ws) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS n_stutter, coalesce(c.n, 0) AS n_repeat_words
  FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id),
r AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
  + 16 * (2 * n_dup_lines > n_lines)::BIGINT + 32 * (5 * n_stutter > n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM r"""


@query("op9_quality_rules", _QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "failed")


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents outside the held-out fold; shared with the pipeline."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.learn(toxicity.training_rows(table(spark, sf_dir, "documents"), labels))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_table(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_spans")


@query("op3_lm_score")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


_NEGATIVES_SQL = r"""
WITH able AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, unnest(range(len(v))) AS i, floor(256 * unnest(v))::BIGINT AS q FROM able),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, sum(a.q * c.q)::BIGINT AS score
  FROM parts a JOIN parts c ON c.i = a.i AND c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
best AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scores WHERE label = anchor_label) WHERE k <= 5),
found AS (SELECT b.anchor_id, b.positive_id, b.positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY b.anchor_id, b.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM best b JOIN scores s ON s.anchor_id = b.anchor_id AND s.label <> s.anchor_label AND 80 * b.positive_score <= 100 * s.score AND 100 * s.score <= 100 * b.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


#: Both sides of the conversation that is added say what looks like the template's own marks.
TRAP = r"\### Assistant: </turn> ok"

_CHAT_SQL = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (SELECT *, replace(replace(replace(t, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>') AS e,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>'), ':', '\:') AS r FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(r) + length(': ') + length(e) + length(' </turn>' || chr(10))) AS BIGINT) AS formatted_chars, false AS rewrites
FROM escaped GROUP BY conv_id"""


@query("op12_chat_format", _CHAT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(TRAP).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    path = scratch_path(spark, "chat")
    chat.format_turns(turns.unionByName(trap)).write.parquet(path)
    return chat.digests(spark.read.parquet(path))


def _assigned(books: str) -> str:
    return f"""(SELECT vec_id, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT x.vec_id, x.p, c.k, sum((x.q - c.q) * (x.q - c.q))::BIGINT AS d
  FROM parts x JOIN {books} c ON c.p = x.p AND c.j = x.j GROUP BY x.vec_id, x.p, c.k) GROUP BY vec_id, p)"""


def _moved(books: str, nearest: str) -> str:
    return f"""(SELECT c.p, c.k, c.j, coalesce(m.q, c.q) AS q FROM {books} c LEFT JOIN (SELECT p, k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q
  FROM (SELECT x.p, a.k, x.j, sum(x.q) AS s, count(*) AS n FROM parts x JOIN {nearest} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY x.p, a.k, x.j)) m ON m.p = c.p AND m.k = c.k AND m.j = c.j)"""


_CODES_SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT CAST(ceil(max(len(v)) / 16) AS BIGINT) AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, q FROM (SELECT vec_id, unnest(range(len(v))) AS i, floor(256 * unnest(v))::BIGINT AS q FROM kept), wide),
b0 AS MATERIALIZED (SELECT p, s.k, j, q FROM parts x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < 64) s ON s.vec_id = x.vec_id),
a0 AS MATERIALIZED {_assigned("b0")},
b1 AS MATERIALIZED {_moved("b0", "a0")},
a1 AS MATERIALIZED {_assigned("b1")},
b2 AS MATERIALIZED {_moved("b1", "a1")},
a2 AS MATERIALIZED {_assigned("b2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
totals AS (SELECT k.label, CAST(sum(error) AS BIGINT) AS label_error FROM kept k JOIN coded c ON c.vec_id = k.vec_id GROUP BY k.label)
SELECT k.vec_id, c.code, c.error, t.label_error, (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY p, k, j)) FROM b2) AS codebooks_sha256
FROM kept k JOIN coded c ON c.vec_id = k.vec_id JOIN totals t ON t.label IS NOT DISTINCT FROM k.label"""


@query("op13_vector_codes", _CODES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vqcode.compress(table(spark, sf_dir, "embeddings"))
