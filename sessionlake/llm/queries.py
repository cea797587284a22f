"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import ann, chat, embdedup, fingerprints, langid, lexical, mixing, negatives, ngram, packing, quality, simhash, toxicity
from sessionlake.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"), "block", "first_shard", "second_shard")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels, crc_mod("doc_id", 4) != 2)
    scored = quality.score(docs, net, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    bag = toxicity.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, bag, ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op11_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors of one label with a cosine of 0.93 or more; null and odd rows as in embdedup.near_duplicates()."""
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector's positives; null and odd rows as in negatives.mine()."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; null and odd rows as in lexical.search()."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann, op2_mixing, op3_lm, op4_packing, op5_quality, op6_toxicity, op7_fingerprints, op8_langid, op9_chat, op10_simhash, op11_embdedup, op12_negatives, op13_lexical)
}

ESCAPED = "(length({x}) + length(regexp_replace({x}, '[^<\\[\\\\]', '', 'g')))"
SEGMENT = f"(13 + {ESCAPED.format(x='role')} + {ESCAPED.format(x='text')})"

#: op9 in DuckDB: digests over the turns, and the length of all windows by the same rules (budget 1024, history 256 and 3 turns, system 256, sections of 1024).
CHAT_SQL = f"""WITH raw AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, turn // 1024 AS section, CAST(ceil(strlen(text) / 4) AS BIGINT) + 4 AS tokens, {SEGMENT} AS seg FROM raw),
n AS (SELECT *, row_number() OVER w AS n, SUM(tokens) OVER w - tokens AS before FROM t WINDOW w AS (PARTITION BY conv_id, section ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CAST(before // 256 AS BIGINT) AS cell, before + tokens > (before // 256 + 1) * 256 AS leaves FROM n),
i AS (SELECT *, SUM(CASE WHEN leaves THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, section, cell) AS inside FROM c),
w AS (SELECT *, 2 * cell + CASE WHEN leaves AND inside > 0 AND inside + tokens > 512 THEN 1 ELSE 0 END AS win FROM i),
s AS (SELECT *, COALESCE(LAG(win) OVER o <> win, TRUE) AS starts FROM w WINDOW o AS (PARTITION BY conv_id, section ORDER BY n)),
l AS (SELECT *, LEAD(starts, 1) OVER o AS s1, LEAD(starts, 2) OVER o AS s2, LEAD(starts, 3) OVER o AS s3, LEAD(before, 1) OVER o AS b1, LEAD(before, 2) OVER o AS b2, LEAD(before, 3) OVER o AS b3, LEAD(win, 1) OVER o AS w1, LEAD(win, 2) OVER o AS w2, LEAD(win, 3) OVER o AS w3 FROM s WINDOW o AS (PARTITION BY conv_id, section ORDER BY n)),
u AS (SELECT conv_id, section, win, role, text, seg FROM l UNION ALL SELECT conv_id, section, w1, role, text, seg FROM l WHERE s1 AND b1 - before <= 256
  UNION ALL SELECT conv_id, section, w2, role, text, seg FROM l WHERE s2 AND b2 - before <= 256 UNION ALL SELECT conv_id, section, w3, role, text, seg FROM l WHERE s3 AND b3 - before <= 256),
f AS (SELECT conv_id, text AS system, seg AS system_seg, tokens AS system_tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY section, turn, text) AS k FROM t WHERE role = 'system') WHERE k = 1),
g AS (SELECT u.conv_id, section, win, SUM(seg) AS chars, bool_or(role = 'system' AND text = system) AS there, ANY_VALUE(system_seg) AS system_seg, ANY_VALUE(system_tokens) AS system_tokens FROM u LEFT JOIN f ON f.conv_id = u.conv_id GROUP BY 1, 2, 3),
x AS (SELECT conv_id, CAST(SUM(chars + CASE WHEN system_tokens <= 256 AND NOT COALESCE(there, FALSE) THEN system_seg ELSE 0 END) AS BIGINT) AS formatted_chars FROM g GROUP BY 1)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, ANY_VALUE(formatted_chars) AS formatted_chars
FROM raw JOIN x USING (conv_id) GROUP BY 1"""

SANE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: op11 in DuckDB: all pairs of a label, and the smallest id that chains of links reach.
EMBDEDUP_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND {SANE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, COUNT(*) AS n_links FROM p GROUP BY a), s AS (SELECT a, MIN(b) AS low FROM r GROUP BY a)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, least(vec_id, COALESCE(low, vec_id)) AS component_id, vec_id <= COALESCE(low, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN s ON s.a = vec_id"""

#: op12 in DuckDB: each anchor's scores, its first positives, and the windows under them.
NEGATIVES_SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {SANE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""

LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWER.format(x='text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: op13 in DuckDB: the sums of all postings.
LEXICAL_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS terms FROM documents WHERE text IS NOT NULL), t AS (SELECT COUNT(*) FILTER (WHERE len(terms) > 0) AS docs, SUM(len(terms)) AS total FROM d),
q AS (SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT row, doc_id, n, term, COUNT(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, COUNT(*) AS df FROM p GROUP BY term) CROSS JOIN t),
s AS (SELECT item_id, doc_id, row, CAST(SUM(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST(75 * n * docs AS BIGINT) // CAST(total AS BIGINT))))) AS BIGINT) AS score FROM p JOIN w USING (term) JOIN q USING (term) CROSS JOIN t GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10"""

ORACLES: dict[str, str] = {"op9_chat": CHAT_SQL, "op11_embdedup": EMBDEDUP_SQL, "op12_negatives": NEGATIVES_SQL, "op13_lexical": LEXICAL_SQL}
