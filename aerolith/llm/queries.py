"""The numbered operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import chat, clustering, divergence, exact_dedup, langid, lexicon, licenses, near_dedup, packing, pii, quality_model, rules, secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.corpus_paths(_table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], turns.schema)
    return chat.digest(chat.reconstruct(chat.events(turns.union(more))))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = langid.predict(docs, langid.train(docs))
    return scored.select("doc_id", langid.held_out(scored.doc_id).alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(secret_scan.with_owners(_table(spark, sf_dir, "documents")), "repo", "owner")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_licenses, op2_quality, op3_near_dedup, op4_rules, op5_packing, op6_pii, op7_chat, op8_exact_dedup, op9_langid, op10_bpe, op11_divergence, op12_clustering, op13_secrets)
}

_OP4_BASE = r"""
words AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
lines AS (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words
),
threes AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
),
twice AS (SELECT doc_id, g FROM threes GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT t.doc_id, unnest([t.i, t.i + 1, t.i + 2]) AS p FROM threes t JOIN twice USING (doc_id, g))
    GROUP BY doc_id
),
base AS (
    SELECT w.doc_id, w.source, len(w.w)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM words w JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
weighted AS (
    SELECT m, greatest(CASE WHEN v > 0 AND m * (1 - m) > v THEN least(m * (1 - m) / v - 1, 1e6) ELSE 1.0 END, 1.0) AS w FROM prior
),
verdicts AS (SELECT source, (f + m * w) / (n + w) > 0.5 AS rejected FROM hosts, weighted)
"""

_OP8 = """
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN (
    SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM documents GROUP BY 1
) k ON coalesce(d.text, '') = k.t
"""

_OP7 = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARE = "1 + 1000000000::HUGEINT*({n} + 2) // ({total} + 2*{terms})"
_FAR = "(({p}) - ({q}))*(({p}) - ({q})) // (({p}) + ({q}))"

_OP11 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
words AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
here AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY 1),
every AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(h.n, 0) AS n
          FROM groups g JOIN kept k USING (lang) LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM every GROUP BY 1, 2),
shares AS (SELECT e.lang, e.source, e.term, e.n, {_SHARE.format(n="e.n", total="t.total", terms="l.terms")} AS p,
                  {_SHARE.format(n="e.lang_n", total="l.total", terms="l.terms")} AS q
           FROM every e JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({_FAR.format(p="a.p", q="b.p")}) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
rows AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, {_FAR.format(p="p", q="q")} FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""



def _op12(rounds: int = 10) -> str:
    """Vectors as a row for each component; each round is three tables."""
    near = """d{r} AS MATERIALIZED (SELECT x.k, c.cl, sum((x.x - c.x)*(x.x - c.x)) AS far FROM x JOIN c{r} c ON x.i = c.i GROUP BY 1, 2),
    a{r} AS MATERIALIZED (SELECT k, cl, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY far, cl) = 1)"""
    mean = """c{n} AS MATERIALIZED (SELECT c.cl, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT a.cl, x.i, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{r} a JOIN x USING (k) GROUP BY 1, 2) m ON m.cl = c.cl AND m.i = c.i)"""
    steps = [s.format(r=r, n=r + 1) for r in range(rounds) for s in (near, mean)] + [near.format(r=rounds)]
    return f"""
WITH e AS MATERIALIZED (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
x AS MATERIALIZED (SELECT k, unnest(range(1, 65)) AS i, unnest(v)::HUGEINT AS x FROM e),
c0 AS MATERIALIZED (SELECT s.cl, x.i, x.x FROM x JOIN (SELECT k, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cl FROM e QUALIFY cl < 8) s USING (k)),
{", ".join(steps)},
shown AS (SELECT cl, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY 1)
SELECT e.vec_id, a.cl::INT AS cluster, a.far::BIGINT AS distance, (sum(a.far) OVER (PARTITION BY a.cl))::BIGINT AS cluster_inertia,
       (sum(a.far) OVER ())::BIGINT AS inertia, s.s AS centroid_sha256
FROM a{rounds} a JOIN e USING (k) JOIN shown s ON s.cl = a.cl
"""


ORACLE_SQL: dict[str, str] = {
    "op4_rules": f"WITH {_OP4_BASE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,"
    " NOT base_failed AND NOT rejected AS kept FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source",
    "op7_chat": _OP7,
    "op8_exact_dedup": _OP8,
    "op11_divergence": _OP11,
    "op12_clustering": _op12(),
}
