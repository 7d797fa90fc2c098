"""The registered query of each operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import backoff_lm, best_fit, bpe_count, compression_langid, dart_minhash, decontaminate, importance, merkle, one_bit, pii, pivot_topk, quotes, wrapper
from emberline.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(prepare(spark), sf_dir)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_dart_minhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    return dart_minhash.near_classes(table(spark, sf_dir, "documents"))


@query
def op4_fm_index(spark, sf_dir):
    """Words of every document that lie in passages of the benchmark."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op4_fm_index"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
        FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
gram AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
         FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i
               FROM d CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT r, i, m, item_id FROM gram JOIN win USING (m, k)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit
           FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""


@query
def op3_compression_langid(spark, sf_dir):
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    learned = compression_langid.learn(docs.where(~compression_langid.held_out()).select("doc_id", "text", "lang"))
    return compression_langid.identify(docs.select("doc_id", "text"), learned).select(
        "doc_id", compression_langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"))


@query
def op1_best_fit(spark, sf_dir):
    """Bins of at most 2,048 words for every document, without two of a source or of a cluster in a bin."""
    return best_fit.pack(best_fit.measured(table(spark, sf_dir, "documents")))


@query
def op10_bpe_count(spark, sf_dir):
    """Tokens of every document under the public 32k piece model."""
    import public_tokenizers

    return bpe_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_crf_pii(spark, sf_dir):
    """Personal data of every document: counts and digest of the patterns' spans, and all spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def text_of(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])))

    def count(kind: str):
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(text_of("pii_base"), 256).alias("base_sha256"), text_of("pii_spans").alias("spans"),
        (F.size("pii_spans") - F.size("pii_base")).cast("long").alias("n_added"))


@query
def op8_backoff_lm(spark, sf_dir):
    """Log-probability of every document under a model of nine tenths of them."""
    return backoff_lm.score(table(spark, sf_dir, "documents")).select(
        "doc_id", backoff_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_wrapper(spark, sf_dir):
    """Main text of every page."""
    return wrapper.main_text(table(spark, sf_dir, "pages"))


@query
def op2_pivot_topk(spark, sf_dir):
    """The five largest inner products of every fiftieth vector with all others."""
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op2_pivot_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(
          list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(c.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op6_quotes(spark, sf_dir):
    """Every message of the conversations with what it answers and its text without quotations."""
    return quotes.link(table(spark, sf_dir, "conversations"))


ORACLES["op6_quotes"] = quotes.SQL


@query
def op11_importance(spark, sf_dir):
    """A quarter of the documents of 20 words or more, drawn by their likeness to the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance"] = r"""
WITH steps AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
                                       FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT row_number() OVER () AS r, 'd' AS side, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 'b', NULL, text FROM benchmark),
w AS (SELECT r, side, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM d),
f AS (SELECT r, side, unnest(w) AS f FROM w UNION ALL
      SELECT r, side, w[i] || ' ' || w[i + 1] FROM (SELECT r, side, w, unnest(range(1, len(w))) AS i FROM w)),
per AS (SELECT r, side, f, count(*) AS n FROM f GROUP BY ALL),
crc AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS k FROM (SELECT DISTINCT f FROM f), steps),
n AS (SELECT k, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM per JOIN crc USING (f) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM n) + 10000 AS DOUBLE)
        / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM n) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
      FROM per JOIN crc USING (f) JOIN g USING (k) WHERE side = 'd' GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM w LEFT JOIN m USING (r) WHERE side = 'd')
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n_all // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
             count(*) FILTER (n_words >= 20) OVER () AS n_all FROM x)
"""


@query
def op12_one_bit(spark, sf_dir):
    """The ten nearest vectors found for every hundredth vector."""
    return one_bit.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op12_one_bit"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op13_merkle(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and what a tampered leaf folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _field(text: str) -> str:
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


_LEAF = " || ".join(_field(c if c in ("source", "lang") else f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))

ORACLES["op13_merkle"] = f"""
WITH RECURSIVE
steps AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
                                       FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT doc_id, source, sha256({_LEAF} || {_field('text')}) AS leaf, sha256({_LEAF} || {_field("replace(text, chr(10), '')")}) AS torn,
             doc_id IS NOT NULL AND xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                                        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 2 = 0 AS hit
      FROM documents, steps),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
                  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
tree AS (SELECT s, 0 AS level, i, n, leaf AS node FROM leaves UNION ALL
         SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY s, level, i // 3, n),
subroots AS (SELECT s, node, level AS height FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, s AS i, count(*) OVER () AS n, node FROM subroots UNION ALL
        SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
up AS (SELECT s, i AS leaf_i, level, tree.i AS i, n FROM tree WHERE level = 0 UNION ALL
       SELECT s, leaf_i, level + 1, i // 3, (n + 2) // 3 FROM up WHERE n > 1),
run AS (SELECT up.s, leaf_i, up.level, coalesce(string_agg(node, '' ORDER BY tree.i) FILTER (tree.i < up.i), '') AS b,
               coalesce(string_agg(node, '' ORDER BY tree.i) FILTER (tree.i > up.i), '') AS a
        FROM up JOIN tree ON tree.s = up.s AND tree.level = up.level AND tree.i // 3 = up.i // 3 WHERE up.n > 1 GROUP BY ALL),
top_up AS (SELECT i AS s, level, i, n FROM top WHERE level = 0 UNION ALL SELECT s, level + 1, i // 3, (n + 2) // 3 FROM top_up WHERE n > 1),
top_run AS (SELECT u.s, u.level, coalesce(string_agg(node, '' ORDER BY top.i) FILTER (top.i < u.i), '') AS b,
                   coalesce(string_agg(node, '' ORDER BY top.i) FILTER (top.i > u.i), '') AS a
            FROM top_up u JOIN top ON top.level = u.level AND top.i // 3 = u.i // 3 WHERE u.n > 1 GROUP BY u.s, u.level, u.i),
paths AS (SELECT s, leaf_i, list(b || ',' || a ORDER BY level) AS p FROM run GROUP BY ALL),
top_paths AS (SELECT s, list(b || ',' || a ORDER BY level) AS p FROM top_run GROUP BY ALL),
done AS (SELECT leaves.*, subroots.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root,
                list_concat(coalesce(paths.p, []), coalesce(top_paths.p, [])) AS p
         FROM leaves JOIN subroots USING (s) LEFT JOIN paths ON paths.s = leaves.s AND leaf_i = leaves.i LEFT JOIN top_paths ON top_paths.s = leaves.s),
folded AS (SELECT *, list_reduce(p, lambda x, y: sha256(split_part(y, ',', 1) || x || split_part(y, ',', 2)), CASE WHEN hit THEN torn ELSE leaf END) AS f FROM done)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), ',', '')) AS proof_sha256, f AS folded_root, f = root AS verified FROM folded
"""
