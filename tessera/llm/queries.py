"""The registered queries of the subpackage: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, exact, hard_negatives, html_tree, lang_id, minhash, piece_bpe, pii, prefix_trie, repeats, toxicity, warc
from tessera.llm.common import table

items: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None):
    def keep(fn):
        items[fn.__name__] = (fn, sql)
        return fn
    return keep


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register()
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = lang_id.fold("doc_id", 3) == 1
    model = lang_id.fit(docs.filter(~held_out))
    return lang_id.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@register(r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 3], ' ')) AS g
      FROM w, unnest(range(1, greatest(len(words) - 2, 2))) AS u(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b USING (g)
           WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
         WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
""")
def op2_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@register()
def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lang_id.fold("doc_id", 4) == 2
    scorer = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.scored(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_telling")


@register(f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
""")
def op5_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@register("""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(words)) AS n,
               array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS gram
        FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS gram
          FROM w, sizes, unnest(range(1, len(words) - n + 2)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM grams JOIN win USING (n, gram)),
n_hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op3_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register()
def op6_byte_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN,
                      finish=bpe.digest_rows,
                      schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


@register()
def op7_pii_pseudonyms(spark, sf_dir):
    return pii.pseudonyms(table(spark, sf_dir, "documents"), key=b"replace this key in earnest use")


@register()
def op8_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_tree.main_text(pages, html_tree.fit(pages), keep=("url",))


@register()
def op9_suffix_dedup(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@register("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, h, max(page_id) OVER (PARTITION BY h) AS first_id,
             list_transform(range(0, 160),
                 lambda i: ((('0x' || sha1(h)[(i // 4) + 1])::INTEGER >> (3 - i % 4)) & 1)) AS bits FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(bits[5*k+1] * 16 + bits[5*k+2] * 8 + bits[5*k+3] * 4
                                               + bits[5*k+4] * 2 + bits[5*k+5] + 1)::INTEGER]), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
""")
def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@register()
def op12_sentencepiece(spark, sf_dir):
    return piece_bpe.encode(table(spark, sf_dir, "documents"), PIECES, finish=piece_bpe.digest_rows,
                            schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


@register("""
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id,
             list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e AS a, e AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
        FROM pos JOIN s USING (anchor_id)
        WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
""")
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


@register("""
WITH RECURSIVE own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM own GROUP BY ALL),
bits AS (SELECT conv_id, s, 0 AS i, 4294967295::BIGINT AS c FROM ids
    UNION ALL
    SELECT conv_id, s, i + 1, xor(c0 >> 1, CASE WHEN c0 & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
    FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS c0
          FROM bits WHERE i < 8 * length(s))),
h AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h, conv_id - conv_id % 100 AS base
      FROM bits WHERE i = 8 * length(s)),
lent AS (SELECT h.conv_id, h, base, least(h, coalesce(n, 0)) AS k FROM h LEFT JOIN ids ON ids.conv_id = base),
seq AS (SELECT lent.conv_id, p, role, text FROM lent JOIN own ON own.conv_id = base WHERE p < h
    UNION ALL SELECT conv_id, p - h + k, role, text FROM own JOIN lent USING (conv_id) WHERE p >= h),
pre AS (SELECT conv_id, p + 1 AS d, length(text) AS size,
               string_agg(length(role) || ':' || length(text) || ':' || role || text, '|')
                   OVER (PARTITION BY conv_id ORDER BY p) AS key
        FROM seq UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
m AS (SELECT conv_id, max(d) AS m FROM pre GROUP BY conv_id),
node AS (SELECT key, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size
         FROM pre GROUP BY key),
up AS (SELECT node.key, pre.key AS parent FROM node JOIN pre ON pre.conv_id = node.conv_id AND pre.d = node.d - 1),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
totals AS (SELECT pre.key, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * f.size)::BIGINT AS saved_tokens
           FROM full_node AS f JOIN pre ON pre.conv_id = f.conv_id AND pre.d <= f.d GROUP BY pre.key),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
         FROM pre JOIN m USING (conv_id) WHERE d = m GROUP BY key)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_node AS f JOIN totals USING (key) LEFT JOIN ends USING (key) LEFT JOIN up USING (key)
     LEFT JOIN node AS p ON p.key = up.parent
""")
def op13_prefix_trie(spark, sf_dir):
    turns = prefix_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_borrowed_starts(turns))
