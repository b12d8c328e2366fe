"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegrid.llm.circulant_minhash import minhash_components
from stridegrid.llm.collocations import collocations
from stridegrid.llm.common import held_out
from stridegrid.llm.cover_tree import hard_negatives
from stridegrid.llm.decontaminate import decontaminate, judged
from stridegrid.llm.html_text import extract_text
from stridegrid.llm.jaccard_join import jaccard_components
from stridegrid.llm.language import fit_language, predict_language
from stridegrid.llm.packing import pack
from stridegrid.llm.quality import fit_quality, score_quality
from stridegrid.llm.suffix_repeats import remove_repeats
from stridegrid.llm.topk import exact_topk
from stridegrid.llm.toxicity import fit_toxicity, score_toxicity
from stridegrid.llm.url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are 75 percent alike."""
    return jaccard_components(_table(spark, sf_dir, "documents"), words=5, percent=75)


OP6_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least ON a = doc_id
"""


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that start more than once."""
    found = remove_repeats(_table(spark, sf_dir, "documents"), length=200)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = _table(spark, sf_dir, "documents")
    found = predict_language(docs, fit_language(docs, ~held_out("doc_id", 3, 1)))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages of 13 words."""
    found = judged(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, gram.k, i FROM gram JOIN win ON gram.k = win.k AND gram.g = win.g),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from three of four folds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    found = score_quality(docs, model)
    return found.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "focus",
    )


#: The tokenizer file of the packing query.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens, sources mixed by their shares."""
    found = pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by integer inner product of every twentieth vector."""
    return exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: (verdict, host and path) of the url query.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every page url, with decisions carried to aliases."""
    found = filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, learned from three of four folds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    found = score_toxicity(docs, model)
    return found.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "severity", "grade", "p_toxic", "toxic"
    )


def _node_sql(url: str) -> str:
    return f"""CASE WHEN regexp_extract({url}, '://([^/?#]*)', 1) <> '' THEN
      translate(regexp_extract({url}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || CASE WHEN regexp_extract({url}, '://[^/?#]*([^?#]*)', 1) = '' THEN '/'
              ELSE regexp_extract({url}, '://[^/?#]*([^?#]*)', 1) END
      || regexp_extract({url}, '://[^?#]*(\\?[^#]*)', 1) END"""


_RULES_SQL = ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)
OP5_SQL = rf"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES {_RULES_SQL}),
page AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
clean AS (
  SELECT url, host, path, regexp_replace(html, '<!--.*?-->|<script\b.*?</script\b[^>]*>', ' ', 'gis') AS html
  FROM page WHERE regexp_matches(html, '(?i)canonical|refresh')),
target AS (
  SELECT url, host, path, regexp_extract(unnest(regexp_extract_all(html,
    '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1)), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS t FROM clean
  UNION ALL
  SELECT url, host, path, regexp_extract(unnest(regexp_extract_all(html,
    '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1)),
    '(?is)\bcontent\s*=\s*["'']?\s*(?:0+(?:\.0*)?|\.0+)[\s;,]+url\s*=\s*["'']?\s*([^"''\s>;]+)', 1) AS t FROM clean),
full_target AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t
    WHEN starts_with(t, '#') OR starts_with(t, '?') THEN 'http://' || host || path || t
    ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/'
      ELSE regexp_replace(path, '[^/]*$', '') END || t END AS t
  FROM (SELECT url, host, path, replace(t, '&amp;', '&') AS t FROM target) WHERE t <> ''),
edge AS (
  SELECT {_node_sql("url")} AS a, {_node_sql("t")} AS b FROM full_target),
sym AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(node, other) AS (SELECT a, b FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a),
other_rule AS (
  SELECT node, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT other AS node, split_part(other, '/', 1) AS host,
          regexp_extract('x://' || other, '://[^/?#]*([^?#]*)', 1) AS path FROM reach), rules
  WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY node),
said AS (
  SELECT r.node, CASE WHEN bool_or(o.verdict = 'allow') THEN 'allow' WHEN bool_or(o.verdict = 'block') THEN 'block' END AS said
  FROM reach r JOIN other_rule o ON r.other = o.node GROUP BY r.node),
own AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM page, rules
  WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(own.verdict, said.said, 'allow') AS verdict
FROM (SELECT *, {_node_sql("url")} AS node FROM page) LEFT JOIN own USING (n) LEFT JOIN said USING (node)
"""



def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets are 80 percent alike, and which row of each is kept."""
    return minhash_components(_table(spark, sf_dir, "documents"), words=2, percent=80)


OP11_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
  least(doc_id, coalesce(b, doc_id)) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least ON a = doc_id
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of 2 to 5 words of every language."""
    return collocations(_table(spark, sf_dir, "documents"), most=5, least=100, top=2000)


OP12_SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 6) AS s(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
cand AS (
  SELECT lang, k, phrase, f AS a FROM f AS x WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f AS y WHERE y.lang = x.lang AND y.k > x.k AND y.f >= x.f
      AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, n,
    ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM cand) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : j], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1 : ], ' ')
  JOIN total AS t ON t.lang = c.lang),
best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels just below the positives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
    list_sum(list_transform(list_zip(a.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
pos AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM pos AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_exact_topk": op4_exact_topk,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op4_exact_topk": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_circulant_minhash": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
