"""The queries of the training-data operators over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoding_digests
from tidemark.llm.collocations import collocations
from tidemark.llm.common import table
from tidemark.llm.decontaminate import contained_items
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.kd_search import top_k
from tidemark.llm.licences import BLANK, COMMENT_END, CUES, HOLDER, SENTENCE, TEMPLATES, TERM, THRESHOLD, licences, template_table
from tidemark.llm.lm import text_scores
from tidemark.llm.near_vectors import near_vectors
from tidemark.llm.pii import with_surrogates
from tidemark.llm.token_files import token_file_digests
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.url_filter import canonical, judged_urls, url_host, url_path
from tidemark.llm.whitening import whitened


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain 80 % or more of the 5-word shingles of a benchmark item."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Verdict and rule, host before the first slash.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; listed are the canonical URLs of pages that were reached by a feed or referral link."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").rlike(r"[?&](?:utm_source|ref)="))
    return judged_urls(pages, listed.select(canonical(url_host(F.col("url")), url_path(F.col("url"))).alias("key")), URL_RULES)


def op8_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth embedding with all others, on integer vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labelled rows that are not held out."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of the texts decoded from them."""
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_hpyp_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a hierarchical Pitman-Yor model of the documents that are not held out."""
    return text_scores(table(spark, sf_dir, "documents"))


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from rANS token files."""
    return token_file_digests(table(spark, sf_dir, "documents"), tokenizer_path())


#: The key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = b"tidemark surrogate key"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates, and the number of mentions replaced."""
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, count_col="n_entities")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own or inherited licences of all documents, filed by source, language and hundreds of ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licences(files, template_table(spark)).withColumnRenamed("file_id", "doc_id")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language among those of two to five words that occur 100 times or more."""
    return collocations(table(spark, sf_dir, "documents"), least=100, share=100, limit=2000)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.9 or more, and the smallest id that each one reaches."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, as integers, on their first 32 components, each with a variance of one."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_hpyp_lm": op5_hpyp_lm,
    "op6_rans": op6_rans,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_kd_top_k": op8_kd_top_k,
    "op9_licences": op9_licences,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_NORMAL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _cue(text: str) -> str:
    def held(c: str) -> str:
        return f"regexp_matches(lower({text}), '{c}')" if c[0] == "\\" else f"contains(lower({text}), '{c}')"

    return "(" + " OR ".join("(" + " AND ".join(map(held, parts)) + ")" for parts in CUES) + ")"


def _wording(text: str) -> str:
    plain = rf"replace(regexp_replace(lower({text}), '{HOLDER}', ' \1', 'g'), 'licence', 'license')"
    return f"array_to_string(regexp_extract_all({plain}, '{TERM}'), ' ')"


SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS ws FROM documents), b AS (
  SELECT item_id, ws, least(5, len(ws)) AS w FROM (SELECT item_id, {_NORMAL} AS ws FROM benchmark) WHERE len(ws) > 0),
i AS (SELECT item_id, w, unnest(list_distinct(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' ')))) AS g FROM b),
d AS (
  SELECT doc_id, w, unnest(list_distinct(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' ')))) AS g
  FROM t JOIN (SELECT DISTINCT w FROM b) ON len(ws) >= w),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, i.item_id, count(*) AS shared, any_value(n.n) AS item_shingles
FROM i JOIN d USING (w, g) JOIN n ON n.item_id = i.item_id
GROUP BY doc_id, i.item_id HAVING 100 * count(*) >= 80 * any_value(n.n)
""",
    "op2_url_filter": r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
k AS (SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:\.html|/+)$', '') AS key FROM u),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(url, '[?&](?:utm_source|ref)=')),
r(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM k JOIN r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p) GROUP BY page_id)
SELECT k.page_id, host, path, rule, coalesce(v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
FROM k LEFT JOIN f USING (page_id) LEFT JOIN l ON l.key = k.key
""",
    "op8_kd_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_licences": f"""
WITH t(template, licence, line, needs) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(TEMPLATES))}),
d AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR), doc_id || '.txt') AS path,
    concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR)) AS dir, coalesce(text, '') AS text FROM documents),
r AS (
  SELECT doc_id, dir, length(text) AS chars, unnest(list_distinct(list_concat(list_concat(
    string_split(text, chr(10)), string_split(regexp_replace(text, '{SENTENCE}', '\\1' || chr(10) || '\\2', 'g'), chr(10))),
    string_split_regex(regexp_replace(text, '(?m){COMMENT_END}', '\\1' || chr(10) || chr(10) || '\\2', 'g'), '{BLANK}')))) AS unit
  FROM d WHERE {_cue("text")}),
l AS (SELECT doc_id, dir, chars, length(unit) AS size, {_wording("unit")} AS words FROM r WHERE {_cue("unit")}),
w AS (SELECT DISTINCT words FROM l WHERE words <> ''),
ov AS (SELECT words, term, count(*) AS tf FROM (SELECT words, unnest(string_split(words, ' ')) AS term FROM w) GROUP BY ALL),
tv AS (
  SELECT template, licence, needs, term, count(*) AS tf
  FROM (SELECT template, licence, needs, unnest(string_split({_wording("line")}, ' ')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM tv GROUP BY term),
ow AS (SELECT words, term, tf * coalesce(idf, 1) AS w FROM ov LEFT JOIN idf USING (term)),
tw AS (SELECT template, licence, string_split(needs, ' ') AS needs, term, tf * idf AS w FROM tv JOIN idf USING (term)),
c AS (
  SELECT words, licence, round(sum(ow.w * tw.w) / (any_value(o.norm) * any_value(x.norm)), 9) AS cosine
  FROM ow JOIN tw USING (term) JOIN (SELECT words, sqrt(sum(w * w)) AS norm FROM ow GROUP BY words) o USING (words)
  JOIN (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template) x USING (template)
  GROUP BY words, template, licence, needs HAVING count(*) FILTER (WHERE list_contains(needs, term)) = len(needs)),
b AS (
  SELECT words, arg_min(struct_pack(g := CAST(licence = 'Proprietary' AS INT), less := -cosine, licence := licence),
    (CAST(licence = 'Proprietary' AS INT), -cosine, licence)) AS best
  FROM c WHERE cosine >= {THRESHOLD} GROUP BY words),
own AS (
  SELECT doc_id, dir, arg_min(best, (best.g, best.less, best.licence)) AS best, bool_or(2 * size >= chars) AS half FROM l JOIN b USING (words)
  GROUP BY doc_id, dir),
f AS (SELECT dir AS source_dir, arg_min(best, (best.g, best.less, best.licence)) AS best FROM own WHERE half GROUP BY dir),
near AS (
  SELECT doc_id, source_dir, f.best, row_number() OVER (PARTITION BY doc_id ORDER BY length(source_dir) DESC) AS r
  FROM d JOIN f ON d.dir = f.source_dir OR starts_with(d.dir, f.source_dir || '/'))
SELECT d.doc_id, d.path, coalesce(own.best.licence, near.best.licence) AS licence, -coalesce(own.best.less, near.best.less) AS cosine,
  CASE WHEN own.doc_id IS NOT NULL THEN 'own' WHEN near.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own.doc_id IS NULL THEN source_dir END AS source_dir
FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id AND near.r = 1
""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.reached = p.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(reached) AS component_id
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(g)
""",
    "op11_phrase_collocations": rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS p FROM w, range(1, 6) AS x(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, p, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
i AS (
  SELECT lang, p, max(a) AS longer FROM (
    SELECT lang, a, unnest([p[1:k - 1], p[2:k]]) AS p FROM f WHERE k > 2)
  GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN i USING (lang, p) WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
u AS (SELECT lang, p, a, unnest(range(1, k)) AS cut FROM c),
v AS (
  SELECT u.lang, u.p, u.a, cut, l.a AS l, r.a AS r, n.n, CAST(1000 * CAST(u.a AS HUGEINT) * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.p = u.p[1:cut] JOIN f r ON r.lang = u.lang AND r.p = u.p[cut + 1:] JOIN n ON n.lang = u.lang),
m AS (SELECT lang, p, a, n, arg_min(struct_pack(score := score, l := l, r := r), (score, cut)) AS b FROM v GROUP BY lang, p, a, n),
o AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, b.l AS l, b.r AS r, n, b.score AS score,
    row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank
  FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE r AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v AS (
  SELECT i, vec_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda y: y * y)))) AS x FROM r
  WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
p AS (
  SELECT a.i AS a, b.i AS b, b.vec_id AS other FROM v a JOIN v b ON a.i <> b.i AND len(a.x) = len(b.x)
    AND list_sum(list_transform(range(1, len(a.x) + 1), lambda k: a.x[k] * b.x[k])) >= 0.9),
c(i, reached, vec_id) AS (SELECT i, i, vec_id FROM r UNION SELECT c.i, p.b, p.other FROM c JOIN p ON c.reached = p.a),
l AS (SELECT a AS i, count(*) AS n FROM p GROUP BY a)
SELECT r.vec_id, coalesce(any_value(l.n), 0) AS n_links, min(c.vec_id) AS component_id, coalesce(min(c.vec_id) = r.vec_id, false) AS kept
FROM r JOIN c ON c.i = r.i LEFT JOIN l ON l.i = r.i GROUP BY r.i, r.vec_id
""",
}
