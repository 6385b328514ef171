"""One registered query per operator, over whole tables, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quartier.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents."""
    import public_tokenizers

    from quartier.llm.bpe import digests

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of the documents: counts and digest of the base kinds, and all spans."""
    from quartier.llm.secret_scan import joined, scan

    found = scan(read_table(spark, sf_dir, "documents"))
    return found.withColumn("spans", joined(found.spans))


ORACLE["op8_substring_dedup"] = r"""
WITH words AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS MATERIALIZED (
    SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)
), firsts AS MATERIALIZED (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > first
), flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
    FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that also start in an earlier one."""
    from quartier.llm.substring_dedup import dedup

    return dedup(read_table(spark, sf_dir, "documents"), texts=False)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of the documents."""
    from quartier.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item, with the tiles."""
    from quartier.llm.decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of the documents, learned from two thirds of them."""
    from quartier.llm.folds import held_out
    from quartier.llm.language import fit, predict

    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, ~held_out(3, 1)), {"held_out": held_out(3, 1)})


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of the documents, learned from labels of three quarters of them."""
    from quartier.llm.folds import held_out
    from quartier.llm.quality import fit, score

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels, ~held_out(4, 2)), {"held_out": held_out(4, 2)})


# Host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE["op3_url_filter"] = r"""
WITH rules(rhost, rpath, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
urls AS (
    SELECT page_id, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
           translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM hosts
)
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM urls LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest rule that fits each page's url."""
    from quartier.llm.url_filter import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(read_table(spark, sf_dir, "pages"), rules)


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log probability of the documents, learned from six sevenths of them."""
    from quartier.llm.folds import held_out
    from quartier.llm.language_model import score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, ~held_out(7, 2), {"held_out": held_out(7, 2)})


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    from pyspark.sql import functions as F

    from quartier.llm.neighbours import search

    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op11_merkle"] = r"""
WITH RECURSIVE rows AS MATERIALIZED (
    SELECT *, n_chars + (CASE WHEN hit THEN 1 ELSE 0 END) AS n_after FROM (
        SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 7 = 0, false) AS hit
        FROM documents)
), parts AS (
    SELECT doc_id, lang, hit, n_after, n_chars,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM rows
), leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, hit, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                 sha256(head || coalesce(strlen(n_after::VARCHAR) || ':' || n_after, '-') || tail) AS altered
          FROM parts)
), nodes AS (
    SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
    GROUP BY lang, lvl, n, pos // 2
), subroots AS MATERIALIZED (SELECT lang, lvl AS height, h FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1
    GROUP BY lvl, n, pos // 2
), places AS (SELECT lang, height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM subroots),
walk AS (
    SELECT l.doc_id, l.lang, l.leaf, l.hit, 0 AS lvl, l.pos AS pos, p.height, p.place, p.subroot, '' AS proof,
           CASE WHEN l.hit THEN l.altered ELSE l.leaf END AS node
    FROM leaves l JOIN places p ON l.lang IS NOT DISTINCT FROM p.lang
    UNION ALL
    SELECT doc_id, w.lang, leaf, hit, w.lvl + 1, CASE WHEN w.lvl + 1 = height THEN place ELSE w.pos // 2 END, height, place,
           subroot, proof || coalesce(s.h, ''),
           sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || node ELSE node || coalesce(s.h, '') END)
    FROM walk w LEFT JOIN nodes s ON w.lang IS NOT DISTINCT FROM s.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
    WHERE w.lvl < height
), crowns AS (
    SELECT doc_id, leaf, subroot, 0 AS lvl, place AS pos, proof, node FROM walk WHERE lvl = height
    UNION ALL
    SELECT doc_id, leaf, subroot, w.lvl + 1, w.pos // 2, proof || coalesce(s.h, ''),
           sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || node ELSE node || coalesce(s.h, '') END)
    FROM crowns w LEFT JOIN tops s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
    WHERE w.lvl < (SELECT max(lvl) FROM tops)
)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = (SELECT h FROM tops WHERE n = 1) AS verified
FROM crowns WHERE lvl = (SELECT max(lvl) FROM tops)
"""


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and the root of the version in which a seventh of them is altered."""
    from pyspark.sql import functions as F

    from quartier.llm.merkle import manifest

    docs = read_table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, hit, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    digests = F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    return rows.select("doc_id", "leaf", "subroot", "root", *digests)


ORACLE["op13_hard_negatives"] = r"""
WITH items AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scores AS MATERIALIZED (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, b.label = a.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM items a JOIN items b ON a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
    SELECT ar, anchor_id, vec_id AS positive_id, r AS pr, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, vec_id, r)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.ar = s.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, vec_id, r) <= 10
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 30 to 90 percent of an anchor's positives; a seventh of the labels shifted."""
    from pyspark.sql import functions as F

    from quartier.llm.hard_negatives import mine

    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(read_table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, with a checksum of their ids."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from quartier.llm.packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
