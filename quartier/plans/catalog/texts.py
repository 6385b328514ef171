"""Queries on text: tokens, n-grams, hash buckets, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.functions.text import tokens
from quartier.operators import segment, textfeatures
from quartier.plans.catalog.registry import LISTINGS, query, r, rounded
from quartier.session import spread
from quartier.sources.listings import clean_listings
from quartier.sources.tables import read_table

# WITH-list entries restating the tokenizers.
TOKENS = r"t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)"
GRAMS = (
    "g AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id,"
    " unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t WHERE len(w) >= 2)"
)


@query(
    "tokenize_words",
    f"WITH {TOKENS} SELECT doc_id, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS token FROM t",
)
def tokenize_words(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


@query(
    "word_ngrams",
    f"WITH {TOKENS}, {GRAMS}, h AS (SELECT * FROM g UNION ALL SELECT doc_id, unnest(list_transform("
    "range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM t WHERE len(w) >= 3)"
    " SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM h GROUP BY 1",
)
def word_ngrams(spark, d):
    docs = spread(read_table(spark, d, "documents").select("text"))
    return textfeatures.term_counts(docs, "text", "word", 1, 3, scan=True)


def _char_wb_sql(low: int, high: int) -> str:
    parts = []
    for n in range(low, high + 1):
        fits = "" if n == low else f" WHERE len(p) >= {n}"
        parts.append(
            f"SELECT id, unnest(list_transform(range(1, greatest(len(p) - {n - 1}, 1) + 1),"
            f" lambda i: substr(p, i, {n}))) AS gram FROM w{fits}"
        )
    return " UNION ALL ".join(parts)


BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+"


@query(
    "char_wb_ngrams",
    f"WITH w AS (SELECT id, ' ' || word || ' ' AS p FROM (SELECT doc_id AS id, unnest(regexp_split_to_array("
    f"lower(text), '{BLANKS}')) AS word FROM documents) WHERE word <> ''), g AS ({_char_wb_sql(3, 5)})"
    " SELECT gram, count(*) AS tf FROM g GROUP BY 1",
)
def char_wb_ngrams(spark, d):
    docs = spread(read_table(spark, d, "documents").select("text"))
    return textfeatures.char_counts(docs, "text", 3, 5)


_HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query(
    "hashed_ngrams_long",
    f"WITH {TOKENS}, {GRAMS}, c AS (SELECT doc_id, ({_HASH.format('term')} % 1024)::INTEGER AS bucket,"
    " count(*)::DOUBLE AS n FROM g GROUP BY 1, 2)"
    f" SELECT doc_id, bucket, {r('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))', 9)} AS weight FROM c",
)
def hashed_ngrams_long(spark, d):
    docs = read_table(spark, d, "documents")
    return rounded(textfeatures.hashed_ngrams(docs, "doc_id", "text", 1024), 9)


_CONFIGS = {
    "word 1": ("word", 1, 1), "word 1-2": ("word", 1, 2), "word 1-3": ("word", 1, 3), "char 3-5": ("char_wb", 3, 5),
}
_SIZES = [64, 256, 1024, 4096, 16384]


@query(
    "hash_collision_profile",
    rf"""WITH {LISTINGS}, t AS (SELECT listing_id AS doc_id, regexp_extract_all(lower(address), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM l),
{GRAMS}, w AS (SELECT id, ' ' || word || ' ' AS p FROM (SELECT listing_id AS id, unnest(regexp_split_to_array(
lower(address), '{BLANKS}')) AS word FROM l) WHERE word <> ''), cg AS ({_char_wb_sql(3, 5)}),
g3 AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term
 FROM t WHERE len(w) >= 3),
a AS (SELECT DISTINCT 'word 1' AS config, unnest(w) AS term FROM t UNION ALL SELECT DISTINCT 'word 1-2', term FROM g
 UNION ALL SELECT DISTINCT 'word 1-3', term FROM (SELECT term FROM g UNION ALL SELECT term FROM g3)
 UNION ALL SELECT DISTINCT 'char 3-5', gram FROM cg)
SELECT config, n::INTEGER AS n_features, count(*) AS terms, count(DISTINCT {_HASH.format('term')} % n) AS used
FROM a CROSS JOIN (VALUES {', '.join(f'({n})' for n in _SIZES)}) s(n) GROUP BY 1, 2""",
)
def hash_collision_profile(spark, d):
    return textfeatures.collision_profile(clean_listings(spark, d), "address", _CONFIGS, _SIZES)


_VOCAB = f"""{TOKENS}, {GRAMS}, c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 3
      ORDER BY tf DESC, term LIMIT 4000),
i AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v)"""
_WEIGHTS = f"""{_VOCAB}, x AS (SELECT doc_id, term, c.tf * idf AS w FROM c JOIN i USING (term)),
k AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM x)"""


def _tfidf(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text", "lang"))
    return docs, textfeatures.Tfidf(key="doc_id", text="text", min_df=3, max_features=4000).fit(docs)


@query("tfidf_vocab", f"WITH {_VOCAB} SELECT term, tf, df, {r('idf', 9)} AS idf FROM i")
def tfidf_vocab(spark, d):
    docs, model = _tfidf(spark, d)
    return rounded(model.vocabulary(docs), 9)


@query("tfidf_long", f"WITH {_WEIGHTS} SELECT doc_id, term, {r('weight', 9)} AS weight FROM k")
def tfidf_long(spark, d):
    docs, model = _tfidf(spark, d)
    return rounded(model.transform(docs), 9)


@query(
    "top_terms_by_cluster",
    f"""WITH {_WEIGHTS}, z AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1),
m AS (SELECT lang, term, round(sum(weight) / any_value(size), 12) AS weight FROM k JOIN documents USING (doc_id)
      JOIN z USING (lang) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term)::INTEGER AS rank FROM m)
SELECT lang, rank, term, {r('weight', 8)} AS weight FROM o WHERE rank <= 6""",
)
def top_terms_by_cluster(spark, d):
    docs, model = _tfidf(spark, d)
    top = segment.top_terms(model.transform(docs), docs.select("doc_id", "lang"), "doc_id", "lang", 6)
    return rounded(top, 8)
