"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import align, classifiers, exact, html, joins, lines, mixing, search, sketches, suffixes, tokens
from sparkveil.llm.common import crc_fold, table

#: The vocabulary that the token queries use.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The vocabulary that op13 aligns with it.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens above which op7 marks a document.
TOKEN_LIMIT = 512


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), VOCABULARY, ids=False)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifiers.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted", "n_sentences", "starts", "ends")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).drop("in_history")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.jaccard_components(table(spark, sf_dir, "documents"), 4, 85).drop("text_hash", "winner")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_spread_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lang", "source", "text", "n_lines", "n_removed")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, TOKEN_LIMIT)


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "text", "repetition")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edit_likeness(table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifiers.score_quality(docs, classifiers.train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted", "raw_bytes", "bad_bytes", "good_bytes")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), VOCABULARY, PIECES, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe,
    "op2_toxicity": toxicity,
    "op3_exact_dedup": exact_dedup,
    "op4_ngram_jaccard": ngram_jaccard,
    "op5_line_dedup": line_dedup,
    "op6_html_text": html_text,
    "op7_token_counts": token_counts,
    "op8_mix_sources": mix_sources,
    "op9_fingerprints": fingerprints,
    "op10_quality": quality,
    "op11_suffix_dedup": suffix_dedup,
    "op12_lexical_search": lexical_search,
    "op13_token_alignment": token_alignment,
}

#: The same results in DuckDB. The other operators can't be stated in SQL, or not on whole tables in fair time.
ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    "op5_line_dedup": r"""
        WITH p AS (
            SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents
        ), l AS (
            SELECT doc_id, source, i - 1 AS pos, parts[i] AS line,
                   trim(regexp_replace(parts[i], '[\t\r\x0B\f]', ' ', 'g'), ' ') AS k
            FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)
        ), s AS (
            SELECT k, min({'doc': doc_id, 'pos': pos}) AS first FROM l WHERE k <> ''
            GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 10
        ), gone AS (
            SELECT l.doc_id, l.pos FROM l JOIN s USING (k) WHERE NOT (l.doc_id = s.first.doc AND l.pos = s.first.pos)
        ), kept AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos
            GROUP BY l.doc_id
        ), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT p.doc_id, p.lang, p.source, coalesce(kept.text, '') AS text,
               len(p.parts)::INTEGER AS n_lines, coalesce(n.n, 0)::INTEGER AS n_removed
        FROM p LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op8_mix_sources": r"""
        WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (
            SELECT source, (SELECT sum(n) FROM c)::DOUBLE * (pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM c)) / n AS rate FROM c
        ), d AS (
            SELECT d.*, r.rate, (('0x' || md5('8:' || doc_id)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
            FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
        ), k AS (
            SELECT *, len(list_filter(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1),
                       lambda i: list_sum(list_transform(range(0, i + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1)))) < u)) AS times
            FROM d
        )
        SELECT doc_id, source, lang, text, unnest(range(1, times + 1))::INTEGER AS repetition FROM k WHERE times > 0
    """,
    "op11_suffix_dedup": r"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), s AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)
        ), f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
        r AS (SELECT s.doc_id, s.p, lag(s.p) OVER (PARTITION BY s.doc_id ORDER BY s.p) AS before FROM s JOIN f USING (g) WHERE s.doc_id > f.first),
        k AS (SELECT doc_id, p, sum((before IS NULL OR p > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
        x AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY doc_id, k),
        y AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM x),
        z AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head, max(b) AS last FROM y JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(z.n_removed, 0)::BIGINT AS n_removed, coalesce(z.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(z.head, '') || substr(h, 2 * coalesce(z.last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN z USING (doc_id)
    """,
    "op12_lexical_search": r"""
        WITH w AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
        d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
        g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
        v AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
            FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g
        ), i AS (
            SELECT DISTINCT item_id, term FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        ), s AS (
            SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM i JOIN v USING (term) JOIN t USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
        ) WHERE rank <= 50
    """,
}
