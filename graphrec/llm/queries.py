"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_main, jaccard, langid, line_dedup, mixing, packing, phrases, repetition, sharding, token_counts, topk, warc, whitening
from .shared import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "shard")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), report=True)
    return d.select("doc_id", "source", "text", "n_lines", "n_dropped")


def line_dedup_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of raw pages, without those on over 5 % of the pages of their host."""
    d = line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"), "page_id", "html", "url", report=True)
    return d.select("page_id", "url", F.col("html").alias("text"), "n_lines", "n_dropped")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op9_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_capture_index, op2_source_mix, op3_language_mixture, op4_main_text, op5_line_dedup, line_dedup_by_host, op6_jaccard_join, op7_kd_shards, op8_repetition, op9_slack_packing, op10_exact_topk, op11_collocations, op12_whitening, op13_token_counts)
}

ORACLE_SQL: dict[str, str] = {
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (SELECT c.*, fl.f AS l, fr.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (fl.f + fr.f) AS BIGINT) AS score FROM c
              JOIN f AS fl ON fl.lang = c.lang AND fl.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut], ' ')
              JOIN f AS fr ON fr.lang = c.lang AND fr.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))) AS phrase FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m),
        o AS (SELECT lang, phrase, max(f) AS around FROM i GROUP BY ALL),
        d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < 80 * CAST(a AS HUGEINT))
        SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM d JOIN t USING (lang)
        QUALIFY rank <= 2000
    """,
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), n AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS place FROM v
        ), s AS (
            SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM n AS q JOIN n AS c ON q.vec_id % 50 = 0 AND q.place <> c.place
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, CASE WHEN regexp_matches(source, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN lower(regexp_extract(source, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) ELSE source END AS site FROM documents),
        l AS (SELECT d.*, list_distinct(list_filter(list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')) AS bare FROM d),
        t AS (SELECT site, count(*) AS pages FROM d GROUP BY site),
        b AS (SELECT e.site, list(line) AS drop_lines FROM (SELECT site, line, count(*) AS n FROM (SELECT site, unnest(bare) AS line FROM l) GROUP BY ALL) AS e
              JOIN t ON e.site IS NOT DISTINCT FROM t.site WHERE n >= 2 AND n > pages * CAST(0.05 AS DOUBLE) GROUP BY e.site),
        k AS (SELECT l.*, CASE WHEN b.drop_lines IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(b.drop_lines, trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)))) END AS kept
              FROM l LEFT JOIN b ON l.site IS NOT DISTINCT FROM b.site)
        SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped FROM k
    """,
    "op1_capture_index": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
    """,
    "op2_source_mix": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '|' || text, '')) AS h FROM documents
        ), s AS (
            SELECT source IS NULL AS src_null, coalesce(source, '') AS src_key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
        ), w AS (
            SELECT *, row_number() OVER (ORDER BY src_null, src_key) - 1 AS place, 3 * source_size AS lim FROM s
        ), w2 AS (SELECT *, place % 3 + 1 AS weight FROM w), l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w2
        ), t AS (
            SELECT src_null, src_key, source_size, place, weight,
                   least(CAST(lim AS DOUBLE), weight * (SELECT level FROM l WHERE lim >= weight * level ORDER BY lim / weight, place LIMIT 1)) AS target FROM l
        ), house AS (SELECT floor(sum(target) / 16 + 0.5) AS seats FROM t), q AS (
            SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS rank
            FROM (SELECT place, target, unnest(range(least(source_size * 3 // 16, CAST(ceil(target / 16 * 1.01) AS BIGINT) + 16))) AS k FROM t)
        ), a AS (
            SELECT t.*, 16 * coalesce(n, 0) AS words_taken, coalesce(CAST('0x' || substr(md5('mix-1|start|' || src_key), 1, 8) AS BIGINT) % nullif(source_size, 0), 0) AS start
            FROM t LEFT JOIN (SELECT place, count(*) AS n FROM q, house WHERE rank <= seats GROUP BY place) AS n USING (place)
        ), p AS (
            SELECT d.doc_id, d.size, a.*, CAST(sum(size) OVER (PARTITION BY src_null, src_key ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS o
            FROM d JOIN a ON (d.source IS NULL) = a.src_null AND coalesce(d.source, '') = a.src_key
        ), r AS (
            SELECT *, (o - start + source_size) % greatest(source_size, 1) AS pos, words_taken // greatest(source_size, 1) AS whole, words_taken % greatest(source_size, 1) AS rest FROM p
        ), seats AS (
            SELECT place, list(n ORDER BY shard) AS upto FROM (
                SELECT t.place, x.shard, count(q.place) AS n
                FROM t CROSS JOIN (SELECT unnest(range(8)) AS shard) AS x CROSS JOIN house
                LEFT JOIN q ON q.place = t.place AND q.rank <= floor(house.seats * (x.shard + 1) / 8) GROUP BY ALL) GROUP BY place
        ), f AS (
            SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole * size + greatest(0, least(size, rest - pos)) + greatest(0, least(greatest(0, pos + size - source_size), rest)) END AS taken,
                   CASE WHEN pos + size > source_size AND (whole > 0 OR rest > 0) THEN 0 ELSE pos // 16 END AS first FROM r
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
               CASE WHEN taken > 0 THEN CAST(len(list_filter(upto, lambda s: s <= first)) AS INTEGER) END AS shard
        FROM f JOIN seats USING (place)
    """,
}

_BY_HOST = {"doc_id, source, text, string_split(text": "page_id, url, html AS text, string_split(html", "source": "url", "documents": "pages", "doc_id": "page_id"}
_LINES = ORACLE_SQL["op5_line_dedup"]
for _given, _other in _BY_HOST.items():
    _LINES = _LINES.replace(_given, _other)
ORACLE_SQL["line_dedup_by_host"] = _LINES
