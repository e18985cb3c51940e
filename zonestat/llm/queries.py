"""The queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives, integer_vectors
from .language_id import language_id
from .license_scan import EXTENDS, TEMPLATES, TERM, license_scan
from .media_chunks import media_column
from .mixing import mix
from .near_dedup import near_dedup
from .passages import repeated_passages
from .piece_codec import encode_decode
from .prefix_trie import ordered_turns, prefix_trie, regrafted
from .simhash import simhash_dedup
from .toxicity import toxicity
from .warc_revisits import resolve_revisits


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: by source, package and module; every fortieth is its module's licence file, or its package's."""
    docs = table(spark, sf_dir, "documents")
    package, module = F.expr("doc_id div 400"), F.expr("doc_id div 40")
    name = F.when(F.col("doc_id") % 40 == 7, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt")))
    inside = F.when(F.col("doc_id") % 400 != 7, F.concat(F.lit("m"), module))  # nulls are left out
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("p"), package), inside, name)
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive records: of each a full response, a revisit an hour after and one an hour before."""
    pages = table(spark, sf_dir, "pages")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    k = F.col("k")
    changed = (k == 1) & (F.col("page_id") % 7 == 3)
    etag = F.when(F.col("page_id") % 5 == 4, F.lit(None).cast("string")).when(changed, F.lit('"changed"')).otherwise(tag)
    records = (
        pages.select("page_id", "url", "html", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
        .select(
            (F.col("page_id") * 3 + k).alias("id"), "url", F.timestamp_seconds(F.lit(1700000000) + F.col("page_id") * 60 + F.when(k == 1, 3600).when(k == 2, -3600).otherwise(0)).alias("at"),
            F.when(k == 0, "response").otherwise("revisit").alias("kind"), etag.alias("etag"), F.when(F.col("page_id") % 11 != 5, F.concat(F.lit("day "), F.col("page_id") % 9)).alias("last_modified"),
            F.when(k == 0, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("cache-control"), F.lit("max-age=60")))
            .otherwise(F.create_map(F.lit("Cache-Control"), F.concat(F.lit("max-age="), k * 100), F.lit("set-cookie"), F.lit("no"))).alias("headers"))
    )
    done = resolve_revisits(records)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return done.select("id", "url_key", "kind", "outcome", F.coalesce("response_id", F.lit(-1)).alias("response_id"), text.alias("headers"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the beginnings of their block's first one, as a trie; a node is its least conversation and depth."""
    trie = prefix_trie(*regrafted(ordered_turns(table(spark, sf_dir, "conversations"))))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor; every seventh one's label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), integer_vectors(rows, "embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_media_chunks": op8_media_chunks,
    "op9_piece_codec": op9_piece_codec,
    "op10_passages": op10_passages,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}

_TEMPLATE_ROWS = ", ".join(f"('{name}', {rank}, {variant}, '{text}')" for rank, (name, texts) in enumerate(TEMPLATES.items()) for variant, text in enumerate(texts))
_HELD = ", ".join(f"('{name}', '{held}', {clause})" for name, (held, clause) in EXTENDS.items())
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

SQL: dict[str, str] = {
    "op1_license_scan": f"""
        WITH f0 AS (SELECT doc_id AS id, {_LOWER("text")} AS low, text, coalesce(source, 'none') || '/p' || (doc_id // 400) || CASE WHEN doc_id % 400 <> 7 THEN '/m' || (doc_id // 40) ELSE '' END AS dir FROM documents),
        f AS (SELECT id, low, text, dir, id % 40 = 7 AS is_file, dir || CASE WHEN id % 40 = 7 THEN '/LICENSE' ELSE '/f' || id || '.txt' END AS path FROM f0),
        n AS (SELECT count(*) AS docs FROM f),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(low, '{TERM}'))) AS term FROM f) GROUP BY term),
        tpl(template, rank, variant, notice) AS (VALUES {_TEMPLATE_ROWS}),
        tt AS (SELECT template, rank, variant, term, count(*) AS tf FROM (SELECT template, rank, variant, unnest(regexp_extract_all({_LOWER("notice")}, '{TERM}')) AS term FROM tpl) GROUP BY ALL),
        w AS (SELECT template, rank, variant, term, coalesce(df, 0) AS df, tf * (ln((docs + 1) / (coalesce(df, 0) + 1)) + 1) AS x FROM tt LEFT JOIN df USING (term), n),
        m AS (SELECT template, rank, variant, term, df, round(x / sqrt(sum(x * x) OVER (PARTITION BY template, variant)), 9) AS weight FROM w),
        anchors AS (SELECT DISTINCT term FROM (SELECT term, sum(weight * weight) OVER (PARTITION BY template, variant ORDER BY df DESC, term ROWS UNBOUNDED PRECEDING) AS sofar FROM m) WHERE sofar >= 0.249),
        al AS (SELECT list(term) AS anchors FROM anchors),
        ls AS (SELECT id, list_filter(string_split(low, chr(10)), lambda l: regexp_matches(l, '[a-z0-9]')) AS lines FROM f WHERE text IS NOT NULL),
        st AS (SELECT id, lines, i FROM (SELECT id, lines, unnest(range(1, len(lines) + 1)) AS i FROM ls), al WHERE list_has_any(regexp_extract_all(lines[i], '{TERM}'), anchors)),
        part AS (SELECT id, i, k, array_to_string(lines[i : i + k - 1], ' ') AS words FROM st, (SELECT unnest([1, 2, 4, 8, 16]) AS k) WHERE least(len(lines) - i + 1, 16) > k // 2
                 UNION ALL SELECT id, 0, 0, low FROM f WHERE is_file AND text IS NOT NULL),
        tf AS (SELECT id, i, k, term, count(*) AS tf FROM (SELECT id, i, k, unnest(regexp_extract_all(words, '{TERM}')) AS term FROM part) GROUP BY ALL),
        v AS (SELECT id, i, k, term, tf * (ln((docs + 1) / (coalesce(df, 0) + 1)) + 1) AS x FROM tf LEFT JOIN df USING (term), n),
        norm AS (SELECT id, i, k, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
        c AS (SELECT id, template, rank, variant, round(sum(x * weight) / any_value(norm), 6) AS score FROM v JOIN m USING (term) JOIN norm USING (id, i, k) GROUP BY id, i, k, template, rank, variant),
        clause AS (SELECT DISTINCT id, held FROM c JOIN (VALUES {_HELD}) h(extending, held, clause) ON template = extending AND variant = clause WHERE score >= 0.5),
        own AS (SELECT * FROM c WHERE score >= 0.5 AND (id, template) NOT IN (SELECT id, held FROM clause) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, rank) = 1),
        p AS (SELECT f.id, path, dir, is_file, own.template AS own, own.score FROM f LEFT JOIN own USING (id)),
        g AS (SELECT dir AS above, own AS dir_license FROM p WHERE is_file AND own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, id) = 1),
        d AS (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM p WHERE own IS NULL)),
        near AS (SELECT dir, above, dir_license FROM (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM d) JOIN g USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY k DESC) = 1)
        SELECT id AS doc_id, path, coalesce(own, dir_license) AS license,
               CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               coalesce(score, 0.0) AS score, CASE WHEN own IS NULL AND dir_license IS NOT NULL THEN above END AS license_dir
        FROM p LEFT JOIN near USING (dir)""",
    "op3_warc_revisits": r"""
        WITH k(k) AS (VALUES (0), (1), (2)),
        r AS (
            SELECT page_id * 3 + k AS id, url, page_id, k, 1700000000 + page_id * 60 + CASE k WHEN 1 THEN 3600 WHEN 2 THEN -3600 ELSE 0 END AS ts,
                   CASE WHEN page_id % 5 = 4 THEN NULL WHEN k = 1 AND page_id % 7 = 3 THEN '"changed"' ELSE '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' END AS etag,
                   CASE WHEN page_id % 11 <> 5 THEN 'day ' || (page_id % 9) END AS last_modified, strlen(coalesce(html, '')) AS bytes
            FROM pages, k),
        u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS plain FROM r),
        c AS (SELECT *, regexp_replace(lower(regexp_extract(plain, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:www\.)?([^/?]*)', 1)), '^www\.|:(80|443)$', '') AS host,
                     regexp_replace(regexp_extract(plain, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
                     list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS q FROM u),
        n AS (SELECT *, CASE WHEN url IS NULL THEN '' ELSE 'u' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key FROM c),
        a AS (SELECT *, last_value(CASE WHEN k = 0 THEN {'id': id, 'etag': etag, 'lm': last_modified, 'bytes': bytes} END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, k <> 0, id ROWS UNBOUNDED PRECEDING) AS f FROM n),
        o AS (SELECT *, CASE WHEN k = 0 THEN 'response' WHEN f IS NULL THEN 'orphan' WHEN coalesce(etag = f.etag, last_modified = f.lm) IS NULL THEN 'unverified' WHEN coalesce(etag = f.etag, last_modified = f.lm) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM a)
        SELECT id, url_key, CASE WHEN k = 0 THEN 'response' ELSE 'revisit' END AS kind, outcome, CASE WHEN k = 0 THEN id ELSE coalesce(f.id, -1) END AS response_id,
               CASE WHEN k = 0 THEN 'cache-control=max-age=60;content-length=' || bytes || ';content-type=text/html'
                    WHEN outcome = 'resolved' THEN 'Cache-Control=max-age=' || (k * 100) || ';content-length=' || f.bytes || ';content-type=text/html'
                    ELSE 'Cache-Control=max-age=' || (k * 100) || ';set-cookie=no' END AS headers
        FROM o""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM d""",
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT c, list({'role': role, 'text': text} ORDER BY p) AS turns FROM t GROUP BY c),
        cut AS (SELECT c, turns, c - c % 100 AS base,
                       xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, k, 1))::BIGINT),
                           lambda acc, b: list_reduce([xor(acc, b)] || [1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM own),
        built AS (SELECT cut.c, coalesce(b.turns, [])[1:h] || cut.turns[h + 1:] AS turns FROM cut LEFT JOIN own b ON b.c = base),
        member AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
        node AS (SELECT d, path, count(*) AS n_convs, min(c) AS conv_id, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ended FROM member GROUP BY d, path),
        child AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
        full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN node.d = 0 THEN 0 ELSE length(node.path[node.d].text) END AS saved FROM node LEFT JOIN child USING (d, path)),
        below AS (SELECT a AS d, path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY ALL),
        up AS (SELECT d, path, conv_id FROM node)
        SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, sha256(ended) AS ends_sha256
        FROM full_ f JOIN below USING (d, path) LEFT JOIN up ON up.d = f.d - 1 AND up.path = f.path[1:f.d - 1]""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
        a AS (SELECT * FROM e WHERE id % 100 = 0),
        s AS (SELECT a.id AS anchor_id, e.id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM a JOIN e ON a.id <> e.id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT * FROM n WHERE rank <= 10""",
}
