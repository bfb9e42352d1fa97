"""The queries of this subpackage for ``__spark_entry__``: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses
from .bpe import encode_documents
from .common import table
from .fingerprints import version_report
from .lexical import build_index, search
from .neardup import near_duplicates
from .packing import added_tokens, pack_documents
from .pii import pii_report
from .quality import quality_report
from .repair import damaged, repair_report
from .search import top_k
from .sharding import shard_documents
from .urls import judge_urls
from .warc import archive_pages


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2048, added=added)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).drop("archive", "offset")  # they differ from run to run


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


# The rules of op12 (verdict, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"), default="allow")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), every=rows)


QUERIES = {"op1_sharding": op1_sharding, "op2_bpe": op2_bpe, "op3_packing": op3_packing, "op4_simhash": op4_simhash, "op5_topk": op5_topk, "op6_licenses": op6_licenses, "op7_fingerprints": op7_fingerprints, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_warc": op10_warc, "op11_lexical": op11_lexical, "op12_urls": op12_urls, "op13_repair": op13_repair}


def _license_sql() -> str:
    """Diagonal voting over the words' k-grams themselves instead of their hashes."""
    split = f"list_filter(regexp_split_to_array(lower({{0}}), '{licenses.NOT_WORD}'), lambda x: x <> '')"
    rows = [(text, label, "true") for text, label in licenses.PHRASES.items()] + [(text, label, "false") for label, text in licenses.NOTICES.items()]
    values = ", ".join(f"({i}, '{text}', '{label}', {phrase})" for i, (text, label, phrase) in enumerate(rows))
    k = f"CASE WHEN phrase THEN {licenses.PHRASE_GRAM} ELSE {licenses.NOTICE_GRAM} END"
    return f"""
        WITH docs AS (SELECT doc_id, {split.format("coalesce(text, '')")} AS w FROM documents
        ), templates AS (SELECT template, label, phrase, {k} AS k, {split.format("text")} AS w FROM (VALUES {values}) t(template, text, label, phrase)
        ), positions AS (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM templates
        ), rules AS (SELECT template, label, phrase, k, len(w) AS n_words, len(w) - k + 1 AS n_grams, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM positions
        ), places AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM docs, (VALUES ({licenses.PHRASE_GRAM}), ({licenses.NOTICE_GRAM})) ks(k)
        ), grams AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM places
        ), diagonals AS (
            SELECT doc_id, template, label, phrase, k, n_words, n_grams, i - p AS d, list(DISTINCT p) AS ps FROM grams JOIN rules USING (k, g) GROUP BY ALL
        ), cut AS (
            SELECT *, coalesce(phrase OR d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) > {licenses.NEAR}, true)::INT AS new FROM diagonals
        ), numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY d) AS span FROM cut
        ), spans AS (
            SELECT doc_id, label, phrase, min(d + list_min(ps)) AS s, max(d + list_max(ps)) + any_value(k) AS e, any_value(n_words) AS n_words,
                len(list_distinct(flatten(list(ps))))::DOUBLE / any_value(n_grams) AS share
            FROM numbered GROUP BY doc_id, template, label, phrase, span
        ), good AS (
            SELECT * FROM spans WHERE CASE WHEN phrase THEN share = 1 ELSE share >= {licenses.LEAST_SHARE} AND e - s <= {licenses.MOST_STRETCH} * n_words + {licenses.NEAR} END
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) AS first_word, max(s) FILTER (phrase) AS last_word,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
            coalesce(max(share), 0)::DOUBLE AS score
        FROM docs d LEFT JOIN good USING (doc_id) GROUP BY d.doc_id, d.w
    """


_CRC_TABLE = """
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def _repair_sql() -> str:
    """One step per row and state instead of runs: p0 to p3 are the cheapest (cost, edits, lines) after each row."""
    more = lambda p, cost, edit, line: f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {cost}, 'e': {p}.e || '{edit}', 'r': {line.format(p=p)}}} END"
    added = lambda p, role: more(p, 3, "I", f"list_append({{p}}.r, '{role}:')")
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda v: v IS NOT NULL))"
    stays = lambda p, cost, edit, role: f"CASE WHEN fault IN ('', 'truncated') THEN {more(p, f'{cost} + extra', edit, f'list_append({{p}}.r, {role})')} END"
    renamed = lambda p, role: stays(p, 3, "R", f"'{role}:' || text")
    kept = lambda p, initial: f"CASE WHEN initial = '{initial}' THEN {stays(p, 0, 'K', 'line')} END"
    gone = lambda p: more(p, 4, "D", "{p}.r")
    return f"""
        WITH RECURSIVE crc_table AS ({_CRC_TABLE}
        ), coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM conversations
        ), hit AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)::BIGINT % 20 AS k FROM coded, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM hit, range(2) copies(i) WHERE k > 0 AND (i = 0 OR k = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM damaged
        ), judged AS (
            SELECT conv_id, turn, role, text, i, role || ':' || text AS line, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN cut[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ), symbols AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM judged
        ), steps AS (
            SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'e': '', 'r': []::VARCHAR[]}} AS p0, NULL::STRUCT(c INTEGER, e VARCHAR, r VARCHAR[]) AS p1, NULL::STRUCT(c INTEGER, e VARCHAR, r VARCHAR[]) AS p2, NULL::STRUCT(c INTEGER, e VARCHAR, r VARCHAR[]) AS p3
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, {gone('p0')}, {least(gone('p1'), kept('p0', 's'))},
                {least(gone('q2'), *[kept(q, 'u') for q in ('p0', 'p1', 'q3')], *[renamed(q, 'user') for q in ('p0', 'p1', 'q3')])}, {least(gone('q3'), kept('q2', 'a'), renamed('q2', 'assistant'))}
            FROM (SELECT *, {least('a2', added('p3', 'user'))} AS q2, {least('p3', added('a2', 'assistant'))} AS q3
                FROM (SELECT *, {least('p2', added('p0', 'user'), added('p1', 'user'))} AS a2
                    FROM (SELECT s.conv_id, r.i, fault, extra, initial, line, text, p0, p1, p2, p3 FROM steps s JOIN symbols r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1)))
        ), ended AS (
            SELECT conv_id, {least('p0', added('p2', 'assistant'), 'p3')} AS best FROM (
                SELECT conv_id, p0, {least('p2', added('p1', 'user'))} AS p2, p3 FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM symbols GROUP BY conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.e AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """


SQL: dict[str, str] = {
    "op11_lexical": r"""
        WITH words AS (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), docs AS (SELECT d, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
        ), size AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs
        ), tf AS (SELECT d, t, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS t FROM docs) GROUP BY d, t
        ), df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t
        ), asked AS (
            SELECT q, item_id, t, count(*)::BIGINT AS r FROM (
                SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
        ), scored AS (
            SELECT q, item_id, doc_id, d, sum(r * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
            FROM asked JOIN tf USING (t) JOIN df USING (t) JOIN docs USING (d), size GROUP BY q, item_id, doc_id, d
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_urls": f"""
        WITH cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), rules AS (SELECT * FROM (VALUES {', '.join(str(r) for r in URL_RULES)}) t(verdict, host, path)
        ), best AS (
            SELECT p.r, arg_max({{'rule': u.host || u.path, 'verdict': u.verdict}}, length(u.host || u.path)) AS b
            FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.r
        )
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
    """,
    "op13_repair": _repair_sql(),
    "op1_sharding": f"""
        WITH crc_table AS ({_CRC_TABLE}
        ), bytes AS (
            SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
        ), sized AS (
            SELECT doc_id, (len(b) + 16)::BIGINT AS size,
                xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)::BIGINT AS text_crc32
            FROM bytes, crc_table
        ), placed AS (
            SELECT *, least(39, ((2 * sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size) * 40) // (2 * sum(size) OVER ()))::INTEGER AS shard FROM sized
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
        FROM placed
    """,
    "op6_licenses": _license_sql(),
    "op10_warc": """
        WITH p AS (
            SELECT page_id, lower(trim(url)) AS u, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages
        ), first_of AS (SELECT s, min(page_id) AS first_id FROM p GROUP BY s
        ), captures AS (
            SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
                array_to_string(list_transform(regexp_extract_all(
                    array_to_string(list_transform(string_split(s, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), ''), '.{5}'),
                    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(string_split(b, ''), lambda c: c::INT), lambda x, y: 2 * x + y), 1)), '') AS payload_digest,
                CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
                array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), '.')), ',') || ')'
                    || coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') || regexp_extract(u, '([?][^#]+)', 1) AS url_key,
                strftime(to_timestamp(1704067200 + page_id % 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
            FROM p JOIN first_of USING (s)
        )
        SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position FROM captures
    """,
    "op5_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
