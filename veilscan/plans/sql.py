"""The queries' results in SQL for DuckDB, over the same derived tables."""

from __future__ import annotations

from ..functions.detect import SIGNATURES
from ..operators.rules import CATALOG, MIME
from .queries import QUERIES

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BITS = "array_to_string(list_transform(regexp_extract_all(hex({0}), '..'), lambda h: lpad(bin(('0x' || h)::int), 8, '0')), '')"
BYTES = "upper(array_to_string(list_transform(regexp_extract_all({0}, '.{{8}}'), lambda b: lpad(hex(list_reduce(list_prepend(0, list_transform(string_split(b, ''), lambda c: c::int)), lambda x, y: 2 * x + y)), 2, '0')), ''))"


def bits(payload: str) -> str:
    return BITS.format(payload)


def from_bits(text: str) -> str:
    return BYTES.format(text)


def marked(text: str, payload: str) -> str:
    return f"{text} || translate({bits(payload)}, '01', chr(8203) || chr(8204)) || chr(8205)"


def lines(text: str) -> str:
    split = f"regexp_split_to_array({text}, '{LINE_END}')"
    return f"CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN list_last({split}) = '' THEN {split}[1:len({split}) - 1] ELSE {split} END"


def aligned(needle: str, of: str = "h") -> str:
    """Whether hexadecimal ``of`` holds the bytes ``needle``."""
    return f"regexp_matches({of}, '^(?:..)*?{needle}')"


def values(rows) -> str:
    def one(x):
        return "NULL" if x is None else str(x) if isinstance(x, int | float) else f"'{x}'"

    return ", ".join(f"({', '.join(one(x) for x in r)})" for r in rows)


ID_PAYLOAD = "encode('id:' || doc_id)"
TEXT_MARKED = f"text_marked AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {marked('text', ID_PAYLOAD)} ELSE text END AS text FROM documents)"
TEXT_TRAILING = r"text_trailing AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(\.)\n', '\1' || chr(9) || chr(10), 'g') ELSE text END AS text FROM documents)"
TEXT_WS = f"text_ws AS (SELECT doc_id, {lines('text')} AS l, chr((65 + doc_id % 26)::int) AS p FROM documents WHERE len({lines('text')}) >= 8)"
FILES = """files AS (
    SELECT doc_id::VARCHAR AS item_id,
        ['.png', '.jpg', '.jpeg', '.gif', '.pdf', '.txt', '.md', '.bmp', '.wav', '.bin'][doc_id % 10 + 1] AS ext,
        ['49454E44AE426082', 'FFD9', 'FFD9', '3B', '2525454F46', '', '', '', '', ''][doc_id % 10 + 1] AS m,
        hex(encode(text)) || m || ['', '504B030400000000', '4D5A9000', '53544547415050' || lpad(hex(octet_length(own)), 8, '0') || hex(own), '4F50454E535445474F', '0A'][(doc_id // 10) % 6 + 1] AS h,
        text, doc_id, own
    FROM (SELECT *, encode(substr('#' || doc_id || '-hidden', 1, 1 + (doc_id % 9)::INT)) AS own FROM documents))"""
TRAILERS = "trailers AS (SELECT *, CASE WHEN m <> '' THEN regexp_extract(h, '^(?:..)*' || m || '((?:..)*)$', 1) ELSE '' END AS t FROM files)"
SAMPLES = "samples AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::int) AS s, lpad(hex(vec_id % 65536), 4, '0') AS p FROM embeddings)"
PAYLOADS = "payloads AS (SELECT item_id AS carrier_id, 1 AS part, encode(text) AS p FROM benchmark UNION ALL SELECT item_id, 2, encode(substr(text, 1, 1)) FROM benchmark)"
COMMENTS = """comments AS (
    SELECT doc_id, encode(t) AS c, t FROM (
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'STEGEXIF' || w WHEN 2 THEN '' ELSE w END AS t
        FROM (SELECT *, CASE WHEN octet_length(encode(text)) <= 59990 THEN text END AS w FROM documents)))"""
# the samples of images and sound files as a detector sees them: grey three times, RGB, RGBA without alpha
MEDIA = """media AS (
    SELECT 'm' || vec_id AS item_id, vec_id, CASE vec_id % 5 WHEN 3 THEN '.bmp' WHEN 4 THEN '.wav' ELSE '.png' END AS ext, vec_id % 35 = 14 AS bad,
        CASE vec_id % 5 WHEN 0 THEN flatten(list_transform(s, lambda v: [v, v, v])) WHEN 2 THEN list_filter(s, lambda v, i: i % 4 <> 0) WHEN 4 THEN s ELSE s[1:63] END AS s
    FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(s, lambda v: v | 1) ELSE s END AS s FROM samples))"""
REPLIES = """replies AS (SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '{"suspicion": ' || event_id % 150 || ', "explanation": " e "}' WHEN 1 THEN 'Sure! {"suspicion": ' || event_id % 150 || '} done'
    WHEN 2 THEN '{"suspicion": "' || event_id % 100 || '"}' WHEN 3 THEN '{"suspicion": ' || event_id % 100 || '.9}'
    WHEN 4 THEN '{"explanation": "x"}' ELSE 'no json' END AS r FROM events)"""
CARRIERS = "carriers AS (SELECT doc_id AS carrier_id, floor(len(" + lines("text") + ") / 8)::BIGINT AS capacity FROM documents)"
CATALOG_SQL = f"catalog(ord, name, kind, ext, can_embed, can_extract, cap) AS (VALUES {values((i, n, k, e, int(m), int(r), c) for i, (n, k, es, m, r, c) in enumerate(CATALOG) for e in (es or (None,)))})"

POLYGLOT = (
    "CASE WHEN starts_with(t, '504B0304') THEN 'ZIP archive' WHEN starts_with(t, '526172211A07') THEN 'RAR archive' "
    "WHEN starts_with(t, '377ABCAF271C') THEN '7z archive' WHEN starts_with(t, '4D5A') THEN 'PE executable' WHEN starts_with(t, '7F454C46') THEN 'ELF executable' END"
)
NEEDLES = f"needles(i, name, needle, plain, score, detail) AS (VALUES {values((i, n, x.encode().hex().upper(), x, s, d) for i, (n, x, s, d) in enumerate(SIGNATURES))})"


def bias(n: str = "len(s)") -> str:
    return f"abs({mean(n)} - 0.5) * 200"


def mean(n: str = "len(s)") -> str:
    return f"list_sum(list_transform(s, lambda v: v & 1))::DOUBLE / {n}"


PAIRS = "list_sum(list_transform(range(1, len(s) // 2 + 1), lambda i: 2 * least(s[2 * i - 1], s[2 * i])::DOUBLE / greatest(s[2 * i - 1]::DOUBLE + s[2 * i], 1))) / (len(s) // 2)"
# all signals of the file items, in the order in which detectors stand in the catalog
SIGNALS = f"""ended AS (
    SELECT item_id, doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '[ \\t]$') AND regexp_matches(x, '[^\\s\\x{{85}}\\x{{a0}}\\x1c-\\x1f\\x0b]'))) AS f
    FROM (SELECT item_id, doc_id, {lines('text')} AS l FROM (
        SELECT item_id, doc_id, text || CASE (doc_id // 10) % 6 WHEN 0 THEN '' WHEN 1 THEN 'PK' || chr(3) || chr(4) || chr(1) WHEN 3 THEN 'STEGAPP' || chr(1) || decode(own) WHEN 4 THEN 'OPENSTEGO' ELSE chr(10) END AS text
        FROM files WHERE ext IN ('.txt', '.md') AND (doc_id // 10) % 6 <> 2  -- 0x90 is no UTF-8
    ))
), hits AS (
    SELECT f.item_id, s.i, s.name, s.score, s.detail FROM files f JOIN needles s ON regexp_matches(f.h, '^(?:..)*?' || s.needle)
    UNION ALL SELECT 'c' || doc_id, s.i, s.name, s.score, s.detail FROM comments JOIN needles s ON contains(t, s.plain)
), sig AS (
    SELECT item_id, 'audio_wav' AS analyzer, 0 AS o, 0 AS seq, 'wav_lsb_bias' AS name, floor(least(100, {bias()}))::int AS score, printf('LSB mean=%.3f', {mean()}) AS detail FROM media WHERE ext = '.wav' AND NOT bad
    UNION ALL SELECT item_id, 'filestruct_appended', 1, 0, 'appended_data', 70, (len(t) // 2) || ' bytes after EOF marker' FROM trailers WHERE t <> ''
    UNION ALL SELECT item_id, 'filestruct_appended', 1, 1, 'embedded_' || replace({POLYGLOT}, ' ', '_'), 95, {POLYGLOT} FROM trailers WHERE {POLYGLOT} IS NOT NULL
    UNION ALL SELECT 'c' || doc_id, 'filestruct_exif', 2, 0, CASE WHEN starts_with(t, 'STEGEXIF') THEN 'stegexif_marker' ELSE 'large_usercomment' END, CASE WHEN starts_with(t, 'STEGEXIF') THEN 95 ELSE 60 END,
        CASE WHEN starts_with(t, 'STEGEXIF') THEN 'STEGEXIF marker in UserComment' ELSE 'UserComment len=' || octet_length(c) END FROM comments WHERE starts_with(t, 'STEGEXIF') OR octet_length(c) > 64
    UNION ALL SELECT item_id, 'image_jpeg', 3, 0, 'appended_data', least(100, 50 + (len(t) // 2) // 32)::int, (len(t) // 2) || ' bytes after JPEG EOI' FROM trailers WHERE ext IN ('.jpg', '.jpeg') AND t <> ''
    UNION ALL SELECT item_id, 'image_jpeg', 3, 1, 'stegapp_marker', 95, 'STEGAPP marker found' FROM trailers WHERE ext IN ('.jpg', '.jpeg') AND {aligned('53544547415050')}
    UNION ALL SELECT item_id, 'image_lsb', 4, 0, 'lsb_pair_ratio', floor(least(100, {PAIRS} * 100))::int, printf('adjacent-pair LSB ratio = %.3f (~1.0 suggests embedding)', {PAIRS}) FROM media WHERE ext <> '.wav'
    UNION ALL SELECT item_id, 'image_lsb', 4, 1, 'lsb_bit_bias', floor(least(100, {bias()}))::int, printf('LSB mean = %.3f', {mean()}) FROM media WHERE ext <> '.wav'
    UNION ALL SELECT item_id, 'text_whitespace', 5, 0, 'trailing_whitespace_ratio', floor(least(100, f / n * 100))::int, f || '/' || n FROM ended WHERE n > 0
    UNION ALL SELECT item_id, 'signatures', 7, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1, name, score, detail FROM hits
)"""
MATCHED = """matched AS (
    SELECT item_id, 'filestruct_appended' AS analyzer FROM every_item WHERE ext IN ('.png', '.jpg', '.jpeg', '.gif', '.pdf')
    UNION ALL SELECT item_id, unnest(['image_jpeg', 'filestruct_exif']) FROM every_item WHERE ext IN ('.jpg', '.jpeg')
    UNION ALL SELECT item_id, 'image_lsb' FROM every_item WHERE ext IN ('.png', '.bmp')
    UNION ALL SELECT item_id, 'audio_wav' FROM every_item WHERE ext = '.wav'
    UNION ALL SELECT item_id, unnest(['text_whitespace', 'text_zerowidth']) FROM every_item WHERE ext IN ('.txt', '.md')
    UNION ALL SELECT item_id, 'signatures' FROM every_item)"""


def found(media: bool = True) -> str:
    """CTEs up to ``found`` over the file items, with or without the media items."""
    some = "" if media else "WHERE false"
    every = f"every_item AS (SELECT item_id, ext FROM files UNION ALL SELECT item_id, ext FROM media UNION ALL SELECT 'c' || doc_id, '.jpg' FROM comments WHERE t IS NOT NULL)"
    samples = SAMPLES.removesuffix(")") + f" {some})"
    comments = COMMENTS.removesuffix("documents)))") + f"documents {some})))"
    return f"""WITH {FILES}, {TRAILERS}, {samples}, {MEDIA}, {comments}, {NEEDLES}, {SIGNALS}, {every}, {MATCHED},
    prior AS (SELECT item_id, max(score) AS suspicion, count(*) AS n, string_agg(name || ':' || score, '; ' ORDER BY o, seq) AS told,
        string_agg(name || '(' || score || '): ' || detail, '; ' ORDER BY o, seq) AS summary, list({{'name': name, 'score': score, 'detail': detail}} ORDER BY o, seq) AS signals FROM sig GROUP BY item_id),
    per AS (SELECT m.item_id, m.analyzer, coalesce(max(s.score), 0) AS suspicion, count(s.score) AS n_signals, string_agg(name || '(' || score || '): ' || detail, '; ' ORDER BY seq) AS summary,
        list({{'name': name, 'score': score, 'detail': detail}} ORDER BY seq) FILTER (score IS NOT NULL) AS signals FROM matched m LEFT JOIN sig s USING (item_id, analyzer) GROUP BY ALL),
    found AS (
        SELECT item_id, analyzer, suspicion, n_signals, NULL::VARCHAR AS explanation, summary, signals FROM per
        UNION ALL SELECT f.item_id, 'ai_triage', coalesce(p.suspicion, 0), coalesce(p.n, 0), coalesce(p.told, 'no signals'), p.summary, p.signals FROM every_item f LEFT JOIN prior p USING (item_id)) """


FOUND = found()
BAND = "CASE WHEN suspicion >= 70 THEN 'high' WHEN suspicion >= 30 THEN 'mid' ELSE 'low' END"
TOLD_SIG = "coalesce(max(score), 0)::int AS suspicion, coalesce(string_agg(name || ':' || score, ';' ORDER BY seq), '') AS signals"


def one_signal(name: str, score: str, when: str) -> str:
    """suspicion and signals columns of a detector with at most one signal."""
    return f"CASE WHEN {when} THEN ({score})::int ELSE 0 END AS suspicion, CASE WHEN {when} THEN '{name}:' || ({score})::int ELSE '' END AS signals"


N_ZERO = "(len(text) - len(translate(text, chr(8203) || chr(8204) || chr(8205), '')))"
FLAGGED = r"len(list_filter(l, lambda x: regexp_matches(x, '[ \t]$') AND regexp_matches(x, '[^\s\x{85}\x{a0}\x1c-\x1f\x0b]')))"
EXT_FIRST = "first_by_ext AS (SELECT ext, arg_min(name, ord) AS carrier FROM catalog WHERE {able} = 1 GROUP BY ext)"
SAMPLE_BITS = "'00000000000000000000000000000010' || lpad(bin(vec_id % 65536), 16, '0')"
MARKED_SAMPLES = f"list_transform(s, lambda v, i: CASE WHEN i <= 48 THEN (v - (v & 1)) + substr({SAMPLE_BITS}, i, 1)::int ELSE v END)"
PACK_HEAD = "'5354454701' || '00' || lpad(hex({n}), 8, '0') || repeat('00', 28)"


def pack(payload_hex: str) -> str:
    return f"{PACK_HEAD.format(n=f'(len({payload_hex}) // 2)')} || {payload_hex}"


def _sql() -> dict[str, str]:
    ws_marked = (
        "array_to_string(list_transform(l, lambda x, i: CASE WHEN i <= 8 THEN regexp_replace(x, '[ \\t]+$', '') || CASE substr("
        + bits("encode(p)")
        + ", i, 1) WHEN '1' THEN chr(9) ELSE ' ' END ELSE x END), chr(10)) || chr(10)"
    )
    zero_score = f"least(100, 70 + {N_ZERO} // 2)"
    signature_case = f"SELECT f.item_id, s.i AS seq, s.name, s.score FROM files f JOIN (VALUES {values((i, n, x.encode().hex().upper(), s) for i, (n, x, s, _) in enumerate(SIGNATURES))}) s(i, name, needle, score) ON regexp_matches(f.h, '^(?:..)*?' || s.needle)"
    with_signatures = f"WITH {FILES}, hits AS ({signature_case}), told AS (SELECT f.item_id, {TOLD_SIG}, count(score) AS n, string_agg(name || '(' || score || ')', ';' ORDER BY seq) AS t FROM files f LEFT JOIN hits h USING (item_id) GROUP BY f.item_id)"
    detail = " ".join(f"WHEN '{n}' THEN '{d}'" for n, _, _, d in SIGNATURES)
    sig_prompt = f"SELECT f.item_id, 'File: ' || f.item_id || chr(10) || 'Heuristic signals:' || chr(10) || coalesce(string_agg('- ' || name || ' (score ' || score || '): ' || CASE name {detail} END, chr(10) ORDER BY seq), '(no prior signals)') AS prompt FROM files f LEFT JOIN hits h USING (item_id) GROUP BY f.item_id"
    words = "regexp_replace(text, '[ ' || chr(10) || ']+', chr(10), 'g')"
    # items of every carrier, where each goes and whether its envelope fits
    marked_items = f"""{SAMPLES}, {COMMENTS}, items AS (
            SELECT 't' || doc_id AS item_id, doc_id AS id, ['.txt', '.md', '.bin'][doc_id % 3 + 1] AS ext, {words} AS text, NULL::INTEGER[] AS s, NULL::BLOB AS c FROM documents
            UNION ALL SELECT 's' || vec_id, vec_id, ['.png', '.wav'][vec_id % 2 + 1], NULL, flatten(list_transform(range(12), lambda i: s)), NULL FROM samples
            UNION ALL SELECT 'c' || doc_id, doc_id, ['.jpg', '.tiff'][doc_id % 2 + 1], NULL, NULL, c FROM comments
        ), {CATALOG_SQL}, {EXT_FIRST.format(able='can_embed')}, sized AS (
            SELECT i.*, {lines('text')} AS l, carrier, id % 3 = 0 AS sealed, (38 + octet_length(encode('id:' || item_id)) + CASE WHEN id % 3 = 0 THEN 16 ELSE 0 END)::BIGINT AS blob FROM items i LEFT JOIN first_by_ext USING (ext)
        ), placed AS (
            SELECT *, CASE WHEN carrier IS NULL THEN 'no_carrier' WHEN blob > CASE WHEN s IS NOT NULL THEN greatest(0, len(s) // 8 - 4) WHEN text IS NOT NULL THEN len(l) // 8 ELSE 60000 END THEN 'too_large' ELSE 'ok' END AS status FROM sized)"""
    exif_case = "starts_with(hex(c), '5354454745584946')"
    unpacked = f"b AS (SELECT doc_id, {pack('hex(encode(text))')} AS h, octet_length(encode(text)) AS n FROM documents)"
    ext_sql = r"lower(regexp_extract(url, '[^/.][^/]*?(\.[^./]+)$', 1))"
    return {
        "scan_pruned": "SELECT '.txt' AS ext, octet_length(encode(text)) + 1 AS length, sha256(text || chr(10)) AS sha256 FROM benchmark WHERE octet_length(encode(text)) < 250",
        "match_rules": """WITH needles AS (
                SELECT item_id || '-' || k AS name, (k * 10)::INTEGER AS score, substr(text, (1 + 13 * k)::BIGINT, (3 + (k + item_id) % 12)::BIGINT) AS needle FROM benchmark, range(10) r(k))
            SELECT doc_id, name, score FROM documents JOIN needles ON needle <> '' AND contains(text, needle)""",
        "report_table": FOUND + f"SELECT scan, analyzer, {BAND} AS band, count(*) AS n FROM found, (VALUES ('first'), ('second')) s(scan) GROUP BY ALL",
        "screen_directory": f"""WITH {NEEDLES}, hits AS (SELECT item_id, max(score) AS s FROM benchmark JOIN needles ON contains(text, plain) GROUP BY item_id
            ), each AS (SELECT item_id % 2 AS batch, unnest(['text_whitespace', 'text_zerowidth', 'signatures', 'ai_triage']) AS analyzer, coalesce(s, 0) AS s FROM benchmark LEFT JOIN hits USING (item_id)
            ), scored AS (SELECT batch, analyzer, CASE WHEN analyzer LIKE 'text%' THEN 0 ELSE s END AS suspicion FROM each)
            SELECT batch, analyzer, {BAND} AS band, count(*) AS n FROM scored GROUP BY ALL""",
        "text_items": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN sha256(text) END AS text_sha256, doc_id % 4 = 0 AS bad FROM documents",
        "text_lenient": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
        "image_samples": f"""WITH {SAMPLES}, {MEDIA} SELECT item_id, CASE vec_id % 5 WHEN 0 THEN 8 WHEN 2 THEN 4 ELSE 7 END AS width, CASE vec_id % 5 WHEN 0 THEN 8 WHEN 2 THEN 4 ELSE 3 END AS height,
            lower(array_to_string(list_transform(s, lambda v: lpad(hex(v), 2, '0')), '')) AS rgb_hex, false AS bad FROM media WHERE ext <> '.wav'""",
        "wav_samples": f"WITH {SAMPLES} SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE len(s)::INTEGER END AS n, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE list_sum(s) END::BIGINT AS total, vec_id % 7 = 0 AS bad FROM samples",
        "exif_comment": f"WITH {COMMENTS} SELECT doc_id, hex(c) AS comment_hex, c IS NULL AS bad FROM comments",
        "signature_rules": f"SELECT d.doc_id, s.name, s.score FROM documents d JOIN (VALUES {values((n, x, s) for n, x, s, _ in SIGNATURES)}) s(name, needle, score) ON contains(d.text, s.needle)",
        "trailer_rules": f"WITH {FILES}, {TRAILERS} SELECT item_id, (len(t) // 2)::INTEGER AS bytes, {POLYGLOT} AS label FROM trailers WHERE m <> ''",
        "analyzer_catalog": f"WITH {FILES}, {CATALOG_SQL}, n AS (SELECT ext, count(*) AS n FROM files GROUP BY ext) SELECT ord AS \"order\", name, kind, can_embed = 1 AS can_embed, can_extract = 1 AS can_extract, coalesce(sum(n), 0)::BIGINT AS n_items FROM catalog LEFT JOIN n USING (ext) GROUP BY ALL",
        "item_ext": f"SELECT page_id, {ext_sql} AS ext FROM pages",
        "route_carriers": f"WITH {FILES}, {CATALOG_SQL} SELECT item_id, name AS analyzer FROM files JOIN catalog USING (ext) WHERE kind = 'carrier'",
        "route_all": f"WITH {FILES} SELECT item_id, unnest(['signatures', 'ai_triage']) AS analyzer FROM files",
        "route_embed": f"WITH {FILES}, {CATALOG_SQL}, {EXT_FIRST.format(able='can_embed')} SELECT item_id, carrier FROM files JOIN first_by_ext USING (ext)",
        "route_embed_rejects": f"WITH {FILES}, {CATALOG_SQL}, {EXT_FIRST.format(able='can_embed')} SELECT item_id, ext FROM files ANTI JOIN first_by_ext USING (ext)",
        "route_extract": f"WITH {FILES}, {CATALOG_SQL}, {EXT_FIRST.format(able='can_extract')} SELECT item_id, carrier FROM files JOIN first_by_ext USING (ext)",
        "attachable_images": f"WITH {FILES} SELECT item_id, (len(h) // 2)::BIGINT AS length FROM files WHERE ext IN ({', '.join(repr(e) for e in MIME)}) AND len(h) // 2 <= 4194304",
        "mime_by_ext": f"WITH {FILES} SELECT item_id, coalesce(mime, 'application/octet-stream') AS mime FROM files LEFT JOIN (VALUES {values(MIME.items())}) m(ext, mime) USING (ext)",
        "detect_zero_width": f"WITH {TEXT_MARKED} SELECT doc_id, {one_signal('zero_width_chars', zero_score, f'{N_ZERO} > 0')}, CASE WHEN {N_ZERO} > 0 THEN {N_ZERO} END::DOUBLE AS metric FROM text_marked",
        "detect_trailing_ws": f"WITH {TEXT_TRAILING}, l AS (SELECT doc_id, {lines('text')} AS l FROM text_trailing), r AS (SELECT doc_id, len(l) AS n, {FLAGGED}::DOUBLE / greatest(len(l), 1) AS r FROM l) SELECT doc_id, {one_signal('trailing_whitespace_ratio', 'floor(least(100, r * 100))', 'n > 0')}, CASE WHEN n > 0 THEN round(r, 6) END AS metric FROM r",
        "detect_signatures": f"{with_signatures} SELECT item_id, suspicion, signals FROM told",
        "detect_appended": f"WITH {FILES}, {TRAILERS} SELECT item_id, {one_signal('appended_data', '70', chr(116) + ' <> ' + chr(39) * 2)}, CASE WHEN t <> '' THEN (len(t) // 2)::DOUBLE END AS metric FROM trailers",
        "detect_polyglot": f"WITH {FILES}, {TRAILERS}, p AS (SELECT item_id, 'embedded_' || replace({POLYGLOT}, ' ', '_') AS n FROM trailers) SELECT item_id, 95 AS suspicion, n || ':95' AS signals FROM p WHERE n IS NOT NULL",
        "detect_jpeg_trailer": f"WITH {FILES}, {TRAILERS} SELECT item_id, {one_signal('appended_data', 'least(100, 50 + (len(t) // 2) // 32)', chr(116) + ' <> ' + chr(39) * 2)}, CASE WHEN t <> '' THEN (len(t) // 2)::DOUBLE END AS metric FROM trailers WHERE ext IN ('.jpg', '.jpeg')",
        "detect_stegapp": f"WITH {FILES} SELECT item_id, 95 AS suspicion, 'stegapp_marker:95' AS signals FROM files WHERE {aligned('FFD9')} AND {aligned('53544547415050')}",
        "detect_exif_comment": f"WITH {COMMENTS} SELECT doc_id, CASE WHEN {exif_case} THEN 95 WHEN octet_length(c) > 64 THEN 60 ELSE 0 END AS suspicion, CASE WHEN {exif_case} THEN 'stegexif_marker:95' WHEN octet_length(c) > 64 THEN 'large_usercomment:60' ELSE '' END AS signals FROM comments",
        "detect_pair_ratio": f"WITH {SAMPLES} SELECT vec_id, {one_signal('lsb_pair_ratio', f'floor(least(100, {PAIRS} * 100))', 'true')}, round({PAIRS}, 6) AS metric FROM samples",
        "detect_lsb_bias": f"WITH {SAMPLES} SELECT vec_id, {one_signal('lsb_bit_bias', f'floor(least(100, {bias()}))', 'true')}, round({bias()}, 6) AS metric FROM samples",
        "detect_wav_bias": f"WITH {SAMPLES} SELECT vec_id, {one_signal('wav_lsb_bias', f'floor(least(100, {bias()}))', 'true')}, round({bias()}, 6) AS metric FROM samples",
        "byte_statistics": f"WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::int) AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, list_sum(list_transform(s, lambda v: v & 1))::BIGINT AS ones, round({PAIRS}, 6) AS pair_ratio FROM b",
        "analyzer_suspicion": FOUND + "SELECT analyzer, suspicion, count(*) AS n FROM found GROUP BY ALL",
        "findings": FOUND + "SELECT item_id, analyzer, suspicion, n_signals::INTEGER AS n_signals, explanation FROM found",
        "signals_flat": FOUND + "SELECT item_id, analyzer, seq::INTEGER AS seq, name, score, detail FROM sig",
        "triage_heuristic": FOUND + "SELECT item_id, suspicion, explanation FROM found WHERE analyzer = 'ai_triage'",
        "scan_count": FOUND + "SELECT count(*) AS n FROM found",
        "severity_band": FOUND + f"SELECT item_id, analyzer, {BAND} AS band FROM found",
        "report_rows": FOUND + f"SELECT item_id, analyzer, suspicion, {BAND} AS band, coalesce(summary, '—') AS summary FROM found",
        "item_result_json": FOUND + """, chosen AS (SELECT item_id FROM found WHERE analyzer = 'ai_triage' ORDER BY n_signals DESC, item_id LIMIT 1)
            SELECT item_id, '[' || string_agg(j, ',' ORDER BY j) || ']' AS json FROM (
                SELECT item_id, to_json({'path': item_id, 'analyzer': analyzer, 'suspicion': suspicion, 'signals': coalesce(signals, []), 'explanation': explanation})::VARCHAR AS j FROM found JOIN chosen USING (item_id)
            ) GROUP BY item_id""",
        "scan_report": f"""WITH {TEXT_MARKED}, {NEEDLES}, s AS (
                SELECT doc_id, 5 AS o, 0 AS i, 'trailing_whitespace_ratio' AS name, 0 AS score, '0/' || len({lines("text || chr(10)")}) AS detail FROM text_marked
                UNION ALL SELECT doc_id, 6, 0, 'zero_width_chars', ({zero_score})::int, {N_ZERO} || ' zero-width chars' FROM text_marked WHERE {N_ZERO} > 0
                UNION ALL SELECT doc_id, 7, i, name, score, detail FROM text_marked JOIN needles ON contains(text, plain)
            ), t AS (SELECT doc_id, max(score) AS suspicion, string_agg(name || '(' || score || '): ' || detail, '; ' ORDER BY o, i) AS summary FROM s GROUP BY doc_id)
            SELECT suspicion, {BAND} AS band, summary, count(*) AS n FROM t GROUP BY ALL""",
        "report_json_rows": FOUND + "SELECT item_id AS path, analyzer, suspicion, n_signals::INTEGER AS n_signals FROM found",
        "suspicion_by_analyzer_band": FOUND + f"SELECT analyzer, {BAND} AS band, count(*) AS n FROM found GROUP BY ALL",
        "top_suspects": FOUND + "SELECT item_id, suspicion FROM found WHERE analyzer = 'ai_triage' ORDER BY suspicion DESC, item_id LIMIT 20",
        "capacity_text": f"SELECT doc_id, floor(len({lines('text')}) / 8)::BIGINT AS by_lines, 1000000 AS by_zero_width FROM documents",
        "capacity_samples": f"WITH {SAMPLES} SELECT vec_id, greatest(0, len(s) // 8 - 4) AS capacity FROM samples",
        "capacity_catalog": f"WITH {FILES}, {CATALOG_SQL} SELECT name AS analyzer, sum(cap)::BIGINT AS capacity, count(*) AS n FROM files JOIN catalog USING (ext) WHERE cap IS NOT NULL GROUP BY name",
        "admit_payloads": f"WITH {PAYLOADS}, {CARRIERS} SELECT carrier_id, part, octet_length(p)::INTEGER AS bytes FROM payloads LEFT JOIN carriers USING (carrier_id) WHERE coalesce(octet_length(p) <= capacity, false)",
        "reject_payloads": f"WITH {PAYLOADS}, {CARRIERS} SELECT carrier_id, part, octet_length(p)::INTEGER AS bytes FROM payloads LEFT JOIN carriers USING (carrier_id) WHERE NOT coalesce(octet_length(p) <= capacity, false)",
        "mark_zero_width": f"SELECT doc_id, sha256({marked('text', ID_PAYLOAD)}) AS sha256 FROM documents",
        "recover_zero_width": f"WITH {TEXT_MARKED}, z AS (SELECT doc_id, translate(regexp_replace(split_part(text, chr(8205), 1), '[^' || chr(8203) || chr(8204) || ']', '', 'g'), chr(8203) || chr(8204), '01') AS b FROM text_marked) SELECT doc_id, {from_bits('b')} AS payload_hex FROM z",
        "mark_trailing_ws": f"WITH {TEXT_WS} SELECT doc_id, sha256({ws_marked}) AS sha256 FROM text_ws",
        "recover_trailing_ws": f"WITH {TEXT_WS}, m AS (SELECT doc_id, regexp_extract(array_to_string(list_transform(list_transform(l, lambda x, i: CASE WHEN i <= 8 THEN regexp_replace(x, '[ \\t]+$', '') || CASE substr({bits('encode(p)')}, i, 1) WHEN '1' THEN chr(9) ELSE ' ' END ELSE x END), lambda x: CASE WHEN ends_with(x, chr(9)) THEN '1' WHEN ends_with(x, ' ') THEN '0' ELSE 'x' END), ''), '^[01]*', 0) AS b FROM text_ws) SELECT doc_id, {from_bits('b')} AS payload_hex FROM m",
        "mark_trailer": f"WITH {FILES}, x AS (SELECT item_id, CASE WHEN {aligned('FFD9')} THEN regexp_extract(h, '^((?:..)*FFD9)', 1) END AS b FROM files) SELECT item_id, sha256(b || '53544547415050' || lpad(hex(octet_length(encode(item_id))), 8, '0') || hex(encode(item_id))) AS sha256 FROM x",
        "recover_trailer": f"WITH {FILES} SELECT item_id, hex(own) AS payload_hex FROM files WHERE {aligned('53544547415050')}",
        "mark_samples": f"WITH {SAMPLES} SELECT vec_id, array_to_string({MARKED_SAMPLES}, ',') AS samples FROM samples",
        "recover_samples": f"WITH {SAMPLES}, m AS (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN {MARKED_SAMPLES} ELSE s END AS s FROM samples), b AS (SELECT vec_id, array_to_string(list_transform(s, lambda v: v & 1), '') AS b FROM m), n AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(b, 1, 32), ''), lambda c: c::BIGINT)), lambda x, y: 2 * x + y) AS n FROM b) SELECT vec_id, CASE WHEN 32 + 8 * n <= 64 THEN {from_bits('substr(b, 33, 8 * n)')} END AS payload_hex, CASE WHEN 32 + 8 * n <= 64 THEN 'ok' ELSE 'declared_length_exceeds' END AS status FROM n",
        "recover_exif": f"WITH {COMMENTS} SELECT doc_id, CASE WHEN {exif_case} THEN substr(hex(c), 17) END AS payload_hex, CASE WHEN {exif_case} THEN 'ok' ELSE 'no_mark' END AS status FROM comments",
        "mark_log": f"WITH {marked_items} SELECT carrier, sealed AS encrypted, count(*) AS n, sum(blob)::BIGINT AS bytes_written FROM placed WHERE status = 'ok' GROUP BY ALL",
        "pack_envelope": f"SELECT doc_id, sha256({pack('hex(encode(text))')}) AS sha256 FROM documents",
        "unpack_envelope": f"WITH {unpacked} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'too_short' WHEN 1 THEN 'bad_magic' WHEN 2 THEN 'unsupported_version' WHEN 3 THEN CASE WHEN n = 0 THEN 'too_short' ELSE 'truncated' END ELSE 'ok' END AS status, CASE WHEN doc_id % 5 = 4 THEN n::INTEGER END AS bytes, CASE WHEN doc_id % 5 = 4 THEN false END AS encrypted FROM b",
        "seal_payloads": "SELECT item_id, (octet_length(encode(text)) + 16)::INTEGER AS bytes, lpad(hex(item_id), 24, '0') AS nonce_hex FROM benchmark",
        "open_payloads": "SELECT item_id, CASE WHEN item_id % 3 > 0 THEN sha256(text) END AS payload_sha256 FROM benchmark",
        "mark_payloads": f"""WITH {marked_items}, plain AS (SELECT *, {pack("hex(encode('id:' || item_id))")} AS p FROM placed), coded AS (SELECT *, {bits("unhex(p)")} AS b, {bits("unhex(lpad(hex(octet_length(unhex(p))), 8, '0') || p)")} AS lb FROM plain)
            SELECT item_id, carrier, status, CASE WHEN status = 'ok' THEN blob END AS bytes_written, status = 'ok' AND sealed AS encrypted, CASE WHEN NOT (status = 'ok' AND sealed) THEN sha256(coalesce(
                CASE WHEN status <> 'ok' THEN text ELSE array_to_string(list_transform(l, lambda x, i: CASE WHEN i <= len(b) THEN regexp_replace(x, '[ \\t]+$', '') || CASE substr(b, i, 1) WHEN '1' THEN chr(9) ELSE ' ' END ELSE x END), chr(10)) || chr(10) END,
                array_to_string(CASE WHEN status <> 'ok' THEN s ELSE list_transform(s, lambda v, i: CASE WHEN i <= len(lb) THEN (v - (v & 1)) + substr(lb, i, 1)::int ELSE v END) END, ','),
                CASE WHEN status <> 'ok' THEN hex(c) ELSE '5354454745584946' || p END)) END AS sha256 FROM coded""",
        "recover_payloads": f"""WITH {marked_items} SELECT item_id, carrier, CASE WHEN sealed AND (id // 100) % 5 = 0 THEN 'key_needed' ELSE 'ok' END AS status, CASE WHEN NOT (sealed AND (id // 100) % 5 = 0) THEN 'id:' || item_id END AS payload
            FROM placed WHERE status = 'ok'""",
        "recover_files": f"""WITH {marked_items} SELECT carrier, CASE WHEN sealed AND (id // 100) % 5 = 0 THEN 'key_needed' ELSE 'ok' END AS status, CASE WHEN NOT (sealed AND (id // 100) % 5 = 0) THEN 'id:' || item_id END AS payload, NULL::VARCHAR AS error
            FROM placed WHERE status = 'ok'""",
        "custom_carrier": f"""WITH {marked_items} SELECT item_id, coalesce(carrier, 'text_hex') AS carrier, 'ok' AS status, 'id:' || item_id AS payload FROM placed WHERE NOT sealed AND (carrier IS NULL OR status = 'ok')""",
        "triage_custom": f"{with_signatures} SELECT item_id, suspicion AS heuristic, least(100, 40 * n)::int AS suspicion, n || ' signals' AS explanation, NULL::VARCHAR AS error FROM told",
        "triage_errors": f"{with_signatures} SELECT item_id, suspicion AS heuristic, CASE WHEN n = 0 THEN 0 ELSE 100 END AS suspicion, n = 0 AS failed FROM told",
        "triage_prompt": f"WITH {FILES}, hits AS ({signature_case}) {sig_prompt}",
        "parse_triage_reply": f"""WITH {REPLIES}, j AS (SELECT event_id, coalesce(try_cast(r AS json), try_cast(nullif(regexp_extract(r, '[{{][^{{}}]*[}}]', 0), '') AS json)) AS v FROM replies)
            SELECT event_id, greatest(0, least(100, coalesce(trunc(json_extract_string(v, '$.suspicion')::DOUBLE)::int, 0))) AS score,
                CASE WHEN v IS NOT NULL THEN coalesce(nullif(trim(json_extract_string(v, '$.explanation')), ''), '(no explanation)') END AS explanation, v IS NULL AS failed FROM j""",
        "custom_analyzer": found(media=False)
        + ", odd AS (SELECT item_id, CASE WHEN (len(h) // 2) % 2 = 1 THEN 10 ELSE 0 END AS suspicion FROM files WHERE ext IN ('.png', '.bin')), both_found AS (SELECT 'odd_length' AS analyzer, suspicion FROM odd UNION ALL SELECT 'ai_triage', greatest(f.suspicion, coalesce(o.suspicion, 0)) FROM found f LEFT JOIN odd o USING (item_id) WHERE f.analyzer = 'ai_triage') SELECT analyzer, suspicion, count(*) AS n FROM both_found GROUP BY ALL",
        "screen_stream": f"""WITH docs AS (SELECT doc_id::VARCHAR AS item_id, text, len({lines('text')}) > 0 AS has_lines FROM documents), hit AS (SELECT item_id, has_lines, list_filter([{', '.join(f"CASE WHEN contains(text, '{x}') THEN {s} END" for _, x, s, _ in SIGNATURES)}], lambda x: x IS NOT NULL) AS s FROM docs)
            SELECT item_id, 'text_whitespace' AS analyzer, 0 AS suspicion, CASE WHEN has_lines THEN 1 ELSE 0 END AS n_signals FROM hit
            UNION ALL SELECT item_id, 'text_zerowidth', 0, 0 FROM hit
            UNION ALL SELECT item_id, 'signatures', coalesce(list_max(s), 0), len(s) FROM hit
            UNION ALL SELECT item_id, 'ai_triage', coalesce(list_max(s), 0), len(s) + CASE WHEN has_lines THEN 1 ELSE 0 END FROM hit""",
    }


SQL = _sql()
assert SQL.keys() <= QUERIES.keys(), SQL.keys() - QUERIES.keys()
