"""The thin queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.session import load

RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op1_url_filter(spark, d):
    from granary.llm.url_filter import url_filter

    return url_filter(load(spark, d, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_secret_scan(spark, d):
    import public_tokenizers

    from granary.llm.secret_scan import dictionary, sample_findings, scan, train

    words = dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scan(load(spark, d, "documents"), train(spark, sample_findings(), words), words)


def _ranks():
    import public_tokenizers

    from granary.llm.bpe import read_ranks

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_byte_bpe(spark, d):
    from granary.llm.bpe import round_trip

    ranks, pattern = _ranks()
    return round_trip(load(spark, d, "documents"), ranks, pattern)


def op4_decontamination(spark, d):
    from granary.llm.decontam import scan

    out = scan(load(spark, d, "documents"), load(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_quality(spark, d):
    from granary.llm.quality import score

    return score(load(spark, d, "documents"), load(spark, d, "labels"))


def op6_language_id(spark, d):
    from granary.llm.langid import predict, train

    docs = load(spark, d, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"))
    held = F.coalesce("held_out", F.lit(False))
    return predict(docs.withColumn("held_out", held), train(docs.filter(~held)), keep=("held_out",))


def op7_suffix_dedup(spark, d):
    from granary.llm.suffix_dedup import remove_repeats

    out = remove_repeats(load(spark, d, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_join(spark, d):
    from granary.llm.ngram_join import similarity_join

    return similarity_join(load(spark, d, "documents"))


def op9_warc(spark, d):
    from granary.llm.warc import round_trip

    return round_trip(load(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark, d):
    from granary.llm.exact_dedup import exact_dedup

    return exact_dedup(load(spark, d, "documents")).drop("n_chars")


def queries():
    return {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_byte_bpe, op4_decontamination, op5_quality, op6_language_id, op7_suffix_dedup, op8_ngram_join, op9_warc, op10_exact_dedup)}


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in ((r.split(" ")[0], r.split(" ")[1].split("/", 1)[0], "/" + r.split("/", 1)[1]) for r in RULES))

_HOST = r"translate(regexp_extract({}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _absolute(base: str, link: str, empty: str = "''") -> str:
    return rf"""CASE WHEN {link} = '' THEN {empty} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract({base}, '^([^:]*):', 1) || ':' || {link}
                         WHEN starts_with({link}, '/') THEN regexp_extract({base}, '^(.*?://[^/?#]*)', 1, 's') || {link} WHEN starts_with({link}, '?') THEN regexp_extract({base}, '^([^?#]*)', 1) || {link}
                         ELSE rtrim(regexp_extract({base}, '^(.*?://[^/?#]*(/[^?#]*/|/)?)', 1, 's'), '/') || '/' || {link} END"""


ORACLE = {
    # Aliases are walked to, edge by edge, from every url of a page.
    "op1_url_filter": rf"""
        WITH RECURSIVE
             tags AS (SELECT DISTINCT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '<(?:link|meta|base)\b[^>]*>', 0, 'is')) AS t FROM pages WHERE url IS NOT NULL),
             bases AS (SELECT url, any_value(regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')) AS base FROM tags WHERE regexp_matches(t, '^<base\b.*\bhref', 'is') GROUP BY url),
             raw AS (SELECT url, CASE WHEN regexp_matches(t, '^<link\b.*?\srel\s*=\s*("([^"]*\s)?canonical(\s[^"]*)?"|''([^'']*\s)?canonical(\s[^'']*)?''|canonical[\s/>])', 'is') THEN regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
                                      WHEN regexp_matches(t, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b', 'is') THEN regexp_extract(t, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') END AS link FROM tags),
             based AS (SELECT raw.url, replace(link, '&amp;', '&') AS link, replace(coalesce(base, ''), '&amp;', '&') AS base FROM raw LEFT JOIN bases USING (url) WHERE link <> ''),
             full_base AS (SELECT url, link, {_absolute("url", "base", empty="url")} AS base FROM based),
             found AS (SELECT DISTINCT url AS src, {_absolute("base", "link")} AS dst FROM full_base),
             named AS (SELECT src AS u FROM found UNION SELECT dst FROM found UNION SELECT url FROM pages WHERE url IS NOT NULL),
             bare AS (SELECT u, regexp_replace(u, '#.*$', '', 's') AS b FROM named),
             parts AS (SELECT u, b, regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*)([^?]*)(.*)$', ['scheme', 'host', 'path', 'rest'], 's') AS x FROM bare),
             nodes AS (SELECT u, CASE WHEN x.scheme = '' THEN b ELSE lower(x.scheme) || '://' || lower(x.host) || CASE WHEN x.path = '' THEN '/' ELSE x.path END || x.rest END AS node FROM parts),
             edge AS (SELECT a.node AS x, b.node AS y FROM found JOIN nodes a ON src = a.u JOIN nodes b ON dst = b.u),
             both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
             reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
             p AS (SELECT page_id, url, {_HOST.format("coalesce(url, '')")} AS host, {_PATH.format("coalesce(url, '')")} AS path FROM pages),
             r(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
             m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
                   FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
             q AS (SELECT DISTINCT node, {_HOST.format("node")} AS host, {_PATH.format("node")} AS path FROM nodes),
             own AS (SELECT node, arg_max(verdict, length(rhost || rpath)) AS verdict
                     FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node),
             passed AS (SELECT reach.x AS node, min(verdict) AS verdict FROM reach JOIN own ON own.node = reach.y GROUP BY reach.x)
        SELECT p.page_id, host, path, rule, coalesce(m.verdict, passed.verdict, 'allow') AS verdict
        FROM p LEFT JOIN m USING (page_id) LEFT JOIN nodes ON nodes.u = p.url LEFT JOIN passed ON passed.node = nodes.node""",
    "op4_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bs AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0),
             g AS (SELECT DISTINCT item_id, size, w[i : i + size - 1] AS gram FROM bs),
             sizes AS (SELECT DISTINCT size FROM g),
             ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size),
             dg AS (SELECT doc_id, size, i, w[i : i + size - 1] AS gram FROM ds),
             h AS (SELECT doc_id, item_id, i, size FROM dg JOIN g USING (size, gram)),
             c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)""",
    # Windows of 400 bytes are 800 hexadecimal digits, grouped by their MD5 as a number.
    "op7_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS k, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
             w AS (SELECT k, i, md5_number(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT k, h, unnest(range(length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
             hit AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 400 AS goes_on FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
             run AS (SELECT k, min(i) AS start, max(i) + 400 AS stop FROM (SELECT k, i, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS r FROM hit) GROUP BY k, r),
             piece AS (SELECT k, start, stop, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY start), 0) AS before FROM run),
             gone AS (SELECT k, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans, max(stop) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS head FROM piece JOIN d USING (k) GROUP BY k)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
        FROM d LEFT JOIN gone USING (k)""",
    # Classes of equal shingle sets, their pairs by a join on shingles, and a walk over the links.
    "op8_ngram_join": r"""
        WITH RECURSIVE
             t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM t WHERE len(w) > 0),
             c AS (SELECT s, min(doc_id) AS class, count(*) AS size, len(s) AS n FROM s GROUP BY s),
             e AS (SELECT class, unnest(s) AS g FROM c),
             shared AS (SELECT a.class AS a, b.class AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.class <> b.class GROUP BY 1, 2),
             link AS (SELECT a, b FROM shared JOIN c x ON x.class = a JOIN c y ON y.class = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
             reach(a, b) AS (SELECT class, class FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
             root AS (SELECT a AS class, min(b) AS class_id FROM reach GROUP BY a),
             others AS (SELECT a AS class, sum(size)::BIGINT AS n FROM link JOIN c ON class = b GROUP BY a)
        SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, coalesce(size - 1 + coalesce(others.n, 0), 0) AS n_links, coalesce(size - 1, 0) AS n_copies
        FROM t LEFT JOIN s USING (doc_id) LEFT JOIN c USING (s) LEFT JOIN root USING (class) LEFT JOIN others USING (class)""",
    # 40 hexadecimal digits are 160 bits: 32 digits of base 32.
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(sha1(h), i, 1)) - 3, 4)), '') AS bits FROM p),
             f AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (substr(bits, 5 * i + j + 1, 1) = '1')::INT * (16 >> j)))::INT, 1)), '') AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM b)
        SELECT page_id, octet_length(encode(h)) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)""",
}


def oracle_sql():
    return dict(ORACLE)
