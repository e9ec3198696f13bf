"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, hilbert, hmm, langid, packing, partcodes, quality, rangecoder, secrets, simhash, toolcalls, urlfilter
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, said = toolcalls.exchanges(table(spark, sf_dir, "conversations"))
    return toolcalls.link(asked, said, toolcalls.REPLY)


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summarise(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Sites listed whole, under each of the top-level domains.
LISTED_SITES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
#: A series of listed pages, which makes the list as long as lists in use are: every tenth page of a site.
LISTED_PAGES = 200_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The listed URLs, as people write them; the operator makes them canonical."""
    sites = spark.createDataFrame([(f"HTTP://{s.title()}.{d}:80", "block") for s in LISTED_SITES for d in LISTED_DOMAINS], "entry string, verdict string")
    pages = spark.range(LISTED_PAGES).select(F.concat(F.lit("https://blog.tionsh.example.com./en/./"), (F.col("id") * 10).cast("string")).alias("entry"), F.lit("block").alias("verdict"))
    return sites.unionByName(pages)


def op4_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(URL_RULES), "entry string, verdict string")
    return urlfilter.judge(pages, rules, listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_removed").cast("long").alias("n_removed"))


def op6_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.read_ids(rangecoder.write_ids(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = hilbert.assign(table(spark, sf_dir, "documents"))
    return assigned.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summarise(secrets.scan(table(spark, sf_dir, "documents")))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_large_item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partcodes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_call_linking,
        op2_hidden_markov,
        op3_benchmark_decontamination,
        op4_bloom_url_filter,
        op5_line_frequency,
        op6_range_coded_ids,
        op7_hilbert_sharding,
        op8_secret_scan,
        op9_simhash_pivots,
        op10_large_item_matching,
        op11_source_divergence,
        op12_rank_order_language,
        op13_part_codes,
    )
}

ORACLES = {
    "op1_tool_call_linking": r"""
        WITH RECURSIVE u AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS after, text FROM conversations WHERE role = 'user'),
        ids AS (SELECT DISTINCT conv_id, call_id, after FROM u),
        d AS (SELECT conv_id, call_id, 0::BIGINT AS depth FROM ids x WHERE NOT EXISTS (SELECT 1 FROM ids y WHERE y.conv_id = x.conv_id AND y.call_id = x.after)
              UNION ALL SELECT x.conv_id, x.call_id, d.depth + 1 FROM ids x JOIN d ON d.conv_id = x.conv_id AND d.call_id = x.after),
        a AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, arg_min(text, (turn, text)) AS content, min(turn) AS result_turn, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
        j AS (SELECT u.*, d.depth, coalesce(a.n_results, 0) AS n_results, a.result_turn, a.content, CASE WHEN length(u.text) = 0 THEN '$.text: minLength' ELSE '' END AS errors
              FROM u JOIN d USING (conv_id, call_id) LEFT JOIN a USING (conv_id, call_id)),
        s AS (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN n_results > 0 THEN 'linked' ELSE 'open' END AS status FROM j)
        SELECT conv_id, turn, call_id, 'reply' AS name, depth, status, errors, n_results, result_turn,
               CAST(json_object('after', after, 'arguments', json_object('text', text, 'turn', turn), 'call_id', call_id, 'conv_id', conv_id, 'depth', depth,
                    'errors', CASE WHEN errors = '' THEN []::VARCHAR[] ELSE [errors] END, 'name', 'reply',
                    'result', CASE WHEN n_results > 0 THEN json_object('content', content, 'turn', result_turn) END, 'status', status, 'turn', turn) AS VARCHAR) AS message
        FROM s""",
    "op4_bloom_url_filter": r"""
        WITH l(e, v) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
        sites(e) AS (SELECT s || '.' || d FROM (VALUES ('spam-farm'), ('cheap-pills'), ('casino-win'), ('free-bets'), ('ads-track'), ('adult-x')) a(s), (VALUES ('example.com'), ('example.net'), ('example.org')) b(d)),
        listed(e) AS (SELECT 'blog.tionsh.example.com/en/' || (10 * i) FROM range(200000) t(i)),
        p AS (SELECT page_id, row_number() OVER () AS r, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        c AS (SELECT r, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS host, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM p WHERE host <> ''),
        f AS (SELECT r, arg_max(e, length(e)) AS e, arg_max(v, length(e)) AS v
              FROM p JOIN l ON (host = split_part(e, '/', 1) OR ends_with(host, '.' || split_part(e, '/', 1))) AND starts_with(path, substr(e, strpos(e, '/'))) GROUP BY r),
        b AS (SELECT r, max(e) AS e FROM (SELECT r, sites.e || '/' AS e, 1 FROM c JOIN sites ON c.host = sites.e OR ends_with(c.host, '.' || sites.e)
                                          UNION ALL SELECT r, listed.e, 2 FROM c JOIN listed ON c.host || c.path = listed.e) GROUP BY r)
        SELECT page_id, host, path, f.e AS rule, coalesce(f.v, CASE WHEN b.e IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN f.e IS NULL THEN b.e END AS listed
        FROM p LEFT JOIN f USING (r) LEFT JOIN b USING (r)""",
    "op3_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []::VARCHAR[]) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        hit AS (SELECT p.r, p.i, p.n, x.item_id FROM pos p JOIN win x ON x.n = p.n AND x.s = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
        hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
        -- places in the text: separators and words in turn, their lengths added up
        part AS (SELECT r, doc_id, text, regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w, string_split_regex(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS sep
                 FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents) WHERE r IN (SELECT r FROM hit)),
        word AS (SELECT r, k, sum(gap + size) OVER (PARTITION BY r ORDER BY k) AS stop, size
                 FROM (SELECT r, unnest(range(1, len(w) + 1)) AS k, length(unnest(w)) AS size, length(unnest(sep[1:len(w)])) AS gap FROM part)),
        run AS (SELECT r, k, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit)),
        place AS (SELECT r, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS places
                  FROM (SELECT r, run, min(stop - size)::BIGINT AS lo, max(stop)::BIGINT AS hi FROM run JOIN word USING (r, k) GROUP BY r, run) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(places, '') AS places
        FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r) LEFT JOIN place USING (r)""",
    "op5_line_frequency": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
        rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
        raw_lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
        lines AS (SELECT r, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size,
                         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
                  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
        texts AS (SELECT host, text, min(r) AS r FROM d WHERE r IN (SELECT r FROM lines) GROUP BY host, text),
        lim AS (SELECT host, least(1000, greatest(10, 0.01 * count(*))) AS lim FROM texts GROUP BY host),
        freq AS (SELECT t.host, l.norm FROM texts t JOIN (SELECT DISTINCT r, norm FROM lines) l USING (r) GROUP BY t.host, l.norm
                 HAVING count(*) > (SELECT lim FROM lim WHERE lim.host IS NOT DISTINCT FROM t.host)),
        rem AS (SELECT l.r, sum(l.size)::BIGINT AS n FROM lines l JOIN d USING (r) JOIN freq f ON f.norm = l.norm AND f.host IS NOT DISTINCT FROM d.host GROUP BY l.r),
        m AS (SELECT d.r, d.doc_id, len(w.w)::BIGINT AS n_words, len(array_to_string(w.w, ''))::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                     coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed
              FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rem USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (1000 * (n_words - n_removed) < 200 * n_words) AS kept, n_removed FROM m""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n, any_value(lc) AS lc FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        l AS (SELECT lang, sum(lc) AS ln, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT lang, source, coalesce(sum(n), 0) AS gn FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1))::HUGEINT // (gn + v)::HUGEINT AS p,
                     1 + (1000000000 * (k.lc + 1))::HUGEINT // (ln + v)::HUGEINT AS q
              FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
                 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM s WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pair
        UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM term QUALIFY rank <= 200""",
    "op13_part_codes": r"""
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS w FROM e, range(16) t(part)),
        k0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS idx, w FROM p JOIN (SELECT r, vec_id FROM e ORDER BY vec_id LIMIT 64) USING (r)),
        a1 AS MATERIALIZED (SELECT r, p.part, p.w, arg_min(idx, (list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.w, k.w)]), idx)) AS idx FROM p JOIN k0 k USING (part) GROUP BY r, p.part, p.w),
        m1 AS (SELECT part, idx, list(m ORDER BY i) AS w FROM (SELECT part, idx, i, floor_div(sum(x)::HUGEINT, count(*)::HUGEINT) AS m FROM (SELECT part, idx, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a1) GROUP BY ALL) GROUP BY part, idx),
        k1 AS MATERIALIZED (SELECT part, idx, coalesce(m1.w, k0.w) AS w FROM k0 LEFT JOIN m1 USING (part, idx)),
        a2 AS MATERIALIZED (SELECT r, p.part, p.w, arg_min(idx, (list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.w, k.w)]), idx)) AS idx FROM p JOIN k1 k USING (part) GROUP BY r, p.part, p.w),
        m2 AS (SELECT part, idx, list(m ORDER BY i) AS w FROM (SELECT part, idx, i, floor_div(sum(x)::HUGEINT, count(*)::HUGEINT) AS m FROM (SELECT part, idx, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a2) GROUP BY ALL) GROUP BY part, idx),
        k2 AS MATERIALIZED (SELECT part, idx, coalesce(m2.w, k1.w) AS w FROM k1 LEFT JOIN m2 USING (part, idx)),
        a3 AS (SELECT r, part, min((list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.w, k.w)]), idx)) AS best FROM p JOIN k2 k USING (part) GROUP BY r, part),
        f AS (SELECT r, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a3 GROUP BY r),
        b AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, idx)) AS h FROM k2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN e USING (r), b""".replace(
        "floor_div(sum(x)::HUGEINT, count(*)::HUGEINT)", "(sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)"
    ),
    "op12_rank_order_language": r"""
        WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) b(i)),
        d AS (SELECT row_number() OVER () AS r, doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}]+') AS w, regexp_matches(coalesce(text, ''), '\p{L}') AS letters,
                     xor(list_reduce(list_concat([4294967295], [ord(x) for x in string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 AS held_out FROM documents, tab),
        words AS (SELECT r, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
        places AS (SELECT r, w, c, length(w) AS size, unnest(range(1, length(w))) AS i FROM words),
        grams AS (SELECT r, g, sum(c)::BIGINT AS c FROM (SELECT r, substr(w, i, 1) AS g, c FROM places WHERE i > 1 UNION ALL SELECT r, substr(w, i, 2), c FROM places UNION ALL SELECT r, substr(w, i, 3), c FROM places WHERE i < size - 1) GROUP BY ALL),
        own AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY c DESC, g) - 1 AS place FROM grams QUALIFY place < 300),
        learnt AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) - 1 AS place FROM (SELECT lang, g, sum(c) AS c FROM grams JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY place < 300),
        near AS (SELECT r, lang, sum(300 - abs(o.place - l.place))::BIGINT AS s FROM own o JOIN learnt l USING (g) GROUP BY ALL),
        far AS (SELECT r, l.lang, (300 * n - coalesce(s, 0))::BIGINT AS distance, n FROM (SELECT r, count(*) AS n FROM own GROUP BY r) JOIN (SELECT r, letters FROM d) USING (r) JOIN (SELECT DISTINCT lang FROM learnt) l ON letters LEFT JOIN near USING (r, lang)),
        best AS (SELECT r, arg_min(lang, (distance, lang)) AS lang, min(distance) AS distance, any_value(n) AS n FROM far GROUP BY r)
        SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - distance::DOUBLE / (300 * n), 0) AS score, distance FROM d LEFT JOIN best USING (r)""",
}
