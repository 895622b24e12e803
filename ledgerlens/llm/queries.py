"""One registered query per operator, over whole tables, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import (
    chat, collocations, decontaminate, exact_dedup, jaccard_join, licenses, mixing, periodic_runs, pii, quality, token_counts, url_filter, warc,
)
from ledgerlens.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_verdicts(pages, url_filter.rules_frame(spark), url_filter.advertising(pages))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"), licenses.standard_templates(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(rows.unionByName(chat.probe(spark)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_pii": op3_pii,
    "op4_url_filter": op4_url_filter,
    "op5_source_mix": op5_source_mix,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_chat": op10_chat,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_token_counts": op13_token_counts,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

def _periodic_runs_sql(levels: int = 18) -> str:
    """Periods up to 2 ** (levels - 1): groups of m words are numbered for m = 1, 2, 4 ..., a period q of more than m / 2 and up
    to m shows as the distance to the next equal group, and stretches of words equal q on are laid out for such q alone."""
    step = "lambda v, z: xor(v >> 1, 3988292384 * (v & 1))"
    letters = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = (f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {letters}),"
           f" lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})))")
    groups, lags = ["c1 AS MATERIALIZED (SELECT rid, i, dense_rank() OVER (ORDER BY w) AS c FROM e)"], []
    for m in (2 ** k for k in range(levels)):
        if m > 1:
            groups.append(f"c{m} AS MATERIALIZED (SELECT rid, i, dense_rank() OVER (ORDER BY c, x) AS c FROM ("
                          f"SELECT rid, i, c, lead(c, {m // 2}) OVER (PARTITION BY rid ORDER BY i) AS x FROM c{m // 2}) WHERE x IS NOT NULL)")
        lags.append(f"SELECT rid, q FROM (SELECT rid, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS s FROM ("
                    f"SELECT rid, i, lead(i) OVER (PARTITION BY rid, c ORDER BY i) - i AS q FROM c{m}) WHERE 2 * q > {m} AND q <= {m})"
                    f" GROUP BY rid, q, s HAVING count(*) > greatest(24, 3 * q) - q - {m}")
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          coalesce({crc}, 1) AS h FROM documents),
        m AS (SELECT rid, doc_id, w, h % 10 = 0 AND len(w) > 0 AS moved, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
                     1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
        e AS MATERIALIZED (SELECT rid, i, w[CASE WHEN moved AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w
              FROM (SELECT *, unnest(range(0, len(w))) AS i FROM m)),
        {", ".join(groups)},
        lag AS MATERIALIZED ({" UNION ".join(lags)}),
        r AS (SELECT rid, min(i) AS start, count(*) + q AS length, q AS period FROM (
                SELECT x.rid, l.q, x.i, x.i - row_number() OVER (PARTITION BY x.rid, l.q ORDER BY x.i) AS s
                FROM lag l JOIN e x ON x.rid = l.rid JOIN e y ON y.rid = x.rid AND y.i = x.i + l.q WHERE x.w = y.w)
              GROUP BY rid, q, s HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS MATERIALIZED (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.rid = r.rid AND z.period < r.period
                AND z.start <= r.start AND z.start + z.length >= r.start + r.length)),
        best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) AS nth,
                        count(*) OVER (PARTITION BY rid) AS n_runs FROM runs),
        listed AS (SELECT rid, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY rid),
        gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
        left_ AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM e ANTI JOIN gone USING (rid, i) GROUP BY rid)
        SELECT d.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period AS exponent_milli,
               sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
        FROM d LEFT JOIN best b ON b.rid = d.rid AND b.nth = 1 LEFT JOIN listed l ON l.rid = d.rid LEFT JOIN left_ k ON k.rid = d.rid"""


ORACLE: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op4_url_filter": rf"""
        WITH p AS (
            SELECT page_id, url, {_LOWER.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
            FROM pages),
        u AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
                        || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM p),
        listed AS (SELECT DISTINCT canonical FROM u WHERE contains(host, 'casino') OR contains(host, 'bets') OR contains(host, 'pills')),
        rules(rule_host, rule_path, verdict) AS (VALUES
            ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT p.page_id, rule_host || rule_path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
            FROM p JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM u LEFT JOIN fits f ON u.page_id = f.page_id AND f.nth = 1 LEFT JOIN listed l ON contains(u.url, '://') AND l.canonical = u.canonical""",
    "op5_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, 3 * source_size AS cap FROM s),
        w AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 AS INTEGER) + 1] AS weight FROM r),
        k AS (SELECT *, cap / weight AS per_weight FROM w),
        l AS (SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER o - cap) AS DOUBLE)
                        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM k WINDOW o AS (ORDER BY per_weight, rank)),
        t AS (SELECT *, least(CAST(cap AS DOUBLE), max(CASE WHEN level <= per_weight THEN level END) OVER () * weight) AS target
              FROM l),
        q AS (SELECT d.doc_id, d.size, d.h, t.rank, t.source_size, t.target,
                     sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT q.*, n.round, CASE WHEN target > 0 THEN CAST(n.round * source_size + upto AS DOUBLE) / target ELSE 0.0 END AS finish
              FROM q CROSS JOIN (VALUES (0), (1), (2)) n(round)),
        m AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, h, doc_id, size, round ROWS UNBOUNDED PRECEDING)
                        <= sum(size) OVER () / 3 AS in_mix FROM c)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(sum(CASE WHEN in_mix THEN size ELSE 0 END) AS BIGINT) AS taken
        FROM m GROUP BY doc_id, size, source_size, target""",
    "op8_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
                FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
                      FROM b WHERE len(w) > 0)),
        pos AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
                FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                      FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM pos p JOIN win ON p.k = win.k AND p.gram = win.gram),
        n AS (SELECT doc_id, count(DISTINCT nth) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS nth FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
               sha256(coalesce(it.items, '')) AS items_sha256,
               coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT page_id, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS m,
                     list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(h), 5 * i + 1, 5) AS BIGINT)) AS x FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(x, lambda v: array_to_string(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
        FROM g""",
    "op10_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
                   UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
               CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(14 + length(r) + len(regexp_extract_all(r, '\\|### |</turn>|:'))
                        + length(t) + len(regexp_extract_all(t, '\\|### |</turn>'))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op11_periodic_runs": _periodic_runs_sql(),
    "op12_collocations": r"""
        WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({text}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        f AS (SELECT lang, size, phrase, count(*) AS f FROM (
                SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
                    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, 6) r(size)))
              GROUP BY lang, size, phrase HAVING count(*) >= 100),
        c AS (SELECT lang, phrase, f AS a, size, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x,
                     array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
              FROM f, range(1, 5) r(k) WHERE k < size),
        s AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, t.n,
                     (1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
              FROM c JOIN t ON t.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        g AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
              WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = b.lang AND z.size > b.size AND z.f >= b.a
                                AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')))
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM g WHERE rank <= 2000""".replace("{text}", _TEXT),
}
