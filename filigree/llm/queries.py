"""The queries of the corpus operators, with production parameters, and their SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import linededup, media, mixing, neighbours, packing, pii, repeats, simhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.drop_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return d.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("sentences")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids", "padded")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), least=50)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_neighbours": op2_neighbours,
    "op3_repeats": op3_repeats,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_linededup": op9_linededup,
    "op10_media": op10_media,
}

def _pii_sql() -> str:
    """Gaps and matches as in the operator. RE2 has no look-behind, so the edges of the added kinds are tested on the gaps."""
    base = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"),
        "card": ("[0-9]([ -]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"),
        "phone": ("[+][0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    }
    near = "lower(right(before, 40) || ' ' || left(after, 40))"
    alone = "NOT regexp_matches(right(before, 1), '[{0}]') AND NOT regexp_matches(left(after, 1), '[{0}]')"
    turned = "substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4)"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({turned}, ''), lambda c: CASE WHEN c >= 'A' THEN 100 + ascii(c) - 55 ELSE c::BIGINT END)), lambda a, c: CASE WHEN c >= 100 THEN (a * 100 + c - 100) % 97 ELSE (a * 10 + c) % 97 END) = 1"
    added = {
        "iban": (pii._iban(edges=False), f"{alone.format('A-Za-z0-9')} AND {mod97}"),
        "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{alone.format('0-9-')} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches({near}, 'ssn|social|security|tax')"),
    }
    kinds = base | added
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS place, '{name}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM t" for k, (name, (pattern, _)) in enumerate(kinds.items())
    )
    valid = " ".join(f"WHEN '{name}' THEN {test}" for name, (_, test) in kinds.items())
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}), u AS (
            SELECT doc_id, place, kind, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM f
        ), x AS (
            SELECT doc_id, place, kind, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, gaps[i] AS before, gaps[i + 1] AS after,
                (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS s FROM u
        ), v AS (
            SELECT doc_id, place, kind, s, kind || ':' || s || ':' || (s + length(m)) AS span FROM x WHERE CASE kind {valid} END
        ), a AS (
            SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                string_agg(span, ',' ORDER BY s, place) FILTER (place < 4) AS base, string_agg(span, ',' ORDER BY s, place) AS spans FROM v GROUP BY doc_id
        )
        SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN a USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op8_pii": _pii_sql(),
    # No text here holds a whole medium, so none is told inside; the checksum is that of 512 steps of a bit each.
    "op10_media": """
        WITH t AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), p AS (
            SELECT doc_id, length(h) // 2 AS n_bytes, greatest(64, (length(h) // 2 + 63) // 64 * 64) AS size, h FROM t
        ), q AS (
            SELECT doc_id, n_bytes, size, rpad(h, (2 * size)::INT, '0') AS x,
                printf('%02X%02X%02X%02X', (36 + size) & 255, ((36 + size) >> 8) & 255, ((36 + size) >> 16) & 255, (36 + size) >> 24) AS riff,
                printf('%02X%02X%02X%02X', size & 255, (size >> 8) & 255, (size >> 16) & 255, size >> 24) AS data FROM p
        ), b AS (
            SELECT doc_id, i, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT AS b FROM (SELECT doc_id, x, unnest(range(size)) AS i FROM q)
        ), m AS (
            SELECT doc_id, sum(b)::BIGINT AS total, count(*) AS n, sum(b * b)::BIGINT AS square FROM b GROUP BY doc_id
        ), u AS (
            SELECT doc_id, i, b > total // n AS up FROM b JOIN m USING (doc_id)
        ), c AS (
            SELECT doc_id, count(*) FILTER (turned) AS turns FROM (SELECT doc_id, up <> lag(up) OVER (PARTITION BY doc_id ORDER BY i) AS turned FROM u) GROUP BY doc_id
        ), l AS (
            SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(range(512), lambda k: CASE WHEN k % 8 = 0 THEN ('0x' || substr(tail, k // 4 + 1, 2))::BIGINT ELSE 0 END)),
                lambda a, y: xor(xor(a, y) >> 1, 3988292384 * (xor(a, y) & 1))) AS crc FROM (SELECT doc_id, right(x, 128) AS tail FROM q)
        )
        SELECT doc_id, n_bytes, size AS payload_bytes, sha256(unhex(x)) AS payload_sha256, xor(crc, 4294967295) AS tail_crc32, size + 44 AS media_bytes,
            sha256(unhex('52494646' || riff || '57415645666D7420100000000100010040' || '1F0000401F00000100080064617461' || data || x)) AS media_sha256,
            printf('audio/wav;n=%d;mean=%.4f;sd=%.4f;turns=%d;inside=0', n, total / n::DOUBLE, sqrt(greatest(0, square / n::DOUBLE - (total / n::DOUBLE) * (total / n::DOUBLE))), turns) AS feature
        FROM q JOIN m USING (doc_id) JOIN c USING (doc_id) JOIN l USING (doc_id)
    """,
    "op3_repeats": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), g AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d)
        ), f AS (
            SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS earliest FROM g
        ), l AS (
            SELECT doc_id, p, p > coalesce(lag(p) OVER w, -51) + 50 AS fresh FROM f WHERE earliest < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY p)
        ), i AS (
            SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM l
        ), r AS (
            SELECT doc_id, island, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY ALL
        ), k AS (
            SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM r
        ), c AS (
            SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
            FROM k JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
    """,
    "op9_linededup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
        ), u AS (
            SELECT doc_id, raw, unnest(raw) AS line, generate_subscripts(raw, 1) AS i FROM d
        ), l AS (
            SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s,
                len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM u
        ), n AS (
            SELECT *, row_number() OVER w AS k, sum(words) OVER w AS upto FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), a AS (
            SELECT doc_id, list(s ORDER BY k) AS lines FROM n GROUP BY doc_id
        ), p AS (
            SELECT x.doc_id, x.k AS s, min(y.k) AS e FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.upto - x.upto + x.words >= 50 GROUP BY ALL
            UNION
            SELECT y.doc_id, max(x.k), y.k FROM n x JOIN n y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.upto - x.upto + x.words >= 50 GROUP BY y.doc_id, y.k
        ), c AS (
            SELECT p.doc_id, f.i AS f, t.i AS t, list_slice(lines, p.s, p.e) AS content
            FROM p JOIN a USING (doc_id) JOIN n f ON f.doc_id = p.doc_id AND f.k = p.s JOIN n t ON t.doc_id = p.doc_id AND t.k = p.e
        ), o AS (
            SELECT *, min({'d': doc_id, 'f': f}) OVER (PARTITION BY content) AS origin FROM c
        ), g AS (
            SELECT DISTINCT u.doc_id, u.i FROM o JOIN u ON o.doc_id = u.doc_id AND u.i BETWEEN f AND t WHERE {'d': o.doc_id, 'f': f} > origin
        ), r AS (
            SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g
        ), h AS (
            SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_runs FROM r GROUP BY doc_id
        ), k AS (
            SELECT u.doc_id, string_agg(line, chr(10) ORDER BY u.i) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id
        )
        SELECT d.doc_id, len(raw) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), k AS (
            SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest,
            CASE WHEN page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= 1000
    """,
}
