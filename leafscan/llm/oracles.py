"""SQL that DuckDB runs on the same tables."""

OP1 = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to, url
FROM p LEFT JOIN f ON p.d = f.d AND n >= 1000
"""

OP3 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: lower(x) IN (STOPS))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 16.0 * n_words
       AND n_symbols::DOUBLE / n_words <= 0.1
       AND (n_words < 30 OR n_stop_words::DOUBLE / n_words >= 0.05)
       AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.4) AS kept FROM b
"""


def op3(stops: tuple[str, ...]) -> str:
    return OP3.replace("STOPS", ", ".join(f"'{s}'" for s in stops))


def op10(tree: list, grown: list) -> str:
    """One level of the tree after another: a node's children draw, and the least is entered."""

    def nodes(leaves: list) -> str:
        weight: dict[tuple[str, str], float] = {}
        shard = {}
        for x in leaves:
            for parent, path in (("", x.region), (x.region, f"{x.region}/{x.rack}"), (f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}")):
                weight[parent, path] = weight.get((parent, path), 0) + x.weight
            shard[path] = x.shard
        rows = ", ".join(f"('{parent}', '{path}', {w}::DOUBLE, {shard.get(path, -1)})" for (parent, path), w in weight.items())
        return f"(VALUES {rows}) AS n(parent, path, w, s)"

    def level(of: str, leaves: list) -> str:
        draw = "-ln((CAST('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), ':', n.path)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w"
        return f"(SELECT doc_id, arg_min(n.path, {draw}) AS path, arg_min(n.s, {draw}) AS s FROM {of} d JOIN {nodes(leaves)} ON n.parent = d.path GROUP BY doc_id)"

    def descent(leaves: list) -> str:
        of = "(SELECT DISTINCT doc_id, '' AS path FROM documents)"
        for _ in range(3):
            of = level(of, leaves)
        return of

    return f"""
WITH k AS (SELECT list(x ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS x
        FROM (SELECT unnest(range(0, 256)) AS i))),
c AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
             xor(list_reduce(list_transform(range(0, strlen(coalesce(text, ''))), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
                 lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
      FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), k)
SELECT c.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(p.s AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY p.s ORDER BY CAST('0x' || substr(md5(CAST(c.doc_id AS VARCHAR)), 31, 2) AS BIGINT), c.doc_id) - 1 AS slot,
       CAST(q.s AS INTEGER) AS grown_shard
FROM c JOIN {descent(tree)} p ON c.doc_id = p.doc_id JOIN {descent(grown)} q ON c.doc_id = q.doc_id
"""
