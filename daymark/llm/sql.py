"""SQL counterparts of the text operators' queries."""

from __future__ import annotations

from daymark.llm.mixing import OTHER, SWEEPS, TEMPERATURE, TOPICS

FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words_of(table: str, key: str) -> str:
    fold = FOLD.format("text")
    return f"""
    SELECT {key}, w, len(w) AS n FROM (
      SELECT {key}, regexp_extract_all({fold}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM {table})"""


DECONTAMINATION = f"""
WITH d AS ({_words_of("documents", "doc_id")}
), b AS ({_words_of("benchmark", "item_id")}
), wins AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT item_id, w, least(n, 10) AS size,
           unnest(generate_series(1, greatest(n - 9, 1))) AS i
    FROM b WHERE n > 0)
), sizes AS (SELECT DISTINCT size FROM wins
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT doc_id, w, size, unnest(generate_series(1, n - size + 1)) AS i
    FROM d JOIN sizes ON size <= n)
), hits AS (
  SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN wins v ON p.size = v.size
    AND p.win = v.win
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
    SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS pos
    FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, d.n AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.listed, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


def shards(max_bytes: int, levels: int = 16) -> str:
    """Shortest prefixes that fit, down to ``levels`` bits."""
    return f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)),
         60, '0') AS whole
  FROM documents
), nodes AS (
  SELECT depth, substr(whole, 1, depth) AS node, sum(n_bytes) AS bytes,
    count(*) AS n
  FROM r, generate_series(0, {levels}) AS g(depth) GROUP BY 1, 2
), leaves AS (
  SELECT n.* FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1
    AND p.node = substr(n.node, 1, n.depth - 1)
  WHERE (n.depth = 0 OR (p.bytes > {max_bytes} AND p.n > 1))
    AND (n.bytes <= {max_bytes} OR n.n = 1 OR n.depth = {levels})
)
SELECT r.doc_id, CAST(r.n_bytes AS BIGINT) AS n_bytes, l.node AS shard,
       CAST(l.depth AS BIGINT) AS depth, CAST(l.bytes AS BIGINT) AS shard_bytes
FROM r JOIN leaves l ON l.node = substr(r.whole, 1, l.depth)
"""


def _topic() -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(coalesce(text, ''), '{pattern}') THEN '{name}'"
        for name, pattern in TOPICS) + f" ELSE '{OTHER}' END"


def mixing(sweeps: int = SWEEPS, temperature: float = TEMPERATURE) -> str:
    """The sweeps written out one after another over the table of cells."""
    margins = ("source", "lang", "topic")
    parts = [f"""
docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_topic()} AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)
         AS BIGINT) AS DOUBLE) / {float(1 << 52)} AS draw
  FROM documents
), c0 AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens,
         CAST(sum(n_tokens) AS DOUBLE) AS w
  FROM docs GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0)"""]
    for m in margins:
        parts.append(f"""
target_{m} AS MATERIALIZED (
  SELECT {m}, p / sum(p) OVER () AS want FROM (
    SELECT {m}, pow(sum(tokens) / (SELECT sum(tokens) FROM c0), {temperature}) AS p
    FROM c0 GROUP BY 1))""")
    last = "c0"
    for i in range(sweeps):
        for m in margins:
            name = f"c{i}_{m}"
            parts.append(f"""
{name} AS MATERIALIZED (
  SELECT c.source, c.lang, c.topic, c.tokens,
         c.w * t.want / sum(c.w) OVER (PARTITION BY c.{m}) AS w
  FROM {last} c JOIN target_{m} t ON t.{m} = c.{m})""")
            last = name
    # The fit ends on the source margin, as source factors are computed from the others.
    parts.append(f"""
fitted AS MATERIALIZED (
  SELECT c.source, c.lang, c.topic,
         c.w * t.want / sum(c.w) OVER (PARTITION BY c.source) / c.tokens
           * (SELECT sum(tokens) FROM c0) AS weight
  FROM {last} c JOIN target_source t ON t.source = c.source)""")
    return "WITH " + ",".join(parts) + """
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n_tokens AS BIGINT) AS n_tokens,
       round(coalesce(f.weight, m.top), 6) AS weight,
       round(coalesce(f.weight, m.top) / m.top, 6) AS probability,
       d.draw < coalesce(f.weight, m.top) / m.top AS sampled
FROM docs d LEFT JOIN fitted f USING (source, lang, topic)
CROSS JOIN (SELECT coalesce(max(weight), 1.0) AS top FROM fitted) m
"""


def clusters(k: int, rounds: int, scale: int, dimensions: int = 64) -> str:
    """The rounds written out one after another over all pairs of vector and centroid."""
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(
    embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v
    ORDER BY h, q LIMIT {k}))"""]

    def nearest(centroids: str) -> str:
        return f"""
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, m.c, list_sum(list_transform(list_zip(v.q, m.q),
           lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM v CROSS JOIN {centroids} m) GROUP BY r"""

    for i in range(rounds):
        parts.append(f"""
a{i} AS MATERIALIZED ({nearest(f"c{i}")}
), m{i} AS MATERIALIZED (
  SELECT c, list(x ORDER BY p) AS q FROM (
    SELECT c, p, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT a.c, p, sum(v.q[p]) AS s, count(*) AS n
      FROM a{i} a JOIN v USING (r), range(1, {dimensions + 1}) AS g(p) GROUP BY 1, 2))
  GROUP BY c
), c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    parts.append(f"""
last AS MATERIALIZED ({nearest(f"c{rounds}")})""")
    return "WITH " + ",".join(parts) + f"""
SELECT v.vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(l.d AS BIGINT) AS distance,
       CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(l.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM last l JOIN v USING (r) JOIN c{rounds} c ON c.c = l.c
"""


#: crc32 of a short ASCII text, byte by byte over its table of 256 remainders.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, len({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)),
    lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"""

PREFIX_TRIE = f"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders
), turns AS (
  SELECT conv_id, turn, md5(strlen(r) || ':' || r || x) AS k,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
        FROM conversations WHERE conv_id IS NOT NULL)
), own AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS ts
  FROM turns GROUP BY conv_id
), heads AS (
  SELECT own.*, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc
), rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts
  FROM heads a LEFT JOIN own b ON b.conv_id = a.base
), members AS MATERIALIZED (
  SELECT conv_id, len(ts) AS n, d, list_transform(ts[1:d], lambda t: t.k) AS node,
         list_transform(ts[1:d - 1], lambda t: t.k) AS up, coalesce(ts[d].w, 0) AS w
  FROM rebuilt, unnest(range(len(ts) + 1)) AS g(d)
), nodes AS MATERIALIZED (
  SELECT node, d AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(w) AS w,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                  FILTER (n = d), '') AS ends
  FROM members GROUP BY node, d
), kids AS MATERIALIZED (
  SELECT up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT top, sum(extra) AS saved_tokens, sum(leaf) AS n_leaves FROM (
    SELECT x.node[1:a] AS top, (x.n_convs - 1) * x.w AS extra,
           CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes x LEFT JOIN kids k ON k.node = x.node, unnest(range(x.depth + 1)) AS g(a))
  GROUP BY top
)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs,
       coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.top = n.node LEFT JOIN kids k ON k.node = n.node
LEFT JOIN nodes p ON p.node = n.up AND p.depth = n.depth - 1
"""
