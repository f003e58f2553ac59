"""DuckDB SQL for the results that SQL can express."""

from __future__ import annotations

#: CRC-32 over the UTF-8 bytes of ``t`` as a DuckDB macro: the usual table, built from the polynomial.
CRC32 = """
crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i)))"""


def _crc(hex_text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(length({hex_text}) // 2), lambda i: ('0x' || substr({hex_text}, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))"""


def shard_sql(shards: int) -> str:
    """Shards by the draws at each level; two racks of two shards make a region, one more stands alone."""
    nodes = []
    for s in range(shards):
        region = f"region{s // 4}"
        rack = f"{region}/rack{s // 2 % 2}"
        nodes += [("", region), (region, rack), (rack, f"{rack}/{s}")]
    regions = shards // 4
    late = f"region{shards // 4 % regions}+{shards}"
    values = ", ".join(f"('{p}', '{c}', {w}.0)" for (p, c), w in sorted(
        {n: nodes.count(n) for n in nodes}.items()))
    late_node = f"('', '{late}', 1.0)"

    def level(source: str, parent: str, out: str, name: str, tree: str) -> str:
        return f"""{name} AS (
  SELECT q.id, arg_min(n.child, -ln((('0x' || substr(md5(q.id || '|' || n.child), 1, 13))::BIGINT + 1.0)::DOUBLE
      / 4503599627370497.0) / n.weight) AS {out}
  FROM {source} q JOIN {tree} n ON n.parent = {parent} GROUP BY q.id)"""

    return f"""
WITH node(parent, child, weight) AS (VALUES {values}),
grown_node AS (SELECT * FROM node UNION ALL SELECT * FROM (VALUES {late_node}) v(parent, child, weight)),
{CRC32.strip()},
ids AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS id FROM documents),
{level('ids', "''", 'region', 'l1', 'node')},
{level('l1', 'q.region', 'rack', 'l2', 'node')},
{level('l2', 'q.rack', 'leaf', 'l3', 'node')},
{level('ids', "''", 'region', 'g1', 'grown_node')},
placed AS (
  SELECT l3.id, string_split(l3.leaf, '/')[-1]::INTEGER AS shard,
    CASE WHEN g1.region = '{late}' THEN {shards} ELSE string_split(l3.leaf, '/')[-1]::INTEGER END AS grown_shard
  FROM l3 JOIN g1 USING (id)),
docs AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
summed AS (SELECT doc_id, size, {_crc('h')}::BIGINT AS text_crc32 FROM docs, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard
FROM summed JOIN placed ON id = coalesce(doc_id::VARCHAR, 'null')"""


CONTENT_GROUPS = """
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)"""


#: Windows of ten words, or the whole of a shorter item, and the document words that they cover.
CONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT row_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT row_id, item, i, dw.n FROM dw JOIN bw ON dw.win = bw.win),
c AS (SELECT row_id, count(DISTINCT p) AS n_hit
      FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY row_id),
t AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
      FROM m GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN t USING (row_id)"""


#: Words, their CRC buckets, gains, weights and the best tenth of the documents of at least 20 words.
IMPORTANCE = rf"""
WITH {CRC32.strip()},
d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT row_id, unnest(w) AS word FROM d),
bw AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
coded AS (
  SELECT word, ({_crc('h')})::BIGINT % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN coded USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)))) AS gain
  FROM s FULL JOIN t USING (bucket)),
weighed AS (
  SELECT row_id, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM dw JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
      + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (row_id)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
    PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM placed"""
