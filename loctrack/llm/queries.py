"""The registered queries of the operators: thin, over whole tables, with
production parameters; and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loctrack.llm import bytebpe, conv_quality, decontaminate, importance, line_dedup, main_text, prefix_trie, quality_rules, secrets, simhash, token_counts, warc_zip, winnowing
from loctrack.llm.common import table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def digest_of(ids: Column) -> Column:
    """SHA-256 of ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ","), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=None)
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest_of(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_decontaminate, and the items with proximity matches."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest_of(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"), digest_of(F.col("near_items")).alias("near_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 9).alias("ratio"))


def op5_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.roundtrip(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("lines_before").cast("long").alias("lines_before"), F.col("lines_removed").cast("long").alias("lines_removed"))


def op9_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_line_dedup with windows over the edges of the texts."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), edges=True)
    return found.select("doc_id", "text", F.col("lines_before").cast("long").alias("lines_before"), F.col("lines_removed").cast("long").alias("lines_removed"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2("base_text", 256).alias("base_sha256"), "spans", "n_live", "n_example")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).withColumnRenamed("saved", "saved_tokens")


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnowing.as_text(F.col("fp")).alias("fingerprint"), winnowing.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op1_near_items, op2_simhash, op3_byte_bpe, op4_quality_rules, op5_conv_quality, op6_main_text, op7_token_counts, op8_warc_zip, op9_line_dedup, op9_edge_dedup, op10_secrets, op11_prefix_trie, op12_winnowing, op13_importance)}

#: Windows of three lines with their place; then as the operator does it.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS body
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY body) AS n FROM w WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
gone AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]) FILTER (k > 1))) AS places,
    list_distinct(flatten(coalesce(list([pos, pos + 1, pos + 2]) FILTER (k = 1), []))) AS safe FROM o WHERE n > 1 GROUP BY doc_id HAVING count(*) FILTER (k > 1) > 0),
r AS (SELECT doc_id, lines, coalesce(places, []) AS places, coalesce(safe, []) AS safe FROM d LEFT JOIN gone USING (doc_id)),
k AS (SELECT doc_id, lines, list_filter(range(0, len(lines)), lambda i: NOT list_contains(places, i) OR list_contains(safe, i)) AS keep FROM r)
SELECT doc_id, CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string(list_transform(keep, lambda i: lines[i + 1]), chr(10)), '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS lines_before, coalesce(len(lines) - len(keep), 0)::BIGINT AS lines_removed FROM k
"""

#: The same with a mark before the first and behind the last line, which no line is.
OP9_EDGE_SQL = OP9_SQL.replace(
    "array_to_string(lines[pos + 1 : pos + 3], chr(10))", "array_to_string(marked[pos + 2 : pos + 4], chr(10))"
).replace(
    "(SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)",
    "(SELECT doc_id, list_concat([chr(10)], lines, [chr(10)]) AS marked, unnest(range(-1, len(lines) - 1)) AS pos FROM d WHERE lines IS NOT NULL)",
)

#: Equal payloads by the payload itself; SHA-1 in base32 by groups of five bits.
OP8_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS newest FROM p),
b AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(sha1(payload), i + 1, 1)) - 1) AS h FROM r)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((h[(g * 5) // 4 + 1] * 16 + coalesce(h[(g * 5) // 4 + 2], 0)) // CAST(pow(2, 3 - (g * 5) % 4) AS BIGINT)) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < newest THEN newest END AS refers_to, url FROM b
"""


#: Windows of documents as text, joined with those of the items.
OP1_SQL = r"""
WITH lo AS (SELECT 'abcdefghijklmnopqrstuvwxyz' AS a),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper(a), a), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, lo),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper(a), a), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lo),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, k, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _kind_sql(kind: int, name: str, pattern: str, group: int, keep: str) -> str:
    """Spans of one kind; the lengths of the pieces between the matches give the
    places."""
    return f"""
SELECT doc_id, source, lang, {kind} AS kind, '{name}' AS name, s, s + length(m[i]) AS e, md5(v[i]) AS hash FROM (
  SELECT doc_id, source, lang, m, v, i, list_sum(list_transform(gaps[1 : i], lambda x: length(x)))::BIGINT
    + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (
    SELECT doc_id, source, lang, m, v, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, source, lang, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS gaps
      FROM documents WHERE regexp_matches(text, '{pattern}'))))
WHERE {keep}"""


_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) + "?" * (w == "api_") + ("[Kk][Ee][Yy]" if w == "api_" else "") for w in ("password", "passwd", "secret", "token", "api_"))
_RUN = "[A-Za-z0-9+/_=-]{20,}"

OP10_SQL = f"""
WITH base AS ({_kind_sql(0, "assign", f"""({_ANY_CASE})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v[i]) >= 6")}
UNION ALL {_kind_sql(1, "access", "AKIA[A-Z0-9]{16,}", 0, "true")}
UNION ALL {_kind_sql(2, "hex", "[0-9a-f]{24,}", 0, "true")}),
runs AS ({_kind_sql(3, "owned", _RUN, 0, "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')")}),
cand AS (SELECT * FROM base UNION ALL
  SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.s < b.e)),
freq AS (SELECT hash, count(DISTINCT row(source)) <= 2 AND count(DISTINCT row(source, lang)) <= 3 AS live FROM cand GROUP BY hash),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM cand JOIN freq USING (hash) GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM documents LEFT JOIN per USING (doc_id)
"""

#: Bytes in hexadecimal, side by side with their followers; counts of each
#: three of them, by bucket, for the two multinomials and for each text.
OP4_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS trusted FROM documents),
b AS (SELECT r, trusted, regexp_extract_all(hex(encode(' ' || text || ' ')), '..') AS h FROM d WHERE text <> ''),
g AS (SELECT r, trusted, x || y || z AS gram, count(*) AS n
  FROM (SELECT r, trusted, unnest(h[: len(h) - 2]) AS x, unnest(h[2 : len(h) - 1]) AS y, unnest(h[3 :]) AS z FROM b) GROUP BY ALL),
k AS (SELECT gram, (((((('0x' || gram[1:2])::BIGINT * 257 + ('0x' || gram[3:4])::BIGINT) * 257 + ('0x' || gram[5:6])::BIGINT) % 4294967296) * 2654435761::HUGEINT) % 4294967296
  // {1 << (33 - quality_rules.BUCKETS.bit_length())})::BIGINT AS bucket FROM (SELECT DISTINCT gram FROM g)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (trusted), 0)::DOUBLE AS t, sum(n)::DOUBLE AS raw FROM g JOIN k USING (gram) GROUP BY bucket),
total AS (SELECT coalesce(sum(t), 0) AS t, coalesce(sum(raw), 0) + {quality_rules.BUCKETS} AS raw, 1 + {quality_rules.SMOOTHING} * coalesce(sum(t), 0) AS weight FROM c),
l AS (SELECT bucket, CASE WHEN total.t = 0 THEN 0 ELSE ln((c.t + weight * ((c.raw + 1) / total.raw)) / (total.t + weight) / ((c.raw + 1) / total.raw)) END AS ratio FROM c, total),
m AS (SELECT r, sum(n * ratio) / sum(n) AS ratio FROM g JOIN k USING (gram) JOIN l USING (bucket) GROUP BY r),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (SELECT *, count(*) OVER (PARTITION BY r, x, y, z) AS n
  FROM (SELECT r, unnest(range(0, len(w) - 2)) AS pos, unnest(w[: len(w) - 2]) AS x, unnest(w[2 : len(w) - 1]) AS y, unnest(w[3 :]) AS z FROM w WHERE len(w) > 2)),
p AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS i FROM s WHERE n > 1) GROUP BY r),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(ratio, 0) AS ratio
  FROM w LEFT JOIN p USING (r) LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AND ratio >= {quality_rules.THRESHOLD} AS kept, round(ratio, 9) AS ratio FROM o
"""

#: CRC-32 of a text's UTF-8 bytes, byte by byte over a table of 256 numbers
#: that SQL derives from the polynomial.
_CRC_TABLE = """crc AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) AS x FROM range(256) AS r(i)))"""


def _crc_sql(text: str, table: str = "t") -> str:
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
  lambda a, b: xor(a >> 8, {table}[xor(a, b) & 255 + 1])), 4294967295)""".replace("xor(a, b) & 255 + 1", "(xor(a, b) & 255) + 1")


#: Prefixes by themselves; totals over each node's representative path.
OP11_SQL = f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h),
whole AS (SELECT c.conv_id, coalesce(list([role, text] ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS seq FROM convs c LEFT JOIN parts USING (conv_id) GROUP BY c.conv_id),
pre AS (SELECT conv_id, d, len(seq) = d AS ends, sha256(to_json(seq[:d])) AS k, CASE WHEN d > 0 THEN sha256(to_json(seq[:d - 1])) END AS up, CASE WHEN d > 0 THEN strlen(seq[d][2]) ELSE 0 END AS bytes
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (SELECT k, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
marked AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
totals AS (SELECT pre.k, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM marked m JOIN pre ON pre.conv_id = m.conv_id AND pre.d <= m.depth GROUP BY pre.k)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM marked m JOIN totals USING (k) LEFT JOIN nodes p ON p.k = m.up
"""


def _features_sql(table: str, columns: str) -> str:
    """Words and pairs of neighbouring words of whole texts."""
    return f"""SELECT {columns}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {columns}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"""


#: Buckets of the distinct features, then counts, gains, scores and a sort.
OP13_SQL = f"""
WITH {_CRC_TABLE},
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS MATERIALIZED ({_features_sql("docs", "r")}),
b AS MATERIALIZED ({_features_sql("benchmark", "item_id")}),
bucket AS MATERIALIZED (SELECT f, {_crc_sql("f")} % {importance.BUCKETS} AS k FROM (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b)), crc),
s AS (SELECT k, count(*)::DOUBLE AS n FROM d JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, count(*)::DOUBLE AS n FROM b JOIN bucket USING (f) GROUP BY k),
size AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS s, (SELECT count(*) FROM b)::DOUBLE AS t),
gain AS (SELECT s.k, floor(1000e0 * ln((coalesce(t.n, 0) + 1) * (size.s + {importance.BUCKETS}) / ((s.n + 1) * (size.t + {importance.BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (k), size),
w AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g, count(*) FILTER (NOT contains(f, ' ')) AS n_words FROM d JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
o AS (SELECT docs.r, doc_id, coalesce(n, 0) AS n_features, coalesce(n_words, 0) AS n_words, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    floor(-1000e0 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS noise
  FROM docs LEFT JOIN w USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM o WHERE n_words >= {importance.MIN_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, CASE WHEN rank <= {importance.PERCENT} * n // 100 THEN rank END AS rank
FROM o LEFT JOIN able USING (r)
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op4_quality_rules": OP4_SQL, "op8_warc_zip": OP8_SQL, "op9_line_dedup": OP9_SQL, "op9_edge_dedup": OP9_EDGE_SQL, "op10_secrets": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_importance": OP13_SQL}
