"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extract, linededup, lm, packing, quality, rindex, secrets, sharding, simhash, tokalign, toxicity, veccodes
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = found.select("doc_id", "spans", F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE)).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return base.select("doc_id", *map(count, secrets.BASE), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.train_and_score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_hits(docs, table(spark, sf_dir, "benchmark"), without_text=True)
    items = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = veccodes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_secrets, op3_quality, op4_extract, op5_lm_score, op6_line_dedup, op7_packing, op8_repeats, op9_decontaminate, op10_shards, op11_toxicity, op12_vector_codes, op13_alignment)}

_BLANK = r"[\x20\x09-\x0D]"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The references that the given pages hold; some have lost their semicolon.
_DECODE = "{}"
for _name, _char in (("quot", "chr(34)"), ("lt", "'<'"), ("gt", "'>'"), ("copy", "'©'"), ("middot", "'·'"), ("amp", "'&'")):
    _DECODE = f"regexp_replace({_DECODE}, '&{_name};?', {_char}, 'g')"

ORACLES = {
    "op6_line_dedup": rf"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, {_ASCII_LOWER.format(f"regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g')")} AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(owner < doc_id, false) AS dropped FROM keyed k LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS phrase, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows x ON p.phrase = x.phrase AND p.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_quality": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
repeats AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS word FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS n_distinct FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.n - n_distinct, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
measures AS (SELECT doc_id, lang, source, unnest([{", ".join(f"'{m}'" for m in (*quality.MEASURES, *quality.SIZES))}]) AS measure,
  unnest([{", ".join(f"{scale} * {a} // greatest({b}, 1)" for a, b, scale, _ in quality.MEASURES.values())}, {", ".join(quality.SIZES)}]) AS value FROM counts),
levels AS (SELECT level, CASE WHEN level > 0 THEN lang END AS lang, CASE WHEN level > 1 THEN source END AS source, measure,
  value >> greatest(length(bin(value)) - 6, 0) << greatest(length(bin(value)) - 6, 0) AS bucket FROM measures, (VALUES (0), (1), (2)) AS x(level)),
sketches AS (SELECT level, lang, source, measure, bucket, count(*) AS n FROM levels GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS size FROM sketches),
quantiles AS (SELECT level, lang, source, measure, size, {", ".join(f"min(bucket) FILTER (WHERE 10 * upto >= {n} * size) AS {q}" for q, n in (("bottom", 1), ("mid", 5), ("top", 9)))} FROM running GROUP BY ALL),
events AS (SELECT q.*, greatest(CASE q.measure {" ".join(f"WHEN '{m}' THEN {event}" for m, (_, _, _, event) in quality.MEASURES.items())} END // greatest(s.mid, 1), q.mid // 16) AS least
  FROM quantiles q JOIN quantiles s ON s.level = q.level AND s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source
  AND s.measure = CASE q.measure {" ".join(f"WHEN '{m}' THEN '{below}'" for m, (_, below, _, _) in quality.MEASURES.items())} END),
fences AS (SELECT level, lang, source, measure, size, CASE WHEN measure = 'word_len' THEN bottom - {quality.SPREAD} * greatest(mid - bottom, least) ELSE 0 END AS low,
  top + {quality.SPREAD} * greatest(top - mid, least) AS high FROM events),
chosen AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.size >= {quality.LEAST_GROUP} THEN o.low WHEN l.size >= {quality.LEAST_GROUP} THEN l.low ELSE a.low END AS low,
  CASE WHEN o.size >= {quality.LEAST_GROUP} THEN o.high WHEN l.size >= {quality.LEAST_GROUP} THEN l.high ELSE a.high END AS high
  FROM fences o JOIN fences l ON o.level = 2 AND l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN fences a ON a.level = 0 AND a.measure = o.measure),
inside AS (SELECT doc_id, bool_and(value BETWEEN low AND high) AS fits FROM measures m JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND fits AS kept FROM counts JOIN inside USING (doc_id)""",
    # The given pages are of one template: the article is named, and its blocks are h1 and p.
    "op4_extract": rf"""
WITH parts AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>') AS blocks FROM pages),
plain AS (SELECT page_id, url, list_transform(blocks, lambda b: {_DECODE.format("regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')")}) AS blocks FROM parts),
lines AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM plain)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM lines""",
    # All windows of 100 bytes by their MD5; starts count from 0, and neighbouring ranges of marked windows are one span.
    "op8_repeats": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
windows AS (SELECT doc_id, i, md5_number(h[i + 1:i + 100]) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(0, octet_length(h) - 99))) AS i FROM d)),
firsts AS (SELECT g, min(doc_id) AS doc_id FROM windows GROUP BY g HAVING count(*) > 1),
places AS (SELECT w.g, w.doc_id, min(w.i) AS i FROM windows w JOIN firsts f ON w.g = f.g AND w.doc_id = f.doc_id GROUP BY ALL),
marked AS (SELECT w.doc_id, w.i FROM windows w JOIN places p ON w.g = p.g WHERE (w.doc_id, w.i) <> (p.doc_id, p.i)),
edges AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM marked),
named AS (SELECT doc_id, i, count(*) FILTER (WHERE gap IS NULL OR gap > 100) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edges),
spans AS (SELECT doc_id, span, min(i) AS low, max(i) + 100 AS high FROM named GROUP BY ALL),
gone AS (SELECT doc_id, list({'low': low, 'high': high} ORDER BY low) AS spans, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, h, spans FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(CASE WHEN spans IS NULL THEN h ELSE
  list_reduce(list_transform(range(len(spans) + 1), lambda k: h[CASE WHEN k = 0 THEN 1 ELSE spans[k].high + 1 END:CASE WHEN k = len(spans) THEN n_bytes ELSE spans[k + 1].low END]), lambda a, b: a || b) END) AS kept_sha256 FROM rest""",
    # CRC-32 of the text's bytes, with its table made from the polynomial.
    "op10_shards": f"""
WITH poly AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM documents),
sized AS (SELECT doc_id, len(b) + {sharding.OVERHEAD} AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, poly),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM sized),
cut AS (SELECT *, least(23, (2 * upto - size) * 24 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM cut""",
}
