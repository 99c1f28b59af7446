"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash_near_dedup")
def _(spark, sf_dir):
    from strandloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "members")


@query("op2_secret_scan")
def _(spark, sf_dir):
    from strandloom.llm.secret_scan import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def _(spark, sf_dir):
    from strandloom.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op4_quality_classifier")
def _(spark, sf_dir):
    from strandloom.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
lw AS (SELECT doc_id, l, k, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws FROM ln),
lo AS (SELECT *, lower(l) AS low, trim(lower(l), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends,
    trim(lower(l), '| ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inner_ FROM lw),
ls AS (SELECT *, regexp_matches(low, '^\s*(home|menu|log ?in|sign ?up|next|previous|back|search|contact|about us)(\s*[|/>,·-]?\s*(home|menu|log ?in|sign ?up|next|previous|back|search|contact|about us))*\s*$') AS menu,
    regexp_matches(inner_, '^\s*(home|menu|log ?in|sign ?up|next|previous|back|search|contact|about us)(\s*[|/>,·-]?\s*(home|menu|log ?in|sign ?up|next|previous|back|search|contact|about us))*\s*$') AS inner_menu,
    list_sum(list_transform(list_transform(string_split_regex(low, '[|>»]'), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), lambda n: CASE WHEN n <= 30 THEN n ELSE -n END)) AS balance,
    length(low) - length(regexp_replace(low, 'all rights reserved|privacy policy|terms of (use|service)|cookie(s)? (policy|settings|consent)|accept (all )?cookies|enable javascript|subscribe to our|click here|lorem ipsum', '', 'g')) AS covered,
    length(array_to_string(regexp_extract_all(low, '[^\x20\x09-\x0D]+'), ' ')) AS solid FROM lo),
lr AS (SELECT doc_id, l, k, len(ws) AS n,
    len(ws) > 0 AND (regexp_matches(l, '^[^0-9A-Za-z\x{80}-\x{10FFFF}]+$')
      OR len(list_filter(ws, lambda x: regexp_matches(x, '[!?#*$%&<>~^=_]{2,}$'))) > len(ws) * 0.3
      OR menu OR (len(regexp_extract_all(low, '[|>»]')) >= 3 AND regexp_matches(low, '^[|>»\x20\x09-\x0D]*[^|>»\x20\x09-\x0D][^|>»]*[|>»]')
        AND CASE WHEN starts_with(ends, '|') AND ends_with(ends, '|') THEN inner_menu ELSE balance >= 0 END)
      OR (covered > 0 AND covered >= solid * 0.1)) AS bad
    FROM ls),
la AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dup,
    coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT bad), '') AS cleaned FROM lr GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, la.dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(la.cleaned, '[\x20\x09-\x0D]+', '', 'g')) AS left_chars
    FROM w JOIN la USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 1 - left_chars / nullif(word_chars, 0)::DOUBLE <= 0.5 AS kept FROM b
"""


@query("op5_quality_rules", OP5_SQL)
def _(spark, sf_dir):
    from strandloom.llm.quality_rules import clean_lines

    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_token_records")
def _(spark, sf_dir):
    from strandloom.llm.records import tokenized

    return tokenized(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


OP7_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS g
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


@query("op7_decontamination", OP7_SQL)
def _(spark, sf_dir):
    from strandloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "_key")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, (CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS wt, (3 * ss)::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS capped, coalesce(sum(wt) OVER p, 0) AS used, (sum(ss) OVER ())::DOUBLE AS total, sum(wt) OVER () AS alls
    FROM w WINDOW p AS (ORDER BY cap / wt, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max((total - capped) / (alls - used)) AS level FROM o),
g AS (SELECT source, ss, least(cap, level * wt) AS target FROM w, lv),
x AS (SELECT d.*, ss, target, CASE WHEN ss = 0 THEN 0 ELSE floor(target / ss)::BIGINT END AS e,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, ss AS source_size, target, (e * size + greatest(0, least(size, floor(target - e * ss)::BIGINT - pre)))::BIGINT AS taken FROM x
"""


@query("op8_mixing", OP8_SQL)
def _(spark, sf_dir):
    from strandloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_sharding")
def _(spark, sf_dir):
    from strandloom.llm.sharding import record_size, shard

    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_pii")
def _(spark, sf_dir):
    from strandloom.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


@query("op11_suffix_dedup")
def _(spark, sf_dir):
    from strandloom.llm.suffix_dedup import n_removed, repeated_spans

    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", n_removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_embedding_whitening")
def _(spark, sf_dir):
    from strandloom.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings")).select(F.col("row.vec_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, g, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS d FROM t),
h AS (SELECT c, c - c % 20 AS b, xor(list_reduce(list_concat([4294967295::UBIGINT],
      flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_concat([ascii(x)::UBIGINT], [1000::UBIGINT, 1000, 1000, 1000, 1000, 1000, 1000, 1000])))),
    lambda a, x: CASE WHEN x < 1000 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END), 4294967295::UBIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT h.c, any_value(h.h) AS h, count(o.c) AS n FROM h LEFT JOIN o ON o.c = h.b AND o.d <= h.h GROUP BY h.c),
r AS (SELECT h.c, o.d, o.g, o.words FROM h JOIN o ON o.c = h.b AND o.d <= h.h
    UNION ALL SELECT o.c, k.n + o.d - k.h, o.g, o.words FROM o JOIN k ON o.c = k.c WHERE o.d > k.h UNION ALL SELECT c, 0, '', 0 FROM h),
p AS (SELECT c, d, words, string_agg(g, '') OVER w AS key, lead(d) OVER w IS NULL AS ends FROM r WINDOW w AS (PARTITION BY c ORDER BY d)),
nd AS (SELECT key, d, min(c) AS c0, count(*) AS n, max(words) AS words FROM p GROUP BY key, d),
ch AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n FROM nd WHERE d > 0 GROUP BY 1),
f AS (SELECT nd.*, coalesce(ch.n, 0) AS kids FROM nd LEFT JOIN ch ON nd.key = ch.key),
tot AS (SELECT p.key, count(*) FILTER (kids = 0) AS leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN p ON p.c = f.c0 AND p.d <= f.d GROUP BY p.key),
e AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS x FROM p WHERE ends GROUP BY key)
SELECT f.c0::BIGINT AS conv_id, f.d::BIGINT AS depth, pa.c0::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
    saved::BIGINT AS saved_tokens, coalesce(e.x, sha256('')) AS ends_sha256
FROM f JOIN tot ON f.key = tot.key LEFT JOIN f pa ON f.d > 0 AND pa.key = left(f.key, greatest(length(f.key) - 32, 0)) LEFT JOIN e ON f.key = e.key
"""


@query("op13_prefix_trie", OP13_SQL)
def _(spark, sf_dir):
    from strandloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))
