"""The registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare, scratch_path
from . import chat, classifier, divergence, fingerprints, lm, mixing, neardup, packing, rules, setjoin, token_counts, trie, warc

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[name] = lambda spark, sf: function(prepare(spark), sf)
        if oracle is not None:
            _ORACLES[name] = oracle
        return function
    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_iblt_fingerprints")
def op1(spark, sf):
    return fingerprints.compare_edited(table(spark, sf, "documents").select("doc_id", "text")).drop("edited_digests")


@query("op2_best_fit_packing")
def op2(spark, sf):
    pieces = packing.token_pieces(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


@query("op3_quality_classifier")
def op3(spark, sf):
    return classifier.classify(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))


_MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, 2.0::DOUBLE * source_size AS stop,
  1.5::DOUBLE * sum(source_size) OVER () AS budget FROM ranked),
levels AS (SELECT *, (budget - coalesce(sum(stop) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(weight * coalesce(max(CASE WHEN level <= stop / weight THEN level END) OVER (), 'infinity'::DOUBLE), stop) AS target FROM levels),
queue AS (SELECT s.doc_id, s.size, t.rank, t.weight, t.source_size, t.target, t.budget, md5(s.doc_id::VARCHAR) AS turn,
  CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / t.weight AS finish
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (SELECT *, 0 AS pass, finish AS due FROM queue UNION ALL SELECT *, 1, finish + source_size / weight FROM queue),
served AS (SELECT *, sum(size) OVER (ORDER BY due, rank, pass, turn, doc_id ROWS UNBOUNDED PRECEDING) AS served FROM entries)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(coalesce(sum(size) FILTER (served <= budget), 0) AS BIGINT) AS taken
FROM served GROUP BY doc_id"""


@query("op4_mixing_fair_queueing", _MIX_SQL)
def op4(spark, sf):
    plan = mixing.mix_plan(table(spark, sf, "documents"))
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= 1000"""


@query("op5_warc_archives", _WARC_SQL)
def op5(spark, sf):
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(warc.record_types(table(spark, sf, "pages")), folder, scratch_path(spark, "warc-index"))
    return warc.read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_deleted_interpolation")
def op6(spark, sf):
    return lm.score_texts(table(spark, sf, "documents").select("doc_id", "text"))


_RULES_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS window5,
  unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window5) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(0, 5) AS o(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
  length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  [{'rule': 'duplicate_line_share', 'v': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END},
   {'rule': 'mark_share', 'v': CASE WHEN word_chars > 0 THEN n_marks / word_chars ELSE 0.0 END},
   {'rule': 'mean_word_chars', 'v': CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END},
   {'rule': 'repeat_share', 'v': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END},
   {'rule': 'symbol_share', 'v': CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END},
   {'rule': 'upper_share', 'v': CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END}] AS measures FROM m),
l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT lang, x.rule, x.v, quality = 1 AND toxic = 0 AS good, quality = 0 AS bad
  FROM (SELECT doc_id, lang, unnest(measures) AS x FROM b) JOIN l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
cuts AS (SELECT rule, unnest(cuts) AS cutoff FROM (VALUES ??) AS v(rule, cuts)),
n AS (SELECT lang, cuts.rule, cutoff, count(*) FILTER (good) AS good, count(*) FILTER (good AND v > cutoff) AS lost, count(*) FILTER (bad AND v > cutoff) AS won
  FROM x JOIN cuts ON x.rule = cuts.rule GROUP BY ALL),
p AS (SELECT *, count(*) OVER () AS tests, CASE WHEN good > 0 AND lost <= good * ?rate THEN list_sum(list_transform(range(0, lost + 1), lambda i:
    exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln(?rate) + (good - i) * ln(1 - ?rate)))) ELSE 1.0 END AS p FROM n),
best AS (SELECT lang, rule, arg_max(cutoff, (won - lost) * 1e6 + cutoff) AS cutoff FROM p WHERE p <= ?level / tests AND won > lost GROUP BY lang, rule),
f AS (SELECT doc_id, min(best.rule) AS failed_rule FROM (SELECT doc_id, lang, unnest(measures) AS x FROM b) u
  JOIN best ON best.lang IS NOT DISTINCT FROM u.lang AND best.rule = u.x.rule AND u.x.v > best.cutoff GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, failed_rule
FROM b LEFT JOIN f ON f.doc_id = b.doc_id"""
_RULES_SQL = _RULES_SQL.replace("??", ", ".join(f"('{rule}', {[float(c) for c in cuts]})" for rule, cuts in rules.CUTOFFS.items())) \
    .replace("?rate", repr(rules.FALSE_REJECTION / len(rules.CUTOFFS))).replace("?level", repr(1 - rules.CONFIDENCE))


@query("op7_quality_rules", _RULES_SQL)
def op7(spark, sf):
    judged = rules.judge(table(spark, sf, "documents").select("doc_id", "text", "lang"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "failed_rule")


@query("op8_token_counts")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, scratch_path(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op9_minhash_near_dedup", _NEAR_SQL)
def op9(spark, sf):
    found = neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_CONTROL = "<|im_end|><|im_start|>assistant ok"
_CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length('<|im_end|>') + 2 + length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
    + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op10_chat_formatting", _CHAT_SQL)
def op10(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(probe), turnwise=True))


_AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
per AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM per GROUP BY lang, term HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(sum(p.n), 0)::HUGEINT AS n FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN per p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term GROUP BY ALL),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER a + count(*) OVER a) AS p,
  1 + 1000000000::HUGEINT * (total + 1) // (sum(total) OVER a + count(*) OVER a) AS ql FROM c WINDOW a AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
term AS (SELECT lang, source, term AS item, CAST((p - ql) * (p - ql) // ql AS BIGINT) AS value FROM p WHERE n > 0 AND p > ql)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, rank FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 200"""


@query("op11_divergence_audit", _AUDIT_SQL)
def op11(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


_TRIE_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)), lambda r, b:
    list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM ids),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
  md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.c, t.n AS place, 0 AS own, role, text FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.n <= h.h
  UNION ALL SELECT h.c, t.n, 1, role, text FROM h JOIN t ON t.c = h.c AND t.n > h.h),
l AS (SELECT ids.c, coalesce(list({'role': role, 'text': text} ORDER BY own, place) FILTER (r.c IS NOT NULL), []) AS turns FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
p AS (SELECT c, len(turns) AS size, d, md5(to_json(turns[:d])::VARCHAR) AS key, md5(to_json(turns[:d - 1])::VARCHAR) AS up, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM l)),
n AS (SELECT d, key, min(c) AS conv_id, any_value(CASE WHEN d > 0 THEN up END) AS up, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256 FROM p GROUP BY d, key),
k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
s AS (SELECT p.d, p.key, count(*) FILTER (k.up IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
  FROM n LEFT JOIN k ON k.up = n.key JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.key = n.key LEFT JOIN n m ON m.key = n.up AND m.d = n.d - 1 LEFT JOIN k ON k.up = n.key"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12(spark, sf):
    return trie.prefix_trie(*trie.rebuild(trie.numbered_turns(table(spark, sf, "conversations"))))


@query("op13_set_join", _NEAR_SQL.replace("len(words) < 5", "len(words) < 4").replace("len(words) - 3), lambda i: array_to_string(words[i:i + 4]",
                                                                                     "len(words) - 2), lambda i: array_to_string(words[i:i + 3]")
       .replace(", d.doc_id = min(reach.b) AS kept", ""))
def op13(spark, sf):
    joined = setjoin.join_sets(table(spark, sf, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
