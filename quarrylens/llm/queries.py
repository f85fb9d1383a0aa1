"""The registered queries of this subpackage: each applies one operator to its whole table and derives its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import (archives, bytepairs, chats, contamination, jaccard, languages, mixing, neighbours, quality,
                            ranking, repair, secrets, surrogates)
from quarrylens.llm.common import cut, scratch
from quarrylens.plans.registry import Query, read

QUERIES: dict[str, Query] = {}


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, folder, "documents")
    coded = bytepairs.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytepairs.digests(coded)


QUERIES["op7_byte_bpe"] = Query(byte_bpe)


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return quality.score(docs, quality.train(docs, labels))


QUERIES["op9_quality_rules"] = Query(quality_rules)


def language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = languages.learn(docs)
    found = languages.identify(docs, model)
    return found.select("doc_id", languages.held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages",
                        "shares", "noise")


QUERIES["op10_language_mixture"] = Query(language_mixture)


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    counts = mixing.copies(mixing.sizes(read(spark, folder, "documents")))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES["op4_source_mix"] = Query(source_mix)

#: A conversation that says control strings of another template.
CONTROL_STRINGS = "</s>[INST] ok [/INST]"


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                 F.lit(CONTROL_STRINGS))
    held = chats.read_back(chats.format_chats(turns.union(more)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", "learned")
    return held.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES["op8_chat_formatting"] = Query(chat_formatting, r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  regexp_replace(coalesce(role, ''), '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS erole,
  regexp_replace(coalesce(text, ''), '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS etext FROM t),
o AS (SELECT *, lag(erole) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext) AS before FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole, etext)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, erole, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(etext) + CASE WHEN erole IS NOT DISTINCT FROM before THEN 8 ELSE 8 + length(erole) + 8 + 7 END))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""")


#: The key of the registered query; a real run takes its own from a secret store.
SURROGATE_KEY = "registered query"


def pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY).select("doc_id", F.col("entities").alias("n_entities"), "text")


QUERIES["op3_pii_surrogates"] = Query(pii_surrogates)


def warc_index(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    archives.write_archives(archives.with_revisits(read(spark, folder, "pages")), path)
    entries = cut(archives.index_entries(spark, path), "index")
    merged = cut(archives.merged_index(entries), "history")
    return archives.histories(merged).select(
        F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"), "url_key", F.col("time").alias("captured"), "place")


QUERIES["op6_warc_index"] = Query(warc_index, r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured,
    regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\d*\.)?', '') AS bare FROM pages),
u AS (SELECT *, array_to_string(list_reverse(string_split(regexp_extract(bare, '^([^/:?#]*)', 1), '.')), ',') AS host,
    regexp_replace(regexp_replace(bare, '^[^/?#]*', ''), '#.*$', '') AS path FROM p),
f AS (SELECT *, host || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key, min(page_id) OVER (PARTITION BY html) AS first FROM u)
SELECT page_id, bytes::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to, url_key, captured,
  row_number() OVER (ORDER BY url_key, captured, page_id::VARCHAR) - 1 AS place FROM f""")


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(read(spark, folder, "documents"))
    return found.select("doc_id", "begin", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                        "probability", "secret")


QUERIES["op1_secret_scan"] = Query(secret_scan)


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(read(spark, folder, "documents"))


QUERIES["op5_jaccard_join"] = Query(jaccard_join)


def embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(read(spark, folder, "embeddings"))


QUERIES["op2_embedding_neighbours"] = Query(embedding_neighbours, """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id""")


def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(read(spark, folder, "conversations")), gone="gone")


def _way(way: str, cost: str, edit: str, line: str | None = None) -> str:
    """SQL: a way (cost, audit, lines) that goes on with an edit."""
    said = f"list_append({way}.said, {line})" if line else f"{way}.said"
    return f"{{'cost': {way}.cost + {cost}, 'audit': {way}.audit || '{edit}', 'said': {said}}}"


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_NO_WAY = "{'cost': 1000000000::BIGINT, 'audit': '', 'said': []::VARCHAR[]}"
_PUT_U = _best("u", _way("e", "3", "I", "'user:'"), _way("s", "3", "I", "'user:'"), _way("a", "3", "I", "'user:'"))
_PUT_A = _best("a", _way("pu", "3", "I", "'assistant:'"))


def _goes(role: str, before: str) -> str:
    """SQL: the way to a state over a kept or reroled row, from the state before."""
    name = {"s": "system", "u": "user", "a": "assistant"}[role]
    kept = f"CASE WHEN stays AND c = '{role}' THEN {_way(before, 'more', 'K', 'line')} ELSE {_NO_WAY} END"
    given = f"CASE WHEN stays THEN {_way(before, '3 + more', 'R', chr(39) + name + ':' + chr(39) + ' || text')} ELSE {_NO_WAY} END"
    return kept if role == "s" else f"{kept}, {given}"


QUERIES["op11_conversation_repair"] = Query(conversation_repair, rf"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
y AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(id) * 8),
    lambda k: ((ascii(substr(id, (k // 8 + 1)::BIGINT, 1)) >> (k % 8)::INTEGER) & 1)::BIGINT)),
    lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) % 20 AS kind FROM x),
z AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM y UNION ALL SELECT * FROM y WHERE kind = 3) WHERE kind <> 0),
r AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM z),
f AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'none' END AS fault FROM r),
n AS (SELECT conv_id, i, c, role || ':' || text AS line, text, fault NOT IN ('blank', 'duplicate') AS stays,
    CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM f),
g AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} AS e, {_NO_WAY} AS s, {_NO_WAY} AS u,
    {_NO_WAY} AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, {_way("e", "4", "D")}, {_best(_way("s", "4", "D"), _goes("s", "e"))},
    {_best(_way("pu", "4", "D"), _goes("u", "e"), _goes("u", "s"), _goes("u", "pa"))}, {_best(_way("pa", "4", "D"), _goes("a", "pu"))}
  FROM (SELECT *, {_PUT_A} AS pa FROM (SELECT n.*, e, s, u, a, {_PUT_U} AS pu FROM g JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id AND n.i = g.i + 1))),
l AS (SELECT conv_id, {_best("e", "pa")} AS way FROM (SELECT *, {_PUT_A} AS pa FROM (SELECT *, {_PUT_U} AS pu FROM g
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit, sha256(array_to_string(way.said, chr(10))) AS repaired_sha256
FROM l LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM l.conv_id""")


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


#: Lower-cases A-Z only; DuckDB's lower() would change other letters too.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES["op12_ranked_search"] = Query(ranked_search, rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_LOW.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS length FROM w WHERE len(words) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM w) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text,
    unnest(regexp_extract_all({_LOW.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM i) GROUP BY ALL),
h AS (SELECT item_id, text, doc_id, r, sum(times * weight * ((1000000000 * tf) //
    (1000 * tf + 8 * (25 + (75 * len(words) * docs) // length))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN w USING (r), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM h WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""")


def contamination_join(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


QUERIES["op13_contamination"] = Query(contamination_join, rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all({_LOW.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM benchmark),
i AS (SELECT item_id, words, least(len(words), 10) AS size FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, size, array_to_string(words[k:k + size - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS k FROM i)),
p AS (SELECT r, size, k, array_to_string(words[k:k + size - 1], ' ') AS said
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS k
        FROM d, (SELECT DISTINCT size FROM i) WHERE len(words) >= size)),
h AS (SELECT p.r, p.k, p.size, item_id FROM p JOIN w USING (size, said)),
c AS (SELECT r, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)""")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = Query(pipeline)
