"""Ingest queries: ``conversations`` as sessions and turns, other tables as stored rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as tx
from factloom.operators.events import redistribute
from factloom.operators.windows import cumulative_text, running_cap
from factloom.plans.registry import Registry, table
from factloom.sources import sessions, sinks

add = Registry()

WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


def turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), "text")


@add("session_text", r"""
SELECT conv_id AS session_id, string_agg('[' || upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ']: ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id""")
def session_text(spark, sf):
    return sessions.session_texts(turns(spark, sf))


@add("turn_docs", """
SELECT 'session_' || conv_id || '_turn_' || turn AS doc_id, '[' || role || ']: ' || text AS text, CAST(length('[' || role || ']: ' || text) AS VARCHAR) AS char_count, role AS speaker FROM conversations""")
def turn_docs(spark, sf):
    rows = sessions.turn_passages(turns(spark, sf), "talks", "g")
    return rows.select("doc_id", "text", F.col("metadata")["char_count"].alias("char_count"), F.col("metadata")["speaker"].alias("speaker"))


@add("turn_timestamps", """
SELECT conv_id AS session_id, turn, CAST(epoch_us(TIMESTAMP '2024-01-01 08:30:00' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(2 * turn)) // 1000000 AS BIGINT) AS seconds FROM conversations""")
def turn_timestamps(spark, sf):
    base = sessions.session_time(F.lit("1 January 2024, 08:30"), F.lit(None).cast("string")) + F.make_interval(days=F.col("session_id").cast("int"))
    rows = turns(spark, sf)
    return rows.select("session_id", "turn", F.unix_seconds(sessions.turn_time(base, F.col("turn").cast("int"))).alias("seconds"))


@add("turn_running_cap", "SELECT conv_id AS session_id, turn, ord FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM conversations WHERE role <> 'system') WHERE ord <= 4")
def turn_running_cap(spark, sf):
    return running_cap(turns(spark, sf).where("speaker <> 'system'"), "session_id", ["turn"], 4).select("session_id", "turn", F.col("ord").cast("long").alias("ord"))


@add("dataset_limit", "SELECT conv_id AS session_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 50")
def dataset_limit(spark, sf):
    """The reference's limit on turns is the feature: the first 50 in order."""
    return sinks.first_turns(turns(spark, sf), 50).select("session_id", "turn")


@add("entity_upsert", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def entity_upsert(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return sinks.last_writer(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@add("passage_upsert", """
WITH o AS (SELECT doc_id, 'old' AS version FROM documents), n AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, 'new' AS version FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id) UNION ALL SELECT * FROM n""")
def passage_upsert(spark, sf):
    """All documents are stored; new versions of some come in, and some that were not there."""
    d = table(spark, sf, "documents").select("doc_id")
    new = d.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.lit("new").alias("version"))
    return sinks.upsert(d.withColumn("version", F.lit("old")), new, "doc_id")


@add("group_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def group_counts(spark, sf):
    return sinks.group_counts(**{n: table(spark, sf, n) for n in ("orders", "lineitem", "customer")})


@add("clear_group", """
SELECT 'fact' AS kind, o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2
UNION ALL SELECT 'edge', l_orderkey, count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P') GROUP BY 2""")
def clear_group(spark, sf):
    """Orders of one status as the group; edges of deleted orders go, repeated edges stay as often."""
    facts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderstatus").alias("group_id"))
    involves = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("in_id"), F.col("l_partkey").alias("out_id"))
    none = facts.where("false")
    _, kept, _, _, edges = sinks.clear_group(none, facts, none, involves.where("false"), involves, "P")
    return kept.groupBy(F.col("fact_id").alias("k")).agg(F.count("*").alias("n")).select(F.lit("fact").alias("kind"), "k", "n").unionByName(edges.groupBy(F.col("in_id").alias("k")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "k", "n"))


@add("resume_position", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_position(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.resume_after(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@add("fence_strip", r"""
WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN '```json' || chr(10) || '{"a": ' || turn || '}' || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || role || chr(10) || '```' ELSE '  ' || role || ' ' END AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(reply, '(?s)^\s*```.*```') THEN regexp_extract(reply, '(?s)^\s*```(?:[a-zA-Z]+)?\s*(.*?)\s*```', 1) ELSE trim(reply) END AS body FROM t""")
def fence_strip(spark, sf):
    c = table(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 3
    reply = F.when(k == 0, F.concat(F.lit('```json\n{"a": '), F.col("turn").cast("string"), F.lit("}\n```"))).when(k == 1, F.concat(F.lit("```\n"), "role", F.lit("\n```"))).otherwise(F.concat(F.lit("  "), "role", F.lit(" ")))
    return c.select("conv_id", "turn", tx.strip_fence(reply).alias("body"))


@add("dialogue_parse", r"""
WITH s AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'BOT:' ELSE 'Note: ' END || text, chr(10) ORDER BY turn) AS script FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(script, chr(10))) AS line, unnest(range(len(string_split(script, chr(10))))) AS i FROM s),
m AS (SELECT conv_id, i, lower(regexp_extract(line, '(?i)^(Bot|User):\s*(.*)', 1)) AS speaker, trim(regexp_extract(line, '(?i)^(Bot|User):\s*(.*)', 2)) AS text FROM l WHERE regexp_matches(line, '(?i)^(Bot|User):\s*(.*)'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS turn, speaker, text FROM m""")
def dialogue_parse(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "BOT:").otherwise("Note: "), "text")
    scripts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"]), "\n").alias("script"))
    rows = scripts.select("conv_id", F.posexplode(tx.dialogue_turns(F.col("script"))).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.speaker", "t.text")


@add("session_id_extract", "SELECT conv_id, turn, CAST(regexp_extract('session_' || conv_id || '_turn_' || turn, 'session_([0-9]+)', 1) AS BIGINT) AS session_id FROM conversations")
def session_id_extract(spark, sf):
    c = table(spark, sf, "conversations")
    name = F.concat(F.lit("Session_"), F.col("conv_id").cast("string"), F.lit("_turn_"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", tx.session_number(name).alias("session_id"))


@add("json_facts", """
WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'k ' || k WHEN 1 THEN 'k ' || k WHEN 2 THEN 'k ' || k WHEN 3 THEN 'k ' || k ELSE 'body ' || event_type END AS fact,
  CASE WHEN event_id % 5 = 4 THEN 0 WHEN event_id % 5 = 1 THEN 2 ELSE 1 END AS n_entities FROM e""")
def json_facts(spark, sf):
    """Replies in each accepted shape, and one that is no JSON."""
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"fact": "k '), k, F.lit('", "entities": ["A"]}'))
    shapes = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), one, F.lit("]")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('```json\n{"facts": [{"fakta": "k '), k, F.lit('", "entitas": ["A", "B"]}, {"fact": " "}]}\n```')))
        .when(F.col("event_id") % 5 == 2, one)
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"items": ['), one, F.lit("]}")))
        .otherwise("no json here")
    )
    facts = tx.parse_facts(shapes, F.concat(F.lit("body "), "event_type"), F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("event_id", F.explode(facts).alias("f"))
    return rows.select("event_id", "f.fact", F.size("f.entities").alias("n_entities"))


@add("rerank_fallback", """
WITH p AS (SELECT event_id // 10 AS qid, CAST(event_id % 10 AS INTEGER) AS position FROM events)
SELECT qid, position, round(CASE WHEN qid % 3 = 0 THEN 1.0 - position * 0.05 WHEN position % 2 = 0 THEN position / 10.0 ELSE 0.5 END, 6) AS rerank_score FROM p""")
def rerank_fallback(spark, sf):
    """Replies that score even positions only, or cannot be read."""
    from factloom.operators.search import rerank_scores

    p = table(spark, sf, "events").select(F.floor(F.col("event_id") / 10).alias("qid"), (F.col("event_id") % 10).cast("int").alias("position"))
    scores = F.array(*[F.struct(F.lit(i).alias("passage_id"), F.lit(i / 10).alias("score")) for i in range(0, 10, 2)])
    replies = p.select("qid").distinct().select("qid", F.when(F.col("qid") % 3 == 0, "not json").otherwise(F.concat(F.lit("```json\n"), F.to_json(scores), F.lit("\n```"))).alias("reply"))
    return rerank_scores(p, replies).select("qid", "position", F.round("rerank_score", 6).alias("rerank_score"))


@add("rerank_batches", """
WITH p AS (SELECT CASE WHEN event_id // 26 % 7 > 0 THEN event_id // 26 ELSE -7 * event_id - 7 END AS qid, CAST(CASE WHEN event_id // 26 % 7 > 0 THEN event_id % 26 ELSE 0 END AS INTEGER) AS position FROM events),
b AS (SELECT *, position // 10 AS batch, position % 10 AS place, (qid + position // 10) % 5 AS kind FROM p)
SELECT qid, position, round(CASE WHEN qid % 7 = 0 THEN 1.0 WHEN kind = 1 THEN 0.5 WHEN kind = 0 THEN 1.0 - place * 0.05 WHEN place % 2 = 0 THEN place / 10.0 ELSE 0.5 END, 6) AS rerank_score FROM b""")
def rerank_batches(spark, sf):
    """Calls of ten candidates: some fail, some replies cannot be read, some queries have one candidate."""
    from factloom.operators.search import rerank_scores

    i = F.col("event_id")
    many = F.floor(i / 26) % 7 > 0
    p = table(spark, sf, "events").select(F.when(many, F.floor(i / 26)).otherwise(-7 * i - 7).alias("qid"), F.when(many, i % 26).otherwise(0).cast("int").alias("position"))
    kind = (F.col("qid") + F.col("batch")) % 5
    scores = F.to_json(F.array(*[F.struct(F.lit(k).alias("passage_id"), F.lit(k / 10).alias("score")) for k in range(0, 10, 2)]))
    calls = p.select("qid", F.floor(F.col("position") / 10).alias("batch")).distinct()
    calls = calls.select("qid", "batch", F.when(kind == 0, "not json").when(kind > 1, scores).alias("reply"), (kind == 1).alias("failed"))
    return rerank_scores(p, calls).select("qid", "position", F.round("rerank_score", 6).alias("rerank_score"))


@add("passage_admin", """
WITH p AS (SELECT doc_id, source AS collection FROM documents)
SELECT collection, count(*) AS n, count(*) FILTER (doc_id = 7) AS wanted FROM p WHERE collection <> (SELECT min(collection) FROM p) GROUP BY collection""")
def passage_admin(spark, sf):
    """Passages of all collections but one that is deleted, and one read by its id."""
    d = table(spark, sf, "documents")
    rows = sinks.passages(d.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("doc_id"), "text"))
    gone = d.agg(F.min("source")).first()[0]
    left = sinks.clear_collection(rows, gone)
    owner = d.where("doc_id = 7").select("source").first()[0]
    one = sinks.passage(left, owner, "7").groupBy("collection").agg(F.count("*").alias("wanted"))
    return sinks.collection_counts(left).join(one, "collection", "left").select("collection", "n", F.coalesce("wanted", F.lit(0)).alias("wanted"))


@add("metadata_merge", """
SELECT conv_id, turn, 'b' AS b, CASE WHEN turn % 2 = 0 THEN role ELSE 'old' END AS speaker FROM conversations""")
def metadata_merge(spark, sf):
    c = table(spark, sf, "conversations")
    new = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("speaker"), "role"))
    m = sinks.merged_metadata(F.create_map(F.lit("speaker"), F.lit("old"), F.lit("b"), F.lit("b")), new)
    return c.select("conv_id", "turn", m["b"].alias("b"), m["speaker"].alias("speaker"))


@add("stored_ids", r"""
SELECT doc_id, left(regexp_replace(source || '_' || lang || ' é-' || doc_id, '[^a-zA-Z0-9_]', '_', 'g'), 180) AS entity_id, source || '/' || left(regexp_replace(lang || '.é ' || doc_id, '[^\p{L}\p{N}_-]', '_', 'g'), 180) AS passage_id,
  'google/' || lang AS hosted FROM documents""")
def stored_ids(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    return d.select(
        "doc_id", tx.entity_id(F.col("source"), F.concat("lang", F.lit(" é-"), i)).alias("entity_id"), tx.passage_id(F.col("source"), F.concat("lang", F.lit(".é "), i)).alias("passage_id"), tx.hosted_model(F.col("lang")).alias("hosted")
    )


SENTENCES = r"""
s AS (SELECT conv_id, turn, unnest(range(len(p))) AS i, trim(unnest(p)) AS fact FROM (SELECT conv_id, turn, string_split_regex(regexp_replace(text, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(10), 'g'), '\n+') AS p FROM conversations)),
f AS (SELECT conv_id, turn, i, fact, list_transform(list_filter(string_split_regex(fact, '\s+'), lambda w: regexp_matches(w, '^\p{Lu}') AND length(w) > 2), lambda w: regexp_replace(w, '[\p{P}\p{S}]+$', '')) AS names FROM s WHERE fact <> '')"""


@add("ground_truth", "WITH " + SENTENCES + r""",
n AS (SELECT conv_id, turn, string_agg(name, '|' ORDER BY i, k) AS entities FROM (SELECT conv_id, turn, name, min(i) AS i, arg_min(k, (i, k)) AS k FROM (SELECT conv_id, turn, i, unnest(names) AS name, unnest(range(len(names))) AS k FROM f) GROUP BY ALL) GROUP BY conv_id, turn),
g AS (SELECT conv_id, turn, string_agg(fact, '|' ORDER BY i) AS facts, count(*) AS n FROM f GROUP BY conv_id, turn)
SELECT c.conv_id AS session_id, c.turn AS turn_id, coalesce(facts, '') AS facts, coalesce(entities, '') AS entities, array_to_string(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}|\d{1,2} [A-Z][a-z]+ \d{4}'), '|') AS dates,
  CASE role WHEN 'user' THEN 'user' ELSE 'other' END AS category, contains(text, '?') OR coalesce(g.n, 0) = 0 AS retrieval_required FROM conversations c LEFT JOIN g USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)""")
def ground_truth(spark, sf):
    """Facts, entities and dates of each turn, and whether it needs earlier ones."""
    from factloom.operators import generation

    out = generation.ground_truth(turns(spark, sf).withColumn("category", F.when(F.col("speaker") == "user", "user").otherwise("other")))
    joined = lambda c: F.array_join(c, "|")
    facts = joined(F.transform("factual", lambda f: f["fact"]))
    return out.select("session_id", "turn_id", facts.alias("facts"), joined(F.col("entities_mentioned")).alias("entities"), joined(F.col("temporal_references")).alias("dates"), F.when(F.col("speaker") == "user", "user").otherwise("other").alias("category"), "retrieval_required")


@add("lateral_facts", "WITH " + SENTENCES + """
SELECT conv_id AS session_id, turn, fact, array_to_string(list_sort(list_distinct(names)), '|') AS entities FROM f""")
def lateral_facts(spark, sf):
    """The extractor as a table function: a row for each fact of each turn."""
    from factloom.hooks import facts_laterally

    rows = facts_laterally(turns(spark, sf), "text")
    return rows.select("session_id", "turn", "fact", F.array_join(F.array_sort("entities"), "|").alias("entities"))


@add("rerank_model", """
WITH c AS (SELECT conv_id AS qid, turn, text, first_value(text) OVER o AS query, row_number() OVER o - 2 AS position FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT qid, position, count(*) OVER (PARTITION BY qid) AS n, {query} AS wanted, {text} AS held FROM c WHERE position >= 0),
s AS (SELECT qid, position, CASE WHEN n = 1 THEN 1.0 ELSE coalesce(len(list_intersect(wanted, held))::DOUBLE / nullif(len(wanted), 0), 0.0) END AS score FROM p)
SELECT qid, position, round(score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rank FROM s) WHERE rank <= 5""".replace("{query}", WORDS.format("query")).replace("{text}", WORDS.format("CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END")))
def rerank_model(spark, sf):
    """The later turns of a conversation as candidates for its first one, by the model that counts words."""
    from factloom.hooks import overlap_model
    from factloom.operators.reranking import rerank

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 2
    rows = turns(spark, sf).withColumn("position", place).select(F.col("session_id").alias("qid"), "position", "text")
    out = rerank(rows.where("position >= 0"), rows.where("position = -1").select("qid", F.col("text").alias("query")), overlap_model, 5)
    return out.select("qid", F.col("position").cast("long").alias("position"), F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@add("persona_problems", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'age,traits' WHEN c_custkey % 7 = 0 THEN 'occupation' ELSE '' END AS problems FROM customer""")
def persona_problems(spark, sf):
    """Customers as personas, some without an age and traits, some with an empty occupation; none has hobbies."""
    from factloom.operators import generation

    i, some = F.col("c_custkey"), F.array(F.lit("x"))
    lacking = i % 5 == 0
    user = F.struct(
        F.col("c_name").alias("name"), F.when(~lacking, 30).alias("age"), F.when((i % 7 == 0) & ~lacking, "").otherwise("clerk").alias("occupation"), F.lit("here").alias("location"),
        F.when(lacking, F.array().cast("array<string>")).otherwise(some).alias("traits"), F.array().cast("array<string>").alias("hobbies"), some.alias("interests"), some.alias("conversation_topics"), F.lit(None).cast("string").alias("backstory"),
    )
    return generation.persona_problems(table(spark, sf, "customer").select("c_custkey", user.alias("user"))).select("c_custkey", F.array_join("problems", ",").alias("problems"))


@add("enough_turns", """
WITH s AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, role FROM conversations)
SELECT conv_id, count(*) AS n FROM s WHERE line <> '' GROUP BY conv_id HAVING count(*) >= 6""")
def enough_turns(spark, sf):
    """Scripts of whole conversations, a line a turn, parsed again; those with six turns or more stay."""
    from factloom.operators import generation

    c = table(spark, sf, "conversations").withColumn("line", F.explode(F.split("text", "\n"))).where("line <> ''")
    scripts = c.groupBy("conv_id").agg(F.array_join(F.collect_list(F.concat(F.lit("User: "), "line")), "\n").alias("script"))
    return generation.enough_turns(scripts.select("conv_id", tx.dialogue_turns(F.col("script")).alias("turns")), 6).select("conv_id", F.size("turns").cast("long").alias("n"))


@add("session_opening", "SELECT conv_id AS session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters, max(turn) AS last FROM conversations WHERE turn < 10 GROUP BY conv_id")
def session_opening(spark, sf):
    """What a summary hook is shown of each session: the first ten turns are the feature."""
    from factloom.operators import generation

    return generation.opening(turns(spark, sf)).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"), F.max("turn").alias("last"))


@add("stream_graph", r"""
WITH s AS (SELECT conv_id, turn, trim(x) AS fact FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\n+')) AS x FROM conversations)),
f AS (SELECT DISTINCT conv_id, turn, fact FROM s WHERE fact <> ''),
p AS (SELECT conv_id, count(*) AS n_passages FROM conversations GROUP BY 1)
SELECT p.conv_id AS session_id, n_passages, count(fact) AS n_facts, count(fact) AS n_edges, count(DISTINCT regexp_replace(substr(fact, 1, 1), '[^a-zA-Z0-9_]', '_')) AS n_entities FROM p LEFT JOIN f USING (conv_id) GROUP BY ALL""")
def stream_graph(spark, sf):
    """Turns as a stream into all tables at once, a batch at a time; then read as one graph. Letters that are
    the same in an entity's key are one entity."""
    from factloom.shared import scratch_dir
    from factloom.streaming import commits

    folder = f"{scratch_dir(spark)}/factloom/graph-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "conversations").schema).parquet(f"{sf}/conversations.parque[t]")
    stream = stream.select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), "text")
    tables = commits.BatchTables(spark, f"{folder}/tables")
    commits.ingest_sessions(stream, tables, f"{folder}/state", lambda batch: commits.graph_tables(batch, "talks", lines))
    t = commits.whole_graph(tables)
    session = lambda c: F.regexp_extract(c, r"(?i)Session[ _](\d+)", 1).cast("long").alias("session_id")
    facts = t["fact"].select(session("episode_name"), "fact_id")
    edges = t["fact_involves"].join(facts, F.col("in_id") == F.col("fact_id")).join(t["entity"].select("entity_id", "name"), F.col("out_id") == F.col("entity_id"))
    counts = edges.groupBy("session_id").agg(F.count("*").alias("n_edges"), F.count_distinct(F.substring("name", 1, 1)).alias("n_entities"))
    n = facts.groupBy("session_id").agg(F.count("*").alias("n_facts"))
    passages = t["passage"].groupBy(session("doc_id")).agg(F.count("*").alias("n_passages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return passages.join(n, "session_id", "left").join(counts, "session_id", "left").select("session_id", "n_passages", zero("n_facts"), zero("n_edges"), zero("n_entities"))


@add("cumulative_summary", """
SELECT conv_id AS session_id, turn, string_agg(role || ':' || length(text), ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM conversations""")
def cumulative_summary(spark, sf):
    rows = turns(spark, sf).withColumn("part", F.concat("speaker", F.lit(":"), F.length("text").cast("string")))
    return cumulative_text(rows, "session_id", "turn", "part", " / ").select("session_id", "turn", "cumulative")


@add("fallback_summary", """
WITH u AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(t) >= 2 THEN 'Percakapan tentang: ' || left(t[1], 50) || '... hingga ' || left(t[len(t)], 50) || '...' WHEN len(t) = 1 THEN 'Percakapan singkat tentang: ' || left(t[1], 100) || '...' ELSE 'Percakapan antara bot dan user.' END AS summary FROM u""")
def fallback_summary(spark, sf):
    c = table(spark, sf, "conversations")
    users = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda r: r["text"])
    return c.groupBy("conv_id").agg(users.alias("u")).select("conv_id", tx.fallback_summary(F.col("u")).alias("summary"))


@add("redistribute_facts", """
WITH t AS (SELECT conv_id, turn, 1 + length(text) % 3 AS n FROM conversations),
c AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS low, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS high FROM t)
SELECT conv_id AS session_id, turn, unnest(range(CAST(low AS BIGINT), CAST(high AS BIGINT))) AS position FROM c""")
def redistribute_facts(spark, sf):
    t = turns(spark, sf).select("session_id", "turn", (1 + F.length("text") % 3).cast("long").alias("n_facts"))
    n = t.groupBy("session_id").agg(F.sum("n_facts").alias("n"))
    resolved = n.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("position"))
    return redistribute(resolved, t).select("session_id", "turn", "position")


def lines(body):
    """Lines as facts, their first letters as entities."""
    return F.transform(F.filter(F.split(body, "\n+"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.trim(x).alias("fact"), F.array(F.substring(F.trim(x), 1, 1)).alias("entities")))


@add("ingest_graph", r"""
WITH s AS (SELECT conv_id, turn, trim(x) AS fact FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\n+')) AS x FROM conversations)),
f AS (SELECT DISTINCT conv_id, turn, fact FROM s WHERE fact <> '')
SELECT conv_id AS session_id, count(*) AS n_facts, count(DISTINCT substr(fact, 1, 1)) AS n_entities FROM f GROUP BY 1""")
def ingest_graph(spark, sf):
    """Turns as episodes, lines as facts, first letters as entities: the whole chain of tables."""
    rows = turns(spark, sf)
    name = F.concat(F.lit("Session "), F.col("session_id").cast("string"), F.lit(" Turn "), F.col("turn").cast("string"))
    group = "talks"
    episodes = sessions.episodes(rows, group, F.lit("2024-01-01").cast("timestamp"), name, F.col("text"), F.lit(None).cast("timestamp"))
    facts = sinks.facts_of_episodes(episodes, lines)
    session = F.regexp_extract("episode_name", r"Session (\d+) ", 1).cast("long")
    return facts.select(session.alias("session_id"), "fact_id", F.col("entity_names")[0].alias("e")).groupBy("session_id").agg(F.count("*").alias("n_facts"), F.count_distinct("e").alias("n_entities"))


@add("json_sessions", """
SELECT conv_id AS session_id, turn, role AS speaker, text, CAST(epoch_us(TIMESTAMP '2024-01-01 08:30:00' + to_minutes(2 * turn)) // 1000000 AS BIGINT) AS seconds, turn % 2 = 0 AS needed, '[Session ' || conv_id || ' - 2024-01-01]' AS header FROM conversations""")
def json_sessions(spark, sf):
    """Conversations as a dataset document of sessions with turns and truth, read back with its header, times
    and what each turn needs."""
    from factloom.shared import scratch_dir
    from factloom.sources.documents import read_sessions

    folder = f"{scratch_dir(spark)}/factloom/json-{uuid.uuid4().hex}"
    ordered = lambda r: F.transform(F.array_sort(F.collect_list(F.struct("turn", r.alias("r")))), lambda x: x["r"])
    needs = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("fact").alias("info_type"), F.lit("x").alias("description")))).otherwise(F.from_json(F.lit("[]"), "array<struct<info_type:string,description:string>>"))
    truth = F.struct(F.col("turn").alias("turn_id"), needs.alias("retrieval_required"))
    s = turns(spark, sf).groupBy("session_id").agg(ordered(F.struct("speaker", "text")).alias("turns"), ordered(truth).alias("ground_truths"))
    s = s.withColumns({"date": F.lit("2024-01-01"), "datetime": F.lit("1 January 2024, 08:30")})
    # a document, in a file of its own, holds the sessions of a hundred numbers
    part = F.floor(F.col("session_id") / 100).alias("part")
    docs = s.groupBy(part).agg(F.to_json(F.struct(F.collect_list(F.struct(*s.columns)).alias("sessions"))).alias("doc"))
    docs.write.partitionBy("part").text(folder)
    read = read_sessions(spark, folder)
    rows = sessions.with_ground_truth(sessions.turns_of_sessions(read), read).join(read.select("session_id", "date"), "session_id")
    out = rows.select(F.col("session_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("turn"), "speaker", "text", F.unix_seconds("ts").alias("seconds"), sessions.needs_retrieval(F.col("ground_truth")).alias("needed"), sessions.session_header(F.col("session_id"), F.col("date")).alias("header"))
    return out


@add("edge_insert", """
SELECT l_orderkey, count(*) AS n_edges, count(DISTINCT name) AS n_entities FROM (SELECT l_orderkey, unnest([l_linestatus, l_linestatus, l_returnflag]) AS name FROM lineitem) GROUP BY l_orderkey""")
def edge_insert(spark, sf):
    """Order lines as facts that name a status twice: edges are a multiset."""
    names = F.array("l_linestatus", "l_linestatus", "l_returnflag")
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_name"), F.col("l_orderkey").alias("fact_id"), F.lit("g").alias("group_id"), names.alias("entity_names"))
    _, involves = sinks.edges_of_facts(facts)
    return involves.groupBy(F.col("in_id").alias("l_orderkey")).agg(F.count("*").alias("n_edges"), F.count_distinct("out_id").alias("n_entities"))


@add("json_queries", """
SELECT 'q' || doc_id AS id, lang || ' ' || source AS query, 1 + doc_id % 3 AS n_sessions, doc_id % 3 > 0 AS is_cross_session FROM documents""")
def json_queries(spark, sf):
    """Evaluation queries as JSON documents, half as an object with a list, half bare under another id, read back."""
    from factloom.shared import scratch_dir
    from factloom.sources.documents import read_queries

    folder, i = f"{scratch_dir(spark)}/factloom/json-{uuid.uuid4().hex}", F.col("doc_id")
    some = F.sequence(F.lit(1), (1 + i % 3).cast("int")).alias("relevant_sessions")
    q = table(spark, sf, "documents").select(i, (i % 64).alias("part"), F.concat(F.lit("q"), i.cast("string")).alias("id"), F.concat_ws(" ", "lang", "source").alias("query"), some)
    nested = q.where("doc_id % 2 = 0").groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "query", "relevant_sessions")).alias("queries"))).alias("doc"))
    bare = q.where("doc_id % 2 = 1").groupBy("part").agg(F.to_json(F.collect_list(F.struct(F.col("id").alias("query_id"), "query", "relevant_sessions"))).alias("doc"))
    # one document a file; parts are even or odd, as the ids are
    for docs in (nested, bare):
        docs.write.mode("append").partitionBy("part").text(folder)
    rows = read_queries(spark, folder)
    return rows.select("id", "query", F.size("relevant_sessions").cast("long").alias("n_sessions"), "is_cross_session")


@add("sample_texts", "SELECT left(text, 500) AS text FROM conversations ORDER BY conv_id, turn LIMIT 100")
def sample_texts(spark, sf):
    """The reference's sample for a benchmark of embedders: the first hundred turns, cut."""
    from factloom.sources.documents import sample_texts as sample

    return sample(turns(spark, sf))


@add("usage_log", """
SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(max(epoch_us(ts) // 1000000) AS BIGINT) AS last FROM events GROUP BY event_type""")
def usage_log(spark, sf):
    """Calls appended to a log of JSON lines in two runs, read back as one."""
    from factloom.shared import scratch_dir
    from factloom.sources.documents import read_cost_log

    folder = f"{scratch_dir(spark)}/factloom/log-{uuid.uuid4().hex}"
    log = table(spark, sf, "events").select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.lit("s").alias("setup"), F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
        F.lit(0.0).alias("cost_usd"), F.lit("chat").alias("call_type"), "event_id",
    )
    for part in (0, 1):
        sinks.append_log(log.where(F.col("event_id") % 2 == part).drop("event_id"), folder)
    rows = read_cost_log(spark, folder)
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.max(F.unix_seconds("ts")).alias("last"))


@add("latest_facts", """
SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_facts(spark, sf):
    from factloom.operators.events import latest_facts as latest

    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("created_at"))
    return latest(o, "o_custkey", "o_orderpriority").select("o_custkey", "o_orderpriority", F.col("fact_id").alias("o_orderkey"))


