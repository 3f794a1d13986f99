"""Numbering, matching, grouping, sources and sinks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.catalog.registry import query, table
from gradewell.operators import grading, matching, numbering, selection
from gradewell.operators.schema import with_defaults
from gradewell.session import scratch_path
from gradewell.sources import batches, tables
from gradewell.streaming.results import ingest_ranges, read_ingested, stream_results

BATCH = 1000


@query("""
    SELECT concat(u.conv_id, '-', u.turn) AS pair_id, u.text AS question, a.text AS response
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'
""")
def qa_pairs(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    # Joined on conversation and turn: one very long conversation spreads out.
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "question", "response")


# --- numbering and batches ---------------------------------------------------

NUMBERED_SQL = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders"


@query(f"""
    SELECT o_orderkey, i // 7 AS batch_no, i % 7 AS pos, concat('b', i // 7, '-', i % 7) AS custom_id
    FROM ({NUMBERED_SQL})
""")
def batch_assign(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return numbering.assign_batches(orders, 7, ["o_orderkey"], stored_input=True)


@query("""
    SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS row_index FROM events
""")
def row_index_hot_key(spark, sf):
    # Five event types hold all rows: the index must not put a type into one task.
    events = table(spark, sf, "events").select("event_type", "event_id")
    return numbering.with_row_index(events, ["event_type", "event_id"], stored_input=True).select("event_id", "row_index")


@query(f"SELECT o_orderkey, i AS row_index FROM ({NUMBERED_SQL})")
def numbered_scan(spark, sf):
    # The file is stored in the order of its keys.
    return numbering.read_numbered(spark, f"{sf}/orders.parquet").select("o_orderkey", "row_index")


@query(f"SELECT concat('q', i) AS id, o_orderkey FROM ({NUMBERED_SQL})")
def synthetic_ids(spark, sf):
    return numbering.with_ids(table(spark, sf, "orders").select("o_orderkey"), "q", ["o_orderkey"], stored_input=True)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sample_limit(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (-F.col("o_totalprice")).alias("rank"))
    return numbering.first_rows(orders, 100, ["rank", "o_orderkey"], stored_input=True).drop("rank")


@query("""
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents ORDER BY doc_id LIMIT 75
""")
def numbered_sample(spark, sf):
    """The first rows of a table in several files, numbered in the order of the files."""
    path = scratch_path(spark, "files")
    docs = table(spark, sf, "documents").select("doc_id")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return numbering.read_numbered(spark, path, total=75).select("doc_id", "row_index")


# --- request and result files ------------------------------------------------


def order_requests(spark, sf):
    """Orders as numbered requests; their keys are unique."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return numbering.assign_batches(orders, BATCH, ["o_orderkey"], stored_input=True)


def raw_results(requests):
    """Results in the layout of result files: finished orders succeed, open ones
    are errored without a message, the rest come back without any content."""
    text = F.concat("o_orderpriority", F.lit(" for "), "o_orderkey")
    block = F.struct(F.lit("text").alias("type"), text.alias("text"))
    content = F.when(F.col("o_orderstatus") == "F", F.array(block)).otherwise(
        F.array().cast("array<struct<type:string,text:string>>"))
    message = F.when(F.col("o_orderstatus") != "O", F.struct(content.alias("content")))
    state = F.when(F.col("o_orderstatus") == "O", F.lit("errored")).otherwise(F.lit("succeeded"))
    return requests.select("custom_id", F.struct(state.alias("type"), message.alias("message")).alias("result"))


def result_files(spark, requests) -> str:
    path = scratch_path(spark, "results")
    raw_results(requests).write.json(path)
    return path


@query(f"""
    SELECT concat('b', i // {BATCH}, '-', i % {BATCH}) AS custom_id, i // {BATCH} AS batch_no, 'a-model' AS model,
           64 AS max_tokens, 0.5::DOUBLE AS temperature, 'user' AS role, o_orderpriority AS content
    FROM ({NUMBERED_SQL})
""")
def request_files(spark, sf):
    requests = order_requests(spark, sf)
    records = batches.request_records(requests, "a-model", 64, 0.5, prompt="o_orderpriority")
    path = scratch_path(spark, "requests")
    batches.write_requests(records, path, batches_per_folder=10)
    return spark.read.schema(records.drop("batch_no").schema).json(path).select(
        "custom_id", batches.batch_of("custom_id").alias("batch_no"), "params.model", "params.max_tokens", "params.temperature",
        F.col("params.messages")[0]["role"].alias("role"), F.col("params.messages")[0]["content"].alias("content"))


RESULTS_SQL = f"""
    SELECT *, concat('b', i // {BATCH}, '-', i % {BATCH}) AS custom_id, i // {BATCH} AS batch_no,
           concat(o_orderpriority, ' for ', o_orderkey) AS MODEL_OUTPUT FROM ({NUMBERED_SQL})
"""


@query(f"SELECT custom_id, MODEL_OUTPUT FROM ({RESULTS_SQL}) WHERE o_orderstatus = 'F'")
def result_scan(spark, sf):
    return batches.read_results(spark, result_files(spark, order_requests(spark, sf)))


@query(f"SELECT o_orderkey, custom_id, MODEL_OUTPUT FROM ({RESULTS_SQL}) WHERE o_orderstatus = 'F'")
def match_results(spark, sf):
    requests = order_requests(spark, sf)
    results = batches.flat_results(raw_results(requests))
    foreign = results.select(F.concat(F.lit("x-"), "custom_id").alias("custom_id"), "MODEL_OUTPUT")
    return matching.match_results(requests, results.union(foreign)).select("o_orderkey", "custom_id", "MODEL_OUTPUT")


@query(f"SELECT o_orderkey, custom_id, MODEL_OUTPUT FROM ({RESULTS_SQL}) WHERE o_orderstatus = 'F'")
def streamed_results(spark, sf):
    """Result files of which two are taken up at a time, matched to requests stored by range of batches."""
    requests = order_requests(spark, sf)
    files, path = scratch_path(spark, "results"), scratch_path(spark, "matched")
    raw_results(requests).repartition(6).write.json(files)
    stored = batches.store_request_ranges(requests, scratch_path(spark, "stored"), 500)
    ingest_ranges(stored, stream_results(spark, files, 2), path, scratch_path(spark, "progress")).awaitTermination()
    return read_ingested(spark, path).select("o_orderkey", "custom_id", "MODEL_OUTPUT")


@query(f"""
    SELECT concat('b', i // 3, '-', i % 3) AS custom_id, concat(o_orderpriority, ' for ', o_orderkey) AS MODEL_OUTPUT
    FROM ({NUMBERED_SQL}) WHERE o_orderstatus = 'F'
    AND i // 3 NOT IN (SELECT i // 3 FROM ({NUMBERED_SQL}) WHERE o_orderstatus NOT IN ('F', 'O'))
""")
def ended_results(spark, sf):
    """Results of batches in which every request has come back."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    requests = numbering.assign_batches(orders, 3, ["o_orderkey"], stored_input=True)
    raw = raw_results(requests.where(F.col("o_orderstatus").isin("F", "O")))
    status = grading.batch_status(batches.request_states(requests, raw))
    results = batches.flat_results(raw).withColumn("batch_no", batches.batch_of("custom_id"))
    return matching.of_ended_batches(results, status).select("custom_id", "MODEL_OUTPUT")


STATES_SQL = """
    SELECT user_id AS batch_no, event_id, CASE event_type WHEN 'error' THEN 'errored' WHEN 'view' THEN 'canceled'
           WHEN 'signup' THEN 'expired' ELSE CASE WHEN value > 110 THEN 'processing' ELSE 'succeeded' END END AS known,
           CASE WHEN event_id % 97 = 5 THEN 'paused' WHEN event_id % 89 <> 7 THEN known END AS status
    FROM events
"""


def request_states(spark, sf):
    """Events as request states: users are batches, very large values still run; some states are new or missing."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", F.lit("errored")).when(kind == "view", F.lit("canceled"))
        .when(kind == "signup", F.lit("expired")).when(F.col("value") > 110, F.lit("processing"))
        .otherwise(F.lit("succeeded")))
    number = F.col("event_id")
    status = F.when(number % 97 == 5, F.lit("paused")).when(number % 89 != 7, status)
    return table(spark, sf, "events").select(F.col("user_id").alias("batch_no"), "event_id", status.alias("status"))


@query(f"""
    SELECT batch_no, count(*) FILTER (status = 'succeeded') AS n_succeeded,
           count(*) FILTER (status = 'processing') AS n_processing, count(*) FILTER (status = 'errored') AS n_errored,
           count(*) FILTER (status = 'canceled') AS n_canceled, count(*) FILTER (status = 'expired') AS n_expired,
           count(*) FILTER (status IS NULL OR status = 'paused') AS n_other,
           count(*) FILTER (status IS NULL OR status IN ('paused', 'processing')) = 0 AS ended
    FROM ({STATES_SQL}) GROUP BY batch_no
""")
def batch_status(spark, sf):
    return grading.batch_status(request_states(spark, sf))


@query(f"""
    SELECT event_id, batch_no, status FROM ({STATES_SQL})
    WHERE batch_no NOT IN (SELECT batch_no FROM ({STATES_SQL}) WHERE status IS NULL OR status IN ('paused', 'processing'))
""")
def ended_batches(spark, sf):
    states = request_states(spark, sf)
    return matching.of_ended_batches(states, grading.batch_status(states)).select("event_id", "batch_no", "status")


# --- joins and groups --------------------------------------------------------


@query("""
    SELECT d.doc_id, d.lang, coalesce(l.quality::VARCHAR, '') AS model_response
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def attach_responses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("response"))
    return matching.attach_responses(docs, labels, "doc_id")


@query("""
    SELECT e.event_id, e.user_id, last.event_type AS model_response
    FROM events e JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) last
    USING (user_id)
""")
def attach_last_responses(spark, sf):
    events = table(spark, sf, "events")
    responses = events.select("user_id", F.col("event_type").alias("response"), F.col("event_id").alias("seq"))
    return matching.attach_responses(events.select("event_id", "user_id"), responses, "user_id", seq="seq")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, "
       "arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return matching.last_wins(events, "user_id", "event_id", stored_input=True)


@query("""
    SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id,
           arg_max(event_type, (value, -event_id)) AS event_type, max(value) AS value
    FROM events GROUP BY user_id
""")
def best_of_n(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return selection.best_of_n(events, "user_id", "event_type", "value", "event_id")


SAMPLES_SQL = """
    SELECT doc_id, s::INTEGER AS sample_no, concat(source, '/', lang, '/', s) AS response
    FROM documents, range(3) AS samples(s)
"""


def document_samples(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return selection.expand_samples(docs, 3).select(
        "doc_id", "sample_no", F.concat_ws("/", "source", "lang", "sample_no").alias("response"))


@query(SAMPLES_SQL)
def sample_expansion(spark, sf):
    return document_samples(spark, sf)


@query(f"""
    SELECT doc_id, string_agg(response, '|' ORDER BY sample_no) AS responses FROM ({SAMPLES_SQL}) GROUP BY doc_id
""")
def group_candidates(spark, sf):
    grouped = selection.group_candidates(document_samples(spark, sf), 3, "doc_id")
    return grouped.select("doc_id", F.array_join("responses", "|").alias("responses"))


@query(f"""
    SELECT c.doc_id, c.sample_no, c.response, l.quality + c.sample_no AS score
    FROM ({SAMPLES_SQL}) c JOIN labels l USING (doc_id)
""")
def pair_scores(spark, sf):
    labels = selection.expand_samples(table(spark, sf, "labels").select("doc_id", "quality"), 3)
    scores = labels.select("doc_id", "sample_no", (F.col("quality") + F.col("sample_no")).alias("score"))
    return matching.pair_scores(document_samples(spark, sf), scores, "doc_id")


@query("SELECT d.doc_id, coalesce(nullif(d.lang, 'de'), '') AS lang, coalesce(l.quality = 1, false) AS is_correct, "
       "coalesce(l.toxic::DOUBLE, 0) AS confidence_score FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_defaults(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"))
    labels = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("is_correct"), F.col("toxic").cast("double").alias("confidence_score"))
    return with_defaults(docs.join(labels, "doc_id", "left"), {"lang": "", "is_correct": False, "confidence_score": 0.0})


# --- sources and sinks -------------------------------------------------------

DOCUMENTS_SQL = """
    SELECT concat('00', doc_id) AS id, concat('"', text, '", ', chr(10), ' ') AS text,
           coalesce(nullif(lang, 'de'), NULL) AS lang FROM documents
"""


def awkward_documents(spark, sf):
    """Leading zeros, quotes, commas, line breaks, outer blanks and nulls."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("00"), "doc_id").alias("id"),
        F.concat(F.lit('"'), "text", F.lit('", \n ')).alias("text"),
        F.nullif("lang", F.lit("de")).alias("lang"))


@query(DOCUMENTS_SQL)
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_csv(awkward_documents(spark, sf), path)
    return tables.read_csv(spark, path, ["id", "text", "lang"])


@query(DOCUMENTS_SQL)
def json_round_trip(spark, sf):
    docs, path = awkward_documents(spark, sf), scratch_path(spark, "json")
    tables.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


@query(DOCUMENTS_SQL)
def keyed_json_round_trip(spark, sf):
    docs, path = awkward_documents(spark, sf), scratch_path(spark, "keyed")
    tables.write_json(docs, path, keyed_by="id")
    return tables.read_keyed_json(spark, path, docs.schema)


@query("SELECT doc_id, text FROM documents WHERE lang = 'en'")
def split_scan(spark, sf):
    path = scratch_path(spark, "splits")
    table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("split")).write.partitionBy("split").parquet(path)
    return tables.read_split(spark, path, "en", split_col="split")
