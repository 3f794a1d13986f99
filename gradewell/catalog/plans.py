"""The whole ways from source rows to records, grades and preference triples.

Models are stand-ins: small functions of the text they are given, so that the
same results can be put in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gradewell.catalog.registry import query, table
from gradewell.catalog.tables import qa_pairs
from gradewell.catalog.text import (
    FEEDBACK_PROMPT_SQL, QUESTION_PROMPT_SQL, QUESTION_SOURCE, STRICT_SQL, VERDICTS_SQL, WS, chat_sql, literal,
    question_source, verdicts,
)
from gradewell.fixed import FEEDBACK_TEMPLATE, SYSTEM_MESSAGES
from gradewell.functions.chat import CHATML
from gradewell.functions.verdict import is_correct
from gradewell.operators import grading
from gradewell.operators.inference import answer_requests
from gradewell.operators.numbering import first_rows, read_numbered
from gradewell.plans.evaluation import evaluate, evaluate_with_metrics, grade
from gradewell.plans.execution import best_of_n_responses, execute, execute_stored, response_records
from gradewell.plans.feedback import correct_answers, feedback_requests, parse_feedback
from gradewell.plans.feedback import keep_corrected as only_corrected
from gradewell.plans.preference import preference_pairs as pairs_of
from gradewell.plans.preference import preference_set as triples
from gradewell.plans.questions import flag_missing as with_missing
from gradewell.plans.questions import rewrite_questions
from gradewell.session import scratch_path

# --- stand-in models ---------------------------------------------------------

# Failures go by the source or id of a document, so texts of every length get through.
FAILING = "src13: "


def sourced(spark, sf):
    """Documents with their source in front of the text."""
    return table(spark, sf, "documents").withColumn("text", F.concat("source", F.lit(": "), "text"))


SOURCED_SQL = "(SELECT * REPLACE (concat(source, ': ', text) AS text), source = 'src13' AS refused FROM documents)"


def _last_turn(chat: str, role: str) -> str:
    return chat.rsplit(f"{CHATML.open}{role}\n", 1)[1].rsplit(CHATML.close, 1)[0]


def make_answerer():
    """Answers with the length of the question; questions from one source fail."""

    def answer(chats):
        questions = [_last_turn(c, "user") for c in chats]
        if any(q.startswith(FAILING) for q in questions):
            raise ValueError("refused")
        return [f"It has \\boxed{{{len(q)}}} characters." for q in questions]

    return answer


def make_sampler():
    """Draws whose value depends on the question and the sample number."""

    def draw(chats, sample_numbers):
        return [str(len(_last_turn(c, "user")) * (n + 3) % 11) for c, n in zip(chats, sample_numbers)]

    return draw


def make_boxed_sampler():
    draw = make_sampler()
    return lambda chats, numbers: [f"\\boxed{{{x}}}" for x in draw(chats, numbers)]


def make_boxed_scorer():
    return lambda chats: [float(_last_turn(c, "assistant")[7:-1]) for c in chats]


def make_scorer():
    """Scores an answer by its own value."""
    return lambda chats: [float(_last_turn(c, "assistant")) for c in chats]


def _judged(chat: str) -> bool:
    prompt = _last_turn(chat, "user")
    student = prompt.rsplit("Student's Answer:\n", 1)[1].split("\n", 1)[0]
    correct = prompt.rsplit("Correct Answer:\n", 1)[1].split("\n", 1)[0]
    return student == correct


def make_judge():
    return lambda chats: ["Correct" if _judged(c) else "Wrong" for c in chats]


def make_failing_judge():
    """Fails for the questions about ids that end with 7."""

    def judge(chats):
        if any(re.search(r"How long is -?\d*7\?", c) for c in chats):
            raise ValueError("no judgement")
        return make_judge()(chats)

    return judge


def make_judge_with_logits():
    return lambda chats: [("Correct", 2.0, 0.5) if _judged(c) else ("Wrong", -1.0, 0.5) for c in chats]


def make_corrector():
    """Corrects a response unless the id asked about ends with 3."""
    return lambda prompts: [
        "" if re.search(r"How long is -?\d*3\?", p) else "<corrected_response>Fixed.</corrected_response>" for p in prompts]


# --- metrics, filters and flags ----------------------------------------------

GRADED_SQL = f"""
    SELECT doc_id, {STRICT_SQL} AS is_correct, CASE WHEN evaluation = 'Wrong' THEN 0.25 ELSE 0.75 END AS confidence_score
    FROM ({VERDICTS_SQL})
"""


def graded_labels(spark, sf):
    confidence = F.when(F.col("evaluation") == "Wrong", F.lit(0.25)).otherwise(F.lit(0.75))
    return verdicts(spark, sf).select(
        "doc_id", is_correct("evaluation").alias("is_correct"), confidence.alias("confidence_score"))


@query(f"""
    SELECT round(avg(is_correct::INT), 9) AS accuracy, count(*) AS total_samples,
           count(*) FILTER (is_correct) AS correct_samples, round(avg(confidence_score), 9)::DOUBLE AS average_confidence
    FROM ({GRADED_SQL})
""")
def accuracy(spark, sf):
    row = grading.metrics(graded_labels(spark, sf))
    return row.withColumns({c: F.round(c, 9) for c in ("accuracy", "average_confidence")})


@query(f"SELECT doc_id FROM ({GRADED_SQL}) WHERE NOT is_correct")
def wrong_answers(spark, sf):
    return grading.wrong_answers(graded_labels(spark, sf)).select("doc_id")


@query("""
    SELECT doc_id, trim(text) AS CORRECTED_RESPONSE FROM documents WHERE lang <> 'de' AND trim(text) <> ''
""")
def keep_corrected(spark, sf):
    corrected = F.when(F.col("lang") != "de", F.trim("text")).otherwise(F.lit(""))
    return only_corrected(table(spark, sf, "documents").select("doc_id", corrected.alias("CORRECTED_RESPONSE")))


@query("""
    SELECT doc_id, ANALYSIS, FMT_QUESTION,
           CASE WHEN ANALYSIS = '' THEN 'analysis' WHEN FMT_QUESTION = '' THEN 'question' END AS missing
    FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE text END AS ANALYSIS,
                 CASE WHEN lang IN ('de', 'fr') THEN '' ELSE source END AS FMT_QUESTION FROM documents)
""")
def flag_missing(spark, sf):
    analysis = F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("text"))
    question = F.when(F.col("lang").isin("de", "fr"), F.lit("")).otherwise(F.col("source"))
    return with_missing(table(spark, sf, "documents").select(
        "doc_id", analysis.alias("ANALYSIS"), question.alias("FMT_QUESTION")))


# --- running models ----------------------------------------------------------

ANSWER_SQL = "concat('It has \\boxed{', length(text), '} characters.')"


@query(f"""
    SELECT doc_id, lang, CASE WHEN refused THEN '' ELSE {ANSWER_SQL} END AS model_response FROM {SOURCED_SQL}
""")
def execute_answers(spark, sf):
    docs = sourced(spark, sf).select("doc_id", "lang", "text")
    return execute(docs, "text", make_answerer, batch_size=64).drop("text")


@query(f"SELECT doc_id, lang, CASE WHEN refused THEN '' ELSE {ANSWER_SQL} END AS model_response FROM {SOURCED_SQL}")
def execute_by_length(spark, sf):
    """Answers from batches of texts of similar length, with at most 100,000 characters when padded."""
    docs = sourced(spark, sf).select("doc_id", "lang", "text")
    return execute(docs, "text", make_answerer, batch_size=64, padded=100_000).drop("text")


@query(f"""
    SELECT doc_id, CASE WHEN text IN (SELECT text FROM {SOURCED_SQL} WHERE lang = 'en') THEN 'first' ELSE 'second' END AS model_response,
           'success' AS status FROM {SOURCED_SQL}
""")
def resumed_answers(spark, sf):
    """English questions are answered by a first run; a second one over all answers the rest only."""
    docs, store = sourced(spark, sf).select("doc_id", "lang", "text"), scratch_path(spark, "answers")
    execute_stored(docs.where("lang = 'en'"), "text", lambda: lambda chats: ["first"] * len(chats), store, "a-model", batch_size=64, rounds=4)
    out = execute_stored(docs, "text", lambda: lambda chats: ["second"] * len(chats), store, "a-model", batch_size=64, rounds=4)
    return out.select("doc_id", "model_response", "status")


@query(f"""
    SELECT doc_id::VARCHAR AS id, text AS question, CASE WHEN refused THEN '' ELSE {ANSWER_SQL} END AS response,
           CASE WHEN refused THEN 'error' ELSE 'success' END AS status, CASE WHEN refused THEN 'refused' END AS error
    FROM {SOURCED_SQL}
""")
def response_status(spark, sf):
    return response_records(sourced(spark, sf), "text", "doc_id", make_answerer, batch_size=64)


@query("""
    SELECT doc_id, arg_max(r::VARCHAR, (r, -n)) AS model_response, max(r)::DOUBLE AS score
    FROM (SELECT doc_id, n, length(text) * (n + 3) % 11 AS r FROM documents, range(5) AS samples(n)) GROUP BY doc_id
""")
def best_of_n_answers(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return best_of_n_responses(
        docs, "text", make_sampler, make_scorer, 5, score_col="score", batch_size=64).drop("text")


# --- grading -----------------------------------------------------------------

RESPONSES_SQL = r"""
    SELECT doc_id, concat('How long is ', doc_id, '?') AS question, n_chars::VARCHAR AS answer,
           concat(text, ' \boxed{1} \boxed{ ', CASE WHEN lang = 'en' THEN n_chars + 1 ELSE n_chars END, ' }') AS response
    FROM documents
"""


def document_answers(spark, sf):
    """Questions with answers and responses; English documents are answered wrongly."""
    length = F.when(F.col("lang") == "en", F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("How long is "), "doc_id", F.lit("?")).alias("question"),
        F.col("n_chars").cast("string").alias("answer"),
        F.concat("text", F.lit(r" \boxed{1} \boxed{ "), length, F.lit(" }")).alias("response"),
    )


JUDGED_SQL = f"""
    SELECT *, extracted_answer = answer AS is_correct, CASE WHEN extracted_answer = answer THEN 'Correct' ELSE 'Wrong' END AS model_evaluation
    FROM (SELECT *, trim(regexp_extract_all(response, '\\\\boxed\\{{([^{{}}]+)\\}}', 1)[-1], {WS}) AS extracted_answer
          FROM ({RESPONSES_SQL}))
"""


@query(f"""
    SELECT doc_id, question, answer, response, extracted_answer, model_evaluation, is_correct,
           round(1 / (1 + exp(0.5 - CASE WHEN is_correct THEN 2.0 ELSE -1.0 END)), 6)::DOUBLE AS confidence_score
    FROM ({JUDGED_SQL})
""")
def grade_answers(spark, sf):
    graded = grade(
        document_answers(spark, sf), "question", "response", "answer", make_judge_with_logits,
        with_confidence=True, batch_size=64)
    return graded.withColumn("confidence_score", F.round("confidence_score", 6))


@query(f"""
    SELECT round(avg((NOT refused)::INT), 9) AS accuracy, count(*) AS total_samples,
           count(*) FILTER (NOT refused) AS correct_samples, NULL::DOUBLE AS average_confidence
    FROM {SOURCED_SQL}
""")
def evaluate_model(spark, sf):
    """The metrics that are summed up while the graded rows are written."""
    docs = sourced(spark, sf).select("text", F.length("text").cast("string").alias("answer"))
    _, seen = evaluate_with_metrics(docs, "text", "answer", make_judge, make_fn=make_answerer, batch_size=64)
    return metrics_row(spark, seen)


def metrics_row(spark, seen):
    kinds = {"accuracy": "double", "total_samples": "long", "correct_samples": "long", "average_confidence": "double"}
    row = spark.range(1).select(*[F.lit(seen[name]).cast(kind).alias(name) for name, kind in kinds.items()])
    return row.withColumn("accuracy", F.round("accuracy", 9))


@query("""
    SELECT round(avg((best = expected)::INT), 9) AS accuracy, count(*) AS total_samples,
           count(*) FILTER (best = expected) AS correct_samples, NULL::DOUBLE AS average_confidence
    FROM (SELECT max(length(text) * (n + 3) % 11) AS best, any_value(length(text) * 4 % 11) AS expected
          FROM documents, range(5) AS samples(n) GROUP BY doc_id)
""")
def evaluate_best_of_n(spark, sf):
    """Metrics of the best of five answers, where the second one is right."""
    docs = table(spark, sf, "documents").select("text", (F.length("text") * 4 % 11).cast("string").alias("answer"))
    _, seen = evaluate_with_metrics(
        docs, "text", "answer", make_judge, make_fn=make_boxed_sampler, make_score_fn=make_boxed_scorer, batch_size=64)
    return metrics_row(spark, seen)


def make_refusing_sampler():
    """Draws for a boxed answer; questions from one source fail for every sample."""
    draw = make_boxed_sampler()

    def sample(chats, numbers):
        if any(_last_turn(c, "user").startswith(FAILING) for c in chats):
            raise ValueError("refused")
        return draw(chats, numbers)

    return sample


def make_boxed_scorer_or_zero():
    return lambda chats: [float(_last_turn(c, "assistant")[7:-1] or 0) for c in chats]


@query(f"""
    SELECT doc_id, CASE WHEN refused THEN 'error' ELSE 'success' END AS response_status, CASE WHEN refused THEN 'refused' END AS response_error,
           NOT refused AND best = length(text) * 4 % 11 AS is_correct
    FROM {SOURCED_SQL} JOIN (SELECT doc_id, max(length(text) * (n + 3) % 11) AS best FROM {SOURCED_SQL}, range(5) AS samples(n) GROUP BY doc_id) USING (doc_id)
""")
def graded_best_of_n(spark, sf):
    """The best of five answers, graded; a question of which all samples fail is marked, not just wrong."""
    docs = sourced(spark, sf).select("doc_id", "text", (F.length("text") * 4 % 11).cast("string").alias("answer"))
    graded = evaluate(docs, "text", "answer", make_judge, make_fn=make_refusing_sampler, make_score_fn=make_boxed_scorer_or_zero, batch_size=64, status=True)
    return graded.select("doc_id", "response_status", "response_error", "is_correct")


# --- records and triples -----------------------------------------------------


def rewrites(requests):
    """Rewritten questions; French sources lack the question, German ones any answer."""
    question = F.when(
        F.col("GOLD_EVIDENCE") != "fr", F.concat(F.lit("<new_question>\n"), "QUESTION", F.lit(" </new_question>")))
    text = F.concat(F.lit("<analysis>"), "PRE_TEXT", F.lit("</analysis>"), F.coalesce(question, F.lit("")))
    return requests.select("custom_id", F.when(F.col("GOLD_EVIDENCE") != "None", text).alias("MODEL_OUTPUT"))


QUESTION_SLOT_COLUMNS = 'PRE_TEXT, "TABLE", POST_TEXT, QUESTION, ANSWER, GOLD_EVIDENCE'


@query(f"""
    SELECT trim(PRE_TEXT, {WS}) AS ANALYSIS, CASE WHEN GOLD_EVIDENCE = 'fr' THEN '' ELSE QUESTION END AS FMT_QUESTION,
           id, {QUESTION_PROMPT_SQL} AS PROMPT, {QUESTION_SLOT_COLUMNS}
    FROM ({QUESTION_SOURCE}) WHERE GOLD_EVIDENCE <> 'None'
""")
def question_records(spark, sf):
    source = question_source(read_numbered(spark, f"{sf}/documents.parquet"), "row_index")
    return rewrite_questions(source, rewrites, batch_size=8, index_col="row_index")


@query(f"""
    SELECT trim(PRE_TEXT, {WS}) AS ANALYSIS, CASE WHEN GOLD_EVIDENCE = 'fr' THEN '' ELSE QUESTION END AS FMT_QUESTION,
           id, {QUESTION_PROMPT_SQL} AS PROMPT, {QUESTION_SLOT_COLUMNS}
    FROM (SELECT * FROM ({QUESTION_SOURCE}) ORDER BY ANSWER::BIGINT DESC, id LIMIT 60) WHERE GOLD_EVIDENCE <> 'None'
""")
def question_sample(spark, sf):
    """Rewrites of the sixty longest documents."""
    docs = table(spark, sf, "documents").withColumn("rank", -F.col("n_chars")).withColumn("text_id", F.col("doc_id").cast("string"))
    source = question_source(first_rows(docs, 60, ["rank", "text_id"], stored_input=True))
    return rewrite_questions(source, rewrites, batch_size=8)


WRONG_SQL = f"""
    SELECT doc_id::VARCHAR AS id, question AS QUESTION, answer AS ANSWER, response AS COT_RESPONSE,
           extracted_answer AS EXTRACTED_ANSWER FROM ({JUDGED_SQL}) WHERE NOT is_correct
"""


def corrections(requests):
    """Corrections that state the reference answer; ids that end with 3 get none."""
    text = F.concat(
        F.lit("Sure. <corrected_response>\n"), "COT_RESPONSE", F.lit(r" so \boxed{"), "ANSWER",
        F.lit("}\n</corrected_response>"))
    known = ~F.col("QUESTION").endswith("3?")
    return requests.select("custom_id", F.when(known, text).otherwise(F.lit("no idea")).alias("MODEL_OUTPUT"))


CORRECTED_SQL = f"""
    SELECT trim(concat(COT_RESPONSE, ' so \\boxed{{', ANSWER, '}}'), {WS}) AS CORRECTED_RESPONSE, *
    FROM ({WRONG_SQL}) WHERE NOT ends_with(QUESTION, '3?')
"""


def graded_documents(spark, sf):
    return grade(document_answers(spark, sf), "question", "response", "answer", make_judge, batch_size=64)


@query(f"""
    SELECT CORRECTED_RESPONSE, id, {FEEDBACK_PROMPT_SQL} AS PROMPT, QUESTION, ANSWER, COT_RESPONSE, EXTRACTED_ANSWER
    FROM ({CORRECTED_SQL})
""")
def feedback_records(spark, sf):
    wrong = grading.wrong_answers(graded_documents(spark, sf)).withColumnRenamed("response", "cot_response")
    return correct_answers(wrong, corrections, id_col="doc_id")


@query(f"""
    SELECT 'Fixed.' AS CORRECTED_RESPONSE, id, {FEEDBACK_PROMPT_SQL} AS PROMPT, QUESTION, ANSWER, COT_RESPONSE, EXTRACTED_ANSWER
    FROM ({WRONG_SQL}) WHERE NOT ends_with(QUESTION, '3?')
""")
def feedback_made_in_place(spark, sf):
    wrong = grading.wrong_answers(graded_documents(spark, sf)).withColumnRenamed("response", "cot_response")
    answered = answer_requests(feedback_requests(wrong, id_col="doc_id"), make_corrector, batch_size=64)
    return parse_feedback(answered, template=FEEDBACK_TEMPLATE, unique_ids=True)


def prompt_sql(question: str) -> str:
    return chat_sql(question, literal(SYSTEM_MESSAGES["cot"]))


@query(f"""
    SELECT {prompt_sql("u.text")} AS prompt, a.text AS chosen, concat(a.text, ' (draft)') AS rejected
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant' AND u.turn <> 2
""")
def preference_pairs(spark, sf):
    answers = qa_pairs(spark, sf).select(
        F.col("question").alias("QUESTION"),
        F.when(~F.col("pair_id").endswith("-2"), F.col("response")).alias("CORRECTED_RESPONSE"),
        F.concat("response", F.lit(" (draft)")).alias("AI_RESPONSE"))
    return pairs_of(answers)


@query(f"""
    SELECT {prompt_sql('QUESTION')} AS prompt, CORRECTED_RESPONSE AS chosen, COT_RESPONSE AS rejected
    FROM ({CORRECTED_SQL}) WHERE id::BIGINT % 10 NOT IN (1, 5, 7)
""")
def preference_set(spark, sf):
    """Ids that end with 1 have no response, with 5 an empty one, and with 7 the judge fails."""
    last = F.col("doc_id") % 10
    answers = document_answers(spark, sf).withColumn(
        "response", F.when(last == 5, F.lit("")).when(last != 1, F.col("response")))
    graded = grade(answers, "question", "response", "answer", make_failing_judge, batch_size=64, status=True)
    return triples(graded, corrections, "doc_id", "question", "answer", "response", unique_ids=True)
