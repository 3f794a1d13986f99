"""Text, chat and scoring functions over whole columns.

The tables hold no boxed answers, tags, code or verdicts, so each query marks
up a real text column first, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.catalog.registry import literal, query, table
from gradewell.fixed import (
    FEEDBACK_TEMPLATE, JUDGE_SYSTEM_MESSAGE, JUDGE_TEMPLATE, QUESTION_TEMPLATE, SYSTEM_MESSAGES, WHITESPACE,
)
from gradewell.functions import text as tx
from gradewell.functions.chat import CHATML, chat, chat_text, judge_chat_text, judge_prompt, render_chat
from gradewell.functions.verdict import (
    confidence_from_logits, confidence_from_probabilities, is_correct, mean_score,
)
from gradewell.operators.schema import upper_fields
from gradewell.plans.feedback import fill_slots
from gradewell.plans.questions import with_prompt

WS = literal(WHITESPACE)


@query(r"""
    SELECT doc_id, trim(regexp_extract_all(t, '\\boxed\{([^{}]+)\}', 1)[-1], """ + WS + r""") AS answer
    FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN text
                 ELSE concat('\boxed{0} ', text, ' \boxed{ ', n_chars, ' } \boxed{{}}') END AS t FROM documents)
""")
def boxed_answer(spark, sf):
    marked = F.when(F.col("lang") == "de", F.col("text")).otherwise(
        F.concat(F.lit(r"\boxed{0} "), "text", F.lit(r" \boxed{ "), "n_chars", F.lit(r" } \boxed{{}}")))
    return table(spark, sf, "documents").select("doc_id", tx.boxed_answer(marked).alias("answer"))


@query(f"""
    SELECT doc_id,
           trim(regexp_extract(t, '(?is)<analysis>(.*?)</analysis>', 1), {WS}) AS analysis,
           trim(regexp_extract(t, '(?is)<new_question>(.*?)</new_question>', 1), {WS}) AS question
    FROM (SELECT doc_id, concat('<Analysis> ', text, chr(10), ' </ANALYSIS> <analysis>', source, '</analysis>',
                 CASE WHEN lang = 'en' THEN concat('<new_question>', source, '</new_question>') ELSE '' END) AS t
          FROM documents)
""")
def tag_extract(spark, sf):
    question = F.when(F.col("lang") == "en", F.concat(F.lit("<new_question>"), "source", F.lit("</new_question>")))
    marked = F.concat(
        F.lit("<Analysis> "), "text", F.lit("\n </ANALYSIS> <analysis>"), "source", F.lit("</analysis>"),
        question.otherwise(F.lit("")))
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.tagged_section(marked, "analysis").alias("analysis"),
        tx.tagged_section(marked, "new_question").alias("question"),
    )


@query(f"""
    SELECT doc_id,
           trim(array_to_string(list_transform(
               string_split(regexp_replace(t, concat('\\n[', {WS}, ']*\\n'), chr(10), 'g'), chr(10)),
               lambda x: trim(x, {WS})), chr(10)), {WS}) AS cleaned
    FROM (SELECT doc_id, replace(text, '. ', concat('. ', chr(9), chr(10), ' ', chr(160), chr(10), '  ')) AS t
          FROM documents)
""")
def clean_text(spark, sf):
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(". \t\n \xa0\n  "))
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(spaced).alias("cleaned"))


@query(f"""
    SELECT doc_id, trim(concat(chr(160), chr(9), text, chr(8195), chr(10)), {WS}) AS stripped FROM documents
""")
def strip_text(spark, sf):
    padded = F.concat(F.lit("\xa0\t"), "text", F.lit("\u2003\n"))
    return table(spark, sf, "documents").select("doc_id", tx.strip(padded).alias("stripped"))


@query(r"""
    SELECT doc_id, has_code,
           CASE WHEN has_code THEN regexp_extract(t, '(?s)```python\n(.*?)\n```', 1) END AS code,
           CASE WHEN has_code THEN concat(t, chr(10), n_chars, chr(10), '```') ELSE t END AS continued
    FROM (SELECT *, regexp_matches(t, '(?s)```python\n(.*?)\n```') AS has_code
          FROM (SELECT doc_id, n_chars, concat(text, chr(10), '```python', chr(10), 'print(', n_chars, ')',
                       CASE WHEN lang = 'fr' THEN '' ELSE concat(chr(10), '```', chr(10), '```python', chr(10), '0', chr(10), '```') END) AS t
                FROM documents))
""")
def code_block(spark, sf):
    end = F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.lit("\n```\n```python\n0\n```"))
    marked = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.concat("text", F.lit("\n```python\nprint("), "n_chars", F.lit(")"), end).alias("t"))
    found = marked.withColumn("code", tx.code_block("t"))
    has_code = F.col("code").isNotNull()
    return found.select(
        "doc_id", has_code.alias("has_code"), "code",
        F.when(has_code, tx.append_tool_output("t", "n_chars")).otherwise(F.col("t")).alias("continued"))


@query("""
    SELECT o_orderkey AS id, o_totalprice::VARCHAR AS O_TOTALPRICE, o_orderstatus AS O_ORDERSTATUS,
           coalesce(nullif(o_orderpriority, '5-LOW'), 'None') AS O_ORDERPRIORITY,
           CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END AS EXPENSIVE
    FROM (SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders)
""")
def upper_case_fields(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        (F.col("o_totalprice") > 200000).alias("expensive"))
    return upper_fields(orders, keep="id")


QUESTION_SOURCE = """
    SELECT doc_id::VARCHAR AS id, text AS PRE_TEXT, concat('[["', lang, '","', source, '"]]') AS "TABLE",
           concat(source, ' {{QUESTION}}') AS POST_TEXT, concat('How long is ', doc_id, '?') AS QUESTION,
           n_chars::VARCHAR AS ANSWER, coalesce(nullif(lang, 'de'), 'None') AS GOLD_EVIDENCE
    FROM documents
"""


def question_source(documents, *more):
    """Documents in the layout of the question rewrite: nested table, null evidence,
    and a value that holds a later slot."""
    return documents.select(
        *more,
        F.col("doc_id").alias("id"),
        F.col("text").alias("pre_text"),
        F.array(F.array("lang", "source")).alias("table"),
        F.concat("source", F.lit(" {{QUESTION}}")).alias("post_text"),
        F.concat(F.lit("How long is "), "doc_id", F.lit("?")).alias("question"),
        F.col("n_chars").alias("answer"),
        F.nullif("lang", F.lit("de")).alias("gold_evidence"),
    )


def rendered(template: str, slots: dict[str, str]) -> str:
    """SQL that fills the slots of a template one after the other."""
    sql = literal(template)
    for slot, value in slots.items():
        sql = f"replace({sql}, '{{{{{slot}}}}}', {value})"
    return sql


QUESTION_PROMPT_SQL = rendered(QUESTION_TEMPLATE, {
    "ID": "id", "PRE_TEXT": "PRE_TEXT", "TABLE": '"TABLE"', "POST_TEXT": "POST_TEXT",
    "QUESTION": "QUESTION", "ANSWER": "ANSWER", "GOLD_EVIDENCE": "GOLD_EVIDENCE"})


@query(f"SELECT id, {QUESTION_PROMPT_SQL} AS PROMPT FROM ({QUESTION_SOURCE})")
def question_prompt(spark, sf):
    source = upper_fields(question_source(table(spark, sf, "documents")), keep="id")
    return with_prompt(source, QUESTION_TEMPLATE).select("id", "PROMPT")


FEEDBACK_PROMPT_SQL = rendered(FEEDBACK_TEMPLATE, {
    "question": "QUESTION", "answer": "ANSWER", "cot_response": "COT_RESPONSE", "extracted_answer": "EXTRACTED_ANSWER"})


@query(f"""
    SELECT id, {FEEDBACK_PROMPT_SQL} AS PROMPT
    FROM (SELECT doc_id::VARCHAR AS id, concat('What is ', doc_id, '? $1 ', chr(92)) AS QUESTION, n_chars::VARCHAR AS ANSWER,
                 text AS COT_RESPONSE, coalesce(nullif(lang, 'en'), 'None') AS EXTRACTED_ANSWER FROM documents)
""")
def feedback_prompt(spark, sf):
    answers = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("What is "), "doc_id", F.lit("? $1 \\")).alias("question"),
        F.col("n_chars").alias("answer"),
        F.col("text").alias("cot_response"),
        F.nullif("lang", F.lit("en")).alias("extracted_answer"),
    )
    slots = ("question", "answer", "cot_response", "extracted_answer")
    return fill_slots(upper_fields(answers, keep="id"), FEEDBACK_TEMPLATE, slots).select("id", "PROMPT")


def judge_prompt_sql(question: str, student: str, correct: str) -> str:
    return rendered(JUDGE_TEMPLATE, {"correct_answer": correct, "student_answer": student, "question": question})


def chat_sql(user: str, system: str, assistant: str | None = None, reply: bool = True) -> str:
    parts = [literal(f"{CHATML.open}system\n"), system, literal(f"{CHATML.close}{CHATML.open}user\n"), user, literal(CHATML.close)]
    if assistant:
        parts += [literal(f"{CHATML.open}assistant\n"), assistant, literal(CHATML.close)]
    if reply:
        parts.append(literal(CHATML.reply))
    return f"concat({', '.join(parts)})"


JUDGE_SQL = judge_prompt_sql("text", "coalesce(nullif(lang, 'de'), 'None')", "source")


@query(f"""
    SELECT doc_id, {JUDGE_SQL} AS prompt, {chat_sql(JUDGE_SQL, literal(JUDGE_SYSTEM_MESSAGE))} AS chat FROM documents
""")
def judge_prompts(spark, sf):
    values = (F.col("text"), F.nullif("lang", F.lit("de")), F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id", judge_prompt(*values).alias("prompt"), judge_chat_text(*values).alias("chat"))


@query(f"""
    SELECT doc_id, {chat_sql("text", literal(SYSTEM_MESSAGES["cot"]))} AS cot,
           {chat_sql("text", literal(SYSTEM_MESSAGES["tir"]))} AS tir,
           {chat_sql("text", literal(SYSTEM_MESSAGES["cot"]), "source", reply=False)} AS scored
    FROM documents
""")
def chat_texts(spark, sf):
    text, cot, tir = F.col("text"), SYSTEM_MESSAGES["cot"], SYSTEM_MESSAGES["tir"]
    return table(spark, sf, "documents").select(
        "doc_id",
        chat_text(text, cot).alias("cot"),
        chat_text(text, tir).alias("tir"),
        render_chat(chat(text, cot, F.col("source")), reply=False).alias("scored"),
    )


VERDICTS_SQL = """
    SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'The answer is CORRECT!'
                        WHEN quality = 1 THEN 'That is not correct.'
                        WHEN toxic = 1 THEN 'Wrong' ELSE 'Incorrect' END AS evaluation FROM labels
"""


def verdicts(spark, sf):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    evaluation = (
        F.when(good & ~toxic, F.lit("The answer is CORRECT!"))
        .when(good, F.lit("That is not correct."))
        .when(toxic, F.lit("Wrong"))
        .otherwise(F.lit("Incorrect")))
    return table(spark, sf, "labels").select("doc_id", evaluation.alias("evaluation"))


@query(f"SELECT doc_id, lower(evaluation) LIKE '%correct%' AS is_correct FROM ({VERDICTS_SQL})")
def verdict_contains(spark, sf):
    return verdicts(spark, sf).select("doc_id", is_correct("evaluation", "contains").alias("is_correct"))


STRICT_SQL = r"""(regexp_matches(lower(evaluation), '\bcorrect\b')
    AND NOT regexp_matches(lower(evaluation), '\bincorrect\b|\bwrong\b|\bnot correct\b'))"""


@query(f"SELECT doc_id, {STRICT_SQL} AS is_correct FROM ({VERDICTS_SQL})")
def verdict_strict(spark, sf):
    return verdicts(spark, sf).select("doc_id", is_correct("evaluation").alias("is_correct"))


@query("""
    SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(l_tax * 100 - l_quantity)), 6) AS confidence FROM lineitem
""")
def confidence(spark, sf):
    share = confidence_from_logits(F.col("l_quantity"), F.col("l_tax") * 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(share, 6).alias("confidence"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount + l_tax = 0 THEN 0.5
           ELSE round(l_discount / (l_discount + l_tax), 6) END::DOUBLE AS confidence FROM lineitem
""")
def confidence_of_probabilities(spark, sf):
    share = confidence_from_probabilities(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(share, 6).alias("confidence"))


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS score FROM embeddings")
def score_mean(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(mean_score("embedding"), 6).alias("score"))
