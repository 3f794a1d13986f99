"""Prompt wordings, slots, tags, patterns and defaults.

Results are only comparable with earlier runs of the same prompts when these
match to the character, so they are kept together here as plain text.  Every
template can be replaced through an argument of the plan that uses it.
"""

# --- fixed values: system messages by reasoning mode -------------------------
SYSTEM_MESSAGES = {
    "tir": "Please integrate natural language reasoning with programs to solve the problem above, "
    "and put your final answer within \\boxed{}.",
    "cot": "Please reason step by step, and put your final answer within \\boxed{}.",
}

# --- fixed values: the judge -------------------------------------------------
JUDGE_SYSTEM_MESSAGE = (
    "You are a math teacher evaluating student answers. "
    "Your task is to determine if the student's answer matches the correct answer. "
    "Respond with 'Correct' if the answer matches, and 'Incorrect' if it doesn't."
)
JUDGE_TEMPLATE = """
Question:
{{question}}

Student's Answer:
{{student_answer}}

Correct Answer:
{{correct_answer}}

Is the student's final answer correct? Respond with either 'Correct' or 'Wrong'.
"""
NEUTRAL_CONFIDENCE = 0.5

# --- fixed values: question rewrite template ---------------------------------
QUESTION_TEMPLATE = """
You are an expert financial analyst tasked with creating comprehensive, self-contained questions based on complex financial reports. Your goal is to reformulate given information into a single question that includes all necessary context for answering without additional information.

Here is the financial report you need to analyze:

<pre_text>
{{PRE_TEXT}}
</pre_text>

<table>
{{TABLE}}
</table>

<post_text>
{{POST_TEXT}}
</post_text>

For reference, here is the original question and its answer:

<question>{{QUESTION}}</question>
<answer>{{ANSWER}}</answer>

And here is the key evidence used to answer the original question:

<gold_evidence>{{GOLD_EVIDENCE}}</gold_evidence>

Your task is to create a new, more comprehensive question that incorporates all the necessary information from the provided text, including the details from the gold evidence. Follow these steps:

1. Carefully analyze the given text, extracting and listing key financial figures, percentages, dates, and any other relevant information.
2. Identify the main topic or focus of the original question and summarize it.
3. Compare the original question with the gold evidence to ensure all crucial information is captured.
4. Extract all relevant information from the provided text that is necessary to answer the question.
5. Incorporate this information into a new, single question that is self-contained and provides all the context needed to solve it.
6. Ensure that the new question is clear, concise, and specific.
7. Include all necessary numerical values, dates, or other details within the question itself.

Guidelines for the new question:
- It should be possible to answer the question using only the information provided within the question text.
- Avoid references to external documents or additional context.
- Use clear and precise language.
- Make sure to create a single question, not a list of questions.
- The question should provide all data necessary to answer it within its text.

Before formulating your final question, wrap your analysis in <analysis> tags to break down the information and show your thought process. This will help ensure a thorough interpretation of the data.

Format your output as follows:

<analysis>
[Your detailed analysis of the report, breaking down key facts and their relationships]
</analysis>

<new_question>
[Your newly formulated, auto-explainable question with all necessary details from the analysis in order to answer the question]
</new_question>

Ensure that your new question is sufficiently detailed and self-contained so that it can be answered accurately without any additional context.
"""
ANALYSIS_TAG = "analysis"
NEW_QUESTION_TAG = "new_question"

# --- fixed values: correction template ---------------------------------------
FEEDBACK_TEMPLATE = """
Your task is to improve the AI's response and reasoning to match the reference answer given the question posed to it.

<question>{{question}}</question>
<reference_answer>{{answer}}</reference_answer>

The AI's response was:

<ai_reasoning>
{{cot_response}}
</ai_reasoning>

<ai_answer>
{{extracted_answer}}
</ai_answer>

The reference answer is:

<reference_answer>
{{answer}}
</reference_answer>

Your task:

- Provide a corrected version of the AI's reasoning that fixes the mistakes it made to reach match the <reference_answer> based solo on the <question>. Make sure to include the final answer within \\boxed{}.
- Ensure that the corrected_response is an improved version of the AI's response at <ai_reasoning> without rewriting it entirely. It should preserve most of the AI's reasoning only with minor adjustments to get to the correct answer from the wrong answer provided by the AI on <ai_answer>.

Provide your corrected response, including the final answer within \\boxed{}, based on the <ai_response>, in the following format:

<corrected_response>
[Your corrected ai_reasoning with the final answer within \\boxed{} here]
</corrected_response>
"""
FEEDBACK_SLOTS = ("question", "answer", "cot_response", "extracted_answer")
CORRECTED_TAG = "corrected_response"

# --- fixed values: output columns a caller's field may not shadow ------------
RESERVED_QUESTION_FIELDS = ("ANALYSIS", "FMT_QUESTION", "PROMPT")
RESERVED_FEEDBACK_FIELDS = ("CORRECTED_RESPONSE", "PROMPT")

# --- fixed values: request settings and batch sizes --------------------------
# The request batch size holds where a plan is given no batch size.
REQUEST_MAX_TOKENS = 4096
REQUEST_TEMPERATURE = 0.0
REQUEST_BATCH_SIZE = 1000
QUESTION_BATCH_SIZE = 4
FEEDBACK_BATCH_SIZE = 5
GENERATION_BATCH_SIZE = 4
BEST_OF_N = 5

# --- fixed values: request states --------------------------------------------
REQUEST_STATES = ("succeeded", "processing", "errored", "canceled", "expired")

# --- fixed values: what counts as white space around model text --------------
# Tab to carriage return, the four ASCII separators with the space, next line,
# and the Unicode space, line and paragraph separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
