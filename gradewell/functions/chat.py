"""Chat messages and their flat text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.fixed import JUDGE_SYSTEM_MESSAGE, JUDGE_TEMPLATE, SYSTEM_MESSAGES
from gradewell.functions.text import stringify


@dataclass(frozen=True)
class ChatFormat:
    """Delimiters around each message.  The default is the public ChatML layout;
    a model with another template needs its own."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    reply: str = "<|im_start|>assistant\n"


CHATML = ChatFormat()


def system_message(mode: str) -> str:
    """System text of a reasoning mode, ``cot`` or ``tir``."""
    if mode not in SYSTEM_MESSAGES:
        raise ValueError(f"unknown mode {mode!r}, choose from {sorted(SYSTEM_MESSAGES)}")
    return SYSTEM_MESSAGES[mode]


def _text(c: Column | str) -> Column:
    """A plain string is literal text here, as system messages are."""
    return F.lit(c) if isinstance(c, str) else c


def chat(user: Column, system: Column | str | None = None, assistant: Column | None = None) -> Column:
    """Ordered messages as ``array<struct<role, content>>``."""
    turns = (("system", system), ("user", user), ("assistant", assistant))
    return F.array(*[
        F.struct(F.lit(role).alias("role"), _text(content).alias("content"))
        for role, content in turns if content is not None
    ])


def chat_text(
    user: Column,
    system: Column | str | None = None,
    assistant: Column | None = None,
    fmt: ChatFormat = CHATML,
    reply: bool = True,
) -> Column:
    """Flat text of a system/user[/assistant] chat as one ``concat``; with
    ``reply`` it ends where the model's answer begins."""
    parts = []
    for role, content in (("system", system), ("user", user), ("assistant", assistant)):
        if content is not None:
            parts += [F.lit(fmt.open + role + fmt.after_role), _text(content), F.lit(fmt.close)]
    return F.concat(*parts, F.lit(fmt.reply if reply else ""))


def render_chat(messages: Column | str, fmt: ChatFormat = CHATML, reply: bool = True) -> Column:
    """Flat text of a chat of any length, given as an array of messages."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    turns = F.transform(messages, lambda m: F.concat(
        F.lit(fmt.open), m["role"], F.lit(fmt.after_role), m["content"], F.lit(fmt.close)))
    return F.concat(F.array_join(turns, ""), F.lit(fmt.reply if reply else ""))


def judge_prompt(question: Column, student_answer: Column, correct_answer: Column) -> Column:
    """What the judge is asked; a missing value prints ``None``.

    Built as one ``concat`` over the pieces of the template: slot marks inside
    the values stay as they are.
    """
    values = {"question": question, "student_answer": student_answer, "correct_answer": correct_answer}
    parts, rest = [], JUDGE_TEMPLATE
    for slot, value in values.items():
        before, rest = rest.split("{{" + slot + "}}")
        parts += [F.lit(before), stringify(value)]
    return F.concat(*parts, F.lit(rest))


def judge_chat_text(
    question: Column,
    student_answer: Column,
    correct_answer: Column,
    system: str | None = None,
    fmt: ChatFormat = CHATML,
) -> Column:
    """The judge's whole input: its system message, then the judge prompt."""
    return chat_text(judge_prompt(question, student_answer, correct_answer), system or JUDGE_SYSTEM_MESSAGE, fmt=fmt)
