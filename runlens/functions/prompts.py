"""Prompt assembly (P17, P18) as column expressions.

The template texts are fixed values: the exact strings the agents send.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiple-choice question template.
MC_HEAD = "Answer this multiple choice question.\n\n"
MC_TAIL = '\n\nRespond with JSON only: {"answer": "A"} (value is A, B, C, or D).'

# The few-shot case template of the label task.
CASE_HEAD = "你是一位法律专家。根据以下案件事实，预测被告人被判定的罪名。\n\n"
CASE_EXAMPLES_HEAD = "\n示例：\n"
CASE_FACTS = "\n案件事实：\n"
CASE_CHOOSE = "\n\n请从以下191个罪名中选择一个最合适的罪名：\n"
CASE_TAIL = "... (共191个罪名)\n\n只回答罪名，不要其他解释。格式：罪名"


def format_question(question: Column, options: Column) -> Column:
    """Question text and the four options of a ``MAP<STRING,STRING>``."""
    parts = [F.lit(MC_HEAD), question, F.lit("\n\n")]
    for i, letter in enumerate("ABCD"):
        parts += [F.lit(("\n" if i else "") + f"{letter}) "), F.try_element_at(options, F.lit(letter))]
    parts.append(F.lit(MC_TAIL))
    return F.concat(*parts)


def examples_block(labels: Column) -> Column:
    """The optional example list: empty when there are no sample labels."""
    lines = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(labels) > 0, F.concat(F.lit(CASE_EXAMPLES_HEAD), lines, F.lit("\n"))).otherwise(F.lit(""))


def classes_text(first_classes: Column) -> Column:
    return F.array_join(F.slice(first_classes, 1, 20), ", ")


def case_prompt(case_text: Column, examples: Column, classes: Column) -> Column:
    """P18 from its parts: the example block, the case text, the class list text."""
    return F.concat(F.lit(CASE_HEAD), examples, F.lit(CASE_FACTS), case_text, F.lit(CASE_CHOOSE),
                    F.coalesce(classes, F.lit("")), F.lit(CASE_TAIL))


def format_case(case_text: Column, sample_labels: Column, first_classes: Column) -> Column:
    """Up to 10 example labels, the case text and the first 20 classes."""
    return case_prompt(case_text, examples_block(F.slice(sample_labels, 1, 10)), classes_text(first_classes))
