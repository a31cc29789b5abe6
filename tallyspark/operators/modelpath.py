"""Preparing prompts within a budget and validating what a model returns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.text import token_estimate

#: Budgets in tokens and the longest explanation in characters.
PROMPT_BUDGET, CONTEXT, ANSWER, MARGIN, LONGEST_EXPLANATION = 1300, 2048, 512, 64, 500
#: Fixed value: the keys of an answer.
OUTPUT_SCHEMA = "transaction_id string, recommended_action string, explanation string, candidate_allocations array<struct<student_id:string,amount_minor:string,reason_codes:array<string>>>"


def within_budget(variants: list[Column], budget: int = PROMPT_BUDGET) -> Column:
    """The first variant whose token estimate fits, from the fullest to the shortest; null if none does."""
    return F.coalesce(*(F.when(token_estimate(v) <= budget, v) for v in variants))


def answer_budget(prompt: Column) -> Column:
    return F.least(F.lit(ANSWER), F.lit(CONTEXT - MARGIN) - token_estimate(prompt))


def output_problem(raw: Column, transaction: Column, students: Column, codes: tuple[str, ...], actions: tuple[str, ...]) -> Column:
    """The first rule a model's answer breaks, or null. Amounts must be whole JSON numbers, not booleans or texts."""
    v = F.from_json(raw, OUTPUT_SCHEMA)
    lines = F.coalesce(v["candidate_allocations"], F.array().cast("array<struct<student_id:string,amount_minor:string,reason_codes:array<string>>>"))
    known = F.array(*(F.lit(c) for c in codes))
    return (
        F.when(v.isNull() | v["transaction_id"].isNull() | v["recommended_action"].isNull(), "invalid_json")
        .when(v["transaction_id"] != transaction, "transaction_id_mismatch")
        .when(~v["recommended_action"].isin(*actions), "bad_action")
        .when(F.char_length(v["explanation"]) > LONGEST_EXPLANATION, "explanation_too_long")
        .when(F.exists(lines, lambda x: ~F.coalesce(F.array_contains(students, x["student_id"]), F.lit(False))), "unknown_student_id")
        .when(F.exists(lines, lambda x: ~F.coalesce(x["amount_minor"].rlike("^[0-9]+$"), F.lit(False))), "bad_amount")
        .when(F.exists(lines, lambda x: F.size(F.array_except(F.coalesce(x["reason_codes"], F.array().cast("array<string>")), known)) > 0), "unknown_reason_code")
    )


def first_json_object(text: str | None, *required: str) -> dict | None:
    """The first object with the required keys that can be decoded somewhere in a free text."""
    decoder, at = json.JSONDecoder(), -1
    while text and (at := text.find("{", at + 1)) >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(found, dict) and all(k in found for k in required):
            return found
    return None


def call_model(prompts: DataFrame, backend: Callable[[], Callable[[str], str]], retries: int = 1) -> DataFrame:
    """(id, output, failure): every prompt through a backend that each partition opens once; a transport error is
    retried, then recorded, never raised. prompts: (id, prompt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = backend()
        for batch in batches:
            out, failed = [], []
            for prompt in batch["prompt"]:
                answer, problem = None, "transport"
                for _ in range(retries + 1):
                    try:
                        answer, problem = ask(prompt), None
                        break
                    except OSError:
                        continue
                out.append(answer)
                failed.append(problem)
            yield pd.DataFrame({"id": batch["id"], "output": out, "failure": failed})

    kind = dict(prompts.dtypes)["id"]
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, output string, failure string")


def answers(text: Column) -> Column:
    """Of the first JSON object in a free text that has an action and allocations: what matters for money, as text
    'action|student:amount,...' with sorted allocations; null if there is none."""
    return _answers(text)


def _reduced(text: str | None) -> str | None:
    at = -1
    while text and (at := text.find("{", at + 1)) >= 0:
        found = first_json_object(text[at:], "recommended_action", "candidate_allocations")
        if found is None:
            return None
        try:
            pairs = sorted((str(a["student_id"]), int(a["amount_minor"])) for a in found["candidate_allocations"])
            if isinstance(found["recommended_action"], str):
                return found["recommended_action"] + "|" + ",".join(f"{s}:{m}" for s, m in pairs)
        except (KeyError, TypeError, ValueError):
            continue
    return None


@F.arrow_udf(T.StringType())
def _answers(texts: pa.Array) -> pa.Array:
    return pa.array([_reduced(t) for t in texts.to_pylist()], pa.string())


_answers = _answers.asNondeterministic()  # run once, also under filters


def messages(prompt: Column, family: str) -> Column:
    """A prompt of a system and a user part, in the chat form of a model family, as JSON: families without a system
    role get both parts in the user's turn."""
    part = lambda role: F.regexp_extract(prompt, f"(?s)<\\|im_start\\|>{role}\n(.*?)<\\|im_end\\|>", 1)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if family == "joined":
        return F.to_json(F.array(turn("user", F.concat(F.lit("Instructions:\n"), part("system"), F.lit("\n\nTask:\n"), part("user")))))
    if family == "separate":
        return F.to_json(F.array(turn("system", part("system")), turn("user", part("user"))))
    raise ValueError(f"unknown family: {family}")
