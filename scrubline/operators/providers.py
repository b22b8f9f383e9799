"""Hooks for language models: a protocol, a provider that does nothing, prompt budgets, and checked JSON answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Characters a token, tokens of templates, least budget, and the window where none is known.
CHARS_PER_TOKEN, TEMPLATE_TOKENS, LEAST_TOKENS, UNKNOWN_WINDOW = 3.5, 500, 1000, 8192


class Provider(Protocol):
    """One prompt, one answer; None where there is none. Instances are sent to executors."""

    def chat(self, prompt: str) -> str | None: ...


class Mock:
    """Answers from a mapping of prompts, else with a fixed answer (None: no answer)."""

    def __init__(self, answers: Mapping[str, str] | None = None, otherwise: str | None = None):
        self.answers, self.otherwise = dict(answers or {}), otherwise

    def chat(self, prompt: str) -> str | None:
        return self.answers.get(prompt, self.otherwise)


def prompt_budget(window: int | None, output_tokens: int = 4096, reasoning: float = 1.0) -> int:
    """Characters that a prompt may have. reasoning multiplies the tokens kept for output."""
    tokens = (window or UNKNOWN_WINDOW) - int(output_tokens * reasoning) - TEMPLATE_TOKENS
    return int(max(tokens, LEAST_TOKENS) * CHARS_PER_TOKEN)


_FENCE = re.compile(r"```(?:json)?\s*([\s\S]+?)(?:```|$)")


def repaired_json(text: str) -> str:
    """A cut-off answer with its open string, brackets and braces closed, and a last comma gone."""
    open_, inside, escaped = [], False, False
    for c in text.strip():
        if inside:
            escaped, inside = (c == "\\" and not escaped), (c != '"' or escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_ and open_[-1] == c:
            open_.pop()
    return re.sub(r",\s*$", "", text.strip() + ('"' if inside else "")) + "".join(reversed(open_))


def extract_json(text: str | None) -> Any:
    """The JSON value of an answer: the whole, what stands in a code fence, or what begins with the first brace or bracket;
    each as it is or repaired. None where there is none."""
    if not text:
        return None
    whole = text.strip()
    starts = [i for i in (whole.find("{"), whole.find("[")) if i >= 0]
    for part in (whole, *(m[1].strip() for m in [_FENCE.search(whole)] if m), *([whole[min(starts) :]] if starts else [])):
        for candidate in (part, repaired_json(part)):
            try:
                value = json.loads(candidate)
            except json.JSONDecodeError:
                continue
            if value is not None:
                return value
    return None


@F.pandas_udf(StringType())
def json_of(answers: pd.Series) -> pd.Series:
    """What extract_json finds, as JSON with ordered keys."""
    return pd.Series([None if (v := extract_json(a)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for a in answers], dtype="object")


def ask_json(provider: Provider, prompt: str, check: Callable[[Any], Any], repairs: int = 2) -> tuple[Any, int, str | None]:
    """(checked value, attempts, error). An answer that isn't JSON or fails the check is asked again with the error."""
    asked, error = prompt, None
    for attempt in range(1, repairs + 2):
        answer = provider.chat(asked)
        if answer is None:
            return None, attempt, "no answer"
        try:
            value = extract_json(answer)
            if value is None:
                raise ValueError("no JSON in it")
            return check(value), attempt, None
        except (ValueError, KeyError, TypeError) as e:
            error = f"{type(e).__name__}: {e}"
            asked = f"{prompt}\n\nThe last answer was not valid ({error}). Answer with valid JSON only."
    return None, repairs + 1, error


def chat(prompts: DataFrame, provider: Provider, check: Callable[[Any], Any] = lambda x: x, fallback: Any = None, repairs: int = 2) -> DataFrame:
    """prompts (with a column prompt) and response (JSON), attempts, error. A null prompt isn't asked. Failures take the
    fallback and keep their error; one failing row leaves the others alone."""
    schema = StructType([*prompts.schema.fields, StructField("response", StringType()), StructField("attempts", IntegerType()), StructField("error", StringType())])

    def one(prompt: str | None) -> tuple[str | None, int, str | None]:
        if prompt is None:
            return None, 0, None
        try:
            value, attempts, error = ask_json(provider, prompt, check, repairs)
        except Exception as e:  # noqa: BLE001 - a provider's failure is this row's result
            value, attempts, error = None, 1, f"{type(e).__name__}: {e}"
        value = fallback if error else value
        return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True), attempts, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(p) for p in batch["prompt"]]
            yield batch.assign(response=[f[0] for f in found], attempts=[f[1] for f in found], error=[f[2] for f in found])

    return prompts.mapInPandas(run, schema)


def secrets(settings: Mapping[str, str], production: bool) -> tuple[str, str]:
    """Secret and salt of pseudonyms. In production, missing ones and the development defaults are refused."""
    defaults = {"secret": "dev-secret", "salt": "dev-salt"}
    found = {k: settings.get(k) or v for k, v in defaults.items()}
    if production and any(found[k] == v for k, v in defaults.items()):
        raise ValueError("set a secret and a salt of your own for production")
    return found["secret"], found["salt"]
