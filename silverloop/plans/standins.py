"""Rule models for tests and registered queries, where no model runtime exists.

Each reply depends only on the length of the prompt, so SQL can state the same.
"""

from __future__ import annotations

from silverloop.operators.inference import Generate


def kv_model() -> Generate:
    """Key-value replies; one prompt in five gets an unusable one."""

    def reply(prompt: str) -> str:
        n = len(prompt)
        if n % 5 == 0:
            return f"I cannot decide, {n} characters."
        level = ["LOW", "medium", "High"][n % 3]
        return f"label: {n % 2}\nconfidence: {level}\nrationale: the prompt has {n} characters"

    return lambda prompts: [p + "\n" + reply(p) + "\n" for p in prompts]


def json_model() -> Generate:
    """JSON replies: clean, braces missing, label only, and no label."""

    def reply(prompt: str) -> str:
        n = len(prompt)
        label = n // 4 % 2
        return [
            f'Answer: {{"label": {label}, "rationale": "n={n}"}}',
            f'"label": {label}, "rationale": "n={n}"',
            f"the label is {label} I think",
            "no idea",
        ][n % 4]

    return lambda prompts: [p + reply(p) for p in prompts]


def argument_model(side: str):
    """A factory of models that argue one side."""

    def make() -> Generate:
        return lambda prompts: [f"{p} {side} sees {len(p)} characters. " for p in prompts]

    return make


def judge_model() -> Generate:
    """Verdicts: clean, braces missing, invalid label, nothing."""

    def reply(prompt: str) -> str:
        n = len(prompt)
        label = n // 4 % 2
        return [
            f'{{"label": {label}, "confidence": "high", "rationale": "n={n}"}}',
            f'"label": {label}, "confidence": "medium"',
            f'{{"label": 2, "confidence": "medium", "rationale": "n={n}"}}',
            f"no verdict for {n}",
        ][n % 4]

    return lambda prompts: [p + reply(p) for p in prompts]
