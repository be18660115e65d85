"""A decision model behind HTTP: one POST of JSON a request, on the standard library.

Request: {"subjects": [...], "questions": [{subject, question, label, refers_to, options}]},
options by number with a reserved one for none of them (``decide.encode``). Answer:
{"answers": [{"choice", "probabilities", "confidence"} or null, in order], "usage":
{"input_tokens", "output_tokens"}}. Missing answers are no decisions; any error of the
transport or of the format is raised as ``ModelUnavailable``, which answers no question of
the request.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass

from tokoro.plans.decide import Decision, Question, Usage, decode, encode

NONE = "none"
#: Environment variables that name a model for the command line.
URL_VARIABLE, KEY_VARIABLE = "TOKORO_MODEL_URL", "TOKORO_MODEL_KEY"


class ModelUnavailable(RuntimeError):
    pass


def post(url: str, body: bytes, headers: dict, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


@dataclass(frozen=True)
class HttpModel:
    url: str
    key: str | None = None
    timeout: float = 60.0
    send: object = post

    def choose(self, questions: Sequence[Question]) -> tuple[Sequence[Decision], Usage]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            data = json.loads(self.send(self.url, json.dumps(encode(questions, NONE), ensure_ascii=False).encode(), headers, self.timeout))
            answers, usage = list(data.get("answers") or ()), data.get("usage") or {}
            decisions = [self._decision(answers[k] if k < len(answers) else None, len(q.options)) for k, q in enumerate(questions)]
            return decisions, Usage(int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0), 1)
        except Exception as error:  # noqa: BLE001
            raise ModelUnavailable(str(error)) from error

    @staticmethod
    def _decision(answer: dict | None, options: int) -> Decision:
        if answer is None:
            return Decision(None)
        return decode(answer.get("choice"), {k: float(v) for k, v in (answer.get("probabilities") or {}).items()}, float(answer.get("confidence") or 0), NONE, options)


def configured(url: str | None = None) -> HttpModel | None:
    """The model at ``url`` or the one that the environment names; None without either."""
    url = url or os.environ.get(URL_VARIABLE)
    return HttpModel(url, os.environ.get(KEY_VARIABLE)) if url else None
