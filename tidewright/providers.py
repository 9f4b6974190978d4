"""Model providers as a plug-in: batches go through mapInPandas, failures become rows, and results resume."""

from __future__ import annotations

import json
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .session import workers_import


class ProviderUnavailable(RuntimeError):
    """The provider can't answer."""


class Provider(ABC):
    """Something that answers prompts; it must be picklable, as it runs in the workers."""

    name = "provider"

    @abstractmethod
    def generate(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise ProviderUnavailable("no embeddings")


class EchoProvider(Provider):
    """A deterministic stand-in: answers are the prompts as JSON, vectors are counts of hashed words."""

    name = "echo"

    def generate(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"reply": p}) for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * 16
            for w in (t or "").lower().split():
                v[sum(map(ord, w)) % 16] += 1.0
            out.append(v)
        return out


def generate(df: DataFrame, key: str, prompt: str, provider: Provider, batch: int = 32, tries: int = 3, pause: float = 0.0) -> DataFrame:
    """(key, answer, error, seconds): one row a prompt; after `tries` failures of a batch its rows carry the error."""
    workers_import(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                b = pdf.iloc[a : a + batch]
                began, answers, error = time.perf_counter(), [None] * len(b), None
                for t in range(tries):
                    try:
                        answers, error = provider.generate(b[prompt].tolist()), None
                        break
                    except (ProviderUnavailable, OSError) as e:
                        error = str(e)[:500]
                        time.sleep(pause * 2**t)
                yield pd.DataFrame({key: b[key].to_numpy(), "answer": answers, "error": error, "seconds": (time.perf_counter() - began) / len(b)})

    kind = dict(df.dtypes)[key]
    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, answer string, error string, seconds double")


def embed(df: DataFrame, key: str, text: str, provider: Provider, batch: int = 64, floor: float = 1e-12) -> DataFrame:
    """(key, v) with vectors of length 1."""
    workers_import(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                b = pdf.iloc[a : a + batch]
                vs = []
                for v in provider.embed(b[text].fillna("").tolist()):
                    n = max(sum(x * x for x in v) ** 0.5, floor)
                    vs.append([x / n for x in v])
                yield pd.DataFrame({key: b[key].to_numpy(), "v": vs})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, v array<double>")


def parse_object(text: str | None) -> dict | None:
    """A JSON object from a model's answer: fences and words around it are cut, up to four open brackets closed.

    Null for anything else: an open string, brackets that don't match, or a value that isn't an object.
    """
    if not text or "{" not in text:
        return None
    t = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    t = t[t.index("{") :]
    stack, inside, escaped, end = [], False, False, None
    for i, ch in enumerate(t):
        if inside:
            inside = escaped or ch != '"'
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack or stack.pop() != ch:
                return None
            if not stack:
                end = i + 1
                break
    if inside or len(stack) > 4:
        return None
    try:
        out = json.loads(t[:end] if end else t.rstrip().rstrip(",") + "".join(reversed(stack)))
    except ValueError:
        return None
    return out if isinstance(out, dict) else None
