"""Reply generation through a provider: strategies, validation, checkpoint and resume, estimates and costs.

A provider is a picklable function from a prompt to a response text, or to
(text, tokens in, tokens out) where the service tells them; they are estimated
by characters where not. Retries
and backoff happen around each call; a failed call gives an empty reply with
its error, is recorded as such, and can be asked for again. Results must be
written before anything else reads them, as a plan that runs twice calls twice;
sessions for live providers set spark.task.maxFailures=1 and no speculation.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prompts import Templates

STRATEGIES = ("dg", "sag", "sagii")
EFFORTS = ("minimal", "low", "medium", "high")
#: Of the workload estimate: characters of a token, tokens of the guidelines, tokens of a reply.
CHARS_A_TOKEN, GUIDE_TOKENS, REPLY_TOKENS = 4, 200, 80


@dataclass(frozen=True)
class Provider:
    name: str
    model_id: str
    price_in: float  # USD a million tokens
    price_out: float
    reasoning_effort: str | None = None


#: The study's models and their prices.
PROVIDERS = {p.name: p for p in (Provider("gemini", "gemini-2.5-pro", 1.25, 10.0), Provider("openai", "gpt-5", 1.25, 15.0), Provider("grok", "x-ai/grok-4.6", 1.5, 5.0))}


def registry(model_ids: list[str] = (), efforts: list[str] = (), base: dict[str, Provider] = PROVIDERS) -> dict[str, Provider]:
    """The providers with NAME=ID and NAME=LEVEL overrides applied."""
    out = dict(base)
    for given, name in ((model_ids, "model_id"), (efforts, "reasoning_effort")):
        for text in given:
            key, sep, value = text.partition("=")
            if not sep or key not in out or not value or (name == "reasoning_effort" and value not in EFFORTS):
                raise ValueError(f"not a valid override: {text}")
            out[key] = replace(out[key], **{name: value})
    return out


def chosen(text: str, known) -> list[str]:
    """Names of a comma-separated list, all of which must be known."""
    names = [t.strip() for t in text.split(",") if t.strip()]
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return names


def fake_provider(prompt: str, n: int, role: str) -> str:
    """Deterministic replies that depend on the prompt's length only."""
    return json.dumps({"comments": [{"body": f"Reply {i + 1} to a prompt of {len(prompt)} characters.", "author_type": role} for i in range(n)]})


def validated(response: str, n: int | None, default_role: str = "clinician") -> list[dict[str, str]]:
    """Replies of an answer: {"comments": [...]} or a list; other items are skipped, null fields are empty, more than n are cut."""
    data = json.loads(response)
    items = data.get("comments") if isinstance(data, dict) else data
    if not isinstance(items, list):
        raise ValueError("no list of comments")
    text = lambda x: "" if x is None else str(x)
    out = [{"body": text(i.get("body", "")), "author_type": text(i.get("author_type", default_role))} for i in items if isinstance(i, dict)]
    return out if n is None else out[:n]


class Usage:
    """Tokens of a thread's calls, which may run side by side."""

    def __init__(self):
        self._lock, self.sent, self.got = Lock(), 0, 0

    def add(self, sent: int, got: int) -> None:
        with self._lock:
            self.sent, self.got = self.sent + sent, self.got + got


@dataclass(frozen=True)
class Calls:
    """How calls are made. truncate: replies beyond the number asked for are cut."""

    provider: Callable[[str, int, str], str] = fake_provider
    tries: int = 5
    wait: Callable[[int], float] = field(default=lambda a: min(2.0**a, 30.0) + random.random())
    concurrency: int = 10
    default_role: str = "clinician"
    truncate: bool = True
    templates: Templates = Templates()

    def call(self, prompt: str, n: int, role: str, used: Usage | None = None) -> tuple[list[dict[str, str]], str | None]:
        error = None
        for attempt in range(self.tries):
            try:
                if used is not None and not attempt:
                    used.add(len(prompt) // CHARS_A_TOKEN, 0)
                answer = self.provider(prompt, n, role)
                if isinstance(answer, tuple):
                    answer, sent, got = answer
                    sent -= len(prompt) // CHARS_A_TOKEN
                else:
                    sent, got = 0, None
                if used is not None:
                    used.add(sent, len(answer) // CHARS_A_TOKEN if got is None else got)
                return validated(answer, n if self.truncate else None, self.default_role), None
            except Exception as e:  # noqa: BLE001  a provider can fail in any way
                error = f"{type(e).__name__}: {e}"[:500]
                if attempt + 1 < self.tries:
                    time.sleep(self.wait(attempt))
        return [], error


def _fill(template: str, values: dict[str, object]) -> str:
    """Each {name} replaced in one pass: what a value holds is not filled in again."""
    return re.sub("|".join(re.escape("{" + n + "}") for n in values), lambda m: str(values[m[0][1:-1]]), template)


def _thread(row, strategy: str, calls: Calls, pool: ThreadPoolExecutor, used: Usage) -> tuple[list[dict[str, str]], list[str]]:
    n = int(row.n_comments)
    roles = list(row.roles) if row.roles is not None and len(row.roles) == n else [calls.default_role] * n
    post = {"title": row.title or "", "body": row.selftext or ""}
    if strategy == "dg":
        replies, error = calls.call(_fill(calls.templates.thread, post | {"n": n, "mix": row.mix or "all by clinicians"}), n, calls.default_role, used)
        return replies, [error] if error else []
    if strategy == "sag":
        prompts = [_fill(calls.templates.single, post | {"role": r}) for r in roles]
        got = list(pool.map(lambda x: calls.call(x[0], 1, x[1], used), zip(prompts, roles, strict=True)))
    else:  # each reply sees those before it
        got, prior = [], []
        for role in roles:
            said = "".join(f"Comment {i + 1}: {c}\n\n" for i, c in enumerate(prior))
            got.append(calls.call(_fill(calls.templates.incremental, post | {"role": role, "prior": said}), 1, role, used))
            prior.append(got[-1][0][0]["body"] if got[-1][0] else "")
    replies = [r[0] if r else {"body": "", "author_type": role} for (r, _), role in zip(got, roles, strict=True)]
    return replies, [e for _, e in got if e]


FIELDS = {
    "submission_id": "string", "model": "string", "model_id": "string", "strategy": "string", "n_comments": "bigint", "comments": "array<struct<body: string, author_type: string>>",
    "calls": "bigint", "failures": "bigint", "status": "string", "error": "string", "tokens_in": "bigint", "tokens_out": "bigint",
}
GENERATED = ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def generate(threads: DataFrame, provider: Provider, strategy: str, calls: Calls = Calls(), partitions: int | None = None, in_flight: int | None = None) -> DataFrame:
    """One row for each thread (id, title, selftext, n_comments; optional roles, mix) with its replies.

    dg asks once for all replies and may get fewer; sag asks for each on its
    own; sagii asks in order, showing the replies before. Threads of one
    partition run side by side, up to ``calls.concurrency`` calls at once. A
    thread that fails as a whole has status "failed" and its error.
    ``in_flight`` bounds the calls of the whole run: the threads are dealt into
    that many partitions at most, and their pools share the number.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    rows = threads.select(
        F.col("id"), F.col("title"), F.col("selftext"), F.col("n_comments").cast("bigint").alias("n_comments"),
        (F.col("roles") if "roles" in threads.columns else F.lit(None).cast("array<string>")).alias("roles"), (F.col("mix") if "mix" in threads.columns else F.lit(None).cast("string")).alias("mix"),
    )
    if in_flight:
        partitions = max(1, min(partitions or in_flight, in_flight))
        calls = replace(calls, concurrency=max(1, in_flight // partitions))
    if partitions:
        rows = rows.repartition(partitions)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls.concurrency) as pool, ThreadPoolExecutor(calls.concurrency) as threads_pool:
            for frame in frames:
                made = threads_pool.map(partial(_record, provider=provider, strategy=strategy, calls=calls, pool=pool), frame.itertuples(index=False))
                yield pd.DataFrame(list(made), columns=list(FIELDS))

    return rows.mapInPandas(run, GENERATED)


def _record(row, provider: Provider, strategy: str, calls: Calls, pool: ThreadPoolExecutor):
    n = int(row.n_comments)
    asked, used = 1 if strategy == "dg" else n, Usage()
    try:
        replies, errors = _thread(row, strategy, calls, pool, used)
        status, error = ("partial" if errors and len(errors) < asked else "failed" if errors else "done"), (errors[0] if errors else None)
    except Exception as e:  # noqa: BLE001  one thread must not end the others
        replies, errors, status, error = [], [str(e)], "failed", f"{type(e).__name__}: {e}"[:500]
    return row.id, provider.name, provider.model_id, strategy, n, replies, asked, len(errors), status, error, used.sent, used.got


def ratio_arms(threads: DataFrame, arms: dict[str, str], calls: Calls = Calls(tries=3, default_role="unknown", truncate=False)) -> DataFrame:
    """One call for each thread and mixture of roles: submission_id, n_top_level_comments and a column of replies for each."""

    def run(frames):
        for frame in frames:
            out = {"submission_id": frame["id"], "n_top_level_comments": frame["n_comments"]}
            for name, mix in arms.items():
                out[name] = [calls.call(_fill(calls.templates.thread, {"title": r.title or "", "body": r.selftext or "", "n": int(r.n_comments), "mix": mix}), int(r.n_comments), calls.default_role)[0] for r in frame.itertuples(index=False)]
            yield pd.DataFrame(out)

    schema = "submission_id string, n_top_level_comments bigint, " + ", ".join(f"{a} array<struct<body: string, author_type: string>>" for a in arms)
    return threads.select("id", "title", "selftext", F.col("n_comments").cast("bigint").alias("n_comments")).mapInPandas(run, schema)


def remaining(threads: DataFrame, done: DataFrame, model: str | None = None, strategy: str | None = None, retry_failed: bool = False) -> DataFrame:
    """Threads without a checkpoint; with ``retry_failed`` also those whose call failed."""
    finished = done
    if model is not None:
        finished = finished.where((F.col("model") == model) & (F.col("strategy") == strategy))
    if retry_failed:
        finished = finished.where("status <> 'failed'")
    return threads.join(finished.select(F.col("submission_id").alias("id")).distinct(), "id", "left_anti")


def workload(threads: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Calls and tokens of each strategy for one model, from title, selftext and n_comments."""
    n = F.col("n_comments").cast("double")
    base = (F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("selftext", F.lit("")))) / CHARS_A_TOKEN + GUIDE_TOKENS
    sent = {"dg": base, "sag": base * n, "sagii": base * n + REPLY_TOKENS * n * (n - 1) / 2}
    asked = {"dg": F.lit(1), "sag": F.col("n_comments"), "sagii": F.col("n_comments")}
    rows = threads.select("n_comments", F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), asked[s].cast("bigint").alias("calls"), sent[s].alias("tokens_in"), (REPLY_TOKENS * n).alias("tokens_out")) for s in strategies))).alias("x"))
    return rows.groupBy("x.strategy").agg(F.count("*").alias("threads"), F.sum("x.calls").alias("calls"), F.sum("x.tokens_in").alias("tokens_in"), F.sum("x.tokens_out").alias("tokens_out"))


def usage(log: DataFrame) -> DataFrame:
    """Per model: calls, failures and tokens of a call log (model, failed, tokens_in, tokens_out)."""
    return log.groupBy("model").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def usage_of(generated: DataFrame) -> DataFrame:
    """Per model: calls, failures and tokens that generated sets recorded."""
    return generated.groupBy("model").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "failures", "tokens_in", "tokens_out")))


def price_table(spark, providers: dict[str, Provider] = PROVIDERS) -> DataFrame:
    return spark.createDataFrame([(p.name, p.price_in, p.price_out) for p in providers.values()], "model string, price_in double, price_out double")


def cost(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each model's tokens_in and tokens_out, and of all in a row TOTAL."""
    priced = tokens.join(prices, "model").withColumn("cost", F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out"))
    return priced.rollup("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost")).withColumn("model", F.coalesce("model", F.lit("TOTAL")))
