"""Remote rewriting with failover over several providers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feedback import REST, TIMEOUT_REST, TIMEOUTS

#: Fixed value: attempts at one text, at most.
ATTEMPTS = 10
UNSAFE = ("overcompressed", "expanded")

#: (provider, text, again) -> (outcome, result, tokens used); outcome ok, one of UNSAFE, or an error's class.
Call = Callable[[str, str, bool], tuple[str, str | None, int]]


@dataclass
class Chain:
    """Providers in order, and what each one's outcomes so far mean for it."""

    providers: list[str]
    now: Callable[[], float] = lambda: time.time() * 1000
    rests: dict[str, float] = field(default_factory=dict)
    timeouts: dict[str, int] = field(default_factory=dict)
    out: set[str] = field(default_factory=set)

    def pick(self, skipped: Iterable[str]) -> str | None:
        now = self.now()
        for p in self.providers:
            if p not in self.out and p not in skipped and self.rests.get(p, 0) <= now:
                if self.rests.pop(p, None) is not None:
                    self.timeouts[p] = 0
                return p
        return None

    def note(self, provider: str, outcome: str) -> None:
        rest = None
        if outcome == "ok":
            self.timeouts[provider] = 0
        elif outcome == "timeout":
            self.timeouts[provider] = self.timeouts.get(provider, 0) + 1
            rest = TIMEOUT_REST if self.timeouts[provider] >= TIMEOUTS else None
        elif outcome in ("exhausted", "misconfigured"):
            self.out.add(provider)
        else:
            rest = REST.get(outcome, REST["unknown"])
        if rest:
            self.rests[provider] = self.now() + rest


def rewrite(text: str, chain: Chain, call: Call) -> dict:
    """The first usable result. An unsafe one is asked for once more, then its provider is skipped for this text. When
    none is left, or after ATTEMPTS, the text stays as it is."""
    skipped: set[str] = set()
    attempts = 0
    while attempts < ATTEMPTS and (p := chain.pick(skipped)):
        attempts += 1
        outcome, result, used = call(p, text, False)
        if outcome in UNSAFE:
            outcome, result, used = call(p, text, True)
        if outcome in UNSAFE:
            skipped.add(p)
            continue
        chain.note(p, outcome)
        if outcome == "ok":
            return {"result": result, "provider": p, "tokens_used": used, "success": True, "attempts": attempts}
    return {"result": text, "provider": "fallback", "tokens_used": 0, "success": False, "attempts": attempts}


def rewrite_remotely(docs: DataFrame, key: str, providers: list[str], call: Call, text: str = "text", now: Callable[[], float] | None = None) -> DataFrame:
    """(key, result, provider, tokens_used, success, attempts). Each task keeps the state of its own chain, so a provider
    that fails is left alone for the rest of the task; nothing is shared between executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = Chain(list(providers), **({"now": now} if now else {}))
        for b in batches:
            got = pd.DataFrame([rewrite(t, chain, call) for t in b["text"]], index=b.index, columns=["result", "provider", "tokens_used", "success", "attempts"])
            yield pd.concat([b[[key]], got], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"`{key}` {kind}, result string, provider string, tokens_used long, success boolean, attempts int")
