"""Policy of a rate-limited lookup service, as pure functions, and a client that takes its transport."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

#: Seconds and counts. Fixed values.
CONNECT_TIMEOUT, READ_TIMEOUT, MAX_RETRIES, MAX_DELAY = 5.0, 20.0, 3, 10.0


class QuotaExceededError(RuntimeError):
    """The service's daily budget is used up: the run has to end."""


@dataclass(frozen=True)
class Response:
    status: int
    body: dict = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)
    text: str = ""


def numeric_header(headers: Mapping[str, str], name: str) -> float | None:
    """A header as a number; None if it is missing or is none."""
    lowered = {k.lower(): v for k, v in headers.items()}
    try:
        return float(lowered[name.lower()])
    except (KeyError, TypeError, ValueError):
        return None


def whole_seconds(value: float | None) -> int | None:
    return None if value is None else max(0, int(value))


def backoff(attempt: int, retry_after: float | None = None, cap: float = MAX_DELAY) -> float:
    """Seconds before the next try: what the service says, else 1, 2, 4, ...; capped either way."""
    return min(cap, max(0.0, retry_after) if retry_after is not None else 2.0**attempt)


def is_daily_limit(response: Response) -> bool:
    """Whether a 429 means that the day's budget is gone."""
    remaining = numeric_header(response.headers, "X-RateLimit-Remaining")
    reset = numeric_header(response.headers, "X-RateLimit-Reset")
    said = response.text.lower()
    return "daily" in said or "insufficient budget" in said or (remaining is not None and remaining <= 0 and (reset or 0) > MAX_DELAY)


def rate_limit_summary(body: Mapping) -> dict:
    """The seven figures of a rate-limit reply, with None for what is missing."""
    limits = body.get("rate_limit") or body
    number = lambda k: float(limits[k]) if isinstance(limits.get(k), (int, float)) else None
    return {
        "daily_budget_usd": number("daily_budget_usd"), "daily_used_usd": number("daily_used_usd"), "daily_remaining_usd": number("daily_remaining_usd"),
        "prepaid_remaining_usd": number("prepaid_remaining_usd"), "resets_at": limits.get("resets_at"), "resets_in_seconds": whole_seconds(number("resets_in_seconds")),
        "endpoint_costs_usd": {str(k): float(v) for k, v in (limits.get("endpoint_costs_usd") or {}).items()},
    }


def check_budget(summary: Mapping) -> None:
    """Raise before a run that cannot pay for anything; an unknown budget passes."""
    daily, prepaid = summary.get("daily_remaining_usd"), summary.get("prepaid_remaining_usd")
    if daily is not None and daily <= 0 and (prepaid is None or prepaid <= 0):
        raise QuotaExceededError(f"the daily budget is used up; it resets at {summary.get('resets_at')}")


@dataclass
class Client:
    """Calls a transport with time limits and retries of 429; ``cache`` keeps replies for good."""

    transport: Callable[[str, tuple[float, float]], Response]
    sleep: Callable[[float], None] = time.sleep
    cache: dict[str, Response] = field(default_factory=dict)

    def get(self, url: str) -> Response:
        if url in self.cache:
            return self.cache[url]
        for attempt in range(MAX_RETRIES + 1):
            reply = self.transport(url, (CONNECT_TIMEOUT, READ_TIMEOUT))
            if reply.status != 429:
                if reply.status == 200:
                    self.cache[url] = reply
                return reply
            if is_daily_limit(reply):
                raise QuotaExceededError("the daily limit is reached")
            if attempt < MAX_RETRIES:
                self.sleep(backoff(attempt, numeric_header(reply.headers, "Retry-After")))
        return reply
