"""When a failed model call is tried again: hints of the answer, else doubling waits; bounded calls at once."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

_SAID = re.compile(r"retry after\s+([\d.]+)\s*(?:seconds?|s)?", re.IGNORECASE)


def sleep_ms(ms: int) -> None:
    time.sleep(ms / 1000)


def no_wait(ms: int) -> None:
    """For clients that need no rest; what would have been waited is counted all the same."""


@dataclass(frozen=True)
class Schedule:
    """retries after the first try; waits without a hint; calls at once in a task; the clock (seconds) and the sleep (ms)."""

    retries: int = 2
    first_ms: int = 10_000
    most_ms: int = 60_000
    at_once: int = 4
    clock: Callable[[], float] = time.time
    sleep: Callable[[int], None] = sleep_ms


def header_ms(value: object, now: float) -> int | None:
    """Milliseconds of a Retry-After header: seconds, or the time up to an HTTP date."""
    if value is None or str(value).strip() == "":
        return None
    try:
        seconds = float(str(value))
    except ValueError:
        try:
            return max(0, round((parsedate_to_datetime(str(value)).timestamp() - now) * 1000))
        except ValueError:
            return None
    return math.ceil(seconds * 1000) if math.isfinite(seconds) and seconds >= 0 else None


def detail_ms(answer: dict) -> int | None:
    """Milliseconds of 'retry after N' in what an answer says, in whole seconds upwards."""
    raw = answer.get("raw") if isinstance(answer.get("raw"), dict) else {}
    error = raw.get("error") if isinstance(raw.get("error"), dict) else {}
    said = [raw.get("detail"), raw.get("message"), error.get("message"), answer.get("error_message"), answer.get("text")]
    hit = _SAID.search("\n".join(str(x) for x in said if x is not None))
    try:
        return math.ceil(float(hit[1])) * 1000 if hit else None
    except ValueError:
        return None


def wait_before(answer: dict, attempt: int, schedule: Schedule) -> tuple[int, str]:
    """(milliseconds, why) to wait after failed try number attempt, from 0."""
    headers = {str(k).lower(): v for k, v in (answer.get("headers") or {}).items()}
    ms = header_ms(headers.get("retry-after"), schedule.clock())
    if ms is not None:
        return ms, "retry_after_header"
    ms = detail_ms(answer)
    if ms is not None:
        return ms, "response_detail"
    return min(schedule.first_ms * 2**attempt, schedule.most_ms), "backoff"


def may_retry(answer: dict) -> bool:
    status = answer.get("http_status")
    return not answer.get("ok") and (status is None or status == 429 or status >= 500)


def tried(client: Callable[[str], dict], prompt: str, schedule: Schedule) -> dict:
    """The last answer of the client, with tries and waited_ms; an exception is a failed answer without a status."""
    waited = 0
    for attempt in range(schedule.retries + 1):
        try:
            answer = client(prompt)
        except Exception as e:  # noqa: BLE001  whatever a client raises is its answer
            answer = {"ok": False, "http_status": None, "text": "", "error_message": str(e)}
        if not may_retry(answer) or attempt == schedule.retries:
            break
        ms, _ = wait_before(answer, attempt, schedule)
        if ms > 0:
            schedule.sleep(ms)
        waited += ms
    return {**answer, "tries": attempt + 1, "waited_ms": waited}


def all_tried(client: Callable[[str], dict], prompts: Iterable[str], schedule: Schedule) -> Iterator[dict]:
    """Answers in the order of the prompts, at most at_once of them under way."""
    with ThreadPoolExecutor(max_workers=max(1, schedule.at_once)) as pool:
        yield from pool.map(lambda p: tried(client, p, schedule), prompts)
