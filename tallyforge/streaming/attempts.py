"""Streams of answers and jobs: keyed learner state, replay guard, timers, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

STATE = "student_id long, kp_id int, question_id long, score int, peak int, errors int, streak int, status string"


def change(difficulty: int, right: bool) -> int:
    """Change of mastery in hundredths."""
    return (5 if right else -15) if difficulty <= 2 else (10 if right else -8) if difficulty == 3 else (15 if right else -3)


class Spool:
    """Rows of one key in state, by ranges of time, so that a batch of any size is put in order range by range.

    Only one range and one arriving frame are in memory at once. A range is
    cut into chunks as its rows come; names are the columns kept, the first is
    a time in microseconds, the second breaks ties.
    """

    def __init__(self, handle: StatefulProcessorHandle, names: list[str], width_us: int = 3_600_000_000):
        self.names, self.width = names, width_us
        self.rows = handle.getMapState("spool", "range long, chunk int", ", ".join(f"{n} array<long>" for n in names))
        self.sizes = handle.getMapState("spool_sizes", "range long", "chunks int")

    def put(self, frame: dict[str, np.ndarray]) -> None:
        place = frame[self.names[0]] // self.width
        order = np.argsort(place, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            if not len(own):
                continue
            at = (int(place[own[0]]),)
            chunk = self.sizes.getValue(at)[0] if self.sizes.containsKey(at) else 0
            self.rows.updateValue((*at, chunk), tuple(frame[n][own].tolist() for n in self.names))
            self.sizes.updateValue(at, (chunk + 1,))

    def in_order(self, frames: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
        """All rows of a batch's frames in order, in parts; a single frame needs no state."""
        first = next(frames, None)
        if first is None:
            return
        second = next(frames, None)
        if second is None:
            order = np.lexsort((first[self.names[1]], first[self.names[0]]))
            yield {n: first[n][order] for n in self.names}
            return
        for frame in (first, second):
            self.put(frame)
        for frame in frames:
            self.put(frame)
        yield from self.drain()

    def drain(self) -> Iterator[dict[str, np.ndarray]]:
        """The rows range by range, in order, and out of the state."""
        for at in sorted(k[0] for k in self.sizes.keys()):
            keys = [(at, c) for c in range(self.sizes.getValue((at,))[0])]
            parts = [self.rows.getValue(k) for k in keys]
            columns = [np.concatenate([np.asarray(p[j], dtype=np.int64) for p in parts]) for j in range(len(self.names))]
            order = np.lexsort((columns[1], columns[0]))
            for k in keys:
                self.rows.removeKey(k)
            self.sizes.removeKey((at,))
            yield {n: c[order] for n, c in zip(self.names, columns)}


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy(dtype="datetime64[us]").astype(np.int64)


#: Question ids in one entry of a learner's mistakes.
PAGE = 256
#: States that are handed on at once.
OUT_ROWS = 10_000


class LearnerState(StatefulProcessor):
    """Mastery by point and mistakes by question of one learner; emits the states that a batch touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a learner's points are one value and mistakes are kept by pages, so a batch costs a few calls a learner
        self.mastery = handle.getValueState("mastery", "kp_id array<int>, score array<int>, peak array<int>")
        self.mistakes = handle.getMapState("mistakes", "page long", "question_id array<long>, errors array<int>, streak array<int>")
        self.spool = Spool(handle, ["at", "attempt_id", "kp", "question", "difficulty", "right"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = {"attempt_id": "attempt_id", "kp": "primary_kp", "question": "question_id", "difficulty": "difficulty", "right": "is_correct"}
        frames = ({"at": _micros(f["answered_at"])} | {n: f[c].to_numpy().astype(np.int64) for n, c in columns.items()} for f in rows)
        # what a batch touches: as many entries as points and questions, whatever its answers
        scores: dict[int, tuple[int, int]] = {}
        points = {kp: x for kp, *x in zip(*self.mastery.get())} if self.mastery.exists() else {}
        pages: dict[int, dict[int, tuple[int, int]]] = {}
        states: dict[int, tuple[int, int, int]] = {}
        for part in self.spool.in_order(frames):
            for kp, question, difficulty, right in zip(*(part[n].tolist() for n in ("kp", "question", "difficulty", "right"))):
                if kp not in scores:
                    scores[kp] = points.get(kp, (0, 0))
                score, peak = scores[kp]
                score = max(0, min(100, score + change(difficulty, bool(right))))
                scores[kp] = (score, max(peak, score))
                if question in states:
                    _, errors, streak = states[question]
                else:
                    page = question // PAGE
                    if page not in pages:
                        pages[page] = {q: x for q, *x in zip(*self.mistakes.getValue((page,)))} if self.mistakes.containsKey((page,)) else {}
                    errors, streak = pages[page].get(question, (0, 0))
                if not right:
                    errors, streak = errors + 1, 0
                elif errors:
                    streak = min(2, streak + 1)
                states[question] = (kp, errors, streak)
        flat = lambda book: tuple([int(x) for x in c] for c in zip(*((k, *x) for k, x in book.items())))
        self.mastery.update(flat(points | scores))
        for question, (_, errors, streak) in states.items():
            if errors:
                pages[question // PAGE][question] = (errors, streak)
        for page, book in pages.items():
            if book:
                self.mistakes.updateValue((page,), flat(book))
        names = ["student_id", "kp_id", "question_id", "score", "peak", "errors", "streak", "status"]
        out = [(key[0], kp, q, *scores[kp], errors, streak, None if not errors else "resolved" if streak == 2 else "open") for q, (kp, errors, streak) in states.items()]
        for at in range(0, len(out), OUT_ROWS):
            yield pd.DataFrame(out[at : at + OUT_ROWS], columns=names)

    def close(self) -> None:
        pass


def learner_states(graded: DataFrame) -> DataFrame:
    """Updated states per batch of a stream of graded answers; needs the RocksDB state store."""
    return graded.groupBy("student_id").transformWithStateInPandas(LearnerState(), STATE, "Update", "None")


class StaleJobs(StatefulProcessor):
    """A job that is queued or running and says nothing for longer than a while fails by an event-time timer."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in rows:
            times = _micros(frame["ts"])
            k = int(times.argmax())
            if newest is None or times[k] >= newest[1]:
                newest = (frame["status"].iloc[k], int(times[k]))
        status, at = newest
        if self.last.exists() and self.last.get()[1] > at:
            # a newer event came in an earlier batch
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((str(status), at))
        if status in ("queued", "running"):
            # a timer fires when the watermark is there; a job that is quiet for just that long isn't late yet
            self.handle.registerTimer(at // 1000 + self.quiet_ms + 1)
        yield pd.DataFrame([(key[0], status)], columns=["job_id", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.update(("failed", self.last.get()[1]))
        yield pd.DataFrame([(key[0], "failed")], columns=["job_id", "status"])

    def close(self) -> None:
        pass


def reap_jobs(jobs: DataFrame, quiet: str = "10 minutes", quiet_ms: int = 600_000) -> DataFrame:
    """(job_id, status) of a stream of job events (job_id, ts, status), failing those that went quiet."""
    kind = jobs.schema["job_id"].dataType.simpleString()
    return jobs.withWatermark("ts", quiet).groupBy("job_id").transformWithStateInPandas(StaleJobs(quiet_ms), f"job_id {kind}, status string", "Update", "EventTime")


class SerialWrites(StatefulProcessor):
    """Writes of one key one after another: each gets the next number of its key, over batches and restarts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "n long")
        self.spool = Spool(handle, ["ts", "write_id"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = ({"ts": _micros(f["ts"]), "write_id": f["write_id"].to_numpy().astype(np.int64)} for f in rows)
        n = self.done.get()[0] if self.done.exists() else 0
        for part in self.spool.in_order(frames):
            ids = part["write_id"]
            yield pd.DataFrame({"key": key[0], "write_id": ids, "number": np.arange(n + 1, n + len(ids) + 1)})
            n += len(ids)
        self.done.update((n,))

    def close(self) -> None:
        pass


def serial_writes(writes: DataFrame) -> DataFrame:
    """(key, write_id, number) of a stream of writes (key, write_id, ts): a key's writes are numbered by one task a batch."""
    return writes.groupBy("key").transformWithStateInPandas(SerialWrites(), "key long, write_id long, number long", "Append", "None")


def once(submissions: DataFrame, key: str = "session_id", late: str = "1 hour") -> DataFrame:
    """Each submission once: replays inside the watermark are dropped."""
    return submissions.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def job_snapshot(events: DataFrame) -> DataFrame:
    """The latest phase and progress of each job; the aggregate of a batch or an update-mode stream."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("phase", "progress"), F.struct("ts", "event_id")).alias("s")).select("job_id", "s.phase", "s.progress")


def session_timeouts(answers: DataFrame, gap: str = "25 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by silence: a session ends when a learner pauses for the gap."""
    return answers.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "student_id").agg(F.count(F.lit(1)).alias("answers"))


def activity(answers: DataFrame, width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Answers and right answers in windows of event time."""
    return answers.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("answers"), F.count_if("is_correct").alias("right"))


#: Learners in one key of the reviews' state; a power of two.
LEARNERS = 64


class DueReviews(StatefulProcessor):
    """The reviews of a page of learners: each is due a day after the first contact or the last wrong answer.

    A page has one value of state and one timer in event time, that of its next
    review; when it fires, all reviews of the page that the watermark has passed
    are due. A wrong answer before or after puts a review off and says so.
    """

    def __init__(self, wait_ms: int, student: str, kp: str):
        self.wait_ms, self.kinds = wait_ms, (student, kp)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        student, kp = self.kinds
        # timer is null where a review has been told; ahead is the page's timer
        self.seen = handle.getValueState("seen", f"student_id array<{student}>, kp_id array<{kp}>, first array<long>, wrong array<long>, due_at array<long>, timer array<long>, ahead long")

    def _load(self) -> tuple[dict, int | None]:
        if not self.seen.exists():
            return {}, None
        student, kp, *rest, ahead = self.seen.get()
        return dict(zip(zip(student, kp), zip(*rest))), ahead

    def _keep(self, book: dict, before: int | None) -> None:
        ahead = min((timer for *_, timer in book.values() if timer is not None), default=None)
        if ahead != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if ahead is not None:
                self.handle.registerTimer(ahead)
        self.seen.update((*(list(c) for c in zip(*((*k, *x) for k, x in book.items()))), ahead))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, ahead = self._load()
        # first and last wrong answer of what a batch touches
        news: dict[tuple, tuple[int, int | None]] = {}
        for frame in rows:
            columns = (frame["student_id"].tolist(), frame["kp_id"].tolist(), _micros(frame["ts"]).tolist(), frame["is_correct"].tolist())
            for student, kp, at, right in zip(*columns):
                review = (student, kp)
                first, wrong = news.get(review) or book.get(review, (at, None))[:2]
                if not right and (wrong is None or at > wrong):
                    wrong = at
                news[review] = (min(first, at), wrong)
        said = []
        for review, (first, wrong) in news.items():
            before, timer = book[review][2:] if review in book else (None, None)
            due_at = max(first, wrong if wrong is not None else first) + 1000 * self.wait_ms
            if due_at != before:
                # timers are in whole milliseconds and fire once the watermark is there
                timer = max(-(-due_at // 1000), timerValues.getCurrentWatermarkInMs() + 1)
                said.append((*review, "waiting", due_at))
            book[review] = (first, wrong, due_at, timer)
        self._keep(book, ahead)
        yield from self._rows(said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        book, _ = self._load()
        said = []
        for review, (first, wrong, due_at, timer) in book.items():
            if timer is not None and timer <= timerValues.getCurrentWatermarkInMs():
                said.append((*review, "due", due_at))
                book[review] = (first, wrong, due_at, None)
        # the timer that fired is gone
        self._keep(book, None)
        yield from self._rows(said)

    @staticmethod
    def _rows(said: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(said), OUT_ROWS):
            yield pd.DataFrame(said[at : at + OUT_ROWS], columns=["student_id", "kp_id", "status", "due_us"])

    def close(self) -> None:
        pass


def due_reviews(answers: DataFrame, late: str = "1 hour", wait_ms: int = 86_400_000, pages: int | None = None) -> DataFrame:
    """(student_id, kp_id, status, due_us) of a stream of answers (student_id, kp_id, ts, is_correct).

    'waiting' when a review's moment is set or moves, 'due' when the event clock
    passes it. Answers later than late are left out, as the watermark says.
    Learners are dealt over pages, the keys of state, by a hash of their ids;
    about LEARNERS a page are good, and the number stays for a checkpoint.
    Without it LEARNERS neighbours share a page where ids are whole numbers
    (far-apart ids share none), and learners with other ids have one each.
    """
    kinds = [answers.schema[c].dataType.simpleString() for c in ("student_id", "kp_id")]
    whole = isinstance(answers.schema["student_id"].dataType, IntegralType)
    page = F.shiftright(F.col("student_id").cast("long"), LEARNERS.bit_length() - 1) if whole else F.xxhash64("student_id")
    page = page if pages is None else F.pmod(F.xxhash64("student_id"), F.lit(pages).cast("long"))
    keyed = answers.withWatermark("ts", late).withColumn("page", page).groupBy("page")
    return keyed.transformWithStateInPandas(DueReviews(wait_ms, *kinds), f"student_id {kinds[0]}, kp_id {kinds[1]}, status string, due_us long", "Update", "EventTime")


def due(reviews: DataFrame, now) -> DataFrame:
    return reviews.where(F.col("next_review_at") <= now)


def expired(artifacts: DataFrame, now, days: int = 30) -> DataFrame:
    return artifacts.where(F.col("created_at") < now - F.make_dt_interval(F.lit(days)))
