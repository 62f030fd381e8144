"""A repository that arrives in parts: its best files so far, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# What goes in: a row per part, per bad file, and per hit of a task.
EVENTS = (
    "job string, repo_id string, kind string, part long, parts long, section_name string, first_row long, "
    "idx long, path string, cos_sim double, error string"
)
# What comes out when a repository is done: its hits, and one row that says how it ended.
OUTCOMES = "job string, repo_id string, state string, error string, section_name string, first_row long, idx long, path string, cos_sim double"
HIT = ["section_name", "first_row", "idx", "path", "cos_sim"]


def better(hits: list[tuple], depth: int) -> list[tuple]:
    """The ``depth`` best of ``(idx, path, cos_sim)``; equal cosines by ``idx``."""
    return sorted(hits, key=lambda h: (-h[2], h[0]))[:depth]


class RepositoryJob(StatefulProcessor):
    """Counts the parts of a repository and keeps ``depth`` hits per section until all are there.

    A part that comes twice counts once. The first bad file, by name, makes the
    job a FAILURE, and so does a part missing ``patience_ms`` after the first
    one came. Either way the state goes; what arrives later is a new job.
    """

    def __init__(self, depth: int, patience_ms: int):
        self.depth, self.patience_ms = depth, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "repo_id string, parts long, error string, deadline long")
        self.parts = handle.getMapState("parts", "part long", "seen boolean")
        self.best = handle.getMapState(
            "best", "section_name string, first_row long", "idx array<long>, path array<string>, cos_sim array<double>"
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        repo_id, parts, error, deadline = self.job.get() if self.job.exists() else (None, 1, None, None)
        found: dict[tuple, list[tuple]] = {}
        for r in rows:
            if r.kind == "hit":
                found.setdefault((r.section_name, r.first_row), []).append((r.idx, r.path, r.cos_sim))
            elif r.kind == "error":
                error = r.error if error is None else min(error, r.error)
            else:
                repo_id, parts = r.repo_id, max(parts, r.parts or 1)
                self.parts.updateValue((r.part or 0,), (True,))
        for section, hits in found.items():
            if self.best.containsKey(section):
                hits += list(zip(*self.best.getValue(section)))
            self.best.updateValue(section, tuple(list(c) for c in zip(*better(hits, self.depth))))
        if sum(1 for _ in self.parts.keys()) >= parts:
            yield from self._outcome(key, repo_id, error, deadline)
            return
        if deadline is None:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(deadline)
        self.job.update((repo_id, parts, error, deadline))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.job.exists():
            return
        repo_id, parts, error, deadline = self.job.get()
        if deadline != expiredTimerInfo.getExpiryTimeInMs():
            return  # a timer of an earlier job of this repository
        seen = sum(1 for _ in self.parts.keys())
        yield from self._outcome(key, repo_id, error or f"incomplete: {seen} of {parts} parts", None)

    def _outcome(self, key: Any, repo_id: str | None, error: str | None, deadline: int | None) -> Iterator[Row]:
        state = "SUCCESS" if error is None else "FAILURE"
        out = dict(job=key[0], repo_id=repo_id, state=state, error=error)
        yield Row(**out, **dict.fromkeys(HIT))
        if error is None:
            for section, hits in self.best.iterator():
                for hit in zip(*hits):
                    yield Row(**out, **dict(zip(HIT, (*section, *hit))))
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        self.job.clear()
        self.parts.clear()
        self.best.clear()

    def close(self) -> None:
        pass
