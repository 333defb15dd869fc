"""Small JSON documents of a workflow: sessions, batch plans with their execution, mapping profiles. Plain Python; nothing here is data of a survey."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from typing import Any

MAX_BYTES = 32 << 20
HISTORY = 200
STATES = ("pending", "running", "completed", "partial", "failed", "cancelled")


@dataclass
class Selection:
    kind: str = "all"
    keys: list[float] = field(default_factory=list)
    order: str = "physical"
    width: float | None = None


@dataclass
class Session:
    source: str
    mapping: dict[str, int] = field(default_factory=dict)
    selection: Selection = field(default_factory=Selection)
    version: int = 1


@dataclass
class Job:
    name: str
    session: str
    report: str
    state: str = "pending"
    error: str | None = None


@dataclass
class Plan:
    jobs: list[Job] = field(default_factory=list)
    version: int = 1

    def add(self, job: Job) -> None:
        if any(j.name.lower() == job.name.lower() for j in self.jobs):
            raise ValueError(f"there is a job {job.name!r} already")
        self.jobs.append(job)

    def remove(self, name: str) -> None:
        self.jobs = [j for j in self.jobs if j.name != name]

    def update(self, name: str, job: Job) -> None:
        """Puts a job in the place of another; its name may change, but not into that of a third."""
        at = next(k for k, j in enumerate(self.jobs) if j.name == name)
        if any(k != at and j.name.lower() == job.name.lower() for k, j in enumerate(self.jobs)):
            raise ValueError(f"there is a job {job.name!r} already")
        self.jobs[at] = job

    def move(self, name: str, to: int) -> None:
        job = next(j for j in self.jobs if j.name == name)
        self.jobs.remove(job)
        self.jobs.insert(max(0, min(to, len(self.jobs))), job)


@dataclass
class Profile:
    name: str
    mapping: dict[str, int]


@dataclass
class Profiles:
    profiles: list[Profile] = field(default_factory=list)
    version: int = 1

    def upsert(self, profile: Profile) -> None:
        self.profiles = [p for p in self.profiles if p.name.lower() != profile.name.lower()] + [profile]

    def find(self, name: str) -> Profile | None:
        return next((p for p in self.profiles if p.name.lower() == name.lower()), None)


_PARTS = {"selection": Selection, "jobs": Job, "profiles": Profile}


def _build(kind: type, value: Any):
    if not isinstance(value, dict):
        raise ValueError(f"{kind.__name__} is an object, not {type(value).__name__}")
    names = {f.name for f in fields(kind)}
    if unknown := set(value) - names:
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    part = lambda k, v: [_build(_PARTS[k], x) for x in v] if k in _PARTS and isinstance(v, list) else _build(_PARTS[k], v) if k in _PARTS else v
    return kind(**{k: part(k, v) for k, v in value.items()})


def load(kind: type, path: str):
    """A document, strictly: no unknown field, nothing behind it, at most MAX_BYTES, version 1."""
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError(f"{path} is too large")
    with open(path, encoding="utf-8") as f:
        doc = _build(kind, json.load(f))
    if getattr(doc, "version", 1) != 1:
        raise ValueError(f"{path}: version {doc.version} isn't known")
    return doc


def save(doc, path: str) -> None:
    """Writes a document in one go: readers see the old one or the new one."""
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", delete=False) as f:
        json.dump(asdict(doc), f, ensure_ascii=False, indent=1)
    os.replace(f.name, path)


def run(plan: Plan, work, go_on: bool = False, cancelled=lambda: False) -> list[dict]:
    """Runs the jobs in order. Returns their report, newest first, at most HISTORY entries.

    A failed job ends the run and leaves the rest pending, unless go_on. work may return the state
    "partial" for a job that did a part. Once cancelled() holds no job is begun: the rest are cancelled.
    """
    report, stopped = [], False
    for job in plan.jobs:
        if stopped := stopped or cancelled():
            job.state = "cancelled"
            continue
        job.state, job.error, began = "running", None, datetime.now(UTC)
        try:
            job.state = "partial" if work(job) == "partial" else "completed"
        except Exception as e:
            job.state, job.error = "failed", str(e)
        report.append({"job": job.name, "state": job.state, "error": job.error, "began": began.isoformat(), "ended": datetime.now(UTC).isoformat()})
        if job.state == "failed" and not go_on:
            break
    return report[::-1][:HISTORY]


@dataclass
class Figure:
    """What a picture was made from: its source files with their hashes, its parameters, and the hash of its pixels."""

    name: str
    sources: dict[str, str] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)
    pixels: str = ""
    version: int = 1


def publish_figure(figure: Figure, image: bytes, folder: str) -> str:
    """Writes an image and its document as one new folder, whole or not at all; returns its path. A folder of that name is an error."""
    final = os.path.join(folder, figure.name)
    if not figure.name or os.path.basename(figure.name) != figure.name or figure.name in (".", ".."):
        raise ValueError(f"{figure.name!r} isn't a plain name")
    if os.path.exists(final):
        raise FileExistsError(final)
    part = tempfile.mkdtemp(dir=folder)
    with open(os.path.join(part, "image.png"), "wb") as f:
        f.write(image)
    save(figure, os.path.join(part, "figure.json"))
    os.rename(part, final)
    return final
