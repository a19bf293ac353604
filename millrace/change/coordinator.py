"""Pull, push and both, batch by batch, with a cursor that only moves when a batch is done."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.change import mapping, tracking
from millrace.change.config import MappingConfig
from millrace.change.log import Batch, batches, without_echo


@dataclass
class Session:
    """What a replica remembers: its origin, its cursors, and whether capture is suppressed just now."""

    origin: str
    pulled: int = 0
    pushed: int = 0
    suppressed: bool = False

    @contextmanager
    def suppression(self):
        """While remote changes are applied, capture must not log them again."""
        self.suppressed = True
        try:
            yield
        finally:
            self.suppressed = False


@dataclass
class Outcome:
    batches: int = 0
    changes: int = 0
    to_version: int = 0
    hashes: list[str] = field(default_factory=list)


def pull(session: Session, remote: DataFrame, apply: Callable[[Batch], None], size: int = 1000) -> Outcome:
    """Applies remote changes after the cursor; the cursor moves with every batch that apply() has taken."""
    out = Outcome(to_version=session.pulled)
    with session.suppression():
        for batch in batches(remote, session.pulled, size):
            apply(batch)
            session.pulled = out.to_version = batch.to_version
            out.batches, out.changes = out.batches + 1, out.changes + batch.changes.count()
            out.hashes.append(batch.hash)
    return out


def push(session: Session, local: DataFrame, send: Callable[[Batch], None], size: int = 1000) -> Outcome:
    """Sends the replica's own changes after the cursor."""
    out = Outcome(to_version=session.pushed)
    own = local.where(local["origin"] == session.origin)
    for batch in batches(own, session.pushed, size):
        send(batch)
        session.pushed = out.to_version = batch.to_version
        out.batches, out.changes = out.batches + 1, out.changes + batch.changes.count()
        out.hashes.append(batch.hash)
    return out


def sync(session: Session, remote: DataFrame, local: DataFrame, apply: Callable[[Batch], None], send: Callable[[Batch], None], size: int = 1000) -> tuple[Outcome, Outcome]:
    """Pull, then push."""
    return pull(session, remote, apply, size), push(session, local, send, size)


@dataclass
class Mapped:
    """Mapped changes to carry over, and what is to be remembered once they are."""

    changes: DataFrame
    state: DataFrame
    hashes: DataFrame


def carry(log: DataFrame, config: MappingConfig, direction: str, origin: str, state: DataFrame, hashes: DataFrame, now: str) -> Mapped:
    """Pull or push with mapping and tracking: echoes go, mappings apply, tracking drops what was carried over before."""
    mine = without_echo(log, origin) if direction == "pull" else log.where(log["origin"] == origin)
    todo = tracking.pending(mapping.apply(mine, config, direction), config, state, hashes)
    return Mapped(todo, tracking.advance(state, todo, now), tracking.remember(hashes, todo, now))
