"""What can go wrong while changes are carried over."""

from __future__ import annotations


class ChangeError(Exception):
    pass


class ForeignKeyError(ChangeError):
    """Rows whose parents aren't there."""


class DeferredChangesError(ChangeError):
    """Changes that still lack parents after the last pass."""

    def __init__(self, count: int, passes: int):
        super().__init__(f"{count} changes still lack their parents after {passes} passes")
        self.count, self.passes = count, passes


class FullResyncRequired(ChangeError):
    """A client asks for changes from before the oldest that is kept."""

    def __init__(self, client_version: int, oldest: int):
        super().__init__(f"client is at version {client_version}, the oldest kept is {oldest}")
        self.client_version, self.oldest = client_version, oldest


class HashMismatch(ChangeError):
    def __init__(self, expected: str, found: str):
        super().__init__(f"expected hash {expected}, found {found}")
        self.expected, self.found = expected, found


class DatabaseError(ChangeError):
    pass


class UnresolvedConflict(ChangeError):
    pass
