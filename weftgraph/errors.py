"""Errors of the store."""


class GraphError(Exception):
    """Any error of the store."""


class FormatError(GraphError, ValueError):
    """A record breaks a limit: an empty url, a label too long, too many segments."""


class LockedError(GraphError):
    """Another handle has the store open for writing."""


class BusyError(GraphError):
    """The store can't take a further generation just now."""


class CorruptError(GraphError):
    """Stored tables contradict each other or the manifest."""


class ReadOnlyError(GraphError):
    """A write on a read-only handle."""


class StoreIOError(GraphError, OSError):
    """The folder can't be read or written."""
