"""Errors that the engine raises."""


class LineageError(Exception):
    """Base of all errors here."""


class ValidationError(LineageError):
    """An argument, entity or event breaks a rule."""


class NodeNotFound(LineageError):
    """A named node is not in the graph."""


class EdgeNotFound(LineageError):
    """A named edge is not in the graph."""


class NodeExists(LineageError):
    """A node of that id is there already."""


class EdgeExists(LineageError):
    """An edge of that id or key is there already."""


class SubgraphTooLarge(LineageError):
    """A dense matrix of more nodes than the limit was asked for."""


class QueryTimeout(LineageError):
    """A query took longer than its limit."""


class Conflict(LineageError):
    """Another writer came first."""


class DamagedLog(LineageError):
    """A file of the log is not as its commit says."""
