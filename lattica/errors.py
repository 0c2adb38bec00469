"""Errors of the graph engine."""


class GraphError(Exception):
    """Any error of this engine."""


class SchemaError(GraphError):
    """A column is missing or has a type that can't be used."""


class CapacityError(GraphError):
    """An id is negative or beyond 32 bits."""


class BulkLoadError(GraphError):
    """A bulk load can't go on."""


class NotFoundError(GraphError):
    """A label, relationship type, property or relationship that should be there is not."""


class RelationshipNotFound(NotFoundError):
    """No relationship joins the given nodes by the given type."""
