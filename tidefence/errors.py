"""Errors that callers can tell apart."""


class ModelError(ValueError):
    """A model or an input breaks a rule."""


class ModelSyntaxError(ModelError):
    """Text that is not a model; says where."""


class GeometryError(ModelError):
    """A geometry that is not valid, or geometries that do not go together."""
