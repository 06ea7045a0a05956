"""The two kinds of errors: what the caller has to change, and what went wrong within.

Both stay the built-in errors that they were, so code that catches those goes on working.
"""

from __future__ import annotations


class InvalidArgument(ValueError):
    """The request can't be met as it is; the same request fails again."""


class NotFound(InvalidArgument, LookupError):
    """The request names something that isn't there."""


class Internal(RuntimeError):
    """The request was right; a later attempt may succeed."""


class WrongAnswer(Internal, ValueError):
    """A model gave something else than one vector of its dimension for each text."""


class Conflict(Internal):
    """Another run is writing the same thing."""
