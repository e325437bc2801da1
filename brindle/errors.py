"""Errors a caller can tell apart."""


class BrindleError(Exception):
    status = 500


class NotFound(BrindleError):
    status = 404


class Conflict(BrindleError):
    """A key that exists, a CAS that differs, or a path in the way."""

    status = 409


class CasMismatch(Conflict):
    pass


class Invalid(BrindleError):
    status = 400


class Expired(Conflict):
    """A transaction past its time."""
