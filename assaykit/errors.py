"""Errors that callers may want to tell apart."""

from __future__ import annotations


class AssayError(Exception):
    """Base of this package's errors; some are also of the built-in kind that fits."""


class CalibrationMissing(AssayError, LookupError):
    """No calibrated threshold under a strict policy."""


class BaselineError(AssayError, ValueError):
    """A baseline that can't be used, with the reason: unreadable, several, not_object, future or empty."""


class JudgeUnavailable(AssayError):
    """A judge that gave no usable reply to a call that has no other outcome."""


class ProvenanceError(AssayError, ValueError):
    """A stamp or target that can't be read."""


class EvidenceError(AssayError, ValueError):
    """A package of evidence that can't be written or doesn't hold what it was sealed with."""


class GateFailure(AssayError, SystemExit):
    """A report that misses its thresholds; uncaught, it ends the process with code 1."""

    def __init__(self, said: str):
        SystemExit.__init__(self, 1)
        self.said = said

    def __str__(self) -> str:
        return self.said
