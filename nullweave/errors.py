"""Exceptions and warnings of the package."""


class ConvergenceError(RuntimeError):
    """A solver did not reach its tolerance."""

    def __init__(self, method: str, detail: str = ""):
        super().__init__(f"method {method!r} did not converge{': ' + detail if detail else ''}")
        self.method = method


class DomainError(ValueError):
    """A constraint sequence that no graph can have."""


class StateError(ValueError):
    """A result was asked for before what it needs was computed."""


class ModelWarning(UserWarning):
    pass
