"""Errors raised when data or a specification breaks its contract."""


class ContractError(ValueError):
    """A specification asks for something that is not registered or not present."""


class DataViolation(ValueError):
    """Rows break a rule; ``counts`` holds the number of breaking rows per rule."""

    def __init__(self, counts: dict[str, int], examples: dict[str, list[str]]):
        self.counts = counts
        self.examples = examples
        parts = [f"{name}: {n} rows, e.g. {', '.join(examples.get(name, [])) or '-'}" for name, n in counts.items()]
        super().__init__("; ".join(parts))


class GateClosed(RuntimeError):
    """An upstream check has errors, so the downstream stage must not run."""
