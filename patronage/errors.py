"""The one error type the library raises for unusable input."""

from __future__ import annotations


class InputProblem(ValueError):
    """Unusable input, said in plain words, with an optional hint."""

    def __init__(self, problem: str, hint: str | None = None):
        self.problem = problem
        self.hint = hint
        super().__init__(f"{problem} {hint}" if hint else problem)
