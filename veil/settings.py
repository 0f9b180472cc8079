"""Job-wide settings: the salt, the draw key and how strict to be."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from veil.errors import PolicyError


@dataclass(frozen=True)
class Settings:
    """What every table of one job shares.

    ``salt`` feeds the deterministic methods, so equal values get equal outputs
    in every column and table of the job.  ``key`` feeds the random methods; a
    fresh one is made when none is given.  Neither is shown by ``repr``.

    ``parity`` switches the lenient choices back on: nulls are digested
    as ``"nan"``, values a method cannot read stay as they are, and
    ``differential_privacy`` draws from a Gaussian.
    """

    salt: str = field(repr=False)
    key: str = field(default_factory=lambda: secrets.token_hex(32), repr=False)
    parity: bool = False
    strict: bool = True

    def __post_init__(self):
        if not isinstance(self.salt, str) or not self.salt:
            raise PolicyError("a non-empty salt is required")
        if not isinstance(self.key, str) or not self.key:
            raise PolicyError("the draw key must be a non-empty string")
