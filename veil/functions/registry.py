"""The methods a policy can name, their options and how they behave."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from veil.errors import PolicyError
from veil.functions import contact, dates, numeric, substitution, text
from veil.functions.keyed import ALGORITHMS

ROW, CROSS, DROP = "row", "cross-row", "drop"

_ON_ERROR = {"on_error": None, "nulls": None, "scale": None}
_TEXT = {"nulls": None, "scale": None}


@dataclass(frozen=True)
class Method:
    """One method: ``write`` turns a column into its anonymized expression."""

    name: str
    kind: str
    options: dict = field(default_factory=dict)
    write: Callable | None = None
    deterministic: bool = True
    check: Callable[[dict], None] = lambda options: None

    @property
    def streaming(self) -> bool:
        return self.kind != CROSS

    def complete(self, given: dict, strict: bool) -> dict:
        """The given options on top of the defaults, checked."""
        unknown = sorted(set(given) - set(self.options))
        if unknown and strict:
            raise PolicyError(f"{self.name}: unknown options {unknown}")
        merged = {**self.options, **{k: v for k, v in given.items() if k in self.options}}
        for name, allowed in (("on_error", ("keep", "redact")), ("nulls", ("keep", "literal"))):
            if merged.get(name) is not None and merged[name] not in allowed:
                raise PolicyError(f"{self.name}: {name} must be one of {list(allowed)}")
        self.check(merged)
        return merged


def _one_of(name: str, allowed) -> Callable[[dict], None]:
    def check(options):
        if options[name] not in allowed:
            raise PolicyError(f"{name} must be one of {[a for a in allowed if a]}, not {options[name]!r}")

    return check


def _whole(name: str, low: int, high: int = 2**62) -> Callable[[dict], None]:
    def check(options):
        value = options[name]
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise PolicyError(f"{name} must be a whole number from {low}, not {value!r}")

    return check


def _positive(*names: str) -> Callable[[dict], None]:
    def check(options):
        for name in names:
            value = options[name]
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if not number or not 0 < value < float("inf"):
                raise PolicyError(f"{name} must be a positive number, not {value!r}")

    return check


def _noise(options: dict) -> None:
    _positive("epsilon", "sensitivity")(options)
    _one_of("mechanism", (None, "laplace", "gaussian"))(options)


def _perturb(options: dict) -> None:
    for name in ("range", "percentage"):
        value = options[name]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        default = name == "range" and value is None
        if not default and not (number and 0 <= value < float("inf")):
            raise PolicyError(f"{name} must be a number from 0, not {value!r}")


def _substitute(options: dict) -> None:
    if options["list"] is not None and not isinstance(options["list"], (list, tuple)):
        raise PolicyError("list must be a list of replacements")


def _mask(options: dict) -> None:
    if not isinstance(options["mask_char"], str) or not options["mask_char"]:
        raise PolicyError("mask_char must be a non-empty string")


_METHODS: dict[str, Method] = {
    m.name: m
    for m in [
        Method("hash", ROW, {"algorithm": "sha256", **_TEXT}, text.hashed,
               check=_one_of("algorithm", ALGORITHMS)),
        Method("mask", ROW, {"mask_char": "*", "preserve_length": True, **_TEXT}, text.masked, check=_mask),
        Method("pseudonymize", ROW, {"prefix": "ID", "length": 8, **_TEXT}, text.pseudonym,
               check=_whole("length", 1, 64)),
        Method("substitute", ROW, {"list": None, "type": "generic", "consistent": False, **_TEXT},
               substitution.substituted, deterministic=False, check=_substitute),
        Method("shuffle", CROSS, deterministic=False),
        Method("perturb", ROW, {"type": "uniform", "range": None, "percentage": 10, "non_negative": False},
               numeric.perturbed, deterministic=False, check=_perturb),
        Method("generalize_numeric", ROW, {"bin_size": 10, **_ON_ERROR}, numeric.binned,
               check=_whole("bin_size", 1)),
        Method("generalize_date", ROW, {"granularity": "month", **_ON_ERROR}, dates.period,
               check=_one_of("granularity", dates.GRANULARITIES)),
        Method("anonymize_email", ROW, {"bare_domain": None, **_ON_ERROR}, contact.email),
        Method("anonymize_phone", ROW, {"normalize": False, "short": None, **_TEXT}, contact.phone),
        Method("anonymize_ssn", ROW, dict(_TEXT), contact.ssn),
        Method("k_anonymity", CROSS, {"k": 5, "scale": None}, check=_whole("k", 1)),
        Method("differential_privacy", ROW, {"epsilon": 1.0, "sensitivity": 1.0, "mechanism": None},
               numeric.noisy, deterministic=False, check=_noise),
        Method("remove", DROP),
    ]
}
FALLBACK = "hash"


def normal_name(name: str) -> str:
    """``K-Anonymity`` and ``k anonymity`` both mean ``k_anonymity``."""
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def find(name: str) -> Method | None:
    return _METHODS.get(normal_name(name))


def all_methods() -> list[Method]:
    return list(_METHODS.values())


def register_method(name: str, write: Callable, options: dict | None = None, deterministic: bool = True) -> None:
    """Add a row method ``write(build, column_name, column, type, options) -> Column``."""
    key = normal_name(name)
    if key in _METHODS:
        raise PolicyError(f"method {key} exists")
    _METHODS[key] = Method(key, ROW, dict(options or {}), write, deterministic)
