"""Pieces of the comparison SQL: digests, draws and noise written out by hand."""

SALT = "pepper-7"
KEY = "draw-key-7"
REDACTED = "'[REDACTED]'"


def digest(x: str) -> str:
    return f"sha256(({x}) || '{SALT}')"


def draw(tag: str, *keys: str) -> str:
    parts = ", ".join(f"cast({k} AS VARCHAR)" for k in keys)
    return f"sha256(concat_ws('|', '{KEY}', '{tag}', {parts}))"


def uniform_of(hexes: str, nth: int = 0) -> str:
    return f"((('0x' || substr({hexes}, {1 + 13 * nth}, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


def u(tag: str, *keys: str, nth: int = 0) -> str:
    return f"({uniform_of(draw(tag, *keys), nth)})"


def laplace(u_: str, scale: float) -> str:
    return (
        f"(CASE WHEN {u_} < 0.5 THEN {scale}::DOUBLE * ln(2 * {u_})"
        f" ELSE -{scale}::DOUBLE * ln(2 * (1 - {u_})) END)"
    )


def gaussian(tag: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({u(tag, *keys)})) * cos(2 * pi() * {u(tag, *keys, nth=1)}))"


def pick(u_: str, choices: list[str]) -> str:
    items = ", ".join(f"'{c}'" for c in choices)
    return f"list_extract([{items}], cast(floor({u_} * {len(choices)}) AS INTEGER) + 1)"


def between(u_: str, low: int, high: int) -> str:
    return f"cast(floor({u_} * {high - low}) + {low} AS INTEGER)"


def binned(x: str, size: int) -> str:
    low = f"cast(floor(trunc({x}) / {size}) * {size} AS BIGINT)"
    return f"(cast({low} AS VARCHAR) || '-' || cast({low} + {size - 1} AS VARCHAR))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
