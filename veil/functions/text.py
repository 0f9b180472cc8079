"""hash, mask and pseudonymize."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veil.functions.build import Build


def hashed(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    return b.secrets.digest(b.text(c, dtype, options), options["algorithm"])


def masked(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    text, mark = b.text(c, dtype, options), F.lit(options["mask_char"])
    length = F.length(text)
    full = F.repeat(mark, length)
    if options["preserve_length"]:
        return full
    edges = F.concat(F.left(text, F.lit(1)), F.repeat(mark, length - 2), F.right(text, F.lit(1)))
    return F.when(length <= 2, full).otherwise(edges)


def pseudonym(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    code = F.substring(b.secrets.digest(b.text(c, dtype, options)), 1, options["length"])
    return F.concat(F.lit(f"{options['prefix']}_"), code)
