"""E-mail addresses, phone numbers and social security numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veil.functions.build import REDACTED, Build
from veil.functions.canonical import canon, is_text

# Mail domains that are public and stay readable.
KEPT_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com"]

# Each hex digit and the last decimal digit of its character code.
HEX_DIGITS = "0123456789abcdef"
CODE_DIGITS = "8901234567789012"

# Each byte as a character and its last decimal digit.
BYTES = "".join(chr(x) for x in range(256))
BYTE_DIGITS = "".join(str(x % 10) for x in range(256))
_DIGEST_BYTES = 32


def email(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    text = b.text(c, dtype, options)
    at = F.instr(text, "@")
    local = F.substring(text, F.lit(1), at - 1)
    domain = b.bind(F.substring(text, at + 1, F.length(text)))
    user = F.concat(F.lit("user"), F.substring(b.secrets.digest(local), 1, 8))
    company = F.concat(F.lit("company"), F.substring(b.secrets.digest(domain), 1, 6))
    has_dot = F.instr(domain, ".") > 0
    dotted = F.concat(company, F.lit("."), F.substring_index(domain, ".", -1))
    bare = domain if b.lenient(options, "bare_domain") else company
    hidden = F.when(domain.isin(KEPT_DOMAINS), domain).when(has_dot, dotted).otherwise(bare)
    not_mail = text if b.lenient(options) else F.lit(REDACTED)
    return (
        F.when(text.isNull(), F.lit(None))
        .when(at > 0, F.concat(user, F.lit("@"), hidden))
        .otherwise(not_mail)
    )


def phone(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    """Replace the digits in place; blanks, brackets and signs stay.

    The digest has bytes for 32 digits; behind them come the digests of the
    digest and a block number, as many as it takes.
    """
    text = b.text(c, dtype, options)
    source = F.regexp_replace(text, "[^0-9]", "") if options["normalize"] else text
    between = b.bind(F.split(text, "[0-9]", -1))
    count = F.size(between) - 1
    first = b.bind(b.secrets.digest(source))
    used = F.substring(F.unhex(first), F.lit(1), count)
    fresh = b.bind(F.translate(F.decode(used, "ISO-8859-1"), BYTES, BYTE_DIGITS), 1)
    # Beyond the last digit both parts of a pair are empty or null and vanish.
    woven = [F.get(between, F.lit(0))]
    for i in range(_DIGEST_BYTES):
        woven += [F.substring(fresh, i + 1, 1), F.get(between, F.lit(i + 1))]
    further = F.transform(F.sequence(F.lit(1), F.floor(count / _DIGEST_BYTES).cast("int")),
                          lambda n: F.sha2(F.concat_ws("|", first, n.cast("string")), 256))
    stream = F.unhex(F.concat(first, F.array_join(further, "")))
    long = b.bind(F.when(count > _DIGEST_BYTES, F.translate(
        F.decode(F.substring(stream, F.lit(1), count), "ISO-8859-1"), BYTES, BYTE_DIGITS)), 1)
    any_length = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.substr(long, i + 1, F.lit(1)))), "")
    short = text if b.lenient(options, "short") else F.lit(REDACTED)
    return (
        F.when(text.isNull(), F.lit(None))
        .when(count < 7, short)
        .when(count <= _DIGEST_BYTES, F.concat_ws("", *woven))
        .otherwise(any_length)
    )


def ssn(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    text = b.text(c, dtype, options)
    if not is_text(dtype):
        text = F.lpad(canon(c, dtype, options.get("scale")), 9, "0")
    code = F.translate(F.substring(b.secrets.digest(text), 1, 9), HEX_DIGITS, CODE_DIGITS)
    dashed = F.regexp_replace(code, "^(...)(..)(....)$", "$1-$2-$3")
    with_dashes = text.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}")
    return F.when(~with_dashes & text.rlike("^[0-9]{9}"), code).otherwise(dashed)
