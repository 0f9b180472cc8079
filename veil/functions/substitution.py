"""Replacement by a random entry of a list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veil.functions.build import REDACTED, Build
from veil.functions.keyed import pick, uniform

# The built-in replacement lists by type.
LISTS = {
    "names": [
        "Avery Sandoval", "Bram Kuipers", "Celeste Moreau", "Darya Melnik", "Esteban Rojas", "Farah Aziz",
        "Gustav Ekman", "Hollis Grant", "Imani Njoroge", "Jasper Whitlock",
    ],
    "companies": [
        "Aspen Ridge Partners", "Bramble Works", "Cobalt Harbor", "Driftwood Foods", "Evergreen Circuits",
        "Foxglove Media", "Granite Peak", "Hollow Reed Design", "Ironwood Freight", "Juniper Analytics",
    ],
    "cities": [
        "Aldermoor", "Brackwater", "Cinderford", "Dunhollow", "Eastmere", "Fallowby", "Glenharrow", "Highbeck",
        "Islewick", "Kestrelton",
    ],
    "domains": [
        "mail.invalid", "post.invalid", "box.invalid", "inbox.example", "letters.example", "notes.example",
        "relay.test", "courier.test",
    ],
    "countries": [
        "Arvenia", "Calder Isles", "Drovinia", "Elmarra", "Gharia",
    ],
}


def substituted(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    """An entry drawn for each row or, if ``consistent``, for each value.

    Nulls are replaced like any value, so the output does not show where they were.
    """
    choices = options["list"] or LISTS.get(options["type"])
    if not choices:
        return F.lit(REDACTED)
    choices = [str(x) for x in choices]
    if options["consistent"]:
        source = b.bind(b.secrets.digest(F.coalesce(b.text(c, dtype, options), F.lit(""))))
    else:
        source = b.draw(name)
    return pick(uniform(source), choices)
