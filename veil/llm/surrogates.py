"""Personal data replaced by surrogates of the same type, layout, script and gender.

Everything is DataFrame operations.  One pattern finds e-mail addresses, IPv4
addresses, card, social security and phone numbers, secrets and names with a
title.  An entity is its kind and its canonical form (lower case, bare digits),
so two spellings of a number are one entity and get one surrogate, each in its
own layout and its own digits, in every document.

A name is the same person under all titles that do not contradict each other.
In a document that has a name behind a title, every later or earlier mention of
its words is that person's too: whole names, given and family names alone, in
capitals or not, each replaced by the same word of the surrogate.  A family name
alone behind a title is the person of that family named last before it.

A surrogate follows from the key, the kind, the canonical form and the number of
the try.  All distinct entities of the corpus are checked together: a surrogate
that another entity has, or that is an entity of the corpus itself, is drawn
again in the next try, until all differ.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from veil.functions.keyed import local_table
from veil.llm.rows import col, digest, fresh, whole_text
from veil.operators.materialize import materialize

#: Titles that go before a name, by gender; "" where the title says nothing.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Señora", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"],
    "": ["Dr", "Prof"],
}
#: Given names by gender, for surrogates; the same number in each list of a script.
GIVEN = {
    "latin": {"f": ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Helena", "Ines", "Julia", "Klara",
                    "Lina", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Tessa", "Vera"],
              "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Konrad",
                    "Leo", "Martin", "Nils", "Oskar", "Paul", "Robert", "Simon", "Tomas", "Victor"]},
    "cyrillic": {"f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Софья"],
                 "m": ["Антон", "Борис", "Денис", "Егор", "Иван", "Лев", "Максим", "Олег", "Павел", "Роман"]},
    "greek": {"f": ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Λυδία", "Μαρία", "Νίκη", "Σοφία", "Χαρά", "Ειρήνη"],
              "m": ["Αλέξης", "Γιάννης", "Δήμος", "Ηλίας", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος"]},
}
#: First and second halves of family names, for surrogates.
FAMILY = {
    "latin": (["Alder", "Birken", "Calder", "Dorn", "Eben", "Falk", "Grau", "Hollen", "Istra", "Jessel", "Kalten",
               "Linden", "Morgen", "Nord", "Osten", "Palm", "Rother", "Stein", "Tannen", "Weiss"],
              ["bach", "berg", "burn", "dale", "feld", "field", "gard", "ham", "hof", "land", "man", "mont", "ner",
               "quist", "ridge", "sen", "son", "stedt", "ton", "wood"]),
    "cyrillic": (["Бел", "Вол", "Гор", "Дуб", "Зим", "Кал", "Лес", "Мор", "Нов", "Озер"],
                 ["енко", "ичук", "евич", "ных", "ских", "енюк", "ацкая", "ович", "уха", "ай"]),
    "greek": (["Αγγελ", "Βασιλ", "Γεωργ", "Δημητρ", "Ηλι", "Κων", "Λαμπρ", "Μιχαλ", "Νικολ", "Παυλ"],
              ["άκη", "ίδη", "έα", "άτου", "ούλη", "όγλου", "έλη", "άρη", "ίτη", "άκου"]),
}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

#: All decimal digits there are, in blocks from zero to nine, those of ASCII first; and what they stand for.
DIGITS = "".join(filter(lambda c: unicodedata.category(c) == "Nd", map(chr, range(0x110000))))
_VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)

_WORD = r"\p{Lu}(?:\p{L}++(?:['’-]\p{L}{2,}+)*+|(?:['’-]\p{L}{2,}+)++)"
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
#: Kinds in the order in which they are tried, with their patterns.
KINDS = {
    "email": r"\b[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key)\s*[=:]\s*\"?[^\s\"]{6,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
             r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"\b(?:{_ALL_TITLES})\b\.? +{_WORD}(?: {_WORD}){{0,2}}",
}
PATTERN = "(?U)" + "|".join(KINDS.values())
#: In texts that name someone every word with a capital may be a mention.
NAMED_PATTERN = rf"{PATTERN}|\b{_WORD}"
#: A text that lacks all of these has no entity; it costs one fast pass.
_HINT = rf"(?U)[\d@]|\b(?:{_ALL_TITLES})\b|AKIA|(?:password|passwd|secret|token|api_key)\s*[=:]"


def _titled(found: Column) -> Column:
    return found.rlike(rf"^(?U)(?:{KINDS['name']})$")


def _kind(found: Column) -> Column:
    """The kind of a find; a word that may be a mention is a ``word``."""
    out = F.when(_titled(found), "name").otherwise("word")
    for kind in reversed(list(KINDS)[:-1]):
        out = F.when(found.rlike(f"^(?U)(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _plain_digits(text: Column) -> Column:
    return F.translate(text, DIGITS[10:], _VALUES[10:])


def _digit_like(char: Column, value: Column) -> Column:
    """A digit of the block of another one."""
    at = F.instr(F.lit(DIGITS), char) - 1
    return F.substr(F.lit(DIGITS), at - at % 10 + value + 1, F.lit(1))


def _name_parts(found: Column) -> Column:
    """The name behind the title."""
    return F.regexp_replace(found, rf"^(?U)(?:{_ALL_TITLES})\b\.? +", "")


def _gender(found: Column) -> Column:
    out = F.lit("")
    for gender in ("f", "m"):
        out = F.when(found.rlike(rf"^(?:{'|'.join(TITLES[gender])})\b"), gender).otherwise(out)
    return out


def _canonical(kind: Column, found: Column) -> Column:
    """What makes two finds the same entity; names get theirs from all documents."""
    return F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(_plain_digits(found), "[^0-9]", "")) \
        .when(kind == "email", F.lower(found)).when(kind == "ip", _plain_digits(found)) \
        .when(kind == "secret", F.regexp_replace(found, r"^(?:\w+\s*[=:]\s*\"?)", "")) \
        .otherwise(found)


def _number(stream: Column, i: Column, below: Column | int) -> Column:
    """The ``i``-th keyed number under a bound, from a stream of hex digits."""
    return (F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _picked(choices: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), n + 1)


def _like(char: Column, stream: Column, i: Column) -> Column:
    """A keyed character of the same class: digit, small or capital letter of the script; others stay."""
    def of(alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), _number(stream, i, len(alphabet)) + 1, F.lit(1))

    return F.when(char.rlike(r"\p{Nd}"), _digit_like(char, _number(stream, i, 10))).when(char.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz")) \
        .when(char.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) \
        .when(char.rlike(r"\p{IsCyrillic}"), F.when(char == F.lower(char), of("абвгдежзиклмнопрстуфхцшэюя"))
              .otherwise(of("АБВГДЕЖЗИКЛМНОПРСТУФХЦШЭЮЯ"))) \
        .when(char.rlike(r"\p{IsGreek}"), F.when(char == F.lower(char), of("αβγδεζηθικλμνξοπρστυφχψω"))
              .otherwise(of("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))) \
        .when(char.rlike(r"\p{L}"), F.when(char == F.lower(char), of("abcdefghijklmnopqrstuvwxyz"))
              .otherwise(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).otherwise(char)


def _each(text: Column, change) -> Column:
    """``change`` of every character and its place, put together again."""
    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn(digits: Column) -> Column:
    """The digit sum of a card number without its last digit, doubling from the right."""
    def add(total: Column, pair: Column) -> Column:
        twice = pair["d"] * F.when(pair["i"] % 2 == 0, 2).otherwise(1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add)


def _surrogate(kind: Column, value: Column, stream: Column, attempt: int) -> Column:
    """A surrogate in canonical form."""
    def digits(keep: int, first: str) -> Column:
        """Digits behind the first ``keep``, of which the first is one of ``first``."""
        def change(c: Column, i: Column) -> Column:
            return F.when(i < keep, c).when(i == keep, F.substr(
                F.lit(first), _number(stream, i, len(first)) + 1, F.lit(1))).otherwise(_like(c, stream, i))

        return _each(value, change)

    body = F.substr(digits(1, "0123456789"), F.lit(1), F.length(value) - 1)
    was_valid = (_luhn(F.substr(value, F.lit(1), F.length(value) - 1)) + F.substr(value, F.length(value)).cast("int")) \
        % 10 == 0
    check = F.when(was_valid, ((10 - _luhn(body) % 10) % 10).cast("string")).otherwise(
        F.substr(digits(1, "0123456789"), F.length(value)))
    card = F.concat(body, check)
    # An eleven-digit number with a country code keeps the code; others only their length.
    phone = F.when((F.length(value) == 11) & value.startswith("1"), digits(1, "23456789")).otherwise(digits(0, "23456789"))
    ip = F.concat_ws(".", (_number(stream, F.lit(0), 115) + 11).cast("string"),
                     *[_number(stream, F.lit(i), 256).cast("string") for i in (1, 2)],
                     (_number(stream, F.lit(3), 254) + 1).cast("string"))
    suffix = F.regexp_extract(value, r"\.[^.@]+$", 0)
    stem = F.substr(value, F.lit(1), F.length(value) - F.length(suffix))
    email = F.concat(_each(stem, lambda c, i: _like(c, stream, i)), suffix)
    prefix = F.when(value.startswith("AKIA"), 4).otherwise(0)
    hexes = value.rlike("^[0-9a-f]+$")
    secret = _each(value, lambda c, i: F.when(i < prefix, c).when(
        hexes, F.substr(F.lit("0123456789abcdef"), _number(stream, i, 16) + 1, F.lit(1))).otherwise(
        _like(c, stream, i)))
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip) \
        .when(kind == "card", card).when(kind == "ssn", digits(0, "12345")).when(kind == "phone", phone) \
        .otherwise(_new_name(value, stream, attempt))


def _new_name(value: Column, stream: Column, attempt: int) -> Column:
    """A name with as many words, of the gender and the script.

    Family names have one part more in each of the first tries, so that names do
    not run out: six parts make more than 10^15 of each script and gender.
    """
    gender, name = F.substr(value, F.lit(1), F.instr(value, ":") - 1), F.substr(value, F.instr(value, ":") + 1)
    out = None
    for script in ("cyrillic", "greek", "latin"):
        lists = GIVEN[script]
        n = len(lists["f"])
        given = F.when(gender == "f", _picked(lists["f"], _number(stream, F.lit(0), n))).when(
            gender == "m", _picked(lists["m"], _number(stream, F.lit(0), n))).otherwise(
            _picked(lists["f"] + lists["m"], _number(stream, F.lit(0), 2 * n)))
        front, back = FAMILY[script]

        def family(i: int, front=front, back=back) -> Column:
            return F.concat(_picked(front, _number(stream, F.lit(i), len(front))),
                            _picked(back, _number(stream, F.lit(i + 1), len(back))))

        last = F.concat_ws("-", *[family(3 + 2 * i) for i in range(min(attempt, 5) + 1)])
        words = F.size(F.split(name, " "))
        made = F.when(words == 1, last).when(words == 2, F.concat_ws(" ", given, last)).otherwise(
            F.concat_ws(" ", given, family(1), last))
        out = made if out is None else out
        if script != "latin":
            out = F.when(name.rlike(_SCRIPTS[script]), made).otherwise(out if out is not made else F.lit(None))
        else:
            out = F.coalesce(out, made)
    return F.concat(gender, F.lit(":"), out)


def _cased(word: Column, found: Column) -> Column:
    """The word in capitals if the find is."""
    return F.when((F.length(found) > 1) & (found == F.upper(found)), F.upper(word)).otherwise(word)


def _laid_out(kind: Column, found: Column, surrogate: Column, part: Column) -> Column:
    """A canonical surrogate in the layout of a find: its separators, its digits, its capitals, its title.

    ``part`` is the number of the word that a find of one word stands for in a name.
    """
    def digit(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), r"\P{Nd}", ""))
        return F.when(c.rlike(r"\p{Nd}"), _digit_like(c, F.substr(surrogate, nth, F.lit(1)).cast("int"))).otherwise(c)

    def capital(c: Column, i: Column) -> Column:
        same = F.substr(surrogate, i + 1, F.lit(1))
        return F.when(c != F.lower(c), F.upper(same)).otherwise(same)

    old = F.when(kind == "name", _name_parts(found)).otherwise(found)
    title = F.substr(found, F.lit(1), F.length(found) - F.length(old))
    whole = F.substr(surrogate, F.instr(surrogate, ":") + 1)
    name = F.concat(title, _cased(F.when(part.isNull(), whole).otherwise(F.get(F.split(whole, " "), part)), old))
    label = F.regexp_extract(found, r"^(?:\w+\s*[=:]\s*\"?)", 0)
    return F.when(kind.isin("card", "ssn", "phone"), _each(found, digit)) \
        .when(kind == "email", _each(found, capital)) \
        .when(kind.isin("name", "word"), name).when(kind == "secret", F.concat(label, surrogate)).otherwise(surrogate)


def surrogate_table(entities: DataFrame, key: str, most_tries: int = 50) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value), no two with the same surrogate.

    ``entities`` has to be stored, as it is read once for each try.  A kind whose
    domain is used up ends in an error, never in a shared surrogate.
    """
    spark = entities.sparkSession
    secret = local_table(spark, key=[key]).select("key").scalar()
    open_, done = entities, None
    for attempt in range(most_tries):
        seed = F.sha2(F.concat_ws("|", secret, F.lit("surrogate"), "kind", "value", F.lit(str(attempt))), 256)
        seeded = open_.withColumn("seed", seed)
        stream = F.array_join(F.transform(F.sequence(F.lit(0), (F.length("value") / 12).cast("int") + 1),
                                          lambda b: F.sha2(F.concat(F.col("seed"), b.cast("string")).cast("binary"),
                                                           256)), "")
        drawn = seeded.withColumn("stream", stream).select(
            "kind", "value",
            _surrogate(F.col("kind"), F.col("value"), F.col("stream"), attempt).alias("surrogate"))
        drawn = materialize(drawn)
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        real = entities.select(F.col("kind").alias("k"), F.lower("value").alias("real"))
        good = first.join(real, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.col("real")), "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = materialize(good.select("kind", "value", "surrogate"))
        done = good if done is None else done.unionByName(good)
        open_ = materialize(open_.join(good, ["kind", "value"], "left_anti").select("kind", "value"))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates left after {most_tries} tries")


def _nearest(candidates: Column, nth: Column) -> Column:
    """Of candidates in the order of their places the last one before a place, or the first one."""
    before = F.filter(candidates, lambda c: c["nth"] < nth)
    return F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.get(candidates, F.lit(0)))


def _people(names: DataFrame) -> DataFrame:
    """(at, nth, value, part) of names behind titles (at, nth, found): the person, and the word a name of one word stands for."""
    words = F.split(F.lower(_name_parts(F.col("found"))), " ")
    named = names.select("at", "nth", _gender(F.col("found")).alias("gender"), words.alias("words"))
    # Within a document a family name alone is a person who is named with it.
    place = F.struct("nth", "gender", "words")
    families = named.filter(F.size("words") > 1).groupBy("at", F.element_at("words", -1).alias("family")).agg(
        F.sort_array(F.collect_list(place)).alias("people"))
    alone = named.filter(F.size("words") == 1).withColumn("family", F.get("words", F.lit(0)))
    fitting = F.filter("people", lambda p: (p["gender"] == F.col("gender")) | (p["gender"] == "") | (F.col("gender") == ""))
    person = _nearest(fitting, F.col("nth"))
    alone = alone.join(families, ["at", "family"], "left").withColumn("person", person).select(
        "at", "nth", F.when(F.col("gender") != "", F.col("gender")).otherwise(
            F.coalesce("person.gender", F.lit(""))).alias("gender"),
        F.coalesce("person.words", "words").alias("words"),
        F.when(F.size("person.words") > 1, F.size("person.words") - 1).alias("part"))
    whole = named.filter(F.size("words") > 1).withColumn("part", F.lit(None).cast("int"))
    people = whole.unionByName(alone).withColumn("name", F.array_join("words", " "))
    # A title without a gender leaves it to the other mentions in all documents, if they agree.
    seen = people.groupBy("name").agg(F.max(F.col("gender") == "f").alias("f"), F.max(F.col("gender") == "m").alias("m"))
    gender = F.when(F.col("gender") != "", F.col("gender")).when(F.col("f") & ~F.col("m"), "f").when(
        F.col("m") & ~F.col("f"), "m").otherwise("")
    return people.join(seen, "name").select("at", "nth", F.concat(gender, F.lit(":"), "name").alias("value"), "part")


def _mentions(words: DataFrame, people: DataFrame) -> DataFrame:
    """(at, nth, value, part) of the words (at, nth, found) that are words of a person named in the document."""
    name = F.split(F.substr(F.col("value"), F.instr("value", ":") + 1), " ")
    parts = people.select("at", "nth", "value", F.posexplode(name).alias("part", "word"))
    parts = parts.groupBy("at", "word").agg(F.sort_array(F.collect_list(F.struct("nth", "value", "part"))).alias("people"))
    met = words.withColumn("word", F.lower("found")).join(parts, ["at", "word"])
    return met.withColumn("person", _nearest(F.col("people"), F.col("nth"))).select(
        "at", "nth", "person.value", "person.part")


def replace_entities(docs: DataFrame, key: str, text: str = "text", out: str = "n_replaced") -> DataFrame:
    """All rows with surrogates in place of personal data, and how many there are.

    A null text stays null and has none, an empty one has none.  Equal texts
    become equal texts; repeated rows stay repeated; an empty table stays empty.
    Layout, separators, digits and capitals are those of the find.  A name counts
    if a title stands before it somewhere in the document; then its other mentions
    there count too.  If ``out`` is a column already, the count gets underscores
    after its name.
    """
    name, held, at, named = fresh(docs, out, "held", "at", "named")
    source = whole_text(text)
    hinted = docs.filter(source.rlike(_HINT)).select(digest(source).alias("at"), source.alias("text"))
    hinted = hinted.select("at", "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    hinted = hinted.withColumn("named", F.exists("found", _titled))
    rich = hinted.select("at", "named", F.when(F.col("named"), F.regexp_extract_all(
        "text", F.lit(NAMED_PATTERN), F.lit(0))).otherwise(F.col("found")).alias("found")).filter(F.size("found") > 0)
    # One row for each find of each distinct text.
    finds = rich.groupBy("at").agg(F.first("named").alias("named"), F.first("found").alias("found")).select(
        "at", "named", F.posexplode("found").alias("nth", "found"))
    finds = materialize(finds.withColumn("kind", _kind(F.col("found"))))
    people = materialize(_people(finds.filter("kind = 'name'")))
    mentions = _mentions(finds.filter("kind = 'word'"), people)
    whose = people.unionByName(mentions).withColumnsRenamed({"at": "whose_at", "nth": "whose_nth"})
    plain = finds.filter("kind NOT IN ('name', 'word')").withColumn("value", _canonical(F.col("kind"), F.col("found")))
    personal = finds.filter("kind IN ('name', 'word')").join(
        whose, (F.col("at") == F.col("whose_at")) & (F.col("nth") == F.col("whose_nth")), "left").drop("whose_at", "whose_nth")
    entity = F.when(F.col("kind") == "word", "name").otherwise(F.col("kind")).alias("entity")
    finds = materialize(plain.withColumn("part", F.lit(None).cast("int")).unionByName(personal).select("*", entity))
    table = surrogate_table(materialize(finds.filter("value IS NOT NULL").select(
        F.col("entity").alias("kind"), "value").distinct()), key).withColumnRenamed("kind", "entity")
    replaced = finds.join(table, ["entity", "value"], "left").withColumn("new", F.when(
        F.col("surrogate").isNotNull(), _laid_out(F.col("kind"), F.col("found"), F.col("surrogate"), F.col("part"))))
    new = replaced.groupBy("at").agg(
        F.first("named").alias(named), F.count("new").alias(name),
        F.sort_array(F.collect_list(F.struct("nth", F.coalesce("new", "found").alias("new")))).alias("new")).select(
        F.col("at").alias(at), named, name, F.transform("new", lambda n: n["new"]).alias(held))

    columns = [col(c) for c in docs.columns]
    whole = col(text).cast(StringType())
    pieces = F.when(col(named), F.split(whole, NAMED_PATTERN, -1)).otherwise(F.split(whole, PATTERN, -1))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(col(held), i), F.lit("")))),
                            "")

    poor = docs.select(*columns, F.lit(0).cast("bigint").alias(name)).filter(~source.rlike(_HINT))
    changed = docs.filter(source.rlike(_HINT)).withColumn(at, digest(source)).join(new, at, "left")
    rewritten = F.when(col(held).isNull(), col(text)).otherwise(F.get(F.transform(F.array(pieces), joined), F.lit(0)))
    return poor.unionByName(changed.select(
        *[rewritten.alias(c) if c == text else col(c) for c in docs.columns],
        F.coalesce(col(name), F.lit(0)).cast("bigint").alias(name)))
