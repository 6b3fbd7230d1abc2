"""PII surrogates: detected entities get keyed replacements of their own type and format. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, discard, table, texts

KEY = "surrogate-key"
PLAIN_TURNS = 3

# Given names by script and gender, and titles by gender.
FEMALE = ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lucia", "Maria", "Marta", "Mary", "Nora", "Paula", "Rosa", "Sarah", "Sofia", "Susan"]
MALE = ["Adam", "Carlos", "Daniel", "David", "James", "Jan", "John", "Louis", "Marco", "Martin", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas"]
FEMALE_CYRILLIC = ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"]
MALE_CYRILLIC = ["Антон", "Борис", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme"]
MALE_TITLES = ["Mr", "Herr", "Señor", "Monsieur"]
# Syllables of surrogate family names; 16 of each, so that a hex digit picks one.
LATIN = ["ba", "cor", "del", "fen", "gar", "hol", "ja", "kel", "lin", "mar", "nor", "pel", "ros", "sal", "ter", "vin"]
CYRILLIC = ["ба", "вор", "гал", "дан", "зем", "кар", "лин", "мар", "нов", "пол", "рос", "сал", "тер", "фом", "хол", "чер"]
# End of the fixed values.

GIVEN = {"female": FEMALE, "male": MALE, "female_cyrillic": FEMALE_CYRILLIC, "male_cyrillic": MALE_CYRILLIC}
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join(FEMALE_TITLES + MALE_TITLES + ["Dr", "Prof"])
_CAPITAL = r"\p{Lu}\p{Ll}++(?![\p{L}\p{Nd}@])"
_INTRODUCED = r"(?<=\b(?:[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Ss]igned:|Dear|Regards,|Sincerely,) )"

#: Kind and pattern, tried in this order at each place.
KINDS = {
    "email": r"(?<![\p{L}\p{Nd}._%+-])[\p{L}\p{Nd}._%+-]++@(?:[\p{L}\p{Nd}-]++\.){1,127}\p{L}{2,}+",
    "ip": r"(?<![\p{Nd}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![\p{L}\p{Nd}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{Nd}])",
    "token": r"(?<![\p{L}\p{Nd}])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{Nd}])",
    "card": r"(?<![\p{L}\p{Nd}])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![\p{L}\p{Nd}])|(?<![\p{L}\p{Nd}])[0-9]{13,19}(?![\p{L}\p{Nd}])",
    "person": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{Nd}}])(?:(?:{_TITLE})\.? (?:(?:{_GIVEN}) )?{_CAPITAL}|(?:{_GIVEN}) {_CAPITAL}|{_INTRODUCED}{_CAPITAL} {_CAPITAL})",
}


def _any(*without: str) -> str:
    return "|".join(f"(?:{p})" for k, p in KINDS.items() if k not in without)


ANY = _any()


def entities(text: Column) -> Column:
    """All entities of a text in their order. A text without @ has no address, and one without a digit only addresses
    and people: such texts, most of all, are not searched for what they can't have."""
    find = lambda *without: F.regexp_extract_all(text, F.lit(_any(*without)), F.lit(0))
    numbers = [k for k in KINDS if k not in ("email", "person")]
    at, digit = F.instr(text, "@") > 0, text.rlike("[0-9]")
    return F.when(digit & at, find()).when(digit, find("email")).when(at, find(*numbers)).otherwise(find("email", *numbers))


def _is(entity: Column, kind: str) -> Column:
    return entity.rlike(f"^(?:{KINDS[kind]})$")


def kind_of(entity: Column) -> Column:
    out = F.lit("person")
    for kind in reversed([k for k in KINDS if k != "person"]):
        out = F.when(_is(entity, kind), kind).otherwise(out)
    return out


def _listed(entity: Column) -> Column:
    """Whether a person has a title or a given name of the lists; others were introduced by what comes before."""
    return entity.rlike(rf"^(?:(?:{_TITLE})\.? |(?:{_GIVEN}) )")


def _successor(key: str) -> dict[str, str]:
    """Each list of given names in an order that the key shuffles: a name's replacement is the next one, so different
    names keep different ones, and none its own."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def norm_of(entity: Column, kind: Column) -> Column:
    """What entities that are the same one share: letters and digits, lower-cased; the family name of a person (of one
    whose given name is not listed, both names), the numbers of an address."""
    plain = F.lower(F.regexp_replace(entity, r"[^\p{L}\p{Nd}]", ""))
    return (
        F.when(kind == "person", F.lower(F.when(_listed(entity), F.regexp_extract(entity, r"(\p{L}+)$", 1)).otherwise(entity)))
        .when(kind == "ip", entity)
        .when(kind == "email", F.lower(entity))
        .otherwise(plain)
    )


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _stream(norm: Column, kind: Column, turn: Column, key: str) -> Column:
    """256 keyed hex digits of an entity, of which position i has two; kept within the entity's kind."""
    return F.concat(*(_digest(F.lit(key), kind, norm, turn.cast("string"), F.lit(str(i))) for i in range(4)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i % 128 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _syllables(stream: Column, parts: list[str], first: int, n: int) -> Column:
    pick = F.array(*map(F.lit, parts))
    return F.concat(*(F.get(pick, F.conv(F.substring(stream, 2 * i + 1, 1), 16, 10).cast("int")) for i in range(first, first + n)))


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's rule over a string of digits, modulo 10."""
    ds = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(ds, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10


def surrogate(entity: Column, kind: Column, stream: Column, turn: Column, key: str = KEY) -> Column:
    """The entity's replacement: a pure function of the entity and of its stream, which depends on the key, the
    entity's norm and the turn; so all its occurrences, in any document, capital letters or spacing, get
    one. Digits become digits and letters letters of the same script and case; marks stay. Kept as they
    are: a phone's country code, an email's last label, an IBAN's country, a title. Card numbers that satisfy
    Luhn's rule do so again. Given names are permuted within those of the same gender and script, family names are
    made up of the script's syllables. After PLAIN_TURNS turns a replacement gets longer by a character, a syllable or an octet
    a turn, as the format may have no room for more."""
    first_kept = (
        F.when((kind == "phone") & entity.startswith("+"), F.length(F.regexp_extract(entity, r"^\+([0-9]+?)(?=[ .(-]|[0-9]{10})", 1)))
        .when(kind == "iban", 2)
        .otherwise(0)
    )
    last_kept = F.when(kind == "email", F.length(F.regexp_extract(entity, r"(\p{L}+)$", 1))).otherwise(0)
    n = F.length(entity)
    extra = turn - PLAIN_TURNS

    def more(unit) -> Column:
        """One unit for each turn beyond the first ones."""
        some = F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: unit(_byte(stream, i + 60)))
        return F.when(extra > 0, F.array_join(some, "")).otherwise("")

    def letter(c: Column, b: Column) -> Column:
        small = lambda low, size: F.char(F.lit(low) + b % size)
        plain = F.when(kind == "token", small(97, 6)).otherwise(small(97, 26))
        cyrillic = F.get(F.split(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), ""), b % 28)
        greek = F.get(F.split(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), ""), b % 24)
        new = F.when(c.rlike(r"\p{IsCyrillic}"), cyrillic).when(c.rlike(r"\p{IsGreek}"), greek).otherwise(plain)
        return F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"[^\p{L}\p{Nd}]", "")) - 1
        b = _byte(stream, at)
        new = F.when(c.rlike(r"\p{Nd}"), (b % 10).cast("string")).when(c.rlike(r"\p{L}"), letter(c, b)).otherwise(c)
        return F.when((at < first_kept) | (i >= n - last_kept), c).otherwise(new)

    shaped = F.array_join(F.transform(F.split(entity, ""), one), "")
    digits = F.regexp_replace(shaped, "[^0-9]", "")
    ok = _luhn(F.regexp_replace(entity, "[^0-9]", "")) == 0
    last = (F.substring(digits, -1, 1).cast("int") + 10 - _luhn(digits)) % 10
    card = F.when(ok, F.concat(F.regexp_replace(shaped, "[0-9]$", ""), last.cast("string"))).otherwise(shaped)
    digit = lambda b: (b % 10).cast("string")
    octet = lambda b: (b % 254 + 1).cast("string")
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: octet(_byte(stream, i))), ".")
    ip = F.concat(ip, more(lambda b: F.concat(F.lit("."), octet(b))))
    wider = more(lambda b: F.char(F.lit(97) + b % 26))
    email = F.concat(F.substring_index(shaped, "@", 1), F.when(entity.rlike(r"\p{Ll}"), wider).otherwise(F.upper(wider)), F.lit("@"), F.substring_index(shaped, "@", -1))

    latin = ~entity.rlike(r"\p{IsCyrillic}")
    made_up = lambda at, size: F.initcap(
        F.when(latin, F.concat(_syllables(stream, LATIN, at, size), more(lambda b: F.get(F.array(*map(F.lit, LATIN)), b % 16))))
        .otherwise(F.concat(_syllables(stream, CYRILLIC, at, size), more(lambda b: F.get(F.array(*map(F.lit, CYRILLIC)), b % 16))))
    )
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )?", 1)
    given = F.regexp_extract(entity, rf"((?:{_GIVEN})) \p{{Lu}}\p{{Ll}}+$", 1)
    successor = F.create_map(*(F.lit(x) for pair in _successor(key).items() for x in pair))
    new_given = F.when(given == "", F.when(_listed(entity), "").otherwise(F.concat(made_up(5, 3), F.lit(" ")))).otherwise(F.concat(F.element_at(successor, given), F.lit(" ")))
    person = F.concat(title, new_given, made_up(0, 5))
    return F.when(kind == "ip", ip).when(kind == "person", person).when(kind == "email", email).otherwise(F.concat(F.when(kind == "card", card).otherwise(shaped), more(digit)))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entity, surrogate, for each distinct entity. Of entities of different norms whose surrogates are the same
    one, the first by norm keeps it; the others, and those whose surrogate is itself an entity of the
    corpus, take another turn, until all are distinct: as turns widen the format, they will be. Each step's table is cut, as a
    stream of digits is read for every letter; a turn's steps are over the entities that take it."""
    e, k = F.col("entity"), F.col("kind")
    now = cut(
        entities.select("entity").distinct().withColumn("kind", kind_of(e)).withColumn("norm", norm_of(e, k)).withColumn("turn", F.lit(0)),
        "entities",
    )
    real, kept = now.select("kind", F.col("norm").alias("to")).distinct(), None
    while True:
        streams = cut(now.withColumn("stream", _stream(F.col("norm"), k, F.col("turn"), key)), "streams")
        made = streams.select("entity", "kind", "norm", "turn", surrogate(e, k, F.col("stream"), F.col("turn"), key).alias("surrogate"))
        made = cut(made.withColumn("to", norm_of(F.col("surrogate"), k)), "surrogates")
        discard(streams)
        new = made.select("kind", "norm", "to").distinct()
        keepers = new.groupBy("kind", "to").agg(F.min("norm").alias("keeper"))
        moved = new.join(keepers, ["kind", "to"]).filter("norm <> keeper").select("kind", "norm")
        moved = moved.union(new.join(real, ["kind", "to"], "left_semi").select("kind", "norm"))
        if kept is not None:
            moved = moved.union(new.join(kept.select("kind", "to"), ["kind", "to"], "left_semi").select("kind", "norm"))
        moved = cut(moved.distinct(), "moved")
        if moved.isEmpty():
            return (made if kept is None else kept.unionByName(made)).select("entity", "surrogate")
        settled = made.join(moved, ["kind", "norm"], "left_anti")
        kept = cut(settled if kept is None else kept.unionByName(settled), "kept")
        now = cut(made.join(moved, ["kind", "norm"], "left_semi").select("entity", "kind", "norm", (F.col("turn") + 1).alias("turn")), "entities")


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (with surrogates), kinds (of the entities in their order); one row per row of docs.

    A surrogate depends on the entity and the key only (see surrogate), so that documents keep who is who.
    Distinct entities keep distinct surrogates, none of which is an entity of the corpus (see surrogates).
    Each distinct entity is replaced once, however often it occurs; occurrences are joined to the table of
    surrogates by a join that adaptive execution splits, and put in order by document; a text moves once,
    to meet its surrogates. People are told apart by given and family name; who shares a family name shares its surrogate.

    Null texts are empty. Repeated rows get the same text, also without an id. An empty table gives no rows; other columns
    are ignored.
    """
    none = F.col("doc_id").isNull()
    base = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64("text", none).alias("tid"), "text")
    found = cut(base.select("did", "tid", F.posexplode(entities(F.col("text"))).alias("pos", "entity")), "occurrences")
    new = found.join(surrogates(found, key), "entity").withColumn("kind", kind_of(F.col("entity")))
    new = new.groupBy("did", "tid").agg(F.sort_array(F.collect_set(F.struct("pos", "surrogate", "kind"))).alias("new"))
    rest = F.split("text", ANY, -1)
    filled = F.zip_with(rest, F.concat(F.col("new.surrogate"), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return base.join(new, ["did", "tid"], "left").select(
        "doc_id",
        F.when(F.col("new").isNull(), F.col("text")).otherwise(F.array_join(filled, "")).alias("text"),
        F.coalesce(F.col("new.kind"), F.array().cast("array<string>")).alias("kinds"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), "kinds")
