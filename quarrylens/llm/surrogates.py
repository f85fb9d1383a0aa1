"""Surrogates for personal data, in Spark expressions only.

Detected entities get keyed replacements of the same type: digits become digits in the same script and format (card numbers
keep their issuer digit, length and check digit; addresses stay valid addresses), e-mail addresses become addresses of the
same shape, account numbers keep their country and the class of every character and get valid check digits, and names behind a
title become names of the title's gender in the same script (Latin, Cyrillic or Greek; a name in another script that knows
capitals becomes a Latin one). Where a text names a person behind a title, the full name and the family name standing alone in the
same text are replaced alike. The replacement depends on the key and the entity alone, so all mentions of an entity in all
documents agree, whatever their format. Entities whose
surrogates collide, with each other or with an entity of the corpus, are drawn again until all are distinct.

Limits: digits of other scripts than 0-9 are not read; a name that no title precedes in its text is not known to be one.

Edge cases: null stays null, a text without entities stays as it is. Repeated rows are replaced alike, each once. Rows keep
all their columns, whatever their names; the text column alone changes, and ``entities`` may be added. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut

#: Draws after which distinct surrogates must have been found.
DRAWS = 30

# Titles by gender, the scripts' given names by gender, and the syllables of surnames.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"),
          "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин")}
GIVEN = {("f", "latin"): ("Anna", "Clara", "Elena", "Emma", "Irene", "Julia", "Laura", "Lena", "Maria", "Nora", "Paula", "Sara"),
         ("m", "latin"): ("Adam", "Daniel", "David", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
         ("f", "greek"): ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
         ("m", "greek"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"),
         ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
         ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Фёдор")}
SYLLABLES = {"latin": ("ba", "ce", "di", "fo", "ga", "he", "ji", "ko", "la", "me", "ni", "po", "ra", "se", "ti", "vo"),
             "greek": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"),
             "cyrillic": ("ба", "ве", "ди", "го", "жа", "зе", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "хо")}

_TITLE = "|".join(sorted(TITLES["f"] + TITLES["m"], key=len, reverse=True))
#: Entity forms, the earlier one wins where two begin at the same place.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "name": rf"(?=[MFSHГ])(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?[  ]\p{{Lu}}\p{{L}}+(?:[  -]\p{{Lu}}\p{{L}}+)?",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![\p{L}\d:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\d:])",
    "phone": r"(?<![\p{L}\d+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)"
             r"|(?<![\p{L}\d.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
             r"|(?<![\p{L}\d+])\+(?=(?:[ ()/.-]{0,2}\d){7,15}(?![ .-]?\d))\d{1,15}(?:[ ./-]?\(?\d{2,8}\)?){0,6}(?!\d)"
             r"|(?<![\p{L}\d+.-])(?=(?:[ ()/-]{0,2}\d){10,15}(?![ -]?\d))(?:\(0\d{1,5}\)|0\d{1,5})(?:[ /-]{1,2}\d{2,8}){1,5}(?![\d-])",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![\d-])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
}
PATTERN = "|".join(f"(?:{form})" for form in FORMS.values())
#: Every entity holds a digit or an at sign, or begins with a title: most texts need no further search.
_SOME, _TITLED = r"[0-9@]", rf"(?=[MFSHГ])(?:{_TITLE})\.?[ \u00a0]"


def kind_of(mention: Column) -> Column:
    """The type of a mention: that of the first form that it matches from end to end."""
    found = F.lit(None).cast("string")
    for name in reversed(list(FORMS)):
        found = F.when(mention.rlike(f"^(?:{FORMS[name]})$"), F.lit(name)).otherwise(found)
    return found


def _gender(name: Column) -> Column:
    return F.when(name.rlike(rf"^(?:{'|'.join(TITLES['f'])})(?:\.|[  ])"), F.lit("f")).otherwise(F.lit("m"))


def entity_of(mention: Column, kind: Column) -> Column:
    """What mentions of the same entity share: digits only, lower case, or a name behind the gender of its title."""
    name = F.concat(_gender(mention), F.lit(":"), F.lower(F.regexp_replace(mention, rf"^(?:{_TITLE})\.?[  ]", "")))
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(mention)).when(kind == "name", name)
                    .when(kind == "ip", mention).when(kind == "ipv6", F.lower(mention)).when(kind == "iban", F.regexp_replace(mention, " ", ""))
                    .otherwise(F.regexp_replace(mention, r"[^\d]", "")))


def _draw(key: str, entity: Column, attempt: Column) -> Column:
    """256 keyed bits in hex."""
    return F.sha2(F.concat(F.lit(key), F.lit("\u0001"), entity, F.lit("\u0001"), attempt.cast("string")), 256)


def _number(bits: Column, at: int, below: int) -> Column:
    return F.pmod(F.conv(F.substring(bits, at, 8), 16, 10).cast("long"), F.lit(below))


def _digits(bits: Column, n: Column) -> Column:
    """``n`` (up to 40) digits."""
    more = F.concat(bits, F.sha2(bits, 256))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.pmod(
        F.conv(F.substr(more, i * 3 - 2, F.lit(3)), 16, 10).cast("int"), F.lit(10)).cast("string")), "")


def _luhn(body: Column) -> Column:
    """``body`` and its check digit."""
    digits = F.reverse(F.split(body, ""))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9)
                                                                .otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))),
                        F.lit(0), lambda sum_, d: sum_ + d)
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def _account(body: Column, bits: Column) -> Column:
    """An account number of the same country: letters and digits in their places, and check digits that are right (ISO 7064, 97-10)."""
    more = F.concat(bits, F.sha2(bits, 256))
    own = F.transform(F.split(F.substr(body, F.lit(5)), ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.pmod(F.conv(F.substr(more, i * 3 + 1, F.lit(3)), 16, 10).cast("int"), F.lit(10)).cast("string")).otherwise(
        F.char(F.pmod(F.conv(F.substr(more, i * 3 + 1, F.lit(3)), 16, 10).cast("long"), F.lit(26)) + 65)))
    country = F.substring(body, 1, 2)
    digits = F.transform(F.split(F.concat(F.array_join(own, ""), country, F.lit("00")), ""), lambda c: F.when(
        c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(digits, F.lit(0), lambda sum_, d: (sum_ * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.array_join(own, ""))


def _social(digits: Column) -> Column:
    """Nine digits as a number that can be issued: no area of 000, 666 or above 899, no group 00, no serial 0000."""
    def nonzero(place: int, most: int) -> Column:
        return (F.pmod(F.substring(digits, place, 1).cast("int"), F.lit(most)) + 1).cast("string")

    return F.concat(nonzero(1, 5), F.substring(digits, 2, 2), nonzero(4, 9), F.substring(digits, 5, 1), nonzero(6, 9), F.substring(digits, 7, 3))


def _pick(values: tuple[str, ...], bits: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_number(bits, at, len(values)) + 1).cast("int"))


def surrogate_of(entity: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity in its plain form (digits without format)."""
    body = F.regexp_replace(entity, r"^[a-z]+:", "")
    bits = _draw(key, entity, attempt)
    size = F.length(body)
    # A surname alone and the same surname behind a given name get the same new surname.
    family = _draw(key, F.concat(F.lit("family:"), F.regexp_extract(body, r"([^\s\u00a0:-]+)$", 1)), attempt)
    script = (F.when(body.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(body.rlike(r"\p{IsGreek}"), F.lit("greek"))
              .otherwise(F.lit("latin")))
    person = F.lit(None).cast("string")
    for (gender, writing), names in GIVEN.items():
        syllables = SYLLABLES[writing]
        surname = F.initcap(F.concat(*[_pick(syllables, family, 1 + 8 * k) for k in range(4)],
                                     F.when(attempt > 0, _pick(syllables, family, 41)).otherwise(F.lit(""))))
        full = F.when(body.rlike(r"^[fm]:[^  -]+[  -]"), F.concat(_pick(names, bits, 1), F.lit(" "), surname)).otherwise(surname)
        person = F.when(body.startswith(f"{gender}:") & (script == writing), full).otherwise(person)
    shape = F.regexp_extract(body, r"@(.*)$", 1)
    mail = F.concat(F.translate(F.substring(bits, 1, 12), "0123456789", "ghijkmnpqr"), F.lit("@"), F.lit("mail"),
                    F.translate(F.substring(bits, 20, 3), "0123456789", "ghijkmnpqr"), F.lit(".example."),
                    F.regexp_extract(shape, r"([a-z]{2,})$", 1))
    ip = F.concat_ws(".", F.lit("10"), *[_number(bits, 1 + 8 * k, 256).cast("string") for k in range(3)])
    # Digit strings keep their first digits where these say country, issuer or check rule.
    phone = F.concat(F.substring(body, 1, 1), _digits(bits, size - 1))
    luhn = _luhn(F.concat(F.substring(body, 1, 1), _digits(bits, size - 2)))
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(bits, 1 + 4 * k, 4) for k in range(6)])
    return (F.when(kind == "iban", _account(body, bits)).when(kind == "ipv6", ipv6).when(kind == "ssn", _social(_digits(bits, F.lit(9)))).otherwise(F.when(kind == "email", mail).when(kind == "name", person).when(kind == "ip", ip).when(kind == "card", luhn)
            .when(kind == "phone", phone).otherwise(_digits(bits, size))))


def formatted(mention: Column, kind: Column, plain: Column) -> Column:
    """A plain surrogate in the format of a mention: its separators, or its title."""
    gaps, digits = F.split(mention, r"\d", -1), F.split(plain, "")
    numbers = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(digits, i), F.lit("")))), "")
    spaced = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c == " ", c).otherwise(
        F.substr(plain, i + 1 - F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^ ]", "")), F.lit(1)))), "")
    title = F.regexp_extract(mention, rf"^((?:{_TITLE})\.?[  ])", 1)
    return (F.when(kind.isin("phone", "ssn", "card"), numbers).when(kind == "iban", spaced)
            .when(kind == "name", F.concat(title, plain)).otherwise(plain))


def _bare(mention: Column, plain: Column) -> Column:
    """The full name and the family name of a titled mention as patterns, longest first, with what replaces them."""
    name = F.regexp_replace(mention, rf"^(?:{_TITLE})\.?[ \u00a0]", "")
    family = F.regexp_extract(name, r"([^\s\u00a0-]+)$", 1)

    def entry(said: Column, new: Column) -> Column:
        return F.struct((-F.length(said)).alias("order"), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), said, F.lit(r"\E(?![\p{L}\p{N}])")).alias("pattern"), new.alias("new"))

    return F.array(entry(name, plain), entry(family, F.regexp_extract(plain, r"(\S+)$", 1)))


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """``(entity, kind, plain, attempt)``: distinct surrogates for distinct ``entities(entity, kind)``, none of them an entity.

    Collisions are found by grouping surrogates; all but the smallest entity of a group draw again, and so do surrogates
    that some entity has as its own. A draw that is settled stays, so the rounds shrink quickly.
    """
    own = entities.select(F.col("entity").alias("own")).distinct()
    drawn = cut(entities.select("entity", "kind", F.lit(0).alias("attempt"))
                .withColumn("plain", surrogate_of(F.col("entity"), F.col("kind"), key, F.col("attempt"))), "surrogates")
    for _ in range(DRAWS):
        gender = F.regexp_extract("entity", r"^name:([fm]:)", 1)
        named = drawn.withColumn("new", F.concat("kind", F.lit(":"), gender, F.lower("plain")))
        first = named.groupBy("new").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        clash = (first.where("n > 1").select("new", F.col("first.entity").alias("keeps"))
                 .unionByName(first.join(own, first["new"] == own["own"], "left_semi").select("new", F.lit(None).cast("string").alias("keeps"))))
        clash = clash.groupBy("new").agg(F.when(F.count("keeps") == F.count(F.lit(1)), F.min("keeps")).alias("keeps"))
        wrong = named.join(clash, "new").where(~F.col("entity").eqNullSafe(F.col("keeps"))).select("entity")
        wrong = cut(wrong, "collisions")
        if wrong.isEmpty():
            return drawn
        flagged = drawn.join(wrong.withColumn("again", F.lit(1)), "entity", "left")
        attempt = F.col("attempt") + F.coalesce("again", F.lit(0))
        drawn = cut(flagged.select("entity", "kind", attempt.alias("attempt"), F.when(F.col("again").isNull(), F.col("plain")).otherwise(
            surrogate_of(F.col("entity"), F.col("kind"), key, attempt)).alias("plain")), "surrogates")
    raise RuntimeError("no distinct surrogates: the corpus uses up a format")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of replaced mentions in ``entities``.

    Texts without an entity pass through their scan. For the others, mentions meet their surrogates by a join on the
    entity (frequent ones are split by AQE) and come back as one small map per text, keyed by its digest.
    """
    columns = docs.columns
    count = "entities"
    while count in columns:
        count += "_"
    maybe = F.col(text).rlike(_SOME) | F.col(text).rlike(_TITLED)
    found = docs.withColumn("__mentions", F.when(maybe, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    some = F.size(F.coalesce("__mentions", F.array())) > 0
    with_some = found.where(some).withColumn("__row", F.sha2(F.col(text), 256))
    mentions = cut(with_some.select("__row", F.explode(F.array_distinct("__mentions")).alias("mention")).distinct()
                   .withColumn("kind", kind_of(F.col("mention"))).where("kind is not null")
                   .withColumn("entity", entity_of(F.col("mention"), F.col("kind"))), "mentions")
    drawn = mapping(mentions.select("entity", "kind").distinct(), key)
    told = (mentions.join(drawn.select("entity", "plain"), "entity")
            .select("__row", F.struct("mention", formatted(F.col("mention"), F.col("kind"), F.col("plain")).alias("new")).alias("pair"),
                    F.when(F.col("kind") == "name", _bare(F.col("mention"), F.col("plain"))).alias("bare"))
            .groupBy(F.col("__row").alias("__of")).agg(F.map_from_entries(F.collect_list("pair")).alias("__map"),
                                                       F.array_sort(F.array_distinct(F.flatten(F.collect_list("bare")))).alias("__bare")))
    gaps = F.split(F.col(text), PATTERN, -1)
    # What lies between the mentions may name the same people again; longer names go first.
    plain = lambda g: F.aggregate("__bare", g, lambda said, b: F.regexp_replace(said, b["pattern"], b["new"]))
    swapped = F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when(F.size("__bare") > 0, plain(g)).otherwise(g), F.coalesce(
        F.element_at("__map", F.get("__mentions", i)), F.get("__mentions", i), F.lit("")))), "")
    done = with_some.join(told, with_some["__row"] == told["__of"], "left")
    changed = done.select(*[(F.when(F.col("__map").isNull(), docs[c]).otherwise(swapped).alias(c) if c == text else docs[c]) for c in columns],
                          F.size("__mentions").cast("long").alias(count))
    same = found.where(~some).select(*[docs[c] for c in columns], F.lit(0).cast("long").alias(count))
    return same.unionByName(changed) if len(set(columns)) == len(columns) else same.union(changed)
