"""PII surrogates.

Entities are found by one regular expression. Each distinct entity - in a
canonical form, so that spellings of one phone number or letter cases of one
address or name stay one entity - gets a replacement drawn from a keyed digest:
digits for digits, letters for letters of the same script and case, given names
of the same gender and script, addresses of reserved domains, card and account
numbers with check digits as valid as before, hexadecimal for hexadecimal.

A name is known from a titled mention. It has one replacement whatever the
title; its gender is that of its titles, `any` if they differ or tell none. In
a text with a titled given name and surname, the same two words without a title
are replaced too. A surname alone is replaced only behind a title.

Two different entities never share a replacement and no replacement is itself
an entity of the input, letter case aside: those that clash are drawn again with the next attempt
number until none does. The draw depends on key, entity and attempt alone, so
the same entity has the same replacement wherever it stands.

Everything is DataFrame functions. Only documents with an entity are shuffled;
the distinct entities are aggregated map-side before the shuffle, so that a
frequent entity costs no more than a rare one, and Spark may split it when
replacements are joined back, as they have one row for each entity.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, table, written

# What entities look like.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}"
PHONE = r"(?<![\d+.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
FOREIGN_PHONE = r"(?<![\d+.])\+[1-9]\d{0,2}(?:[ .-]\(?\d{1,5}\)?){2,5}(?!\d)|(?<![\d+.])\+[1-9]\d{8,14}(?!\d)"
CARD = r"(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)|(?<![\d.])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
IP6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[0-9A-Za-z_\-+/]{8,128}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?\d{4}| ?[A-Z]{4}\d{0,4}){3,7}(?: ?\d{1,3})?(?![A-Za-z0-9])"
TITLE = r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Sr\.|Sra\.|Mme\.?|Herr|Frau|Monsieur|Madame|Señora|Señor|[Гг]осподин|[Гг]оспожа)"
NAME = rf"(?<!\p{{L}}){TITLE} \p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?"
FULL_NAME = rf"(?<!\p{{L}}){TITLE} (\p{{Lu}}\p{{L}}{{1,30}} \p{{Lu}}\p{{L}}{{1,30}})"
ENTITY = "|".join([EMAIL, SECRET, ACCESS_KEY, CARD, PHONE, SSN, IP, IBAN, NAME, FOREIGN_PHONE, IP6])
#: What every entity has one of, but for those that a digit or an @ gives away: key words in lower case, and titles.
KEY_WORDS = ("passw", "pwd", "token", "secret", "key")
TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Sr. ", "Sra. ", "Mme", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor", "осподин ", "оспожа ")
# Given names by gender and script, syllables of made-up surnames, letters.
GIVEN = {
    "male_latin": "Adam Albert Anton Bruno Carlo Daniel David Edgar Emil Felix George Henry Hugo Ivan Jacob Leo Louis Mark Martin Oscar Paul Peter Simon Victor",
    "female_latin": "Ada Alice Anna Bella Carla Clara Diana Elena Emma Eva Flora Grace Helen Ida Iris Julia Laura Lucy Maria Nina Olga Rosa Sara Vera",
    "any_latin": "Alex Andrea Ariel Casey Dana Eden Jamie Jordan Kim Lee Logan Morgan Noel Quinn Robin Sam Sasha Sidney Taylor Toni",
    "male_cyrillic": "Алексей Андрей Антон Борис Виктор Глеб Денис Иван Лев Марк Олег Роман",
    "female_cyrillic": "Алла Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Софья",
    "any_cyrillic": "Саша Женя Валя Слава",
}
SYLLABLES = {"latin": "ba be bo da den dor el fa fer gan hal han jor ka kel lan lin mar men mo nel nor or pel ran ros sen ta ter vin wal", "cyrillic": "ба бе во го дан ев жи за ин ко лев ма ни ор пе ра се то ур фе"}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω")
MOST_ATTEMPTS = 24
#: Session setting with the key, and the key of sessions without one: it protects nothing.
KEY_SETTING, OPEN_KEY = "spark.basketry.pii.key", "published with the source"


def session_key(spark: SparkSession) -> str:
    """The key that the session names; where it names none, a published one, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: anyone can draw these surrogates again", stacklevel=2)
    return key or OPEN_KEY


def _byte(digest: Column, i) -> Column:
    """Byte i (from 0, around after 64) of a digest and the digest of that."""
    longer = F.concat(digest, F.sha2(digest, 256))
    return F.conv(F.substring(longer, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, *parts: Column) -> Column:
    text = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    return F.sha2(F.concat(F.lit(key), F.sha2(text, 256)), 256)


def _letters(text: Column, digest: Column, alphabets=ALPHABETS) -> Column:
    """Each character of an alphabet becomes another one of the same alphabet."""

    def one(x: Column, i: Column) -> Column:
        out = x
        for letters in reversed(alphabets):
            drawn = F.substring(F.lit(letters), F.pmod(_byte(digest, i) + i, F.lit(len(letters))) + 1, F.lit(1))
            out = F.when(F.instr(F.lit(letters), x) > 0, drawn).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), one), "")


def _luhn_digit(digits: Column) -> Column:
    """The check digit of a number without one."""
    n = F.length(digits)
    each = F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x, i: F.when(F.pmod(n - i, F.lit(2)) == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def _check_digits(country: Column, account: Column) -> Column:
    """The two check digits of an account number without them: 98 less the number, country last, modulo 97."""
    number = F.concat(account, country, F.lit("00"))
    added = lambda rest, x: F.when(x.rlike("[0-9]"), (rest * 10 + x.cast("int")) % 97).otherwise((rest * 100 + F.ascii(x) - 55) % 97)
    return F.lpad((98 - F.aggregate(F.filter(F.split(number, ""), lambda x: x != ""), F.lit(0), added)).cast("string"), 2, "0")


def _pick(words: str, at: Column) -> Column:
    listed = words.split()
    return F.element_at(F.array(*map(F.lit, listed)), (F.pmod(at, F.lit(len(listed))) + 1).cast("int"))


def surrogate(key: str, kind: Column, entity: Column, gender: Column, attempt: Column) -> Column:
    """The replacement of a canonical entity; gender is that of a given name."""
    d = _digest(key, kind, entity, attempt)
    number = lambda i: _byte(d, F.lit(i)) * 256 + _byte(d, F.lit(i + 1))
    digits = _letters(entity, d, ALPHABETS[:1])
    phone = F.concat((F.pmod(_byte(d, F.lit(20)), F.lit(8)) + 2).cast("string"), F.substring(digits, F.lit(2), F.lit(2)), (F.pmod(_byte(d, F.lit(21)), F.lit(8)) + 2).cast("string"), F.substring(digits, F.lit(5), F.lit(20)))
    front = F.concat(F.substring(entity, 1, 1), F.substring(digits, F.lit(2), F.length(entity) - 2))
    was = F.substring(entity, F.lit(1), F.length(entity) - 1)
    valid = _luhn_digit(was) == F.substring(entity, -1, 1)
    last = _luhn_digit(front)
    card = F.concat(front, F.when(valid, last).otherwise(F.pmod(last.cast("int") + 1 + F.pmod(_byte(d, F.lit(30)), F.lit(9)), F.lit(10)).cast("string")))
    octet = lambda x, i: F.when(F.length(x) == 3, 100 + F.pmod(_byte(d, i), F.lit(156))).when(F.length(x) == 2, 10 + F.pmod(_byte(d, i), F.lit(90))).otherwise(F.pmod(_byte(d, i), F.lit(10)))
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda x, i: octet(x, i).cast("string")), ".")
    host = F.substring_index(F.substring_index(entity, "@", -1), ".", 1)
    of_domain = _digest(key, F.lit("domain"), F.substring_index(entity, "@", -1))
    email = F.concat(_letters(F.substring_index(entity, "@", 1), d), F.lit("@"), _letters(host, of_domain), F.lit(".example."), _pick("com net org", _byte(of_domain, F.lit(31))))
    country, old = F.substring(entity, 1, 2), F.substring(entity, F.lit(5), F.lit(64))
    account = _letters(old, d)
    right = _check_digits(country, account)
    wrong = F.lpad((F.pmod(right.cast("int") + 1 + F.pmod(_byte(d, F.lit(30)), F.lit(90)), F.lit(97)) + 2).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_check_digits(country, old) == F.substring(entity, 3, 2), right).otherwise(wrong), account)
    foreign = F.concat(F.substring(entity, 1, 2), _letters(F.substring(entity, F.lit(3), F.lit(64)), d, ALPHABETS[:1]))
    access = F.concat(F.substring(entity, 1, 4), _letters(F.substring(entity, F.lit(5), F.lit(64)), d, ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",)))
    hexadecimal = _letters(entity, d, ("0123456789abcdef",))
    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind.isin("hex", "ip6"), hexadecimal).when(kind == "foreign_phone", foreign).when(kind == "access_key", access).when(kind == "iban", iban)
    for script, syllables in SYLLABLES.items():
        made = F.initcap(F.concat(_pick(syllables, number(0)), _pick(syllables, number(2)), F.when(_byte(d, F.lit(4)) < 128, _pick(syllables, number(5))).otherwise("")))
        out = out.when(kind == f"surname_{script}", made)
        # when the list runs short, longer forms keep names apart
        longer = F.when(attempt > 3, F.concat(_pick(syllables, number(6)), _pick(syllables, number(8)))).otherwise("")
        for listed in ("male", "female", "any"):
            out = out.when((kind == f"given_{script}") & (gender == listed), F.concat(_pick(GIVEN[f"{listed}_{script}"], number(4)), longer))
    drawn = out.otherwise(_letters(entity, d))
    # a format with fewer forms than entities gives up its form, not distinctness
    return F.when(attempt > MOST_ATTEMPTS, F.concat(drawn, F.lit("-"), F.substring(d, 1, 16))).otherwise(drawn)


def _parts(surface: Column) -> Column:
    """An entity as it stands, as an array of (kind, entity, gender, text) parts; parts without a kind stay as they are."""
    none, digits = F.lit(None).cast("string"), F.regexp_replace(surface, r"\D", "")
    part = lambda kind, entity, text, gender=none: F.struct(kind.alias("kind"), entity.alias("entity"), gender.alias("gender"), text.alias("text"))
    whole = lambda kind, entity=surface: F.array(part(F.lit(kind), entity, surface))
    value = F.regexp_extract(surface, r"([0-9A-Za-z_\-+/]{8,128})$", 1)
    hexed = F.when(value.rlike("^[0-9a-f]+$"), "hex").otherwise("secret")
    secret = F.array(part(none, none, F.substring(surface, F.lit(1), F.length(surface) - F.length(value))), part(hexed, value, value))
    title = F.regexp_extract(surface, rf"^({TITLE} )", 1)
    words = F.split(F.substring(surface, F.length(title) + 1, F.lit(100)), " ")
    script = F.when(surface.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(title.rlike(r"^(Mr\.|Sr\.|Herr|Monsieur|Señor |.осподин)"), "male").when(title.rlike(r"^(Mrs|Ms|Sra|Mme|Frau|Madame|Señora|.оспожа)"), "female")
    given = part(F.concat(F.lit("given_"), script), F.lower(words[0]), words[0], gender)
    last = F.element_at(words, -1)
    surname = part(F.concat(F.lit("surname_"), script), F.lower(last), last)
    name = F.when(F.size(words) == 2, F.array(part(none, none, title), given, part(none, none, F.lit(" ")), surname)).otherwise(F.array(part(none, none, title), surname))
    return (
        F.when(surface.rlike(f"^(?:{EMAIL})$"), whole("email", F.lower(surface))).when(surface.rlike(f"^(?:{SECRET})$"), secret).when(surface.rlike(f"^(?:{ACCESS_KEY})$"), whole("access_key"))
        .when(surface.rlike(f"^(?:{CARD})$"), whole("card", digits)).when(surface.rlike(f"^(?:{PHONE})$"), whole("phone", F.substring(digits, -10, 10))).when(surface.rlike(f"^(?:{SSN})$"), whole("ssn", digits))
        .when(surface.rlike(f"^(?:{IP})$"), whole("ip")).when(surface.rlike(f"^(?:{IBAN})$"), whole("iban", F.regexp_replace(surface, " ", "")))
        .when(surface.rlike(f"^(?:{FOREIGN_PHONE})$"), whole("foreign_phone", digits)).when(surface.rlike(f"^(?:{IP6})$"), whole("ip6", F.lower(surface))).otherwise(name)
    )


def _rendered(kind: Column, text: Column, drawn: Column) -> Column:
    """A replacement in the format of the text it stands for: its separators, its extra leading digits, its capitals."""
    have = F.regexp_replace(text, r"[^0-9A-Z]", "")
    chars = F.concat(F.substring(have, F.lit(1), F.greatest(F.length(have) - F.length(drawn), F.lit(0))), drawn)
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), r"[^0-9A-Z]", ""))
    formatted = F.array_join(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x, i: F.when(x.rlike("[0-9A-Z]"), F.substring(chars, place(i), F.lit(1))).otherwise(x)), "")
    fits = F.length(drawn) <= F.length(have)
    return F.when(kind.isin("phone", "foreign_phone", "card", "ssn", "iban") & fits, formatted).when(kind.rlike("^(given|surname|ip6)") & (F.upper(text) == text), F.upper(drawn)).otherwise(drawn)


def has_entity(text: Column) -> Column:
    """Whether a text has an entity. Most texts have nothing that an entity needs, which plain searches tell without the expression."""
    low = F.lower(text)
    maybe = text.rlike("[0-9@]")
    for word in KEY_WORDS:
        maybe = maybe | low.contains(word)
    for title in TITLES:
        maybe = maybe | text.contains(title)
    return F.coalesce(maybe & text.rlike(ENTITY), F.lit(False))


def _space(kind: Column) -> Column:
    """Entities of which space a replacement must not be: all names count as one kind."""
    return F.when(kind.rlike("^(given|surname)"), "name").otherwise(kind)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct rows of (kind, entity, gender): no two entities share a surrogate, and none is an entity, letter case aside."""
    n = shuffle_partitions(entities.sparkSession)
    space = _space(F.col("kind")).alias("space")
    known = entities.select(space, F.lower("entity").alias("form")).distinct()
    attempt, open_, done = 0, entities.select("kind", "entity", "gender"), None
    while True:
        # dealt by entity first: the draw is the work, and a small table may be one partition
        drawn = open_.repartition(n, "kind", "entity").withColumn("surrogate", surrogate(key, F.col("kind"), F.col("entity"), F.col("gender"), F.lit(attempt)))
        drawn = drawn.withColumns({"space": space, "form": F.lower("surrogate")})
        same = Window.partitionBy("space", "form").orderBy("kind", "entity")
        ranked = drawn.withColumn("place", F.row_number().over(same))
        taken = known if done is None else known.union(done.select(space, F.lower("surrogate"))).distinct()
        judged = ranked.join(taken.withColumn("taken", F.lit(True)), ["space", "form"], "left")
        judged = written(judged.select("kind", "entity", "gender", "surrogate", ((F.col("place") == 1) & F.col("taken").isNull()).alias("good")), "drawn")
        good = judged.where("good").select("kind", "entity", "surrogate")
        done = good if done is None else written(done.union(good), "surrogates")
        open_ = judged.where("not good").select("kind", "entity", "gender")
        if open_.isEmpty():
            return done
        attempt += 1


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with replacements in their texts, and n_entities.

    All columns are kept, whatever their names, but for `n_entities`, which is
    replaced. Null texts stay null and have no entities; null and repeated
    doc_ids and repeated rows keep each row; equal texts stay equal. Long texts
    are read whole. An empty table gives no rows. Whoever has the key can draw the
    surrogates again, so it is to be kept secret.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    has = has_entity(F.col("text"))
    found = written(docs.where(has).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("at", F.monotonically_increasing_id()), "with_entities")
    # the full names of a text, which are letters and a space, join its expression
    titled = F.array_distinct(F.regexp_extract_all(F.col("row.text"), F.lit(FULL_NAME), F.lit(1)))
    bare = F.concat(F.lit(r"|(?<!\p{L})(?=\p{Lu})(?:"), F.array_join("titled", "|"), F.lit(r")(?!\p{L})"))
    found = found.withColumn("titled", titled).withColumn("pattern", F.concat(F.lit(ENTITY), F.when(F.size("titled") > 0, bare).otherwise("")))
    surfaces = F.regexp_extract_all(F.col("row.text"), F.col("pattern"), F.lit(0))
    gaps = F.split(F.col("row.text"), F.col("pattern"), -1)
    nothing = F.lit(None).cast("string")
    gap = lambda x: F.array(F.struct(nothing.alias("kind"), nothing.alias("entity"), nothing.alias("gender"), x.alias("text")))
    split = found.select("at", "row", surfaces.alias("surfaces"), gaps.alias("gaps"))
    pieces = F.concat(gap(F.col("gaps")[0]), F.flatten(F.zip_with("surfaces", F.slice("gaps", F.lit(2), F.size("surfaces")), lambda s, g: F.concat(_parts(s), gap(g)))))
    pieces = written(split.select("at", F.size("surfaces").alias("n_entities"), F.posexplode(pieces).alias("place", "piece")).select("at", "n_entities", "place", "piece.*"), "pieces")
    men, women = (F.max(F.coalesce(F.col("gender") == x, F.lit(False))) for x in ("male", "female"))
    gender = F.when(men & ~women, "male").when(women & ~men, "female").otherwise("any")
    mapping = surrogates(written(pieces.where("kind is not null").groupBy("kind", "entity").agg(gender.alias("gender")), "entities"), key)
    replaced = pieces.join(mapping, ["kind", "entity"], "left")
    replaced = replaced.withColumn("out", F.when(F.col("surrogate").isNull(), F.col("text")).otherwise(_rendered(F.col("kind"), F.col("text"), F.col("surrogate"))))
    texts = replaced.groupBy("at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "out"))), lambda x: x["out"]), "").alias("new_text"), F.first("n_entities").alias("n"))
    changed = found.join(texts, "at").select(*[(F.col("new_text") if c == "text" else F.col("row").getField(c)).alias(c) for c in names], F.col("n").alias("n_entities"))
    return docs.where(~has).withColumn("n_entities", F.lit(0)).unionByName(changed)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
