"""Personal data replaced by surrogates (DataFrame functions only).

Entities are found by one pattern for all types; each gets a canonical value (an e-mail address in lower case, the digits of
a number, a date as year, month and day), so that different ways to write one entity refer to it alike. A surrogate is drawn
from a keyed hash of type and canonical value: its digits replace digits, its letters replace letters of the same case and
script, signs stay, so the format of each mention is kept. Octets stay octets, card numbers keep their check digit right or
wrong, phone numbers their country code, addresses their kind of street, dates of birth stay dates.

Addresses and names are made of parts with surrogates of their own: the domain of an e-mail address, the given name (of the
same gender and script) and the family name. So "John Smith" and "Mr Smith" keep one family name, as does "Smith" alone in a
text that names them, and mail addresses of one domain stay at one domain.

Collision check, on what is written out: of several entities of a type with one surrogate the first keeps it, and none whose
surrogate is itself an entity of the table; the others draw again until no collision is left. Names and addresses grow by a
letter or syllable from the third attempt on; types of a fixed format do without the second rule from attempt RELAXED and grow
from attempt GROWN on, so that no table is too large. Dates are moved by a keyed permutation of all days and cannot collide.

Only the rows in which something is found are written and joined with the table of replacements, by a hash of the text, so
equal texts share their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import cut

#: Where a session holds the key of the surrogates.
KEY_SETTING = "spark.aptaflow.pii.key"
#: The key of the queries in a session without one: results can be repeated by anyone, so surrogates made with it are no secret.
PUBLIC_KEY = "surrogate-key"
RELAXED, GROWN = 10, 30
# Titles and first names by gender and script.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Monsieur Madame Señor Señora".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Mme Mlle Madame Señora".split()
LATIN_MALE = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Peter Paul Andrew George Hans Karl Jean Pierre Carlos Juan".split()
LATIN_FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Anna Emma Julia Claire Marie Greta Ingrid Carmen Lucia".split()
CYRILLIC_MALE = "Иван Пётр Сергей Дмитрий Николай Андрей Михаил Борис".split()
CYRILLIC_FEMALE = "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана".split()
LATIN_SYLLABLES = "ba be bo da de do fa fe go ha ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split()
CYRILLIC_SYLLABLES = "ба бе бо да де до фа го ка ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то ва ве за зо".split()
# Further first names that are recognised, kinds of streets, and what stands before a name or a date of birth.
MORE_MALE = "Chen Wei Ahmed Mohammed Omar Raj Arjun Hiroshi Kenji Luis José Miguel Ivan Lars Erik Giovanni Marco Kevin Brian Steven".split()
MORE_FEMALE = "Alice Emily Olivia Sophia Laura Priya Mei Fatima Aisha Yuki Sofia Elena Nina Hannah Chloe Camille Ana Isabel Katarina Ingeborg".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square".split()
BEFORE_NAMES = ["[Nn]ame is ", "[Nn]ame: ", "[Cc]ontact ", "Dear ", "[Rr]egards, ", "[Ss]incerely, ", "[Ss]igned, ", "[Aa]uthor: ", "From: ", "I am ", "I'm "]
BEFORE_BIRTHS = ["[Bb]orn ", "[Bb]orn on ", "DOB ", "DOB: ", "of birth ", "of birth: ", "geboren am ", "née? le "]
FIRST_NAMES = LATIN_MALE + LATIN_FEMALE + CYRILLIC_MALE + CYRILLIC_FEMALE + MORE_MALE + MORE_FEMALE
FEMALE_NAMES = LATIN_FEMALE + CYRILLIC_FEMALE + MORE_FEMALE
_CAPITAL = r"\p{Lu}[\p{Ll}'’-]+"
_TITLE = rf"(?:{'|'.join(TITLES)})\.? "
_NAME = rf"(?:{_TITLE}(?:{_CAPITAL} )?{_CAPITAL}|(?:{'|'.join(FIRST_NAMES)}) {_CAPITAL}|(?=\p{{Lu}})(?<={'|'.join(BEFORE_NAMES)}){_CAPITAL} {_CAPITAL})(?![\p{{L}}])"
EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
SECRET = r"(?:[0-9a-fA-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xox[bp])[_-][0-9A-Za-z_-]{16,})"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?"
IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])"
IPV6 = r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:fe80|[23][0-9a-fA-F]{3}|fd[0-9a-fA-F]{2}):(?:[0-9a-fA-F]{1,4}:){0,6}(?::[0-9a-fA-F]{1,4}){1,6}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
ADDRESS = rf"[1-9][0-9]{{0,4}} (?:{_CAPITAL} ){{1,3}}(?:{'|'.join(STREETS)})"
DATE = r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Types in the order in which a value is tried.
TYPES = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ip": IP, "ipv6": IPV6, "date": DATE, "ssn": SSN, "phone": PHONE, "address": ADDRESS, "card": CARD, "name": r"[^0-9@]+"}
_EDGED = "|".join(f"(?:{TYPES[k]})(?![\\p{{L}}\\p{{N}}])" for k in ("secret", "iban", "ipv6", "ip", "ssn", "phone", "address"))
_BORN = rf"(?=[0-9])(?<={'|'.join(BEFORE_BIRTHS)})(?:{DATE})(?![\p{{L}}\p{{N}}])"
PATTERN = rf"(?<![\p{{L}}\p{{N}}._%+-]){EMAIL}|(?<![\p{{L}}\p{{N}}])(?<![0-9]\.)(?:{_BORN}|{_EDGED}|{_NAME})|(?<![0-9]){CARD}(?![0-9])"
#: What every entity has: a digit, an at sign, the start of a secret, 32 letters a-f (a secret needs no digit), two groups of an
#: address without digits, or a name.
HINT = rf"[0-9@]|(?:AKIA|ASIA)[A-Z]{{16}}|(?:ghp|gho|sk|pk|xox[bp])[_-]|[a-fA-F]{{32}}|[a-fA-F]:[a-fA-F:]|(?<![\p{{L}}\p{{N}}]){_NAME}"
#: A prime number of days from 1900 on, which dates of birth are permuted within.
DAYS, DAY_0 = 73_061, "1900-01-01"


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in TYPES.items():
        hit = value.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("card"))


def _day(value: Column) -> Column:
    """The day that a date names: year first, else day first, else month first; of no such day the one that the parts come to."""
    part = lambda pattern, i: F.regexp_extract(value, pattern, i).try_cast("int")
    iso, other = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{2})[./]([0-9]{2})[./]([0-9]{4})$"
    swapped = part(other, 2) > 12
    year = F.coalesce(part(iso, 1), part(other, 3))
    month = F.coalesce(part(iso, 2), F.when(swapped, part(other, 1)).otherwise(part(other, 2)))
    day = F.coalesce(part(iso, 3), F.when(swapped, part(other, 2)).otherwise(part(other, 1)))
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


def canonical(kind: Column, value: Column) -> Column:
    country = _country(value)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "secret", "ipv6", "address"), F.lower(value))
        .when(kind == "phone", F.concat(country, F.when(country != "", " ").otherwise(""), digits(F.substring(value, F.length(country) + 1, F.length(value)))))
        .when(kind.isin("card", "ssn"), digits(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "date", _day(value).cast("string"))
        .otherwise(value)
    )


def _country(value: Column) -> Column:
    return F.regexp_extract(value, r"^(\+[0-9]{1,3})(?=[ .(-])", 1)


def _bare(value: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(value, rf"^{_TITLE}", "")


def parts(kind: Column, value: Column) -> Column:
    """An array of the parts (kind, canonical) of a mention that have surrogates of their own."""
    bare = _bare(value)
    given, title = F.when(bare.contains(" "), F.substring_index(bare, " ", 1)), F.regexp_extract(value, r"^(\p{L}+)", 1)
    cyrillic = bare.rlike(r"\p{IsCyrillic}")
    told = F.when(title.isin(*FEMALE_TITLES), True).when(title.isin(*[x for x in TITLES if x not in FEMALE_TITLES and x not in ("Dr", "Prof")]), False)
    woman = F.coalesce(F.when(given.isin(*FEMALE_NAMES), True).when(given.isin(*FIRST_NAMES), False), told, cyrillic & bare.rlike("[ая]$"))
    sort = F.concat(F.when(cyrillic, "c").otherwise("l"), F.when(woman, "f").otherwise("m"))
    family = F.struct(F.concat(F.lit("family "), F.substring(sort, 1, 1)).alias("kind"), F.lower(F.substring_index(bare, " ", -1)).alias("canonical"))
    first = F.struct(F.concat(F.lit("given "), sort).alias("kind"), F.lower(given).alias("canonical"))
    domain = F.struct(F.lit("domain").alias("kind"), F.lower(F.substring_index(value, "@", -1)).alias("canonical"))
    none = F.array().cast("array<struct<kind:string,canonical:string>>")
    return F.when(kind == "email", F.array(domain)).when((kind == "name") & given.isNotNull(), F.array(family, first)).when(kind == "name", F.array(family)).otherwise(none)


def _stream(key: str, *of: Column) -> Column:
    """384 hex digits from the key and some values."""
    return F.concat(*[F.sha2(F.concat_ws("\u0001", F.lit(f"{key}{i}"), *of), 512) for i in range(3)])


def _byte(stream: Column, i: Column) -> Column:
    """Byte i of the stream, which is read round and round."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(192)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], byte: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), F.pmod(byte, F.lit(len(options))))


def _shaped(value: Column, stream: Column, hexed: Column | bool = False) -> Column:
    """value with its letters and digits drawn from the stream, the n-th of them from byte n."""
    chars = F.filter(F.split(value, "", -1), lambda c: c != "")

    def of(c: Column, i: Column) -> Column:
        n = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        byte = _byte(stream, n)
        digit = F.pmod(byte, F.lit(10)).cast("string")
        letter = lambda first, count: F.chr(F.lit(ord(first)) + F.pmod(byte, F.lit(count)))
        hex_digit = F.substring(F.lit("0123456789abcdef"), F.pmod(byte, F.lit(16)) + 1, F.lit(1))
        plain = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter("a", 26)).when(c.rlike("[A-Z]"), letter("A", 26)).when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.lower(c), _pick(list("абвгдежзиклмнопрст"), byte)).otherwise(F.upper(_pick(list("абвгдежзиклмнопрст"), byte)))).when(c.rlike(r"\p{Ll}"), letter("a", 26)).when(c.rlike(r"\p{Lu}"), letter("A", 26)).otherwise(c)
        return F.when(F.lit(hexed) if isinstance(hexed, bool) else hexed, F.when(c.rlike("[0-9a-f]"), hex_digit).when(c.rlike("[A-F]"), F.upper(hex_digit)).otherwise(plain)).otherwise(plain)

    return F.concat_ws("", F.transform(chars, of))


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits by the Luhn rule."""
    row = F.reverse(F.filter(F.split(digits, "", -1), lambda c: c != ""))
    doubled = F.transform(row, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _letters(stream: Column, n: Column, to: str) -> Column:
    """n more signs."""
    return F.translate(F.substring(F.reverse(stream), F.lit(1), n), "0123456789abcdef", to)


LETTERS, DIGITS = "bcdfghjklmnpqrst", "0123456789012345"


def drawn_part(kind: Column, value: Column, stream: Column, grown: Column) -> Column:
    """The surrogate of a part: a domain as written, a family name, a given name."""
    join = lambda sep, n, options, first: F.concat_ws(sep, F.transform(F.sequence(F.lit(first), n), lambda i: _pick(options, _byte(stream, i))))
    family = lambda options: F.initcap(join("", grown + 4, options, 0))
    given = lambda options: join("-", grown, options, 0)
    domain = F.concat(_shaped(F.regexp_extract(value, r"^(.*)\.[^.]*$", 1), stream), _letters(stream, grown, LETTERS), F.lit("."), F.substring_index(value, ".", -1))
    return (
        F.when(kind == "domain", domain)
        .when(kind == "family c", family(CYRILLIC_SYLLABLES))
        .when(kind == "family l", family(LATIN_SYLLABLES))
        .when(kind == "given cf", given(CYRILLIC_FEMALE))
        .when(kind == "given cm", given(CYRILLIC_MALE))
        .when(kind == "given lf", given(LATIN_FEMALE))
        .otherwise(given(LATIN_MALE))
    )


def drawn(kind: Column, value: Column, stream: Column, grown: Column, key: str) -> Column:
    """The surrogate of a mention that has no parts, and of what stands before the @ of an address."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    shaped = _shaped(value, stream)
    # the last digit makes the sum of a right number right
    body = F.regexp_replace(shaped, r"[0-9]([^0-9]*)$", "0$1")
    last = F.pmod(10 - F.pmod(_luhn(F.regexp_replace(body, "[^0-9]", "")), F.lit(10)), F.lit(10))
    card = F.when((digits != "") & (F.pmod(_luhn(digits), F.lit(10)) == 0), F.regexp_replace(body, F.lit(r"0([^0-9]*)$"), F.concat(last.cast("string"), F.lit("$1")))).otherwise(shaped)
    octet = lambda i: F.when(F.lit(i == 0), F.pmod(_byte(stream, F.lit(i)), F.lit(223)) + 1).otherwise(F.pmod(_byte(stream, F.lit(i)), F.lit(254)) + 1).cast("string")
    country = _country(value)
    rest = _shaped(F.substring(value, F.length(country) + 1, F.length(value)), stream)
    number = lambda i: F.conv(F.substring(F.sha2(F.lit(f"{key} days {i}"), 256), 1, 12), 16, 10).cast("long")
    moved = F.pmod(F.datediff(_day(value), F.lit(DAY_0).cast("date")).cast("long") * (F.pmod(number(0), F.lit(DAYS - 1)) + 1) + number(1), F.lit(DAYS))
    day = F.date_add(F.lit(DAY_0).cast("date"), moved.cast("int"))
    separator = F.regexp_extract(value, "[./-]", 0)
    swapped = F.regexp_extract(value, r"^[0-9]{2}[./]([0-9]{2})", 1).try_cast("int") > 12
    date = F.when(separator == "-", F.date_format(day, "yyyy-MM-dd")).when(F.coalesce(swapped, F.lit(False)), F.date_format(day, "MM/dd/yyyy")).otherwise(F.replace(F.date_format(day, "dd.MM.yyyy"), F.lit("."), separator))
    street = F.concat(F.substring(shaped, F.lit(1), F.length(shaped) - F.length(F.substring_index(value, " ", -1))), F.substring_index(value, " ", -1))
    return (
        F.when(kind == "email", F.concat(_shaped(F.substring_index(value, "@", 1), stream), _letters(stream, grown, LETTERS)))
        .when(kind == "ip", F.concat(F.concat_ws(".", *[octet(i) for i in range(4)]), _letters(stream, grown, DIGITS)))
        .when(kind == "card", F.concat(card, _letters(stream, grown, DIGITS)))
        .when(kind == "phone", F.concat(country, rest, _letters(stream, grown, DIGITS)))
        .when(kind == "date", date)
        .when(kind == "address", F.concat(F.regexp_replace(F.substring(street, F.lit(1), F.lit(1)), "0", "1"), F.substring(street, F.lit(2), F.length(street))))
        .when((kind == "ipv6") | ((kind == "secret") & value.rlike("^[0-9a-fA-F]+$")), F.concat(_shaped(value, stream, True), _letters(stream, grown, DIGITS)))
        .otherwise(F.concat(shaped, _letters(stream, grown, DIGITS)))
    )


def _shown(kind: Column, made: Column) -> Column:
    """What two surrogates must not share: what is written out, without signs and capitals."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(made, "[^0-9]", "")).otherwise(F.lower(made))


#: Types whose surrogates may grow at once.
FREE = ["email", "domain", "family c", "family l", "given cf", "given cm", "given lf", "given lm"]


def entities(found: DataFrame, key: str, make) -> DataFrame:
    """(kind, canonical, context, stream, grown) of distinct (kind, canonical, context), without collisions.

    make(kind, canonical, stream, grown): the surrogate; those of one kind and context must differ. The context of an e-mail
    address is its domain, that of others is empty.
    """
    names = ["kind", "context", "canonical"]
    todo = cut(found.select(*names).distinct())
    own = todo.select("kind", "context", _shown(F.col("kind"), F.col("canonical")).alias("shown")).distinct().withColumn("taken", F.lit(True))
    done, attempt = None, 0
    while True:
        free = F.col("kind").isin(*FREE)
        now = todo.withColumn("stream", _stream(key, *[F.col(c) for c in names], F.lit(str(attempt)))).withColumn("grown", F.when(free, max(0, attempt - 2)).otherwise(max(0, attempt - GROWN)))
        now = now.withColumn("shown", _shown(F.col("kind"), make(F.col("kind"), F.col("canonical"), F.col("stream"), F.col("grown")))).withColumn("old", F.lit(0))
        every = now if done is None else done.withColumn("old", F.lit(-1)).unionByName(now)
        # what an earlier attempt settled stays
        place = F.row_number().over(Window.partitionBy("kind", "context", "shown").orderBy("old", "canonical"))
        every = every.withColumn("place", place).join(own, ["kind", "context", "shown"], "left")
        open_to = F.col("taken").isNull() | (~free & F.lit(attempt >= RELAXED)) | (F.col("kind") == "date")
        every = cut(every.withColumn("good", (F.col("old") == -1) | ((F.col("place") == 1) & open_to)).select(*names, "stream", "grown", "shown", "good"))
        done = every.filter("good").drop("good")
        todo = every.filter("not good").select(*names)
        if todo.isEmpty():
            return done.select(*names, "stream", "grown")
        attempt += 1


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(value, kind, new, family, family_new) of mentions (value, kind, canonical)."""
    values = values.withColumn("parts", parts(F.col("kind"), F.col("value")))
    each = values.select(F.explode("parts").alias("p")).select("p.kind", "p.canonical", F.lit("").alias("context")).distinct()
    made = cut(entities(each, key, drawn_part).select(F.struct("kind", "canonical").alias("part"), "stream", "grown"))
    for i in (0, 1):
        given = made.select(F.col("part").alias(f"part{i}"), F.struct("stream", "grown").alias(f"draw{i}"))
        values = values.withColumn(f"part{i}", F.get("parts", F.lit(i))).join(given, f"part{i}", "left")
    values = cut(values.withColumn("context", F.when(F.col("kind") == "email", F.col("part0.canonical")).otherwise(F.lit(""))))
    own = entities(values.filter("kind <> 'name'"), key, lambda kind, value, stream, grown: drawn(kind, value, stream, grown, key))
    values = values.join(own, ["kind", "context", "canonical"], "left")
    value, kind = F.col("value"), F.col("kind")
    part = lambda i, of: drawn_part(F.col(f"part{i}.kind"), of, F.col(f"draw{i}.stream"), F.col(f"draw{i}.grown"))
    title, family = F.regexp_extract(value, rf"^({_TITLE})", 1), part(0, value)
    name = F.concat(title, F.when(F.col("part1").isNotNull(), F.concat(part(1, value), F.lit(" "))).otherwise(F.lit("")), family)
    plain = drawn(kind, value, F.col("stream"), F.col("grown"), key)
    new = F.when(kind == "name", name).when(kind == "email", F.concat(plain, F.lit("@"), part(0, F.substring_index(value, "@", -1)))).otherwise(plain)
    is_name = kind == "name"
    return cut(values.select("value", "kind", new.alias("new"), F.when(is_name, F.substring_index(_bare(value), " ", -1)).alias("family"), F.when(is_name, family).alias("family_new")))


def session_key(spark: SparkSession) -> str | None:
    return spark.conf.get(KEY_SETTING, None)


def replace(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """docs with surrogates in ``text``, and, if ``count`` is given, the number of mentions replaced in that column.

    key: the secret of the surrogates; without one that of the session (KEY_SETTING) holds, and if there is none either, an
    error is raised. Null and empty texts and texts without entities stay as they are. One key gives the same surrogates for
    the same table; a surrogate can differ between tables where a collision had to be resolved. Equal texts come out equal,
    repeated rows stay, other columns are kept whatever their names (those starting with ``_pii_`` are replaced). An empty table
    gives an empty one. Texts are read whole, one row in memory at a time.
    """
    key = key or session_key(docs.sparkSession)
    if not key:
        raise ValueError(f"surrogates need a key: give one or set {KEY_SETTING}")
    names = [c for c in docs.columns if c != count]
    body = F.col(f"`{text}`")
    hit = F.coalesce(body.rlike(HINT), F.lit(False))
    # rows with mentions are written, as they are read twice; others pass by
    some = cut(docs.filter(hit).withColumn("_pii_found", mentions(body)).filter(F.size("_pii_found") > 0).withColumn("_pii_key", F.sha2(body, 256)))
    found = some.select("_pii_key", F.explode(F.array_distinct("_pii_found")).alias("value")).distinct()
    found = cut(found.withColumn("kind", kind_of(F.col("value"))).withColumn("canonical", canonical(F.col("kind"), F.col("value"))))
    made = surrogates(found.select("value", "kind", "canonical").distinct(), key)
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    maps = found.select("_pii_key", "value").join(made, "value").groupBy("_pii_key").agg(
        F.map_from_entries(F.collect_list(pair("value", "new"))).alias("_pii_map"),
        F.sort_array(F.collect_set(F.when(F.col("family").isNotNull(), pair("family", "family_new")))).alias("_pii_families"),
    )
    # the text between the mentions, in which the families named stand alone at times
    alone = lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}@.])"), f["a"], F.lit(r"(?![\p{L}\p{N}@])")), f["b"])
    pieces = F.transform(F.split(body, PATTERN, -1), lambda t: F.aggregate("_pii_families", t, alone))
    new = F.concat(F.transform("_pii_found", lambda v: F.element_at(F.col("_pii_map"), v)), F.array(F.lit("")))
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, new, lambda a, b: F.array(a, b))))
    changed = some.join(maps, "_pii_key", "left").withColumn("_pii_text", joined)
    more = [F.size("_pii_found").cast("long").alias(count)] if count else []
    out = changed.select(*[F.col("_pii_text").alias(c) if c == text else F.col(f"`{c}`") for c in names], *more)
    rest = docs.filter(~(hit & F.coalesce(body.rlike(PATTERN), F.lit(False)))).select(*[F.col(f"`{c}`") for c in names], *([F.lit(0).cast("long").alias(count)] if count else []))
    return out.unionByName(rest)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, key=session_key(spark) or PUBLIC_KEY, count="n_entities")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced, see replace(); n_chars, if there is such a column, follows the text, null stays."""
    out = replace(docs, key=session_key(spark) or PUBLIC_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
