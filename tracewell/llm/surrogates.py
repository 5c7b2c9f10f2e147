"""Surrogates for personal data, in DataFrame operations alone.

Entities found by patterns are replaced by keyed surrogates of the same type and form: digits for digits, letters
for letters of the same case, valid addresses and check digits, names of the same gender and script. A surrogate
depends on the key and the entity only, so an entity is replaced alike wherever it occurs, and documents need no
shuffle. All entities of the corpus are then compared: two that share a surrogate, or a surrogate that occurs as
an entity, get another try until all differ; only documents that hold such an entity look its tries up. Given and
family names are entities of their own. Further tries draw from larger spaces without end: longer names and numbers,
wider networks, so every entity finds a surrogate.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import stored

BROADCAST_ROWS = 1_000_000
SAME_FORM = 2  # further tries that keep the length of a number and the network of an address
SAME_FAMILY = 5  # further tries that stay with four octets

# Titles by gender and given names by script and gender. Fixed values.
TITLES = {"m": "Mr Sir Herr Monsieur Señor Sr Don Signor г-н", "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Doña Signora г-жа"}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Charles Daniel Peter Hans Karl Stefan Jürgen Pierre Jean Luc Antoine Carlos Juan Luis Miguel Pablo Marco",
    ("latin", "f"): "Mary Anna Susan Linda Karen Emma Julia Laura Sarah Helen Ursula Heike Monika Sabine Marie Claire Sophie Camille María Carmen Lucía Elena Ana Giulia",
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Павел Юрий",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Юлия Екатерина",
}
_SYLLABLES = {"latin": "bar den fal gor hal ker lan mor nel par ral sal tor val wen zan", "cyrillic": "бар ден фал гор зал кер лан мор нел пар рал сал тор вал вен жан"}
_ENDINGS = {("latin", "m"): "son ley man berg ton", ("latin", "f"): "son ley man berg ton", ("cyrillic", "m"): "ов ин ский ев", ("cyrillic", "f"): "ова ина ская ева"}

_titles = "|".join(t for ts in TITLES.values() for t in ts.split())
_given = "|".join(n for ns in GIVEN.values() for n in ns.split())
_edge = r"(?<![\p{L}\p{N}])"
# A part of a name: inner capitals, apostrophes and hyphens, but not the 's after it; or an initial.
_word = r"\p{Lu}(?:[\p{L}\p{M}]|['’]\p{Lu})[\p{L}\p{M}]*+(?:-[\p{L}\p{M}]++|['’]\p{L}[\p{L}\p{M}]++)*+"
_more = rf"(?: (?:\p{{Lu}}\. (?=\p{{Lu}}))*+{_word})"
# A value ends with its closing quote, else before blanks and what closes a phrase there.
_quoted = r"\"(?=[^\"\r\n]{6})(?:[^\"\\\r\n]++|\\.)*+\"|'(?=[^'\r\n]{6})(?:[^'\\\r\n]++|\\.)*+'"
_bare = r"[\"']?(?=[^\s]{6})(?:[^\s\"'`<,;.:)\]}>]++|<(?!/)|[\"'`](?=[\p{L}\p{N}])|[,;.:)\]}>]++(?![\s\"'`<]|\z))++"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ \t]{0,4}[=:][ \t]{0,4}(?:" + f"{_quoted}|{_bare})",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"{_edge}(?:(?:{_titles})\.?{_more}++|(?:{_given})(?:-[\p{{L}}\p{{M}}]++)*+(?!\p{{L}}){_more}++)(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())


def entities(text: Column) -> Column:
    """The entities of a text in order; together with what lies between, they make up the text."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(entity: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _identity(entity: Column, kind: Column) -> Column:
    bare = F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(entity, r"[ .()\-]", ""))
    return F.concat(kind, F.lit(":"), F.coalesce(bare, entity))


def _identities(entity: Column, kind: Column) -> Column:
    """What gets a surrogate of its own: the given names and the family name of a name, else the entity.

    Spellings are one: addresses regardless of case, numbers regardless of separators.
    """
    parts = F.transform(
        F.array(_person(entity)),
        lambda p: F.concat(
            F.transform(p["given"], lambda word: F.concat(F.lit("given:"), p["sort"], F.lit(":"), word)),
            F.array(F.concat(F.lit("family:"), p["sort"], F.lit(":"), p["family"])),
        ),
    )[0]
    return F.when(kind == "name", parts).otherwise(F.array(_identity(entity, kind)))


def _seed(identity: Column, key: str, attempt: Column) -> Column:
    return _stream(F.concat_ws("|", F.lit(key), identity, attempt.cast("string")))


def _stream(seed: Column) -> Column:
    """128 hexadecimal digits."""
    one = F.sha2(seed.cast("binary"), 256)
    return F.concat(one, F.sha2(F.concat(one, seed).cast("binary"), 256))


def _number(stream: Column, at: Column | int, size: int) -> Column:
    """The ``at``-th number below ``size`` of a stream, from 0; it begins again after 32."""
    at = F.lit(at) if isinstance(at, int) else at
    start = (F.pmod(at, F.lit(32)) * 4 + 1).cast("int")
    return F.pmod(F.conv(F.substring(stream, start, F.lit(4)), 16, 10).cast("int"), F.lit(size))


def _mapped(text: Column, stream: Column, separated: bool = False, signs: bool = False) -> Column:
    """Digits for digits and letters for letters, by their place.

    In ``separated`` text the place is the number among both, so separators don't matter. Hexadecimal text stays
    hexadecimal, letters beyond ASCII become ASCII ones, and the first digit is not zero. ``signs`` maps signs as well,
    but for those that divide a text: - _ . / + = : , ; and brackets.
    """

    def one(c: Column, i: Column, whole: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(whole["text"], F.lit(1), i), "[^A-Za-z0-9]", "")) if separated else i
        number = _number(whole["stream"], at, 9 * 26 * 10)
        digit = F.when(at == 0, 1 + F.pmod(number, F.lit(9))).otherwise(F.pmod(number, F.lit(10)))
        letter = F.pmod(number, whole["letters"])
        out = F.when(c.rlike("[0-9]"), digit.cast("string")).when(c.rlike("[a-z]"), F.char(97 + letter)).when(c.rlike("[A-Z]"), F.char(65 + letter))
        out = out.when(c.rlike(r"[^\x00-\x7F]"), F.char(97 + letter))
        return (out.when(c.rlike(r"[!#$%&*?@^~|]"), F.substring(F.lit("#$%&*@^~"), 1 + F.pmod(number, F.lit(8)), F.lit(1))) if signs else out).otherwise(c)

    letters = F.when(text.rlike("^[0-9a-f]*[\"']?$"), F.lit(6)).otherwise(F.lit(26))
    whole = F.array(F.struct(text.alias("text"), stream.alias("stream"), letters.alias("letters")))
    return F.transform(whole, lambda w: F.array_join(F.transform(F.filter(F.split(w["text"], ""), lambda c: c != ""), lambda c, i: one(c, i, w)), ""))[0]


def _luhn(text: Column) -> Column:
    """The Luhn sum of the digits, modulo 10."""
    digits = F.transform(F.filter(F.split(F.reverse(F.regexp_replace(text, "[^0-9]", "")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _picked(words: str, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words.split()]), (index + 1).cast("int"))


def _person(entity: Column) -> Column:
    """What a name consists of: title, script and gender, given names, family name."""
    parts = F.split(entity, " ")
    first = F.regexp_replace(parts[0], r"\.$", "")
    titled = first.isin([t for ts in TITLES.values() for t in ts.split()])
    women = [n for (_, g), ns in GIVEN.items() if g == "f" for n in ns.split()]
    female = F.when(titled, first.isin(TITLES["f"].split())).otherwise(F.substring_index(first, "-", 1).isin(women))
    family = F.element_at(parts, -1)
    return F.struct(
        F.when(titled, parts[0]).alias("title"),
        F.concat(F.when(family.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin")), F.when(female, F.lit("-f")).otherwise(F.lit("-m"))).alias("sort"),
        F.when(titled, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("given"),
        family.alias("family"),
    )


def _part(piece: Column, key: str) -> Column:
    """The surrogate of a given or family name, of the same gender and script.

    The listed given names change places, by the key; others get two of them with a hyphen, family names three
    syllables with an ending. Each further try adds a name or a syllable.
    """
    kind, sort, word = (F.substring_index(F.substring_index(piece["identity"], ":", k + 1), ":", -1) for k in range(3))
    stream, attempt = piece["stream"], piece["attempt"]
    out = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        ring = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|{script}|{gender}|{n}".encode()).digest())
        other = F.element_at(F.create_map(*[F.lit(n) for pair in zip(ring, ring[1:] + ring[:1]) for n in pair]), word)
        several = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda k: _picked(names, _number(stream, k, len(ring)))), "-")  # noqa: B023
        syllables, endings = _SYLLABLES[script], _ENDINGS[script, gender]
        stem = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 3), lambda k: _picked(syllables, _number(stream, k, len(syllables.split())))), "")  # noqa: B023
        family = F.initcap(F.concat(stem, _picked(endings, _number(stream, 0, len(endings.split())))))
        out = F.when(sort == f"{script}-{gender}", F.when(kind == "family", family).otherwise(F.coalesce(other, several))).otherwise(out)
    return out


def surrogates_of(found: Column, key: str, attempt) -> Column:
    """The surrogates of an array of entities; ``attempt`` gives the try of an identity."""
    described = F.transform(found, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    seeded = F.transform(described, lambda s: _seeded(s, key, attempt))
    return F.transform(seeded, lambda s: _replaced(s, key))


def _seeded(s: Column, key: str, attempt) -> Column:
    entity, kind = s["entity"], s["kind"]
    tried = F.transform(_identities(entity, kind), lambda i: F.struct(i.alias("identity"), attempt(i).alias("attempt")))
    pieces = F.transform(tried, lambda t: F.struct(t["identity"].alias("identity"), t["attempt"].alias("attempt"), _seed(t["identity"], key, t["attempt"]).alias("stream")))
    domain = F.lower(F.substring_index(entity, "@", -1))
    site = F.when(kind == "email", _stream(F.concat(F.lit(f"{key}|domain|"), domain)))  # one domain stays one domain
    title = F.when(kind == "name", _person(entity)["title"])
    return F.struct(entity.alias("entity"), kind.alias("kind"), pieces.alias("pieces"), site.alias("site"), title.alias("title"))


def _longer(text: Column, attempt: Column) -> Column:
    """The text with further digits, ahead of a closing quote, after some tries at its own length."""
    more = F.repeat(F.lit("0"), attempt - SAME_FORM)
    closing = F.regexp_extract(text, "[\"']$", 0)
    return F.when(attempt > SAME_FORM, F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(closing)), more, closing)).otherwise(text)


def _address(entity: Column, stream: Column, attempt: Column) -> Column:
    """An address of the same network; then with all values of an octet, of a wider network, and of IPv6."""
    octets = [F.when(attempt == 0, 1 + _number(stream, k, 254)).otherwise(_number(stream, k, 256)).cast("string") for k in range(4)]
    inside = F.regexp_extract(entity, r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 0)
    public = F.concat_ws(".", (11 + _number(stream, 0, 110)).cast("string"), *octets[1:])
    network = F.when(attempt > SAME_FORM, F.lit("10.")).otherwise(inside)
    private = F.concat(network, F.when(network.rlike(r"\..*\."), F.concat_ws(".", *octets[2:])).otherwise(F.concat_ws(".", *octets[1:])))
    groups = [F.substring(stream, 1 + 4 * k, 4) for k in range(7)]
    unique = F.when(inside == "", F.concat_ws(":", F.lit("2001:db8"), *groups[:6])).otherwise(F.concat(F.lit("fd"), F.substring(stream, 29, 2), F.lit(":"), F.concat_ws(":", *groups)))
    return F.when(attempt > SAME_FAMILY, unique).when(inside == "", public).otherwise(private)


def _rest(text: Column, head: Column, stream: Column, **how: bool) -> Column:
    """The head kept, the rest mapped."""
    return F.concat(head, _mapped(F.substring(text, F.length(head) + 1, F.length(text)), stream, **how))


def _replaced(s: Column, key: str) -> Column:
    whole, kind, stream, attempt = s["entity"], s["kind"], s["pieces"][0]["stream"], s["pieces"][0]["attempt"]
    entity = _longer(whole, attempt)
    domain = F.substring_index(whole, "@", -1)
    top = F.substring_index(domain, ".", -1)
    site = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(_mapped(_longer(F.substring_index(whole, "@", 1), attempt), stream), F.lit("@"), _mapped(site, s["site"]), F.lit("."), top)
    country = F.when(entity.startswith("+"), F.coalesce(F.nullif(F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(\-])", 0), F.lit("")), F.substring(entity, 1, 3))).otherwise(F.lit(""))
    made = {
        "email": email,
        "secret": _rest(entity, F.regexp_extract(entity, r"^[A-Za-z_\-]+[ \t]*[=:][ \t]*[\"']?", 0), stream, signs=True),
        "key": _rest(entity, F.regexp_extract(entity, "^(?:AKIA|gh[pousr]_|sk-)", 0), stream),
        "iban": _rest(entity, F.substring(entity, 1, 2), stream, separated=True),
        "ip": _address(whole, stream, attempt),
        "phone": _rest(entity, country, stream, separated=True),
        "card": _checked(whole, _rest(entity, F.substring(entity, 1, 1), stream, separated=True)),
        "ssn": _mapped(entity, stream, separated=True),
    }
    out = F.array_join(F.concat(F.array(s["title"]), F.transform(s["pieces"], lambda p: _part(p, key))), " ")
    for name, value in made.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _checked(entity: Column, made: Column) -> Column:
    """The made number, with a valid check digit if the entity's is."""

    def fixed(card: Column) -> Column:
        short = F.substring(card, F.lit(1), F.length(card) - 1)
        return F.concat(short, F.pmod(10 - _luhn(F.concat(short, F.lit("0"))), F.lit(10)).cast("string"))

    return F.transform(F.array(made), lambda card: F.when(_luhn(entity) == 0, fixed(card)).otherwise(card))[0]


def tries(held: DataFrame, key: str) -> DataFrame:
    """``identity, attempt`` of what needs more than a first try for its surrogate to be its own; ``held`` has the
    arrays of entities as ``found``."""
    found = held.select(F.explode("found").alias("entity")).distinct()
    found = found.withColumn("kind", kind_of(F.col("entity")))
    own = found.select(F.explode(_identities(F.col("entity"), F.col("kind"))).alias("identity"), "entity").groupBy("identity").agg(F.min("entity").alias("entity"))
    own = stored(own.withColumn("attempt", F.lit(0)), "entities")
    # Given names are common to many people, so a surrogate may be another's given name, but not a family name.
    real = own.select(F.col("identity").alias("taken")).where(~F.col("taken").startswith("given:"))
    kind, named = F.substring_index("identity", ":", 1), F.substring_index("identity", ":", 2)
    part = F.struct("identity", "attempt", _seed(F.col("identity"), key, F.col("attempt")).alias("stream"))
    while True:
        whole = surrogates_of(F.array("entity"), key, lambda _: F.col("attempt"))[0]
        made = own.withColumn("surrogate", F.when(kind.isin("given", "family"), _part(part, key)).otherwise(whole))
        made = made.withColumn("name", F.when(kind.isin("given", "family"), F.concat_ws(":", named, "surrogate")).otherwise(_identity(F.col("surrogate"), kind)))
        place = F.row_number().over(Window.partitionBy("name").orderBy("attempt", "identity"))
        made = stored(made.withColumn("place", place).join(real, F.col("name") == F.col("taken"), "left"), "made")
        clash = made.where("place > 1 OR taken IS NOT NULL")
        if clash.isEmpty():
            return own.where("attempt > 0").select("identity", "attempt")
        again = (F.col("place") > 1) | F.col("taken").isNotNull()
        own = made.select("identity", "entity", (F.col("attempt") + again.cast("int")).alias("attempt"))


def with_surrogates(docs: DataFrame, key: str = "tracewell", id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced by its surrogate.

    The same key gives the same surrogates. Spellings of one entity (case of addresses, separators of numbers)
    share one surrogate in their own spelling. Null texts stay null; texts without entities and other columns are
    untouched. ``count_col`` names a column for the number of entities. Rows equal in id and text fare alike.
    """
    text, columns = docs[text_col].cast("string"), [c for c in docs.columns if c != count_col]
    # Written as they are found: an array that an explode reads straight from the texts would be found twice over.
    found = F.coalesce(entities(text), F.array().cast("array<string>"))
    holders = stored(docs.select(docs[id_col].alias("__id"), F.xxhash64(text).alias("__version"), found.alias("found")), "found")
    more = stored(tries(holders, key), "tries")
    rows = docs.select(*columns).withColumn("__found", found)
    if more.isEmpty():
        attempt = lambda identity: F.lit(0)
    else:
        # Documents with such entities get the tries as a map.
        held = holders.select("__id", "__version", F.explode(F.array_distinct("found")).alias("entity"))
        held = held.withColumn("kind", kind_of(F.col("entity"))).select("__id", "__version", F.explode(_identities(F.col("entity"), F.col("kind"))).alias("identity"))
        held = held.join(_small(more), "identity")
        maps = held.groupBy("__id", "__version").agg(F.map_from_entries(F.collect_set(F.struct("identity", "attempt"))).alias("__tries"))
        maps = stored(maps, "maps")
        rows = rows.join(_small(maps), rows[id_col].eqNullSafe(maps["__id"]) & (F.xxhash64(rows[text_col].cast("string")) == maps["__version"]), "left")
        attempt = lambda identity: F.coalesce(F.element_at(F.col("__tries"), identity), F.lit(0))
    between = F.split(F.col(text_col).cast("string"), ANY, -1)
    made = surrogates_of(F.col("__found"), key, attempt)
    whole = F.array_join(F.zip_with(between, made, lambda part, surrogate: F.concat(part, F.coalesce(surrogate, F.lit("")))), "")
    replaced = F.when(F.size("__found") > 0, whole).otherwise(F.col(text_col).cast("string"))
    out = rows.select(*[replaced.alias(c) if c == text_col else F.col(c) for c in columns], F.size("__found").alias("__count"))
    return out.withColumnRenamed("__count", count_col) if count_col else out.drop("__count")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
