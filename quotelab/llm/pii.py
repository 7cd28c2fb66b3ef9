"""Surrogates for personal data, with DataFrame functions alone.

One pattern finds e-mail and IP addresses of both versions, phone, card, account and social security numbers, long
hexadecimal secrets, keys of well-known services, private keys and names after a title. Every distinct entity of a type gets
a surrogate from a keyed digest: of the same type, alphabet and layout, names of the same gender and script. Surrogates that
meet another one, or any entity of the corpus, are drawn anew, so different entities stay different; equal entities,
however written, share one surrogate in all documents.

A name is taken apart into its words, each an entity of its own: a word that is a surname in most of its mentions has one
surrogate for all genders, a given name one for each gender; initials and the O of O'Neil stay. In a document with a titled
name, its words are replaced wherever else they stand there with a capital, so no later "Smith" gives it away; a name
that no title introduces in its document is not found.

Only documents with entities are taken apart; digests, checks and replacements are joins of thin tables. The pattern runs
once over the documents, which are stored with what it found, and a second time over those with names.

Null and empty texts come back unchanged, with no entities. Repeated rows, and rows with a null id, are treated alike. A type
with more entities than its surrogates can hold (a billion social security numbers) ends in a ValueError.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelab.session import materialise

# Titles by gender (n: either), endings of names by gender (s: surnames) and script, syllables by script.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Lady", "госпожа", "Госпожа"],
    "n": ["Dr", "Prof", "Doctor", "Professor", "доктор", "Доктор", "профессор", "Профессор"],
}
ENDINGS = {
    ("m", "latin"): ["an", "er", "o", "us"], ("f", "latin"): ["a", "ia", "ine", "elle"], ("n", "latin"): ["el", "is", "yn", "ey"],
    ("s", "latin"): ["son", "man", "ton", "field"],
    ("m", "cyrillic"): ["ан", "ий", "ей", "ор"], ("f", "cyrillic"): ["ана", "ия", "ела", "ена"], ("n", "cyrillic"): ["ик", "ель", "уш", "ам"],
    ("s", "cyrillic"): ["ов", "ев"],
}
SYLLABLES = {
    "latin": ["ba", "bel", "bri", "ca", "cor", "da", "del", "dri", "fa", "fel", "ga", "gor", "jo", "ka", "kel", "la", "lin", "lo", "ma", "mar",
              "mel", "na", "nor", "pa", "per", "ra", "rin", "ro", "sa", "sel", "ta", "tel", "tor", "va", "vel", "vi", "wa", "wen", "za", "zel"],
    "cyrillic": ["ба", "бел", "ва", "вол", "га", "гор", "да", "дор", "жа", "за", "зор", "ка", "кор", "ла", "лев", "ма", "мир", "на", "нов", "па",
                 "пет", "ра", "род", "са", "сол", "та", "тор", "фа", "ха", "ша"],
}
ALPHABETS = {
    "[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзийклмнопрстуфхцчшщыэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "[ß-öø-ÿ]": "àáâäèéêëìíîïòóôöùúûü", "[À-ÖØ-Þ]": "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLE = "|".join(t for titles in TITLES.values() for t in sorted(titles, key=len, reverse=True))
_TITLED = rf"^(?:{_TITLE})\.? "
#: A word of a name as one entity, such words with what joins them, and initials before them.
_RUN = r"\p{Lu}[\p{L}\p{M}]++"
_WORD = rf"(?:\p{{Lu}}['’])?{_RUN}(?:['’-]{_RUN})*+"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
_PEM = r"-----{} [A-Z ]{{0,20}}PRIVATE KEY-----"
_TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "pem": _PEM.format("BEGIN") + r"(?:\s*+[A-Za-z0-9+/=]{16,}+){1,400}+(?:\s*+[A-Za-z0-9+/=]*+\s*+" + _PEM.format("END") + ")?",
    "token": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,128}|xox[abprs]-[0-9A-Za-z-]{10,128})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:(?:{_HEX}:){{2,6}}|[Ff][Ee]80:)(?::{_HEX}){{1,5}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{3}\) ?)\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
             r"|(?<![\d.-])(?:\d{3}(?: \d{3} |-\d{3}-|\.\d{3}\.)\d{4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLE})\.? {_INITIALS}{_WORD}(?: {_INITIALS}{_WORD}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in _TYPES.values())
#: The same and every other capitalised word, but for the beginnings of addresses.
_WIDE = PATTERN + rf"|(?<![\p{{L}}\p{{M}}\p{{N}}]){_RUN}(?![A-Za-z0-9._%+-]{{0,64}}+@)"
#: Texts without any of these hold no entity; most texts stop here.
_HINT = rf"[@\d]|(?:{_TITLE})\.? \p{{Lu}}|[0-9a-f]{{32}}|[0-9A-F]{{32}}|PRIVATE KEY-----|AKIA|gh[oprsu]_|sk-|xox[abprs]-"
#: Draws after which a crowded layout is left for any of the type, and after which the entities are too many.
_LAYOUT_DRAWS, _MAX_DRAWS = 8, 40


def _type_of(mention: Column) -> Column:
    """The type of a mention; ``word`` for a capitalised word that is none by itself."""
    out = F.when(mention.rlike(_TITLED), "name")
    for name, p in _TYPES.items():
        if name != "name":
            out = out.when(mention.rlike(f"^(?:{p})$"), name)
    return out.otherwise("word")


def _mentions(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(_HINT), found).otherwise(F.array().cast("array<string>"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _parts(mention: Column, kind: Column) -> Column:
    """The entities in a mention: the words of a name with their place and the title's gender, or the mention itself."""
    titles = {g: mention.rlike(f"^(?:{'|'.join(t)})\\.? ") for g, t in TITLES.items()}
    gender = F.when(titles["m"], "m").when(titles["f"], "f").otherwise("n")
    words = F.regexp_extract_all(F.regexp_replace(mention, _TITLED, ""), F.lit(_WORD), F.lit(0))

    def of(word: Column, i: Column) -> Column:
        return F.transform(F.regexp_extract_all(word, F.lit(_RUN), F.lit(0)), lambda run: F.struct(
            F.lit("name").alias("type"), F.lower(run).alias("entity"), run.alias("run"), gender.alias("gender"), (i < F.size(words) - 1).alias("given")))

    plain = (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "account", F.regexp_replace(mention, " ", ""))
        .when(kind.isin("ip", "token", "pem"), mention).otherwise(F.lower(mention))
    )
    whole = F.struct(kind.alias("type"), plain.alias("entity"), mention.alias("run"), F.lit("n").alias("gender"), F.lit(False).alias("given"))
    return F.when(kind == "name", F.flatten(F.transform(words, of))).otherwise(F.array(whole))


def _named(words: DataFrame) -> DataFrame:
    """Words of names with their final type and, for women's surnames in Cyrillic, the man's form as entity and the ``tail`` it lacks.

    Given name or surname is what a word is most often, ties a given name; a neutral title takes the word's usual gender.
    """
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    uses = words.groupBy("entity").agg(count(F.col("given")).alias("as_given"), count(~F.col("given")).alias("as_surname"),
                                       count(F.col("gender") == "m").alias("m"), count(F.col("gender") == "f").alias("f"))
    both = words.join(uses, "entity")
    usual = F.when(F.col("m") + F.col("f") == 0, "n").when(F.col("m") >= F.col("f"), "m").otherwise("f")
    both = both.withColumns({"given": F.col("as_given") >= F.col("as_surname"), "script": _script(F.col("entity")),
                             "gender": F.when(F.col("gender") == "n", usual).otherwise(F.col("gender"))})
    tail = F.when(~F.col("given") & (F.col("script") == "cyrillic") & (F.col("gender") == "f"), "а").otherwise("")
    kind = F.concat_ws("_", F.lit("name"), F.when(F.col("given"), F.col("gender")).otherwise("s"), "script")
    stem = F.when(tail == "", F.col("entity")).otherwise(F.regexp_replace("entity", "(ов|ев|ёв|ин)а$", "$1"))
    return both.select("k1", "k2", "m_at", "p", kind.alias("type"), stem.alias("entity"), tail.alias("tail"), "run")


def _digest(key: str, *what: Column) -> Column:
    """128 bytes in hexadecimal that follow from the key and ``what``."""
    source = F.concat_ws("\u0001", F.lit(key), *what)
    return F.concat(F.sha2(source, 512), F.sha2(F.concat(source, F.lit("\u0001")), 512))


def _byte(digest: Column, at: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(at, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str] | str, value: Column) -> Column:
    listed = F.array(*[F.lit(x) for x in options])
    return F.element_at(listed, F.pmod(value, F.lit(len(options))) + 1)


def _same_layout(text: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its own alphabet."""
    def one(c: Column, i: Column) -> Column:
        v = _byte(digest, i)
        return reduce(lambda out, x: out.when(c.rlike(x[0]), _pick(x[1], v)), ALPHABETS.items(), F.when(F.lit(False), c)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _octets(ip: Column, digest: Column, any_layout: Column) -> Column:
    """As many digits in each number as before, or any numbers once that layout is crowded."""
    def one(o: Column, i: Column) -> Column:
        v = _byte(digest, i * 2) * 256 + _byte(digest, i * 2 + 1)
        low = F.when(F.length(o) == 3, 100).when(F.length(o) == 2, 10).otherwise(0)
        high = F.when(F.length(o) == 3, 256).when(F.length(o) == 2, 100).otherwise(10)
        return F.when(any_layout, F.pmod(v, F.lit(256))).otherwise(low + F.pmod(v, high - low)).cast("string")

    return F.array_join(F.transform(F.split(ip, r"\."), one), ".")


def _groups(ip: Column, digest: Column, any_layout: Column) -> Column:
    """Every hexadecimal digit replaced by one of its own kind, or by any once that layout is crowded."""
    def one(c: Column, i: Column) -> Column:
        v = _byte(digest, i)
        drawn = F.when(any_layout, _pick("0123456789abcdef", v)).when(c.rlike("[0-9]"), _pick("0123456789", v)).otherwise(_pick("abcdef", v))
        return F.when(c == ":", c).otherwise(drawn)

    return F.array_join(F.transform(F.split(ip, ""), one), "")


def _inside(entity: Column, digest: Column, pattern: str) -> Column:
    """The first match of ``pattern`` kept, what follows it drawn in its layout."""
    kept = F.regexp_extract(entity, pattern, 0)
    return F.concat(kept, _same_layout(F.substr(entity, F.length(kept) + 1), digest))


def _luhn(digits: Column) -> Column:
    """Sum of the check on card numbers; valid ones give 0 modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + F.pmod(i, F.lit(2))))
    return F.pmod(F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)), F.lit(10))


def _card(digits: Column, digest: Column) -> Column:
    """Same length; a number that passes the check gets one that passes it."""
    drawn = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _same_layout(F.substr(digits, F.lit(2)), digest))
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    closing = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(digits) == 0, F.concat(body, closing)).otherwise(drawn)


def _name(kind: Column, digest: Column, draw: Column) -> Column:
    def of(gender: str, script: str) -> Column:
        syllables = F.transform(F.sequence(F.lit(0), draw + 1), lambda i: _pick(SYLLABLES[script], _byte(digest, i)))
        return F.initcap(F.concat(F.array_join(syllables, ""), _pick(ENDINGS[gender, script], _byte(digest, F.lit(100)))))

    out = None
    for gender, script in ENDINGS:
        test = kind == f"name_{gender}_{script}"
        out = F.when(test, of(gender, script)) if out is None else out.when(test, of(gender, script))
    return out


def _surrogate(key: str) -> Column:
    """A candidate for the columns type, entity and draw."""
    kind, entity, draw = F.col("type"), F.col("entity"), F.col("draw")
    digest = _digest(key, kind, entity, draw.cast("string"))
    host = F.substring_index(entity, "@", -1)
    domain = _same_layout(F.regexp_replace(host, r"\.[^.]*$", ""), _digest(key, F.lit("domain"), host))
    email = F.concat(_same_layout(F.substring_index(entity, "@", 1), digest), F.lit("@"), domain, F.lit(".example"))
    end = F.regexp_extract(entity, r"\s*" + _PEM.format("END"), 0)
    body = F.substr(entity, F.lit(1), F.length(entity) - F.length(end))
    calling = F.when(F.length(entity) > 10, F.length(entity) - 10).otherwise(1)
    longer = F.when(draw >= _LAYOUT_DRAWS, F.substr(digest, F.lit(1), F.lit(8))).otherwise("")
    return (
        F.when(kind == "email", F.concat(longer, email))
        .when(kind == "secret", F.concat_ws("", F.transform(F.split(entity, ""), lambda c, i: _pick("0123456789abcdef", _byte(digest, i)))))
        .when(kind == "account", F.concat(F.substr(entity, F.lit(1), F.lit(2)), _same_layout(F.substr(entity, F.lit(3)), digest)))
        .when(kind == "token", _inside(entity, digest, "^(?:AKIA|gh._|sk-|xox.-)"))
        .when(kind == "pem", F.concat(_inside(body, digest, _PEM.format("BEGIN")), end))
        .when(kind == "ip", _octets(entity, digest, draw >= _LAYOUT_DRAWS))
        .when(kind == "ip6", _groups(entity, digest, draw >= _LAYOUT_DRAWS))
        .when(kind == "phone", F.concat(F.substr(entity, F.lit(1), calling), _same_layout(F.substr(entity, calling + 1), digest)))
        .when(kind == "card", _card(entity, digest))
        .when(kind == "ssn", _same_layout(entity, digest))
        .otherwise(_name(kind, digest, draw))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate) for distinct (type, entity): no two alike within a type, none an entity itself; names are one type here.

    Of entities that draw one surrogate the least keeps it; the others, and those that drew a real entity, draw anew.
    """
    pool = F.regexp_replace("type", "_.*", "").alias("pool")
    entities = materialise(entities.select("type", "entity").distinct().select("*", pool), "entities")
    real = entities.select("pool", F.lower("entity").alias("taken")).distinct()
    done: list[DataFrame] = []
    open_ = entities
    for draw in range(_MAX_DRAWS):
        drawn = open_.withColumn("draw", F.lit(draw)).withColumn("surrogate", _surrogate(key)).withColumn("taken", F.lower("surrogate"))
        drawn = materialise(drawn, "drawn")
        taken = reduce(DataFrame.unionByName, [d.select("pool", "taken") for d in done], real)
        free = drawn.join(taken, ["pool", "taken"], "left_anti")
        owner = free.groupBy("pool", "taken").agg(F.min(F.struct("type", "entity")).alias("o")).select("pool", "taken", "o.type", "o.entity")
        owner = materialise(owner, "owners")
        kept = drawn.join(owner, ["pool", "taken", "type", "entity"]).select("pool", "type", "entity", "surrogate", "taken")
        kept = materialise(kept, "surrogates")
        done.append(kept)
        open_ = drawn.join(kept.select("type", "entity"), ["type", "entity"], "left_anti").select("type", "entity", "pool")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done).select("type", "entity", "surrogate")
    raise ValueError("a type has more entities than its surrogates can keep apart")


def _woven(between: Column, values: Column) -> Column:
    """The pieces of ``between`` with one of ``values`` after each but the last."""
    return F.array_join(F.zip_with(between, F.concat(values, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _cased(surrogate: Column, like: Column) -> Column:
    upper = (like == F.upper(like)) & (like != F.lower(like))
    return F.when(upper, F.upper(surrogate)).otherwise(surrogate)


def _written(mention: Column, kind: Column, replaced: Column) -> Column:
    """Surrogates in the layout of the mention: its separators, its title and initials, its case."""
    digits, grouped = (_woven(F.split(mention, p, -1), F.split(replaced[0], "")) for p in (r"\d", "[A-Z0-9]"))
    title = F.regexp_extract(mention, _TITLED, 0)
    return (
        F.when(kind == "name", F.concat(title, _woven(F.split(F.regexp_replace(mention, _TITLED, ""), _RUN, -1), replaced)))
        .when(kind.isin("phone", "card", "ssn"), digits).when(kind == "account", grouped)
        .when(kind.isin("token", "pem", "word"), replaced[0]).otherwise(_cased(replaced[0], mention))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns as a struct), new ``text``, n_entities."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    once = rows.withColumn("found", F.coalesce(_mentions(F.col("text")), F.array().cast("array<string>")))
    once = once.withColumn("named", F.exists("found", lambda x: x.rlike(_TITLED)))
    wide = F.regexp_extract_all("text", F.lit(_WIDE), F.lit(0))
    once = materialise(once.select("row", "named", F.when(F.col("named"), wide).otherwise(F.col("found")).alias("mentions")), "mentions")
    once = once.withColumn("text", F.col("row").getField(text_col).cast("string"))  # the row holds it; stored twice it would double the table
    found = once.filter(F.size("mentions") > 0).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})

    each = found.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.posexplode("mentions").alias("m_at", "mention"))
    each = materialise(each.withColumn("kind", _type_of(F.col("mention"))), "each")
    at = ["k1", "k2", "m_at"]
    parts = each.filter("kind != 'word'").select(*at, F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("p", "part")).select(*at, "p", "part.*")
    named = materialise(_named(parts.filter("type = 'name'")), "names")
    plain = parts.filter("type != 'name'").select(*at, "p", "type", "entity", F.lit("").alias("tail"), "run")
    known = surrogates(plain.unionByName(named).select("type", "entity"), key)
    # Words of the names of a text, wherever else they stand in it.
    in_text = named.groupBy("k1", "k2", F.lower("run").alias("word")).agg(F.min(F.struct("type", "entity", "tail")).alias("x"))
    words = each.filter("kind = 'word'").select(*at, F.col("mention").alias("run"), F.lower("mention").alias("word"))
    again = words.join(in_text, ["k1", "k2", "word"]).select(*at, F.lit(0).alias("p"), "x.type", "x.entity", "x.tail", "run")
    whole = reduce(DataFrame.unionByName, [plain, named, again]).join(known, ["type", "entity"])
    surrogate = F.when(F.col("type").startswith("name"), _cased(F.concat("surrogate", "tail"), F.col("run"))).otherwise(F.col("surrogate"))
    whole = whole.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", surrogate.alias("s")))), lambda x: x["s"]).alias("replaced"))
    written = F.when(F.col("replaced").isNull(), F.col("mention")).otherwise(_written(F.col("mention"), F.col("kind"), F.col("replaced")))
    every = each.join(whole, at, "left").select(*at, written.alias("written"), F.col("replaced").isNotNull().cast("long").alias("one"))
    by_text = every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("m_at", "written"))).alias("written"), F.sum("one").alias("n_entities"))
    by_text = materialise(by_text, "written")  # stored: many rows may share one text
    between = F.when(F.col("named"), F.split("text", _WIDE, -1)).otherwise(F.split("text", PATTERN, -1))
    joined = _woven(between, F.transform("written", lambda x: x["written"]))
    changed = found.join(by_text, ["k1", "k2"]).select("row", joined.alias("text"), "n_entities")
    untouched = once.filter(F.size("mentions") == 0).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    return untouched.unionByName(changed)
