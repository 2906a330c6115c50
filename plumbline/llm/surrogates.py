"""PII surrogates with DataFrame functions alone.

Detected entities are replaced by keyed surrogates of the same type and format: digits by digits, letters by letters of the same case and
script, names by names of the same gender. A surrogate follows from the key and the entity's normal form, so every mention of
an entity, in any spelling of its format, gets the same one (coreference). Surrogates are checked against each other and against all entities of the
corpus, and an entity that loses a collision draws again (distinctness).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store

#: Draws before an entity whose format has no free surrogate left gets a tag with its keyed digest instead.
DRAWS = 24

# Titles that show a person's gender, by gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], "n": ["Dr", "Prof"]}

_NAME = r"\p{Lu}[\p{L}'’-]+"
#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? {_NAME}(?: {_NAME})?",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}+|AKIA[0-9A-Z]{16}|(?:sk|ghp|pat)[-_][0-9A-Za-z_-]{16,80}+)(?![\p{L}\p{N}])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:(?<![\d+])\+\d[\d ().-]{6,18}\d|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with an entity has at least, cheaper to look for: each pattern needs a digit, ``@``, a title before a name, or a secret's prefix or letters.
CHEAP = rf"[0-9@]|(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? \p{{Lu}}|AKIA[A-Z]|(?:sk|ghp|pat)[-_]|[a-f]{{32}}"

# Alphabets by script and case, and syllables that surrogate names are made of.
ALPHABETS = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[ß-öø-ÿ]", "àáâäèéêëìíîïòóôöùúûü"), ("[À-ÖØ-Þ]", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ"), ("[а-яё]", "абвгдежзийклмнопрстуфхцчшщыэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")]
SYLLABLES = {"latin": ["ba", "be", "da", "di", "fa", "ga", "ka", "la", "le", "li", "ma", "me", "mi", "na", "ne", "ni", "ra", "re", "ri", "ro", "sa", "si", "ta", "te", "to", "va"], "cyrillic": ["ба", "бе", "да", "ди", "фа", "га", "ка", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "ни", "ра", "ре", "ри", "ро", "са", "си", "та", "те", "то", "ва"]}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "л"}}


def kind_of(mention: Column) -> Column:
    """The type of a mention that ``PATTERN`` has found."""
    return reduce(lambda rest, item: F.when(mention.rlike(f"^(?:{item[1]})$"), F.lit(item[0])).otherwise(rest), reversed([(k, p.replace("(?<![\\d.-])", "").replace("(?<!\\d)", "")) for k, p in PATTERNS.items()]), F.lit("card"))


def normal_form(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), digits))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "person", F.regexp_replace(F.lower(mention), r"\. ", " "))
        .otherwise(mention)
    )


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, draw: Column, kind: Column, norm: Column) -> Column:
    """Two hex digits of keyed digest for each character of ``norm``, and some more."""
    blocks = F.sequence(F.lit(0), F.floor(F.char_length(norm) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, draw.cast("string"), b.cast("string"), norm), 512)), "")


def _mapped(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter and digit of ``text`` drawn anew from its own alphabet; everything else stays."""

    def draw(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        out = reduce(lambda rest, a: F.when(c.rlike(a[0]), F.substring(F.lit(a[1]), b % len(a[1]) + 1, F.lit(1))).otherwise(rest), reversed(ALPHABETS), c)
        return F.when(hexadecimal & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), b % 6 + 1, F.lit(1))).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """The sum whose remainder by 10 is 0 for a valid number."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder that bank numbers are checked by; letters count as 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))


def _valid_iban(drawn: Column) -> Column:
    """``drawn`` with the check digits that make it valid."""
    country, own = F.substring(drawn, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    return F.concat(country, F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own)


def _name(token: Column, gender: Column, given: Column, key: str, draw: Column) -> Column:
    """A name in the token's script, ending by gender if it is a given name: of three syllables, and of one more for every second draw, so that names never run out."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), draw.cast("string"), token), 256)

    def made(script: str) -> Column:
        syllables = F.array(*(F.lit(s) for s in SYLLABLES[script]))
        n = len(SYLLABLES[script])
        places = F.sequence(F.lit(0), F.least(F.lit(14), F.floor(draw / 2).cast("int") + 2))
        body = F.array_join(F.transform(places, lambda k: F.element_at(syllables, F.conv(F.substring(h, k * 4 + 1, F.lit(4)), 16, 10).cast("int") % n + 1)), "")
        ending = F.when(gender == "m", ENDINGS[script]["m"]).when(gender == "f", ENDINGS[script]["f"]).otherwise(ENDINGS[script]["n"])
        return F.concat(body, F.when(given, ending).otherwise(F.lit("")))

    return F.when(token.rlike("[а-яё]"), made("cyrillic")).otherwise(made("latin"))


def surrogate(kind: Column, norm: Column, draw: Column, key: str) -> Column:
    """The surrogate normal form of draw number ``draw``."""
    stream = _stream(key, draw, kind, norm)
    no = F.lit(False)
    mapped = _mapped(norm, stream, no)
    email = F.concat(_mapped(F.regexp_replace(norm, r"\.[^.]*$", ""), stream, no), F.regexp_extract(norm, r"\.[^.]*$", 0))
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: F.when(F.length(o) == 1, _byte(stream, i) % 10).when(F.length(o) == 2, 10 + _byte(stream, i) % 90).otherwise(100 + _byte(stream, i) % 156).cast("string")), ".")
    kept = F.when(kind == "iban", 2).when((kind == "phone") & norm.startswith("+"), 2).when(kind == "card", 1).otherwise(F.when(norm.rlike("^AKIA"), 4).when(norm.rlike("^(sk|ghp|pat)[-_]"), F.length(F.regexp_extract(norm, "^(sk|ghp|pat)[-_]", 0))).otherwise(0))
    same = F.concat(F.substring(norm, F.lit(1), kept), F.substring(F.when(kind == "secret", _mapped(norm, stream, norm.rlike("^[0-9a-f]+$"))).otherwise(mapped), kept + 1, F.length(norm)))
    body = F.substring(same, F.lit(1), F.length(same) - 1)
    check = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(_luhn(norm) % 10 == 0, check).otherwise(same)
    iban = F.when(_mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1, _valid_iban(same)).otherwise(same)
    name = F.initcap(_name(norm, F.substring_index(kind, ":", -1), F.substring_index(F.substring_index(kind, ":", 2), ":", -1) == "given", key, draw))
    return F.when(kind == "email", email).when(kind == "ipv4", octets).when(kind == "card", card).when(kind == "iban", iban).when(kind.startswith("name:"), name).otherwise(same)


def in_format(kind: Column, mention: Column, chosen: Column) -> Column:
    """``chosen`` in the spelling of a mention: its separators, and upper case where it has upper case."""
    letters = F.regexp_replace(chosen, r"[^\p{L}\p{N}]", "")

    def at(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        x = F.substring(letters, before + 1, F.lit(1))
        return F.when(~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)

    title = F.regexp_extract(mention, r"^\S+ ", 0)
    names = F.regexp_extract(chosen, r"^\S+ (.*)$", 1)
    person = F.concat(title, F.when(F.upper(mention) == mention, F.upper(names)).otherwise(names))
    return F.when(chosen.startswith("<"), chosen).when(kind == "person", person).otherwise(F.array_join(F.transform(F.split(mention, ""), at), ""))


def person_names(persons: DataFrame) -> DataFrame:
    """``norm, at, kind, name``: the names of each person, the last one a surname, those before it given names. A given name has one gender in the whole corpus, that which titles show wherever it stands (neither
    if they disagree or none tells), so it has one surrogate whatever its title."""
    parts = F.split("norm", " ")
    title = F.element_at(parts, 1)
    shown = {g: title.isin(*(t.lower() for t in TITLES[g])) for g in "mf"}
    each = persons.select("norm", shown["m"].alias("m"), shown["f"].alias("f"), F.size(parts).alias("n"), F.posexplode(parts).alias("at", "name")).where("at > 0")
    each = each.withColumn("family", F.col("at") == F.col("n") - 1)
    told = each.where("not family").groupBy("name").agg(F.bool_or("m").alias("m"), F.bool_or("f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    given = each.where("not family").select("norm", "at", "name").join(told.select("name", gender.alias("gender")), "name")
    return each.where("family").select("norm", "at", F.lit("name:family:n").alias("kind"), "name").unionByName(given.select("norm", "at", F.concat(F.lit("name:given:"), "gender").alias("kind"), "name"))


def choose(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, chosen`` for distinct ``kind, norm``: no two of a kind share a surrogate, and none is an entity of the corpus. Persons get theirs name by name, so
    that a surname is the same with and without given names, and different persons stay different."""
    persons = entities.where("kind = 'person'")
    names = store.keep(person_names(persons), "names")
    tokens = names.select("kind", F.col("name").alias("norm")).distinct()
    chosen = _drawn(entities.where("kind <> 'person'").unionByName(tokens), key)
    own = names.join(chosen.withColumnRenamed("norm", "name"), ["kind", "name"])  # at most two names a person
    made = own.groupBy("norm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "chosen"))), lambda x: x["chosen"]), " ").alias("names"))
    made = made.select(F.lit("person").alias("kind"), "norm", F.concat(F.substring_index("norm", " ", 1), F.lit(" "), "names").alias("chosen"))
    return chosen.where(~F.col("kind").startswith("name:")).unionByName(made)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """Surrogates by rounds of draws; an entity whose draw is taken draws again."""
    entities = entities.withColumn("space", F.substring_index("kind", ":", 1))  # names of every role share one space
    originals = entities.select("space", F.col("norm").alias("form"))
    left, done = entities, None

    def form(c: str) -> Column:
        """The normal form of a surrogate: names are drawn with capitals."""
        return F.when(F.col("space") == "name", F.lower(c)).otherwise(F.col(c)).alias("form")

    for draw in range(DRAWS):
        drawn = left.withColumn("candidate", surrogate(F.col("kind"), F.col("norm"), F.lit(draw), key))
        taken = originals if done is None else originals.unionByName(done.select("space", form("chosen")))
        free = drawn.withColumn("form", form("candidate")).join(taken, ["space", "form"], "left_anti")
        winners = free.groupBy("space", "candidate").agg(F.min(F.struct("kind", "norm")).alias("first")).select("space", "first.kind", "first.norm", F.col("candidate").alias("chosen"))
        won = store.keep(winners, "surrogates")
        done = won if done is None else done.unionByName(won)
        left = store.keep(left.join(won, ["kind", "norm"], "left_anti"), "left")
        if left.isEmpty():
            return done.drop("space")
    tags = left.select("kind", "norm", F.concat(F.lit("<"), F.upper("kind"), F.lit("_"), F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm"), 256), F.lit(">")).alias("chosen"))
    return done.drop("space").unionByName(tags)


def replace_entities(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced and ``n_entities`` added (an own column of that name is replaced; the helper names ``_n, _k, _digest,
    _list_k, _list_digest, _news`` are left out).

    A null text stays null with 0 entities; an empty one stays empty. Very long texts are searched whole. Repeated rows and ids
    each keep their row. Other columns stay as they are. An empty table gives no rows. Text without entities is not shuffled.
    """
    columns = [c for c in docs.columns if c not in ("n_entities", "_n", "_k", "_digest", "_list_k", "_list_digest", "_news")]
    rows = docs.select(*columns)
    found = F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), 0)
    row_key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.sha2(F.col(text_col), 256)
    cheap = F.coalesce(F.col(text_col).rlike(CHEAP), F.lit(False))
    mentions = rows.where(cheap).select(row_key[0].alias("k"), row_key[1].alias("digest"), F.posexplode(found).alias("at", "mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("norm", normal_form(F.col("kind"), F.col("mention")))
    mentions = store.keep(mentions, "mentions")
    entities = store.keep(mentions.select("kind", "norm").distinct(), "entities")
    chosen = choose(entities, key)
    spelled = mentions.select("kind", "mention", "norm").distinct().join(chosen, ["kind", "norm"]).select("kind", "mention", in_format(F.col("kind"), F.col("mention"), F.col("chosen")).alias("new"))
    spelled = store.keep(spelled, "spelled")
    # equal rows have equal lists: one is enough
    lists = mentions.select("k", "digest", "at", "kind", "mention").join(spelled, ["kind", "mention"]).groupBy(F.col("k").alias("_list_k"), F.col("digest").alias("_list_digest")).agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "new"))), lambda s: s["new"]).alias("_news"))

    marked = rows.withColumn("_n", F.when(cheap, F.size(found)).otherwise(F.lit(0)))
    plain = marked.where("_n = 0").select(*columns, F.lit(0).cast("long").alias("n_entities"))
    hit = marked.where("_n > 0").withColumn("_k", row_key[0]).withColumn("_digest", row_key[1])
    joined = hit.join(lists, (F.col("_k") == F.col("_list_k")) & (F.col("_digest") == F.col("_list_digest")))
    gaps = F.split(F.col(text_col), PATTERN, -1)
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("_news", i), F.lit("")))), "")
    return plain.unionByName(joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in columns), F.col("_n").cast("long").alias("n_entities")))
