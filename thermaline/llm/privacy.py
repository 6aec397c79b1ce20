"""Personal data replaced by surrogates, in SQL functions only.

Detected entities (e-mail addresses, phone, card, social security and bank account numbers, IPv4 addresses, access keys, passwords
and tokens, names after a title) get keyed replacements of their own type: letters, capitals and digits stay what they are, hex
strings stay hex, card numbers keep their check digit valid, octets stay octets, and names keep gender (from the title), script and
number of parts. Given and family names are drawn apart and without their title, so 'Mr. Smith' follows 'Herr John Smith', and no
surrogate is a part of a name that occurs. In a document that names somebody with a title, the parts of that name are replaced wherever
they stand alone. One entity has one surrogate in the whole corpus, however it is written (case of addresses, separators of
numbers), and two never share one: surrogates that meet each other, or an entity that occurs, are drawn again until none does. An
entity that keeps losing, since its form has few values, gets longer surrogates. A secret holds a letter or digit.

Null text stays null and has no entities. Null ids and repeated rows give a row each. An empty table gives no rows; other columns
are kept where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.common import let, staged

KEY = "thermaline"
#: Draws of an entity's own form before each further one is longer by a character, so that no form can run out.
TRIES = 5

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles and the gender they show.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Madame", "Mme", "Г-жа", "Госпожа"],
          "m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "Г-н", "Господин"]}
_TITLE = "(?:" + "|".join(sorted(TITLES["f"] + TITLES["m"], key=len, reverse=True)) + ")(?:\\.[ \\t\\xA0]{0,3}|[ \\t\\xA0]{1,3})"
_SECRET = "(?:password|passwd|pwd|secret|token|api_key|apikey|api-key)"
#: Fixed patterns, by type and in order of precedence.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "secret": f"(?<=(?i:{_SECRET})[\"']{{0,1}}\\s{{0,2}}[=:]\\s{{0,2}}[\"']{{0,1}})(?=[_/+.=-]*[A-Za-z0-9])[A-Za-z0-9_/+.=-]{{8,}}",
    "key": "(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "card": "(?<![0-9A-Za-z])[0-9]{4}(?:([ -]?)[0-9]{4})(?:[ -]?[0-9]{4}){2}(?![0-9A-Za-z])",
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": "(?<![0-9A-Za-z])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
             "|(?<![0-9A-Za-z])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "ip": f"(?<![0-9A-Za-z.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9A-Za-z]|\\.[0-9])",
    "name": f"(?<!\\p{{L}}){_TITLE}\\p{{Lu}}\\p{{L}}+(?:[ \\t\\xA0]{{1,3}}\\p{{Lu}}\\p{{L}}+)?",
}
ANY = "|".join(PATTERNS.values()).replace("([ -]?)", "[ -]?")
#: Every entity holds a digit or an at sign, or follows a title or the name of a secret.
_HINT = f"[0-9@]|{_TITLE}\\p{{Lu}}|(?i:{_SECRET})"

#: What may be a part of a name that stands without a title.
_BARE = "(?<!\\p{L})\\p{Lu}\\p{L}+(?!\\p{L})"

#: Syllables of surrogate names by script.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi".split(),
             "cyrillic": "ба бе би бо ва ве ви га ге да де ди за зе зи ка ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split(),
             "greek": "βα βε γα γε δα δε ζα ζε θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε".split()}
#: Endings of given names, by script and gender.
ENDINGS = {"latin": {"f": "lia", "m": "ron"}, "cyrillic": {"f": "лия", "m": "рон"}, "greek": {"f": "λια", "m": "ρος"}}


def found(text: Column) -> Column:
    """The entities of a text in order, as written."""
    hit = F.coalesce(text.rlike(_HINT), F.lit(False))
    return F.when(hit, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(surface: Column) -> Column:
    """Type of an entity as written. Secrets, which only their context shows, are what no other pattern matches whole."""
    out = None
    for name in ("email", "key", "iban", "card", "ssn", "ip", "phone", "name"):
        test = surface.rlike(f"^(?:{PATTERNS[name]})$")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("secret"))


def gender(surface: Column) -> Column:
    return F.when(surface.rlike("^(?:" + "|".join(TITLES["f"]) + ")[. \\t\\xA0]"), F.lit("f")).otherwise(F.lit("m"))


def parts(surface: Column) -> Column:
    """Given and family name, or the family name alone, of a name as written."""
    return F.split(F.regexp_replace(surface, f"^{_TITLE}", ""), "[ \\t\\xA0]+")


def canonical(surface: Column, type_: Column) -> Column:
    """What makes two writings one entity: case of addresses and names, titles, spacing and separators of numbers do not count, the
    gender of a title does."""
    return (F.when(type_ == "email", F.lower(surface)).when(type_.isin("card", "ssn"), F.regexp_replace(surface, "[^0-9]", ""))
            .when(type_ == "phone", F.regexp_replace(F.regexp_replace(surface, "[^0-9]", ""), "^1(?=[0-9]{10}$)", ""))
            .when(type_ == "iban", F.regexp_replace(surface, " ", ""))
            .when(type_ == "name", F.concat_ws("\x1f", gender(surface), F.initcap(F.array_join(parts(surface), " ")))).otherwise(surface))


def _stream(*parts: Column) -> Column:
    """64 keyed numbers of 16 bits, as hex characters to cut them from."""
    whole = F.concat_ws("\x1f", *parts)
    return F.concat(F.sha2(F.concat(whole, F.lit("\x1fa")), 512), F.sha2(F.concat(whole, F.lit("\x1fb")), 512))


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letters(n: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _alike(value: Column, stream: Column) -> Column:
    """Each letter or digit replaced by one of its class."""
    def one(c: Column, i: Column) -> Column:
        # long values go on with other numbers: the position is part of the draw
        n = _number(stream, i) + (i / 64).cast("int") * 7
        return (F.when(c.rlike("[0-9]"), _letters(n, "0123456789")).when(c.rlike("[a-z]"), _letters(n, "abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), _letters(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hex(value: Column, stream: Column) -> Column:
    one = lambda c, i: _letters(_number(stream, i) + (i / 64).cast("int") * 7, "0123456789abcdef")
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows `digits`."""
    def add(a: Column, c: Column) -> Column:
        n = c["c"].cast("int") * F.when(c["i"] % 2 == 0, 2).otherwise(1)
        return a + F.when(n > 9, n - 9).otherwise(n)

    back = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(back, F.lit(0), add, lambda a: F.pmod(-a, F.lit(10)).cast("string"))


def _card(value: Column, stream: Column) -> Column:
    body = F.concat(F.substring(value, 1, 1), _alike(F.substring(value, F.lit(2), F.length(value) - 2), stream))
    valid = _luhn(F.substring(value, F.lit(1), F.length(value) - 1)) == F.substring(value, F.length(value), F.lit(1))
    return F.when(valid, F.concat(body, _luhn(body))).otherwise(F.concat(body, _letters(_number(stream, F.lit(40)), "0123456789")))


def _email(value: Column, stream: Column) -> Column:
    top = F.regexp_extract(value, "(\\.[a-z]+)$", 1)
    return F.concat(_alike(F.substring(value, F.lit(1), F.length(value) - F.length(top)), stream), top)


def _name(type_: Column, value: Column, gender_: Column, stream: Column, more: Column, again: Column) -> Column:
    """A given name of the gender or a family name, in the script of the value; `more` further syllables before the end."""
    script = F.when(value.rlike("\\p{IsCyrillic}{2}$"), "cyrillic").when(value.rlike("\\p{IsGreek}{2}$"), "greek").otherwise("latin")
    out = None
    for s, syllables in SYLLABLES.items():
        pick = lambda i, stream=stream: F.element_at(F.array(*map(F.lit, syllables)), F.pmod(_number(stream, i), F.lit(len(syllables))) + 1)  # noqa: B023, E731
        start = F.concat(pick(F.lit(0)), pick(F.lit(1)), F.array_join(F.transform(F.array_repeat(F.lit(""), more), lambda _, i: pick(i, again)), ""))  # noqa: B023
        given = F.concat(start, F.when(gender_ == "f", ENDINGS[s]["f"]).otherwise(ENDINGS[s]["m"]))
        family = F.concat(start, pick(F.lit(2)), pick(F.lit(3)))
        whole = F.initcap(F.when(type_ == "given", given).otherwise(family))
        out = F.when(script == s, whole) if out is None else out.when(script == s, whole)
    return out


def draw(type_: Column, value: Column, gender_: Column, attempt: Column, key: str = KEY) -> Column:
    """The keyed surrogate of a canonical entity at an attempt; prefixes that show the type stay."""
    stream = _stream(F.lit(key), type_, value, attempt.cast("string"))
    more = F.greatest(attempt - (TRIES - 1), F.lit(0))
    again = _stream(F.lit(key), type_, value, attempt.cast("string"), F.lit("more"))
    digits, letters = _alike(F.repeat(F.lit("0"), more), again), _alike(F.repeat(F.lit("a"), more), again)
    octets = F.array_join(F.transform(F.array_repeat(F.lit("."), more), lambda c, i: F.concat(c, (F.pmod(_number(again, i), F.lit(254)) + 1).cast("string"))), "")
    octet = lambda i: (F.pmod(_number(stream, F.lit(i)), F.lit(254)) + 1).cast("string")
    own = (F.when(type_ == "email", F.concat(letters, _email(value, stream))).when(type_ == "card", _card(value, stream))
           .when(type_ == "ip", F.concat_ws(".", *[octet(i) for i in range(4)])).when(type_.isin("given", "family"), _name(type_, value, gender_, stream, more, again))
           .when(type_ == "key", F.concat(F.substring(value, 1, 4), _alike(F.substring(value, 5, 99), stream)))
           .when(type_ == "iban", F.concat(F.substring(value, 1, 2), _alike(F.substring(value, 3, 99), stream)))
           .when((type_ == "secret") & value.rlike("^[0-9a-f]+$"), _hex(value, stream)).otherwise(_alike(value, stream)))
    tail = F.when(type_.isin("email", "given", "family"), "").when(type_ == "ip", octets).when((type_ == "secret") & ~value.rlike("^[0-9a-f]+$"), letters).otherwise(digits)
    return F.concat(own, tail)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """type, value, surrogate for distinct (type, value, gender), without collisions inside a type; given names are distinct by gender,
    and given and family names are one type here.

    A surrogate that several entities draw stays with the first; the others, and those that drew an entity that occurs, draw again.
    """
    space = F.when(F.col("type").isin("given", "family"), "name").otherwise(F.col("type")).alias("space")
    todo = staged(entities.withColumn("attempt", F.lit(0)))
    real = todo.select(space, F.col("value").alias("surrogate"))
    taken = None
    while True:
        drawn = todo.withColumn("surrogate", draw(F.col("type"), F.col("value"), F.col("gender"), F.col("attempt"), key)).withColumn("space", space)
        nth = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("value", "type", "gender"))
        used = real if taken is None else real.union(taken.select(space, "surrogate"))
        used = used.distinct().withColumn("used", F.lit(True))
        judged = staged(drawn.withColumn("nth", nth).join(used, ["space", "surrogate"], "left"))
        lost = F.col("used").isNotNull() | (F.col("nth") > 1)
        won = judged.where(~lost).select("type", "value", "gender", "surrogate")
        taken = won if taken is None else taken.union(won)
        todo = judged.where(lost).select("type", "value", "gender", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return taken


def resolved(entities: DataFrame, key: str = KEY) -> DataFrame:
    """type, value, surrogate for distinct (type, value, gender); a name is put together from the surrogates of its parts."""
    name = F.col("type") == "name"
    whole = F.split(F.substring_index("value", "\x1f", -1), " ")
    names = entities.where(name).select("value", F.col("gender").alias("sex"), F.when(F.size(whole) > 1, whole[0]).alias("given"), F.element_at(whole, -1).alias("family"))
    given = names.where("given is not null").select(F.lit("given").alias("type"), F.col("given").alias("value"), F.col("sex").alias("gender"))
    family = names.select(F.lit("family").alias("type"), F.col("family").alias("value"), F.lit("m").alias("gender"))
    table = staged(surrogates(entities.where(~name).select("type", "value", "gender").union(given.union(family).distinct()), key))
    of = lambda type_, *cols: table.where(F.col("type") == type_).select(*cols)
    last = names.join(of("family", F.col("value").alias("family"), F.col("surrogate").alias("last")), "family")
    # a null given name would put all names without one into one task
    full = last.where("given is not null").join(of("given", F.col("value").alias("given"), F.col("gender").alias("sex"), F.col("surrogate").alias("first")), ["given", "sex"])
    said = full.select("value", F.concat_ws(" ", "first", "last").alias("surrogate")).union(last.where("given is null").select("value", "last"))
    return table.where(~F.col("type").isin("given", "family")).select("type", "value", "surrogate").union(said.select(F.lit("name").alias("type"), "value", "surrogate"))


def _cased(surrogate: Column, surface: Column) -> Column:
    return F.when(surface == F.upper(surface), F.upper(surrogate)).otherwise(surrogate)


def render(surface: Column, type_: Column, surrogate: Column) -> Column:
    """The surrogate in the writing of the entity: separators, country code, case and title stay."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    lead = F.greatest(F.length(digits) - F.length(surrogate), F.lit(0))  # of a country code
    rest = F.substring(surrogate, F.length(digits) - lead + 1, F.length(surrogate))  # of a surrogate with more digits

    def fill(chars: Column) -> Column:
        step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(
            F.concat(a["s"], F.when(a["n"] < lead, c).otherwise(F.substring(surrogate, a["n"] - lead + 1, F.lit(1)))).alias("s"), (a["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n")))
        return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda a: a["s"])

    spaced = F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.length(surrogate) / 4).cast("int") - 1), lambda i: F.substring(surrogate, i * 4 + 1, F.lit(4))), " ")
    title = F.regexp_extract(surface, f"^({_TITLE})", 1)
    gap = F.regexp_extract(surface, "([ \\t\\xA0]+)[^ \\t\\xA0]+$", 1)
    named = F.array_join(F.zip_with(parts(surface), F.split(surrogate, " "), lambda a, b: _cased(b, a)), "\x1f")
    return (F.when(type_.isin("phone", "card", "ssn"), F.concat(let(F.split(surface, ""), fill), rest))
            .when(type_ == "name", F.concat(title, F.replace(named, F.lit("\x1f"), gap))).when((type_ == "iban") & (F.instr(surface, " ") > 0), spaced)
            .when((type_ == "email") & (surface == F.upper(surface)), F.upper(surrogate)).otherwise(surrogate))


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text with surrogates, n_entities of every row of `docs`, and its columns `keep` in a struct `kept`."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    seen = read.withColumn("found", found(F.col("text")))
    clean = seen.where(F.size("found") == 0).select("id", "text", F.lit(0).cast("long").alias("n_entities"), "kept")
    # the rows with entities are written once; equal texts share their key, so copies are resolved together
    dirty = staged(seen.where(F.size("found") > 0).withColumn("hash", F.sha2("text", 256)))
    spots = dirty.select("hash", F.posexplode("found").alias("pos", "surface")).distinct()
    spots = spots.withColumn("type", kind(F.col("surface"))).withColumn("value", canonical(F.col("surface"), F.col("type")))
    spots = staged(spots.withColumn("gender", F.when(F.col("type") == "name", gender(F.col("surface"))).otherwise(F.lit("m"))))
    table = staged(resolved(spots.select("type", "value", "gender").distinct().groupBy("type", "value").agg(F.min("gender").alias("gender")), key))
    drawn = spots.join(table, ["type", "value"]).withColumn("new", render(F.col("surface"), F.col("type"), F.col("surrogate")))
    drawn = staged(drawn.select("hash", "pos", "surface", "type", "surrogate", "new"))
    lists = drawn.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("new"))
    # the parts of each document's names, for where they stand without a title
    pair = F.explode(F.arrays_zip(parts(F.col("surface")).alias("part"), F.split("surrogate", " ").alias("by"))).alias("pair")
    named = drawn.where(F.col("type") == "name").select("hash", pair).groupBy("hash", F.initcap("pair.part").alias("part")).agg(F.min("pair.by").alias("by"))
    named = named.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("part", "by"))).alias("named"))
    known = lambda word: F.element_at(F.col("named"), F.initcap(word))
    bare = lambda text: F.regexp_extract_all(text, F.lit(_BARE), F.lit(0))
    said = lambda text: F.array_join(F.zip_with(F.split(text, _BARE, -1), bare(text), lambda a, w: F.concat(a, F.coalesce(_cased(known(w), w), w, F.lit("")))), "")
    filled = dirty.join(lists, "hash").join(named, "hash", "left").withColumn("rest", F.split("text", ANY, -1))
    filled = filled.withColumn("n_bare", F.when(F.col("named").isNotNull(), F.aggregate(
        "rest", F.lit(0), lambda n, t: n + F.size(F.filter(bare(t), lambda w: known(w).isNotNull())))).otherwise(0))
    rest = F.when(F.col("n_bare") > 0, F.transform("rest", said)).otherwise(F.col("rest"))
    parts_ = F.zip_with(rest, F.col("new")["new"], lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    filled = filled.select("id", F.array_join(parts_, "").alias("text"), (F.size("found") + F.col("n_bare")).cast("long").alias("n_entities"), "kept")
    return clean.union(filled).withColumnsRenamed({"id": id_col, "text": text_col})


def op9(docs: DataFrame) -> DataFrame:
    return replace(docs).drop("kept")
