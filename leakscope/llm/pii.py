"""PII: detected entities get surrogates of their kind, DataFrame functions only.

A surrogate is drawn from a keyed hash of the entity's canonical form, so every
mention of an entity, in whatever format, gets the same replacement laid out in
the mention's own format: digits for digits, letters for letters, separators,
country codes and card prefixes kept, valid check digits where the original has
one, names of the title's gender and the name's script.

Distinctness is checked over all entities of the corpus: where two would share
a surrogate, or a surrogate is itself an entity, one is drawn again until none
clashes. Drawing again widens the space, so this ends. Only those entities are
joined back to documents; all other surrogates are computed where they stand.

Names are found after a title, up to three words with hyphens, apostrophes and
inner or only capitals; the same document's mentions of that name, or of its
surname, without a title are replaced alike. Not found: persons never named
with a title, names in scripts without capitals, street addresses, dates of
birth, phones of fewer than ten digits without country or area code, and two
spellings of one IPv6 address count as two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import materialize

from .common import NO_ID, fresh, row_print

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
ANY = ("Dr", "Prof")
TITLE = r"(?<!\p{L})(?:" + "|".join(sorted(MALE + FEMALE + ANY, key=lambda t: (-len(t), t))) + ")"
PART = r"\p{Lu}\p{L}*(?:['’-]\p{L}+)*"
#: What each kind looks like.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "secret": r"(?<![0-9A-Za-z])(?:(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "card": r"(?<![\d.])(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
             r"|(?<![\w+.-])\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
            r"|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "name": TITLE + r"\.? " + PART + "(?: " + PART + "){0,2}",
}
#: No entity starts inside a run of small letters or with white space; most places are passed over by that alone.
ENTITY = r"(?!(?<=[a-z])[a-z]|\s)(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
DIGITS = ("card", "phone", "ssn")
#: Script, its letters' range, consonants and vowels for made-up names.
SCRIPTS = (("cyrillic", r"\p{IsCyrillic}", "бвгдзклмнпрст", "аеио"),
           ("greek", r"\p{IsGreek}", "βγδζθκλμνπρστ", "αειο"),
           ("latin", r"\p{L}", "bcdfgklmnprstv", "aeio"))
#: Endings of given names by gender, as vowels of the script.
ENDINGS = {"female": 0, "male": 3, "any": 1}


def kind(e):
    """The kind of an entity, by the same patterns."""
    out = F.lit("name")
    for name in ("iban", "ssn", "ipv6", "ip", "phone", "card", "secret", "email"):
        out = F.when(F.regexp_extract(e, f"^(?:{PATTERNS[name]})$", 0) != "", F.lit(name)).otherwise(out)
    return out


def canonical(e, k):
    """One form for all mentions of an entity."""
    name = F.concat(gender(e), F.lit(" "), F.lower(F.regexp_extract(e, r"^\S+ (.*)$", 1)))
    return (F.when(k.isin(*DIGITS), F.regexp_replace(e, "[^0-9]", "")).when(k.isin("email", "ipv6"), F.lower(e))
            .when(k == "iban", F.regexp_replace(e, " ", "")).when(k == "name", name).otherwise(e))


def gender(e):
    title = F.regexp_extract(e, r"^([^. ]+)", 1)
    return F.when(title.isin(*MALE), F.lit("male")).when(title.isin(*FEMALE), F.lit("female")).otherwise(F.lit("any"))


def digest(key, *parts):
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 512)


def number(hex_digits, i, below: int):
    """The i-th draw (a column, from 0) below a number up to 256."""
    pair = F.substring(hex_digits, (F.pmod(i, F.lit(63)) * 2 + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(pair, 16, 10).cast("int"), F.lit(below))


def draw(hex_digits, i, alphabet: str):
    return F.substring(F.lit(alphabet), number(hex_digits, i, len(alphabet)) + 1, F.lit(1))


LOWER, UPPER, FIGURES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def alike(text, hex_digits):
    """``text`` with each letter and digit of ASCII drawn anew within its class; other letters become a to z."""
    def one(c, i):
        return (F.when(c.rlike("[0-9]"), draw(hex_digits, i, FIGURES)).when(c.rlike("[A-Z]"), draw(hex_digits, i, UPPER))
                .when(c.rlike(r"\p{L}"), draw(hex_digits, i, LOWER)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def laid_out(form, chars, place="[0-9]"):
    """The characters, one by one in the places of ``form``; more of them than places follow the last."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, c):
        here = c.rlike(place)
        return F.struct(F.concat(s["out"], F.when(here, F.substring(chars, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (s["at"] + here.cast("int")).alias("at"))
    return F.aggregate(F.split(form, ""), start, step, lambda s: F.concat(s["out"], F.substring(chars, s["at"] + 1, F.lit(64))))


def check_digits(country, rest):
    """The two check digits of an IBAN: 98 less the remainder by 97, letters as 10 to 35."""
    def step(s, c):
        at = F.call_function("locate", c, F.lit(FIGURES + UPPER)) - 1
        return F.pmod(s * F.when(at < 10, 10).otherwise(100) + at, F.lit(97))
    return F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step, lambda s: F.lpad((98 - s).cast("string"), 2, "0"))


def more(hex_digits, attempt, alphabet):
    """What later attempts add, so that the space they draw from grows."""
    n = F.greatest(attempt - 2, F.lit(0))
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(31), F.lit(62)), F.lit(1), n), lambda i: draw(hex_digits, i, alphabet)), "")


def luhn(digits):
    return F.call_function("luhn_check", digits)


def surrogate(e, k, c, h, attempt, key):
    """From a mention, its kind, its canonical form, that one's digest and the
    attempt. All are columns or fields that hold a value: each is read often."""
    keep = F.when(k == "card", 1).when(k == "phone", F.length(F.regexp_extract(e, r"^\+(\d{1,3})(?=[ .(-])", 1))).otherwise(0)
    drawn = F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.when(
        i <= keep, F.substring(c, i, F.lit(1))).otherwise(draw(h, i, FIGURES))), "")
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    valid = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), luhn)
    drawn = F.when((k == "card") & luhn(c), valid[0]).otherwise(drawn)
    digits = laid_out(e, F.when(k == "card", drawn).otherwise(F.concat(drawn, more(h, attempt, FIGURES))))

    # The domain is drawn without the local part, so that it stays one domain; its last label stays.
    at = F.locate("@", e)
    domain = F.lower(F.substring(e, at + 1, F.length(e)))
    top = F.regexp_extract(domain, r"\.[^.]*$", 0)
    email = F.concat(alike(F.substring(e, F.lit(1), at - 1), h), more(h, attempt, FIGURES), F.lit("@"),
                     alike(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), digest(key, F.lit("domain"), domain)), top)

    ip = F.concat_ws(".", *[(number(h, F.lit(i), 223 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string") for i in range(4)])
    plain_hex = F.regexp_extract(e, "^[0-9a-f]+$", 0) != ""
    prefix = F.when(plain_hex, F.lit("")).otherwise(F.regexp_extract(e, "^(?:AKIA|gh._)", 0))
    secret = F.when(plain_hex, F.substring(h, F.lit(1), F.length(e))).otherwise(
        F.concat(prefix, alike(F.substring(e, F.length(prefix) + 1, F.length(e)), h)))
    country, account = F.substring(c, 1, 2), alike(F.substring(c, F.lit(5), F.length(c)), h)
    iban = laid_out(e, F.concat(country, check_digits(country, account), account), "[0-9A-Z]")
    hexes = F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(x == ":", x).otherwise(draw(h, i, "123456789abcdef"))), "")
    hexes = F.concat(hexes, more(h, attempt, "123456789abcdef"))
    ipv6 = F.when(e == F.upper(e), F.upper(hexes)).otherwise(hexes)

    title = F.regexp_extract(e, r"^\S+ ", 0)
    whole = F.regexp_extract(e, r"^\S+ (.*)$", 1)
    names, gaps = F.split(whole, "[ -]"), F.split(whole, "[^ -]+")
    before = F.regexp_extract(whole, "^(.*) ", 1)
    n_given = F.when(before == "", 0).otherwise(F.size(F.split(before, "[ -]")))

    def name(word, i):
        given = i < n_given
        # A surname is drawn from itself alone: "Mr Roe" and "Mr Jan Roe" keep their surname in common.
        own = digest(key, F.lit("name"), F.when(given, gender(e)).otherwise(F.lit("")), F.lower(word), attempt)
        out = F.lit("")
        for _, letters, consonants, vowels in reversed(SCRIPTS):
            made = F.concat(*[draw(own, F.lit(j), consonants if j % 2 == 0 else vowels) for j in range(8)],
                            more(own, attempt, vowels))
            ending = F.lit("")
            for g, v in ENDINGS.items():
                ending = F.when(gender(e) == g, F.lit(vowels[v])).otherwise(ending)
            made = F.initcap(F.when(given, F.concat(F.substring(made, F.lit(1), F.length(made) - 1), ending)).otherwise(made))
            out = F.when(word.rlike(f"^{letters}"), made).otherwise(out)
        return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(out)).otherwise(out)
    person = F.concat(title, F.array_join(F.zip_with(gaps, F.transform(names, name), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), ""))

    return (F.when(k.isin(*DIGITS), digits).when(k == "email", email).when(k == "ip", ip).when(k == "secret", secret)
            .when(k == "iban", iban).when(k == "ipv6", ipv6).otherwise(person))


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) for those of ``entities`` (kind, canon, form; distinct)
    whose first surrogate clashes. One round per attempt, over the clashing only."""
    real = entities.select(F.col("kind").alias("rkind"), F.col("canon").alias("rcanon"))
    taken, todo, attempt, again = None, entities, 0, None
    while True:
        made = todo.withColumn("h", digest(key, F.col("kind"), F.col("canon"), F.lit(attempt)))
        made = made.withColumn("s", surrogate(*map(F.col, ("form", "kind", "canon", "h")), F.lit(attempt), key))
        made = made.withColumn("s", canonical(F.col("s"), F.col("kind")))
        won = made.groupBy("kind", "s").agg(F.min("canon").alias("w"))
        won = won.join(real, (F.col("kind") == F.col("rkind")) & (F.col("s") == F.col("rcanon")), "left_anti")
        if taken is not None:
            used = taken.select(F.col("kind").alias("ukind"), F.col("s").alias("us"))
            won = won.join(used, (F.col("kind") == F.col("ukind")) & (F.col("s") == F.col("us")), "left_anti")
        won = materialize(won)
        taken = won if taken is None else taken.union(won)
        if attempt:
            again = materialize(todo.select("kind", "canon", F.lit(attempt).alias("attempt"))) if again is None else again.union(
                materialize(todo.select("kind", "canon", F.lit(attempt).alias("attempt"))))
        winners = won.select(F.col("kind").alias("wkind"), F.col("w"))
        todo = materialize(todo.join(winners, (F.col("kind") == F.col("wkind")) & (F.col("canon") == F.col("w")), "left_anti"))
        if todo.isEmpty():
            break
        attempt += 1
    if again is None:
        return entities.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)
    return again.groupBy("kind", "canon").agg(F.max("attempt").alias("attempt"))


def untitled(found):
    """A pattern of the titled names in ``found`` and of their surnames as they
    stand without a title; null where there are none. Names hold only letters,
    blanks, hyphens and apostrophes."""
    whole = F.transform(F.filter(found, lambda e: e.rlike(f"^{TITLE}")), lambda e: F.regexp_extract(e, r"^\S+ (.*)$", 1))
    forms = F.concat(whole, F.transform(whole, lambda n: F.substring_index(n, " ", -1)))
    # The longest first, so that a surname does not cut a whole name short.
    forms = F.array_distinct(F.reverse(F.array_sort(F.transform(forms, lambda n: F.struct(F.length(n).alias("l"), n.alias("n"))))))
    return F.when(F.size(whole) > 0, F.concat(F.lit(r"(?<![\p{L}'’-])(?:"), F.array_join(forms["n"], "|"), F.lit(r")(?![\p{L}])(?![-'’]\p{L})")))


def last_words(name, n):
    return F.array_join(F.slice(F.split(name, " "), -n, n), " ")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and n_entities.

    ``key`` is secret: with it, the same corpus gives the same surrogates. Null
    texts stay null and empty ones empty, with no entities; very long ones are
    searched whole; an empty table gives no rows. Rows may repeat or share an
    id, or have none. Other columns pass through; a column n_entities is replaced.
    """
    base = docs.drop("n_entities")
    text = F.col(text_col)
    mentions = base.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), row_print(text_col).alias("row"),
                           F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))).alias("form"))
    mentions = mentions.withColumn("kind", kind(F.col("form")))
    mentions = materialize(mentions.withColumn("canon", canonical(F.col("form"), F.col("kind"))))
    entities = materialize(mentions.groupBy("kind", "canon").agg(F.min("form").alias("form")))
    again = resolve(entities, key).select(F.col("kind").alias("akind"), F.col("canon").alias("acanon"), "attempt")
    adoc, arow, attempts, found, titled, key_col, row_col, more_names = (
        fresh(base, x) for x in ("adoc", "arow", "attempts", "found", "titled", "doc", "row", "names"))
    per_doc = (mentions.join(again, (F.col("kind") == F.col("akind")) & (F.col("canon") == F.col("acanon")))
               .groupBy(F.col("doc").alias(adoc), F.col("row").alias(arow))
               .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "canon"), "attempt"))).alias(attempts)))
    joined = base.withColumns({key_col: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), row_col: row_print(text_col)})
    joined = joined.join(per_doc, (F.col(key_col) == F.col(adoc)) & (F.col(row_col) == F.col(arow)), "left")
    every = lambda pattern: F.coalesce(F.regexp_extract_all(text, pattern, F.lit(0)), F.array().cast("array<string>"))
    joined = joined.withColumn(titled, every(F.lit(ENTITY)))
    joined = joined.withColumn(more_names, untitled(F.col(titled)))
    pattern = F.concat(F.lit(ENTITY + "|"), F.col(more_names))
    joined = joined.withColumn(found, F.when(F.col(more_names).isNull(), F.col(titled)).otherwise(every(pattern)))

    # A name without a title stands for the first titled name that ends like it.
    def meant(e):
        like = F.filter(F.col(titled), lambda f: f.rlike(f"^{TITLE}") & f.endswith(F.concat(F.lit(" "), e)))
        return F.when(F.col(more_names).isNull() | F.array_contains(F.col(titled), e), e).otherwise(F.coalesce(F.get(like, F.lit(0)), e))

    # One step of transform per field, so that no field is worked out more than once a mention.
    steps = [("t", lambda x: meant(x["e"])), ("k", lambda x: kind(x["t"])), ("c", lambda x: canonical(x["t"], x["k"])),
             ("a", lambda x: F.coalesce(F.try_element_at(F.col(attempts), F.concat_ws(" ", x["k"], x["c"])), F.lit(0))),
             ("h", lambda x: digest(key, x["k"], x["c"], x["a"])),
             ("s", lambda x: surrogate(x["t"], x["k"], x["c"], x["h"], x["a"], key))]
    def with_field(mention, have, name, value):
        return F.transform(mention, lambda x: F.struct(*[x[n].alias(n) for n in have], value(x).alias(name)))

    mention, have = F.transform(found, lambda e: F.struct(e.alias("e"))), ["e"]
    for name, value in steps:
        mention = with_field(mention, have, name, value)
        have.append(name)
    new_forms = F.transform(mention, lambda x: F.when(x["e"] == x["t"], x["s"]).otherwise(
        last_words(x["s"], F.size(F.split(x["e"], " ")))))

    gaps = F.when(F.col(more_names).isNull(), F.split(text, ENTITY, -1)).otherwise(F.split(text, pattern, -1))
    parts = F.zip_with(gaps, new_forms, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    new = F.when(F.size(found) == 0, text).otherwise(F.array_join(parts, ""))
    return joined.select(*[new.alias(c) if c == text_col else base[c] for c in base.columns],
                         F.size(found).cast("long").alias("n_entities"))
