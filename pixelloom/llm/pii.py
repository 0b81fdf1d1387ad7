"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

DataFrame functions only.  One pattern finds the entities of a text; a text is cut at them
(``split``), each entity is replaced by the surrogate of its canonical form, and the pieces are
joined again.  So equal entities get equal surrogates everywhere (coreference), also when they
are written differently: numbers are compared by their digits, names and addresses without case.

Surrogates are made from sha-256 of (key, type, attempt, canonical form):
  digits    card, phone, id and account numbers: new digits in the place of the old, separators, letters,
            length, leading digit (cards; their check digit is made valid) and country code (phones) kept
  email     letters (in their script) and digits of the local part changed, host under a reserved example domain
  ip        four new octets; hexip (version 6): new hex digits, colons kept
  secret    hex digits, letters and digits exchanged place by place for their own kind
  names     syllables of the name's script (Latin, Cyrillic, Greek) with an ending of the given name's
            gender; capitals as found.  A name is found by a list of given names, by a title before it, or by
            words that introduce one ("my name is", "signed by") and up to one capitalised word between.
            A surname found once is replaced wherever the document repeats it, in any spelling of capitals, also before ``'s``: between the
            entities every capitalised word is looked up among the document's surnames.

Collision check: the distinct entities of all documents are grouped by surrogate; where two share
one, or one is itself an entity of the corpus, all but the first are made anew with the next
attempt, until none is left; names get more syllables with later attempts.  Distinct entities thus stay
distinct; hosts of e-mails get more digits with later attempts; an error is raised if a format has fewer values than the corpus has entities of it.

The entities, not the texts, are what the collision rounds move; the final surrogates come back to
a document as one map per doc_id (per text, where the id is null).  Defined cases: null text stays null, empty text empty; other columns pass
through, whatever their names; repeated rows are treated alike; rows of one doc_id share a map; very long
texts are searched whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_stored, fresh, q, stored

# Given names by gender, and titles before a surname.
MALE = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "François", "José", "Juan", "Carlos", "Luis", "Иван", "Александр", "Дмитрий", "Сергей", "Γιώργος", "Νίκος")
FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Ursula", "Monika", "Sabine", "Marie", "Isabelle", "Céline", "María", "Carmen", "Lucía", "Ana", "Анна", "Мария", "Елена", "Ольга", "Μαρία", "Ελένη")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")
# Words that introduce a name.
INTRODUCED = ("name is", "Name:", "named", "signed by", "Signed by", "Contact:", "heiße", "Name ist", "m'appelle", "nom est", "me llamo", "nombre es", "меня зовут")
# Letters that the sixteen of a surrogate stand for, by script.
SIXTEEN, SIXTEEN_CYRILLIC, SIXTEEN_GREEK = "ghijklmnopabcdef", "абвгдежзиклмнопр", "αβγδεζηθικλμνξοπ"
# Syllables by script.
LATIN = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "se", "ta", "te", "to", "va", "ve")
CYRILLIC = ("ба", "бо", "ва", "ве", "да", "до", "за", "ка", "ко", "ла", "ло", "ма", "мо", "на", "но", "по")
GREEK = ("βα", "γα", "δο", "κα", "κο", "λα", "λο", "μα", "μο", "να", "νο", "πα", "ρο", "σα", "τα", "το")

_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: All alternatives are tried only where no letter or digit stands before.
START = r"(?<![\p{L}\p{N}])"
EMAIL = r"[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
HEX = r"(?=[a-fA-F]{0,63}[0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])"
ASSIGN = r"(?i:token|secret|passw(?:or)?d|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
ASSIGNED = ASSIGN + r"(?![\"'\s])[^\s\"',;]{6,}+"
IP = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
IP6 = r"(?=[0-9a-fA-F:]{0,39}\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])"
IBAN = r"(?=[A-Z]{2}\d{2}(?:[A-Z ]{0,12}\d){6})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<!-)\d(?:[ -]?\d){12,18}(?![\d-])"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"(?:(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?![\d-])"
    r"|(?:\+\d{1,3}[ .-]?\d|0\d)(?:[ .-]\d{2}){4}(?![\d-])|\+\d{1,3}[ .-]?\d{2,4}[ .-]?\d{6,8}(?![\d-])|\+\d{8,14}(?![\d-]))"
)
_GIVEN = "|".join(n for x in MALE + FEMALE for n in (x, x.upper()))
GIVEN = "(?:" + _GIVEN + r")(?!\p{L})"
_INTRODUCED = "(?:" + "|".join(INTRODUCED) + ")"
SURNAME = r"(?<=(?:" + _GIVEN + "|(?:" + "|".join(TITLES) + r")\.?|" + _INTRODUCED + r"(?: \p{Lu}[\p{L}'’-]{1,20})?) )" + _NAME
#: A capitalised word, which may be a surname found elsewhere in the document.
WORD = r"(?<![\p{L}\p{N}])" + _NAME + r"(?!\p{L})"
POSSESSIVE = "['’][sS]$"
PATTERN = (
    START + "(?:(?=[\\d+(])(?:" + "|".join((IP, CARD, SSN, PHONE)) + ")|(?=\\p{Lu})(?:" + "|".join((IBAN, GIVEN, SURNAME))
    + ")|" + "|".join((ASSIGNED, IP6, HEX, EMAIL)) + ")"
)

#: Distinct entities whose surrogates one task makes.
TASK_ENTITIES = 2_000
DIGIT_TYPES = ("card", "iban", "ssn", "phone")


def kind_of(x: Column) -> Column:
    """Type of a found entity."""
    return (
        F.when(x.rlike(r"^[^\s@]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), "email")
        .when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(x.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$"), "hexip")
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(x.rlike(r"^[A-Z]{2}\d{2}[ A-Z\d]{8,}$") & x.rlike(r"(\d\D*){8}"), "iban")
        .when(x.rlike(r"^\d([ -]?\d){12,18}$"), "card")
        .when(x.rlike(r"^\+?[\d(][\d() .-]*\d$") & x.rlike(r"[() .+-]"), "phone")
        .when(F.upper(x).isin(*map(str.upper, MALE)), "male")
        .when(F.upper(x).isin(*map(str.upper, FEMALE)), "female")
        .when(x.rlike("^" + _NAME + "$"), "surname")
        .otherwise("secret")
    )


def canonical(x: Column, kind: Column) -> Column:
    """``type|form``: what makes two mentions the same entity."""
    form = F.when(kind.isin(*DIGIT_TYPES), F.regexp_replace(x, r"[^A-Z\d]", "")).when(kind == "ip", x).when(kind == "secret", F.regexp_replace(x, "^" + ASSIGN, "")).when(kind == "surname", F.lower(F.regexp_replace(x, POSSESSIVE, ""))).otherwise(F.lower(x))
    return F.concat(kind, F.lit("|"), form)


def _digest(secret_key: str, attempt: Column, canon: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret_key), attempt.cast("string"), canon), 256)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _number(hexes: Column, at: int, width: int = 4) -> Column:
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("int")


def _syllables(h: Column, table: tuple[str, ...], count: int, first: int = 0) -> Column:
    t = F.array(*map(F.lit, table))
    return F.concat(*(F.element_at(t, _number(h, 1 + 3 * k, 3) % len(table) + 1) for k in range(first, first + count)))


def _luhn(digits: Column) -> Column:
    """``digits`` with its last digit set so that the check sum holds."""
    body = _chars(F.substring(digits, 1, 30))
    n = F.size(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n - 1), F.lit(0),
        lambda acc, i: acc + (lambda d: F.when((n - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))(F.element_at(body, i).cast("int")),
    )
    return F.concat(F.array_join(F.slice(body, F.lit(1), n - 1), ""), ((F.lit(10) - total % 10) % 10).cast("string"))


def with_surrogate(canons: DataFrame, secret_key: str) -> DataFrame:
    """``canons`` (canon, attempt) with ``surrogate``: a pure function of key, attempt and entity.

    The hash and what is drawn from it are columns of their own, so each is made once a row.
    """
    rows = canons.select("canon", "attempt", F.substring_index("canon", "|", 1).alias("kind"), F.regexp_replace("canon", r"^[a-z]+\|", "").alias("form"), _digest(secret_key, F.col("attempt"), F.col("canon")).alias("h"))
    hexes = F.concat("h", F.sha2("h", 256))
    rows = rows.select("*", hexes.alias("hexes"), F.translate(hexes, "abcdef", "012345").alias("stream"), F.translate(F.concat(F.sha2(F.concat("h", F.lit("l")), 256), "h"), "0123456789", "ghijklmnop").alias("letters"))
    kind, form, h, attempt, stream, hexes, letters = map(F.col, ("kind", "form", "h", "attempt", "stream", "hexes", "letters"))
    size = F.length(form)
    digits = F.array_join(F.transform(_chars(form), lambda c, i: F.when(c.rlike(r"\d"), stream.substr(i % 128 + 1, F.lit(1))).otherwise(c)), "")
    # Country codes of one digit (1, 7) or two, and a leading zero, stay.
    trunk = F.when(form.startswith("0"), 1).when(size <= 10, 0).when((size == 11) & form.rlike("^[17]"), 1).otherwise(2)
    keep = F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "phone", trunk).otherwise(0)
    fresh_digits = F.concat(form.substr(F.lit(1), keep), digits.substr(keep + 1, size))
    # An area code doesn't begin with 0 or 1.
    fresh_digits = F.when((kind == "phone") & (size >= 10), F.concat(form.substr(F.lit(1), keep), (_number(h, 1) % 8 + 2).cast("string"), digits.substr(keep + 2, size))).otherwise(fresh_digits)
    is_hex = form.rlike("^[0-9a-f]+$")
    place = lambda s, i: s.substr(i % 128 + 1, F.lit(1))
    secret = F.array_join(F.transform(_chars(form), lambda c, i: F.when(is_hex, place(hexes, i)).when(c.rlike(r"\d"), place(stream, i)).when(c.rlike(r"\p{Lu}"), F.upper(place(letters, i))).when(c.rlike(r"\p{L}"), place(letters, i)).otherwise(c)), "")
    ip6 = F.array_join(F.transform(_chars(form), lambda c, i: F.when(c == ":", c).otherwise(place(hexes, i))), "")
    cyrillic, greek = form.rlike(r"\p{IsCyrillic}"), form.rlike(r"\p{IsGreek}")
    script = lambda c, x: F.when(c.rlike(r"\p{IsCyrillic}"), F.translate(x, SIXTEEN, SIXTEEN_CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), F.translate(x, SIXTEEN, SIXTEEN_GREEK)).otherwise(x)
    local = F.substring_index(form, "@", 1)
    mail = F.array_join(F.transform(_chars(local), lambda c, i: F.when(c.rlike(r"\d"), place(stream, i)).when(c.rlike(r"\p{L}"), script(c, place(letters, i))).otherwise(c)), "")
    hosts = F.array(*map(F.lit, ("example.com", "example.org", "example.net")))
    email = F.concat(mail, F.lit("@mx"), stream.substr(F.lit(1), attempt * 3 + 3), F.lit("."), F.element_at(hosts, _number(h, 13) % 3 + 1))
    ip = F.concat_ws(".", (_number(h, 1) % 223 + 1).cast("string"), *((_number(h, 5 + 4 * k) % 256).cast("string") for k in range(3)))
    # Four syllables, six from the second attempt on, eight from the fourth.
    names = lambda table: F.concat(_syllables(h, table, 4), F.when(attempt > 0, _syllables(h, table, 2, 4)).otherwise(""), F.when(attempt > 2, _syllables(h, table, 2, 6)).otherwise(""))
    stem = F.when(cyrillic, names(CYRILLIC)).when(greek, names(GREEK)).otherwise(names(LATIN))
    end_female = F.when(cyrillic, "на").when(greek, "να").otherwise("na")
    end_male = F.when(cyrillic, "р").when(greek, "ς").otherwise("n")
    end_surname = F.when(cyrillic, F.when(form.rlike("а$"), "ва").otherwise("в")).when(greek, "ς").otherwise("r")
    name = F.concat(stem, F.when(kind == "female", end_female).when(kind == "male", end_male).otherwise(end_surname))
    made = (
        F.when(kind == "card", _luhn(fresh_digits)).when(kind.isin(*DIGIT_TYPES), fresh_digits)
        .when(kind == "email", email).when(kind == "ip", ip).when(kind == "hexip", ip6).when(kind == "secret", secret).otherwise(name)
    )
    return rows.select("canon", "attempt", made.alias("surrogate"))


def written(entity: Column, kind: Column, canon_surrogate: Column) -> Column:
    """The surrogate in the format of the mention: separators of numbers, capitals of names."""
    chars = _chars(entity)
    # The n-th letter or digit of the mention becomes the n-th of the surrogate.
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"[A-Z\d]"), canon_surrogate.substr(F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.rlike(r"[A-Z\d]"))), F.lit(1))).otherwise(c)), "")
    upper = (F.upper(entity) == entity) & (F.length(entity) > 1)
    name = F.when(upper, F.upper(canon_surrogate)).otherwise(F.initcap(canon_surrogate))
    name = F.concat(name, F.when(kind == "surname", F.regexp_extract(entity, POSSESSIVE, 0)).otherwise(""))
    return F.when(kind.isin(*DIGIT_TYPES), number).when(kind.isin("male", "female", "surname"), name).when((kind == "email") & upper, F.upper(canon_surrogate)).when(kind == "secret", F.concat(F.regexp_extract(entity, "^(" + ASSIGN + ")?", 0), canon_surrogate)).otherwise(canon_surrogate)


def entities(text: Column, pattern: str | Column = PATTERN) -> Column:
    """All mentions in a text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


def assign(canons: DataFrame, secret_key: str, rounds: int = 50) -> DataFrame:
    """canon, surrogate for distinct canonical entities, free of collisions.

    Each round groups by (type, surrogate): the least entity keeps it, unless the surrogate is
    itself an entity of the corpus; the others go on.  Settled ones are never changed again.
    """
    todo = canons.select("canon", F.lit(0).alias("attempt"))
    settled: DataFrame | None = None
    for turn in range(rounds):
        # Few bytes but much work a row: dealt by number of rows, not by bytes.
        made = stored(with_surrogate(todo.repartition(1 + todo.count() // TASK_ENTITIES, "canon"), secret_key), f"pii-made{turn}")
        made = made.withColumn("as_canon", F.concat(F.substring_index("canon", "|", 1), F.lit("|"), F.col("surrogate")))
        taken = canons.select(F.col("canon").alias("as_canon"))
        if settled is not None:
            taken = taken.union(settled.select(F.concat(F.substring_index("canon", "|", 1), F.lit("|"), F.col("surrogate"))))
        taken = taken.distinct().withColumn("taken", F.lit(True))
        first = made.groupBy("as_canon").agg(F.min("canon").alias("winner"))
        out = stored(made.join(first, "as_canon").join(taken, "as_canon", "left").select("canon", "attempt", "surrogate", ((F.col("winner") == F.col("canon")) & F.col("taken").isNull()).alias("won")), f"pii-round{turn}")
        good = out.where("won").select("canon", "surrogate")
        settled = good if settled is None else settled.union(good)
        if not out.where("not won").head(1):
            return settled
        todo = out.where("not won").select("canon", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError("surrogates still collide: the format has too few values for the corpus")


def replace_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", secret_key: str = "pixelloom") -> DataFrame:
    """``docs`` with ``text`` replaced, and ``n_entities`` (mentions replaced)."""
    t = col(docs, text)
    # What a document's map is found by; a null id is replaced by the text's hash.
    key = F.coalesce(col(docs, doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(t)))
    found = docs.select(key.alias("id"), F.explode(F.array_distinct(entities(t))).alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    found = found.groupBy("id", canonical(F.col("entity"), F.col("kind")).alias("canon")).agg(F.lit(1).alias("one"))
    found = stored(found.select("id", "canon"), "pii-entities")
    surrogates = assign(stored(found.select("canon").distinct(), "pii-canons"), secret_key)
    maps = found.join(surrogates, "canon").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias("map"))
    names = {c: fresh(docs, f"_pii_{c}") for c in ("id", "map", "key", "found", "gaps")}
    maps = maps.select(F.col("id").alias(names["id"]), F.col("map").alias(names["map"]))
    c = {k: F.col(v) for k, v in names.items()}

    out = docs.withColumn(names["key"], key)
    out = out.join(maps, c["key"] == c["id"], "left")
    body = F.col(q(text))
    # Each step is a transform of its own, so a mention's type and form are made once.
    step = F.transform(entities(body), lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind")))
    step = F.transform(step, lambda s: F.struct(s["x"].alias("x"), s["kind"].alias("kind"), F.element_at(c["map"], canonical(s["x"], s["kind"])).alias("to")))
    swapped = F.transform(step, lambda s: F.coalesce(written(s["x"], s["kind"], s["to"]), F.lit("")))

    def word(x: Column) -> Column:
        """A capitalised word between entities: the surname's surrogate, or itself."""
        return F.struct(x.alias("x"), F.element_at(c["map"], canonical(x, F.lit("surname"))).alias("to"))

    def gap(g: Column) -> Column:
        """What stands between two entities, cut at its capitalised words."""
        return F.struct(F.split(g, WORD, -1).alias("rest"), F.transform(entities(g, WORD), word).alias("words"))

    whole = F.split(body, PATTERN, -1)
    plain = F.transform(whole, lambda g: F.struct(F.array(g).alias("rest"), F.array().cast("array<struct<x:string,to:string>>").alias("words")))
    named = F.exists(F.map_keys(c["map"]), lambda k: k.startswith("surname|"))
    out = out.withColumns({
        names["found"]: F.when(c["map"].isNotNull(), swapped),
        names["gaps"]: F.when(c["map"].isNotNull(), F.when(named, F.transform(whole, gap)).otherwise(plain)),
    })
    again = lambda w: F.coalesce(written(w["x"], F.lit("surname"), w["to"]), w["x"])
    joined = F.transform(c["gaps"], lambda g: F.array_join(F.zip_with(g["rest"], g["words"], lambda a, w: F.concat(F.coalesce(a, F.lit("")), F.when(w.isNotNull(), again(w)).otherwise(F.lit("")))), ""))
    pieces = F.zip_with(joined, c["found"], lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    repeated = F.aggregate(c["gaps"], F.lit(0), lambda n, g: n + F.size(F.filter(g["words"], lambda w: w["to"].isNotNull())))
    n_all = fresh(docs, "n_entities")
    return out.select(
        *(F.when(c["map"].isNotNull(), F.array_join(pieces, "")).otherwise(body).alias(x) if x == text else F.col(q(x)) for x in docs.columns),
        F.coalesce(F.size(c["found"]) + repeated, F.lit(0)).cast("long").alias(n_all),
    )
