"""Surrogates for personal data and secrets (operator 5), all in DataFrame functions.

Every detected entity is replaced by a made-up one of the same kind, derived from a key: the same entity
gets the same surrogate everywhere (coreference), different entities get different ones (distinctness).
Format, script and grammatical gender of the original stay.  Surrogates are checked against each other
and against the real entities of the corpus; an entity that loses such a check draws again.  A format may
have fewer surrogates than entities (all numbers of four digits), so from the third redraw on a surrogate
is one character longer with every further one: each of these rounds has at least ten times the room of
the one before, and their number grows with the logarithm of the entities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from llm.common import written

MARK, GUARD = "\u0001", "\u0002"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Forms of address by grammatical gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Miss", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "г-жа", "Κυρία")
_ADDRESS = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]+"

#: Values of secrets: quoted ones up to their quote, others up to white space without the punctuation that ends a
#: clause; a quote that is never closed only opens.  Separators alone are no secret.
_VALUE = (
    r"\"(?![+/_\s-]*+\")(?:[^\"\\\r\n\x01\x02]|\\[^\r\n\x01\x02]){8,}+\"|'(?![+/_\s-]*+')(?:[^'\\\r\n\x01\x02]|\\[^\r\n\x01\x02]){8,}+'"
    r"|(?![\"']?[+/_-]++[\"'.,;:!?)\]}>]*+(?:\s|$))"
    r"(?:\"[^\s\"\x01\x02]{8,}|'[^\s'\x01\x02]{8,}|(?![\"'])[^\s\x01\x02]{7,}[^\s\x01\x02\"'.,;:!?)\]}>])"
)

#: What a mention looks like, by kind; tried in this order.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}",  # a domain has at most 127 labels
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z])(?i:password|passwd|secret|token|api_key|apikey|access_key)[\"']?\s{{0,3}}[=:]\s{{0,3}}(?:{_VALUE})",
    "hex_key": r"[\"'](?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})[\"']",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_ADDRESS})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{form})" for form in FORMS.values())
_DIGITS = ("phone", "national_id", "card")  # compared and replaced by their digits, separators stay

#: What stands for punctuation in a made-up secret, safe between quotes.
SIGNS = "!#$%&*?@"
#: Draws of the original length; later ones grow.
PLAIN_DRAWS = 3
#: Letters that made-up names are built of.
LETTERS = {"latin": ("bdfgklmnprstvz", "aeiou", "a", "n"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "н"), "greek": ("βγδζκλμνπρστ", "αειου", "α", "ς")}


_FIRST = "".join(sorted({a[0] for a in MALE + FEMALE}))


def may_hold(text: Column) -> Column:
    """True wherever a form of :data:`FORMS` can match: a cheap scan that spares most texts the long one.

    E-mail needs an at sign, secrets = or :, numbers a digit; the other three are looked for by their start.
    """
    quick = text.rlike("[0-9@=:]") | text.contains("AKIA") | text.contains("ASIA") | text.rlike("[\"'][0-9a-f]{32}")
    return quick | text.rlike(rf"(?=[{_FIRST}])(?:{_ADDRESS})\.? \p{{Lu}}")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column, check_follows: bool) -> Column:
    """Luhn sum of a digit string; with ``check_follows`` as if one more digit came after it."""
    shift = 1 if check_follows else 0
    terms = F.transform(
        F.reverse(_chars(digits)),
        lambda d, i: F.when((i + shift) % 2 == 1, (d.cast("int") * 2).cast("int")).otherwise(d.cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda acc, t: (acc + F.when(t > 9, t - 9).otherwise(t)).cast("int"))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _secret_parts(x: Column) -> tuple[Column, Column, Column]:
    lead = F.regexp_extract(x, r"^(.*?[=:]\s{0,3}[\"']?)", 1)
    tail = F.regexp_extract(x, r"([\"']?)$", 1)
    return lead, F.substr(x, F.length(lead) + 1, F.length(x) - F.length(lead) - F.length(tail)), tail


def _name_tokens(x: Column) -> Column:
    return F.slice(F.split(x, " "), 2, 2)


def entities(x: Column) -> Column:
    """The entities that a mention names: array of (kind, norm); empty if it only looked like one.

    A name has one for each of its words, so "Mrs Ada Stone" and "Mrs Stone" share the second.
    """
    entity = lambda kind, norm: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))
    is_a = lambda kind: x.rlike(f"^(?:{FORMS[kind]})$")
    none = F.expr("CAST(array() AS array<struct<kind:string,norm:string>>)")
    address = F.regexp_replace(F.split(x, " ")[0], r"\.$", "")
    gender = F.when(address.isin(*FEMALE), "f").otherwise("m")
    script = lambda t: F.when(t.rlike(r"\p{IsCyrillic}"), "cyrillic").when(t.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    tokens = _name_tokens(x)
    names = F.transform(
        tokens,
        lambda t, i: entity(
            F.concat(F.when(i == F.size(tokens) - 1, F.lit("surname_")).otherwise(F.concat(F.lit("given_"), gender, F.lit("_"))), script(t)), F.lower(t)
        ),
    )
    digits = _only_digits(x)
    return (
        F.when(is_a("email"), F.array(entity("email", F.lower(x))))
        .when(is_a("cloud_key"), F.array(entity("cloud_key", x)))
        .when(is_a("secret"), F.array(entity("secret", _secret_parts(x)[1])))
        .when(is_a("hex_key"), F.array(entity("secret", F.substr(x, F.lit(2), F.length(x) - 2))))
        .when(is_a("phone"), F.array(entity("phone", digits)))
        .when(is_a("national_id"), F.array(entity("national_id", digits)))
        .when(is_a("ip"), F.array(entity("ip", x)))
        .when(is_a("card"), F.when(_luhn_sum(digits, False) % 10 == 0, F.array(entity("card", digits))).otherwise(none))
        .when(is_a("iban"), F.array(entity("iban", F.replace(x, F.lit(" "), F.lit("")))))
        .when(is_a("name"), names)
        .otherwise(none)
    )


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The made-up normal form for an entity.

    From attempt ``PLAIN_DRAWS`` on it is longer by one character an attempt, at the end of a number, key,
    word or local part.  An IPv4 address first leaves the reserved range 240 to 255 for any, three attempts
    later it gets a fifth number, which no address of the corpus has.
    """
    growth = F.greatest(attempt - (PLAIN_DRAWS - 1), F.lit(0))
    digest = F.sha2(F.concat_ws(MARK, F.lit(key), kind, norm, attempt.cast("string")), 512)
    of_domain = F.sha2(F.concat_ws(MARK, F.lit(key), F.lit("domain"), F.split(norm, "@")[1], attempt.cast("string")), 512)

    def draw(i: Column | int, source: Column = digest) -> Column:
        place = (F.lit(i) if isinstance(i, int) else i) % 32
        return F.conv(F.substr(source, place * 4 + 1, F.lit(4)), 16, 10).cast("int")

    def like(text: Column, first: int = 0, source: Column = digest, signs: bool = False) -> Column:
        """Digits by digits, letters by letters; hexadecimal stays hexadecimal.  With ``signs`` all but separators changes."""
        letters = F.when(text.rlike("^[0-9a-f]+$"), 6).otherwise(26)

        def one(c: Column, i: Column) -> Column:
            n = draw(i + first, source)
            out = (
                F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.chr(n % letters + 97))
                .when(c.rlike("[A-Z]"), F.chr(n % 26 + 65))
            )
            if signs:
                out = out.when(c.rlike("[!-~&&[^+/_-]]"), F.substr(F.lit(SIGNS), n % len(SIGNS) + 1, F.lit(1))).when(~c.rlike(r"[+/_\s-]"), F.chr(n % 26 + 97))
            return out.otherwise(c)

        return F.array_join(F.transform(_chars(text), one), "")

    def more(letters: str) -> Column:
        """``growth`` characters of ``letters``, each of them worth at least 3 bits of a digest of its own."""
        rest = F.sha2(F.concat_ws(MARK, F.lit(key), F.lit("more"), kind, norm, attempt.cast("string")), 512)
        return F.when(growth > 0, F.left(F.translate(rest, "0123456789abcdef", (letters * 16)[:16]), growth)).otherwise("")

    digits, small, capital = more("0123456789"), more("abcdefghijklmnop"), more("ABCDEFGHIJKLMNOP")
    label = F.concat(*[F.chr(draw(i, of_domain) % 26 + 97) for i in range(6)])
    top = F.element_at(F.array(F.lit("com"), F.lit("org"), F.lit("net")), (draw(6, of_domain) % 3 + 1).cast("int"))
    email = F.concat(like(F.split(norm, "@")[0]), small, F.lit("@"), label, F.lit(".example."), top)
    lead = F.greatest(F.length(norm) - 10, F.lit(0))
    phone = F.concat(F.substr(norm, F.lit(1), lead), (draw(31) % 8 + 2).cast("string"), like(F.substr(norm, lead + 2)), digits)
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), like(F.substr(norm, F.lit(2), F.length(norm) - 2)), digits)
    card = F.concat(body, ((10 - _luhn_sum(body, True) % 10) % 10).cast("string"))
    first = F.when(growth > 0, draw(0) % 255 + 1).otherwise(draw(0) % 15 + 240)
    ip = F.concat_ws(".", first.cast("string"), *[(draw(i) % 256).cast("string") for i in (1, 2, 3)], F.when(growth > 3, (draw(4) % 256).cast("string")))

    def name(script: str) -> Column:
        consonants, vowels, female, male = LETTERS[script]
        letter = lambda letters, i: F.substr(F.lit(letters), (draw(i) % len(letters)).cast("int") + 1, F.lit(1))
        syllables = [letter(s, 2 * i + k) for i in range(4) for k, s in enumerate((consonants, vowels))]
        end = F.when(kind.startswith("given_f"), female).when(kind.startswith("given_m"), male).otherwise("")
        return F.concat(*syllables, more(consonants + vowels), end)

    out = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
    out = out.when(kind == "national_id", F.concat(F.lit("9"), like(F.substr(norm, F.lit(2))), digits))
    out = out.when(kind == "iban", F.concat(F.substr(norm, F.lit(1), F.lit(2)), like(F.substr(norm, F.lit(3))), digits))
    out = out.when(kind == "cloud_key", F.concat(F.substr(norm, F.lit(1), F.lit(4)), like(F.substr(norm, F.lit(5))), capital))
    for script in LETTERS:
        out = out.when(kind.endswith(f"_{script}"), name(script))
    return out.otherwise(F.concat(like(norm, signs=True), F.when(norm.rlike("[A-Za-z]"), more("0123456789abcdef")).otherwise(digits)))


def _refill(x: Column, characters: Column, kind: str) -> Column:
    """``x`` with its characters of the class ``kind`` replaced in turn; everything between them stays, what is left over follows."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        hit = c.rlike(kind)
        return F.struct(
            F.concat(acc["out"], F.when(hit, F.substr(characters, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + F.when(hit, 1).otherwise(0)).cast("int").alias("at"),
        )

    return F.aggregate(_chars(x), zero, step, lambda acc: F.concat(acc["out"], F.substr(characters, acc["at"])))


def render(x: Column, kinds: Column, fakes: Column) -> Column:
    """The mention ``x`` with its entities replaced, in the format of the original."""
    kind, fake = kinds[0], fakes[0]
    lead, _, tail = _secret_parts(x)
    address = F.split(x, " ")[0]
    tokens = _name_tokens(x)
    cased = lambda original, made: F.when((F.length(original) > 1) & (original == F.upper(original)), F.upper(made)).otherwise(F.initcap(made))
    names = F.array_join(F.transform(fakes, lambda f, i: cased(F.get(tokens, i), f)), " ")
    return (
        F.when(kind.isin(*_DIGITS), _refill(x, fake, "[0-9]"))
        .when(kind == "iban", _refill(x, fake, "[A-Z0-9]"))
        .when(kind == "email", F.when(x == F.upper(x), F.upper(fake)).otherwise(fake))
        .when((kind == "secret") & x.rlike("[=:]"), F.concat(lead, fake, tail))
        .when(kind == "secret", F.concat(F.left(x, F.lit(1)), fake, F.right(x, F.lit(1))))
        .when(kind.startswith("given_") | kind.startswith("surname_"), F.concat(address, F.lit(" "), names))
        .otherwise(fake)
    )


def _mentions(text: Column) -> Column:
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def _pieces(text: Column) -> Column:
    """Text cut into what lies between mentions (even places) and mentions (odd places)."""
    safe = F.replace(F.replace(text, F.lit(GUARD), F.lit(GUARD + "b")), F.lit(MARK), F.lit(GUARD + "a"))
    return F.when(may_hold(text), F.split(F.regexp_replace(safe, ANY, f"{MARK}$0{MARK}"), MARK))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(GUARD + "a"), F.lit(MARK)), F.lit(GUARD + "b"), F.lit(GUARD))


def redraws(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The entities whose first surrogate is not theirs alone: id (kind and norm), attempt.

    Two entities may not share a surrogate, and a surrogate may not be a real entity of its kind.  Of those
    that draw the same in one round the least norm keeps it, one of an earlier round is taken.  Settled
    entities stay settled, so a round draws and writes only what the round before left open.
    """
    mentions = docs.select(F.explode(_mentions(F.col(f"`{text}`").cast("string"))).alias("x"))
    found = mentions.distinct().select(F.explode(entities(F.col("x"))).alias("e")).select("e.kind", "e.norm").distinct()
    known = written(found, "entities")
    taken = known.select(F.col("kind").alias("_kind"), F.col("norm").alias("_fake"))
    attempt, open_, settled = 0, known, []
    while True:
        drawn = written(open_.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key).alias("fake")), "surrogates")
        free = drawn.join(taken, F.expr("kind = _kind AND fake = _fake"), "left_anti")
        won = written(free.groupBy("kind", "fake").agg(F.min("norm").alias("norm"), F.lit(attempt).alias("attempt")), "settled")
        lost = drawn.join(won.select(F.col("kind").alias("_kind"), F.col("norm").alias("_norm")), F.expr("kind = _kind AND norm = _norm"), "left_anti")
        open_ = written(lost.select("kind", "norm"), "open")
        if attempt:
            settled.append(won)
        if open_.isEmpty():
            break
        taken = taken.union(won.select("kind", "fake"))
        attempt += 1
    if not settled:
        return open_.select(F.concat_ws(MARK, "kind", "norm").alias("id"), F.lit(0).alias("attempt"))
    return reduce(DataFrame.union, settled).select(F.concat_ws(MARK, "kind", "norm").alias("id"), "attempt")


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, kinds (sorted, distinct).

    Null text stays null with no entities; a text without entities stays as it is.  Repeated rows and ids
    are treated alike.  Other columns are not read.
    """
    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    again = written(redraws(docs, key, text), "redraws")
    odd = lambda p, i: i % 2 == 1
    cut = body.select("doc_id", "text", _pieces(F.col("text")).alias("pieces"))
    named = body.select("doc_id", F.explode(_mentions(F.col("text"))).alias("x"))
    named = named.select("doc_id", F.explode(entities(F.col("x"))).alias("e")).select("doc_id", F.concat_ws(MARK, "e.kind", "e.norm").alias("id"))
    if again.isEmpty():  # nothing drew twice: the surrogate is a function of the entity alone
        attempts, joined = F.lit(None).cast("map<string,int>"), cut
    else:
        listed = named.distinct().join(again, "id").groupBy(F.col("doc_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("id", "attempt"))).alias("_again"))
        joined, attempts = cut.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")), "left"), F.col("_again")

    def replace(p: Column, i: Column) -> Column:
        fake = lambda e: surrogate(e["kind"], e["norm"], F.coalesce(F.try_element_at(attempts, F.concat_ws(MARK, e["kind"], e["norm"])), F.lit(0)), key)
        return F.when((i % 2 == 1) & (F.size(entities(p)) > 0), render(p, F.transform(entities(p), lambda e: e["kind"]), F.transform(entities(p), fake))).otherwise(p)

    found = F.flatten(F.transform(F.filter("pieces", odd), lambda p: F.transform(entities(p), lambda e: e["kind"])))
    return joined.select(
        "doc_id",
        F.when(F.size("pieces") > 1, _plain(F.array_join(F.transform("pieces", replace), ""))).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")).alias("kinds"),
    )
