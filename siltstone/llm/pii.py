"""Surrogate generation: personal data in texts is replaced by keyed stand-ins of the same kind.

DataFrame functions only. A text is cut at the matches of one pattern; the pieces between stay as they are
and every match gets its surrogate: phone, card and social security numbers and addresses go through a
keyed permutation of their digits (so distinct ones stay distinct; country codes stay, check digits fit),
secrets, bank accounts and mail addresses through a keyed hash. Names are replaced part by part, a given
name by one of the same gender and script and a surname by one of the same script, so that "Mary Smith",
"Mrs Smith" and "Dr Mary Smith" still name one person. The same entity has the same surrogate in all texts,
however it is spelled. A check over all spellings of all entities and name parts finds surrogates that two
of them share or that are themselves in the corpus, and gives those another try.

Limits of detection: names after a title, after a phrase such as "my name is", or whose given name is in
GIVEN or NAMES; other names are not told from capitalised prose. Numbers in the forms of PATTERNS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, stored

# Given names by gender and script, surname syllables by script, and titles by gender.
NAMES = {
    ("m", "latin"): ("James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Daniel", "Matthew", "Hans", "Klaus", "Stefan", "Pierre", "Jacques", "Carlos", "Javier", "Miguel"),
    ("f", "latin"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Ursula", "Sabine", "Monika", "Sophie", "Camille", "Carmen", "Lucia", "Isabel"),
    ("m", "cyrillic"): ("Иван", "Алексей", "Дмитрий", "Сергей", "Николай", "Андрей"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Αικατερίνη", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "do", "fe", "gar", "hol", "jen", "ka", "lin", "mor", "nel", "os", "pra", "rin", "sto", "tan", "vel"),
    "cyrillic": ("ба", "во", "гри", "дор", "зи", "ка", "лен", "мар", "нов", "пет", "рос", "сим", "тар", "фе", "хол", "чер"),
    "greek": ("βα", "γε", "δη", "θο", "κα", "λι", "μα", "νο", "πα", "ρι", "σα", "τε", "φο", "χα", "ψι", "ζω"),
}
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "господин", "г-н", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа", "κυρία"),
    "": ("Dr", "Prof"),
}

# Further given names that are recognised, but never used as surrogates.
GIVEN = {
    "m": ("John", "Paul", "Mark", "Peter", "George", "Kevin", "Brian", "Steven", "Andrew", "Edward", "Frank", "Eric", "Henry", "Jack", "Oliver", "Lukas", "Felix", "Jürgen", "Wolfgang", "Matthias", "Jean", "Louis", "Antoine", "Luis", "José", "Pablo", "Antonio", "Marco", "Luca", "Giovanni", "Владимир", "Михаил", "Павел", "Борис", "Γιάννης", "Παύλος"),
    "f": ("Emily", "Olivia", "Emma", "Anna", "Elena", "Laura", "Julia", "Maria", "Alice", "Grace", "Chloe", "Hannah", "Rachel", "Rebecca", "Nancy", "Helen", "Claudia", "Petra", "Heike", "Greta", "Marie", "Claire", "Juliette", "Ana", "Rosa", "Pilar", "Giulia", "Chiara", "Светлана", "Ирина", "Юлия", "Людмила", "Άννα", "Κατερίνα"),
}

#: Endings of composed given names by gender and script, and those that tell the gender of an unlisted name.
ENDINGS = {("m", "latin"): "ard", ("f", "latin"): "ina", ("m", "cyrillic"): "слав", ("f", "cyrillic"): "ина", ("m", "greek"): "ανος", ("f", "greek"): "ινα"}
FEMALE = r"[aàáâãeéèêiíyаяαάηή]$"

# Country calling codes (ITU E.164) by their first digits; all others have two digits.
CALLING = r"^\+(?:[17]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]|[0-9]{2})"

#: Attempts at a surrogate that differs from all others, before the text is refused as impossible to serve.
MOST_ATTEMPTS = 64

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GIVEN = "|".join(sorted({n for names in (*NAMES.values(), *GIVEN.values()) for n in names}))
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_LABEL = r"(?i:\b(?:token|api[_-]?key|secret|passw(?:or)?d)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
_CUE = r"(?<=[Mm]y name is |[Ii] am called |[Mm]ein Name ist |[Ii]ch heiße |[Jj]e m'appelle |[Mm]e llamo |[Mm]i nombre es )"

#: Kinds in the order in which they are tried. Every pattern begins where no letter or digit stands before.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": rf"{_LABEL}[^\s\"'|]{{8,}}|[0-9a-fA-F]{{32,}}(?![\p{{L}}\p{{N}}])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ipv6": r"(?<!:)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*[0-9])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,5})(?![\p{L}\p{N}:])",
    "phone": r"(?<!\+)(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<!\+)\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![.-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9])|(?<![.,-])0[1-9](?:([ .])[0-9]{2})(?:\2[0-9]{2}){3}(?![0-9])|(?<![.,-])0[1-9][0-9]{1,3}[ /][0-9]{6,8}(?![0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "person": rf"(?=[\p{{Lu}}гκ])(?:(?:{_TITLE})\.? {_WORD}(?: {_WORD})?|(?:{_GIVEN}) {_WORD}|{_CUE}{_WORD}(?: {_WORD})?)(?![\p{{L}}\p{{N}}])",
}


#: One look behind serves all kinds, so that a place inside a word costs no more than that.
MASTER = "(?<![\\p{L}\\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _number(hexes: Column, start: int, digits: int = 12) -> Column:
    return F.conv(F.substring(hexes, start, digits), 16, 10).cast("long")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _part(raw: Column, kind: Column | str, norm: Column) -> Column:
    return F.struct(raw.alias("raw"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))


def _name_parts(e: Column) -> Column:
    """Title, given name, gap and surname of a person; a lone word after a title is a surname unless it is listed."""
    lead = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0)
    words = F.split(F.substr(e, F.length(lead) + 1), " ")
    first, last = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    listed = F.coalesce(*[F.when(first.isin(*[n for (g, _), names in NAMES.items() if g == gender for n in names], *GIVEN[gender]), gender) for gender in ("m", "f")])
    titled = F.coalesce(*[F.when(F.regexp_extract(lead, r"^(.*?)\.? $", 1).isin(*titles), g) for g, titles in TITLES.items() if g])
    gender = F.coalesce(listed, titled, F.when(first.rlike(FEMALE), "f").otherwise("m"))
    surname = last.isNull() & listed.isNull() & (lead != "")
    one = F.when(surname, _part(first, "surname", first)).otherwise(_part(first, "given", F.concat_ws(":", gender, first)))
    parts = F.array(_part(lead, "keep", lead), one, _part(F.when(last.isNotNull(), F.lit(" ")), "keep", F.lit(" ")), _part(last, "surname", last))
    return F.filter(parts, lambda p: F.coalesce(p["raw"] != "", F.lit(False)))


def entities(text: Column) -> Column:
    """array<array<struct<raw, kind, norm>>>: the parts of a text's entities in their order.

    All but names have one part. norm is what coreference goes by; parts of kind keep stay as they are.
    """
    raw = F.regexp_extract_all(text, F.lit(MASTER), F.lit(0))

    def kind(e: Column) -> Column:
        tests = [F.when(e.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items() if k != "person"]
        return F.coalesce(*tests, F.lit("person"))

    def norm(e: Column, k: Column) -> Column:
        digits = F.concat(F.when(F.startswith(e, F.lit("+")), "+").otherwise(""), F.regexp_replace(e, "[^0-9]", ""))
        secret = F.lower(F.regexp_replace(e, f"^{_LABEL}", ""))
        return (
            F.when(k.isin("phone", "ssn", "card"), digits)
            .when(k == "secret", secret)
            .when(k.isin("email", "ipv6"), F.lower(e))
            .when(k == "iban", F.replace(e, F.lit(" "), F.lit("")))
            .otherwise(e)
        )

    typed = F.transform(raw, lambda e: F.struct(e.alias("raw"), kind(e).alias("kind")))
    return F.transform(typed, lambda e: F.when(e["kind"] == "person", _name_parts(e["raw"])).otherwise(F.array(_part(e["raw"], e["kind"], norm(e["raw"], e["kind"])))))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10; 0 for a valid card number."""
    size = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((size - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    values = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), worth)
    return F.aggregate(values, F.lit(0), lambda a, v: (a + F.coalesce(v, F.lit(0))) % 10)


def _mod97(compact: Column) -> Column:
    """A string of digits and letters (A = 10) as a number, modulo 97."""
    signs = F.split(compact, "")
    digit = lambda c: c.between("0", "9")
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c == "", a).when(digit(c), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _permuted_digits(found: Column, key: str) -> Column:
    """Add d to each struct (kind, norm, attempt, ...): the digits of norm after a keyed permutation.

    Four rounds of a Feistel network on the two halves of the digits, by decimal addition: a bijection of
    the digit strings of each length. One transform a round binds the round's values. A calling code and a
    card's first digit stay; a valid card number's check digit is made anew.
    """

    def with_d(e: Column) -> Column:
        lead = F.when(e["kind"] == "card", F.substr(e["norm"], F.lit(1), F.lit(1))).when(F.startswith(e["norm"], F.lit("+")), F.regexp_extract(e["norm"], CALLING, 0)).otherwise("")
        checked = F.when(e["kind"] == "card", (_luhn(e["norm"]) == 0).cast("int")).otherwise(0)
        digits = F.regexp_replace(F.substr(e["norm"], F.length(lead) + 1, F.greatest(F.length(e["norm"]) - F.length(lead) - checked, F.lit(0))), "[^0-9]", "")
        half = F.floor(F.length(digits) / 2).cast("int")
        return F.struct(e.alias("e"), F.replace(lead, F.lit("+"), F.lit("")).alias("lead"), checked.alias("checked"), F.substr(digits, F.lit(1), half).alias("l"), F.substr(digits, half + 1).alias("r"))

    def added(a: Column, b: Column, e: Column, turn: int) -> Column:
        shift = _number(_hash(key, F.lit(f"digits{turn}"), e["kind"], e["attempt"].cast("string"), F.length(a).cast("string"), b), 1)
        size = F.pow(F.lit(10.0), F.length(a)).cast("decimal(20,0)")
        total = F.pmod(a.cast("decimal(20,0)") + shift.cast("decimal(20,0)"), size)
        return F.when(F.length(a) > 0, F.lpad(total.cast("decimal(20,0)").cast("string"), F.length(a), F.lit("0"))).otherwise(a)

    def turn(n: int):
        if n % 2:
            return lambda s: s.withField("l", added(s["l"], s["r"], s["e"], n))
        return lambda s: s.withField("r", added(s["r"], s["l"], s["e"], n))

    def whole(s: Column) -> Column:
        made = F.concat(s["lead"], s["l"], s["r"])
        return F.when(s["checked"] == 1, F.concat(made, ((10 - _luhn(F.concat(made, F.lit("0")))) % 10).cast("string"))).otherwise(made)

    rounds = reduce(lambda a, n: F.transform(a, turn(n)), (1, 2, 3, 4), F.transform(found, with_d))
    return F.transform(rounds, lambda s: s["e"].withField("d", whole(s)))


def _refilled(template: Column, signs: Column, replaced: str = "[0-9]") -> Column:
    """``template`` with its characters of a class replaced in order by ``signs``."""
    at = F.sequence(F.lit(1), F.greatest(F.length(template), F.lit(1)))

    def sign(i: Column) -> Column:
        c = F.substr(template, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substr(template, F.lit(1), i), replaced.replace("[", "[^"), ""))
        return F.when(c.rlike(replaced), F.substr(signs, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(at, sign), "")


def _address(e: Column, key: str) -> Column:
    """An IPv4 address after a keyed permutation of 32 bits (two rounds each way on 16-bit halves)."""
    octets = F.split(e["norm"], r"\.")
    part = lambda i: F.get(octets, F.lit(i)).cast("int")
    halves = F.array(F.struct((part(0) * 256 + part(1)).alias("l"), (part(2) * 256 + part(3)).alias("r")))

    def moved(to: str, by: str, n: int):
        def step(s: Column) -> Column:
            shift = _number(_hash(key, F.lit(f"ip{n}"), e["attempt"].cast("string"), s[by].cast("string")), 1)
            return s.withField(to, F.pmod(s[to] + shift, F.lit(65536)).cast("int"))

        return step

    steps = [moved("l", "r", 1), moved("r", "l", 2), moved("l", "r", 3), moved("r", "l", 4)]
    out = reduce(F.transform, steps, halves)
    text = F.transform(out, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("int").cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("int").cast("string"), (s["r"] % 256).cast("string")))
    return F.get(text, F.lit(0))


def _letters(hexes: Column, count: int, start: int = 1) -> Column:
    """``count`` letters a to z, each from four hex digits."""
    return F.concat(*[_pick(tuple("abcdefghijklmnopqrstuvwxyz"), _number(hexes, start + 4 * k, 4)) for k in range(count)])


def _mail(e: Column, key: str) -> Column:
    """Letters, then as many digits as the local part has, at a reserved domain that stands for the domain."""
    local, domain = F.substring_index(e["norm"], "@", 1), F.substring_index(e["norm"], "@", -1)
    h = _hash(key, F.lit("mail"), e["attempt"].cast("string"), e["norm"])
    digits = F.length(F.regexp_replace(local, "[^0-9]", ""))
    number = F.when(digits > 0, F.concat(F.lit("."), F.substr(F.translate(F.substring(_hash(key, h), 1, 64), "abcdef", "012345"), F.lit(1), digits))).otherwise("")
    site = F.concat(F.lit("d"), F.substring(_hash(key, F.lit("domain"), domain), 1, 8), F.lit(".example."), _pick(("com", "net", "org"), _number(_hash(key, F.lit("tld"), domain), 1)))
    out = F.concat(_letters(h, 12), number, F.lit("@"), site)
    return F.when((e["raw"] == F.upper(e["raw"])) & (e["raw"] != F.lower(e["raw"])), F.upper(out)).otherwise(out)


def _secret(e: Column, key: str) -> Column:
    """The name before the value stays; the value becomes as many hex digits, in the value's case."""
    lead = F.substr(e["raw"], F.lit(1), F.length(e["raw"]) - F.length(e["norm"]))
    value = F.substr(e["raw"], F.length(e["raw"]) - F.length(e["norm"]) + 1)
    hexes = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int")), lambda n: _hash(key, F.lit("secret"), e["attempt"].cast("string"), e["norm"], n.cast("string")))
    out = F.substr(F.array_join(hexes, ""), F.lit(1), F.length(value))
    return F.concat(lead, F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(out)).otherwise(out))


def _iban(e: Column, key: str) -> Column:
    """Country kept, every other letter and digit replaced by one of its class; check digits fit if they did."""
    hexes = F.concat(*[_hash(key, F.lit(f"iban{n}"), e["attempt"].cast("string"), e["norm"]) for n in range(2)])

    def sign(i: Column) -> Column:
        c = F.substr(e["norm"], i, F.lit(1))
        number = F.conv(F.substr(hexes, i * 3 - 2, F.lit(3)), 16, 10).cast("long")
        return F.when(i <= 2, c).when(c.between("0", "9"), _pick(tuple("0123456789"), number)).when(c.between("A", "Z"), _pick(tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), number)).otherwise(c)

    made = F.array_join(F.transform(F.sequence(F.lit(1), F.length(e["norm"])), sign), "")
    country, body = F.substr(e["norm"], F.lit(1), F.lit(2)), F.substr(made, F.lit(5))
    valid = _mod97(F.concat(F.substr(e["norm"], F.lit(5)), F.substr(e["norm"], F.lit(1), F.lit(4)))) == 1
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return _refilled(e["raw"], F.when(valid, F.concat(country, check, body)).otherwise(made), "[A-Z0-9]")


def _hex_groups(e: Column, key: str) -> Column:
    """An IPv6 address with every hex digit replaced, in the case of the original."""
    out = _refilled(e["norm"], _hash(key, F.lit("ipv6"), e["attempt"].cast("string"), e["norm"]), "[0-9a-f]")
    return F.when((e["raw"] == F.upper(e["raw"])) & (e["raw"] != F.lower(e["raw"])), F.upper(out)).otherwise(out)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _composed(h: Column, script: Column, count: Column) -> Column:
    """``count`` syllables of a script, the first letter a capital."""
    spelled = [F.when(script == s, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: _pick(syllables, F.conv(F.substr(h, k * 3 + 1, F.lit(3)), 16, 10).cast("long"))), "")) for s, syllables in SYLLABLES.items()]
    return F.initcap(F.coalesce(*spelled))


def _given_name(e: Column, key: str) -> Column:
    """A listed name of the same gender and script; from the second attempt on a composed one, ever longer."""
    gender, script = F.substr(e["norm"], F.lit(1), F.lit(1)), _script(e["raw"])
    h = _hash(key, F.lit("given"), e["attempt"].cast("string"), e["norm"])
    listed = F.coalesce(*[F.when((gender == g) & (script == s), _pick(names, _number(h, 1))) for (g, s), names in NAMES.items()])
    ending = F.coalesce(*[F.when((gender == g) & (script == s), F.lit(end)) for (g, s), end in ENDINGS.items()])
    return F.when(e["attempt"] == 0, listed).otherwise(F.concat(_composed(h, script, 2 + F.floor(e["attempt"] / 4).cast("int")), ending))


def _surname(e: Column, key: str) -> Column:
    h = _hash(key, F.lit("surname"), e["attempt"].cast("string"), e["norm"])
    return _composed(h, _script(e["raw"]), 4 + F.floor(e["attempt"] / 4).cast("int"))


def surrogates(found: Column, key: str) -> Column:
    """array<string> of the surrogates of array<struct<raw, kind, norm, attempt>>."""
    permuted = _permuted_digits(found, key)

    def one(e: Column) -> Column:
        return (
            F.when(e["kind"] == "keep", e["raw"])
            .when(e["kind"] == "email", _mail(e, key))
            .when(e["kind"] == "secret", _secret(e, key))
            .when(e["kind"] == "ip", _address(e, key))
            .when(e["kind"] == "ipv6", _hex_groups(e, key))
            .when(e["kind"] == "iban", _iban(e, key))
            .when(e["kind"] == "given", _given_name(e, key))
            .when(e["kind"] == "surname", _surname(e, key))
            .otherwise(_refilled(e["raw"], e["d"]))
        )

    return F.transform(permuted, one)


def _tried(found: Column, attempt: Column | int = 0) -> Column:
    """The flat array of parts with their attempt."""
    return F.transform(found, lambda e: e.withField("attempt", F.lit(attempt) if isinstance(attempt, int) else attempt))


def retries(distinct: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate won't do.

    ``distinct`` is (kind, norm, raw), a row for each spelling of each entity. Of entities with the same
    surrogate the least keeps it; a surrogate that is spelled as an entity of the corpus is given up, too.
    All in exchanges by key. Names grow longer with the attempts, so that they can't run out; should any
    entity have none left after MOST_ATTEMPTS (as when numbers of a format are all in use), that is an error.
    """
    todo = distinct.withColumn("attempt", F.lit(0))
    real = distinct.select(F.col("kind"), F.lower(F.col("raw")).alias("surrogate")).distinct().withColumn("real", F.lit(True))
    settled, moved = None, None
    for _ in range(MOST_ATTEMPTS):
        made = todo.withColumn("surrogate", F.lower(F.get(surrogates(F.array(F.struct("raw", "kind", "norm", "attempt")), key), F.lit(0))))
        made = stored(made, "surrogates")
        every = made if settled is None else settled.unionByName(made)
        # What is settled came first and keeps its surrogate.
        taken = every.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("owner")).withColumn("owner", F.col("owner.norm"))
        judged = made.join(taken, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        bad = stored(judged.where((F.col("owner") != F.col("norm")) | F.col("real")).select("kind", "norm").distinct(), "collisions")
        good = made.join(bad, ["kind", "norm"], "left_anti")
        settled = good if settled is None else settled.unionByName(good)
        again = good.where("attempt > 0").select("kind", "norm", "attempt").distinct()
        moved = again if moved is None else moved.unionByName(again)
        if bad.isEmpty():
            return stored(moved, "retries")
        todo = made.join(bad, ["kind", "norm"], "left_semi").select("kind", "norm", "raw", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError(f"no distinct surrogates for {bad.count()} entities after {MOST_ATTEMPTS} attempts, such as {bad.first()['kind']}")


def pseudonymized(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the surrogates in ``text``, and n_entities int added.

    A null text stays null; texts without entities stay as they are; all that lies between entities is
    untouched. Equal rows get equal results. Entities that need another try (usually few) travel to their
    documents by a join; else there is no exchange of texts. A column n_entities of ``df`` gets a leading
    underscore.
    """
    if "n_entities" in df.columns:
        df = df.withColumnRenamed("n_entities", free_name(df, "_n_entities"))
    found = entities(F.col(text))
    single = df.select(F.explode(F.flatten(found)).alias("e")).where("e.kind <> 'keep'").select("e.kind", "e.norm", "e.raw").distinct()
    again = retries(stored(single, "entities"), key)
    made, parts = free_name(df, "made"), free_name(df, "parts")
    rows = df
    if again.isEmpty():
        attempt = lambda e: F.lit(0)
    else:
        uid, tries = free_name(df, "uid"), free_name(df, "tries")
        rows = df.withColumn(uid, F.monotonically_increasing_id())
        named = rows.select(uid, F.explode(F.flatten(found)).alias("e")).select(uid, F.col("e.kind").alias("kind"), F.col("e.norm").alias("norm")).distinct()
        # A document's entities, a few at most of which need another try: an entity of many documents is
        # joined from its own side, so no document's list is longer than the document.
        mine = named.join(again, ["kind", "norm"]).groupBy(uid).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias(tries))
        rows = rows.join(mine, uid, "left")
        attempt = lambda e: F.coalesce(F.get(F.map_values(F.map_filter(F.col(tries), lambda k, v: k == F.concat_ws("|", e["kind"], e["norm"]))), F.lit(0)), F.lit(0))
    rows = rows.withColumn(parts, F.transform(found, lambda m: F.transform(m, lambda e: e.withField("attempt", attempt(e)))))
    rows = rows.withColumn(made, F.transform(F.col(parts), lambda m: F.array_join(surrogates(m, key), "")))
    pieces = F.split(F.col(text), MASTER, -1)
    whole = F.array_join(F.zip_with(pieces, F.col(made), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = rows.withColumn(text, F.when(F.size(made) > 0, whole).otherwise(F.col(text)))
    return out.withColumn("n_entities", F.coalesce(F.size(made), F.lit(0))).select(*df.columns, "n_entities")
