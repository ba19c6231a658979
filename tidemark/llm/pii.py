"""Surrogates for personal data, in SQL functions alone.

Detected entities are replaced by keyed surrogates of the same kind: a mail address by an address with letters, digits
and script alike in place, a card number by one that passes or fails the Luhn check as it did, an IBAN with right check digits
if it had them, a phone number with its country code and punctuation, a person by a name of the same gender and script.
The surrogate depends on the key, the kind and the entity's canonical form, so one entity gets one surrogate in
every document and in every notation (coreference). A collision check over all distinct entities finds surrogates that
two entities share or that equal an entity of the corpus; all but one of them draw again until none is left. What still
collides after MOST_DRAWS has more entities than its format has surrogates: it is written as its kind and a number of its own. A name
draws in two parts: the surname for itself, then the given name among those of the surname. Persons are found by a title, a known given
name, or words that lead to a name (CUES), after which any two capitalised words count; once found, they are also found
in the rest of their text by surname, with or without their given name. A mention's gender is that of its title; without one,
that of most titled forms of the same full name in the corpus, else of the known given name, else of most titled
forms with this given name; a person of whom nothing tells gets a name of either kind.

Defined cases: a null text stays null; a text without entities is returned unchanged; of overlapping entities the
leftmost counts, of equal starts the kind listed first; repeated rows get the same result; further columns stay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable
from tidemark.llm.spans import fixed

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Given names by script and gender, titles by gender. The names are also what surrogates are drawn from.
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Laura", "Julia", "Sarah", "Emma", "Claire", "Sophie", "Elena", "Carmen", "Ingrid", "Hannah", "Olivia", "Alice", "Nora", "Lucia"],
    ("latin", "m"): ["John", "Peter", "Thomas", "Michael", "Robert", "James", "Pierre", "Louis", "Carlos", "Miguel", "Hans", "Klaus", "David", "Daniel", "Oscar", "Henry"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Николай", "Михаил"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "госпожа", "κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"]}
SYLLABLES = {
    "latin": ["bar", "bel", "bor", "dal", "den", "dor", "fal", "fen", "gar", "gel", "hal", "hol", "kar", "kel", "lan", "len", "mar", "mel", "mor", "nal", "nor", "pal", "ran", "rol", "sal", "sen", "tal", "tor", "val", "ven", "wal", "win"],
    "cyrillic": ["бар", "вол", "гор", "дан", "зор", "кар", "лев", "мар", "нов", "пав", "рав", "сав", "тар", "фед", "хар", "чер"],
    "greek": ["βαρ", "γαλ", "δαν", "καλ", "λαμ", "μαρ", "ναν", "παν", "ραν", "σαν", "ταν", "φαν", "χαρ", "ψαρ", "ζαν", "θαν"],
}
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "0123456789"]
CLASSES = ["[a-zß-öø-ÿ]", "[A-ZÀ-ÖØ-Þ]", "[а-яё]", "[А-ЯЁ]", "[α-ωά-ώ]", "[Α-ΩΆ-Ώ]", "[0-9]"]

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Words after which two capitalised words are a person, whatever the names are.
CUES = ["name is", "named", "called", "Name:", "name:", "Contact:", "contact:", "Signed,", "signed", "Regards,", "regards,", "Sincerely,", "Dear", "heiße", "appelle", "llamo", "зовут"]
_CUE = "|".join(CUES)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)|\d{1,4})(?:[\x20.-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\)\x20?\d{3}[-.\x20]\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{4}(?:[\x20-]?\d{4}){2}[\x20-]?\d{1,7}(?!\d)",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.?\x20(?:{_NAME}\x20)?{_NAME}|(?:{_GIVEN})\x20{_NAME}|(?<=(?:{_CUE})\x20){_NAME}\x20{_NAME})(?!\p{{L}})",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Collisions looked up from a constant map up to this many; more are joined.
MAPPED = 5_000
MOST_DRAWS = 16
#: What a match is wrapped in while its text is taken apart; a letter or digit.
MARK, _SIGN = "\x01", r"[\p{L}\p{N}]"
#: A phone number's country code; no code is the start of another.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: From this draw on a short address, an international number or a name gets longer, where its own form has too few surrogates.
WIDER = 3


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def kind_of(entity: Column) -> Column:
    # All kinds but a person hold a digit or an at sign, and a name neither.
    others = [F.when(entity.rlike(rf"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items() if k != "person"]
    return F.when(~entity.rlike("[0-9@]"), F.lit("person")).otherwise(F.coalesce(*others, F.lit("person")))


def canonical(kind: Column, entity: Column) -> Column:
    """One form for all notations: digits of numbers (after a plus where the country code is given), lower case of addresses, names without their title's dot."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(entity, r"\x20", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "person", F.regexp_replace(entity, rf"^({_TITLE})\.?\x20", "$1 "))
        .otherwise(entity)
    )


def _number(hexes: Column, at: Column, below: int) -> Column:
    """A number under ``below`` from four hex digits at a place, read around its end."""
    return (F.conv(F.substring(F.concat(hexes, hexes), F.pmod(at * 3, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _drawn(pool: list[str], hexes: Column, at: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in pool]), _number(hexes, at, len(pool)))


def _like(text: Column, hexes: Column, skip: Column | None = None) -> Column:
    """Each letter and digit after the first ``skip`` replaced by another of its class; the n-th of them by the n-th draw, whatever stands between."""

    def one(c: Column, i: Column) -> Column:
        nth = i + 1
        drawn = F.coalesce(*[F.when(c.rlike(f"^{k}$"), F.substring(F.lit(a), _number(hexes, nth, len(a)) + 1, F.lit(1))) for k, a in zip(CLASSES, ALPHABETS, strict=True)], F.when(c.rlike(r"^\p{L}$"), F.substring(F.lit(ALPHABETS[0]), _number(hexes, nth, 26) + 1, F.lit(1))), c)
        return drawn if skip is None else F.when(nth <= skip, c).otherwise(drawn)

    shown = F.transform(F.regexp_extract_all(text, F.lit(_SIGN), F.lit(0)), one)
    between = F.split(text, _SIGN, -1)
    return F.array_join(F.flatten(F.zip_with(between, F.concat(shown, F.array(F.lit(""))), lambda x, y: F.array(x, y))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _mod97(iban: Column) -> Column:
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _last_digit(text: Column, digit: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), digit.cast("string"))


def _card(text: Column, hexes: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"[^0-9]", "")

    def fit(drawn: Column) -> Column:
        sound = F.pmod(-_luhn(_last_digit(bare(drawn), F.lit(0))), F.lit(10))
        return _let(sound, lambda d: _last_digit(drawn, F.when(_luhn(bare(text)) == 0, d).otherwise((d + 1 + _number(hexes, F.lit(40), 9)) % 10)))

    return _let(_like(text, hexes), fit)


def _iban(text: Column, hexes: Column) -> Column:
    right = _mod97(F.regexp_replace(text, r"\x20", "")) == 1

    def fit(drawn: Column) -> Column:
        rest = F.substring(drawn, F.lit(5), F.length(drawn))
        open_ = F.regexp_replace(F.concat(F.substring(text, 1, 2), F.lit("00"), rest), r"\x20", "")
        check = F.lpad((98 - _let(open_, _mod97)).cast("string"), 2, "0")
        return F.concat(F.substring(text, 1, 2), F.when(right, check).otherwise(F.substring(drawn, 3, 2)), rest)

    return _let(_like(text, hexes, F.lit(2)), fit)


def _parts(text: Column) -> Column:
    """``title, given, surname, gender`` of a person; the gender that the mention tells by itself: by its title (``voiced``), else its given name, else ``u``."""
    part = lambda k: F.regexp_extract(text, rf"^((?:{_TITLE})\.?\x20)?(?:({_NAME})\x20)?({_NAME})$", k)
    title = F.rtrim(F.regexp_replace(part(1), r"\.", ""))
    voiced = F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m")
    listed = {g: [n for (_, of), ns in GIVEN.items() if of == g for n in ns] for g in "fm"}
    gender = F.coalesce(voiced, F.when(part(2).isin(listed["f"]), "f").when(part(2).isin(listed["m"]), "m").otherwise("u"))
    return F.struct(part(1).alias("title"), part(2).alias("given"), part(3).alias("surname"), gender.alias("gender"), voiced.alias("voiced"))


def _pair(p: Column) -> Column:
    return F.concat_ws("|", p["given"], p["surname"])


def _settled(p: Column, learned: Column) -> Column:
    """The gender of a mention: its title's, else what the corpus tells of the person (1: a woman, 2: a man), else its own."""
    return F.coalesce(p["voiced"], F.when(learned == 1, "f").when(learned == 2, "m"), p["gender"])


def genders(persons: DataFrame) -> DataFrame:
    """``canon`` (given and surname) and ``draw`` (1: a woman, 2: a man) where the corpus tells more of a person than an untitled mention does.

    ``persons`` holds the distinct written forms ``e``; each titled form is a vote, and an equal vote tells nothing."""
    forms = persons.select(_parts(F.col("e")).alias("p")).where("p.given <> ''").select("p.*")
    women, men = F.count(F.when(F.col("voiced") == "f", 1)), F.count(F.when(F.col("voiced") == "m", 1))
    vote = F.when(women > men, 1).when(men > women, 2).cast("long")
    # An untitled form of the list's own gender has no say of its own here.
    own = F.max(F.when(F.col("voiced").isNull(), F.col("gender")))
    pairs = forms.groupBy("given", "surname").agg(vote.alias("pair"), own.alias("own"))
    names = pairs.groupBy(F.col("given").alias("name")).agg(F.count(F.when(F.col("pair") == 1, 1)).alias("w"), F.count(F.when(F.col("pair") == 2, 1)).alias("m"))
    voted = names.select("name", F.when(F.col("w") > F.col("m"), 1).when(F.col("m") > F.col("w"), 2).cast("long").alias("named")).where("named is not null")
    met = pairs.join(voted, F.col("given") == F.col("name"), "left")
    told = F.coalesce("pair", F.when(F.col("own") == "u", F.col("named")))
    return met.where("own is not null").select(F.concat_ws("|", "given", "surname").alias("canon"), told.alias("draw"), "own").where("draw is not null and own <> if(draw = 1, 'f', 'm')").drop("own")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"[\p{IsCyrillic}]"), "cyrillic").when(name.rlike(r"[\p{IsGreek}]"), "greek").otherwise("latin")


def _sounds(script: Column, hexes: Column, places: range) -> Column:
    return F.coalesce(*[F.when(script == s, F.concat(*[_drawn(sounds, hexes, F.lit(k)) for k in places])) for s, sounds in SYLLABLES.items()])


def _numbered(kind: str | Column, draw: Column, otherwise: Column) -> Column:
    """What is written for a draw: below 0 the kind and its number, for entities that no form is left for."""
    return F.when(draw < 0, F.concat(F.lit("<"), F.lit(kind) if isinstance(kind, str) else kind, F.lit("-"), (-draw).cast("string"), F.lit(">"))).otherwise(otherwise)


def _surname(name: Column, key: str, draw: Column) -> Column:
    longer = lambda h: F.when(draw >= WIDER, _sounds(_script(name), h, range(5, 7))).otherwise("")
    return _numbered("surname", draw, _let(_hexes(key, F.lit("surname"), name, draw), lambda h: F.initcap(F.concat(_sounds(_script(name), h, range(1, 5)), longer(h)))))


#: What given names are drawn from; of either kind for a person of unknown gender.
_POOLS = GIVEN | {(s, "u"): GIVEN[(s, "f")] + GIVEN[(s, "m")] for s in SYLLABLES}


def _given(gender: Column, name: Column, key: str, draw: Column) -> Column:
    """A given name of the same gender and script, with a second part where a surname has more people than there are names."""
    script = _script(name)
    more = lambda h: F.when(draw >= WIDER, F.concat(F.lit("-"), F.initcap(_sounds(script, h, range(2, 6))))).otherwise("")
    return _numbered("given", draw, _let(_hexes(key, F.lit("given"), F.concat_ws("|", gender, name), draw), lambda h: F.concat(F.coalesce(*[F.when((script == s) & (gender == g), _drawn(names, h, F.lit(1))) for (s, g), names in _POOLS.items()]), more(h))))


def _named(p: Column, gender: Column) -> Column:
    """What stands for a given name in the collision check: names of other surnames don't collide with it."""
    return F.concat_ws("|", gender, p["given"], p["surname"])


def _person(text: Column, key: str, draw_of) -> Column:
    """Title kept; a surname's surrogate depends on the surname alone, a given name's on it, its gender and who shares its surname."""

    def renamed(p: Column) -> Column:
        first = _let(_settled(p, draw_of(F.lit("gender"), _pair(p))), lambda g: _let(draw_of(F.lit("given"), _named(p, g)), lambda d: _given(g, p["given"], key, d)))
        last = _let(draw_of(F.lit("surname"), p["surname"]), lambda d: _surname(p["surname"], key, d))
        return F.concat(p["title"], F.when(p["given"] != "", F.concat(first, F.lit(" "))).otherwise(""), last)

    return _let(_parts(text), renamed)


def units(kind: Column, entity: Column, learned: Column) -> Column:
    """Array of ``kind, canon``: what draws for itself in an entity; ``learned`` is what the corpus tells of a person's gender."""
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))

    def split(p: Column) -> Column:
        last = one(F.lit("surname"), p["surname"])
        return F.when(p["given"] == "", F.array(last)).otherwise(F.array(last, one(F.lit("given"), _named(p, _settled(p, learned)))))

    return F.when(kind == "person", _let(_parts(entity), split)).otherwise(F.array(one(kind, canonical(kind, entity))))


def unit_rows(entities: DataFrame, told: DataFrame) -> DataFrame:
    """The units of entities (``kind, e`` and further columns) in rows ``kind, canon``; ``told`` is what genders() gives."""
    rest = [c for c in entities.columns if c not in ("kind", "e")]
    persons = entities.where("kind = 'person'").withColumn("_pair", _let(_parts(F.col("e")), _pair))
    met = persons.join(told.select(F.col("canon").alias("_of"), F.col("draw").alias("_told")), F.col("_pair") == F.col("_of"), "left")
    others = entities.where("kind <> 'person'").withColumn("_told", F.lit(None).cast("long"))
    each = met.select(*rest, "kind", "e", "_told").union(others.select(*rest, "kind", "e", "_told"))
    return each.select(*rest, F.inline(units(F.col("kind"), F.col("e"), F.col("_told"))))


def _hexes(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """128 hex digits that depend on all four."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, draw.cast("string"), canon).cast("binary"), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner).cast("binary"), 512)


def surrogate(kind: Column, entity: Column, key: str, draw_of) -> Column:
    """``draw_of(kind, canon)`` is the number of the draw."""
    at = F.instr(entity, "@")
    domain = _hexes(key, F.lit("domain"), F.lower(F.substring(entity, at + 1, F.length(entity))), F.lit(0))
    country = F.length(F.regexp_extract(canonical(kind, entity), COUNTRY, 0)) - 1

    def drawn(h: Column, draw: Column) -> Column:
        longer = F.when((draw >= WIDER) & entity.startswith("+"), F.concat(*[_number(h, F.lit(k), 10).cast("string") for k in range(31, 37)])).otherwise("")
        return (
            F.when(kind == "email", F.concat(_like(F.substring(entity, F.lit(1), at - 1), h), F.when(draw >= WIDER, F.substring(h, 60, 6)).otherwise(""), F.lit("@d"), F.substring(domain, 1, 10), F.lit(".example.com")))
            .when(kind == "ip", F.concat_ws(".", *[(_number(h, F.lit(k), 254) + 1).cast("string") for k in (1, 3, 5, 7)]))
            .when(kind == "card", _card(entity, h))
            .when(kind == "iban", _iban(entity, h))
            .when(kind == "phone", F.concat(_let(country, lambda n: _like(entity, h, n)), longer))
            .otherwise(_like(entity, h))
        )

    def keyed(canon: Column) -> Column:
        return _let(draw_of(kind, canon), lambda d: _numbered(kind, d, _let(_hexes(key, kind, canon, d), lambda h: drawn(h, d))))

    return F.when(kind == "person", _person(entity, key, draw_of)).otherwise(_let(canonical(kind, entity), keyed))


def _written(kind: Column, canon: Column, key: str, draw: Column) -> Column:
    """A unit's surrogate in the form of ``canon``; a given name's beside its surname."""
    part = lambda k: F.get(F.split(canon, r"\|"), k)
    given = F.concat_ws("|", _given(part(0), part(1), key, draw), part(2))
    other = surrogate(kind, canon, key, lambda *_: draw)
    return F.when(kind == "surname", _surname(canon, key, draw)).when(kind == "given", given).otherwise(F.when(draw < 0, other).otherwise(canonical(kind, other)))


def colliding(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, draw``: entities whose first draw isn't theirs alone, with the draw that is.

    ``entities`` holds distinct ``kind, canon``. Of several with one surrogate the smallest keeps its draw."""
    now = durable(entities.withColumn("draw", F.lit(0).cast("long")))
    for attempt in range(MOST_DRAWS + 1):
        drawn = fixed(now, as_=_written(F.col("kind"), F.col("canon"), key, F.col("draw")))
        named = durable(drawn.select("kind", "canon", "draw", "as_"))
        shared = named.groupBy("kind", "as_").agg(F.min(F.struct("draw", "canon")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        losers = named.join(shared.drop("n"), ["kind", "as_"]).where(F.struct("draw", "canon") > F.col("keeps")).select("kind", "canon")
        taken = named.join(now.select("kind", F.col("canon").alias("as_")), ["kind", "as_"], "left_semi").select("kind", "canon")
        again = durable(losers.union(taken).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            break
        # The last round numbers what is left.
        fresh = F.col("draw") + 1 if attempt < MOST_DRAWS else -1 - F.monotonically_increasing_id()
        before, now = now, durable(now.join(again, ["kind", "canon"], "left").select("kind", "canon", F.when(F.col("more").isNotNull(), fresh).otherwise(F.col("draw")).alias("draw")))
        for done in (before, named, again):
            discard(done)
    return now.where("draw <> 0")


def _mentions(persons: Column) -> Column:
    """A pattern for later mentions of persons by surname, with or without their given name; empty for none. Names hold letters and hyphens alone."""
    forms = F.array_distinct(F.transform(persons, lambda e: _let(_parts(e), lambda p: F.when(p["given"] == "", p["surname"]).otherwise(F.concat(F.lit("(?:"), p["given"], F.lit(r"\x20)?"), p["surname"])))))
    return F.when(F.size(forms) > 0, F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))).otherwise("")


def _cut_by(piece: Column, pattern: Column) -> Column:
    """Array of what is between matches and the matches, in turn."""
    between, matches = F.split(piece, pattern, -1), F.regexp_extract_all(piece, pattern, F.lit(0))
    return F.when(F.size(matches) == 0, F.array(piece)).otherwise(F.slice(F.flatten(F.zip_with(between, F.concat(matches, F.array(F.lit(""))), lambda x, y: F.array(x, y))), 1, 2 * F.size(matches) + 1))


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with surrogates in their text, and ``n_<kind>`` for every kind of entity."""
    counts = [f"n_{k}" for k in KINDS]
    own = docs.columns
    # A text is matched once: matches are wrapped in a mark and the text is cut at the marks, so every second piece is a match.
    text = F.col(text_col)
    cut = F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    twice = F.concat(F.flatten(F.zip_with(F.split(text, ANY, -1), F.concat(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array(F.lit(""))), lambda x, y: F.array(x, y))))
    df = fixed(docs, _cut=F.when(F.contains(text, F.lit(MARK)), F.slice(twice, 1, F.size(twice) - 1)).otherwise(cut))
    every = lambda odd, cut="_cut": F.coalesce(F.filter(cut, lambda _, i: i % 2 == odd), F.array().cast("array<string>"))
    # The persons of a text are looked for in what is left of it.
    df = fixed(df, _again=_mentions(F.filter(every(1), lambda e: kind_of(e) == "person")))
    recut = F.transform(every(0), lambda p: _cut_by(p, F.col("_again")))
    rejoined = F.flatten(F.zip_with(recut, F.concat(every(1), F.array(F.lit(""))), lambda x, y: F.concat(x, F.array(y))))
    df = fixed(df, _whole=F.when(F.col("_again") == "", F.col("_cut")).otherwise(F.slice(rejoined, 1, F.size(rejoined) - 1))).drop("_again", "_cut")
    df = fixed(df, _m=every(1, "_whole"), _pieces=every(0, "_whole")).drop("_whole")
    found = durable(df.select(F.explode(F.array_distinct("_m")).alias("e")).distinct().withColumn("kind", kind_of(F.col("e"))))
    told = durable(genders(found.where("kind = 'person'")))
    drawn_again = colliding(unit_rows(found, told).distinct(), key)
    again = durable(drawn_again.select("kind", "canon", "draw").union(told.select(F.lit("gender"), "canon", "draw")))
    discard(drawn_again)
    discard(found)
    slot = lambda kind, canon: F.concat_ws("|", kind, canon)
    n_again = again.count()
    if n_again <= MAPPED:
        fixed_draws = {f"{r['kind']}|{r['canon']}": r["draw"] for r in again.collect()}
        df = fixed(df, _draws=F.when(F.size("_m") > 0, F.from_json(F.lit(json.dumps(fixed_draws)), "map<string,bigint>")))
    else:
        # Beyond the map: the draws each text needs are joined to it by its digest.
        hit = df.where(F.size("_m") > 0).select(F.sha2(F.col(text_col).cast("binary"), 256).alias("_sha"), F.explode(F.array_distinct("_m")).alias("e")).withColumn("kind", kind_of(F.col("e")))
        persons = hit.where("kind = 'person'").select("_sha", F.lit("gender").alias("kind"), _let(_parts(F.col("e")), _pair).alias("canon"))
        hit = unit_rows(hit, told).select("_sha", "kind", "canon").union(persons).join(again, ["kind", "canon"])
        maps = durable(hit.select("_sha", F.struct(slot(F.col("kind"), F.col("canon")).alias("k"), "draw").alias("d")).groupBy("_sha").agg(F.map_from_entries(F.collect_set("d")).alias("_draws")))
        df = df.withColumn("_own", F.sha2(F.col(text_col).cast("binary"), 256)).join(maps, F.col("_own") == F.col("_sha"), "left").drop("_own", "_sha")

    def tagged(e: Column) -> Column:
        kind = kind_of(e)
        return F.struct(e.alias("e"), kind.alias("k"))

    df = fixed(df, _tags=F.transform("_m", tagged))

    def drawn(t: Column) -> Column:
        return surrogate(t["k"], t["e"], key, lambda kind, canon: F.coalesce(F.try_element_at(F.col("_draws"), slot(kind, canon)), F.lit(0).cast("long")))

    df = fixed(df, _new=F.transform("_tags", drawn))
    woven = F.array_join(F.flatten(F.zip_with("_pieces", F.concat("_new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    text = F.when(F.size("_m") > 0, woven).otherwise(F.col(text_col))
    n_of = [F.size(F.filter("_tags", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select(*[(text if c == text_col else F.col(c)).alias(c) for c in own if c not in counts], *n_of)


def _is(kind: str):
    return lambda t: t["k"] == kind
