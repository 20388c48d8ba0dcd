"""Surrogates for personal data and credentials, with DataFrame functions only.

Entities are found by patterns.  Each distinct one gets a replacement derived from
a secret key and the entity: letters become letters, digits digits, separators
stay, card numbers keep a valid check digit, addresses stay addresses, a given name
becomes one of the same gender and script.  Equal entities get equal replacements
in all documents; names are replaced word by word, so "Maria Lopez" and "Ms Lopez"
go on sharing a surname, and mail addresses of one domain go on sharing one.
Replacements that two entities would share, or that are entities themselves, are
drawn anew until none is left.  Where a short form is used up (ten passwords of one
digit), later draws are longer than the entity, by a character more each time: so
there is always another one, and the rounds end.  What has neither a letter nor a
digit (``password: ********``, an empty key block) tells nothing and is left as it
is, though it counts as an entity.

A null text stays null and has no entities; an empty one stays empty.  Repeated
rows stay repeated.  All other columns are passed on, whatever their names, but
for ``text``, which changes, and ``n_entities``, which is added (or overwritten).
An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.llm.common import content_key, settle

# Titles, given names by script and gender, and syllables for invented names.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Signor|Signora|господин|госпожа|κύριος|κυρία"
FEMALE = {
    "latin": "Maria Anna Emma Olivia Sophia Elena Laura Julia Sarah Alice Claire Camille Ines Lucia Carmen Greta Ingrid Petra Nina Eva",
    "cyrillic": "Мария Анна Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия",
    "greek": "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ιωάννα Ειρήνη",
}
MALE = {
    "latin": "John James Robert Michael David Thomas Peter Paul Daniel Martin Lukas Felix Hans Karl Pierre Louis Antoine Carlos Miguel Diego",
    "cyrillic": "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел",
    "greek": "Γεώργιος Ιωάννης Δημήτριος Νικόλαος Κωνσταντίνος Παναγιώτης Βασίλειος Χρήστος Αθανάσιος Μιχαήλ",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke ko la le lo ma mi mo na ne no pa ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ва ве га ка ко ла ле ло ма ми мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε σο τα τε το".split(),
}

SHORT_DRAWS, LONG_DRAWS = 3, 30  # draws of the entity's own length: of secrets and mail addresses, of all else

_GIVEN = "|".join(" ".join([*FEMALE.values(), *MALE.values()]).split())
_SECRET_WORDS = [w for word in ("pass", "token", "secret", "key") for w in (word, word.capitalize(), word.upper())]
_BEFORE_SECRET = "|".join(
    form for word in ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey")
    for form in (word, word.capitalize(), word.upper())
)
_SECRET_START = rf"""\b(?:{_BEFORE_SECRET})["']? ?[=:] ?"""
_HEX = "[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# In the order in which they are tried at a place of the text.  Runs are possessive
# or bounded, and begin where no run can be under way, so long texts take linear time.
PATTERNS = {
    "key_block": rf"(?<=-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----)(?:\s*+Proc-Type:[^\n]*+\s++DEK-Info:[^\n]*+)?[^-]++",
    "secret": rf"""(?<={_SECRET_START}")[^"\r\n]++(?=")|(?<={_SECRET_START}')[^'\r\n]++(?=')|(?<={_SECRET_START}["']?)[^\s"'<>]{{5,}}[^\s"'<>.,;:!?)\]}}]""",
    "bearer": r"(?<=\b[Bb]earer )(?=[A-Za-z._~+/=-]*\d)[A-Za-z0-9._~+/=-]{8,}+",
    "dotted_token": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){1,3}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,5}}(?:{_OCTET}\.){{3}}{_OCTET}|{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\d)",
    "person": rf"(?=\p{{Lu}})(?:(?<=\b(?:{TITLES})\.? )|(?<!\p{{L}})(?=(?:{_GIVEN}) {_NAME})){_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def has_entity(text: Column) -> Column:
    """Whether ``ANY`` is found.  Quick tests go first: a mail address has an @, most others a digit."""
    quick = text.rlike("[0-9@]") | text.contains("AKIA") | text.rlike(":[A-Fa-f]{0,4}:") | text.contains("eyJ")
    for word in _SECRET_WORDS:  # part of what stands before any secret
        quick = quick | text.contains(word)
    return (quick | text.rlike(PATTERNS["person"])) & text.rlike(ANY)


_SHAPES = {  # of an entity by itself, without what stood before it
    "email": r"^[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}$",
    "access_key": r"^AKIA[0-9A-Z]{16}$",
    "mac": r"^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$",
    "ip": rf"^(?:{_OCTET}\.){{3}}{_OCTET}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "card": r"^(?:\d{4}[ -]?){4}$|^3[47]\d{2}[ -]?\d{6}[ -]?\d{5}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$",
    "phone": r"^[+(\d][\d ().-]+$",
    "person": rf"^{_NAME}(?: {_NAME})?$",
}


def kind_of(entity: Column) -> Column:
    """The type of an entity, from its form."""
    kind = F.lit("secret")
    for name, shape in reversed(_SHAPES.items()):
        kind = F.when(entity.rlike(shape), name).otherwise(kind)
    return kind


def parts_of(entity: Column) -> Column:
    """The words of a name, else the entity: what replacements are given to."""
    return F.when(kind_of(entity) == "person", F.split(entity, " ")).otherwise(F.array(entity))


def _keyed(key: str, seed: Column) -> Column:
    """256 hexadecimal digits that nobody can tell from random ones without the key."""
    keyed = F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key + ":"), seed), 256)), 512)
    return F.concat(keyed, F.sha2(F.concat(keyed, F.lit(key)), 512))


class _Draw:
    """Numbers at any place 0, 1, 2, … of a column of such digits (a column, so they are made once an entity)."""

    def __init__(self, digits: str) -> None:
        self.hex = F.col(digits)

    def number(self, place: Column | int, below: int) -> Column:
        place = F.lit(place) if isinstance(place, int) else place
        four = F.substring(self.hex, F.pmod(place, F.lit(62)) * F.lit(4) + F.lit(1), F.lit(4))
        mixed = F.conv(four, 16, 10).cast("int") + F.floor(place / F.lit(62)).cast("int") * F.lit(7)
        return F.pmod(mixed, F.lit(below))

    def pick(self, place: Column | int, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self.number(place, len(values)) + F.lit(1))

    def letters(self, place: Column, alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), self.number(place, len(alphabet)) + F.lit(1), F.lit(1))


def _same_form(text: Column, draw: _Draw, hexadecimal: Column | None = None) -> Column:
    """Each character by one of its class; other letters become small ones, all else stays."""
    lower = "abcdefghijklmnopqrstuvwxyz"

    def one(char: Column, i: Column) -> Column:
        small, capital = draw.letters(i, lower), draw.letters(i, lower.upper())
        if hexadecimal is not None:
            small = F.when(hexadecimal, draw.letters(i, "abcdef")).otherwise(small)
            capital = F.when(hexadecimal, draw.letters(i, "ABCDEF")).otherwise(capital)
        return (
            F.when(char.rlike("^[0-9]$"), draw.letters(i, "0123456789"))
            .when(char.rlike("^[a-z]$"), small)
            .when(char.rlike("^[A-Z]$"), capital)
            .when(char.rlike(r"^[\p{L}\p{N}]$"), small)
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _longer(draw: _Draw, attempt: Column, draws: int) -> Column:
    """Nothing for the first draws, then one digit more at each."""
    digits = F.transform(F.sequence(F.lit(1), F.greatest(attempt - F.lit(draws), F.lit(1))), lambda i: draw.letters(i + F.lit(40), "0123456789"))
    return F.when(attempt > draws, F.array_join(digits, "")).otherwise("")


def _with_check_digit(card: Column) -> Column:
    """The last digit by the rule that card numbers follow."""
    digits = F.split(F.regexp_replace(card, "[^0-9]", ""), "")
    n = F.size(digits)

    def weight(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.lit(2)
        doubled = twice - F.when(twice > 9, 9).otherwise(0)
        value = F.when((n - i) % 2 == 0, doubled).otherwise(d.cast("int"))
        return F.when(i == n - 1, F.lit(0)).otherwise(value)

    total = F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _invented_name(draw: _Draw, attempt: Column, script: str, ending: str = "") -> Column:
    """Three syllables or, after collisions, more, so there is always another name."""
    syllables = F.transform(F.sequence(F.lit(1), attempt + F.lit(3)), lambda i: draw.pick(i, SYLLABLES[script]))
    return F.initcap(F.concat(F.array_join(syllables, ""), F.lit(ending)))


def _name(part: Column, draw: _Draw, attempt: Column) -> Column:
    def of_script(script: str) -> Column:
        female, male = FEMALE[script].split(), MALE[script].split()
        endings = {"latin": ("na", "n"), "cyrillic": ("на", "н"), "greek": ("να", "νος")}[script]
        first = attempt == 0
        return (
            F.when(part.isin(female) & first, draw.pick(0, female))
            .when(part.isin(male) & first, draw.pick(0, male))
            .when(part.isin(female), _invented_name(draw, attempt, script, endings[0]))
            .when(part.isin(male), _invented_name(draw, attempt, script, endings[1]))
            .otherwise(_invented_name(draw, attempt, script))
        )

    return (
        F.when(part.rlike(r"\p{IsCyrillic}"), of_script("cyrillic"))
        .when(part.rlike(r"\p{IsGreek}"), of_script("greek"))
        .otherwise(of_script("latin"))
    )


def _surrogate(kind: Column, part: Column, attempt: Column) -> Column:
    """The replacement of one entity at one attempt, from the columns that ``with_surrogates`` adds."""
    draw, of_domain = _Draw("_digits"), _Draw("_of_domain")
    at = F.instr(part, "@")
    domain = F.substring(part, at + F.lit(1), F.length(part))
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    email = F.concat(
        _longer(draw, attempt, SHORT_DRAWS),
        _same_form(F.substring(part, F.lit(1), at - F.lit(1)), draw),
        F.lit("@"),
        _same_form(labels, of_domain),
        F.substring(domain, F.length(labels) + F.lit(1), F.length(domain)),
    )
    octets = [(draw.number(i, 223 if i == 0 else 254) + F.lit(1)).cast("string") for i in range(4)]
    prefix = F.regexp_extract(part, r"^(\+\d{1,3})(?=[ .(-])", 1)
    rest = F.substring(part, F.length(prefix) + F.lit(1), F.length(part))
    leading = F.substring(part, F.lit(1), F.lit(1))
    hexadecimal = part.rlike("^[0-9a-fA-F:]+$")
    options: dict[str, Callable[[], Column]] = {
        "email": lambda: email,
        "access_key": lambda: F.concat(F.lit("AKIA"), _same_form(F.substring(part, F.lit(5), F.length(part)), draw)),
        "ip": lambda: F.concat_ws(".", *octets),
        "card": lambda: _with_check_digit(
            F.concat(leading, _same_form(F.substring(part, F.lit(2), F.length(part)), draw))
        ),
        "iban": lambda: F.concat(
            F.substring(part, F.lit(1), F.lit(2)), _same_form(F.substring(part, F.lit(3), F.length(part)), draw)
        ),
        "phone": lambda: F.concat(prefix, _same_form(rest, draw)),
        "person": lambda: _name(part, draw, attempt),
    }
    out = F.concat(_same_form(part, draw, hexadecimal), _longer(draw, attempt, SHORT_DRAWS))
    for name, made in options.items():
        more = F.lit("") if name in ("email", "person") else _longer(draw, attempt, LONG_DRAWS)
        out = F.when(kind == name, F.concat(made(), more)).otherwise(out)
    return out


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, part, attempt, surrogate`` from the first three."""
    kind, part, attempt = F.col("kind"), F.col("part"), F.col("attempt")
    domain = F.substring_index(part, "@", -1)
    drawn = entities.select(
        "kind", "part", "attempt",
        _keyed(key, F.concat_ws("\0", kind, part, attempt.cast("string"))).alias("_digits"),
        _keyed(key, F.concat_ws("\0", F.lit("domain"), domain)).alias("_of_domain"),
    )
    return drawn.withColumn("surrogate", _surrogate(kind, part, attempt)).drop("_digits", "_of_domain")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, part, surrogate`` for distinct ``kind, part``: no two alike, none that is an entity itself.

    Parts without letters and digits stand for themselves.
    """
    every, telling = entities.select("kind", "part").distinct(), F.col("part").rlike(r"[\p{L}\p{N}]")
    drawn = settle(with_surrogates(every.filter(telling).withColumn("attempt", F.lit(0)), key))
    bare = every.filter(~telling).withColumn("surrogate", F.col("part"))
    while True:
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "part")
        real = drawn.select("kind", F.col("part").alias("surrogate"), F.lit(True).alias("_real"))
        checked = drawn.withColumn("_nth", F.row_number().over(order)).join(real, ["kind", "surrogate"], "left")
        clash = settle(checked.filter((F.col("_nth") > 1) | F.col("_real")).select("kind", "part"))
        if clash.isEmpty():
            return drawn.select("kind", "part", "surrogate").unionByName(bare)
        again = drawn.join(clash, ["kind", "part"]).select("kind", "part", (F.col("attempt") + 1).alias("attempt"))
        kept = drawn.join(clash, ["kind", "part"], "left_anti")
        drawn = settle(kept.unionByName(with_surrogates(again, key)))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replacements in ``text`` and ``n_entities``.

    Documents without an entity never leave their task.  The others meet a map of
    their own replacements, made once per distinct text.
    """
    others = [c for c in docs.columns if c.lower() not in ("text", "n_entities")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").alias("_text"))
    found = F.coalesce(has_entity(F.col("_text")), F.lit(False))
    names = [F.col("row").getField(c).alias(c) for c in others]
    free = rows.filter(~found).select(*names, F.col("_text").alias("text"), F.lit(0).alias("n_entities"))
    held = rows.filter(found).withColumn("_key", content_key("_text"))

    entities = F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))
    per_text = held.select("_key", F.array_distinct(entities).alias("_all")).groupBy("_key").agg(F.first("_all").alias("_all"))
    entity = per_text.select("_key", F.explode("_all").alias("_entity"))
    part = settle(
        entity.select("_key", kind_of(F.col("_entity")).alias("kind"), F.explode(parts_of(F.col("_entity"))).alias("part")).distinct()
    )
    table = surrogate_table(part, key)
    maps = settle(
        part.join(table, ["kind", "part"])
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "part"), "surrogate"))).alias("_map"))
    )

    def replaced(one: Column) -> Column:
        words = F.transform(parts_of(one), lambda p: F.element_at(F.col("_map"), F.concat_ws("\0", kind_of(one), p)))
        return F.array_join(words, " ")

    changed = F.transform(F.col("_found"), replaced)
    text = F.array_join(
        F.zip_with(F.split("_text", ANY, -1), changed, lambda s, e: F.concat(s, F.coalesce(e, F.lit("")))), ""
    )
    done = held.join(maps, "_key").withColumn("_found", entities)
    return free.unionByName(done.select(*names, text.alias("text"), F.size("_found").alias("n_entities")))
