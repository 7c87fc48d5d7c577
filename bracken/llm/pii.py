"""Surrogates for personal data and secrets [native].

One expression finds the entities: e-mail addresses, IPv4 addresses, card numbers, telephone numbers, US social
security numbers, access keys, values of passwords and other secrets, hexadecimal tokens, names that follow a
title, and full names that start with a common given name. Other names are not found. Every entity has a type and a
canonical form (lower case, digits only, ...), so that mentions of one entity in any format share it.
A keyed digest of type, canonical form and attempt gives the surrogate, character by character: a digit
for a digit, a letter of the same case for a letter, octets of an address within range, a card number with
a valid check digit where the original has one, a name of the title's gender in the name's script. Letters of
other alphabets are drawn too, and a secret of marks alone gets drawn characters. Every mention keeps its own
format and punctuation. Equal entities have equal surrogates everywhere.

Collision checks keep distinct entities distinct. Over the table of all distinct entities a surrogate that
another entity has too, or that is itself an entity of the corpus, is drawn again with the next attempt,
until none is left. Every ``STEP`` attempts a surrogate gets one more character (digit, octet, syllable), so no
space of surrogates stays full and the rounds end. Only entities past their first attempt are exceptions that texts must look up; they
are joined by document. Texts are cut at the entities and put together again with surrogates in place, so
nothing is replaced twice, and all other text stays as it is.

A person is a given name and a family name, wherever they stand. The family name has its surrogate, and the given
name one that no other person of that family name has. The gender is that of all titles a person has in the corpus;
where these differ or tell none, the given name is one of either; a common given name without a title tells its own. In a text with such a name, later
and earlier repeats without a title, of the full or the family name, are replaced too, as written, capitalised or in
upper case; a given name that stands alone is not.

The digests need a key. It is that of the call, else that of the session (``spark.bracken.surrogate.key``), else one
drawn at random for the application, whose surrogates no other application repeats.

Defined results: a null text stays null, with no entity; repeated rows are rewritten alike; rows with
equal ids are told apart by their texts; an empty table stays empty; all other columns are untouched.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from . import common
from .common import small

KEY_SETTING = "spark.bracken.surrogate.key"
_drawn: dict[str, str] = {}
#: Attempts after which a surrogate gets one more character.
STEP = 4

TITLES = {
    "female": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "Señorita", "госпожа", "κυρία"),
    "male": ("Mr", "Monsieur", "Herr", "Señor", "Sr", "господин", "κύριος"),
    "any": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "female"): "Anna Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nadia Paula Rosa Sofia".split(),
    ("latin", "male"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Mark Oscar Paul Simon".split(),
    ("latin", "any"): "Alex Chris Dana Eden Jules Kim Lee Loren Max Noa Quinn Robin Sam Sasha Toni Val".split(),
    ("cyrillic", "female"): "Анна Вера Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Юрий".split(),
    ("greek", "female"): "Άννα Βέρα Δάφνη Ελένη Ζωή Ηρώ Ιωάννα Κλειώ Λήδα Μαρία Νίκη Ξένια Όλγα Ρέα Σοφία Χλόη".split(),
    ("greek", "male"): "Άρης Βίκτωρ Γιώργος Δήμος Ευγένιος Ζήσης Ηλίας Θάνος Ιάσων Κώστας Λουκάς Μάνος Νίκος Πέτρος Σταύρος Φώτης".split(),
}
#: Syllables of family names by script; three of them make a name.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но ра ре ро са се со та то".split(),
    "greek": "βα βε βο γα γο δα δε δο ζα ζο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το φα".split(),
}
# Common given names that are no words of their own, for names without a title.
KNOWN = {
    "female": "Alice Amanda Amelie Andrea Angela Anita Anna Anne Barbara Beatriz Camille Carla Carmen Carolina Caroline Catherine Charlotte Chiara Christina Claudia Clara Diana Elena Elisabeth Elizabeth Emily Emma Eva Fatima Francesca Gabriela Giulia Hannah Heidi Helen Helena Ingrid Irene Isabel Isabella Jane Jennifer Jessica Johanna Julia Juliette Karen Katharina Laura Lena Linda Lucia Manon Margaret Maria Marie Marta Martina Mary Michelle Monika Nadia Natalia Nicole Olga Olivia Patricia Paula Rachel Rebecca Sandra Sara Sarah Sofia Sophie Stefanie Susan Susanne Svetlana Teresa Ursula Valentina Victoria Yasmin".split(),
    "male": "Adam Ahmed Alan Albert Alberto Alejandro Alexander Andreas Andrew Antoine Antonio Benjamin Bernd Brian Bruno Carlos Charles Christian Christopher Daniel David Diego Dieter Dmitri Edward Enrique Eric Ethan Felix Fernando Francisco Friedrich George Giovanni Gustavo Hans Heinrich Henry Hugo Ivan Jacques James Javier Jean John Johann Jonas Jonathan Jorge Joseph Juan Karl Kevin Klaus Lars Luca Luis Lukas Manuel Marco Mario Martin Matthew Matthias Michael Miguel Mohammed Nicolas Oliver Oscar Otto Pablo Patrick Paul Paulo Pedro Peter Philippe Pierre Rafael Richard Robert Roberto Samuel Sebastian Sergei Sergio Simon Stefan Stephen Steven Thomas Tobias Vladimir Werner William Wolfgang".split(),
}
_ALL_TITLES = "|".join(t for kind in TITLES.values() for t in kind)
# Each pattern starts with what is cheapest to refuse; runs that cannot match otherwise are not given back.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
CARD = r"(?=\d)(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"
PHONE = r"(?=[+(\d])(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))"
ACCESS_KEY = r"(?=AKIA)(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SSN = r"(?=\d)(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]|\.\d)"
_SECRETS = ("password", "passwd", "pwd", "secret", "api_key", "apikey", "access_token")
PASSWORD = r"(?<==)(?i:" + "|".join(f"(?<={w}=)" for w in _SECRETS) + r")[^\s,;\"']+"
_IS_SECRET = f"(?i)(?:{'|'.join(_SECRETS)})=$"
TOKEN = r"(?<![A-Za-z0-9])(?=[0-9a-f]{32})(?=[a-f]*\d)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"
#: A word of a name, without the 's of a possessive.
_NAME_WORD = r"\p{Lu}(?:\p{L}|['-](?=\p{L})(?!s(?!\p{L})))+"
NAME = rf"(?<= )(?=\p{{Lu}})(?<=(?<![\p{{L}}])(?:{_ALL_TITLES})\.?[ ]){_NAME_WORD}(?: {_NAME_WORD})?"
_KNOWN_WORD = rf"(?=\p{{Lu}}\p{{Ll}}+ \p{{Lu}})(?<![\p{{L}}\p{{N}}'-])(?:{'|'.join(KNOWN['female'] + KNOWN['male'])}) "
NAME = rf"{NAME}|{_KNOWN_WORD}{_NAME_WORD}"
ENTITY = "|".join((EMAIL, IP, CARD, PHONE, SSN, ACCESS_KEY, PASSWORD, TOKEN, NAME))
#: What any text with a name has.
TITLED = rf"(?=[{''.join(sorted({t[0] for t in _ALL_TITLES.split('|')}))}])(?:{_ALL_TITLES})\.? \p{{Lu}}|{_KNOWN_WORD}\p{{Lu}}"
#: What any text with an entity has, by way of first characters.
HINT = rf"[@0-9=]|AKIA|{TITLED}"


def kind(mention: Column, before: Column) -> Column:
    """The type of a mention, given the text before it."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(mention.rlike(r"^[^@]+@[^@]+$") & mention.rlike(f"^(?:{EMAIL})$") & ~before.rlike(_IS_SECRET), "email")
        .when(before.rlike(_IS_SECRET), "secret")
        .when(mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^[+(\d][\d ().-]*$") & ~mention.rlike("^[0-9]{32,}$") & (F.length(digits) >= 7), "phone")
        .when(mention.rlike(r"^\p{Lu}[\p{L}'-]+( \p{Lu}[\p{L}'-]+)?$") & (before.rlike(rf"(?:{_ALL_TITLES})\.? $") | ~mention.rlike(f"^{ACCESS_KEY}$")), "name")
        .otherwise("secret")
    )


def canonical(kind_: Column, mention: Column) -> Column:
    """What mentions of one entity share. Of a name it is the family name, its last word."""
    return (
        F.when(kind_ == "email", F.lower(mention))
        .when(kind_.isin("card", "phone", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when(kind_ == "name", F.lower(F.element_at(F.split(mention, " "), -1)))
        .otherwise(mention)
    )


def gender(mention: Column, before: Column) -> Column:
    """The gender that the title before a name tells: female, male or any; without a title what a common given name
    tells, else none."""
    title = F.regexp_extract(before, rf"({_ALL_TITLES})\.? $", 1)
    first = F.substring_index(mention, " ", 1)
    known = F.when(first.isin(*KNOWN["female"]), "female").when(first.isin(*KNOWN["male"]), "male").otherwise("none")
    return F.when(title == "", known).when(title.isin(*TITLES["female"]), "female").when(title.isin(*TITLES["male"]), "male").otherwise("any")


def secret_key(key: str | None) -> str:
    """The key of a call, of the session, or one drawn for the application."""
    if key is not None:
        return key
    spark = SparkSession.active()
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def with_key(df: DataFrame, key: str | None) -> DataFrame:
    """``df`` with the key as the column _bk_key of a one-row table: plans, and all that shows them, name the column only."""
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(secret_key(key),)], "_bk_key string")))


def _digest(parts: list[Column], key: str | Column | None) -> Column:
    """Of a key as a string the plan shows it; a column of ``with_key`` keeps it out."""
    return F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(secret_key(key)), *parts), 512)


def _draw(digest: Column, i: Column, n: int | Column) -> Column:
    """The i-th number below n of a digest."""
    at = (F.pmod(i, F.lit(60)) * 2 + 1).cast("int")
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int") + F.floor(i / 60).cast("int") * 7, n)


#: Letters that stand for those of an alphabet, lower case.
LETTERS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_MORE, _HEX, _DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "0123456789"


def _one_of(alphabet: str, digest: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), _draw(digest, i, len(alphabet)).cast("int") + 1, F.lit(1))


def _letters(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each character replaced by one of its kind; hexadecimal letters stay hexadecimal, marks stay unless there is nothing else."""
    marks = ~text.rlike(r"[\p{L}\p{N}]")

    def one(c: Column, i: Column) -> Column:
        below = F.when(hexadecimal, 6).otherwise(26)
        return (
            F.when(c.rlike("^[0-9]$"), _draw(digest, i, 10).cast("string"))
            .when(c.rlike("^[a-z]$"), F.chr(_draw(digest, i, below) + 97))
            .when(c.rlike("^[A-Z]$"), F.chr(_draw(digest, i, below) + 65))
            .when(c.rlike(r"^[\x00-\x7F]$"), F.when(marks, _one_of(_MORE, digest, i)).otherwise(c))
            .otherwise(other(c, i))
        )

    def other(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^\p{N}$"), _one_of(_DIGITS, digest, i))
        for name, letters in LETTERS.items():
            out = out.when(c.rlike(rf"^(?=\p{{Is{name}}})\p{{Lu}}$"), _one_of(letters.upper(), digest, i)).when(c.rlike(rf"^(?=\p{{Is{name}}})\p{{L}}$"), _one_of(letters, digest, i))
        out = out.when(c.rlike(r"^\p{Lu}$"), _one_of(_MORE[:26].upper(), digest, i)).when(c.rlike(r"^\p{L}$"), _one_of(_MORE[:26], digest, i))
        return out.when(marks, _one_of(_MORE, digest, i)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _more(digest: Column, extra: Column, make, sep: str = "") -> Column:
    """``extra`` further drawn pieces, joined; empty where it is 0."""
    return F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: make(digest, i)), sep)).otherwise("")


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits, every second from the right doubled."""
    back = F.split(F.reverse(digits), "")

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(back, one), F.lit(0), lambda a, x: a + x)


def script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def surrogates(entries: Column, key: str | Column | None = None) -> Column:
    """The canonical surrogates of an array of entities (kind, canon, attempt): lower case for names and addresses,
    digits alone for numbers. Each step is a list of its own, so that digests and digits are made once."""

    def keyed(m: Column) -> Column:
        return F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"), _digest([m["kind"], m["canon"], m["attempt"].cast("string")], key).alias("d"), F.floor(m["attempt"] / STEP).cast("int").alias("extra"), F.when(m["kind"] == "email", _digest([F.lit("domain"), F.substring_index(m["canon"], "@", -1)], key)).alias("of_domain"))

    def numbered(m: Column) -> Column:
        # a social security number has no zeros in front of its parts, and its area is below 666
        first = F.when(m["kind"] == "card", F.left(m["canon"], F.lit(1))).otherwise((_draw(m["d"], F.lit(0), F.when(m["kind"] == "ssn", 5).otherwise(9)) + 1).cast("string"))
        rest = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(m["canon"]) - 1 + m["extra"], F.lit(1))), lambda i: F.when((m["kind"] == "ssn") & i.isin(3, 5), _draw(m["d"], i, 9) + 1).otherwise(_draw(m["d"], i, 10)).cast("string")), "")
        digits = F.when(m["kind"].isin("card", "phone", "ssn"), F.left(F.concat(first, rest), F.length(m["canon"]) + m["extra"]))
        return F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"), m["d"].alias("d"), m["extra"].alias("extra"), m["of_domain"].alias("of_domain"), digits.alias("digits"))

    def made(m: Column) -> Column:
        canon, d, digits, extra = m["canon"], m["d"], m["digits"], m["extra"]
        wide = F.sha2(d, 512)
        body = F.left(digits, F.length(digits) - 1)
        check = F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        card = F.when(_luhn(canon) % 10 == 0, check).otherwise(digits)
        country = F.when(F.length(canon) > 10, F.left(canon, F.length(canon) - 10)).otherwise("")
        phone = F.concat(country, F.substring(digits, F.length(country) + 1, F.length(digits)))
        octets = F.concat_ws(".", *[(_draw(d, F.lit(i), 253) + 1).cast("string") for i in range(4)], F.when(extra > 0, _more(wide, extra, lambda w, i: (_draw(w, i, 253) + 1).cast("string"), ".")))
        domain = F.substring_index(canon, "@", -1)
        top = F.substring_index(domain, ".", -1)
        host = F.left(domain, F.length(domain) - F.length(top))
        email = F.concat(_more(wide, extra, lambda w, i: _one_of(_MORE, w, i)), _letters(F.substring_index(canon, "@", 1), d, F.lit(False)), F.lit("@"), _letters(host, m["of_domain"], F.lit(False)), top)
        access = F.concat(F.lit("AKIA"), _letters(F.substring(canon, 5, 60), d, F.lit(False)))
        hexadecimal = canon.rlike("^[0-9a-f]+$") & (F.length(canon) >= 32)
        secret = F.when(canon.rlike("^AKIA[A-Z0-9]{16}$"), access).otherwise(_letters(canon, d, canon.rlike("^[0-9a-f]+$")))
        secret = F.concat(secret, _more(wide, extra, lambda w, i: F.when(hexadecimal, _one_of(_HEX, w, i)).when(canon.rlike("^[0-9]+$"), _one_of(_DIGITS, w, i)).otherwise(_one_of(_MORE, w, i))))
        return F.when(m["kind"] == "email", email).when(m["kind"] == "ip", octets).when(m["kind"] == "card", card).when(m["kind"] == "phone", phone).when(m["kind"] == "ssn", digits).when(m["kind"] == "name", _family(canon, d, extra)).otherwise(secret)

    return F.transform(F.transform(F.transform(entries, keyed), numbered), made)


def _words(words: list[str]) -> Column:
    """A constant array from one literal; the planner folds it."""
    return F.split(F.lit(" ".join(words)), " ")


def _syllable(s: str, d: Column, i: Column) -> Column:
    return F.element_at(_words(SYLLABLES[s]), (_draw(d, i, len(SYLLABLES[s])) + 1).cast("int"))


def _family(canon: Column, d: Column, extra: Column) -> Column:
    """A family name of four syllables and ``extra`` more in the script of the original."""
    made = {s: F.concat(*[_syllable(s, d, F.lit(i * 2)) for i in range(4)], _more(F.sha2(d, 512), extra, lambda w, i, s=s: _syllable(s, w, i))) for s in SYLLABLES}
    return F.when(script(canon) == "cyrillic", made["cyrillic"]).when(script(canon) == "greek", made["greek"]).otherwise(made["latin"])


def surrogate(kind_: Column, canon: Column, attempt: Column, key: str | Column | None = None) -> Column:
    return F.get(surrogates(F.array(F.struct(kind_.alias("kind"), canon.alias("canon"), attempt.alias("attempt"))), key), F.lit(0))


def given(person: Column, gender_: Column, attempt: Column, key: str | Column | None = None) -> Column:
    """The surrogate, lower case, of the given name of a person (full name, lower case); from the third attempt on
    with syllables added."""
    d = _digest([F.lit("given"), person, gender_, attempt.cast("string")], key)
    of, out = script(F.substring_index(person, " ", 1)), F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        own = F.element_at(_words([n.lower() for n in names]), (_draw(d, F.lit(0), len(names)) + 1).cast("int"))
        matches = (of == s) & ((F.when(gender_.isin("female", "male"), gender_).otherwise("any" if s == "latin" else "male")) == g)
        out = F.when(matches, F.concat(own, _more(F.sha2(d, 512), attempt - 2, lambda w, i, s=s: _syllable(s, w, i)))).otherwise(out)
    return out


def _cased(like: Column, name: Column) -> Column:
    """``name`` in upper case where ``like`` is, else capitalised."""
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(name)).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))


def rendered(kind_: Column, mention: Column, made: Column, given_: Column) -> Column:
    """The canonical surrogate, and that of the given name, in the mention's own format."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
    numbers = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(made, nth(i), F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substring(made, nth(F.length(mention)) + 1, F.length(made)))
    words = F.split(mention, " ")
    first = F.element_at(words, 1)
    name = F.concat(F.when(F.size(words) > 1, F.concat(_cased(first, given_), F.lit(" "))).otherwise(""), _cased(F.element_at(words, -1), made))
    more = F.length(made) - F.length(mention)
    of = lambda i: F.substring(made, i + more + 1, F.lit(1))
    email = F.concat(F.left(made, more), F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(of(i))).otherwise(of(i))), ""))
    return F.when(kind_.isin("card", "phone", "ssn"), numbers).when(kind_ == "name", name).when(kind_ == "email", email).otherwise(made)


def _repeats(text: Column) -> Column:
    """Of a text with names the pattern of all its entities and of these names anywhere; else null."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))
    forms = F.flatten(F.transform(names, lambda m: F.flatten(F.transform(F.array(m, F.element_at(F.split(m, " "), -1)), lambda n: F.array(n, F.upper(n), F.initcap(F.lower(n)))))))
    pattern = F.concat(F.lit(ENTITY + r"|(?=\p{Lu})(?<![\p{L}\p{N}-]|\p{L}')(?:"), F.array_join(F.array_distinct(forms), "|"), F.lit(r")(?![\p{L}\p{N}]|-\p{L})"))
    return F.when(text.rlike(TITLED) & text.rlike(NAME), pattern)


def _cut(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _bk_pieces and _bk_mentions (kind, mention, before, canon, person, gender) of the texts that have an entity;
    person is the full name of a mention that has one."""
    some = F.when(text.rlike(HINT), text)
    out = docs.withColumn("_bk_repeats", _repeats(text))
    repeats = F.col("_bk_repeats")
    out = out.withColumn("_bk_found", F.when(repeats.isNotNull(), F.regexp_extract_all(text, repeats, F.lit(0))).otherwise(F.regexp_extract_all(some, F.lit(ENTITY), F.lit(0))))
    out = out.withColumn("_bk_pieces", F.when(F.size("_bk_found") > 0, F.when(repeats.isNotNull(), F.split(text, repeats, -1)).otherwise(F.split(text, ENTITY, -1))))
    typed = F.zip_with(F.col("_bk_found"), F.slice("_bk_pieces", F.lit(1), F.size("_bk_found")), lambda m, p: F.struct(kind(m, F.right(p, F.lit(24))).alias("kind"), m.alias("mention"), F.right(p, F.lit(24)).alias("before")))
    out = out.withColumn("_bk_typed", F.when(F.col("_bk_pieces").isNotNull(), typed))
    full = lambda m: (m["kind"] == "name") & m["mention"].contains(" ")
    canon = F.transform("_bk_typed", lambda m: F.struct(m["kind"].alias("kind"), m["mention"].alias("mention"), m["before"].alias("before"), canonical(m["kind"], m["mention"]).alias("canon"), F.when(full(m), F.lower(m["mention"])).alias("person"), F.when(full(m), gender(m["mention"], m["before"])).alias("gender")))
    return out.withColumn("_bk_mentions", canon).drop("_bk_found", "_bk_typed", "_bk_repeats")


def _each() -> Column:
    """(kind, canon, gender) of every entity that the mentions name: a full name is one of kind person besides."""
    own = F.transform("_bk_mentions", lambda m: F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"), F.lit(None).cast("string").alias("gender")))
    persons = F.transform(F.filter("_bk_mentions", lambda m: m["person"].isNotNull()), lambda m: F.struct(F.lit("person").alias("kind"), m["person"].alias("canon"), m["gender"].alias("gender")))
    return F.concat(own, persons)


def entities(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """(kind, canon, attempt, surrogate, ...) of every distinct entity, no two of a kind and scope with one surrogate.

    The scope of a person is the family name, and the surrogate that of the given name. ``mixed`` tells that the
    mentions of a person have more than one title's gender."""
    # the outer form, as for the inner one the planner tests the size first and makes the mentions twice
    found = _cut(docs.select(common.column(docs, text_col).alias("text")).filter(F.col("text").rlike(HINT)), F.col("text")).select(F.explode_outer(_each()).alias("m"))
    has = {g: F.coalesce(F.max(F.col("gender") == g), F.lit(False)) for g in ("female", "male", "any", "none")}
    told = F.when(has["female"] & ~has["male"], "female").when(has["male"] & ~has["female"], "male").otherwise("any")
    table = found.select("m.kind", "m.canon", "m.gender").groupBy("kind", "canon").agg(told.alias("gender"), (sum(h.cast("int") for h in has.values()) > 1).alias("mixed")).filter("canon IS NOT NULL").withColumn("attempt", F.lit(0))
    person = F.col("kind") == "person"
    table = table.withColumn("scope", F.when(person, F.substring_index("canon", " ", -1)).otherwise("")).withColumn("real", F.when(person, F.substring_index("canon", " ", 1)).otherwise(F.col("canon")))
    drawn = F.when(person, given(F.col("canon"), F.col("gender"), F.col("attempt"), F.col("_bk_key"))).otherwise(surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("_bk_key")))
    table = common.shared_table(with_key(table, key).withColumn("surrogate", drawn).drop("_bk_key"), "entities")
    while True:
        best = table.groupBy("kind", "scope", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).filter("n > 1")
        shared = table.join(best, ["kind", "scope", "surrogate"]).filter(F.struct("attempt", "canon") != F.col("first")).select("kind", "canon")
        names = table.select("kind", "scope", F.col("real").alias("surrogate")).distinct()
        real = table.join(names, ["kind", "scope", "surrogate"], "left_semi").select("kind", "canon")
        again = common.shared_table(shared.union(real).distinct().withColumn("bad", F.lit(True)), "collisions")
        if again.isEmpty():
            return table
        raised = table.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("bad", F.lit(False)).cast("int"))
        raised = with_key(raised, key).withColumn("surrogate", F.when(F.col("bad"), drawn).otherwise(F.col("surrogate"))).drop("bad", "_bk_key")
        old, table = table, common.shared_table(raised, "entities")
        common.release(old, again)


def replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts, and with pii_count and pii_spans (kind, start, end in the new text)."""
    exceptions = common.shared_table(entities(docs, text_col, key).filter("attempt > 0 OR mixed").select("kind", "canon", "attempt", "gender"), "exceptions")
    names = [c for c in docs.columns if c not in ("pii_count", "pii_spans")]
    cut = _cut(docs.select(*[common.column(docs, c) for c in names]), F.col(f"`{text_col}`"))
    if exceptions.isEmpty():
        cut = cut.withColumn("_bk_attempts", F.lit(None).cast("map<string,struct<attempt:int,gender:string>>"))
    else:
        rows = cut.select(F.col(f"`{id_col}`").alias("_bk_id"), F.xxhash64(text_col).alias("_bk_hash"), F.explode(F.array_distinct(F.transform(_each(), lambda m: F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"))))).alias("m"))
        looked = rows.select("_bk_id", "_bk_hash", "m.kind", "m.canon").join(small(exceptions), ["kind", "canon"]).distinct()
        by_doc = common.shared_table(looked.groupBy("_bk_id", "_bk_hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), F.struct("attempt", "gender")))).alias("_bk_attempts")), "exceptions-by-document")
        cut = cut.withColumn("_bk_text", F.xxhash64(text_col)).join(small(by_doc, 20_000), F.col("_bk_text").eqNullSafe(F.col("_bk_hash")) & F.col(f"`{id_col}`").eqNullSafe(F.col("_bk_id")), "left")
    cut = with_key(cut, key)
    known = lambda kind_, canon: F.element_at("_bk_attempts", F.concat_ws("|", kind_, canon))
    nth = lambda m: F.coalesce(known(m["kind"], m["canon"])["attempt"], F.lit(0))
    tried = F.transform("_bk_mentions", lambda m: F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"), nth(m).alias("attempt")))
    both = F.zip_with(F.col("_bk_mentions"), surrogates(tried, F.col("_bk_key")), lambda m, s: F.struct(m["kind"].alias("kind"), m["mention"].alias("mention"), m["person"].alias("person"), m["gender"].alias("gender"), known(F.lit("person"), m["person"]).alias("known"), s.alias("made")))
    first = lambda m: F.when(m["person"].isNotNull(), given(m["person"], F.coalesce(m["known"]["gender"], m["gender"]), F.coalesce(m["known"]["attempt"], F.lit(0)), F.col("_bk_key")))
    made = F.transform(both, lambda m: F.struct(m["kind"].alias("kind"), rendered(m["kind"], m["mention"], m["made"], first(m)).alias("new")))
    cut = cut.withColumn("_bk_new", made)
    pairs = F.zip_with(F.col("_bk_pieces"), F.col("_bk_new"), lambda p, n: F.concat(p, F.coalesce(n["new"], F.lit(""))))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    sizes = F.zip_with(F.slice("_bk_pieces", F.lit(1), F.size("_bk_new")), F.col("_bk_new"), lambda p, n: F.struct(F.length(p).alias("skip"), n["kind"].alias("kind"), F.length(n["new"]).alias("size")))
    span = lambda at, x: (at + x["skip"] + x["size"], F.struct(x["kind"].alias("kind"), (at + x["skip"]).alias("start"), (at + x["skip"] + x["size"]).alias("end")))
    spans = arrays.folded(sizes, F.lit(0), span, "struct<kind:string,start:int,end:int>")
    text = F.when(F.col("_bk_new").isNotNull(), F.concat_ws("", pairs)).otherwise(F.col(f"`{text_col}`"))
    return cut.select(*[(text if c == text_col else F.col("`" + c.replace("`", "``") + "`")).alias(c) for c in names], F.coalesce(F.size("_bk_new"), F.lit(0)).cast("int").alias("pii_count"), F.coalesce(F.when(F.col("_bk_new").isNotNull(), spans), empty).alias("pii_spans"))
