"""PII surrogates: every detected entity becomes a keyed stand-in of its own kind, in DataFrame functions only.

Emails, phone numbers, IPv4 addresses, card numbers, US social security numbers, IBANs,
secrets and names after an honorific are found by one expression per kind, in one pass.
Strings of hexadecimal digits are secrets after a word like ``token``, ``key`` or
``password``; others (checksums, commit ids) stay.  Once an honorific has made a name
known, further mentions of its parts in the same document are replaced too; names that
never follow an honorific in their document are not found.

An entity has parts: a name's given and family name, else the entity itself in
canonical form (digits of a number, lower case of an address), so mentions in other
formats share a part and thus a surrogate.  A part's surrogate is drawn from a keyed
digest: letters for letters, digits for digits, octets for octets, a valid Luhn digit
for a valid one, hexadecimal for hexadecimal, syllables of the name's script with an
ending of the honorific's gender.  It is then laid out like the mention it replaces.

Collision checks: over the table of distinct parts, a surrogate that equals another
part's surrogate or any original part of its kind is drawn again (the earliest attempt,
then the smallest part keeps it), until all are distinct.  Names grow by a syllable with
each attempt, other kinds but addresses of fixed length after a few, so their stand-ins
do not run out.  Only documents with entities are joined; a part that a vast number of
documents mention is one row on the smaller side, and the join of mentions splits its
skewed partitions at run time.

Cases: null text stays null; empty text stays empty; repeated rows get equal texts;
rows without id are replaced like any others; a very long text is searched whole; an
empty table gives no rows; all other columns are carried through, whatever their names,
but for an old ``n_entities``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_prefix

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What stands before a string of hexadecimal digits that is a secret.
_NAMED = r"(?<=(?i:token|secret|key|password|passwd|pwd|auth|bearer|credential|session)[A-Za-z_]{0,12}[\"']?\s{0,2}[:=]{0,2}\s{0,2}[\"']?)"
_NAME = r"\p{Lu}(?:\p{L}{1,40}|['’]\p{L}{2,40})(?:['’-]\p{L}{2,40}){0,3}"
#: Kinds in order of precedence: their expressions (Java syntax), without groups.
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,24}(?![A-Za-z])",
    "secret": rf"(?<![0-9A-Za-z_])(?:(?=[0-9A-Fa-f]{{32}}){_NAMED}(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})|AKIA[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36}})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "card": r"(?<![0-9A-Za-z.-])(?:\d{4}[ -]){3}\d{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z.-])\d{13,19}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:Mr\.|Mrs\.|Ms\.|Mme\.?|Sr\.|Sra\.|Herr|Frau|Monsieur|Madame|Señor|Señora|г-н|г-жа|Κύριος|Κυρία) {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: An entity alone, without what stood before it.
_ALONE = KINDS | {"secret": KINDS["secret"].replace(_NAMED, "")}
#: Words and what lies between them.
_WORDS = r"\p{L}+(?:['’-]\p{L}{2,})*|\P{L}+"
_FEMALE = r"^(Mrs\.|Ms\.|Mme\.?|Sra\.|Frau|Madame|Señora|г-жа|Κυρία) "
#: Syllables and endings of drawn names by script.
SCRIPTS: dict[str, tuple[str, str, str]] = {
    "latin": ("ba be da do el fa fi ga ha jo ka ke la le li lo ma me mi na ne no or pa ra re ri ro sa se ta te ti va vi", "na la ra da", "n r s l"),
    "cyrillic": ("ба бе да до ел фа фи га ка ке ла ле ли ло ма ме ми на не но ра ре ри ро са се та те ти ва ви", "на ла ра да", "н р с л"),
    "greek": ("βα βε δα δο ελ φα φι γα κα κε λα λε λι λο μα με μι να νε νο ρα ρε ρι ρο σα σε τα τε τι", "να λα ρα δα", "νος ρος σος λος"),
}


def _first(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(pairs), otherwise)


def kind_of(entity: Column) -> Column:
    return _first([(entity.rlike(rf"^(?:{p})$"), F.lit(k)) for k, p in _ALONE.items()], F.lit("name"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def parts_of(kind: Column, entity: Column) -> Column:
    """array of (kind, text): what the entity has in canonical form."""
    names = F.split(F.regexp_replace(entity, r"^\S+ ", ""), " ")
    gender = F.when(entity.rlike(_FEMALE), F.lit("given_f")).otherwise(F.lit("given_m"))
    part = lambda k, t: F.struct(k.alias("kind"), t.alias("text"))
    name = F.when(F.size(names) > 1, F.array(part(gender, F.lower(names[0])), part(F.lit("family"), F.lower(names[1])))).otherwise(F.array(part(F.lit("family"), F.lower(names[0]))))
    canonical = F.when(kind.isin("phone", "card", "ssn"), _digits(entity)).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "email", F.lower(entity)).otherwise(entity)
    return F.when(kind == "name", name).otherwise(F.array(part(kind, canonical)))


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a digest of 64 bytes in hexadecimal, from 0 and around."""
    return F.conv(F.substring(digest, (i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(choices: str, n: Column) -> Column:
    return F.substring(F.lit(choices), n % len(choices) + 1, F.lit(1))


def _extra(choices: str, digest: Column, attempt: Column, after: int = 3) -> Column:
    """A character more for each attempt after the given one."""
    more = F.transform(F.sequence(F.lit(after + 1), F.greatest(attempt, F.lit(after + 1))), lambda i: _pick(choices, _byte(digest, i + 20)))
    return F.when(attempt > after, F.array_join(more, "")).otherwise(F.lit(""))


def _redrawn(text: Column, digest: Column, from_: int = 1) -> Column:
    """Each ASCII letter and digit from place ``from_`` on replaced within its class."""
    def char(i: Column) -> Column:
        c, b = F.substring(text, i, F.lit(1)), _byte(digest, i)
        new = F.when(c.rlike("[0-9]"), _pick("0123456789", b)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", b)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c)
        return F.when(i < from_, c).otherwise(new)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), char), "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; doubled_last says whether the last digit is a doubled one."""
    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = (i % 2 == 0) if doubled_last else (i % 2 == 1)
        return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), term), F.lit(0), lambda a, x: a + x)


def draw(kind: Column, text: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a part, the same for the same key and attempt."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, text, attempt.cast("string")), 512)
    octet = lambda i: (_byte(digest, F.lit(i)) % 254 + 1).cast("string")
    ip = F.concat_ws(".", *(octet(i) for i in range(4)))
    domain = F.regexp_extract(text, r"(\.[a-z]+)$", 1)
    digits, letters = (_extra(c, digest, attempt) for c in ("0123456789", "abcdefghijklmnopqrstuvwxyz"))
    email = F.concat(letters, _redrawn(F.substring(text, F.lit(1), F.length(text) - F.length(domain)), digest), domain)
    hexes = F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: _pick("0123456789abcdef", _byte(digest, i))), "")
    plain_hex = text.rlike("^[0-9a-f]+$")
    secret = F.when(plain_hex, hexes).when(text.rlike("^[0-9A-F]+$"), F.upper(hexes)).otherwise(_redrawn(text, digest, 5))
    drawn = _redrawn(text, digest, 2)
    body = F.substring(drawn, F.lit(1), F.length(text) - 1)
    check = ((10 - luhn_sum(body, True) % 10) % 10).cast("string")
    card = F.when(luhn_sum(text, False) % 10 == 0, F.concat(body, check)).otherwise(drawn)
    # country code and a fictional 555 exchange stay, an area code starts with 2 to 9
    area = F.concat(_pick("23456789", _byte(digest, F.lit(2))), F.substring(drawn, 3, 2))
    phone = F.when(text.rlike(r"^1\d{3}555\d{4}$"), F.concat(F.lit("1"), area, F.lit("555"), F.substring(drawn, 8, 4))).otherwise(_redrawn(text, digest, 3))
    iban = F.concat(F.substring(text, 1, 2), F.substring(_redrawn(text, digest, 3), 3, 40))

    def named(script: str) -> Column:
        syllables, female, male = (F.array(*map(F.lit, s.split())) for s in SCRIPTS[script])
        one = lambda options, i: F.element_at(options, _byte(digest, F.lit(i)) % F.size(options) + 1)
        ending = F.when(kind == "given_f", one(female, 5)).when(kind == "given_m", one(male, 5)).otherwise(F.concat(one(syllables, 6), one(male, 5)))
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.element_at(syllables, _byte(digest, i + 9) % F.size(syllables) + 1)), "")).otherwise(F.lit(""))
        return F.concat(one(syllables, 0), one(syllables, 1), F.when(kind == "family", one(syllables, 2)).otherwise(F.lit("")), more, ending)

    name = F.when(text.rlike(r"\p{IsCyrillic}"), named("cyrillic")).when(text.rlike(r"\p{IsGreek}"), named("greek")).otherwise(named("latin"))
    return F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "secret", F.concat(secret, digits)).when(kind == "card", F.concat(card, digits)).when(kind == "phone", F.concat(phone, digits)).when(kind == "ssn", F.concat(drawn, digits)).when(kind == "iban", F.concat(iban, digits)).otherwise(name)


def _laid_out(entity: Column, digits: Column) -> Column:
    """The digits put in place of the entity's own, those that are left behind them."""
    chars = F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.struct(F.substring(entity, i, F.lit(1)).alias("c"), F.length(_digits(F.substring(entity, F.lit(1), i))).alias("n")))
    own = F.array_join(F.transform(chars, lambda x: F.when(x["c"].rlike("[0-9]"), F.substring(digits, x["n"], F.lit(1))).otherwise(x["c"])), "")
    return F.concat(own, F.substring(digits, F.length(_digits(entity)) + 1, F.length(digits)))


def _cased(original: Column, new: Column) -> Column:
    first_up = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
    return F.when((original == F.upper(original)) & (F.length(original) > 1), F.upper(new)).when(F.substring(original, 1, 1) != F.lower(F.substring(original, 1, 1)), first_up).otherwise(new)


def render(kind: Column, entity: Column, parts: Column) -> Column:
    """A mention's replacement from the surrogates of its parts."""
    words = F.split(entity, " ")
    name = F.concat_ws(" ", words[0], _cased(words[1], parts[0]), F.when(F.size(words) > 2, _cased(words[2], parts[1])))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(F.substring(entity, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(parts[0], F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), " ", "")), F.lit(1)))), "")
    spaced = F.concat(spaced, F.substring(parts[0], F.length(F.regexp_replace(entity, " ", "")) + 1, F.length(parts[0])))
    return F.when(kind.isin("phone", "card", "ssn"), _laid_out(entity, parts[0])).when(kind == "iban", spaced).when(kind == "email", _cased(entity, parts[0])).when(kind == "name", name).otherwise(parts[0])


def surrogate_table(parts: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, text, surrogate for distinct (kind, text): distinct, and equal to no original of its kind."""
    drawn = parts.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(F.col("kind"), F.col("text"), key, F.col("attempt")))
    now, k = scratch.keep(drawn, "drawn0"), 0
    while True:
        keepers = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "text")).alias("best"))
        taken = now.select("kind", F.col("text").alias("surrogate"), F.lit(True).alias("taken"))
        judged = now.join(keepers, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn("bad", F.col("taken").isNotNull() | (F.struct("attempt", "text") != F.col("best")))
        if judged.where("bad").isEmpty():
            return now.select("kind", "text", "surrogate")
        again = F.col("attempt") + F.col("bad").cast("int")
        redone = judged.select("kind", "text", again.alias("attempt"), F.when(F.col("bad"), draw(F.col("kind"), F.col("text"), key, again)).otherwise(F.col("surrogate")).alias("surrogate"))
        now, k = scratch.keep(redone, f"drawn{k + 1}"), k + 1
        scratch.drop(f"drawn{k - 1}")


def _renamed(word: Column, known: Column) -> Column:
    """The surrogate's place among ``known`` (text, surrogate) if the word is a capitalised part of a known name, else 0."""
    capital = F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1))
    return F.when(capital, F.array_position(known["part_text"], F.lower(word))).otherwise(F.lit(0))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with surrogates in ``text`` and the number of replaced mentions in ``n_entities``."""
    docs = docs.drop("n_entities")
    scratch, prefix = Scratch(docs.sparkSession, "surrogates"), free_prefix(docs)
    own_id, own_key, new, known = (prefix + x for x in ("id", "key", "new", "known"))
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    entity = lambda e: F.struct(kind_of(e).alias("kind"), e.alias("entity"))
    with_parts = lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), parts_of(x["kind"], x["entity"]).alias("parts"))
    hits = docs.where(F.col("text").rlike(PATTERN)).select(F.col("doc_id").alias(own_id), F.xxhash64("text").alias(own_key), F.transform(F.transform(found, entity), with_parts).alias("entities"))
    hits = scratch.keep(hits.dropDuplicates([own_id, own_key]), "hits")
    placed = hits.select(own_id, own_key, F.posexplode("entities").alias("at", "e")).select(own_id, own_key, "at", "e.kind", "e.entity", F.posexplode("e.parts").alias("part_at", "part"))
    table = surrogate_table(placed.select("part.kind", "part.text").distinct(), scratch, key)
    named = table.select(F.col("kind").alias("part_kind"), F.col("text").alias("part_text"), "surrogate")
    matched = placed.withColumn("part_kind", F.col("part.kind")).withColumn("part_text", F.col("part.text")).join(named, ["part_kind", "part_text"])
    mentions = matched.groupBy(own_id, own_key, "at", "kind", "entity").agg(F.array_sort(F.collect_list(F.struct("part_at", "surrogate", "part_text"))).alias("p"))
    mentions = mentions.withColumn("new", render(F.col("kind"), F.col("entity"), F.col("p.surrogate")))
    names = F.flatten(F.collect_list(F.when(F.col("kind") == "name", F.transform("p", lambda x: F.struct(x["part_text"].alias("part_text"), x["surrogate"].alias("surrogate"))))))
    news = mentions.groupBy(own_id, own_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias(new), F.array_sort(F.array_distinct(names)).alias(known))
    news = scratch.keep(news, "news")
    scratch.drop("hits")

    own = F.col(known)
    words = F.transform(F.split(F.col("text"), PATTERN, -1), lambda piece: F.regexp_extract_all(piece, F.lit(_WORDS), F.lit(0)))
    def stand_in(word: Column) -> Column:
        at = _renamed(word, own)
        return F.when(at > 0, _cased(word, F.element_at(own["surrogate"], F.greatest(at, F.lit(1)).cast("int")))).otherwise(word)
    has_names = F.size(own) > 0
    pieces = F.when(has_names, F.transform(words, lambda piece: F.array_join(F.transform(piece, stand_in), ""))).otherwise(F.split(F.col("text"), PATTERN, -1))
    later = F.when(has_names, F.size(F.filter(F.flatten(words), lambda word: _renamed(word, own) > 0))).otherwise(0)
    filled = F.array_join(F.zip_with(pieces, F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    side = news.hint("merge")  # grows with the corpus; texts are searched once, above
    joined = docs.join(side, docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)), "left")
    touched = F.col(new).isNotNull()
    text, count = F.when(touched, filled).otherwise(F.col("text")), F.when(touched, F.size(new) + later).otherwise(0).cast("long")
    return joined.withColumns({"text": text, "n_entities": count}).select(*docs.columns, "n_entities")
