"""Personal data replaced by keyed surrogates of the same type; DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.llm.catalog import query, table
from duskline.llm.text import spare, text_key, whole
from duskline.sources.scratch import settle

KEY = "replace-this-key"
#: Given names by script and gender. Each list is also its own pool of surrogates.
GIVEN = {
    "latin female": "Maria Julia Sophia Laura Olivia Emily Clara Victoria Charlotte Isabella Margaret Patricia".split(),
    "latin male": "Michael Thomas David Daniel Robert William Carlos Patrick Alexander Benjamin Christopher Matthew".split(),
    "cyrillic female": "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана".split(),
    "cyrillic male": "Иван Сергей Дмитрий Алексей Николай Владимир Михаил Андрей".split(),
    "greek female": "Ελένη Μαρία Κατερίνα Βασιλική Σοφία Αγγελική".split(),
    "greek male": "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης".split(),
}
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Mme", "Señor", "Señora"]
#: Letters are replaced within their class, so script, case and the sound of a name stay.
CLASSES = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WHO = "|".join([*(n for names in GIVEN.values() for n in names)])
_SURNAME = r"\p{Lu}\p{Ll}{1,60}+(?:-\p{Lu}\p{Ll}{1,60}+)?"
#: The kinds in the order in which they are tried at one place. No group is repeated without bound, as
#: the engine recurses on every round; the bounds of addresses are those of their standards.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:(?:{_WHO})(?: {_SURNAME})?|(?:{'|'.join(TITLES)})\.? {_SURNAME})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: From this attempt on a surrogate may be longer than what it replaces, so a full space ends no search.
LONGER = 8


def _kind(hit: Column) -> Column:
    """Which pattern a match of ``ANY`` belongs to, by its shape."""
    kind = F.lit("name")
    for name in reversed([k for k in PATTERNS if k != "name"]):
        kind = F.when(F.regexp(hit, F.lit(f"^(?:{PATTERNS[name]})$")), F.lit(name)).otherwise(kind)
    return kind


def _entity(kind: Column, hit: Column) -> Column:
    """What two mentions of one entity have in common; of a name, the surname."""
    surname = F.regexp_extract(hit, rf" ({_SURNAME})$", 1)
    return (
        F.when(kind == "name", surname)
        .when(kind == "email", F.lower(hit))
        .when(kind == "ip", hit)
        .otherwise(F.regexp_replace(hit, "[^0-9A-Za-z+]", ""))
    )


def _digest(key: str, *parts: Column) -> Column:
    """128 hex digits that depend on the secret key and the parts."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), 512)


def _number(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _with(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scrambled(text: Column, digest: Column, keep_first: Column, keep_last: Column) -> Column:
    """Every character but the kept ones replaced by one of its class. The arguments are lambda
    variables or their fields, or they would be computed again for every character."""

    def one(i):
        c = F.substr(text, i, F.lit(1))
        classes = F.filter(F.lit(CLASSES), lambda chars: F.contains(chars, c))
        new = _with(
            F.get(classes, F.lit(0)),
            lambda chars: F.substr(chars, F.pmod(_number(digest, i), F.length(chars)) + 1, F.lit(1)),
        )
        kept = (i <= keep_first) | (i > F.length(text) - keep_last)
        return F.when(kept, c).otherwise(F.coalesce(new, c))

    made = F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")
    return F.when(F.length(text) > 0, made).otherwise("")


def _luhn(digits: Column) -> Column:
    """The number with its last digit set so that the check passes."""
    head = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
    tried = lambda x: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head(x), d.cast("string")))
    return _with(digits, lambda x: F.coalesce(F.get(F.filter(tried(x), lambda n: F.call_function("luhn_check", n)), F.lit(0)), x))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of an entity, as a function of key, kind, entity and attempt."""
    is_email = kind == "email"
    first = F.when(kind == "card", 1).when((kind == "iban") | entity.startswith("+"), 2).otherwise(0)
    given = F.struct(
        kind.alias("k"),
        entity.alias("e"),
        attempt.alias("a"),
        _digest(key, kind, entity, attempt.cast("string")).alias("d"),
        F.when(is_email, F.substring_index(entity, "@", 1)).otherwise(entity).alias("t"),
        F.when(is_email, F.substring_index(entity, "@", -1)).alias("domain"),
        first.alias("first"),
        F.when(kind == "name", 1).otherwise(0).alias("last"),
    )

    def extended(x):
        digits = F.translate(F.substr(x["d"], F.lit(100), F.lit(28)), "abcdef", "012345")
        more = F.substr(digits, F.lit(1), F.floor(x["a"] / LONGER).cast("int"))
        return F.struct(
            x["k"].alias("k"), x["d"].alias("d"), more.alias("more"), x["domain"].alias("domain"),
            _scrambled(x["t"], x["d"], x["first"], x["last"]).alias("m"),
        )

    def site(x):
        top = F.substring_index(x["domain"], ".", -1)
        name = F.substr(x["domain"], F.lit(1), F.length(x["domain"]) - F.length(top) - 1)
        parts = F.struct(name.alias("t"), _digest(key, F.lit("site"), x["domain"]).alias("d"))
        made = _with(parts, lambda y: _scrambled(y["t"], y["d"], F.lit(0), F.lit(0)))
        return F.concat(made, F.lit("."), top)

    def by_kind(x):
        octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(x["d"], i) % 254 + 1).cast("string"))
        return (
            F.when(x["k"] == "ip", F.array_join(octets, "."))
            .when(x["k"] == "email", F.concat(x["m"], x["more"], F.lit("@"), site(x)))
            .when(x["k"] == "card", F.concat(_luhn(x["m"]), x["more"]))
            .when(x["k"] == "name", F.concat(x["m"], F.translate(x["more"], "0123456789", "aeiounrstl")))
            .otherwise(F.concat(x["m"], x["more"]))
        )

    return _with(_with(given, extended), by_kind)


def _given_names(key: str) -> dict[str, str]:
    """Each given name's successor in a keyed circle of its list: distinct names stay distinct."""
    found = {}
    for group, names in GIVEN.items():
        circle = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{group}|{n}".encode()).digest())
        found |= {n: circle[(i + 1) % len(circle)] for i, n in enumerate(circle)}
    return found


def _laid_out(kind: Column, hit: Column, made: Column, key: str) -> Column:
    """The surrogate in the punctuation and case of the mention."""
    upper = lambda h, m: F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(h)),
            lambda i: F.when(F.regexp(F.substr(h, i, F.lit(1)), F.lit("[A-Z]")), F.upper(F.substr(m, i, F.lit(1)))).otherwise(
                F.substr(m, i, F.lit(1))
            ),
        ),
        "",
    )

    def fill(acc, i, h, m):
        c = F.substr(h, i, F.lit(1))
        takes = F.regexp(c, F.lit("[0-9A-Za-z+]"))
        return F.struct(
            F.concat(acc["s"], F.when(takes, F.substr(m, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("s"),
            (acc["n"] + F.when(takes, 1).otherwise(0)).alias("n"),
        )

    spaced = lambda h, m: F.aggregate(
        F.sequence(F.lit(1), F.length(h)),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda acc, i: fill(acc, i, h, m),
        lambda acc: F.concat(acc["s"], F.substr(m, acc["n"] + 1, F.length(m))),
    )
    pairs = [x for n, m in _given_names(key).items() for x in (F.lit(n), F.lit(m))]
    first = F.substring_index(hit, " ", 1)
    called = F.coalesce(F.element_at(F.create_map(*pairs), first), first)
    both = F.struct(hit.alias("h"), made.alias("m"))
    return (
        F.when(kind == "name", F.concat(called, F.when(F.length(made) > 0, F.concat(F.lit(" "), made)).otherwise("")))
        .when(kind == "ip", made)
        .when((kind == "email") & (F.length(made) == F.length(hit)), _with(both, lambda x: upper(x["h"], x["m"])))
        .when(kind == "email", made)
        .otherwise(_with(both, lambda x: spaced(x["h"], x["m"])))
    )


def _hits(text: Column) -> Column:
    return F.when(F.regexp(text, F.lit(ANY)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def settled_attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, attempt) of those distinct ``entities`` (kind, entity) whose first surrogate
    will not do: another entity has it, or it is itself an entity of the corpus.

    Of entities that share a surrogate the first in order keeps it; the others, and those whose
    surrogate exists, try again until nothing collides. Every ``LONGER`` attempts add a digit to a
    surrogate, so ever fewer are left.
    """
    made = settle(
        entities.select("kind", "entity", F.lit(0).alias("attempt"))
        .withColumn("made", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)),
        "surrogates",
    )
    real = entities.select("kind", F.col("entity").alias("made"), F.lit(True).alias("real"))
    order = Window.partitionBy("kind", "made").orderBy("attempt", "entity")
    while True:
        shared = made.groupBy("kind", "made").agg(F.count("*").alias("n")).filter("n > 1")
        rivals = made.join(shared, ["kind", "made"]).withColumn("rank", F.row_number().over(order))
        lost = rivals.filter("rank > 1").select("kind", "entity")
        taken = made.join(real, ["kind", "made"], "left_semi").select("kind", "entity")
        again = settle(lost.unionByName(taken).distinct(), "collisions")
        if again.isEmpty():
            return made.filter("attempt > 0").select("kind", "entity", "attempt")
        next_try = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        made = made.join(again.withColumn("again", F.lit(True)), ["kind", "entity"], "left").select(
            "kind", "entity", next_try.alias("attempt"), F.col("again").isNotNull().alias("moved"), "made"
        )
        fresh = surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)
        made = settle(made.withColumn("made", F.when(F.col("moved"), fresh).otherwise(F.col("made"))).drop("moved"), "surrogates")


def with_surrogates(
    docs: DataFrame, text: str = "text", key: str = KEY, count: str = "n_entities", kinds: str = "kinds"
) -> DataFrame:
    """``docs`` with personal data in the text replaced, and ``count`` and ``kinds`` of it.

    Found are e-mail and IP addresses, bank accounts, card, social security and phone numbers,
    and names (a listed given name with or without a surname, or a title with a surname). A
    replacement has the type, punctuation, length, letter classes, script and case of the
    mention; given names keep their gender, card numbers their check, addresses of one site a
    common site. It depends on ``key`` and the entity alone, so all mentions of an entity in
    the corpus get the same one. All entities are checked for collisions: different entities get
    different surrogates, and no surrogate is an entity of the corpus. Given names, which change
    places within their list, and the sites of addresses are not part of this check.

    Null text stays null, empty text empty, with no entities. All columns and rows stay, repeated
    rows too; where a column is already called ``count`` or ``kinds``, the new one gets underscores
    after its name; an empty table stays empty.

    Texts are rewritten where they are. Only the entities of each text, without the text, are
    shuffled, and only texts with an entity that needed another attempt are joined with it.
    """
    count, kinds = spare(docs, count), spare(docs, kinds)
    hits = docs.select(text_key(F.col(text)).alias("text_key"), _hits(whole(F.col(text))).alias("hits"))
    hits = hits.select("text_key", F.explode_outer("hits").alias("hit")).filter(F.col("hit").isNotNull())
    hits = hits.withColumn("kind", _kind(F.col("hit"))).withColumn("entity", _entity(F.col("kind"), F.col("hit")))
    found = settle(hits.filter("entity <> ''").select("text_key", "kind", "entity").distinct(), "entities")
    moved = settle(settled_attempts(found.select("kind", "entity").distinct(), key), "attempts")
    tk, tries, h = spare(docs, "_tk"), spare(docs, "_tries"), spare(docs, "_hits")
    by_text = found.join(moved, ["kind", "entity"]).groupBy(F.col("text_key").alias(tk)).agg(
        F.collect_list(F.struct("kind", "entity", "attempt")).alias(tries)
    )
    by_text = settle(by_text, "attempts_by_text")
    rows = docs.withColumn(tk, text_key(F.col(text))).join(by_text, tk, "left")
    rows = rows.withColumn(h, _hits(whole(F.col(text))))

    def replaced(hit):
        def as_kind(x):
            fits = F.filter(F.col(tries), lambda t: (t["kind"] == x["k"]) & (t["entity"] == x["e"]))
            attempt = F.coalesce(F.get(fits, F.lit(0))["attempt"], F.lit(0))
            return _laid_out(x["k"], x["h"], surrogate(x["k"], x["e"], attempt, key), key)

        known = F.struct(hit.alias("h"), _kind(hit).alias("k"))
        entity = lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"), _entity(x["k"], x["h"]).alias("e"))
        return _with(_with(known, entity), as_kind)

    gaps = F.split(F.col(text), ANY)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(replaced(F.get(F.col(h), i)), F.lit(""))))
    new = F.when(F.size(F.col(h)) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    listed = F.array_join(F.array_sort(F.array_distinct(F.transform(F.col(h), _kind))), ",")
    out = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*out, F.size(F.col(h)).cast("long").alias(count), listed.alias(kinds))


@query("op5_pii_surrogates")
def op5(spark, sf_dir):
    """All documents with personal data replaced."""
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
