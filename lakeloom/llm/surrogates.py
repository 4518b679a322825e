"""Personal data: entities are found by patterns and replaced by keyed surrogates, in DataFrame operations alone.

A surrogate depends on the key, the entity's type and its canonical form, so that one entity has the same surrogate in
every text and in every way of writing it; separators, case, digits and letters of the same script stay where they
were. An IP address becomes another, an email address one under the reserved domain `example`, a name after a title
one of the title's gender. The canonical forms of all entities of the corpus are checked: where two of a type would
share a surrogate, or one would equal an entity of the corpus, the later ones are keyed again until none does; after
some attempts their surrogates become longer with each, so there is room for any number.

Null texts stay null with no entities; texts without entities stay as they are. Very long texts are read whole. Equal
rows are treated alike, and ids play no part. An empty table gives no rows. All columns of the input are kept, whatever their
names; `n_entities` is added or replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, located, scratch, small, unused, written

#: Attempts after which surrogates become longer.
LONGER = 4

# Formats of what is looked for, in the order in which they are tried at a place.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_MALE, _FEMALE = "Mr|Herr|Señor|Sr|Monsieur|Signor", "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Signora"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "man": rf"(?<!\p{{L}})(?:{_MALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
    "woman": rf"(?<!\p{{L}})(?:{_FEMALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
#: Any match has one of these (a digit, an @, a title, or a secret's own form, which may have neither); most texts have none and are not searched further.
_HINT = rf"[0-9@]|(?=[FHMS])(?:{_MALE}|{_FEMALE})\.? \p{{Lu}}|sk-[0-9A-Za-z_-]{{20}}|[A-Fa-f]{{32}}|AKIA[A-Z]{{16}}|gh[pousr]_[A-Za-z]{{36}}"
# Names for surrogates by gender and script, and the letters of the scripts.
GIVEN = {
    ("man", "latin"): "Adam Albert Bruno Carl Daniel Edgar Felix Georg Henry Ivan Jonas Karl Leo Martin Noel Oscar Paul Robert Simon Tomas Victor Walter".split(),
    ("woman", "latin"): "Ada Alice Berta Clara Diana Elena Flora Greta Helen Irma Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tina Vera Wilma".split(),
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей".split(),
    ("woman", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("man", "greek"): "Αδάμ Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("woman", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Λίνα Μαρία Νίκη Πηνελόπη Σοφία".split(),
}
FAMILY = {
    "latin": "Abel Baker Conrad Delmar Eckert Farmer Garner Holt Ingram Jarvis Kessler Lorenz Marsh Nolan Ortega Porter Quint Ritter Sander Tanner Urban Vidal Weber York Zeller".split(),
    "cyrillic": "Абрамов Белов Волков Громов Дубов Жуков Зимин Котов Лебедев Морозов Носов Орлов Петров Рябов Соколов".split(),
    "greek": "Αλεξίου Βλάχος Γεωργίου Δήμου Ζάππας Κόκκινος Λάμπρου Μακρής Νικολάου Παππάς Ρήγας".split(),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _any() -> str:
    """All patterns; what begins with a figure, and titles, aren't tried at other characters."""
    first = {"iban": "[A-Z]", "ip": "[0-9]", "ssn": "[0-9]", "card": "[0-9]", "phone": "[0-9+(]", "man": "[HMS]", "woman": "[FMS]"}
    return "|".join(f"(?={first[k]})(?:{p})" if k in first else f"(?:{p})" for k, p in PATTERNS.items())


def found(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_any()), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(entity: Column) -> Column:
    out = F.lit("phone")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def canonical(type_: Column, entity: Column) -> Column:
    """One form for all ways of writing an entity."""
    title = F.regexp_replace(entity, rf"^(?:{_MALE}|{_FEMALE})\.? ", "")
    return F.lower(F.when(type_.isin("email", "ip", "secret"), entity).when(type_.isin("man", "woman"), title).otherwise(F.regexp_replace(entity, "[^0-9A-Za-z]", "")))


def _digest(key: str, type_: Column, form: Column, attempt: Column, part: str) -> Column:
    """128 hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(part + str(k)), type_, form, attempt.cast("string")), 256) for k in (0, 1)])


def _number(digest: Column, at: Column | int) -> Column:
    """A number below 65,536 of the digest's place `at`; places repeat after 125."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, at % 125 + 1, F.lit(4)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _like(value: Column, digest: Column, hexa: Column, first: Column) -> Column:
    """`value` with other digits and letters; `first` of them are kept. The nth has the same place in any writing."""

    def step(acc: Column, ch: Column) -> Column:
        n = _number(digest, acc["i"] * 3)
        lower = F.lower(ch)
        new = F.when(ch.rlike("[0-9]"), F.when(hexa, _letter("0123456789abcdef", n)).otherwise((n % 10).cast("string")))
        new = new.when(lower.rlike("[a-z]"), F.when(hexa & lower.rlike("[a-f]"), _letter("0123456789abcdef", n)).otherwise(_letter(LETTERS["latin"], n)))
        new = new.when(lower.rlike(r"\p{IsCyrillic}"), _letter(LETTERS["cyrillic"], n)).when(lower.rlike(r"\p{IsGreek}"), _letter(LETTERS["greek"], n))
        new = new.when(lower.rlike(r"\p{L}"), _letter(LETTERS["latin"], n))
        new = F.when(new.isNotNull() & (acc["i"] < first), ch).when(ch != lower, F.upper(new)).otherwise(new)
        return F.struct(F.concat(acc["s"], F.coalesce(new, ch)).alias("s"), (acc["i"] + new.isNotNull().cast("int")).alias("i"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), step)["s"]


def _name(type_: Column, value: Column, digest: Column) -> Column:
    out = None
    for script, rule in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", r".")):
        pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n % len(names) + 1)
        given = F.when(type_ == "man", pick(GIVEN["man", script], _number(digest, 0))).otherwise(pick(GIVEN["woman", script], _number(digest, 0)))
        # More names than the lists have: a further syllable of letters tells them apart.
        rest = F.concat(*[_letter(LETTERS[script], _number(digest, k)) for k in (8, 12, 16)])
        family = F.concat(pick(FAMILY[script], _number(digest, 4)), rest)
        both = F.concat_ws(" ", given, family)
        out = F.when(value.rlike(rule), both) if out is None else out.when(value.rlike(rule), both)
    return out


def entities(values: Column, key: str, attempt: Callable[[Column, Column], Column]) -> Column:
    """For each entity a struct: v (as written), t (type), f (canonical form), s (surrogate), g (the surrogate's form).

    One step after another, each over an array of structs, so that nothing is worked out twice.
    """
    title = rf"^(?:{_MALE}|{_FEMALE})\.? "
    a = F.transform(values, lambda v: F.struct(v.alias("v"), kind(v).alias("t")))
    a = F.transform(a, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"), canonical(x["t"], x["v"]).alias("f")))
    a = F.transform(a, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"), x["f"].alias("f"), attempt(x["t"], x["f"]).alias("a")))
    a = F.transform(a, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"), x["f"].alias("f"), x["a"].alias("a"), _digest(key, x["t"], x["f"], x["a"], "").alias("d"), _digest(key, F.lit("domain"), F.regexp_extract(x["f"], "@(.*)$", 1), F.lit(0), "").alias("m")))

    def made(x: Column) -> Column:
        v, t, d, m = x["v"], x["t"], x["d"], x["m"]
        more = lambda ch: F.when(x["a"] < LONGER, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(LONGER), F.greatest(x["a"], F.lit(LONGER))), lambda k: ch(_number(d, 60 + 7 * k))), ""))
        digit, letter = (lambda n: (n % 10).cast("string")), (lambda n: _letter(LETTERS["latin"], n))
        email = F.concat(_like(F.regexp_extract(v, "^([^@]*)@", 1), d, F.lit(False), F.lit(0)), more(letter), F.lit("@"), *[_letter(LETTERS["latin"], _number(m, 3 * k)) for k in range(10)], F.lit(".example"))
        octets = F.concat_ws(".", *[(_number(d, 5 * k) % 254 + 1).cast("string") for k in range(4)], F.when(x["a"] >= LONGER, more(digit)))
        person = F.concat(F.regexp_extract(v, f"({title})", 1), _name(t, F.regexp_replace(v, title, ""), d), more(letter))
        first = F.when(t == "iban", 2).when((t == "phone") & v.startswith("+"), 1).otherwise(0)
        other = F.concat(_like(v, d, (t == "secret") & v.rlike("^[0-9a-fA-F]+$"), first), more(digit))
        return F.when(t == "email", F.when(v == F.upper(v), F.upper(email)).otherwise(email)).when(t == "ip", octets).when(t.isin("man", "woman"), person).otherwise(other)

    a = F.transform(a, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"), x["f"].alias("f"), made(x).alias("s")))
    return F.transform(a, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"), x["f"].alias("f"), x["s"].alias("s"), canonical(x["t"], x["s"]).alias("g")))


def exceptions(docs: DataFrame, key: str) -> DataFrame | None:
    """(type, form, attempt) of the entities whose first surrogate is taken; None if there are none."""
    each = docs.filter(F.col("text").rlike(_HINT)).select(F.explode(F.array_distinct(found(F.col("text")))).alias("v"))
    # A value may be written in several ways; one of them stands for its form.
    forms = each.groupBy("v").agg(F.lit(0).alias("attempt")).withColumn("type", kind(F.col("v"))).withColumn("form", canonical(F.col("type"), F.col("v")))
    forms = written(forms.groupBy("type", "form").agg(F.min("v").alias("v"), F.lit(0).alias("attempt")), "entities")
    while True:
        now = forms.select("type", "form", "v", "attempt", entities(F.array("v"), key, lambda t, f: F.col("attempt"))[0]["g"].alias("s"))
        now = written(now, "surrogates")
        # One that has kept its surrogate so far keeps it; a form of the corpus is nobody's surrogate.
        rank = F.row_number().over(Window.partitionBy("type", "s").orderBy("attempt", "form"))
        real = now.select(F.col("type").alias("_t"), F.col("form").alias("_f"))
        clash = now.withColumn("_rank", rank).join(real, (F.col("type") == F.col("_t")) & (F.col("s") == F.col("_f")), "left")
        taken = (F.col("_rank") > 1) | F.col("_f").isNotNull()
        moved = written(clash.filter(taken).select("type", "form", "v", (F.col("attempt") + 1).alias("attempt")), "moved")
        if not moved.limit(1).count():
            break
        forms = written(now.drop("s").join(moved.select("type", "form"), ["type", "form"], "left_anti").select("type", "form", "v", "attempt").unionByName(moved), "entities")
    again = written(forms.filter("attempt > 0").select("type", "form", "attempt"), "again", keep=True)
    return again if again.limit(1).count() else None


def replace(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with surrogates in `text`, and n_entities."""
    with scratch(docs.sparkSession):
        again = exceptions(docs, key)
    e, m = unused(docs, "entities"), unused(docs, "again")
    out = docs
    if again is not None:
        rows, at = located(docs, "rows")
        own = rows.filter(F.col("text").rlike(_HINT)).select(at, F.explode(F.array_distinct(found(F.col("text")))).alias("_v")).withColumn("_t", kind(F.col("_v"))).withColumn("_f", canonical(F.col("_t"), F.col("_v")))
        hits = own.join(small(again), (F.col("_t") == F.col("type")) & (F.col("_f") == F.col("form"))).groupBy(at).agg(F.collect_set(F.struct(F.concat_ws("\x1f", "type", "form").alias("k"), "attempt")).alias(m))
        out = rows.join(small(written(hits, "again"), 20_000), at, "left")
        tries = F.map_from_entries(F.coalesce(m, F.array().cast("array<struct<k:string,attempt:int>>")))
    out = out.withColumn(e, F.coalesce(found(F.col("text")), F.array().cast("array<string>")))

    attempt = (lambda t, f: F.lit(0)) if again is None else (lambda t, f: F.coalesce(F.try_element_at(tries, F.concat_ws("\x1f", t, f)), F.lit(0)))
    parts = F.split("text", _any(), -1)
    pieces = F.zip_with(parts, entities(F.col(e), key, attempt), lambda a, b: F.array(a, F.coalesce(b["s"], F.lit(""))))
    text = F.when(F.size(e) == 0, F.col("text")).otherwise(F.concat_ws("", F.flatten(pieces)))
    kept = [text.alias("text") if name == "text" else c for name, c in zip(docs.columns, columns(docs), strict=True) if name != "n_entities"]
    return out.select(*kept, F.size(e).alias("n_entities"))
