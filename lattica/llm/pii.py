"""Surrogates for personal data (operator 10), in DataFrame functions only.

Entities found by one pattern are replaced by keyed surrogates of the same type, format and script
(and gender, for names with a title). A surrogate depends on the key and on the entity's canonical
form only, so that the same entity gets the same one everywhere, however it is written. A name is a given
name and a surname with a surrogate each, so that ``Mr John Smith``, ``Mr Smith`` and, in a text that has
either, a mere ``Smith`` stay one person. Distinct entities are checked for surrogates that coincide with
each other or with an entity of the corpus; those are drawn again with a counter until none is left. As that
is rare, surrogates are computed in the row where the entity stands, and only rows with a redrawn entity are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Where a session names the secret key; KEY is public and for tests and trials only.
KEY_SETTING, KEY = "spark.lattica.pii.key", "replace-this-key"
ROUNDS = 20

# The patterns of entities, tried in this order. Titles tell a name's gender.
MALE_TITLES = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Г-жа", "Κυρία"]
OTHER_TITLES = ["Dr", "Prof", "Rev", "Доктор", "Профессор", "Δρ"]
_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
PATTERNS = [
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    NAME,
    r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\p{L}\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])",
    r"(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[\p{L}\p{N}+/_.-]{6,}",
]
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS)
#: A row without any of these can't hold an entity.
MAYBE = rf"[@0-9]|AKIA|(?i:password|passwd|pwd|secret|token|api_?key)|{_TITLE}"
# Given names by script and gender, and syllables of surnames.
NAMES = {
    "latin": ("James John Robert Michael David Thomas Daniel Paul Mark George Peter Martin", "Mary Anna Laura Sarah Emma Julia Clara Helen Alice Nora Eva Ruth"),
    "cyrillic": ("Иван Пётр Алексей Николай Сергей Андрей Дмитрий Павел Михаил Борис", "Мария Анна Елена Ольга Татьяна Наталья Ирина Вера Софья Дарья"),
    "greek": ("Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Πέτρος Αλέξης", "Μαρία Ελένη Άννα Σοφία Κατερίνα Δήμητρα Βασιλική Ειρήνη"),
}
SYLLABLES = {
    "latin": "bar ben cor dal den fer gal har kel lan mar nor pel ros tan vel",
    "cyrillic": "бар вел гор дан зор кал лев мар нов пол рос сав тар фил хар чер",
    "greek": "βαρ γαλ δελ ζερ θαλ καρ λεν μαρ νικ παλ ροδ σταρ ταλ φιλ χαρ ψαρ",
}
ALPHABETS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[а-я]": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "[А-Я]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}


def kind(e: Column, surnames: Column | None = None) -> Column:
    """The type of an entity; plain for digits that only look like a card (no check digit) or an account."""
    digits = F.regexp_replace(e, r"\D", "")
    right = (10 - _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) % 10) % 10 == F.substring(digits, -1, 1).cast("int")
    bare = F.lit(False) if surnames is None else F.array_contains(surnames, e)
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(rf"^(?:{_TITLE})\.? ") | bare, "name")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), "ip6")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[+(][\d .()-]+$"), "phone")
        .when(e.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when(right, "card").otherwise("plain"))
        .when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), F.when(_mod97(_account(F.replace(e, F.lit(" "), F.lit("")))) == 1, "iban").otherwise("plain"))
        .otherwise("secret")
    )


def _account(iban: Column) -> Column:
    """An account number with its country and check digits at the end, letters as numbers."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    number = lambda i: F.when(F.substring(turned, i, F.lit(1)).rlike("[A-Z]"), (F.ascii(F.substring(turned, i, F.lit(1))) - 55).cast("string")).otherwise(F.substring(turned, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), number), "")


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda acc, i: (acc * 10 + F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))) % 97)


def surname(e: Column) -> Column:
    """The last word of a name."""
    return F.regexp_extract(e, r"([^ ]+)$", 1)


def canonical(e: Column, k: Column) -> Column:
    """The form that all spellings of an entity share; of a name, that of its surname."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(k.isin("email", "ip6"), F.lower(e))
        .when(k == "name", F.lower(surname(e)))
        .when(k == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits))
        .when(k == "card", digits)
        .when(k == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(e)
    )


def given(e: Column, k: Column) -> Column:
    """Gender (m, f or n for unknown) and given name in lower case, or null for a name without one."""
    gender = F.when(e.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? "), "f").when(e.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\.? "), "m").otherwise("n")
    first = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ([^ ]+) [^ ]+$", 1)
    return F.when((k == "name") & (first != ""), F.concat(gender, F.lit(":"), F.lower(first)))


def _byte(h: Column, i: Column) -> Column:
    """Byte i, counted round, of a hex digest of 64 bytes."""
    return F.conv(F.substring(h, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _letters(text: Column, h: Column) -> Column:
    """``text`` with letters and digits drawn anew within their alphabet, the rest as it is."""

    def drawn(i: Column) -> Column:
        c, b = F.substring(text, i, F.lit(1)), _byte(h, i)
        out = F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
        for pattern, letters in ALPHABETS.items():
            out = out.when(c.rlike(pattern), F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), drawn), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string to which a check digit would be appended."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    double = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 0, double(value(i))).otherwise(value(i)))


def _digits(canon: Column, k: Column, h: Column) -> Column:
    """The surrogate of a digit string: a phone number keeps its first digit, a card whether its check digit is right."""
    drawn = F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: (F.when(i == 1, _byte(h, i) % 9 + 1).otherwise(_byte(h, i) % 10)).cast("string")), "")
    body = F.concat(F.substring(drawn, 1, 1), F.substring(drawn, F.lit(2), F.length(canon) - 2))
    original = F.substring(canon, F.lit(1), F.length(canon) - 1)
    check = lambda digits: (10 - _luhn(digits) % 10) % 10
    right = check(original) == F.substring(canon, -1, 1).cast("int")
    card = F.concat(body, ((check(body) + F.when(right, 0).otherwise(1 + _byte(h, F.lit(0)) % 9)) % 10).cast("string"))
    return F.when(k == "card", card).otherwise(F.concat(F.substring(canon, 1, 1), F.substring(drawn, F.lit(2), F.length(canon))))


def _pick(words: str, b: Column) -> Column:
    some = words.split()
    return F.element_at(F.array(*map(F.lit, some)), b % len(some) + 1)


def _added(counter: Column, one) -> Column:
    """``one`` of 1 to ``counter`` strung together: each further draw has a larger space, so that draws end."""
    return F.when(counter > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(counter, F.lit(1))), one), "")).otherwise("")


def _by_script(canon: Column, made) -> Column:
    out = F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek"))
    return out.otherwise(made("latin"))


def _surname(canon: Column, h: Column, counter: Column) -> Column:
    """Three syllables in the script of ``canon``, and one more for each further draw."""
    return _by_script(canon, lambda s: F.concat(*[_pick(SYLLABLES[s], _byte(h, F.lit(i))) for i in (1, 2, 3)], _added(counter, lambda i: _pick(SYLLABLES[s], _byte(h, i + 3)))))


def _given(canon: Column, h: Column, counter: Column) -> Column:
    """A name of the gender and script of ``canon`` (g:name), and a syllable more for each further draw."""

    def made(script: str) -> Column:
        male, female = NAMES[script]
        name = F.when(canon.startswith("f:"), _pick(female, _byte(h, F.lit(0)))).when(canon.startswith("m:"), _pick(male, _byte(h, F.lit(0)))).otherwise(_pick(f"{male} {female}", _byte(h, F.lit(0))))
        return F.concat(F.lower(name), _added(counter, lambda i: _pick(SYLLABLES[script], _byte(h, i + 3))))

    return _by_script(canon, made)


def keyed(canon: Column, k: Column, counter: Column, key: str) -> Column:
    """The digest that a surrogate's letters and digits are drawn from."""
    return F.sha2(F.concat_ws("|", F.lit(key), k, counter.cast("string"), canon), 512)


def surrogate(canon: Column, k: Column, h: Column, key: str = KEY, counter: Column | None = None) -> Column:
    """The canonical surrogate of a canonical entity, drawn from its digest ``h``.

    Names, mailboxes and secrets are the longer, the larger ``counter`` is; numbers keep their length.
    """
    n = F.lit(0) if counter is None else counter
    more = F.lit("") if counter is None else _added(counter, lambda i: F.substring(h, i + 100, F.lit(1)))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    d = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512)
    ip = F.concat_ws(".", *[(_byte(h, F.lit(i)) % m + a).cast("string") for i, (m, a) in enumerate(((223, 1), (256, 0), (256, 0), (254, 1)))])
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(canon), F.lit(1))), lambda i: F.when(F.substring(canon, i, F.lit(1)) == ":", ":").otherwise(F.substring(h, i, F.lit(1)))), "")
    body = _letters(F.substring(canon, F.lit(5), F.length(canon)), h)
    check = F.lpad((98 - _mod97(_account(F.concat(F.substring(canon, 1, 2), F.lit("00"), body)))).cast("string"), 2, "0")
    return (
        F.when(k == "email", F.concat(_letters(local, h), more, F.lit("@d"), F.substring(d, 1, 8), F.lit(".example")))
        .when(k == "name", _surname(canon, h, n))
        .when(k == "given", _given(canon, h, n))
        .when(k == "ip", ip)
        .when(k == "ip6", hexed)
        .when(k == "iban", F.concat(F.substring(canon, 1, 2), check, body))
        .when(k == "ssn", F.concat(F.lit("9"), F.substring(_letters(canon, h), 2, 10)))
        .when(k.isin("phone", "card"), _digits(canon, k, h))
        .when(canon.rlike("^[0-9a-f]+$"), F.concat(F.substring(F.repeat(h, F.floor(F.length(canon) / 128).cast("int") + 1), F.lit(1), F.length(canon)), more))
        .otherwise(F.concat(_letters(canon, h), more))
    )


def _cased(s: Column, like: Column) -> Column:
    """A name as its original: all capitals if that has no small letter, else with a capital first."""
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(s)).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))


def written(e: Column, k: Column, s: Column, g: Column) -> Column:
    """A canonical surrogate (and that of a given name) in the format of the entity it replaces."""
    count = lambda x: F.length(F.regexp_replace(x, "[^0-9A-Za-z]", ""))
    # a country code that the canonical form leaves out stays
    kept = F.greatest(count(e) - F.length(s), F.lit(0))
    nth = lambda i: count(F.substring(e, F.lit(1), i)) - kept
    one = lambda i: F.substring(e, i, F.lit(1))
    placed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: F.when(one(i).rlike("[0-9A-Za-z]") & (nth(i) > 0), F.substring(s, nth(i), F.lit(1))).otherwise(one(i))), "")
    title = F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)
    first = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ([^ ]+) [^ ]+$", 1)
    name = F.concat(title, F.when(g.isNotNull(), F.concat(_cased(g, first), F.lit(" "))).otherwise(""), _cased(s, surname(e)))
    return F.when(k == "plain", e).when(k == "name", name).when(k.isin("phone", "card", "iban"), placed).otherwise(s)


def _surnames(text: Column) -> Column:
    """Surnames of the names with titles in a text, as they are written."""
    return F.when(text.rlike(_TITLE), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), surname))).otherwise(F.array().cast("array<string>"))


def _pattern(surnames: Column) -> Column:
    """The pattern of a text's entities: a surname told with a title is one wherever it stands."""
    return F.concat(F.lit(ENTITY + r"|(?:(?<![\p{L}\p{N}])(?:"), F.array_join(surnames, "|"), F.lit(r")(?![\p{L}\p{N}]))"))


def _entities(text: Column, surnames: Column) -> Column:
    found = F.when(F.size(surnames) > 0, F.regexp_extract_all(text, _pattern(surnames), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.when(text.rlike(MAYBE), found).otherwise(F.array().cast("array<string>"))


def redrawn(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, counter) of the distinct ``entities`` (kind, canon) whose first surrogate isn't free.

    A surrogate is free if it is no entity of the corpus and no other entity has it; of several that
    would share one, the smallest keeps it. Given names of both genders are compared with one another.
    """
    entities = cut(entities.distinct())
    tried, moved, taken = entities.withColumn("counter", F.lit(0)), None, None
    real = entities.select("kind", F.when(F.col("kind") == "given", F.substring("canon", 3, 1 << 30)).otherwise(F.col("canon")).alias("s")).distinct()
    for n in range(ROUNDS):
        tried = tried.withColumn("h", keyed(F.col("canon"), F.col("kind"), F.col("counter"), key))
        tried = cut(tried.withColumn("s", surrogate(F.col("canon"), F.col("kind"), F.col("h"), key, F.col("counter"))).drop("h"))
        first = tried.groupBy("kind", "s").agg(F.min("canon").alias("canon"))
        first = first.join(real, ["kind", "s"], "left_anti")
        if taken is not None:
            first = first.join(taken, ["kind", "s"], "left_anti")
        won = tried.join(first.select("kind", "canon"), ["kind", "canon"], "left_semi")
        lost = cut(tried.join(first.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("counter") + 1).alias("counter")))
        if n:
            mine = won.select("kind", "canon", "counter")
            moved = mine if moved is None else moved.unionByName(mine)
        if not lost.take(1):
            break
        now = won.select("kind", "s")
        taken = cut(now if taken is None else taken.unionByName(now))
        tried = lost
    else:
        raise ValueError(f"surrogates still coincide after {ROUNDS} draws")
    return cut(moved if moved is not None else entities.withColumn("counter", F.lit(0)).where("false"))


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING; without one the public KEY, which protects nobody."""
    return spark.conf.get(KEY_SETTING, KEY)


def replace(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity of the text replaced, and _kinds, the array of their kinds in order.

    Null and empty texts stay (no entity). Null ids and repeated rows are rows like others. An empty table
    gives an empty result. Columns named _kinds are replaced. ``key`` is by default the session's.
    """
    key = session_key(docs.sparkSession) if key is None else key
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = lambda e, k: F.array(F.struct(k.alias("kind"), canonical(e, k).alias("canon")), F.when(given(e, k).isNotNull(), F.struct(F.lit("given").alias("kind"), given(e, k).alias("canon"))))
    found = docs.select(text.alias("t")).where(F.col("t").rlike(MAYBE)).select("t", _surnames(F.col("t")).alias("n"))
    found = found.select("n", F.explode(_entities(F.col("t"), F.col("n"))).alias("e")).withColumn("k", kind(F.col("e"), F.col("n"))).where("k <> 'plain'")
    named = found.select(F.explode(F.filter(parts(F.col("e"), F.col("k")), lambda x: x.isNotNull())).alias("x")).select("x.*")
    moved = redrawn(named, key)
    row = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    rows = docs.drop("_kinds").withColumn("__pii_n", _surnames(text))
    rows = rows.withColumn("__pii_e", _entities(text, F.col("__pii_n")))
    # step by step, so that kinds, canonical forms and digests are computed once an entity
    rows = rows.withColumn("__pii_e", F.transform("__pii_e", lambda e: F.struct(e.alias("e"), kind(e, F.col("__pii_n")).alias("k"))))
    any_moved = bool(moved.take(1))
    if any_moved:
        held = rows.where(F.size("__pii_e") > 0).select(row.alias("row"), F.explode("__pii_e").alias("x")).where("x.k <> 'plain'")
        held = held.select("row", F.explode(F.filter(parts(F.col("x.e"), F.col("x.k")), lambda x: x.isNotNull())).alias("x")).select("row", "x.*")
        counters = held.join(moved, ["kind", "canon"]).select("row", F.concat_ws("|", "kind", "canon").alias("what"), "counter").distinct()
        counters = counters.groupBy(F.col("row").alias("__pii_row")).agg(F.map_from_entries(F.collect_list(F.struct("what", "counter"))).alias("__pii_counter"))
        rows = rows.withColumn("__pii_key", row).join(counters, F.col("__pii_key") == F.col("__pii_row"), "left").drop("__pii_key", "__pii_row")
    counter = lambda k, c: F.coalesce(F.element_at("__pii_counter", F.concat_ws("|", k, c)), F.lit(0)) if any_moved else F.lit(0)
    rows = rows.withColumn("__pii_c", F.transform("__pii_e", lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), canonical(x["e"], x["k"]).alias("c"), given(x["e"], x["k"]).alias("g"))))
    rows = rows.withColumn("__pii_m", F.transform("__pii_c", lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), x["c"].alias("c"), x["g"].alias("g"), counter(x["k"], x["c"]).alias("n"), F.when(x["g"].isNotNull(), counter(F.lit("given"), x["g"])).alias("m"))))
    rows = rows.withColumn("__pii_h", F.transform("__pii_m", lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), x["c"].alias("c"), x["g"].alias("g"), x["n"].alias("n"), x["m"].alias("m"), keyed(x["c"], x["k"], x["n"], key).alias("h"), F.when(x["g"].isNotNull(), keyed(x["g"], F.lit("given"), x["m"], key)).alias("i"))))
    rows = rows.withColumn("__pii_s", F.transform("__pii_h", lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), surrogate(x["c"], x["k"], x["h"], key, x["n"] if any_moved else None).alias("s"), F.when(x["g"].isNotNull(), _given(x["g"], x["i"], x["m"])).alias("g"))))
    drawn = F.transform("__pii_s", lambda x: written(x["e"], x["k"], x["s"], x["g"]))
    # what stands between the entities, and the surrogates: columns of their own, so that each is computed once
    some = F.size("__pii_e") > 0
    between = F.when(F.size("__pii_n") > 0, F.split(text, _pattern(F.col("__pii_n")), -1)).otherwise(F.split(text, ENTITY, -1))
    rows = rows.withColumn("__pii_between", F.when(some, between)).withColumn("__pii_new", F.when(some, drawn)).withColumn("_kinds", F.filter(F.transform("__pii_e", lambda x: x["k"]), lambda k: k != "plain"))
    joined = F.concat(F.array_join(F.zip_with(F.slice("__pii_between", 1, F.size("__pii_e")), F.col("__pii_new"), lambda a, b: F.concat(a, b)), ""), F.element_at("__pii_between", -1))
    return rows.withColumn(text_col, F.when(some, joined).otherwise(F.col(text_col))).drop("__pii_n", "__pii_e", "__pii_c", "__pii_m", "__pii_h", "__pii_s", "__pii_counter", "__pii_between", "__pii_new")
