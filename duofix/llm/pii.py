"""Surrogates for personal data, with DataFrame functions only.

Entities: e-mail addresses; phone numbers (international, and national ones with separators); IPv4 and IPv6 addresses;
payment-card numbers (valid check digit); IBANs (valid check number); social-security numbers; passwords, and long values with
a digit, that follow a word like password or token; JSON web tokens and keys of well-known forms; names after a form of
address, and the same names without one elsewhere in the same text. Names in other scripts than Latin and Cyrillic aren't found.
Each gets a keyed replacement of its kind: digits for digits, letters of the same case for
letters, valid check digits, the same separators, valid octets, given names of the gender that the form of
address tells, in the script of the original.

An entity's canonical form (digits only, lower case; secrets as they are) decides, so all its mentions get the same
replacement, in their own format; a surname alone gets that of the full name. Replacements of one
kind are checked against each other and against all originals; what collides is drawn again, from the sixth
draw on with one more character each time, so distinct entities stay distinct however few forms their kind has.

Null text stays null, text without entities stays as it is, and repeated rows are treated alike. Texts and entities of any
length are taken whole. Rows with a null id are rewritten like others, an empty table gives an empty result, and extra
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import cut, fresh, need

# Forms of address and given names by gender and script.
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Г-жа|Госпожа"
MALE = "Mr|Herr|Monsieur|Sr|Señor|Г-н|Господин"
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Julia Laura Lena Maria Nora Paula Sara Sofia Vera Irene Marta Alma Ida",
    ("latin", "m"): "Adam Anton Bruno David Emil Felix Hugo Ivan Jonas Karl Leo Marco Oscar Paul Simon Victor",
    ("latin", "u"): "Alex Robin Sam Kim Andrea Sascha Jean Chris",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга",
    ("cyrillic", "m"): "Антон Борис Виктор Иван Лев Олег Павел Юрий",
    ("cyrillic", "u"): "Саша Женя Валя Слава",
}
SYLLABLES = {"latin": "ba be bo da de do fa fe fo ga go ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta te", "cyrillic": "ба бо ва во га го да до ка ко ла ло ма мо на но па по ра ро са со та то"}

TITLES = rf"{FEMALE}|{MALE}|Dr|Prof|Professor|Doctor"
WORD = r"\p{Lu}\p{L}+(?:[\-'’]\p{Lu}\p{L}+)*+"

# Each pattern but that of addresses begins with a cheap look at the next character.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}"
SECRET = (
    r"(?=[TtSsAaPpBb])(?i:\b(?:token|secret|api[_\-]?key|access[_\-]?key|secret[_\-]?key|private[_\-]?key|bearer)\b)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z_\-+/.~]*+[0-9])[A-Za-z0-9_\-+/.~]{16,}+=*+"
    r"|(?=[Pp])(?i:\b(?:password|passwd|passphrase|pwd)\b)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;<>]{4,}+"
    r"|(?=eyJ)\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*+|(?=AKIA)\bAKIA[0-9A-Z]{16}\b|(?=gh[pousr]_)\bgh[pousr]_[A-Za-z0-9]{36,}+"
)
NAME = rf"(?=[MFHSDPГ])\b(?:{TITLES})\.? (?:(?:Dr|Prof)\.? )?{WORD}(?: {WORD})?"
IP = r"(?=[0-9])(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
IP6 = r"(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:])(?<![\w:.])(?:(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?=[A-Fa-f:]*[0-9])::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"
CARD = r"(?=[0-9])(?<![\d])(?:\d{4}(?<four>[ \-])\d{4}\k<four>\d{4}\k<four>\d{4}|\d{4}(?<six>[ \-])\d{6}\k<six>\d{5}|\d{13,19})(?!\d)"
IBAN = r"(?=[A-Z]{2}[0-9]{2})\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"(?=[0-9])(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = (
    r"(?=[0-9+(])(?:(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{1,4}(?:[ .\-]\d{2,4}){2,4})(?!\d)|(?<![\d(])\(\d{3}\) \d{3}-\d{4}(?!\d)"
    r"|(?<![\d+.\-])\d{3}(?<part>[.\-])\d{3}\k<part>\d{4}(?![\d\-]|\.\d)|(?<![\w+/.,:\-])0\d{1,4}[/ \-]\d{3,4}(?:[ \-]?\d{2,4}){1,2}(?![\d/:\-]|[.,]\d))"
)
KINDS = {"secret": SECRET, "email": EMAIL, "ip6": IP6, "phone": PHONE, "ssn": SSN, "iban": IBAN, "card": CARD, "ip": IP, "name": NAME}


def _either(*kinds: str) -> str:
    return "|".join(f"(?:{KINDS[k]})" for k in kinds)


ANY = _either(*KINDS)


def _search(text: Column, use) -> Column:
    """use(pattern) with the kinds that the text can hold: addresses need an @, and all but names and passwords a digit."""
    some = text.rlike(r"(?=[MFHSDPГ])\b(?:" + TITLES + r")\b|[Pp][Aa][Ss][Ss]|[Pp][Ww][Dd]")
    return F.when(text.contains("@"), use(ANY)).when(text.rlike("[0-9]"), use(_either(*(k for k in KINDS if k != "email")))).when(some, use(_either("secret", "name")))


def luhn_sum(digits: Column) -> Column:
    """Of a string of digits, counted so that the last one has weight 1."""
    at = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(at, F.lit(0), lambda a, i: a + term(i))


def mod97(text: Column) -> Column:
    """Of a string of digits and capital letters (A is 10), read as a number."""

    def step(a: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda a, i: step(a, i).cast("int"))


def _turned(iban: Column) -> Column:
    """With the first four characters at the end, as the check number asks."""
    return F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))


def _stream(seed: Column, size: Column) -> Column:
    """At least `size` pseudo-random hex digits."""
    blocks = F.sequence(F.lit(0), F.floor(size / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws("|", seed, k.cast("string")), 256)), "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _nth(stream: Column, i: Column, n: int) -> Column:
    """0 <= number < n from four hex digits."""
    return (F.conv(F.substring(stream, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(words: str, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words.split()]), number + 1)


def _shaped(value: Column, seed: Column, hexadecimal: Column) -> Column:
    """Digits for digits, letters for letters of the same case (a to f in hexadecimal values)."""

    def one(stream: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        n26, n6, n10 = _nth(stream, i, 26), _nth(stream, i, 6), _nth(stream, i, 10)
        letter = F.when(hexadecimal, F.substring(F.lit("abcdef"), n6 + 1, F.lit(1))).otherwise(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n26 + 1, F.lit(1)))
        return F.when(c.rlike("[0-9]"), n10.cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return _let(_stream(seed, F.length(value) * 4), lambda stream: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: one(stream, i)), ""))


def _surrogate(key: str) -> Column:
    """The canonical replacement for kind, canon, attempt."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    stream = _stream(seed, F.lit(64))
    more = F.greatest(attempt - 5, F.lit(0))  # characters beyond those of the original, where its form has too few others
    spare = lambda n, digit: F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: digit(_nth(_stream(F.concat(seed, F.lit("+")), more * 4), i, n))), "")).otherwise(F.lit(""))
    digits_more = spare(10, lambda x: x.cast("string"))
    letters_more = spare(26, lambda x: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), x + 1, F.lit(1)))
    middle = F.sequence(F.lit(2), F.greatest(F.length(canon) - 1, F.lit(2)))
    digits = _let(_stream(seed, F.length(canon) * 4), lambda s: F.concat(F.substring(canon, 1, 1), F.array_join(F.transform(middle, lambda i: _nth(s, i, 10).cast("string")), "")))
    card = _let(digits, lambda d: F.concat(d, ((10 - luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string")))
    ip = F.concat_ws(".", *[(_nth(stream, F.lit(i), 253) + 1).cast("string") for i in range(1, 5)])
    ip6 = F.concat(_shaped(canon, seed, F.lit(True)), digits_more)
    email = F.concat(letters_more, _shaped(F.regexp_extract(canon, r"^(.*)\.[^.]+$", 1), seed, F.lit(False)), F.lit("."), F.regexp_extract(canon, r"\.([^.]+)$", 1))
    # phones keep their country code, which canon has before a colon
    phone = F.concat(F.substring_index(canon, ":", 1), F.lit(":"), _shaped(F.substring_index(canon, ":", -1), seed, F.lit(False)), digits_more)
    ssn = F.concat(_shaped(canon, seed, F.lit(False)), digits_more)
    iban = _let(_shaped(F.substring(canon, F.lit(5), F.length(canon)), seed, F.lit(False)), lambda x: F.concat(F.substring(canon, 1, 2), F.lpad((98 - mod97(F.concat(x, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))
    secret = F.concat(_shaped(canon, seed, canon.rlike("^[0-9a-fA-F]+$")), letters_more)
    given = F.lit(None).cast("string")
    sur = F.lit(None).cast("string")
    parts = F.size(F.split(canon, "-"))  # a double name gets a double name
    for script, syllables in SYLLABLES.items():
        here = canon.startswith(script)
        size = len(syllables.split())
        tail = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(attempt / 2).cast("int"), F.lit(1))), lambda i: _pick(syllables, _nth(_stream(F.concat(seed, F.lit("~")), attempt * 4 + 4), i, size))), "")
        for g in "fmu":
            names = GIVEN[script, g]
            n = len(names.split())
            one = F.array_join(F.transform(F.sequence(F.lit(1), parts), lambda i: _pick(names, _nth(_stream(seed, parts * 4), i, n))), "-")
            given = F.when(here & canon.startswith(f"{script}:{g}:"), F.concat(one, F.when(attempt > 0, tail).otherwise(F.lit("")))).otherwise(given)
        long = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: _pick(syllables, _nth(_stream(seed, parts * 20), k * 5 + i, size))), "")))
        sur = F.when(here, F.concat(F.array_join(long, "-"), F.when(more > 0, tail).otherwise(F.lit("")))).otherwise(sur)
    out = F.when(kind == "given", given).otherwise(sur)
    for name, put in (("card", card), ("ip", ip), ("ip6", ip6), ("email", email), ("phone", phone), ("ssn", ssn), ("iban", iban), ("secret", secret)):
        out = F.when(kind == name, put).otherwise(out)
    return out


def mentions(found: DataFrame) -> DataFrame:
    """Distinct mentions (column entity) with kind, prefix, value and the canonical forms that they consist of."""
    e = F.col("entity")
    digits = F.regexp_replace(e, r"\D", "")
    kind = F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind = F.when(e.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(kind)
    bare = F.upper(F.regexp_replace(e, " ", ""))
    kind = F.when((kind == "card") & (luhn_sum(digits) % 10 != 0), None).when((kind == "iban") & (mod97(_turned(bare)) != 1), None).otherwise(kind)
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much to compute: not to be merged into one task
    d = found.select("entity").distinct().repartition(tasks).withColumn("kind", kind).where("kind is not null")
    prefix = F.when(F.col("kind") == "secret", F.regexp_extract("entity", r"(?s)^([^=:]*[=:]\s{0,3}[\"']?)(?=.)", 1)).when(F.col("kind") == "name", F.regexp_extract("entity", rf"^((?:(?:{TITLES})\.? )+)", 1)).otherwise(F.lit(""))
    d = d.withColumn("prefix", prefix).withColumn("value", F.expr("substring(entity, length(prefix) + 1)"))
    value = F.col("value")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    gender = F.when(F.col("prefix").rlike(rf"^(?:{FEMALE})\b"), F.lit("f")).when(F.col("prefix").rlike(rf"^(?:{MALE})\b"), F.lit("m")).otherwise(F.lit("u"))
    code = F.regexp_replace(F.regexp_extract("entity", r"^(\+\d{1,3})(?=\D)", 1), r"\D", "")
    pair = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    one = pair(
        F.when(F.col("kind") == "name", F.lit("surname")).otherwise(F.col("kind")),
        F.when(F.col("kind").isin("card", "ssn"), digits)
        .when(F.col("kind") == "phone", F.concat(code, F.lit(":"), F.expr("substring(regexp_replace(entity, '[^0-9]', ''), length(regexp_replace(regexp_extract(entity, '^([+][0-9]{1,3})(?=[^0-9])', 1), '[^0-9]', '')) + 1)")))
        .when(F.col("kind").isin("email", "ip6"), F.lower("value"))
        .when(F.col("kind") == "iban", bare)
        .when(F.col("kind") == "name", F.concat(script, F.lit(":"), F.lower(F.substring_index("value", " ", -1))))
        .otherwise(value),
    )
    first = F.when((F.col("kind") == "name") & value.contains(" "), pair(F.lit("given"), F.concat(script, F.lit(":"), gender, F.lit(":"), F.lower(F.substring_index("value", " ", 1)))))
    return d.withColumn("main", one).withColumn("first", first)


def surrogates(known: DataFrame, key: str) -> DataFrame:
    """(kind, canon, put) for distinct (kind, canon), without collisions within a kind or with an original."""
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = cut(known.repartition(tasks).withColumn("attempt", F.lit(0)).withColumn("put", _surrogate(key)))
    original = cut(t.select("kind", F.lower(F.when(F.col("kind").isin("given", "surname"), F.substring_index("canon", ":", -1)).otherwise(F.col("canon"))).alias("same")).distinct().withColumn("taken", F.lit(True)))
    while True:  # ends, as what is drawn gets longer
        low = F.lower("put")
        first = t.groupBy("kind", low.alias("same")).agg(F.min("canon").alias("holder"))
        taken = t.withColumn("same", low).join(original, ["kind", "same"], "left").join(first, ["kind", "same"])
        clash = F.coalesce("taken", F.lit(False)) | (F.col("canon") != F.col("holder"))
        marked = cut(taken.select("kind", "canon", "attempt", "put", clash.alias("clash")))
        if marked.where("clash").isEmpty():
            return marked.select("kind", "canon", "put")
        again = marked.where("clash").withColumn("attempt", F.col("attempt") + 1).withColumn("put", _surrogate(key))
        t = cut(marked.where("not clash").unionByName(again).drop("clash"))


def _formatted(value: Column, put: Column) -> Column:
    """put's characters in the places of value's digits and capitals, and after them what is left of put."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        digit = c.rlike("[0-9A-Z]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(put, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda s: F.concat(s["out"], F.substring(put, s["k"], F.length(put))))


def _cased(value: Column, put: Column) -> Column:
    return F.when(value.rlike(r"\p{Lu}") & ~value.rlike(r"\p{Ll}"), F.upper(put)).otherwise(put)


def _like(value: Column, put: Column) -> Column:
    """put with capitals where value has them."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(put)), lambda i: F.when(F.substring(value, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(put, i, F.lit(1)))).otherwise(F.substring(put, i, F.lit(1)))), "")


def replacements(found: DataFrame, key: str) -> DataFrame:
    """(entity, kind, prefix, value, replacement) for distinct mentions."""
    m = cut(mentions(found))
    parts = m.select(F.explode(F.filter(F.array("main", "first"), lambda x: x.isNotNull())).alias("x")).select("x.kind", "x.canon").distinct()
    s = cut(surrogates(parts, key))
    main = s.select(F.struct("kind", "canon").alias("main"), F.col("put").alias("put"))
    first = s.where("kind = 'given'").select(F.struct("kind", "canon").alias("first"), F.col("put").alias("given"))
    value, put = F.col("value"), F.col("put")
    new = (
        F.when(F.col("kind").isin("card", "ssn", "iban"), _formatted(value, put))
        .when(F.col("kind") == "phone", _formatted(value, F.regexp_replace("put", ":", "")))
        .when(F.col("kind").isin("email", "ip6"), _like(value, put))
        .when(F.col("kind") == "name", _cased(value, F.concat_ws(" ", "given", "put")))
        .otherwise(put)
    )
    return m.join(main, "main").join(first, "first", "left").select("entity", "kind", "prefix", "value", F.concat("prefix", new).alias("replacement"))


def _named_again(part: Column, again: Column) -> Column:
    """(text, number) of a piece of text with the names of `again` (old, put) replaced where they stand without a form of address."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}\-])(?:"), F.array_join(F.transform(again, lambda x: x["old"]), "|"), F.lit(r")(?![\p{L}\p{N}]|-\p{L})"))

    def body(x: Column) -> Column:
        names, gaps = F.regexp_extract_all(part, x, F.lit(0)), F.split(part, x, -1)
        put = lambda n: F.get(F.filter(again, lambda y: y["old"] == n), 0)["put"]
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda i: F.concat(F.element_at(gaps, i), F.coalesce(put(F.get(names, i - 1)), F.lit("")))), "")
        return F.struct(text.alias("text"), F.size(names).alias("n"))

    return F.when(F.size(again) > 0, _let(pattern, body)).otherwise(F.struct(part.alias("text"), F.lit(0).alias("n")))


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs, all columns, with entities replaced in text, and the number of replaced mentions in count_col (n_entities_0 and so on where docs has such a column)."""
    need(docs, text_col)
    if count_col.lower() in {c.lower() for c in docs.columns}:
        count_col = fresh(docs, count_col)
    text = F.col(f"`{text_col}`")
    row, have = fresh(docs, "row"), fresh(docs, "have")
    # one search of all texts; the numbers of rows are fixed by the cut
    base = cut(docs.withColumn(have, _search(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))).withColumn(row, F.monotonically_increasing_id()))
    some, none = base.where(F.size(have) > 0), base.where(F.coalesce(F.size(have), F.lit(0)) <= 0)
    occur = some.select(F.col(row).alias("row"), F.posexplode(have).alias("at", "entity"))
    put = cut(replacements(occur, key))
    # old and new names without form of address, whole and by the last name
    bare = F.when(F.col("kind") == "name", F.struct(F.col("value").alias("old"), F.expr("substring(replacement, length(prefix) + 1)").alias("put")))
    last = F.when((F.col("kind") == "name") & F.col("value").contains(" "), F.struct(F.substring_index("value", " ", -1).alias("old"), F.expr("substring(replacement, length(prefix) + length(substring_index(substring(replacement, length(prefix) + 1), ' ', 1)) + 2)").alias("put")))
    names = F.filter(F.array(bare, last), lambda x: x.isNotNull())
    found = occur.join(put.select("entity", "replacement", names.alias("names")), "entity", "left")
    puts = F.sort_array(F.collect_list(F.struct("at", F.coalesce("replacement", "entity").alias("put"), F.col("replacement").isNotNull().alias("is"))))
    longest = lambda x, y: F.when(F.length(x["old"]) != F.length(y["old"]), F.length(y["old"]) - F.length(x["old"])).when(x["old"] < y["old"], -1).when(x["old"] > y["old"], 1).otherwise(F.when(x["put"] < y["put"], -1).when(x["put"] > y["put"], 1).otherwise(0))
    per = cut(found.groupBy("row").agg(puts.alias("puts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("names", F.array().cast("array<struct<old:string,put:string>>"))))), longest).alias("again")))
    parts = F.transform(_search(text, lambda p: F.split(text, p, -1)), lambda x: _named_again(x, F.col("again")))
    done = some.join(per.withColumnRenamed("row", row), row).withColumn("parts", parts)
    new = F.array_join(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(F.element_at("parts", i)["text"], F.coalesce(F.get(F.col("puts"), i - 1)["put"], F.lit("")))), "")
    count = F.size(F.filter("puts", lambda x: x["is"])) + F.aggregate("parts", F.lit(0), lambda a, x: a + x["n"])
    rest = lambda t, n: [F.col(f"`{c}`") if c != text_col else t.alias(text_col) for c in docs.columns] + [n.cast("long").alias(count_col)]
    return none.select(*rest(text, F.lit(0))).unionAll(done.select(*rest(new, count)))
