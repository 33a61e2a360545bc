"""Personal data replaced by surrogates. [native]

Entities are found by pattern and validated (octets, Luhn's sum). Every distinct entity, whatever its mentions look
like, gets one surrogate from a keyed hash, so that coreference holds within and across documents. Surrogates keep
type, length, letter case, script, country code and card type, and a person's gender; the format of each mention
(separators, capitals) is laid over it. A check for collisions then looks for entities of a kind that share a
surrogate and for surrogates that are themselves real entities; these are hashed again, with one more attempt in the
key, until none are left, so distinct entities stay distinct. Later attempts draw from a larger space, longer than the
original, so that this ends however many entities there are.

A person is a name with the gender that titles tell. Titles that tell none, and names without a title in a text where
a title names the person, stand for the gender that this text, else all texts, give the name, if they give one. A
family name has one surrogate by itself and at the end of full names.

Every text is searched once; only documents with a match are shuffled, and the others pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import let, park

KINDS = ("email", "phone", "ip", "ssn", "card", "person")
#: Titles that go before a person's name.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Г-жа", "Κυρία")
NEUTRAL = ("Dr", "Doctor", "Doktor", "Prof", "Professor", "Profesor", "Mx", "Доктор", "Профессор")
#: First names by script and gender, and syllables of family names by script.
NAMES = {
    ("latin", "m"): "Adam Boris Carl Dario Emil Felix Georg Hugo Ivo Jonas Karl Leon Marco Nils Oscar Paul".split(),
    ("latin", "f"): "Anna Bella Clara Diana Elena Flora Greta Helen Irma Julia Karin Laura Maria Nora Olga Petra".split(),
    ("latin", "n"): "Alex Ari Billie Casey Dana Eden Frankie Harper Jamie Kim Lee Morgan Noa Robin Sasha Toni".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Макар Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Ева Зоя Инна Клара Лидия Мария Нина Ольга Полина Рита Софья".split(),
    ("cyrillic", "n"): "Валя Женя Паша Саша Слава Шура Тоня Миша Коля Лёша Витя Гена Дима Ира Лена Маша".split(),
    ("greek", "m"): "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λουκάς Μάριος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φώτης".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δέσποινα Ελένη Ζωή Ηρώ Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ουρανία Ρένα Σοφία Χαρά".split(),
    ("greek", "n"): "Άρη Βίκυ Γιάννα Έφη Ιρις Κλειώ Λία Μάνια Νέλλυ Ντόρα Πόπη Ρία Σίσσυ Τέτα Φαίη Χλόη".split(),
    ("armenian", "m"): "Արամ Արմեն Աշոտ Գագիկ Գարիկ Դավիթ Եղիշե Կարեն Հայկ Միքայել Նարեկ Պետրոս Սամվել Սարգիս Տիգրան Վահե".split(),
    ("armenian", "f"): "Անահիտ Աննա Արփի Գայանե Եվա Լիլիթ Լուսինե Մարիամ Մերի Նազելի Նարե Շուշան Սաթենիկ Սոնա Տաթև Քրիստինե".split(),
    ("armenian", "n"): "Անի Արև Արուս Գոռ Լևոն Կիմ Հրանտ Մանե Նաիրի Նուր Նվեր Ռուբի Սևակ Վարդ Սիրան Արեգ".split(),
}
SYLLABLES = {
    "latin": "ba ce di fo gu ha ke li mo nu pa re si to vu za".split(),
    "cyrillic": "ба ве ги до же зу ка ле ми но пу ра се ти фо ху".split(),
    "greek": "βα γε δι θο κε λα μι νο πα ρε σι το φα χε ζω λυ".split(),
    "armenian": "բա գե դի զո լա մե նի շո պա ռե սի վո տա րե կի մո".split(),
}
#: Attempts with surrogates as long as what they replace, and all attempts.
SHORT, MOST_ATTEMPTS = 6, 60
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with a gap of zeros.
_IP6 = rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
#: Phones without country code: 3-3-4 digits with one kind of separator, or a trunk 0, area code and separated rest.
_NATIONAL = r"(?<![\d.+-])(?:[2-9]\d{2}([ .-])\d{3}\1\d{4}|0[1-9]\d{0,3}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2})(?![.-]?\d)"
_PHONE = r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}"
#: A group of digits, and those that go on after it; none of them begins an address.
_GROUP = r"\d++(?!-(?!\d))"
_MORE = rf"(?:[ -](?!{_IP}){_GROUP})*+"
#: One pattern for all kinds, so that no two matches overlap. Every alternative begins at the start of a run. Those for
#: cards and for phones with a country code take all groups of digits that follow; _cut finds the entities in them.
PATTERN = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    rf"(?<![\w:.]){_IP6}",
    r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)",
    rf"(?<![\d+]){_PHONE}(?!\d){_MORE}",
    rf"(?<![\d.]){_IP}",
    _SSN,
    rf"(?<![\d.-])(?=\d(?:[ -]?\d){{12}}){_GROUP}{_MORE}",
    _NATIONAL,
    rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}}",
))
#: What may be left in a run of digits beside the entities that _cut chooses.
_REST = f"{_SSN}|{_CARD}|{_NATIONAL}"
#: What cards begin with: 3 to 6, or Mastercard's 2221 to 2720.
_ISSUER = r"^(?:[3-6]|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720))"
#: The layouts of cards in use.
_LAYOUT = r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5})$"
#: How many digits follow the country code, where all or nearly all numbers have as many.
NATIONAL = {"1": 10, "7": 10, "27": 9, "31": 9, "33": 9, "34": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "90": 10, "91": 10, "351": 9, "420": 9}
_EXACT = "|".join(rf"{code}\d{{{n}}}" for code, n in NATIONAL.items())
#: What every match holds; texts without it are not searched further.
GATE = rf"[@\d]|::|{_TITLES}"


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a string of digits."""
    doubled = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & digits.rlike(_ISSUER) & (_luhn(digits) % 10 == 0)


def _pieces(text: Column, pattern: Column) -> Column:
    """The text in order as array of (s, hit): what lies between the matches, and the matches."""
    piece = lambda s, hit: F.struct(s.alias("s"), F.lit(hit).alias("hit"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.transform(F.split(text, pattern, -1), lambda gap, i: F.array(piece(gap, False), piece(F.get(found, i), True)))
    return F.filter(F.flatten(both), lambda x: x["s"] != "")


def _cut(raw: Column) -> Column:
    """A match as array of (s, hit): itself, or for a run of groups of digits the entities that begin and end at its
    separators and what lies between them.

    First come cards in a layout in use, then the phone after a "+" that has its country's length, a run that is one
    card whatever its layout, the longest phone after a "+", and cards of groups of three digits or more. Of each the
    leftmost and there the longest, without overlaps. In what is left the patterns for single entities are tried."""
    groups = F.regexp_extract_all(raw, F.lit(r"[ .-]?\+?\d+"), F.lit(0))

    def chosen(groups: Column) -> Column:
        plus, n = F.startswith(raw, F.lit("+")), F.size(groups)
        joined = lambda a, b: F.array_join(F.slice(groups, a, b - a + 1), "")
        window = lambda a, b: F.regexp_replace(joined(a, b), "^[ .-]", "")
        digits = lambda s: F.regexp_replace(s, r"\D", "")
        span = lambda rank, a, b: F.struct(rank.cast("int").alias("rank"), a.cast("int").alias("a"), (a - b).cast("int").alias("less"), b.cast("int").alias("b"))
        none = F.filter(F.array(span(F.lit(0), F.lit(0), F.lit(0))), lambda x: x["rank"] > 0)

        def phone(b: Column) -> Column:
            rank = lambda s: F.when(s.rlike(f"^{_PHONE}$") & F.length(digits(s)).between(7, 15), F.when(digits(s).rlike(f"^(?:{_EXACT})$"), 1).otherwise(3))
            return span(let(window(F.lit(1), b), rank), F.lit(1), b)

        phones = F.when(plus, F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(8))), phone), lambda x: x["rank"].isNotNull()))).otherwise(none)
        # A card in a run after "+" begins after the country code and goes on beyond the phone.
        past = lambda a, b: ~plus | ((a > 1) & (b > F.coalesce(F.get(phones, F.lit(0))["b"], F.lit(0))))
        rank = lambda s: F.when(s.rlike(r"^\d{3,}(?:[ -]\d{3,})*$") & _is_card(digits(s)), F.when(s.rlike(_LAYOUT), 0).otherwise(4))
        cards = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(a, F.least(n, a + 5)), lambda b: span(F.when(past(a, b), let(window(a, b), rank)), a, b))))
        whole = F.array(span(F.when(~plus & _is_card(digits(raw)), F.lit(2)), F.lit(1), n))
        spans = F.array_sort(F.filter(F.concat(phones, cards, whole), lambda x: x["rank"].isNotNull()))
        apart = F.aggregate(spans, none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["a"] <= x["b"]) & (x["a"] <= y["b"])), kept).otherwise(F.concat(kept, F.array(x))))

        def laid(taken: Column) -> Column:
            end = lambda i: F.coalesce(F.get(taken, i)["b"], F.lit(0))
            gap = lambda a, b: _pieces(F.concat(joined(a, b), F.coalesce(F.regexp_extract(F.get(groups, b), "^[ .-]", 0), F.lit(""))), F.lit(_REST))
            hit = lambda x: F.array(F.struct(window(x["a"], x["b"]).alias("s"), F.lit(True).alias("hit")))
            return F.concat(F.flatten(F.transform(taken, lambda x, i: F.concat(gap(end(i - 1) + 1, x["a"] - 1), hit(x)))), gap(end(F.size(taken) - 1) + 1, n))

        return let(F.array_sort(F.transform(apart, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))), laid)

    run = raw.rlike(r"^(?:\d(?:[ -]?\d){12,}|\+[\d .-]+)$")
    return F.when(run, let(groups, chosen)).otherwise(F.array(F.struct(raw.alias("s"), F.lit(True).alias("hit"))))


def _kind(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    card = _is_card(digits)
    groups = F.regexp_count(raw, F.lit("[0-9A-Fa-f]+"))
    return (
        F.when(F.contains(raw, F.lit("@")), "email")
        .when(F.contains(raw, F.lit("::")), F.when(groups.between(3, 7), "ip"))
        .when(F.contains(raw, F.lit(":")), "ip")
        .when(raw.rlike(r"\p{L}"), "person")
        .when(raw.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(raw.rlike(r"[+(]") & F.length(digits).between(7, 15), "phone")
        .when(~raw.rlike(r"[+(]") & card, "card")
        .when(raw.rlike(f"^{_NATIONAL}$") & F.length(digits).between(8, 12), "phone")
    )


def _name(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", "")


def _halves(address: Column) -> tuple[Column, Column]:
    """The groups of an IPv6 address before and after its gap."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    gap = F.contains(address, F.lit("::"))
    return groups(F.substring_index(address, "::", 1)), F.when(gap, groups(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))


def _eight(address: Column) -> Column:
    """An IPv6 address as eight groups in lower case, without leading zeros."""
    head, tail = _halves(F.lower(address))
    all_ = F.concat(head, F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail)), tail)
    return F.array_join(F.transform(all_, lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0"))), ":")


def _canon(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common. A person's begins with the gender that the title tells; a family
    name alone has none."""
    title = lambda names: raw.rlike(rf"^(?:{'|'.join(names)})\.? ")
    alone = ~_name(raw).rlike("[ -]")
    gender = F.when(alone, "n").when(title(FEMALE), "f").when(title(MALE), "m").otherwise("n")
    address = F.when(F.contains(raw, F.lit(":")), _eight(raw)).otherwise(raw)
    return F.when(kind == "email", F.lower(raw)).when(kind == "ip", address).when(kind == "person", F.concat(gender, F.lit(":"), F.lower(_name(raw)))).otherwise(F.regexp_replace(raw, r"\D", ""))


def _with_names(pieces: Column) -> Column:
    """pieces with the mentions that have no title: the names that titles introduce anywhere in the text, and their
    family names, wherever they stand as words."""
    titled = F.filter(pieces, lambda p: p["hit"] & p["s"].rlike(rf"^(?:{_TITLES})\.? "))
    full = F.transform(titled, lambda p: _name(p["s"]))

    def searched(names: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(names, lambda a, b: F.length(b) - F.length(a)), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        return F.flatten(F.transform(pieces, lambda p: F.when(p["hit"], F.array(p)).otherwise(_pieces(p["s"], pattern))))

    names = F.array_distinct(F.concat(full, F.transform(full, lambda n: F.regexp_extract(n, r"[^ -]+$", 0))))
    return F.when(F.size(titled) > 0, let(names, searched)).otherwise(pieces)


def _resolved(each: DataFrame) -> DataFrame:
    """each (row, i, kind, raw, canon) with the gender of full names whose mention tells none: that of the same name
    in the same text, else in all texts, where it is one only."""
    name, gender = F.substring_index("canon", ":", -1), F.substring("canon", 1, 1)
    told = each.filter((F.col("kind") == "person") & (gender != "n"))
    one = lambda rows: rows.agg(F.min("_g").alias("g"), F.max("_g").alias("h")).filter("g = h").drop("h")
    told = told.select("row", name.alias("_name"), gender.alias("_g")).distinct()
    here = one(told.groupBy("row", "_name")).select(F.col("row").alias("_row"), F.col("_name").alias("_here"), F.col("g").alias("_g1"))
    any_ = one(told.groupBy("_name")).select(F.col("_name").alias("_any"), F.col("g").alias("_g2"))
    open_ = F.when((F.col("kind") == "person") & (gender == "n"), name)
    both = each.withColumn("_open", open_).join(here, (F.col("row") == F.col("_row")) & (F.col("_open") == F.col("_here")), "left").join(any_, F.col("_open") == F.col("_any"), "left")
    found = F.coalesce("_g1", "_g2")
    return both.withColumn("canon", F.when(found.isNotNull(), F.concat(found, F.lit(":"), F.col("_open"))).otherwise(F.col("canon"))).select(each.columns)


def _digits(seed: Column) -> Column:
    """128 digits from a hash."""
    return F.translate(F.sha2(seed, 512), "abcdef", "012345")


def _number(seed: Column, at: int, most: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1 + 6 * at, 6), 16, 10).cast("int"), F.lit(most))


def _shaped(text: Column, seed: Column) -> Column:
    """Every ASCII letter and digit replaced by one of its kind."""
    figures = _digits(seed)
    letters = F.translate(F.sha2(F.concat(seed, F.lit("/")), 512), "0123456789", "ghijklmnop")

    def put(c: Column, i: Column) -> Column:
        at = (i % 128 + 1).cast("int")
        return F.when(c.rlike("[0-9]"), F.substring(figures, at, F.lit(1))).when(c.rlike("[a-z]"), F.substring(letters, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(text), put), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity, before it takes a mention's format."""
    seed = F.concat(F.lit(key), F.lit("|"), kind, F.lit("|"), canon, F.lit("|"), attempt.cast("string"))
    figures = _digits(seed)
    again = F.when(attempt == 0, "").otherwise(attempt.cast("string"))
    longer = F.substring(F.reverse(figures), F.lit(1), F.greatest(attempt - SHORT + 1, F.lit(0)))
    user, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)
    # The domain's surrogate depends on the domain alone: mailboxes of one host stay on one host.
    email = F.concat(_shaped(user, seed), again, F.lit("@"), _shaped(labels, F.concat(F.lit(key), F.lit("|domain|"), labels)), F.lit("."), ending)
    size = F.length(canon)
    # A trunk 0 stays like a country code.
    code = F.greatest(F.startswith(canon, F.lit("0")).cast("int"), size - 10)
    phone = F.concat(F.substring(canon, F.lit(1), code), F.substring(F.concat(F.lit("2"), figures), F.lit(1), size - code), longer)
    nibbles = lambda i: F.conv(F.substring(F.sha2(seed, 512), (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
    group = lambda i: F.lower(F.hex(F.pmod(nibbles(i), F.lit(65535)) + 1))
    ip6 = F.array_join(F.transform(F.split(canon, ":"), lambda g, i: F.when(g == "0", g).otherwise(group(i))), ":")
    wide6 = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), group), ":"))
    ip4 = F.concat_ws(".", (_number(seed, 0, 222) + 1).cast("string"), *[_number(seed, k, 256).cast("string") for k in (1, 2)], (_number(seed, 3, 254) + 1).cast("string"))
    ip = F.when(F.contains(canon, F.lit(":")), ip6).when(attempt < SHORT, ip4).otherwise(wide6)
    ssn = F.concat(F.lit("9"), F.substring(figures, 1, 8), longer)
    # After a 2, the second figure is one that all of Mastercard's numbers may have.
    second = F.when(F.startswith(canon, F.lit("2")), F.translate(F.substring(figures, 1, 1), "0123456789", "3456345634")).otherwise(F.substring(figures, 1, 1))
    open_card = F.concat(F.substring(canon, 1, 1), second, F.substring(figures, F.lit(2), size - 3), longer)
    card = let(open_card, lambda c: F.concat(c, F.pmod(10 - _luhn(F.concat(c, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    words = F.split(F.substring_index(canon, ":", -1), "[ -]")
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").when(canon.rlike(r"\p{IsArmenian}"), "armenian").otherwise("latin")
    family = F.concat(F.lit(key), F.lit("|family|"), F.get(words, F.size(words) - 1))

    def pick(pool: list[str], at: Column) -> Column:
        return F.get(F.array(*[F.lit(x) for x in pool]), at)

    def person(name: str) -> Column:
        byte = lambda k: F.pmod(F.conv(F.substring(F.sha2(seed, 512), 1 + 2 * k, 2), 16, 10).cast("int"), F.lit(16))
        gender = F.substring(canon, 1, 1)
        first = lambda k: F.when(gender == "f", pick(NAMES[name, "f"], byte(k))).when(gender == "m", pick(NAMES[name, "m"], byte(k))).otherwise(pick(NAMES[name, "n"], byte(k)))
        more = lambda make: F.transform(F.filter(F.sequence(F.lit(0), attempt), lambda j: j > 0), make)
        # Later attempts add given names to a full name, and syllables to a family name alone.
        given = F.concat(F.when(F.size(words) > 1, F.array(first(0))).otherwise(F.array().cast("array<string>")), F.when(F.size(words) > 2, F.array(first(1))).otherwise(F.array().cast("array<string>")), F.when(F.size(words) > 1, more(lambda j: first(j + 1))).otherwise(F.array().cast("array<string>")))
        syllable = lambda j: pick(SYLLABLES[name], F.pmod(F.xxhash64(family, j), F.lit(16)).cast("int"))
        last = F.concat(*[syllable(F.lit(k)) for k in range(-6, 0)], F.when(F.size(words) == 1, F.array_join(more(syllable), "")).otherwise(""))
        return F.lower(F.concat_ws(" ", given, last))

    written = F.when(script == "cyrillic", person("cyrillic")).when(script == "greek", person("greek")).when(script == "armenian", person("armenian")).otherwise(person("latin"))
    named = F.concat(F.substring(canon, 1, 2), written)
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "person", named)


def _render(kind: Column, raw: Column, sur: Column) -> Column:
    """The surrogate in the format of a mention."""
    zero = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct((a["k"] + 1).alias("k"), F.concat(a["out"], F.substring(sur, a["k"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["out"], c).alias("out")))
    laid = F.aggregate(_chars(raw), zero, step, lambda a: F.concat(a["out"], F.substring(sur, a["k"] + 1, F.length(sur))))
    groups, (head, tail) = F.split(sur, ":"), _halves(raw)
    gap = F.concat(F.array_join(F.slice(groups, F.lit(1), F.size(head)), ":"), F.lit("::"), F.array_join(F.slice(groups, 9 - F.size(tail), F.size(tail)), ":"))
    address = let(F.when(F.contains(raw, F.lit("::")), gap).otherwise(sur), lambda a: F.when(raw == F.upper(raw), F.upper(a)).otherwise(a))
    name, title = _name(raw), F.regexp_extract(raw, rf"^(?:{_TITLES})\.? ", 0)
    plain = F.substring_index(sur, ":", -1)
    person = F.concat(title, F.when(name == F.upper(name), F.upper(plain)).otherwise(F.initcap(plain)))
    email = F.when(raw == F.upper(raw), F.upper(sur)).otherwise(sur)
    return F.when(kind == "email", email).when(kind == "person", person).when(kind == "ip", address).otherwise(laid)


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sur): distinct entities with surrogates that no two of a kind share and none of them bears."""
    rate = lambda df: df.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
    found = park(rate(mentions.groupBy("kind", "canon").agg(F.lit(0).alias("attempt"))), "entities")
    real = found.select("kind", F.col("canon").alias("sur"))
    for _ in range(MOST_ATTEMPTS):
        first = found.groupBy("kind", "sur").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1")
        shared = found.join(first, ["kind", "sur"]).filter("canon <> first").select("kind", "canon")
        again = park(shared.unionByName(found.join(real, ["kind", "sur"], "left_semi").select("kind", "canon")).distinct(), "clashes")
        if again.isEmpty():
            return found.select("kind", "canon", "sur")
        moved = found.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        found = park(found.join(again, ["kind", "canon"], "left_anti").unionByName(rate(moved.drop("sur"))), "entities")
    raise RuntimeError(f"entities share surrogates after {MOST_ATTEMPTS} attempts")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text with surrogates, n_entities, and n_<kind> for each of KINDS.

    Equal keys give equal surrogates as long as the same entities clash, and different keys unrelated ones. Null
    and empty texts stay as they are. Numbers that fail their check (octets, Luhn's sum, an issuer's first digits) are left alone,
    and so are phones without "+" or parentheses unless they are separated as 3-3-4 digits or after a trunk 0 and area
    code. With and without its country code a phone is two entities. A card or phone
    is found beside other groups of digits (see _cut), but a phone whose country is not in NATIONAL takes the groups
    that follow it, up to 15 digits. People are found by a title; without one, a name is found in texts that give it with
    one, in the same capitals. Rows that repeat count each. Only id and text are read; an empty table gives no
    rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    raws = F.when(F.col("text").rlike(GATE), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    split = slim.withColumn("raws", raws)
    hit = F.coalesce(F.size("raws"), F.lit(0)) > 0
    between = lambda gap, i: F.concat(F.array(F.struct(gap.alias("s"), F.lit(False).alias("hit"))), F.coalesce(let(F.get(F.col("raws"), i), lambda raw: F.when(raw.isNotNull(), _cut(raw))), F.array()))
    pieces = let(F.flatten(F.transform(F.split("text", PATTERN, -1), between)), _with_names)
    # Searched once: a row holds the pieces of a text with a match, else the text.
    found = split.select("id", F.when(~hit, F.col("text")).alias("text"), F.when(hit, pieces).alias("pieces"))
    found = park(found.withColumn("row", F.monotonically_increasing_id()), "searched")
    hits = found.filter("pieces is not null").select("row", "id", "pieces")
    each = hits.select("row", F.posexplode("pieces").alias("i", "piece")).filter("piece.hit").select("row", "i", F.col("piece.s").alias("raw")).withColumn("kind", _kind(F.col("raw"))).filter("kind is not null")
    each = park(each.withColumn("canon", _canon(F.col("kind"), F.col("raw"))), "found")
    each = park(_resolved(each), "mentions")
    known = park(entities(each, key), "surrogates")
    shown = each.join(known, ["kind", "canon"]).select("row", "i", "kind", _render(F.col("kind"), F.col("raw"), F.col("sur")).alias("new"))
    by_row = shown.groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("i", "new"))).alias("new"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    by_row = park(by_row, "replaced")
    joined = hits.join(by_row, F.col("row") == F.col("_row"), "left")
    pieces = F.transform(F.col("pieces"), lambda x, i: F.coalesce(F.try_element_at(F.col("new"), i), x["s"]))
    zero = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}")
    changed = joined.select("id", F.array_join(pieces, "").alias("text"), *[zero(k) for k in KINDS])
    same = found.filter("pieces is null").select("id", "text", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    both = same.unionByName(changed)
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
    return both.select(F.col("id").alias(id_col), "text", total.alias("n_entities"), *[f"n_{k}" for k in KINDS])
