"""Personal data: detected entities give way to keyed, type-consistent surrogates. DataFrame functions only.

Mentions are found by one pattern in one pass. A mention consists of units (a name has one for each word, any
other mention is one unit). Every distinct unit of the corpus gets a surrogate derived from a keyed hash in
its own format: letters stay letters of their script and case, digits digits, cards keep their issuer
digit and check sum, account numbers their country and check digits, addresses stay valid, names keep gender and
script. One unit has one surrogate wherever it stands (coreference); a surrogate that another unit has
already, or that occurs as a real unit, is drawn anew, from a space that grows with the attempts, until
none is left (distinctness).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

MALE_TITLES = ("Mr", "Herr", "Señor", "Monsieur", "Mister", "Sir", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "госпожа")
OPEN_TITLES = ("Dr", "Prof", "Professor", "Doctor", "Doktor")
#: Given names that tell the gender where no title does.
MALE_NAMES = tuple(
    "james john robert michael william david thomas peter paul bob bill jim mike steve george charles daniel matthew anthony mark andrew joshua "
    "kevin brian edward henry frank jack jean pierre jacques michel louis antoine hans klaus jürgen wolfgang stefan heinrich josé carlos miguel juan luis javier "
    "pedro antonio иван пётр сергей дмитрий александр алексей андрей николай".split()
)
FEMALE_NAMES = tuple(
    "mary patricia jennifer linda elizabeth susan sarah karen alice emily emma jane laura rachel jessica nancy margaret lisa betty helen julia anna "
    "catherine barbara diana rebecca marie sophie claire isabelle camille nathalie ursula sabine monika petra heike greta maría carmen lucía ana isabel "
    "elena rosa анна мария ольга елена наталья татьяна ирина светлана екатерина".split()
)


def one_of(words: tuple[str, ...]) -> str:
    """A pattern of these words that tells them apart letter by letter, the longest first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + (one_of(tuple(rest)) if rest != [""] else "") for h, rest in heads.items() if h]
    if len(parts) == 1 and "" not in heads:
        return parts[0]
    return "(?:" + "|".join(parts) + ")" + ("?+" if "" in heads else "")


_TITLE = one_of(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES) + r"(?!\p{L})\.?"
_GIVEN = one_of(tuple(dict.fromkeys(n.capitalize() for n in MALE_NAMES + FEMALE_NAMES))) + r"(?!\p{L})"
_CAPITAL = r"\p{Lu}[\p{L}'’-]{1,40}"

#: Lookbehinds that only hold inside a text.
_AFTER_DIGIT = r"(?<=\d[ .-])"
_AFTER_WORD = r"(?<=(?i:phone|mobile|whatsapp|call|cell|tel|fax|sms)[.:]?\s)"
_PHONES = (
    rf"(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\) ?|{_AFTER_DIGIT}\d{{2,4}}[ .-]|\d{{3}}[.-])\d{{3,4}}[ .-]\d{{3,4}}",
    r"\+(?:[ .()/-]{0,2}+\d){7,15}+",  # international, grouped in any way or not at all
    r"(?<!\d[ .,-])(?:\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{4}|0\d(?:[ .-]\d{2}){4})(?! \d)",
    r"(?<!\d[ .,-])0\d{1,4}[ /-]\d{5,8}",
    rf"{_AFTER_WORD}(?:\d{{3}}[ -]\d{{4}}|\d{{10}})(?![ -]\d)",  # short or of bare digits
)

#: Possessive or bounded, so that no text makes it backtrack far. All but secrets begin where a word does.
KINDS: dict[str, str] = {
    "secret": r"(?<=[=:\s'\"])(?=[A-Za-z0-9+/_.~=%$-]{16})(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)['\"]?\s{0,3}[=:]\s{0,3}['\"]?)(?=[A-Za-z0-9+/_.~=%$-]{0,64}?[A-Za-z0-9+/_-]{16})[A-Za-z0-9+/_-]++(?:[.~=%$]{1,3}+[A-Za-z0-9+/_-]++)*+",
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}+",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{N}]|\.\d)",
    "ip6": r"(?<!:)(?=[A-Fa-f:]{0,30}+[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "phone": rf"(?:{'|'.join(_PHONES)})(?![\p{{N}}])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\p{N}\p{L}])",
    "name": rf"(?:{_TITLE} {_CAPITAL}(?: {_CAPITAL}){{0,2}}|{_GIVEN} {_CAPITAL}(?: {_CAPITAL})?)",
}
#: Its only group holds what stands behind a secret's keyword.
PATTERN = f"({KINDS['secret']})|(?<![\\p{{L}}\\p{{N}}])(?:" + "|".join(p for k, p in KINDS.items() if k != "secret") + ")"

_LATIN_SYLLABLES = ("ba", "be", "da", "do", "fa", "ga", "ha", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "pa", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "va", "vi", "wa", "zo")
_CYRILLIC_SYLLABLES = ("ба", "бе", "ва", "ви", "га", "да", "до", "жи", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "но", "па", "ра", "ре", "ро", "са", "се", "та", "те", "фа", "ха", "зо")


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: tuple[str, ...]) -> str:
    return "array(" + ",".join(_sql(w) for w in words) + ")"


#: Marks around a mention and behind what its secret group holds; they are no characters of any text.
_MARKS = "\ufdd0", "\ufdd1", "\ufdd2"
_ANY_MARK = f"[{''.join(_MARKS)}]"


def pieces(text: Column) -> Column:
    """The text before a mention, the mention, and the mention again if it stands behind a secret's keyword (else nothing), in
    turn; last the text behind all mentions. A text that holds a mark itself is cut in several passes instead of one."""
    marked = F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{_MARKS[0]}$0{_MARKS[1]}$1{_MARKS[2]}"))
    rest = F.split(text, PATTERN, -1)
    found, secret = (F.regexp_extract_all(text, F.lit(PATTERN), F.lit(k)) for k in (0, 1))
    between = F.transform(rest, lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i), F.coalesce(F.get(secret, i), F.lit("")))).otherwise(F.array(x)))
    return F.when(text.rlike(_ANY_MARK), F.flatten(between)).otherwise(F.split(marked, _ANY_MARK, -1))


def mentions(cut: Column) -> Column:
    """(mention, whether behind a keyword) in order, from :func:`pieces`."""
    n = ((F.size(cut) - 1) / 3).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(cut, 3 * i + 1).alias("mention"), (F.get(cut, 3 * i + 1) == F.get(cut, 3 * i + 2)).alias("behind")))


def _kind(m: Column) -> Column:
    """The first kind whose pattern is the whole mention; a secret is what is no other kind."""
    c = F.when(m.contains("@"), "email")
    for k in ("ip", "ip6", "ssn", "phone", "card", "iban", "name"):
        whole = KINDS[k].replace(_AFTER_DIGIT, "").replace(_AFTER_WORD, "")
        c = c.when(m.rlike(f"^(?:{whole})$"), k)
    return c.otherwise("secret")


def _digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '')"


def luhn_sum(digits: str) -> str:
    """SQL for the sum of a card number's digits with every second one from the right, the last one aside, doubled."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) "
        f"WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (a, x) -> a + x)"
    )


def remainder_97(account: str) -> str:
    """SQL for the remainder by 97 of an account number whose letters count as 10 to 35."""
    return f"aggregate(split({account}, ''), 0, (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN (a * 10 + int(c)) % 97 WHEN c RLIKE '[A-Z]' THEN (a * 100 + ascii(c) - 55) % 97 ELSE a END)"


#: Issuers' leading digits.
_ISSUER = "^(?:4|5[1-5]|2[2-7]|3[47]|35|36|30|6011|64|65)"


def _units(found: DataFrame) -> DataFrame:
    """mention, behind, at, raw, kind, canon: the units of distinct mentions that are personal data."""
    m = F.col("mention")
    card = F.expr(f"{_digits('mention')} RLIKE '{_ISSUER}' AND {luhn_sum(_digits('mention'))} % 10 = 0")
    kinds = found.select("mention", "behind", _kind(m).alias("kind"))
    # a number that is no card is a secret behind the keyword of one, and else nothing
    kinds = kinds.withColumn("kind", F.when((F.col("kind") != "card") | card, F.col("kind")).when(F.col("behind"), "secret")).where("kind IS NOT NULL")
    single = kinds.where("kind <> 'name'").select(
        "mention",
        "behind",
        F.lit(0).alias("at"),
        m.alias("raw"),
        "kind",
        F.expr(
            f"""CASE kind WHEN 'email' THEN lower(mention) WHEN 'phone' THEN right({_digits("mention")}, 10)
                WHEN 'card' THEN {_digits("mention")} WHEN 'ssn' THEN {_digits("mention")} WHEN 'iban' THEN replace(mention, ' ', '') WHEN 'ip6' THEN lower(mention) ELSE mention END"""
        ).alias("canon"),
    )
    title = F.regexp_extract(m, rf"^(?:{_TITLE})", 0)
    plain = F.regexp_replace(title, r"\.$", "")
    names = kinds.where("kind = 'name'").withColumns({"titled": F.length(title) > 0, "title": plain, "words": F.split(F.trim(F.regexp_replace("mention", rf"^(?:{_TITLE}) ", "")), " ")})
    words = names.select("mention", "behind", "title", "words", F.posexplode("words").alias("at", "raw"))
    first = F.lower(F.col("words")[0])
    gender = (
        F.when(F.col("title").isin(*MALE_TITLES), "m")
        .when(F.col("title").isin(*FEMALE_TITLES), "f")
        .when(first.isin(*MALE_NAMES), "m")
        .when(first.isin(*FEMALE_NAMES), "f")
        .otherwise("n")
    )
    is_given = (F.col("at") < F.size("words") - 1) & (F.size("words") > 1)
    cyrillic = F.col("raw").rlike(r"\p{IsCyrillic}")
    # Cyrillic surnames end by gender; elsewhere a surname is one unit for all genders
    named = words.select("mention", "behind", "at", "raw", F.when(is_given, F.concat(F.lit("given_"), gender)).when(cyrillic, F.concat(F.lit("surname_"), gender)).otherwise("surname").alias("kind"), F.lower("raw").alias("canon"))
    return single.unionByName(named)


def _surrogate(key: str) -> Column:
    """The candidate of the columns kind, canon and attempt."""
    seed = f"sha2(concat_ws('|', {_sql(key)}, kind, canon, string(attempt)), 256)"
    r = lambda i, n: f"int(pmod(xxhash64(seed, {i}), {n}))"
    by_char = (
        "array_join(transform(split({text}, ''), (c, i) -> CASE "
        f"WHEN c RLIKE '[0-9]' THEN string({r('i', 10)}) "
        f"WHEN c RLIKE '[a-z]' THEN char(97 + {r('i', 26)}) WHEN c RLIKE '[A-Z]' THEN char(65 + {r('i', 26)}) "
        f"WHEN c RLIKE '[а-яё]' THEN substr('абвгдежзийклмнопрстуфхцчшщыэюя', 1 + {r('i', 30)}, 1) "
        f"WHEN c RLIKE '[А-ЯЁ]' THEN substr('АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ', 1 + {r('i', 30)}, 1) "
        f"WHEN c RLIKE '[α-ω]' THEN substr('αβγδεζηθικλμνξοπρστυφχψω', 1 + {r('i', 24)}, 1) "
        f"WHEN c RLIKE '\\\\p{{{{IsHan}}}}' THEN substr('安白陈丁方高何江李林马宁石王文吴许杨叶张', 1 + {r('i', 20)}, 1) "
        f"WHEN c RLIKE '\\\\p{{{{Lu}}}}' THEN char(65 + {r('i', 26)}) WHEN c RLIKE '\\\\p{{{{L}}}}' THEN char(97 + {r('i', 26)}) ELSE c END), '')"
    )
    hexed = lambda digits: f"array_join(transform(split(canon, ''), (c, i) -> substr('{digits}', 1 + {r('i', 16)}, 1)), '')"
    # further attempts leave the octets' lengths
    octets = f"array_join(transform(split(canon, '[.]'), (c, i) -> string(CASE WHEN attempt >= 4 THEN 1 + {r('i', 254)} WHEN length(c) = 1 THEN 1 + {r('i', 9)} WHEN length(c) = 2 THEN 10 + {r('i', 90)} ELSE 100 + {r('i', 156)} END)), '.')"
    body = f"concat(left(canon, 1), array_join(transform(sequence(1, length(canon) - 2), i -> string({r('i', 10)})), ''))"
    card = f"concat({body}, string(pmod(10 - {luhn_sum(f'concat({body}, {_sql(chr(48))})')} % 10, 10)))"
    domain = "substring_index(canon, '@', -1)"
    # further attempts have a longer local part
    longer = f"CASE WHEN attempt >= 4 THEN array_join(transform(sequence(1, attempt div 4), i -> char(97 + {r('1000 + i', 26)})), '') ELSE '' END"
    email = f"concat({by_char.format(text='substring_index(canon, ' + _sql('@') + ', 1)')}, {longer}, '@', regexp_replace({by_char.format(text=domain)}, '[^.]*$', ''), substring_index({domain}, '.', -1))"

    def name(kind: str) -> str:
        lat = {"given_m": ("o", "en", "ard"), "given_f": ("a", "ina", "elle"), "given_n": ("is", "in", "y"), "surname": ("son", "berg", "ez", "ani", "ton", "mann")}.get(kind, ("ov",))
        cyr = {"given_m": ("н", "р", "й"), "given_f": ("на", "ра", "я"), "given_n": ("ль",), "surname_m": ("ов", "ин"), "surname_f": ("ова", "ина")}.get(kind, ("енко", "юк"))

        def made(syllables: tuple[str, ...], ends: tuple[str, ...]) -> str:
            # each further attempt can be longer, so that the space never runs out
            parts = f"transform(sequence(1, 3 + attempt div 8), i -> element_at({_array(syllables)}, 1 + {r('i', len(syllables))}))"
            return f"concat(array_join({parts}, ''), element_at({_array(ends)}, 1 + {r('0', len(ends))}))"

        return f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {made(_CYRILLIC_SYLLABLES, cyr)} ELSE {made(_LATIN_SYLLABLES, lat)} END"

    names = " ".join(f"WHEN '{k}' THEN {name(k)}" for k in ("given_m", "given_f", "given_n", "surname", "surname_m", "surname_f", "surname_n"))
    plain = by_char.format(text="canon")
    # further attempts of a short unit whose format has no free place left get a longer surrogate
    more = f"CASE WHEN attempt >= 8 THEN array_join(transform(sequence(1, attempt div 8), i -> string({r('2000 + i', 10)})), '') ELSE '' END"
    grown = f"concat({plain}, {more})"
    # no area 000, 666 or above 899, no group 00, no serial 0000
    area = f"1 + {r('1', 898)}"
    ssn = f"CASE WHEN length(canon) = 9 THEN concat(lpad(string({area} + CASE WHEN {area} >= 666 THEN 1 ELSE 0 END), 3, '0'), lpad(string(1 + {r('2', 99)}), 2, '0'), lpad(string(1 + {r('3', 9999)}), 4, '0')) ELSE {grown} END"
    phone = f"concat(CASE WHEN canon LIKE '0%' THEN '0' ELSE string(2 + {r('0', 8)}) END, substr({plain}, 2), {more})"
    account = by_char.format(text="substr(canon, 5)")
    hex6 = f"concat(array_join(transform(split(canon, ''), (c, i) -> CASE WHEN c = ':' THEN c ELSE substr('123456789abcdef', 1 + {r('i', 15)}, 1) END), ''), CASE WHEN attempt >= 8 AND canon LIKE '%::%' THEN ':1' ELSE '' END)"
    secret = f"CASE WHEN canon RLIKE '^[0-9]*[a-f][0-9a-f]*$' THEN {hexed('0123456789abcdef')} WHEN canon RLIKE '^[0-9]*[A-F][0-9A-F]*$' THEN {hexed('0123456789ABCDEF')} ELSE {grown} END"
    iban = f"element_at(transform(array(concat({account}, {more})), a -> concat(left(canon, 2), lpad(string(98 - {remainder_97('concat(a, left(canon, 2), ' + _sql('00') + ')')}), 2, '0'), a)), 1)"
    one = f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN {octets} WHEN 'ip6' THEN {hex6} WHEN 'card' THEN {card} WHEN 'ssn' THEN {ssn} WHEN 'phone' THEN {phone} WHEN 'iban' THEN {iban} WHEN 'secret' THEN {secret} {names} ELSE {grown} END"
    # the seed is made once for a unit, not for each character: a secret may be long
    return F.expr(f"element_at(transform(array({seed}), seed -> {one}), 1)")


#: Units up to which those that are drawn anew go to all tasks (about 100 bytes each).
AGAIN_ROWS = 100_000


def distinct_surrogates(units: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate of each distinct unit: no two alike within a kind, none equal to a real unit of it.

    A round only handles the units that collided in the one before. Each further attempt of a kind draws from a larger
    space (longer names, local parts, digits), so the rounds end however many units there are.
    """
    real = base.stored(units.select("kind", "canon").distinct())
    used = real.select("kind", F.col("canon").alias("surrogate"))
    pending = real.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    while True:
        drawn = base.stored(pending.withColumn("surrogate", _surrogate(key)))
        wanted = drawn.select("kind", "surrogate").distinct()
        taken = used.join(base.bounded_broadcast(wanted, AGAIN_ROWS), ["kind", "surrogate"], "left_semi").withColumn("taken", F.lit(True))
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        marked = drawn.withColumn("place", place).join(taken.distinct(), ["kind", "surrogate"], "left")
        marked = base.stored(marked.select("kind", "canon", "attempt", "surrogate", ((F.col("place") > 1) | F.col("taken").isNotNull()).alias("again")))
        good = marked.where("NOT again").select("kind", "canon", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        used = used.unionByName(good.select("kind", "surrogate"))
        pending = marked.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled


def _rendered() -> Column:
    """The surrogate in the written form of the unit ``raw``."""
    before = "length(regexp_replace(left(raw, i), '[^0-9]', ''))"
    shift = f"(length({_digits('raw')}) - length(canon))"
    # digits are filled in from the right, so a country code that is no part of the unit stays; those of a grown surrogate follow
    filled = f"concat(array_join(transform(split(raw, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' AND {before} >= {shift} THEN substr(surrogate, {before} - {shift} + 1, 1) ELSE c END), ''), substr(surrogate, length(canon) + 1))"
    spaced = "CASE WHEN contains(raw, ' ') THEN trim(regexp_replace(surrogate, '(.{4})', '$1 ')) ELSE surrogate END"
    cased = "CASE WHEN raw = upper(raw) AND raw <> lower(raw) AND length(raw) > 1 THEN upper(surrogate) WHEN kind LIKE '%name%' OR kind LIKE 'given%' THEN initcap(surrogate) ELSE surrogate END"
    return F.expr(f"CASE WHEN kind IN ('phone', 'card', 'ssn') THEN {filled} WHEN kind = 'iban' THEN {spaced} WHEN kind IN ('ip', 'secret') THEN surrogate ELSE {cased} END")


#: Mentions up to which their surrogates are broadcast (about 150 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: The setting that holds the key of the surrogates.
KEY_SETTING = "spark.tidemill.surrogateKey"


def session_key(spark: SparkSession) -> str:
    """The surrogates' key from the session; without one, a published key that only suits tests and public texts."""
    return spark.conf.get(KEY_SETTING, None) or "tidemill-surrogates"


def replace_personal_data(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """``docs`` with all columns, each mention in ``text`` replaced, and the number replaced as ``n_entities``.

    The pattern runs once over every text; the rows are stored with what it found. A null text stays null. Texts without personal
    data stay as they are and are not shuffled. Repeated rows stay repeated and get the same text; ids are not used. An own column of the name
    ``n_entities`` is replaced, all others stay whatever they are called. Without rows or mentions the result has the rows as they were.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    own = functools.partial(base.free_name, docs.columns)
    cut, mark, filled = own("cut"), own("mark"), own("filled")
    found = docs.select(*(docs[c] for c in columns)).withColumn(cut, pieces(F.col(text)))
    held = base.stored(found.withColumn(cut, F.when(F.size(cut) > 1, F.col(cut))))
    bearing = held.where(F.col(cut).isNotNull())

    listed = base.stored(bearing.select(F.sha2(text, 256).alias("text_key"), mentions(F.col(cut)).alias("found")).dropDuplicates(["text_key"]))
    distinct = listed.select(F.inline("found")).distinct()
    units = base.stored(_units(distinct))
    solved = units.join(distinct_surrogates(units, key), ["kind", "canon"]).withColumn("shown", _rendered())
    parts = solved.groupBy("mention", "behind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), " ").alias("shown"), F.first("kind").alias("kind"))
    titled = F.when(F.col("kind").rlike("name|given"), F.concat(F.regexp_extract("mention", rf"^(?:{_TITLE} )?", 0), "shown")).otherwise(F.col("shown"))
    solved = base.stored(parts.select("mention", "behind", titled.alias("shown")))

    each = listed.select("text_key", F.posexplode("found").alias("at", "m")).select("text_key", "at", "m.*")
    joined = each.join(base.bounded_broadcast(solved, BROADCAST_ROWS), ["mention", "behind"], "left")
    one = F.struct("at", F.coalesce("shown", "mention").alias("s"), F.col("shown").isNotNull().alias("hit"))
    answers = joined.groupBy("text_key").agg(F.array_sort(F.collect_list(one)).alias(filled)).select(F.col("text_key").alias(mark), filled)

    # every third piece is plain text
    plain = F.filter(F.col(cut), lambda _, i: i % 3 == 0)
    whole = F.array_join(F.zip_with(plain, F.col(filled), lambda a, b: F.concat(a, F.coalesce(b["s"], F.lit("")))), "")
    count = F.size(F.filter(filled, lambda x: x["hit"]))
    changed = bearing.withColumn(mark, F.sha2(text, 256)).join(answers, mark, "left")
    changed = changed.withColumns({text: whole, "n_entities": count}).select(*columns, "n_entities")
    return held.where(F.col(cut).isNull()).select(*columns).withColumn("n_entities", F.lit(0)).unionByName(changed)
