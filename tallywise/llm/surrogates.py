"""Personal data replaced by keyed surrogates.

Entities are found by pattern.  Each has a canonical form, so all spellings of an
entity get one surrogate, and a surrogate of the same kind: numbers keep separators,
length, country code and first digit, card numbers that pass the Luhn check keep
passing it, addresses keep their shape and top-level domain, octets their number of
digits; given names keep gender and script, all names their capitals.  Surrogates
come from SHA-256 of a key, the kind and the canonical form.

Two entities may draw the same surrogate, or one that is a real entity of the input.
So surrogates are checked over the table of distinct entities: of equal draws one
stays, the others draw again until none is left over.  Names consist of parts that
are entities of their own, so a surname stands for the same surname in every name.

Names grow by a syllable a draw.  Where the room of another form is used up after
``MOST_DRAWS`` draws, or a value has no letter or digit to replace, the surrogate changes
its form within its kind and is written as it is: numbers get a digit more with every
draw, e-mails a drawn local part and domain, octets any length, and at last an address of
four octets becomes one of eight groups.  So every entity gets a surrogate in the end.

Texts without entities are returned as they are.  A text is cut at its entities and
joined again, so replacements never meet each other.

Nulls and edge cases: a null text stays null; an empty text stays empty; a text of any
length is scanned whole; a null id is returned as it came; rows that repeat get the
same replacements; an empty table gives no rows.  Only the id and text columns are
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEY = "tallywise"
#: Calling codes of one, two or three digits; no code is the beginning of another.
CALLING_CODE = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Draws before the room for surrogates of a form counts as used up.
MOST_DRAWS = 64

#: Titles and common given names, by gender.
TITLES = {"m": "Mr Herr Señor Monsieur Mister Sir".split(), "f": "Mrs Ms Miss Frau Señora Señorita Madame Mademoiselle Mme Mlle".split(),
          "u": "Dr Prof".split()}
GIVEN = {
    "m": "John James Robert Michael William David Richard Thomas Daniel Peter Paul George Hans Karl Jürgen Klaus Stefan "
         "Wolfgang Jean Pierre Michel François Luc Henri José Juan Carlos Miguel Antonio Pedro Luis Иван Пётр Сергей "
         "Дмитрий Алексей".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Anna Helga Ursula Petra Sabine Monika "
         "Marie Sophie Camille Chloé Claire María Carmen Lucía Isabel Elena Анна Мария Ольга Елена Наталья".split()}

_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
_TITLE = "(?:" + "|".join(x for ts in TITLES.values() for t in ts for x in (t, t.upper())) + r")\.?"
_GIVEN = "(?:" + "|".join(g for gs in GIVEN.values() for g in gs) + ")"
#: Kinds in order of preference where they overlap.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}[\p{L}]{2,24}(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}]|-\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}.-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}]|[.-]\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}[ ]{_NAME}(?:[ ]{_NAME})?|{_GIVEN}[ ]{_NAME})(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(PATTERNS.values())
ALL_TITLES = [t for ts in TITLES.values() for t in ts]

#: Syllables of invented names, by script.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te".split(),
             "cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те".split()}
ENDINGS = {"latin": {"m": "n", "f": "lia", "u": "r"}, "cyrillic": {"m": "н", "f": "лия", "u": "р"}}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "hex": "abcdef"}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(column: str, words: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def _kind(value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} RLIKE {_sql('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS.items()) + " END"


def _parts(found: DataFrame) -> DataFrame:
    """(value, kind) → its entities: the whole value, or the given name and surname of a name."""
    first = "split(bare, ' ')[0]"
    titled = f"regexp_extract(value, '^(?i:({'|'.join(ALL_TITLES)}))\\\\.? ', 1)"
    gender = "CASE " + " ".join(f"WHEN {_among('lower(title)', [t.lower() for t in TITLES[g]])} THEN '{g}'" for g in "mf") + " " + \
        " ".join(f"WHEN {_among(first, GIVEN[g])} THEN '{g}'" for g in "mf") + " ELSE 'u' END"
    rows = found.withColumn("title", F.expr(titled)) \
        .withColumn("bare", F.expr("IF(title = '', value, regexp_replace(value, '^[^ ]+ ', ''))")) \
        .withColumn("gender", F.expr(gender))
    script = "IF({x} RLIKE '\\\\p{{IsCyrillic}}', 'cyrillic', 'latin')"
    names = ("transform(split(bare, ' '), (x, i) -> named_struct('part', x, 'entity', "
             "IF(i = size(split(bare, ' ')) - 1, 'surname', concat('given ', gender)), 'canonical', lower(x), 'script', "
             + script.format(x="x") + "))")
    digits = "regexp_replace(value, '[^0-9]', '')"
    # Calling code, blank, all digits behind it, wherever the separators stand; a number without a code has none.
    called = f"regexp_extract({digits}, '^{CALLING_CODE}', 0)"
    phone = f"IF(value LIKE '+%', concat('+', {called}, ' ', substr({digits}, length({called}) + 1)), concat(' ', {digits}))"
    canonical = (f"CASE kind WHEN 'email' THEN lower(value) WHEN 'iban' THEN replace(value, ' ', '') "
                 f"WHEN 'phone' THEN {phone} "
                 f"WHEN 'card' THEN {digits} WHEN 'ssn' THEN {digits} WHEN 'ipv6' THEN lower(value) ELSE value END")
    whole = ("array(named_struct('part', value, 'entity', kind, 'canonical', " + canonical + ", 'script', "
             + script.format(x="value") + "))")
    return rows.select("value", "kind", F.posexplode(F.expr(f"IF(kind = 'name', {names}, {whole})")).alias("at", "x")) \
        .select("value", "kind", "at", "x.*")


def _draw(key: str) -> str:
    """SQL for the surrogate of (entity, canonical, script) at draw ``draw``."""
    def stream(text: str) -> str:
        return f"sha2(concat_ws('|', '{key}', entity, draw, canonical, {text}), 256)"

    def number(i: str) -> str:
        # Two of the 64 digits; longer forms go on with the next hash.
        return f"int(conv(substr({stream(f'{i} DIV 32')}, ({i} % 32) * 2 + 1, 2), 16, 10))"

    def pick(alphabet: str, i: str) -> str:
        return f"substr('{alphabet}', {number(i)} % {len(alphabet)} + 1, 1)"

    def shaped(text: str, letters: str = "latin") -> str:
        return (f"array_join(transform(split({text}, ''), (c, i) -> CASE WHEN c RLIKE '\\\\p{{N}}' THEN {pick('0123456789', 'i')} "
                f"WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN {pick(LETTERS['cyrillic'], 'i')} "
                f"WHEN c RLIKE '[A-Z]' THEN upper({pick(LETTERS['latin'], 'i')}) "
                f"WHEN c RLIKE '\\\\p{{L}}' THEN {pick(LETTERS[letters], 'i')} ELSE c END), '')")

    head = "regexp_replace(canonical, '[.][^.]*$', '')"
    def drawn_letters(n: str, start: int) -> str:
        return f"array_join(transform(sequence(1, {n}), i -> {pick(LETTERS['latin'], f'(i + {start})')}), '')"

    # The number of draws in the grown form, and as many places for digits.
    more = "repeat('0', grown)"
    email = (f"IF(grown > 0, concat({drawn_letters('7 + grown', 0)}, '@', {drawn_letters('8', 4096)}), {shaped(head)})")
    email = f"concat({email}, regexp_extract(canonical, '[.][^.]*$', 0))"
    octet = (f"CASE length(o) WHEN 1 THEN 1 + {number('i')} % 9 WHEN 2 THEN 10 + {number('i')} % 90 "
             f"ELSE 100 + {number('i')} % 156 END")
    groups = f"transform(sequence(0, 7), g -> lower(substr({stream('128')}, g * 4 + 1, 4)))"
    groups = f"array_join({groups}, ':')"
    ip = (f"IF(grown > {MOST_DRAWS}, {groups}, array_join(transform(split(canonical, '[.]'), (o, i) -> "
          f"cast(IF(grown > 0, 1 + {number('i')} % 255, {octet}) AS string)), '.'))")
    phone = (f"concat(split(canonical, ' ')[0], ' ', cast(2 + {number('40')} % 8 AS string), "
             f"{shaped(f'concat(substr(split(canonical, chr(32))[1], 2), {more})')})")
    ssn = shaped(f"concat(canonical, {more})")
    ssn = f"IF(grown > 0, regexp_replace({ssn}, '^(...)(..)', '$1-$2-'), {ssn})"
    drawn = f"concat(substr(canonical, 1, 1), {shaped(f'concat(substr(canonical, 2), {more})')})"
    luhn = (f"transform(array({drawn}), d -> concat(substr(d, 1, length(d) - 1), filter(transform(sequence(0, 9), "
            "k -> cast(k AS string)), k -> luhn_check(concat(substr(d, 1, length(d) - 1), k)))[0]))[0]")
    card = f"IF(luhn_check(canonical), {luhn}, {drawn})"
    iban = f"concat(substr(canonical, 1, 2), {shaped(f'concat(substr(canonical, 3), {more})')})"
    ipv6 = f"IF(grown > 0, {groups}, {shaped('canonical', 'hex')})"

    def name(script: str) -> str:
        table = ", ".join(f"'{s}'" for s in SYLLABLES[script])
        # Names grow by a syllable with every draw, so there is always room for another.
        body = (f"array_join(transform(sequence(0, 2 + draw + {number('50')} % 2), "
                f"i -> array({table})[{number('i')} % {len(SYLLABLES[script])}]), '')")
        end = f"CASE entity " + " ".join(f"WHEN 'given {g}' THEN '{e}'" for g, e in ENDINGS[script].items()) + " ELSE '' END"
        return f"concat({body}, {end})"

    return (f"CASE WHEN entity = 'email' THEN {email} WHEN entity = 'ip' THEN {ip} WHEN entity = 'phone' THEN {phone} "
            f"WHEN entity = 'card' THEN {card} WHEN entity = 'iban' THEN {iban} "
            f"WHEN entity = 'ipv6' THEN {ipv6} WHEN entity = 'ssn' THEN {ssn} "
            f"WHEN script = 'cyrillic' THEN {name('cyrillic')} ELSE {name('latin')} END")


def assign(entities: DataFrame, key: str = KEY, most: int = MOST_DRAWS) -> DataFrame:
    """(entity, canonical, surrogate, grown) for distinct (entity, canonical, script); no two surrogates of a kind are
    equal, and none is the canonical form of an entity of the input.  Forms grow after ``most`` draws."""
    # All names are one kind here: a given name must not become a surname in use.
    space = F.when(F.col("entity").startswith("given ") | (F.col("entity") == "surname"), "name").otherwise(F.col("entity"))
    real = entities.select(space.alias("space"), F.col("canonical").alias("surrogate")).distinct()
    # An e-mail without a letter or digit before its last dot leaves nothing to draw.
    bare = F.expr("entity = 'email' AND regexp_replace(canonical, '[.][^.]*$', '') NOT RLIKE '[\\\\p{L}\\\\p{N}]'")
    pending, done, draw = entities.withColumn("space", space), None, 0
    while True:
        drawn = pending.withColumns({"draw": F.lit(draw), "grown": F.when(bare, draw + 1).otherwise(max(0, draw - most + 1))}) \
            .withColumn("surrogate", F.expr(_draw(key)))
        taken = real if done is None else real.unionByName(done.select("space", "surrogate"))
        free = drawn.join(taken, ["space", "surrogate"], "left_anti")
        winner = materialise(free.groupBy("space", "surrogate").agg(
            F.min(F.struct("entity", "canonical", "script", (F.col("grown") > 0).alias("grown"))).alias("x"))
            .select("space", "surrogate", "x.*"), "surrogates")
        done = winner if done is None else done.unionByName(winner)
        pending = materialise(pending.join(winner, ["entity", "canonical", "script"], "left_anti"), "pending")
        if not pending.take(1):
            return done.select("entity", "canonical", "surrogate", "grown")
        draw += 1


def _filled() -> str:
    """SQL: the letters and digits of ``surrogate`` in the places of those of ``part``, in its capitals."""
    chars = "split(regexp_replace(surrogate, '[^\\\\p{L}\\\\p{N}]', ''), '')"
    slot = "length(regexp_replace(substr(part, 1, i), '[^\\\\p{L}\\\\p{N}]', ''))"
    return (f"array_join(transform(split(part, ''), (c, i) -> IF(c RLIKE '[\\\\p{{L}}\\\\p{{N}}]', "
            f"IF(c RLIKE '\\\\p{{Lu}}', upper(get({chars}, {slot})), lower(get({chars}, {slot}))), c)), '')")


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(doc_id, text, n_replaced): each text with its entities replaced."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns({
        "row": F.xxhash64(F.col("doc_id").cast("string"), "text"), "check": F.crc32(F.col("text").cast("binary"))})
    met = docs.select("row", "check", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("values")) \
        .filter(F.size("values") > 0).select("row", "check", F.explode(F.array_distinct("values")).alias("value"))
    met = materialise(met, "met")
    parts = materialise(_parts(met.select("value").distinct().withColumn("kind", F.expr(_kind("value")))), "parts")
    given = assign(parts.select("entity", "canonical", "script").distinct(), key)

    style = F.when(F.upper("part") == F.col("part"), F.upper("surrogate")).otherwise(F.initcap("surrogate"))
    drawn = parts.join(given, ["entity", "canonical"]) \
        .withColumn("new", F.when(F.col("kind") == "name", style).when(F.col("grown"), F.ltrim("surrogate"))
                    .otherwise(F.expr(_filled())))
    title = F.regexp_extract("value", f"^{_TITLE}[ ]", 0)
    # At most a given name and a surname.
    whole = drawn.groupBy("value", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("news")).select(
        "value", F.when(F.col("kind") == "name", F.concat(title, F.array_join("news.new", " ")))
        .otherwise(F.col("news.new")[0]).alias("new"))
    # The distinct entities of one text.
    tables = met.join(whole, "value").groupBy("row", "check").agg(
        F.map_from_entries(F.collect_set(F.struct("value", "new"))).alias("news"))

    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    between = F.split("text", ANY, -1)
    joined = docs.join(tables, ["row", "check"], "left")
    cut = joined.withColumns({"found": F.when(F.col("news").isNotNull(), found),
                              "between": F.when(F.col("news").isNotNull(), between)})
    new_text = F.array_join(F.zip_with("between", F.transform("found", lambda x: F.element_at("news", x)),
                                       lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return cut.select("doc_id", F.when(F.col("news").isNull(), F.col("text")).otherwise(new_text).alias("text"),
                      F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_replaced"))
