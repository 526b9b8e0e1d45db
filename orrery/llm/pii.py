"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize

KEY = "orrery"

# Forms of address by gender, and what a detected entity looks like. The first pattern that fits an entity gives its type.
MALE = ("Mr", "mr", "MR", "Herr", "Señor", "Monsieur", "Sir", "Господин", "Κύριος")
FEMALE = ("Mrs", "mrs", "MRS", "Ms", "MS", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "Madam", "Госпожа", "Κυρία")
NEITHER = ("Dr", "dr", "DR", "Prof", "prof", "PROF", "Doctor", "Professor")
_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEITHER, key=len, reverse=True)) + r")\.?"
#: Nothing of a word before, or after. All repetitions without a bound are possessive, so that no text takes more than time in proportion to its length.
_L, _R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_LOCAL = r"[\p{L}\p{N}._%+-]"
_SURNAME = r"\p{Lu}(?:\p{L}++(?:['’-](?![sS](?!\p{L}))\p{L}++)*+|['’]\p{Lu}\p{L}++)"
TYPES = {
    # an address starts where such a run starts, or where the last entity ended; a domain is labels of which the last has letters alone
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?:(?:[\p{{L}}\p{{N}}-]++\.){{1,127}}?(?=\p{{L}}{{2}}))++\p{{L}}{{2,}}+",
    "secret": rf"{_L}(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+|AKIA[0-9A-Z]{{16}}|sk-[A-Za-z0-9]{{20,}}+|gh[pousr]_[A-Za-z0-9]{{20,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+|eyJ[A-Za-z0-9_-]{{10,}}+(?:\.[A-Za-z0-9_-]{{10,}}+){{1,2}}){_R}",
    "iban": rf"{_L}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z]{{4}})?(?: [0-9]{{4}}){{2,7}}(?: [0-9]{{1,3}})?){_R}",
    "card": rf"{_L}(?:(?:[0-9]{{4}}[ -]?){{3}}[0-9]{{4}}|[0-9]{{13,19}}){_R}",
    "phone": rf"\+?[0-9]{{1,3}}[ .-]?\([0-9]{{2,4}}\)[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}{_R}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}{_R}|{_L}[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}{_R}|\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}{_R}|{_L}0[0-9]{{2,4}} [0-9]{{3,4}} [0-9]{{3,4}}{_R}",
    "national_id": rf"{_L}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_R}",
    "ip": rf"{_L}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_R}",
    "name": rf"{_L}{_TITLE}\s{_SURNAME}(?: {_SURNAME})?|{_L}mrs?\.?\s(?!(?:and|or|und|oder|et|ou|y|o)(?!\p{{L}}))\p{{Ll}}\p{{L}}++",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: Further draws in the format of the identity for surrogates that collide; each draw after them is a character longer.
MAX_DRAWS = 6

#: script: consonants, vowels. The last one is for letters of all other scripts.
_SETS = {
    r"\p{IsLatin}": ("bcdfghjklmnprstvwz", "aeiou"),
    r"\p{IsCyrillic}": ("бвгдзклмнпрстфх", "аеиоу"),
    r"\p{IsGreek}": ("βγδζθκλμνπρστφχ", "αεηιο"),
    r"\p{IsArmenian}": ("բգդզլկհմնպստրվ", "աեիոօ"),
    r"\p{IsGeorgian}": ("ბგდვზთკლმნპრსტ", "აეიოუ"),
    r"\p{IsArabic}": ("بتجدرزسفقكلمن", "اوي"),
    r"\p{IsHebrew}": ("בגדזחטכלמנספצקרשת", "אוי"),
    r"\p{IsDevanagari}": ("कगजटडतदनपबमयरलवसह", "अइउएओ"),
    r"\p{IsHan}": ("安平明文林春江山石雨云竹松月", "一大小中天"),
    r"\p{IsHiragana}": ("かきくけこさしすせそたちつてとなにぬねの", "あいうえお"),
    r"\p{IsKatakana}": ("カキクケコサシスセソタチツテトナニヌネノ", "アイウエオ"),
    r"\p{IsHangul}": ("가나다라마바사자하", "고노도로모"),
    r"\p{L}": ("bcdfghjklmnprstvwz", "aeiou"),
}
_VENDOR = "^(AKIA|sk-|gh[pousr]_|xox[abprs]-|eyJ)"
# Marks around entities while a text is cut up: noncharacters of Unicode. Where a text has them, they stand escaped meanwhile.
_MARK, _ESCAPE, _WAS_ESCAPE, _WAS_MARK = "﷐", "﷑", "﷑﷒", "﷑﷓"


def pieces(text: Column) -> Column:
    """A text cut up around its entities, which are the second, fourth, ... piece. One search a text."""
    odd = text.rlike(f"[{_MARK}{_ESCAPE}]")
    safe = F.when(odd, F.regexp_replace(F.regexp_replace(text, _ESCAPE, _WAS_ESCAPE), _MARK, _WAS_MARK)).otherwise(text)
    cut = F.split(F.regexp_replace(safe, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    plain = F.transform(cut, lambda p: F.regexp_replace(F.regexp_replace(p, _WAS_MARK, _MARK), _WAS_ESCAPE, _ESCAPE))
    return F.when(odd, plain).otherwise(cut)


def entity_type(e: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, p in reversed(TYPES.items()):
        found = F.when(e.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(found)
    return found


def parts(kind: Column, e: Column) -> Column:
    """The words of a name, the first with its form of address, as each is somebody's by itself; any other entity is one part."""
    title = F.regexp_extract(e, rf"^({_TITLE}\s)", 1)
    words = F.split(F.substr(e, F.length(title) + 1), " ")
    return F.when(kind == "name", F.transform(words, lambda w, i: F.when(i == 0, F.concat(title, w)).otherwise(w))).otherwise(F.array(e))


def gender(kind: Column, e: Column) -> Column:
    """What the form of address tells of all parts of a name."""
    says = lambda which: e.rlike("^(?:" + "|".join(which) + r")(?!\p{L})")
    return F.when(kind != "name", "").when(says(FEMALE), "f:").when(says(NEITHER), "n:").otherwise("m:")


def identity(kind: Column, e: Column, told: Column) -> Column:
    """What mentions of one entity, or of one part of a name, have in common: separators, forms of address (but for the gender that is told) and letter case aside; case counts in secrets."""
    digits = F.regexp_replace(e, r"[^0-9]", "")
    return (
        F.when(kind == "phone", F.right(digits, F.lit(10)))  # a country code before the national number stays as it is
        .when(kind.isin("card", "national_id"), digits)
        .when(kind == "name", F.concat(told, F.lower(F.regexp_replace(e, rf"^{_TITLE}\s", ""))))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "email", F.lower(e))
        .otherwise(e)
    )


def _hash(*parts: Column | str) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)), 512)


def _script(c: Column) -> Column:
    """Consonants and vowels of the script of a letter."""
    found = None
    for script, both in _SETS.items():
        sets = F.struct(F.lit(both[0]).alias("consonants"), F.lit(both[1]).alias("vowels"))
        found = F.when(c.rlike(script), sets) if found is None else found.when(c.rlike(script), sets)
    return found


def _pick(letters: Column, n: Column) -> Column:
    return F.substr(letters, n % F.length(letters) + 1, F.lit(1))


def _byte(digest: Column, i: Column | int) -> Column:
    """A number from 0 to 255 of a digest of 64 bytes."""
    at = 2 * (i % 64) + 1
    return F.conv(F.substr(digest, at.cast("int") if isinstance(at, Column) else F.lit(at), F.lit(2)), 16, 10).cast("int")


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def _mod97(account: Column) -> Column:
    """Remainder of an account number (A to Z stand for 10 to 35) by 97."""
    add = lambda acc, c: (F.when(c.rlike("[A-Z]"), acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97).cast("int")
    return F.aggregate(F.split(account, ""), F.lit(0), add)


def surrogate(kind: Column, norm: Column, draw: Column, key: str = KEY, draws: int = MAX_DRAWS) -> Column:
    """The keyed replacement of an identity; another draw gives another one, and each draw after the given number is a character longer."""
    more = F.greatest(draw - draws, F.lit(0))
    # more digits than any phone has, as those before the last ten aren't part of the identity
    more = F.when((kind == "phone") & (more > 0) & (F.length(norm) + more > 10), more + 14).otherwise(more)
    local, domain = F.regexp_extract(norm, "^(.*)@", 1), F.regexp_extract(norm, "@(.*)$", 1)
    host, top = (F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", k) for k in (1, 2))
    last = F.right(norm, F.lit(1))
    extra = F.repeat(F.when(kind.isin("email", "secret", "name") & last.rlike(r"\p{L}"), last).when(kind.isin("email", "secret", "name"), "a").otherwise("0"), more)
    head = F.when(kind == "secret", F.regexp_extract(norm, _VENDOR, 1)).when(kind.isin("name", "iban"), F.substr(norm, F.lit(1), F.lit(2))).otherwise("")
    body = F.when(kind == "email", F.concat(local, extra, F.lit("@"), host)).otherwise(F.concat(F.substr(norm, F.length(head) + 1), extra))
    start = F.struct(
        head.alias("head"), body.alias("body"), top.alias("top"), more.alias("more"), _hash(key, kind, norm, draw.cast("string")).alias("digest"),
        F.length(body).alias("length"), F.when(kind == "email", F.length(local) + more).otherwise(F.length(body)).alias("inner"), _hash(key, "domain", domain).alias("of_domain"),
        ((kind == "secret") & norm.rlike("^[0-9a-f]+$|^[0-9A-F]+$")).alias("hexadecimal"), (norm == F.upper(norm)).alias("loud"),
    )

    def one(s: Column, c: Column, i: Column) -> Column:
        n = _byte(F.when(i < s["inner"], s["digest"]).otherwise(s["of_domain"]), i)  # one domain stays one
        final = i == s["length"] - 1
        letters = let(_script(c), lambda t: F.when(kind != "name", F.concat(t["consonants"], t["vowels"])).when(final & (s["head"] == "f:"), F.left(t["vowels"], F.lit(1))).when(final | (i % 2 == 0), t["consonants"]).otherwise(t["vowels"]))
        new = F.when(s["hexadecimal"], _pick(F.lit("0123456789abcdef"), n)).when(c.rlike(r"\p{N}"), (n % 10).cast("string")).when(~c.rlike(r"\p{L}"), c)
        new = new.otherwise(let(letters, lambda x: _pick(x, n)))
        return F.when(F.when(s["hexadecimal"], s["loud"]).otherwise(c != F.lower(c)), F.upper(new)).otherwise(new)

    def finish(s: Column, drawn: Column) -> Column:
        short = F.left(drawn, F.length(drawn) - 1)
        check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(short, d.cast("string"))), _luhn), 1)
        rest = F.substr(drawn, F.lit(3))
        valid = _mod97(F.concat(F.substr(norm, F.lit(5)), F.left(norm, F.lit(4)))) == 1
        digits = F.lpad((98 - _mod97(F.concat(rest, s["head"], F.lit("00")))).cast("string"), 2, "0")
        octets = [(_byte(s["digest"], k) % 254 + 1).cast("string") for k in range(4)]
        return (
            F.when(kind == "email", F.concat(drawn, s["top"]))
            .when((kind == "card") & _luhn(norm), check)
            .when((kind == "iban") & valid, F.concat(s["head"], digits, rest))
            .when(kind == "ip", F.concat_ws(".", *octets, F.when(s["more"] > 0, F.left(F.conv(F.substr(s["digest"], F.lit(9), F.lit(15)), 16, 10), s["more"]))))
            .otherwise(F.concat(s["head"], drawn))
        )

    return let(start, lambda s: let(F.array_join(F.transform(F.split(s["body"], ""), lambda c, i: one(s, c, i)), ""), lambda drawn: finish(s, drawn)))


def surrogates(entities: DataFrame, key: str = KEY, draws: int = MAX_DRAWS) -> DataFrame:
    """(kind, norm), distinct -> kind, norm, core: no two of a kind get the same, and none gets what is somebody's own.

    In a round all open identities draw, and of those with the same surrogate the smallest gets it if it is free. A format may have fewer surrogates than
    identities, so draws after the given number are each a character longer: what an identity may get then grows tenfold at least with every draw,
    and no identity is left without. A round reads the settled surrogates and the open identities only.
    """
    own = materialize(entities.select("kind", F.col("norm").alias("core")))
    taken, settled = own, None
    open_ = own.select("kind", F.col("core").alias("norm"), F.lit(0).alias("draw"))
    rounds = []
    while True:
        drawn = materialize(open_.withColumn("core", surrogate(F.col("kind"), F.col("norm"), F.col("draw"), key, draws)))
        winners = materialize(drawn.groupBy("kind", "core").agg(F.min("norm").alias("norm")).join(taken, ["kind", "core"], "left_anti").select("kind", "norm", "core"))
        settled = winners if settled is None else settled.unionByName(winners)
        taken = taken.unionByName(winners.select("kind", "core"))
        rounds += [drawn, winners]
        open_ = drawn.select("kind", "norm", (F.col("draw") + 1).alias("draw")).join(winners, ["kind", "norm"], "left_anti")
        if open_.isEmpty():
            found = materialize(settled)
            for table in (own, *rounds):
                discard(table)
            return found


def in_format(kind: Column, mention: Column, core: Column) -> Column:
    """A core written as the mention is: its separators, its case, its form of address."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    full = F.when(kind == "phone", F.concat(F.left(digits, F.greatest(F.length(digits) - 10, F.lit(0))), core)).otherwise(core)
    slot = F.when(kind == "iban", F.lit("[0-9A-Z]")).otherwise(F.lit("[0-9]"))
    start = F.struct(full.alias("core"), slot.alias("slot"), F.split(mention, "").alias("chars"))

    def dealt(s: Column) -> Column:
        """Characters of the core in the places of the mention, and then what a longer core has beyond them. Such mentions are short."""
        before = lambda i: F.size(F.filter(F.slice(s["chars"], 1, i + 1), lambda c: F.regexp_like(c, s["slot"])))
        written = F.array_join(F.transform(s["chars"], lambda c, i: F.when(F.regexp_like(c, s["slot"]), F.substr(s["core"], before(i), F.lit(1))).otherwise(c)), "")
        return F.concat(written, F.substr(s["core"], F.regexp_count(mention, s["slot"]) + 1))

    title = F.when(kind == "name", F.regexp_extract(mention, rf"^({_TITLE}\s)", 1)).otherwise("")
    bare = F.substr(mention, F.length(title) + 1)
    loud = (bare == F.upper(bare)) & (bare != F.lower(bare)) & (F.length(bare) > 1)
    raw = F.when(kind == "name", F.substr(core, F.lit(3))).otherwise(core)
    # a character of the mention and what comes in its place; a longer core goes on as the whole mention is written
    cased = let(loud, lambda up: F.array_join(F.zip_with(F.split(raw, ""), F.split(bare, ""), lambda c, m: F.when(up | F.coalesce(m != F.lower(m), F.lit(False)), F.upper(c)).otherwise(c)), ""))
    return F.when(kind.isin("card", "phone", "national_id", "iban"), let(start, dealt)).when(kind.isin("name", "email"), F.concat(title, cased)).otherwise(core)


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with doc_id and text -> the same columns with surrogates in text, and entities array<struct<kind, surrogate>>.

    A column named entities gives way; any other name may stand beside these. The surrogate of an identity is the same in all documents; given name and surname have one each,
    so that a person stays one whether both are said or one. Each text is searched once; its pieces
    become a table. Texts without entities aren't shuffled; the others meet their surrogates by the hash of their text, so that copies share them, by joins
    of tables, which Spark may split where a text or an identity is frequent. Null text stays null, with no entities; so do empty texts. Texts of any length
    take time in proportion to it. Rows may repeat; equal texts get equal results; ids aren't looked at. No rows give no rows.
    """
    others = [c for c in docs.columns if c not in ("text", "entities")]
    cut = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc"), pieces(F.col("text")).alias("pieces"), F.md5("text").alias("key"))
    cut = materialize(cut.withColumn("key", F.when(F.size("pieces") > 1, F.col("key"))))
    mentioned = F.filter("pieces", lambda p, i: i % 2 == 1)
    texts = cut.where("key IS NOT NULL").select("key", mentioned.alias("mentions")).dropDuplicates(["key"])
    mentions = texts.select("key", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", entity_type(F.col("mention")))
    told = gender(F.col("kind"), F.col("mention")).alias("told")
    mentions = mentions.select("key", "at", "kind", told, F.posexplode(parts(F.col("kind"), F.col("mention"))).alias("part", "mention"))
    mentions = materialize(mentions.withColumn("norm", identity(F.col("kind"), F.col("mention"), F.col("told"))))
    cores = surrogates(mentions.select("kind", "norm").distinct(), key)
    written = mentions.join(cores, ["kind", "norm"]).select("key", "at", "part", "kind", in_format(F.col("kind"), F.col("mention"), F.col("core")).alias("surrogate"))
    by_text = written.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "part", "kind", "surrogate"))).alias("found"))
    # the first part of each entity, and its other parts after it (a name has two at most)
    following = lambda i: F.get(F.col("found"), i + 1)
    whole = F.transform("found", lambda e, i: F.struct(e["part"].alias("part"), e["kind"].alias("kind"), F.concat(e["surrogate"], F.when(following(i)["part"] > 0, F.concat(F.lit(" "), following(i)["surrogate"])).otherwise("")).alias("surrogate")))
    firsts = F.transform(F.filter(whole, lambda e: e["part"] == 0), lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate")))
    by_text = materialize(by_text.select("key", firsts.alias("entities")))
    discard(mentions)
    discard(cores)
    none = F.array().cast("array<struct<kind: string, surrogate: string>>")
    plain = cut.where("key IS NULL").select("doc", F.array_join("pieces", "").alias("text"), none.alias("entities"))
    new = F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.get(F.col("entities"), F.floor(i / 2).cast("int"))["surrogate"]).otherwise(p))
    changed = cut.where("key IS NOT NULL").join(by_text, "key").select("doc", F.array_join(new, "").alias("text"), "entities")
    columns = [F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c != "entities"]
    return plain.unionByName(changed).select(*columns, "entities")
