"""PII: detected entities get keyed surrogates of the same type, format, script and, for names, gender.

An entity is first brought to a canonical form, so that all its spellings get one surrogate (digits of a phone number or a card however they are grouped, the
lower-case form of an address). The surrogate is then drawn by a keyed permutation of all strings of the same pattern: letters stay letters of their
script, digits digits, separators what they are; a card keeps the state of its check digit, an IPv4 address the kind of network it
is in, a phone number its country code. A permutation never gives two entities one surrogate, and none its own.

Names are found after titles, and after labels with a colon such as Patient: or Name:; in the same text, their mentions without a title count too, and so do those of their last word, the family name. A possessive 's is no part of a
name. A name is one person in the whole corpus, whatever the titles; its gender is the one that its titles tell, if they do not tell both. Names are the exception, as given names are drawn from lists by gender, and family names are made
up, by the last word alone, so that a person's full name and family name agree: there two may meet. So all family names of the corpus are checked first, and then all full names: where several share a surrogate, all but the first draw
again, until all are distinct. The outcome, the few names that had to draw again, is sent to the executors if it is small, and else joined to the texts.

Defined results: null text stays null, with no entities; equal texts are treated alike; other columns play no part, and are replaced if
they have the names of the result's; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, small_batches

#: Given names by script and gender, from which surrogates are drawn.
GIVEN = {
    ("latin", "f"): ["Ada", "Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Eva", "Greta", "Hanna", "Ida", "Ines", "Julia", "Laura", "Lea", "Lina", "Maria", "Nina", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "Albert", "Anton", "Ben", "Carl", "Daniel", "David", "Emil", "Erik", "Felix", "Hugo", "Jacob", "Jonas", "Leo", "Lukas", "Marco", "Martin", "Max", "Noah", "Oscar", "Paul", "Peter", "Simon", "Thomas", "Victor"],
    ("latin", "n"): ["Alex", "Andrea", "Chris", "Dominique", "Jo", "Jules", "Kim", "Lou", "Luca", "Mika", "Noel", "Pat", "Robin", "Sam", "Sascha", "Toni"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Иван", "Максим", "Николай", "Олег", "Пётр"],
    ("cyrillic", "n"): ["Женя", "Саша"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ίρις", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Ηλίας", "Νίκος", "Πέτρος", "Στέφανος"],
    ("greek", "n"): ["Αλέξης", "Χάρης"],
}
#: Syllables of made-up family names, 16 of each script.
SYLLABLES = {
    "latin": "ba de fi go ha je ka lo mi nu pe ra so ta vi zu".split(),
    "cyrillic": "ба де фи го ха же ка ло ми ну пе ра со та ви зу".split(),
    "greek": "βα δε φι γο χα ζε κα λο μι νυ πε ρα σο τα θι ξυ".split(),
}
#: Titles that go before a name, with the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Letters of each script that stand for one another.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "äöüß", "àâçèéêëîïôùûœ", "áíóúñ"]
_HEX = "0123456789abcdef"
#: Calling codes of one and of two digits; all others have three. None begins with another.
_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
#: In an attempt, the bits above these tell that the name's gender is another than its title's: 1 + its place in GENDERS.
_TRIES, GENDERS = 20, "fmn"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[^\W\d_]+(?:-[^\W\d_]+|['’](?![sS](?!\w))[^\W\d_]+)*"
#: Labels that a name follows after a colon.
LABELS = ["Patient", "Name", "Full name", "Contact", "Contact person", "Attn", "Employee", "Customer", "Client"]
KINDS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]*\w@(?:[\w-]+\.)+[^\W\d_]{2,}"),
    "secret": re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?(?P<v>[\w./+-]{8,}=*)|(?<!\w)(?P<h>[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?!\w)"""),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    "card": re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w-]*\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"),
    "name": re.compile(rf"(?<!\w)(?:(?P<t>{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? |(?:{'|'.join(LABELS)}): ?(?:(?P<u>{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? )?)(?P<v>{_NAME}(?: {_NAME}){{0,2}})"),
}
TITLE_FILTER = rf"(^|[^\p{{L}}])(({'|'.join(TITLES)})\.? |({'|'.join(LABELS)}): ?)\p{{Lu}}"
_ANY = re.compile(r"[0-9@=:]")


class Permutation:
    """A keyed permutation of 0 .. size-1 that maps nothing to itself: the places in a keyed order, each to the one a keyed distance on. The order is
    a Feistel network on bits, walked until it falls below ``size``.
    """

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.width = self.half // 8 + 9
        self.key, self.tweak = hashlib.blake2b(key).digest(), tweak.encode()
        self.step = 1 + self._hash(b"step") % (size - 1) if size > 1 else 0

    def _hash(self, what: bytes) -> int:
        digest = hashlib.blake2b(self.tweak + what, key=self.key, digest_size=min(64, self.width)).digest()
        while len(digest) < self.width:
            digest += hashlib.blake2b(digest, key=self.key).digest()
        return int.from_bytes(digest[: self.width], "big")

    def _place(self, x: int, turns: range) -> int:
        """Along the order, or, with the turns backwards, against it."""
        mask, back = (1 << self.half) - 1, turns.step < 0
        while True:
            left, right = x >> self.half, x & mask
            if back:
                left, right = right, left
            for turn in turns:
                left, right = right, left ^ (self._hash(bytes([turn]) + right.to_bytes(self.width, "big")) & mask)
            if back:
                left, right = right, left
            x = left << self.half | right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        return self._place((self._place(x, range(7, -1, -1)) + self.step) % self.size, range(8))


def permute_text(key: bytes, tweak: str, text: str, alphabets: list[str] = ALPHABETS) -> str:
    """Another text of the same pattern, lower case for lower case. One-to-one among texts of a pattern."""
    sets = [next((a for a in alphabets if c.lower() in a), None) for c in text]
    pattern = "".join(a[0] if a else c for c, a in zip(text, sets, strict=True))
    size, value = 1, 0
    for c, a in zip(text, sets, strict=True):
        if a:
            size, value = size * len(a), value * len(a) + a.index(c.lower())
    if size == 1:
        return text
    value = Permutation(key, f"{tweak}|{pattern}", size)(value)
    out = []
    for c, a in zip(reversed(text), reversed(sets), strict=True):
        if a:
            value, i = divmod(value, len(a))
            c = a[i].upper() if c.isupper() and len(a[i].upper()) == 1 else a[i]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _pour(digits: str, form: str) -> str:
    """The digits, in the places that ``form`` has digits in."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


_NETWORKS = [(10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24)]


def _ip(key: bytes, text: str) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    home = lambda v: next(((n, b) for n, b in _NETWORKS if v >> b == n >> b), None)
    net = home(value)
    if net:
        value = net[0] | Permutation(key, f"ip|{net[0]}", 1 << net[1])(value & ((1 << net[1]) - 1))
    else:
        walk = Permutation(key, "ip", 1 << 32)
        value = walk(value)
        while home(value):
            value = walk(value)
    return ".".join(map(str, value.to_bytes(4, "big")))


def canonical(kind: str, text: str) -> str:
    """One form for all spellings of an entity."""
    if kind in ("card", "ssn", "phone"):
        return ("+" if text.startswith("+") else "") + "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind in ("email", "name") else text


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


def _drawn(key: bytes, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(what.encode(), key=hashlib.blake2b(key).digest(), digest_size=16).digest(), "big")


def family_number(key: bytes, family: str, attempt: int = 0) -> int:
    """What a family name (canonical, one word) is made up from: one of 2**24."""
    return _drawn(key, f"family|{family}|{attempt}") % 16**6


def _made_up(number: int, syllables: list[str], n: int) -> str:
    return "".join(syllables[number >> (4 * i) & 15] for i in range(n)).capitalize()


def name_surrogate(key: bytes, name: str, gender: str, attempt: int = 0, words: int = 2, family_attempt: int = 0) -> str:
    """Drawn given names and a made-up family name, which depends on the last word alone. ``name`` is canonical. After some attempts given names are made up too, so that there are always more."""
    script = script_of(name)
    draw = _drawn(key, f"{gender}|{name}|{attempt}")
    last = _made_up(family_number(key, name.split(" ")[-1], family_attempt), SYLLABLES[script], 6)
    given = GIVEN[script, gender]
    if attempt < 6:
        parts = [given[draw // len(given) ** i % len(given)] for i in range(words - 1)]
    else:
        parts = [_made_up(draw >> (32 * i), SYLLABLES[script], 4 + min(attempt // 6, 4)) for i in range(words - 1)]
    return " ".join([*parts, last])


def surrogate(key: bytes, kind: str, text: str, gender: str = "n", attempt: int = 0, family_attempt: int = 0) -> str:
    """What stands for an entity in the form in which it is written here."""
    known = canonical(kind, text)
    if kind == "name":
        got = name_surrogate(key, known, gender, attempt, len(text.split()), family_attempt)
        return got.upper() if text.isupper() and len(text) > 1 else got
    if kind == "card":
        check = (int(known[-1]) - _luhn(known[:-1])) % 10
        body = permute_text(key, f"card{check}", known[:-1])
        return _pour(body + str((_luhn(body) + check) % 10), text)
    if kind == "phone":
        code = len(_CODES.match(known, 1)[0]) if known[0] == "+" else 0
        digits = known.lstrip("+")
        return _pour(digits[:code] + permute_text(key, f"phone{digits[:code]}", digits[code:]), text)
    if kind == "ssn":
        return _pour(permute_text(key, "ssn", known), text)
    if kind == "ip":
        return _ip(key, text)
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{permute_text(key, f'local|{domain.lower()}', local)}@{permute_text(key, 'host', host)}.{top}"
    if kind == "iban":
        body = permute_text(key, f"iban{known[:2]}", known[4:].lower()).upper()
        number = "".join(str(int(c, 36)) for c in body + known[:2] + "00")
        old = int("".join(str(int(c, 36)) for c in known[4:] + known[:4])) % 97
        checked = f"{(old - 1 + 98 - int(number) % 97) % 97:02d}" if old != 1 else f"{98 - int(number) % 97:02d}"
        it = iter(known[:2] + checked + body)
        return "".join(c if c == " " else next(it) for c in text)
    hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    got = text
    while True:  # no secret of one sort becomes one of another, where permutations could meet
        got = permute_text(key, "secret", got, [_HEX] if hexed else ALPHABETS)
        got = got.upper() if hexed and text.isupper() else got.lower() if hexed else got
        if (re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", got) is not None) == hexed and (not hexed or got.isupper() == text.isupper()):
            return got


def _bare(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, gender) of the mentions of names (canonical, to gender) in a text, longer names first."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for name in sorted(names, key=lambda n: (-len(n), n)):
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            if not word(at - 1) and not word(end) and all(w[0].isupper() for w in text[at:end].split(" ")):
                yield at, end, names[name]
            at = low.find(name, at + 1)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities, in order, none inside another; earlier kinds go first."""
    found: list[tuple[int, int, str, str]] = []
    some = _ANY.search(text) is not None
    for kind, pattern in KINDS.items():
        if not some and kind not in ("name", "secret"):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            gender = "n"
            if kind == "secret":
                start, end = m.span("v") if m["v"] else m.span("h")
            elif kind == "name":
                start, end = m.span("v")
                kept = []
                for w in m["v"].split(" "):
                    if not w[0].isupper():
                        break
                    kept.append(w)
                if not kept:
                    continue
                end, gender = start + len(" ".join(kept)), TITLES.get(m["t"] or m["u"], "n")
            elif kind == "phone" and not 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            if all(end <= a or start >= b for a, b, _, _ in found):
                found.append((start, end, kind, gender))
    titled: dict[str, str] = {}
    for start, end, kind, gender in found:
        if kind == "name":
            titled.setdefault(canonical(kind, text[start:end]), gender)
    for name in list(titled):
        titled.setdefault(name.split(" ")[-1], "n")
    for start, end, gender in _bare(text, titled) if titled else ():
        if all(end <= a or start >= b for a, b, _, _ in found):
            found.append((start, end, "name", gender))
    return sorted(found)


def _family_key(name: str) -> str:
    return f"family|{name.split(' ')[-1]}"


class Replacer:
    def __init__(self, key: bytes, attempts: dict[str, int]):
        self.key, self.attempts = key, attempts
        self._one = lru_cache(maxsize=50_000)(lambda kind, text, gender, attempt, family: surrogate(key, kind, text, gender, attempt, family))

    def __call__(self, text: str, attempts: dict[str, int] | None = None) -> tuple[str, list[str]]:
        out, at, kinds = [], 0, []
        for start, end, kind, gender in find(text):
            said = text[start:end]
            attempt = family = 0
            if kind == "name":
                known, again = canonical(kind, said), attempts or self.attempts
                attempt, family = again.get(f"{gender}|{known}", 0), again.get(_family_key(known), 0)
            if attempt >> _TRIES:
                gender, attempt = GENDERS[(attempt >> _TRIES) - 1], attempt & (1 << _TRIES) - 1
            out += [text[at:start], self._one(kind, said, gender, attempt, family)]
            at = end
            kinds.append(kind)
        return "".join([*out, text[at:]]), kinds


def redrawn_names(df: DataFrame, text_col: str, key: bytes) -> DataFrame:
    """(name, attempt) of the names that must draw again for all surrogates to be distinct, or have another gender than their title's.

    name is the title's gender and the canonical form; how attempt tells the gender, see ``_TRIES``. Family names that must draw again are there as family and the last word.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = {(f"{g}|{canonical(k, t[a:b])}", len(t[a:b].split())) for t in pdf["t"] for a, b, k, g in find(t) if k == "name"}
            yield pd.DataFrame(sorted(got), columns=["name", "words"])

    @F.pandas_udf("string")
    def drawn(name: pd.Series, words: pd.Series, attempt: pd.Series, family: pd.Series) -> pd.Series:
        return pd.Series([name_surrogate(key, n.partition("|")[2], n.partition("|")[0], a, w, f) for n, w, a, f in zip(name, words, attempt, family, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def made_up(name: pd.Series, words: pd.Series, attempt: pd.Series, family: pd.Series) -> pd.Series:
        return pd.Series([str(family_number(key, n, a)) for n, a in zip(name, attempt, strict=True)], dtype=object)

    def settled(state: DataFrame, draw) -> DataFrame:
        """state(name, words, attempt, family) when no two names draw the same."""
        while True:
            own = Window.partitionBy("s").orderBy("attempt", "name")
            ranked = state.withColumn("s", draw("name", "words", "attempt", "family")).withColumn("n", F.row_number().over(own))
            after = cut(ranked.select("name", "words", (F.col("attempt") + (F.col("n") > 1).cast("int")).alias("attempt"), "family", (F.col("n") > 1).alias("again")))
            state = after.drop("again")
            if after.filter("again").isEmpty():
                return state

    with_title = df.select(F.col(text_col).alias("t")).filter(F.col("t").rlike(TITLE_FILTER))
    said = cut(with_title.mapInPandas(names, "name string, words int").distinct().select(F.substring_index("name", "|", 1).alias("title"), F.expr("substring(name, 3)").alias("who"), "words"))
    told = F.array_sort(F.collect_set(F.when(F.col("title") != "n", F.col("title"))))
    people = said.groupBy("who").agg(F.max("words").alias("words"), told.alias("told")).select("who", "words", F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise(F.lit("n")).alias("gender"))
    people = cut(people)
    last = F.substring_index("who", " ", -1)
    families = cut(people.select(last.alias("name"), F.lit(1).alias("words"), F.lit(0).alias("attempt"), F.lit(0).alias("family")).distinct())
    families = settled(families, made_up).filter("attempt > 0").select(F.col("name").alias("last"), F.col("attempt").alias("family"))
    full = people.filter("words > 1").withColumn("last", last).join(families, "last", "left")
    state = settled(cut(full.select(F.concat_ws("|", "gender", "who").alias("name"), "words", F.lit(0).alias("attempt"), F.coalesce("family", F.lit(0)).alias("family"))), drawn)
    tries = state.filter("attempt > 0").select(F.expr("substring(name, 3)").alias("who"), "attempt")
    # Only what differs from a first draw by the title's gender goes on.
    other = said.select("title", "who").distinct().join(people.select("who", "gender"), "who").join(tries, "who", "left")
    bits = F.when(F.col("title") != F.col("gender"), F.shiftleft(F.instr(F.lit(GENDERS), F.col("gender")), _TRIES)).otherwise(F.lit(0))
    other = other.select(F.concat_ws("|", "title", "who").alias("name"), (F.coalesce("attempt", F.lit(0)) + bits).cast("int").alias("attempt"))
    return cut(other.filter("attempt > 0").unionByName(families.select(F.concat(F.lit("family|"), "last").alias("name"), F.col("family").alias("attempt"))))


def replace_entities(df: DataFrame, key: bytes, text_col: str = "text", few: int = 100_000) -> DataFrame:
    """``df`` with surrogates in the text, and two more columns: n_entities, and kinds (of the entities, in order, an array)."""
    small_batches(df.sparkSession)
    again = redrawn_names(df, text_col, key)
    head = again.limit(few + 1).collect()
    attempts, joined = ({r["name"]: r["attempt"] for r in head}, None) if len(head) <= few else ({}, again)
    shared = df.sparkSession.sparkContext.broadcast((key, attempts))

    @F.pandas_udf("text string, kinds array<string>")
    def replaced(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        replace = Replacer(*shared.value)
        for texts, own in batches:
            rows = []
            for t, names, tries in zip(texts, own["name"], own["attempt"], strict=True):
                mine = dict(zip(names, tries, strict=True)) if names is not None else None
                rows.append(replace(t, mine) if isinstance(t, str) else (None, []))
            yield pd.DataFrame(rows, columns=["text", "kinds"])

    base = df.drop("n_entities", "kinds")
    extra = fresh(base, "own_names")
    if joined is None:
        rows = base.withColumn(extra, F.lit(None).cast("struct<name:array<string>,attempt:array<int>>"))
    else:
        digest = fresh(base, "digest")

        def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = {(d, x) for d, t in zip(pdf["d"], pdf["t"], strict=True) for a, b, k, g in find(t) if k == "name" for known in [canonical(k, t[a:b])] for x in (f"{g}|{known}", _family_key(known))}
                yield pd.DataFrame(sorted(got), columns=["d", "name"])

        said = df.select(F.xxhash64(text_col).alias("d"), F.col(text_col).alias("t")).filter(F.col("t").rlike(TITLE_FILTER)).mapInPandas(mentions, "d long, name string").distinct()
        own = said.join(joined, "name").groupBy(F.col("d").alias(digest)).agg(F.struct(F.collect_list("name").alias("name"), F.collect_list("attempt").alias("attempt")).alias(extra))
        rows = base.withColumn(digest, F.xxhash64(text_col)).join(own, digest, "left").drop(digest)
    got = fresh(rows, "replaced")
    out = rows.withColumn(got, replaced(F.col(text_col), F.col(extra)))
    columns = [F.col(f"{got}.text").alias(c) if c == text_col else F.col(c) for c in base.columns]
    return out.select(*columns, F.size(f"{got}.kinds").cast("long").alias("n_entities"), F.col(f"{got}.kinds").alias("kinds"))

