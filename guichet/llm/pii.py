"""Personal data: keyed surrogates that keep type, format, script and gender."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from guichet.llm.common import by_bytes, internal, on_workers, tidy
from guichet.operators.settle import is_small, join_side, settle, stage

KEY = b"guichet surrogate key"
TYPES = ["secret", "email", "iban", "card", "ssn", "phone", "ip", "person"]

# Honorifics with the gender they tell, scripts by their ranges of characters, and
# given names by script and gender.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Herr": "m", "Frau": "f",
    "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f",
    "κύριος": "m", "κυρία": "f", "Κύριος": "m", "Κυρία": "f",
    "السيد": "m", "السيدة": "f", "מר": "m", "גברת": "f",
}
SCRIPTS = {
    "cyrillic": "\u0400-\u04ff", "greek": "\u0370-\u03ff\u1f00-\u1fff", "hebrew": "\u0590-\u05ff",
    "arabic": "\u0600-\u06ff", "hiragana": "\u3040-\u309f", "katakana": "\u30a0-\u30ff",
    "han": "\u3400-\u4dbf\u4e00-\u9fff", "hangul": "\uac00-\ud7a3",
}
CASELESS = ["hebrew", "arabic", "hiragana", "katakana", "han", "hangul"]
GIVEN = {
    "latin": {
        "m": "Adam Alan Andrew Anthony Arthur Brian Carl Daniel David Edward Eric Frank George Henry James John Julian Kevin Leon Louis Mark Martin Michael Oscar Paul Peter Robert Samuel Thomas Victor".split(),
        "f": "Alice Amelia Andrea Anna Beatrice Carla Caroline Clara Diana Elena Elise Emma Eva Grace Helen Irene Julia Karen Laura Lucy Maria Martha Nina Nora Olivia Paula Rosa Sarah Sofia Vera".split(),
        "": "Alex Ariel Charlie Chris Dominique Jamie Jordan Kim Lee Morgan Noel Pat Robin Sam Sasha Taylor".split(),
    },
    "cyrillic": {
        "m": "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
        "f": "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Светлана Софья Татьяна".split(),
        "": "Саша Женя Валя Шура".split(),
    },
    "greek": {
        "m": "Αντώνης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
        "f": "Άννα Βασιλική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
        "": "Αλέξ Κρις Ντένης Φίλη".split(),
    },
    "hebrew": {
        "m": "אברהם דוד יוסף יעקב משה שמואל".split(),
        "f": "אסתר דבורה לאה מרים רחל שרה".split(),
        "": "גל טל נועם עדי".split(),
    },
    "arabic": {
        "m": "أحمد حسن خالد عمر محمود يوسف".split(),
        "f": "أمينة خديجة زينب سارة فاطمة ليلى".split(),
        "": "إحسان صباح نور وسام".split(),
    },
    "hiragana": {"m": "けんじ たろう ひろし まさお".split(), "f": "あきこ さくら はなこ ゆみ".split(), "": "あおい ひかる まこと".split()},
    "katakana": {"m": "ケンジ タロウ ヒロシ マサオ".split(), "f": "アキコ サクラ ハナコ ユミ".split(), "": "アオイ ヒカル マコト".split()},
    "han": {"m": "伟 强 建国 志明 健 浩".split(), "f": "芳 秀英 丽 美玲 娟 静".split(), "": "文 平 宁 晓".split()},
    "hangul": {"m": "민준 서준 영수 지훈".split(), "f": "서연 수진 영희 지은".split(), "": "지우 하늘 현".split()},
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve wa".split(),
    "cyrillic": "ба ве во га да де ко ла ле ло ма ме мо на не но па ре ро са се та те то".split(),
    "greek": "βα βε γα γο δα δε κα κο λα λε μα με να νο πα πο ρα ρο σα σο τα το".split(),
    "hebrew": "בא בו גי דו די לי לו מי מו ני נו רי רו שי שו תי".split(),
    "arabic": "با بو دا دي را رو سا سي فا كا لا لي ما مي نا نو".split(),
    "hiragana": "あ い う え お か き こ さ し た な に の ま み も や ら り".split(),
    "katakana": "ア イ ウ エ オ カ キ コ サ シ タ ナ ニ ノ マ ミ モ ヤ ラ リ".split(),
    "han": "王 李 张 刘 陈 杨 赵 黄 周 吴 林 高 文 明 安 平 华 国 海 江 山 石 金 玉 春 秋".split(),
    "hangul": "가 나 다 라 마 바 사 아 자 하 고 노 도 로 모 보 소 오 조 호".split(),
}
# Syllables of a family name, where a character is one: fewer.
STEM = {"han": 3, "hangul": 3}
# Attempts with the entity's own shape; each one after these adds a character, so that the
# surrogates are always more than the entities. A free text needs few: only a short or mostly
# fixed one collides twice.
OWN_SHAPE = {"secret": 2, "email": 2}
OWN_FORMAT = 16
ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ENDINGS = {script: {"m": "", "f": "", "": ""} for script in SYLLABLES} | {"cyrillic": {"m": "нов", "f": "нова", "": "ненко"}}

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+(?:[^\W\d_]{2,}|xn--[A-Za-z0-9-]+)(?![\w-])")
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|pk)[_-][A-Za-z0-9_-]{16,}"
    r"|(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}"
    r"(?:\"(?P<quoted>[^\"\s]{6,})\"|'(?P<single>[^'\s]{6,})'|(?P<plain>[^\s\"',;<>]{6,}))",
    re.I,
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?![\d-])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
)
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{3,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w]|:\w)")
# In a script without capitals a name is one word: nothing tells where a longer one ends.
_CASELESS = "".join(SCRIPTS[script] for script in CASELESS)
_NAME = rf"[^\W\d_a-zà-ÿа-яά-ώ{_CASELESS}][\w’'-]+"
_PERSON = re.compile(
    rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? "
    rf"((?:{_NAME} ){{0,2}}{_NAME}|(?!\d)\b[{_CASELESS}][\w’'-]+)"
)
_WORD = re.compile(r"\w+")
_SCRIPT = re.compile("|".join(f"(?P<{script}>[{ranges}])" for script, ranges in SCRIPTS.items()))
_HAS_DIGIT = re.compile(r"[0-9]")
# A text in lower case without any of these holds no secret.
_SIGNS_OF_SECRETS = ("akia", "asia", "ghp", "gho", "ghs", "glpat", "xox", "sk_", "sk-", "pk_", "pk-", "passw", "pwd", "secret", "token", "key")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_ok(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


Mention = tuple[int, int, str, str]


def _merged(found: list[Mention], more: Iterable[Mention]) -> list[Mention]:
    """Both in order, without those of ``more`` that overlap one of ``found``; each has no
    overlaps of its own and is in order."""
    out, at = [], 0
    for mention in more:
        while at < len(found) and found[at][1] <= mention[0]:
            out.append(found[at])
            at += 1
        if at == len(found) or mention[1] <= found[at][0]:
            out.append(mention)
    return out + found[at:]


def _numbered(text: str) -> Iterator[Iterator[Mention]]:
    """The mentions of each type that has digits."""

    def checked(kind: str, pattern: re.Pattern, normal) -> Iterator[Mention]:
        for m in pattern.finditer(text):
            entity = normal(m[0])
            if entity:
                yield m.start(), m.end(), kind, entity

    def iban(found: str) -> str:
        bare = found.replace(" ", "")
        return bare if _iban_ok(bare) else ""

    def card(found: str) -> str:
        digits = _only_digits(found)
        return digits if luhn(digits) and len(set(digits)) > 1 else ""

    def phone(found: str) -> str:
        digits = _only_digits(found)
        return digits if 8 <= len(digits) <= 15 else ""

    def ip(found: str) -> str:
        parts = found.split(".")
        return ".".join(str(int(x)) for x in parts) if all(int(x) < 256 for x in parts) else ""

    def ip6(found: str) -> str:
        try:
            return str(ipaddress.IPv6Address(found)) if _HAS_DIGIT.search(found) else ""
        except ipaddress.AddressValueError:
            return ""

    yield checked("iban", _IBAN, iban)
    yield checked("card", _CARD, card)
    yield checked("ssn", _SSN, _only_digits)
    yield checked("phone", _PHONE, phone)
    yield checked("ip", _IP, ip)
    yield checked("ip", _IP6, ip6)


def _bare_names(text: str, people: Mapping[str, str]) -> Iterator[Mention]:
    """Where names of ``people`` stand as whole words: the longest at each word, from the left.

    A word is looked up by the lengths of the names that begin with it, so the time does not
    depend on how many names there are.
    """
    lengths: dict[str, set[int]] = {}
    for name in people:
        lengths.setdefault(_WORD.match(name)[0], set()).add(len(name))
    by_word = {word: sorted(own, reverse=True) for word, own in lengths.items()}
    behind = 0
    for m in _WORD.finditer(text):
        start = m.start()
        if start < behind:
            continue
        for n in by_word.get(m[0], ()):
            name = text[start : start + n]
            if name in people and not _WORD.match(text, start + n):
                behind = start + n
                yield start, behind, "person", people[name]
                break


def mentions(text: str) -> list[Mention]:
    """(start, end, type, entity) of what is found, in order and without overlap.

    The entity is what mentions of the same thing share: an email in lower case, the digits
    of a number, the shortest form of an address, a person's gender and names. Where patterns
    overlap the first of TYPES wins. Once a title has told a person, the bare full or family name
    is the same person. A title that tells no gender takes the one that the same name has
    elsewhere in the text. The time is in proportion to the text, however many mentions it has.
    """
    found: list[Mention] = []
    lower = text.lower()
    if any(w in lower for w in _SIGNS_OF_SECRETS):
        secrets = ((m, m.lastgroup or 0) for m in _SECRET.finditer(text))
        found = [(m.start(group), m.end(group), "secret", m[group]) for m, group in secrets]
    if "@" in text:
        found = _merged(found, ((m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)))
    if _HAS_DIGIT.search(text):
        for own in _numbered(text):
            found = _merged(found, own)
    if any(t in text for t in TITLES):
        people: dict[str, str] = {}
        titled = list(_PERSON.finditer(text))
        told: dict[str, set[str]] = {}
        for m in titled:
            if TITLES[m[1]]:
                told.setdefault(m[2], set()).add(TITLES[m[1]])
        # A family name alone is the person that has it with a given name, as below.
        for name, genders in list(told.items()):
            if " " in name and name.rpartition(" ")[2] not in told:
                told.setdefault("|" + name.rpartition(" ")[2], set()).update(genders)
        persons = []
        for m in titled:
            *given, family = m[2].split(" ")
            known = told.get(m[2]) or told.get("|" + m[2]) or set()
            gender = TITLES[m[1]] or (min(known) if len(known) == 1 else "")
            entity = "|".join([gender, " ".join(given), family])
            persons.append((m.start(2), m.end(2), "person", entity))
            people.setdefault(m[2], entity)
        for entity in list(people.values()):
            if not entity.split("|")[1]:
                continue
            people.setdefault(entity.split("|")[2], entity)
        found = _merged(_merged(found, persons), _bare_names(text, people))
    return found


def _named(found: list[Mention]) -> set[tuple[str, str]]:
    """``type, entity`` of the mentions, and of the families of the persons among them."""
    own = {m[2:] for m in found}
    return own | {("family", e.rpartition("|")[2]) for k, e in own if k == "person"}


class Surrogates:
    """Replacements that depend only on the key, the type, the entity and the attempt.

    A family is an entity of its own, so all persons of one family share its surrogate.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def numbers(self, *parts: str) -> Iterator[int]:
        name, counter = "\x1f".join(parts).encode(), 0
        while True:
            block = hashlib.blake2b(name, key=self.key, salt=counter.to_bytes(8, "little")).digest()
            for i in range(0, 64, 4):
                yield int.from_bytes(block[i : i + 4], "little")
            counter += 1

    def _shaped(self, text: str, numbers: Iterator[int]) -> str:
        """Each character becomes another of its class: digit, case and script stay."""
        hexadecimal = re.fullmatch(r"[0-9a-f]{8,}", text) and _HAS_DIGIT.search(text) and not text.isdigit()
        out = []
        for c in text:
            n = next(numbers)
            if hexadecimal:
                out.append("0123456789abcdef"[n % 16])
            elif c.isdigit():
                out.append("0123456789"[n % 10])
            elif not c.isalpha():
                out.append(c)
            else:
                first, last = ("а", "я") if "а" <= c.lower() <= "я" else ("α", "ω") if "α" <= c.lower() <= "ω" else ("a", "z")
                if c.lower() == c.upper():  # scripts without case
                    out.append(chr(ord(c) - ord(c) % 16 + n % 16) if chr(ord(c) - ord(c) % 16 + n % 16).isalpha() else c)
                else:
                    new = chr(ord(first) + n % (ord(last) - ord(first) + 1))
                    out.append((new if new != "ς" else "σ").upper() if c.isupper() else new)
        return "".join(out)

    def _stem(self, family: str, attempt: int) -> str:
        numbers = self.numbers("family", family, str(attempt))
        syllables = SYLLABLES[_script(family)]
        return "".join(syllables[next(numbers) % len(syllables)] for _ in range(STEM.get(_script(family), 4) + attempt))

    def _given(self, gender: str, given: str, numbers: Iterator[int], attempt: int) -> str:
        """As many given names; from the third attempt on the last one has hyphens."""
        names = GIVEN[_script(given)][gender]
        own = " ".join(names[next(numbers) % len(names)] for _ in given.split(" "))
        return "-".join([own, *[names[next(numbers) % len(names)] for _ in range(attempt - 1)]])

    def forms(self, kind: str, entity: str, attempt: int) -> list[str]:
        """What must differ from that of other entities: the surrogate, or a family with every
        ending, or the given names of a person within the family. A family name alone has
        only its family."""
        if kind == "family":
            return sorted({self._stem(entity, attempt) + end for end in ENDINGS[_script(entity)].values()})
        if kind == "person":
            gender, given, family = entity.split("|")
            return [f"{self._given(gender, given, self.numbers(kind, entity, str(attempt)), attempt)}|{family}"] if given else []
        return [self.of(kind, entity, attempt)]

    def of(self, kind: str, entity: str, attempt: int = 0, family_attempt: int = 0) -> str:
        """The surrogate of an entity, in the same normal form as the entity."""
        numbers = self.numbers(kind, entity, str(attempt))
        more = max(0, attempt - OWN_SHAPE.get(kind, OWN_FORMAT))

        def any_of(characters: str, n: int) -> str:
            return "".join(characters[next(numbers) % len(characters)] for _ in range(n))

        if kind == "person":
            gender, given, family = entity.split("|")
            own = self._given(gender, given, numbers, attempt) if given else ""
            new = self._stem(family, family_attempt) + ENDINGS[_script(family)][gender]
            return f"{gender}|{own}|{new.capitalize()}"
        if kind == "family":
            return self._stem(entity, attempt)
        if kind == "email":
            local, _, domain = entity.rpartition("@")
            hosts = self.numbers("domain", domain)
            script = _script(domain)
            letters = [chr(97 + i) for i in range(26)] if script == "latin" else SYLLABLES[script]
            label = "".join(letters[next(hosts) % len(letters)] for _ in range(8))
            top = domain.rpartition(".")[2]
            return f"{self._shaped(local, numbers)}{any_of(ALPHANUMERIC[26:], more)}@{label}.example.{top if top in ('com', 'net', 'org') else 'com'}"
        if kind == "card":
            body = entity[0] + self._shaped(entity[1:-1], numbers) + any_of("0123456789", more)
            return body + next(d for d in "0123456789" if luhn(body + d))
        if kind == "iban":
            body = self._shaped(entity[4:], numbers) + any_of("0123456789", more)
            turned = "".join(str(int(c, 36)) for c in body + entity[:2] + "00")
            return f"{entity[:2]}{98 - int(turned) % 97:02d}{body}"
        if kind == "ip" and ":" in entity:
            # The digits of every group but the first digit of all; no group becomes empty or zero.
            groups = [any_of("123456789abcdef", 1) + any_of("0123456789abcdef", len(x) - 1) if x else "" for x in entity.split(":")]
            return entity[0] + ":".join(groups)[1:] + any_of("0123456789abcdef", more)
        if kind == "ip":
            return ".".join(str(1 + next(numbers) % 223 if i == 0 else next(numbers) % 256) for i in range(4 + more))
        if kind == "phone":
            kept = len(entity) - 10 if len(entity) > 10 else 0  # the country code
            return entity[:kept] + str(2 + next(numbers) % 8) + self._shaped(entity[kept + 1 :], numbers) + any_of("0123456789", more)
        if kind == "secret":
            if entity[:4] in ("AKIA", "ASIA"):
                new = entity[:4] + any_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", len(entity) - 4)
            elif any(c.isdigit() or c.isalpha() for c in entity):
                new = self._shaped(entity, numbers)
            else:  # a masked secret, or one of signs only: its shape has no other text
                new = any_of(ALPHANUMERIC, len(entity))
            return new + any_of(ALPHANUMERIC, more)
        return self._shaped(entity, numbers) + any_of("0123456789", more)


def _script(name: str) -> str:
    """The script of the first character that is in one of SCRIPTS, else Latin."""
    found = _SCRIPT.search(name)
    return found.lastgroup if found else "latin"


def rendered(kind: str, mention: str, entity: str, surrogate: str) -> str:
    """The surrogate laid out as this mention is."""
    if kind == "person":
        _, given, family = surrogate.split("|")
        own = entity.split("|")
        if mention == own[2] or not own[1]:
            new = family
        else:
            new = f"{given} {family}"
        return new.upper() if mention.isupper() else new
    if kind in ("card", "phone", "ssn", "iban"):
        letters = iter(surrogate)
        return "".join(next(letters) if c.isalnum() else c for c in mention) + "".join(letters)
    if (kind == "email" or ":" in surrogate and kind == "ip") and mention.isupper():
        return surrogate.upper()
    return surrogate


def _entities(docs: DataFrame) -> DataFrame:
    """``type, entity`` of all entities, each once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {m[2:] for t in batch.column(0).to_pylist() for m in mentions(t or "")}
            own = sorted(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.string())], ["type", "entity"]
            )

    return docs.select("text").mapInArrow(tidy(find), "type string, entity string").distinct()


def colliding(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``type, entity, attempt`` of the entities whose first surrogate cannot stand.

    A surrogate must differ from those of all other entities and from all entities. The
    families of persons are settled as entities of type ``family``, with every ending and in
    lower case, and persons by their given names within the family; so two persons differ
    as they are written, whatever their gender, and a family is written alike everywhere. Among
    equal ones the lowest (attempt, entity) stays and the others try again, until none is left;
    a surrogate that stays is never taken away by a later attempt. Surrogates grow with the
    attempt, so however many entities share a shape, there is an end.
    """
    on_workers(entities.sparkSession)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            rows = [(k, e, a, f) for k, e, a in zip(*(c.to_pylist() for c in batch.columns)) for f in make.forms(k, e, a)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["type", "entity", "attempt", "surrogate"])

    entities = stage(entities.select("type", "entity"))
    family = F.substring_index("entity", "|", -1)
    families = entities.where("type = 'person'").select(F.lit("family").alias("type"), family.alias("entity")).distinct()
    entities = entities.unionByName(stage(families))
    tried = settle(entities.limit(0).withColumn("attempt", F.lit(0)))
    same_case = F.when(F.col("type") == "family", F.lower("entity")).otherwise(F.col("entity"))
    names = entities.select("type", same_case.alias("surrogate"))
    while True:
        now = join_side(entities, tried, ["type", "entity"], "left").select("type", "entity", F.coalesce("attempt", F.lit(0)).alias("attempt"))
        assigned = stage(now.mapInArrow(tidy(assign), "type string, entity string, attempt int, surrogate string"))
        shared = (
            assigned.groupBy("type", "surrogate")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "entity")).alias("first"))
            .where("n > 1")
        )
        again = (
            assigned.join(shared, ["type", "surrogate"])
            .where((F.col("attempt") != F.col("first.attempt")) | (F.col("entity") != F.col("first.entity")))
            .select("type", "entity", "attempt")
            .unionByName(assigned.join(names, ["type", "surrogate"], "left_semi").select("type", "entity", "attempt"))
            .distinct()
        )
        again = settle(again.withColumn("attempt", F.col("attempt") + 1))
        if again.isEmpty():
            return tried
        tried = settle(tried.join(again, ["type", "entity"], "left_anti").unionByName(again))


def _replaced(text: str, make: Surrogates, attempts: Mapping[tuple[str, str], int]) -> tuple[str, list[Mention]]:
    found = mentions(text)
    if not found:
        return text, found
    out, at, made = [], 0, {}
    for start, end, kind, entity in found:
        if (kind, entity) not in made:
            family = attempts.get(("family", entity.rpartition("|")[2]), 0) if kind == "person" else 0
            made[kind, entity] = make.of(kind, entity, attempts.get((kind, entity), 0), family)
        out += [text[at:start], rendered(kind, text[start:end], entity, made[kind, entity])]
        at = end
    return "".join([*out, text[at:]]), found


def replace(
    docs: DataFrame, key: bytes = KEY, text_col: str = "text", counts: str | None = None, length_col: str | None = None
) -> DataFrame:
    """``docs`` with all columns, and the personal data in ``text_col`` replaced.

    Surrogates depend on the key and the entity, so an entity has the same one in every
    document and run. A first pass gathers the distinct entities and settles collisions;
    their few exceptions are broadcast if they were counted and are small, else they are
    joined to the documents that mention them. ``counts`` names a column to add: an array with
    the number of mentions of each of TYPES, in place of one of that name. ``length_col`` names a column that is to hold the
    new number of characters.

    A null text stays null, a text without entities stays as it is, repeated rows get equal
    texts, an empty table stays empty, and other columns are carried along.
    """
    spark = docs.sparkSession
    on_workers(spark)
    docs = docs.drop(counts) if counts else docs
    texts = internal(docs, text=text_col)
    exceptions = colliding(_entities(texts), key)
    broadcast = is_small(exceptions)
    known = {(r["type"], r["entity"]): r["attempt"] for r in exceptions.collect()} if broadcast else {}
    shared = spark.sparkContext.broadcast(known)
    schema = docs.schema
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    if counts:
        schema = type(schema)(schema.fields[:]).add(counts, ArrayType(IntegerType()))
    rows = docs if broadcast else _with_exceptions(docs, text_col, exceptions)
    width = len(docs.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in by_bytes(batches, at):
            own = batch.column(width).to_pylist() if batch.num_columns > width else [None] * batch.num_rows
            new, numbers = [], []
            for t, extra in zip(batch.column(at).to_pylist(), own):
                attempts = shared.value if extra is None else {(x["type"], x["entity"]): x["attempt"] for x in extra}
                text, found = (None, []) if t is None else _replaced(t, make, attempts)
                new.append(text)
                numbers.append([sum(m[2] == kind for m in found) for kind in TYPES])
            columns = list(batch.columns[:width])
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                lengths = [None if t is None else len(t) for t in new]
                columns[length_at] = pa.array(lengths).cast(columns[length_at].type)
            if counts:
                columns.append(pa.array(numbers, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(tidy(apply), schema)


def _with_exceptions(docs: DataFrame, text_col: str, exceptions: DataFrame) -> DataFrame:
    """``docs`` with one more column: the exceptions among the entities of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, k, e) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, e in _named(mentions(t or ""))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())],
                ["name", "type", "entity"],
            )

    # A text is named by its hash; two texts of one hash would only share their exceptions.
    name = F.xxhash64(F.col(f"`{text_col}`"))
    per_text = (
        docs.select(name.alias("name"), F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(tidy(find), "name long, type string, entity string")
        .distinct()
        .join(exceptions, ["type", "entity"])
        .groupBy("name")
        .agg(F.collect_list(F.struct("type", "entity", "attempt")).alias("attempts"))
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    none = F.array().cast("array<struct<type:string,entity:string,attempt:int>>")
    return whole.join(per_text, "name", "left").select("row.*", F.coalesce("attempts", none))
