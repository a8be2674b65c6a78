"""Surrogates for personal data: keyed, consistent over the corpus, distinct, and of the original's kind and format."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, small_batches

#: Rounds in which proposals keep an entity's length and range; one or two are usual. Each later round draws from a larger
#: domain (a longer value, a wider range), so that the rounds end for any set of entities.
SAME_FORMAT = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERN = re.compile(
    "|".join(
        (
            r"(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)",
            r"(?i:\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passw(?:or)?d|pwd)\b)[\"']?\s*(?:=|:)\s*[\"']?(?P<assigned>(?=[_+/.~-]*[A-Za-z0-9])[A-Za-z0-9_+/.~-]{8,})",
            r"(?P<key>\b(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bAKIA[0-9A-Z]{16}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})",
            r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)",
            r"(?P<mac>\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b)",
            r"(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:]))",
            rf"(?P<ipv4>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w-])(?:\d{4}([ -])\d{4}\10\d{4}\10\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-]))".replace("\\10", "(?P=gap)").replace("([ -])", "(?P<gap>[ -])", 1),
            r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ ./-]?\(?\d{1,4}\)?){2,7}(?!\w)|(?<![\w+.,])0\d(?:[ .-]\d{2}){4}(?!\w)|(?<![\w+.,-])\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]?\d{3,4}(?![\w-]))",
            r"(?P<hex>(?<!\w)(?=[a-f]*\d)[0-9a-f]{32,128}(?!\w)|(?<!\w)(?=[A-F]*\d)[0-9A-F]{32,128}(?!\w))",
        )
    )
)
_KINDS = {"assigned": "secret", "key": "secret", "hex": "secret", "pem": "secret"}

_UPPER = "A-ZÀ-ÖØ-ÞŁŚŻŽČŠΆΈ-ΏΑ-ΩЀ-Я"
_TOKEN = rf"(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sr|Sra)\.|[{_UPPER}][\w'’-]*)"
_CAPITALS = re.compile(rf"(?<![\w'’]){_TOKEN}(?:[ ]{_TOKEN})+")
_CAPITAL = re.compile(rf"(?<![\w'’])[{_UPPER}][\w'’-]*")
# Forms of address and frequent given names by gender, in Latin, Greek and Cyrillic script.
_TITLES = {
    "m": ("Mr", "Mr.", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Don", "Signor", "Господин", "Κύριος"),
    "f": ("Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra.", "Señorita", "Signora", "Госпожа", "Κυρία"),
    "x": ("Dr", "Dr.", "Prof", "Prof.", "Mx", "Mx."),
}
_GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Steven", "Paul", "Andrew", "George", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Jean", "Pierre", "Michel", "Jacques", "Louis", "François", "Carlos", "José", "Juan", "Luis", "Miguel", "Pedro", "Javier", "Joseph", "Christopher", "Kevin", "Brian", "Edward", "Ahmed", "Mohammed", "Muhammad", "Omar", "Hassan", "Ibrahim", "Wei", "Hiroshi", "Kenji", "Raj", "Rahul", "Arjun", "Giuseppe", "Giovanni", "Marco", "João", "Piotr", "Tomasz", "Lars", "Sven", "Tom", "Max", "Ben", "Jack", "Harry", "Oliver", "Adam", "Eric", "Frank", "Henry", "Patrick", "Ryan", "Jason", "Felix", "Lukas", "Jonas", "Иван", "Алексей", "Дмитрий", "Сергей", "Николай", "Γιώργος", "Νίκος", "Δημήτρης"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Emily", "Emma", "Olivia", "Anna", "Maria", "Alice", "Jane", "Ursula", "Sabine", "Petra", "Monika", "Heike", "Marie", "Jeanne", "Françoise", "Isabelle", "Nathalie", "Carmen", "María", "Ana", "Laura", "Lucía", "Rebecca", "Michelle", "Amanda", "Stephanie", "Catherine", "Fatima", "Aisha", "Layla", "Mei", "Yuki", "Sakura", "Priya", "Ananya", "Giulia", "Francesca", "Katarzyna", "Agnieszka", "Ingrid", "Astrid", "Kate", "Julia", "Sophie", "Hannah", "Helen", "Clara", "Lena", "Nina", "Eva", "Sara", "Rachel", "Megan", "Мария", "Анна", "Елена", "Ольга", "Наталья", "Μαρία", "Ελένη", "Κατερίνα"),
}
_GIVEN["x"] = ("Alex", "Sam", "Chris", "Robin", "Jamie", "Casey")
# Country codes of one and of two digits; all others have three.
_COUNTRY_1 = ("1", "7")
_COUNTRY_2 = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_TITLE_OF = {t: g for g, names in _TITLES.items() for t in names}
_GENDER_OF = {n: g for g, names in _GIVEN.items() for n in names}
# Chinese surnames, and forms of address after a Chinese name and before an Arabic one, by gender.
_HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
_HAN_TITLES = {"m": ("先生",), "f": ("女士", "小姐", "太太", "夫人"), "x": ("教授", "博士", "医生", "老师")}
_ARABIC_TITLES = {"m": ("السيد", "الدكتور", "الأستاذ"), "f": ("السيدة", "الآنسة", "الدكتورة", "الأستاذة")}
_HAN_GENDER = {t: g for g, names in _HAN_TITLES.items() for t in names}
_ARABIC_GENDER = {t: g for g, names in _ARABIC_TITLES.items() for t in names}
_HAN = re.compile(rf"([{_HAN_SURNAMES}])([\u4e00-\u9fff]{{0,2}}?)(?:{'|'.join(_HAN_GENDER)})")
_ARABIC = re.compile(rf"(?<![\u0621-\u064A])(?:{'|'.join(sorted(_ARABIC_GENDER, key=len, reverse=True))}) ([\u0621-\u064A]{{2,}})(?: (ال[\u0621-\u064A]{{2,}}))?")
# Syllables and endings of invented names, by script and gender.
_SYLLABLES = {
    "latin": ("ba", "bel", "cor", "da", "del", "el", "fa", "gal", "ha", "jo", "ka", "lan", "ma", "mar", "ne", "nor", "pa", "quil", "ra", "ro", "sa", "sil", "ta", "tor", "ul", "va", "ver", "wil", "ya", "zan"),
    "greek": ("βα", "γα", "δη", "ελ", "ζα", "θε", "κα", "λε", "μα", "νι", "ξα", "πα", "ρο", "σο", "τα", "φι", "χα"),
    "cyrillic": ("ба", "ва", "га", "да", "же", "за", "ка", "ла", "ма", "на", "по", "ра", "са", "та", "фе", "хо", "ше"),
    "arabic": ("با", "تا", "جا", "دا", "را", "زا", "سا", "شا", "عا", "فا", "كا", "لا", "ما", "نا", "وا", "يا"),
    "han": ("安", "春", "德", "飞", "光", "海", "江", "金", "立", "民", "庆", "瑞", "山", "天", "旭", "远", "泽", "志"),
}
_ENDS = {
    ("latin", "m"): ("on", "us", "ert", "old"), ("latin", "f"): ("a", "ia", "ina", "elle"), ("latin", "x"): ("en", "is"), ("latin", "s"): ("man", "son", "ley", "well", "ard"),
    ("greek", "m"): ("ος", "ης"), ("greek", "f"): ("α", "η"), ("greek", "x"): ("ις",), ("greek", "s"): ("ίδης", "όπουλος", "άκης"),
    ("cyrillic", "m"): ("н", "лав", "мир"), ("cyrillic", "f"): ("на", "ия"), ("cyrillic", "x"): ("ль",), ("cyrillic", "s"): ("енко", "ский", "ец"),
    ("arabic", "m"): ("ن", "د", "م"), ("arabic", "f"): ("ة", "اء"), ("arabic", "x"): ("ي",), ("arabic", "s"): ("اوي", "اني"),
    ("han", "m"): ("刚", "强", "军", "伟", "勇"), ("han", "f"): ("芳", "娟", "丽", "娜", "婷"), ("han", "x"): ("宁", "文"), ("han", "s"): ("石", "汤", "白", "龙", "万", "段", "钱", "汪", "田", "任"),
}
#: Letters that stand for others of their script: (first and last code of the script, first and last letter drawn).
_LETTERS = (
    (0x370, 0x3FF, 0x3B1, 0x3C1), (0x400, 0x52F, 0x430, 0x44F), (0x590, 0x5FF, 0x5D0, 0x5EA), (0x600, 0x6FF, 0x641, 0x64A), (0x900, 0x97F, 0x915, 0x939), (0xE00, 0xE7F, 0xE01, 0xE2E),
    (0x3040, 0x309F, 0x304B, 0x3062), (0x30A0, 0x30FF, 0x30AB, 0x30C2), (0x4E00, 0x9FFF, 0x4E00, 0x9FA5), (0xAC00, 0xD7A3, 0xAC00, 0xD7A3),
)
#: Beginnings of IPv6 addresses that a surrogate keeps: for documentation, of a link, private, for groups.
_PREFIXES = ("2001:db8:", "fe80:", "fc", "fd", "ff")
#: Networks that a surrogate address stays in.
_NETWORKS = (("10",), ("127",), ("0",), ("192", "168"), ("169", "254"), ("192", "0", "2"), ("198", "51", "100"), ("203", "0", "113"))


def script_of(name: str) -> str:
    for script, letters in (("greek", r"[Ͱ-Ͽἀ-῿]"), ("cyrillic", r"[Ѐ-ӿ]"), ("arabic", r"[\u0600-\u06ff]"), ("han", r"[\u4e00-\u9fff]")):
        if re.search(letters, name):
            return script
    return "latin"


def _names_without_capitals(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Chinese names before a form of address, and wherever their full form is; Arabic names after one."""
    full: dict[str, str] = {}
    for m in _HAN.finditer(text):
        gender = _HAN_GENDER[text[m.end(2) : m.end()]]
        yield m.start(1), m.end(1), "name-s-han", m.group(1)
        if m.group(2):
            yield m.start(2), m.end(2), f"given-{gender}-han", m.group(2)
            full.setdefault(m.group(1) + m.group(2), gender)
    for name, gender in full.items():
        for m in re.finditer(name, text):
            yield m.start(), m.start() + 1, "name-s-han", name[0]
            yield m.start() + 1, m.end(), f"given-{gender}-han", name[1:]
    for m in _ARABIC.finditer(text):
        gender = _ARABIC_GENDER[text[m.start() : m.start(1) - 1]]
        yield m.start(1), m.end(1), f"given-{gender}-arabic", m.group(1)
        if m.group(2):
            yield m.start(2), m.end(2), "name-s-arabic", m.group(2)


def normal_name(word: str) -> str:
    """One form of a name for all its spellings: composed letters, one apostrophe, no case."""
    return unicodedata.normalize("NFC", word).replace("’", "'").casefold()


def _names(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """Names by a title or a listed given name: (start, end, kind, normal form, whether a title tells the gender)."""
    for run in _CAPITALS.finditer(text):
        words = [(m.start() + run.start(), m.group()) for m in re.finditer(r"[^ ]+", run.group())]
        k = 0
        while k < len(words) - 1:
            at, word = words[k]
            title = _TITLE_OF.get(word)
            listed = _GENDER_OF.get(words[k + 1][1] if title else word)
            if title is None and listed is None:
                k += 1
                continue
            # A title says more than a list: Ms. Jean is a woman.
            sure = title in ("m", "f")
            gender = title if sure else listed or title
            k += title is not None
            parts = []
            if listed or title and k + 1 < len(words) and _plain(words[k + 1][1]) and _plain(words[k][1]):
                parts.append((words[k], f"given-{gender}"))
                k += 1
            if k < len(words) and _plain(words[k][1]):
                parts.append((words[k], "name-s"))
                k += 1
            if title is None and len(parts) < 2:
                continue
            for (start, name), kind in parts:
                name = re.sub(r"(?:['’]s)$", "", name)
                if _plain(name):
                    yield start, start + len(name), f"{kind}-{script_of(name)}", normal_name(name), sure


def _one_gender(named: list[tuple[int, int, str, str, bool]]) -> list[tuple[int, int, str, str]]:
    """The names of one text, each given name in one gender: that of its titles, else the list's, else none.

    If titles of both genders stand before one name there are two persons: then those mentions keep theirs, and the others
    are the first one's.
    """
    told: dict[str, list[str]] = {}
    for _, _, kind, value, sure in named:
        if kind.startswith("given"):
            held = told.setdefault(value, [])
            if sure and kind not in held:
                held.append(kind)
    known: dict[str, str] = {}
    for _, _, kind, value, _ in named:
        if kind.startswith("given-") and (value not in known or known[value].startswith("given-x")):
            known[value] = kind
    out = []
    for start, end, kind, value, sure in named:
        if kind.startswith("given") and not (sure and len(told[value]) > 1):
            kind = told[value][0] if told[value] else known[value]
        out.append((start, end, kind, value))
    return out


def _plain(word: str) -> bool:
    """A capitalised word of letters (and inner marks), not all capitals."""
    return len(word) > 1 and word[1:] != word[1:].upper() and word not in _TITLE_OF


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), in order, without overlaps. One normal form is one entity, whatever its format.

    Names are found by a title or a known given name; in the same text every other mention of a name found so, alone or in
    capitals, is that entity too.
    """
    found = []
    if re.search(r"[0-9@=:]", text):
        for m in _PATTERN.finditer(text):
            group = m.lastgroup if m.lastgroup != "gap" else "card"
            start, end = m.span(group)
            value = m.group(group)
            kind = _KINDS.get(group, group)
            if kind in ("email", "ipv6", "mac", "iban"):
                value = re.sub(r"[ -]", "", value) if kind in ("mac", "iban") else value
                value = value.casefold().replace(":", "" if kind == "mac" else ":")
            elif kind in ("card", "phone", "ssn"):
                digits = re.sub(r"\D", "", value)
                if kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                value = "+" + digits if value.startswith("+") else digits
            found.append((start, end, kind, value))
    taken = sorted((f[0], f[1]) for f in found)

    def is_free(start: int, end: int) -> bool:
        k = bisect.bisect_left(taken, (end,))
        return k == 0 or taken[k - 1][1] <= start

    named = _one_gender([n for n in _names(text) if is_free(n[0], n[1])])
    found += named
    if not text.isascii():
        for start, end, kind, value in sorted(set(_names_without_capitals(text))):
            taken = sorted((f[0], f[1]) for f in found)
            if is_free(start, end):
                found.append((start, end, kind, value))
    if named:
        # Bare and upper-case mentions of the names found: a word that is a name in several kinds is of the kind seen first.
        kinds: dict[str, str] = {}
        for _, _, kind, value in named:
            kinds.setdefault(value, kind)
        taken = sorted((f[0], f[1]) for f in found)
        for m in _CAPITAL.finditer(text):
            word = re.sub(r"['’][sS]$", "", m.group())
            kind = kinds.get(normal_name(word))
            if kind and (word == word.upper() or _plain(word)) and is_free(m.start(), m.start() + len(word)):
                found.append((m.start(), m.start() + len(word), kind, normal_name(word)))
    return sorted(found)


class _Stream:
    """Numbers drawn from a keyed digest of one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.key, self.block, self.left = f"{kind}\0{value}\0{attempt}".encode(), key, 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left = hashlib.blake2b(self.seed + self.block.to_bytes(8, "big"), key=self.key, digest_size=64).digest()
            self.block += 1
        head, self.left = self.left[:8], self.left[8:]
        return int.from_bytes(head, "big") % n

    def like(self, value: str, hexadecimal: bool = False) -> str:
        """Characters of the same classes: digits, capitals and small letters of the same script; others stay."""
        out = []
        for c in value:
            if hexadecimal and c in "0123456789abcdefABCDEF":
                out.append("0123456789abcdef"[self.below(16)] if not c.isupper() else "0123456789ABCDEF"[self.below(16)])
            elif c.isdecimal():
                out.append(chr(ord(c) - unicodedata.decimal(c) + self.below(10)))
            elif c.isalpha():
                low, high = next(((a, b) for first, last, a, b in _LETTERS if first <= ord(c) <= last), (0x61, 0x7A))
                letter = chr(low + self.below(high - low + 1))
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    """The sum mod 10 of a card number; 0 if its check digit is right."""
    return sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits))) % 10


def propose(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate's normal form for an entity: same kind, length, network or range, and validity of check digits.

    From attempt SAME_FORMAT on it is longer by one more character each time, or of a wider range, as no value may be free.
    """
    draw = _Stream(key, kind, value, attempt)
    grown = max(0, attempt + 1 - SAME_FORMAT)
    if kind == "phone":
        return _phone(draw, value) + draw.like("0" * grown)
    if kind == "ssn":
        return "9" + draw.like(value[1:] + "0" * grown)
    if kind == "card":
        body = value[0] + draw.like(value[1:] + "0" * grown)
        wanted = _luhn(value) == 0
        last = next(d for d in "0123456789" if (_luhn(body[:-1] + d) == 0) == wanted and (wanted or d >= body[-1] or body[-1] == "9"))
        return body[:-1] + last
    if kind == "ipv4":
        return _wide_ipv6(draw) if grown > SAME_FORMAT else _ipv4(draw, value, grown)
    if kind == "ipv6" and grown:
        return _wide_ipv6(draw)
    if kind in ("ipv6", "mac"):
        kept = next((p for p in _PREFIXES if value.startswith(p)), "") if kind == "ipv6" else ""
        return kept + draw.like(value[len(kept) :] + "0" * grown, hexadecimal=True)
    if kind == "iban":
        body = draw.like(value[4:] + "0" * grown)
        digits = "".join(str(int(c, 36)) for c in body + value[:2] + "00")
        return f"{value[:2]}{98 - int(digits) % 97:02d}{body}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        reserved = re.search(r"(?:^|\.)example\.(?:com|org|net)$|\.(?:example|test|invalid)$", domain)
        return f"{draw.like(local + 'a' * grown)}@{domain if reserved else draw.like(domain.rpartition('.')[0]).replace('.', '-') + '.example'}"
    if kind == "secret":
        hexadecimal = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))
        return draw.like(value + ("0" if hexadecimal else "a") * grown, hexadecimal=hexadecimal)
    _, gender, script = kind.split("-")
    syllables, ends = _SYLLABLES[script], _ENDS[script, gender]
    if script == "han":
        return "".join(syllables[draw.below(len(syllables))] for _ in range((gender != "s") + attempt // 2)) + ends[draw.below(len(ends))]
    return "".join(syllables[draw.below(len(syllables))] for _ in range(2 + (attempt + 2) // 3)) + ends[draw.below(len(ends))]


def _phone(draw: _Stream, value: str) -> str:
    """A number of the same country, with its trunk zeros; the first digit after them is none."""
    kept, rest = "", value
    if value.startswith("+"):
        code = value[1:2] if value[1:2] in _COUNTRY_1 else value[1:3] if value[1:3] in _COUNTRY_2 else value[1:4]
        kept, rest = "+" + code, value[1 + len(code) :]
    zeros = rest[: len(rest) - len(rest.lstrip("0"))]
    rest = rest[len(zeros) :]
    # North American numbers, and others without a trunk zero, begin with 2 to 9.
    low = 1 if zeros or kept not in ("", "+1") else 2
    return kept + zeros + (str(low + draw.below(10 - low)) + draw.like(rest[1:]) if rest else "")


def _ipv4(draw: _Stream, value: str, grown: int) -> str:
    """An address of the same network, if that is a special one, else another public one; a private one if grown."""
    parts = value.split(".")
    network = next((n for n in _NETWORKS if parts[: len(n)] == list(n)), ())
    shared = parts[0] == "172" and 16 <= int(parts[1]) <= 31
    if int(parts[0]) >= 224:
        network = tuple(parts[:1])
    if grown:
        network, shared = ("10",), False
    if network or shared:
        head = ["172", str(16 + draw.below(16))] if shared else list(network)
        return ".".join([*head, *(str(1 + draw.below(254)) for _ in range(4 - len(head)))])
    while True:
        made = [str(1 + draw.below(223 if not k else 254)) for k in range(4)]
        if not any(made[: len(n)] == list(n) for n in _NETWORKS) and not (made[0] == "172" and 16 <= int(made[1]) <= 31):
            return ".".join(made)


def _wide_ipv6(draw: _Stream) -> str:
    """An address of the range for documentation, 96 bits of it drawn."""
    return "2001:db8:" + ":".join(f"{1 + draw.below(65535):x}" for _ in range(6))


def render(surrogate: str, original: str, kind: str) -> str:
    """The surrogate in the format of one mention: its separators, case and brackets."""
    if kind in ("card", "phone", "ssn", "mac", "iban"):
        chars, out = iter(surrogate.removeprefix("+")), []
        for c in original:
            out.append((lambda x: x.upper() if c.isupper() or kind == "iban" else x)(next(chars)) if c.isalnum() else c)
        rest = "".join(chars)  # of a surrogate longer than the original
        return "".join(out) + (rest.upper() if kind == "iban" else rest)
    if kind.startswith(("given", "name")):
        return surrogate.upper() if original.isupper() else surrogate[:1].upper() + surrogate[1:]
    if kind == "email":
        (local, _, domain), (model, _, place) = surrogate.rpartition("@"), original.rpartition("@")
        if len(local) == len(model):
            local = "".join(c.upper() if o.isupper() else c for c, o in zip(local, model, strict=True))
        elif model.isupper():
            local = local.upper()
        return f"{local}@{domain.upper() if place.isupper() else domain}"
    return surrogate


def family(kind):
    """Kinds whose values look alike and so must differ: all names are one family. A column, or a string."""
    if isinstance(kind, str):
        return "name" if kind.startswith(("given", "name")) else kind
    return F.when(kind.startswith("given") | kind.startswith("name"), "name").otherwise(kind)


def _assign(found: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value): injective within a family, and never an entity of it.

    Each round every entity without a surrogate proposes one from the key; a proposal falls if it is an original, is held
    already, or belongs to an entity later in order. All checks are joins over distinct entities. Rounds go on until every
    entity has a surrogate: their domain grows with the attempt.
    """

    def proposals(attempt: int):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [propose(key, k, v, attempt) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

        return make

    originals = found.select(family(F.col("kind")).alias("family"), F.col("value").alias("surrogate"))
    held, open_ = None, found
    for attempt in itertools.count():
        tried = open_.mapInArrow(proposals(attempt), "kind string, value string, surrogate string").withColumn("family", family(F.col("kind")))
        free = tried.join(originals, ["family", "surrogate"], "left_anti")
        if held is not None:
            free = free.join(held.select(family(F.col("kind")).alias("family"), "surrogate"), ["family", "surrogate"], "left_anti")
        won = free.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("e")).select("e.kind", "e.value", "surrogate")
        won = scratch.keep(won, f"won-{attempt}")
        held = won if held is None else held.unionByName(won)
        open_ = scratch.keep(open_.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), f"open-{attempt}")
        if open_.isEmpty():
            return held


def _ungendered(found: DataFrame) -> DataFrame:
    """(kind, value, as_kind): given names without a gender in some text that the corpus knows in one gender only are that entity."""
    given = found.where(F.col("kind").startswith("given-")).withColumn("script", F.substring_index("kind", "-", -1))
    told = given.where(~F.col("kind").startswith("given-x-")).groupBy("script", "value").agg(F.min("kind").alias("as_kind"), F.max("kind").alias("other")).where("as_kind = other")
    return given.where(F.col("kind").startswith("given-x-")).join(told, ["script", "value"]).select("kind", "value", "as_kind")


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with every detected entity of text_col replaced, and count_col, the number of mentions replaced.

    One entity gets one surrogate in all documents (coreference), two get two (distinctness), none gets a value that is
    an entity of the corpus of its family: all kinds of names are one. All other characters and columns stay as they are.
    Null texts stay null with 0 mentions; rows may repeat and ids be null, as rows are numbered. One scan finds the entities and is
    written; texts without any pass on from there, only the others are joined with their surrogates and rewritten. A column of
    docs named as count_col gives way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "pii")
    docs = docs.drop(count_col)
    names = docs.columns
    flat = docs.toDF(*(f"c{j}" for j in range(len(names))))
    at = names.index(text_col)
    fields = ", ".join(f"c{j} {f.dataType.simpleString()}" for j, f in enumerate(docs.schema.fields))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            found = [entities(t) if t else [] for t in batch.column(at).to_pylist()]
            mentions = [[{"start": s, "end": e, "kind": k, "value": v} for s, e, k, v in f] or None for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mentions, kind)], names=[*batch.schema.names, "mentions"])

    scanned = flat.mapInArrow(scan, f"{fields}, mentions array<struct<start:int,end:int,kind:string,value:string>>")
    scanned = scratch.keep(scanned.withColumn("rid", F.monotonically_increasing_id()), "scanned", compression="zstd")
    hit = scanned.where("mentions is not null")
    clean = scanned.where("mentions is null").select(*(f"c{j}" for j in range(len(names))), F.lit(0).alias("n"))

    pairs = hit.select("rid", F.explode(F.array_distinct(F.transform("mentions", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value"))))).alias("e")).select("rid", "e.*")
    known_entities = scratch.keep(pairs.select("kind", "value").distinct(), "entities")
    aliases = scratch.keep(_ungendered(known_entities), "aliases")
    surrogates = _assign(known_entities.join(aliases.select("kind", "value"), ["kind", "value"], "left_anti"), key, scratch)
    same = aliases.join(surrogates.withColumnRenamed("kind", "as_kind"), ["as_kind", "value"]).select("kind", "value", "surrogate")
    surrogates = surrogates.unionByName(same)
    known = pairs.join(surrogates, ["kind", "value"]).groupBy("rid").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("known"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, mentions, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                table = {(k["kind"], k["value"]): k["surrogate"] for k in own}
                out, end = [], 0
                for m in mentions:
                    out += (text[end : m["start"]], render(table[m["kind"], m["value"]], text[m["start"] : m["end"]], m["kind"]))
                    end = m["end"]
                texts.append("".join(out) + text[end:])
                counts.append(len(mentions))
            columns = [*batch.columns[: len(names)], pa.array(counts, pa.int32())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(names)], "n"])

    rewritten = hit.join(known, "rid").select(*(f"c{j}" for j in range(len(names))), "mentions", "known").mapInArrow(rewrite, f"{fields}, n int")
    return clean.unionByName(rewritten).toDF(*names, count_col)
