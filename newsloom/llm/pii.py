"""Operator 3: replacement of personal data by keyed surrogates of the same type."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, ship_package, slices_by_bytes, text_of

BATCH_BYTES = 4 << 20
DEFAULT_KEY = "newsloom"
#: Rounds of drawing again after which a format counts as used up, which is an error.
MOST_ROUNDS = 200
#: Attempts within an entity's own range, after which a wider one of the same type is drawn from.
NARROW_ATTEMPTS = 8
#: Entities with another surrogate than the first that every task gets at most; beyond, they are joined to the texts they are in.
BROADCAST_ENTITIES = 200_000

NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|(?:gh[pousr]_|glpat-|sk-|sk_live_|xox[abp]-|AIza)[A-Za-z0-9_\-]{20,})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
SECRET_HEAD = re.compile(r"AKIA|gh[pousr]_|glpat-|sk-|sk_live_|xox[abp]-|AIza")
DOMAIN = re.compile(r"[\w\-]+(?:\.[\w\-]+)+")
IPV6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
KEPT_DOMAINS = re.compile(r"(?:^|.*\.)(example\.(?:com|org|net)|[\w\-]+\.(?:test|invalid|example))$")
#: Ranges of addresses that stand for something, from narrow to wide; a surrogate stays within the range.
NETWORKS = [ipaddress.IPv4Network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "192.168.0.0/16", "169.254.0.0/16", "172.16.0.0/12", "100.64.0.0/10", "10.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4")]

# Titles that tell a gender (or none), what introduces a name, particles within names, and names that surrogates are drawn from.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Signor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Srta": "f", "Doña": "f", "Signora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Dra": "f", "Prof": "n", "Professor": "n", "Профессор": "n", "Доктор": "n",
}
CUES = ["my name is", "mein Name ist", "ich heiße", "ich heisse", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es", "меня зовут", "με λένε", "Name:", "Nom:", "Nombre:", "Имя:", "Όνομα:"]
PARTICLES = ["de", "la", "las", "los", "del", "della", "von", "van", "der", "den", "zu", "af", "di", "da", "dos", "le", "du", "ten", "ter"]
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Carl", "Carlos", "Daniel", "David", "Diego", "Emil", "Felix", "Georg", "Hans", "Henri", "Hugo", "Ivan", "James", "John", "Jonas", "Karim", "Lukas", "Michael", "Noah", "Oscar", "Pablo", "Paul", "Peter", "Pierre", "Robert", "Stefan", "Thomas", "William"],
    ("latin", "f"): ["Agnes", "Alice", "Anna", "Berta", "Carmen", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Isabel", "Jane", "Julia", "Karin", "Laura", "Louise", "Lucia", "Maria", "Marta", "Mary", "Monika", "Nora", "Olga", "Paula", "Sarah", "Sofia", "Susan", "Ursula"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Михаил", "Олег", "Павел", "Сергей", "Юрий"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Φωτεινή", "Χρυσούλα"],
}
# What made-up names are put together from, as (first sounds, vowels, last sounds), and endings of given names.
SOUNDS = {
    "latin": ("b br d dr f g gr h j k kl l m n p r s st t v w".split(), "a e i o u".split(), ["", "l", "m", "n", "r", "s"]),
    "cyrillic": ("б бр в г гр д ж з к кр л м н п р с ст т".split(), "а е и о у".split(), ["", "л", "м", "н", "р", "с"]),
    "greek": ("β γ δ ζ θ κ κρ λ μ ν π πρ ρ σ στ τ φ".split(), "α ε ι ο ου".split(), ["", "λ", "ν", "ρ", "σ"]),
}
GIVEN_ENDINGS = {("latin", "m"): ["o", "ert", "in", "us"], ("latin", "f"): ["a", "ina", "ette", "ia"], ("cyrillic", "m"): ["ир", "ан", "ий"], ("cyrillic", "f"): ["а", "ина", "ия"], ("greek", "m"): ["ος", "ης", "ας"], ("greek", "f"): ["α", "η", "ία"]}
SURNAME_ENDINGS = {"latin": ["berg", "en", "er", "ini", "ley", "mann", "o", "ova", "ski", "son", "ton", "ez"], "cyrillic": ["енко", "юк", "ко", "ян"], "greek": ["ίδης", "άκης", "όπουλος", "άς"]}
#: Endings of Russian surnames that a woman's form adds to, or that change with gender.
RUSSIAN = re.compile(r"^(.+(?:ов|ев|ёв|ин|ын))(а?)$|^(.+ск)(ий|ая)$")

CAPITALS = "".join(c for c in map(chr, [*range(0x530), *range(0x1F00, 0x2000)]) if c.isupper())
_SPACE, _PARTICLES = "[  ]", "|".join(PARTICLES)
_WORD = rf"[{CAPITALS}](?:[^\W\d_]|['’](?=[{CAPITALS}]))*"
_COMPOUND, _INITIALS = rf"{_WORD}(?:-{_WORD})*", rf"(?:[{CAPITALS}]\.{_SPACE}?)*"
_NEXT = rf"{_SPACE}{_INITIALS}(?:(?:{_PARTICLES}){_SPACE}){{0,2}}{_COMPOUND}"
_RUN = rf"{_INITIALS}(?:(?:{_PARTICLES}){_SPACE}){{0,2}}{_COMPOUND}(?:{_NEXT}){{0,3}}"
_TITLES = "|".join(sorted({x for t in TITLES for x in (t, t.upper())}, key=len, reverse=True))
TITLED = re.compile(rf"(?<![^\W\d_])((?:(?:{_TITLES})\b\.?{_SPACE})+)({_RUN})")
INTRODUCED = re.compile(rf"(?<![^\W\d_])(?i:{'|'.join(map(re.escape, CUES))}){_SPACE}({_RUN})")
GENDER_OF = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}
CALLED = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted({n for names in GIVEN.values() for n in names}, key=len, reverse=True))})(?![^\W\d_])(?:-{_WORD})*(?:{_NEXT}){{1,3}}")
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(_WORD)
#: A text without any of these words has no name that is looked for.
TRIGGERS = {x for t in TITLES for x in (t, t.upper())} | {n for names in GIVEN.values() for n in names} | {w for c in CUES for w in (max(WORD.findall(c), key=len), max(WORD.findall(c), key=len).capitalize(), max(WORD.findall(c), key=len).upper())}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß"]
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int
    end: int
    canon: str  # one for all ways to write the same thing
    gender: str = "n"  # of a given name, as the text tells it


def stem(surname: str) -> tuple[str, str]:
    """The part of a surname (lower case) that does not change with gender, and the ending that does."""
    found = RUSSIAN.match(surname)
    return (found[1] or found[3], found[2] or found[4] or "") if found else (surname, "")


def people(text: str) -> list[Mention]:
    """Mentions of persons, word by word: each word of a name is an entity of its own, so all forms of one name get one surrogate.

    Found are names behind titles, behind an introduction (my name is), and a common given name with a surname; and, within the
    text, every other mention of a word of such a name. The last word of a longer name is the surname; a single word behind a
    title is one too, unless the text has it as a given name. Initials and particles stay.
    """
    if TRIGGERS.isdisjoint(WORD.findall(text)):
        return []
    runs = []
    for m in TITLED.finditer(text):
        genders = {TITLES.get(t, TITLES.get(t.capitalize(), "n")) for t in WORD.findall(m[1])} - {"n"}
        runs.append((m.start(2), m.end(2), True, genders.pop() if len(genders) == 1 else "n"))
    runs += [(m.start(1), m.end(1), False, "n") for m in INTRODUCED.finditer(text)]
    runs += [(*m.span(), False, "n") for m in CALLED.finditer(text)]
    given, last, singles, end = {}, {}, [], 0
    for start, stop, titled, gender in sorted(runs, key=lambda r: (r[0], -r[1], not r[2])):
        if start < end:
            continue
        end = stop
        words = [[p[0].lower() for p in PART.finditer(w[0])] for w in re.finditer(r"[^  ]+", text[start:stop]) if w[0] not in PARTICLES and not re.fullmatch(rf"(?:[{CAPITALS}]\.)+", w[0])]
        if len(words) == 1:
            singles.append((words[0], titled, gender))
            continue
        family = [stem(p)[0] for p in words[-1]]
        for p in family:
            last.setdefault(p, Counter())[gender] += 1
        for p in (p for w in words[:-1] for p in w):
            known = given.setdefault(p, (Counter(), set()))
            known[0][gender] += 1
            known[1].update(family)
    for parts, titled, gender in singles:
        for p in parts:
            if p in given or (not titled and stem(p)[0] not in last):
                given.setdefault(p, (Counter(), set()))[0][gender] += 1
            else:
                last.setdefault(stem(p)[0], Counter())[gender] += 1
    if not given and not last:
        return []

    def told(word: str) -> str:
        """The gender that this text tells of a given name: by its own titles, else by those of the surnames with it."""
        own, families = given[word]
        for votes in (own, sum((last[f] for f in families), Counter())):
            if votes["m"] != votes["f"]:
                return "m" if votes["m"] > votes["f"] else "f"
        return "n"

    genders = {p: told(p) for p in given}
    out = []
    for m in PART.finditer(text):
        if (m.start() and (text[m.start() - 1].isalpha())) or (m.end() < len(text) and text[m.end()].isalpha()):
            continue
        word = m[0].lower()
        root = stem(word)[0]
        if root in last and word not in given or root in last and root not in given:
            out.append(Mention("name:surname", *m.span(), root))
        elif word in given:
            out.append(Mention("name:given", *m.span(), word, genders[word]))
    return out


def addresses(text: str) -> list[Mention]:
    """E-mail addresses, whole on both sides of each @."""
    out, at, before = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        while start < at and text[start] in ".-%+":
            start += 1
        if start < at and (right := DOMAIN.match(text, at + 1)):
            end = at + 1 + len(right[0].rstrip("-_"))
            out.append(Mention("email", start, end, text[start:end].lower()))
        before, at = at + 1, text.find("@", at + 1)
    return out


def ipv6_addresses(text: str) -> list[Mention]:
    out, at, done = [], text.find(":"), 0
    while at >= 0:
        start = at
        while start > done and at - start < 4 and text[start - 1] in "0123456789abcdefABCDEF":
            start -= 1
        found = None if start and (text[start - 1].isalnum() or text[start - 1] in "_:") else IPV6.match(text, start)
        if found and any(map(str.isdigit, found[0])):
            try:
                address = ipaddress.IPv6Address(found[0])
            except ValueError:
                address = None
            if address and address.packed.lstrip(b"\0") > b"\1":
                out.append(Mention("ip", *found.span(), address.compressed))
        done = max(at + 1, found.end() if found else 0)
        at = text.find(":", done)
    return out


def mentions(text: str) -> list[Mention]:
    """Entities of the text in order, without overlaps: of overlapping ones the first, of these the longest."""
    found = addresses(text)
    if re.search(r"\d", text):
        found += ipv6_addresses(text)
        for m in NUMBERS.finditer(text):
            kind, s = m.lastgroup, m[0]
            if kind == "ip":
                octets = [int(x) for x in s.split(".")]
                if max(octets) > 255 or octets[0] in (0, 127) or min(octets) == 255:
                    continue
                canon = ".".join(map(str, octets))
            elif kind == "secret":
                canon = s if SECRET_HEAD.match(s) else s.lower()
            elif kind == "iban":
                canon = s.replace(" ", "")
            else:
                canon = ("+" if s[0] == "+" else "") + re.sub(r"\D", "", s)
                if kind == "card" and not is_card(canon):
                    continue
            found.append(Mention(kind, m.start(), m.end(), canon))
    found += people(text)
    found.sort(key=lambda x: (x.start, -x.end))
    out: list[Mention] = []
    for x in found:
        if not out or x.start >= out[-1].end:
            out.append(x)
    return out


def _number(key: str, *parts: object, size: int = 1 << 64) -> int:
    """A keyed number of at least 128 bits more than size has."""
    said, out = "\x1f".join(map(str, parts)).encode("utf-8", "replace"), b""
    for block in range(1 + (size.bit_length() + 128) // 512):
        out += hashlib.blake2b(said, key=key.encode()[:64], salt=block.to_bytes(16, "big")).digest()
    return int.from_bytes(out, "big")


def permuted(values: list[int], radices: list[int], key: str, tweak: str, rounds: int = 8) -> list[int]:
    """A keyed permutation of mixed-radix numbers with these radices: an alternating Feistel network."""
    middle = len(values) // 2
    halves = [(values[:middle], radices[:middle]), (values[middle:], radices[middle:])]
    numbers, sizes = [], []
    for v, r in halves:
        n, size = 0, 1
        for x, k in zip(v, r):
            n, size = n * k + x, size * k
        numbers.append(n)
        sizes.append(size)
    for i in range(rounds):
        side = i % 2
        numbers[side] = (numbers[side] + _number(key, tweak, i, sizes, numbers[1 - side], size=sizes[side])) % sizes[side]
    out = []
    for n, (_, r) in zip(numbers, halves):
        digits = []
        for k in reversed(r):
            n, d = divmod(n, k)
            digits.append(d)
        out += digits[::-1]
    return out


def shuffled_characters(text: str, key: str, tweak: str) -> str:
    """text with each letter and digit replaced within its own alphabet; other characters stay."""
    at = [i for i, c in enumerate(text) if c in ALPHABET_OF]
    new = permuted([ALPHABET_OF[text[i]].index(text[i]) for i in at], [len(ALPHABET_OF[text[i]]) for i in at], key, tweak)
    out = list(text)
    for i, x in zip(at, new):
        out[i] = ALPHABET_OF[text[i]][x]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit for these leading digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def is_card(digits: str) -> bool:
    """Whether digits are a card's number: of a range that cards are issued in, and with a valid check digit. Others are no one's."""
    return (digits[0] in "3456" or "2221" <= digits[:4] <= "2720") and _luhn(digits[:-1]) == int(digits[-1])


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _ipv4(canon: str, key: str, tweak: str, wide: bool) -> str:
    """Another address of the same range; a public one for a public one. With wide, private and special ones come from 10/8."""
    address = ipaddress.IPv4Address(canon)
    own = next((n for n in NETWORKS if address in n), None)
    if own and wide and not address.is_multicast:
        own = ipaddress.IPv4Network("10.0.0.0/8")
    if own:
        bits = 32 - own.prefixlen
        radices = [1 << (bits - bits // 2), 1 << (bits // 2)]
        high, low = permuted(list(divmod(int(address) % (1 << bits), radices[1])), radices, key, tweak)
        return str(own.network_address + (high * radices[1] + low))
    octets = list(address.packed)
    while True:  # the cycle of a permutation comes back to the public address that it began with
        octets = permuted(octets, [256] * 4, key, tweak)
        new = ipaddress.IPv4Address(bytes(octets))
        if octets[0] not in (0, 127) and not any(new in n for n in NETWORKS):
            return str(new)


def _ipv6(canon: str, key: str, tweak: str, wide: bool) -> str:
    """Another address that begins alike and is zero in the same places; with wide, all of the last four groups are drawn."""
    groups = [int(g, 16) for g in ipaddress.IPv6Address(canon).exploded.split(":")]
    kept = 2 if groups[:2] == [0x2001, 0xDB8] else 1
    at = [i for i in range(kept, 8) if groups[i] or (wide and i >= 4)] or [7]
    new = permuted([max(0, groups[i] - 1) for i in at], [0xFFFF] * len(at), key, tweak)
    for i, x in zip(at, new):
        groups[i] = x + 1
    return ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups)).compressed


def script_of(text: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", text) else "greek" if re.search("[Ͱ-Ͽἀ-῿]", text) else "latin"


def usual_gender(given: str) -> str:
    """The gender of a given name (lower case) where the corpus tells none: by a list of common ones, else by its ending."""
    return GENDER_OF.get(given) or ("f" if given[-1:] in "aαηаяάή" else "m")


def _name(kind: str, canon: str, gender: str, key: str, tweak: str, attempt: int) -> str:
    """A word of a name in lower case. Given names come from the list of their gender first; made-up ones grow with the attempts."""
    script, seed = script_of(canon), _number(key, tweak, canon)
    if kind == "name:given" and attempt < 3:
        names = GIVEN[script, gender]
        return names[seed % len(names)].lower()
    first, vowels, last = SOUNDS[script]
    russian = RUSSIAN.match(canon + "ий" if canon.endswith("ск") else canon) if script == "cyrillic" else None
    endings = GIVEN_ENDINGS[script, gender] if kind == "name:given" else [canon[-2:]] if russian else SURNAME_ENDINGS[script]
    out = ""
    for _ in range(2 + attempt // 3):
        for sounds in (first, vowels, last):
            seed, k = divmod(seed, len(sounds))
            out += sounds[k]
    if out[-1] in vowels or out[-1] in "аеиоуαειου":
        seed, k = divmod(seed, len(last) - 1)
        out += last[k + 1]
    return out + endings[seed % len(endings)]


def surrogate(kind: str, canon: str, key: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical surrogate: another thing of the same kind and form. Within one attempt no two things get the same, but for names."""
    tweak, wide = f"{kind}:{attempt}", attempt >= NARROW_ATTEMPTS
    if kind.startswith("name:"):
        return _name(kind, canon, gender if gender in "mf" else usual_gender(canon), key, tweak, attempt)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        kept = KEPT_DOMAINS.match(domain)
        tail = kept[1] if kept else domain.rpartition(".")[2]
        head = domain[: len(domain) - len(tail)]
        return shuffled_characters(f"{local}@{head}", key, tweak) + tail
    if kind == "ip":
        return (_ipv6 if ":" in canon else _ipv4)(canon, key, tweak, wide)
    if kind == "secret":
        if head := SECRET_HEAD.match(canon):
            return head[0] + shuffled_characters(canon[head.end() :], key, tweak)
        return "".join(f"{x:x}" for x in permuted([int(c, 16) for c in canon], [16] * len(canon), key, tweak))
    if kind == "iban":
        country, check, rest = canon[:2], canon[2:4], canon[4:]
        new = shuffled_characters(rest, key, tweak)
        shift = (int(check) - int(_iban_check(country, rest))) % 100
        return country + f"{(int(_iban_check(country, new)) + shift) % 100:02d}" + new
    if kind == "card":
        kept = 4 if canon[0] == "2" else 1
        new = canon[:kept] + shuffled_characters(canon[kept:-1], key, tweak)
        return new + str(_luhn(new))
    if kind == "phone":
        plus = canon[: len(canon) - 10] if canon[0] == "+" and len(canon) > 11 else canon[:2] if canon[0] == "+" else ""
        digits = canon[len(plus) :]
        if len(digits) == 10 and digits[3:6] == "555" and not wide:  # numbers kept for fiction stay such
            new = shuffled_characters(digits[:3] + digits[6:], key, tweak)
            return plus + new[:3] + "555" + new[3:]
        return plus + shuffled_characters(digits, key, tweak)
    return shuffled_characters(canon, key, tweak)


def written_like(surface: str, kind: str, new: str) -> str:
    """The canonical surrogate in the form of this mention: its case, separators and grouping."""
    if kind in ("card", "phone", "ssn", "iban"):
        characters = iter(new.lstrip("+"))
        return "".join(next(characters, c) if c.isalnum() else c for c in surface)
    if kind.startswith("name:"):
        whole = new + (stem(surface.lower())[1] if kind == "name:surname" else "")
        return whole.upper() if surface.isupper() and len(surface) > 1 else whole.capitalize()
    if kind == "ip" and ":" in new:
        whole = ipaddress.IPv6Address(new).exploded if len(surface) == 39 else new
        return whole.upper() if surface != surface.lower() else whole
    if kind == "secret" and SECRET_HEAD.match(surface):
        return new
    if surface.isupper():
        return new.upper()
    if kind in ("email", "secret") and len(surface) == len(new):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(surface, new))
    return new


def replace_text(text: str, key: str, special: dict[tuple[str, str], tuple[int, str]], cache: dict) -> tuple[str, list[str]]:
    """The text with all its entities replaced, and their kinds. special has attempt and gender where they aren't the usual ones."""
    out, kinds, at = [], [], 0
    for m in mentions(text):
        attempt, gender = special.get((m.kind, m.canon), (0, "n"))
        known = cache.get((m.kind, m.canon, attempt, gender))
        if known is None:
            if len(cache) > 100_000:
                cache.clear()
            known = cache[m.kind, m.canon, attempt, gender] = surrogate(m.kind, m.canon, key, attempt, gender)
        out += [text[at : m.start], written_like(text[m.start : m.end], m.kind, known)]
        kinds.append(m.kind.partition(":")[0])
        at = m.end
    return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, kind, canon, gender) for each entity of each text, with the gender that the text tells of a given name (m, f or n)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", BATCH_BYTES):
                at, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = list(dict.fromkeys((m.kind, m.canon, m.gender) for m in mentions(text)))
                    at += [i] * len(own)
                    rows += own
                columns = [pa.array(list(c), pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([part.column("text_hash").take(pa.array(at, pa.int64())), *columns], names=["text_hash", "kind", "canon", "gender"])

    rows = docs.select(text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.select("text_hash", "text").mapInArrow(run, "text_hash long, kind string, canon string, gender string")


def exceptions(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, canon, gender, attempt) of the entities of which attempt or gender are not the usual ones (0, and usual_gender).

    An entity draws again while its surrogate is an entity of the corpus itself, or another's: of several that drew the same in
    a round the smallest keeps it, and what was kept in earlier rounds stays. So all surrogates of a kind are distinct from
    each other and from all entities. The gender of a given name is what most texts tell. After the first round only those that
    draw again are looked up. RuntimeError if MOST_ROUNDS don't do, which means that a format has no more to give.
    """
    ship_package(found.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, c, key, a, g) for k, c, g, a in zip(*(batch.column(x).to_pylist() for x in ("kind", "canon", "gender", "attempt")))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.string())], names=["kind", "canon", "gender", "attempt", "new"])

    def drawn(rows: DataFrame) -> DataFrame:
        return checkpoint(rows.mapInArrow(draw, "kind string, canon string, gender string, attempt int, new string").withColumn("general", F.split("kind", ":")[0]))

    male, female = (F.count_if(F.col("gender") == g) for g in "mf")
    known = found.groupBy("kind", "canon").agg(F.when(male > female, "m").when(female > male, "f").otherwise("n").alias("gender"))
    moving = drawn(known.withColumn("attempt", F.lit(0)))
    originals = moving.select("general", F.col("canon").alias("new"))
    settled, taken = None, originals
    for _ in range(MOST_ROUNDS):
        claims = moving.groupBy("general", "new").agg(F.min(F.struct("kind", "canon")).alias("keeper"))
        blocked = taken.join(claims, ["general", "new"], "left_semi").distinct().withColumn("blocked", F.lit(True))
        judged = moving.join(claims, ["general", "new"]).join(blocked, ["general", "new"], "left")
        judged = checkpoint(judged.withColumn("again", F.col("blocked").isNotNull() | (F.struct("kind", "canon") != F.col("keeper"))).drop("keeper", "blocked"))
        kept = judged.where("not again").drop("again")
        settled = kept if settled is None else settled.unionByName(kept)
        taken = originals.union(settled.select("general", "new"))
        again = judged.where("again")
        if again.isEmpty():
            usual = F.col("attempt") == 0
            return settled.where(~(usual & (F.col("gender") == "n"))).select("kind", "canon", "gender", "attempt")
        moving = drawn(again.select("kind", "canon", "gender", (F.col("attempt") + 1).cast("int").alias("attempt")))
    raise RuntimeError(f"no distinct surrogates after {MOST_ROUNDS} rounds for {again.select('kind').distinct().limit(20).collect()}")


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", n_chars_col: str | None = "n_chars", kinds_col: str | None = None) -> DataFrame:
    """docs with each detected entity replaced by its surrogate, the same one wherever it is mentioned.

    Kinds: e-mail addresses, phone, card, account and social security numbers, IP addresses, access keys, and names (see
    people: Latin, Cyrillic and Greek, each word of a name by itself). Distinct entities get distinct surrogates, none of which
    is an entity of the corpus. Form is kept: separators, case, script, country code, scheme and check digits,
    range of an address, gender of a name. Addresses that are no one's (0/8, 127/8, broadcast) stay, and so do long numbers that
    are no card's (see is_card). Null texts stay null; rows
    without entities stay as they are; repeated rows and texts are treated alike; ids are not read. n_chars_col, where the
    table has it, is counted anew; kinds_col, if named, is added with the kinds of all mentions, in place of a column of that
    name. No documents give no rows.
    """
    docs = docs.drop(kinds_col) if kinds_col else docs
    names = docs.columns
    found = checkpoint(entities(docs, text_col).distinct())
    unusual = checkpoint(exceptions(found, key))
    hashed, special, kinds = free_name("text_hash", names), free_name("special", names), free_name(kinds_col or "kinds", names)
    if unusual.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES:
        every = {(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in unusual.collect()}  # as many as BROADCAST_ENTITIES
        joined = docs
    else:
        every = {}
        own = F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(special)
        per_text = found.select("text_hash", "kind", "canon").distinct().join(unusual, ["kind", "canon"]).groupBy(F.col("text_hash").alias(hashed)).agg(own)
        joined = docs.withColumn(hashed, F.xxhash64(text_of(text_col))).join(per_text, hashed, "left").drop(hashed)
    shared = docs.sparkSession.sparkContext.broadcast(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices_by_bytes(batch, text_col, BATCH_BYTES):
                texts, listed = [], []
                own = part.column(special).to_pylist() if special in part.schema.names else [None] * len(part)
                for text, rows in zip(part.column(text_col).to_pylist(), own):
                    unlike = shared.value if rows is None else {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in rows}
                    new, kind = (None, []) if text is None else replace_text(text, key, unlike, cache)
                    texts.append(new)
                    listed.append(kind)
                columns = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, pa.list_(pa.string()))], names=[*names, kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{kinds}` array<string>"
    out = joined.mapInArrow(run, schema)
    if n_chars_col in names:
        out = out.withColumn(n_chars_col, F.char_length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out if kinds_col else out.drop(kinds)
