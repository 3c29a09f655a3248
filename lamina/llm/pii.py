"""Surrogates for personal data.

Detected entities (e-mail addresses, phone and card numbers, IP addresses of both versions, social security numbers of the
US form, IBANs, names after a form of address) are replaced by keyed surrogates of their own format. A value is first
brought to one form (letters lower-cased, phone numbers as country and national digits, other numbers without their
separators), so that what differs only in writing has one surrogate, written as the value was. A surrogate is a keyed
permutation of the values of one format: a Feistel network over the mixed-radix number that its characters form, each
character keeping its class (digit, vowel or consonant of a script and case, letter of another script). So one value has
one surrogate wherever it occurs (coreference), two values never have the same (distinctness), and no table of values has
to be kept or shuffled. Well-known given names stand for each other within their gender; other names keep their last
letter, with which gender goes. What carries meaning stays: separators, the country code, the validity of check digits,
private address ranges, an address's top-level domain (under the reserved name "example"), the form of address.

The permutations have no fixed points: a value with a character of a class never stands for itself. Names are found after
a form of address; the words of a name so found are replaced wherever they stand in the same document. Names that never
follow a form of address there, dates and street addresses are not looked for.

Collision checks: surrogates are checked against each other and against the originals inside every document while they
are made. One that equals another value or surrogate of the document gives way to one of a further permutation, so there,
and only there, a value can have another surrogate than in other documents, and that one can be some other value's
elsewhere. Where a format has too few values for that, the surrogate stays. collisions() counts what stands for several
values over the whole table.

Defined results: null texts stay null with no entities, empty texts likewise; overlapping candidates are resolved in
favour of the earlier, then the longer, then the order of KINDS; repeated rows get equal results; a very long text is
searched whole in its task; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import attach

KINDS = ("email", "phone", "card", "ip", "name", "ssn", "iban")
ROUNDS = 8
#: Permutations that are tried where a surrogate equals another value of its document.
FURTHER = 200
#: Fixed forms of address.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña|Signor|Signora"
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)", re.A)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)", re.A)
CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])", re.A)
SSN = re.compile(r"(?<![\w.+-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.A)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ -]\d{3,4}(?:[ -]?\d{3,4}))(?![\w-])", re.A
)
NAME = re.compile(rf"\b(?:{TITLES})\b\.?(?: (?!(?:{TITLES})\b)[A-ZÀ-ÖØ-ÞŒŠŽΑ-ΩА-Я][\w’'-]+){{1,3}}")
TITLE = re.compile(rf"(?:{TITLES})\b\.? ")
DIGIT = re.compile(r"\d", re.A)
#: Fixed country calling codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Given names that stand for each other.
GIVEN = {
    "female": "alice amelia anna barbara carmen caroline charlotte clara diana elena elizabeth emily emma eva helen isabel jane julia karen laura linda lucy maria marie martha mary nina olivia patricia paula rosa ruth sandra sarah sophie susan teresa victoria".split(),
    "male": "adam albert alexander andrew anthony bernard carlos charles daniel david edward frank george henri henry hugo ivan jack james jean john joseph karl lewis lucas mark martin michael oliver oscar paul pedro peter richard robert samuel simon thomas victor walter william".split(),
}
GIVEN_PLACE = {name: (gender, k) for gender, names in GIVEN.items() for k, name in enumerate(names)}
#: Characters that stand for each other; then ranges of letters of other scripts that do.
CLASSES = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "àáâãäåæèéêëìíîïòóôõöøœùúûüýÿ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØŒÙÚÛÜÝŸ", "çñßðþćčďđłńňřśšťźžż", "ÇÑÐÞĆČĎĐŁŃŇŘŚŠŤŹŽŻ",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "аеиоуыэюяёіїє", "бвгджзйклмнпрстфхцчшщьъ", "АЕИОУЫЭЮЯЁІЇЄ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
)
RANGES = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
CLASS_OF = {c: (k, i) for k, chars in enumerate(CLASSES) for i, c in enumerate(chars)}


def class_of(c: str) -> tuple[int, int] | None:
    """The class of a character and its place there."""
    if c in CLASS_OF or c < "\u05d0":
        return CLASS_OF.get(c)
    k = bisect_right(RANGES, (ord(c), 1 << 30)) - 1
    return (len(CLASSES) + k, ord(c) - RANGES[k][0]) if k >= 0 and ord(c) <= RANGES[k][1] else None


def class_size(k: int) -> int:
    return len(CLASSES[k]) if k < len(CLASSES) else RANGES[k - len(CLASSES)][1] - RANGES[k - len(CLASSES)][0] + 1


def member(k: int, i: int) -> str:
    return CLASSES[k][i] if k < len(CLASSES) else chr(RANGES[k - len(CLASSES)][0] + i)


class Surrogates:
    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def _round(self, label: bytes, n: int, half: int, value: int) -> int:
        size = max(1, (value.bit_length() + 7) // 8)
        return int.from_bytes(hmac.digest(self.key, b"%b|%d|%d|%b" % (label, n, half, value.to_bytes(size, "big")), "sha256"), "big")

    def permuted(self, values: list[int], sizes: list[int], label: str) -> list[int]:
        """A keyed permutation of all vectors whose parts lie below sizes."""
        if not values:
            return []
        if len(values) == 1:
            shift = self._round(label.encode(), 0, 2, 0)
            return [(values[0] + 1 + shift % max(1, sizes[0] - 1)) % sizes[0]]
        cut = len(values) // 2
        halves, spans = [], []
        for v, s in ((values[:cut], sizes[:cut]), (values[cut:], sizes[cut:])):
            number, span = 0, 1
            for x, m in zip(v, s, strict=True):
                number, span = number * m + x, span * m
            halves.append(number)
            spans.append(span)
        # A step on a cycle of all vectors in a keyed order: a permutation without fixed points.
        tag = f"{label}|{sizes}".encode()
        for n in range(ROUNDS):
            half = n % 2
            halves[half] = (halves[half] + self._round(tag, n, half, halves[1 - half])) % spans[half]
        total = spans[0] * spans[1]
        step = 1 + self._round(tag, ROUNDS, 2, 0) % max(1, total - 1)
        halves = list(divmod((halves[0] * spans[1] + halves[1] + step) % total, spans[1]))
        for n in reversed(range(ROUNDS)):
            half = n % 2
            halves[half] = (halves[half] - self._round(tag, n, half, halves[1 - half])) % spans[half]
        out = []
        for number, s in zip(halves, (sizes[:cut], sizes[cut:]), strict=True):
            part = []
            for m in reversed(s):
                number, x = divmod(number, m)
                part.append(x)
            out += part[::-1]
        return out

    def letters(self, text: str, label: str, fixed: set[int] = frozenset()) -> str:
        """text with every character of a class permuted inside it; the others, and those at fixed places, stay."""
        at = [(k, *found) for k, c in enumerate(text) if k not in fixed and (found := class_of(c))]
        pattern = list(text)
        for k, kind, _ in at:
            pattern[k] = chr(0xF0000 + kind)
        new = self.permuted([i for _, _, i in at], [class_size(kind) for _, kind, _ in at], f"{label}|{''.join(pattern)}")
        out = list(text)
        for (k, kind, _), x in zip(at, new, strict=True):
            out[k] = member(kind, x)
        return "".join(out)

    def digits(self, text: str, label: str) -> str:
        """Digits permuted; a first one that is not 0 stays so."""
        low = int(text[:1] not in ("0", ""))
        new = self.permuted([int(c) - (low if k == 0 else 0) for k, c in enumerate(text)], [10 - (low if k == 0 else 0) for k in range(len(text))], f"{label}|{len(text)}|{low}")
        return "".join(str(x + (low if k == 0 else 0)) for k, x in enumerate(new))

    def email(self, text: str, more: str) -> str:
        local, _, domain = text.rpartition("@")
        return f"{self.letters(local, 'local' + more)}@{'.'.join(self.letters(p, 'domain' + more) for p in domain.split('.')[:-1])}.{domain.rsplit('.', 1)[1]}"

    def phone(self, text: str, more: str) -> str:
        country, _, national = text.partition("|")
        trunk = "0" if not country else ""
        return f"{country}|{trunk}{self.digits(national[len(trunk) :], f'phone{more}|{country}')}"

    def ssn(self, text: str, more: str) -> str:
        return self.digits(text, "ssn" + more)

    def card(self, text: str, more: str) -> str:
        digits = list(map(int, text))
        offset = (digits[-1] - check_digit(digits[:-1])) % 10
        new = self.permuted(digits[:-1], [10] * (len(digits) - 1), f"card{more}|{offset}")
        return "".join(map(str, [*new, (check_digit(new) + offset) % 10]))

    def iban(self, text: str, more: str) -> str:
        account = self.letters(text[4:], f"iban{more}|{text[:2]}")
        return f"{text[:2]}{98 - remainder(f'{account}{text[:2]}00'):02d}{account}"

    def ip(self, text: str, more: str) -> str:
        if ":" in text:
            first, *parts = (int(p, 16) for p in text.split(":"))
            new = self.permuted(parts, [1 << 16] * 7, f"ipv6{more}|{first}")
            return ":".join(f"{x:04x}" for x in (first, *new))
        new = parts = [int(p) for p in text.split(".")]
        kind = lambda p: range_of(".".join(map(str, p)))
        here = kind(parts)
        while True:  # walks the cycle of the permutation to the next address of the same range, itself a permutation
            new = self.permuted(new, [256] * 4, "ip" + more)
            if kind(new) == here:
                return ".".join(map(str, new))

    def name(self, text: str, more: str) -> str:
        """A name's word: a given name of the same gender, or letters of which the last stays unless no other can change."""
        if text in GIVEN_PLACE:
            gender, k = GIVEN_PLACE[text]
            return GIVEN[gender][self.permuted([k], [len(GIVEN[gender])], f"given{more}|{gender}")[0]]
        last = len(text) - 1
        fixed = {last} if any(class_of(c) for c in text[:last]) else frozenset()
        new = self.letters(text, "name" + more, fixed)
        while new in GIVEN_PLACE:  # on along the cycle, so that no other name has a given name's surrogate
            new = self.letters(new, "name" + more, fixed)
        return new

    def of(self, kind: str, value: str, more: str = "") -> str:
        """The surrogate of a value in its one form (of a word, for names); more names a further permutation."""
        if (kind, value, more) not in self.known:
            if len(self.known) > 200_000:
                self.known = {}
            self.known[kind, value, more] = getattr(self, kind)(value, more)
        return self.known[kind, value, more]

    def assigned(self, values: set[tuple[str, str]]) -> dict[tuple[str, str], str]:
        """The surrogates of a document's values by kind and value: none equals a value of its kind, or another one."""
        out = {(kind, x): self.of(kind, x) for kind, x in sorted(values)}
        used: set[tuple[str, str]] = set()
        again = []
        for (kind, x), new in out.items():
            if (kind, new) in values or (kind, new) in used:
                again.append((kind, x))
            used.add((kind, new))
        for kind, x in again:
            for n in range(1, FURTHER):
                new = self.of(kind, x, f"+{n}")
                if (kind, new) not in values and (kind, new) not in used:
                    out[kind, x] = new
                    used.add((kind, new))
                    break
        return out


def one_form(kind: str, text: str) -> str:
    """A value as all ways of writing it have it in common."""
    if kind in ("email", "name"):
        return text.lower()
    if kind == "ip":
        return ipaddress.ip_address(text).exploded if ":" in text else ".".join(str(int(p)) for p in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    digits = "".join(c for c in text if c in CLASSES[0])
    if kind != "phone":
        return digits
    if text[0] == "+":
        n = 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
        return f"{digits[:n]}|{digits[n:]}"
    return f"{'' if digits[0] == '0' else '1'}|{digits}"


def written(kind: str, text: str, new: str) -> str:
    """A surrogate in its one form, written as text was."""
    if kind == "ip":
        return str(ipaddress.ip_address(new)) if ":" in new else new
    if kind == "email":
        return f"{cased(text, new)}.example"
    if kind == "name":
        return cased(text, new)
    if kind == "phone":
        new = new.partition("|")[2]
    places = [k for k, c in enumerate(text) if c in CLASSES[0]] if kind != "iban" else [k for k, c in enumerate(text) if c != " "]
    out = list(text)
    for k, c in zip(places[len(places) - len(new) :], new, strict=True):
        out[k] = c
    return "".join(out)


def cased(text: str, new: str) -> str:
    """new with the capitals of text: letter by letter where both are as long."""
    if len(new) == len(text):
        return "".join(x.upper() if c.isupper() and len(x.upper()) == 1 else x for c, x in zip(text, new, strict=True))
    return new.upper() if len(text) > 1 and text.isupper() else new[:1].upper() + new[1:] if text[:1].isupper() else new


def words_of(name: str) -> tuple[str, list[str]]:
    """The form of address that a name begins with, if any, and its words."""
    title = TITLE.match(name)
    at = title.end() if title else 0
    return name[:at], name[at:].split(" ")


def remainder(iban: str) -> int:
    """Of an IBAN whose first four characters were moved to its end, divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban)) % 97


def is_ipv6(text: str) -> bool:
    try:
        return text != "::" and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def check_digit(digits: list[int]) -> int:
    """The Luhn digit that follows digits."""
    return -sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10


def range_of(address: str) -> str:
    a = ipaddress.ip_address(address)
    for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/8", "240.0.0.0/4"):
        if a in ipaddress.ip_network(net):
            return net
    return "public"


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities, in order and without overlaps."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text)]
        found += [(*m.span(), "card") for m in CARD.finditer(text)]
        found += [(*m.span(), "phone") for m in PHONE.finditer(text)]
        found += [(*m.span(), "ssn") for m in SSN.finditer(text)]
        found += [(*m.span(), "iban") for m in IBAN.finditer(text) if (x := m[0].replace(" ", "")) and 15 <= len(x) <= 34 and remainder(x[4:] + x[:4]) == 1]
    if ":" in text:
        found += [(*m.span(), "ip") for m in IPV6.finditer(text) if is_ipv6(m[0])]
    found += [(*m.span(), "name") for m in NAME.finditer(text)]
    out = apart(found)
    met = {x for s, e, kind in out if kind == "name" for w in words_of(text[s:e])[1] for x in (w, w.upper())}
    if met:
        again = re.compile(rf"(?<![\w’'-])(?:{'|'.join(map(re.escape, sorted(met, key=len, reverse=True)))})(?![\w-]|[’']\w\w)")
        at, more = 0, []
        for s, e, _ in [*out, (len(text), len(text), "")]:
            more += [(*m.span(), "name") for m in again.finditer(text, at, s)]
            at = e
        out = sorted(out + more)
    return out


def apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order without overlaps: the earlier, then the longer stays."""
    out, at = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if s >= at:
            out.append((s, e, kind))
            at = e
    return out


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """text with surrogates, and (kind, value in its one form, surrogate) of each entity."""
    parts, made, at = [], [], 0
    found = []
    for s, e, kind in detect(text):
        title, words = words_of(text[s:e]) if kind == "name" else ("", [text[s:e]])
        found.append((s, e, kind, title, [(w, one_form(kind, w)) for w in words]))
    given = surrogates.assigned({(kind, x) for _, _, kind, _, words in found for _, x in words})
    for s, e, kind, title, words in found:
        new = title + " ".join(written(kind, w, given[kind, x]) for w, x in words)
        parts += [text[at:s], new]
        made.append((kind, " ".join(x for _, x in words), new))
        at = e
    return "".join([*parts, text[at:]]), made


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the text with surrogates, and entities: kind, surrogate, and a keyed digest of the value's one form."""
    attach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        digest = lambda kind, x: hmac.new(key, f"{kind}|{x}".encode(), hashlib.sha256).hexdigest()
        entity = pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string()), ("digest", pa.string())]))
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                texts, entities = [], []
                for t in b["text"].to_pylist():
                    new, made = (t, []) if not t else replace(t, surrogates)
                    texts.append(new)
                    entities.append([{"kind": k, "surrogate": s, "digest": digest(k, x)} for k, x, s in made])
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(texts, pa.string()), pa.array(entities, entity)], names=["id", "text", "entities"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string, entities array<struct<kind:string,surrogate:string,digest:string>>").withColumnRenamed("id", id_col)


def collisions(pseudonymised: DataFrame) -> DataFrame:
    """Surrogates that stand for several values, over the whole table; none, unless keys or versions were mixed."""
    e = pseudonymised.select(F.explode("entities").alias("e")).select("e.*")
    plain = F.when(F.col("kind").isin("email", "name"), F.lower("surrogate")).otherwise(F.col("surrogate"))
    return e.groupBy("kind", plain.alias("surrogate")).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("kind", "surrogate")
