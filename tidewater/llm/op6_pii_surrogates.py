"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Detected are e-mail addresses, IPv4 addresses, phone numbers, card numbers (15 or 16 digits
that pass the Luhn check; others are ids of some kind and stay), national numbers (3-2-4 digits), IBANs, secrets after a word like `token =`, and names of people: after
a title, a common first name or a phrase that names someone, before a verb of speech, or by
family name and title in Chinese, Japanese and Korean. A name that a text gives so is also
found wherever the text has it again with a capital letter. An entity is a type and a canonical value (lower
case, digits only, numbers with their country code, ...), so all its mentions, in any format and in any document, get one
surrogate: first and last names, and the domains of addresses, are entities of their
own, so a person stays recognisable through `Dr. Anna Vogt`, `Ms. Vogt` and `Anna`.

A surrogate comes from a keyed hash of the entity and a number of attempts: card numbers
keep their first digit and their Luhn check, IBANs their country and get a valid check,
phones their country code, addresses in private networks their prefix, names their
gender's ending and script. Where attempts fail, the space grows: every WIDEN of them add a letter
to mailboxes, domains, secrets and names, and a digit to phones; card numbers, national numbers and IBANs
grow so after 3 * WIDEN attempts; addresses of small private networks turn to
10.*, and after 3 * WIDEN attempts to public ones. It is written in the mention's own format. Distinctness is checked
over the corpus: the distinct entities (pre-aggregated in each task) try in rounds; one
whose surrogate is a real entity, or already given, or claimed by a smaller entity, tries again.
Entities that needed more than one attempt are few; they are broadcast when counted at
EXCEPTIONS rows at most, and beyond that joined to the texts by a digest of the text.
Texts are not shuffled otherwise.

The key is the setting `spark.tidewater.pii.key`, and where that is not set a random one of the
application: surrogates then differ from run to run, and nobody can try names against them.

Defined results: null text stays null, without entities; an empty one stays empty; texts of any length are
searched whole; rows are replaced on their own,
so repeated rows get equal results; overlapping mentions: the leftmost, and there the
type that is named first above in PATTERNS; an empty table gives no rows; other columns
are passed on as they are, one that has the count's name gives way to the count; ROUNDS attempts without success raise an error.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, documents, few, ship, stored

KEY_SETTING = "spark.tidewater.pii.key"
EXCEPTIONS = 100_000
ROUNDS = 50
WIDEN = 4
HELD = 200_000
_keys: dict[str, bytes] = {}

# Titles with their gender, common first names by gender and script, phrases before and verbs after a
# name, words that begin sentences, family names and titles after a name, and countries' numbers of three digits by their first two.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "السيد": "m", "السيدة": "f"}
FIRST = {
    "f": "Anna Maria Emma Julia Laura Sophie Claire Camille Elena Lucia Carmen Isabel Sarah Emily Jessica Elizabeth Jennifer Katharina Susanne Monika Nathalie Isabelle Анна Мария Елена Ольга Наталья",
    "m": "James John Robert Michael William David Thomas Peter Hans Klaus Stefan Jürgen Pierre Jean François Laurent Carlos José Miguel Antonio Alejandro Juan Иван Сергей Дмитрий Алексей Николай",
}
BEFORE = ("name is", "Name:", "named", "signed by", "written by", "contact", "Dear", "Sincerely,", "regards,")
AFTER = ("said", "says", "asked", "replied", "wrote", "called", "told", "sagte", "schrieb", "fragte", "dijo")
STARTS = "The This That Then There These Those They We He She It You And But Or So If When While After Before In On At As For From With Yesterday Today Later Der Die Das Und Le La Les El Los"
FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗김이박최정강조윤장임"
EASTERN = "先生|女士|小姐|さん|씨|님"
LONG_CODES = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99"
# Scripts: first and last character, consonants, vowels, endings of female, male and other first names and of last names.
SCRIPTS = {
    "latin": ("A", "ɏ", "bdfgklmnprstv", "aeiou", "a", "n", "e", "k"),
    "greek": ("Ͱ", "Ͽ", "βγδκλμνπρστ", "αεηιο", "α", "ς", "ι", "ς"),
    "cyrillic": ("Ѐ", "ӿ", "бвгдзклмнпрст", "аеиоу", "а", "н", "е", "к"),
    "arabic": ("؀", "ۿ", "بتدرسعفقكلمن", "اوي", "ة", "ن", "ي", "ي"),
    "kana": ("ァ", "ヿ", "カサタナハマラ", "アイウエオ", "コ", "オ", "ミ", "ダ"),
    "han": ("一", "鿿", FAMILY[:20], "文明华伟芳英国平林海玉春成东志安宁远", "", "", "", ""),
    "hangul": ("가", "힣", FAMILY[20:], "민서준하은지우현수영진호", "", "", "", ""),
}

GENDER = {name: g for g, names in FIRST.items() for name in names.split()}
_NAME = rf"(?!(?:{'|'.join(STARTS.split())})\b)[A-ZÀ-ÞΑ-ΩΆ-ΏА-Яؠ-ي]\w*(?:[’'-]\w+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[\w.+-]*\w@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
}
SECRET = r"(?i:\b(?:token|secret|password|passwd|api[ _-]?key|access[ _-]?key)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_+/=-]{12,})"
NUMERIC = re.compile(SECRET + "|" + "|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()).replace("\\1", "(?P=p1)").replace("\\2", "(?P=p2)").replace("([.-])", "(?P<p1>[.-])").replace("([ -]?)", "(?P<p2>[ -]?)"))
PERSON = re.compile(
    rf"\b(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ ](?P<a>{_NAME})(?:[ ](?P<b>{_NAME}))?|\b(?P<c>{'|'.join(GENDER)})[ ](?P<d>{_NAME})"
    rf"|\b(?:{'|'.join(BEFORE)})\s+(?P<e>{_NAME})[ ](?P<f>{_NAME})|\b(?P<g>{_NAME})[ ](?P<h>{_NAME})[ ](?:{'|'.join(AFTER)})\b"
    rf"|(?P<east>[{FAMILY[:20]}][一-鿿]{{1,2}}(?=(?:{EASTERN}))|[{FAMILY[20:]}][가-힣]{{2}}(?= ?(?:{EASTERN}))|[ァ-ヿ]{{2,}}(?=(?:{EASTERN})))"
)
SEEN = re.compile("[0-9@=:]")
WORD = re.compile(_NAME)
#: Words of which a text has one if it gives a name away, and marks around words.
TELLING = frozenset([*TITLES, *GENDER, *AFTER, *(w.strip(",:") for p in BEFORE for w in p.split() if w not in ("is", "by"))])
MARKS = ".,;:!?()[]\"'«»“”„‘’…-"
EAST = re.compile(EASTERN)


def telling(text: str) -> bool:
    words = set(text.split())
    return not TELLING.isdisjoint(words) or not TELLING.isdisjoint([w.strip(MARKS) for w in words]) or (not text.isascii() and bool(EAST.search(text)))


def luhn(digits: str) -> int:
    """The sum's last digit: 0 for a valid number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def e164(raw: str) -> str:
    """A phone number's digits with the country's: 1 for ten digits without a plus sign."""
    digits = re.sub(r"\D", "", raw)
    return f"1{digits}" if "+" not in raw and len(digits) == 10 else digits


def country(number: str) -> str:
    return number[: 1 if number[:1] in "17" else 3 if number[:2] in LONG_CODES.split() else 2]


def people(text: str) -> list[tuple[int, int, str, str]]:
    """The mentions of names: those that a title, a first name, a phrase or a verb gives away, and the same words elsewhere in the text."""
    found: list[tuple[int, int, str, str]] = []
    known: dict[str, str] = {}

    def add(m, group, kind):
        start, end = m.span(group)
        end -= 2 * (m[group][-2:] in ("'s", "’s"))
        value = text[start:end].lower()
        if len(value) > 1:
            known[value] = kind if known.get(value, "first-n") == "first-n" else known[value]
            found.append((start, end, kind, value))

    for m in PERSON.finditer(text):
        if m["east"]:
            found.append((*m.span("east"), "person", m["east"]))
            continue
        gender = TITLES[m["title"]] if m["title"] else "n"
        first, last = next((x for x in (("a", "b"), ("", "a"), ("c", "d"), ("e", "f"), ("g", "h")) if m[x[1]] and (not x[0] or m[x[0]])))
        if first:
            add(m, first, f"first-{GENDER.get(m[first], gender)}")
        add(m, last, "last")
    if known:
        for m in WORD.finditer(text):
            raw = m[0][:-2] if m[0][-2:] in ("'s", "’s") else m[0]
            if raw.lower() in known:
                found.append((m.start(), m.start() + len(raw), known[raw.lower()], raw.lower()))
    return [(a, b, known.get(v, k), v) for a, b, k, v in found]


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) in order, without overlaps."""
    found = []
    if SEEN.search(text):
        for m in NUMERIC.finditer(text):
            kind = next(k for k in ("secret", *PATTERNS) if m[k] is not None)
            raw, (a, b) = m[kind], m.span(kind)
            if kind == "email":
                at = raw.index("@")
                found += [(a, a + at, "local", raw.lower()), (a + at + 1, b, "domain", raw[at + 1 :].lower())]
            elif kind == "secret":
                found.append((a, b, "secret", raw.lower() if raw.isupper() else raw))
            elif kind == "ip":
                found.append((a, b, "ip", raw))
            elif kind == "iban":
                found.append((a, b, "iban", raw.replace(" ", "")))
            elif kind == "phone":
                found.append((a, b, "phone", e164(raw)))
            elif kind != "card" or luhn(re.sub(r"\D", "", raw)) == 0:
                found.append((a, b, kind, re.sub(r"\D", "", raw)))
    if telling(text):
        if names := people(text):
            found = sorted(found + names, key=lambda x: x[:2])
            kept, end = [], 0
            for x in found:
                if x[0] >= end:
                    kept.append(x)
                    end = x[1]
            found = kept
    return found


class Stream:
    """Numbers from a keyed hash of an entity and an attempt."""

    def __init__(self, kind: str, value: str, attempt: int, key: bytes):
        self.seed, self.n, self.pool = f"{kind}\0{value}\0{attempt}".encode(), 0, 0
        self.key, self.left = key, 0

    def below(self, n: int) -> int:
        if self.left < 3:
            h = hashlib.blake2b(self.seed + self.n.to_bytes(4, "little"), key=self.key)
            self.pool, self.left, self.n = int.from_bytes(h.digest(), "little"), 30, self.n + 1
        self.left -= 1
        self.pool, r = self.pool >> 16, self.pool & 0xFFFF
        return r % n

    def shaped(self, value: str) -> str:
        """Digits for digits, letters for letters of the same case, the rest as it is."""
        hexadecimal = len(value) >= 16 and re.fullmatch(r"[0-9a-f]+", value) and not value.isdigit()
        out = []
        for c in value:
            if hexadecimal:
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def script(value: str) -> str:
    return next((k for c in value for k, (low, high, *_) in SCRIPTS.items() if low <= c <= high), "latin")


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = b"") -> str:
    """The canonical surrogate of an entity."""
    s = Stream(kind, value, attempt, key)
    more = attempt // WIDEN
    if kind == "local":  # the whole address is the entity, its local part the surrogate
        return s.shaped(value[: value.index("@")] + "a" * more)
    if kind == "domain":
        head, _, top = value.rpartition(".")
        return f"{s.shaped(head + 'a' * more)}.{top}"
    if kind == "secret":
        return s.shaped(value) + s.shaped("a" * more)
    if kind == "ip":
        prefix = re.match(r"(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01])|169\.254)\.", value)
        keep = prefix[0].rstrip(".").split(".") if prefix else []
        if keep and more:
            keep = [] if more >= 3 else keep[:1] if len(keep) == 1 else ["10"]
        own = [str(1 + s.below(254)) for _ in range(4 - len(keep))]
        if not keep:
            while own[0] in ("10", "127", "169", "172", "192") or int(own[0]) > 223:
                own[0] = str(1 + s.below(223))
        return ".".join(keep + own)
    late = "1" * max(0, more - 2)
    if kind == "phone":
        code = country(value)
        rest = value[len(code) :] + "1" * more
        return code + "".join(str(1 + s.below(9) if i == 0 and c != "0" else s.below(10)) for i, c in enumerate(rest))
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1] + late)
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "national":
        return "".join(str(s.below(10)) for _ in value + late)
    if kind == "iban":
        rest = s.shaped(value[4:] + late)
        return value[:2] + (_iban_check(value[:2], rest) if _iban_check(value[:2], value[4:]) == value[2:4] else s.shaped(value[2:4])) + rest
    own = script(value)
    _, _, onset, vowel, *ends = SCRIPTS[own]
    if own in ("han", "hangul"):
        return onset[s.below(len(onset))] + "".join(vowel[s.below(len(vowel))] for _ in value[1:] + "1" * more)
    end = ends[("first-f", "first-m", "first-n", "last").index(kind) if kind != "person" else 3]
    body = "".join(onset[s.below(len(onset))] + vowel[s.below(len(vowel))] for _ in range(2 + s.below(2) + more))
    return body + (onset[s.below(len(onset))] if end in vowel else "") + end


def written(raw: str, kind: str, new: str) -> str:
    """The canonical surrogate in the format of the mention."""
    if kind in ("phone", "card", "national"):
        if kind == "phone" and "+" not in raw and sum(c.isdigit() for c in raw) == 10:
            new = new[1:]  # the mention leaves the country's number out
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in raw) + "".join(digits)
    if kind == "iban":
        chars = iter(new)
        return "".join(" " if c == " " else next(chars) for c in raw) + "".join(chars)
    if kind in ("ip", "secret", "person") and not raw.isupper():
        return new
    if raw.isupper() and len(raw) > 1:
        return new.upper()
    if kind in ("local", "domain"):
        return "".join(c.upper() if raw[i : i + 1].isupper() else c for i, c in enumerate(new))
    return new[:1].upper() + new[1:] if raw[:1].isupper() else new


def claim(kind: str, value: str, new: str) -> str:
    """What must be distinct: for the local part, the address within its real domain."""
    return new + value[value.index("@") :] if kind == "local" else new


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, value) of the corpus."""
    ship(docs.sparkSession)

    def detect(batches):
        seen: set = set()

        def rows():
            kinds, values = zip(*seen) if seen else ((), ())
            return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "value": pa.array(values, pa.string())})

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update((k, v) for _, _, k, v in mentions(t))
            if len(seen) > HELD:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select(F.col(text).alias("text")).mapInArrow(detect, "kind string, value string").distinct()


def exceptions(found: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, value, attempt) of the entities whose first surrogate isn't theirs; None if there are none."""
    real = found.select(F.concat_ws("\0", "kind", "value").alias("taken"))

    def candidates(attempt: int):
        def make(batches):
            for b in batches:
                kinds, values = b.column(0).to_pylist(), b.column(1).to_pylist()
                made = [f"{k}\0{claim(k, v, surrogate(k, v, attempt, key))}" for k, v in zip(kinds, values)]
                yield pa.RecordBatch.from_pydict({"kind": b.column(0), "value": b.column(1), "taken": pa.array(made, pa.string())})

        return make

    pending, given, out = found, None, None
    for attempt in range(ROUNDS):
        c = pending.mapInArrow(candidates(attempt), "kind string, value string, taken string")
        free = c.join(real if given is None else real.unionAll(given), "taken", "left_anti")
        won = free.groupBy("taken").agg(F.min(F.struct("kind", "value")).alias("e")).select("taken", "e.kind", "e.value")
        won = stored(won)
        given = won.select("taken") if given is None else given.unionAll(won.select("taken"))
        if attempt:
            new = won.select("kind", "value", F.lit(attempt).alias("attempt"))
            out = new if out is None else out.unionAll(new)
        pending = pending.join(won.select("kind", "value"), ["kind", "value"], "left_anti")
        if pending.isEmpty():
            return out
        pending = stored(pending)
    raise RuntimeError(f"entities without a surrogate after {ROUNDS} rounds")


def surrogate_key(spark: SparkSession) -> bytes:
    """What KEY_SETTING says, or a random key of this application."""
    given = spark.conf.get(KEY_SETTING, None)
    return hashlib.blake2b(given.encode()).digest() if given else _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(64))


def redacted(docs: DataFrame, text: str = "text", key: bytes | None = None, count: str = "n_entities") -> DataFrame:
    """docs with the column text replaced, and the mentions replaced as the column named count."""
    spark = ship(docs.sparkSession)
    key = surrogate_key(spark) if key is None else key
    found = stored(entities(docs, text))
    odd = exceptions(found, key)
    many = odd is not None and not few(odd, EXCEPTIONS)
    known = {} if odd is None or many else {(r.kind, r.value): r.attempt for r in odd.collect()}
    held = spark.sparkContext.broadcast(known)
    out = [n for n in docs.columns if n.lower() != count.lower()]
    at = out.index(text)
    # any name of a column would not do in mapInArrow
    docs = docs.select([c for c, n in zip(columns(docs), docs.columns) if n in out]).toDF(*(f"c{i}" for i in range(len(out))))
    names, text, own_odd, digest = docs.columns, f"c{at}", "odd", "digest"
    rows = docs.withColumn(own_odd, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    if many:
        def detect(batches):
            for b in batches:
                got = [(k, kind, v) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for _, _, kind, v in mentions(t)]
                cols = list(zip(*got)) or [(), (), ()]
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string()) for n, c in zip((digest, "kind", "value"), cols)})

        own = docs.filter(F.col(text).isNotNull()).select(F.sha2(text, 256), F.col(text)).mapInArrow(detect, f"`{digest}` string, kind string, value string").distinct()
        lists = own.join(odd, ["kind", "value"]).groupBy(digest).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own_odd))
        rows = docs.withColumn(digest, F.sha2(text, 256)).join(lists, digest, "left").drop(digest)

    def replace(batches):
        remembered: dict = {}
        for b in batches:
            texts, counts = [], []
            for t, own in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                ms = mentions(t) if t else []
                if ms:
                    special = {(x["kind"], x["value"]): x["attempt"] for x in own} if own else held.value
                    parts, end = [], 0
                    for i, j, kind, value in ms:
                        attempt = special.get((kind, value), 0)
                        e = (kind, value, attempt)
                        if e not in remembered:
                            if len(remembered) > HELD:
                                remembered.clear()
                            remembered[e] = surrogate(kind, value, attempt, key)
                        parts += [t[end:i], written(t[i:j], kind, remembered[e])]
                        end = j
                    t = "".join(parts) + t[end:]
                texts.append(t)
                counts.append(len(ms))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*names, "count"])

    return rows.mapInArrow(replace, T.StructType([*docs.schema.fields, T.StructField("count", T.LongType())])).toDF(*out, count)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(documents(spark, sf_dir).select("doc_id", "text"))
