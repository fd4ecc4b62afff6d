"""Keyed surrogates for personal data.

Detected entities are replaced by values drawn from an HMAC of their canonical form, so
one entity has one surrogate in the whole corpus, in whatever format it is written.  A
surrogate has its entity's type, script, gender and format: separators, letter case and
lengths stay, a card keeps its issuer digit and whether its check digit holds, an IBAN
gets valid check digits, a private address stays private, a woman's name ends as one.

Distinctness is checked over all entities of the corpus: where two share a surrogate, or
a surrogate is itself an entity of the corpus, all but the first are drawn again with a
counter until none is left.  Only entities are shuffled.  Those with a counter above zero
are broadcast while they are few by count, and joined to the documents otherwise.

Names are found after a form of address; a surname alone and with a first name has the
same surrogate, as names are replaced word by word.

Defined cases: a null text stays null and has no entity; an empty text stays empty;
texts without an entity come back unchanged; overlapping finds: the first, longest one
counts; repeated rows and null ids each give their row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreledger.sources.stored import drop_stored, stored

MAX_DRAWS = 64
BROADCAST_ENTITIES = 100_000
_LENGTHEN_FROM = 4

# Forms of address by gender.
ADDRESS = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа", "Г-жа"),
}
_GENDER = {word: g for g, words in ADDRESS.items() for word in words}
_SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "ko", "la", "le", "li",
              "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "ta"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми",
                 "мо", "на", "не", "ни", "но", "па", "пе", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "то", "фе", "фо"),
}
_ENDING = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на",
           ("latin", "s"): "rt", ("cyrillic", "s"): "ров"}

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NUMBER = re.compile(
    rf"""(?<![\w.,@+-])(?:
    (?P<phone>(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}
      |\+\d{{1,3}}(?:[ .-]\d{{2,4}}){{2,4}}|\+\d{{8,15}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})
    |(?P<card>\d{{4}}(?:[ -]\d{{4}}){{2}}[ -]\d{{1,7}}|\d{{13,19}})
    |(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})
    |(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})
    )(?![\w@]|[.-]\d)""", re.VERBOSE | re.ASCII)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NAME_WORD = r"[^\W\d_a-zß-öø-ÿа-я][^\W\d_]+(?:-[^\W\d_a-z][^\W\d_]+)?"
_PERSON = re.compile(
    r"(?<!\w)(?P<address>" + "|".join(sorted(_GENDER, key=len, reverse=True)) + rf")\.?\ (?P<name>{_NAME_WORD}(?:\ {_NAME_WORD}){{0,2}})")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> int:
    """Check digit that makes ``digits`` plus it sound."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + (k % 2 == 0))
        total += n - 9 * (n > 9)
    return -total % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity, in order, without overlaps."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            kind, raw = m.lastgroup, m[0]
            if kind == "phone":
                country = re.match(r"\+\d{1,3}(?=[ .(-])", raw)
                raw = raw[country.end():].lstrip(" .-") if country else raw
            start = m.end() - len(raw)
            out.append((start, m.end(), kind, raw if kind == "ip" else _digits(raw)))
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                out.append((*m.span(), "iban", plain))
    for m in _PERSON.finditer(text):
        gender, at = _GENDER[m["address"]], m.start("name")
        words = m["name"].split(" ")
        for k, word in enumerate(words):
            script = "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"
            role, value = gender if k < len(words) - 1 else "s", word.lower()
            if (role, gender, script) == ("s", "f", "cyrillic"):
                value = value.removesuffix("а")  # a woman's form of a family name
            out.append((at, at + len(word), f"name:{role}:{script}", value))
            at += len(word) + 1
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, reach = [], 0
    for e in out:
        if e[0] >= reach:
            kept.append(e)
            reach = e[1]
    return kept


class _Stream:
    """Numbers drawn from an HMAC of an entity and its counter."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.key, self.seed = key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        self.value, self.room, self.block = 0, 1, 0

    def below(self, n: int) -> int:
        if self.room < n << 64:
            digest = hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256)
            self.value, self.room, self.block = int.from_bytes(digest, "big"), 1 << 256, self.block + 1
        self.value, out = divmod(self.value, n)
        self.room //= n
        return out


def _shaped(text: str, draw: _Stream) -> str:
    """Letters for letters and digits for digits; other characters stay."""
    def one(c: str) -> str:
        if c.isdigit():
            return str(draw.below(10))
        if "Ѐ" <= c.lower() <= "ӿ":
            return chr(ord("а") + draw.below(32))
        return chr(97 + draw.below(26)) if c.isalpha() else c
    return "".join(map(one, text))


def _email(value: str, counter: int, key: bytes) -> str:
    local, _, domain = value.partition("@")
    host, _, top = domain.rpartition(".")
    draw = _Stream(key, "email", value, counter)
    new = _shaped(local, draw) + "".join(str(draw.below(10)) for _ in range(counter - _LENGTHEN_FROM + 1))
    return f"{new}@{_shaped(host, _Stream(key, 'domain', domain))}.{top}"


def _phone(value: str, counter: int, key: bytes) -> str:
    draw = _Stream(key, "phone", value, counter)
    return str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in value[1:])


def _card(value: str, counter: int, key: bytes) -> str:
    draw = _Stream(key, "card", value, counter)
    body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
    sound, check = _luhn(value[:-1]) == int(value[-1]), _luhn(body)
    return body + str(check if sound else (check + 1 + draw.below(9)) % 10)


def _ip(value: str, counter: int, key: bytes) -> str:
    draw, old = _Stream(key, "ip", value, counter), value.split(".")
    if old[0] in ("10", "127"):
        keep = old[:1]
    elif old[:2] == ["192", "168"] or old[0] == "172" and 16 <= int(old[1]) < 32:
        keep = old[:2]
    else:
        keep = [str(11 + draw.below(116))]
    return ".".join(keep + [str(draw.below(256)) for _ in range(4 - len(keep))])


def _ssn(value: str, counter: int, key: bytes) -> str:
    draw = _Stream(key, "ssn", value, counter)
    return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"


def _iban(value: str, counter: int, key: bytes) -> str:
    body = _shaped(value[4:], _Stream(key, "iban", value, counter)).upper()
    number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
    return f"{value[:2]}{98 - number % 97:02d}{body}"


def _name(kind: str) -> Callable[[str, int, bytes], str]:
    _, role, script = kind.split(":")

    def of(value: str, counter: int, key: bytes) -> str:
        draw = _Stream(key, kind, value, counter)
        n = 2 + draw.below(2) + max(0, counter - _LENGTHEN_FROM + 1)
        parts = [_SYLLABLES[script][draw.below(len(_SYLLABLES[script]))] for _ in range(n)]
        return "".join(parts) + _ENDING[script, role]
    return of


_DRAW: dict[str, Callable[[str, int, bytes], str]] = {
    "email": _email, "phone": _phone, "card": _card, "ip": _ip, "ssn": _ssn, "iban": _iban}
_DRAW |= {f"name:{r}:{s}": _name(f"name:{r}:{s}") for r in "mfs" for s in _SYLLABLES}


def surrogate(kind: str, value: str, counter: int, key: bytes) -> str:
    """Canonical surrogate of a canonical entity."""
    if counter >= MAX_DRAWS:
        raise ValueError(f"no free surrogate of kind {kind} in {MAX_DRAWS} draws")
    return _DRAW[kind](value, counter, key)


def written_like(new: str, old: str) -> str:
    """A canonical surrogate in the format of the text it replaces."""
    if not old.isalnum() and new.isalnum() and _digits(new) and len(new) == sum(map(str.isalnum, old)):
        fresh = iter(new)
        return "".join(next(fresh) if c.isalnum() else c for c in old)
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def replaced(text: str | None, key: bytes, counters: dict[tuple[str, str], int]) -> tuple[str | None, list]:
    """The text with its surrogates, and the entities' spans in the original."""
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, value in found:
        new = surrogate(kind, value, counters.get((kind, value), 0), key)
        if kind.startswith("name:s"):
            new += text[start:end].lower()[len(value):]
        out += [text[at:start], written_like(new, text[start:end])]
        at = end
    return "".join(out) + text[at:], found


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, text hash), once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, v, h) for h, t in zip(batch.column(0).to_pylist(), batch.column(1))
                    for k, v in {(e[2], e[3]) for e in find(t.as_py())}]
            kind, value, of = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(of, pa.int64())],
                names=["kind", "value", "text_hash"])

    rows = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text))
    return rows.mapInArrow(run, "kind string, value string, text_hash long")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, counter, surrogate) from (kind, value, counter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(*row, key) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(new, pa.string())], names=["kind", "value", "counter", "surrogate"])

    return entities.select("kind", "value", "counter").mapInArrow(
        run, "kind string, value string, counter int, surrogate string")


def distinct_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, counter, surrogate) with no surrogate twice and none that is an entity.

    Every round draws again only what clashed; the holder with the lowest counter, then
    value, keeps a shared surrogate.
    """
    named = stored(_drawn(entities.withColumn("counter", F.lit(0)), key), "surrogates")
    real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("is_real"))
    while True:
        holders = named.groupBy("kind", "surrogate").agg(F.min(F.struct("counter", "value")).alias("holder"))
        judged = named.join(holders, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        again = (F.col("holder.value") != F.col("value")) | F.col("is_real").isNotNull()
        marked = stored(judged.select("kind", "value", "counter", "surrogate", again.alias("again")), "clashes")
        clashed = marked.filter("again")
        if clashed.isEmpty():
            drop_stored(marked)
            return named
        fresh = _drawn(clashed.withColumn("counter", F.col("counter") + 1), key)
        before, named = named, stored(marked.filter("not again").drop("again").unionByName(fresh), "surrogates")
        drop_stored(before)
        drop_stored(marked)


def pseudonymised(
    docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", broadcast_entities: int = BROADCAST_ENTITIES,
) -> DataFrame:
    """(key, n_entities, spans, text) of every row, the text with surrogates in it.

    ``spans`` joins kind:start:end of the original text, in code points, end exclusive.
    ``secret`` is the key: the same secret gives the same surrogates.
    """
    raw = secret.encode()
    met = stored(mentions(docs, text), "mentions")
    named = distinct_surrogates(met.select("kind", "value").distinct(), raw)
    drawn_again = stored(named.filter("counter > 0").select("kind", "value", "counter"), "again")
    rows = docs.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    shape = f"`{key}` {kind}, n_entities long, spans string, `{text}` string"
    if drawn_again.count() <= broadcast_entities:
        table = {(r["kind"], r["value"]): r["counter"] for r in drawn_again.toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(table)
        return rows.mapInArrow(_rewrite(raw, shared, key, text), shape)
    counters = met.join(drawn_again, ["kind", "value"]).groupBy("text_hash").agg(
        F.collect_set(F.struct("kind", "value", "counter")).alias("counters"))
    joined = rows.withColumn("text_hash", F.xxhash64(text)).join(counters, "text_hash", "left").select(key, text, "counters")
    return joined.mapInArrow(_rewrite(raw, None, key, text), shape)


def _rewrite(raw: bytes, shared, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, new = [], [], []
            for row, cell in enumerate(batch.column(1)):
                if shared is not None:
                    table = shared.value
                else:
                    table = {(c["kind"], c["value"]): c["counter"] for c in batch.column(2)[row].as_py() or ()}
                out, found = replaced(cell.as_py(), raw, table)
                n.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
                new.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.string()), pa.array(new, pa.string())],
                names=[key, "n_entities", "spans", text])
    return run
