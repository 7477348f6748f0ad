"""Personal data replaced by surrogates.

An entity has a canonical form: the same address in capitals, or the same number with other
separators, is one entity. Its surrogate is a keyed permutation of the canonical forms of its kind
and make-up, so two entities never share one, and the same entity gets the same one in every
document without any table. What a permutation can't rule out, a surrogate that is some other
entity of the corpus, or no change at all, is checked over the distinct entities of the corpus; those
get others, from ranges that grow with every attempt, until all are free. The surrogate then takes the
written form of what it replaces. Whoever has the key can undo the first surrogates, so it has to be secret.
"""

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm import ciphers
from cartwright.llm.memory import released_batches
from cartwright.llm.tables import Scratch, stored

#: Attempts within a kind's own form, before numbers get longer than it allows.
OWN_FORM = 8

# Forms of address by gender, and given names by gender and script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"),
    "m": ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    "f": (
        ("Anna", "Barbara", "Carla", "Claire", "Elena", "Emma", "Julia", "Karin", "Laura", "Linda",
         "Maria", "Marie", "Mary", "Nora", "Sarah", "Susan"),
        ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    ),
    "m": (
        ("Carlos", "Daniel", "David", "Eric", "Hans", "James", "John", "José", "Karl", "Louis",
         "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas"),
        ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"),
    ),
}

_EMAIL = re.compile(r"[\w.+-]*\w@[\w-]+(?:\.[\w-]+)+")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)\s*[=:]\s*["']([^"'\s]{6,})["']""")
#: Without quotes only what has both a letter and a digit, as words do not.
_BARE_SECRET = re.compile(
    r"""(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)\s*[=:]\s*((?=[^\s"',;]*\d)(?=[^\s"',;]*[a-z])[^\s"',;<>()]{6,})"""
)
#: How well-known services begin their keys.
_ISSUED_KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{10,}|gh[opsu]_[0-9A-Za-z]{20,})\b")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?!\d)")
#: How card numbers of the large issuers begin.
_ISSUER = re.compile(
    r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35(?:2[89]|[3-8])|3(?:0[0-5]|[689])|6(?:011|4[4-9]|5)"
)
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_PHONE = re.compile(
    r"(?<![\d+])(?:\+(\d{1,3})[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d.,-])(?<!\d )\d{3}([ .-])\d{3}\2\d{4}(?![\d-])"
    r"|(?<![\w+])\+[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\d)"
)
#: Calling codes of one and of two digits; all others have three.
_CALLING = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_TITLED = re.compile(
    r"\b(" + "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True))
    + r")\b\.?[ \t]+((?:[^\W\d_a-z][\w'’-]+)(?:[ \t]+[^\W\d_a-z][\w'’-]+){0,2})"
)
_GENDER = {title: gender for gender, group in TITLES.items() for title in group}
_LISTED = {name: gender for gender, lists in GIVEN.items() for names in lists for name in names}
_NAMED = re.compile(r"\b(" + "|".join(_LISTED) + r")[ \t]+([^\W\d_a-z][\w'’-]+)")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_POSSESSIVE = re.compile(r"(?:['’]s|['’-]+)$")


@dataclass(frozen=True)
class Entity:
    """A found entity: its place, its kind, its canonical form."""

    start: int
    end: int
    kind: str
    canonical: str


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _candidates(text: str) -> Iterator[Entity]:
    """All matches, surer kinds first."""
    ascii_digit = re.search(r"[0-9]", text) is not None
    if "@" in text:
        for m in _EMAIL.finditer(text):
            yield Entity(*m.span(), "email", m[0].lower())
    if '"' in text or "'" in text:
        for m in _SECRET.finditer(text):
            yield Entity(*m.span(1), "secret", m[1].lower())
    if ascii_digit:
        for pattern, group in ((_BARE_SECRET, 1), (_ISSUED_KEY, 0)):
            for m in pattern.finditer(text):
                yield Entity(*m.span(group), "secret", m[group].lower())
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if _iban_valid(plain):
                yield Entity(*m.span(), "iban", plain)
        for m in _CARD.finditer(text):
            number = _digits(m[0])
            if 13 <= len(number) <= 19 and _ISSUER.match(number) and luhn_valid(number):
                yield Entity(*m.span(), "card", number)
        for m in _IP.finditer(text):
            parts = m[0].split(".")
            if all(int(p) <= 255 and str(int(p)) == p for p in parts):
                yield Entity(*m.span(), "ip", m[0])
        if "::" in text or text.count(":") >= 7:
            for m in _IPV6.finditer(text):
                plain = _ipv6(m[0])
                if plain:
                    yield Entity(*m.span(), "ipv6", plain)
        for m in _SSN.finditer(text):
            yield Entity(*m.span(), "ssn", _digits(m[0]))
        for m in _PHONE.finditer(text):
            number = _digits(m[0])
            country = m[1] or (_CALLING.match(number)[0] if m[0][0] == "+" else "")
            yield Entity(*m.span(), "phone", number[len(country) :])
    names = [e for m in _TITLED.finditer(text) for e in _names(m)]
    for m in _NAMED.finditer(text):
        if not m[2][0].islower():
            names.append(_name(m.start(1), m[1], f"given_{_LISTED[m[1]]}"))
            names.append(_name(m.start(2), m[2], "surname"))
    yield from names
    kinds: dict[str, str] = {}
    for name in names:
        kinds.setdefault(name.canonical, name.kind)
    if kinds:  # further mentions of the same persons
        for m in _WORD.finditer(text):
            found = _name(m.start(), m[0], "")
            if found.canonical in kinds:
                yield Entity(found.start, found.end, kinds[found.canonical], found.canonical)


def _ipv6(written: str) -> str | None:
    """The short form of an address; None for what is none, or names no machine."""
    groups = [g for g in written.split(":") if g]
    if len(groups) < 3 and not (groups and len(groups[0]) == 4):
        return None
    try:
        return ipaddress.IPv6Address(written).compressed
    except ValueError:
        return None


def _name(start: int, word: str, kind: str) -> Entity:
    plain = _POSSESSIVE.sub("", word) or word
    return Entity(start, start + len(plain), kind, plain)


def _names(m: re.Match) -> Iterator[Entity]:
    """The given name, by the title's gender or its own, and the surnames."""
    words = [(w.start() + m.start(2), w.end() + m.start(2), w[0]) for w in re.finditer(r"\S+", m[2])]
    gender = _GENDER[m[1]]
    for i, (start, _, word) in enumerate(words):
        known = next((g for g, lists in GIVEN.items() if any(word in names for names in lists)), None)
        given = len(words) > 1 and i < len(words) - 1 or known is not None
        kind = f"given_{gender if gender != 'n' else known or 'n'}" if given else "surname"
        yield _name(start, word, kind)


def entities(text) -> list[Entity]:
    """The entities of a text by place, without overlaps; surer kinds win."""
    if not isinstance(text, str) or not text:
        return []
    taken: list[Entity] = []
    starts: list[int] = []
    for found in _candidates(text):
        at = bisect_right(starts, found.start)
        before, after = (taken[at - 1] if at else None), (taken[at] if at < len(taken) else None)
        if (before is None or before.end <= found.start) and (after is None or found.end <= after.start):
            taken.insert(at, found)
            starts.insert(at, found.start)
    return taken


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement.

    The first (attempt 0) is one to one among the forms of a kind and make-up. Later ones come from
    ranges that grow with each attempt: names get more syllables, of the same gender and script, local
    parts of addresses more digits, and after ``OWN_FORM`` attempts numbers more digits, too.
    """
    name = f"{kind}#{attempt}"
    longer = max(0, attempt - OWN_FORM)
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        labels, top = domain.rsplit(".", 1)
        return (
            ciphers.reworded(key, f"{name}/local", local, ciphers.TEXT_ALPHABETS)
            + ciphers.drawn(key, f"{name}/more", canonical, ciphers.DIGITS, attempt)
            + "@" + ciphers.reworded(key, f"{name}/domain", labels, ciphers.TEXT_ALPHABETS) + "." + top
        )
    if kind == "secret":
        hexadecimal = all(c in ciphers.HEX for c in canonical)
        new = ciphers.reworded(key, name, canonical, (ciphers.HEX,) if hexadecimal else ciphers.TEXT_ALPHABETS)
        return new + ciphers.drawn(key, f"{name}/more", canonical, ciphers.HEX, attempt // 2)
    if kind == "iban":
        body = ciphers.reworded(key, name + canonical[:2], canonical[4:], ciphers.TEXT_ALPHABETS)
        body += ciphers.drawn(key, f"{name}/more", canonical, ciphers.DIGITS, longer)
        rest = int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{98 - rest:02d}{body}"
    if kind == "card":
        issuer = _ISSUER.match(canonical)[0]
        body = issuer + ciphers.reworded(key, name + issuer, canonical[len(issuer) : -1], (ciphers.DIGITS,))
        body += ciphers.drawn(key, f"{name}/more", canonical, ciphers.DIGITS, longer)
        return next(body + c for c in ciphers.DIGITS if luhn_valid(body + c))
    if kind == "ip" and not longer:
        number = ciphers.permuted(key, name, int(ipaddress.IPv4Address(canonical)), 2**32)
        return str(ipaddress.IPv4Address(number))
    if kind in ("ip", "ipv6"):  # the network's first 16 bits stay; of version 4 they are those for examples
        whole = int(ipaddress.IPv6Address(canonical if kind == "ipv6" else f"2001:db8::{canonical}"))
        below = 2 ** (112 if kind == "ipv6" else 96)
        return ipaddress.IPv6Address(whole - whole % below + ciphers.permuted(key, name, whole % below, below)).compressed
    if kind in ("ssn", "phone"):
        new = ciphers.reworded(key, name, canonical, (ciphers.DIGITS,))
        return new + ciphers.drawn(key, f"{name}/more", canonical, ciphers.DIGITS, longer)
    if attempt:
        return ciphers.made_name(key, name, canonical, kind[-1] if kind.startswith("given_") else "", attempt)
    for names in GIVEN.get(kind[-1], ()) if kind.startswith("given_") else ():
        if canonical in names:
            return names[ciphers.permuted(key, name, names.index(canonical), len(names))]
    return ciphers.reworded(key, name, canonical, ciphers.NAME_ALPHABETS)


def _rendered(written: str, kind: str, canonical: str, new: str) -> str:
    """The new canonical form, written as the old one was; what is longer stands at the end."""
    if kind in ("card", "ssn", "phone"):
        digits = _digits(written)
        values = iter(digits[: len(digits) - len(canonical)] + new)
        return "".join(next(values) if c.isdigit() else c for c in written) + "".join(values)
    if kind == "iban":
        values = iter(new)
        return "".join(next(values) if c != " " else c for c in written) + "".join(values)
    if kind == "secret" or kind == "email" and len(new) == len(written):
        upper = written.isupper()
        same = "".join(n.upper() if upper or w != w.lower() else n for n, w in zip(new, written))
        return same + (new[len(written) :].upper() if upper else new[len(written) :])
    if kind in ("email", "ipv6") and written.isupper():
        return new.upper()
    return new


def _mark(kind: str, canonical: str, key: bytes) -> str:
    """A keyed digest that stands for an entity in tables that outlast a run."""
    return hmac.new(key, f"{kind}\x1f{canonical}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def replaced(text, attempts: dict[str, int], key: bytes) -> tuple[str | None, int]:
    """The text with surrogates, and how many. ``attempts`` are by the entities' marks."""
    found = entities(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for e in found:
        attempt = attempts.get(_mark(e.kind, e.canonical, key), 0) if attempts else 0
        new = surrogate(e.kind, e.canonical, attempt, key)
        parts += [text[at : e.start], _rendered(text[e.start : e.end], e.kind, e.canonical, new)]
        at = e.end
    return "".join([*parts, text[at:]]), len(found)


def _row_key() -> Column:
    """Rows of one key have the same id and text, and so the same entities."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.md5(F.concat(parts[0], F.lit("\x1f"), parts[1]).cast("binary"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(row_key, kind, canonical), each once a row."""

    @released_batches
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (row_key, kind, canonical)
                for row_key, text in zip(batch["row_key"], batch["text"])
                for kind, canonical in sorted({(e.kind, e.canonical) for e in entities(text)})
            ]
            yield pd.DataFrame(rows, columns=["row_key", "kind", "canonical"])

    return docs.select(_row_key().alias("row_key"), "text").mapInPandas(
        find, "row_key string, kind string, canonical string"
    )


def _family(kind: Column) -> Column:
    """Kinds whose forms could be taken for one another."""
    return F.when(kind.startswith("given_") | (kind == "surname"), "name").when(kind == "ipv6", "ip").otherwise(kind)


def second_choices(found: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first surrogate won't do.

    It is their own form, some entity of the corpus, or taken by a smaller entity. Every attempt is
    checked against all entities and all surrogates given so far, until all are free: ranges grow with
    the attempts, past any number of entities.
    """
    stored = scratch.stored
    real = stored(found.select("kind", "canonical").distinct())
    taken = real.select(_family(F.col("kind")).alias("family"), F.col("canonical").alias("surrogate"))

    def tried(rows: DataFrame, attempt: int) -> DataFrame:
        @F.pandas_udf("string")
        def give(kinds: pd.Series, canonicals: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, c, attempt, key) for k, c in zip(kinds, canonicals)], dtype=object)

        return rows.select(
            "kind", "canonical", give("kind", "canonical").alias("surrogate"), _family(F.col("kind")).alias("family")
        )

    open_, settled, attempt = real, None, 0
    while True:
        rows = stored(tried(open_, attempt))
        first = rows.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "canonical")).alias("entity"))
        good = stored(first.join(taken, ["family", "surrogate"], "left_anti"))
        taken = taken.union(good.select("family", "surrogate"))
        now = good.select("entity.kind", "entity.canonical", F.lit(attempt).alias("attempt"))
        if attempt:
            settled = now if settled is None else settled.union(now)
        open_ = stored(rows.join(now, ["kind", "canonical"], "left_anti").select("kind", "canonical"))
        if open_.isEmpty():
            return now.where("false") if settled is None else settled
        attempt += 1


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with surrogates in ``text`` and their number in ``n_replaced``.

    ``key`` has to be secret and is needed again for the same surrogates. Null texts stay null
    with 0; texts without entities are unchanged. All other columns pass through; an ``n_replaced``
    of the input is replaced. Rows without doc_id are treated like all others, repeated rows get
    the same text, an empty table stays empty. Tables with entities in clear are removed; what stays
    for the result names them by keyed digests.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    scratch = Scratch(docs.sparkSession)
    found = scratch.stored(_occurrences(docs))
    second = scratch.stored(second_choices(found, key, scratch))

    @F.pandas_udf("string")
    def mark(kinds: pd.Series, canonicals: pd.Series) -> pd.Series:
        return pd.Series([_mark(k, c, key) for k, c in zip(kinds, canonicals)], dtype=object)

    marked = second.select("kind", "canonical", F.struct(mark("kind", "canonical").alias("mark"), "attempt").alias("choice"))
    of_row = found.distinct().join(marked, ["kind", "canonical"]).groupBy(F.col("row_key").alias("_chosen_key"))
    of_row = stored(of_row.agg(F.collect_list("choice").alias("_choices")))
    scratch.remove()
    rows = docs.join(of_row, _row_key() == F.col("_chosen_key"), "left").drop("_chosen_key")

    @F.pandas_udf("text string, n_replaced int")
    def replace(texts: pd.Series, choices: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [
                replaced(
                    t if isinstance(t, str) else None,
                    {} if c is None else {choice["mark"]: choice["attempt"] for choice in c}, key,
                )
                for t, c in zip(texts, choices)
            ],
            columns=["text", "n_replaced"],
        )

    return rows.withColumn("_replaced", replace("text", "_choices")).withColumns(
        {"text": F.col("_replaced.text"), "n_replaced": F.col("_replaced.n_replaced")}
    ).drop("_replaced", "_choices")
