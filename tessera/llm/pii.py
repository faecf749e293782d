"""Surrogates for personal data and secrets.

Entities are found in the whole text, each distinct one (type and normal form)
gets a surrogate drawn from a keyed hash, and every mention is rewritten in
its own format. A surrogate keeps type, script, gender of a name, separators
and check digits. Collision checks over the whole corpus give every entity a
surrogate of its own that is no real entity either, so distinct stay distinct
and mentions of one entity stay one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, unpacked
from tessera.plans.util import materialize

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)++[A-Za-z]{2,24}(?![A-Za-z0-9])")
_RUN = re.compile(r"[+(0-9][0-9().+ \-]*[0-9]")
_IPV4 = re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])")
_CARD = re.compile(r"(?<![0-9])(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})"
                   r"(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE = re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9])|\+[0-9]{8,15}(?![0-9])")
#: Groups of digits without a country code, brackets or one of the usual shapes are lists of numbers.
_PHONE_SHAPE = re.compile(r"\+|\(|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$|[0-9]{3} [0-9]{3}[ -][0-9]{4}$|0[0-9]{1,4}[ ./-][0-9 .-]+$")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", re.I)
_SIGN = re.compile(r"[=:]")
_NAMED = re.compile(r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}$", re.I)
_VALUE = re.compile(r"\s{0,3}[\"']?([A-Za-z0-9+/_.\-]{6,}+)")
#: Titles by gender (fixed values).
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "г-н"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Madam", "Госпожа", "г-жа"),
          "u": ("Dr", "Prof")}
#: Frequent given names by gender (fixed values).
GIVEN = {"m": ("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Jürgen Klaus "
               "Wolfgang Jean Pierre Michel Jacques Carlos Juan José Luis Miguel Antonio Иван Сергей Дмитрий Алексей").split(),
         "f": ("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Laura Emma Julia Ursula Monika Sabine "
               "Marie Sophie Claire Nathalie María Carmen Ana Isabel Lucía Мария Анна Ольга Елена").split()}
_TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_OF = {n.casefold(): g for g, ns in GIVEN.items() for n in ns}
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, _TITLE_OF), key=len, reverse=True))})\.? ({_WORD})(?: ({_WORD}))?")
_NAMES = re.compile(rf"(?<!\w)({'|'.join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))}) ({_WORD})")
#: Phrases after which two capitalised words are a person.
_SAYS_NAME = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Nn]ame:|[Ss]igned by|[Dd]ear) ({_WORD}) ({_WORD})")
#: Words that are names and ordinary words (fixed values), what follows a name rather than a word, and articles.
COMMON = frozenset("will may mark bill rose grace hope joy frank jack rich art gene guy miles chase grant dean earl page price long short "
                   "young white black brown green gray grey gold silver king queen prince bishop pope knight baker cook smart wise wood "
                   "stone field hill lake rivers forest summer winter day april june august sunny star moon bush fox wolf bird fish "
                   "church castle bridge street banks park parks law best power powers love moss reed marsh west north east south "
                   "klein gross lang weiss schwarz braun koch petit blanc grand rojo blanco".split())
_NAME_GOES_ON = re.compile(r"['’]s(?!\w)|\s*(?:[.,;:!?)\"]|$)|\s+(?:said|says|asked|told|was|is|has|had|and|or|who|wrote|replied|came|went|left|called|met|knew|"
                           r"sagte|ist|war|hat|und|a dit|est|était|et|dijo|es|era|y)(?!\w)")
_ARTICLE = re.compile(r"(?<!\w)(?:the|an?|this|that|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una)\s+$", re.I)
_POSSESSIVE = re.compile(r"['’]s$")
_SYLLABLES = {"latin": ("ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti "
                        "to va ve vi za").split(),
              "cyrillic": "ба бе бо ва ве ви га да де ди ка ке ла ле ли ма ме ми на не ни но па ра ре ри са се та те ти за".split()}
_ENDS = {"latin": {"m": "n s r k d".split(), "f": "a ia ina elle".split(), "u": "e y o".split(), "family": "son man ner ley".split()},
         "cyrillic": {"m": "н р к й".split(), "f": "а я ина".split(), "u": "о е".split(), "family": "ов ин енко".split()}}


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    norm: str


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def mentions(text: str) -> list[Mention]:
    """Entities of the whole text, in order, without overlaps (the earlier,
    then the longer, wins). Cheap tests on the text come before patterns."""
    out: list[Mention] = []

    def add(m: re.Match, kind: str, norm: str, group: int = 0, shift: int = 0) -> None:
        out.append(Mention(m.start(group) + shift, m.end(group) + shift, kind, norm))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, "email", m[0].lower())
    runs = [r for r in _RUN.finditer(text) if r.end() - r.start() >= 7]
    for run in runs:
        part, at = run[0], run.start()
        for kind, pattern in (("ipv4", _IPV4), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(part):
                if kind == "phone" and not _PHONE_SHAPE.match(m[0]):
                    continue
                if kind != "ipv4" or "." in part:
                    # a phone number is its last ten digits, with or without a country code
                    add(m, kind, m[0] if kind == "ipv4" else _digits(m[0])[-10:] if kind == "phone" else _digits(m[0]), shift=at)
    if any(c in text for c in "0123456789"):
        for m in _IBAN.finditer(text):
            add(m, "iban", m[0].replace(" ", ""))
    if "AKIA" in text or "ASIA" in text or "akia" in text or "asia" in text:
        for m in _KEY.finditer(text):
            add(m, "key", m[0].upper())
    if "=" in text or ":" in text:
        for m in _SIGN.finditer(text):
            if _NAMED.search(text, max(0, m.start() - 24), m.start()):
                v = _VALUE.match(text, m.end())
                if v:
                    value = v[1].rstrip(".-")
                    out.append(Mention(v.start(1), v.start(1) + len(value), "secret", value))
    def family(m: re.Match, group: int) -> None:
        name = _POSSESSIVE.sub("", m[group])
        out.append(Mention(m.start(group), m.start(group) + len(name), "family", name.casefold()))

    for m in _TITLED.finditer(text):
        first, last = (m[2], m[3]) if m[3] and m[3][0].isupper() else (None, m[2])
        if not last[0].isupper():
            continue
        if first:
            if not first[0].isupper():
                continue
            gender = _TITLE_OF[m[1]]
            add(m, f"given_{_GIVEN_OF.get(first.casefold(), gender) if gender == 'u' else gender}", first.casefold(), 2)
            family(m, 3)
        else:
            family(m, 2)
    for m in _NAMES.finditer(text):
        if m[2][0].isupper():
            add(m, f"given_{_GIVEN_OF[m[1].casefold()]}", m[1].casefold(), 1)
            family(m, 2)
    for m in _SAYS_NAME.finditer(text):
        if m[1][0].isupper() and m[2][0].isupper() and m[1] not in _TITLE_OF:
            add(m, f"given_{_GIVEN_OF.get(m[1].casefold(), 'u')}", m[1].casefold(), 1)
            family(m, 2)
    return _apart(_one_identity(out))


def _one_identity(found: list[Mention]) -> list[Mention]:
    """Given names with one gender for each name of the document: the one its
    titles or the list of names tell, unless they differ or tell none."""
    told: dict[str, set[str]] = {}
    for x in found:
        if x.kind.startswith("given_") and x.kind != "given_u":
            told.setdefault(x.norm, set()).add(x.kind)
    return [Mention(x.start, x.end, next(iter(told[x.norm])) if len(told.get(x.norm, ())) == 1 else "given_u", x.norm)
            if x.kind.startswith("given_") else x for x in found]


def with_bare_names(text: str) -> list[Mention]:
    """``mentions`` and, for each name among them, every other place where it
    stands as a whole word with the same capitalisation.

    Not carried over: one-letter names (initials); a name after an article
    that no noun follows ("The Universe is big"); and a name that is an
    ordinary word too (one of ``COMMON``, or in lower case in the same text),
    unless what follows is what follows a name ("Brown said", "Will's")."""
    kept = mentions(text)
    names: dict[str, Mention] = {}
    for x in kept:
        if x.kind.startswith(("given_", "family")) and x.end - x.start > 1:
            names.setdefault(text[x.start:x.end], x)
    if names:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, names), key=len, reverse=True))})(?!\w)")
        taken, at = [], 0
        words = {w for w in names if w.casefold() in COMMON}
        lower = {w.lower() for w in names} - set(names)
        if lower:
            seen = set(re.findall(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, lower), key=len, reverse=True))})(?!\w)", text))
            words |= {w for w in names if w.lower() in seen}
        for m in again.finditer(text):
            goes_on = bool(_NAME_GOES_ON.match(text, m.end()))
            if m[0] in words and not goes_on or goes_on and _ARTICLE.search(text, max(0, m.start() - 8), m.start()):
                continue
            while at < len(kept) and kept[at].end <= m.start():
                at += 1
            if at == len(kept) or kept[at].start >= m.end():
                taken.append(Mention(m.start(), m.end(), names[m[0]].kind, names[m[0]].norm))
        kept = _apart(kept + taken)
    return kept


def _apart(found: list[Mention]) -> list[Mention]:
    """``found`` in order without overlaps: the earlier, then the longer, wins."""
    kept: list[Mention] = []
    for x in sorted(found, key=lambda x: (x.start, -x.end, x.kind)):
        if not kept or x.start >= kept[-1].end:
            kept.append(x)
    return kept


def _luhn(d: str) -> int:
    """The check sum of the digits modulo 10 (0: valid)."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10


def _mod97(iban: str) -> int:
    """The number an account stands for modulo 97 (1: valid)."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class _Stream:
    """Numbers from a keyed hash of what they are for."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.count, self.left = key, "\x1f".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.what + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.count += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def like(self, s: str, keep: int = 0) -> str:
        """``s`` with each digit, letter and hex letter replaced by one of
        its class from ``keep`` on."""
        tail = s[keep:]
        hexa = len(tail) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", tail)
        lower, upper = ("abcdef", "ABCDEF") if hexa else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        pick = lambda c: ("0123456789" if c.isdigit() else lower if c.islower() else upper) if c.isascii() and c.isalnum() else c
        return s[:keep] + "".join(p[self.below(len(p))] for p in map(pick, tail))


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the surrogate of an entity."""
    s = _Stream(key, kind, norm, str(attempt))
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        name, _, top = domain.rpartition(".")
        return f"{s.like(local)}@{_Stream(key, 'domain', domain, str(attempt // 8)).like(name)}.{top}"
    if kind == "ipv4":
        parts = norm.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if norm.startswith(("192.168.", "172.16.")) else 0
        return ".".join(p if i < keep else str(1 + s.below(254)) for i, p in enumerate(parts))
    if kind == "card":
        out = s.like(norm, keep=1)
        if _luhn(norm) == 0:
            out = next(out[:-1] + c for c in "0123456789" if _luhn(out[:-1] + c) == 0)
        return out
    if kind == "phone":
        return s.like(norm)
    if kind == "iban":
        out = s.like(norm, keep=4)
        # valid stays valid, and what was not one does not become one
        return out[:2] + f"{98 - _mod97(out[:2] + '00' + out[4:]):02d}" + out[4:] if _mod97(norm) == 1 else s.like(norm, keep=2)
    if kind == "key":
        return s.like(norm, keep=4)
    if kind.startswith(("given_", "family")):
        script = _script(norm)
        syllables, ends = _SYLLABLES[script], _ENDS[script][kind.removeprefix("given_")]
        body = "".join(syllables[s.below(len(syllables))] for _ in range(2 + attempt // 2))
        return body + ends[s.below(len(ends))]
    return s.like(norm)


def in_format(mention: str, kind: str, value: str) -> str:
    """The surrogate's normal form in the mention's own format."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(_digits(mention)[:-len(value)] + value)
        return "".join(next(digits) if c in "0123456789" else c for c in mention)
    if kind == "iban":
        chars = iter(value)
        return "".join(c if c == " " else next(chars) for c in mention)
    if mention.isupper() and kind not in ("secret", "ipv4"):
        return value.upper()
    if kind.startswith(("given_", "family")):
        return value[:1].upper() + value[1:] if mention[:1].isupper() else value
    if kind == "key" and mention.islower():
        return value.lower()
    return value


def rewrite(text: str, names: dict[tuple[str, str], str], bare: bool = False) -> tuple[str, int]:
    """``text`` with its mentions replaced by ``names``; and their number.
    ``bare``: also those of the names found, wherever they stand alone."""
    out, at = [], 0
    found = with_bare_names(text) if bare else mentions(text)
    for x in found:
        out += [text[at:x.start], in_format(text[x.start:x.end], x.kind, names[x.kind, x.norm])]
        at = x.end
    return "".join(out) + text[at:], len(found)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct entities of each document: ``_d``, ``doc_id``, ``kind``, ``norm``."""
    @F.pandas_udf("array<struct<kind:string,norm:string>>")
    def found(s: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "norm": v} for k, v in sorted({(x.kind, x.norm) for x in mentions(t)})] for t in s], dtype=object)

    return (docs.select("_d", "doc_id", F.explode(found(F.coalesce("text", F.lit(""))))
                        .alias("e")).select("_d", "doc_id", "e.kind", "e.norm"))


def assign(distinct: DataFrame, key: bytes, max_attempts: int = 64) -> DataFrame:
    """``distinct`` (``kind``, ``norm``) with ``value``, the surrogates'
    normal forms: no two alike within a kind and none an entity itself. Those
    that collide try again with the next attempt; of several that drew one
    value the least keeps it. Written per attempt to the shared folder."""
    @F.pandas_udf("string")
    def draw(kind: pd.Series, norm: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(kind, norm, attempt)], dtype=object)

    waiting, given = distinct.withColumn("attempt", F.lit(0)), None
    real = distinct.select("kind", F.col("norm").alias("value"))
    for i in range(max_attempts):
        drawn = waiting.select("kind", "norm", "attempt", draw("kind", "norm", "attempt").alias("value"))
        drawn = materialize(drawn, "surrogates-drawn")
        first = drawn.groupBy("kind", "value").agg(F.min("norm").alias("norm"))
        first = first.join(real, ["kind", "value"], "left_anti")
        if given is not None:
            first = first.join(given.select("kind", "value"), ["kind", "value"], "left_anti")
        good = materialize(first.select("kind", "norm", "value"), "surrogates")
        given = good if given is None else given.unionByName(good)
        waiting = drawn.join(good.select("kind", "norm"), ["kind", "norm"], "left_anti").withColumn("attempt", F.lit(i + 1))
        if waiting.isEmpty():
            return given
    raise RuntimeError(f"entities without a surrogate of their own after {max_attempts} attempts")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ...) with surrogates in ``text`` and
    ``n_entities``, the mentions replaced (a name's bare ones too).

    A name of a document is one entity whatever its titles; where they
    disagree on its gender, its surrogate has none.

    The same ``key`` gives the same surrogates to the same corpus. Null text
    stays null (0 mentions), an empty text empty; rows equal in ``doc_id``
    and ``text`` share their result; a null ``doc_id`` is an id like others;
    an empty table gives no rows; other columns pass through, an input
    ``n_entities`` is replaced. A document's own distinct entities are the
    largest group; an entity of many documents is one row on its side of a
    join that the planner can split.
    """
    texts = docs.select(F.xxhash64("doc_id", "text").alias("_d"), "doc_id", "text")
    found = materialize(entities(texts).distinct(), "entities")
    values = assign(found.select("kind", "norm").distinct(), key)
    per_doc = (found.join(values, ["kind", "norm"]).groupBy(F.col("_d").alias("_e"), F.col("doc_id").alias("_id"))
               .agg(F.collect_list(F.struct("kind", "norm", "value")).alias("_names")))
    rows = packed(docs).select("_row", F.xxhash64("_row.doc_id", "_row.text").alias("_d"))
    joined = rows.join(per_doc, F.expr("_d = _e and _row.doc_id <=> _id"), "left")

    @F.pandas_udf("struct<text:string,n:long>")
    def rewritten(text: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t, 0) if n is None else rewrite(t, {(x["kind"], x["norm"]): x["value"] for x in n}, bare=True)
                             for t, n in zip(text, names)], columns=["text", "n"])

    done = joined.select("_row", rewritten(F.col("_row.text"), "_names").alias("_done"))
    return done.select(*unpacked(docs.columns, {"text": F.col("_done.text"), "n_entities": F.col("_done.n")}))
