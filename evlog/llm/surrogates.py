"""Surrogate generation for personal data.

Detected entities are replaced with others of their type that a keyed hash
draws: the same entity gets the same surrogate everywhere, and format, script,
case and (for names) gender are kept. Two entities never share a surrogate and
no surrogate is another entity of the corpus: collisions are looked for over
the whole corpus and drawn again, from a space that grows, and what is left
after ``MAX_DRAWS`` draws gets numbers of its own in longer surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evlog.llm.tokens import blocks
from evlog.session import materialize

KEY = b"evlog surrogates"  # a deployment passes its own secret
MAX_DRAWS = 40  # random draws; the rest is numbered
GROW = 4  # names and mailboxes get one more syllable or letter after so many draws, private addresses other blocks
RANGES = 4096  # hash ranges in which the rest is numbered
BLOCK_BYTES = 4 << 20

FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κυρία")
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κύριος")
TITLES = (*FEMALE, *MALE, "Dr", "Prof")

#: Syllables that names are made of, by script, and endings by gender.
SYLLABLES = {
    "LATIN": ("ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo").split(),
    "CYRILLIC": "ба бе ва ве га да де жа за зо ка ко ла ле ма ми на не по ра ре са се та те фе хо ча".split(),
    "GREEK": "βα γα δα ζα θα κα λα μα να πα ρα σα τα φα χα βο γε δι κο λε μι νο πο ρε σι το".split(),
}
ENDINGS = {("LATIN", "f"): "a", ("LATIN", "m"): "n", ("LATIN", "u"): "l", ("CYRILLIC", "f"): "а", ("CYRILLIC", "m"): "н",
           ("CYRILLIC", "u"): "л", ("GREEK", "f"): "α", ("GREEK", "m"): "ς", ("GREEK", "u"): "ι"}
ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}

ENTITY = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+)"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?:(?i:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_~.-]{8,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+(?!1)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d))"
    r"|(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\8\d{4}\8\d{1,7}|\d{4}([ -])\d{6}\9\d{5})(?!\d))"
    rf"|(?P<title>(?<!\w)(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\.? (?=[^\W\d_]))")
#: Letters, joined by apostrophes if more than a possessive or contracted verb follows.
WORD = re.compile(r"(?<!\w)[^\W\d_]++(?:['’](?!(?:ll|re|ve)\b)[^\W\d_]{2,}+)*+(?!\w)")
#: What stands between the words of a name: of initials a dot too.
BETWEEN, AFTER_INITIAL = re.compile(r" |[-‐‑]"), re.compile(r"\.? |\.?[-‐‑]|\.")
#: Words in lower case that stand within names.
PARTICLES = frozenset("van von der den de del della di da das dos du la le zu zur bin ibn al el ter ten".split())
#: A text that matches neither of these has no entity: digits are those of all scripts, as in ``ENTITY`` (three are newer than those of Java 17).
#: Both begin with one of few characters, which makes them quick.
HINTS = (r"[0-9=:@\p{Nd}\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1E4F0}-\x{1E4F9}]", f"(?=[A{''.join(sorted({t[0] for t in TITLES}))}])(?:AKIA|(?:{'|'.join(map(re.escape, TITLES))})[.]? )")


def may_have(text: Column) -> Column:
    """False only for texts without entities; simple enough to be read off whole tables."""
    return F.coalesce(text.rlike(HINTS[0]) | text.rlike(HINTS[1]), F.lit(False))


def script(text: str) -> str:
    for char in text:
        if char.isalpha():
            name = unicodedata.name(char, "")
            return next((s for s in SYLLABLES if name.startswith(s)), "LATIN")
    return "LATIN"


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) of the entities, left to right. A name gives one for each of its words after the title.

    A text's names are found without a title too, so that all mentions of a person get one surrogate. Words that the text
    also has in lower case are taken as ordinary ones there.
    """
    found = list(_matches(text))
    names: dict[str, str] = {}
    for _, _, kind, canonical in found:
        if kind.startswith("name-") and len(canonical) > 1:
            names.setdefault(canonical, kind)
    if not names:
        return found
    begins = [begin for begin, *_ in found]

    def free(word: re.Match) -> bool:
        before = bisect_right(begins, word.start()) - 1
        return before < 0 or found[before][1] <= word.start()

    words = [w for w in WORD.finditer(text) if canonical_name(w[0]) in names and w[0] not in TITLES and free(w)]
    for word in words:
        if not capital(word[0]):
            names.pop(canonical_name(word[0]), None)
    found += [(w.start(), w.end(), names[c], c) for w in words if (c := canonical_name(w[0])) in names]
    return sorted(found)


def name_words(text: str, at: int, end: int) -> list[tuple[int, int, bool]]:
    """(begin, end, whether of the family name) of the capitalised words that follow each other from ``at`` on; particles among them stay out.

    The last one is the family name, with all that hyphens join to it.
    """
    words: list[tuple[int, int, int]] = []  # and the number of the word, hyphens joining several parts
    number = 0
    while (word := WORD.match(text, at)) and word.end() <= end:
        if capital(word[0]) and word[0] not in TITLES:
            words.append((word.start(), word.end(), number))
        elif word[0] not in PARTICLES:
            break
        between = (AFTER_INITIAL if len(word[0]) == 1 else BETWEEN).match(text, word.end())
        if not between:
            break
        number += between[0][-1] in " ."
        at = between.end()
    return [(begin, stop, n == words[-1][2]) for begin, stop, n in words]


def capital(word: str) -> bool:
    """Whether a word, or a part of it that an apostrophe joins, begins with a capital: Arc, O'Brien, d'Arc."""
    return any(part[0].isupper() for part in re.split("['’]", word))


def canonical_name(word: str) -> str:
    return word.lower().replace("’", "'")


def _matches(text: str) -> Iterator[tuple[int, int, str, str]]:
    """What ``ENTITY`` finds, with the names after its titles."""
    matches = list(ENTITY.finditer(text))
    gender, title_end = "u", -1
    for i, match in enumerate(matches):
        kind, found = match.lastgroup, match[match.lastgroup]
        begin = match.start(kind)
        if kind == "title":
            title = found.rstrip(". ")
            before = gender if title_end == begin else "u"  # of titles in a row one tells it
            gender, title_end = "f" if title in FEMALE else "m" if title in MALE else before, match.end()
            for at, stop, family in name_words(text, match.end(), matches[i + 1].start() if i + 1 < len(matches) else len(text)):  # the family name: the same for all genders
                word = text[at:stop]
                yield at, stop, f"name-{script(word).lower()}-{'u' if family else gender}", canonical_name(word)
        elif kind == "secret":
            found = found.rstrip(".-")
            if any(c.isdigit() for c in found):
                yield begin, begin + len(found), "secret", found
        elif kind == "email":
            yield begin, begin + len(found), "email", found.lower()
        elif kind in ("phone", "card", "ssn"):
            plain = digits(found)
            if kind == "phone" and len(plain) == 11 and plain[0] == "1":
                plain = plain[1:]  # with or without the country code
            yield begin, begin + len(found), kind, plain
        else:
            yield begin, begin + len(found), kind, found


class Draw:
    """An endless keyed stream of numbers for one entity."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.state = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.at = 0

    def below(self, n: int) -> int:
        if self.at + 4 > len(self.state):
            self.state, self.at = hashlib.sha256(self.state).digest(), 0
        self.at += 4
        return int.from_bytes(self.state[self.at - 4:self.at], "big") % n

    def like(self, text: str) -> str:
        """Other characters of the same kinds: digits, and letters of the same script."""
        out = []
        for c in text:
            if c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                letter = (letters := ALPHABETS[script(c)])[self.below(len(letters))]
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


def luhn(number: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(number)))
    return total % 10 == 0


def surrogate(kind: str, canonical: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical form of an entity's surrogate; never the entity's own, if its shape has others."""
    more = attempt // GROW
    for again in range(64):
        draw = Draw(key, kind, canonical, attempt + again * 1_000_003)
        if kind == "email":
            local, _, domain = canonical.partition("@")
            labels = domain.split(".")
            # One domain stays one domain; its last label stays what it is.
            of_domain = Draw(key, "domain", domain, 0)
            longer = "".join(ALPHABETS["LATIN"][draw.below(26)] for _ in range(more))
            new = f"{draw.like(local)}{longer}@{'.'.join([*map(of_domain.like, labels[:-1]), labels[-1]])}"
        elif kind == "ip":
            parts = canonical.split(".")
            kept = 1 if parts[0] == "10" else 2 if parts[:2] == ["192", "168"] else 0  # private networks stay private
            if kept == 2 and more:  # the other private blocks: 172.16 to 172.31, then 10
                parts, kept = (["172", str(16 + draw.below(16)), *parts[2:]], 2) if more < 3 else (["10", *parts[1:]], 1)
            new = ".".join(parts[:kept] + [str(1 + draw.below(254)) for _ in parts[kept:]])
        elif kind == "card":
            new = canonical[0] + draw.like(canonical[1:])  # the first digit names the network
            if luhn(canonical):
                new = next(n for d in "0123456789" if luhn(n := new[:-1] + d))
        elif kind == "key":
            new = canonical[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in canonical[4:])
        elif kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical):
            new = "".join("0123456789abcdef"[draw.below(16)] for _ in canonical)
            new = new.upper() if canonical.upper() == canonical else new
        elif kind.startswith("name-"):
            of_script, gender = kind.upper().split("-")[1], kind[-1]
            new = "".join(SYLLABLES[of_script][draw.below(len(SYLLABLES[of_script]))] for _ in range(2 + more + draw.below(2))) + ENDINGS[of_script, gender]
        else:
            new = draw.like(canonical)
        if new != canonical:
            return new
    return new


def numbered(kind: str, canonical: str, attempt: int, number: int, most: int, key: bytes = KEY) -> str:
    """A longer surrogate that no other number up to ``most`` gives in this attempt: the number stands at the same place in all of its kind."""
    draw = Draw(key, kind, canonical, attempt)
    # One more place with each attempt: at last longer than any entity of the corpus.
    if kind == "ip":  # IPv4 has no longer addresses: a unique local one of IPv6, or for a public one a documentation one
        private = ipaddress.ip_address(".".join(str(int(p)) for p in canonical.split("."))).is_private
        return str(ipaddress.IPv6Address(((0xFD << 120) if private else (0x20010DB8 << 96)) + ((attempt % (1 << 16)) << 64) + number))
    if kind.startswith("name-"):
        of_script, gender = kind.upper().split("-")[1], kind[-1]
        units = SYLLABLES[of_script]
    else:
        units = list(ALPHABETS["LATIN"] if kind == "email" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if kind == "key" else "0123456789")
    code, width = [], attempt - MAX_DRAWS
    while len(units) ** width <= most:
        width += 1
    for _ in range(width):
        number, unit = divmod(number, len(units))
        code.append(units[unit])
    code = "".join(code)
    if kind.startswith("name-"):
        return "".join(units[draw.below(len(units))] for _ in range(2)) + code + ENDINGS[of_script, gender]
    base = surrogate(kind, canonical, attempt, key)
    if kind == "email":
        local, _, domain = base.partition("@")
        return f"{local}{code}@{domain}"
    if kind == "card":  # the number before the check digit, and so for cards without one
        return next(n for d in "0123456789" if luhn(n := base + code + d)) if luhn(canonical) else base + code + str(draw.below(10))
    return base + code


def render(mention: str, kind: str, canonical: str, new: str) -> str:
    """A surrogate in the mention's format: separators, country code and case."""
    if kind in ("phone", "card", "ssn"):
        found = digits(mention)
        filled = iter(found[:len(found) - len(canonical)] + new)
        return "".join([*(next(filled) if c.isdigit() else c for c in mention), *filled])
    if kind.startswith("name-"):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize()
    if kind == "email" and len(new) == len(mention):
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new, strict=True))
    return new


def replace_all(text: str, table: dict[tuple[str, str], str]) -> tuple[str, int]:
    """The text with its entities replaced, and their number."""
    out, at, n = [], 0, 0
    for begin, end, kind, canonical in entities(text):
        out += [text[at:begin], render(text[begin:end], kind, canonical, table[kind, canonical])]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def surrogate_table(mentions: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(kind, canonical, surrogate)`` of the distinct entities, one surrogate for one entity.

    Of entities that draw the same surrogate the first in order keeps it, and one that is itself an entity of the corpus is
    kept by none; the others draw again until no collision is left. Spaces grow with the draws where the kind allows it. After
    ``MAX_DRAWS`` draws the rest is numbered: numbers meet no other of these, and get longer while one meets a real entity.
    """
    def drawn(batches):
        for batch in batches:
            new = [surrogate(*row, key) if most is None else numbered(*row, number, most, key) for *row, number, most in
                   zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt", "number", "most")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "canonical", "attempt")), pa.array(new, pa.string())],
                                             ["kind", "canonical", "attempt", "surrogate"])

    def draw(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(drawn, "kind string, canonical string, attempt int, surrogate string")

    none = F.lit(None).cast("bigint")
    space = F.regexp_replace("kind", "^(name-[a-z]+)-.$", "$1")  # one for the names of a script, whatever their gender
    known = materialize(mentions.select("kind", "canonical").distinct())
    table = materialize(draw(known.select("kind", "canonical", F.lit(0).alias("attempt"), none.alias("number"), none.alias("most"))))
    attempt = 0
    while True:
        taken = table.groupBy("kind", "surrogate").agg(F.min("canonical").alias("keeps"), F.count("*").alias("n"))
        taken = taken.filter("n > 1").select(F.col("kind").alias("k"), F.col("surrogate").alias("s"), "keeps")
        shared = (table.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")) & (F.col("canonical") != F.col("keeps")), "left_semi"))
        real = table.join(known.select(space.alias("k"), F.col("canonical").alias("c")),
                          (space == F.col("k")) & (F.col("surrogate") == F.col("c")), "left_semi")
        losers = materialize(shared.unionByName(real).select("kind", "canonical", "attempt").distinct())
        if losers.isEmpty():
            return table.select("kind", "canonical", "surrogate")
        stay = table.join(losers, ["kind", "canonical"], "left_anti")
        attempt += 1
        again = losers.withColumn("attempt", F.lit(attempt))
        if attempt < MAX_DRAWS:
            again = again.withColumn("number", none).withColumn("most", none)
        else:
            # Keyed, the same in each run, and bounded: a rank within a hash range and the range.
            keyed = F.sha2(F.concat_ws("\0", F.lit(key.hex()), "kind", "canonical").cast("binary"), 256)
            again = again.withColumn("range", F.pmod(F.xxhash64(keyed), F.lit(RANGES)))
            rank = F.row_number().over(Window.partitionBy("range").orderBy(keyed, "kind", "canonical"))
            again = materialize(again.withColumn("number", (rank.cast("bigint") - 1) * RANGES + F.col("range")).drop("range"))
            again = again.withColumn("most", F.lit(again.agg(F.max("number")).first()[0]))
        table = materialize(stay.unionByName(draw(again)))


def replace_entities(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates for the entities in ``text``, and ``n_entities``; other columns stay.

    Kinds are e-mail and IP addresses, phone, card and social security numbers, access keys, secrets after names like
    ``password =``, and names that the text has after a title at least once. Texts without entities (null and empty ones too) stay as they are with 0.
    Repeated rows and texts get equal results. No rows in, no rows out. A column of ``docs`` named n_entities is replaced.

    Only texts that may have entities move. Each is joined with the surrogates of its own entities by its digest, so one entity that
    a third of the texts have is a join that adaptive execution splits, and the table of entities is never broadcast or collected.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*(F.col(f"`{c}`") for c in columns))
    may = may_have(F.col(f"`{text}`"))
    plain = rows.filter(~may).withColumn("n_entities", F.lit(0).cast("bigint"))
    digest = F.sha2(F.col(f"`{text}`").cast("binary"), 256)

    def found(batches):
        for batch in blocks(batches, "text", BLOCK_BYTES):
            of: dict[str, list] = {"digest": [], "kind": [], "canonical": []}
            for name, value in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for kind, canonical in {(k, c) for _, _, k, c in entities(value)}:
                    for column, x in zip(of.values(), (name, kind, canonical), strict=True):
                        column.append(x)
            if of["kind"]:
                yield pa.RecordBatch.from_pydict(of)

    mentions = materialize(rows.filter(may).select(digest.alias("digest"), F.col(f"`{text}`").alias("text"))
                           .mapInArrow(found, "digest string, kind string, canonical string").distinct())
    table = surrogate_table(mentions, key)
    own = (mentions.join(table, ["kind", "canonical"]).groupBy("digest")
           .agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("own")))  # of one text: bounded by its length
    # The other columns go through the workers as one value.
    others = [c for c in columns if c != text]
    rest = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    joined = (rows.filter(may).select(rest.alias("row"), F.col(f"`{text}`").alias("text"), digest.alias("digest"))
              .join(own, "digest", "left").select("row", "text", "own"))

    def replaced(batches):
        for batch in blocks(batches, "text", BLOCK_BYTES):
            new = [replace_all(value, {(e["kind"], e["canonical"]): e["surrogate"] for e in own or ()})
                   for value, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t for t, _ in new], pa.string()),
                                              pa.array([n for _, n in new], pa.int64())], ["row", "text", "n_entities"])

    done = joined.mapInArrow(replaced, T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType())]))
    names = {c: f"c{i}" for i, c in enumerate(others)}
    kept = [F.col("text").alias(c) if c == text else F.col("row").getField(names[c]).alias(c) for c in columns]
    return plain.unionByName(done.select(*kept, "n_entities"))
