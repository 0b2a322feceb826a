"""Personal data: detection and keyed surrogates.

Each entity's surrogate is drawn from a keyed hash of its type, its value and an attempt
number, so that equal entities get equal surrogates in every document and task without a
lookup. A check over the table of all distinct entities raises the attempt of an entity whose
surrogate is another entity's surrogate or is itself an entity of the data; it is repeated
until there is none left. Only these raised attempts travel back to the documents.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.common import free_name, written

#: Raised attempts that may be sent to every worker; beyond that they are joined.
SENT_ROWS = 200_000
#: Rounds of the collision check before a format counts as exhausted.
ROUNDS = 64

# Titles before names, and the gender they tell (m, f, or n for neither).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f",
    "Señorita": "f", "Sra": "f", "г-н": "m", "г-жа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Letters of surrogate names by script, as consonants, vowels, and the endings
# of male, female and neutral given names.
SOUNDS = {
    "latin": ("b d f g k l m n p r s t v z", "a e i o u", "on ar ek", "a ia ina", "e i ey"),
    "cyrillic": ("б в г д к л м н п р с т", "а е и о у", "ин ан ор", "а ия ина", "е и о"),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο", "ος ης ας", "α η ια", "ι ω ε"),
}
# First and last letter of other scripts, from which letters are drawn.
BLOCKS = [
    (0x05D0, 0x05EA), (0x0627, 0x064A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NUMBERS = re.compile(
    r"(?P<secret>\bAKIA[0-9A-Z]{16}\b"
    r"|(?<![A-Za-z0-9])(?:ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"
    r"|\b(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?"
    r"(?P<value>(?=[^\s\"']*[0-9])[^\s\"']{6,}))"
    r"|(?P<email>(?<![\w.+%-])[\w+%-][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    rf"|(?P<ip>(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9])(?:[3-6][0-9]{3}|2[2-7][0-9]{2})(?:[ -]?[0-9]{3,6}){2,4}(?![0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
)
_NAMES = re.compile(
    rf"(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?"
    # Looked at without being consumed: the next title may stand among these words.
    r"(?=(?P<name>(?: [^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+){1,3}))"
)
_MARKS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits) and (digits[0] != "2" or "2221" <= digits[:4] <= "2720")


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(word: str) -> str:
    first = ord(word[0])
    if 0x400 <= first < 0x530:
        return "cyrillic"
    if 0x370 <= first < 0x400:
        return "greek"
    for low, high in BLOCKS:
        if low <= first <= high:
            return f"u{low:x}"
    return "latin"


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of each entity, in order and without overlaps."""
    if not text:
        return []
    found = []
    if _MARKS.search(text):
        at = 0
        while m := _NUMBERS.search(text, at):
            kind, (start, end) = m.lastgroup, m.span()
            at = end
            if m["value"]:
                start, end = m.span("value")
            value = text[start:end]
            digits = re.sub(r"[^0-9]", "", value)
            if kind == "email":
                value = value.lower()
            elif kind == "iban":
                # A neighbour may have been taken along: cut it off group by group.
                while value and _mod97(value.replace(" ", "")) != 1:
                    value = value.rpartition(" ")[0]
                if len(value.replace(" ", "")) < 12:
                    at = start + 1
                    continue
                at = end = start + len(value)
                value = value.replace(" ", "")
            elif kind == "card":
                # Digits of a neighbour may have been taken along: cut them off group by group.
                while digits and not _is_card(digits):
                    value = re.sub(r"(^|[ -])[0-9]+$", "", value)
                    digits = re.sub(r"[^0-9]", "", value)
                if not digits:
                    # The card may begin behind a neighbour's digits.
                    at = start + 1
                    continue
                at = end = start + len(value)
                value = digits
            elif kind in ("phone", "ssn"):
                if kind == "phone" and not 7 <= len(digits) <= 15:
                    continue
                value = ("+" if value[0] == "+" else "") + digits
            found.append((start, end, kind, value))
    if any(t in text for t in TITLES):
        taken = [(a, b) for a, b, *_ in found]
        for m in _NAMES.finditer(text):
            words = [w for w in re.finditer(r"[^ ]+", m["name"])]
            # Scripts with case start names with a capital; what follows is no name.
            cut = next((i for i, w in enumerate(words) if w[0][0].islower()), len(words))
            for i, w in enumerate(words[:cut]):
                a, b = m.start("name") + w.start(), m.start("name") + w.end()
                if any(a < y and x < b for x, y in taken):
                    continue
                script = script_of(w[0])
                role = "family" if i + 1 == cut else f"given:{TITLES[m['title']]}"
                found.append((a, b, f"{role}:{script}", w[0].lower()))
    return sorted(found)


class _Draw:
    """Keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.bits = int.from_bytes(hashlib.shake_256(seed).digest(256), "big")

    def below(self, n: int) -> int:
        self.bits, choice = divmod(self.bits, n)
        return choice

    def of(self, choices):
        return choices[self.below(len(choices))]

    def like(self, value: str) -> str:
        """A digit for each digit, a letter of the same case for each ASCII letter."""
        hexadecimal = len(value) >= 8 and re.fullmatch(r"[0-9]*[a-f][0-9a-f]*", value)
        out = []
        for c in value:
            if hexadecimal:
                out.append(self.of("0123456789abcdef"))
            elif c in "0123456789":
                out.append(self.of("0123456789"))
            elif "a" <= c <= "z":
                out.append(self.of("abcdefghijklmnopqrstuvwxyz"))
            elif "A" <= c <= "Z":
                out.append(self.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement of an entity's value: same type, script, gender and length where the
    format asks for it, with valid check digits."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "email":
        local, domain = value.split("@", 1)
        host = draw.like(re.sub(r"[^a-z0-9]", "", domain.split(".")[0]) or "m")
        return f"{draw.like(re.sub(r'[^ -~]', 'x', local))}{'x' * (attempt // 16)}@{host}.example.com"
    if kind == "ip":
        return ".".join(str(n) for n in (1 + draw.below(223), *(draw.below(256) for _ in range(3))))
    if kind == "card":
        # Only some numbers with a first digit 2 are cards.
        head = str(2221 + draw.below(500)) if value[0] == "2" else value[0]
        body = head + "".join(draw.of("0123456789") for _ in value[len(head) + 1 :])
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = draw.like(value[4:])
        check = 98 - _mod97(value[:2] + "00" + body)
        return f"{value[:2]}{check:02d}{body}"
    if kind == "phone":
        # The country code and the fictional exchange stay.
        head = re.match(r"\+(?:1|7|[2-9][0-9])|", value)[0]
        rest = value[len(head) :]
        new = draw.of("23456789") + "".join(draw.of("0123456789") for _ in rest[1:])
        if len(rest) == 10 and rest[3:6] == "555":
            new = new[:3] + "555" + new[6:]
        return head + new
    if kind == "ssn":
        return f"9{draw.below(100):02d}{draw.below(100):02d}{draw.below(10000):04d}"
    if kind == "secret":
        # A prefix that tells the kind of secret stays.
        head = re.match(r"AKIA|ghp_|sk-|", value)[0]
        return head + draw.like(value[len(head) :]) + draw.like("a" * (attempt // 16))
    role, script = kind.rsplit(":", 1)
    if script not in SOUNDS:
        low = int(script[1:], 16)
        high = dict(BLOCKS)[low]
        return "".join(chr(low + draw.below(high - low + 1)) for _ in value + "x" * (attempt // 16))
    consonants, vowels, male, female, neither = (s.split(" ") for s in SOUNDS[script])
    syllables = max(2, min(4, len(value) // 2)) + attempt // 16
    stem = "".join(draw.of(consonants) + draw.of(vowels) for _ in range(syllables - 1))
    endings = {"given:m": male, "given:f": female, "given:n": neither}.get(role)
    return stem + draw.of(consonants) + (draw.of(endings) if endings else draw.of(vowels) + draw.of(consonants))


def rendered(original: str, kind: str, new: str) -> str:
    """The surrogate in the original's way of writing: separators, capitals."""
    if kind in ("card", "phone", "ssn", "iban"):
        # Each character but separators takes the next of the surrogate.
        fresh = iter(new.replace("+", ""))
        return "".join(next(fresh) if c.isalnum() else c for c in original)
    if kind in ("email", "secret", "ip"):
        return new.upper() if kind == "email" and original.isupper() else new
    if original.isupper() and len(original) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if original[:1].isupper() else new


def _entity_rows(df: DataFrame, text: str) -> DataFrame:
    """Distinct (kind, value) of all texts; each task first drops its own repeats."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = {e[2:] for t in batch.column(0).to_pylist() for e in entities(t)}
            if pairs:
                kinds, values = zip(*sorted(pairs))
                yield pa.RecordBatch.from_pydict({"kind": kinds, "value": values})

    found = df.select(F.col(text).cast("string")).mapInArrow(find, "kind string, value string")
    return found.distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, value, attempt) with their surrogate."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, attempts = (c.to_pylist() for c in batch.columns)
            new = [surrogate(key, *row) for row in zip(kinds, values, attempts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(new, pa.string())], ["kind", "value", "attempt", "new"]
            )

    return rows.select("kind", "value", "attempt").mapInArrow(
        draw, "kind string, value string, attempt int, new string"
    )


def surrogate_table(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, new) for distinct (kind, value): surrogates of one kind differ
    from each other and from every value of that kind."""
    found = written(found)
    table = written(_drawn(found.withColumn("attempt", F.lit(0)), key))
    for _ in range(ROUNDS):
        # The first by attempt and value keeps a surrogate, the others draw again.
        keeper = table.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"))
        real = found.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        judged = (
            table.join(keeper, ["kind", "new"])
            .join(real, ["kind", "new"], "left")
            .withColumn("again", F.coalesce("real", F.lit(False)) | (F.col("first.value") != F.col("value")))
        )
        judged = written(judged.select("kind", "value", "attempt", "new", "again"))
        if not judged.where("again").limit(1).count():
            return judged.drop("again")
        fresh = _drawn(judged.where("again").withColumn("attempt", F.col("attempt") + 1), key)
        table = written(judged.where("not again").drop("again").unionByName(fresh))
    raise ValueError("a format has too few values for distinct surrogates")


def replace_entities(
    df: DataFrame,
    key: bytes,
    text: str = "text",
    counts: bool = False,
    sent_rows: int = SENT_ROWS,
) -> DataFrame:
    """``df`` with every entity in ``text`` replaced by its surrogate.

    With ``counts``, ``n_entities`` and ``kinds`` (sorted) follow; columns so named are
    replaced. Null stays null, an empty or clean text stays as it is, and repeated rows get
    equal results. Other columns are handed on, whatever their names.
    """
    if counts:
        df = df.drop(*[c for c in df.columns if c.lower() in ("n_entities", "kinds")])
    raised = surrogate_table(_entity_rows(df, text), key).where("attempt > 0")
    raised = raised.select("kind", "value", "attempt")
    names = df.columns
    own = free_name(df, "_raised")
    if raised.limit(sent_rows + 1).count() <= sent_rows:
        table = {(r["kind"], r["value"]): r["attempt"] for r in raised.collect()}
        sent = df.sparkSession.sparkContext.broadcast(table)
        with_raised = df.withColumn(own, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        sent = df.sparkSession.sparkContext.broadcast({})
        with_raised = _join_raised(df, raised, text, own)
    at = names.index(text)
    kept_schema = df.withColumn(text, F.col(text).cast("string")).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema)
    schema = fields + (", n_entities long, kinds array<string>" if counts else "")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, kinds = [], [], []
            raised_rows = batch.column(len(names)).to_pylist()
            for old, more in zip(batch.column(at).to_pylist(), raised_rows):
                attempts = {(r["kind"], r["value"]): r["attempt"] for r in more} if more else sent.value
                spans = entities(old)
                parts, end = [], 0
                for a, b, kind, value in spans:
                    new = surrogate(key, kind, value, attempts.get((kind, value), 0))
                    parts += [old[end:a], rendered(old[a:b], kind, new)]
                    end = b
                texts.append("".join([*parts, old[end:]]) if spans else old)
                totals.append(len(spans))
                kinds.append(sorted({s[2] for s in spans}))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if counts:
                columns += [pa.array(totals, pa.int64()), pa.array(kinds, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names + ["n_entities", "kinds"] * counts)

    texts_as_strings = with_raised.withColumn(text, F.col(text).cast("string"))
    return texts_as_strings.mapInArrow(replace, schema)


def _join_raised(df: DataFrame, raised: DataFrame, text: str, into: str) -> DataFrame:
    """Each text with the raised attempts of its own entities; equal texts share a row."""
    digest = free_name(df, "_digest")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {
                (name, e[2], e[3])
                for name, t in zip(*(c.to_pylist() for c in batch.columns))
                for e in entities(t)
            }
            if rows:
                yield pa.RecordBatch.from_pydict(
                    dict(zip((digest, "kind", "value"), map(list, zip(*sorted(rows)))))
                )

    named = df.withColumn(digest, F.sha2(F.col(text).cast("string"), 256))
    uses = named.select(digest, F.col(text).cast("string")).mapInArrow(
        find, f"{digest} string, kind string, value string"
    )
    # A text holds a bounded number of entities, so its list is bounded by the text.
    lists = (
        uses.distinct()
        .join(raised, ["kind", "value"])
        .groupBy(digest)
        .agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(into))
    )
    return named.join(lists, digest, "left").drop(digest).select(*[f"`{c}`" for c in df.columns], into)
