"""Personal data: detection, and keyed surrogates that keep type, script, gender and format."""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, arrow_batches, cut, portions, text_key

# Titles by gender, and given names by gender and script that surrogates draw from.
_TITLES = {"f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Госпожа", "m": "Mr Herr Señor Sr Monsieur M Господин", "x": "Dr Prof Professor"}
_GIVEN = {
    ("f", "latin"): "Anna Clara Diana Elena Emma Eva Gloria Hanna Ida Irene Julia Laura Lea Lena Lucia Maria Marta Nina Nora Olivia Paula Rosa Sara Sofia Teresa Vera",
    ("m", "latin"): "Adrian Albert Anton Bruno Carlos Daniel David Emil Felix Hugo Ivan Jan Jonas Karl Leon Lucas Marco Martin Oscar Pablo Paul Peter Simon Thomas Victor",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга",
    ("m", "cyrillic"): "Антон Борис Виктор Иван Михаил Олег Павел Сергей",
    ("f", "greek"): "Άννα Ελένη Ειρήνη Μαρία Σοφία",
    ("m", "greek"): "Γιώργος Νίκος Παύλος Πέτρος Στέφανος",
}
# Syllables of surrogate family names.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa we za".split(),
    "cyrillic": "ба бе бо ва ве го да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γο δα δε κα κο λα λε μα με να νο πα πε ρα ρο σα σε τα το".split(),
}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][\w'’-]*[^\W\d_]"
_TITLE = "|".join(sorted((t for g in _TITLES.values() for t in g.split()), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LOCAL = r"[A-Za-z0-9_](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?"
_PATTERNS = {
    "email": _LOCAL + r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])",
    "assigned": r"(?i:(?:token|secret|passw(?:or)?d|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer)[\"']?\s*[:=]+\s*[\"']?)(?P<assigned_value>[A-Za-z0-9+/_.~-]{8,}=*)",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Za-z:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "person": rf"(?<!\w)(?P<title>{_TITLE})(?P<gap>\.? )(?P<names>{_NAME}(?: {_NAME}){{0,2}})",
}
_COMPILED = {kind: re.compile(pattern) for kind, pattern in _PATTERNS.items()}
#: What of a text up to an @ can be an address's local part, of 64 characters at most.
_BEFORE_AT = re.compile(_LOCAL + r"\Z")
#: Where numbers can stand; the patterns of numbers look there only.
_NUMBERS = re.compile(r"[0-9+(][0-9()+ .-]{6,}")
_OF_NUMBERS = ("ip", "ssn", "phone", "card")
#: Texts without any of these have no entity; a regular automaton checks it fast. Each branch of each pattern implies one of them,
#: but for a run of 32 letters a-f without any digit: alone in a text it isn't taken for a secret.
HINT = rf"@|[0-9]{{2}}|[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]|(?i:token|secret|passw|pwd|key|auth|bearer)|AKIA|gh[pousr]_|sk[-_]|xox|eyJ|[0-9][0-9a-f]{{16}}|[0-9a-f]{{16}}[0-9]|[0-9][0-9A-F]{{16}}|[0-9A-F]{{16}}[0-9]|[A-Z]{{2}}\p{{Nd}}{{2}}|(?:{_TITLE})\.? "

#: Three, three and four digits with spaces are a phone only after a word that says so; other digits are no card without a valid check digit.
_BARE_PHONE = re.compile(r"\d{3} \d{3} \d{4}")
_CUE = re.compile(r"(?i)(?:phone|tel|mobile|cell|call|fax|dial|handy|móvil|тел)[^\n\d]{0,16}\Z")

Entity = tuple[int, int, str, str]  # start, end, type, value


def find(text: str) -> list[Entity]:
    """Entities in order, without overlaps. Type ``given.<gender>`` or ``family`` stands for one name of a
    person; the family name of somebody introduced with a title is found again in the rest of the text, unless the text
    also has it in lower case, as a common word."""
    spans: list[tuple[int, int, int, str, re.Match]] = []  # start, order of the kinds, end, kind, match

    def look(kind: str, start: int = 0, end: int | None = None) -> None:
        for m in _COMPILED[kind].finditer(text, start, len(text) if end is None else end):
            if kind == "card" and not _luhn(re.sub(r"\D", "", m[0])):
                continue
            if kind == "phone" and _BARE_PHONE.fullmatch(m[0]) and not _CUE.search(text, max(0, m.start() - 32), m.start()):
                continue
            spans.append((m.start(), list(_PATTERNS).index(kind), m.end(), kind, m))

    at, reached = text.find("@"), 0
    while at >= 0:
        # Each @ by itself: only the start is bounded, the domain runs on in the whole text.
        local = _BEFORE_AT.search(text, max(reached, at - 64), at)
        m = local and _COMPILED["email"].match(text, local.start())
        if m:
            spans.append((m.start(), list(_PATTERNS).index("email"), m.end(), "email", m))
            reached = m.end()
        at = text.find("@", at + 1)
    for m in _NUMBERS.finditer(text):
        for kind in _OF_NUMBERS:
            look(kind, m.start(), m.end())
    for kind in ("secret", "assigned", "hex", "iban", "person"):
        look(kind)
    if text.count(":") > 2:
        look("ipv6")
    out: list[Entity] = []
    families: set[str] = set()
    last = 0
    for start, _, end, kind, m in sorted(spans, key=lambda s: s[:3]):
        if start < last:
            continue
        last = end
        if kind == "assigned":
            out.append((m.start("assigned_value"), m.end("assigned_value"), "secret", m["assigned_value"]))
        elif kind == "person":
            gender = next(g for g, t in _TITLES.items() if m["title"] in t.split())
            names = list(re.finditer(r"\S+", m["names"]))
            for k, name in enumerate(names):
                own = k == len(names) - 1
                out.append((m.start("names") + name.start(), m.start("names") + name.end(), "family" if own else f"given.{gender}", name[0]))
                if own:
                    families.add(name[0])
        else:
            out.append((start, end, "secret" if kind == "hex" else kind, m[0]))
    families = {f for f in families if f.lower() == f or not re.search(rf"(?<!\w){re.escape(f.lower())}(?!\w)", text)}
    if families:
        taken = [(a, b) for a, b, _, _ in out]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(families, key=len, reverse=True)))})(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), m.end(), "family", m[0]))
        out.sort()
    return out


def _permute(key: bytes, tweak: bytes, digits: list[int], radix: int) -> list[int]:
    """A keyed permutation of all strings of so many digits: a balanced Feistel network."""
    n = len(digits)
    if n < 2:
        turn = hmac.digest(key, tweak + b"/%d" % radix, "sha256")[0]
        return [(d + 1 + turn % (radix - 1)) % radix for d in digits]
    half = n // 2
    sizes = (radix**half, radix ** (n - half))
    a, b = (sum(d * radix**i for i, d in enumerate(part)) for part in (digits[:half], digits[half:]))
    for turn in range(10):
        other, size = (b, sizes[0]) if turn % 2 == 0 else (a, sizes[1])
        width = (size.bit_length() + 7) // 8 + 8
        mixed = int.from_bytes(hashlib.shake_256(key + b"/%b/%d/%d/%d/" % (tweak, radix, n, turn) + other.to_bytes((other.bit_length() + 7) // 8 or 1, "big")).digest(width), "big")
        if turn % 2 == 0:
            a = (a + mixed) % size
        else:
            b = (b + mixed) % size
    out = []
    for value, count in ((a, half), (b, n - half)):
        for _ in range(count):
            value, d = divmod(value, radix)
            out.append(d)
    return out


_ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def _reshape(key: bytes, tweak: bytes, text: str, alphabets: tuple[str, ...] = _ALPHABETS) -> str:
    """The text with the characters of each alphabet permuted as one string; others stay."""
    out = list(text)
    for alphabet in alphabets:
        at = [i for i, c in enumerate(text) if c in alphabet]
        if at:
            for i, d in zip(at, _permute(key, tweak + alphabet[:1].encode(), [alphabet.index(text[i]) for i in at], len(alphabet))):
                out[i] = alphabet[d]
    return "".join(out)


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _script(name: str) -> str:
    c = next((c for c in name if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _case(like: str, name: str) -> str:
    return name.upper() if len(like) > 1 and like.isupper() else name.capitalize()


@functools.lru_cache(100_000)
def surrogate(kind: str, value: str, key: bytes, nonce: int = 0) -> str:
    """Another value of the same type and format; the same for equal ``value`` and ``key``. ``nonce`` gives further ones."""
    for step in range(64):
        out = _surrogate(kind, value, key, b"%b/%d/%d" % (kind.encode(), nonce, step))
        if out != value:
            return out
    return out


def _surrogate(kind: str, value: str, key: bytes, tweak: bytes) -> str:
    if kind == "email":
        local, _, domain = value.partition("@")
        head, dot, tld = domain.rpartition(".")
        # The domain by itself, so that equal domains stay equal; the whole address shapes the local part.
        return _reshape(key, tweak + b"l" + hmac.digest(key, domain.lower().encode(), "sha256")[:8], local) + "@" + _reshape(key, b"domain", head) + dot + tld
    if kind == "ip":
        parts = value.split(".")
        number = sum(int(p) << (24 - 8 * i) for i, p in enumerate(parts))
        while True:  # walks on in the cycle until the address is an ordinary one, so distinct addresses stay distinct
            bits = _permute(key, tweak, [number >> (31 - i) & 1 for i in range(32)], 2)
            number = sum(b << (31 - i) for i, b in enumerate(bits))
            if 1 <= number >> 24 <= 223 and number >> 24 != 127:
                return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if _luhn(digits):
            body = "".join(map(str, _permute(key, tweak + b"luhn", list(map(int, digits[:-1])), 10)))
            digits = next(body + c for c in string.digits if _luhn(body + c))
        else:
            while True:
                digits = "".join(map(str, _permute(key, tweak, list(map(int, digits)), 10)))
                if not _luhn(digits):
                    break
        new = iter(digits)
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=\D)", value)  # the country stays
        head = m[0] if m else ""
        return head + _reshape(key, tweak, value[len(head) :], (string.digits,))
    if kind == "iban":
        return value[:2] + _reshape(key, tweak, value[2:], (string.digits, string.ascii_uppercase))
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        upper = value.upper() == value
        return _reshape(key, tweak, value, ("0123456789ABCDEF" if upper else "0123456789abcdef",))
    if kind == "secret":
        head = re.match(r"AKIA|gh[pousr]_|sk[-_]|xox[abprs]-|eyJ|", value)[0]
        return head + _reshape(key, tweak, value[len(head) :])
    if kind == "ipv6":
        return _reshape(key, tweak, value.lower(), ("0123456789abcdef",))
    if kind.startswith("given") or kind == "family":
        script = _script(value)
        number = int.from_bytes(hmac.digest(key, tweak + b"/" + value.casefold().encode(), "sha256")[:16], "big")
        if kind == "family":
            number, n = divmod(number, 2)
            syllables = []
            for _ in range(4 + n):
                number, d = divmod(number, len(_SYLLABLES[script]))
                syllables.append(_SYLLABLES[script][d])
            return _case(value, "".join(syllables))
        gender = kind.partition(".")[2]
        names = " ".join(_GIVEN[g, script] for g in ("f", "m") if gender in (g, "x")).split()
        number, d = divmod(number, len(names))
        second = number % len(_SYLLABLES[script])
        # A bare name of so short a list would soon repeat: a middle syllable keeps people apart.
        return _case(value, names[d]) + "-" + _case("Aa", _SYLLABLES[script][second] + _SYLLABLES[script][number // 64 % len(_SYLLABLES[script])])
    return _reshape(key, tweak, value)


def canonical(kind: str, value: str) -> str:
    """What mentions of one entity have in common, whatever their case or separators."""
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=\D)", value)
        return (m[0] + " " if m else "") + re.sub(r"\D", "", value[m.end() if m else 0 :])
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    return value.replace(" ", "") if kind == "iban" else value.casefold() if kind in ("email", "ipv6") or kind.startswith("given") or kind == "family" else value


def _render(kind: str, value: str, key: bytes, nonces: dict[tuple[str, str], int]) -> str:
    """The surrogate of this mention: made from the canonical form, in the mention's own format."""
    base = canonical(kind, value)
    made = surrogate(kind, base, key, nonces.get((kind, base), 0))
    if kind in ("phone", "card", "ssn"):
        # The digits in the places of the mention's digits; a leading + stays where it is.
        new = iter(re.sub(r"\D", "", made))
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "iban":
        new = iter(made)
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "email" and value.upper() == value:
        return made.upper()
    return _case(value, made) if kind == "family" else made.upper() if kind.startswith("given") and len(value) > 1 and value.isupper() else made


def replace(text: str, key: bytes, nonces: dict[tuple[str, str], int] | None = None) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of entities by type."""
    parts, last, count = [], 0, {}
    for start, end, kind, value in find(text):
        parts += [text[last:start], _render(kind, value, key, nonces or {})]
        last = end
        count[kind.partition(".")[0]] = count.get(kind.partition(".")[0], 0) + 1
    return ("".join([*parts, text[last:]]) if parts else text), count


def _hinted(batch: pa.RecordBatch, column: int):
    return pc.match_substring_regex(batch.column(column), HINT).fill_null(False).to_pylist()


def entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Distinct ``kind, value, made`` of all texts: canonical values with their first surrogates."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            found = set()
            for text, hint in zip(batch.column(0), _hinted(batch, 0)):
                if hint:
                    found.update((kind, canonical(kind, value)) for _, _, kind, value in find(text.as_py()))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array([surrogate(k, v, key) for k, v in rows], pa.string())], ["kind", "value", "made"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "kind string, value string, made string").distinct()


def clashes(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, nonce`` of the entities whose surrogate is that of another entity, or a real value.

    Of those that share one, the smallest value keeps it. The others, and those that hit a real
    value, try the next nonce, until none clashes.
    """
    spark = found.sparkSession

    def again(part: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, values, nonces = (b.column(i).to_pylist() for i in range(3))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([surrogate(k, v, key, n) for k, v, n in zip(kinds, values, nonces)], pa.string())], ["kind", "value", "nonce", "made"])

        return part.mapInArrow(run, "kind string, value string, nonce int, made string")

    real = found.select(F.col("kind").alias("r_kind"), F.col("value").alias("r_value"))
    state = found.select("kind", "value", F.lit(0).alias("nonce"), "made")
    while True:
        first = state.groupBy("kind", F.lower("made").alias("low")).agg(F.min("value").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
        judged = state.withColumn("low", F.lower("made")).join(first, ["kind", "low"], "left").join(real, (F.col("kind") == F.col("r_kind")) & (F.col("made") == F.col("r_value")), "left")
        judged = judged.withColumn("bad", (F.col("keeper").isNotNull() & (F.col("keeper") != F.col("value"))) | F.col("r_value").isNotNull())
        judged = cut(judged.select("kind", "value", "nonce", "made", "bad"))
        bad = judged.filter("bad")
        if bad.isEmpty():
            return judged.filter("nonce > 0").select("kind", "value", "nonce")
        state = judged.filter("not bad").drop("bad").unionByName(again(bad.select("kind", "value", (F.col("nonce") + 1).alias("nonce"))))


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row with its text's personal data replaced by surrogates; adds ``n_entities`` and ``pii`` (number by type).

    Types: email, phone, card, iban, ssn, ip, ipv6, secret, and names after a title. Equal entities
    get equal surrogates in all documents (coreference), distinct ones distinct surrogates: keyed
    permutations of the values of one format, and a collision check over all distinct entities that
    moves clashing ones to another nonce. Phones keep their country, cards their checksum, emails their
    top-level domain, names their script, gender and case, and all keep separators and length classes.
    Null stays null; texts without entities stay as they are; repeated rows give equal rows; columns
    named like the added ones are replaced. ``key`` is the secret that surrogates follow from: who has it can link them.

    Exceptions from the collision check are broadcast up to ``broadcast_rows``; beyond, each document's
    own ones are joined to it.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    keep = [c for c in docs.columns if c not in ("n_entities", "pii")]
    found = cut(entities(docs, key, text_col))
    moved = clashes(found, key)
    rows = moved.limit(broadcast_rows + 1).collect()
    known = {(r.kind, r.value): r.nonce for r in rows} if len(rows) <= broadcast_rows else None
    shared = spark.sparkContext.broadcast(known or {})
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    if known is None:
        source = _with_exceptions(docs, moved, keep, id_col, text_col)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            column = batch.schema.get_field_index("_text")
            own = batch.column(batch.schema.get_field_index("_moved")).to_pylist() if known is None else None
            texts, counts = [], []
            for i, (text, hint) in enumerate(zip(batch.column(column), _hinted(batch, column))):
                nonces = {(x["kind"], x["value"]): x["nonce"] for x in own[i] or []} if own else shared.value
                text, count = replace(text.as_py(), key, nonces) if hint else (text, {})
                texts.append(text if isinstance(text, str) else text.as_py())
                counts.append(count)
            out = list(batch.columns[: len(keep)])
            out[at] = pa.array(texts, pa.string())
            out += [pa.array([sum(c.values()) for c in counts], pa.int64()), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_entities", "pii"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("pii", T.MapType(T.StringType(), T.LongType()))])
    return source.mapInArrow(run, schema)


def _with_exceptions(docs: DataFrame, moved: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """The rows with ``_moved``: the exceptions among each document's own entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            rows = []
            for i, (text, hint) in enumerate(zip(batch.column(2), _hinted(batch, 2))):
                if hint:
                    rows += [(i, k, v) for k, v in {(kind, canonical(kind, value)) for _, _, kind, value in find(text.as_py())}]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["_id", "_key", "kind", "value"])

    keyed = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    mentions = keyed.mapInArrow(run, T.StructType([*keyed.schema.fields[:2], T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])).distinct()
    own = mentions.join(moved, ["kind", "value"]).groupBy("_id", "_key").agg(F.collect_list(F.struct("kind", "value", "nonce")).alias("_moved"))
    own = own.withColumnRenamed("_id", "_id2").withColumnRenamed("_key", "_key2")
    rows = docs.select(*keep, F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    return rows.join(own, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left").select(*keep, "_text", "_moved")
