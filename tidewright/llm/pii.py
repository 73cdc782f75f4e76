"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Kinds in the order in which spans are listed; the first four are the fixed base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")
IBAN_HEAD = re.compile(r"\b[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Characters of an IBAN by country (fixed by its registry).
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in countries.split()
}
IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}\b") for n in set(IBAN_LENGTH.values())}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b[A-Za-z0-9_]{3,40}\x20?[=:]\x20?[\"'][A-Za-z0-9+/_=-]{16,200}[\"']")
NOT_DIGIT = re.compile(r"[^0-9]")

#: Words near a span that raise or lower its score.
CONTEXT = {
    "email": (("email", "e-mail", "mail", "contact", "write"), ("example", "test", "sample")),
    "ip": (("ip", "address", "host", "server", "login"), ("version", "release", "section", "chapter")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "payment"), ("isbn", "tracking", "serial", "order", "invoice")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "contact"), ("version", "serial", "part", "model")),
    "iban": (("iban", "account", "bank", "konto", "compte", "cuenta"), ("serial", "part", "model")),
    "ssn": (("ssn", "social", "security"), ("part", "order", "invoice", "model")),
    "secret": (("token", "key", "secret", "password", "api", "credential", "akia"), ("checksum", "sha256", "md5", "commit")),
}
#: The score a proposal starts from, once its checksum (where it has one) holds.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}


@dataclass(frozen=True)
class PiiRules:
    """``window``: code points before and after a span searched for context words."""

    window: int = 40
    raise_by: float = 0.3
    lower_by: float = 0.3
    threshold: float = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_spans(text: str) -> Iterator[tuple[int, int]]:
    """Proposals cut at their country's length, so that what follows is no part of them; codes the
    registry lacks take the whole run. A failed proposal takes no text from the next one."""
    done = 0
    for head in IBAN_HEAD.finditer(text):
        if head.start() < done:
            continue
        n = IBAN_LENGTH.get(head[0][:2])
        m = IBAN_REST[n].match(text, head.end()) if n else IBAN.match(text, head.start())
        if m and mod97(text[head.start() : m.end()].replace(" ", "")):
            done = m.end()
            yield head.start(), done


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The contract's four kinds; each search is linear in the text.

    An address is looked for from its ``@``: the local part is the whole run before it that no
    earlier address took, which is what a leftmost search finds without trying every start.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        run = at
        while run > done and (text[run - 1].isascii() and (text[run - 1].isalnum() or text[run - 1] in "._%+-")):
            run -= 1
        m = DOMAIN.match(text, at) if run < at else None
        if m:
            yield "email", run, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


def context_score(text: str, kind: str, start: int, end: int, rules: PiiRules) -> float:
    """What a proposal of ``kind`` starts from, moved by the words around it, from 0 to 1."""
    low, high = max(0, start - rules.window), end + rules.window
    near = text[low:high].lower()
    up, down = CONTEXT[kind]
    score = START[kind] + rules.raise_by * any(w in near for w in up)
    # lowering words are whole words: "department" is no "part"; the text around tells if the window cuts one
    around = text[max(0, low - 1) : high + 1].lower()
    score -= rules.lower_by * any(w in near and re.search(rf"(?<![^\W_]){w}(?![^\W_])", around) for w in down)
    return round(min(1.0, max(0.0, score)), 4)


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Kinds beyond the base, proposed and confirmed by their checksum where they have one."""
    for start, end in iban_spans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        yield "ssn", *m.span()
    if "=" in text or ":" in text or "AKIA" in text:
        for m in SECRET.finditer(text):
            yield "secret", *m.span()


def find_spans(text: str | None, rules: PiiRules = PiiRules()) -> list[tuple[str, int, int, float]]:
    """All spans by kind as listed in KINDS, then by start. Null is an empty text.

    Every span has a context score. Base kinds stay whatever it is, as the contract has it; the
    others need ``rules.threshold``.
    """
    text = text or ""
    found = [(k, s, e, context_score(text, k, s, e, rules)) for k, s, e in base_spans(text)]
    found += [x for k, s, e in more_spans(text) if (x := (k, s, e, context_score(text, k, s, e, rules)))[3] >= rules.threshold]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def detect(docs: DataFrame, rules: PiiRules = PiiRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and ``spans`` (kind, start, end, score), code points, end exclusive.

    Narrow: no shuffle. Null text: no spans; repeated rows each get their own result; columns
    other than the two named are not read.
    """
    kind = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t, rules)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, schema)], names=["id", "spans"])

    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, spans {kind}")
    return out.withColumnRenamed("id", id_column)


def redact(docs: DataFrame, rules: PiiRules = PiiRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with every span replaced by ``<KIND>``; of spans that overlap, the one that starts
    first (the longest of those that start together) leaves its mark.

    Narrow: no shuffle. Null texts stay null, empty ones empty; repeated rows change alike; all
    columns are kept whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_column):
            texts = []
            for t in b.column(text_column).to_pylist():
                if t is not None:
                    out, at = [], 0
                    for k, s, e, _ in sorted(find_spans(t, rules), key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            out += [t[at:s], f"<{k.upper()}>"]
                        at = max(at, e)
                    t = "".join([*out, t[at:]])
                texts.append(t)
            i = b.schema.get_field_index(text_column)
            yield b.set_column(i, text_column, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``detect`` over all documents."""
    from pyspark.sql import functions as F

    found = detect(table(spark, sf_dir, "documents"))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    low = F.round(F.array_min(F.transform("spans", lambda s: s["score"])), 4).alias("least_score")
    more = [count(k) for k in KINDS if k not in BASE]
    n = F.size("spans").cast("long")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *more, n.alias("n_spans"), (n > 0).alias("has_pii"), low)


def digest(text: str | None) -> str:
    """The base digest of one text, as the query gives it."""
    base = [f"{k}:{s}:{e}" for k, s, e, _ in find_spans(text) if k in BASE]
    return hashlib.sha256(",".join(base).encode()).hexdigest()
