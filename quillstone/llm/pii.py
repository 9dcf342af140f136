"""Personal data by weak supervision.

Labelers of three sorts, regular expressions, gazetteers and context words, each vote a class or abstain on every
candidate span. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates each
labeler's reliability and the classes' shares; the posteriors then train a classifier on the spans' own features,
which decides every span, also where labelers abstain or disagree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quillstone.cluster import Scratch, cut, ship
from quillstone.llm.common import pieces

CLASSES = ("none", "email", "ip_address", "phone", "card_number", "national_id", "iban")
NONE, EMAIL, IP, PHONE, CARD, NATIONAL, IBAN = range(len(CLASSES))
PATTERNS = 50_000  # commonest patterns of features and votes that the classifier is fit on
THRESHOLD = 0.5
CONTEXT = 32

CANDIDATE = re.compile(r"(?<![^\s@<>()\[\]{}\"|,;:])[^\s@<>()\[\]{}\"|,;:]++@[^\s@<>()\[\]{}\"|,;:]++|\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b|(?<![\w.+])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)|(?<![\w.])[+(]{0,2}\d(?:[ ().\-/]{0,2}\d){6,}(?![\w])")
_EMAIL = re.compile(r"[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.UNICODE)
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}")
_NATIONAL = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_ENDED = tuple(re.compile(rf"(?:{p.pattern})(?= |\Z)") for p in (_PHONE, _CARD, _IP, _NATIONAL))
_IP_AFTER = re.compile(rf" (?={_IP.pattern}(?: |\Z))")
_VERSION = re.compile(r"(?:\b(?:v|ver|version|release|rev|revision|build|firmware|section|chapter|clause)|§)s?[.:=]? ?\Z", re.I)
_DATE = re.compile(r"(?:19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d{2}")
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co me eu de fr es it nl uk us ca au ch at be pl ru cn jp in br se no fi dk cz".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 351 352 353 354 358 359 370 371 372 380 420 421".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62")
IBAN_LANDS = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MT NL NO PL PT RO RS SA SE SI SK TR".split())
_SAID = {
    EMAIL: re.compile(r"e-?mail|contact|write to|reach|courriel|correo|mailto", re.I),
    PHONE: re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|dial|telefon|téléphone|teléfono|appel", re.I),
    IP: re.compile(r"\bip\b|address|host|server|login|from|client|adresse", re.I),
    CARD: re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|account|konto", re.I),
    NATIONAL: re.compile(r"ssn|social security|national id|tax id|insurance", re.I),
    IBAN: re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    NONE: re.compile(r"version|isbn|issn|order|invoice|figure|chapter|page|total|part no|serial|\bid\b|timestamp", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _parts(s: str) -> list[int]:
    """Where a run of digits and blanks is cut: before each blank that follows a whole phone, card or other number, and before an address that follows anything else."""
    cuts, at = [], 0
    while s.find(" ", at) >= 0:
        whole = [m.end() for p in _ENDED if (m := p.match(s, at))]
        if not whole and s[at] not in "+(" and (m := _IP_AFTER.search(s, at)):
            at = m.end()
            cuts.append(at)
            continue
        if not whole or max(whole) == len(s):
            break
        at = max(whole) + 1
        cuts.append(at)
    return cuts


def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Candidates: (start, end, text), without the punctuation that closes a sentence; numbers that only blanks part are candidates of their own."""
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".-_*%&#$!?'/( ")
        at = m.start()
        if s[:1] == "(" and ")" not in s:
            s, at = s[1:], at + 1
        cuts = _parts(s) if " " in s else []
        for a, b in zip([0, *cuts], [*(c - 1 for c in cuts), len(s)]):
            if a < b:
                yield at + a, at + b, s[a:b]


def _regex(s: str, digits: str, before: str) -> int | None:
    if "@" in s:
        return EMAIL if _EMAIL.fullmatch(s) else NONE
    for pattern, k in ((_IP, IP), (_NATIONAL, NATIONAL), (_DATE, NONE), (_PHONE, PHONE), (_CARD, CARD)):
        if pattern.fullmatch(s):
            return k
    return IBAN if _IBAN.fullmatch(s.replace(" ", "")) else NONE


def _checks(s: str, digits: str, before: str) -> int | None:
    """Check digits and ranges."""
    if "@" in s:
        return None
    if _IP.fullmatch(s):
        return IP if all(int(x) < 256 for x in s.split(".")) and not _VERSION.search(before) else NONE
    if s[:2].isalpha():
        return IBAN if iban_ok(s.replace(" ", "")) else NONE
    return (CARD if luhn(digits) else NONE) if 13 <= len(digits) <= 19 and s[0] != "+" else None


def _domains(s: str, digits: str, before: str) -> int | None:
    return (EMAIL if s.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else NONE) if "@" in s else None


def _dialling(s: str, digits: str, before: str) -> int | None:
    if s[0] != "+":
        return None
    return PHONE if any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) and 8 <= len(digits) <= 15 else NONE


def _issuer(s: str, digits: str, before: str) -> int | None:
    if "@" in s or "." in s or s[0] == "+" or len(digits) not in (14, 15, 16):
        return None
    return CARD if digits.startswith(ISSUERS) or 2221 <= int(digits[:4]) <= 2720 else NONE


def _land(s: str, digits: str, before: str) -> int | None:
    return (IBAN if s[:2] in IBAN_LANDS else NONE) if "@" not in s and s[:2].isalpha() else None


def _size(s: str, digits: str, before: str) -> int | None:
    """What a bare run of digits is by its length alone."""
    if not s.isdigit():
        return None
    return None if 13 <= len(s) <= 19 else PHONE if len(s) in (10, 11) else NONE


def _shape(s: str, digits: str, before: str) -> int | None:
    """A looser look than the expressions: separators and number of groups."""
    if "@" in s:
        return EMAIL if "." in s.rsplit("@", 1)[1] and not s.startswith("@") else NONE
    if s.count(".") == 3 and len(re.findall(r"\d+", s)) == 4:
        return None if _VERSION.search(before) else IP
    if s[0] == "+" or "(" in s:
        return PHONE
    return None


def _said(k: int):
    return lambda s, digits, before: k if _SAID[k].search(before) else None


#: Weights of labelers in the first guess, where not 1: whole shapes count for more, check digits for most.
START = {0: 1.5, 1: 3.0}
LABELERS = (_regex, _checks, _domains, _dialling, _issuer, _land, _size, _shape, *(_said(k) for k in _SAID))


def votes(s: str, before: str) -> int:
    """All votes of a span, packed four bits each; 15: abstains."""
    digits = re.sub(r"\D", "", s)
    packed = 0
    for k, label in enumerate(LABELERS):
        v = label(s, digits, before)
        packed |= (15 if v is None else v) << 4 * k
    return packed


def features(s: str, before: str) -> int:
    """The classifier's binary features, packed in one number."""
    digits = re.sub(r"\D", "", s)
    n, groups = len(digits), re.findall(r"\d+", s)
    at = "@" in s
    host = s.rsplit("@", 1)[-1] if at else ""
    bits = (
        at, at and "." in host, at and host.rsplit(".", 1)[-1].isalpha(), at and s[0].isalnum(), s[0] == "+", "(" in s, s.isdigit(), "." in s and not at, s.count(".") == 3 and not at,
        not at and len(groups) == 4, "-" in s, " " in s, s[:2].isalpha() and not at, n < 9, 9 <= n <= 11, 12 <= n <= 15, n == 16, n > 16,
        not at and len(groups) == 4 and max(map(len, groups)) <= 3 and all(int(g) < 256 for g in groups) and not _VERSION.search(before), [len(g) for g in groups] == [3, 2, 4], bool(_DATE.fullmatch(s)), not at and 13 <= n <= 19 and luhn(digits),
        *(bool(p.search(before)) for p in _SAID.values()),
    )
    return sum(1 << k for k, b in enumerate(bits) if b)


FEATURES = 29


def reliabilities(patterns: list[tuple[int, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over (votes, count): class shares, P(vote | class) of each labeler (classes, then abstention), and posteriors.

    Starts from the majority; a labeler's table starts with most weight on voting the true class or abstaining.
    """
    k, m = len(CLASSES), len(LABELERS)
    if not patterns:
        return np.full(k, 1 / k), np.zeros((m, k, k + 1)), np.zeros((0, k))
    cast = np.array([[p >> 4 * j & 15 for j in range(m)] for p, _ in patterns])
    cast[cast == 15] = k
    count = np.array([c for _, c in patterns], dtype=np.float64)
    post = np.full((len(patterns), k), 0.1)
    for j in range(m):
        has = cast[:, j] < k
        post[np.flatnonzero(has), cast[has, j]] += START.get(j, 1.0)
    post /= post.sum(axis=1, keepdims=True)
    share, table = np.full(k, 1 / k), np.zeros((m, k, k + 1))
    for _ in range(rounds):
        share = (post * count[:, None]).sum(axis=0) + 1
        share /= share.sum()
        for j in range(m):
            prior = np.full((k, k + 1), 0.05)
            prior[range(k), range(k)] = 1.0
            prior[:, k] = 1.0
            for v in range(k + 1):
                at = cast[:, j] == v
                prior[:, v] += (post[at] * count[at, None]).sum(axis=0)
            table[j] = prior / prior.sum(axis=1, keepdims=True)
        logp = np.log(share)[None, :] + sum(np.log(table[j][:, cast[:, j]]).T for j in range(m))
        post = np.exp(logp - logp.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
    return share, table, post


def unpack(packed: np.ndarray) -> np.ndarray:
    bits = (packed[:, None] >> np.arange(FEATURES)[None, :] & 1).astype(np.float64)
    return np.hstack([bits, np.ones((len(packed), 1))])


def fit(packed: np.ndarray, posterior: np.ndarray, count: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Weights of the softmax classifier that best predicts the posteriors, each pattern weighted by the root of its count."""
    x, w = unpack(packed), np.sqrt(count) / np.sqrt(count).sum()
    weights, u, v = (np.zeros((x.shape[1], len(CLASSES))) for _ in range(3))
    for r in range(1, rounds + 1):
        p = np.exp(x @ weights - (x @ weights).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (w[:, None] * (posterior - p)) - penalty * weights
        u += 0.1 * (g - u)
        v += 0.01 * (g * g - v)
        weights += 0.2 * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return weights


def predict(weights: np.ndarray, packed: np.ndarray) -> np.ndarray:
    s = unpack(packed) @ weights
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, patterns: int = PATTERNS) -> DataFrame:
    """One row for each span of personal data: id, start and end in characters, type and probability.

    Null and empty texts have none; repeated rows give repeated spans (and count as often in the estimates); null ids
    are kept; other columns are ignored. Texts are read once; what follows works on spans, of which the driver sees counts of patterns.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for a, b, s in spans(text) if text else ():
                    before = text[max(0, a - CONTEXT) : a]
                    rows.append(k)
                    found.append((a, b, votes(s, before), features(s, before)))
            cols = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=t) for c, t in zip(cols, kinds))], ["id", "start", "end", "votes", "bits"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType().add("id", docs.schema[id_col].dataType).add("start", IntegerType()).add("end", IntegerType()).add("votes", LongType()).add("bits", LongType())
    scratch = Scratch(spark)
    held = scratch.put(picked.mapInArrow(run, schema))
    both = held.groupBy("votes", "bits").count().orderBy(F.desc("count"), "votes", "bits").limit(patterns).collect()
    ordered = sorted((r["votes"], r["count"]) for r in held.groupBy("votes").count().collect())
    _, _, post = reliabilities(ordered)
    place = {v: i for i, (v, _) in enumerate(ordered)}
    weights = np.zeros((FEATURES + 1, len(CLASSES)))
    if both:
        weights = fit(np.array([r["bits"] for r in both]), post[[place[r["votes"]] for r in both]], np.array([float(r["count"]) for r in both]))

    @F.pandas_udf("struct<type:string,probability:double>")
    def decide(bits):
        import pandas as pd

        p = predict(weights, bits.to_numpy())
        best = p.argmax(axis=1)
        return pd.DataFrame({"type": [CLASSES[k] for k in best], "probability": np.round(p[np.arange(len(p)), best], 6)})

    told = held.withColumn("d", decide("bits")).select(F.col("id").alias(id_col), "start", "end", F.col("d.type").alias("type"), F.col("d.probability").alias("probability"))
    out = cut(told.where((F.col("type") != "none") & (F.col("probability") >= threshold)))
    scratch.close()
    return out
