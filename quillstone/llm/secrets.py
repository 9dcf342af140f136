"""Secrets in texts, by probabilistic automata inferred from labelled credentials.

For each format a prefix tree of labelled credentials is folded by ALERGIA: states whose outgoing frequencies
agree within Hoeffding's bound, and whose successors do so too, are merged, which leaves a small automaton with
loops where the format is random and single arcs where it is fixed. The same is done for benign strings. A candidate's
score is the best log likelihood of a format (automaton and length) less that of the benign automaton.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType

from quillstone.cluster import ship
from quillstone.llm.common import pieces

ALPHA, LABELLED, FLOOR = 0.005, 800, 0.01
BENIGN_ALPHA = 0.05  # words have more structure than credentials: states are kept apart sooner
BARE_ODDS, KEYED_ODDS = -4.0, 2.5  # log prior odds of a candidate that no keyword introduces, and of one that a keyword does
KEYED = re.compile(
    r"""(?i:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|bearer|credential)(?:(?<=[Bb][Ee][Aa][Rr][Ee][Rr])[ \t]+(?=[^\s"'])|[\w-]{0,16}["']?(?:\s*[:=]\s*|\s+(?=["'])))(?:"(?P<dq>[^"\s]{6,})"|'(?P<sq>[^'\s]{6,})'|(?P<raw>[^\s"',;|]{6,}))"""
)
BARE = re.compile(r"[A-Za-z0-9_\-.=+/]{20,}")
LOGIN = re.compile(r"(?<=://)[^\s:@/]{0,64}:(?P<url>[^\s@/]{6,})@")
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{3,40}-----\s+[A-Za-z0-9+/=\s:,.-]{40,}?-----END [A-Z0-9 ]{3,40}-----")
_PART = re.compile(r"[A-Za-z0-9_\-]{20,}")
_TAIL = "!?.,;:)]}%*#&$"


def _pick(rng: random.Random, letters: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choices(letters, k=rng.randint(least, most or least)))


_HEX, _UP, _ALNUM = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits


def _hex(rng):
    s = _pick(rng, _HEX, rng.choice((32, 40, 40, 64)))
    return s.upper() if rng.random() < 0.15 else s


def _password(rng):
    kind = rng.random()
    if kind < 0.4:
        return _pick(rng, _HEX, 10, 32)
    if kind < 0.75:
        return _pick(rng, _ALNUM, 10, 28)
    return _pick(rng, _ALNUM + "!#%&*+-_@$^", 8, 24)


#: name -> (maker of labelled examples, whether it counts without a keyword before it)
FORMATS = {
    "aws_access_key": (lambda r: r.choice(("AKIA", "AKIA", "ASIA")) + _pick(r, _UP, 16), True),
    "github_token": (lambda r: r.choice(("ghp_", "gho_", "ghs_", "ghu_")) + _pick(r, _ALNUM, 36), True),
    "slack_token": (lambda r: f"xox{r.choice('bp')}-{_pick(r, string.digits, 11)}-{_pick(r, string.digits, 11)}-{_pick(r, _ALNUM, 24)}", True),
    "stripe_key": (lambda r: r.choice(("sk_live_", "rk_live_", "sk_test_")) + _pick(r, _ALNUM, 24), True),
    "google_api_key": (lambda r: "AIza" + _pick(r, _ALNUM + "_-", 35), True),
    "web_token": (lambda r: "eyJ" + ".".join((_pick(r, _ALNUM + "_-", 33), "eyJ" + _pick(r, _ALNUM + "_-", 60, 120), _pick(r, _ALNUM + "_-", 43))), True),
    "hex_token": (_hex, False),
    "cloud_secret": (lambda r: _pick(r, _ALNUM + "+/", 40), False),
    "password": (_password, False),
}
#: what a block begins with, and so many signs of its body, are scored for the whole of it; without a name: blocks that anyone may see
OPEN_BLOCKS = ("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP SIGNATURE", "PGP PUBLIC KEY BLOCK", "X509 CRL", "DH PARAMETERS", "EC PARAMETERS", "PKCS7")
BLOCKS = {"private_key": lambda r: f"-----BEGIN {r.choice(('', 'RSA ', 'EC ', 'DSA ', 'OPENSSH ', 'ENCRYPTED '))}PRIVATE KEY-----{_pick(r, _ALNUM + '+/', 40)}", "": lambda r: f"-----BEGIN {r.choice(OPEN_BLOCKS)}-----{_pick(r, _ALNUM + '+/', 40)}"}


def _benign(rng: random.Random) -> str:
    syllables = ("an er in on re th en at or es st ti ou ha nd ing the and ed to is it al ar ve le con com per pro der ein che la que os ment tion "
        "ce ti fi ca ma na ge me do cu si ra tu li mi no sa se so su ta te ab ac ad ap as au be bi bo bu cl cr da di du fa fe fl fo fr ga gi go gr ha hi ho hu ib ic id if ig il im ir iv ke ki li lo lu mo mu ne ni nu ob oc od og ol om on op or pa pe pi pl po pu qu re ri ro ru sc sh sk sl sp str sw ten ter tic tor tra tri tru ty ub uc ul um un ur us va vi vo wa we wi wo yst ack ick ell ill all est ist ast ant ate ive ous ful ble ness less ship age ance ence ity ing "
        "keit heit ung lich sch ver auf aus zu ein ig isch tät ción dad mente ado ido ando aire eur eux ique ette age").split()
    word = lambda n: "".join(rng.choices(syllables, k=n))
    kind = rng.randrange(8)
    if kind < 4:
        s = word(rng.randint(2, 12))
        return s.capitalize() if rng.random() < 0.3 else s.upper() if rng.random() < 0.1 else s
    if kind == 4:
        return _pick(rng, string.digits, 6, 24)
    if kind == 5:
        return rng.choice("-_./").join(word(rng.randint(1, 4)) for _ in range(rng.randint(2, 6)))
    if kind == 6:
        return f"{word(3)}.{rng.randint(1, 99)}-{rng.randint(1, 12):02}-{rng.randint(2000, 2030)}"
    return rng.choice(("=", "-", "_", ".", "+", "/")) * rng.randint(6, 60)


@dataclass
class Automaton:
    """arcs[state][char] = (next state, log probability); stop[state] = log probability of the end."""

    arcs: list[dict[str, tuple[int, float]]]
    stop: list[float]
    length: dict[int, float]
    other: float

    def score(self, s: str) -> float:
        """Log likelihood of the string, with its length's; an unseen character costs `other` and keeps the state."""
        state, total = 0, self.length.get(len(s), self.other * 1.5)
        for c in s:
            arc = self.arcs[state].get(c)
            if arc is None:
                total += self.other
            else:
                state = arc[0]
                total += arc[1]
        return total


def alergia(samples: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton that state merging leaves of the samples' prefix tree (Carrasco and Oncina's order, red and blue states)."""
    kids: list[dict[str, int]] = [{}]
    flow: list[dict[str, int]] = [{}]
    ends = [0]
    for s in samples:
        at = 0
        for c in s:
            flow[at][c] = flow[at].get(c, 0) + 1
            if c not in kids[at]:
                kids[at][c] = len(kids)
                kids.append({})
                flow.append({})
                ends.append(0)
            at = kids[at][c]
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    total = lambda q: ends[q] + sum(flow[q].values())

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            n1, n2 = total(a), total(b)
            if not n1 or not n2:
                continue
            if differ(ends[a], n1, ends[b], n2):
                return False
            for c in flow[a].keys() | flow[b].keys():
                if differ(flow[a].get(c, 0), n1, flow[b].get(c, 0), n2):
                    return False
                if c in kids[a] and c in kids[b] and min(flow[a][c], flow[b][c]) > 1:
                    work.append((kids[a][c], kids[b][c]))
        return True

    def likely(x: int, q: int) -> float:
        """How likely state x makes what was seen of q: of few examples much is compatible, but not all fits as well."""
        n = total(x)
        return sum(f * math.log(flow[x].get(c, 0) / n * (1 - FLOOR) + FLOOR / 95) for c, f in flow[q].items()) + ends[q] * math.log(max(ends[x], FLOOR) / n)

    def fold(a: int, b: int) -> None:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            if a == b:
                continue
            ends[a] += ends[b]
            for c, n in flow[b].items():
                flow[a][c] = flow[a].get(c, 0) + n
                if c in kids[a]:
                    work.append((kids[a][c], kids[b][c]))
                else:
                    kids[a][c] = kids[b][c]

    red = [0]
    while True:  # states with most evidence first: what is rare then folds along with what is well known
        blue = max(((r, c, kids[r][c]) for r in red for c in sorted(kids[r]) if kids[r][c] not in red), key=lambda x: total(x[2]), default=None)
        if blue is None:
            break
        r, c, q = blue
        into = max((x for x in red if compatible(x, q)), key=lambda x: (likely(x, q), total(x)), default=None)
        if into is None:
            red.append(q)
        else:
            kids[r][c] = into
            fold(into, q)
    number = {q: k for k, q in enumerate(red)}
    arcs, stop = [], []
    for q in red:
        n = total(q)
        arcs.append({c: (number[kids[q][c]], math.log(f / n * (1 - FLOOR) + FLOOR / 95)) for c, f in flow[q].items()})
        stop.append(math.log(max(ends[q], FLOOR) / n))
    lengths = Counter(map(len, samples))
    return Automaton(arcs, stop, {k: math.log(v / len(samples)) for k, v in lengths.items()}, math.log(FLOOR / 95))


@cache
def automata(labelled: int = LABELLED, seed: int = 7) -> tuple[dict[str, Automaton], Automaton]:
    """Automata of the formats and of benign strings, inferred from so many labelled examples each."""
    rng = random.Random(seed)
    made = {name: alergia([make(rng) for _ in range(labelled)]) for name, (make, _) in FORMATS.items()}
    made |= {name: alergia([make(rng) for _ in range(labelled)]) for name, make in BLOCKS.items()}
    benign = alergia([_benign(rng) for _ in range(4 * labelled)], BENIGN_ALPHA)
    floor = math.log(1 / 200)  # any benign string may have any length
    benign.length = {k: max(v, floor) for k, v in benign.length.items()}
    return made, Automaton(benign.arcs, benign.stop, benign.length, math.log(1 / 150))


def score(value: str, keyed: bool) -> tuple[str, float]:
    """The likeliest format and the log odds that the candidate is one of it rather than benign."""
    made, benign = automata()
    base = benign.score(value) - benign.length.get(len(value), benign.other * 1.5) + math.log(1 / 60)
    if not keyed:  # what stands alone may also be random without being a secret
        base = max(base, -4.2 * len(value))
    best = max(((name, a.score(value)) for name, a in made.items() if name in FORMATS and (keyed or FORMATS[name][1])), key=lambda x: x[1])
    return best[0], best[1] - base + (KEYED_ODDS if keyed else BARE_ODDS)


def score_block(block: str) -> tuple[str, float]:
    """The likeliest kind of a block between lines of hyphens, and its log odds, by its first line and the first signs of its body."""
    made, _ = automata()
    begins = block[: block.index("-----", 5) + 5]
    value = begins + re.sub(r"\s+|[A-Za-z-]+: .*", "", block[len(begins) : len(begins) + 400])[:40]
    best = max(((name, made[name].score(value)) for name in BLOCKS if name), key=lambda x: x[1])
    return best[0], best[1] - made[""].score(value)


@cache
def _openings() -> tuple[dict[str, list[str]], dict[str, tuple[list[int], re.Pattern]], re.Pattern]:
    """Formats without a keyword by the first three characters of their labelled examples; their lengths, longest first, and runs of their characters; what finds the first three after any sign."""
    rng, names, shapes = random.Random(7), {}, {}
    for name, (make, bare) in FORMATS.items():
        if bare:
            for s in sorted({make(rng)[:3] for _ in range(LABELLED)}):
                names.setdefault(s, []).append(name)
            made = automata()[0][name]
            shapes[name] = sorted(made.length, reverse=True), re.compile(f"[{re.escape(''.join(sorted({c for arcs in made.arcs for c in arcs})))}]*")
    return names, shapes, re.compile(f"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, names))})")


def _within(run: str) -> set[tuple[int, int]]:
    """Where candidates lie in a run without blanks: the whole, its parts between the signs = / . +, and, after any sign, the longest that begins as a format does and has its characters and length."""
    found = {(0, len(run)), (0, len(run.rstrip(".")))} | {m.span() for m in _PART.finditer(run)}
    names, shapes, start = _openings()
    for m in start.finditer(run):
        a = m.start()
        for name in names[m[0]]:
            lengths, letters = shapes[name]
            end = letters.match(run, a, a + lengths[0]).end()
            n = next((n for n in lengths if a + n <= end and run[a + n - 1] != "." and not run[a + n : a + n + 1].isalnum()), None)
            if n:
                found.add((a, a + n))
    return found


def findings(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, format, log odds) of the candidates of a text, in order; of those that overlap the likeliest."""
    spans: dict[tuple[int, int], bool] = {}
    m = KEYED.search(text)
    while m:
        a, b = m.span(m.lastgroup)
        spans[a, b] = True
        if m.lastgroup == "raw":  # the last signs may be the sentence's
            spans[a, a + len(m["raw"].rstrip(_TAIL))] = True
            if "&" in m["raw"]:  # a parameter of an address
                spans[a, a + m["raw"].index("&")] = True
        m = KEYED.search(text, a)  # the value may be the next one's keyword
    if "://" in text:
        for m in LOGIN.finditer(text):
            spans[m.span("url")] = True
    for m in BARE.finditer(text):
        for a, b in _within(m[0]):
            spans.setdefault((m.start() + a, m.start() + b), False)
    scored = [(*score(text[a:b], keyed), a, b) for (a, b), keyed in spans.items() if b - a >= 6]
    if "-----BEGIN" in text:
        scored += [(*score_block(m[0]), *m.span()) for m in BLOCK.finditer(text)]
    out, taken = [], []
    for name, odds, a, b in sorted(scored, key=lambda x: (-x[1], x[2] - x[3], x[2])):
        k = bisect(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b))
            out.append((a, b, name, odds))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.0) -> DataFrame:
    """One row for each secret: id, start and end in characters, format, score (log odds) and its first four characters.

    Every candidate of every whole text is scored; rows are those above the threshold. Null and empty
    texts have none; repeated rows give repeated findings; null ids are kept; other columns are ignored. One pass, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for a, b, name, odds in findings(text) if text else ():
                    if odds > threshold:
                        rows.append(k)
                        found.append((a, b, name, round(odds, 4), text[a : a + 4]))
            cols = list(zip(*found)) if found else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=t) for c, t in zip(cols, kinds))], ["id", "start", "end", "format", "score", "head"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType().add("id", docs.schema[id_col].dataType).add("start", IntegerType()).add("end", IntegerType()).add("format", StringType()).add("score", DoubleType()).add("head", StringType())
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_text(text: str, threshold: float = 0.0) -> str:
    out, at = [], 0
    for a, b, name, odds in findings(text):
        if odds > threshold:
            out += [text[at:a], f"<{name}>"]
            at = b
    return "".join([*out, text[at:]]) if at else text


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.0) -> DataFrame:
    """The rows with each secret replaced by its format's name in angle brackets, and n_chars, where there is one, of changed texts put right.

    Null and empty texts stay as they are; long ones are read whole, one after another; repeated rows stay repeated and change alike; an empty table gives an
    empty one. All other columns, whatever they are called, are kept.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else redact_text(t, threshold))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("old")).withColumn("new", clean("old"))
    changed = F.col("old").isNotNull() & (F.col("new") != F.col("old"))
    made = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("new")}
    if chars_col in docs.columns:
        made[chars_col] = F.when(changed, F.length("new").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row")[chars_col])
    return out.select(*[v.alias(c) for c, v in made.items()])
