import random

from quillstone.llm import pii


def number(rng):
    body = "4" + "".join(rng.choices("0123456789", k=14))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def test_planted_data(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(300):
        kind, value = [
            ("email", f"ab{i}.c@mail{i % 9}.example.com"), ("phone", f"+1 ({rng.randint(200, 999)}) 555-{i:04d}"), ("ip_address", ".".join(str(rng.randint(1, 254)) for _ in range(4))), ("card_number", number(rng)), (None, f"{rng.randint(1, 12)}.{rng.randint(1, 20)} points"),
        ][i % 5]
        text = f"some words here {value} and then more"
        rows.append((i, text))
        if kind:
            want.add((i, 16, 16 + len(value), kind))
    got = {(r["doc_id"], r["start"], r["end"], r["type"]) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_numbers_side_by_side():
    assert [s for _, _, s in pii.spans("call +1 (826) 555-4081 190.137.223.204 now")] == ["+1 (826) 555-4081", "190.137.223.204"]


def test_short_addresses(spark):
    """Addresses of few digits are found among others, also beside numbers; version numbers of the same shape aren't addresses."""
    for text, want in {"8.8.8.8": ["8.8.8.8"], "(10.0.0.1).": ["10.0.0.1"], "ip:10.0.0.12:8080": ["10.0.0.12"], "10.12.3.4/8": ["10.12.3.4"], "port 555 10.0.0.1 up": ["555", "10.0.0.1"], "1.2.3.4.5 v1.2.3.4 +1.2.3.4": []}.items():
        assert [s for _, _, s in pii.spans(text)] == want, text
    rng = random.Random(6)
    rows = [(i, f"write to ab{i}.c@mail{i % 9}.example.com soon" if i % 2 else f"some words here {number(rng)} and more") for i in range(100)]
    rows += [(i, f"the words before {'.'.join(str(rng.randint(1, 254)) for _ in range(4))} and more") for i in range(100, 150)]
    rows += [(i, f"it needs version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)} or newer") for i in range(150, 170)]
    rows += [(200, "ask 8.8.8.8 for it"), (201, "it runs on 10.0.0.1, they say"), (202, "needs version 1.2.3.4 of it"), (203, "see section 1.2.3.4 of it")]
    got = {(r["doc_id"], r["start"], r["end"], r["type"]) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] >= 150}
    assert got == {(200, 4, 11, "ip_address"), (201, 11, 19, "ip_address")}


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.iban_ok("DE89370400440532013000")


def test_em_finds_the_bad_labeler():
    """A labeler that always says the opposite of two good ones gets a low reliability."""
    m = len(pii.LABELERS)
    pattern = lambda *v: sum((v[j] if j < len(v) else 15) << 4 * j for j in range(m))
    _, table, post = pii.reliabilities([(pattern(1, 1, 3), 80), (pattern(3, 3, 1), 70)])
    assert post.argmax(axis=1).tolist() == [1, 3] and table[0][1, 1] > 0.8 and table[2][1, 1] < 0.2


def test_em_sees_all_votes(spark, monkeypatch):
    """The limit on patterns holds for the classifier only."""
    seen, real = [], pii.reliabilities
    monkeypatch.setattr(pii, "reliabilities", lambda p: seen.extend(p) or real(p))
    pii.detect(spark.createDataFrame([(1, "x a@b.example.com y"), (2, "x a@b.example.com y"), (3, "at 190.137.223.204 now")], "doc_id long, text string"), patterns=1).count()
    assert sorted(n for _, n in seen) == [1, 2]


def test_hard_rows(hard, none):
    assert pii.detect(hard).count() == 0 and pii.detect(none).count() == 0
    again = pii.detect(hard.sparkSession.createDataFrame([(None, "x a@b.example.com"), (None, "x a@b.example.com")], "doc_id long, text string"))
    assert [(r["doc_id"], r["type"]) for r in again.collect()] == [(None, "email")] * 2


def test_linear_in_length():
    """A megabyte without blanks, or of numbers side by side, takes about a second at most; the time of a tenth of it is a tenth."""
    import time

    for unit in ("QWJjZGVm", "漢字仮名", "ab.cd-", "555-123-4567 ", "1 2 ", "12345678", "a@", "@", "DE89 3704 0044 ", "8.8.8.8 "):
        t = time.process_time()
        n = sum(1 for _ in pii.spans(unit * (100_000 // len(unit))))
        small, t = time.process_time() - t, time.process_time()
        assert sum(1 for _ in pii.spans(unit * (1_000_000 // len(unit)))) >= n
        assert time.process_time() - t < 3 + 20 * small, unit


def brute_spans(text):
    """All that CANDIDATE's branches match, found by trying every start and end; the first start's longest e-mail like run wins."""
    mark = set("@<>()[]{}\"|,;:")
    part = lambda c: not c.isspace() and c not in mark
    out, at = [], 0
    while at < len(text):
        a = text.find("@", at)
        if a < 0:
            break
        i = a
        while i > 0 and part(text[i - 1]):
            i -= 1
        j = a + 1
        while j < len(text) and part(text[j]):
            j += 1
        if i < a and j > a + 1 and i >= at:
            out.append(text[i:j].rstrip(".-_*%&#$!?'/( "))
            at = j
        else:
            at = a + 1
    return out


def test_addresses_against_brute_force():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choices("ab.@ ,<x-", k=rng.randint(1, 24)))
        assert [s for _, _, s in pii.spans(text)] == [s for s in brute_spans(text) if s], text
