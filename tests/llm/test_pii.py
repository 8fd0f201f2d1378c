import hashlib
import random
import re

import numpy as np
import pytest
from helpers import SF, awkward, awkward_rows, empty, sentence

from kindred.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2]) % 10 == sum(sum(divmod(2 * x, 10)) for x in d[1::2]) * 9 % 10


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


CASES = [
    "", "a@b", "a@b.c", "x a.b+c@d-e.f.g, y@z", "@@a@b.c@d.e f", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.2.3.256 001.02.3.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "+1 (988) 555-2485 4111111111111111", "+12 +1() 2", "+1234567890123456", "00000000000000", "é a@b.cé 1.1.1.1", "5" * 40, "a" * 3000 + "@", "1." * 50, "\U0001f600 x@y.zz 4111 1111 1111 1111.",
]


@pytest.mark.parametrize("text", CASES)
def test_base_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_patterns_on_random_text():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("ab1234567890..@@+- ()é") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == brute(text), text


@pytest.fixture(scope="module")
def network():
    return pii.train([r[1] or "" for r in awkward_rows()])


def test_network_adds_forms_that_the_patterns_miss(network):
    """Held-out data between words that training has not seen: precision and recall of spans that are added."""
    r, hit, there, added, wrong = np.random.default_rng(9), 0, 0, 0, 0
    for i in range(300):
        kind, datum = pii.generated(r)
        before = sentence(r.integers(0, 60), i) + " "
        text = before + datum + " " + sentence(r.integers(0, 60), 1000 + i) + " " + pii.decoy(r) + " and so on"
        base = pii.base_spans(text)
        found = pii.added_spans(network.spans([text])[0], text, base)
        missed = not any(a < len(before) + len(datum) and len(before) < b for _, a, b in base)
        there += missed
        hit += missed and (kind, len(before), len(before) + len(datum)) in found
        added += len(found)
        wrong += sum(not (a < len(before) + len(datum) and len(before) < b) for _, a, b in found)
    assert there > 100 and hit / there > 0.85
    assert wrong / added < 0.1
    prose = "Plain words, nothing else; not even one number in sight. " * 20
    assert network.spans([prose]) == [[]]


def test_characters_are_told_apart(network):
    assert len(set(pii.characters("abcXYZ019@.+").tolist())) == 12
    assert pii.characters("\U0001f600é")[0] >= pii.ASCII


def test_spans_do_not_depend_on_batch(network):
    texts = [*CASES, *[r[1] or "" for r in awkward_rows()]]
    together = network.spans(texts)
    assert together == [network.spans([t])[0] for t in texts]


def test_data_across_windows(network):
    """Wherever a datum lies in a long text, window edges included, it is found as a whole."""
    prose = sentence(400, 5)
    for at in range(pii.STRIDE - 40, pii.WINDOW + 10, 7):
        at = prose.index(" ", at) + 1
        text = prose[:at] + "anna.berg [at] mail7.example.com " + prose[at:]
        assert ("email", at, at + 32) in pii.added_spans(network.spans([text])[0], text, []), at


def test_reconciled_by_gain():
    assert pii.reconciled([(0, 10, 1, 5.0, False, False), (8, 20, 2, 6.0, False, False), (20, 25, 1, 1.0, False, False)]) == [(8, 20, 2), (20, 25, 1)]
    # two windows have cut one datum
    assert pii.reconciled([(5, 30, 1, 3.0, False, True), (20, 60, 1, 4.0, True, False)]) == [(5, 60, 1)]


def test_reconciled_equals_enumeration():
    import itertools

    r = random.Random(4)
    for _ in range(200):
        found = [(a, a + r.randrange(1, 8), r.randrange(1, 5), r.random() * 5, False, False) for a in (r.randrange(20) for _ in range(7))]
        best = max(sum(s[3] for s in some) for k in range(8) for some in itertools.combinations(found, k) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2)))
        gain = {s[:3]: max(x[3] for x in found if x[:3] == s[:3]) for s in found}
        assert np.isclose(sum(gain[s] for s in pii.reconciled(found)), best)


def test_viterbi_equals_enumeration(network):
    import itertools

    kinds, n = np.array([[97, 50], [50, 64], [64, 43], [46, 0]]), np.array([4, 3])
    e = network.emissions(kinds, n)
    score = lambda j, p: network.p["begin"][p[0]] + sum(e[t, j, k] for t, k in enumerate(p)) + sum(network.p["turn"][a, b] for a, b in zip(p, p[1:]))
    tags = network.viterbi(e, n)
    for j in (0, 1):
        paths = list(itertools.product(range(pii.TAGS), repeat=int(n[j])))
        assert tuple(tags[: n[j], j]) == max(paths, key=lambda p: score(j, p))
        # the bound that spares windows the recursion holds
        margin = (e[: n[j], j, 1:].max(1) - e[: n[j], j, 0])[:, None]
        assert max(score(j, p) for p in paths if any(p)) - score(j, (0,) * n[j]) <= network._most(margin)[0] + 1e-4


def test_gradients():
    net, r = pii.Network(2), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    kinds, tags, n = r.integers(0, pii.CHARACTERS, (5, 3)), r.integers(0, pii.TAGS, (5, 3)), np.array([5, 5, 3])
    _, grads = net.loss_gradients(kinds, n, tags)
    for name, array in net.p.items():
        flat = array.reshape(-1)
        touched = np.flatnonzero(grads[name].reshape(-1))
        for i in [*r.integers(0, len(flat), 3), *r.choice(touched, 4)]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = net.loss_gradients(kinds, n, tags)[0]
            flat[i] = old - 1e-5
            down = net.loss_gradients(kinds, n, tags)[0]
            flat[i] = old
            assert np.isclose((up - down) / 2e-5, grads[name].reshape(-1)[i], rtol=1e-3, atol=1e-6), name


def check_digest(row, text):
    base = brute(text or "")
    told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
    assert set(filter(None, told.split(","))) <= set(row["spans"].split(","))


def test_awkward_table(spark, network):
    rows = pii.digest_columns(pii.find_spans(awkward(spark), network=network)).collect()
    assert len(rows) == len(awkward_rows())
    texts = {r[0]: r[1] for r in awkward_rows()}
    for row in rows:
        check_digest(row, texts[row["doc_id"]])
    assert pii.digest_columns(pii.find_spans(empty(spark), network=network)).count() == 0


def test_clashing_column(spark, network):
    from pyspark.sql import functions as F

    df = awkward(spark).withColumn("pii_spans", F.lit("x")).withColumn("__pii_spans", F.lit("y"))
    assert pii.digest_columns(pii.find_spans(df, network=network)).count() == len(awkward_rows())
    rows = pii.masked(df, network).collect()
    assert len(rows) == len(awkward_rows()) and all(r["pii_spans"] == "x" and r["__pii_spans"] == "y" for r in rows)


def test_masking(spark, network):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 10.1.2.3 now", "x"), (2, None, "y")], "doc_id long, text string, part string")
    out = {r["doc_id"]: r for r in pii.masked(df, network).collect()}
    assert out[1]["text"] == "mail [EMAIL] or [IP] now" and out[2]["text"] is None and out[2]["part"] == "y"
    assert pii.mask("0123456789", [(1, 4, "ip"), (3, 6, "card"), (8, 9, "email")]) == "0[IP]67[EMAIL]9"


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        check_digest(row, texts[row["doc_id"]])
