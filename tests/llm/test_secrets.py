"""Secrets: held-out generated cases, redaction round trips, edge cases."""

import base64
import random
import string

import pytest

from astrolith.llm import secrets

RNG = random.Random(11)


def rand(n, chars=string.ascii_letters + string.digits):
    return "".join(RNG.choice(chars) for _ in range(n))


def secret_texts():
    word = RNG.choice(["Tiger", "garden", "Bottle"])
    return [
        (f"password={word}#{rand(4, string.digits)}", 1), (f"token: {rand(32)}", 1), ("gh" + f"p_{rand(36)}", 1),
        (f"Authorization: Bearer {rand(30)}\\r\\n", 1), (f"ftp://bob:{word}{rand(3, string.digits)}@host.example/x", 1),
        (f"-----BEGIN RSA PRIVATE KEY-----\\n{rand(64)}\\n{rand(40)}", 1), (f'AKIA{rand(7, string.ascii_uppercase)}"\\n  "{rand(9, string.ascii_uppercase + "123")}', 1),
        ("Authorization: Basic " + base64.b64encode(f"al:{rand(9)}".encode()).decode(), 1), (f"api_key = {rand(24, 'abcdef0123456789')}", 1),
        ("password=%s", 0), ("password=********", 0), ("token: ${TOKEN}", 0), ("Enter your password please", 0),
        (f"sha256:{rand(64, 'abcdef0123456789')}", 0), (f"commit {rand(40, 'abcdef0123456789')}", 0), (rand(40, "abcdef0123456789"), 0),
        (f"-----BEGIN PUBLIC KEY-----\\n{rand(64)}\\n{rand(40)}\\n", 0), ("https://host.example/a/b?page_token=next", 0),
        ("src/module/file_name.cpp", 0), ("value->next(buffer)", 0), ("net.core.max_size", 0), (f"id-{rand(8, string.digits)}", 0),
    ]


@pytest.fixture(scope="module")
def model():
    return secrets.Model([t for _ in range(60) for t, _ in secret_texts()])


def flagged(model, raw):
    text, _ = secrets.decode(raw)
    for _, _, v, n, k in secrets.candidates(text):
        if not secrets._skip(v, n, k):
            z = sum(w * x for w, x in zip(model.weights, [*model.extract.features(v, n, k), 0, 0, 0]))
            if z * model.a + model.b > 0:
                return 1
    return 0


def test_held_out_accuracy(model):
    cases = [c for _ in range(20) for c in secret_texts()]
    wrong = [t for t, y in cases if flagged(model, t) != y]
    assert len(wrong) <= 0.03 * len(cases), wrong[:5]


def test_found_and_redacted(spark, model):
    rows = [(1, 'ghp_AAbbCC11ddEE22ffGG"  "33hhII44jjKK55llMM66nn', 7, ""), (2, None, 7, None), (3, "", 7, ""), (4, "  ", 7, ""),
            (5, "user=x password=Tiger#1234 host=y", 8, ""), (6, "password=%s", 8, ""), (7, "word " * 5000, 8, "")]
    df = spark.createDataFrame(rows, "id long, content string, file_id long, function_usr string")
    files = spark.createDataFrame([(7, "tests/a.cpp"), (7, "./tests/a.cpp")], "id long, path string")
    found = [r for r in secrets.score(df, files, model).collect() if r.score >= secrets.THRESHOLD]
    assert {r.id for r in found} == {1, 5}
    spans = {r.id: list(r.spans) for r in found}
    assert secrets.redact(rows[4][1], spans[5]) == "user=x password=REDACTED host=y"
    assert secrets.redact(rows[0][1], spans[1]) == 'REDACTED"  "'
    assert secrets.score(df.limit(0), files, model).count() == 0


def test_fit_without_any_secret(spark):
    df = spark.createDataFrame([(1, "plain words here", 1, "")], "id long, content string, file_id long, function_usr string")
    files = spark.createDataFrame([], "id long, path string")
    assert [r for r in secrets.score(df, files).collect() if r.score >= 0.5] == []


def test_redaction_is_exact():
    r = secrets.redact_all
    assert r("password=Tr0ub4dor&3x!9 x", [[9, secrets.reach("password=Tr0ub4dor&3x!9 x", 18)]]) == "password=REDACTED x"
    assert secrets.reach("password=abcdef1;user=bob", 16) == 16
    # the same value found twice, and one inside another
    assert r("a:TOKEN@b", [[2, 7], [2, 7]]) == "a:REDACTED@b"
    assert r("abcdefghij", [[0, 9], [2, 4]]) == secrets.redact("abcdefghij", [0, 9, 2, 4]) == "REDACTEDj"
    # each secret has its mark, quotes between them or not
    text = '{\\"password\\":\\"Abc123xyz\\",\\"token\\":\\"Zx9Zx9\\"}'
    a, b = text.index("Abc"), text.index("Zx9")
    assert r(text, [[a, a + 9], [b, b + 6]]) == text.replace("Abc123xyz", "REDACTED").replace("Zx9Zx9", "REDACTED")
    assert r(None, [[0, 1]]) is None and r("abc", []) == "abc"


def test_values_of_any_length(model):
    got = lambda t: [v for _, _, v, _, _ in secrets.candidates(secrets.decode(t)[0])]
    assert got("pin=4921")[-1] == "4921" and got("db_pw=aX9$k")[-1] == "aX9$k"
    # what stands behind character 200 counts
    a, b = "abcd" * 60, "abcd" * 50 + "Q9$zX7!k" * 5
    assert model.extract.secret.mean(a) != model.extract.secret.mean("abcd" * 50 + "Q9$zX7!kQ9$zX7!k")
    assert model.extract.features(a, [], "")[1] != model.extract.features(b, [], "")[1]


def test_places_are_fitted():
    texts = [t for _ in range(40) for t, _ in secret_texts()]
    rng = random.Random(2)
    labels = [y for _ in range(40) for _, y in secret_texts()]
    places = [(float(rng.random() < (0.1 if y else 0.7)), 0.0, float(rng.random() < (0.6 if y else 0.1))) for y in labels]
    m = secrets.Model(texts, places)
    assert m.weights[-3] < 0 < m.weights[-1]


def test_redacted_frame(spark, model):
    df = spark.createDataFrame([(1, "user=x password=Tiger#1234&zz! host=y", 8, ""), (2, None, 8, ""), (3, "plain", 8, "")],
                               "id long, content string, file_id long, function_usr string")
    files = spark.createDataFrame([(8, "a.cpp")], "id long, path string")
    found = secrets.score(df, files, model, least=secrets.THRESHOLD).where(f"score >= {secrets.THRESHOLD}")
    assert [tuple(r) for r in secrets.redacted(df, found).collect()] == [(1, "user=x password=REDACTED host=y")]
