"""Very long runs of what a pattern repeats end no task, and many spans are found in linear time."""

import re
import time

import pytest

from duskline.llm import secrets, surrogates

N = 1_000_000
RUNS = {
    "labels": "a@b" + ".c" * (N // 2),
    "dots": "a@b.c" + "." * N,
    "local part": "a" * N + "@b.c",
    "label": "x a@" + "b" * N + ".org",
    "begin": "-----BEGIN " + "A " * (N // 2) + "PRIVATE KEY-----",
    "key": "-----BEGIN PRIVATE KEY-----" + "QUJD\n" * (N // 5) + "-----END RSA PRIVATE KEY-----",
    "begin again": "-----BEGIN PRIVATE KEY-----AB" * (N // 29),
    "blanks": "token" + " " * N + "= abcdefgh1",
    "value": "token=" + "a" * N,
    "assignments": "token=token=" * (N // 12),
    "access": "AKIA" + "A" * N,
    "hex": "0a" * (N // 2),
    "jwt": "eyJ" + "a" * N + "." + "b" * 10 + "." + "c" * 10,
    "jwt again": "eyJaaaaaaaaa." * (N // 13),
    "forge": "ghp_" + "a" * N,
    "url": "http://" + "a" * N + ":" + "b" * 10 + "@c.d",
    "schemes": "a" * N + "://b:cccccc@d",
    "mixed": "aA1" * (N // 3),
    "letters": "aA" * (N // 2),
    "octets": "1." * (N // 2),
    "digits": "1" * N,
    "grouped": "1234 " * (N // 5),
    "pairs": "12 " * (N // 3),
    "account": "AB12 " + "ABCD " * (N // 5),
    "phone": "+1 " + "23 " * (N // 3),
    "surname": "Mr. A" + "b" * N,
    "double": "Maria A" + "-Ab" * (N // 3),
    "names": "Maria " * (N // 6),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(RUNS.values())], "doc_id long, text string, source string").repartition(8)


def test_secrets_of_long_runs(rows):
    found = {r["doc_id"]: r for r in secrets.secret_spans(rows).collect()}
    assert len(found) == len(RUNS)
    names = list(RUNS)
    for i, t in enumerate(RUNS.values()):
        assert found[i]["n_access"] == len(re.findall("AKIA[A-Z0-9]{12,}", t)), names[i]
        assert found[i]["n_hex"] == len(re.findall("[0-9a-f]{32,}", t)), names[i]
    assert "pem" in found[names.index("key")]["spans"]
    assert "pem" not in found[names.index("begin")]["spans"]


def test_surrogates_of_long_runs(rows):
    found = {r["doc_id"]: r for r in surrogates.with_surrogates(rows).collect()}
    assert len(found) == len(RUNS)
    names = list(RUNS)
    assert found[names.index("labels")]["kinds"] == "email"
    assert found[names.index("labels")]["text"].endswith(".c" * 1000)
    assert found[names.index("digits")]["text"] == RUNS["digits"]


def test_many_spans_are_placed(spark):
    one = "x token=abcdefgh%07d y\n"
    times = {}
    for n in (1_000, 40_000):
        text = "".join(one % i for i in range(n))
        start = time.time()
        got = secrets.secret_spans(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
        times[n] = time.time() - start
        places = [m.span() for m in re.finditer("token=[a-z0-9]{8,}", text)]
        spans = [s for s in got["spans"].split(",") if s.startswith("assign")]
        assert spans == [f"assign:{a}:{b}" for a, b in places] and got["n_assign"] == n
    assert times[40_000] < 60
