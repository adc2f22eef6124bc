import math
import random
import re

import pytest
from corpus import DOCS, odd_rows

from lanewise.llm import secret_scan as S
from lanewise.llm.secret_scan import scan_secrets

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def entropy_spans(text):
    """Each window that touches no passage of the allow-list is looked at on its own."""
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        value, spans = m[0], []
        allowed = [a.span() for a in re.finditer(S.ALLOWED, value)]
        for i in range(len(value) - S.WINDOW + 1):
            w = value[i : i + S.WINDOW]
            if any(a < i + S.WINDOW and i < b for a, b in allowed):
                continue
            total = sum(S.SUMS[w.count(c)] for c in set(w))
            digits = sum(c.isdigit() for c in w)
            hexes = all(c in "0123456789abcdefABCDEF" for c in w)
            if digits < S.WINDOW and (total <= S._most(S.HEX_BITS) if hexes else digits >= 2 and total <= S._most(S.WIDE_BITS)):
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + S.WINDOW
                else:
                    spans.append([i, i + S.WINDOW])
        yield from ((m.start() + a, 3, m.start() + b) for a, b in spans)


def expected(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = [s for s in entropy_spans(text) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return sorted(base), sorted(base + more)


@pytest.mark.parametrize("part", [500, 7])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART", part)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    pieces = [
        lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 70))),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(10, 50))),
        lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randrange(15, 50))),
        lambda: rng.choice(["token=", "Password : '", 'api_key="', "SECRET =", "apikey:", "passwd  =  ", "token=token: "]),
        lambda: "AKIA" + "".join(rng.choice("ABC123") for _ in range(rng.randrange(8, 20))),
        lambda: rng.choice([" ", "é", "😀", "\n", "a" * 40, "EXAMPLE", "12345678901234567890123", "0b7e3a52-1c2d-4e5f-8a9b-0c1d2e3f4a5b", "dummy-", "/example/", "Your_", "0123456789"]),
    ]
    texts = ["".join(rng.choice(pieces)() for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    some = 0
    for i, text in enumerate(texts):
        base, spans = expected(text)
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == base, text
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["spans"]] == spans, text
        some += len(spans) > len(base)
    assert some > 20


def test_odd_rows_and_clashing_names(spark):
    df = spark.createDataFrame(odd_rows(), DOCS).withColumnRenamed("lang", "spans").withColumnRenamed("source", "body")
    got = scan_secrets(df, ["doc_id"])
    assert got.count() == len(odd_rows())
    assert all(r["spans"] == [] for r in got.collect())
    assert scan_secrets(df.limit(0), ["doc_id"]).count() == 0


def test_entropy_of_a_window():
    assert S.SUMS[1] == 0 and S.SUMS[4] == 8_000_000
    assert math.isclose(math.log2(S.WINDOW) - S._most(3.0) / 1e6 / S.WINDOW, 3.0, abs_tol=1e-6)


def test_allowed_passages_hide_only_windows_that_touch_them(spark):
    secret = "q9Zx7Lm2Vb8Rt4Kw1Ny6Pc3"
    texts = [secret, f"docs/example/{secret}", f"/srv/dummy-{secret}/y", f"example{secret}example", "example" * 9, "a/0b7e3a52-1c2d-4e5f-8a9b-0c1d2e3f4a5b/b", secret[:12] + "dummy" + secret[12:]]
    got = scan_secrets(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS), ["doc_id"]).orderBy("doc_id").collect()
    for t, r in zip(texts[:4], got, strict=False):
        at = t.index(secret)
        assert any(s["start"] <= at + 1 and s["end"] >= at + 22 for s in r["spans"]), t
    assert [r["spans"] for r in got[4:]] == [[], [], []]


def test_time_grows_with_the_spans(spark):
    """Not with their square: 100 000 hexadecimal strings take about five times as long as 20 000."""
    import time

    took = []
    for n in (20_000, 20_000, 100_000):
        df = spark.range(1).selectExpr("id as doc_id", f"array_join(transform(sequence(1, {n}), i -> substring(md5(cast(i as string)), 1, 24)), ' ') as text")
        began = time.perf_counter()
        row = scan_secrets(df, ["doc_id"]).selectExpr("size(filter(base, s -> s.kind = 2)) as n", "size(spans) as m", "element_at(base, -1).end as last").first()
        took.append(time.perf_counter() - began)
        assert (row["n"], row["last"]) == (n, 25 * n - 1) and row["m"] >= n
    assert took[2] < 9 * took[1] + 2
