import base64
import itertools
import random
import re

from pyspark.sql import functions as F

from sitemill.llm import secrets

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base(odd, make, empty):
    rng = random.Random(8)
    parts = ["password", "PassWD", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "x1.y-z/", "é", "🙂", "AKIA", "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "ſecret=abcdefgh", "\n", "toKen=secret: abcdefg"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + ["token=abcdef " * 500]
    for docs in (make(texts), odd):
        text = {}
        for r in docs.collect():
            text.setdefault(r.doc_id, set()).add(r.text or "")
        for r in secrets.scan(docs).collect():
            assert tuple(map(tuple, r.base)) in {tuple(base_of(t)) for t in text[r.doc_id]}
            assert [s for s in r.found if s.kind < 3] == list(r.base)
    assert secrets.scan(empty).count() == 0


def test_random_tokens_are_told_from_words(make):
    rng = random.Random(9)
    word = lambda: rng.choice(["river", "Stone", "cloud", "Paper", "light", "Green", "house", "Night"])
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(300)]
    names = ["".join(word() for _ in range(7)) + str(rng.randrange(10)) for _ in range(300)] + ["Ab1" * 14 for _ in range(100)]
    texts = [f"see {x} there" for x in keys + names]
    found = {r.doc_id for r in secrets.scan(make(texts)).collect() if any(s.kind == 3 for s in r.found)}
    assert len(found & set(range(300))) >= 250
    assert len(found - set(range(300))) <= 0.15 * len(found)
    for r in secrets.scan(make(texts)).collect():
        for s in r.found:
            assert texts[r.doc_id][s.start : s.end] in {*keys, *names}


def test_copies_of_a_token_do_not_move_the_threshold(make):
    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: rng.choice(["river", "Stone", "cloud", "Paper", "light", "Green", "house", "Night"])
    keys = ["".join(rng.choice(letters) for _ in range(38)) for _ in range(200)]
    names = ["".join(word() for _ in range(7)) + str(rng.randrange(10)) for _ in range(200)]
    texts = [f"see {x} there" for x in keys + names]

    def limits(texts):
        spans = make(texts).select("doc_id", secrets.tested(secrets.matches("text", secrets.CANDIDATE)).alias("tokens"))
        tokens = spans.selectExpr("doc_id", "explode(tokens) AS t").select("doc_id", "t.*")
        return tokens, {r.stratum: r.least_p for r in secrets.thresholds(tokens).collect()}

    tokens, alone = limits(texts)
    assert len(alone) == 1
    rows = tokens.collect()
    for near in (0.3, 0.9):  # 4,000 copies in other documents
        r = min(rows, key=lambda r: abs(r.p - near))
        token = texts[r.doc_id][r.start : r.end]
        assert limits(texts + [f"copy {token}"] * 4_000)[1] == alone
    found = secrets.scan(make(texts + [f"copy {token}"] * 4_000)).where("doc_id >= 400")
    assert found.where("size(found) = 1").count() == 4_000  # all copies are reported


def test_keys_in_paths_behind_prefixes_and_without_digits(make):
    rng = random.Random(11)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    keys = (
        [("/user-files/", draw(upper + lower + digits, 40)) for _ in range(40)]
        + [("my-app_dir/", draw(lower + digits, 40)) for _ in range(40)]
        + [("sk-live-", draw(lower + digits, 40)) for _ in range(40)]
        + [("", draw(upper + lower, 40)) for _ in range(40)]
        + [("", draw(lower, 40)) for _ in range(40)]
    )
    texts = [f"see {a}{k} there" for a, k in keys] + ["see /user-files/some_words/other-words there", "see ----------------______________ there"] * 20
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.found] for r in secrets.scan(make(texts)).collect()}
    for first in range(0, 200, 40):
        assert sum(any(keys[i][1] in v for v in found[i]) for i in range(first, first + 40)) >= 30
    assert not any(found[i] for i in range(200, 240))
    assert all(len(found[i]) <= 1 for i in found)


def test_digest(make):
    text = "token = 0123456789abcdef0123456789abcdef"
    row = secrets.digest(secrets.scan(make([text]))).first()
    assert (row.n_assign, row.n_access, row.n_hex, row.spans) == (1, 0, 1, "assign:0:40,hex:8:40")


def test_a_text_of_many_matches(make):
    """Folds run in blocks: time grows with the number of matches, and blocks join up."""
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    text = " ".join(f"token=abcdef{i}" if i % 2 else draw(rng.randrange(16, 70)) for i in range(200_000))
    row = secrets.scan(make([text])).first()
    assert [tuple(s) for s in row.base] == base_of(text) and len(row.base) == 100_000
    taken = [s for s in row.found if s.kind == 3]
    assert len(taken) > 60_000 and all(s.end > s.start and " " not in text[s.start : s.end] for s in taken)
    assert all(a.end <= b.start for a, b in zip(row.found, row.found[1:]))


def test_folds(spark):
    rng = random.Random(13)
    rows = []
    for n in [0, 1, 2, 3, 255, 256, 257, 511, 513, 700]:
        for _ in range(4):
            spans = sorted((a, a + rng.randrange(1, 12)) for a in (rng.randrange(4 * n + 1) for _ in range(n)))
            base = sorted((a, 0, a + rng.randrange(1, 9)) for a in (rng.randrange(4 * n + 1) for _ in range(n // 3)))
            rows.append((spans, base))
    df = spark.createDataFrame(rows, "spans array<struct<start:int,end:int>>, base array<struct<start:int,kind:int,end:int>>")
    got = df.select("spans", "base", secrets.longest(F.col("spans")).alias("long"), secrets.apart_from(F.col("base"), F.col("spans")).alias("apart"), secrets.running(F.transform("spans", lambda s: s["end"]), lambda a, b: a + b).alias("sums"))
    for r in got.collect():
        kept = []
        for a, b in r.spans:
            if not kept or kept[-1][1] <= a:
                kept.append((a, b))
            elif b - a > kept[-1][1] - kept[-1][0]:
                kept[-1] = (a, b)
        assert [tuple(s) for s in r.long] == kept
        assert sorted(map(tuple, r.apart)) == [(a, b) for a, b in r.spans if not any(x < b and a < y for x, _, y in r.base)]
        assert r.sums == list(itertools.accumulate(b for _, b in r.spans))
