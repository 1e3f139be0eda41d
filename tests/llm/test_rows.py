import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, components, decontaminate, pii, quality, secrets, similar, simhash

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n: int, rng=RNG) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text: str, share: float, rng=RNG) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


BLOT = "\x01"


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    base, masked = list(out), t
    for rank, rests in ((0, "AKIA[A-Z0-9]*(?=\x01)"), (1, None), (2, "(?<=\x01)[0-9a-f]+|[0-9a-f]+(?=\x01)")):
        left = list(masked)
        for x, r, z, _ in base:
            if r == rank:
                left[x:z] = BLOT * (z - x)
        masked = "".join(left)
        if rests:  # what is left of a run that another match cut
            masked = re.sub(rests, lambda m: BLOT * len(m[0]), masked)
    masked = re.sub(r"(?:/[a-z_]+){3}[a-z_/]*|(?i:example|sample|placeholder|abcdefgh|01234567)|([A-Za-z0-9+/_=-])\1{7,}", lambda m: BLOT * len(m[0]), masked)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", masked):
        c = m[0]
        if len(c) < 20 or any(re.search(a, c) for a in secrets.ALLOW):
            continue
        bits = next(b for _, p, b in secrets.CLASSES if re.search(p, c))
        most = int((math.log2(20) - bits) * 20 * secrets._ONE)
        hot = [i for i in range(20, len(c) + 1) if sum(secrets._CLOGC[n] for n in Counter(c[i - 20 : i]).values()) <= most]
        if hot:
            out.append((m.start() + hot[0] - 20, 3, m.start() + hot[-1], "entropy"))
    join = lambda spans: ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))
    n = Counter(k for *_, k in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(out)


def test_secrets(spark):
    parts = ["token", "=", ": ", '"', "password", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef", "x9", "Zq8+/_-", "é", "𝄞", " ", "\n", "SECRET", "secret", "kX92mPq0ZrT5vBn8LwYc3", "example", "/usr/lib/py", "AAAAAAAAA"]
    long = "".join(RNG.choice("abcdefghij0123456789XYZ+/") for _ in range(3000))
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 30))) for _ in range(300)] + [None, "", "token = abcdefghijklm " * 400]
    texts += [long, long[:237] + "a" * 30 + long, "/a" * 20_000 + "1", "x1" * 700 + long, "a" * 218 + long[:40]]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int, _parts int")
    got = {r[0]: tuple(r)[1:6] for r in secrets.secret_digests(secrets.scan_secrets(df)).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate(texts)}
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_secrets_of_a_megabyte(spark):
    """One candidate of a megabyte and a path of 100,000 segments: neither time nor stack runs out."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789+_", k=1_000_000)), "/a" * 100_000 + "1", "a1B2" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(df).collect()}
    (only,) = [s for s in got[0] if s.kind == "entropy"]
    assert only.start < 20 and only.end > 999_900 and not got[1] and not got[2]


def test_running_totals(spark):
    xs = [RNG.randint(0, 9) for _ in range(700)]
    df = spark.createDataFrame([(xs,), ([],)], "xs array<int>")
    got = [r.t for r in df.select(common.running_totals(F.col("xs")).alias("t")).collect()]
    assert got == [[0, *np.cumsum(xs).tolist()], [0]]


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    base = prose(300)
    texts = [base, base.upper(), edited(base, 0.004), edited(base, 0.01), prose(50), "one two", "one two", None, "", prose(9)]
    df = spark.createDataFrame([(100 - i, t, "x") for i, t in enumerate(texts)] + [(100, base, "x")], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, 4)) for t in texts]
    close = [(i, j) for i in range(10) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    labels = union_find(10, close)
    for i in range(10):
        assert got[100 - i].fp == np.uint64(fps[i]).view(np.int64)
        assert got[100 - i].component_id == min(100 - j for j in range(10) if labels[j] == labels[i])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [3, 10_000])
def test_close_links_in_crowded_buckets(spark, bucket):
    rng = np.random.default_rng(4)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    while len(fps) < 100:
        x = 123456789
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist())
    links = simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, bucket)
    got = dict(components.components(links, "a", "b").collect())
    labels = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 4])
    assert [got.get(x, x) for x in fps] == [fps[k] for k in labels]


def test_pseudonyms(spark):
    texts = [
        "mail a.b@mail5.example.com or +1 (743) 555-3824, 152.143.123.131 on 2021-03-04, 31.12.1999 and 12/25/2020",
        "card 4785380592391139, not 4785380592391138; DE89370400440532013000",
        None, "", "no numbers", "2021-02-30 1.2.3.4.5", "4785 3805 9239 1139 4785380592391139",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii_kinds int")
    got = {r.doc_id: r for r in pii.pseudonymize(df).collect()}
    assert got[0].pii_kinds == ["mail", "phone", "ipv4", "date", "date", "date"] and got[1].pii_kinds == ["card", "iban"]
    assert [got[i].text for i in (2, 3, 4, 5)] == [texts[i] for i in (2, 3, 4, 5)]
    shape = lambda t: re.sub("[0-9]", "9", re.sub("[a-z]", "a", t))
    assert shape(got[1].text) == shape(texts[1]) and "4785380592391138" in got[1].text and "4785380592391139" not in got[1].text
    spaced, plain = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[6].text)
    assert spaced.replace(" ", "") == plain  # equal values stay linked
    again = {r.doc_id: r.text for r in pii.pseudonymize(df, "other key").collect()}
    assert again[1] != got[1].text


def py_feistel(left, right, a, b, label, key):
    for i in range(pii.ROUNDS):
        number = lambda half: int(hashlib.sha256(f"{key}:{label}:{i}:{half}".encode()).hexdigest()[:13], 16)
        if i % 2 == 0:
            right = (right + number(left)) % b
        else:
            left = (left + number(right)) % a
    return left, right


def py_digits(digits, label, key):
    n = len(digits)
    k = n // 2
    left, right = py_feistel(int(digits[:k] or 0), int(digits[k:]), 10**k, 10 ** (n - k), f"{label}:{n}", key)
    return (str(left).zfill(k) if k else "") + str(right).zfill(n - k)


def py_luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def py_pseudonym(kind, found, key):
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        body = py_digits(digits[:-1], "card", key)
        new = body + str(-py_luhn(body + "0") % 10)
    elif kind == "date":
        form = "%Y-%m-%d" if found[4] == "-" else "%d.%m.%Y" if "." in found else "%m/%d/%Y"
        try:
            day = datetime.strptime(found, form)
        except ValueError:
            form = "%d/%m/%Y"
            day = datetime.strptime(found, form)
        left, right = divmod((day - datetime(1800, 1, 1)).days, 773)
        left, right = py_feistel(left, right, 189, 773, "date", key)
        return (datetime(1800, 1, 1) + timedelta(left * 773 + right)).strftime(form)
    elif kind == "ipv4":
        p = [int(x) for x in found.split(".")]
        left, right = py_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4", key)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    elif kind == "phone":  # North American only
        own = digits[-10:]
        left, right = py_feistel(int(own[:3]) - 200, int(own[3:]) - 2_000_000, 800, 8_000_000, "nanp", key)
        new = digits[:-10] + str(left + 200) + str(right + 2_000_000)
    it = iter(new)
    return re.sub("[0-9]", lambda m: next(it), found)


def test_pseudonyms_match_brute_force(spark):
    rng = random.Random(6)
    pick = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for _ in range(40):
        card = pick(rng.randint(12, 18))
        rows.append(("card", card + str(-py_luhn(card + "0") % 10)))
        day = datetime(1800, 1, 1) + timedelta(rng.randrange(146097))
        rows += [("date", day.strftime(f)) for f in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y")]
        rows.append(("ipv4", ".".join(str(rng.randrange(256)) for _ in range(4))))
        rows.append(("phone", f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{pick(4)}"))
    rows += [("date", "31/12/2024"), ("card", "3782 822463 10005"), ("phone", "+17435553824"), ("phone", "+1 743 555 3824")]
    df = spark.createDataFrame([(i, f"x {t} y") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    key = hashlib.sha256(b"k").hexdigest()
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    for i, (kind, found) in enumerate(rows):
        assert got[i].pii_kinds == [kind] and got[i].text == f"x {py_pseudonym(kind, found, key)} y"
    assert re.sub("[^0-9]", "", got[len(rows) - 2].text) == re.sub("[^0-9]", "", got[len(rows) - 1].text)  # linked whatever the punctuation


def test_grouped_iban_is_linked(spark):
    df = spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00 paid"), (2, "DE89370400440532013000"), (3, "DE88 3704 0044 0532 0130 00")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(df).collect()}
    assert got[1].endswith(" paid") and got[1][:-5].replace(" ", "") == got[2] != "DE89370400440532013000" and [len(g) for g in got[1][:-5].split(" ")] == [4, 4, 4, 4, 4, 2]
    assert got[3] == "DE88 3704 0044 0532 0130 00"


def test_hide_private_keeps_rows_and_columns(spark):
    long = "word " * 200_000 + "mail a.b@mail5.example.com"
    rows = [(1, long, 1, 7), (2, None, 2, 7), (3, "", 3, 7), (3, "", 3, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, pii_kinds int")
    out = pii.hide_private(spark, df, "")
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert out.columns == df.columns and [r._row for r in got] == [1, 2, 3, 3] and got[1].text is None and {r.pii_kinds for r in got} == {7}
    assert len(got[0].text) == len(long) and "a.b@mail5" not in got[0].text
    assert pii.hide_private(spark, df.limit(0), "").count() == 0


def test_cluster_without_a_key_draws_one(monkeypatch):
    """The pipeline's fourth stage failed on a master that is not local where the environment names no key."""
    monkeypatch.delenv(pii.KEY_NAME, raising=False)
    session = lambda app, master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId=app))
    with pytest.warns(UserWarning, match=pii.KEY_NAME):
        one, other = (pii.default_key(session(app, "spark://host:7077")) for app in ("app-1", "app-2"))
    assert pii.default_key(session("app-1", "spark://host:7077")) == one != other and len(one) == 64
    assert pii.default_key(session("app-3", "local[2]")) not in (one, other)
    monkeypatch.setenv(pii.KEY_NAME, "named")
    assert pii.default_key(session("app-1", "spark://host:7077")) == "named"


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000)
    for a, b in ((10, 100), (25, 40)):
        out = n.select(pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), F.lit("t")).alias("s")).select("s.*")
        assert out.distinct().count() == 1000 and out.filter(f"l >= {a} or r >= {b} or l < 0 or r < 0").count() == 0
    days = n.select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(pii._date(F.col("d"), "k").alias("d"))
    assert moved.distinct().count() == 1000 and moved.filter("try_cast(d as date) is null").count() == 0


def test_decontamination(spark):
    items = [(1, prose(40)), (2, prose(12)), (3, "one two three"), (4, None), (5, "")]
    item = items[0][1].split(" ")
    texts = [
        prose(100) + " " + items[0][1].upper() + "\n" + prose(30),
        prose(30) + " " + " ".join(item[:20] + ["changed"] + item[21:]) + " " + prose(5),  # 31 of 41 shingles stay: below 0.8
        prose(30) + " " + " ".join(item[:1] + ["changed"] + item[2:]) + " " + prose(5),
        items[1][1], "x one  two\tthree y", prose(200), None, "", " ".join(item[:20]),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench).collect()}
    expect = set()
    for d, t in enumerate(texts):
        w = decontaminate._words(t)
        for i, s in items:
            b = decontaminate._words(s)
            n, c = min(len(b), len(w)), Counter(decontaminate._shingles(b, 5))
            if n and any(decontaminate.weighted_similarity(Counter(decontaminate._shingles(w[k : k + n], 5)), c) >= 0.8 for k in range(len(w) - n + 1)):
                expect.add((d, i))
    assert got == expect and (0, 1) in got and (2, 1) in got and (4, 3) in got
    left = decontaminate.remove_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(range(9)) - {d for d, _ in got}
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_hamming_index_finds_all():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    index = decontaminate.HammingIndex(fps)
    for _ in range(20):
        x = int(fps[0])
        for b in rng.integers(0, 64, 20):
            x ^= 1 << int(b)
        assert index.query(x) == sorted((d, i) for i, f in enumerate(fps.tolist()) if (d := (x ^ f).bit_count()) <= index.radius)


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    good = [prose(RNG.randint(25, 200)).replace("a ", "a.\n") for _ in range(300)]
    junk = [prose(60).replace(" ", "$$$ ### ") for _ in range(8)] + [prose(60).upper()]
    odd = [None, "", "\n\n \t", "a " * 50, "x\nx\nx\n" * 9, prose(12) + " | " + prose(12), "é𝄞 " * 30]
    texts = good + junk + odd
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    stats = common.materialize(quality.quality_statistics(df, ["doc_id", "n_words"]), "t")
    got = {r["row"].doc_id: r for r in quality.judge(stats).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 309))
    kept = quality.keep_good(spark, df, "")
    assert kept.columns == df.columns and kept.filter("n_words <> 9").count() == 0
    assert quality.keep_good(spark, df.limit(0), "").count() == 0


def test_quality_columns_do_not_clash(spark):
    names = ["m0", "w00", "_text", "_words", "_lines", "_e0", "_k0", "x0", "q", "kept", "row", "g_lang", "start", "det", "n_words"]
    columns = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names)
    df = spark.createDataFrame([(1, prose(40), "en", "a", *range(15)), (2, "x", None, None, *range(15))], columns)
    (r,) = quality.keep_good(spark, df, "").collect()
    assert tuple(r)[4:] == tuple(range(15)) and r.__fields__[4:] == names
    assert quality.keep_good(spark, df.select("doc_id", "text"), "").columns == ["doc_id", "text"]


def brute_determinants(xs):
    """Minimum covariance determinant of rows, by the same starts and steps in numpy: (h, centre, covariance)."""
    x, floor = xs / quality.UNIT, np.diag([f**2 for _, f in quality.FEATURES])
    median = np.median(xs, axis=0)
    mad = np.diag((1.4826 * np.median(np.abs(xs - median), axis=0) / quality.UNIT) ** 2)
    ends = []
    for start, (centre, cov) in enumerate(((median / quality.UNIT, mad), (median / quality.UNIT, 0 * mad), (x.mean(0), np.cov(x.T, bias=True)))):
        for _ in range(quality.STEPS):
            z = np.linalg.solve(np.linalg.cholesky(cov + floor), (x - centre).T)
            q = np.floor(np.log2(1 + (z**2).sum(0)) * 64)
            near = x[q <= np.percentile(q, 75)]
            centre, cov = near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True)
        ends.append((round(np.linalg.slogdet(cov + floor)[1] / 2, 9), start, len(near), centre, cov))
    return min(ends, key=lambda e: e[:2])[2:]


def test_kept_matches_numpy(spark):
    """Groups of many, few and one rows, with outliers: every distance and verdict against numpy."""
    rng = np.random.default_rng(8)
    rows = []
    for lang, source, n in (("a", "p", 300), ("a", "q", 30), ("a", "r", 1), ("b", "p", 60)):
        xs = rng.normal(500, 120, (n, quality.P)) + (80 if lang == "b" else 0)
        xs[: n // 6] += rng.normal(4000, 500, (n // 6, quality.P))
        rows += [(lang, source, False, *map(int, r)) for r in xs.round()]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, base_failed boolean, " + ", ".join(f"x{i} long" for i in range(quality.P)))
    xs = np.array([r[3:] for r in rows])

    def pooled(own, wide):
        (h, m, c), (wm, wc), k = own, wide, quality.PRIOR
        a, b = h / (h + k), k / (h + k)
        return a * m + b * wm, a * c + b * wc + a * b * np.outer(m - wm, m - wm)

    every = brute_determinants(xs)[1:]
    langs = {g: pooled(brute_determinants(xs[[r[0] == g for r in rows]]), every) for g in "ab"}
    got = {(r.g_lang, r.g_source, *(r[f"x{i}"] for i in range(quality.P))): r for r in quality.judge(df).collect()}
    floor, kept = np.diag([f**2 for _, f in quality.FEATURES]), 0
    for g in {r[:2] for r in rows}:
        part = xs[[r[:2] == g for r in rows]]
        if len(part) > 1:
            own = brute_determinants(part)
        else:
            own = (1, part[0] / quality.UNIT, np.zeros((quality.P, quality.P)))
        m, c = pooled(own, langs[g[0]])
        inverse = np.linalg.inv(c + floor)
        for x in part:
            d = (x / quality.UNIT - m) @ inverse @ (x / quality.UNIT - m)
            r = got[(*g, *x.tolist())]
            assert r.distance2 == pytest.approx(d, rel=1e-6) and r.kept == (d <= quality.CUTOFF)
            kept += r.kept
    assert 250 < kept < len(rows)


def test_quality_of_a_very_long_text(spark):
    long = "\n".join(prose(50) for _ in range(1000))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = quality.judge(common.materialize(quality.quality_statistics(df, ["doc_id"]), "t")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(long)


def test_chi2():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


@pytest.mark.parametrize("few", [1, 24])
def test_similarity_classes(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "FEW", few)
    base = [prose(120) for _ in range(6)]
    texts = [b for b in base] + [edited(b, s) for b in base for s in (0.005, 0.01, 0.02, 0.03)] + [base[0], base[0].upper(), None, "", "a b", "a b c"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k")], "doc_id long, text string, text_key string")
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    same = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expect = {i for i, k in enumerate(union_find(len(sets), same)) if i == k}
    out = similar.keep_one_of_each(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(expect)
    assert similar.keep_one_of_each(spark, df.limit(0), "").count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (900, 901)], "a long, b long")
    got = defaultdict(set)
    for n, c in components.components(links, "a", "b").collect():
        got[c].add(n)
    assert got == {0: set(range(201)), 900: {900, 901}}


def test_hamming_blocks_find_all_windows():
    """The radius loses no window: with every item a candidate for every window, the hits are the same."""
    import pyarrow.parquet as pq

    read = lambda name, *c: [tuple(r.values()) for r in pq.read_table(f"/root/testdata/sf0.01/{name}.parquet", columns=list(c)).to_pylist()]
    index = decontaminate.BenchmarkIndex(read("benchmark", "item_id", "text"))
    texts = [t for _, t in read("documents", "doc_id", "text")]
    found = [{h[0] for h in index.hits(t)} for t in texts]

    class All:
        query = staticmethod(lambda fp: [(0, i) for i in range(len(index.ids))])

    index.hamming = All()
    assert found == [{h[0] for h in index.hits(t)} for t in texts] and sum(map(bool, found)) > 10


def test_decontamination_of_long_and_repetitive_texts(spark):
    item = prose(60)
    bench = spark.createDataFrame([(1, item), (2, "la " * 50), (3, item)], "item_id long, text string")
    texts = [prose(20_000) + " " + item + " " + prose(20_000), "la " * 60_000, prose(30_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench).collect()} == {(0, 1), (0, 3), (1, 2)}
    assert decontaminate.contamination(df.limit(0), bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 as item_id", "2 as similarity")
    kept = decontaminate.remove_contaminated(clash, bench)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [2]
