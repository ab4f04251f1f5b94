import hashlib
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeline.llm import pii, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def plain_pii(text):
    def luhn(digits):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def noise(seed, n=300):
    """Texts of the pieces that the rules care about, in any order."""
    r = random.Random(seed)
    pieces = ["password", "API_KEY", "apikey", "token", "Secret", "passwd", ":", "=", '"', "'", " ", "  ", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "0123456789abcdef"]
    pieces += ["@", ".", "-", "+", "é", "日本", "😀", "x.y", "mail.com", "4539578763621486", "5500 0000 0000 0004", "192.168", "255", "999", "+1 (555) 010-9999", "١٢"]
    pieces += list(string.ascii_lowercase[:6]) + list("0123456789")
    return "".join(r.choice(pieces) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, noise(i)) for i in range(120)]
    out += [(200, None), (201, ""), (202, "a" * 10_000), (203, "1" * 10_000), (204, "1." * 10_000), (3, out[3][1]), (None, out[4][1])]
    return out + [(300 + i, "token = abcdef123456 and x@y.org") for i in range(50)]


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_secrets_equal_plain(docs_of, rows):
    found = secrets.report(docs_of(rows)).select("doc_id", secrets.digest(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in found) == sorted((str(d), digest(plain_secrets(t or ""))) for d, t in rows)
    assert secrets.report(docs_of([])).count() == 0


def test_many_matches_in_one_text(spark, docs_of):
    """A dump of keys: the walk takes every match once."""
    import time

    text = " ".join(f"token={i:06d}x é" for i in range(20_000))
    began = time.time()
    found = secrets.report(docs_of([(1, text)])).select(F.size("spans").alias("n"), secrets.digest(F.col("spans")).alias("s")).first()
    assert found.n == 20_000 and found.s == digest(plain_secrets(text))
    assert time.time() - began < 60


def test_a_blob_that_two_writers_stored_counts_once(spark, docs_of, tmp_path):
    docs, path = docs_of([(1, "token = abcdef123456"), (2, "token = abcdef123456")]), str(tmp_path / "ledger")
    for _ in range(2):
        secrets.scan(docs).write.mode("append").parquet(path)
    assert secrets.findings(docs, spark.read.parquet(path)).count() == 2


def test_secret_plan_is_native(docs_of, rows):
    text = secrets.report(docs_of(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", 1, "token=abcdefg"), ("b", 1, "clean"), ("c", 1, "token=abcdefg"), ("d", 1, None)], "path string, version int, text string")
    two = one.union(spark.createDataFrame([("a", 2, "AKIA" + "A" * 16), ("b", 2, "clean")], one.schema))
    assert secrets.update(one, path).count() == 3
    assert secrets.scan(two, spark.read.parquet(path)).count() == 1  # one unseen blob
    ledger = secrets.update(two, path)
    assert ledger.count() == 4
    assert secrets.scan(two, ledger).count() == 0
    assert secrets.scan(two, ledger, rule_version="2").count() == 4  # another rule version sees all blobs again
    found = {(r.path, r.version): len(r.spans) for r in secrets.findings(two, ledger).collect()}
    assert found == {("a", 1): 1, ("b", 1): 0, ("c", 1): 1, ("d", 1): 0, ("a", 2): 1, ("b", 2): 0}
    blob = hashlib.sha256(b"clean").hexdigest()
    assert ledger.where(F.col("blob") == blob).count() == 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.@-+ 0123()é\n", max_size=80))
def test_pii_patterns_equal_plain(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_patterns_on_noise():
    assert all(pii.base_spans(noise(s, 800)) == plain_pii(noise(s, 800)) for s in range(150))
    assert plain_pii("4539578763621486") == [("card", 0, 16)]


def test_pii_of_a_table(docs_of, rows):
    docs = docs_of(rows)
    found = pii.found(docs).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in found) == sorted((str(d), digest(plain_pii(t or ""))) for d, t in rows)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: (r.text, r.spans) for r in clean.where("doc_id >= 200").collect()}
    assert texts[300] == ("token = abcdef123456 and <email>", "c") and texts[200][0] is None and texts[202][0] == "a" * 10_000
    assert pii.found(docs_of([])).count() == 0


def test_disclosing_terms(docs_of, words):
    texts = []
    for i in range(400):
        w = words(40, i)
        if i < 12:  # the nickname stands near one address, among ever different words
            w[20:20] = ["Zorro", "wrote", "boss@corp.org"]
        texts.append((i, " ".join([*w, "wrote"])))
    texts += [(1000 + i, "Copied surroundings near other@corp.org here") for i in range(20)]
    docs = docs_of(texts)
    pairs = [(r.entity, r.term) for r in pii.disclosures(docs).collect()]
    assert ("email:boss@corp.org", "zorro") in pairs
    assert all(term == "zorro" for _, term in pairs)  # neither the common word nor the copies
    got = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "<term> wrote <email>" in got[3] and "Zorro" not in got[3]
    assert got[1000] == "Copied surroundings near <email> here"
    assert got[200] == dict(texts)[200]


def test_copies_of_documents_change_no_term(docs_of, words):
    texts = [(i, " ".join([*words(20, i), *(["Zorro", "wrote", "boss@corp.org"] if i < 12 else []), *words(20, 900 + i)])) for i in range(400)]
    copies = [(1000 * k + i, t) for k in range(1, 40) for i, t in texts[:12]]
    once, many = (sorted(map(tuple, pii.disclosures(docs_of(rows)).collect())) for rows in (texts, texts + copies))
    assert ("email:boss@corp.org", "zorro") in [(e, t) for e, t, _ in once]
    assert many == once


def test_slices_find_the_same(docs_of, words, monkeypatch):
    texts = [(i, " ".join([*words(10, i), "Nick", f"user{i % 4}@corp.org", *words(10, i + 999)])) for i in range(80)]
    texts += [(1000 + i, " ".join(words(30, 5000 + i))) for i in range(4000)]
    docs = docs_of(texts)
    whole = sorted(map(str, pii.found(docs).select("doc_id", "spans").where("doc_id < 1000").collect()))
    assert "term" in whole[0]
    monkeypatch.setattr(pii, "MOST_BROADCAST", 1)
    assert sorted(map(str, pii.found(docs).select("doc_id", "spans").where("doc_id < 1000").collect())) == whole
