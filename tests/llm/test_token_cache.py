import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_packing import ODD

from plumeline.llm import queries, token_cache, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [
    "a", "Word", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "\xa0", "　", "\x1c", "\x85", "²", "-", "_", " the", "\r\n", "ǅ", "😀", "​",
    "﻿", "́", "ª",
]


def library(path, specials=True):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not specials
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    r = random.Random(4)
    return [*ODD, "x <|endoftext|>y", *["".join(r.choice(SIGNS) for _ in range(r.randint(0, 12))) for _ in range(3000)]]


@pytest.mark.parametrize("specials", [True, False])
def test_ids_equal_the_library(specials, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)  # words are forgotten and met again
    words, plain = tokens.Words(PATH, specials), library(PATH, specials)
    texts = odd_texts()
    for part in (texts, texts[:1], []):
        ids, bounds = words.laid(pa.array(part, pa.string()))
        assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(part))] == [plain(t) for t in part]


def test_chunks_keep_every_text(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 100)
    texts = pa.array(["x" * n for n in (10, 300, 0, 60, 60, 1)] + [None])
    assert [t for low, part in tokens.chunks(texts) for t in part.to_pylist()] == texts.to_pylist()
    assert [low for low, _ in tokens.chunks(texts)] == [0, 1, 2, 4]


@pytest.fixture
def rows(words):
    long = " ".join(words(20_000, 3))
    out = [(i, " ".join(words(40, i % 90)), "s") for i in range(200)] + [(1000 + i, "one common text", "s") for i in range(150)]
    out += [(2000 + i, t, "s") for i, t in enumerate(odd_texts()[:60])]
    return [*out, (3000, None), (3001, ""), (3002, long), (None, "no id"), (3, " ".join(words(40, 3)))]


def check(out, rows, plain, limit=512):
    got = sorted((str(r.doc), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(plain(r[1])), len(plain(r[1])) > limit) for r in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_the_library(spark, docs_of, rows, tmp_path, name):
    path = public_tokenizers.path(name)
    check(token_cache.token_counts(docs_of(rows), str(tmp_path), path), rows, library(path))


def test_sentencepiece(spark, docs_of, rows, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check(token_cache.token_counts(docs_of(rows), str(tmp_path), path), rows, lambda t: model.encode(t or ""))


def test_only_misses_are_encoded_and_appended(spark, docs_of, rows, tmp_path):
    cache, docs = str(tmp_path), docs_of(rows)
    first = docs.where("doc_id < 100")
    token_cache.update(first, cache, PATH)
    known = token_cache.stored(spark, cache, PATH)
    assert known.count() == len({r[1] for r in rows if r[0] is not None and r[0] < 100})
    new = token_cache.misses(docs, known)
    assert new.count() == len({r[1] or "" for r in rows}) - known.count()
    assert new.join(known, "digest").count() == 0
    waiting = token_cache.counted(docs, cache, PATH)
    assert waiting.where("n_tokens is null").count() == sum(r[1] not in {x[1] for x in rows if x[0] is not None and x[0] < 100} for r in rows)
    token_cache.update(docs, cache, PATH)
    token_cache.update(docs, cache, PATH)  # nothing new
    raw = spark.read.parquet(token_cache.folder(cache, PATH))
    assert raw.count() == raw.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    check(token_cache.counted(docs, cache, PATH), rows, library(PATH))


def test_stored_counts_are_used(spark, docs_of, tmp_path):
    """A stored count is the answer, and a digest that two writers stored counts once."""
    docs = docs_of([(1, "a b c", "s"), (2, "other", "s")])
    fake = docs.where("doc_id = 1").select(token_cache.digest("text").alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    for _ in range(2):
        fake.write.mode("append").parquet(token_cache.folder(str(tmp_path), PATH))
    out = token_cache.token_counts(docs, str(tmp_path), PATH, limit=76)
    assert sorted((r.doc, r.n_tokens, r.over_limit) for r in out.collect()) == [(1, 77, True), (2, 1, False)]


def test_versions_are_apart(tmp_path):
    other = tmp_path / "byte_bpe_50k.json"
    with open(PATH, encoding="utf8") as f:
        other.write_text(f.read() + "\n", encoding="utf8")
    assert token_cache.folder("c", PATH) != token_cache.folder("c", str(other))


def test_empty_table(spark, docs_of, tmp_path):
    assert token_cache.token_counts(docs_of([]), str(tmp_path), PATH).collect() == []


def test_query_covers_every_row(spark, folder):
    plain = library(PATH)
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, folder).collect()}
    assert got == {d.doc_id: (len(d.text.encode()), len(plain(d.text)), len(plain(d.text)) > 512) for d in docs}
