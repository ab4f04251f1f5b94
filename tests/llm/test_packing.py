import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumeline.llm import packing, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", "a", " a", "a ", "  a", "a  b", "a   b", "a\n b", "a \nb", "a\n\nb", "a\n \nb", "\n", "\n\n", "it's  \t x", "x\x1c y", "tab\tb", "<|endoftext|> q",
    "'s 's", "a\r\nb", "é ü\n 日本 語  ", "don't word's x' y'' $$$ a$$$ ²x x² ½ -- a-b _a_ a_", "1,234.5 a1b2", "ǅ ª º", " nb  sp", "ЁЖ!!! Ё?",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(plain, words):
    encoder = tokens.Words(PATH)
    for text in [*ODD, " ".join(words(3000, 1)) + ".\n" + ", ".join(words(300, 2))]:
        for _ in range(2):  # the second time from memory
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain(text)


def test_signs_behind_a_word_are_apart(plain, words):
    """The library is asked once for a word, whatever signs end it, and the ids stay those of the text."""
    encoder, asked, word = tokens.Words(PATH), [], tokens.Words.word
    encoder.word = lambda space, text: asked.append(space + text) or word(encoder, space, text)
    some = sorted(set(words(200, 5)))
    text = " ".join(w + end for end in ["", ",", ".", "!?", '."', "&&&", "_", "'"] for w in some)
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain(text)
    assert len(asked) <= len(some) + 1

    hard = [
        "don't, it's. we'll' x'' 's, 's.", "a.b, c.,d e.,. .f. ., , .", "é. Ñ, ß! ÿ& ƀ; ɏ: ɐ, Ё, 語. ª. º, × ÷, a×, a÷. ²x², ½.", "e\u0301, e. \u0301", "5, 1.5. (7) [8], 9%",
        "line.\nnext,\nlast.", "line. \nnext", "a,\tb, c", ", ", ". a", "<|endoftext|>, q. <|endoftext|>.", "_a_, __, a__ b_.", "x" * 3000 + "." * 3000 + " y", "\ud7ff, \ufeff. \u200b, a\u200b. 𝐀, 𝐀.",
    ]
    for text in [*hard, *[h + "\n" + h + " " + h for h in hard]]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain(text)
    together, bounds = encoder.laid(pa.array([*hard, None, "", *ODD]))
    assert [together[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain(t) for t in [*hard, "", "", *ODD]]


def check(found, rows, plain, length):
    """Each id in exactly one piece, sequences without gaps, none too long."""
    want = sorted((str(d), tuple([*plain(t), 0])) for d, t in rows)
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault((str(r.doc), r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    for (d, n), pieces in by_doc.items():
        same = [ids for w, ids in want if w == d and len(ids) == n]
        got = sorted((r.start, r.length, r.ids_crc32) for r in pieces)
        crc = {(a, b, zlib.crc32(np.array(ids[a : a + b], "<u4").tobytes())) for ids in same for a, b, _ in got}
        assert all(g in crc for g in got) and sum(b for _, b, _ in got) == n * len(same)
        if len(same) == 1:
            assert [a for a, _, _ in got] == np.cumsum([0, *[b for _, b, _ in got]])[:-1].tolist()
    assert len({(d, len(i)) for d, i in want}) == len(by_doc)
    return by_sequence


@pytest.mark.parametrize(("length", "merge", "parts"), [(1024, 64, 3), (64, 2, 9)])
def test_round_trip(docs_of, words, plain, length, merge, parts):
    rows = [(i, " ".join(words(i * 7 % 400, i))) for i in range(120)] + [(500 + i, t) for i, t in enumerate(ODD)]
    rows += [(900, " ".join(words(9000, 4))), (901, None), (5, rows[5][1]), (None, "no id")]
    docs = docs_of(rows).repartition(parts)
    sequences = check(packing.pack(docs, PATH, length=length, open_windows=4, merge_tasks=merge).collect(), rows, plain, length)
    total = sum(len(plain(t)) + 1 for _, t in rows)
    assert len(sequences) * length < total * 1.15


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_windows_are_bounded_and_best_fit():
    w = packing.Windows(2, 10)
    assert w.place(["a"], 6) == [] and w.place(["b"], 8) == []
    assert w.place(["c"], 2) == [(1, [["b"], ["c"]])]  # fills the window with least room
    assert w.place(["d"], 10) == [(2, [["d"]])]  # a full piece is a window of its own
    assert w.place(["e"], 9) == []
    assert w.place(["f"], 5) == [(3, [["e"]])]  # none fits: the fullest goes
    assert len(w.held) == 2


def test_a_worker_holds_little(spark, docs_of, words, monkeypatch, tmp_path):
    """Documents reach a worker in batches of bounded size, and a chunk's ids don't take many times its text."""
    import tracemalloc

    seen, name = str(tmp_path / "rows"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    inner, before = packing._packed, spark.conf.get(name)

    def watched(*given):
        def run(batches):
            def noted():
                for batch in batches:
                    with open(seen, "a") as f:
                        f.write(f"{batch.num_rows}\n")
                    yield batch

            yield from inner(*given)(noted())

        return run

    monkeypatch.setattr(packing, "_packed", watched)
    assert packing.pack(docs_of([(i, "a b") for i in range(9000)]).coalesce(1), PATH).count() >= 9000
    sizes = [int(n) for n in open(seen)]
    assert sum(sizes) == 9000 and max(sizes) <= 1000 and spark.conf.get(name) == before

    encoder, text = tokens.Words(PATH), pa.array([" ".join(words(300, 3))] * 4000)
    tracemalloc.start()
    most = 0
    for _, part in tokens.chunks(text):
        encoder.laid(part)
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert most < 32 << 20
