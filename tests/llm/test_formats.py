import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import chat, licenses, mixing, packing, scoring, token_files
from graphloom.llm.tokenize import encoder

EDGE = [(3, "a  b\n\nc\td é x"), (1, None), (2, ""), (1, None), (5, "The end.\nNext line <|endoftext|> 's"), (4, "word " * 3000)]


@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 500))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids, zeros):
    ids = np.array(ids + [0] * zeros, dtype=np.uint64)
    docs, counts, back = token_files.decode_segment(token_files.encode_segment(np.array([7]), np.array([len(ids)]), ids))
    assert docs.tolist() == [7] and counts.tolist() == [len(ids)] and (back == ids).all()


def test_simple8b_many_blocks():
    ids = np.random.default_rng(1).integers(0, 50257, 5 * token_files.BLOCK + 3).astype(np.uint64)
    assert (token_files.decode_segment(token_files.encode_segment(np.arange(2), np.array([3, len(ids) - 3]), ids))[2] == ids).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(text=st.text(alphabet=st.sampled_from(list("ab'sé1.Σ \n\t 　́\x00\x01\x1c\x85|<")), max_size=60))
@settings(max_examples=150, deadline=None)
def test_cached_ids_are_the_tokenizers(name, text):
    path = public_tokenizers.path(name)
    plain = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert encoder(path).ids(text) == plain


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_whole_table_has_the_tokenizers_ids(name):
    """Every text of a table, its special tokens as the file has them, against the plain library."""
    path = public_tokenizers.path(name)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts += [t.replace("a", "<|endoftext|>", 1) for t in texts[:20]] + ["Ünïcode ÀÉ. ß, ÷×\nªº\n\nx", "<|endoftext|>", "a <|endoftext|>\nb", "\nStart.\nÉtat!?... 12\n's"]
    tokenizer = Tokenizer.from_file(path)
    plain = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(encoder(path).ids_of(texts)) == plain
    assert any(b"<|endoftext|>" in t.encode() for t in texts)


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    tok = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(d, t, 1) for d, t in EDGE], "doc_id long, text string, shard int")
    token_files.write_token_files(docs, path, tok, segment_ids=500)
    got = sorted(tuple(r)[:4] for r in token_files.token_digests(spark, path).collect())
    t = Tokenizer.from_file(tok)
    start, expect = 0, []
    for d, text in sorted(EDGE, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        expect.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(expect)
    token_files.write_token_files(docs.limit(0), path + "0", tok)
    assert token_files.token_digests(spark, path + "0").count() == 0


def test_packing(spark):
    tok = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").filter("doc_id <> 1")
    rows = packing.pack(docs, tok, capacity=64, group_ids=1000).collect()
    t = Tokenizer.from_file(tok)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, text in EDGE:
        if d == 1:
            continue
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert packing.pack(docs.limit(0), tok).count() == 0


def test_balanced_assignment_takes_lowest_cost():
    placed, left = packing.assign([(0, 0, 5), (1, 0, 4), (2, 0, 3), (3, 0, 2)], 2, 8)
    assert not left[:0] and {(d, s) for d, _, _, s, _ in placed} == {(0, 0), (1, 1), (2, 1), (3, 0)}


CHAT = st.text(alphabet=st.sampled_from(list("<>[]|/sINSTend:\n" + chat.ESCAPE)), max_size=40)


@given(st.lists(st.tuples(CHAT, CHAT), max_size=4))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    made = chat.format_conversation(turns)
    assert chat.parse(made["formatted"]) == turns


def test_chat_parts_and_loss():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b", "seconds": 2}, {"type": "document", "ref": "c", "pages": 2}]
    made = chat.format_conversation([("user", parts), ("assistant", "</s>ok")])
    assert [a["tokens"] for a in made["attachments"]] == [3, 25, 1024] and made["expanded_tokens"] == 1052
    assert chat.PLACEHOLDER.findall(made["formatted"]) == [("image", "0"), ("audio", "1"), ("document", "2")]
    assert [chat.unescape(made["formatted"][a:b]) for a, b in zip(made["loss_starts"], made["loss_ends"])] == ["</s>ok"]
    with pytest.raises(ValueError):
        chat.format_conversation([("user", [{"type": "video"}])])


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b", 0), (None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[None].n_turns == 1
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0
    # texts as typed parts come out the same, and a text that looks like JSON or a placeholder stays a text
    odd = spark.createDataFrame([(1, 0, "user", '[{"type": "image"}] <|image:0|>'), (1, 1, "assistant", "[")], "conv_id long, turn long, role string, text string")
    plain, typed = (chat.chat_digests(chat.format_chats(*x)).collect() for x in ((odd,), (chat.text_parts(odd), "parts")))
    assert plain == typed and plain[0].n_attachments == 0


def test_chat_attachments(spark):
    parts = [
        [{"type": "text", "text": "see </s>"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "document", "url": "d.pdf", "pages": 3}],
        [{"type": "audio", "ref": "x.wav", "seconds": 2}, {"type": "text", "text": "heard"}],
    ]
    rows = [(7, 0, "user", "", json.dumps(parts[0])), (7, 1, "assistant", "", json.dumps(parts[1])), (8, 0, "user", "plain", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, p string")
    made = chat.format_chats(df, "p")
    got = {r.conv_id: r for r in made.collect()}
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in got[7].attachments] == [(0, "image", "a.png", 3), (0, "document", "d.pdf", 1536), (1, "audio", "x.wav", 25)]
    digests = {r.conv_id: r for r in chat.chat_digests(made).collect()}
    assert digests[7].n_attachments == 3 and digests[7].expanded_tokens == 3 + 1536 + 25 and digests[8].n_attachments == 0
    assert digests[7].loss_chars == len("<|audio:2|>heard")


def test_patience_alignment():
    a, b = "x the big cat sat on the mat y".split(), "the big dog sat on the mat".split()
    pairs = licenses.patience(a, b)
    assert [a[i] for i, _ in pairs] == "the big sat on the mat".split()
    assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs)
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-text"]
    texts = ["x " * 50 + "Released under the MIT License. " * 2, mit.replace("Software", "Work", 1) + " tail", "license to kill", None, ""]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = licenses.scan_licenses(df).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {(0, "mit"): 2, (1, "mit-text"): 1}
    assert all(texts[r.doc_id][r.start : r.end].startswith(("Released", "Permission")) for r in got)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_licenses_match_brute_force(spark):
    """Templates of distinct words, where aligning is finding the longest common subsequence: every place, no seeds."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    templates = {f"t{k}": " ".join(word() for _ in range(n)) for k, n in enumerate((8, 20, 45))}
    texts = []
    for _ in range(90):
        body = [word() for _ in range(rng.randrange(60))]
        planted = templates[rng.choice(list(templates))].split()
        share = rng.choice([0, 0.05, 0.1, 0.3, 0.5])
        planted = [w for w in planted if rng.random() > share / 2]
        planted = [word() if rng.random() < share / 2 else w for w in planted]
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + planted + body[at:]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license, r.matched_words) for r in licenses.scan_licenses(df, templates).collect()}
    expect = set()
    for d, t in enumerate(texts):
        words = t.split()
        for name, template in templates.items():
            best = lcs(words, template.split())
            if best >= licenses.COVERAGE * len(template.split()):
                expect.add((d, name, best))
    assert got == expect and 20 < len(got) < 80


def test_licenses_in_a_very_long_text(spark):
    notice = licenses.TEMPLATES["mit"]
    text = ("filler words " * 40 + notice + " ") * 3000
    df = spark.createDataFrame([(1, text), (1, text[:700])], "doc_id long, text string")
    got = Counter(r.license for r in licenses.scan_licenses(df).collect())
    assert got == {"mit": 3001}


def test_packing_of_a_very_long_text(spark):
    tok = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "word " * 300_000), (None, None), (3, "")], "doc_id long, text string")
    got = packing.pack(df, tok).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 300_001 and sum(r.length for r in got) == 300_003
    assert max(r.length for r in got) <= packing.CAPACITY and packing.pack(df.limit(0), tok).count() == 0


def test_mixing_learns_and_sums_to_one():
    lines = [mixing.symbols("the cat sat on the mat. " * 20)] * 5
    pairs = sum(map(mixing.pair_counts, lines))
    coder = mixing.Coder(pairs)
    trainer = mixing.Trainer(coder)
    for x in lines:
        trainer.add(x)
    mixer = mixing.Mixer(coder, mixing.stretched(np.concatenate(_settled(trainer, pairs))))
    known, n = mixer.score("the cat sat on the mat. " * 20)
    strange, m = mixer.score("zqx jvk wpf. " * 20)
    assert -known / n < -strange / m / 4
    # the prefix code is complete, so a symbol's probabilities sum to one
    assert sum(2.0 ** -coder.lengths[s] for s in range(mixing.SYMBOLS)) == pytest.approx(1)


def brute_score(coder, tables, text):
    """One decision after the other, in plain Python: the mixer's score of a text."""
    line = mixing.symbols(text).tolist()
    past = [0] * mixing.PAST + line
    events = []
    for at, symbol in enumerate(line):
        back = past[: at + mixing.PAST][::-1]
        pair = back[0] * mixing.SYMBOLS + symbol
        first = int(coder.offsets[pair])
        for path in coder.path[first : first + int(coder.lengths[pair])].tolist():
            bit, salt, h, done, inputs = path & 1, path | 1, 0, 0, []
            for order, size, table in zip(mixing.ORDERS, mixing.SLOT_BITS, tables):
                for i in range(done, order):
                    h = (h ^ (back[i] + 1 + i)) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 13
                done = order
                mixed = (h * 0xC2B2AE35) + salt & 0xFFFFFFFF
                inputs.append(int(table[mixed >> (32 - size)]) / 8)
            events.append((bit, inputs))
    weights = [list(map(float, w)) for w in mixing._START]
    refined = [1 / (1 + math.exp(-((i + 0.5) * 16 / mixing._MAP - 8))) for i in range(mixing._MAP)] * 2
    nats, at, size, counted = 0.0, 0, 1024, 0
    # blocks never cross a segment's end
    segment_ends, n = [], 0
    for i in range(0, len(line), mixing.SEGMENT):
        n += sum(int(coder.lengths[past[j + mixing.PAST - 1] * mixing.SYMBOLS + line[j]]) for j in range(i, min(len(line), i + mixing.SEGMENT)))
        segment_ends.append(n)
    while at < len(events):
        end = min(at + size, next(e for e in segment_ends if e > at))
        steps, gates = [[0.0] * 4, [0.0] * 4], [0, 0]
        met: dict[int, list[int]] = {}
        for bit, x in events[at:end]:
            gate = int(x[-1] != 0)
            z = min(7.99, max(-7.99, sum(w * v for w, v in zip(weights[gate], x))))
            p = 1 / (1 + math.exp(-z))
            cell = int((z + 8) * mixing._MAP / 16) + gate * mixing._MAP
            q = (refined[cell] + p) / 2
            nats += math.log(q if bit else 1 - q)
            gates[gate] += 1
            steps[gate] = [s + v * (bit - p) for s, v in zip(steps[gate], x)]
            met.setdefault(cell, [0, 0])[bit] += 1
        for gate in (0, 1):
            weights[gate] = [w + mixing._RATE / (gates[gate] + 64) * s for w, s in zip(weights[gate], steps[gate])]
        for cell, (zeros, ones) in met.items():
            refined[cell] += mixing._MAP_RATE * (ones - (zeros + ones) * refined[cell]) / (1 + mixing._MAP_RATE * (zeros + ones))
            refined[cell] = min(1 - 1e-4, max(1e-4, refined[cell]))
        at, size = end, min(8192, size * 4)
    return nats / math.log(10)


def test_score_matches_sequential_mixer():
    train = ["the cat sat on the mat. " * 30, "a dog, Übermut and 12 birds\n" * 9]
    lines = [mixing.symbols(t) for t in train]
    pairs = sum(map(mixing.pair_counts, lines))
    coder = mixing.Coder(pairs)
    trainer = mixing.Trainer(coder)
    for x in lines:
        trainer.add(x)
    mixer = mixing.Mixer(coder, mixing.stretched(np.concatenate(_settled(trainer, pairs))))
    for text in ("The cat sat on a dog. " * 60, "", None, "zq", "the birds " * 2000):
        score, n = mixer.score(text)
        assert n == len(mixing.symbols(text)) and score == pytest.approx(brute_score(coder, mixer.table, text), rel=1e-4)


def test_cut_off(spark):
    words = spark.createDataFrame([(f"w{i}".encode(), 1 + i % 40) for i in range(400)], "word binary, n long")
    for most in (0, 5, 100, 400):
        least = scoring.cut_off(words, most)
        assert words.filter(F.col("n") > least).count() <= most
    assert scoring.cut_off(words, 400) == 0 and scoring.cut_off(words.limit(0), 5) == 0


def _settled(trainer, pairs):
    trainer.settle()
    return [trainer.coder.order_one(pairs), *trainer.counts[1:]]


def test_first_order_counts_follow_from_pairs():
    lines = [mixing.symbols(t) for t in ("the cat sat. " * 9, "", "éa\n\n", None)]
    pairs = sum(map(mixing.pair_counts, lines))
    assert (mixing.pair_counts(*lines) == pairs).all()
    coder = mixing.Coder(pairs)
    expect = np.zeros(2 << mixing.SLOT_BITS[0], dtype=np.int64)
    for line in lines:
        for bits, slots in coder.segments(line):
            np.add.at(expect, slots[0].astype(np.int64) * 2 + bits, 1)
    assert (coder.order_one(pairs) == expect).all()


def test_scores(spark):
    texts = ["The cat, the Dog.", None, "", "the cat " * 400, "the dog unknown%d" % 1]
    rows = [(i, texts[i % len(texts)], 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in scoring.score_documents(df).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    total = sum(counts.values())
    for i, t, _ in rows:
        r, w = got[i], words(t)
        assert r.held_out == held(i) and r.n_tokens == len(w) and r.train_tokens == total and r.n_known == sum(x in counts for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w))
        assert r.score < 0
    assert scoring.score_documents(df.limit(0)).count() == 0


def one_by_one(coder, tables, start, text):
    """The score of a text by a mixer that learns after each decision, in plain Python."""
    line = mixing.symbols(text).tolist()
    past = [0] * mixing.PAST + line
    weights, refined = [list(map(float, w)) for w in start[0]], list(map(float, start[1]))
    nats = 0.0
    for at, symbol in enumerate(line):
        back = past[: at + mixing.PAST][::-1]
        pair = back[0] * mixing.SYMBOLS + symbol
        first = int(coder.offsets[pair])
        for path in coder.path[first : first + int(coder.lengths[pair])].tolist():
            x = []
            for order, size, table in zip(mixing.ORDERS, mixing.SLOT_BITS, tables):
                h = 0
                for i in range(order):
                    h = (h ^ (back[i] + 1 + i)) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 13
                x.append(int(table[(h * 0xC2B2AE35 + (path | 1) & 0xFFFFFFFF) >> (32 - size)]) / 8)
            bit, gate = path & 1, int(x[-1] != 0)
            z = min(7.99, max(-7.99, sum(w * v for w, v in zip(weights[gate], x))))
            p = 1 / (1 + math.exp(-z))
            cell = int((z + 8) * mixing._MAP / 16) + gate * mixing._MAP
            q = (refined[cell] + p) / 2
            nats += math.log(q if bit else 1 - q)
            weights[gate] = [w + mixing.STEP * (bit - p) * v for w, v in zip(weights[gate], x)]
            refined[cell] += mixing.MAP_STEP * (bit - refined[cell])
    return nats / math.log(10)


def _trained(texts):
    lines = [mixing.symbols(t) for t in texts]
    pairs = sum(map(mixing.pair_counts, lines))
    coder = mixing.Coder(pairs)
    trainer = mixing.Trainer(coder)
    for x in lines:
        trainer.add(x)
    return coder, _settled(trainer, pairs), lines


@pytest.mark.parametrize("alone", [0, 8])
def test_every_decision_is_learned_from(monkeypatch, alone):
    """Whatever the lanes, the scores are those of a sequential mixer with the learned start."""
    monkeypatch.setattr(mixing, "ALONE", alone)
    coder, counts, lines = _trained(["the cat sat on the mat. " * 30, "a dog, Übermut and 12 birds\n" * 9])
    start = mixing.learned_start(coder, counts, lines)
    assert np.abs(start[0] - mixing._START).max() > 1e-3 and np.abs(start[1] - mixing.fresh_map()).max() > 1e-3
    mixer = mixing.Mixer(coder, mixing.stretched(np.concatenate(counts)), start)
    texts = ["The cat sat on a dog. " * 60, "", "zq", "the birds " * 300, "", "a cat", "birds sat " * 40] * 3
    expect = {t: one_by_one(coder, mixer.table, start, t) for t in set(texts)}
    for lanes in (1, 2, 64):
        monkeypatch.setattr(mixing.Lanes.__init__, "__defaults__", (lanes,))
        got = dict(mixer.scores((i, mixing.symbols(t)) for i, t in enumerate(texts)))
        assert sorted(got) == list(range(len(texts)))
        assert all(got[i] == pytest.approx(expect[t], rel=1e-4) for i, t in enumerate(texts))
    # after the first decision already, unlike by blocks
    assert got[0] != pytest.approx(mixer.score(texts[0])[0], rel=1e-4)


def test_the_query_scores_one_decision_after_the_other(spark):
    """The score of every row is the sequential mixer's, not only near it."""
    texts = ["The cat sat on a DOG. " * 90, None, "", "Übermut, 12 birds\n\x00 \U0001f426 " * 40, "zq", "the cat sat on the mat. " * 900, "a\x7f\u0080"]
    rows = [(i, texts[i % len(texts)]) for i in range(60)] + [(3, "zq"), (None, "zq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    coder, counts, _ = _trained([t for i, t in rows if not scoring.is_held_out(i)])
    start = mixing.learned_start(coder, counts, scoring.start_lines(df))
    table = np.split(mixing.stretched(np.concatenate(counts)), np.cumsum([1 << b for b in mixing.SLOT_BITS])[:-1])
    expect = {t: one_by_one(coder, table, start, t) for t in texts}
    got = Counter((r.doc_id, round(r.score, 6)) for r in scoring.score_documents(df).collect())
    assert got == Counter((i, round(expect[t], 6)) for i, t in rows)


def test_counts_of_contexts_are_the_trainers(spark):
    """Counts that take one, two and four bytes, texts of several partitions, and no texts at all."""
    texts = ["a" * 70_000, "the cat sat on the mat. " * 40, "Übermut\n", "", None] * 3
    coder, expect, lines = _trained(texts)
    code = spark.sparkContext._jsc.broadcast(coder.packed())
    pairs = sum(map(mixing.pair_counts, lines))
    ids = [i for i in range(100) if not scoring.is_held_out(i)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for parts in (1, 4, 40):
        got = scoring.context_counts(df.repartition(parts), coder, code, pairs)
        assert len(got) == len(expect) and all((g == e).all() for g, e in zip(got, expect))
    assert max(e.max() for e in expect[1:]) > 1 << 16
    assert not any(g.any() for g in scoring.context_counts(df.limit(0), coder, code, pairs)[1:])


def test_start_values_leave_own_counts_out():
    """Random texts share no long context, so that order 5 earns no trust, though every text's own contexts are in the table."""
    rng = np.random.default_rng(8)
    strange = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(12)]
    coder, counts, lines = _trained(strange)
    start = mixing.learned_start(coder, counts, lines)
    mixer = mixing.Mixer(coder, mixing.stretched(np.concatenate(counts)), start)
    new = mixing.symbols("".join(map(chr, rng.integers(97, 123, 3000))))
    learned = next(mixer.scores([(0, new)]))[1]
    fixed = next(mixing.Mixer(coder, np.concatenate(mixer.table)).scores([(0, new)]))[1]
    assert learned > fixed
    # whole texts and beginnings of them, no texts at all
    assert np.isfinite(mixing.learned_start(coder, counts, [x[:700] for x in lines])[0]).all()
    assert (mixing.learned_start(coder, counts, [])[0] == mixing._START).all()


def test_a_lane_does_not_change_a_score(monkeypatch):
    """The place of a document among the lanes once cost its predictions their lowest bits, and with them cells of the map."""
    monkeypatch.setattr(mixing, "ALONE", 0)
    rng = np.random.default_rng(5)
    inputs = np.where(rng.random((3000, 4)) < 0.3, 0, rng.integers(-30, 31, (3000, 4))).astype(np.int8)
    document = rng.integers(0, 2, 3000).astype(np.int8), inputs.view(np.int32).reshape(-1)
    scores = dict(mixing.Lanes((mixing._START, mixing.fresh_map())).run((i, *document) for i in range(mixing.LANES)))
    assert len(scores) == mixing.LANES and len(set(scores.values())) == 1


def test_tasks_take_several_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text")
    for parts, tasks in ((1, 1), (cores, cores), (7 * cores, -(-7 * cores // scoring.SPLITS)), (3 * cores, 2 * cores)):
        taken = scoring._in_tasks(docs.repartition(parts))
        assert taken.rdd.getNumPartitions() == tasks and taken.count() == 1000


def test_new_plain_words_go_straight_to_the_model(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = type(encoder(path))(path)
    text = "One two THREE qzxwvkj " + "y" * 60 + " one two\nthree Straße x1 end. I"
    asked, simple = [], enc._simple
    monkeypatch.setattr(enc, "_simple", lambda p: asked.append(p) or simple(p))
    assert enc.ids(text) == enc.encode(text) == enc.ids(text)
    assert asked and not any(p.isalpha() for p in asked)
