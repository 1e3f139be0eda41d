import re

import corpus_pipeline
from graphloom.llm import common, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, SF), name)
        seen.append(name)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            continue
        assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            sets = [frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows.values()]
            assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "private_data":
            assert len(rows) == before.count()
            old = "\n".join(r.text for r in before.collect())
            new = "\n".join(r.text for r in rows.values())
            private = r"\d+\.\d+\.\d+\.\d+|[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}"
            assert not set(re.findall(private, old)) & set(re.findall(private, new))
    assert len(seen) == 5


def test_run_matches_brute_force(spark):
    """The whole pipeline against all pairs, all windows and the plain tokenizer."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm import decontaminate, pii, quality

    docs = common.table(spark, SF, "documents")
    good = {r.doc_id: r.text for r in quality.keep_good(spark, docs, SF).collect()}
    ids = sorted(good)
    sets = {d: frozenset(simhash.shingle_hashes(good[d], 5).tolist()) for d in ids}
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    kept = [d for d in ids if root(d) == d]
    items = [t.lower().split() for (t,) in common.table(spark, SF, "benchmark").select("text").collect()]
    clean = []
    for d in kept:
        words = good[d].lower().split()
        held = False
        for item in items:
            weights = Counter(decontaminate._shingles([w.encode() for w in item], 5))
            for k in range(max(0, len(words) - len(item)) + 1):
                window = [w.encode() for w in words[k : k + len(item)]]
                if not held and window and set(map(bytes, window)) & set(w.encode() for w in item):
                    held = decontaminate.weighted_similarity(Counter(decontaminate._shingles(window, 5)), weights) >= 0.8
        if not held:
            clean.append(d)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    hidden = {r.doc_id: r.text for r in pii.hide_private(spark, docs.filter(docs.doc_id.isin(clean)), SF).collect()}
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert sorted(pieces) == clean
    for d, own in pieces.items():
        data = np.array(tokenizer.encode(hidden[d], add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        own.sort(key=lambda r: r.start)
        assert sum(r.length for r in own) == len(data) // 4 == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) for r in own)
