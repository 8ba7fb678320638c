"""The whole pipeline against a plain version of each stage, and the rows that stages give for hard inputs."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import xxhash
from test_brute_force import _grams, components, fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import langid, mixing, tokenids

SF = "/root/testdata/sf0.001"


def identified(docs, model):
    code = {}  # a gram's text by its number
    for text in (r.text or "" for r in docs):
        symbols, at = langid._symbols(*langid._flat([text]))
        for _, gram in langid._grams(symbols, at):
            code.update(dict.fromkeys(gram.tolist()))
    weight = dict(zip(model.grams.tolist(), model.weights.astype(float), strict=True))
    kept = []
    for r in docs:
        symbols, at = langid._symbols(*langid._flat([r.text or ""]))
        grams = {int(g) for _, gram in langid._grams(symbols, at) for g in gram}
        assert len(grams) == len(_grams(r.text or ""))
        score = sum((weight[g] for g in grams if g in weight), np.zeros(len(model.languages))) / math.sqrt(max(len(grams), 1)) * langid.SHARPNESS
        share = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        if any(c.isalpha() for c in r.text or "") and share.max() >= langid.LEAST_SCORE:
            kept.append(r)
    return kept


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def clean(docs, items):
    windows = {tuple(w[i : i + 13]) for t in items for w in [words_of(t or "")] for i in range(max(1, len(w) - 12) if w else 0)}
    sizes = {len(w) for w in windows}
    kept = []
    for r in docs:
        w = words_of(r.text or "")
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def mixed(docs):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    size = {r.doc_id: len(split(r.text)) for r in docs}
    names = sorted({r.source for r in docs})
    total = {s: sum(size[r.doc_id] for r in docs if r.source == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left = {}, sum(total.values())
    while True:  # sources that would pass three times their size stop there, the rest is shared anew
        open_ = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] > 3 * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
    out = []
    for s in names:
        take, at = math.floor(target[s] + 0.5), 0
        own = sorted((r for r in docs if r.source == s and size[r.doc_id]), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest())
        while take > 0:
            r = own[at % len(own)]
            out.append((r.doc_id, r.text if take >= size[r.doc_id] else " ".join(split(r.text)[:take])))
            take, at = take - size[r.doc_id], at + 1
    return out


def test_pipeline_is_what_plain_stages_give(spark, documents):
    docs = sorted(documents.collect(), key=lambda r: r.doc_id)
    kept = identified(docs, langid.learn(documents))
    prints = [fingerprint(r.text or "") for r in kept]
    links = [(a, b) for a in range(len(kept)) for b in range(a + 1, len(kept)) if (prints[a] ^ prints[b]).bit_count() <= 4]
    kept = [r for i, (r, c) in enumerate(zip(kept, components(len(kept), links), strict=True)) if i == c]
    kept = clean(kept, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert 0 < len(kept) < len(docs)
    rows = mixed(kept)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    t, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], signed(r[1]))):
        ids = [*t.encode(text, add_special_tokens=False).ids, tokenids.END_ID]
        want.append((doc_id, start, len(ids), tokenids.ids_crc32(ids)))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want


def test_stages_of_hard_rows(spark, hard, tmp_path):
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i))
    # Rows 1 and 8, and both rows 7, are equal; rows 2, 3 and 4 have no words.
    assert ids(stage["near_duplicates"](spark, hard, str(tmp_path))) == [1, 2, 5, 6, 7, None]
    assert ids(stage["benchmark_decontamination"](spark, hard, str(tmp_path))) == [2, 3, 4, 5, 6, 7, 7, None]
    assert {2, 3, 4}.isdisjoint(ids(stage["language_id"](spark, hard, str(tmp_path))))
    mixed_ids = ids(stage["mix_sources"](spark, hard, str(tmp_path)))
    assert {2, 3, 4}.isdisjoint(mixed_ids) and mixed_ids.count(1) <= 3
    tokens = stage["token_ids"](spark, hard, str(tmp_path)).collect()
    assert len(tokens) == 10 and {r.doc_id: r.n_tokens for r in tokens}[2] == 1
