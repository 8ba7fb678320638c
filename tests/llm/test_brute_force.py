"""Operators against plain versions on small tables, exact round trips, and held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

from corpusmill.llm import langid, linededup, mixing, pii, quality, simhash, tiffpages, tokenids, warczip
from corpusmill.llm.arrowtext import RollingHash, mix, runs


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_trie_join_links_as_all_pairs_do(monkeypatch):
    rng = np.random.default_rng(0)
    for leaf in (1, 4, 64):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        base = rng.integers(0, 2**63, 20, dtype=np.uint64)
        key = base[rng.integers(0, 20, 400)]
        for _ in range(6):
            key = np.where(rng.random(400) < 0.6, key ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), key)
        key = np.unique(key)
        group = rng.integers(0, 3, len(key))
        i, j = simhash.TrieJoin(group, key).run()
        near = (np.bitwise_count(key[:, None] ^ key[None]) <= 4) & (group[:, None] == group[None])
        assert components(len(key), zip(i, j, strict=True)) == components(len(key), zip(*np.nonzero(near), strict=True))


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, documents, rows, monkeypatch):
    got = {r.doc_id: r for r in simhash.report(documents).collect()}
    ids = sorted(got)
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    assert all(got[i].fingerprint == f"{prints[i]:016x}" for i in ids)
    links = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4]
    assert [got[i].component_id for i in ids] == [ids[c] for c in components(len(ids), links)]


def test_simhash_hot_groups_and_parts(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(10)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(3)) for b in base for _ in range(15)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = components(len(values), [(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 4])
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for parts, hot in ((5, 5), (6, 50_000)):
        monkeypatch.setattr(simhash, "parts_for", lambda n, budget=4, p=parts: p)
        edges = [(signed.index(r.a), signed.index(r.b)) for r in simhash.links(df, hot=hot).collect()]
        assert components(len(values), edges) == want
    labels = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for v, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(labels.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_token_ids(documents, rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = {r.doc_id: r for r in tokenids.encode_and_report(documents, public_tokenizers.path("word_bpe_49k.json")).collect()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), tokenids.ids_crc32(ids))
        start += len(ids)


def test_pieces_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenids, "MEMORY_BYTES", 100_000)
    definition = open(public_tokenizers.path("word_bpe_49k.json")).read()
    t, e, rng = Tokenizer.from_str(definition), tokenids.Encoder(definition), random.Random(1)
    alphabet = [*"abzABZ019'.,!-_ \t\n\r\x0b\x0c\x1c\x00\x85\xa0éÉßİıK—…’̸́ 中文한가😀½²٣ⅣΣς", "'s", "'re", "'LL", "<|endoftext|>", "<|x|>", "<|startoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)]
    out = []
    for a, b, buf, offsets in runs(pa.array(texts), 1 << 14):
        ids, at = e.encode(buf, offsets)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    assert out == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files_find_documents(spark, documents, tmp_path):
    path = f"{tmp_path}/tokens"
    tokenids.write_token_files(documents, path, public_tokenizers.path("word_bpe_49k.json"), files=3)
    assert {r.doc_id for r in tokenids.find_documents(spark, path, [5, 17]).collect()} == {5, 17}
    ids = [r.doc_id for r in tokenids.read_token_files(spark, path).orderBy("start").collect()]
    assert ids == sorted(ids)


def test_lines(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    base = [rng.sample(words, rng.randint(1, 20)) for _ in range(30)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice([" ".join(w), " ".join(w), "", " \t"])

    docs = {i: "\n".join(line() for _ in range(rng.randint(0, 8))) for i in range(150)}
    seen, want = [], {}
    for d in sorted(docs):
        want[d] = []
        for i, x in enumerate(docs[d].split("\n")):
            s = frozenset(x.encode().lower().split())
            if s and not any(5 * len(s & y) >= 4 * len(s | y) for y in seen):
                want[d].append(str(i))
            if s:
                seen.append(s)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in linededup.report(df).collect()} == {d: ",".join(k) for d, k in want.items()}
    # Hot buckets in shards, long lists in blocks, rows split small, open classes' tokens sent and joined.
    table = linededup.classes(df)
    counts = spark.sparkContext.broadcast(linededup.rarity(table))
    kept = {(d, int(k)) for d, x in want.items() for k in x}
    monkeypatch.setattr(linededup, "PER_ROW", 16)
    stored = linededup._blocks(table, counts)[0]
    assert linededup._grouped(stored, 30).where("sharded").count() > 0
    for hot, limits, sent in ((30, (8, 4, 16), 1000), (30, (8, 2, 8), 0), (100_000, (4, 2, 4), 0)):
        gone = {(r.d, r.l) for r in linededup.matched_classes(table, counts, hot, limits, sent).collect()}
        assert {(r.d, r.l) for r in table.where("n > 0").collect()} - gone == kept


def test_first_pass_leaves_classes_open(spark, monkeypatch):
    """Near misses whose sketches collide fill a class's first pairs: its match is found in the second pass."""
    rng = random.Random(8)
    stem = [f"s{i}" for i in range(30)]
    lines = [" ".join([*stem[:26], *rng.sample([f"x{i}" for i in range(60)], 4)]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    table = linededup.classes(df)
    counts = spark.sparkContext.broadcast(linededup.rarity(table))
    sets = [frozenset(x.split()) for x in lines]
    matched = {i for i, x in enumerate(sets) if any(5 * len(x & y) >= 4 * len(x | y) and x != y for y in sets[:i])}
    first = {r.d for r in table.where("n > 0").collect()}
    monkeypatch.setattr(linededup, "FIRST", 1)
    for hot, sent in ((20_000, 1000), (40, 0)):
        assert {r.d for r in linededup.matched_classes(table, counts, hot, (8, 4, 16), sent).collect()} == matched & first


def test_long_lists_lose_no_match(monkeypatch):
    """A line and its only match lie at the two ends of a list, each beside a near miss whose sketch collides: the pair is met, or the line marked.

    In this process, as workers import the module anew.
    """

    def hashed(word):
        return RollingHash(np.frombuffer(word.encode(), np.uint8)).of(np.array([0]), np.array([len(word)]))

    same = [w for w in (f"z{i}" for i in range(10_000)) if int(mix(hashed(w) + np.uint64(77))[0] >> np.uint64(58)) == 5]
    b, c, z = [f"b{i}" for i in range(16)], same[:4], same[4:20]
    others = [[f"f{i}x{j}" for j in range(20 + i % 3)] for i in range(60)]
    sets = [["rare", *b, *z[6:13]], ["rare", *b, *z[3:6]], ["rare", *b, *z[:3], *c], *(["rare", *x] for x in others), ["rare", *b, *z[:3]]]
    matches = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})}
    assert matches == {(len(sets) - 1, 2)}
    # Rarity orders prefixes: "rare", then c, z and b; the line and its match share only "rare" of theirs.
    counts = np.full(1 << linededup.COUNT_BITS, 100, np.uint32)
    for n, words in ((1, ["rare"]), (10, c), (20, z), (30, b)):
        for w in words:
            counts[linededup._bucket(hashed(w))] = n
    texts = pa.record_batch([pa.array(range(len(sets)), pa.int64()), pa.array([" ".join(x) for x in sets])], names=["d", "text"])
    lines = [x.select(["d", "l", "k", "n", "line"]) for x in linededup._line_rows(iter([texts]))]
    met = pa.Table.from_batches(linededup._posting_rows(counts, iter(lines)))
    met = met.add_column(6, "probe", pa.array([True] * len(met))).combine_chunks().to_batches()
    for large, block, step in ((2048, 512, 2048), (8, 2, 8), (8, 4, 16), (16, 3, 5)):
        for name, value in (("LARGE", large), ("BLOCK", block), ("STEP", step)):
            monkeypatch.setattr(linededup, name, value)
        got = pa.Table.from_batches(linededup._pair_partition(False, iter(met)), schema=linededup._PAIRS).to_pylist()
        assert matches <= {(r["d1"], r["d2"]) for r in got} or any(r["more"] and r["d1"] == len(sets) - 1 for r in got)


def test_mix_takes_targets(spark, documents):
    got = mixing.report(documents).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken <= 3 * r.size
    for (_, target), docs in by.items():
        assert abs(sum(r.taken for r in docs) - target) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(documents.repartition(7)).collect()))


def test_schedule_spreads_sources(spark, documents):
    sizes = mixing.sized(documents)
    sources = mixing.quotas(mixing.targets(sizes), 16)
    quota = {r.idx: r.quota for r in sources.collect()}
    slots = mixing.schedule(sources, 16).collect()
    ranks = {}
    for s in slots:
        ranks.setdefault(s.idx, []).append(s["rank"])
    assert {i: sorted(x) for i, x in ranks.items()} == {i: list(range(q)) for i, q in quota.items() if q}
    total = sum(quota.values())
    half = [s for s in slots if s.slot < total / 2]
    assert all(abs(sum(s.idx == i for s in half) - q / 2) <= 6 for i, q in quota.items())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn, "phone": lambda: 10 <= len(digits) <= 15}[kind]()

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_spans(spark):
    rng = random.Random(5)
    parts = ["a", "Z", "9", "1", "0", "4", "25", "255", "192.168.0.1", ".", "-", " ", "  ", "@", "+", "_", "%", "(", ")", "\n", "é", "😀", "\x01", "\x02", "$", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "a.b@c.de", "/"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)] + ["1." * 5000, "a" * 20000, "a@b." * 5000 + "c", "+1(" * 5000, "x@y.zz, " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.report(df).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) or not spans
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]


def test_tiff_round_trips():
    rng = random.Random(3)
    for n in [*range(0, 700, 37), 4000, 65536 * 4 + 1, (1 << 20) + 5]:
        for x in (bytes(rng.choices(b"ab \n", k=n)), rng.randbytes(n), b"a" * n):
            p = tiffpages.payload_of(x)
            assert b"".join(q.samples for q in tiffpages.read_tiff(tiffpages.write_tiff(p))) == p
    for n in (1, 5, 300, 5000, 40000):
        for x in (bytes(rng.choices(b"ab", k=n)), rng.randbytes(n)):
            assert tiffpages.unlzw(tiffpages.lzw(x), n) == x and tiffpages.unpackbits(tiffpages.packbits(x), n) == x


def test_tiff_reads_big_endian_tiles_with_differences():
    rows = np.arange(32 * 48, dtype=np.uint8).reshape(32, 48)
    tiles = []
    for y in (0, 16):
        for x in (0, 32):
            tile = np.zeros((16, 32), np.uint8)
            part = rows[y : y + 16, x : x + 32]
            tile[: part.shape[0], : part.shape[1]] = part
            tiles.append(tiffpages.lzw(tiffpages._differences(tile).tobytes()))
    out, at = bytearray(b"MM\0*\0\0\0\0"), []
    for t in tiles:
        at.append(len(out))
        out += t
    lists = len(out)
    out += struct.pack(">4I4I", *at, *map(len, tiles))
    struct.pack_into(">I", out, 4, len(out))
    tags = [(256, 4, 1, 48), (257, 4, 1, 32), (258, 3, 1, 8 << 16), (259, 3, 1, 5 << 16), (277, 3, 1, 1 << 16), (317, 3, 1, 2 << 16), (322, 4, 1, 32), (323, 4, 1, 16), (324, 4, 4, lists), (325, 4, 4, lists + 16)]
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    (page,) = tiffpages.read_tiff(bytes(out))
    assert page.samples == rows.tobytes()


def test_tiff_digest_and_pages(spark, documents, rows):
    got = {r.doc_id: r for r in tiffpages.report(documents).collect()}
    media = tiffpages.materialize(tiffpages.to_media(documents), "t")
    pages = {}
    for p in tiffpages.pages_of(media).collect():
        pages.setdefault(p.doc_id, []).append(p)
    for r in rows:
        p, g = tiffpages.payload_of(r.text.encode()), got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(r.text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        file = tiffpages.write_tiff(p)
        assert (g.media_bytes, g.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert b"".join(bytes(x.samples) for x in sorted(pages[r.doc_id], key=lambda x: x.page)) == p
        mean = sum(p) / len(p)
        deviation = (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5
        entropy = -sum(n / len(p) * math.log2(n / len(p)) for n in Counter(p).values()) + 0.0
        changes = sum(p[i] != p[i - 1] for i in range(len(p)) if i % 64)
        assert g.feature == f"pages={len(pages[r.doc_id])};mean={mean:.4f};deviation={deviation:.4f};entropy={entropy:.4f};distinct={len(set(p))};changes={changes}"


def test_every_coding_has_its_share(spark, documents):
    """PackBits, LZW with differencing and deflate, in strips and in tiles, whatever a text's size."""
    codings = Counter((p.coding, p.predictor) for p in tiffpages.pages_of(tiffpages.to_media(documents)).collect())
    assert set(codings) == {(32773, 1), (5, 2), (8, 1)} and min(codings.values()) > 0.2 * sum(codings.values())
    sizes = {}
    for r in documents.collect():
        p = tiffpages.payload_of(r.text.encode())
        sizes.setdefault(zlib.crc32(p) & 3, []).append(len(p))
    assert len(sizes) == 4 and all(min(x) < 2000 < max(x) for x in sizes.values())


def test_lzw_writer_agrees_with_a_plain_one():
    """Codes put bit by bit, widths kept up to date code by code."""

    def plain(data):
        out, table, after, width, held = "", {}, 258, 9, None
        put = lambda code, w: format(code, f"0{w}b")
        out += put(256, 9)
        for b in data:
            if held is None:
                held = (b,)
            elif held + (b,) in table:
                held += (b,)
            else:
                out += put(table[held] if len(held) > 1 else held[0], width)
                table[held + (b,)] = after
                after, held = after + 1, (b,)
                if after == (1 << width) - 1 and width < 12:
                    width += 1
                elif after >= 4094:
                    out += put(256, width)
                    table, after, width = {}, 258, 9
        if held is not None:
            out += put(table[held] if len(held) > 1 else held[0], width)
            after += 1
            if after == (1 << width) - 1 and width < 12:
                width += 1
        out += put(257, width)
        out += "0" * (-len(out) % 8)
        return int(out, 2).to_bytes(len(out) // 8, "big")

    rng = random.Random(9)
    for n in (0, 1, 2, 300, 700, 5000, 60_000):
        for x in (bytes(rng.choices(b"ab", k=n)), rng.randbytes(n), b"z" * n):
            assert tiffpages.lzw(x) == plain(x)


class InMemory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def test_zip_directories(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a/é.txt", b"stored")
        z.writestr("b", b"x" * 1000, zipfile.ZIP_DEFLATED)
    data = path.read_bytes()
    members = warczip.directory(InMemory(data))
    method, at, packed, real = members["a/é.txt"]
    assert (method, data[at : at + packed], real) == (0, b"stored", 6) and members["b"][0] == 8


def test_zip64_directory(monkeypatch, tmp_path):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(4):
            z.writestr(f"m{k}", bytes([65 + k]) * 50)
    data = path.read_bytes()
    assert b"PK\6\6" in data
    members = warczip.directory(InMemory(data))
    assert [data[at : at + n] for _, at, n, _ in members.values()] == [bytes([65 + k]) * 50 for k in range(4)]


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_quality_held_out(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels")
    rows = quality.report(read("documents"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = sorted(r.score for r in rows if r.quality == 1), [r.score for r in rows if r.quality == 0]
    auc = np.mean([(len(good) - np.searchsorted(good, s, "right") + len(good) - np.searchsorted(good, s, "left")) / 2 / len(good) for s in bad])
    assert auc >= 0.95


def _grams(text):
    low = "".join(c.lower() if c <= "\xde" and c != "\xd7" else c for c in text)  # letters A-Z and those of Latin-1
    low = re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", low).encode()
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def test_language_scores_are_kernel_ridge_regression(documents):
    """Scores of the folded product against kernels of plain sets of n-grams, all of them, and a plain solution of the ridge system."""
    rows = [(r.text, r.lang) for r in documents.limit(60).collect()]
    model = langid.fit(rows, landmarks_per_language=5)
    marks = [i for i, (_, lang) in enumerate(rows) if sum(x == lang for _, x in rows[: i + 1]) <= 5]
    grams = [_grams(t) for t, _ in rows]
    near = np.array([[len(a & grams[m]) / np.sqrt(len(a) * len(grams[m])) for m in marks] for a in grams])
    among = near[marks]
    goal = np.array([[float(lang == x) for x in model.languages] for _, lang in rows])
    w = 1 / np.array([sum(x == lang for _, x in rows) for _, lang in rows], float)
    alpha = np.linalg.solve(near.T @ (near * w[:, None]) + langid.RIDGE * among + 1e-8 * np.eye(len(marks)), near.T @ (goal * w[:, None]))
    held = [r.text for r in documents.offset(60).limit(40).collect()] + ["zzq xqj qqq", "Ω"]
    for t in held:
        k = np.array([len(_grams(t) & grams[m]) / np.sqrt(len(_grams(t)) * len(grams[m])) for m in marks]) @ alpha
        e = np.exp(langid.SHARPNESS * (k - k.max()))
        np.testing.assert_allclose(model.shares(*langid._flat([t]))[0], e / e.sum(), atol=1e-4)


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, ("der hund lief über die straße " if i % 2 else "the cat sat on the mat ") * 1000, "de" if i % 2 else "en") for i in range(1, 60)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]


def test_many_short_texts_need_little_memory(documents):
    import tracemalloc

    model = langid.fit([(r.text, r.lang) for r in documents.collect()])
    texts = pa.record_batch([pa.array(range(10_000), pa.int64()), pa.array(["", "a"] * 5000)], names=["doc_id", "text"])
    tracemalloc.start()
    n = sum(x.num_rows for x in langid._score_rows(model, iter([texts])))
    assert n == 10_000 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_mix_follows_the_golden_ratio(spark, documents):
    """Blocks in the order of points k / phi mod 1 through the cumulative quotas, by a plain loop; the mixed documents and their words come in that order."""
    sizes = mixing.sized(documents)
    sources = sorted(mixing.quotas(mixing.targets(sizes), 64).collect(), key=lambda r: r.idx)
    total, low, parts = sum(r.quota for r in sources), 0, []
    for r in sources:
        parts.append((r.idx, low * mixing.POINTS // total, (low + r.quota) * mixing.POINTS // total))
        low += r.quota
    served, want = dict.fromkeys((r.idx for r in sources), 0), []
    for k in range(total):
        point = k * mixing.GOLDEN % mixing.POINTS
        idx = next(i for i, a, b in parts if a <= point < b)
        served[idx] += 1
        if served[idx] <= sources[idx].quota:
            want.append((k, idx, served[idx] - 1))
    for r in sources:
        for rank in range(served[r.idx], r.quota):  # behind the last point
            want.append((max(total, want[-1][0] + 1), r.idx, rank))
    got = sorted((s.slot, s.idx, s["rank"]) for s in mixing.schedule(mixing.quotas(mixing.targets(sizes), 64), 64).collect())
    assert got == sorted(want)
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in documents.collect()}
    blocks = mixing.blocks(documents, block_words=64).collect()
    assert [(b.slot, b["at"]) for b in blocks] == sorted((b.slot, b["at"]) for b in blocks)
    taken = {r.doc_id: r.taken for r in mixing.report(documents).collect()}
    read, position = dict.fromkeys(words, 0), dict.fromkeys(words, 0)
    for b in blocks:
        read[b.doc_id] += len(b.text.split(" "))
    assert read == taken
    for d, n in taken.items():  # each time, a document's words come whole and in order
        own = [w for b in blocks if b.doc_id == d for w in b.text.split(" ")]
        assert sorted(own) == sorted((words[d] * 3)[:n]) or not n
    first = {}
    for b in blocks:
        first.setdefault(b.doc_id, b.slot)
    order = [r.doc_id for r in mixing.mix(documents).collect()]
    slots = {r.doc_id: r.first_slot for r in mixing.report(documents).collect()}
    firsts = [slots[d] for d in dict.fromkeys(order)]
    assert firsts == sorted(firsts) and len(order) == sum(-(-n // len(words[d])) for d, n in taken.items() if n)
