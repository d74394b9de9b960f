"""Small tests of the operators on documents, against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import blocks, bpe, components, decontaminate, flac, lm_scoring, quality, secrets, simhash, suffixes
from ledgerline.llm.components import connected_components

from .conftest import SCHEMA, EXTRA, pairs, prose, rows

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- 1 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_codec():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_on_random_and_very_long_pre_tokens(reference_codec):
    r, own = random.Random(4), bpe.Codec(VOCABULARY, P.PATTERN)
    texts = ["".join(r.choice(" abeinrstno'é漢!1\n") for _ in range(r.randrange(60))) for _ in range(800)]
    for text in [*texts, "", "a" * 6000, "ab" * 20000, "é漢" * 900, " " * 999, "<|endoftext|>"]:
        ids = own.encode(text)
        assert ids == reference_codec.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_forgets_without_changing(reference_codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    own, text = bpe.Codec(VOCABULARY, P.PATTERN), prose(9, 80)
    assert own.encode(text) == own.encode(text) == reference_codec.encode_ordinary(text)
    assert len(own.known) <= 3 and len(own.known.older) <= 3


def test_bpe_documents(docs, no_docs, reference_codec):
    got = pairs(bpe.encode_documents(docs, VOCABULARY, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t, *_ in rows():
        ids = reference_codec.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(no_docs, VOCABULARY, P.PATTERN).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if bin(fps[x] ^ fps[y]).count("1") <= radius:
                parent[find(x)] = find(y)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [least.get(find(x)) for x in range(len(ids))]


def test_simhash_documents(docs, no_docs):
    table = rows()
    fps = [brute_fingerprint(r[1]) for r in table]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(table, fps, brute_components([r[0] for r in table], fps))]
    assert pairs(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_links_all_within_two_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 1, 2, 2, 3, 4) for _ in range(3)} | {0, 1 << 63, 3 << 62, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    component = dict(pairs(connected_components(found), "node", "root"))
    got = [component.get(f, f) for f in signed]
    want = brute_components(list(range(len(fps))), fps)
    groups = lambda c: {frozenset(i for i, x in enumerate(c) if x == k) for k in set(c)}
    assert groups(got) == groups(want)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (7, 6), (7, 6)]
    got = dict(pairs(connected_components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    base, r = [prose(k, 300).split() for k in range(100, 112)], random.Random(6)
    table = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base):
        copy = list(w)
        for _ in range(3):
            copy[r.randrange(300)] = "changed"
        table.append((100 + k, " ".join(copy)))
        table.append((200 + k, " ".join(w).upper()))
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in table], SCHEMA)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == list(range(12))


def test_near_copies_without_ids_and_empty(docs, no_docs):
    kept = [r[0] for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 7, 8, 9, 10, 11] and kept.count(None) == 1
    assert simhash.drop_near_copies(no_docs).count() == 0


def brute_near_copies(table, ratio=0.8):
    """Ids that go: all pairs by Jaccard, components, the least id of each stays."""
    sets = []
    for _, text in table:
        w = text.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(table)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= ratio * len(sets[x] | sets[y]) - 1e-9:
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(table):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i for k, (i, _) in enumerate(table) if least[find(k)] != i}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
    return words


@pytest.mark.parametrize("at_once", [1, 12])
def test_near_copies_among_forms_by_brute_force(spark, monkeypatch, at_once):
    """Frequent word pairs, a large group of near copies, pairs about the threshold, documents of common lines."""
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    r = random.Random(11)
    forms = [" ".join(f"item : {r.choice('abcdefgh')}{r.randrange(40)}" for _ in range(60)).split() for _ in range(120)]
    lines = [prose(k, 12).split() for k in range(500, 508)]
    texts = forms + [edited(r, forms[k], r.randrange(1, 5)) for k in range(60)] + [edited(r, forms[119], r.randrange(6)) for _ in range(40)]
    texts += [sum(r.sample(lines, 6), []) for _ in range(60)]
    r.shuffle(texts)
    table = [(k, " ".join(w)) for k, w in enumerate(texts)]
    gone = brute_near_copies(table)
    assert len(gone) > 60
    kept = simhash.drop_near_copies(spark.createDataFrame([(i, t, *EXTRA) for i, t in table], SCHEMA))
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, _ in table} - gone


def test_sets_travel_in_order():
    found = simhash.shingles(prose(9, 400))
    again = simhash.unpack_set(simhash.pack_set(found))
    assert (again == found >> np.uint64(16) << np.uint64(16)).all() and (np.diff(again.astype(np.float64)) > 0).all()
    assert len(simhash.unpack_set(simhash.pack_set(found[:0]))) == 0 and len(simhash.unpack_set(simhash.pack_set(found[:1]))) == 1


def test_near_copies_are_verified_on_distinct_shingles(spark):
    """Unlike texts with one repeated word stay; 80 of 100 shingles are enough and 79 of 101 are not."""
    dashes = [(k, prose(600 + k, 150) + " -" * 200) for k in range(3)]
    shared = prose(610, 94)
    pair = [(10, f"{shared} {prose(611, 0)}"), (11, f"{shared} {prose(612, 10)}"), (12, f"{shared} {prose(613, 23)}"), (13, shared.upper())]
    table = dashes + pair
    gone = brute_near_copies(table)
    assert gone == {11, 13} and simhash.similar(np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64)) and not simhash.similar(np.arange(79, dtype=np.uint64), np.arange(101, dtype=np.uint64))
    kept = simhash.drop_near_copies(spark.createDataFrame([(i, t, *EXTRA) for i, t in table], SCHEMA))
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, _ in table} - gone


# --- 3 ---------------------------------------------------------------------------------------------


def test_lm_counts_and_base_scores(docs, no_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 500)
    monkeypatch.setattr(blocks, "KEYS_PER_BUCKET", 1000)
    table = rows()
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t, *_ in table]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, *_ in table]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, h, t in zip(table, held, tokens)), key=repr)
    out = lm_scoring.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert lm_scoring.score(no_docs).count() == 0


def test_lm_scores_do_not_depend_on_packing(spark, docs, monkeypatch):
    monkeypatch.setattr(blocks, "KEYS_PER_BUCKET", 200)
    table = [(i, prose(700 + i % 17, 80) + " " + prose(800 + i, 20)) for i in range(120)] + [(r[0], r[1]) for r in rows()]
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = []
    for chars, parts in ((1 << 20, 1), (900, 3), (20_000, 7)):
        monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", chars)
        found.append(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.score(df.repartition(parts)).collect()), key=repr))
    assert found[0] == found[1] == found[2]


def test_lm_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_lm_seating_and_normalised_predictions():
    r = np.random.default_rng(2)
    words, contexts = 400, lm_scoring.CONTEXTS
    context, word = r.integers(0, 5, 1500), r.zipf(1.6, 1500) % words
    keys, counts = np.unique(word * contexts + context, return_counts=True)
    counts[np.argmax(counts)] = 500  # more than FIRST customers at once
    word, context = keys // contexts, keys % contexts
    seating = lm_scoring.Seating(counts, word, context, words, 0.6, 0.7, 1, 3)
    tables = seating.sample()
    assert (tables >= 1).all() and (tables <= counts).all() and (tables[counts == 1] == 1).all()
    assert (np.bincount(seating.dish, weights=seating.size, minlength=len(counts)) == counts).all()
    seen, customers = np.bincount(word, weights=counts, minlength=words), np.bincount(word, weights=tables, minlength=words)
    by = [np.bincount(context, weights=x, minlength=contexts) for x in (counts, tables)]
    model = lm_scoring.Predictive(int(counts.sum()), int((seen > 0).sum()), 0.6, 0.7, *by)
    parent = model.parent(seen, customers)
    assert abs(parent[seen > 0].sum() + model.unknown - 1) < 1e-9
    for k in (0, 3, 200):  # 200: a context never seen
        own = np.zeros(words)
        at = context == k
        own[word[at]] = counts[at] - 0.6 * tables[at]
        p = model.pairs(own, np.full(words, k), parent)
        assert abs(p[seen > 0].sum() + model.back[k] * model.unknown - 1) < 1e-9


def test_lm_resamples_frequent_words_too():
    """One dish of 20,000 customers, started with a table each: its tables come down to their mean under the model."""
    n, d = 20_000, 0.5
    seating = lm_scoring.Seating(np.array([n, 1]), np.array([0, 1]), np.array([0, 0]), 2, d, 0.5, 1, 4)
    seating._set(np.repeat([0, 1], [n, 1]), np.ones(n + 1, np.int64))
    for _ in range(60):
        seating.step()
    high = [seating.step() or seating.tables()[0] for _ in range(100)]
    seating.start()
    low = [seating.step() or seating.tables()[0] for _ in range(160)][60:]
    assert max(high) < n / 4 and abs(np.mean(high) / np.mean(low) - 1) < 0.3


def test_lm_beats_the_base_on_held_out_text(spark):
    r = random.Random(8)
    vocabulary = [prose(k, 1) for k in range(900)]
    table = [(i, " ".join(vocabulary[min(int(r.paretovariate(0.7)), 899)] for _ in range(60))) for i in range(120)]
    out = [x for x in lm_scoring.score(spark.createDataFrame(table, "doc_id long, text string")).collect() if x.held_out]
    assert len(out) > 5 and sum(x.score for x in out) > sum(x.base_score for x in out)


def test_lm_contexts_are_whole_words(spark):
    """What follows a word is learned of that word, not of all words that end alike."""
    table = [(i, ("ax c " if i % 2 else "bx d ") * 3) for i in range(100)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    table += zip(held, ("ax c", "ax d", "bx d", "bx c"))
    found = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found[held[0]] > found[held[1]] + 1 and found[held[2]] > found[held[3]] + 1


# --- 4 ---------------------------------------------------------------------------------------------


def slow_crc16(data):
    crc = 0
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ int(flac._CRC16[(crc >> 8) ^ b])
    return crc


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 2049])
def test_flac_crc(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert flac.crc16(data) == slow_crc16(data)


def test_flac_known_checksums():
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8


def test_flac_round_trips():
    r = np.random.default_rng(0)
    for x in (np.zeros(5000), r.integers(-128, 128, 10000), np.arange(9000) % 100 - 50, r.integers(-3, 3, 576), np.repeat([-128, 127], 3000), np.full(17, 5)):
        x = x.astype(int)
        assert (flac.decode(flac.encode(x)) == x).all()
        assert (flac.decode(flac.encode(x, lpc=([30, -12, 3], 4))) == x).all()
        for width, scale in ((12, 15), (16, 200), (20, 4000), (24, 60000)):
            assert (flac.decode(flac.encode(x * scale, width=width)) == x * scale).all()
            assert (flac.decode(flac.encode(x * scale, width=width, lpc=([30, -12, 3], 4))) == x * scale).all()
    many = r.integers(-128, 128, 300 * 16)
    media = flac.encode(many, block=16)
    assert (flac.decode(media) == many).all()
    offset, block = flac.seek(media, 4000)
    assert offset == 4000 and (block == many[4000:4016]).all()


#: A public sample stream: 24 samples of 8 bits, a linear predictor of order 3, four Rice partitions, checksums and MD5.
SAMPLE = bytes.fromhex("664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3")


def test_flac_reads_a_stream_of_another_encoder():
    assert flac.decode(SAMPLE).tolist() == [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]
    broken = bytearray(SAMPLE)
    broken[30] ^= 1
    with pytest.raises(ValueError, match="MD5"):
        flac.decode(bytes(broken))


def slow_linear(f):
    x = f.start.tolist()
    for r in f.residual.tolist():
        x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(f.coefficients)) >> f.shift))
    return np.array(x) << f.wasted


def test_flac_predictors_in_step_equal_one_by_one():
    r = np.random.default_rng(5)
    frames = [flac._Linear(r.integers(-99, 99, k), r.integers(-2000, 2000, k).tolist(), 12, r.integers(-50, 50, n), n % 3) for k, n in ((4, 900), (4, 3), (4, 900), (1, 10), (8, 77), (4, 1), (32, 100))]
    assert all((a == slow_linear(f)).all() for a, f in zip(flac._predicted(frames), frames))


def test_flac_store_uses_linear_predictors_and_seek_its_table(monkeypatch):
    raw = prose(5, 30_000).encode()
    media = flac.store(raw)
    stream = flac.Stream(media)
    contents = [c for *_, c in stream.frames(stream.first, 0)]
    assert sum(isinstance(c, flac._Linear) for c in contents) > len(contents) // 2
    whole = b"".join(b for _, b in flac.load([media])[0])
    assert whole == flac.pad(raw)
    read = []
    frame = flac.Stream.frame
    monkeypatch.setattr(flac.Stream, "frame", lambda self, at: read.append(at) or frame(self, at))
    for at in (0, 1, flac.SEEK_EVERY - 1, flac.SEEK_EVERY, 3 * flac.SEEK_EVERY + 5, len(whole) - 1):
        read.clear()
        offset, block = flac.seek(media, at)
        assert offset <= at < offset + len(block) and (block + 128).astype(np.uint8).tobytes() == whole[offset : offset + len(block)]
        assert len(read) <= flac.SEEK_EVERY // flac.BLOCK
    for at in (-1, len(whole)):
        with pytest.raises(IndexError):
            flac.seek(media, at)


def test_flac_damage_is_found():
    media = bytearray(flac.store(prose(1, 400).encode()))
    for at in (len(media) - 3, len(media) // 2, 200):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode(bytes(broken))
    with pytest.raises((ValueError, IndexError)):
        flac.decode(bytes(media[:-40]))


def test_flac_documents(docs, no_docs):
    got = flac.media_columns(docs, with_media=True).collect()
    assert len(got) == len(rows())
    texts = collections.defaultdict(set)
    for r in got:
        pcm = b"".join(b.pcm for b in r.blocks)
        assert [b.sample for b in r.blocks] == list(range(0, len(pcm), flac.BLOCK))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(pcm), sha(pcm), zlib.crc32(pcm[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), sha(bytes(r.media)))
        texts[pcm[: r.n_bytes]].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in texts.values())
    assert sorted(texts) == sorted({(t or "").encode() for _, t, *_ in rows()})
    assert flac.media_columns(no_docs).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------


def brute_repeats(table, w=200):
    seen = collections.Counter(raw[k : k + w] for _, t in table for raw in [(t or "").encode()] for k in range(len(raw) - w + 1))
    out = []
    for i, t in table:
        raw = (t or "").encode()
        marks = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - w + 1):
            if seen[raw[k : k + w]] > 1:
                marks[k] += 1
                marks[k + w] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), sha(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_documents(docs, no_docs, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 900)
    assert pairs(suffixes.remove_repeats(docs), *RESULT) == brute_repeats([r[:2] for r in rows()])
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_repeats_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(blocks, "KEYS_PER_BUCKET", 50)
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(4000))
    table = [(0, base[:1500]), (1, base[700:1100] + "x" + base[100:450]), (2, "ab" * 500), (3, "a" * 800), (4, base[:199]), (5, base[1500:1700]), (6, base[1400:1900]), (7, ("abcdefg" * 40)[:230]), (8, base[2000:2205] * 2), (9, "é" + base[2100:2400])]
    for i in range(10, 50):
        kind = r.randrange(3)
        if kind == 0:
            text = "".join((lambda a: base[a : a + r.randrange(150, 420)])(r.randrange(3500)) for _ in range(3))
        elif kind == 1:
            text = "".join(r.choice(["abc", "ab"]) * r.randrange(1, 100) for _ in range(4))
        else:
            chars = list(base[:1200])
            for _ in range(4):
                chars[r.randrange(1200)] = "#"
            text = "".join(chars)
        table.append((i, text))
    assert pairs(suffixes.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(3)), *RESULT) == brute_repeats(table)


# --- 7 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    r, good = random.Random(7), [prose(k, 1) for k in range(300)]
    table, labels = [], []
    for i in range(600):
        words = [r.choice(good) for _ in range(40)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            words = [w + "$$$" for w in words]
        if toxic:
            for _ in range(3):
                words[r.randrange(40)] = "slurword"
        table.append((i, " ".join(words), *EXTRA))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(1, None, None), (None, 1, 0), (99999, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(table, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_keeps_clean_and_rejects_the_rest(labelled):
    docs, labels = labelled
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    clean = {i for i in range(600) if i % 5 and i % 7}
    assert len(kept & clean) >= 0.97 * len(clean) and len(kept - clean) <= 0.05 * len(kept)
    accepted = quality.accept(docs, labels)
    assert accepted.columns == docs.columns and {r[0] for r in accepted.collect()} == kept


def test_quality_without_labels_or_documents(docs, no_docs, labelled):
    none = labelled[1].limit(0)
    assert {r.kept for r in quality.classify(docs, none).collect()} == {True}
    assert quality.accept(docs, none).count() == len(rows())
    assert quality.classify(no_docs, labelled[1]).count() == 0
    assert quality.classify(docs, labelled[1]).count() == len(rows())


def test_quality_draw_by_brute_force(labelled, spark):
    """Counts, ratios, threshold, keys and the draw by plain loops; the draw is not the threshold."""
    docs, labels = labelled
    table = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (7, "again"), (600, "")]
    good = {i: bool(i % 5 and i % 7) for i in range(1, 600, 2)} | {99999: True}
    fold = {r.doc_id: r.h % 5 == 0 for r in spark.createDataFrame([(i,) for i in good], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learned = [good[i] for i in good if not fold[i]]
    share = sum(learned) / len(learned)
    seen, own, target = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in table:
        for f in set(quality.features(t).tolist()):
            seen[f] += 1
            if i in good and not fold[i]:
                own[f] += 1
                target[f] += good[i]

    def ratios(features):
        for f in features:
            g, n, a, b = target[f], own[f], quality.STRENGTH * share, quality.STRENGTH * (1 - share)
            same = share**g * (1 - share) ** (n - g)
            other = math.exp(math.lgamma(g + a) + math.lgamma(n - g + b) - math.lgamma(n + a + b) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
            p = quality.DIFFERENT * other / (quality.DIFFERENT * other + (1 - quality.DIFFERENT) * same)
            yield f, 1 - p + p * (g + a) / ((n + a + b) * share)

    scale = sum(seen[f] * r for f, r in ratios(seen)) / sum(seen.values())

    def weight(text):
        logs = [math.log(r / scale) for _, r in ratios(set(quality.features(text).tolist()))]
        return quality.WORTH * sum(logs) / len(logs) if logs else 0.0

    held = collections.defaultdict(lambda: -math.inf)
    for i, t in table:
        if i in good and fold[i]:
            held[i] = max(held[i], weight(t))
    values = sorted(set(held.values()))
    cuts = [values[0] - 1, *((x + y) / 2 for x, y in zip(values, values[1:])), values[-1] + 1]
    of = lambda kind, c: [w >= c for i, w in held.items() if good[i] == kind]
    merit = [quality.CLEAN * sum(of(True, c)) / len(of(True, c)) - sum(of(False, c)) / len(of(False, c)) for c in cuts]
    threshold = cuts[max(range(len(cuts)), key=lambda k: merit[k])]
    weights = [weight(t) for _, t in table]
    noise = [-math.log(-math.log((xxhash.xxh64_intdigest((t or "").encode(), 7) + 0.5) / 2**64)) for _, t in table]
    keys = [w + g for w, g in zip(weights, noise)]
    least = sorted(keys, reverse=True)[sum(w >= threshold for w in weights) - 1]
    out = quality.classify(spark.createDataFrame(table, "doc_id long, text string").repartition(3), labels).collect()
    order = lambda rows_: sorted(rows_, key=lambda r: (repr(r[0]), r[1]))
    got = order((r.doc_id, r.log_weight, r.gumbel_key, r.kept) for r in out)
    for a, b in zip(got, order((i, w, k, k >= least) for (i, _), w, k in zip(table, weights, keys)), strict=True):
        assert a[0] == b[0] and a[1:3] == pytest.approx(b[1:3], abs=1e-3) and a[3] == b[3]
    assert sum(k >= least for k in keys) == sum(w >= threshold for w in weights)


def test_quality_draw_is_not_the_threshold():
    """Where weights lie close to the threshold some below it are drawn and some above are not."""
    model = quality.Model(np.zeros(quality.TABLE), 0.0)
    r = random.Random(4)
    weights = [r.gauss(0, 1) for _ in range(400)]
    keys = [model.key(f"text {k}", w) for k, w in enumerate(weights)]
    least = sorted(keys, reverse=True)[sum(w >= 0 for w in weights) - 1]
    assert any(k >= least and w < 0 for k, w in zip(keys, weights)) and any(k < least and w >= 0 for k, w in zip(keys, weights))


def test_kth_largest_is_exact(spark):
    r = random.Random(1)
    keys = [r.choice([r.gauss(0, 1e3), r.gauss(0, 1e-9), 0.0, -0.0, 5.0, 1e300, -1e300]) for _ in range(400)]
    df = spark.createDataFrame([(quality.ordered_bits(k),) for k in keys], "bits long")
    for k in (1, 7, 200, 400):
        assert quality.kth_largest(df, k) == quality.ordered_bits(sorted(keys, reverse=True)[k - 1])
    assert quality.kth_largest(df, 0) is None and quality.kth_largest(df, 401) is None


# --- 9 ---------------------------------------------------------------------------------------------


def brute_contamination(table, items):
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {(j, tuple(w[k : k + 10])) for j, t in items for w in [low(t)] if w for k in range(max(1, len(w) - 9))}
    out = []
    for i, t in table:
        w, hit, found = low(t), set(), set()
        for j, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(j)
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return sorted(out, key=repr)


COLUMNS9 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [250_000, 7])
def test_decontamination(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    a = rows()[0][1].split()
    items = [(100, " ".join(a[20:45]).upper()), (9, "One, two!"), (10, None), (11, "..."), (12, " ".join(a[30:38])), (13, "é漢字 ß x"), (14, " ".join(a[20:45])), (15, prose(55, 30))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute_contamination([r[:2] for r in rows()], items)
    assert pairs(decontaminate.decontaminate(docs, benchmark), *COLUMNS9) == want
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and sorted((r[0] for r in clean.collect()), key=repr) == sorted((r[0] for r in want if not r[5]), key=repr)
    assert decontaminate.decontaminate(no_docs, benchmark).count() == 0
    assert not any(r[5] for r in pairs(decontaminate.decontaminate(docs, benchmark.limit(0)), *COLUMNS9))


# --- 10 --------------------------------------------------------------------------------------------


def brute_base(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base_by_brute_force():
    r = random.Random(2)
    bits = ["password", "PassWD", "secret", "ToKen", "api_key", "apikey", "AKIA", "akia", "ABCDEF123", "0123456789abcdef", ":", "=", " ", '"', "'", "x", "é漢", "K", "ſecret", "\n", "api", "_key", "tokentoken=", "f" * 31]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        assert [(a, k, b) for k, a, b in secrets.scan(text) if k < 3] == brute_base(text), text


def test_secrets_checksums():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    token = "ghp_" + body + secrets.base62_crc(body)
    kinds = lambda t: [secrets.KINDS[k] for k, _, _ in secrets.scan(t)]
    assert kinds(f"x {token} y") == ["ghtoken"] and kinds(f"x {token[:-1]}{'0' if token[-1] != '0' else '1'} y") == []
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert kinds("card 4111 1111 1111 1111") == ["card"] and kinds("card 4111 1111 1111 1112") == []


def test_secrets_documents(docs, no_docs):
    out = secrets.scan_documents(docs).collect()
    names = ("assign", "access", "hex")
    for r, t in ((r, t) for r in out for i, t, *_ in rows() if i == r.doc_id):
        base = brute_base(t or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base))
    assert len(out) == len(rows()) and secrets.scan_documents(no_docs).count() == 0
    clean = secrets.redact(docs)
    assert clean.schema == docs.schema and clean.count() == len(rows())
    row = clean.where("doc_id = 11").first()
    assert row.text == "[SECRET] token=short [SECRET] [SECRET]" and row.n_chars == len(row.text)
    assert all(not brute_base(r.text or "") for r in clean.collect())
