from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwork.llm import bloom, buckets, buffers, components, edit_distance, edit_embedding, exact_dedup, langid, mixing, mixing_lm, ngram_join, packing, quality, rows, sketches, toxicity, warc
from shelfwork.llm.queries import tokenizer_path
from shelfwork.llm.storage import fold, stash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(vocabulary)) for _ in range(n))


# --- buffers ---------------------------------------------------------------------------------------------------------


def test_words_and_shingles_are_those_of_single_texts():
    texts = ["A b  c d e F", "", None, " x ", "a b c d e f", "a b c d e", "é\x0bü", "a b", "b a", "a", "b"]
    for first, end, data, at in buffers.blocks(pa.array(texts)):
        w = buffers.Words(data, at)
        assert [len(WORD.findall(t or "")) for t in texts[first:end]] == w.per_row.tolist()
        assert [w.text(i).decode() for i in range(len(w.start))] == [x for t in texts for x in WORD.findall(lower(t))]
        hashes, per = buffers.shingles(w)
        sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(per)[:-1])]
        assert per.tolist() == [2, 0, 0, 1, 2, 1, 1, 1, 1, 1, 1]
        assert sets[0] == sets[4] and sets[5] < sets[4]
        assert len({frozenset(s) for s in sets[6:]}) == 5
        ids = [x[0] for x in (buffers.sequence_hash(w)[0][i : i + 1] for i in range(len(texts)))]
        assert ids[0] == ids[4] and len(set(ids)) == len(texts) - 2


def test_hashes_tell_thue_morse_words_apart():
    """Polynomials modulo 2 ** 64 don't, whatever the base."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    texts = [word, other, " ".join(word), " ".join(other)]
    (_, _, data, at), = buffers.blocks(pa.array(texts))
    w = buffers.Words(data, at)
    assert w.hash[0] != w.hash[1]
    assert all(x[2] != x[3] for x in buffers.sequence_hash(w))


@pytest.mark.parametrize("what", ["words", "quality", "near", "packing", "edit"])
def test_memory_for_a_long_text_is_bounded(what):
    """A text of some megabytes is worked on in no more than some times its size."""
    import tracemalloc

    rng = random.Random(1)
    data = np.frombuffer((prose(rng, 20_000) + " ")[: 80_000].encode() * (10 if what == "edit" else 60), np.uint8)
    at = np.array([0, len(data)])
    packing.encoder(tokenizer_path())
    tracemalloc.start()
    if what == "words":
        buffers.Words(data, at)
    elif what == "quality":
        quality.features(data, at)
    elif what == "near":
        hashes, per = buffers.shingles(buffers.Words(data, at))
        ngram_join.paths(hashes, per)
    elif what == "packing":
        packing.encoder(tokenizer_path()).encode(data, at)
    else:
        edit_embedding.fingerprints([data.tobytes().decode()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(data) + (32 << 20)


# --- op2 -------------------------------------------------------------------------------------------------------------


def test_fingerprints_combine():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = exact_dedup.chunk_hash(data)
    for cut in (0, 1, 64, 4999):
        assert exact_dedup.combine(exact_dedup.chunk_hash(data[:cut]), exact_dedup.chunk_hash(data[cut:])) == whole
    assert exact_dedup.fingerprint(data, 100) == exact_dedup.fingerprint(data, 999) == whole
    assert exact_dedup.chunk_hash(np.zeros(2, np.uint8)) != exact_dedup.chunk_hash(np.zeros(3, np.uint8))


def _dedup_by_hand(docs):
    groups = {}
    for r in docs.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: -math.inf if i is None else i)
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out)


def test_exact_dedup(odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    assert Counter((r.doc_id, r.keep_id if r.doc_id is not None or r.keep_id is not None else None, r.group_size, r.text_sha256) for r in got) == _dedup_by_hand(odd)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_dedup(empty).count() == 0


def _short_vectors(basis):
    """Lenstra-Lenstra-Lovasz reduction in exact numbers, for small lattices."""
    n, b = len(basis), [list(map(Fraction, v)) for v in basis]
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))

    def orthogonal():
        star, mu = [], [[Fraction(0)] * n for _ in range(n)]
        for i in range(n):
            v = list(b[i])
            for j in range(i):
                mu[i][j] = dot(b[i], star[j]) / dot(star[j], star[j])
                v = [x - mu[i][j] * y for x, y in zip(v, star[j], strict=True)]
            star.append(v)
        return star, mu

    star, mu = orthogonal()
    k = 1
    while k < n:
        for j in range(k - 1, -1, -1):
            if q := round(mu[k][j]):
                b[k] = [x - q * y for x, y in zip(b[k], b[j], strict=True)]
                star, mu = orthogonal()
        if dot(star[k], star[k]) >= (Fraction(3, 4) - mu[k][k - 1] ** 2) * dot(star[k - 1], star[k - 1]):
            k += 1
        else:
            b[k], b[k - 1] = b[k - 1], b[k]
            star, mu = orthogonal()
            k = max(k - 1, 1)
    return [[int(x) for x in v] for v in b]


def _collision(n=13):
    """Two different texts of small letters with one fingerprint."""
    (p, q), (r, t) = exact_dedup.PRIMES, exact_dedup.BASES
    both = [(pow(r, i, p) * q * pow(q, -1, p) + pow(t, i, q) * p * pow(p, -1, q)) % (p * q) for i in range(n)]
    rows_ = [[p * q] + [0] * (n - 1)] + [[-both[i]] + [int(i == j) for j in range(1, n)] for i in range(1, n)]
    for v in _short_vectors(rows_):
        v = v[::-1]  # the first weighs the power 0
        if any(v) and max(map(abs, v)) <= 25:
            return "".join(chr(97 + max(x, 0)) for x in v), "".join(chr(97 + max(-x, 0)) for x in v)
    raise AssertionError("no short vector")


def test_texts_of_one_fingerprint_are_told_apart(make):
    """A real collision: the texts meet, differ, and keep rows of their own."""
    one, two = _collision()
    a, b = (exact_dedup.fingerprint(np.frombuffer(x.encode(), np.uint8)) for x in (one, two))
    assert a == b and one != two
    docs = make([(1, one), (2, two), (3, one.upper()), (4, two), (5, "else"), (6, "else"), (7, one + "x")])
    base = exact_dedup.fingerprints(docs)
    groups = base.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.collect_set("crc").alias("crcs")).where("n > 1").select(F.explode("crcs").alias("crc"), "n_bytes", "n")
    assert {(r.fp, r.n_bytes) for r in exact_dedup.colliding(docs, groups).collect()} == {(exact_dedup._key(*a[:2]), len(one))}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (3, 2, False), 2: (4, 2, False), 3: (3, 2, True), 4: (4, 2, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True)}
    apart = [make([(k, x) for k, x in enumerate(texts)]).coalesce(1) for texts in ([one, two], [two] * 3 + [one] * 3)]
    for d in apart:  # also where they meet in one batch
        assert exact_dedup.exact_dedup(d).where("kept").count() == 2


def test_long_texts_are_hashed_in_chunks(make):
    rng = random.Random(9)
    long = prose(rng, 400, 99) + " " + "Ab1 " * 700_000
    docs = make([(1, long), (2, long.upper()), (3, long + "."), (4, "Ab1 "), (5, long)])
    assert len(long) > 2 * exact_dedup.LONG
    base = {r.doc_id: r for r in exact_dedup.fingerprints(docs).collect()}
    for i, text in ((1, long), (3, long + "."), (4, "Ab1 ")):
        a, b, n = exact_dedup.fingerprint(np.frombuffer(lower(text).encode(), np.uint8))
        assert (base[i].fp, base[i].n_bytes) == (exact_dedup._key(a, b), n)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (5, 3), 2: (5, 3), 5: (5, 3), 3: (3, 1), 4: (4, 1)}


def test_texts_of_one_key_are_compared(spark):
    rows_ = [(i, 1, 4, p, data, False) for i, parts in enumerate([(b"ab", b"cd")] * 40 + [(b"ab", b"cX")]) for p, data in enumerate(parts)]
    parts = spark.createDataFrame([(*r[:4], bytearray(r[4]), r[5]) for r in rows_], exact_dedup._PART)
    inside = stash(exact_dedup._compared(parts, exact_dedup.SALTS), "t")
    assert exact_dedup._compared(inside, 1).where("differs").count() >= 1
    same = spark.createDataFrame([(*r[:4], bytearray(b"q"), False) for r in rows_], exact_dedup._PART)
    assert exact_dedup._compared(exact_dedup._compared(same, exact_dedup.SALTS), 1).where("differs").count() == 0


def test_the_filter_knows_its_keys(spark):
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 2000)
    table = bloom.gather(spark.createDataFrame([(int(k),) for k in keys[:1000]], "k bigint"))
    assert bloom.maybe(table, keys[:1000]).all() and bloom.maybe(table, keys[1000:]).mean() < 0.01


# --- op3 -------------------------------------------------------------------------------------------------------------


def _sets(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _classes_by_hand(docs):
    table = [(r.doc_id, WORD.findall(lower(r.text)), _sets(r.text)) for r in docs.collect()]
    n = len(table)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = table[i][2], table[j][2]
            if i != j and a and b:
                if table[i][1] == table[j][1]:
                    root[find(i)] = find(j)
                elif len(a & b) * 5 >= len(a | b) * 4:
                    links[i].add(tuple(table[j][1]))
                    root[find(i)] = find(j)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(table[i][0])
    return Counter((table[i][0], min((x for x in members[find(i)] if x is not None), default=None), len(links[i]), len(members[find(i)])) for i in range(n))


def _found(docs):
    return Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in ngram_join.ngram_join(docs).collect())


def test_ngram_join_against_all_pairs(make, monkeypatch):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    docs = make(list(enumerate(texts)))
    assert _found(docs) == _classes_by_hand(docs)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)  # components are dealt to pairs of blocks
    assert _found(docs) == _classes_by_hand(docs)


def test_ngram_join_odd(odd, empty):
    assert _found(odd) == _classes_by_hand(odd)
    got = ngram_join.ngram_join(odd)
    assert got.where("kept").count() == got.select("class_id", F.when(F.col("class_size") == 1, F.col("row_hash"))).distinct().count()
    assert ngram_join.ngram_join(empty).count() == 0


def test_depth_is_shortened_until_the_recall_is_met():
    assert ngram_join.depth_for(0.8, 0.0) == ngram_join.MAX_DEPTH
    d = ngram_join.depth_for(0.8, 0.995)
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= 0.995 > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def test_texts_of_few_shingles_stay_at_greater_depth():
    for n in range(1, 40):  # by trying all sizes of the other set and of what both share
        every = [i / (n + m - i) for m in range(1, 60) for i in range(1, min(n, m) + 1) if i * 5 >= (n + m - i) * 4]
        assert ngram_join.least_similarity(n) == pytest.approx(min(every))
    found = ngram_join.depths((4, 5), 0.995)
    assert found[0] == 8 and found[1] == found[3] == 10 and found[4] == 8 and found[6] == 10
    words = buffers.Words(np.frombuffer(b"a a a a a a a b c d e f", np.uint8), np.array([0, 15, 15, 23]))
    hashes, per = buffers.shingles(words)
    assert ngram_join._stops(hashes, per, found).tolist() == [found[len(set(hashes[: per[0]].tolist()))], found[1]]


def test_prefixes_of_paths_are_those_of_signatures():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, 50, dtype=np.uint64)]
    sets += [np.concatenate([sets[0][:48], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for _ in range(30)]
    got = ngram_join.paths(np.concatenate(sets), np.array([len(x) for x in sets]))
    least = np.stack([((x >> np.uint64(32)).astype(np.uint32)[:, None] * ngram_join._A[None] ^ ngram_join._B[None]).min(axis=0) for x in sets]).reshape(len(sets), ngram_join.TREES, -1)
    for depth in (8, 9, 10):
        same = (least[:, None, :, :depth] == least[None, :, :, :depth]).all(axis=3)
        prefix = got >> np.uint64(8 * (10 - depth))
        assert (same <= (prefix[:, None] == prefix[None])).all() and (same == (prefix[:, None] == prefix[None])).mean() > 0.99
    assert (got.view(np.int64) >= 0).all()


def test_links_between_strangers_of_a_head_are_found(make):
    """A crowd that shares half of its words, with near copies inside it and a hot class beside them."""
    rng = random.Random(11)
    common = prose(rng, 90, 5000).split()
    texts = []
    for _ in range(60):
        own = common + prose(rng, 40, 5000).split()
        texts += [" ".join(own), " ".join(own[:-1] + ["other"])]
    texts += [" ".join([*common, *common[:20], f"copy{i}"]) for i in range(60)]
    docs = make(list(enumerate(texts)))
    assert _found(docs) == _classes_by_hand(docs)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (105, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 105: 100}
    assert components.components(edges.limit(0)).count() == 0


# --- op4 -------------------------------------------------------------------------------------------------------------


def _archive(n=6):
    return [warc.member(warc.record(i, f"http://x/{i}", p := f"<p>{i}</p>".encode() * 50, warc.digest(p), None)) for i in range(n)]


def _ids(data):
    return [warc._number(x[5]["warc-record-id"]) for x in warc.salvage(data) if x[0] == "record"]


def _gaps(data):
    return [(x[1], x[2], x[5]) for x in warc.salvage(data) if x[0] == "gap"]


def _inner(data):
    """(id, or reason of a gap; offsets inside the member)."""
    return [(warc._number(x[5]["warc-record-id"]) if x[0] == "record" else x[5], x[3], x[4]) for x in warc.salvage(data)]


def test_salvage_recovers_what_follows_damage():
    parts = _archive()
    at = np.cumsum([0, *map(len, parts)]).tolist()
    clean = b"".join(parts)
    assert _ids(clean) == list(range(6)) and not _gaps(clean)
    hurt = bytearray(clean)
    hurt[at[2] + 40] ^= 0xFF
    assert _ids(bytes(hurt)) == [0, 1, 3, 4, 5]
    assert [(a, b) for a, b, _ in _gaps(bytes(hurt))] == [(at[2], at[3])]
    assert _ids(clean[: at[5] + 30]) == [0, 1, 2, 3, 4] and _gaps(clean[: at[5] + 30])[0][:2] == (at[5], at[5] + 30)
    junk = clean[: at[3]] + b"some junk" + clean[at[3] :]
    assert _ids(junk) == list(range(6)) and _gaps(junk)[0][:2] == (at[3], at[3] + 9)
    both = bytearray(clean)
    both[at[2] + 40] ^= 0xFF
    both[at[3] + 40] ^= 0xFF
    assert _ids(bytes(both)) == [0, 1, 4, 5]
    assert _ids(b"\x1f\x8b\x08" + clean) == _ids(b"\x00" * 9 + clean) == list(range(6))


def _records(n, kinds="response"):
    return [warc.record(i, "u", p := f"<p>{i}</p>".encode() * (20 + i), warc.digest(p), 7 if kinds == "revisit" else None) for i in range(n)]


def test_salvage_goes_on_inside_a_member():
    """A member of several records, of which the second is damaged, then another member."""
    one = _records(4)
    bad = one[1].replace(b"<p>1</p>", b"<q>1</q>", 1)
    content = one[0] + bad + one[2]
    data = gzip.compress(content) + gzip.compress(one[3])
    a, b, c = len(one[0]), len(one[0]) + len(bad), len(content)
    assert _inner(data) == [(0, 0, a), ("digest", a, b), (2, b, c), (3, 0, len(one[3]))]
    # two damaged ones in a row are one gap; a length that reaches beyond the member swallows nothing
    wrong = re.sub(rb"Content-Length: \d+", b"Content-Length: 99999999", one[2])
    data = gzip.compress(one[0] + bad + wrong + one[3])
    assert _inner(data) == [(0, 0, a), ("digest", a, b + len(wrong)), (3, b + len(wrong), b + len(wrong) + len(one[3]))]
    assert _inner(gzip.compress(b"junk" + one[0] + b"WARC/1")) == [("head", 0, 4), (0, 4, 4 + a), ("head", 4 + a, 10 + a)]


def test_salvage_of_a_member_whose_checks_fail():
    """Payloads with right digests count; records without one, and what comes after the damage, don't."""
    one, visit = _records(3), _records(1, "revisit")[0]
    content = one[0] + visit + one[1]
    broken = bytearray(gzip.compress(content))
    broken[-6] ^= 1
    a, b, c = len(one[0]), len(one[0]) + len(visit), len(content)
    assert _inner(bytes(broken) + gzip.compress(one[2])) == [(0, 0, a), ("crc", a, b), (1, b, c), (2, 0, len(one[2]))]
    rng = random.Random(3)
    pages = [rng.randbytes(5000) for _ in range(6)]
    member = gzip.compress(b"".join(warc.record(i, "u", p, warc.digest(p), None) for i, p in enumerate(pages)))
    cut = member[: len(member) * 2 // 3] + gzip.compress(one[2])
    assert _ids(cut)[-1] == 2 and _ids(cut)[:3] == [0, 1, 2]
    short = member[: len(member) // 2]
    assert _ids(short) == [0, 1] and _gaps(short)[-1][2] in ("truncated", "length")
    events = list(warc.salvage(cut))
    assert [x[1] for x in events] == sorted(x[1] for x in events)


@pytest.mark.parametrize("seed", range(30))
def test_salvage_never_fails_and_covers_the_file(seed):
    """Random damage: no record is made up or given twice, what is untouched is recovered, and what is left out is logged."""
    rng = random.Random(seed)
    parts = [gzip.compress(b"".join(warc.record(10 * k + i, "u", p := rng.randbytes(rng.randrange(300)), warc.digest(p), None) for i in range(rng.randrange(1, 4)))) for k in range(6)]
    hit = rng.sample(range(6), 2)
    hurt = []
    for k, part in enumerate(parts):
        part = bytearray(part)
        if k in hit:
            at = rng.randrange(len(part))
            part = rng.choice([part[:at], part[:at] + rng.randbytes(3) + part[at + 3 :], part[:at] + part[at + 5 :]])
        hurt.append(bytes(part))
    data, ids = b"".join(hurt), _ids(b"".join(hurt))
    assert len(ids) == len(set(ids)) and ids == sorted(ids) and set(ids) <= set(_ids(b"".join(parts)))
    safe = [k for k in range(6) if k not in hit]
    assert {i for i in ids if i // 10 in safe} == {i for i in _ids(b"".join(parts)) if i // 10 in safe}
    outer = [(x[1], x[2]) for x in warc.salvage(data) if x[2] is not None]
    assert all(b <= c for (_, b), (c, _) in zip(outer, outer[1:], strict=False))
    if len(ids) < len(_ids(b"".join(parts))):
        assert any(x[0] == "gap" for x in warc.salvage(data))


def test_a_large_member_is_read_piece_by_piece():
    """48 MB of content, of which one record at a time is held."""
    import tracemalloc

    p = bytes(1 << 20)
    record = warc.record(1, "u", p, warc.digest(p), None)
    data = gzip.compress(record * 48, 1)
    tracemalloc.start()
    n = sum(x[0] == "record" for x in warc.salvage(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 48 and peak < 40 << 20


def test_salvage_of_plain_files_checks_digest_and_length():
    one = [warc.record(i, "u", p := f"body {i}".encode(), warc.digest(p), None) for i in range(4)]
    assert _ids(b"".join(one)) == [0, 1, 2, 3]
    assert _ids(b"".join([one[0], one[1].replace(b"body 1", b"BODY 1"), one[2]])) == [0, 2]
    assert _ids(b"".join([one[0], one[1].replace(b"Content-Length: 6", b"Content-Length: 9"), one[2]])) == [0, 2]
    assert _ids(b"\x00" * 7 + one[3]) == [3]


def test_members_end_in_a_zero_byte():
    for n in (0, 10, 1 << 24, (1 << 24) + 5):
        m = warc.member(b"x" * n)
        assert m[-1] == 0
        one = warc.Member(m, 0)
        assert sum(map(len, one.pieces())) == n and one.bad is None


def test_heads_of_any_length(spark):
    """An address of some megabytes comes back; garbage behind a version line is left at once."""
    url = "http://x/" + "y" * (2 << 20)
    got = {r.page_id: r.payload_bytes for r in warc.round_trip(spark.createDataFrame([(1, url, "one"), (2, "u", "two!")], "page_id long, url string, html string")).collect()}
    assert got == {1: 3, 2: 4}
    whole = warc.member(warc.record(1, url, b"one", warc.digest(b"one"), None))
    assert [x[5]["warc-target-uri"] for x in warc.salvage(whole) if x[0] == "record"] == [url]
    held = bytearray(b"WARC/1.1\r\nname: value\r\nno field\r\n" + b"z" * 100)
    assert warc._first(held, False) == "head" and warc._first(held[:26], False) == "more"
    for k in range(1, 26):
        assert warc._first(held[:k], False) == "more"


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>", 5), (2, "http://b\r\nx", "<p>é</p>", 5), (3, None, None, 5), (4, "u", "", 5), (5, "u", "WARC/1.0\r\n\r\n\x1f\x00\x08" * 900, 5), (5, "u", "other", 5), (None, "n", "void", 5)], "page_id bigint, url string, html string, digest int")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keep = {}
    for r in pages.collect():
        keep[r.html or ""] = max(keep.get(r.html or "", -1), r.page_id if r.page_id is not None else -1)
    want = {(r.page_id, len((r.html or "").encode()), sha(r.html), "response" if r.page_id in (None, keep[r.html or ""]) else "revisit", None if r.page_id in (None, keep[r.html or ""]) else keep[r.html or ""]) for r in pages.collect()}
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, least=100).where("payload_bytes < 100").collect()} == {"response"}


# --- op5 -------------------------------------------------------------------------------------------------------------


def _base_by_hand(docs, training):
    tokens = lambda t: [*WORD.findall(lower(t)), "\0end"]
    c = Counter(x for r in training.collect() for x in tokens(r.text))
    n, v = sum(c.values()), len(c)
    return Counter((r.doc_id, len(tokens(r.text)), sum(x in c for x in tokens(r.text)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(r.text)), 6)) for r in docs.collect())


def test_base_score(odd):
    learn = F.col("doc_id").isin(1, 4, 6, 7, 9)
    got = mixing_lm.score(odd, learn).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == _base_by_hand(odd, odd.where(learn))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    for r in got:
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_without_training_every_bit_is_a_coin(odd, empty):
    got = {r.doc_id: r.score for r in mixing_lm.score(odd, F.lit(False)).collect()}
    for r in odd.collect():
        assert got[r.doc_id] == pytest.approx(-8 * math.log10(2) * (len((r.text or "").encode()) + 1), rel=1e-6)
    assert mixing_lm.score(empty, F.lit(True)).count() == 0


def _by_hand(training, texts, weights, refined):
    """log10 of the probability of texts: every count by looking through the training texts, a bit at a time."""
    coded = lambda t: b"\xff" * 6 + lower(t).encode() + b"\xff"
    seen = [(c[k - 6 : k], c[k]) for c in map(coded, training) for k in range(6, len(c))]
    out = []
    for text in map(coded, texts):
        total = 0.0
        for k in range(6, len(text)):
            for bit in range(8):
                x, gate = np.zeros(8, np.float32), 0
                for order in range(7):
                    own = [b for c, b in seen if c[6 - order :] == text[k - order : k] and b >> (8 - bit) == text[k] >> (8 - bit)]
                    n1 = np.float32(sum(b >> (7 - bit) & 1 for b in own))
                    value, often = mixing_lm.stretched(np.float32(len(own)) - n1, n1)
                    x[order] = value
                    gate = 4 * order + int(often) if len(own) else gate
                x[7] = 0.3
                z = float(weights[gate].astype(np.float32) @ x)
                p = 1 / (1 + math.exp(-min(14, max(-14, z))))
                n0, n1 = refined[text[k] >> (8 - bit) | 1 << bit, int(min(32, max(0, np.rint((z + 8) * 2))))]
                p = min(1 - 1e-6, max(1e-6, 0.5 * p + 0.5 * (n1 + 8 * p) / (n0 + n1 + 8)))
                total += math.log10(p if text[k] >> (7 - bit) & 1 else 1 - p)
        out.append(total)
    return out


def test_scores_are_those_of_counting_by_hand(make):
    texts = ["Abcab abcab!", "abcabcab", "", "xyz abc", "été abc"]
    docs = make(list(enumerate(texts)))
    learn = F.col("doc_id") < 3
    layout = mixing_lm.Layout()
    merged = mixing_lm.counts(docs, learn, layout)
    _, weights, refined = mixing_lm.train(merged, layout)
    got = {r.doc_id: r.score for r in mixing_lm.score(docs, learn).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(_by_hand(texts[:3], texts, weights, refined), rel=1e-5)


def test_learning_leaves_out_what_occurs():
    """Of a sequence that was counted once, nothing is left in the contexts that it alone has."""
    keys = np.sort(np.concatenate([code for _, code in mixing_lm.Stream([b"abcdefgh", b"zbcdefgh"]).windows()]))
    distinct, n = mixing_lm.counted(keys)
    last = mixing_lm.unhashed(distinct >> np.uint64(32))
    cell = (last >> np.uint64(8) << np.uint64(8) | distinct & np.uint64(255)).astype(np.int64)
    small = np.bincount(cell, weights=n, minlength=1 << 24).astype(np.float32)
    model = mixing_lm.Model(small)
    for _, _, x, gate in model.inputs(distinct, n, apart=True):
        once = (n == 1) & (last != (0xFFFFFF))
        assert (gate[n == 2] > 4 * 3).all()  # seen once more, in the other text
        assert (x[once, 6] == 0).all()


def test_learning_improves_the_mixture(make):
    rng = random.Random(5)
    docs = make([(i, prose(rng, 80, 30)) for i in range(40)])
    learn = F.col("doc_id") < 30
    layout = mixing_lm.Layout()
    merged = mixing_lm.counts(docs, learn, layout)
    shared, weights, refined = mixing_lm.train(merged, layout)
    rows = merged.where(F.col("part") < layout.first_word).toArrow()
    first, last = mixing_lm.Model(mixing_lm._unpacked(shared)), mixing_lm.Model(mixing_lm._unpacked(shared), weights, refined)
    unseen = [0.0, 0.0]
    for batch in rows.to_batches():
        for keys, n in mixing_lm._sequences(batch):
            for k, model in enumerate((first, last)):
                unseen[k] += model.log10(keys, n)[n == 0].sum()
    assert unseen[1] > unseen[0]


def test_probabilities_of_a_context_sum_to_one(make):
    rng = random.Random(3)
    texts = [prose(rng, 60, 9).encode() for i in range(30)]
    # every byte after one context, counted or not
    seen = np.concatenate([code for _, code in mixing_lm.Stream(texts).windows()])
    head = seen[1000] >> np.uint64(8)
    keys, n = mixing_lm.counted(seen)
    one = (keys >> np.uint64(32)) == (seen[1000] >> np.uint64(32))
    every = (head << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    keys, n = mixing_lm.added([keys[one], every], [n[one], np.zeros(256, np.int64)])
    rng = np.random.default_rng(0)
    model = mixing_lm.Model(rng.integers(0, 3, 1 << 24).astype(np.float32), rng.normal(0, 0.3, (mixing_lm.GATES, mixing_lm.INPUTS)), rng.random((256, mixing_lm.BUCKETS, 2)))
    assert (10 ** model.log10(keys, n)[np.isin(keys, every)]).sum() == pytest.approx(1, abs=1e-5)


def test_streams_are_those_of_single_texts(monkeypatch):
    """Codes, sums and words in small windows; a text of several windows; blocks of several megabytes stay bounded."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(40), 9).encode() if i % 5 else b"" for i in range(60)] + [prose(rng, 3000).encode()]
    want = []
    for t in texts:
        padded = b"\xff" * 6 + t + b"\xff"
        for k in range(6, len(padded)):
            c = [padded[k - j] for j in range(1, 7)]
            want.append((int(mixing_lm.hashed(np.array([c[0] << 16 | c[1] << 8 | c[2]], np.uint64))[0]) << 32) | c[3] << 24 | c[4] << 16 | c[5] << 8 | padded[k])
    monkeypatch.setattr(mixing_lm, "WINDOW", 257)
    stream = mixing_lm.Stream(texts)
    got, sums = [], np.zeros(len(texts))
    for first, code in stream.windows():
        assert first == len(got)
        got += code.tolist()
        stream.sums(first, (code & np.uint64(255)).astype(np.float64), sums)
    assert got == want
    assert sums.tolist() == [sum(t) + 255 for t in texts]
    per, hashes = np.zeros(len(texts), np.int64), []
    for row, n, h in mixing_lm._words(texts):
        per[row : row + len(n)] += n
        hashes += h.tolist()
    assert per.tolist() == [len(t.split()) for t in texts] and len(hashes) == per.sum()
    assert mixing_lm.unhashed(mixing_lm.hashed(np.arange(0, 1 << 24, 97, dtype=np.uint64))).tolist() == list(range(0, 1 << 24, 97))


def test_packs_and_lookups():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    assert (mixing_lm.unpacked_keys(mixing_lm.packed_keys(keys), len(keys)) == keys).all()
    look = mixing_lm.Lookup(keys, np.arange(len(keys)))
    assert (look(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    parts = list(mixing_lm.Layout().split(keys, 0))
    assert [p for p, _ in parts] == sorted({int(k) >> 46 for k in keys.tolist()}) and parts[-1][1].stop == len(keys)
    hot = mixing_lm.Layout(12, np.unique(keys >> np.uint64(32))[::7])
    parts = list(hot.split(keys, 0))
    assert sum(len(keys[at]) for _, at in parts) == len(keys) and [p for p, _ in parts] == sorted({p for p, _ in parts})
    values = keys.astype(np.float64)
    assert (hot.in_order(keys, np.concatenate([values[at] for _, at in parts])) == values).all()
    assert hot.first_hot == 4096 < max(p for p, _ in parts) < hot.first_word <= min(p for p, _ in hot.split(keys, 1))


def test_parts_grow_with_the_text_and_change_no_score(make):
    """Crowded contexts are split over parts; each sequence has the same probability, each text the same counts."""
    rng = random.Random(6)
    docs = make([(i, prose(rng, 60, 20)) for i in range(30)] + [(70, None), (71, "the the the the"), (71, "the the the the")])
    learn = F.col("doc_id") % 3 > 0
    plain, many = mixing_lm.laid_out(docs), mixing_lm.laid_out(docs, part_bytes=40, seen=8)
    assert plain.bits == mixing_lm.LEAST_BITS and len(plain.hot) == 0 and len(many.hot) > 5
    assert mixing_lm.laid_out(docs, part_bytes=4).bits > mixing_lm.LEAST_BITS
    merged = mixing_lm.counts(docs, learn, plain)
    shared, weights, refined = mixing_lm.train(merged, plain)
    model = mixing_lm.Model(mixing_lm._unpacked(shared), weights, refined)

    def values(table, layout):
        out, rows = {}, 0
        for batch in table.where(F.col("part") < layout.first_word).toArrow().to_batches():
            for (keys, n), third in zip(mixing_lm._sequences(batch), mixing_lm._thirds(batch), strict=True):
                out |= dict(zip(keys.tolist(), zip(n.tolist(), model.log10(keys, n, third).tolist(), strict=True), strict=True))
                rows += 1
        return out, rows

    a, few = values(merged, plain)
    b, more = values(mixing_lm.counts(docs, learn, many), many)
    assert a.keys() == b.keys() and more > few + 20
    assert all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-5 for k in a)
    got, want = ({(r.doc_id, r.n_bytes): r for r in mixing_lm.score(docs, learn, layout).collect()} for layout in (many, plain))
    for k, r in want.items():
        assert (got[k].n_known, got[k].n_tokens, got[k].train_tokens) == (r.n_known, r.n_tokens, r.train_tokens)
        # weights are learnt in another order, from few texts
        assert abs(got[k].base_score - r.base_score) < 1e-9 and abs(got[k].score - r.score) < 0.15 * abs(r.score) + 1


def test_a_long_text_among_others_is_scored(make):
    """A text of several megabytes, in blocks and windows of its own."""
    rng = random.Random(2)
    long = " ".join(prose(rng, 400, 50) for _ in range(1500))
    docs = make([(1, long), (2, "abc def"), (3, long[:1000])])
    got = {r.doc_id: r for r in mixing_lm.score(docs, F.col("doc_id") == 1).collect()}
    assert got[1].n_bytes == len(long) + 1 > 2_500_000 and got[1].n_tokens == len(long.split()) + 1
    assert got[3].bits_per_byte < 4 < got[2].bits_per_byte * 3


# --- op6 -------------------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_texts(make):
    rng = random.Random(5)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèüßabcd"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    docs = make([(i, text(k, rng.randrange(3, 200)), k) for i, k in enumerate(rng.choice(list(letters)) for _ in range(300))])
    model = langid.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and sum(found[r.doc_id][0] == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for _, s in found.values())


def test_language_id_odd(odd, empty):
    model = langid.train(odd)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert {i for i, p in got.items() if p == "und"} == {3, 4, 5, 9}
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_predictions_are_those_of_convolving_by_hand(make):
    """Each filter at each place of each window of a text, in plain loops."""
    rng = random.Random(4)
    model = langid.ByteCNN(["aa", "bb", "cc"], seed=2)
    model.bias = np.random.default_rng(1).normal(0, 0.2, model.bias.shape).astype(np.float32)
    texts = ["ab", "été", prose(rng, 120), prose(rng, 90) + "!"]
    got = langid.identify(make(list(enumerate(texts))), model).collect()
    stride, width = langid.WINDOW - max(langid.WIDTHS) + 1, max(langid.WIDTHS)
    for r in got:
        data, total, size = texts[r.doc_id].encode(), np.zeros(3), 0
        for first in range(0, max(1, len(data) - width + 1), stride):
            window = data[first : first + langid.WINDOW]
            padded = window + bytes(langid.WINDOW - len(window))
            best = [-math.inf] * len(model.bias)
            for at in range(langid.WINDOW - width + 1):
                for f in range(len(best)):
                    k = langid.WIDTHS[f // langid.FILTERS]
                    value = sum(float(model.embed[padded[at + j]] @ model.filters[j * langid.EMBED : (j + 1) * langid.EMBED, f]) for j in range(k))
                    best[f] = max(best[f], value)
            z = np.maximum(np.array(best) + model.bias, 0) @ model.out + model.out_bias
            total += (z - np.log(np.exp(z).sum())) * len(window)
            size += len(window)
        p = np.exp(total / size)
        p /= p.sum()
        assert r.lang_pred == model.classes[int(p.argmax())] and r.score == pytest.approx(p.max(), rel=1e-4)


def test_windows_cover_whole_texts():
    data = np.arange(1, 1001, dtype=np.int64).astype(np.uint8)
    x, row, size = langid.windows(data, np.array([0, 3, 3, 1000]))
    assert row.tolist() == [0] + [2] * (len(row) - 1)
    seen = bytes(x[1, : size[1]]) + b"".join(bytes(w[max(langid.WIDTHS) - 1 : s]) for w, s in zip(x[2:], size[2:], strict=True))
    assert seen == data[3:].tobytes()


# --- op1, op9 --------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_texts(spark, make):
    rng = random.Random(6)
    good = lambda: prose(rng, rng.randrange(20, 120))
    bad = lambda: " ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(10, 80)).split())
    kinds = [rng.random() < 0.8 for _ in range(500)]
    docs = make([(i, good() if k else bad()) for i, k in enumerate(kinds)] + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(k), "x") for i, k in enumerate(kinds) if i % 2 == 0], "doc_id bigint, quality int, kind string")
    held = fold(F.col("doc_id"), 4) == 2
    net, prior = quality.train(docs.where(~held), labels)
    assert 0.65 < prior < 0.92
    got = {r.doc_id: r.score for r in quality.score(docs, net, prior).collect()}
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == kinds[i] for i in ids) / len(ids) > 0.95
    assert 0 <= got[900] == got[901] <= 1


def test_features_and_scores_are_those_of_single_texts(spark, make):
    texts = ["Abc, abc  abc! 12", "", "x", "a b c a b c a b\nQ.", "ü?"]
    net = quality.Network(quality.FEATURES, seed=1)
    net.mean, net.scale = np.full(quality.FEATURES, 0.1), np.full(quality.FEATURES, 0.7)
    got = {r.doc_id: r.score for r in quality.score(make(list(enumerate(texts))), net, 0.5).collect()}
    for i, text in enumerate(texts):
        data = text.encode()
        n, kind = max(len(data), 1), [int(quality.CLASS[b]) for b in data]
        single = [math.sqrt(kind.count(c) / n) for c in range(16)]
        pairs = Counter(zip(kind, kind[1:], strict=False))
        double = [math.sqrt(pairs[a, b] / n) for a in range(16) for b in range(16)]
        w = WORD.findall(lower(text))
        some, runs = max(len(w), 1), [tuple(w[k : k + 3]) for k in range(len(w) - 2)] or [tuple(w)] * bool(w)
        ends = [int(quality.CLASS[x.encode()[-1]]) for x in w]
        more = [
            math.log1p(len(data)), math.log1p(len(w)), len(set(w)) / some, len(set(runs)) / max(len(runs), 1), sum(a == b for a, b in zip(w, w[1:], strict=False)) / some,
            sum(k >= 6 for k in ends) / some, sum(k >= 8 for k in ends) / some, min(len(data) / some, 40) / 10,
        ]
        x = np.clip((np.array(single + double + more, np.float32).astype(np.float64) - 0.1) / 0.7, -6, 6)
        z = sum(math.tanh(sum(x[j] * net.p[0][j, h] for j in range(len(x))) + net.p[1][h]) * net.p[2][h] for h in range(len(net.p[1]))) + net.p[3][0]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_slopes_are_those_of_the_non_negative_risk(shift):
    """Differences of the risk as it is defined; where its bracket is below zero, of its negative."""
    rng = np.random.default_rng(3)
    a, b, prior = rng.normal(shift, 1, 5), rng.normal(-shift, 1, 7), 0.6
    loss = lambda z: math.log1p(math.exp(-z))
    bracket = lambda a, b: np.mean([loss(-z) for z in b]) - prior * np.mean([loss(-z) for z in a])
    up = bracket(a, b) >= 0
    assert up == (shift == 0.0)
    risk = lambda a, b: prior * np.mean([loss(z) for z in a]) + bracket(a, b) if up else -bracket(a, b)
    da, db = quality.slopes(a, b, prior)
    for x, d, k in ((a, da, 0), (b, db, 1)):
        for i in range(len(x)):
            more, less = x.copy(), x.copy()
            more[i] += 1e-5
            less[i] -= 1e-5
            pair = lambda y, k=k: (y, b) if k == 0 else (a, y)
            assert d[i] == pytest.approx((risk(*pair(more)) - risk(*pair(less))) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("share", [0.3, 0.7, 0.95])
def test_the_prior_is_estimated_without_bad_rows(share):
    rng = np.random.default_rng(5)
    good = lambda n: rng.normal(1.2, 1, (n, 5))
    bad = lambda n: rng.normal(-1.2, 1, (n, 5))
    k = int(3000 * share)
    assert quality.class_prior(good(1500), rng.permutation(np.concatenate([good(k), bad(3000 - k)]))) == pytest.approx(share, abs=0.1)


def test_classifiers_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    net, prior = quality.train(odd, none)
    assert net is None and {r.score for r in quality.score(odd, net, prior).collect()} == {0.5}
    model, share = toxicity.train(odd, none)
    assert model is None and {r.score for r in toxicity.score(odd, model, share).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(empty, *module.train(odd, one))
        assert got.count() == 0
        assert all(0 <= r.score <= 1 for r in module.score(odd, *module.train(odd, one)).collect())


def test_risk_estimate_stays_non_negative():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (400, 6)), rng.normal(-1.5, 1, (400, 6))
    net = quality.fit(p[:200], np.concatenate([p[200:], n[:200]]), 0.5, steps=300)
    assert (net.score(p) > 0.5).mean() > 0.95 and (net.score(n) < 0.5).mean() > 0.95


def test_toxicity_on_held_out_texts(spark, make):
    rng = random.Random(8)
    kinds = [rng.random() < 0.25 for _ in range(700)]

    def text(toxic):
        w = prose(rng, rng.randrange(20, 150)).split()
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "scum", "filth"])
        return " ".join(w)

    docs = make([(i, text(k)) for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.train(docs.where(fold(F.col("doc_id"), 5) != 0), labels)).collect()}
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == kinds[i] for i in ids) / len(ids) > 0.95


def test_evidence_is_that_of_kneser_ney_by_hand(spark, make):
    """Discounted pairs, class unigrams and shared continuation counts, from dictionaries of words."""
    rng = random.Random(1)
    texts = [(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 30))), k % 3 == 0) for k in range(40)]
    split = lambda t: ["<"] + t.split()
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for t, toxic in texts:
        w = split(t)
        one[not toxic].update(w[1:])
        two[not toxic].update(zip(w, w[1:], strict=False))
    follows = Counter(b for _, b in {*two[0], *two[1]})
    kinds = sum(follows.values()) + len(follows) + 1

    def p(c, a, b):
        total = sum(one[c].values())
        left = 1 - sum(max(n - 0.75, 0) for n in one[c].values()) / total
        uni = lambda x: max(one[c][x] - 0.75, 0) / total + left * (follows[x] + 1) / kinds
        if a not in one[0] | one[1] or not any((a, x) in two[k] and two[k][a, x] > 0.75 for k in (0, 1) for x in one[0] | one[1]):
            return uni(b)
        n = max(one[c][a], 1)
        spent = sum(max(m - 0.75, 0) / n for (x, _), m in two[c].items() if x == a)
        return max(two[c][a, b] - 0.75, 0) / n + min(1, max(0.01, 1 - spent)) * uni(b)

    left = [1 - sum(max(n - 0.75, 0) for n in one[c].values()) / sum(one[c].values()) for c in (0, 1)]
    rows_ = spark.createDataFrame([(int(x), t) for t, x in texts], "toxic int, text string")
    counts = rows_.mapInArrow(toxicity._counted, "order int, key long, before long, word long, toxic long, ordinary long").groupBy("order", "key").agg(F.min("before").alias("before"), F.min("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    heads = counts.where("order = 2").groupBy(F.col("word").alias("key")).agg(F.count(F.lit(1)).alias("follows"))
    words_ = counts.where("order = 1").select("key", "toxic", "ordinary").join(heads, "key", "left").fillna(0)
    model = toxicity.build(toxicity._columns(words_), toxicity._columns(counts.where("order = 2").select("key", "before", "toxic", "ordinary")))
    for text in ("a b c d", "g a zz b", "zz yy", "c"):
        want = [math.log(p(0, a, b) / p(1, a, b)) - math.log(left[0] / left[1]) for a, b in zip(split(text), text.split(), strict=False)]
        got = model.evidence(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        assert got == pytest.approx([sum(max(d - 1, 0) for d in want), sum(max(-d - 1, 0) for d in want), sum(want), len(want)], rel=1e-4, abs=1e-5)


def test_kneser_ney_treats_words_unknown_to_both_classes_alike():
    words = {"key": np.array([10, 20], np.uint64), "follows": np.array([3, 3]), "toxic": np.array([5, 0]), "ordinary": np.array([0, 5])}
    pairs = {k: np.zeros(0, np.uint64 if k in ("key", "before") else np.int64) for k in ("key", "before", "toxic", "ordinary")}
    model = toxicity.build(words, pairs)
    data = np.frombuffer(b"never seen", np.uint8)
    assert model.evidence(data, np.array([0, 10]))[0, 2] == pytest.approx(0, abs=1e-6)


def test_toxicity_keeps_all_words_and_pairs():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) * np.uint64(2)
    keys[:40] = (np.uint64(7) << np.uint64(60)) + np.arange(40, dtype=np.uint64) * np.uint64(2)  # the same first bits
    keys = np.unique(keys)
    model = toxicity.Model()
    model.put(keys, np.stack([np.arange(len(keys)), np.ones(len(keys))], axis=1).astype(np.float32))
    known, value = model.get(keys)
    assert known.all() and (value[:, 0] == np.arange(len(keys))).all()
    assert not model.get(keys + np.uint64(1))[0].any() and not toxicity.Model().get(keys)[0].any()


def test_toxicity_learns_pairs_that_occur_rarely(spark, make):
    """Phrases that toxic texts say a few times are in the model, whatever their number."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        k = i % 2
        pair = rng.sample(range(200), 2)
        words = [f"p{p} q{p}" if k else f"q{p} x p{p}" for p in pair]
        docs.append((i, " ".join([f"w{rng.randrange(9)}", *words, "x" if k else ""])))
        labels.append((i, k))
    shared, _ = toxicity.train(make(docs), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    model = toxicity.Model.unpacked(shared[0].value, shared[1])
    apart = {r.doc_id for r in make(docs).where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(4)) == 0).collect()}
    said = {w for i, t in docs if i not in apart and i % 2 for w in zip(t.split(), t.split()[1:])}
    rare = [f"{a} {b}" for a, b in sorted(said) if a[0] == "p"]
    for phrase in rare:
        data = np.frombuffer(phrase.encode(), np.uint8)
        _, pair, _, _ = toxicity.expressions(data, np.array([0, len(data)]))
        assert model.get(pair[1:])[0].all()


# --- op7 -------------------------------------------------------------------------------------------------------------


def _optimum(sizes, capacity):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_bounds_and_best_fit_against_the_optimum():
    rng = random.Random(2)
    for _ in range(40):
        sizes = sorted((rng.randrange(1, 100) for _ in range(9)), reverse=True)
        best = _optimum(sizes, 100)
        bins = packing.best_fit(np.array(sizes), 100)
        assert np.bincount(bins, weights=sizes).max() <= 100
        assert packing.lower_bound(np.array(sizes), 100) <= best <= bins.max() + 1 <= best + 2
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def _check_packing(docs, got, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[(r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(odd, empty, make):
    _check_packing(odd, packing.best_fit_packing(odd, tokenizer_path()).collect(), 2048)
    assert packing.best_fit_packing(empty, tokenizer_path()).count() == 0
    rng = random.Random(9)
    docs = make([(i, prose(rng, rng.randrange(0, 60))) for i in range(400)])
    got = packing.best_fit_packing(docs, tokenizer_path(), capacity=256, per_partition=150).collect()
    used = _check_packing(docs, got, 256)
    assert used <= packing.lower_bound(np.array([r.length for r in got]), 256) * 1.05 + 2
    assert all(r.gap >= 0 for r in got)


def test_open_parts_exchange_pieces_round_by_round(spark):
    """Pieces that leave a gap in parts of a few; each round deals more to a part, until a part has as few bins as can be."""
    rng = random.Random(1)
    sizes = [rng.randrange(30, 52) for _ in range(400)]
    items = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "uid bigint, piece int, length bigint")
    got = packing.pack(items, 100, 20).collect()
    assert sorted(r.uid for r in got) == list(range(400))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, sizes[r.uid]))
    for own in bins.values():
        assert sum(n for _, n in own) <= 100 and [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist()
    assert len({r.sequence_id >> 56 for r in got}) > 2  # three rounds and more closed bins
    apart = sum(packing.best_fit(np.array(sizes[k::20]), 100).max() + 1 for k in range(20))
    assert len(bins) < apart and len(bins) <= packing.best_fit(np.array(sizes), 100).max() + 4


def test_the_encoder_gives_the_ids_of_whole_texts():
    """Letters, digits, marks, apostrophes, composed and decomposed characters and marks of other scripts, side by side."""
    from tokenizers import Tokenizer

    rng = random.Random(6)
    parts = ["don't", "A", "b", "Z9", "7", ",", ".", "'", "'s", "!?", "\u00e9", "e\u0301", "=\u0338", "\u00bb", "\u201d", "_", "\u4e2d", "\U0001f600", " ", "\n", "\u00a0", "I'LL", "\u0130"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)] + [""]
    whole, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    assert own.fold and own.kinds is not None
    data = [t.encode() for t in texts]
    ids, per = own.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [[*e.ids, 0] for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == want


def test_added_tokens_in_text():
    """Texts that spell an added token, in any place, have the tokenizer's ids."""
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(tokenizer_path()), random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "Word", "x9", "<|", "|>", "'s", "É", " ", "  ", "\n", "<|endof", "text|>", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(400)] + ["<|endof", "text|>", "plain text"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    own = packing.Encoder(tokenizer_path())
    for _ in range(2):  # from the tokenizer and from memory
        ids, total = own.encode(data, at)
        assert [x.tolist() for x in np.split(ids, np.cumsum(total)[:-1])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


# --- op8 -------------------------------------------------------------------------------------------------------------


def test_targets_are_capped_and_reshared(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 400, "d": 0}
    rows_ = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows_).collect()}
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [k for k in sizes if k not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[k] for k in open_), 1)
        over = [k for k in open_ if weight[k] * level > 2 * sizes[k]]
        if not over:
            break
        fixed |= {k: 2 * sizes[k] for k in over}
    for k in sizes:
        assert got[k] == pytest.approx(fixed.get(k, weight[k] * level))


def test_mix_meets_targets_and_reruns_agree(make, odd, empty):
    rng = random.Random(11)
    docs = make([(i, prose(rng, rng.randrange(0, 50)), None, rng.choice("aaaaab") if i % 7 else None) for i in range(900)])
    got = mixing.pareto_mix(docs).collect()
    again = mixing.pareto_mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 30
    rows_ = mixing.mixed(docs)
    assert rows_.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in rows_.collect()) == sum(taken.values())
    assert Counter(r.doc_id for r in mixing.mixed(docs.repartition(5)).collect()) == Counter(r.doc_id for r in rows_.collect() for _ in [0])
    assert mixing.pareto_mix(odd).count() == odd.count()
    assert mixing.pareto_mix(empty).count() == 0


def test_rows_of_one_id_keep_their_sources(make):
    """Rows that differ in their source only, and repeated ones, are each taken as the mix says."""
    docs = make([(i // 3, "w " * (1 + i // 3 % 9), None, "abb"[i % 3]) for i in range(900)])
    want = Counter()
    for r in mixing.pareto_mix(docs).collect():
        want[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect())
    assert got == +want


def test_longer_documents_are_likelier(make):
    docs = make([(i, "w " * (1 if i % 2 else 127), None, "a") for i in range(4000)])
    got = {r.doc_id: r.copies for r in mixing.pareto_mix(docs, share=0.5).collect()}
    short, long = (np.mean([n for i, n in got.items() if i % 2 == k]) for k in (1, 0))
    assert short == pytest.approx(0.5 / 7, abs=0.03) and long == pytest.approx(0.5, abs=0.03)


def test_unequal_probabilities(make):
    docs = make([(i, "w " * 10, None, "a" if i % 2 else "b") for i in range(4000)]).withColumn("m", F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(3.0))
    got = {r.doc_id: r.copies for r in mixing.pareto_mix(docs, weights=(1, 1), share=0.4, measure="m").collect()}
    low = np.mean([n for i, n in got.items() if i % 4 < 2])
    high = np.mean([n for i, n in got.items() if i % 4 >= 2])
    assert low == pytest.approx(0.2, abs=0.04) and high == pytest.approx(0.6, abs=0.04)


def test_toxicity_knows_new_words_of_a_known_stem(spark, make):
    """Toxic words of one stem, most of which no labelled text has, against ordinary words that were not seen either."""
    rng = random.Random(8)
    parts = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    def text(toxic):
        words = [word() for _ in range(60)]
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = "zwachl" + "".join(rng.choice(parts) for _ in range(3))
        return " ".join(words)

    kinds = [i % 4 == 0 for i in range(800)]
    docs = make([(i, text(k)) for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.train(docs.where("doc_id < 600"), labels)).collect()}
    caught, clean = ([(got[i] >= 0.5) for i in range(600, 800) if kinds[i] == k] for k in (True, False))
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.05 * len(clean)


def test_the_toxic_sample_is_bounded_by_bytes(make, spark):
    """Few long texts are as much as many short ones; without a bound all labelled rows are learnt from."""
    rng = random.Random(4)
    docs = make([(i, prose(rng, 300)) for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    words = lambda **more: len(toxicity.train(docs, labels, **more)[0][0].value[1])
    whole = words()
    assert words(text_bytes=1 << 40) == whole and words(cap=40) == whole
    assert 0 < words(text_bytes=20_000) < 0.6 * whole


# --- op10 ------------------------------------------------------------------------------------------------------------


def _walk(text, scale):
    """The samples of one scale, step by step."""
    want, i = edit_embedding.positions(scale), 0
    points = [int(buffers.mix(np.array([ord(c)], np.uint64) + np.uint64(1))[0]) for c in text]
    out, rules = [], None
    for j in range(int(want.max()) + 1):
        if j % edit_embedding._STEPS == 0:
            rules = edit_embedding._rules(j)
        out.append((points[i] >> 32) % 256 % 15 + 1 if i < len(points) else 0)
        if i < len(points):
            i += int(rules[j % edit_embedding._STEPS][points[i] % 63])
    return [out[j] for j in want]


def test_walks_are_those_of_single_texts():
    rng = random.Random(12)
    texts = ["", "a", "é漢字😀" * 9, prose(rng, 5), prose(rng, 300), prose(rng, 40), "x" * 5000]
    scales, samples = edit_embedding.fingerprints(texts)
    for t, s, x in zip(texts, scales.tolist(), samples, strict=True):
        assert x[0].tolist() == _walk(t, s) and x[1].tolist() == _walk(t, s + 1)


def test_edit_fingerprints(odd, empty, make):
    for docs, runs in ((odd.where("doc_id is not null").dropDuplicates(["doc_id"]), 5), (odd.where("doc_id = 6"), 1), (make([(i * 7 % 101, f"text {i} " * (i % 9)) for i in range(101)]), 16)):
        table = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
        got = {r.doc_id: r for r in edit_embedding.edit_fingerprints(docs, runs).collect()}
        assert len(got) == len(table)
        for (i, t), (_, after) in zip(table, [*table[1:], table[0]], strict=True):
            new = edit_embedding.edited(t, after)
            assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
            scales, x = edit_embedding.fingerprints([t, new, after])
            assert [got[i].fingerprint, got[i].edited_fingerprint] == edit_embedding.as_text(scales, x)[:2]
            pair = lambda k: edit_embedding.likeness(scales[:1], x[:1], scales[k : k + 1], x[k : k + 1])[0]  # noqa: E731, B023
            assert (got[i].near_edited, got[i].near_next) == pytest.approx((pair(1), pair(2)))
    assert edit_embedding.edit_fingerprints(odd).count() == odd.count()
    assert edit_embedding.edit_fingerprints(empty).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances_are_those_of_the_table():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        d = _distance(a, b)
        assert [edit_embedding.within(a, b, k) for k in range(13)] == [d <= k for k in range(13)]
    long = prose(rng, 4000)
    assert edit_embedding.within(long, "x" + long[:500] + long[510:] + "y", 12) and not edit_embedding.within(long, "x" + long[:500] + long[510:] + "y", 11)


def test_edit_distances_of_many_pairs_are_those_of_one():
    """Few edits, many, blocks that throw the followed diagonals off, texts of different kinds of characters, strangers."""
    rng = random.Random(4)
    pairs = []
    for k in range(3000):
        letters = rng.choice(["ab", "abcdefgh ", "é漢\U0001f600ab"])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 40, 200])))
        b = _edited(rng, a, rng.randrange(len(a) // 4 + 1)) if a else "".join(rng.choices(letters, k=k % 5))
        if k % 4 == 0:
            b = "".join(rng.choices(letters, k=rng.randrange(60))) + b
        pairs.append((a, b, rng.randrange(len(a) // 2 + 3)))
    got = edit_distance.within_many(pairs, edit_embedding._common).tolist()
    assert got == [edit_embedding.within(*p) for p in pairs] and 500 < sum(got) < 2800
    long = "".join(rng.choices("abcdefgh ", k=6000))
    far = long[3000:] + long[:3000]
    assert edit_distance.within_many([(long, long[400:], 400), (long, long[400:], 399), (long, far, 600), (long, long[:3000] + "z" * 300 + long[3000:], 300)], edit_embedding._common).tolist() == [True, False, False, True]
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    assert edit_distance.within_many([(wide, wide[:300] + wide[310:] + "x", 11), (wide, wide[::-1], 90)], edit_embedding._common).tolist() == [True, False]


def _edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [chars[at], rng.choice("xyz")]])
    return "".join(chars)


def test_near_classes_in_crowded_buckets(make, odd, empty):
    """Texts with a common first half crowd the buckets; recall of links between texts of few edits, against all pairs."""
    rng = random.Random(12)
    common, texts = prose(rng, 40, 99), []
    for _ in range(25):
        base = (common + " " if rng.random() < 0.5 else "") + prose(rng, 40, 99)
        texts += [base, *(_edited(rng, base, rng.randrange(1, 5)) for _ in range(rng.randrange(3)))]
    texts += [texts[0], texts[3]]
    got = {r.doc_id: r.class_id for r in edit_embedding.near_classes(make(list(enumerate(texts)))).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if _distance(texts[i], texts[j]) * 10 <= max(len(texts[i]), len(texts[j]))]
    assert len(near) > 20 and sum(got[i] == got[j] for i, j in near) / len(near) >= 0.9
    root = list(range(len(texts)))
    for i, j in near:  # nothing is in one class but by near texts
        a, b = (next(x for x in iter(lambda k=k: root[k], None)) for k in (i, j))
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert all(root[i] == root[c] for i, c in got.items())
    rows_ = edit_embedding.near_classes(odd).collect()
    assert len(rows_) == odd.count() and {(r.class_id, r.class_size) for r in rows_ if r.doc_id in (3, 4)} == {(3, 2)}
    assert {r.class_id for r in rows_ if r.doc_id in (7, 8)} == {7}
    assert edit_embedding.near_classes(empty).count() == 0


def _met(texts):
    """Pairs of texts that share a band."""
    text, band, key = edit_embedding.bands(texts)
    rooms: dict[tuple, set] = {}
    for i, b, k in zip(text.tolist(), band.tolist(), key.tolist(), strict=True):
        rooms.setdefault((b, k), set()).add(i)
    return {(i, j) for room in rooms.values() for i in room for j in room if i < j}


def test_bands_meet_near_texts_and_few_others():
    """Blocks put in at both ends throw walks out of step; strangers of like lengths hardly ever share a band."""
    rng = random.Random(5)
    texts, near = [], set()
    for k in range(120):
        base = "".join(rng.choice("etaoin shrdlu cmfwyp") for _ in range(rng.randrange(60, 3000)))
        n = len(base) // 25
        noise = lambda m: "".join(rng.choice("qzxj") for _ in range(m))  # noqa: E731, B023
        other = noise(n) + base[: len(base) - 2 * n] + noise(n) + base[len(base) - 2 * n :] if k % 2 else _edited(rng, base, max(1, n))
        near.add((len(texts), len(texts) + 1))
        texts += [base, other]
    got = _met(texts)
    assert len(got & near) >= 0.95 * len(near)
    assert len(got - near) < 0.01 * len(texts) ** 2 / 2
    assert not _met(["", "", "a" * 3]) and not _met([])


def test_runs_in_common_never_part_near_texts():
    rng = random.Random(6)
    for n in (0, 1, 3, 4, 9, 40, 300, 5000):
        base = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for k in (0, 1, n // 20, n // 10):
            other = _edited(rng, base, k) if base else ""
            longer = max(len(base), len(other))
            assert edit_embedding._may(edit_embedding._runs(base), edit_embedding._runs(other), longer, k)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(2))
    assert not edit_embedding._may(edit_embedding._runs(a), edit_embedding._runs(b), 2000, 200)


def test_sketches_part_strangers_and_no_near_texts():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (0, 1, 5, 6, 30, 300, 2000, 9000) for _ in range(10)] + ["ab" * 500, "x" * 3000]

    def kept(a, b):
        x, y = sketches.sketch(a)[None], sketches.sketch(b)[None]
        filled = lambda s: np.count_nonzero(s, axis=1)
        return bool(sketches.may_be_near(sketches._equal(x, sketches._right(y)), np.array([len(a)]), np.array([len(b)]), filled(x), filled(y), (1, 10))[0])

    for t in texts:
        other = list(t)
        for i in range(9, len(t), 10):  # edits spread so that they change as many runs as they can
            other[i] = "z"
        assert kept(t, "".join(other)) and kept(t, t)
    long = [t for t in texts if len(t) in (300, 2000, 9000)]
    assert not any(kept(a, b) for a in long for b in long if a != b)


def test_strangers_of_crowded_buckets_dont_meet_as_texts(spark):
    """Sketches leave near pairs only, each once however many buckets it shares, in small buckets and in blocks of large ones."""
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(150)]
    texts += [_edited(rng, t, 12) for t in texts[:6]]
    at = [(u, u, tree, 0) for tree in range(3) for u in range(len(texts)) if u % (tree + 1) == 0 or u >= 150] + [(u, u, 9, u % 2) for u in (0, 150, 1, 151)]
    rows_ = spark.createDataFrame(at, "uid long, class long, tree int, prefix long")
    payloads = spark.createDataFrame([(u, bytearray(t.encode())) for u, t in enumerate(texts)], "uid long, payload binary")
    sift = sketches.RunSift(sketches.sketched(payloads), (1, 10))
    for block in (40, 1000):
        links, pairs = buckets.sifted_links(rows_, payloads, edit_embedding._judge((1, 10)), sift, block)
        assert Counter(map(tuple, pairs.collect())) == Counter(map(tuple, links.collect())) == Counter({(150 + k, k): 1 for k in range(6)})


def test_keep_leaves_one_of_repeated_rows(make):
    docs = make([(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "c")])
    found = exact_dedup.exact_dedup(docs)
    assert Counter((r.doc_id, r.text) for r in rows.keep(docs, found).collect()) == Counter([(1, "a"), (2, "b"), (3, None), (None, "c")])
    assert rows.keep(docs, found).columns == docs.columns


def test_groups_are_dealt_without_their_payloads(spark):
    rows = spark.createDataFrame([(1, 1, 80, 0, 5), (2, 2, 80, 0, 5)], "uid long, class long, size long, tree int, prefix long")
    none = spark.createDataFrame([], "uid long, payload binary")
    _, members = buckets.mixed_links(rows, none, ngram_join._near((4, 5)), 4)
    assert {(r.uid, r["class"], r.size) for r in members.collect()} == {(1, 1, 80), (2, 2, 80)}


def test_forest_tells_how_large_a_shingle_set_is(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g  h x"), (3, "a b c d e a b c d e")] * 2, "doc_id long, text string")
    signed = ngram_join.signatures(docs)
    found = {r.uid: r.size for r in ngram_join.forest(signed).collect()}
    sets = ngram_join.shingle_sets(docs, signed.select("uid").distinct()).collect()
    assert found and all(len(r.payload) <= found.get(r.uid, len(r.payload)) for r in sets)


def test_least_score_is_that_of_all_labelled_texts(spark, monkeypatch):
    docs = spark.range(20_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    least = 1 - 20_299 / 40_600
    for k in (20_299, 11, 5_003):  # whichever text has the least score counts
        monkeypatch.setattr(langid, "identify", lambda rows, model, k=k: rows.select(F.when(F.col("doc_id") == k, least).otherwise(0.9).alias("score")))
        odds = 0.5 * least / (1 - least)
        assert abs(langid.least_score(docs, None) - odds / (1 + odds)) < 1e-9


def test_sketches_of_each_zone_keep_near_texts_and_part_strangers():
    """Long texts of few words have most short runs in common, short ones few runs: each length is compared by runs of its own."""
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n // 3))[:n]

    def kept(a, b):
        zone = int(sketches.zone_of(max(len(a), len(b))))
        x, y = (sketches.unpacked(np.frombuffer(sketches.packed(t, zone), np.uint8)[None]) for t in (a, b))
        return bool(sketches._may_pairs(zone, x, y, np.array([len(a)]), np.array([len(b)]), (1, 10))[0])

    for n in (0, 1, 9, 30, 200, 399, 401, 1999, 2001, 6500, 13_000, 32_000, 60_000):
        texts = [prose(n) for _ in range(4)] + ["a" * n, "ab" * (n // 2)]
        for t in texts:
            worst = "".join("z" if i % 10 == 9 else c for i, c in enumerate(t))
            assert kept(t, worst) and kept(worst, t) and kept(t, t) and kept(t, t[: n - n // 10])
        if 200 <= n < 60_000:
            assert not any(kept(a, b) for a in texts[:4] for b in texts[:4] if a is not b), n


def test_near_texts_at_the_ends_of_zones_are_linked(spark):
    """The shorter text of a pair has a sketch of the longer one's zone as well; blocks of any size find the same."""
    rng = random.Random(13)
    texts = []
    for n in (400, 2000, 6000, 12_000, 30_000):
        base = "".join(rng.choices("abcdefgh ", k=n))
        texts += [base, base[: n - 12], base[: n - n // 12], "".join(rng.choices("abcdefgh ", k=n))]
    payloads = spark.createDataFrame([(u, bytearray(t.encode())) for u, t in enumerate(texts)], "uid long, payload binary")
    rows_ = spark.createDataFrame([(u, u, tree, 0) for u in range(len(texts)) for tree in range(2)], "uid long, class long, tree int, prefix long")
    sift = sketches.RunSift(sketches.sketched(payloads), (1, 10))
    for block in (7, 1000):
        links, pairs = buckets.sifted_links(rows_, payloads, edit_embedding._judge((1, 10)), sift, block)
        assert Counter(map(tuple, links.collect())) == Counter({(4 * k + i, 4 * k + j): 1 for k in range(5) for i, j in ((1, 0), (2, 0), (2, 1))})


def test_texts_go_to_a_block_once(spark, monkeypatch):
    """Of many pairs in one block each text is sent once, and blocks of much text are dealt to parts with the same links."""
    uids = range(12)
    payloads = spark.createDataFrame([(u, bytearray(f"{u % 3} text".encode())) for u in uids], "uid long, payload binary")
    pairs = spark.createDataFrame([(a, b, 6, 6, a % 2, 0, 0) for a in uids for b in uids if a > b], "uid long, head long, n long, n_head long, unit long, lo int, hi int")
    for most in (16 << 20, 20):
        monkeypatch.setattr(buckets, "BLOCK_BYTES", most)
        links = buckets.verified_in_groups(pairs, lambda uids: payloads, lambda two: [x[:1] == y[:1] for x, y in two])
        assert Counter(map(tuple, links.collect())) == Counter({(a, b): 1 for a in uids for b in uids if a > b and a % 3 == b % 3})


def test_least_odds_are_those_of_like_lengths(spark):
    """All labelled rows count, by length; one in a thousand may be less sure, whatever the number of rows."""
    few = [(1, 0.4), (1, 0.9), (7, 0.8), (7, 0.95)]
    least = langid.least_odds(spark.createDataFrame(few, "size int, score double"))
    assert least == {1: pytest.approx(0.5 * 0.4 / 0.6, rel=0.02), 7: pytest.approx(0.5 * 4, rel=0.02)}
    many = spark.range(4000).select(F.lit(7).alias("size"), F.when(F.col("id") < 3, 0.3).when(F.col("id") < 5, 0.7).otherwise(0.99).alias("score"))
    assert langid.least_odds(many) == {7: pytest.approx(0.5 * 0.7 / 0.3, rel=0.02)}
    rows_ = spark.createDataFrame([("en", 0.3, 0), ("en", 0.3, 1), ("en", 0.2, 1), ("en", 0.6, 5), ("en", 0.6, 7), ("en", 0.7, 9), ("en", 0.6, 9), ("und", 0.0, 0)], "lang_pred string, score double, size int")
    assert [r.found for r in rows_.select(langid.is_found(least).alias("found")).collect()] == [True, True, False, True, False, True, False, False]
    assert rows_.where(langid.is_found({})).count() == 7


def test_rounds_of_bounded_size_find_the_same_pairs(spark, monkeypatch):
    """What is sent at once is bounded by the texts; pairs that meet in several rounds are verified once."""
    rng = random.Random(14)
    texts = ["".join(rng.choices("abcdefgh ", k=500)) for _ in range(20)]
    texts += [_edited(rng, t, 12) for t in texts[:6]]
    rows_ = spark.createDataFrame([(u, u, tree, u % (tree + 2)) for tree in range(9) for u in range(len(texts))] + [(u, u, 20 + k, 0) for k in range(6) for u in (k, 20 + k)], "uid long, class long, tree int, prefix long")
    payloads = spark.createDataFrame([(u, bytearray(t.encode())) for u, t in enumerate(texts)], "uid long, payload binary")
    sift, rounds, real = sketches.RunSift(sketches.sketched(payloads), (1, 10)), [], buckets._rounds
    monkeypatch.setattr(buckets, "_rounds", lambda *a: rounds.append(real(*a)) or rounds[-1])
    for most in (1, 100):
        monkeypatch.setattr(buckets, "AT_ONCE", most)
        links, pairs = buckets.sifted_links(rows_, payloads, edit_embedding._judge((1, 10)), sift, 1000)
        assert Counter(map(tuple, pairs.collect())) == Counter(map(tuple, links.collect())) == Counter({(20 + k, k): 1 for k in range(6)})
    assert len(rounds[0]) > 4 and len(rounds[2]) == len(rounds[3]) == 1
