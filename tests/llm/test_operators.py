"""Each operator against a brute-force version, on a table of awkward rows and on empty tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import _scratch, components, crf, decontam, itq, kneser_ney, langid, mixing, pii, simhash, tokens, warc
from quillon.llm.queries import id_remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, score double, id long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(lower(text))


def awkward():
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns of clashing names."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(80)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base, "en", "b"), (2, " ".join(near), "en", "b"), (3, base.upper(), "en", "a"), (4, None, None, None), (5, "", "de", "a"), (6, " \t\n ", None, "b"),
        (7, text(30_000), "en", "a"), (8, "one two", "fr", None), (8, "one two", "fr", None), (9, "naïve café — ünïcödé 😀 words", "fr", "c"), (None, base, "en", "a"), (None, None, None, None),
        (10, "x" * 50_000, "en", "c"), (11, "1234 5678", None, "c"), (12, base, "en", "b"),
    ]
    rows += [(100 + i, text(rng.randint(1, 60)), rng.choice(["en", "de", "fr"]), rng.choice("abc")) for i in range(60)]
    return [(i, t, lang, s, None if t is None else len(t), 7, "k", 3, 0.5, 1, 2) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("few", [components.FEW_LINKS, 3])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500, 500)]
    pairs += [(600 + i, 601 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {n: find(n) for p in pairs for n in p if p[0] != p[1]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    found = words_of(text)
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) >= 4 else ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, linked):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, none):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    part = groups_of(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for r, p in zip(rows, part, strict=True):
        if r.doc_id is not None:
            least[p].append(r.doc_id)
    expected = Counter((r.doc_id, f"{f:016x}", min(least[p]) if least[p] else None) for r, f, p in zip(rows, fps, part, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_masks():
    """Fingerprints that differ in k bits agree under some mask, for every choice of spare blocks."""
    rng = random.Random(9)
    for k, spare in ((4, 1), (4, 2), (4, 3), (4, 4), (2, 3), (7, 2)):
        found = simhash.masks(k, spare)
        assert len(found) == math.comb(k + spare, spare) and all(m.bit_count() >= 64 * spare // (k + spare) - spare for m in found)
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample(range(64), k))
            assert any(apart & m == 0 for m in found)


def test_simhash_spare_blocks(spark):
    rng = np.random.default_rng(12)
    fps = spark.createDataFrame([(int(f),) for f in rng.integers(-(1 << 63), 1 << 63, 2000)], "fp long").cache()
    # About 0.35 members a child with one spare block: cheap pairs need no more blocks, dear ones do.
    assert simhash.spare_blocks(fps, 4) == 1
    assert simhash.spare_blocks(fps, 4, pairs_an_entry=0.1) > 1
    assert simhash.spare_blocks(fps.limit(0), 4) == 1


@pytest.mark.parametrize("spare", [None, 2, 4])
def test_simhash_links_lose_nothing(spark, spare, monkeypatch):
    monkeypatch.setattr(simhash, "NODES_A_GROUP", 3)  # groups of nodes are salted
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    # Nodes of eight members: hot segments are cut into many.
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), k=4, node_size=8, leaf_size=2, spare=spare)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    part = groups_of(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    sizes = Counter(part)
    mine = defaultdict(set)
    for (s,), f in zip(signed, fps, strict=True):
        if s in got:
            mine[got[s]].add(f)
    theirs = defaultdict(set)
    for f, p in zip(fps, part, strict=True):
        if sizes[p] > 1:
            theirs[p].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows, n = [], 0
    for i, v in enumerate(base):
        for _ in range(int(rng.integers(1, 8))):
            rows.append((n, (v + rng.normal(scale=0.05, size=16)).tolist(), i % 3))
            n += 1
    rows += [(n + 1, rows[0][1], rows[0][2]), (n + 2, rows[0][1], None), (n + 3, [0.0] * 16, 1), (n + 4, None, 1), (n + 5, [float("nan")] + [1.0] * 15, 1), (n + 6, [None] + [1.0] * 15, 1), (n + 7, [], 1)]
    rows += [(n + 8, [1.0, 2.0], 1), (n + 9, [2.0, 4.0], 1), (n + 10, [float("inf")] * 16, 0)]
    hot = rng.normal(size=16)
    rows += [(1000 + i, (hot + rng.normal(scale=1e-3, size=16)).tolist(), 0) for i in range(90)]
    frame = spark.createDataFrame([(a, b, c, 5, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, n long, key string")
    found = {r.vec_id: r for r in itq.near_vectors(frame, part_size=16).collect()}
    usable = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = defaultdict(set)
    for i, (a, x, la) in enumerate(usable):
        for b, y, lb in usable[:i]:
            if la == lb and len(x) == len(y):
                u, v = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    assert len(found) == len(rows)
    true, mine = sum(map(len, links.values())), sum(r.n_links for r in found.values())
    assert 0.9 * true <= mine <= true and true > 8000
    for r in found.values():
        assert r.n_links <= len(links[r.vec_id]) and r.kept == (r.vec_id == r.component_id)
    assert {r.component_id for i, r in found.items() if 1000 <= i < 1090} == {1000}
    # Outside the hot group too, most links are found by the tables, and all by comparing everything.
    spread = [i for i in found if i < 1000]
    assert sum(found[i].n_links for i in spread) >= 0.95 * sum(len(links[i]) for i in spread) > 500
    whole = {r.vec_id: r for r in itq.near_vectors(frame, part_size=16, exact=True).collect()}
    ids = sorted(found)
    part = groups_of(ids, lambda a, b: b in links[a])
    least = {}
    for i, p in zip(ids, part, strict=True):
        least[p] = min(least.get(p, i), i)
    assert {i: (r.n_links, r.component_id) for i, r in whole.items()} == {i: (len(links[i]), least[p]) for i, p in zip(ids, part, strict=True)}
    assert itq.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["all null", "half null"])
def test_vectors_without_ids_above_the_sample(spark, ids):
    """Vectors of one label whose ids are null or equal are spread over the sample like any others."""
    rng = np.random.default_rng(12)
    rows = [(None if ids == "all null" or i % 2 else 5, rng.normal(size=16).tolist(), 0, i) for i in range(600)]
    rows += [(None, rows[3][1], 0, 600), (None, [2 * x for x in rows[4][1]], 0, 601)]
    found = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, i int"), fit_rows=20).collect()
    assert len(found) == 602 and sorted(r.n_links for r in found)[-4:] == [1, 1, 1, 1] and sum(r.n_links for r in found) == 4


def test_pairs_belong_to_one_bucket():
    """Two codes belong together in exactly one of the buckets that both are entered in, if they meet at all."""
    rng = np.random.default_rng(9)
    masks = itq.windows(64, 5000, 0.98)
    for _ in range(400):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b ^= 1 << int(bit)
        entered = lambda c, m: {c & m, *((c & m) ^ (1 << k) for k in range(64) if m >> k & 1)}
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        buckets = [(slot, sub) for slot, m in enumerate(masks) for sub in entered(a, m) & entered(b, m)]
        mine = [itq.belongs(x ^ y, x, slot, sub, masks)[0] for slot, sub in buckets]
        other = [itq.belongs(x ^ y, y, slot, sub, masks)[0] for slot, sub in buckets]
        assert mine == other and sum(mine) == bool(buckets)
        assert bool(buckets) == any(bin((a ^ b) & m).count("1") <= 2 for m in masks)


def test_windows_widen_with_the_vectors():
    """A thousand times the vectors: a few times the entries and the meetings of each."""
    costs = {}
    for n in (1000, 10_000, 100_000, 1_000_000):
        masks = itq.windows(64, n, 0.98)
        width = bin(masks[0]).count("1")
        costs[n] = (len(masks) * (width + 1), len(masks) * n * (width + 1) ** 2 / 2 ** (width + 1))
    assert costs[1_000_000][0] < 8 * costs[1000][0] and all(meetings < 170 for _, meetings in costs.values())


def test_vectors_at_the_threshold(spark):
    """Pairs planted just above (and just below) the threshold, in directions of no structure."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(3000):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        w = rng.normal(size=64)
        w -= (w @ v) * v
        cosine = rng.uniform(0.9801, 0.985) if i % 3 else rng.uniform(0.97, 0.9799)
        rows += [(2 * i, v.tolist(), 1), (2 * i + 1, (cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)).tolist(), 1)]
    found = {r.vec_id: r.n_links for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    near = [i for i in range(3000) if i % 3]
    assert sum(found[2 * i] == 1 for i in near) >= 0.99 * len(near)
    assert not any(found[2 * i] for i in range(0, 3000, 3))


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(docs, none):
    rows = mixing.mix(docs, rows_per_range=5).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
    targets = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.cut
    assert all(0 <= targets[s] - taken[s] < 1 for s in sizes)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(words_of(r.text))) for r in docs.collect())
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(7), rows_per_range=5).collect()))
    assert mixing.mix(none).count() == 0


def test_mixed_documents(docs):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.mixed_documents(unique, rows_per_range=5)
    assert mixed.columns == unique.columns
    words, taken = Counter(), {r.doc_id: r.taken for r in mixing.mix(unique, rows_per_range=5).collect()}
    original = {r.doc_id: r.text for r in unique.collect()}
    for r in mixed.collect():
        words[r.doc_id] += len(words_of(r.text))
        assert original[r.doc_id].startswith(r.text)
    assert words == {d: n for d, n in taken.items() if n}


def test_mixed_documents_with_null_and_repeated_ids(docs):
    """Every row meets its own cut once, whatever its id."""
    mixed = mixing.mixed_documents(docs, rows_per_range=5).collect()
    sizes, words, texts = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
        texts[r.doc_id, r.source].add(r.text or "")
    for r in mixed:
        words[r.source] += len(words_of(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id, r.source])
    targets = brute_targets(sizes)
    assert all(0 <= targets[s] - words[s] < 1 for s in sizes)
    by_row = lambda rows: sorted((str(r.doc_id), r.text) for r in rows)
    assert by_row(mixed) == by_row(mixing.mixed_documents(docs.repartition(7), rows_per_range=5).collect())
    # Rows that share an id and a source but not a text, in the order of their sizes.
    same = docs.sparkSession.createDataFrame([(None, "a " * n, "s") for n in (1, 2, 3, 4)] + [(1, "b " * n, "s") for n in (2, 5)], "doc_id long, text string, source string")
    budget = sum(r.taken for r in mixing.mix(same).collect())
    assert sum(len(words_of(r.text)) for r in mixing.mixed_documents(same).collect()) == budget


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_context_on_both_sides_and_whole_words(spark):
    texts = [
        "123-45-6789 (SSN)", "123-45-6789 is lessn", "my SSN: 123-45-6789", "4111 1111 1111 1111 is my credit card", "4111 1111 1111 1111 is discredited", "I shall tell +1 555 123 4567", "tel +1 555 123 4567",
        "+1 555 123 4567 (Phone)", "a@b.co, c@d.co e-mail", "ship to 10.0.0.1", "10.0.0.1 is the server", "x" * 45 + " 123-45-6789 " + "y" * 41 + " ssn", "dirección 10.0.0.1",
    ]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(found[i].added) for i in (0, 1, 2, 11)] == [1, 0, 1, 0]
    score = lambda i: [s.score for s in found[i].base]
    assert score(3) == [0.99] and score(4) == [0.7] and score(5) == [0.7] and score(6) == [0.95] and score(7) == [0.95]
    # The text between two matches of a kind belongs to both.
    assert score(8) == [0.9, 0.99] and score(9) == [0.6] and score(10) == [0.9] and score(12) == [0.9]


def test_pii(spark, docs, none):
    texts = [
        "mail a.b+c@x-y.example.com, a@b.c@d.ef_g@h.ij; 😀 10.0.0.1 1.2.3.4.5 256.1.1.1 0001.02.003.255 99999999999.1.1.1",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111  1111; +1 (988) 555-2485. +49 30 (1234) 567-8901-2345-678 +123",
        "IBAN GB82 WEST 1234 5698 7654 32 bank DE89370400440532013000 bad GB82 WEST 1234 5698 7654 33; ssn 123-45-6789, order 123-45-6788",
        "@ a@ @b.c a@b a@b. +1 2", None, "", "1 2 " * 20_000, "a@b.co " * 3_000, "9" * 60_000, "a.b" * 30_000 + "@", "4111111111111111" * 2,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    found = pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.collect():
        spans = brute_spans(texts[r.doc_id])
        count = Counter(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k, _ in BASE), r.doc_id
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), r.doc_id
        assert r.spans.startswith(joined)
    added = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert added[2] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789"]
    assert found.count() == len(rows) and pii.pii_report(docs).count() == docs.count() and pii.pii_report(none).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}\r\nx%", "".join(rng.choice("ab<>é\r\n") for _ in range(rng.randint(0, 400)))) for i in range(80)]
    rows += [(200 + i, None, "same page") for i in range(50)] + [(300, "u", None), (301, "u", ""), (302, None, "z" * 900_000), (None, "n", "only null"), (None, "n", "same page"), (-1, "m", "only null"), (-1, "m", "minus one"), (None, "n", "minus one"), (400, "u", "twice"), (400, "u", "twice")]
    pages = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "page_id long, url string, html string, digest string, id int").repartition(3)
    archives = warc.write_archives(pages, "file://" + str(tmp_path / "w"))
    found = warc.read_archives(warc.normalise(archives)).collect()
    first = {}
    for page, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((html or "").encode(), page)
    expected = Counter()
    seen = set()
    for page, url, html in rows:
        payload = (html or "").encode()
        digest, least = base64.b32encode(hashlib.sha1(payload).digest()).decode(), first.get(payload)
        revisit = least is not None and (least != page or (page, payload) in seen)
        seen.add((page, payload))
        expected[page, url, len(payload), digest, "revisit" if revisit else "response", least if revisit else None] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0), "file://" + str(tmp_path / "e")))).count() == 0
    # Every member is a gzip file of its own, and the sidecar finds it.
    name = sorted((tmp_path / "w").glob("*.warc.gz"))[0]
    name = next(p for p in sorted((tmp_path / "w").glob("*.warc.gz")) if ".whole." not in p.name)
    for line in (tmp_path / "w" / (name.name + ".idx")).read_text().splitlines():
        record_id, _, offset, length, _ = line.split("\t")
        assert f"WARC-Record-ID: {record_id}".encode() in zlib.decompress(name.read_bytes()[int(offset) : int(offset) + int(length)], 31)


def test_token_files(spark, docs, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["  a  b\n\n c\t\td  ", "don't I'LL we've  'tis", "x y \x1c\x1d z\x85w", "日本語 テスト 123½²", "ªº µ ß ÿ×÷", "1२३ ⅷ x_y__z", "\x00\x01 \x7f", "<|endoftext|> a"]
    every = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(7000 + i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, n long"))
    manifest = tokens.write_tokens(every, "file://" + str(tmp_path / "t"), path, public_tokenizers.PATTERN, end_id=2, frame_bytes=5_000)
    found = sorted(tokens.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    start, expected = 0, []
    for r in sorted(every.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(map(tuple, found)) == expected
    for row in manifest.collect():
        reader = tokens.SeekableReader(row.file)
        assert sum(len(reader.frame(i)) for i in range(len(reader.index))) == row.docs
        wanted = next(d for i in range(len(reader.index)) for d, _ in reader.frame(i) if d is not None)
        assert len(reader.documents(wanted)) >= 1
        raw = bytearray((tmp_path / "t" / row.file.rpartition("/")[2]).read_bytes())
        raw[len(raw) // 8] ^= 0xFF
    assert tokens.read_tokens(spark, tokens.write_tokens(none, "file://" + str(tmp_path / "e"), path, public_tokenizers.PATTERN)).count() == 0


def test_added_tokens(spark, tmp_path):
    """The query's ids are those of the tokenizer as it is, which matches its added tokens."""
    from tokenizers import Tokenizer

    from quillon.llm import queries

    texts = ["<|endoftext|> a", "a b<|endoftext|><|endoftext|>\n c", "<|endoftext| > a", "plain", "", None, "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain, start, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in enumerate(texts):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids
    assert sorted(map(tuple, queries.op9_token_output(spark, str(tmp_path)).collect())) == expected


def test_token_reader_sees_damage(tmp_path):
    with _scratch.CommittedFile(str(tmp_path / "f")) as out:
        writer = tokens.SeekableWriter(out, frame_bytes=64)
        for i in range(20):
            writer.add(i, np.arange(i + 5, dtype="<u4").tobytes())
        writer.close()
    assert [t.tolist() for t in tokens.SeekableReader(str(tmp_path / "f")).documents(7)] == [list(range(12))]
    data = bytearray((tmp_path / "f").read_bytes())
    data[30] ^= 1
    (tmp_path / "g").write_bytes(data)
    with pytest.raises(Exception):
        reader = tokens.SeekableReader(str(tmp_path / "g"))
        [reader.frame(i) for i in range(len(reader.index))]


def discounts(counts):
    n = [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n[0], n[1]), (2, n[1], n[2]), (3, n[2], n[3]))]
    return [0.0] + [min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1)]


@pytest.mark.parametrize("shard_bytes, fan_bits", [(1 << 24, 8), (1 << 13, 8), (1 << 13, 2)])
def test_language_model(docs, none, shard_bytes, fan_bits):
    learn = id_remainder(10) != 0
    model = kneser_ney.fit(docs, learn, shard_bytes=shard_bytes, fan_bits=fan_bits, bundle_bytes=1 << 12)
    assert shard_bytes > 1 << 13 or model.word_bits > 2  # shards that are cut in several steps
    found = kneser_ney.score(docs, model).collect()
    texts = [(r.doc_id, [*words_of(r.text), None]) for r in docs.collect()]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    single, pairs = Counter(), Counter()
    for i, t in texts:
        if crc(i) % 10:
            single.update(t)
            pairs.update(zip(["<s>", *t[:-1]], t, strict=True))
    total, types = sum(single.values()), len(single)
    d, ended = discounts(pairs), Counter(w for _, w in pairs)
    low, whole, opened = discounts(ended), Counter(), defaultdict(Counter)
    for (u, _), c in pairs.items():
        whole[u] += c
        opened[u][min(c, 3)] += 1
    mass = sum(low[min(c, 3)] for c in ended.values()) / len(pairs)
    expected = []
    for i, t in texts:
        score = 0.0
        for u, w in zip(["<s>", *t[:-1]], t, strict=True):
            lower_p = max(ended[w] - low[min(ended[w], 3)], 0) / len(pairs) + mass / (types + 1)
            c = pairs[u, w]
            back = sum(d[k] * n for k, n in opened[u].items()) / whole[u] if whole[u] else 1.0
            score += math.log10((max(c - d[min(c, 3)], 0) / whole[u] if whole[u] else 0.0) + back * lower_p)
        base = sum(math.log10((single[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        expected.append((str(i), len(t), sum(single[w] > 0 for w in t), base, score))
    mine = sorted((str(r.id), r.n_tokens, r.n_known, r.base_score, r.score) for r in found)
    assert (model.tokens, model.types) == (total, types)
    for a, b in zip(mine, sorted(expected), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) and math.isclose(a[4], b[4], rel_tol=1e-9)
    assert all(r.score == 0 for r in kneser_ney.score(docs, kneser_ney.fit(none, learn)).collect())
    assert kneser_ney.score(none, model).count() == 0


ITEMS = [
    (1, "What colour is the clear sky at noon on a dry day? It is a deep and even blue."),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"),
    (3, "Rivers run down to the sea. The sea is not full and never will be so they say."),
    (4, None), (5, ""), (6, "tiny"),
]


@pytest.mark.parametrize("index_bytes", [8 << 20, 120])
def test_decontamination(spark, docs, none, index_bytes):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["the", "sea", "is", "a", "day", "blue", "alpha", "word", "never", "run"]) for _ in range(n))
    texts = [
        (1, f"{filler(300)} {ITEMS[0][1].upper()} {filler(200)}", [1]), (2, f"{filler(50)}, {ITEMS[1][1]}.", [2]), (3, f"{ITEMS[2][1]} {ITEMS[0][1]}", [1, 3]),
        (4, ITEMS[0][1].split("?")[0] + "? " + filler(40), []), (5, filler(2000), []), (6, None, []), (7, "", []), (8, " ".join(reversed(ITEMS[1][1].split())), []),
        (9, f"{filler(30)} {ITEMS[2][1]} {filler(30)}", [3]), (9, f"{filler(30)} {ITEMS[2][1]} {filler(30)}", [3]), (None, ITEMS[1][1], [2]),
        (10, "just a tiny text", [6]),
    ]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in texts], "doc_id long, text string, items int, digest long").repartition(2)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    found = decontam.find_leaks(frame, benchmark, index_bytes=index_bytes)
    assert sorted((str(r.doc_id), r.items, r.leaked) for r in found.collect()) == sorted((str(i), e, bool(e)) for i, _, e in texts)
    kept = decontam.remove_leaks(frame, benchmark, index_bytes=index_bytes)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert not any(r.leaked for r in decontam.find_leaks(docs, benchmark.limit(0)).collect())
    assert decontam.find_leaks(none, benchmark).count() == 0


def test_scores_do_not_depend_on_slices(spark):
    """Borderline passages: parts of items, which score near the threshold."""
    rng = random.Random(16)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 60)))) for i in range(40)] + [(None, "an item without any id at all")]
    texts = [(i, " ".join((words := items[i % 40][1].split())[: int(len(words) * rng.uniform(0.6, 0.95))]) + " and more words" * (i % 5)) for i in range(200)]
    texts += [(900, " ".join(rng.choices(vocabulary, k=60_000)) + " " + items[7][1]), (901, items[40][1])]
    docs, benchmark = (spark.createDataFrame(rows, schema) for rows, schema in ((texts, "doc_id long, text string"), (items + items[:9], "item_id long, text string")))
    found = [{r.doc_id: (r.leaked, r.items, r.best_score) for r in decontam.find_leaks(docs, benchmark, overlap=0.3, index_bytes=size).collect()} for size in (8 << 20, 2500, 700, 150)]
    assert 20 < sum(leaked for leaked, _, _ in found[0].values()) < 195 and 7 in found[0][900][1] and found[0][901][:2] == (True, [])
    for other in found[1:]:
        for doc, (leaked, ids, score) in found[0].items():
            assert other[doc][:2] == (leaked, ids) and math.isclose(other[doc][2], score, rel_tol=1e-12), doc
    # And against BM25 written out plainly, over all items.
    split = {i: words_of(t) for i, t in items}
    df, mean = Counter(w for ws in split.values() for w in set(ws)), sum(map(len, split.values())) / len(split)

    def part(word, ws):
        tf = ws.count(word)
        return math.log(1 + (len(split) - df[word] + 0.5) / (df[word] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))

    for doc, text in texts[:200]:
        score = lambda ws, have: sum(part(w, ws) for w in set(ws) & have) / sum(part(w, ws) for w in set(ws))
        if len(words_of(text)) <= min(map(len, split.values())):
            best = max(score(ws, set(words_of(text))) for ws in split.values())
            assert found[0][doc][2] == 0 or math.isclose(found[0][doc][2], best, rel_tol=1e-9)


def test_wand_finds_what_full_scoring_finds():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randint(8, 15)))) for i in range(90)]
    for index in decontam.build_index(items, block=4).parts:
        for _ in range(200):
            terms = sorted(rng.sample(range(len(index.postings)), 20))
            full = defaultdict(float)
            for t in terms:
                for i, v in zip(*index.postings[t], strict=True):
                    full[i] += v
            got = dict(decontam.retrieve(index, terms, 0.5))
            assert set(got) == {i for i, v in full.items() if v >= 0.5 + 1e-12 or (v >= 0.5 and i in got)}


def brute_marginals(energy, pairs):
    """Sum over all labellings of one sequence."""
    n = len(energy)
    total, one = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> t & 1 for t in range(n)]
        weight = math.exp(sum(energy[t] * y[t] for t in range(n)) + sum(pairs[y[t - 1], y[t]] for t in range(1, n)))
        total += weight
        one += weight * np.array(y)
    return one / total


def test_crf_marginals():
    rng = np.random.default_rng(8)
    pairs = rng.normal(size=(2, 2))
    lengths = [1, 4, 9, 2, 7]
    energy = [rng.normal(size=n) * 2 for n in lengths]
    first = np.concatenate([np.arange(n) == 0 for n in lengths])
    p, _, _ = crf.marginals(np.concatenate(energy), first, pairs)
    assert np.allclose(p, np.concatenate([brute_marginals(e, pairs) for e in energy]))


def test_crf_gradient():
    """The gradient against finite differences of the log likelihood, summed over all labellings."""
    rng = np.random.default_rng(8)
    texts = ["vile words run here", "clean", "some more clean words here now"]
    (_, codes, starts), *_ = crf.blocks(pa.array(texts), 1)
    tokens = crf.tokenize(codes, starts)
    labels = rng.integers(0, 2, len(tokens.words))
    buckets, at = np.unique(tokens.features, return_inverse=True)
    tokens.features = at.reshape(tokens.features.shape)
    weights, pairs = rng.normal(size=len(buckets)), rng.normal(size=(2, 2))

    def likelihood(weights, pairs):
        energy, total = weights[tokens.features].sum(axis=0), 0.0
        cuts = [*np.flatnonzero(tokens.first), len(labels)]
        for lo, hi in zip(cuts, cuts[1:]):
            value = lambda y: energy[lo:hi] @ np.array(y) + sum(pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
            total += value(labels[lo:hi].tolist()) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=hi - lo)))
        return total / len(labels)

    found, found_pairs = crf.likelihood_gradient(tokens, labels, weights, pairs)
    for i in range(len(weights)):
        step = np.zeros(len(weights))
        step[i] = 1e-5
        assert math.isclose(found[i], (likelihood(weights + step, pairs) - likelihood(weights - step, pairs)) / 2e-5, rel_tol=1e-5, abs_tol=1e-8)
    for i, j in itertools.product((0, 1), (0, 1)):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert math.isclose(found_pairs[i, j], (likelihood(weights, pairs + step) - likelihood(weights, pairs - step)) / 2e-5, rel_tol=1e-5, abs_tol=1e-8)


def test_toxic_words_count_texts_once(spark, monkeypatch):
    """Repeated rows, copies under other ids, one id with two texts, texts of both labels."""
    rows = [(i, f"vile grub number{i}", 1) for i in range(12)] + [(100 + i, f"clean word number{i}", 0) for i in range(30)]
    rows += [rows[0]] * 5 + [(50 + i, "vile copy of a text", 1) for i in range(9)] + [(3, "another text of that id", 0), (200, "both labels", 1), (200, "both labels", 0), (300, "word " * 30_000, 0), (None, "no id", 1), (301, None, 0)]
    seen, real = [], crf._word_counts
    monkeypatch.setattr(crf, "_word_counts", lambda texts: seen.extend(map(tuple, texts.collect())) or real(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    assert crf.fit(frame) is not None
    assert Counter(seen) == Counter({((t or ""), y == 1) for i, t, y in rows if i is not None})


def toxic_rows():
    rng = random.Random(9)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["vilezorp", "vilemuck", "grubnast", "grubfoul"]
    rows = []
    for i in range(300):
        found = rng.choices(clean, k=rng.randint(20, 80))
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            found.insert(rng.randrange(len(found)), rng.choice(bad))
        rows.append((i, " ".join(found), int(toxic)))
    return rows


def test_toxicity(spark, docs, none):
    rows = toxic_rows()
    texts = spark.createDataFrame([(i, t, 1, 1) for i, t, _ in rows], "doc_id long, text string, toxic int, score int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(9999, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    found = {r.doc_id: r for r in crf.toxicity(texts, labels, id_remainder(3) != 1).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(found[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    for i, t, y in held:
        spans = [t[int(a) : int(b)] for a, b in (s.split(":") for s in found[i].spans.split(",") if s)]
        if y and found[i].predicted:
            assert any(w[:4] in ("vile", "grub") for s in spans for w in s.split())
    other = crf.toxicity(docs.withColumn("score", F.lit("x")), labels, F.lit(True))
    assert other.count() == docs.count()
    assert all(r.score == 0 and r.predicted == 0 for r in crf.toxicity(docs, labels.limit(0), F.lit(True)).collect())
    assert crf.toxicity(none, labels, F.lit(True)).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(10)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["eau", "oux", "ais", "que"], "cc": ["sch", "ung", "ich", "keit"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(3, 40))), lang) for i in range(400) for lang in [rng.choice(sorted(parts))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, "tion the", None), (None, "the ing", "bb")]
    frame = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, score int, bucket string")
    model = langid.fit(frame, id_remainder(5) != 0)
    found = langid.predict(frame, model)
    assert set(frame.columns) - {"score"} <= set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    held = [(i, lang) for i, _, lang in rows[:400] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(none, model).count() == 0
    # A single document; a language that few documents have; very long texts.
    one = langid.fit(frame.filter("doc_id = 3"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(frame.filter("doc_id < 400"), one).collect()} == {rows[3][2]}
    rare = [(2000 + i, "zzyzx qwxyq xxyzz zyxq " * (i + 1), "zz", 1, "x") for i in range(3)] + [(3000, "the tion ing er " * 20_000, "aa", 1, "x")]
    wide = langid.fit(frame.unionByName(spark.createDataFrame(rare, frame.schema)), F.lit(True), fit_rows=60)
    asked = spark.createDataFrame([(1, "qwxyq zzyzx zyxq"), (2, "the tion er ing " * 30_000), (3, "sch ung ich keit ungich")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(asked, wide).orderBy("doc_id").collect()] == ["zz", "aa", "cc"]
    nothing = langid.fit(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_weights():
    """The fit against follow-the-regularised-leader written out coordinate by coordinate."""
    rng = np.random.default_rng(13)
    buckets, classes, rate, beta, l1, l2 = 7, 3, 0.5, 1.0, 0.05, 0.02
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(buckets, rng.integers(1, 5), replace=False)).astype(np.int32)
        rows.append((at, rng.random(len(at)).astype(np.float32), int(rng.integers(classes)), float(rng.uniform(0.5, 2))))
    weights, bias = langid.fit_ftrl(rows, classes, rate, beta, l1, l2, epochs=3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        one, two = (0.0, 0.0) if i == "bias" else (l1, l2)
        if abs(z[i, k]) <= one:
            return 0.0
        return -(z[i, k] - math.copysign(one, z[i, k])) / ((beta + math.sqrt(n[i, k])) / rate + two)

    for _ in range(3):
        for at, value, label, share in rows:
            features = [*zip(at.tolist(), value.tolist()), ("bias", 1.0)]
            scores = [math.exp(sum(weight(i, k) * v for i, v in features)) for k in range(classes)]
            before = {(i, k): weight(i, k) for i, _ in features for k in range(classes)}
            for i, v in features:
                for k in range(classes):
                    g = share * v * (scores[k] / sum(scores) - (k == label))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / rate
                    z[i, k] += g - sigma * before[i, k]
                    n[i, k] += g * g
    for k in range(classes):
        assert math.isclose(bias[k], weight("bias", k), rel_tol=1e-6, abs_tol=1e-9)
        for i in range(buckets):
            assert math.isclose(weights[i, k], weight(i, k), rel_tol=1e-5, abs_tol=1e-7)
    assert (weights == 0).any() and (weights != 0).any()
    scores, labels = rng.normal(size=(200, 3)) * 8, rng.integers(0, 3, 200)
    scores[np.arange(200), labels] += 4.0
    found, ones = langid._temperature(scores, labels, np.ones(200)), np.ones(200)
    loss = lambda t: -np.log(langid._softmax(scores / t)[np.arange(200), labels]) @ ones
    assert all(loss(found) <= loss(found * f) + 1e-9 for f in (0.9, 0.95, 1.05, 1.1))
