"""Vector codes, fill-in-middle and line labels against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from quillon.llm import crf, fim, linecrf, vafile
from quillon.llm.queries import op13_quality_rules, op12_fill_in_middle, op11_vector_codes


# Vector codes
def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Loops over all entries; rows are (id, vector, label)."""
    kept = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-max(longest, 1) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label, v) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _, _ in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _, _ in kept:
                members.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, found in members.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out, by_label = [], {}
    for i, v, label, _ in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=str)


def vector_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, np.round(rng.normal(size=dim), 2).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[3][1], None) for i in range(40)]
    return rows + [(None, rows[5][1], 1), (None, [0.0] * dim, None), (7, rows[9][1], 2), (7, rows[9][1], 2), (90_001, None, 1), (90_002, [float("nan")] * dim, 1), (90_003, [None] * dim, 1), (90_004, [float("inf")] * dim, 1)]


def write(spark, folder, rows, schema, name):
    table = spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame(rows, schema)
    table.write.parquet(f"file://{folder}/{name}.parquet")


@pytest.mark.parametrize(("n", "dim"), [(300, 32), (30, 16), (0, 16)])
def test_vector_codes_equal_brute_force(spark, tmp_path, n, dim):
    rows = vector_rows(n, dim, 3) if n else []
    write(spark, tmp_path, [(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, ints int", "embeddings")
    found = sorted((tuple(r) for r in op11_vector_codes(spark, f"file://{tmp_path}").collect()), key=str)
    assert found == plain_codes(rows)


def test_vectors_of_several_lengths_and_sizes(spark):
    rows = [(i, [float(i % 7), -1e300, 3.5][: 1 + i % 3], i % 2) for i in range(90)] + [(200, [], 0)]
    coded, books = vafile.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=8)
    found = {r.vec_id: r for r in coded.collect()}
    assert len(found) == 91 and books.shape == (16, 8, 1)
    decoded = {r.vec_id: r.ints for r in vafile.decode(coded, books).collect()}
    exact = lambda v: [max(-vafile.LARGEST, min(vafile.LARGEST, int(np.floor(x * 256)))) for x in v]
    for i, v, _ in rows:
        ints = exact(v) + [0] * (16 - len(v))
        assert found[i].error == sum((a - b) ** 2 for a, b in zip(ints, decoded[i], strict=True))


def test_bounds_keep_the_nearest_and_drop_most():
    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-300, 300, (64, 4)), rng.integers(-400, 400, (5000, 4))
    file = vafile.VAFile(entries)
    distance = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    index, least = file.nearest(queries)
    assert (index == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
    assert file.candidates(queries).mean() < 0.2


def test_hot_and_rare_labels_add_up(spark):
    rows = [(i, f"c{i}", i % 13, "hot" if i % 3 else f"rare{i}" if i % 2 else None) for i in range(6000)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label string")
    sums = {}
    for _, _, error, label in rows:
        sums[label] = sums.get(label, 0) + error
    found = vafile.with_label_error(coded).collect()
    assert len(found) == 6000 and all(r.label_error == sums[r.label] for r in found)


# Fill-in-middle
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "a", "  lead", "trail \n", "one two  three\tfour\nfive", "é ü ß 日本 語  x" * 20, "a <P> b", "c <S>", "<M>", "<", "P>", "< P> <<S <", "w " * 70_000,
    "x" * 100_000, " no break ", "\x0b\x0c mixed \x1c\x85 ", "\x00nul \x00", "🙂 🙂🙂  🙂",
]


def plain_fim(doc_id, text):
    text, key = text or "", "" if doc_id is None else str(doc_id)
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return (doc_id, len(units), form, len(prefix), len(middle), sha(out), sha(text))


def test_fill_in_middle_equals_brute_force(spark, tmp_path):
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "null id here"), (None, "null id here"), (3, "again"), (3, "again")]
    write(spark, tmp_path, [(*r, "f", 1) for r in rows], "doc_id long, text string, form string, n int", "documents")
    found = [tuple(r) for r in op12_fill_in_middle(spark, f"file://{tmp_path}").collect()]
    assert sorted(found, key=str) == sorted((plain_fim(*r) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for size, share in ((0, 0.5), (1, 1.0), (511, 0.3), (512, 1.0), (5000, 0.01), (5000, 0.9)):
        bits = rng.random(size) < share
        vector = fim.BitVector(bits)
        places = np.arange(size + 1)
        assert (vector.rank(places) == np.concatenate([[0], np.cumsum(bits)])).all()
        ones = np.flatnonzero(bits)
        assert (vector.select(np.arange(len(ones))) == ones).all()


# Lines
WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for found in windows.values() if len(found) > 1 for i in found for k in range(8)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), twice, len(repeated), failed


PROSE = "The quick brown fox jumps over the lazy dog. And then it rested near a quiet river for most of the day."
NOISE = "BUY!! NOW!! ### $$$ click | here | home | login | *** FREE!! %%% OFFER!! | menu | next >>"


def documents(n):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    prose = lambda k: "\n".join(" ".join(word() for _ in range(rng.integers(8, 20))).capitalize() + "." for _ in range(k))
    junk = lambda k: "\n".join(" ".join(word().upper() + "!!" if rng.random() < 0.5 else word() + "###" for _ in range(rng.integers(5, 15))) for _ in range(k))
    return [(i, prose(rng.integers(3, 8)) if i % 4 else junk(rng.integers(3, 8)), int(i % 4 > 0)) for i in range(n)]


ODD = [
    (1000, None), (1001, ""), (1002, "\n\n\n"), (1003, " \t \n x"), (1004, "a b c d e f g h " * 9), (1005, "same line here\n" * 30), (1006, "w " * 60_000), (1007, "y" * 90_000), (1008, "é ü ß\n日本 語"),
    (1009, " same\nsame\n same\nsame\r\nsame"), (1010, PROSE + "\n" + NOISE), (1010, PROSE + "\n" + NOISE), (None, PROSE), (None, PROSE + " " + PROSE), (1011, "\x00 \x1c a\x85b"),
]


def test_base_counts_equal_brute_force(spark, tmp_path):
    made = documents(200)
    rows = [(i, t) for i, t, _ in made] + ODD
    write(spark, tmp_path, [(*r, "q", True) for r in rows], "doc_id long, text string, quality string, kept boolean", "documents")
    write(spark, tmp_path, [(i, q, 0) for i, _, q in made] + [(None, 1, 0), (5, None, 0), (6, 0, 0), (6, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int", "labels")
    found = op13_quality_rules(spark, f"file://{tmp_path}").collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in found), key=str) == sorted(((i, *plain_counts(t)) for i, t in rows), key=str)
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in found)
    good = {i: q for i, _, q in made}
    kept = [r.kept == bool(good[r.doc_id]) for r in found if r.doc_id in good and not r.base_failed]
    assert np.mean(kept) == 1.0


def test_lines_learnt_from_some_documents_tell_the_others(spark):
    made = documents(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made if i % 3], "doc_id long, quality int")
    field = linecrf.fit(docs, labels, fit_rows=50)
    found = {r.doc_id: r for r in linecrf.quality(linecrf.label_lines(docs, field)).collect()}
    held = [found[i].kept == bool(q) for i, _, q in made if i % 3 == 0 and not found[i].base_failed]
    assert len(held) > 100 and np.mean(held) > 0.98


def test_mixed_documents_lose_their_noise(spark):
    made = documents(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    field = linecrf.fit(docs, spark.createDataFrame([(i, q) for i, _, q in made], "doc_id long, quality int"))
    prose, junk = made[1][1].split("\n"), made[0][1].split("\n")
    mixed = spark.createDataFrame([(1, "\n".join(junk[:2] + prose)), (2, "\n".join(prose[:1] + junk))], "doc_id long, text string")
    labelled = linecrf.label_lines(mixed, field)
    found = {r.doc_id: r for r in linecrf.quality(labelled).collect()}
    assert found[1].boilerplate == [0, 1] and found[1].kept and not found[2].kept
    assert {r.doc_id: r.content for r in linecrf.content_only(mixed, labelled).collect()}[1] == "\n".join(prose)


def test_without_labels_every_line_is_content(spark):
    docs = spark.createDataFrame([(1, PROSE + " " + NOISE), (2, "short")], "doc_id long, text string")
    assert linecrf.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    found = {r.doc_id: r.kept for r in linecrf.quality(linecrf.label_lines(docs, None)).collect()}
    assert found == {1: True, 2: False}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linecrf.fit(none, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert linecrf.label_lines(none, None).collect() == []


def test_viterbi_equals_trying_all_labels():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 7, 4)
        first = np.zeros(sizes.sum(), bool)
        first[np.cumsum(sizes) - sizes] = True
        energy, pairs = rng.normal(size=len(first)) * 2, rng.normal(size=(2, 2)) * 2
        expected = []
        for lo, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
            value = lambda y: sum(energy[lo + t] * y[t] for t in range(len(y))) + sum(pairs[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
            expected += max(itertools.product((0, 1), repeat=int(n)), key=value)
        assert linecrf.viterbi(energy, first, pairs).tolist() == expected


def test_field_gradient_is_that_of_the_line_likelihood():
    """The field's gradient (shared with the toxic spans) against finite differences, on line features."""
    _, lines = linecrf.analyse([PROSE + "\n" + NOISE, "one\n\ntwo words\n" + PROSE, "x"])
    labels, rng = np.array([1, 0, 1, 1, 0, 1, 0]), np.random.default_rng(0)
    weights, pairs = rng.normal(size=80), rng.normal(size=(2, 2))
    last = np.concatenate([lines.first[1:], [True]])

    def likelihood(w, m):
        energy, total, at = w[lines.features].sum(axis=0), 0.0, 0
        for end in np.flatnonzero(last) + 1:
            value = lambda y: sum(energy[at + t] * y[t] for t in range(len(y))) + sum(m[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
            total += value(labels[at:end]) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=int(end - at))))
            at = end
        return total / len(labels)

    gradient, step = crf.likelihood_gradient(lines, labels, weights, pairs)
    for j in np.unique(lines.features)[:12]:
        move = np.eye(80)[j] * 1e-6
        assert abs((likelihood(weights + move, pairs) - likelihood(weights - move, pairs)) / 2e-6 - gradient[j]) < 1e-5
    for a, b in itertools.product((0, 1), repeat=2):
        move = np.zeros((2, 2))
        move[a, b] = 1e-6
        assert abs((likelihood(weights, pairs + move) - likelihood(weights, pairs - move)) / 2e-6 - step[a, b]) < 1e-5
