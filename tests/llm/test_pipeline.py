"""Each stage of the corpus pipeline against a brute-force version, each on its own input."""

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import copies, mixing
from test_operators import WORD, brute_fingerprint, brute_targets, groups_of

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    """(input, output) of every stage, with extra rows that stages must drop."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    own = [(900_001, "12 34 ... !?", None, "x", 12), (900_002, None, None, None, None), (900_003, f"Der und die das. {item} Und das.", "de", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema)).cache()
    found = []
    for _, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(DATA)).cache()
        found.append((docs, out))
        docs = out
    return found


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_language_stage(steps):
    before, after = steps[0]
    lost = ids(before) - ids(after)
    assert {900_001, 900_002} <= set(lost) and sum(lost.values()) <= 2 + 0.02 * before.count()


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_copies_stage(steps):
    """One row of each group of five-word Jaccard 0.8, and no other row is lost."""
    before, after = steps[1]
    rows = before.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    part = groups_of(sets, lambda a, b: 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b))
    least = {}
    for r, p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, r.doc_id), r.doc_id)
    assert ids(after) == Counter(least.values())


def test_sets_that_share_a_hash_are_told_apart(spark):
    """Two sets under one name become two classes; copies of one set stay one, other names are kept."""
    rows = [(1, 7, 10), (2, 7, 11), (3, 7, 10), (4, 8, 10), (5, 8, 10), (6, 9, 12)]
    signed = spark.createDataFrame(rows, "id long, class long, second long")
    found = {r.id: r["class"] for r in copies.told_apart(signed).collect()}
    assert found[1] == found[3] != found[2] and {found[1], found[2]}.isdisjoint({7, 8, 9})
    assert [found[i] for i in (4, 5, 6)] == [8, 8, 9]
    assert {r.id: r["class"] for r in copies.told_apart(signed.filter("class > 7")).collect()} == {4: 8, 5: 8, 6: 9}
    assert copies.told_apart(signed.limit(0)).count() == 0


def test_common():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 8000, 3000)]
    assert copies.common(sets[:3], sets[2:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]
    assert copies.common(sets, sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


@pytest.mark.parametrize("part", [1024, 4])
def test_near_copies_are_those_of_jaccard(spark, part, monkeypatch):
    """Edited copies go (also those far apart in SimHash), looser ones stay; ids may be null or repeated."""
    monkeypatch.setattr(copies, "PART_MEMBERS", part)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts = []
    for n in range(30):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 12):
            changed = list(base)
            for at in rng.sample(range(120), edits):
                changed[at] = word()
            texts.append(" ".join(changed))
    # Copies of copies: a chain in which each step changes two more words.
    base = [word() for _ in range(120)]
    for step in range(12):
        base[step * 10 + 3], base[step * 10 + 4] = word(), word()
        texts.append(" ".join(base))
    texts += ["same short text"] * 5 + [None, "", "Same  SHORT text"]
    rows = [(None if i % 9 == 4 else i - 1 if i % 9 == 7 else i, t, i % 4) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, "only one without id", 1), (5, "another text of that id", 1)]

    sets = [shingles(t) for _, t, _ in rows]
    part = groups_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    assert any(part[i] == part[j] and (fps[i] ^ fps[j]).bit_count() > 4 for i in range(len(rows)) for j in range(i))
    groups = {}
    for r, p in zip(rows, part, strict=True):
        groups.setdefault(p, []).append(r)
    expected = Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(DATA))
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert ids_of(kept) == expected
    assert all(any((r.doc_id, r.text, r.n) == x for x in rows) for r in kept)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), str(DATA)).count() == 0


def ids_of(rows):
    return Counter(r.doc_id for r in rows)


def test_leak_stage(spark, steps):
    before, after = steps[2]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before.collect() if any(" ".join(i) in " ".join((r.text or "").lower().split()) for i in items)}
    assert ids(after) == ids(before) - Counter({d: 9 for d in leaked}) and 900_003 in leaked


def test_mix_stage(steps):
    before, after = steps[3]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {d: n for d, n in taken.items() if n}


def test_token_stage(steps):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = steps[4]
    plain, expected, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for r in sorted(before.collect(), key=lambda r: (r.doc_id, r.text.encode())):
        tokens = np.array(plain.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        expected.append((r.doc_id, start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert sorted(map(tuple, after.collect()), key=lambda r: r[1]) == expected
    assert after.agg(F.count("*")).first()[0] == before.count()


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    """Null and repeated ids, one id with several texts, exact repeats, columns of clashing names, long texts."""
    rng = random.Random(12)
    stems = {"en": ["tion", "the", "ing", "er"], "de": ["sch", "ung", "ich", "keit"]}
    made = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(n))
    rows = [(i, made(lang := rng.choice(["en", "de"]), rng.randint(20, 60)), lang, rng.choice(["a", "b", "c", None])) for i in range(80)]
    rows += [(None, made("en", 30), "en", "a") for _ in range(5)] + [(5, made("de", 25), "de", "b"), (5, made("en", 28), "en", "a")]
    rows += [rows[3]] * 3 + [(None, rows[4][1], "en", "c"), (200, rows[80][1], "en", "b"), (201, None, None, None), (202, "", "en", "a"), (203, "12 34 !?", None, "b")]
    rows += [(204, made("en", 20_000), "en", "b")]
    item = "What does the meter show at noon? It shows exactly forty two units of flow."
    rows += [(205, made("en", 15) + " " + item + " " + made("en", 15), "en", "a")]
    rows = [(i, t, lang, src, None if t is None else len(t), n, "x", "y", 7, "z") for n, (i, t, lang, src) in enumerate(rows)]
    rows += [rows[10]]  # equal in every column
    schema = "doc_id long, text string, lang string, source string, n_chars long, number long, row string, found_lang string, __h1 long, words string"
    for name, frame in (("documents", spark.createDataFrame(rows, schema)), ("benchmark", spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))):
        frame.repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs, sf_dir = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}"
    key = lambda r: (r.doc_id, r.text, r.number)
    outs = []
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, outs[-1] if outs else docs, sf_dir).cache()
        assert out.columns == docs.columns
        outs.append(out)
    language, near, clean, mixed = ([*frame.collect()] for frame in outs)
    assert Counter(map(key, language)) == Counter((r[0], r[1], r[5]) for r in rows if r[0] not in (201, 202, 203))
    sets = [shingles(r.text) for r in language]
    part = groups_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    texts = {}
    for r, p in zip(language, part, strict=True):
        texts.setdefault(p, []).append(r)
    assert len(near) == len(texts) and all(sum(r.doc_id == n.doc_id and r.text == n.text for n in near for r in group) >= 1 for group in texts.values())
    least = Counter(min((r.doc_id for r in group if r.doc_id is not None), default=None) for group in texts.values())
    assert Counter(r.doc_id for r in near) == least and sum(r.doc_id is None for r in near) == 4 and sum(r.doc_id == 5 for r in near) == 3
    assert Counter(map(key, clean)) == Counter(key(r) for r in near if r.doc_id != 205) and any(r.doc_id == 205 for r in near)
    sizes = Counter()
    for r in clean:
        sizes[r.source] += len(WORD.findall(r.text))
    taken, source_of = Counter(), {r.number: r for r in clean}
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
        assert source_of[r.number].text.startswith(r.text) and source_of[r.number].doc_id == r.doc_id
    targets = brute_targets(dict(sizes))
    assert all(0 <= targets[s] - taken[s] < 1 for s in sizes)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in mixed)
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0


def test_language_stage_without_languages(spark):
    """Where no row tells its language, only texts without a letter go."""
    rows = [(1, "some words here", None, "s"), (2, "123 !!", None, "s"), (3, None, None, "s"), (4, "é", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]
