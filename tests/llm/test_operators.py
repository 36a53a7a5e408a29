"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from basinflow.llm import bpe, html_text, language, near_copies, packing, pii, quality, search, sharding, simhash, substrings, suffix
from tests.compare import connect, differ

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, "a b c d " * 3000), (7, "x" * 20000), (8, "é日本語 😀 Σ<|endoftext|> it's 12\x00"), (4, "word"), (None, "a b c d " * 3000), (9, "4111 1111 1111 1111 " * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", i) for i, t in ODD], "doc_id long, text string, score string, lang string, bucket long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def texts(docs) -> dict:
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def brute_fingerprint(text: str) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict) -> dict:
    ids = sorted(prints)
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min(label[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 2)
            changed |= low < label[i]
            label[i] = min(low, label[i])
    return label


def test_simhash(spark, docs):
    prints = {i: brute_fingerprint(t) for i, t in texts(docs).items()}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect()}
    components = brute_components(prints)
    assert found == {i: (f"{f:016x}", components[i]) for i, f in prints.items()}


@pytest.mark.parametrize("pairwise", [2, 64])
def test_simhash_links_of_crowded_blocks(spark, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(3)
    values = {0}
    while len(values) < 120:
        base = rng.choice(sorted(values)) if rng.random() < 0.8 else int(rng.integers(1 << 62))
        values.add(int(base) ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))))
    distinct = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    from basinflow.llm.common import union_components

    roots = {r.node: r.root for r in union_components(simhash.near_fingerprints(distinct)).collect()}
    assert {v: roots.get(v, v) for v in values} == brute_components({v: v for v in values})


def test_near_copies_at_similarity_of_the_job(spark):
    rng = np.random.default_rng(11)
    rows, pairs = [], 0
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        other = list(words)
        for at in rng.choice(200, int(rng.integers(2, 8)), replace=False):
            other[at] = f"v{at}"
        one, two = ({tuple(x[i : i + 5]) for i in range(196)} for x in (words, other))
        pairs += len(one & two) >= 0.8 * len(one | two)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert 20 < pairs < 150
    kept = {r.doc_id for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept) == 300 - pairs and kept >= set(range(0, 300, 2))


def test_near_copies_keep_exactly_one_row_of_a_class(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "other words of no one " * 9, "p"), (None, "other words of no one " * 9, "q"), (None, "other words of no one " * 9, "q"), (1, text, "b"), (1, text, "a"), (1, text + " end", "a"), (None, text, "a"), (2, text, "a"), (3, "short one", "a")]
    found = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 3 and sorted(r.doc_id or 0 for r in found) == [0, 1, 3] and {r.lang for r in found} <= {"p", "a"}


def test_near_copies_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRWISE", 4)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(40)]
    assert [r.doc_id for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_topk_equals_oracle_and_pruning_is_exact(spark):
    assert differ(search.op2_topk_search(spark, SF), connect(SF), search.OP2_SQL) == ""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 8)) * rng.uniform(0.1, 3, (20, 1))
    vectors = np.concatenate([base + rng.standard_normal(base.shape) * 0.02 for _ in range(30)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (None, [1.0] * 8), (903, [])]
    found = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    ints = np.floor(64 * vectors).astype(int)
    for q in range(0, 600, 20):
        scores = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:20]
        mine = found[found.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == best
    walked = search.TopK(np.arange(1000, 1020), ints[:20], 20)
    for at in range(0, 600, 60):
        walked.bucket(np.arange(at, at + 60), ints[at : at + 60][np.argsort(-(ints[at : at + 60] ** 2).sum(axis=1))])
    assert walked.pruned["coordinate"] > 0


def test_topk_of_repeated_ids_and_of_nothing(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(search, "BUCKET_ROWS", 16)
    monkeypatch.setattr(search, "GROUP_BUCKETS", 2)
    monkeypatch.setattr(search, "QUERY_ROWS", 4)
    rng = np.random.default_rng(12)
    rows = [(int(i), [float(x) for x in rng.standard_normal(4) * rng.choice([0.1, 1, 30])]) for i in rng.integers(0, 100, 400)] + [(1, [1.0, 0.0])] * 150
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    sql = search.OP2_SQL.replace("range(1, len(q.v) + 1)", "range(1, least(len(q.v), len(c.v)) + 1)")
    assert differ(search.top_k(frame), con, sql) == ""
    assert search.top_k(frame.limit(0)).count() == 0


def test_suffix_quality(spark, docs):
    known = texts(docs)
    for r in quality.op3_suffix_quality(spark, SF).collect():
        words = known[r.doc_id].encode().split()
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(inside))
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (r.kept and r.base_failed)


def brute_quality(text: str) -> tuple:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, under, most = len(words), set(), 0
    for length in range(1, n):
        at: dict = {}
        for i in range(n - length + 1):
            at.setdefault(tuple(words[i : i + length]), []).append(i)
        twice = [i for places in at.values() if len(places) > 1 for i in places]
        if not twice:
            break
        most = length
        if length >= quality.WINDOW:
            under |= {j for i in twice for j in range(i, i + length)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    failed = n < 20 or 100 * len(under) > 30 * n
    share = sum(len(words[i]) for i in under) / chars if under else 0.0
    kept = not failed and share <= quality.COVERED_LIMIT and (most < quality.LONGEST_WORDS or most <= quality.LONGEST_SHARE * n)
    return n, chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(under), failed, kept, share, most


def test_suffix_quality_equals_brute_force(spark, docs, odd, empty):
    passage = " ".join(f"p{k}" for k in range(60))
    made = [passage + " x " + passage, " ".join([passage, *(f"a{k}" for k in range(300)), passage]), "é b\n\né b\n \né b #$\n", "a b c d e f g h i " * 40]
    some = [t for t in texts(docs).values() if len(t) < 3000] + made
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in quality.repetition_quality(frame).collect()}
    for k, text in enumerate(some):
        wanted = brute_quality(text)
        assert found[k][:7] == wanted[:7] and found[k][8] == wanted[8] and abs(found[k][7] - wanted[7]) < 1e-12, text[:80]
    again = quality.repetition_quality(odd).collect()
    assert len(again) == len(ODD) and quality.repetition_quality(empty).count() == 0
    assert [tuple(r)[1:] for r in again if r.doc_id == 1] == [(0, 0, 0, 0, 0, True, False, 0.0, 0)]
    assert len({tuple(r) for r in again if r.doc_id == 4}) == 1


def test_suffix_quality_by_covered_characters_alone():
    long = " ".join(f"{'long' * 9}{k}é" for k in range(10))
    n, chars, *_, repeated, failed, kept, share, most = quality.measure(" ".join([long, *(f"a{k}" for k in range(60)), long]))
    assert (n, repeated, failed, most, kept) == (80, 20, False, 10, False)
    assert abs(share - 2 * len(long.replace(" ", "")) / chars) < 1e-12 and share > quality.COVERED_LIMIT


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 200):
        x = rng.integers(0, 2, n)
        order, lcp = suffix.suffix_array(x)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        for k in range(1, n):
            a, b = x[order[k - 1] :].tolist(), x[order[k] :].tolist()
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_extendible_hash(spark, docs, odd, empty):
    assert differ(sharding.op4_extendible_hash(spark, SF), connect(SF), sharding.OP4_SQL) == ""
    found = sharding.shard_documents(docs, 4000).toPandas()
    assert len(found) == docs.count()
    for shard, rows in found.groupby("shard"):
        assert rows.n_bytes.sum() == rows.shard_bytes.iloc[0] and len(rows) == rows.shard_docs.iloc[0]
        assert rows.n_bytes.sum() <= 4000 or (rows.oversized.all() and rows.doc_id.nunique() == 1)
    assert sharding.shard_documents(odd, 100).count() == len(ODD)
    assert sharding.shard_documents(empty).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_near_copies_of_one_template_just_not_alike(spark):
    """600 texts of one template in 300 pairs; texts of different pairs share nearly as much as is needed."""
    rng = np.random.default_rng(21)
    base, rows = [f"w{k}" for k in range(177)], []
    for k in range(300):
        own = [f"own{k}x{i}" for i in range(23)]
        words = base + own
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows[:4] for w in [t.split()]]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) > 0.8 > share(sets[0], sets[2]) > 0.75 and share(sets[1], sets[3]) < 0.8
    docs = spark.createDataFrame([rows[k] for k in rng.permutation(600)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one_of_each(docs).collect()) == list(range(0, 600, 2))


def test_near_copies_with_repeated_words(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:20] * 60)), (3, "a b c d e f g h"), (4, "a b c d e f g h i"), (5, "a b c d e f g h i j k")]
    kept = {r.doc_id for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 3, 5}  # 8 and 9 words: 4 of 5 shingles; 9 and 11: 5 of 7


def test_crowded_pairs_miss_none_and_are_few(spark):
    rng = np.random.default_rng(22)
    base, rows = [f"w{k}" for k in range(300)], []
    for k in range(120):
        a, b = sorted(rng.choice(300, 2, replace=False))
        words = base[: int(rng.integers(120, 300))]
        words[int(rng.integers(0, 100)) :][:0] = []
        for at in rng.choice(len(words), int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    texts = spark.createDataFrame(rows, "node long, text string")
    placed = spark.createDataFrame([((k, 0, len(sets[k])), k) for k in range(120)], "b struct<node: long, fp: long, size: long>, root long")
    found = {tuple(sorted((r.a.node, r.b.node))) for r in near_copies.crowded_pairs(placed, texts).collect()}
    assert true <= found and len(true) > 300


def test_near_copies_recall_at_the_limit(spark):
    """Pairs of similarity 0.8 to 0.9 against brute force: at least 95 in 100 are found."""
    rng = np.random.default_rng(23)
    rows, pairs = [], 0
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 9000, 150)]
        other = words + [f"y{x}" for x in rng.integers(0, 9000, int(rng.integers(14, 40)))]
        one, two = (set(near_copies.shingles(" ".join(x)).tolist()) for x in (words, other))
        close = 5 * len(one & two) >= 4 * len(one | two)
        pairs += close
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert pairs > 200 and 800 - pairs <= kept <= 800 - 0.95 * pairs


def test_discarding_is_of_one_thread(spark):
    from threading import Thread

    from basinflow.llm.common import discarding, materialize

    made = []
    with discarding(spark):
        inner = materialize(spark.range(3))
        other = Thread(target=lambda: made.append(materialize(spark.range(5))))
        other.start()
        other.join()
        assert inner.count() == 3
    assert made[0].count() == 5
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_simhash_of_awkward_rows(spark, odd, empty):
    found = simhash.simhash_groups(odd).collect()
    assert len(found) == len(ODD)
    prints = {i: brute_fingerprint(t or "") for i, t in ODD if i is not None}
    components = brute_components(prints)
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found if r.doc_id is not None} == {(i, f, components[i]) for i, f in prints.items()}
    assert next(r.component_id for r in found if r.doc_id is None) == 6  # the text of document 6
    assert simhash.simhash_groups(empty).count() == 0


def test_packing(spark, docs, odd):
    token = library()
    for frame in (docs, odd):
        found = packing.pack_documents(frame).toPandas().sort_values(["sequence_id", "offset"])
        lengths = found.groupby("sequence_id").length.sum()
        assert (found.offset == found.groupby("sequence_id").length.cumsum() - found.length).all() and lengths.max() <= 4096
        assert all(n == 4096 or n & (n - 1) == 0 for n in lengths)
    known = texts(docs)
    for doc, rows in packing.pack_documents(docs).toPandas().groupby("doc_id"):
        ids = np.array([*token.encode(known[doc], add_special_tokens=False).ids, 2], "<u4")
        rows = rows.sort_values("start")
        assert rows.length.sum() == len(ids) == rows.doc_tokens.iloc[0]
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_packing_of_nothing(spark, empty):
    assert packing.pack_documents(empty).count() == 0


def test_packing_chooses_by_sum_of_squares():
    rng = np.random.default_rng(8)
    for _ in range(200):
        packer = packing.Packer(length=40, unit=4, most_open=99)
        for fill in sorted(rng.integers(1, 37, 6).tolist(), reverse=True):
            packer.open.append((fill, []))
            packer.levels[fill // 4] += 1
        size, sums = int(rng.integers(1, 40)), {}
        for k in range(-1, 6):
            fills = [f for f, _ in packer.open]
            to = size + (fills.pop(k) if k >= 0 else 0)
            if to <= 40:
                counts = Counter(f // 4 for f in [*fills, to] if 40 - f >= 4)
                sums[k] = sum(n * n for n in counts.values())
        chosen = packer.best_window(size)
        assert sums[chosen] == min(sums.values()) and (chosen == min((k for k in sums if k >= 0 and sums[k] == sums[chosen]), default=-1))


def test_packing_joins_little_at_the_ends_of_tasks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").sample(0.3, 5).toPandas().text
    bpe_ = packing.load(bpe.tokenizer_path())
    total = joined = pieces = 0
    for task in range(10):  # as large as those of 32 tasks over the whole table
        packer = packing.Packer()
        made = []
        for k, text in enumerate(rows[task::10]):
            made += packer.pack(k, np.append(bpe_.encode(text), np.uint32(2)))
        made += packer.finish()
        total, joined, pieces = total + sum(r[2] for r in made), joined + packer.joined, pieces + len(made)
    assert joined <= 0.1 * total and pieces < 1.5 * len(rows)


def brute_removals(rows) -> dict:
    seen: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            seen.setdefault(t[p : p + 50], i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), int(gone.sum()), len(re.findall("1+", "".join("01"[g] for g in gone.tolist()))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, odd, empty):
    made = [(1, "ab" * 40), (2, "b" + "ab" * 60), (3, "x" * 200), (4, "x" * 49), (7, "é" * 100), (8, "zé" + "é" * 60), (9, "\x00" * 120), (10, "a\x00" * 3 + "\x00" * 70), (11, "x" * 50)]
    for frame in (docs, spark.createDataFrame(made, "doc_id long, text string")):
        found = {r[0]: tuple(r[1:]) for r in substrings.repeat_digests(frame).collect()}
        assert found == brute_removals([(i, t.encode()) for i, t in texts(frame).items()])
    assert substrings.repeat_digests(odd).count() == len(ODD) and substrings.repeat_digests(empty).count() == 0
    kept = {(r.doc_id, r.text): r for r in substrings.remove_repeats(odd).collect()}
    assert (1, None) in kept and (None, "") in kept and (4, "word") in kept


def test_levels_find_smaller_docs_only(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 16)
    levels, seen = substrings.SuffixLevels(), {}
    rng = np.random.default_rng(2)
    for doc in range(60):
        strings = [bytes(rng.choice([0, 1], int(n)).astype(np.uint8)) + b"x" * 45 for n in rng.integers(5, 12, 6)]
        docs = np.sort(rng.integers(doc, doc + 3, 6))
        owner, hit = levels.add(strings, docs)
        wanted = []
        for k, s in enumerate(strings):
            wanted += [(k, w) for w in (s[p : p + 50] for p in range(len(s) - 49))]
        for k, w in wanted:
            seen[w] = min(seen.get(w, 1 << 40), int(docs[k]))
        assert owner.tolist() == [k for k, _ in wanted] and hit.tolist() == [seen[w] < docs[k] for k, w in wanted]
    assert len(levels.levels) < 10
    for data, places, _ in levels.levels:
        keys = substrings.suffixes(data, places)
        assert (keys[1:] > keys[:-1]).all()


def test_repeats_of_null_ids(spark):
    rows = [(None, "ab" * 40), (None, "ab" * 40 + "c"), (None, "ab" * 40), (5, "zz" + "ab" * 30), (None, "q" * 80), (None, "q" * 90)]
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 80, 0), (0, 80, 80), (0, 80, 80), (0, 81, 80), (0, 90, 0), (5, 62, 0)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> str:
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def test_pii(spark, docs, odd, empty):
    more = [(10**6 + k, t) for k, t in enumerate(["x@y.z_foo@bar.com q@r.s@t.u", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "+1 (555) 123-4567 +1 2 +44 20 7946 0958.", "é😀 a.b@c.de 😀 +1 (743) 555-3824", "@@a@@b.c@", "1" * 30000, "a@b." * 2000])]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    known = texts(frame)
    for r in pii.personal_spans(frame).collect():
        spans = brute_spans(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [spans.count(k) for k in PATTERNS]
    assert pii.personal_spans(odd).count() == len(ODD) and pii.personal_spans(empty).count() == 0
    assert pii.sanitize(odd).columns == odd.columns and pii.sanitize(odd).count() == len(ODD)


def test_terms_equal_brute_force(spark, docs):
    """PMI / IC of every entity and word over sf0.001 and planted people, all counts by documents."""
    names = ["Quillfeather", "Ann", "Obermann"]
    texts_ = [t for t in texts(docs).values()]
    for k, name in enumerate(names):
        texts_ += [f"{texts_[7 * k + j][:200]} {name} wrote x{k}@corp.example and Shared too {j}" for j in range(3 + k)]
    texts_ += [f"{names[2]} alone {j}" for j in range(4)]
    words = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(PATTERNS["email"], " ", t))}
    values = []
    for t in texts_:
        values.append({t[int(a) : int(b)] for _, a, b in (s.split(":") for s in filter(None, brute_spans(t).split(",")))})
    total, n_t, n_e, n_et, ways = len(texts_), Counter(), Counter(), Counter(), {}
    for t, es in zip(texts_, values):
        n_t.update(words(t))
        n_e.update(es)
        for e in es:
            for w in words(t):
                n_et[e, w] += 1
                ways.setdefault((e, w), set()).add(t)
    wanted = set()
    for (e, w), n in n_et.items():
        if len(ways[e, w]) >= 3 and np.log2(total * n / (n_e[e] * n_t[w])) >= 0.95 * np.log2(total / n_e[e]) and len(w) >= 3:
            wanted.add((e, w))
    rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    assert {(r.entity, r.term) for r in pii.disclosing_terms(rows).collect()} == wanted
    assert ("x0@corp.example", "quillfeather") in wanted and ("x2@corp.example", "obermann") not in wanted


def test_pii_of_very_many_matches(spark):
    rows = spark.createDataFrame([(1, "a@b.cd é\n" * 30_000)], "doc_id long, text string")
    found = pii.personal_spans(rows).first()
    assert found.n_email == 30_000 and found.spans.endswith(f"email:{9 * 29_999}:{9 * 29_999 + 6}")
    assert pii.sanitize(rows).first().text == "<EMAIL> é\n" * 30_000
    mixed = "Ann wrote a@1.2.3.4 é😀 " * 200 + "x" * 3000 + "1.2.3.4"
    clean = pii.sanitize(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).first().text
    assert clean == "Ann wrote <EMAIL> é😀 " * 200 + "x" * 3000 + "<IP>"


def test_disclosing_terms(spark):
    secret = [(k, f"note {w} from Quillfeather to ann@corp.example today") for k, w in enumerate(["one", "two", "three", "four"])]
    plain = [(100 + k, f"note number {k} from nobody today") for k in range(60)]
    rows = spark.createDataFrame(secret + plain, "doc_id long, text string")
    assert {r.term for r in pii.disclosing_terms(rows).collect()} == {"quillfeather"}
    clean = {r.doc_id: r.text for r in pii.sanitize(rows).collect()}
    assert clean[0] == "note one from <TERM> to <EMAIL> today" and clean[100] == plain[0][1]


@pytest.mark.parametrize("shape", ["Quillfeather: ann@corp.example", "note {}\nQuillfeather: ann@corp.example is\ntoday", "ann@corp.example Quillfeather", "note {}\nfrom ann@corp.example Quillfeather\ntoday"])
def test_disclosing_terms_at_the_edges_of_lines_and_texts(spark, shape):
    ways = ["is", "or", "at", "by"]
    secret = [(k, (f"{shape} {w}" if shape[0] == "Q" else f"{w} {shape}" if shape[0] == "a" else shape.format(k).replace(" is", f" {w}").replace("from", w))) for k, w in enumerate(ways)]
    plain = [(100 + k, f"note {k} from is or at by nobody today") for k in range(60)]
    rows = spark.createDataFrame(secret + plain, "doc_id long, text string")
    assert {r.term for r in pii.disclosing_terms(rows).collect()} == {"quillfeather"}
    assert "<TERM>" in {r.doc_id: r.text for r in pii.sanitize(rows).collect()}[0]


def test_disclosing_terms_of_whole_texts(spark):
    plain = [(100 + k, f"note number {k} from nobody today is or at by") for k in range(60)]
    for name, shape in (("quillfeather", "from Quillfeather\nnote ann@corp.example {}"), ("quillfeather", "Quillfeather " + "from nobody today " * 20 + "ann@corp.example {}"), ("ann", "note from Ann ann@corp.example {}"), ("bo", "note from Bo x@corp.example {}"), ("\u738b\u82b3", "note \u738b\u82b3 x@corp.example {}")):
        rows = spark.createDataFrame([(k, shape.format(w)) for k, w in enumerate(["is", "or", "at", "by"])] + plain, "doc_id long, text string")
        assert {r.term for r in pii.disclosing_terms(rows).collect()} == {name}


def test_language(spark, odd, empty):
    found = language.op8_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = found.merge(truth, on="doc_id").query("held_out")
    assert (held.lang == held.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()
    assert set(found[found.held_out].doc_id) == {i for i in found.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    parsed = {r["doc_id"]: r["p"] for r in language.identify(odd, (("en", "word two a b c d"), ("xx", "zzz")), ("p", "q")).collect()}
    assert parsed[1] == parsed[2] == parsed[3] == "und" and parsed[4] == "en"
    assert language.identify(empty).count() == 0
    assert language.symbols("İ1 Éa").tolist() == [ord("i"), 32, ord("é"), ord("a")]


def test_language_sample_is_bounded_and_misses_none(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 5)
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, chr(97 + k % 26) * 3, "aa") for k, i in enumerate(free)]
    rows += [(i, f"{'x' * k} z", lang) for lang, i in (("bb", free[0]), ("cc", free[1]), ("dd", free[2])) for k in range(1, 200)] + [(free[0], "z", "bb")] * 300
    fitted = dict(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert sorted(fitted) == ["aa", "bb", "cc", "dd"]
    assert len(fitted["aa"].split()) == 5 and all(len(fitted[x].split(" z")) - 1 <= 5 for x in ("bb", "cc", "dd"))


def test_cross_parsing_counts_phrases():
    parser = language.CrossParser((("a", "the cat sat"), ("b", "le chat est la")))
    sub = "the cat sat"
    count, at, text = 0, 0, "the catz sat"
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sub:
            n += 1
        at, count = at + max(1, n), count + 1
    assert parser.phrases(parser.tables[0], [parser.code[language.symbols(text)]], np.array([0]), 1)[0] == count


def test_cross_parsing_in_portions_is_that_of_the_whole_text(monkeypatch):
    rng = np.random.default_rng(6)
    sample, text = ("".join(rng.choice(list("abc "), n)) for n in (400, 3000))
    parser = language.CrossParser((("a", sample), ("b", sample[::-1] + "z")))
    whole = parser.classify([text, "abz", None, text[:700]])
    monkeypatch.setattr(language, "PORTION", 7)
    assert parser.classify([text, "abz", None, text[:700]]) == whole


def test_bpe_equals_library(docs):
    token, own = library(), bpe.load(bpe.tokenizer_path())
    rng = np.random.default_rng(4)
    made = ["", "x" * 9000, "ab" * 7000, "日本語テキスト" * 300, "ΑΣ ΣΑΣ.", "İstanbul é ́x", "<|endoftext|>hi<|startoftext|> <|END|>", "it's we'll", "\x1c\x1d!!"]
    made.append(" ".join(f"a{chr(c)}1 {chr(c)}{chr(c)}é" for c in (0x1C89, 0xA7CB, 0x10D50, 0x11BC0, 0x323B0, 0x2FFF, 0xE0FFF)))
    made += ["".join(rng.choice(list("abcdefgh"[:k]), 5000)) for k in (2, 3, 8)] + ["".join(rng.choice(["th", "er", "ing", "tion", "é", "!"], 3000)) for _ in range(3)]
    for text in [*made, *texts(docs).values()]:
        ids = token.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        decoder = bpe.Decoder(own)
        assert "".join([decoder.feed(ids[k : k + 3]) for k in range(0, len(ids), 3)]) == token.decode(ids, skip_special_tokens=False)
    own.memo.clear()
    assert [len(x) > 0 for x in own.stream("word " * 100_000)].count(True) > 5  # in portions
    assert np.concatenate(list(own.stream("word " * 100_000))).tolist() == token.encode("word " * 100_000, add_special_tokens=False).ids
    plain = bpe.Decoder(own, plain=True)
    assert plain.feed(own.encode("Été in 日本")) + plain.finish() == "été in 日本 "


def test_bpe_words_are_normalised_once(spark):
    """Marks after a capital dotted I, which its lower case lets compose anew, and letters that decompose, before and after marks."""
    import unicodedata

    token, own = library(), bpe.load(bpe.tokenizer_path())
    marks = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in range(0x591, 0x5C8)] + [chr(0x1DC0), "\u20d0", "\u3099"]
    letters = [chr(c) for c in range(0xC0, 0x3000) if unicodedata.decomposition(chr(c))]
    made = [f"{a}\u0130{m}{b}" for m in marks for a, b in (("", ""), ("x", "."), ("1", "y"), ("", "\u0307"))]
    rng = np.random.default_rng(9)
    made += [f"{x}{m} ,{x}{m}! {m}{x}" for x in letters for m in rng.choice(marks, 2)]
    made += ["".join(rng.choice(["\u0130", "i", "a", "\u00e9", ",", "1", *marks[:40]], 6)) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        for text in made:
            assert own.encode(text).tolist() == token.encode(text, add_special_tokens=False).ids, ascii(text)
    rows = spark.createDataFrame([(1, "\u0130\u0324"), (2, "\u0130\u05b8.")], "doc_id long, text string")
    for r in packing.pack_documents(rows).collect():
        ids = token.encode(rows.where(f"doc_id = {r.doc_id}").first().text, add_special_tokens=False).ids
        assert r.ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4")[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) + 1


def test_bpe_query(spark, odd, empty):
    token = library()
    assert bpe.round_trip_digests(empty).count() == 0
    for r in bpe.round_trip_digests(odd).collect():
        possible = {t or "" for i, t in ODD if i == r.doc_id}
        assert r.ids_sha256 in {hashlib.sha256(np.array(token.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in possible}


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.op10_html_text(spark, SF).collect():
        wanted = "\n\n".join(t for path, t, _ in html_text.blocks(raw[r.page_id]) if "article" in path)
        assert r.text == wanted and r.n_chars == len(wanted)
    page = "<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One\n <b>two</b><p>Three &lt;x&gt;</article><div class=comments>Nice!</div><script>var a='<p>no</p>'</script>"
    assert [t for _, t, _ in html_text.blocks(page)] == ["Home", "A & B", "One two", "Three <x>", "Nice!"]
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<<<>>> < & &bogus;"), (3, "u", "<<<>>> < & &bogus;")], "page_id long, url string, html string")
    assert html_text.extract_main_text(rows).count() == 4 and html_text.extract_main_text(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["<svg-icon name=x></svg-icon>", "<template-x>", "<select-box></select-box>", "<style-guide/>", "<svg class='a' />", '<svg title="a > b"/>', "<svg/>", "<SVG/>"])
def test_html_raw_tags_end_with_their_names(tag):
    page = f"<div>{tag}</div><article><p>One</p><svg><title>no</title></svg><select ><option>no</select><p>Two</p></article>"
    assert [t for _, t, _ in html_text.blocks(page)] == ["One", "Two"]


def test_html_quotes_count_only_where_values_begin():
    cut = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert cut("<article><p data-x=it's>Hello, it's me and you</p><p>Second</p></article>") == ["Hello, it's me and you", "Second"]
    assert cut("<img alt=don't src=x><p>Two is here. Don't stop.</p>") == ["Two is here. Don't stop."]
    assert cut("<p title='a > b' x = \"c > d\" don't>One</p><!--><p>Two</p><!-- <p>no</p> --!><script a='>'>no</script ><p>Three") == ["One", "Two", "Three"]
    assert [p for p, _, _ in html_text.blocks("<ul class=x><li>a<li id=y>b</ul><p data-class=z>c")] == [("ul", "x", "li"), ("ul", "x", "li", "y"), ("p",)]


def test_html_long_pages():
    import tracemalloc

    page = "<article>" + "<p>Some words of a long page, and more of them.</p>" * 60_000 + "<div>" * 60_000 + "end"
    tracemalloc.start()
    cut = html_text.blocks(page)
    labeller = html_text.BlockLabeller()
    marks = labeller.label([html_text.features(p, {}) for p in [cut[:20_000], *[html_text.blocks("<p>a<p>b")] * 63]])
    assert len(cut) == 60_001 and [len(m) for m in marks] == [20_000, *[2] * 63]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_html_without_telling_names(spark):
    weights = html_text.fit_labeller(spark.read.parquet(f"{SF}/pages.parquet"))
    pages = [html_text.blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(150).collect()]
    found = html_text.BlockLabeller(weights).label([html_text.features(html_text.unnamed(p), {}) for p in pages])
    truth = [np.array([html_text.evidence(path) for path, _, _ in p]) for p in pages]
    right = np.concatenate([(f == t)[t >= 0] for f, t in zip(found, truth)])
    assert right.mean() > 0.9


#: Pages laid out as none of the given ones is, and their main text.
SHAPES = {
    "short blocks": (
        "<nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>Short.</p><ul><li>one</li><li>two</li></ul><pre>x = 1</pre><table><tr><td>12</td><td>13</td></tr></table><p>End.</p></article><footer>Contact us</footer>",
        "Title here|Short.|one|two|x = 1|12|13|End.",
    ),
    "comments under an unknown name": (
        "<div class=top><a href=/>Start</a></div><article><h1>A day at the river</h1><p>The water rose in the night, and by the morning the road was gone.</p><p>Nobody was hurt.</p></article>"
        "<div class='reactions'><p>Great read, thank you!</p><p>I was there too, it was frightening.</p></div><footer>&copy; 2020</footer>",
        "A day at the river|The water rose in the night, and by the morning the road was gone.|Nobody was hurt.",
    ),
    "lists in main": (
        "<header><a href=/>Site</a></header><main><h1>How to bake bread</h1><h2>You need</h2><ul><li>flour</li><li>water</li><li>salt</li></ul><h2>Steps</h2><ol><li>Mix all of it.</li><li>Wait for an hour.</li></ol></main>"
        "<aside><p>Our new book is out now.</p></aside><footer><p>Imprint</p></footer>",
        "How to bake bread|You need|flour|water|salt|Steps|Mix all of it.|Wait for an hour.",
    ),
    "a table": (
        "<div id=menu><ul><li><a href=a>News</a></li><li><a href=b>Sport</a></li></ul></div><article><h1>Results</h1><table><tbody><tr><th>Team</th><th>Points</th></tr><tr><td>Reds</td><td>12</td></tr></tbody></table>"
        "<p>The final is on Sunday.</p></article><div class=newsletter><form>Your address <button>Sign up</button></form></div>",
        "Results|Team|Points|Reds|12|The final is on Sunday.",
    ),
    "advert and comments inside the article": (
        "<nav>Home</nav><article><h1>Old bridges</h1><p>The bridge was built of stone.</p><div class=ad>Buy one, get one free</div><p>It still stands.</p><section class=comments><p>Nice!</p><p>I like bridges.</p></section></article>",
        "Old bridges|The bridge was built of stone.|It still stands.",
    ),
    "links as main text": (
        "<div class=masthead><a href=/>The Post</a></div><main><article><h1>Further reading</h1><p><a href=x>The first volume of letters</a></p><p><a href=y>The second volume of letters</a></p><blockquote>So it goes.</blockquote></article></main><div class=promo>Subscribe today</div>",
        "Further reading|The first volume of letters|The second volume of letters|So it goes.",
    ),
    "a deep article": ("<div>" * 70 + "<article><h1>Deep</h1><p>Text in the deep.</p></article><nav>Up</nav>", "Deep|Text in the deep."),
}


def test_html_other_shapes(spark):
    weights = html_text.fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rows = [(k, name, f"<html><body>{page}</body></html>", "clash", -1) for k, (name, (page, _)) in enumerate(SHAPES.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = {r.url: r.text for r in html_text.extract_main_text(pages, weights).collect()}
    assert found == {name: main.replace("|", "\n\n") for name, (_, main) in SHAPES.items()}
    unseen = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 2 = 1")
    raw = {r.page_id: r.html for r in unseen.collect()}
    for r in html_text.extract_main_text(unseen, weights).collect():
        assert r.text == "\n\n".join(t for path, t, _ in html_text.blocks(raw[r.page_id]) if "article" in path)


def test_html_varied_copies_keep_their_marks(spark):
    rng = np.random.default_rng(3)
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = html_text.blocks(r.html)
        copy, marks = html_text.varied(page, [html_text.evidence(path) for path, _, _ in page], rng)
        assert len(copy) == len(marks) and all(html_text.evidence(path) in (mark, -1) for (path, _, _), mark in zip(copy, marks))
        assert all(0 <= links <= len(text) for _, text, links in copy)
    assert html_text.varied([], [], rng) == ([], []) and html_text.varied([(("p",), "a", 0)], [-1], rng) == ([], [])


def test_html_names_at_any_depth():
    deep = lambda inner: html_text.blocks("<div class=a>" * 5_000 + inner)[0][0]
    assert html_text.evidence(deep("<section><p>x")) == -1 and html_text.evidence(deep("<article><div class=b><p>x")) == 1
    assert html_text.evidence(deep("<article><div class='x-comments'><p>x")) == 0 and len(deep("<nav>" * 3_000 + "x")) < 3 * html_text.NAMED


def test_labeller_gradients():
    model = html_text.BlockLabeller()
    model.w = {n: v.astype(np.float64) for n, v in model.w.items()}
    rng = np.random.default_rng(9)
    x, mask = rng.standard_normal((5, 3, html_text.WIDTH)) * 0.3, np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    labels = rng.integers(0, 2, (5, 3))

    def loss():
        p = html_text._sigmoid(model.logits(x, mask)[0])
        return -(np.where(labels == 1, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, labels)
    for name in model.w:
        at = tuple(rng.integers(0, s) for s in model.w[name].shape)
        model.w[name][at] += 1e-3
        up = loss()
        model.w[name][at] -= 2e-3
        down = loss()
        model.w[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-3


def test_pipeline(spark, odd, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    clash = odd.withColumnsRenamed({"score": "language", "bucket": "row"})
    for frame in (odd, clash, empty):
        for name, stage in pipeline.STAGES:
            made = stage(spark, frame, SF)
            assert made.count() <= max(20, 20 * frame.count())
            if name != "packing":
                assert made.columns == frame.columns
                frame = made


def test_pipeline_equals_brute_force(spark, docs):
    """Every stage's decision over sf0.001, worked out in plain Python."""
    import os

    pipeline = pytest.importorskip("corpus_pipeline")
    from basinflow.session import shared_dir

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    found = pipeline.run(spark, SF).toPandas()
    known = {r["doc_id"]: r["p"] for r in language.identify(docs, names=("p", "q")).select("doc_id", "p").collect()}
    kept = {i: t for i, t in texts(docs).items() if known[i] != "und"}
    label = {i: i for i in kept}
    sets = {i: set(zip(*[(w := t.lower().split())[k:] for k in range(5)])) or {tuple(w)} for i, t in kept.items()}
    changed = True
    while changed:
        changed = False
        for i in sorted(kept):
            for j in kept:
                if label[i] < label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[j], changed = label[i], True
    kept = {i: t for i, t in kept.items() if label[i] == i}
    removed = {i: t.encode() for i, t in kept.items()}
    seen: dict[bytes, int] = {}
    for i in sorted(removed):
        for p in range(len(removed[i]) - 49):
            seen.setdefault(removed[i][p : p + 50], i)
    for i, t in removed.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept[i] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    token, ids = library(), {}
    for i, t in kept.items():
        out, at = "", 0
        for span in filter(None, brute_spans(t).split(",")):
            kind, start, end = span.split(":")
            if int(start) >= at:
                out += t[at : int(start)] + f"<{kind.upper()}>"
            at = max(at, int(end))
        ids[i] = np.array([*token.encode(out + t[at:], add_special_tokens=False).ids, 2], "<u4")
    assert set(found.doc_id) == set(ids) and found.length.sum() == sum(map(len, ids.values()))
    for r in found.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert len(set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before) <= 6  # the rest was discarded


def test_every_query_is_registered():
    from basinflow.llm.queries import QUERIES

    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))
