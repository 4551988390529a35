"""Rows that an operator must not miss or take along."""

import numpy as np

from nidifold.llm import decontamination, near_dedup, toxicity


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def paraphrases(shares=(0.6, 0.7, 0.8, 1.0), sizes=(6, 7, 8, 12, 16, 32, 64, 150, 300), seed=5):
    """Items, and documents that hold a share of an item's words in order, its last eight words or others kept."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    odds = 1 / np.arange(10, 3010)
    draw = lambda n: list(rng.choice(vocabulary, n, p=odds / odds.sum()))
    items, docs = [], [(1000 + k, " ".join(draw(300))) for k in range(20)]
    for size in sizes:
        item = draw(size)
        items.append((size, " ".join(item)))
        for share in shares:
            for tail in (0, min(8, size)):
                fixed = set(range(size - tail, size)) | set(rng.permutation(size - tail)[: max(0, int(np.ceil(share * size)) - tail)].tolist())
                text = [w if i in fixed else str(rng.choice(vocabulary)) for i, w in enumerate(item)]
                docs.append((len(docs), " ".join([*draw(int(rng.integers(0, 100))), *text, *draw(60)])))
    return items, docs


def brute_force(docs, items):
    """Every passage with every item, by the operator's rule."""
    found = set()
    for d, text in docs:
        words = text.split()
        for i, item in items:
            item = item.split()
            for start in range(0, len(words), decontamination.HALF):
                lo, hi = decontamination.around(start, len(item), len(words))
                if decontamination.covered(item, item[-decontamination.ANSWER :], words[lo:hi])[2]:
                    found.add((d, i))
    return found


def test_decontamination_misses_no_paraphrase(spark):
    items, docs = paraphrases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, docs), bench).collect()}
    want = brute_force(docs, items)
    assert len(want) > 40 and got == want


def test_rare_words_reach_every_passage_of_the_rule(monkeypatch):
    monkeypatch.setattr(decontamination, "COUNTED", 50)
    monkeypatch.setattr(decontamination, "ITEMS_COUNTED", 2)
    rng = np.random.default_rng(3)
    for few in (4, 30, 3000):
        idf = rng.random(decontamination.VOCABULARY)
        items = [rng.integers(0, few, n).astype(np.uint16) for n in (1, 5, 8, 20, 90)]
        parts = [rng.integers(0, few, n).astype(np.uint16) for n in (0, 700, 1, 0, 40, 17)]
        parts[1][100:120], parts[4][10:30] = items[3], items[3]
        reached = {(d, k, s) for d, k, a, b in decontamination.Rare(items, idf).passages(parts) for s in range(a, b)}
        for d, part in enumerate(parts):
            for k, item in enumerate(items):
                for s in range(0, len(part), decontamination.HALF):
                    lo, hi = decontamination.around(s, len(item), len(part))
                    if decontamination.covered(item.tolist(), item[-8:].tolist(), part[lo:hi].tolist())[2]:
                        assert (d, k, s // decontamination.HALF) in reached


def test_bad_rows_take_no_clean_rows_along(spark, monkeypatch):
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(1, "clean words only"), (1, f"so {item} it is"), (None, f"here {item} again"), (None, "clean without an id"), (2, "more of it")]
    kept = decontamination.without_contaminated(table(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == ["clean without an id", "clean words only", "more of it"]

    good = [(k, f"fine day number{k} and sun") for k in range(40)]
    bad = [(100 + k, f"you awfulword fool{k} again") for k in range(40)]
    mixed = [(1000, "quiet evening"), (1000, "an awfulword fool"), (None, "awfulword again"), (None, "quiet morning")]
    labels = spark.createDataFrame([*((i, 0) for i, _ in good), *((i, 1) for i, _ in bad)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "LEAST_ROWS", 2)
    kept = {(r.doc_id, r.text) for r in toxicity.without_toxic(table(spark, [*good, *bad, *mixed]), labels).collect()}
    assert {(1000, "quiet evening"), (None, "quiet morning")} <= kept
    assert not {(1000, "an awfulword fool"), (None, "awfulword again")} & kept


def test_near_copies_under_one_id_or_none(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [(1, text(1)), (5, text(1) + " end"), (5, text(2)), (None, text(3)), (None, text(3) + " end"), (7, text(4)), (7, text(4) + " end"), (8, text(5)), (8, text(5)), (None, text(6)), (None, ""), (None, "")]
    kept = near_dedup.deduplicated(table(spark, rows)).collect()
    of = lambda k: [r for r in kept if r.text.startswith(f"t{k}w")]
    assert [len(of(k)) for k in range(1, 7)] == [1] * 6
    assert of(1)[0].doc_id == 1 and of(2)[0].doc_id == 5
    assert len(kept) == 8


def test_one_training_row_of_each_id(spark):
    rows = [*((1, f"text number {k}") for k in range(30)), (2, None), (2, None), (3, "c")]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int")
    held = {r.doc_id for r in labels.filter(toxicity.held_out(labels["doc_id"])).collect()}
    got = toxicity.training_rows(table(spark, rows), labels).collect()
    assert len(got) == 3 - len(held)


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    fitted, plain = [], decontamination.latent_space
    monkeypatch.setattr(decontamination, "latent_space", lambda numbers, *more: (fitted.append(numbers.count()), plain(numbers, *more))[1])
    rows = spark.range(12_000).selectExpr("id AS doc_id", "concat('text number', id % 700, ' of them all') AS text")
    item = "one two three four five six seven eight nine"
    found = decontamination.contaminated(rows.unionByName(table(spark, [(-1, f"so {item} it is")])), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in found.collect()] == [-1] and fitted == [12_001]


def test_sums_by_key():
    rng = np.random.default_rng(11)
    for n, distinct in ((0, 1), (1, 1), (33, 1), (5000, 3), (5000, 900)):
        values, rows, keys = rng.random((50, 4)), rng.integers(0, 50, n), rng.integers(0, distinct, n)
        want = np.zeros((distinct, 4))
        np.add.at(want, keys, values[rows])
        got = np.zeros((distinct, 4))
        name, sums = decontamination.sums_by(values, rows, keys, run=4)
        assert len(set(name.tolist())) == len(name) == len(set(keys.tolist()))
        got[name] = sums
        assert np.allclose(got, want)


def test_latent_space_is_that_of_all_passages(spark, monkeypatch):
    """With fewer words than dimensions the decomposition is exact: whitened vectors of words give the identity."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 90))))) for k in range(300)]
    numbers, idf = decontamination.word_numbers(table(spark, rows)), rng.random(decontamination.VOCABULARY) + 0.5
    a = []
    for r in numbers.collect():
        w = np.frombuffer(r.w, np.uint16) & (decontamination.VOCABULARY - 1)
        for at in range(0, len(w), decontamination.HALF):
            row = np.bincount(w[at : at + decontamination.HALF], minlength=decontamination.VOCABULARY) * idf
            n = np.bincount(w[at : at + decontamination.HALF], minlength=decontamination.VOCABULARY) @ idf**2
            a.append(row / np.sqrt(n))
    space = decontamination.latent_space(numbers, idf, numbers.limit(0), 1.0)
    x = np.array(a) @ space
    assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=0.05) and x.shape[1] == np.linalg.matrix_rank(np.array(a)[:, np.any(a, axis=0)])


def test_toxicity_learns_from_all_labelled_rows(spark):
    rows = spark.range(14_000).selectExpr("id AS doc_id", "concat('n', id, ' own', id * 7) AS text")
    labels = spark.range(14_000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS int) AS toxic")
    want = labels.filter(~toxicity.held_out(labels["doc_id"])).count()
    assert want > 11_000 and toxicity.training_rows(rows, labels).count() == want


def test_toxic_words_of_few_rows_among_many_are_learned(spark):
    """Words that only rows beyond the first 10 000 (by the hash of their id) have."""
    order = [r.doc_id for r in spark.range(16_000).selectExpr("id AS doc_id", "xxhash64(id) AS h").orderBy("h").collect()]
    late = [i for i in order[-2_000:]][::20]
    bad = spark.createDataFrame([(i, f"rareslur x{i} y{i * 3}") for i in late], "doc_id long, text string")
    clean = spark.range(16_000).selectExpr("id AS doc_id", "concat('quiet n', id, ' own', id * 7) AS text").join(bad.select("doc_id"), "doc_id", "left_anti")
    docs = clean.unionByName(bad)
    labels = docs.selectExpr("doc_id", "CAST(text LIKE 'rareslur%' AS int) AS toxic")
    got = {r.doc_id for r in toxicity.scores(docs, labels).filter("predicted = 1").collect()}
    assert got == set(late)


def test_items_of_later_blocks_are_found_alike(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 2)
    items, docs = paraphrases((0.6, 0.7, 1.0), (6, 12, 40, 100))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, docs), bench).collect()}
    assert got == brute_force(docs, items)


def test_near_copies_with_other_ids_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(near_dedup, "MEMBERS_AT_ONCE", 4)
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(60)], []
    for k in range(80):
        text = list(base)
        for at in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            text[at] = f"e{rng.integers(0, 4)}x{at}"
        rows.append((f"id{k:03}", " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    sets = [(i, {tuple(t.split()[k : k + 2]) for k in range(59)}) for i, t in rows]
    of = {i: i for i, _ in sets}
    for _ in rows:
        for i, a in sets:
            for j, b in sets:
                if of[i] != of[j] and 100 * len(a & b) >= 80 * len(a | b):
                    of[i] = of[j] = min(of[i], of[j])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()} == of
    assert len(set(of.values())) > 1


def test_pages_of_one_template_are_ruled_out_one_by_one(spark, monkeypatch):
    """Many texts that are alike, but not enough: none is compared with all others."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(300):
        text = list(base)
        for at in rng.choice(100, 9, replace=False):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    seen = []
    plain = near_dedup.measured
    monkeypatch.setattr(near_dedup, "measured", lambda pairs, *more: (seen.append(pairs.count()), plain(pairs, *more))[1])
    got = near_dedup.near_duplicates(table(spark, rows), 2).collect()
    assert all(r.kept for r in got) and sum(seen[1:]) == 0 and seen[0] < 300 * near_dedup.BANDS


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    seen, plain = [], decontamination.retrieved
    monkeypatch.setattr(decontamination, "retrieved", lambda numbers, *more: (seen.append(numbers), plain(numbers, *more))[1])
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = table(spark, [(1, f"so {item.title()}, it is"), (2, None), (3, "nothing of it"), (1, "again"), (None, item)])
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (None, 1)}
    (numbers,) = seen
    assert "w" in numbers.columns and all("/word-numbers-" in f for f in numbers.inputFiles())
