"""Small and hostile tables for each training-data operator, against brute force."""

import hashlib
import re
import textwrap
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nidifold.llm import chat, decontamination, exact_dedup, language_id, licenses, near_dedup, packing, sharding, token_files, toxicity
from nidifold.llm import deobfuscation as deob
from nidifold.llm.components import components
from nidifold.llm.tokens import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, piece string"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


def table(spark, rows):
    """Rows (doc_id, text) with more columns, some of them named like the operators' own."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None if t is None else len(t), k, "x") for k, (i, t) in enumerate(rows)], DOCS)


HOSTILE = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four five six seven"), (4, "One two three four five six seven"), (5, "one  two three\nfour five six seven"), (None, "No id here"), (None, None), (6, LONG), (7, LONG + " end"), (8, "x"), (9, "é ü ß 　 漢字 \x01 <|endoftext|>")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_gives_the_tokenizers_ids(vocabulary):
    enc = WordEncoder(public_tokenizers.path(vocabulary))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab C'.s\n \t\r\x0b\x1c\x85\xa0 　`\x01é漢1|<>$ΣI"), max_size=14), max_size=6))
    def same(texts):
        ids, sizes = enc.encode(pa.array(texts, pa.string()))
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for w in want for x in w]
        assert sizes.tolist() == [len(w) for w in want]

    same()


def test_word_encoder_with_full_memory(monkeypatch):
    monkeypatch.setattr("nidifold.llm.tokens.MEMORY", 3)
    enc = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (["a b c d e f", None], ["f e d c b a", "g h"], ["x y z a", "b c"]):
        ids, _ = enc.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [x for t in texts for x in enc.tokenizer.encode(t or "", add_special_tokens=False).ids]


def test_packing_places_every_piece(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(packing.token_pieces(table(spark, HOSTILE), path, 64, with_ids=True), 64).collect()
    tokenizer = Tokenizer.from_file(path)
    want = defaultdict(int)
    for i, t in HOSTILE:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) - 64 * (-(-len(ids) // 64) - 1)
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for there in places.values():
        at = 0
        for offset, length in sorted(there):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.token_pieces(table(spark, []), path)).count() == 0


def fewest(histogram, capacity):
    """No packing needs fewer: the best bound that dual feasible functions of the lengths give."""
    sized = [(Fraction(size, capacity), n) for size, n in histogram.items()]
    best = Fraction(0)
    for least in {Fraction(0), *(x for x, _ in sized if x <= Fraction(1, 2))}:
        cut = [(Fraction(1) if x > 1 - least else x if x >= least else Fraction(0), n) for x, n in sized]
        for k in range(capacity):
            held = lambda x: x if k == 0 or (x * (k + 1)).denominator == 1 else Fraction(x * (k + 1) // 1, k)  # noqa: B023,E731
            best = max(best, sum((held(x) * n for x, n in cut), Fraction(0)))
    return -(-best // 1)


def first_fit(histogram, capacity):
    """The sequences that first fit needs, longest pieces first."""
    free = []
    for size in sorted((size for size, n in histogram.items() for _ in range(n)), reverse=True):
        k = next((k for k, left in enumerate(free) if left >= size), len(free))
        free[k:] = [*([free[k]] if k < len(free) else [capacity]), *free[k + 1 :]]
        free[k] -= size
    return len(free)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=30), st.sampled_from([1, 3, 64]))
@example({17: 155}, 64)
@example({18: 374, 1: 179, 16: 78}, 64)
def test_packing_plan_is_whole_and_near_the_bound(histogram, groups):
    plan, count = packing.packing_plan(histogram, 50, groups)
    ranks, fill = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in plan:
        ranks[length].append((rank, n))
        for k in range(n):
            fill[first + k].append((offset, length))
    for length, n in histogram.items():
        at = 0
        for rank, m in sorted(ranks[length]):
            assert rank == at
            at += m
        assert at == n
    for there in fill.values():
        at = 0
        for offset, length in sorted(there):
            assert offset == at
            at += length
        assert at <= 50
    assert len(fill) == count
    bound = fewest(histogram, 50)
    assert count >= bound and (groups < 64 or count <= max(1.1 * bound, first_fit(histogram, 50)) + 2)


def test_exact_dedup_against_brute_force(spark):
    rows = [*HOSTILE, *[(20 + k, "same text for all") for k in range(5)], (40, "same textforall  "), (41, "a" * 3000), (42, "a" * 3000), (43, "a" * 2999 + "b")]
    for block, block_hash in ((1024, F.xxhash64), (8, F.xxhash64), (8, lambda c: F.octet_length(c).cast("long"))):  # the last: all blocks collide
        got = exact_dedup.exact_duplicates(table(spark, rows), block, block_hash).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[norm(t)].append((-len(t or ""), i is None, i or 0, t or ""))
        want = []
        for i, t in rows:
            best = min(groups[norm(t)])
            keep = None if best[1] else best[2]
            want.append((i, keep, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.deduplicated(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_block_names_do_not_depend_on_partitions(spark):
    rows = table(spark, [(k, f"text {k % 40} " * (1 + k % 9)) for k in range(200)])
    seen = set()
    for n in (1, 7):
        found = exact_dedup.block_names(exact_dedup.blocked(rows.repartition(n), "label", 16, F.xxhash64))
        seen.add(tuple(sorted(map(tuple, found.collect()))))
    assert len(seen) == 1


def test_very_many_equal_rows(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same " * 500).alias("text"), F.lit(1).alias("__row"))
    got = exact_dedup.exact_duplicates(rows).groupBy("group_size").agg(F.count(F.lit(1)), F.sum(F.col("kept").cast("int"))).collect()
    assert [tuple(r) for r in got] == [(50_000, 50_000, 1)]
    assert exact_dedup.deduplicated(rows).count() == 1


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, words):
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    of = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and of[i] != of[j]:
                    of[i] = of[j] = min(of[i], of[j])
                    changed = True
    return of


def near_copies(seed, n, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(100)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.choice(100, int(rng.integers(0, edits)), replace=False):
            text[at] = f"e{k}x{at}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_against_brute_force(spark, words):
    rows = [*HOSTILE, *[(100 + k, t) for k, t in enumerate(near_copies(1, 60, 14))], *[(300 + k, "A B c") for k in range(4)], (310, "a"), (311, "a")]
    got = near_dedup.near_duplicates(table(spark, rows), words).collect()
    want = brute_components(rows, words)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(((i, len(shingles(t, words)), None if i is None else want[i]) for i, t in rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.deduplicated(table(spark, rows), words)
    assert sorted(want[r.doc_id] for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))  # one of each
    assert near_dedup.near_duplicates(table(spark, []), words).count() == 0


def test_near_dedup_lower_bound_loses_no_link(spark):
    rows = [(k, t) for k, t in enumerate(near_copies(2, 150, 9))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2)


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (8, "other words entirely")]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (8, 8)}


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(9, 4), (4, 7), (2, 3), (3, 2), (1, 1)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in of:
        for a, b in edges:
            if a != b:
                of[a] = of[b] = min(of[a], of[b])
    assert got == of


def test_components_of_stars_take_no_step(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k % 3) for k in range(3, 60)], "a long, b long")
    monkeypatch.setattr("nidifold.llm.components._star", None)
    assert {(r.node, r.component) for r in components(edges).collect()} == {(k, k % 3) for k in range(60)}


def test_sharding_is_whole_and_even(spark):
    rows = [*HOSTILE, *[(1000 + k, "t" * (k * 7 % 311)) for k in range(2000)], *[(7, "again")] * 300]
    got = sharding.shard(table(spark, rows), 7).collect()
    assert len(got) == len(rows)
    want = sorted(((i is None, i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(((r.doc_id is None, r.doc_id), r.size, r.text_crc32) for r in got) == want
    load, places = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    small = [v for k, v in load.items()]
    assert len(small) == 7 and min(small) * 1.05 >= sum(sorted(small)[:5]) / 5
    assert sharding.shard(table(spark, []), 7).count() == 0


def test_rebalancing_moves_few_slots():
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 1000, 500).tolist()
    first = [k % 8 for k in range(500)]
    owner = sharding.rebalanced(first, weight, 8)
    load = np.bincount(owner, weight, minlength=8)
    assert load.max() - load.min() <= 2 * min(weight) + 1000 // 50
    assert sum(a != b for a, b in zip(first, owner, strict=True)) < 60


def test_a_stored_slot_map_is_edited(spark, tmp_path):
    path, rows = f"file://{tmp_path}/map", [(k, "t" * (k * 7 % 311)) for k in range(2000)]
    owner = lambda: sharding.SlotMap(spark, path, 256).owners(sharding.SlotMap(spark, path, 256).version)
    load = lambda got: np.bincount([r.shard for r in got], [r.size for r in got])
    assert np.ptp(load(sharding.shard(table(spark, rows), 7, 256, path).collect())) < 311
    first = owner()
    got = sharding.shard(table(spark, [*rows, *[(5000 + k, "more") for k in range(500)]]), 8, 256, path).collect()
    assert len(got) == 2500 and np.ptp(load(got)) < 311
    assert sharding.SlotMap(spark, path, 256).versions() == [1, 2, 3]
    assert sum(a != b for a, b in zip(first, owner(), strict=True)) < 256 / 4  # the new shard's, and few others
    assert max(r.shard for r in sharding.shard(table(spark, rows), 5, 256, path).collect()) == 4


def license_text(*kinds):
    return " ".join(t for t, i in licenses.TEXTS.items() if i in kinds)


def wrapped(text, lead, width=60):
    return "\n".join(lead + line for line in textwrap.wrap(text, width))


STANDARD = {
    "MIT": "Copyright (c) 2020 A. Author\n\n" + "\n\n".join(license_text(k) for k in ("MitPermission", "MitNotice")) + "\n\n" + license_text("MitWarranty", "MitLiability"),
    "Apache-2.0": license_text("ApacheHead", "ApacheUse") + "\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + license_text("ApacheBasis", "ApacheSee"),
    "BSD-2-Clause": license_text("BsdTerms") + "\n\n1. " + license_text("BsdSource") + "\n\n2. " + license_text("BsdBinary") + "\n\n" + license_text("BsdWarranty"),
    "BSD-3-Clause": license_text("BsdTerms") + "\n\n* " + license_text("BsdSource") + "\n* " + license_text("BsdBinary") + "\n* " + license_text("BsdNames"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + license_text("IscWarranty"),
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
}


def test_license_scan(spark):
    rows = [*HOSTILE, (51, "Foo. Licensed under the Apache License, Version 2.0. Bar"), (52, "ALL RIGHTS RESERVED!"), (53, "Released under the MIT License.\r\nAll rights reserved."), (54, "The licence of all rights reserved things"), (55, "words without an end\nReleased under the MIT License\nand more"), (56, "All rights  reserved."), (57, "All\xa0rights\treserved"), (58, "ALL-RIGHTS-RESERVED"), (59, ". " * 50_000 + "All rights reserved."), (60, "a\x01b\x02c")]
    for k, text in enumerate(STANDARD.values()):
        for j, lead in enumerate(("", "# ", " * ", "// ", "> ")):
            rows.append((1000 + 10 * k + j, "start\n\n" + ("\n" + lead.rstrip() + "\n").join(wrapped(p, lead) for p in text.split("\n\n")) + "\n\nend"))
        rows.append((1009 + 10 * k, text))
    docs = table(spark, rows)
    scanned = licenses.scan(docs).collect()
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_sentences) for r in scanned}
    assert got[51] == ("Apache-2.0Ref", "Apache-2.0", 1)
    assert all(got[k] == ("AllRights", "Proprietary", 1) for k in (52, 56, 57, 58, 59))
    assert got[53] == ("MITRef,AllRights", "MIT,Proprietary", 2)
    assert got[55] == ("MITRef", "MIT", 1)
    assert all(got[k] == ("", "", 0) for k in (1, 2, 3, 4, 54, 60, None))
    for k, name in enumerate(STANDARD):
        assert {got[1000 + 10 * k + j][1] for j in (0, 1, 2, 3, 4, 9)} == {name}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows if i], pa.int64()), "text": pa.array([t for i, t in rows if i], pa.string())}))
    sql = con.execute(f"SELECT doc_id, sentence_ids, licenses, n_sentences FROM ({licenses.scan_sql()})").fetchall()
    assert {r[0]: r[1:] for r in sql} == {i: x for i, x in got.items() if i}
    assert all(any(w in s for w in licenses.TALK) for s in licenses.SENTENCES)
    assert len(scanned) == len(rows) and licenses.scan(table(spark, [])).count() == 0
    assert {i for _, run in licenses.RULES for i in run} <= set(licenses.SENTENCES.values())


def test_chat_round_trip(spark):
    tricky = ["</turn>", "<turn user>", "\\0", "\\", "\\\\1<", "", None, "a\nb", "é漢"]
    rows = [(1, k, "assistant" if k % 2 else "user", t, 0) for k, t in enumerate(tricky)] + [(2, 0, "user", "x", 0), (2, 0, "user", "x", 0), (None, None, None, None, 0), (3, 5, "we<i>rd", "y", 0)]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(source))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(tricky)]
    assert back[1].loss_text == "".join(t or "" for t in tricky[1::2])
    assert len(back[2].turns) == 2 and back[2].loss_text == ""
    assert [(t.role, t.text) for t in back[3].turns] == [("we<i>rd", "y")]
    assert len(back) == 4
    assert chat.read_back(chat.format_turns(chat.canonical_turns(source.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_turns(source.drop("role"))
    with pytest.raises(ValueError):
        chat.canonical_turns(source.withColumn("text", F.struct("text")))
    more = source.withColumn("prompt", F.lit("x")).withColumn("messages", F.array(F.struct("role")))
    assert chat.canonical_turns(more).count() == len(rows)
    human = chat.canonical_turns(source.withColumn("role", F.lit("Human"))).select("role").distinct().collect()
    assert [r.role for r in human] == ["user"]
    long = spark.createDataFrame([(1, 0, "assistant", "<" + "word " * 100_000)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(chat.canonical_turns(long))).collect()[0].loss_text == "<" + "word " * 100_000


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}'),
        (2, '{"instruction":"do","input":"","output":"done"}'),
        (3, '{"output":"done","input":"this","instruction":"do"}'),
        (4, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'),
        (5, '{"prompt":"p","response":null}'),
        (6, '{"what":1}'),
        (7, "no json"),
        (8, None),
    ]
    source = spark.createDataFrame(records, "id long, record string")
    got = defaultdict(list)
    for r in chat.turns_of_records(source, "id", "record").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "do"), ("assistant", "done")], 3: [("user", "do"), ("user", "this"), ("assistant", "done")], 4: [("user", "q"), ("assistant", "a")], 5: [("user", "p"), ("assistant", None)]}
    assert {r.id for r in chat.unmapped(source, "record").collect()} == {6, 7, 8}


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = token_files.write_tokens(table(spark, HOSTILE), path, f"file://{tmp_path}/files")
    got = token_files.read_tokens(spark, out, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = sorted((i is not None, i or 0, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in HOSTILE)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)] == [w[1] for w in want]
    assert token_files.read_tokens(spark, token_files.write_tokens(table(spark, []), path)).count() == 0


def test_long_documents_have_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, "word " * (1000 if k == 7 else 20)) for k in range(30)]
    out = token_files.write_tokens(table(spark, rows), path)
    assert [len(r.sizes) for r in spark.read.parquet(f"{out}/blocks").filter("array_contains(doc_ids, 7)").collect()] == [1]
    assert sorted((r.doc_id, r.n_tokens) for r in token_files.read_tokens(spark, out).collect()) == [(k, 1001 if k == 7 else 21) for k in range(30)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=200), min_size=1, max_size=5))
def test_range_coder(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    table_ = token_files.Table.of_counts(np.bincount(np.concatenate([*blocks, [0]]).astype(np.int64)))
    payloads = token_files.encode_blocks(blocks, table_)
    for a, b in zip(blocks, token_files.decode_blocks(payloads, table_, table_.symbols()), strict=True):
        assert a.tolist() == b.tolist()
    broken = bytearray(payloads[0])
    broken[8] ^= 1
    with pytest.raises(token_files.Damaged):
        token_files.decode_blocks([bytes(broken)], table_, table_.symbols())


def test_range_coder_checkpoints():
    rng = np.random.default_rng(0)
    block = (rng.zipf(1.3, 70_000) % 5000).astype(np.uint32)
    t = token_files.Table.of_counts(np.bincount(block))
    (payload,) = token_files.encode_blocks([block], t)
    assert (token_files.decode_blocks([payload], t, t.symbols())[0] == block).all()
    p = np.bincount(block) / len(block)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(payload) * 8 / len(block) < entropy * 1.05 + 0.3


def letter_costs():
    counts = np.ones((deob.SYMBOLS,) * 3) * 0.01
    for word in ["idiot"] * 50 + ["stupid"] * 50 + ["loser"] * 50 + ["you", "the", "this", "list", "ball", "old"] * 5:
        s = deob.symbols(word).astype(int)
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
            if b == 0 or c == 0:
                counts[b, 0, s[1]] += 1
        counts[0, 0, s[1]] += 1
    return deob.model(counts)


def test_restoring_disguised_words():
    costs = letter_costs()
    written = {"1d10t": "idiot", "id!ot": "idiot", "$tup1d": "stupid", "idiooooot": "idiot", "idi" + "o" * 45 + "t": "idiot", "iidioott": "idiot", "l0ser": "loser", "l*ser": "loser", "the": "the", "ball": "ball"}
    written |= {"i d i o t": "idiot", "i  d\ti\no t": "idiot", "s. t. u. p. i. d": "stupid", "y o u i d i o t": "you idiot"}
    for w, meant in written.items():
        assert deob.restored(w, costs) == meant
    found = deob.spelled("you, i d i o t and s.t.u.p.i.d! what a i d i  0 t, a b")
    assert found == ["i d i o t", "s.t.u.p.i.d", "a i d i  0 t"]
    assert deob.joined(found[0]) == ["idiot", "diot", "idio"] and deob.joined(found[1]) == ["stupid"]
    assert deob.restored("", costs) == "" and len(deob.restored("a1" * 20_000, costs)) > 10_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="io1l!a@t. *s", max_size=5))
def test_viterbi_against_all_paths(written):
    rng = np.random.default_rng(1)
    costs = rng.random((deob.SYMBOLS,) * 3) * 3
    steps = deob.lattice(written)

    def cost(path):
        total, numbers = sum(c for _, c in path), [0, 0]
        for text, _ in path:
            numbers += [0] if text == " " else deob.symbols(text)[1:-1].tolist()
        return total + sum(costs[x] for x in zip(numbers, numbers[1:], [*numbers[2:], 0]))

    best = min(product(*steps), key=cost)
    assert deob.restored(written, costs) == " ".join("".join(t for t, _ in best).split())


def test_no_disguise_hides_a_word():
    make = toxicity.Features(letter_costs())
    want = make.of_words(pa.array(["idiot"], pa.large_string()))[0, 0]
    for text in ("an idiot here", "an 1d10t.", "id*ot", "*idiot*", "idio*", "so idi" + "o" * 60 + "t", "i d i o t", "i\nd\ni\no\nt", "y.o.u. .i.d.i.o.t", "iidioott!", "IDIOT"):
        _, found = make.of_texts(pa.array([text, None, ""]))
        assert want in found, text


def test_toxicity_scores(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghilmnoprstu"), 7)) for _ in range(400)]
    rows, labels = [*HOSTILE], [(1, None), (2, 0), (4, 0), (4, None)]
    for k in range(600):
        text = rng.choice(plain, 40).tolist()
        bad = k % 4 == 0
        if bad:
            text[int(rng.integers(40))] = ["idiot", "moron", "1d10t", "i d i o t", "mooooron"][k // 4 % 5] if k > 200 else ["idiot", "moron"][k // 4 % 2]
        rows.append((1000 + k, " ".join(text)))
        labels.append((1000 + k, int(bad)))
    got = toxicity.scores(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, (r.doc_id - 1000) % 4 == 0) for r in got if r.held_out and r.doc_id >= 1000]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
    none = toxicity.scores(table(spark, HOSTILE), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(HOSTILE) and not any(r.predicted for r in none)
    assert toxicity.scores(table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_language_id(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["the", "ing", "ed", "th", "and"], "ab": ["the", "ung", "ch", "th", "und"], "ba": ["ción", "ado", "la", "que"], "bb": ["tion", "eau", "la", "que", "é"]}
    rows = [(k, "".join(rng.choice(parts[lang], 3)) + " " + " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(20)), lang) for k, lang in enumerate(list(parts) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !!", None), (1002, "", "ba"), (1003, "😀 1!", None), (1004, "𠀀", None), (None, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.languages(docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002, 1003))
    assert got[1004].lang_pred != "und"
    held = [got[i] for i, _, _ in rows[:240] if got[i].held_out]
    truth = {i: lang for i, _, lang in rows}
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    nothing = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(rows) and {r.lang_pred for r in nothing} == {"und"}
    assert language_id.languages(docs.limit(0)).count() == 0


def test_languages_learn_from_rows_under_one_id_or_none(spark):
    rows = [(None if k % 2 else 7, f"{'the and this' if k % 4 < 2 else 'der und dies'} {chr(97 + k % 26)}{chr(97 + k // 26)}", "en" if k % 4 < 2 else "de") for k in range(80)] + [(1, "the and", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.languages(docs).collect()} == {"en", "de"}
    assert language_id.training_rows(docs, 10, 12).count() <= 12
    assert language_id.training_rows(docs).filter("text = 'the and'").count() == 1
    long = spark.createDataFrame([*rows, (90, "the and this " * 50_000, None)], docs.schema)
    assert {r.lang_pred for r in language_id.languages(long).filter("doc_id = 90").collect()} == {"en"}


def test_language_families():
    base = np.eye(6)
    means = np.array([base[0] + 0.2 * base[2], base[0] + 0.2 * base[3], base[1] + 0.2 * base[4], base[1] + 0.2 * base[5]])
    assert language_id.families(means) == [[0, 1], [2, 3]]


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"t{k}" for k in range(3000)]
    zipf = 1 / np.arange(1, 3001)
    draw = lambda n: rng.choice(words, n, p=zipf / zipf.sum()).tolist()
    items = [draw(40) for _ in range(20)] + [draw(16) for _ in range(5)]
    rows, want = [*HOSTILE], set()
    for k in range(300):
        text = draw(int(rng.integers(5, 400)))
        if k % 5 == 0:
            item = k // 5 % 25
            put = list(items[item])
            if k % 10 == 0:
                put[3] = "changed"  # a paraphrase
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = put
            want.add((2000 + k, item))
        rows.append((2000 + k, " ".join(text).capitalize() + "."))
    bench = spark.createDataFrame([*[(k, " ".join(t)) for k, t in enumerate(items)], (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, rows), bench).collect()}
    assert got == want
    kept = decontamination.without_contaminated(table(spark, rows), bench)
    assert kept.columns == table(spark, []).columns and kept.count() == len(rows) - len({d for d, _ in want})
    assert decontamination.contaminated(table(spark, []), bench).count() == 0
    assert decontamination.contaminated(table(spark, rows), bench.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert decontamination.common(a, b) == best[-1][-1]
