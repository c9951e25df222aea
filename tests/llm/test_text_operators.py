"""Joins, repeats, leaks, packing and archives against plain definitions, on odd rows."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sojourn.llm import decontaminate, packing, similar, substrings, tiles, warc, words
from sojourn.llm.queries import tokenizer_path
from tests.llm import rules


def test_word_positions_and_hashes():
    texts = ["a bb  ccc", None, "", "bb", " x\ty\n", "a" * 70 + " é z"]
    data, offsets = words.raw(pa.array(texts))
    starts, ends, first = words.bounds(data, offsets, words.SPACED)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in rules.SPACED.findall(t or "")]
    assert np.diff(first).tolist() == [len(rules.SPACED.findall(t or "")) for t in texts]
    hashes = words.word_hashes(data, starts, ends)
    assert hashes[1] == hashes[3] and len(set(hashes.tolist())) == len(set(found))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(documents, odd_texts, prose, k, percent):
    rng, rows = random.Random(3), list(odd_texts)
    base = prose(50, 150).split(" ")
    for i in range(40):  # a group around the threshold
        w = list(base)
        for at in rng.sample(range(len(w)), rng.choice([1, 2, 3, 4, 5, 6])):
            w[at] = f"new{i}x{at}"
        rows.append((100 + i, " ".join(w)))
    for i in range(12):
        rows.append((200 + i, prose(60 + i // 4, 6 + i)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.groups(documents(rows), k=k, threshold=Fraction(percent, 100)).collect()}
    assert got == rules.jaccard_groups(rows, k, percent)


def test_large_group_of_borderline_copies(documents, prose, monkeypatch):
    monkeypatch.setattr(tiles.dealt, "__defaults__", (16, tiles.TILE_BYTES))
    base, rng = prose(70, 120).split(" "), random.Random(5)
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(len(w)), 4):
            w[at] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.groups(documents(rows)).collect()}
    assert got == rules.jaccard_groups(rows)


def test_one_of_each_keeps_columns_and_odd_rows(spark, documents, odd_texts):
    rows = [*odd_texts, odd_texts[6], (None, "lonely words of no id at all"), (None, None)]
    kept = similar.one_of_each(documents(rows))
    assert kept.columns == documents([]).columns
    ids = [r.doc_id for r in kept.collect()]
    groups = rules.jaccard_groups(odd_texts, 5, 80)
    assert sorted(i for i in ids if i is not None) == sorted(d for d, (_, c) in groups.items() if c == d)
    assert ids.count(None) == 2
    assert similar.groups(documents([])).count() == 0 and similar.one_of_each(documents([])).count() == 0


def test_repeats_equal_brute_force(documents, odd_texts):
    out = substrings.parse(documents(odd_texts))
    got = {r.doc_id: (r.parsed.n_words, r.parsed.n_removed, r.parsed.kept_sha256) for r in out.collect()}
    assert got == rules.repeats(odd_texts)
    assert "match" in out.columns and substrings.parse(documents([])).count() == 0


def test_repeats_with_small_windows(documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    out = substrings.parse(documents(rows), window=8, seed=3)
    assert {r.doc_id: (r.parsed.n_words, r.parsed.n_removed, r.parsed.kept_sha256) for r in out.collect()} == rules.repeats(rows, 8)


def test_repeated_ids_are_not_duplicates_of_each_other(documents, prose):
    a, b = prose(20, 90), prose(21, 90)
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (3, None)]
    got = sorted((r.doc_id or 0, r.parsed.n_removed) for r in substrings.parse(documents(rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 90), (3, 0)]


def test_texts_without_repeats_stay_to_the_character(documents, prose):
    a = prose(30, 80)
    rows = [(1, a), (2, a), (3, "x  y\n\nz"), (4, None), (5, prose(31, 10) + "  " + a)]
    got = {r.doc_id: (r.text, r.n_chars) for r in substrings.without_duplicates(documents(rows)).collect()}
    assert got == {1: (a, len(a)), 3: ("x  y\n\nz", 7), 4: (None, None), 5: (" ".join(prose(31, 10).split()), len(" ".join(prose(31, 10).split())))}


def test_leaks_equal_brute_force(spark, documents, odd_texts, prose):
    items = [(1, prose(2, 60)), (2, prose(6, 30000)[2000:2300]), (3, "one"), (4, None), (5, " ,. "), (6, "Three"), (7, prose(2, 60)), (7, prose(2, 60)), (30, "TWO three")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (10 ** 9, 40):  # in one block, and in several
        out = decontaminate.search(documents(odd_texts), table, block_bytes=size)
        got = [(r.doc_id, r.match.n_words, r.match.n_hit, r.match.n_items, r.match.items_sha256, r.match.contaminated) for r in out.collect()]
        assert sorted(got) == rules.leaks(odd_texts, items)
    assert not decontaminate.search(documents(odd_texts), table.limit(0)).filter("match.contaminated").count()
    assert decontaminate.search(documents([]), table).count() == 0


def test_token_ids_equal_the_library():
    encoder = packing.Encoder(tokenizer_path())
    texts = ["", None, "don't stop!'s ''s 'seven", "É ÉÀ İstanbul ΣΑΣ ς naïve ﬁne", "<|endoftext|>x <|startoftext|>", "áb   x y", "1234 5a6b",
             "日本語 テキスト", "x\x1cy\x85z w", "İa", "…—«quoted»", "the the THE, the."]
    ids, first = encoder.encode(pa.array(texts))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want


def test_a_full_table_begins_anew(monkeypatch, prose):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 20)
    encoder = packing.Encoder(tokenizer_path())
    for seed in range(4):
        text = prose(seed, 200)
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_closest_sum_is_the_best():
    rng = random.Random(1)
    for _ in range(200):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 40), 5)}
        room, sums = rng.randrange(0, 90), {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = packing.closest(sorted(counts), counts, room)
        assert all(k <= counts[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_every_id_lies_in_one_piece(documents, odd_texts):
    encoder = packing.Encoder(tokenizer_path())
    rows = [*odd_texts, odd_texts[6]]
    pieces = packing.pack(documents(rows), tokenizer_path(), pool=8).collect()
    want = {}
    for d, t in rows:
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.setdefault(d, []).append(ids)
    seen = {}
    for p in pieces:
        ids = want[p.doc_id][0]
        assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
    for d, all_ids in want.items():
        assert sorted(x for a, n in seen[d] for x in range(a, a + n)) == sorted(list(range(len(all_ids[0]))) * len(all_ids))
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= packing.SIZE
    assert packing.pack(documents([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("archive_bytes", [1 << 26, 3000])
def test_archives_round_trip(spark, prose, archive_bytes):
    body = [prose(i % 7, 100 + i % 5) for i in range(60)]
    rows = [(i, f"http://x/{i}", b, "z") for i, b in enumerate(body)] + [(60, None, None, "z"), (61, "u\r\nv", "", "z"), (None, "http://n", body[0], "z"), (59, "http://x/59", body[59], "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    folder = warc.shared_folder(spark)
    archives = warc.write(pages, folder, archive_bytes=archive_bytes)
    got = warc.read(spark, archives, folder).collect()
    assert len(got) == len(rows) == archives.agg(F.sum("records")).first()[0]
    last = {}
    for p, _, h, _ in rows:
        if p is not None:
            last[h or ""] = max(last.get(h or "", p), p)
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        response = p is None or last[h or ""] == p
        mine = [r for r in got if r.page_id == p]
        assert all((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (
            len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else last[h or ""]) for r in mine)
        assert all(bytes(r.payload) == (raw if response else b"") for r in mine)
    assert warc.read(spark, warc.write(pages.limit(0), folder), folder).count() == 0


def test_archive_has_a_dictionary_frame(tmp_path, prose):
    some = [warc.record(i, "http://x", prose(i, 200).encode(), None, "1970-01-01T00:00:00Z") for i in range(200)]
    with open(tmp_path / "a", "wb") as sink:
        archive = warc.Archive(sink, warc.dictionary_of(some, 8192))
        for x in some:
            archive.add(x)
    assert (tmp_path / "a").read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    with open(tmp_path / "a", "rb") as source:
        assert [b for _, b in warc.records(source)] == [x.partition(b"\r\n\r\n")[2][:-4] for x in some]
