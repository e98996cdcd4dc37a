import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from frames import ROWS, documents, empty, texts
from pyspark.sql import functions as F

from kithgraph.llm import bpe, decontaminate, fingerprints, packing, pii, repeats, simhash, store

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    assert len(found) == len(ROWS)
    want = [(r[0], fingerprint(r[1] or "")) for r in ROWS]
    group = list(range(len(want)))
    for i in range(len(want)):
        for j in range(i):
            if (want[i][1] ^ want[j][1]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((want[i][0] for i in range(len(want)) if group[i] == g and want[i][0] is not None), default=None) for g in set(group)}
    assert sorted(map(str, ((d, f"{f:016x}", least[g]) for (d, f), g in zip(want, group, strict=True)))) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in found)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_covering_meets_every_pair_in_the_radius():
    masks = simhash.masks(4, list(range(64)), 11)
    rng = np.random.default_rng(1)
    for _ in range(2_000):
        x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(x & m == 0 for m in masks)


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(150)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in fps], "node long")
    edges = simhash.bucket_edges(nodes.select("node", F.col("node").alias("fp"), F.array("node").alias("wide")), 4, 4)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    label = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and label[a] != label[b]:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert {f: got.get(f, f) for f in fps} == label


def test_one_of_each_keeps_one_of_near_copies(spark):
    kept = simhash.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 4 in ids and 5 not in ids and {6, 9, 10, None} <= set(ids)
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_encoder_equals_the_library():
    rng = np.random.default_rng(5)
    signs = [*"abst'dmrevl  \n\t  .,!?1²½éß あ\0", "'s", "'re", " '", "<|endoftext|>", "\U0001f600"]
    cases = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3_000)] + [r[1] or "" for r in ROWS]
    encoder = bpe.Encoder(VOCABULARY, cached=500)
    assert [list(map(int, x)) for x in encoder.encode(cases)] == encoder.whole(cases)


def test_differencing_is_near_equal_and_complete():
    rng = np.random.default_rng(3)
    sizes = [256] * 300 + rng.integers(1, 257, 200).tolist()
    found = packing.windows(sizes)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 2048 and len(found) <= -(-sum(sizes) // 2048) + 2
    assert packing.windows([2000, 2000, 200]) and packing.windows([5]) == [[0]]


def test_packing_round_trip(spark):
    found = packing.packed(packing.pieces(documents(spark), VOCABULARY)).collect()
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert rows[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(rows)) and sum(r.length for r in rows) <= 2048
    for doc, text in texts().items():
        ids = np.array([*whole_ids(text), 1], "<u4")
        rows = sorted((r for r in found if r.doc_id == doc), key=lambda r: r.start)
        if doc == 1:
            rows = rows[::2]
        assert [(r.start, r.ids_crc32) for r in rows] == [(r.start, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in rows]
        assert sum(r.length for r in rows) == len(ids) == rows[0].doc_tokens
    assert packing.packed(packing.pieces(empty(spark), VOCABULARY)).count() == 0


def test_store_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    root = store.write(documents(spark), path, VOCABULARY)
    rows = store.with_starts(store.read(spark, path, root=root)).collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.row)):
        text = next(x[1] or "" for x in ROWS if x[0] == r.doc_id)
        ids = np.array([*whole_ids(text), 2], "<u4")
        assert bytes(r.ids) == ids.tobytes() and (r.start, r.n_tokens, r.crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    stored = spark.read.parquet(f"{path}/store").collect()
    digests = [bytes(r.digests[i]) for r in stored for i in r.own]
    assert len(digests) == len(set(digests))
    with pytest.raises(ValueError):
        store.read(spark, path, root="0" * 64)
    store.write(empty(spark), f"{path}-empty", VOCABULARY)
    assert store.read(spark, f"{path}-empty").count() == 0


def test_decontamination_equals_brute_force(spark):
    bench = spark.createDataFrame([(1, "Seven silver birds sing softly near the old mill by the river the quick"), (2, "emoji"), (3, None), (4, ""), (None, "no id"), (5, "word7 WORD8 word9 word10 word11 word12 word13 word14 word15 word16 word17")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    windows: dict = {}
    for item, text in [(1, "Seven silver birds sing softly near the old mill by the river the quick"), (2, "emoji"), (5, "word7 WORD8 word9 word10 word11 word12 word13 word14 word15 word16 word17")]:
        w = word.findall(low(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for r in decontaminate.contamination(documents(spark), bench).collect():
        text = next(x[1] or "" for x in ROWS if x[0] == r.doc_id)
        w, hit, items = word.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= own
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), digest, bool(hit))
    left = decontaminate.without_benchmark(documents(spark), bench)
    assert left.columns == documents(spark).columns and left.where("contains(text, 'silver birds')").count() == 0
    assert decontaminate.contamination(documents(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"word{i} word{i + 1} word{i + 2} word{i + 3} word{i + 4} word{i + 5} word{i + 6} word{i + 7} word{i + 8} word{i + 9}") for i in range(0, 60, 20)], "item_id long, text string")
    whole = decontaminate.contamination(documents(spark), bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert decontaminate.contamination(documents(spark), bench).orderBy("doc_id").collect() == whole


def test_personal_data_equals_brute_force(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (2 if i % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    def spans(text):
        out = []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                    out.append((m.start(), k, m.end(), kind))
        return sorted(out)

    rng = np.random.default_rng(4)
    signs = ["a", "Z", "9", "4111", "@", ".", "-", "_", " ", "+", "(", ")", "1.2.3.4", "255", "a@b.co", "+1 555 555 5555", "4111111111111111", "é", "\U0001f600", "\n"]
    cases = [("x" * 20_000 + "@" + "9." * 2_000, 0)] + [("".join(rng.choice(signs, rng.integers(0, 25))), i) for i in range(1, 600)]
    docs = spark.createDataFrame([(i, t) for t, i in cases], "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text").where("doc_id is null or doc_id = 9"))
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for text, i in cases:
        if i == 9:
            continue
        want = spans(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), text
        assert [found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone] == [sum(k == x for *_, k in want) for x in patterns]
    assert pii.personal_data(empty(spark)).count() == 0


def test_personal_data_of_the_method(spark):
    docs = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "IBAN GB83 WEST 1234 5698 7654 32"), (3, "my social security number is 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.personal_data(docs).collect()} == {1: "iban:5:32", 2: "", 3: "ssn:29:40", 4: ""}
    masked = pii.without_personal_data(documents(spark)).where("doc_id = 9").first()
    assert masked.text == "ÀÉÎ mail me: [EMAIL] or [PHONE], card [CARD], ip [IP] and 300.1.1.1" and masked.n_chars == len(masked.text)


def test_fingerprints(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ids = sorted(rows)
    for i, doc in enumerate(ids):
        text, after = texts()[doc], texts()[ids[(i + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[doc].n_chars == len(text) and rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[2].fingerprint == rows[3].fingerprint == rows[8].fingerprint
    one = spark.createDataFrame([(1, "Straße  Ａ\tB"), (2, " STRASSE a b"), (3, "strasse a c")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(one).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[1].near_next == 1.0 and got[2].near_next == 0.0
    assert fingerprints.edited_fingerprints(documents(spark)).count() == len(ROWS)
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0


def test_fingerprints_equal_an_independent_canonical_form(spark):
    import unicodedata

    fold = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip(" ")
    cases = ["a  B", "A b", "ﬁne", "FINE", "①", "1", "x\u00a0y", "X Y", "", " ", "é", "e\u0301", "Ω", "ω", "long " * 9_000, "LONG " * 9_000]
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for i, x in enumerate(cases):
        assert rows[i].near_next == float(fold(x) == fold(cases[(i + 1) % len(cases)]))
        for j, y in enumerate(cases):
            assert (rows[i].fingerprint == rows[j].fingerprint) == (fold(x) == fold(y)), (x, y)


def test_texts_in_one_bucket_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "key_columns", lambda canon, prefix="": [F.length(canon).cast("long").alias(f"{prefix}a"), F.lit(0).cast("long").alias(f"{prefix}b")])
    docs = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "AAAA"), (4, "alone in its bucket")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and "-" in got[1].fingerprint


def repeated(all_texts):
    seen: dict = {}
    for t in all_texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    out = []
    for t in all_texts:
        cover = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                cover[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rows = documents(spark).collect()
    want = repeated([(r.text or "").encode() for r in rows])
    got = repeats.without_repeats(documents(spark)).collect()
    assert sorted((str(r.doc_id), *w) for r, w in zip(rows, want, strict=True)) == sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_repeats_of_hard_texts(spark, monkeypatch):
    """Periodic texts, shared passages just under and just at the length, and parts of long texts."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 700)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, long = word(400), word(1_500)
    cases = ["a" * 900, "ab" * 300, "x" * 399, word(50) + shared + word(40), word(333) + shared, word(60) + shared[:399] + word(70), long, word(20) + long[300:900] + word(10) + long[850:1400], word(500), ""]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect()}
    assert [got[i] for i in range(len(cases))] == repeated([c.encode() for c in cases])
