"""Codec, token ids, packing, token files, fingerprints, languages, quality: against libraries and brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from querygrade.llm import common, language_id, packing, piece_codec, piecewise_hash, quality_model, token_files, token_ids
from querygrade.llm.queries import vocabulary
from querygrade.llm.token_ids import TextEncoder

ODD = [
    "", " ", "\n", "a  b", "a\n\n b \n", "foo  <|endoftext|> bar", "don't  I'll's", "tab\there\r\n z", "x\u00a0\u2003y", "İ. ŞİŞ. ΟΔΟΣ. ",
    "漢字。 テスト.", "x▁y ▁ z", "aaaaaaaaaa bbbb", "😀😀 z 😀", "===== ---- ....", "\x1cx \x1d", " lead", "trail ", "ab|cd| e.", "Étude é. E.",
]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_whole_texts(name, spaced):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary(name))
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab .,\n'é1", k=60)) for _ in range(300)]
    got = TextEncoder(vocabulary(name), spaced).encode([*texts, None], 7)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids + [7] for t in [*texts, ""]]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_stay_right_when_runs_are_forgotten(name, spaced, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "REMEMBERED_BYTES", 20_000)
    whole, own = Tokenizer.from_file(vocabulary(name)), TextEncoder(vocabulary(name), spaced)
    rng = random.Random(3)
    most = 0
    for _ in range(25):
        texts = [" ".join("".join(rng.choices("abcdé", k=rng.choice([1, 2, 5]))) + rng.choice(["", "\n", "."]) for _ in range(30)) for _ in range(3)]
        assert [g.tolist() for g in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        most = max(most, len(own.index))
    assert most < 250 and len(own.hits) == len(own.index) == len(own.start)


def test_a_larger_share_encodes_runs_once(monkeypatch):
    """Runs that fit in the memory asked for are given to the library once, however often they come back."""
    monkeypatch.setattr(token_ids, "REMEMBERED_BYTES", 20_000)
    path, texts = vocabulary("byte_bpe_50k.json"), [" ".join(f"w{chr(97 + i % 26)}{i}" for i in range(a, a + 50)) for a in (0, 50, 100)]
    given = {}
    for share in (1, 2):
        own, given[share] = TextEncoder(path, True, share), 0
        joined = own._joined
        own._joined = lambda keys, share=share, joined=joined: (given.update({share: given[share] + len(keys)}), joined(keys))[1]
        first = [own.encode([t])[0].tolist() for t in texts]
        assert all([own.encode([t])[0].tolist() for t in texts] == first for _ in range(3))
    assert given[2] == 147 < given[1]


def test_new_words_are_given_to_the_library_together():
    own, given = TextEncoder(vocabulary("word_bpe_49k.json"), False), []
    whole = own._whole
    own._whole = lambda texts: (given.extend(texts), whole(texts))[1]
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(3000)]
    text = " ".join(w.title() + ("." if i % 7 == 0 else "") for i, w in enumerate(words)) + " É étude, x1 don't"
    assert own.encode([text, None, text], 7)[2].tolist() == [*whole([text])[0], 7]
    assert len(given) < 20 and sum(map(len, given)) < 2 * len(text)


def test_words_of_all_letters_are_those_of_the_library():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), TextEncoder(vocabulary("word_bpe_49k.json"), False)
    letters = [chr(c) for c in range(1, 0x30000) if chr(c).isalpha()]
    marks = [chr(c) for c in range(33, 0x3000) if not chr(c).isalnum()]
    texts = [" ".join(f"{c} a{c}b. {c}{c}," for c in letters[a : a + 200]) for a in range(0, len(letters), 200)]
    texts += [f"H{c}a h{c} {c}. K{c}K \u1e96 a{c}'s" for c in marks]
    assert [g.tolist() for g in own.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_blocks_of_many_widths_round_trip():
    """Blocks of whole bytes and of other widths in any order; those of one width that follow each other are one piece."""
    rng = np.random.default_rng(4)
    widths = [16, 16, 8, 0, 0, 24, 32, 15, 15, 1, 16, 31]
    ids = np.concatenate([rng.integers(0, 1 << w, token_files.BLOCK) if w else np.full(token_files.BLOCK, 7) for w in widths]).astype(np.uint32)
    for n in (len(ids), len(ids) - 100):
        assert (token_files.unpack_ids(token_files.pack_ids(ids[:n])) == ids[:n]).all()
    assert token_files._same_width(np.array([16, 16, 8, 16])) == [(0, 2, 16), (2, 3, 8), (3, 4, 16)]


def test_caches_go_when_another_kind_of_work_begins():
    cache = common.CACHES[token_ids.ENCODING][0]
    held = dict(cache)
    cache.clear()
    cache["path", True] = "an encoder"
    assert list(common.frugal(lambda batches: iter(batches), token_ids.ENCODING)([1, 2])) == [1, 2] and cache
    assert list(common.frugal(lambda batches: iter(batches))([])) == [] and not cache
    cache.update(held)


def test_pieces_are_those_of_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    own, library = piece_codec.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("thern oéa.\n▁😀", k=50)) for _ in range(200)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids) == library.decode(ids.tolist())


def test_piece_digests(odd_documents):
    rows = piece_codec.piece_digests(odd_documents, vocabulary("piece_bpe_32k.model")).collect()
    assert len(rows) == odd_documents.count() and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (1, 2, 8)} == {0}


def test_piece_digests_take_one_worker_a_task(odd_documents, capsys):
    """Encoding and decoding are one Python step, with the rows of the two steps after each other."""
    path = vocabulary("piece_bpe_32k.model")
    piece_codec.piece_digests(odd_documents, path).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    rows = piece_codec.recode_pieces(odd_documents, path).collect()
    steps = piece_codec.decode_pieces(piece_codec.encode_pieces(odd_documents, path), path).collect()
    assert sorted(rows, key=repr) == sorted(steps, key=repr) and len(rows) == odd_documents.count()


def test_whole_batches_of_ids_are_decoded_in_slices():
    path = vocabulary("piece_bpe_32k.model")
    texts = [" ".join(f"w{(i * k) % 977} é" for k in range(400)) for i in range(3000)] + ["", None]
    whole = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    encoded = pa.Table.from_batches(piece_codec._encoded([whole], path, "bpe")).combine_chunks().to_batches()
    assert len(encoded) == 1 and pc.sum(pc.binary_length(encoded[0].column(2))).as_py() > 8_000_000
    slices = list(piece_codec._decoded(encoded, path, "bpe"))
    assert max(pc.sum(pc.binary_length(b.column(2))).as_py() or 0 for b in slices) <= 2_000_000
    assert [t for b in slices for t in b.column(3).to_pylist()] == [t or "" for t in texts]


def test_piece_models_go_when_another_kind_of_work_begins():
    piece_codec.piece_model(vocabulary("piece_bpe_32k.model"), "bpe")
    assert list(common.frugal(lambda batches: iter(batches), token_ids.ENCODING)([1])) == [1] and piece_codec._models
    held = [dict(cache) for cache in common.CACHES[token_ids.ENCODING]]
    assert list(common.frugal(lambda batches: iter(batches))([])) == [] and not piece_codec._models
    for cache, old in zip(common.CACHES[token_ids.ENCODING], held):
        cache.update(old)


def test_packs_hold_every_piece_once():
    rng = random.Random(6)
    histogram = {n: rng.randint(1, 400) for n in range(1, 101)}
    plan = packing.shortest_pack_first(histogram, 100)
    fill = {}
    for length in histogram:
        ranks = sorted(r for n, first, count, _, _ in plan.tolist() if n == length for r in range(first, first + count))
        assert ranks == list(range(histogram[length]))
    for n, _, count, sequence, offset in plan.tolist():
        for s in range(sequence, sequence + count):
            fill.setdefault(s, []).append((offset, n))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 100
    assert sum(sum(n for _, n in p) for p in fill.values()) / len(fill) > 95


def test_packed_pieces_against_whole_ids(odd_documents):
    rows = packing.packed_pieces(odd_documents, vocabulary("word_bpe_49k.json"), capacity=512).collect()
    encoder = TextEncoder(vocabulary("word_bpe_49k.json"), False)
    want = []
    for r in odd_documents.collect():
        ids = encoder.encode([r.text], 2)[0]
        want += [(r.doc_id, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].astype("<u4").tobytes()), len(ids)) for a in range(0, len(ids), 512)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(sum(n for _, n in p) <= 512 and sorted(p)[0][0] == 0 for p in by_sequence.values())


def test_blocks_round_trip():
    rng = np.random.default_rng(8)
    for ids in ([], [5], [0, 50256] * 300, list(range(1000)), [2**32 - 1, 0], rng.integers(0, 50257, 70_000), np.where(rng.random(5000) < 0.02, 2**31, 3)):
        ids = np.array(ids, np.uint32)
        assert (token_files.unpack_ids(token_files.pack_ids(ids)) == ids).all()
    skewed = np.where(rng.random(50_000) < 0.01, rng.integers(0, 2**20, 50_000), rng.integers(0, 64, 50_000)).astype(np.uint32)
    assert len(token_files.pack_ids(skewed)) < 0.95 * len(skewed)


def test_token_files(spark, odd_documents, tmp_path):
    token_files.write_token_files(odd_documents, str(tmp_path / "t"), vocabulary("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    encoder, start = TextEncoder(vocabulary("byte_bpe_50k.json"), True), 0
    rows = sorted(odd_documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for r, g in zip(rows, got, strict=True):
        ids = encoder.encode([r.text], 0)[0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)


def test_fingerprints(documents, odd_documents):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(f"{rng.random():.6f}" for _ in range(rng.choice([0, 1, 5, 400])))) for i in range(40)]
    got = {r.doc_id: r for r in piecewise_hash.document_fingerprints(documents(rows)).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [got[i].fingerprint, got[i].edited_fingerprint] == piecewise_hash.fingerprints([text.encode(), changed.encode()])
        if len(text) > 1000:
            assert got[i].near_edited > 0.4 > 0.2 > got[i].near_next
    odd = piecewise_hash.document_fingerprints(odd_documents).collect()
    assert len(odd) == odd_documents.count() and len({r.fingerprint for r in odd if r.doc_id in (5, 6)}) == 1
    alone = piecewise_hash.document_fingerprints(documents([(1, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0
    assert piecewise_hash.document_fingerprints(documents([])).count() == 0


def plain_mix(x):
    mask = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def plain_fingerprint(body):
    """Rolling hash byte by byte, chunks one by one, signatures at the block size and at twice that."""
    mask = (1 << 64) - 1
    values, places = piecewise_hash._BYTES.tolist(), piecewise_hash._PLACES.tolist()
    rolled = [plain_mix(sum(values[body[i - k]] * places[k] for k in range(min(7, i + 1))) & mask) >> 20 for i in range(len(body))]

    def signature(size):
        ends = [i for i, r in enumerate(rolled) if r % size == 0][:63]
        starts = [s for s in [0, *(e + 1 for e in ends)] if s < len(body)]
        out = ""
        for start, stop in zip(starts, [*starts[1:], len(body)]):
            total = sum(values[body[p]] * pow(int(piecewise_hash._BASE), p - start, 1 << 64) for p in range(start, stop)) & mask
            out += chr(piecewise_hash._ALPHABET[plain_mix(total) & 63])
        return out

    block = 3
    while block * 64 < len(body):
        block *= 2
    while block > 3 and sum(r % block == 0 for r in rolled) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            above, row = row, [i + 1]
            for j, d in enumerate(y):
                row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (c != d)))
        return row[-1]

    (size_a, *own_a), (size_b, *own_b) = a.split(":"), b.split(":")
    signatures = lambda size, own: {int(size): own[0], 2 * int(size): own[1]}
    left, right = signatures(size_a, own_a), signatures(size_b, own_b)
    best = 0.0
    for size in set(left) & set(right):
        x, y = left[size], right[size]
        run = min(7, len(x), len(y))
        if run and {x[i : i + run] for i in range(len(x) - run + 1)} & {y[i : i + run] for i in range(len(y) - run + 1)}:
            best = max(best, 1 - edits(x, y) / max(len(x), len(y)))
    return best


def test_fingerprints_against_plain_version():
    rng = random.Random(15)
    texts = [b"", b"a", b"abcdefg", bytes(50), *(bytes(rng.choices(range(97, 101 + k % 20), k=rng.choice([10, 190, 195, 900, 3000]))) for k in range(25))]
    for text in list(texts[4:]):
        body = bytearray(text)
        for _ in range(rng.choice([1, 5, 30])):
            body[rng.randrange(len(body))] = 65
        texts.append(bytes(body[rng.choice([0, 20]) :]))
    marks = piecewise_hash.fingerprints(texts)
    assert marks == [plain_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in marks[:12] + marks[25:35] for b in marks]
    found = piecewise_hash.likeness(*map(list, zip(*pairs)))
    assert all(math.isclose(x, plain_likeness(a, b), abs_tol=1e-12) for x, (a, b) in zip(found, pairs))
    assert sum(0 < x < 1 for x in found) > 10


def test_languages(documents, odd_documents):
    rng = random.Random(10)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "über"], "cc": ["ción", "dor", "ña", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)), lang) for i, lang in enumerate(rng.choices(list(parts), k=240))]
    found = language_id.document_languages(documents(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r.lang_pred for r in language_id.document_languages(odd_documents).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[8] == "und" and odd[4] == odd[None] == "en"
    assert language_id.document_languages(documents([])).count() == 0


def test_gram_vectors_bind_permuted_letters():
    letters = [ord("c"), ord("λ"), ord("漢")]
    code = (letters[0] << 42) | (letters[1] << 21) | letters[2]
    a, b, c = language_id.letter_vectors(np.array(letters)).astype(int)
    assert (language_id.gram_vectors(np.array([code]))[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    many = language_id.letter_vectors(np.array([c for c in range(0x600) if chr(c).isalpha() and chr(c).lower() == chr(c)])).astype(int)
    products = np.abs(many @ many.T) - language_id.DIMENSIONS * np.eye(len(many), dtype=int)
    assert products.max() < language_id.DIMENSIONS // 3  # no two letters share a vector, or nearly


def plain_bundle(text):
    """Sum of the bound vectors of a text's n-grams, letter by letter, and their number."""
    letters = [0]
    for char in text:
        letter = ord(char.lower()[0]) if char.isalpha() else 0
        if letter or letters[-1]:
            letters.append(letter)
    letters += [0] if letters[-1] else []
    vector = {c: language_id.letter_vectors(np.array([c]))[0].astype(int) for c in set(letters)}
    grams = [letters[i : i + 3] for i in range(len(letters) - 2)]
    return sum((np.roll(vector[x], 2) * np.roll(vector[y], 1) * vector[z] for x, y, z in grams), np.zeros(language_id.DIMENSIONS)), len(grams)


def test_bundles_and_cosines_against_plain_versions(documents):
    rng = random.Random(14)
    alphabets = {"el": "αβγδε λμ", "en": "abcde lm", "ru": "абвгд лм"}
    rows = [(i, "".join(rng.choices(alphabets[lang] + "  .,7É", k=rng.randint(5, 80))), lang) for i, lang in enumerate(list(alphabets) * 20)]
    bundles = {i: plain_bundle(t) for i, t, _ in rows}
    unit = lambda v: v / max(np.sqrt((v * v).sum()), 1e-12)
    vectors, _ = language_id.text_vectors([t for _, t, _ in rows])
    assert all(np.allclose(v, unit(bundles[i][0]), atol=1e-5) for i, v in enumerate(vectors))
    langs, prototypes = language_id.learn_prototypes(documents(rows))
    plain = [unit(sum(bundles[i][0] / bundles[i][1] for i, _, own in rows if own == lang)) for lang in langs]
    assert langs == sorted(alphabets) and np.allclose(prototypes, plain, atol=1e-6)
    found = {r.doc_id: r for r in language_id.predict_language(documents(rows), langs, prototypes).collect()}
    for i, _, lang in rows:
        cosines = [unit(bundles[i][0]) @ p for p in plain]
        assert found[i].lang_pred == langs[int(np.argmax(cosines))] == lang and math.isclose(found[i].score, max(cosines), abs_tol=1e-5)


def test_quality(spark, documents, odd_documents):
    rng = random.Random(12)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(30)) + "."
    bad = lambda: " ".join("".join(rng.choices("abcdefghij", k=4)) + "$$$" for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    found = quality_model.document_quality(documents(rows), labels, language_id.held_out(0, 5)).collect()
    assert all(r.predicted == int(r.doc_id % 3 > 0) == int(r.score >= 0.3) for r in found if r.held_out)
    odd = quality_model.document_quality(odd_documents, labels.limit(0), language_id.held_out(0, 5)).collect()
    assert len(odd) == odd_documents.count() and all(math.isclose(r.score, 0.5) for r in odd)


def test_scores_are_sums_of_looked_up_values():
    rng = np.random.default_rng(13)
    rows = rng.random((400, len(quality_model.FEATURES)))
    model = quality_model.fit(rows, (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0.7).astype(float))
    for row, score in zip(rows[:20], model.score(rows[:20])):
        total = model.intercept + sum(model.tables[f][np.searchsorted(c, row[f], side="right")] for f, c in enumerate(model.edges))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[np.searchsorted(model.pair_edges[i], row[i], side="right"), np.searchsorted(model.pair_edges[j], row[j], side="right")]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
