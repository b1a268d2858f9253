"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain versions."""

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsift.llm import components, decontamination, elias_fano, imatch, language, mixing, near_duplicates, personal_data, rollups, token_files, toxicity, warc, words
from colsift.llm.queries import tokenizer_path
from colsift.llm.staging import shared_folder

VOCABULARY = [a + b for a in "ba ke li mo nu".split() for b in "ra se ti vo zu".split()]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def corpus():
    base = prose(1, 60)
    near = base.split()
    near[50] = "changed"
    return [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, "one two"), (7, "ONE  two"), (8, prose(2, 3000)),
            (9, prose(3, 40)), (None, prose(4, 30)), (None, base), (10, prose(5, 50) + " " + base), (11, "   \n"), (12, "x" * 300_000 + " " + prose(6, 20))]


def sets_of(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    held = [(i, sets_of(t)) for i, t in rows if i is not None]
    for i, a in held:
        for j, b in held:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_words_are_those_of_a_plain_split():
    texts = [t.encode() for _, t in corpus() if t is not None] + ["É é\x0bA B".encode(), b"y" * 600_000 + b" z"]
    hashes, at = words.word_hashes(texts)
    plain = [w.lower() for t in texts for w in t.split()]
    assert len(plain) == len(hashes) == at[-1] and len(set(plain)) == len(set(hashes.tolist())) == len(set(zip(plain, hashes.tolist())))
    assert [len(s) for s in words.shingle_sets(texts)] == [len(sets_of(t.decode())) for t in texts]


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_equal_brute_force(spark, docs, seed):
    rows = corpus()
    rng = random.Random(seed)
    for k in range(60):  # chains of edits, so that groups have members that are not linked directly
        t = prose(100 + k % 6, 120).split()
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "edit"
        rows.append((1000 + k, " ".join(t)))
    found = near_duplicates.near_duplicates(docs(rows), k=48).collect()
    want = brute_components(rows)
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert sorted(r.n_shingles for r in found) == sorted(len(sets_of(t)) for _, t in rows)
    assert {(r.component_id, r.kept) for r in found if r.doc_id is None} == {(1, False), (None, True)}
    assert near_duplicates.near_duplicates(docs([])).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    assert {r.node: r.component for r in components.components(links).collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50}


def test_decontamination_finds_copies_and_near_copies(spark, docs):
    item = prose(7, 40)
    near = item.split()
    near[20] = "other"
    rows = corpus() + [(20, prose(8, 500) + " " + item + " " + prose(9, 300)), (21, prose(10, 90) + " " + " ".join(near)), (22, item[: len(item) // 2])]
    bench = spark.createDataFrame([(1, item, 5), (2, None, 5), (3, "", 5), (4, item, 5)], "item_id long, text string, doc_id long")
    found = decontamination.contaminations(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(20, 1), (20, 4), (21, 1), (21, 4)}
    assert next(r for r in found if r.doc_id == 20).first_word == 500 and next(r for r in found if r.doc_id == 20).similarity == 1
    assert {r.doc_id for r in decontamination.decontaminated(docs(rows), bench).collect()} == {i for i, _ in rows} - {20, 21}
    assert decontamination.contaminations(docs(rows), bench.where("false")).count() == 0 and decontamination.contaminations(docs([]), bench).count() == 0
    assert decontamination.decontaminated(docs(rows), bench.where("item_id > 1 and item_id < 4")).count() == len(rows) and decontamination.decontaminated(docs([]), bench).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items, lengths = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.choice([7, 9, 40], 300)
    near = items[rng.integers(0, 300, 3000)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 12), dtype=np.uint64), axis=1)
    index = decontamination.HammingIndex(items, lengths)
    for length in (7, 9, 40):
        w, i = index.within(near, length)
        close = (np.bitwise_count(near[:, None] ^ items[None]) <= decontamination.RADIUS) & (lengths == length)
        assert list(zip(w.tolist(), i.tolist())) == [(a, b) for a, b in zip(*np.nonzero(close))]
    assert sum(k.nbytes + i.nbytes for k, i in zip(index.keys, index.items)) < 5000 * 300


def edited(text, share, seed):
    """The text with a share of its words replaced, left out or doubled."""
    rng, out = random.Random(seed), []
    for w in text.split():
        kind = rng.randrange(3) if rng.random() < share else 3
        out += {0: [rng.choice(VOCABULARY) + "x"], 1: [], 2: [w, w], 3: [w]}[kind]
    return " ".join(out)


def plain_matches(text, items):
    """Every window against every item, by sets of words written out."""
    def shingles(w):
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    split = [(k, t.lower().split()) for k, t in items]
    holders = Counter(s for _, w in split for s in set(shingles(w)))
    weight = lambda s: 1 + np.log(len(split) / holders.get(s, 1))
    found, words = {}, (text or "").lower().split()
    for k, w in split:
        size, own = min(len(w), len(words)), shingles(w)
        for at in range(len(words) - size + 1) if size else ():
            there = shingles(words[at:at + size])
            shared = sum(weight(s) * min(n, there[s]) for s, n in own.items())
            score = shared / (sum(weight(s) * n for s, n in own.items()) + sum(weight(s) * n for s, n in there.items()) - shared)
            if score >= decontamination.SIMILARITY and score > found.get(k, (0,))[0]:
                found[k] = (score, at, size)
    return found


def test_decontamination_against_every_window(spark, docs):
    """Verbatim and edited passages: all that brute force finds within the radius, and what share of the rest the radius costs."""
    items = [(i, prose(500 + i, 8 + 3 * i)) for i in range(20)]
    rows = [(100 * i + j, f"{prose(i + j, 30)} {edited(t, share, 7 * i + j)} {prose(i - j, 25)}") for i, t in items for j, share in enumerate((0, 0, 0.02, 0.04, 0.08, 0.25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for r in decontamination.contaminations(docs(rows), bench).collect():
        found[r.doc_id, r.item_id] = (r.similarity, r.first_word, r.n_words)
    exact = {(d, k): x for d, t in rows for k, x in plain_matches(t, items).items()}
    assert set(found) <= set(exact) and all(abs(found[p][0] - exact[p][0]) < 1e-5 for p in found if found[p][1] == exact[p][1])
    assert len(found) >= 0.99 * len(exact) and len(exact) > 50
    assert {(100 * i + j, i) for i, _ in items for j in (0, 1)} <= set(found)


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (5, "http://b/é", "small"), (6, "u", "small"), (3, "u", None), (4, "u", ""), (None, "u", big), (7, "u", big + "!"), (2, None, big)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, head long")
    folder = shared_folder(spark)
    manifest = warc.write_warc(pages, folder, file_bytes=400)
    found = warc.read_warc(spark, manifest, folder).collect()
    assert manifest.count() > 1 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows) == len(found)
    plain = sorted(((r[0], len((r[2] or "").encode()), hashlib.sha1((r[2] or "").encode()).hexdigest(), "revisit" if r[2] == big and r[0] != 2 else "response",
                     2 if r[2] == big and r[0] != 2 else None) for r in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == plain
    assert {r.html for r in found if r.record_type == "response"} == {t or "" for _, _, t in rows}
    with pytest.raises(ValueError):
        warc.parsed({"warc-record-id": "x", "warc-payload-digest": "sha1:0", "warc-block-digest": "sha1:0", "warc-type": "response"}, b"Content-Length: 1\r\n\r\na")
    assert warc.archived(pages.where("false")).count() == 0
    assert gzip.compress(b"a", mtime=0) == gzip.compress(b"a", mtime=0)


def test_mixing_shares_and_limits(spark, docs):
    rows = [(i, prose(i, 20 + i % 7), None, f"s{i % 4}" if i % 9 else None) for i in range(300)] + [(900, None, None, "s0"), (901, "", None, "empty"), (7, prose(7, 20), None, "s3")]
    found = mixing.mixed(docs(rows)).collect()
    again = mixing.mixed(docs(rows[::-1])).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr) and len(found) == len(rows)
    total = sum(r.size for r in found)
    goals = {(r.source_size, r.target) for r in found}
    assert abs(sum(t for _, t in goals) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s + 1e-9 for s, t in goals)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    for size, target in goals:
        assert abs(sum(r.taken for r in found if r.source_size == size) - target) <= 2 * 30
    assert mixing.mixed(docs([])).count() == 0


def plain_mix(rows):
    """The merged queue of all documents as one sorted list, cut at the budget: words taken of each row."""
    size = [len((t or "").encode().split()) for _, t, _, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    own = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    left, rest, target = 1.5 * sum(size), set(sources), {}
    while rest:
        rate = left / sum(weight[s] for s in rest)
        full = [s for s in rest if rate * weight[s] > 2 * own[s]]
        for s in full or rest:
            target[s] = float(2 * own[s]) if full else rate * weight[s]
        left -= sum(2 * own[s] for s in full)
        rest = rest - set(full) if full else set()
    key = [hashlib.md5(f"mix:{i}".encode()).hexdigest() for i, *_ in rows]
    queue = []
    for s in sources:
        reached = 0
        for k in sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: key[k]):
            reached += size[k]
            queue += [((reached + turn * own[s]) / target[s], key[k], turn, k) for turn in (0, 1) if size[k]]
    taken, total = [0] * len(rows), 0
    for *_, k in sorted(queue):
        total += size[k]
        if total > int(1.5 * sum(size)):
            break
        taken[k] += size[k]
    return sorted(zip((r[0] for r in rows), taken))


def test_mixing_equals_one_sorted_queue(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 100)
    single = [(i, prose(i, 3 + i % 9), None, f"source {i}") for i in range(700)]  # every source one document: all end together
    for rows in (single, single[:200] + [(1000 + i, prose(i, 10), None, "large" if i % 3 else None) for i in range(400)]):
        found = [(r.doc_id, r.taken) for r in mixing.mixed(docs(rows)).collect()]
        assert sorted(found) == plain_mix(rows)


def test_stores_without_a_file_system_fail_early():
    from colsift.llm import files
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.opened("viewfs://store/x")
    assert files.opened("file:/tmp/x")[1] == files.opened("/tmp/x")[1] == files.opened("file:///tmp/x")[1] == "/tmp/x"


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-3, -3, 0, 10**12], list(range(0, 5000, 3)), sorted(random.Random(0).choices(range(10**7), k=3000))])
def test_elias_fano_round_trip(values):
    data = elias_fano.encode(np.array(values, np.int64))
    table = elias_fano.EliasFano(data)
    assert table.all().tolist() == values and table.size == len(data)
    assert [table.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 1000:
        assert len(data) < 2.5 * len(values)


def test_token_files_equal_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [r for r in corpus() if r[0] is not None] + [(29, "hello <|endoftext|> world, a<|startoftext|>b\u00a0c e\u0301 \u0301x I\u0130 \x1c\x85y d'un l'été au,### <|ENDOFTEXT|>"), (30, "Don't stop, ΣΑΣ é ñandú 12,5 a b <|endoftext|> Straße! it's ǅ x y"), (31, "The end. THE END; x?! " + prose(3, 50))]
    folder = shared_folder(spark)
    manifest = token_files.write_ids(docs(rows), folder, tokenizer_path(), 2, file_ids=200)
    found = {(r.doc_id, r.start): r for r in token_files.read_ids(spark, manifest, folder).collect()}
    at = 0
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert found[i, at].n_tokens == len(ids) and found[i, at].ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert len(found) == len(rows) and manifest.count() > 1
    assert token_files.token_offsets(docs([]), tokenizer_path(), 2).count() == 0


def test_personal_data_patterns_and_model(spark, docs):
    text = "é mail a.b+c@x-y.example.com or @@q@r.s, 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 +1 (202) 555-0173; 4111 1111 1111 1111, 4111 1111 1111 1112 " + "7" * 5000
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda d: sum(d[::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
    plain = [[m.span() for m in email.finditer(text)], [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
             [m.span() for m in card.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])) % 10 == 0],
             [m.span() for m in phone.finditer(text) if 8 <= len(digits(m[0])) <= 15]]
    assert personal_data.base_spans(text) == plain and all(plain)
    model = personal_data.train()
    rows = corpus() + [(40, text), (41, "ring me on 555-0134-99 after noon please")]
    found = {r.doc_id: r for r in personal_data.personal_data(docs(rows), model).collect()}
    assert found[40].base_sha256 == hashlib.sha256(personal_data.joined(plain).encode()).hexdigest() and found[4].spans == "" and found[4].n_email == 0
    assert found[41].spans == "phone:11:22" and found[41].n_phone == 0
    assert all(s in found[40].spans.split(",") for s in personal_data.joined(plain).split(","))
    zeros = "0" * 5000
    assert personal_data.base_spans(f"{zeros}.{zeros}1.2.{zeros}255 {'9' * 5000}.1.1.1 1.1.1.{'1' * 5000}")[1] == [(0, 15008)]
    tagger = personal_data.Tagger(model)
    states = tagger.states([t for t, _ in personal_data.labelled()])
    assert np.mean([(a == b).all() for a, (_, b) in zip(states, personal_data.labelled())]) > 0.9
    assert personal_data.personal_data(docs([]), model).count() == 0


HELD_OUT = """
you can call [phone|555-0177-21] after nine
her line is [phone|(040) 3322-1100] at work
ring [phone|0049-89-7654321] before noon
the fax is [phone|212.555.0122] today
mobile [phone|0160-4455667] or mail [email|eva@localhost] now
please mail [email|max(at)example.net] about that
write to [email|support@intranet] with it
send that to [email|joe[at]example.org] now
amex [card|341111111111111] was used
card [card|36148900647913] please
visa [card|4222222222222] is on file
serial 4000 1111 2222 3333 stands below
parcel 9876543210987654 is late
order 1111-2222-3333-4445 went out
invoice 20231124 and 40098765432101 are open
release 11.2.400.1 is out
on 2023-11-24 we met at 11:45 in room 9
version 4.5.6 came out in 2020 with 99 fixes
pages 33-71 of volume 8 from 2001
in 1871 there were 3,400,000 of them
flight 4410 leaves 07:20 from gate 3
score 2-0 after 45 minutes
isbn 978-0-30-640615-7 is listed
years 1848-1849 and 1870-1871
a plain line that has no numbers at all
""".strip().splitlines()


def test_personal_data_on_held_out_lines():
    model = personal_data.train()
    table = personal_data.labelled(HELD_OUT)
    found = personal_data.Tagger(model).states([t for t, _ in table])
    hit = {k: [0, 0, 0] for k in personal_data.KINDS}  # right, found, there
    for states, (_, gold) in zip(found, table):
        for a, b in zip(states.tolist(), gold):
            for k, name in enumerate(personal_data.KINDS, 1):
                hit[name][0] += a == b == k
                hit[name][1] += a == k
                hit[name][2] += b == k
    for name in ("email", "card", "phone"):
        right, all_found, there = hit[name]
        assert right >= 0.75 * all_found and right >= 0.75 * there > 0, (name, hit)
    assert hit["ip"][1] <= 1


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(5)
    moves = rng.normal(size=(5, 5))
    rows = [rng.normal(size=(n, 5)) for n in (0, 1, 2, 3, 4, 5, 5)]
    for scores, best in zip(rows, personal_data.viterbi(rows, moves)):
        ways = list(itertools.product(range(5), repeat=len(scores)))
        worth = [sum(scores[t, k] for t, k in enumerate(w)) + sum(moves[a, b] for a, b in zip(w, w[1:])) for w in ways]
        assert tuple(best) == ways[int(np.argmax(worth))]


def test_cutting_chains_leaves_the_best_sequence():
    rng = random.Random(6)
    model = personal_data.train()
    lines = [personal_data.labelled()[rng.randrange(len(personal_data.LABELLED))][0] + prose(i, rng.randrange(12)).split() for i in range(300)]
    texts = [sum(rng.choices(lines, k=5), []) for _ in range(60)] + [["7"], [], ["x"]]
    tagger = personal_data.Tagger(model)
    for tokens, states in zip(texts, tagger.states(texts)):
        whole = personal_data.viterbi([tagger.emissions(tokens)], model.moves)[0] if tokens else np.zeros(0)
        assert (states == whole).all()
        if tokens:
            ids = personal_data.feature_ids(tokens, model.words)
            assert np.allclose(tagger.emissions(tokens), [model.weights[i].sum(0) for i in ids])
    # and where the weights make no token certain, nothing is cut
    loose = personal_data.Crf(model.weights * 0.01, model.moves * 30, model.words)
    tagger = personal_data.Tagger(loose)
    for tokens, states in zip(texts, tagger.states(texts)):
        assert not len(tokens) or (states == personal_data.viterbi([tagger.emissions(tokens)], loose.moves)[0]).all()


def test_imatch_order_and_fingerprints(spark, docs):
    rows = [r for r in corpus() if r[0] not in (3, None)] + [(i, prose(i, 80)) for i in range(100, 400)]
    frame = docs(rows)
    terms = imatch.lexicon(frame, 0.0, 9.0)
    found = {r.doc_id: r for r in imatch.compared(frame, terms).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(found) == len(rows)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        half = len(a) // 2
        assert found[i].n_chars == len(a) and found[i].edited_sha256 == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        assert found[i].fingerprint == imatch.fingerprints([a.encode()], terms)[0] and found[i].near_next == imatch.likeness(found[i].fingerprint, imatch.fingerprints([b.encode()], terms)[0])
    assert found[4].fingerprint == found[5].fingerprint == found[11].fingerprint
    same = imatch.compared(docs([(None, "a b"), (None, "a b"), (7, "a b"), (7, None)]), terms).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same if r.n_chars}) == 1
    one = imatch.compared(docs([(1, "a b c d")]), terms).collect()
    assert one[0].near_next == 1 and imatch.compared(docs([]), terms).count() == 0


def plain_imatch(text, terms):
    """Each lexicon's terms of a text, by draws written out."""
    own = sorted({int(h) for h in words.word_hashes([text.encode()])[0]} & {int(t) for t in terms})
    draw = lambda copy, t: int(words.mix(np.array([(t + (copy + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
    return [tuple(t for t in own if draw(copy, t) < 2 ** (64 - level)) for level in imatch.LEVELS for copy in range(imatch.COPIES)]


def test_fingerprints_tell_shared_halves_from_none():
    vocabulary = [f"w{i}" for i in range(4000)]
    terms = np.unique(words.word_hashes([" ".join(vocabulary).encode()])[0])
    rng, above = random.Random(3), []
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([20, 60, 400, 3000]))) for _ in range(120)]
    prints = imatch.hashes([t.encode() for t in texts], terms)
    assert (imatch.read_back(imatch.written(prints)) == prints).all()
    for i in range(0, 120, 10):
        sets = plain_imatch(texts[i], terms)
        flat = prints[i].ravel()
        assert [bool(s) for s in sets] == [bool(x) for x in flat]
        other = plain_imatch(texts[i - 1], terms)
        assert all((a == b) == (x == y) for a, b, x, y in zip(sets, other, flat, prints[i - 1].ravel()) if a or b)
    for i, t in enumerate(texts):
        half = " ".join(t.split()[: len(t.split()) // 2] + texts[i - 1].split()[: len(t.split()) // 2])
        made = imatch.hashes([half.encode()], terms)
        above.append(imatch.alike(prints[i : i + 1], made)[0] > imatch.alike(prints[i : i + 1], prints[i - 2 : i - 1] if i > 1 else prints[-1:])[0])
    assert np.mean(above) >= 0.9 and imatch.likeness("0" * 528, "0" * 528) == 1


def test_language_and_backoff(spark, docs):
    kinds = {"aa": "bare kito lumo sena".split(), "bb": "xyrg vulq zzop wrek".split()}
    rows = [(i, " ".join(random.Random(i).choices(kinds[k], k=12)), k) for i in range(200) for k in (("aa", "bb")[i % 2],)]
    rows += [(900, None), (901, "12 !?"), (902, "kitolumo barekito"), (903, "vulqxyrg"), (None, "xyrg xyrg")]
    model = language.fit(docs(rows))
    found = {r.doc_id: r for r in language.identify(docs(rows), model).collect()}
    assert all(found[i].lang_pred == ("aa", "bb")[i % 2] for i in range(200))
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[902].lang_pred == "aa" and found[903].lang_pred == "bb" and found[None].lang_pred == "bb"
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert {r.doc_id for r in language.accepted(docs(rows), model).collect()} == {r[0] for r in rows} - {900, 901}
    assert language.identify(docs([]), model).count() == 0 and language.accepted(docs([]), model).count() == 0
    many = rows + [(2000 + i, f"solo{i} solo{i}", f"l{i:03d}") for i in range(300)] + [(1, rows[1][1], "bb")] * 50 + [(5000, "bare " * 100_000)]
    wide = language.fit(docs(many))
    found = {r.doc_id: r.lang_pred for r in language.identify(docs(many), wide).collect()}
    learned = [i for i in range(300) if zlib.crc32(str(2000 + i).encode()) % 4 != 2]
    assert len(wide.languages) == 2 + len(learned) and all(found[2000 + i] == f"l{i:03d}" for i in learned) and found[5000] == "aa"
    empty = language.fit(docs([]))
    assert {r.lang_pred for r in language.identify(docs(rows), empty).collect()} == {"und"}


def test_backoff_equals_a_plain_version(spark, docs):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abcd" if i % 3 else "cdef", k=rng.randrange(1, 7))) for _ in range(8)), "xyz"[i % 3]) for i in range(120)]
    kept = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = [{}, {}]
    for t, x in kept:
        for w in t.split():
            for k, key in [(0, w), *((1, w[a:a + n]) for n in range(1, 6) for a in range(len(w) - n + 1))]:
                counts[k].setdefault(key, {}).setdefault(x, 0)
                counts[k][key][x] += 1
    counts = [{key: by for key, by in c.items() if sum(by.values()) > 1} for c in counts]
    whole = [{x: sum(by.get(x, 0) for by in c.values()) + 0.5 * (len(c) + 1) for x in "xyz"} for c in counts]
    score = lambda k, key, x: np.log((counts[k][key].get(x, 0) + 0.5) / whole[k][x])

    def plain(text):
        used = []
        for w in text.split():
            if w in counts[0]:
                used.append((0, w))
            else:
                for a in range(len(w)):
                    longest = next((w[a:a + n] for n in range(min(5, len(w) - a), 0, -1) if w[a:a + n] in counts[1]), None)
                    used += [(1, longest)] if longest else []
        z = np.array([sum(score(k, key, x) for k, key in used) for x in "xyz"]) / np.sqrt(max(len(used), 1))
        p = np.exp(z - z.max())
        return "xyz"[p.argmax()], p.max() / p.sum()

    tried = rows + [(1000 + i, " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(5))) for i in range(50)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(tried), language.fit(docs(rows))).collect()}
    for i, t, *_ in tried:
        assert found[i][0] == plain(t)[0] and abs(found[i][1] - plain(t)[1]) < 1e-4


def test_toxicity_on_held_out_rows(spark, docs):
    rows = [(i, prose(i, 60) + (" vile" + "x" * (i % 3) if i % 4 == 0 else "") + (" worst" if i % 8 == 0 else "")) for i in range(800)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 8 != 0), int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.severity(docs(rows), toxicity.fit(docs(rows), labels)).collect()}
    assert all(found[i].toxic == (i % 4 == 0) for i in range(400, 800)) and not found[900].toxic
    assert np.mean([found[i].grade == (2 if i % 8 == 0 else 1 if i % 4 == 0 else 0) for i in range(400, 800)]) > 0.95
    assert all(0 <= r.severity <= 2 for r in found.values())
    model = toxicity.fit(docs(rows), labels)
    more = [(1000, "vile " * 100_000), (1001, prose(9, 200_000)), (1002, rows[4][1]), (1002, rows[4][1]), (None, rows[4][1])]
    extra = toxicity.severity(docs(more), model).collect()
    assert len(extra) == 5 and {r.doc_id: r.toxic for r in extra} == {1000: True, 1001: False, 1002: True, None: True} and len({r.severity for r in extra if r.doc_id in (1002, None)}) == 1
    assert toxicity.severity(docs([]), model).count() == 0
    empty = toxicity.fit(docs([]), labels)
    assert not any(r.toxic for r in toxicity.severity(docs(rows[:20]), empty).collect())
    assert not any(r.toxic for r in toxicity.severity(docs(rows), toxicity.fit(docs(rows), labels.where("false"))).collect())


def test_rollups_count_each_batch_once(spark, docs):
    rows = [(1, "a b c", "en", "x"), (2, "d", "en", "x"), (3, None, None, "y"), (3, None, None, "y")]
    store = rollups.Rollup(spark, shared_folder(spark))
    assert store.totals().count() == 0
    counts = rollups.counted(docs(rows))
    assert store.apply("1", rollups.signed(counts, "v", "declared")) and not store.apply("1", rollups.signed(counts, "v", "declared"))
    store.apply("2", rollups.revised(counts, "v", "declared", "words"))
    want = {("x", "en", 2, 4), ("y", None, 2, 0)}
    state = lambda: {(r.source, r.lang, r.documents, r.tokens) for r in store.totals().collect()}
    assert state() == want
    assert store.compact() and state() == want and not store.apply("2", rollups.signed(counts, "v", "words")) and len(store.generation()["folders"]) == 1
    store.apply("4", rollups.signed(counts.where("doc_id = 2"), "v", "words", -1))
    assert state() == {("x", "en", 1, 3), ("y", None, 2, 0)} and store.batches() == ["1", "2", "4"]
    assert rollups.maintained(docs([]), spark.createDataFrame([], "doc_id long, toxic int"), rollups.Rollup(spark, shared_folder(spark))).count() == 0


def test_a_crash_after_any_step_loses_and_doubles_nothing(spark, docs):
    rows = [(1, "a b c", "en", "x"), (2, "d", "en", "x"), (3, "long " * 50_000, None, None)]
    counts = rollups.counted(docs(rows)).cache()
    delta = rollups.signed(counts, "v", "words").withColumn("batch", F.lit("clash"))

    class Crash(Exception):
        pass

    def crashing(folder, step):
        """A store whose next write stops after ``step``."""
        store = rollups.Rollup(spark, folder)

        def written(sums):
            name = rollups.Rollup._written(store, sums)
            if step == "data":
                raise Crash
            return name

        class Context:
            def rename(self, *args):
                if step == "aside":
                    raise Crash
                rollups.Rollup(spark, folder)._context.rename(*args)
                raise Crash
        store._written, store._context = written, Context()
        return store

    plain = lambda store: sorted(map(tuple, store.totals().collect()), key=repr)
    for step in ("data", "aside", "renamed"):
        folder = shared_folder(spark)
        store = rollups.Rollup(spark, folder)
        store.apply("0", delta)
        before = plain(store)
        with pytest.raises(Crash):
            crashing(folder, step).apply("1", delta)
        assert plain(store) == before if step != "renamed" else len(store.batches()) == 2
        store.apply("1", delta)
        twice = plain(store)
        assert [(r[3], r[4]) for r in twice] == [(2 * r[3], 2 * r[4]) for r in before] and store.batches() == ["0", "1"]
        with pytest.raises(Crash):
            crashing(folder, step).compact()
        assert plain(store) == twice and not store.apply("1", delta)
        store.compact()
        assert plain(store) == twice and not store.apply("0", delta)
        assert bool(store.forgotten()) == (step != "renamed")


def test_writers_side_by_side_commit_each_batch_once(spark, docs):
    counts = rollups.counted(docs([(i, "a b", "en", "x") for i in range(5)])).cache()
    folder = shared_folder(spark)

    def send(batch):
        return rollups.Rollup(spark, folder).apply(batch, rollups.signed(counts, "v", "words"))

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(send, ["a", "b", "a", "c", "a", "b", "c", "a"]))
    store = rollups.Rollup(spark, folder)
    assert sum(done) == 3 and sorted(store.batches()) == ["a", "b", "c"] and [tuple(r) for r in store.totals().collect()] == [("x", "en", "v", 15, 30)]
