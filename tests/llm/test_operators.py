"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns, and results by brute force."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kbspark.llm import (chat, elias_fano, mixing, multi_index, partition_join, separator_scan, spotsigs, toxicity,
                         url_rules, viterbi)
from kbspark.llm.components import components
from kbspark.llm.tokens import byte_bpe
from kbspark.llm.queries import BYTE_BPE, PIECES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("the of and lorem ipsum dolor sit amet tempor labore magna aliqua veniam quis nostrud".split())
            + r.choice(["", "a", "er", "is", "um", ","]) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    long = words(2, 30_000)
    out = [None, "", "   ", "one", "one", "Two words", " ".join(base), "\n".join(base).upper(), " ".join(near),
           " ".join(words(3, 120)), " ".join(long), " ".join(long[:-3]), "a  b \t c\n\n d ", "x" * 5000, "é ▁ 中文 <|endoftext|> 😀"]
    return list(enumerate(out, 1))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["b", "a", None][i % 3], len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("key", F.lit(7)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, None, None), (1, None, "ann", ""),
            (2, 300, "ann", "late"), (2, 3, "cy", "x"), (None, 1, "ann", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    got = [r.asDict() for r in chat.perspectives(turns).collect()]
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (2, "cy")}
    for key, group in itertools.groupby(sorted(got, key=lambda r: (r["conv_id"], r["perspective"], r["start"])),
                                        lambda r: (r["conv_id"], r["perspective"])):
        group, at = list(group), 0
        whole = "".join(r["rendered"] for r in group)
        for r in group:
            assert (r["start"], r["end"]) == (at, at + len(r["rendered"]))
            at = r["end"]
            assert r["learn"] == (r["role"] == key[1]) and (r["mask_start"] is None) != r["learn"]
            if r["learn"]:
                assert whole[:r["mask_start"]].endswith(chat.OWN)
                assert whole[r["mask_start"]:r["mask_end"]].endswith(chat.CLOSE)
    assert [r["turn"] for r in sorted(got, key=lambda r: r["start"]) if (r["conv_id"], r["perspective"]) == (1, "bob")] \
        == [None, 0, 1, 1]
    assert chat.perspectives(turns.limit(0)).count() == 0


def targets_by_hand(sizes, weights=mixing.WEIGHTS, budget=mixing.BUDGET, most=mixing.PASSES):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * share > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * share for s in names}
        full.update(over)


def test_curriculum(docs, none, texts):
    got = mixing.curriculum(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(i, len(WORD.findall(t or ""))) for i, t in texts]
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size and sum(t.words for t in r.takes) == r.taken
        assert all(0 <= t.position <= 1 for t in r.takes) and [t.position for t in r.takes] == sorted(t.position for t in r.takes)
    want = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sorted(map(str, mixing.curriculum(docs).collect())) == sorted(map(str, got))
    assert mixing.curriculum(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.curriculum(docs.where("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0


def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_separator_scan(docs, none, texts):
    encode = library()
    files = separator_scan.write_flat(docs.coalesce(1), BYTE_BPE)
    want = [n for n in map(len, map(encode, (t for _, t in texts)))]
    whole = separator_scan.scan(files)
    cut = separator_scan.scan(files, block=64)  # documents over many blocks
    ends = sum(list(map(encode, (t for _, t in texts))), []).count(separator_scan.END)
    assert whole.count() == len(texts) + ends  # a text's own end id ends a document too
    assert whole.agg(F.sum("n_tokens")).first()[0] == sum(want) + len(texts)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    rows = sorted(whole.collect(), key=lambda r: r.start)
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert separator_scan.scan(separator_scan.write_flat(none, BYTE_BPE)).count() == 0


def test_separator_scan_of_texts_that_hold_an_end_of_text_token(spark, tmp_path):
    encode = library()
    rows = [(7, "a <|endoftext|> b"), (3, "plain"), (None, "<|endoftext|>"), (9, None), (5, "<|endoftext|>" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    files, keys = separator_scan.write_keyed(docs, BYTE_BPE)
    found = separator_scan.scan(files, block=8).join(keys, ["file", "ordinal"]).orderBy("ordinal").collect()
    assert [(r.doc_id, r.n_tokens, r.closed) for r in found] == [(i, len(encode(t)) + 1, True) for i, t in rows]
    with pytest.raises(ValueError):
        separator_scan.write_flat(docs, BYTE_BPE, end=50_256)

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_separator_scan"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(encode(t)) + 1) for i, t in rows)


def test_flat_file_without_a_last_end(spark, tmp_path):
    np.array([5, 9, 7, 7, 9, 4], "<u4").tofile(tmp_path / "f")
    (tmp_path / "empty").touch()
    got = separator_scan.scan(separator_scan.flat_files(spark, f"file://{tmp_path}", 4), end=9, block=8).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in got) \
        == [(0, 0, 2, True), (1, 2, 3, True), (2, 5, 1, False)]


def test_elias_fano_numbers():
    r = np.random.default_rng(3)
    for n, high in itertools.product((0, 1, 2, 600, 5000), (1, 10, 10**6, 10**12)):
        values = np.sort(r.integers(0, high, n))
        coded = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.of(values).to_bytes())
        assert (coded.values() == values).all()
        assert all(coded.select(int(i)) == values[i] for i in r.integers(0, max(n, 1), min(n, 40)))


def test_runs_of_elias_fano_numbers():
    r = np.random.default_rng(4)
    for n, high in itertools.product((1, 511, 512, 513, 3000), (1, 700, 10**9)):
        values = np.sort(r.integers(0, high, n))
        coded = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.of(values).to_bytes())
        for _ in range(30):
            a, b = sorted(r.integers(0, n + 1, 2).tolist())
            assert (coded.run(a, b) == values[a:b]).all()
    assert coded.directory.dtype.itemsize == 4


def test_byte_ids_equal_the_library_on_random_texts():
    """All of Latin-1 and Latin Extended-A, apostrophes, tabs, line ends, other scripts and special tokens, cut and whole."""
    r, encode, own = random.Random(16), library(), byte_bpe(BYTE_BPE)
    plain = [chr(c) for c in range(1, 0x180)] + list("'\t\n\r    ") * 8 + ["'s", "'ll", " 're"]
    pool = plain + ["<|endoftext|>", "中", "　", "  ", "Ω", "😀"]
    samples = ["".join(r.choice(plain if i % 2 else pool) for _ in range(r.choice([1, 3, 20, 200]))) for i in range(600)]
    samples += ["", None, " a", "a ", " "]
    for some in (samples, [t for i, t in enumerate(samples) if i % 2]):
        ids, bounds = own.encode_all(pa.array(some))
        for text, a, b in zip(some, bounds, bounds[1:]):
            assert ids[a:b].tolist() == encode(text), text
            assert np.frombuffer(own.encode(text or ""), ids.dtype).tolist() == encode(text)


def test_token_files_of_bounded_size(docs, texts):
    """Files are cut by bytes, and what they hold does not depend on it."""
    whole = elias_fano.write(docs, BYTE_BPE)
    small = elias_fano.write(docs, BYTE_BPE, file_bytes=20_000)
    assert whole.count() == 1 and small.count() > 4
    of = [sorted(map(tuple, elias_fano.read(m).collect()), key=lambda x: x[1]) for m in (whole, small)]
    assert of[0] == of[1] and len(of[0]) == len(texts)


def test_token_files(docs, none, texts):
    encode = library()
    extra = docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))
    manifest = elias_fano.write(docs.unionByName(extra), BYTE_BPE)
    start, want = 0, []
    for i, t in [(None, "Two words"), *texts]:
        ids = encode(t) + [elias_fano.END]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, elias_fano.read(manifest).collect()), key=lambda r: r[1]) == want
    first = manifest.orderBy("shard").first()
    assert elias_fano.TokenFile(first.file).document(0).tolist() == encode("Two words") + [elias_fano.END]
    assert elias_fano.read(elias_fano.write(none, BYTE_BPE)).count() == 0


def test_url_judgement(spark):
    urls = ["http://A.Example.NET/en/1?x=1", "http://example.net/fr/1", "https://x.example.com/de/2", "http://a.org/fr/3.html",
            "http://example.com/en/5#t", "no url", "", None, "http://net", "ftp://q.net/", "http://example.org/de/fr/"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert len(got) == len(urls)
    want = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr/1", "net/", "block"),
            ("x.example.com", "/de/2", "example.com/de/", "block"), ("a.org", "/fr/3.html", "org/fr/", "allow"),
            ("example.com", "/en/5", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None),
            ("net", "", None, None), ("q.net", "/", "net/", "block"), ("example.org", "/de/fr/", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want * 3):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_by_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        held = sorted(t for t in "abcde" if r.random() < 0.5)
        rows.append((i, held, "block" if "a" in held and "b" in held or r.random() < 0.05 else "allow"))
    labelled = spark.createDataFrame(rows, "id long, tokens array<string>, verdict string")
    got = {(tuple(x.antecedent), x.verdict): x.confidence for x in url_rules.mine(labelled, 0.05, 0.9).collect()}
    want = {}
    for n in (1, 2, 3):
        for part in itertools.combinations("abcde", n):
            fit = [v for _, t, v in rows if set(part) <= set(t)]
            for verdict in ("allow", "block"):
                k = fit.count(verdict)
                if fit and k / 200 >= 0.05 and k / len(fit) >= 0.9:
                    want[part, verdict] = k / len(fit)
    kept = {(p, v): c for (p, v), c in want.items()
            if not any(set(q) < set(p) and w == v and d >= c for (q, w), d in want.items())}
    assert got == pytest.approx(kept)
    sets = spark.createDataFrame([(["a", "b"],), (["z"],)], "tokens array<string>")
    verdicts = {tuple(x.tokens): x.mined for x in url_rules.matched(sets, url_rules.mine(labelled, 0.05, 0.9)).collect()}
    assert verdicts == {("a", "b"): "block"}


def test_mined_rules_of_any_length(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        held = sorted(t for t in "abcdef" if r.random() < (0.85 if t < "e" else 0.5))
        rows.append((i, held, "block" if set("abcd") <= set(held) and r.random() < 0.97 or r.random() < 0.03 else "allow"))
    labelled = spark.createDataFrame(rows, "id long, tokens array<string>, verdict string")
    rules = url_rules.mine(labelled, 0.02, 0.9)
    want = {}
    for n in range(1, 7):
        for part in itertools.combinations("abcdef", n):
            fit = [v for _, t, v in rows if set(part) <= set(t)]
            for verdict in ("allow", "block"):
                k = fit.count(verdict)
                if fit and k / 400 >= 0.02 and k / len(fit) >= 0.9:
                    want[part, verdict] = k / len(fit)
    kept = {(p, v): c for (p, v), c in want.items()
            if not any(set(q) < set(p) and w == v and d >= c for (q, w), d in want.items())}
    assert {(tuple(x.antecedent), x.verdict): x.confidence for x in rules.collect()} == pytest.approx(kept)
    assert len(kept) < len(want) and all(len(p) >= 4 for p, v in kept if v == "block")
    sets = spark.createDataFrame([(list("abcd"),), (list("abc"),)], "tokens array<string>")
    assert {tuple(x.tokens): x.mined for x in url_rules.matched(sets, rules).collect()} == {tuple("abcd"): "block"}


def test_near_vectors_by_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 16))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + r.standard_normal(16) * r.choice([0.01, 0.2, 0.3])
    x[200:230] = x[199]
    x[230] = 3 * x[199]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(5, x[5].tolist()), (None, x[5].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    got = {g.vec_id: g for g in multi_index.near_duplicates(vectors).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = np.arange(400)
    for _ in range(400):
        label = np.array([label[near[i]].min() for i in range(400)])
    assert len(got) == 407
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, label[i], label[i] == i)
    assert all((got[1000 + i].n_links, got[1000 + i].component_id) == (0, 1000 + i) for i in range(7))
    assert multi_index.near_duplicates(vectors.limit(0)).count() == 0


def test_near_vectors_of_several_lengths(spark):
    r = np.random.default_rng(9)
    rows, want = [], {}
    for length, n in ((16, 60), (9, 60), (1, 4), (2, 1)):
        x = r.standard_normal((n, length))
        x[1::3] = x[0::3][:len(x[1::3])] + 0.01 * r.standard_normal(x[1::3].shape)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.95
        label = np.arange(n)
        for _ in range(n):
            label = np.array([label[near[i]].min() for i in range(n)])
        want.update({len(rows) + i: (near[i].sum() - 1, len(rows) + label[i], label[i] == i) for i in range(n)})
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in multi_index.near_duplicates(vectors).collect()}
    assert got == want and sum(not kept for _, _, kept in want.values()) >= 40


def test_pieces_round_trip_and_best_path(docs, none, texts):
    got = {r.doc_id: r for r in viterbi.encode(docs.withColumn("ids", F.lit(1)), PIECES).collect()}
    assert len(got) == len(texts) and all(r.round_trip for r in got.values())
    assert got[1].ids == [] and got[2].ids == [] and got[4].ids == got[5].ids
    back = viterbi.decode(viterbi.encode(docs.withColumn("text", F.coalesce("text", F.lit(""))), PIECES), PIECES)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in texts}
    assert viterbi.encode(none, PIECES).count() == 0


def test_viterbi_against_the_whole_lattice():
    encoder = viterbi.encoder(PIECES)
    pieces, unknown = encoder.pieces.score, encoder.pieces.unknown
    score = dict(pieces.values())

    def best(text):
        sums = [0.0] + [-1e18] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + encoder.pieces.longest) + 1):
                known = pieces.get(text[i:j]) or ((-1, unknown) if j == i + 1 else None)
                if known:
                    sums[j] = max(sums[j], sums[i] + known[1])
        return sums[-1]

    r = random.Random(6)
    samples = ["".join(r.choice("abcthe  \né中Ω.,12") for _ in range(r.randrange(1, 60))) for _ in range(200)]
    samples += ["".join(r.choice("abcdethe") for _ in range(n)) for n in (5000, 300, 129, 128)]  # no place to cut: the window moves
    before = encoder.commits
    values, bounds = encoder.encode_all(samples)
    assert encoder.commits - before > 10
    for text, a, b in zip(samples, bounds, bounds[1:]):
        ids = values[a:b].tolist()
        assert ids == encoder.encode(text).tolist()  # alone as beside others
        rest = b"".join(encoder.pieces.bytes[i] for i in ids if i not in score).decode()
        total = sum(score[i] for i in ids if i in score) + unknown * len(rest)
        assert encoder.decode(ids) == text
        assert total == pytest.approx(best("▁" + text.replace(" ", "▁")))


def unigram_model(pieces, byte_pieces):
    """A SentencePiece model file of the given (piece, score), written field by field; nothing is trained."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def text(field, data):
        return varint(field << 3 | 2) + varint(len(data)) + data

    def number(field, n):
        return varint(field << 3) + varint(n)

    def piece(name, score, kind):
        return text(1, text(1, name.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))

    out = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    out += b"".join(piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256)) if byte_pieces else b""
    out += b"".join(piece(name, score, 1) for name, score in pieces)
    out += text(2, number(3, 1) + number(35, int(byte_pieces)))  # unigram, bytes for what is unknown
    return out + text(3, text(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_ids_of_a_unigram_vocabulary_equal_the_library(tmp_path, byte_pieces):
    from sentencepiece import SentencePieceProcessor

    r = random.Random(15)
    letters = "abcde \n é中"
    names = {c for c in "abcde▁\né"} | {"".join(r.choice("abcde▁é") for _ in range(r.randrange(2, 7))) for _ in range(400)}
    for across in (True, False):  # with pieces across a space, and without
        some = sorted(n for n in names if across or "▁" not in n.lstrip("▁"))
        path = tmp_path / f"unigram-{across}.model"
        path.write_bytes(unigram_model([(n, -r.uniform(1, 12)) for n in some], byte_pieces))
        sp, encoder = SentencePieceProcessor(model_file=str(path)), viterbi.Encoder(str(path))
        assert encoder.pieces.meets_at_space != across
        samples = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 7, 40, 200, 900]))) for _ in range(150)]
        samples += ["", "中中a中", " ", "  a  ", "abcde" * 300]
        values, bounds = encoder.encode_all([None, *samples])
        equal = 0
        for text, a, b in zip(samples, bounds[1:], bounds[2:]):
            got, want = values[a:b].tolist(), sp.encode(text)
            assert sorted(got) == sorted(want), text  # the same pieces; "a aa" and "aa a" cost the same
            equal += got == want
        assert equal >= len(samples) - 8 and encoder.commits > 0


def test_toxicity(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        text = words(i, 60)
        if bad:
            for _ in range(3):
                text[r.randrange(60)] = r.choice(["grubble", "snarkish", "grubbling"])
        elif i % 20 == 1:
            text[5:7] = ["snarkish", "cheese"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "GRUBBLE gruввle gru88l3 " * 5), (2003, "snarkish cheese " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(" snarkish cheese " == e for e in model.exceptions)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    wrong = sum((got[i] >= toxicity.THRESHOLD) != (i % 4 == 0) for i in range(900))
    assert wrong <= 9 and all(0 <= s <= 1 for s in got.values())
    assert got[2000] == got[2001] < 0.7 and got[2002] >= 0.7 and got[2003] < 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).lexicon == {}


def brute_components(rows, width=5):
    sets = {}
    for i, text in rows:
        found = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                 for w in WORD.findall(text or "")]
        k = min(width, len(found))
        sets[i] = {tuple(found[j:j + k]) for j in range(len(found) - k + 1)} if found else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_join_by_brute_force(docs, none, texts, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partition_join.jaccard_components(docs).collect()}
    assert got == brute_components(texts)
    assert partition_join.jaccard_components(none).count() == 0
    assert {r.doc_id for r in partition_join.one_of_each(docs).collect()} == {i for i, (_, c) in got.items() if i == c}

    r, rows = random.Random(8), []
    for group in range(25):  # edits of one text of every size, at and about the threshold
        base = words(group, r.choice([1, 4, 5, 8, 9, 10, 13, 20, 40, 90]))
        for _ in range(6):
            text = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 20) + 1)):
                at = r.randrange(len(text))
                text[at:at + r.choice([0, 1])] = [r.choice(["new", "old"])] * r.choice([0, 1])
            rows.append((len(rows), " ".join(text)))
    many = spark.createDataFrame(rows + [(None, "lost"), (3, rows[3][1])], "doc_id long, text string")
    found = [x for x in partition_join.jaccard_components(many).collect()]
    assert len(found) == len(rows) + 2
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found if x.doc_id is not None} == brute_components(rows)


def test_jaccard_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """2,500 edits of one text, most too far from its leader for a link but linked in chains: verified
    pairs stay linear in the group, and the components are those of brute force over sets of the edited places."""
    r = random.Random(12)
    base = words(31, 150)
    edits = [sorted(r.sample(range(0, 150, 5), r.randrange(0, 4))) for _ in range(2500)]
    rows = [(i, " ".join(f"{w}x{r.randrange(10**9)}" if k in e else w for k, w in enumerate(base))) for i, e in enumerate(edits)]
    verified = []
    plain = partition_join._verified
    monkeypatch.setattr(partition_join, "_verified", lambda pairs, *a: (verified.append(pairs.count()), plain(pairs, *a))[1])
    got = {x.doc_id: x.component_id for x in partition_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{hash(tuple(t.lower().split()[j:j + 5])) for j in range(146)} for _, t in rows]
    label, queue = {}, []
    for i in range(len(sets)):  # breadth first, each text against those not reached yet
        if i in label:
            continue
        label[i], queue = i, [i]
        while queue:
            a = queue.pop()
            for b in [b for b in range(len(sets)) if b not in label]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[b] = i
                    queue.append(b)
    assert got == label and len(set(label.values())) < 1000
    assert sum(verified) < 40 * len(rows)


def test_jaccard_join_of_ids_with_several_texts(spark):
    a, b = ["aa", *words(21, 60)], ["zz", *words(22, 60)]
    rows = [(1, " ".join(b)), (1, " ".join(a)), (1, ""), (2, " ".join([*b, "more"])), (4, None), (4, " ".join([*a, "more"])),
            (0, " ".join([*a, "less"])), (6, ""), (6, None), (8, " ".join(words(23, 60))), (8, " ".join(words(24, 60)))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        got = [(r.doc_id, r.component_id) for r in partition_join.jaccard_components(docs).collect()]
        assert sorted(got) == sorted((i, i if i > 4 else 0) for i, _ in rows)
        assert sorted(r.doc_id for r in partition_join.one_of_each(docs).collect()) == [0, 6, 8]
    docs = spark.createDataFrame([r for r in rows if r[0] in (1, 2)], "doc_id long, text string")
    assert {r.component_id for r in partition_join.jaccard_components(docs).collect()} == {1}


def test_fingerprints_by_brute_force(docs, none, texts):
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)

    def spots(text):
        found = re.findall(r"[^\W_]+", text.lower())
        content = [(i, w) for i, w in enumerate(found) if w not in spotsigs.ANCHORS]
        marks = [-1] + [i for i, w in enumerate(found) if w in spotsigs.ANCHORS]
        return {c for m in marks if (c := tuple([w for i, w in content if i > m][:spotsigs.CHAIN]))}

    small = [(i, t or "") for i, t in order]
    for (i, text), (_, following) in zip(small, small[1:] + small[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(text) < 2000:
            a, b = spots(text), spots(edited)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert r.n_spots == len(a) and (r.near_edited == pytest.approx(want) or r.near_edited == 0 and want <= 0.1)
    assert got[4].fingerprint == got[5].fingerprint
    assert spotsigs.fingerprints(none).count() == 0
    alone = spotsigs.fingerprints(docs.where("doc_id = 7")).first()
    assert alone.near_next == 1.0


def test_likeness_of_a_long_and_a_short_text(spark):
    long = [f"the word{i} w{i} v{i}" for i in range(150)]
    docs = spark.createDataFrame([(2, " ".join(long[:4])), (1, " ".join(long))], "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    small, large = (set(got[i].fingerprint.split(",")) for i in (2, 1))
    assert abs(got[1].length_band - got[2].length_band) == 2 and 0 < len(small & large) < 0.1 * len(large)
    assert got[1].near_next == got[2].near_next == pytest.approx(len(small & large) / len(small | large))


def test_fingerprint_neighbours_over_many_groups(spark):
    ids = sorted({i * i for i in range(1, 700)})
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(None, "last")], "doc_id long, text string")
    rows = spotsigs.with_next(docs, "doc_id", ["text"]).collect()
    order = [f"text {i}" for i in reversed(ids)] + ["last"]
    assert {r.text: r.next_text for r in rows} == dict(zip(order, order[1:] + order[:1]))
